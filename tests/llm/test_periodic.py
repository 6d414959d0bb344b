"""Periodic runs against a scan of every lag."""

import hashlib
import random
import time
import zlib

import numpy as np

from quire.llm import periodic
from quire.llm.queries import op13_periodic_runs
from tests.llm.test_operators import ODD_TEXTS, empty_table, odd_table


def brute_runs(words, shortest=12):
    """Every maximal stretch with its smallest period, by comparing all words at all lags."""
    found = {}
    for period in range(1, len(words) // 2 + 1):
        at = 0
        while at + period < len(words):
            first = at
            while at + period < len(words) and words[at] == words[at + period]:
                at += 1
            if at + period - first >= max(shortest, 2 * period) and at > first:
                found.setdefault((first, at + period - first), period)
            at += 1
    return sorted((start, length, period) for (start, length), period in found.items())


def sequence(rng):
    kind, n = rng.randrange(7), rng.randint(0, 400)
    words = []
    if kind < 2:
        return [rng.randint(0, (1, 300)[kind]) for _ in range(n)]
    if kind == 2:
        while len(words) < n:
            words += ([rng.randint(0, 3) for _ in range(rng.randint(1, 60))] * rng.randint(1, 6))[:rng.randint(1, 200)]
    elif kind == 3:
        while len(words) < n:
            words += [0] * rng.randint(1, 80) + [rng.randint(0, 3)]
    elif kind == 4:  # Fibonacci words have as many runs as there can be
        a, words = [0], [0, 1]
        while len(words) < n:
            a, words = words, words + a
    elif kind == 5:  # squares of what is itself periodic
        unit = [0, 0, 1] * rng.randint(5, 20) + [0] * rng.randint(0, 2)
        words = unit * rng.randint(2, 5) + [rng.randint(0, 5) for _ in range(rng.randint(0, 30))] + unit + unit
    else:
        words = [rng.randint(0, 99) for _ in range(n)] * 2
        if words:
            words[rng.randrange(len(words))] = 7
    return words


def test_runs_like_brute_force():
    rng = random.Random(1)
    total = 0
    for _ in range(60):
        rows = [sequence(rng) for _ in range(rng.randint(1, 4))]
        words = np.array([word for row in rows for word in row], np.int64)
        cuts = np.append(0, np.cumsum([len(row) for row in rows]))
        got = list(zip(*(part.tolist() for part in periodic.runs_of(words, cuts))))
        assert got == [(at, *run) for at, row in enumerate(rows) for run in sorted(brute_runs(row), key=lambda r: (r[0], r[2]))]
        total += len(got)
    assert total > 500


def test_runs_do_not_hang_on_the_sums(monkeypatch):
    """Where sums are equal by chance, here always, words decide."""
    monkeypatch.setattr(periodic.Repeats, "_same", lambda self, one, lag, size: np.ones(len(one), bool))
    rng = random.Random(2)
    for _ in range(10):
        row = sequence(rng)
        got = list(zip(*(part.tolist() for part in periodic.runs_of(np.array(row, np.int64), np.array([0, len(row)])))))
        assert [run[1:] for run in got] == sorted(brute_runs(row), key=lambda r: (r[0], r[2]))


def test_long_texts_take_no_square_time():
    unit = np.random.default_rng(0).integers(0, 9999, 30_000)
    began = time.time()
    for words in (np.zeros(100_000, np.int64), np.tile([0, 1, 2], 40_000), np.tile(unit, 5), np.random.default_rng(0).integers(0, 2, 100_000)):
        periodic.runs_of(words, np.array([0, len(words)]))
    assert time.time() - began < 30
    assert [part.tolist() for part in periodic.runs_of(np.tile(unit, 5), np.array([0, 150_000]))] == [[0], [0], [150_000], [30_000]]


def brute_query(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
    kept = b" ".join(word for i, word in enumerate(words) if i not in gone)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_like_brute_force(spark, tmp_path):
    rng = random.Random(4)
    texts = [*ODD_TEXTS, "a b " * 9, "x  y\tz\n" * 7 + " tail", "one\x85two\xa0three\x1cfour " * 4]
    texts += [" ".join(f"w{word}" for word in sequence(rng)) for _ in range(160)]
    texts += [" ".join(str(rng.randint(0, 10**6)) for _ in range(rng.randint(1, 300))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == [brute_query(*row) for row in enumerate(texts)]
    assert sum(zlib.crc32(str(at).encode()) % 10 == 0 for at in range(len(texts))) > 20


def test_runs_on_awkward_rows(spark):
    found = periodic.find_runs(periodic.with_echo(odd_table(spark)), collapsed="score")
    rows = found.collect()
    assert len(rows) == len(ODD_TEXTS) + 2 and found.columns == [*odd_table(spark).columns, "n_words", "runs"]
    by_text = {row.text: row for row in rows}
    assert [tuple(run) for run in by_text["word " * 3000].runs] == [(0, 3000, 1)] and by_text["word " * 3000].score == "word"
    assert by_text[None].n_words == 0 and by_text[None].runs == [] and by_text[None].score == ""
    assert all((row.n, row.bucket, row.digest) != (None, None, None) for row in rows)
    assert periodic.find_runs(empty_table(spark), collapsed="c").collect() == []
    runs = periodic.find_runs(spark.createDataFrame([("a b " * 4, "kept")], "text string, runs string"), shortest=4)
    assert [(r.n_words, [tuple(run) for run in r.runs]) for r in runs.collect()] == [(8, [(0, 8, 2)])]
