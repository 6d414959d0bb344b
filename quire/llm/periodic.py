"""Periodic runs of words: minimizers at several scales seed extensions, lag scans find short periods."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from quire.llm.batches import mapped, widened, with_columns

#: Periods below this are found by comparing the words at each lag; from here on, scales double.
SHORT = 16

#: Pairs of equal minimizers that are extended together.
PAIRS = 1 << 19

#: Words that are worked on together; a longer text is worked on alone.
TOGETHER = 1 << 19

#: Odd multipliers.
ODD, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers, equal words alike, and where each text's begin (and the
    end). Words are what space and tab to carriage return part; a null text has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    which, cuts = coded.indices.to_numpy(), lists.offsets.to_numpy()
    blank = pc.index(coded.dictionary, "").as_py()
    if blank >= 0:  # blanks at the ends make empty words
        real = which != blank
        cuts, which = np.append(0, np.cumsum(real))[cuts], which[real]
    return which.astype(np.int64), cuts.astype(np.int64) - cuts[0]


def _stretches(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of consecutive numbers in a sorted array."""
    if not len(at):
        return at, at
    last = np.flatnonzero(np.diff(at) > 1)
    return at[np.append(0, last + 1)], at[np.append(last, len(at) - 1)] + 1


class Repeats:
    """Maximal runs in sequences of words that are joined by separators, each unlike anything else.

    A run is a stretch with smallest period ``p``, at least ``2 * p`` and ``shortest`` long, that no
    neighbour extends. No run holds a separator: within one, that would have to equal another word."""

    def __init__(self, words: np.ndarray, cuts: np.ndarray, shortest: int) -> None:
        count = len(cuts) - 1
        self.shortest = shortest
        self.starts = cuts[:-1] + np.arange(count)
        self.longest = int(np.max(np.diff(cuts), initial=0))
        self.row = np.full(len(words) + count, -1, np.int64)
        sequence = np.repeat(np.arange(count), np.diff(cuts))
        self.row[np.arange(len(words)) + sequence] = words
        ends = cuts[1:] + np.arange(count)
        self.row[ends] = -1 - np.arange(count)
        self.sequence = np.repeat(np.arange(count), np.diff(cuts) + 1)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and periods, by start and period."""
        for period in range(1, min(SHORT, self.longest // 2 + 1)):
            self._lag(period)
        if self.longest >= 2 * SHORT:
            self._scales()
        if not self.found:
            return (np.empty(0, np.int64),) * 3
        start, end, period = (np.concatenate(part) for part in zip(*self.found))
        # A stretch that has a period also has its multiples: the smallest is the run's.
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        first = np.append(True, (np.diff(start) != 0) | (np.diff(end) != 0))
        start, end, period = start[first], end[first], period[first]
        order = np.lexsort((period, start))
        return start[order], end[order], period[order]

    def _add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        """Stretches whose words equal those a period ahead; ``end`` is that of the stretch itself."""
        whole = end + period
        long = whole - start >= np.maximum(self.shortest, 2 * period)
        if long.any():
            self.found.append((start[long], whole[long], period[long]))

    def _lag(self, period: int, low: int = 0, high: int | None = None) -> None:
        row = self.row[low:high]
        start, end = _stretches(np.flatnonzero(row[:-period] == row[period:]) + low)
        self._add(start, end, np.full(len(start), period))

    def _scales(self) -> None:
        """For each scale P, the runs with periods of P to 2 P - 1.

        Such a run holds P words and the same a period ahead. Among them is a whole block of P / 4
        grams of P / 2 words, and the same window of grams a period ahead; so the least gram of the
        block (the rightmost of equal ones) and that of the window are equal minimizers at the
        run's period. Each block's minimizer thus meets all equal ones at such a distance."""
        size, length = 1, len(self.row)
        ids = self._singles()
        self._sums()
        scale = SHORT
        while 2 * scale <= self.longest:
            while size < scale // 2:
                ids, size = self._doubled(ids, size), 2 * size
            live = np.flatnonzero(ids >= 0)
            if not len(live):
                return
            self._seeds(ids, live, scale)
            scale *= 2

    def _singles(self) -> np.ndarray:
        """For each word its number, -1 for words that are once in their sequence."""
        ids = np.full(len(self.row), -1, np.int64)
        real = np.flatnonzero(self.row >= 0)
        keys = self.sequence[real] * (int(self.row.max(initial=0)) + 1) + self.row[real]
        ids[real] = _numbered(keys)
        return ids

    def _doubled(self, ids: np.ndarray, size: int) -> np.ndarray:
        """Numbers of grams of twice as many words; what is in no repeated gram is in no run."""
        both = np.flatnonzero((ids[:-size] >= 0) & (ids[size:] >= 0)) if size < len(ids) else np.empty(0, np.int64)
        new = np.full(len(ids), -1, np.int64)
        if len(both):
            new[both] = _numbered(ids[both] * (int(ids.max()) + 1) + ids[both + size])
        return new

    def _seeds(self, ids: np.ndarray, live: np.ndarray, scale: int) -> None:
        width = scale // 4
        # Least mixed number first, rightmost of equal ones.
        keys = (ids[live].astype(np.uint64) * ODD >> np.uint64(32) << np.uint64(32)) | (np.uint64(2**32 - 1) - live.astype(np.uint64))
        least, reach = keys, 1
        while reach < width:
            least = np.minimum(least[:-reach], least[reach:]) if reach < len(least) else least[:0]
            reach *= 2
        at = live[:len(least)]
        whole = live[width - 1:] - at == width - 1
        least, at = least[whole], at[whole]
        marks = (np.uint64(2**32 - 1) - (np.unique(least) & np.uint64(2**32 - 1))).astype(np.int64)
        anchors = (np.uint64(2**32 - 1) - (least[at % width == 0] & np.uint64(2**32 - 1))).astype(np.int64)
        anchors = np.unique(anchors)
        table = np.sort(ids[marks] << 32 | marks)
        low = np.searchsorted(table, ids[anchors] << 32 | anchors + scale)
        high = np.searchsorted(table, ids[anchors] << 32 | anchors + 2 * scale)
        counts = high - low
        anchors, low, counts = anchors[counts > 0], low[counts > 0], counts[counts > 0]
        if not len(anchors):
            return
        period_at, end_at = self._covered()
        new = []
        for piece in np.array_split(np.arange(len(anchors)), max(1, -(-int(counts.sum()) // PAIRS))):
            one = np.repeat(anchors[piece], counts[piece])
            steps = np.arange(len(one)) - np.repeat(np.cumsum(counts[piece]) - counts[piece], counts[piece])
            two = table[np.repeat(low[piece], counts[piece]) + steps] & (2**32 - 1)
            lag = two - one
            # Within a run, multiples of its period give that run again.
            known = (end_at[one] >= two) & (lag % period_at[one] == 0)
            one, lag = one[~known], lag[~known]
            if len(one):
                new.append(np.unique(np.stack([*self._extended(one, lag), lag], axis=1), axis=0))
        if new:
            self._checked(np.unique(np.concatenate(new), axis=0))

    def _covered(self) -> tuple[np.ndarray, np.ndarray]:
        """For each word the period and end of the longest run found so far that holds it."""
        period_at, end_at = np.ones(len(self.row), np.int64), np.zeros(len(self.row), np.int64)
        if self.found:
            start, end, period = (np.concatenate(part) for part in zip(*self.found))
            for at in np.lexsort((-period, end - start)).tolist():
                period_at[start[at]:end[at]] = period[at]
                end_at[start[at]:end[at]] = end[at]
        return period_at, end_at

    def _sums(self) -> None:
        """Sums of the words' mixed numbers times powers of a base, modulo 2^64."""
        mixed = (self.row.astype(np.uint64) + np.uint64(1)) * ODD
        mixed ^= mixed >> np.uint64(29)
        self.powers = np.ones(len(self.row) + 1, np.uint64)
        self.powers[1:] = BASE
        self.powers = np.cumprod(self.powers, dtype=np.uint64)
        self.sums = np.append(np.uint64(0), np.cumsum(mixed * self.powers[:-1], dtype=np.uint64))

    def _same(self, one: np.ndarray, lag: np.ndarray, size: np.ndarray) -> np.ndarray:
        sums = self.sums
        return (sums[one + size] - sums[one]) * self.powers[lag] == sums[one + lag + size] - sums[one + lag]

    def _extended(self, one: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the stretch around each place whose words equal those at the lag starts and ends."""
        ahead, behind = np.zeros_like(one), np.zeros_like(one)
        step = 1 << max(0, self.longest.bit_length() - 1)
        length = len(self.row)
        while step:
            at = one + ahead
            fits = at + lag + step <= length
            fits[fits] = self._same(at[fits], lag[fits], np.full(int(fits.sum()), step))
            ahead[fits] += step
            at = one - behind - step
            fits = at >= 0
            fits[fits] = self._same(at[fits], lag[fits], np.full(int(fits.sum()), step))
            behind[fits] += step
            step //= 2
        return one - behind, one + ahead

    def _checked(self, rows: np.ndarray) -> None:
        """Adds stretches word by word proven; where sums were equal by chance, the lag is scanned."""
        start, end, lag = rows.T
        long = end + lag - start >= np.maximum(self.shortest, 2 * lag)
        row, good, scan = self.row, np.flatnonzero(long), set()
        for at in good.tolist():
            a, b, p = int(start[at]), int(end[at]), int(lag[at])
            before = a > 0 and row[a - 1] == row[a - 1 + p]
            after = b + p < len(row) and row[b] == row[b + p]
            if before or after or not np.array_equal(row[a:b], row[a + p:b + p]):
                scan.add(p)
        keep = good[~np.isin(lag[good], list(scan))] if scan else good
        self._add(start[keep], end[keep], lag[keep])
        for period in scan:
            self._lag(period)


def _numbered(keys: np.ndarray) -> np.ndarray:
    """Equal keys get one number from 0, keys that are there once get -1."""
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    repeated = counts > 1
    return np.where(repeated, np.cumsum(repeated) - 1, -1)[inverse]


def runs_of(words: np.ndarray, cuts: np.ndarray, shortest: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequence, start, length and period of every run, by sequence, start and period. ``cuts`` says
    where the sequences begin in ``words``; short ones are worked on together."""
    parts, first = [], 0
    while first < len(cuts) - 1:
        last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + TOGETHER, "right")) - 1)
        own = cuts[first:last + 1]
        repeats = Repeats(words[own[0]:own[-1]], own - own[0], shortest)
        start, end, period = repeats.runs()
        sequence = repeats.sequence[start]
        parts.append((sequence + first, start - repeats.starts[sequence], end - start, period))
        first = last
    return tuple(np.concatenate(part) if parts else np.empty(0, np.int64) for part in (zip(*parts) if parts else [()] * 4))


RUNS = T.ArrayType(T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")]))
_ARROW = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])


def find_runs(docs: DataFrame, text: str = "text", shortest: int = 12, collapsed: str | None = None) -> DataFrame:
    """``docs`` with ``n_words`` and ``runs``: every maximal stretch of consecutive words of each whole
    text with a smallest period, at least twice that and ``shortest`` words long, as an array of
    ``start`` (a word's number from 0), ``length`` and ``period``, by start and period. Where
    ``collapsed`` names a column, it gets the words that are not, in any run, after its first period,
    joined by one space.

    Words are what space and tab to carriage return part. Periods below ``SHORT`` come from a scan of
    each lag; longer ones from minimizers, whose equal pairs at a possible distance are extended by
    sums of the words and then compared word by word. Nothing is shuffled. A row's text is worked on
    whole in one task, in memory that grows with its words (some 100 bytes each).

    Null and empty texts have no words and no runs (and collapse to an empty text). Rows stay as they
    are, repeated ones too; columns of the new names are replaced, all others pass through.
    """
    kinds: dict[str, T.DataType] = {"n_words": T.LongType(), "runs": RUNS}
    if collapsed:
        kinds[collapsed] = T.StringType()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(text)
        words, cuts = word_ids(texts)
        sequence, start, length, period = runs_of(words, cuts, shortest)
        edges = np.searchsorted(sequence, np.arange(len(cuts)))
        structs = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(_ARROW))
        columns: dict[str, pa.Array] = {
            "n_words": pa.array(np.diff(cuts)), "runs": pa.ListArray.from_arrays(pa.array(edges, pa.int32()), structs),
        }
        if collapsed:
            kept = []
            for at, value in enumerate(texts.cast(pa.binary()).to_pylist()):
                own, a, b = (value or b"").split(), edges[at], edges[at + 1]
                if a < b:
                    gone = np.zeros(len(own) + 1, np.int64)
                    np.add.at(gone, start[a:b] + period[a:b], 1)
                    np.add.at(gone, start[a:b] + length[a:b], -1)
                    own = [own[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
                kept.append(b" ".join(own))
            columns[collapsed] = pa.array(kept, pa.binary()).cast(pa.string())
        return with_columns(batch, columns)

    return mapped(docs, run, widened(docs.schema, **kinds))


def with_echo(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with periodic ends: where h, the CRC-32 of the decimal id, is a multiple of 10 and the
    text has n words, each word from a = (h // 10) % n on becomes that at a + (i - a) % p, with
    p = 1 + (n - a) // (3 + h // 10 % 8). Such a text's words are joined by one space; all other texts
    stay as they are, those of null ids and null texts among them."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, changed = batch.column(doc_id).to_pylist(), {}
        for at, own in enumerate(ids):
            h = zlib.crc32(str(own).encode()) if own is not None else 1
            if h % 10 == 0 and (words := (batch.column(text)[at].as_py() or "").encode().split()):
                n, g = len(words), h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                changed[at] = b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)]).decode()
        if not changed:
            return with_columns(batch, {text: batch.column(text).cast(pa.string())})
        values = batch.column(text).to_pylist()
        return with_columns(batch, {text: pa.array([changed.get(at, value) for at, value in enumerate(values)], pa.string())})

    return mapped(docs, run, widened(docs.schema, **{text: T.StringType()}))
