"""Exact dedup: binary-fuse filters of an immutable snapshot screen a new batch."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.batches import known, mapped, shared, shown, texts_of
from quire.llm.bloom import holds, id_filter, id_positions
from quire.session import staged

#: What doesn't count in a text: space, and tab to carriage return.
BLANK = b" \t\n\x0b\x0c\r"

#: Digests of a bucket on average; a filter is built and asked in one task.
BUCKET = 20_000


def fuse_slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> np.ndarray:
    """Three slots of each 64-bit key, in three adjacent segments that the key chooses."""
    mixed = _mix(keys ^ np.uint64(seed))
    first = ((mixed >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
    mask = np.uint64(segment - 1)
    inside = [(mixed >> np.uint64(shift) & mask).astype(np.int64) for shift in (0, 18)]
    inside.append((_mix(mixed) & mask).astype(np.int64))
    return np.stack([(first + at) * segment + inside[at] for at in range(3)], axis=1)


def _mix(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ keys >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    keys = (keys ^ keys >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return keys ^ keys >> np.uint64(33)


def _tags(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)


def build_fuse(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """A static three-wise binary-fuse filter with 16-bit tags of distinct 64-bit keys: ``seed``,
    ``segment``, ``segments`` and the table. Slots that one key alone has are peeled off in rounds;
    keys then get their tags in the opposite order. Another seed is tried where keys remain."""
    size = len(keys)
    segment = 1 << max(2, min(18, int(np.log(max(size, 2)) / np.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(size, 2)))
    segments = max(1, int(np.ceil(size * factor / segment)) - 2)
    tags = _tags(keys)
    for seed in range(1, 1000):
        if seed % 20 == 0:
            segments += max(1, segments // 10)
        slots = fuse_slots(keys, seed, segment, segments)
        length = (segments + 2) * segment
        left, rounds = np.ones(size, bool), []
        counts = np.bincount(slots.ravel(), minlength=length)
        owners = np.zeros(length, np.uint64)
        which = np.arange(size, dtype=np.uint64)
        for column in range(3):
            np.bitwise_xor.at(owners, slots[:, column], which)
        while left.any():
            alone = np.flatnonzero(counts == 1)
            if not len(alone):
                break
            own, first = np.unique(owners[alone].astype(np.int64), return_index=True)
            rounds.append((own, alone[first]))
            left[own] = False
            gone = slots[own]
            np.subtract.at(counts, gone.ravel(), 1)
            for column in range(3):
                np.bitwise_xor.at(owners, gone[:, column], own.astype(np.uint64))
        if left.any():
            continue
        table = np.zeros(length, np.uint16)
        for own, at in reversed(rounds):
            others = table[slots[own]]
            table[at] = tags[own] ^ others[:, 0] ^ others[:, 1] ^ others[:, 2] ^ table[at]
        return seed, segment, segments, table.tobytes()
    raise ValueError("no filter was found; are there repeated keys?")


def in_fuse(keys: np.ndarray, seed: int, segment: int, segments: int, table: bytes) -> np.ndarray:
    """Which keys may be in the filter: all that are, and about one in 65,536 of the others."""
    held = np.frombuffer(table, np.uint16)[fuse_slots(keys, seed, segment, segments)]
    return (held[:, 0] ^ held[:, 1] ^ held[:, 2]) == _tags(keys)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", side: Column | None = None) -> DataFrame:
    """``doc_id``, ``side``, ``n_chars`` of the original text and the SHA-256 ``digest`` of the text
    without blanks, for every row; null texts count as empty."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch, "text")
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("side"), pa.array([len(value) for value in texts], pa.int64()),
            pa.array([sha256(value.encode().translate(None, BLANK)).digest() for value in texts], pa.binary()),
        ], names=["doc_id", "side", "n_chars", "digest"])

    picked = docs.select(
        known(doc_id).alias("doc_id"), (F.lit(0) if side is None else side).cast("int").alias("side"), F.col(text).alias("text")
    )
    return mapped(picked, run, "doc_id long, side int, n_chars long, digest binary")


def snapshot_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """One filter for each bucket of an immutable set of distinct digests (column ``digest``)."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(_keys(rows["digest"]))
        seed, segment, segments, table = build_fuse(keys)
        return pd.DataFrame({"bucket": [key[0]], "seed": [seed], "segment": [segment], "segments": [segments], "table": [table]})

    return snapshot.withColumn("bucket", _bucket("digest", buckets)).groupBy("bucket").applyInPandas(
        run, "bucket long, seed long, segment long, segments long, table binary"
    )


def screen(batch: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The distinct digests of a batch that a snapshot's filters let through."""
    def run(key: tuple, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(rows):
            return rows[["digest"]].iloc[:0]
        one = own.iloc[0]
        return rows.loc[in_fuse(_keys(rows["digest"]), int(one.seed), int(one.segment), int(one.segments), one.table), ["digest"]]

    asked = batch.select("digest").withColumn("bucket", _bucket("digest", buckets))
    return asked.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(run, "digest binary")


def _bucket(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets))


def _keys(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(value[:8] for value in column), "<u8") if len(column) else np.empty(0, np.uint64)


def exact_duplicates(
    docs: DataFrame, in_snapshot: Column, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Which row of equal texts stays: ``doc_id``, ``keep_id``, ``group_size``, ``kept`` and
    ``text_sha256`` for every row.

    Texts are equal when they are without blanks (space, tab to carriage return). The row with the
    most code points stays, then the one with the smallest id. ``in_snapshot`` says which rows are
    the snapshot: its digests are grouped once and filters built of them; the others are the new
    batch, grouped by itself. Digests of the batch that pass the filters are looked up among the
    snapshot's, and where they are there, the bytes of the two groups' first rows are compared.

    Null texts count as empty, and empty texts equal each other. Null ids are the smallest. Rows
    that repeat an id and its text all have ``kept`` true if that row stays. An empty side, or a
    null ``in_snapshot`` (batch), is no special case; other columns are left out.
    """
    rows = staged(digests(docs, doc_id, text, F.when(in_snapshot, 0).otherwise(1)), "digests")
    best = F.min(F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").alias("id"))).alias("best")
    groups = staged(rows.groupBy("side", "digest").agg(best, F.count("*").alias("n")), "digest-groups")
    old, new = groups.where("side = 0").drop("side"), groups.where("side = 1").drop("side")
    buckets = groups.count() // BUCKET + 1
    passed = staged(screen(new, snapshot_filters(old.select("digest"), buckets), buckets), "screened")
    met = new.join(passed, "digest", "left_semi").select("digest", F.col("best").alias("best_new"), F.col("n").alias("n_new")).join(
        old.select("digest", F.col("best").alias("best_old"), F.col("n").alias("n_old")), "digest"
    )
    met = staged(met, "met")
    same = met.join(_same_bytes(docs, met, doc_id, text), "digest", "left_semi")
    both = same.select(
        F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), "digest",
        F.least("best_new", "best_old").alias("best_both"), (F.col("n_new") + F.col("n_old")).alias("n_both"),
    )
    decided = staged(groups.join(both, ["side", "digest"], "left").select(
        "side", "digest", F.coalesce("best_both", "best")["id"].alias("keep_id"), F.coalesce("n_both", "n").alias("group_size"),
    ), "decided")
    return rows.join(decided, ["side", "digest"]).select(
        shown("doc_id").alias("doc_id"), shown("keep_id").alias("keep_id"), "group_size",
        (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _same_bytes(docs: DataFrame, met: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The digests of ``met`` whose groups' first rows have the same bytes without blanks."""
    firsts = met.select("digest", F.explode(F.array("best_new.id", "best_old.id")).alias("first"))
    bits = min(1 << 28, max(1 << 20, 1 << (32 * met.count()).bit_length()))
    held = shared(docs.sparkSession, id_filter(firsts.select("first"), bits))

    def wanted(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(pa.array(holds(held.value, id_positions(batch.column("first").to_numpy(), bits))))
        bare = [value.encode().translate(None, BLANK) for value in texts_of(batch, "text")]
        return pa.RecordBatch.from_arrays([batch.column("first"), pa.array(bare, pa.binary())], names=["first", "bare"])

    # A filter of the ids, at most 32 MB, lets only these rows' texts be shuffled.
    texts = mapped(docs.select(known(doc_id).alias("first"), F.col(text).alias("text")), wanted, "first long, bare binary")
    own = texts.join(firsts, "first").where(F.sha2("bare", 256) == F.lower(F.hex("digest")))  # an id may have several texts
    return own.groupBy("digest").agg(F.min("bare").alias("least"), F.max("bare").alias("most")).where(
        F.col("least") == F.col("most")
    ).select("digest")
