"""Line dedup: two Bloom filters find the lines that may repeat; only those are shuffled."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quire.llm.batches import known, mapped, release, shared, slices, texts_of, unused, widened, with_columns
from quire.llm.bloom import Marks, filter_bits, holds, id_filter, id_positions, positions, twice_filter
from quire.session import staged

#: What is stripped from a line's ends: space, and tab to carriage return.
BLANK = " \t\n\x0b\x0c\r"


def line_keys(text: str, shortest: int) -> list[bytes | None]:
    """The digest of each line's key, None for keys of fewer than ``shortest`` code points. A key
    is the line without blanks at its ends and with A-Z in lower case."""
    keys = []
    for line in text.split("\n"):
        line = line.strip(BLANK)
        keys.append(blake2b(line.encode().lower(), digest_size=16).digest() if len(line) >= shortest else None)
    return keys


def drop_repeated_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = 20, documents: int = 3,
    most_bits: int = 1 << 28,
) -> DataFrame:
    """``docs`` without the lines that at least ``documents`` documents hold, except in the document
    with the largest id among them; ``text`` is what stays, ``n_lines`` the number of lines before
    and ``n_dropped`` of those that went.

    Lines are equal when their keys are (see ``line_keys``; 128-bit digests stand for them), and
    keys below ``shortest`` code points never go. The first pass marks each document's keys in two
    Bloom filters, seen once and seen again; the second lists the keys that the latter holds, and
    only these are shuffled, counted exactly and given to the document that keeps them. Of the texts,
    only those of documents that lose a line are shuffled; a filter of ids tells the others.

    Null and empty texts are one empty line, and come back empty. A null id is the smallest; rows
    that share an id are one document, and each loses its lines. Other columns pass through; any
    called ``n_lines`` or ``n_dropped`` are replaced. ``most_bits`` bounds the broadcast filter.
    """
    keyed = docs.select(known(doc_id).alias("doc_id"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    bits = filter_bits(size, most=most_bits)
    twice = shared(docs.sparkSession, twice_filter(keyed.mapInArrow(_marks(shortest, bits), "segment long, once binary, twice binary"), bits))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, keys = [], []
            for doc, value in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text")):
                own = list({key for key in line_keys(value, shortest) if key})
                if own:
                    own = [key for key, held in zip(own, holds(twice.value, positions(own, bits)).tolist()) if held]
                    ids += [doc] * len(own)
                    keys += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "key"])
        release()

    found = staged(keyed.mapInArrow(suspects, "doc_id long, key binary"), "line-suspects")
    confirmed = staged(
        found.groupBy("key").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= documents).select("key", "keeper"), "line-repeats",
    )
    of, lost = unused("_of", docs.columns), unused("_gone", docs.columns)
    gone = staged(
        found.join(confirmed, "key").where(F.col("doc_id") != F.col("keeper"))
        .groupBy(F.col("doc_id").alias(of)).agg(F.collect_set("key").alias(lost)), "lines-gone",
    )
    id_bits = filter_bits(128 * gone.count(), most=most_bits)
    touched = shared(docs.sparkSession, id_filter(gone.select(of), id_bits))

    def drop(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, before, dropped = [], [], []
        for value, keys in zip(texts_of(batch, text), batch.column(lost).to_pylist()):
            lines = value.split("\n")
            if keys:
                keys = set(keys)
                stay = [line for line, key in zip(lines, line_keys(value, shortest)) if key not in keys]
            else:
                stay = lines
            kept.append("\n".join(stay))
            before.append(len(lines))
            dropped.append(len(lines) - len(stay))
        done = with_columns(batch, {
            text: pa.array(kept, pa.string()), "n_lines": pa.array(before, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()),
        })
        return done.select([name for name in done.schema.names if name not in (of, lost)])

    def may_lose(batch: pa.RecordBatch) -> np.ndarray:
        return holds(touched.value, id_positions(batch.column(of).to_numpy(), id_bits))

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(pa.array(~may_lose(batch)))
        return drop(with_columns(batch, {lost: pa.nulls(batch.num_rows, pa.list_(pa.binary()))}))

    schema = widened(docs.schema, **{text: T.StringType(), "n_lines": T.LongType(), "n_dropped": T.LongType()})
    known_docs = docs.withColumn(of, known(doc_id))
    cut = mapped(known_docs, lambda batch: batch.filter(pa.array(may_lose(batch))), known_docs.schema).join(gone, of, "left")
    return mapped(known_docs, whole, schema).unionAll(mapped(cut, drop, schema))


def _marks(shortest: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks()
        for batch in slices(batches, 2048):
            found = [
                positions(list(own), bits).ravel()
                for value in texts_of(batch, "text")
                if (own := {key for key in line_keys(value, shortest) if key})
            ]
            if found:
                marks.add(np.concatenate(found))
        yield marks.pieces()
        del marks
        release()

    return run
