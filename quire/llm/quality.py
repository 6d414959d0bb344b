"""Quality classifier: nearest-neighbour voting on latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quire.llm.batches import mapped, shared, slices, texts_of, widened, with_columns

#: Classes of characters, in order: other, lower vowel, other lower letter, upper letter, digit,
#: space, line feed, end of sentence, comma and the like, bracket or quote, bar, symbol.
CLASSES = 12
GRAMS = CLASSES**3
REPEATS = 32
TERMS = GRAMS + REPEATS


def _class_table() -> np.ndarray:
    table = np.zeros(0x250, np.uint16)
    for code in range(0x250):
        char = chr(code)
        if char.isalpha():
            table[code] = 3 if char.isupper() else 1 if char in "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿœ" else 2
        elif char.isdigit():
            table[code] = 4
        elif char == "\n":
            table[code] = 6
        elif char.isspace():
            table[code] = 5
        elif char in ".?":
            table[code] = 7
        elif char in ",;:-":
            table[code] = 8
        elif char in "()[]{}\"'«»":
            table[code] = 9
        elif char == "|":
            table[code] = 10
        elif char.isprintable():
            table[code] = 11
    return table


TABLE = _class_table()


def features(text: str) -> np.ndarray:
    """Terms of a whole text: three-grams of character classes, damped by a square root of their
    share, and how strongly words repeat, as one of ``REPEATS`` levels for each of four measures."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    kinds = np.where(codes < len(TABLE), TABLE[np.minimum(codes, len(TABLE) - 1)], 2).astype(np.int32)
    kinds = np.concatenate([[6], kinds, [6]])
    grams = (kinds[:-2] * CLASSES + kinds[1:-1]) * CLASSES + kinds[2:] if len(kinds) > 2 else kinds[:0]
    found = np.zeros(TERMS, np.float32)
    counts = np.bincount(grams, minlength=GRAMS)
    found[:GRAMS] = np.sqrt(counts / max(len(grams), 1))
    words = text.split()
    size = max(len(words), 1)
    same = sum(a == b for a, b in zip(words, words[1:])) / size
    lines = text.split("\n")
    again = 1 - len(set(lines)) / len(lines)
    for at, share in enumerate((same, again)):
        level = min(int(share * 8), 7)
        found[GRAMS + at * 8 + level] = 0.5 if level else 0.1
    upper = float((kinds == 3).mean())
    odd = float((kinds >= 9).mean())
    for at, share in enumerate((upper, odd), 2):
        level = min(int(share * 16), 7)
        found[GRAMS + at * 8 + level] = 0.5 if level else 0.1
    return found


def _vectors(texts: list[str]) -> np.ndarray:
    return np.array([features(text) for text in texts], np.float32).reshape(-1, TERMS)


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    examples: int = 4096, dimensions: int = 48,
) -> dict[str, np.ndarray]:
    """The model: term weights, a latent-semantic basis, and unit vectors of labelled documents.

    Learnt from at most ``examples`` labelled rows of ``docs``, those with the smallest hashes of their ids;
    this is the bound on what the driver holds and broadcasts (``examples`` times ``dimensions``
    numbers, and ``TERMS`` times ``dimensions``). Rows with a null id or label don't take part; the
    label of an id that is labelled twice is the larger one.
    """
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"))
    picked = (
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.max(F.col(label)).cast("int").alias("label"))
        .join(ids, "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
    )
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [row.tobytes() for row in _vectors(texts_of(batch, "text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())], names=["doc_id", "label", "terms"],
            )

    # Every worker sees the ids of the examples, at most ``examples`` of them.
    joined = own.join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text")
    found = joined.mapInArrow(run, "doc_id long, label int, terms binary")
    rows = found.orderBy("doc_id", "terms").limit(examples).collect()
    terms = np.array([np.frombuffer(row["terms"], np.float32) for row in rows], np.float32).reshape(-1, TERMS)
    marks = np.array([row["label"] for row in rows], np.float32)
    weights = np.log((1 + len(rows)) / (1 + (terms > 0).sum(0))).astype(np.float32) + 1
    weighted = terms * weights
    if len(rows):
        _, vectors = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
        basis = vectors[:, ::-1][:, :dimensions].astype(np.float32)
    else:
        basis = np.zeros((TERMS, dimensions), np.float32)
    return {"basis": weights[:, None] * basis, "vectors": _unit(weighted @ basis), "labels": marks}


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def vote(
    rows: np.ndarray, model: dict[str, np.ndarray], neighbours: int, power: float = 8.0, block: int = 256,
) -> np.ndarray:
    """The share of label 1 among the nearest examples of each row, by cosine to a power."""
    marks = model["labels"]
    if not len(marks):
        return np.full(len(rows), 0.5)
    k = min(neighbours, len(marks))
    scores = []
    for start in range(0, len(rows), block):
        near = _unit(rows[start:start + block] @ model["basis"]) @ model["vectors"].T
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, at, 1), 1e-6).astype(np.float64) ** power
        scores.append((weight * marks[at]).sum(1) / weight.sum(1))
    return np.concatenate(scores) if scores else np.empty(0)


def classify(
    docs: DataFrame, model: dict[str, np.ndarray], text: str = "text", neighbours: int = 15,
) -> DataFrame:
    """``docs`` with ``score``, 0 to 1 (higher: label 1 is likelier), and ``predicted``, 1 from 0.5.

    Every whole text is compared with every example, exactly, block by block; only the text counts.
    Null texts count as empty; without any example all scores are 0.5. Rows stay as they are, and
    columns called ``score`` or ``predicted`` are replaced.
    """
    sent = shared(docs.sparkSession, model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = vote(_vectors(texts_of(batch, text)), sent.value, neighbours)
        return with_columns(batch, {
            "score": pa.array(scores, pa.float64()), "predicted": pa.array((scores >= 0.5).astype(np.int32)),
        })

    return mapped(docs, run, widened(docs.schema, score=T.DoubleType(), predicted=T.IntegerType()))
