"""Language identification by hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quire.llm.batches import mapped, shared, slices, texts_of, widened, with_columns

#: Components of a vector, letters of an n-gram, n-gram vectors that a worker remembers.
DIMENSIONS, LETTERS, REMEMBERED = 1024, 3, 16_384

#: Joins the words of a text; it takes part in n-grams like a letter.
GAP = 0x20


class Space:
    """Random letter vectors of +1 and -1. An n-gram's vector binds its letters' vectors, each
    permuted (rotated) by its place, by multiplication; a text bundles its n-grams by addition."""

    def __init__(self) -> None:
        self.letters: dict[int, np.ndarray] = {}
        self.rows = np.empty((REMEMBERED, DIMENSIONS), np.float32)
        self.at: dict[int, int] = {}
        lower = np.arange(0x110000, dtype=np.int32)
        for code in range(0x110000):
            char = chr(code)
            if not char.isalpha():
                lower[code] = GAP
            elif len(char.lower()) == 1:
                lower[code] = ord(char.lower())
        self.lower = lower

    def letter(self, code: int) -> np.ndarray:
        found = self.letters.get(code)
        if found is None:
            bits = np.random.Generator(np.random.Philox(code)).integers(0, 2, DIMENSIONS, np.int8)
            found = self.letters[code] = (bits * 2 - 1).astype(np.float32)
        return found

    def vector(self, gram: int) -> np.ndarray:
        bound = np.ones(DIMENSIONS, np.float32)
        for place in range(LETTERS):
            bound = bound * np.roll(self.letter(gram >> 21 * (LETTERS - 1 - place) & 0x1FFFFF), LETTERS - 1 - place)
        return bound

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams of a text's lower-cased letters, whatever else it holds between
        them as one gap, and how often each occurs."""
        codes = self.lower[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
        codes = np.concatenate([[GAP], codes, [GAP]])
        codes = codes[np.append(True, (codes[1:] != GAP) | (codes[:-1] != GAP))].astype(np.int64)
        if len(codes) < LETTERS:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        size = len(codes) - LETTERS + 1
        keys = np.zeros(size, np.int64)
        for place in range(LETTERS):
            keys = keys << 21 | codes[place:place + size]
        return np.unique(keys, return_counts=True)

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(DIMENSIONS, np.float64)
        for start in range(0, len(grams), 4096):
            places = []
            for gram in grams[start:start + 4096].tolist():
                place = self.at.get(gram)
                if place is None:
                    if len(self.at) >= REMEMBERED:  # what this block has looked up goes first
                        total += counts[start:start + len(places)].astype(np.float32) @ self.rows[places]
                        start, places, self.at = start + len(places), [], {}
                    place = self.at[gram] = len(self.at)
                    self.rows[place] = self.vector(gram)
                places.append(place)
            total += counts[start:start + len(places)].astype(np.float32) @ self.rows[places]
        return total


@lru_cache(maxsize=1)
def space() -> Space:
    """One for each worker process."""
    return Space()


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang``, ``gram`` and ``n`` over all rows with a language; tasks sum before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in slices(batches):
            found: dict[str, list] = {}
            for value, label in zip(texts_of(batch, "text"), batch.column("lang").to_pylist()):
                found.setdefault(label, []).append(space().grams(value))
            for label, parts in found.items():
                old = sums.get(label)
                grams, at = np.unique(np.concatenate([p[0] for p in parts] + ([old[0]] if old else [])), return_inverse=True)
                counts = np.concatenate([p[1] for p in parts] + ([old[1]] if old else []))
                sums[label] = grams, np.bincount(at, counts, len(grams)).astype(np.int64)
        for label, (grams, counts) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"],
            )

    picked = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counted = picked.mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def prototypes(docs: DataFrame, text: str = "text", lang: str = "lang", salts: int = 16) -> DataFrame:
    """``lang`` and its ``vector``: the bundle of all its texts' n-grams. n-grams are bundled in
    ``salts`` parts for each language, whose vectors are then added."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = np.array(batch.column("lang").to_pylist(), object)
            grams, counts = batch.column("gram").to_numpy(), batch.column("n").to_numpy()
            for label in set(labels):
                own = labels == label
                sums[label] = sums.get(label, 0) + space().bundle(grams[own], counts[own])
        for label, vector in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * DIMENSIONS, pa.string()), pa.array(range(DIMENSIONS), pa.int32()), pa.array(vector)],
                names=["lang", "at", "value"],
            )

    counts = gram_counts(docs, text, lang).repartition(salts, "gram")
    parts = counts.mapInArrow(run, "lang string, at int, value double")
    return parts.groupBy("lang", "at").agg(F.sum("value").alias("value"))


def identify(docs: DataFrame, learnt: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: the language of ``learnt`` (of ``prototypes``)
    whose vector has the largest cosine with the text's, and that cosine, 0 at least.

    ``und`` and 0 where the text is null or has no letter, or nothing was learnt. Ties go to the
    first language in order of its name. Rows stay as they are; columns called ``lang_pred`` or
    ``score`` are replaced. Prototypes (one vector for each language) are broadcast.
    """
    found: dict[str, np.ndarray] = {}
    for row in learnt.collect():
        found.setdefault(row["lang"], np.zeros(DIMENSIONS))[row["at"]] = row["value"]
    names = sorted(found)
    matrix = np.array([found[name] / max(np.linalg.norm(found[name]), 1e-12) for name in names]).reshape(-1, DIMENSIONS)
    sent = shared(docs.sparkSession, (names, matrix))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, unit = sent.value
        labels, scores = [], []
        for value in texts_of(batch, text):
            grams, counts = space().grams(value)
            vector = space().bundle(grams, counts) if len(grams) and known else np.zeros(DIMENSIONS)
            size = np.linalg.norm(vector)
            if not len(grams) or not known:
                labels.append("und")
                scores.append(0.0)
                continue
            cosines = unit @ vector / max(size, 1e-12)
            best = int(np.argmax(cosines))
            labels.append(known[best])
            scores.append(float(min(1.0, max(0.0, cosines[best]))))
        return with_columns(batch, {"lang_pred": pa.array(labels, pa.string()), "score": pa.array(scores, pa.float64())})

    return mapped(docs, run, widened(docs.schema, lang_pred=T.StringType(), score=T.DoubleType()))


def bucket_of(column: str, buckets: int) -> Column:
    """crc32 of an id as text, modulo ``buckets``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % buckets
