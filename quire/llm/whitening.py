"""Embedding whitening: a distributed covariance, its eigenvectors in mixed precision, and the projection."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from quire.llm.batches import mapped, slices, widened, with_columns
from quire.llm.eigen import WIDE, eigenpairs
from quire.llm.vectors import matrix, real, width
from quire.session import staged

#: Rows of a batch; partial sums of so many whole numbers are exact in doubles.
ROWS = 4096

#: Whole numbers beyond this are none that the sums hold exactly; rows with such entries are left out.
LARGEST = 2.0**49

#: Rows of partial sums that come to the driver; their bytes are bounded by these and the width.
SLOTS = 16


@dataclass(frozen=True)
class Whitening:
    """What is fitted: quantising, counts and sums of the fit list, and the components kept."""

    scale: float
    offset: int
    entries: int
    count: int
    middle: np.ndarray  # whole numbers next to the means, int64
    rest: np.ndarray  # count times (mean - middle), int64
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # unit eigenvectors, one column each
    trace: float
    identity_error: float

    def whitened(self, numbers: np.ndarray) -> np.ndarray:
        """Rows of whole numbers, centred, projected and divided by the standard deviations."""
        return ((numbers - self.middle) - self.rest / max(self.count, 1)) @ self.vectors / np.sqrt(self.values)

    def deviations(self, numbers: np.ndarray) -> list[int | None]:
        """The sums of (count * number - sum)^2, exactly; None where a long doesn't hold it."""
        away = numbers - self.middle
        most = float(np.abs(away).max(initial=0)) * self.count + self.count
        if most * most * max(self.entries, 1) < 2.0**62:
            return ((away * self.count - self.rest) ** 2).sum(axis=1).tolist()
        exact = ((away.astype(object) * self.count - self.rest.astype(object)) ** 2).sum(axis=1)
        return [int(value) if value < 2**63 else None for value in exact]


def whole_numbers(column: pa.Array, entries: int, scale: float, offset: int) -> np.ndarray:
    """floor(scale * c) + offset of every entry, as int64."""
    return np.floor(matrix(column, entries) * scale).astype(np.int64) + offset


def usable(vectors: DataFrame, vector: str, entries: int, scale: float) -> DataFrame:
    """The rows whose vectors are real, as wide as most, and not beyond ``LARGEST`` when scaled."""
    within = F.forall(F.col(vector), lambda c: F.abs(c.cast("double") * scale) < LARGEST)
    return vectors.where(real(F.col(vector)) & (F.size(vector) == entries) & within)


def distinct_numbers(vectors: DataFrame, vector: str, entries: int, scale: float, offset: int) -> DataFrame:
    """Each distinct vector of whole numbers once, as bytes of two (where all fit) or eight per entry
    and without the offset. Tasks drop their own copies first, so a vector that many rows share
    reaches the shuffle once from each."""
    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        numbers = whole_numbers(batch.column(0), entries, scale, 0)
        small = np.abs(numbers).max(axis=1, initial=0) < 2**15
        wide, narrow = numbers.astype("<i8"), numbers.astype("<i2")
        packed = [(narrow if fits else wide)[at].tobytes() for at, fits in enumerate(small.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["x"])

    return mapped(vectors.select(vector), pack, "x binary", ROWS).distinct()


def _unpacked(batch: pa.RecordBatch, entries: int) -> np.ndarray:
    rows = [np.frombuffer(x, "<i8" if len(x) == 8 * entries else "<i2") for x in batch.column("x").to_pylist()]
    return np.array(rows, np.int64).reshape(-1, entries)


def _summed(rows: DataFrame, entries: int, size: int, partial: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``partial``, an array of ``size`` numbers, over all batches. Tasks add up their own,
    slots those of their tasks, and the driver at most ``SLOTS`` of them. A number goes as two
    doubles, so that no digit of ``WIDE`` is lost."""
    def body(total: np.ndarray) -> bytes:
        high = total.astype(np.float64)
        out = io.BytesIO()
        np.save(out, np.stack([high, (total - high).astype(np.float64)]))
        return out.getvalue()

    def read(data: bytes) -> np.ndarray:
        high, low = np.load(io.BytesIO(data))
        return high.astype(WIDE) + low.astype(WIDE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, WIDE)
        for batch in slices(batches, ROWS):
            total += partial(_unpacked(batch, entries))
        slot = TaskContext.get().partitionId() % SLOTS
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([body(total)], pa.binary())], names=["slot", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, sums in zip(batch.column("slot").to_pylist(), batch.column("sums").to_pylist()):
                totals[slot] = totals.get(slot, WIDE(0)) + read(sums)
        for slot, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([body(total)], pa.binary())], names=["slot", "sums"])

    schema = "slot int, sums binary"
    parts = rows.mapInArrow(run, schema).repartition(SLOTS, "slot").mapInArrow(add, schema)
    return sum((read(bytes(row["sums"])) for row in parts.collect()), np.zeros(size, WIDE))


def _products(numbers: np.ndarray) -> np.ndarray:
    """Sums of the products of all pairs of columns of whole numbers, exact in doubles where those
    hold them, else in ``WIDE``."""
    most = float(np.abs(numbers).max(initial=0))
    kind = np.float64 if len(numbers) * most * most < 2.0**53 else WIDE
    own = numbers.astype(kind)
    return (own.T @ own).astype(WIDE).ravel()


def fit(vectors: DataFrame, vector: str = "embedding", components: int = 16, scale: float = 64.0, offset: int = 1_000_000) -> Whitening:
    """The whitening of ``vectors``, whose entries c become whole numbers floor(scale * c) + offset.

    The fit list is each distinct vector of whole numbers once. A first pass over it sums them, a
    second sums products of the numbers less the whole numbers next to the means (a fraction of at
    most one half is left of the mean and is taken out of the covariance in the higher precision, so
    nothing cancels, wherever the offset puts the numbers), a third measures what whitening makes of
    it. The covariance has the list's length as divisor. Its eigenvectors come from a single-precision
    solver and are corrected in the higher precision: see ``eigen.eigenpairs``.

    Kept are the ``components`` of largest eigenvalue, but none that rounding alone could give (so
    there are no more than independent directions, and none of a list of one). Left out are rows
    whose vectors are null or empty, hold nulls or what is not finite, have another width than most,
    or numbers beyond 2^49 when scaled. The driver holds matrices of width times width.
    """
    entries = width(vectors, vector)
    nothing = Whitening(scale, offset, entries, 0, np.zeros(entries, np.int64), np.zeros(entries, np.int64), np.empty(0), np.empty((entries, 0)), 0.0, 0.0)
    if not entries:
        return nothing
    rows = staged(distinct_numbers(usable(vectors, vector, entries, scale), vector, entries, scale, offset), "whole-numbers")

    def sums(numbers: np.ndarray) -> np.ndarray:
        return np.append(numbers.sum(axis=0), len(numbers)).astype(WIDE)

    *totals, count = (int(value) for value in _summed(rows, entries, entries + 1, sums))
    if not count:
        return nothing
    middle = np.array([round(Fraction(total, count)) for total in totals], np.int64)
    rest = np.array([total - count * int(mid) for total, mid in zip(totals, middle)], np.int64)
    products = _summed(rows, entries, entries * entries, lambda numbers: _products(numbers - middle)).reshape(entries, entries)
    away = rest.astype(WIDE) / count
    covariance = products / count - np.outer(away, away)
    values, found = eigenpairs(covariance)
    kept = int((values > entries * np.finfo(float).eps * max(float(values[0]), 0.0)).sum()) if values[0] > 0 else 0
    kept = min(kept, components)
    model = Whitening(
        scale, offset, entries, count, middle, rest, values[:kept].astype(float), found[:, :kept].astype(float), float(np.trace(covariance)), 0.0,
    )

    def moments(numbers: np.ndarray) -> np.ndarray:
        white = model.whitened(numbers)
        return np.append((white.T @ white).ravel(), white.sum(axis=0)).astype(WIDE)

    error = 0.0
    if kept:
        white = _summed(rows, entries, kept * kept + kept, moments) / count
        means = white[kept * kept:]
        error = float(np.abs(white[:kept * kept].reshape(kept, kept) - np.outer(means, means) - np.eye(kept)).max())
    return Whitening(
        scale, offset, entries, count, middle + offset, rest, model.values, model.vectors, model.trace, error,
    )


def whiten(vectors: DataFrame, model: Whitening, vector: str = "embedding", whitened: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """The rows that ``fit`` would use, with ``whitened``, their projections on the components of the
    model, each divided by its standard deviation, and ``deviation``, the sum over the entries of
    (n * number - sum)^2, exactly (null where a long doesn't hold it). Rows that share a vector all
    get it; other columns pass through, those of the two new names are replaced. Nothing is shuffled.
    """
    kinds: dict[str, T.DataType] = {whitened: T.ArrayType(T.DoubleType()), deviation: T.LongType()}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        numbers = whole_numbers(batch.column(vector), model.entries, model.scale, model.offset)
        white = model.whitened(numbers)
        size = white.shape[1]
        offsets = pa.array(np.arange(len(white) + 1) * size, pa.int32())
        return with_columns(batch, {
            whitened: pa.ListArray.from_arrays(offsets, pa.array(white.ravel())),
            deviation: pa.array(model.deviations(numbers), pa.int64()),
        })

    rows = usable(vectors, vector, model.entries, model.scale) if model.entries else vectors.where(F.lit(False))
    return mapped(rows, run, widened(vectors.schema, **kinds), ROWS)
