"""Bloom filters built by tasks in sparse pieces and put together by segment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.batches import release

#: Bits of a segment; positions go to segments, and a segment is put together in one task.
SEGMENT = 1 << 20


def filter_bits(bytes_of_keys: int, least: int = 1 << 20, most: int = 1 << 28) -> int:
    """A power of two of about one bit for every eight bytes of text: some ten bits and more for
    each key of a hundred bytes. ``most`` bounds what is broadcast (32 MB); beyond it a filter fills
    up and passes more, which costs shuffling and changes no result."""
    return int(min(max(least, 1 << max(0, int(bytes_of_keys) // 8 - 1).bit_length()), most))


def positions(digests: list[bytes], bits: int) -> np.ndarray:
    """Two positions of each 16-byte digest, as an array with two columns."""
    words = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return (words & np.uint64(bits - 1)).astype(np.int64)


class Marks:
    """Positions that a task has seen once, and more than once. New ones wait until there are as
    many as old ones, so that a position is merged a few times only, however long the task is."""

    def __init__(self) -> None:
        self.once = np.empty(0, np.int64)
        self.twice = np.empty(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0

    def add(self, found: np.ndarray) -> None:
        self.waiting.append(found)
        self.n_waiting += len(found)
        if self.n_waiting > max(SEGMENT // 4, len(self.once)):
            self._merge()

    def _merge(self) -> None:
        found, counts = np.unique(np.concatenate([*self.waiting, self.once[:0]]), return_counts=True)
        self.waiting, self.n_waiting = [], 0
        again = np.union1d(found[counts > 1], found[np.isin(found, self.once, assume_unique=True)])
        self.once = np.union1d(self.once, found)
        self.twice = np.union1d(self.twice, again)

    def pieces(self) -> pa.RecordBatch:
        self._merge()
        segments = np.unique(self.once // SEGMENT)
        columns = {"segment": segments}
        for name, all_marks in (("once", self.once), ("twice", self.twice)):
            cuts = np.searchsorted(all_marks, np.append(segments, segments[-1:] + 1) * SEGMENT)
            columns[name] = [(all_marks[a:b] % SEGMENT).astype("<u4").tobytes() for a, b in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays(
            [pa.array(segments), pa.array(columns["once"], pa.binary()), pa.array(columns["twice"], pa.binary())],
            names=["segment", "once", "twice"],
        )


def twice_filter(pieces: DataFrame, bits: int) -> bytes:
    """The bits that more than one key set, over all pieces (``segment``, ``once``, ``twice``).

    Segments are put together where they are dealt to; the driver gets at most ``bits`` bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for segment, once, twice in zip(*(batch.column(name).to_pylist() for name in ("segment", "once", "twice"))):
                seen, again = held.setdefault(segment, (np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)))
                at = np.frombuffer(once, "<u4")
                again[at[seen[at]]] = True
                seen[at] = True
                again[np.frombuffer(twice, "<u4")] = True
        for segment, (_, again) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment]), pa.array([np.packbits(again, bitorder="little").tobytes()], pa.binary())], names=["segment", "bits"],
            )
        del held
        release()

    segments = max(1, bits // SEGMENT)
    dealt = pieces.repartition(min(segments, 256), "segment")
    whole = bytearray(max(bits, SEGMENT) // 8)
    for row in dealt.mapInArrow(run, "segment long, bits binary").collect():
        whole[row["segment"] * SEGMENT // 8:(row["segment"] + 1) * SEGMENT // 8] = row["bits"]
    return bytes(whole)


def holds(filter_bytes: bytes, found: np.ndarray) -> np.ndarray:
    """Which rows of positions have all their bits in the filter."""
    bits = np.frombuffer(filter_bytes, np.uint8)
    return ((bits[found >> 3] >> (found & 7).astype(np.uint8)) & 1).all(axis=1)


def id_positions(ids: np.ndarray, bits: int) -> np.ndarray:
    """Two positions of each id, as an array with two columns."""
    mixed = ids.astype(np.int64).view(np.uint64)
    columns = []
    for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        spread = (mixed ^ mixed >> np.uint64(32)) * np.uint64(odd)
        columns.append((spread >> np.uint64(20)) & np.uint64(bits - 1))
    return np.stack(columns, axis=1).astype(np.int64)


def id_filter(ids: DataFrame, bits: int) -> bytes:
    """A filter of the ids in the first column. Ids go to segments by position, each id once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks()
        for batch in batches:
            found = id_positions(batch.column(0).to_numpy(), bits).ravel()
            marks.add(np.concatenate([found, found]))
        yield marks.pieces()

    return twice_filter(ids.mapInArrow(run, "segment long, once binary, twice binary"), bits)
