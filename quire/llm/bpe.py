"""Byte-level BPE: encoding by a rank queue on a hierarchical bitmap, and decoding."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from quire.llm.batches import mapped, shared, texts_of, widened, with_columns
from quire.llm.words import PATTERN, WordCoder

#: Letters and numbers that the tables of the `regex` module have and those of
#: tiktoken 0.14 (Unicode 16) have not; there they are neither.
NEWER = (
    r"[\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1"
    r"\uab6c\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7"
    r"\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1"
    r"\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    r"\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    r"\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2"
    r"\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81"
    r"\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2"
    r"\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff"
    r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479"
    r"\U0003d000-\U0003fc3f]"
)
NEWER_FOUND = re.compile(NEWER)
#: The pattern as tiktoken reads it, for the texts that hold any of these.
OLDER_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{L}--NEW]+| ?[\p{N}--NEW]+| ?(?:[^\s\p{L}\p{N}]|NEW)+|\s+(?!\S)|\s+"
).replace("NEW", NEWER)

#: Bytes that go through the rank queue together; a longer pre-token goes alone.
TOGETHER = 4_000_000

WORD_BITS = 8
NONE = np.int32(2**31 - 1)


class RankQueue:
    """Positions by merge rank: a bucket for each rank, and two levels of bits that say which
    buckets hold any, so that the next rank is the first set bit of each level."""

    __slots__ = ("summary", "words", "buckets")

    def __init__(self) -> None:
        self.summary = 0
        self.words: dict[int, int] = {}
        self.buckets: dict[int, list[int]] = {}

    def push(self, ranks: list[int], positions: list[int]) -> None:
        for rank, position in zip(ranks, positions):
            bucket = self.buckets.get(rank)
            if bucket is None:
                self.add(rank, [position])
            else:
                bucket.append(position)

    def add(self, rank: int, bucket: list[int]) -> None:
        """A whole bucket of a rank that has none."""
        self.buckets[rank] = bucket
        word = rank >> WORD_BITS
        bits = self.words.get(word, 0)
        self.words[word] = bits | 1 << (rank & (1 << WORD_BITS) - 1)
        if not bits:
            self.summary |= 1 << word

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank and its bucket."""
        lowest = self.summary & -self.summary
        word = lowest.bit_length() - 1
        bits = self.words[word]
        first = bits & -bits
        self.words[word] = bits = bits ^ first
        if not bits:
            self.summary ^= lowest
        rank = word << WORD_BITS | first.bit_length() - 1
        return rank, self.buckets.pop(rank)


class Merges:
    """The merges of a vocabulary: which pairs of tokens make a token, and how pieces merge."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.single = np.array([ranks[bytes([byte])] for byte in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for at in range(1, len(token)):
                left, right = ranks.get(token[:at]), ranks.get(token[at:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[key] for key in self.keys.tolist()], np.int32)
        both = np.repeat(self.single, 256), np.tile(self.single, 256)
        self.of_bytes = self.rank(*both)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens, ``NONE`` where they make no token."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], NONE)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit numbers. Pieces go through one
        queue together, bucket by bucket, and never merge with each other."""
        encoded, rest = [b""] * len(pieces), []
        for at, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                encoded[at] = whole.to_bytes(4, "little")
            elif piece:
                rest.append(at)
        size, start = 0, 0
        for end, at in enumerate(rest, 1):
            size += len(pieces[at])
            if size >= TOGETHER or end == len(rest):
                for piece, ids in zip(rest[start:end], self._together([pieces[x] for x in rest[start:end]])):
                    encoded[piece] = ids
                size, start = 0, end
        return encoded

    def _together(self, pieces: list[bytes]) -> Iterable[bytes]:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        size = len(data)
        token = np.append(self.single[data], np.int32(-1))
        pair = np.full(size + 1, NONE, np.int32)
        pair[:size - 1] = self.of_bytes[data[:-1].astype(np.int32) * 256 + data[1:]]
        pair[ends - 1] = NONE
        # The neighbours of a token, by their first bytes; ``size`` stands for none.
        after, before = np.arange(1, size + 1, dtype=np.int32), np.arange(-1, size, dtype=np.int32)
        after[ends - 1] = size
        before[(ends - lengths)] = size
        alive, early = np.ones(size, bool), []
        queue = RankQueue()
        order = np.argsort(pair[:size], kind="stable").astype(np.int32)
        found, firsts = np.unique(pair[order], return_index=True)
        for rank, bucket in zip(found.tolist(), np.split(order, firsts[1:])):
            if rank != NONE:
                queue.add(rank, bucket.tolist())
        del order
        while queue.summary:
            rank, bucket = queue.pop()
            at = np.array(bucket, np.int32)
            at = np.unique(at[pair[at] == rank])  # others are stale: they have merged or changed
            right = after[at]
            linked = right[:-1] == at[1:]
            if linked.any():  # of pairs that overlap, the first, third, ... merge
                place = np.arange(len(at))
                run = np.maximum.accumulate(np.where(np.append(False, linked), 0, place))
                at = at[(place - run) % 2 == 0]
                right = after[at]
            end = after[right]
            token[at] = rank
            after[at] = end
            before[end] = at
            alive[right] = False
            pair[right] = NONE
            left = before[at]
            has_left = left < size
            changed = np.concatenate([at, left[has_left]])
            made = self.rank(token[changed], token[after[changed]])
            pair[changed] = made
            pushed = made != NONE
            if (made < rank).any():  # this one had to come first
                early += changed[made < rank].tolist()
            queue.push(made[pushed].tolist(), changed[pushed].tolist())
        counts = np.add.reduceat(alive, ends - lengths, dtype=np.int64)
        flat = token[:size][alive].astype("<u4").tobytes()
        cuts = np.append(0, np.cumsum(counts) * 4).tolist()
        ids = [flat[a:b] for a, b in zip(cuts, cuts[1:])]
        for piece in set(np.searchsorted(ends, early, side="right").tolist()) if early else ():
            ids[piece] = self._one_by_one(pieces[piece])
        return ids

    def _one_by_one(self, piece: bytes) -> bytes:
        """The same for a piece in which a merge makes a pair of a lower rank: there the leftmost
        position of a bucket merges alone, before the queue is asked again."""
        size, rank_of = len(piece), self.ranks.get
        after, before, pair = list(range(1, size + 1)), list(range(-1, size - 1)), [-1] * size
        queue = RankQueue()

        def look(at: int) -> None:
            rank = rank_of(piece[at:after[after[at]]]) if after[at] < size else None
            pair[at] = -1 if rank is None else rank
            if rank is not None:
                queue.push([rank], [at])

        for at in range(size - 1):
            look(at)
        while queue.summary:
            rank, bucket = queue.pop()
            bucket = sorted({at for at in bucket if pair[at] == rank})
            if not bucket:
                continue
            at = bucket[0]
            if bucket[1:]:
                queue.add(rank, bucket[1:])
            gone = after[at]
            after[at] = after[gone]
            pair[gone] = -1
            if after[at] < size:
                before[after[at]] = at
            look(at)
            if before[at] >= 0:
                look(before[at])
        ids, at = [], 0
        while at < size:
            ids.append(self.ranks[piece[at:after[at]]])
            at = after[at]
        return np.array(ids, "<u4").tobytes()


class Coder(WordCoder):
    """Encodes texts to little-endian unsigned 32-bit ids, and decodes them."""

    together = 8_000_000  # a run through the queue costs as many steps as there are ranks

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.merges = Merges(ranks)
        self.plain, self.older = regex.compile(PATTERN).findall, regex.compile(OLDER_PATTERN, regex.V1).findall
        by_id = sorted(ranks.items(), key=lambda item: item[1])
        lengths = np.zeros(by_id[-1][1] + 1, np.int64)
        lengths[[rank for _, rank in by_id]] = [len(token) for token, _ in by_id]
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(token for token, _ in by_id), np.uint8)

    def split(self, text: str) -> list[str]:
        return self.plain(text) if text.isascii() or not NEWER_FOUND.search(text) else self.older(text)

    def whole(self, texts: list[str]) -> list[bytes]:
        return self._joined([self.split(text) for text in texts])

    def spaced(self, words: list[str]) -> list[bytes]:
        return self._joined([self._pieces(word) for word in words])

    def _pieces(self, word: str) -> list[str]:
        if word.isalpha():  # one run of letters
            return [" " + word]
        if word[:-1].isalpha() and word[-1] in ".,":
            return [" " + word[:-1], word[-1]]
        return self.split(" " + word)

    def _joined(self, split: list[list[str]]) -> list[bytes]:
        pieces = list(set(chain.from_iterable(split)))
        ids = dict(zip(pieces, self.merges.encode([piece.encode() for piece in pieces])))
        return [ids[parts[0]] if len(parts) == 1 else b"".join(map(ids.__getitem__, parts)) for parts in split]

    def decode(self, ids: np.ndarray, block: int = 1 << 18) -> bytes:
        parts = []
        for at in range(0, len(ids), block):
            lengths = self.lengths[ids[at:at + block]]
            ends = np.cumsum(lengths)
            shift = np.repeat(self.starts[ids[at:at + block]] - ends + lengths, lengths)
            parts.append(self.bytes[shift + np.arange(len(shift))].tobytes())
        return b"".join(parts)


@lru_cache(maxsize=2)
def coder(vocabulary: bytes) -> Coder:
    """One for each worker process and vocabulary."""
    lines = (line.split() for line in vocabulary.splitlines() if line)
    return Coder({base64.b64decode(token): int(rank) for token, rank in lines})


def _id_lists(encoded: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(ids) // 4 for ids in encoded])
    values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(encoded))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def encode(
    docs: DataFrame, ranks_path: str, text: str = "text", ids: str = "ids", decoded: str | None = None,
) -> DataFrame:
    """``docs`` with the token ids of every whole text, as the rank file of ``ranks_path`` gives
    them, and, where ``decoded`` names a column, the bytes that these ids stand for.

    Null texts count as empty and have no ids. Rows stay as they are, repeated ones too; a column
    that is already called ``ids`` or ``decoded`` is replaced, others pass through. The rank file
    (about 1 MB) is broadcast. Merges never cross pre-tokens, so words are encoded once and
    remembered; a pre-token of any length is encoded whole.
    """
    vocabulary = shared(docs.sparkSession, Path(ranks_path).read_bytes())
    kinds: dict[str, T.DataType] = {ids: T.ArrayType(T.IntegerType())}
    if decoded:
        kinds[decoded] = T.BinaryType()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = coder(vocabulary.value)
        encoded = list(own.encode(texts_of(batch, text)))
        columns: dict[str, pa.Array] = {ids: _id_lists(encoded)}
        if decoded:
            back = [own.decode(np.frombuffer(value, "<u4")) for value in encoded]
            columns[decoded] = pa.array(back, pa.binary())
        return with_columns(batch, columns)

    return mapped(docs, run, widened(docs.schema, **kinds), rows=2048)


def decode(docs: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that the ids stand for. Null lists count as empty; an id that the
    vocabulary doesn't have fails the job."""
    vocabulary = shared(docs.sparkSession, Path(ranks_path).read_bytes())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = coder(vocabulary.value)
        lists = [np.array(value or [], np.int64) for value in batch.column(ids).to_pylist()]
        return with_columns(batch, {decoded: pa.array([own.decode(value) for value in lists], pa.binary())})

    return mapped(docs, run, widened(docs.schema, **{decoded: T.BinaryType()}))

