"""Packing: shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from quire.llm.batches import mapped, shared, texts_of
from quire.llm.words import PATTERN, WordCoder
from quire.session import staged

#: Letters whose classes may differ between the libraries' Unicode tables.
RARE = re.compile("[\u0530-\U0010ffff]")

#: Pieces of one length that are ranked together.
BLOCK = 1_000


class Coder(WordCoder):
    """Token ids of texts as little-endian unsigned 32-bit numbers, by a tokenizer file.

    Words of common letters are encoded, many at a time, by the same merges in a faster library;
    all else by the tokenizer itself."""

    def __init__(self, model: str, special_as_text: bool = False) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(model)
        self.model.encode_special_tokens = special_as_text
        special = [] if special_as_text else [token.content for token in self.model.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        letters = byte_letters()
        ranks = {
            bytes(letters[letter] for letter in token): at
            for token, at in self.model.get_vocab(with_added_tokens=False).items()
            if all(letter in letters for letter in token)
        }
        self.faster = tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first = np.zeros(max(ranks.values()) + 1, bool)
        self.first[[at for token, at in ranks.items() if token[:1] == b" "]] = True

    def _together(self, texts: list[str]) -> list[bytes]:
        """Texts that hold a special token's string are encoded whole: it is a token of its own."""
        apart = [at for at, text in enumerate(texts) if self.special and self.special.search(text)]
        found = super()._together(["" if at in set(apart) else text for at, text in enumerate(texts)] if apart else texts)
        for at, ids in zip(apart, self.whole([texts[at] for at in apart])):
            found[at] = ids
        return found

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.model.encode_batch(texts, add_special_tokens=False)
        return [np.array(one.ids, "<u4").tobytes() for one in found]

    def spaced(self, words: list[str]) -> list[bytes]:
        ids = [b""] * len(words)
        common = [at for at, word in enumerate(words) if word and not RARE.search(word)]
        for start in range(0, len(common), 300):
            part = common[start:start + 300]
            found = np.array(self.faster.encode_ordinary(" " + " ".join([words[at] for at in part])), "<u4")
            starts = np.flatnonzero(self.first[found])
            if len(starts) != len(part):
                raise ValueError("a word has no start, or several")
            flat, cuts = found.tobytes(), (np.append(starts, len(found)) * 4).tolist()
            for at, a, b in zip(part, cuts, cuts[1:]):
                ids[at] = flat[a:b]
        others = [at for at, found in enumerate(ids) if not found]
        for at, found in zip(others, self.whole([" " + words[at] for at in others])):
            ids[at] = found
        return ids


def byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary file writes each byte: printable bytes as they
    are in Latin-1, the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in plain]
    return {chr(byte): byte for byte in plain} | {chr(0x100 + at): byte for at, byte in enumerate(others)}


@lru_cache(maxsize=2)
def coder(model: str, special_as_text: bool = False) -> Coder:
    """One for each worker process and tokenizer."""
    return Coder(model, special_as_text)


def token_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, doc_id: str = "doc_id",
    text: str = "text", special_as_text: bool = False,
) -> DataFrame:
    """The token ids of every whole text and then ``end_id``, cut into pieces of at most
    ``capacity``: all but the last of a document are full.

    One row for each piece: ``doc_id``, ``start`` (ids of its document before it), ``length``,
    ``ids_crc32`` of its ids as little-endian unsigned 32-bit numbers, and ``doc_tokens``. The string of
    a special token in a text is that token, as in the library's own call; with ``special_as_text`` it
    is ordinary text, so that no text can fake a boundary. Null
    texts count as empty and have the end id alone; repeated rows are documents of their own; null
    ids stay null. Other columns are left out.
    """
    model = shared(docs.sparkSession, Path(tokenizer_path).read_text())
    end = np.array([end_id], "<u4").tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        encoded = coder(model.value, special_as_text).encode(texts_of(batch, "text"))
        for doc, ids in zip(batch.column("doc_id").to_pylist(), encoded):
            ids += end
            total = len(ids) // 4
            for start in range(0, total, capacity):
                part = memoryview(ids)[start * 4:(start + capacity) * 4]
                rows.append((doc, start, len(part) // 4, zlib.crc32(part), total))
        columns = zip(*rows) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = T.StructType([T.StructField(name, T.LongType()) for name in names])
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return mapped(picked, run, schema, rows=4096)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Packing patterns and how often each is used.

    Lengths come longest first; all pieces of a length go to the packs that hold least, as long as
    they fit, else into new packs. Packs with the same content are one pattern with a count, so the
    work depends on the number of lengths, not on that of the pieces.
    """
    by_used: list[list[tuple[int, tuple]]] = [[] for _ in range(capacity + 1)]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        # What is put down here can't take another piece of this length before all have had one:
        # it isn't looked at again until the scan comes to how much it holds.
        used = 1
        while left and used + length <= capacity:
            if not by_used[used]:
                used += 1
                continue
            count, pattern = by_used[used].pop()
            taken = min(count, left)
            left -= taken
            by_used[used + length].append((taken, (length, pattern)))
            if count > taken:
                by_used[used].append((count - taken, pattern))
        if left:
            fitting = capacity // length if length * 2 <= capacity else 1
            for held, count in ((fitting, left // fitting), (left % fitting, 1)):
                if held and count:
                    pattern: tuple = ()
                    for _ in range(held):
                        pattern = (length, pattern)
                    by_used[held * length].append((count, pattern))
    found = []
    for used in range(capacity, 0, -1):
        for count, pattern in by_used[used]:
            lengths = []
            while pattern:
                lengths.append(pattern[0])
                pattern = pattern[1]
            found.append((count, lengths[::-1]))
    return found


def placements(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """Where pieces go: ``(length, first_rank, last_rank, sequence, offset)``; the piece of that
    length and rank r is at ``offset`` of the sequence ``sequence + r - first_rank``."""
    placed, ranks, sequence = [], {}, 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            first = ranks.get(length, 0)
            placed.append((length, first, first + count - 1, sequence, offset))
            ranks[length] = first + count
            offset += length
        sequence += count
    return placed


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``pieces`` with the ``sequence_id`` and ``offset`` of each: sequences hold at most
    ``capacity`` tokens, gapless from 0, and are numbered without gaps.

    ``pieces`` needs ``doc_id``, ``start`` and ``length`` (1 to ``capacity``; others fail the job);
    more columns pass through, whatever their names (``sequence_id`` and ``offset`` are replaced). Null
    and repeated ids are pieces like others; rows that are the same in all columns share a block. The driver holds one count for each length and one row for
    each place of a pattern, whatever the number of pieces; the pieces of a length are ranked in
    blocks, so that a length which most pieces have is no single task.
    """
    spark = pieces.sparkSession
    # Rows travel whole under one name, so no column of theirs meets one of these. The salt is of all
    # that a row holds: it parts rows that share an id and is the same however rows are dealt out.
    names = [name for name in pieces.columns if name not in ("sequence_id", "offset")]
    pieces = staged(pieces.select("length", F.xxhash64(*names).alias("salt"), F.struct(*names).alias("row")), "pieces")
    histogram = {row.length: row.n for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 1 <= (length or 0) <= capacity for length in histogram):
        raise ValueError(f"lengths must be 1 to {capacity}")
    blocks = spark.createDataFrame(
        [(length, -(-count // BLOCK)) for length, count in histogram.items()], "length long, blocks long"
    )
    place = spark.createDataFrame(
        placements(shortest_pack_first(histogram, capacity)),
        "length long, first_rank long, last_rank long, sequence long, offset long",
    )
    cut = pieces.join(F.broadcast(blocks), "length").withColumn(
        "block", F.pmod(F.col("salt"), F.col("blocks"))
    )
    sizes = cut.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = W.partitionBy("length", "block").orderBy("salt", "row.doc_id", "row.start")
    ranked = cut.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["length", "block"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    at = F.broadcast(place.withColumnRenamed("length", "of"))
    found = (ranked["length"] == at["of"]) & ranked["rank"].between(at["first_rank"], at["last_rank"])
    return ranked.join(at, found).select(
        "row.*", (F.col("sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset",
    )
