"""N-gram Jaccard join: prefix filters under several global orders, then exact verification."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.batches import known, mapped, release, shared, shown, slices
from quire.llm.bloom import Marks, filter_bits, holds, id_filter, id_positions, twice_filter
from quire.llm.components import components
from quire.session import staged

#: Counters of the frequency sketch, a bound on what is broadcast (four bytes each), and those of
#: one segment of it. Their order is all that is broadcast, so no count is too large.
COUNTERS, SEGMENT = 1 << 20, 1 << 16

#: 64-bit words of a set's parity bits.
PARITY_WORDS = 16

#: Odd multipliers of the orders and of the shingles.
ODD = tuple(np.uint64(value) for value in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
))


def mixed(keys: np.ndarray, order: int) -> np.ndarray:
    """A permutation of the 64-bit numbers for each order."""
    keys = (keys ^ keys >> np.uint64(31)) * ODD[order % len(ODD)]
    return (keys ^ keys >> np.uint64(29)) * ODD[(order + 1) % len(ODD)]


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles of so many words, A-Z in lower
    case. A text of fewer words is one shingle, one without any (or null) has none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(word) for word in coded.dictionary.to_pylist()], np.uint64)
    blank = np.array([word == "" for word in coded.dictionary.to_pylist()], bool)
    which = coded.indices.to_numpy()
    flat = hashes[which] if len(hashes) else np.empty(0, np.uint64)
    real = ~blank[which] if len(hashes) else np.empty(0, bool)
    cuts = lists.offsets.to_numpy()
    if not real.all():  # blanks at the ends make empty words
        cuts = np.append(0, np.cumsum(real))[cuts]
        flat = flat[real]
    size = len(flat) - words + 1
    rolled = np.zeros(max(size, 0), np.uint64)
    for at in range(words):
        rolled = mixed(rolled + flat[at:at + size], at) if size > 0 else rolled
    sets = []
    for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if end - start >= words:
            sets.append(np.unique(rolled[start:end - words + 1]))
        elif end > start:
            sets.append(np.array([xxhash.xxh3_64_intdigest(flat[start:end].tobytes(), seed=end - start)], np.uint64))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def frequencies(docs: DataFrame, words: int) -> np.ndarray:
    """The rank of each of ``COUNTERS`` hash classes by how many documents have shingles of it, over
    all documents. Tasks count, segments of counters are added where they are dealt to."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(COUNTERS, np.int64)
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), words)
            found = np.concatenate(sets) & np.uint64(COUNTERS - 1)
            totals += np.bincount(found.astype(np.int64), minlength=COUNTERS)
        for start in range(0, COUNTERS, SEGMENT):
            part = totals[start:start + SEGMENT]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([start // SEGMENT]), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["segment", "counts"],
                )
        release()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, counts in zip(batch.column("segment").to_pylist(), batch.column("counts").to_pylist()):
                totals[segment] = totals.get(segment, 0) + np.frombuffer(zlib.decompress(counts), np.int64)
        for segment, counts in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment]), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], names=["segment", "counts"],
            )

    schema = "segment long, counts binary"
    parts = docs.select("text").mapInArrow(count, schema).repartition(COUNTERS // SEGMENT, "segment").mapInArrow(add, schema)
    totals = np.zeros(COUNTERS, np.int64)
    for row in parts.collect():
        totals[row["segment"] * SEGMENT:(row["segment"] + 1) * SEGMENT] = np.frombuffer(zlib.decompress(row["counts"]), np.int64)
    return np.unique(totals, return_inverse=True)[1].astype(np.uint32)


def prefixes(shingles: np.ndarray, size: int, loads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``size`` shingles under three global orders: by rising frequency, and two random
    ones, of which 32 bits are kept."""
    load = loads[(shingles & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64)
    rank = load << np.uint64(40) | mixed(shingles, 0) >> np.uint64(24)
    first = shingles[np.argsort(rank, kind="stable")[:size]]
    others = []
    for order in (1, 2):
        rank = mixed(shingles, order)
        at = np.argpartition(rank, size - 1)[:size] if size < len(rank) else slice(None)
        others.append(shingles[at].astype(np.uint32).view(np.int32))
    return first.view(np.int64), *others


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """For each of the classes of a hash, whether the set has an odd number of shingles in it. Two
    sets differ in at least as many shingles as their bits differ in places."""
    classes = 64 * PARITY_WORDS
    counts = np.bincount((mixed(shingles, 3) % np.uint64(classes)).astype(np.int64), minlength=classes)
    return np.packbits((counts & 1).astype(bool)).view(np.int64)


def similar_documents(
    docs: DataFrame, words: int = 5, share: tuple[int, int] = (80, 100), doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row: the smallest id that links
    reach. Documents link when the Jaccard similarity of their sets of word shingles is at least
    ``share`` (a fraction of whole numbers).

    Words are what blanks (space, tab to carriage return) part, A-Z in lower case; a text with
    fewer than ``words`` of them is one shingle. Equal sets are one class from the start, so copies
    are never paired. Of a class, the shingles that come first under a global order are its prefix;
    documents that link share one under every order. Candidates come from the order by frequency
    (which keeps common passages out of prefixes) and must pass two random orders as well, and their
    parity bits must not prove that the sets differ in too much; the sets of what is left are compared
    exactly.

    Each prefix shingle first pairs its documents with one of them, the one that has it earliest.
    Where links then leave several components among a shingle's documents, those of different
    components are paired too, so no link that joins components is missed, and a group of many near
    copies costs no pairs within what the first step has joined. These pairs meet the parity bits in
    the join itself: of documents that are almost similar to a large group, few pairs come out of it.
    No candidate is dropped otherwise.

    Null and empty texts have no shingles, link with nothing and are their own component; null ids
    are the smallest id and stay null. Rows that share an id count as one document. Other columns
    are left out.
    """
    own = docs.select(known(doc_id).alias("doc_id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    loads = shared(spark, frequencies(own, words))
    rows = staged(mapped(own, _prefix_rows(words, share, loads), PREFIXES), "prefixes")
    classes = staged(rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("class")), "classes")
    first = rows.join(classes, (rows["digest"] == classes["digest"]) & (rows["doc_id"] == classes["class"]), "left_semi")
    kept = staged(_repeated(first, _prefix_total(rows)), "repeated")
    tokens = kept.select("doc_id", "n", F.inline("places"))

    centers = tokens.groupBy("token").agg(
        F.min(F.struct("i", "n", "doc_id")).alias("center"), F.count("*").alias("members")
    ).where("members > 1").select("token", F.col("center.doc_id").alias("x"), F.col("center.n").alias("nx"), F.col("center.i").alias("ix"))
    centers = staged(centers, "centers")
    star = tokens.join(centers, "token").where(
        (F.col("doc_id") != F.col("x")) & _possible(F.col("n"), F.col("i"), F.col("nx"), F.col("ix"), share)
    ).select("x", F.col("doc_id").alias("y")).distinct()
    links = staged(_verified(own, first, star, words, share), "links")

    joined = components(links)
    tokens = (
        kept.select("doc_id", "n", "places").join(joined, F.col("doc_id") == F.col("id"), "left")
        .select("doc_id", "n", F.coalesce("root", "doc_id").alias("root"), F.inline("places"))
    )
    # What is left of a shingle without its center, where that is in several components.
    others = tokens.join(centers.select("token", "x"), "token").where(F.col("doc_id") != F.col("x")).drop("x")
    several = others.groupBy("token").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most")
    left = others.join(several.select("token"), "token", "left_semi")
    left = staged(left.join(kept.select("doc_id", "parity"), "doc_id"), "left")
    one = left.select("token", *[F.col(name).alias(f"{name}_x") for name in ("doc_id", "n", "i", "root", "parity")])
    rest = one.join(left, "token").where(
        (F.col("doc_id_x") < F.col("doc_id")) & (F.col("root_x") != F.col("root"))
        & _possible(F.col("n"), F.col("i"), F.col("n_x"), F.col("i_x"), share)
        & _close(F.col("n"), F.col("parity"), F.col("n_x"), F.col("parity_x"), share)
    ).select(F.col("doc_id_x").alias("x"), F.col("doc_id").alias("y")).distinct()
    links = links.union(staged(_verified(own, first, rest, words, share), "links"))

    roots = components(links)
    found = rows.select("doc_id", "n", "digest").join(classes, "digest", "left")
    found = found.join(roots, F.col("class") == F.col("id"), "left")
    return found.select(
        shown("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("root", "class", "doc_id").alias("component_id"),
    ).withColumn("component_id", shown("component_id"))


def similar_pairs(
    docs: DataFrame, words: int = 5, share: tuple[int, int] = (80, 100), doc_id: str = "doc_id", text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """The join itself: (``pairs``, ``members``). ``pairs`` has every link between different sets once,
    as the smallest ids ``x`` < ``y`` of the two classes of equal sets; ``members`` has ``class`` and
    ``doc_id`` of every row with shingles, so copies are not expanded into pairs.

    Shingles, null and empty texts, and ids are as in ``similar_documents``. Prefixes under three orders
    and parity bits are the filters here, too, but every pair that passes them is compared: the result
    has no shorter way than its own size. A prefix shingle that very many classes share is a join key
    that Spark splits where adaptive execution is on.
    """
    own = docs.select(known(doc_id).alias("doc_id"), F.col(text).alias("text"))
    loads = shared(docs.sparkSession, frequencies(own, words))
    rows = staged(mapped(own, _prefix_rows(words, share, loads), PREFIXES), "prefixes")
    classes = staged(rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("class")), "classes")
    first = rows.join(classes, (rows["digest"] == classes["digest"]) & (rows["doc_id"] == classes["class"]), "left_semi")
    first = staged(first.dropDuplicates(["digest"]), "first")
    kept = staged(_repeated(first, _prefix_total(rows)), "repeated")
    tokens = kept.select("doc_id", "n", "parity", F.inline("places"))
    one = tokens.select("token", *[F.col(name).alias(f"{name}_x") for name in ("doc_id", "n", "i", "parity")])
    pairs = one.join(tokens, "token").where(
        (F.col("doc_id_x") < F.col("doc_id")) & _possible(F.col("n"), F.col("i"), F.col("n_x"), F.col("i_x"), share)
        & _close(F.col("n"), F.col("parity"), F.col("n_x"), F.col("parity_x"), share)
    ).select(F.col("doc_id_x").alias("x"), F.col("doc_id").alias("y")).distinct()
    links = _verified(own, first, pairs, words, share).select(shown("x").alias("x"), shown("y").alias("y"))
    members = rows.join(classes, "digest").select(shown("class").alias("class"), shown("doc_id").alias("doc_id"))
    return links, members


PREFIXES = "doc_id long, n long, digest binary, a array<long>, b array<int>, c array<int>, parity array<long>"


def _prefix_rows(words: int, share: tuple[int, int], loads):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column("text"), words)
        columns: list[list] = [[], [], [], [], []]
        for own in sets:
            if len(own):
                size = len(own) - -(-len(own) * share[0] // share[1]) + 1
                found = [blake2b(own.tobytes(), digest_size=16).digest(), *prefixes(own, size, loads.value), parity_bits(own)]
            else:
                found = [None, None, None, None, None]
            for column, value in zip(columns, found):
                column.append(value)
        kinds = (pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))
        arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds)]
        counts = pa.array([len(own) for own in sets], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), counts, *arrays], names=["doc_id", "n", "digest", "a", "b", "c", "parity"])

    return run


def _prefix_total(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.size("a"))).first()[0] or 0


def _repeated(first: DataFrame, total: int) -> DataFrame:
    """``doc_id``, ``n``, ``parity`` and ``places`` (``i``, ``token``) of the documents' prefix shingles
    that others may have as well. Most shingles of a prefix are in no other one: two Bloom filters,
    seen once and seen again, keep those from being shuffled. A full filter keeps more, loses none."""
    bits = filter_bits(32 * total)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks()
        for batch in slices(batches):
            marks.add(id_positions(batch.column("a").flatten().to_numpy(), bits).ravel())
        yield marks.pieces()
        del marks
        release()

    twice = twice_filter(first.select("a").mapInArrow(marked, "segment long, once binary, twice binary"), bits)
    again = shared(first.sparkSession, twice)

    def places(batch: pa.RecordBatch) -> pa.RecordBatch:
        shingles = batch.column("a")
        flat = shingles.flatten().to_numpy()
        cuts = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(shingles), 0).to_numpy()))
        at = np.arange(len(flat)) - np.repeat(cuts[:-1], np.diff(cuts))
        stay = holds(again.value, id_positions(flat, bits))
        pairs = pa.StructArray.from_arrays([pa.array(at[stay].astype(np.int32)), pa.array(flat[stay])], names=["i", "token"])
        found = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(stay))[cuts].astype(np.int32)), pairs)
        kept = [batch.column("doc_id"), batch.column("n"), batch.column("parity"), found]
        return pa.RecordBatch.from_arrays(kept, names=["doc_id", "n", "parity", "places"])

    schema = "doc_id long, n long, parity array<long>, places array<struct<i int, token long>>"
    return mapped(first.select("doc_id", "n", "parity", "a"), places, schema)


def _possible(n: Column, i: Column, nx: Column, ix: Column, share: tuple[int, int]) -> Column:
    """Whether two sets can be similar if the shingle at places ``i`` and ``ix`` is the first that
    they share. Similar sets pass at the first they share, whatever comes before."""
    least = F.least(n - i, nx - ix)
    return least * (share[0] + share[1]) >= (n + nx) * share[0]


def _close(n: Column, bits: Column, nx: Column, bits_x: Column, share: tuple[int, int]) -> Column:
    """Whether parity bits leave it open that two sets are similar. They never rule out sets that are."""
    differ = sum((F.bit_count(bits[at].bitwiseXOR(bits_x[at])) for at in range(PARITY_WORDS)), F.lit(0))
    return differ * (share[0] + share[1]) <= (n + nx) * (share[1] - share[0])


def _verified(docs: DataFrame, first: DataFrame, pairs: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """The pairs (``x``, ``y``) that pass the other orders and parity bits and whose sets are similar."""
    def side(name: str) -> DataFrame:
        return first.select(F.col("doc_id").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("n", "b", "c", "parity")])

    passed = pairs.join(side("x"), "x").join(side("y"), "y").where(
        F.arrays_overlap("b_x", "b_y") & F.arrays_overlap("c_x", "c_y")
        & _close(F.col("n_x"), F.col("parity_x"), F.col("n_y"), F.col("parity_y"), share)
    )
    passed = staged(passed.select("x", "y").distinct(), "candidates")
    wanted = passed.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct()
    bits = min(1 << 28, max(1 << 20, 1 << (16 * passed.count()).bit_length()))
    held = shared(docs.sparkSession, id_filter(wanted, bits))

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(pa.array(holds(held.value, id_positions(batch.column("doc_id").to_numpy(), bits))))
        found = shingle_sets(batch.column("text"), words)
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array([blake2b(own.tobytes(), digest_size=16).digest() for own in found], pa.binary()),
            pa.array([own.view(np.int64) for own in found], pa.list_(pa.int64())),
        ], names=["doc_id", "digest", "shingles"])

    own = staged(
        mapped(docs, sets, "doc_id long, digest binary, shingles array<long>")
        .join(first.select("doc_id", "digest").join(wanted, "doc_id", "left_semi"), ["doc_id", "digest"], "left_semi").drop("digest"),
        "sets",
    )
    x, y = (own.select(F.col("doc_id").alias(name), F.col("shingles").alias(f"s{name}")) for name in ("x", "y"))
    both = passed.join(x, "x").join(y, "y").withColumn("common", F.size(F.array_intersect("sx", "sy")))
    union = F.size("sx") + F.size("sy") - F.col("common")
    return both.where(F.col("common") * share[1] >= union * share[0]).select("x", "y")
