"""Approximate nearest neighbours by largest inner product, over learned partitions."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.llm.batches import known, mapped, shared, shown, slices
from quire.llm.partitions import Router, learn
from quire.llm.vectors import matrix, real, width
from quire.session import staged

#: Vectors that the router is fitted on at most, and neighbours of each in their graph.
SAMPLE, DEGREE = 16_384, 16

#: Partitions at most; fewer distinct vectors than ``FEW`` are one partition, which is searched whole.
PARTS, FEW = 1024, 256

#: Vectors, and queries, that meet in one group at most, about; larger partitions are cut.
BLOCK = 4096

#: Queries whose products are worked out together.
TOGETHER = 256


def partitions_for(count: int) -> int:
    """A quarter of the root of the number of vectors: about four roots of vectors in each."""
    return 1 if count < FEW else min(PARTS, int(count ** 0.5 / 4))


def fit(classes: DataFrame, entries: int, recall: float = 0.96, sample: int = SAMPLE) -> Router | None:
    """The router for distinct vectors (``x``, doubles as bytes); None for a single partition.

    It is fitted on at most ``sample`` of them, those with the smallest hashes: their exact neighbour
    graph is made by tasks, the driver splits it and trains on it."""
    parts = partitions_for(classes.count())
    if parts < 2:
        return None
    chosen = classes.select("x", F.xxhash64("x").alias("h")).orderBy("h", "x").limit(sample).collect()
    rows = np.frombuffer(b"".join(row["x"] for row in chosen), "<f8").reshape(-1, entries)
    spark, degree = classes.sparkSession, min(DEGREE, len(rows) - 1)
    held = shared(spark, rows)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.column(0).to_numpy()
            scores = held.value[at] @ held.value.T
            scores[np.arange(len(at)), at] = -np.inf
            found = np.argpartition(-scores, degree - 1, axis=1)[:, :degree].astype("<i4")
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array([own.tobytes() for own in found], pa.binary())], names=["id", "near"],
            )

    graph = np.empty((len(rows), degree), np.int64)
    for row in spark.range(0, len(rows), 1, max(1, len(rows) // 1024)).mapInArrow(near, "id long, near binary").collect():
        graph[row["id"]] = np.frombuffer(row["near"], "<i4")
    return learn(rows, graph, parts, recall)


def packed(vectors: DataFrame, vec_id: str, vector: str, entries: int) -> DataFrame:
    """``id`` and vector (``x``, doubles as bytes) of the rows that take part."""
    some = F.exists(F.col(vector), lambda c: c != 0)
    rows = vectors.where(real(F.col(vector)) & (F.size(vector) == entries) & some)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        numbers = matrix(batch.column("x"), entries) + 0.0  # no negative zeros
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([own.tobytes() for own in numbers.astype("<f8")], pa.binary())], names=["id", "x"],
        )

    return mapped(rows.select(known(vec_id).alias("id"), F.col(vector).alias("x")), run, "id long, x binary", 4096)


def nearest(
    vectors: DataFrame, queries: Column, count: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
    recall: float = 0.96, sample: int = SAMPLE, router: Router | None = None,
) -> DataFrame:
    """For each row of ``vectors`` that ``queries`` names, its ``count`` nearest others that were found:
    ``query_id``, ``rank`` from 1, ``vec_id`` and ``score``, the inner product in double precision.
    Nearest is the largest product, ties go to the smaller id; all others are returned if there are
    fewer than ``count``.

    Every distinct vector is stored in the partition that the router finds most probable; a query
    visits as many of its most probable partitions as hold the ``recall`` that was asked for on held
    out vectors, and is compared with all that is in them. On vectors with structure that is few of
    them, on directions at random most. Equal vectors are one: it carries its ``count`` + 1 smallest
    ids, of which no ranking can use more, so copies cost nothing. Partitions with many vectors or
    visitors are cut into blocks, which meet block by block.

    Left out, as queries too, are vectors that are null, empty or zero, hold nulls or what is not
    finite, or have another width than most. Null ids are candidates with the smallest id, never
    queries. Rows that share an id are rows of their own: each is searched, without itself alone.
    ``router`` is one from ``fit``, for tables that are searched again.
    """
    entries = width(vectors, vector)
    spark = vectors.sparkSession
    if not entries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = packed(vectors, vec_id, vector, entries)
    asked = packed(vectors.where(queries & F.col(vec_id).isNotNull()), vec_id, vector, entries)

    first = rows.withColumn("at", F.row_number().over(W.partitionBy("x").orderBy("id"))).where(F.col("at") <= count + 1)
    classes = staged(first.groupBy("x").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    router = router or fit(classes, entries, recall, sample)
    held = shared(spark, router)

    def home(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = batch.column("x")
        parts = np.zeros(len(x), np.int32) if held.value is None else held.value.homes(_doubles(x, entries))
        return pa.RecordBatch.from_arrays([pa.array(parts), x, batch.column("ids")], names=["part", "x", "ids"])

    def visit(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = batch.column("x")
        lists = [np.zeros(1, np.int32)] * len(x) if held.value is None else held.value.visits(_doubles(x, entries))
        return pa.RecordBatch.from_arrays([x, pa.array(lists, pa.list_(pa.int32()))], names=["x", "parts"])

    stored = staged(mapped(classes, home, "part int, x binary, ids array<long>", 4096), "stored")
    visits = staged(mapped(asked.select("x").distinct(), visit, "x binary, parts array<int>", 4096), "visits")
    visits = visits.select("x", F.explode("parts").alias("part"))
    # One row for each partition: into how many blocks its vectors and its visitors are cut.
    blocks = (
        stored.groupBy("part").count().select("part", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
        .join(visits.groupBy("part").count().select("part", F.ceil(F.col("count") / BLOCK).cast("int").alias("turns")), "part")
    )
    blocks = F.broadcast(staged(blocks, "blocks"))  # at most PARTS rows

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in its own block, once for each block of the other side."""
        return df.join(blocks, "part").withColumn(own, F.pmod(F.xxhash64("x"), F.col(own)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        )

    place = ["part", "blocks", "turns"]
    left = dealt(visits, "turns", "blocks").select(*place, "x").groupBy(*place)
    right = dealt(stored, "blocks", "turns").select(*place, "x", "ids").groupBy(*place)

    def meet(ask: pa.Table, table: pa.Table) -> pa.Table:
        keys: list[bytes] = []
        hits: list[list[dict]] = []
        if ask.num_rows and table.num_rows:
            own_x, all_x = ask.column("x").to_pylist(), table.column("x").to_pylist()
            ids = table.column("ids").to_pylist()
            own, stock = (np.frombuffer(b"".join(x), "<f8").reshape(-1, entries) for x in (own_x, all_x))
            for at in range(0, len(own), TOGETHER):
                for x, found in zip(own_x[at:at + TOGETHER], _top(own[at:at + TOGETHER], stock, count + 1)):
                    top = sorted(((-score, i, all_x[row] == x) for row, score in found for i in ids[row]))[:count + 1]
                    keys.append(_key(x))
                    hits.append([{"score": -score, "id": i, "same": same} for score, i, same in top])
        kind = pa.list_(pa.struct([("score", pa.float64()), ("id", pa.int64()), ("same", pa.bool_())]))
        return pa.table({"key": pa.array(keys, pa.binary()), "hits": pa.array(hits, kind)})

    hits = left.cogroup(right).applyInArrow(meet, "key binary, hits array<struct<score:double,id:long,same:boolean>>")
    hits = hits.select("key", F.inline("hits")).withColumn(
        "at", F.row_number().over(W.partitionBy("key").orderBy(F.desc("score"), "id"))
    ).where(F.col("at") <= count + 1)
    best = hits.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "score", "id", "same"))).alias("hits"))

    def keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([_key(x) for x in batch.column("x").to_pylist()], pa.binary())], names=["query", "key"],
        )

    found = mapped(asked, keyed, "query long, key binary", 4096).join(best, "key")
    # The row itself, once, where it is among them.
    itself = F.array_position(F.transform("hits", lambda h: h["same"] & (h["id"] == F.col("query"))), True).cast("int")
    others = F.filter("hits", lambda h: h["at"] != itself)
    return found.select("query", F.posexplode(F.slice(others, 1, count)).alias("rank", "hit")).select(
        F.col("query").alias("query_id"), (F.col("rank") + 1).cast("int").alias("rank"),
        shown("hit.id").alias("vec_id"), F.col("hit.score").alias("score"),
    )


def _doubles(x: pa.Array, entries: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.to_pylist()), "<f8").reshape(-1, entries)


def _key(x: bytes) -> bytes:
    return blake2b(x, digest_size=16).digest()


def _top(own: np.ndarray, stock: np.ndarray, count: int) -> list[list[tuple[int, float]]]:
    """For each query the rows of ``stock`` that may be among its ``count`` nearest, with scores.

    A matrix product's last bits depend on where a row stands, so what it puts within rounding of the
    last place counts as well, and scores are summed anew, in one order for all."""
    products = own @ stock.T
    if len(stock) > count:
        last = np.partition(products, len(stock) - count, axis=1)[:, len(stock) - count]
        slack = 1e-12 * np.linalg.norm(own, axis=1) * np.linalg.norm(stock, axis=1).max()
        among = products >= (last - slack)[:, None]
    else:
        among = np.ones_like(products, bool)
    query, row = np.nonzero(among)
    scores = (own[query] * stock[row]).sum(axis=1).tolist()
    cuts = np.searchsorted(query, np.arange(len(own) + 1)).tolist()
    pairs = list(zip(row.tolist(), scores))
    return [pairs[a:b] for a, b in zip(cuts, cuts[1:])]
