"""Exact top-k by inner product with M-trees, searched best first.

Vectors become integers.  With ``R`` the greatest length of all vectors, a vector gets one more
component so that all have length ``R``, and a query a zero there; then the squared distance is
``|q|^2 + R^2 - 2 q.x``, so the nearest in the metric are the greatest in inner product.

The tree's top level is a set of at most ``MOST_PIVOTS`` routing vectors, chosen farthest-first from
a sample of at most ``SAMPLE_ROWS`` rows.  Every row goes to its nearest one; a crowded routing
vector is dealt out by a hash of the id to shards of about ``SHARD_ROWS`` rows.  A query asks the
shards whose covering ball can hold something better than its k-th best in the sample.  In a shard
an M-tree of paged nodes (routing vectors, covering radii, distances to the parent) is searched best
first; stored parent distances rule out entries before their distance is computed.  Queries meet a
shard in blocks of ``QUERY_ROWS``.  Scores are exact integers; bounds have slack for rounding.

Defined results: rows without an id, and vectors that are null or hold null or non-finite components
take no part; shorter vectors count as filled with zeros; components must stay below 2**24 after
scaling (greater ones are cut to that); ties go to the smaller id; a row with the query's id is its own.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeweave.llm.registry import query
from timeweave.llm.tables import cut_lineage, read

SAMPLE_ROWS = 4_096
MOST_PIVOTS = 1_024
SHARD_ROWS = 4_096
QUERY_ROWS = 4_096
PAGE = 64
LARGEST = 1 << 24


def matrix(column, width: int) -> np.ndarray:
    """Rows of a list column as doubles, filled with zeros up to ``width``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """One more component, so that every row has squared length ``longest``."""
    return np.hstack([x, np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))[:, None]])


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``x`` to all rows of ``y``."""
    square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(square, 0))


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows, each the farthest from those before; equal rows are taken once."""
    chosen, nearest = [0], apart(x, x[:1])[:, 0]
    while len(chosen) < n and nearest.max() > 1e-6:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, apart(x, x[chosen[-1:]])[:, 0])
    return np.array(chosen)


@dataclass
class Node:
    """A page: rows of a leaf, or children with their routing vectors, radii and parent distances."""

    rows: np.ndarray  # of a leaf: its rows; else the routing row of each child
    parent_distance: np.ndarray
    radius: np.ndarray | None = None
    children: list["Node"] = field(default_factory=list)


def grow(x: np.ndarray, rows: np.ndarray, routing: int) -> Node:
    """The M-tree of ``rows`` under the routing row ``routing``."""
    to_parent = apart(x[rows], x[routing:routing + 1])[:, 0]
    if len(rows) <= PAGE:
        return Node(rows, to_parent)
    pivots = rows[farthest_first(x[rows], min(PAGE, -(-len(rows) // PAGE) + 1))]
    of = apart(x[rows], x[pivots]).argmin(axis=1)
    groups = [rows[of == i] for i in range(len(pivots))]
    if max(map(len, groups)) > len(rows) // 2:  # many equal vectors: pages of a fixed size
        groups = [part for group in groups for part in np.array_split(group, -(-len(group) // (PAGE * PAGE // 2)))] if len(groups) > 1 else np.array_split(rows, min(PAGE, -(-len(rows) // PAGE)))
    groups = [group for group in groups if len(group)]
    heads = np.array([group[apart(x[group], x[group].mean(axis=0)[None])[:, 0].argmin()] for group in groups])
    children = [grow(x, group, head) for group, head in zip(groups, heads)]
    radius = np.array([apart(x[group], x[head:head + 1])[:, 0].max() for group, head in zip(groups, heads)])
    return Node(heads, apart(x[heads], x[routing:routing + 1])[:, 0], radius, children)


def search(root: Node, routing: int, plain: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, k: int, floor: float, longest: float) -> list[tuple[int, int]]:
    """The best ``k`` (score, id) of one query whose score is at least ``floor``."""
    base = q @ q + longest
    reach = lambda score: np.sqrt(max(base - 2 * score, 0.0)) * (1 + 1e-9) + 1e-6
    best: list[tuple[float, int]] = []  # least first, by (score, -id)
    limit = reach(floor)
    counter = 0
    waiting = [(0.0, counter, root, float(np.sqrt(max(base - 2 * (plain[routing] @ q), 0))))]
    while waiting:
        bound, _, node, to_routing = heapq.heappop(waiting)
        if bound > limit:
            break
        slack = limit if node.radius is None else limit + node.radius
        near = np.flatnonzero(np.abs(to_routing - node.parent_distance) <= slack + 1e-6)
        if not len(near):
            continue
        rows = node.rows[near]
        score = plain[rows] @ q
        if node.radius is None:
            for value, vec in zip(score.tolist(), ids[rows].tolist()):
                if vec != own and value >= floor:
                    entry = (value, -vec)
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
            if len(best) == k:
                floor = max(floor, best[0][0])
                limit = reach(floor)
            continue
        distance = np.sqrt(np.maximum(base - 2 * score, 0))
        lower = np.maximum(distance - node.radius[near], 0)
        for i in np.flatnonzero(lower <= limit).tolist():
            counter += 1
            heapq.heappush(waiting, (float(lower[i]), counter, node.children[near[i]], float(distance[i])))
    return [(int(value), -vec) for value, vec in best]


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of (vec_id, v) rows for (vec_id, v) queries; ``v`` holds integers."""
    spark = vectors.sparkSession
    vectors = cut_lineage(vectors.select("vec_id", "v"))
    facts = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("longest")).first()
    shape = "query_id long, vec_id long, score long"
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, longest = max(facts["width"], 1), float(facts["longest"])
    share = min(1.0, 0.5 * SAMPLE_ROWS / facts["n"]) if facts["n"] > SAMPLE_ROWS else 1.0
    taken = vectors.filter(F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(1 << 20)) < int(share * (1 << 20))).limit(SAMPLE_ROWS).toArrow()
    sample, sample_ids = matrix(taken.column("v"), width), taken.column("vec_id").to_numpy()
    high = lifted(sample, longest) if len(sample) else np.zeros((1, width + 1))
    pivots = high[farthest_first(high, min(MOST_PIVOTS, -(-facts["n"] // (SHARD_ROWS // 2))))]
    shared = spark.sparkContext.broadcast((sample, sample_ids, pivots))

    def place(batches):
        pivots = shared.value[2]
        for batch in batches:
            distance = apart(lifted(matrix(batch.column("v"), width), longest), pivots)
            of = distance.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of.astype(np.int32)), pa.array(distance[np.arange(len(of)), of])], names=["vec_id", "v", "pivot", "distance"])

    placed = cut_lineage(vectors.mapInArrow(place, "vec_id long, v array<long>, pivot int, distance double"))
    balls = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")).collect()  # at most MOST_PIVOTS
    radius, salts = np.full(len(pivots), -np.inf), np.zeros(len(pivots), int)
    for ball in balls:
        radius[ball["pivot"]], salts[ball["pivot"]] = ball["radius"], -(-ball["n"] // SHARD_ROWS)
    n_blocks = max(1, -(-queries.count() // QUERY_ROWS))

    def ask(batches):
        sample, sample_ids, pivots = shared.value
        for batch in batches:
            q, own = matrix(batch.column("v"), width), batch.column("vec_id").to_numpy()
            floor = np.full(len(q), -np.inf)
            if len(sample) > k:
                score = q @ sample.T
                score[own[:, None] == sample_ids[None]] = -np.inf
                floor = np.partition(score, -k, axis=1)[:, -k]
            base = (q * q).sum(axis=1) + longest
            distance = apart(np.hstack([q, np.zeros((len(q), 1))]), pivots)
            limit = np.sqrt(np.maximum(base - 2 * floor, 0)) * (1 + 1e-9) + 1e-6
            row, pivot = np.nonzero(distance - radius[None] - 1e-6 <= limit[:, None])
            copies = salts[pivot]
            salt = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
            row, pivot = np.repeat(row, copies), np.repeat(pivot, copies)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(row)), batch.column("v").take(pa.array(row)), pa.array(floor[row]), pa.array(pivot.astype(np.int32)), pa.array(salt.astype(np.int32))], names=["query_id", "q", "floor", "pivot", "salt"])

    block = lambda name: F.pmod(F.xxhash64(name, F.lit(5)), F.lit(n_blocks)).cast("int").alias("block")
    asked = queries.select("vec_id", "v").mapInArrow(ask, "query_id long, q array<long>, floor double, pivot int, salt int").select("*", block("query_id"))
    salt_of = F.get(F.lit(salts.tolist()), F.col("pivot"))
    shards = placed.select("vec_id", "v", "pivot", F.pmod(F.xxhash64("vec_id"), salt_of).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))

    def visit(shard: pa.Table, asking: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if len(shard) and len(asking):
            plain, ids = matrix(shard.column("v"), width), shard.column("vec_id").to_numpy()
            x = lifted(plain, longest)
            root = grow(x, np.arange(len(x)), 0)
            for q, own, floor in zip(matrix(asking.column("q"), width), asking.column("query_id").to_pylist(), asking.column("floor").to_pylist()):
                found += [(own, vec, score) for score, vec in search(root, 0, plain, ids, q, own, k, floor, longest)]
        cols = list(zip(*found)) or [(), (), ()]
        return pa.table({name: pa.array(col, pa.int64()) for name, col in zip(("query_id", "vec_id", "score"), cols)})

    keys = ("pivot", "salt", "block")
    hits = shards.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(visit, shape)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integers(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part: each component times 256, rounded down."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(vector, lambda x: F.least(F.greatest(F.floor(x.cast("double") * 256), F.lit(-LARGEST)), F.lit(LARGEST)))
    return df.filter(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & fine).select("vec_id", scaled.alias("v"))


SQL = """
WITH v AS (
    SELECT vec_id, [floor(x::DOUBLE * 256) FOR x IN embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 5
"""


@query("op2_metric_search", SQL)
def op2_metric_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five greatest inner products of every fiftieth vector with all others."""
    vectors = integers(read(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)
