"""Hard negatives of anchors, searched with bounds along spanning trees of anchors.

A row's score is its inner product with the anchor.  For an anchor ``a`` with tree parent ``p`` and a row
``x`` the scores differ by at most ``|a - p| * |x|``, so the score at the parent, plus or minus edge length
times the row's norm, bounds the score at the child.  Going down a tree only the rows whose bounds overlap
one of the anchor's windows are scored again; the others pass their widened bounds on.

Two searches are made: the best rows with the anchor's label (its positives, window from a floor
upwards), then the best rows with other labels within a window below each positive's score.

* Rows go once to the nearest of at most ``MOST_PIVOTS`` routing vectors and, where one is crowded, by a
  hash of a row number to shards of about ``SHARD_ROWS`` rows.
* Anchors form groups of about ``GROUP_ROWS`` around the same routing vectors, each with its minimum
  spanning tree.  A group visits the shards whose ball can reach a window of one of its anchors.
* A task streams sorted rows: one shard, then the groups that visit it, one after the other.  It holds one
  shard and one group.  A shard asked by more than ``LANE_ROWS`` anchors is sent to several tasks, each with
  its part of the groups; nothing else is sent twice.
* A sample of at most ``SAMPLE_ROWS`` rows gives routing vectors and floors (the k-th best of the sample
  within a window); it only saves work, every row is placed and reached.

Where bounds rule nothing out, the work is anchors times rows, as any exact search's.

Defined results: rows with a null id, label or vector, or a null or non-finite component take no part;
shorter vectors count as filled with zeros; ties go to the smaller id; "other" rows have another id;
repeated rows count as often as they occur, but equal anchors are searched once; scores are exact, those
beyond a long are cut to its range; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeweave.llm.metric_search import apart, farthest_first
from timeweave.llm.registry import query
from timeweave.llm.runs import runs
from timeweave.llm.tables import cut_lineage, read, spread

SAMPLE_ROWS = 4_096
MOST_PIVOTS = 1_024
SHARD_ROWS = 4_096
GROUP_ROWS = 512
LANE_ROWS = 65_536
LEAST, MOST = -(1 << 63), (1 << 63) - 1
WINDOWS = "array<struct<key:bigint,low:bigint,high:bigint>>"


def kind_of(longest: float) -> type:
    """Numbers in which inner products of vectors of this squared length are exact."""
    return np.float64 if longest < 2.0 ** 52 else np.int64 if longest < 2.0 ** 62 else object


def matrix(column: pa.ChunkedArray, width: int, kind: type) -> np.ndarray:
    """Rows of a list column, filled with zeros up to ``width``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width), kind)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def norms(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return np.sqrt((x * x).sum(axis=1))


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order they join the minimum spanning tree, the place of each one's parent there, edge lengths.

    The root is the row nearest the mean; its parent is -1.
    """
    x = x.astype(np.float64)
    root = int(apart(x, x.mean(axis=0)[None])[:, 0].argmin())
    order, parent, edge = [root], [-1], [0.0]
    nearest, of = apart(x, x[root:root + 1])[:, 0], np.zeros(len(x), int)
    nearest[root] = np.inf
    for place in range(1, len(x)):
        row = int(nearest.argmin())
        order.append(row)
        parent.append(int(of[row]))
        edge.append(float(norms(x[row:row + 1] - x[order[of[row]]])[0]))  # anew, as squares cancel
        distance = apart(x, x[row:row + 1])[:, 0]
        closer = (distance < nearest) & (nearest < np.inf)
        nearest[closer], of[closer] = distance[closer], place
        nearest[row] = np.inf
    return np.array(order), np.array(parent), np.array(edge)


def within(scores: np.ndarray, low: int, high: int) -> np.ndarray:
    return (scores >= low) & (scores <= high)


def suits(label: int, own: int, labels: np.ndarray, ids: np.ndarray, same: bool) -> np.ndarray:
    """The rows that may answer an anchor: other rows of its label, or rows of other labels."""
    return (labels == label) & (ids != own) if same else labels != label


class Shard:
    """Rows with their norms, searched by one group of anchors after the other."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        self.x, self.ids, self.labels, self.norms = x, ids, labels, norms(x)

    def visit(self, anchors: np.ndarray, own: list[int], label: list[int], parent: list[int], edge: list[float], windows: list[list[dict]], k: int, same: bool) -> Iterator[tuple[int, int, int, int]]:
        """(place of the anchor, window's key, id, score) of the best ``k`` rows of each window."""
        middle, slack = np.zeros((len(own), len(self.x))), np.zeros((len(own), len(self.x)))
        lengths = norms(anchors)
        for i, (a, up) in enumerate(zip(anchors, parent)):
            rounding = 1e-9 * lengths[i] * self.norms + 1e-6
            if up < 0:
                rows = np.arange(len(self.x))
            else:
                middle[i] = middle[up]
                slack[i] = slack[up] + edge[i] * (1 + 1e-9) * self.norms + rounding
                low, high = middle[i] - slack[i], middle[i] + slack[i]
                near = np.zeros(len(self.x), bool)
                for w in windows[i]:
                    near |= (high >= w["low"]) & (low <= w["high"])
                rows = np.flatnonzero(near & suits(label[i], own[i], self.labels, self.ids, same))
            if not len(rows):
                continue
            scores = self.x[rows] @ a
            middle[i, rows], slack[i, rows] = scores.astype(np.float64), rounding[rows]
            if up < 0:
                fit = np.flatnonzero(suits(label[i], own[i], self.labels, self.ids, same))
                rows, scores = rows[fit], scores[fit]
            for w in windows[i]:
                hit = np.flatnonzero(within(scores, w["low"], w["high"]))
                if len(hit) > k:
                    edge_score = np.partition(scores[hit], len(hit) - k)[len(hit) - k]
                    hit = hit[scores[hit] >= edge_score]
                best = sorted((-int(scores[h]), int(self.ids[rows[h]])) for h in hit)[:k]
                for score, row in best:
                    yield i, w["key"], row, min(max(-score, LEAST), MOST)


def prepared(df: DataFrame, label: Column, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, v) of the rows that take part; ``v`` is each component times 256, rounded down."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * 256))
    return df.filter(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & fine).select("vec_id", label.cast("long").alias("label"), scaled.alias("v")).filter(F.col("label").isNotNull())


class Search:
    """The rows placed in shards and the anchors in trees; asked once for positives, once for negatives."""

    def __init__(self, rows: DataFrame, anchors: DataFrame):
        self.spark = rows.sparkSession
        rows = cut_lineage(rows.select("vec_id", "label", "v"))
        length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
        facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max(length).alias("longest")).first()
        self.n = facts["n"]
        if not self.n:
            return
        width, kind = max(facts["width"], 1), kind_of(facts["longest"])
        share = min(1.0, 0.5 * SAMPLE_ROWS / self.n) if self.n > SAMPLE_ROWS else 1.0
        taken = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(1 << 20)) < int(share * (1 << 20))).limit(SAMPLE_ROWS).toArrow()
        sample = matrix(taken.column("v"), width, kind) if len(taken) else np.zeros((1, width), kind)
        ids, labels = taken.column("vec_id").to_numpy(), taken.column("label").to_numpy()
        plain = sample.astype(np.float64)
        pivots = plain[farthest_first(plain, min(MOST_PIVOTS, -(-self.n // (SHARD_ROWS // 2))))]
        self.width, self.kind = width, kind
        self.shared = self.spark.sparkContext.broadcast((sample[:len(taken)], ids, labels, pivots))
        self.placed = cut_lineage(self._nearest(rows).withColumn("row", F.monotonically_increasing_id()))
        self.radius, self.salts = np.full(len(pivots), -np.inf), np.ones(len(pivots), int)
        for ball in self.placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("r")).collect():  # at most MOST_PIVOTS
            self.radius[ball["pivot"]], self.salts[ball["pivot"]] = ball["r"], -(-ball["n"] // SHARD_ROWS)
        self.anchors = self._trees(anchors)

    def _nearest(self, rows: DataFrame) -> DataFrame:
        shared, width, kind = self.shared, self.width, self.kind

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots = shared.value[3]
            for batch in batches:
                x = matrix(batch.column("v"), width, kind).astype(np.float64)
                of = apart(x, pivots).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of.astype(np.int32)), pa.array(norms(x - pivots[of]) * (1 + 1e-9))], names=[*batch.schema.names, "pivot", "distance"])

        return rows.mapInArrow(place, "vec_id long, label long, v array<long>, pivot int, distance double")

    def _trees(self, anchors: DataFrame) -> DataFrame:
        """Anchors by group, in the order of the group's tree."""
        width, kind = self.width, self.kind
        anchors = cut_lineage(self._nearest(anchors.select("vec_id", "label", "v").distinct()).drop("distance"))
        sizes = {r["pivot"]: -(-r["count"] // GROUP_ROWS) for r in anchors.groupBy("pivot").count().collect()}  # at most MOST_PIVOTS
        salts = [sizes.get(i, 1) for i in range(len(self.radius))]
        salt = F.pmod(F.xxhash64("vec_id", "label", "v"), F.get(F.lit(salts), F.col("pivot")))
        grouped = anchors.select("vec_id", "label", "v", (F.col("pivot").cast("long") * (1 << 32) + salt).alias("grp"))
        grouped = grouped.repartition(spread(anchors), "grp").sortWithinPartitions("grp", "vec_id", "label")

        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, cuts in runs(batches, ["grp"]):
                for a, b in zip(cuts[:-1], cuts[1:]):
                    group = table.slice(a, b - a)
                    order, parent, edge = spanning_tree(matrix(group.column("v"), width, kind))
                    group = group.take(pa.array(order)).append_column("ord", pa.array(np.arange(len(order), dtype=np.int32)))
                    group = group.append_column("parent", pa.array(parent.astype(np.int32))).append_column("edge", pa.array(edge))
                    yield from group.combine_chunks().to_batches()

        return cut_lineage(grouped.mapInArrow(grow, "vec_id long, label long, v array<long>, grp long, ord int, parent int, edge double"))

    def best(self, windows: DataFrame, k: int, same: bool) -> DataFrame:
        """(grp, ord, key, rank, row_id, score): the best ``k`` rows of each window of each anchor.

        ``windows`` are the anchors with a column ``windows``.
        """
        shared, width, kind, radius = self.shared, self.width, self.kind, self.radius
        fields = ["vec_id", "label", "v", "grp", "ord", "parent", "edge"]
        schema = f"vec_id long, label long, v array<long>, grp long, ord int, parent int, edge double, windows {WINDOWS}"

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sample, ids, labels, pivots = shared.value
            for table, cuts in runs(batches, ["grp"]):
                for a, b in zip(cuts[:-1], cuts[1:]):
                    group = table.slice(a, b - a).combine_chunks()
                    v, own, label = matrix(group.column("v"), width, kind), group.column("vec_id").to_pylist(), group.column("label").to_pylist()
                    asked = group.column("windows").to_pylist()
                    scores = v @ sample.T
                    centre, reach = v.astype(np.float64) @ pivots.T, norms(v)[:, None] * radius[None]
                    slack = 1e-9 * norms(v)[:, None] * norms(pivots)[None] + 1e-6
                    reached = np.zeros(len(pivots), bool)
                    for i, windows in enumerate(asked):
                        fit = scores[i][suits(label[i], own[i], labels, ids, same)]
                        for w in windows:
                            inside = fit[within(fit, w["low"], w["high"])]
                            if len(inside) >= k:
                                w["low"] = max(w["low"], min(int(np.partition(inside, len(inside) - k)[len(inside) - k]), MOST))
                            reached |= (centre[i] + reach[i] + slack[i] >= w["low"]) & (centre[i] - reach[i] - slack[i] <= w["high"])
                    pivots_asked = pa.array([np.flatnonzero(reached).astype(np.int32)] * len(group), pa.list_(pa.int32()))
                    kept = group.select(fields).append_column("windows", pa.array(asked, group.schema.field("windows").type)).append_column("pivots", pivots_asked)
                    yield from kept.combine_chunks().to_batches()

        sorted_ = windows.select(*fields, "windows").repartition(spread(windows), "grp").sortWithinPartitions("grp", "ord")
        asked = cut_lineage(sorted_.mapInArrow(ask, f"{schema}, pivots array<int>"))
        loads = asked.select(F.explode("pivots").alias("pivot")).groupBy("pivot").count().collect()  # at most MOST_PIVOTS
        lanes = np.ones(len(radius), int)
        for load in loads:
            lanes[load["pivot"]] = -(-load["count"] // LANE_ROWS)
        of_pivot = lambda values: F.get(F.lit([int(v) for v in values]), F.col("pivot")).cast("int")
        asking = asked.withColumn("pivot", F.explode("pivots")).withColumn("lane", F.pmod(F.xxhash64("grp"), of_pivot(lanes)).cast("int")).withColumn(
                "salt", F.explode(F.sequence(F.lit(0), of_pivot(self.salts) - 1))).select("pivot", "salt", "lane", F.lit(1).alias("side"), *fields, "windows")
        visited = [int(load["pivot"]) for load in loads]
        rows = self.placed.filter(F.col("pivot").isin(visited)).withColumn("lane", F.explode(F.sequence(F.lit(0), of_pivot(lanes) - 1))).select(
            "pivot", F.pmod(F.xxhash64("row"), of_pivot(self.salts)).cast("int").alias("salt"), "lane", F.lit(0).alias("side"), "vec_id", "label", "v",
            F.lit(0).cast("long").alias("grp"), F.lit(0).alias("ord"), F.lit(0).alias("parent"), F.lit(0.0).alias("edge"), F.lit(None).cast(WINDOWS).alias("windows"))
        place = ["pivot", "salt", "lane"]
        # In a task: a shard (side 0), then the groups that visit it.
        streamed = rows.unionByName(asking).repartition(spread(windows), *place).sortWithinPartitions(*place, "side", "grp", "ord")

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, at = None, None
            for table, cuts in runs(batches, [*place, "side", "grp"]):
                sides = table.column("side").to_numpy()
                for a, b in zip(cuts[:-1], cuts[1:]):
                    part = table.slice(a, b - a).combine_chunks()
                    where = tuple(part.column(name)[0].as_py() for name in place)
                    x = matrix(part.column("v"), width, kind)
                    if not sides[a]:
                        shard, at = Shard(x, part.column("vec_id").to_numpy(), part.column("label").to_numpy()), where
                    elif at == where:
                        found = list(shard.visit(x, *(part.column(name).to_pylist() for name in ("vec_id", "label", "parent", "edge", "windows")), k, same))
                        place_of, key, row, score = zip(*found) if found else ((),) * 4
                        grp = np.full(len(found), part.column("grp")[0].as_py(), np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(grp), pa.array(place_of, pa.int32()), *(pa.array(c, pa.int64()) for c in (key, row, score))], names=["grp", "ord", "key", "row_id", "score"])

        hits = streamed.mapInArrow(visit, "grp long, ord int, key long, row_id long, score long")
        order = Window.partitionBy("grp", "ord", "key").orderBy(F.desc("score"), "row_id")
        return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` and ``anchors`` are (vec_id, label, v) with integer vectors; anchors are some of the rows.  A
    negative's score lies between ``low`` and ``high`` per cent of the positive's.
    """
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    search = Search(rows, anchors)
    if not search.n:
        return rows.sparkSession.createDataFrame([], shape)
    window = lambda key, least, most: F.struct(key.cast("long").alias("key"), least.cast("long").alias("low"), most.cast("long").alias("high"))
    every = search.anchors.withColumn("windows", F.array(window(F.lit(0), F.lit(LEAST), F.lit(MOST))))
    found = cut_lineage(search.best(every, positives, same=True).select("grp", "ord", F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # Wide enough numbers, so that no product overflows; a window depends on the score alone.
    score = F.col("positive_score").cast("decimal(38,0)")
    bounds = window(F.col("positive_score"), F.ceil(score * low / 100), F.floor(score * high / 100))
    windows = found.groupBy("grp", "ord").agg(F.collect_set(bounds).alias("windows"))
    windows = windows.withColumn("windows", F.filter("windows", lambda w: w["low"] <= w["high"])).filter(F.size("windows") > 0)
    # The whole group travels, as the others of a tree carry the bounds.
    held = search.anchors.join(windows.select("grp").distinct(), "grp", "left_semi").join(windows, ["grp", "ord"], "left").withColumn(
        "windows", F.coalesce("windows", F.array().cast(WINDOWS)))
    hits = search.best(held, negatives, same=False).select("grp", "ord", F.col("key").alias("positive_score"), "rank", F.col("row_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = search.anchors.select("grp", "ord", F.col("vec_id").alias("anchor_id"))
    return found.join(hits, ["grp", "ord", "positive_score"]).join(named, ["grp", "ord"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(x::DOUBLE * 256) FOR x IN embedding] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
    FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id,
       positive_score, score AS negative_score
FROM positives JOIN (SELECT * FROM scored WHERE NOT same) USING (anchor_id)
WHERE 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""


@query("op12_hard_negatives", SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three negatives for each of the five positives of every fiftieth vector; a seventh of the labels is shifted."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = prepared(read(spark, sf_dir, "embeddings"), label)
    return hard_negatives(rows, rows.filter(F.col("vec_id") % 50 == 0))
