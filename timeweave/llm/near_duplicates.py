"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Words are lower-cased; a text is the set of its runs of ``SHINGLE`` words (a shorter text is one run).

1. Texts with equal sets are one class; only one text of each class goes on.
2. A signature has ``TREES`` trees of labels.  The matched prefix of a tree starts at ``DEEPEST``
   labels and is shortened until two texts at the threshold meet in some tree with the target
   recall.  Each tree is a sorted trie: rows sorted by node and label meet the texts below the same
   prefix.  A node's texts are walked breadth first over pairs whose whole signatures agree well
   below the threshold (``LOOSE``); only links that connect something new are written.
3. Connected texts form a candidate group.  All pairs of a group are verified on the exact sets, in
   tiles of ``TILE_ROWS`` x ``TILE_ROWS`` texts, so a group never has to fit into a task.  Links are
   counted; of the pairs, only enough to connect are written.
4. Verified links give the final groups.

Nodes beyond ``NODE_ROWS`` texts are walked in tiles as well.  Nothing is capped.

Defined results: a text that is null or has no word is alone; a null id is never linked; links are
counted between different sets, so copies share the count of their class; ids are taken to be
unique (rows that repeat an id count as one document with any of its texts).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.llm.components import components
from timeweave.llm.filters import IdFilter
from timeweave.llm.registry import query
from timeweave.llm.runs import runs
from timeweave.llm.tables import cut_lineage, read, spread
from timeweave.llm.words import mix, shingle_sets, slices

SHINGLE = 5
THRESHOLD = 0.8
TREES = 24
DEEPEST = 12
RECALL = 0.999
LOOSE = 0.6
NODE_ROWS = 32_768
TILE_ROWS = 256


def prefix_length(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest matched prefix that still finds a pair at the threshold with the target recall."""
    for depth in range(DEEPEST, 1, -1):
        if 1 - (1 - threshold ** depth) ** TREES >= recall:
            return depth
    return 1


def minhashes(shingles: np.ndarray, masks: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least value of every hash function over a set; the set is read in bounded pieces."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(masks), 0xFFFFFFFF, np.uint32)
    for a in range(0, len(short), 8192):
        part = short[a:a + 8192]
        np.minimum(out, ((part[None] ^ masks[:, None]) * factors[:, None]).min(axis=1), out=out)
    return out


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n, d1, d2, labels, sketch): set size, set digest, labels of all trees, one byte a label."""
    hashes = TREES * prefix_length()
    values = mix(np.arange(1, hashes + 1, dtype=np.uint64))
    masks, factors = (values >> np.uint64(32)).astype(np.uint32), values.astype(np.uint32) | np.uint32(1)

    def sign(batches):
        for batch in slices(batches):
            n, d1, d2, labels, sketch = [], [], [], [], []
            for own in shingle_sets(batch.column("text"), SHINGLE):
                low = minhashes(own, masks, factors)
                n.append(len(own))
                d1.append(own.sum(dtype=np.uint64).astype(np.int64) if len(own) else 0)
                d2.append(mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64) if len(own) else 0)
                labels.append(low.tobytes())
                sketch.append(low.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(labels, pa.binary()), pa.array(sketch, pa.binary())],
                names=["doc_id", "n", "d1", "d2", "labels", "sketch"])

    return docs.select("doc_id", F.lower(text).alias("text")).mapInArrow(sign, "doc_id long, n long, d1 long, d2 long, labels binary, sketch binary")


def tiles(df: DataFrame, key: str, size: Column, block_rows: int) -> DataFrame:
    """Adds the row's ``block`` and, for each tile (i, j) of its key that it belongs to, one row."""
    blocks = F.ceil(size / block_rows).cast("int")
    df = df.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    return df.withColumn("__o", other).withColumns({"i": F.least("block", "__o"), "j": F.greatest("block", "__o")}).drop("__o").repartition(
        spread(df), key, "i", "j").sortWithinPartitions(key, "i", "j", "rep")


def walk(sketches: np.ndarray, ids: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links that connect the rows of one node as all its loosely similar pairs do."""
    links, open_ = [], np.arange(len(ids))
    while len(open_) > 1:
        queue, open_ = [open_[0]], open_[1:]
        while queue and len(open_):
            row = queue.pop()
            near = (sketches[open_] == sketches[row]).mean(axis=1) >= least
            links += [(ids[row], ids[x]) for x in open_[near]]
            queue += open_[near].tolist()
            open_ = open_[~near]
    return links


def candidate_links(reps: DataFrame) -> DataFrame:
    """(a, b) links between texts that share a node, enough to connect all loosely similar ones."""
    width = 4 * prefix_length()
    prefixes = [F.xxhash64(F.lit(t), F.substring("labels", 1 + t * width, width)) for t in range(TREES)]
    nodes = reps.select("rep", F.explode(F.array(*prefixes)).alias("node"))
    shared = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
    met = nodes.join(shared, "node").join(reps.select("rep", "sketch"), "rep")
    least = LOOSE + (1 - LOOSE) / 256  # labels agree by chance in one of 256 bytes

    def link(batches):
        for table, at in runs(batches, ["node", "i", "j"]):
            ids = table.column("rep").to_numpy()
            sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
            sizes = np.diff(at)
            pairs = at[:-1][sizes == 2]
            close = pairs[(sketches[pairs] == sketches[pairs + 1]).mean(axis=1) >= least]
            links = list(zip(ids[close], ids[close + 1]))
            for a, b in zip(at[:-1][sizes > 2], at[1:][sizes > 2]):
                links += walk(sketches[a:b], ids[a:b], least)
            if links:
                a, b = np.array(links, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = tiles(met, "node", F.col("size"), NODE_ROWS).select("node", "i", "j", "rep", "sketch")
    return dealt.mapInArrow(link, "a long, b long")


def verified(texts: DataFrame) -> DataFrame:
    """(a, b, links) of (rep, group, size, text): counts with b null, and links enough to connect."""
    def verify(batches):
        for table, at in runs(batches, ["group", "i", "j"]):
            for a, b in zip(at[:-1], at[1:]):
                if b - a < 2:
                    continue
                part = table.slice(a, b - a)
                sets = list(shingle_sets(part.column("text"), SHINGLE))
                if not all(map(len, sets)):  # only where a repeated id also has a text without words
                    part = part.filter(pa.array([len(x) > 0 for x in sets]))
                    sets = [x for x in sets if len(x)]
                    if len(sets) < 2:
                        continue
                ids, block = part.column("rep").to_numpy(), part.column("block").to_numpy()
                within = part.column("i")[0].as_py() == part.column("j")[0].as_py()
                sizes = np.array([len(x) for x in sets])
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                names, flat = np.unique(np.concatenate(sets), return_inverse=True)
                linked = np.zeros((len(ids), len(ids)), bool)
                marked = np.zeros(len(names), np.int32)
                for x in range(len(ids) - 1):
                    marked[flat[offsets[x]:offsets[x + 1]]] = 1
                    common = np.add.reduceat(marked[flat[offsets[x + 1]:]], offsets[x + 1:-1] - offsets[x + 1])
                    linked[x, x + 1:] = common >= THRESHOLD * (sizes[x] + sizes[x + 1:] - common) - 1e-9
                    marked[flat[offsets[x]:offsets[x + 1]]] = 0
                linked &= ids[:, None] != ids[None]
                if not within:
                    linked &= block[:, None] != block[None]
                linked |= linked.T
                counts = linked.sum(axis=1)
                some = np.flatnonzero(counts)
                a_out, b_out, n_out = ids[some].tolist(), [None] * len(some), counts[some].tolist()
                open_ = np.ones(len(ids), bool)
                for start in some.tolist():
                    if not open_[start]:
                        continue
                    open_[start], queue = False, [start]
                    while queue:
                        x = queue.pop()
                        fresh = np.flatnonzero(linked[x] & open_)
                        open_[fresh] = False
                        queue += fresh.tolist()
                        a_out += [int(ids[x])] * len(fresh)
                        b_out += ids[fresh].tolist()
                        n_out += [0] * len(fresh)
                if a_out:
                    yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64()), pa.array(n_out, pa.int64())], names=["a", "b", "links"])

    dealt = tiles(texts, "group", F.col("size"), TILE_ROWS).select("group", "i", "j", "block", "rep", "text")
    return dealt.mapInArrow(verify, "a long, b long, links long")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: its group (least id), its class of equal sets, and its class's links."""
    docs = docs.select("doc_id", F.col(text).alias("text"))
    signed = cut_lineage(signatures(docs))
    classes = cut_lineage(
        signed.filter((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("n", "d1", "d2")
        .agg(F.min("doc_id").alias("rep"), F.first("labels").alias("labels"), F.first("sketch").alias("sketch")))
    loose = cut_lineage(components(candidate_links(classes)))
    groups = loose.join(loose.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component")
    # Only texts that have a candidate partner are shuffled.
    asked = IdFilter(loose, "id").rows(docs, "doc_id", inside=True)
    texts = asked.select(F.col("doc_id").alias("rep"), F.lower("text").alias("text")).join(
        groups.select(F.col("id").alias("rep"), F.col("component").alias("group"), "size"), "rep")
    checked = cut_lineage(verified(texts))
    counts = checked.filter(F.col("b").isNull()).groupBy("a").agg(F.sum("links").alias("n_links"))
    final = components(checked.filter(F.col("b").isNotNull()))
    linked = final.join(counts, final["id"] == counts["a"]).select(F.col("id").alias("rep"), "component", "n_links")
    named = classes.select("n", "d1", "d2", "rep").join(linked, "rep", "left")
    return signed.select("doc_id", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left").select(
        "doc_id",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("copy_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"))


SQL = r"""
WITH RECURSIVE split AS (
    SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_sort(list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])) END AS s
    FROM split
), copies AS (
    SELECT doc_id, s, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS copy_id FROM sets
), flat AS (
    SELECT copy_id, len(s) AS n, unnest(s) AS g FROM copies WHERE doc_id = copy_id
), links AS (
    SELECT a.copy_id AS a, b.copy_id AS b FROM flat a JOIN flat b ON a.g = b.g AND a.copy_id <> b.copy_id
    GROUP BY a.copy_id, b.copy_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))
), reach AS (
    SELECT a AS id, a AS c FROM links UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.id
), groups AS (SELECT id, min(c) AS class_id FROM reach GROUP BY id),
counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, coalesce(class_id, copy_id) AS class_id, copy_id, coalesce(n_links, 0) AS n_links
FROM copies LEFT JOIN groups ON id = copy_id LEFT JOIN counts ON a = copy_id
"""


@query("op1_near_duplicates", SQL)
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of near copies and its number of links."""
    return near_duplicates(read(spark, sf_dir, "documents"))
