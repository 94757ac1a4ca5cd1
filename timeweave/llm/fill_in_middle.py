"""Fill-in-middle: a text is cut at two places and written with its middle last.

A unit is a maximal run of A-Z and a-z, or one other code point.  Two hashes of the id choose how many
units the prefix and the middle end after; two more choose the form.

The texts of a slice of an Arrow batch are one row of bytes, split into fixed blocks.  A Fenwick tree
over the blocks holds their numbers of units and code points.  To find the place behind the first k
units of a text, a binary-lifting descent goes down to the block where the next unit begins, with the
units and code points before that block; only this block is then looked at byte by byte.  All cuts of a
slice descend together, so a cut costs the logarithm of the number of blocks plus one block.

Defined results: null texts are empty; a null id hashes like an empty one; empty texts, texts that hold
one of the marks, and the share ``1 - rate`` of the others stay plain, with null cut places; repeated rows are
treated alike; columns with the names of the added ones are replaced, all other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeweave.llm.registry import query
from timeweave.llm.tables import read
from timeweave.llm.words import raw, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLOCK_BYTES = 256
LETTER = np.zeros(256, bool)
LETTER[ord("A"):ord("Z") + 1] = LETTER[ord("a"):ord("z") + 1] = True
LEAD = np.ones(256, bool)
LEAD[0x80:0xC0] = False
ADDED = {"fim_text": "string", "fim_form": "string", "n_units": "bigint", "prefix_chars": "bigint", "middle_chars": "bigint"}


class BlockTree:
    """A Fenwick tree whose nodes hold the units and the code points of the blocks they span."""

    def __init__(self, counts: np.ndarray):
        self.n = len(counts)
        upto = np.vstack([np.zeros((1, 2), np.int64), np.cumsum(counts, axis=0)])
        at = np.arange(1, self.n + 1)
        self.nodes = np.zeros((self.n + 1, 2), np.int64)
        self.nodes[1:] = upto[at] - upto[at - (at & -at)]

    def descend(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The blocks where the units with these numbers (from 1) begin, and the counts before each block."""
        block, before = np.zeros(len(unit), np.int64), np.zeros((len(unit), 2), np.int64)
        step = 1 << max(self.n.bit_length() - 1, 0)
        while step:
            further = np.minimum(block + step, self.n)
            sums = before + self.nodes[further]
            go = (block + step <= self.n) & (sums[:, 0] < unit)
            block[go], before[go] = further[go], sums[go]
            step >>= 1
        return block, before


class Units:
    """The units of many texts that lie one behind the other in ``data``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        letter, lead = LETTER[data], LEAD[data]
        goes_on = np.zeros(len(data), bool)
        goes_on[1:] = letter[1:] & letter[:-1]
        inner = offsets[:-1][offsets[:-1] < len(data)]
        goes_on[inner] = False
        begins = lead & ~goes_on
        self.offsets = offsets
        n_blocks = -(-len(data) // BLOCK_BYTES)
        blocks = np.zeros((2, n_blocks * BLOCK_BYTES), bool)
        blocks[0, :len(data)], blocks[1, :len(data)] = begins, lead
        self.begins, self.lead = blocks.reshape(2, n_blocks, BLOCK_BYTES)
        self.tree = BlockTree(blocks.reshape(2, n_blocks, BLOCK_BYTES).sum(axis=2, dtype=np.int64).T)
        self.n_units, self.n_points = self._by_text(begins), self._by_text(lead)
        self.units_before = np.cumsum(self.n_units) - self.n_units
        self.points_before = np.cumsum(self.n_points) - self.n_points

    def _by_text(self, marks: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.offsets) - 1, np.int64)
        filled = np.flatnonzero(np.diff(self.offsets))
        if len(filled):
            out[filled] = np.add.reduceat(marks, self.offsets[filled], dtype=np.int64)
        return out

    def cut(self, text: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte place in ``data`` and code points of the text before the cut behind so many units."""
        place, points = self.offsets[text + 1].copy(), self.n_points[text].copy()
        inside = np.flatnonzero(units < self.n_units[text])  # all others end with the text
        own, wanted = text[inside], self.units_before[text[inside]] + units[inside] + 1
        block, before = self.tree.descend(wanted)
        within = np.cumsum(self.begins[block], axis=1, dtype=np.int16) == (wanted - before[:, 0])[:, None]
        local = within.argmax(axis=1)
        place[inside] = block * BLOCK_BYTES + local
        ahead = self.lead[block] & (np.arange(BLOCK_BYTES) < local[:, None])
        points[inside] = before[:, 1] + ahead.sum(axis=1) - self.points_before[own]
        return place, points


def arranged(batch: pa.RecordBatch) -> list[pa.Array]:
    """The added columns of one slice."""
    data, offsets = raw(batch.column("text"))
    units = Units(data, offsets)
    form = batch.column("form").to_numpy(zero_copy_only=False)
    moved = np.flatnonzero(form != "plain")
    ends = [batch.column(name).to_numpy()[moved] % (units.n_units[moved] + 1) for name in ("h1", "h2")]
    first, first_points = units.cut(moved, np.minimum(*ends))
    second, second_points = units.cut(moved, np.maximum(*ends))
    whole = data.tobytes()
    out = [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    for row, a, b in zip(moved.tolist(), (first - offsets[moved]).tolist(), (second - offsets[moved]).tolist()):
        prefix, middle, suffix = out[row][:a], out[row][a:b], out[row][b:]
        out[row] = b"".join([marks[0], prefix, marks[1], suffix, marks[2], middle] if form[row] == "psm" else [marks[1], suffix, marks[0], prefix, marks[2], middle])
    plain = np.ones(len(form), bool)
    plain[moved] = False
    chars = np.zeros((2, len(form)), np.int64)
    chars[0, moved], chars[1, moved] = first_points, second_points - first_points
    return [pa.array(out, pa.binary()).cast(pa.string()), batch.column("form"), pa.array(units.n_units), pa.array(chars[0], mask=plain), pa.array(chars[1], mask=plain)]


def numbers(doc_id: Column, seed: int, n: int) -> list[Column]:
    """``n`` numbers below 2**32 from one digest of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def fill_in_middle(df: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 1, rate: int = 90, suffix_first: int = 20, with_text: bool = False) -> DataFrame:
    """All rows with ``fim_text``, ``fim_form`` (plain, psm or spm), ``n_units`` and the lengths of prefix and middle.

    ``rate`` and ``suffix_first`` are percentages.  The text column is left out unless ``with_text``.
    """
    keep = [f for f in df.schema.fields if f.name not in ADDED and (with_text or f.name != text)]
    body = F.coalesce(F.col(text), F.lit(""))
    h1, h2, h3, h4 = numbers(F.col(doc_id), seed, 4)
    marked = F.contains(body, F.lit(PREFIX)) | F.contains(body, F.lit(SUFFIX)) | F.contains(body, F.lit(MIDDLE))
    form = F.when((body == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    # The kept columns travel as one, so that none of them can clash with the helpers.
    packed = df.select(F.struct(*[F.col(f"`{f.name}`") for f in keep]).alias("kept"), body.alias("text"), h1.alias("h1"), h2.alias("h2"), form.alias("form"))
    schema = T.StructType([packed.schema["kept"], *T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in ADDED.items())).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("kept"), *arranged(batch)], names=schema.names)

    done = packed.mapInArrow(run, schema)
    return done.select(*[F.col("kept")[f.name].alias(f.name) for f in keep], *ADDED)


def restore(df: DataFrame, name: str = "restored_text") -> DataFrame:
    """All columns and the text rebuilt from ``fim_text`` and ``fim_form`` alone."""
    whole = F.col("fim_text")
    head, middle = F.substring_index(whole, MIDDLE, 1), F.substring_index(whole, MIDDLE, -1)
    psm, spm = F.col("fim_form") == "psm", F.col("fim_form") == "spm"
    mark = F.when(psm, SUFFIX).otherwise(PREFIX)
    at = F.locate  # the marks stand in no text, so each is found once, where it was put
    cut = F.when(psm, at(SUFFIX, head)).otherwise(at(PREFIX, head))
    one = F.substring(head, F.lit(len(PREFIX) + 1), cut - F.lit(len(PREFIX) + 1))
    two = F.substring(head, cut + F.length(mark), F.length(head))
    return df.withColumn(name, F.when(psm, F.concat(one, middle, two)).when(spm, F.concat(two, middle, one)).otherwise(whole))


SQL = """
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
    SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
           ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
    FROM t
), c AS (
    SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM u
), p AS (
    SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(coalesce(prefix, '')) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(coalesce(middle, '')) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
              WHEN 'psm' THEN '<P>' || coalesce(prefix, '') || '<S>' || coalesce(suffix, '') || '<M>' || coalesce(middle, '')
              ELSE '<S>' || coalesce(suffix, '') || '<P>' || coalesce(prefix, '') || '<M>' || coalesce(middle, '') END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


@query("op13_fill_in_middle", SQL)
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text cut and rearranged, and the text restored from that."""
    done = restore(fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text")))
    return done.select("doc_id", F.col("n_units").alias("n"), F.col("fim_form").alias("form"), "prefix_chars", "middle_chars",
                       F.sha2("fim_text", 256).alias("output_sha256"), F.sha2("restored_text", 256).alias("restored_sha256"))
