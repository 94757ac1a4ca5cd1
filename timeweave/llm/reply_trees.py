"""Conversations from reply trees: best branches, formatted with marks that texts cannot forge.

Ancestors are found by self-joins that double their reach each round, so a path of ``n`` messages
takes about ``log2(n)`` rounds.  A leaf's branch is scored by the sum over its messages; the best
branches of a tree are kept (ties: the longer one, then the greater leaf id).  A kept branch is
walked back from its leaf along the stored reaches and formatted as one conversation.

A turn is ``<s>role newline text </s>``.  Inside roles and texts each backslash is doubled and a
backslash is put behind the first character of each control string, which is undone on reading.

Defined results: a null role or text is empty; a message whose parent is null or missing is a root;
messages on a cycle belong to no conversation; of messages with one id the least by role and text
counts.  Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeweave.llm.registry import query
from timeweave.llm.tables import cut_lineage, read

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<|", "[NL]")
BEGIN, END, LOSS_ROLE = "<s>", "</s>", "assistant"
MOST_ROUNDS = 48


def escape(value: Column) -> Column:
    doubled = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda x, c: F.replace(x, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}")), CONTROL, doubled)


def unescape(value: Column) -> Column:
    plain = reduce(lambda x, c: F.replace(x, F.lit(f"{c[0]}\\{c[1:]}"), F.lit(c)), CONTROL, value)
    return F.replace(plain, F.lit("\\\\"), F.lit("\\"))


def turn_text(role: Column, text: Column) -> Column:
    """One formatted turn; a line break in a role becomes ``[NL]``."""
    head = F.replace(escape(role), F.lit("\n"), F.lit("[NL]"))
    return F.concat(F.lit(BEGIN), head, F.lit("\n"), escape(text), F.lit(END))


def read_turns(formatted: Column) -> Column:
    """The (role, text) structs of a formatted conversation."""
    parts = F.filter(F.split(formatted, END, -1), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(
        unescape(F.replace(F.substring_index(F.substring(x, len(BEGIN) + 1, F.length(x)), "\n", 1), F.lit("[NL]"), F.lit("\n"))).alias("role"),
        unescape(F.substring(x, F.instr(x, "\n") + 1, F.length(x))).alias("text"),
    ))


def _reaches(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Every node's depth and branch score, and for each power of two the ancestors that far up."""
    state = cut_lineage(nodes.select("tree", "node", F.col("parent").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth")))
    levels: list[DataFrame] = []
    while len(levels) < MOST_ROUNDS:
        above = state.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("depth").alias("deeper"))
        joined = state.filter(F.col("up").isNotNull()).join(above, ["tree", "up"], "left")
        # A missing parent ends the path like a null one.
        levels.append(cut_lineage(joined.filter(F.col("deeper").isNotNull()).select("tree", "node", "up")))
        if levels[-1].isEmpty():
            levels.pop()
            state = state.withColumn("up", F.lit(None).cast("string"))
            break
        moved = joined.select("tree", "node", F.col("next").alias("up"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"), (F.col("depth") + F.coalesce("deeper", F.lit(0))).alias("depth"))
        state = cut_lineage(state.filter(F.col("up").isNull()).unionByName(moved))
    return state.filter(F.col("up").isNull()).select("tree", "node", "total", "depth"), levels


def chosen_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, branch, depth, role, text) of the messages on the best ``branches`` paths of each tree.

    ``messages`` has tree, node and parent ids, role, text and a score.  Ids are compared as text.
    """
    key = lambda name: F.col(name).cast("string").alias(name)
    nodes = cut_lineage(
        messages.select(F.coalesce(F.col("tree").cast("string"), F.lit("~")).alias("tree"), key("node"), key("parent"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
        .filter(F.col("node").isNotNull())
        .groupBy("tree", "node").agg(F.min(F.struct("role", "text", "parent", "score")).alias("m"))
        .select("tree", "node", "m.*")
    )
    measured, levels = _reaches(nodes)
    inner = nodes.select("tree", F.col("parent").alias("node")).distinct()
    best = Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("depth"), F.desc("node"))
    path = (
        measured.join(inner, ["tree", "node"], "left_anti")
        .withColumn("branch", F.row_number().over(best)).filter(F.col("branch") <= branches)
        .select("tree", "branch", "node")
    )
    for level in reversed(levels):
        path = cut_lineage(path.unionByName(path.join(level, ["tree", "node"]).select("tree", "branch", F.col("up").alias("node"))))
    return path.join(measured, ["tree", "node"]).join(nodes.select("tree", "node", "role", "text"), ["tree", "node"]).select("tree", "branch", "depth", "role", "text")


def conversations(paths: DataFrame) -> DataFrame:
    """One formatted conversation for each (tree, branch)."""
    turns = F.array_sort(F.collect_list(F.struct("depth", turn_text(F.col("role"), F.col("text")).alias("t"))))
    return paths.groupBy("tree", "branch").agg(F.array_join(F.transform(turns, lambda x: x["t"]), "").alias("formatted"))


def with_loss(df: DataFrame, formatted: str = "formatted") -> DataFrame:
    """Adds the turns read back and the text under the loss mask: every assistant text, in order."""
    turns = df.withColumn("turns", read_turns(F.col(formatted)))
    loss = F.filter("turns", lambda x: x["role"] == LOSS_ROLE)
    return turns.withColumn("loss_text", F.array_join(F.transform(loss, lambda x: x["text"]), ""))


ESCAPED = "replace(replace(replace(replace(replace(replace(replace({x}, '\\', '\\\\'), '<s>', '<\\s>'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]'), '<|', '<\\|'), '[NL]', '[\\NL]')"
SQL = f"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(8 + length(replace({ESCAPED.format(x='role')}, chr(10), '[NL]')) + length({ESCAPED.format(x='text')}))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""


@query("op5_reply_trees", SQL)
def op5_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a tree of one branch: each turn replies to the one before it."""
    probe = F.lit("</s>[INST] ok [/INST]")
    given = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), probe.alias("text"))
    rows = given.unionByName(added)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    messages = rows.withColumn("node", F.row_number().over(order)).select(
        F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.length("text").alias("score"))
    done = with_loss(conversations(chosen_paths(messages)))
    digest = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return done.select(
        F.when(F.col("tree") != "~", F.col("tree")).cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
