"""Chat formatting from reply trees, with DataFrame functions only.

Messages form trees: each has an id, its parent's id (null at a root), a role, a text and a score.
Self-joins that double the covered distance enumerate every root-to-leaf path; branches are ranked
by score inside their tree; each chosen path becomes one conversation string with loss spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ragmill.llm.common import materialize, table

# Control strings of common chat templates.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>")
_TAILS = r"(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>)"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """Put one more backslash after the first character of each control string, so none is left."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAILS, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)\\" + _TAILS, r"$1$2$3")


def escape_role(role: Column) -> Column:
    """A role stands on one line: backslashes and line ends are spelled out, then control strings."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def reply_paths(nodes: DataFrame) -> DataFrame:
    """(tree_id, leaf_id, node_id, depth) of every node on every root-to-leaf path, depth 0 at the leaf.

    ``nodes`` has tree_id, node_id, parent_id. Each self-join doubles the distance of the ancestor
    pointers, so n rounds reach 2**n levels. A parent that does not exist makes its child a root. Nodes
    on a cycle reach no root and are left out with all below them. Nodes with a null id are left out; of
    repeated ids the one with the smallest parent remains.
    """
    ids = nodes.select("tree_id", "node_id", "parent_id").where("node_id IS NOT NULL")
    ids = ids.groupBy("tree_id", "node_id").agg(F.min("parent_id").alias("parent_id"))
    known = ids.select("tree_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("known"))
    ids = ids.join(known, ["tree_id", "parent_id"], "left")
    ups = [materialize(ids.select("tree_id", "node_id", F.expr("IF(known, parent_id, NULL)").alias("up")), "parents")]
    left = ups[0].where("up IS NOT NULL").count()
    while left:
        up = ups[-1]
        then = up.select("tree_id", F.col("node_id").alias("up"), F.col("up").alias("up2"))
        up = materialize(up.where("up IS NOT NULL").join(then, ["tree_id", "up"]).where("up2 IS NOT NULL").select("tree_id", "node_id", F.col("up2").alias("up")), "ancestors")
        before, left = left, up.count()
        if before == left:  # levels are without gaps, so all that is left circles
            break
        if left:
            ups.append(up)
    parents = ups[0].select("tree_id", F.col("up").alias("node_id")).where("node_id IS NOT NULL").distinct()
    on = ups[0].join(parents, ["tree_id", "node_id"], "left_anti")
    if left:
        on = on.join(up.select("tree_id", "node_id"), ["tree_id", "node_id"], "left_anti")
    on = on.select("tree_id", F.col("node_id").alias("leaf_id"), "node_id", F.lit(0).cast("long").alias("depth"))
    for n, up in enumerate(ups):
        moved = on.join(up, ["tree_id", "node_id"]).where("up IS NOT NULL")
        on = materialize(on.unionByName(moved.select("tree_id", "leaf_id", F.col("up").alias("node_id"), (F.col("depth") + (1 << n)).alias("depth"))), "paths")
    return on


def format_conversations(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """The best ``branches`` paths of each tree (None: all), each as one conversation.

    ``nodes``: tree_id, node_id, parent_id, role, text, score; further columns are ignored. Null role or
    text counts as empty, null score as 0. A path's score is the mean of its nodes' scores; ties go to the
    smaller leaf id. Returns tree_id, branch (1 is the best), leaf_id, score, formatted, and loss_spans:
    (start, length) in code points of each assistant text as it stands, escaped, in ``formatted``.
    An empty table gives an empty table.
    """
    nodes = nodes.select("tree_id", "node_id", "parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    one = nodes.groupBy("tree_id", "node_id").agg(F.min(F.struct("role", "text", "score")).alias("m")).select("tree_id", "node_id", "m.*")
    full = reply_paths(nodes).join(one, ["tree_id", "node_id"])
    paths = full.groupBy("tree_id", "leaf_id").agg(
        F.avg("score").alias("score"),
        F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("at"), "role", "text"))).alias("turns"),
    )
    rank = F.row_number().over(W.partitionBy("tree_id").orderBy(F.desc("score"), "leaf_id"))
    paths = paths.withColumn("branch", rank)
    if branches is not None:
        paths = paths.where(F.col("branch") <= branches)
    marked = F.transform("turns", lambda t: F.struct((t.role == "assistant").alias("learn"), F.concat(F.lit(OPEN), escape_role(t.role), F.lit("\n")).alias("head"), escape(t.text).alias("body")))
    paths = paths.withColumn("marked", marked)
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    spans = F.aggregate(
        "marked",
        F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")),
        lambda a, t: F.struct(
            (a.at + F.length(t.head) + F.length(t.body) + len(CLOSE)).cast("long").alias("at"),
            F.when(t.learn, F.concat(a.spans, F.array(F.struct((a.at + F.length(t.head)).cast("long").alias("start"), F.length(t.body).cast("long").alias("length"))))).otherwise(a.spans).alias("spans"),
        ),
        lambda a: a.spans,
    )
    text = F.array_join(F.transform("marked", lambda t: F.concat(t.head, t.body, F.lit(CLOSE))), "")
    return paths.select("tree_id", "branch", "leaf_id", "score", text.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role,text>> that ``formatted`` was made from."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")
    parts = F.transform(parts, lambda p: F.substr(p, F.lit(1), F.length(p) - len(CLOSE)))
    head = lambda p: F.substring_index(p, "\n", 1)
    return F.transform(parts, lambda p: F.struct(unescape_role(head(p)).alias("role"), unescape(F.substr(p, F.length(head(p)) + 2)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s.start + 1).cast("int"), s.length.cast("int")))), "")


def as_tree(conversations: DataFrame) -> DataFrame:
    """Linear conversations as trees of one branch: each row replies to the row before, by turn (null turns
    first, repeated turns by role and text)."""
    rows = conversations.withColumn("node_id", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")))
    parent = F.when(F.col("node_id") > 1, F.col("node_id") - 1)
    return rows.select(F.col("conv_id").alias("tree_id"), "node_id", parent.alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT -1L AS conv_id, x.turn, x.role, '</s>[INST] ok [/INST]' AS text FROM (SELECT explode(array(named_struct('turn', 0L, 'role', 'user'), named_struct('turn', 1L, 'role', 'assistant'))) AS x)")
    done = format_conversations(as_tree(rows.unionByName(probe)), branches=1)
    done = done.withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", read_loss(F.col("formatted"), F.col("loss_spans")))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return done.select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>)', '\1\2\\\3', 'g') AS body,
    regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>)', '\1\2\\\3', 'g') AS head
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(head) + 1 + length(body) + 11) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
