"""Mixing sources to target weights: token weights of (source, language, topic) cells are raked to the three
marginals by iterative proportional fitting, then documents are drawn with calibrated probabilities.
DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ragmill.llm.common import free_name, materialize, table

DIMS = ("source", "lang", "topic")
#: Exponent of each dimension's token shares in its target: below 1, large parts give to small ones.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Passes over the three dimensions in one plan; plans follow until marginals are met, at most so many.
PASSES, MOST_PLANS = 4, 50
#: Largest relative miss of a marginal that counts as met.
CLOSE = 1e-9
KEEP = 0.6
SEED = "mix"
SYMBOLS = r"[|&#*=<>{}\[\]()/_~^%$@+!]"


def topic_of(text: Column) -> Column:
    """The register of a text, from its make-up alone: figures, markup, lists, and prose by length."""
    n, lines = F.length(text), F.regexp_count(text, F.lit("\n")) + 1
    return (
        F.when(F.regexp_count(text, F.lit("[0-9]")) * 20 >= n, "figures")
        .when(F.regexp_count(text, F.lit(SYMBOLS)) * 50 >= n, "markup")
        .when((lines >= 4) & (n < lines * 60), "list")
        .when(n < 600, "note")
        .when(n < 6000, "article")
        .otherwise("long read")
    )


def tokens_of(text: Column) -> Column:
    """Words: one more than the blanks and line ends; an empty or null text has none."""
    gaps = F.length(text) - F.length(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")))
    return F.when(F.length(text) > 0, gaps + 1).otherwise(0).cast("long")


def with_cells(docs: DataFrame, to: str, topic: Column | None = None) -> DataFrame:
    """``docs`` with a struct ``to`` of source, lang, topic and tokens; a null is a part of its own, named ''. An empty
    or null text has no topic but ''."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    kind = topic_of(F.nullif("text", F.lit(""))) if topic is None else topic
    return docs.withColumn(to, F.struct(part(F.col("source")).alias("source"), part(F.col("lang")).alias("lang"), F.when(F.length("text") > 0, part(kind)).otherwise("").alias("topic"), tokens_of(F.col("text")).alias("tokens")))


def tempered_targets(cells: DataFrame, temper=None) -> dict[str, DataFrame]:
    """Target share of each value of each dimension, from its token share to a power."""
    temper, out = temper or TEMPER, {}
    for d in DIMS:
        t = cells.groupBy(d).agg(F.sum("tokens").alias("t")).where("t > 0").select(d, F.pow(F.col("t").cast("double"), temper[d]).alias("t"))
        out[d] = t.select(d, F.col("t").alias("target"))
    return out


def with_targets(cells: DataFrame, targets: dict[str, DataFrame] | None) -> DataFrame:
    """``cells`` with t_source, t_lang, t_topic: targets of their values, 0 without one (tempered ones, if none are given),
    scaled to sum to 1 over the values that cells have."""
    cells = cells.where("tokens > 0").coalesce(1)
    for d in DIMS:
        all_ = F.sum("tokens").over(W.partitionBy(d))
        if targets is None:
            target = F.pow(all_.cast("double"), TEMPER[d])
        else:
            cells, target = cells.join(targets[d].select(d, F.col("target").cast("double").alias("given")), d, "left"), F.coalesce("given", F.lit(0.0))
        cells = cells.withColumns({f"t_{d}": target, f"s_{d}": F.col("tokens") / all_}).drop("given")
    cells = materialize(cells, "cell_targets")
    # each value once: a cell counts by its share of its value
    sums = cells.agg(*(F.sum(F.col(f"t_{d}") * F.col(f"s_{d}")).alias(d) for d in DIMS)).first()
    return cells.select(*DIMS, "tokens", *((F.col(f"t_{d}") / F.lit(sums[d] or 1.0)).alias(f"t_{d}") for d in DIMS))


def raking_pass(cells: DataFrame) -> DataFrame:
    """One pass of iterative proportional fitting: weights are scaled along each dimension to its targets."""
    for d in DIMS:
        now = F.sum("weight").over(W.partitionBy(d))
        cells = cells.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"t_{d}") / now).otherwise(0.0))
    return cells


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None, passes: int = PASSES, most: int = MOST_PLANS, close: float = CLOSE) -> tuple[DataFrame, float]:
    """(source, lang, topic, tokens, weight) and the largest relative miss of a marginal.

    Cells are a small table (values of the dimensions, not documents), and a window puts those of the commonest language into
    one task anyway: they are one partition, so that passes need no exchange. ``passes`` passes are one plan of window
    sums, written; plans follow until the miss is ``close``, or does not fall any more (targets that no weights meet, as where
    a source has no document of a language its target needs), or ``most`` are done. A value without a target has weight 0."""
    cells, miss = with_targets(cells, targets).withColumn("weight", F.col("tokens").cast("double")), float("inf")
    for _ in range(most):
        cells = cells.coalesce(1)
        for _ in range(passes):
            cells = raking_pass(cells)
        off = lambda d: F.abs(F.sum("weight").over(W.partitionBy(d)) / F.nullif(f"t_{d}", F.lit(0.0)) - 1)
        cells = materialize(cells.withColumn("miss", F.greatest(*(F.coalesce(off(d), F.lit(0.0)) for d in DIMS[:-1]))), "raked")
        before, miss = miss, cells.agg(F.max("miss")).first()[0] or 0.0
        cells = cells.drop("miss")
        if miss <= close or miss > 0.999 * before:
            break
    return cells.select(*DIMS, "tokens", "weight"), miss


def calibrate(raked: DataFrame, keep: float = KEEP) -> DataFrame:
    """(source, lang, topic, prob): tokens times prob is in proportion to the weights and sums to the share ``keep``
    of all tokens; where that asks for more than there is, prob is 1 and the rest goes to the other cells. The scale is
    looked for until no further cell is full, so it is exact."""
    total, scale, full = raked.agg(F.sum("tokens")).first()[0] or 0, 0.0, -1
    rate = F.col("weight") / F.col("tokens")
    while True:
        is_full = rate * scale >= 1
        got = raked.agg(F.sum(F.when(is_full, F.col("tokens")).otherwise(0)), F.sum(F.when(is_full, 0.0).otherwise(F.col("weight")))).first()
        if not got[1] or got[0] == full:
            break
        full = got[0]
        scale = (keep * total - full) / got[1]
    return raked.select(*DIMS, F.least(F.lit(1.0), rate * scale).alias("prob"))


def unit(doc_id: Column, seed: str = SEED) -> Column:
    """A number from 0 to 1 that depends on the id alone; a null id counts as empty."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)


def mix(docs: DataFrame, keep: float = KEEP, targets: dict[str, DataFrame] | None = None, topic: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that are drawn, all columns as they were, and last a struct of source, lang, topic, tokens and
    prob. It is called mix, with as many underscores as make the name unused.

    Needs doc_id, text, source and lang; ``topic`` is any column of ``docs``, the register of the text by default. Nulls
    of source, language and topic are values of their own. Rows without words (null and empty texts) are never drawn;
    very long texts weigh by their words. Rows that repeat an id share their fate; an empty table gives an empty one."""
    to = free_name(docs, "mix")
    docs = with_cells(docs, to, topic)
    cells = materialize(docs.groupBy(*(F.col(f"{to}.{d}").alias(d) for d in DIMS)).agg(F.sum(f"{to}.tokens").alias("tokens")), "cells")
    raked, _ = rake(cells, targets)
    names = [free_name(docs, f"mix_{d}") for d in (*DIMS, "prob")]
    prob = materialize(calibrate(raked, keep).toDF(*names), "probabilities")
    on = [F.col(f"{to}.{d}") == F.col(n) for d, n in zip(DIMS, names[:-1], strict=True)]
    drawn = docs.join(prob, on).where((F.col(f"{to}.tokens") > 0) & (unit(F.col("doc_id")) < F.col(names[-1])))
    return drawn.withColumn(to, F.col(to).withField("prob", F.col(names[-1]))).drop(*names)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    got = mix(docs)
    m = got.columns[-1]
    return got.select("doc_id", f"{m}.source", f"{m}.lang", f"{m}.topic", f"{m}.tokens", F.round(f"{m}.prob", 6).alias("prob"))


#: Passes and cap rounds that SQL, which cannot stop by itself, unrolls: more than it takes; the rest change nothing.
SQL_PASSES, SQL_CAPS = 24, 12


def sample_sql(docs: str, keep: float = KEEP) -> str:
    """CTEs named d (documents with dimensions) and p (cells with prob), for DuckDB; ``docs`` is a table or CTE."""
    count = lambda what: f"length(text) - length(regexp_replace(text, '{what}', '', 'g'))"
    s = [
        f"""n AS (SELECT *, {count("[0-9]")} AS x_digits, {count(SYMBOLS)} AS x_symbols, {count(chr(92) + "n")} + 1 AS x_lines FROM {docs})""",
        """d AS (SELECT *, CASE WHEN length(text) > 0 THEN length(text) - length(replace(replace(text, ' ', ''), chr(10), '')) + 1 ELSE 0 END AS x_tokens,
  coalesce(source, '') AS x_source, coalesce(lang, '') AS x_lang,
  CASE WHEN coalesce(length(text), 0) = 0 THEN '' WHEN x_digits * 20 >= length(text) THEN 'figures' WHEN x_symbols * 50 >= length(text) THEN 'markup' WHEN x_lines >= 4 AND length(text) < x_lines * 60 THEN 'list'
    WHEN length(text) < 600 THEN 'note' WHEN length(text) < 6000 THEN 'article' ELSE 'long read' END AS x_topic FROM n)""",
        "c AS (SELECT x_source AS source, x_lang AS lang, x_topic AS topic, CAST(sum(x_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL HAVING sum(x_tokens) > 0)",
    ]
    for k in DIMS:
        s.append(f"t_{k} AS (SELECT {k}, pow(sum(tokens), {TEMPER[k]}) / sum(pow(sum(tokens), {TEMPER[k]})) OVER () AS target FROM c GROUP BY {k})")
    s.append("r_0 AS (SELECT *, tokens AS weight FROM c)")
    at = 0
    for _ in range(SQL_PASSES):
        for k in DIMS:
            s.append(f"r_{at + 1} AS MATERIALIZED (SELECT r.source, r.lang, r.topic, r.tokens, r.weight * t.target / sum(r.weight) OVER (PARTITION BY r.{k}) AS weight FROM r_{at} r JOIN t_{k} t USING ({k}))")
            at += 1
    s.append(f"k_0 AS (SELECT {keep} * sum(tokens) / sum(weight) AS scale FROM r_{at})")
    for n in range(1, SQL_CAPS):
        full = f"weight / tokens * (SELECT scale FROM k_{n - 1}) >= 1"
        s.append(f"k_{n} AS (SELECT coalesce(({keep} * sum(tokens) - coalesce(sum(tokens) FILTER ({full}), 0)) / sum(weight) FILTER (NOT ({full})), (SELECT scale FROM k_{n - 1})) AS scale FROM r_{at})")
    s.append(f"p AS (SELECT source AS x_source, lang AS x_lang, topic AS x_topic, least(1.0, weight / tokens * (SELECT scale FROM k_{SQL_CAPS - 1})) AS prob FROM r_{at})")
    return ",\n".join(s)


DRAWN_SQL = f"d JOIN p USING (x_source, x_lang, x_topic) WHERE x_tokens > 0 AND CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{SEED}'), 1, 13) AS BIGINT) / 4503599627370496.0 < prob"
OP6_SQL = f"WITH {sample_sql('documents')}\nSELECT doc_id, x_source AS source, x_lang AS lang, x_topic AS topic, CAST(x_tokens AS BIGINT) AS tokens, round(prob, 6) AS prob FROM {DRAWN_SQL}"
