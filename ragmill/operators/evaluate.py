"""Relevance and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ragmill.functions.text import holds, normalize
from ragmill.schemas import KS, METRICS


def judge(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """``hits`` (qid, rank, text, ...) with rel, matching_gold and n_gold: the first of the question's gold passages
    (qid, gold: array) that stands in the text. A question without gold has n_gold 0."""
    j = hits.join(gold.select("qid", "gold"), "qid", "left")
    first = F.get(F.filter("gold", lambda g: holds(j["text"], g)), F.lit(0))
    j = j.withColumn("matching_gold", first)
    return j.withColumn("rel", F.col("matching_gold").isNotNull().cast("int")).withColumn("n_gold", F.coalesce(F.size("gold"), F.lit(0))).drop("gold")


def metrics_at(judged: DataFrame, keys: list[str], ks=KS, questions: DataFrame | None = None) -> DataFrame:
    """(keys, k, mrr, map, ndcg, precision, recall, f1_score) for each cut-off. Every key of ``questions`` has its rows: a
    question without hits scores 0 and counts in means. Without ``questions`` only what has hits is there.

    ``judged``: keys, rank, rel, n_gold. Hits are ranked once; cut-offs come from one join with the few k and one
    aggregation. Precision is over what was retrieved, the mean of MAP over what was relevant there; recall and NDCG
    can exceed 1 where several chunks hold one gold passage. Without hits or gold all are 0."""
    running = F.sum("rel").over(W.partitionBy(*keys).orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = judged.select(*keys, "rank", "rel", "n_gold").withColumn("cum", running)
    rows = rows.withColumn("k", F.explode(F.filter(F.array(*map(F.lit, ks)), lambda k: k >= F.col("rank"))))
    a = rows.groupBy(*keys, "k").agg(
        F.count("*").alias("n"),
        F.sum("rel").alias("hit"),
        F.max("n_gold").alias("n_gold"),
        F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("first"),
        F.avg(F.when(F.col("rel") > 0, F.col("cum") / F.col("rank"))).alias("ap"),
        F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"),
    )
    top = F.least("n_gold", "n").cast("int")
    ideal = F.when(top > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(top, F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1)))
    zero = lambda c: F.coalesce(F.when(F.col("n_gold") > 0, c), F.lit(0.0))
    a = a.select(
        *keys,
        "k",
        zero(1 / F.col("first")).alias("mrr"),
        zero(F.col("ap")).alias("map"),
        zero(F.col("dcg") / ideal).alias("ndcg"),
        zero(F.col("hit") / F.col("n")).alias("precision"),
        zero(F.try_divide(F.col("hit"), F.col("n_gold"))).alias("recall"),
    )
    if questions is not None:
        every = questions.select(*keys).distinct().withColumn("k", F.explode(F.array(*map(F.lit, ks))))
        a = every.join(a, [*keys, "k"], "left").fillna(0.0, list(METRICS[:-1]))
    both = F.col("precision") + F.col("recall")
    return a.withColumn("f1_score", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / F.when(both > 0, both)).otherwise(0.0))


def wide(metrics: DataFrame, keys: list[str], ks=KS) -> DataFrame:
    """One row per key: metric@k columns."""
    names = ("mrr", "map", "ndcg", "precision", "recall", "f1_score")
    return metrics.groupBy(*keys).agg(*(F.max(F.when(F.col("k") == k, F.col(m))).alias(f"{m}@{k}") for m in names for k in ks))


def partial_multihop(hits: DataFrame, gold: DataFrame, top: int = 10) -> DataFrame:
    """(qid, found, missed) of questions with several gold passages of which some, not all, stand in the top hits."""
    g = gold.where(F.size("gold") > 1).select("qid", F.posexplode("gold").alias("gpos", "g"))
    near = g.join(hits.where(F.col("rank") <= top).select("qid", "rank", "text"), "qid", "left")
    at = near.groupBy("qid", "gpos").agg(F.min(F.when(F.contains(normalize(F.col("text")), normalize(F.col("g"))), F.col("rank"))).alias("at"))
    out = at.groupBy("qid").agg(F.count_if(F.col("at").isNotNull()).alias("found"), F.count_if(F.col("at").isNull()).alias("missed"))
    return out.where("found > 0 AND missed > 0")


def fragmented(hits: DataFrame, gold: DataFrame, top: int = 5) -> DataFrame:
    """(qid, gpos) of the first gold passage that only the joined top hits hold."""
    joined = hits.where(F.col("rank") <= top).groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list(F.struct("rank", "text")))["text"], " ").alias("all"), F.collect_list("text").alias("each"))
    g = gold.select("qid", F.posexplode("gold").alias("gpos", "g")).join(joined, "qid")
    lost = g.where(F.contains(normalize(F.col("all")), normalize(F.col("g"))) & ~F.exists("each", lambda t: F.contains(normalize(t), normalize(F.col("g")))))
    return lost.groupBy("qid").agg(F.min("gpos").alias("gpos"))


def near_misses(hits: DataFrame, gold: DataFrame, top: int = 3, least: float = 0.8) -> DataFrame:
    """(qid, gpos, rank, share) of gold passages of which a hit holds a stretch above ``least`` of their length.

    The stretch is difflib's: in hits of 200 characters or more it does not begin at characters that are common there."""

    @F.pandas_udf("double")
    def share(text, g):
        import pandas as pd
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, b, a).find_longest_match(0, len(b), 0, len(a)).size / max(1, len(b)) for a, b in zip(text, g, strict=True)], dtype="float64")

    g = gold.select("qid", F.posexplode("gold").alias("gpos", "g")).join(hits.where(F.col("rank") <= top), "qid")
    return g.withColumn("share", share(normalize(F.col("text")), normalize(F.col("g")))).where(F.col("share") > least).select("qid", "gpos", "rank", "share")


def lost_in_the_middle(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose recall is 0 at 5 and above 0 at 20."""
    w = wide(metrics, keys)
    return w.where("`recall@20` > 0 AND `recall@5` = 0").select(*keys, F.col("recall@20").alias("recall_20"))


def quota(rows: DataFrame, group: list[str], order: list[str], most: int = 2) -> DataFrame:
    """The first ``most`` rows of each group."""
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("nth") <= most)
