"""Result tables: enrichment, summaries, pivots and long forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ragmill.functions.text import index_name, numeric, params, size_bin, strategy
from ragmill.operators.ranks import percentiles

BASE = ("mrr", "map", "ndcg_at_k", "precision_at_k", "recall_at_k", "f1_score_at_k")


def summary(rows: DataFrame, metrics=BASE) -> DataFrame:
    return rows.groupBy("experiment").agg(*(F.avg(m).alias(m) for m in metrics))


def mean_std(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and sample deviation, which one row does not have."""
    return rows.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def pivot_mean(rows: DataFrame, index: str, columns: str, values: list[str], value: str) -> DataFrame:
    """One column for each of the given ``values``, so that no pass is needed to find them."""
    return rows.groupBy(index).pivot(columns, values).agg(F.avg(value))


def means_by(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Means by keys; rows with a null key are left out."""
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    return rows.where(known).groupBy(*keys).agg(*(F.avg(m).alias(m) for m in metrics))


def having_positive(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return means_by(rows, keys, [value]).where(F.col(value) > 0)


def pr_curve(rows: DataFrame, key: str = "strategy", ks=(1, 3, 5, 10, 20)) -> DataFrame:
    """(key, k, recall, precision), averaged."""
    a = rows.groupBy(key).agg(*(F.avg(f"{m}@{k}").alias(f"{m}_{k}") for m in ("recall", "precision") for k in ks))
    points = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"recall_{k}").alias("recall"), F.col(f"precision_{k}").alias("precision")) for k in ks)))
    return a.select(key, points.alias("p")).select(key, "p.*")


def melt(rows: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return rows.unpivot(ids, columns, name, value)


def melt_recall(rows: DataFrame, ids: list[str]) -> DataFrame:
    """Every recall@k column as rows, k as a number."""
    long = melt(rows, ids, [c for c in rows.columns if "recall@" in c], "metric", "recall")
    return long.select(*ids, F.regexp_extract("metric", r"@(\d+)", 1).cast("int").alias("k"), "recall")


def melt_metrics(rows: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    return melt(rows, ids, columns, "metric", "value").withColumn("metric", F.upper("metric"))


def quartiles(rows: DataFrame, key: str, value: str) -> DataFrame:
    return percentiles(rows, key, value, [0.25, 0.5, 0.75]).toDF(key, "q1", "median", "q3")


def with_chunk_metadata(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Left join on experiment: count, time and mean size of its chunks."""
    c = chunks.select("experiment", F.col("total_chunks").alias("chunk_count"), F.col("processing_time_seconds").alias("chunk_time"), F.col("avg_chars_per_chunk").alias("chunk_avg_chars"))
    return rows.join(c, "experiment", "left")


def with_index_metadata(rows: DataFrame, indices: DataFrame) -> DataFrame:
    """Left join on experiment and model, slashes taken as underscores on both sides; build time under any of its names."""
    t = F.coalesce("build_time_seconds", "indexing_compute_duration_seconds", "indexing_duration")
    i = indices.select(index_name(F.col("experiment"), F.col("model")).alias("index_key"), t.alias("index_time"))
    return rows.withColumn("index_key", index_name(F.col("experiment"), F.col("embedding_model"))).join(i, "index_key", "left").drop("index_key")


def prefix_join(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Each experiment with the first file whose name begins with it and an underscore. Names are cut at each of their
    underscores, so that the join is on equal keys."""
    parts = F.split("file", "_")
    heads = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "_"))
    keyed = files.where(F.contains("file", F.lit("_"))).select("file", "seconds", F.explode(heads).alias("experiment"))
    best = keyed.groupBy("experiment").agg(F.min(F.struct("file", "seconds")).alias("f"))
    return rows.join(best, "experiment", "left").select(*rows.columns, F.col("f.file").alias("file"), F.col("f.seconds").alias("seconds"))


def not_done(wanted: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(manifest, keys, "left_anti")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def reorder(rows: DataFrame, lead: list[str]) -> DataFrame:
    """Leading columns first; KeyError if one is not there."""
    if missing := [c for c in lead if c not in rows.columns]:
        raise KeyError(missing)
    return rows.select(*lead, *(c for c in rows.columns if c not in lead))


def null_safe_contains(c: Column, part: str) -> Column:
    return F.coalesce(F.contains(c, F.lit(part)), F.lit(False))


def enriched(rows: DataFrame) -> DataFrame:
    """Strategy, parameters, times in hours (0 is none) and efficiency. A rate stands in for a time that no row has."""
    no_time = rows.agg(F.count("chunk_time")).first()[0] == 0
    chunk_s = F.try_divide(F.col("chunk_count").cast("double"), F.col("chunks_per_second")) if no_time and "chunks_per_second" in rows.columns else F.col("chunk_time")
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    name = F.col("experiment")
    out = rows.withColumns({"strategy": strategy(name), **params(name)})
    hours = lambda c: F.nullif(finite(c) / 3600, F.lit(0.0))
    out = out.withColumns({"chunk_hours": hours(chunk_s.cast("double")), "index_hours": hours(numeric(F.col("index_time").cast("string")))})
    total = F.coalesce("chunk_hours", F.lit(0.0)) + F.coalesce("index_hours", F.lit(0.0))
    return out.withColumns({"total_hours": F.nullif(total, F.lit(0.0)), "size_bin": size_bin(F.col("chunk_avg_chars")), "efficiency": F.try_divide(F.col("ndcg@10"), F.col("chunk_avg_chars")) * 100})


#: Metrics, strategies and levels of the report.
REPORT_METRICS = ("ndcg@10", "recall@10", "precision@10", "map@10", "mrr@10")
STRATEGIES = ("Fixed", "Recursive", "Sentence", "Semantic")
LEVELS = ("All", "Easy", "Moderate", "Hard")


def report_sections(rows: DataFrame) -> dict[str, DataFrame]:
    """The five sections of the report on a master table, by title: metrics by strategy, models, parameters, difficulty,
    and the strategies side by side. Metrics that no column has are left out."""
    d = rows.withColumns({"strategy": strategy(F.col("experiment")), **params(F.col("experiment"))})
    there = [m for m in REPORT_METRICS if m in d.columns]
    mean = lambda m: F.avg(F.col(f"`{m}`")).alias(m)
    by = lambda key, names: d.where(F.col(key).isNotNull()).groupBy(key).agg(*map(mean, names)).orderBy(key)
    wide = lambda key, column, values: d.groupBy(key).pivot(column, list(values)).agg(F.avg("`ndcg@10`")).orderBy(key)
    out = {"Metrics by strategy": d.groupBy("strategy").agg(*(f(F.col(f"`{m}`")).alias(f"{m} {n}") for m in there for n, f in (("mean", F.avg), ("std", F.stddev_samp)))).orderBy("strategy")}
    if "embedding_model" in d.columns:
        out["Embedding models"] = wide("embedding_model", "strategy", (*STRATEGIES, "Other"))
    out["Semantic threshold"] = by("param_threshold", [m for m in there if m in REPORT_METRICS[:3]])
    out["Overlap"] = by("param_overlap", [m for m in there if m in REPORT_METRICS[:2]])
    if "config_difficulty" in d.columns:
        out["Difficulty"] = wide("strategy", "config_difficulty", LEVELS)
    out["Strategies compared"] = d.where(F.col("strategy").isin(*STRATEGIES)).groupBy("strategy").agg(*map(mean, there)).orderBy("strategy")
    return out


def selected(experiments: DataFrame) -> DataFrame:
    """Experiments of the distance comparison: the semantic ones and one of each other strategy."""
    return experiments.where(F.startswith("experiment", F.lit("semantic")) | F.col("experiment").isin("fixed_1024_128", "recursive_1024_128", "sentence_s10"))


def merged_columns(rows: DataFrame, path: Column, model: Column, difficulty: Column, input_file: Column, has_metadata: Column) -> DataFrame:
    """``rows`` with model_name, dataset_difficulty and dataset_type, from a run's metadata, or else its path."""
    from_path = F.lit("unknown")
    for part, name in (("bge-large", "BAAI/bge-large-en-v1.5"), ("bge-base", "BAAI/bge-base-en-v1.5"), ("MiniLM", "all-MiniLM-L6-v2")):
        from_path = F.when(F.contains(path, F.lit(part)), name).otherwise(from_path)
    silver = has_metadata & null_safe_contains(F.lower(input_file), "silver")
    level = F.when(silver, "Hard").otherwise(F.when(has_metadata, F.coalesce(difficulty, F.lit("unknown"))).otherwise("unknown"))
    low = F.lower(path)
    named = F.when(F.contains(low, F.lit("easy")), "Easy").when(F.contains(low, F.lit("hard")), "Hard").when(F.contains(low, F.lit("moderate")), "Moderate").otherwise("unknown")
    return rows.withColumns({
        "model_name": F.when(has_metadata, F.coalesce(model, F.lit("unknown"))).otherwise(from_path),
        "dataset_difficulty": F.when(level == "unknown", named).otherwise(level),
        "dataset_type": F.when(silver, "Silver").otherwise("Gold"),
    })


def flatten_record(rows: DataFrame, most: int = 3) -> DataFrame:
    """sample_id, question, gold_count, gold_json, gold_passage_1.. with '' for what is missing."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    gold = F.coalesce("gold_passages", F.array().cast("array<string>"))
    return rows.select(text("sample_id").alias("sample_id"), text("question").alias("question"), F.size(gold).alias("gold_count"), F.to_json(gold).alias("gold_json"), *(F.coalesce(F.get(gold, F.lit(i)), F.lit("")).alias(f"gold_passage_{i + 1}") for i in range(most)))


def distinct_gold(pairs: Column) -> Column:
    """Trimmed, distinct, sorted short answers of all pairs."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.flatten(F.transform(pairs, lambda p: p["short_answers"])), lambda s: F.trim(s)), lambda s: s != "")))


def sample_contexts(docs: DataFrame, n: int, hops: int, seed: str, least: int = 100) -> DataFrame:
    """(sample, hop, doc_id): ``n`` draws of ``hops`` different documents of ``least`` characters, the same for a seed.

    Documents stand in the order of a digest; a limit on that order keeps each task's best, not all rows."""
    long = docs.where(F.length("text") >= least).select("doc_id", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(seed)).cast("binary")).alias("key"))
    top = long.orderBy("key", "doc_id").limit(n * hops)
    at = F.row_number().over(W.orderBy("key", "doc_id")) - 1
    return top.withColumn("at", at).select(F.floor(F.col("at") / hops).cast("int").alias("sample"), (F.col("at") % hops).cast("int").alias("hop"), "doc_id")


def accept_until(attempts: DataFrame, n: int, most_failures: int | None = None) -> DataFrame:
    """The first ``n`` valid attempts (attempt, valid) before the failures reach 10 n. An attempt of unknown validity is
    neither. What is accepted stands among the first n + failures attempts, so that no more are ranked in one task."""
    most = 10 * n if most_failures is None else most_failures
    attempts = attempts.where("valid IS NOT NULL").orderBy("attempt").limit(max(0, n + most - 1))
    w = W.orderBy("attempt").rowsBetween(W.unboundedPreceding, W.currentRow)
    got = attempts.withColumn("bad", F.sum((~F.col("valid")).cast("int")).over(w)).withColumn("good", F.sum(F.col("valid").cast("int")).over(w))
    return got.where(F.col("valid") & (F.col("good") <= n) & (F.col("bad") < most)).drop("bad", "good")
