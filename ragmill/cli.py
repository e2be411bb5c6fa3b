"""Command line: build chunks and vectors, run evaluations, make questions, gather and compare results.

Data and results lie below a root on any store; embedders, fetchers and language models are injected, on the command line
as ``module:name``."""

from __future__ import annotations

import argparse
import datetime
import hashlib
import importlib
import json
import posixpath
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.functions import pages as pg
from ragmill.functions import text as tx
from ragmill.functions.vectors import Embedder, HashingEmbedder, batch_size, embed
from ragmill.operators import chunk as ck
from ragmill.operators import evaluate as ev
from ragmill.operators import results as rs
from ragmill.operators.retrieve import RETRIEVERS, knn
from ragmill.schemas import KS
from ragmill.session import session
from ragmill.sources import readers, store, writers

#: Names of the distance comparison.
DISTANCES = {"ip": "IP (Cosine)", "l2": "L2 (Euclidean)", "l1": "L1 (Manhattan)", "linf": "Linf (Chebyshev)"}


def safe(name: str) -> str:
    return name.replace("/", "_")


def stem(path: str) -> str:
    return posixpath.splitext(posixpath.basename(path))[0]


def stamp(form: str = "%Y-%m-%d_%H-%M-%S") -> str:
    return datetime.datetime.now().strftime(form)


def run_prefix(config: dict, path: str) -> str:
    """Model, configuration name and difficulty of a run, as one folder name."""
    parts = [safe(config.get("embedding_model") or "unknown"), stem(path)] + ([config["difficulty"]] if config.get("difficulty") else [])
    return "_".join(parts)


def preprocessed_path(base: str, limit: int | None) -> str:
    """A dated file name that tells the limit, or that there is none."""
    return f"{base}/preprocessed_{stamp('%Y-%m-%d')}_{'all' if limit is None else f'limit_{limit}'}.jsonl"


def check_config(config: dict) -> str | None:
    missing = [k for k in ("input_file", "embedding_model", "experiments") if not config.get(k)]
    return f"The configuration lacks {', '.join(missing)}." if missing else None


def documents(spark: SparkSession, config: dict) -> DataFrame:
    rows = readers.samples(spark, config["input_file"], config.get("limit"))
    if config.get("difficulty"):
        rows = rows.where(F.col("difficulty") == config["difficulty"])
    return rows


def chunk_key(experiment: dict, config: dict) -> str:
    """What chunks hang on: function, parameters and input. Chunks of another key are made anew."""
    what = [experiment["function"], experiment.get("params", {}), config["input_file"], config.get("limit"), config.get("difficulty")]
    return hashlib.sha256(json.dumps(what, sort_keys=True).encode()).hexdigest()[:16]


def side_file(spark: SparkSession, path: str) -> dict:
    return json.loads(store.read_text(spark, path) or "{}")


def build_chunks(spark: SparkSession, config: dict, root: str, embedder: Embedder | None = None) -> None:
    """Chunks of each experiment, unless they are there already and were made alike."""
    docs = documents(spark, config).where(F.length("document_text") > 0).select(F.xxhash64("sample_id").alias("doc_id"), F.col("document_text").alias("text"))
    for e in config["experiments"]:
        where, side = f"{root}/chunks/{e['name']}", f"{root}/chunks/{e['name']}.metadata.json"
        key = chunk_key(e, config)
        if store.whole(spark, where) and side_file(spark, side).get("key") == key:
            continue
        params = {k: v for k, v in e.get("params", {}).items() if k != "chunking_embeddings"}
        if e["function"] == "chunk_semantic":
            params["embedder"] = embedder or HashingEmbedder()
        began = time.time()
        out = ck.chunk(docs, e["function"], **params)
        out.withColumn("chunk_id", F.xxhash64("doc_id", "chunk_pos")).write.mode("overwrite").parquet(where)
        stats = ck.corpus_stats(spark.read.parquet(where), docs).first().asDict()
        took = time.time() - began
        if e["function"] == "chunk_semantic":
            stats |= {f"sentence_{k}": v for k, v in ck.sentence_stats(docs).first().asDict().items()}
        writers.metadata({"experiment": e["name"], "key": key, **stats, "processing_time_seconds": took, "chunks_per_second": stats["total_chunks"] / took if took else 0, "avg_chars_per_chunk": stats["avg_chars"], "created": datetime.datetime.now().isoformat()}, side)


def build_vectors(spark: SparkSession, config: dict, root: str, embedder: Embedder | None = None, by_length: bool = False, device: str = "cpu") -> None:
    """Vectors of each experiment's chunks, made anew when the chunks were. With ``by_length`` texts of like length are
    encoded together, as many as the model's budget holds."""
    model = config["embedding_model"]
    for e in config["experiments"]:
        chunks, where = f"{root}/chunks/{e['name']}", f"{root}/vectors/{e['name']}_{safe(model)}"
        side, key = f"{where}.metadata.json", side_file(spark, f"{chunks}.metadata.json").get("key")
        if not store.whole(spark, chunks) or store.whole(spark, where) and side_file(spark, side).get("key") == key:
            continue
        began, rows, together = time.time(), spark.read.parquet(chunks), 1024
        if by_length:
            together = batch_size(rows.agg(F.max(F.length("text"))).first()[0] or 0, model, device)
            rows = rows.withColumn("n_chars", F.length("text")).repartitionByRange("n_chars", "chunk_id").sortWithinPartitions("n_chars", "chunk_id")
        embed(rows, "text", embedder or HashingEmbedder(), batch=together).select("chunk_id", "embedding").write.mode("overwrite").parquet(where)
        writers.metadata({"experiment": e["name"], "model": model, "key": key, "batch_size": together, ("indexing_duration" if by_length else "indexing_compute_duration_seconds"): time.time() - began}, side)


def evaluate(spark: SparkSession, config: dict, root: str, embedder: Embedder | None = None) -> DataFrame | None:
    """Metrics per question and experiment, wide, with the mean time a question took; experiments without chunks or vectors
    are left out, and without any there is no table. Questions without hits score 0."""
    if config.get("retriever_type", "exact") not in RETRIEVERS:
        raise SystemExit(1)
    rows = documents(spark, config).where(F.length("question") > 0)
    q = rows.select(F.xxhash64("sample_id").alias("qid"), "sample_id", "question", F.col("gold_passages").alias("gold"))
    vectors = embed(q, "question", embedder or HashingEmbedder()).select("qid", "embedding")
    n, top, out = max(1, q.count()), config.get("top_k", 20), []
    for e in config["experiments"]:
        c, v = f"{root}/chunks/{e['name']}", f"{root}/vectors/{e['name']}_{safe(config['embedding_model'])}"
        if not (store.whole(spark, c) and store.whole(spark, v)):
            continue
        v, c = readers.load_index(spark, v, c)
        began = time.time()
        hits = f"{root}/hits/{e['name']}_{safe(config['embedding_model'])}"
        RETRIEVERS[config.get("retriever_type", "exact")](vectors, v, top).write.mode("overwrite").parquet(hits)
        took = time.time() - began
        judged = ev.judge(spark.read.parquet(hits).join(c.select("chunk_id", "text"), "chunk_id"), q)
        ks = tuple(k for k in KS if k <= top)
        m = ev.wide(ev.metrics_at(judged, ["qid"], ks, questions=q), ["qid"], ks)
        facts = {"experiment": F.lit(e["name"]), "num_chunks": F.lit(c.count()), "retrieval_time_s": F.lit(took / n)}
        out.append(q.select("qid", "sample_id", "question").join(m, "qid").drop("qid").withColumns(facts))
    return rs.union_all(out) if out else None


def run(spark: SparkSession, config: dict, path: str, root: str, embedder: Embedder | None = None) -> str | None:
    """Evaluate a configuration, unless its results are there; returns the folder. It gets the details, the summary, a copy of
    the configuration, times, and a log."""
    where = f"{root}/results/{run_prefix(config, path)}"
    if any(x.endswith("_detailed_results.csv") for x in store.names(spark, where)):
        return None
    at, began, log = stamp(), time.time(), []
    say = lambda x: (log.append(f"{datetime.datetime.now().isoformat()} {x}"), print(x))
    say(f"{documents(spark, config).count()} samples of {config['input_file']}")
    rows = evaluate(spark, config, root, embedder)
    if rows is None:
        say("No experiment has chunks and vectors.")
        return None
    details = f"{where}/{at}_detailed_results.csv"
    writers.detailed_results(rows, where, at)
    if not store.whole(spark, details):
        say("No questions.")
        return None
    rows = readers.result_csv(spark, details)
    means = rows.groupBy("experiment").agg(*(F.avg(F.col(f"`{c}`").cast("double")).alias(c) for c in rows.columns if "@" in c)).orderBy("experiment")
    writers.csv(means, f"{where}/{at}_summary.csv")
    store.write_text(spark, f"{where}/{posixpath.basename(path)}", json.dumps(config, ensure_ascii=False, indent=2))
    writers.metadata({**{k: config.get(k) for k in ("embedding_model", "difficulty", "input_file", "top_k")}, "config": config, "duration_seconds": time.time() - began}, f"{where}/metadata.json")
    say(writers.report({"Summary": means}))
    say(f"{time.time() - began:.1f} seconds")
    store.write_text(spark, f"{where}/{at}_run.log", "\n".join(log) + "\n")
    return where


def preprocess(spark: SparkSession, samples: DataFrame, pages: DataFrame) -> DataFrame:
    """Samples (sample_id, question, urls, qa_pairs) with the texts of their pages and distinct gold passages."""
    texts = pg.pages_for(samples, pg.parse_pages(pages)).where(F.length("document_text") > 0)
    return samples.join(texts, "sample_id").withColumns({"question": F.trim("question"), "gold_passages": rs.distinct_gold(F.col("qa_pairs"))}).drop("urls", "qa_pairs")


def preprocess_dataset(spark: SparkSession, source: str, base: str, fetcher: readers.Fetcher, limit: int | None = None) -> str:
    """Fetch the pages of a dataset's samples, each once, and write the samples whose pages have text; returns the path."""
    given = readers.dataset(spark, source, schema="sample_id string, ambiguous_question string, wikipages array<struct<title:string,url:string>>, qa_pairs array<struct<short_answers:array<string>>>")
    given = given.orderBy("sample_id").limit(limit) if limit else given
    samples = given.select("sample_id", tx.clean_text(F.col("ambiguous_question")).alias("question"), F.filter(F.array_distinct(F.transform("wikipages", lambda p: p.url)), lambda u: u.isNotNull()).alias("urls"), "qa_pairs")
    urls = samples.select(F.explode("urls").alias("url")).distinct()
    path = preprocessed_path(base, limit)
    writers.jsonl(preprocess(spark, samples, readers.fetch_pages(urls, fetcher)), path)
    return path


def silver(spark: SparkSession, corpus: str, path: str, model: readers.LanguageModel, limit: int = 10, hops: int = 2, seed: str = "silver") -> int:
    """Questions over ``hops`` sampled documents each, as samples in ``path``; returns how many. Up to ten failures for each
    question wanted are borne."""
    docs = readers.document_texts(spark, corpus).select(F.xxhash64("text").alias("doc_id"), "text").dropDuplicates(["doc_id"])
    picks = rs.sample_contexts(docs, 11 * limit, hops, seed).join(docs, "doc_id").groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("hop", "text")))["text"].alias("ctx")).where(F.size("ctx") == hops)
    asked = readers.ask(picks.withColumn("prompt", tx.multihop_prompt(F.get("ctx", F.lit(0)), F.get("ctx", F.lit(1)))), "prompt", model)
    got = asked.select(F.col("sample").alias("attempt"), "ctx", F.explode(F.array(tx.parse_reply(F.col("reply")))).alias("r")).withColumn("valid", tx.valid_reply(F.col("r")))
    kept = rs.accept_until(got, limit).select(
        F.concat(F.lit("silver_"), F.md5(F.concat_ws("\n", "ctx").cast("binary"))).alias("sample_id"), "r.question", "r.answer", F.col("r.gold_snippets").alias("gold_passages"),
        F.array_join("ctx", "\n\n").alias("document_text"), F.lit("Multihop").alias("category"), F.lit("Hard").alias("difficulty"), F.struct(F.col("ctx").alias("source_chunks")).alias("metadata"),
    )
    writers.jsonl(kept, path)
    return spark.read.schema("sample_id string").json(path).count()


def categorize(spark: SparkSession, source: str, path: str, model: readers.LanguageModel, limit: int | None = None) -> None:
    """Samples with category and difficulty as the model names them."""
    got = readers.ask(readers.samples(spark, source, limit).withColumn("prompt", tx.category_prompt(F.coalesce("question", F.lit("")))), "prompt", model)
    category, difficulty = tx.pair_of(F.coalesce("reply", F.lit("")))
    writers.jsonl(got.withColumns({"category": category, "difficulty": difficulty}).drop("prompt", "reply"), path)


def chunk_metadata(spark: SparkSession, root: str) -> DataFrame:
    kind = "experiment string, total_chunks long, processing_time_seconds double, avg_chars_per_chunk double"
    rows = [side_file(spark, f"{root}/chunks/{n}") for n in store.names(spark, f"{root}/chunks", "file") if n.endswith(".metadata.json")]
    return spark.createDataFrame([(r.get("experiment"), r.get("total_chunks"), r.get("processing_time_seconds"), r.get("avg_chars_per_chunk")) for r in rows], kind)


def index_metadata(spark: SparkSession, root: str) -> DataFrame:
    names = ("build_time_seconds", "indexing_compute_duration_seconds", "indexing_duration")
    rows = [side_file(spark, f"{root}/vectors/{n}") for n in store.names(spark, f"{root}/vectors", "file") if n.endswith(".metadata.json")]
    return spark.createDataFrame([(r.get("experiment"), r.get("model"), *(r.get(n) for n in names)) for r in rows], "experiment string, model string, " + ", ".join(f"{n} double" for n in names))


def result_tables(spark: SparkSession, root: str, ends: str):
    """(folder, path, metadata) of the result tables below ``root``; archives are left out."""
    for folder in store.names(spark, f"{root}/results", "folder"):
        if "archive" not in folder:
            where = f"{root}/results/{folder}"
            for n in store.names(spark, where):
                if n.endswith(ends):
                    yield folder, f"{where}/{n}", side_file(spark, f"{where}/metadata.json")


def aggregate(spark: SparkSession, root: str) -> DataFrame | None:
    """The master table: all detailed results with what their folder names say, and the facts of their chunks and vectors."""
    frames = []
    for folder, path, meta in result_tables(spark, root, "_detailed_results.csv"):
        parts = tx.folder_parts(F.lit(folder), F.lit(meta.get("embedding_model")).cast("string"))
        frames.append(readers.result_csv(spark, path).withColumns({**parts, "dataset_type": tx.dataset_type(parts["experiment_config"])}))
    if not frames:
        return None
    rows = rs.union_all(frames).where(F.col("embedding_model") != "unknown").drop("chunking_time_s")
    return rs.with_index_metadata(rs.with_chunk_metadata(rows, chunk_metadata(spark, root)), index_metadata(spark, root))


def merge(spark: SparkSession, root: str) -> DataFrame | None:
    """Summaries of all runs (details where there are none), with model, difficulty and kind of data from the run's metadata
    or path, and each experiment's index time and number of chunks."""
    found = list(result_tables(spark, root, "_summary.csv")) or list(result_tables(spark, root, "_detailed_results.csv"))
    frames = []
    for _, path, meta in found:
        text = lambda k, m=meta: F.lit(m.get(k)).cast("string")
        rows = readers.result_csv(spark, path)
        frames.append(rs.merged_columns(rows, F.lit(path), text("embedding_model"), text("difficulty"), text("input_file"), F.lit(bool(meta))).withColumn("source_file", F.lit(posixpath.basename(path))))
    if not frames:
        return None
    rows = rs.union_all(frames).where(F.col("model_name") != "unknown").withColumn("embedding_model", F.col("model_name"))
    rows = rs.with_index_metadata(rows.drop("num_chunks", "index_time"), index_metadata(spark, root)).withColumnRenamed("index_time", "indexing_time_s").drop("embedding_model")
    rows = rows.join(chunk_metadata(spark, root).select("experiment", F.col("total_chunks").alias("num_chunks")), "experiment", "left")
    return rs.reorder(rows, ["model_name", "dataset_type", "dataset_difficulty", "experiment", "indexing_time_s", "num_chunks"])


def compare_distances(spark: SparkSession, root: str, gold: str, embedder: Embedder | None = None, top: int = 10) -> DataFrame | None:
    """Mean metrics of the gold questions under four distances, for the selected experiments that have chunks."""
    embedder = embedder or HashingEmbedder()
    questions = readers.gold_questions(spark, gold).select(F.xxhash64("question", "gold").alias("qid"), "question", "gold").dropDuplicates(["qid"])
    asked = embed(questions, "question", embedder).select("qid", "embedding")
    there = [n for n in store.names(spark, f"{root}/chunks", "folder") if store.whole(spark, f"{root}/chunks/{n}")]
    names = [r.experiment for r in rs.selected(spark.createDataFrame([(n,) for n in there], "experiment string")).orderBy("experiment").collect()]
    out = []
    for name in names:
        chunks = spark.read.parquet(f"{root}/chunks/{name}")
        vectors = readers.cached(spark, f"{root}/distance_vectors/{name}", lambda c=chunks: embed(c, "text", embedder).select("chunk_id", "embedding"))
        for metric, title in DISTANCES.items():
            hits = knn(asked, vectors, top, metric).join(chunks.select("chunk_id", "text"), "chunk_id")
            m = ev.metrics_at(ev.judge(hits, questions), ["qid"], (top,), questions=questions)
            cols = {"mrr": "MRR", "ndcg": f"NDCG@{top}", "precision": f"Precision@{top}", "recall": f"Recall@{top}", "f1_score": f"F1@{top}"}
            out.append(m.agg(*(F.round(F.avg(c), 4).alias(to) for c, to in cols.items())).select(F.lit(name).alias("Experiment"), F.lit(title).alias("Distance_Metric"), F.lit(chunks.count()).alias("Chunks_Count"), *(F.col(f"`{c}`") for c in cols.values())))
    return rs.union_all(out) if out else None


def injected(name: str | None, default=None):
    """An object by ``module:name``; a class is made without arguments."""
    if not name:
        return default
    module, _, attribute = name.partition(":")
    got = getattr(importlib.import_module(module), attribute)
    return got() if isinstance(got, type) else got


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ragmill")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, **options):
        s = sub.add_parser(name)
        for x in positional:
            s.add_argument(x)
        for x, (kind, default) in options.items():
            flag = "--" + x.replace("_", "-")
            s.add_argument(flag, action="store_true") if kind is bool else s.add_argument(flag, type=kind, default=default, required=default is ...)
        return s

    for name in ("build-chunks", "build-vectors", "run"):
        command(name, config=(str, ...), root=(str, "data"), embedder=(str, None), **({"by_length": (bool, None), "device": (str, "cpu")} if name == "build-vectors" else {}))
    for name in ("aggregate", "merge", "report"):
        command(name, root=(str, ...), to=(str, ...))
    command("distances", root=(str, ...), gold=(str, ...), to=(str, ...), embedder=(str, None))
    command("silver", "input", "output", limit=(int, 10), model=(str, None))
    command("categorize", "input", "output", limit=(int, None), model=(str, None))
    command("preprocess", "input", base=(str, "data/preprocessed"), limit=(int, None), fetcher=(str, ...))
    command("mirror", "source", "target")
    command("to-csv", "input", "output", delimiter=(str, ","), max_gold=(int, 3))
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = session()
    if a.command == "to-csv":
        print(writers.records_csv(readers.samples(spark, a.input), a.output, a.delimiter, a.max_gold))
    elif a.command == "mirror":
        print(readers.mirror(spark, a.source, a.target))
    elif a.command == "silver":
        print(silver(spark, a.input, a.output, injected(a.model, readers.FixedReplies()), a.limit))
    elif a.command == "categorize":
        categorize(spark, a.input, a.output, injected(a.model, readers.FixedReplies()), a.limit)
    elif a.command == "preprocess":
        print(preprocess_dataset(spark, a.input, a.base, injected(a.fetcher), a.limit))
    elif a.command in ("aggregate", "merge", "distances", "report"):
        rows = compare_distances(spark, a.root, a.gold, injected(a.embedder)) if a.command == "distances" else {"aggregate": aggregate, "merge": merge, "report": aggregate}[a.command](spark, a.root)
        if rows is None:
            print("No results.")
        elif a.command == "report":
            store.write_text(spark, a.to, writers.report(rs.report_sections(rows)))
        else:
            writers.csv(rows, a.to)
    else:
        config = readers.config(a.config)
        if problem := check_config(config):
            print(problem)
        elif a.command == "build-chunks":
            build_chunks(spark, config, a.root, injected(a.embedder))
        elif a.command == "build-vectors":
            build_vectors(spark, config, a.root, injected(a.embedder), a.by_length, a.device)
        else:
            run(spark, config, a.config, a.root, injected(a.embedder))


if __name__ == "__main__":
    main()
