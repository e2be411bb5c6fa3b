"""Readers. Paths go to Spark, which knows every store; a missing path gives an empty table where that is the rule."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.functions.text import renamed_blob, relevant_file
from ragmill.schemas import SAMPLE
from ragmill.sources import store


def _lines(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.text(path)
    except AnalysisException:
        return spark.createDataFrame([], "value string")


def samples(spark: SparkSession, path: str, limit: int | None = None, schema: str = SAMPLE) -> DataFrame:
    """JSON lines as samples; sample_id falls back to id, then to one made of the line, the same in every run. A bad line fails; 0 or None is no limit;
    a missing file is empty. The first rows of a limit are the file's first."""
    try:
        df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    df = df.withColumn("sample_id", F.coalesce("sample_id", "id", F.md5(F.to_json(F.struct(*df.columns)).cast("binary"))))
    return df.limit(limit) if limit else df


def document_texts(spark: SparkSession, path: str) -> DataFrame:
    """The first of document_text, text, content, document of each line; other lines are skipped."""
    row = F.from_json("value", "document_text string, text string, content string, document string")
    return _lines(spark, path).select(F.coalesce(*(row[c] for c in ("document_text", "text", "content", "document"))).alias("text")).where("text IS NOT NULL")


def strict_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, object) of a file of JSON objects one after another, over one line or many. What is no object is
    skipped; a tail that ends too soon fails. A file is read by one task, as only its reader knows where objects end."""

    def run(batches):
        import pyarrow as pa

        decoder = json.JSONDecoder()
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at, out = 0, []
                while True:
                    while at < len(text) and text[at].isspace():
                        at += 1
                    if at >= len(text):
                        break
                    try:
                        got, end = decoder.raw_decode(text, at)
                    except json.JSONDecodeError as e:
                        raise ValueError(f"{name}: no whole object from line {text.count(chr(10), 0, at) + 1}") from e
                    if isinstance(got, dict):
                        out.append((text.count("\n", 0, at) + 1, json.dumps(got, ensure_ascii=False)))
                    at = end
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(out), pa.string()), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.string())], names=["file", "line", "object"])

    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.mapInArrow(run, "file string, line int, object string")


def gold_questions(spark: SparkSession, path: str) -> DataFrame:
    """(question, gold): lines with a question and gold passages, a single one as a list of one; other lines are skipped."""
    lines = _lines(spark, path)
    many = F.from_json("value", "question string, gold_passages array<string>")
    one = F.from_json("value", "gold_passages string")["gold_passages"]
    gold = F.coalesce(many["gold_passages"], F.when(F.length(one) > 0, F.array(one)))
    question = F.coalesce(many["question"], F.from_json("value", "question string")["question"])
    return lines.select(question.alias("question"), gold.alias("gold")).where((F.length("question") > 0) & (F.size("gold") > 0))


def chunk_texts(spark: SparkSession, path: str) -> DataFrame:
    """(pos, text) of a JSON array of strings or of objects with page_content, text or content; blank ones are dropped."""
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], "pos int, text string")
    items = whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "item"))
    row = F.from_json("item", "page_content string, text string, content string")
    full = lambda c: F.nullif(row[c], F.lit(""))
    text = F.when(F.startswith("item", F.lit("{")), F.coalesce(full("page_content"), full("text"), full("content"))).otherwise(F.col("item"))
    return items.select("pos", text.alias("text")).where(F.trim("text") != "")


def load_index(spark: SparkSession, vectors: str, chunks: str) -> tuple[DataFrame, DataFrame]:
    """Vectors and chunks written together; RuntimeError if their numbers differ."""
    v, c = spark.read.parquet(vectors), spark.read.parquet(chunks)
    n, m = v.count(), c.count()
    if n != m:
        raise RuntimeError(f"{n} vectors and {m} chunks")
    return v, c


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; made and written if it was never written to its end. Other errors, such as a store that
    cannot be reached, are errors and overwrite nothing."""
    if not store.whole(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def result_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with tabs, or commas if tabs give less than two columns."""
    head = spark.read.text(path).first()
    sep = "\t" if head and head[0].count("\t") >= 1 else ","
    return spark.read.option("sep", sep).option("header", "true").option("mode", "PERMISSIVE").csv(path)


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.option("header", "true")
    return (r.schema(schema) if schema else r.option("inferSchema", "true")).csv(path)


def files(spark: SparkSession, root: str, patterns: Iterable[str]) -> DataFrame:
    """(path, length) of the files below ``root`` that match the first pattern that any file matches."""
    for p in patterns:
        got = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", p).load(root).select("path", "length")
        if not got.isEmpty():
            return got
    return spark.createDataFrame([], "path string, length long")


def blobs(spark: SparkSession, root: str) -> DataFrame:
    """(path, to) of the metadata and result files of a store, with the names they are kept under."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return got.where(relevant_file(F.col("path"))).withColumn("to", renamed_blob(F.col("path")))


def mirror(spark: SparkSession, root: str, target: str) -> int:
    """Copy the metadata and result files below ``root`` to ``target`` under the names they are kept under; returns how many
    were not there before. These are few and small: one for each experiment."""
    base = root.rstrip("/")
    done = 0
    for r in blobs(spark, root).toLocalIterator():
        inner = r.path.split(base.removeprefix("file://"), 1)[-1].lstrip("/")
        to = spark.range(1).select(renamed_blob(F.lit(inner))).first()[0]
        done += store.copy(spark, r.path, f"{target.rstrip('/')}/{to}")
    return done


def dataset(spark: SparkSession, path: str, split: str = "train", schema: str | None = None) -> DataFrame:
    """A published dataset's split from its files: Parquet if there is any below ``path`` with the split's name, else JSON."""
    for kind, glob in (("parquet", f"*{split}*.parquet"), ("json", f"*{split}*.json*")):
        if not files(spark, path, [glob]).isEmpty():
            r = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
            return (r.schema(schema) if schema else r).format(kind).load(path)
    raise FileNotFoundError(f"{path}: no files of split {split}")


def json_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row of a JSON file; nulls if it is missing or bad."""
    try:
        return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("j")).select("j.*")
    except AnalysisException:
        return spark.range(1).select(F.from_json(F.lit("{}"), schema).alias("j")).select("j.*")


def config(path: str) -> dict:
    """A configuration, read on the driver from any store."""
    text = store.read_text(SparkSession.active(), path)
    if text is None:
        raise FileNotFoundError(path)
    return json.loads(text)


class Fetcher(Protocol):
    def get(self, url: str) -> str | None: ...


def fetch_pages(urls: DataFrame, fetcher: Fetcher) -> DataFrame:
    """(url, html) through an injected fetcher; what cannot be fetched has null html."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            u = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.string()), pa.array([fetcher.get(x) if x else None for x in u], pa.string())], names=["url", "html"])

    return urls.select("url").mapInArrow(run, "url string, html string")


class LanguageModel(Protocol):
    def reply(self, prompt: str) -> str: ...


class FixedReplies:
    """A model for tests: the reply is a rule of the prompt alone."""

    def reply(self, prompt: str) -> str:
        words = prompt.split()
        if prompt.startswith("Name the category"):
            return f"General | {('Easy', 'Moderate', 'Hard')[len(words) % 3]}"
        return json.dumps({"question": f"What joins {words[-1]}?", "answer": words[-1], "gold_snippets": [" ".join(words[-5:])]}, ensure_ascii=False)


def ask(df: DataFrame, prompt: str, model: LanguageModel, to: str = "reply") -> DataFrame:
    """``df`` with the model's reply to each prompt; a failing call gives null."""

    @F.pandas_udf("string")
    def run(s):
        def one(p):
            try:
                return None if p is None else model.reply(p)
            except Exception:
                return None

        return s.map(one)

    return df.withColumn(to, run(prompt))
