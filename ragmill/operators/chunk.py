"""Chunkers: DataFrame (doc_id, text) to (doc_id, chunk_pos, text). Every document is cut by itself, where it lies."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ragmill.functions.text import split_safe
from ragmill.functions.vectors import Embedder, dot, embed
from ragmill.operators.ranks import percentiles


def exploded(df: DataFrame, chunks: Column) -> DataFrame:
    return df.select("doc_id", F.posexplode(chunks).alias("chunk_pos", "text"))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, "\\s+"), lambda t: t != "")


def windows(items: Column, size: int, overlap: int) -> Column:
    """Runs of ``size`` items, ``overlap`` of them shared; the last run ends with the items."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below size")
    step = size - overlap
    last = F.greatest(F.ceil((F.size(items) - size) / step), F.lit(0)).cast("int") * step
    return F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.array_join(F.slice(items, i + 1, size), " "))


def fixed(df: DataFrame, chunk_size: int, chunk_overlap: int = 0) -> DataFrame:
    """Windows of tokens; a text without tokens has no chunk. Tokens are words, as no vocabulary comes along.

    The generator keeps the token array from being made anew for every window."""
    cut = df.select("doc_id", F.explode(F.array(tokens(F.col("text")))).alias("tokens")).where(F.size("tokens") > 0)
    return exploded(cut, windows(F.col("tokens"), chunk_size, chunk_overlap))


def sentences(df: DataFrame) -> DataFrame:
    """(doc_id, pos, text)"""
    return df.select("doc_id", F.posexplode(split_safe(F.col("text"))).alias("pos", "text"))


def by_sentence(df: DataFrame, sentences_per_chunk: int) -> DataFrame:
    if sentences_per_chunk <= 0:
        raise ValueError("sentences_per_chunk must be positive")
    n = sentences_per_chunk
    cut = df.select("doc_id", F.explode(F.array(split_safe(F.col("text")))).alias("s")).where(F.size("s") > 0)
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("s") - 1) / n).cast("int")), lambda i: F.array_join(F.slice("s", i * n + 1, n), " "))
    return exploded(cut, groups)


def pieces(text: str, separators: list[str], size: int, length: Callable[[str], int]) -> list[str]:
    """Pieces of at most ``size``: cut at the first separator that is there, kept in front, and deeper where needed."""
    sep = next((s for s in separators if s in text), separators[-1])
    rest = separators[separators.index(sep) + 1 :]
    parts = list(text) if sep == "" else [p for p in re.split(f"(?={re.escape(sep)})", text) if p]
    out = []
    for p in parts:
        out += [p] if length(p) <= size or not rest else pieces(p, rest, size, length)
    return out


def recursive_split(text: str, size: int, overlap: int, length: Callable[[str], int], separators=("\n\n", "\n", " ", "")) -> list[str]:
    """Greedy runs of pieces up to ``size``, each beginning with pieces of the last one up to ``overlap``."""
    out: list[str] = []
    run: list[tuple[str, int]] = []
    total = 0
    for p in pieces(text, list(separators), size, length):
        n = length(p)
        if run and total + n > size:
            out.append("".join(x for x, _ in run).strip())
            while run and (total > overlap or total + n > size):
                total -= run.pop(0)[1]
        run.append((p, n))
        total += n
    out.append("".join(x for x, _ in run).strip())
    return [c for c in out if c]


#: What counts as a token of recursive chunks: words, and signs one by one.
TOKEN, WORD = re.compile(r"\w+|[^\w\s]"), re.compile(r"\w")


def piece_ends(text: str, marks: list[tuple[np.ndarray, int]], starts: np.ndarray, size: int) -> np.ndarray:
    """Where the pieces of ``pieces`` end, by tokens. ``marks``: places and length of each separator, the coarsest first;
    ``starts``: where tokens begin. A level is cut at all its separators at once; what is too long goes to the next."""
    ends = []

    def cut(a: int, b: int, level: int) -> None:
        while level < len(marks):
            places, wide = marks[level]
            lo, hi = np.searchsorted(places, (a, b - wide + 1))
            level += 1
            if hi <= lo:
                continue
            bounds = np.append(places[lo:hi], b)
            bounds = bounds[bounds > a]
            count = np.diff(np.searchsorted(starts, np.append(a, bounds)))
            done = 0
            for k in np.flatnonzero(count > size):
                ends.append(bounds[done:k])
                cut(int(bounds[k - 1]) if k else a, int(bounds[k]), level)
                done = k + 1
            ends.append(bounds[done:])
            return
        ends.append(np.arange(a + 1, b + 1))

    cut(0, len(text), 0)
    return np.concatenate(ends)


def token_split(text: str, size: int, overlap: int) -> list[str]:
    """``recursive_split`` at paragraphs, lines, blanks and characters, by tokens, which are counted once a text: chunks are
    looked up in sums of counts."""
    if not text:
        return []
    signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, kind = np.unique(signs, return_inverse=True)
    word = np.array([bool(WORD.match(chr(c))) for c in kinds])[kind]
    blank = np.array([chr(c).isspace() for c in kinds])[kind]
    starts = np.flatnonzero(~blank & ~(word & np.append(False, word[:-1])))
    line = np.flatnonzero(signs == 10)
    marks = [(line[:-1][np.diff(line) == 1], 2), (line, 1), (np.flatnonzero(signs == 32), 1)]
    ends = np.concatenate(([0], piece_ends(text, marks, starts, size)))
    single = np.flatnonzero(np.diff(ends) == 1)
    count = np.diff(np.searchsorted(starts, ends))
    # characters by themselves are a token each, but for white space
    count[single] = ~blank[ends[single]]
    total = np.concatenate(([0], np.cumsum(count)))
    out, at, n = [], 0, len(count)
    while True:
        to = max(at + 1, int(np.searchsorted(total, total[at] + size, side="right")) - 1)
        out.append(text[ends[at] : ends[min(to, n)]].strip())
        if to >= n:
            return [c for c in out if c]
        at = min(to, int(np.searchsorted(total, max(total[to] - overlap, total[to + 1] - size))))


def recursive(df: DataFrame, chunk_size: int, chunk_overlap: int = 0) -> DataFrame:
    """Recursive separators; length counts words and signs. An Arrow-batched function, as the rule calls itself."""

    @F.pandas_udf("array<string>")
    def run(s):
        return s.map(lambda t: token_split(t, chunk_size, chunk_overlap) if t else [])

    return exploded(df, run("text"))


def distances(df: DataFrame, group: str = "doc_id", order: str = "pos", vector: str = "embedding") -> DataFrame:
    """``df`` with one minus the dot product with the row before, null at the first."""
    w = W.partitionBy(group).orderBy(order)
    return df.withColumn("distance", 1 - dot(F.lag(vector).over(w), F.col(vector)))


def islands(df: DataFrame, threshold: Column, group: str = "doc_id", order: str = "pos") -> DataFrame:
    """``df`` with island: one more wherever the distance is above the threshold."""
    w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn("island", F.sum(F.when(F.col("distance") > threshold, 1).otherwise(0)).over(w))


def percentile_threshold(df: DataFrame, amount: float, group: str = "doc_id") -> DataFrame:
    """(group, threshold): the linear percentile of the distances; 0 without any."""
    return percentiles(df, group, "distance", [amount / 100]).select(group, F.coalesce("p0", F.lit(0.0)).alias("threshold"))


def semantic(df: DataFrame, embedder: Embedder, similarity_threshold: float = 0.8) -> DataFrame:
    """Runs of sentences whose neighbours are similar."""
    cut = islands(distances(embed(sentences(df), "text", embedder)), F.lit(1 - similarity_threshold))
    rows = cut.groupBy("doc_id", F.col("island").cast("int").alias("chunk_pos")).agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("s"))
    return rows.select("doc_id", "chunk_pos", F.array_join(F.col("s.text"), " ").alias("text"))


CHUNKERS = {"chunk_fixed_size": fixed, "chunk_recursive": recursive, "chunk_by_sentence": by_sentence, "chunk_semantic": semantic}


def chunk(df: DataFrame, function: str, **params) -> DataFrame:
    """By the registered name of a chunker; blank chunks of the semantic one are dropped, empty ones of all."""
    out = CHUNKERS[function](df, **params)
    return out.where(F.trim("text") != "" if function == "chunk_semantic" else F.col("text") != "")


def corpus_stats(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    c = chunks.agg(F.count("*").alias("total_chunks"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("total_characters"))
    n = documents.agg(F.count("*").alias("documents"))
    return n.join(c).withColumn("avg_chars", F.coalesce(F.try_divide(F.col("total_characters").cast("double"), F.col("total_chunks")), F.lit(0.0)))


def sentence_stats(df: DataFrame) -> DataFrame:
    """(documents, sentences, avg_chars, max_chars) of the sentences that are embedded."""
    s = sentences(df)
    return s.agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("sentences"), F.avg(F.length("text")).alias("avg_chars"), F.max(F.length("text")).alias("max_chars"))


def length_sorted(chunks: DataFrame) -> DataFrame:
    """``chunks`` with their place in the order of length, ties as they were.

    A length's first place comes from counts by length (which are few), the place within from a window by length and one
    of 1024 ranges of documents, so that places hang on values alone and a lost task is redone alike."""
    ends = chunks.agg(F.min("doc_id").cast("double"), F.max("doc_id").cast("double")).first()
    low, span = (ends[0] or 0.0), (ends[1] or 0.0) - (ends[0] or 0.0) + 1
    cut = chunks.withColumn("n_chars", F.length("text")).withColumn("bin", F.floor((F.col("doc_id").cast("double") - low) / span * 1024))
    bins = cut.groupBy("n_chars", "bin").count()
    by_length = bins.groupBy("n_chars").agg(F.sum("count").alias("count"))
    starts = by_length.select("n_chars", F.coalesce(F.sum("count").over(W.orderBy("n_chars").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inner = F.coalesce(F.sum("count").over(W.partitionBy("n_chars").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = bins.withColumn("inner", inner).join(starts, "n_chars").select("n_chars", "bin", (F.col("start") + F.col("inner")).alias("before"))
    nth = F.row_number().over(W.partitionBy("n_chars", "bin").orderBy("doc_id", "chunk_pos"))
    return cut.withColumn("nth", nth).join(before, ["n_chars", "bin"]).withColumn("place", F.col("before") + F.col("nth")).drop("bin", "before", "nth")
