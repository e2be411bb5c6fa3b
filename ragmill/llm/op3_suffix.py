"""Removal of repeated byte strings, by suffix arrays over the places where repeats can be.

A string of ``length`` bytes is named by the smallest hash among the 32-byte grams in it: equal strings have
equal names. The starts of a text fall into runs of one name; a run with the bytes that its strings cover is a
piece. A name that one single piece has cannot repeat; pieces that are the same as a whole repeat as a whole.
Only pieces that share a name but differ (or may repeat inside) go to shards, each piece text once. A shard
builds a suffix array (Larsson-Sadakane refinement) and Kasai's common prefixes. A name with very many
pieces spreads over several shards; their sorted strings are then merged by binary search.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ragmill.llm.common import discard, materialize, table, text_buffers
from ragmill.llm.suffix import repeated

GRAM = 32
SHARD_BYTES = 3 << 20
#: Pieces of one name that a shard takes; a name with more is spread.
SPREAD = 2048
#: Starts of a piece at most; a longer run of one name (periodic text) is cut, and its pieces spread.
CUT = 1 << 17
#: Words of a passage that counts as repeated whatever its bytes, and words of the grams that name passages.
PASSAGE_WORDS, PASSAGE_GRAM = 51, 24
SALTS = 16


class Rolling:
    """Hashes of all substrings of a byte array from prefix sums, modulo 2**64."""

    def __init__(self):
        rng = np.random.default_rng(2024)
        self.symbol = rng.integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = 0x9E3779B97F4A7C15
        self.power = self.inverse = np.ones(1, np.uint64)

    def grow(self, n: int):
        if len(self.power) <= n:
            size = max(n + 1, 1 << 16, 2 * len(self.power))
            for name, m in (("power", self.base), ("inverse", pow(self.base, -1, 1 << 64))):
                setattr(self, name, np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size - 1, m, np.uint64)))))

    def sums(self, b: np.ndarray) -> np.ndarray:
        self.grow(len(b))
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.symbol[b] * self.power[: len(b)], dtype=np.uint64)))

    def all(self, sums: np.ndarray, size: int) -> np.ndarray:
        """Of each substring of ``size`` bytes."""
        return mixed((sums[size:] - sums[:-size]) * self.inverse[: len(sums) - size])

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each window, from running minima of blocks forwards and backwards."""
    n = len(x)
    y = np.concatenate((x, np.full(-n % size, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, size)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - size + 1], ahead[size - 1 : n])


def pieces_of(b: np.ndarray, length: int, roll: Rolling):
    """(name, digest, start, number of starts, whether the name's gram stands in it more than once) of each piece."""
    gram = min(GRAM, length)
    sums = roll.sums(b)
    grams = roll.all(sums, gram)
    name = sliding_min(grams, length - gram + 1)
    start = cut_runs(np.concatenate(([0], np.flatnonzero(name[1:] != name[:-1]) + 1)), len(name))
    end = np.append(start[1:], len(name))
    digest = roll.spans(sums, start, end - 1 + length)
    # a piece whose smallest gram stands at one place only holds no string twice
    piece = np.repeat(np.arange(len(start)), end - start)
    at = np.flatnonzero(grams[: len(name)] == name)
    times = np.bincount(piece[at], minlength=len(start))
    late = sliding_count(grams, name[end - 1], end, end - 1 + length - gram + 1)
    return name[start], digest, start, end - start, times + late > 1


def cut_runs(start: np.ndarray, size: int, most: int | None = None) -> np.ndarray:
    """``start`` of runs up to ``size`` with further starts, so that no run is longer than ``most``."""
    most = most or CUT
    run = np.diff(np.append(start, size))
    n = -(-run // most)
    return np.repeat(start, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * most


def sliding_count(grams, value, lo, hi):
    """How often ``value`` stands in grams[lo:hi], one by one for the few that need it."""
    out = np.zeros(len(value), np.int64)
    size = hi - lo
    if not len(value):
        return out
    where = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
    hit = grams[np.minimum(where, len(grams) - 1)] == np.repeat(value, size)
    return np.bincount(np.repeat(np.arange(len(value)), size)[hit], minlength=len(value))


def all_pieces(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        roll = Rolling()
        for t in text_buffers(batches, "text"):
            keys = t.batch.column(0).to_numpy()
            cols: list[list] = [[], [], [], [], [], []]
            for i in np.flatnonzero(np.diff(t.offs) >= length):
                got = pieces_of(t.data[t.offs[i] : t.offs[i + 1]], length, roll)
                cols[0].append(np.full(len(got[0]), keys[i]))
                for c, x in zip(cols[1:], got, strict=True):
                    c.append(x)
            if cols[0]:
                row, name, digest, start, starts, inner = map(np.concatenate, cols)
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(name.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(start.astype(np.int64)), pa.array(starts.astype(np.int64)), pa.array(inner)], names=["row", "name", "digest", "start", "starts", "inner"])

    return docs.select("row", "text").mapInArrow(run, "row long, name long, digest long, start long, starts long, inner boolean")


def piece_texts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(name, digest, spread, starts, piece) for (row, name, digest, spread, start, starts): the bytes of each piece."""
    per_row = wanted.groupBy("row").agg(F.collect_list(F.struct("start", "starts", "name", "digest", "spread")).alias("cuts"))
    rows = docs.select("row", "text")

    def run(batches):
        import pyarrow as pa

        for t in text_buffers(batches, "text"):
            cuts = t.batch.column(2)
            flat = cuts.flatten()
            count = np.diff(np.asarray(cuts.offsets))
            start, starts = (np.asarray(flat.field(k)) for k in (0, 1))
            base = np.repeat(t.offs[:-1], count) + start
            data = [t.data[a : a + n + length - 1].tobytes() for a, n in zip(base, starts, strict=True)]
            yield pa.RecordBatch.from_arrays([flat.field(2), flat.field(3), flat.field(4), flat.field(1), pa.array(data, pa.binary())], names=["name", "digest", "spread", "starts", "piece"])

    return rows.join(per_row, "row").select("row", "text", "cuts").mapInArrow(run, "name long, digest long, spread int, starts long, piece binary")


def runs_of(flags: np.ndarray) -> list[dict]:
    """First and last index of each run of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [{"lo": int(a), "hi": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]


RUNS = "array<struct<lo:long,hi:long>>"


def shard_repeats(pieces: DataFrame, length: int) -> DataFrame:
    """(name, digest, spread, part, runs, open): the starts that repeat inside the piece's shard. For names that
    are spread, open has a hash of each string, start by start."""

    def run(shard):
        import pyarrow as pa

        raw = shard.column("piece").combine_chunks()
        n = shard.num_rows
        texts = [np.frombuffer(raw[i].as_buffer(), np.uint8) for i in range(n)]
        starts = shard.column("starts").to_numpy()
        size = np.array([len(x) for x in texts])
        first = np.cumsum(size) - size
        every = np.repeat(first - np.cumsum(starts) + starts, starts) + np.arange(starts.sum())
        text = np.concatenate(texts)
        again = repeated(text, every, length)
        cut = np.cumsum(starts)
        spread = shard.column("spread").to_numpy()
        roll = Rolling()
        hashes = [roll.all(roll.sums(x), length).tobytes() if s > 1 else None for x, s in zip(texts, spread, strict=True)]
        runs = [runs_of(again[b - k : b]) for b, k in zip(cut, starts, strict=True)]
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        return pa.table({"name": shard.column("name"), "digest": shard.column("digest"), "spread": shard.column("spread"), "part": shard.column("part"), "runs": pa.array(runs, kind), "open": pa.array(hashes, pa.binary())})

    return pieces.groupBy("shard", "part").applyInArrow(run, f"name long, digest long, spread int, part int, runs {RUNS}, open binary")


def across_shards(found: DataFrame) -> DataFrame:
    """(name, digest, runs) for names that are spread: starts whose strings stand in two shards or more.

    The strings of each piece are dealt over as many ranges of hashes as the name has shards; a range from all
    shards comes together, and each shard's sorted list is looked up in the others by binary search. What is shared goes
    back to the pieces that have strings in the range, and to no others."""

    def deal(batches):
        import pyarrow as pa

        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for k in range(b.num_rows):
                h, ranges = np.frombuffer(b.column(4)[k].as_py(), np.uint64), b.column(1)[k].as_py()
                where = np.minimum((h / 2.0**64 * ranges).astype(np.int64), ranges - 1)
                order = np.lexsort((h, where))
                edge = np.flatnonzero(np.diff(where[order])) + 1
                for at in np.split(order, edge):
                    for c, x in zip(out, (b.column(0)[k].as_py(), int(where[at[0]]), b.column(2)[k].as_py(), b.column(3)[k].as_py(), h[at].tobytes(), at.astype(np.int32).tobytes()), strict=True):
                        c.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["name", "range", "part", "digest", "strings", "places"])

    def merge(t):
        import pyarrow as pa

        part = t.column("part").to_numpy()
        lists = [np.frombuffer(x, np.uint64) for x in t.column("strings").to_pylist()]
        by_part = [np.unique(np.concatenate([lists[i] for i in np.flatnonzero(part == p)])) for p in np.unique(part)]
        # lists are merged two by two, and what one finds in the other is kept
        shared = []
        while len(by_part) > 1:
            a, b = by_part.pop(0), by_part.pop(0)
            at = np.searchsorted(a, b)
            hit = a[np.minimum(at, len(a) - 1)] == b
            shared.append(b[hit])
            by_part.append(np.insert(a, at[~hit], b[~hit]))
        got = np.unique(np.concatenate(shared)) if shared else np.zeros(0, np.uint64)
        return pa.table({"name": pa.array([t.column("name")[0].as_py()]), "range": pa.array([t.column("range")[0].as_py()], pa.int32()), "shared": pa.array([got.tobytes()], pa.binary())})

    def mark(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        for b in batches:
            runs = []
            for k in range(b.num_rows):
                h, s = np.frombuffer(b.column(2)[k].as_py(), np.uint64), np.frombuffer(b.column(4)[k].as_py(), np.uint64)
                hit = s[np.minimum(np.searchsorted(s, h), len(s) - 1)] == h
                runs.append([{"lo": int(x), "hi": int(x)} for x in np.frombuffer(b.column(3)[k].as_py(), np.int32)[hit]])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(runs, kind)], names=["name", "digest", "runs"])

    spread = found.where("spread > 1").select("name", "spread", "part", "digest", "open")
    lists = materialize(spread.mapInArrow(deal, "name long, range int, part int, digest long, strings binary, places binary"), "lists")
    shared = materialize(lists.select("name", "range", "part", "strings").groupBy("name", "range").applyInArrow(merge, "name long, range int, shared binary").where("length(shared) > 0"), "shared")
    pairs = lists.join(shared, ["name", "range"]).select("name", "digest", "strings", "places", "shared")
    return pairs.mapInArrow(mark, f"name long, digest long, runs {RUNS}").where(F.size("runs") > 0)


def repeat_runs(docs: DataFrame, length: int, shard_bytes: int = SHARD_BYTES, spread: int = SPREAD) -> DataFrame:
    """(row, runs): of each row with repeats, the runs of starts of strings that start elsewhere too."""
    pieces = materialize(all_pieces(docs, length), "pieces")
    kinds = materialize(pieces.groupBy("name", "digest").agg(F.count("*").alias("n"), F.max("inner").alias("inner"), F.min(F.struct("row", "start")).alias("at"), F.first("starts").alias("starts")), "kinds")
    names = kinds.groupBy("name").agg(F.count("*").alias("m"), F.max("inner").alias("any_inner"), F.sum(F.col("starts") + length - 1).alias("size"))
    names = materialize(names.where("m > 1 OR any_inner").select("name", "m", "size"), "names")
    total = names.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-int(total) // shard_bytes))
    parts = F.ceil(F.greatest(F.col("m") / spread, F.col("size") / shard_bytes)).cast("int")
    wanted = kinds.join(names.withColumn("spread", parts), "name").select(F.col("at.row").alias("row"), F.col("at.start").alias("start"), "starts", "name", "digest", "spread")
    texts = piece_texts(docs, wanted, length)
    texts = texts.withColumn("shard", F.pmod(F.hash("name"), F.lit(shards))).withColumn("part", F.pmod(F.hash("digest"), F.col("spread")).cast("int"))
    # a spread name has shards of its own
    texts = texts.withColumn("shard", F.when(F.col("spread") > 1, F.col("name")).otherwise(F.col("shard").cast("long")))
    found = materialize(shard_repeats(texts, length), "shard_repeats")
    parts_ = found.where(F.size("runs") > 0).select("name", "digest", "runs")
    if not found.where("spread > 1").isEmpty():
        parts_ = parts_.unionByName(across_shards(found))
    whole = kinds.where("n > 1").select("name", "digest", F.array(F.struct(F.lit(0).cast("long").alias("lo"), (F.col("starts") - 1).alias("hi"))).alias("runs"))
    marks = materialize(parts_.unionByName(whole).groupBy("name", "digest").agg(F.flatten(F.collect_list("runs")).alias("runs")), "marks")
    hits = pieces.select("row", "start", "name", "digest").join(marks, ["name", "digest"])
    moved = F.transform("runs", lambda r: F.struct((r.lo + F.col("start")).alias("lo"), (r.hi + F.col("start")).alias("hi")))
    return hits.select("row", moved.alias("runs")).groupBy("row").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def stretch_runs(docs: DataFrame, words: int, length: int) -> DataFrame:
    """(row, runs): the stretches of ``words`` words in fewer than ``length`` bytes that stand elsewhere too, by
    64-bit hashes: in another row, or in the same without overlap. A run's hi is where the stretch ends, less
    ``length``."""

    def run(batches):
        import pyarrow as pa

        roll, letter = Rolling(), np.ones(256, bool)
        letter[[9, 10, 11, 12, 13, 32]] = False
        for t in text_buffers(batches, "text"):
            keys = t.batch.column(0).to_numpy()
            for i in np.flatnonzero(np.diff(t.offs) >= 2 * words - 1):
                b = t.data[t.offs[i] : t.offs[i + 1]]
                edge = np.diff(np.concatenate(([False], letter[b], [False])).astype(np.int8))
                lo, hi = np.flatnonzero(edge == 1)[: -words + 1 or None], np.flatnonzero(edge == -1)[words - 1 :]
                some = hi - lo < length if len(hi) else np.zeros(0, bool)
                if some.any():
                    lo, hi = lo[some], hi[some]
                    h = roll.spans(roll.sums(b), lo, hi)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lo), keys[i])), pa.array(h.view(np.int64)), pa.array(lo), pa.array(hi - length)], names=["row", "hash", "lo", "hi"])

    found = materialize(docs.select("row", "text").mapInArrow(run, "row long, hash long, lo long, hi long"), "stretches")
    at = found.groupBy("hash", "row", "lo").agg(F.count("*").alias("n"), F.first("hi").alias("hi"))
    again = at.groupBy("hash").agg(F.min("row").alias("a"), F.max("row").alias("b"), F.max("n").alias("n"), F.max("lo").alias("last"), (F.min("hi") + length).alias("end"))
    again = again.where("a < b OR n > 1 OR last >= end").select("hash")
    # a stretch that very many rows hold lies in SALTS tasks
    again = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = found.withColumn("salt", F.pmod(F.xxhash64("row", "lo"), F.lit(SALTS)).cast("int"))
    return found.join(again, ["hash", "salt"]).groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))


class Passages:
    """Runs of ``words`` words of the texts in a buffer, named by the smallest hash among their grams."""

    def __init__(self, words: int):
        self.words, self.gram, self.roll = words, min(PASSAGE_GRAM, words), Rolling()
        self.letter = np.ones(256, bool)
        self.letter[[9, 10, 11, 12, 13, 32]] = False

    def read(self, data: np.ndarray, offs: np.ndarray):
        """(name of each passage, hash sums of words, where each text's words and passages begin)."""
        first = np.zeros(len(data) + 1, bool)
        first[offs] = True
        inside = self.letter[data]
        lo = np.flatnonzero(inside & (first[:-1] | ~np.concatenate(([False], inside[:-1])))) if len(data) else np.zeros(0, np.int64)
        hi = np.flatnonzero(inside & (first[1:] | ~np.append(inside[1:], False))) + 1 if len(data) else lo
        word = self.roll.spans(self.roll.sums(data), lo, hi)
        self.roll.grow(len(word))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(word * self.roll.power[: len(word)], dtype=np.uint64)))
        at = np.searchsorted(lo, offs)
        if len(word) < self.words:
            return np.zeros(0, np.uint64), sums, at
        return sliding_min(self.roll.all(sums, self.gram), self.words - self.gram + 1), sums, at

    def pieces(self, data, offs):
        """(text, name, digest, first word, passages, whether its gram may stand in it twice) of each piece."""
        name, sums, at = self.read(data, offs)
        n = np.maximum(np.diff(at) - self.words + 1, 0)
        place = np.repeat(at[:-1], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        text = np.repeat(np.arange(len(n)), n)
        if not len(place):
            return (np.zeros(0, np.int64),) * 6
        name = name[place]
        start = cut_runs(np.concatenate(([0], np.flatnonzero((name[1:] != name[:-1]) | (text[1:] != text[:-1])) + 1)), len(name))
        size = np.diff(np.append(start, len(name)))
        digest = self.roll.spans(sums, place[start], place[start] + size - 1 + self.words)
        return text[start], name[start], digest, place[start] - at[text[start]], size, size > self.words - self.gram + 1


def passage_rows(docs: DataFrame, words: int = PASSAGE_WORDS) -> DataFrame:
    """(row): the rows of ``docs`` (row, text) with a passage of ``words`` words that stands elsewhere too, in another row
    or, without overlap, in the same; white space between words may differ. By 64-bit hashes of words and passages.

    As with bytes, passages are named by their smallest gram, so that equal ones have equal names; pieces that are the
    same as a whole repeat as a whole, and only single pieces that share a name are looked through passage by passage."""

    def cut(batches):
        import pyarrow as pa

        known = Passages(words)
        for t in text_buffers(batches, "text"):
            text, name, digest, start, size, twice = known.pieces(t.data, t.offs)
            keys = t.batch.column(0).take(pa.array(text))
            yield pa.RecordBatch.from_arrays([keys, pa.array(name.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(start), pa.array(size), pa.array(twice.astype(bool))], names=["row", "name", "digest", "start", "size", "twice"])

    def each(batches):
        import pyarrow as pa

        known = Passages(words)
        for t in text_buffers(batches, "text", 1 << 20):
            _, sums, at = known.read(t.data, t.offs)
            cuts = t.batch.column(2)
            flat, count = cuts.flatten(), np.diff(np.asarray(cuts.offsets))
            start, size = (np.asarray(flat.field(k)) for k in (0, 1))
            base = np.repeat(at[:-1], count) + start
            piece = np.repeat(np.arange(len(start)), size)
            place = np.arange(len(piece)) - np.repeat(np.cumsum(size) - size, size)
            h = known.roll.spans(sums, base[piece] + place, base[piece] + place + words)
            # a passage that stands in its piece twice, without overlap
            order = np.lexsort((place, h, piece))
            same = (h[order][1:] == h[order][:-1]) & (piece[order][1:] == piece[order][:-1])
            run = np.concatenate(([0], np.cumsum(~same))) if len(order) else np.zeros(0, np.int64)
            head = np.flatnonzero(np.concatenate(([True], ~same))) if len(order) else run
            last = np.append(head[1:], len(order)) - 1 if len(order) else run
            inner = place[order][last] - place[order][head] >= words
            keep = order[head]
            yield pa.RecordBatch.from_arrays([flat.field(2).take(pa.array(piece[keep])), pa.array(h[keep].view(np.int64)), pa.array(inner)], names=["piece", "hash", "inner"])

    pieces = materialize(docs.select("row", "text").mapInArrow(cut, "row long, name long, digest long, start long, size long, twice boolean"), "passages")
    kinds = pieces.groupBy("name", "digest").agg(F.count("*").alias("n"), F.max("twice").alias("twice"), F.min(F.struct("row", "start")).alias("at"), F.first("size").alias("size"))
    kinds = materialize(kinds, "passage_kinds")
    names = kinds.groupBy("name").agg(F.count("*").alias("m"), F.max("twice").alias("twice")).where("m > 1 OR twice").select("name")
    wanted = kinds.join(names, "name", "left_semi").select(F.col("at.row").alias("row"), F.col("at.start").alias("start"), "size", F.xxhash64("name", "digest").alias("piece"))
    per_row = wanted.groupBy("row").agg(F.collect_list(F.struct("start", "size", "piece")).alias("cuts"))
    full = docs.select("row", "text").join(per_row, "row")
    whole = W.partitionBy("hash")
    found = full.mapInArrow(each, "piece long, hash long, inner boolean")
    found = found.withColumns({"a": F.min("piece").over(whole), "b": F.max("piece").over(whole), "again": F.max("inner").over(whole)}).where("a < b OR again")
    marked = found.select("piece").union(kinds.where("n > 1").select(F.xxhash64("name", "digest"))).distinct()
    rows = pieces.select("row", F.xxhash64("name", "digest").alias("piece")).join(marked, "piece", "left_semi").select("row").distinct()
    rows = materialize(rows, "passage_rows")
    discard(pieces, kinds)
    return rows


def spans_of(lo: np.ndarray, hi: np.ndarray, length: int, size: int) -> np.ndarray:
    """Which of ``size`` bytes lie in a string of ``length`` bytes that starts in one of the runs."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi + length, -1)
    return np.cumsum(edge[:size]) > 0


FIELDS = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "repeated": "int"}


def remove_repeats(docs: DataFrame, length: int = 400, rewrite: bool = False, shard_bytes: int = SHARD_BYTES, spread: int = SPREAD, words: int | None = None, passages: int | None = None) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) with the bytes removed that lie in a string of ``length`` bytes which
    starts anywhere else; all copies go, strings are judged on the input, matches never cross documents.
    With ``words``, stretches of so many words that are shorter than ``length`` go likewise.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and repeated (1 if bytes went or, with ``passages``, if so
    many words in a row stand elsewhere, which changes nothing else); with ``rewrite`` all columns as they were and the
    rest of the text, a character going if one of its bytes does. Null texts count as empty (with ``rewrite``
    they stay null), null ids are as good as others, rows that repeat id and text are copies of each other,
    an empty table gives an empty one. Equality of pieces is by 64-bit hashes, of strings in a shard by bytes.
    """
    key = F.xxhash64("doc_id", "text")
    rows = docs.select(key.alias("row"), "text")
    again = passage_rows(rows, passages) if passages else None
    runs = repeat_runs(rows, length, shard_bytes, spread)
    if words:
        runs = runs.unionByName(stretch_runs(rows, words, length)).groupBy("row").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    runs = runs.select(F.col("row").alias("__row"), F.col("runs").alias("__runs"))
    if passages:
        runs = runs.join(again.select(F.col("row").alias("__row"), F.lit(True).alias("__again")), "__row", "full")
    else:
        runs = runs.withColumn("__again", F.lit(False))
    rest = [c for c in docs.columns if c != "text"] if rewrite else ["doc_id"]
    full = docs.withColumn("__row", key).join(runs, "__row", "left").select("text", "__runs", F.coalesce("__again", F.lit(False)).alias("__again"), *rest)
    columns = docs.columns

    def run(batches):
        import pyarrow as pa

        for t in text_buffers(batches, "text"):
            runs_, again = t.batch.column(1), t.batch.column(2)
            out: list[list] = [[], [], [], [], []]
            texts = []
            for i in range(len(t)):
                b = t.data[t.offs[i] : t.offs[i + 1]]
                gone = None
                if runs_[i].is_valid:
                    pair = runs_[i].values
                    gone = spans_of(np.asarray(pair.field(0)), np.asarray(pair.field(1)), length, len(b))
                if rewrite:
                    if gone is not None:
                        # characters begin at bytes that are not 10xxxxxx
                        char = np.cumsum((b & 0xC0) != 0x80) - 1
                        lost = np.bincount(char, gone, minlength=1) > 0
                        b = b[~lost[char]]
                    texts.append(None if t.nulls[i] else b.tobytes().decode("utf-8", "replace"))
                else:
                    kept = b if gone is None else b[~gone]
                    out[0].append(len(b))
                    out[1].append(len(b) - len(kept))
                    out[2].append(0 if gone is None else int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])))
                    out[3].append(hashlib.sha256(kept.tobytes()).hexdigest())
                    out[4].append(int(again[i].as_py() or len(kept) < len(b)))
            others = [t.batch.column(3 + k) for k in range(len(rest))]
            if rewrite:
                cols = dict(zip(rest, others, strict=True)) | {"text": pa.array(texts, pa.string())}
                yield pa.RecordBatch.from_arrays([cols[c] for c in columns], names=columns)
            else:
                yield pa.RecordBatch.from_arrays([*others, *(pa.array(x, kind) for x, kind in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32()), strict=True))], names=["doc_id", *FIELDS])

    schema = docs.schema if rewrite else f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{k} {v}" for k, v in FIELDS.items())
    return full.mapInArrow(run, schema)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and ``repeated``: 1 if bytes went or a passage of PASSAGE_WORDS words stands elsewhere."""
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 400, passages=PASSAGE_WORDS)
