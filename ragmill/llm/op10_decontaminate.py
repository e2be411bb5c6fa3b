"""Benchmark decontamination by latent semantic retrieval.

Passages of all documents are weighted by TF-IDF over hashed words; a randomised sketch of the passage matrix,
summed over the cluster, gives its leading right singular vectors (Nystroem: one pass suffices). Document windows
that hold enough words of a part of a benchmark item and are no strangers to it by latent cosine are candidates;
the longest common subsequence of words, and for doubtful ones the item's answer, its closing words, decide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.llm.common import table, text_buffers
from ragmill.llm.op3_suffix import Rolling

BITS = 15
VOCABULARY = 1 << BITS
RANK = 28
#: Leading singular vectors that are left out: they tell languages and the commonest words, not passages.
COMMON = 4
STEP = 8  # words; windows are two or three steps long, for items below or from LONG words
WIDTH = 3 * STEP
LONG = 32
#: Least latent cosine of a candidate; least share of an item's words in order that is a leak as such, or with the answer.
COSINE, SURE, DOUBTFUL, ANSWER = 0.0, 0.75, 0.5, 0.6
#: Least share of a part's words that a candidate window must hold.
HOLD = 0.35
#: Buckets that count as one where words are only bounded.
FOLD = 8
ITEMS_AT_ONCE = 1600
BLOCKS = 32  # pieces in which sketches are summed
OFTEN = 64  # places of a bucket that are added one by one


class Vocabulary:
    """Buckets of the words in a byte buffer: hashes from prefix sums over the lower-cased bytes."""

    def __init__(self):
        self.roll = Rolling()
        byte = np.arange(256, dtype=np.uint8)
        upper = (byte >= 65) & (byte <= 90)
        self.roll.symbol = self.roll.symbol[np.where(upper, byte + 32, byte)]
        self.letter = np.ones(256, bool)
        self.letter[[9, 10, 11, 12, 13, 32]] = False

    def buckets(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all words, and where the words of each text begin (and end). Words end with their text."""
        n = len(data)
        inside = self.letter[data]
        first = np.zeros(n + 1, bool)
        first[offs] = True
        start = np.flatnonzero(inside & (first[:-1] | ~np.concatenate(([False], inside[:-1])))) if n else np.zeros(0, np.int64)
        end = np.flatnonzero(inside & (first[1:] | ~np.append(inside[1:], False))) + 1 if n else start
        h = self.roll.spans(self.roll.sums(data), start, end)
        return (h >> np.uint64(64 - BITS)).astype(np.uint16), np.searchsorted(start, offs)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def cuts(offs: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of ``step`` words that do not cross texts, and each run's text."""
    n = -(-np.diff(offs) // step)
    doc = np.repeat(np.arange(len(n)), n)
    return np.repeat(offs[:-1], n) + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * step, doc


def passage_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many passages of all documents each bucket stands, and how many passages there are. Both are of a fixed
    size, summed on the cluster."""

    def run(batches):
        import pyarrow as pa

        known, df = Vocabulary(), np.zeros(VOCABULARY + 1, np.int64)
        for t in text_buffers(batches, "text"):
            ids, offs = known.buckets(t.data, t.offs)
            start, _ = cuts(offs, WIDTH)
            df[-1] += len(start)
            for lo in range(0, len(start), VOCABULARY):  # passage and bucket fit in 32 bits
                some = np.append(start[lo : lo + VOCABULARY + 1], len(ids))[: VOCABULARY + 1]
                passage = np.repeat(np.arange(len(some) - 1, dtype=np.uint32), np.diff(some))
                pair = np.sort(passage * np.uint32(VOCABULARY) + ids[some[0] : some[-1]])
                pair = pair[np.concatenate(([True], pair[1:] != pair[:-1]))]
                df[:-1] += np.bincount(pair % np.uint32(VOCABULARY), minlength=VOCABULARY)
        some = np.flatnonzero(df)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], names=["bucket", "n"])

    got = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(VOCABULARY + 1, np.int64)
    for r in got:
        df[r.bucket] = r.n
    return df[:-1], int(df[-1])


def summed(rows: np.ndarray, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The sum of the rows that each run of ``ids`` names; runs begin at ``start`` and have at most WIDTH ids. The last of
    ``rows`` is zero."""
    out = np.zeros((len(start), rows.shape[1]), rows.dtype)
    size = np.diff(np.append(start, len(ids)))
    for k in range(WIDTH):
        out += rows.take(np.where(k < size, ids.take(start + k, mode="clip"), len(rows) - 1), axis=0)
    return out


def scattered(y: np.ndarray, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, rows): for each bucket of ``ids`` the sum of ``y`` over the runs it stands in, once for each time.

    A bucket's first OFTEN places are added one after the other, for all buckets at once; what is left is of few buckets
    and is a dense product."""
    run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(ids))))
    order = np.argsort(ids, kind="stable")
    there, run = ids[order], run[order]
    head = np.flatnonzero(np.concatenate(([True], there[1:] != there[:-1])))
    size = np.diff(np.append(head, len(there)))
    common_first = np.argsort(-size, kind="stable")
    head, size = head[common_first], size[common_first]
    out = np.zeros((len(head), y.shape[1]), y.dtype)
    for k in range(min(OFTEN, int(size[0]))):
        m = np.searchsorted(-size, -k, side="left")
        out[:m] += y.take(run[head[:m] + k], axis=0)
    many = int(np.searchsorted(-size, -OFTEN, side="left"))
    wide = max(1, (1 << 20) // len(y))  # so many counts at a time
    for lo in range(0, many, wide):
        more = size[lo : min(lo + wide, many)] - OFTEN
        column = np.repeat(np.arange(len(more)), more)
        place = np.repeat(head[lo : lo + len(more)] + OFTEN - np.cumsum(more) + more, more) + np.arange(len(column))
        count = np.bincount(column * len(y) + run[place], minlength=len(more) * len(y)).reshape(len(more), len(y))
        out[lo : lo + len(more)] += count.astype(y.dtype) @ y
    return there[head], out


def sketch(docs: DataFrame, idf: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """A'A omega for the passages' normalised TF-IDF matrix A, summed in BLOCKS pieces on the cluster."""

    def run(batches):
        import pyarrow as pa

        known, out = Vocabulary(), np.zeros((VOCABULARY, omega.shape[1]))
        weighted, square = (np.vstack((idf[:, None] * omega, np.zeros(omega.shape[1])))).astype(np.float32), (idf * idf).astype(np.float32)
        for t in text_buffers(batches, "text", 1 << 20):
            ids, offs = known.buckets(t.data, t.offs)
            start, _ = cuts(offs, WIDTH)
            if not len(ids):
                continue
            y = summed(weighted, ids, start)
            y /= np.maximum(np.add.reduceat(square[ids], start), 1e-6)[:, None]
            bucket, part = scattered(y, ids, start)
            out[bucket] += part
        out *= idf[:, None]
        if out.any():
            size = VOCABULARY // BLOCKS
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array([out[k * size : (k + 1) * size].astype(np.float32).tobytes() for k in range(BLOCKS)], pa.binary())], names=["block", "part"])

    def add(t):
        import pyarrow as pa

        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in t.column("part").to_pylist())
        return pa.table({"block": pa.array([t.column("block")[0].as_py()], pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})

    # partial sums by task number first: no task adds more than a square root of them
    parts = docs.select("text").mapInArrow(run, "block int, part binary").withColumn("half", F.pmod(F.spark_partition_id(), F.lit(16)))
    halves = parts.groupBy("block", "half").applyInArrow(lambda t: _as_float(add(t)), "block int, part binary")
    got = halves.groupBy("block").applyInArrow(add, "block int, part binary").collect()
    y = np.zeros((BLOCKS, VOCABULARY // BLOCKS, omega.shape[1]))
    for r in got:
        y[r.block] = np.frombuffer(r.part, np.float64).reshape(y.shape[1:])
    return y.reshape(VOCABULARY, -1)


def _as_float(t):
    import pyarrow as pa

    part = np.frombuffer(t.column("part")[0].as_py(), np.float64).astype(np.float32).tobytes()
    return pa.table({"block": t.column("block"), "part": pa.array([part], pa.binary())})


@dataclass
class Space:
    """term: latent vector of each bucket, its idf within."""

    term: np.ndarray


def fit_sample(docs: DataFrame, most: int | None = None) -> DataFrame:
    """The rows that singular vectors are fitted on: all of them. Only a caller that gives ``most`` gets fewer, the rows whose
    ids hash lowest, so many of them expected."""
    if most is None:
        return docs
    part = min(1.0, most / max(1, docs.count()))
    return docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(part * (1 << 20)))


def fit(docs: DataFrame, rank: int = RANK, seed: int = 3) -> Space:
    """The latent space of the passages of ``docs``; without any, one of a random projection. Document frequencies
    and singular vectors are of all passages, every passage is searched, and the tests measure recall against brute force."""
    df, n = passage_counts(docs)
    idf = np.log((n + 1) / (df + 1)) + 0.1
    omega = np.random.default_rng(seed).normal(size=(VOCABULARY, COMMON + rank + 6))
    if not n:
        return Space((idf[:, None] * omega[:, :rank]).astype(np.float32))
    y = sketch(fit_sample(docs), idf, omega)
    # Nystroem: A'A is about y (omega' y)^-1 y'
    shift = 1e-6 * np.linalg.norm(y)
    y = y + shift * omega
    w, v = np.linalg.eigh((omega.T @ y + y.T @ omega) / 2)
    keep = w > 1e-9 * w.max()
    u, size, _ = np.linalg.svd(y @ v[:, keep] / np.sqrt(w[keep]), full_matrices=False)
    u = u / np.maximum(size, 1e-9 * size.max())  # each direction counts alike
    return Space((idf[:, None] * u[:, COMMON : COMMON + rank]).astype(np.float32))


class Item:
    __slots__ = ("answer", "answer_from", "id", "masks", "n", "words")

    def __init__(self, item_id, words: list[bytes]):
        self.id, self.words, self.n = item_id, words, len(words)
        self.answer_from = self.n - max(3, self.n // 4)
        self.masks = masks(words)
        self.answer = masks(words[max(0, self.answer_from) :])


def masks(words: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def common(mask: dict[bytes, int], n: int, text: list[bytes]) -> int:
    """Longest common subsequence with ``text``, all rows of the table in one number."""
    full = (1 << n) - 1
    v = full
    for w in text:
        m = mask.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def judge(item: Item, text: list[bytes]) -> tuple[float, bool] | None:
    """(share of the item's words in order, whether the answer is there), if that is a leak.

    Very short items must stand there as a whole."""
    share = common(item.masks, item.n, text) / item.n
    if share < (DOUBTFUL if item.n >= 8 else 1.0):
        return None
    size = item.n - max(0, item.answer_from)
    answered = common(item.answer, size, text) >= ANSWER * size
    return (share, answered) if share >= SURE or answered else None


def latent(ids: np.ndarray, offs: np.ndarray, space: Space, steps=(2, 3)) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each number of steps: unit vectors of windows so long, their texts, and where they begin (in words of the
    chunk)."""
    start, doc = cuts(offs, STEP)
    if not len(start):
        return [(np.zeros((0, space.term.shape[1]), np.float32), doc, start) for _ in steps]
    x = np.empty((len(start), space.term.shape[1]), np.float32)
    ends = np.append(start[1:], len(ids))
    for lo in range(0, len(start), 2048):  # so many gathered rows as stay in the cache
        some = start[lo : lo + 2048]
        x[lo : lo + 2048] = np.add.reduceat(space.term[ids[some[0] : ends[lo + len(some) - 1]]], some - some[0], axis=0)
    z, out = x.copy(), []
    new = np.concatenate(([True], doc[1:] != doc[:-1]))
    for k in range(1, max(steps)):
        same = np.flatnonzero(doc[k:] == doc[:-k])
        z[same] += x[k:][same]
        if k + 1 in steps:
            # a window must be whole, or the first of its text
            whole = new.copy()
            whole[same] = True
            unit = z[whole]
            norm = np.sqrt(np.einsum("ij,ij->i", unit, unit))
            out.append((unit / np.maximum(norm, 1e-9)[:, None], doc[whole], start[whole]))
    return out


def bucket_masks(items: list[Item], known: Vocabulary) -> np.ndarray:
    """``masks`` of each item of up to 64 words by folded bucket, as one row; a last bucket stands for no word."""
    out = np.zeros((len(items), VOCABULARY // FOLD + 1), np.uint64)
    for k, item in enumerate(items):
        if item.n <= 64:
            raw = np.frombuffer(b" ".join(item.words), np.uint8)
            ids = known.buckets(raw, np.array([0, len(raw)]))[0] // FOLD
            np.bitwise_or.at(out[k], ids, np.uint64(1) << np.arange(item.n, dtype=np.uint64))
    return out


def most_common(table: np.ndarray, sizes: np.ndarray, k: np.ndarray, folded: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """At least ``common`` of items ``k`` with the words from ``lo`` to ``hi``, for all pairs at once; words of one
    folded bucket count as equal. Items of more than 64 words get their size."""
    none = table.shape[1] - 1
    v, row, flat = np.full(len(k), np.uint64(2**64 - 1)), k * table.shape[1], table.ravel()
    for step in range(int((hi - lo).max(initial=0))):
        at = lo + step
        u = v & flat.take(row + np.where(at < hi, folded.take(at, mode="clip"), none))
        v = (v + u) | (v - u)
    n = sizes[k]
    full = np.uint64(2**64 - 1) >> (64 - np.minimum(n, 64)).astype(np.uint64)
    return np.where(n <= 64, n - np.bitwise_count(v & full), n)


def find_leaks(docs: DataFrame, items: list[tuple[int, str]], space: Space) -> DataFrame:
    """(doc_id, item_id, share, answered) of a bounded block of items against all documents."""
    given = [(i, x) for i, x in items if x and words_of(x.encode())]

    def run(batches):
        import pyarrow as pa

        known = Vocabulary()
        all_items = [Item(i, words_of(x.encode("utf-8", "replace"))) for i, x in given]
        queries, none = [], VOCABULARY // FOLD
        by_bucket = bucket_masks(all_items, known)
        sizes = np.array([item.n for item in all_items])
        enough = np.where(sizes >= 8, DOUBTFUL, 1.0) * sizes
        for steps in (2, 3):
            width, parts, part_item, part_size, bags = steps * STEP, [], [], [], []
            for k, item in enumerate(all_items):
                if (item.n < LONG) != (steps == 2):
                    continue
                raw = np.frombuffer(b" ".join(item.words), np.uint8)
                ids = known.buckets(raw, np.array([0, len(raw)]))[0]
                for at in sorted({*range(0, max(1, item.n - width + 1), STEP), max(0, item.n - width)}):
                    part = ids[at : at + width]
                    parts.append(space.term[part].sum(axis=0))
                    part_item.append(k)
                    part_size.append(len(part))
                    bags.append((np.bincount(part // FOLD, minlength=none + 1) > 0).astype(np.uint8))
            if parts:
                q = np.stack(parts)
                q /= np.maximum(np.sqrt((q * q).sum(axis=1)), 1e-9)[:, None]
                least = np.ceil(HOLD * np.array(part_size) - 1e-9).astype(np.uint8)
                queries.append((steps, q, np.array(part_item), least, np.ascontiguousarray(np.stack(bags, axis=1))))
        for t in text_buffers(batches, "text", 1 << 20):
            ids, offs = known.buckets(t.data, t.offs)
            lists: dict[int, list[bytes]] = {}
            windows = latent(ids, offs, space)
            found: dict[tuple[int, int], tuple[float, bool]] = {}
            folded = (ids // FOLD).astype(np.int64)
            # words of each step; a step ends with its text
            step, step_doc = cuts(offs, STEP)
            word = step[:, None] + np.arange(STEP)
            word = np.where(word < offs[step_doc + 1][:, None], np.append(folded, none).take(word, mode="clip"), none).T
            step_doc = np.append(step_doc, np.full(WIDTH // STEP, -1))
            for steps, q, part_item, least, bags in queries:
                (z, doc, start), width = windows[steps - 2], steps * STEP
                first = np.searchsorted(step, start)
                rows = max(16, (1 << 18) // len(q))  # so many counts as stay in the cache
                for lo in range(0, len(z), rows):
                    # words of a part that a window holds, counted with repeats
                    at = first[lo : lo + rows]
                    some = word[:, at[0] : at[-1] + steps]
                    count = np.zeros((some.shape[1] + 1, len(q)), np.uint8)
                    for row in some:
                        count[:-1] += bags.take(row, axis=0)
                    hold = count[at - at[0]]
                    for k in range(1, steps):
                        hold += count[np.where(step_doc[at + k] == step_doc[at], at - at[0] + k, len(count) - 1)]
                    i, j = np.divmod(np.flatnonzero(hold >= least), len(q))
                    i += lo
                    near = np.einsum("ij,ij->i", z[i], q[j]) >= COSINE
                    i, k = np.divmod(np.unique(i[near] * len(all_items) + part_item[j[near]]), len(all_items))
                    # the common subsequence, if all words of a bucket were one, bounds it
                    most = most_common(by_bucket, sizes, k, folded, np.maximum(offs[doc[i]], start[i] - sizes[k]), np.minimum(offs[doc[i] + 1], start[i] + width + sizes[k]))
                    ok = most >= enough[k]
                    for w, k in zip(i[ok].tolist(), k[ok].tolist(), strict=True):
                        d, item = int(doc[w]), all_items[k]
                        if found.get((d, k), (0, False))[0] == 1.0:
                            continue
                        if d not in lists:
                            lists[d] = words_of(t.raw(d))
                        at = int(start[w] - offs[d])
                        got = judge(item, lists[d][max(0, at - item.n) : at + width + item.n])
                        if got and got > found.get((d, k), (0.0, False)):
                            found[d, k] = got
            if found:
                keys = sorted(found)
                yield pa.RecordBatch.from_arrays(
                    [t.batch.column(0).take(pa.array([d for d, _ in keys])), pa.array([all_items[k].id for _, k in keys], pa.int64()), pa.array([round(found[x][0], 4) for x in keys]), pa.array([found[x][1] for x in keys])],
                    names=["doc_id", "item_id", "share", "answered"],
                )

    schema = "doc_id long, item_id long, share double, answered boolean"
    if not given:
        return docs.sparkSession.createDataFrame([], schema)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def leaks(docs: DataFrame, benchmark: DataFrame, space: Space | None = None) -> DataFrame:
    """(doc_id, item_id, share, answered) for each document in which a benchmark item stands, whole or reworded.

    All of ``benchmark`` (item_id, text) is searched, ITEMS_AT_ONCE at a time, so that what tasks hold is bounded.
    Null and empty texts and items leak nothing; rows that repeat give rows that repeat; an empty table on either
    side gives an empty one; further columns are ignored."""
    space = space or fit(docs)
    ids = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").groupBy("item_id", "text").agg(F.count("*").alias("n"))
    out, last = None, None
    while True:
        more = ids if last is None else ids.where((F.col("item_id") > last.item_id) | (F.col("item_id") == last.item_id) & (F.col("text") > last.text))
        rows = more.orderBy("item_id", "text").limit(ITEMS_AT_ONCE).collect()
        if not rows:
            break
        last = rows[-1]
        block = [(r.item_id, r.text) for r in rows for _ in range(r.n)]
        for lo in range(0, len(block), ITEMS_AT_ONCE):
            got = find_leaks(docs, block[lo : lo + ITEMS_AT_ONCE], space)
            out = got if out is None else out.unionByName(got)
    return out if out is not None else find_leaks(docs, [], space)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is none of a leak's; all columns as they were. Rows of a null id are told
    apart by a 64-bit hash of their text."""
    key = F.coalesce("doc_id", F.xxhash64("text"))
    found = leaks(docs.select(key.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("__key")).distinct()
    return docs.withColumn("__key", key).join(found, "__key", "left_anti").select(*docs.columns)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
