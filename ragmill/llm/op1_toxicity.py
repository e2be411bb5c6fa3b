"""Toxicity: logistic regression over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.llm.common import bounded_sample, discard, free_name, held_out, materialize, table, text_buffers, tidy

ORDERS = (3, 5, 7)
BITS = 18
BLOCKS, SUMS = 16, 16  # pieces in which vectors are summed, and sums of each before the last
MARKS = 1 << 26  # bits that tell ids


def grams(text: str, scratch: np.ndarray) -> np.ndarray:
    """Buckets of the distinct character n-grams of a whole text, lower-cased and set between blanks."""
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    h = c.copy()
    for n in range(2, max(ORDERS) + 1):
        if len(c) < n:
            break
        h = h[:-1] * np.uint32(0x9E3779B1) + c[n - 1 :]
        if n in ORDERS:
            g = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
            g >>= np.uint32(32 - BITS)
            # of equal buckets the one written last stays: no sorting, no clearing
            at = np.arange(len(g), dtype=np.int32)
            scratch[g] = at
            out.append(g[scratch[g] == at])
    if not out:
        return np.zeros(0, np.uint32)
    both = np.concatenate(out)
    at = np.arange(len(both), dtype=np.int32)
    scratch[both] = at
    return both[scratch[both] == at]


@dataclass
class Model:
    """weight: by bucket, the log-count ratio times what the regression learned; used: the buckets it learned from;
    bias: score without text."""

    weight: np.ndarray
    bias: float
    used: np.ndarray

    def score(self, text: str, scratch: np.ndarray) -> float:
        g = grams(text, scratch)
        z = self.bias + float(self.weight[g].sum(dtype=np.float64)) / np.sqrt(1 + np.count_nonzero(self.used[g]))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def slopes(v: np.ndarray, bias: float, toxic: np.ndarray, size: np.ndarray, cols: np.ndarray, weigh: tuple[float, float]) -> np.ndarray:
    """Of some texts, ``size`` features of ``cols`` each: loss, its slope by the bias, and by what each feature adds to a sum."""
    scale = 1 / np.sqrt(1 + size)
    z = np.bincount(np.repeat(np.arange(len(size)), size), v[cols], len(size)) * scale + bias
    weight = np.where(toxic > 0, weigh[1], weigh[0])
    err = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - toxic)
    loss = weight @ np.logaddexp(0, np.where(toxic > 0, -z, z))
    return np.concatenate(([loss, err.sum()], np.bincount(cols, np.repeat(err * scale, size), len(v))))


def minimum(f, x: np.ndarray, steps: int, least: float = 1e-3, kept: int = 10) -> np.ndarray:
    """Where the convex ``f`` (value and gradient) is least, by L-BFGS from ``x``: until the gradient is ``least`` of the first,
    or nothing falls any more."""
    value, g = f(x)
    first, pairs = np.linalg.norm(g), []
    for _ in range(steps):
        if np.linalg.norm(g) <= least * first:
            break
        d, parts = g.copy(), []
        for s, y in reversed(pairs):
            parts.append(s @ d / (s @ y))
            d -= parts[-1] * y
        d *= pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / first
        for s, y in pairs:
            d += s * (parts.pop() - y @ d / (s @ y))
        t = 1.0
        while t > 1e-6:
            there, slope = f(x - t * d)
            if there <= value - 1e-4 * t * (g @ d):
                break
            t /= 2
        else:
            break
        if (g - slope) @ d > 0:
            pairs = [*pairs[1 - kept :], (-t * d, slope - g)]
        x, value, g = x - t * d, there, slope
    return x


def telling(df1: np.ndarray, df0: np.ndarray, n1: float, n0: float, smooth: float, least_z: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-count ratio of each bucket, and whether it tells the labels apart by ``least_z`` standard errors."""
    ratio = np.log((df1 + smooth) / (n1 + 2 * smooth)) - np.log((df0 + smooth) / (n0 + 2 * smooth))
    return ratio, np.abs(ratio) / np.sqrt(1 / (df1 + smooth) + 1 / (df0 + smooth)) >= least_z


def learn(total, ratio: np.ndarray, use: np.ndarray, bias: float, l2: float, steps: int) -> Model:
    """The regression over the features of ``use``; ``total(v, bias)`` gives ``slopes`` summed over all texts."""
    r = ratio[use]

    def f(x):
        w, got = x[:-1], total(x[:-1] * r, x[-1])
        return got[0] + l2 / 2 * (w @ w), np.append(r * got[2:] + l2 * w, got[1])

    x = minimum(f, np.append(np.full(len(r), 0.02), bias), steps)
    weight = np.zeros(1 << BITS, np.float32)
    weight[use] = x[:-1] * r
    return Model(weight, float(x[-1]), use)


def constant(toxic: bool) -> Model:
    return Model(np.zeros(1 << BITS, np.float32), 40.0 if toxic else -40.0, np.zeros(1 << BITS, bool))


def fit(texts: list[str], labels: np.ndarray, smooth: float = 1.0, l2: float = 1e-4, steps: int = 200, least_z: float = 3.0, share: float = 0.25) -> Model:
    """Binary features that tell the labels apart by ``least_z`` standard errors, times their log-count ratios,
    over the root of how many a text has; ``share`` is the weight of label 1. Without rows of both labels the
    model is constant: the share of label 1, or 0 without any rows."""
    y = np.asarray(labels, np.float64)
    if len(y) == 0 or y.min() == y.max():
        return constant(len(y) > 0 and y[0] > 0)
    scratch = np.zeros(1 << BITS, np.int32)
    n1, n0 = y.sum(), (1 - y).sum()
    df1, df0 = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for t, lab in zip(texts, y, strict=True):
        (df1 if lab else df0)[grams(t, scratch)] += 1
    ratio, use = telling(df1, df0, n1, n0, smooth, least_z)
    to = np.cumsum(use) - 1
    # all n-grams of all texts are never held at once
    x = [to[g[use[g]]].astype(np.int32) for g in (grams(t, scratch) for t in texts)]
    cols, size = np.concatenate(x), np.array([len(i) for i in x])
    weigh = ((1 - share) / n0, share / n1)
    return learn(lambda v, b: slopes(v, b, y, size, cols, weigh), ratio, use, float(np.log(n1 / n0)), l2, steps)


def marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id may be one of ``ids``: all that are, few others while the ids are few beside MARKS. A
    bitmap of hashes, of a fixed size, tells them, so that a join to follow shuffles no other texts."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS))
    bits = np.zeros(MARKS // 8, np.uint8)
    found = ids.select((place + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("nth")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    for r in found.collect():
        part = np.frombuffer(r.bits, np.uint8)
        bits[(r.nth - 1) * len(part) : r.nth * len(part)] = part

    def run(batches):
        import pyarrow as pa

        for b in batches:
            at = b.column(b.num_columns - 1).to_numpy()
            yield b.filter(pa.array((bits[at >> 3] >> (at & 7) & 1).astype(bool)))

    mark = free_name(docs, "mark")
    whole = docs.withColumn(mark, place)
    return whole.mapInArrow(run, whole.schema).drop(mark)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of every labelled document that is not held out. Null labels and texts are not used; of repeated
    labels the larger counts, of repeated documents the text that sorts first."""
    lab = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = marked(docs.where(F.col("text").isNotNull() & ~held_out()).select(F.col("doc_id").cast(lab.schema["doc_id"].dataType), "text"), lab.select("doc_id"))
    rows = rows.join(lab, "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def added(rows: DataFrame, run, n: int) -> np.ndarray:
    """The sum of the vectors of ``n`` numbers that ``run`` makes of the batches of each task (None: nothing), in BLOCKS
    pieces: the cluster adds those of tasks whose numbers agree modulo SUMS, then the SUMS that are left; the driver gets
    one vector."""
    size = -(-n // BLOCKS)

    def parts(batches):
        import pyarrow as pa

        got = run(batches)
        if got is not None:
            got = np.append(got, np.zeros(size * BLOCKS - n)).reshape(BLOCKS, size)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array([x.tobytes() for x in got], pa.binary())], names=["block", "part"])

    def add(order):
        def whole(t):
            import pyarrow as pa

            t = t.sort_by(order)  # equal tables, equal sums
            got = sum(np.frombuffer(x, np.float64) for x in t.column("part").to_pylist())
            return pa.table({"block": t.column("block")[:1], "half": t.column("half")[:1], "part": pa.array([got.tobytes()], pa.binary())})

        return whole

    schema = "block int, half int, part binary"
    each = rows.mapInArrow(parts, "block int, part binary").withColumn("task", F.spark_partition_id()).withColumn("half", F.col("task") % SUMS)
    out = np.zeros((BLOCKS, size))
    with tidy(rows.sparkSession):
        got = each.groupBy("block", "half").applyInArrow(add("task"), schema).groupBy("block").applyInArrow(add("half"), schema).collect()
    for r in got:
        out[r.block] = np.frombuffer(r.part, np.float64)
    return out.ravel()[:n]


def packed(cols: np.ndarray) -> bytes:
    """Ascending numbers as steps of one byte; 255 goes on so far without a number."""
    step = np.diff(cols, prepend=0)
    out = np.full(len(cols) + int((step // 255).sum()), 255, np.uint8)
    out[np.cumsum(step // 255 + 1) - 1] = step % 255
    return out.tobytes()


def unpacked(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how many numbers each row has, the numbers) of rows of ``packed`` bytes that begin and end at ``offs``."""
    at = np.flatnonzero(data != 255)
    run = np.concatenate(([0], np.cumsum(data, dtype=np.int64)))
    size = np.diff(np.searchsorted(at, offs))
    return size, run[at + 1] - np.repeat(run[offs[:-1]], size)


def fit_all(docs: DataFrame, labels: DataFrame, smooth: float = 1.0, l2: float = 1e-4, steps: int = 200, least_z: float = 3.0, share: float = 0.25) -> Model:
    """``fit`` on every row of ``labelled``, of whatever number and length: the texts stay on the cluster, which sums counts
    and slopes; the driver holds numbers by bucket."""
    import pyarrow as pa

    buckets = 1 << BITS
    rows = materialize(labelled(docs, labels), "labelled")

    def count(batches):
        scratch, out = np.zeros(buckets, np.int32), np.zeros((2, buckets + 1))
        for t in text_buffers(batches, "text"):
            for i, toxic in enumerate(t.batch.column("toxic").to_pylist()):
                out[toxic, grams(t.raw(i).decode("utf-8", "replace"), scratch)] += 1
                out[toxic, -1] += 1
        return out.ravel() if out[:, -1].any() else None

    df0, df1 = added(rows, count, 2 * (buckets + 1)).reshape(2, -1)
    n0, n1 = df0[-1], df1[-1]
    if not n0 or not n1:
        discard(rows)
        return constant(n1 > 0)
    ratio, use = telling(df1[:-1], df0[:-1], n1, n0, smooth, least_z)
    to, weigh = (np.cumsum(use) - 1).astype(np.int32), ((1 - share) / n0, share / n1)

    def features(batches):
        scratch = np.zeros(buckets, np.int32)
        for t in text_buffers(batches, "text"):
            each = (grams(t.raw(i).decode("utf-8", "replace"), scratch) for i in range(len(t)))
            cols = pa.array([packed(np.sort(to[g[use[g]]])) for g in each], pa.binary())
            yield pa.RecordBatch.from_arrays([t.batch.column("toxic"), cols], names=["toxic", "cols"])

    lists = materialize(rows.mapInArrow(features, "toxic int, cols binary"), "features")

    def total(v, bias):
        sent = docs.sparkSession.sparkContext.broadcast(v)

        def run(batches):
            v, out = sent.value, None
            for b in batches:
                toxic, cols = b.column("toxic").to_numpy(), b.column("cols").cast(pa.large_binary())
                _, offsets, raw = cols.buffers()
                offs = np.frombuffer(offsets, np.int64)[cols.offset : cols.offset + len(cols) + 1]
                data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
                at = 0
                while at < len(cols):  # so many numbers at a time
                    to = min(max(int(np.searchsorted(offs, offs[at] + (1 << 20), side="right")) - 1, at + 1), len(cols))
                    size, some = unpacked(data[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
                    got = slopes(v, bias, toxic[at:to], size, some, weigh)
                    out, at = got if out is None else out + got, to
            return out

        try:
            return added(lists, run, len(v) + 2)
        finally:
            sent.destroy()  # not when the driver happens to collect its garbage

    model = learn(total, ratio, use, float(np.log(n1 / n0)), l2, steps)
    discard(rows, lists)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = 1500, most_chars: int = 60_000) -> tuple[list[str], np.ndarray]:
    """A bounded sample for ``fit``, for callers that want one (the queries use ``fit_all``): of each class the ``per_class`` labelled documents, none held out, whose ids hash
    lowest, of texts up to ``most_chars`` (longer ones are scored but not learned from). Null labels are not used;
    of repeated labels the larger counts, of repeated documents the text that sorts first."""
    lab = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    short = docs.where(F.length("text") <= most_chars)
    # ids first, so that no task sends more texts than are used
    ids = short.select("doc_id").join(lab, "doc_id").distinct()
    which = {r.doc_id: r.toxic for r in bounded_sample(ids, "toxic", "doc_id", per_class)}
    got = short.where(F.col("doc_id").isin(*which)).groupBy("doc_id").agg(F.min("text").alias("text")).collect() if which else []
    got.sort(key=lambda r: r.doc_id)
    return [r.text for r in got], np.array([which[r.doc_id] for r in got])


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, threshold: float = 0.5) -> DataFrame:
    """(id, score, predicted) of every whole text, however long; null counts as empty. With ``keep`` the rows of ``docs``
    below ``threshold`` come back instead, all columns as they were. Equal texts get equal scores, rows that repeat give
    rows that repeat, an empty table gives an empty one; other columns are ignored."""
    schema = docs.schema if keep else f"{id_col} {docs.schema[id_col].dataType.simpleString()}, score double, predicted int"
    cols = docs.columns if keep else [id_col, text_col]

    def run(batches):
        import pyarrow as pa

        scratch = np.zeros(1 << BITS, np.int32)
        for t in text_buffers(batches, text_col):
            s = np.array([model.score(t.raw(i).decode("utf-8", "replace"), scratch) for i in range(len(t))])
            if keep:
                yield t.batch.filter(pa.array(s < threshold))
            else:
                yield pa.RecordBatch.from_arrays([t.batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    return docs.select(*cols).mapInArrow(run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_all(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
