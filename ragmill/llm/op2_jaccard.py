"""Jaccard join on word n-grams: a blocked sparse product of the document by n-gram incidence.

Which documents can reach the threshold t is settled by counting. If |A & B| >= t * |A | B|, the two sets
differ in at most min(|A|, |B|) * (1 - t) / t n-grams. Sets of similar size are cut into one more bucket
than that (by hash), so two that link agree in a whole bucket. Documents that agree in a bucket are
joined into blocks; in each block the product of the incidence with its transpose accumulates overlaps,
and pairs below the bound that their sizes set are discarded. Links never cross blocks unseen, so the
result is exact up to collisions of 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ragmill.llm.common import discard, materialize, table, text_buffers
from ragmill.llm.components import components

#: Sets and n-grams of a block at most. A family that fills FINE blocks of the small size or fewer takes small ones.
BLOCK_DOCS, SMALL_DOCS, FINE = 1024, 256, 8
BLOCK_GRAMS = 1 << 21
#: Sets of a family that stand for it: what links with one of them, or with one that does, is joined already.
PIVOTS = 8
SALTS = 64
#: Digests of texts that a task remembers, so that a copy is cut into buckets once.
REMEMBER = 1 << 16
#: Buckets beyond the bound; a set with more empty ones also shows them.
SPARE = 1
#: Scans in which the buckets of a scheme with extra ones are dealt out, each a range of their hashes: so much less of the
#: disk holds them at a time.
PASSES = 4
#: Sides of a bucket whose pairs are counted; a bucket of more is told by its smallest side.
RARE = 16


class Words(dict):
    """64-bit hashes of words; the table is bounded, words beyond are hashed anew."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 1 << 18:
            self[word] = h
        return h


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(k)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def shingles(text: bytes, width: int, words: Words) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word sequences of lower-cased text; the whole if it has fewer words."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    n = min(width, len(w))
    g = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        g = g * np.uint64(0x9E3779B97F4A7C15) + mixed(h[i : len(h) - n + 1 + i], 0xBF58476D1CE4E5B9)
    g = np.sort(mixed(g, 0xD6E8FEB86659FD93))
    return g[np.concatenate(([True], g[1:] != g[:-1]))]


class Scheme:
    """Size classes, and buckets by class, of a threshold of ``percent`` hundredths.

    With more buckets than need be, two sets that link agree in many: ``extra`` is how many more, by the bound on
    their difference. A set that shares fewer with all others together links with none. Lower thresholds have
    smaller buckets, which strangers share more often; this rules them out."""

    def __init__(self, percent: int):
        self.percent = percent
        self.extra = 0.0 if percent >= 90 else 0.4
        # Sizes of two sets that link differ by a factor of at most 1/t: the same class, or the next.
        step, bounds = 100 / percent * 1.001, [1.0]
        while bounds[-1] < 1e10:
            bounds.append(bounds[-1] * step)
        self.bounds = np.array(bounds)

    def size_class(self, n) -> np.ndarray:
        return np.searchsorted(self.bounds, n, side="right") - 1

    def differ(self, group: int) -> int:
        """Most n-grams in which two linked sets of classes group - 1 and group differ."""
        return int(np.ceil(self.bounds[group + 1])) * (100 - self.percent) // self.percent

    def signatures(self, g: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(group, need, hashes of the buckets) for the set's own class and the next."""
        own, out = int(self.size_class(len(g))), []
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(g, 0xA0761D6478BD642F), dtype=np.uint64)))
        for group in (own, own + 1):
            d = self.differ(group)
            if not d:  # only equal sets link
                continue
            k = d + 1 + SPARE + int(self.extra * d)
            # the sets are sorted, so that buckets by leading bits are runs
            cuts = np.searchsorted(g, (np.arange(1, k, dtype=np.float64) / k * 2.0**64).astype(np.uint64))
            cuts = np.concatenate(([0], cuts, [len(g)]))
            full = cuts[1:] > cuts[:-1]
            value = sums[cuts[1:]] - sums[cuts[:-1]]
            tag = mixed(np.arange(k, dtype=np.uint64) + np.uint64(group << 32), 0xE7037ED1A0B428DB)
            # empty buckets agree with each other: while few, they are left out of sight and of the number needed.
            # A set that shows all of its own may share up to SPARE with one that hides them.
            hidden = k - np.count_nonzero(full)
            show, hidden = (full, hidden) if hidden <= SPARE else (np.ones(k, bool), SPARE)
            out.append((group, k - d - hidden, mixed(value[show] + tag[show], 0x8EBC6AF09C88C6E3)))
        return out

    def links(self, overlap, a, b):
        return self.percent * (a + b - overlap) <= 100 * overlap


def node_of(g: np.ndarray) -> int:
    """A 63-bit digest of a set, which stands for it and all its copies."""
    return int(mixed(g.sum(dtype=np.uint64, keepdims=True) ^ mixed(g, 0x589965CC75374CC3).sum(dtype=np.uint64), 0xD6E8FEB86659FD93)[0] >> np.uint64(1))


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, node): size and digest of each set; no node for an empty one."""

    def run(batches):
        import pyarrow as pa

        words = Words()
        for t in text_buffers(batches, "text"):
            g = [shingles(t.raw(i), width, words) for i in range(len(t))]
            yield pa.RecordBatch.from_arrays([t.batch.column(0), pa.array([len(x) for x in g], pa.int64()), pa.array([node_of(x) if len(x) else None for x in g], pa.int64())], names=["doc_id", "n", "node"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, node long")


def bucket_hashes(docs: DataFrame, width: int, percent: int, part: int = 0, parts: int = 1) -> DataFrame:
    """(side, need, sigs): the buckets of a set in its own class or the next, and how many it needs to share there to
    link; of the buckets those in one of ``parts`` ranges of their hashes. A side is twice the node, plus one for the next class. A task passes a text on once, as far as it remembers;
    what it passes on again changes nothing but the work."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        words, scheme, seen = Words(), Scheme(percent), set()
        for t in text_buffers(batches, "text"):
            side, need, sigs = [], [], []
            for i in range(len(t)):
                raw = t.raw(i)
                key = xxhash.xxh3_128_intdigest(raw)
                if key in seen:
                    continue
                if len(seen) < REMEMBER:
                    seen.add(key)
                g = shingles(raw, width, words)
                if not len(g):
                    continue
                own, node = int(scheme.size_class(len(g))), node_of(g)
                for group, least, sig in scheme.signatures(g):
                    if parts > 1:
                        sig = sig[(sig >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32) == part]
                    side.append((node << 1 | int(group != own)) - (1 << 63))
                    need.append(least)
                    sigs.append(sig.view(np.int64))
            if side:
                offs = np.concatenate(([0], np.cumsum([len(x) for x in sigs]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(side, pa.int64()), pa.array(need, pa.int32()), pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(sigs)))], names=["side", "need", "sigs"])

    return docs.where("doc_id IS NOT NULL").select("text").mapInArrow(run, "side long, need int, sigs array<long>")


def shared_buckets(docs: DataFrame, width: int, percent: int, part: int, parts: int) -> DataFrame:
    """(side, need, sig) of the buckets in one range that more sides than one have.

    The shuffle carries a side, a number and a bucket; a bucket of very many sets spills, and is not held."""
    rows = bucket_hashes(docs, width, percent, part, parts).select("side", "need", F.explode("sigs").alias("sig"))
    whole = W.partitionBy("sig")
    rows = rows.withColumn("first", F.min("side").over(whole)).withColumn("last", F.max("side").over(whole)).where("first <> last")
    return materialize(rows.select("side", "need", "sig").distinct(), "shared_buckets")


def node_of_side(side) -> F.Column:
    return F.shiftright(side, 1) + (1 << 62)


def stars(rows: DataFrame) -> DataFrame:
    """(a, b): the node of each of ``rows`` (side, sig) and the smallest node of its bucket."""
    first = F.min("node").over(W.partitionBy("sig").orderBy("node").rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.select(node_of_side("side").alias("node"), "sig").select(F.col("node").alias("a"), first.alias("b"))


def sharing(left: DataFrame) -> DataFrame:
    """(a, b) of nodes such that any two that share as many of the buckets ``left`` (side, need, sig) as they need are joined.

    The pairs in buckets of up to RARE sides are counted. A side that has ``often`` larger buckets besides shares at least
    need - often of the small ones with what it links with, so that pairs of fewer go. Larger buckets join all their sides, but of
    a side only those that are left without its need - 1 largest: of need shared buckets one is left on both sides, as all
    order them alike."""
    left = left.withColumn("sides", F.count("*").over(W.partitionBy("sig"))).where("sides > 1")
    of_side = W.partitionBy("side")
    left = left.withColumn("often", F.count_if(F.col("sides") > RARE).over(of_side)).withColumn("nth", F.row_number().over(of_side.orderBy(F.desc("sides"), "sig")))
    left = materialize(left.withColumn("gap", (F.col("need") - F.col("often")).cast("int")).select("side", "sig", "sides", "gap", (F.col("nth") >= F.col("need")).alias("kept")), "ordered_buckets")
    few = left.where(F.col("sides") <= RARE).groupBy("sig").agg(F.array_sort(F.collect_list(F.struct("side", "gap"))).alias("all"))
    few = few.select("all", F.posexplode("all").alias("at", "b")).select("b", F.explode(F.expr("slice(all, at + 2, size(all))")).alias("a"))
    pairs = few.select(F.col("a.side").alias("a"), F.col("b.side").alias("b"), F.greatest("a.gap", "b.gap").alias("gap")).groupBy("a", "b", "gap").agg(F.count("*").alias("k"))
    pairs = pairs.where("k >= gap").select(node_of_side("a").alias("a"), node_of_side("b").alias("b"))
    edges = materialize(pairs.union(stars(left.where((F.col("sides") > RARE) & F.col("kept")))).where("a <> b").distinct(), "sharing")
    discard(left)
    return edges


def candidates(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) of nodes such that any two that link are joined by way of others, once those are gone that share too few
    buckets to link at all: nodes that share enough buckets, or, where one is enough, a bucket with the smallest that has it.

    A scheme with extra buckets has several times as many, and is scanned PASSES times."""
    extra = Scheme(percent).extra > 0
    parts = PASSES if extra else 1
    ranges = [shared_buckets(docs, width, percent, k, parts) for k in range(parts)]
    shared = reduce(DataFrame.union, ranges)
    enough = shared.groupBy("side", "need").agg(F.count("*").alias("k")).where("k >= need").select("side")
    alive = materialize(enough, "alive")
    left = shared.join(alive, "side", "left_semi")
    edges = sharing(left) if extra else materialize(stars(left).where("a <> b").distinct(), "stars")
    discard(*ranges, alive)
    # a node with several centres joins them: through the smallest, so that all nodes of a family say the same
    edges = edges.withColumn("c", F.min("b").over(W.partitionBy("a")))
    return edges.select("a", F.col("c").alias("b")).union(edges.where("b <> c").select(F.col("b").alias("a"), F.col("c").alias("b"))).distinct()


def overlaps(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, scheme: Scheme, most: int = 1 << 22):
    """Pairs (i, j) of ``rows`` x ``cols`` whose sets link, by accumulating the product over blocks of n-grams.

    Columns of one document are left out; those that more documents share come last, when few pairs live."""
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets), dtype=np.int32), size)
    order = np.argsort(flat)
    flat, doc = flat[order], doc[order]
    heads = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    df = np.diff(np.append(heads, len(flat)))
    heads, df = heads[df > 1], df[df > 1]
    rank = np.argsort(df, kind="stable")
    heads, df = heads[rank], df[rank]
    a, b = size[rows][:, None], size[cols][None, :]
    need = -(-scheme.percent * (a + b) // (100 + scheme.percent))
    live = (np.minimum(a, b) >= need) & (rows[:, None] < cols[None, :])
    row_at, col_at = np.full(len(sets), -1, np.int32), np.full(len(sets), -1, np.int32)
    row_at[rows], col_at[cols] = np.arange(len(rows)), np.arange(len(cols))
    got = np.zeros(live.shape, np.int32)
    left = np.bincount(doc[np.repeat(heads - np.cumsum(df) + df, df) + np.arange(df.sum())], minlength=len(sets))
    at = 0
    while at < len(heads) and live.any():
        work = np.cumsum(df[at:].astype(np.int64) ** 2)
        to = at + max(1, int(np.searchsorted(work, most, side="right")))
        n = df[at:to]
        member = doc[np.repeat(heads[at:to], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        column = np.repeat(np.arange(to - at), n)
        if work[to - at - 1] > 16 * n.sum() or work[to - at - 1] > most:
            # dense columns: as many at a time as fit, multiplied by BLAS
            r, c = row_at[member], col_at[member]
            wide = max(1, most // max(1, len(rows) + len(cols)))
            for lo in range(0, to - at, wide):
                x = (column >= lo) & (column < lo + wide)
                left_, right = np.zeros((len(rows), min(wide, to - at - lo)), np.float32), np.zeros((len(cols), min(wide, to - at - lo)), np.float32)
                rr, cc = x & (r >= 0), x & (c >= 0)
                left_[r[rr], column[rr] - lo] = 1
                right[c[cc], column[cc] - lo] = 1
                got += (left_ @ right.T).astype(np.int32)
        else:
            first = np.repeat(np.cumsum(n) - n, n)
            each = np.repeat(np.arange(len(member)), n[column])
            other = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(n[column]) - n[column], n[column])
            r, c = row_at[member[each]], col_at[member[other]]
            ok = (r >= 0) & (c >= 0)
            got += np.bincount(r[ok].astype(np.int64) * len(cols) + c[ok], minlength=got.size).reshape(got.shape).astype(np.int32)
        left -= np.bincount(member, minlength=len(sets))
        at = to
        live &= got + np.minimum(left[rows][:, None], left[cols][None, :]) >= need
    return np.nonzero(live & (got >= need))


def local_roots(m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index each of m nodes is joined with."""
    root = np.arange(m)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def by_component(rows: DataFrame, few: DataFrame, how: str) -> DataFrame:
    """``rows`` joined with a table of one row a component, which is dealt SALTS times, so that a component of very many rows
    lies in many tasks."""
    salt = F.pmod(F.xxhash64("doc_id", "n"), F.lit(SALTS)).cast("int")
    few = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", salt).join(few, ["component", "salt"], how).drop("salt")


def with_pivots(rows: DataFrame, scheme: Scheme) -> DataFrame:
    """``rows`` (doc_id, component, cls, n, grams) with centres: the pivots that a set links with, each named by the
    smallest pivot that it is joined with through pivots. Components of more than SMALL_DOCS sets have PIVOTS pivots, those
    whose ids hash lowest; smaller ones have none. Rows are dealt to blocks, and pivots go to each block: a component's
    work here is in proportion to its size."""
    sizes = rows.groupBy("component").agg(F.count("*").alias("docs")).where(F.col("docs") > SMALL_DOCS)
    sizes = materialize(sizes.select("component", F.ceil(F.col("docs") / SMALL_DOCS).cast("int").alias("cuts")), "large_components")
    large = by_component(rows, sizes, "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("cuts")).cast("int"), F.lit(-1)))
    nth = F.row_number().over(W.partitionBy("component").orderBy(F.xxhash64("doc_id"), "doc_id"))
    pivots = by_component(rows, sizes, "inner").withColumn("nth", nth).where(F.col("nth") <= PIVOTS)
    pivots = materialize(pivots.select("component", "cuts", "doc_id", "grams"), "pivots").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))

    def centres(mine, theirs):
        import pyarrow as pa

        sets = lambda t: [np.frombuffer(x, np.uint64) for x in t.column("grams").to_pylist()]
        name = theirs.column("doc_id").to_numpy()
        order = np.argsort(name, kind="stable")
        name, pivot = name[order], [sets(theirs)[k] for k in order]
        own = sets(mine)
        every = own + pivot
        size = np.array([len(x) for x in every])
        flat, heads = np.concatenate(every), np.cumsum(size) - size
        linked = np.zeros((len(every), len(pivot)), bool)
        for k, g in enumerate(pivot):
            overlap = np.add.reduceat((g[np.minimum(np.searchsorted(g, flat), len(g) - 1)] == flat).astype(np.int64), heads)
            linked[:, k] = scheme.links(overlap, size, len(g))
        i, j = np.nonzero(linked[len(own) :])
        root = name[local_roots(len(pivot), i, j)]
        got = [sorted(set(root[x].tolist())) for x in linked[: len(own)]]
        return mine.select(["doc_id", "component", "cls", "n", "grams"]).append_column("centres", pa.array(got, pa.list_(pa.int64())))

    some = large.where("block >= 0").groupBy("component", "block").cogroup(pivots.select("component", "block", "doc_id", "grams").groupBy("component", "block"))
    done = some.applyInArrow(centres, "doc_id long, component long, cls int, n long, grams binary, centres array<long>")
    rest = large.where("block < 0").select("doc_id", "component", "cls", "n", "grams", F.array().cast("array<long>").alias("centres"))
    return done.unionByName(rest)


def verified(docs: DataFrame, groups: DataFrame, width: int, percent: int, count: bool = True) -> DataFrame:
    """(a, b, links): for each document with links in a block, the block's smallest it is joined with, and how many.

    With ``count`` every pair of compatible size is counted in some block. Without, only what joins matters: sets that
    link with the commonest pivot of their component are joined already and are compared with the others alone, so that
    a family costs its size times its pivots and its outsiders; links are then no full number."""
    scheme = Scheme(percent)

    def sets_of(batches):
        import pyarrow as pa

        words = Words()
        for t in text_buffers(batches, "text"):
            g = [shingles(t.raw(i), width, words) for i in range(len(t))]
            n = np.array([len(x) for x in g])
            yield pa.RecordBatch.from_arrays(
                [t.batch.column(0), t.batch.column(2), pa.array(scheme.size_class(n).astype(np.int32)), pa.array(n), pa.array([x.tobytes() for x in g], pa.binary())],
                names=["doc_id", "component", "cls", "n", "grams"],
            )

    rows = docs.select("doc_id", "text").join(groups, "doc_id").select("doc_id", "text", "component")
    rows = materialize(rows.mapInArrow(sets_of, "doc_id long, component long, cls int, n long, grams binary"), "sets")
    if count:
        joined, rows = None, rows.withColumn("settled", F.lit(False))
    else:
        first = rows
        rows = materialize(with_pivots(rows, scheme), "centred")
        discard(first)
        joined = rows.select(F.col("doc_id").alias("a"), F.explode("centres").alias("b"), F.lit(1).cast("long").alias("links"))
        own = F.get("centres", F.lit(0))
        often = rows.groupBy("component", own.alias("centre")).agg(F.count("*").alias("k")).where("centre IS NOT NULL")
        often = often.groupBy("component").agg(F.max_by("centre", F.struct("k", "centre")).alias("centre"))
        rows = by_component(rows, materialize(often, "centres"), "left").withColumn("settled", F.coalesce(own == F.col("centre"), F.lit(False)))
    rows = rows.select("doc_id", "component", "cls", "n", "grams", "settled").withColumn("grp", F.explode(F.array(F.col("cls"), F.col("cls") + 1)))
    sizes = rows.groupBy("component", "grp").agg(
        F.count("*").alias("docs"), F.count_if(~F.col("settled")).alias("new"), F.sum("n").alias("all"), F.sum(F.when(~F.col("settled"), F.col("n")).otherwise(0)).alias("new_all"), F.max("cls").alias("top")
    )
    # a group without documents of its upper class compares nothing that the group below does not
    sizes = sizes.where((F.col("docs") > 1) & (F.col("new") > 0) & (F.col("top") == F.col("grp")))
    parts = lambda n, grams: F.greatest(F.least(F.ceil(n / SMALL_DOCS), F.lit(FINE)), F.ceil(n / BLOCK_DOCS), F.ceil(grams / BLOCK_GRAMS)).cast("int")
    new, old = parts(F.col("new"), F.col("new_all")), parts(F.col("docs") - F.col("new"), F.col("all") - F.col("new_all"))
    sizes = materialize(sizes.select("component", "grp", new.alias("new"), old.alias("old")), "block_sizes")
    rows = rows.join(sizes, ["component", "grp"])
    # blocks of new sets come first and meet all blocks; those of settled ones meet these only
    deal = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    mine = F.when(F.col("settled"), F.col("new") + deal(F.col("old"))).otherwise(deal(F.col("new")))
    last = F.when(F.col("settled"), F.col("new")).otherwise(F.col("new") + F.col("old")) - 1
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.select("doc_id", "component", "cls", "grp", "grams", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))

    def compare(block):
        import pyarrow as pa

        ids = block.column("doc_id").to_numpy()
        cls, mine = block.column("cls").to_numpy(), block.column("mine").to_numpy()
        grp, lo, hi = block.column("grp")[0].as_py(), block.column("lo")[0].as_py(), block.column("hi")[0].as_py()
        order = np.argsort(ids, kind="stable")
        ids, cls, mine = ids[order], cls[order], mine[order]
        raw = block.column("grams").combine_chunks()
        sets = [np.frombuffer(raw[int(k)].as_buffer(), np.uint64) for k in order]
        got_a, got_b = [], []
        every = np.arange(len(ids))
        for x, y in [(lo, hi)] if lo == hi else [(lo, hi), (hi, lo)]:
            i, j = overlaps(sets, every[mine == x], every[mine == y], scheme) if (mine == x).any() and (mine == y).any() else (every[:0], every[:0])
            i, j = every[mine == x][i], every[mine == y][j]
            ok = (cls[i] == grp) | (cls[j] == grp)
            got_a.append(i[ok])
            got_b.append(j[ok])
        a, b = np.concatenate(got_a), np.concatenate(got_b)
        root = local_roots(len(ids), a, b)
        count = np.bincount(np.concatenate((a, b)), minlength=len(ids))
        some = np.flatnonzero(count)
        return pa.table({"a": ids[some], "b": ids[root[some]], "links": count[some]})

    found = rows.groupBy("component", "grp", "lo", "hi").applyInArrow(compare, "a long, b long, links long")
    return found if joined is None else found.unionByName(joined)


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90, count: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, links) of every row of ``docs`` (doc_id, text; others are ignored).

    component_id is the smallest doc_id that links reach, itself included (documents of one set are one node,
    and their smallest doc_id stands for it); links counts the documents with other
    sets it links with, where copies count once (without ``count`` only whether there are any). Documents without words link with nothing. A null id has a null
    component and takes no part; rows that repeat an id share one component. An empty table gives an empty one.
    """
    seen = materialize(fingerprints(docs, width), "fingerprints")
    classes = materialize(seen.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep")), "classes")
    blocks = components(candidates(docs, width, percent))
    blocks = blocks.join(classes, "node").select(F.col("rep").alias("doc_id"), "component")
    links = materialize(verified(docs, blocks, width, percent, count), "links")
    final = components(links.where("a <> b").select("a", "b"))
    degree = links.groupBy(F.col("a").alias("rep")).agg((F.sum if count else F.max)("links").alias("links"))
    found = materialize(classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left"), "class_components")
    return seen.join(found, "node", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("links", F.lit(0)).alias("links"),
    )


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` but those that link, however far, with one of a smaller doc_id; all columns as they were.
    Rows of a null id and rows without words link with nothing and stay; rows that repeat an id stay or go together.
    Very long texts count with all their shingles, an empty table gives an empty one."""
    found = jaccard_components(docs, width, percent, count=False)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), 3, 90)
