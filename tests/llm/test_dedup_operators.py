"""Jaccard join, suffix dedup, decontamination and the pipeline against brute force."""

import hashlib
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from ragmill.llm import common, op2_jaccard, op3_suffix, op10_decontaminate, suffix
from ragmill.llm.components import components

ODD = [(1, None), (2, ""), (3, "x"), (4, "x"), (None, "a b c d"), (5, " \t\n"), (6, "w " * 30000), (7, "W " * 30000)]


def odd(spark):
    return spark.createDataFrame([(i, t, "c", 1, 2) for i, t in ODD], "doc_id long, text string, component string, n int, row int")


def families(seed, n=120, size=60):
    """Texts with copies, near copies of many distances, and shared passages."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=70))
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            base = rng.choice(out[-10:]).split()
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                base[rng.randrange(len(base))] = rng.choice(words)
            out.append(" ".join(base))
        else:
            out.append(" ".join(rng.choices(words, k=rng.choice([1, 2, 8, size, 3 * size]))))
        if rng.random() < 0.2:
            out[-1] += " " + passage
    return out


def brute_components(texts, width, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 3, 90), (2, 3, 90), (3, 5, 80), (4, 2, 70)])
def test_jaccard(spark, seed, width, percent, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(op2_jaccard, "BLOCK_DOCS", 3)  # many blocks
    texts = families(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op2_jaccard.jaccard_components(df, width, percent).collect()}
    assert got == brute_components(texts, width, percent)


@pytest.mark.parametrize(("seed", "width", "percent", "knobs"), [(5, 5, 80, {}), (6, 5, 80, {"SMALL_DOCS": 3, "BLOCK_DOCS": 4, "PIVOTS": 2}), (7, 3, 90, {"SMALL_DOCS": 2, "FINE": 2, "BLOCK_DOCS": 3, "PIVOTS": 1}), (8, 2, 70, {"SMALL_DOCS": 4, "REMEMBER": 2})])
def test_jaccard_by_pivots(spark, seed, width, percent, knobs, monkeypatch):
    for k, v in knobs.items():
        monkeypatch.setattr(op2_jaccard, k, v)
    texts = families(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_components(texts, width, percent)
    got = op2_jaccard.jaccard_components(df, width, percent, count=False).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert {r.doc_id for r in op2_jaccard.one_of_each(df, width, percent).collect()} == {i for i, (_, c) in want.items() if c == i}


def test_jaccard_of_one_large_family(spark):
    """Near copies in a chain of drifts: few link with a pivot, all are one class."""
    rng = random.Random(1)
    words, texts = [f"w{i}" for i in range(120)], []
    for k in range(900):
        if k % 3 == 0:
            words[rng.randrange(len(words))] = f"x{k}"
        texts.append(" ".join(words[: 115 + k % 5]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_components(texts, 3, 90)
    for count in (True, False):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in op2_jaccard.jaccard_components(df, 3, 90, count).collect()} == want


def test_jaccard_odd(spark):
    got = [tuple(r)[:3] for r in op2_jaccard.jaccard_components(odd(spark)).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (None, 2, None), (5, 0, 5), (6, 1, 6), (7, 1, 6)], key=str)
    assert op2_jaccard.jaccard_components(odd(spark).limit(0)).count() == 0
    kept = op2_jaccard.one_of_each(odd(spark))
    assert kept.columns == odd(spark).columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, None, 5, 6}


def test_strangers_that_share_passages_with_many_are_no_candidates(spark):
    """Each document shares its passages with several others and nearly equals only its own copy: candidates are the
    copies, not one component that grows with the table."""
    rng = random.Random(5)
    passages = [" ".join(f"p{p}w{i}" for i in range(60)) for p in range(40)]
    texts = [" ".join(passages[p] for p in sorted(rng.sample(range(40), 5))) for _ in range(80)]
    texts += [x + " more" for x in texts[:8]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = components(op2_jaccard.candidates(docs, 5, 80)).groupBy("component").count().collect()
    assert max(r["count"] for r in found) <= 8
    want = brute_components(texts, 5, 80)
    assert {r.doc_id for r in op2_jaccard.one_of_each(docs).collect()} == {i for i, (_, c) in want.items() if c == i}


def test_sides_that_share_enough_buckets_are_joined(spark):
    """Families in buckets below and above RARE, and strangers in large ones."""
    rng = random.Random(7)
    of = {}
    for side in range(150):
        family = side % 3 if side < 90 else side // 2
        of[side] = {family * 100 + k for k in range(20) if rng.random() < 0.9} | {10000 + rng.randrange(6) for _ in range(4)} | {20000 + side}
    need = {side: 6 + side % 4 for side in of}
    name = lambda side: (side << 1) - (1 << 62)
    left = spark.createDataFrame([(name(side), need[side], sig) for side, sigs in of.items() for sig in sorted(sigs)], "side long, need int, sig long")
    got = {r.node: r.component for r in components(op2_jaccard.sharing(left)).collect()}
    node = lambda side: (name(side) >> 1) + (1 << 62)
    joined = [(a, b) for a in of for b in of if a < b and len(of[a] & of[b]) >= max(need[a], need[b])]
    assert len(joined) > 1000 and all(got[node(a)] == got[node(b)] for a, b in joined)
    assert got[node(90)] != got[node(92)]


def test_ranges_of_buckets_are_all_buckets_once(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(300))), (2, "a b c"), (3, None)], "doc_id long, text string")
    rows = lambda *part: [(r.side, r.need, x) for r in op2_jaccard.bucket_hashes(docs, 5, 80, *part).collect() for x in r.sigs]
    parts, whole = [rows(k, op2_jaccard.PASSES) for k in range(op2_jaccard.PASSES)], rows()
    assert sorted(x for part in parts for x in part) == sorted(whole)
    assert all(len(part) < len(whole) / 2 for part in parts)


def test_a_written_table_leaves_no_shuffle_files(spark):
    """They go with the write, not when the driver collects its garbage; the session's setting stays."""
    before = spark.conf.get(common.CLEANUP, None)
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.getName() for f in (lambda x: [x.apply(i) for i in range(x.size())])(disk.getAllFiles()) if f.getName().endswith(".data")}
    old = files()
    back = common.materialize(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), "counts")
    until = time.time() + 10
    while files() - old and time.time() < until:
        time.sleep(0.1)
    assert not files() - old and back.count() == 7
    assert spark.conf.get(common.CLEANUP, None) == before


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_enough_buckets(percent):
    """However few buckets a set fills: what it shares with any that it links with is no less than it needs."""
    rng, scheme = np.random.default_rng(7), op2_jaccard.Scheme(percent)
    for n in (4, 5, 8, 9, 10, 12) * 300:
        whole = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1))
        part = np.delete(whole, rng.choice(n, n * (100 - percent) // 100, replace=False))
        if not scheme.links(len(part), n, len(part)) or n == len(part):
            continue
        a, b = ({g: (need, set(s.tolist())) for g, need, s in scheme.signatures(x)} for x in (whole, part))
        group = max(int(scheme.size_class(n)), int(scheme.size_class(len(part))))
        if group in a and group in b:
            assert len(a[group][1] & b[group][1]) >= max(a[group][0], b[group][0]) >= 1


def test_links_are_counted(spark):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)] + [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in (10, 50, 190)] + [" ".join(base)]
    got = {r.doc_id: r.links for r in op2_jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: 3, 1: 3, 2: 3, 3: 3, 4: 3}


def test_components(spark):
    chain = [(i, i + 1) for i in range(10, 60)] + [(100, 5), (100, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 10 for i in range(10, 61)}, 5: 5, 100: 5, 101: 5, 7: 7}


# ---------------------------------------------------------------- suffixes


@pytest.mark.parametrize("seed", range(8))
def test_suffix_array(seed):
    rng = np.random.default_rng(seed)
    depth = int(rng.choice([3, 8, 13, 40, 400]))
    text = rng.integers(97, 97 + int(rng.choice([1, 2, 26])), int(rng.integers(1, 700))).astype(np.uint8)
    if seed % 2:
        text = np.concatenate((text, text, text[:50]))
    raw = text.tobytes()
    sa, place = suffix.suffix_array(text, depth)
    assert np.array_equal(sa[place], np.arange(len(text)))
    keys = [raw[i : i + depth] for i in sa]
    assert keys == sorted(keys)
    lcp = suffix.common_prefixes(text, sa, place, depth, lane=int(rng.choice([4, 256])))
    for k in range(1, len(sa)):
        a, b = raw[sa[k - 1] :], raw[sa[k] :]
        n = 0
        while n < min(len(a), len(b), depth) and a[n] == b[n]:
            n += 1
        assert lcp[k] == n


def brute_removal(texts, length):
    count = Counter()
    raws = [(t or "").encode() for t in texts]
    for b in raws:
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for b in raws:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        out.append((len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("seed", "length", "knobs"), [(1, 400, {}), (2, 60, {}), (3, 60, {"shard_bytes": 3000, "spread": 3}), (4, 20, {"shard_bytes": 2000, "spread": 2})])
def test_repeats(spark, seed, length, knobs):
    texts = [*families(seed, 60, 90), "é" * 700, "ab" * 600, "abcabc", None, "", "q" * length]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:5] for r in op3_suffix.remove_repeats(df, length, **knobs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removal(texts, length)


def brute_passages(texts, words):
    where = defaultdict(list)
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        for at in range(len(w) - words + 1):
            where[tuple(w[at : at + words])].append((i, at))
    out = set()
    for v in where.values():
        if len({i for i, _ in v}) > 1 or v[-1][1] - v[0][1] >= words:
            out |= {i for i, _ in v}
    return out


@pytest.mark.parametrize(("seed", "words"), [(1, 51), (2, 20), (3, 4)])
def test_passages(spark, seed, words, monkeypatch):
    rng = random.Random(seed)
    one = " ".join(f"p{rng.randrange(50)}" for _ in range(words))
    # white space may differ; in one text twice, with and without overlap; one word short
    own = " ".join(f"q{i}" for i in range(words))
    texts = [*families(seed, 60, 90), f"a {one} b", one.replace(" ", "\n\t"), f"{own} {own}", " ".join(["z"] * (words + 1)), " ".join(["y"] * 2 * words), own.rsplit(" ", 1)[0], None, "", " "]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    assert {r.row for r in op3_suffix.passage_rows(rows, words).collect()} == brute_passages(texts, words)
    got = op3_suffix.remove_repeats(rows.withColumnRenamed("row", "doc_id"), 400, passages=words).collect()
    gone = {i for i, x in enumerate(brute_removal(texts, 400)) if x[1]}
    assert {r.doc_id for r in got if r.repeated} == brute_passages(texts, words) | gone and {r.doc_id for r in got if r.n_removed} == gone
    assert op3_suffix.passage_rows(rows.limit(0), words).count() == 0


def test_periodic_text_is_cut(spark, monkeypatch):
    monkeypatch.setattr(op3_suffix, "CUT", 100)
    texts = ["ab" * 1000, "x" + "ab" * 300, "abc" * 500, "q" * 99, "bc" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:5] for r in op3_suffix.remove_repeats(df, 60, shard_bytes=2000, spread=3).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removal(texts, 60)
    assert op3_suffix.cut_runs(np.array([0, 5]), 305, 100).tolist() == [0, 5, 105, 205]


def test_repeats_odd(spark):
    got = op3_suffix.remove_repeats(odd(spark), 400).collect()
    assert len(got) == len(ODD) and {r.n_bytes for r in got if r.doc_id in (1, 2)} == {0}
    text = "".join(chr(97 + i * i % 25) for i in range(300)) + "ä"
    rest = op3_suffix.remove_repeats(spark.createDataFrame([(1, "ü" + text + "1", 5), (2, text + "2", 6), (3, None, 7)], "doc_id long, text string, row int"), 300, rewrite=True)
    assert sorted(map(tuple, rest.collect())) == [(1, "ü1", 5), (2, "2", 6), (3, None, 7)]
    assert op3_suffix.remove_repeats(odd(spark).limit(0), 400).count() == 0


# ---------------------------------------------------------------- decontamination


def test_common_subsequence():
    rng = random.Random(0)
    for _ in range(60):
        a, b = ([rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randrange(1, 70))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert op10_decontaminate.common(op10_decontaminate.masks(a), len(a), b) == row[-1]


def test_decontamination(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    common = [f"c{i}" for i in range(30)]
    prose = lambda n: [rng.choice(common) if rng.random() < 0.5 else rng.choice(words) for _ in range(n)]
    items = [prose(n) for n in (12, 18, 25, 40, 60) * 4]
    texts, want = [], set()
    for i in range(160):
        body = prose(rng.choice([5, 40, 300]))
        if i % 4 == 0:
            k = i // 4 % len(items)
            leak = list(items[k])
            for _ in range((0, 0, 2)[i % 3]):
                leak[rng.randrange(len(leak))] = "other"
            at = rng.randrange(len(body))
            body[at:at] = leak
            want.add((i, k))
        texts.append(" ".join(body))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(98, None), (99, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in op10_decontaminate.leaks(docs, bench).collect()}
    every = [op10_decontaminate.Item(k, [w.encode() for w in x]) for k, x in enumerate(items)]
    brute = set()
    for i, t in enumerate(texts):
        w = t.encode().split()
        for item in every:
            step = max(1, item.n // 3)
            if any(op10_decontaminate.judge(item, w[a : a + 2 * item.n + step]) for a in range(0, len(w), step)):
                brute.add((i, item.id))
    assert want <= brute and len(brute - got) <= 0.05 * len(brute) and got <= brute
    kept = op10_decontaminate.without_leaks(docs, bench)
    assert {r.doc_id for r in kept.collect()} == set(range(160)) - {i for i, _ in got}


def test_most_common():
    rng = random.Random(1)
    known = op10_decontaminate.Vocabulary()
    items = [op10_decontaminate.Item(k, [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(n)]) for k, n in enumerate((1, 5, 30, 63, 64, 65))]
    text = [rng.choice([b"a", b"b", b"c", b"d", b"e"]) for _ in range(200)]
    raw = np.frombuffer(b" ".join(text), np.uint8)
    folded = (known.buckets(raw, np.array([0, len(raw)]))[0] // op10_decontaminate.FOLD).astype(np.int64)
    k, lo = np.arange(6), np.array([0, 150, 20, 0, 100, 0])
    got = op10_decontaminate.most_common(op10_decontaminate.bucket_masks(items, known), np.array([x.n for x in items]), k, folded, lo, lo + 50)
    want = [op10_decontaminate.common(x.masks, x.n, text[a : a + 50]) for x, a in zip(items, lo.tolist(), strict=True)]
    assert got[:5].tolist() == want[:5] and got[5] == 65


def test_decontamination_finds_what_judge_accepts(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    common = [f"c{i}" for i in range(40)]
    prose = lambda n: [rng.choice(common) if rng.random() < 0.5 else rng.choice(words) for _ in range(n)]
    items = [op10_decontaminate.Item(k, [w.encode() for w in prose(n)]) for k, n in enumerate((15, 20, 27, 31, 32, 38, 48, 59, 64, 70) * 3)]
    texts, want = [" ".join(prose(200)) for _ in range(300)], []
    for share in (0.0, 0.2, 0.3, 0.4, 0.45, 0.5):
        for item in items:
            for kind in range(4):
                leak = list(item.words)
                for at in rng.sample(range(item.n), round(share * item.n)):
                    leak[at] = b"new%d" % rng.randrange(10**9) if kind % 2 else rng.choice(words + common).encode()
                if op10_decontaminate.judge(item, leak):
                    want.append((len(texts), item.id, share))
                    texts.append(" ".join([*prose(rng.randrange(60)), *(w.decode() for w in leak), *prose(rng.randrange(60))]))
    sample = op10_decontaminate.fit_sample
    monkeypatch.setattr(op10_decontaminate, "fit_sample", lambda docs: sample(docs, 200))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(x.id, b" ".join(x.words).decode()) for x in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in op10_decontaminate.leaks(docs, bench).collect()}
    for share in sorted({x[2] for x in want}):
        some = [(i, k) in got for i, k, s in want if s == share]
        assert len(some) >= 20 and sum(some) >= 0.95 * len(some), (share, sum(some), len(some))


def test_decontamination_is_fitted_on_all_passages(spark, monkeypatch):
    """More documents than any sample held: the sketch is that of brute force over all of them."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    picks = rng.integers(0, len(words), (12000, 5))
    docs = spark.createDataFrame([(i, " ".join(words[k] for k in x)) for i, x in enumerate(picks.tolist())], "doc_id long, text string")
    seen, real = [], op10_decontaminate.sketch
    monkeypatch.setattr(op10_decontaminate, "sketch", lambda docs, idf, omega: seen.append((idf, omega, real(docs, idf, omega))) or seen[-1][2])
    op10_decontaminate.fit(docs)
    (idf, omega, y), raw = seen[0], np.frombuffer(" ".join(words).encode(), np.uint8)
    bucket = op10_decontaminate.Vocabulary().buckets(raw, np.array([0, len(raw)]))[0]
    a = np.zeros((len(picks), op10_decontaminate.VOCABULARY), np.float32)
    for k in range(5):
        a[np.arange(len(picks)), bucket[picks[:, k]]] += 1
    some = np.unique(bucket)
    a = a[:, some] * idf[some]
    a /= np.sqrt((idf[bucket[picks]] ** 2).sum(axis=1))[:, None]
    assert np.allclose(y[some], a.T @ (a @ omega[some]), rtol=1e-3, atol=1e-3 * np.abs(y).max())


def test_decontamination_pages_through_rows_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(op10_decontaminate, "ITEMS_AT_ONCE", 3)
    texts = [" ".join(f"{c}{i}" for i in range(20)) for c in "abcdefgh"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, t) for t in texts] + [(1, texts[0])] * 4 + [(2, texts[0]), (1, None), (None, texts[1])], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in op10_decontaminate.leaks(docs, bench).collect())
    assert got == {(0, 1): 5, (0, 2): 1, **{(i, 1): 1 for i in range(1, 8)}}


def test_decontamination_odd(spark):
    bench = spark.createDataFrame([(1, "a b c d"), (2, None)], "item_id long, text string")
    got = op10_decontaminate.leaks(odd(spark), bench).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(None, 1)]
    assert op10_decontaminate.leaks(odd(spark).limit(0), bench).count() == 0
    assert op10_decontaminate.leaks(odd(spark), bench.limit(0)).count() == 0


# ---------------------------------------------------------------- pipeline


def test_repeats_of_short_words(spark, sf):
    import corpus_pipeline as p

    rng = random.Random(4)
    short = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    yes, no, inner = short(51), short(50), short(60)
    texts = [f"one {yes} two", f"three\n{yes}", f"four {no} five", f"six {no} seven", f"é {inner} x {inner}", None, yes[:-1] + "é", short(400), "the " * 60]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in p.repeats(spark, docs, sf).collect()}
    want = ["one  two", "three\n", *texts[2:4], "é  x ", None, *texts[6:]]
    assert {i: got[i][0] for i in got} == dict(enumerate(want)) and all(n is None or n == len(t) for t, n in got.values())


def test_stages_keep_documents_without_an_id(spark, sf):
    import corpus_pipeline as p

    rng = random.Random(2)
    text = lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(80))
    item, one, two = text(), text(), text()
    docs = spark.createDataFrame([(1, one), (2, one), (None, two), (None, f"{text()} {item}"), (3, f"{item} {text()}")], "doc_id long, text string")
    kept = p.near_duplicates(spark, docs, sf).collect()
    assert sorted((r.doc_id, r.text == two) for r in kept if r.doc_id) == [(1, False), (3, False)] and sum(r.doc_id is None for r in kept) == 2
    clean = op10_decontaminate.without_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in clean) == [(0, two), (1, one), (2, one)]


def test_pipeline_fits_decontamination_on_all_it_gets(spark, sf, monkeypatch):
    """More documents than any sample held, repeated and null ids among them."""
    import corpus_pipeline as p

    seen, real = [], op10_decontaminate.sketch
    monkeypatch.setattr(op10_decontaminate, "sketch", lambda docs, idf, omega: seen.append(docs.count()) or real(docs, idf, omega))
    docs = spark.range(12000).selectExpr("nullif(id % 11000, 5) AS doc_id", "concat('w', id % 50, ' x', id % 7, ' y', id) AS text")
    assert p.decontamination(spark, docs, sf).count() == 12000
    assert seen == [12000]


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = []
    for name, stage in p.STAGES:
        docs = p.materialize(stage(spark, docs, sf), name)
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != "mixing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "near_duplicates":
            rows = sorted((r.doc_id, r.text) for r in docs.collect())
            assert all(c == i for i, (_, c) in brute_components([t for _, t in rows], 5, 80).items())
        if name == "repeats":
            seen = defaultdict(set)
            for i, (d, t) in enumerate(rows):
                for at in range(0, len(t.encode()) - 249):
                    seen[t.encode()[at : at + 250]].add((i, at))
            want = {d: brute for (d, _), brute in zip(rows, brute_removal([t for _, t in rows], 250), strict=True)}
            got = {r.doc_id: len(r.text.encode()) for r in docs.collect()}
            assert all(abs(got[d] - (w[0] - w[1])) <= 2 * w[2] for d, w in want.items())
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and len(ids[0]) > len(ids[-1]) > 0
    again = p.run(spark, sf)
    assert {r.doc_id for r in again.select("doc_id").collect()} == ids[-1]
