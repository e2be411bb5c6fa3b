"""Toxicity, language, licences, HTML, chat, media and mixing: small cases with defined results."""

import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import same
from pyspark.sql import functions as F

from ragmill.llm import jpeg, op1_toxicity, op4_media, op5_language, op6_mixing, op7_html, op8_license, op9_chat, registry

ODD = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "y z"), (4, "wörd " * 20000), (5, "١٢ 12 !!")]


def odd(spark):
    """Nulls, empty, repeated and long texts, and columns whose names clash with those that operators make."""
    rows = [(i, t, None if i == 2 else "en", "s", 7, "r", 9) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int, row string, n int")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_agrees_with_sql(spark, sf, name):
    same(registry.QUERIES[name](spark, sf), registry.ORACLE_SQL[name], sf)


# ---------------------------------------------------------------- toxicity


def test_toxicity_held_out(spark, sf):
    d = "/root/testdata/sf0.01"
    got = registry.QUERIES["op1_toxicity"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    toxic = held.toxic == 1
    assert (held.predicted == held.toxic).mean() > (~toxic).mean()  # the constant 0
    ranks = held.score.rank()
    auc = (ranks[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert held.predicted[toxic].mean() >= 0.75 and auc > 0.95
    assert set(got[got.held_out].doc_id) == {i for i in got.doc_id if zlib.crc32(str(i).encode()) % 5 == 0}


def plain_buckets(text):
    """Buckets of the n-grams of a text, one character at a time."""
    chars, out, most = [ord(c) for c in " " + text.lower() + " "], set(), 2**32
    for n in op1_toxicity.ORDERS:
        for at in range(len(chars) - n + 1):
            h = chars[at]
            for c in chars[at + 1 : at + n]:
                h = (h * 0x9E3779B1 + c) % most
            out.add(((h ^ (h >> 15)) * (0x85EBCA6B + 2 * n) % most) >> (32 - op1_toxicity.BITS))
    return out


def test_toxicity_scores_one_by_one():
    good, bad = [f"a fine day in town {i} with tea" for i in range(80)], [f"you idiot clown {i} go away" for i in range(60)]
    model = op1_toxicity.fit(good + bad, np.array([0] * 80 + [1] * 60))
    scratch = np.zeros(1 << op1_toxicity.BITS, np.int32)
    n1, n0 = Counter(), Counter()
    for texts, n in ((bad, n1), (good, n0)):
        for t in texts:
            n.update(plain_buckets(t))
    for text in ("", "x", "an IDIOT in town", "ärger über alles 😀 idiot", good[0], bad[0]):
        g = plain_buckets(text)
        used = [b for b in g if model.used[b]]
        z = model.bias + sum(float(model.weight[b]) for b in used) / math.sqrt(1 + len(used))
        assert model.score(text, scratch) == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-6)
        for b in used:  # what is used tells the labels apart, and its ratio is that of the counts
            ratio = math.log((n1[b] + 1) / 62) - math.log((n0[b] + 1) / 82)
            assert abs(ratio) / math.sqrt(1 / (n1[b] + 1) + 1 / (n0[b] + 1)) >= 3 - 1e-9


def test_samples_are_bounded(spark):
    docs = spark.createDataFrame([(i % 7, f"text {i}", "en" if i % 9 else "de") for i in range(900)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)] * 3, "doc_id long, toxic int")
    texts, toxic = op1_toxicity.training_rows(docs, labels, per_class=2)
    assert len(texts) <= 4 and set(toxic) == {0, 1}
    got = op5_language.training_rows(docs, per_language=5, excerpt=3)
    assert Counter(got[1]) == {"de": 5, "en": 5} and all(len(t) == 3 for t in got[0])
    many = spark.createDataFrame([(i, "abc", f"l{i % 300}") for i in range(1500)], "doc_id long, text string, lang string")
    assert len(set(op5_language.training_rows(many)[1])) == 300


def toxic_rows(n):
    """Documents and labels, more of each class than any sample held; words of the last rows stand in no others."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(40)]
    label = np.arange(n) % 2
    picks = np.where(label[:, None] > 0, rng.integers(0, 30, (n, 5)), rng.integers(10, 40, (n, 5)))
    texts = [" ".join(words[k] for k in x) + (f" late{lab}" if i >= n - 600 else "") for i, (x, lab) in enumerate(zip(picks.tolist(), label, strict=True))]
    return texts, label


def test_toxicity_learns_from_all_labelled_rows(spark):
    """The model is that of one process over all rows: repeated, null and unlabelled ones and very long texts among them."""
    texts, label = toxic_rows(8000)
    texts[7] = "clown " * 20_000
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([*rows, (5, "zzz"), (3, None), (None, "w1"), (9000, "w2 unlabelled")], "doc_id long, text string")
    labels = spark.createDataFrame([*enumerate(label.tolist()), (4, 0), (6, None), (None, 1), (9500, 1)], "doc_id long, toxic int")
    got = op1_toxicity.fit_all(docs.repartition(7), labels)
    some = [i for i in range(8000) if zlib.crc32(str(i).encode()) % 5]
    want = op1_toxicity.fit([texts[i] for i in some], label[some])
    assert (got.used == want.used).all() and got.bias == pytest.approx(want.bias, abs=1e-6)
    assert got.weight == pytest.approx(want.weight, abs=1e-6)
    empty = docs.limit(0)
    assert op1_toxicity.fit_all(empty, labels).bias < 0 and op1_toxicity.fit_all(docs, labels.where("toxic = 1")).bias > 0


def test_toxicity_sums_reach_the_driver_once(spark, monkeypatch):
    """However many tasks add to a sum, the driver is sent one vector; the weights it sends out are gone after each pass."""
    from pyspark import SparkContext

    def run(batches):
        ids = np.concatenate([np.zeros(0, np.int64), *(b.column(0).to_numpy() for b in batches)])
        return np.bincount(ids % 999, minlength=999) * 0.5 if len(ids) else None

    rows, got, sent = spark.range(0, 3000, 1, 40).where("id < 2900"), [], []
    collect, broadcast = type(rows).collect, SparkContext.broadcast
    monkeypatch.setattr(type(rows), "collect", lambda self: got.append(collect(self)) or got[-1])
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append((value, broadcast(self, value))) or sent[-1][1])
    assert op1_toxicity.added(rows, run, 999).tolist() == (np.bincount(np.arange(2900) % 999) * 0.5).tolist()
    assert len(got) == 1 and sum(len(r.part) for r in got[0]) <= 8 * (999 + op1_toxicity.BLOCKS)
    assert not op1_toxicity.added(rows.limit(0), run, 999).any()
    texts, label = toxic_rows(300)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    op1_toxicity.fit_all(docs.repartition(7), spark.createDataFrame(list(enumerate(label.tolist())), "doc_id long, toxic int"))
    paths = [b._path for value, b in sent if isinstance(value, np.ndarray)]
    assert paths and not any(os.path.exists(x) for x in paths)


def test_query_and_pipeline_learn_from_all_labelled_rows(spark, tmp_path, monkeypatch):
    """Both score with the model of all rows, not of some of each class."""
    import corpus_pipeline

    texts, label = toxic_rows(8000)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(label.tolist())), "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    some = [i for i in range(8000) if zlib.crc32(str(i).encode()) % 5]
    want = op1_toxicity.fit([texts[i] for i in some], label[some])
    seen, real = [], op1_toxicity.score_toxicity
    monkeypatch.setattr(op1_toxicity, "score_toxicity", lambda docs, model, **more: seen.append(model) or real(docs, model, **more))
    op1_toxicity.op1_toxicity(spark, str(tmp_path))
    corpus_pipeline.toxicity(spark, docs, str(tmp_path))
    assert len(seen) == 2
    for got in seen:
        assert (got.used == want.used).all() and got.weight == pytest.approx(want.weight, abs=1e-6)


def test_toxicity_fit_is_the_minimum():
    """No small step along the gradient or at random lowers the loss by much; packed features come back."""
    texts, label = toxic_rows(1200)
    model, scratch = op1_toxicity.fit(texts, label), np.zeros(1 << op1_toxicity.BITS, np.int32)
    x, y = np.zeros((len(texts), int(model.used.sum()))), label.astype(float)
    to = np.cumsum(model.used) - 1
    for i, t in enumerate(texts):
        g = op1_toxicity.grams(t, scratch)
        x[i, to[g[model.used[g]]]] = 1
    df = [x[y == k].sum(axis=0) for k in (0, 1)]
    r = np.log((df[1] + 1) / (y.sum() + 2)) - np.log((df[0] + 1) / ((1 - y).sum() + 2))
    x *= r / np.sqrt(1 + x.sum(axis=1))[:, None]
    weigh = np.where(y > 0, 0.25 / y.sum(), 0.75 / (1 - y).sum())

    def slope(w, b):
        err = weigh * (1 / (1 + np.exp(-(x @ w + b))) - y)
        return np.append(x.T @ err + 1e-4 * w, err.sum())

    start = slope(np.full(len(r), 0.02), math.log(y.sum() / (1 - y).sum()))
    assert np.linalg.norm(slope(model.weight[model.used] / r, model.bias)) <= 2e-3 * np.linalg.norm(start)
    lists = [[], [0], [254, 255, 256, 262143], [3, 258, 513], [262143]]
    raw = [op1_toxicity.packed(np.array(c, np.int32)) for c in lists]
    size, cols = op1_toxicity.unpacked(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert size.tolist() == [len(c) for c in lists] and cols.tolist() == sum(lists, [])


def test_toxicity_odd(spark):
    model = op1_toxicity.fit(["you idiot clown " + str(i) for i in range(200)] + ["a fine day " + str(i) for i in range(200)], np.array([1] * 200 + [0] * 200))
    got = op1_toxicity.score_toxicity(odd(spark), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    kept = op1_toxicity.score_toxicity(spark.createDataFrame([(1, "such an idiot clown", 5), (2, "a fine day", 6)], "doc_id long, text string, score int"), model, keep=True)
    assert [tuple(r) for r in kept.collect()] == [(2, "a fine day", 6)]
    assert op1_toxicity.score_toxicity(odd(spark).limit(0), model).count() == 0
    assert op1_toxicity.fit([], np.array([])).score("x", np.zeros(1 << op1_toxicity.BITS, np.int32)) < 0.5
    assert op1_toxicity.fit(["x"], np.array([1])).score("", np.zeros(1 << op1_toxicity.BITS, np.int32)) > 0.5


# ---------------------------------------------------------------- language


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in op5_language.init(3, 4).items()}
    x = rng.integers(0, 257, (9, 5)).astype(np.int16)
    x[7:, 2] = op5_language.PAD
    y = rng.integers(0, 3, 5)
    _, g = op5_language.gradients(p, x, y)
    for name in p:
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in p[name].shape)
            if name[0] == "e":
                at = (int(x[rng.integers(9), rng.integers(5)]), at[1])
            keep, eps = p[name][at], 1e-2
            p[name][at] = keep + eps
            up = op5_language.gradients(p, x, y)[0]
            p[name][at] = keep - eps
            down = op5_language.gradients(p, x, y)[0]
            p[name][at] = keep
            assert g[name][at] == pytest.approx((up - down) / (2 * eps), abs=2e-3), name


def one_gru(p, d, symbols):
    """States of one direction, a byte at a time."""
    k = p["u" + d].shape[0]
    h, out = np.zeros(k), []
    sigmoid = lambda a: 1 / (1 + np.exp(-a))
    for s in symbols:
        a, u = p["e" + d][s].astype(float), p["u" + d].astype(float)
        z, r = sigmoid(a[:k] + h @ u[:, :k]), sigmoid(a[k : 2 * k] + h @ u[:, k : 2 * k])
        n = np.tanh(a[2 * k :] + (r * h) @ u[:, 2 * k :])
        h = (1 - z) * n + z * h
        out.append(h)
    return np.array(out)


def test_language_pools_every_position():
    model = op5_language.fit(["the and of house " * 30, "der und die häuser " * 30], ["en", "de"], steps=60)
    pad = [op5_language.PAD] * op5_language.CONTEXT
    rng = np.random.default_rng(5)
    texts = ["a", "der und the", "über die häuser of " * 3, *(" ".join(rng.choice(["the", "und", "häuser", "of", "über"], n)) for n in (60, 400))]
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    got = model.pooled(np.concatenate(raw), np.concatenate(([0], np.cumsum([len(r) for r in raw]))), lanes=7)
    wide = op5_language.WINDOW
    for r, g in zip(raw, got, strict=True):
        padded, total = [*pad, *r.tolist(), *[op5_language.PAD] * wide, *pad], np.zeros(2)
        for at in range(0, len(r), wide):  # each stretch with the bytes around it
            symbols = padded[at : at + wide + 2 * len(pad)]
            h = np.concatenate((one_gru(model.params, "f", symbols), one_gru(model.params, "b", symbols[::-1])[::-1]), axis=1)
            e = np.exp(h @ model.params["o"] + model.params["ob"])
            total += (e / e.sum(axis=1, keepdims=True))[len(pad) : len(pad) + min(wide, len(r) - at)].sum(axis=0)
        assert g == pytest.approx(total / len(r), abs=1e-5)


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = registry.QUERIES["op5_language_id"](spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95


def test_language_odd(spark):
    model = op5_language.fit(["the and of " * 30, "der und die " * 30], ["en", "de"], steps=40)
    got = {(r.doc_id, r.lang_pred) for r in op5_language.identify_language(odd(spark), model).collect()}
    assert {(1, "und"), (2, "und"), (5, "und")} <= got and all(p in ("en", "de") for i, p in got if i in (3, 4, None))
    assert op5_language.identify_language(odd(spark).limit(0), model).count() == 0
    assert op5_language.fit([], []).languages == ["und"]


# ---------------------------------------------------------------- media


@pytest.mark.parametrize("seed", range(6))
def test_jpeg_round_trip(seed):
    rng = np.random.default_rng(seed)
    files = []
    for _ in range(12):
        n = int(rng.integers(1, 20)) * 64
        kind = int(rng.integers(0, 4))
        a = rng.integers(0, 256, n) if kind == 0 else rng.choice([0, 0, 0, 0, 0, 0, 1, 255, 2, 128, 127], n) if kind == 1 else rng.choice([0, 1, 255], n, p=[0.97, 0.02, 0.01]) if kind == 2 else np.zeros(n)
        files.append(a.astype(np.uint8).tobytes())
    blocks = np.array([len(f) // 64 for f in files])
    coded = jpeg.encode(np.frombuffer(b"".join(files), np.uint8), blocks)
    coef, images, first = jpeg.coefficients(coded)
    assert all(jpeg.payload_of(coef, im, f)[: len(p)] == p for p, im, f in zip(files, images, first, strict=True))
    alone = jpeg.decode(coded[:1])[0]
    assert np.array_equal(alone, jpeg.decode(coded)[0])


def test_jpeg_wide_grid():
    blocks = 6 * jpeg.MOST_ROWS + 5
    data = np.random.default_rng(1).integers(0, 256, blocks * 64).astype(np.uint8)
    coded = jpeg.encode(data, np.array([blocks]))
    coef, images, first = jpeg.coefficients(coded)
    assert images[0].mcux == 2 and jpeg.payload_of(coef, images[0], first[0])[: len(data)] == data.tobytes()


def test_inverse_transform():
    coef = np.zeros((1, 64))
    coef[0, 0] = 80
    assert np.allclose(coef @ jpeg.BASIS / (1 << jpeg.SHIFT), 10)
    x = np.arange(8)
    wave = np.cos((2 * x + 1) * 3 * np.pi / 16)
    coef[:] = 0
    coef[0, np.flatnonzero(jpeg.ZIGZAG == 3)[0]] = 8  # three half waves along a row
    want = np.tile(8 * wave / 2 * np.sqrt(1 / 8), (8, 1))
    assert np.allclose((coef @ jpeg.BASIS / (1 << jpeg.SHIFT)).reshape(8, 8), want, atol=1e-4)


def test_media(spark):
    got = op4_media.text_media(odd(spark)).collect()
    text = {i: t for i, t in ODD}
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64) or b"\0" * 64
        assert (r.n_bytes, r.payload, r.payload_sha256, r.tail_crc32) == (len(raw), padded, hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.media_bytes == len(r.media) and hashlib.sha256(r.media).hexdigest() == r.media_sha256 and len(r.tensor) == r.width * r.height * 3
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id == 3}) == 1
    back = op4_media.decode_media(spark.createDataFrame([(1, got[0].media), (2, b"junk"), (3, None)], "id long, media binary"), "id", "media").collect()
    assert {r.id: r.tensor for r in back} == {1: got[0].tensor, 2: None, 3: None}
    assert op4_media.text_media(odd(spark).limit(0)).count() == 0


# ---------------------------------------------------------------- licences


def test_license_odd(spark):
    rows = [(1, "text\nReleased under the MIT License.\nmore"), (2, "RELEASED under the mit   license"), (3, "released under the"), (4, None), (5, ""), (None, "All rights reserved."), (6, "All rights reserved.\nAll rights reserved.")]
    got = {(r.doc_id, r.license, r.dice, r.n_units) for r in op8_license.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT", 1.0, 4), (2, "MIT", 1.0, 1), (None, "Proprietary", 1.0, 1), (6, "Proprietary", 1.0, 3)}
    assert op8_license.license_scan(odd(spark)).count() == 0
    assert op8_license.license_scan(odd(spark).limit(0)).count() == 0


def test_license_notices_over_lines(spark):
    grant = next(t for n, t in op8_license.TEMPLATES if n == "MIT" and "sublicense" in t).split()
    block = "\n".join(" * " + " ".join(grant[i : i + 9]) for i in range(0, len(grant), 9))
    rows = [(1, f"int a;\n\n{block}\n\nint b;\nint c;"), (2, "code here\n# Released under\n# the MIT\n# License.\nmore of the code here"), (3, "code of one kind\n# Released under\n# any other\n# License.\nmore of the code"), (4, f"no blank line about {block} so it stays unseen " + "other words that follow on " * 30)]
    got = {r.doc_id: (r.license, r.dice) for r in op8_license.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] == ("MIT", 1.0) and 3 not in got


def test_license_bounds():
    """Words left out of the first look never decide: what lacks the others is below the least Dice."""
    for _, text in op8_license.TEMPLATES:
        grams = op8_license.bigrams_of(text)
        lo, hi = op8_license.bounds(len(grams), 0.8)
        for n in range(1, 400):
            best = 2 * min(n, len(grams)) / (n + len(grams))
            assert (best >= 0.8 - 1e-12) == (lo <= n <= hi)
        bare = [g for g in grams if set(g.split()) <= op8_license.COMMON]
        assert 2 * len(bare) / (len(bare) + len(grams)) < 0.8


# ---------------------------------------------------------------- HTML


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a = "</p>";</script></head><body><header><a>Site</a></header>
<nav><ul><li>Home<li>About</ul></nav><div class="cookie-notice">We use cookies</div><article><h1>A &amp; B</h1><p>One <b>two</b><br>three<p>four
 five<aside>see also</aside><form>Sign up</form><div class="ad">Buy</div><p>tail &lt;x&gt;</p></article><section class="comments"><p>nice</p></section><footer>end</footer>"""


def test_html(spark):
    rows = [(1, "http://h/a", PAGE, 3), (2, "http://h/b", None, 3), (3, None, "", 3), (4, "http://h/c", "plain <b>text</b> only", 3), (4, "http://h/c", "plain <b>text</b> only", 3), (5, "x", "<p>" + "word " * 50000, 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = op7_html.extract_main_text(df).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert text[1] == "A & B\nOne two three\nfour five\ntail <x>" and text[2] == text[3] == "" and text[4] == "plain text only"
    assert len(text[5]) == 50000 * 5 - 1 and all(r.n_chars == len(r.text) for r in got)
    assert op7_html.extract_main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p class=it's>I don't know</p>", "I don't know"),
        ('<p title="5" 6">hello', "hello"),
        ("<body><form action=x><div><h1>All</h1><p>in a form</p></div></form></body>", "All\nin a form"),
        ("<form>Sign up</form><p>text</p>", "text"),
        ('<p title="never ends>text</p><p>more</p>', "text\nmore"),
        ("<a href=x/>y</a> <p a = \"1>2\" b='>'>z", "y\nz"),
        ("<p data-x=\"class='ad'\">kept</p><p CLASS='Ad'>gone</p><p hidden>gone</p><p aria-hidden=TRUE>gone</p>", "kept"),
        ("a < b <3 c<", "a < b <3 c<"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>flat", "deep\nflat"),
    ],
)
def test_html_as_it_is_found(spark, page, want):
    got = op7_html.extract_main_text(spark.createDataFrame([(1, "http://h/", page)], "page_id long, url string, html string")).collect()
    assert [r.text for r in got] == [want]


def test_importance_as_counted_one_by_one(spark):
    rng = np.random.default_rng(3)
    pages = []
    for i in range(12):
        extra = "".join(f"<li>entry {rng.integers(4)}" for _ in range(rng.integers(3)))
        pages.append((i, f"http://h{i % 3 // 2}/{i}", f"<body><div class='b a'><p>same</p><ul>{extra}</ul></div><main><h1>Title {i}</h1><p>text {i // 2}</p>{'<table><td>x</table>' if i % 2 else ''}</main></body>"))
    parsed = op7_html.parsed_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), "page_id", "url", "html").withColumn("host", op7_html.host_of(F.col("url")))
    got = {(r.host, r.branch): (r.pages, r.presentation, r.content) for r in op7_html.style_trees(parsed).collect()}
    want = {}
    for host in ("h0", "h1"):
        trees = [op7_html.parse(h) for _, u, h in pages if f"//{host}/" in u]
        chain = {leaf: c for _, leaves, _ in trees for leaf, (c, _) in leaves.items()}
        stands = defaultdict(set)  # pages by leaf and text
        for k, (blocks, _, _) in enumerate(trees):
            for leaf, *_, text in blocks:
                stands[leaf, text].add(k)
        total = len(trees)
        for at in {x for c in chain.values() for x in c}:
            below = [len(v) for (leaf, _), v in stands.items() if at in chain[leaf]]
            mean = sum(math.log(k) for k in below) / len(below) / math.log(total)
            styles = Counter(style for _, _, nodes in trees for b, style, _ in nodes if b == at)
            n = sum(styles.values())
            look = -sum(k / n * math.log(k / n) for k in styles.values()) / math.log(n) if n > 1 else 1.0
            want[host, at] = (total, pytest.approx(look, abs=1e-9), pytest.approx(1 - mean * total / (total + op7_html.PRIOR), abs=1e-9))
    assert got == want


def test_style_tree_removes_what_all_pages_share(spark):
    pages = [(i, f"http://site/{i}", f"<html><body><div><p>Every page says this</p></div><section><p>Page {i} says {i * i}</p></section></body></html>") for i in range(30)]
    got = op7_html.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"Page {i} says {i * i}" for i in range(30)}
    # without the tree it stays: markup and names tell nothing here
    bare = op7_html.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string"), least=-1).collect()
    assert all(r.text.startswith("Every page") for r in bare)
    few = op7_html.extract_main_text(spark.createDataFrame(pages[:3], "page_id long, url string, html string")).collect()
    assert all(r.text.startswith("Every page") for r in few)


def test_style_tree_works_in_articles(spark):
    page = lambda i, root: f"<html><body><div class='wrap'><p>Site name</p><{root}><div class='x1'><p>All pages say this</p></div><h1>Page {i}</h1><p>It says {i * i}</p></{root.split()[0]}></div></body></html>"
    pages = [(i, f"http://{host}/{i}", page(i, root)) for host, root in (("a", "article"), ("b", "main class='c/d'"), ("c", "div role=main"), ("d", "my-page role=main")) for i in range(20)]
    pages += [(100 + i, f"http://e/{i}", page(7, "article")) for i in range(20)]
    got = op7_html.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert all(r.text == f"Page {r.page_id}\nIt says {r.page_id ** 2}" for r in got if r.page_id < 100)
    # copies of one page keep their article
    assert {r.text for r in got if r.page_id >= 100} == {"All pages say this\nPage 7\nIt says 49"}


# ---------------------------------------------------------------- chat


def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "hi", 1.0), (1, 2, 1, "assistant", "bad", 0.0), (1, 3, 1, "assistant", "good </s>", 5.0), (1, 4, 3, "user", None, None), (2, 1, 2, "user", "loop", 0.0), (2, 2, 1, "user", "loop", 0.0), (2, 3, 2, "user", "below", 0.0), (3, 1, 99, "assistant", "<\\s> [INST] [\\INST]", 0.0)]
    df = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, role string, text string, score double").withColumn("at", F.lit(0))
    best = {r.tree_id: r for r in op9_chat.format_conversations(df, 1).withColumn("turns", op9_chat.read_turns(F.col("formatted"))).withColumn("loss", op9_chat.read_loss(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert set(best) == {1, 3}
    assert [tuple(t) for t in best[1].turns] == [("user", "hi"), ("assistant", "good </s>"), ("user", "")] and best[1].loss == "good </s>"
    assert best[3].loss == "<\\s> [INST] [\\INST]"
    assert op9_chat.format_conversations(df, None).where("tree_id = 1").count() == 2
    assert op9_chat.format_conversations(df.limit(0)).count() == 0


def test_deep_path(spark):
    rows = [(1, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(100)]
    df = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, role string, text string, score double")
    one = op9_chat.format_conversations(df).select(op9_chat.read_turns(F.col("formatted")).alias("t")).first()
    assert [x.text for x in one.t] == [str(i) for i in range(100)]


@pytest.mark.parametrize("text", ["", "plain", "</s>", "<\\/s>", "<\\\\/s>", "<<s>>", "[INST][/INST]", "[[INST]", "<|im_end|>\n", "<|\\im_end|>", "\\", "<</SYS>>", "a\x01b"])
def test_escape(spark, text):
    col = F.lit(text)
    r = spark.range(1).select(op9_chat.unescape(op9_chat.escape(col)).alias("back"), op9_chat.escape(col).alias("out")).first()
    assert r.back == text and not any(c in r.out for c in op9_chat.CONTROL)


# ---------------------------------------------------------------- mixing


def mixed_rows(spark):
    rows = [(i, "word " * (20 + i % 7) + ("12345678" if i % 5 == 0 else ""), ("en", "de", None)[i % 3], "hot" if i % 4 else "cold") for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def cells_of(spark):
    docs = op6_mixing.with_cells(mixed_rows(spark), "m")
    return docs.groupBy(*(F.col(f"m.{d}").alias(d) for d in op6_mixing.DIMS)).agg(F.sum("m.tokens").alias("tokens"))


def test_raking_meets_every_marginal(spark):
    cells = cells_of(spark)
    targets = op6_mixing.tempered_targets(cells)
    raked, miss = op6_mixing.rake(cells, targets)
    assert miss <= op6_mixing.CLOSE
    for d in op6_mixing.DIMS:
        want = {r[0]: r[1] for r in targets[d].collect()}
        got = {r[0]: r[1] for r in raked.groupBy(d).agg(F.sum("weight")).collect()}
        assert len(got) > 1 and got == pytest.approx({k: v / sum(want.values()) for k, v in want.items()}, rel=1e-8)
    prob = op6_mixing.calibrate(raked, 0.5).join(raked.select(*op6_mixing.DIMS, "tokens", "weight"), list(op6_mixing.DIMS)).collect()
    assert all(0 <= r.prob <= 1 for r in prob) and sum(r.prob * r.tokens for r in prob) == pytest.approx(0.5 * sum(r.tokens for r in prob), rel=1e-9)
    rates = [r.prob * r.tokens / r.weight for r in prob if r.prob < 1]
    assert max(rates) == pytest.approx(min(rates), rel=1e-9)


def test_raking_as_numpy_does_it(spark):
    cells = cells_of(spark)
    targets = op6_mixing.tempered_targets(cells)
    got = {tuple(r[:3]): r.weight for r in op6_mixing.rake(cells, targets)[0].collect()}
    rows = cells.collect()
    w = np.array([float(r.tokens) for r in rows])
    for _ in range(200):
        for k, d in enumerate(op6_mixing.DIMS):
            t = {r[0]: r[1] for r in targets[d].collect()}
            for v in t:
                at = np.array([r[k] == v for r in rows])
                w[at] *= t[v] / sum(t.values()) / w[at].sum()
        if _ > 30:
            break
    assert got == pytest.approx({tuple(r[:3]): x for r, x in zip(rows, w, strict=True)}, rel=1e-7)


def test_raking_gives_up_on_targets_that_cannot_be_met(spark):
    cells = spark.createDataFrame([("a", "x", "t", 10), ("b", "y", "t", 10)], "source string, lang string, topic string, tokens long")
    targets = {d: spark.createDataFrame(rows, f"{d} string, target double") for d, rows in (("source", [("a", 0.9), ("b", 0.1)]), ("lang", [("x", 0.1), ("y", 0.9)]), ("topic", [("t", 1.0)]))}
    _, miss = op6_mixing.rake(cells, targets, passes=2)
    assert miss > 1
    none = {d: spark.createDataFrame([], f"{d} string, target double") for d in op6_mixing.DIMS}
    assert {r.prob for r in op6_mixing.calibrate(op6_mixing.rake(cells, none)[0]).collect()} == {0.0}


def test_mixing_odd(spark):
    got = op6_mixing.mix(odd(spark), 1.0)
    assert got.columns == [*odd(spark).columns, "mix"] and all(r.mix.tokens > 0 and r.mix.prob == 1 for r in got.collect())
    assert {r.doc_id for r in got.collect()} == {3, None, 4, 5} and got.where("doc_id = 3").count() == 2
    assert op6_mixing.mix(odd(spark).limit(0)).count() == 0
    clash = odd(spark)
    for name in ("mix", "MIX_", "_tokens", "_source", "_prob", "mix_source", "mix_prob", "weight", "topic"):
        clash = clash.withColumn(name, F.lit(5))
    got = op6_mixing.mix(clash, 1.0, topic=F.col("row"))
    assert got.columns == [*clash.columns, "mix__"] and {r["mix__"].topic for r in got.collect()} == {"r"} and {r["_tokens"] for r in got.collect()} == {5}
