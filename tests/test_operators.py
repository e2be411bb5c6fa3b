import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ragmill.functions import pages as pg
from ragmill.functions import text as tx
from ragmill.functions.runs import Runs
from ragmill.functions.vectors import HashingEmbedder, batch_size, fixed_batch_size
from ragmill.operators import retrieve
from ragmill.operators import chunk as ck
from ragmill.operators import results as rs
from ragmill.operators.ranks import percentiles
from ragmill.operators.retrieve import knn
from ragmill.sources import readers, writers


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def texts(df):
    return [r.text for r in df.orderBy("doc_id", "chunk_pos").collect()]


def test_sentences(spark):
    five = docs(spark, "Sentence a. Sentence b. Sentence c. Sentence d. Sentence e.")
    assert texts(ck.by_sentence(five, 2)) == ["Sentence a. Sentence b.", "Sentence c. Sentence d.", "Sentence e."]
    assert len(texts(ck.by_sentence(five, 10))) == 1
    assert texts(ck.by_sentence(docs(spark, "", None), 2)) == []
    with pytest.raises(ValueError):
        ck.by_sentence(five, 0)
    long = docs(spark, "x" * 2500)
    assert [len(x) for x in texts(ck.by_sentence(long, 1))] == [1000, 1000, 500]


def test_fixed(spark):
    assert texts(ck.fixed(docs(spark, "a short text", "", None), 64, 16)) == ["a short text"]
    words = [f"w{i}" for i in range(100)]
    got = texts(ck.fixed(docs(spark, " ".join(words)), 10, 3))
    want, at = [], 0
    while True:
        want.append(" ".join(words[at : at + 10]))
        if at + 10 >= 100:
            break
        at += 7
    assert got == want
    with pytest.raises(ValueError):
        ck.fixed(docs(spark, "a"), 5, 5)


def test_recursive(spark):
    text = "one two three.\n\nfour five six seven.\nEight nine ten eleven twelve."
    got = texts(ck.recursive(docs(spark, text, "", None), 5, 0))
    assert all(got) and len(got) == len(set(got))
    assert "".join("".join(got).split()) == "".join(text.split())
    count = lambda x: len(x.split())
    assert all(count(c) <= 5 for c in got)
    assert ck.recursive_split("abcdef", 2, 0, len) == ["ab", "cd", "ef"]
    assert ck.recursive_split("a b c d", 4, 2, len) == ["a b", "b c", "c d"]


@given(st.text(alphabet="ab \n.é_\u2003\t", max_size=60), st.integers(1, 6), st.integers(0, 5))
@settings(max_examples=1500, deadline=None)
def test_tokens_are_counted_once(text, size, overlap):
    assert ck.token_split(text, size, overlap) == ck.recursive_split(text, size, overlap, lambda x: len(ck.TOKEN.findall(x)))


def test_percentiles(spark):
    """As the exact aggregate has them: ties, a group of one value, of nulls, of few and of many rows, a null key, NaN."""
    rng = np.random.default_rng(5)
    rows = [(k, float(v)) for k, n in (("many", 5000), ("few", 3), (None, 40)) for v in rng.normal(size=n)]
    rows += [("ties", float(v)) for v in rng.integers(0, 3, 900)] + [("one", 7.0), ("none", None), ("same", 1.5), ("same", 1.5), ("few", None)]
    rows += [("odd", float("nan")), ("odd", float("inf")), ("odd", 1.0), ("odd", -0.5), ("odd", float("-inf"))]
    d = spark.createDataFrame(rows, "k string, v double").repartition(5)
    at = [0.0, 0.25, 0.5, 0.9, 0.333, 1.0]
    want = {r.k: r.p for r in d.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, at))).alias("p")).collect()}
    got = {r.k: list(r)[1:] for r in percentiles(d, "k", "v", at).collect()}
    assert set(got) == set(want)
    for k, p in want.items():
        assert got[k] == [None] * len(at) if p is None else np.array_equal(got[k], p, equal_nan=True), k
    assert percentiles(d.limit(0), "k", "v", at).count() == 0


def test_semantic(spark):
    class Stub:
        def encode(self, texts):
            return np.array([[0, 0, 1] if "different" in t else [1, 0, 0] for t in texts], np.float32)

    got = texts(ck.chunk(docs(spark, "One. Two. A different one.", "Single", ""), "chunk_semantic", embedder=Stub(), similarity_threshold=0.8))
    assert got == ["One. Two.", "A different one.", "Single"]
    with pytest.raises(KeyError):
        ck.chunk(docs(spark, "x"), "nothing")


def test_knn(spark):
    corpus = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 0.0, 1.0])], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(7, [0.9, 0.1, 0.0])], "qid long, embedding array<float>")
    for metric in ("l2", "ip", "l1", "linf"):
        assert [r.chunk_id for r in knn(q, corpus, 10, metric).orderBy("rank").collect()] == [0, 1, 2]
    assert knn(q.limit(0), corpus, 3).count() == 0
    assert knn(q, corpus.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        knn(q, corpus, 3, "x")


def test_knn_keeps_every_query(spark, monkeypatch):
    """Blocks end anywhere; a qid is one query; rows without one ask nothing; ties go to the smaller id."""
    rng = np.random.default_rng(2)
    v = rng.integers(-2, 3, (300, 3)).astype(float)
    corpus = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, embedding array<double>")
    asked = [(i, v[i].tolist()) for i in range(40)] + [(3, [9.0, 9.0, 9.0]), (None, [0.0, 0.0, 0.0])]
    queries = spark.createDataFrame(asked, "qid long, embedding array<double>")
    monkeypatch.setattr(retrieve, "QUERY_BYTES", 24 * 7)
    monkeypatch.setattr(retrieve, "CELLS", 1)
    for metric in ("l2", "ip", "l1", "linf"):
        got = retrieve.knn(queries, corpus, 5, metric).collect()
        for q in range(40):
            d = retrieve.scores(v[q : q + 1], v, metric)[0]
            want = sorted(range(300), key=lambda i: (d[i], i))[:5]  # noqa: B023
            assert [r.chunk_id for r in sorted((r for r in got if r.qid == q), key=lambda r: r.rank)] == want
        assert len(got) == 200


def test_clean_text(spark):
    odd = ["a b", "x​y", " a \n\n  b\t c ", "", "a\x0bb\x85c d", " 　pad　 "]
    got = [r.c for r in docs(spark, *odd).orderBy("doc_id").select(tx.clean_text(F.col("text")).alias("c")).collect()]

    def plain(s):
        for m in "​‎‏":
            s = s.replace(m, "")
        import re

        s = re.sub("[ \t ]+", " ", s.replace(" ", " "))
        return "\n".join(x for x in (ln.strip() for ln in s.splitlines()) if x)

    assert got == [plain(s) for s in odd]


def test_names(spark):
    df = spark.createDataFrame([("all-MiniLM-L6-v2_01_gold_easy_Easy",), ("BAAI_bge-base_01_gold_all",), ("other",)], "f string")
    got = [tuple(r) for r in df.select(*(c.alias(k) for k, c in tx.folder_parts(F.col("f")).items())).collect()]
    assert got == [("all-MiniLM-L6-v2", "Easy", "01_gold_easy"), ("BAAI_bge-base", "All", "01_gold_all"), ("unknown", "All", "other")]


def test_replies(spark):
    rows = [('{"question":"q","answer":"a","gold_snippets":["s"]}',), ('```json\n{"question":"IMPOSSIBLE","answer":"a","gold_snippets":["s"]}\n```',), ("broken {",), ('{"question":"q","answer":"a","gold_snippets":[]}',)]
    df = spark.createDataFrame(rows, "r string").select(F.explode(F.array(tx.parse_reply(F.col("r")))).alias("p"))
    got = df.select("p.question", tx.valid_reply(F.col("p")).alias("v")).collect()
    assert [tuple(r) for r in got] == [("q", True), ("IMPOSSIBLE", False), ("Error parsing generation", False), ("q", False)]
    tries = spark.createDataFrame([(i, i % 3 == 0) for i in range(30)], "attempt int, valid boolean")
    assert [r.attempt for r in rs.accept_until(tries, 3).collect()] == [0, 3, 6]
    assert rs.accept_until(tries, 9, 4).count() == 2
    flags = [bool(x) if x < 2 else None for x in np.random.default_rng(2).integers(0, 3, 60).tolist()]
    odd = spark.createDataFrame(list(enumerate(flags)), "attempt long, valid boolean").repartition(4)
    for n, most in ((0, 5), (1, 1), (5, 3), (7, 40), (50, 9), (3, 0)):
        want, good, bad = [], 0, 0
        for i, x in enumerate(flags):
            good, bad = good + (x is True), bad + (x is False)
            if x and good <= n and bad < most:
                want.append(i)
        assert sorted(r.attempt for r in rs.accept_until(odd, n, most).collect()) == want


def test_length_order(spark):
    got = ck.length_sorted(spark.createDataFrame([(0, 0, "zzzz"), (0, 1, "a"), (0, 2, "mmmm")], "doc_id long, chunk_pos int, text string")).orderBy("place").collect()
    assert [(r.place, r.text) for r in got] == [(1, "a"), (2, "zzzz"), (3, "mmmm")]


def test_lookups(spark):
    rows = spark.createDataFrame([("e1", "m/x"), ("e2", "m/x")], "experiment string, embedding_model string")
    idx = spark.createDataFrame([("e1", "m_x", None, 3.0, 4.0)], "experiment string, model string, build_time_seconds double, indexing_compute_duration_seconds double, indexing_duration double")
    assert {r.experiment: r.index_time for r in rs.with_index_metadata(rows, idx).collect()} == {"e1": 3.0, "e2": None}
    with pytest.raises(KeyError):
        rs.reorder(rows, ["nope"])
    assert rs.reorder(rows, ["embedding_model"]).columns == ["embedding_model", "experiment"]


WIKI = """<h1 id="firstHeading">Title</h1><div id="mw-content-text"><h2>Head</h2><p>Para <b>bold</b></p><ul><li>one<li>two</ul>
<blockquote>said</blockquote><div class="thumbcaption">cap</div><figcaption>fig</figcaption><img alt="alt">
<table><tr><th>A</th><th>B</th></tr><tr><td>Bob</td><td> </td></tr></table></div>
<table class="infobox"><tr><td>k</td><td>v</td></tr></table><ol class="references"><li><span class="reference-text">ref</span></li></ol>
<div id="mw-normal-catlinks"><a>Categories</a>: <a>Cat 1</a><a>Cat 2</a></div>"""


def test_pages(spark):
    p = spark.createDataFrame([("u", WIKI), ("v", "<p>no content</p>"), ("w", None)], "url string, html string")
    got = {r.url: r.page for r in pg.parse_pages(p).collect()}
    assert got["v"] is None and got["w"] is None
    page = got["u"]
    assert page.text.split("\n") == ["TITLE: Title", "# Head", "Para bold", "- one", "- two", "> said", "IMAGE_CAPTION: cap", "FIG_CAPTION: fig", "IMAGE_ALT: alt", "TABLE:", "A B", "Bob", "INFOBOX:", "k v", "REFERENCES:", "ref", "CATEGORIES: Cat 1, Cat 2"]
    assert page.tables[0].rows == [["A", "B"], ["Bob"]]
    s = spark.createDataFrame([("s", ["u", "v", "u"])], "sample_id string, urls array<string>")
    one = pg.pages_for(s, pg.parse_pages(p)).first()
    assert one.url == "u" and len(one.pages) == 2 and pg.SPLIT in one.document_text


def test_pages_are_parsed_by_bytes(spark):
    """Slices hold so many bytes together, or one larger page; pages of several slices come back in order, none is lost."""
    sizes = np.array([3, 4, 0, 9, 30, 1, 1, 8, 2, 0])
    cut = list(pg.slices(sizes, 10))
    assert [i for a, b in cut for i in range(a, b)] == list(range(len(sizes))) and all(sizes[a:b].sum() <= 10 or b == a + 1 for a, b in cut)
    assert list(pg.slices(np.zeros(0, int), 10)) == []
    long = "word " * (pg.SLICE // 12)
    rows = [(i, None if i == 3 else f"u{i}", None if i == 5 else f'<div id="mw-content-text"><p>{i} {long if i % 2 else "é"}</p></div>') for i in range(12)]
    p = spark.createDataFrame(rows, "page_id int, url string, html string").coalesce(1)
    got = pg.parse_pages(p, keys=("page_id", "url")).collect()
    assert [r.page_id for r in got] == list(range(12)) and [r.page_id for r in got if r.page is None] == [3, 5]
    assert all(r.page.text == f"{r.page_id} {long if r.page_id % 2 else 'é'}".strip() for r in got if r.page)


def test_readers(spark, tmp_path):
    f = tmp_path / "s.jsonl"
    f.write_text('{"id":"1","question":"q","gold_passages":["g"]}\n{"id":"2","question":"q"}\n')
    assert [r.sample_id for r in readers.samples(spark, str(f)).collect()] == ["1", "2"]
    assert readers.samples(spark, str(f), 1).count() == 1
    assert readers.samples(spark, str(tmp_path / "none")).count() == 0
    g = tmp_path / "g.jsonl"
    g.write_text('{"question":"a","gold_passages":["x"]}\n{"question":"b","gold_passages":"y"}\nbad\n\n{"question":"","gold_passages":["x"]}\n')
    assert [(r.question, r.gold) for r in readers.gold_questions(spark, str(g)).collect()] == [("a", ["x"]), ("b", ["y"])]
    d = tmp_path / "d.jsonl"
    d.write_text('{"document_text":"1"}\n{"text":"2"}\nbad\n{"content":"3"}\n{"other":"4"}\n{"document":"5"}\n')
    assert [r.text for r in readers.document_texts(spark, str(d)).collect()] == ["1", "2", "3", "5"]
    m = tmp_path / "m.json"
    m.write_text('{"a":\n1}\n\n{"b": 2}\n')
    assert [(r.line, json.loads(r.object)) for r in readers.json_objects(spark, str(m)).collect()] == [(1, {"a": 1}), (4, {"b": 2})]
    c = tmp_path / "c.json"
    c.write_text('["x", {"page_content": "y"}, {"text": "z"}, " "]')
    assert [r.text for r in readers.chunk_texts(spark, str(c)).orderBy("pos").collect()] == ["x", "y", "z"]
    t = tmp_path / "t.csv"
    t.write_text("a\tb\n1\t2\n")
    assert readers.result_csv(spark, str(t)).columns == ["a", "b"]
    assert readers.json_or_empty(spark, str(tmp_path / "no.json"), "a int").first().a is None


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("1", "q", ["a", "b"])], "sample_id string, question string, gold_passages array<string>")
    assert writers.records_csv(rows, str(tmp_path / "o"), "\\t", 2) == 1
    assert readers.result_csv(spark, str(tmp_path / "o")).first().gold_passage_2 == "b"
    assert "| 1 |" in writers.report({"T": rows.select("sample_id")})
    assert not (tmp_path / "e").exists() and writers.detailed_results(rows.limit(0), str(tmp_path / "e"), "x").isEmpty()


def test_small_functions():
    assert [fixed_batch_size(m) for m in ("MiniLM", "bge-base", "bge-large", "x")] == [8192, 1536, 256, 1024]
    sizes = {("MiniLM", 10): 64_000, ("MiniLM", 3000): 3035, ("base", 30): 16_000, ("base", 1500): 2400, ("base", 3000): 607, ("large", 30): 512, ("large", 601): 256, ("large", 1353): 128, ("large", 30_000): 16}
    assert {k: batch_size(k[1], k[0]) for k in sizes} == sizes and batch_size(10, "x", "cpu") == batch_size(10, "x", "mps") == 32
    v = HashingEmbedder().encode(["a b", "", "a b"])
    assert np.allclose(np.linalg.norm(v, axis=1), 1) and np.array_equal(v[0], v[2])


def test_runs_of_items():
    """What stands in a text as a whole, or shares runs with it, against sets of word runs; items of one and two words too."""
    rng = np.random.default_rng(5)
    some = lambda n: [f"w{i}" for i in rng.integers(0, 6, n)]
    items = [(i, some(n)) for i, n in enumerate([1, 2, 3, 3, 4, 5, 6, 9, 12, 0])] + [(10, ["once"]), (11, ["w1", "once", "w2"])]
    runs = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    whole, near = Runs(items, 3, True), Runs(items, 3, False)
    hit = 0
    for k in range(300):
        w = some(int(rng.integers(0, 60))) + (items[k % 12][1] if k % 3 == 0 else []) + some(4)
        want = [i for i, x in items if x and runs(x, min(3, len(x))) <= runs(w, min(3, len(x)))]
        assert sorted(whole.within(" ".join(w))) == want
        shared = {i: len(runs(x, 3) & runs(w, 3)) for i, x in items if len(x) >= 3}
        want = {i: n for i, n in shared.items() if n >= min(5, len(runs(items[i][1], 3)))}
        assert {r["id"]: r["shared"] for r in near.sharing(" ".join(w), 5)} == want
        hit += len(want)
    assert hit > 100 and Runs([], 3, True).within("a b c") == [] == Runs([], 3, False).sharing("", 5)


def brute(q, v, ids, k, metric, own=None):
    d = retrieve.scores(q, v, metric)
    if own is not None:
        d = np.where(ids[None, :] == own[:, None], np.inf, d)
    return [[(int(ids[j]), d[i, j]) for j in np.lexsort((ids, d[i]))[:k] if np.isfinite(d[i, j])] for i in range(len(q))]


@pytest.mark.parametrize("metric", ["l2", "ip", "l1", "linf"])
@pytest.mark.parametrize("kind", ["plain", "ties", "far", "odd"])
def test_nearest_of_blocks(spark, metric, kind):
    """The k nearest of many blocks are those of all rows, to the bit: ties, vectors far from the origin and near each other
    (where a product's rounding is larger than their distances), vectors that overflow or are no numbers."""
    rng = np.random.default_rng(3)
    v, q = rng.standard_normal((3000, 8)), rng.standard_normal((9, 8))
    if kind == "ties":
        v, q = rng.integers(0, 2, (3000, 8)).astype(float), rng.integers(0, 2, (9, 8)).astype(float)
    if kind == "far":
        v, q = 1e9 + 1e-6 * v, 1e9 + 1e-6 * q
    if kind == "odd":
        v[::7], v[3], v[5], q[2] = 1e200, np.nan, np.inf, 1e200
    ids = rng.permutation(3000).astype(np.int64)
    asked = spark.createDataFrame([(int(ids[i]), x.tolist()) for i, x in enumerate(q)], "qid long, embedding array<double>")
    corpus = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)], "chunk_id long, embedding array<double>")
    for own in (False, True):
        got = [[] for _ in q]
        place = {int(ids[i]): i for i in range(len(q))}
        with np.errstate(all="ignore"):
            want = brute(q, v, ids, 5, metric, ids[: len(q)] if own else None)
        for r in knn(asked, corpus, 5, metric, exclude_self=own).orderBy("qid", "rank").collect():
            got[place[r.qid]].append((r.chunk_id, -r.distance if metric == "ip" else r.distance))
        if metric == "ip":  # a product's sums hang on the shape of the block
            assert [len(x) for x in got] == [len(x) for x in want] and np.allclose([d for x in got for _, d in x], [d for x in want for _, d in x])
        else:
            assert got == want


def test_few_distances_are_taken():
    """Once k are known only what can be nearer is looked at; bounds leave no pair out."""
    rng = np.random.default_rng(4)
    q, v = rng.standard_normal((50, 16)), rng.standard_normal((20000, 16))
    full = retrieve.scores(q, v, "l2")
    row, col, d = retrieve.near(q, v, "l2", 10, np.full(50, np.inf))
    assert len(row) == 500 and (d == full[row, col]).all() and (np.sort(d.reshape(50, 10)) == np.sort(full)[:, :10]).all()
    row, col, d = retrieve.near(q, v, "l2", 10, np.sort(full)[:, 2])
    assert len(row) == 150 and (np.bincount(row) == 3).all()


def test_words_are_hashed_once():
    import zlib

    some = ["a b a", "", None, "x " * 500 + "Y", "é \u00a0 z", "b"]
    want = np.zeros((len(some), 16), np.float32)
    for i, x in enumerate(some):
        for w in (x or "").lower().split():
            want[i, zlib.crc32(w.encode()) % 16] += 1 if zlib.crc32(w.encode()) >> 31 else -1
    norm = np.linalg.norm(want, axis=1)
    want[norm == 0, 0] = 1
    got = HashingEmbedder(16).encode(some)
    assert got.dtype == np.float32 and (got == want / np.where(norm == 0, 1, norm)[:, None]).all()
    assert HashingEmbedder(16).encode([]).shape == (0, 16)
