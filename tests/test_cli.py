"""The command line from samples to reports, on a folder of its own."""

import json

import pytest

from ragmill import cli
from ragmill.sources import readers, store, writers


def site():
    """A fetcher for tests, of a class that travels to the executors as it is."""

    class Site:
        def get(self, url):
            return None if url.endswith("gone") else f"<html><body><h1>{url}</h1><div id='mw-content-text'><p>Text of {url} with enough words to keep.</p></div></body></html>"

    return Site()


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("cli")
    body = "Rivers run to the sea. The mill stands by the river. Grain comes by cart every week. Flour leaves in sacks. The miller counts them at night. "
    with open(at / "in.jsonl", "w") as f:
        for i in range(6):
            f.write(json.dumps({"sample_id": str(i), "question": f"Where does mill {i} stand?", "gold_passages": [f"mill {i} stands by the river"], "document_text": body.replace("The mill", f"The mill {i}") * 3, "difficulty": "Hard" if i % 2 else "Easy"}) + "\n")
    names = [("fixed_1024_128", "chunk_fixed_size", {"chunk_size": 40, "chunk_overlap": 8}), ("sentence_s10", "chunk_by_sentence", {"sentences_per_chunk": 2}), ("semantic_t0.5", "chunk_semantic", {"similarity_threshold": 0.5}), ("other", "chunk_recursive", {"chunk_size": 30})]
    config = {"input_file": str(at / "in.jsonl"), "embedding_model": "some/model", "top_k": 20, "experiments": [{"name": n, "function": f, "params": p} for n, f, p in names]}
    (at / "01_gold_all.json").write_text(json.dumps(config))
    return at


def call(root, command, *args):
    cli.main([command, *args])


def test_from_chunks_to_reports(spark, root):
    base, config = f"file://{root}/data", f"file://{root}/01_gold_all.json"
    for command in ("build-chunks", "build-vectors"):
        call(root, command, "--config", config, "--root", base)
    side = json.loads(store.read_text(spark, f"{base}/chunks/semantic_t0.5.metadata.json"))
    assert side["total_chunks"] > 0 and side["sentence_sentences"] == 6 * 15 and side["key"]
    call(root, "run", "--config", config, "--root", base)
    folder = f"{base}/results/some_model_01_gold_all"
    names = store.names(spark, folder)
    assert "metadata.json" in names and "01_gold_all.json" in names and any(n.endswith("_run.log") for n in names) and any(n.endswith("_summary.csv") for n in names)
    details = next(f"{folder}/{n}" for n in names if n.endswith("_detailed_results.csv"))
    rows = readers.result_csv(spark, details)
    assert rows.count() == 6 * 4 and {"recall@20", "retrieval_time_s", "num_chunks"} <= set(rows.columns)
    assert rows.where("experiment = 'fixed_1024_128' AND CAST(`recall@20` AS DOUBLE) > 0").count() == 6
    # a second run finds its results and leaves them
    call(root, "run", "--config", config, "--root", base)
    assert store.names(spark, folder) == names
    # an archive is no result
    store.copy(spark, f"{folder}/metadata.json", f"{base}/results/archive_old/x_detailed_results.csv")
    for command in ("aggregate", "merge", "report"):
        call(root, command, "--root", base, "--to", f"{base}/{command}")
    master = readers.result_csv(spark, f"{base}/aggregate")
    assert master.count() == 24 and "chunking_time_s" not in master.columns
    first = master.where("experiment = 'other'").first()
    assert first.embedding_model == "some_model" and first.dataset_type == "Gold" and first.config_difficulty == "All" and float(first.chunk_count) > 0 and float(first.index_time) > 0
    merged = readers.result_csv(spark, f"{base}/merge")
    assert merged.columns[:6] == ["model_name", "dataset_type", "dataset_difficulty", "experiment", "indexing_time_s", "num_chunks"]
    assert {(r.model_name, r.dataset_type) for r in merged.collect()} == {("some/model", "Gold")} and merged.count() == 4
    assert all(float(r.indexing_time_s) > 0 and int(r.num_chunks) > 0 for r in merged.collect())
    text = store.read_text(spark, f"{base}/report")
    assert all(f"## {x}" in text for x in ("Metrics by strategy", "Embedding models", "Semantic threshold", "Overlap", "Difficulty", "Strategies compared"))


def test_changed_parameters_make_new_chunks(spark, root):
    base = f"file://{root}/again"
    config = readers.config(f"file://{root}/01_gold_all.json")
    config["experiments"] = config["experiments"][:1]
    cli.build_chunks(spark, config, base)
    cli.build_vectors(spark, config, base, by_length=True)
    before = spark.read.parquet(f"{base}/chunks/fixed_1024_128").count()
    made = store.read_text(spark, f"{base}/chunks/fixed_1024_128.metadata.json")
    cli.build_chunks(spark, config, base)
    assert store.read_text(spark, f"{base}/chunks/fixed_1024_128.metadata.json") == made
    config["experiments"][0]["params"]["chunk_size"] = 20
    cli.build_chunks(spark, config, base)
    cli.build_vectors(spark, config, base, by_length=True)
    after = spark.read.parquet(f"{base}/chunks/fixed_1024_128").count()
    assert after > before and spark.read.parquet(f"{base}/vectors/fixed_1024_128_some_model").count() == after
    v, c = readers.load_index(spark, f"{base}/vectors/fixed_1024_128_some_model", f"{base}/chunks/fixed_1024_128")
    assert v.join(c, "chunk_id").count() == after
    spark.range(2).write.parquet(f"{base}/two")
    with pytest.raises(RuntimeError):
        readers.load_index(spark, f"{base}/vectors/fixed_1024_128_some_model", f"{base}/two")


def test_distances(spark, root):
    base = f"file://{root}/dist"
    config = readers.config(f"file://{root}/01_gold_all.json")
    cli.build_chunks(spark, config, base)
    call(root, "distances", "--root", base, "--gold", f"file://{root}/in.jsonl", "--to", f"{base}/distances")
    rows = readers.result_csv(spark, f"{base}/distances").collect()
    assert len(rows) == 3 * 4 and {r.Distance_Metric for r in rows} == set(cli.DISTANCES.values()) and "other" not in {r.Experiment for r in rows}
    assert all(0 <= float(r.MRR) <= 1 and int(r.Chunks_Count) > 0 for r in rows) and any(float(r.MRR) > 0 for r in rows)
    assert cli.compare_distances(spark, f"file://{root}/nothing", f"file://{root}/in.jsonl") is None


def test_questions_are_made(spark, root):
    out = f"file://{root}/silver"
    call(root, "silver", f"file://{root}/in.jsonl", out, "--limit", "2")
    rows = readers.samples(spark, out).collect()
    assert len(rows) == 2 and all(r.difficulty == "Hard" and len(r.metadata.source_chunks) == 2 and r.gold_passages for r in rows)
    again = f"file://{root}/silver2"
    call(root, "silver", f"file://{root}/in.jsonl", again, "--limit", "2")
    assert {r.sample_id for r in readers.samples(spark, again).collect()} == {r.sample_id for r in rows}
    call(root, "categorize", f"file://{root}/in.jsonl", f"file://{root}/cat", "--limit", "3")
    assert {r.category for r in readers.samples(spark, f"file://{root}/cat").collect()} == {"General"}


def test_preprocess(spark, root):
    data = root / "asks"
    data.mkdir()
    page = lambda x: {"title": x, "url": f"http://h/{x}"}
    with open(data / "train.jsonl", "w") as f:
        for i, pages in enumerate((["a", "b"], ["gone"], ["b"])):
            f.write(json.dumps({"sample_id": str(i), "ambiguous_question": f" q {i} ", "wikipages": [page(x) for x in pages], "qa_pairs": [{"short_answers": ["z ", "a"]}, {"short_answers": ["a"]}]}) + "\n")
    path = cli.preprocess_dataset(spark, f"file://{data}", f"file://{root}/pre", site())
    rows = {r.sample_id: r for r in readers.samples(spark, path).collect()}
    assert set(rows) == {"0", "2"} and rows["0"].question == "q 0" and list(rows["0"].gold_passages) == ["a", "z"] and "Text of http://h/a" in rows["0"].document_text
    assert cli.preprocessed_path("b", None).endswith("_all.jsonl") and cli.preprocessed_path("b", 5).endswith("_limit_5.jsonl")
    assert readers.samples(spark, cli.preprocess_dataset(spark, f"file://{data}", f"file://{root}/pre", site(), 1)).count() == 1
    with pytest.raises(FileNotFoundError):
        readers.dataset(spark, f"file://{data}", "test")


def test_stores(spark, root):
    base = f"file://{root}/store"
    assert store.names(spark, base) == [] and store.read_text(spark, f"{base}/x") is None
    for name in ("chunks/a/metadata.json", "indices/a/1metadata.json", "results/r/1_detailed_results.csv", "results/archive/metadata.json", "results/r/plot.png"):
        store.write_text(spark, f"{base}/{name}", "é")
    assert readers.mirror(spark, base, f"file://{root}/copy") == 3 and readers.mirror(spark, base, f"file://{root}/copy") == 0
    assert store.read_text(spark, f"file://{root}/copy/chunks/a/chunks_metadata.json") == "é" and store.exists(spark, f"file://{root}/copy/indices/a/index_metadata.json")
    made = []
    make = lambda: (made.append(1), spark.range(3))[1]
    assert readers.cached(spark, f"{base}/t", make).count() == readers.cached(spark, f"{base}/t", make).count() == 3 and len(made) == 1
    long = writers.report({"T": spark.range(7)}, 5)
    assert "2 more rows" in long
    assert cli.run_prefix({}, "c/x.json") == "unknown_x" and cli.run_prefix({"embedding_model": "a/b", "difficulty": "Hard"}, "x.json") == "a_b_x_Hard"
    assert "embedding_model" in cli.check_config({"input_file": "x", "experiments": [1]}) and cli.check_config({"input_file": "x", "experiments": [1], "embedding_model": "m"}) is None
