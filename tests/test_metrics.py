import math

import pytest

from ragmill.operators.evaluate import fragmented, judge, metrics_at, near_misses, partial_multihop


def metrics(spark, rel, n_gold, k):
    rows = [(1, i + 1, r, n_gold) for i, r in enumerate(rel)]
    return metrics_at(spark.createDataFrame(rows, "qid int, rank int, rel int, n_gold int"), ["qid"], (k,)).first()


def log(n):
    return math.log2(n)


@pytest.mark.parametrize(
    ("rel", "n_gold", "want"),
    [
        ([1, 1, 1], 3, {"mrr": 1, "map": 1, "ndcg": 1, "precision": 1, "recall": 1, "f1_score": 1}),
        ([0, 1, 1, 0, 1], 3, {"mrr": 0.5, "map": (1 / 2 + 2 / 3 + 3 / 5) / 3, "ndcg": (1 / log(3) + 1 / log(4) + 1 / log(6)) / (1 + 1 / log(3) + 1 / log(4)), "precision": 0.6, "recall": 1}),
        ([0, 0, 0, 1, 0], 3, {"mrr": 0.25, "map": 0.25}),
        ([0, 0, 0], 3, {"mrr": 0, "map": 0, "ndcg": 0, "f1_score": 0}),
        ([1, 1], 1, {"ndcg": 1 + 1 / log(3), "recall": 2}),
        ([1, 1], 0, {"mrr": 0, "map": 0, "ndcg": 0, "precision": 0, "recall": 0, "f1_score": 0}),
    ],
)
def test_values(spark, rel, n_gold, want):
    got = metrics(spark, rel, n_gold, 20)
    for k, v in want.items():
        assert got[k] == pytest.approx(v), k


def test_cut_off(spark):
    got = metrics(spark, [1, 0, 1, 1], 3, 3)
    assert got.precision == got.recall == pytest.approx(2 / 3)
    assert got.ndcg == pytest.approx(1.5 / (1 + 1 / log(3) + 1 / log(4)))


@pytest.mark.parametrize(
    ("text", "gold", "want"),
    [
        ("underwater mill", "water mill", 0),
        ("water mills", "water mill", 0),
        ("Winter came", "win", 0),
        ("a win.", "win", 1),
        ("the (Lower Valley) farm", "lower valley", 1),
        ("LOUD Words", "loud words", 1),
        ("a   b", "a b", 1),
        ("a\nb", "a b", 1),
        ("a\tb", "a b", 1),
        ("they use F# there", "F#", 1),
        ("a well-known man", "well-known", 1),
        ("unrelated", "gold", 0),
    ],
)
def test_boundaries(spark, text, gold, want):
    hits = spark.createDataFrame([(1, 1, text)], "qid int, rank int, text string")
    got = judge(hits, spark.createDataFrame([(1, [gold])], "qid int, gold array<string>")).first()
    assert got.rel == want
    assert got.matching_gold == (gold if want else None)


def test_questions_without_hits_score_nothing(spark):
    judged = spark.createDataFrame([(1, 1, 1, 1)], "qid int, rank int, rel int, n_gold int")
    got = {(r.qid, r.k): (r.mrr, r.recall, r.f1_score) for r in metrics_at(judged, ["qid"], (1, 3), spark.createDataFrame([(1,), (2,), (2,)], "qid int")).collect()}
    assert got == {(1, 1): (1, 1, 1), (1, 3): (1, 1, 1), (2, 1): (0, 0, 0), (2, 3): (0, 0, 0)}


def test_forensics(spark):
    hits = spark.createDataFrame([(1, 1, "The first passage is here"), (1, 2, "the second pas"), (1, 3, "sage follows it")], "qid int, rank int, text string")
    gold = spark.createDataFrame([(1, ["first passage", "missing altogether"]), (2, ["x"])], "qid int, gold array<string>")
    assert [tuple(r) for r in partial_multihop(hits, gold).collect()] == [(1, 1, 1)]
    split = spark.createDataFrame([(1, ["second pas sage follows"])], "qid int, gold array<string>")
    assert [tuple(r) for r in fragmented(hits, split).collect()] == [(1, 0)]
    near = spark.createDataFrame([(1, ["first passage is herf"])], "qid int, gold array<string>")
    assert [r.rank for r in near_misses(hits, near).collect()] == [1]
