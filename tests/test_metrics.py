import math
import random

import pytest
from pyspark.sql import functions as F

from lateweave.operators.metrics import (
    exclusions_from_lists, expected_runs, gold_counts, join_qrels, macro_mean, qrels_from_gold,
    qrels_from_pairs, query_metrics, resume_pending, retrieval_metrics, split_report,
    splits_present,
)
from lateweave.operators.ranking import display_ranking, exclude_ids, topk_per_query
from lateweave.operators.trainlog import every_kth, trailing_mean
from lateweave.schemas import METRICS


def scored_table(spark, seed=0):
    rng = random.Random(seed)
    rows = [(f"s{q % 2}", f"q{q}", f"d{d}", float(rng.randint(0, 9)))
            for q in range(6) for d in range(rng.randint(3, 40))]
    return rows, spark.createDataFrame(rows, "split string, qid string, doc_id string, score double")


def ranking(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append(r.doc_id)
    return out


def expected_order(rows, last=False):
    out = {}
    for _, q, d, s in rows:
        out.setdefault(q, []).append((d, s))
    for q, items in out.items():
        items.sort(key=lambda x: x[0], reverse=last)
        items.sort(key=lambda x: -x[1])
        out[q] = [d for d, _ in items]
    return out


@pytest.mark.parametrize("fan_in", [1, 3, 32])
def test_topk_breaks_ties_by_id(spark, fan_in):
    rows, df = scored_table(spark)
    want = {q: ds[:7] for q, ds in expected_order(rows).items()}
    for p in (1, 6):
        assert ranking(topk_per_query(df.repartition(p), 7, fan_in=fan_in)) == want
    last = {q: ds[:7] for q, ds in expected_order(rows, last=True).items()}
    assert ranking(topk_per_query(df, 7, ties="last", fan_in=fan_in)) == last


def test_nan_is_dropped(spark):
    df = spark.createDataFrame([("s", "q", "a", float("nan")), ("s", "q", "b", 1.0)],
                               "split string, qid string, doc_id string, score double")
    assert ranking(topk_per_query(df, 5)) == {"q": ["b"]}


def test_exclusion_comes_after_the_cut(spark):
    rows, df = scored_table(spark)
    order = expected_order(rows)
    lists = [(r[0], r[1], order[r[1]][1:3] + ["unknown"] + order[r[1]][1:2]) for r in set((a, b) for a, b, _, _ in rows)]
    queries = spark.createDataFrame(lists, "split string, qid string, excluded_ids array<string>")
    kept = exclude_ids(topk_per_query(df, 5), exclusions_from_lists(queries))
    assert ranking(kept) == {q: [d for d in ds[:5] if d not in ds[1:3]] for q, ds in order.items()}
    ranks = {}
    for r in kept.collect():
        ranks.setdefault(r.qid, []).append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in ranks.values())
    none = exclusions_from_lists(queries.drop("excluded_ids"))
    assert ranking(exclude_ids(topk_per_query(df, 5), none)) == {q: d[:5] for q, d in order.items()}


def test_display_ranking(spark):
    _, df = scored_table(spark)
    texts = df.select("doc_id").distinct().withColumn("text", F.repeat(F.col("doc_id"), 50))
    for r in display_ranking(df, texts, 3).collect():
        assert r.preview == (r.doc_id * 50)[:60]
    tied = spark.createDataFrame([("s", "q", str(i), 1.0, i) for i in (9, 10, 11)],
                                 "split string, qid string, doc_id string, score double, n int")
    got = display_ranking(tied, texts, 3, place="n").collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"])] == ["11", "10", "9"]


def reference_metrics(ranked, gold):
    g = set(gold)
    hits = [i for i, d in enumerate(ranked, 1) if d in g]
    if not g:
        return dict.fromkeys(METRICS, 0.0)
    out = {"map": sum((n + 1) / r for n, r in enumerate(hits)) / len(g)}
    for k in (1, 10, 100):
        ideal = sum(1 / math.log2(i + 1) for i in range(1, min(k, len(g)) + 1))
        out[f"ndcg@{k}"] = sum(1 / math.log2(r + 1) for r in hits if r <= k) / ideal
    for k in (10, 100):
        out[f"recall@{k}"] = sum(r <= k for r in hits) / len(g)
    return out


def test_metrics_against_their_definitions(spark):
    rng = random.Random(4)
    rows, df = scored_table(spark, 4)
    order = expected_order(rows)
    gold = {q: [rng.choice([f"d{rng.randint(0, 45)}" for _ in range(3)]) for _ in range(rng.randint(0, 9))]
            for q in order}
    gold["q9"], gold["q0"] = ["d1"], []
    queries = spark.createDataFrame(
        [(f"s{int(q[1:]) % 2}", q, g) for q, g in gold.items()],
        "split string, qid string, gold_ids array<string>")
    ranked, qrels = topk_per_query(df, 100), qrels_from_gold(queries)
    want = {q: reference_metrics(order.get(q, []), g) for q, g in gold.items()}
    got = query_metrics(ranked, qrels, queries).collect()
    assert len(got) == len(gold)
    for r in got:
        for m in METRICS:
            assert r[m] == pytest.approx(want[r.qid][m]), (r.qid, m)
    for r in retrieval_metrics(ranked, qrels, queries).collect():
        mine = [want[q][r.metric] for q in gold if f"s{int(q[1:]) % 2}" == r.split]
        assert r.value == pytest.approx(sum(mine) / len(mine))
    skipped = query_metrics(ranked, qrels, queries, empty_gold="skip")
    assert {r.qid for r in skipped.collect()} == {q for q, g in gold.items() if g}


def test_qrels(spark):
    queries = spark.createDataFrame(
        [("s", "1", ["a", "a", "b"]), ("s", "2", []), ("s", "3", None)],
        "split string, qid string, gold_ids array<string>")
    qrels = qrels_from_gold(queries)
    assert sorted((r.qid, r.doc_id, r.rel) for r in qrels.collect()) == [("1", "a", 1), ("1", "b", 1)]
    assert {r.qid: r.n_gold for r in gold_counts(queries, qrels).collect()} == {"1": 2, "2": 0, "3": 0}
    pairs = spark.createDataFrame(
        [("s", "1", 5), ("s", "1", 5), ("s", "9", 5)], "split string, qid string, doc_id int")
    assert [tuple(r) for r in qrels_from_pairs(pairs, queries).collect()] == [("s", "1", "5", 1)]
    ranked = spark.createDataFrame([("s", "1", "a", 1), ("s", "1", "z", 2)],
                                   "split string, qid string, doc_id string, rank int")
    assert {r.doc_id: r.rel for r in join_qrels(ranked, qrels).collect()} == {"a": 1, "z": 0}


def test_unknown_metric(spark):
    _, df = scored_table(spark)
    q = df.select("split", "qid").distinct()
    with pytest.raises(ValueError):
        query_metrics(topk_per_query(df), df.select("split", "qid", "doc_id"), q, ["mrr"])


def test_reports_and_resume(spark):
    expected = spark.createDataFrame([("biology",), ("pony",), ("aops",)], "split string")
    runs = expected_runs(expected, "r1")
    assert {r.split: r.qlen for r in runs.collect()} == {"biology": 256, "pony": 32, "aops": 256}
    metrics = spark.createDataFrame(
        [("r1", "pony", 32, "ndcg@10", 0.5), ("r1", "biology", 256, "ndcg@10", 0.25),
         ("r1", "biology", 256, "map", 0.9), ("r0", "aops", 256, "ndcg@10", 0.1)],
        "run_id string, split string, qlen int, metric string, value double")
    assert [r.split for r in resume_pending(runs, metrics).collect()] == ["aops"]
    report = split_report(expected, metrics.where("run_id = 'r1'"))
    assert {r.split: (r.pct, r.status) for r in report.collect()} == {
        "biology": (25.0, "done"), "pony": (50.0, "done"), "aops": (None, "missing")}
    assert tuple(macro_mean(report).first()) == (37.5, 2, 3)
    assert macro_mean(split_report(expected, metrics.where("1 = 0"))).count() == 0
    present, missing = splits_present(expected, metrics.where("run_id = 'r1'"))
    assert {r.split for r in present.collect()} == {"biology", "pony"}
    assert [r.split for r in missing.collect()] == ["aops"]


@pytest.mark.parametrize("k,chunk", [(1, 4), (5, 4), (5, 1000), (50, 7)])
def test_trailing_mean(spark, k, chunk):
    rng = random.Random(k)
    losses = {r: [rng.random() for _ in range(n)] for r, n in [("a", 37), ("b", 3)]}
    log = spark.createDataFrame(
        [(r, i, x) for r, xs in losses.items() for i, x in enumerate(xs, 1)],
        "run string, step long, loss double")
    got = trailing_mean(log, k, ["run"], chunk=chunk).collect()
    assert len(got) == 40
    for r in got:
        last = losses[r.run][:r.step][-k:]
        assert r.trailing_mean == pytest.approx(sum(last) / len(last))


def test_every_kth(spark):
    log = spark.range(1, 11).withColumnRenamed("id", "step")
    assert [r.step for r in every_kth(log, 4).collect()] == [4, 8]
    assert every_kth(log, 0).count() == 0


def test_repeated_document_is_one_hit(spark):
    ranked = spark.createDataFrame([("s", "q", "d", 1), ("s", "q", "d", 2)],
                                   "split string, qid string, doc_id string, rank int")
    qrels = spark.createDataFrame([("s", "q", "d")], "split string, qid string, doc_id string")
    queries = spark.createDataFrame([("s", "q", ["d"])], "split string, qid string, gold_ids array<string>")
    row = query_metrics(ranked, qrels, queries, ["recall@10"]).first()
    assert row["recall@10"] == 1.0


def test_trailing_mean_counts_rows_not_steps(spark):
    from lateweave.operators.trainlog import trailing_mean

    log = spark.createDataFrame([(s, float(s)) for s in (1, 2, 3, 7, 8)], "step long, loss double")
    for chunk in (2, 100):
        got = {r["step"]: r["trailing_mean"] for r in trailing_mean(log, 3, chunk=chunk).collect()}
        assert got == {1: 1.0, 2: 1.5, 3: 2.0, 7: 4.0, 8: 6.0}
