"""One query per operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lateweave.functions.gate import gate_stats, gate_udf, gate_value, init_gate, with_gate_weights
from lateweave.functions.text import (
    format_query, null_to_empty, py_strip, route_length, text_column,
)
from lateweave.functions.vectors import dot, l2_normalise, maxsim, weighted_maxsim
from lateweave.operators.gatefit import (
    align_triple, append_steps, fit_gate, gate_features, gate_gradient, pairwise_loss, read_step_log,
    score_loss, text_features, triple_features,
)
from lateweave.operators.merge import (
    corpus_counts, cut_shards, limit_batches, merge_sources, seeded_shuffle, source_counts, train_test_split,
)
from lateweave.operators.metrics import (
    exclusions_from_lists, gold_counts, join_qrels, qrels_from_gold, qrels_from_pairs,
    query_metrics, resume_pending, retrieval_metrics, splits_present,
)
from lateweave.operators.ranking import display_ranking, exclude_ids, topk_per_query
from lateweave.operators.scoring import score_topk
from lateweave.operators.tokens import embed_tokens, embedding_drift, truncate_tokens
from lateweave.operators.trainlog import every_kth, trailing_mean
from lateweave.operators.triples import (
    explode_product, last_wins_dim, project_triple, resolve_record,
)
from lateweave.plans.build_triples import (
    hq_triples, materialize, materialize_prompted, merge_tables, vl_triples,
)
from lateweave.plans.evaluate import (
    evaluate, evaluate_corpora, evaluate_run, evaluate_texts, rank_queries, report,
)
from lateweave.schemas import DOMAINS, PROMPTED_RECORD
from lateweave.session import cut_lineage, scratch_path
from lateweave.sources.readers import (
    load_beir_tables, load_eval_tables, load_triples, load_versioned_split, scan_jsonl,
)
from lateweave.sources.writers import damaged_files, load_gate, read_manifest, save_gate, write_verified
from workload import tables as t
from workload.encoder import make_encoder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("split", "qid", "doc_id", F.round("score", 6).alias("score"), "rank")


def _expected(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d,) for d in DOMAINS], "split string")


# Scoring and ranking

@query
def maxsim_topk(spark, sf_dir):
    queries, docs = t.one_corpus(spark, sf_dir)
    return _ranked(score_topk(queries, docs, k=10))


@query
def maxsim_topk_passes(spark, sf_dir):
    queries, docs = t.one_corpus(spark, sf_dir)
    return _ranked(score_topk(queries, docs, k=10, pass_bytes=128 << 10))


@query
def weighted_maxsim_topk(spark, sf_dir):
    queries, docs = t.one_corpus(spark, sf_dir)
    return _ranked(score_topk(with_gate_weights(queries, t.GATE), docs, k=10, mode="norm"))


@query
def mlp_unnorm_maxsim_topk(spark, sf_dir):
    queries, docs = t.one_corpus(spark, sf_dir)
    return _ranked(score_topk(with_gate_weights(queries, t.MLP), docs, k=10, mode="unnorm"))


@query
def masked_maxsim_topk(spark, sf_dir):
    texts = t.packed(spark, sf_dir).withColumn("split", F.lit("all"))
    seen = F.transform("label", lambda x: (F.get("label", F.lit(0)) != 0) & (x != 9))
    docs = texts.select("split", F.col("id").alias("doc_id"), "toks", seen.alias("mask"))
    return _ranked(score_topk(texts.withColumnRenamed("id", "qid"), docs, k=100))


@query
def exclude_after_topk(spark, sf_dir):
    queries, docs = t.one_corpus(spark, sf_dir)
    own = queries.withColumn("excluded_ids", F.array("qid"))
    return _ranked(exclude_ids(score_topk(queries, docs, k=10), exclusions_from_lists(own)))


@query
def display_rank(spark, sf_dir):
    queries, docs = t.domain_corpora(spark, sf_dir)
    texts = t.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), "text")
    scored = score_topk(queries, docs).withColumn("n", F.col("doc_id").cast("long"))
    top = display_ranking(scored, texts, k=5, place="n")
    return top.withColumn("score", F.round("score", 6))


@query
def rank_scored_table(spark, sf_dir):
    e = t.table(spark, sf_dir, "events")
    scored = e.select(F.col("event_type").alias("split"), F.col("user_id").cast("string").alias("qid"),
                      F.col("event_id").cast("string").alias("doc_id"), F.col("value").alias("score"))
    return topk_per_query(scored, k=5)


def _neighbours(spark, sf_dir):
    texts = t.packed(spark, sf_dir)
    q = with_gate_weights(texts.select(F.col("id").alias("qid"), F.col("toks").alias("q")),
                          t.GATE, toks="q")
    d = texts.select((F.col("id").cast("long") - 1).cast("string").alias("qid"),
                     F.col("toks").alias("d"),
                     F.transform("label", lambda x: x < 5).alias("mask"))
    return q.join(d, "qid")


@query
def maxsim_pairs(spark, sf_dir):
    q, d, w, m = F.col("q"), F.col("d"), F.col("w"), F.col("mask")
    return _neighbours(spark, sf_dir).select(
        "qid", F.round(maxsim(q, d), 6).alias("plain"),
        F.round(maxsim(q, d, m), 6).alias("masked"),
        F.round(weighted_maxsim(q, w, d), 6).alias("norm"),
        F.round(weighted_maxsim(q, w, d, mode="unnorm"), 6).alias("unnorm"),
        F.round(weighted_maxsim(q, w, d, m), 6).alias("masked_norm"))


# The gate

def _gated_tokens(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), F.col("label") + 1)
    return t.tokens(spark, sf_dir).select(
        name.alias("split"), "id", "pos", "v", gate_value(F.col("v"), t.GATE).alias("w"))


@query
def gate_linear(spark, sf_dir):
    return _gated_tokens(spark, sf_dir).select("id", "pos", F.round("w", 6).alias("w"))


@query
def gate_mlp(spark, sf_dir):
    return t.tokens(spark, sf_dir).select(
        "id", "pos", F.round(gate_value(F.col("v"), t.MLP), 6).alias("w"))


@query
def gate_mlp_wide(spark, sf_dir):
    """A gate of 64 x 32 weights over packed texts, one of them without tokens."""
    toks = F.when(F.col("id") != "3", F.col("toks"))
    weighted = with_gate_weights(t.packed(spark, sf_dir).withColumn("toks", toks), t.WIDE)
    return weighted.select("id", F.posexplode_outer("w").alias("pos", "w")).withColumn("w", F.round("w", 6))


@query
def gate_mlp_arrow(spark, sf_dir):
    return t.tokens(spark, sf_dir).select(
        "id", "pos", F.round(gate_udf(t.MLP)("v"), 6).alias("w"))


def _rounded_stats(df: DataFrame) -> DataFrame:
    return df.select("split", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")])


@query
def gate_stats_population(spark, sf_dir):
    return _rounded_stats(gate_stats(_gated_tokens(spark, sf_dir), by=["split"]))


@query
def gate_stats_sample(spark, sf_dir):
    return _rounded_stats(gate_stats(_gated_tokens(spark, sf_dir), by=["split"], ddof=1))


def _features(spark, sf_dir):
    return triple_features(*t.token_triples(spark, sf_dir))


@query
def aligned_triple_deltas(spark, sf_dir):
    return _deltas(gate_features(align_triple(*t.token_triples(spark, sf_dir))))


@query
def token_deltas(spark, sf_dir):
    return _deltas(_features(spark, sf_dir))


def _deltas(features):
    return (features.select("triple_id", F.posexplode("delta").alias("pos", "delta"))
            .withColumn("delta", F.round("delta", 6)))


@query
def gate_pairwise_loss(spark, sf_dir):
    features = cut_lineage(_features(spark, sf_dir))
    parts = [pairwise_loss(features, t.GATE, mode).select(
        F.lit(mode).alias("mode"), F.round("loss", 6).alias("loss"), "n_triples")
        for mode in ("unnorm", "norm")]
    return parts[0].unionByName(parts[1])


@query
def gate_score_loss(spark, sf_dir):
    """The loss from two score columns: each document against its two successors."""
    texts = t.packed(spark, sf_dir).select(F.col("id").cast("long").alias("n"), "toks")
    q = with_gate_weights(texts, t.GATE)
    pos = texts.select((F.col("n") - 1).alias("n"), F.col("toks").alias("p"))
    neg = texts.select((F.col("n") - 2).alias("n"), F.col("toks").alias("m"))
    scored = q.join(pos, "n").join(neg, "n").select(
        weighted_maxsim(F.col("toks"), F.col("w"), F.col("p"), mode="unnorm").alias("pos"),
        weighted_maxsim(F.col("toks"), F.col("w"), F.col("m"), mode="unnorm").alias("neg"))
    return score_loss(scored, "pos", "neg").withColumn("loss", F.round("loss", 6))


@query
def gate_linear_gradient(spark, sf_dir):
    got = gate_gradient(_features(spark, sf_dir), t.GATE)
    return got.withColumn("grad", F.round("grad", 8))


@query
def gate_mlp_gradient(spark, sf_dir):
    got = gate_gradient(_features(spark, sf_dir), t.MLP)
    return got.withColumn("grad", F.round("grad", 8))


@query
def gate_fit_one_step(spark, sf_dir):
    gate, _ = fit_gate(_features(spark, sf_dir), gate=t.GATE, steps=1)
    return _gate_rows(spark, gate)


@query
def gate_fit_four_steps(spark, sf_dir):
    gate, _ = fit_gate(_features(spark, sf_dir), gate=t.GATE, steps=4, lr=0.05)
    return _gate_rows(spark, gate)


def _gate_rows(spark, gate):
    return spark.createDataFrame([("w", i, x) for i, x in enumerate(gate.w)] + [("b", 0, gate.b)],
                                 "param string, idx int, value double").withColumn(
        "value", F.round("value", 8))


@query
def gate_fit(spark, sf_dir):
    gate, log = fit_gate(_features(spark, sf_dir), steps=5, batches=2)
    rows = spark.createDataFrame(log).withColumn("bias", F.lit(gate.b))
    return rows.select("step", *[F.round(c, 6).alias(c) for c in rows.columns if c != "step"])


@query
def gate_saved(spark, sf_dir):
    """A fitted gate, saved and loaded again."""
    gate, _ = fit_gate(_features(spark, sf_dir), gate=t.GATE, steps=1)
    return _gate_rows(spark, load_gate(spark, save_gate(spark, gate, scratch_path(spark, "gate"))))


@query
def gate_from_triples(spark, sf_dir):
    """Two steps from a table of texts: the texts are embedded by content, then as above."""
    triples = _vl(spark, sf_dir).withColumn("triple_id", F.col("conv_id") * 1000 + F.col("turn"))
    features = text_features(triples, make_encoder, make_encoder)
    return _gate_rows(spark, fit_gate(features, gate=t.WORD_GATE, steps=2, lr=0.05)[0])


@query
def gate_starts(spark, sf_dir):
    """A fresh gate changes no token, with or without a hidden layer: its weight is that of its bias."""
    w = [gate_udf(init_gate(t.DIM, hidden))("v") for hidden in (0, 24)]
    return t.tokens(spark, sf_dir).select(
        "id", "pos", F.round(w[0], 12).alias("linear"), F.round(w[1], 12).alias("two_layer"))


@query
def step_log_rows(spark, sf_dir):
    """Two runs; a portion with wrong losses is written again. Trailing means by run."""
    e = t.table(spark, sf_dir, "events")
    path = scratch_path(spark, "step-log")
    none = F.lit(None).cast("double")
    rows = e.select(F.concat(F.lit("run-"), F.col("event_id") % 2).alias("run"),
                    (F.col("event_id") - F.col("event_id") % 2).alias("step"), F.col("value").alias("loss"),
                    *[none.alias(c) for c in ("head_w_mean", "head_w_std", "head_w_min", "head_w_max")])
    append_steps(rows.withColumn("loss", F.when(F.col("step") % 3 == 0, -1.0).otherwise(F.col("loss"))), path)
    append_steps(rows.where(F.col("step") % 3 == 0), path)
    got = trailing_mean(read_step_log(spark, path), 50, run=["run"], chunk=2000)
    return got.withColumn("trailing_mean", F.round("trailing_mean", 9))


# Evaluation

def _metric_rows(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round("value", 6))


@query
def domain_metrics(spark, sf_dir):
    return _metric_rows(evaluate(*t.domain_corpora(spark, sf_dir), gate=t.GATE))


@query
def domain_metrics_plain(spark, sf_dir):
    queries, docs = t.domain_corpora(spark, sf_dir)
    return _metric_rows(evaluate(queries.drop("excluded_ids"), docs))


@query
def query_level_metrics(spark, sf_dir):
    queries, docs = t.domain_corpora(spark, sf_dir)
    one = queries.withColumn("split", F.lit("all"))
    ranked = rank_queries(one, docs.withColumn("split", F.lit("all")))
    got = query_metrics(ranked, qrels_from_gold(one), one)
    return got.select("split", "qid", *[
        F.round(f"`{m}`", 6).alias(m.replace("@", "_at_")) for m in got.columns[2:]])


@query
def evaluation_run(spark, sf_dir):
    queries, docs = t.domain_corpora(spark, sf_dir)
    path = scratch_path(spark, "metrics")
    got = evaluate_run(spark, queries, docs, path, "run", gate=t.GATE)
    return _metric_rows(got).select("run_id", "split", "qlen", "metric", "value")


@query
def text_topk(spark, sf_dir):
    queries, docs = t.text_corpus(spark, sf_dir)
    q = embed_tokens(queries, make_encoder, ["split", "qid"], "query", gate=t.WORD_GATE)
    d = embed_tokens(docs, make_encoder, ["split", "doc_id"],
                     partitions=spark.sparkContext.defaultParallelism)
    return _ranked(exclude_ids(score_topk(q, d, mode="norm"), exclusions_from_lists(queries)))


@query
def text_evaluation(spark, sf_dir):
    queries, docs = t.text_corpus(spark, sf_dir)
    got = evaluate_texts(spark, queries, docs, scratch_path(spark, "metrics"), "run", make_encoder,
                         make_encoder, t.WORD_GATE, document_length=1_000_000,
                         partitions=spark.sparkContext.defaultParallelism)
    return _metric_rows(got).select("run_id", "split", "qlen", "metric", "value")


@query
def small_corpora_run(spark, sf_dir):
    """Two small corpora by language, evaluated together; the second call finds nothing to do."""
    docs = t.table(spark, sf_dir, "documents")
    items = t.table(spark, sf_dir, "benchmark")
    asked = items.select(F.col("item_id").alias("_id"), "text")
    pairs = items.select(F.col("item_id").alias("query-id"),
                         F.explode(F.array(F.col("item_id"), F.col("item_id") + 7)).alias("corpus-id"))
    corpora = [load_beir_tables(docs.where(of).select(F.col("doc_id").alias("_id"), "text"), asked, pairs, name)
               for name, of in [("scifact", F.col("lang") == "en"), ("fiqa2018", F.col("lang") != "en")]]
    path = scratch_path(spark, "metrics")
    for _ in range(2):
        got = evaluate_corpora(spark, corpora, path, "run", make_encoder, make_encoder, t.WORD_GATE,
                               partitions=spark.sparkContext.defaultParallelism)
    return _metric_rows(got).select("run_id", "split", "qlen", "metric", "value")


@query
def split_report(spark, sf_dir):
    rows, _ = report(evaluate(*t.domain_corpora(spark, sf_dir), gate=t.GATE), _expected(spark))
    return rows.withColumn("pct", F.round("pct", 4))


@query
def macro_mean(spark, sf_dir):
    _, mean = report(evaluate(*t.domain_corpora(spark, sf_dir), gate=t.GATE), _expected(spark))
    return mean.withColumn("mean_pct", F.round("mean_pct", 4))


@query
def gold_qrels(spark, sf_dir):
    return qrels_from_gold(t.domain_corpora(spark, sf_dir)[0])


@query
def judged_ranking(spark, sf_dir):
    queries, docs = t.domain_corpora(spark, sf_dir)
    return _ranked_with_rel(join_qrels(rank_queries(queries, docs), qrels_from_gold(queries)))


def _ranked_with_rel(df: DataFrame) -> DataFrame:
    return df.select("split", "qid", "doc_id", "rank", "rel")


def _pairs(spark, sf_dir):
    """Judged pairs from labels: repeated where both grades agree."""
    rows = t.table(spark, sf_dir, "labels")
    return rows.select(F.lit("all").alias("split"), F.col("doc_id").cast("string").alias("qid"),
                       F.explode(F.array("quality", "toxic").cast("array<string>")).alias("doc_id"))


def _benchmark_queries(spark, sf_dir):
    return t.table(spark, sf_dir, "benchmark").select(
        F.lit("all").alias("split"), F.col("item_id").cast("string").alias("qid"))


@query
def qrels_sets(spark, sf_dir):
    queries = _benchmark_queries(spark, sf_dir)
    return qrels_from_pairs(_pairs(spark, sf_dir), queries)


@query
def qrels_set_sizes(spark, sf_dir):
    queries = _benchmark_queries(spark, sf_dir)
    return gold_counts(queries, qrels_from_pairs(_pairs(spark, sf_dir), queries))


@query
def resume_runs(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents")
    labels = t.table(spark, sf_dir, "labels")
    expected = docs.select(F.lit("run").alias("run_id"), F.col("source").alias("split"),
                           route_length(F.col("source"), short_mark="src1").alias("qlen"))
    finished = (docs.join(labels.where("toxic = 1"), "doc_id").select(
        F.lit("run").alias("run_id"), F.col("source").alias("split"),
        route_length(F.col("source"), short_mark="src1").alias("qlen")))
    return resume_pending(expected.dropDuplicates(), finished)


def _present(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents")
    wanted = docs.select(F.col("source").alias("split")).dropDuplicates()
    toxic = docs.join(t.table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")
    return splits_present(wanted, toxic.select(F.col("source").alias("split")))


@query
def splits_found(spark, sf_dir):
    return _present(spark, sf_dir)[0]


@query
def splits_missing(spark, sf_dir):
    return _present(spark, sf_dir)[1]


# Triples

def _hq(spark, sf_dir):
    return hq_triples(t.id_records(spark, sf_dir), t.id_documents(spark, sf_dir), ["position"],
                      row_key=["doc_id"])


def _vl(spark, sf_dir):
    return vl_triples(t.text_records(spark, sf_dir), ["conv_id", "turn"])


def _prompted(spark, sf_dir):
    return explode_product(t.prompted_records(spark, sf_dir), keep=["split", "conv_id", "turn"])


@query
def last_wins(spark, sf_dir):
    return last_wins_dim(t.repeated_documents(spark, sf_dir), ["position"])


@query
def resolve_by_id(spark, sf_dir):
    return _hq(spark, sf_dir)


@query
def resolve_hot_ids(spark, sf_dir):
    """The same look-up when one id in three rows is the same, with salts for it, and others have none."""
    hot = F.array(F.array(F.lit("about"), F.lit("7")))
    none = F.array(F.array(F.lit("about"), F.lit(None).cast("string")))
    records = t.id_records(spark, sf_dir).withColumn(
        "pos", F.when(F.col("query")[0] == "in en", hot).when(F.col("query")[0] == "in fr", none)
        .otherwise(F.col("pos")))
    return resolve_record(records, t.id_documents(spark, sf_dir), ["position"], row_key=["doc_id"],
                          hot_rows=50)


@query
def flatten_pairs(spark, sf_dir):
    return _vl(spark, sf_dir)


@query
def explode_triples(spark, sf_dir):
    return _prompted(spark, sf_dir)


@query
def prompted_queries(spark, sf_dir):
    return t.prompted_records(spark, sf_dir).select(
        "conv_id", "turn", format_query(F.col("prompt"), F.col("query")).alias("query"))


@query
def strip_text(spark, sf_dir):
    c = t.table(spark, sf_dir, "conversations")
    pad = F.concat(F.lit("\u3000\x1c "), F.col("text"), F.lit("\u2029\x85\n"))
    return c.select("conv_id", "turn", py_strip(pad).alias("text"),
                    null_to_empty(F.when(F.col("role") == "user", F.col("role"))).alias("role"))


def _merged(spark, sf_dir):
    return merge_sources({"prompted": _prompted(spark, sf_dir), "hq": _hq(spark, sf_dir),
                          "vl": _vl(spark, sf_dir)})


@query
def merged_triples(spark, sf_dir):
    return _merged(spark, sf_dir)


@query
def triple_counts(spark, sf_dir):
    raw = [r.select(F.lit(n).alias("source")) for n, r in [
        ("prompted", t.prompted_records(spark, sf_dir)), ("hq", t.id_records(spark, sf_dir)),
        ("vl", t.text_records(spark, sf_dir))]]
    return source_counts(raw[0].unionAll(raw[1]).unionAll(raw[2]), _merged(spark, sf_dir))


@query
def corpus_sizes(spark, sf_dir):
    return corpus_counts(*t.domain_corpora(spark, sf_dir))


@query
def shuffled(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents")
    row = F.monotonically_increasing_id()       # partition in the upper bits, row in the lower 33
    mixed = seeded_shuffle(docs, ["doc_id"]).select(
        "doc_id", "shuffle_key", "n_chars", F.shiftright(row, 33).alias("part"),
        row.bitwiseAND(F.lit((1 << 33) - 1)).alias("row_index"))
    return _placed(mixed, "part").drop("part", "row_index")


def _placed(rows: DataFrame, part: str) -> DataFrame:
    """Rows with their 1-based ``place`` over all parts; one row per part is counted ahead."""
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n")).select(
        part, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    return rows.join(before, part).withColumn("place", F.col("before") + F.col("row_index") + 1).drop("before")


@query
def split_train(spark, sf_dir):
    return train_test_split(t.table(spark, sf_dir, "documents"), 0.15, ["doc_id"])[0]


@query
def split_test(spark, sf_dir):
    return train_test_split(t.table(spark, sf_dir, "documents"), 0.15, ["doc_id"])[1]


@query
def limited_batches(spark, sf_dir):
    return limit_batches(t.table(spark, sf_dir, "documents"), 6, 16, ["doc_id"])


# Scans and sinks over written copies of the given tables

@query
def jsonl_triples(spark, sf_dir):
    folder = scratch_path(spark, "jsonl")
    records = t.prompted_records(spark, sf_dir)
    for domain, part in [("pony", F.col("turn") < 2), ("aops", F.col("turn") >= 2)]:
        (records.where(part).select("prompt", "query", "pos", "neg")
         .write.json(f"{folder}/{domain}.jsonl"))
    rows = scan_jsonl(spark, folder, ["pony", "aops"], PROMPTED_RECORD)
    return explode_product(rows, keep=["split"])


@query
def triple_build(spark, sf_dir):
    folder = scratch_path(spark, "build")
    hq = materialize(spark, "hq", f"{folder}/hq", t.id_records(spark, sf_dir),
                     t.id_documents(spark, sf_dir), ["position"])
    prompted = write_verified(project_triple(_prompted(spark, sf_dir)), f"{folder}/prompted")
    merged = merge_tables(spark, {"prompted": prompted, "hq": hq}, f"{folder}/merged", shards=4)
    return _placed(load_triples(spark, merged, row_key=True), "file").drop("file", "row_index")


@query
def manifest_rows(spark, sf_dir):
    """Rows of every part of a verified table, from its manifest, and what is wrong with it.

    A part is one file, or several where it would be too much for a task.
    """
    docs = t.table(spark, sf_dir, "documents")
    files = cut_shards(docs, ["text"], 4) // 4
    place = F.col("doc_id") % 4 * files + F.pmod(F.xxhash64("doc_id"), F.lit(files))
    path = write_verified(docs.repartitionById(4 * files, place.cast("int")), scratch_path(spark, "verified"))
    wrong = damaged_files(spark, path).select("file", "problem")
    part = F.regexp_extract("file", r"^part-(\d+)", 1).cast("int")
    return (read_manifest(spark, path).join(wrong, "file", "left")
            .groupBy(F.floor(part / files).cast("int").alias("part"))
            .agg(F.sum("n").alias("n"), F.coalesce(F.max("problem"), F.lit("good")).alias("state")))


@query
def required_columns(spark, sf_dir):
    """Rows behind a check of their columns; a table without one of them raises."""
    answered = t.answered_turns(spark, sf_dir).withColumnRenamed("answer", "positive")
    try:
        project_triple(answered)
    except ValueError as e:
        missing = str(e)
    return project_triple(answered.withColumn("negative", F.lit(missing).contains("negative").cast("string")))


@query
def prompted_build(spark, sf_dir):
    """All domains from JSON lines to one shuffled triple table, with each row's place."""
    folder = scratch_path(spark, "jsonl")
    records = cut_lineage(t.prompted_records(spark, sf_dir).select(
        "conv_id", "prompt", "query", "pos", "neg"))
    for i, domain in enumerate(DOMAINS):
        (records.where(F.pmod("conv_id", F.lit(len(DOMAINS))) == i).drop("conv_id")
         .write.json(f"{folder}/{domain}.jsonl"))
    path = materialize_prompted(spark, folder, scratch_path(spark, "prompted"), shards=4)
    return _placed(load_triples(spark, path, row_key=True), "file").drop("file", "row_index")


@query
def eval_tables(spark, sf_dir):
    """Per split of the loader: queries, documents, judged pairs; a benchmark passage is a later
    version of the document with its number."""
    docs = t.table(spark, sf_dir, "documents").select(
        F.col("source").alias("split"), F.col("doc_id").alias("id"), F.col("text").alias("content"))
    items = t.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("content"))
    versions = docs.withColumn("part", F.lit(0)).unionByName(
        items.join(docs.select("split", "id"), "id").withColumn("part", F.lit(1)))
    labels = t.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.array("quality", "toxic").alias("gold_ids"))
    examples = (docs.join(labels, "id", "left")
                .select("split", "id", F.col("content").alias("query"), "gold_ids"))
    splits = [f"src{i}" for i in range(20)]
    got = load_eval_tables(examples.withColumn("part", F.lit(0)), versions, splits, order=["part"])
    parts = [got[name].select("split", F.lit(name).alias("part"),
                              F.concat_ws("/", F.col(key), extra).alias("item"))
             for name, key, extra in [("queries", "qid", F.md5("query")), ("corpus", "doc_id", F.md5("text")),
                                      ("qrels", "qid", F.col("doc_id"))]]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def latest_version(spark, sf_dir):
    """Two versions of a tree; the newer path by components is read."""
    root = scratch_path(spark, "versions")
    docs = t.table(spark, sf_dir, "documents")
    for version, text in [("1.0.0", F.lit("old")), ("1.0.0-rc", F.col("text"))]:
        rows = docs.select(F.col("doc_id").alias("id"), text.alias("content"))
        rows.write.parquet(f"{root}/documents/{version}/h/bright-pony.parquet")
        rows.select("id", F.col("content").alias("query"), F.array("id").alias("gold_ids")
                    ).write.parquet(f"{root}/examples/{version}/h/bright-pony.parquet")
    queries, corpus = load_versioned_split(spark, root, ["pony"])
    return queries.join(corpus.withColumnRenamed("doc_id", "qid"), ["split", "qid"]).select(
        "split", "qid", "query", F.col("gold_ids")[0].alias("gold"), "text")


@query
def non_empty_text(spark, sf_dir):
    """Corpus, queries and judgements of one small corpus, with blanked-out texts."""
    docs = t.table(spark, sf_dir, "documents")
    labels = t.table(spark, sf_dir, "labels")
    blank = F.when(F.coalesce(F.col("toxic"), F.lit(0)) == 1, "").otherwise(F.col("text"))
    corpus = docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("_id"), blank.alias("text"))
    queries = t.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("_id"),
        F.when(F.length("text") > 150, "").otherwise(F.col("text")).alias("text"))
    pairs = _pairs(spark, sf_dir).select(F.col("qid").alias("query-id"),
                                         F.col("doc_id").alias("corpus-id"))
    got = load_beir_tables(corpus, queries, pairs, "scifact")
    parts = [got["corpus"].select(F.lit("corpus").alias("part"),
                                  F.concat_ws("/", "doc_id", F.md5("text")).alias("item")),
             got["queries"].select(F.lit("queries").alias("part"),
                                   F.concat_ws("/", "qid", F.md5("text")).alias("item")),
             got["qrels"].select(F.lit("qrels").alias("part"),
                                 F.concat_ws("/", "qid", "doc_id").alias("item"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def text_fallback(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"),
                       text_column(docs).alias("text"),
                       text_column(docs, ("content",)).alias("none"))


# Tokens

@query
def route_lengths(spark, sf_dir):
    return t.domain_corpora(spark, sf_dir)[0].select(
        "split", "qid", route_length(F.col("split")).alias("qlen"))


@query
def truncated_tokens(spark, sf_dir):
    cap = F.when(F.col("label") < 5, 3).otherwise(6)
    return (truncate_tokens(t.tokens(spark, sf_dir), cap)
            .select("id", "pos", "label", F.round(_whole("v"), 6).alias("v_sum")))


def _whole(vector):
    """A number that depends on every value of a vector and its place."""
    return F.aggregate(F.transform(vector, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0),
                       lambda s, x: s + x)


@query
def normalised_tokens(spark, sf_dir):
    double = F.transform("v", lambda x: x * F.lit(3))
    unit = t.tokens(spark, sf_dir).select("id", "pos", l2_normalise(double).alias("u"))
    return unit.select("id", "pos", F.round(_whole("u"), 6).alias("u_sum"),
                       F.round(dot(F.col("u"), F.col("u")), 6).alias("norm"))


@query
def drift(spark, sf_dir):
    old = t.tokens(spark, sf_dir)
    change = F.when(F.col("label") == 3, 1.5).otherwise(1.01)
    head = F.transform(F.col("v").cast("array<double>"), lambda x: x * change)
    tail = F.transform(F.col("v").cast("array<double>"),
                       lambda x: F.when(F.col("id").cast("int") > 20, x * 0.01).otherwise(0.0))
    new = old.select("id", "pos", F.concat(head, tail).alias("v"))
    got = embedding_drift(old, new)
    return got.select("id", F.round("head_drift", 6).alias("head_drift"),
                      F.round("tail_max", 6).alias("tail_max"), "ok")


@query
def embedded_documents(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents")
    got = embed_tokens(docs, make_encoder, ["doc_id"],
                       partitions=spark.sparkContext.defaultParallelism)
    pooled = F.aggregate(F.transform("toks", _whole), F.lit(0.0), lambda s, x: s + x)
    return got.select("doc_id", F.size("toks").alias("n_tokens"),
                      F.round(pooled, 3).alias("toks_sum"))


@query
def embedded_queries(spark, sf_dir):
    items = t.table(spark, sf_dir, "benchmark")
    got = embed_tokens(items, make_encoder, ["item_id"], gate=t.WORD_GATE)
    return got.select("item_id", F.posexplode("w").alias("pos", "w")).withColumn("w", F.round("w", 5))


# The step log

@query
def trailing_loss(spark, sf_dir):
    got = trailing_mean(t.step_log(spark, sf_dir), 50, chunk=2000)
    return got.withColumn("trailing_mean", F.round("trailing_mean", 9))


@query
def reported_steps(spark, sf_dir):
    got = every_kth(trailing_mean(t.step_log(spark, sf_dir), 50, chunk=2000), 50)
    return got.withColumn("trailing_mean", F.round("trailing_mean", 9))
