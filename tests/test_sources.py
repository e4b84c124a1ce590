import json
import logging

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lateweave.functions.gate import Gate, init_gate
from lateweave.plans.build_triples import (
    materialize, materialize_prompted, merge_tables, prompted_triples,
)
from lateweave.operators.triples import last_wins_dim
from lateweave.plans.evaluate import evaluate_run, evaluate_texts, report
from lateweave.schemas import DOMAINS, PROMPTED_RECORD, TRIPLE_COLUMNS
from lateweave.session import checkpoint_dir, scratch_path
from lateweave.sources import paths, writers
from lateweave.sources.readers import (
    in_scan_order,     load_beir_tables, load_eval_tables, load_triples, load_versioned_split, scan_jsonl,
    scan_latest_version, scan_tolerant, select_domains,
)
from lateweave.sources.writers import (
    damaged_files, load_gate, materialize_once, read_manifest, save_gate, write_replace, write_verified,
)
from workload.encoder import make_encoder


def triples(spark, n, tag=""):
    return spark.range(n).select(*[F.concat(F.lit(c + tag), F.col("id") % 5).alias(c) for c in TRIPLE_COLUMNS])


def write_lines(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")


def test_jsonl(spark, tmp_path):
    write_lines(tmp_path / "pony.jsonl",
                json.dumps({"query": "what", "pos": ["p" * 10], "neg": ["n" * 10, None]}), "", "  ",
                json.dumps({"prompt": None, "query": "x", "pos": None}))
    write_lines(tmp_path / "aops.jsonl",
                json.dumps({"prompt": "do", "query": "it", "pos": ["p" * 12], "neg": ["n" * 12], "extra": 1}))
    rows = scan_jsonl(spark, str(tmp_path), ["pony", "aops"], PROMPTED_RECORD)
    assert {(r.split, r.prompt, r["query"]) for r in rows.collect()} == {
        ("pony", None, "what"), ("pony", None, "x"), ("aops", "do", "it")}
    got = prompted_triples(spark, str(tmp_path), "pony")
    assert [(r.split, r["query"]) for r in got.collect()] == [("pony", "what")]
    write_lines(tmp_path / "leetcode.jsonl", json.dumps({"query": "x"}))
    with pytest.raises(RuntimeError):
        prompted_triples(spark, str(tmp_path), "leetcode")


def test_malformed_line_raises(spark, tmp_path):
    write_lines(tmp_path / "pony.jsonl", '{"query": "a"}', '{"query": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        scan_jsonl(spark, str(tmp_path), ["pony"]).collect()


def test_select_domains():
    assert select_domains() == DOMAINS and len(DOMAINS) == 12
    assert select_domains("aops") == ["aops"]
    with pytest.raises(ValueError):
        select_domains("chess")


def put(path, **columns):
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table(columns), path)


def test_latest_version(spark, tmp_path):
    for version, tag in [("1.0.0", "old"), ("1.0.0-rc", "new"), ("0.9", "older")]:
        put(tmp_path / "examples" / version / "h" / "bright-pony.parquet",
            id=[1], query=[tag], gold_ids=[["3"]])
        put(tmp_path / "documents" / version / "h" / "bright-pony.parquet", id=[3], content=[tag])
    put(tmp_path / "examples" / "1.0.0" / "h" / "bright-aops.parquet", id=["7"], query=["q"], gold_ids=[[4]])
    examples, documents = scan_latest_version(spark, str(tmp_path), ["pony", "aops"])
    assert set(examples) == set(documents) == {"pony"}
    assert "1.0.0-rc" in examples["pony"] and "1.0.0-rc" in documents["pony"]

    def fallback(split):
        return (spark.createDataFrame([(9, "fq", [1], [2])],
                                      "id int, query string, gold_ids array<int>, excluded_ids array<int>"),
                spark.createDataFrame([(1, "ft")], "id int, text string"))

    queries, docs = load_versioned_split(spark, str(tmp_path), ["pony", "aops"], fallback)
    assert {tuple(map(str, r)) for r in queries.collect()} == {
        ("pony", "1", "new", "['3']", "[]"), ("aops", "9", "fq", "['1']", "['2']")}
    assert {tuple(r) for r in docs.collect()} == {("pony", "3", "new"), ("aops", "1", "ft")}
    with pytest.raises(FileNotFoundError):
        load_versioned_split(spark, str(tmp_path), ["aops"])


def test_tolerant_scan_ignores_foreign_metadata(spark, tmp_path):
    table = pa.table({"id": [1, 2], "content": ["a", "b"]}).replace_schema_metadata(
        {"org.apache.spark.sql.parquet.row.metadata": '{"type":"unheard-of"}', "foreign": '{"x": "List"}'})
    pq.write_table(table, tmp_path / "t.parquet")
    got = scan_tolerant(spark, str(tmp_path / "t.parquet"), schema="id long, content string")
    assert got.count() == 2 and got.columns == ["id", "content"]
    assert scan_tolerant(spark, str(tmp_path / "t.parquet")).count() == 2


def test_tolerant_scan_opens_one_footer(spark, tmp_path):
    """Other types, other columns and a broken footer elsewhere: columns go by name, types by cast."""
    folder = tmp_path / "t.parquet"
    folder.mkdir()
    pq.write_table(pa.table({"content": ["a"], "id": pa.array([1], pa.int32()), "more": [0.5]}), folder / "part-0.parquet")
    pq.write_table(pa.table({"id": pa.array([2], pa.int32())}), folder / "part-1.parquet")
    files = [str(folder / f"part-{i}.parquet") for i in (0, 1)]
    got = scan_tolerant(spark, *files, schema="id string, content string, absent long")
    assert got.dtypes == [("id", "string"), ("content", "string")]
    assert sorted(map(tuple, got.collect())) == [("1", "a"), ("2", None)]
    (folder / "part-2.parquet").write_bytes(b"no parquet")
    assert scan_tolerant(spark, *files, str(folder / "part-2.parquet"), schema="id string").columns == ["id"]


def test_scan_order_survives_a_shuffle(spark, tmp_path):
    """The last row of the last file of the last table wins, wherever its rows come to lie."""
    folder = tmp_path / "docs"
    folder.mkdir()
    for name, rows in [("b", [("x", "b0"), ("y", "b1"), ("x", "b2")]), ("a", [("x", "a0"), ("z", "a1"), ("z", "a2")])]:
        pq.write_table(pa.table({"id": [r[0] for r in rows], "content": [r[1] for r in rows]}), folder / f"{name}.parquet")
    pq.write_table(pa.table({"id": ["y"], "content": ["later"]}), tmp_path / "items.parquet")
    rows = in_scan_order(spark.read.parquet(str(folder)), spark.read.parquet(str(tmp_path / "items.parquet")))
    got = last_wins_dim(rows.repartition(7), ["position"]).collect()
    assert {r.doc_id: r.content for r in got} == {"x": "b2", "y": "later", "z": "a2"}


def test_damaged_files_are_named(spark, tmp_path):
    path = str(tmp_path / "table")
    write_verified(spark.range(100).repartitionById(4, (F.col("id") % 4).cast("int")), path)
    files = sorted(r.file for r in read_manifest(spark, path).collect())
    assert len(files) == 4 and damaged_files(spark, path).collect() == []
    assert spark.read.parquet(path).count() == 100
    raw = (tmp_path / "table" / files[1]).read_bytes()
    (tmp_path / "table" / files[1]).write_bytes(raw[:len(raw) // 2])
    (tmp_path / "table" / f".{files[1]}.crc").unlink()
    (tmp_path / "table" / files[2]).unlink()
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "other"))
    new = next((tmp_path / "other").glob("part-*.parquet"))
    (tmp_path / "table" / files[3]).write_bytes(new.read_bytes())
    (tmp_path / "table" / f".{files[3]}.crc").unlink()
    (tmp_path / "table" / "part-9.parquet").write_bytes(new.read_bytes())
    spark.catalog.refreshByPath(path)
    got = {r.file: r.problem for r in damaged_files(spark, path).collect()}
    assert got == {files[1]: "unreadable", files[2]: "unreadable", files[3]: "changed", "part-9.parquet": "unknown"}


def test_a_changed_input_builds_anew(spark, tmp_path):
    source, path, built = tmp_path / "source", str(tmp_path / "table"), []
    source.mkdir()
    (source / "a.jsonl").write_text("x")

    def build():
        built.append(1)
        return triples(spark, 3)

    for _ in range(2):
        materialize_once(spark, path, TRIPLE_COLUMNS, build, [str(source)])
    assert len(built) == 1
    (source / "b.jsonl").write_text("y")
    materialize_once(spark, path, TRIPLE_COLUMNS, build, [str(source)])
    assert len(built) == 2
    (source / "a.jsonl").write_text("longer")
    for _ in range(2):
        materialize_once(spark, path, TRIPLE_COLUMNS, build, [str(source)])
    assert len(built) == 3 and spark.read.parquet(path).count() == 3


def test_a_gate_of_another_size_raises(spark, tmp_path):
    path = save_gate(spark, init_gate(4), str(tmp_path / "gate"))
    assert load_gate(spark, path, dim=4).in_features == 4
    with pytest.raises(ValueError, match="4 values, not 5"):
        load_gate(spark, path, dim=5)


def test_eval_tables(spark, caplog):
    examples = spark.createDataFrame(
        [("biology", 1, "first", ["d1"], 0), ("biology", 1, "last", ["d2", "d2"], 1), ("biology", 2, "q", None, 2)],
        "split string, id int, query string, gold_ids array<string>, row int")
    documents = spark.createDataFrame(
        [("biology", 5, "old", 0), ("biology", 5, "new", 1), ("aops", 6, "x", 2)],
        "split string, id int, content string, row int")
    with caplog.at_level(logging.WARNING):
        got = load_eval_tables(examples, documents, ["biology", "aops"], order=["row"])
    assert "aops" in caplog.text
    assert {tuple(r) for r in got["queries"].collect()} == {("biology", "1", "last"), ("biology", "2", "q")}
    assert [tuple(r) for r in got["corpus"].collect()] == [("biology", "5", "new")]
    assert [tuple(r) for r in got["qrels"].collect()] == [("biology", "1", "d2", 1)]


def test_beir_tables(spark):
    corpus = spark.createDataFrame([("a", "text"), ("b", "")], "_id string, text string")
    queries = spark.createDataFrame([("1", "q"), ("2", "")], "_id string, text string")
    pairs = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "a")], ["query-id", "corpus-id"])
    got = load_beir_tables(corpus, queries, pairs, "scifact")
    assert [r.doc_id for r in got["corpus"].collect()] == ["a"]
    assert [r.qid for r in got["queries"].collect()] == ["1"]
    assert got["qrels"].count() == 1
    with pytest.raises(ValueError):
        load_beir_tables(corpus, queries, pairs, "nothing")


def test_load_triples(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_triples(spark, str(tmp_path / "none"))
    triples(spark, 7).withColumn("extra", F.lit(1)).write.parquet(str(tmp_path / "t"))
    assert load_triples(spark, str(tmp_path / "t")).columns == TRIPLE_COLUMNS
    triples(spark, 3).drop("negative").write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="negative"):
        load_triples(spark, str(tmp_path / "bad"))
    triples(spark, 2).write.parquet(str(tmp_path / "many" / "a_train"))
    triples(spark, 4).write.parquet(str(tmp_path / "many" / "b_test"))
    assert load_triples(spark, str(tmp_path / "many")).count() == 2


def boom(spark):
    return triples(spark, 3).withColumn("query", F.raise_error(F.lit("boom")).cast("string"))


@pytest.mark.parametrize("write", [write_replace, write_verified])
def test_replace_keeps_the_old_table_on_failure(spark, tmp_path, write):
    path = str(tmp_path / "t")
    write(triples(spark, 5), path)
    write(triples(spark, 9), path)
    assert spark.read.parquet(path).count() == 9
    with pytest.raises(Exception, match="boom"):
        write(boom(spark), path)
    assert spark.read.parquet(path).count() == 9
    write(triples(spark, 4), path)
    assert spark.read.parquet(path).count() == 4
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_verified_write_shards_and_mismatch(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    write_verified(triples(spark, 100), path, shards=3)
    assert len(list((tmp_path / "t").glob("*.parquet"))) == 3
    real = writers._fingerprint
    calls = []

    def broken(columns):
        calls.append(1)
        return real(columns if len(calls) == 1 else columns[:1])

    monkeypatch.setattr(writers, "_fingerprint", broken)
    with pytest.raises(OSError, match="read back"):
        write_verified(triples(spark, 50), path)
    assert spark.read.parquet(path).count() == 100
    assert (tmp_path / ".t.tmp").exists()


def test_materialize_once(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []

    def build():
        calls.append(1)
        return triples(spark, 3)

    for _ in range(2):
        materialize_once(spark, path, TRIPLE_COLUMNS, build)
    assert len(calls) == 1
    paths.delete(spark, f"{path}/_SUCCESS")
    materialize_once(spark, path, TRIPLE_COLUMNS, build)
    assert len(calls) == 2
    with pytest.raises(ValueError):
        materialize(spark, "other", path, triples(spark, 1))


def test_merge_tables(spark, tmp_path):
    inputs = {n: write_replace(triples(spark, k, n), str(tmp_path / n)) for n, k in [("a", 40), ("b", 25)]}
    merged = merge_tables(spark, inputs, str(tmp_path / "m"), shards=4)
    rows = [tuple(r) for r in load_triples(spark, merged).collect()]
    assert len(rows) == 65
    assert len(list((tmp_path / "m").glob("*.parquet"))) == 4
    again = {n: write_replace(spark.read.parquet(p).coalesce(1), str(tmp_path / "again" / n))
             for n, p in inputs.items()}
    rebuilt = {n: write_replace(triples(spark, k, n), str(tmp_path / "rebuilt" / n)) for n, k in [("a", 40), ("b", 25)]}
    second = load_triples(spark, merge_tables(spark, rebuilt, str(tmp_path / "m2"), shards=4))
    assert [tuple(r) for r in second.collect()] == rows
    third = load_triples(spark, merge_tables(spark, again, str(tmp_path / "m3"), shards=4))
    assert [tuple(r) for r in third.collect()] == rows
    both = [tuple(r) for n in inputs.values() for r in spark.read.parquet(n).collect()]
    assert sorted(rows) == sorted(both) and rows != both


def test_row_count_is_checked(spark, tmp_path):
    with pytest.raises(ValueError, match="expected 6"):
        write_verified(triples(spark, 5), str(tmp_path / "t"), expect_rows=6)
    assert not (tmp_path / "t").exists()


def test_prompted_table(spark, tmp_path):
    lines = [json.dumps({"query": f"q{i}", "pos": ["p" * 10], "neg": ["n" * 10]}) for i in range(30)]
    write_lines(tmp_path / "pony.jsonl", *lines)
    path = materialize_prompted(spark, str(tmp_path), str(tmp_path / "t"), "pony", shards=2)
    got = [r["query"] for r in load_triples(spark, path).collect()]
    assert sorted(got) == sorted(f"q{i}" for i in range(30)) and got != [f"q{i}" for i in range(30)]


def test_gate_table(spark, tmp_path):
    path = str(tmp_path / "gate")
    with pytest.raises(FileNotFoundError):
        load_gate(spark, path)
    assert load_gate(spark, path, require_gate=False, dim=3) == init_gate(3)
    with pytest.raises(ValueError):
        load_gate(spark, path, require_gate=False)
    for gate in (Gate([1.0, 2.0], 0.5), init_gate(3, hidden=2)):
        save_gate(spark, gate, path)
        assert load_gate(spark, path) == gate


def test_evaluation_from_texts(spark, tmp_path):
    queries = spark.createDataFrame(
        [("aops", "1", "red fox", ["a"], ["c"]), ("pony", "2", "blue", ["b"], [])],
        "split string, qid string, query string, gold_ids array<string>, excluded_ids array<string>")
    docs = spark.createDataFrame(
        [("aops", "a", "the red fox"), ("aops", "c", "red fox"), ("aops", "d", "a hen"), ("pony", "b", "blue")],
        "split string, doc_id string, text string")
    path = str(tmp_path / "metrics")

    def run(run_id):
        return evaluate_texts(spark, queries, docs, path, run_id, make_encoder, make_encoder)

    got = {(r.split, r.metric): r.value for r in run("r").collect()}
    assert got["aops", "ndcg@1"] == got["pony", "ndcg@1"] == 1.0
    assert run("r").count() == 12


def test_checkpoint_folder(spark):
    folder = checkpoint_dir(spark)
    mine = f"{folder.rstrip('/')}/scratch-{spark.sparkContext.applicationId}/"
    assert folder and scratch_path(spark, "x").startswith(f"{mine}x-")


def test_arrow_locations(tmp_path):
    (tmp_path / "a b").mkdir()
    for uri in (f"{tmp_path}/a b", (tmp_path / "a b").as_uri()):
        store, path = paths.arrow_location(uri)
        assert store.get_file_info(path).is_file is False and path.endswith("/a b")
    with pytest.raises(ValueError, match="viewfs"):
        paths.arrow_location("viewfs://store/x")


def test_evaluation_resumes(spark, tmp_path):
    def toks(*xs):
        return [[float(x), 1.0] for x in xs]

    queries = spark.createDataFrame(
        [("pony", "q1", toks(*range(40)), ["d1"], ["d3"]), ("aops", "q2", toks(1), ["d9"], [])],
        "split string, qid string, toks array<array<float>>, gold_ids array<string>, excluded_ids array<string>")
    docs = spark.createDataFrame([("pony", f"d{i}", toks(i, 2)) for i in range(5)] + [("aops", "d9", toks(1))],
                                 "split string, doc_id string, toks array<array<float>>")
    path = str(tmp_path / "metrics")
    first = evaluate_run(spark, queries.where("split = 'aops'"), docs, path, "r")
    assert {r.split for r in first.collect()} == {"aops"}
    both = evaluate_run(spark, queries, docs, path, "r")
    got = {(r.split, r.metric): (r.qlen, r.value) for r in both.collect()}
    assert both.count() == 12
    assert got["aops", "ndcg@10"] == (256, 1.0)
    assert got["pony", "map"] == (32, pytest.approx(1 / 3))       # d4, then excluded d3, d2, d1
    assert evaluate_run(spark, queries, docs, path, "r").count() == 12
    assert evaluate_run(spark, queries, docs, path, "other").count() == 12
    expected = spark.createDataFrame([(s,) for s in DOMAINS], "split string")
    rows, mean = report(both, expected)
    assert rows.where("status = 'done'").count() == 2 and mean.first().n_present == 2
