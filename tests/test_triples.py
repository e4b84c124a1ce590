"""Record rules against a plain statement of them, on random records."""

import random

from pyspark.sql import functions as F

from lateweave.functions.text import PY_WHITESPACE, format_query, py_strip, text_column
from lateweave.operators.triples import (
    explode_product, flatten_record, last_wins_dim, min_length_filter, resolve_record,
)
from lateweave.schemas import NESTED_RECORD, PROMPTED_RECORD, require_columns

ROWS = 300


def text(rng, longest=14):
    alphabet = "ab é\U0001f600" + PY_WHITESPACE
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest)))


def pair_list(rng, ids=False):
    n = rng.choice([0, 1, 1, 1, 2])
    out = []
    for _ in range(n):
        items = [text(rng) for _ in range(rng.choice([0, 1, 2, 2]))]
        if ids and len(items) == 2:
            items[1] = str(rng.randint(0, 12))
        out.append(items)
    return out


def nested(rng, ids):
    return ([text(rng) for _ in range(rng.randint(0, 3))], pair_list(rng, ids), pair_list(rng))


def two_or_one(items, pair, single, nothing=""):
    if items and len(items[0]) > 1:
        return pair(items[0])
    if items and len(items[0]) == 1:
        return single(items[0])
    return nothing


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_all_python_whitespace_is_stripped(spark):
    assert len(PY_WHITESPACE) == 29
    texts = [w + "x" + w for w in PY_WHITESPACE] + [PY_WHITESPACE, "", "a​"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(py_strip(F.col("t"))).collect()
    assert [r[0] for r in got] == [t.strip() for t in texts]


def test_resolve_record(spark):
    rng = random.Random(1)
    records = [nested(rng, True) for _ in range(ROWS)]
    docs = [(i % 9, f"text {i} " + text(rng), i) for i in range(20)]
    last = {str(i): t for i, t, _ in docs}

    def expected(query, pos, neg):
        pair = pos and len(pos[0]) > 1
        found = last.get(pos[0][1], pos[0][1]) if pair else last.get("", "")
        positive = pos[0][0] + " " + found if pair and pos[0][0] else found
        return (" ".join(query), positive, two_or_one(neg, " ".join, lambda x: x[0]))

    df = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(records)], "n int, " + NESTED_RECORD.simpleString()[7:-1].replace(":", " "))
    documents = spark.createDataFrame(docs, "id int, content string, row int")
    want = sorted(expected(*r) for r in records)
    for hot in (200_000, 10):
        got = resolve_record(df, documents, ["row"], row_key=["n"], hot_rows=hot)
        assert rows_of(got, "query", "positive", "negative") == want
    kept = min_length_filter(resolve_record(df, documents, ["row"]))
    assert rows_of(kept, "query", "positive", "negative") == [
        w for w in want if len(w[1]) > 10 and len(w[2]) > 10]


def test_last_wins_dim(spark):
    docs = spark.createDataFrame(
        [(1, "old", 0, 5), (1, "new", 1, 0), (2, "only", 0, 1), (1, "mid", 0, 9)],
        "id int, content string, part int, row int")
    assert rows_of(last_wins_dim(docs, ["part", "row"]), "doc_id", "content") == [
        ("1", "new"), ("2", "only")]


def test_flatten_record(spark):
    rng = random.Random(2)
    records = [nested(rng, False) for _ in range(ROWS)]

    def side(items):
        return two_or_one(items, lambda x: " ".join(x[:2]).strip(), lambda x: x[0])

    want = sorted((" ".join(q), side(p), side(n)) for q, p, n in records)
    got = flatten_record(spark.createDataFrame(records, NESTED_RECORD))
    assert rows_of(got, "query", "positive", "negative") == want


def test_plain_string_query(spark):
    df = spark.createDataFrame([("a b", [["x", "y"]], [["z"]])],
                               "query string, pos array<array<string>>, neg array<array<string>>")
    assert rows_of(flatten_record(df), "query", "positive", "negative") == [("a b", "x y", "z")]


def maybe(rng, make):
    return None if rng.random() < 0.15 else make()


def test_explode_product(spark):
    rng = random.Random(3)
    records = [(maybe(rng, lambda: text(rng)), maybe(rng, lambda: text(rng)),
                maybe(rng, lambda: [maybe(rng, lambda: text(rng, 16)) for _ in range(rng.randint(0, 4))]),
                maybe(rng, lambda: [maybe(rng, lambda: text(rng, 16)) for _ in range(rng.randint(0, 6))]))
               for _ in range(ROWS)]
    df = spark.createDataFrame(records, PROMPTED_RECORD)

    def expected(row, n_pos, n_neg):
        p, q = ((x or "").strip() for x in row[:2])
        query = f"{p}\nQuery: {q}" if p and q else p or q
        def usable(items, n):
            return [t for t in ((x or "").strip() for x in (items or [])[:n]) if len(t) >= 10]
        return [(query, a, b) for a in usable(row[2], n_pos) for b in usable(row[3], n_neg) if query]

    for n_pos, n_neg in [(2, 4), (1, 1), (9, 9), (0, 4)]:
        got = explode_product(df, n_pos, n_neg)
        want = sorted(t for r in records for t in expected(r, n_pos, n_neg))
        assert rows_of(got, "query", "positive", "negative") == want


def test_length_limits_differ(spark):
    flat = spark.createDataFrame([("q", "x" * n, "y" * 11) for n in (9, 10, 11)],
                                 "query string, positive string, negative string")
    assert [len(r.positive) for r in min_length_filter(flat).collect()] == [11]
    listed = spark.createDataFrame([("", "q", ["x" * n], ["y" * 10]) for n in (9, 10, 11)],
                                   PROMPTED_RECORD)
    assert sorted(len(r.positive) for r in explode_product(listed).collect()) == [10, 11]


def test_format_query_nulls(spark):
    df = spark.createDataFrame([(" p ", " q "), (None, "q"), ("p", None), (None, None), ("p", " ")],
                               "p string, q string")
    got = [r[0] for r in df.select(format_query(F.col("p"), F.col("q"))).collect()]
    assert got == ["p\nQuery: q", "q", "p", "", "p"]


def test_text_column_falls_back_on_absence_not_null(spark):
    both = spark.createDataFrame([(None, "t")], "content string, text string")
    one = both.select("text")
    none = both.select(F.lit(1).alias("id"))
    assert [df.select(text_column(df)).first()[0] for df in (both, one, none)] == [None, "t", ""]


def test_missing_columns_raise(spark):
    try:
        require_columns(spark.range(1), ["id", "query"])
    except ValueError as e:
        assert "query" in str(e)
    else:
        raise AssertionError("no error")
