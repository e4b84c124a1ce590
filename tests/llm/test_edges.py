"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from lateweave.llm import ann, exact, langid, licenses, minhash, packing, pieces, records, toxicity, warc
from lateweave.llm.queries import BYTE_BPE, PIECES
from lateweave.session import scratch_path

SCHEMA = "doc_id long, text string, lang string, digest string, key string, score double, kept int"
LONG = " ".join(f"word{i}" for i in range(30_000))
ROWS = [(1, None), (2, ""), (3, "!!!"), (4, "a"), (4, "a"), (None, "no id"), (5, LONG), (6, LONG.upper()),
        (7, LONG + " tail"), (8, "  two  spaces \n tab\t é 日本語 <|endoftext|> "), (9, "Größe, don't stop.")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "y", 0.5, 1) for i, t in rows], SCHEMA)


def token_records(docs):
    spark = docs.sparkSession
    folder = scratch_path(spark, "records")
    manifest = records.write_token_records(docs, folder, BYTE_BPE)
    index = records.read_index(spark, manifest, folder)
    again = records.record_digests(records.fetch_records(index, folder).withColumn("start", F.lit(0).cast("bigint")))
    whole = records.record_digests(records.read_token_records(spark, manifest, folder))
    assert (sorted(map(str, again.drop("start").collect())) == sorted(map(str, whole.drop("start").collect())))
    return whole


OPERATORS = {
    "near": lambda d: minhash.near_duplicates(d),
    "exact": lambda d: exact.exact_duplicates(d),
    "pieces": lambda d: pieces.piece_digests(pieces.decode_pieces(pieces.encode_pieces(d, PIECES), PIECES, True)),
    "records": token_records,
    "languages": lambda d: langid.predict_languages(d, langid.fit_languages(d)),
    "packing": lambda d: packing.pack_documents(d, BYTE_BPE),
    "toxicity": lambda d: toxicity.score_documents(d, None),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_table(spark, name):
    got = [r.doc_id for r in OPERATORS[name](frame(spark, ROWS)).collect()]
    want = [i for i, _ in ROWS]
    key = lambda x: (x is not None, x)
    if name == "packing":
        assert set(got) == set(want)
    else:
        assert sorted(got, key=key) == sorted(want, key=key)
    assert OPERATORS[name](frame(spark, [])).collect() == []


def test_values_of_odd_rows(spark):
    docs = frame(spark, ROWS)
    near = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert near == {1: 1, 2: 1, 3: 3, 4: 4, None: None, 5: 5, 6: 5, 7: 5, 8: 8, 9: 9}
    same = [r for r in exact.exact_duplicates(docs).collect() if r.doc_id in (1, 2, 4, 5, 6)]
    assert {(r.doc_id, r.keep_id, r.group_size) for r in same} == {(1, 2, 2), (2, 2, 2), (4, 4, 2), (5, 6, 2),
                                                                   (6, 6, 2)}
    assert sorted(r.kept for r in same if r.doc_id == 4) == [False, True]
    stay = exact.drop_copies(docs)
    assert stay.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in stay.collect()) == [0, 2, 3, 4, 6, 7, 8, 9]
    lang = {r.doc_id: r.lang_pred for r in langid.predict_languages(docs, langid.fit_languages(docs)).collect()}
    assert lang[1] == lang[2] == lang[3] == "und" and lang[4] == "en"


def test_digest_collisions_do_not_merge_texts(spark):
    """One digest for all texts: the byte check tells them apart."""
    docs = frame(spark, [(1, "a"), (2, "b"), (3, "A"), (4, "c"), (5, "b")])
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept)
           for r in exact.exact_duplicates(docs, digest=lambda t: F.lit(b"same")).collect()}
    assert got == {1: (3, 2, False), 2: (5, 2, False), 3: (3, 2, True), 4: (4, 1, True), 5: (5, 2, True)}


def test_broken_record_raises(spark):
    from io import BytesIO

    raw = records.frame(b"payload")
    assert records.read_frame(BytesIO(raw)) == b"payload"
    for i in range(len(raw)):
        with pytest.raises(ValueError):
            records.read_frame(BytesIO(raw[:i] + bytes([raw[i] ^ 1]) + raw[i + 1:]))


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]),
            (6, [0.0, 1.0]), (7, [1.0, 0.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest_neighbours(df, F.col("vec_id") % 2 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got] == [
        (0, 1, 1, 1.0), (0, 2, 6, 0.0), (6, 1, 0, 0.0), (6, 2, 1, 0.0)]
    assert ann.nearest_neighbours(df.limit(0), F.col("vec_id") % 2 == 0).collect() == []


def test_pages_and_licenses(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", "<p>a<script>x</script>b &amp; c")],
                                  "page_id long, url string, html string")
    made = warc.derivative_records(warc.response_records(pages)).collect()
    assert len(made) == 6
    text = {r.source_id: warc.parse(bytes(r.record))[0][1] for r in made if r.record_type == "conversion"}
    assert text == {"1": b"", None: b"", "2": b"ab & c"}
    twice = "Released under the MIT License. Then more. Released under the MIT License."
    docs = frame(spark, [(1, None), (2, twice), (None, "released  UNDER the mit license")])
    assert sorted(str(r.doc_id) for r in licenses.scan_licenses(docs).collect()) == ["2", "2", "None"]


def test_every_text_of_a_repeated_id_is_compared(spark):
    """Two different texts under one id: a third document that is like the larger one finds its class."""
    a = " ".join(f"a{i}" for i in range(300))
    b = " ".join(f"b{i}" for i in range(300))
    docs = frame(spark, [(1, a), (1, b), (2, b + " more"), (3, "other words of its own here"), (4, a + " too"),
                         (5, b + " more"), (9, "other words of its own here now")])
    got = sorted((r.doc_id, r.class_id, r.class_size) for r in minhash.near_duplicates(docs).collect())
    assert got == [(1, 1, 5), (1, 1, 5), (2, 1, 5), (3, 3, 1), (4, 1, 5), (5, 1, 5), (9, 9, 1)]
    three = frame(spark, [(7, a), (7, b), (7, "c d e f g h"), (8, "c d e f g h"), (6, b), (2, a)])
    assert {(r.doc_id, r.class_id, r.class_size) for r in minhash.near_duplicates(three).collect()} == {
        (i, 2, 6) for i in (2, 6, 7, 8)}
