"""All stages over a small table with odd rows, against plain decisions and all pairs."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lateweave.llm import langid, minhash, toxicity
from lateweave.llm.common import materialize
from lateweave.llm.queries import BYTE_BPE

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"wort{i}" for i in range(4000))
ODD = [(100_001, None), (100_002, ""), (100_003, "123 !!! ²"), (100_004, "a"), (100_004, "a"), (None, "no id but words"),
       (100_005, LONG), (100_006, LONG.upper()), (100_007, LONG + " tail"), (100_008, "of one id the first text of the two"),
       (100_008, "of one id another text that is unlike it")]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    whole = docs.unionByName(odd, allowMissingColumns=True)
    # Columns whose names the stages use themselves.
    whole = whole.withColumn("score", F.lit(0.5)).withColumn("class_id", F.lit(7)).withColumn("key", F.col("text"))
    whole.repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


def staged(spark, sf_dir):
    """What every stage left, by the stages' own functions, each written and read again."""
    docs, left = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, sf_dir), name)
        left.append((before, docs))
    return left


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def near_classes(rows):
    """Class of every (id, text): components over shared ids and weighted Jaccard similarity of 0.8 or more."""
    sets, root = [], list(range(len(rows)))
    for _, text in rows:
        w = minhash.words_of(text or "")
        n = min(5, len(w))
        sets.append(Counter(tuple(w[j:j + n]) for j in range(len(w) - n + 1)) if w else Counter())

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            same_id = rows[i][0] == rows[j][0]
            if rows[i][0] is None or rows[j][0] is None:
                continue
            b = sets[j]
            if same_id or sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                root[top(i)] = top(j)
    return [top(i) for i in range(len(rows))]


def test_stages(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "exact_copies", "near_copies", "packing"]
    left = staged(spark, sf_dir)
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert all(after.columns == columns for _, after in left[:-1])

    # Language: what has a letter and a prediction above the threshold.
    before, after = left[0]
    model = langid.fit_languages(before)
    weights = model.weights().astype(np.float32)
    want = []
    for r in before.collect():
        lang, score = langid.predict_texts(model, weights, [r.text or ""])
        if any(map(str.isalpha, r.text or "")) and lang[0] != "und" and score[0] >= langid.LEAST_SCORE:
            want.append(tuple(r))
    assert rows(after) == sorted(want, key=str) and len(want) == before.count() - 3

    # Toxicity: what scores below the threshold.
    before, after = left[1]
    field = toxicity.fit_field(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = toxicity.Scorer(field)
    want = [tuple(r) for r in before.collect() if score([r.text])[0][0] < toxicity.THRESHOLD]
    assert rows(after) == sorted(want, key=str)

    # Exact copies: of equal texts the largest id, one row of it.
    before, after = left[2]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    best = {}
    for r in before.collect():
        body = r.text.translate(lower)
        best[body] = max(best.get(body, (-1,)), (-1 if r.doc_id is None else r.doc_id,))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text.translate(lower)) for r in after.collect()) == sorted(
        (i, body) for body, (i,) in best.items())

    # Near copies: of each class the rows of its smallest id; rows without an id stay.
    before, after = left[3]
    given = [(r.doc_id, r.text) for r in before.collect()]
    low = defaultdict(lambda: 1 << 60)
    classes = near_classes(given)
    for (i, _), c in zip(given, classes):
        low[c] = min(low[c], 1 << 60 if i is None else i)
    want = sorted([g for g, c in zip(given, classes) if g[0] is None or g[0] == low[c]], key=str)
    assert sorted([(r.doc_id, r.text) for r in after.collect()], key=str) == want

    # Packing: every token of what stays, once and in order; no sequence has a gap or is too long.
    docs, packed = left[4]
    check_packed(docs, packed)


def check_packed(docs, packed):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE_BPE)
    p = packed.toPandas()
    want = Counter()
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [1]
        for start in range(0, len(ids), 2048):
            piece = np.array(ids[start:start + 2048], dtype="<u4")
            want[r.doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    got = Counter((None if pd.isna(i) else int(i), *x) for i, *x in zip(
        p.doc_id, p.start.tolist(), p.length.tolist(), p.ids_crc32.tolist(), p.doc_tokens.tolist()))
    assert got == want
    for _, s in p.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048


def test_run_is_its_stages(spark, sf_dir):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert rows(corpus_pipeline.run(spark, sf_dir).select(columns)) == rows(staged(spark, sf_dir)[-1][1].select(columns))


def test_empty_tables(spark, sf_dir, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_documents_stay_where_nothing_can_be_learned(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language(spark, docs, sf_dir)
    assert rows(kept) == sorted([tuple(r) for r in docs.collect() if any(map(str.isalpha, r.text or ""))], key=str)
    assert corpus_pipeline.toxic(spark, docs, sf_dir).columns == docs.columns


def test_wanted_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit_languages(docs)
    found = {r.doc_id: r.lang_pred for r in langid.predict_languages(docs, model).collect()}
    kept = {r.doc_id for r in langid.keep_languages(docs, model, ["de", "fr"], 0.0).collect()}
    assert kept == {i for i, lang in found.items() if lang in ("de", "fr")} and kept
