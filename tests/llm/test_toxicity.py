"""Long labelled documents leave room for the others, and held-out rows are judged label by label."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lateweave.llm import toxicity
from lateweave.llm.common import held_out
from lateweave.llm.queries import op10_toxicity

FULL = "/root/testdata/sf0.1"


def tables(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")


def rows_of(long_toxic=False):
    long = [(i, "calm water flows " * 700, 0) for i in range(1000, 1400)]
    clean = [(i, f"calm water number{i} flows", 0) for i in range(100, 160)]
    bad = [(i, ("you vile wretch " * (2000 if long_toxic else 1)) + f"number{i}", 1) for i in range(200, 260)]
    return long + clean + bad


def test_long_documents_leave_room(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_WORDS", 4000)
    docs, labels = tables(spark, rows_of())
    field = toxicity.fit_field(docs, labels)
    assert field is not None
    got = toxicity.score_documents(docs.filter(held_out(F.col("doc_id"))), field).join(labels, "doc_id").toPandas()
    assert set(got.toxic) == {0, 1} and (got.predicted == got.toxic).all()


def test_a_label_without_a_row_raises(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_WORDS", 4000)
    docs, labels = tables(spark, rows_of(long_toxic=True))
    with pytest.raises(ValueError, match="toxic"):
        toxicity.fit_field(docs, labels)
    assert toxicity.fit_field(docs, labels.filter("toxic = 0")) is None
    assert toxicity.fit_field(docs.limit(0), labels) is None


def test_recall_and_false_alarms(spark):
    got = op10_toxicity(spark, FULL).toPandas().merge(pd.read_parquet(f"{FULL}/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    assert held[held.toxic == 1].predicted.mean() >= 0.8
    assert held[held.toxic == 0].predicted.mean() <= 0.02
