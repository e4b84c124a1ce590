"""Shards that are too much for one task are cut into several files, with the same rows in the same order."""

from pyspark.sql import functions as F

from lateweave.operators import merge
from lateweave.operators.merge import cut_shards
from lateweave.schemas import TRIPLE_COLUMNS
from lateweave.plans.build_triples import merge_tables
from lateweave.sources.readers import load_triples


def test_shards_are_cut_by_their_text(spark, monkeypatch):
    df = spark.range(1000).select(F.repeat(F.lit("é"), 50).alias("a"), F.lit(None).cast("string").alias("b"))
    monkeypatch.setattr(merge, "PIECE_BYTES", 10_000)
    assert cut_shards(df, ["a", "b"], 4) == 12 and cut_shards(df.limit(0), ["a", "b"], 4) == 4


def test_merged_triples_in_more_files_keep_their_order(spark, tmp_path, monkeypatch):
    rows = spark.range(400).select(*[F.concat(F.lit(c), F.col("id") % 150).alias(c) for c in TRIPLE_COLUMNS])
    rows.write.parquet(str(tmp_path / "in"))
    got = {}
    for name, most in [("whole", merge.PIECE_BYTES), ("cut", 500)]:
        monkeypatch.setattr(merge, "PIECE_BYTES", most)
        path = merge_tables(spark, {"x": str(tmp_path / "in")}, str(tmp_path / name), shards=2)
        placed = load_triples(spark, path, row_key=True).orderBy("file", "row_index").collect()
        sizes = {}
        for r in placed:
            sizes[r.file] = sizes.get(r.file, 0) + 1
        got[name] = [[r[c] for c in TRIPLE_COLUMNS] for r in placed], sizes
    assert got["whole"][0] == got["cut"][0] and len(got["whole"][1]) == 2
    assert len(got["cut"][1]) > 8 and max(got["cut"][1].values()) < 100
