"""Parts of a verified table that are several files each."""

from __spark_entry__ import queries
from lateweave.operators import merge

SF = "/root/testdata/sf0.001"


def test_manifest_of_cut_parts(spark, monkeypatch):
    whole = sorted(queries()["manifest_rows"](spark, SF).collect())
    monkeypatch.setattr(merge, "PIECE_BYTES", 20_000)
    seen = []
    asked = merge.math.ceil
    monkeypatch.setattr(merge.math, "ceil", lambda x: seen.append(asked(x)) or asked(x))
    cut = queries()["manifest_rows"](spark, SF)
    assert max(seen) > 2 and sorted(cut.collect()) == whole
