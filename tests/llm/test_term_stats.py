"""Term statistics against plain counting."""

import numpy as np
import pandas as pd

from strandloom.llm import term_stats


def test_against_plain_counts(spark):
    rng = np.random.default_rng(4)
    n = 20_000
    rows = pd.DataFrame({"t": np.where(rng.random(n) < 0.34, "hot", ["t%d" % x for x in rng.integers(0, 9000, n)]), "r": rng.integers(0, 50, n).astype(str), "w": rng.integers(0, 9, n), "id": 1, "weight": 2, "record": "clash"})
    got = term_stats.term_statistics(spark.createDataFrame(rows).repartition(6), "t", "r", "w").toPandas().set_index("term")
    want = rows.groupby("t").agg(occurrences=("w", "sum"), records=("r", "nunique"))
    assert (got.occurrences.sort_index() == want.occurrences).all() and (got.records.sort_index() == want.records).all()
    assert sorted(got.id) == list(range(len(want)))
    assert got.mark["hot"] == "common" and set(got.mark[(got.records <= 2)]) == {"rare"} and got.mark[(got.records > 2) & (got.records < 20)].isna().all()


def test_nulls_empty_terms_and_marks(spark):
    df = spark.createDataFrame([("a", "1", None), ("a", "1", 3), ("", "2", 1), (None, "3", 1), ("b", None, 2)], "t string, r string, w bigint")
    got = {r.term: (r.occurrences, r.records, r.mark) for r in term_stats.term_statistics(df, "t", "r", "w", few=1).collect()}
    assert got == {"a": (3, 1, "rare"), "": (1, 1, "rare"), "b": (2, 0, "rare")}
    got = {r.term: r.mark for r in term_stats.term_statistics(df, "t", "r", few=1, common=(1, 3)).collect()}
    assert got == {"a": "rare and common", "": "rare and common", "b": "rare"}
    assert term_stats.term_statistics(df.limit(0), "t", "r").count() == 0
