"""Lossy counting: guaranteed intervals against exact counts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandloom.llm import frequent


def skewed(spark, n=60_000, seed=1):
    rng = np.random.default_rng(seed)
    items = np.where(rng.random(n) < 0.34, "hot", ["i%d" % x for x in (rng.zipf(1.3, n) % 20_000)])
    rows = pd.DataFrame({"g": rng.integers(0, 3, n), "item_": items, "w": rng.integers(0, 5, n), "part_group": "clash", "total": 1})
    return rows, spark.createDataFrame(rows).repartition(5)


@pytest.mark.parametrize("batch", [100, 10_000])
def test_intervals_hold_and_none_is_missed(spark, batch):
    rows, df = skewed(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.g, r.item_): r for r in frequent.frequent_items(df, "g", "item_", "w", "0.005").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    exact = rows.groupby(["g", "item_"]).w.sum()
    totals = rows.groupby("g").w.sum()
    for key, r in got.items():
        assert r.low <= exact[key] <= r.high and r.high - r.low <= 0.0005 * totals[key[0]] + 1 and r.total == totals[key[0]]
    assert {k for k, v in exact.items() if v >= 0.005 * totals[k[0]]} <= set(got)


def test_exact_pass_counts_duplicates_once(spark):
    df = spark.createDataFrame([("a", "x", 5, 1), ("a", "x", 5, 1), ("a", "y", 2, 2), ("a", "x", 5, 3), (None, "z", 1, 4), ("a", None, 9, 5), ("a", "y", None, 6), ("a", "y", -3, 7)], "g string, i string, c bigint, id int")
    once = df.where("c > 0").dropDuplicates()
    found = frequent.frequent_items(once, "g", "i", "c", "0.2")
    got = {(r.g, r.i): (r.weight, r.total) for r in frequent.exact_frequent(found, df.where("c > 0"), "g", "i", "c", "0.2").collect()}
    assert got == {("a", "x"): (10, 12), (None, "z"): (1, 1)}


def test_share_is_met_exactly(spark):
    df = spark.createDataFrame([("g", f"i{j}") for j in range(5)], "g string, i string")
    assert frequent.frequent_items(df, "g", "i", None, "0.2").count() == 5  # ties all stand
    assert frequent.frequent_items(df, "g", "i", None, "0.21").count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], "g int, i string, w bigint")
    assert frequent.frequent_items(df, "g", "i", "w").count() == 0


def test_memory_bound(spark):
    """Many distinct items leave few entries."""
    rows = spark.range(200_000).select(F.lit(1).alias("g"), F.col("id").cast("string").alias("i")).coalesce(1)
    items, totals = frequent.lossy_counts(rows, "g", "i", None, 0.001)
    assert items.count() <= 10_000 and totals.first().total == 200_000
