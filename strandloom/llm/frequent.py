"""Most frequent items of a very long column by lossy counting, with guaranteed count intervals."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

SUMMARY = "part_group string, item string, seen bigint, missed bigint, floor bigint, total bigint"


def _summaries(error: float):
    num, den = Fraction(error).limit_denominator(10**9).as_integer_ratio()  # whole numbers stay exact above 2^53

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict = {}  # group -> (items, seen, missed), sorted by item
        totals: dict = {}
        for pdf in batches:
            for group, rows in pdf.groupby("part_group", sort=False, dropna=False):
                codes, items = pd.factorize(rows["item"].to_numpy(), sort=True)
                seen = np.zeros(len(items), np.int64)
                np.add.at(seen, codes, rows["weight"].to_numpy(np.int64))
                group = None if group is None or group != group else group
                before = totals.get(group, 0)
                totals[group] = after = before + int(seen.sum())
                missed = np.full(len(items), before * num // den, np.int64)  # what a new item may have lost to earlier pruning
                if group in kept:
                    old, old_seen, old_missed = kept[group]
                    at = np.searchsorted(old, items)
                    hit = (at < len(old)) & (old[np.minimum(at, len(old) - 1)] == items) if len(old) else np.zeros(len(items), bool)
                    old_seen[at[hit]] += seen[hit]
                    items = np.concatenate([old, items[~hit]])
                    seen, missed = np.concatenate([old_seen, seen[~hit]]), np.concatenate([old_missed, missed[~hit]])
                    order = np.argsort(items, kind="stable")
                    items, seen, missed = items[order], seen[order], missed[order]
                keep = seen + missed > after * num // den  # the bucket ends with the batch
                kept[group] = items[keep], seen[keep], missed[keep]
        for group, (items, seen, missed) in kept.items():
            floor = totals[group] * num // den
            yield pd.DataFrame({"part_group": group, "item": items, "seen": seen, "missed": missed, "floor": floor, "total": 0})
            yield pd.DataFrame({"part_group": [group], "item": [None], "seen": [0], "missed": [0], "floor": [floor], "total": [totals[group]]})

    return run


def lossy_counts(rows: DataFrame, group: str, item: str, weight: str | None = None, error: float = 0.0005) -> tuple[DataFrame, DataFrame]:
    """Count intervals of the items that may be frequent, and each group's total.

    Returns (``group``, item, low, high) with low <= true weight <= high and high - low <= ``error`` x the group's total,
    for all items of a weight above that bound (rarer ones may be missing), and (``group``, total). Each input partition
    keeps, per group, entries with their greatest undercount, pruned at the end of each Arrow batch: about
    log(error x rows) / error entries, however many distinct items there are. Summaries add up, an item absent from one
    adding that partition's floor to its undercount; so neither a hot item nor a hot group meets in one task before it is
    reduced. Null items and weights that are null or not positive are left out; a null group is a group.
    """
    w = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    base = rows.select(F.col(group).cast("string").alias("part_group"), F.col(item).cast("string").alias("item"), w.alias("weight"))
    base = base.where("item is not null and weight > 0")
    parts = written(base.mapInPandas(_summaries(error), SUMMARY), "lossy")
    kind = dict(rows.dtypes)[group]
    totals = parts.where("item is null").groupBy("part_group").agg(F.sum("total").alias("total"), F.sum("floor").alias("floors"))
    items = parts.where("item is not null").groupBy("part_group", "item").agg(
        F.sum("seen").alias("low"), F.sum("missed").alias("m"), F.sum("floor").alias("f")
    )
    both = items.join(totals, items.part_group.eqNullSafe(totals.part_group)).drop(totals.part_group)
    named = F.col("part_group").cast(kind).alias(group)
    intervals = both.select(named, F.col("item").alias(item), "low", (F.col("low") + F.col("m") + F.col("floors") - F.col("f")).alias("high"), "total")
    return intervals, totals.select(named, "total")


def frequent_items(rows: DataFrame, group: str, item: str, weight: str | None = None, share: str = "0.005", error: float | None = None) -> DataFrame:
    """(group, item, low, high, total) of every item whose weight may reach ``share`` of its group's total: none is missed."""
    s = Fraction(share)
    found, _ = lossy_counts(rows, group, item, weight, float(s) / 10 if error is None else error)
    return found.where(F.col("high") * s.denominator >= F.col("total") * s.numerator)


def exact_frequent(candidates: DataFrame, rows: DataFrame, group: str, item: str, weight: str, share: str = "0.005") -> DataFrame:
    """The candidates of ``frequent_items`` whose exact weight reaches the share: (group, item, weight, total).

    A second pass counts only the rows of candidates, of which there are at most about 1 / share per group. ``rows`` may
    hold exact duplicates, which count once here.
    """
    s = Fraction(share)
    few = written(candidates.select(F.col(group).alias("_g"), F.col(item).alias("_i"), F.col("total").alias("_t")), "candidates")
    hits = rows.join(few, rows[group].eqNullSafe(few["_g"]) & (rows[item] == few["_i"]), "left_semi").dropDuplicates()
    sums = hits.groupBy(F.col(group).alias("_g"), F.col(item).alias("_i")).agg(F.sum(weight).alias("_w")).alias("s")
    both = sums.join(few.alias("f"), F.col("s._g").eqNullSafe(F.col("f._g")) & (F.col("s._i") == F.col("f._i")))
    sums = both.select(F.col("s._g").alias(group), F.col("s._i").alias(item), F.col("f._t").alias("total"), F.col("s._w").alias("weight"))
    return sums.where(F.col("weight") * s.denominator >= F.col("total") * s.numerator)
