"""Spectral groups on planted profiles."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandloom.llm import similar_groups as sg


def planted(spark, sizes=(40, 7, 2, 1, 1), seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for g, size in enumerate(sizes):
        base = rng.dirichlet(np.ones(8))
        for i in range(size):
            share = np.maximum(base + rng.normal(0, 0.002, 8), 0)
            rows += [(f"g{g}_{i:02d}", float(f * 10), int(s * 100_000)) for f, s in enumerate(share / share.sum())]
    return pd.DataFrame(rows, columns=["o", "gc", "c"])


def brute(rows, radius=0.10):
    p = rows.pivot_table(index="o", columns="gc", values="c", aggfunc="sum").fillna(0)
    p = p.div(p.sum(axis=1), axis=0)
    return {(a, b) for a in p.index for b in p.index if a < b and np.abs(p.loc[a] - p.loc[b]).sum() <= radius}


def test_groups_pairs_and_ranks(spark):
    rows = planted(spark)
    df = spark.createDataFrame(rows).withColumns({"record": F.lit("clash"), "s": F.lit(1)})
    members, edges, copies = sg.similar_groups(sg.share_profiles(df, "o", "gc", "c"))
    got = members.toPandas()
    assert {tuple(r) for r in sg.similar_pairs(members, edges, copies).collect()} == brute(rows)
    assert sorted(got.groupby("group").size(), reverse=True) == [40, 7, 2, 1, 1]
    for group, part in got.groupby("group"):
        assert part["size"].unique() == [len(part)] and group == part.record.min() and sorted(part["rank"]) == list(range(1, len(part) + 1))
        assert part.sort_values("rank").internal_affinity.is_monotonic_decreasing
    assert got[got.group.str.startswith("g3")].internal_affinity.tolist() == [1.0]


def test_equal_profiles_null_rows_and_empty(spark):
    df = spark.createDataFrame([("a", 1.0, 5), ("b", 1.0, 9), ("c", 2.0, 1), ("d", None, 1), ("e", 1.0, None), (None, 1.0, 1), ("f", 1.0, 0)], "o string, gc double, c bigint")
    members, edges, copies = sg.similar_groups(sg.share_profiles(df, "o", "gc", "c"))
    assert {r.record: (r.group, r["size"]) for r in members.collect()} == {"a": ("a", 2), "b": ("a", 2), "c": ("c", 1)}
    assert [tuple(r) for r in sg.similar_pairs(members, edges, copies).collect()] == [("a", "b")] and edges.count() == 0
    assert {r.record: (r.rank, r.internal_affinity) for r in members.collect()} == {"a": (1, 2.0), "b": (2, 2.0), "c": (1, 1.0)}
    members, edges, copies = sg.similar_groups(sg.share_profiles(df.limit(0), "o", "gc", "c"))
    assert members.count() == edges.count() == 0


def bridged(gap, size=40, seed=0):
    """Two tight groups whose centres are ``gap`` apart, so that only a few pairs between them are within the radius."""
    rng = np.random.default_rng(seed)
    base = np.full(8, 1 / 8)
    rows = []
    for g in range(2):
        centre = base + g * gap / 2 * np.array([1, -1, 0, 0, 0, 0, 0, 0])
        for i in range(size):
            share = np.maximum(centre + rng.normal(0, 0.002, 8), 0)
            rows += [(f"g{g}_{i:02d}", float(f * 10), int(s * 100_000)) for f, s in enumerate(share / share.sum())]
    return pd.DataFrame(rows, columns=["o", "gc", "c"])


def test_bridged_groups_lose_no_pair(spark):
    rows = bridged(0.094)
    true = brute(rows)
    between = sum(a[:2] != b[:2] for a, b in true)
    assert 0 < between < 400
    members, edges, copies = sg.similar_groups(sg.share_profiles(spark.createDataFrame(rows), "o", "gc", "c"))
    got = members.toPandas()
    assert {tuple(r) for r in sg.similar_pairs(members, edges, copies).collect()} == true
    assert set(got.group) == {"g0_00"} and set(got["size"]) == {80} and sorted(got["rank"]) == list(range(1, 81))


def shaped(centres):
    """One record at each centre (0 to 1), a share of it at feature 1 and the rest at feature 2."""
    return pd.DataFrame([(f"r{i:03d}", float(f), int(round(10_000 * s))) for i, c in enumerate(centres) for f, s in ((1, c), (2, 1 - c))], columns=["o", "gc", "c"])


def test_chains_lose_no_pair(spark):
    chains = [(3, 0.045), (6, 0.045), (12, 0.045), (200, 0.003)]
    rows = pd.concat([shaped([0.05 + gap * i for i in range(n)]).assign(o=lambda r, n=n: f"{n:03d}-" + r.o, gc=lambda r, n=n: r.gc + 10 * n) for n, gap in chains])
    members, edges, copies = sg.similar_groups(sg.share_profiles(spark.createDataFrame(rows), "o", "gc", "c"))
    assert {tuple(r) for r in sg.similar_pairs(members, edges, copies).collect()} == brute(rows)
    assert {(r.group, r["size"]) for r in members.collect()} == {(f"{n:03d}-r000", n) for n, _ in chains}


def test_links_of_any_shape_stay_in_one_group(spark):
    n = 60
    shapes = {
        "path": [(i, i + 1) for i in range(n - 1)], "ring": [(i, (i + 1) % n) for i in range(n)], "star": [(0, i) for i in range(1, n)],
        "bridge": [(i, j) for a in (0, 30) for i in range(a, a + 30) for j in range(i + 1, a + 30)] + [(0, 59)],
    }
    name = lambda shape, i: f"{shape}{i:02d}"
    df = spark.createDataFrame([(name(s, min(p)), name(s, max(p)), 0.7) for s, links in shapes.items() for p in links] + [("x", "y", 0.5)], "a string, b string, weight double")
    records = spark.createDataFrame([(name(s, i),) for s in shapes for i in range(n)] + [("x",), ("y",), ("z",)], "record string")
    got = {r.record: r.group for r in sg.spectral_groups(records, df).collect()}
    assert got == {name(s, i): name(s, 0) for s in shapes for i in range(n)} | {"x": "x", "y": "x", "z": "z"}


def test_a_third_of_the_records_equal(spark):
    rows = pd.concat([shaped([0.3] * 40 + [0.9] * 2 + list(np.linspace(0.0, 1.0, 60)))])
    members, edges, copies = sg.similar_groups(sg.share_profiles(spark.createDataFrame(rows), "o", "gc", "c"))
    assert {tuple(r) for r in sg.similar_pairs(members, edges, copies).collect()} == brute(rows)
    assert copies.where("copy_of = 'r000'").count() == 40 and edges.where("a = 'r001' or b = 'r001'").count() == 0


def test_crowded_cells_meet_in_blocks(spark, monkeypatch):
    rows = planted(spark, (60, 30))
    profiles = sg.share_profiles(spark.createDataFrame(rows), "o", "gc", "c")
    blocks = sg.paired_blocks
    monkeypatch.setattr(sg, "paired_blocks", lambda *args: blocks(*args, block=7))
    got = [(r.a, r.b) for r in sg.affinities(profiles).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
