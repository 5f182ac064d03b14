"""Clusters of mutually similar records by power iteration over sparse affinities."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ml import paired_blocks
from ..session import written

#: Vectors that are iterated together, steps of the iteration and rounds of k-means at each level.
VECTORS, STEPS, ROUNDS = 4, 4, 1
#: Features among which the axes of the candidates' grid are chosen (speed only).
AXIS_CHOICE = 8


def share_profiles(rows: DataFrame, record: str, feature: str, weight: str) -> DataFrame:
    """(record, features, shares): the share of the record's weight at each feature, as arrays in the order of the features.

    Rows with a null in any of the three columns, and records without a positive weight, are left out.
    """
    sums = rows.where(F.col(record).isNotNull() & F.col(feature).isNotNull() & F.col(weight).isNotNull()).groupBy(F.col(record).alias("record"), F.col(feature).alias("f"))
    sums = sums.agg(F.sum(weight).cast("double").alias("w"))
    cells = sums.where("w <> 0").groupBy("record").agg(F.array_sort(F.collect_list(F.struct("f", "w"))).alias("c"), F.sum("w").alias("t")).where("t > 0")
    return cells.select("record", F.col("c.f").alias("features"), F.transform("c.w", lambda w: w / F.col("t")).alias("shares"))


def _grid_axes(profiles: DataFrame, axes: int) -> list:
    """Features t for which the sums of shares up to t tell the profiles apart best: greedily by what variance the chosen ones leave."""
    cells = profiles.select(F.explode(F.arrays_zip("features", "shares")).alias("x")).select("x.features", "x.shares")
    by_feature = cells.groupBy("features").agg((F.sum(F.col("shares") * F.col("shares")) - F.sum("shares") * F.sum("shares") / F.lit(float(max(1, profiles.count())))).alias("v"))
    few = [r.features for r in by_feature.orderBy(F.col("v").desc(), "features").limit(AXIS_CHOICE).collect()]
    if len(few) <= axes:
        return few
    sums = profiles.select(*[_up_to(t).alias(f"s{i}") for i, t in enumerate(few)])
    pairs = [(i, j) for i in range(len(few)) for j in range(i + 1)]
    row = sums.agg(*[F.covar_pop(f"s{i}", f"s{j}") for i, j in pairs]).first()
    left = np.zeros((len(few), len(few)))
    for (i, j), v in zip(pairs, row):
        left[i, j] = left[j, i] = v
    chosen = []
    for _ in range(axes):
        i = int(np.argmax(np.diag(left)))
        if left[i, i] <= 0:
            break
        chosen.append(few[i])
        left = left - np.outer(left[i], left[i]) / left[i, i]
    return chosen


def _up_to(t):
    return F.aggregate(F.zip_with("features", "shares", lambda f, s: F.when(f <= F.lit(t), s).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)


def _close(radius: float):
    def compare(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        sizes = np.array([len(x) for side in (a, b) for x in side["features"]])
        values, where = np.unique(np.concatenate([x for side in (a, b) for x in side["features"]]), return_inverse=True)
        dense = np.zeros((len(sizes), len(values)))
        dense[np.repeat(np.arange(len(sizes)), sizes), where] = np.concatenate([x for side in (a, b) for x in side["shares"]])
        x, y = dense[: len(a)], dense[len(a) :]
        common = np.zeros((len(x), len(y)))
        for p, q in zip(x.T, y.T):
            if p.any() and q.any():
                common += np.minimum.outer(p, q)
        i, j = np.nonzero(x.sum(1)[:, None] + y.sum(1) - 2 * common <= radius + 1e-9)
        p, q = a["id"].to_numpy()[i], b["id"].to_numpy()[j]
        if same:
            i, j, p, q = (v[p < q] for v in (i, j, p, q))
        step = max(1, 4_000_000 // max(1, len(values)))
        gap = np.concatenate([np.abs(x[i[n : n + step]] - y[j[n : n + step]]).sum(1) for n in range(0, len(i), step)] or [np.zeros(0)])
        keep = gap <= radius + 1e-12
        p, q, gap = p[keep], q[keep], gap[keep]
        return pd.DataFrame({"a": np.where(p < q, p, q), "b": np.where(p < q, q, p), "weight": 1 - gap / (2 * radius)})

    return compare


def affinities(profiles: DataFrame, radius: float = 0.10, axes: int = 3) -> DataFrame:
    """(a, b, weight), a < b, of all profiles whose shares differ by at most ``radius`` in sum, exactly; weight from 0.5 to 1.

    The differences up and down of two such profiles are equal, so any sum of shares differs by at most radius / 2. Hence profiles
    meet only in neighbouring cells of a grid of that width on ``axes`` sums of shares, in blocks of bounded size.
    """
    width = radius / 2 + 1e-9
    chosen = _grid_axes(profiles, axes)
    kind = dict(profiles.dtypes)["record"]
    if not chosen:
        return profiles.sparkSession.createDataFrame([], f"a {kind}, b {kind}, weight double")
    cells = [F.floor(_up_to(t) / width).alias(f"c{i}") for i, t in enumerate(chosen)]
    placed = profiles.select(F.col("record").alias("id"), "features", "shares", *cells)
    return paired_blocks(placed, [f"c{i}" for i in range(len(chosen))], _close(radius), f"a {kind}, b {kind}, weight double")


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b", "weight").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def power_embedding(links: DataFrame, vectors: int = VECTORS, steps: int = STEPS) -> DataFrame:
    """(record, v0, v1, ...) of the records that ``links`` (a, b, weight) holds: start values from a hash, averaged again and again over
    the row-normalised affinities.

    Every record is its own neighbour with the mean weight of its links. Records that are linked closely come to equal values,
    unlinked groups keep their own.
    """
    both = _both_ways(links)
    degree = both.groupBy("a").agg(F.sum("weight").alias("d"), F.count(F.lit(1)).alias("n"))
    own = degree.select("a", F.col("a").alias("b"), (F.col("d") / F.col("n")).alias("weight"))
    total = degree.select("a", (F.col("d") + F.col("d") / F.col("n")).alias("t"))
    walk = written(both.unionByName(own).join(total, "a").select("a", "b", (F.col("weight") / F.col("t")).alias("w")), "walk")
    names = [f"v{i}" for i in range(vectors)]
    start = [(F.pmod(F.xxhash64("record", F.lit(i)), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias(n) for i, n in enumerate(names)]
    state = walk.select(F.col("a").alias("record")).distinct().select("record", *start)
    for _ in range(steps):
        moved = walk.join(state.withColumnRenamed("record", "b"), "b").groupBy(F.col("a").alias("record"))
        state = moved.agg(*[F.sum(F.col("w") * F.col(n)).alias(n) for n in names])
    return written(state, "vectors")


def first_groups(links: DataFrame, level: int = 0, jumps: int = 2) -> DataFrame:
    """(record, group): every linked record follows its neighbour of most links (ties by a hash) unless it comes first itself.

    Followed ``jumps`` times doubling, so a group's centre starts where its links are densest. In each linked set at
    least the neighbours of its first record join it.
    """
    both = _both_ways(links).select("a", "b")
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("n")).select("a", F.struct("n", F.xxhash64("a", F.lit(level)).alias("h"), F.col("a").alias("id")).alias("p"))
    best = both.join(degree.toDF("b", "q"), "b").groupBy("a").agg(F.max("q").alias("q"))
    to = best.join(degree, "a").select(F.col("a").alias("record"), F.greatest("p", "q")["id"].alias("group"))
    for _ in range(jumps):
        to = written(to, "following")
        to = to.join(to.toDF("group", "next"), "group").select("record", F.col("next").alias("group"))
    return to


def embedding_kmeans(embedding: DataFrame, start: DataFrame, links: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(record, group): k-means of the embedding from the groups of ``start``; a record is held against the centres of its own and its
    neighbours' groups. Groups without a link never share a centre, so no other centre can be right.
    """
    names = [c for c in embedding.columns if c != "record"]
    both = _both_ways(links).select("a", "b")
    distance = reduce(lambda x, y: x + y, [(F.col(n) - F.col(f"m_{n}")) ** 2 for n in names])
    of = start
    for _ in range(rounds):
        of = written(of, "assigned")
        centres = embedding.join(of, "record").groupBy("group").agg(*[F.avg(n).alias(f"m_{n}") for n in names])
        tried = both.join(of.withColumnRenamed("record", "b"), "b").select(F.col("a").alias("record"), "group").unionByName(of).distinct()
        scored = tried.join(centres, "group").join(embedding, "record").groupBy("record").agg(F.min(F.struct(distance.alias("d"), F.col("group"))).alias("x"))
        of = scored.select("record", "x.group")
    return of


def spectral_groups(records: DataFrame, links: DataFrame) -> DataFrame:
    """(record, group): level by level, power iteration and k-means of the embedding; linked groups are the records of the next level.

    Ends when no link parts two groups, so no link is lost, however slowly a chain or a bridge lets the iteration mix. Each level
    leaves a fraction of the groups that are linked, so there are about log(records) of them; most sets need one.
    ``group`` is the smallest record of the group.
    """
    members, level = records.select("record", F.col("record").alias("group")), 0  # grows by a join of written groups a level
    links = links.select("a", "b", "weight")
    while not links.isEmpty():
        groups = written(embedding_kmeans(power_embedding(links), first_groups(links, level), links), "assigned")
        smallest = groups.groupBy("group").agg(F.min("record").alias("least"))
        groups = written(groups.join(smallest, "group").select(F.col("record").alias("group"), F.col("least")), "groups")
        members = members.join(groups, "group", "left").select("record", F.coalesce("least", "group").alias("group"))
        ends = links.join(groups.toDF("a", "ga"), "a").join(groups.toDF("b", "gb"), "b").where("ga <> gb")
        links = written(ends.groupBy(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).agg(F.sum("weight").alias("weight")), "links")
        level += 1
    return written(members, "members")


def similar_groups(profiles: DataFrame, radius: float = 0.10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The groups (record, group, size, rank, internal_affinity) of all profiles, the affinities (a, b, weight) they come from, and
    (record, copy_of).

    Equal profiles are taken together as copies of their smallest record before anything is compared; the affinities are those
    between such records. Groups that an affinity links are one, so no pair within ``radius`` is parted. rank 1 is the group's most
    typical member: the one of largest summed affinity to its group, copies included, ties to the smaller name. No profiles
    give three empty frames.
    """
    copies = F.min("record").over(Window.partitionBy("features", "shares"))
    profiles = written(profiles.withColumn("copy_of", copies), "profiles")
    counts = written(profiles.groupBy("copy_of").agg(F.count(F.lit(1)).alias("n")), "copies")
    single = profiles.where("record = copy_of").select("record", "features", "shares")
    edges = written(affinities(single, radius), "affinities")
    n = counts.withColumnRenamed("copy_of", "b")
    weighted = _both_ways(edges).join(n, "b").select("a", "b", (F.col("weight") * F.col("n")).alias("weight"))
    inner = written(counts.join(weighted.groupBy(F.col("a").alias("copy_of")).agg(F.sum("weight").alias("w")), "copy_of", "left").select("copy_of", (F.col("n") + F.coalesce("w", F.lit(0.0))).alias("inner")), "inner")
    groups = spectral_groups(single.select("record"), edges)
    of_copy = groups.select(F.col("record").alias("copy_of"), "group").join(inner, "copy_of")
    out = profiles.select("record", "copy_of").join(of_copy, "copy_of").withColumn("internal_affinity", F.round("inner", 9))
    sizes = out.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    order = Window.partitionBy("group").orderBy(F.col("internal_affinity").desc(), "record")
    members = out.join(sizes, "group").withColumn("rank", F.row_number().over(order)).select("record", "group", "size", "rank", "internal_affinity")
    return members, edges, profiles.select("record", "copy_of")


def similar_pairs(members: DataFrame, edges: DataFrame, copies: DataFrame) -> DataFrame:
    """(a, b), a < b, of all records of one group that an affinity joins, copies written out."""
    of = written(copies.join(members.select("record", "group"), "record"), "placed")
    one, two = of.toDF("a", "ca", "ga"), of.toDF("b", "cb", "gb")
    same = one.join(two, (F.col("ca") == F.col("cb")) & (F.col("a") < F.col("b"))).select("a", "b")
    linked = edges.toDF("ca", "cb", "weight").join(one, "ca").join(two, "cb").where("ga = gb")
    return same.unionByName(linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
