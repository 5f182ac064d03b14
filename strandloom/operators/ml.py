"""Clustering, reduction and evaluation of organism vectors.

The reference only declares these; what they compute is our definition, stated in each docstring. Input frames have an id
column and a vector column; labels are an integer column.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VarianceThresholdSelector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .matrix import kmer_vectors, matrix_long


def kmeans(vectors: DataFrame, n_clusters: int = 3, seed: int = 42, features: str = "features") -> DataFrame:
    """``prediction`` by k-means (k-means|| start)."""
    return KMeans(k=n_clusters, seed=seed, featuresCol=features).fit(vectors).transform(vectors)


#: Centroids that Ward's merging starts from; its cost grows with their square on the driver, whatever the number of rows.
WARD_CENTROIDS = 200


def hierarchical(vectors: DataFrame, n_clusters: int = 3, seed: int = 42, features: str = "features", method: str = "bisecting") -> DataFrame:
    """``prediction`` by divisive clustering (``bisecting`` k-means) or by ``ward``: Ward's merging of k-means centroids (see ward_tree)."""
    if method == "ward":
        labelled, _ = ward_tree(vectors, n_clusters, seed, features)
        return labelled
    if method != "bisecting":
        raise ValueError(f"unknown method {method!r}")
    return BisectingKMeans(k=n_clusters, seed=seed, featuresCol=features).fit(vectors).transform(vectors)


def ward_tree(vectors: DataFrame, n_clusters: int = 3, seed: int = 42, features: str = "features", centroids: int = WARD_CENTROIDS) -> tuple[DataFrame, DataFrame]:
    """The rows with ``centroid`` and ``prediction``, and the merge tree (step, left, right, height, size) for a dendrogram.

    Rows are brought to at most ``centroids`` k-means centroids first (Spark's work), whose weights and means are merged by Ward's
    rule: always the two whose union adds least to the squared distances; ``height`` is the root of twice that. Nodes below the number
    of centroids are centroids, node ``number + step`` is the merge of that step.
    """
    model = KMeans(k=centroids, seed=seed, featuresCol=features, predictionCol="centroid").fit(vectors)
    placed = model.transform(vectors)
    means = np.array(model.clusterCenters())
    weight = np.zeros(len(means))
    for r in placed.groupBy("centroid").count().collect():
        weight[r["centroid"]] = r["count"]
    label = np.arange(len(means))  # current node of each centroid
    nodes = {i: (means[i], weight[i]) for i in range(len(means)) if weight[i] > 0}
    tree, cut = [], label.copy()
    while len(nodes) > 1:
        if len(nodes) == n_clusters:
            cut = label.copy()
        ids = sorted(nodes)
        x, w = np.array([nodes[i][0] for i in ids]), np.array([nodes[i][1] for i in ids])
        added = ((x[:, None] - x) ** 2).sum(-1) * (w[:, None] * w / (w[:, None] + w))
        np.fill_diagonal(added, np.inf)
        i, j = np.unravel_index(np.argmin(added), added.shape)
        new = len(means) + len(tree)
        total = w[i] + w[j]
        tree.append((len(tree), int(ids[min(i, j)]), int(ids[max(i, j)]), float(np.sqrt(2 * added[i, j])), int(total)))
        nodes[new] = ((x[i] * w[i] + x[j] * w[j]) / total, total)
        label[np.isin(label, [ids[i], ids[j]])] = new
        del nodes[ids[i]], nodes[ids[j]]
    if n_clusters == 1:
        cut = label.copy()
    number = {n: c for c, n in enumerate(sorted(set(cut[weight > 0].tolist())))}
    to = F.element_at(F.array(*[F.lit(number.get(n, 0)) for n in cut.tolist()]), F.col("centroid") + 1)
    steps = vectors.sparkSession.createDataFrame(tree, "step int, left int, right int, height double, size bigint")
    return placed.withColumn("prediction", to), steps


#: Coordinates that PCA takes: its covariance is a square of them on the driver.
MOST_PCA = 4096


def reduce_dimensions(vectors: DataFrame, method: str = "pca", n_components: int = 2, features: str = "features") -> DataFrame:
    """``reduced`` by PCA; t-SNE and UMAP have no distributed form here and raise."""
    if method != "pca":
        raise NotImplementedError(f"{method}: only pca is distributed")
    first = vectors.select(features).first()
    if first is not None and first[0].size > MOST_PCA:
        raise ValueError(f"pca is for at most {MOST_PCA} coordinates; take matrix.kmer_vectors for k-mers of larger k")
    return PCA(k=n_components, inputCol=features, outputCol="reduced").fit(vectors).transform(vectors)


def select_by_variance(vectors: DataFrame, threshold: float = 0.0, features: str = "features") -> DataFrame:
    """``selected``: the coordinates whose sample variance exceeds the threshold."""
    return VarianceThresholdSelector(varianceThreshold=threshold, featuresCol=features, outputCol="selected").fit(vectors).transform(vectors)


def silhouette(clustered: DataFrame, features: str = "features", label: str = "prediction") -> float:
    """Mean silhouette with squared Euclidean distances, from each cluster's sums, so no points meet; one cluster gives 0."""
    if clustered.select(label).distinct().limit(2).count() < 2:
        return 0.0
    return ClusteringEvaluator(featuresCol=features, predictionCol=label).evaluate(clustered)


def davies_bouldin(points: DataFrame, array: str, label: str) -> DataFrame:
    """One row (davies_bouldin): mean over clusters of the worst (scatter_i + scatter_j) / distance(i, j).

    ``array`` is an array column. Only the centroids, one row a cluster, meet each other. Null if there is one cluster.
    """
    rows = points.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(array).cast("array<double>").alias("_x"))
    cells = rows.withColumn("_id", F.monotonically_increasing_id()).select("label", "_id", F.posexplode("_x").alias("pos", "x"))
    means = cells.groupBy("label", "pos").agg(F.avg("x").alias("m"))
    distance = cells.join(means, ["label", "pos"]).groupBy("label", "_id").agg(F.sqrt(F.sum((F.col("x") - F.col("m")) ** 2)).alias("d"))
    scatter = distance.groupBy("label").agg(F.avg("d").alias("s"))
    other = means.toDF("label2", "pos", "m2")
    apart = (
        means.join(other, "pos").where("label <> label2").groupBy("label", "label2").agg(F.sqrt(F.sum((F.col("m") - F.col("m2")) ** 2)).alias("d"))
    )
    ratio = apart.join(scatter, "label").join(scatter.toDF("label2", "s2"), "label2")
    worst = ratio.groupBy("label").agg(F.max((F.col("s") + F.col("s2")) / F.col("d")).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def optimize_clusters(vectors: DataFrame, cluster_range=range(2, 11), seed: int = 42) -> DataFrame:
    """(n_clusters, silhouette) of each cluster count tried, on one cached input."""
    vectors = vectors.cache()
    found = [(k, float(silhouette(kmeans(vectors, k, seed)))) for k in cluster_range]
    vectors.unpersist()
    return vectors.sparkSession.createDataFrame(found, "n_clusters int, silhouette double")


def top_kmers_per_cluster(matrix: DataFrame, labels: DataFrame, n_top: int = 20) -> DataFrame:
    """Per cluster the k-mers whose mean value exceeds that of all other organisms most (a top-k report).

    ``matrix`` is the long form, ``labels`` has (organism_id, prediction); absent cells are 0.
    """
    sizes = labels.groupBy("prediction").agg(F.count(F.lit(1)).alias("size"))
    total = F.sum("size").over(Window.partitionBy())
    sizes = sizes.withColumn("all", total)
    per = matrix.join(labels.select("organism_id", "prediction"), "organism_id").groupBy("kmer", "prediction").agg(F.sum("value").alias("s"))
    per = per.withColumn("t", F.sum("s").over(Window.partitionBy("kmer"))).join(F.broadcast(sizes), "prediction")
    rest = F.when(F.col("all") > F.col("size"), (F.col("t") - F.col("s")) / (F.col("all") - F.col("size"))).otherwise(0.0)
    scored = per.select("prediction", "kmer", (F.col("s") / F.col("size") - rest).alias("score"))
    w = Window.partitionBy("prediction").orderBy(F.col("score").desc(), "kmer")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n_top)


def cluster_organisms(vectors: DataFrame, reduction: str | None = "pca", n_components: int = 2, clustering: str = "hierarchical", n_clusters: int = 3) -> DataFrame:
    """Reduction, then clustering (``hierarchical``, ``ward`` or ``kmeans``): ``prediction`` per row."""
    column = "features"
    if reduction:
        vectors, column = reduce_dimensions(vectors, reduction, n_components), "reduced"
    methods = {"hierarchical": hierarchical, "kmeans": kmeans, "ward": partial(hierarchical, method="ward")}
    if clustering not in methods:
        raise ValueError(f"unknown clustering {clustering!r}")
    return methods[clustering](vectors, n_clusters, features=column)


def cluster_kmers(features: DataFrame, k: int = 8, metric: str = "count", n_top: int = 500, min_prevalence: float = 0.0, min_variance: float = 0.0, reduction: str | None = "pca", n_components: int = 2, clustering: str = "hierarchical", n_clusters: int = 3) -> DataFrame:
    """(organism_id, prediction) from k-mer rows (organism_id, kmer, k, metric): matrix, frequencies, filter, top k-mers, reduction, clusters.

    Null metrics and organisms are left out. For any k, as only the ``n_top`` most varying k-mers become coordinates.
    """
    rows = features.where(F.col("organism_id").isNotNull() & F.col("kmer").isNotNull() & F.col(metric).isNotNull())
    vectors = written(kmer_vectors(matrix_long(rows, metric, k), n_top, min_prevalence, min_variance), "vectors")
    size = len(vectors.first().features) if not vectors.isEmpty() else 0
    if size == 0:
        return vectors.select("organism_id", F.lit(0).alias("prediction"))
    found = cluster_organisms(vectors, reduction if size > n_components else None, n_components, clustering, n_clusters)
    return found.select("organism_id", "prediction")


#: Points of one cell that a block holds; a task compares two blocks.
BLOCK_POINTS = 1000


def paired_blocks(placed: DataFrame, keys: list[str], compare: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame], schema: str, block: int = BLOCK_POINTS) -> DataFrame:
    """The rows of ``compare(left, right, same)`` over all pairs of points in the same or in neighbouring cells, each pair met once.

    ``placed`` has a unique ``id``, a payload, and the integer cell coordinates ``keys``. One side lies in its own cell, the other is
    copied to those of the 3^n neighbours that come before its own cell; so two points of different cells meet once, and points of
    one cell (``same``) in both orders. A cell with many points is cut into blocks that are compared two by two: no task
    holds more than two blocks, and a point moves once for each block, not for each pair.
    """
    blocks = placed.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1))
    own = F.pmod(F.xxhash64("id"), F.col("_blocks"))
    left = placed.join(blocks, keys).withColumn("_l", own).withColumn("_r", every).drop("_blocks")
    left = left.withColumn("_same", F.explode(F.array(F.lit(True), F.lit(False))))
    offsets = [o for o in product((-1, 0, 1), repeat=len(keys)) if o <= (0,) * len(keys)]
    moved = F.explode(F.array(*[F.struct(F.lit(not any(o)).alias("same"), *[(F.col(k) + d).alias(k) for k, d in zip(keys, o)]) for o in offsets]))
    around = placed.withColumn("_to", moved).drop(*keys).select("*", F.col("_to.same").alias("_same"), *[F.col(f"_to.{k}").alias(k) for k in keys]).drop("_to")
    right = around.join(blocks, keys).withColumn("_r", own).withColumn("_l", every).drop("_blocks")
    right = right.select(*[F.col(c).alias(f"{c}_") for c in right.columns])  # names of its own: the two sides share their lineage
    none = pd.DataFrame(columns=[x.split()[0] for x in schema.split(", ")])

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return none if a.empty or b.empty else compare(a, b.rename(columns=lambda c: c.removesuffix("_")), bool(a["_same"].iloc[0]))

    group = [*keys, "_same", "_l", "_r"]
    return left.groupBy(*group).cogroup(right.groupBy(*[f"{c}_" for c in group])).applyInPandas(meet, schema)


def close_pairs(points: DataFrame, id_col: str, array: str, eps: float, axes: int = 3) -> DataFrame:
    """(a, b) of all points at most ``eps`` apart (Euclidean, in doubles), a < b.

    Points meet only through grid cells of width ``eps`` on the ``axes`` coordinates of largest variance (see paired_blocks).
    Within a pair of blocks a product of matrices about the blocks' centre, with the bound of its rounding error as slack, leaves the
    pairs whose distance is then computed; so large coordinates lose no pair. Ids are unique; null ids and null arrays are left out; all
    arrays have one length; a pair with a null or NaN coordinate is not close.
    """
    base = points.where(F.col(array).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(array).cast("array<double>").alias("x"))
    by_axis = base.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.var_pop("v").alias("v"), F.max(F.abs("v")).alias("top"))
    best = by_axis.orderBy(F.col("v").desc_nulls_last(), "pos").limit(axes).collect()
    kind = dict(base.dtypes)["id"]
    if not best:
        return points.sparkSession.createDataFrame([], f"a {kind}, b {kind}")
    keys = [f"c{i}" for i in range(len(best))]
    # a little wider than eps, as the quotient is rounded
    width = [eps * (1 + 1e-9) + 8 * float(np.finfo(float).eps) * (r.top if r.top is not None and np.isfinite(r.top) else 0.0) for r in best]
    placed = base.select("id", "x", *[F.floor(F.coalesce(F.get("x", F.lit(r.pos)), F.lit(0.0)) / F.lit(w)).alias(c) for r, w, c in zip(best, width, keys)])

    def near(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        x, y = np.stack(a["x"]).astype(float), np.stack(b["x"]).astype(float)
        centre = x.mean(axis=0)
        u, v = x - centre, y - centre
        squares = (u * u).sum(1)[:, None] + (v * v).sum(1)
        slack = 4 * (x.shape[1] + 4) * np.finfo(float).eps * (squares + eps * eps)
        i, j = np.nonzero(squares - 2 * (u @ v.T) <= eps * eps + slack)
        p, q = a["id"].to_numpy()[i], b["id"].to_numpy()[j]
        keep = np.sqrt(((x[i] - y[j]) ** 2).sum(1)) <= eps
        if same:
            keep &= p < q
        p, q = p[keep], q[keep]
        return pd.DataFrame({"a": np.where(p < q, p, q), "b": np.where(p < q, q, p)})

    return paired_blocks(placed, keys, near, f"a {kind}, b {kind}")


def smallest_reachable(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, root): the smallest id of each node's connected component.

    Min-label rounds with pointer jumping; each round is written to the shared folder, so lineage stays short. Edges are
    (a, b), taken in both directions. A path of n nodes takes about log(n) rounds; if labels still change after ``max_rounds``
    it raises and returns nothing.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    state = written(nodes.select(F.col("id"), F.col("id").alias("root")).distinct(), "roots")
    for _ in range(max_rounds):
        near = both.join(state.toDF("b", "r"), "b").groupBy(F.col("a").alias("id")).agg(F.min("r").alias("near"))
        step = state.join(near, "id", "left").select("id", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root"))
        step = written(step, "steps")
        # the roots in use are few and reduced first, so that a component of most nodes is no hot key of the look-up
        up = step.select("root").distinct().join(step.select(F.col("id").alias("root"), F.col("root").alias("up")), "root")
        step = written(step.join(up, "root", "left").select("id", "old", F.coalesce("up", "root").alias("root")), "roots")
        state = step.select("id", "root")
        if step.where("old <> root").limit(1).count() == 0:
            return state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def dbscan(points: DataFrame, id_col: str, array: str, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """(id, cluster, core): density clusters; a point counts as its own neighbour, noise has cluster null.

    Clusters are the components of core points within ``eps``, named by their smallest id; a border point joins the
    smallest such cluster next to it.
    """
    ids = points.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    pairs = written(close_pairs(points, id_col, array, eps), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    core = written(ids.join(degree, "id", "left").where(F.coalesce("n", F.lit(0)) + 1 >= min_samples).select("id"), "core")
    inner = pairs.join(core.toDF("a"), "a").join(core.toDF("b"), "b").select("a", "b")
    roots = smallest_reachable(core, inner)
    border = both.join(roots.toDF("b", "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
    out = ids.join(roots, "id", "left").join(border, "id", "left")
    return out.select("id", F.coalesce("root", "near").alias("cluster"), F.col("root").isNotNull().alias("core"))


def evaluate(clustered: DataFrame, array: str, features: str = "features", label: str = "prediction") -> DataFrame:
    """(metric, value) rows: silhouette and Davies-Bouldin."""
    first = clustered.sparkSession.createDataFrame([("silhouette", float(silhouette(clustered, features, label)))], "metric string, value double")
    second = davies_bouldin(clustered, array, label).select(F.lit("davies_bouldin").alias("metric"), F.col("davies_bouldin").alias("value"))
    return reduce(DataFrame.unionByName, [first, second])
