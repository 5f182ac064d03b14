"""Metadata, matrices and clustering on small fixtures."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from strandloom.operators import matrix, metadata, ml


def test_genome_stats(spark):
    df = spark.createDataFrame([("g", "ACGN"), ("g", ""), ("h", None)], "organism_id string, seq string")
    got = {r.genome_id: tuple(r)[1:] for r in metadata.genome_stats(df).collect()}
    assert got == {"g": (2, 4, 50.0, 1), "h": (1, 0, 0.0, 0)}


def test_kmer_stats(spark):
    df = spark.createDataFrame([("g", 8, k, c) for k, c in zip("abcd", (1, 2, 5, 10))] + [("g", 8, "e", None)], "organism_id string, k int, kmer string, cnt bigint")
    r = metadata.kmer_stats(df).first()
    assert tuple(r) == ("g", 8, 18, 4, 10, 1, 4.5, 3.5, 25)
    assert metadata.kmer_stats(df.limit(0)).count() == 0


def test_incremental(spark):
    known = spark.createDataFrame([("a", 1)], "genome_id string, v int")
    new = spark.createDataFrame([("a", 2), ("b", 3)], "genome_id string, v int")
    assert {tuple(r) for r in metadata.merge_metadata(known, new, ["genome_id"]).collect()} == {("a", 1), ("b", 3)}
    assert {tuple(r) for r in metadata.merge_metadata(known, new, ["genome_id"], refresh=True).collect()} == {("a", 2), ("b", 3)}


def test_document_and_latest(spark):
    g = spark.createDataFrame([("a", 5), ("b", 6)], "genome_id string, total_size bigint")
    k = spark.createDataFrame([("a", 8, 1), ("a", 9, 2), ("c", 8, 3)], "organism_id string, k_value int, total_kmers bigint")
    got = {r.genome_id: (r.total_size, {x: y.total_kmers for x, y in (r.kmers or {}).items()}) for r in metadata.metadata_document(g, k).collect()}
    assert got == {"a": (5, {"8": 1, "9": 2}), "b": (6, {}), "c": (None, {"8": 3})}
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", None, "z")], "id string, t int, v string")
    assert [r.v for r in metadata.latest_rows(rows, ["id"], ["t"]).collect()] == ["y"]


def long(spark):
    return spark.createDataFrame([("X", "AC", 3), ("Y", "AC", 1), ("Y", "GT", 2)], "organism_id string, kmer string, count bigint")


def test_matrix(spark):
    m = matrix.matrix_long(long(spark))
    wide = {r.organism_id: (r.AC, r.GT, r.AA) for r in matrix.wide(m, 2).collect()}
    assert wide == {"X": (3, 0, 0), "Y": (1, 2, 0)}
    assert matrix.zero_filled(m, 2).count() == 32
    assert {r.organism_id: (r.indices, r["values"]) for r in matrix.sparse_rows(m).collect()} == {"X": ([1], [3.0]), "Y": ([1, 11], [1.0, 2.0])}
    assert {r.organism_id: r.features.toArray().sum() for r in matrix.sparse_vectors(m, 2).collect()} == {"X": 3, "Y": 3}
    with pytest.raises(ValueError):
        matrix.matrix_long(long(spark), "colour")
    with pytest.raises(ValueError):
        matrix.wide(m, 12)
    with pytest.raises(ValueError):
        matrix.sparse_vectors(m, 16)


def test_normalize_filter_top(spark):
    m = matrix.matrix_long(long(spark))
    assert {(r.organism_id, r.kmer): round(r.value, 4) for r in matrix.normalize(m).collect()} == {("X", "AC"): 1, ("Y", "AC"): 0.3333, ("Y", "GT"): 0.6667}
    profile = {r.kmer: (r.prevalence, r.variance) for r in matrix.kmer_profile(m, 2).collect()}
    assert profile == {"AC": (1.0, 1.0), "GT": (0.5, 1.0)}
    assert matrix.filter_features(m, 2, 0.6, 0).select("kmer").distinct().first().kmer == "AC"
    assert [r.kmer for r in matrix.top_features(m, 2, 1).collect()] == ["AC"]  # ties by k-mer


def points(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(3)] + [(10 + i, [10.0 + i / 10, 10.0]) for i in range(5)] + [(99, [50.0, 50.0])]
    return spark.createDataFrame(rows, "id bigint, x array<double>")


def test_dbscan_and_pairs(spark):
    p = points(spark)
    got = {r.id: (r.cluster, r.core) for r in ml.dbscan(p, "id", "x", 0.25, 3).collect()}
    assert got[99] == (None, False) and got[0] == (None, False)
    assert {got[10 + i][0] for i in range(5)} == {10}
    rows = [(r.id, r.x) for r in p.collect()]
    expect = {(a, b) for a, x in rows for b, y in rows if a < b and sum((i - j) ** 2 for i, j in zip(x, y)) ** 0.5 <= 1.05}
    assert {tuple(r) for r in ml.close_pairs(p, "id", "x", 1.05).collect()} == expect
    assert ml.dbscan(p.limit(0), "id", "x", 1.0, 2).count() == 0


def test_components_of_a_long_path(spark):
    nodes = spark.range(40)
    edges = spark.range(39).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in ml.smallest_reachable(nodes, edges).collect()} == {0}


def test_clusterings(spark):
    v = points(spark).where("id < 99").withColumn("features", array_to_vector("x"))
    for how in ("kmeans", "hierarchical"):
        found = {r.id: r.prediction for r in ml.cluster_organisms(v, None, clustering=how, n_clusters=2).collect()}
        assert found[0] == found[2] != found[10] == found[14]
    clustered = ml.kmeans(v, 2)
    assert ml.silhouette(clustered) > 0.9
    metrics = {r.metric: r.value for r in ml.evaluate(clustered, "x").collect()}
    assert metrics["davies_bouldin"] < 0.2
    assert ml.optimize_clusters(v.select("features"), range(2, 4)).orderBy(F.col("silhouette").desc()).first().n_clusters == 2
    with pytest.raises(NotImplementedError):
        ml.reduce_dimensions(v, "umap")
    with pytest.raises(ValueError):
        ml.cluster_organisms(v, None, clustering="magic")


def test_top_kmers_per_cluster(spark):
    m = matrix.matrix_long(long(spark))
    labels = spark.createDataFrame([("X", 0), ("Y", 1)], "organism_id string, prediction int")
    got = {(r.prediction, r["rank"]): (r.kmer, r.score) for r in ml.top_kmers_per_cluster(m, labels, 1).collect()}
    assert got == {(0, 1): ("AC", 2.0), (1, 1): ("GT", 2.0)}


@pytest.mark.parametrize("offset", [0.0, 1e3, 1e7])
@pytest.mark.parametrize("size", [2, 16, 256])
def test_close_pairs_equal_brute_force_at_any_offset(spark, offset, size):
    rng = np.random.default_rng(size)
    x = offset + rng.normal(0, 0.5 / np.sqrt(size), (120, size))
    x[1::3] = x[::3] + rng.normal(0, 0.1 / np.sqrt(size), x[::3].shape)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<double>")
    true = {(i, j) for i in range(120) for j in range(i + 1, 120) if np.sqrt(((x[i] - x[j]) ** 2).sum()) <= 0.5}
    got = [tuple(r) for r in ml.close_pairs(df, "id", "x", 0.5).collect()]
    assert len(got) == len(set(got)) and set(got) == true and true


@pytest.mark.parametrize("k", [8, 12])
@pytest.mark.parametrize("how", ["hierarchical", "ward", "kmeans"])
def test_from_kmers_to_clusters(spark, k, how):
    """Two kinds of organisms whose k-mers differ come apart."""
    rows = [(f"{kind}{i}", base * k, k, 5 + i) for kind, bases in (("a", "AC"), ("b", "GT")) for i in range(5) for base in bases] + [("a0", None, k, 1), (None, "A" * k, k, 1)]
    df = spark.createDataFrame(rows, "organism_id string, kmer string, k int, count bigint")
    found = {r.organism_id: r.prediction for r in ml.cluster_kmers(df, k, clustering=how, n_clusters=2).collect()}
    assert len(found) == 10 and len({found[f"a{i}"] for i in range(5)}) == len({found[f"b{i}"] for i in range(5)}) == 1 and found["a0"] != found["b0"]


def test_ward_tree_and_too_wide_pca(spark):
    v = points(spark).withColumn("features", array_to_vector("x"))
    labelled, tree = ml.ward_tree(v, 3)
    steps = tree.orderBy("step").collect()
    assert [r.step for r in steps] == list(range(len(steps))) and steps[-1]["size"] == 9 and all(a.height <= b.height + 1e-9 for a, b in zip(steps, steps[1:]))
    got = {r.id: r.prediction for r in labelled.collect()}
    assert len(set(got.values())) == 3 and got[10] == got[14] != got[0] == got[2] != got[99]
    with pytest.raises(ValueError):
        ml.cluster_organisms(matrix.sparse_vectors(matrix.matrix_long(spark.createDataFrame([("x", "ACGTACGT", 1)], "organism_id string, kmer string, count bigint")), 8))
    with pytest.raises(ValueError):
        ml.hierarchical(v, method="single")
