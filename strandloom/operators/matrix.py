"""Organism x k-mer matrices: long and sparse forms for any k, wide and zero-filled forms for small k.

The reference leaves normalising, filtering and ranking undefined; the definitions here are ours: frequency is value over
the organism's total; prevalence is the share of organisms with a value above 0; variance is that of the population with
the zeros included; thresholds are inclusive; ties go to the smaller k-mer.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kmer import BASES, rank4

#: The zero-filled forms hold organisms x 4^k cells; beyond this k use the sparse form.
MAX_DENSE_K = 6


def matrix_long(features: DataFrame, metric: str = "count", k: int | None = None) -> DataFrame:
    """(organism_id, kmer, value); several rows of one cell give the largest value. A missing metric column raises."""
    if metric not in features.columns:
        raise ValueError(f"no column {metric!r}")
    rows = features if k is None else features.where(F.col("k") == k)
    return rows.groupBy("organism_id", "kmer").agg(F.max(F.col(metric).cast("double")).alias("value"))


def vocabulary(matrix: DataFrame) -> DataFrame:
    """The distinct k-mers."""
    return matrix.select("kmer").distinct()


def all_kmers(k: int) -> list[str]:
    if not 1 <= k <= MAX_DENSE_K:
        raise ValueError(f"dense forms are for k from 1 to {MAX_DENSE_K}; use sparse_rows for k = {k}")
    return ["".join(p) for p in product(BASES, repeat=k)]


def zero_filled(matrix: DataFrame, k: int) -> DataFrame:
    """Every organism with every k-mer of length k, 0 where there is no value: the grid is exploded per organism."""
    grid = matrix.select("organism_id").distinct().select("organism_id", F.explode(F.array(*map(F.lit, all_kmers(k)))).alias("kmer"))
    return grid.join(matrix, ["organism_id", "kmer"], "left").select("organism_id", "kmer", F.coalesce("value", F.lit(0.0)).alias("value"))


def wide(matrix: DataFrame, k: int) -> DataFrame:
    """One row per organism, one column per k-mer in lexicographic order, zeros filled; rows in no order (sort by organism_id for one)."""
    return matrix.groupBy("organism_id").pivot("kmer", all_kmers(k)).agg(F.first("value")).na.fill(0.0)


def sparse_rows(matrix: DataFrame) -> DataFrame:
    """(organism_id, indices, values): indices are lexicographic base-4 ranks, ascending; any k up to 31."""
    cells = F.array_sort(F.collect_list(F.struct(rank4(F.col("kmer")).alias("i"), F.col("value").alias("v"))))
    packed = matrix.where("value <> 0").groupBy("organism_id").agg(cells.alias("_c"))
    return packed.select("organism_id", F.col("_c.i").alias("indices"), F.col("_c.v").alias("values"))


def sparse_vectors(matrix: DataFrame, k: int) -> DataFrame:
    """(organism_id, features) with pyspark.ml sparse vectors of size 4^k (k up to 15), made from their struct form, without Python."""
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import StructField, StructType

    if k > 15:
        raise ValueError("a vector's index has 32 bits: k is 15 at most")
    row = F.to_json(F.struct(F.struct(F.lit(0).alias("type"), F.lit(4**k).alias("size"), F.col("indices").cast("array<int>").alias("indices"), "values").alias("v")))
    parsed = F.from_json(row, StructType([StructField("v", VectorUDT())]))
    return sparse_rows(matrix).select("organism_id", parsed["v"].alias("features"))


def kmer_vectors(matrix: DataFrame, n_top: int = 500, min_prevalence: float = 0.0, min_variance: float = 0.0) -> DataFrame:
    """(organism_id, features): dense vectors of the frequencies of the ``n_top`` most varying k-mers that reach the thresholds, for any k.

    Positions follow variance (descending), then the k-mer. The list of k-mers is at most ``n_top`` rows, so it is broadcast. An organism
    without any of them has a vector of zeros.
    """
    from pyspark.ml.functions import array_to_vector

    shares = normalize(matrix)
    organisms = matrix.select("organism_id").distinct()
    chosen = filter_features(shares, organisms.count(), min_prevalence, min_variance)
    best = top_features(chosen, organisms.count(), n_top).withColumn("pos", F.row_number().over(Window.orderBy(F.col("variance").desc(), "kmer")) - 1)
    best = best.select("kmer", "pos").cache()
    size = best.count()
    cells = shares.join(F.broadcast(best), "kmer").groupBy("organism_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "value"))).alias("m"))
    full = organisms.join(cells, "organism_id", "left")
    values = F.transform(F.sequence(F.lit(0), F.lit(max(size, 1) - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return full.select("organism_id", array_to_vector(values).alias("features"))


def normalize(matrix: DataFrame) -> DataFrame:
    """Values as frequencies within the organism."""
    total = F.sum("value").over(Window.partitionBy("organism_id"))
    return matrix.withColumn("value", F.when(total != 0, F.col("value") / total).otherwise(0.0))


def kmer_profile(matrix: DataFrame, organisms: int) -> DataFrame:
    """(kmer, prevalence, variance) over ``organisms`` organisms, absent cells being 0."""
    n = F.lit(float(organisms))
    mean = F.sum("value") / n
    return matrix.groupBy("kmer").agg(
        (F.sum(F.when(F.col("value") > 0, 1).otherwise(0)) / n).alias("prevalence"),
        F.greatest(F.sum(F.col("value") * F.col("value")) / n - mean * mean, F.lit(0.0)).alias("variance"),
    )


def filter_features(matrix: DataFrame, organisms: int, min_prevalence: float = 0.2, min_variance: float = 0.001) -> DataFrame:
    """The cells of the k-mers that reach both thresholds."""
    keep = kmer_profile(matrix, organisms).where((F.col("prevalence") >= min_prevalence) & (F.col("variance") >= min_variance))
    return matrix.join(keep.select("kmer"), "kmer", "left_semi")


def top_features(matrix: DataFrame, organisms: int, n: int = 500) -> DataFrame:
    """The n k-mers of largest variance (a top-k report)."""
    return kmer_profile(matrix, organisms).orderBy(F.col("variance").desc(), "kmer").limit(n)
