"""Genome and k-mer metadata, with incremental refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kmer import base_count


def genome_stats(contigs: DataFrame) -> DataFrame:
    """(genome_id, contigs, total_size, gc_content, n_count); every symbol counts for the size, empty contigs count as contigs."""
    seq = F.upper(F.coalesce(F.col("seq"), F.lit("")))
    total = F.sum(F.length(seq).cast("bigint"))
    gc = F.sum(base_count(seq, "GC").cast("bigint"))
    return contigs.groupBy(F.col("organism_id").alias("genome_id")).agg(
        F.count(F.lit(1)).alias("contigs"),
        total.alias("total_size"),
        F.when(total > 0, gc * F.lit(100.0) / total).otherwise(0.0).alias("gc_content"),
        F.sum(base_count(seq, "N").cast("bigint")).alias("n_count"),
    )


def kmer_stats(counts: DataFrame) -> DataFrame:
    """Summary of the counts per (organism_id, k).

    With a column ``file_path`` in ``counts`` the summary names the (smallest) path of each group. The exact median comes from a histogram of the counts (few distinct values), so no group is held in one buffer of
    all its rows. Counts that are null are left out.
    """
    named = "file_path" in counts.columns
    histogram = counts.where(F.col("cnt").isNotNull()).groupBy("organism_id", "k", "cnt").agg(F.count(F.lit(1)).alias("n"), *[F.min("file_path").alias("file_path")] * named)
    return histogram.groupBy("organism_id", F.col("k").alias("k_value")).agg(
        *[F.min("file_path").alias("file_path")] * named,
        F.sum(F.col("cnt") * F.col("n")).alias("total_kmers"),
        F.sum("n").alias("unique_kmers"),
        F.max("cnt").alias("max_count"),
        F.min("cnt").alias("min_count"),
        (F.sum(F.col("cnt") * F.col("n")) / F.sum("n")).alias("mean_count"),
        F.expr("percentile(cnt, 0.5D, n)").alias("median_count"),
        (F.sum(F.col("cnt") * F.col("n")) + F.col("k_value") - 1).alias("estimated_genome_size"),
    )


def missing_rows(new: DataFrame, known: DataFrame, keys: list[str], refresh: bool = False) -> DataFrame:
    """The rows of ``new`` that are still to be computed: all with ``refresh``, else those whose keys ``known`` lacks."""
    return new if refresh else new.join(known.select(*keys).distinct(), keys, "left_anti")


def merge_metadata(known: DataFrame, new: DataFrame, keys: list[str], refresh: bool = False) -> DataFrame:
    """Known rows and new ones; without ``refresh`` a known key keeps its row, with it only the matching keys are replaced."""
    if refresh:
        return known.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)
    return known.unionByName(missing_rows(new, known, keys), allowMissingColumns=True)


def latest_rows(meta: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, by the columns of ``order`` (descending, nulls last)."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return meta.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def metadata_document(genomes: DataFrame, kmers: DataFrame) -> DataFrame:
    """One row per organism with its genome fields and a map from k (as text) to the k-mer summary; either side may lack it."""
    rest = [c for c in kmers.columns if c != "organism_id"]
    packed = kmers.groupBy(F.col("organism_id").alias("genome_id")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("k_value").cast("string").alias("key"), F.struct(*rest).alias("value"))))).alias("kmers")
    )
    return genomes.join(packed, "genome_id", "full")
