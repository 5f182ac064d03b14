"""Per-k-mer feature rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kmer import feature_columns


def kmer_features(counts: DataFrame, groups="all", genome_meta: DataFrame | None = None, ks: Iterable[int] | None = None) -> DataFrame:
    """Features of each row of counts (organism_id, k, kmer, cnt), in the groups asked for.

    Without ``genome_meta`` there is no shuffle; with it, genome_size comes by a left join on the organism and is null
    where the size is unknown or 0. Rows with neither a k-mer nor a count are left out. ``ks`` keeps some k only (partition pruning on a table partitioned by k).
    """
    if ks is not None:
        counts = counts.where(F.col("k").isin([int(k) for k in ks]))
    # holds for every real row; it keeps the features a projection of their own above an aggregate, where common parts are computed once
    counts = counts.where(F.col("kmer").isNotNull() | F.col("cnt").isNotNull())
    out = counts.select("organism_id", "kmer", F.col("cnt").alias("count"), "k", *feature_columns(F.col("kmer"), groups))
    if genome_meta is None:
        return out
    size = genome_meta.select(F.col("genome_id").alias("organism_id"), F.nullif("total_size", F.lit(0).cast("bigint")).alias("genome_size"))
    return out.join(size, "organism_id", "left")
