"""Incremental k-mer counts over a stream of contigs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.counting import DEFAULT_KS, count_kmers


def append_counts(contigs: DataFrame, path: str, checkpoint: str, ks: Iterable[int] = DEFAULT_KS) -> StreamingQuery:
    """Writes each micro-batch's counts under ``path/batch=<id>``; a repeated batch overwrites its own folder only.

    Counts add up, so ``current_counts`` over all batches equals one count over all contigs; no state is kept.
    """

    def save(batch: DataFrame, number: int) -> None:
        count_kmers(batch, ks).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return contigs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()


def current_counts(batches: DataFrame) -> DataFrame:
    """The sum over the batches."""
    from pyspark.sql import functions as F

    return batches.groupBy("organism_id", "k", "kmer").agg(F.sum("cnt").alias("cnt"))
