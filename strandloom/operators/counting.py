"""k-mer counting over contigs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kmer import is_kmer, letters

DEFAULT_KS = (8, 9, 10, 11, 12)


def checked_ks(ks: Iterable[int]) -> list[int]:
    """Distinct k values in order; an empty list or a k below 1 raises."""
    out = list(dict.fromkeys(int(k) for k in ks))
    if not out or min(out) < 1:
        raise ValueError(f"k values must be at least 1 and not empty: {out}")
    return out


def kmer_windows(contigs: DataFrame, ks: Iterable[int] = DEFAULT_KS, chunk: int = 2048, keep_ambiguous: bool = False, tasks: int | None = None) -> DataFrame:
    """One row (organism_id, k, kmer) for each window of each k, never across contigs.

    A contig shorter than the largest k gives nothing, for the smaller k too. Windows with a symbol other than A, C, G, T
    are dropped unless ``keep_ambiguous``; a symbol outside ASCII counts as one N. Null sequences give nothing. Contigs are cut into
    chunks of ``chunk`` starts that overlap by k-1, and windows are cut from the chunk's bytes: both are constant-time slices in
    generated code, so the work is linear in the length. Few long contigs leave cores idle; ``tasks`` then deals the chunks out over
    that many tasks, which moves each symbol once, before the windows multiply it.
    """
    ks = checked_ks(ks)
    low, top = min(ks), max(ks)
    ascii_ = F.when(F.octet_length("seq") == F.length("seq"), F.col("seq")).otherwise(F.regexp_replace("seq", r"[^\x00-\x7F]", "N"))
    whole = contigs.where(F.length("seq") >= top).select("organism_id", F.upper(ascii_).cast("binary").alias("_bytes"))
    chunks = whole.select("organism_id", F.explode(F.sequence(F.lit(1), F.octet_length("_bytes"), F.lit(chunk))).alias("_at"), "_bytes")
    text = F.substring(F.col("_bytes"), F.col("_at"), F.lit(chunk + top - 1))
    if not keep_ambiguous:
        text = F.regexp_replace(text.cast("string"), "[^ACGT]", "N").cast("binary")
    chunks = chunks.select("organism_id", text.alias("_text"))
    if tasks is not None:
        chunks = chunks.repartition(tasks)
    starts = F.sequence(F.lit(1), F.least(F.octet_length("_text") - (low - 1), F.lit(chunk)))
    out = chunks.where(F.octet_length("_text") >= low).select("organism_id", "_text", F.explode(starts).alias("_i"))
    out = out.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where(F.octet_length("_text") - F.col("_i") + 1 >= F.col("k"))
    out = out.select("organism_id", "k", F.substring(F.col("_text"), F.col("_i"), F.col("k")).cast("string").alias("kmer"))
    return out if keep_ambiguous else out.where(~F.contains("kmer", F.lit("N")))


def count_kmers(contigs: DataFrame, ks: Iterable[int] = DEFAULT_KS, chunk: int = 2048, tasks: int | None = None) -> DataFrame:
    """Forward-strand counts (organism_id, k, kmer, cnt); one shuffle after partial aggregation, all k in one pass.

    ``tasks`` deals the chunks of long contigs out before (see kmer_windows).
    """
    return kmer_windows(contigs, ks, chunk, tasks=tasks).groupBy("organism_id", "k", "kmer").agg(F.count(F.lit(1)).alias("cnt"))


def count_status(contigs: DataFrame, counts: DataFrame) -> DataFrame:
    """One status row per organism of ``contigs``: how many k-mers it gave, and ``ok`` or ``no k-mers``.

    Where ``contigs`` has a column ``error`` (files that could not be read, see fasta_source) the status is ``failed: `` and the
    reason, so one broken file costs no other organism its counts.
    """
    got = counts.groupBy("organism_id").agg(F.sum("cnt").alias("total_kmers"))
    error = F.max("error") if "error" in contigs.columns else F.max(F.lit(None).cast("string"))
    out = contigs.groupBy("organism_id").agg(error.alias("_error")).join(got, "organism_id", "left")
    status = F.when(F.col("_error").isNotNull(), F.concat(F.lit("failed: "), "_error")).when(F.col("total_kmers") > 0, "ok").otherwise("no k-mers")
    return out.withColumn("status", status).drop("_error")


def readable_counts(raw: DataFrame) -> DataFrame:
    """Rows of a loaded count table as (organism_id, k, kmer, cnt): exact duplicates once, readable k-mers, counts above 0, runs summed."""
    rows = raw.where((F.col("count") > 0) & is_kmer(F.col("kmer"), F.col("k"))).dropDuplicates()
    return rows.groupBy("organism_id", "k", letters(F.col("kmer")).alias("kmer")).agg(F.sum("count").alias("cnt"))
