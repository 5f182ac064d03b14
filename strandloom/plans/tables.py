"""The test tables, and contigs derived from them (they hold no DNA)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table that lies in far fewer files than there are cores, dealt out over the cores; others stay where they lie.

    For work that far exceeds the moving of its rows (text, windows) on tables that are one small file. The rows and results are the
    same either way; only the files are listed, nothing is planned or read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * len(df.inputFiles()) <= cores else df


def _letters(prefix: str, key: str):
    return F.translate(F.md5(F.concat(F.lit(prefix), F.col(key).cast("string"))), "0123456789abcdef", "ACGTACGTACGTACGN")


def contigs(spark: SparkSession, sf_dir: str, name: str = "customer") -> DataFrame:
    """(organism_id, contig_id, seq): a text of 4 to 128 symbols per row of ``customer`` or ``orders``, from hashes of its key."""
    key, organism = {"customer": ("c_custkey", F.col("c_nationkey")), "orders": ("o_orderkey", F.col("o_custkey") % 25)}[name]
    seq = F.substring(F.concat(*[_letters(p, key) for p in "abcd"]), F.lit(1), (F.lit(4) + F.col(key) % 125).cast("int"))
    rows = spread(table(spark, sf_dir, name).select(key, "c_nationkey" if name == "customer" else "o_custkey"))
    # exploded, as filters on the text would else be worked out a second time, by the few tasks that read the files
    return rows.select(F.concat(F.lit("ORG_"), organism).alias("organism_id"), F.col(key).alias("contig_id"), F.explode(F.array(seq)).alias("seq"))


def _sql_letters(prefix: str, key: str) -> str:
    return f"translate(md5(concat('{prefix}', {key})), '0123456789abcdef', 'ACGTACGTACGTACGN')"


def contigs_sql(name: str = "customer") -> str:
    key, organism = {"customer": ("c_custkey", "c_nationkey"), "orders": ("o_orderkey", "o_custkey % 25")}[name]
    letters = ", ".join(_sql_letters(p, key) for p in "abcd")
    return f"select concat('ORG_', {organism}) organism_id, {key} contig_id, substr(concat({letters}), 1, cast(4 + {key} % 125 as int)) seq from {name}"


def counts_sql(ks, name: str = "customer") -> str:
    """SQL of the k-mer counts over the contigs."""
    top = max(ks)
    parts = " union all ".join(
        f"select organism_id, {k} k, substr(seq, i::int, {k}) kmer from (select organism_id, seq, unnest(range(1, length(seq) - {k} + 2)) i from contigs where length(seq) >= {top})"
        for k in ks
    )
    return f"with contigs as ({contigs_sql(name)}), windows as ({parts}), counts as (select organism_id, k::int k, kmer, count(*) cnt from windows where regexp_full_match(kmer, '[ACGT]+') group by all)"


#: SQL of readable_counts over the loaded table.
READ = "translate(upper(kmer), '0123', 'ATCG')"
VALID = f"(length({READ}) = k and regexp_full_match({READ}, '[ACGT]+'))"
LOADED = f"""counts as (select organism_id, k, {READ} kmer, sum("count")::bigint cnt from (select distinct * from kmer_counts where "count" > 0 and {VALID}) group by 1, 2, 3)"""
FEATURES = f"""rows_ as (select organism_id, {READ} kmer, k, "count", gc_percent from kmer_features where {VALID})"""
