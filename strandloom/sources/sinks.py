"""Sinks: Parquet as the canonical form, text, CSV and JSON in the layouts that other tools and our own readers read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kmer import encode


def write_counts(counts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """k-mer counts as Parquet, partitioned by organism and k (pruned on reading)."""
    counts.write.mode(mode).partitionBy("organism_id", "k").parquet(path)


def write_kmer_text(counts: DataFrame, path: str, compress: bool = False, mode: str = "overwrite") -> None:
    """'digits TAB count' lines in '<organism>/k<k>.txt' files (gzip with .gz if asked), ordered by k-mer; ``readers.read_kmer_text`` reads them.

    One task writes one file, of at most 4^k lines. Rows with a null organism or k belong to no file and raise.
    """
    rows = counts.select("organism_id", "k", encode(F.col("kmer")).alias("kmer"), "cnt")
    rows = rows.repartition("organism_id", "k").sortWithinPartitions("organism_id", "k", "kmer")
    writer = rows.write.mode(mode).partitionBy("organism_id", "k").option("sep", "\t")
    (writer.option("compression", "gzip") if compress else writer).csv(path)
    _name_files(counts.sparkSession, path, ["organism_id", "k"], lambda organism, k: f"{organism}/k{k}.txt" + (".gz" if compress else ""))


def write_feature_csv(features: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Feature rows with a header as '<organism>_kmer_features.csv', ordered by k and k-mer; one task writes one organism's file."""
    rows = features.repartition("organism_id").sortWithinPartitions("organism_id", "k", "kmer")
    rows.write.mode(mode).partitionBy("organism_id").option("header", True).csv(path)
    _name_files(features.sparkSession, path, ["organism_id"], lambda organism: f"{organism}_kmer_features.csv")


def _name_files(spark: SparkSession, path: str, columns: list[str], name) -> None:
    """Renames the one file of each partition folder below ``path``; only names pass through the driver."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    pattern = "/".join(f"{c}=*" for c in columns)
    for found in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{pattern}/part-*")):
        at, values = found.getPath().getParent(), []
        for _ in columns:
            values.insert(0, unescape(at.getName().split("=", 1)[1]))
            at = at.getParent()
        if "__HIVE_DEFAULT_PARTITION__" in values:
            raise ValueError(f"rows with a null in {columns} belong to no file")
        if any("/" in v for v in values):
            raise ValueError(f"no file name: {values}")
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name(*values)}")
        fs.mkdirs(target.getParent())
        if not fs.rename(found.getPath(), target):
            raise OSError(f"cannot name {target.toString()}")
    for folder in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{columns[0]}=*")):
        fs.delete(folder.getPath(), True)


def metadata_json(document: DataFrame) -> DataFrame:
    """One JSON object a genome (genome_id as its only key), as lines of ``value``."""
    fields = [c for c in document.columns if c != "genome_id"]
    fields = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if dict(document.dtypes)[c] == "timestamp" else F.col(c) for c in fields]
    return document.where("genome_id is not null").select(F.to_json(F.create_map("genome_id", F.struct(*fields))).alias("value"))


def write_metadata_json(document: DataFrame, path: str, one_document: bool = False, mode: str = "overwrite") -> None:
    """The metadata as JSON lines, one genome a line; or, with ``one_document``, as one object with the genomes as keys in order.

    The lines are written by all tasks. The one document is for tools that want it: a single task writes it in a stream.
    ``readers.read_metadata_json`` reads both.
    """
    lines = metadata_json(document)
    if one_document:
        order = Window.orderBy("value")
        rows = lines.select(F.row_number().over(order).alias("n"), F.expr("substring(value, 2, length(value) - 2)").alias("value"))
        head = rows.sparkSession.createDataFrame([(0, "{")], "n int, value string")
        tail = rows.sparkSession.createDataFrame([(2147483647, "}")], "n int, value string")
        body = rows.select("n", F.concat(F.when(F.col("n") > 1, ",").otherwise(""), "value").alias("value"))
        lines = head.unionByName(body).unionByName(tail).coalesce(1).sortWithinPartitions("n").select("value")
    lines.write.mode(mode).text(path)
