"""Readers of genome, k-mer, feature, accession and metadata files."""

from __future__ import annotations

import csv
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.names import file_stem, is_accession, k_of_file, parent_name, plain_path

FASTA_SUFFIXES = ("fa", "fasta", "fna")
FEATURE_SCHEMA = (
    "kmer string, count bigint, k int, gc_percent double, A_count int, C_count int, G_count int, T_count int, A_present int,"
    " C_present int, G_present int, T_present int, cpg_count int, cpg_obs_exp double, shannon_entropy double,"
    " normalized_entropy double, has_repeat int, genome_size bigint"
)
METADATA_SCHEMA = (
    "map<string, struct<file_path: string, last_updated: string, contigs: bigint, total_size: bigint, gc_content: double, n_count: bigint,"
    " kmers: map<string, struct<file_path: string, k_value: int, total_kmers: bigint, unique_kmers: bigint, max_count: bigint,"
    " min_count: bigint, mean_count: double, median_count: double, estimated_genome_size: bigint>>>>"
)


def glob_of(patterns: Iterable[str] | None) -> str:
    """One brace glob of several patterns, so that a file which matches two of them is read once."""
    patterns = list(patterns or ["*"])
    return patterns[0] if len(patterns) == 1 else "{" + ",".join(patterns) + "}"


def find_files(spark: SparkSession, directory: str, patterns: Iterable[str] | None = None, recursive: bool = False) -> DataFrame:
    """(file_path, length) of the matching files, ordered by path; reads no content."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob_of(patterns)).option("recursiveFileLookup", recursive)
    return reader.load(directory).select(F.col("path").alias("file_path"), "length").orderBy("file_path")


def read_fasta(spark: SparkSession, paths: str | list[str], check_names: bool = True) -> DataFrame:
    """Contigs (organism_id, contig_id, seq) of plain or gz FASTA files; plain files are split.

    The organism is the file's stem (of the plain name for gz). Sequences are upper-cased, white space and line ends are
    removed, empty records stay. Text before the first header can't be told from a record and becomes one. With
    ``check_names`` two files of one stem raise.
    """
    name = F.regexp_replace("_file", r"\.gz$", "")
    raw = spark.read.option("lineSep", "\n>").text(paths).select("value", plain_path(F.col("_metadata.file_path")).alias("_file"))
    if check_names:
        twice = spark.read.format("binaryFile").load(paths).select(file_stem(F.regexp_replace("path", r"\.gz$", "")).alias("s"))
        if bad := [r.s for r in twice.groupBy("s").count().where("count > 1").limit(5).collect()]:
            raise ValueError(f"several files of one name: {bad}")
    record = F.regexp_replace("value", "^>", "")
    body = F.regexp_replace(F.regexp_replace(record, r"^[^\n]*\n?", ""), r"\s+", "")
    out = raw.where(F.length(F.trim("value")) > 0).select(file_stem(name).alias("organism_id"), record.alias("_r"), body.alias("_b"))
    return out.select("organism_id", F.regexp_extract("_r", r"^(\S+)", 1).alias("contig_id"), F.upper("_b").alias("seq"))


def fasta_upper(lines: DataFrame) -> DataFrame:
    """FASTA lines (value) with sequences in upper case and header lines as they are."""
    return lines.withColumn("value", F.when(F.col("value").startswith(">"), F.col("value")).otherwise(F.upper("value")))


def read_kmer_text(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(organism_id, k, kmer, count) of '<organism>/k<k>.txt[.gz]' files anywhere below ``paths``, with or without a header line.

    The k-mer stays text, so leading zeros of the digit code are kept. Files whose name has no k, and lines whose count is
    no number, are left out; an empty file gives no rows.
    """
    rows = spark.read.schema("kmer string, count string").option("sep", "\t").option("recursiveFileLookup", True).csv(paths)
    path = plain_path(F.col("_metadata.file_path"))
    rows = rows.select(parent_name(path).alias("organism_id"), k_of_file(path).alias("k"), "kmer", F.expr("try_cast(count as bigint)").alias("count"))
    return rows.where(F.col("k").isNotNull() & F.col("count").isNotNull())


def read_feature_csv(spark: SparkSession, paths: str | list[str], metric: str = "count") -> DataFrame:
    """Feature files ('<organism>_kmer_features.csv' or any name) with a header, and their file's organism; quoting as CSV has it.

    Columns are taken by name (the header differs with the feature groups); those that a file lacks are null. A file without the
    column kmer or that of ``metric`` is skipped. Only the first line of each file is looked at beforehand; files of one header are
    read together.
    """
    kinds = dict(x.strip().split(" ") for x in FEATURE_SCHEMA.split(","))
    if metric not in kinds:
        raise ValueError(f"no column {metric!r}")
    groups: dict[str, list[str]] = {}
    for path in spark.read.option("recursiveFileLookup", True).text(paths).inputFiles():
        groups.setdefault(_first_line(spark, path), []).append(path)
    organism = F.regexp_replace(file_stem(plain_path(F.col("_metadata.file_path"))), "_kmer_features$", "").alias("organism_id")
    out = spark.createDataFrame([], "organism_id string, " + FEATURE_SCHEMA)
    for header, files in sorted(groups.items()):
        names = next(csv.reader([header]), [])
        if "kmer" in names and metric in names:
            schema = StructType([StructField(f"_c{i}", StringType()) for i in range(len(names))])
            rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(files)
            cells = [F.col(f"_c{names.index(c)}").try_cast(t).alias(c) if c in names else F.lit(None).cast(t).alias(c) for c, t in kinds.items()]
            out = out.unionByName(rows.select(organism, *cells))
    return out


def _first_line(spark: SparkSession, path: str) -> str:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at), "UTF-8"))
    try:
        return reader.readLine() or ""
    finally:
        reader.close()


def read_accession_text(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Distinct accessions of a text list: split at white space, '#' lines and blanks dropped, GCF_/GCA_ only."""
    return clean_accessions(spark.read.text(paths), "value")


def clean_accessions(lines: DataFrame, column: str) -> DataFrame:
    """(accession): see read_accession_text."""
    words = lines.where(~F.coalesce(F.trim(column), F.lit("#")).startswith("#")).select(F.explode(F.split(F.trim(column), r"\s+")).alias("accession"))
    return words.where(is_accession(F.col("accession"))).distinct()


def read_accession_table(spark: SparkSession, path: str, column: int | str | None = None) -> DataFrame:
    """(accession), trimmed, of one column of a CSV or TSV file with header; duplicates and any prefix stay.

    The column is given by position or name, else it is the first whose header holds both 'assembly' and 'accession', else
    the first. Short rows and empty cells are dropped.
    """
    separator = {"csv": ",", "tsv": "\t"}.get(path.rsplit(".", 1)[-1].lower())
    if separator is None:
        raise ValueError(f"neither .csv nor .tsv: {path}")
    table = spark.read.option("header", True).option("sep", separator).csv(path)
    if column is None:
        column = next((c for c in table.columns if "assembly" in c.lower() and "accession" in c.lower()), 0)
    name = table.columns[column] if isinstance(column, int) else column
    if name not in table.columns:
        raise ValueError(f"no column {name!r}")
    return table.select(F.trim(table[f"`{name}`"]).alias("accession")).where("accession <> ''")


def read_accessions(spark: SparkSession, path: str, column: int | str | None = None) -> DataFrame:
    """By the suffix: .txt lists, .csv and .tsv tables; others raise ValueError."""
    if path.lower().endswith(".txt"):
        return read_accession_text(spark, path)
    return read_accession_table(spark, path, column)


def read_metadata_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Two flat tables of metadata in JSON: genomes, and k-mer summaries per organism and k; both empty if it is absent or broken.

    JSON lines (one object a line, as ``sinks.write_metadata_json`` writes them) are read by all tasks. Where the first line is no
    whole object, each file is one document, which one task parses: a form for small files only.
    """
    try:
        lines = spark.read.text(path)
        first = lines.where(F.length(F.trim("value")) > 0).select(F.from_json("value", METADATA_SCHEMA).isNotNull().alias("whole"), F.trim("value").endswith("}").alias("ends")).first()
        text = lines if first is not None and first.whole and first.ends else spark.read.text(path, wholetext=True)
    except AnalysisException:
        text = spark.createDataFrame([], "value string")
    rows = text.select(F.explode(F.from_json("value", METADATA_SCHEMA)).alias("genome_id", "m"))
    fields = ("file_path", "last_updated", "contigs", "total_size", "gc_content", "n_count")
    genomes = rows.select("genome_id", *[F.col(f"m.{f}") for f in fields]).withColumn("last_updated", F.expr("try_to_timestamp(last_updated, 'yyyy-MM-dd HH:mm:ss')"))
    kmers = rows.select(F.col("genome_id").alias("organism_id"), F.explode("m.kmers").alias("_k", "s")).select("organism_id", "s.*")
    return genomes, kmers


def genome_size(genomes: DataFrame, genome_id: str) -> int | None:
    """The total size of one genome, or None if it is unknown or 0."""
    row = genomes.where(F.col("genome_id") == genome_id).agg(F.max("total_size").alias("s")).first()
    return row.s or None


def available_genomes(genomes: DataFrame) -> DataFrame:
    """(genome_id), each once."""
    return genomes.where("genome_id is not null").select("genome_id").distinct()
