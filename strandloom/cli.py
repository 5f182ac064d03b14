"""The three stages as commands: ``python -m strandloom.cli count|features|metadata ...``; each reads and writes files through Spark."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.kmer import FEATURE_SETS, decode
from .operators.counting import DEFAULT_KS, count_kmers, count_status
from .operators.features import kmer_features
from .operators.metadata import genome_stats, kmer_stats, metadata_document
from .sources import readers, sinks
from .sources.fasta_source import register

log = logging.getLogger("strandloom")


def _counted(spark: SparkSession, path: str):
    rows = readers.read_kmer_text(spark, path)
    return rows.groupBy("organism_id", "k", decode(F.upper("kmer")).alias("kmer")).agg(F.sum("count").alias("cnt"))


def count(spark: SparkSession, args: argparse.Namespace) -> None:
    """Counts the k-mers of all FASTA files of a folder; a file that cannot be read is logged, and the others are counted."""
    register(spark)
    contigs = spark.read.format("fasta_ordered").option("errors", "keep").load(args.input)
    counts = count_kmers(contigs, args.k, tasks=args.tasks)
    sinks.write_kmer_text(counts, args.output, args.compress)
    for r in count_status(contigs, counts).where("status <> 'ok'").limit(100).collect():
        log.warning("%s: %s", r.organism_id, r.status)


def features(spark: SparkSession, args: argparse.Namespace) -> None:
    """Writes the feature files of counted k-mers."""
    sinks.write_feature_csv(kmer_features(_counted(spark, args.input), args.groups), args.output)


def metadata(spark: SparkSession, args: argparse.Namespace) -> None:
    """Writes the metadata of genomes and, if given, of their counted k-mers."""
    genomes = genome_stats(readers.read_fasta(spark, args.input)).withColumn("last_updated", F.current_timestamp())
    counts = _counted(spark, args.counts) if args.counts else spark.createDataFrame([], "organism_id string, k int, kmer string, cnt bigint")
    sinks.write_metadata_json(metadata_document(genomes, kmer_stats(counts)), args.output, args.one_document)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="strandloom", description=__doc__)
    parser.add_argument("--log-level", default="INFO", choices=["DEBUG", "INFO", "WARNING", "ERROR"])
    stages = parser.add_subparsers(required=True)
    for run in (count, features, metadata):
        stage = stages.add_parser(run.__name__, help=run.__doc__)
        stage.add_argument("input")
        stage.add_argument("output")
        stage.set_defaults(run=run)
        if run is count:
            stage.add_argument("-k", type=int, nargs="+", default=list(DEFAULT_KS))
            stage.add_argument("--compress", action="store_true")
            stage.add_argument("--tasks", type=int, help="deal the chunks of a few long contigs out over so many tasks")
        elif run is features:
            stage.add_argument("--groups", default="all", choices=list(FEATURE_SETS))
        else:
            stage.add_argument("--counts")
            stage.add_argument("--one-document", action="store_true")
    args = parser.parse_args(argv)
    logging.basicConfig(level=args.log_level, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    args.run(spark or SparkSession.builder.appName("strandloom").getOrCreate(), args)


if __name__ == "__main__":
    main()
