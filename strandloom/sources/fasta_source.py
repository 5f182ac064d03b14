"""A Python data source for FASTA that keeps the order of the contigs: ``spark.read.format("fasta_ordered").load(path)``."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SUFFIXES = ("fa", "fasta", "fna")


class FastaDataSource(DataSource):
    """One task per file; rows (organism_id, contig_ord, contig_id, seq, error) leave as each record ends. Text before a header is skipped.

    ``path`` is a file or folder on any file system that Arrow knows (local, hdfs, s3, gs). A file that cannot be read fails the
    job; with the option ``errors`` set to ``keep`` it gives, after the records it held so far, one row with ``error`` and nulls.
    """

    @classmethod
    def name(cls) -> str:
        return "fasta_ordered"

    def schema(self) -> str:
        return "organism_id string, contig_ord int, contig_id string, seq string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("errors", "fail"))


class _Reader(DataSourceReader):
    def __init__(self, path: str, errors: str):
        if errors not in ("fail", "keep"):
            raise ValueError(f"errors is fail or keep, not {errors!r}")
        self.path = path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path)
        self.errors = errors

    def _at(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def partitions(self):
        from pyarrow import fs

        files, path = self._at()
        info = files.get_file_info(path)
        found = files.get_file_info(fs.FileSelector(path)) if info.type == fs.FileType.Directory else [info]
        names = sorted(f.path for f in found if f.type == fs.FileType.File)
        return [InputPartition(f) for f in names if f.removesuffix(".gz").rsplit(".", 1)[-1] in SUFFIXES]

    def read(self, partition):
        path = partition.value
        organism = os.path.basename(path.removesuffix(".gz")).rsplit(".", 1)[0]
        try:
            for order, name, seq in self._records(path):
                yield organism, order, name, seq, None
        except (OSError, ValueError) as error:
            if self.errors == "fail":
                raise
            yield organism, None, None, None, f"{type(error).__name__}: {error}"

    def _records(self, path):
        import io

        files, _ = self._at()
        order, name, parts = -1, None, []
        raw = files.open_input_stream(path, compression="gzip" if path.endswith(".gz") else None)
        with io.TextIOWrapper(io.BufferedReader(raw, 1 << 20), "utf-8") as lines:
            for line in lines:
                if line.startswith(">"):
                    if name is not None:
                        yield order, name, "".join(parts).upper()
                    order, name, parts = order + 1, (line[1:].split() or [""])[0], []
                elif name is not None:
                    parts.append("".join(line.split()))
        if name is not None:
            yield order, name, "".join(parts).upper()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastaDataSource)
