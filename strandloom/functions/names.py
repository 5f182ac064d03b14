"""Column expressions on file names, paths, accessions and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCESSION_PREFIXES = ("GCF_", "GCA_")


def plain_path(path: Column) -> Column:
    """A file's address (as in _metadata.file_path) without its percent signs: names may hold spaces and other characters."""
    return F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """The name without its last suffix; a name that starts with its only dot is its own stem."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def parent_name(path: Column) -> Column:
    """The name of the folder that holds the file, or an empty text."""
    return F.regexp_extract(path, "([^/]+)/[^/]+$", 1)


def k_of_file(path: Column) -> Column:
    """k from the first 'k<digits>' of the file's name, else null."""
    return F.nullif(F.regexp_extract(file_name(path), r"k(\d+)", 1), F.lit("")).cast("int")


def organism_of_feature_file(path: Column) -> Column:
    """The first two '_' parts of the stem; opt-in, as it merges the versions of one assembly."""
    return F.substring_index(file_stem(path), "_", 2)


def accession_file_name(accession: Column) -> Column:
    return F.replace(accession, F.lit("."), F.lit("_"))


def is_accession(text: Column) -> Column:
    return text.startswith(ACCESSION_PREFIXES[0]) | text.startswith(ACCESSION_PREFIXES[1])


def download_url(refseq: Column, genbank: Column) -> Column:
    """Address of the genome file: the RefSeq path, else the GenBank path; null when both are empty."""
    path = F.coalesce(F.nullif(refseq, F.lit("")), F.nullif(genbank, F.lit("")))
    return F.regexp_replace(F.concat(path, F.lit("/"), F.substring_index(path, "/", -1), F.lit("_genomic.fna.gz")), "^ftp", "https")


# The two patterns below are the formats to be matched.


def is_email(text: Column) -> Column:
    return text.rlike(r"^[^@]+@[^@]+\.[^@]+\z")


def is_tool_name(text: Column) -> Column:
    return text.rlike(r"^[\w\-]+\z")
