"""Frequency of every distinct term: a global integer dictionary, and count arrays by identifier range."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Identifiers in a count array; records whose rows of one block are meant for one piece.
BLOCK, PIECE_RECORDS = 4096, 10_000


def dictionary(terms: DataFrame, term: str) -> DataFrame:
    """(term, id) of the distinct non-null terms, ids dense from 0, written once so that they never change.

    Ids follow Spark's partitions; the driver holds one count per partition.
    """
    numbered = terms.where(F.col(term).isNotNull()).select(F.col(term).alias("term")).distinct().withColumn("_m", F.monotonically_increasing_id())
    numbered = written(numbered, "dictionary")
    part, place = F.shiftright("_m", 33).cast("int"), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(numbered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets = zip([r.p for r in sizes], accumulate([r.n for r in sizes], initial=0))
    starts = terms.sparkSession.createDataFrame([(p, o) for p, o in offsets], "p int, start bigint")
    return numbered.join(F.broadcast(starts), part == F.col("p")).select("term", (F.col("start") + place).alias("id"))


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Count arrays of each block of ids within a task; the table of open blocks is emptied when it grows."""
    open_: dict[int, np.ndarray] = {}
    for pdf in batches:
        ids = pdf["id"].to_numpy()
        block = ids // BLOCK
        for b in np.unique(block):
            mask = block == b
            arrays = open_.setdefault(int(b), np.zeros((2, BLOCK), np.int64))
            np.add.at(arrays[0], ids[mask] % BLOCK, pdf["weight"].to_numpy()[mask])
            np.add.at(arrays[1], ids[mask] % BLOCK, pdf["present"].to_numpy()[mask])
        if len(open_) > 1024:
            yield _emptied(open_)
    if open_:
        yield _emptied(open_)


def _emptied(open_: dict[int, np.ndarray]) -> pd.DataFrame:
    """The blocks as rows that hold their used places only, so a block that many tasks share costs each what it counted."""
    used = {b: np.flatnonzero(a.any(axis=0)) for b, a in open_.items()}
    out = pd.DataFrame({"block": list(open_), "places": list(used.values()), "occurrences": [open_[b][0][at] for b, at in used.items()], "records": [open_[b][1][at] for b, at in used.items()]})
    open_.clear()
    return out


def _summed(key: tuple[Any, ...], pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total, seen = np.zeros((2, BLOCK), np.int64), np.zeros(BLOCK, bool)
    for pdf in pdfs:
        for at, o, r in zip(pdf["places"], pdf["occurrences"], pdf["records"]):
            total[0][at] += o
            total[1][at] += r
            seen[at] = True
    ids = np.flatnonzero(seen)
    yield pd.DataFrame({"id": key[0] * BLOCK + ids, "occurrences": total[0][ids], "records": total[1][ids]})


def term_statistics(rows: DataFrame, term: str, record: str, weight: str | None = None, few: int = 2, common: tuple[int, int] = (40, 100), records: int | None = None) -> DataFrame:
    """(term, id, occurrences, records, mark) of every distinct term.

    ``occurrences`` sums the weight (or rows; a null weight adds 0), ``records`` counts the distinct non-null records with the
    term. ``mark`` is ``rare`` for terms in at most ``few`` records, ``common`` for those in at least the share ``common``
    (numerator, denominator) of ``records`` (by default the distinct records of ``rows``), ``rare and common`` if both hold,
    else null. Null terms are left out; an empty text is a term.

    Rows are reduced to one per term and record before anything else moves, so a hot term or record is no hot group.
    Encoded rows move by identifier range, a range's rows in pieces by their record, one for each PIECE_RECORDS records; each task adds the blocks of its ranges in arrays,
    and the arrays of a block are summed.
    """
    base = rows.select(F.col(term).alias("term"), F.col(record).alias("record"), (F.lit(1) if weight is None else F.coalesce(F.col(weight), F.lit(0))).cast("bigint").alias("weight"))
    if records is None:
        records = base.select("record").where("record is not null").distinct().count()
    pairs = base.where("term is not null").groupBy("term", "record").agg(F.sum("weight").alias("weight"))
    pairs = written(pairs, "pairs")
    words = dictionary(pairs, "term")
    piece = F.pmod(F.xxhash64("record"), F.lit(-(-max(1, records) // PIECE_RECORDS)))
    encoded = pairs.join(words, "term").select("id", "weight", F.col("record").isNotNull().cast("bigint").alias("present"), piece.alias("piece"))
    ranges = encoded.repartition(F.floor(F.col("id") / BLOCK), "piece").drop("piece")
    blocks = ranges.mapInPandas(_blocks, "block bigint, places array<bigint>, occurrences array<bigint>, records array<bigint>")
    counts = blocks.groupBy("block").applyInPandas(_summed, "id bigint, occurrences bigint, records bigint")
    rare = F.coalesce("records", F.lit(0)) <= few
    often = F.coalesce("records", F.lit(0)) * common[1] >= F.lit(records) * common[0]
    out = words.join(counts, "id", "left").select("term", "id", F.coalesce("occurrences", F.lit(0)).alias("occurrences"), F.coalesce("records", F.lit(0)).alias("records"))
    mark = F.when(rare & often, "rare and common").when(rare, "rare").when(often, "common")
    return out.withColumn("mark", mark)
