"""Rows that fail to parse: a quote-aware tokenizer over raw records, with typed rows or a reason and its place.

The tokenizer is a finite-state machine run over whole batches of records at once. The bytes are cut into chunks; for
each chunk the transition it makes from every state is found for all chunks together, the chunks' transitions are
composed along the buffer, and with its entry state known each chunk then gives the state after each of its bytes. A
record of any length is thus no special case; only the cutting of the found fields goes row by row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, PLAIN, QUOTED, CLOSED, BROKEN = range(5)
TAB, QUOTE, OTHER, END = range(4)
#: State after a byte of the class (column) in the state (row): START and PLAIN differ in what a quote means.
NEXT = np.array(
    [
        [START, QUOTED, PLAIN, START],
        [START, PLAIN, PLAIN, START],
        [QUOTED, CLOSED, QUOTED, START],
        [START, QUOTED, BROKEN, START],
        [BROKEN, BROKEN, BROKEN, START],
    ],
    dtype=np.uint8,
)
CHUNK = 128
HEADER = "Assembly Accession"
FIELDS = (
    "assembly_accession", "assembly_name", "organism_name", "organism_infraspecific_names_breed",
    "organism_infraspecific_names_strain", "organism_infraspecific_names_cultivar", "organism_infraspecific_names_ecotype",
    "organism_infraspecific_names_isolate", "organism_infraspecific_names_sex", "annotation_name", "assembly_level",
    "assembly_release_date", "wgs_project_accession", "assembly_stats_number_of_scaffolds",
)


def states_after(kinds: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """The state after each byte of a buffer of byte classes, from START, by composing chunk transitions."""
    n = len(kinds)
    if not n:
        return np.zeros(0, np.uint8)
    rows = -(-n // chunk)
    grid = np.full(rows * chunk, END, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(rows, chunk).T)
    maps = np.broadcast_to(np.arange(5, dtype=np.uint8), (rows, 5)).copy()
    for column in grid:
        maps = NEXT[maps, column[:, None]]
    step = 1  # inclusive prefix composition of the chunks' transitions, doubling the reach each time
    while step < rows:
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
        step *= 2
    state = np.concatenate([[START], maps[:-1, START]]).astype(np.uint8)
    out = np.empty((chunk, rows), np.uint8)
    for i, column in enumerate(grid):
        state = NEXT[state, column]
        out[i] = state
    return out.T.reshape(-1)[:n]


def tokenize(lines: Sequence[str], separator: bytes = b"\t") -> pd.DataFrame:
    """Of each line ``fields`` and their ``begins`` (None if the quoting breaks), ``reason`` and ``at``; places are byte offsets."""
    encoded = [x.encode("utf-8", "surrogatepass") for x in lines]
    if not encoded:
        return pd.DataFrame({"fields": [], "begins": [], "reason": [], "at": []})
    buffer = b"\n".join(encoded) + b"\n"
    data = np.frombuffer(buffer, np.uint8)
    ends = np.cumsum([len(x) + 1 for x in encoded]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    kinds = np.full(len(data), OTHER, np.uint8)
    kinds[data == separator[0]] = TAB
    kinds[data == ord('"')] = QUOTE
    kinds[ends] = END
    after = states_after(kinds)
    before = np.concatenate([[START], after[:-1]])
    line_of = lambda at: np.searchsorted(ends, at)
    broken_at = np.full(len(encoded), -1)
    reason = np.array([None] * len(encoded), object)
    bad = np.flatnonzero((after == BROKEN) & (before != BROKEN))
    broken_at[line_of(bad)] = bad - starts[line_of(bad)]
    reason[line_of(bad)] = "text after closing quote"
    open_end = np.flatnonzero(before[ends] == QUOTED)
    opened = np.flatnonzero((after == QUOTED) & (before == START) & (kinds == QUOTE))
    last_open = opened[np.searchsorted(opened, ends[open_end]) - 1] if len(opened) else opened
    broken_at[open_end] = last_open - starts[open_end]
    reason[open_end] = "unclosed quote"
    parts = np.flatnonzero((kinds == TAB) & (after == START) & (before != BROKEN))
    cuts: list = [None] * len(encoded)
    begins: list = [None] * len(encoded)
    which = line_of(parts)
    bounds = np.searchsorted(which, np.arange(len(encoded) + 1))
    for i, line in enumerate(encoded):
        if reason[i] is None:
            edges = [-1, *(parts[bounds[i] : bounds[i + 1]] - starts[i]).tolist(), len(line)]
            begins[i] = [a + 1 for a in edges[:-1]]
            cells = [line[a + 1 : b] for a, b in zip(edges, edges[1:])]
            cuts[i] = [(c[1:-1].replace(b'""', b'"') if c[:1] == b'"' else c).decode("utf-8", "replace") for c in cells]
    return pd.DataFrame({"fields": cuts, "begins": begins, "reason": reason, "at": broken_at})


def tokenized(lines: Column) -> Column:
    """struct<fields, begins, reason, at> of each line; a final carriage return is no part of it, null gives nulls."""

    @F.pandas_udf("struct<fields: array<string>, begins: array<bigint>, reason: string, at: bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for lines in batches:
            out = tokenize([x.removesuffix("\r") if isinstance(x, str) else "" for x in lines])
            out.loc[lines.isna().to_numpy(), "fields"] = None
            yield out

    return run(lines)


def read_records(raw: DataFrame, line: str = "line", fields: Sequence[str] = FIELDS, header: str = HEADER) -> DataFrame:
    """Each record of ``raw`` once, with all columns of ``raw`` and the struct ``record_``: fields, reason, at.

    Left out as no records: null lines, lines of white space only, and header lines (first field ``header``, perhaps after
    a byte-order mark). ``reason`` is null for a valid record, else the first of: ``unclosed quote``, ``text after closing
    quote``, ``wrong field count``, ``invalid accession``, ``invalid release date``. ``at`` is the byte offset in the line:
    of the quote, of the first byte after it, of the first field too many (the line's end if there are too few), or of the
    invalid field. Repeated lines are kept: a row is judged by itself.
    """
    rows = raw.where(F.col(line).isNotNull() & F.col(line).rlike(r"(?U)[^\s\p{Z}\x1c-\x1f\x85]")).withColumn("record_", tokenized(F.col(line)))
    f = F.col("record_.fields")
    first = F.coalesce(F.get(f, F.lit(0)), F.substring_index(line, "\t", 1))
    rows = rows.where(F.regexp_replace(first, "^\ufeff", "") != header)
    accession, date = (F.trim(F.get(f, F.lit(fields.index(n)))) for n in ("assembly_accession", "assembly_release_date"))
    day = date.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & ~date.startswith("0000") & date.try_cast("date").isNotNull()
    begin = lambda i: F.coalesce(F.get("record_.begins", F.lit(i)), F.octet_length(line).cast("bigint"))
    fault = F.col("record_.reason").isNotNull()
    count, no_accession, no_date = F.size(f) != len(fields), ~accession.rlike(r"^GC[FA]_[0-9]{9}\.[0-9]+\z"), ~((date == "") | day)
    reason = F.when(fault, F.col("record_.reason")).when(count, F.lit("wrong field count"))
    reason = reason.when(no_accession, F.lit("invalid accession")).when(no_date, F.lit("invalid release date"))
    at = F.when(fault, F.col("record_.at")).when(count, begin(len(fields))).when(no_accession, begin(fields.index("assembly_accession")))
    at = at.when(no_date, begin(fields.index("assembly_release_date")))
    return rows.withColumn("record_", F.struct(f.alias("fields"), reason.alias("reason"), at.alias("at")))


def valid_rows(records: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """The loaded rows: raw columns whose names do not clash, and the typed fields (trimmed, empty as null, the date as DATE).

    A scaffold number that is no whole number does not make a record fail; it is null in its typed column, and its text stays in
    ``assembly_stats_number_of_scaffolds_text``, null wherever the number was read.
    """
    cells = {c: F.nullif(F.trim(F.col("record_.fields")[i]), F.lit("")) for i, c in enumerate(fields)}
    cells["assembly_release_date"] = cells["assembly_release_date"].cast("date")
    scaffolds = cells["assembly_stats_number_of_scaffolds"]
    cells["assembly_stats_number_of_scaffolds"] = scaffolds.try_cast("bigint")
    cells["assembly_stats_number_of_scaffolds_text"] = F.when(scaffolds.try_cast("bigint").isNull(), scaffolds)
    keep = [c for c in records.columns if c != "record_" and c.lower() not in cells]
    return records.where("record_.reason is null").select(*[F.col(f"`{c}`") for c in keep], *[v.alias(c) for c, v in cells.items()])


def failed_rows(records: DataFrame) -> DataFrame:
    """The rejected rows: the raw columns, ``error_reason`` and ``error_at``."""
    keep = [F.col(f"`{c}`") for c in records.columns if c not in ("record_", "error_reason", "error_at")]
    return records.where("record_.reason is not null").select(*keep, F.col("record_.reason").alias("error_reason"), F.col("record_.at").alias("error_at"))
