"""Attribute-value rows into wide tables, with the cells that cannot be filled rightly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Attributes of the k-mer feature rows with their types; the order is the position in the entity's array.
SPEC = {
    "kmer": "string", "k": "int", "count": "bigint", "gc_percent": "double", "a_count": "int", "c_count": "int", "g_count": "int",
    "t_count": "int", "cpg_count": "int", "has_repeat": "int", "genome_size": "bigint", "mask_score": "double", "reviewer_flag": "string",
    "note": "string",
}
UPPER = ("kmer",)
WHOLE = ("int", "bigint", "smallint", "tinyint")


#: More attributes than this are no columns of a wide table.
MOST_ATTRIBUTES = 2000


def discovered_spec(rows: DataFrame, spec: dict[str, str] = SPEC, attribute: str = "attribute", most: int = MOST_ATTRIBUTES) -> dict[str, str]:
    """``spec`` and, after it in order of name, the other attributes that occur, as strings; more than ``most`` raise ValueError."""
    name = F.nullif(F.lower(F.trim(attribute)), F.lit("")).alias("a")
    found = rows.select(name).where("a is not null").distinct().where(~F.col("a").isin(list(spec))).limit(most + 1).collect()
    if len(spec) + len(found) > most:
        raise ValueError(f"more than {most} attributes; keep them as rows")
    return spec | {r.a: "string" for r in sorted(found)}


def typed_text(value: Column, kind: str, upper: bool = False) -> Column:
    """A value in the one spelling of its typed form, or null if it does not fit the type."""
    if kind in WHOLE:
        return F.when(value.rlike(r"^[+-]?[0-9]+\z"), value.try_cast(kind)).cast("string")
    if kind == "string":
        return F.upper(value) if upper else value
    return value.try_cast(kind).cast("string")


def entity_cells(rows: DataFrame, spec: dict[str, str] = SPEC, entity: str = "entity_id", attribute: str = "attribute", value: str = "attr_value", upper=UPPER) -> DataFrame:
    """The completed grid, one row per entity: ``cells``, an array by attribute position of (low, high, bad, given).

    ``low`` and ``high`` are the smallest and largest spelling of the values that fit, ``bad`` one that does not, ``given``
    how many values there were. Attribute names ignore case and spaces around; values lose spaces around, and null or
    empty ones are absent. Rows of one cell are pre-aggregated before they shuffle, so a hot entity or attribute costs no
    task more than a cell's row for each input task. The grid comes from the entities and the positions of ``spec``
    (exploded for each entity), joined to the cells on the left, so an entity with only absent or unknown attributes
    keeps its row. Rows with a null entity belong to none and are left out.
    """
    names = list(spec)
    position = F.array_position(F.array(*map(F.lit, names)), F.lower(F.trim(attribute))).cast("int") - 1
    text = F.nullif(F.trim(value), F.lit(""))
    base = rows.where(F.col(entity).isNotNull()).select(F.col(entity).alias("_e"), position.alias("_p"), text.alias("_v"))
    kinds: dict[tuple[str, bool], list[int]] = {}  # one branch for each type, however many attributes there are
    for i, n in enumerate(names):
        kinds.setdefault((spec[n], n in upper), []).append(i)
    typed = F.coalesce(*[F.when(F.col("_p").isin(at), typed_text(F.col("_v"), kind, up)) for (kind, up), at in kinds.items()])
    base = base.withColumn("_t", typed)
    cells = base.where("_p >= 0 and _v is not null").groupBy("_e", "_p").agg(
        F.min("_t").alias("low"), F.max("_t").alias("high"), F.min(F.when(F.col("_t").isNull(), F.col("_v"))).alias("bad"), F.count(F.lit(1)).alias("given")
    )
    grid = base.select("_e").distinct().select("_e", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("_p"))
    full = grid.join(cells, ["_e", "_p"], "left").groupBy("_e").agg(
        F.array_sort(F.collect_list(F.struct("_p", "low", "high", "bad", "given"))).alias("cells")
    )
    return full.select(F.col("_e").alias(entity), "cells")


def wide_entities(cells: DataFrame, spec: dict[str, str] = SPEC, entity: str = "entity_id") -> DataFrame:
    """One row per entity with a typed column per attribute; a cell with contradicting values, or none that fits, is null.

    A value that does not fit next to one that does leaves the cell filled with the one that fits; ``failed_cells`` names both.
    """
    out = []
    for i, (name, kind) in enumerate(spec.items()):
        c = F.col("cells")[i]
        out.append(F.when(c.low == c.high, c.low).try_cast(kind).alias(name if name != entity else f"{name}_"))
    return cells.select(entity, *out)


def failed_cells(cells: DataFrame, spec: dict[str, str] = SPEC, entity: str = "entity_id") -> DataFrame:
    """(entity, attribute, reason, example) of each cell that cannot be filled rightly: a value of another type, or two different values."""
    named = F.array(*map(F.lit, spec))
    rows = cells.select(entity, F.explode("cells").alias("c"))
    reason = F.when(F.col("c.bad").isNotNull(), "does not fit the type").when(F.col("c.low") != F.col("c.high"), "contradicting values")
    return rows.select(entity, F.element_at(named, F.col("c._p") + 1).alias("attribute"), reason.alias("reason"), F.coalesce("c.bad", "c.high").alias("example")).where("reason is not null")
