"""Attribute-value rows into wide tables."""

import pytest


from strandloom.operators import entities


def rows(spark, *cells):
    return spark.createDataFrame([(e, a, v, "x") for e, a, v in cells], "entity_id bigint, attribute string, attr_value string, cells string")


def run(spark, *cells):
    c = entities.entity_cells(rows(spark, *cells))
    wide = {r.entity_id: r.asDict() for r in entities.wide_entities(c).collect()}
    return wide, {(r.entity_id, r.attribute): r.reason for r in entities.failed_cells(c).collect()}


def test_types_spelling_and_faults(spark):
    wide, bad = run(
        spark, (1, " KMER ", "acgt"), (1, "kmer", "ACGT "), (1, "k", "+04"), (1, "K", "4"), (1, "Count", "7"), (1, "gc_percent", "50"), (1, "gc_percent", "50.0"),
        (2, "k", "4.0"), (2, "k", "4"), (2, "count", "1"), (2, "count", "2"), (2, "count", "2"), (3, "k", "3000000000"), (3, "count", "3000000000"), (4, "k", " "), (4, "k", None),
        (5, "colour", "red"), (6, None, "1"), (None, "k", "4"), (7, "kmer", "A"), (7, "kmer", "C"), (8, "count", "9" * 20), (8, "k", "-1"), (9, "k", "1 2"),
    )
    assert set(wide) == {1, 2, 3, 4, 5, 6, 7, 8, 9}
    assert [wide[1][c] for c in ("kmer", "k", "count", "gc_percent", "a_count")] == ["ACGT", 4, 7, 50.0, None]
    assert (wide[2]["k"], wide[2]["count"], wide[3]["count"], wide[4]["k"], wide[8]["k"]) == (4, None, 3000000000, None, -1)
    assert bad == {
        (2, "k"): "does not fit the type", (2, "count"): "contradicting values", (3, "k"): "does not fit the type", (7, "kmer"): "contradicting values",
        (8, "count"): "does not fit the type", (9, "k"): "does not fit the type",
    }


def test_empty_repeated_and_long(spark):
    c = entities.entity_cells(rows(spark, (1, "k", "1")).limit(0))
    assert entities.wide_entities(c).count() == entities.failed_cells(c).count() == 0
    wide, bad = run(spark, *[(1, "note", "n" * 100_000)] * 5)
    assert len(wide[1]["note"]) == 100_000 and not bad


def test_own_attributes_and_clashing_name(spark):
    spec = {"entity_id": "string", "size": "double"}
    c = entities.entity_cells(rows(spark, (1, "entity_id", "a"), (1, "size", "1e3")), spec)
    assert [tuple(r) for r in entities.wide_entities(c, spec).collect()] == [(1, "a", 1000.0)]


def test_discovered_attributes(spark):
    df = rows(spark, (1, " Colour", "red"), (1, "COLOUR", "red"), (2, "k", "3"), (2, None, "x"), (2, " ", "x"))
    spec = entities.discovered_spec(df)
    assert list(spec) == [*entities.SPEC, "colour"]
    wide = {r.entity_id: (r.colour, r.k) for r in entities.wide_entities(entities.entity_cells(df, spec), spec).collect()}
    assert wide == {1: ("red", None), 2: (None, 3)}
    two = rows(spark, (1, "colour", "red"), (1, "colour", "blue"))
    spec = entities.discovered_spec(two)
    assert {(r.entity_id, r.attribute) for r in entities.failed_cells(entities.entity_cells(two, spec), spec).collect()} == {(1, "colour")}
    with pytest.raises(ValueError):
        entities.discovered_spec(df, most=5)
