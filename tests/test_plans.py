"""The physical plans that the operators are meant to give."""

import os

import pytest

from strandloom.operators import counting, entities, features
from strandloom.plans import core_queries
from strandloom.plans.tables import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_do_not_shuffle(spark):
    counts = spark.createDataFrame([("x", 4, "ACGT", 1)], "organism_id string, k int, kmer string, cnt bigint")
    text = plan(features.kmer_features(counts))
    assert "Exchange" not in text and "Python" not in text


def test_features_are_a_projection_above_aggregated_counts(spark):
    text = plan(core_queries.feat_all(spark, SF))
    entropy = [line for line in text.splitlines() if "LOG2" in line.upper()]
    assert entropy and all("Project" in line for line in entropy)


def test_counting_shuffles_once_after_partial_counts(spark):
    contigs = spark.createDataFrame([("x", "ACGT")], "organism_id string, seq string")
    text = plan(counting.count_kmers(contigs, [2, 3]))
    assert text.count("Exchange") == 1 and "partial_count" in text and "Python" not in text


def test_scans_are_pruned_and_filtered(spark):
    text = plan(core_queries.k_from_filename(spark, SF))
    assert "ReadSchema: struct<file_path:string>" in text and "IsNotNull(file_path)" in text


def test_cells_are_reduced_before_they_shuffle(spark):
    text = plan(entities.entity_cells(table(spark, SF, "feature_attributes")))
    assert "partial_min" in text and "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("name", ["p1_found", "p4_found", "kmer_count", "close_pairs", "meta_full"])
def test_no_cross_joins(spark, name):
    text = plan(core_queries.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
