"""Golden and property cases of counting, codes and features."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import kmer as fk
from strandloom.operators import counting, features


def contigs(spark, *rows):
    return spark.createDataFrame([(o, str(i), s) for i, (o, s) in enumerate(rows)], "organism_id string, contig_id string, seq string")


def counted(df):
    return {(r.organism_id, r.k, r.kmer): r.cnt for r in df.collect()}


def brute(rows, ks):
    out = {}
    for o, s in rows:
        if s is None or len(s) < max(ks):
            continue
        s = s.upper()
        for k in ks:
            for i in range(len(s) - k + 1):
                w = s[i : i + k]
                if set(w) <= set("ACGT"):
                    out[o, k, w] = out.get((o, k, w), 0) + 1
    return out


def test_golden_counts(spark):
    got = counted(counting.count_kmers(contigs(spark, ("x", "ACGTACGNACGT")), [2, 3]))
    assert got == {("x", 2, "AC"): 3, ("x", 2, "CG"): 3, ("x", 2, "GT"): 2, ("x", 2, "TA"): 1, ("x", 3, "ACG"): 3, ("x", 3, "CGT"): 2, ("x", 3, "GTA"): 1, ("x", 3, "TAC"): 1}


def test_short_contig_gives_nothing_for_any_k(spark):
    got = counted(counting.count_kmers(contigs(spark, ("x", "ACGTAC"), ("x", "ACG")), [2, 4]))
    assert got == brute([("x", "ACGTAC")], [2, 4])


def test_windows_do_not_cross_contigs(spark):
    assert counted(counting.count_kmers(contigs(spark, ("x", "AC"), ("x", "gt")), [2])) == {("x", 2, "AC"): 1, ("x", 2, "GT"): 1}


def test_too_short_null_and_empty(spark):
    assert counted(counting.count_kmers(contigs(spark, ("x", "AC"), ("x", None), ("x", "")), [2, 3])) == {}
    assert counted(counting.count_kmers(contigs(spark, ("x", "A")).limit(0), [1])) == {}


def test_symbols_outside_ascii_spoil_only_their_own_windows(spark):
    rows = [("x", "ACGTé" * 9 + "ACGTACGT"), ("y", "ßACGTTT\u4e16ACG\U0001f9ecTTAC"), ("z", "acgtaﬁcgta")]
    want = brute([(o, "".join(c if c.isascii() else "N" for c in s)) for o, s in rows], [2, 4])
    for chunk in (1, 3, 5, 2048):
        assert counted(counting.count_kmers(contigs(spark, *rows), [2, 4], chunk)) == want
    kept = counting.kmer_windows(contigs(spark, *rows), [4], 3, keep_ambiguous=True)
    assert kept.count() == sum(len(s) - 3 for _, s in rows)


def test_chunks_dealt_out_over_tasks_change_nothing(spark):
    rows = [("x", "ACGTTGCA" * 200), ("y", "GATTACA" * 3)]
    dealt = counting.count_kmers(contigs(spark, *rows), [3, 8], 64, tasks=3)
    assert counted(dealt) == brute(rows, [3, 8])


@pytest.mark.parametrize("chunk", [1, 7, 64, 2048])
def test_chunks_change_nothing(spark, chunk):
    rnd = random.Random(3)
    rows = [(f"o{i % 3}", "".join(rnd.choice("ACGTacgtN") for _ in range(rnd.choice([0, 5, 12, 13, 64, 65, 300])))) for i in range(30)]
    assert counted(counting.count_kmers(contigs(spark, *rows), [3, 8, 12], chunk)) == brute(rows, [3, 8, 12])


def test_bad_ks(spark):
    for ks in ([], [0], [-1, 3]):
        with pytest.raises(ValueError):
            counting.count_kmers(contigs(spark, ("x", "ACGT")), ks)


def test_codes(spark):
    df = spark.createDataFrame([("ACGT", "0231"), ("AANT", "9")], "a string, b string")
    rows = df.select(fk.encode(F.col("a")), fk.decode(F.col("b")), fk.decode(F.col("a"))).collect()
    assert [tuple(r) for r in rows] == [("0231", "ACGT", "ACGT"), ("00X1", "N", "AANT")]
    rows = df.limit(1).select(fk.legacy_roundtrip(F.lit("AACT")), fk.rank4(F.lit("ACGT")), fk.read_kmer(F.lit("aC3t"), F.lit(4)), fk.read_kmer(F.lit("ACG"), F.lit(4)), fk.read_kmer(F.lit("ACGN"), F.lit(4))).first()
    assert tuple(rows) == ("CT", 27, "ACGT", None, None)


def test_features_golden(spark):
    counts = spark.createDataFrame([("x", 4, k, 1) for k in ("CGCG", "AAAA", "ACGT")], "organism_id string, k int, kmer string, cnt bigint")
    got = {r.kmer: r for r in features.kmer_features(counts).collect()}
    r = got["CGCG"]
    assert (r.gc_percent, r.A_count, r.C_count, r.cpg_count, round(r.cpg_obs_exp, 4), r.shannon_entropy, r.normalized_entropy, r.has_repeat) == (100, 0, 2, 2, 2.6667, 1, 0.5, 1)
    r = got["AAAA"]
    assert (r.gc_percent, r.cpg_obs_exp, r.shannon_entropy, r.has_repeat, r.A_present, r.C_present) == (0, 0, 0, 1, 1, 0)
    r = got["ACGT"]
    assert (r.gc_percent, round(r.cpg_obs_exp, 4), r.shannon_entropy, r.has_repeat) == (50, 5.3333, 2, 0)


def test_repeat_and_base_sums_on_all_4mers(spark):
    kmers = ["".join(p) for p in itertools.product("ACGT", repeat=4)]
    counts = spark.createDataFrame([("x", 4, k, 1) for k in kmers], "organism_id string, k int, kmer string, cnt bigint")
    for r in features.kmer_features(counts).collect():
        assert r.has_repeat == int(r.kmer[:2] == r.kmer[2:])
        assert r.A_count + r.C_count + r.G_count + r.T_count == 4


def test_feature_groups(spark):
    counts = spark.createDataFrame([("x", 4, "ACGT", 1)], "organism_id string, k int, kmer string, cnt bigint")
    assert features.kmer_features(counts, "basic").columns == ["organism_id", "kmer", "count", "k", "gc_percent", "A_count", "C_count", "G_count", "T_count"]
    assert "A_present" not in features.kmer_features(counts, "advanced").columns
    with pytest.raises(ValueError):
        features.kmer_features(counts, ["colour"])


def test_genome_size(spark):
    counts = spark.createDataFrame([(o, 4, "ACGT", 1) for o in "abc"], "organism_id string, k int, kmer string, cnt bigint")
    meta = spark.createDataFrame([("a", 10), ("b", 0)], "genome_id string, total_size bigint")
    assert {r.organism_id: r.genome_size for r in features.kmer_features(counts, "basic", meta).collect()} == {"a": 10, "b": None, "c": None}
