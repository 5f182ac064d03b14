"""Readers, sinks, names and the stream on small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from strandloom import cli
from strandloom.functions import names as fn
from strandloom.functions.kmer import decode
from strandloom.operators.counting import count_kmers, count_status
from strandloom.operators.features import kmer_features
from strandloom.operators.metadata import kmer_stats, metadata_document
from strandloom.sources import fasta_source, readers, sinks
from strandloom.streaming import counts as stream

FASTA = ">c1 first > one\r\nacgt\r\nAC GT\r\n>c2\r\n>c3\nNNN"


def test_fasta(spark, tmp_path):
    (tmp_path / "G_1.fa").write_text(FASTA)
    with gzip.open(tmp_path / "G_2.fna.gz", "wt") as f:
        f.write(FASTA)
    rows = readers.read_fasta(spark, [str(tmp_path / "G_1.fa"), str(tmp_path / "G_2.fna.gz")]).collect()
    want = {("c1", "ACGTACGT"), ("c2", ""), ("c3", "NNN")}
    for organism in ("G_1", "G_2"):
        assert {(r.contig_id, r.seq) for r in rows if r.organism_id == organism} == want
    fasta_source.register(spark)
    ordered = spark.read.format("fasta_ordered").load(str(tmp_path)).orderBy("organism_id", "contig_ord").collect()
    assert [(r.organism_id, r.contig_ord, r.contig_id, r.seq) for r in ordered[:3]] == [("G_1", 0, "c1", "ACGTACGT"), ("G_1", 1, "c2", ""), ("G_1", 2, "c3", "NNN")]
    assert len(ordered) == 6
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "G_1.fasta").write_text(FASTA)
    with pytest.raises(ValueError):
        readers.read_fasta(spark, [str(tmp_path / "G_1.fa"), str(tmp_path / "sub" / "G_1.fasta")])


def test_fasta_upper(spark):
    df = spark.createDataFrame([(">aC",), ("acgn",)], "value string")
    assert [r.value for r in readers.fasta_upper(df).collect()] == [">aC", "ACGN"]


def test_kmer_text(spark, tmp_path):
    d = tmp_path / "ORG"
    d.mkdir()
    (d / "k4.txt").write_text("kmer\tcount\n0001\t5\nACGT\t2\n")
    (d / "k5.txt").write_text("")
    (d / "other.txt").write_text("0001\t5\n")
    with gzip.open(d / "k6.txt.gz", "wt") as f:
        f.write("000123\t7\n")
    got = {tuple(r) for r in readers.read_kmer_text(spark, str(d)).collect()}
    assert got == {("ORG", 4, "0001", 5), ("ORG", 4, "ACGT", 2), ("ORG", 6, "000123", 7)}


@pytest.mark.parametrize("compress", [False, True])
def test_kmer_round_trip(spark, tmp_path, compress):
    rows = [("o", 4, "AAAC", 3), ("o", 4, "ACGT", 1), ("GCF_1_2 +x=%", 5, "AAAAA", 2), ("o", 5, "CCCCC", 9)]
    counts = spark.createDataFrame(rows, "organism_id string, k int, kmer string, cnt bigint")
    sinks.write_kmer_text(counts, str(tmp_path / "t"), compress)
    end = ".gz" if compress else ""
    assert (tmp_path / "t" / "o" / f"k4.txt{end}").exists() and (tmp_path / "t" / "GCF_1_2 +x=%" / f"k5.txt{end}").exists()
    assert {r.value for r in spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "t")).collect()} == {"0002\t3", "0231\t1", "00000\t2", "22222\t9"}
    back = readers.read_kmer_text(spark, str(tmp_path / "t"))
    assert {(r.organism_id, r.k, r.kmer, r["count"]) for r in back.withColumn("kmer", decode(F.col("kmer"))).collect()} == set(rows)
    sinks.write_counts(counts, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).where("k = 4").count() == 2
    with pytest.raises(ValueError):
        sinks.write_kmer_text(counts.withColumn("organism_id", F.lit(None).cast("string")), str(tmp_path / "n"))


def test_feature_csv(spark, tmp_path):
    counts = spark.createDataFrame([("org1", 4, "ACGT", 1), ("org2", 4, "AAAA", 2)], "organism_id string, k int, kmer string, cnt bigint")
    wanted = kmer_features(counts, "basic")
    sinks.write_feature_csv(wanted, str(tmp_path / "f"))
    assert (tmp_path / "f" / "org1_kmer_features.csv").exists()
    (tmp_path / "f" / "no_metric_kmer_features.csv").write_text("kmer,count\nACGT,1\n")
    (tmp_path / "f" / "no_kmer.csv").write_text("gc_percent\n1\n")
    (tmp_path / "f" / "quoted.csv").write_text('count,"kmer",gc_percent,note\n7,"ACGA",50.0,"a,b"\nx\n')
    (tmp_path / "f" / "empty.csv").write_text("")
    back = readers.read_feature_csv(spark, str(tmp_path / "f"), "gc_percent")
    names = wanted.columns
    assert {tuple(r[c] for c in names) for r in back.where("organism_id like 'org%'").collect()} == {tuple(r) for r in wanted.collect()}
    assert {(r.organism_id, r.kmer, r["count"]) for r in back.where("organism_id not like 'org%'").collect()} == {("quoted", "ACGA", 7), ("quoted", None, None)}
    assert back.where("has_repeat is not null").count() == 0
    with pytest.raises(ValueError):
        readers.read_feature_csv(spark, str(tmp_path / "f"), "colour")


@pytest.mark.parametrize("one", [False, True])
def test_metadata_round_trip(spark, tmp_path, one):
    genomes = spark.createDataFrame([(f"g{i}", f"/x/g{i}.fa", i, 10 * i, 50.0, 0) for i in range(1, 4)], "genome_id string, file_path string, contigs bigint, total_size bigint, gc_content double, n_count bigint")
    genomes = genomes.withColumn("last_updated", F.to_timestamp(F.lit("2024-01-02 03:04:05")))
    counts = spark.createDataFrame([("g1", 8, "A" * 8, 3, "p"), ("g1", 9, "A" * 9, 4, "q"), ("g3", 8, "C" * 8, 1, "r")], "organism_id string, k int, kmer string, cnt bigint, file_path string")
    stats = kmer_stats(counts)
    path = str(tmp_path / "m")
    sinks.write_metadata_json(metadata_document(genomes, stats).coalesce(1), path, one_document=one)
    if one:
        text = "".join(f.read_text() for f in (tmp_path / "m").glob("part-*"))
        assert list(json.loads(text)) == ["g1", "g2", "g3"] and json.loads(text)["g1"]["kmers"]["9"]["file_path"] == "q"
    back, summaries = readers.read_metadata_json(spark, path)
    assert {tuple(r[c] for c in genomes.columns) for r in back.collect()} == {tuple(r) for r in genomes.collect()}
    assert {tuple(r[c] for c in stats.columns) for r in summaries.collect()} == {tuple(r) for r in stats.collect()}
    assert readers.genome_size(back, "g2") == 20 and readers.genome_size(back, "none") is None
    assert readers.available_genomes(back).count() == 3


def test_accessions(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n#x\nF_1\nGCF_1.1\nGCF_1.1\nGCA_2.1 GCF_3.1\n")
    assert {r.accession for r in readers.read_accessions(spark, str(tmp_path / "a.txt")).collect()} == {"GCF_1.1", "GCA_2.1", "GCF_3.1"}
    (tmp_path / "a.tsv").write_text("Name\tAssembly Accession\nx\t GCF_1.1 \ny\tF_2\nz\n")
    path = str(tmp_path / "a.tsv")
    assert sorted(r.accession for r in readers.read_accessions(spark, path).collect()) == ["F_2", "GCF_1.1"]
    assert sorted(r.accession for r in readers.read_accessions(spark, path, "Name").collect()) == ["x", "y", "z"]
    assert sorted(r.accession for r in readers.read_accessions(spark, path, 0).collect()) == ["x", "y", "z"]
    for bad in (("a.xml", None), ("a.tsv", "Nothing")):
        with pytest.raises(ValueError):
            readers.read_accessions(spark, str(tmp_path / bad[0]), bad[1])


def test_metadata_json(spark, tmp_path):
    doc = {"g": {"file_path": "f", "last_updated": "2024-01-02 03:04:05", "contigs": 1, "total_size": 4, "gc_content": 50.0, "n_count": 0, "kmers": {"8": {"k_value": 8, "total_kmers": 3}}}, "h": {"kmers": {}}}
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=2))
    genomes, kmers = readers.read_metadata_json(spark, str(tmp_path / "m.json"))
    assert {r.genome_id: r.total_size for r in genomes.collect()} == {"g": 4, "h": None}
    assert [(r.organism_id, r.k_value, r.total_kmers) for r in kmers.collect()] == [("g", 8, 3)]
    lines = [json.loads(r.value) for r in sinks.metadata_json(metadata_document(genomes, kmers)).collect()]
    assert {k for x in lines for k in x} == {"g", "h"}
    assert next(x for x in lines if "g" in x)["g"]["last_updated"] == "2024-01-02 03:04:05"
    for text in (None, "{broken"):
        if text:
            (tmp_path / "b.json").write_text(text)
        genomes, kmers = readers.read_metadata_json(spark, str(tmp_path / "b.json"))
        assert genomes.count() == kmers.count() == 0


def test_find_files(spark, tmp_path):
    for f in ("a.fa", "b.fasta", "c.txt"):
        (tmp_path / f).write_text("x")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "e.fa").write_text("x")
    name = lambda df: [r.file_path.rsplit("/", 1)[-1] for r in df.collect()]
    assert name(readers.find_files(spark, str(tmp_path), ["*.fa", "*.fasta", "a*"])) == ["a.fa", "b.fasta"]
    assert name(readers.find_files(spark, str(tmp_path), ["*.fa"], recursive=True)) == ["a.fa", "e.fa"]


def test_names(spark):
    df = spark.createDataFrame([("d/GCF_1_2/k10.txt.gz", "GCF_1_2_kmer_features.csv", "x/yeast_kmer_features.csv")], "a string, b string, c string")
    row = df.select(fn.k_of_file(F.col("a")), fn.parent_name(F.col("a")), fn.organism_of_feature_file(F.col("b")), fn.organism_of_feature_file(F.col("c")), fn.accession_file_name(F.lit("GCF_1.2"))).first()
    assert tuple(row) == (10, "GCF_1_2", "GCF_1", "yeast_kmer", "GCF_1_2")
    url = df.select(fn.download_url(F.lit(""), F.lit("ftp://h/x_y")), fn.download_url(F.lit(""), F.lit("")), fn.is_email(F.lit("a@b.c")), fn.is_email(F.lit("a@b")), fn.is_tool_name(F.lit("a-b"))).first()
    assert tuple(url) == ("https://h/x_y/x_y_genomic.fna.gz", None, True, False, True)


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("o", "ACGTACGTACGT"), ("p", "ACGTAAAA"), ("o", "GGGG")], "organism_id string, seq string")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    reader = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1)
    stream.append_counts(reader.parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), [3]).awaitTermination()
    got = {tuple(r) for r in stream.current_counts(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == {tuple(r) for r in count_kmers(rows, [3]).collect()}


def test_broken_file_costs_no_other_organism(spark, tmp_path):
    (tmp_path / "G_1.fa").write_text(">a\nACGTACGT\n")
    (tmp_path / "G_2.fa.gz").write_bytes(gzip.compress(b">a\nACGT\n" * 1000)[:-20])
    (tmp_path / "G_3.fna").write_text(">a\nNN\n")
    fasta_source.register(spark)
    contigs = spark.read.format("fasta_ordered").option("errors", "keep").load(str(tmp_path))
    status = {r.organism_id: r.status for r in count_status(contigs, count_kmers(contigs, [4])).collect()}
    assert status["G_1"] == "ok" and status["G_3"] == "no k-mers" and status["G_2"].startswith("failed: ")


def test_commands(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "G_1.fa").write_text(">a\nACGTACGTAC\n")
    at = lambda name: str(tmp_path / name)
    cli.main(["count", at("in"), at("counts"), "-k", "4", "5"], spark)
    cli.main(["features", at("counts"), at("features"), "--groups", "basic"], spark)
    cli.main(["metadata", at("in"), at("meta"), "--counts", at("counts"), "--one-document"], spark)
    rows = readers.read_feature_csv(spark, at("features")).collect()
    assert {(r.organism_id, r.kmer, r["count"]) for r in rows if r.k == 4} == {("G_1", "ACGT", 2), ("G_1", "CGTA", 2), ("G_1", "GTAC", 2), ("G_1", "TACG", 1)}
    genomes, kmers = readers.read_metadata_json(spark, at("meta"))
    assert genomes.first().total_size == 10 and {(r.k_value, r.total_kmers) for r in kmers.collect()} == {(4, 7), (5, 6)}
