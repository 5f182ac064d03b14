"""Registered queries of the k-mer operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kmer as fk
from ..functions import names as fn
from ..operators import counting, entities, features, matrix, metadata, ml, records
from ..sources import readers
from .tables import FEATURES, LOADED, READ, VALID, contigs, contigs_sql, counts_sql, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
KS = counting.DEFAULT_KS


def query(sql: str | None = None):
    """Registers a function by its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _loaded(spark, d):
    return counting.readable_counts(table(spark, d, "kmer_counts"))


def _rows(spark, d):
    """Readable rows of kmer_features with letters."""
    rows = table(spark, d, "kmer_features").where(fk.is_kmer(F.col("kmer"), F.col("k"))).withColumn("kmer", fk.letters(F.col("kmer")))
    return rows.select("organism_id", "kmer", "k", "count", "gc_percent")


# --- counting -------------------------------------------------------------------------------------------------------


@query(counts_sql(KS) + " select * from counts")
def kmer_count(spark, d):
    return counting.count_kmers(contigs(spark, d), KS)


@query(counts_sql([8], "orders") + " select * from counts")
def kmer_count_single_k(spark, d):
    return counting.count_kmers(contigs(spark, d, "orders"), [8])


@query(counts_sql(KS) + " select k, sum(cnt)::bigint total_kmers, count(*) kmer_rows, count(distinct organism_id) organisms from counts group by k")
def kmer_total_by_k(spark, d):
    counts = counting.count_kmers(contigs(spark, d), KS)
    return counts.groupBy("k").agg(F.sum("cnt").alias("total_kmers"), F.count(F.lit(1)).alias("kmer_rows"), F.countDistinct("organism_id").alias("organisms"))


@query(f"with c as ({contigs_sql()}) select organism_id, count(*) short_contigs, sum(length(seq))::bigint short_size from c where length(seq) < 12 group by 1")
def short_contigs(spark, d):
    short = contigs(spark, d).where(F.length("seq") < max(KS))
    return short.groupBy("organism_id").agg(F.count(F.lit(1)).alias("short_contigs"), F.sum(F.length("seq").cast("bigint")).alias("short_size"))


@query(f"with c as ({contigs_sql()}), w as (select organism_id, substr(seq, unnest(range(1, length(seq) - 6))::int, 8) kmer from c where length(seq) >= 8) select organism_id, count(*) ambiguous from w where kmer like '%N%' group by 1")
def ambiguous_windows(spark, d):
    windows = counting.kmer_windows(contigs(spark, d), [8], keep_ambiguous=True)
    return windows.where(~fk.only_bases(F.col("kmer"))).groupBy("organism_id").agg(F.count(F.lit(1)).alias("ambiguous"))


@query(counts_sql([10]) + f", o as (select distinct organism_id from ({contigs_sql()})), g as (select organism_id, sum(cnt)::bigint total_kmers from counts group by 1) select o.organism_id, total_kmers, case when total_kmers > 0 then 'ok' else 'no k-mers' end status from o left join g using (organism_id)")
def count_status(spark, d):
    c = contigs(spark, d)
    return counting.count_status(c, counting.count_kmers(c, [10]))


@query(f"with {LOADED} select * from counts")
def readable_counts(spark, d):
    return _loaded(spark, d)


# --- k-mer codes and features ---------------------------------------------------------------------------------------


@query(f"with {LOADED} select k, kmer, translate(kmer, 'ATCG', '0123') code from (select distinct k, kmer from counts)")
def kmer_encode(spark, d):
    return _loaded(spark, d).select("k", "kmer").distinct().withColumn("code", fk.encode(F.col("kmer")))


@query("select distinct k, kmer, case when regexp_full_match(kmer, '[0-9]+') then translate(kmer, '0123456789', 'ATCGNNNNNN') else kmer end decoded from kmer_counts")
def kmer_decode(spark, d):
    return table(spark, d, "kmer_counts").select("k", "kmer").distinct().withColumn("decoded", fk.decode(F.col("kmer")))


@query(f"with {LOADED} select k, kmer, translate(translate(kmer, 'ATCG', '0123')::bigint::varchar, '0123', 'ATCG') kept from (select distinct k, kmer from counts)")
def kmer_legacy_roundtrip(spark, d):
    return _loaded(spark, d).select("k", "kmer").distinct().withColumn("kept", fk.legacy_roundtrip(F.col("kmer")))


def _n(base: str) -> str:
    return f"(length(kmer) - length(replace(kmer, '{base}', '')))"


def _term(base: str) -> str:
    return f"case when {_n(base)} > 0 then ({_n(base)} / length(kmer)) * log2({_n(base)} / length(kmer)) else 0 end"


GC = f"round(({_n('G')} + {_n('C')}) * 100.0::double / length(kmer), 9) gc_percent"
COUNTS = ", ".join(f"{_n(b)}::int {b}_count" for b in "ACGT")
PRESENT = ", ".join(f"(contains(kmer, '{b}'))::int {b}_present" for b in "ACGT")
CPG = f"(len(string_split(kmer, 'CG')) - 1)::int cpg_count, round(case when {_n('C')} * {_n('G')} > 0 then (len(string_split(kmer, 'CG')) - 1) / (({_n('C')} / length(kmer)) * ({_n('G')} / length(kmer)) * (length(kmer) - 1)) else 0.0 end, 9) cpg_obs_exp"
ENTROPY = f"round(0 - ({' + '.join(map(_term, 'ACGT'))}), 9) shannon_entropy, round((0 - ({' + '.join(map(_term, 'ACGT'))})) / 2, 9) normalized_entropy"
REPEAT = "(len(list_filter(range(1, length(kmer) - 2), lambda i: substr(kmer, i::int, 2) = substr(kmer, i::int + 2, 2))) > 0)::int has_repeat"


def _rounded(df):
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _features(spark, d, groups):
    return _rounded(features.kmer_features(_loaded(spark, d), groups))


def _sql_features(*parts: str) -> str:
    return f"with {LOADED} select organism_id, kmer, cnt \"count\", k, {', '.join(parts)} from counts"


@query(_sql_features(GC))
def feat_gc(spark, d):
    return _features(spark, d, ["gc_content"])


@query(_sql_features(COUNTS))
def feat_base_counts(spark, d):
    return _features(spark, d, ["base_counts"])


@query(_sql_features(PRESENT))
def feat_presence(spark, d):
    return _features(spark, d, ["presence"])


@query(_sql_features(CPG))
def feat_cpg(spark, d):
    return _features(spark, d, ["cpg_sites"])


@query(_sql_features(ENTROPY))
def feat_entropy(spark, d):
    return _features(spark, d, ["entropy"])


@query(_sql_features(REPEAT))
def feat_repeat(spark, d):
    return _features(spark, d, ["repeats"])


@query(_sql_features(GC, COUNTS, PRESENT, CPG, ENTROPY, REPEAT))
def feat_all(spark, d):
    return _features(spark, d, "all")


@query(_sql_features(GC, COUNTS))
def feat_basic(spark, d):
    return _features(spark, d, "basic")


@query(_sql_features(GC, COUNTS, CPG, ENTROPY, REPEAT))
def feat_advanced(spark, d):
    return _features(spark, d, "advanced")


LATEST = "meta as (select * from (select *, row_number() over (partition by genome_id order by last_updated desc nulls last, meta_id desc nulls last) rn from genome_metadata where genome_id is not null) where rn = 1)"


def _latest(spark, d):
    meta = table(spark, d, "genome_metadata").where("genome_id is not null")
    return metadata.latest_rows(meta, ["genome_id"], ["last_updated", "meta_id"])


@query(f"with {LOADED}, {LATEST} select c.organism_id, kmer, cnt \"count\", k, {GC}, nullif(total_size, 0) genome_size from counts c left join meta m on c.organism_id = m.genome_id")
def feat_genome_size(spark, d):
    return _rounded(features.kmer_features(_loaded(spark, d), ["gc_content"], _latest(spark, d)))


@query(_sql_features(GC) + " where k in (8, 12)")
def feat_k_filter(spark, d):
    return _rounded(features.kmer_features(_loaded(spark, d), ["gc_content"], ks=[8, 12]))


# --- metadata -------------------------------------------------------------------------------------------------------

GENOMES = f"genomes as (select organism_id genome_id, count(*) contigs, sum(length(seq))::bigint total_size, sum(length(seq) - length(translate(seq, 'GC', '')))::bigint gc, sum(length(seq) - length(replace(seq, 'N', '')))::bigint n_count from ({contigs_sql('orders')}) group by 1)"


@query(f"with {GENOMES} select genome_id, contigs, total_size, round(case when total_size > 0 then gc * 100.0::double / total_size else 0 end, 9) gc_content, n_count from genomes")
def genome_stats(spark, d):
    return _rounded(metadata.genome_stats(contigs(spark, d, "orders")))


STATS = "stats as (select organism_id, k k_value, sum(cnt)::bigint total_kmers, count(*) unique_kmers, max(cnt) max_count, min(cnt) min_count, round(avg(cnt), 6) mean_count, median(cnt)::double median_count, (sum(cnt) + k - 1)::bigint estimated_genome_size from counts group by 1, 2)"


@query(f"with {LOADED}, {STATS} select * from stats")
def kmer_stats(spark, d):
    return metadata.kmer_stats(_loaded(spark, d)).withColumn("mean_count", F.round("mean_count", 6))


@query(f"with {GENOMES} select genome_id, contigs, total_size, round(case when total_size > 0 then gc * 100.0::double / total_size else 0 end, 9) gc_content, n_count from genomes where genome_id not in (select concat('ORG_', n_nationkey) from nation where n_regionkey < 2)")
def genome_incremental(spark, d):
    """The genomes of the first two regions are known, those of the others are new."""
    known = table(spark, d, "nation").where("n_regionkey < 2").select(F.concat(F.lit("ORG_"), "n_nationkey").alias("genome_id"))
    todo = metadata.missing_rows(contigs(spark, d, "orders").withColumnRenamed("organism_id", "genome_id"), known, ["genome_id"])
    return _rounded(metadata.genome_stats(todo.withColumnRenamed("genome_id", "organism_id")))


@query(f"with {LOADED}, {STATS} select organism_id, k_value, total_kmers, unique_kmers from stats s where not exists (select 1 from genome_metadata m where m.genome_id = s.organism_id and m.k_value = s.k_value and m.total_kmers is not null)")
def kmer_incremental(spark, d):
    known = table(spark, d, "genome_metadata").where("total_kmers is not null").select(F.col("genome_id").alias("organism_id"), F.col("k_value").alias("k"))
    todo = metadata.missing_rows(_loaded(spark, d), known, ["organism_id", "k"])
    return metadata.kmer_stats(todo).select("organism_id", "k_value", "total_kmers", "unique_kmers")


@query(f"with {LOADED}, {STATS}, {LATEST}, ks as (select organism_id genome_id, string_agg(concat_ws(':', k_value, total_kmers, unique_kmers, max_count, min_count, round(mean_count * 1000000)::bigint, (median_count * 2)::bigint, estimated_genome_size), ',' order by k_value) kmers from stats where organism_id is not null group by 1) select coalesce(m.genome_id, ks.genome_id) genome_id, total_size, contigs, kmers from meta m full join ks on m.genome_id = ks.genome_id")
def meta_full(spark, d):
    stats = metadata.kmer_stats(_loaded(spark, d)).where("organism_id is not null")
    doc = metadata.metadata_document(_latest(spark, d).select("genome_id", "total_size", "contigs"), stats)
    whole = lambda x: F.round(x).cast("bigint").cast("string")
    cells = lambda s: [s[c].cast("string") for c in ("k_value", "total_kmers", "unique_kmers", "max_count", "min_count")]
    pairs = F.transform(F.array_sort(F.map_values("kmers")), lambda s: F.concat_ws(":", *cells(s), whole(F.round(s.mean_count, 6) * 1000000), whole(s.median_count * 2), s.estimated_genome_size.cast("string")))
    return doc.withColumn("kmers", F.when(F.col("kmers").isNotNull(), F.array_join(pairs, ",")))


@query(f"with {LATEST} select genome_id, contigs, total_size, last_updated from meta")
def genome_latest(spark, d):
    return _latest(spark, d).select("genome_id", "contigs", "total_size", "last_updated")


# --- matrices -------------------------------------------------------------------------------------------------------

LONG = f'{FEATURES}, matrix as (select organism_id, kmer, max("count"::double) "value" from rows_ where k = 8 group by 1, 2)'
N_ORG = "(select count(distinct organism_id) from rows_ where k = 8)"
PROFILE = f'profile as (select kmer, sum(("value" > 0)::int) / {N_ORG} prevalence, greatest(sum("value" * "value") / {N_ORG} - (sum("value") / {N_ORG}) * (sum("value") / {N_ORG}), 0) variance from matrix group by 1)'


def _matrix(spark, d):
    return matrix.matrix_long(_rows(spark, d), "count", 8)


def _organisms(spark, d):
    return _rows(spark, d).where("k = 8").select("organism_id").distinct().count()


@query(f"with {LONG} select * from matrix")
def matrix_k_filter(spark, d):
    return _matrix(spark, d)


@query(f"with {FEATURES} select organism_id, kmer, max(gc_percent) \"value\" from rows_ group by 1, 2")
def matrix_metric_gc(spark, d):
    return matrix.matrix_long(_rows(spark, d), "gc_percent")


@query(f"with {FEATURES} select distinct kmer from rows_")
def vocabulary(spark, d):
    return matrix.vocabulary(_rows(spark, d))


def _tiny(spark, d, k):
    counts = counting.count_kmers(contigs(spark, d), [k])
    return matrix.matrix_long(counts.withColumnRenamed("cnt", "count"))


@query(counts_sql([3]) + ", o as (select distinct organism_id from counts), v as (select a || b || c kmer from unnest(['A','C','G','T']) x(a), unnest(['A','C','G','T']) y(b), unnest(['A','C','G','T']) z(c)) select o.organism_id, v.kmer, coalesce(cnt, 0)::double \"value\" from o cross join v left join counts c on c.organism_id = o.organism_id and c.kmer = v.kmer")
def matrix_long_zero_fill(spark, d):
    return matrix.zero_filled(_tiny(spark, d, 3), 3)


@query(counts_sql([1]) + " select organism_id, " + ", ".join(f"coalesce(max(case when kmer = '{b}' then cnt end), 0)::double \"{b}\"" for b in "ACGT") + " from counts group by 1")
def matrix_pivot_k1(spark, d):
    return matrix.wide(_tiny(spark, d, 1), 1)


RANK = "list_sum(list_transform(range(1, 9), lambda i: (strpos('ACGT', substr(kmer, i::int, 1)) - 1) * (4 ** (8 - i))::bigint))::bigint"


@query(f'with {LONG} select organism_id, list({RANK} order by kmer) "indices", list("value" order by kmer) "values" from matrix where "value" <> 0 group by 1')
def matrix_sparse(spark, d):
    return matrix.sparse_rows(_matrix(spark, d))


@query(f'with {LONG} select organism_id, kmer, round(case when sum("value") over (partition by organism_id) <> 0 then "value" / sum("value") over (partition by organism_id) else 0 end, 9) "value" from matrix')
def normalize_frequency(spark, d):
    return _rounded(matrix.normalize(_matrix(spark, d)))


@query(f'with {LONG}, {PROFILE} select organism_id, kmer, "value" from matrix where kmer in (select kmer from profile where prevalence >= 0.01 and variance >= 0.001)')
def filter_features(spark, d):
    return matrix.filter_features(_matrix(spark, d), _organisms(spark, d), 0.01, 0.001)


@query(f"with {LONG}, {PROFILE} select kmer, round(prevalence, 9) prevalence, round(variance, 4) variance from profile order by profile.variance desc, kmer limit 500")
def top_features(spark, d):
    out = matrix.top_features(_matrix(spark, d), _organisms(spark, d), 500)
    return out.select("kmer", F.round("prevalence", 9).alias("prevalence"), F.round("variance", 4).alias("variance"))


# --- sources and names ----------------------------------------------------------------------------------------------


@query(f"select contig_id, concat('>', organism_id, ' acgt') header, upper(lower(seq)) body from ({contigs_sql()})")
def fasta_upper(spark, d):
    c = contigs(spark, d)
    lines = c.select("contig_id", F.explode(F.array(F.concat(F.lit(">"), "organism_id", F.lit(" acgt")), F.lower("seq"))).alias("value"))
    out = readers.fasta_upper(lines)
    head = F.max(F.when(F.col("value").startswith(">"), F.col("value")))
    return out.groupBy("contig_id").agg(head.alias("header"), F.max(F.when(~F.col("value").startswith(">"), F.col("value"))).alias("body"))


@query("select distinct accession from (select unnest(string_split_regex(trim(assembly_accession), '\\s+')) accession from ncbi_dataset where assembly_accession is not null and trim(assembly_accession)[1] <> '#') where accession like 'GCF\\_%' escape '\\' or accession like 'GCA\\_%' escape '\\'")
def accession_clean(spark, d):
    return readers.clean_accessions(table(spark, d, "ncbi_dataset"), "assembly_accession")


PATHS = "refseq as (select distinct trim(assembly_accession) a from ncbi_dataset where assembly_accession is not null)"


@query(f"with {PATHS} select a accession, 'https://host.example/genomes/' || a || '/' || a || '_genomic.fna.gz' url from refseq")
def download_url(spark, d):
    acc = table(spark, d, "ncbi_dataset").select(F.trim("assembly_accession").alias("accession")).where("accession is not null").distinct()
    path = F.concat(F.lit("ftp://host.example/genomes/"), "accession")
    refseq, genbank = [F.when(F.col("accession").startswith(p), path).otherwise("") for p in fn.ACCESSION_PREFIXES]
    return acc.select("accession", fn.download_url(refseq, genbank).alias("url")).where("url is not null")


@query("select distinct trim(assembly_accession) accession, replace(trim(assembly_accession), '.', '_') file_name from ncbi_dataset where assembly_accession is not null")
def accession_filename(spark, d):
    acc = table(spark, d, "ncbi_dataset").select(F.trim("assembly_accession").alias("accession")).where("accession is not null").distinct()
    return acc.withColumn("file_name", fn.accession_file_name(F.col("accession")))


FILE = "regexp_extract(file_path, '([^/]+)$', 1)"


@query(f"select file_path, nullif(regexp_extract({FILE}, 'k([0-9]+)', 1), '')::int k_of_file from (select distinct file_path from kmer_counts where file_path is not null)")
def k_from_filename(spark, d):
    files = table(spark, d, "kmer_counts").where("file_path is not null").select("file_path").distinct()
    return files.withColumn("k_of_file", fn.k_of_file(F.col("file_path")))


@query("select source_file, array_to_string(string_split(regexp_replace(source_file, '\\.[^.]*$', ''), '_')[1:2], '_') organism from (select distinct source_file from feature_attributes where source_file is not null)")
def organism_from_filename(spark, d):
    files = table(spark, d, "feature_attributes").where("source_file is not null").select("source_file").distinct()
    return files.withColumn("organism", fn.organism_of_feature_file(F.col("source_file")))


@query(f"select file_path, {FILE} file_name, count(*) n from kmer_counts where regexp_matches({FILE}, '^k.*\\.txt') group by 1, 2")
def file_inventory(spark, d):
    rows = table(spark, d, "kmer_counts").withColumn("file_name", fn.file_name(F.col("file_path")))
    return rows.where(F.col("file_name").rlike(r"^k.*\.txt")).groupBy("file_path", "file_name").agg(F.count(F.lit(1)).alias("n"))


@query("select regexp_extract(file_path, '([^/]+)/[^/]+$', 1) organism, count(distinct file_path) files from kmer_counts where file_path is not null group by 1")
def organism_files(spark, d):
    rows = table(spark, d, "kmer_counts").where("file_path is not null").select("file_path").distinct()
    return rows.groupBy(fn.parent_name(F.col("file_path")).alias("organism")).agg(F.count(F.lit(1)).alias("files"))


# --- clustering -----------------------------------------------------------------------------------------------------


def _embeddings(spark, d):
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, d, "embeddings").where("embedding is not null")
    return rows.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))


@query()
def kmeans(spark, d):
    return ml.kmeans(_embeddings(spark, d), 10).select("vec_id", "prediction")


@query()
def hierarchical(spark, d):
    return ml.hierarchical(_embeddings(spark, d), 10).select("vec_id", "prediction")


@query()
def pca(spark, d):
    from pyspark.ml.functions import vector_to_array

    return ml.reduce_dimensions(_embeddings(spark, d)).select("vec_id", vector_to_array("reduced").alias("reduced"))


@query(
    "with e as (select vec_id, unnest(embedding)::double x, unnest(range(len(embedding))) pos from embeddings), kept as (select pos from e group by 1 having var_samp(x) > 0.01)"
    " select vec_id, list(x order by pos) selected from e join kept using (pos) group by 1"
)
def variance_selection(spark, d):
    from pyspark.ml.functions import vector_to_array

    return ml.select_by_variance(_embeddings(spark, d), 0.01).select("vec_id", vector_to_array("selected").alias("selected"))


@query()
def evaluate(spark, d):
    return ml.evaluate(ml.kmeans(_embeddings(spark, d), 5), "embedding")


@query(
    "with e as (select vec_id, label, embedding::double[] x from embeddings where embedding is not null and label is not null),"
    " far as (select a.vec_id, a.label, b.label other, sum(list_distance(a.x, b.x) ** 2) / (count(*) - (a.label = b.label)::int) m from e a join e b on true group by 1, 2, 3),"
    " own as (select vec_id, m a from far where label = other), near as (select vec_id, min(m) b from far where label <> other group by 1)"
    " select round(avg(case when a is null or isnan(a) then 0 else (b - a) / greatest(a, b) end), 6) silhouette from own join near using (vec_id)"
)
def silhouette_of_labels(spark, d):
    """The silhouette of the given labels, in place of those of a clustering."""
    rows = _embeddings(spark, d).where("label is not null")
    return spark.createDataFrame([(round(ml.silhouette(rows, label="label"), 6),)], "silhouette double")


@query()
def optimize_k(spark, d):
    return ml.optimize_clusters(_embeddings(spark, d).select("features"))


@query()
def cluster_pipeline(spark, d):
    return ml.cluster_organisms(_embeddings(spark, d), "pca", 2, "hierarchical", 3).select("vec_id", "prediction")


@query()
def cluster_kmers(spark, d):
    """k-mer rows to matrix, frequencies, top k-mers, PCA and clusters."""
    return ml.cluster_kmers(_rows(spark, d), 8)


@query()
def cluster_kmers_ward(spark, d):
    return ml.cluster_kmers(_rows(spark, d), 12, clustering="ward")


@query()
def ward_merges(spark, d):
    _, tree = ml.ward_tree(_embeddings(spark, d).select("features"), 10)
    return tree


@query(
    "with e as (select vec_id, label, unnest(embedding)::double x, unnest(range(len(embedding))) pos from embeddings where label is not null),"
    " m as (select label, pos, avg(x) m from e group by 1, 2),"
    " s as (select label, avg(d) s from (select e.label, vec_id, sqrt(sum((x - m) * (x - m))) d from e join m on e.label = m.label and e.pos = m.pos group by 1, 2) group by 1),"
    " a as (select p.label l1, q.label l2, sqrt(sum((p.m - q.m) * (p.m - q.m))) d from m p join m q on p.pos = q.pos and p.label <> q.label group by 1, 2)"
    " select round(avg(r), 6) davies_bouldin from (select l1, max((x.s + y.s) / d) r from a join s x on x.label = l1 join s y on y.label = l2 group by 1)"
)
def davies_bouldin(spark, d):
    return _rounded(ml.davies_bouldin(table(spark, d, "embeddings"), "embedding", "label")).select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


@query(
    f"with {LONG}, labels as (select organism_id, (hash_ % 3)::int prediction from (select distinct organism_id, ascii(right(organism_id, 3)) hash_ from matrix)),"
    " sizes as (select prediction, count(*) size from labels group by 1), per as (select kmer, prediction, sum(\"value\") s from matrix join labels using (organism_id) group by 1, 2),"
    " t as (select kmer, sum(s) t from per group by 1), scored as (select per.prediction, kmer, s / size - (t - s) / ((select count(*) from labels) - size) score from per join t using (kmer) join sizes using (prediction))"
    " select prediction, kmer, round(score, 6) score, rank::int \"rank\" from (select *, row_number() over (partition by prediction order by score desc, kmer) rank from scored) where rank <= 20"
)
def top_kmers_per_cluster(spark, d):
    m = _matrix(spark, d)
    labels = m.select("organism_id").distinct().withColumn("prediction", F.ascii(F.substring("organism_id", -3, 3)) % 3)
    return ml.top_kmers_per_cluster(m, labels).withColumn("score", F.round("score", 6))


CLOSE = "pairs as (select a.vec_id a, b.vec_id b from embeddings a join embeddings b on a.vec_id < b.vec_id and list_distance(a.embedding::double[], b.embedding::double[]) <= 0.6)"


@query(f"with {CLOSE} select * from pairs")
def close_pairs(spark, d):
    return ml.close_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 0.6)


@query(
    f"with recursive {CLOSE}, both_ as (select a, b from pairs union all select b, a from pairs), core as (select vec_id id from embeddings left join both_ on a = vec_id group by 1 having count(b) + 1 >= 5),"
    " inner_ as (select a, b from both_ where a in (select id from core) and b in (select id from core)),"
    " walk as (select id, id root from core union select b id, root from walk join inner_ on a = id), roots as (select id, min(root) root from walk group by 1),"
    " border as (select a id, min(root) near from both_ join roots on b = id group by 1)"
    " select vec_id id, coalesce(root, near) \"cluster\", root is not null core from embeddings left join roots r on r.id = vec_id left join border o on o.id = vec_id"
)
def dbscan(spark, d):
    return ml.dbscan(table(spark, d, "embeddings"), "vec_id", "embedding", 0.6, 5)


# --- p1 and p4 ------------------------------------------------------------------------------------------------------


def _records(spark, d):
    return records.read_records(table(spark, d, "ncbi_raw"))


_CELL = r'(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)'


def _p1_sql() -> str:
    cells = "\\t".join([_CELL] * 14)
    unquote = lambda x: f"trim(case when starts_with({x}, '\"') then replace({x}[2:-2], '\"\"', '\"') else {x} end, ' ')"
    first = f"regexp_extract(body, '^((?s:{_CELL}))(?:\\t|$)', 1)"
    return f"""with lines as (select *, regexp_replace(line, '\\r$', '') body from ncbi_raw where line is not null and not regexp_full_match(line, '\\s*')),
    recs as (select *, regexp_full_match(body, '(?s){cells}') whole from lines
      where {first} not in ('Assembly Accession', chr(65279) || 'Assembly Accession', '"Assembly Accession"')),
    parts as (select *, regexp_extract(body, '^(?s:({_CELL})(?:\\t{_CELL}){{13}})$', 1) acc_, regexp_extract(body, '^(?s:(?:{_CELL}\\t){{11}}({_CELL})(?:\\t{_CELL}){{2}})$', 1) day_ from recs),
    clean as (select *, {unquote('acc_')} acc, {unquote('day_')} dy from parts)
    select raw_id from clean where not whole or not regexp_full_match(acc, 'GC[FA]_[0-9]{{9}}\\.[0-9]+') or not (dy = '' or (regexp_full_match(dy, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') and dy[1:4] <> '0000' and try_cast(dy as date) is not null))"""


@query(_p1_sql())
def p1_found(spark, d):
    return records.failed_rows(_records(spark, d)).select("raw_id")


def _p1_failed_sql() -> str:
    """The rows of p1_found with the reason and its byte offset: whole cells up to the first broken one are cut off by one pattern."""
    begin = lambda n: f"strlen(regexp_extract(body, '^(?s:(?:{_CELL}\\t){{{n}}})'))"
    closed = """'^(?s:"(?:[^"]|"")*")'"""
    day = records.FIELDS.index("assembly_release_date")
    return f"""with bad as ({_p1_sql()}), lines as (select *, regexp_replace(line, '\\r$', '') body from ncbi_raw where raw_id in (select raw_id from bad)),
    cut as (select *, regexp_extract(body, '^(?s:(?:{_CELL}\\t)*)') whole from lines), rest as (select *, body[length(whole) + 1:] tail from cut),
    judged as (select *, case when regexp_full_match(tail, '(?s){_CELL}') then (case when not regexp_full_match(body, '(?s)(?:{_CELL}\\t){{13}}{_CELL}') then 'wrong field count'
      when not regexp_full_match(body, '(?s)"? *GC[FA]_[0-9]{{9}}\\.[0-9]+ *"?(?:\\t.*)?') then 'invalid accession' else 'invalid release date' end)
      when regexp_full_match(tail, '(?s)"(?:[^"]|"")*') then 'unclosed quote' else 'text after closing quote' end error_reason from rest)
    select raw_id, file_name, line_no, received_at, line, error_reason, case error_reason when 'unclosed quote' then strlen(whole) when 'text after closing quote' then strlen(whole) + strlen(regexp_extract(tail, {closed}))
      when 'invalid accession' then 0 when 'invalid release date' then {begin(day)} when 'wrong field count' then (case when regexp_matches(body, '^(?s:(?:{_CELL}\\t){{14}})') then {begin(14)} else strlen(line) end) end::bigint error_at from judged"""


@query(_p1_failed_sql())
def p1_failed_rows(spark, d):
    return records.failed_rows(_records(spark, d))


def _p1_valid_sql() -> str:
    """The complement of p1_found, with the fields cut, unquoted and typed."""
    cut = f"regexp_extract_all(regexp_replace(line, '\\r$', '') || chr(9), '(?s)({_CELL})\\t', 1)"
    part = lambda i: f"nullif(trim(case when starts_with(f[{i}], '\"') then replace(f[{i}][2:-2], '\"\"', '\"') else f[{i}] end, ' '), '')"
    cells = []
    for i, name in enumerate(records.FIELDS, 1):
        whole = f"case when regexp_full_match({part(i)}, '[+-]?[0-9]+') then try_cast({part(i)} as bigint) end"
        kinds = {"assembly_release_date": f"{part(i)}::date", "assembly_stats_number_of_scaffolds": whole}
        cells.append(f"{kinds.get(name, part(i))} {name}")
        if name == "assembly_stats_number_of_scaffolds":
            cells.append(f"case when ({whole}) is null then {part(i)} end {name}_text")
    first = f"regexp_extract(regexp_replace(line, '\\r$', ''), '^((?s:{_CELL}))(?:\\t|$)', 1)"
    return (
        f"with bad as ({_p1_sql()}), good as (select *, {cut} f from ncbi_raw where line is not null and not regexp_full_match(line, '\\s*')"
        f" and {first} not in ('Assembly Accession', chr(65279) || 'Assembly Accession', '\"Assembly Accession\"') and raw_id not in (select raw_id from bad))"
        f" select raw_id, file_name, line_no, received_at, line, {', '.join(cells)} from good"
    )


@query(_p1_valid_sql())
def p1_valid_rows(spark, d):
    return records.valid_rows(_records(spark, d))


def _cells(spark, d):
    return entities.entity_cells(table(spark, d, "feature_attributes"))


_TYPED = """cells as (select entity_id, lower(trim(attribute, ' ')) attribute, nullif(trim(attr_value, ' '), '') v from feature_attributes where entity_id is not null),
 typed as (select entity_id, attribute, v, case attribute when 'kmer' then upper(v) when 'k' then (case when regexp_full_match(v, '[+-]?[0-9]+') then try_cast(v as int) end)::varchar
  when 'count' then (case when regexp_full_match(v, '[+-]?[0-9]+') then try_cast(v as bigint) end)::varchar end t from cells where v is not null and attribute in ('kmer', 'k', 'count'))"""


@query(f"with {_TYPED} select entity_id, attribute from typed group by 1, 2 having count(distinct t) > 1 or count(*) > count(t)")
def p4_found(spark, d):
    found = entities.failed_cells(_cells(spark, d))
    return found.where(F.col("attribute").isin("kmer", "k", "count")).select("entity_id", "attribute")


def _all_typed(kinds: dict[str, str]) -> str:
    """The typed spelling of every attribute in SQL; those that the list of types lacks are text."""
    whole = [n for n, t in kinds.items() if t in entities.WHOLE]
    cases = " ".join(f"when '{n}' then (case when regexp_full_match(v, '[+-]?[0-9]+') then try_cast(v as {kinds[n]}) end)::varchar" for n in whole)
    doubles = ", ".join(f"'{n}'" for n, t in kinds.items() if t == "double")
    return f"case when attribute in ({doubles}) then try_cast(v as double)::varchar when attribute = 'kmer' then upper(v) else case attribute {cases} else v end end"


def _p4_wide_sql() -> str:
    cell = "max(case when attribute = '{0}' then t end)::{1} \"{0}\""
    columns = ", ".join(cell.format(n, {"string": "varchar"}.get(t, t)) for n, t in entities.SPEC.items())
    return (
        "with cells as (select entity_id, lower(trim(attribute, ' ')) attribute, nullif(trim(attr_value, ' '), '') v from feature_attributes where entity_id is not null),"
        f" typed as (select entity_id, attribute, {_all_typed(entities.SPEC)} t from cells where v is not null and attribute <> ''),"
        " one as (select entity_id, attribute, min(t) t from typed group by 1, 2 having count(distinct t) = 1)"
        f" select e.entity_id, {columns} from (select distinct entity_id from cells) e left join one o on e.entity_id = o.entity_id group by 1"
    )


@query(_p4_wide_sql())
def p4_wide(spark, d):
    """All attributes that occur: the known ones typed, others as text (the SQL names those of the test tables)."""
    rows = table(spark, d, "feature_attributes")
    spec = entities.discovered_spec(rows)
    return entities.wide_entities(entities.entity_cells(rows, spec), spec)


@query(
    "with cells as (select entity_id, lower(trim(attribute, ' ')) attribute, nullif(trim(attr_value, ' '), '') v from feature_attributes where entity_id is not null),"
    f" typed as (select entity_id, attribute, v, {_all_typed(entities.SPEC)} t from cells where v is not null and attribute <> ''),"
    " cell as (select entity_id, attribute, count(*) > count(t) bad, count(distinct t) > 1 two from typed group by 1, 2)"
    " select entity_id, attribute, case when bad then 'does not fit the type' else 'contradicting values' end reason from cell where bad or two"
)
def p4_failed_cells(spark, d):
    """Over all attributes that occur, as in p4_wide."""
    rows = table(spark, d, "feature_attributes")
    spec = entities.discovered_spec(rows)
    return entities.failed_cells(entities.entity_cells(rows, spec), spec).select("entity_id", "attribute", "reason")


@query(f"with {_TYPED}, one as (select entity_id, attribute, min(t) t from typed group by 1, 2 having count(distinct t) = 1) select e.entity_id, max(case when attribute = 'kmer' then t end) kmer, max(case when attribute = 'k' then t end)::int k, max(case when attribute = 'count' then t end)::bigint \"count\" from (select distinct entity_id from cells) e left join one o on e.entity_id = o.entity_id group by 1")
def p4_wide_core(spark, d):
    return entities.wide_entities(_cells(spark, d)).select("entity_id", "kmer", "k", "count")
