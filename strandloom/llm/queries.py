"""Registered queries of the training-data operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.kmer import is_kmer, letters
from ..plans.tables import READ, VALID, spread, table
from . import encoding, frequent, leakage, percentiles, similar_groups, term_stats, tokens

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function by its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _texts(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text", "declared_charset"))


# --- p2: most frequent items ----------------------------------------------------------------------------------------

_P2 = f"""rows_ as (select k, {READ} kmer, "count" c from (select distinct * from kmer_counts where "count" > 0 and {VALID})), n as (select k, sum(c) n from rows_ group by 1)"""


def _counted(spark, d):
    return table(spark, d, "kmer_counts").where("`count` > 0")


def _letters(rows):
    return rows.withColumn("letters", letters(F.col("kmer")))


def _intervals(spark, d):
    rows = _counted(spark, d).where(is_kmer(F.col("kmer"), F.col("k"))).dropDuplicates()
    return frequent.frequent_items(_letters(rows), "k", "letters", "count", "0.005")


@query(f"with {_P2} select k, kmer from rows_ join n using (k) group by k, kmer, n having sum(c) * 200 >= n")
def p2_found(spark, d):
    # the second pass need not test the spelling again: only candidates' letters meet it
    found = frequent.exact_frequent(_intervals(spark, d), _letters(_counted(spark, d)), "k", "letters", "count", "0.005")
    return found.select("k", F.col("letters").alias("kmer"))


@query()
def p2_intervals(spark, d):
    return _intervals(spark, d).withColumnRenamed("letters", "kmer")


# --- p3: similar organisms ------------------------------------------------------------------------------------------


def _profiles(spark, d):
    rows = table(spark, d, "kmer_features").where("k = 10 and `count` is not null").dropDuplicates()
    return similar_groups.share_profiles(rows, "organism_id", "gc_percent", "count")


@query(
    'with rows_ as (select distinct * from kmer_features where k = 10 and "count" is not null and gc_percent is not null and organism_id is not null), s as (select organism_id o, gc_percent g, sum("count") c from rows_ group by 1, 2),'
    " p as (select o, g, c / sum(c) over (partition by o) s from s), os as (select distinct o from p), gs as (select distinct g from p),"
    " full_ as (select os.o, gs.g, coalesce(s, 0) s from os cross join gs left join p on p.o = os.o and p.g = gs.g), v as (select o, list(s order by g) v from full_ group by 1)"
    " select a.o organism_a, b.o organism_b from v a join v b on a.o < b.o where list_sum(list_transform(list_zip(a.v, b.v), lambda x: abs(x[1] - x[2]))) <= 0.10"
)
def p3_found(spark, d):
    return similar_groups.similar_pairs(*similar_groups.similar_groups(_profiles(spark, d))).toDF("organism_a", "organism_b")


@query()
def p3_groups(spark, d):
    members, _, _ = similar_groups.similar_groups(_profiles(spark, d))
    return members.withColumnRenamed("record", "organism_id")


# --- p5: percentiles ------------------------------------------------------------------------------------------------

P5_SHARES = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


P5_KEYS, P5_PARTS = ["organism_id", "k"], ["run_id", "day"]


def _values(spark, d):
    """The histogram of counts by organism, k, run and day; exact duplicates once."""
    rows = table(spark, d, "kmer_counts").where("`count` > 0 and organism_id is not null and k is not null")
    return percentiles.distinct_histogram(rows.withColumn("day", F.to_date("counted_at")), [*P5_KEYS, *P5_PARTS], "count")


def _digests(values):
    return percentiles.merged(percentiles.digests(values, P5_KEYS, P5_PARTS), P5_KEYS)


@query(
    'with t as (select organism_id, k, median("count") m from (select distinct * from kmer_counts where "count" > 0) group by 1, 2)'
    " select meta_id from genome_metadata g join t on t.organism_id = g.genome_id and t.k = g.k_value where median_count is not null and abs(median_count - m) > 0.2 * m"
)
def p5_found(spark, d):
    values = _values(spark, d)
    medians = percentiles.exact_medians(values, _digests, P5_KEYS)
    meta = table(spark, d, "genome_metadata").where("median_count is not null")
    both = meta.join(medians, (meta.genome_id == medians.organism_id) & (meta.k_value == medians.k))
    return both.where(F.abs(F.col("median_count") - F.col("median")) > 0.2 * F.col("median")).select("meta_id")


@query()
def p5_percentiles(spark, d):
    values = _values(spark, d)
    return percentiles.certified(values, _digests(values), P5_KEYS, P5_SHARES)


# --- p6: frequency of every term ------------------------------------------------------------------------------------

_P6 = f"""rows_ as (select organism_id, {READ} kmer, "count" c from (select distinct * from kmer_features where {VALID})), n as (select count(distinct organism_id) n from kmer_features), t as (select kmer, coalesce(sum(c), 0)::bigint occurrences, count(distinct organism_id) records from rows_ group by 1)"""


def _terms(spark, d):
    rows = table(spark, d, "kmer_features")
    organisms = rows.select("organism_id").where("organism_id is not null").distinct().count()
    rows = rows.where(is_kmer(F.col("kmer"), F.col("k"))).dropDuplicates()
    return term_stats.term_statistics(_letters(rows), "letters", "organism_id", "count", 2, (40, 100), organisms)


@query(f"with {_P6} select kmer from t, n where records <= 2 or records * 100 >= n * 40")
def p6_found(spark, d):
    return _terms(spark, d).where("mark is not null").select(F.col("term").alias("kmer"))


@query(f"with {_P6} select kmer, occurrences, records, case when records <= 2 and records * 100 >= n * 40 then 'rare and common' when records <= 2 then 'rare' when records * 100 >= n * 40 then 'common' end mark from t, n")
def p6_terms(spark, d):
    return _terms(spark, d).select(F.col("term").alias("kmer"), "occurrences", "records", "mark")


# --- p8: leaked evaluation texts ------------------------------------------------------------------------------------


def _leaks(spark, d):
    return leakage.leaked_items(_texts(spark, d), table(spark, d, "eval_items"))


_GRAMS = "select {id}, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) g from (select {id}, regexp_extract_all(lower(strip_accents(text)), '[\\p{{L}}\\p{{N}}]+') w from {table} where text is not null)"


@query(f"select distinct doc_id, item_id from ({_GRAMS.format(id='doc_id', table='documents')}) join ({_GRAMS.format(id='item_id', table='eval_items')}) using (g)")
def p8_found(spark, d):
    return _leaks(spark, d).select("doc_id", "item_id")


_PLACED = _GRAMS.replace("select {id}, unnest(", "select {id}, unnest(range(len(w) - 11)) pos, unnest(", 1)


@query(
    f"with d as ({_PLACED.format(id='doc_id', table='documents')}), i as ({_PLACED.format(id='item_id', table='eval_items')}),"
    " met as (select distinct doc_id, item_id, d.pos - i.pos shift, d.pos from d join i using (g)),"
    " runs as (select *, pos - row_number() over (partition by doc_id, item_id, shift order by pos) run from met),"
    " long as (select doc_id, item_id, count(*) + 11 words from runs group by doc_id, item_id, shift, run)"
    " select doc_id, item_id, max(words)::int words from long group by 1, 2"
)
def p8_leaks(spark, d):
    return _leaks(spark, d)


# --- p7: token ids --------------------------------------------------------------------------------------------------


@query()
def p7_ids(spark, d):
    return tokens.encoded(_texts(spark, d))


@query("select doc_id, coalesce(text, '') text from documents")
def p7_text(spark, d):
    """Encoded and decoded again."""
    return tokens.decoded(tokens.encoded(_texts(spark, d)))


# --- p9: wrong character encodings ----------------------------------------------------------------------------------


def _garbled(spark, d):
    return encoding.garbled_texts(_texts(spark, d))


@query()
def p9_found(spark, d):
    return _garbled(spark, d).select("doc_id")


@query()
def p9_restored(spark, d):
    return _garbled(spark, d)
