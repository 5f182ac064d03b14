"""Column expressions on k-mers; all built-in functions, so they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
# The storage code of the four letters is A 0, T 1, C 2, G 3.
CODE_LETTERS, CODE_DIGITS = "ATCG", "0123"
#: Feature groups in output order, and the named sets of them.
FEATURE_GROUPS = ("gc_content", "base_counts", "presence", "cpg_sites", "entropy", "repeats")
FEATURE_SETS = {
    "all": FEATURE_GROUPS,
    "basic": ("gc_content", "base_counts"),
    "advanced": ("gc_content", "base_counts", "cpg_sites", "entropy", "repeats"),
}


def encode(kmer: Column) -> Column:
    """Letters to storage digits; any symbol but A, C, G, T becomes X."""
    return F.translate(F.regexp_replace(kmer, "[^ACGT]", "X"), CODE_LETTERS, CODE_DIGITS)


def decode(kmer: Column) -> Column:
    """Storage digits to letters, digits above 3 to N; text that is not all digits is taken as letters."""
    return F.when(kmer.rlike(r"^[0-9]+\z"), F.translate(kmer, "0123456789", "ATCGNNNNNN")).otherwise(kmer)


def legacy_roundtrip(kmer: Column) -> Column:
    """What is left of a k-mer (k <= 19) when its digit code once was read as an integer: leading A's are lost."""
    return F.translate(encode(kmer).cast("bigint").cast("string"), CODE_DIGITS, CODE_LETTERS)


def is_kmer(kmer: Column, k: Column) -> Column:
    """Whether a k-mer in any spelling (case, digit code, mixed) is exactly k letters of ACGT; null for a null k-mer."""
    return (F.length(kmer) == k) & kmer.rlike(r"^[ACGTacgt0-3]+\z")


def letters(kmer: Column) -> Column:
    """The upper-case letters of a k-mer in any spelling; other symbols stay."""
    return F.translate(F.upper(kmer), CODE_DIGITS, CODE_LETTERS)


def read_kmer(kmer: Column, k: Column) -> Column:
    """The upper-case letters of a k-mer in any spelling, or null unless it is exactly k of ACGT."""
    return F.when(is_kmer(kmer, k), letters(kmer))


def only_bases(text: Column) -> Column:
    return (F.length(text) > 0) & (F.length(F.translate(text, BASES, "")) == 0)


def rank4(kmer: Column) -> Column:
    """Base-4 rank in lexicographic order (A < C < G < T) as BIGINT, for k up to 31."""
    return F.conv(F.translate(kmer, BASES, "0123"), 4, 10).cast("bigint")


def base_count(text: Column, bases: str) -> Column:
    """How many letters of ``bases`` a text holds; replace() works on bytes, so also whole contigs take linear time without objects."""
    rest = text
    for b in bases:
        rest = F.replace(rest, F.lit(b), F.lit(""))
    return F.length(text) - F.length(rest)


def gc_percent(kmer: Column) -> Column:
    return F.when(F.length(kmer) > 0, base_count(kmer, "GC") * F.lit(100.0) / F.length(kmer)).otherwise(0.0)


def cpg_count(kmer: Column) -> Column:
    return F.regexp_count(kmer, F.lit("CG"))


def cpg_obs_exp(kmer: Column) -> Column:
    """CpG seen over expected; the expected value is 0.001 where C or G is absent, so the ratio is 0 there."""
    n = F.length(kmer)
    share = (base_count(kmer, "C") / n) * (base_count(kmer, "G") / n)
    return cpg_count(kmer) / F.when((n > 1) & (share > 0), share * (n - 1)).otherwise(F.lit(0.001))


def shannon_entropy(kmer: Column) -> Column:
    """Bits, over the symbols present, always summed in the order A, C, G, T."""
    total = F.lit(0.0)
    for b in BASES:
        p = base_count(kmer, b) / F.length(kmer)
        total = total - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    return total


def has_repeat(kmer: Column) -> Column:
    """1 if a pair of letters follows itself at once anywhere (XYXY, so also AAAA), else 0."""
    return kmer.rlike(r"(..)\1").cast("int")


def feature_columns(kmer: Column, groups: tuple[str, ...] | list[str] | str = "all") -> list[Column]:
    """Feature columns of the groups (or of a named set), in the fixed order of FEATURE_GROUPS; unknown names raise."""
    names = FEATURE_SETS[groups] if isinstance(groups, str) and groups in FEATURE_SETS else groups
    if isinstance(names, str) or (unknown := set(names) - set(FEATURE_GROUPS)):
        raise ValueError(f"unknown feature groups: {names if isinstance(names, str) else sorted(unknown)}")
    entropy = shannon_entropy(kmer)
    columns = {
        "gc_content": [gc_percent(kmer).alias("gc_percent")],
        "base_counts": [base_count(kmer, b).alias(f"{b}_count") for b in BASES],
        "presence": [(F.instr(kmer, b) > 0).cast("int").alias(f"{b}_present") for b in BASES],
        "cpg_sites": [cpg_count(kmer).alias("cpg_count"), cpg_obs_exp(kmer).alias("cpg_obs_exp")],
        "entropy": [entropy.alias("shannon_entropy"), (entropy / 2).alias("normalized_entropy")],
        "repeats": [has_repeat(kmer).alias("has_repeat")],
    }
    return [c for g in FEATURE_GROUPS if g in names for c in columns[g]]
