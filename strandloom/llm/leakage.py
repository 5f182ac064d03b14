"""Passages of held-out items inside a large corpus: a prefix-filtered join of word shingles."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Words in a shingle; words in a row that make a passage; bits of the sieve, 8 MB however many items there are.
SHINGLE, PASSAGE, SIEVE_BITS = 5, 12, 26
_WORD = re.compile(r"[^\W_]+")
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(64)], np.uint64)


def words(text: str) -> list[str]:
    """Runs of letters and digits; case and accents are taken off first."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.category(c).startswith("M"))
    return _WORD.findall(text.casefold())


class WordHashes(dict):
    """64-bit hashes of words, kept for a bounded number of them."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(found: list[str], hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of each ``size`` words in a row."""
    n = len(found) - size + 1
    if n < 1:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out += h[i : i + n] * _FACTORS[i + 1]
    return out.view(np.int64)


def _item_rows(id_col: str, text_col: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            split = [words(t) for t in pdf[text_col]]
            yield pd.DataFrame({"item": pdf[id_col], "words": split, "shingles": [shingles(w, hashes) for w in split]})

    return run


def sieve_of(hashed: DataFrame, bits: int = SIEVE_BITS) -> np.ndarray:
    """2^bits bits, of which those named by the leading bits of the hashes (s) are set; at most 2^(bits - 6) words reach the driver."""
    place = F.shiftrightunsigned("s", 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63).cast("bigint")).cast("int"))
    words_ = hashed.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(bit).alias("m")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words_["w"].to_numpy(np.int64)] = words_["m"].to_numpy(np.int64)
    return out


def _regions(id_col: str, text_col: str, known: Broadcast, need: int, bits: int):
    """Stretches of a text in which at least ``need`` shingles in a row pass the sieve: a shorter one holds no passage."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, sieve = WordHashes(), known.value
        for pdf in batches:
            out = []
            for doc, text in zip(pdf[id_col], pdf[text_col]):
                found = words(text)
                h = shingles(found, hashes)
                place = (h.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
                at = np.flatnonzero((sieve[place >> 6] >> (place & 63)) & 1)
                if len(at) >= need:
                    for run_ in np.split(at, np.flatnonzero(np.diff(at) != 1) + 1):
                        if len(run_) >= need:
                            out.append((doc, run_[0], found[run_[0] : run_[-1] + SHINGLE], h[run_]))
            yield pd.DataFrame(out, columns=["doc", "start", "words", "shingles"])

    return run


def _longest_match(doc, item):
    """The most words in a row that are equal in two aligned arrays."""
    step = lambda s, same: F.struct(
        F.when(same, s.now + 1).otherwise(0).alias("now"), F.greatest(s.best, F.when(same, s.now + 1).otherwise(0)).alias("best")
    )
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))
    return F.aggregate(F.zip_with(doc, item, lambda p, q: F.coalesce(p == q, F.lit(False))), zero, step, lambda s: s.best)


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", passage: int = PASSAGE, bits: int = SIEVE_BITS) -> DataFrame:
    """(doc_id, item_id, words): each document with each item of which it holds ``passage`` words in a row; words is the longest such run.

    Words are runs of letters and digits without case and accents. A passage of p words holds p - SHINGLE + 1 shingles in a
    row, so only stretches of that many shingles that pass a sieve of the items' shingles leave the scan of the corpus. The
    sieve has a fixed size, so the corpus is read once however many and however long the items are; a fuller sieve lets more
    stretches through. Their shingles meet those of the items in a join and are counted; of the shingles that a passage needs,
    its rarest is its prefix and the only one to be joined. The item's words are then laid over the stretch at the place of
    the prefix, cut to the length both have, and compared word by word, so neither hashes nor the sieve decide anything.

    Null ids and null texts are left out; empty texts and items of fewer than ``passage`` words match nothing; repeated rows
    of a document or an item give one row.
    """
    if passage < SHINGLE:
        raise ValueError(f"a passage has at least {SHINGLE} words")
    base = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    given = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).alias("item"), F.col(text).alias("text")).distinct()
    need, kind, item_kind = passage - SHINGLE + 1, dict(base.dtypes)["doc"], dict(given.dtypes)["item"]
    split = given.mapInPandas(_item_rows("item", "text"), f"item {item_kind}, words array<string>, shingles array<bigint>")
    split = written(split.where(F.size("words") >= passage), "items")
    of_items = split.select(F.posexplode("shingles").alias("at", "s"), "item")
    sieve = docs.sparkSession.sparkContext.broadcast(sieve_of(of_items.select("s"), bits))
    regions = base.mapInPandas(_regions("doc", "text", sieve, need, bits), f"doc {kind}, start bigint, words array<string>, shingles array<bigint>")
    regions = written(regions, "regions")
    # rarity over the corpus; then, of the shingles that a passage must all hold, the rarest is its prefix
    hits = regions.select("doc", "start", F.posexplode("shingles").alias("pos", "s"))
    rarity = hits.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    span = Window.partitionBy("item").orderBy("at").rowsBetween(0, need - 1)
    ranked = of_items.join(rarity, "s", "left").withColumn("p", F.min(F.when(F.col("n").isNotNull(), F.struct("n", "s", "at"))).over(span))
    ranked = ranked.withColumn("full", F.count("n").over(span)).where(F.col("full") == need)
    prefixes = ranked.select("item", F.col("p.s").alias("s"), F.col("p.at").alias("at")).distinct()
    # a pair meets in a prefix at one alignment; the item's words lie over the region, as far as both reach
    met = hits.join(prefixes, "s").select("doc", "start", "item", (F.col("pos") - F.col("at")).alias("shift")).distinct()
    met = met.join(regions.select("doc", "start", F.col("words").alias("dw")), ["doc", "start"]).join(split.select("item", F.col("words").alias("iw")), "item")
    first = F.greatest("shift", F.lit(0))
    length = F.least(F.size("dw") - first, F.size("iw") - (first - F.col("shift")))
    laid = met.where(length >= passage).select(
        "doc", "item", F.slice("dw", first + 1, length).alias("dw"), F.slice("iw", first - F.col("shift") + 1, length).alias("iw")
    )
    found = laid.select("doc", "item", _longest_match(F.col("dw"), F.col("iw")).alias("words")).where(F.col("words") >= passage)
    return found.groupBy(F.col("doc").alias(doc_id), F.col("item").alias(item_id)).agg(F.max("words").alias("words"))
