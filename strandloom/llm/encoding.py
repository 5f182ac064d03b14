"""Texts that were decoded in a wrong character encoding: found, and restored where that can be told.

A wrong decoding turns each letter into one or several fixed other characters: a substitution cipher whose keys are the
swaps of two code pages. Which swaps occur in a source, and how clean words look, is learned together by
expectation-maximization: words are held against character bigrams of the corpus as they stand and as each swap would
restore them; the shares by which swaps explain them re-weight both the bigrams and each source's swaps. What no known
swap explains in a source is deciphered: the letter of each character is learned by expectation-maximization from the pairs
of characters against the bigrams. A text is then judged by its source's learned odds and what its words gain.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

# Code pages that texts are wrongly read in, and that they may have been written in.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "cp1253", "iso8859_7")
WRITTEN_IN = ("cp1252", "cp1250", "iso8859_2", "cp852", "cp1251", "koi8_r", "cp866", "iso8859_5", "cp1253", "iso8859_7", "mac_roman", "cp437", "cp850")
WRITTEN_WIDE = ("shift_jis", "euc_jp", "gbk", "big5")
READ_WIDE = ("gbk", "shift_jis", "big5")
#: Characters that the bigrams tell apart; rarer ones count as their kind. (first code point, how many share the kind)
LETTERS = 2000
KINDS = (
    (0x80, 32), (0xA0, 96), (0x100, 600), (0x300, 112), (0x370, 144), (0x400, 300), (0x530, 3000), (0x1E00, 512), (0x2000, 1000), (0x2500, 300),
    (0x2600, 2700), (0x3040, 200), (0x3100, 800), (0x3400, 28000), (0xA000, 3000), (0xAC00, 11200), (0xD800, 12000), (0x10000, 100000),
)
#: Rounds of the learning; the log probability below which a bigram is suspect; the share of a swap before learning. Few characters
#: happen to be valid UTF-8 read wrongly, so there a word is as likely garbled as not; one-byte swaps nearly always give some text.
ROUNDS, RARE, PRIOR_UTF8, PRIOR_OTHER = 4, -4.0, 0.5, 1e-3
#: Sources with shares of their own, those of most words; the rest are learned as one. Words that a source's share is smoothed by.
SOURCES, SMOOTH = 1000, 20.0
#: Shares of a garbled text's words that may be affected; the likeliest counts.
RATES = np.array([0.9, 0.5, 0.1, 0.01, 0.001])
#: Unknown pages: characters of a one-byte page that a source's cipher can hold, letters they may stand for, EM steps and starts.
PAGE, CIPHER_LETTERS, CIPHER_STEPS, CIPHER_STARTS = 128, 240, 100, 3
#: What a pair of characters must gain by deciphering on average, as a wrong mapping of rare or foreign words gains less; different
#: pairs that a source must have, as fewer do not determine a page's letters.
CIPHER_GAIN, CIPHER_PAIRS = 2.0, 200
_LOST = "�"


def _bytes_of(page: str) -> np.ndarray:
    """The byte of each code point up to 65535 in a one-byte code page, or -1; bytes without a character are control characters."""
    out = np.full(65536, -1, np.int16)
    for b in range(256):
        c = bytes([b]).decode(page, "replace")
        out[ord(c) if c != _LOST else b] = b
    return out


def _letters_of(page: str) -> np.ndarray:
    """The code point of each byte in a one-byte code page, or -1."""
    texts = [bytes([b]).decode(page, "replace") for b in range(256)]
    return np.array([-1 if c == _LOST or 0x80 <= ord(c) < 0xA0 else ord(c) for c in texts], np.int32)


SWAPS = (
    [f"{w}>utf-8" for w in (*READ_AS, *READ_WIDE)]
    + [f"{w}>{r}" for w in READ_AS for r in (*WRITTEN_IN, *WRITTEN_WIDE) if w != r]
    + [f"{w}>utf-8 twice" for w in (*READ_AS, *READ_WIDE)]
)
SWAP_ID = {s: i for i, s in enumerate(SWAPS)}
#: The swap number of a source's deciphered page.
CIPHER = len(SWAPS)
PRIOR = np.array([PRIOR_UTF8 if ">utf-8" in s else PRIOR_OTHER for s in SWAPS] + [PRIOR_OTHER])
_BYTES = {w: _bytes_of(w) for w in READ_AS}
_LETTERS = {r: _letters_of(r) for r in WRITTEN_IN}


def unescaped(text: str) -> str:
    """Character references as characters, also when they were escaped again."""
    while "&" in text and (plain := html.unescape(text)) != text:
        text = plain
    return text


def suspicious_words(text: str) -> list[str]:
    """The words, parted at ASCII white space, that hold other characters than ASCII."""
    return [w.decode() for w in unescaped(text).encode("utf-8", "replace").split() if not w.isascii()]


@dataclass
class Bigrams:
    """Log probabilities of character pairs; ``ids`` gives a character's row, ``share`` how common it is, ``letters`` the characters of rows 1, 2, ..."""

    ids: np.ndarray
    table: np.ndarray
    share: np.ndarray
    letters: list[int]

    def scores(self, codes: np.ndarray, starts: np.ndarray, lowest: bool = False) -> np.ndarray:
        """The summed (or lowest) log probability of each word; words lie in ``codes`` with a 0 before each and at the end."""
        ids = self.ids[codes]
        each = self.table[ids[:-1], ids[1:]]
        return np.minimum.reduceat(each, starts) if lowest else np.add.reduceat(each, starts)


def laid_out(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, a 0 before each and at the end, and where each word's 0 is."""
    codes = np.frombuffer(("\0" + "\0".join(w.replace("\0", " ") for w in words) + "\0").encode("utf-32-le"), np.uint32)
    sizes = np.array([len(w) for w in words], np.int64) + 1
    return codes, np.concatenate([[0], np.cumsum(sizes)[:-1]])


def code_ids(letters: list[int]) -> np.ndarray:
    """Row of each code point: 0 for the word's end, then the letters, then the kinds."""
    kinds = np.searchsorted([k for k, _ in KINDS], np.arange(0x110000), side="right")
    ids = (len(letters) + 1 + kinds).astype(np.int16)
    ids[letters] = np.arange(1, len(letters) + 1)
    ids[0] = 0
    return ids


def bigrams(pairs: pd.DataFrame, letters: list[int], ids: np.ndarray) -> Bigrams:
    return of_counts(counts_of(pairs, letters), letters, ids)


def counts_of(pairs: pd.DataFrame, letters: list[int]) -> np.ndarray:
    """The table of (a, b, w)."""
    size = len(letters) + 2 + len(KINDS)
    counts = np.zeros((size, size), np.float32)
    counts[pairs["a"].to_numpy(int), pairs["b"].to_numpy(int)] = pairs["w"].to_numpy()
    return counts


def of_counts(counts: np.ndarray, letters: list[int], ids: np.ndarray) -> Bigrams:
    """Log probabilities smoothed by the second character's own share."""
    first = counts.sum(axis=1, keepdims=True)
    own = (counts.sum(axis=0) + 0.001) / (counts.sum() + 1)
    table = counts + 2 * own
    table /= first + 2
    np.log(table, out=table)
    table[:, len(letters) + 1 :] -= np.log([1, *[n for _, n in KINDS]]).astype(np.float32)
    return Bigrams(ids, table, own / own.sum(), letters)


def _decodings(words: list[str]) -> list[tuple[int, str, str]]:
    """(word's number, swap, restored) of each word whose characters read as bytes are text in a many-byte encoding."""
    codes, starts = laid_out(words)
    ends = np.append(starts[1:], len(codes) - 1)
    plain = np.minimum(codes, 65535)
    found = []
    for page in READ_AS:
        data = _BYTES[page][plain]
        usable = np.minimum.reduceat(data[:-1], starts) >= 0
        high = data > 127
        at = np.flatnonzero(high)
        first = at[np.minimum(np.searchsorted(at, starts), len(at) - 1)] if len(at) else starts
        following = data[np.minimum(first + 1, len(data) - 1)]
        as_utf8 = usable & (data[first] >= 0xC2) & (data[first] <= 0xF4) & (following >= 0x80) & (following <= 0xBF)
        count = np.add.reduceat(high[:-1].astype(np.int64), starts)
        as_wide = usable & (count >= 4) & (count * 3 >= ends - starts - 1)
        raw = np.where(data < 0, 0, data).astype(np.uint8).tobytes()
        for i in np.flatnonzero(as_utf8):
            if text := _utf8(raw[starts[i] + 1 : ends[i]]):
                found.append((int(i), f"{page}>utf-8", text))
        for i in np.flatnonzero(as_wide):
            for wide in WRITTEN_WIDE:
                try:
                    found.append((int(i), f"{page}>{wide}", raw[starts[i] + 1 : ends[i]].decode(wide)))
                except UnicodeDecodeError:
                    pass
    for i, word in enumerate(words):
        if any("⺀" <= c for c in word):
            for page in READ_WIDE:
                try:
                    text = _utf8(word.encode(page))
                except UnicodeEncodeError:
                    continue
                if text:
                    found.append((i, f"{page}>utf-8", text))
    return found


def _utf8(data: bytes) -> str | None:
    """The text, without a character cut off at the end; None if it is not UTF-8 or no more than ASCII."""
    try:
        text = data.decode()
    except UnicodeDecodeError as error:
        if error.reason != "unexpected end of data":
            return None
        text = data[: error.start].decode()
    return None if text.isascii() else text


def undoable(words: list[str], model: Bigrams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, swap, gain) of each swap that could have made a word, with the log probability gained by undoing it.

    One-byte swaps are tried on words with a rare bigram only; words whose characters read as bytes are many-byte text always
    count, as copies of a garbled text may have made their bigrams common.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    codes, starts = laid_out(words)
    base_all = model.scores(codes, starts)
    rare = np.flatnonzero(model.scores(codes, starts, lowest=True) < RARE)
    texts, which, swaps = [], [], []
    for i, swap, text in _decodings(words):
        texts.append(text), which.append(i), swaps.append(swap)
    for j, swap, text in _decodings(texts) if texts else ():
        if swap == swaps[j] and swap.endswith(">utf-8"):
            texts.append(text), which.append(which[j]), swaps.append(f"{swap} twice")
    out = [(np.array(which, np.int64), np.array([SWAP_ID[x] for x in swaps], np.int64), model.scores(*laid_out(texts)) - base_all[which])] if texts else []
    codes, starts = laid_out([words[i] for i in rare])
    base = base_all[rare]
    plain = np.minimum(codes, 65535)
    for page in READ_AS if len(rare) else ():
        data = _BYTES[page][plain]
        usable = np.minimum.reduceat(data[:-1], starts) >= 0
        for written_in in WRITTEN_IN if usable.any() else ():
            if written_in != page:
                letters = _LETTERS[written_in][np.maximum(data, 0)]
                fine = np.flatnonzero(usable & (np.minimum.reduceat(letters[:-1], starts) >= 0))
                if len(fine):
                    gain = model.scores(np.maximum(letters, 0), starts) - base
                    out.append((rare[fine], np.full(len(fine), SWAP_ID[f"{page}>{written_in}"]), gain[fine]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate([o[c] for o in out]) for c in range(3))


def explained(words: list[str], model: Bigrams) -> list[list[tuple[int, float]]]:
    """For each word the swaps that gain log probability, as (swap, gain)."""
    out: list[list] = [[] for _ in words]
    which, swaps, gains = undoable(words, model)
    keep = gains > 0
    for i, swap, gain in zip(which[keep].tolist(), swaps[keep].tolist(), gains[keep].tolist()):
        out[i].append((swap, gain))
    return out


@dataclass
class Learned:
    """The bigrams; each source's row of ``odds``, the last one being that of all other sources; the log odds that a word which a swap can
    undo was made by it; and the deciphered pages by row."""

    model: Bigrams
    rows: dict[str | None, int]
    odds: np.ndarray
    ciphers: dict[int, dict[int, int]]

    def row(self, source: str | None) -> int:
        return self.rows.get(source, len(self.rows))


def cipher_gains(words: list[str], cipher: dict[int, int], model: Bigrams) -> np.ndarray:
    """What each word gains by the cipher's letters; 0 where they change nothing."""
    changed = [w.translate(cipher) for w in words]
    return model.scores(*laid_out(changed)) - model.scores(*laid_out(words)) if words else np.zeros(0)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(source, text): each text that may hold suspicious words once, however often and in whatever sources it is copied.

    Copies, told by a hash, are reduced before they shuffle; a text of several sources stays with the smallest one.
    """
    some = docs.where(F.col("text").rlike(r"[^\x00-\x7F]|&"))
    return some.groupBy(F.xxhash64("text").alias("h")).agg(F.min("source").alias("source"), F.first("text").alias("text")).select("source", "text")


def word_counts(docs: DataFrame) -> DataFrame:
    """(source, word, n) of the suspicious words of ``docs`` (source, text); n is the number of distinct texts, so that neither a long text nor a copied one outweighs the rest.

    Words are counted in each batch before they shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text.isascii() or "&" in text:
                    counts.update((source, w) for w in set(suspicious_words(text)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["source", "word", "n"]
            )

    found = distinct_texts(docs).mapInArrow(run, "source string, word string, n bigint")
    return found.groupBy("source", "word").agg(F.sum("n").alias("n"))


def _letter_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        codes, starts = laid_out(pdf["word"].tolist())
        each = np.repeat(pdf["n"].to_numpy(), np.diff(np.append(starts, len(codes) - 1)))
        kinds, where = np.unique(codes[:-1], return_inverse=True)
        yield pd.DataFrame({"a": kinds.astype(np.int64), "w": np.bincount(where, each.astype(float))})


PARTS = "kind int, a bigint, b bigint, c bigint, w double, t double"
_PAIRS, _SHARES, _UNKNOWN = 0, 1, 2


def _statistics(shared, size: int, pages: bool, trusted: bool):
    """Sums of one round: the bigrams of words by their share of being clean (a, b, w); for each source and swap the words that it made (w)
    of those that it can undo (t); and, where ``pages`` are to be deciphered, the character pairs (b, c) of each source's words (w).

    Once pages are deciphered, their words are ``trusted`` to be garbled for one round, so that the bigrams lose them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: Learned = shared.value
        made, tried = np.zeros((size + 1, CIPHER + 1)), np.zeros((size + 1, CIPHER + 1))
        for pdf in batches:
            words = pdf["word"].tolist()
            counts = np.array([len(x) for x in pdf["sources"]])
            word_of = np.repeat(np.arange(len(words)), counts)  # one line for each word and source
            source, n = np.concatenate(pdf["sources"].tolist()), np.concatenate(pdf["ns"].tolist()).astype(float)
            codes, starts = laid_out(words)
            clean = np.ones(len(source))
            if now.odds is not None:
                which, swaps, gains = undoable(words, now.model)
                first = np.concatenate([[0], np.cumsum(counts)])
                line = np.concatenate([np.arange(a, b) for a, b in zip(first[which], first[which + 1])]) if len(which) else np.zeros(0, np.int64)
                each = np.repeat(np.arange(len(which)), counts[which])
                swap, gain = swaps[each], gains[each]
                for row, cipher in now.ciphers.items():
                    at = np.flatnonzero(source == row)
                    by = cipher_gains([words[i] for i in word_of[at]], cipher, now.model)
                    line, swap, gain = np.concatenate([line, at[by != 0]]), np.concatenate([swap, np.full((by != 0).sum(), CIPHER)]), np.concatenate([gain, by[by != 0]])
                odds = np.exp(np.minimum(np.where(trusted & (swap == CIPHER), 50.0, now.odds[source[line], swap] + gain), 50.0))
                clean = 1 / (1 + np.bincount(line, odds, len(source)))
                np.add.at(made, (source[line], swap), n[line] * odds * clean[line])
                np.add.at(tried, (source[line], swap), n[line])
            length = np.diff(np.append(starts, len(codes) - 1))
            rows = now.model.ids[codes].astype(np.int64)
            keys, where = np.unique(rows[:-1] << 20 | rows[1:], return_inverse=True)
            weight = np.bincount(where, np.repeat(np.bincount(word_of, n * clean, len(words)), length))
            yield pd.DataFrame({"kind": _PAIRS, "a": keys >> 20, "b": keys & 0xFFFFF, "c": 0, "w": weight, "t": 0.0})
            if pages:
                yield _source_pairs(codes, starts, length, word_of, source, n * clean)
        a, b = np.nonzero(tried)
        yield pd.DataFrame({"kind": _SHARES, "a": a, "b": b, "c": 0, "w": made[a, b], "t": tried[a, b]})

    return run


def _source_pairs(codes, starts, length, word_of, source, weight) -> pd.DataFrame:
    """The character pairs of one-byte pages in the words of each source."""
    size = length[word_of]
    at = np.repeat(starts[word_of] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    x, y = codes[at].astype(np.int64), codes[at + 1].astype(np.int64)
    fit = (np.maximum(x, y) >= 0x80) & (np.maximum(x, y) < 0x3000)
    keys, where = np.unique((np.repeat(source.astype(np.int64), size) << 32 | x << 16 | y)[fit], return_inverse=True)
    return pd.DataFrame({"kind": _UNKNOWN, "a": keys >> 32, "b": keys >> 16 & 0xFFFF, "c": keys & 0xFFFF, "w": np.bincount(where, np.repeat(weight, size)[fit], len(keys)), "t": 0.0})


def deciphered(pairs: pd.DataFrame, counts: np.ndarray, letters: list[int], ids: np.ndarray) -> dict[int, int]:
    """The letter of each character of a source whose page is on no list, from counts w of the character pairs (x, y) of its words.

    The bigrams are those of all other sources (``counts`` less the source's own), as a page that a whole source is read in would
    else be a language of its own. Expectation-maximization of the letters' emissions, ASCII and the word's ends
    standing for themselves, from several starts; the mapping by which the pairs gain most is taken. It holds only if that
    gain pays for naming its letters and is CIPHER_GAIN for each pair it changes: words that are merely rare, or of a
    language that only this source has, give none. Sources that read as others do need no mapping, and one with more text than
    all others has nothing to be held against.
    """
    p, q, w = pairs["x"].to_numpy(int), pairs["y"].to_numpy(int), pairs["w"].to_numpy()
    others = counts.copy()
    np.subtract.at(others, (ids[p].astype(int), ids[q].astype(int)), w)
    model = of_counts(np.maximum(others, 0), letters, ids)
    seen = np.bincount(p, w, 65536) + np.bincount(q, w, 65536)
    seen[:128] = 0
    unknown = np.argsort(-seen, kind="stable")[:PAGE]
    unknown = unknown[seen[unknown] > 0]
    high = [r for r, c in enumerate(letters, 1) if 0x80 <= c < 0x3000 and chr(c).isalpha()]
    high = np.array(sorted(high, key=lambda r: -model.share[r])[:CIPHER_LETTERS], np.int64)
    known = np.array([c for c in range(128) if c == 0 or chr(c).isalpha() or chr(c) in "'-.,"], np.int64)
    high_rows = np.isin(np.arange(len(others)), high)
    usual = np.where(high_rows[:, None] | high_rows[None, :], np.maximum(others, 0), 0)
    reads = float((usual * model.table).sum() / max(usual.sum(), 1)) - float((w * model.table[ids[p], ids[q]]).sum() / max(w.sum(), 1e-9))
    if len(pairs) < CIPHER_PAIRS or w.sum() > usual.sum() or reads < CIPHER_GAIN:
        return {}
    place = np.full(65536, -1)
    place[known], place[unknown] = np.arange(len(known)), len(known) + np.arange(len(unknown))
    fit = (place[p] >= 0) & (place[q] >= 0)
    seen_pairs = np.zeros((len(known) + len(unknown),) * 2)
    np.add.at(seen_pairs, (place[p][fit], place[q][fit]), w[fit])
    states = np.concatenate([ids[known], high]).astype(int)
    joint = model.share[states][:, None] * np.exp(model.table[np.ix_(states, states)])
    targets = np.array([letters[r - 1] for r in high], np.int64)
    best, top = {}, 0.0
    for start in range(CIPHER_STARTS):
        emit = np.zeros((len(states), len(seen_pairs)))
        emit[np.arange(len(known)), np.arange(len(known))] = 1
        emit[len(known) :, len(known) :] = np.random.default_rng(start).dirichlet(np.full(len(unknown), 4.0), len(high))
        for _ in range(CIPHER_STEPS):
            ratio = seen_pairs / (emit.T @ joint @ emit + 1e-300)
            grown = emit * (joint @ emit @ ratio.T + joint.T @ emit @ ratio)
            grown[: len(known)] = emit[: len(known)]
            emit = grown / np.maximum(grown.sum(axis=1, keepdims=True), 1e-300)
        letter = (emit * model.share[states][:, None])[len(known) :, len(known) :].argmax(axis=0)
        mapping = {int(c): int(t) for c, t in zip(unknown, targets[letter]) if c != t}
        turned = np.arange(65536)
        turned[list(mapping)] = list(mapping.values())
        gain = float((w * (model.table[ids[turned[p]], ids[turned[q]]] - model.table[ids[p], ids[q]])).sum())
        changed = float(w[(turned[p] != p) | (turned[q] != q)].sum())
        if gain > max(top, len(mapping) * np.log(len(high)), CIPHER_GAIN * changed):
            best, top = mapping, gain
    return best


def learned(docs: DataFrame, rounds: int = ROUNDS, letters: int = LETTERS, sources: int = SOURCES) -> Learned:
    """What the corpus' texts (source, text) teach: bigrams of clean text, each source's odds of the swaps, and deciphered pages.

    The driver gets the bigrams of at most ``letters`` characters and of the KINDS, and for at most ``sources`` sources a share of each
    swap and a page's letters: none grows with the corpus.
    """
    spark = docs.sparkSession
    counted = written(word_counts(docs), "words")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).mapInPandas(_letter_counts, "a bigint, w double").groupBy("a").agg(F.sum("w").alias("w")).where("a > 0")
    chosen = sorted(r.a for r in top.orderBy(F.col("w").desc(), "a").limit(letters).collect())
    ids = code_ids(chosen)
    most = counted.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "source").limit(sources).collect()
    rows = {r.source: i for i, r in enumerate(most)}
    size = len(rows)
    numbers = spark.createDataFrame([(s, i) for s, i in rows.items()], "name string, i int")
    placed = counted.join(numbers, counted.source.eqNullSafe(numbers.name), "left").select("word", F.coalesce("i", F.lit(size)).alias("i"), "n")
    each = placed.groupBy("word", "i").agg(F.sum("n").alias("n")).groupBy("word")
    words = written(each.agg(F.collect_list("i").alias("sources"), F.collect_list("n").alias("ns")), "sources_of_words")
    now = Learned(Bigrams(ids, np.zeros((1, 1)), np.zeros(1), chosen), rows, None, {})
    for number in range(rounds + 1):  # the first one only counts
        run = _statistics(spark.sparkContext.broadcast(now), size, number == rounds - 2, number == rounds - 1)
        sums = words.mapInPandas(run, PARTS).groupBy("kind", "a", "b", "c").agg(F.sum("w").alias("w"), F.sum("t").alias("t"))
        sums = written(sums, "statistics")
        pairs = sums.where(f"kind = {_PAIRS}").select("a", "b", "w").toPandas()
        made, tried = np.zeros((2, size + 1, CIPHER + 1))
        for r in sums.where(f"kind = {_SHARES}").collect():
            made[r.a, r.b], tried[r.a, r.b] = r.w, r.t
        # one word less than was made, as a word must not vouch for itself
        overall = (np.maximum(made.sum(axis=0) - 1, 0) + PRIOR) / (tried.sum(axis=0) + 1)
        share = np.clip((np.maximum(made - 1, 0) + SMOOTH * overall) / (tried + SMOOTH), 1e-9, 0.999)
        ciphers = _ciphers(sums, pairs, chosen, ids) if number == rounds - 2 else now.ciphers
        now = Learned(bigrams(pairs, chosen, ids), rows, np.log(share / (1 - share)), ciphers)
    return now


def _ciphers(sums: DataFrame, pairs: pd.DataFrame, letters: list[int], ids: np.ndarray) -> dict[int, dict[int, int]]:
    """The deciphered pages, one task a source: its pairs are those of the characters below U+3000."""
    shared = sums.sparkSession.sparkContext.broadcast((counts_of(pairs, letters), letters, ids))
    run = lambda key, pdf: pd.DataFrame([(key[0], c, t) for c, t in deciphered(pdf, *shared.value).items()], columns=["a", "x", "t"])
    pages = sums.where(f"kind = {_UNKNOWN}").select("a", F.col("b").alias("x"), F.col("c").alias("y"), "w").groupBy("a").applyInPandas(run, "a bigint, x bigint, t bigint")
    out: dict[int, dict[int, int]] = {}
    for r in pages.collect():
        out.setdefault(r.a, {})[r.x] = r.t
    return out


def text_odds(prior: float, gains: np.ndarray, words: int) -> float:
    """The log odds that a swap garbled a text, from its prior, the gains of the words it explains and how many words the text has."""
    each = np.logaddexp(np.log1p(-RATES)[:, None], np.log(RATES)[:, None] + gains).sum(axis=1)
    return prior + float(np.max(each + (words - len(gains)) * np.log1p(-RATES)))


def _judged(shared):
    """(doc, swap, odds, lost, restored): the texts that are likelier garbled than not, or that hold replacement characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Learned = shared.value
        known: dict[str, list] = {}
        for batch in batches:
            docs, texts, sources = (batch.column(i).to_pylist() for i in range(3))
            split = [[] if t.isascii() and "&" not in t else suspicious_words(t) for t in texts]
            fresh = list({w for words in split for w in words if w not in known})
            for a in range(0, len(fresh), 20_000):
                known.update(zip(fresh[a : a + 20_000], explained(fresh[a : a + 20_000], now.model)))
            out = []
            for doc, text, source, words in zip(docs, texts, sources, split):
                row, own = now.row(source), set(words)
                ways: dict[int, list] = {}
                for w in own:
                    for swap, gain in known[w]:
                        ways.setdefault(swap, []).append(gain)
                if own and row in now.ciphers:
                    by = cipher_gains(list(own), now.ciphers[row], now.model)
                    ways[CIPHER] = by[by > 0].tolist()
                odds = {s: text_odds(now.odds[row, s], np.array(g), len(own)) for s, g in ways.items() if g and now.odds[row, s] + sum(g) > 0}
                swap = max(odds, key=lambda s: (odds[s], s), default=None)
                total = float(np.logaddexp.reduce(list(odds.values()))) if odds else 0.0
                lost = any(_LOST in w for w in words)
                if total > 0 or lost:
                    out.append((doc, _name(swap) if total > 0 else None, total if total > 0 else 0.0, lost, _restored(unescaped(text), words, known, swap, row, now) if total > 0 else None))
            if len(known) > 100_000:
                known.clear()
            columns = list(zip(*out)) or [[]] * 5
            kinds = [batch.schema.field(0).type, pa.string(), pa.float64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc", "swap", "odds", "lost", "restored"])

    return run


def _name(swap: int) -> str:
    return "deciphered" if swap == CIPHER else SWAPS[swap]


def undone(word: str, swap: str) -> str | None:
    """The word as the swap restores it, or None."""
    page, _, written_in = swap.removesuffix(" twice").partition(">")
    if written_in in _LETTERS:
        return word.translate(_translation(page, written_in))
    try:
        if page in _BYTES:
            data = _BYTES[page][np.minimum(np.frombuffer(word.encode("utf-32-le"), np.uint32), 65535)]
            raw = None if (data < 0).any() else data.astype(np.uint8).tobytes()
        else:
            raw = word.encode(page)
        text = None if raw is None else _utf8(raw) if written_in == "utf-8" else raw.decode(written_in)
    except UnicodeError:
        return None
    return undone(text, f"{page}>{written_in}") if text is not None and swap.endswith(" twice") else text


@cache
def _translation(page: str, written_in: str) -> dict[int, int]:
    """The letter of each wrongly read character."""
    high = np.flatnonzero(_BYTES[page] > 127)
    letters = _LETTERS[written_in][_BYTES[page][high]]
    return {int(c): int(x) for c, x in zip(high, letters) if x >= 0}


def _restored(text: str, words: list[str], known: dict, swap: int, row: int, now: Learned) -> str:
    """The text with its words restored.

    By the text's swap wherever many bytes can be undone; with one-byte swaps and deciphered pages in all words if most that it
    changes gain, else in those that do. Words that a many-byte swap leaves alone are restored by their own likeliest swap.
    """
    own = set(words)
    if swap == CIPHER:
        best = {w: w.translate(now.ciphers[row]) for w in own}
        helped = {w for w, gain in zip(own, cipher_gains(list(own), now.ciphers[row], now.model)) if gain > 0}
    else:
        best = {w: fixed for w in own if (fixed := undone(w, SWAPS[swap])) not in (None, w)}
        helped = {w for w in best if any(s == swap for s, _ in known[w])}
    if swap != CIPHER and SWAPS[swap].split(">")[1] not in _LETTERS:
        for w in own - best.keys():
            ways = [(gain + now.odds[row, s], s) for s, gain in known[w]]
            if ways and max(ways)[0] > 0 and (fixed := undone(w, SWAPS[max(ways)[1]])) is not None:
                best[w] = fixed
    elif len(helped) < 0.8 * len(best):
        best = {w: fixed for w, fixed in best.items() if w in helped}
    pieces = re.split(r"([ \t\n\r\x0b\x0c]+)", text)
    return "".join([best.get(p, p) for p in pieces])


def garbled_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "declared_charset") -> DataFrame:
    """(doc_id, swap, odds, lost, restored) of each text with characters that only a wrong decoding put there.

    ``swap`` names the code pages (read as > written in) that explain the text best, or ``deciphered`` for a page that is not on the
    list; ``odds`` is the log odds that the text is garbled: its source's learned odds of the swap and what its distinct words
    gain by undoing it. ``lost`` tells whether it holds replacement characters, ``restored`` is the text as its author wrote it, or null
    where only replacement characters are left. Words are restored one by one, those of one-byte swaps by translate() where
    that makes them likelier. Character references are read as characters. Null ids and null texts are left out; a null source is
    a source; empty and plain ASCII texts are never cases; repeated rows are judged each by itself.
    """
    kind = dict(docs.dtypes)[doc_id]
    base = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"))
    shared = docs.sparkSession.sparkContext.broadcast(learned(base.select("source", "text")))
    found = base.select("doc", "text", "source").mapInArrow(_judged(shared), f"doc {kind}, swap string, odds double, lost boolean, restored string")
    return found.withColumnRenamed("doc", doc_id)
