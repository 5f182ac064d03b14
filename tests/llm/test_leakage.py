"""Leaked passages against a brute-force search."""

import random

import pytest

from strandloom.llm import leakage


def brute(docs, items, n=12):
    out = set()
    for d, t in docs:
        have = leakage.words(t)
        grams = {tuple(have[i : i + n]) for i in range(len(have) - n + 1)}
        for i, u in items:
            w = leakage.words(u)
            if any(tuple(w[j : j + n]) in grams for j in range(len(w) - n + 1)):
                out.add((d, i))
    return out


def made(seed=0):
    rnd = random.Random(seed)
    words = [f"w{i}é" for i in range(60)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, say(rnd.choice([5, 11, 12, 13, 40]))) for i in range(40)]
    items += [(100, items[4][1] + " tail"), (101, "same " * 30)]
    docs = []
    for d in range(120):
        parts = say(30).split()
        for _ in range(rnd.choice([0, 1, 2])):
            w = rnd.choice(items)[1].split()
            a = rnd.randrange(max(1, len(w) - 8))
            parts[rnd.randrange(len(parts)) : 0] = w[a : a + rnd.choice([8, 11, 12, 13, 30])]
        text = " ".join(parts)
        docs.append((d, rnd.choice([text, text.upper().replace("É", "E"), text.replace(" ", " — ", 9), text.replace(" ", "\n\t")])))
    docs += [(900, "same " * 12), (901, "same " * 11), (902, ""), (903, "x " * 50_000 + items[2][1])]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string")


@pytest.mark.parametrize("bits", [leakage.SIEVE_BITS, 6, 9])
def test_against_brute_force(spark, bits):
    """Also with sieves that are full: they only let more through."""
    docs, items = made()
    got = leakage.leaked_items(*frames(spark, docs, items), bits=bits).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items) and len(got) == len(brute(docs, items)) > 10
    assert {(r.doc_id, r.item_id): r.words for r in got}[900, 101] == 12


def test_nulls_repeats_clashes_and_empty(spark):
    text = " ".join(f"word{i}" for i in range(14))
    docs = spark.createDataFrame([(1, text, 5, "c"), (1, text, 5, "c"), (2, None, 5, "c"), (None, text, 5, "c")], "doc_id bigint, text string, start int, words string")
    items = spark.createDataFrame([(7, text, "c"), (7, text, "c"), (8, None, "c"), (None, text, "c"), (9, "", "c")], "item_id bigint, text string, shingles string")
    assert [tuple(r) for r in leakage.leaked_items(docs, items).collect()] == [(1, 7, 14)]
    assert leakage.leaked_items(docs.limit(0), items).count() == leakage.leaked_items(docs, items.limit(0)).count() == 0
    with pytest.raises(ValueError):
        leakage.leaked_items(docs, items, passage=3)


def test_words():
    assert leakage.words("Ångström's ΣΑΣ_x  straße—20²") == ["angstrom", "s", "σασ", "x", "strasse", "202"]
