"""Token ids against the public library, and exact round trips."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import tokens

PATH = f"{tokens.DIRECTORY}/{tokens.VOCABULARY}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no public vocabulary")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {t: i for i, t in enumerate(tokens.read_vocabulary(PATH))}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ours(texts, states=tokens.STATES):
    parts, split = tokens._Parts(tokens.Transducer(tokens.read_vocabulary(PATH), states)), tokens.regex.compile(tokens.PATTERN).findall
    flat, each = parts.encode([split(t) for t in texts])
    ends = each.cumsum()
    return [flat[e - n : e].tolist() for e, n in zip(ends, each)]


def texts():
    rnd = random.Random(1)
    mixed = lambda: "".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 1200), rnd.randrange(0x3040, 0x30FF), rnd.randrange(0x1F300, 0x1F600)])) for _ in range(300))
    return ["", "a", "<|endoftext|> x", "  two  spaces\n\n\tand", "日本語" * 60, "ÃÂ" * 60, " " * 300, "a" * 700, "é̀" * 30, "it's IT'S 12345", *[mixed() for _ in range(60)]]


@pytest.mark.parametrize("states", [50, tokens.STATES])
def test_ids_equal_the_library(library, states):
    assert ours(texts(), states) == [library.encode_ordinary(t) for t in texts()]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=30).map(lambda b: b.decode("utf-8", "replace")), min_size=1, max_size=5))
def test_any_text(library, some):
    assert ours(some) == [library.encode_ordinary(t) for t in some]


def test_frame_with_null_empty_long_and_repeated_rows(spark, library):
    long = "çà et là " * 200_000
    df = spark.createDataFrame([(1, "héllo", 9), (1, "héllo", 9), (2, None, 9), (3, "", 9), (None, "x", 9), (4, long, 9)], "doc_id bigint, text string, ids int")
    got = tokens.encoded(df).collect()
    assert sorted((r.doc_id or 0, len(r.ids)) for r in got if r.doc_id != 4) == [(0, 1), (1, 3), (1, 3), (2, 0), (3, 0)]
    assert next(r.ids for r in got if r.doc_id == 4) == library.encode_ordinary(long)
    back = tokens.decoded(tokens.encoded(df)).collect()
    assert sorted(((r.doc_id or 0), r.text) for r in back) == [(0, "x"), (1, "héllo"), (1, "héllo"), (2, ""), (3, ""), (4, long)]
    assert tokens.encoded(df.limit(0)).count() == 0


def test_decoding_strange_ids(spark):
    df = spark.createDataFrame([(1, [-1, 15496, None, 10**6]), (2, None)], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.text for r in tokens.decoded(df).collect()} == {1: "�Hello��", 2: ""}


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.binary(max_size=20), st.text(max_size=8).map(lambda t: t.encode())), st.lists(st.integers(0, 20), max_size=4))
def test_stream_of_bytes_is_cut_anywhere(data, cuts):
    stream, at, out = tokens.Utf8Stream(), 0, ""
    for c in sorted(cuts):
        out += stream.push(data[at:c])
        at = max(at, c)
    assert out + stream.push(data[at:]) + stream.close() == data.decode("utf-8", "replace")
