"""Rows that fail to parse, against a plain one-line parser."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.operators import records

GOOD = "\t".join(["GCF_700000001.1", "n", "o", *[""] * 8, "2020-02-29", "", "7"])


def plain(line):
    """Fields of a line, or the reason and place of broken quoting."""
    out, i = [], 0
    data = line.encode()
    while True:
        if data[i : i + 1] == b'"':
            start, i, cell = i, i + 1, b""
            while True:
                j = data.find(b'"', i)
                if j < 0:
                    return None, "unclosed quote", start
                cell += data[i:j]
                if data[j + 1 : j + 2] != b'"':
                    break
                cell, i = cell + b'"', j + 2
            i = j + 1
            if i < len(data) and data[i : i + 1] != b"\t":
                return None, "text after closing quote", i
        else:
            j = data.find(b"\t", i)
            j = len(data) if j < 0 else j
            cell, i = data[i:j], j
        out.append(cell.decode())
        if i == len(data):
            return out, None, -1
        i += 1


def same(lines):
    got = records.tokenize(lines)
    for line, fields, reason, at in zip(lines, got["fields"], got["reason"], got["at"]):
        assert (fields, reason, at) == plain(line), line


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet='"\tab é\n', max_size=40), min_size=1, max_size=12))
def test_tokenizer_equals_plain_parser(lines):
    same(lines)


@pytest.mark.parametrize("size", [1, 127, 128, 129, 100_000])
def test_long_records_cross_chunks(size):
    rnd = random.Random(size)
    same(['"' + "x" * size + '"\t' + "".join(rnd.choice('"\ta') for _ in range(size)), "a" * size, '"' * size, "\t" * size, '"' + "\t" * size])


def test_states_need_no_chunk_size():
    rnd = random.Random(5)
    kinds = records.np.array([rnd.randrange(4) for _ in range(5000)], records.np.uint8)
    want, state = [], 0
    for k in kinds:
        state = records.NEXT[state, k]
        want.append(state)
    for chunk in (1, 3, 128, 9999):
        assert records.states_after(kinds, chunk).tolist() == want


def raw(spark, *lines):
    return spark.createDataFrame([(i, x, "keep", "clash") for i, x in enumerate(lines)], "raw_id bigint, line string, file_name string, assembly_name string")


def test_reasons_and_loaded_rows(spark):
    date = lambda d: GOOD.replace("2020-02-29", d)
    lines = [
        GOOD, GOOD + "\r", GOOD, None, "", " \t ", "Assembly Accession\tx", "﻿Assembly Accession", '"Assembly Accession"', GOOD + "\t", GOOD[:-2],
        GOOD.replace("GCF", "GCX"), " " + GOOD, date(" 2020-02-28 "), date(""), date("2021-02-29"), date("0000-01-01"), date("20200229"), date("2020-02-29T"),
        GOOD.replace("\tn\t", '\t"n\t'), GOOD.replace("\tn\t", '\t"n"x\t'), GOOD.replace("\tn\t", '\t"a ""b"" \tc"\t'), GOOD.replace("\tn\t", '\tn "q" n\t'), GOOD + "\n",
        GOOD.replace("700000001.1", "700000001."), GOOD.replace("\t7", "\tseven"),
    ]
    read = records.read_records(raw(spark, *lines))
    bad = {r.raw_id: (r.error_reason, r.error_at) for r in records.failed_rows(read).collect()}
    assert bad == {
        9: ("wrong field count", len(GOOD) + 1), 10: ("wrong field count", len(GOOD) - 2), 11: ("invalid accession", 0), 15: ("invalid release date", 28), 16: ("invalid release date", 28),
        17: ("invalid release date", 28), 18: ("invalid release date", 28), 19: ("unclosed quote", 16), 20: ("text after closing quote", 19), 24: ("invalid accession", 0),
    }
    good = {r.raw_id: r for r in records.valid_rows(read).collect()}
    assert set(good) == {0, 1, 2, 12, 13, 14, 21, 22, 23, 25}
    assert good[0].file_name == "keep" and good[0].assembly_name == "n" and good[0].assembly_stats_number_of_scaffolds == 7
    assert good[21].assembly_name == 'a "b" \tc' and str(good[13].assembly_release_date) == "2020-02-28" and good[14].assembly_release_date is None
    assert good[25].assembly_stats_number_of_scaffolds is None


def test_empty_and_clashing_columns(spark):
    read = records.read_records(raw(spark, GOOD).limit(0))
    assert records.failed_rows(read).count() == records.valid_rows(read).count() == 0
    more = raw(spark, "x", GOOD).withColumns({"record_": F.lit(1), "error_reason": F.lit(2), "organism_name": F.lit(3)})
    read = records.read_records(more)
    assert records.failed_rows(read).first().error_reason == "wrong field count"
    assert records.valid_rows(read).first().organism_name == "o"
