"""Documents without ids, and several with one id."""

import random

import pytest

from reliefgrid.llm import ngram_join, substring_dedup

R = random.Random(8)


def words(n):
    return ["".join(R.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


@pytest.fixture
def make(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def test_near_copies_of_a_copy_without_id(make):
    w = words(200)
    text, near, other = " ".join(w), " ".join([*w[:-1], "changed"]), " ".join(words(200))
    got = {(r.doc_id, r.component_id) for r in ngram_join.link_documents(make([(None, text), (5, text), (6, near), (7, other)])).collect()}
    least = -(1 << 63)
    assert got == {(least, least), (5, least), (6, least), (7, 7)}


def test_documents_of_one_id(make):
    w = words(100)
    text, near, other = " ".join(w), " ".join([*w[:-1], "changed"]), " ".join(words(100))
    got = ngram_join.dedup_documents(make([(1, text), (5, near), (5, other), (None, other), (None, text)])).collect()
    assert sorted(r.text for r in got) == sorted([text, other]) and {r.doc_id for r in got} == {None}


def test_spans_of_rows_with_one_id(make):
    passage, a, b, c = words(40), words(90), words(5), words(60)
    rows = [(None, " ".join([*passage, *a])), (None, " ".join(b)), (None, " ".join([*a, *passage])), (4, " ".join(c)), (5, " ".join(words(3))), (5, " ".join([*c, *b]))]
    got = substring_dedup.remove_repeats(make(rows), texts=True).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got} == {-(1 << 63), 4, 5}
    full = [x.split() for _, x in rows]
    kept = sorted(r.kept for r in got)
    first, later = sorted([rows[0][1], rows[2][1]])
    rest = later.split()
    # of the two rows without id the one of the greater text loses both passages, which the other holds in another order
    assert kept == sorted([first, "", rows[1][1], rows[3][1], rows[4][1], rows[1][1]]) and len(rest) == len(full[0])
    assert sum(r.n_removed for r in got) == len(rest) + len(c)
