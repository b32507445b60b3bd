"""Fill-in-the-middle on awkward rows, against a plain rewrite."""

import collections
import hashlib
import re

import helpers as h
import pytest
from hypothesis import given, settings, strategies as st
from runlens.llm import fill_in_middle as fim


def plain(doc_id, text):
    text = text or ""
    draws = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, b = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or draws[2] % 100 >= 90:
        return n, "plain", None, None, text
    if draws[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def rows():
    odd = ["<", "<<P", "a<P>b", "x" * 200_000, "日本語 a\U0001f600b\r\n" * 9000, "<M", "\u0000é", "<S<P<M" * 50]
    more = [(1000 + 37 * i + j, t) for i, t in enumerate(odd) for j in range(12)]
    return [(d, t, None, "x", 1, 2.5) for d, t in more] + h.awkward_rows()


def test_rows_equal_the_plain_version(spark):
    own = rows()
    got = fim.digests(h.awkward(spark, own).repartition(5)).collect()
    want = collections.Counter()
    for d, t, *_ in own:
        *head, out = plain(d, t)
        want[(d, *head, sha(out), sha(t))] += 1
    assert collections.Counter(map(tuple, got)) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_texts_equal_the_plain_version(spark):
    got = fim.transformed(h.awkward(spark, rows())).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter((d, *plain(d, t)) for d, t, *_ in rows())
    assert fim.digests(h.awkward(spark, [])).count() == 0 and fim.transformed(h.awkward(spark, [])).count() == 0


def test_copies_of_a_row_are_not_one_group(spark):
    same = spark.range(0, 4000, 1, 16).selectExpr("cast(null as long) doc_id", "'one two three' text")
    out = fim.digests(same)
    assert out.count() == 4000 and out.distinct().count() == 1
    homes = fim.pieces(same).groupBy(*fim.KEY).count()
    assert homes.count() == 16


def test_one_shuffle(spark):
    plan = fim.digests(h.awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab<>PSM é\n\U0001f600", max_size=60), st.lists(st.integers(0, 2**32 - 1), min_size=4, max_size=4), st.integers(1, 9))
def test_any_cut_restores(text, draws, size):
    head, parts = fim.cut_text(text.encode(), draws)
    out = b"".join(parts)
    assert head[0] == len(re.findall("[A-Za-z]+|[^A-Za-z]", text))
    chopped = (out[i : i + size] for i in range(0, len(out), size))
    pieces = sorted(enumerate(fim.restored(head[1], chopped)), key=lambda p: (p[1][0], p[0]))
    assert b"".join(p for _, (_, p) in pieces) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é\n\U0001f600", max_size=80), st.integers(4, 9))
def test_pieces_are_whole_units(text, most):
    import numpy as np

    data = np.frombuffer(text.encode(), dtype=np.uint8).copy()
    found = [bytes(data[a:b]) for a, b in fim.cuts(fim.unit_starts(data), 0, len(data), most)]
    assert b"".join(found) == text.encode() and all(0 < len(p) <= most for p in found)
    for p, q in zip(found, found[1:]):
        assert not (p[-1:].isalpha() and q[:1].isalpha()) or len(p) == most
        p.decode()


def test_marks_that_could_be_mistaken_are_refused():
    with pytest.raises(ValueError):
        fim.Plan(prefix="<P<")
