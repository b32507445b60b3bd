"""The prefix tree and its ranked tour against plain recursion."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F
from runlens.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string, c int, depth string, key long, id long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "d", 2, 3) for r in rows], SCHEMA)


def plain(rows, rebuild=True):
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, turns in own.items():
        if c is None or not rebuild:
            convs[c] = turns
            continue
        h = zlib.crc32(str(c).encode()) % 6
        base = int(c / 100) * 100
        convs[c] = own.get(base, [])[:h] + turns[h:]
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = collections.defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved, low = {}, {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
        low[k] = min((c for c in members[k] if c is not None), default=None)
    out = collections.Counter()
    for k, who in members.items():
        ends = sorted((c for c in who if len(convs[c]) == len(k)), key=lambda c: (c is not None, c or 0))
        listed = ",".join("null" if c is None else str(c) for c in ends)
        out[low[k], len(k), low[k[:-1]] if k else None, len(who), len(kids[k]), leaves[k], saved[k], hashlib.sha256(listed.encode()).hexdigest()] += 1
    return out


def differing(got, want):
    got = collections.Counter(map(tuple, got))
    return [*(got - want), *(want - got)][:5]


def awkward():
    rng = random.Random(5)
    rows = [(None, 0, "user", "null id"), (None, None, None, None), (1, None, "user", "first"), (1, None, "user", "first"), (1, 0, None, "x"), (1, 0, "assistant", None),
            (2, 5, "user", "a:b"), (2, 5, "user", "a"), (3, 1, "use", "ra"), (3, 2, "user", "a"), (-7, 0, "user", "neg"), (-107, 0, "user", "neg"), (-100, 0, "user", "basis"),
            (9_000_000_000, 0, "user", "x" * 100_000), (9_000_000_001, 0, "user", "x" * 100_000), (9_000_000_001, 1, "assistant", "\U0001f600é")]
    for c in range(100, 420):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"say {rng.randrange(2 + t)}"))
    rows += [(500, t, "user", "again") for t in range(90)] + [(501, t, "user", "again") for t in range(120)]
    return rows


@pytest.mark.parametrize("base,stretch,chunk", [(20_000, 8_192, 1 << 15), (5, 7, 12)])
def test_tree_equals_recursion(spark, monkeypatch, base, stretch, chunk):
    for name, value in (("BASE", base), ("STRETCH", stretch), ("CHUNK", chunk)):
        monkeypatch.setattr(ct, name, value)
    rows = awkward()
    got = ct.shared_trie(frame(spark, rows).repartition(3)).collect()
    assert not differing(got, plain(rows))


def test_conversations_as_they_are(spark):
    rows = awkward()[:40]
    got = ct.conversation_trie(frame(spark, rows)).collect()
    assert not differing(got, plain(rows, rebuild=False))


def test_no_rows(spark):
    assert ct.shared_trie(frame(spark, [])).count() == 0


def test_a_list_is_ranked_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(ct, "BASE", 10)
    order = list(range(1, 700))
    random.Random(1).shuffle(order)
    order = [0, *order]
    rows = [(a, b, a % 5, 1) for a, b in zip(order, [*order[1:], None])]
    got = {r["arc"]: (r["p"], r["q"]) for r in ct.prefix_sums(spark.createDataFrame(rows, "arc long, next long, u long, v long")).collect()}
    p = 0
    for i, a in enumerate(order):
        assert got[a] == (p, i)
        p += a % 5
    assert ct.prefix_sums(spark.createDataFrame([], "arc long, next long, u long, v long")).count() == 0


def test_members_of_a_hot_node_travel_as_few_rows(spark, monkeypatch):
    ends = spark.range(0, 50_000, 1, 8).select(F.unhex(F.lit("00")).alias("key"), F.col("id").alias("conv_id"))
    want = hashlib.sha256(",".join(map(str, range(50_000))).encode()).hexdigest()
    assert [r["ends_sha256"] for r in ct.member_digests(ends.repartition(5)).collect()] == [want]
