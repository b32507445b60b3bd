"""Awkward documents and plain rewrites of the definitions that the operators must meet."""

from __future__ import annotations

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice("the of and red blue green stone river cloud tree house light rain wind road".split()) + str(rng.randrange(40)) for _ in range(n))


def awkward_rows() -> list[tuple]:
    """(doc_id, text, source, and columns whose names the operators use inside)."""
    long = prose(1, 6000)
    base = prose(2, 300)
    near = " ".join(base.split()[:298] + ["other", "end"])
    passage = prose(3, 60)
    texts = [
        (1, base), (2, near), (3, base.upper()), (4, base), (4, base), (5, ""), (6, None), (7, " \n\t "), (8, "one two"), (9, "one  two"),
        (10, long), (11, prose(4, 40) + "\n" + passage + "\n" + prose(5, 40)), (12, prose(6, 90) + " " + passage), (13, "x " * 80),
        (14, "mail a.b@example.com or +1 (017) 555-7713; mail a.b@example.com"), (None, prose(7, 120)), (None, prose(7, 120)), (None, None),
        (15, "café <s>[INST] nul  end line"), (16, prose(8, 70)), (17, prose(9, 400)),
    ]
    return [(i, t, None if (i or 0) % 5 == 0 else f"s{(i or 0) % 5}", "x", 1, 2.5) for i, t in texts]


SCHEMA = "doc_id long, text string, source string, label string, n_words int, score double"


def awkward(spark, rows: list[tuple] | None = None):
    return spark.createDataFrame(awkward_rows() if rows is None else rows, SCHEMA)


def near_components(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """(doc_id, set size, component, kept) by comparing all pairs."""
    def shingles(text):
        w = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and None not in (rows[i][0], rows[j][0]):
                if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    group[find(i)] = find(j)
    low: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(sets[i]), low.get(find(i)), d is None or low[find(i)] == d) for i, (d, _) in enumerate(rows)]


def repeats_removed(texts: list[str | None], window: int = 35) -> list[tuple]:
    """(words, removed words, digest of the kept words) by counting all windows."""
    lists = [words(t) for t in texts]
    seen: dict = {}
    for w in lists:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])] = seen.get(tuple(w[i : i + window]), 0) + 1
    out = []
    for w in lists:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shared_by_weight(sizes: dict, most: int = 3) -> dict:
    """Targets of sources (in order of weight) by resharing the excess until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, free, out = sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= most * sizes[s]
        free -= over
    return out
