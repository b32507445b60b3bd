"""Url parts and rules against plain Python, the regression against a one-machine fit and on held-out urls."""

import collections
import random

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from runlens.llm import url_filter as u

RULES = u.rules_of(["allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/", "allow x.net", "block net/"])


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for end in "?#":
        rest = rest.split(end, 1)[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def rule(url):
    host, path = parts(url)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(str(r)), not r.allow), default=None)


URLS = [
    None, "", "no scheme", "://", "http://", "http:///", "http://a.example.org/es/1", "http://EXAMPLE.ORG/en/12?x=1", "http://example.org/en/2", "http://org/", "http://borg/",
    "http://org", "http://example.org?/es/", "http://example.org#/es/", "http://É.x.com/de/", "http://x.com/fr/://y.org/", "a://b://c.org/", "http://x.com:80/de/", "http://x.net",
    "http://y.x.net/a", "http://y.net/a", "http://x.com/de\n/", "http://x.com/de/\n?", "https://user@x.com/fr/", "http://x.com/" + "ab/" * 20_000, "http://" + "long." * 4_000 + "org/",
    "http://x.com/fr/\U0001f600", " http://x.org/ ",
]


def frame(spark, urls):
    return spark.createDataFrame([(i, x, "h", "p", 1.0, True) for i, x in enumerate(urls)], "page_id long, url string, host string, path string, score double, verdict boolean")


def test_parts_and_rules_equal_plain_python(spark):
    urls = URLS + URLS[:9]
    got = u.judged(frame(spark, urls), RULES).orderBy("page_id").collect()
    assert len(got) == len(urls)
    for row, url in zip(got, urls):
        found = rule(url)
        assert (row["host"], row["path"]) == parts(url), url
        assert row["rule"] == (found and str(found)), url
        if found:
            assert row["verdict"] == ("allow" if found.allow else "block")
        assert row["verdict"] == ("allow" if (found.allow if found else row["score"] >= 0.5) else "block")


def test_no_rows_no_labels(spark):
    assert u.judged(frame(spark, []), RULES).count() == 0
    out = u.judged(frame(spark, URLS), []).collect()
    assert {(r["rule"], r["verdict"], r["score"]) for r in out} == {(None, "allow", None)}
    only = frame(spark, URLS[:4]).select("url", F.lit(False).alias("allow"))
    assert {r["verdict"] for r in u.judged(frame(spark, URLS), [], only).collect()} == {"allow"}


def made(seed, n):
    """Urls whose label hangs on words in host and path, with words that say nothing."""
    rng = random.Random(seed)
    good, bad, plain = "library school garden museum".split(), "casino bets pills jackpot".split(), "blue north river page seven home".split()
    rows = []
    for _ in range(n):
        ok = rng.random() < 0.7
        words = [rng.choice(good if ok else bad), rng.choice(plain), rng.choice(plain)]
        rng.shuffle(words)
        rows.append((f"http://{words[0]}-{words[1]}{rng.randrange(99)}.net/{words[2]}/{rng.randrange(9999)}", ok))
    return rows


def test_held_out_accuracy(spark):
    labelled = spark.createDataFrame(made(1, 300), "url string, allow boolean")
    rows = made(2, 400)
    got = u.judged(frame(spark, [x for x, _ in rows]), [], labelled).collect()
    assert sum((r["verdict"] == "allow") == rows[r["page_id"]][1] for r in got) >= 0.98 * len(rows)


def test_fit_equals_one_machine(spark):
    labelled = spark.createDataFrame(made(3, 120) + [("http://twice.net/", True), ("http://twice.net/", False), ("http://none.net/", None)], "url string, allow boolean")
    rows = labelled.withColumns(u.url_parts(F.col("url"))).select("host", "path", "allow")
    model = u.fit(rows, slots=40)
    once = rows.where("allow is not null").groupBy("host", "path").agg(F.min("allow").alias("allow"))
    data = u.hashed(once, 40).select(vector_to_array("__features").alias("x"), "allow").collect()
    x, y = np.array([r["x"] for r in data]), np.array([r["allow"] for r in data], dtype=float)
    w = np.where(y == 1, 1 / (2 * y.sum()), 1 / (2 * (1 - y).sum()))
    x1, theta, ridge = np.hstack([x, np.ones((len(x), 1))]), np.zeros(41), np.append(np.full(40, u.PENALTY), 0)
    for _ in range(60):  # Newton's steps
        p = 1 / (1 + np.exp(-x1 @ theta))
        slope = x1.T @ (w * (p - y)) + ridge * theta
        theta -= np.linalg.solve((x1 * (w * p * (1 - p))[:, None]).T @ x1 + np.diag(ridge + 1e-12), slope)
    assert np.abs(x @ model.coefficients.toArray() + model.intercept - x1 @ theta).max() < 1e-2


def test_labels_are_bounded_by_hash_order(spark):
    labelled = spark.createDataFrame(made(4, 200), "url string, allow boolean")
    rows = labelled.withColumns(u.url_parts(F.col("url"))).select("host", "path", "allow")
    a, b = (u.fit(r, most=50) for r in (rows, rows.repartition(7, "path")))
    assert np.allclose(a.coefficients.toArray(), b.coefficients.toArray(), atol=1e-6)


def test_no_python_in_the_plan(spark):
    plan = u.judged(frame(spark, URLS), RULES)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange", "Join"))


def test_longest_rule_wins_and_ties_block():
    assert [str(r) for r in RULES][:2] == ["org/", "example.org/es/"]
    assert collections.Counter(r.allow for r in RULES) == {True: 3, False: 4}
