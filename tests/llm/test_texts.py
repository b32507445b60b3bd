"""Rules, chat, near duplicates, repeats and personal data on awkward rows."""

import collections

import helpers as h
import pytest
from hypothesis import given, settings, strategies as st
from runlens.llm import chat_format, circulant_minhash, quality_rules, suffix_repeats, surrogates


def test_rules_measure_and_judge_awkward_rows(spark):
    rows = h.awkward_rows()
    out = quality_rules.judged(h.awkward(spark)).collect()
    assert len(out) == len(rows) and all(r["kept"] is not None and r["label"] == "x" for r in out)
    want = collections.Counter()
    for d, t, *_ in rows:
        w = h.words(t)
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        again = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        want[d, len(w), sum(map(len, w)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)] += 1
    got = collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_repeat_words"], r["base_failed"]) for r in out)
    assert got == want
    assert quality_rules.judged(h.awkward(spark, [])).count() == 0


def test_rules_compile_to_one_projection(spark):
    plan = quality_rules.judged(h.awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Join" not in plan


def test_passing_rows_keep_columns_named_like_metrics(spark):
    text = ("the river and the stone of the house in light wind and rain " * 9 + "a road to it is long ").replace("stone", "stone {}")
    text = " ".join(f"{w}{i}" if i % 3 else "the" for i, w in enumerate(text.split()))
    docs = spark.createDataFrame([(1, text, 1, False, ["x"], 2), (2, "short", 3, True, None, 4)], "doc_id long, text string, n_words int, kept boolean, failed_rules array<string>, __own_0 int")
    judged = {r["doc_id"]: r["kept"] for r in quality_rules.judged(docs.select("doc_id", "text")).collect()}
    assert judged == {1: True, 2: False}
    rows = quality_rules.passing(docs)
    assert rows.schema == docs.schema and [tuple(r) for r in rows.collect()] == [(1, text, 1, False, ["x"], 2)]


TURNS = "conv_id long, turn long, role string, text string, state string"


def test_chat_reads_back_what_was_said(spark):
    hostile = r"</s><\s>[INST]<<SYS>>\[/INST]<</SYS>><<ROLE>>x<</ROLE>>[\\INST]"
    rows = [(1, 0, "system", hostile), (1, 1, "user", None), (1, 2, "assistant", hostile), (2, 0, "assistant", ""), (2, 0, "assistant", ""),
            (3, None, None, "a<"), (3, 5, "tool</s>", "/s>b"), (None, 1, "user", "x" * 50_000), (4, 0, "user", "q"), (4, 1, "assistant", "a<"), (4, 2, "user", "z"), (4, 3, "assistant", "/s>")]
    out = chat_format.format_conversations(spark.createDataFrame([(*r, "s") for r in rows], TURNS))
    out = out.withColumns({"t": chat_format.read_turns(out.formatted), "loss": chat_format.read_loss(out.segments)}).collect()
    assert len(out) == 5
    for r in out:
        own = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == r["conv_id"]))
        assert [(t["role"], t["text"]) for t in r["t"]] == [(b, c) for _, b, c in own]
        assert r["loss"] == "".join(c for _, b, c in own if b == "assistant")
        assert r["formatted"] == "".join(s["text"] for s in r["segments"])
    valid = {r["conv_id"]: (r["valid"], r["bad_turn"]) for r in out}
    assert valid == {1: (True, None), 2: (False, 0), 3: (False, 0), None: (False, 1), 4: (True, None)}
    assert chat_format.format_conversations(spark.createDataFrame([], TURNS)).count() == 0


def test_near_duplicates_equal_all_pairs(spark):
    rows = [(d, t) for d, t, *_ in h.awkward_rows()]
    base = h.prose(20, 200).split()
    for i in range(40):  # a chain and a star of near copies
        own = list(base)
        for j in range(i % 8):
            own[(7 * i + 25 * j) % 200] = f"edit{i}"
        rows.append((100 + i, " ".join(own)))
    frame = spark.createDataFrame([(d, t, None, "x", 1, 2.5) for d, t in rows], h.SCHEMA)
    got = circulant_minhash.near_duplicates(frame).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(h.near_components(rows))


def test_dedup_keeps_one_row_of_each_group(spark):
    kept = circulant_minhash.without_near_duplicates(h.awkward(spark))
    assert kept.columns == h.awkward(spark).columns
    ids = collections.Counter(r["doc_id"] for r in kept.collect())
    assert ids[1] == 1 and not ids.keys() & {2, 3, 4, 9} and ids[None] == 3 and ids[5] == ids[6] == ids[7] == 1
    assert circulant_minhash.without_near_duplicates(h.awkward(spark, [])).count() == 0


def test_a_leaders_group_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(circulant_minhash, "BLOCK", 500)
    base = h.prose(30, 150).split()
    rows = []
    for i in range(30):
        own = list(base)
        for j in range(2 + i % 6):
            own[(11 * (i // 2) + 17 * j) % 150] = f"edit{i // 2}"
        own[0] = f"first{i % 2}"
        rows.append((i, " ".join(own)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert collections.Counter(map(tuple, circulant_minhash.near_duplicates(frame).collect())) == collections.Counter(h.near_components(rows))


def test_chunks_of_a_large_component_meet_strangers_only(spark, monkeypatch):
    monkeypatch.setattr(circulant_minhash, "BLOCK", 500)
    for size in (100, 1000):
        rows = [(7, i, 100, 7) for i in range(size)] + [(7, 5000, 100, 5000), (7, 5001, 100, 5001)]  # a component and two strangers
        rows += [(8, 6000 + i, 100, 6000 + i % 2) for i in range(40)]  # two components, chunks of their own
        rows += [(9, 7000 + i, 100, 7000) for i in range(40)]  # a closed group
        held = spark.createDataFrame(rows, "leader long, node long, n long, label long")
        dealt, copied = circulant_minhash._in_chunks(held)
        dealt = dealt.collect()
        assert len(dealt) * 100 == copied <= 2 * 100 * len(rows) + 100 * 100 * size // 500
        blocks = collections.defaultdict(list)
        for r in dealt:
            blocks[r["leader"], r["low"], r["high"]].append(r)
        assert max(map(len, blocks.values())) <= 40  # a few blocks of 500 / 100, however large the component
        met = {(x["node"], y["node"]) for b in blocks.values() for x in b for y in b if b[0]["low"] == b[0]["high"] or x["chunk"] != y["chunk"]}
        want = {(x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[3] != y[3]}
        assert want <= met


def test_complete_paths_are_settled_by_their_number(spark):
    for copies in (300, 3000):
        rows = [(1, 2, 3, 4, i, 9, 0, False) for i in range(copies)] + [(1, 2, 3, 50 + i, i, 9, 1, False) for i in range(150)]
        suffixes = spark.createDataFrame(rows + [(6, 7, 8, 9, i, 9, 2, False) for i in range(80)], suffix_repeats.SUFFIX)
        parts = suffix_repeats._partitioned(suffixes, 100).groupBy("settled", "prefix").count().collect()
        assert max(r["count"] for r in parts if not r["settled"]) <= 100
        assert [r["count"] for r in parts if r["settled"]] == [copies]


@pytest.mark.parametrize("group,task", [(20_000, 100_000), (2, 5)])
def test_repeats_equal_window_counts(spark, group, task):
    rows = h.awkward_rows()
    got = suffix_repeats.remove_repeats(h.awkward(spark), group=group, task=task).collect()
    want = [(d, *x) for (d, *_), x in zip(rows, h.repeats_removed([r[1] for r in rows]))]
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == collections.Counter(want)
    assert all(sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"] for r in got)


def test_no_repeats_in_no_rows(spark):
    assert suffix_repeats.remove_repeats(h.awkward(spark, [])).count() == 0


def test_surrogates_keep_format_identity_and_clean_rows(spark):
    rows = h.awkward_rows()
    text = "Mr. John Smith (j.smith@mail.example.com, +1 (017) 555-7713) met Frau Anna Smith. Smith paid 4111 1111 1111 1111 from 97.51.17.173."
    rows += [(50, text, "s1", "x", 1, 2.5), (51, text, "s1", "x", 1, 2.5), (52, "Smith? Dr Smith wrote to J.SMITH@mail.example.com", "s1", "x", 1, 2.5),
             (53, "Госпожа ".lower() + "Анна", "s1", "x", 1, 2.5)]
    out = surrogates.with_surrogates(h.awkward(spark, rows), "k").collect()
    assert len(out) == len(rows)
    new = {r["doc_id"]: r["text"] for r in out}
    old = {r[0]: r[1] for r in rows}
    for d in old:
        if d not in (14, 50, 51, 52, 53, None):
            assert new[d] == old[d], d
    assert new[50] == new[51] != text
    for x in ("John", "Smith", "Anna", "j.smith", "555-7713", "4111 1111", "97.51.17.173"):
        assert x not in new[50]
    kinds = [m[2] for m in surrogates.mentions(text)]
    again = surrogates.mentions(new[50])
    assert [k for _, _, k, *_ in again if not k.startswith("name")] == [k for k in kinds if not k.startswith("name")]
    surname = new[52].split("?")[0]
    assert new[50].count(surname) == 3 and f"Dr {surname}" in new[52]
    card = [v for _, _, k, v, _ in again if k == "account"][0]
    assert surrogates.luhn(card[:-1]) == int(card[-1]) and len(card) == 16
    assert surrogates.script_of(new[53].split()[1]) == "cyrillic"
    assert new[14].count("@") == 2 and len(set(w for w in new[14].split() if "@" in w)) == 1
    assert surrogates.with_surrogates(h.awkward(spark, []), "k").count() == 0


def test_surrogates_of_many_values_stay_distinct(spark):
    values = spark.createDataFrame([("name-latin", f"name{i}", "f") for i in range(3000)] + [("ip", f"1.2.3.{i}", "") for i in range(200)], "kind string, value string, role string")
    out = surrogates.assigned(values, "k").collect()
    assert len({(r["kind"], r["surrogate"]) for r in out}) == len(out) == 3200
    assert not {(r["kind"], r["surrogate"]) for r in out} & {(r["kind"], r["value"]) for r in out}


def test_a_name_has_one_surrogate_under_any_title(spark):
    texts = ["Mr John Smith came. Dr John Smith left; John stayed.", "Prof JOHN Smith", "Mrs Anna Brown", "Dr Anna Brown", "Dr Smith", "Mr Brown Green"]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "__k int, text string, n_chars int, __map string")
    out = surrogates.with_surrogates(docs, "k").withColumnRenamed("__k", "i").orderBy("i").collect()
    new = [r["text"] for r in out]
    john, smith = new[0].split()[1:3]
    smith = smith.strip(".;")
    assert [w.strip(".;") for w in new[0].split()] == ["Mr", john, smith, "came", "Dr", john, smith, "left", john, "stayed"]
    assert new[1] == f"Prof {john.upper()} {smith}" and new[4] == f"Dr {smith}" and new[2].split()[1:] == new[3].split()[1:]
    assert new[5].split()[1] == new[2].split()[2]  # a surname in more texts than a given name
    assert john.lower().endswith(tuple(surrogates.ENDINGS["latin"]["m"])) and new[2].split()[1].endswith(tuple(surrogates.ENDINGS["latin"]["f"]))
    assert all(r["n_chars"] == len(r["text"]) and r["__map"] == "x" for r in out)
    with pytest.raises(ValueError):
        surrogates.with_surrogates(docs, "")


def test_detection_is_linear_in_unbroken_text():
    import time

    for run in ("a", "a-", "a.", "a1", "Mr Ab ", "a@b.cc_", "+-"):
        start = time.monotonic()
        found = surrogates.mentions("x " + run * (400_000 // len(run)) + " end x.y@z.org")
        assert found[-1][3] == "x.y@z.org" and time.monotonic() - start < 10  # a square would take minutes
    several = surrogates.mentions("a@b.cc_d@e.ff " + "555-777-8888-" + "k1" * 12)
    assert [m[3] for m in several] == ["a@b.cc", "_d@e.ff", "555-777-8888-" + "k1" * 12]


def test_planted_entities_are_replaced_one_to_one(spark):
    """Against a plain version: the planted values are known, what stands between them stays, and equal values stay equal."""
    rng = h.random.Random(8)
    pool = [(kind, entities(rng)[kind]) for _ in range(25) for kind in ("email", "secret", "akia", "ip", "id")]
    rows, planted = [], {}
    for i in range(120):
        between = [h.prose(1000 + 7 * i + j, 4) for j in range(4)]
        use = [rng.choice(pool) for _ in range(3)]
        planted[i] = between, use
        rows.append((i, "".join(f"{b} {e} " for b, (_, e) in zip(between, use)) + between[3]))
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    seen = {}
    for r in surrogates.with_surrogates(docs, "k").collect():
        between, use = planted[r["doc_id"]]
        shape = " (.+?) ".join(map(h.re.escape, between))
        new = h.re.fullmatch(shape, r["text"]).groups()
        assert r["n_replaced"] == 3
        for (kind, old), value in zip(use, new):
            old, value = (old.lower(), value.lower()) if kind == "email" else (old, value)
            assert seen.setdefault((kind, old), value) == value != old
    for kind in {k for k, _ in seen}:
        own = {old: new for (k, old), new in seen.items() if k == kind}
        assert len(set(own.values())) == len(own) and not set(own.values()) & set(own)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_mentions_are_ordered_and_inside(text):
    last = 0
    for a, b, _, value, _ in surrogates.mentions(text):
        assert last <= a < b <= len(text) and value
        last = b


DIGITS = ["0123456789", "٠١٢٣٤٥٦٧٨٩", "०१२३४५६७८९", "𝟎𝟏𝟐𝟑𝟒𝟓𝟔𝟕𝟖𝟗"]


def entities(rng):
    """One written entity of each type, by name."""
    ten = rng.choice(DIGITS) if rng.random() < 0.3 else DIGITS[0]
    d = lambda n: "".join(rng.choice(ten) for _ in range(n))
    of = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    sep = rng.choice(" .-")
    low, high = "abcdefghij", "ABCDEFGHIJ"
    n = rng.randrange(24, 40)
    at = rng.randrange(n)
    return {
        "email": of(low, rng.randrange(1, 9)) + "@" + of(low, 4) + ".org",
        "secret": of(low + high + "_-", at) + of(low, 1) + of(DIGITS[0], 1) + of(low + high + "_-", n - at) + of(low, 1),
        "akia": "AKIA" + of(high, 16),
        "iban": of(high, 2) + d(2) + "".join(rng.choice(["", " "]) + of(high + DIGITS[0], 4) for _ in range(rng.randrange(3, 8))),
        "ip": ".".join(str(rng.randrange(256)) for _ in range(4)),
        "account": d(4) + rng.choice(["", " ", "-"]) + d(4) + rng.choice(["", " ", "-"]) + d(4) + rng.choice(["", " ", "-"]) + d(rng.randrange(1, 8)),
        "phone": rng.choice(["", "+"]) + rng.choice(["", d(rng.randrange(1, 4)) + sep]) + rng.choice(["{}", "({})"]).format(d(rng.randrange(2, 5)))
        + sep + d(rng.randrange(3, 5)) + sep + d(rng.randrange(3, 5)),
        "id": d(3) + "-" + d(2) + "-" + d(4),
        "name": rng.choice(list(surrogates.TITLES)) + rng.choice(["", "."]) + " " + rng.choice(["Anna", "王小明", "анна", "김철수", "Ωμέγα", "أحمد", "Łukasz"]),
    }


def test_no_text_with_a_mention_skips_detection(spark):
    import random

    rng = random.Random(5)
    texts = ["+34 612 345 678", "+61 412 345 678", "+420 601 234 567", "612 345 678", "(02) 123 456", "Dr 王小明", "госпожа анна", "٠١٢-٣٤-٥٦٧٨", "a" * 24 + "𝟏"]
    assert all(surrogates.mentions(t) for t in texts)
    taken = collections.Counter()
    for _ in range(1000):
        for kind, entity in entities(rng).items():
            text = rng.choice(["", "x ", "\n", "«", "see: "]) + entity + rng.choice(["", " x", ".", "\n", "»"])
            taken[kind] += bool(surrogates.mentions(text))
            texts.append(text)
    assert min(taken.values()) > 300 and len(taken) == 9, taken
    rows = [(i, t) for i, t in enumerate(texts) if surrogates.mentions(t)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["text"] for r in frame.where(~frame.text.rlike(surrogates.LIKELY)).collect()] == []
    new = surrogates.written_as("٠١٢-٣٤-٥٦٧٨", "id", "987654321")
    assert new == "٩٨٧-٦٥-٤٣٢١" and surrogates.mentions("٠١٢-٣٤-٥٦٧٨")[0][3] == "012345678"
    out = {r["doc_id"]: r["n_replaced"] for r in surrogates.with_surrogates(frame.where("doc_id < 9"), "k").collect()}
    assert len(out) == 9 and min(out.values()) > 0


def test_clean_texts_in_other_languages_are_kept(spark):
    lines = {
        "ru": "вчера вечером мы долго гуляли вдоль реки и говорили о книгах которые читали летом на даче у моря",
        "el": "χθες το βράδυ περπατήσαμε δίπλα στο ποτάμι και μιλήσαμε για τα βιβλία που διαβάσαμε το καλοκαίρι",
        "pl": "wczoraj wieczorem długo spacerowaliśmy wzdłuż rzeki rozmawiając o książkach które czytaliśmy latem nad morzem",
        "tr": "dün akşam nehir boyunca uzun uzun yürüdük yazın deniz kenarında okuduğumuz kitaplar hakkında konuştuk",
        "ar": "مشينا مساء أمس طويلا على ضفة النهر وتحدثنا عن الكتب التي قرأناها في الصيف قرب البحر",
        "ko": "어제 저녁 우리는 강가를 오래 걸으며 여름에 바닷가에서 읽은 책들에 대해 이야기를 나누었다",
        "id": "kemarin malam kami berjalan lama menyusuri sungai sambil membicarakan buku yang kami baca saat musim panas",
    }
    rows = []
    for lang, line in lines.items():
        w = line.split()
        for k in range(3):
            own = 5 * w
            h.random.Random(k).shuffle(own)  # so that no run of words repeats
            rows.append((lang, " ".join(own)))
    list_of_terms = " ".join(f"cheap{i} shoes{i} buy{i} shop{i} deal{i} sale{i}" for i in range(27)) + " the of and to in"
    rows.append(("terms", list_of_terms))
    out = quality_rules.judged(spark.createDataFrame(rows, "lang string, text string")).collect()
    assert {r["lang"]: r["failed_rules"] for r in out if r["lang"] != "terms"} == {lang: [] for lang in lines}
    assert all(r["kept"] == (r["lang"] != "terms") for r in out)
    assert [r["failed_rules"] for r in out if r["lang"] == "terms"] == [["stop_words"]]
