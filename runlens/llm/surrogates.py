"""Personal data: detected entities give way to keyed surrogates of the same type and format.

Every distinct value of a type gets one surrogate in the whole corpus, so mentions that belong together stay together; collisions
between surrogates, and with values that occur, are found by joins and drawn anew until none is left.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from .common import discard, stored, text_or_empty

SETTING = "spark.runlens.surrogateKey"  # where a session may keep the key

# Titles that introduce a name, with the gender that they tell.
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "n", "Prof": "n", "Herr": "m", "Frau": "f",
    "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Señorita": "f",
    "Sr": "m", "Sra": "f", "Don": "m", "Doña": "f", "господин": "m", "госпожа": "f", "κύριος": "m", "κυρία": "f",
}
# Sounds that invented names are made of, by script; endings by gender.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga go ha he ja jo ka ke ki ko la le li lo ma me mi mo na ne ni no pa ra re ri ro sa se ta te ti to va vi".split(),
    "cyrillic": "ба бе ва ве ви га да де ди до за зо ка ке ки ко ла ле ли ло ма ме ми мо на не ни но па ра ре ри ро са се та те ти то фа".split(),
    "greek": "βα γα δα δε δη δο ζα θε κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα ρα ρε ρι ρο σα σε τα τε τι το φα".split(),
}
ENDINGS = {
    "latin": {"m": ["n", "rd", "s"], "f": ["na", "lia", "ra"], "n": ["l", "x"], "s": ["ler", "man", "sen"]},
    "cyrillic": {"m": ["н", "р"], "f": ["на", "ля"], "n": ["ль"], "s": ["ко", "ин"]},
    "greek": {"m": ["ος", "ης"], "f": ["να", "λη"], "n": ["ις"], "s": ["ου", "ίδης"]},
}

_NAME = r"[^\W\d_a-zà-ÿ][^\W\d_]+"
# Addresses and keys have parts of any length, which are tried where an unbroken run of their characters begins and nowhere else
# in it: a later start would read the run again and find nothing that the first did not.
_LOCAL, _DOMAIN = r"[\w.%+-]++(?<=\w)@", r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_EMAIL = rf"(?P<email>{_LOCAL}{_DOMAIN})"
_KEYLIKE = (
    r"(?:(?<=\w)[A-Za-z0-9_]*+-++|-*+)\b(?P<secret>(?=[A-Za-z_-]*+\d)(?=[\d_-]*+[A-Za-z])[A-Za-z0-9_-]{24,}+)"
)
PATTERN = re.compile(
    rf"(?<![\w.%+-]){_EMAIL}"
    rf"|(?<![A-Za-z0-9_-]){_KEYLIKE}"
    r"|(?P<akia>\bAKIA[0-9A-Z]{16}(?![A-Za-z0-9_-]))"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d))"
    r"|(?P<account>(?<![\d.,])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d)|(?<![\d.,])\d{13,19}(?!\d))"
    r"|(?P<phone>(?<![\w.])\+?(?:\d{1,3}[ .-])?\(?\d{2,4}\)?[ .-]\d{3,4}[ .-]\d{3,4}(?![\w]))"
    r"|(?P<id>(?<!\d)\d{3}-\d{2}-\d{4}(?!\d))"
    rf"|\b(?P<title>{'|'.join(TITLES)})\b\.?[ ](?P<name>{_NAME}(?:[ ]{_NAME})?)"
)
# What is left of a run after a match inside it is a run of its own.
RESUMED = re.compile(rf"{_EMAIL}|{_KEYLIKE}")
# What any match of PATTERN holds, for a test in Spark before Python sees the text; whatever PATTERN takes must pass. Each branch
# begins with one set of characters, so that most characters of a text fail at once. Digits are those of any script, as in Python;
# of 24 or more characters of a secret, 12 stand before or after any digit.
_D = r"[\p{Nd}\p{Cn}]"
LIKELY = (
    rf"@|{_D}(?:"
    rf"{_D}\)?[ .-]{_D}{{3}}|{_D}{{3}}[ -]?{_D}|{_D}{{0,2}}(?:\.{_D}{{1,3}}){{3}}|-{_D}{{2}}-{_D}{{4}}"
    rf"|{_D} ?[A-Z0-9]{{4}}|[A-Za-z0-9_-]{{12}}|(?<=[A-Za-z0-9_-]{{12}}.{{1,2}}))"
    r"|AKIA[0-9A-Z]{16}"
    rf"|[{''.join(sorted({t[0] for t in TITLES}))}](?<=(?:^|[^\p{{L}}]).)(?:{'|'.join(t[1:] for t in TITLES)})\.? [^ ._0-9a-zà-ÿ]"
)


def script_of(name: str) -> str:
    return "cyrillic" if "Ѐ" <= name[0] <= "ӿ" else "greek" if "Ͱ" <= name[0] <= "Ͽ" else "latin"


def _in_ascii(c: str) -> str:
    """A digit of any script as 0 to 9; other characters as they are."""
    return str(unicodedata.decimal(c)) if c.isdecimal() else c


def _found(text: str) -> Iterator[re.Match]:
    """Matches of PATTERN from left to right, in time linear in the text."""
    at, ahead = 0, PATTERN.search(text)
    while True:
        if ahead is not None and ahead.start() < at:
            ahead = PATTERN.search(text, at)
        rest = RESUMED.match(text, at) if at else None
        m = rest if rest is not None and (ahead is None or rest.start(rest.lastgroup) <= ahead.start()) else ahead
        if m is None:
            return
        yield m
        at = m.end()


def mentions(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, type, value, role) of what is replaced, from left to right. Type and value are what mentions of one entity share.

    The last word after a title is the surname (role s), a word before it the given name, whose role is the gender that the
    title tells (m, f, or n for none). A name stands for the same person under any title, and elsewhere in the text without
    one, so its bare mentions are found as well; they and all other types have an empty role.
    """
    out, names = [], {}
    for m in _found(text):
        kind = m.lastgroup
        if kind == "name":
            at = m.start("name")
            parts = m.group("name").split(" ")
            for i, part in enumerate(parts):
                role = "s" if i == len(parts) - 1 else TITLES[m.group("title")]
                kind = f"name-{script_of(part)}"
                out.append((at, at + len(part), kind, part.lower(), role))
                names.setdefault(part, kind)
                at += len(part) + 1
            continue
        value, (start, end) = m.group(kind), m.span(kind)
        kind = "secret" if kind == "akia" else kind
        plain = value.lower() if kind == "email" else value if kind == "secret" else "".join(map(_in_ascii, value))
        if kind not in ("email", "secret", "ip"):
            plain = re.sub(r"[^0-9A-Za-z]", "", plain)
        out.append((start, end, kind, plain, ""))
    if names:
        i, bare = 0, []
        for m in re.finditer(r"\w+", text):
            if m.group() in names:
                while i < len(out) and out[i][1] <= m.start():
                    i += 1
                if i == len(out) or m.end() <= out[i][0]:
                    bare.append((m.start(), m.end(), names[m.group()], m.group().lower(), ""))
        out = sorted(out + bare)
    return out


class Draw:
    """A stream of numbers keyed by secret, type, value and attempt."""

    def __init__(self, key: str, kind: str, value: str, attempt: int):
        self.seed = f"{kind}\0{value}\0{attempt}".encode()
        self.key, self.block, self.left = hashlib.sha256(key.encode()).digest(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left = hashlib.blake2b(self.seed + self.block.to_bytes(4, "big"), key=self.key).digest()
            self.block += 1
        x, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return x % n

    def like(self, c: str, hexadecimal: bool = False) -> str:
        if c.isdigit():
            return str(self.below(10))
        if c.isalpha():
            letters = "abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz"
            new = letters[self.below(len(letters))]
            return new.upper() if c.isupper() else new
        return c


def luhn(digits: str) -> int:
    """The check digit that completes ``digits``."""
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return -total % 10


def surrogate(key: str, kind: str, value: str, role: str, attempt: int) -> str:
    """A value of the same type and shape; another one for each attempt. The role of a name chooses its ending."""
    draw = Draw(key, kind, value, attempt)
    if kind.startswith("name-"):
        script = kind.removeprefix("name-")
        sounds, ends = SYLLABLES[script], ENDINGS[script][role]
        return "".join(sounds[draw.below(len(sounds))] for _ in range(2 + attempt // 8)) + ends[draw.below(len(ends))]
    if kind == "email":
        local, _, domain = value.rpartition("@")
        host, _, top = domain.rpartition(".")
        return "".join(map(draw.like, local)) + "@" + "".join(map(draw.like, host)) + "." + top
    if kind == "ip":
        first = 1 + draw.below(223)
        return ".".join(map(str, [first, *(draw.below(256) for _ in range(3))]))
    if kind == "account":
        body = str(1 + draw.below(9)) + "".join(str(draw.below(10)) for _ in value[2:])
        valid = luhn(value[:-1]) == int(value[-1])
        return body + str(luhn(body) if valid else (luhn(body) + 1 + draw.below(9)) % 10)
    if kind == "iban":
        return value[:2] + "".join(map(draw.like, value[2:]))
    if kind == "phone" and len(value) > 10:  # the country's code stays
        return value[:-10] + str(2 + draw.below(8)) + "".join(map(draw.like, value[-9:]))
    hexadecimal = kind == "secret" and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) is not None
    return "".join(draw.like(c, hexadecimal) for c in value)


def written_as(surface: str, kind: str, new: str) -> str:
    """The surrogate in the way the mention was written: separators, and capitals of names and addresses."""
    if kind.startswith("name-"):
        return new.upper() if surface.isupper() else new.capitalize()
    if kind == "email":
        return "".join(n.upper() if s.isupper() else n for s, n in zip(surface, new)) if len(surface) == len(new) else new
    if kind in ("secret", "ip"):
        return new
    fresh = iter(new)
    return "".join(_in_script(c, next(fresh)) if re.match(r"[0-9A-Za-z]", _in_ascii(c)) else c for c in surface)


def _in_script(old: str, new: str) -> str:
    """A new digit in the script of the old one; the digits of a script stand side by side."""
    return chr(ord(old) - unicodedata.decimal(old) + int(new)) if old.isdecimal() and new.isdecimal() else new


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, chars, text in zip(batch.column("key").to_pylist(), batch.column("chars").to_pylist(), batch.column("text")):
            rows += [(key, chars, *entity) for entity in sorted({m[2:] for m in mentions(text.as_py())})]
        columns = list(zip(*rows)) or [[]] * 5
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns, types)), ["key", "chars", "kind", "value", "role"])


def _rewrite(texts: pd.Series, maps: pd.Series) -> pd.DataFrame:
    out = []
    for text, pairs in zip(texts, maps):
        known = {(p["kind"], p["value"]): p["surrogate"] for p in (pairs if pairs is not None else ())}
        parts, at, n = [], 0, 0
        for a, b, kind, value, _ in mentions(text):
            if a < at:
                continue
            parts += [text[at:a], written_as(text[a:b], kind, known[kind, value])]
            at, n = b, n + 1
        out.append(("".join(parts) + text[at:], n))
    return pd.DataFrame(out, columns=["text", "n"])


def settled(found: DataFrame) -> DataFrame:
    """``kind, value, role``: one row for each entity of ``found`` (kind, value, role; a row for each text and role).

    A name is a surname if it is one in at least as many texts as it is a given name. A given name's gender is that which more
    of its titles tell, or n if none does or they tell both alike. All else has an empty role.
    """
    m, f, n, s = (F.count_if(F.col("role") == r) for r in "mfns")
    role = F.when(s + m + f + n == 0, "").when(s >= m + f + n, "s").when(m > f, "m").when(f > m, "f").otherwise("n")
    return found.groupBy("kind", "value").agg(role.alias("role"))


def assigned(values: DataFrame, key: str) -> DataFrame:
    """``kind, value, surrogate`` for each row of ``values`` (kind, value, role; an entity in one row): no two values of a kind
    share a surrogate, and none is a value.

    Of values that drew the same surrogate the smallest keeps it. A value that lost, or drew an existing value, draws again.
    """

    def draws(kinds: pd.Series, values: pd.Series, roles: pd.Series, attempts: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, k, v, r, int(a)) for k, v, r, a in zip(kinds, values, roles, attempts)], dtype=object)

    entity = ["kind", "value", "role"]
    drawn = F.pandas_udf(draws, StringType())(*entity, "attempt")
    values = stored(values.select(*entity), "entities")
    current = stored(values.withColumn("attempt", F.lit(0)).withColumn("surrogate", drawn), "surrogates")
    while True:
        owner = current.groupBy(F.col("kind").alias("k"), F.col("surrogate").alias("s")).agg(F.min("value").alias("owner"))
        real = values.select(F.col("kind").alias("rk"), F.col("value").alias("rv"))
        checked = current.join(owner, (F.col("kind") == F.col("k")) & (F.col("surrogate") == F.col("s")))
        checked = checked.join(real, (F.col("kind") == F.col("rk")) & (F.col("surrogate") == F.col("rv")), "left")
        lost = (F.col("value") != F.col("owner")) | F.col("rv").isNotNull()
        after = stored(
            checked.select(*entity, "surrogate", "attempt", lost.alias("lost"))
            .withColumn("attempt", F.col("attempt") + F.col("lost").cast("int"))
            .withColumn("surrogate", F.when(F.col("lost"), drawn).otherwise(F.col("surrogate"))),
            "surrogates",
        )
        discard(current)
        current = after.select(*entity, "attempt", "surrogate")
        if after.where("lost").isEmpty():
            return current.select("kind", "value", "surrogate")


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and ``n_replaced``; all columns stay, ``n_chars`` is set anew.

    ``key`` is the secret that the draws depend on; an empty one is refused. Null texts stay null, with 0 replaced; empty texts,
    repeated rows and null ids need no care since rows are told apart by their texts alone. A column named ``n_replaced`` is
    overwritten, any other name may occur. An empty table gives no rows.
    """
    if not key:
        raise ValueError("surrogates need a key")
    longest = max(map(len, docs.columns))
    own_key, own_chars, pairs, new = (f"_{c}".ljust(longest + 2, "_") for c in ("key", "chars", "pairs", "new"))  # no column is as long
    likely = F.coalesce(F.col("text").rlike(LIKELY), F.lit(False))
    clean = docs.where(~likely).withColumn("n_replaced", F.lit(0).cast("long"))
    rest = stored(docs.where(likely), "surrogate-texts")
    ident = [F.xxhash64("text").alias("key"), F.length("text").cast("long").alias("chars")]
    found = rest.select(*ident, "text").mapInArrow(_finder, "key long, chars long, kind string, value string, role string")
    found = stored(found.distinct(), "mentions")
    known = found.select("key", "chars", "kind", "value").distinct().join(assigned(settled(found), key), ["kind", "value"])
    known = known.groupBy(F.col("key").alias(own_key), F.col("chars").alias(own_chars)).agg(
        F.collect_list(F.struct("kind", "value", "surrogate")).alias(pairs)
    )
    rest = rest.join(known, (F.xxhash64("text") == F.col(own_key)) & (F.length("text") == F.col(own_chars)), "left")
    rewritten = F.pandas_udf(_rewrite, "text string, n long")
    rest = rest.withColumn(new, F.when(F.col(pairs).isNotNull(), rewritten("text", pairs)))
    rest = rest.withColumns({
        "text": F.coalesce(F.col(new)["text"], "text"),
        "n_replaced": F.coalesce(F.col(new)["n"], F.lit(0)).cast("long"),
    })
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rest = rest.withColumn("n_chars", F.when(F.col(pairs).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return clean.unionByName(rest.select(*clean.columns))
