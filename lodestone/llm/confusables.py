"""Problem 1: one consistent form for texts that print alike.

Characters are first brought to plain forms (full width, joined letters, blanks, hyphens, invisible characters), then each token's
letters are resolved to one script: the sets of scripts in which each letter, or a look-alike of it, exists are intersected over the
token. One script left: the token is spelled in it. Several left (a whole-script confusable): it takes the script that the text's
settled tokens mostly have, Latin if that script would need letters that are rare in it. None left (a mixed-script token that can't be settled): the script of most of its settled letters. All
three choices depend only on what the text looks like, so texts that look alike get the same form.
"""

from __future__ import annotations

import functools
import json
import os
import re
import string
import tempfile
import unicodedata

import pyarrow as pa
from pyspark import SparkContext, SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that print as a Latin letter does, for use without a session; with one, see prepare().
COMMON = {
    "Cyrillic": dict(zip("аеорсухѕіјһԁԛԝѵӏАВЕЅІЈКМНОРСТУХԚԜԌ", "aeopcyxsijhdqwvlABESIJKMHOPCTYXQWG", strict=True)),
    "Greek": dict(zip("ονραιυϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovpaiujABEZHIKMNOPTYX", strict=True)),
    "Armenian": dict(zip("օսհցԼՏՕ", "ouhgLSO", strict=True)),
    "Cherokee": dict(zip("ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᏔᏃ", "ABCDEHJKLMPRSTVWZ", strict=True)),
}
# Hyphens that print as "-", and invisible characters that aren't of category Cf.
HYPHENS = "‐‑‒⁃˗−﹣－"
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"

LATIN = "Latin"
#: The letters of an alphabet that its everyday words are written with; of other scripts all are.
EVERYDAY = {"Cyrillic": ("А", "я"), "Greek": ("Α", "ω")}
#: Scripts that are written together.
_TOGETHER = {"Hiragana": "Cjk", "Katakana": "Cjk", "Hangul": "Cjk", "Bopomofo": "Cjk"}
TABLE = "lodestone-look-alikes.json"

# look-alike classes by their Latin member: the spelling in each script
SPELL: dict[str, dict[str, str]] = {}
CLASS: dict[str, str] = {}
_SETS: dict[str, frozenset | None] = {}
_FROM: list[str] = []


@functools.cache
def script_of(ch: str) -> str | None:
    """The script of a letter, by its name; None where it says nothing (marks, modifiers, common letters)."""
    if unicodedata.category(ch)[0] == "M" or unicodedata.category(ch) == "Lm":
        return None
    first, *rest = unicodedata.name(ch, "?").split()
    name = f"{first} {rest[0]}".title() if first in ("OLD", "NEW") and rest else first.title()
    return _TOGETHER.get(name, name)


def _use(letters: dict[str, str], source: str) -> None:
    """Makes the classes of letters (of other scripts, with the Latin letter of each)."""
    SPELL.clear(), CLASS.clear(), _SETS.clear()
    for x in sorted(letters):
        SPELL.setdefault(letters[x], {LATIN: letters[x]}).setdefault(script_of(x) or "?", x)
        CLASS[x] = CLASS[letters[x]] = letters[x]
    for f in (_resolve, _spelled, _formed):
        f.cache_clear()
    _FROM[:] = [source]


def _classes() -> None:
    """Classes of the table that prepare() sent, where there is one; else those of COMMON."""
    path = SparkFiles.get(TABLE) if SparkFiles._is_running_on_worker or SparkContext._active_spark_context else None
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            _use(json.load(f), path)
    else:
        _use({x: y for v in COMMON.values() for x, y in v.items()}, "common")


def published(spark: SparkSession) -> dict[str, str]:
    """The letters of other scripts that by Unicode's table of confusable characters (as Spark's own library for Unicode has it) look like a Latin letter, with that letter:
    of those it could be, the one of the same case. Letters that are another form of a letter anyway are left out."""
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    latin: dict[str, list[str]] = {}
    for x in string.ascii_letters:
        latin.setdefault(checker.getSkeleton(x), []).append(x)
    # letters in which no script has words that others spell are left out: syllables and ideographs
    own = [c for c in map(chr, range(0x80, 0x1F000)) if unicodedata.category(c)[0] == "L" and not unicodedata.decomposition(c) and script_of(c) not in (None, LATIN, "Cjk", "Mathematical")]
    looks = checker.getSkeleton("\n".join(own)).split("\n")
    return {c: min(latin[k], key=lambda y: (unicodedata.category(y) != unicodedata.category(c), y)) for c, k in zip(own, looks, strict=True) if k in latin}


def prepare(spark: SparkSession) -> None:
    """Sends the published look-alikes to all executors, once for each application. Without it only those of COMMON are known."""
    if not os.path.exists(SparkFiles.get(TABLE)):
        folder = tempfile.mkdtemp(prefix="lodestone-")
        with open(f"{folder}/{TABLE}", "w", encoding="utf-8") as f:
            json.dump({x: y for v in COMMON.values() for x, y in v.items()} | published(spark), f)
        spark.sparkContext.addFile(f"{folder}/{TABLE}")
    _classes()


# anything but ASCII, composed letters of Latin 1 and common punctuation, none of which has another form
_ODD = re.compile("[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u00a1\u00ab\u00bb\u00bf\u2013\u2014\u2018-\u201e\u2026]")
# letters beyond the Latin blocks
_FOREIGN = re.compile("[\u0370-\u1dff\u1f00-\u1fff\u2c00-\u2c5f\u2c80-\u2dff\u3040-\ua71f\ua7f0-\uab2f\uab6a-\ufaff\ufb13-\ufeff\U00010000-\U0001ffff]")
_TOKEN = re.compile(r"(?:[^\W\d_]|[\u0300-\u036f])+")


class _Forms(dict):
    """Code point -> plain form, filled in as code points occur."""

    def __missing__(self, cp: int) -> str:
        self[cp] = out = self.form(chr(cp))
        return out

    def form(self, ch: str) -> str:
        kind = unicodedata.category(ch)
        if ch in HYPHENS:
            return "-"
        if kind == "Cf" or ch in INVISIBLE or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF:
            return ""
        if kind == "Zs":
            return " "
        if kind in ("Zl", "Zp") or ch == "\x85":
            return "\n"
        tag, _, rest = unicodedata.decomposition(ch).partition(" ")
        if tag in ("<wide>", "<narrow>", "<font>", "<noBreak>") or (tag == "<compat>" and (kind == "Nl" or kind[0] == "L" and " " in rest)):
            return "".join(self[int(x, 16)] for x in rest.split())
        return ch


_FORMS = _Forms()


def _scripts(ch: str) -> frozenset | None:
    """The scripts in which the letter or a look-alike exists; None where it says nothing."""
    if ch not in _SETS:
        own = script_of(ch)
        _SETS[ch] = frozenset(SPELL[CLASS[ch]]) if ch in CLASS else None if own is None else frozenset([own])
    return _SETS[ch]


@functools.lru_cache(200_000)
def _resolve(token: str) -> tuple[frozenset, str | None]:
    """The scripts that all letters share; if none, the script that most settled letters have."""
    sets = [x for x in map(_scripts, token) if x is not None]
    common = frozenset.intersection(*sets) if sets else frozenset()
    if common or not sets:
        return common, None
    count: dict[str, int] = {}
    for x in sets:
        if len(x) == 1:
            count[next(iter(x))] = count.get(next(iter(x)), 0) + 1
    return common, min(count, key=lambda s: (-count[s], s != LATIN, s)) if count else LATIN


@functools.lru_cache(200_000)
def _spelled(token: str, script: str) -> str:
    return "".join(((s := SPELL[CLASS[c]]).get(script) or s[LATIN] if script_of(c) != script else c) if c in CLASS else c for c in token)


def _everyday(token: str, script: str) -> bool:
    """Whether the token, spelled in the script, has only letters of its everyday words."""
    low, high = EVERYDAY.get(script, ("", "\U0010ffff"))
    return all(low <= x <= high for c in token if c in CLASS and (x := SPELL[CLASS[c]].get(script)))


def canonical(text: str | None) -> str | None:
    """The consistent form. Null stays null, an empty text stays empty; text of plain ASCII is returned as it is."""
    return text if text is None or text.isascii() or not _ODD.search(text) else _formed(text)


@functools.lru_cache(256)
def _formed(text: str) -> str:
    if not _FROM:
        _classes()
    text = text.translate(_FORMS)
    if text.isascii():
        return text
    if not _FOREIGN.search(text):  # Latin letters only
        return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
    text = unicodedata.normalize("NFD", text)
    found = [(m, *_resolve(m[0])) for m in _TOKEN.finditer(text)]
    settled: dict[str, int] = {}
    for _, common, _m in found:
        if len(common) == 1:
            s = next(iter(common))
            settled[s] = settled.get(s, 0) + 1
    main = min(settled, key=lambda s: (-settled[s], s != LATIN, s), default=LATIN)
    out, at = [], 0
    for m, common, most in found:
        script = most or (next(iter(common)) if len(common) == 1 else main if main in common and _everyday(m[0], main) else LATIN)
        out += [text[at : m.start()], _spelled(m[0], script)]
        at = m.end()
    return unicodedata.normalize("NFC", "".join(out) + text[at:])


@F.arrow_udf(T.StringType())
def _canonical(texts: pa.Array) -> pa.Array:
    return pa.array([canonical(x) for x in texts.to_pylist()], pa.string())


def canonical_text(c: Column) -> Column:
    """Only texts with a character beyond ASCII go to Python; the rest stay in the JVM."""
    return F.coalesce(_canonical(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def tokens_report(text: str) -> list[tuple[str, str, str]]:
    """(token, kind, spelling) for tokens that use a look-alike: kind is `mixed` or `whole`."""
    if not _FROM:
        _classes()
    text = unicodedata.normalize("NFD", text.translate(_FORMS))
    out = []
    for m in _TOKEN.finditer(text):
        used = {s for s in map(script_of, m[0]) if s}
        common, _ = _resolve(m[0])
        if len(used) > 1:
            out.append((unicodedata.normalize("NFC", m[0]), "mixed", canonical(m[0])))
        elif used - {LATIN} and LATIN in common:
            out.append((unicodedata.normalize("NFC", m[0]), "whole", canonical(m[0])))
    return out


def consistent_texts(df: DataFrame, text: str = "text", out: str = "canonical") -> DataFrame:
    """df with the consistent form of `text` in `out` and whether it was changed in `<out>_changed`. An existing column of that name is replaced."""
    return df.withColumn(out, canonical_text(F.col(text))).withColumn(f"{out}_changed", ~F.col(out).eqNullSafe(F.col(text)))


def look_alike_pairs(left: DataFrame, right: DataFrame, same: list[str]) -> DataFrame:
    """Pairs (key_a of left, key_b of right) with equal `same` columns and `form` but different `text_hash`.

    left, right: key, form, text_hash and `same`. Rows meet only by way of the pairs of different texts of a form, so copies of one
    text, however many, are never compared with each other, and the work is that of writing the result.
    """
    on = [*same, "form"]
    a, b = (x.groupBy(*on, "text_hash").agg(F.lit(1).alias("_")).drop("_") for x in (left, right))
    pairs = a.withColumnRenamed("text_hash", "ha").join(b.withColumnRenamed("text_hash", "hb"), on).where("ha <> hb")
    a = left.select(*on, F.col("text_hash").alias("ha"), F.col("key").alias("key_a"))
    b = right.select(*on, F.col("text_hash").alias("hb"), F.col("key").alias("key_b"))
    return pairs.join(a, [*on, "ha"]).join(b, [*on, "hb"]).select("key_a", "key_b")


def keyed_forms(df: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    """key, form (16 bytes that stand for the consistent form), text_hash; nulls are left out, empty texts are texts."""
    return df.where(F.col(text).isNotNull()).select(
        F.col(key).alias("key"), *more, F.unhex(F.md5(canonical_text(F.col(text)))).alias("form"), F.xxhash64(text).alias("text_hash"))
