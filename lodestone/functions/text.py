"""Text measures and normal forms as column expressions."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ZERO_WIDTH = "[​‌‍⁠﻿]"
#: Letters that print as Latin ones, and those (in the same order).
FOLD_FROM = "аеорсухіјѕАВЕКМНОРСТХІЈЅοιΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
FOLD_TO = "aeopcyxijsABEKMHOPCTXIJSoiABEZHIKMNOPTYX"

#: Full-width signs and odd blanks with what they print as; look-alikes as above.
PLAIN_FROM = FOLD_FROM + "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
PLAIN_TO = FOLD_TO + "".join(map(chr, range(0x21, 0x7F))) + " " * 15
INVISIBLE = "[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u2069\ufeff]"


def plain(c: Column) -> Column:
    """The text as it prints, in ordinary letters: what rules look at. Plain ASCII stays as it is."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(c, PLAIN_FROM, PLAIN_TO), INVISIBLE, "")).otherwise(c)


def plain_sql(text: str) -> str:
    """plain() in SQL."""
    a, b = (v.replace("'", "''") for v in (PLAIN_FROM, PLAIN_TO))
    return f"regexp_replace(translate({text}, '{a}', '{b}'), '{INVISIBLE}', '', 'g')"


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def nfkc(c: Column) -> Column:
    """NFKC; plain ASCII stays in the JVM."""
    return F.coalesce(_nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


_COUNTS = T.StructType([T.StructField("n_chars", T.LongType()), T.StructField("n_distinct", T.LongType()), T.StructField("entropy", T.DoubleType())])


@F.arrow_udf(_COUNTS)
def char_counts(texts: pa.Array) -> pa.Array:
    """Characters, different ones, and their entropy in bits; of a null or empty text 0."""
    out = []
    for t in texts.to_pylist():
        n, k = len(t or ""), Counter(t or "")
        out.append({"n_chars": n, "n_distinct": len(k), "entropy": math.log2(n) - sum(c * math.log2(c) for c in k.values()) / n if n else 0.0})
    return pa.array(out, pa.struct([("n_chars", pa.int64()), ("n_distinct", pa.int64()), ("entropy", pa.float64())]))


def common_words(c: Column, k: int, least: int) -> Column:
    """Words of at least `least` signs: their number, the number that the k commonest have together, and that of the commonest."""

    @F.arrow_udf(T.StructType([T.StructField(x, T.LongType()) for x in ("n_words", "top", "most")]))
    def count(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            n = Counter(w for w in _TOKEN.findall((t or "").lower()) if len(w) >= least)
            top = n.most_common(k)
            out.append({"n_words": n.total(), "top": sum(x for _, x in top), "most": top[0][1] if top else 0})
        return pa.array(out, pa.struct([(x, pa.int64()) for x in ("n_words", "top", "most")]))

    return count(c)


_TOKEN = re.compile("[a-z0-9_']+")


def fold(c: Column) -> Column:
    return F.translate(c, FOLD_FROM, FOLD_TO)


def strip_invisible(c: Column) -> Column:
    return F.regexp_replace(c, ZERO_WIDTH, "")


def dedupe_form(c: Column) -> Column:
    """Lower case with single blanks: the form whose hash finds exact copies."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_']+"), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    """Word n-grams in order, with repeats; empty if there are fewer words. The words are bound once, else they would be worked out for each n-gram."""

    def own(w: Column) -> Column:
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.array(words), own))


def char_ngrams(c: Column, n: int) -> Column:
    """Runs of n signs, with repeats; a shorter text is one run, an empty one too."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))


def hash_bucket(c: Column, buckets: int = 100) -> Column:
    """The first 32 bits of the SHA-256, modulo buckets."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("bigint") % buckets


def logit_blend(p: Column, q: Column, weight: float = 0.6) -> Column:
    """Weighted mean of log-odds, as a probability; 0 where both are 0."""

    def logit(x: Column) -> Column:
        y = F.least(F.greatest(x, F.lit(0.001)), F.lit(0.999))
        return F.log(y / (1 - y))

    z = weight * logit(p) + (1 - weight) * logit(q)
    return F.when((p == 0) & (q == 0), 0.0).otherwise(1 / (1 + F.exp(-z)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))
