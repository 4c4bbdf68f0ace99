"""Encoded parts of texts: found, decoded and scanned again, layer by layer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import rules as R

LOWER = "abcdefghijklmnopqrstuvwxyz"
# The least lengths of what counts as encoded.
BASE64 = r"[A-Za-z0-9+/_-]{20,}={0,2}"
BASE32 = r"\b[A-Z2-7]{16,}={0,6}"
HEX = r"\b(?:0x)?([0-9a-fA-F]{20,})\b"
HEX_ESCAPES = r"(?:\\x[0-9a-fA-F]{2}){4,}"
PERCENT = r"(?:%[0-9a-fA-F]{2}){3,}"
ENTITIES = r"(?:&#(?:x[0-9a-fA-F]{1,5}|[0-9]{1,6});){3,}"
UNICODE_ESCAPES = r"(?:\\u[0-9a-fA-F]{4}){3,}"
CIPHER_NAMED = r"(?i)\b(?:rot[ _-]?13|caesar|atbash|shift cipher)\b"
PRINTABLE = r"^[\x09\x0A\x0D\x20-\x7E]{8,}$"
ENCODINGS = ("base64", "base32", "hex", "hex_escapes", "percent", "entities", "unicode_escapes", "rot13")


def shifted(c: Column, n: int) -> Column:
    """Letters moved n places in the alphabet."""
    low = LOWER[n:] + LOWER[:n]
    return F.translate(c, LOWER + LOWER.upper(), low + low.upper())


def rot13(c: Column) -> Column:
    return shifted(c, 13)


def best_caesar(c: Column) -> Column:
    """The shift whose text has most of English's commonest letters, with the text: a struct (score, shift, text)."""
    tries = [F.struct((F.length(c) - F.length(F.regexp_replace(F.lower(shifted(c, n)), "[etaoin]", ""))).alias("score"), F.lit(-n).alias("shift"), shifted(c, n).alias("text")) for n in range(1, 26)]
    return F.array_max(F.array(*tries))


def _text(b: Column) -> Column:
    t = F.decode(b, "ISO-8859-1")
    return F.when(t.rlike(PRINTABLE), t)


def _code_points(codes: Column) -> Column:
    """A text of numbers of characters."""
    return F.array_join(F.transform(codes, lambda x: F.when(x < 65536, F.decode(F.unhex(F.lpad(F.hex(x), 4, "0")), "UTF-16BE")).otherwise("")), "")


def _base32(x: Column) -> Column:
    """Bytes of base-32 text: bits of all letters, in eights."""
    letters = F.filter(F.split(F.rtrim(F.translate(x, "=", " ")), ""), lambda y: y != "")
    bits = F.array_join(F.transform(letters, lambda y: F.lpad(F.bin(F.instr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), y) - 1), 5, "0")), "")
    n = F.floor(F.length(bits) / 8).cast("int")
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.lpad(F.conv(F.substring(bits, i * 8 + 1, F.lit(8)), 2, 16), 2, "0")), ""))


def layers(text: Column) -> Column:
    """What a text holds in code: array of (encoding, decoded); only printable results of eight characters or more. A text that names a letter cipher is taken as one as a whole."""

    def part(name: str, pattern: str, group: int, f) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        return F.transform(found, lambda x: F.struct(F.lit(name).alias("encoding"), f(x).alias("decoded")))

    def hexed(x: Column) -> Column:
        return _text(F.try_to_binary(x, F.lit("hex")))

    def base64(x: Column) -> Column:
        y = F.translate(x, "-_", "+/")
        return _text(F.try_to_binary(F.rpad(F.rtrim(F.translate(y, "=", " ")), (F.ceil(F.length(F.rtrim(F.translate(y, "=", " "))) / 4) * 4).cast("int"), "="), F.lit("base64")))

    def entities(x: Column) -> Column:
        n = F.regexp_extract_all(x, F.lit("&#(x?[0-9a-fA-F]+);"), F.lit(1))
        return _code_points(F.transform(n, lambda y: F.when(y.startswith("x"), F.conv(F.substring(y, 2, 8), 16, 10)).otherwise(y).cast("long")))

    def escapes(x: Column) -> Column:
        return _code_points(F.transform(F.regexp_extract_all(x, F.lit(r"\\u([0-9a-fA-F]{4})"), F.lit(1)), lambda y: F.conv(y, 16, 10).cast("long")))

    all_ = [
        part("base64", BASE64, 0, base64), part("base32", BASE32, 0, lambda x: _text(_base32(x))), part("hex", HEX, 1, hexed), part("hex_escapes", HEX_ESCAPES, 0, lambda x: hexed(F.replace(x, F.lit("\\x"), F.lit("")))),
        part("percent", PERCENT, 0, lambda x: F.try_url_decode(x)), part("entities", ENTITIES, 0, entities), part("unicode_escapes", UNICODE_ESCAPES, 0, escapes),
    ]
    cipher = F.when(text.rlike(CIPHER_NAMED), F.array(F.struct(F.lit("rot13").alias("encoding"), rot13(text).alias("decoded")))).otherwise(F.array().cast("array<struct<encoding:string,decoded:string>>"))
    return F.filter(F.concat(*all_, cipher), lambda x: F.length(x["decoded"]) >= 8)


#: A text without any of these holds nothing in code.
MAYBE = r"[A-Za-z0-9+/_-]{16}|(?:%[0-9a-fA-F]{2}){3}|&#|\\[xu][0-9a-fA-F]|(?i:rot[ _-]?13|caesar|atbash|shift cipher)"


def decode_and_scan(df: DataFrame, key: str, text: str, rules: list[R.Rule], depth: int = 3, least: float = 0.5) -> DataFrame:
    """key, depth, encoding, rule_id, confidence: findings in decoded parts; each layer costs a tenth of confidence, below `least` none is kept. Layers are unrolled; texts (and decoded parts) without
    a sign of code go no further."""
    out, now = [], df.select(key, F.col(text).alias("t"))
    for i in range(1, depth + 1):
        now = now.where(F.col("t").rlike(MAYBE)).select(key, F.inline(layers(F.col("t")))).withColumnRenamed("decoded", "t")
        x, f = R.looked_at(now, [key, "encoding"], "t", rules)
        hit = x.select(key, F.lit(i).alias("depth"), "encoding", F.inline_outer(f)).where("rule_id is not null")
        out.append(hit.select(key, "depth", "encoding", "rule_id", F.round(F.col("confidence") - 0.1 * i, 6).alias("confidence")).where(F.col("confidence") >= least))
    return reduce(DataFrame.unionByName, out)


def in_place(text: Column) -> Column:
    """The text with what its code says appended, each in brackets."""
    return F.concat(text, F.array_join(F.transform(layers(text), lambda x: F.concat(F.lit(" [DECODED: "), x["decoded"], F.lit("]"))), ""))
