"""Shell commands and texts in disguise: variants of a command, spaced letters, loose JSON."""

from __future__ import annotations

import codecs
import hashlib
import html
import json
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import INVISIBLE, PLAIN_FROM, PLAIN_TO

_ANSI = re.compile(r"\$'((?:[^'\\]|\\.)*)'", re.S)
_SET = re.compile(r"(?:^|[;&\s])([A-Za-z_]\w*)=(\"[^\"]*\"|'[^']*'|[^\s;&|]*)")
_USE = re.compile(r"\$\{([A-Za-z_]\w*)\}|\$([A-Za-z_]\w*)")
_PATH = re.compile(r"(?<![\w/.-])/(?:[\w.-]+/)+(?=[\w.-])")
SPACED = re.compile(r"(?<![A-Za-z0-9])(?:[A-Za-z] ){3,}[A-Za-z](?![A-Za-z0-9])")
_PLAIN = str.maketrans(PLAIN_FROM, PLAIN_TO)
_HIDDEN = re.compile(r"<!--(.*?)-->", re.S)
_GONE = re.compile(INVISIBLE)


def variants(command: str) -> list[str]:
    """The command and what a shell makes of it, each once: $'..' decoded, variables that it sets itself put in (IFS is a blank), quotes, backslashes and paths removed, other alphabets' letters in ASCII."""

    def decoded(m: re.Match) -> str:
        try:
            return codecs.decode(m[1].encode("latin-1", "backslashreplace"), "unicode_escape")
        except UnicodeDecodeError:
            return m[1]

    a = _ANSI.sub(decoded, command)
    known = {"IFS": " "} | {k: v.strip("\"'") for k, v in _SET.findall(a)}
    b = _USE.sub(lambda m: known.get(m[1] or m[2], m[0]), a)
    c = _PATH.sub("", re.sub(r"\\(?=[A-Za-z])", "", re.sub(r"'([^']*)'|\"([^\"]*)\"", lambda m: m[1] or m[2] or "", b)))
    d = unicodedata.normalize("NFKD", c.translate(_PLAIN)).encode("ascii", "ignore").decode()
    return list(dict.fromkeys([command, a, b, c, d]))


def _text_udf(kind, f):
    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        return pa.array([None if t is None else f(t) for t in texts.to_pylist()], to_arrow_type(kind))

    return run


def shell_variants(c: Column) -> Column:
    return _text_udf(T.ArrayType(T.StringType()), variants)(c)


def collapsed(c: Column) -> Column:
    """Letters spaced out, at least four of them, put together; texts without any stay in the JVM."""
    may = c.rlike(r"(?<![A-Za-z0-9])(?:[A-Za-z] ){3,}[A-Za-z](?![A-Za-z0-9])")
    return F.coalesce(_text_udf(T.StringType(), lambda t: SPACED.sub(lambda m: m[0].replace(" ", ""), t))(F.when(may, c)), c)


def _jsonish(text: str) -> str:
    """Canonical JSON of what is JSON; the text itself, as a string, otherwise."""
    try:
        value = json.loads(text)
    except ValueError:
        value = text
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_json(c: Column) -> Column:
    return _text_udf(T.StringType(), _jsonish)(c)


def tool_hash(c: Column) -> Column:
    """A hash that doesn't change with the order of keys or with blanks."""
    return _text_udf(T.StringType(), lambda t: hashlib.sha256(_jsonish(t).encode()).hexdigest())(c)


def _leaves(text: str) -> list[dict]:
    try:
        value = json.loads(text)
    except ValueError:
        return [{"path": "", "value": text}]
    out: list[dict] = []
    todo = [("", value)]
    while todo:
        path, v = todo.pop()
        if isinstance(v, dict):
            todo += [(f"{path}.{k}" if path else k, x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            todo += [(f"{path}[{i}]", x) for i, x in reversed(list(enumerate(v)))]
        elif v is not None:
            out.append({"path": path, "value": v if isinstance(v, str) else json.dumps(v)})
    return out


def leaves(c: Column) -> Column:
    """The leaves of a JSON value of any depth, with their paths, in order: array of struct path, value. What isn't JSON is one leaf of no path; nulls are no leaves."""
    return _text_udf(T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])), _leaves)(c)


FLAGS = ("invisible", "look_alikes", "entities", "spaced", "hidden", "nfkc", "control", "odd_blanks", "blank_share")


def _normal(text: str) -> dict:
    a = unicodedata.normalize("NFKC", text)
    b = html.unescape(a)
    c = _GONE.sub("", b)
    d = c.translate(_PLAIN)
    e = SPACED.sub(lambda m: m[0].replace(" ", ""), d)
    hidden = [x.strip() for x in _HIDDEN.findall(e) if x.strip()]
    f = _HIDDEN.sub("", e)
    flags = {
        "nfkc": a != text, "entities": b != a, "invisible": c != b, "look_alikes": d != c, "spaced": e != d, "hidden": bool(hidden), "control": any(unicodedata.category(x) == "Cc" and x not in "\t\n\r" for x in text),
        "odd_blanks": any(unicodedata.category(x) == "Zs" and x != " " for x in text), "blank_share": len(text) > 10 and text.count(" ") / len(text) > 0.4,
    }
    return {"text": " ".join((f + "".join(f" {x}" for x in hidden)).split()), "hidden": hidden, "flags": [k for k in FLAGS if flags[k]]}


def normalised(c: Column) -> Column:
    """Struct text (in its compatible form, entities, invisible signs, look-alikes and spaced letters resolved, comments at the end), hidden (what comments say) and flags (which of the nine applied)."""
    return _text_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("hidden", T.ArrayType(T.StringType())), T.StructField("flags", T.ArrayType(T.StringType()))]), _normal)(c)


def repetition(c: Column) -> Column:
    """The share of a text in runs of three or more of the same two to five signs (whole texts of 20 signs or more, 1 at most)."""
    n = sum((F.aggregate(F.regexp_extract_all(c, F.lit(rf"((?s:(.{{{w}}}))\2{{2,}})"), F.lit(1)), F.lit(0), lambda a, x: a + F.length(x)) for w in (2, 3, 4, 5)), F.lit(0))
    return F.when(F.length(c) >= 20, F.least(F.lit(1.0), n / F.length(c))).otherwise(0.0)
