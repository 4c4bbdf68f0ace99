"""Markup and binary documents: parsed where a pattern can't say it, in Arrow batches."""

from __future__ import annotations

import io
import math
import re
import zipfile
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def hides(style: str | None) -> bool:
    """Whether a style's declarations hide what they apply to: shown not at all, without size, see-through, or far off."""
    for declaration in (style or "").lower().split(";"):
        name, _, value = (x.strip() for x in declaration.partition(":"))
        value = value.removesuffix("!important").strip()
        number = re.match(r"-?[0-9.]+", value)
        amount = float(number[0]) if number and number[0].strip("-.").replace(".", "", 1).isdigit() else None
        if (name, value) in {("display", "none"), ("visibility", "hidden"), ("visibility", "collapse"), ("color", "transparent")}:
            return True
        if name in ("opacity", "font-size", "max-height", "max-width") and amount == 0:
            return True
        if name in ("left", "top", "text-indent", "margin-left") and amount is not None and amount <= -500:
            return True
    return False


def content_type(text: Column) -> Column:
    """pdf, html, markdown (two marks at least) or plain, by what the text begins with."""
    head = F.substring(text, 1, 4096)
    marks = sum((F.when(text.rlike(p), 1).otherwise(0) for p in (r"(?m)^#{1,6} ", r"(?m)^[-*] ", r"\[[^\]]+\]\([^)]+\)", r"```", r"\*\*[^*]+\*\*")), F.lit(0))
    return (F.when(F.substring(text, 1, 1024).contains("%PDF-"), "pdf").when(head.rlike(r"(?i)<(!doctype html|html|body|head|div|script)\b"), "html")
            .when(marks >= 2, "markdown").otherwise("plain"))


class _Parts(HTMLParser):
    """Visible and hidden text of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.visible: list[str] = []
        self.hidden: list[str] = []
        self.open: list[tuple[str, bool]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        hide = tag in ("script", "style", "template", "noscript") or "hidden" in a or a.get("aria-hidden") == "true" or hides(a.get("style"))
        self.hidden += [a[k] for k in ("alt", "title", "aria-label", "content") if a.get(k)]
        if tag not in VOID:
            self.open.append((tag, hide))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        (self.hidden if any(h for _, h in self.open) else self.visible).append(data)

    def handle_comment(self, data: str) -> None:
        self.hidden.append(data)


def page_parts(html: str) -> tuple[str, str]:
    p = _Parts()
    p.feed(html)
    p.close()
    return tuple(" ".join(" ".join(x).split()) for x in (p.visible, p.hidden))


def html_divergence(df: DataFrame, key: str, html: str) -> DataFrame:
    """key, visible, hidden, ratio (hidden characters over all), severity. Null pages have empty parts."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [page_parts(x) if isinstance(x, str) else ("", "") for x in b[html]]
            ratio = [len(h) / max(1, len(v) + len(h)) for v, h in parts]
            yield pd.DataFrame({key: b[key], "visible": [v for v, _ in parts], "hidden": [h for _, h in parts], "ratio": ratio, "severity": ["high" if r > 0.3 else "medium" if r > 0.1 else "low" for r in ratio]})

    return df.select(key, html).mapInPandas(run, f"`{key}` {kind}, visible string, hidden string, ratio double, severity string")


def png_texts(data: bytes) -> list[str]:
    """The text chunks of a PNG; of a broken file those before the break."""
    out, at = [], 8
    while at + 8 <= len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if kind == b"tEXt":
            out.append(body.replace(b"\0", b": ").decode("latin-1"))
        elif kind == b"zTXt" and b"\0\0" in body:
            name, _, packed = body.partition(b"\0\0")
            try:
                out.append(f"{name.decode('latin-1')}: {zlib.decompress(packed).decode('latin-1')}")
            except zlib.error:
                pass
        at += 12 + n
    return out


def jpeg_texts(data: bytes) -> list[str]:
    out, at = [], 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at + 1] == 0xFE:
            out.append(data[at + 4 : at + 2 + n].decode("latin-1"))
        at += 2 + n
    return out


def office_texts(data: bytes, size: int = 50_000_000) -> list[str]:
    """Texts of an Office file's parts, and findings: macros, outside links, hidden text. A part that unpacks to more than `size` bytes is reported instead of read: it is a packed bomb."""
    out = []
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for i in z.infolist():
                if i.filename.lower().endswith("vbaproject.bin"):
                    out.append("macro: " + i.filename)
                elif i.file_size > size:
                    out.append(f"too large: {i.filename}")
                elif i.filename.endswith((".xml", ".rels")):
                    with z.open(i) as f:
                        x = f.read().decode("utf-8", "replace")
                    out += ["external: " + y for y in re.findall(r'Target="(https?://[^"]+)"[^>]*TargetMode="External"', x)]
                    out += ["hidden: " + i.filename] * ("<w:vanish" in x)
                    out.append(" ".join(re.findall(r"<(?:w|a):t[^>]*>([^<]+)<", x)))
    except (zipfile.BadZipFile, zlib.error, RuntimeError):
        out.append("broken archive")
    return [x for x in out if x]


def lsb_measures(data: bytes) -> tuple[float, float]:
    """How far the share of odd bytes is from a half (times ten, 1 at most), and the chi-square of pairs of values that differ in the last bit."""
    if not data:
        return 0.0, 0.0
    odd = sum(b & 1 for b in data) / len(data)
    counts = [0] * 256
    for b in data:
        counts[b] += 1
    chi = sum((counts[i] - counts[i + 1]) ** 2 / (counts[i] + counts[i + 1]) for i in range(0, 256, 2) if counts[i] + counts[i + 1])
    return min(1.0, abs(odd - 0.5) * 10), chi


def bit_measures(df: DataFrame) -> DataFrame:
    """path, odd, chi, entropy of binary files (path, content): how uneven last bits are, and bits a byte. Null contents are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *lsb_measures(bytes(c)), entropy(bytes(c))) for p, c in zip(b["path"], b["content"], strict=True) if c is not None]
            yield pd.DataFrame(rows, columns=["path", "odd", "chi", "entropy"])

    return df.select("path", "content").mapInPandas(run, "path string, odd double, chi double, entropy double")


def scan_files(df: DataFrame) -> DataFrame:
    """path, kind, finding of binary files (path, content): text in images, Office parts, code in PDFs, text behind an image's end."""

    def one(data: bytes) -> Iterator[tuple[str, str]]:
        if data.startswith(b"\x89PNG"):
            yield from (("png", x) for x in png_texts(data))
            end = data.find(b"IEND")
            if 0 <= end < len(data) - 8:
                yield "png", f"appended: {len(data) - end - 8} bytes"
        elif data.startswith(b"\xff\xd8"):
            yield from (("jpeg", x) for x in jpeg_texts(data))
        elif data.startswith(b"PK\x03\x04"):
            yield from (("office", x) for x in office_texts(data))
        elif b"%PDF-" in data[:1024]:
            text = data.decode("latin-1")
            yield from (("pdf", x) for x in sorted(set(re.findall(r"/(?:JavaScript|JS|OpenAction|Launch|EmbeddedFile|OCG|AA)\b", text))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, k, f) for p, c in zip(b["path"], b["content"], strict=True) if c is not None for k, f in one(bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "kind", "finding"])

    return df.select("path", "content").mapInPandas(run, "path string, kind string, finding string")


def ascii_art_blocks(df: DataFrame, key: str, text: str, least: int = 3) -> DataFrame:
    """key, first_line, n_lines of runs of at least `least` lines that are mostly symbols."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("i", "line"))
    symbols = F.length(F.regexp_replace("line", r"[A-Za-z0-9\s.,;:'\"!?-]", "")) / F.greatest(F.length("line"), F.lit(1))
    art = lines.where((F.length("line") >= 5) & (symbols > 0.4))
    # within a run the line number minus the rank is constant
    from pyspark.sql import Window as W

    g = art.withColumn("g", F.col("i") - F.row_number().over(W.partitionBy(key).orderBy("i")))
    return g.groupBy(key, "g").agg(F.min("i").alias("first_line"), F.count("*").alias("n_lines")).where(F.col("n_lines") >= least).drop("g")


def entropy(data: bytes) -> float:
    n = len(data)
    return -sum(c / n * math.log2(c / n) for c in (data.count(bytes([b])) for b in set(data))) if n else 0.0
