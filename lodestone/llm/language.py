"""Problem 5: language of each text and of each single-language segment, as a mixture of n-gram models.

A model of each language (hashed 3- and 4-grams of letters) is fitted to a bounded sample of labelled texts; as labels are sometimes wrong and
texts sometimes mixed, expectation-maximisation reassigns the sample's sentences before the models are final. Of a text, the sentences'
likelihoods under all languages are mixed with proportions found by expectation-maximisation; a further language joins the text's set only if it
raises the log-likelihood by more than a penalty. Each sentence then gets its likeliest language of the set, and runs of equal
languages are segments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import NO_VALUE, clean
from lodestone.llm.confusables import canonical

# Two-letter codes with the three-letter codes and names that stand for the same language.
LANGUAGES = {
    "en": "eng english", "de": "deu ger german deutsch", "fr": "fra fre french français francais", "es": "spa spanish español espanol castellano",
    "it": "ita italian italiano", "ru": "rus russian русский", "pt": "por portuguese português", "nl": "nld dut dutch nederlands",
    "pl": "pol polish polski", "uk": "ukr ukrainian", "cs": "ces cze czech", "sv": "swe swedish", "da": "dan danish", "no": "nor norwegian nb nn",
    "fi": "fin finnish", "el": "ell gre greek", "tr": "tur turkish", "ar": "ara arabic", "he": "heb hebrew", "hi": "hin hindi", "zh": "zho chi chinese",
    "ja": "jpn japanese", "ko": "kor korean", "ro": "ron rum romanian", "hu": "hun hungarian", "bg": "bul bulgarian", "vi": "vie vietnamese",
}
CODE = {x: k for k, v in LANGUAGES.items() for x in [k, *v.split()]}

SIZE = 1 << 17
NGRAMS = (3, 4)
#: Share of probability that all n-grams have in equal parts.
UNSEEN = 0.05
#: Labelled texts that the models are fitted to at most, in equal parts of each language (LEAST_ROWS at least), those whose keys have the smallest hashes, and the
#: characters that such a text has at most; everything else covers all texts, whole.
SAMPLE_ROWS, LEAST_ROWS = 6000, 200
LONGEST = 20_000
#: An n-gram shares letters with others, so a sentence's log-likelihood counts for less than half of the sum over its n-grams.
TEMPER = 0.4
#: Log-likelihood by which a further language of a text must pay.
PENALTY = 8.0
#: Mean share of a text's n-grams that no language's sample has, above which the text is in none of them.
STRANGE = 0.9

_SENTENCE = re.compile(r"(?<=[.!?…])[\"'»)\]]*\s+|\n+")
_LETTER = re.compile(r"[^\W\d_]")
_DIGIT = np.array([c.isdigit() or c == "_" for c in map(chr, range(0x80))])


def language_code(c: Column) -> Column:
    """The two-letter code of a label in any spelling (code, name, with a region); null if it is missing or none of a known language."""
    k = clean(c)
    codes = F.create_map(*[F.lit(x) for kv in CODE.items() for x in kv])
    return F.when(k.isin(NO_VALUE), F.lit(None)).otherwise(F.coalesce(F.try_element_at(codes, k), F.try_element_at(codes, F.regexp_extract(k, r"^(\p{L}+)[-_ ]", 1))))


def split_sentences(text: str) -> list[str]:
    """Sentences of a text in its consistent form."""
    return [s for s in _SENTENCE.split(text) if s and not s.isspace()]


def sentences(text: str | None) -> list[str]:
    return split_sentences(canonical(text)) if text else []


class _Letters:
    """Which code points are letters (or other signs of words that are no decimal digit), filled for the common plane at first use."""

    table: np.ndarray | None = None

    @classmethod
    def of(cls, cp: np.ndarray) -> np.ndarray:
        if cls.table is None:
            cls.table = np.array([bool(_LETTER.match(chr(i))) for i in range(0x10000)])
        low = cls.table[np.minimum(cp, 0xFFFF)]
        high = cp > 0xFFFF
        if high.any():
            low[high] = [bool(_LETTER.match(chr(i))) for i in cp[high]]
        return low


def _grams(parts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n the codes of all n-grams of letters of all sentences, and the sentence of each. Words with digits (names of files, users) are left out."""
    flat = "\n".join([" " + p.replace("\n", " ") + " " for p in parts]).lower()
    cp = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    end, letter = cp == 10, _Letters.of(cp)
    # a word runs to the next blank; one with a digit or an underscore is blank as a whole
    blank = (cp == 32) | end | (cp == 9) | (cp == 13)
    word = np.cumsum(blank)
    digit = np.zeros(int(word[-1]) + 1 if len(cp) else 1, bool)
    digit[word[_DIGIT[np.minimum(cp, 0x7F)] & (cp < 0x80)]] = True
    cp = np.where(end, np.uint32(10), np.where(letter & ~digit[word], cp, np.uint32(32)))
    keep = np.ones(len(cp), bool)
    keep[1:] = (cp[1:] != 32) | (cp[:-1] != 32)
    cp = cp[keep]
    end = cp == 10
    sent = np.cumsum(end)
    out, h = [], np.full(len(cp), 3, np.uint32)
    for n in range(1, max(NGRAMS) + 1):
        m = max(0, len(cp) - n + 1)
        h = (h[:m] ^ cp[n - 1 : n - 1 + m]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n in NGRAMS:
            ok = (sent[:m] == sent[n - 1 : n - 1 + m]) & ~end[:m]
            out.append(((h & np.uint32(SIZE - 1))[ok].astype(np.int64), sent[:m][ok]))
    return out


class LanguageModel:
    def __init__(self, langs: list[str], logp: np.ndarray):
        """logp: [n-gram order, code, language], and in a last column whether any language has the n-gram."""
        self.langs, self.logp = langs, logp

    def measured(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each sentence in each language (0 in all without letters), and the share of its n-grams that no language has."""
        k = len(self.langs)
        out, n = np.zeros((len(parts), k + 1), np.float32), np.zeros(len(parts), np.int64)
        at = 0
        while at < len(parts):  # about so many characters at a time
            end, size = at, 0
            while end < len(parts) and (size < 400_000 or end == at):
                size += len(parts[end])
                end += 1
            for i, (codes, sent) in enumerate(_grams(parts[at:end])):
                if len(codes):
                    starts = np.flatnonzero(np.r_[True, sent[1:] != sent[:-1]])
                    out[at + sent[starts]] += np.add.reduceat(self.logp[i][codes], starts, axis=0)
                    n[at + sent[starts]] += np.diff(np.r_[starts, len(codes)])
            at = end
        return out[:, :k].astype(float) * TEMPER, 1 - out[:, k] / np.maximum(n, 1)

    def scores(self, parts: list[str]) -> np.ndarray:
        return self.measured(parts)[0]

    @staticmethod
    def fitted(langs: list[str], grams: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray) -> LanguageModel:
        """q: [sentence, language] shares."""
        logp = np.empty((len(NGRAMS), SIZE, len(langs) + 1), np.float32)
        for k, (codes, sent) in enumerate(grams):
            seen = np.zeros(SIZE)
            for j in range(len(langs)):
                c = np.bincount(codes, q[sent, j], SIZE)
                seen += c
                # an n-gram that a language lacks is as unlikely in each, however much text of it there was
                logp[k, :, j] = np.log((1 - UNSEEN) * c / max(c.sum(), 1) + UNSEEN / SIZE)
            logp[k, :, -1] = seen > 0
        return LanguageModel(langs, logp)

    @staticmethod
    def spoken(rows: list[tuple[str, str]], common: float = 0.05) -> list[str]:
        """The languages of the labels that texts bear out. One with a large share of the labels is taken as it is. Of a rare one, wrong labels of other languages' texts
        may be all there is: it stays if a model of one half of its texts gives most of the other half more likelihood than every common language's model does."""
        of: dict[str, list[str]] = {}
        for text, lang in rows:
            of.setdefault(lang, []).append(text)
        sure = sorted(x for x, t in of.items() if len(t) >= common * len(rows))
        out = list(sure)
        for lang in sorted(of.keys() - set(sure)):
            if len(of[lang]) < 2 or not sure:
                out += [lang] * (not sure)
                continue
            own = of[lang]
            texts = [(t, x) for x in sure for t in of[x][:50]] + [(t, lang) for t in own[::2]]
            names = [*sure, lang]
            parts = [(s, names.index(x)) for t, x in texts for s in sentences(t)]
            model = LanguageModel.fitted(names, _grams([s for s, _ in parts]), np.eye(len(names))[[j for _, j in parts]])
            best = [model.scores(s).sum(0).argmax() for s in map(sentences, own[1::2]) if s]
            if best and 2 * sum(int(b) == len(sure) for b in best) > len(best):
                out.append(lang)
        return sorted(out)

    @staticmethod
    def train(rows: list[tuple[str, str]], rounds: int = 4) -> LanguageModel:
        """rows: (text, language as labelled)."""
        langs = LanguageModel.spoken(rows)
        parts, label = [], []
        for text, lang in rows:
            if lang in langs:
                own = sentences(text)
                parts += own
                label += [langs.index(lang)] * len(own)
        lab = np.array(label, np.int64)
        q = np.eye(len(langs))[lab] if len(lab) else np.zeros((0, len(langs)))
        grams = _grams(parts)
        model = None
        for _ in range(rounds):
            model = LanguageModel.fitted(langs, grams, q)
            # a sentence is as its text is labelled unless its letters say otherwise
            s = model.scores(parts) + 2.0 * np.eye(len(langs))[lab]
            s = np.exp(s - s.max(1, keepdims=True)) if s.size else s
            q = s / s.sum(1, keepdims=True) if s.size else s
        return model

    def mixture(self, a: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Of one text's sentence scores: its languages, and for each sentence the log of proportion times likelihood of each."""
        chosen = [int(a.sum(0).argmax())]
        best, parts = a[:, chosen].sum(), a[:, chosen]
        while len(chosen) < len(self.langs):
            # no language can add more than what sentences gain that are wholly in it
            most = np.maximum(a - parts.max(1, keepdims=True), 0).sum(0)
            most[chosen] = 0
            options = []
            for j in np.flatnonzero(most > PENALTY):
                sub = a[:, [*chosen, j]]
                p = np.full(sub.shape[1], 1 / sub.shape[1])
                for _ in range(6):
                    w = np.log(np.maximum(p, 1e-9)) + sub
                    m = w.max(1)
                    r = np.exp(w - m[:, None])
                    n = r.sum(1)
                    p = (r / n[:, None]).sum(0) / len(a)
                options.append((float((m + np.log(n)).sum()), int(j), w))
            total, j, w = max(options, key=lambda x: x[0], default=(best, -1, parts))
            if total - best <= PENALTY:
                break
            best, parts = total, w
            chosen.append(j)
        return chosen, parts

    def texts(self, texts: list[str | None]) -> Iterator[list[tuple[str | None, float, int, int]]]:
        """For each text its segments: (language, confidence, sentences, characters); one of no language if it has no letters, of `und` with confidence 0 if
        nearly all its n-grams occur in none of the languages."""
        return self.split_texts([sentences(t) for t in texts])

    def split_texts(self, own: list[list[str]]) -> Iterator[list[tuple[str | None, float, int, int]]]:
        a, strange = self.measured([s for x in own for s in x])
        count = np.array([len(x) for x in own], np.int64)
        has = np.flatnonzero(count)
        first = np.cumsum(count) - count
        lettered = (a != 0).any(1) if self.langs else np.zeros(len(a), bool)
        p = np.exp(a - a.max(1, keepdims=True)) if a.size else a
        p = p / p.sum(1, keepdims=True) if a.size else a
        # texts to which no second language could add as much as the penalty need no mixture
        best, simple, sure, n, unknown = (np.zeros(len(own), t) for t in (np.int64, bool, float, float, bool))
        if len(has) and a.size:
            at = first[has]
            best[has] = np.add.reduceat(a, at).argmax(1)
            of = np.repeat(best[has], count[has])
            i = np.arange(len(a))
            simple[has] = np.add.reduceat(np.maximum(a - a[i, of][:, None], 0), at).max(1) <= PENALTY
            n[has] = np.add.reduceat(lettered.astype(float), at)
            sure[has] = np.add.reduceat(np.where(lettered, p[i, of], 0.0), at) / np.maximum(n[has], 1)
            unknown[has] = np.add.reduceat(np.where(lettered, strange, 0.0), at) > STRANGE * n[has]
        for i, parts in enumerate(own):
            if not n[i]:
                yield [(None, 0.0, len(parts), sum(map(len, parts)))]
            elif unknown[i]:
                yield [("und", 0.0, len(parts), sum(map(len, parts)))]
            elif simple[i]:
                yield [(self.langs[best[i]], round(float(sure[i]), 4), len(parts), sum(map(len, parts)))]
            else:
                at = slice(first[i], first[i] + count[i])
                yield self._segments(parts, a[at], p[at], lettered[at])

    def _segments(self, parts: list[str], b: np.ndarray, p: np.ndarray, lettered: np.ndarray) -> list[tuple[str | None, float, int, int]]:
        known = np.flatnonzero(lettered)
        chosen, w = self.mixture(b[known])
        lang = np.empty(len(parts), np.int64)
        lang[known] = np.array(chosen)[w.argmax(1)]
        # a sentence without letters goes with the one before it, at the start with the first that has letters
        lang = lang[known[np.maximum(np.searchsorted(known, np.arange(len(parts)), side="right") - 1, 0)]]
        cut = np.flatnonzero(np.r_[True, lang[1:] != lang[:-1]])
        out = []
        for lo, hi in zip(cut, [*cut[1:], len(parts)], strict=True):
            use = [i for i in range(lo, hi) if lettered[i]]
            out.append((self.langs[lang[lo]], round(float(p[use, lang[lo]].mean()), 4), int(hi - lo), sum(len(x) for x in parts[lo:hi])))
        return out


def fit(df: DataFrame, key: str, text: str, label: str, rows: int = SAMPLE_ROWS) -> LanguageModel:
    """A model of the languages that df's labels name, fitted to about `rows` labelled texts of up to LONGEST characters, as many of each language."""
    x = df.select(F.xxhash64(key).alias("h"), F.col(key).alias("k"), F.col(text).alias("t"), language_code(F.col(label)).alias("l")).where(f"l is not null and length(t) between 1 and {LONGEST}")
    n = {r["l"]: r["n"] for r in x.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not n:
        return LanguageModel.train([])
    per = max(LEAST_ROWS, rows // len(n))
    # rows that can't be among a language's smallest hashes are dropped where they are
    most = F.create_map(*[F.lit(v) for lang, m in n.items() for v in (lang, int(-(2**63) + 2**64 * min(1.0, 1.5 * per / m)) - (1.5 * per >= m))])
    own: dict[str, list] = {lang: [] for lang in n}
    for r in x.where(F.col("h") <= most[F.col("l")]).collect():
        own[r["l"]].append((r["h"], r["k"], r["t"]))
    return LanguageModel.train([(t, lang) for lang in sorted(own) for _, _, t in sorted(own[lang])[:per]])


def segments(df: DataFrame, key: str, text: str, model: LanguageModel) -> DataFrame:
    """key, segment_no, lang, confidence, n_sentences, n_chars, n_langs of each segment of each text.

    A text that is null, empty or without letters has one segment, whose lang is null; one in none of the model's languages has one, `und`. Whole texts are read, however long.
    """
    kind = df.schema[key].dataType.simpleString()
    names = [key, "segment_no", "lang", "confidence", "n_sentences", "n_chars", "n_langs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                rows: list[tuple] = []
                for i, s in enumerate(model.texts(part.column(1).to_pylist())):
                    k = len({x[0] for x in s if x[0]})
                    rows += [(i, j, *x, k) for j, x in enumerate(s)]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(cols[0])), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.float64()), *[pa.array(c, pa.int32()) for c in cols[4:]]], names)

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, segment_no int, lang string, confidence double, n_sentences int, n_chars int, n_langs int")


def relabelled(df: DataFrame, key: str, text: str, label: str, model: LanguageModel) -> DataFrame:
    """Segments of the texts whose label is missing or wrong, and of all that have more than one language."""
    given = df.select(key, language_code(F.col(label)).alias("given"))
    s = segments(df, key, text, model).where("lang is not null and lang <> 'und'")
    return s.join(given, key).where("n_langs > 1 or given is null or given <> lang")
