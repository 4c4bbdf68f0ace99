"""Problem 6: defective prompt and response pairs.

Openings of responses (their first words, names and numbers masked) are clustered by MinHash over their words, candidates being verified exactly. A cluster that recurs
across unrelated prompts and whose responses stop short, where responses of the table usually go on, is a refusal's template, and its short responses refuse. For responses whose
opening is too rare to tell, a word model of templates' responses against those that go on decides. Whether a response broke off is judged by how often complete
sentences end, and how often they go on, after its last words; copies by the share of its word triples that are the prompt's; its language by the n-gram mixture of problem 5.

Texts are read once: that pass leaves each response's words as codes, and all that follows reads only these.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import smallest, stored
from lodestone.llm.confusables import canonical
from lodestone.llm.grouping import connected
from lodestone.llm.language import LANGUAGES, LONGEST, LanguageModel, split_sentences
from lodestone.llm.wordsets import mix

#: Words of an opening; similarity (of words counted with repeats) of a cluster's openings: one of ten words may differ.
OPENING, SIMILAR = 10, 0.8
#: Rows x bands of an opening's MinHash signature: a pair that differs in one of ten words shares no band with probability (1 - 0.82^4)^12 = 0.0008.
ROWS, BANDS = 4, 12
#: A template recurs with at least so many different prompts; so large a share of its responses are short.
PROMPTS, SHORT_SHARE = 3, 0.9
#: Responses of each kind, of up to LONGEST words, to which the word model is fitted at most, those whose keys have the smallest hashes. They are labelled by their templates.
SAMPLE_ROWS = 6000
#: Share of a copy's word triples that are in the prompt.
COPIED = 0.8
#: Bits of the table in which the last words of responses without a stop are marked: a word end that isn't one of them is counted in vain with the share of bits that are set.
MARKS = 1 << 26

# Answers that stand for no answer, in lower case without outer brackets and punctuation.
NO_ANSWER = ["", "no response", "no answer", "no output", "empty", "empty response", "n/a", "na", "none", "null", "nil", "nan", "undefined", "blank", "no reply", "no content", "not available", "missing", "tbd", "todo"]
# The languages' names (stems, lower case) as prompts in the six languages of the data write them after a word for "answer".
ASKED = {
    "en": "english englisch anglais inglés ingles inglese английск", "de": "german deutsch allemand alemán aleman tedesco немецк",
    "fr": "french französisch français francais francés frances francese французск", "es": "spanish spanisch espagnol español espanol spagnolo испанск",
    "it": "italian italienisch italien italiano итальянск", "ru": "russian russisch russe ruso russo русск",
}
ANSWER = r"(?:answer|reply|respond|response|write|antworte|antwort|schreibe|réponds|répondez|réponse|écris|responde|respuesta|contesta|escribe|rispondi|risposta|scrivi|ответь|ответьте|ответ|пиши|отвечай)"
_ASKED = [(lang, re.compile(ANSWER + r"\b[^.!?\n]{0,40}?\b(?:" + "|".join(v.split()) + ")")) for lang, v in ASKED.items()]
_ANSWER = re.compile(ANSWER)

_DIGIT = re.compile(r"\d")
_WORD = re.compile(r"(?:[^\W\d_]|['’])+|[#\x01]")
_FENCE = re.compile(r"```.*?```", re.S)
_SIGNED = re.compile(r"\n\s*(?:--|—|–)\s[^\n]*\Z")
_FIELD = re.compile(r"\"\w+\"\s*:")
# Errors that tell of a cut; they count only where the last sentence has no stop.
_CUT = re.compile(r"(?i)max[_ ]?tokens (?:reached|exceeded)|finish_reason\s*[=:]\s*length|stream closed|cut off|truncated")
_CLOSED = re.compile(r"[.!?。！？][\"'»”)\]]*\s*\Z")

#: Codes of the ends of sentences with and without a stop, and of what is before the first word; words have codes from 0 on.
STOP, OPEN, START = -1, -2, -3
_CODES: dict[str, int] = {}
_MOST_WORDS = 500_000  # words kept in a worker's memory; beyond that it starts anew
U = np.uint64


def prose(response: str | None) -> str:
    """The response in its consistent form without code, signature and the names of JSON fields."""
    return _prose(canonical(response or "").strip())


def _prose(text: str) -> str:
    if "\n" in text:
        text = _SIGNED.sub("", _FENCE.sub("\n", text)).strip()
    return _FIELD.sub(" ", text) if text[:1] in "{[" else text


class _Tokens(dict):
    """Words of what stands between blanks (lower case), kept as it occurs; what has a digit is a name, "#"."""

    def __missing__(self, token: str) -> tuple[str, ...]:
        if _DIGIT.search(token):
            return ("#",)
        words = tuple(_WORD.findall(token))
        if len(self) >= _MOST_WORDS:
            self.clear()
        self[token] = words
        return words


_TOKENS = _Tokens()


def masked(sentence: str) -> list[str]:
    """Words in lower case, names and numbers masked."""
    return [w for t in sentence.lower().split() for w in _TOKENS[t]]


def is_empty(response: str | None) -> bool:
    return response is None or _is_empty(canonical(response))


def _is_empty(text: str) -> bool:
    return text.strip().lower().strip(" \t\n()[]<>{}\"'.-_*…") in NO_ANSWER if len(text) < 200 else not text.strip(" \t\n()[]<>{}\"'.-_*…")


class Prompt:
    """What is known of a prompt."""

    def __init__(self, prompt: str | None):
        self.text = canonical(prompt or "")
        self.words = masked(self.text)
        self.different = frozenset(self.words)
        self._triples: set[tuple] | None = None

    @property
    def triples(self) -> set[tuple]:
        if self._triples is None:
            self._triples = _triples(self.words)
        return self._triples


def _triples(words: list[str]) -> set[tuple]:
    return set(zip(words, words[1:], words[2:], strict=False))


def is_copy(prompt: Prompt, text: str, words: list[str]) -> bool:
    """Whether nearly all word triples of the response (text, its masked words), and so all but slight changes and marks, are the prompt's. A response of fewer than three
    different triples is a copy if four fifths of the different words of both are common to both."""
    some = set(words)
    if 2 * len(some & prompt.different) < len(some):
        return False
    own = _triples(words)
    if len(own) < 3:
        a, b = (set(re.findall(r"\w+", x.lower())) for x in (text, prompt.text))
        return bool(a) and 5 * len(a & b) >= 4 * len(a | b)
    return len(own & prompt.triples) >= COPIED * len(own)


def is_closed(sentence: str) -> bool:
    return sentence[-1:] in ".!?" or bool(_CLOSED.search(sentence[-8:]))


def codes(words: list[str]) -> np.ndarray:
    """Codes of words, of 31 bits."""
    for x in set(words).difference(_CODES):
        _CODES[x] = xxhash.xxh32_intdigest(x) & 0x7FFFFFFF
    out = np.fromiter(map(_CODES.__getitem__, words), np.int32, len(words))
    if len(_CODES) > _MOST_WORDS:
        _CODES.clear()
    return out


def coded(own: list[str]) -> np.ndarray:
    """The words' codes of sentences, each followed by STOP or OPEN."""
    return np.concatenate([np.r_[codes(masked(s)), np.int32(STOP if is_closed(s) else OPEN)] for s in own] or [np.zeros(0, np.int32)]).astype(np.int32)


@dataclass
class WordModel:
    """Log-odds of hashed words and word pairs, positive for refusals."""

    odds: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    SIZE = 1 << 16

    @classmethod
    def features(cls, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Of coded responses one after another: the different words and word pairs (hashed) of each sentence, the sentence of each, and the number of sentences."""
        end = c < 0
        sent = np.cumsum(end) - end
        before = np.r_[np.int64(START), c[:-1].astype(np.int64)]
        before = np.where(before < 0, START, before)
        this = np.where(end, STOP, c.astype(np.int64))
        pair = (mix((before.astype(U) << U(32)) ^ (this.astype(U) & U(0xFFFFFFFF))) % U(cls.SIZE)).astype(np.int64)
        word = this[~end] % cls.SIZE
        x = np.unique(np.concatenate([(sent[~end].astype(np.int64) << 17) | word, (sent.astype(np.int64) << 17) | (1 << 16) | pair]))
        return ((x & 0xFFFF) ^ np.where(x & 0x10000, 0x5BD1, 0)) & 0xFFFF, x >> 17, int(end.sum())

    @classmethod
    def train(cls, yes: np.ndarray, no: np.ndarray) -> WordModel:
        """yes, no: coded sentences of refusals and of others."""
        k, n = [], []
        for c in (yes, no):
            f, _, m = cls.features(c) if len(c) else (np.zeros(0, np.int64), None, 0)
            k.append(np.bincount(f, minlength=cls.SIZE))
            n.append(m)
        if not n[0]:
            return cls()
        # shares are smoothed alike, however many sentences there are of each, so that what neither has says nothing
        few = 0.5 / n[0]
        return cls(np.log((k[0] / n[0] + few) / (k[1] / max(n[1], 1) + few)).astype(np.float32))

    def scores(self, c: np.ndarray) -> np.ndarray:
        """A score for each sentence."""
        f, sent, n = self.features(c)
        if not len(self.odds):
            return np.full(n, -1.0)
        k = np.bincount(sent, minlength=n)
        return np.bincount(sent, self.odds[f], minlength=n) / np.sqrt(np.maximum(k, 1)) - (k == 0)


def last_open(text: str) -> bool | str:
    """Whether the response (in its consistent form) breaks off, where marks tell; else its last sentence, which lacks its stop."""
    text = text.strip()
    body = _SIGNED.sub("", text).strip() if "\n" in text else text
    if "```" in body:
        if body.count("```") % 2:
            return True
        if body.endswith("```"):
            return False
    if body[:1] in "{[":
        return body[-1:] not in "}]"
    if body.endswith(("…", "...")):
        body = body.rstrip("….").rstrip()
    elif body[-1:] in ".!?" or _CLOSED.search(body[-8:]):
        return False
    own = split_sentences(_FENCE.sub("\n", body))
    return own[-1] if own else False


def opening(own: list[str]) -> str:
    return " ".join(masked(" ".join(own[:2]))[:OPENING])


def asked(text: str) -> set[str]:
    """Languages that the prompt (in its consistent form) asks the answer to be in."""
    text = text.lower()
    return {lang for lang, r in _ASKED if r.search(text)} & set(LANGUAGES) if _ANSWER.search(text) else set()


READ = "prompt long, kind string, opening string, n_sentences int, broken boolean, cut boolean, tail array<int>, foreign boolean, codes array<int>"


class Reader:
    """What is read of pairs, once: see READ. Prompts met lately are remembered."""

    def __init__(self, language: LanguageModel):
        self.language = language
        self.prompts: dict[str | None, Prompt] = {}
        self.spoken: dict[str | None, set[str]] = {}

    def rows(self, prompts: list[str | None], responses: list[str | None], errors: list[str | None]) -> list[pa.Array]:
        n = len(prompts)
        kind: list[str | None] = [None] * n
        first: list[str | None] = [None] * n
        broken, cut, foreign = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
        length = np.zeros(n, np.int32)
        tails: list[list[int] | None] = [None] * n
        words: list[list[str]] = [[]] * n
        stops: list[bool] = []
        rest, answers, new = [], [], {}
        if len(self.prompts) > 4000:
            self.prompts.clear()
            self.spoken.clear()
        for i, (p, r, e) in enumerate(zip(prompts, responses, errors, strict=True)):
            text = canonical(r)
            if text is None or _is_empty(text):
                kind[i] = "empty"
                continue
            own = split_sentences(_prose(text.strip()))
            length[i] = len(own)
            # all sentences' words at once, with a mark after each
            w = masked(" \x01 ".join([*(own if "\x01" not in text else [s.replace("\x01", " ") for s in own]), ""]))
            plain = [x for x in w if x != "\x01"]
            if p not in self.prompts:
                self.prompts[p] = Prompt(p)
            if p is not None and is_copy(self.prompts[p], text, plain):
                kind[i] = "copy"
            if own:
                words[i] = w
                stops += map(is_closed, own)
                # the first two sentences' words
                at = w.index("\x01", w.index("\x01") + 1) - 1 if len(own) > 2 else len(plain)
                first[i] = " ".join(plain[: min(at, OPENING)]) or None
            if kind[i]:
                continue
            x = last_open(text)
            if isinstance(x, str):
                tails[i] = [START, START, *codes(masked(x)).tolist()][-3:]
                cut[i] = bool(e and _CUT.search(e))
            else:
                broken[i] = x
            rest.append(i)
            answers.append(own)
            if p not in self.spoken and p not in new:
                new[p] = split_sentences(self.prompts[p].text)
        found = [{x[0] for x in s if x[0] and x[0] != "und"} for s in self.language.split_texts([*new.values(), *answers])]
        self.spoken.update(zip(new, found, strict=False))
        for i, ours in zip(rest, found[len(new) :], strict=True):
            theirs = self.spoken[prompts[i]]
            foreign[i] = bool(ours and theirs and not (theirs & ours)) and not (ours & asked(self.prompts[prompts[i]].text))
        ids = [None if p is None else xxhash.xxh64_intdigest(p) - (1 << 63) for p in prompts]
        c = codes([x for w in words for x in w])
        c[c == _MARK] = np.where(np.array(stops, bool), STOP, OPEN)
        flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, words)]), pa.int32()), pa.array(c))
        return [pa.array(ids, pa.int64()), pa.array(kind, pa.string()), pa.array(first, pa.string()), pa.array(length), pa.array(broken), pa.array(cut), pa.array(tails, pa.list_(pa.int32())), pa.array(foreign), flat]


_MARK = xxhash.xxh32_intdigest("\x01") & 0x7FFFFFFF


def read(df: DataFrame, key: str, prompt: str, response: str, error: str, language: LanguageModel) -> DataFrame:
    """key and READ of each row, written to the shared folder. Rows of a prompt are brought together, so that it is read once; a prompt with very many rows is split by Spark's
    rebalancing."""
    kind = df.schema[key].dataType.simpleString()
    reader = Reader(language)
    names = [key, *(x.split()[0] for x in READ.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), *reader.rows(*[part.column(i).to_pylist() for i in (1, 2, 3)])], names)

    return stored(df.select(key, prompt, response, error).hint("rebalance", F.col(prompt)).mapInArrow(run, f"`{key}` {kind}, {READ}"), "pairs")


def usual_length(op: DataFrame) -> int:
    """The number of sentences that most openings' responses have, each opening counted once with its median: however many rows refusals make, they share few openings."""
    own = op.groupBy("opening").agg(F.percentile_approx("n_sentences", 0.5, 10000).alias("n"))
    n = own.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    return int(n["n"]) if n else 0


_SEEDS = np.random.Generator(np.random.PCG64(6)).integers(1, 2**63, ROWS * BANDS, dtype=np.uint64) | U(1)


def _word_keys(text: str) -> np.ndarray:
    """Keys of an opening's words, each with how often it occurred before."""
    seen: dict[str, int] = {}
    out = np.zeros(OPENING, U)
    w = text.split()[:OPENING]
    for i, x in enumerate(w):
        seen[x] = seen.get(x, 0) + 1
        out[i] = xxhash.xxh3_64_intdigest(f"{x} {seen[x]}")
    return out[: len(w)]


def signatures(texts: list[str]) -> np.ndarray:
    """[opening, band]: hashes of ROWS minima each, as int64. Every opening has a word."""
    k = [_word_keys(t) for t in texts]
    flat = np.concatenate(k) if k else np.zeros(0, U)
    starts = np.cumsum([0, *map(len, k)])[:-1]
    out = np.zeros((BANDS, len(k)), U)
    for i in range(ROWS * BANDS if len(k) else 0):
        out[i // ROWS] = mix(out[i // ROWS] + np.minimum.reduceat(mix(flat * _SEEDS[i]), starts))
    return mix(out + np.arange(BANDS, dtype=U)[:, None]).view(np.int64).T


def clusters(op: DataFrame) -> DataFrame:
    """opening, cluster: openings of responses that stop short (`short`; all that have a row where it is true) with those, short or not, that are at least SIMILAR to one of them, and so on
    from short one to short one; clusters have the name of their smallest opening. An opening that is like no other is a cluster of its own.

    In each band's bucket all openings meet the short opening with the smallest hash, which differs from bucket to bucket, and pairs are verified exactly; so a bucket costs
    as many rows as it has openings.
    """
    own = stored(op.groupBy("opening").agg(F.max("short").alias("short")), "openings")

    @F.arrow_udf("array<bigint>")
    def banded(texts: pa.Array) -> pa.Array:
        s = signatures(texts.to_pylist())
        return pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * BANDS, pa.int32()), pa.array(s.ravel()))

    part = own.select("opening", "short", F.explode(banded("opening")).alias("k"))
    part = stored(part, "bands")
    centre = F.when(F.col("short"), F.struct(F.xxhash64("opening", "k").alias("h"), "opening"))
    first = part.groupBy("k").agg(F.min(centre).alias("m"), F.count("*").alias("n")).where("n > 1 and m is not null").select("k", F.col("m.opening").alias("v"))
    pairs = part.join(first, "k").where("opening <> v").select(F.col("opening").alias("u"), "v", "short").distinct()

    def words(c: str):
        # words with their number, so that arrays are multisets
        w = F.split(c, " ")
        return F.transform(w, lambda x, i: F.concat(x, F.lit(" "), F.size(F.filter(F.slice(w, F.lit(1), i + 1), lambda y: y == x)).cast("string")))

    both = F.size(F.array_intersect(words("u"), words("v")))
    near = stored(pairs.where(both >= SIMILAR * (F.size(F.split("u", " ")) + F.size(F.split("v", " ")) - both)), "links")
    found = connected(near.where("short").select("u", "v")).select(F.col("node").alias("v"), F.col("component").alias("c"))
    # long openings go with the short one they are linked to, the smallest cluster if there are several
    named = own.where("short").select(F.col("opening").alias("v")).join(found, "v", "left").select("v", F.coalesce("c", "v").alias("c"))
    long = near.where("not short").join(named, "v").groupBy(F.col("u").alias("opening")).agg(F.min("c").alias("cluster"))
    rest = own.where("not short").join(long, "opening", "left").select("opening", F.coalesce("cluster", "opening").alias("cluster"))
    return named.select(F.col("v").alias("opening"), F.col("c").alias("cluster")).unionByName(rest)


def templates(op: DataFrame, usual: int, share: float = SHORT_SHARE, prompts: int = PROMPTS) -> DataFrame:
    """Openings of clusters that recur across different prompts and whose responses stop before the usual number of sentences. op: opening, n_sentences, prompt (a null prompt counts as none)."""
    x = op.withColumn("short", F.col("n_sentences") < usual)
    c = stored(clusters(x.select("opening", "short")), "clusters")
    per = x.join(c, "opening").groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.col("short").cast("int")).alias("s"), F.approx_count_distinct("prompt", 0.03).alias("p"))
    return c.join(per.where(f"p >= {prompts} and s >= {share} * n").select("cluster"), "cluster", "left_semi").select("opening")


def _ends_of(c: np.ndarray, place: np.ndarray) -> np.ndarray:
    """[3, place]: keys of the last one, two and three words up to each place of c, which doesn't look before the sentence's start."""
    w = c.astype(np.int64)
    one = w[place]
    two = np.where(place >= 1, w[place - 1], START)
    two = np.where(two < 0, START, two)
    three = np.where((place >= 2) & (two != START), w[place - 2], START)
    three = np.where(three < 0, START, three)
    k1 = mix(one.astype(U) + U(1))
    k2 = mix(k1 + (two.astype(U) << U(1)) + U(2))
    k3 = mix(k2 + (three.astype(U) << U(2)) + U(3))
    return np.stack([k1, k2, k3])


def ends(rows: DataFrame, key: str, whole: DataFrame) -> DataFrame:
    """key, ended of rows with a `tail` (the last words of a sentence without its stop): whether it is complete, that is whether its last three words (two, one, the first of these that occur at least
    four times; one word always) have ended sentences at least a tenth of the times they occur. Counted in all sentences of `whole` (codes) that have a stop, but each text's last.

    Only a table of marks, of a fixed size, is sent around: word ends that aren't marked are not counted.
    """
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                col = b.column(1)
                n = np.diff(col.offsets.to_numpy())
                flat = col.flatten().to_numpy(zero_copy_only=False)
                k = _ends_of(flat, np.cumsum(n) - 1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(3, dtype=np.int32) + 1, len(n))), pa.concat_arrays([b.column(0)] * 3), pa.array(k.ravel())], ["words", key, "k"])

    last = stored(rows.where("tail is not null").select(key, "tail").mapInArrow(tails, f"words int, `{key}` {kind}, k long"), "tails")
    bit = F.expr(f"pmod(k, {MARKS})")
    got = last.select(bit.alias("b")).groupBy(F.expr("b div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("m")).toPandas()
    marks = np.zeros(MARKS // 64, np.int64)
    marks[got["w"].to_numpy(np.int64)] = got["m"].to_numpy(np.int64)
    sent = spark.sparkContext.broadcast(marks.view(np.uint64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(0)
            c = col.flatten().to_numpy(zero_copy_only=False)
            if not len(c):
                continue
            end = c < 0
            # the number of sentences left in the text after each place, and whether the own one has a stop
            at = np.flatnonzero(end)
            sentence = np.cumsum(end) - end
            closed = c[at][sentence] == STOP
            final = np.zeros(len(at), bool)
            final[sentence[np.cumsum(np.diff(col.offsets.to_numpy()))[np.diff(col.offsets.to_numpy()) > 0] - 1]] = True
            place = np.flatnonzero(~end & closed & ~final[sentence])
            k = _ends_of(c, place)
            i = k % U(MARKS)
            hit = (sent.value[(i >> U(6)).astype(np.int64)] >> (i & U(63))) & U(1) == 1
            ending = np.broadcast_to(end[np.minimum(place + 1, len(c) - 1)], k.shape)
            key_, e = k[hit].view(np.int64), ending[hit]
            u, back = np.unique(key_, return_inverse=True)
            e_ = np.bincount(back, e, len(u)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(e_), pa.array(np.bincount(back, minlength=len(u)).astype(np.int64))], ["k", "e", "n"])

    counts = whole.select("codes").mapInArrow(count, "k long, e long, n long").groupBy("k").agg(F.sum("e").alias("e"), F.sum("n").alias("n"))
    x = last.join(counts, "k", "left").where("n >= 4 or (words = 1 and n > 0)")
    best = x.groupBy(key).agg(F.max_by(F.expr("10 * e >= n"), "words").alias("ended"))
    return last.where("words = 1").select(key).join(best, key, "left").select(key, F.coalesce("ended", F.lit(False)).alias("ended"))


def _sample(rows: DataFrame, key: str, n: int) -> np.ndarray:
    """The codes of the sample, one response after another."""
    keys = stored(smallest(rows.where(f"size(codes) <= {LONGEST}").select(key), key, n), "sample")
    got = rows.select(key, "codes").join(F.broadcast(keys), key, "left_semi").toArrow()
    got = got.sort_by(key)["codes"].combine_chunks()
    return (got.flatten() if isinstance(got, pa.ListArray) else pa.concat_arrays([x.flatten() for x in got.chunks])).to_numpy(zero_copy_only=False)


def refusals(rows: DataFrame, key: str, usual: int, model: WordModel) -> DataFrame:
    """key of the rows (codes, n_sentences, template) that refuse. A short response with a template's opening does, unless a sentence after its first is none of a refusal by the word model; of
    other openings, a response does all whose sentences are of one."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 5000):
                p = b.slice(at, 5000)
                n = p.column(2).to_numpy(zero_copy_only=False)
                known = p.column(3).to_numpy(zero_copy_only=False) & (n < usual)
                # most responses are told by their first sentence
                c = p.column(1).flatten().to_numpy(zero_copy_only=False)
                end = c < 0
                sent = np.cumsum(end) - end
                start = np.cumsum(n) - n
                opens = np.zeros(int(n.sum()), bool)
                opens[start] = True
                may = (model.scores(c[opens[sent]]) > 0) | known
                p = p.filter(pa.array(may))
                n, known = n[may], known[may]
                if len(n):
                    ok = model.scores(p.column(1).flatten().to_numpy(zero_copy_only=False)) > 0
                    start = np.cumsum(n) - n
                    ok[start[known]] = True
                    yield pa.RecordBatch.from_arrays([p.column(0).filter(pa.array(np.logical_and.reduceat(ok, start)))], [key])

    return rows.where("n_sentences > 0").select(key, "codes", "n_sentences", "template").mapInArrow(run, f"`{key}` {kind}")


def defective(df: DataFrame, key: str, prompt: str, response: str, error: str, language: LanguageModel, rows: int = SAMPLE_ROWS) -> DataFrame:
    """key, defect of the rows that have one. A null response is empty; a null prompt is no language and is copied by nothing."""
    x = read(df, key, prompt, response, error, language)
    op = x.where("opening is not null").select("opening", "n_sentences", "prompt")
    usual = usual_length(op)
    known = stored(templates(op, usual), "templates").withColumn("template", F.lit(True))
    x = x.join(known, "opening", "left").withColumn("template", F.coalesce("template", F.lit(False))).drop("opening", "prompt")
    x = stored(x, "flagged")
    short, whole = x.where(f"template and n_sentences < {usual} and kind is null"), x.where(f"not template and n_sentences >= {usual}")
    model = WordModel.train(_sample(short, key, rows), _sample(whole, key, rows))
    no = refusals(x.where("kind is null"), key, usual, model).withColumn("refused", F.lit(True))
    last = ends(x, key, whole)
    out = x.select(key, "kind", "broken", "cut", "foreign", F.col("tail").isNotNull().alias("open")).join(no, key, "left").join(last, key, "left")
    cut = F.col("broken") | (F.col("open") & (F.col("cut") | ~F.coalesce("ended", F.lit(True))))
    defect = F.coalesce("kind", F.when(F.col("refused"), "refusal").when(cut, "truncated").when(F.col("foreign"), "wrong_language"))
    return out.select(key, defect.alias("defect")).where("defect is not null")
