"""Problem 10: subject areas of documents by interpolated n-gram language models.

Each subject has a model of words and word pairs, interpolated with that of all text, which is also the background that it is compared with. The models
are fitted to a bounded sample of documents, then counted once more over all documents; of the sample those that a reader labelled start them: sentences are then assigned to the models they gain by, and
the models fitted anew, so that wrong and missing labels and sentences on nothing don't spoil them. A sentence's gain by a subject is the background's cross-entropy per word minus the subject's; the
gain from which it is on the subject is calibrated for each subject on labelled documents that the models weren't started with. A paragraph deals with a subject if enough of its sentences are on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import present, smallest, spread
from lodestone.llm.confusables import canonical
from lodestone.llm.language import LONGEST, sentences
from lodestone.llm.pairs import masked

SIZE, PAIRS = 1 << 16, 1 << 18
#: Code of what is before the first word.
BEGIN = xxhash.xxh32_intdigest("^") % SIZE
#: Labelled and other documents that start the models at most, those whose keys have the smallest hashes, of up to LONGEST characters; all documents are counted in the end.
LABELLED, OTHERS = 4000, 4000
#: Parts of the labelled documents; models started with the other parts' labels say how each part's documents score, by which the acceptance is calibrated. A subject with fewer than FEW
#: documents is accepted as all together are.
FOLDS, FEW = 2, 20
#: A paragraph deals with a subject if it has at least SENTENCES sentences, of which as many are on it, and at least SHARE of those on any.
SENTENCES, SHARE = 3, 0.3
#: Gain per word (nats) from which a sentence is on a subject where there are no held-out documents to tell.
GAIN = 0.25
#: While the models start: share of a word's occurrences that a subject must have for the word to speak for it, the occurrences that all text's share weighs, and the gain that a sentence
#: on a subject has in all. Until the sentences on nothing are found, only words that are mostly one subject's tell.
FLOOR, KAPPA, START = 0.5, 1.0, 1.2

_PARAGRAPH = regex.compile(r"\n+")


def paragraphs(text: str | None) -> list[list[str]]:
    if not text:
        return []
    return [s for s in (sentences(p) for p in _PARAGRAPH.split(canonical(text))) if s]


def _codes(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all sentences' words (names left out) and word pairs (each word with the one before), and the number of words of each sentence."""
    own = [masked(s) for s in parts]
    flat = [x for w in own for x in w]
    for x in set(flat).difference(_MEMO):
        _MEMO[x] = xxhash.xxh32_intdigest(x) % SIZE
    c = np.fromiter(map(_MEMO.__getitem__, flat), np.int64, len(flat))
    if len(_MEMO) > 300_000:
        _MEMO.clear()
        _MEMO["#"] = _NAME
    sent = np.repeat(np.arange(len(own)), [len(w) for w in own])
    is_word = c != _NAME
    c, sent = c[is_word], sent[is_word]
    before = np.full(len(c), BEGIN)
    before[1:] = np.where(sent[1:] == sent[:-1], c[:-1], BEGIN)
    return c, (before * 40503 + c * 7919 + 11) % PAIRS, np.bincount(sent, minlength=len(own))


_NAME = -1
_MEMO: dict[str, int] = {"#": _NAME}


class SubjectModel:
    """Counts of words and pairs of words on each subject and in all text, and the gain from which a sentence is on each subject."""

    def __init__(self, subjects: list[str], words: np.ndarray, pairs: np.ndarray, all_words: np.ndarray, all_pairs: np.ndarray, least: np.ndarray | None = None):
        self.subjects, self.words, self.pairs, self.all_words, self.all_pairs = subjects, words, pairs, all_words, all_pairs
        self.least = np.full(len(subjects), GAIN) if least is None else least
        # the counts of a word's subjects side by side
        self._words, self._pairs = np.ascontiguousarray(words.T), np.ascontiguousarray(pairs.T)
        self.prior = (words.sum(1) + 1) / (all_words.sum() + len(subjects) + 1)

    @staticmethod
    def fitted(of: np.ndarray, counted: np.ndarray, codes: tuple, subjects: list[str]) -> SubjectModel:
        """of: each sentence's subject, -1 for none; counted: the sentences that all text consists of."""
        u, b, n = codes
        sent = np.repeat(np.arange(len(n)), n)
        k, on, use = len(subjects), of[sent], counted[sent]
        words, pairs = np.zeros((k, SIZE), np.float32), np.zeros((k, PAIRS), np.float32)
        for j in range(k):
            words[j] = np.bincount(u[use & (on == j)], minlength=SIZE)
            pairs[j] = np.bincount(b[use & (on == j)], minlength=PAIRS)
        return SubjectModel(subjects, words, pairs, np.bincount(u[use], minlength=SIZE).astype(np.float32), np.bincount(b[use], minlength=PAIRS).astype(np.float32))

    def gains(self, codes: tuple) -> np.ndarray:
        """[sentence, subject]: the background's cross-entropy per word minus the subject's, over the words that tell. A word's probability after another is interpolated from the pair's, the word's
        and all text's counts, in the form in which it is compared: times the subject's prior, over the background's probability, that is the share of the word's occurrences that the subject
        has. Below FLOOR a share tells of the languages and sources that a subject is frequent in rather than of the subject, so such a word is taken to be as probable in both."""
        u, b, n = codes
        k = len(self.subjects)
        out = np.zeros(len(n) * k)
        sent = np.repeat(np.arange(len(n)), n)
        for at in range(0, len(u), 100_000):
            w, p, of = u[at : at + 100_000], b[at : at + 100_000], sent[at : at + 100_000]
            word = (self._words[w] + KAPPA * self.prior) / (self.all_words[w] + KAPPA)[:, None]
            share = (self._pairs[p] + KAPPA * word) / (self.all_pairs[p] + KAPPA)[:, None]
            i, j = np.nonzero(share >= FLOOR)
            out += np.bincount(of[i] * k + j, np.log(share[i, j] / self.prior[j]), len(out))
        return out.reshape(len(n), k) / np.maximum(n, 1)[:, None]

    def assigned(self, codes: tuple, start: bool = False) -> np.ndarray:
        """Each sentence's subject, that of the largest gain if it is large enough for it; -1 for none."""
        g = self.gains(codes)
        if start:
            g = g * codes[2][:, None]
        if not g.size:
            return np.full(len(g), -1)
        best = g.argmax(1)
        return np.where(g[np.arange(len(g)), best] >= (START if start else self.least[best]), best, -1)

    def settled(self, codes: tuple, para: np.ndarray, start: bool = False) -> np.ndarray:
        """Each sentence's subject, that of most of its paragraph (para: its number, from 0 on) where it has no gain; -1 for none."""
        of = self.assigned(codes, start)
        near = np.zeros((para[-1] + 1, len(self.subjects)))
        np.add.at(near, (para[of >= 0], of[of >= 0]), 1)
        top, n = near.argmax(1), near.max(1)
        return np.where(of >= 0, of, np.where((n >= SENTENCES) & (n > 0.6 * np.bincount(para)), top, -1)[para])

    @staticmethod
    def train(docs: list[tuple[str, str | None, bool]], subjects: list[str], rounds: int = 6) -> SubjectModel:
        """docs: (text, subject as labelled, whether labelled at all). At first the sentences of labelled documents are on the document's subject; then
        each is on what it gains most by, and one without a gain on what most of its paragraph is on."""
        subjects = sorted(subjects)
        parts, doc, para, given, known = [], [], [], [], []
        for text, label, has in docs:
            d = len(given)
            given.append(subjects.index(label) if has and label in subjects else -1)
            known.append(has)
            for own in paragraphs(text):
                n = para[-1] + 1 if para else 0
                parts += own
                doc += [d] * len(own)
                para += [n] * len(own)
        codes = _codes(parts)
        doc_, para_ = np.array(doc, np.int64), np.array(para, np.int64)
        of = np.array(given, np.int64)[doc_] if parts else np.zeros(0, np.int64)
        counted = np.array(known, bool)[doc_] if parts else np.zeros(0, bool)
        model = SubjectModel.fitted(of, counted, codes, subjects)
        for _ in range(rounds if parts and subjects else 0):
            model = SubjectModel.fitted(model.settled(codes, para_, True), np.ones(len(parts), bool), codes, subjects)
        return model

    def texts(self, texts: list[str | None]) -> Iterator[dict[str, int]]:
        """For each text the subjects it deals with, and the sentences on each in paragraphs that do."""
        return self.paragraphs([paragraphs(t) for t in texts])

    def paragraphs(self, own: list[list[list[str]]]) -> Iterator[dict[str, int]]:
        """As texts(), of the sentences of the paragraphs of each text."""
        of = self.assigned(_codes([s for x in own for p in x for s in p]))
        at, k = 0, len(self.subjects)
        for x in own:
            out: dict[str, int] = {}
            for p in x:
                n = np.bincount(of[at : at + len(p)] + 1, minlength=k + 1)
                at += len(p)
                if len(p) >= SENTENCES:
                    none, n = n[0], n[1:]
                    # where all others are on one subject, a sentence that is on none by itself goes with them
                    if none == 1 and np.count_nonzero(n) == 1:
                        n = np.where(n > 1, n + 1, n)
                    for j in np.flatnonzero((n >= SENTENCES) & (n >= SHARE * n.sum())):
                        out[self.subjects[j]] = out.get(self.subjects[j], 0) + int(n[j])
            yield out

    def document_gains(self, texts: list[str]) -> np.ndarray:
        """[text, subject]: the gain that enough sentences of a paragraph reach (see paragraphs()), the largest of all paragraphs."""
        out = np.full((len(texts), len(self.subjects)), -np.inf)
        for i, text in enumerate(texts):
            own = [p for p in paragraphs(text) if len(p) >= SENTENCES]
            all_ = self.gains(_codes([s for p in own for s in p]))
            at = 0
            for p in own:
                g = all_[at : at + len(p)]
                at += len(p)
                g = np.where(g == g.max(1, keepdims=True), g, -np.inf)
                # in the shortest paragraphs one may go with the others
                out[i] = np.maximum(out[i], np.sort(g, 0)[len(p) - (SENTENCES - (len(p) == SENTENCES))])
        return out

    def accepting(self, score: np.ndarray, labels: list[str | None]) -> SubjectModel:
        """The model with the acceptance of each subject that best tells apart the documents that are labelled so from the others: the gain at which the shares accepted of
        both differ most, and from there half way down to no gain, as the models that score the documents know fewer labels than the one that is used. Wrong and incomplete labels shrink that difference everywhere alike, so they don't move the best place."""
        label = np.array([[x == s for s in self.subjects] for x in labels], bool).reshape(len(labels), len(self.subjects))

        def best(s: np.ndarray, y: np.ndarray) -> float:
            order = np.argsort(-s, kind="stable")
            s, y = s[order], y[order]
            gap = np.cumsum(y) / max(y.sum(), 1) - np.cumsum(~y) / max((~y).sum(), 1)
            last = np.r_[s[1:] != s[:-1], True][: len(s)] & (s > 0)
            if not last.any():
                return GAIN
            i = int(np.argmax(np.where(last, gap, -np.inf)))
            return float(s[i]) / 2

        together = best(score.ravel(), label.ravel()) if label.any() else GAIN
        least = np.array([best(score[:, j], label[:, j]) if label[:, j].sum() >= FEW else together for j in range(len(self.subjects))])
        return SubjectModel(self.subjects, self.words, self.pairs, self.all_words, self.all_pairs, least)

    @staticmethod
    def calibrated(docs: list[tuple[str, str | None, bool]], subjects: list[str]) -> SubjectModel:
        """train() with the acceptance calibrated."""
        model = SubjectModel.train(docs, subjects)
        yes = [d for d in docs if d[2]]
        score, labels = [np.zeros((0, len(subjects)))], []
        for f in range(FOLDS):
            part = yes[f::FOLDS]
            other = SubjectModel.train([d for i, d in enumerate(yes) if i % FOLDS != f] + [(t, None, False) for t, _, _ in part], subjects, 3)
            score.append(other.document_gains([t for t, _, _ in part]))
            labels += [x for _, x, _ in part]
        return model.accepting(np.concatenate(score), labels)


def fit(docs: DataFrame, labels: DataFrame, subjects: list[str], key: str = "doc_id", text: str = "text", subject: str = "subject") -> SubjectModel:
    """A model of the subjects from docs (key, text) and labels (key, subject; null = none). Of several labels of a document the smallest counts."""
    lab = labels.groupBy(key).agg(F.min(present(F.col(subject))).alias("l"))
    x = docs.select(key, F.col(text).alias("t")).where(f"length(t) between 1 and {LONGEST}")
    yes = smallest(x.join(lab, key), key, LABELLED).collect()
    no = smallest(x.join(lab, key, "left_anti"), key, OTHERS).collect()
    yes, no = (sorted(y, key=lambda r: r[key]) for y in (yes, no))
    return counted(docs, text, SubjectModel.calibrated([(r["t"], r["l"], True) for r in yes] + [(r["t"], None, False) for r in no], subjects))


def counted(docs: DataFrame, text: str, model: SubjectModel) -> SubjectModel:
    """The model with the words and pairs of all documents and whole texts counted, each sentence on the subject that `model` gives it."""
    k = len(model.subjects)
    if not k:
        return model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a row of words and pairs for each subject, and the last for sentences on none
        total = np.zeros((k + 1) * (SIZE + PAIRS), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                own = [p for t in whole.column(0).slice(at, 1000).to_pylist() for p in paragraphs(t)]
                if own:
                    codes = u, b, n = _codes([s for p in own for s in p])
                    of = model.settled(codes, np.repeat(np.arange(len(own)), [len(p) for p in own]), True)
                    row = np.repeat(np.where(of >= 0, of, k), n) * (SIZE + PAIRS)
                    i, c = np.unique(np.concatenate([row + u, row + SIZE + b]), return_counts=True)
                    total[i] += c
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(total[i], pa.int64())], ["i", "n"])

    got = spread(docs.select(text)).mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros((k + 1) * (SIZE + PAIRS), np.int64)
    total[got["i"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    total = total.reshape(k + 1, SIZE + PAIRS)
    words, pairs = (x.astype(np.float32) for x in (total[:, :SIZE], total[:, SIZE:]))
    return SubjectModel(model.subjects, words[:k], pairs[:k], total[:, :SIZE].sum(0).astype(np.float32), total[:, SIZE:].sum(0).astype(np.float32), model.least)


def document_subjects(docs: DataFrame, key: str, text: str, model: SubjectModel) -> DataFrame:
    """key, subject, n_sentences of each subject that a document deals with. Null and empty texts deal with none."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                rows = [(i, s, n) for i, x in enumerate(model.texts(part.column(1).to_pylist())) for s, n in sorted(x.items())]
                i, s, n = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i, pa.int64())), pa.array(s, pa.string()), pa.array(n, pa.int32())], [key, "subject", "n_sentences"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, subject string, n_sentences int")
