"""Toxicity by a weighted lexicon.

Texts are folded: lower case, homoglyphs (Cyrillic, Greek, full width, mathematical letters, accents that
the training texts do not use) to Latin letters, digits and signs inside words to the letters they stand
for, with l and i as one class because 1, ! and | stand for both; invisible characters vanish and all else
is a space.  One Aho-Corasick automaton finds all lexicon terms (word stems) and exception phrases; a term
inside an exception phrase does not count.  The weights of a text's matches, normalised by its length, give
the score by a logistic curve.

The lexicon is learned: stems whose share of documents differs between toxic and other labelled texts beyond
chance (likelihood ratio, corrected for the number of stems) and whose rate a word is many times higher in
toxic ones.  A term's weight is the log of that rate ratio.  Exception phrases are learned likewise: a word
that holds a term but is as common in other texts, and two-word phrases around a term that only other texts
have; more can be given.
"""

from __future__ import annotations

import math
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Logit, hand_back, lowest, remainder, rows_kept, table
from .textblocks import Block, blocks, each_block

#: Labelled rows that training takes (lowest hash of id and text) and their bytes, a documented bound.
TRAIN_ROWS, TRAIN_BYTES = 6_000, 64_000_000
THRESHOLD = 0.7
STEMS = range(4, 9)
RATE_RATIO = 8.0
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "sore loser")

# What stands for a letter.  Classes of one: l, 1, !, | read as i.
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
DIGITS = dict(zip("0123456789", "oizeasgtbg", strict=True))
HOMOGLYPHS = dict(zip("абвгеёікморстухјѕԁһіԛԝαβεικνορτυχϲℓı", "a6breeikmopctyxjsdhiqwabeikvoptuxcii", strict=True)) | {"в": "b", "н": "h", "ո": "n", "ս": "u", "ɡ": "g", "ɑ": "a"}
INVISIBLE = (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)
_GONE, _GAP, _BORDER = 0, 0x20, 0x0A


class Folding:
    """Folds code points by one table look-up; ``keep``: accented letters that are letters of their own."""

    def __init__(self, keep: Iterable[str] = ()):
        self.keep = frozenset(keep)
        lut = np.arange(0x110000, dtype=np.uint32)
        ranges = [*range(0x3000), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)]
        for p in ranges:
            lut[p] = self._one(chr(p))
        lut[0xD800:0xE000] = _GAP
        lut[list(INVISIBLE)] = _GONE
        self.lut = lut
        self.sign = np.zeros(0x110000, np.uint32)
        for c, to in SIGNS.items():
            self.sign[ord(c)] = ord(to)

    def _one(self, c: str) -> int:
        low = c.lower()
        if low in DIGITS:
            return ord(DIGITS[low])
        if low in HOMOGLYPHS:
            return ord(HOMOGLYPHS[low])
        if low not in self.keep:
            plain = unicodedata.normalize("NFKD", low)
            if unicodedata.combining(plain[0]):
                return _GONE
            low = plain[0].lower()
            low = DIGITS.get(low, HOMOGLYPHS.get(low, low))
        low = low[0]
        return ord("i" if low == "l" else low) if low.isalpha() else _GAP

    def points(self, p: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Folded code points with one space before, between and after words, and the place at which each text starts.

        A code point that no term or phrase holds parts the texts, so nothing is found across their border.
        """
        p = np.insert(p, np.repeat(starts, 3), _GAP)
        border = starts + 3 * np.arange(len(starts)) + 1
        out = self.lut[p]
        sign = self.sign[p]
        out[border] = _BORDER
        at = np.flatnonzero(sign)
        if len(at):
            at = at[at < len(p) - 1]
            solid = lambda i: (out[i] != _GAP) & (out[i] != _GONE)
            at = at[solid(at - 1) & solid(at + 1)]
            out[at] = sign[at]
        out = out[out != _GONE]
        gap = out == _GAP
        keep = np.ones(len(out), bool)
        keep[1:] = ~(gap[1:] & gap[:-1])
        out = np.concatenate([out[keep], [_GAP] if out[-1] != _GAP else []]).astype("<u4")
        return out, np.flatnonzero(out == _BORDER) + 1

    def text(self, s: str) -> str:
        p = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4")
        out, starts = self.points(p, np.zeros(1, np.int64))
        return out[starts[0] :].tobytes().decode("utf-32-le")

    def block(self, block: Block) -> tuple[str, np.ndarray, np.ndarray]:
        """The folded texts in a row, the place where each starts, and each one's words."""
        try:
            s = block.data.tobytes().decode("utf-8")
            lengths = block.sums((block.data & 0xC0) != 0x80)
        except UnicodeDecodeError:
            each = [block.text(i).decode("utf-8", "replace") for i in range(block.n)]
            s, lengths = "".join(each), np.array([len(x) for x in each], np.int64)
        p = np.frombuffer(s.encode("utf-32-le"), "<u4")
        out, starts = self.points(p, np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64))
        begins = np.flatnonzero((out[1:] != _GAP) & (out[1:] != _BORDER) & (out[:-1] == _GAP))
        words = np.bincount(np.searchsorted(starts, begins, "right") - 1, minlength=block.n)
        return out.tobytes().decode("utf-32-le"), starts, words


@dataclass
class Lexicon:
    """Terms with weights, exception phrases (all folded) and the curve that turns matches into a score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    keep: frozenset[str] = frozenset()
    curve: Logit = field(default_factory=Logit)

    def __post_init__(self):
        self._ready = None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def ready(self):
        if self._ready is None:
            terms = sorted(self.weights)
            folding = Folding(self.keep)
            automaton = ahocorasick.Automaton()
            for k, t in enumerate(terms):
                automaton.add_word(t, (k, len(t)))
            for x in self.exceptions:
                phrase = folding.text(x)
                if phrase.strip() and phrase not in automaton:
                    automaton.add_word(phrase, (-1, len(phrase)))
            if len(automaton):
                automaton.make_automaton()
            self._ready = folding, automaton, np.array([self.weights[t] for t in terms])
        return self._ready

    def matches(self, folded: str) -> tuple[np.ndarray, np.ndarray]:
        """Place and term of the matches that no exception phrase covers."""
        _, automaton, _ = self.ready()
        hits = [(end + 1 - length, end + 1, term) for end, (term, length) in automaton.iter(folded)] if len(automaton) else []
        start, end, term = np.array(hits, np.int64).reshape(-1, 3).T
        phrase = term < 0
        if phrase.any():
            order = np.argsort(start[phrase], kind="stable")
            begins, reach = start[phrase][order], np.maximum.accumulate(end[phrase][order])
            last = np.searchsorted(begins, start, "right") - 1  # phrases that begin no later; a phrase ends with a space
            phrase |= (last >= 0) & (end <= reach[last] + 1)
        return start[~phrase], term[~phrase]

    def features(self, block: Block) -> np.ndarray:
        """Per text: log of the summed weights, weights for 100 words, distinct terms, log of the words."""
        folding, _, weight = self.ready()
        folded, starts, words = folding.block(block)
        at, term = self.matches(folded)
        total, kinds = np.zeros(block.n), np.zeros(block.n)
        if len(at):
            doc = np.searchsorted(starts, at, "right") - 1
            total = np.bincount(doc, weight[term], block.n)
            kinds = np.bincount(np.unique(doc * len(weight) + term) // len(weight), minlength=block.n)
        n = np.maximum(words, 1)
        return np.column_stack([np.log1p(total), np.minimum(100 * total / n, 50), np.log1p(kinds), np.log1p(words) * (total > 0), total > 0])

    def scores(self, block: Block) -> np.ndarray:
        return self.curve.predict(self.features(block))


def _words(folding: Folding, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words, and word, document and count of each word in each document."""
    known: dict[str, int] = {}
    word, count, sizes = array("i"), array("i"), []
    for t in texts:
        found = Counter(folding.text(t).split())
        word.extend([known.setdefault(w, len(known)) for w in found])
        count.extend(found.values())
        sizes.append(len(found))
    return list(known), np.frombuffer(word, np.int32), np.repeat(np.arange(len(texts), dtype=np.int32), sizes), np.frombuffer(count, np.int32)


def _rank(vocabulary: list[str], word: np.ndarray, doc: np.ndarray, count: np.ndarray, y: np.ndarray) -> list[tuple]:
    """(evidence, length, stem, weight) of stems that tell toxic texts from others."""
    toxic = y[doc] > 0
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    w1 = int(count[toxic].sum())
    w0 = int(count.sum()) - w1
    tallies = []
    asked = [vocabulary[k] for k in np.unique(word[toxic])]  # other stems are of no interest
    for n in STEMS:
        stems: dict[str, int] = {}
        for w in asked:
            if len(w) >= n:
                stems.setdefault(w[:n], len(stems))
        of = np.fromiter((stems.get(w[:n], -1) if len(w) >= n else -1 for w in vocabulary), np.int32, len(vocabulary))
        m = len(stems)
        stem = of[word]
        occ, df = [], []
        for side in (~toxic, toxic):
            at = np.flatnonzero(side & (stem >= 0))
            occ.append(np.bincount(stem[at], count[at], m).astype(np.int64))
            df.append(np.bincount(np.unique(doc[at].astype(np.int64) * m + stem[at]) % m, minlength=m) if m else occ[-1])
        often = np.flatnonzero(df[1] >= 3)
        names = list(stems)
        tallies.append((int((df[1] > 0).sum()), [(names[k], *(int(x[k]) for x in (*occ, *df))) for k in often]))
    bar = 2 * math.log(max(10, sum(k for k, _ in tallies)))
    ranked = []
    for name, o0, o1, b, a in (x for _, rows in tallies for x in rows):
        ratio = (o1 / w1) / ((o0 + 0.5) / max(w0, 1))
        if ratio >= RATE_RATIO and a / n1 > b / n0 and _surprise(a, n1, b, n0) > bar:  # chosen by documents, ranked by occurrences
            ranked.append((_surprise(o1, w1, o0, w0), len(name) + 1, " " + name, min(8.0, math.log(ratio))))
    return sorted(ranked, reverse=True)


def _spared(weights: dict[str, float], folding: Folding, texts: list[str], y: np.ndarray) -> list[str]:
    """Words that hold a term, and two words around one, that other texts have at twice the rate of toxic ones."""
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    other, own = Counter(), Counter()
    for t, toxic in zip(texts, y, strict=True):
        words = ["", *folding.text(t).split(), ""]
        seen = set()
        for i, w in enumerate(words):
            if any(" " + w[:n] in weights for n in STEMS):
                seen |= {w, f"{words[i - 1]} {w}".strip(), f"{w} {words[i + 1]}".strip()}
        (own if toxic else other).update(seen)
    return sorted(x for x, b in other.items() if b >= max(5, 0.002 * n0) and b / n0 >= 2 * own[x] / n1)


def _surprise(a: int, n: int, b: int, m: int) -> float:
    """The likelihood ratio statistic of a among n against b among m."""
    p = (a + b) / (n + m)
    return 2 * sum(k * math.log(k / e) for k, e in ((a, n * p), (b, m * p), (n - a, n * (1 - p)), (m - b, m * (1 - p))) if k)


def learn(texts: list[str], toxic: list[int], exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon, its exceptions and its curve from labelled texts.  Without both labels nothing matches and the score is constant."""
    letters = Counter(c for t in texts for c in set(t.lower()) if c.isalpha() and not c.isascii() and c not in HOMOGLYPHS)
    keep = frozenset(c for c, n in letters.items() if n >= max(3, 0.005 * len(texts)))
    y = np.array(toxic, int)
    weights: dict[str, float] = {}
    spared: list[str] = []
    if len(y) and 0 < y.sum() < len(y):
        folding = Folding(keep)
        for _, _, stem, weight in _rank(*_words(folding, texts), y):
            if not any(stem.startswith(t) or t.startswith(stem) for t in weights):
                weights[stem] = weight
        spared = _spared(weights, folding, texts, y)
    lexicon = Lexicon(weights, tuple(sorted({*exceptions, *spared})), keep)
    x = np.concatenate([lexicon.features(one) for t in texts for _, _, one in blocks(pa.array([t], pa.string()))]) if texts else np.zeros((0, 5))
    lexicon.curve = Logit().fit(x, y)
    return lexicon


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> Lexicon:
    """Learn from at most ``rows`` labelled texts of at most ``size`` bytes in sum, whole, those whose id and text hash lowest.

    An id labelled twice counts as toxic if any label says so; an id on several texts lends its label to each,
    and a repeated row counts once.  Texts are chosen by id and hash and only those chosen are fetched, by a
    broadcast of at most ``rows`` ids.
    """
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("_y"))
    texts = docs.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_h"), "text")
    known = texts.select("doc_id", "_h", F.octet_length("text").alias("_n")).distinct().join(marked, "doc_id")
    chosen, total = [], 0
    for r in lowest(known, ["doc_id", "_h"], rows):
        if total + r["_n"] <= size or not chosen:
            chosen.append((r["doc_id"], r["_h"], int(r["_y"] > 0)))
            total += r["_n"]
    if not chosen:
        return learn([], [])
    wanted = docs.sparkSession.createDataFrame(chosen, "doc_id bigint, _h bigint, _y int")
    got = texts.join(F.broadcast(wanted), ["doc_id", "_h"]).dropDuplicates(["doc_id", "_h"]).toArrow()
    rows = sorted(zip(got["doc_id"].to_pylist(), got["text"].to_pylist(), got["_y"].to_pylist(), strict=True))
    del got
    found = learn([t for _, t, _ in rows], [y for _, _, y in rows])
    del rows
    hand_back()
    return found


def scored(docs: DataFrame, lexicon: Lexicon, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the score of each row of ``docs``, over whole texts.

    A text's score depends on that text alone.  Null and empty texts have no match and the score of such;
    repeated rows score alike; an empty table gives no rows; other columns of ``docs`` are not touched.  A very
    long text is one block: it takes about twenty times its bytes in one worker and time in proportion.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in each_block(batch, "_text"):
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(keep))), pa.array(lexicon.scores(block), pa.float64())], [*(f"k{i}" for i in range(len(keep))), "score"])

    picked = docs.select(*(F.col(x).alias(f"k{i}") for i, x in enumerate(keep)), F.col(text).alias("_text"))
    schema = ", ".join([*(f"k{i} {picked.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))), "score double"])
    return picked.mapInArrow(run, schema).select(*(F.col(f"k{i}").alias(x) for i, x in enumerate(keep)), "score")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(remainder("doc_id", 3) != 1)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` that score below THRESHOLD, with all their columns, whatever their names.

    Null and empty texts, and rows without an id, stay or go by their score like all others; an empty table gives none.
    """
    lexicon = train(training_rows(docs), table(spark, sf_dir, "labels"))
    return rows_kept(docs, lambda block, _: lexicon.scores(block) < THRESHOLD)
