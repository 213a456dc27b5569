"""Language identification by prediction by partial matching.

Each language has a variable-order tree of byte contexts (orders 0 to MAX_ORDER) with counts of the
bytes that followed; rare contexts beyond a fixed number are cut off.  A byte is coded in the longest context that was seen in training; a byte new to
that context costs the escape probability and is then coded one order lower, down to a uniform code
over 256 bytes.  Escape probabilities are method C: distinct / (total + distinct).  The statistics are
frozen after training, so the exact code length of every byte is a table entry: each tree is compiled
to one row for each of its contexts and one column for each byte seen.  A text's code length in a language is
the sum over all its bytes; the shortest wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hand_back, remainder
from .textblocks import Block, each_block

MAX_ORDER = 3
#: Training takes at most so many documents (lowest hash of id and text) and bytes of each language; a documented bound.
TRAIN_DOCS, TRAIN_BYTES = 600, 2_000_000
#: Contexts that the trees of all languages keep in sum, which bounds the model whatever the languages.
CONTEXTS = 65_536
UNKNOWN = "und"
SLICE = 4_000_000


def _codes(code: np.ndarray, data: np.ndarray, bounds: np.ndarray, a: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Symbols of all bytes and, for orders 0 to MAX_ORDER, the context before each: the last byte is the lowest digit.

    Before the first byte of a text stands the symbol a - 1, which is never coded itself.
    """
    c = code[data]
    at = np.arange(len(c)) + MAX_ORDER * np.repeat(np.arange(1, len(bounds)), np.diff(bounds))
    wide = np.full(len(c) + MAX_ORDER * (len(bounds) - 1), a - 1, np.int64)
    wide[at] = c
    contexts = [np.zeros(len(c), np.int64)]
    for o in range(1, MAX_ORDER + 1):
        contexts.append(contexts[-1] + wide[at - o] * a ** (o - 1))
    return c, contexts


def _frequent(grams: list[tuple[np.ndarray, np.ndarray]], a: int, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The grams of the ``most`` contexts that most bytes followed; of equals the shorter one, then the lower number."""
    found = [np.unique(k // a, return_inverse=True) for k, _ in grams]
    totals = [np.bincount(at, m, len(contexts)) for (contexts, at), (_, m) in zip(found, grams, strict=True)]
    order = np.repeat(np.arange(len(grams)), [len(t) for t in totals])
    number = np.concatenate([contexts for contexts, _ in found])
    kept = np.zeros(len(order), bool)
    kept[np.lexsort((number, order, -np.concatenate(totals)))[:most]] = True
    keep = [kept[order == o][at] for o, (_, at) in enumerate(found)]
    return [(k[x], m[x]) for (k, m), x in zip(grams, keep, strict=True)]


class ByteTrees:
    """The trees of all languages, compiled.

    Every language keeps the same number of contexts, ``contexts`` in sum, those that most bytes followed (the
    shorter one of equals); a context's suffix is never followed by fewer, so trees stay whole.  Each language has
    a table with one row for each of its contexts and the bits of every byte there, all escapes included.
    ``row_of[context of MAX_ORDER symbols]`` is the number of its longest suffix that any language keeps, and
    ``own[language, number]`` where that language's longest suffix of it starts in ``table``.  So the model takes
    at most 4 (symbols ** 3 + contexts (symbols + languages)) bytes, 70 MB at 258 symbols and few languages.
    """

    def __init__(self, texts: dict[str, list[bytes]], contexts: int = CONTEXTS):
        self.langs = sorted(texts)
        joined = [(np.frombuffer(b"".join(texts[x]), np.uint8), np.cumsum([0, *map(len, texts[x])])) for x in self.langs]
        present = np.zeros(256, bool)
        for data, _ in joined:
            present[data] = True
        seen = np.flatnonzero(present)
        self.size = a = len(seen) + 2  # one symbol for all bytes never seen, one for the start of a text
        self.code = np.full(256, a - 2, np.int64)
        self.code[seen] = np.arange(len(seen))
        grams = []  # by language and order: context * a + byte, and its count
        for data, bounds in joined:
            c, before = _codes(self.code, data, bounds, a)
            grams.append(_frequent([np.unique(k * a + c, return_counts=True) for k in before], a, max(1, contexts // len(joined))))
        row_of, own = np.zeros(1, np.int32), [np.zeros(1, np.int32) for _ in joined]
        tables = [np.full((1, a), 8.0, np.float32) for _ in joined]
        for o in range(MAX_ORDER + 1):
            union = np.unique(np.concatenate([g[o][0] // a for g in grams])) if grams else np.zeros(0, np.int64)
            above = row_of[union % a ** (o - 1) if o else union * 0]  # the numbers of the suffixes
            for j, g in enumerate(grams):
                k, m = g[o]
                mine, at = np.unique(k // a, return_inverse=True)
                place = np.searchsorted(union, mine)
                kinds, total = np.bincount(at, minlength=len(mine)), np.bincount(at, m, len(mine))
                rows = own[j][above]
                cost = tables[j][rows[place]] - np.log2(kinds / (total + kinds)).astype(np.float32)[:, None]
                cost[at, k % a] = -np.log2(m / (total + kinds)[at])
                rows[place] = len(tables[j]) + np.arange(len(mine))
                own[j] = np.concatenate([own[j], rows])
                tables[j] = np.concatenate([tables[j], cost])
            start = int(row_of.max()) + 1 if o else 1
            row_of = row_of[np.arange(a**o) % a ** (o - 1)] if o else row_of.copy()
            row_of[union] = start + np.arange(len(union))
        starts = np.cumsum([0, *map(len, tables)])[:-1]
        self.row_of = row_of
        self.own = np.array([(x + y) * a for x, y in zip(own, starts, strict=True)], np.int32)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.float32)

    def bits(self, block: Block) -> np.ndarray:
        """The code length of each text of a block in each language.  A text above SLICE bytes is coded slice by slice."""
        out = np.zeros((block.n, len(self.langs)))
        full = np.flatnonzero(np.diff(block.bounds) > 0)
        if not len(full) or not self.langs:
            return out
        if block.n > 1 or len(block.data) <= SLICE:
            c, contexts = _codes(self.code, block.data, block.bounds, self.size)
            for j, each in enumerate(self._each(c, contexts[-1])):
                out[full, j] = np.add.reduceat(each, block.bounds[full], dtype=np.float64)
            return out
        before = np.full(MAX_ORDER, self.size - 1, np.int64)
        for p in range(0, len(block.data), SLICE):
            wide = np.concatenate([before, self.code[block.data[p : p + SLICE]]])
            n = len(wide) - MAX_ORDER
            context = sum(wide[MAX_ORDER - o : MAX_ORDER - o + n] * self.size ** (o - 1) for o in range(1, MAX_ORDER + 1))
            out[0] += [each.sum(dtype=np.float64) for each in self._each(wide[MAX_ORDER:], context)]
            before = wide[-MAX_ORDER:]
        return out

    def _each(self, c: np.ndarray, context: np.ndarray) -> Iterator[np.ndarray]:
        """The bits of each byte, language by language."""
        number, c = self.row_of.take(context), c.astype(np.int32)
        for own in self.own:
            yield self.table.take(own.take(number) + c)

    def predict(self, block: Block) -> tuple[list[str], np.ndarray]:
        """The language with the shortest code (the first by name of equals) and its share among all 2 ** -length."""
        bits = self.bits(block)
        if not self.langs:
            return [UNKNOWN] * block.n, np.zeros(block.n)
        best = bits.argmin(1)
        share = 1 / np.exp2(np.maximum(-1000, bits.min(1, keepdims=True) - bits)).sum(1)
        lettered = np.array([any(map(str.isalpha, block.text(i).decode("utf-8", "replace"))) for i in range(block.n)], bool)
        return [self.langs[k] if ok else UNKNOWN for k, ok in zip(best, lettered, strict=True)], np.where(lettered, share, 0.0)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_each: int = TRAIN_DOCS, bytes_each: int = TRAIN_BYTES) -> ByteTrees:
    """Trees from the ``docs_each`` texts of each language whose key and text hash lowest, whole texts up to ``bytes_each`` bytes in sum.

    Rows without a language or text teach nothing; a null key counts as empty and repeated rows count once, so
    one key on many rows teaches like many.  What reaches the driver: a count for each language, the hashes and
    sizes below a cutoff and then the chosen texts, without a sort or shuffle of all rows.
    """
    h = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(text))
    rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("l"), h.alias("h")).where("t is not null and l is not null and t != ''")
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not counts:
        return ByteTrees({})
    unit = (F.col("h").cast("double") + 2.0**63) / 2.0**64
    share = F.lit(None)
    for x, n in counts.items():
        share = F.when(F.col("l") == x, F.lit(min(1.0, 1.1 * (docs_each + 6 * docs_each**0.5) / n))).otherwise(share)
    low = rows.where(unit <= share)
    found: dict[str, list] = {x: [] for x in counts}
    for r in low.select("l", "h", F.octet_length("t").alias("n")).distinct().collect():
        found[r["l"]].append((r["h"], r["n"]))
    chosen = []
    for x, ts in found.items():
        total = 0
        for h, n in sorted(ts)[:docs_each]:
            if total + n <= bytes_each or not total:
                chosen.append((x, h))
                total += n
    wanted = docs.sparkSession.createDataFrame(chosen, "l string, h bigint")
    got = low.join(F.broadcast(wanted), ["l", "h"]).dropDuplicates(["l", "h"]).select("l", "h", F.col("t").cast("binary").alias("t")).collect()
    texts: dict[str, list[bytes]] = {}
    for r in sorted(got, key=lambda r: (r["l"], r["h"])):
        texts.setdefault(r["l"], []).append(bytes(r["t"]))
    trees = ByteTrees(texts)
    del got, texts
    hand_back()
    return trees


def identify(docs: DataFrame, trees: ByteTrees, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred and score of each row of ``docs``, over whole texts.

    Null and empty texts and texts without a letter get ``und`` with score 0, as does every text if the
    trees know no language.  Equal code lengths go to the first language by name; repeated rows get the same.
    An empty table gives no rows; other columns of ``docs`` are not touched; very long texts go slice by slice.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for rows, block in each_block(batch, "_text"):
                lang, score = model.predict(block)
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(keep))), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*(f"k{i}" for i in range(len(keep))), "lang_pred", "score"])

    picked = docs.select(*(F.col(x).alias(f"k{i}") for i, x in enumerate(keep)), F.col(text).alias("_text"))
    schema = ", ".join([*(f"k{i} {picked.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))), "lang_pred string", "score double"])
    return picked.mapInArrow(run, schema).select(*(F.col(f"k{i}").alias(x) for i, x in enumerate(keep)), "lang_pred", "score")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(remainder("doc_id", 5) != 0)
