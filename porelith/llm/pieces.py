"""SentencePiece encoding and decoding with a given piece table.

An Aho-Corasick automaton over all pieces reads a text once; at each place its output links name the pieces
that end there, longest first, and each relaxes the best score of that place (Viterbi).  A character that no
piece covers is spelled in byte pieces, at the score of an unknown one.  Scores are those of the table, and a
tie goes to the longer last piece.

The text is prefixed by one space and spaces are written U+2581.  Where, as in the tables at hand, U+2581
stands only at the start of a piece, no piece reaches across the start of a word, so the best path of a text
is that of its words, and a word's path is remembered (a bounded table in each worker).  Other tables are
handled text by text.  A U+2581 of the text itself is spelled in byte pieces, so that decoding gives back
exactly the text, always, if the table has byte pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textblocks import each_block

SPACE = "▁"
#: An unknown character scores so much less than the least piece.
UNKNOWN_PENALTY = 10.0
#: Words whose path a worker remembers.
REMEMBERED = 300_000
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*")


@dataclass
class PieceTable:
    """Pieces by id with scores; ``kinds``: n(ormal), b(yte), u(nknown) or c(ontrol)."""

    pieces: list[str]
    scores: list[float]
    kinds: str
    _ready: object = field(default=None, repr=False)

    @classmethod
    def load(cls, path: str) -> PieceTable:
        """From a SentencePiece model file on the driver."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        kinds = "".join("u" if model.is_unknown(i) else "b" if model.is_byte(i) else "c" if model.is_control(i) or model.is_unused(i) else "n" for i in ids)
        return cls([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], kinds)

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def codec(self) -> Codec:
        if self._ready is None:
            self._ready = Codec(self)
        return self._ready


class _Paths(dict):
    """Paths by word; filled on demand and emptied when full."""

    def __init__(self, solve):
        super().__init__()
        self.solve = solve

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        path = self.solve(SPACE + word)
        if len(word) <= 64:
            self[word] = path
        return path


class Codec:
    def __init__(self, table: PieceTable):
        normal = [i for i, k in enumerate(table.kinds) if k == "n"]
        self.automaton = ahocorasick.Automaton()
        for i in normal:
            if table.pieces[i]:
                self.automaton.add_word(table.pieces[i], (len(table.pieces[i]), table.scores[i], i))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.single = {table.pieces[i] for i in normal if len(table.pieces[i]) == 1}
        self.unknown_score = min((table.scores[i] for i in normal), default=0.0) - UNKNOWN_PENALTY
        self.unknown = table.kinds.find("u")
        self.bytes = {int(table.pieces[i][3:5], 16): i for i, k in enumerate(table.kinds) if k == "b"}
        self.spelled = [self._spell(i, k, p) for i, (k, p) in enumerate(zip(table.kinds, table.pieces, strict=True))]
        self.by_word = not any(SPACE in table.pieces[i].lstrip(SPACE) for i in normal)
        self.paths = _Paths(self.best)

    @staticmethod
    def _spell(i: int, kind: str, piece: str) -> bytes:
        return bytes([int(piece[3:5], 16)]) if kind == "b" else piece.replace(SPACE, " ").encode() if kind == "n" else " ⁇ ".encode() if kind == "u" else b""

    def out_of_table(self, s: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in s.encode()) if len(self.bytes) == 256 else (self.unknown,) * len(s)

    def best(self, s: str) -> tuple[int, ...]:
        """The path of highest score through ``s``, spaces written U+2581."""
        n = len(s)
        score, piece, length = [float("-inf")] * (n + 1), [-1] * (n + 1), [1] * (n + 1)
        score[0] = 0.0
        matches = self.automaton.iter(s) if len(self.automaton) else ()
        if not self.single.issuperset(s):
            matches = self._with_unknown(s, matches)
        for end, (size, value, i) in matches:  # by place; at a place the longest piece first
            value += score[end + 1 - size]
            if value > score[end + 1]:
                score[end + 1], piece[end + 1], length[end + 1] = value, i, size
        out, to = [], n
        while to > 0:
            start = to - length[to]
            out.append((piece[to],) if piece[to] >= 0 else self.out_of_table(s[start:to]))
            to = start
        return tuple(chain.from_iterable(reversed(out)))

    def _with_unknown(self, s: str, matches):
        """The matches with one of a single character, id -1, wherever no piece is just that character."""
        waiting = [(k, (1, self.unknown_score, -1)) for k, c in enumerate(s) if c not in self.single][::-1]
        for match in matches:
            while waiting and waiting[-1][0] < match[0]:
                yield waiting.pop()
            yield match
        yield from reversed(waiting)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if SPACE in text:
            first, *rest = text.split(SPACE)
            out = list(self._encode(SPACE + first.replace(" ", SPACE)))
            mark = self.out_of_table(SPACE)
            for part in rest:
                out += mark
                out += self._encode(part.replace(" ", SPACE))
            return out
        if self.by_word and "  " not in text and text[0] != " " and text[-1] != " ":
            return list(chain.from_iterable(map(self.paths.__getitem__, text.split(" "))))
        return list(self._encode(SPACE + text.replace(" ", SPACE)))

    def _encode(self, s: str) -> Iterator[int]:
        if not self.by_word:
            return iter(self.best(s))
        lead = len(s) - len(s.lstrip(SPACE)) == 0 and s.find(SPACE) != 0
        head = s[: s.find(SPACE)] if SPACE in s else s
        words = map(self.paths.__getitem__, (w[1:] for w in _WORD.findall(s)))
        return chain(self.best(head) if lead and head else (), chain.from_iterable(words))

    def decode(self, ids) -> str:
        out = b"".join(map(self.spelled.__getitem__, ids))
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


def default_model() -> str:
    """The public table; a path on the driver, where alone it is read."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded(docs: DataFrame, table: PieceTable, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ids, n_pieces and exact (decoding gives back the text) of each row of ``docs``, whole texts.

    Null and empty texts have no pieces and are exact.  Repeated rows are encoded alike; an empty table gives no
    rows; other columns of ``docs`` are not touched.  A very long text is one list of numbers in one worker, about
    forty times its bytes while it is made.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value.codec()
        for batch in batches:
            for rows, block in each_block(batch, "_text"):
                flat, sizes, exact = [], [], []
                for i in range(block.n):
                    text = block.text(i).decode("utf-8", "replace")
                    ids = codec.encode(text)
                    exact.append(codec.decode(ids) == text)
                    flat.append(np.array(ids, np.int32))
                    sizes.append(len(ids))
                at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(flat)))
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(keep))), lists, pa.array(sizes, pa.int32()), pa.array(exact)], [*(f"k{i}" for i in range(len(keep))), "ids", "n_pieces", "exact"])

    picked = docs.select(*(F.col(x).alias(f"k{i}") for i, x in enumerate(keep)), F.col(text).alias("_text"))
    schema = ", ".join([*(f"k{i} {picked.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))), "ids array<int>, n_pieces int, exact boolean"])
    return picked.mapInArrow(run, schema).select(*(F.col(f"k{i}").alias(x) for i, x in enumerate(keep)), "ids", "n_pieces", "exact")


def decoded(rows: DataFrame, table: PieceTable, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the text of each row's ids; a null list gives null."""
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value.codec()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [None if x is None else codec.decode(x) for x in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), pa.array(texts, pa.string())], [*(f"k{k}" for k in range(len(keep))), "text"])

    picked = rows.select(*(F.col(x).alias(f"k{i}") for i, x in enumerate(keep)), F.col(ids).alias("_ids"))
    schema = ", ".join([*(f"k{i} {picked.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))), "text string"])
    return picked.mapInArrow(run, schema).select(*(F.col(f"k{i}").alias(x) for i, x in enumerate(keep)), "text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces and exact of each row, in the manner of ``encoded``."""
    return encoded(docs, PieceTable.load(default_model()))
