"""Vector bin packing of examples into sequences.

A piece of an example is a vector of tokens, segments and loss-bearing tokens, each as a
share of a sequence's limit. A sequence takes, again and again, the piece that fits with
the largest dot product with what it has left; when none fits, a prefix of the piece of
the largest product fills it. A sequence is closed at the limit of tokens or at the
largest power of two that it has reached, neither of which is padded; what is beyond goes
back to the pool. Each task packs the rows that it reads from a pool of bounded size, so
that nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import WordBpe

END = 2
#: Pieces that wait for a sequence; a task's sequences are numbered from its own multiple of 2^40.
POOL, ROOM = 256, 1 << 40
#: Pieces of one Arrow batch.
ROWS = 1024


@dataclass(frozen=True)
class Limits:
    """Most tokens, segments and loss-bearing tokens of a sequence."""

    tokens: int = 4096
    segments: int = 256
    loss: int = 4096


@dataclass(frozen=True)
class Piece:
    """A run of an example's ids; the first `quiet` of it bear no loss."""

    row: int
    ids: np.ndarray
    quiet: int
    start: int  # the example's ids before it
    total: int  # the example's ids

    @property
    def tokens(self) -> int:
        return len(self.ids)

    @property
    def loss(self) -> int:
        return len(self.ids) - self.quiet

    def prefix(self, tokens: int, loss: int) -> int:
        """The longest prefix of at most so many tokens and loss-bearing tokens."""
        return min(len(self.ids), tokens, self.quiet + loss)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        quiet = min(n, self.quiet)
        return Piece(self.row, self.ids[:n], quiet, self.start, self.total), Piece(self.row, self.ids[n:], self.quiet - quiet, self.start + n, self.total)


class Pool:
    """Pieces that each fit an empty sequence, and their vectors."""

    def __init__(self, limits: Limits) -> None:
        self._limits = limits
        self._scale = 1 / np.array([limits.tokens, limits.segments, limits.loss], float)
        self._pieces: list[Piece | None] = []
        self._sizes = np.zeros((0, 3), np.int64)
        self._free: list[int] = []
        self.waiting = 0

    def put(self, piece: Piece) -> None:
        if not self._free:
            n = len(self._pieces)
            self._free = list(range(2 * n + 63, n - 1, -1))
            self._pieces += [None] * (n + 64)
            self._sizes = np.vstack([self._sizes, np.full((n + 64, 3), np.iinfo(np.int32).max)])
        piece = replace(piece, ids=piece.ids.copy())  # a rest doesn't hold its whole example
        k = self._free.pop()
        self._pieces[k], self._sizes[k] = piece, (piece.tokens, 1, piece.loss)
        self.waiting += 1

    def _take(self, k: int) -> Piece:
        piece, self._pieces[k] = self._pieces[k], None
        self._sizes[k] = np.iinfo(np.int32).max
        self._free.append(k)
        self.waiting -= 1
        return piece

    def sequence(self) -> list[Piece]:
        """Pieces of the next sequence, in order."""
        left = np.array([self._limits.tokens, self._limits.segments, self._limits.loss])
        out: list[Piece] = []
        while self.waiting and left[0] > 0 and left[1] > 0:
            fits = (self._sizes <= left).all(1)
            worth = self._sizes @ (left * self._scale * self._scale)
            if fits.any():
                piece = self._take(int(np.where(fits, worth, -1).argmax()))
            else:
                there = self._sizes[:, 1] == 1
                k = int(np.where(there, worth, -1).argmax())
                n = self._pieces[k].prefix(int(left[0]), int(left[2]))
                if not n:  # another one may begin with ids that bear no loss
                    quiet = [i for i in np.flatnonzero(there).tolist() if self._pieces[i].prefix(int(left[0]), int(left[2]))]
                    if not quiet:
                        break
                    k = quiet[0]
                    n = self._pieces[k].prefix(int(left[0]), int(left[2]))
                piece, rest = self._take(k).cut(n)
                self.put(rest)
            out.append(piece)
            left -= (piece.tokens, 1, piece.loss)
        return self._closed(out, self._limits.tokens - int(left[0]))

    def _closed(self, pieces: list[Piece], tokens: int) -> list[Piece]:
        """The first pieces, up to the limit or a power of two; the others go back."""
        size = tokens if tokens == self._limits.tokens else 1 << (tokens.bit_length() - 1)
        out = []
        for p in pieces:
            if not size:
                self.put(p)
                continue
            head, rest = p.cut(min(size, p.tokens))
            out.append(head)
            size -= head.tokens
            if rest.tokens:
                self.put(rest)
        return out


def packed(examples: Iterable[tuple[np.ndarray, int]], limits: Limits) -> Iterator[tuple[Piece, int, int]]:
    """(piece, its sequence, its offset there) of examples (ids, how many of the first bear no loss); every id in one piece."""
    pool, number = Pool(limits), 0

    def closed(most: int) -> Iterator[tuple[Piece, int, int]]:
        nonlocal number
        while pool.waiting > most:
            offset = 0
            for p in pool.sequence():
                yield p, number, offset
                offset += p.tokens
            number += 1

    for row, (ids, quiet) in enumerate(examples):
        rest = Piece(row, ids, quiet, 0, len(ids))
        while rest.tokens:
            piece, rest = rest.cut(rest.prefix(limits.tokens, limits.loss))
            if piece.tokens == limits.tokens:
                yield piece, number, 0
                number += 1
            else:
                pool.put(piece)
                yield from closed(POOL)
    yield from closed(0)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, limits: Limits = Limits(), tokenizer: str | None = None) -> DataFrame:
    """id, start, length, ids, doc_tokens, loss_tokens, sequence_id, offset: one row a piece.

    An example is its prompt's ids, which bear no loss, its text's ids and END; ids are
    little-endian unsigned 32-bit numbers, the piece's own. Null texts and prompts are
    empty: such an example is END alone. A text of more ids than a sequence holds is cut
    into whole sequences and a rest. Examples of a null id and repeated rows are packed like
    any other, each row by itself; equal examples are interchangeable, ties go to the piece
    that came first in the pool. An empty table gives no rows; other columns, and their
    names, have no effect. tokenizer is the path of a vocabulary of words.
    """
    if min(limits.tokens, limits.segments, limits.loss) < 1:
        raise ValueError("limits must be positive")
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, keys = WordBpe(path), {}

        def examples() -> Iterator[tuple[np.ndarray, int]]:
            row = 0
            for b in batches:
                for key, text, prompt in zip(*b.columns, strict=True):
                    before = bpe.ids(prompt.as_py() or "")
                    ids = np.concatenate([before, bpe.ids(text.as_py() or ""), [END]]).astype("<u4")
                    keys[row] = [key.as_py(), len(ids)]
                    row += 1
                    yield ids, len(before)

        first, rows = TaskContext.get().partitionId() * ROOM, []
        for p, number, offset in packed(examples(), limits):
            key = keys[p.row]
            rows.append((key[0], p.start, p.tokens, p.ids.tobytes(), p.total, p.loss, first + number, offset))
            key[1] -= p.tokens
            if not key[1]:
                del keys[p.row]
            if len(rows) == ROWS:
                yield _batch(rows)
                rows = []
        yield _batch(rows)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), (F.col(prompt_col).cast("string") if prompt_col else F.lit(None).cast("string")).alias("prompt"))
    return texts.mapInArrow(run, SCHEMA).withColumnRenamed("id", id_col)


SCHEMA = "id long, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary() if kind == "binary" else pa.int64() for _, kind in map(str.split, SCHEMA.split(", "))]
    columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])


def op12_packing(docs: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids; see pack."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")
