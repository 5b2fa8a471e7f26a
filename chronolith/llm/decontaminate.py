"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared folded: lower-case letters and digits, all else one space. A region
within edit distance k of a passage of m characters shares m - q + 1 - k q of its
q-grams, all on diagonals that lie within k of each other. Shared q-grams are counted
in overlapping bands of diagonals; where a band reaches the bound within a passage's length, each passage
there is aligned, those with most shared q-grams first, until none can be nearer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.store import written
from .common import fold

Q = 8
#: Edits allowed, as a share of a passage's characters.
EDITS = 0.1
#: Every run of so many characters of a longer item is a passage.
PASSAGE = 160
#: Passages of one item that are aligned together: at first, and then.
FIRST, THEN = 8, 128
#: Folded characters of items that one pass over the documents looks for.
BLOCK_CHARS = 1 << 22
#: Folded characters of documents that are looked at together.
PIECE = 1 << 18
FAR = 1 << 30
_FILTER_BITS = 22
_HIT = "array<struct<item:long,distance:int>>"


def _grams(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of the q-grams, by doubling (Q is 8)."""
    h = x.astype(np.uint64) + np.uint64(1)
    for step, by in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9)):
        h = (h[: max(0, len(h) - step)] * np.uint64(by)) ^ h[step:]
        h ^= h >> np.uint64(31)
    return h * np.uint64(0x9E3779B97F4A7C15)


_NOTHING = np.zeros(0, np.uint32)


def budget(m: int) -> int:
    """Edits allowed in a passage of m characters: a share, and no more than the lemma can see."""
    return max(0, min(int(EDITS * m), (m - Q) // Q))


def folded(text: str | None) -> np.ndarray:
    """A text's folded characters, without spaces at its ends."""
    x = fold(text or "")[0]
    return x[(x[:1] == 32).sum() : len(x) - (x[-1:] == 32).sum()]


def passages(items: list[tuple[int, str]]) -> list[tuple[int, np.ndarray]]:
    """(item, folded passage), all that are looked for in texts; items of fewer than Q characters have none.

    An index of the whole items looks for the same passages and is much smaller.
    """
    out = []
    for item, text in items:
        x = folded(text)
        if len(x) >= Q:
            out += [(item, x[a : a + PASSAGE]) for a in range(max(0, len(x) - PASSAGE) + 1)]
    return out


def banded(passage: np.ndarray, region: np.ndarray, most: int) -> np.ndarray:
    """Least edit distance of each row of passage to a part of its row of region, within the band; FAR if over `most`.

    region[:, i] stands beside passage[:, j] on diagonal i - j, of which there are
    region's columns - passage's columns + 1. Distances only grow along the passage, so
    that rows over the limit are left out as it goes on.
    """
    wide = region.shape[1] - passage.shape[1] + 1
    along = np.arange(wide, dtype=np.int16)
    d = np.zeros((len(region), wide), np.int16)
    out, rows = np.full(len(region), FAR), np.arange(len(region))
    for j in range(passage.shape[1]):
        if j % 16 == 15:
            near = d.min(1) <= most
            if not near.all():
                rows, d, region, passage = rows[near], d[near], region[near], passage[near]
                if not len(rows):
                    return out
        new = d + (region[:, j : j + wide] != passage[:, j : j + 1])
        new[:, :-1] = np.minimum(new[:, :-1], d[:, 1:] + 1)
        new -= along
        d = np.minimum.accumulate(new, axis=1) + along
    best = d.min(1).astype(np.int64)  # FAR doesn't fit the distances' 16 bits
    out[rows] = np.where(best <= most, best, FAR)
    return out


@dataclass
class Index:
    """q-grams of items and where they are; of bounded size.

    A text of more than PASSAGE characters stands for all its passages. One of fewer
    than Q, of which there is no q-gram, is looked for as a document's whole text.
    """

    items: np.ndarray
    texts: list[np.ndarray]

    def __post_init__(self) -> None:
        short = [len(x) < Q for x in self.texts]
        self.whole: dict[bytes, list[int]] = {}
        for i, x, few in zip(self.items, self.texts, short, strict=True):
            if few:
                self.whole.setdefault(x.tobytes(), []).append(int(i))
        self.items = np.array([i for i, few in zip(self.items, short, strict=True) if not few], np.int64)
        self.texts = [x for x, few in zip(self.texts, short, strict=True) if not few]
        if not self.texts:
            return
        size = np.array([len(x) for x in self.texts])
        m = np.minimum(size, PASSAGE)
        self.edits = np.array([budget(n) for n in m])
        self.needed = m - Q + 1 - self.edits * Q
        self.shift = np.array([max(1, int(k)).bit_length() for k in self.edits])
        #: Added to diagonals, so that those of the band before the first aren't negative either.
        self.back = int(size.max()) + (1 << int(self.shift.max()))
        grams = [_grams(x) for x in self.texts]
        h = np.concatenate(grams)
        which = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        where = np.concatenate([np.arange(len(g)) for g in grams])
        order = np.argsort(h, kind="stable")
        self.which, self.where = which[order], where[order]
        self.hashes, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.hashes >> np.uint64(64 - _FILTER_BITS)] = True

    def hits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in x, passage, position in passage) of shared q-grams."""
        h = _grams(x)
        at = np.flatnonzero(self.filter[h >> np.uint64(64 - _FILTER_BITS)])
        k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        same = self.hashes[k] == h[at]
        at, k = at[same], k[same]
        n = self.count[k]
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[k], n)
        return np.repeat(at, n), self.which[entry], self.where[entry]

    def search(self, x: np.ndarray, start: np.ndarray) -> dict[tuple[int, int], int]:
        """Least distance within budget by (text, item's place); x holds several texts, parted by zeros."""
        at, which, where = self.hits(x)
        if not len(at):
            return {}
        text = np.searchsorted(start, at, side="right") - 1
        many = len(self.texts)
        pair = text * many + which
        # Only pairs that share a q-gram are counted: there may be many texts and many items.
        _, at_pair, shared = np.unique(pair, return_inverse=True, return_counts=True)
        keep = shared[at_pair] >= self.needed[which]
        if not keep.any():
            return {}
        at, which, where, pair = at[keep], which[keep], where[keep], pair[keep]
        band = (at - where + self.back) >> self.shift[which]
        key = np.concatenate([pair << 32 | band, pair << 32 | band - 1])
        keys, k, n = np.unique(key, return_inverse=True, return_counts=True)
        full = n >= self.needed[(keys >> 32) % many]
        if not full.any():
            return {}
        mine = np.flatnonzero(full[k])
        mine = mine[np.argsort(k[mine], kind="stable")]
        places = np.split(where[mine % len(where)], np.cumsum(n[full])[:-1])
        found: dict[tuple[int, int], int] = {}
        end = np.r_[start[1:] - 1, len(x)]
        keys = keys[full]
        for pair, group in _runs(keys >> 32, np.arange(len(keys))):
            t, p = divmod(pair, many)
            d = self._nearest(x, int(start[t]), int(end[t]), p, [(((int(keys[g]) & 0xFFFFFFFF) << int(self.shift[p])) - self.back, places[g]) for g in group])
            if d < FAR:
                found[t, p] = d
        return found

    def _nearest(self, x: np.ndarray, start: int, end: int, p: int, bands: list[tuple[int, np.ndarray]]) -> int:
        """Least distance within budget of item p's passages to x[start:end]; bands of (first diagonal, places in the item that share q-grams)."""
        item, most = self.texts[p], int(self.edits[p])
        m, wide = min(len(item), PASSAGE), 2 << int(self.shift[p])
        low, first, least = [], [], []
        for diagonal, places in bands:
            shared = np.zeros(len(item) - Q + 2, np.int64)
            shared[places + 1] = 1
            shared = np.cumsum(shared)
            lacking = m - Q + 1 - (shared[m - Q + 1 :] - shared[: len(item) - m + 1])
            a = np.flatnonzero(lacking <= most * Q)
            first.append(a)
            least.append(-(-lacking[a] // Q))
            low.append(np.full(len(a), diagonal))
        first, least, low = np.concatenate(first), np.concatenate(least), np.concatenate(low)
        order = np.argsort(least, kind="stable")
        first, least, low = first[order], least[order], low[order] + first[order]
        best, i = FAR, 0
        while i < len(first) and least[i] <= most:
            take = slice(i, i + (THEN if i else FIRST))
            i = take.stop
            spot = low[take, None] + np.arange(m + wide)
            region = np.where((spot >= start) & (spot < end), x[np.clip(spot, start, end - 1)], 0)
            d = int(banded(item[first[take, None] + np.arange(m)], region, most).min())
            if d <= most:
                best, most = d, d - 1
        return best


def _runs(values: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    ordered = values[order]
    cut = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(order) else np.array([], int)
    for a, b in zip(cut, np.r_[cut[1:], len(order)], strict=True):
        yield int(ordered[a]), order[a:b]


def find(index: Index, texts: list[str | None]) -> list[list[tuple[int, int]]]:
    """(item, least distance) for each text, by item."""
    best: list[dict[int, int]] = [{} for _ in texts]
    if index.whole:
        for found, text in zip(best, texts, strict=True):
            x = folded(text[: 1 << 16]) if text else _NOTHING
            if 0 < len(x) < Q and (len(text) <= 1 << 16 or np.array_equal(folded(text), x)):
                found.update(dict.fromkeys(index.whole.get(x.tobytes(), ()), 0))
    if not index.texts:
        return [sorted(b.items()) for b in best]
    overlap = 2 * PASSAGE + 2 * (2 << int(index.shift.max()))
    pieces, rows, size = [], [], 0

    def look() -> None:
        start = np.cumsum([0, *[len(p) + 1 for p in pieces]])[:-1]
        x = np.zeros(sum(len(p) + 1 for p in pieces), np.uint32)
        for s, p in zip(start, pieces, strict=True):
            x[s : s + len(p)] = p
        for (t, p), d in index.search(x, start).items():
            item = int(index.items[p])
            best[rows[t]][item] = min(d, best[rows[t]].get(item, FAR))

    for row, text in enumerate(texts):
        x = fold(text)[0] if text else np.zeros(0, np.uint32)
        for a in range(0, max(1, len(x) - overlap), PIECE):
            pieces.append(x[a : a + PIECE + overlap])
            rows.append(row)
            size += len(pieces[-1]) + 1
            if size >= PIECE:
                look()
                pieces, rows, size = [], [], 0
    if pieces:
        look()
    return [sorted(b.items()) for b in best]


class Block:
    """Items of bounded size as they come; the index is built by the Python worker that first looks into it."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items = items
        self.built: Index | None = None

    @property
    def index(self) -> Index:
        if self.built is None:
            folds = [(i, folded(t)) for i, t in self.items]
            self.built = Index(np.array([i for i, x in folds if len(x)], np.int64), [x for _, x in folds if len(x)])
        return self.built


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Block]:
    """The whole benchmark, in blocks of about BLOCK_CHARS characters but for a longer item; the driver hands on one after the other."""
    held: list[tuple[int, str]] = []
    size = 0
    for r in benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1])
        if size >= BLOCK_CHARS:
            yield Block(held)
            held, size = [], 0
    if held:
        yield Block(held)


def leaked(docs: DataFrame, block: Block, text: Column) -> Column:
    """Array of (item, distance) that a text column has of one block, item by item."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    @F.pandas_udf(_HIT)
    def look(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"item": i, "distance": d} for i, d in hits] for hits in find(shared.value.index, list(texts))])

    return look(text.cast("string"))


def _passes(benchmark: DataFrame) -> Iterator[tuple[Block, bool]]:
    """(block, whether it is the last); no more than two blocks are held."""
    held = None
    for block in blocks(benchmark):
        if held is not None:
            yield held, False
        held = block
    if held is not None:
        yield held, True


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, item_id, distance: the documents that hold a passage of an item within its edit budget.

    distance is the least over the document's regions and the item's passages. Null and
    empty texts hold nothing; null and empty items are not looked for, items of fewer
    than Q folded characters only as whole texts. Rows of one id, null too, count
    together: one row for each item that any of them holds. An empty table or benchmark
    gives no rows; other columns, and their names, have no effect.
    """
    found = docs.select(F.col(id_col), F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("distance")).filter("false")
    for block, last in _passes(benchmark):
        rows = docs.select(F.col(id_col), F.explode(leaked(docs, block, F.col(text_col))).alias("h")).select(id_col, F.col("h.item").alias("item_id"), F.col("h.distance").alias("distance"))
        found = found.union(rows if last else written(rows, "leaks"))
    return found.groupBy(id_col, "item_id").agg(F.min("distance").alias("distance"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a benchmark passage; columns as before, nothing shuffled.

    Each row counts by itself: repeated rows and null ids like any other; rows of null
    or empty text stay, very long ones are read whole. Ties among items change nothing, as
    one is enough. An empty table stays empty; other columns, whatever their names, stay.
    """
    for block, last in _passes(benchmark):
        docs = docs.filter(F.size(leaked(docs, block, F.col(text_col))) == 0)
        docs = docs if last else written(docs, "unleaked")
    return docs
