"""Alignment of the tokens of two vocabularies over the same bytes.

After both have encoded a whole text, places where a token of either ends and the next
one of either is marked with a space are anchors; they split the text into windows of
token ids. A window's alignment depends on its ids alone, so that it is remembered by
them. Its groups end where tokens of both end; its links are the pairs that overlap.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.store import written
from .common import join_counted
from .tokens import ByteBpe, PieceBpe

#: Windows and their links that a task remembers, and tokens that are aligned at once.
REMEMBERED, LINKS, AT_ONCE = 200_000, 2_000_000, 1 << 19
#: Marks an id of A in a window's key.
OF_A = np.uint32(1 << 31)
#: Counted pairs that are broadcast, 40 bytes each; more are shuffled.
BROADCAST_PAIRS = 1_000_000
#: A pair's number: A's id times this, plus B's.
WIDE = 1 << 32


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs that start there and have these sizes, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Vocabulary:
    """Bytes of a vocabulary's tokens."""

    def __init__(self, bytes_of: list[bytes]) -> None:
        self.sizes = np.array(list(map(len, bytes_of)))
        self.marked = np.array([x.startswith(b" ") for x in bytes_of])
        self._flat, self._starts = np.frombuffer(b"".join(bytes_of), np.uint8), np.cumsum(self.sizes) - self.sizes

    def gives(self, ids: np.ndarray, want: np.ndarray) -> bool:
        sizes = self.sizes[ids]
        return sizes.sum() == len(want) and bool((self._flat[_runs(self._starts[ids], sizes)] == want).all())


class Aligner:
    """Aligns some texts together; windows are remembered from call to call."""

    def __init__(self, path_a: str, path_b: str) -> None:
        a, b = ByteBpe(path_a), PieceBpe(path_b)
        self._encoders, self._sides = (a, b), (Vocabulary(a.bytes_of), Vocabulary(b.bytes_of))
        self._wide = len(b.bytes_of)
        self._forget()

    def _forget(self) -> None:
        self._known: dict[bytes, int] = {}
        self._texts: list[str] = []
        self._counts = np.zeros(0, np.int64)
        self._pairs, self._ends = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a blank and text; none where a vocabulary doesn't give the bytes back."""
        none = np.zeros(0, "<u4")
        if not text:
            return none, none
        found = self._encoders[0].ids(" " + text), self._encoders[1].ids(text)
        want = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass"), np.uint8)
        return found if all(v.gives(x, want) for v, x in zip(self._sides, found, strict=True)) else (none, none)

    def _learn(self, keys: list[bytes]) -> None:
        """Aligns windows, all at once, and numbers them on."""
        ids = np.frombuffer(b"".join(keys), np.uint32)
        of_a = ids >= OF_A
        a, b = (ids[of_a] ^ OF_A).astype(np.int64), ids[~of_a].astype(np.int64)
        last_a = np.cumsum(of_a)[np.cumsum([len(k) // 4 for k in keys]) - 1] - 1
        ends_a, ends_b = (np.cumsum(v.sizes[x]) for v, x in zip(self._sides, (a, b), strict=True))
        ends = np.union1d(ends_a, ends_b)
        pairs = a[np.searchsorted(ends_a, ends)] * self._wide + b[np.searchsorted(ends_b, ends)]
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        parts, i, j = [], 0, 0
        xs, ys = list(map(str, a.tolist())), list(map(str, b.tolist()))
        for p, q in zip((np.searchsorted(ends_a, shared) + 1).tolist(), (np.searchsorted(ends_b, shared) + 1).tolist(), strict=True):
            parts.append(f"{xs[i]}|{ys[j]}" if p == i + 1 and q == j + 1 else f"{','.join(xs[i:p])}|{','.join(ys[j:q])}")
            i, j = p, q
        groups, links = (np.append(0, np.searchsorted(x, ends_a[last_a]) + 1) for x in (shared, ends))
        at = groups.tolist()
        self._known.update(zip(keys, range(len(self._texts), len(self._texts) + len(keys)), strict=True))
        self._texts += [parts[s] if e == s + 1 else ";".join(parts[s:e]) for s, e in zip(at, at[1:])]  # noqa: B905
        self._counts = np.append(self._counts, np.diff(groups))
        self._ends = np.append(self._ends, links[1:] + len(self._pairs))
        self._pairs = np.append(self._pairs, pairs)

    def align(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[str], list[int], list[np.ndarray]]:
        """By text, (A's ids, B's ids), neither empty: groups as text, how many, and (A's id, B's id, times) of its linked pairs."""
        if len(self._texts) > REMEMBERED or len(self._pairs) > LINKS:
            self._forget()
        ids = [np.concatenate(x) for x in zip(*texts, strict=True)]
        ends = [np.cumsum(v.sizes[x]) for v, x in zip(self._sides, ids, strict=True)]
        last = [np.cumsum([len(t[k]) for t in texts]) - 1 for k in (0, 1)]
        # Ends before a token that is marked with a space, and the ends of texts, which both share.
        able = [np.append(v.marked[x[1:]], True) for v, x in zip(self._sides, ids, strict=True)]
        for x, k in zip(able, last, strict=True):
            x[k] = True
        anchors = np.intersect1d(ends[0][able[0]], ends[1][able[1]], assume_unique=True)
        cuts = [np.append(0, np.searchsorted(e, anchors) + 1) for e in ends]
        # A window's key: its ids of A, marked, then those of B.
        both = np.empty(len(ids[0]) + len(ids[1]), np.uint32)
        for k, marked, before in ((0, ids[0] | OF_A, cuts[1][:-1]), (1, ids[1], cuts[0][1:])):
            both[np.arange(len(ids[k])) + np.repeat(before, np.diff(cuts[k]))] = marked
        raw, at = both.tobytes(), (4 * (cuts[0] + cuts[1])).tolist()
        keys = [raw[i:j] for i, j in zip(at, at[1:])]  # noqa: B905
        new = [k for k in dict.fromkeys(keys) if k not in self._known]
        if new:
            self._learn(new)
        numbers = list(map(self._known.__getitem__, keys))
        of_text = np.searchsorted(ends[0][last[0]], anchors)
        first = np.searchsorted(of_text, range(len(texts)))
        at = [*first.tolist(), len(numbers)]
        window = np.array(numbers)
        links = self._ends[window + 1] - self._ends[window]
        size = len(self._sides[0].sizes) * self._wide
        linked = np.repeat(of_text, links) * size + self._pairs[_runs(self._ends[window], links)]
        each, times = np.unique(linked, return_counts=True)
        parts = np.searchsorted(each // size, range(len(texts) + 1)).tolist()
        pairs = each % size
        table = np.stack([pairs // self._wide, pairs % self._wide, times]).astype(np.int32)
        said = [";".join(map(self._texts.__getitem__, numbers[s:e])) for s, e in zip(at, at[1:])]  # noqa: B905
        return said, np.add.reduceat(self._counts[window], first).tolist(), [table[:, s:e] for s, e in zip(parts, parts[1:])]  # noqa: B905


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, groups, links(a, b, n): the alignment of a blank and each whole text.

    path_a names a byte-level vocabulary, path_b one of pieces. groups is text, `a1,a2|b1;a3|b2`
    of decimal ids; links are the linked pairs of ids and how often each is linked. Texts that
    are null or empty, or that a vocabulary doesn't give back byte for byte, have no tokens:
    zeros, an empty string and no links. Repeated rows and null ids are rows like any other; an
    empty table gives no rows; other columns, and their names, have no effect. Very long texts
    are encoded in pieces and aligned whole.
    """
    a = path_a or public_tokenizers.path("byte_bpe_50k.json")
    b = path_b or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a, b)
        keys: list[int | None] = []
        ids: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for key, text in zip(*batch.columns, strict=True):
                keys.append(key.as_py())
                ids.append(aligner.ids(text.as_py()))
                size += len(ids[-1][0]) + len(ids[-1][1]) + 64
                if size > AT_ONCE:
                    yield _batch(aligner, keys, ids)
                    keys, ids, size = [], [], 0
        yield _batch(aligner, keys, ids)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_a long, n_b long, n_groups long, n_links long, groups string, links array<struct<a:int,b:int,n:int>>").withColumnRenamed("id", id_col)


def _batch(aligner: Aligner, keys: list[int | None], ids: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    has = [x for x in ids if len(x[0])]
    done = zip(*aligner.align(has), strict=True) if has else iter(())
    out = [next(done) if len(x[0]) else ("", 0, np.zeros((3, 0), np.int32)) for x in ids]
    a, b, n = np.concatenate([np.zeros((3, 0), np.int32), *[o[2] for o in out]], axis=1)
    links = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[o[2].shape[1] for o in out]]).astype(np.int32)), pa.StructArray.from_arrays(list(map(pa.array, (a, b, n))), ["a", "b", "n"]))
    n_a, n_b, groups = [len(x[0]) for x in ids], [len(x[1]) for x in ids], [o[1] for o in out]
    # Every byte where a token ends is one link: each group has one fewer than its tokens.
    n_links = [x + y - g for x, y, g in zip(n_a, n_b, groups, strict=True)]
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"]
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *[pa.array(x, pa.int64()) for x in (n_a, n_b, groups, n_links)], pa.array([o[0] for o in out], pa.string()), links], names)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, a, b, count, best) of all links of an aligned table: best where no pair of the same b is linked more often."""
    links = aligned.select(F.explode("links").alias("x")).select("x.*")
    counts = written(links.groupBy("a", "b").agg(F.sum("n").alias("count"), F.count("*").alias("rows")), "pairs")
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    best = counts.join(top, "b").withColumn("best", F.col("count") == F.col("top"))
    return best.select((F.col("a").cast("long") * WIDE + F.col("b")).alias("pair"), "a", "b", "count", "rows", "best")


def with_counts(aligned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """An aligned table's columns but links, with n_best and count_sum by row.

    n_best counts links whose pair is linked as often, in the whole table, as any pair of
    the same b; count_sum adds up the counts of all links' pairs. aligned is a written table.
    """
    keyed = written(aligned.withColumn("__row", F.monotonically_increasing_id()), "rows")
    pairs = written(pair_counts(keyed).select("pair", "count", "rows", "best"), "counts")
    links = keyed.select("__row", F.explode("links").alias("x")).select("__row", (F.col("x.a").cast("long") * WIDE + F.col("x.b")).alias("pair"), F.col("x.n").alias("n"))
    joined = links.join(F.broadcast(pairs), "pair") if pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS else join_counted(links, pairs, "pair", "rows")
    sums = joined.groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    kept = [c for c in aligned.columns if c != "links"]
    return keyed.select(*kept, "__row").join(sums, "__row", "left").select(*kept, zero("n_best"), zero("count_sum"))


def op13_alignment(docs: DataFrame) -> DataFrame:
    """Counts by document and the digest of its groups; see align and with_counts."""
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    return with_counts(align(docs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "links"))
