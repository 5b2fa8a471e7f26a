"""SimHash near duplicates by anchor-point covering.

A fingerprint's 64 bits fall into parts, and of two fingerprints that differ in at
most `bits` places some part differs in at most bits // parts. In each part the
anchors are the words of a covering code: perfect Hamming(15, 11) blocks, of covering
radius 1, beside the remaining bits as they are. A fingerprint's home is the anchor
nearest to it; it is replicated to every anchor within covering radius plus threshold
that can be the home of a fingerprint it links to. Homes are compared with replicas
at each anchor.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.store import written
from .common import join_counted, small
from ..operators.components import connected_components

SHINGLE, SEED, BITS = 4, 42, 4
#: Homes of one anchor that one task compares; anchors with more are split by home.
HOMES = 1 << 16
#: With more distinct fingerprints than this two parts of more anchors are used, else three.
FEW = 1 << 26
#: Pairs of one anchor up to which all its pairs are laid out at once, and pairs at once.
PAIRS, AT_ONCE = 1 << 14, 1 << 21


def fingerprint(text: str | None) -> int:
    """SimHash over XXH64 of the space-joined word shingles; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(size + 1) - 1
    start, end = (end - size)[: n - SHINGLE + 1], end[SHINGLE - 1 :]
    ones, total, digest = np.zeros(64, np.int64), len(start), xxhash.xxh64_intdigest
    for i in range(0, total, 1 << 16):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(start[i : i + (1 << 16)].tolist(), end[i : i + (1 << 16)].tolist(), strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row of docs; fp holds the fingerprint's 64 bits as a long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_py()) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def nearest_codeword() -> np.ndarray:
    """Of each 15-bit word the nearest word of the Hamming code."""
    w = np.arange(1 << 15, dtype=np.uint32)
    syndrome = np.zeros_like(w)
    for i in range(15):
        syndrome ^= np.where(w >> i & 1, i + 1, 0).astype(np.uint32)
    return np.where(syndrome, w ^ (np.uint32(1) << (syndrome - (syndrome > 0))), w).astype(np.uint64)


def _ranges(parts: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each part."""
    cuts = [round(64 * i / parts) for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def home(x: np.ndarray, bits: int, nearest: np.ndarray) -> np.ndarray:
    """The anchor nearest to each part value."""
    out = x.copy()
    for i in range(0, bits - 14, 15):
        block = np.uint64(0x7FFF << i)
        out = out & ~block | nearest[(x & block) >> np.uint64(i)] << np.uint64(i)
    return out


def replicas(distinct: DataFrame, bits: int, parts: int) -> DataFrame:
    """(part, anchor, fp, home) rows of distinct(fp): each fingerprint at all its anchors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest, each = nearest_codeword(), bits // parts
        for whole in batches:
            for b in (whole.slice(i, 4096) for i in range(0, whole.num_rows, 4096)):
                fp = b.column(0).to_numpy(zero_copy_only=False)
                for part, (first, size) in enumerate(_ranges(parts)):
                    x = fp.view(np.uint64) >> np.uint64(first) & np.uint64((1 << size) - 1)
                    flips = [sum(1 << i for i in c) for k in range(each + 1) for c in combinations(range(size), k)]
                    own = home(x, size, nearest)
                    at = np.sort(np.stack([home(x ^ np.uint64(f), size, nearest) for f in flips], 1), 1)
                    new = np.ones(at.shape, bool)
                    new[:, 1:] = at[:, 1:] != at[:, :-1]
                    row, col = np.nonzero(new)
                    anchor = at[row, col]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), part, np.int32)), pa.array(anchor.view(np.int64)), pa.array(fp[row]), pa.array(anchor == own[row])],
                        ["part", "anchor", "fp", "home"],
                    )

    return distinct.mapInArrow(run, "part int, anchor long, fp long, home boolean")


def _near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= bits


def _large(fps: np.ndarray, home: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of one anchor, only those that join what earlier ones haven't joined."""
    label = np.arange(len(fps))
    for i in np.flatnonzero(home):
        hit = np.flatnonzero(_near(fps, fps[i], bits))
        found, first = np.unique(label[hit], return_index=True)
        if len(found) > 1:
            yield np.full(len(found), fps[i]), fps[hit[first]]
            label[np.isin(label, found)] = found[0]


def _links(cell: np.ndarray, fps: np.ndarray, home: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between homes and replicas of whole cells; rows of a cell lie together."""
    start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    count = np.diff(np.r_[start, len(cell)])
    homes = np.add.reduceat(home.astype(np.int64), start)
    big = homes * count > PAIRS
    for s, n in zip(start[big], count[big], strict=True):
        yield from _large(fps[s : s + n], home[s : s + n], bits)
    group = np.repeat(np.arange(len(start)), count)
    mine = np.flatnonzero(home & ~big[group])
    todo = count[group[mine]]
    cut = np.searchsorted(np.cumsum(todo), np.arange(AT_ONCE, todo.sum() + AT_ONCE, AT_ONCE), side="right")
    for a, b in zip(np.r_[0, cut], np.r_[cut, len(mine)], strict=True):
        h, n = mine[a:b], todo[a:b]
        if len(h):
            left = np.repeat(h, n)
            right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[group[h]], n)
            ok = _near(fps[left], fps[right], bits) & (left != right)
            yield fps[left[ok]], fps[right[ok]]


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes of a few links."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        m = np.minimum(label[a], label[b])
        np.minimum.at(low, label[a], m)
        np.minimum.at(low, label[b], m)
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def links(cells: DataFrame, bits: int) -> DataFrame:
    """(u, v) links of cells(part, anchor, salt, fp, home): enough to connect what is near.

    A task holds the 8-byte fingerprints of one cell at a time.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple] = []
        us, vs, many = [], [], 0

        def flush() -> pa.RecordBatch:
            u, v = _forest(np.concatenate(us), np.concatenate(vs))
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        def whole(last: bool) -> tuple | None:
            """The rows of cells that have ended; what may go on stays in rest."""
            keys = [np.concatenate(x) for x in zip(*rest, strict=True)]
            same = (keys[0] == keys[0][-1]) & (keys[1] == keys[1][-1]) & (keys[2] == keys[2][-1])
            n = len(same) if last else len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            rest[:] = [tuple(x[n:] for x in keys)] if n < len(same) else []
            if not n:
                return None
            part, anchor, salt, fp, home = (x[:n] for x in keys)
            changed = np.r_[False, (part[1:] != part[:-1]) | (anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])]
            return np.cumsum(changed), fp.view(np.uint64), home

        def ended(b: tuple) -> bool:
            return any(x[-1] != y[0][0] for x, y in zip(b[:3], zip(*rest, strict=True), strict=False)) if rest else False

        for batch in batches:
            if not batch.num_rows:
                continue
            b = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cells_end = ended(b) or any(x[0] != x[-1] for x in b[:3])
            rest.append(b)
            done = whole(False) if cells_end else None
            if done:
                for u, v in _links(*done, bits):
                    us.append(u)
                    vs.append(v)
                    many += len(u)
                    if many > 1 << 18:
                        yield flush()
                        us, vs, many = [], [], 0
        done = whole(True) if rest else None
        if done:
            for u, v in _links(*done, bits):
                us.append(u)
                vs.append(v)
        if us:
            yield flush()

    columns = ["part", "anchor", "salt", "fp", "home"]
    dealt = cells.select(*columns).repartition("part", "anchor", "salt").sortWithinPartitions("part", "anchor", "salt")
    return dealt.mapInArrow(run, "u long, v long")


def near_links(distinct: DataFrame, bits: int = BITS, parts: int | None = None, homes: int = HOMES) -> DataFrame:
    """(u, v) pairs that connect the fingerprints of distinct(fp) at `bits` or fewer differing bits.

    An anchor that is home to more than `homes` fingerprints is split: its homes go to
    several tasks, its replicas to each of them.
    """
    parts = parts or (3 if distinct.count() <= FEW else 2)
    at = replicas(distinct, bits, parts)
    hot = written(
        at.filter("home").groupBy("part", "anchor").agg(F.count("*").alias("n")).filter(F.col("n") > homes).select("part", "anchor", F.ceil(F.col("n") / homes).cast("int").alias("salts")),
        "hot",
    )
    if hot.isEmpty():
        return links(at.withColumn("salt", F.lit(0)), bits)
    at = at.join(small(hot), ["part", "anchor"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int")
    at = at.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("home", F.col("home") & (F.col("salt") == own))
    return links(at, bits)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, parts: int | None = None) -> DataFrame:
    """id, fingerprint, component_id; one row per row of docs.

    component_id is the smallest id that links of `bits` or fewer differing bits reach,
    the row's own included. Texts without words, and null texts, have fingerprint zero
    and are linked like any other. Null ids take part and get the component_id of the
    others, or null. A repeated row gives a repeated row; an empty table gives none.
    Very long texts count with all their shingles; other columns, and their names, have no
    effect. Ids are integers.
    """
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "classes")
    roots = connected_components(near_links(classes.select("fp"), bits, parts))
    member = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "n", "first", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("rows"))
    component = written(join_counted(member, least, "root", "rows").select("fp", "n", "component_id"), "components")
    return join_counted(rows, component, "fp", "n").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, that of the smallest id; columns as before.

    Rows with a null id beside others go; rows of one id stay or go together.
    """
    gone = simhash_components(docs, id_col, text_col).filter(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__id")).distinct()
    return docs.join(gone.hint("shuffle_hash"), docs[id_col].eqNullSafe(F.col("__id")), "left_anti")
