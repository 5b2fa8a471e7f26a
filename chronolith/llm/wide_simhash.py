"""SimHash near copies of a given similarity: wide fingerprints, anchor-point covering, every link checked.

The operator of simhash.py for similarities that 64 bits can't tell: the fingerprint of
a text's different word shingles has as many parts as make a pair of the least
similarity meet with the wanted recall. In each part the anchors are a covering code,
and a fingerprint is replicated to every anchor within covering radius plus one bit.
Fingerprints that are near each other at an anchor are pairs to check on the shingles.

A crowd of copies isn't laid out in pairs. First come links that surely hold, as a
forest at each anchor; then, of what these links haven't joined, each fingerprint with
the nearest one of another component at its anchor; and what is left then, in full:
there the longer fingerprints come along, and a map of the shingles that a text doesn't
share with the middle of its crowd, its pivot. Two texts of one pivot are as similar as
what they have in common beyond it, which their maps bound; so a crowd's pairs that
can't be similar are never rows. The longer fingerprints of the pairs of these two
rounds are compared before the texts are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.store import written
from .common import BROADCAST_ROWS, join_counted, small, small_or_none
from .simhash import _forest, home, nearest_codeword

#: Words of a shingle; least similarity of near copies (Jaccard index), as a fraction.
SHINGLE, LEAST, OF = 5, 4, 5
#: Share of the pairs of just the least similarity that some part brings together.
RECALL = 0.99
#: 64-bit words of a fingerprint that are compared at an anchor; differing bits of a pair to check, and of one that surely holds.
COMPARED, MOST, SURE = 2, 31, 8
#: 64-bit words of the longer fingerprints, and how many standard deviations from what the least similarity expects they may differ.
LONG, DEVIATIONS = 16, 2.33
#: 64-bit words of the map of the shingles that a text and its pivot don't share.
MAPPED = 8
#: Fingerprints that an anchor is the home of, on average; with more, parts get wider. Homes of one anchor that one task compares.
EACH, HOMES = 1 << 10, 1 << 16
#: Distances that are computed at once, and pairs part by part; bytes of text that are looked at at once; shingles that a task keeps for later pairs.
AT_ONCE, PAIRS, PIECE, KEPT = 1 << 18, 1 << 13, 1 << 20, 1 << 22
#: Characters of texts that are broadcast in all.
BROADCAST_CHARS = 1 << 24
#: Links that a task joins to stars at once.
STARS = 1 << 18
BESIDE = ["pivot", "weight", "most", "hidden", *(f"m{i}" for i in range(MAPPED))]
_ODD, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_GAP = re.compile(rb"[ \t-\r]")

Links = tuple[np.ndarray, np.ndarray]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * _ODD
    h = (h ^ h >> np.uint64(29)) * _OTHER
    return h ^ h >> np.uint64(32)


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, A-Z as a-z: sums of bytes times what their place in the word weighs."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    out, a = [np.zeros(0, np.uint64)], 0
    while a < len(raw):
        gap = _GAP.search(raw, min(len(raw), a + PIECE))
        b = gap.end() if gap else len(raw)
        x = np.frombuffer(raw, np.uint8, b - a, a)
        at = np.flatnonzero(~_SPACE[x])
        a = b
        if len(at):
            first = np.r_[True, at[1:] != at[:-1] + 1]
            start = np.flatnonzero(first)
            place = (np.arange(len(at)) - start[np.cumsum(first) - 1]).astype(np.uint64)
            out.append(_mix(np.add.reduceat(_BYTE[x[at]] * (_mix(place + np.uint64(1)) | np.uint64(1)), start)))
    return np.concatenate(out)


def shingles(text: str | None) -> np.ndarray:
    """Different 64-bit hashes, in order, of a text's shingles; of its words where it has fewer, none without words."""
    w = word_hashes(text)
    n = min(SHINGLE, len(w))
    h = np.full(len(w) - n + 1 if n else 0, n, np.uint64)
    for i in range(n):
        h = _mix(h ^ w[i : len(w) - n + 1 + i])
    return np.unique(h)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles have a Jaccard index of LEAST / OF or more; empty ones are alike."""
    if min(len(a), len(b)) * OF < max(len(a), len(b)) * LEAST:
        return False
    few, many = sorted((a, b), key=len)
    both = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum()) if len(few) else 0
    return OF * both >= LEAST * (len(a) + len(b) - both)


def differing() -> float:
    """Chance that a bit of two texts of just the least similarity differs: acos(2 s / (1 + s)) / pi."""
    return math.acos(2 * LEAST / (LEAST + OF)) / math.pi


def plan(n: int) -> tuple[int, int]:
    """(bits of a part, parts) for n fingerprints.

    A part brings two texts together where one bit of it differs at most.
    """
    width = 16
    while n > EACH << (width - 4 * (width // 15)):
        width += 1
    meet = (1 - differing()) ** width + width * differing() * (1 - differing()) ** (width - 1)
    return width, math.ceil(math.log(1 - RECALL) / math.log(1 - meet))


def words_of(width: int, parts: int) -> int:
    return max(COMPARED, -(-width * parts // 64))


def fingerprint(found: np.ndarray, words: int) -> np.ndarray:
    """A bit is 1 where it is in over half the shingles' hashes."""
    ones = np.zeros(64 * words, np.int64)
    salt = _mix(np.arange(1, words + 1, dtype=np.uint64))
    for i in range(0, len(found), 1 << 12):
        h = _mix(found[i : i + (1 << 12), None] ^ salt)
        ones += np.add.reduce(np.unpackbits(h.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(found), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text, fp) of every row of docs; fp is an array of `words` longs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(shingles(t.as_py()), words) for t in b.column(1)], np.uint64).reshape(-1).view(np.int64)
            ends = pa.array(np.arange(0, len(fp) + 1, words), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(ends, pa.array(fp))], ["id", "text", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, text string, fp array<long>")


def cells(nodes: DataFrame, many: int, width: int, parts: int, homes: int = HOMES, words: int = COMPARED, more: Sequence[str] = ()) -> DataFrame:
    """nodes(node, root, fp) at all their anchors: (cell, salt, node, root, f0, f1, home), each cell in one task, in order.

    nodes has `many` rows at most. So many `words` of fp come along, f0, f1 and on, and the columns `more`, of longs.

    A cell that is home to more than `homes` fingerprints is split: its homes go to
    several tasks, its replicas to each of them.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, powers = nearest_codeword(), np.uint64(1) << np.arange(width, dtype=np.uint64)
        flips = np.r_[np.uint64(0), powers]
        for whole in batches:
            for b in (whole.slice(i, 4096) for i in range(0, whole.num_rows, 4096)):
                node, root, *beside = (b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns - 1))
                fp = b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(b.num_rows, -1)
                bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little")
                for p in range(parts):
                    x = bits[:, p * width : (p + 1) * width].astype(np.uint64) @ powers
                    at = np.sort(np.stack([home(x ^ f, width, near) for f in flips], 1), 1)
                    new = np.ones(at.shape, bool)
                    new[:, 1:] = at[:, 1:] != at[:, :-1]
                    row, col = np.nonzero(new)
                    anchor = at[row, col]
                    own = anchor == home(x, width, near)[row]
                    columns = [(np.uint64(p << 48) | anchor).view(np.int64), node[row], root[row], *(fp[row, i].view(np.int64) for i in range(words)), *(x[row] for x in beside), own]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cell", "node", "root", *shown, "home"])

    shown = [*(f"f{i}" for i in range(words)), *more]
    at = nodes.select("node", "root", *more, "fp").mapInArrow(run, f"cell long, node long, root long, {', '.join(f'{c} long' for c in shown)}, home boolean")
    if many > homes:
        hot = at.filter("home").groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > homes)
        hot = written(hot.select("cell", F.ceil(F.col("n") / homes).cast("int").alias("salts")), "hot")
        split = not hot.isEmpty()
    else:  # a node has one home of a part, so that no cell has more
        split = False
    at = at.withColumn("salt", F.lit(0))
    if split:
        at = at.join(small(hot), "cell", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
        own = F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")
        at = at.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("home", F.col("home") & (F.col("salt") == own))
    return at.select("cell", "salt", "node", "root", *shown, "home").repartition("cell", "salt").sortWithinPartitions("cell", "salt")


def _differ(f: np.ndarray, a: np.ndarray, b: np.ndarray | slice) -> np.ndarray:
    return sum(np.bitwise_count(x[a, None] ^ x[b]) for x in f)


def sure_links(cell: int, node: np.ndarray, root: np.ndarray, f: np.ndarray, own: np.ndarray) -> Iterator[Links]:
    """Of a cell: a forest of pairs of SURE bits at most, and each node that has one within MOST bits with itself.

    A home that an earlier one has joined isn't compared with all others again, only
    with those that nothing is known to be near to.
    """
    many, homes = len(node), np.flatnonzero(own)
    label, near, joined = np.arange(many), np.zeros(many, bool), np.zeros(many, bool)
    step = max(1, min(256, AT_ONCE // many))
    for i in range(0, len(homes), step):
        todo = homes[i : i + step]
        todo = todo[~joined[todo]]
        d = _differ(f, todo, slice(None))
        d[np.arange(len(todo)), todo] = 255
        a, j = np.nonzero(d <= MOST)
        if not len(a):
            continue
        near[j] = near[todo[a]] = True
        good = d[a, j] <= SURE
        a, j = a[good], j[good]
        for k, hit in zip(np.unique(a), np.split(j, np.flatnonzero(np.diff(a)) + 1), strict=False):
            hit = np.r_[todo[k], hit]
            found, first = np.unique(label[hit], return_index=True)
            joined[hit] = True
            if len(found) > 1:
                yield np.full(len(found), node[todo[k]]), node[hit[first]]
                label[np.isin(label, found)] = found[0]
    done, rest = homes[joined[homes]], np.flatnonzero(~near)
    for i in range(0, len(done), step):
        rest = rest[~near[rest]]
        if not len(rest):
            break
        near[rest[(_differ(f, done[i : i + step], rest) <= MOST).any(0)]] = True
    yield node[near], node[near]


def _open(node: np.ndarray, root: np.ndarray, f: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of a cell: (homes, rows, how many bits each two differ in, 255 for those of one root), some homes at a time."""
    roots, inside, n = np.unique(root, return_inverse=True, return_counts=True)
    if len(roots) == 1:
        return
    crowd = inside == n.argmax()
    for homes, rows in ((np.flatnonzero(own & crowd), np.flatnonzero(~crowd)), (np.flatnonzero(own & ~crowd), np.arange(len(node)))):
        step = max(1, AT_ONCE // len(rows))
        for i in range(0, len(homes), step):
            todo = homes[i : i + step]
            d = _differ(f[:COMPARED], todo, rows)
            d[inside[todo, None] == inside[rows]] = 255
            yield todo, rows, d


def nearest_pairs(cell: int, node: np.ndarray, root: np.ndarray, f: np.ndarray, own: np.ndarray) -> Iterator[Links]:
    """Of a cell: each home with the nearest of another root, where that is within MOST bits."""
    for todo, rows, d in _open(node, root, f, own):
        a = np.flatnonzero(d.min(1) <= MOST)
        yield node[todo[a]], node[rows[d[a].argmin(1)]]


def likely_pairs(cell: int, node: np.ndarray, root: np.ndarray, f: np.ndarray, own: np.ndarray, width: int) -> Iterator[Links]:
    """Of a cell: all pairs of different roots within MOST bits that the longer fingerprints and the maps beside their pivot leave.

    f has LONG words of fingerprints, then the columns of beside_pivot.

    Two of one bit's difference in a part meet at each one's home: the smaller node's
    names them, in the first such part.
    """
    part = cell >> 48
    f, (pivot, weight, most, hidden), mapped = f[:LONG], f[LONG : LONG + 4].view(np.int64), f[LONG + 4 :]
    for todo, rows, d in _open(node, root, f, own):
        a, j = np.nonzero(d <= MOST)
        a, j = todo[a], rows[j]
        far = np.zeros(len(a), np.uint16)
        for x in f:
            far += np.bitwise_count(x[a] ^ x[j])
        left = np.flatnonzero(far <= most_long())
        same = left[(pivot[a[left]] == pivot[j[left]]) & (pivot[a[left]] >= 0)]
        u, v = a[same], j[same]
        shared = np.minimum(hidden[u], hidden[v]) + sum(np.bitwise_count(x[u] & x[v]).astype(np.int64) for x in mapped)
        left = np.setdiff1d(left, same[weight[u] + weight[v] > most[u] + (LEAST + OF) * shared], assume_unique=True)
        for k in (left[i : i + PAIRS] for i in range(0, len(left), PAIRS)):
            u, v = a[k], j[k]
            bits = np.unpackbits(np.ascontiguousarray((f[:, u] ^ f[:, v]).T).view(np.uint8), axis=1, bitorder="little")
            known = min(part + 1, bits.shape[1] // width)
            meet = bits[:, : known * width].reshape(len(k), known, width).sum(2) <= 1
            new = ~meet[:, :part].any(1)
            if known > part:
                new &= ~meet[:, part] | (node[u] < node[v])
            yield node[u[new]], node[v[new]]


def at_cells(dealt: DataFrame, look: Callable[..., Iterator[Links]]) -> DataFrame:
    """(u, v) different pairs that `look` finds in the cells, u the smaller; a task holds one cell at a time."""

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            new = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            goes_on = held and all(x[-1] == y[0] for x, y in zip(new[:2], held[0][:2], strict=True))
            held.append(new)
            if not goes_on:
                rows = [np.concatenate(x) for x in zip(*held, strict=True)]
                cut = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1
                if len(cut):
                    yield [x[: cut[-1]] for x in rows], np.r_[0, cut]
                    rows = [x[cut[-1] :] for x in rows]
                held = [rows]
        if held:
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            yield rows, np.array([0, len(rows[0])])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, many = [], [], 0

        def flush() -> pa.RecordBatch:
            u, v = np.concatenate(us), np.concatenate(vs)
            pair = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0)
            us.clear(), vs.clear()
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["u", "v"])

        for rows, cut in whole(batches):
            cell, _, node, root, *shown, own = rows
            f = np.stack(shown).view(np.uint64)
            some = np.flatnonzero((np.diff(cut) > 1) & (np.add.reduceat(own, cut[:-1], dtype=np.int64) > 0))
            for a, b in zip(cut[some].tolist(), cut[some + 1].tolist(), strict=True):
                for u, v in look(int(cell[a]), node[a:b], root[a:b], f[:, a:b], own[a:b]):
                    us.append(u)
                    vs.append(v)
                    many += len(u)
                    if many > 1 << 18:
                        yield flush()
                        many = 0
        if us:
            yield flush()

    return dealt.mapInArrow(run, "u long, v long").distinct()


def stars(pairs: DataFrame) -> DataFrame:
    """(u, v) pairs that connect what pairs(u, v) do: of those that a task has, up to STARS at once, each node with the smallest it reaches.

    Few pairs come to one task, which leaves connected_components nothing to do in rounds.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def joined() -> pa.RecordBatch:
            u, v = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(2))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _forest(u, v)], ["u", "v"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= STARS:
                yield joined()
        if held:
            yield joined()

    return pairs.select("u", "v").distinct().mapInArrow(run, "u long, v long")


def with_long(rows: DataFrame) -> DataFrame:
    """rows(node, text, fp) with their longer fingerprint, an array of LONG longs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(shingles(t.as_py()), LONG) for t in b.column(1)], np.uint64).reshape(-1).view(np.int64)
            ends = pa.array(np.arange(0, len(fp) + 1, LONG), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(ends, pa.array(fp))], ["node", "text", "fp", "long"])

    return rows.mapInArrow(run, "node long, text string, fp array<long>, long array<long>")


def most_long() -> int:
    """Bits in which longer fingerprints differ at most where the least similarity is possible."""
    bits, p = 64 * LONG, differing()
    return int(bits * p + DEVIATIONS * math.sqrt(bits * p * (1 - p)))


def likely(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs(u, v) whose longer fingerprints leave the least similarity possible."""
    longer = small(texts.select("node", "long"))
    one = lambda c: longer.select(F.col("node").alias(c), F.col("long").alias(f"long_{c}"))
    far = F.aggregate(F.zip_with("long_u", "long_v", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    return pairs.join(one("u"), "u").join(one("v"), "v").filter(far <= most_long()).select("u", "v")


def _remembering() -> Callable[[int, pa.StringScalar], np.ndarray]:
    """The shingles of a node's text; up to KEPT of them are kept for later calls."""
    kept: dict[int, np.ndarray] = {}
    size = 0

    def of(node: int, text: pa.StringScalar) -> np.ndarray:
        nonlocal size
        found = kept.get(node)
        if found is None:
            found = shingles(text.as_py())
            if size > KEPT:
                kept.clear()
                size = 0
            kept[node] = found
            size += len(found) + 16
        return found

    return of


def _few_chars(texts: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Broadcasts what is selected of texts if that is of BROADCAST_CHARS at most."""
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    return F.broadcast if chars <= BROADCAST_CHARS else (lambda df: df)


def checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs(u, v), a written table, whose texts(node, text), with or without a hint to broadcast them, are similar."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _remembering()
        for b in batches:
            u, v = b.column(0).to_pylist(), b.column(1).to_pylist()
            ok = [similar(of(i, x), of(j, y)) for i, j, x, y in zip(u, v, b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    one = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.join(one("u"), "u").join(one("v"), "v").select("u", "v", "text_u", "text_v").mapInArrow(run, "u long, v long")


def pivots(labelled: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, pivot) of the nodes of pairs(u, v): one node of the largest component that labelled(node, root) has among a node's own, its neighbours' and theirs.

    The pivot of a component is the node of it that most pairs have; any choice is right,
    one that a crowd shares spares its pairs. labelled and pairs are written tables, as is
    what comes back.
    """
    both = pairs.union(pairs.select("v", "u")).toDF("node", "other")
    sizes = labelled.groupBy("root").agg(F.count("*").alias("size"))
    middle = labelled.join(both.groupBy("node").agg(F.count("*").alias("n")), "node").groupBy("root").agg(F.max(F.struct("n", -F.col("node"))).alias("top"))
    rank = F.struct("size", (-F.col("root")).alias("place"), (-F.col("top.col2")).alias("pivot"))
    best = written(labelled.join(small(written(middle.join(sizes, "root"), "middle")), "root").select("node", rank.alias("best")), "best")
    for _ in range(2):
        theirs = both.join(best.withColumnRenamed("node", "other"), "other").select("node", "best")
        best = written(theirs.union(best).groupBy("node").agg(F.max("best").alias("best")), "best")
    return best.select("node", F.col("best.pivot").alias("pivot"))


def beside_pivot(texts: DataFrame, pivot: DataFrame) -> DataFrame:
    """node, pivot, weight, most, hidden, m0, m1 and on of texts(node, text): what bounds the similarity of two texts of one pivot.

    Of a text's shingles A and its pivot's P, those of one alone are D; two texts share
    P but for A's and B's missing ones, and what D and D have in common. A map of bits
    shows all of D but for `hidden` ones whose bit another has. weight is (LEAST + OF) *
    |P - A| + LEAST * |A|, most is (LEAST + OF) * |P|: two texts are similar where
    weight + weight is at most most + (LEAST + OF) * |what D and D have in common|.
    Nodes without a pivot have -1.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _remembering()
        for b in batches:
            out = np.zeros((b.num_rows, 4 + MAPPED), np.int64)
            for i, (node, text, other) in enumerate(zip(b.column(1).to_pylist(), b.column(2), b.column(3), strict=True)):
                if node is None:
                    out[i, 0] = -1
                    continue
                a, p = shingles(text.as_py()), of(node, other)
                apart = np.setxor1d(a, p, assume_unique=True)
                bits = np.zeros(64 * MAPPED, np.uint8)
                bits[_mix(apart) % np.uint64(64 * MAPPED)] = 1
                missing = (len(apart) + len(p) - len(a)) // 2
                out[i, :4] = node, (LEAST + OF) * missing + LEAST * len(a), (LEAST + OF) * len(p), len(apart) - int(bits.sum())
                out[i, 4:] = np.packbits(bits, bitorder="little").view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, np.ascontiguousarray(out.T))], ["node", *BESIDE])

    sent = F.broadcast if small_or_none(pivot) is not None else (lambda df: df)
    known = written(texts.select(F.col("node").alias("pivot"), "text").join(sent(pivot.select("pivot").distinct()), "pivot", "left_semi"), "pivots")
    other = _few_chars(known)(known.withColumnRenamed("text", "other"))
    rows = texts.select("node", "text").join(sent(pivot), "node", "left").join(other, "pivot", "left")
    return rows.select("node", "pivot", "text", "other").mapInArrow(run, ", ".join(["node long", *(f"{c} long" for c in BESIDE)]))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", homes: int = HOMES) -> DataFrame:
    """id, component_id; one row per row of docs.

    component_id is the smallest id that links of similar texts reach, the row's own
    included; null ids take part and get the component_id of the others, or null. Texts
    without words, and null texts, are alike; texts of one fingerprint, as repeated rows,
    are one node. Very long texts count whole. An empty table gives no rows; other
    columns, and their names, have no effect. Ids are integers.
    """
    rows_all = docs.count()
    width, parts = plan(rows_all)
    rows = written(fingerprints(docs, words_of(width, parts), id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("row").alias("node"), F.min("id").alias("first"), F.count("*").alias("n")), "classes")
    seen = written(at_cells(cells(classes.withColumn("root", F.lit(0).cast("long")), rows_all, width, parts, homes), sure_links), "links")
    near = seen.filter("u = v").select(F.col("u").alias("node"))
    many = near.count()
    near = F.broadcast(near) if many <= BROADCAST_ROWS else near
    texts = written(with_long(rows.select(F.col("row").alias("node"), "text", "fp").join(near, "node", "left_semi")), "texts")
    sent = _few_chars(texts)(texts)
    label = lambda nodes: nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    joined = lambda found: written(connected_components(stars(found)), "roots")
    roots = joined(written(checked(seen.filter("u < v"), sent), "checked"))
    nearest = written(at_cells(cells(label(texts.select("node", "fp")), many, width, parts, homes), nearest_pairs), "nearest")
    found = written(likely(nearest, sent), "likely")
    roots = joined(roots.toDF("u", "v").union(written(checked(found, sent), "checked")))
    labelled = written(label(texts.select("node")), "labelled")
    beside = written(beside_pivot(texts, pivots(labelled, found)), "beside")
    fp = F.when(F.size("fp") < LONG, F.col("long")).otherwise(F.col("fp")).alias("fp")
    last = cells(texts.select("node", fp).join(beside, "node").join(labelled, "node"), many, width, parts, homes, LONG, BESIDE)
    open_pairs = written(at_cells(last, partial(likely_pairs, width=width)), "open")
    roots = joined(roots.toDF("u", "v").union(written(checked(open_pairs, sent), "checked")))
    member = written(classes.join(roots, "node", "left").select("fp", "n", "first", F.coalesce("root", "node").alias("root")), "member")
    least = written(member.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("rows")), "least")
    component = written(join_counted(member, least, "root", "rows").select("fp", "n", "component_id"), "components")
    return join_counted(rows.select("id", "fp"), component, "fp", "n").select(F.col("id").alias(id_col), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, that of the smallest id; columns as before.

    Rows with a null id beside others go; rows of one id stay or go together, repeated
    ones too. An empty table stays empty.
    """
    gone = near_components(docs, id_col, text_col).filter(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__gone")).distinct()
    kept = docs.join(gone.hint("shuffle_hash"), docs[id_col].eqNullSafe(gone["__gone"]), "left_anti")
    return kept
