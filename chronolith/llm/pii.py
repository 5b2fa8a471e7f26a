"""Personal data: base patterns, and contextual patterns bootstrapped from what they find.

Base entities are seeds. Their contexts, two words before or one on each side, are
patterns where enough different seeds have them and few other words stand there. Every
word in such a place is a token; patterns and the tokens they extract form a graph that
Spark scores in rounds until nothing moves: a pattern is worth what the tokens it
extracts are worth, a token what the patterns around it are worth. Tokens that good
patterns surround are found too, whatever they look like.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.store import written
from .common import small

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The possessive forms match what the plain ones match, in time linear in a text.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
#: A pattern needs so many different seeds, and seeds in such a share of its places, to be a candidate.
MIN_SEEDS, SHARE = 3, 0.5
#: Worth of a pattern from which it counts for its tokens; of a token from which it is found; change at which rounds end.
PATTERN_SCORE, TOKEN_SCORE, STILL = 0.6, 0.95, 1e-6
#: Bits of the filter of patterns' hashes that tasks get, whatever their number; what it lets through is joined.
FILTER_BITS = 26
_ODD, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local@domain from the left: a local part runs back from its @."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in code points, by kind and start."""
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * _ODD
    h = (h ^ h >> np.uint64(29)) * _OTHER
    return h ^ h >> np.uint64(32)


def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Of each ASCII character what it counts as (A-Z as a-z, digits as 0), and whether it is part of no word."""
    value = np.arange(128, dtype=np.uint64)
    value[65:91] += np.uint64(32)
    value[48:58] = 48
    edge = np.zeros(128, bool)
    edge[[ord(c) for c in "\"'`.,;:!?()[]{}<>*#&$%|="]] = True
    return value, edge


_VALUE, _EDGE = _characters()
_BLANK = np.isin(np.arange(128), [32, 9, 10, 11, 12, 13])


def words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of text's words: runs without white space, punctuation at their ends and inside them not counted."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(x, 127)
    plain = x < 128
    blank = plain & _BLANK[low]
    at = np.flatnonzero(~blank & ~(plain & _EDGE[low]))
    if not len(at):
        return np.zeros(0, np.uint64), at, at
    word = np.cumsum(blank)[at]
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
    value = np.where(plain[at], _VALUE[low[at]], x[at]).astype(np.uint64)
    h = np.add.reduceat(_mix(value + np.uint64(1)) * (_mix(place.astype(np.uint64) + np.uint64(7)) | np.uint64(1)), first)
    return _mix(h), at[first], at[np.r_[first[1:] - 1, len(at) - 1]] + 1


def _contexts(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Patterns of places from word `first` to word `last`: of the two words before, and of those on both sides."""
    w = np.r_[np.zeros(2, np.uint64), h, np.zeros(1, np.uint64)]
    two, one, after = w[first], w[first + 1], w[last + 3]
    return _mix(_mix(two + _ODD) ^ one), _mix(_mix(one + _OTHER) ^ after)


def places(text: str, base: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pattern, pattern, start, end, base entity's number or -1): contexts of base entities, and of all words that overlap none."""
    h, start, end = words(text)
    spans = np.array([(a, b) for _, a, b in base], np.int64).reshape(-1, 2)
    first = np.searchsorted(end, spans[:, 0], side="right")
    last = np.searchsorted(start, spans[:, 1], side="left") - 1
    covered = np.zeros(len(h) + 1, np.int64)
    np.add.at(covered, first, 1)
    np.add.at(covered, np.maximum(last, first - 1) + 1, -1)
    free = np.flatnonzero(np.cumsum(covered)[: len(h)] == 0)
    one, two = _contexts(h, np.r_[first, free], np.r_[np.maximum(last, first - 1), free])
    return one.view(np.int64), two.view(np.int64), np.r_[spans[:, 0], start[free]], np.r_[spans[:, 1], end[free]], np.r_[np.arange(len(spans)), np.full(len(free), -1)]


_SPAN = "struct<kind:int,start:long,end:long>"
_PLACE = "row long, pattern long, token string, kind int, start long, end long"


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, text, base): every row with its base spans, written once for all passes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
        for b in batches:
            base = [[{"kind": k, "start": a, "end": e} for k, a, e in base_spans(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(base, pa.list_(span))], ["id", "text", "base"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return written(rows.mapInArrow(run, f"id long, text string, base array<{_SPAN}>").withColumn("row", F.monotonically_increasing_id()), "extracted")


def pattern_filter(patterns: DataFrame) -> np.ndarray:
    """A bit for each hash of patterns(pattern) by its first FILTER_BITS bits: at most 2^(FILTER_BITS - 6) numbers come to the driver."""
    bit = F.shiftrightunsigned("pattern", 64 - FILTER_BITS)
    word = patterns.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(pattern, {64 - FILTER_BITS}) & 63 as int))")).alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for w, bits in word.collect():
        out[w] = bits
    return out


def _through(table: np.ndarray, pattern: np.ndarray) -> np.ndarray:
    bit = pattern.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
    return (table.view(np.uint64)[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)) == 1


def seeds_of(found: DataFrame) -> DataFrame:
    """Places of base entities: a row for each of their two patterns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _rows([(r, *_places_of(t, base)) for r, t, base in _texts(b)], True, None)

    return found.filter(F.size("base") > 0).select("row", "text", "base").mapInArrow(run, _PLACE)


def _texts(b: pa.RecordBatch) -> Iterator[tuple[int, str, list]]:
    yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)


def _places_of(text: str, base: list[dict]) -> tuple:
    spans = [(s["kind"], s["start"], s["end"]) for s in base]
    return text, spans, places(text, spans)


def _rows(each: Iterable[tuple], of_seeds: bool, table: np.ndarray | None) -> pa.RecordBatch:
    out: list[list] = [[], [], [], [], [], []]
    for row, text, spans, (one, two, start, end, number) in each:
        for pattern in (one, two):
            take = np.flatnonzero((number >= 0) if of_seeds else (number < 0) & _through(table, pattern))
            for i in take.tolist():
                a, b = int(start[i]), int(end[i])
                for column, value in zip(out, (row, int(pattern[i]), text[a:b].lower(), spans[number[i]][0] if of_seeds else -1, a, b), strict=True):
                    column.append(value)
    types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["row", "pattern", "token", "kind", "start", "end"])


def others_at(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, others): how many words that aren't base entities stand in the place of patterns(pattern)."""
    shared = found.sparkSession.sparkContext.broadcast(pattern_filter(patterns))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [np.zeros(0, np.int64)]
            for _, t, base in _texts(b):
                one, two, _, _, number = _places_of(t, base)[2]
                both = np.r_[one[number < 0], two[number < 0]]
                hits.append(both[_through(shared.value, both)])
            pattern, n = np.unique(np.concatenate(hits), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pattern), pa.array(n)], ["pattern", "n"])

    counts = found.select("row", "text", "base").mapInArrow(run, "pattern long, n long")
    return counts.groupBy("pattern").agg(F.sum("n").alias("others"))


def tokens_at(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """Words that aren't base entities in the place of patterns(pattern), with kind -1."""
    shared = found.sparkSession.sparkContext.broadcast(pattern_filter(patterns))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _rows([(r, *_places_of(t, base)) for r, t, base in _texts(b)], False, shared.value)

    return found.select("row", "text", "base").mapInArrow(run, _PLACE).join(small(patterns.select("pattern")), "pattern", "left_semi")


def score(seen: DataFrame, min_seeds: int = MIN_SEEDS, pattern_score: float = PATTERN_SCORE) -> DataFrame:
    """(token, k, worth) of unseen tokens that patterns extract, of its best kind k; seen(pattern, token, kind).

    An edge is a pattern around a token, once for any number of occurrences. For each
    kind, a token's worth is 1 less the product of what its good patterns lack, and a
    pattern's worth is the mean over its tokens: of a seed of the kind 1, of another
    seed 0, of others their worth by all other patterns, at first 0. Patterns need
    min_seeds seeds of the kind and, to be good, the given worth. Worths only grow;
    rounds end when none moves.
    """
    edges = written(seen.groupBy("pattern", "token").agg(F.max("kind").alias("kind")), "graph")
    seeds = edges.filter("kind >= 0").groupBy("pattern", F.col("kind").alias("k")).agg(F.count("*").alias("seeds")).filter(F.col("seeds") >= min_seeds)
    graph = written(edges.join(seeds, "pattern").select("pattern", "token", "kind", "k"), "patterns")
    good = graph.select("pattern", "k", F.lit(0.0).alias("good")).distinct()
    before = -1.0
    while True:
        own = F.when(F.col("good") >= pattern_score, F.log(F.greatest(F.lit(1e-9), 1 - F.col("good")))).otherwise(0.0)
        edge = written(graph.join(good, ["pattern", "k"]).select("pattern", "token", "kind", "k", own.alias("own")), "edges")
        lacks = written(edge.filter("kind < 0").groupBy("token", "k").agg(F.sum("own").alias("lacks")), "lacks")
        by_others = 1 - F.exp(F.least(F.lit(0.0), F.coalesce("lacks", F.lit(0.0)) - F.col("own")))
        value = F.when(F.col("kind") >= 0, (F.col("kind") == F.col("k")).cast("double")).otherwise(by_others)
        good = written(edge.join(lacks, ["token", "k"], "left").groupBy("pattern", "k").agg(F.avg(value).alias("good")), "good")
        now = good.agg(F.coalesce(F.sum("good"), F.lit(0.0))).first()[0]
        if abs(now - before) <= STILL:
            break
        before = now
    worth = lacks.select("token", "k", (1 - F.exp("lacks")).alias("worth")).filter("worth > 0")
    return worth.groupBy("token").agg(F.max_by(F.struct("k", "worth"), F.struct("worth", -F.col("k"))).alias("best")).select("token", "best.k", "best.worth")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", token_score: float = TOKEN_SCORE) -> DataFrame:
    """id, base, spans: arrays of (kind, start, end) by kind and start; one row per row of docs.

    spans has the base entities and the words that good patterns extract, without the
    punctuation around them, as the kind that the patterns' seeds have. Null text is empty text; both give empty arrays.
    Repeated rows and null ids give rows of their own; an empty table gives none.
    """
    found = extract(docs, id_col, text_col)
    seeds = written(seeds_of(found), "seeds")
    of = seeds.groupBy("pattern", "kind").agg(F.count_distinct("token").alias("seeds"), F.count("*").alias("n")).filter(F.col("seeds") >= MIN_SEEDS)
    able = written(of.groupBy("pattern").agg(F.sum("n").alias("n")), "able")
    rest = others_at(found, able)
    patterns = written(able.join(rest, "pattern", "left").filter(F.col("n") >= SHARE * (F.col("n") + F.coalesce("others", F.lit(0)))).select("pattern"), "candidates")
    at = written(tokens_at(found, patterns), "tokens")
    seen = seeds.join(small(patterns), "pattern", "left_semi").unionByName(at).select("pattern", "token", "kind")
    tokens = score(seen).filter(F.col("worth") >= token_score).select("token", "k")
    span = F.struct(F.col("k").cast("int").alias("kind"), "start", "end")
    added = at.join(small(written(tokens, "found")), "token").groupBy("row").agg(F.collect_set(span).alias("added"))
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>"))))
    rows = found.select("row", "id", "base")
    return rows.join(small(written(added, "added")), "row", "left").select(F.col("id").alias(id_col), "base", spans.alias("spans"))


def _joined(spans: str):
    kind = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op5_pii(docs: DataFrame) -> DataFrame:
    """Digest of find_pii: counts are of base entities, spans has the added ones too."""
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    return find_pii(docs).select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), added)
