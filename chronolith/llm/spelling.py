"""Grouping of spelling variants by reduced-alphabet generation.

Letters are hashed to a few symbols. Of every reduced word all reduced words within one
edit are generated and joined to the reduced vocabulary: words that differ by one edit
meet there, as their reduced words differ by one edit at most; a map of bits spares those
that no word has the way there. A reduced word that many
words share is told apart by a second alphabet, in which every letter is a symbol. What
is generated are hashes of words, worked out from those of their beginnings and ends;
the strings themselves decide.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.store import written
from .common import join_counted, small

#: Letters of a word; every one is a Latin-1 character.
RUN = re.compile("[A-Za-z\u00c0-\u00ff]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: One occurrence in PERIOD loses a letter.
PERIOD = 97
LEAST_LETTERS, LEAST_COUNT, RATIO = 5, 3, 2
#: Symbols of the first alphabet; words of one reduced word from which on they are told apart by the second.
SYMBOLS, CROWD = 8, 64
#: Different words that a task counts, and characters of words whose neighbours are generated, at once.
COUNTED, AT_ONCE = 200_000, 1 << 15
#: Bits a word of the map of reduced words that exist, and most bits of the map.
SPARSE, MOST_BITS = 16, 1 << 27
#: An odd number; hashes are polynomials in it.
BASE = np.uint64(0x9E3779B97F4A7C15)


def occurrences(doc_id: str, text: str) -> Counter:
    """How often each word stands in a text, after the loss of letters."""
    out: Counter = Counter()
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(RUN.findall(text)).items():
        low = run.translate(LOWER)
        h = zlib.crc32(low.encode(), start)
        if h % PERIOD == 0:
            at = h % len(low)
            low = low[:at] + low[at + 1 :]
        out[low] += n
    return out


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of at least LEAST_LETTERS letters that occur LEAST_COUNT times or more; tasks add up before the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for key, text in zip(*b.columns, strict=True):
                total.update(occurrences(key.as_py() or "", text.as_py() or ""))
                if len(total) > COUNTED:
                    yield _counts(total)
                    total = Counter()
        yield _counts(total)

    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _counts(total: Counter) -> pa.RecordBatch:
    long = [(w, n) for w, n in total.items() if len(w) >= LEAST_LETTERS]
    return pa.RecordBatch.from_arrays([pa.array([w for w, _ in long], pa.string()), pa.array([n for _, n in long], pa.int64())], ["word", "n"])


def alphabet(symbols: int) -> np.ndarray:
    """Value of each Latin-1 character: one of so many, by hash, or its own if symbols is 0."""
    code = np.arange(256, dtype=np.uint64)
    mixed = (code + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    kind = (mixed >> np.uint64(40)) % np.uint64(symbols) if symbols else code
    value = (kind + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    """BASE to the power 0 .. n - 1."""
    return np.cumprod(np.append(np.uint64(1), np.full(max(0, n - 1), BASE)), dtype=np.uint64)


def word_hash(word: str, value: np.ndarray) -> np.uint64:
    letters = value[np.frombuffer(word.encode("latin-1"), np.uint8)]
    return (letters * _powers(len(letters))).sum(dtype=np.uint64)


def neighbourhood(word: str, value: np.ndarray) -> np.ndarray:
    """Hashes of all reduced words within one edit of word's: itself, and each letter left out, replaced or put in."""
    letters = value[np.frombuffer(word.encode("latin-1"), np.uint8)]
    n, symbols = len(letters), np.unique(value)
    power = _powers(n + 1)
    terms = letters * power[:n]
    before = np.append(np.uint64(0), np.cumsum(terms, dtype=np.uint64))
    whole = before[-1]
    after = whole - before
    back = np.uint64(pow(int(BASE), -1, 1 << 64))
    out = [np.array([whole]), before[:-1] + after[1:] * back]
    for s in symbols:
        out += [before[:-1] + s * power[:n] + after[1:], before + s * power + after * BASE]
    return np.unique(np.concatenate(out)).view(np.int64)


def _hashed(words: DataFrame, symbols: int) -> DataFrame:
    """words and `key`, the hash of the reduced word."""
    value = alphabet(symbols)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.fromiter((word_hash(x.as_py(), value) for x in b.column(0)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(h.view(np.int64))], ["word", "n", "key"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, key long")


def _existing(keyed: DataFrame) -> np.ndarray:
    """A map of bits, one for each of the first bits of a key that some row of keyed has: 16 MB at most.

    With very many keys most bits are set, and less is spared.
    """
    n = keyed.count()
    lead = max(12, min(MOST_BITS, SPARSE * max(n, 1)).bit_length() - 1)
    slot = F.shiftrightunsigned("key", 64 - lead)
    bits = keyed.select(F.shiftright(slot, 6).alias("at"), slot.bitwiseAND(63).alias("bit")).groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit AS int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (lead - 6), np.uint64)
    out[bits["at"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)
    return out


def _exists(keys: np.ndarray, there: np.ndarray) -> np.ndarray:
    slot = keys.view(np.uint64) >> np.uint64(64 - (len(there).bit_length() + 5))
    return (there[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def _generated(words: DataFrame, symbols: int, there: np.ndarray) -> DataFrame:
    """(word, key) for every reduced word within one edit that may exist."""
    value, shared = alphabet(symbols), words.sparkSession.sparkContext.broadcast(there)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some, size = [], 0
            for x in b.column(0):
                some.append(x.as_py())
                size += len(some[-1])
                if size > AT_ONCE:
                    yield batch(some)
                    some, size = [], 0
            if some:
                yield batch(some)

    def batch(some: list[str]) -> pa.RecordBatch:
        keys = [k[_exists(k, shared.value)] for k in (neighbourhood(w, value) for w in some)]
        row = np.repeat(np.arange(len(some)), list(map(len, keys)))
        return pa.RecordBatch.from_arrays([pa.array(some).take(pa.array(row)), pa.array(np.concatenate(keys))], ["word", "key"])

    return words.select("word").mapInArrow(run, "word string, key long")


def _met(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """left join right by shuffle: Spark, which sees files and one row of neighbours a word, would size either too low and broadcast it."""
    return left.join(right.hint("merge"), on, how)


def near_words(words: DataFrame, symbols: int = SYMBOLS, crowd: int = CROWD) -> DataFrame:
    """(word, near, near_n) of every two words(word, n) that differ by one edit, in both directions; words is a written table of different words."""
    keyed = written(_hashed(words, symbols), "reduced")
    crowded = written(keyed.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > crowd), "crowded")
    generated = _generated(words, symbols, _existing(keyed))
    apart = keyed if crowded.isEmpty() else keyed.join(small(crowded.select("key")), "key", "left_anti")
    found = _met(generated, apart.withColumnsRenamed({"word": "near", "n": "near_n"}), "key").select("word", "near", "near_n")
    if not crowded.isEmpty():
        close = keyed.join(small(crowded.select("key")), "key", "left_semi").select("word", "n")
        reach = generated.join(small(crowded.select("key")), "key", "left_semi").select("word").distinct()
        exact = written(_hashed(close, 0), "exact")
        found = found.unionByName(_met(_generated(reach, 0, _existing(exact)), exact.withColumnsRenamed({"word": "near", "n": "near_n"}), "key").select("word", "near", "near_n"))
    edit = F.levenshtein("word", "near", 1) == 1
    return found.filter(edit)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms(word, form), whose forms lead to no circle: where they end.

    Every round doubles the steps; chains are as long as the logarithm of the largest count.
    """
    steps = written(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "steps")
    while True:
        on = _met(steps.groupBy("root").agg(F.count("*").alias("rows")), steps.select(F.col("word").alias("root"), F.col("root").alias("next")), "root")
        on = written(on, "next")
        if on.isEmpty():
            return steps
        moved = join_counted(steps, on.hint("merge"), "root", "rows").select("word", F.col("next").alias("root"))
        steps = written(moved.unionByName(steps.join(small(on.select("root")), "root", "left_anti").select("word", "root")), "steps")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", symbols: int = SYMBOLS, crowd: int = CROWD) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs.

    A word is a run of letters, A-Z lower-cased, that loses one letter where the checksum of
    `<id>:<run>` says so. It is near the words that one edit makes of it; its form is the
    one of largest n (of equal ones the first in code-point order) if that is at least
    RATIO times its own, its root where forms end. Null texts and ids are empty; rows of one
    id and text each count; runs and texts may be of any length. An empty table gives no
    rows; other columns, and their names, have no effect.
    """
    words = written(count_words(docs, id_col, text_col), "words")
    near = near_words(words, symbols, crowd)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    full = words.join(best, "word", "left")
    takes = -F.col("best.less") >= RATIO * F.col("n")
    forms = written(full.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(takes, F.col("best.form")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(forms)
    return _met(forms, ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
