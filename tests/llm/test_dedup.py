"""Exact, near and line duplicates against brute force and SQL."""

import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from documents import twin
from oracle import DATA, assert_same, duck
from pyspark.sql import functions as F

from chronolith.llm import common, exact_dedup, line_dedup, queries, simhash, wide_simhash
from chronolith.operators.components import connected_components


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_twins(spark, name):
    assert_same(queries.queries()[name](spark, DATA).toPandas(), duck(DATA, queries.oracle_sql()[name]))


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    entries, bits = exact_dedup.build_directory(keys, 300)
    assert bits >= 5 and entries.select("entry").distinct().count() == entries.count() <= 2**bits
    per = keys.join(entries, F.shiftrightunsigned("h", 64 - bits) == F.col("entry")).groupBy("bucket").count()
    assert per.agg(F.max("count")).first()[0] <= 300 and per.agg(F.sum("count")).first()[0] == 5000


def test_directory_doubles_as_far_as_it_must(spark):
    keys = spark.createDataFrame([(5,), (7,), (4,), (-1,)], "h long")  # three keys part at the 62nd bit
    entries, bits = exact_dedup.build_directory(keys, 1)
    got = exact_dedup.Index(entries, bits, keys).bucket_of(keys)
    assert bits == 64 and got.count() == 4 and got.select("bucket").distinct().count() == 4


def by_id(df):
    return {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in df.collect()}


@pytest.mark.parametrize("key", [5, 0])
def test_chains_keep_colliding_texts_apart(spark, make, monkeypatch, key):
    docs = make([(i, t, "en", "a") for i, t in enumerate(["a", "b", "A", "é", "É"])])
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c: F.lit(key).cast("long"))
    assert by_id(exact_dedup.exact_dedup(docs)) == {0: (2, 2), 2: (2, 2), 1: (1, 1), 3: (3, 1), 4: (4, 1)}
    assert sorted(r["doc_id"] for r in exact_dedup.drop_copies(docs).collect()) == [1, 2, 3, 4]


def test_the_index_decides(make):
    docs = make([(i, f"text {i % 40}", "en", "a") for i in range(100)])
    keyed = exact_dedup.keyed_rows(docs)
    index = exact_dedup.build_index(docs, keyed, capacity=4)
    assert index.bits >= 3 and index.chains.count() == 40
    found = exact_dedup.look_up(docs, keyed, index)
    assert {r["id"]: r["keep_id"] for r in found.collect()} == {i: max(j for j in range(100) if j % 40 == i % 40) for i in range(100)}
    other = exact_dedup.Index(index.entries, index.bits, index.chains.withColumn("keep_id", F.lit(-1).cast("long")))
    assert {r["keep_id"] for r in exact_dedup.look_up(docs, keyed, other).collect()} == {-1}
    moved = exact_dedup.Index(index.entries.withColumn("bucket", F.lit("0:0")), index.bits, index.chains)
    assert exact_dedup.look_up(docs, keyed, moved).count() == 0


def brute_fingerprint(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split(" ")
    words = [w for part in words for w in re.findall("[^\x20\x09-\x0d]+", part)]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    if not shingles:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits=4):
    ids, parent = sorted(fps), {i: i for i in fps}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    arr = np.array([fps[i] for i in ids], np.uint64)
    for n, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[n]) <= bits):
            a, b = find(i), find(ids[j])
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark):
    docs = queries.table(spark, DATA, "documents")
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs.select("doc_id", "text").collect()}
    want = brute_components(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(docs).collect()}
    assert got == {i: (f"{f:016x}", want[i]) for i, f in fps.items()}


@pytest.mark.parametrize("parts, homes", [(3, 1 << 16), (3, 40), (2, 1 << 16)])
def test_links_connect_crowded_fingerprints(spark, parts, homes):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {0: 0, 1: 1}
    for i in range(2, 260):
        base = centre if i % 2 else rng.getrandbits(64)
        fps[i] = base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6)))
    fps = {i: f for i, f in fps.items() if f not in [fps[j] for j in fps if j < i]}
    rows = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps.values()], "fp long")
    roots = {r["node"]: r["root"] for r in connected_components(simhash.near_links(rows, parts=parts, homes=homes)).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for i, f in fps.items():
        s = int(np.uint64(f).astype(np.int64))
        got[roots.get(s, s)].add(i)
    for i, c in brute_components(fps).items():
        want[c].add(i)
    assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in want.values()}


def test_components_of_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "u long, v long")
    assert {r["root"] for r in connected_components(edges).collect()} == {0, 100}


def test_lines_near_the_threshold_are_counted_exactly(make):
    rows = [(i, "common line\nown %d\nrare" % i if i < 10 else "rare\nown %d" % i, "en", f"s{i}") for i in range(14)]
    rows += [(20 + i, "one site only", "en", "s0") for i in range(30)]
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(make(rows), min_sites=11).collect()}
    assert got[0]["text"] == "common line\nown 0" and got[13]["text"] == "own 13" and got[25]["n_removed"] == 0
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(make(rows), min_sites=10).collect()}
    assert got[0] == "own 0"


@pytest.mark.parametrize("homes", [1 << 16, 8])
def test_near_copies_from_a_similarity_of_four_fifths(make, homes):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    boiler = " ".join(word() for _ in range(20))
    rows = []
    for i in range(60):  # a text, and copies of which a share of the words at one end is new
        words = [word() for _ in range(100 + i)]
        rows.append((10 * i, f"{boiler} {' '.join(words)}", "en", "a"))
        for n, share in enumerate((0.08, 0.10, 0.12, 0.3), 1):
            k = int(share * len(words))
            rows.append((10 * i + n, f"{boiler} {' '.join(words[:-k] + [word() for _ in range(k)])}", "en", "a"))
    rows += [(1000 + i, " ".join([word(), *boiler.split() * 9, word()]), "en", "a") for i in range(40)]  # a large group
    sets = {r[0]: wide_simhash.shingles(r[1]) for r in rows}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        both = len(set(sets[a].tolist()) & set(sets[b].tolist()))
        if both / (len(sets[a]) + len(sets[b]) - both) >= 0.8 and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    assert 60 < len(set(root.values())) < len(root) - 150
    got = {r["doc_id"]: r["component_id"] for r in wide_simhash.near_components(make(rows), homes=homes).collect()}
    assert all(root[i] == root[c] for i, c in got.items())
    assert sum(got[i] == c for i, c in root.items()) >= 0.97 * len(root)


def test_a_crowd_beside_texts_below_the_similarity_is_not_laid_out_in_pairs(make, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]

    def changed(n):
        return " ".join(f"new{rng.random()}" if i in at else w for at in [set(rng.sample(range(300), n))] for i, w in enumerate(base))

    rows = [(i, changed(1), "en", "a") for i in range(60)] + [(100 + i, changed(13), "en", "a") for i in range(40)] + [(200 + i, changed(6), "en", "a") for i in range(10)]
    sets = {r[0]: wide_simhash.shingles(r[1]) for r in rows}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if wide_simhash.similar(sets[a], sets[b]) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    made, plain = [], wide_simhash.checked
    monkeypatch.setattr(wide_simhash, "checked", lambda pairs, texts: made.append((pairs.count(), wide_simhash.likely(pairs, texts).count())) or plain(pairs, texts))
    got = {r["doc_id"]: r["component_id"] for r in wide_simhash.near_components(make(rows)).collect()}
    assert got == root and sum(r >= 100 for r in root.values()) == 40
    assert made[-1][0] == made[-1][1] < 40 * 70 / 4


def test_a_crowd_just_below_the_similarity_is_told_apart_by_its_pivot(make, monkeypatch):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(300)]

    def changed(n):
        return " ".join(f"new{rng.random()}" if i in at else w for at in [set(rng.sample(range(300), n))] for i, w in enumerate(base))

    rows = [(i, changed(1), "en", "a") for i in range(60)] + [(100 + i, changed(7), "en", "a") for i in range(40)]
    sets = {r[0]: wide_simhash.shingles(r[1]) for r in rows}
    root, open_pairs = {i: i for i in sets}, 0
    for a, b in itertools.combinations(sets, 2):
        if wide_simhash.similar(sets[a], sets[b]) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
        both = len(np.intersect1d(sets[a], sets[b]))
        open_pairs += 0.74 <= both / (len(sets[a]) + len(sets[b]) - both) < 0.8
    made, plain = [], wide_simhash.checked
    monkeypatch.setattr(wide_simhash, "checked", lambda pairs, texts: made.append(pairs.count()) or plain(pairs, texts))
    got = {r["doc_id"]: r["component_id"] for r in wide_simhash.near_components(make(rows)).collect()}
    assert got == root and sum(r >= 100 for r in root.values()) > 20
    assert open_pairs > 1500 and made[-1] < 100


def test_maps_beside_a_pivot_never_hide_a_similar_pair(make):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base)]
    for i in range(80):  # changes of all sizes, many at places that others change too, some of one and the same new word
        words = [rng.choice(["same", f"new{i}"]) if j < 60 and rng.random() < i / 700 else w for j, w in enumerate(base)]
        texts.append(" ".join(words[: 120 - rng.choice([0, 0, 5, 20])]))
    texts += [" ".join(f"z{i % 7}{j}" for j in range(400)) for i in range(3)] + ["", "one"]
    rows = make([(i, t, "en", "a") for i, t in enumerate(texts)]).select(F.col("doc_id").alias("node"), "text")
    pivot = rows.filter("node <> 5").select("node", F.lit(0).cast("long").alias("pivot"))
    found = {r["node"]: r for r in wide_simhash.beside_pivot(rows, pivot).collect()}
    assert found.pop(5)["pivot"] == -1 and len(found) == len(texts) - 1
    maps = {n: [r[f"m{i}"] & (1 << 64) - 1 for i in range(wide_simhash.MAPPED)] for n, r in found.items()}
    sets = [wide_simhash.shingles(t) for t in texts]
    near = apart = 0
    for a, b in itertools.combinations(found, 2):
        x, y = found[a], found[b]
        shared = min(x["hidden"], y["hidden"]) + sum((p & q).bit_count() for p, q in zip(maps[a], maps[b], strict=True))
        possible = x["weight"] + y["weight"] <= x["most"] + 9 * shared
        assert possible or not wide_simhash.similar(sets[a], sets[b])
        near += wide_simhash.similar(sets[a], sets[b])
        apart += not possible
    assert near > 100 and apart > 1000


@pytest.mark.parametrize("n", [1, 300_000, 10_000_000, 10**10])
def test_parts_bring_near_fingerprints_together(n):
    width, parts = wide_simhash.plan(n)
    p = wide_simhash.differing()
    miss = (1 - (1 - p) ** width - width * p * (1 - p) ** (width - 1)) ** parts
    assert 1 - miss >= wide_simhash.RECALL and 64 * wide_simhash.words_of(width, parts) >= width * parts
    rng = np.random.default_rng(n)
    fp = rng.integers(0, 2, (200, width * parts)).astype(bool)
    near = fp ^ (rng.random(fp.shape) < p)
    meets = ((fp ^ near).reshape(200, parts, width).sum(2) <= 1).any(1)
    assert meets.mean() >= 0.96


def test_word_hashes_follow_the_words_alone(monkeypatch):
    texts = ["Some  words\there\nand more \x0b words", " some words here and more words", "some WORDS here and More words"]
    first, second, third = (wide_simhash.word_hashes(t) for t in texts)
    assert (first == second).all() and (second == third).all() and len(set(first.tolist())) == 5
    monkeypatch.setattr(wide_simhash, "PIECE", 3)
    assert (wide_simhash.word_hashes(texts[0]) == first).all()
    assert len(wide_simhash.word_hashes(None)) == len(wide_simhash.word_hashes(" \n")) == 0
    assert len(wide_simhash.shingles(None)) == 0 and len(wide_simhash.shingles("a b")) == 1


def test_lines_of_tabs_and_with_carriage_returns(make):
    rows = [(i, f"foo  bar\r\n\t\n \x0c\t\r\nown {i}\nfoo\tbar\nlast" if i % 2 else f"  foo bar\n\t\nown {i}\t\n\r\nlast\r", "en", f"s{i}") for i in range(14)]
    rows += [(20, None, "en", "s1"), (21, "\t\n\n", "en", "s2"), (22, "", "en", None), (23, "foo bar", "en", None)]
    got = line_dedup.op7_line_dedup(make(rows))
    assert_same(got.toPandas(), twin(line_dedup.SQL, rows))
    text = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(make(rows)).collect()}
    assert text[0] == "\t\nown 0\t\n\r" and text[1] == "\t\n \x0c\t\r\nown 1" and text[21] == "\t\n\n" and text[23] == ""


def test_a_line_that_most_rows_have_where_lines_are_not_broadcast(make, monkeypatch):
    rows = [(i if i % 3 else None, "\n".join(["everywhere", f"some {i % 7}", f"own {i}"]), "en", f"s{i % 40}") for i in range(400)]
    want = sorted(map(str, line_dedup.line_dedup(make(rows)).collect()))
    assert all("everywhere" not in r for r in want)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    assert sorted(map(str, line_dedup.line_dedup(make(rows)).collect())) == want


def test_copies_where_keys_are_not_broadcast(make, monkeypatch):
    rows = [(i, f"Text {i % 40 if i % 3 else 'of most'}", "en", "a") for i in range(300)]
    want = by_id(exact_dedup.exact_dedup(make(rows)))
    assert max(n for _, n in want.values()) == 100
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    assert by_id(exact_dedup.exact_dedup(make(rows))) == want


def test_near_copies_of_few_texts_take_few_jobs(spark, make):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, last = [], []
    for i in range(40):  # a chain of near copies, each one of the last one: components by rounds alone would take many
        last = [*last[10:], *(word() for _ in range(10 if last else 200))]
        rows.append((i, " ".join(last), "en", "a"))
    rows += [(100 + i, f"copy {i % 2} " + " ".join(f"w{j}" for j in range(60)), "en", "a") for i in range(20)] + [(200 + i, " ".join(word() for _ in range(50)), "en", "a") for i in range(20)]
    docs = make(rows)
    spark.sparkContext.setJobGroup("near", "jobs of near_components")
    got = {r["doc_id"]: r["component_id"] for r in wide_simhash.near_components(docs).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("near"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [got[i] for i in range(40)] == [0] * 40 and {got[i] for i in range(100, 120)} == {100} and all(got[i] == i for i in range(200, 220))
    assert jobs <= 160


@pytest.mark.parametrize("at_once", [1 << 18, 3])
def test_stars_connect_what_the_pairs_do(spark, monkeypatch, at_once):
    monkeypatch.setattr(wide_simhash, "STARS", at_once)
    pairs = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (7, 7), (300, 300), (-5, 400)], "u long, v long")
    got = {r["node"]: r["root"] for r in connected_components(wide_simhash.stars(pairs)).collect()}
    assert got == {i: 0 for i in range(201)} | {500: -5, 400: -5, -5: -5}
    assert wide_simhash.stars(pairs.limit(0)).collect() == []
