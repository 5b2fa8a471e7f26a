"""Language, licences, personal data, toxicity, leaks, mixing and chats."""

import random
import re
import textwrap

import numpy as np
import pytest
from documents import twin
from oracle import DATA, assert_same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronolith.llm import chat_format, decontaminate, language_id, license_scan, mixing, pii, queries, toxicity
from chronolith.llm.common import fold


def test_language_accuracy_on_held_out_rows(spark):
    docs = queries.table(spark, DATA, "documents")
    got = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 20 and right >= 0.97


def test_language_reads_text_alone(spark):
    docs = queries.table(spark, DATA, "documents")
    model = language_id.train(docs, "doc_id", "text", "lang", ~language_id.held_out())
    a = language_id.identify(docs, model)
    b = language_id.identify(docs.withColumn("doc_id", F.col("doc_id") + 1000).withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y")), model)
    assert a.select(F.col("doc_id") + 1000, "lang_pred", "score").exceptAll(b).isEmpty()


def test_presence_kernel_is_the_cosine():
    rows = ["the cat sat", "der hund lief", "le chat est"]
    x = np.zeros((3, language_id.DIM), np.float32)
    for t, r in zip(rows, x, strict=True):
        language_id.presence(t, r)
    m = language_id.fit(x.astype(np.uint8), ["en", "de", "fr"])
    assert [m.langs[i] for i in m.scores(x).argmax(1)] == ["en", "de", "fr"]


def test_ridge_equals_the_dense_kernel_form():
    rng = np.random.default_rng(2)
    langs = [("en", "de", "fr")[i % 3] for i in range(45)]
    bits = (rng.random((45, language_id.DIM)) < [[0.02 + 0.02 * ((j // 900) % 3 == i % 3) for j in range(language_id.DIM)] for i in range(45)]).astype(np.uint8)
    m = language_id.fit(bits, langs)  # all texts are landmarks: Nystroem is exact
    x = bits / np.sqrt(bits.sum(1, keepdims=True))
    kernel, y = x @ x.T, np.array([[float(a == b) for b in sorted(set(langs))] for a in langs])
    value, vector = np.linalg.eigh(kernel)
    z = vector[:, value > 1e-8 * value.max()] * np.sqrt(value[value > 1e-8 * value.max()])
    want = z @ np.linalg.solve(z.T @ z + language_id.RIDGE * 45 * np.eye(z.shape[1]), z.T @ y)
    dense = kernel @ np.linalg.solve(kernel + language_id.RIDGE * 45 * np.eye(45), y)
    got = m.scores(bits.astype(np.float32))
    assert np.abs(want - dense).max() < 1e-6 and np.abs(got - dense).max() < 1e-3


def test_license_variants(make):
    mit = dict(license_scan.KNOWN[:1])["MIT"]
    rows = [
        (1, "The MIT notice\n" + mit, "en", "a"),
        (2, "Copyright (c) 2020 A. Person\n" + mit.upper().replace(",", " ;"), "en", "a"),
        (3, "x\nReleased under the MIT Licence!\n" + "licensed under cc by-nc 4.0", "en", "a"),
        (4, "no terms here", "en", "a"),
    ]
    got = {r["doc_id"]: (r["text_license"], r["notices"], r["n_notices"]) for r in license_scan.license_scan(make(rows)).collect()}
    assert got[2][0] == "MIT" and got[1][0] is None
    assert got[3] == (None, "CC-BY-NC-4.0,MIT", 2) and got[4] == (None, "", 0)


def test_spellings_side_by_side_and_licences_from_a_folder(spark, make, tmp_path):
    (tmp_path / "Made-1.0.txt").write_text("The Licence of nobody.\nAll may copy under this licence, licence holders or not.")
    (tmp_path / "Plain.txt").write_text("Do what you like.")
    known = license_scan.license_texts(spark, str(tmp_path))
    rows = [(1, "the license of nobody: all may copy under this license; license holders or not", "en", "a"), (2, "do what you like", "en", "a"), (3, "else", "en", "a"), (3, "else", "en", "a"), (None, None, None, None)]
    got = sorted((r["doc_id"] or 0, r["text_license"]) for r in license_scan.license_scan(make(rows), known).collect())
    assert got == [(0, None), (1, "Made-1.0"), (2, "Plain"), (3, None), (3, None)]


def test_known_texts_however_their_lines_are_broken(make):
    long = [(name, t) for name, t in license_scan.KNOWN if len(t) > 200]
    notice = "Copyright (c) 2020 A. Person\nCopyright B. Person\nCopyright holders: C. Person\nAll rights reserved.\n"
    rows, want = [], {}
    for name, t in long:
        for width in range(20, 101):
            mark = ("", " * ", "# ")[width % 3]
            want[len(rows)] = name
            rows.append((len(rows), "\n".join(mark + line for line in [*notice.split("\n"), *textwrap.wrap(t, width, break_long_words=False)]), "en", "a"))
    rows += [(5000 + i, t, "en", "a") for i, t in enumerate(("MIT License", "Copyright notice: x\nReleased under the MIT license", "copyright holders 2019\nMIT LICENCE", "see\nLicensed under CC BY 4.0!\r\nlicense", ""))]
    found = license_scan.license_scan(make(rows)).toPandas()
    got = dict(zip(found["doc_id"], found["text_license"], strict=True))
    assert {i: got[i] for i in want} == want
    assert_same(found, twin(license_scan.SQL, rows))


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    n = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(t) if 16 <= len(n(m)) <= 19 and pii._luhn(n(m))]
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 8 <= len(n(m)) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text("a1.@-_ +(0\n", max_size=40) | st.text("1234567890 -+.()", max_size=60))
def test_base_spans_match_the_plain_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_in_linear_time():
    assert pii.base_spans("1" * 300_000 + " " + "a." * 150_000 + "+" * 1000) == []


def test_contextual_patterns_find_unseen_identifiers(make):
    rows = [(i, f"please write to user{i}@mail.example.com for details", "en", "a") for i in range(12)]
    long = "j" * 300
    rows += [(50, "please write to hidden77(at)corp for details", "en", "a"), (51, "the year 1999x9 was fine", "en", "a")]
    rows += [(52, "so: Please WRITE to (jane.doe), for details", "en", "a"), (53, f"please write to {long} for details", "en", "a"), (54, "please write to us", "en", "a")]
    got = {r["doc_id"]: r for r in pii.op5_pii(make(rows)).collect()}
    at = rows[12][1].index("hidden")
    assert got[50]["spans"].startswith(f"email:{at}:") and got[50]["n_email"] == 0 and got[50]["n_added"] == 1
    assert got[51]["spans"] == "" and got[3]["n_email"] == 1
    assert got[52]["spans"] == "email:21:29" and got[53]["spans"] == "email:16:316"
    assert got[54]["spans"] == ""  # one context alone isn't enough


def plain_score(seen, min_seeds, pattern_score):
    edges = {}
    for p, t, k in seen:
        edges[p, t] = max(k, edges.get((p, t), -1))
    kinds = {(p, k) for (p, _), k in edges.items() if k >= 0 and sum(q == p and j == k for (q, _), j in edges.items()) >= min_seeds}
    good = dict.fromkeys(kinds, 0.0)
    lack = lambda p, k: max(1e-9, 1 - good[p, k]) if good.get((p, k), 0) >= pattern_score else 1.0
    others = lambda p, t, k: 1 - np.prod([lack(q, k) for (q, u), j in edges.items() if j < 0 and u == t and q != p])
    for _ in range(60):
        good = {(p, k): np.mean([float(j == k) if j >= 0 else others(p, t, k) for (q, t), j in edges.items() if q == p]) for p, k in kinds}
    out = {}
    for (_, t), j in edges.items():
        if j < 0:
            worth, k = max((others(None, t, k), -k) for k in range(4))
            if worth > 0:
                out[t] = (-k, worth)
    return out


def test_scores_of_the_graph(spark):
    rng = random.Random(8)
    kind = lambda t: -1 if t % 3 == 0 else rng.choice([t % 2, 3]) if t % 7 == 0 else t % 2
    seen = [(p, f"t{t}", kind(t)) for p in range(12) for t in [rng.randrange(12) * 2 + p % 2 if rng.random() < 0.85 else rng.randrange(24) for _ in range(12)]]
    got = {r["token"]: (r["k"], r["worth"]) for r in pii.score(spark.createDataFrame(seen, "pattern long, token string, kind int")).collect()}
    want = plain_score(seen, pii.MIN_SEEDS, pii.PATTERN_SCORE)
    assert set(got) == set(want) and len(got) > 3
    assert all(got[t][0] == want[t][0] and abs(got[t][1] - want[t][1]) < 1e-4 for t in want)


def test_contexts_of_words_and_entities():
    text = "Mail: (a1@b.c), or a2@b.c now; mail (x9) now"
    base = pii.base_spans(text)
    one, two, start, end, number = pii.places(text, base)
    shown = [text[a:b] for a, b in zip(start, end, strict=True)]
    assert shown == ["a1@b.c", "a2@b.c", "Mail", "or", "now", "mail", "x9", "now"] and number.tolist() == [0, 1] + [-1] * 6
    h = pii.words(text)[0]
    assert h[0] == h[5] and h[2] != h[0] and len(pii.words(" ;; ")[0]) == len(pii.words("")[0]) == 0
    assert pii.words("a1-b2")[0] == pii.words("A7-B8,")[0]


def test_toxicity_on_rows_that_it_did_not_see(spark):
    docs, labels = (queries.table(spark, DATA.replace("0.001", "0.01"), t) for t in ("documents", "labels"))
    some = labels.filter("doc_id % 5 <> 0")
    got = toxicity.toxicity(docs, some).join(labels.filter("doc_id % 5 = 0").select("doc_id", F.col("toxic").alias("y")), "doc_id")
    right = got.agg(F.avg((F.col("toxic").cast("int") == F.col("y")).cast("double"))).first()[0]
    assert right >= 0.93


def plain_logistic(x, y, weight):
    w = np.zeros(x.shape[1])
    for _ in range(60_000):
        g = x.T @ (weight * (1 / (1 + np.exp(-x @ w)) - y)) + toxicity.RIDGE * w
        w -= g / (0.25 * (weight[:, None] * x * x).sum())
    return w


def test_the_chain_equals_a_plain_one(spark, make):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(160):
        low, bad = rng.random() < 0.4, rng.random() < 0.35
        words = [f"plain{rng.randrange(6)}" for _ in range(6)] + ["shoddyish"] * (low and rng.random() < 0.9) + ["vileness"] * (bad and rng.random() < 0.9)
        rows.append((i, " ".join(words), "en", "a"))
        marks.append((i, int(not low), int(bad)))
    docs, labels = make(rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    seen = toxicity.training_rows(docs, labels, "doc_id", "text", ["quality", "toxic"]).orderBy("id").collect()
    fold = np.array([r["fold"] for r in seen])
    y = np.array([[r["quality"] == 0, r["toxic"] == 1] for r in seen], float)
    found = [set(toxicity.beginnings(r["text"])[0]) for r in seen]

    def odds(take, i):
        pos, neg = (y[take, i] == 1).sum(), (y[take, i] == 0).sum()
        out = {}
        for b in set().union(*found):
            if sum(b in f for f in found) >= toxicity.ROWS:
                c = [sum(b in found[j] and y[j, i] == v for j in np.flatnonzero(take)) for v in (0, 1)]
                share = [neg / (pos + neg), pos / (pos + neg)]
                d = [np.log((c[v] + toxicity.PRIOR * share[v] + 1e-9) / ((neg, pos)[v] + toxicity.PRIOR)) for v in (0, 1)]
                out[b] = np.array([d[1] - d[0] if d[1] - d[0] > toxicity.LEAST else 0.0])
        return out

    evidence = lambda text, o: toxicity.evidence(text, o, 1)
    earlier, test, want = np.zeros((160, 0)), [[] for _ in seen], []
    for i in range(2):
        own = np.array([evidence(r["text"], o) for o in [{}] for r in seen]) * 0
        for f in range(toxicity.FOLDS):
            o = odds(fold != f, i)
            own[fold == f] = [evidence(r["text"], o) for r in np.array(seen, dtype=object)[fold == f][:, 1:2].ravel().tolist() for r in [{"text": r}]]
        x = np.hstack([own, earlier, np.ones((160, 1))])
        w = plain_logistic(x, y[:, i], np.ones(160))
        o = odds(np.ones(160, bool), i)
        for j, r in enumerate(seen):
            test[j].append(1 / (1 + np.exp(-np.r_[evidence(r["text"], o), test[j], 1.0] @ w)))
        out = np.zeros(160)
        for f in range(toxicity.FOLDS):
            out[fold == f] = 1 / (1 + np.exp(-x[fold == f] @ plain_logistic(x[fold != f], y[fold != f, i], np.ones((fold != f).sum()))))
        earlier = np.hstack([earlier, out[:, None]])
    got = toxicity.toxicity(docs, labels).orderBy("doc_id").collect()
    diff = [abs(got[j]["p_quality"] - test[j][0]) + abs(got[j]["p_toxic"] - test[j][1]) for j in range(160)]
    assert max(diff) < 0.02 and 20 < sum(r["toxic"] for r in got) < 90


def edit_distance(a, b):
    """Least edits from a to any part of b."""
    last = [0] * (len(b) + 1)
    for i, c in enumerate(a, 1):
        new = [i]
        for j, e in enumerate(b, 1):
            new.append(min(last[j] + 1, new[-1] + 1, last[j - 1] + (c != e)))
        last = new
    return min(last)


def test_leaks_equal_brute_force(spark):
    items = [(r["item_id"], r["text"]) for r in queries.table(spark, DATA, "benchmark").limit(12).collect()]
    p = decontaminate.passages(items)
    index = decontaminate.Index(np.array([i for i, _ in p]), [x for _, x in p])
    rng, plain = random.Random(0), lambda x: "".join(map(chr, x))
    for _ in range(25):
        i, t = rng.choice(items)
        t = list(t)
        for _ in range(rng.randint(0, len(t) // 6)):
            at = rng.randrange(len(t))
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "zz"])
        cut = rng.choice([0, 0, len(t) // 2])
        doc = "pre " * rng.randint(0, 9) + "".join(t[cut:]) + " post"
        near = [(d, decontaminate.budget(len(x))) for j, x in p if j == i for d in [edit_distance(plain(x), plain(fold(doc)[0]))]]
        want = min((d for d, most in near if d <= most), default=None)
        assert dict(decontaminate.find(index, [doc])[0]).get(i) == want


def test_long_documents_and_long_items(make, spark):
    item = " ".join(f"token{i % 37}{i}" for i in range(300))
    rows = [(1, "filler words " * 60_000 + item[400:1400] + " filler" * 50_000, "en", "a"), (2, "filler words " * 1000, "en", "a")]
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.contamination(make(rows), bench).collect()] == [(1, 9, 0)]


def plain_rates(tokens, p, goal):
    """Least squares over r >= 0 by very many small steps."""
    a = (tokens / tokens.sum())[:, None] * p
    r = np.ones(len(p))
    for _ in range(20_000):
        r = np.maximum(0, r - 0.2 * p @ np.linalg.solve(a.T @ p, a.T @ r - goal))
    return a.T @ r, a.T @ p


@pytest.mark.parametrize("goal", [[0.3, 0.5, 0.2], [0.05, 0.9, 0.05], [1.0, 0.0, 0.0]])
def test_rates_equal_brute_force_least_squares(spark, goal):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.6, 0.5, 0.4], 80)
    tokens = rng.integers(5, 60, 80).astype(float)
    df = spark.createDataFrame([(i, float(tokens[i]), [float(v) for v in p[i]]) for i in range(80)], "id long, tokens double, p array<double>")
    got = mixing.fit_rates(df, goal).orderBy("id").collect()
    r = np.array([x["rate"] for x in got])
    sums = (tokens / tokens.sum() * r) @ p
    best, gram = plain_rates(tokens, p, np.array(goal))
    size = lambda s: (s - goal) @ np.linalg.solve(gram, s - goal)
    assert r.min() >= 0 and size(sums) <= 1.05 * size(best) + 1e-6
    assert goal[0] == 1.0 or np.abs(sums - goal).max() < 1e-4


def test_words_that_speak_for_a_domain(spark):
    rows = [(d, [10 + d, 20, 30 + i % 2]) for d in range(3) for i in range(40)]
    t = spark.createDataFrame(rows, "label int, words array<long>")
    got = {r["word"]: tuple(r)[1:] for r in mixing._speaking(t, 3).collect()}
    assert got == {10: (1, 0, 0), 11: (0, 1, 0), 12: (0, 0, 1)}


def test_mixing_query(spark):
    got = queries.op9_mixing(spark, DATA).toPandas()
    assert abs(got.filter(like="p_").sum(axis=1) - 1).max() < 1e-6 and (got.rate >= 0).all()
    assert abs(got.copies.sum() - got.rate.sum()) < 40


def automaton_cost(roles, out):
    """Least cost by trying every way of writing `roles`; out: legal outputs up to some length."""
    best = 1 << 30
    for target in out:
        # align input turns to output turns in order, several inputs to one turn, or none
        n, m = len(roles), len(target)
        cost = {(0, -1): 0}
        for i in range(n + 1):
            for j in range(-1, m):
                if (i, j) not in cost:
                    continue
                c = cost[i, j]
                for k in range(j if j >= 0 else 0, m):
                    step = c + chat_format.INSERT * max(0, k - j - 1)
                    if i < n:
                        put = 0 if roles[i] == target[k] else chat_format.RELABEL
                        to = step + put + (chat_format.MERGE if k == j else 0)
                        if to < cost.get((i + 1, k), 1 << 30):
                            cost[i + 1, k] = to
        for j in range(-1, m):
            if (n, j) in cost:
                best = min(best, cost[n, j] + chat_format.INSERT * (m - 1 - j))
    return best


LEGAL = [s + [2, 3] * n for n in range(1, 6) for s in ([], [1])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=5), st.integers(1, 4))
def test_repair_is_cheapest_however_it_is_cut(roles, size):
    pieces = [roles[i : i + size] for i in range(0, len(roles), size)]
    states = chat_format.ends([chat_format.costs(p) for p in pieces])
    out, total = [], 0
    for piece, (a, b) in zip(pieces, states, strict=True):
        for was, (role, inserted, merged) in zip(piece, chat_format.repair(piece, a, b), strict=True):
            out += [*inserted] + ([] if merged else [role])
            total += chat_format.RELABEL * (role != was) + chat_format.MERGE * merged + chat_format.INSERT * len(inserted)
    end = chat_format.ENDS[states[-1][1]]
    out, total = out + [*end[1]], total + end[0]
    assert out in LEGAL
    assert total == automaton_cost(roles, LEGAL)


@pytest.mark.parametrize("piece", [2, 256])
def test_rendered_chat(spark, piece):
    rows = [(1, i, r, t) for i, (r, t) in enumerate([("system", "s"), ("human", "a"), ("user", "b"), ("gpt", "c"), ("user", "d")])]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_format.format_chats(t, piece=piece).orderBy("turn").collect()
    assert "".join(r["rendered"] for r in got) == "<|system|>\ns\n<|end|>\n<|user|>\na\nb\n<|end|>\n<|assistant|>\nc\n<|end|>\n<|user|>\nd\n<|end|>\n<|assistant|>\n\n<|end|>\n"
    assert [r["action"] for r in got] == ["keep", "keep", "merge", "keep", "keep"]


def test_runs_of_long_items_are_found_at_every_offset(make, spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(46))) for i in range(2)]  # 321 characters each
    index = decontaminate.Index(np.array([0, 1]), [fold(t)[0] for _, t in items])
    runs = [items[0][1][a : a + 160] for a in range(321 - 160 + 1)]
    docs = [f"{word()} {run} {word()}" for run in runs]
    assert all(dict(h).get(0, 99) == 0 for h in decontaminate.find(index, docs))
    edited = ["x " + "".join("9" if i % 10 == 7 else c for i, c in enumerate(run)) + " x" for run in runs]
    assert all(0 in dict(h) for h in decontaminate.find(index, edited))
    assert decontaminate.find(index, [items[0][1][30:170]]) == [[]]
    far = np.frombuffer(("a" * 160).encode("utf-32-le"), np.uint32)[None]
    near = np.pad(far.copy(), ((0, 0), (32, 32)))
    near[0, 32 + 159 - 16 : 32 + 160] = 1  # 17 edits, the last one after the last check of the limit
    assert decontaminate.banded(far, near, 16)[0] == decontaminate.FAR and decontaminate.banded(far, near, 17)[0] == 17
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 100)  # a block an item
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, items[0][1][30:210], "en", "a"), (2, items[1][1][30:210], "en", "a"), (3, "plain", "en", "a")]
    assert sorted(tuple(r) for r in decontaminate.contamination(make(rows), bench).collect()) == [(1, 0, 0), (2, 1, 0)]
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(make(rows), bench).collect()] == [3]


def test_short_items_are_looked_for_as_whole_texts(make, spark):
    bench = spark.createDataFrame([(1, "Yes!"), (2, "yes"), (3, "..."), (4, None), (5, "a passage of several words")], "item_id long, text string")
    rows = [(1, " YES ", "en", "a"), (2, "yes indeed", "en", "a"), (3, "", "en", "a"), (4, "so: a passage of several words", "en", "a"), (4, "yes", "en", "a"), (None, "yes" + " " * 70_000, "en", "a"), (6, "yes" + " " * 70_000 + "no", "en", "a")]
    got = sorted((r["doc_id"] or 0, r["item_id"], r["distance"]) for r in decontaminate.contamination(make(rows), bench).collect())
    assert got == [(0, 1, 0), (0, 2, 0), (1, 1, 0), (1, 2, 0), (4, 1, 0), (4, 2, 0), (4, 5, 0)]
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(make(rows), bench).collect()) == [2, 3, 6]


def test_many_short_texts_against_many_items():
    rng = random.Random(4)
    items = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(24)) for _ in range(3000)]
    index = decontaminate.Index(np.arange(3000), [decontaminate.folded(t) for t in items])
    found = decontaminate.find(index, [f"x {items[i]}" for i in range(0, 3000, 3)])
    assert all(dict(f)[i] == 0 for f, i in zip(found, range(0, 3000, 3), strict=True))
