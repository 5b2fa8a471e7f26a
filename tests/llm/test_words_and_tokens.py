"""Spelling variants, packing and token alignment against brute force over whole tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from oracle import DATA
from tokenizers import Tokenizer

from chronolith.llm import alignment, packing, queries, spelling, tokens
from chronolith.llm.common import table, written

WORD = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
BYTE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
BYTE.encode_special_tokens = True
PIECE = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
BITS = [*"ab  \n\t\r.'sé1A▁<0x0A>", "\x0b", "\xa0", "\x1c", "　", "é", "<|endoftext|>", "  ", "\n\n", "日本", "𝒳", "​", "İ", "Σ", "ﬁ", "﻿", "n't", "'S", "'ll", "²", "ª", "÷", "—", "word", " words"]


def texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.randint(1, 40))) for _ in range(n)]


def test_encoders_give_the_ids_of_the_libraries(spark, monkeypatch):
    monkeypatch.setattr(tokens, "PIECE", 60)  # long texts are cut
    word, byte, piece = tokens.WordBpe(public_tokenizers.path("word_bpe_49k.json")), tokens.ByteBpe(public_tokenizers.path("byte_bpe_50k.json")), tokens.PieceBpe(public_tokenizers.path("piece_bpe_32k.model"))
    for t in [*texts(4000), *[r[0] for r in table(spark, DATA, "documents").select("text").collect()]]:
        assert word.ids(t).tolist() == WORD.encode(t, add_special_tokens=False).ids
        assert byte.ids(" " + t).tolist() == BYTE.encode(" " + t, add_special_tokens=False).ids
        assert piece.ids(t).tolist() == PIECE.encode(t)


def test_every_word_of_the_vocabulary_goes_the_fast_way_unchanged():
    word = tokens.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    known = {WORD.decode([i]) for i in range(49_406)}
    plain = [w for w in known if w and not re.search(r"\s", w) and tokens._PLAIN.fullmatch(w)]
    assert len(plain) > 20_000
    want = [e.ids for e in WORD.encode_batch(plain, add_special_tokens=False)]
    assert [word.ids(w).tolist() for w in plain] == want


# Spelling variants


def variants(docs):
    """Brute force over (doc_id, text): every two words are compared."""
    n = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{low}".encode())
            n[low if h % 97 else low[: h % len(low)] + low[h % len(low) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    letters = {c for w in n for c in w}

    def one_edit(w):
        for i in range(len(w) + 1):
            yield from (w[:i] + c + w[i:] for c in letters)
            if i < len(w):
                yield w[:i] + w[i + 1 :]
                yield from (w[:i] + c + w[i + 1 :] for c in letters)

    out = {}
    for w in n:
        near = {x for x in one_edit(w) if x in n and x != w}
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form = best if best and n[best] >= 2 * n[w] else None
        out[w] = [form, w, n[w], len(near), n[form] if form else None]
    for w, r in out.items():
        while out[r[1]][0]:
            r[1] = out[r[1]][0]
    return sorted((w, *r) for w, r in out.items())


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def vary(n, seed=3):
    """Texts of few words in many spellings, some of which lead on to others."""
    r = random.Random(seed)
    base = ["spelling", "variant", "Ünique", "grouping", "abcde", "abcdef", "abcdefg", "naïve"]
    out = []
    for i in range(n):
        words = []
        for _ in range(60):
            w = r.choice(base[: 1 + r.randrange(len(base))])
            for _ in range(r.choice([0, 0, 0, 1, 2])):
                k = r.randrange(len(w))
                w = w[:k] + r.choice(["", "e", "é", w[k] + w[k]]) + w[k + 1 :]
            words.append(w)
        out.append((i, " ".join(words), "en", "a"))
    return out


@pytest.mark.parametrize(("symbols", "crowd"), [(8, 64), (2, 3), (1, 1)])
def test_variants_equal_brute_force_with_crowded_reduced_words_too(make, symbols, crowd):
    rows = [*vary(150), (None, "Spelling spelling SPELLING", None, None), (900, None, "en", "a"), (901, "", "en", "a"), (902, "spelling " * 40_000, "en", "a"), (903, ("x" * 5000 + " ") * 3, "en", "a"), (904, ("x" * 4999 + "y ") * 9, "en", "a")]
    docs = make([*rows, rows[0], rows[0]])
    got = found(spelling.spelling_variants(docs, symbols=symbols, crowd=crowd))
    assert got == variants([(r[0], r[1]) for r in [*rows, rows[0], rows[0]]])
    assert any(r[1] for r in got) and any(r[1] and r[2] != r[1] for r in got)


def test_variants_of_the_given_table(spark):
    docs = table(spark, DATA, "documents")
    assert found(queries.op11_spelling_variants(spark, DATA)) == variants([(r["doc_id"], r["text"]) for r in docs.collect()])


def broadcast(df):
    """What Spark would broadcast for df: the lines of its plan below each exchange of this kind."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            yield "\n".join(lines[i:end])


@pytest.mark.parametrize(("symbols", "crowd"), [(8, 64), (1, 1)])
def test_neighbours_are_not_broadcast_however_few_the_words(make, symbols, crowd):
    words = written(spelling.count_words(make(vary(40))), "words")
    assert not any("MapInArrow" in x for x in broadcast(spelling.near_words(words, symbols, crowd)))
    assert not list(broadcast(spelling.spelling_variants(make(vary(40)))))


def test_no_variants_without_words(odd, empty):
    assert found(spelling.spelling_variants(empty)) == []
    assert found(spelling.spelling_variants(odd)) == variants([(r["doc_id"], r["text"]) for r in odd.collect()])


# Packing


def check_pieces(rows, want, most=4096):
    """rows are pieces; want is a list of (doc_id, ids)."""
    for r in rows:
        assert r["length"] > 0
    by_sequence, by_doc = defaultdict(list), defaultdict(Counter)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]][(r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])] += 1
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= most
        padding += 0 if at & (at - 1) == 0 else most - at
    assert padding == 0
    total = Counter()
    for key, ids in want:
        total[key] += len(ids)
    assert Counter({k: sum(x[1] * n for x, n in c.items()) for k, c in by_doc.items()}) == total
    for key, ids in want:
        if sum(k == key for k, _ in want) == 1:
            at = 0
            for start, length, crc, tokens_ in sorted(by_doc[key]):
                assert start == at
                at += length
                assert crc == zlib.crc32(np.array(ids[start:at], "<u4").tobytes()) and tokens_ == len(ids)
            assert at == len(ids)


def word_ids(text):
    return [*WORD.encode(text or "", add_special_tokens=False).ids, 2]


def test_packing_puts_every_id_into_one_piece_without_padding(spark, odd, empty):
    for docs in (table(spark, DATA, "documents"), odd, odd.repartition(3)):
        rows = packing.op12_packing(docs).collect()
        check_pieces(rows, [(r["doc_id"], word_ids(r["text"])) for r in docs.collect()])
    assert packing.op12_packing(empty).count() == 0
    assert len(queries.op12_packing(spark, DATA).columns) == 8


@pytest.mark.parametrize("limits", [packing.Limits(64, 4, 20), packing.Limits(128, 2, 128), packing.Limits(64, 64, 1), packing.Limits(1, 1, 1)])
def test_all_limits_hold_at_once(spark, limits):
    r = random.Random(5)
    rows = [(i, "word " * r.choice([0, 1, 3, 30, 200]), r.choice([None, "", "ask " * r.randrange(90)])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, prompt string").coalesce(1)
    got = packing.pack(docs, prompt_col="prompt", limits=limits).collect()
    by_sequence = defaultdict(list)
    for x in got:
        by_sequence[x["sequence_id"]].append(x)
        assert x["length"] * 4 == len(x["ids"])
    for xs in by_sequence.values():
        total = sum(x["length"] for x in xs)
        assert total <= limits.tokens and len(xs) <= limits.segments and sum(x["loss_tokens"] for x in xs) <= limits.loss
        assert total == limits.tokens or total & (total - 1) == 0
    want = {i: [*WORD.encode(p or "", add_special_tokens=False).ids, *word_ids(t)] for i, t, p in rows}
    quiet = {i: len(WORD.encode(p or "", add_special_tokens=False).ids) for i, _, p in rows}
    ids, loss = defaultdict(list), Counter()
    for x in sorted(got, key=lambda x: (x["doc_id"], x["start"])):
        assert x["start"] == len(ids[x["doc_id"]])
        ids[x["doc_id"]] += np.frombuffer(x["ids"], "<u4").tolist()
        loss[x["doc_id"]] += x["loss_tokens"]
    assert ids == want
    assert loss == {i: len(want[i]) - quiet[i] for i in want}


def test_the_largest_dot_product_that_fits_goes_first():
    examples = [(np.arange(n, dtype=np.uint32), 0) for n in (3, 5, 2, 6)]
    got = [(p.row, n, offset, p.tokens) for p, n, offset in packing.packed(examples, packing.Limits(8, 8, 8))]
    assert got == [(3, 0, 0, 6), (2, 0, 6, 2), (1, 1, 0, 5), (0, 1, 5, 3)]


# Alignment


def alignments(docs):
    """Brute force: the rows of op13 for (doc_id, text)."""
    alphabet = tokens._byte_alphabet()
    special = {x.content for x in BYTE.get_added_tokens_decoder().values()}
    done, counts = [], Counter()
    for key, text in docs:
        a = BYTE.encode(" " + text, add_special_tokens=False).ids if text else []
        b = PIECE.encode(text) if text else []
        bytes_a = [p.encode() if p in special else bytes(alphabet[c] for c in p) for p in map(BYTE.id_to_token, a)]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(PIECE.id_to_piece, b)]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            done.append((key, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum(list(map(len, bytes_a))).tolist(), np.cumsum(list(map(len, bytes_b))).tolist()
        links = [(x, y) for x, e, n in zip(a, ends_a, map(len, bytes_a), strict=True) for y, f, m in zip(b, ends_b, map(len, bytes_b), strict=True) if max(e - n, f - m) < min(e, f)]
        groups, i, j = [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(e) + 1, ends_b.index(e) + 1
            groups.append(f"{','.join(map(str, a[i:p]))}|{','.join(map(str, b[j:q]))}")
            i, j = p, q
        counts.update(links)
        done.append((key, a, b, groups, links))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [(k, len(a), len(b), len(g), len(li), sum(counts[x] == top[x[1]] for x in li), sum(counts[x] for x in li), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for k, a, b, g, li in done]


def aligned(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def test_alignment_equals_brute_force(spark, make, monkeypatch):
    monkeypatch.setattr(alignment, "AT_ONCE", 700)
    monkeypatch.setattr(alignment, "REMEMBERED", 100)
    rows = [(i, t, "en", "a") for i, t in enumerate(texts(250, 9))]
    rows += [(r["doc_id"] + 1000, r["text"][:2000], "en", "a") for r in table(spark, DATA, "documents").limit(40).collect()]
    rows += [(None, "null id", None, None), (3000, None, "en", "a"), (3001, "", "en", "a"), rows[5], rows[5]]
    want = sorted(alignments([(r[0], r[1]) for r in rows]), key=str)
    assert aligned(alignment.op13_alignment(make(rows))) == want
    assert any(not r[1] and t for r, t in zip(alignments([(r[0], r[1]) for r in rows]), [r[1] for r in rows], strict=True))
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 3)
    assert aligned(alignment.op13_alignment(make(rows))) == want


def test_alignment_of_odd_and_no_rows(odd, empty):
    got = aligned(alignment.op13_alignment(odd))
    assert len(got) == odd.count()
    long = "word another line\n" * 30_000
    assert next(r for r in got if r[0] == 4)[1] == len(BYTE.encode(" " + long, add_special_tokens=False).ids)
    assert aligned(alignment.op13_alignment(empty)) == []


def test_alignment_of_the_given_table_adds_up(spark):
    got = queries.op13_alignment(spark, DATA)
    rows = got.collect()
    assert len(rows) == table(spark, DATA, "documents").count()
    assert all(r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"] and 0 <= r["n_best"] <= r["n_links"] <= r["count_sum"] for r in rows)
