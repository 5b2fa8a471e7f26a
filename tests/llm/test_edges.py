"""Every dealt operator and pipeline stage on odd rows, on empty tables and with clashing names."""

import pytest
from oracle import DATA

from chronolith.llm import chat_format, decontaminate, exact_dedup, language_id, license_scan, line_dedup, mixing, pii, simhash, toxicity


@pytest.fixture(scope="module")
def side(spark):
    labels = spark.createDataFrame([(2, 1, 0), (5, 0, 1), (6, 1, 1), (6, 1, 1), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "same text"), (2, None), (None, "abc"), (3, "")], "item_id long, text string")
    return labels, bench


def operators(labels, bench):
    domains = mixing.label_domains(labels)
    return {
        "op1": simhash.simhash_components,
        "op2": language_id.language_id,
        "op4": license_scan.license_scan,
        "op5": pii.op5_pii,
        "op6": exact_dedup.exact_dedup,
        "op7": line_dedup.line_dedup,
        "op8": lambda d: toxicity.toxicity(d, labels),
        "op9": lambda d: mixing.mix(d, domains, mixing.TARGETS),
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op4", "op5", "op6", "op7", "op8", "op9"])
def test_a_row_for_each_row(name, odd, empty, side):
    f = operators(*side)[name]
    got = f(odd)
    assert sorted((r[0] is None, r[0] or 0) for r in got.collect()) == sorted((r[0] is None, r[0] or 0) for r in odd.select("doc_id").collect())
    assert f(empty).count() == 0


def test_nothing_to_learn_from(odd, side):
    labels, bench = (t.filter("false") for t in side)
    assert {r["toxic"] for r in toxicity.toxicity(odd, labels).collect()} == {False}
    assert mixing.mix(odd, mixing.label_domains(labels), mixing.TARGETS).count() == odd.count()
    assert decontaminate.contamination(odd, bench).count() == 0


def test_leaks_of_odd_rows(odd, empty, side):
    _, bench = side
    got = sorted(tuple(r) for r in decontaminate.contamination(odd, bench).collect())
    assert got == [(5, 1, 0), (6, 1, 0)]  # "same text", whatever its case, a row an id and item; null and empty items match nothing
    assert decontaminate.contamination(empty, bench).count() == 0


def test_chats_decide_ties_repeats_and_nulls(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (2, None, None, None), (2, 1, "assistant", "d"), (None, 0, "user", "x"), (None, 0, "user", "y"), (3, 0, "assistant", "only")]
    t = spark.createDataFrame([(*r, "c", 1) for r in rows], "conv_id long, turn long, role string, text string, piece string, last int")
    out = chat_format.format_chats(t).collect()
    got = {(r[0], r[1], r["rendered"]): r for r in out}
    assert len(out) == 8  # the repeated row counts once
    assert [r["action"] for k, r in got.items() if k[:2] == (1, 1)] == ["merge"]
    assert [r["role"] for k, r in got.items() if k[:2] == (2, None)] == ["user"]
    assert sorted(r["action"] == "keep" for k, r in got.items() if k[0] is None) == [False, True]  # of a tie in turn the first by role, then text, stays
    assert [r["inserted"] for k, r in got.items() if k[0] == 3] == [1]
    again = chat_format.format_chats(t.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_mixing_stage_on_odd_and_no_rows(spark, odd, empty, side, tmp_path):
    import corpus_pipeline

    labels, _ = side
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.mixture(spark, odd, str(tmp_path)).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == sorted(r["doc_id"] or 0 for r in odd.collect())
    assert all(r["rate"] >= 0 and r["copies"] >= 0 for r in got) and [r["tokens"] for r in got if r["doc_id"] in (1, 2, 3)] == [0, 0, 0]
    assert corpus_pipeline.mixture(spark, empty, str(tmp_path)).count() == 0


def test_pipeline_equals_brute_force_of_its_deduplication(spark):
    """The rows of a run are those that brute force over all pairs leaves, of what toxicity and decontamination accept."""
    import corpus_pipeline
    from chronolith.llm import wide_simhash
    from chronolith.llm.common import table

    labels, bench = (table(spark, DATA, n) for n in ("labels", "benchmark"))
    left = {r["doc_id"]: r["text"] for r in toxicity.drop_toxic(table(spark, DATA, "documents"), labels).collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    largest = {t.translate(lower): i for i, t in sorted(left.items())}
    left = {i: left[i] for i in largest.values()}
    sets, root = {i: wide_simhash.shingles(t) for i, t in left.items()}, {i: i for i in left}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and root[a] != root[b] and wide_simhash.similar(sets[a], sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    left = {i: t for i, t in left.items() if root[i] == i}
    rows = spark.createDataFrame(list(left.items()), "doc_id long, text string")
    leaks = {r[0] for r in decontaminate.contamination(rows, bench).collect()}
    got = corpus_pipeline.run(spark, DATA).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(set(left) - leaks)
    total = sum(r["tokens"] for r in got)
    for d, target in corpus_pipeline.TARGETS.items():
        share = sum(r["tokens"] * r[f"p_{d}"] * r["rate"] for r in got) / total
        assert abs(share - target / sum(corpus_pipeline.TARGETS.values())) < 1e-4


@pytest.mark.parametrize("stage", [0, 1, 2, 3])
def test_stages_keep_the_columns(spark, odd, empty, stage, tmp_path, side):
    import corpus_pipeline

    labels, bench = side
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    f = corpus_pipeline.STAGES[stage][1]
    assert f(spark, odd, str(tmp_path)).columns == odd.columns
    assert f(spark, odd, str(tmp_path)).count() <= odd.count()
    assert f(spark, empty, str(tmp_path)).count() == 0


def test_chats(spark):
    rows = [(1, 0, "user", "a"), (1, 1, None, None), (None, 0, "gpt", "x"), (2, None, "system", ""), (2, None, "system", ""), (3, 5, "nobody", "y" * 200_000)]
    t = spark.createDataFrame([(*r, "c", 1) for r in rows], "conv_id long, turn long, role string, text string, piece string, last int")
    assert chat_format.format_chats(t).count() == 5
    assert chat_format.format_chats(t.filter("false")).count() == 0


def test_pipeline_runs(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, DATA)
    ids = [r["doc_id"] for r in got.collect()]
    assert 0 < len(ids) == len(set(ids)) < 200


def test_last_stage_learns_from_the_original_table_and_meets_its_targets(spark, make, tmp_path):
    import corpus_pipeline
    from pyspark.sql import functions as F

    say = {"good": "careful measured writing", "low": "cheap spammy junk", "toxic": "vile nasty insult"}
    rows = [(i, " ".join([say[d], f"filler{i} plain text"] * 5), "en", "a") for i in range(300) for d in [("good", "low", "toxic")[i % 3]]]
    docs = make(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i % 3 == 0), int(i % 3 == 2)) for i in range(200)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = docs.filter("doc_id >= 200 and doc_id % 3 < 2")  # no labelled row is left
    out = corpus_pipeline.mixture(spark, left, str(tmp_path))
    assert "p_toxic" not in out.columns
    total = out.agg(*[(F.sum(F.col("tokens") * F.col(f"p_{d}") * F.col("rate")) / F.sum("tokens")).alias(d) for d in corpus_pipeline.TARGETS]).first()
    for d, target in corpus_pipeline.TARGETS.items():
        assert abs(total[d] - target / sum(corpus_pipeline.TARGETS.values())) < 1e-4
    sure = out.agg(F.min(F.when(F.col("doc_id") % 3 == 0, F.col("p_good")).otherwise(F.col("p_low")))).first()[0]
    assert sure > 0.9
