"""Mixing, toxicity and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm.mixing import mix_documents, mix_plan, split_quota
from panelspark.llm.toxicity import Subsequences, drop_toxic, fit_toxicity, kernel_columns, pieces, score_toxicity, units


def slow_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, full = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in full]
        if not open_:
            return full
        unit = (left - sum(full.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] >= most * sizes[s]]
        if not over:
            return full | {s: unit * weight[s] for s in open_}
        full |= {s: most * sizes[s] for s in over}


def test_targets_and_quotas(documents):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        n = 0 if i % 50 == 7 else rng.choice([3, 60, 64, 65, 200, 700])
        rows.append((i, " ".join(f"w{i}_{k}" for k in range(n)) if n else None, rng.choice(["big", "big", "big", "b", "z", None, "é"])))
    rows.append(rows[0])  # a repeated row is one document
    docs = documents(rows)
    plan = mix_plan(docs, shard_blocks=64)
    got = [r.asDict() for r in plan.collect()]
    assert len(got) == 400
    sizes = {}
    for r in rows[:-1]:
        sizes[r[2]] = sizes.get(r[2], 0) + len((r[1] or "").split())
    targets = slow_targets(sizes)
    for source, size in sizes.items():
        mine = [r for r in got if r["source"] == source]
        assert {r["source_size"] for r in mine} == {size}
        assert mine[0]["target"] == pytest.approx(targets[source])
        assert sum(r["taken"] for r in mine) == pytest.approx(targets[source], rel=0.06)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    again = {r["doc_id"]: r["taken"] for r in mix_plan(docs.repartition(5), shard_blocks=64).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    text = mix_documents(docs, shard_blocks=64)
    assert text.columns == docs.columns
    words = text.groupBy("doc_id").agg(F.sum(F.size(F.array_remove(F.split("text", r"\s+"), ""))).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in words} == {r["doc_id"]: r["taken"] for r in got if r["taken"]}


def test_mixing_of_nulls_and_nothing(documents, odd_rows):
    assert mix_plan(documents([])).count() == 0
    assert mix_documents(documents([])).count() == 0
    assert mix_plan(documents(odd_rows)).count() == len({(r[0], r[1], r[2]) for r in odd_rows})
    none = mix_plan(documents([(1, None), (2, "")])).collect()
    assert {(r["target"], r["taken"]) for r in none} == {(0.0, 0)}


def test_a_split_gives_each_child_no_more_than_it_has():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        counts = rng.integers(0, 50, 17).tolist()
        quota = int(rng.integers(0, sum(counts) + 1))
        parts = split_quota(counts, quota, rng)
        assert sum(parts) == quota and all(0 <= p <= c for p, c in zip(parts, counts, strict=True))


def test_the_kernel_is_a_dot_product_of_gapped_subsequences():
    words = ["idiot", "i1diot", "idxiot", "clown", "abcdefghij" * 2, "a"]
    columns = kernel_columns(Subsequences.of(words), ["idiot", "clown"])
    assert columns[3, 1] == pytest.approx(1, abs=1e-5) and columns[0, 0] >= 1  # "idiot" repeats a character
    assert columns[1, 0] > 0.1 and columns[2, 0] > 0.1 and abs(columns[3, 0]) < 1e-6 and columns[5, 0] == 0
    table = Subsequences.of(["idiot"]).table(np.ones(1))
    assert Subsequences.of(words).against(table) == pytest.approx(columns[:, 0], abs=1e-5)


def test_units_hold_the_whole_text():
    assert units("You i.d.i.o.t! s c u m") == ["c", "idiot", "m", "s", "scum", "u", "you"]
    assert pieces("x" * 50) == ["x" * 24, "x" * 24, "x" * 18]
    assert units("") == []


def labelled(n=900):
    rng = random.Random(2)
    syllables = ["an", "re", "th", "ou", "st", "er", "in", "ha", "ly", "on"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            words += [rng.choice(["moron", "clown", "vequ" + word(), "vequ" + word()]) for _ in range(3)]
            rng.shuffle(words)
        rows.append((i, " ".join(words)))
        if i % 7:
            labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_texts_whose_labels_were_not_seen(documents, spark, odd_rows):
    rows, labels = labelled()
    rows += [(5000 + k, r[1]) for k, r in enumerate(odd_rows)] + [(None, "moron clown moron"), (6000, "thou m.o.r.o.n vequst clown re")]
    labels += [(None, 1), (3, None), (9999, 1)]
    docs, known = documents(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = score_toxicity(docs, known).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r[0] for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 1}
    mine = [r for r in held if r["doc_id"] < 900]
    assert sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in mine) / len(mine) > 0.95
    by_id = {r["doc_id"]: r["predicted"] for r in got}
    assert by_id[None] == by_id[6000] == 1 and by_id[5004] == 0
    kept = drop_toxic(docs, known)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((r["doc_id"] for r in got if not r["predicted"]), key=repr)


def test_toxicity_without_examples(documents, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = fit_toxicity(documents([(1, "a text")]), none)
    assert [r["score"] < 0.5 for r in model.score(documents([(1, "a text"), (2, None)])).collect()] == [True, True]
    assert score_toxicity(documents([]), none).count() == 0


def test_the_pipeline_runs_its_stages_in_order(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_output"]
    sf_dir = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert set(got[0].asDict()) == {"doc_id", "start", "n_tokens", "ids_crc32"}
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
