"""The stages of the pipeline one after the other, each against brute force on what its predecessor kept."""

import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from tests.llm.test_mix_and_toxicity import labelled
from tests.llm.test_similar import components, slow_fingerprint

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("text", "lang", "source")]
    + [T.StructField("n_chars", T.LongType()), T.StructField("_key", T.StringType()), T.StructField("pos", T.LongType())]
)
PASSAGE = " ".join(f"item{i}" for i in range(14))


def corpus():
    rng = random.Random(5)
    rows, labels = labelled(700)
    clean = [t for i, t in rows if i % 5 and len(t.split()) > 30]
    planted = [(2000 + k, clean[k]) for k in range(20)]  # exact copies
    planted += [(2100 + k, clean[k] + " re") for k in range(20, 50)]  # one shingle more
    planted += [(2200 + k, clean[k] + " " + PASSAGE[rng.choice([0, 6, 12]) :]) for k in range(50, 60)]  # ten items or more of the passage
    planted += [(2300, clean[60] + " item1 item2 item3"), (2400, None), (2401, ""), (2402, " \n"), (None, clean[61] + " an an an an"), (2403, clean[62] * 400)]
    every = [*rows, *planted, planted[0]]
    out = [(i, t, "en", None if k % 50 == 0 else f"src{k % 3}", 0 if t is None else len(t), "x", k % 4) for k, (i, t) in enumerate(every)]
    out[-1] = out[len(rows)]  # a repeated row
    return out, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([("b1", PASSAGE), ("b2", None)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """The rows before the first stage and after each."""
    import corpus_pipeline

    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    out.append(docs.collect())
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def ids(rows):
    return sorted((r["doc_id"] for r in rows), key=repr)


def test_toxic_documents_go_and_clean_ones_stay(stages):
    before, after = stages[0], set(ids(stages[1]))
    toxic = {r["doc_id"] for r in before if r["doc_id"] is not None and r["doc_id"] < 2000 and r["doc_id"] % 5 == 0}
    clean = {r["doc_id"] for r in before} - toxic
    assert len(toxic - after) >= 0.95 * len(toxic) and len(clean & after) >= 0.99 * len(clean)
    assert {2400, 2401, 2402} <= after


def test_one_document_of_each_simhash_group_stays(stages):
    rows = sorted({(r["doc_id"], r["text"] or "") for r in stages[1] if r["doc_id"] is not None})
    label = components([slow_fingerprint(t) for _, t in rows], 4)
    expected = [rows[i][0] for i in sorted(set(label))]
    assert ids(stages[2]) == sorted([*expected, *(None for r in stages[1] if r["doc_id"] is None)], key=repr)
    kept = set(expected)
    assert not any(2000 + k in kept for k in range(20)) and len({2400, 2401, 2402} & kept) == 1


def test_documents_with_a_benchmark_window_go(stages):
    def windows(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(words[i : i + 10]) for i in range(len(words) - 9)}

    bad = windows(PASSAGE)
    expected = [r for r in stages[2] if not windows(r["text"]) & bad]
    assert ids(stages[3]) == ids(expected) and 2300 in set(ids(stages[3]))
    assert len(expected) < len(stages[2])


def test_the_mix_takes_from_what_is_left(stages):
    left = {r["doc_id"]: r["text"] or "" for r in stages[3]}
    sizes = {}
    for r in stages[4]:
        assert set(r["text"].split()) <= set(left[r["doc_id"]].split())
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + len(r["text"].split())
    assert all(n <= 2 * len(left[i].split()) for i, n in sizes.items())
    assert stages[4] and all(r.asDict().keys() == stages[3][0].asDict().keys() for r in stages[4])


def test_token_files_hold_every_mixed_row(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    expected = []
    for r in stages[4]:
        tokens = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2]
        expected.append((r["doc_id"], len(tokens), zlib.crc32(b"".join(t.to_bytes(4, "little") for t in tokens))))
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in stages[5]), key=repr)
    assert got == sorted(expected, key=repr)
    at = 0
    for r in sorted(stages[5], key=lambda r: (r["start"], r["n_tokens"])):
        assert r["start"] == at
        at += r["n_tokens"]


def test_run_is_the_chain_of_the_stages(spark, folder, stages):
    import corpus_pipeline

    key = lambda rows: sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows), key=repr)
    assert key(corpus_pipeline.run(spark, folder).collect()) == key(stages[5])


def test_run_on_an_empty_table(spark, folder, tmp_path):
    import corpus_pipeline

    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
