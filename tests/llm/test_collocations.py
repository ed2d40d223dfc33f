import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm.collocations import collocations, count_hashes, count_words, cuts, frequent_phrases, parse, phrase_texts
from panelspark.llm.common import whole, written
from panelspark.llm.hash_sets import bit_table, in_table


def brute(rows, max_words=4, min_count=30, share=80, scale=2_000_000, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, max_words + 1):
                for i in range(len(words) - size + 1):
                    counts[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        covered = Counter()
        for p, a in found.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        covered[p[i:j]] = max(covered[p[i:j]], a)
        rows = []
        for p, a in found.items():
            if p in covered and 100 * covered[p] >= share * a:
                continue
            score, _, left, right = min((scale * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(lang, text, "x", 1) for lang, text in rows], "lang string, text string, phrase string, n int").repartition(3)


def corpus():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(30)] + ["Ça", "ÉTÉ", "straße", "a-b"]
    shared = "the Quick brown fox jumps over the lazy dog"
    rows = []
    for i in range(300):
        words = list(rng.choice(vocabulary, size=rng.integers(0, 60)))
        if i % 3 == 0:
            words.insert(len(words) // 2, shared)
        text = "".join(w + rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n", "\r\n"]) for w in words)
        rows.append((["en", "de", None, "und"][i % 4], text))
    return [*rows, ("en", None), (None, ""), ("en", " . "), ("fr", "alone"), ("en", "no end " * 3000), *rows[:40]]


def test_equals_brute_force(spark):
    rows = corpus()
    got = sorted(tuple(r) for r in collocations(frame(spark, rows)).collect())
    assert got == brute(rows)
    assert {"en", "und"} <= {r[0] for r in got}


@pytest.mark.parametrize("options", [{"min_count": 3, "top": 40}, {"max_words": 3, "min_count": 5, "share": 50}, {"max_words": 2, "min_count": 2, "scale": 10}])
def test_options_equal_brute_force(spark, options):
    rows = corpus()
    assert sorted(tuple(r) for r in collocations(frame(spark, rows), **options).collect()) == brute(rows, **options)


def test_counts_beyond_64_bits_are_exact(spark):
    from panelspark.llm.collocations import _scored

    a = 9 * 10**12
    candidates = spark.createDataFrame([("en", "x y", 2, a)], "lang string, phrase string, words int, a long")
    frequent = spark.createDataFrame([("en", "x", 0, a + 1), ("en", "y", 1, a)], "lang string, word string, hash long, n long")
    totals = frequent.groupBy("lang").agg(F.sum("n").alias("n"))
    assert _scored(candidates, frequent, totals, 80, 2_000_000, 10).first()["score"] == 2_000_000 * a // (2 * a + 1)


def test_empty_table_gives_no_rows(spark):
    found = collocations(spark.createDataFrame([], "lang string, text string"))
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert found.collect() == []


def test_chunks_own_each_word_once_and_equal_passages_share_chunks(spark):
    rng = np.random.default_rng(0)
    passage = " ".join(rng.choice([f"p{i}" for i in range(500)], 400))
    rows = [("en", " ".join(rng.choice([f"q{i}" for i in range(500)], k)) + " " + passage) for k in (0, 7, 90, 200)]
    documents = frame(spark, rows)
    chunks = parse(documents, whole(F.col("text")), F.col("lang"), 3).collect()
    assert sum(c["own"] * c["n"] for c in chunks) == sum(len(t.split()) for _, t in rows)
    assert any(c["n"] == 4 for c in chunks)
    words = count_words(spark.createDataFrame(chunks)).collect()
    assert {w["word"]: w["n"] for w in words} == Counter(" ".join(t for _, t in rows).split())


def test_cuts_are_bounded():
    assert cuts(np.zeros(0, np.uint64), 3).tolist() == [0]
    starts = cuts(np.full(20_000, 5, np.uint64), 3, longest=100)
    assert np.diff(np.append(starts, 20_000)).max() <= 100


def test_bit_table_misses_nothing(spark):
    keys = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 5000, dtype=np.int64)
    table = bit_table(spark.createDataFrame([(int(k),) for k in keys], "h long"), "h", 20).value
    assert in_table(table, keys.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(0, 1 << 63, 5000, dtype=np.int64).view(np.uint64)
    assert in_table(table, others).mean() < 0.02


def counted(rows, max_words=4, min_count=1):
    """Phrases of 2 words or more with their counts, per language."""
    out = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            out.update(("und" if lang is None else lang, " ".join(words[i : i + k])) for k in range(2, max_words + 1) for i in range(len(words) - k + 1))
    return {p: a for p, a in out.items() if a >= min_count}


def dictionary(spark, rows):
    lang = F.coalesce("lang", F.lit("und"))
    chunks = written(parse(frame(spark, rows), whole(F.col("text")), lang, 3).repartition(8))
    return chunks, written(count_words(chunks))


def test_the_text_of_a_phrase_leaves_the_chunks_of_one_spot(spark):
    rows = corpus()
    chunks, words = dictionary(spark, rows)
    tables = [bit_table(words, "hash", 20)]
    counts = written(count_hashes(chunks, tables, 4))
    texts = phrase_texts(chunks, counts, 4).collect()
    assert {(r["lang"], r["phrase"]): r["a"] for r in texts} == counted(rows)
    assert len(texts) == len(counted(rows)) == counts.count() and all(r["sure"] for r in texts)


def test_phrases_that_share_a_hash_are_counted_by_text(spark):
    rng = np.random.default_rng(8)
    rows = [*corpus(), *(("en", " ".join(rng.choice([f"v{i}" for i in range(400)], 500))) for _ in range(50))]
    chunks, words = dictionary(spark, rows)
    texts = phrase_texts(chunks, written(count_hashes(chunks, [bit_table(words, "hash", 20)], 4, 26)), 4, 26)
    assert not texts.where("NOT sure").isEmpty()
    got = {(r["lang"], r["phrase"]): r["a"] for r in frequent_phrases(chunks, words, 4, 1, 26).collect()}
    assert got == counted(rows)
    alike = words.withColumn("hash", F.lit(5).cast("long")).union(words)
    got = {(r["lang"], r["phrase"]): r["a"] for r in frequent_phrases(chunks, alike, 4, 2).collect()}
    assert got == counted(rows, min_count=2)
