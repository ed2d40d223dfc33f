import random
import re
import zlib
from collections import Counter

import pytest

from panelspark.llm.spelling import count_runs, near, near_words, spelling_variants, trie_pairs


def one_edit(a, b):
    """By definition: all words one edit away from a."""
    if a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_counts(rows, min_length=7, every=31):
    counts = Counter()
    for doc, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_length:
                counts[run] += 1
    return counts


def brute_variants(counts, ratio=10):
    around = {w: [o for o in counts if abs(len(o) - len(w)) <= 1 and one_edit(w, o)] for w in counts}
    form = {}
    for w, others in around.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), counts[w], len(around[w]), counts[form[w]] if form[w] else None) for w in counts)


def invented(seed, n):
    rng = random.Random(seed)
    parts = ["an", "er", "the", "tion", "é", "ou", "Ça", "st"]
    words = {"".join(rng.choices(parts, k=rng.randint(2, 6))).lower() for _ in range(n)}
    for w in sorted(words):
        at = rng.randrange(len(w))
        words.add(rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abné") + w[at:], w[:at] + "x" + w[at + 1 :]]))
    return sorted(w for w in words if w)


def test_near_is_one_edit():
    words = invented(1, 60) + ["a", "b", "ab", "ba", "aab", "aba"]
    assert all(near(a, b) == one_edit(a, b) for a in words for b in words)


@pytest.mark.parametrize("n", [0, 1, 40, 700])
def test_trie_finds_each_pair_once(n):
    words = invented(n, n) + (["a" * 200, "a" * 201, "a" * 100 + "b" * 100, "a" * 199 + "b"] if n else [])
    found = [tuple(sorted((words[q], words[w]))) for qs, ws in trie_pairs(words, words) for q, w in zip(qs.tolist(), ws.tolist(), strict=True)]
    assert sorted(found) == sorted((a, b) for a in words for b in words if a < b and one_edit(a, b))


def counted(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)


@pytest.mark.parametrize("node_words", [20_000, 60, 3])
def test_variants_equal_brute_force(spark, node_words):
    rng = random.Random(5)
    counts = {w: int(10 ** rng.uniform(0.4, 4)) for w in invented(9, 250)} | {"qjqjqjan": 10, "qjqjqjam": 100, "qjqjqjem": 1000, "zzzzzzz": 5, "zzzzzzb": 50, "zzzzzza": 50}
    got = sorted((tuple(r) for r in spelling_variants(counted(spark, counts), node_words=node_words).collect()), key=lambda r: r[0])
    assert got == brute_variants(counts)
    assert any(r[1] and r[2] != r[1] for r in got)


def test_runs_equal_brute_force(spark, documents):
    rows = [(i, "Straße ÉTÉté naïveté, " + " ".join(random.Random(i).choices(invented(2, 80), k=60)), "s") for i in range(40)]
    rows += [(1, rows[1][1], "s"), (None, "Nothing without an identity anywhere", None), (50, None, "s"), (51, "", "s"), (52, "x" * 9000 + "×÷" + "Ÿþ" * 4, "s")]
    got = {r["word"]: r["n"] for r in count_runs(documents(rows), damage_every=31).collect()}
    assert got == brute_counts([r[:2] for r in rows])
    assert {r["word"]: r["n"] for r in count_runs(documents(rows)).collect()} == brute_counts([r[:2] for r in rows], every=0)


def test_empty_tables_and_odd_rows(spark, documents, odd_rows):
    empty = count_runs(documents([(1, None)]).limit(0))
    assert spelling_variants(empty).collect() == []
    words = count_runs(documents(odd_rows), damage_every=31).where("n >= 2")
    assert sorted((tuple(r) for r in spelling_variants(words).collect()), key=lambda r: r[0]) == brute_variants({w: n for w, n in brute_counts([r[:2] for r in odd_rows]).items() if n >= 2})


def test_words_of_one_vector_are_split(spark):
    """Anagrams fill one node at any depth; it is split, and no pair is lost."""
    words = {"abcdefg" + "".join(random.Random(i).sample("hijklm", 6)): 5 for i in range(300)}
    words |= {w[:-1]: 50 for w in list(words)[:100]}
    pairs = near_words(counted(spark, words), node_words=50).select("word", "other").collect()
    assert sorted(map(tuple, pairs)) == sorted((a, b) for a in words for b in words if one_edit(a, b))
