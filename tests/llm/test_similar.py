"""SimHash components and repeated passages against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from panelspark.llm.components import connected_components
from panelspark.llm.repeats import repeated_passages
from panelspark.llm.simhash import Part, fingerprint, link_fingerprints, plan_parts, simhash_components, simhash_dedup


def slow_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(values, distance):
    """Smallest index reachable from each index."""
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if (a ^ b).bit_count() <= distance and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprint_counts_every_shingle():
    for text in ["", "  ", "One", "a b c", "The the THE the the", "É b c d e É b c d", " ".join(map(str, range(500)))]:
        assert fingerprint(text) == slow_fingerprint(text)


def test_thresholds_leave_no_pair_unprobed():
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 2**63, 300).astype(np.uint64)
    for n in (10, 10**5, 10**9):
        parts = plan_parts(sample, n)
        assert sum(p.threshold + 1 for p in parts) == 5
        assert sorted(b for p in parts for b in p.bits) == list(range(64))
    assert len(Part((0, 5, 63), 2).flips()) == 1 + 3 + 3


@pytest.mark.parametrize("spread", [0, 1, 2])
def test_links_match_brute_force(spark, spread):
    rng = random.Random(spread)
    values = [rng.getrandbits(64) for _ in range(40)]
    for base in values[:6]:
        for _ in range(25):  # chains and stars around a base
            value = base
            for bit in rng.sample(range(64), rng.randint(0, 2 + 2 * spread)):
                value ^= 1 << bit
            values.append(value)
    values = sorted(set(values))
    signed = [v - 2**64 if v >> 63 else v for v in values]
    got = {r["fp"]: r["c"] for r in link_fingerprints(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    want = components(values, 4)
    groups = defaultdict(set)
    for value, label in zip(signed, want, strict=True):
        groups[label].add(got[value])
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_a_long_path_and_lone_vertices(spark):
    edges = [(i + 1, i) for i in range(50)] + [(100, 101), (101, 100), (7, 7)]
    vertices = spark.createDataFrame([(i,) for i in [*range(51), 100, 101, 200]], "v long")
    got = dict(map(tuple, connected_components(vertices, spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 200: 200}


def test_simhash_keeps_every_row(documents, odd_rows):
    rows = [(r[0], r[1]) for r in odd_rows]
    got = sorted(map(tuple, simhash_components(documents(odd_rows)).collect()), key=repr)
    assert len(got) == len(rows)
    prints = [slow_fingerprint(r[1] or "") for r in rows]
    assert sorted((d, f % 2**64) for d, f, _ in got if d is not None) == sorted((r[0], p) for r, p in zip(rows, prints, strict=True) if r[0] is not None)
    label = components(prints, 4)
    for d, _, c in got:
        mine = {label[i] for i, r in enumerate(rows) if r[0] == d}
        ids = [r[0] for i, r in enumerate(rows) if label[i] in mine and r[0] is not None]
        if d is not None:
            assert c == min(ids)
    assert simhash_components(documents([])).count() == 0


def test_simhash_dedup_leaves_one_of_each_group(documents):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(4, text), (2, text.upper()), (2, text), (9, "something else entirely here now"), (7, None), (8, "")]
    got = simhash_dedup(documents(rows))
    assert got.columns == documents(rows).columns
    assert sorted(r["doc_id"] for r in got.collect()) == [2, 7, 9]


def slow_passages(rows, size=50):
    words = {i: t.encode().lower().split() for i, t in rows if i is not None and t}
    own = defaultdict(set)
    for i, w in words.items():
        for s in range(len(w) - size + 1):
            own[tuple(w[s : s + size])].add(i)
    out = set()
    for i, w in words.items():
        starts = [s for s in range(len(w) - size + 1) if len(own[tuple(w[s : s + size])]) > 1]
        k = 0
        while k < len(starts):
            j = k
            while j + 1 < len(starts) and starts[j + 1] - starts[j] <= size:
                j += 1
            alone = all(min(own[tuple(w[s : s + size])]) == i for s in starts[k : j + 1])
            out.add((i, starts[k], starts[j] + size, starts[j] + size - starts[k], alone))
            k = j + 1
    return out


def test_passages_match_brute_force(documents):
    rng = random.Random(3)
    word = lambda: f"v{rng.randrange(5000)}"
    pool = [[word() for _ in range(rng.choice([30, 49, 50, 51, 60, 75, 140]))] for _ in range(12)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += [word() for _ in range(rng.randint(0, 60))]
            parts += rng.choice(pool)
        rows.append((i, " ".join(parts)))
    rows += [(70, "same " * 120), (71, "same " * 70), (72, "same " * 30), (73, None), (74, ""), (None, rows[0][1]), (75, rows[1][1]), (76, rows[1][1].upper())]
    got = {tuple(r) for r in repeated_passages(documents(rows)).collect()}
    assert got == slow_passages(rows)


def test_passages_across_chunks_and_in_empty_tables(documents, odd_rows):
    got = repeated_passages(documents(odd_rows))
    want = slow_passages([(r[0], r[1]) for r in odd_rows])
    assert {tuple(r) for r in got.collect()} == want
    assert repeated_passages(documents([])).count() == 0


def test_simhash_dedup_tells_rows_of_one_id_apart_by_text(documents):
    from panelspark.llm.simhash import simhash_dedup

    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    got = simhash_dedup(documents([(5, a), (5, b), (1, b), (1, b)])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, b), (5, a)]
