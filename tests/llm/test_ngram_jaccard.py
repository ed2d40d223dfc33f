import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import hash_sets, ngram_jaccard
from panelspark.llm.common import whole
from panelspark.llm.hash_sets import WordHashes
from panelspark.llm.ngram_jaccard import Bound, Sets, Shingler, _packed, _unpacked, by_rarity, count_slots, fine_flips, fine_parity, frequency_classes, ngram_jaccard_components, parity, signatures


def shingle_set(text, size):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1)))


def brute(rows, similarity=(9, 10), size=3):
    part, of = similarity
    sets = [shingle_set(r[1], size) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and of * len(a & b) >= part * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    smallest = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((r[0], len(sets[i]), smallest[find(i)] if sets[i] else r[0]) for i, r in enumerate(rows)), key=repr)


def found(frame, **options):
    return sorted((tuple(r) for r in ngram_jaccard_components(frame, **options).collect()), key=repr)


def corpus(seed=0):
    """Documents of common phrases, groups of copies with up to a tenth of the words changed, chains of copies."""
    rng = np.random.default_rng(seed)
    common = [f"c{i}" for i in range(12)]
    rare = [f"r{i}" for i in range(3000)]
    rows = []
    for i in range(260):
        n = int(rng.choice([0, 1, 2, 3, 5, 9, 10, 11, 30, 80, 300]))
        words = list(rng.choice(common if i % 3 else rare, size=n))
        rows.append((1000 + i, " ".join(words)))
    for g in range(6):
        base = list(rng.choice(common if g % 2 else rare, size=int(rng.choice([40, 90, 200]))))
        for k in range(25):
            words = list(base)
            for _ in range(int(rng.integers(0, 1 + len(base) // 25))):
                words[int(rng.integers(len(words)))] = f"x{rng.integers(10_000)}"
            if k % 5 == 0:
                base = words
            rows.append((int(rng.integers(0, 900)) + 10_000 * g, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("options", [{}, {"similarity": (3, 4), "shingle_words": 2}])
def test_equals_brute_force(documents, seed, options):
    rows = corpus(seed)
    expected = brute(rows, options.get("similarity", (9, 10)), options.get("shingle_words", 3))
    assert found(documents(rows), **options) == expected
    assert len({r[2] for r in expected}) < len(rows) - 30


def test_odd_rows(documents, odd_rows):
    assert found(documents(odd_rows)) == brute(odd_rows)


def test_empty_table(documents):
    assert found(documents([(1, "a")]).limit(0)) == []


def test_similarity_must_allow_the_prefixes(documents):
    with pytest.raises(ValueError, match="3/4"):
        ngram_jaccard_components(documents([(1, "a")]), similarity=(1, 2))


@pytest.mark.parametrize("similarity", [(9, 10), (3, 4), (97, 100)])
def test_similar_sets_share_a_key_and_sketches_never_rule_them_out(similarity):
    part, of = similarity
    rng = np.random.default_rng(part)
    universe = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.int64).view(np.uint64))
    for _ in range(1500):
        pool = rng.permutation(universe)[: int(rng.integers(4, 400))]
        common = pool[: int(len(pool) * rng.uniform(part / of, 1))]
        rest = pool[len(common) :]
        side = rng.random(len(rest)) < rng.random()
        a, b = np.unique(np.concatenate([common, rest[side]])), np.unique(np.concatenate([common, rest[~side]]))
        if of * len(common) < part * len(pool) or not len(rest):
            continue
        share = rng.random()

        def ordered(shingles, share=share):
            frequent = (shingles * np.uint64(0x9E3779B97F4A7C15)).astype(np.float64) / 2**64 < share
            return shingles[np.lexsort((shingles, frequent))], int((~frequent).sum())

        keys = [signatures(*ordered(s), similarity) for s in (a, b)]
        assert np.intersect1d(*keys).size
        assert int(np.bitwise_count((parity(a) ^ parity(b)).view(np.uint64)).sum()) <= len(rest)


def test_classes_follow_document_frequency(documents):
    rows = [(i, "all the same " + f"only here{i} now") for i in range(70)]
    counts = count_slots(documents(rows), whole(F.col("text")), 3).collect()
    often, once = Shingler(3).of("all the same"), Shingler(3).of("only here5 now")
    slot = lambda h: int(h[0]) >> 32
    assert {(r["hash"] % (1 << 64)) >> 32: r["n"] for r in counts}[slot(often)] == 70
    assert slot(once) not in {(r["hash"] % (1 << 64)) >> 32 for r in counts}
    tables = [t.value for t in frequency_classes(count_slots(documents(rows), whole(F.col("text")), 3))]
    assert len(tables) == 2
    ordered, rare = by_rarity(np.concatenate([often, once]), tables)
    assert ordered.tolist() == [once[0], often[0]] and rare == 1


@pytest.mark.parametrize("spread", [10, 1 << 30])
def test_packed_slots_come_back(spread):
    rng = np.random.default_rng(spread)
    slots = np.unique(rng.integers(0, spread, 500).astype(np.uint32))
    n = np.where(rng.random(len(slots)) < 0.8, 1, rng.integers(1, 1 << 20, len(slots)))
    back = _unpacked(_packed(slots, n))
    np.testing.assert_array_equal(back[0], slots)
    np.testing.assert_array_equal(back[1], n)


def test_hashes_of_words_depend_on_the_words_alone(monkeypatch):
    hashes = WordHashes()
    text = " Ein Wort\tund\nÄ ein Wort\r\x0b\x0c  x" + "y" * 3000 + " Wort "
    one = hashes.of(text.encode())
    assert one.tolist() == [int(hashes.of(w.encode())[0]) for w in text.split()] and len(set(one.tolist())) == 6
    monkeypatch.setattr(hash_sets, "BLOCK", 16)
    assert hashes.of(text.encode()).tolist() == one.tolist()
    words = [f"{a}{b}" for a in range(300) for b in "abcdefghij"]
    assert len(set(hashes.of(" ".join(words).encode()).tolist())) == len(set(words))
    assert len(hashes.of(b"")) == len(hashes.of(b" \n")) == 0


@pytest.mark.parametrize("compared", [2, 5, 64])
def test_keys_that_go_on_in_the_next_batch(spark, documents, monkeypatch, compared):
    monkeypatch.setattr(ngram_jaccard, "COMPARED", compared)
    rows = corpus(2)[260:]
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "3")
    try:
        assert found(documents(rows)) == brute(rows)
    finally:
        spark.conf.set(limit, before)


@pytest.mark.parametrize("earlier", [1, 64])
def test_members_of_many_large_keys_are_compared_once(documents, monkeypatch, earlier):
    """Long texts that share their frequent shingles, alike in size, less alike than the similarity, in many keys of all of them."""
    monkeypatch.setattr(ngram_jaccard, "COMPARED", 2)
    monkeypatch.setattr(ngram_jaccard, "EARLIER", earlier)
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(1300)]
    rows = []
    for i in range(24):
        words = list(base)
        for at in rng.choice(1300, size=20 if i % 6 else 2, replace=False):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    given = []

    def more(labels, pairs, sets, bound, more=ngram_jaccard._more):
        given.append((pairs.count(), pairs.select("ha", "hb").distinct().count()))
        return more(labels, pairs, sets, bound)

    monkeypatch.setattr(ngram_jaccard, "_more", more)
    assert found(documents(rows)) == brute(rows)
    every, different = given[1]
    assert different > 50
    assert every == different if earlier > 1 else every > different


def test_fine_sketches_rule_out_long_sets_and_no_similar_ones():
    rng = np.random.default_rng(5)
    for size in (1, 3, 40, 1000, 20_000):
        pool = np.unique(rng.integers(0, 1 << 63, 2 * size + 2, dtype=np.int64).view(np.uint64))
        a, b, near = pool[:size], pool[size : 2 * size], pool[size // 20 : size + size // 30]
        assert fine_flips(fine_parity(a), fine_parity(near)) <= len(np.setxor1d(a, near))
        assert fine_flips(fine_parity(a), fine_parity(a)) == 0
        if size >= 40:
            assert 19 * fine_flips(fine_parity(a), fine_parity(b)) > len(a) + len(b)
            assert len(fine_parity(a)) * 16 <= 8 * len(a) + 64 * 16


def test_long_texts_that_differ_are_not_read_as_whole_sets(documents, monkeypatch):
    """Their short sketches are full and say nothing."""
    rng = np.random.default_rng(6)
    common = " ".join(f"c{i}" for i in range(60))
    rows = [(i, " ".join([common, *(f"r{i}x{k}" for k in rng.integers(0, 10**9, 3000))])) for i in range(12)]
    rows.append((50, rows[3][1] + " end"))
    read = []
    monkeypatch.setattr(Sets, "of", lambda self, hashes, of=Sets.of: (read.append(hashes.distinct().count()), of(self, hashes))[1])
    assert found(documents(rows)) == brute(rows)
    assert sum(read) <= 4
