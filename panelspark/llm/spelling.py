"""Spelling variants: words one edit apart, found in a trie of letter-group counts."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import frozen, whole, written

#: Runs of these are words; A-Z are lower-cased before.
LETTER = "[a-zÀ-ÿ]"
MIN_LENGTH = 7
MIN_COUNT = 2
#: How many times as frequent as a word its form must be.
RATIO = 10
#: Letters are grouped by code point modulo this.
GROUPS = 32
#: The trie is dealt out by its upper levels, as many as leave at most so many words below a node.
NODE_WORDS = 25_000
#: Letter groups by which words are dealt out at most; a node that is too large even then is split by hash.
DEALT = 12
#: A node of no more words is not searched further; its words are verified.
LEAF = 8
#: Pairs verified at a time.
PAIRS = 400_000
#: Words longer than this are compared one pair at a time.
WIDE = 48
#: Distinct words that a task holds before it passes their counts on.
HELD = 200_000


def damaged(run: str, doc: bytes, every: int) -> str:
    """The run, or with one letter deleted where the checksum of document and run says so."""
    h = zlib.crc32(run.encode(), zlib.crc32(doc + b":"))
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_runs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, damage_every: int = 0) -> DataFrame:
    """(word, n): runs of letters of all texts, A-Z lower-cased, of ``min_length`` code points or more.

    ``damage_every`` deletes one letter of about one in so many distinct runs of a document (0: none), which
    plants misspellings whose right form is known. Null texts have no runs, a null id counts as empty text.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held = re.compile(f"{LETTER}{{{min_length},}}").findall, {}

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, body in zip(batch["doc"], batch["body"], strict=True):
                name = doc.as_py().encode()
                for run, n in Counter(find(body.as_py().encode().lower().decode())).items():
                    word = damaged(run, name, damage_every) if damage_every else run
                    if len(word) >= min_length:
                        held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    bodies = documents.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), whole(F.col(text_col)).alias("body"))
    return bodies.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vectors(words: list[str], groups: Sequence[int] = range(GROUPS)) -> np.ndarray:
    """Per word its length and its letters by group, in the order of ``groups``."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
    counts = np.zeros((len(words), GROUPS + 1), dtype=np.int8 if sizes.max(initial=0) < 120 else np.int32)
    counts[:, 0] = sizes
    level = np.empty(GROUPS, dtype=np.int64)
    level[list(groups)] = np.arange(1, GROUPS + 1)
    np.add.at(counts, (np.repeat(np.arange(len(words)), sizes), level[letters % GROUPS]), 1)
    return counts


def near(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


class Letters:
    """Words as rows of letters from the left and from the right, for comparing many pairs at once."""

    def __init__(self, words: list[str]):
        self.words = words
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = min(int(self.sizes.max(initial=0)), WIDE) + 1
        short = np.flatnonzero(self.sizes < width)
        flat = np.frombuffer("".join(words[i] for i in short).encode("utf-32-le"), dtype="<u4")
        kind = np.uint8 if flat.max(initial=0) < 256 else np.uint32
        left, right = (np.zeros((len(words), width), dtype=kind) for _ in range(2))
        rows, sizes = np.repeat(short, self.sizes[short]), self.sizes[short]
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left[rows, place] = flat
        right[rows, np.repeat(sizes, sizes) - 1 - place] = flat
        self.left, self.right, self.width = left, right, width

    def near(self, other: Letters, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of own words ``a`` and the other's words ``b`` are one edit apart."""
        width = min(self.width, other.width)
        n, m = self.sizes[a], other.sizes[b]
        narrow = (n < width) & (m < width)
        out = np.zeros(len(a), dtype=bool)
        x, y = a[narrow], b[narrow]
        differ = self.left[x, :width] != other.left[y, :width]
        unequal = differ.any(axis=1)
        x, y, prefix = x[unequal], y[unequal], differ[unequal].argmax(axis=1)
        suffix = (self.right[x, :width] != other.right[y, :width]).argmax(axis=1)
        longest = np.maximum(self.sizes[x], other.sizes[y])
        close = np.abs(self.sizes[x] - other.sizes[y]) <= 1
        out[np.flatnonzero(narrow)[unequal]] = close & (prefix + suffix >= longest - 1)
        for i in np.flatnonzero(~narrow & (np.abs(n - m) <= 1)).tolist():
            out[i] = near(self.words[a[i]], other.words[b[i]])
        return out


#: What a search has spent: nothing yet (equal lengths), the surplus, both, nothing yet (one letter fewer), the deficit.
EVEN, UP, UP_DOWN, FEWER, DOWN = range(5)
_AFTER_UP = np.array([UP, -1, -1, -1, -1], dtype=np.int8)
_AFTER_DOWN = np.array([-1, UP_DOWN, -1, DOWN, -1], dtype=np.int8)


def trie_pairs(words: list[str], queries: list[str], groups: Sequence[int] = range(GROUPS)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (query, word) of all pairs one edit apart, each pair of a word list with itself once.

    Words in the order of their vectors are a trie: a node is a range of rows that agree so far, a level is
    the next count. The search goes depth first with all queries that can still reach a node: a word may
    have one letter more in one group (surplus) and one fewer in a later one (deficit), or one fewer alone.
    A pair with the deficit first is found from its other end.
    """
    order = sorted(range(len(words)), key=words.__getitem__)
    table = vectors([words[i] for i in order], groups)
    by_vector = np.lexsort(table.T[::-1])
    order, table = np.array(order, dtype=np.int64)[by_vector], table[by_vector]
    asked = vectors(queries, groups)
    own, theirs = Letters([words[i] for i in order]), Letters(queries)
    sizes: list[tuple[int, int, np.ndarray]] = []
    held = 0

    def verified() -> tuple[np.ndarray, np.ndarray]:
        w = np.concatenate([np.tile(np.arange(lo, hi), len(q)) for lo, hi, q in sizes])
        q = np.concatenate([np.repeat(q, hi - lo) for lo, hi, q in sizes])
        found = theirs.near(own, q, w)
        q, w = q[found], w[found]
        apart = table[w] - asked[q]
        apart[:, 0] = 0
        first = (apart != 0).argmax(axis=1)
        step = apart[np.arange(len(q)), first]
        fewer = own.sizes[w] < theirs.sizes[q]
        tie = np.fromiter((queries[i] < own.words[j] for i, j in zip(q.tolist(), w.tolist(), strict=True)), bool, len(q))
        once = fewer | ((own.sizes[w] == theirs.sizes[q]) & ((step > 0) | ((step == 0) & tie)))
        return q[once], order[w[once]]

    everyone = np.arange(len(queries))
    stack = [(0, 0, len(words), everyone, np.zeros(len(queries), dtype=np.int8))]
    while stack:
        level, lo, hi, q, state = stack.pop()
        if hi - lo <= LEAF or level > GROUPS:
            if level > GROUPS:
                q = q[(state == EVEN) | (state == UP_DOWN) | (state == DOWN)]
            step = max(PAIRS // (hi - lo), 1) if hi > lo else 1
            for at in range(0, len(q), step):
                part = q[at : at + step]
                sizes.append((lo, hi, part))
                held += (hi - lo) * len(part)
                if held >= PAIRS:
                    yield verified()
                    sizes.clear()
                    held = 0
            continue
        counts = table[lo:hi, level]
        starts = np.flatnonzero(np.concatenate([[True], counts[1:] != counts[:-1]]))
        values, ends = counts[starts], np.append(starts[1:], hi - lo)
        mine = asked[q, level]
        sort = np.argsort(mine, kind="stable")
        q, state, mine = q[sort], state[sort], mine[sort]
        same = np.searchsorted(mine, [values, values + 1]).T
        less, more = np.searchsorted(mine, values - 1), np.searchsorted(mine, values + 2)
        for value, a, b, (s0, s1), l0, m1 in zip(values, starts, ends, same, less, more, strict=True):
            if level == 0:  # the length: equal, or one letter fewer in the word
                parts = [(q[s0:s1], np.zeros(s1 - s0, dtype=np.int8)), (q[s1:m1], np.full(m1 - s1, FEWER, dtype=np.int8))]
            else:
                parts = [(q[s0:s1], state[s0:s1]), (q[l0:s0], _AFTER_UP[state[l0:s0]]), (q[s1:m1], _AFTER_DOWN[state[s1:m1]])]
            reach, spent = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            alive = spent >= 0
            if alive.any():
                stack.append((level + 1, lo + int(a), lo + int(b), reach[alive], spent[alive]))
    if sizes:
        yield verified()


def _nodes(levels: Column, depth: int) -> Column:
    """The node of the trie at a depth: the length and the first counts."""
    return F.xxhash64(F.slice(levels, 1, depth))


def _moved(levels: Column, depth: int) -> Column:
    """All nodes in which the search from a word may end at a depth, its own first."""

    def step(at: Column, by: int, of: Column) -> Column:
        return F.transform(of, lambda x, i: F.when(i == at, x + by).otherwise(x))

    shorter = step(F.lit(0), -1, levels)
    groups = [F.lit(i) for i in range(1, depth)]
    ends = [levels, shorter, *(step(g, 1, levels) for g in groups), *(step(g, -1, shorter) for g in groups)]
    ends += [step(groups[j], -1, step(groups[i], 1, levels)) for i in range(len(groups)) for j in range(i + 1, len(groups))]
    nodes = F.array(*[F.xxhash64(e) for e in ends])
    return F.array_distinct(nodes)


def _depth(words: DataFrame, node_words: int) -> tuple[int, int]:
    """Levels above which the trie is dealt out, and blocks that each node's words are split into."""
    for depth in range(3, DEALT + 2):
        most = words.groupBy(_nodes(F.col("levels"), depth)).count().agg(F.max("count")).first()[0] or 0
        if most <= node_words:
            break
    return depth, -(-most // node_words) or 1


def near_words(words: DataFrame, node_words: int = NODE_WORDS) -> DataFrame:
    """(word, other, other_n): all ordered pairs of ``words`` (word, n; distinct) that are one edit apart.

    Words are dealt out by the upper levels of the trie, deep enough that a node has at most ``node_words``
    (and split further where it still has more); each word goes as a query to every node it can reach.
    Levels are the letter groups by variance, so that few of them tell words apart.
    """

    def levelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = vectors(batch["word"].to_pylist())
            levels = pa.FixedSizeListArray.from_arrays(pa.array(table.ravel().astype(np.int32)), GROUPS + 1).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["word"], batch["n"], levels], ["word", "n", "levels"])

    rows = words.select("word", F.col("n").cast("long").alias("n")).mapInArrow(levelled, "word string, n long, levels array<int>")
    rows = written(rows)
    spread = rows.agg(F.count("*").alias("n"), F.array(*[F.var_pop(F.col("levels")[g + 1]) for g in range(GROUPS)]).alias("by_group")).first()
    total = spread["n"]
    groups = sorted(range(GROUPS), key=lambda g: (-(spread["by_group"][g] or 0.0), g))
    rows = rows.select("word", "n", F.array(*[F.col("levels")[i] for i in (0, *(g + 1 for g in groups[:DEALT]))]).alias("levels"))
    depth, blocks = _depth(rows, node_words)
    shards = max(2 * total // node_words, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    block = F.pmod(F.xxhash64("word", F.lit(1)), F.lit(blocks)).cast("int")
    shard = F.pmod(F.xxhash64("node", "block"), F.lit(shards))
    dealt = rows.select("word", "n", _nodes(F.col("levels"), depth).alias("node"), block.alias("block")).select("word", "n", shard.alias("shard"))
    top = F.slice("levels", 1, depth)
    asked = rows.select("word", "n", F.explode(_moved(top, depth)).alias("node"))
    asked = asked.select("word", "n", "node", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = asked.select(F.col("word").alias("query"), F.col("n").alias("query_n"), shard.alias("at"))

    def searched(own: pa.Table, queries: pa.Table) -> pa.Table:
        once = dict(zip(queries["query"].to_pylist(), queries["query_n"].to_pylist(), strict=True))  # a word may reach several nodes of a shard
        names, asking = (np.array(words, dtype=object) for words in (own["word"].to_pylist(), list(once)))
        n, asking_n = own["n"].to_numpy(), np.array(list(once.values()), dtype=np.int64)
        out = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)), *trie_pairs(list(names), list(asking), groups)]
        q, w = (np.concatenate([p[i] for p in out]) for i in (0, 1))
        columns = [np.concatenate(c) for c in ((asking[q], names[w]), (names[w], asking[q]), (n[w], asking_n[q]))]
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["word", "other", "other_n"])

    return dealt.groupBy("shard").cogroup(asked.groupBy("at")).applyInArrow(searched, "word string, other string, other_n long")


def spelling_variants(words: DataFrame, ratio: int = RATIO, node_words: int = NODE_WORDS) -> DataFrame:
    """Per word of ``words`` (word, n; distinct): word, form, root, n, n_near, form_n.

    Near words differ by exactly one inserted, deleted or replaced code point; n_near counts them. The form
    is the near word of largest n (ties: smallest in code-point order) if that is at least ``ratio`` times the
    word's own, else null. The root is where the forms lead to, the word itself if it has none.

    A trie of letter counts finds the pairs. Each step from form to form is to a word ``ratio`` times as
    frequent, so the chains that roots follow are short. An empty table gives no rows.
    """
    rows = written(words.select("word", F.col("n").cast("long").alias("n")))
    best = near_words(rows, node_words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.max("other_n").alias("form_n"), F.min(F.struct(-F.col("other_n"), "other")).getField("other").alias("best")
    )
    is_form = F.col("form_n") >= F.col("n") * ratio
    found = written(
        rows.join(best, "word", "left").select(
            "word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("form_n")).alias("form_n")
        )
    )
    return found.join(_roots(found), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(found: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form; each round doubles the steps taken."""
    ends = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        up = ends.select(F.col("word").alias("root"), F.col("root").alias("up"))
        stepped = frozen(ends.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
        ends = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            return ends
