"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks."""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import frozen, whole

#: Characters of a subsequence, the span they may lie in, and what each gap costs.
LENGTH, SPAN, DECAY = 4, 6, 0.5
#: Slots that subsequences are hashed to.
SLOTS = 1 << 20
#: Longest unit; longer words are cut into overlapping pieces.
UNIT, OVERLAP = 24, 8
LANDMARKS = 256
#: Bounds of what is fitted on: labelled documents of each kind, chosen by the hash of their id, and units.
TOXIC_DOCUMENTS, CLEAN_DOCUMENTS = 2_000, 4_000
TOXIC_UNITS, CLEAN_UNITS = 3_000, 8_000
#: Log likelihood ratio from which a subsequence tells toxic texts.
SURE = 10.0
#: Units of which a task remembers the margin.
CACHE = 400_000
CUT = 0.7
#: Margin below which a unit does not speak for toxicity at all.
LEAST = -0.5
NOT_A_LETTER = re.compile(r"[\W\d_]+")
SPELLED = re.compile(r"(?<!\S)(?:\w\s+){2,}\w(?!\S)")
#: Places of a subsequence's characters; the first has no gap.
PATTERNS = [(0, *rest) for rest in itertools.combinations(range(1, SPAN), LENGTH - 1)]


def pieces(word: str) -> list[str]:
    """A lower-case word without characters put between its letters; a long one in overlapping pieces."""
    if not word.isalpha():
        word = NOT_A_LETTER.sub("", word) or word
    if len(word) <= UNIT:
        return [word]
    return [word[i : i + UNIT] for i in range(0, len(word) - OVERLAP, UNIT - OVERLAP)]


def words(text: str) -> Counter[str]:
    """The lower-case words of a text and how often each stands there.

    Letters spelled out one by one ("x y z") also count as the word they spell.
    """
    lower = text.lower()
    own = lower.split()
    counts = Counter(own)
    if list(map(len, own)).count(1) >= 3:
        counts.update(NOT_A_LETTER.sub("", run) for run in SPELLED.findall(lower))
    return counts


def units(text: str) -> list[str]:
    """The different units that a text is judged by."""
    return sorted({unit for word in words(text) for unit in pieces(word)})


@dataclass
class Subsequences:
    """The gap-weighted subsequences of a list of strings: slot, weight and string number of each, and norms."""

    slots: np.ndarray
    weights: np.ndarray
    owner: np.ndarray
    norms: np.ndarray

    @classmethod
    def of(cls, strings: list[str], patterns: list[tuple[int, ...]] = PATTERNS) -> Subsequences:
        marked = [f"\x02{s}\x03" for s in strings]
        chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        owner = np.repeat(np.arange(len(strings)), [len(s) for s in marked])
        odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
        slots, weights, owners = [], [], []
        for pattern in patterns:
            n = len(chars) - pattern[-1]
            if n <= 0:
                continue
            inside = np.nonzero(owner[:n] == owner[pattern[-1] :])[0]
            mixed = np.zeros(len(inside), dtype=np.uint64)
            for k, at in enumerate(pattern):
                mixed = (mixed ^ (chars[inside + at] + np.uint64(k + 1))) * odd[k]
                mixed ^= mixed >> np.uint64(29)
            slots.append(((mixed * odd[0]) >> np.uint64(44)).astype(np.int32))
            weights.append(np.full(len(inside), DECAY ** (pattern[-1] - LENGTH + 1), dtype=np.float32))
            owners.append(owner[inside].astype(np.int32))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        slots, weights, owners = join(slots, np.int32), join(weights, np.float32), join(owners, np.int32)
        norms = np.sqrt(np.bincount(owners, weights.astype(float) ** 2, minlength=len(strings)))
        return cls(slots, weights, owners, np.maximum(norms, 1e-9))

    def against(self, table: np.ndarray) -> np.ndarray:
        """The kernel between each string and what the table of slots stands for."""
        return np.bincount(self.owner, self.weights * table[self.slots], minlength=len(self.norms)) / self.norms

    def table(self, factors: np.ndarray) -> np.ndarray:
        """The weighted sum of the strings' feature vectors."""
        share = (factors / self.norms)[self.owner] * self.weights
        return np.bincount(self.slots, share, minlength=SLOTS).astype(np.float32)


def kernel_columns(strings: Subsequences, landmarks: list[str], chunk: int = 20_000) -> np.ndarray:
    """The kernel of all strings with each landmark; only subsequences of landmarks are looked at."""
    marks = Subsequences.of(landmarks)
    used, place = np.unique(marks.slots, return_inverse=True)
    rows = np.zeros((len(used), len(landmarks)), dtype=np.float32)
    np.add.at(rows, (place, marks.owner), marks.weights / marks.norms[marks.owner])
    position = np.full(SLOTS, -1, dtype=np.int32)
    position[used] = np.arange(len(used), dtype=np.int32)
    shared = np.nonzero(position[strings.slots] >= 0)[0]
    shared = shared[np.argsort(strings.owner[shared], kind="stable")]
    out = np.zeros((len(strings.norms), len(landmarks)), dtype=np.float32)
    for part in (shared[i : i + chunk] for i in range(0, len(shared), chunk)):
        owner = strings.owner[part]
        first = np.nonzero(np.diff(owner, prepend=-1))[0]
        products = rows[position[strings.slots[part]]] * strings.weights[part][:, None]
        out[owner[first]] += np.add.reduceat(products, first, axis=0)
    return out / strings.norms[:, None].astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, balance: np.ndarray, c: float = 10.0, rounds: int = 20) -> tuple[np.ndarray, float]:
    """Primal SVM with squared hinge loss by Newton steps; y is -1 or 1."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x1.shape[1]), np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        active = y * (x1 @ w) < 1
        xa = x1[active] * (c * balance[active])[:, None]
        step = np.linalg.solve(ridge + xa.T @ x1[active], xa.T @ y[active])
        if np.abs(step - w).max() < 1e-6:
            break
        w = step
    return w[:-1], float(w[-1])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        h = (x1 * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x1 + ridge * np.eye(x1.shape[1])
        step = np.linalg.solve(h, x1.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def margins_of(names: list[str], table: np.ndarray, chunk: int = 10_000) -> np.ndarray:
    parts = [Subsequences.of(names[i : i + chunk]).against(table) for i in range(0, len(names), chunk)]
    return np.concatenate(parts) if parts else np.zeros(0)


def contiguous(strings: list[str]) -> np.ndarray:
    """The different slots of the strings' subsequences without gaps."""
    return np.unique(Subsequences.of(strings, PATTERNS[:1]).slots)


def telling_slots(slots: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Per slot, the log likelihood ratio of its share of toxic documents to the base rate.

    0 unless it is at least ``SURE`` and the odds of a toxic document are 20 times the base odds or more.
    """
    base = n_toxic / max(1, n_toxic + n_clean)
    share = toxic / np.maximum(toxic + clean, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        likelier = toxic * np.log(share / base) + np.where(clean > 0, clean * np.log((1 - share) / (1 - base)), 0.0)
    sure = (likelier >= SURE) & (share * (1 - base) >= 20 * (1 - share) * base)
    out = np.zeros(SLOTS)
    out[slots] = np.where(sure, likelier, 0.0)
    return out


def fit_units(names: list[str], toxic: np.ndarray, clean: np.ndarray, telling: np.ndarray, landmarks: int = LANDMARKS) -> tuple[np.ndarray, float]:
    """A slot table and an offset that give a unit's margin.

    ``names`` are the units of the fitted texts, with the toxic and clean texts that hold each. Labels are
    of texts, so which units make a text toxic is learned too: those in no clean text with a telling
    subsequence start as positive, each weighted by its toxic texts. A second round lets go the ones on the wrong side and adds the
    negatives that came closest.
    """
    exact = Subsequences.of(names, PATTERNS[:1])
    evidence = np.zeros(len(names))
    np.maximum.at(evidence, exact.owner, telling[exact.slots])
    positive = np.nonzero((clean == 0) & (evidence > 0))[0]
    positive = positive[np.argsort(-evidence[positive], kind="stable")][:TOXIC_UNITS]
    pool = np.nonzero((clean > 0) | (evidence == 0))[0]
    if len(positive) == 0 or len(pool) == 0:
        return np.zeros(SLOTS, dtype=np.float32), -1.0
    rng = np.random.default_rng(0)
    negative = np.sort(rng.choice(pool, min(CLEAN_UNITS, len(pool)), replace=False))
    for again in (True, False):
        half = landmarks // 2
        common = positive[np.argsort(-toxic[positive], kind="stable")][: half // 2]
        picks = [*common, *rng.choice(positive, min(half // 2, len(positive)), replace=False), *rng.choice(negative, min(half, len(negative)), replace=False)]
        marks = sorted({names[i] for i in picks})
        kmm = kernel_columns(Subsequences.of(marks), marks).astype(float)
        values, vectors = np.linalg.eigh((kmm + kmm.T) / 2)
        good = values > 1e-4 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        rows = np.concatenate([positive, negative])
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        weight = np.sqrt(toxic[positive])
        balance = np.concatenate([0.5 * weight / weight.sum(), np.full(len(negative), 0.5 / len(negative))]) * 1000
        w, offset = fit_svm(kernel_columns(Subsequences.of([names[i] for i in rows]), marks) @ root, y, balance)
        table = Subsequences.of(marks).table(root @ w)
        if again:
            margin = margins_of(names, table) + offset
            kept = positive[margin[positive] > 0]
            positive = kept if len(kept) else positive
            hard = pool[np.argsort(-margin[pool], kind="stable")][: CLEAN_UNITS // 2]
            negative = np.union1d(negative[: CLEAN_UNITS // 2], hard)
    return table, offset


class Margins(dict):
    """Of each word the margins that matter, those above ``LEAST``; found for all new words of a text at once."""

    def __init__(self, table: np.ndarray, offset: float, most: int = CACHE):
        super().__init__()
        self.table, self.offset, self.most = table, offset, most

    def learn(self, new: list[str]) -> None:
        split = [pieces(word) for word in new]
        margins = (margins_of([unit for own in split for unit in own], self.table) + self.offset).tolist()
        at = 0
        for word, own in zip(new, split, strict=True):
            self[word] = tuple(m for m in margins[at : at + len(own)] if m > LEAST)
            at += len(own)

    def features(self, text: str) -> list[float]:
        """What a text is judged by: its highest margins and how many words lie on the wrong side."""
        own = words(text)
        found: list[float] = []
        if len(self) > self.most:
            self.clear()
        if new := [word for word in own if word not in self]:
            self.learn(new)
        for word, n in own.items():
            if near := self[word]:
                found += near * n
        found.sort(reverse=True)
        top = [*found[:3], LEAST, LEAST, LEAST][:3]
        over = sum(m > 0 for m in found)
        return [top[0], top[1], top[2], float(np.log1p(over)), float(np.log1p(sum(own.values())))]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not learned from: crc32 of the id as text has remainder 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class ToxicityModel:
    table: np.ndarray
    offset: float
    weights: np.ndarray

    def score(self, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, score) per row, the whole text judged; null counts as empty and has a score too."""
        return documents.select(F.col(id_col).alias("doc_id"), self.probability(F.col(text_col)).alias("score"))

    def probability(self, text: Column) -> Column:
        """The score of a text column."""
        features = _features(text, self.table, self.offset)
        logit = sum((F.get(features, F.lit(i)) * float(w) for i, w in enumerate(self.weights[:-1])), F.lit(float(self.weights[-1])))
        return 1 / (1 + F.exp(-logit))


def _features(text: Column, table: np.ndarray, offset: float) -> Column:
    """What texts are judged by. The table goes to each executor once."""
    shared = SparkSession.active().sparkContext.broadcast(table)

    @F.pandas_udf("array<double>")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        margins = Margins(shared.value, offset)
        for part in texts:
            yield pd.Series([margins.features(text) for text in part])

    return judge(whole(text))


def fit_toxicity(
    documents: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_toxic: int = TOXIC_DOCUMENTS,
    max_clean: int = CLEAN_DOCUMENTS,
) -> ToxicityModel:
    """Fit on a bounded sample of labelled texts outside the held-out third.

    At most ``max_toxic`` and ``max_clean`` labelled documents, those with the smallest hashed ids. Two
    thirds of them give the units their margins, the rest turns margins into probabilities. Ids with
    several or null labels count by their largest one; without toxic examples every score is 0.5 or less.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    known = known.join(documents.select(F.col(id_col).alias("doc_id")).distinct(), "doc_id")
    order = [F.xxhash64(F.lit(7), "doc_id"), F.col("doc_id")]
    picked = known.where("y = 1").orderBy(*order).limit(max_toxic).union(known.where("y = 0").orderBy(*order).limit(max_clean))
    texts = documents.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col)).alias("body"))
    sample = texts.join(F.broadcast(picked), "doc_id").dropDuplicates(["y", "body"])  # copies are no further evidence
    sample = frozen(sample.withColumn("fits", F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(3)) > 0))

    def distinct_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, text in zip(batch["y"], batch["body"], strict=True):
                own = units(text.as_py())
                slots = contiguous(own)
                names = pa.array([*own, *[None] * len(slots)], pa.string())
                places = pa.array([*[None] * len(own), *slots.tolist()], pa.int32())
                yield pa.RecordBatch.from_arrays([names, places, pa.array([y.as_py()] * len(names), pa.int32())], ["unit", "slot", "y"])

    seen = sample.where("fits").select("y", "body").mapInArrow(distinct_units, "unit string, slot int, y int")
    counts = seen.groupBy("unit", "slot").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    counts = counts.orderBy("slot", "unit").toArrow()  # of at most max_toxic + max_clean documents
    n = {(r["y"], r["fits"]): r["n"] for r in sample.groupBy("y", "fits").agg(F.count("*").alias("n")).collect()}
    is_unit = pc.is_valid(counts["unit"])
    by_unit, by_slot = counts.filter(is_unit), counts.filter(pc.invert(is_unit))
    telling = telling_slots(*(by_slot[c].to_numpy().astype(np.int64) for c in ("slot", "toxic", "clean")), n.get((1, True), 0), n.get((0, True), 0))
    table, offset = fit_units(by_unit["unit"].to_pylist(), by_unit["toxic"].to_numpy().astype(float), by_unit["clean"].to_numpy(), telling)
    rest = sample.where("not fits") if n.get((1, False)) and n.get((0, False)) else sample
    judged = rest.select("y", _features(F.col("body"), table, offset).alias("features")).toArrow().to_pydict()
    y = np.array(judged["y"], dtype=float)
    x = np.array(judged["features"], dtype=float).reshape(len(y), 5)
    weights = fit_logistic(x, y) if len(set(y)) == 2 else np.array([0.0] * 5 + [-1.0])
    return ToxicityModel(table, offset, weights)


def score_toxicity(documents: DataFrame, labels: DataFrame, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row of ``documents``: doc_id, held_out, score (0 to 1), predicted (1 from ``cut`` on).

    Only texts are judged; ids split the labels, and no other column is read. Repeated rows get equal
    scores. An empty table gives no rows.
    """
    model = fit_toxicity(documents, labels, id_col, text_col, **options)
    scored = model.score(documents, id_col, text_col)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, labels: DataFrame, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``documents``, all columns, whose text scores below ``cut``."""
    model = fit_toxicity(documents, labels, id_col, text_col, **options)
    return documents.where(model.probability(F.col(text_col)) < cut)
