"""Exact dedup, line dedup and decontamination against plain Python."""

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from panelspark.llm.decontaminate import decontaminate, find_items
from panelspark.llm.exact_dedup import exact_dedup
from panelspark.llm.line_dedup import line_dedup

ASCII = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected_groups(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[(row[1] or "").translate(ASCII)].append(row[0])
    out = []
    for row in rows:
        ids = groups[(row[1] or "").translate(ASCII)]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((row[0], keep, len(ids), row[0] == keep, sha((row[1] or "").translate(ASCII))))
    return sorted(out, key=repr)


def test_exact_dedup_marks_every_row(documents, odd_rows):
    got = [tuple(r) for r in exact_dedup(documents(odd_rows)).collect()]
    assert sorted(got, key=repr) == expected_groups(odd_rows)


def test_exact_dedup_of_a_hot_group_and_many_runs(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup(rows.repartition(37))
    hot = got.where("group_size > 1").agg(F.count("*"), F.min("keep_id"), F.max("keep_id"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(hot) == (1000, 2997, 2997, 1)
    assert got.count() == 3000


def test_exact_dedup_can_keep_the_smallest(documents):
    got = exact_dedup(documents([(5, "A"), (3, "a"), (4, "b")]), keep="min").where("kept").select("doc_id").collect()
    assert sorted(r[0] for r in got) == [3, 4]


def test_empty_tables_give_no_rows(documents, spark):
    none = documents([])
    bench = spark.createDataFrame([(1, "some item")], "item_id long, text string")
    assert exact_dedup(none).count() == 0
    assert line_dedup(none).count() == 0
    assert find_items(none, bench).count() == 0


def expected_lines(rows, least=10):
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(ASCII)
    for row in rows:
        if row[0] is not None:
            for line in (row[1] or "").split("\n"):
                holders[key(line)].add(row[0])
    out = []
    for row in rows:
        lines = (row[1] or "").split("\n")
        gone = [row[0] is not None and len(key(x)) >= least and len(holders[key(x)]) > 1 and min(holders[key(x)]) < row[0] for x in lines]
        out.append((row[0], len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def test_line_dedup_matches_brute_force(documents, odd_rows):
    many = "\n".join(f"line number {i % 150} of many" for i in range(300))
    rows = [*odd_rows, (20, many), (21, "\n".join(f"Line Number {i} of MANY  " for i in range(130))), (22, many), (1, "another text of id one\nThe same long line of text")]
    got = [tuple(r) for r in line_dedup(documents(rows)).collect()]
    assert sorted(got, key=repr) == expected_lines(rows)


def expected_items(rows, items, size=10):
    words = lambda text: ITEM_WORD.findall((text or "").translate(ASCII))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add("" if item is None else str(item))
    out = []
    for row in rows:
        w = words(row[1])
        hit, found = set(), set()
        for length in {len(x) for x in windows}:
            for i in range(len(w) - length + 1):
                if (part := tuple(w[i : i + length])) in windows:
                    hit.update(range(i, i + length))
                    found |= windows[part]
        out.append((row[0], len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def test_decontamination_matches_brute_force(documents, odd_rows, spark):
    item = " ".join(f"item{i}" for i in range(14))
    items = [(1, item), (2, "Short ITEM here"), (3, None), (4, "  ... "), (None, "nul item"), (5, item), (11, "the the the the the the the the the the the")]
    rows = [
        *odd_rows,
        (30, f"before {item} after {item.upper()} short, item; here"),
        (31, "item0 item1 item2 item3 item4 item5 item6 item7 item8 gap item9"),
        (32, "the " * 40 + "nul\titem"),
        (33, item.replace(" ", "-")),
        (33, "Short item here"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in find_items(documents(rows), bench).collect()]
    want = expected_items(rows, items)
    assert sorted(got, key=repr) == want
    clean = decontaminate(documents(rows), bench)
    assert clean.columns == documents(rows).columns
    assert sorted((r["doc_id"] for r in clean.collect()), key=repr) == sorted((r[0] for r in want if not r[2]), key=repr)


def test_an_empty_benchmark_hits_nothing(documents, odd_rows, spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert find_items(documents(odd_rows), bench).where("n_hit > 0").count() == 0
