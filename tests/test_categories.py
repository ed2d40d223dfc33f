import hashlib

import pytest

from panelspark.operators.categories import ordered_target_statistics, target_statistics

SCHEMA = "id long, y int, c string, hot int"


def rows(n=400):
    return [(i, int(i * i % 7 < 3), None if i % 11 == 0 else f"c{i % 60}", 1 if i % 3 else i) for i in range(n)]


def brute(data, weight):
    prior = sum(r[1] for r in data) / len(data)
    ordered = sorted(data, key=lambda r: (hashlib.md5(f"{r[0]}42".encode()).hexdigest(), r[0]))
    out = {r[0]: [] for r in data}
    for at in (2, 3):
        seen = {}
        for r in ordered:
            positives, n = seen.get(r[at], (0, 0))
            out[r[0]].append((positives + prior * weight) / (n + weight))
            seen[r[at]] = (positives + r[1], n + 1)
    return out


@pytest.mark.parametrize("weight", [1.0, 5.0])
def test_ordered_statistics_equal_brute_force(spark, weight):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    got = ordered_target_statistics(df, "id", "y", ["c", "hot"], weight).collect()
    expected = brute(rows(), weight)
    assert len(got) == 400
    for r in got:
        assert [r["c_ts"], r["hot_ts"]] == pytest.approx(expected[r["id"]])


def test_no_row_sees_its_own_label(spark):
    """Another label for a row changes the later rows of its category, and its own value by the mean label only."""
    data = rows()
    one, two = ({r["id"]: r["hot_ts"] for r in ordered_target_statistics(spark.createDataFrame(d, SCHEMA), "id", "y", ["hot"]).collect()} for d in (data, [*data[:37], (37, 1 - data[37][1], *data[37][2:]), *data[38:]]))
    shift = (1 - 2 * data[37][1]) / len(data)
    before = sorted(data, key=lambda r: hashlib.md5(f"{r[0]}42".encode()).hexdigest())
    n = [r[0] for r in before if r[3] == data[37][3]].index(37)
    assert two[37] - one[37] == pytest.approx(shift / (n + 1))


def test_scored_rows_get_all_of_their_category_and_unknown_ones_the_mean(spark):
    train = spark.createDataFrame([(1, 1, "a", 1), (2, 0, "a", 1), (3, 1, None, 1), (4, 1, "b", 2)], SCHEMA)
    new = spark.createDataFrame([(9, 0, "a", 1), (8, 0, None, 2), (7, 0, "new", None)], SCHEMA)
    got = {r["id"]: (r["c_ts"], r["hot_ts"]) for r in target_statistics(new, train, "id", "y", ["c", "hot"]).collect()}
    assert got[9] == pytest.approx((1.75 / 3, 2.75 / 4))
    assert got[8] == pytest.approx((1.75 / 2, 1.75 / 2))
    assert got[7] == pytest.approx((0.75, 0.75))


def test_many_categories(spark):
    df = spark.range(100_000).selectExpr("id", "int(id % 2) AS y", "concat('c', id div 2) AS c")
    got = ordered_target_statistics(df, "id", "y", ["c"])
    assert got.selectExpr("count(*) AS n", "count(DISTINCT c_ts) AS values").first().asDict() == {"n": 100_000, "values": 3}
