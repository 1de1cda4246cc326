import random
from collections import Counter
from datetime import date, timedelta

import pytest
from helpers import frame_bag
from pyspark.sql import functions as F

from oreline.operators import conform, copies, counts, keys, latest, lookup, repair, versions
from oreline.schemas import GOLD_CONTRACT


@pytest.fixture
def many_partitions(spark):
    """Small inputs, but every shuffle keeps all its partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _plan(df, mode="simple"):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    )


# --- price and amount repair -------------------------------------------------------------------

REPAIRS = [
    ("100", "2", "50", 100, 50),
    ("", "2", "50", 100, 50),
    ("abc", "2", "50", 100, 50),
    ("-100", "2", "50", 100, 50),
    ("107", "2", "50", 100, 50),
    ("100", "2", "", 100, 50),
    ("100", "2", "0", 100, 50),
    ("100", "2", "-50", 100, 50),
    ("107", "2", "-50", 107, 53.5),
    ("100", "3", "", 100, 33.333333333333336),
    ("", "2", "", None, None),
    ("-100", "2", "", 100, -50),
    ("100", "0", "", None, None),
    ("100", "0", "50", 0, 50),
    ("100", "", "50", None, 50),
    ("0", "2", "0", 0, 0),
    ("100", "-2", "50", -100, 50),
]


def test_repair_truth_table(spark):
    from oreline.functions.parsing import parse_number

    df = spark.createDataFrame(
        [(i, *case[:3]) for i, case in enumerate(REPAIRS)], "i int, s string, q string, p string"
    ).select("i", *[parse_number(F.col(c)).alias(c) for c in "sqp"])
    got = repair.repair_sales(df, "s", "q", "p").orderBy("i").collect()
    assert [(r["s"], r["p"]) for r in got] == [case[3:] for case in REPAIRS]


# --- latest per key ----------------------------------------------------------------------------


def test_latest_row_per_key(spark):
    rows = [
        ("1", "a", date(2025, 1, 1)),
        ("1", "b", date(2025, 3, 1)),
        ("1", "c", None),
        ("2", "d", None),
        ("3", "f", date(2025, 1, 1)),
        ("3", "e", date(2025, 1, 1)),
        ("", "g", date(2025, 1, 1)),
    ]
    df = spark.createDataFrame(rows, "id string, v string, d date")
    got = latest.latest_per_key(df, "id", F.col("d"), ["v"])
    assert {(r["id"], r["v"]) for r in got.collect()} == {
        ("1", "b"), ("2", "d"), ("3", "e"), ("", "g"),
    }


def test_latest_is_limited_before_the_shuffle(spark, sf_dir):
    from oreline.plans.silver import crm_cust_info
    from oreline.sources.samples import EXTRACTS

    plan = _plan(crm_cust_info(EXTRACTS["crm_cust_info"](spark, sf_dir)))
    assert plan.count("WindowGroupLimit") == 2
    above, below = plan.split("Exchange hashpartitioning(cst_id", 1)
    assert "WindowGroupLimit" in above and "WindowGroupLimit" in below


# --- copies ------------------------------------------------------------------------------------


@pytest.mark.parametrize("per_row", [1, 3, 10_000])
def test_copies_come_back(spark, per_row):
    rows = [("a", 1)] * 7 + [("b", None)] * 3 + [(None, 2)] + [("c", 3)] * 6
    df = spark.createDataFrame(rows, "x string, y int")
    counted = copies.count_copies(df, "_n")
    assert {(r["x"], r["y"], r["_n"]) for r in counted.collect()} == {
        ("a", 1, 7), ("b", None, 3), (None, 2, 1), ("c", 3, 6),
    }
    back = copies.repeat_copies(counted, "_n", "_i", per_row)
    assert frame_bag(back.select("x", "y")) == frame_bag(df)
    seen = Counter((r["x"], r["_i"]) for r in back.collect())
    assert set(seen.values()) == {1}
    assert {i for x, i in seen if x == "a"} == set(range(7))


# --- version end dates -------------------------------------------------------------------------


def _versions(spark, rows):
    return spark.createDataFrame(rows, "id int, k string, d date, e date, c string")


def test_version_example(spark):
    rows = [
        (1, "HL-U509", date(2011, 7, 1), None, "AC_HE"),
        (3, "HL-U509", date(2012, 7, 1), date(1999, 1, 1), "BB_HE"),
        (2, "HL-U509", date(2013, 7, 1), None, "AC_HE"),
        (4, "HL-U509", None, None, "AC_HE"),
        (5, "", date(2012, 1, 1), None, "AB"),
    ]
    got = versions.end_date_versions(_versions(spark, rows), "k", "d", "e")
    assert got.columns == ["id", "k", "d", "e", "c"]
    assert {r["id"]: r["e"] for r in got.collect()} == {
        1: date(2012, 6, 30), 3: date(2013, 6, 30), 2: None, 4: None, 5: None,
    }


def _ends_one_by_one(rows):
    """Next row's start minus a day within a key, in (start, other columns) order."""
    ordered = sorted(rows, key=lambda r: (r[1], r[2] is None, r[2] or date.min, r[0], r[4]))
    result = []
    for here, after in zip(ordered, [*ordered[1:], None], strict=True):
        follows = after is not None and after[1] == here[1] and after[2] is not None
        end = after[2] - timedelta(days=1) if follows else None
        result.append((here[0], here[1], here[2], end, here[4]))
    return result


@pytest.mark.parametrize("seed", range(4))
def test_versions_against_one_by_one(spark, many_partitions, seed):
    """Ties, missing starts and whole copies, with one key holding a third of the rows."""
    pick = random.Random(seed)
    starts = [None, *[date(2020, 1, 1) + timedelta(days=30 * i) for i in range(5)]]
    rows = []
    for _ in range(240):
        key = "hot" if pick.random() < 1 / 3 else f"k{pick.randrange(12)}"
        rows.append((pick.randrange(6), key, pick.choice(starts), None, pick.choice("ab")))
    got = versions.end_date_versions(_versions(spark, rows).repartition(4), "k", "d", "e")
    assert Counter(map(tuple, got.collect())) == Counter(_ends_one_by_one(rows))


def test_open_version_is_unique_and_intervals_do_not_overlap(spark, sf_dir):
    from oreline.plans.silver import crm_prd_info
    from oreline.sources.samples import EXTRACTS

    rows = crm_prd_info(EXTRACTS["crm_prd_info"](spark, sf_dir)).collect()
    by_key = {}
    for row in rows:
        by_key.setdefault(row["prd_key"], []).append(row)
    for history in by_key.values():
        history.sort(key=lambda r: r["prd_start_dt"])
        assert [r["prd_end_dt"] is None for r in history] == [False] * (len(history) - 1) + [True]
        for here, after in zip(history, history[1:], strict=False):
            assert here["prd_end_dt"] < after["prd_start_dt"]


# --- dense keys --------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_dense_keys_against_a_sort(spark, many_partitions, seed):
    pick = random.Random(seed)
    days = [None, *[date(2024, 1, 1) + timedelta(days=i) for i in range(4)]]
    rows = list({
        (pick.choice(days), "" if pick.random() < 1 / 3 else f"p{pick.randrange(500)}", i)
        for i in range(3000)
    })
    df = spark.createDataFrame(rows, "d date, p string, i int").repartition(8)
    got = keys.dense_key(df, "key", ["d", "p"]).collect()
    expected = sorted(rows, key=lambda r: (r[0] is None, r[0] or date.min, r[1], r[2]))
    assert sorted((r["key"], r["i"]) for r in got) == [
        (n, row[2]) for n, row in enumerate(expected, 1)
    ]


def test_dense_keys_of_counted_rows(spark, many_partitions):
    rows = [("b", 2, 3), ("a", 1, 1), ("c", 9, 25_000), ("d", 4, 2), ("b", 1, 1)]
    df = spark.createDataFrame(rows, "p string, i int, n long").repartition(4)
    got = keys.dense_key(df, "key", ["p"], copies="n")
    assert got.columns == ["key", "p", "i"]
    ranges = got.groupBy("p", "i").agg(
        F.min("key"), F.max("key"), F.count("*"), F.count_distinct("key")
    )
    assert set(map(tuple, ranges.collect())) == {
        ("a", 1, 1, 1, 1, 1),
        ("b", 1, 2, 2, 1, 1),
        ("b", 2, 3, 5, 3, 3),
        ("c", 9, 6, 25_005, 25_000, 25_000),
        ("d", 4, 25_006, 25_007, 2, 2),
    }


def test_dense_keys_of_nothing(spark):
    df = spark.createDataFrame([], "p string")
    assert keys.dense_key(df, "key", ["p"]).collect() == []


def test_dense_keys_do_not_gather_the_table(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("p"))
    plan = _plan(keys.dense_key(df, "key", ["p"]))
    assert "SinglePartition" not in plan and "Window" not in plan


def test_keys_do_not_depend_on_input_order(spark, many_partitions):
    df = spark.range(2000).select(
        (F.col("id") % 50).cast("string").alias("p"), F.col("id").alias("i")
    )
    one = keys.dense_key(df.repartition(3), "key", ["p"])
    two = keys.dense_key(df.orderBy(F.rand(7)).repartition(8), "key", ["p"])
    assert frame_bag(one) == frame_bag(two)


# --- lookups and membership --------------------------------------------------------------------


def test_measured_size_decides_on_broadcast(spark):
    lookup_table = spark.createDataFrame([("a" * 100, 1)] * 10, "k string, v int")
    other = spark.createDataFrame([("b",)], "k3 string")
    size, other_size = lookup.measured_bytes(lookup_table, other)
    assert size >= 10 * (100 + 4) and 1 <= other_size < size
    rows = spark.createDataFrame([("a",)], "k2 string")

    def plan(limit):
        table, _ = lookup.broadcast_if_small(lookup_table, other, limit=limit)
        return _plan(rows.join(table, F.col("k2") == F.col("k")), "extended")

    # one budget for both, the smaller table first
    assert "ResolvedHint" in plan(size + other_size)
    assert "ResolvedHint" not in plan(size + other_size - 1)


def test_orphans_match_brute_force(spark):
    pick = random.Random(1)
    left = ["hot" if pick.random() < 1 / 3 else pick.choice([None, *"abcdef"]) for _ in range(300)]
    right = [pick.choice("abc") for _ in range(50)]
    rows = spark.createDataFrame([(k,) for k in left], "k string").repartition(4)
    for known in (right, [*right, None], [*right, "hot", "hot"], []):
        members = spark.createDataFrame([(k,) for k in known], "id string")
        expected = [k for k in left if k not in known]
        assert lookup.orphan_count(rows, "k", members, "id").first().asDict() == {
            "violations": len(expected), "checked": len(left),
        }
        got = [r["k"] for r in lookup.orphan_rows(rows, "k", members, "id").collect()]
        assert Counter(got) == Counter(expected)


# --- counts, contract --------------------------------------------------------------------------


def test_duplicates_count_missing_as_one_value(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), (None,), ("b",)], "k string")
    assert counts.key_counts(df, "k").agg(counts.duplicates()).first()[0] == 3


def test_values_of_several_columns(spark):
    df = spark.createDataFrame([("x", "1"), ("x", None), ("y", "1")], "a string, b string")
    assert {tuple(r) for r in counts.value_rows(df, ["a", "b"]).collect()} == {
        ("a", "x", 2), ("a", "y", 1), ("b", "1", 2), ("b", None, 1),
    }


def test_contract_types(spark):
    df = spark.createDataFrame(
        [("SO1", 1, 2, date(2024, 1, 1), None, None, 33.333333, 3.0, 11.111111, "extra")],
        "order_number string, product_key int, customer_key long, order_date date, ship_date date,"
        " due_date date, sales_amount double, quantity double, price double, other string",
    )
    got = conform.conform(df, GOLD_CONTRACT["fact_sales"])
    assert [(f.name, f.dataType) for f in got.schema] == [
        (f.name, f.dataType) for f in GOLD_CONTRACT["fact_sales"]
    ]
    row = got.first()
    assert (str(row["sales_amount"]), row["quantity"], str(row["price"])) == ("33.33", 3, "11.11")


def test_amount_beyond_the_contract_stops_the_load(spark):
    df = spark.createDataFrame([(1e20,)], "cost double").withColumns(
        {f.name: F.lit(None) for f in GOLD_CONTRACT["dim_products"].fields if f.name != "cost"}
    )
    with pytest.raises(Exception, match="does not fit"):
        conform.conform(df, GOLD_CONTRACT["dim_products"]).collect()


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_nothing_is_lost_on_the_way_to_the_contract(spark, ansi):
    fields = ("order_number string, product_key long, customer_key long, order_date date, ship_date date,"
              " due_date date, sales_amount double, quantity double, price double")
    row = ("SO1", 1, 1, None, None, None, 10.0, 2.0, 4.999)
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        def run(**changed):
            names = [f.split()[0] for f in fields.split(", ")]
            values = [changed.get(n, v) for n, v in zip(names, row, strict=True)]
            frame = spark.createDataFrame([tuple(values)], fields)
            return conform.conform(frame, GOLD_CONTRACT["fact_sales"]).first()

        kept = run()
        assert kept["quantity"] == 2 and str(kept["price"]) == "5.00"
        assert run(quantity=None, price=None)["quantity"] is None
        for lost in ({"quantity": 2.5}, {"quantity": 3e9}, {"price": 123456789.5}):
            with pytest.raises(Exception, match="does not fit"):
                run(**lost)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_version_end_dates_read_their_rows_once(spark, tmp_path):
    rows = [(1, "a", date(2020, 1, 1), None, "x"), (2, "a", date(2021, 1, 1), None, "y"), (3, "b", None, None, "z")]
    _versions(spark, rows).write.parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    got = versions.end_date_versions(stored, "k", "d", "e")
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 1 or "ReusedExchange" in plan
