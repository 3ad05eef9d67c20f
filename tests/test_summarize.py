import math
import random
import statistics

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark import WindowAggregation, summarize
from tidemark.functions.stats import OPERATIONS

PYTHON = {
    "min": min,
    "q1": lambda v: statistics.quantiles(v, n=4)[0],
    "mean": statistics.mean,
    "median": statistics.median,
    "q3": lambda v: statistics.quantiles(v, n=4)[2],
    "stdev": statistics.stdev,
    "max": max,
}


def window(operations=OPERATIONS, **settings):
    return WindowAggregation(operations=operations, **settings)


def rows_of(df, *sort):
    return [row.asDict() for row in df.orderBy(*(sort or ["time"])).collect()]


def test_three_messages(messages):
    df = messages([(1.0, 0, 1.0), (1.2, 1, 2.0), (1.9, 2, 3.0)], "time long, value double")
    out = summarize(df, window(("min", "mean", "median", "stdev", "max")))
    assert rows_of(out) == [
        {
            "time": 1.5, "window_size": 1.0, "count": 3,
            "min_value": 1.0, "mean_value": 2.0, "median_value": 2.0,
            "stdev_value": 1.0, "max_value": 3.0,
        }
    ]


def test_small_sample_takes_first_value(messages):
    rows = [(1.2, 7, 2.0), (1.2, 9, 9.0), (1.0, 2, 1.0), (1.0, 1, 4.0), (1.9, 0, 3.0)]
    df = messages(rows, "offset long, value double")
    out = rows_of(summarize(df, window(min_sample_size=10), order_by=["offset"], fields=["value"]))
    assert out[0]["count"] == 5
    assert {out[0][f"{op}_value"] for op in OPERATIONS} == {4.0}


def test_first_value_skips_nulls(messages):
    df = messages([(1.0, None), (1.1, 5.0), (1.2, 6.0)], "value double")
    assert rows_of(summarize(df, window(("mean",), min_sample_size=3)))[0]["mean_value"] == 5.0


def test_single_message(messages):
    df = messages([(1.0, 8.0)], "value double")
    out = rows_of(summarize(df, window()))[0]
    assert {out[f"{op}_value"] for op in OPERATIONS} == {8.0}


def test_single_message_without_minimum(messages):
    df = messages([(1.0, 8.0)], "value double")
    out = rows_of(summarize(df, window(min_sample_size=1)))[0]
    assert [out[f"{op}_value"] for op in OPERATIONS] == [8.0, None, 8.0, 8.0, None, None, 8.0]


def test_undefined_statistic_can_raise(messages):
    df = messages([(1.0, 8.0)], "value double")
    with pytest.raises(PySparkException, match="stdev"):
        summarize(df, window(("stdev",), min_sample_size=1), on_error="raise").collect()
    summarize(df, window(min_sample_size=2), on_error="raise").collect()


def test_two_values_extrapolate(messages):
    df = messages([(1.0, 1.0), (1.5, 2.0)], "value double")
    out = rows_of(summarize(df, window(("q1", "q3"))))[0]
    assert (out["q1_value"], out["q3_value"]) == (0.75, 2.25)


def test_window_boundaries(messages):
    df = messages([(0.0, 1.0), (0.9, 1.0), (0.95, 1.0), (1.0, 1.0), (-0.1, 1.0)], "value double")
    out = rows_of(summarize(df, window(("mean",))))
    assert [(row["time"], row["count"]) for row in out] == [(-0.5, 1), (0.5, 3), (1.5, 1)]


def test_empty_windows_give_no_row(messages):
    df = messages([(0.0, 1.0), (100.0, 1.0)], "value double")
    assert [row["time"] for row in rows_of(summarize(df, window()))] == [0.5, 100.5]


def test_output_columns(messages):
    df = messages(
        [(0.0, 0, 1.0, 5, True, 3), (0.1, 0, 1.0, 5, True, 4)],
        "time long, value double, excluded long, nonnumeric boolean, inttype long",
    )
    out = summarize(df, window(("min", "mean")), exclude=["excluded"])
    assert out.dtypes == [
        ("time", "double"), ("window_size", "double"), ("count", "bigint"),
        ("min_value", "double"), ("mean_value", "double"),
        ("min_inttype", "double"), ("mean_inttype", "double"),
    ]


def test_operations_keep_their_order(messages):
    df = messages([(0.0, 1.0)], "value double")
    out = summarize(df, window(("max", "q1", "min")))
    assert out.columns[3:] == ["max_value", "q1_value", "min_value"]


def test_listed_fields_keep_their_order(messages):
    df = messages([(0.0, 1.0, 2, "x")], "a double, b int, c string")
    out = summarize(df, window(("mean",)), fields=["b", "c", "a"])
    assert out.columns[3:] == ["mean_b", "mean_a"]
    with pytest.raises(ValueError, match="zz"):
        summarize(df, window(("mean",)), fields=["zz"])


def test_strict_numeric_types(messages):
    df = messages([(0.0, 1, 2, 3.0, 4.0)], "i int, l long, f float, d double")
    assert summarize(df, window(("mean",)), numeric="strict").columns[3:] == ["mean_l", "mean_d"]
    assert len(summarize(df, window(("mean",))).columns) == 7
    with pytest.raises(ValueError):
        summarize(df, window(), numeric="some")


def test_odd_column_names(messages):
    df = messages([(0.0, 1.0), (0.1, 3.0)], "`a.b c` double")
    assert rows_of(summarize(df, window(("mean", "median"))))[0]["median_a.b c"] == 2.0


@pytest.mark.parametrize("limit", [None, 2])
def test_names_used_inside_do_not_clash(messages, limit):
    df = messages(
        [(0.1 * i, "k", "g", float(i), 2.0 * i) for i in range(7)],
        "rank string, `a.b` string, value double, lo double",
    )
    out = summarize(df, window(), keys=["rank", "a.b"], max_group_values=limit)
    row = rows_of(out)[0]
    assert (row["rank"], row["a.b"], row["median_value"], row["q3_lo"]) == ("k", "g", 3.0, 10.0)


def test_nulls_are_skipped_but_counted(messages):
    rows = [(0.0, 1.0, None), (0.1, None, None), (0.2, 3.0, None)]
    out = rows_of(summarize(messages(rows, "a double, b double"), window()))[0]
    assert out["count"] == 3
    assert (out["mean_a"], out["median_a"], out["q1_a"]) == (2.0, 2.0, 0.5)
    assert all(out[f"{op}_b"] is None for op in OPERATIONS)


def test_messages_without_event_time_are_left_out(spark):
    df = spark.createDataFrame([(None, 1.0)], "timestamp timestamp, value double")
    assert summarize(df, window()).count() == 0


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "double", "bigint"])
def test_event_time_types(spark, kind):
    # 2024-03-10 02:30 does not exist in New York, the zone of the test session.
    seconds = 1710037800
    text = {
        "timestamp_ntz": "timestamp_ntz'2024-03-10 02:30:00'",
        "timestamp": "timestamp'2024-03-10 02:30:00Z'",
        "double": f"{seconds}D",
        "bigint": f"{seconds}L",
    }[kind]
    df = spark.sql(f"SELECT {text} AS ts, 1.0D AS value")
    assert rows_of(summarize(df, window(("mean",)), time_column="ts"))[0]["time"] == seconds + 0.5


def test_string_event_time_raises(spark):
    df = spark.sql("SELECT 'now' AS ts, 1.0D AS value")
    with pytest.raises(TypeError):
        summarize(df, window(), time_column="ts")


@pytest.mark.parametrize("limit", [None, 50_000, 20, 4, 1])
def test_against_python(messages, limit):
    """Same numbers from the array and from the distributed selection."""
    rng = random.Random(5)
    groups = {}
    for start in range(40):
        for key in ("a", None):
            size = rng.randint(2, 39)
            groups[start, key] = [round(rng.lognormvariate(0, 3), rng.choice([0, 6])) for _ in range(size)]
    rows = [
        (start + rng.random() * 0.999, key, value, -value if i % 3 else None)
        for (start, key), values in groups.items()
        for i, value in enumerate(values)
    ]
    df = messages(rows, "key string, value double, other double")
    out = summarize(df, window(), keys=["key"], max_group_values=limit).collect()
    assert len(out) == len(groups)
    for row in out:
        values = groups[int(row["time"] - 0.5), row["key"]]
        others = [-v for i, v in enumerate(values) if i % 3]
        assert row["count"] == len(values)
        for name, sample in (("value", values), ("other", others)):
            for op in OPERATIONS:
                want = PYTHON[op](sample) if len(sample) >= 2 else (sample or [None])[0]
                got = row[f"{op}_{name}"]
                assert got == want or math.isclose(got, want, rel_tol=1e-12, abs_tol=1e-12), (op, sample)


def test_one_group_far_above_the_limit(spark):
    """Several rounds of narrowing, with a value that is a third of all rows."""
    n = 60_000
    df = spark.range(n).select(
        F.timestamp_seconds(F.lit(0)).alias("timestamp"),
        F.when(F.col("id") % 3 == 0, F.lit(7.25))
        .otherwise(F.pmod(F.xxhash64("id"), F.lit(10_000_019)) / 1e5)
        .alias("value"),
    )
    values = [row[0] for row in df.select("value").collect()]
    out = summarize(df, window(("q1", "median", "q3")), max_group_values=50).collect()[0]
    for op in ("q1", "median", "q3"):
        assert out[f"{op}_value"] == PYTHON[op](values)


def test_constant_group_above_the_limit(spark):
    df = spark.range(500).select(F.timestamp_seconds(F.lit(0)).alias("timestamp"), F.lit(3.5).alias("v"))
    out = summarize(df, window(), max_group_values=10).collect()[0]
    assert (out["q1_v"], out["median_v"], out["q3_v"], out["stdev_v"]) == (3.5, 3.5, 3.5, 0.0)


def test_group_of_nulls_above_the_limit(spark):
    df = spark.range(100).selectExpr(
        "timestamp_seconds(0) AS timestamp", "CAST(NULL AS DOUBLE) AS a",
        "IF(id = 7, 2.0D, NULL) AS b", "IF(id % 50 = 7, DOUBLE(id), NULL) AS c",
    )
    row = summarize(df, window(), max_group_values=30).collect()[0]
    assert row["count"] == 100
    assert all(row[f"{op}_a"] is None for op in OPERATIONS)
    assert {row[f"{op}_b"] for op in OPERATIONS} == {2.0}
    assert (row["q1_c"], row["median_c"], row["q3_c"]) == (-5.5, 32.0, 69.5)
    only_nulls = summarize(df.select("timestamp", "a"), window(), max_group_values=30).collect()
    assert [r["median_a"] for r in only_nulls] == [None]


@pytest.mark.parametrize("where", ["false", "value > 5"])
def test_empty_input(messages, where):
    df = messages([(0.0, 1.0)], "value double").where(where)
    assert summarize(df, window()).collect() == []


def test_only_mergeable_statistics_stay_a_hash_aggregation(messages):
    df = messages([(0.0, 1.0)], "value double")
    out = summarize(df, window(("min", "mean", "stdev", "max")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    assert plan.count("Exchange") == 1


def test_sorted_values_are_gathered_once_per_field(messages):
    df = messages([(0.0, 1.0)], "value double")
    plan = summarize(df, window())._jdf.queryExecution().executedPlan().toString()
    assert plan.count(" collect_list(") + plan.count("[collect_list(") == 1
    assert plan.count("Exchange") == 1


def test_a_hot_plan_never_gathers_the_hot_group(messages):
    rows = [(0.0, float(i)) for i in range(100)]
    out = summarize(messages(rows, "value double"), window(), max_group_values=10)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan  # all rows are in hot groups
    rows.append((5.0, 1.0))
    out = summarize(messages(rows, "value double"), window(), max_group_values=10)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_get" in plan and "LeftAnti" not in plan  # the rows of hot groups do not reach collect_list


def exchanged(df):
    """What is exchanged in the plan of ``df``: the first real operator below each exchange."""
    passed = ("WholeStageCodegen", "InputAdapter", "Project", "Filter", "Sort", "ColumnarToRow", "Generate")
    found = []

    def children(node):
        return [node.children().apply(i) for i in range(node.children().size())]

    def walk(node):
        if node.nodeName() == "Exchange":
            below = children(node)[0]
            while below.nodeName().startswith(passed):
                below = children(below)[0]
            found.append(below.nodeName())
        for child in children(node):
            walk(child)

    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.fixture
def no_help(spark):
    """Neither broadcasts nor adaptive plans."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def test_rows_of_hot_groups_are_never_exchanged(spark, messages, no_help):
    rows = [(float(i % 3) / 10, i % 50 if i % 5 == 0 else -1, float(i % 977)) for i in range(5_000)]
    df = messages(rows, "key int, value double")
    out = summarize(df, window(), keys=["key"], max_group_values=100)
    below = exchanged(out)
    assert "HashAggregate" in below and not [name for name in below if name.startswith("Scan ExistingRDD")]
    got = {r["key"]: r.asDict() for r in out.collect()}
    for key in {k for _, k, _ in rows}:
        values = [v for _, k, v in rows if k == key]
        assert got[key]["count"] == len(values)
        for op in OPERATIONS:
            assert got[key][f"{op}_value"] == pytest.approx(PYTHON[op](values), rel=1e-12)


def test_rows_of_hot_cogroups_are_never_exchanged_by_group(spark, no_help):
    from tidemark import cogroup

    rows = spark.range(3_000).select(
        F.timestamp_millis("id").alias("timestamp"), F.lit("a").alias("topic"),
        F.when(F.col("id") % 3 == 0, F.col("id") % 17).otherwise(-1).cast("double").alias("time"), F.col("id").cast("double").alias("value0"),
    )
    out = cogroup(rows, window_size_seconds=60, part_rows=200)
    assert "Range" not in exchanged(out) and len(out.collect()) == 17 + 10


def test_first_values_with_tie_breaks_need_no_sorted_aggregate(spark, messages):
    rng = random.Random(8)
    rows = [
        (rng.randrange(60) / 2, rng.choice(["a", None, "b", "c"]), rng.randrange(4), rng.randrange(9),
         rng.choice([None, float(rng.randrange(50))]), float(i))
        for i in range(900)
    ]
    df = messages(rows, "key string, partition int, offset int, value double, other double")
    settings = window(("mean", "stdev"), min_sample_size=7)
    out = summarize(df, settings, keys=["key"], fields=["value", "other"], order_by=["partition", "offset"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "min_by" not in plan
    got = {(r["key"], r["time"]): r for r in out.collect()}
    groups = {}
    for at, key, *order, value, other in rows:
        groups.setdefault((key, int(at) + 0.5), []).append((at, *order, value, other))
    assert set(got) == set(groups) and any(len(g) < 7 for g in groups.values()) and any(len(g) >= 14 for g in groups.values())
    for place, inside in groups.items():
        for i, name in ((3, "value"), (4, "other")):
            values = [x[i] for x in inside if x[i] is not None]
            first = min(((*x[:3], x[i]) for x in inside if x[i] is not None), default=(None,))[-1]
            want = statistics.mean(values) if len(values) >= 7 else first
            assert got[place][f"mean_{name}"] == (want if want is None else pytest.approx(want))


def test_first_values_where_no_group_needs_them(messages):
    df = messages([(0.1, 1, 2.0), (0.2, 0, 4.0), (0.3, 2, 6.0)], "offset int, value double")
    out = summarize(df, window(("mean",), min_sample_size=3), fields=["value"], order_by=["offset"])
    assert [r["mean_value"] for r in out.collect()] == [4.0]
