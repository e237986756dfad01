import math

from pointspark.operators.profile import ColumnRule, find_issues, profile_loads

RULES = [ColumnRule("a", sentinel=-1.0, lo=0.0, hi=10.0, whole=True), ColumnRule("t", pattern="[0-9]+")]
SCHEMA = "feed_id long, load_id long, load_seq int, a float, t string, c int, n int"


def test_missing_ranges_and_patterns(spark):
    rows = [(1, 1, 0, v, t, 9, 9) for v, t in [(1.0, "12"), (2.5, "x1"), (-1.0, " "), (float("nan"), None), (None, ""), (11.0, "3\n"), (math.inf, "4")]]
    out = {r["column_name"]: r for r in profile_loads(spark.createDataFrame(rows, SCHEMA), RULES).collect()}
    assert (out["a"]["rows"], out["a"]["missing"], out["a"]["distinct_values"], out["a"]["out_of_range"], out["a"]["off_pattern"]) == (7, 3, 4, 2, 1)
    assert (out["t"]["missing"], out["t"]["off_pattern"], out["t"]["min_text"]) == (3, 2, "12")
    assert out["a"]["largest_gap"] is None and out["a"]["rows_before"] is None


def test_changes_against_the_load_before(spark):
    rows = [(1, 1, 0, float(i % 10), "1", 0, 0) for i in range(100)] + [(1, 2, 1, 3.0 if i < 60 else -1.0, "1", 0, 0) for i in range(100)] + [(2, 3, 0, 5.0, "1", 0, 0)]
    got = {tuple(r) for r in find_issues(profile_loads(spark.createDataFrame(rows, SCHEMA), RULES)).collect()}
    assert got == {(2, "a", "missing"), (2, "a", "distinct"), (2, "a", "shift")}


def test_gap_within_one_bucket_is_exact(spark):
    # all values share a bucket of the coarse code, so only the fine pass can see the shift
    rows = [(1, 1, 0, 8.0 + i % 4 * 0.01, "1", 0, 0) for i in range(80)] + [(1, 2, 1, 8.0 + (2 + i % 2) * 0.01, "1", 0, 0) for i in range(80)]
    out = [r for r in profile_loads(spark.createDataFrame(rows, SCHEMA), [ColumnRule("a")]).collect() if r["load_id"] == 2][0]
    assert abs(out["largest_gap"] - 0.5) < 1e-9


def test_gaps_below_the_limit_and_behind_a_border_are_exact(spark):
    # 8.0 and 8.01 share a bucket: in the first case borders show no gap, in the second one of 0.3
    for past, now, want in (([8.0] * 20 + [8.01] * 20 + [100.0] * 60, [8.01] * 40 + [100.0] * 60, 0.2), ([8.0] * 50 + [100.0] * 50, [8.01] * 20 + [100.0] * 80, 0.5)):
        rows = [(1, 1, 0, v, "1", 0, 0) for v in past] + [(1, 2, 1, v, "1", 0, 0) for v in now]
        out = [r for r in profile_loads(spark.createDataFrame(rows, SCHEMA), [ColumnRule("a")], resolve=True).collect() if r["load_id"] == 2][0]
        assert abs(out["largest_gap"] - want) < 1e-9


def test_empty(spark):
    assert find_issues(profile_loads(spark.createDataFrame([], SCHEMA), RULES)).count() == 0


def test_large_ids_are_distinct_and_texts_are_compared_by_value(spark):
    schema = "feed_id long, load_id long, load_seq int, k long, t string"
    words = [f"w{i}" for i in range(300)]
    rows = [(1, 1, 0, 9007199254740992 + i % 2, words[i % 150]) for i in range(300)] + [(1, 2, 1, None, words[150 + i % 150]) for i in range(300)]
    out = {(r["load_id"], r["column_name"]): r for r in profile_loads(spark.createDataFrame(rows, schema), [ColumnRule("k"), ColumnRule("t")], resolve=True).collect()}
    assert out[1, "k"]["distinct_values"] == 2 and out[2, "k"]["missing"] == 300
    # no word is in both loads: chi-square of two equal loads without a common value is the number of rows
    assert abs(out[2, "t"]["chi_square"] - 600) < 1e-6
