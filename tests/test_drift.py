import json

from pointspark.operators import drift


def _files(spark, rows):
    return spark.createDataFrame(rows, "file_id long, series_id long, file_seq int, stage string, header string, name string")


def _pcd(names, kinds):
    return "# .PCD\r\nFIELDS\t" + "\t".join(names) + "\nSIZE " + " ".join(k[1] for k in kinds) + "\nTYPE " + " ".join(k[0] for k in kinds) + "\nDATA ascii"


BASE = ["point_idx", "x", "y", "z"]


def test_rename_retype_add_remove(spark):
    f4, f8 = "F4", "F8"
    files = _files(spark, [
        (1, 1, 0, "pcd", _pcd([*BASE, "a", "b", "c"], ["U4", f4, f4, f4, f4, f4, f4]), "n"), (2, 1, 1, "pcd", _pcd([*BASE, "A2", "B", "d"], ["U4", f4, f4, f4, f8, f4, f4]), "n"),
        (3, 2, 0, "outlier_analysis", json.dumps({"extra_dims": [{"name": "K ", "type": "int32"}]}), "n"), (4, 2, 1, "outlier_analysis", json.dumps({"extra_dims": {"k": "float32"}, "point_format": 6}), "n"),
    ])
    recs = [(1, i, f"{i} 0 0 0 {i / 4} 7 {i}") for i in range(5)] + [(2, i, f"{i}  0 0 0  {i / 4:e} 7 nan") for i in range(1, 6)] + [(3, 0, '{"point_idx": 1, "K ": 2}'), (4, 0, '{"point_idx": 1, "k": null}')]
    records = spark.createDataFrame(recs, "file_id long, row_no int, payload string")
    got = {tuple(r) for r in drift.schema_changes(files, records).collect()}
    assert got == {(2, "renamed", "a", "a2"), (2, "removed", "c", ""), (2, "added", "", "d"), (2, "retyped", "a2", "a2"), (4, "retyped", "k", "k")}
    canon = drift.canonical_fields(files, records)
    table = drift.unified_table(files, records, "pcd", canon)
    assert table.columns == ["series_id", "file_seq", "file_id", "row_no", *BASE, "a", "b", "c", "d"]
    assert dict(table.dtypes)["a"] == "double" and table.count() == 10
    assert table.where("file_id = 2 and point_idx = 4").first()["a"] == 1.0


def test_copy_of_a_kept_field_is_added(spark):
    files = _files(spark, [(1, 1, 0, "pcd", _pcd([*BASE, "a"], ["F4"] * 5), "n"), (2, 1, 1, "pcd", _pcd([*BASE, "a", "a_copy"], ["F4"] * 6), "n")])
    records = spark.createDataFrame([(1, 0, "1 0 0 0 5"), (2, 0, "1 0 0 0 5 5")], "file_id long, row_no int, payload string")
    assert {tuple(r) for r in drift.schema_changes(files, records).collect()} == {(2, "added", "", "a_copy")}


def test_large_ids_are_not_rounded(spark):
    files = _files(spark, [(1, 1, 0, "outlier_analysis", json.dumps({"extra_dims": [{"name": "leaf_id", "type": "int64"}]}), "n")])
    values = ["9007199254740993", "5.0", "1e3"]
    records = spark.createDataFrame([(1, i, f'{{"point_idx": {i}, "leaf_id": {v}}}') for i, v in enumerate(values)], "file_id long, row_no int, payload string")
    table = drift.unified_table(files, records, "outlier_analysis", drift.canonical_fields(files, records))
    assert [r["leaf_id"] for r in table.orderBy("row_no").collect()] == [9007199254740993, 5, 1000]


def test_empty(spark):
    records = spark.createDataFrame([], "file_id long, row_no int, payload string")
    assert drift.schema_changes(_files(spark, []), records).count() == 0


def test_flooding_prefers_the_like_named_field():
    score = drift.flood([("pv_var", "F4"), ("ring", "F4")], [("point_var", "F4"), ("laser", "F4")], {})
    assert score[0, 0] > score[0, 1]


def test_values_refute_a_like_named_match(spark):
    """b_new looks like b_old, but carries the values of c: flooding proposes, values refute, and the rest is flooded again."""
    kinds = ["U4", "F4", "F4", "F4", "F4", "F4"]
    files = _files(spark, [(1, 1, 0, "pcd", _pcd([*BASE, "b_old", "c"], kinds), "n"), (2, 1, 1, "pcd", _pcd([*BASE, "b_new", "q"], kinds), "n")])
    records = spark.createDataFrame([(f, i, f"{i} 0 0 0 {i * 2 if f == 1 else i * 5} {i * 5 if f == 1 else i * 2}") for f in (1, 2) for i in range(4)], "file_id long, row_no int, payload string")
    assert {tuple(r) for r in drift.schema_changes(files, records).collect()} == {(2, "renamed", "b_old", "q"), (2, "renamed", "c", "b_new")}


def test_equal_values_are_told_apart_by_the_graph(spark):
    kinds = ["U4", "F4", "F4", "F4", "F4", "F4"]
    files = _files(spark, [(1, 1, 0, "pcd", _pcd([*BASE, "ring", "pv_var"], kinds), "n"), (2, 1, 1, "pcd", _pcd([*BASE, "point_var", "ring_no"], kinds), "n")])
    records = spark.createDataFrame([(f, 0, "7 0 0 0 3 3") for f in (1, 2)], "file_id long, row_no int, payload string")
    assert {tuple(r) for r in drift.schema_changes(files, records).collect()} == {(2, "renamed", "ring", "ring_no"), (2, "renamed", "pv_var", "point_var")}


def test_ids_beyond_doubles_differ_and_double_names_take_the_first(spark):
    kinds = ["U4", "F4", "F4", "F4", "U8"]
    files = _files(spark, [(1, 1, 0, "pcd", _pcd([*BASE, "leaf"], kinds), "n"), (2, 1, 1, "pcd", _pcd([*BASE, "node"], kinds), "n"), (3, 2, 0, "outlier_analysis", json.dumps({"extra_dims": {"k": "int32"}}), "n")])
    records = spark.createDataFrame([(1, 0, "1 0 0 0 9007199254740993"), (2, 0, "1 0 0 0 9007199254740992"), (3, 0, '{"point_idx": 1, "k": 4, "K ": 5}')], "file_id long, row_no int, payload string")
    assert {tuple(r) for r in drift.schema_changes(files, records).collect()} == {(2, "removed", "leaf", ""), (2, "added", "", "node")}
    assert [r["k"] for r in drift.unified_table(files, records, "outlier_analysis", drift.canonical_fields(files, records)).collect()] == [4]
