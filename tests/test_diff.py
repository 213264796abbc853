import math

import pytest
from pyspark.sql import functions as F

import tablediff as td

NAN, INF = float("nan"), float("inf")


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema).coalesce(1)


def status(result, *keys):
    return {tuple(r[k] for k in (*result.ids, *keys)): r[result.columns["status"]] for r in result.df.collect()}


@pytest.fixture(scope="module")
def pair(spark):
    x = frame(spark, "id string, v double", ("a", 1.0), ("b", 2.0), ("c", 3.0))
    y = frame(spark, "id string, v double", ("a", 1.0), ("b", 2.5), ("d", 4.0))
    return x, y


def test_four_statuses(pair):
    r = td.diff_table(*pair)
    assert r.shape == "cells" and r.ids == ["ID"] and r.measures == ["V"]
    assert r.df.columns == ["ID", "metric", "row_id_x", "row_id_y", "value_x", "value_y", "diff", "abs_diff", "rel_diff", "status"]
    assert status(r) == {("a",): "same", ("b",): "changed", ("c",): "only_x", ("d",): "only_y"}
    b = r.df.where("ID = 'b'").first()
    assert (b.metric, b.row_id_x, b.row_id_y, b.diff, b.abs_diff, b.rel_diff) == ("V", 2, 2, 0.5, 0.5, pytest.approx(0.2))
    assert [x.ID for x in r.sorted().collect()] == ["a", "b", "c", "d"]
    assert r.differences().count() == 3


def test_plan_has_one_shuffle_a_side_and_no_cartesian(pair):
    plan = td.diff_table(*pair).df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join FullOuter") == 1 and "Cartesian" not in plan


@pytest.mark.parametrize("nan_is_na", [True, False])
def test_missing_values(spark, nan_is_na):
    pairs = [(None, None), (None, NAN), (NAN, None), (NAN, NAN), (None, 1.0), (1.0, None), (INF, INF), (INF, -INF), (INF, 1.0), (-0.0, 0.0)]
    x = frame(spark, "id int, v double", *[(i, a) for i, (a, _) in enumerate(pairs)])
    y = frame(spark, "id int, v double", *[(i, b) for i, (_, b) in enumerate(pairs)])
    got = status(td.diff_table(x, y, tolerance=1e6, rel_tol=10, nan_is_na=nan_is_na))
    mixed = "same" if nan_is_na else "changed"
    expected = ["same", mixed, mixed, "same", "changed", "changed", "same", "changed", "changed", "same"]
    assert [got[i,] for i in range(len(pairs))] == expected


def test_missing_keys(spark):
    x = frame(spark, "k double, v double", (None, 1.0), (2.0, 2.0))
    y = frame(spark, "k double, v double", (NAN, 1.0), (2.0, 2.0))
    assert set(status(td.diff_table(x, y, by="k")).values()) == {"same"}
    assert sorted(status(td.diff_table(x, y, by="k", nan_is_na=False)).values()) == ["only_x", "only_y", "same"]
    x = frame(spark, "d date", (None,), (None,))
    assert sorted(status(td.diff_table(x, x.limit(1)), "key_seq").items()) == [((None, 1), "same"), ((None, 2), "only_x")]


def test_tolerances(spark):
    x = frame(spark, "id int, v double", (1, 100.0), (2, 0.0), (3, 1.0), (4, -1e308))
    y = frame(spark, "id int, v double", (1, 100.5), (2, 1e-12), (3, 1.005), (4, 1e308))
    assert status(td.diff_table(x, y, rel_tol=0.01))[1,] == "same"
    assert status(td.diff_table(x, y, rel_tol=0.001))[1,] == "changed"
    assert status(td.diff_table(x, y, tolerance=0.005))[3,] == "same"
    assert status(td.diff_table(x, y, rel_tol=0.9))[2,] == "changed"
    r = {a.ID: a for a in td.diff_table(x, y).df.collect()}
    assert r[1].rel_diff == pytest.approx(0.5 / 100.5) and r[2].rel_diff == 1
    assert r[4].abs_diff == INF and r[4].rel_diff == 2


def test_duplicates(spark):
    x = frame(spark, "id string, v double", ("a", 1.0), ("a", 2.0), ("b", 3.0))
    y = frame(spark, "id string, v double", ("a", 2.0), ("a", 1.0), ("b", 3.0))
    with pytest.warns(td.DuplicatesWarning):
        r = td.diff_table(x, y)
    assert status(r, "key_seq") == {("a", 1): "changed", ("a", 2): "changed", ("b", 1): "same"} and r.paired
    g = td.diff_table(x, y, duplicates="aggregate")
    assert g.shape == "groups" and set(status(g).values()) == {"same"}
    row = g.df.where("ID = 'a'").first()
    assert (row.n_rows_x, row.n_na_x, row.value_key_x) == (2, 0, "0x1p+0|0x1p+1")
    with pytest.raises(td.DuplicatesError) as e:
        td.diff_table(x, y, duplicates="error")
    assert {(r.side, r.ID, r.n_rows) for r in e.value.duplicates.collect()} == {("x", "a", 2), ("y", "a", 2)}
    with pytest.raises(td.InputError):
        td.diff_table(x, y, duplicates="aggregate", tolerance=1)


def test_rows_as_multisets(spark):
    x, y = frame(spark, "k string", ("a",), ("a",), ("b",)), frame(spark, "k string", ("a",), ("b",), ("b",))
    r = td.diff_table(x, y)
    assert r.shape == "rows" and sorted(status(r, "key_seq").values()) == ["only_x", "only_y", "same", "same"]
    assert set(status(td.diff_table(x, y, duplicates="aggregate")).values()) == {"changed"}
    assert any(n.kind == "no_measures" for n in r.notes)


def test_virtual_keys(spark):
    x = frame(spark, "a double, b double", (1.0, 2.0), (3.0, 4.0), (None, 0.0))
    y = frame(spark, "a double, b double", (None, 0.0), (1.0, 2.0), (3.0, 4.0))
    with pytest.raises(td.KeysError):
        td.diff_table(x, y)
    assert "changed" in status(td.diff_table(x, y, row_key="position"), "metric").values()
    r = td.diff_table(x, y, row_key="sorted")
    assert r.ids == ["row_number"] and set(status(r, "metric").values()) == {"same"}
    x = frame(spark, "id string, v double", ("a", 2.0), ("a", 1.0), ("b", 3.0))
    r = td.diff_table(x, x.orderBy("v"), row_key="sorted")
    assert sorted(status(r)) == [("a", 1), ("a", 2), ("b", 1)] and set(status(r).values()) == {"same"}


def test_names_and_columns(spark):
    x = frame(spark, "`Row id` int, metric string, status string, value double", (1, "m", "s", 1.0))
    r = td.diff_table(x, x.toDF("ROW_ID", "Metric", "STATUS", "Value"))
    assert r.ids == ["ROW_ID", "METRIC", "STATUS"] and r.columns["metric"] == "metric_" and r.columns["status"] == "status_"
    assert r.df.select("status_").first()[0] == "same"
    with pytest.raises(td.ColumnsError):
        td.diff_table(frame(spark, "`a b` int, `a.b` int", (1, 2)), x)
    a, b = frame(spark, "id int, v double, n string", (1, 1.0, "z")), frame(spark, "id int, v double, z int", (1, 1.0, 1))
    with pytest.raises(td.ColumnsError) as e:
        td.diff_table(a, b)
    assert e.value.columns == ["n"]
    r = td.diff_table(a.drop("n"), b)
    assert r.dropped == ["z"] and [n.kind for n in r.notes] == ["dropped_columns"]
    r = td.diff_table(a, a, by="ID")
    assert r.ignored == ["n"]
    for kwargs in ({"by": "id"}, {"cast": True}):
        with pytest.raises((td.ColumnsError, td.InputError)):
            td.diff_table(a, a, mode="equal", **kwargs)
    assert td.diff_table(a, a, mode="equal").differences().count() == 0


def test_refusals(spark, pair):
    x, y = pair
    for kwargs in (
        {"mode": "x"}, {"row_key": 1}, {"duplicates": "all"}, {"tolerance": -1}, {"tolerance": NAN}, {"rel_tol": "1"}, {"truncate": 1}, {"by": []},
    ):
        with pytest.raises(td.InputError):
            td.diff_table(x, y, **kwargs)
    with pytest.raises(td.InputError):
        td.diff_table(x, None)
    with pytest.raises(td.MeasuresError):
        td.diff_table(x, y, by="id", measures=["id"])
    with pytest.raises(td.MeasuresError):
        td.diff_table(x, y, measures=["v", "v"])
    with pytest.raises(td.ColumnsError):
        td.diff_table(x, y, by="nope")
    with pytest.raises(td.DisjointError):
        td.diff_table(x, y.withColumn("id", F.concat("id", F.lit("!"))))
    with pytest.raises(td.DisjointError):
        td.diff_table(x, y.limit(0))
    assert td.diff_table(x.limit(0), y.limit(0)).df.count() == 0
    with pytest.raises(td.TypesError):
        td.diff_table(x.withColumn("n", F.lit(1).cast("bigint")), y.withColumn("n", F.lit(1)))
    with pytest.raises(td.TypesError):
        td.diff_table(x, y.withColumn("v", F.col("v").cast("string")), cast=False)


def test_cast_and_truncation(spark):
    x = frame(spark, "id string, n int, d date", *[(str(i), i, None) for i in range(1, 6)])
    y = frame(spark, "ID int, N double, D string", (1, 1.7, None), (2, 2.0, None), (3, -3.7, None), (4, 4.0, None), (5, 5.5, None))
    r = td.diff_table(x, y, by="id", measures="n")
    assert [(t.column, t.n) for t in r.truncated] == [("N", 3)]
    assert sorted(a.row_id_y for a in r.truncated_rows().collect()) == [1, 3, 5]
    assert status(r)["1",] == "same" and status(r)["3",] == "changed"
    with pytest.raises(td.CastError, match="a fraction would go"):
        td.diff_table(x, y, by="id", measures="n", truncate=False)
    with pytest.raises(td.CastError) as e:
        td.diff_table(x, y.withColumn("N", F.lit("word")), by="id", measures="n")
    assert (e.value.column, e.value.from_type, e.value.to_type, e.value.examples) == ("N", "character", "integer", ["word"])


def test_properties(spark):
    rows = [(i, f"g{i % 3}", (i * 37 % 11) / 7.0 if i % 5 else None, i % 4) for i in range(60)]
    x = spark.createDataFrame(rows, "id int, g string, v double, n int").repartition(5)
    y = x.where("id % 7 <> 0").withColumn("v", F.when(F.col("id") % 4 == 0, F.col("v") + 1).otherwise(F.col("v")))
    y = y.union(x.where("id < 5").withColumn("id", F.col("id") + 1000))
    options = {"measures": "numeric+integer", "by": ["id", "g"], "order_by": ["id"]}
    assert td.diff_table(x, x, **options).differences().count() == 0
    a, b = td.diff_table(x, y, mode="equal", **options), td.diff_table(y, x, mode="equal", **options)
    flip = {"same": "same", "changed": "changed", "only_x": "only_y", "only_y": "only_x"}
    assert {k: flip[v] for k, v in status(a, "metric").items()} == status(b, "metric")
    c = td.diff_table(x.repartition(3, "g"), y.repartition(2), mode="equal", **options)
    assert sorted(map(str, c.df.collect())) == sorted(map(str, a.df.collect()))
    for row in a.summary().collect():
        assert row.n == row.n_same + row.n_changed + row.n_only_x + row.n_only_y


def test_summary(spark, pair):
    row = td.diff_table(*pair).summary().first()
    assert (row.metric, row.n, row.n_same, row.n_changed, row.n_only_x, row.n_only_y, row.max_abs_diff, row.mean_abs_diff) == ("V", 4, 1, 1, 1, 1, 0.5, 0.25)
    assert row.rmse == pytest.approx(math.sqrt(0.125)) and row.max_rel_diff == pytest.approx(0.2)
    x, y = frame(spark, "id int, v double", (1, 0.0), (2, 0.0)), frame(spark, "id int, v double", (1, 1e200), (2, -1e200))
    assert td.diff_table(x, y).summary().first().rmse == pytest.approx(1e200)
    x, y = frame(spark, "id int, v double", (1, -1e308)), frame(spark, "id int, v double", (1, 1e308))
    row = td.diff_table(x, y).summary().first()
    assert row.max_abs_diff == INF and row.rmse == INF
    none = frame(spark, "id int, v double", (1, None))
    assert td.diff_table(none, none).summary().first().rmse is None
    keys = frame(spark, "k string", ("a",)).limit(0)
    assert tuple(td.diff_table(keys, keys).summary().first()) == (0, 0, 0, 0, 0)
    with pytest.raises(td.InputError):
        td.diff_summary(none)
