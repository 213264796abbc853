import pytest
from pyspark.sql import functions as F

import tablediff as td
from tablediff.functions.names import canonical_name, check_names, name_map
from tablediff.operators.keys import hex_float
from tablediff.operators.measures import select_measures

from .test_diff import frame

NAN = float("nan")


def test_names():
    assert [canonical_name(n) for n in ("prix_unité", "%", "a  b.c", "_x_", "Straße 2")] == ["PRIX_UNIT", "", "A_B_C", "X", "STRA_E_2"]
    assert [n.label for n in name_map(["Id", "a b"])] == ["Id", "a b (A_B)"]
    with pytest.raises(td.ColumnsError):
        check_names(name_map(["%"]), "x")
    check_names(name_map(["a b", "a.b"]), "y", only={"C"})


def test_numbers(spark):
    df = spark.range(1000, numPartitions=7)
    assert [r.n for r in td.number_rows(df, "n").orderBy("id").collect()] == list(range(1, 1001))
    assert [r.n for r in td.number_rows(df.repartition(5), "n", [F.col("id").desc()]).orderBy("id").collect()] == list(range(1000, 0, -1))
    assert td.number_rows(df.limit(0), "n").count() == 0


def test_hex_floats(spark):
    values = [1.5, 0.1, -0.0, 1e300, 5.0, -2.25, 0.0]
    df = frame(spark, "v double", *[(v,) for v in values])
    assert [r[0] for r in df.select(hex_float(F.col("v"))).collect()] == [
        "0x1.8p+0", "0x1.999999999999ap-4", "0x0p+0", "0x1.7e43c8800759cp+996", "0x1.4p+2", "-0x1.2p+1", "0x0p+0",
    ]
    df = frame(spark, "v double", (None,), (NAN,), (float("inf"),), (-float("inf"),))
    assert [r[0] for r in df.select(hex_float(F.col("v"))).collect()] == ["NA", "NaN", "Inf", "-Inf"]


def test_aggregates(spark):
    df = frame(spark, "k int, metric string, value double", (1, "a", 1.0), (1, "a", 3.0), (1, "a", None), (2, "a", NAN), (2, "a", None))
    rows = {r.k: r for r in td.aggregate_by_key(df, ["k"]).collect()}
    assert (rows[1].n_rows, rows[1].n_na, rows[1].value_sum, rows[1].value_sumsq, rows[1].value_min, rows[1].value_max) == (3, 1, 4, 10, 1, 3)
    assert (rows[2].n_rows, rows[2].n_na, rows[2].value_sum) == (2, 2, None)
    exact = {r.k: r.value_key for r in td.aggregate_by_key(df, ["k"], stats="exact").collect()}
    assert exact == {1: "0x1.8p+1|0x1p+0|NA", 2: "NA|NA"}
    assert {r.k: r.value_key for r in td.aggregate_by_key(df, ["k"], stats="exact", nan_is_na=False).collect()}[2] == "NA|NaN"
    counts = {r.k: [tuple(c) for c in r.value_counts] for r in td.aggregate_by_key(df, ["k"], stats="counts").collect()}
    assert counts == {1: [(None, 1), (1.0, 1), (3.0, 1)], 2: [(None, 2)]}
    assert td.aggregate_by_key(df.drop("value"), ["k"]).columns == ["k", "metric", "n_rows"]
    assert [tuple(r) for r in td.duplicate_keys(df, ["k"]).collect()] == [(1, "a", 3), (2, "a", 2)]
    with pytest.raises(td.KeysError):
        td.aggregate_by_key(df, [])
    with pytest.raises(td.InputError):
        td.aggregate_by_key(df, ["k"], stats="all")


def test_merge(spark):
    x, y = frame(spark, "id int, v int", (1, 1), (2, 2), (None, 3)), frame(spark, "id int, v int, w int", (2, 20, 200), (None, 30, 300), (4, 40, 400))
    row = td.merge_dry_run(x, y, ["id"]).first()
    assert (row.rows_x, row.keys_common, row.matched_x, row.est_merge_rows, row.max_fanout, row.one_to_one) == (3, 2, 2, 2.0, 1.0, True)
    rows = lambda how: sorted(map(str, td.merge_tables(x, y, ["id"], how).collect()))
    assert td.merge_tables(x, y, ["id"]).columns == ["id", "v", "v_y", "w"]
    assert [len(rows(h)) for h in ("inner", "full", "left")] == [2, 4, 3]
    assert "Row(id=4, v=None, v_y=40, w=400)" in rows("full")
    with pytest.raises(td.KeysError) as e:
        td.merge_tables(x.union(x), y, ["id"])
    assert e.value.dry_run["dups_x"] == 3
    with pytest.raises(td.ColumnsError):
        td.merge_tables(x.withColumn("v_y", F.lit(1)), y, ["id"])
    with pytest.raises(td.ColumnsError):
        td.merge_dry_run(x, y, ["w"])
    with pytest.raises(td.KeysError):
        td.merge_dry_run(x, y, [])
    empty = td.merge_dry_run(x.limit(0), y, ["id"]).first()
    assert empty.pct_x is None and empty.keys_common == 0


def test_fanout_beyond_32_bits(spark):
    many = spark.range(46_341).select(F.lit(1).alias("id"))
    row = td.merge_dry_run(many, many, ["id"]).first()
    assert row.est_merge_rows == 2_147_488_281 and row.max_fanout == 2_147_488_281 and not row.one_to_one


def test_melt(spark):
    df = frame(spark, "id int, a double, b int, s string", (1, 1.5, 2, "x"), (2, None, 3, "y"))
    assert td.melt(df).columns == ["id", "b", "s", "metric", "value"] and td.melt(df).count() == 2
    assert [tuple(r) for r in td.melt(df, ["b", "a"]).collect()] == [(1, "x", "b", 2.0), (1, "x", "a", 1.5), (2, "y", "b", 3.0), (2, "y", "a", None)]
    assert td.melt(df.drop("a")) is not None and td.melt(df.select("id", "s")).columns == ["id", "s"]


def test_columns(spark):
    x = frame(spark, "k string, v double, n int, o array<int>", ("a", 1.0, 1, [1]), ("b", None, 1, [1]), ("c", NAN, 2, None))
    y = frame(spark, "K string, V double, n string, z int", ("a", -0.0, "1", 1), ("z", 0.0, "2", 1), ("a", None, "2", 2))
    assert [tuple(r) for r in td.summarize_columns(x).collect()] == [("K", "character", 3), ("V", "numeric", 3), ("N", "integer", 2), ("O", "array", 2)]
    rows = {r.colname: r for r in td.compare_columns(x, y).collect()}
    assert list(rows) == ["K", "V", "N", "O", "Z"]
    assert (rows["K"].n_common, rows["K"].n_union, rows["K"].over_pct, rows["K"].name_y) == (1, 4, 25.0, "K")
    assert (rows["V"].n_unique_x, rows["V"].n_unique_y, rows["V"].n_common) == (3, 2, 1)
    assert rows["N"].type_match is False and rows["N"].n_common is None and rows["N"].n_unique_y == 2
    assert rows["Z"].n_unique_y == 2 and rows["Z"].name_x is None and rows["O"].name_y is None
    empty = td.compare_columns(x.limit(0), y.limit(0)).first()
    assert (empty.n_unique_x, empty.n_union, empty.over_pct) == (0, 0, None)


def test_virtual_key(spark):
    df = frame(spark, "g string, v double, at int", ("b", 2.0, 1), ("a", NAN, 2), ("a", 1.0, 3), ("a", None, 4))
    place = lambda **k: {r.at: r.n for r in td.virtual_key(df, "sorted", "at", "n", **k).collect()}
    assert place(sort_by=["v"]) == {3: 1, 1: 2, 2: 3, 4: 4}
    assert place(groups=["g"], sort_by=["v"]) == {1: 1, 3: 1, 2: 2, 4: 3}
    assert {r.n for r in td.virtual_key(df, "position", "at", "n").collect()} == {1, 2, 3, 4}


def numbers(df, name="n"):
    return {r["at"]: r[name] for r in df.collect()}


@pytest.mark.parametrize("partitions", [1, 7])
def test_occurrence_over_ranges(spark, monkeypatch, partitions):
    """Keys of any number of rows are numbered as a window does, in many tasks."""
    rows = [(None if i % 3 else "a", float(i % 2), (i * 7919) % 1000) for i in range(1000)]
    rows += [("b", 1.0, 1000 + i) for i in range(5)] + [("c", None, 1005), ("c", float("nan"), 1006), ("c", float("nan"), 1007)]
    df = spark.createDataFrame(rows, "k string, j double, at long").repartition(5)
    expected = numbers(td.occurrence(df, ["k", "j"], "at", "n"))
    monkeypatch.setattr("tablediff.operators.rows.TASK_ROWS", 1)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = td.occurrence(df, ["k", "j"], "at", "n", largest=500)
        assert numbers(got) == expected and dict(got.dtypes)["n"] == "bigint" and got.columns == [*df.columns, "n"]
        single = spark.range(2000).select(F.lit("one").alias("k"), F.col("id").alias("at"))
        assert numbers(td.occurrence(single, ["k"], "at", "n")) == {i: i + 1 for i in range(2000)}
        if partitions > 1:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            spread = td.occurrence(single, ["k"], "at", "n").groupBy(F.spark_partition_id()).count().collect()
            assert max(r["count"] for r in spread) < 2000
        assert td.occurrence(single.limit(0), ["k"], "at", "n").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_places_in_groups_of_any_size(spark, monkeypatch):
    df = spark.createDataFrame([("g", float(i % 10), i) for i in range(300)] + [("h", None, 300), ("h", NAN, 301), ("h", 1.0, 302)], "g string, v double, at long")
    expected = numbers(td.virtual_key(df, "sorted", "at", "n", groups=["g"], sort_by=["v"]))
    assert [expected[i] for i in (302, 300, 301, 0, 10)] == [1, 2, 3, 1, 2]
    monkeypatch.setattr("tablediff.operators.rows.TASK_ROWS", 10)
    assert numbers(td.virtual_key(df, "sorted", "at", "n", groups=["g"], sort_by=["v"])) == expected


def test_places_beyond_32_bits(spark):
    row = td.virtual_key(spark.range(2**31, 2**31 + 1), "position", "id", "n").first()
    assert row["n"] == 2**31


def test_repeated_keys_in_one_hot_key(spark, monkeypatch):
    x = spark.range(500).select(F.lit("k").alias("id"), F.col("id").cast("double").alias("v"))
    y = spark.range(400).select(F.lit("k").alias("id"), (F.col("id") + (F.col("id") == 7).cast("int")).cast("double").alias("v"))
    monkeypatch.setattr("tablediff.operators.rows.TASK_ROWS", 20)
    with pytest.warns(td.DuplicatesWarning):
        d = td.diff_table(x, y)
    assert {r["status"]: r["count"] for r in d.df.groupBy("status").count().collect()} == {"same": 399, "changed": 1, "only_x": 100}
    assert d.df.agg(F.max("key_seq"), F.countDistinct("key_seq")).first()[:] == (500, 500)


def test_row_numbers_of_what_does_not_arrive_alike(spark, tmp_path):
    from tablediff.operators.rows import placed, repeatable

    spark.range(100, numPartitions=5).write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    assert repeatable(scan.where("id > 3").selectExpr("id + 1 AS id")) and repeatable(frame(spark, "id int", (1,), (2,)))
    shuffled = scan.repartition(6)
    assert not repeatable(shuffled) and not repeatable(scan.groupBy("id").count()) and not repeatable(scan.join(scan, "id"))
    assert any("/rows-" in f for f in placed(shuffled).inputFiles()) and not any("/rows-" in f for f in placed(scan).inputFiles())
    numbered = td.number_rows(shuffled, "n")
    first = {r["id"]: r["n"] for r in numbered.collect()}
    assert sorted(first.values()) == list(range(1, 101))
    assert {r["id"]: r["n"] for r in numbered.repartition(3).collect()} == first


def test_measures_that_are_none(spark):
    types = {"A": "numeric", "B": "integer", "C": "character"}
    assert select_measures(types) == ["A"] and select_measures(types, "numeric+integer") == ["A", "B"] and select_measures(types, ["B", "A"]) == ["B", "A"]
    with pytest.raises(td.MeasuresError) as e:
        select_measures(types, ["A", "C", "D", "A"])
    assert e.value.columns == ["A", "C", "D"]
    for wrong in ([], None, [1]):
        with pytest.raises(td.MeasuresError):
            select_measures(types, wrong)


def test_a_hot_key_as_a_small_multiset(spark):
    x = spark.range(100_000).select(F.lit("k").alias("id"), (F.col("id") % 3).cast("double").alias("v"))
    y = x.union(spark.createDataFrame([("k", 2.0), ("k", None)], x.schema))
    row = td.diff_table(x, y, duplicates="aggregate", multisets="counts").df.first()
    assert [tuple(c) for c in row.value_key_x] == [(0.0, 33334), (1.0, 33333), (2.0, 33333)] and row.status == "changed"
    assert [tuple(c) for c in row.value_key_y] == [(None, 1), (0.0, 33334), (1.0, 33333), (2.0, 33334)]


def test_cells_of_columns_are_small(spark):
    from tablediff.operators.columns import _cell

    long = "é" * 500
    rows = [(True, 1, 2**40, 1.5, long, "short", b"x" * 90, [1, 2], 0.0), (False, -1, -1, NAN, long + "!", "", b"", [], -0.0), (None,) * 9]
    df = spark.createDataFrame(rows, "b boolean, i int, l long, d double, t string, s string, y binary, a array<int>, z double")
    cells = df.select(*[_cell(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]).collect()
    assert all(cells[2][c] is None for c in df.columns if c != "a") and all(len(v) <= 16 for r in cells[:2] for v in r)
    assert {f: cells[0][f] != cells[1][f] for f in df.columns} == {f: f != "z" for f in df.columns}
    counts = {r.colname: r.n_unique for r in td.summarize_columns(df).collect()}
    assert counts == {c.upper(): 2 if c == "z" else 3 for c in df.columns}
