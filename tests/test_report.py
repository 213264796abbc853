import pytest

import tablediff as td
from tablediff.plans import render

from .test_diff import frame

@pytest.fixture(scope="module")
def pair(spark):
    x = frame(spark, "key string, size double", ("p", 4.0), ("q", 5.0), ("r", 6.0))
    y = frame(spark, "key string, size double", ("p", 4.0), ("q", 3.5), ("s", 7.0))
    return x, y


def section(lines, title):
    """The lines under the heading that begins with `title`."""
    at = next(k for k, s in enumerate(lines) if s.startswith(title))
    stop = next((k for k in range(at + 1, len(lines)) if not lines[k]), len(lines))
    return [s.strip() for s in lines[at + 1 : stop]]


def test_what_a_report_says(pair):
    report = td.diff_table(*pair).report()
    lines = report.format(unicode=False)
    assert lines[0] == "tablediff report: x and y, 3 rows differ"
    rows = section(lines, "rows: 3 in x, 3 in y")
    assert len(rows[0]) == render.BAR and {c: rows[0].count(c) for c in "-=!+"} == dict.fromkeys("-=!+", 12)
    assert [s.split()[1:] for s in rows[1:]] == [
        ["only", "in", "x", "1", "33.33", "%", "of", "x"], ["same", "1", "50.00", "%", "of", "common"],
        ["changed", "1", "50.00", "%", "of", "common"], ["only", "in", "y", "1", "33.33", "%", "of", "y"],
    ]
    assert section(lines, "measures")[1].split() == ["size", "50.00", "%", "1", "1.5", "0.3"]
    assert section(lines, "changes of size") == ['5  ->  3.5  1 times  first at "q"']
    assert section(lines, "only in x") == ["key", '"r"'] and section(lines, "only in y") == ["key", '"s"']
    assert all(s.isascii() for s in lines) and str(report) == "\n".join(report.format())
    assert section(report.format(), "rows")[0] == "░" * 12 + "█" * 12 + "▓" * 12 + "▒" * 12


def test_equal_and_empty(pair):
    equal = td.diff_table(pair[0], pair[0]).report().format()
    assert equal[0] == "tablediff report: x and y, equal: 3 rows, 1 measures" and not any(s.startswith(("rows", "measures", "only")) for s in equal)
    none = pair[0].limit(0)
    assert td.diff_table(none, none).report(x_name="a", y_name="b").format()[0] == "tablediff report: a and b, both are empty"


def test_bounds_and_names(spark):
    x = frame(spark, "id int, grp string, a double, b double, c double, note string", *[(i, "g", float(i), 1.0, 2.0, "z") for i in range(40)])
    y = frame(spark, "ID string, Grp string, A double, b double, c double, note string, extra int",
              *[(str(i), "g", i + (i % 4) / 2, 1.0 + (i == 3), 2.0, "z", 1) for i in range(8, 50)], ("3", "g", 3.0, 2.0, 2.0, "z", 1))
    d = td.diff_table(x, y, by=["id", "grp"])
    r = d.report(x_name="bench", y_name="tested", top_k=2, sample_k=3)
    assert (r.rows.n_x, r.rows.n_y, r.rows.n_only_x, r.rows.n_only_y, r.rows.n_changed) == (40, 43, 7, 10, 25)
    assert r.dropped == ["extra"] and r.ignored == ["note"] and r.identity == ["id", "grp"]
    assert len(r.only_x) == 3 and r.only_x[0] == (0, "g")
    lines = r.format(unicode=False)
    assert "mode  benchmark (tested is held to bench)" in section(lines, "tablediff")
    assert section(lines, "columns") == ["measures      a, b, c", "dropped       extra (not in bench)", "not compared  note"]
    assert section(lines, "changes of a")[-1] == "and 22 more" and len(section(lines, "changes of a")) == 3
    assert section(lines, "measures")[-1] == "1 of 3 measures match wherever both have the row"
    assert section(lines, "only in bench")[-1] == "and 4 more" and "rows: 40 in bench, 43 in tested" in lines
    assert section(lines, "changes of b") == ['1  ->  2  1 times  first at 3, "g"']
    none = d.report(top_k=0, sample_k=0)
    assert none.changes == [] and none.only_x == [] and not any("changes of" in s for s in none.format())
    only = d.with_df(d.differences()).report()
    assert only.rows.n_same == 0 and only.rows.n_changed == 25
    for kwargs in ({"top_k": -1}, {"sample_k": 1.5}, {"x_name": ""}):
        with pytest.raises(td.InputError):
            d.report(**kwargs)
    with pytest.raises(td.InputError):
        td.diff_report(x)
    with pytest.raises(td.InputError):
        r.format(unicode=1)


def test_values():
    assert [render.number(v) for v in (2.0, 2.5, 1 / 3, float("inf"))] == ["2", "2.5", "0.3333333", "inf"] and render.number(1 / 21, 4) == "0.04762"
    assert [render.percent(*p) for p in ((0, 5), (1, 10**9), (1, 2), (10**9 - 1, 10**9), (3, 3), (0, 0))] == ["0.00 %", "0.01 %", "50.00 %", "99.99 %", "100.00 %", "-"]
    assert [render.cell(v) for v in (None, "a", True, 3, 1.5)] == ["null", '"a"', "true", "3", "1.5"] and render.key((1, "b")) == '1, "b"'
    assert render.width("日本") == 4 and render.width("e\u0301") == 1
    assert render.columns([["日本", "1"], ["a", "22"]], {1}) == ["日本   1", "a     22"]
    for counts in ([1, 10**6, 0, 0], [0, 0, 0, 7], [5, 5, 5, 1], [1, 1, 1, 10**9]):
        drawn = render.bar(counts, "abcd")
        assert len(drawn) == render.BAR and all((c in drawn) == (n > 0) for c, n in zip("abcd", counts))
    assert render.bar([0, 0, 0, 0], "abcd") == ""


def test_assertion(spark, pair):
    x, y = pair
    assert td.assert_table_equal(x, x).differences().count() == 0
    close = x.withColumn("size", x["size"] * (1 + 1e-12))
    td.assert_table_equal(close, x)
    with pytest.raises(td.TableMismatch, match="3 of 4 records"):
        td.assert_table_equal(y, x)
    with pytest.raises(AssertionError) as e:
        td.assert_table_equal(y, x, max_rows=1)
    assert "First 1 records" in str(e.value) and e.value.result.shape == "cells"
    with pytest.raises(td.DuplicatesError):
        td.assert_table_equal(x.union(x), x.union(x))
    td.assert_table_equal(x.union(x), x.union(x), duplicates="aggregate")
    with pytest.raises(td.InputError):
        td.assert_table_equal(x, x, max_rows=-1)


def test_one_pass_and_few_jobs(spark):
    """The result is read once; what the report says is what the operators of its parts say."""
    from tablediff.plans.report import one_sided, row_counts, top_changes

    x = spark.range(2000).selectExpr("CAST(id AS int) AS id", "CAST(id % 7 AS double) AS a", "CAST(IF(id % 5 = 0, NULL, id) AS double) AS b", "IF(id % 3 = 0, NULL, 'g') AS g")
    y = spark.range(100, 2300).selectExpr("CAST(id AS int) AS id", "CAST(IF(id % 10 = 0, 99, id % 7) AS double) AS a", "CAST(id AS double) AS b", "IF(id % 3 = 0, NULL, 'g') AS g")
    d = td.diff_table(x, y, by=["id", "g"])
    d.df.persist().count()
    spark.sparkContext.setJobGroup("report", "report")
    r = d.report(top_k=4, sample_k=6)
    spark.sparkContext.setJobGroup("other", "other")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("report")) <= 6  # three queries, each with one shuffle
    counts = row_counts(d).first()
    assert (r.rows.n_x, r.rows.n_y, r.rows.n_only_x, r.rows.n_same, r.rows.n_changed, r.rows.n_only_y) == tuple(counts)
    top = {(t.metric, t.place): t for t in top_changes(d, 4).collect()}
    assert [(c["measure"].upper(), c["value_x"], c["value_y"], c["n"], c["example"]) for c in r.changes] == [
        (m, t.value_x, t.value_y, t.n, tuple(t.example)) for (m, _), t in sorted(top.items())
    ]
    assert {m["measure"].upper(): m["n_distinct_changes"] for m in r.by_measure} == {m: t.n_distinct for (m, _), t in top.items()}
    assert r.only_x == [tuple(k) for k in one_sided(d, "x", 6).collect()] and r.only_y == [tuple(k) for k in one_sided(d, "y", 6).collect()]
    summary = {s.metric: s for s in d.summary().collect()}
    for m in r.by_measure:
        s = summary[m["measure"].upper()]
        assert (m["n_same"], m["n_changed"], m["max_abs_diff"], m["max_rel_diff"]) == (s.n_same, s.n_changed, s.max_abs_diff, s.max_rel_diff)
    d.df.unpersist()


def test_one_sided_keys_of_pairs_come_once(spark):
    x = frame(spark, "id string, v double", *[("a", float(i)) for i in range(9)], ("b", 1.0))
    y = frame(spark, "id string, v double", ("a", 0.0), ("c", 1.0), ("c", 2.0))
    with pytest.warns(td.DuplicatesWarning):
        r = td.diff_table(x, y).report()
    assert r.only_x == [("a",), ("b",)] and r.only_y == [("c",)] and (r.rows.n_only_x, r.rows.n_only_y) == (9, 2)


def test_groups_and_rows(spark):
    x = frame(spark, "id string, v double", ("a", 1.0), ("a", 2.0), ("b", 1.0), ("d", None))
    y = frame(spark, "id string, v double", ("a", 2.0), ("a", 1.0), ("b", 3.0), ("c", 1.0))
    r = td.diff_table(x, y, duplicates="aggregate").report()
    assert r.unit == "keys" and (r.rows.n_same, r.rows.n_changed, r.rows.n_only_x, r.rows.n_only_y) == (1, 1, 1, 1)
    assert r.by_measure == [{"measure": "v", "n_same": 1, "n_changed": 1, "match_rate": 0.5}] and r.only_x == [("d",)]
    r = td.diff_table(x.select("id").distinct(), y.select("id").distinct()).report()
    assert (r.rows.n_same, r.rows.n_only_x, r.rows.n_only_y, r.by_measure, r.only_y) == (2, 1, 1, [], [("c",)])
