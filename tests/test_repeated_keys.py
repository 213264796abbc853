"""Orders whose keys go beyond a million, so that the changed copy repeats keys: what is compared is what SQL joins."""

import pytest

import tablediff as td
from tablediff import queries

from .test_diff import frame
from .test_entry import text


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Keys 0 to 399 and 1,000,000 more; some have another status there, some are in x twice or three times."""
    path = str(tmp_path_factory.mktemp("repeated"))
    low = [(k, "OFP"[k % 3], 1000.0 + 7 * k % 390) for k in range(400)]
    high = [(1_000_000 + k, "OFP"[(k + (k % 80 == 0)) % 3], 1500.5 + 11 * k % 170) for k in range(400)]
    more = [(1_000_000 + k, s, v + 3.25) for k, s, v in low if k % 60 == 0] + [(k, "O", 2.5) for k in (40, 40, 80, 333)]
    frame(spark, "o_orderkey long, o_orderstatus string, o_totalprice double", *low, *high, *more).write.parquet(f"{path}/orders.parquet")
    return path


@pytest.mark.parametrize("name", ["assertion_refused", "diff_abs_tolerance", "diff_cast_text", "diff_cells", "diff_cells_differences", "diff_rel_tolerance", "diff_row_ids", "report_by_measure", "report_drawn", "report_of_differences", "report_row_counts", "summary_cells"])
def test_against_duckdb(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{sf}/orders.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, sf)
    got = sorted(tuple(map(text, r)) for r in df.collect())
    picked = ", ".join(f'"{c}"' for c in df.columns)
    expected = con.execute(f"SELECT {picked} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert got == sorted(tuple(map(text, r)) for r in expected)


def test_each_with_each(spark):
    x = frame(spark, "id string, v double", ("a", 1.0), ("a", 2.0), ("b", 3.0), (None, 4.0), ("c", 5.0), ("c", 6.0))
    y = frame(spark, "id string, v double", ("a", 2.0), ("a", 1.0), ("a", 7.0), ("b", 3.0), (None, 4.0), ("d", 8.0), ("d", 8.0))
    d = td.diff_table(x, y, duplicates="cross")
    rows = [(r.ID, r.row_id_x, r.row_id_y, r.status) for r in d.sorted().collect()]
    assert rows == [
        (None, 4, 5, "same"), ("a", 1, 1, "changed"), ("a", 1, 2, "same"), ("a", 1, 3, "changed"), ("a", 2, 1, "same"), ("a", 2, 2, "changed"), ("a", 2, 3, "changed"),
        ("b", 3, 4, "same"), ("c", 5, None, "only_x"), ("c", 6, None, "only_x"), ("d", None, 6, "only_y"), ("d", None, 7, "only_y"),
    ]
    assert d.crossed and not d.paired and [n.kind for n in d.notes] == ["repeated_keys"] and "8 pairs" in d.notes[0].message
    report = d.report()
    n = report.rows
    assert (n.n_x, n.n_y, n.n_only_x, n.n_same, n.n_changed, n.n_only_y) == (10, 10, 2, 4, 4, 2)
    assert (report.only_x, report.only_y) == ([("c",)], [("d",)])
    assert any("each of the other table" in line for line in report.format()) and any(line.startswith("pairs: 10 in x, 10 in y") for line in report.format())
    once = td.diff_table(x.where("v IN (1, 3, 4)"), y.where("v IN (1, 3, 4)"), duplicates="cross")
    assert not once.crossed and once.notes == [] and once.differences().count() == 0


def test_each_with_each_without_measures(spark):
    x, y = frame(spark, "id string", ("a",), ("a",), ("b",)), frame(spark, "id string", ("a",), ("a",))
    d = td.diff_table(x, y, duplicates="cross")
    assert d.summary().first().asDict() == {"n": 5, "n_same": 4, "n_changed": 0, "n_only_x": 1, "n_only_y": 0}
    assert d.report().rows.n_same == 4
