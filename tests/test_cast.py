import datetime as dt

import pytest
from pyspark.sql import functions as F

import tablediff as td
from tablediff.functions import cast as c
from tablediff.functions.types import CAST_FROM, CAST_TYPES, RULES, SPARK_TYPES

from .test_diff import frame

NAN = float("nan")
#: One value of each type, and a sample of what text can be read as.
VALUES = {
    "character": ("string", {"logical": "TRUE", "Date": "2021-03-04", "numeric": "1.5", "integer": "7"}),
    "logical": ("boolean", True), "Date": ("date", dt.date(2021, 3, 4)), "numeric": ("double", 3.0), "integer": ("int", 3),
    "POSIXct": ("timestamp_ntz", dt.datetime(2021, 3, 4)), "integer64": ("bigint", 3),
}


def one(spark, kind, value, source, target, **options):
    df = frame(spark, f"v {kind}, r int", (value, 1))
    truncate = options.pop("truncate", True)
    cast = c.Cast({"v": ("v", source, target)}, **options)
    work = cast.prepared(df)
    counts = work.agg(*[F.sum(x).alias(k) for k, x in cast.sums.items()]).first().asDict() if cast.sums else {}
    lost, _ = cast.judged(work, "r", counts, truncate)
    out = cast.finished(work, ["v", "r"])
    assert dict(out.dtypes)["v"] == (SPARK_TYPES[target] if source != target else kind)
    return out.first()["v"], lost


@pytest.mark.parametrize("source", [s for s in CAST_FROM if s != "factor"])
def test_every_rule(spark, source):
    kind, value = VALUES[source]
    for target in CAST_TYPES:
        if target == source:
            continue
        v = value[target] if isinstance(value, dict) else value
        if RULES[source, target][0]:
            assert one(spark, kind, v, source, target)[0] is not None
        else:
            with pytest.raises(td.CastError) as e:
                one(spark, kind, v, source, target)
            assert (e.value.from_type, e.value.to_type) == (source, target)


def test_rules_table(spark):
    assert len(RULES) == 35 and sum(ok for ok, _ in RULES.values()) == 24
    wide = {r["from"]: r for r in td.cast_rules(spark).collect()}
    assert wide["factor"]["character"] == "yes" and wide["factor"]["Date"] == "-" and wide["Date"]["Date"] == "="
    assert td.cast_rules(spark, wide=False).count() == 35


@pytest.mark.parametrize(("text", "value"), [("1.5", 1.5), (" -2e3\t", -2000.0), ("0x1F", 31.0), ("Inf", float("inf")), ("-inf", -float("inf")), (".5", 0.5), ("5.", 5.0), ("0x1p3", 8.0), ("-0X1.8P0", -1.5), ("0x.8", 0.5), ("0x1.p-1074", 5e-324), ("0x1.fffffffffffffp+1023", 1.7976931348623157e308), ("0x0001.921fb54442d18p1", 3.141592653589793), (None, None)])
def test_text_to_number(spark, text, value):
    assert one(spark, "string", text, "character", "numeric")[0] == value


@pytest.mark.parametrize("text", ["NA", "1d", "1f", "", "one", "1,5", "0x", "1e", "0x.", "0x1p", "0xg", "0x1.1.1"])
def test_text_that_is_no_number(spark, text):
    with pytest.raises(td.CastError, match="not read as a number"):
        one(spark, "string", text, "character", "numeric")


@pytest.mark.parametrize(("value", "text"), [
    (0.1, "0.1"), (1e15, "1000000000000000"), (-0.0, "0"), (123456.75, "123456.75"), (1e-5, "0.00001"), (1e20, "1e+20"), (2.5e-20, "2.5e-20"),
    (100.0, "100"), (-3.25, "-3.25"), (float("inf"), "Inf"), (NAN, "NaN"), (None, None),
])
def test_number_to_text(spark, value, text):
    assert one(spark, "double", value, "numeric", "character")[0] == text


def test_refused_values(spark):
    for kind, v, source, target, why in (
        ("double", 0.1 + 0.2, "numeric", "character", "15 digits"), ("double", 3e9, "numeric", "integer", "an integer ends"),
        ("double", -2147483648.0, "numeric", "integer", "an integer ends"), ("string", "yes", "character", "logical", "says neither"),
        ("string", "2021-3-4", "character", "Date", "does not read"), ("string", "0024-01-01", "character", "Date", "is not how"),
        ("string", "2021-02-30", "character", "Date", "does not read as"), ("bigint", 2**53 + 1, "integer64", "numeric", "9007199254740993"),
        ("bigint", 2**31, "integer64", "integer", "an integer ends"), ("string", "3e9", "character", "integer", "an integer ends"),
    ):
        with pytest.raises(td.CastError, match=why):
            one(spark, kind, v, source, target)
    with pytest.raises(td.CastError, match="NaN has no such form"):
        one(spark, "double", NAN, "numeric", "integer", nan_is_na=False)
    assert one(spark, "double", NAN, "numeric", "integer")[0] is None


def test_truncation(spark):
    for kind, v, source, target, out, lost in (
        ("double", 1.7, "numeric", "integer", 1, 1), ("double", -3.7, "numeric", "integer", -3, 1), ("double", -0.5, "numeric", "Date", dt.date(1969, 12, 31), 1),
        ("string", "3.7", "character", "integer", 3, 1), ("timestamp_ntz", dt.datetime(2021, 3, 4, 5, 6), "POSIXct", "Date", dt.date(2021, 3, 4), 1),
        ("timestamp_ntz", dt.datetime(1970, 1, 1, 0, 1, 30, 500000), "POSIXct", "numeric", 90.5, 0), ("date", dt.date(1970, 1, 3), "Date", "integer", 2, 0),
        ("boolean", True, "logical", "character", "TRUE", 0), ("int", 5, "integer", "Date", dt.date(1970, 1, 6), 0),
    ):
        got, record = one(spark, kind, v, source, target)
        assert got == out and sum(t.n for t in record) == lost
        if lost:
            with pytest.raises(td.CastError, match="truncate = False"):
                one(spark, kind, v, source, target, truncate=False)


def test_each_text_is_read_once(spark):
    """Whatever is made of a value that was read from text, its plan has each way of reading once."""
    df = spark.range(10).select(F.col("id").cast("int").alias("r"), F.concat(F.col("id").cast("string"), F.lit(".5")).alias("v"))
    cast = c.Cast({"v": ("v", "character", "integer")})
    work = cast.prepared(df)
    checked = work.agg(*[F.sum(x).alias(k) for k, x in cast.sums.items()])
    for plan in (checked, cast.finished(work, ["v", "r"])):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert [text.count(f"{f}(") for f in ("regexp_replace", "conv", "regexp_extract")] == [1, 1, 0] and text.count("RLIKE") == 2
    assert checked.first()["lost|v"] == 10


def test_examples_of_several_columns_by_one_job(spark):
    x = frame(spark, "id int, a int, b int, d date", *[(i, i, i, dt.date(2020, 1, 1)) for i in range(1, 7)])
    y = frame(spark, "id int, a double, b string, d timestamp_ntz", *[(i, i + 0.5, f"{i}.25", dt.datetime(2020, 1, 1, i)) for i in range(1, 7)])
    r = td.diff_table(x, y, by="id", measures=["a", "b"])
    assert [(t.column, t.n, t.examples) for t in r.truncated] == [
        ("a", 6, "1.5 -> 1, 2.5 -> 2, 3.5 -> 3"), ("b", 6, "1.25 -> 1, 2.25 -> 2, 3.25 -> 3"),
        ("d", 6, "2020-01-01 01:00:00 -> 2020-01-01, 2020-01-01 02:00:00 -> 2020-01-01, 2020-01-01 03:00:00 -> 2020-01-01"),
    ]
    assert r.truncated_rows().count() == 18


def test_date_formats(spark):
    assert one(spark, "string", "04/03/2021", "character", "Date", date_format="%d/%m/%Y")[0] == dt.date(2021, 3, 4)
    assert one(spark, "date", dt.date(2021, 3, 4), "Date", "character", date_format="day %d of %B")[0] == "day 04 of March"
    with pytest.raises(td.InputError):
        c.date_pattern("%Q")


def test_normalize(spark):
    df = frame(spark, "k bigint, t timestamp_ntz, v double", (1, dt.datetime(2021, 3, 4, 5), 1.0))
    assert td.normalize_types(df, {"bigint": "integer", "POSIXct": "Date"}).dtypes == [("k", "int"), ("t", "date"), ("v", "double")]
    with pytest.raises(td.TypesError) as e:
        td.normalize_types(df, {"bigint": "integer"})
    assert e.value.columns == ["t"]
    with pytest.raises(td.TypesError):
        td.normalize_types(df.withColumn("a", F.array("v")), {"bigint": "integer", "POSIXct": "Date"})
    with pytest.raises(td.ColumnsError):
        td.normalize_types(df, cols=["nope"])
    assert td.normalize_types(df, cols=["v"]) is df
