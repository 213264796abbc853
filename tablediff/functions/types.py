"""The types of a comparison, and which conversions between them are sound."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The types that can be compared and those that can be converted to them, in order.
CAST_TYPES = ["character", "logical", "Date", "numeric", "integer"]
CAST_FROM = [*CAST_TYPES, "POSIXct", "factor", "integer64"]
MEASURE_TYPES = {"numeric": {"numeric"}, "numeric+integer": {"numeric", "integer"}}

#: Spark's names for types, accepted where a type is named.
ALIASES = {
    "bigint": "integer64", "long": "integer64", "timestamp": "POSIXct", "timestamp_ntz": "POSIXct", "string": "character",
    "boolean": "logical", "date": "Date", "double": "numeric", "float": "numeric", "int": "integer",
}

SPARK_TYPES = {"character": "string", "logical": "boolean", "Date": "date", "numeric": "double", "integer": "int"}


def col_type(kind: T.DataType) -> str:
    """The type of a column as the rules call it; others keep Spark's name."""
    match kind:
        case T.StringType():
            return "character"
        case T.BooleanType():
            return "logical"
        case T.DateType():
            return "Date"
        case T.DoubleType() | T.FloatType():
            return "numeric"
        case T.IntegerType() | T.ShortType() | T.ByteType():
            return "integer"
        case T.TimestampType() | T.TimestampNTZType():
            return "POSIXct"
        case T.LongType():
            return "integer64"
    return kind.typeName()


def _rule(source: str, target: str) -> tuple[bool, str]:
    """Whether the conversion is allowed, and what it does or why not."""
    if source == "factor":
        return target == "character", "levels as text" if target == "character" else "only its levels mean anything; take them as text"
    if target == "logical" and source != "character" or target == "Date" and source in ("logical", "integer64"):
        return False, "means nothing"
    if source == "integer64":
        return True, {"character": "its digits", "numeric": "refused from 2^53 on", "integer": "refused beyond 32 bits"}[target]
    if target == "Date" and source != "character":
        return True, "the day of the time" if source == "POSIXct" else "the day with that number, 1970-01-01 being 0"
    if source in ("Date", "POSIXct") and target in ("numeric", "integer"):
        return True, f"{'days' if source == 'Date' else 'seconds'} from 1970-01-01 on"
    if target == "integer" and source in ("numeric", "character"):
        return True, "what is before the point; refused beyond 32 bits"
    if source == "character":
        return True, "read strictly; any other text is refused"
    if (source, target) == ("numeric", "character"):
        return True, "15 digits; refused where they give another number"
    return True, "the time of day with its date" if source == "POSIXct" else "unchanged in meaning"


RULES = {(a, b): _rule(a, b) for a in CAST_FROM for b in CAST_TYPES if a != b}


def cast_rules(spark: SparkSession, wide: bool = True) -> DataFrame:
    """The conversions as a table: a grid of yes, - and =, or a row (from, to, allowed, note) for each."""
    if not wide:
        rows = [(a, b, ok, note) for (a, b), (ok, note) in RULES.items()]
        return spark.createDataFrame(rows, "`from` string, `to` string, allowed boolean, note string")
    grid = [[a, *("=" if a == b else "yes" if RULES[a, b][0] else "-" for b in CAST_TYPES)] for a in CAST_FROM]
    return spark.createDataFrame(grid, ", ".join(f"`{c}` string" for c in ("from", *CAST_TYPES)))
