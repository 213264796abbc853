"""Line dedup by pairs of lines that recur, in SQL functions only.

A hash is rolled over each two lines that follow each other. Where it recurs in
the corpus the lines belong together, and where it does not a chunk ends; so the
content alone decides the boundaries, and lines put before a passage do not shift
them. (Boundaries where the hash is a multiple of some number lose the lines
around a passage and most passages of two or three lines: see the README.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash
from .sketch import NO_ID, let


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def rolled(lines: Column) -> Column:
    """For each line but the last the hash of it and the next, null where one of them is blank: array<bigint>."""
    hashes = F.transform(lines, lambda x: F.when(x.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(x)))
    return let(hashes, lambda h: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(h) - 1, F.lit(1))),
        lambda i: F.when(F.get(h, i - 1).isNotNull() & F.get(h, i).isNotNull(), F.xxhash64(F.get(h, i - 1), F.get(h, i))),
    ))


def line_dedup(docs: DataFrame) -> DataFrame:
    """Removes passages of two lines or more that occur earlier in `docs` (doc_id, text; more columns are kept).

    A line goes if it is one of two lines, neither blank, that follow each other
    and also start earlier: in a smaller doc_id (null is the least), or further
    up. Lines are judged on the input, so each passage stays where it is first.
    Rows that share doc_id and text are one document and give the same result;
    of different texts with one doc_id the order is by hash. Replaces text by
    what is kept, lines joined by newlines (null stays null), and adds n_lines
    and n_removed (0 for null) in place of columns of that name. Columns of any
    other name are kept, and an empty table gives an empty one.

    Two lines whose hash recurs are compared in bytes, and only those that are
    equal count. A passage that a third of all documents
    share is counted before it is shuffled, and what it is joined with is such
    that Spark can split it.
    """
    text = F.col("text").cast("string")
    columns = {c: F.col(f"c{k}") for k, c in enumerate(docs.columns)} | {"text": F.coalesce(F.array_join("kept", "\n"), "text")}
    if dict(docs.dtypes)["doc_id"] == "bigint":  # the key has it already
        columns["doc_id"] = F.nullif("id", F.lit(NO_ID))
    base = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"),
        *[docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns)],
    )
    each = base.where("text is not null").select("id", "h", F.posexplode(rolled(_lines(F.col("text")))).alias("at", "hash")).where("hash is not null")
    often = each.groupBy("hash").agg(F.count("*").alias("m")).where("m > 1").select("hash")
    maybe = each.repartition("hash").join(often, "hash", "left_semi").groupBy("id", "h").agg(F.collect_set("at").alias("places"))  # bounded by the document

    dealt = base.repartition("id", "h")
    pairs = dealt.join(maybe, ["id", "h"]).select("id", "h", "places", _lines(F.col("text")).alias("lines"))
    pairs = pairs.select("id", "h", F.explode(F.transform("places", lambda p: F.struct(
        p.alias("at"), F.concat_ws("\n", F.get("lines", p), F.get("lines", p + 1)).alias("bytes")
    ))).alias("p")).select("id", "h", "p.*")
    # Both are written: a join of two plain shuffles is one that Spark can split where many documents share a passage.
    pairs, place = stash(pairs, "pairs"), F.struct("id", "h", "at")
    first = stash(pairs.groupBy("bytes").agg(F.min(place).alias("first"), F.count("*").alias("m")).where("m > 1").drop("m"), "pairs")
    again = pairs.join(first, "bytes").where(place != F.col("first"))
    gone = again.groupBy("id", "h").agg(F.collect_set("at").alias("gone"))

    rows = dealt.join(gone, ["id", "h"], "left").withColumn("lines", _lines(F.col("text")))
    kept = F.filter("lines", lambda x, i: ~(F.array_contains("gone", i) | F.array_contains("gone", i - 1)))
    rows = rows.withColumn("kept", F.when(F.col("gone").isNotNull(), kept))
    total = F.coalesce(F.size("lines"), F.lit(0))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(total).cast("long")
    return rows.select(
        *[v.alias(c) for c, v in columns.items() if c not in ("n_lines", "n_removed")],
        n_lines.alias("n_lines"),
        F.coalesce(total - F.size("kept"), F.lit(0)).cast("long").alias("n_removed"),
    )


#: op8 in DuckDB SQL, for documents whose doc_id is a key.
SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
pairs AS (
  SELECT doc_id, place, lines[place] AS a, lines[place + 1] AS b
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines))) AS place FROM d)
  WHERE regexp_matches(lines[place], '[^\x20\x09-\x0D]') AND regexp_matches(lines[place + 1], '[^\x20\x09-\x0D]')),
again AS (SELECT doc_id, place FROM pairs QUALIFY rank() OVER (PARTITION BY a, b ORDER BY doc_id NULLS FIRST, place) > 1),
gone AS (SELECT doc_id, place FROM again UNION SELECT doc_id, place + 1 FROM again),
each AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS place FROM d),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY place) AS text
  FROM each ANTI JOIN gone ON each.doc_id = gone.doc_id AND each.place = gone.place GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, (coalesce(len(lines), 0) - coalesce(n, 0))::BIGINT AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept.text, '')) END AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
