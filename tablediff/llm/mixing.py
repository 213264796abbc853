"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, stash

#: Documents in one bucket of the seeded order, about.
BUCKET = 4096


def targets(sources: DataFrame, max_epochs: int) -> DataFrame:
    """Adds `target` to `sources` (source, weight, source_size): their shares of all words.

    The sum of all sizes is shared by weight; sources above `max_epochs` times
    their size are clamped there and the excess is shared again, until none is
    above. Each round is one aggregation over the sources, of which the driver
    gets two numbers. An empty table, or one without words, has targets of 0.
    """
    cap = F.lit(max_epochs) * F.col("source_size")
    level, clamped = 0.0, -1
    while True:
        over = cap < F.lit(level) * F.col("weight")
        row = sources.agg(
            (F.sum("source_size") - F.coalesce(F.sum(F.when(over, cap)), F.lit(0))).alias("left"),
            F.sum(F.when(~over, F.col("weight"))).alias("weight"),
            F.count_if(over).alias("clamped"),
        ).first()
        if row["clamped"] == clamped or not row["weight"]:
            return sources.withColumn(
                "target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")) if row["weight"] else cap.cast("double")
            )
        level, clamped = row["left"] / row["weight"], row["clamped"]


#: What a mix adds to its rows.
OWN = ("mix_size", "mix_order", "mix_source_size", "mix_target", "mix_copies", "mix_taken")


def sized(docs: DataFrame, seed: int = 42) -> DataFrame:
    """Adds mix_size, the number of words, and mix_order, a hash of seed, doc_id and text that puts rows into an order."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text))
    return docs.drop(*OWN).withColumns({"mix_size": n_words(text), "mix_order": F.md5(key)})


def mix(docs: DataFrame, weights: DataFrame, max_epochs: int = 3, seed: int = 42, cut: bool = True) -> DataFrame:
    """How often each row of `docs` (doc_id, source, text; more columns are kept) is taken.

    `weights` has one row (source, weight) for each source, null for the null
    source. A source is taken whole as often as its target allows; the fraction
    that remains takes its documents once more, in a seeded order, until the
    target is met. The last of them gives its first words only (`cut`), or goes
    whole if at least half of it is wanted. The order is by a hash of doc_id and
    text, so reruns agree, also where doc_id repeats or is null. Rows with the
    same doc_id and text are alike: if the target falls among them, each gives
    as many words. An empty table gives an empty one.

    Adds mix_size (words; a null text has 0), mix_source_size, mix_target,
    mix_copies (whole repetitions) and mix_taken (words), in place of columns of
    that name. Where the target falls comes from sums over buckets of about
    BUCKET documents, of which only that one is put in order; so each source is
    a row of a small plan, and `docs` are not shuffled.
    """
    return _mixed(sized(docs, seed), weights, max_epochs, cut)


def mix_sizes(docs: DataFrame, weights: DataFrame, max_epochs: int = 3, seed: int = 42) -> DataFrame:
    """mix() of doc_id and source alone: texts are read once, and sizes kept."""
    rows = sized(docs.select("doc_id", "source", "text"), seed).drop("text")
    return _mixed(stash(rows, "sizes"), weights, max_epochs, True)


def _mixed(rows: DataFrame, weights: DataFrame, max_epochs: int, cut: bool) -> DataFrame:
    slim = rows.select("source", "mix_size", "mix_order")
    if "text" in rows.columns:
        slim = stash(slim, "sizes")
    totals = slim.groupBy("source").agg(F.sum("mix_size").alias("source_size"), F.count("*").alias("n"))
    known = totals.join(weights.select(F.col("source").alias("of"), "weight"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    plan = targets(stash(known, "sources"), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.select(
        F.col("source").alias("of"), "source_size", "target", whole.alias("whole"),
        (F.floor(F.col("target") + F.lit(0.5)).cast("long") - whole * F.col("source_size")).alias("rest"),
        F.ceil(F.col("n") / F.lit(BUCKET)).cast("long").alias("buckets"),
    )
    # A row for each source; Spark checks its size before it broadcasts it.
    plan = stash(plan, "plan")

    def upto(of: DataFrame, place: str, start: Column) -> DataFrame:
        """The row of each source (`of`) in whose `size`, summed in order of `place` from `start` on, `rest` falls."""
        order = Window.partitionBy("of").orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = of.withColumn("before", start + F.sum("size").over(order) - F.col("size"))
        return summed.where("before < rest and before + size >= rest")

    place = F.shiftright(F.conv(F.substring("mix_order", 1, 8), 16, 10).cast("long") * F.col("buckets"), 32)
    placed = slim.join(plan, slim["source"].eqNullSafe(plan["of"])).select("of", "rest", "mix_size", "mix_order", place.alias("bucket"))
    buckets = placed.groupBy("of", "rest", "bucket").agg(F.sum("mix_size").alias("size"))
    edge = stash(upto(buckets, "bucket", F.lit(0)).select("of", "bucket", "before"), "edges")
    inside = placed.alias("p").join(edge.alias("e"), F.col("p.of").eqNullSafe(F.col("e.of")) & (F.col("p.bucket") == F.col("e.bucket")))
    inside = inside.groupBy("p.of", "rest", F.col("before").alias("start"), "mix_order").agg(F.sum("mix_size").alias("size"), F.count("*").alias("alike"))
    last = stash(upto(inside, "mix_order", F.col("start")).select("of", F.col("mix_order").alias("last"), (F.col("rest") - F.col("before")).alias("left"), "alike"), "edges")
    plan = plan.alias("p").join(last.alias("l"), F.col("p.of").eqNullSafe(F.col("l.of")), "left").select(
        F.struct("p.of", "source_size", "target", "whole", "last", "left", "alike").alias("plan")
    )
    plan = stash(plan, "plan")

    name = "__mix_plan"
    while name in {c.lower() for c in rows.columns}:
        name += "_"
    p = plan.withColumnRenamed("plan", name)
    out = rows.join(p, rows["source"].eqNullSafe(p[f"{name}.of"]))
    at = lambda c: F.col(f"{name}.{c}")
    size = F.col("mix_size")
    part = F.round(at("left") / at("alike")) if cut else F.when(2 * at("left") >= size * at("alike"), size).otherwise(0)
    part = F.when(F.col("mix_order") < at("last"), size).when(F.col("mix_order") == at("last"), part.cast("long")).otherwise(0)
    return out.select(
        *[F.col(c) for c in rows.columns if c not in OWN], "mix_size", at("source_size").alias("mix_source_size"), at("target").alias("mix_target"),
        (at("whole") + F.when((part == size) & (part > 0), 1).otherwise(0)).alias("mix_copies"), (at("whole") * size + part).alias("mix_taken"),
    )


def repeating_weights(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """(source, weight): the weights in turn for the sources by code point, null last.

    One row for each source; only these are put in order in one task.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return docs.select("source").distinct().select(
        "source", F.element_at(F.lit(list(weights)), (place % len(weights) + 1).cast("int")).alias("weight")
    )


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, without cut documents: each row of `docs` as often as it is taken, with the same columns."""
    names = [f"c{k}" for k in range(len(docs.columns))]  # none that the mix adds
    inner = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, names)], *[docs[c] for c in ("doc_id", "source", "text")])
    mixed = mix(inner, cut=False, **options).where("mix_copies > 0")
    copies = mixed.select(*names, F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))))
    return copies.select(*names).toDF(*docs.columns)


#: op4 in DuckDB SQL.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
c AS (SELECT *, 3 * source_size AS cap,
        sum(3 * source_size) OVER o - 3 * source_size AS caps_before, sum(weight) OVER o - weight AS weights_before
      FROM w WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) - caps_before)::DOUBLE / ((SELECT sum(weight) FROM w) - weights_before)::DOUBLE AS level FROM c),
t AS (SELECT source, source_size, least(cap::DOUBLE, weight * (SELECT level FROM l WHERE level * weight <= cap ORDER BY cap / weight, source NULLS LAST LIMIT 1)) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
q AS (SELECT *, floor(target + 0.5)::BIGINT - whole * source_size AS rest FROM p)
SELECT doc_id, size, source_size, target,
       whole * size + greatest(0, least(size, rest - (sum(size) OVER (PARTITION BY d.source ORDER BY u ROWS UNBOUNDED PRECEDING) - size)))::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
"""
