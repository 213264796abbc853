"""Personal data by bootstrapped contextual extraction, in SQL functions only.

1. Strict patterns find the base spans of each kind; they are the seeds.
2. What looks like an identifier without being one of these (a number without
   its country code or with another separator, an address written out, a card
   that fails its check digit) is a candidate, of one kind or of several.
3. Seeds and candidates stand in contexts: the two words before, the word before,
   and the words on both sides. Contexts and values are a graph. A context's
   confidence in a kind is the score that its values have for the kind, over
   their number and one more; a candidate's score is that at least one of its
   trusted contexts is right. Both are computed in turns, a few times.
4. Candidates that score high enough are spans of their kind, wherever they stand.

A context is trusted only if several different seeds of one kind stand in it and
hardly anything else does, so where words say nothing of what follows, as in
noise, nothing is added.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash
from .sketch import let

#: In the order of spans. Each finds the same as its plain form (see the tests) in linear time: nothing is tried twice.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = list(BASE)
#: What a text has at least if it has a match.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

#: Stands for the code points of base spans where candidates are looked for.
MASK = "\u0001"
_AT, _DOT = r"(?:@| ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?)", r"(?:\.| ?[\[({<] ?(?:dot|DOT|\.) ?[\])}>] ?| dot )"
CANDIDATES = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+(?:{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+)*+| at [A-Za-z0-9-]{{1,63}}+(?: dot [A-Za-z0-9-]{{1,63}}+)++)",
    "ip": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|,)[0-9]{1,3}){3})(?![0-9A-Za-z:])",
    "number": r"(?<![0-9A-Za-z])[+(]?[0-9](?:[ ()./_-]{0,2}[0-9])++(?![0-9A-Za-z])",
}
LOOSE = "|".join(f"(?:{p})" for p in CANDIDATES.values())

#: Words of context; how long a word and what is looked at may be.
WORD_CHARS, AROUND = 40, 120
#: Different seeds of a kind that a context needs, and the confidence that makes it trusted.
SUPPORT, TRUST = 5, 0.8
#: The score that makes a candidate a span.
ACCEPT, ROUNDS = 0.8, 3


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(d), ""), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """Whether a match of the kind's base pattern is a span."""
    if kind == "ip":
        part = lambda p: let(F.ltrim(p, F.lit("0")), lambda t: (F.length(t) <= 3) & (F.when(F.length(t) <= 3, F.coalesce(t.try_cast("int"), F.lit(0))).otherwise(999) <= 255))
        return F.forall(F.split(value, r"\."), part)
    if kind == "card":
        return let(digits(value), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False))
    return F.length(digits(value)).between(9, 15) if kind == "phone" else F.lit(True)


def _cut(text: Column, pattern: str, then: Callable[[Column, Column], Column]) -> Column:
    """then(pieces, matches): what stands between the matches of a pattern, one more than these, and the matches."""
    both = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return let(both, lambda x: then(x["p"], x["m"]))


FOUND = "array<struct<gap:int,value:string,left:string,right:string>>"


def found(text: Column, pattern: str) -> Column:
    """The matches of a pattern in order: code points since the one before, the value, and what is around it."""
    return _cut(text, pattern, lambda p, m: F.transform(m, lambda v, i: F.struct(
        F.char_length(F.get(p, i)).cast("int").alias("gap"), v.alias("value"), F.substring(F.get(p, i), -AROUND, AROUND).alias("left"), F.substring(F.get(p, i + 1), 1, AROUND).alias("right")
    )).cast(FOUND))


def masked(text: Column, kind: str) -> Column:
    """The text with the mark MASK for each code point of the kind's spans."""
    shown = lambda v: F.when(v.isNull(), "").when(valid(kind, v), F.repeat(F.lit(MASK), F.char_length(v).cast("int"))).otherwise(v)
    return _cut(text, BASE[kind], lambda p, m: F.array_join(F.transform(p, lambda x, i: F.concat(x, shown(F.get(m, i)))), ""))


def _words(text: Column) -> Column:
    """Words of a context in lower case; identifiers among them are alike."""
    found = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(found, lambda w: F.when(w.rlike(f"[0-9@{MASK}]"), "#").otherwise(F.lower(F.substring(w, -WORD_CHARS, WORD_CHARS))))


def contexts(left: Column, right: Column) -> Column:
    """The contexts of a value: two words before, the word before, and the words on both sides. The end of a text, or another value, is a word, too."""
    before = _words(left)
    word = lambda a, k: F.coalesce(F.try_element_at(a, F.lit(k)), F.lit("^"))
    return let(F.struct(word(before, -2).alias("b"), word(before, -1).alias("a"), word(_words(right), 1).alias("z")), lambda c: F.array(
        F.concat(F.lit("2 "), c["b"], F.lit(" "), c["a"]), F.concat(F.lit("1 "), c["a"]), F.concat(F.lit("+ "), c["a"], F.lit(" "), c["z"])
    ))


def scanned(docs: DataFrame) -> DataFrame:
    """A row for each row of `docs` (doc_id, text): id, doc_id, the matches of each kind, and the candidates. Written once, without texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.array().cast(FOUND)
    hint = lambda k: F.col("t").contains(HINTS[k]) & F.col("number") if HINTS[k] else F.col("number")
    hints = {k: F.col("t").contains("@") if k == "email" else hint(k) for k in KINDS}
    some = F.col("number") | F.col("t").contains("@") | F.col("t").rlike("(?i)[ \\[({<](?:at|dot)[ \\])}>]|[0-9a-f]:")
    rest = reduce(lambda t, k: F.when(hints[k], masked(t, k)).otherwise(t), KINDS, F.col("t"))
    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("id"), text.alias("t"), text.rlike("[0-9]").alias("number"))
    return stash(rows.select(
        "id", "doc_id", *[F.when(hints[k], found(F.col("t"), BASE[k])).otherwise(none).alias(k) for k in KINDS],
        F.when(some, found(rest, LOOSE)).otherwise(none).alias("loose"),
    ), "scanned")


def _placed(rows: DataFrame, column: str) -> DataFrame:
    """(id, start, stop, value, contexts) of each match in a column of scanned()."""
    each = rows.where(F.size(column) > 0).select("id", F.posexplode(column).alias("at", "x")).select("id", "at", "x.*")
    # A document's own matches are put in order.
    upto = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.char_length("value")).over(upto)
    return each.select("id", (stop - F.char_length("value")).alias("start"), stop.alias("stop"), "value", contexts(F.col("left"), F.col("right")).alias("contexts"))


def occurrences(rows: DataFrame) -> DataFrame:
    """Base spans and candidates: id, kind (null for candidates), kinds that a candidate may be of, start, stop, value, contexts."""
    base = [_placed(rows, k).where(valid(k, F.col("value"))).select("id", F.lit(k).alias("kind"), F.array(F.lit(k)).alias("kinds"), "start", "stop", "value", "contexts") for k in KINDS]
    n = F.length(digits(F.col("value")))
    number = F.concat(*[F.when(n.between(a, b), F.array(F.lit(k))).otherwise(F.array().cast("array<string>")) for k, a, b in (("card", 12, 19), ("phone", 7, 15))])
    kinds = F.when(F.col("value").rlike("^[+(]?[0-9][0-9 ()./_-]*$"), number).when(F.col("value").rlike("^[0-9A-Fa-f:]*$|^[0-9]+[\\[(,]"), F.array(F.lit("ip"))).otherwise(F.array(F.lit("email")))
    loose = _placed(rows, "loose").select("id", F.lit(None).cast("string").alias("kind"), kinds.alias("kinds"), "start", "stop", "value", "contexts").where(F.size("kinds") > 0)
    return stash(reduce(DataFrame.union, [*base, loose]), "occurrences")


def bootstrapped(found: DataFrame, support: int = SUPPORT, trust: float = TRUST, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """What occurrences() teach: trusted contexts (context, kind, confidence, seeds) and candidates with scores (value, kind, score)."""
    values = F.lower("value").alias("value")
    links = stash(found.select(values, "kind", "kinds", F.explode("contexts").alias("context")).groupBy("context", "value").agg(
        F.collect_set("kind").alias("seed"), F.array_distinct(F.flatten(F.collect_set("kinds"))).alias("kinds")
    ), "links")
    size = links.groupBy("context").agg(F.count("*").alias("n"))
    seeds = links.select("context", F.explode("seed").alias("kind")).groupBy("context", "kind").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= support)
    # Contexts with enough seeds are the only ones that can be trusted; all else is dropped before the rounds.
    hopeful = stash(seeds.join(size, "context"), "contexts")
    open_ = stash(
        links.where(F.size("seed") == 0).select("context", "value", F.explode("kinds").alias("kind")).join(hopeful.select("context", "kind"), ["context", "kind"]), "open"
    )
    scores = None
    for _ in range(rounds):
        good = hopeful.select("context", "kind", "seeds", "n", F.col("seeds").cast("double").alias("good"))
        if scores is not None:
            more = open_.join(scores, ["value", "kind"]).groupBy("context", "kind").agg(F.sum("score").alias("more"))
            good = good.join(more, ["context", "kind"], "left").withColumn("good", F.col("good") + F.coalesce("more", F.lit(0.0)))
        trusted = stash(good.withColumn("confidence", F.col("good") / (F.col("n") + 1)).where(F.col("confidence") >= trust).select("context", "kind", "confidence", "seeds"), "trusted")
        sure = open_.join(trusted, ["context", "kind"]).groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
        scores = stash(sure, "scores")
    return trusted, scores


def personal_data(docs: DataFrame, support: int = SUPPORT, trust: float = TRUST, accept: float = ACCEPT, rounds: int = ROUNDS) -> DataFrame:
    """The spans of personal data in each row of `docs` (doc_id, text; other columns are ignored).

    Base spans are those of the strict patterns, each kind by itself, so spans of
    different kinds may overlap. Of a candidate, the best kind counts, of equal
    ones the first. Returns doc_id, n_email, n_ip, n_card, n_phone (base spans),
    base_sha256, spans (kind:start:end in code points, end exclusive, by kind and
    start, comma-joined), and n_added, the spans that contexts have added. A null
    text is an empty one, without spans; each row has one of its own.
    """
    rows = scanned(docs)
    every = occurrences(rows)
    _, scores = bootstrapped(every, support, trust, rounds)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    best = scores.where(F.col("score") >= accept).groupBy("value").agg(F.max(F.struct("score", (-rank).alias("rank"))).alias("b")).select(F.col("value").alias("v"), (-F.col("b.rank")).alias("rank"))
    added = every.where("kind is null").join(best, F.lower("value") == F.col("v")).select("id", "rank", "start", "stop", F.lit(False).alias("base"))
    spans = every.where("kind is not null").select("id", rank.alias("rank"), "start", "stop", F.lit(True).alias("base")).union(added)
    own = spans.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "start", "stop", "base"))).alias("s"))  # those of one document
    said = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["rank"]), x["start"], x["stop"])), ",")
    count = lambda k: F.size(F.filter("b", lambda x: x["rank"] == k)).cast("long")
    none = F.array().cast("array<struct<rank:int,start:bigint,stop:bigint,base:boolean>>")
    out = rows.select("id", "doc_id").join(own, "id", "left").withColumn("s", F.coalesce("s", none)).withColumn("b", F.filter("s", lambda x: x["base"]))
    return out.select(
        "doc_id", *[count(k + 1).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(said(F.col("b")), 256).alias("base_sha256"), said(F.col("s")).alias("spans"), (F.size("s") - F.size("b")).cast("long").alias("n_added"),
    )
