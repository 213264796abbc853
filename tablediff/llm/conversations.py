"""Conversation structure repair: the cheapest edits that make each conversation alternate.

A conversation is a line of rows; an edit script is a path through a graph of
places between rows and states (nothing said yet, after system, after user,
after assistant). Forward and backward minimum costs of every place tell which
arcs are tight, that is, on some cheapest path. From the start, the set of
places reached so far (the frontier) takes, step by step, the least letter of
its tight arcs, which spells the least of all cheapest scripts.

A conversation may be longer than a task should hold. So its rows lie in ranges
of the order (segments). A segment is a matrix of the costs from each state
before it to each state after it; from these follow the costs at its ends, then
the states at which the walk enters it, and at last each segment is walked by
itself. Only the hash of the repaired text reads a conversation in one task,
row after row, as the hash is defined so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .common import stash

BLANK = " \t\n\x0b\x0c\r"
#: States: nothing yet, after a system, user or assistant row. An inserted or reroled row follows as it must.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = [USER, USER, ASSISTANT, USER]
ENDS = (START, ASSISTANT)
#: A row's initial: s, u, a or another. What a kept row leads to, by state.
KEEPS = [{START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {}]
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: Faults, and the costs of edits.
SOUND, TRUNCATED, EMPTY, REPEATED = range(4)
DELETE, INSERT, REROLE, UNFINISHED = 2, 5, 1, 5
FAR = 1 << 60


def damaged(rows: DataFrame) -> DataFrame:
    """Faults put into `rows` (conv_id, turn, role, text) by a hash of conversation and turn; nulls are one space.

    Of 20 hashes one each drops the row, empties its text, removes its sentence
    marks, repeats it, or gives it to the user. Adds `copy`, 1 for the repeat.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % 20
    text = F.when(F.col("f") == 1, "").when(F.col("f") == 2, F.regexp_replace("t", "[.!?]", "")).otherwise(F.col("t"))
    copies = F.when(F.col("f") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    held = rows.select("conv_id", "turn", named("role").alias("r"), named("text").alias("t"), fault.alias("f")).where("f <> 0")
    return held.select(
        "conv_id", "turn", F.when(F.col("f") == 4, "user").otherwise(F.col("r")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")
    )


def arcs(code: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state after) of a row's edits in a state; the row's code is its initial and 4 times its fault."""
    fault, initial = divmod(code, 4)
    out = [("D", DELETE, state)]
    if fault in (SOUND, TRUNCATED):
        more = UNFINISHED if fault == TRUNCATED else 0
        if state in KEEPS[initial]:
            out.append(("K", more, KEEPS[initial][state]))
        out.append(("R", REROLE + more, FOLLOWS[state]))
    return out


ARCS = [[arcs(code, state) for state in range(4)] for code in range(16)]


def inserted(costs: list[int], forward: bool) -> list[int]:
    """Costs at a place once rows may be inserted there."""
    out = list(costs)
    for _ in range(3):
        for q, then in enumerate(FOLLOWS):
            if forward:
                out[then] = min(out[then], out[q] + INSERT)
            else:
                out[q] = min(out[q], out[then] + INSERT)
    return out


def step(costs: list[int], code: int) -> list[int]:
    """Forward costs after a row, from those before it (where rows may be inserted)."""
    here, out = inserted(costs, True), [FAR] * 4
    for q, found in enumerate(ARCS[code]):
        for _, cost, then in found:
            out[then] = min(out[then], here[q] + cost)
    return out


def back(costs: list[int], code: int) -> list[int]:
    """Backward costs before a row, from those after it."""
    return inserted([min(cost + costs[then] for _, cost, then in found) for found in ARCS[code]], False)


#: Backward costs after the last row.
CLOSED = inserted([0 if q in ENDS else FAR for q in range(4)], False)


def matrix(codes: list[int]) -> list[int]:
    """The least costs from each state before a segment to each one after it, row by row."""
    out = []
    for q in range(4):
        costs = [0 if p == q else FAR for p in range(4)]
        for code in codes:
            costs = step(costs, code)
        out += [min(c, FAR) for c in costs]
    return out


def ends(matrices: list[list[int]]) -> list[tuple[list[int], list[int]]]:
    """For each of a conversation's segments the forward costs before it and the backward costs after it."""
    before, after = [[0, FAR, FAR, FAR]], [CLOSED]
    for m in matrices[:-1]:
        before.append([min(FAR, *(before[-1][q] + m[4 * q + p] for q in range(4))) for p in range(4)])
    for m in reversed(matrices[1:]):
        after.append([min(FAR, *(m[4 * q + p] + after[-1][p] for p in range(4))) for q in range(4)])
    return list(zip(before, reversed(after)))


def walk(codes: list[int], before: list[int], after: list[int], total: int, entry: int, last: bool) -> tuple[str, list[str], str, int] | None:
    """The least tight letters through a segment from the state `entry`.

    Returns the letters, for each row what is inserted before it (u, a) and what
    becomes of it (D, K, u or a), what is inserted after the last row, and the
    state after it. None if no cheapest path enters in this state.
    """
    backward = [after]
    for code in reversed(codes):
        backward.append(back(backward[-1], code))
    backward.reverse()
    forward = [before]
    for code in codes:
        forward.append(step(forward[-1], code))
    letters, ops, added, at, frontier = [], [], "", 0, {entry}
    cost_at = inserted(forward[0], True)
    if cost_at[entry] + backward[0][entry] != total:
        return None
    while at < len(codes) or last:
        found: dict[str, set[int]] = {}
        for q in frontier:
            options = [("I", INSERT, FOLLOWS[q], backward[at]), *((a, c, p, backward[at + 1]) for a, c, p in (ARCS[codes[at]][q] if at < len(codes) else ()))]
            for letter, cost, then, rest in options:
                if cost_at[q] + cost + rest[then] == total:
                    found.setdefault(letter, set()).add(then)
        if not found:
            break  # the end of the conversation
        letter = min(found)
        frontier = found[letter]
        role = "ua"[next(iter(frontier)) == ASSISTANT]  # a letter leads a state to one other, so the frontier is a single state
        letters.append(letter)
        if letter == "I":
            added += role
            continue
        ops.append(added + (role if letter == "R" else letter))
        added, at = "", at + 1
        cost_at = inserted(forward[at], True)
    return "".join(letters), ops, added, next(iter(frontier))


KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _applied(df: DataFrame, f: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """f on each row's values; it returns rows of `schema`."""
    fields = [x.split() for x in schema.split(", ")]
    names, kinds = [n for n, _ in fields], [KINDS[k] for _, k in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [r for values in zip(*(c.to_pylist() for c in batch.columns)) for r in f(*values)]
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return df.mapInArrow(run, schema)


def _by_conversation(df: DataFrame, f: Callable[..., list[tuple]], field: str, schema: str) -> DataFrame:
    """f on the segments of each conversation: a few numbers for each range of the order, however many rows it has."""
    return _applied(df.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("part", field))).alias("segments")), f, schema)


def _shape(c: str, part: int, codes: list[int]) -> list[tuple]:
    initials = [x % 4 for x in codes]
    illegal = sum(p not in LEGAL for p in zip(initials, initials[1:]))
    faults = [x // 4 for x in codes]
    return [(c, part, matrix(codes), [initials[0], initials[-1], illegal, *(faults.count(f) for f in (EMPTY, REPEATED, TRUNCATED))])]


def _ends(c: str, segments: list[dict]) -> list[tuple]:
    both = ends([s["m"] for s in segments])
    m = segments[-1]["m"]
    total = min(FAR, *(both[-1][0][q] + m[4 * q + p] + CLOSED[p] for q in range(4) for p in range(4)))
    return [(c, s["part"], v, w, total, k == len(both) - 1) for k, (s, (v, w)) in enumerate(zip(segments, both))]


def _exits(c: str, part: int, codes: list[int], v: list[int], w: list[int], total: int, last: bool) -> list[tuple]:
    found = [walk(codes, v, w, total, q, last) for q in range(4)]
    return [(c, part, [-1 if f is None else f[3] for f in found])]


def _entries(c: str, segments: list[dict]) -> list[tuple]:
    out, state = [], START
    for s in segments:
        out.append((c, s["part"], state))
        state = s["exits"][state]
    return out


def _walked(c: str, part: int, codes: list[int], places: list[int], v: list[int], w: list[int], total: int, last: bool, entry: int) -> list[tuple]:
    letters, ops, added, _ = walk(codes, v, w, total, entry, last)
    # What is inserted after the last row is an edit at a place that no row has.
    return [(c, part, letters, places + [2**63 - 1] * last, ops + [added + "D"] * last)]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the repaired rows of each conversation. Rows come in order, each edit before the row it is for."""
    now, digest, edit, first = None, None, "D", True

    def put(role: str, text: str) -> None:
        nonlocal first
        digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
        first = False

    long = {"u": "user", "a": "assistant"}
    for batch in batches:
        done = []
        for c, kind, role, text in zip(*(batch.column(n).to_pylist() for n in ("c", "kind", "role", "text"))):
            if c != now:
                if now is not None:
                    done.append((now, digest.hexdigest()))
                now, digest, first = c, hashlib.sha256(), True
            if kind == 0:
                edit = role
                for x in edit[:-1]:
                    put(long[x], "")
            elif edit[-1] != "D":
                put(role if edit[-1] == "K" else long[edit[-1]], text)
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], ["c", "repaired_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (now, digest.hexdigest())], ["c", "repaired_sha256"])


def _key(conv_id: Column) -> Column:
    """A conversation's id as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def _id(kind: DataType) -> Column:
    return F.when(F.col("c") != "", F.expr("substring(c, 2)").cast(kind))


@dataclass
class Plan:
    """The tables of a repair: rows in order, segments' counts, costs, and edits."""

    turns: DataFrame
    shapes: DataFrame
    costs: DataFrame
    walked: DataFrame

    def edits(self) -> DataFrame:
        """(c, place, edit) of each row, and of what follows the last one: what is inserted before it (u, a), then D, K, u or a."""
        return self.walked.select("c", F.explode(F.arrays_zip("places", "ops")).alias("e")).select("c", F.col("e.places").alias("place"), F.col("e.ops").alias("edit"))


def plan(rows: DataFrame) -> Plan:
    """The cheapest edits of each conversation of `rows` (conv_id, turn, role, text; other columns are ignored).

    Rows are in order of turn, null first, then role, then text; rows
    alike in all are interchangeable. Null role and text are one space; a
    null conv_id is a conversation of its own.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    turns = rows.select(_key(F.col("conv_id")).alias("c"), F.col("turn").cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text"))
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64)]
    turns = turns.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    kept = F.rtrim("text", F.lit(BLANK))
    initial = F.array_position(F.array(*map(F.lit, "sua")), F.substring("role", 1, 1))
    turns = stash(turns.select(
        "c", "turn", "role", "text", F.monotonically_increasing_id().alias("place"),
        F.when(initial > 0, initial - 1).otherwise(3).cast("int").alias("initial"),
        F.when(kept == "", EMPTY).when(F.substring(kept, -1, 1).isin(*".!?"), SOUND).otherwise(TRUNCATED).alias("fault"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest"),
    ), "turns")
    earliest = turns.groupBy("c", "digest").agg(F.min("place").alias("first"))
    repeat = (F.col("fault") != EMPTY) & (F.col("place") > F.col("first"))
    code = (F.col("initial") + 4 * F.when(repeat, REPEATED).otherwise(F.col("fault"))).cast("long")
    part = F.shiftright("place", 33).alias("part")
    coded = turns.select("c", "digest", "place", "initial", "fault", part).join(earliest, ["c", "digest"]).select("c", "part", "place", code.alias("code"))
    held = F.sort_array(F.collect_list(F.struct("place", "code")))  # the rows of one range at most
    segments = stash(coded.groupBy("c", "part").agg(held.alias("h")).select("c", "part", F.col("h.code").alias("codes"), F.col("h.place").alias("places")), "segments")

    shapes = stash(_applied(segments.select("c", "part", "codes"), _shape, "c string, part long, m array<long>, counts array<long>"), "shapes")
    costs = stash(_by_conversation(shapes, _ends, "m", "c string, part long, v array<long>, w array<long>, total long, last boolean"), "costs")
    open_ = segments.join(costs, ["c", "part"])
    exits = _applied(open_.select("c", "part", "codes", "v", "w", "total", "last"), _exits, "c string, part long, exits array<long>")
    entries = _by_conversation(exits, _entries, "exits", "c string, part long, entry long")
    walked = _applied(
        open_.join(entries, ["c", "part"]).select("c", "part", "codes", "places", "v", "w", "total", "last", "entry"), _walked,
        "c string, part long, letters string, places array<long>, ops array<string>",
    )
    return Plan(turns, shapes, costs, stash(walked, "walks"))


def repaired(rows: DataFrame) -> DataFrame:
    """The rows of each conversation once repaired, as plan() takes them: conv_id, place, step, role, text.

    They are in order of place and step; rows that were inserted have an empty text.
    """
    kind, p = rows.schema["conv_id"].dataType, plan(rows)
    both = p.edits().join(p.turns.select("c", "place", "role", "text"), ["c", "place"], "left")
    name = lambda x: F.when(x == "u", "user").otherwise("assistant")
    action = F.substring("edit", -1, 1)
    added = F.expr("filter(split(substring(edit, 1, length(edit) - 1), ''), x -> x <> '')")
    own = F.when(action == "D", F.array()).otherwise(F.array(F.struct(F.when(action == "K", F.col("role")).otherwise(name(action)).alias("role"), F.col("text").alias("text"))))
    every = F.concat(F.transform(added, lambda x: F.struct(name(x).alias("role"), F.lit("").alias("text"))), own)
    return both.select(_id(kind).alias("conv_id"), "place", F.posexplode(every).alias("step", "r")).select("conv_id", "place", "step", "r.role", "r.text")


def audit(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """A row for each conversation of `rows`, as plan() takes them: its faults, and the edits that repair it.

    Returns conv_id, gaps (numbers missing among its turns), blank, duplicate,
    truncated, illegal (neighbours that may not follow each other), cost, audit
    (a letter for each edit: keep, rerole, delete, insert) and repaired_sha256.
    `ids` (conv_id) names conversations that get a row though they have none in
    `rows`; without rows all is zero or empty.
    """
    kind, p = rows.schema["conv_id"].dataType, plan(rows)
    # Of two segments that follow each other, the last initial and the first one are neighbours, too.
    at = F.array_sort(F.collect_list(F.struct("part", F.col("counts")[0].alias("a"), F.col("counts")[1].alias("b"))))
    pair = lambda k: F.concat(F.get("at", k - 1)["b"].cast("string"), F.get("at", k)["a"].cast("string"))
    legal = [f"{a}{b}" for a, b in sorted(LEGAL)]
    meets = F.aggregate(F.sequence(F.lit(1), F.size("at")), F.lit(0).cast("long"), lambda n, k: n + F.coalesce((~pair(k).isin(*legal)).cast("long"), F.lit(0)))
    totals = p.shapes.groupBy("c").agg(
        at.alias("at"), *[F.sum(F.col("counts")[k]).alias(n) for k, n in ((2, "inner"), (3, "blank"), (4, "duplicate"), (5, "truncated"))]
    ).withColumn("illegal", F.col("inner") + meets).drop("at", "inner")
    audits = p.walked.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("part", "letters"))).alias("w")).select("c", F.array_join("w.letters", "").alias("audit"))
    least = p.costs.groupBy("c").agg(F.max("total").alias("cost"))
    numbers = p.turns.groupBy("c", "turn").agg(F.lit(1)).groupBy("c").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))

    # The hash is of a conversation's rows one after the other; its task reads them in order and keeps none.
    lines = p.edits().select("c", "place", F.lit(0).alias("kind"), F.col("edit").alias("role"), F.lit("").alias("text"))
    lines = lines.union(p.turns.select("c", "place", F.lit(1), "role", "text")).repartition("c").sortWithinPartitions("c", "place", "kind")
    hashes = lines.mapInArrow(_hashed, "c string, repaired_sha256 string")

    every = p.turns.select("c") if ids is None else ids.select(_key(F.col("conv_id")).alias("c"))
    out = every.distinct()
    for found in (numbers, totals, least, audits, hashes):
        out = out.join(found, "c", "left")
    counts = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(
        _id(kind).alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")
    )


#: DuckDB SQL for op11_conversations. Forward only: of each state, the least cost and its least letters, row after row.
SQL = r"""
WITH RECURSIVE
steps AS (SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS k)),
crcs AS (SELECT list(v ORDER BY k) AS t FROM steps),
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
hashed AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ord(x) AS BIGINT) for x in string_split(name, '')]),
    lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) % 20 AS f FROM given, crcs),
faulty AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM hashed, (VALUES (0), (1)) AS c(copy) WHERE f <> 0 AND (copy = 0 OR f = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS kept
    FROM faulty),
judged AS (SELECT *, left(role, 1) AS i, CASE WHEN kept = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY nth) > 1 THEN 'duplicate' WHEN kept NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY nth) AS before FROM placed),
-- Of each state (0 nothing yet, s, u, a) the least (cost, letters, said); inserting costs more than deleting a neighbour, so it is never least.
paths AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS nth, struct_pack(c := CAST(0 AS BIGINT), e := '', o := CAST([] AS VARCHAR[])) AS p0,
        struct_pack(c := CAST(1000000000 AS BIGINT), e := '', o := CAST([] AS VARCHAR[])) AS ps, struct_pack(c := CAST(1000000000 AS BIGINT), e := '', o := CAST([] AS VARCHAR[])) AS pu,
        struct_pack(c := CAST(1000000000 AS BIGINT), e := '', o := CAST([] AS VARCHAR[])) AS pa
    FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT conv_id, nth,
        struct_pack(c := p0.c + 2, e := p0.e || 'D', o := p0.o),
        list_sort([struct_pack(c := ps.c + 2, e := ps.e || 'D', o := ps.o), struct_pack(c := p0.c + keep + CASE WHEN i = 's' THEN 0 ELSE 1000000000 END, e := p0.e || 'K', o := list_append(p0.o, own))])[1],
        list_sort([struct_pack(c := pu.c + 2, e := pu.e || 'D', o := pu.o), struct_pack(c := p0.c + keep + CASE WHEN i = 'u' THEN 0 ELSE 1000000000 END, e := p0.e || 'K', o := list_append(p0.o, own)),
            struct_pack(c := ps.c + keep + CASE WHEN i = 'u' THEN 0 ELSE 1000000000 END, e := ps.e || 'K', o := list_append(ps.o, own)),
            struct_pack(c := pa.c + keep + CASE WHEN i = 'u' THEN 0 ELSE 1000000000 END, e := pa.e || 'K', o := list_append(pa.o, own)),
            struct_pack(c := p0.c + keep + 1, e := p0.e || 'R', o := list_append(p0.o, 'user:' || text)), struct_pack(c := ps.c + keep + 1, e := ps.e || 'R', o := list_append(ps.o, 'user:' || text)),
            struct_pack(c := pa.c + keep + 1, e := pa.e || 'R', o := list_append(pa.o, 'user:' || text))])[1],
        list_sort([struct_pack(c := pa.c + 2, e := pa.e || 'D', o := pa.o), struct_pack(c := pu.c + keep + CASE WHEN i = 'a' THEN 0 ELSE 1000000000 END, e := pu.e || 'K', o := list_append(pu.o, own)),
            struct_pack(c := pu.c + keep + 1, e := pu.e || 'R', o := list_append(pu.o, 'assistant:' || text))])[1]
    FROM (SELECT p.conv_id, j.nth, p0, ps, pu, pa, j.i, j.text, j.role || ':' || j.text AS own,
        CASE j.fault WHEN 'blank' THEN 1000000000 WHEN 'duplicate' THEN 1000000000 WHEN 'truncated' THEN 5 ELSE 0 END AS keep
        FROM paths p JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.nth = p.nth + 1)),
best AS (SELECT conv_id, list_sort([p0, pa])[1] AS p FROM (SELECT conv_id, arg_max(p0, nth) AS p0, arg_max(pa, nth) AS pa FROM paths GROUP BY conv_id)),
counts AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    p.c AS cost, p.e AS audit, sha256(array_to_string(p.o, chr(10))) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id
"""
