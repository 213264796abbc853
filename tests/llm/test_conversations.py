import hashlib
import heapq
import random
import zlib
from itertools import groupby

from tablediff.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, c string, place int, kind string"
WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        named = lambda v: " " if v is None else str(v)
        f = zlib.crc32(f"{named(conv)}:{named(turn)}".encode()) % 20
        role, text = named(role), named(text)
        if f == 0:
            continue
        text = "" if f == 1 else "".join(c for c in text if c not in ".!?") if f == 2 else text
        out += [(conv, turn, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
    return out


def cheapest(faults):
    """Least (cost, letters, output roles) by Dijkstra over (rows done, output so far folded to a state)."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, i, state, out = heapq.heappop(heap)
        if i == len(faults) and state in ("", "a"):
            return cost, letters, out
        if (i, state) in done:
            continue
        done.add((i, state))
        push = lambda c, x, j, s, o: heapq.heappush(heap, (cost + c, letters + x, j, s, out + o))  # noqa: E731, B023
        then = follow[state]
        push(5, "I", i, then, ((None, then),))
        if i < len(faults):
            initial, fault = faults[i]
            push(2, "D", i + 1, state, ())
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if (state, initial) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                    push(more, "K", i + 1, initial, ((i, None),))
                push(1 + more, "R", i + 1, then, ((i, then),))


def brute(rows):
    """Each conversation's row of the result; `rows` are whole tuples, in any order."""
    found = {}
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3])
    for conv, own in groupby(sorted(rows, key=key), key=lambda r: r[0]):
        own, seen, faults = list(own), set(), []
        for _, _, role, text in own:
            kept = text.strip(WHITE)
            fault = "blank" if not kept else "duplicate" if (role, text) in seen else "" if kept[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults.append((role[:1], fault))
        cost, letters, out = cheapest(faults)
        long = {"u": "user", "a": "assistant"}
        said = [f"{long[r]}:" if i is None else f"{long[r] if r else own[i][2]}:{own[i][3]}" for i, r in out]
        turns = [t for _, t, _, _ in own if t is not None]
        legal = ("su", "ua", "au")
        found[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[sum(f == n for _, f in faults) for n in ("blank", "duplicate", "truncated")],
            sum(a + b not in legal for (a, _), (b, _) in zip(faults, faults[1:])), cost, letters, hashlib.sha256("\n".join(said).encode()).hexdigest(),
        )
    return found


def made(seed, n):
    rnd = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rnd.choice([0, 1, 2, 3, 5, 8, 12])):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "usr", None])
            text = rnd.choice(["Yes.", "No!", "é fin", "", " \t\n\x0b", None, f"t{turn} ?  ", f"cut {turn}", "\xa0", "  x. \n"])
            rows.append((conv, rnd.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows + [(None, 1, "user", "no id."), (None, 2, "assistant", "none."), (n, None, "assistant", "only null turns."), (n, None, "user", "b.")]


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, "k") for r in rows], SCHEMA)


def results(df):
    return {r.conv_id: tuple(r[n] for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


EMPTY = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_against_brute_force(spark):
    rows = made(1, 150)
    df = table(spark, rows)
    got = results(conversations.audit(conversations.damaged(df), df))
    expected = brute(damage(rows))
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        assert r == expected.get(conv, EMPTY), conv
    assert {x for r in got.values() for x in r[6]} == set("DKR")  # deleting a neighbour always costs less than inserting


def test_a_conversation_over_many_ranges(spark):
    rnd = random.Random(2)
    rows = [(7, t // 2, rnd.choice(["user", "assistant", "system"]), rnd.choice(["Yes.", "a", f"n{t}.", f"m{t}.", "", "What?"])) for t in range(3000)]
    rows += [(8, 1, "user", "Hi."), (6, 1, "user", "Hi.")]
    df = table(spark, rows)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = conversations.plan(df)
        assert held.shapes.where("c = '=7'").count() > 8
        got = results(conversations.audit(df))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    expected = brute(rows)
    for conv in (6, 7, 8):
        assert got[conv] == expected[conv]


def test_repaired_rows(spark):
    rows = [(1, 1, "user", "Hi."), (1, 2, "user", "There"), (1, 3, "assistant", "Yes."), (2, 1, "system", "Be good."), (2, 2, "assistant", "Sure."), (3, 1, "system", "x.")]
    got = {}
    for r in sorted(conversations.repaired(table(spark, rows)).collect(), key=lambda r: (r.conv_id, r.place, r.step)):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got[1] == [("user", "Hi."), ("assistant", "Yes.")]
    assert got[2] == [] if 2 not in got else all(a[0] != b[0] for a, b in zip(got[2], got[2][1:]))
    audits = results(conversations.audit(table(spark, rows)))
    for conv, r in audits.items():
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in got.get(conv, [])).encode()).hexdigest() == r[7]


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.audit(conversations.damaged(empty), empty).count() == 0
    assert conversations.repaired(empty).count() == 0
