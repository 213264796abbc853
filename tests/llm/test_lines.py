import random

from tablediff.llm.lines import line_dedup

from .cases import DOCS_SCHEMA, docs


def test_repeated_passages_go_once(spark):
    rnd = random.Random(2)
    line = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(5))
    passage = [line() for _ in range(40)]
    texts = []
    for i in range(30):
        own = [line() for _ in range(rnd.randrange(3, 30))]
        at = rnd.randrange(len(own))
        texts.append("\n".join(own[:at] + (passage if i % 3 == 0 else []) + own[at:]))
    texts.append(texts[1])
    df = docs(spark, *texts)
    out = {r.doc_id: r for r in line_dedup(df).collect()}
    assert out[0].text == texts[0] and out[0].n_removed == 0
    for i in range(30):
        assert out[i].n_lines == texts[i].count("\n") + 1
        kept = out[i].text.split("\n")
        assert len(kept) == out[i].n_lines - out[i].n_removed
        own = [x for x in texts[i].split("\n") if x not in passage]
        assert [x for x in kept if x not in passage] == own  # nothing of its own goes
        if i and i % 3 == 0:
            assert out[i].n_removed == len(passage)
    assert out[30].n_removed == out[30].n_lines and out[30].text == ""
    assert out[900].text is None and out[900].n_lines == 0 and out[901].text == ""


def brute(rows):
    """rows: (doc_id, text), in order. The text and what is removed of each."""
    seen, out = set(), {}
    for i, text in rows:
        lines = text.split("\n")
        gone = set()
        for k, pair in enumerate(zip(lines, lines[1:])):
            if all(x.strip(" \t\n\v\f\r") for x in pair):
                if pair in seen:
                    gone |= {k, k + 1}
                seen.add(pair)
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(3)
    line = lambda: rnd.choice(["", " ", "x"] + [f"line {rnd.randrange(60)}"] * 12)
    texts = ["\n".join(line() for _ in range(rnd.randrange(1, 25))) for _ in range(120)]
    texts += [texts[3], texts[3] + "\n", "a\na\na\na", "é\n\u2028b\né\n\u2028b"]
    df = docs(spark, *texts)
    rows = sorted({(r.doc_id, r.text) for r in df.collect() if r.text is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    expected = brute(rows)
    for r in line_dedup(df).collect():
        if r.doc_id != 900:
            assert (r.text, r.n_lines, r.n_removed) == expected[r.doc_id], r.doc_id


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", 7, 8, 9, "k"), (2, "z\na\nb", 7, 8, 9, "k")], "doc_id long, text string, __h int, __text int, n_lines int, gone string")
    out = line_dedup(df)
    assert out.columns == ["doc_id", "text", "__h", "__text", "gone", "n_lines", "n_removed"]
    assert sorted(map(tuple, out.collect())) == [(1, "a\nb\nc", 7, 8, "k", 3, 0), (2, "z", 7, 8, "k", 3, 2)]


def test_shape_and_empty(spark):
    df = docs(spark, "a\nb", "a\nb", "a\nb")
    out = line_dedup(df)
    assert out.columns == [*df.columns, "n_lines", "n_removed"]
    assert out.count() == df.count()
    assert line_dedup(spark.createDataFrame([], DOCS_SCHEMA)).count() == 0
