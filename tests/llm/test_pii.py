import hashlib
import random
import re

from pyspark.sql import functions as F

from tablediff.llm import pii

from .cases import DOCS_SCHEMA, docs

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    return sum(x - 9 * (x > 9) for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0


def ok(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    return 13 <= len(d) <= 19 and luhn(d) if kind == "card" else 9 <= len(d) <= 15 if kind == "phone" else True


def base(text):
    return [(k, m.start(), m.end(), m.group()) for k, p in PLAIN.items() for m in p.finditer(text or "") if ok(k, m.group())]


def said(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans)


def contexts(text, a, b, others):
    """As pii.contexts: words up to the neighbouring values (others: sorted spans of the same scan)."""
    left = text[max([0, *(e for _, e in others if e <= a)]) : a][-pii.AROUND :]
    right = text[b : min([len(text), *(s for s, _ in others if s >= b)])][: pii.AROUND]
    words = lambda t: ["#" if re.search(f"[0-9@{pii.MASK}]", w) else w[-pii.WORD_CHARS :].lower() for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    before, after = ["^", "^", *words(left)], [*words(right), "^"]
    return [f"2 {before[-2]} {before[-1]}", f"1 {before[-1]}", f"+ {before[-1]} {after[0]}"]


def brute(texts, support=pii.SUPPORT, trust=pii.TRUST, accept=pii.ACCEPT, rounds=pii.ROUNDS):
    """Spans of each text by the whole method, with dictionaries."""
    seen, found = [], []  # (text number, kind or None, kinds, start, end, value, contexts)
    for n, text in enumerate(texts):
        text = text or ""
        for k, p in PLAIN.items():
            matches = [m.span() for m in p.finditer(text)]
            seen += [(n, k, [k], a, b, v, contexts(text, a, b, matches)) for kind, a, b, v in base(text) if kind == k]
        rest = text
        for k in PLAIN:
            for kind, a, b, _ in base(rest):
                if kind == k:
                    rest = rest[:a] + pii.MASK * (b - a) + rest[b:]
        loose = [m for m in re.finditer(pii.LOOSE, rest)]
        for m in loose:
            v, d = m.group(), len(re.sub("[^0-9]", "", m.group()))
            kinds = [k for k, x, y in (("card", 12, 19), ("phone", 7, 15)) if x <= d <= y] if re.fullmatch("[+(]?[0-9][0-9 ()./_-]*", v) else ["ip"] if re.match("[0-9A-Fa-f:]*$|[0-9]+[\\[(,]", v) else ["email"]
            if kinds:
                found.append((n, None, kinds, *m.span(), v, contexts(rest, *m.span(), [x.span() for x in loose])))
    links = {}
    for _, kind, kinds, _, _, v, cs in seen + found:
        for c in cs:
            seed, possible = links.setdefault((c, v.lower()), (set(), set()))
            seed |= {kind} - {None}
            possible |= set(kinds)
    n, seeds = {}, {}
    for (c, _), (seed, _) in links.items():
        n[c] = n.get(c, 0) + 1
        for k in seed:
            seeds[c, k] = seeds.get((c, k), 0) + 1
    scores = {}
    for _ in range(rounds):
        conf = {ck: (s + sum(scores.get((v, ck[1]), 0) for (c, v), (seed, ks) in links.items() if c == ck[0] and not seed and ck[1] in ks)) / (n[ck[0]] + 1) for ck, s in seeds.items() if s >= support}
        conf = {ck: x for ck, x in conf.items() if x >= trust}
        scores = {}
        for (c, v), (seed, ks) in links.items():
            for k in ks if not seed else ():
                if (c, k) in conf:
                    scores[v, k] = 1 - (1 - scores.get((v, k), 0)) * (1 - conf[c, k])
    out = []
    for i, text in enumerate(texts):
        own = base(text)
        for m, _, _, a, b, v, _ in found:
            best = max(((s, -pii.KINDS.index(k)) for (w, k), s in scores.items() if w == v.lower() and s >= accept), default=None)
            if m == i and best:
                own.append((pii.KINDS[-best[1]], a, b, v))
        out.append(said(sorted(own, key=lambda x: (pii.KINDS.index(x[0]), x[1]))))
    return out


TRICKY = [
    "a@b.c_d@e.f x@y.z. u@v @w.x a.b@c..d %+-@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3.99999999999999999999 1.1.1.",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 5 6  7 0000000000000000000 00000000000000000000 1 2", "+1 (555) 123-4567 +12345678 +1 +1 2 +49 (0) 30 1234567. ++1234567890 +1-234-567-8901-2345-67",
    "é😀 +1 (555) 123-4567é é😀a@b.cd 10.0.0.1", "9" * 3000, "a" * 3000 + "@b", "@" * 50, "a@" + "b." * 2000 + "c", "1." * 3000, "", None, " \t\n", "1 - 2 -3- 4",
]


def test_base_spans(spark):
    rnd = random.Random(1)
    texts = [*TRICKY, *["".join(rnd.choice(["1", "23", "4111 1111 1111 1111", ".", " ", "-", "+", "@", "a", "b.c", "é", "(", ")", "😀", "\n"]) for _ in range(rnd.randrange(60))) for _ in range(600)]]
    got = {r.doc_id: r for r in pii.personal_data(docs(spark, *texts, extra=False)).collect()}
    for i, text in enumerate(texts):
        spans = base(text)
        assert got[i].base_sha256 == hashlib.sha256(said(spans).encode()).hexdigest(), text
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        assert got[i].n_added or got[i].spans == said(spans)


def corpus():
    rnd = random.Random(2)
    number = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    texts = []
    for i in range(30):
        texts.append(f"Hello there {name()}. Please call me at +1 (555) {number(3)}-{number(4)} today or tomorrow")
        texts.append(f"{name()} {name()} write to: {name()}@{name()}.org now, from host 10.0.{i}.{i + 1} as {name()}")
        texts.append(f"{name()} {name()} {rnd.choice(['a', 'b', 'c'])} +44 20 {number(8)} and the year {1900 + i} {name()} {number(7)}")
    texts += ["please call me at 555-1234 today, or at 555-9999", "  Write to: Bob [at] mail [dot] com now", "the number is 555-1234.", "write to: ann at mail dot org now", "host 2001:db8:0:1:0:0:0:1 as x"]
    texts += ["Build 20240101 of release 7.1.2 took 12:30:45 and 1,200,300 rows.", "call me at noon", "from host 10[.]0[.]0[.]9 as you know"]
    return texts


def test_contexts_find_what_patterns_do_not(spark):
    texts = corpus()
    df = docs(spark, *texts)
    got = {(r.doc_id, r.base_sha256): r for r in pii.personal_data(df).collect() if r.doc_id is not None and r.doc_id < 900}
    expected = brute(texts)
    assert [got[i, hashlib.sha256(said(base(t)).encode()).hexdigest()].spans for i, t in enumerate(texts)] == expected
    assert [e for e in expected[90:]] == [
        "phone:18:26,phone:40:48", "email:12:35", "phone:14:22", "email:10:29", "ip:5:25", "", "", "ip:10:24",
    ]
    assert all(e == said(base(t)) for t, e in zip(texts[:90], expected))


def test_trusted_contexts(spark):
    rows = docs(spark, *corpus(), extra=False)
    trusted, scores = pii.bootstrapped(pii.occurrences(pii.scanned(rows)))
    assert {("1 to:", "email"), ("2 me at", "phone"), ("1 host", "ip")} <= {(r["context"], r["kind"]) for r in trusted.collect()}
    assert all(0 <= r["score"] <= 1 for r in scores.collect())


def test_odd_rows(spark):
    df = docs(spark, "call +1 555 123 4567", "call +1 555 123 4567").withColumn("id", F.lit(1)).withColumn("kind", F.lit("x"))
    got = pii.personal_data(df).collect()
    assert len(got) == df.count()
    assert sorted(r.spans for r in got)[-2:] == ["phone:5:20"] * 2
    assert pii.personal_data(spark.createDataFrame([], DOCS_SCHEMA)).count() == 0
