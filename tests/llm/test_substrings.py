import random

import pytest

from tablediff.llm.substrings import SuffixAutomaton, substring_dedup

from .cases import DOCS_SCHEMA, docs


def brute(rows, least):
    """rows: (doc_id, text), distinct. The kept words of each."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = (text or "").encode().split()
        covered = [False] * len(words)
        for p in range(len(words) - least + 1):
            w = tuple(words[p : p + least])
            if w in seen:
                covered[p : p + least] = [True] * least
            seen.add(w)
        out[i] = (len(words), sum(covered), b" ".join(w for w, c in zip(words, covered) if not c).decode())
    return out


@pytest.mark.parametrize(("least", "hot", "shard"), [(20, 1000, 2000), (5, 3, 7)])
def test_against_brute_force(spark, least, hot, shard):
    rnd = random.Random(4)
    word = lambda: f"w{rnd.randrange(400)}"
    shared = [[word() for _ in range(rnd.randrange(least - 3, 3 * least))] for _ in range(6)]
    texts = []
    for k in range(80):
        words = [word() for _ in range(rnd.randrange(0, 120))]
        for _ in range(rnd.randrange(3)):
            at = rnd.randrange(len(words) + 1)
            words[at:at] = rnd.choice(shared)
        texts.append("\t ".join(words))
    texts += [texts[3], texts[4] + " one more", "a " * 60, "a b " * 50, "a " * 70]
    df = docs(spark, *texts)
    rows = {(r.doc_id, r.text) for r in df.collect()}
    got = substring_dedup(df, least=least, hot=hot, shard=shard).collect()
    assert len(got) == df.count()
    expected = brute(rows, least)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept) == expected[r.doc_id], r.doc_id
    assert sum(r.n_removed for r in got) > 500


def test_repeated_rows_with_near_copies_keep_one(spark):
    rnd = random.Random(8)
    first = [f"w{rnd.randrange(10**6)}" for _ in range(60)]
    second = first[:30] + ["other"] + first[31:]
    rows = [(1, " ".join(first)), (1, " ".join(first)), (2, " ".join(second))]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 3
    for r in got:
        assert (r.n_words, r.n_removed, r.kept) == brute(set(rows), 20)[r.doc_id], r.doc_id


def test_automaton():
    rnd = random.Random(5)
    automaton, known = SuffixAutomaton(), []
    for _ in range(60):
        words = [rnd.choice(b"abc") for _ in range(rnd.randrange(1, 12))]
        expected = []
        for end in range(1, len(words) + 1):
            fits = [n for n in range(end + 1) if any(words[end - n : end] == s[i : i + n] for s in known for i in range(len(s) - n + 1))]
            expected.append(max(fits, default=0))
        assert automaton.matches(words) == expected
        automaton.add(words)
        known.append(words)


def test_empty(spark):
    assert substring_dedup(spark.createDataFrame([], DOCS_SCHEMA)).count() == 0
