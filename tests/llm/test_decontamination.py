import hashlib
import random
import re

import pytest

from quarry.llm.decontamination import decontaminate, drop_contaminated, exact_matches, proximity_matches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    windows = set()
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            windows.add((item, tuple(w[s : s + window])))
    out = []
    for i, text in docs:
        w, hit, met = words(text), set(), set()
        for item, x in windows:
            for s in range(len(w) - len(x) + 1):
                if tuple(w[s : s + len(x)]) == x:
                    hit.update(range(s, s + len(x)))
                    met.add(str(item))
        out.append((i, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture
def benchmark_of(spark):
    return lambda items: spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS term", "2 AS phrase")


def corpus():
    rng = random.Random(6)
    word = lambda: rng.choice(["the", "of", "a", "and", "to"] * 4 + [f"w{k}" for k in range(60)])
    items = [(k, " ".join(word() for _ in range(rng.randrange(1, 30)))) for k in range(25)]
    docs = []
    for i in range(80):
        text = [word() for _ in range(rng.randrange(0, 60))]
        if i % 3 == 0:
            got = rng.choice(items)[1].split()
            a = rng.randrange(0, max(1, len(got) - 12))
            text[5:5] = got[a : a + rng.randrange(5, 25)]
        docs.append((i, rng.choice([" ", ", ", "\n", "--"]).join(text).title()))
    return docs, items


def test_against_brute_force(documents, benchmark_of, rows):
    docs, items = corpus()
    assert rows(decontaminate(documents(docs), benchmark_of(items))) == brute(docs, items)


def test_edge_cases(documents, benchmark_of, rows):
    items = [(1, None), (2, ""), (3, "?!"), (4, "Short item"), (4, "Short item"), (5, "short ITEM"), (6, "x x x x x x x x x x x x"), (7, "ÉÀ über 9")]
    docs = [
        (1, None), (2, ""), (3, "a short-item short item"), (4, "x " * 30), (5, "x " * 9), (None, "short item"), (6, "short item"), (6, "short item"), (6, "x"),
        (7, "éà über 9 ÉÀ ÜBER 9 ÉÀ über 9"), (8, "short " * 40_000 + "item"),
    ]
    assert rows(decontaminate(documents(docs), benchmark_of(items))) == brute(docs, items)
    assert rows(decontaminate(documents(docs), benchmark_of([]))) == brute(docs, [])
    assert decontaminate(documents([]), benchmark_of(items)).count() == 0


def test_places(documents, benchmark_of):
    hits, windows = exact_matches(documents([(1, "one two three. Two three")]), benchmark_of([(9, "two three")]))
    assert sorted((s.start, s.n_words) for s in hits.first().starts) == [(1, 2), (3, 2)]
    assert [(r.item_id, r.phrase) for r in windows.collect()] == [(9, "two three")]


def test_proximity(documents, benchmark_of):
    docs = documents([(1, "gamma x beta y z alpha"), (2, "alpha beta"), (3, "alpha x x x x x x x x x beta gamma"), (4, None)])
    got = proximity_matches(docs, benchmark_of([(1, "alpha beta gamma")]), slop=3, window=3)
    assert sorted((r.doc_id, r.first_pos) for r in got.collect()) == [(1, 0)]


def test_stage(documents, benchmark_of):
    docs = documents([(1, "has short item"), (2, "clean"), (None, "short item"), (3, None)])
    left = drop_contaminated(docs, benchmark_of([(1, "short item")]))
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3]
