import random
from collections import defaultdict

import pytest

from quarry.llm.components import components
from quarry.llm.minhash_dedup import drop_near_copies, least_matches, near_duplicates, shingles


def sets_of(rows, n):
    out = defaultdict(list)
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i].append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    return out


def brute(rows, n, percent):
    sets = sets_of([r for r in rows if r[0] is not None], n)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b] if x and y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    flat = sets_of(rows, n)
    seen = defaultdict(int)
    out = []
    for i, _ in rows:
        k = seen[i]
        seen[i] += 1
        out.append((i, len(flat[i][k]), None if i is None else find(i), i is None or find(i) == i))
    return sorted(out, key=repr)


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(9999)}"
    return " ".join(words)


def corpus():
    rng = random.Random(4)
    rows, i = [], 0
    for _ in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(30, 200))]
        for _ in range(rng.randrange(1, 9)):
            rows.append((i, changed(rng, base, rng.randrange(0, 7))))
            i += rng.randrange(1, 4)
    hot = [f"h{rng.randrange(500)}" for _ in range(120)]
    rows += [(1000 + k, changed(rng, hot, 1 + k % 3)) for k in range(60)]
    return rows


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_against_brute_force(documents, rows, n, percent):
    assert rows(near_duplicates(documents(corpus()), n, percent)) == brute(corpus(), n, percent)


def test_edge_cases(documents, rows):
    case = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two"), (7, "one two"), (None, "one two"), (None, None),
        (8, "É a b c"), (9, "é a b c"), (10, "a b c d " * 30_000), (11, "a b c d " * 30_000 + "a"),
    ]
    assert rows(near_duplicates(documents(case), 3, 85)) == brute(case, 3, 85)
    assert near_duplicates(documents([])).count() == 0


def test_stage(documents):
    docs = documents([(5, "a b c d e f g h"), (3, "a b c d e f g h"), (9, "x y z"), (None, "a b c d e f g h")])
    left = drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 3, 9]


def test_odds_of_missing():
    assert least_matches(85) == 41 and least_matches(80) == 36
    assert len(shingles("a b", 3)) == 1 and len(shingles("", 3)) == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (100, 101)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}
