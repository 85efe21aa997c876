import hashlib
from collections import defaultdict

import pytest

from quarry.llm.exact_dedup import drop_exact_copies, exact_dedup


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[fold(t)].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[fold(t)] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[fold(t)]), i == keep, hashlib.sha256(fold(t).encode()).hexdigest()))
    return sorted(out, key=repr)


CASES = {
    "plain": [(1, "Abc"), (2, "aBC"), (3, "abd"), (4, "ÀB"), (5, "àb"), (6, "Àb")],
    "null and empty": [(1, None), (2, ""), (3, " "), (4, None)],
    "repeated rows and null ids": [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "z"), (None, "z")],
    "long": [(1, "x" * 300_000 + "A"), (2, "x" * 300_000 + "a"), (3, "x" * 300_000 + "b")],
    "one group": [(i, "same text") for i in range(500)],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("digest_all", [True, False])
def test_against_brute_force(documents, rows, case, digest_all):
    got = rows(exact_dedup(documents(CASES[case]), digest_all=digest_all))
    want = brute(CASES[case])
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[4] == w[4] or (not digest_all and g[4] is None and g[2] == 1)


def test_empty_table(documents):
    assert exact_dedup(documents([])).count() == 0
    assert drop_exact_copies(documents([])).count() == 0


def test_stage_keeps_columns_and_one_of_each(documents):
    docs = documents([(1, "A"), (2, "a"), (3, "b"), (None, "c"), (2, "other")])
    left = drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, "c"), (2, "a"), (2, "other"), (3, "b")]
