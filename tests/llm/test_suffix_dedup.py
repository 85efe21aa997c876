import hashlib
import random

import numpy as np
import pytest

from quarry.llm import suffix_dedup
from quarry.llm.suffix_dedup import op3_suffix_array_dedup, repeated_strings


def brute(rows, length=100):
    """{id: (bytes, removed, spans, digest)} for rows with ids of their own."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        marks = np.zeros(len(raw) + 1, int)
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                marks[s] += 1
                marks[s + length] -= 1
            seen.add(w)
        gone = np.cumsum(marks)[:-1] > 0
        left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out[i] = (len(raw), int(gone.sum()), int((np.diff(np.concatenate([[0], gone, [0]]).astype(int)) == 1).sum()), hashlib.sha256(left).hexdigest())
    return out


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    shared = [" ".join(word() for _ in range(n)) for n in (12, 25, 60, 120)]
    out = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            s = rng.choice(shared)
            a = rng.randrange(0, max(1, len(s) - 90))
            parts += [" ".join(word() for _ in range(rng.randrange(1, 20))), s[a : a + rng.randrange(80, 400)]]
        out.append((i * 3, " ".join(parts)))
    return out


def found(spark, tmp_path, rows, documents):
    path = str(tmp_path / "documents.parquet")
    documents(rows).write.parquet(path)
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op3_suffix_array_dedup(spark, str(tmp_path)).collect()}


CASES = {
    "mixed": texts(1) + [(500, None), (501, ""), (502, "x" * 99), (503, "x" * 100), (504, "x" * 101), (505, "ab" * 700), (506, "q" * 100 + "r" + "q" * 100)],
    "copies": [(i, "the same words again and again, but not so often that it is long " * 3 + str(i % 3)) for i in range(200)],
    "none": [],
}


@pytest.mark.parametrize("case", CASES)
def test_against_brute_force(spark, tmp_path, documents, case):
    assert found(spark, tmp_path, CASES[case], documents) == brute(CASES[case])


def test_long_texts_in_pieces(spark, tmp_path, documents):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh ") for _ in range(600_000))
    rows = [(1, long), (2, "start " + long[1000:500_000] + " end"), (3, long[250_000:250_300] * 3)]
    assert found(spark, tmp_path, rows, documents) == brute(rows)


def test_ids(documents):
    """Without an id nothing is removed; rows with one id are not before each other; repeated rows are told once."""
    t = "".join(chr(97 + i * i % 26) for i in range(300))
    got = repeated_strings(documents([(None, t), (4, t), (4, t), (4, t + "z"), (9, t)])).collect()
    removed = {(r.doc_id, sum(s.end - s.start for s in r.spans)) for r in got}
    assert removed == {(4, brute([(4, t)])[4][1]), (9, 300)} and len(got) == 4


def test_a_string_has_one_of_the_sides():
    assert suffix_dedup.LENGTH - suffix_dedup.ANCHOR >= 2 * suffix_dedup.HALF - 1
