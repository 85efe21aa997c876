import random

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")

from quarry.llm.bpe import decode, default_vocabulary, encode, round_trip, vocabulary  # noqa: E402
from quarry.llm.token_counts import BLOCK, FULL, SumTree, clean_edits, count_batch, count_edited, edit_batch, edit_trees, edited_text, plant_batch, plant_trees  # noqa: E402

PIECES = ["the", " ", "  ", "\n", "ing", "é", "1", "23", "'s", "'", "!!", "日本", "😀", "qu", "Z", "'l", "l", "\x1c", "\x85", "\xa0", "<|endoftext|>", "<|endof", "-", "aaa"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(default_vocabulary())


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_as_the_library_does(library):
    wanted = texts(1500) + ["a" * 3000, " " * 300, ""]
    v = vocabulary(default_vocabulary())
    mine = [np.frombuffer(x, np.int32) for x in v.encode_batch(wanted)]
    theirs = library.encode_batch(wanted, add_special_tokens=False)
    assert [m.tolist() for m in mine] == [t.ids for t in theirs]
    assert [v.decode(m) for m in mine] == [library.decode(t.ids, skip_special_tokens=False) for t in theirs]


def test_every_character(library):
    v = vocabulary(default_vocabulary())
    for base in range(0, 0x30000, 0x4000):
        chars = [chr(c) for c in range(base, base + 0x4000, 3) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}1 {c}{c} b" for c in chars)
        assert np.frombuffer(v.encode_batch([text])[0], np.int32).tolist() == library.encode(text, add_special_tokens=False).ids


def test_documents(documents, library):
    rows = [(1, "Hello world"), (1, "Hello world"), (None, "x"), (2, None), (3, ""), (4, "wörd " * 40_000)]
    got = sorted(((r.doc_id or 0, r.ids, r.text) for r in round_trip(documents(rows)).collect()))
    assert got == sorted((i or 0, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows)
    assert encode(documents([])).count() == 0
    coded = encode(documents(rows)).withColumnRenamed("ids", "tokens")
    assert coded.columns == ["doc_id", "tokens"] and decode(coded, ids_col="tokens").count() == 6


def test_null_lists_decode_to_null(spark):
    coded = spark.createDataFrame([(1, [15496]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    assert sorted((r.doc_id, r.text) for r in decode(coded).collect() if r.text is not None) == [(1, "Hello"), (3, "")]


def test_edits_against_encoding_anew():
    v, rng = vocabulary(default_vocabulary()), random.Random(3)
    for t in texts(1500, 2):
        edits = []
        for _ in range(rng.randrange(4)):
            a = rng.randrange(len(t) + 1)
            edits.append({"start": a, "end": min(len(t), a + rng.randrange(5)), "text": "".join(rng.choice(PIECES) for _ in range(rng.randrange(3)))})
        edits = clean_edits(edits, len(t))
        pre, before, n, after, again = count_batch(v, [t], [edits])[0]
        assert (before, after) == tuple(len(x) // 4 for x in v.encode_batch([t, edited_text(t, edits)]))
        assert n == len(edits) and (again > 0) <= bool(edits)


def test_edits_far_from_most_words_recount_few():
    v = vocabulary(default_vocabulary())
    t = "some words " * 2000
    assert count_batch(v, [t], [[(9000, 9004, "new")]])[0][4] < 8


def test_counts_of_documents(spark, documents):
    rows = [(1, "write to me.you@mail.example.org or +49 30 1234567 now"), (2, None), (3, ""), (None, "plain"), (1, "plain"), (4, "long text " * 30_000)]
    v = vocabulary(default_vocabulary())
    got = {(r.doc_id, r.n_tokens): r for r in count_edited(documents(rows), None).collect()}
    masked = got[1, len(v.encode_batch([rows[0][1]])[0]) // 4]
    assert masked.n_edits == 2 and masked.n_tokens_edited == len(v.encode_batch(["write to <EMAIL> or <PHONE> now"])[0]) // 4
    assert sum(r.n_edits for r in got.values()) == 2 and len(got) == 6
    assert count_edited(documents([]), None).count() == 0
    own = spark.createDataFrame([(1, "abc def", [(0, 3, "xyz uvw"), (1, 2, "void"), (3, 99, "void"), (None, 2, "void")]), (2, "abc", None)],
                                "doc_id bigint, text string, changes array<struct<start:bigint,end:bigint,text:string>>")
    assert sorted((r.doc_id, r.n_edits, r.n_tokens_edited) for r in count_edited(own, "changes").collect()) == [(1, 1, len(v.encode_batch(["xyz uvw def"])[0]) // 4), (2, 0, 1)]


def test_sum_tree():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 7, 64, 101):
        counts = rng.integers(0, 9, n)
        tree = SumTree(counts)
        for _ in range(20):
            a = int(rng.integers(0, n))
            new = rng.integers(0, 9, int(rng.integers(1, n - a + 1)))
            counts[a : a + len(new)] = new
            tree.put(a, new)
            assert tree.total == counts.sum()


def random_edits(rng, text, most=4, longest=5, words=3):
    edits = []
    for _ in range(rng.randrange(most)):
        a = rng.randrange(len(text) + 1)
        edits.append({"start": a, "end": min(len(text), a + rng.randrange(longest)), "text": "".join(rng.choice(PIECES) for _ in range(rng.randrange(words)))})
    return clean_edits(edits, len(text))


def as_planted(v, text, tree):
    fresh = plant_batch(v, [text])[0]
    ends = np.cumsum(tree.blocks)
    sums = [int(tree.tokens[a:b].sum()) for a, b in zip(ends - tree.blocks, ends, strict=True)]
    assert tree.words.tolist() == fresh.words.tolist() and tree.tokens.tolist() == fresh.tokens.tolist()
    assert ends[-1] == len(tree.words) and max(tree.blocks) <= FULL * BLOCK
    assert [level.tolist() for level in tree.sums.levels] == [level.tolist() for level in SumTree(np.array(sums)).levels]


def test_many_batches_of_edits_on_one_tree():
    v, rng = vocabulary(default_vocabulary()), random.Random(5)
    for text in ["", *texts(20, 8), "".join(texts(60, 9)), "some words " * 900]:
        tree = plant_batch(v, [text])[0]
        for turn in range(12):
            edits = random_edits(rng, text, most=9, longest=(5, 300)[turn % 2], words=(3, 900)[turn % 4 == 3])
            (text,), _ = edit_batch(v, [text], [tree], [edits])
            as_planted(v, text, tree)


def test_only_regions_are_split_and_encoded(monkeypatch):
    v = vocabulary(default_vocabulary())
    text = "some words " * 2000
    tree = plant_batch(v, [text])[0]
    seen = []
    monkeypatch.setattr(v, "prepare", lambda lists: (seen.extend(w for words in lists for w in words), type(v).prepare(v, lists)))
    monkeypatch.setattr(v, "split", lambda text: pytest.fail("the whole text was split"))
    for edits in ([(9000, 9004, "new")], [(12, 13, "x"), (15000, 15000, " and")]):
        (text,), _ = edit_batch(v, [text], [tree], [edits])
    monkeypatch.undo()
    assert 0 < len(seen) < 20
    as_planted(v, text, tree)


def test_edits_on_stored_trees(spark, documents, tmp_path):
    v = vocabulary(default_vocabulary())
    rows = [(1, "abc def"), (1, "abc def"), (None, "x y z"), (2, None), (3, ""), (4, "wörd " * 40_000), (5, "a <|endoftext|> b")]
    fields = "array(named_struct('start', {}, 'end', {}, 'text', '{}'))"
    trees = plant_trees(documents(rows))
    for turn, (start, end, new) in enumerate([(0, 0, "new "), (2, 3, "w and")]):
        trees.write.parquet(str(tmp_path / str(turn)))
        stored = spark.read.parquet(str(tmp_path / str(turn)))
        trees = edit_trees(stored.selectExpr("*", fields.format(start, end, new) + " AS changes"), "changes")
        rows = [(i, edited_text(t or "", clean_edits([{"start": start, "end": end, "text": new}], len(t or "")))) for i, t in rows]
    got = trees.collect()
    key = lambda x: (x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(rows, key=key)
    assert all(r.n_tokens_edited == r.sums[-1] == sum(r.tokens) == len(v.encode_batch([r.text])[0]) // 4 and sum(r.words) == len(r.text) for r in got)
    assert all(r.n_recounted < 12 for r in got)
    assert edit_trees(plant_trees(documents([])), None).count() == 0
