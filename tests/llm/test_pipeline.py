import numpy as np
import pytest

import corpus_pipeline
from quarry.llm.decontamination import drop_contaminated
from quarry.llm.exact_dedup import drop_exact_copies
from quarry.llm.minhash_dedup import drop_near_copies
from quarry.llm.shared import written

from .test_decontamination import words
from .test_exact_dedup import fold
from .test_minhash_dedup import sets_of

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def small(tmp_path_factory, spark):
    """Documents with copies, near copies, benchmark text and junk, and the other tables."""
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(600)]
    prose = lambda n: " ".join(rng.choice(vocabulary, n)).capitalize() + "."
    item = prose(30)
    rows = [(i, prose(60)) for i in range(160)]
    rows += [(200 + i, " ".join(f"{w.upper()}!!" for w in rng.choice(vocabulary, 40))) for i in range(60)]
    rows += [(300, rows[3][1].upper().swapcase()), (301, rows[4][1] + " Extra end."), (302, prose(20) + " " + item + " " + prose(20)), (303, rows[5][1].lower()), (None, prose(50)), (304, None)]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    labels = [(i, 1, 0) for i in range(0, 160, 2)] + [(200 + i, 0, 0) for i in range(0, 60, 2)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), rows


def test_stages_one_by_one(spark, small):
    d, rows = small
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.columns
    after = []
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, d), "stage")
        after.append({r.doc_id: r for r in docs.collect()})
        if len(after) < 5:
            assert docs.columns == names
    quality, exact, near, clean, coded = after
    assert not any(200 <= (i or 0) < 260 for i in quality) and sum(i in quality for i in range(160)) > 150
    # exact copies: of each text the largest id
    best = {}
    for i, r in quality.items():
        best[fold(r.text)] = max(best.get(fold(r.text), -1), -1 if i is None else i)
    assert {-1 if i is None else i for i in exact} == set(best.values())
    # near copies: of each linked group the smallest id
    sets = sets_of([(i, r.text) for i, r in exact.items() if i is not None], 5)
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            x, y = sets[a][0], sets[b][0]
            if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y):
                group = {k: (group[a] if g == group[b] else g) for k, g in group.items()} if group[a] < group[b] else {k: (group[b] if g == group[a] else g) for k, g in group.items()}
    assert set(near) == {i for i in group if group[i] == i} | ({None} & set(exact))
    item = words(spark.read.parquet(f"{d}/benchmark.parquet").first().text)
    windows = {tuple(item[s : s + 10]) for s in range(len(item) - 9)}
    dirty = {i for i, r in near.items() if any(tuple(words(r.text)[s : s + 10]) in windows for s in range(len(words(r.text)) - 9))}
    assert 302 in dirty and set(clean) == set(near) - dirty
    from quarry.llm.bpe import default_vocabulary

    library = tokenizers.Tokenizer.from_file(default_vocabulary())
    assert set(coded) == set(clean)
    for i, r in coded.items():
        assert r.ids == library.encode(clean[i].text or "", add_special_tokens=False).ids and r.decoded == (clean[i].text or "") and r.n_tokens == len(r.ids)


def test_run_is_the_stages(spark, small):
    d, _ = small
    whole = {r.doc_id for r in corpus_pipeline.run(spark, d).collect()}
    assert 302 not in whole and 301 not in whole and 300 in whole and not any(200 <= (i or 0) < 260 for i in whole)


def test_empty_documents(spark, small, documents):
    d, _ = small
    docs = documents([], clash=False)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, d), "stage")
    assert docs.count() == 0


@pytest.mark.parametrize("drop", [drop_exact_copies, drop_near_copies, lambda docs: drop_contaminated(docs, docs.selectExpr("doc_id AS item_id", "text").limit(1))])
def test_dropping_takes_the_same_way_at_any_size(documents, drop):
    """Ids to drop are not broadcast while they are few, as figures of small tables would then say nothing of large ones."""
    docs = documents([(i, f"some text of ten words or more that is number {i % 3} of a few") for i in range(9)])
    plan = drop(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
