import zlib

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import language_id, quality

EN, DE = "the cat and the dog were with them in the house that they had ", "der hund und die katze waren nicht in dem haus das sie hatten "


def test_languages(spark, documents):
    rows = [(i, (EN if i % 2 else DE) * (1 + i % 3), "en" if i % 2 else "de") for i in range(40)] + [(90, None, "en"), (91, "x", None)]
    labelled = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.learn(labelled)
    assert model.langs == ["de", "en"]
    docs = documents([(1, "they were in that house"), (2, "sie waren in dem haus"), (3, None), (4, ""), (5, "12 345 !?"), (None, "the dog"), (7, EN * 60_000), (1, "und nicht")])
    got = sorted(((r.doc_id or 0, r.lang_pred) for r in language_id.predict(docs, model).collect()))
    assert got == [(0, "en"), (1, "de"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (7, "en")]
    assert language_id.predict(documents([]), model).count() == 0
    scores = [r.score for r in language_id.predict(docs, model).collect()]
    assert all(0 <= s <= 1 for s in scores)


def test_nothing_to_learn_from(spark, documents):
    model = language_id.learn(spark.createDataFrame([], "doc_id bigint, text string, lang string"))
    assert [tuple(r) for r in language_id.predict(documents([(1, "abc")]), model).collect()] == [(1, "und", 0.0)]


def code_length(text, train, order=3, data=None):
    """Bits of text under one language, straight from the definition."""
    counts = {}
    for d in data or [b"\n" * order + train.encode()]:
        for i in range(order, len(d)):
            for o in range(order + 1):
                c = counts.setdefault(d[i - o : i], {})
                c[d[i]] = c.get(d[i], 0) + 1
    raw, bits = b"\n" * order + text.encode(), 0.0
    for i in range(order, len(raw)):
        p = 1.0
        for o in range(order, -1, -1):
            c = counts.get(raw[i - o : i])
            if c is None:
                continue
            n, d = sum(c.values()), len(c)
            if raw[i] in c:
                p *= c[raw[i]] / (n + d)
                break
            p *= d / (n + d)
        else:
            p /= 256
        bits -= np.log2(p)
    return bits


def code_length_of_many(text, train):
    """As code_length, each training text beginning anew."""
    return code_length(text, None, data=[b"\n" * 3 + t.encode() for t in train])


def test_code_lengths_are_exact(spark, monkeypatch):
    rows = spark.createDataFrame([(1, EN, "en"), (2, DE, "de")], "doc_id bigint, text string, lang string")
    model = language_id.learn(rows)
    texts = ["the house", "das zebra! é", "q", "x" * 50 + EN]
    for step in (1 << 20, 7):
        monkeypatch.setattr(language_id, "STEP", step)
        got = model._lengths([t.encode() for t in texts])
        assert np.allclose(got, [[code_length(t, DE), code_length(t, EN)] for t in texts], rtol=1e-9)


def test_the_whole_query_against_the_definition(spark, tmp_path):
    """Held-out rows are not learned from; languages and scores are those of the plain code lengths; many languages lose no context."""
    rng = np.random.default_rng(3)
    letters = {k: rng.choice(list("abcdefghijklmnopqrstuvwxyzäöüß éñ"), 9) for k in ("aa", "bb", "cc", "dd", "ee")}
    rows = [(i, "".join(rng.choice(letters[k], 40)), k) for i, k in enumerate(list(letters) * 12)] + [(100, None, "aa"), (101, "... 12", "bb"), (102, "abc abc", None), (None, "bcd", "cc")]
    spark.createDataFrame([(*r, "s", 0) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in language_id.op4_language_id(spark, str(tmp_path)).collect()}
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows}
    assert {i: r.held_out for i, r in got.items()} == held
    train = {k: [t for i, t, lang in rows if lang == k and t and not held[i] and i is not None] for k in letters}
    for i, t, _ in rows:
        if not t or not any(c.isalpha() for c in t):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        bits = np.array([code_length_of_many(t, train[k]) for k in letters])
        assert got[i].lang_pred == list(letters)[bits.argmin()] and np.isclose(got[i].score, 1 / np.exp2(bits.min() - bits).sum(), rtol=1e-6)


def test_ties_go_to_the_first_name(spark, documents):
    model = language_id.learn(spark.createDataFrame([(1, "abc", "b"), (2, "abc", "a")], "doc_id bigint, text string, lang string"))
    assert [tuple(r) for r in language_id.predict(documents([(1, "abc")]), model).collect()] == [(1, "a", 0.5)]


def test_isotonic_and_ridge_against_dense_ones():
    """The fit's parts, summed by fold, are those of one dense system."""
    rng = np.random.default_rng(0)
    y = rng.random(30)
    got = quality.rising(np.arange(30.0), y, np.ones(30))
    best = [max(min(y[a : b + 1].mean() for b in range(i, 30)) for a in range(i + 1)) for i in range(30)]
    assert np.allclose(got, best)


def test_fit_against_one_dense_system(spark):
    """Weights, calibration and scores as numpy gives them from all rows at once."""
    texts = [(i, fine(i) if i % 3 else junk(i), float(i % 3 > 0)) for i in range(60)] * 2
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, label double")
    stats = quality.describe(docs.dropDuplicates(["doc_id"])).cache()
    labels = docs.dropDuplicates(["doc_id"]).select("doc_id", "label")
    model = quality.fit(stats, labels)
    by_id = {r.doc_id: r.stats for r in stats.collect()}
    label = {i: v for i, _, v in texts}
    fold = {r.doc_id: r.f for r in labels.selectExpr("doc_id", "CAST(pmod(xxhash64(CAST(doc_id AS STRING), 'fold'), 4) AS INT) AS f").collect()}
    ids = sorted(by_id)
    x, y, f = np.array([by_id[i] for i in ids]), np.array([label[i] for i in ids]), np.array([fold[i] for i in ids])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    assert np.allclose(model.mean, mean) and np.allclose(model.scale, scale)
    z = quality.random_cosines(x, mean, scale)

    def solved(keep):
        ridge = quality.PENALTY * np.eye(z.shape[1]) * max(1.0, keep.sum()) / quality.COSINES
        ridge[-1, -1] = 0
        return np.linalg.solve(z[keep].T @ z[keep] + ridge, z[keep].T @ y[keep])

    assert np.allclose(model.weights, solved(np.ones(len(y), bool)), atol=1e-6)
    raw = np.array([z[i] @ solved(f != f[i]) for i in range(len(y))])
    bins = np.rint(np.clip(raw, -1, 2) * quality.BINS).astype(int)
    at = np.unique(bins)
    want = quality.rising(at / quality.BINS, np.array([y[bins == b].mean() for b in at]), np.array([(bins == b).sum() for b in at], float))
    assert np.allclose(model.steps, at / quality.BINS) and np.allclose(model.levels, want)
    got = {r.doc_id: r.score for r in quality.score(stats, model).collect()}
    assert np.allclose([got[i] for i in ids], np.clip(np.interp(z @ model.weights, model.steps, model.levels), 0, 1))


def junk(i):
    return " ".join(f"W{i % 7}{k}!!" for k in range(40)) if i % 2 else "spam " * (30 + i % 9)


def fine(i):
    return " ".join(f"{w}{(i * k) % 13}" if k % 11 == 3 else w for k, w in enumerate((EN + DE).split()))


def test_quality_is_learned(spark, documents):
    docs = documents([(i, junk(i) if i % 3 == 0 else fine(i)) for i in range(300)] + [(900, None), (901, ""), (None, fine(5)), (902, fine(1) * 3000)])
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 else 1) for i in range(0, 300, 2)] + [(None, 1), (4, None)], "doc_id bigint, label int")
    scores, model = quality.quality_scores(docs, labels)
    got = {r.doc_id: r for r in scores.collect()}
    assert len(got) == 304 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert np.mean([got[i].predicted == (i % 3 != 0) for i in range(1, 300, 2)]) > 0.95
    left = quality.drop_poor(docs, labels)
    assert left.columns == docs.columns and left.filter("doc_id = 3").count() == 0 and left.filter("doc_id = 1").count() == 1


def test_quality_without_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id bigint, label int")
    docs = documents([(1, "a"), (2, None)])
    assert [r.score for r in quality.quality_scores(docs, none)[0].collect()] == [0.5, 0.5]
    assert quality.drop_poor(docs, none).count() == 2
    assert quality.quality_scores(documents([]), none)[0].count() == 0


def test_isotonic():
    assert quality.rising(np.arange(5.0), np.array([0.0, 1, 0, 1, 1]), np.ones(5)).tolist() == [0, 0.5, 0.5, 1, 1]


def test_gaussian_kernel_is_approximated():
    x = np.random.default_rng(0).normal(size=(40, len(quality.STATISTICS)))
    c = quality.random_cosines(x, np.zeros(x.shape[1]), np.ones(x.shape[1]))[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * x.shape[1]))
    assert np.abs(c @ c.T - exact).max() < 0.35 and np.abs(c @ c.T - exact).mean() < 0.06


def test_held_out_accuracy_on_the_given_tables(spark):
    from quarry.llm.language_id import op4_language_id
    from quarry.llm.quality import op10_quality_classifier

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    got = op4_language_id(spark, d).filter("held_out").join(docs, "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    labels = spark.read.parquet(f"{d}/labels.parquet")
    scored = op10_quality_classifier(spark, d).filter("held_out").join(labels, "doc_id")
    assert scored.agg(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0] > 0.93
