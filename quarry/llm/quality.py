"""Quality scores: a Gaussian kernel approximated by random Fourier features.

Statistics of each whole text (one pass over the documents, written as a narrow table) are
standardised and mapped to random cosines whose inner products approximate a Gaussian
kernel.  Every task sums its rows' part of the normal equations, Spark adds these up by
fold, and the driver solves systems of a fixed size for ridge weights.  Scores that the
other folds give a labelled row are calibrated by isotonic regression over score bins.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bpe import portions
from quarry.llm.shared import table, whole_text, written

#: Bound of the fit: labelled rows sampled.  Size of the fixed systems: cosines, folds; ridge penalty; bins for calibration.
FIT_ROWS, COSINES, FOLDS, PENALTY, BINS = 40_000, 256, 4, 1e-2, 1000
SEED, ACCEPT = 7, 0.7
STATISTICS = (
    "log_bytes", "upper", "lower", "digit", "blank", "newline", "wide", "stop", "loud", "symbol", "bar", "other_mark", "entropy",
    "log_words", "word_length", "distinct", "again", "most_frequent", "pairs", "squeezed", "line_length", "same_lines", "marked_words",
)


def _byte_classes() -> np.ndarray:
    of = np.full(256, 9, np.int64)
    for k, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n\r", b"", b".,;:'-", b"!?", b"#$%&*@^~+=<>_\\")):
        of[list(chars)] = k
    of[128:] = 5
    of[ord("|")] = 10
    return of


_CLASS = _byte_classes()


def statistics(text: str) -> list[float]:
    """Numbers that describe a whole text; an empty one gets zeros."""
    raw = text.encode()
    if not raw:
        return [0.0] * len(STATISTICS)
    n = len(raw)
    bytes_seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, bytes_seen, 11) / n
    share = bytes_seen[bytes_seen > 0] / n
    words = text.split()
    m = max(1, len(words))
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x]
    packer = zlib.compressobj(1)
    squeezed = sum(len(packer.compress(raw[i : i + (1 << 20)])) for i in range(0, n, 1 << 20)) + len(packer.flush())
    return [
        np.log1p(n), kinds[0], kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7], kinds[8], kinds[10], kinds[9],
        float(-(share * np.log2(share)).sum()),
        np.log1p(len(words)), (n - len(words)) / m, len(seen) / m, sum(map(str.__eq__, words, words[1:])) / m, max(seen.values(), default=0) / m,
        len(set(zip(words, words[1:]))) / m, squeezed / n, float(np.log1p(n / max(1, len(lines)))), 1 - len(set(lines)) / max(1, len(lines)),  # noqa: B905
        sum(not w[-1].isalnum() for w in words) / m,
    ]


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, stats``: the statistics of each row's whole text, null as empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part, texts in portions(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part.start : part.stop], pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))], ["doc_id", "stats"]
                )

    return docs.select(F.col(id_col), whole_text(text_col).alias("body")).mapInArrow(run, f"doc_id {kind}, stats array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # raw scores, rising
    levels: np.ndarray  # calibrated ones

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        return random_cosines(stats, self.mean, self.scale)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.cosines(stats) @ self.weights, self.steps, self.levels), 0, 1)


def random_cosines(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    d = stats.shape[1]
    directions, phases = rng.normal(0, 1 / np.sqrt(d), (d, COSINES)), rng.uniform(0, 2 * np.pi, COSINES)
    z = np.clip((stats - mean) / scale, -8, 8)
    return np.hstack([np.sqrt(2 / COSINES) * np.cos(z @ directions + phases), np.ones((len(stats), 1))])


def rising(scores: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Isotonic regression: the rising levels nearest to labels, which are in the order of scores."""
    level, mass, length = [], [], []
    for y, w in zip(labels, weight, strict=True):
        level.append(y), mass.append(w), length.append(1)
        while len(level) > 1 and level[-2] >= level[-1]:
            y, w, k = level.pop(), mass.pop(), length.pop()
            level[-1] = (level[-1] * mass[-1] + y * w) / (mass[-1] + w)
            mass[-1] += w
            length[-1] += k
    return np.repeat(level, length)


def _matrix(batch: pa.RecordBatch, col: int) -> np.ndarray:
    return batch.column(col).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), len(STATISTICS))


def fit(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """stats: ``doc_id, stats``; labels: ``doc_id, label`` (0 or 1).  None without labelled rows.

    Rows with a null id or label are left out.  At most about fit_rows of the labelled
    rows are used, drawn by a hash of their id, so all that reaches the driver is of fixed
    size: moments, normal equations, score bins.
    """
    labels = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").select("doc_id", F.col("label").cast("double").alias("label"))
    n = labels.count()
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality")), F.lit(1_000_000)) * F.lit(n) < F.lit(fit_rows * 1_000_000)
    fold = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")
    rows = written(stats.join(labels.filter(drawn), "doc_id").select(fold, "stats", "label"), "quality-fit")
    d = len(STATISTICS)
    moments = rows.select(*[F.col("stats")[i].alias(f"s{i}") for i in range(d)]).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f"s{i}").alias(f"m{i}") for i in range(d)], *[F.stddev_pop(f"s{i}").alias(f"v{i}") for i in range(d)]
    ).first()
    if not moments["n"]:
        return None
    mean = np.array([moments[f"m{i}"] for i in range(d)])
    scale = np.array([max(moments[f"v{i}"], 1e-6) for i in range(d)])
    size = COSINES + 2  # the cosines, the constant, the label

    def partial(batches):
        sums = np.zeros((FOLDS, size, size))
        for batch in batches:
            x = np.hstack([random_cosines(_matrix(batch, 1), mean, scale), batch.column(2).to_numpy()[:, None]])
            f = batch.column(0).to_numpy()
            for k in range(FOLDS):
                sums[k] += x[f == k].T @ x[f == k]
        yield pa.RecordBatch.from_arrays([pa.array(range(FOLDS), pa.int32()), pa.array([s.tobytes() for s in sums], pa.binary())], ["fold", "sums"])

    def add(key, group):
        total = sum(np.frombuffer(b.as_py()) for b in group["sums"])
        return pa.table({"fold": [key[0].as_py()], "sums": [total.tobytes()]}, pa.schema([("fold", pa.int32()), ("sums", pa.binary())]))

    kind = "fold int, sums binary"
    added = rows.coalesce(32).mapInArrow(partial, kind).groupBy("fold").applyInArrow(add, kind).collect()
    by_fold = {r["fold"]: np.frombuffer(r["sums"]).reshape(size, size) for r in added}
    whole = sum(by_fold.values())

    def solve(sums: np.ndarray) -> np.ndarray:
        ridge = PENALTY * np.eye(size - 1) * max(1.0, sums[-2, -2]) / COSINES
        ridge[-1, -1] = 0
        return np.linalg.lstsq(sums[:-1, :-1] + ridge, sums[:-1, -1], rcond=None)[0]

    apart = np.stack([solve(whole - by_fold[k]) if k in by_fold and (whole - by_fold[k])[-2, -2] else solve(whole) for k in range(FOLDS)])

    def out_of_fold(batches):
        for batch in batches:
            x = random_cosines(_matrix(batch, 1), mean, scale)
            s = (x * apart[batch.column(0).to_numpy()]).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(np.rint(np.clip(s, -1, 2) * BINS).astype(np.int32)), batch.column(2)], ["bin", "label"])

    bins = rows.mapInArrow(out_of_fold, "bin int, label double").groupBy("bin").agg(F.avg("label").alias("y"), F.count(F.lit(1)).alias("w")).orderBy("bin").collect()
    at = np.array([b["bin"] / BINS for b in bins])
    return Model(mean, scale, solve(whole), at, rising(at, np.array([b["y"] for b in bins]), np.array([float(b["w"]) for b in bins])))


def score(stats: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, score, predicted``; without a model every score is 0.5."""
    kind = stats.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            s = np.full(len(batch), 0.5) if model is None else model.score(_matrix(batch, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= ACCEPT).astype(np.int32))], ["doc_id", "score", "predicted"])

    return stats.select("doc_id", "stats").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> tuple[DataFrame, Model | None]:
    """Scores of all rows of docs by what labels (``doc_id, label``) teach, and the model.

    Null and empty texts are scored as such; null ids are scored but never learned from;
    each of repeated rows is scored, and each of repeated labels learned from; with no
    documents there are no rows.  Extra columns are ignored.
    """
    stats = written(describe(docs, id_col, text_col), "quality-stats")
    model = fit(stats, labels, fit_rows)
    return score(stats, model), model


def drop_poor(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that are predicted to be poor; without any label all stay.

    Rows that share an id go if one of them is poor.
    """
    scores, model = quality_scores(docs, labels, id_col, text_col)
    if model is None:
        return docs
    poor = written(scores.filter("predicted = 0").select(F.col("doc_id").alias("poor_id")).distinct(), "quality-poor")
    return docs.alias("d").join(poor.alias("x"), F.col(f"d.`{id_col}`").eqNullSafe(F.col("x.poor_id")), "left_anti")


def op10_quality_classifier(spark, sf_dir):
    """Learned from labels whose remainder is not 2; the others are held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    labels = table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", F.col("quality").alias("label"))
    scores, _ = quality_scores(table(spark, sf_dir, "documents"), labels)
    return scores.select("doc_id", held_out.alias("held_out"), "score", "predicted")
