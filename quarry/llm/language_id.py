"""Language identification by prediction by partial matching.

For each language the labelled sample gives a tree of byte contexts of up to three bytes
with the counts of the bytes that follow.  A byte's probability comes from the longest
context that the language knows; a byte not seen there escapes to the next shorter one,
with the share of new symbols that the context has met as the escape probability, down to
all bytes alike.  The statistics are frozen: a text's code length under a language is the
sum over all its bytes, and the language with the shortest code wins.

Because nothing changes while scoring, each tree is kept as sorted arrays, for every order the
strings of context and byte with their code lengths and the contexts with those of an escape.
They hold what occurs and nothing else, under 1 MB a language here.  The
distinct strings of four bytes in some texts are looked up once each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bpe import portions
from quarry.llm.shared import table, written

ORDER = 3
#: Bound of the fit: labelled rows sampled for a language (their whole texts are used).
ROWS_PER_LANG = 1500
#: Stands before the first byte of a text.
PAD = b"\n" * ORDER
UNDETERMINED = "und"
#: Bytes that are looked up at a time.
STEP = 1 << 20


@dataclass
class Tree:
    """One language.  By order: strings of that many bytes and one more, as sorted numbers, with the code lengths of the last byte; the contexts, with those of an escape."""

    strings: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    def lengths(self, codes: np.ndarray) -> np.ndarray:
        """Code lengths of the last byte of each four, after the three before it."""
        out, left = np.zeros(len(codes)), np.arange(len(codes))
        for order in range(ORDER, -1, -1):
            some = codes[left] & ((1 << 8 * (order + 1)) - 1)
            place, known = _find(self.strings[order], some)
            out[left[known]] += self.bits[order][place[known]]
            left, some = left[~known], some[~known]
            place, met = _find(self.contexts[order], some >> 8)
            out[left[met]] += self.escapes[order][place[met]]
        out[left] += 8  # all bytes alike
        return out


def _find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    place = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return place, known[place] == wanted


@dataclass
class Model:
    langs: list[str]
    trees: list[Tree]

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        able = [i for i, t in enumerate(texts) if t and self.langs and any(map(str.isalpha, t))]
        out = [(UNDETERMINED, 0.0)] * len(texts)
        for i, total in zip(able, self._lengths([texts[i].encode() for i in able]), strict=True):
            best = int(total.argmin())
            out[i] = (self.langs[best], float(1 / np.exp2(np.maximum(total[best] - total, -1000)).sum()))
        return out

    def _lengths(self, texts: list[bytes]) -> np.ndarray:
        """The code length of each text, which is not empty, under each language; long texts in steps, for memory."""
        out = np.zeros((len(texts), len(self.langs)))
        # strings that begin in one text and end in the PAD of the next are left out
        data = np.frombuffer(PAD + PAD.join(texts), np.uint8)
        starts = np.cumsum([0, *(len(t) + ORDER for t in texts[:-1]), *([] if texts else [0])])[: len(texts)]
        for lo in range(0, len(data) - ORDER, STEP):
            codes = _codes(data[lo : lo + STEP + ORDER])
            found, of = np.unique(codes, return_inverse=True)
            text = np.searchsorted(starts, np.arange(lo, lo + len(codes)), "right") - 1
            inside = np.arange(lo, lo + len(codes)) - starts[text] < np.array([len(t) for t in texts])[text]
            for k, tree in enumerate(self.trees):
                out[:, k] += np.bincount(text, np.where(inside, tree.lengths(found)[of], 0), len(texts))
        return out


def _codes(data: np.ndarray) -> np.ndarray:
    """Each four bytes that follow each other, as a number."""
    b = data.astype(np.int64)
    return b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]


def sample(docs: DataFrame, per_lang: int = ROWS_PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, body: about per_lang of each language's rows, or all where there are fewer, by a hash of the id."""
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("body"), F.col(lang_col).cast("string").alias("lang")
    )
    # written, so that its size is known and the join need not move the texts to one task per language
    share = written(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n_rows")), "language-shares")
    drawn = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("language")), F.lit(1_000_000)) * F.col("n_rows") < F.lit(per_lang * 1_000_000)
    return rows.join(share, "lang").filter(drawn).select("lang", "body")


def count_contexts(labelled: DataFrame) -> DataFrame:
    """lang, code, n: how often each four bytes follow each other, code being them as a number."""

    def run(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for part, texts in portions(batch.column(1)):
                for lang in set(langs[part]):
                    codes = []
                    for t, of in zip(texts, langs[part], strict=True):
                        if of == lang:
                            codes.append(_codes(np.frombuffer(PAD + t.encode(), np.uint8)))
                    code, n = np.unique(np.concatenate(codes), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

    return labelled.mapInArrow(run, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def grow(code: np.ndarray, n: np.ndarray) -> Tree:
    """The tree of a language whose texts have each code n times."""
    strings, bits, contexts, escapes = [], [], [], []
    for order in range(ORDER + 1):
        found, of = np.unique(code & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
        count = np.bincount(of, n, len(found))
        context, inside = np.unique(found >> 8, return_inverse=True)
        total, distinct = np.bincount(inside, count, len(context)), np.bincount(inside, minlength=len(context))
        strings.append(found)
        bits.append(np.log2(total + distinct)[inside] - np.log2(count))
        contexts.append(context)
        escapes.append(np.log2(total + distinct) - np.log2(distinct))
    return Tree(strings, bits, contexts, escapes)


def learn(docs: DataFrame, per_lang: int = ROWS_PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The counts of a bounded sample, summed by Spark, come to the driver: a row for each distinct string of four bytes of a language."""
    found = count_contexts(sample(docs, per_lang, id_col, text_col, lang_col)).toArrow()
    lang = found["lang"].combine_chunks().dictionary_encode()
    lang = lang.combine_chunks() if isinstance(lang, pa.ChunkedArray) else lang
    names, of = lang.dictionary.to_pylist(), lang.indices.to_numpy(zero_copy_only=False)
    code, n = found["code"].to_numpy(), found["n"].to_numpy().astype(np.float64)
    order = sorted(range(len(names)), key=names.__getitem__)
    return Model([names[k] for k in order], [grow(code[of == k], n[of == k]) for k in order])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col, *keep, lang_pred, score`` for each row.

    The score is the probability of the language given the code lengths, all languages
    being equally likely before.  Null texts and texts without a letter get ``und`` and 0,
    as does every text if nothing could be learned; ties go to the first name in order.
    Null and repeated ids are carried along; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of the size of the sample's distinct strings

    def run(batches):
        for batch in batches:
            for part, texts in portions(batch.column(1)):
                lang, score = zip(*shared.value.score(texts), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], pa.array(lang), pa.array(score)], ["row", "lang_pred", "score"])

    rows = docs.select(F.struct(F.col(id_col).alias("c0"), *[F.col(k).alias(f"c{i}") for i, k in enumerate(keep, 1)]).alias("row"), F.col(text_col).alias("body"))
    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")
    return out.select(*[F.col(f"row.c{i}").alias(k) for i, k in enumerate((id_col, *keep))], "lang_pred", "score")


def op4_language_id(spark, sf_dir):
    """Learned from documents whose remainder is not 1; the others are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)))
    model = learn(docs.filter(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return predict(docs, model, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score")
