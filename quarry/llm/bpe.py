"""BPE encoding and decoding by prefix-sharing trie traversal.

A byte pair encoding has one last token for every prefix of a word: the longest known
token ending there that fits behind the last token of what precedes it.  So the distinct
words of a batch are walked as a trie, depth first (in sorted order the path in common with
the word before is the trie's stack), last tokens are carried down the branches, and the
state of a prefix that words share is computed once.  The known tokens that end at each byte
of a word are told by one step of an Aho-Corasick automaton.  Words seen before come from a
bounded store in the Python worker.  Spark splits the documents; nothing but the vocabulary (of
fixed size) is shared, so a lost executor costs its own tasks only.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import table, whole_text

#: Words that a worker keeps encoded, in each of two generations (and half as many as it keeps pairs of tokens), and bytes of text that it works on at a time.
KEPT_WORDS, BATCH_BYTES = 120_000, 2_000_000
#: The split into words that the vocabulary was built for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of single bytes, which re splits in half the time.
PATTERN_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
NEVER = 1 << 40


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others in turn from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level vocabulary with its merges, and the words it has encoded lately."""

    def __init__(self, path: str):
        import re

        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = {i: bytes(letters[c] for c in t) for t, i in ids.items()}
        self.bytes_of = [b""] * (1 + max([*raw, *self.special.values()]))
        for i, b in raw.items():
            self.bytes_of[i] = b
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.rank: dict[int, int] = {}
        self.made_of: dict[int, tuple[int, int, int]] = {}
        for n, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[ids[a] << 20 | ids[b]] = n
            self.made_of.setdefault(ids[a + b], (ids[a], ids[b], n))
        # a letter for each byte, as the automaton takes texts
        self.ends = ahocorasick.Automaton()
        for i, b in raw.items():
            if len(b) == 1 or i in self.made_of:
                self.ends.add_word(b.decode("latin-1"), (len(b), i))
        self.ends.make_automaton()
        self.splits = regex.compile(PATTERN), re.compile(PATTERN_ASCII, re.ASCII)
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _edge(self, i: int, side: int) -> list[tuple[int, int]]:
        """The pieces at a token's right (1) or left edge while it is merged, each with the rank of the merge that takes it up."""
        edge = [(i, NEVER)]
        while i in self.made_of:
            edge.append((self.made_of[i][side], self.made_of[i][2]))
            i = self.made_of[i][side]
        return edge[::-1]

    def _fit(self, a: int, b: int) -> bool:
        """Do a and b, each merged by itself, stay two tokens when they meet?"""
        x, y, i, j = self._edge(a, 1), self._edge(b, 0), 0, 0
        while True:
            (p, until_p), (q, until_q) = x[i], y[j]
            across = self.rank.get(p << 20 | q, NEVER)
            if across < until_p and across <= until_q and across != NEVER:
                return False
            if until_p == until_q == NEVER:
                return True
            if until_p <= until_q:
                i += 1
            else:
                j += 1

    def _walk(self, words: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Each of the sorted words with its tokens."""
        last: list[int] = [-1]  # last[d]: the last token of the current path's first d bytes
        before = b""
        fits, bytes_of, tokens_of = self.fits, self.bytes_of, self.ends.iter
        for word in words:
            n, shared = len(word), 0
            for x, y in zip(word, before):  # noqa: B905
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :]
            settled = shared
            for end, (length, token) in tokens_of(word.decode("latin-1")):  # of those that end at one byte the longest comes first
                if end < settled:
                    continue
                if length <= end:
                    pair = last[end + 1 - length] << 20 | token
                    fit = fits.get(pair)
                    if fit is None:
                        fit = fits[pair] = self._fit(pair >> 20, token)
                    if not fit:
                        continue
                last.append(token)
                settled = end + 1
            if settled < n:
                raise ValueError(f"no token of the vocabulary ends {word[: settled + 1]!r}")
            out, d = [], n
            while d:
                out.append(last[d])
                d -= len(bytes_of[last[d]])
            out.reverse()
            yield word, out
            before = word

    def learn(self, words: Iterable[str]) -> None:
        """Encode the words that are not known yet; when there are many, those not met lately are let go."""
        if len(self.known) > KEPT_WORDS:
            self.known, self.older = {}, self.known
        if len(self.fits) > 2 * KEPT_WORDS:
            self.fits.clear()
        known, older, new = self.known, self.older, {}
        for w in words:
            if w not in known:
                if (tokens := older.get(w)) is None:
                    new[w.encode()] = w
                else:
                    known[w] = tokens
        for word, tokens in self._walk(sorted(new)):
            known[new[word]] = array("i", tokens).tobytes()

    def split(self, text: str) -> list[str]:
        """The words of text; special tokens stand as words of their own."""
        one = lambda t: self.splits[t.isascii()].findall(t)
        if self.at_special is None or not any(s in text for s in self.special):
            return one(text)
        return [w for i, part in enumerate(self.at_special.split(text)) for w in ([part] if i % 2 else one(part))]

    def prepare(self, lists: list[list[str]]) -> None:
        self.learn(set().union(*lists))
        for t, i in self.special.items():
            self.known[t] = np.array([i], np.int32).tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The tokens of each text as int32 in bytes."""
        lists = [self.split(t) for t in texts]
        self.prepare(lists)
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in lists]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One for each worker process."""
    return Vocabulary(path)


def portions(column: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[slice, list]]:
    """The texts of an Arrow column, about so many bytes at a time but one text at least, each time with their places."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield slice(start, stop), column.slice(start, stop - start).to_pylist()
        start = stop


def _type(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def _coded(vocab: Vocabulary, column: pa.Array) -> Iterator[tuple[slice, pa.ListArray, np.ndarray, np.ndarray]]:
    """A portion of the texts at a time: its place, the token lists, the tokens in one row and the ends of the lists."""
    for part, texts in portions(column):
        coded = vocab.encode_batch(texts)
        ends, flat = np.cumsum([0, *(len(c) // 4 for c in coded)]), np.frombuffer(b"".join(coded), np.int32)
        yield part, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), flat, ends


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``id_col, ids``: the tokens of each whole text, special tokens in a text included.

    Null text counts as empty and has no tokens.  Null and repeated ids are carried along
    row by row; an empty table gives no rows; other columns are ignored.
    """
    path = path or default_vocabulary()
    rows = docs.select(F.col(id_col), whole_text(text_col).alias("body"))

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            for part, ids, _, _ in _coded(vocab, batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], ids], ["id", "ids"])

    return rows.mapInArrow(run, f"id {_type(docs, id_col)}, ids array<int>").withColumnRenamed("id", id_col)


def decode(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``id_col, text``: what the tokens spell, special ones included; null for a null list."""
    path = path or default_vocabulary()

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            lists, flat = batch.column(1), batch.column(1).values.to_numpy(zero_copy_only=False)
            bounds = lists.offsets.to_numpy()
            whole = lists.is_valid().to_pylist()
            for part in range(0, len(batch), 256):
                at = range(part, min(part + 256, len(batch)))
                texts = [vocab.decode(flat[bounds[i] : bounds[i + 1]]) if whole[i] else None for i in at]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at.start : at.stop], pa.array(texts, pa.string())], ["id", "text"])

    return coded.select(id_col, ids_col).mapInArrow(run, f"id {_type(coded, id_col)}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``id_col, ids, text``: tokens with what these decode to, by one Python worker a task; rows as in `encode`."""
    path = path or default_vocabulary()
    rows = docs.select(F.col(id_col), whole_text(text_col).alias("body"))

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            for part, ids, flat, ends in _coded(vocab, batch.column(1)):
                texts = [vocab.decode(flat[lo:hi]) for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], ids, pa.array(texts, pa.string())], ["id", "ids", "text"])

    return rows.mapInArrow(run, f"id {_type(docs, id_col)}, ids array<int>, text string").withColumnRenamed("id", id_col)


def op8_bpe_encoding(spark, sf_dir):
    """The digests that stand for each document's tokens and for what they decode to."""
    rows = round_trip(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
