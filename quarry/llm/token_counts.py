"""Token counts that follow edits.

A document keeps, in a table, its pre-tokens' lengths and token counts, in blocks that are
the leaves of a segment tree of token counts.  An edit re-splits the text from the last
pre-token that cannot have seen the edit (the split looks at most two characters past a
pre-token's end) until a boundary after the edit is a boundary of the old text too; from
there on the old pre-tokens stand, because the split has no memory.  What lies in between is
encoded and put into its block, and the sums above that block are updated.  The result is a
table of the same form, which the next edits are applied to.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bpe import Vocabulary, default_vocabulary, portions, vocabulary
from quarry.llm.shared import table, whole_text, written

#: Characters past its end that the split of a pre-token can depend on.
AHEAD = 2
#: What the registered query's edits replace, and by what.
REDACTIONS = (
    (r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}\.[A-Za-z0-9.-]{2,63}", "<EMAIL>"),
    (r"\+?[0-9][0-9() -]{7,18}[0-9]", "<PHONE>"),
    (r"AKIA[A-Z0-9]{16,}", "<KEY>"),
)
EDITS = "array<struct<start:bigint,end:bigint,text:string>>"
#: Pre-tokens in a block at first, and so many times that before a tree is shaped anew.
BLOCK, FULL = 32, 8
#: A document's state: characters and tokens of each pre-token, pre-tokens of each block, and the tree's sums, level by level from the blocks up.
LISTS = {"words": pa.int32(), "tokens": pa.int32(), "blocks": pa.int32(), "sums": pa.int64()}
STATE = "text string, words array<int>, tokens array<int>, blocks array<int>, sums array<bigint>"


class SumTree:
    """Sums over a row of counts, level by level."""

    def __init__(self, counts: np.ndarray):
        self.levels = [counts.astype(np.int64)]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(np.add.reduceat(below, np.arange(0, len(below), 2)))

    @classmethod
    def loaded(cls, flat: np.ndarray, n: int) -> SumTree:
        """A tree over n counts from its levels put end to end."""
        tree, at = cls.__new__(cls), n
        tree.levels = [flat[:n].copy()]
        while n > 1:
            n = (n + 1) // 2
            tree.levels.append(flat[at : at + n].copy())
            at += n
        return tree

    @property
    def total(self) -> int:
        return int(self.levels[-1][0]) if len(self.levels[-1]) else 0

    def put(self, first: int, counts: np.ndarray) -> None:
        """Set the counts from the leaf first on, and the sums above them."""
        self.levels[0][first : first + len(counts)] = counts
        lo, hi = first, first + len(counts) - 1
        for below, above in zip(self.levels, self.levels[1:], strict=False):
            lo, hi = lo // 2, hi // 2
            above[lo : hi + 1] = np.add.reduceat(below[2 * lo : 2 * hi + 2], np.arange(0, min(2 * hi + 2, len(below)) - 2 * lo, 2))


class TokenTree:
    """Pre-tokens of a text, in blocks under a tree of token counts."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, blocks: np.ndarray, sums: SumTree):
        self.words, self.tokens, self.blocks, self.sums = words, tokens, blocks, sums

    @classmethod
    def planted(cls, words: np.ndarray, tokens: np.ndarray) -> TokenTree:
        starts = np.arange(0, max(1, len(words)), BLOCK)
        counts = np.add.reduceat(tokens, starts) if len(tokens) else np.zeros(1, np.int64)
        return cls(words, tokens, np.diff(np.append(starts, len(words))), SumTree(counts))

    def replace(self, first: int, stop: int, words: np.ndarray, tokens: np.ndarray) -> None:
        """Put other pre-tokens in the place of those from first to stop, all into the first block that is touched."""
        after, last = np.cumsum(self.blocks), len(self.blocks) - 1
        lo = min(int(np.searchsorted(after, first, "right")), last)
        hi = max(lo, int(np.searchsorted(after, stop)))
        begin = int(after[lo] - self.blocks[lo])
        self.words = np.concatenate([self.words[:first], words, self.words[stop:]])
        self.tokens = np.concatenate([self.tokens[:first], tokens, self.tokens[stop:]])
        sizes, counts = np.zeros(hi - lo + 1, np.int64), np.zeros(hi - lo + 1, np.int64)
        sizes[0] = after[hi] - begin - (stop - first) + len(words)
        counts[0] = self.tokens[begin : begin + sizes[0]].sum()
        self.blocks = np.concatenate([self.blocks[:lo], sizes, self.blocks[hi + 1 :]])
        self.sums.put(lo, counts)
        if sizes[0] > FULL * BLOCK:
            self.__dict__.update(vars(self.planted(self.words, self.tokens)))

    def lists(self) -> tuple[np.ndarray, ...]:
        return self.words, self.tokens, self.blocks, np.concatenate(self.sums.levels)


def clean_edits(edits: list[dict] | None, length: int) -> list[tuple[int, int, str]]:
    """Edits in order within the text; of overlapping ones the first stands, and null fields make an edit void."""
    out, at = [], 0
    for e in sorted((e for e in edits or [] if e and e["start"] is not None and e["end"] is not None and e["text"] is not None), key=lambda e: (e["start"], e["end"])):
        if at <= e["start"] <= e["end"] <= length:
            out.append((e["start"], e["end"], e["text"]))
            at = max(e["end"], e["start"] + (e["end"] == e["start"]))
    return out


def edited_text(text: str, edits: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for start, end, new in edits:
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]])


def changes(vocab: Vocabulary, text: str, bounds: np.ndarray, edits: list[tuple[int, int, str]]) -> list[tuple[int, int, list[str]]]:
    """(first leaf, leaf after the last, new pre-tokens) for each region that edits touch; bounds are the old pre-tokens' ends."""
    new = edited_text(text, edits)
    ends = bounds.tolist()
    match = vocab.splits[new.isascii()].match
    out, i, shift = [], 0, 0
    while i < len(edits):
        first = bisect_right(ends, edits[i][0] - AHEAD)  # the first leaf that may have seen the edit
        begin = ends[first - 1] if first else 0
        at, words, met = begin + shift, [], i
        while True:
            while i < len(edits) and edits[i][0] - AHEAD <= at - shift:  # edits that the region has come to
                shift += len(edits[i][2]) - (edits[i][1] - edits[i][0])
                i += 1
            old = at - shift
            k = bisect_left(ends, old)
            settled = i > met and old >= edits[i - 1][1]
            if settled and (not ends or k < len(ends) and ends[k] == old) and (i == len(edits) or edits[i][0] - AHEAD > old):
                out.append((first, k + 1, words))
                break
            w = match(new, at)[0]
            words.append(w)
            at += len(w)
    return out


def redactions(texts: list[str]) -> list[list[dict]]:
    """An edit for each stretch of personal data or secret in each text."""
    rules = [(re.compile(p), to) for p, to in REDACTIONS]
    return [[{"start": m.start(), "end": m.end(), "text": to} for rule, to in rules for m in rule.finditer(t)] for t in texts]


def _counts(vocab: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of each word; all must be prepared."""
    known = vocab.known
    return np.fromiter(map(len, words), np.int64, len(words)), np.fromiter((len(known[w]) // 4 for w in words), np.int64, len(words))


def plant_batch(vocab: Vocabulary, texts: list[str]) -> list[TokenTree]:
    lists = [vocab.split(t) for t in texts]
    vocab.prepare(lists)
    return [TokenTree.planted(*_counts(vocab, words)) for words in lists]


def edit_batch(vocab: Vocabulary, texts: list[str], trees: list[TokenTree], edits: list[list[tuple[int, int, str]]]) -> tuple[list[str], list[int]]:
    """The edited texts, and how many pre-tokens were encoded anew for each; the trees are updated."""
    news, moved = [], []
    for t, tree, e in zip(texts, trees, edits, strict=True):
        news.append(edited_text(t, e) if e else t)
        if not e:
            moved.append([])
        elif any(s in x for x in (t, news[-1], *(n for _, _, n in e)) for s in vocab.special):
            moved.append([(0, len(tree.words), vocab.split(news[-1]))])
        else:
            moved.append(changes(vocab, t, np.cumsum(tree.words), e))
    vocab.prepare([words for m in moved for _, _, words in m])
    for tree, m in zip(trees, moved, strict=True):
        n = len(tree.words)
        for first, stop, words in reversed(m):  # from the end, so that places before stay as they are
            tree.replace(first, min(stop, n), *_counts(vocab, words))
    return news, [sum(len(words) for _, _, words in m) for m in moved]


def _stored(rows: list[tuple[np.ndarray, ...]]) -> list[pa.Array]:
    """The columns of trees, each a list for each document."""
    out = []
    for column, kind in zip(zip(*rows, strict=True), LISTS.values(), strict=True):
        ends = np.cumsum([0, *map(len, column)])
        out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(column), kind)))
    return out


def _loaded(columns: list[pa.Array]) -> list[TokenTree]:
    rows = []
    for column in columns:
        ends, values = column.offsets.to_pylist(), column.values.to_numpy(zero_copy_only=False)
        rows.append([values[a:b] for a, b in zip(ends, ends[1:], strict=False)])
    return [TokenTree(w, t, b, SumTree.loaded(s, len(b))) for w, t, b, s in zip(*rows, strict=True)]


def plant_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None, path: str | None = None) -> DataFrame:
    """The trees of documents: ``id_col, text, words, tokens, blocks, sums``, and ``edits`` if a column of them is named.

    A null text counts as empty, and has one block of no pre-tokens.  Null and repeated ids
    are carried along row by row, other columns are left out, and an empty table gives no rows.
    """
    path = path or default_vocabulary()
    more = [F.col(edits_col).cast(EDITS).alias("edits")] if edits_col else []
    kept = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("body"), *more)

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            for part, texts in portions(batch.column(1)):
                given = [c.slice(part.start, part.stop - part.start) for c in batch.columns]
                columns = _stored([tree.lists() for tree in plant_batch(vocab, texts)])
                yield pa.RecordBatch.from_arrays([*given[:2], *columns, *given[2:]], ["id", "text", *LISTS, *(["edits"] if edits_col else [])])

    kind = docs.schema[id_col].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, {STATE}" + (f", edits {EDITS}" if edits_col else "")).withColumnRenamed("id", id_col)


def edit_trees(trees: DataFrame, edits_col: str | None, id_col: str = "doc_id", path: str | None = None, state: bool = True) -> DataFrame:
    """Trees after the edits of each row, ``(start, end, text)`` in characters of its text as stored, with ``n_pretokens, n_tokens`` from
    before, ``n_edits, n_tokens_edited`` and ``n_recounted`` (pre-tokens that were encoded for the edits); without state, the numbers alone.

    Without an edits column the edits are `redactions` of the text.  A null list is no edits;
    edits with null fields, outside the text or overlapping an earlier one are left out.  A
    text with special tokens in it is split there, as the encoder does, and encoded as a
    whole if it has edits.  Rows without edits stay as they are; an empty table gives no rows.
    """
    path = path or default_vocabulary()
    kept = trees.select(F.col(id_col).alias("id"), "text", *LISTS, *([F.col(edits_col).cast(EDITS).alias("edits")] if edits_col else []))

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            for part, texts in portions(batch.column(1)):
                given = [c.slice(part.start, part.stop - part.start) for c in batch.columns]
                wanted = [clean_edits(e, len(t)) for e, t in zip(given[6].to_pylist() if edits_col else redactions(texts), texts, strict=True)]
                grown = _loaded(given[2:6])
                before = [(len(tree.words), tree.sums.total, len(e)) for tree, e in zip(grown, wanted, strict=True)]
                news, again = edit_batch(vocab, texts, grown, wanted)
                numbers = [(*b, tree.sums.total, n) for b, tree, n in zip(before, grown, again, strict=True)]
                after = [pa.array(news, pa.string()), *_stored([tree.lists() for tree in grown])] if state else []
                columns = [given[0], *after, *(pa.array(c, pa.int64()) for c in zip(*numbers, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, ["id", *(["text", *LISTS] if state else []), *COUNTS])

    kind = trees.schema[id_col].dataType.simpleString()
    fields = [f"id {kind}", *([STATE] if state else []), *(f"{c} bigint" for c in COUNTS)]
    return kept.mapInArrow(run, ", ".join(fields)).withColumnRenamed("id", id_col)


def count_edited(rows: DataFrame, edits_col: str | None, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Token counts before and after the edits of each row: ``id_col, n_pretokens, n_tokens, n_edits, n_tokens_edited, n_recounted``.

    Trees are planted and stored, and the edits applied to what is stored.  What is null,
    void, repeated or empty is treated as in `plant_trees` and `edit_trees`.
    """
    trees = written(plant_trees(rows, id_col, text_col, edits_col, path), "token-trees")
    return edit_trees(trees, edits_col and "edits", id_col, path, state=False)


COUNTS = ("n_pretokens", "n_tokens", "n_edits", "n_tokens_edited", "n_recounted")


def count_batch(vocab: Vocabulary, texts: list[str], edits: list[list[tuple[int, int, str]]]) -> list[tuple[int, int, int, int, int]]:
    """The numbers of some texts, whose trees are planted and edited at once."""
    trees = plant_batch(vocab, texts)
    before = [(len(tree.words), tree.sums.total, len(e)) for tree, e in zip(trees, edits, strict=True)]
    _, again = edit_batch(vocab, texts, trees, edits)
    return [(*b, tree.sums.total, n) for b, tree, n in zip(before, trees, again, strict=True)]


def op5_token_counts(spark, sf_dir):
    """Counts for every document, and for what it becomes when personal data and keys are masked."""
    return count_edited(table(spark, sf_dir, "documents"), None)
