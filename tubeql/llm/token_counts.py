"""Token counts that follow edits: a segment tree over each document's pre-tokens, kept as a table.

A document's pre-tokens are cut into leaves of LEAF; a tree over the leaves holds the sums of characters and of
tokens below each node, so a place in the text is found, and a count changed, in logarithmic time. build() encodes
every document once and gives its tree as a row: leaves and sums. Counts are read from the root. apply() takes such a
table and edits to its successor: only rows with edits are looked at, and of those only the leaves around an edit.

An edit re-encodes from the last leaf that begins CONTEXT characters or more before it (a pre-token's match looks less
far ahead, and never back) until a pre-token ends, after the edit, where a leaf ended before: from there on all is as
it was. Only those leaves change, and the sums above them.

Vocabulary (ranks of byte-level BPE) and pre-token pattern are parameters; nothing is trained.

Defined results
* null text is empty: no tokens. Strings of special tokens are ordinary text.
* an edit replaces `removed` characters from `start` on by `insert`; places outside the text are moved to its ends,
  null counts as 0 or empty; edits of a document apply in the order of seq, each to what the one before left.
* edits of unknown documents are ignored; edits of a doc_id that several rows share apply to each; rows without a
  doc_id have no edits. The edits of one document are one task's, as each depends on the one before.
* an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, checkpoint, sized, skew_join

LEAF = 64
#: A leaf that grows beyond so many pre-tokens has its tree built anew.
LARGEST = 8 * LEAF
CONTEXT = 4
#: Pre-tokens that a worker's cache of counts holds before it starts anew.
CACHE = 400_000


class Counter:
    """A worker's counts of pre-tokens."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.known = regex.compile(pattern), {}

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        found = list(map(known.get, pieces))
        if None in found:
            if len(known) > CACHE:
                known.clear()
            encode = self.encoding.encode_ordinary
            for i, n in enumerate(found):
                if n is None:
                    n = known.get(pieces[i])
                    if n is None:
                        n = known[pieces[i]] = len(encode(pieces[i]))
                    found[i] = n
        return found


@lru_cache(maxsize=4)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


class Tree:
    """Leaves (texts), the pre-tokens in each, and heaps of sums: node i has the children 2 i and 2 i + 1."""

    def __init__(self, text: str, own: Counter):
        self.own, self.encoded = own, 0
        pieces = own.pattern.findall(text)
        self.leaves, self.size, tokens = self._cut(pieces)
        self._sums(tokens)

    @classmethod
    def kept(cls, own: Counter, leaves: list[str], size: list[int], chars: list[int], tokens: list[int]) -> Tree:
        """A tree from its row."""
        tree = cls.__new__(cls)
        tree.own, tree.encoded, tree.width = own, 0, len(leaves)
        tree.leaves, tree.size, tree.chars, tree.tokens = leaves, size, chars, tokens
        return tree

    def _cut(self, pieces: list[str]) -> tuple[list[str], list[int], list[int]]:
        """Leaves of LEAF pre-tokens, how many each has, and their tokens."""
        counts = self.own.counts(pieces)
        starts = range(0, len(pieces), LEAF)
        return ["".join(pieces[a : a + LEAF]) for a in starts], [len(pieces[a : a + LEAF]) for a in starts], [sum(counts[a : a + LEAF]) for a in starts]

    def _sums(self, tokens: list[int]) -> None:
        """The heaps anew from the leaves; nothing is encoded."""
        self.width = 1
        while self.width < len(self.leaves):
            self.width *= 2
        none = self.width - len(self.leaves)
        self.leaves += [""] * none
        self.size += [0] * none
        self.chars, self.tokens = [0] * self.width + list(map(len, self.leaves)), [0] * self.width + tokens + [0] * none
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def pieces(self) -> int:
        return sum(self.size)

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a place, and where it begins; of empty leaves and ends, the last leaf with text before."""
        i, begin = 1, 0
        while i < self.width:
            i *= 2
            if place >= begin + self.chars[i] and self.chars[i + 1]:
                begin += self.chars[i]
                i += 1
        return i - self.width, begin

    def _set(self, leaf: int, text: str, size: int, tokens: int) -> None:
        self.leaves[leaf], self.size[leaf] = text, size
        i = leaf + self.width
        chars, tokens = len(text) - self.chars[i], tokens - self.tokens[i]
        while i:
            self.chars[i] += chars
            self.tokens[i] += tokens
            i //= 2

    def _again(self, leaf: int, begin: int, start: int, removed: int, insert: str) -> tuple[int, list[str]]:
        """The last leaf that changes, and the new pre-tokens from `leaf` to it."""
        last, more = self.find(start + removed)[0], 1
        while True:
            stop = min(self.width, last + 1 + more)
            old, whole = "".join(self.leaves[leaf:stop]), stop == self.width
            text = old[: start - begin] + insert + old[start - begin + removed :]
            borders, end = {}, 0
            for k in range(leaf, stop):
                end += len(self.leaves[k])
                if begin + end >= start + removed:
                    borders[end + len(insert) - removed] = k
            after, pieces = start - begin + len(insert), []
            for m in self.own.pattern.finditer(text):
                pieces.append(m[0])
                if m.end() >= after and m.end() in borders and (whole or m.end() + CONTEXT <= len(text)):
                    return borders[m.end()], pieces
            if whole:
                return self.width - 1, pieces
            more *= 4

    def edit(self, start: int | None, removed: int | None, insert: str | None) -> None:
        start = min(max(start or 0, 0), self.chars[1])
        removed = min(max(removed or 0, 0), self.chars[1] - start)
        leaf, begin = self.find(max(0, start - CONTEXT))
        last, pieces = self._again(leaf, begin, start, removed, insert or "")
        self.encoded += len(pieces)
        if len(pieces) > LARGEST:
            tokens = self.tokens[self.width :]
            for own, new in zip((self.leaves, self.size, tokens), self._cut(pieces)):
                own[leaf : last + 1] = new
            self._sums(tokens)
            return
        for k in range(leaf + 1, last + 1):
            if self.size[k]:
                self._set(k, "", 0, 0)
        self._set(leaf, "".join(pieces), len(pieces), sum(self.own.counts(pieces)))


Edit = tuple[int, int, str]


def apply_edits(text: str | None, edits: Iterable[Edit], own: Counter) -> tuple[int, Tree]:
    """The count before the edits, and the tree after them."""
    tree = Tree(text or "", own)
    before = tree.total
    for e in edits:
        tree.edit(*e)
    return before, tree


def standing_edits(length: int) -> list[Edit]:
    """The edits of the query: ten characters go at a quarter, words come at the middle, a line comes at the end."""
    return [(length // 4, 10, ""), (length // 2, 0, " (as amended) "), (length + 4, 0, "\nEnd of text.")]


TREE = "doc_id long, leaves array<string>, size array<int>, chars array<int>, tokens array<int>"
EDITED = TREE + ", n_before long, n_encoded long"
KINDS = [pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32())]
PARTS = ["leaves", "size", "chars", "tokens"]


def tree_batch(ids: pa.Array, trees: list[Tree], *more: list[int]) -> pa.RecordBatch:
    parts = [pa.array([getattr(t, p) for t in trees], kind) for p, kind in zip(PARTS, KINDS)]
    names = [x.split()[0] for x in EDITED.split(", ")]
    return batch(names[: 5 + len(more)], ids, *parts, *[pa.array(x, pa.int64()) for x in more])


def build(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """TREE: the tree of each row of docs (doc_id, text). Write it; counts() and apply() read it again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield tree_batch(part.column(0), [Tree(t or "", own) for t in part.column(1).to_pylist()])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, TREE)


def counts(trees: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_pieces): read from the roots and leaf sizes; no text is read."""
    pieces = F.aggregate("size", F.lit(0).cast("long"), lambda t, x: t + x)
    return trees.select("doc_id", F.col("tokens")[1].cast("long").alias("n_tokens"), pieces.alias("n_pieces"))


def apply(trees: DataFrame, path: str, pattern: str, edits: DataFrame | None = None) -> DataFrame:
    """EDITED: the trees after the edits (doc_id, seq, start, removed, insert; None: standing_edits), with the tokens
    before and how many pre-tokens were encoded again. Rows without edits don't move and aren't looked at."""
    trees = trees.select("doc_id", *PARTS)
    none = [F.col("tokens")[1].cast("long").alias("n_before"), F.lit(0).cast("long").alias("n_encoded")]
    rest = None
    if edits is not None:
        one = F.struct("seq", F.col("start").cast("long").alias("start"), F.col("removed").cast("long").alias("removed"), F.col("insert").cast("string").alias("insert"))
        listed = checkpoint(edits.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.sort_array(F.collect_list(one)).alias("edits")))
        ids = sized(listed.select("doc_id"))
        rest = trees.join(ids, "doc_id", "left_anti").select("*", *none)
        trees = skew_join(trees.join(ids, "doc_id", "left_semi"), listed, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                lists = b.column(5).to_pylist() if b.num_columns > 5 else None
                done, before = [], []
                for i, row in enumerate(zip(*[c.to_pylist() for c in b.columns[1:5]])):
                    tree = Tree.kept(own, *row)
                    before.append(tree.total)
                    todo = standing_edits(tree.chars[1]) if lists is None else [(e["start"], e["removed"], e["insert"]) for e in lists[i]]
                    for e in todo:
                        tree.edit(*e)
                    done.append(tree)
                yield tree_batch(b.column(0), done, before, [t.encoded for t in done])

    out = trees.mapInArrow(run, EDITED)
    return out if rest is None else out.unionByName(rest)


def count(docs: DataFrame, path: str, pattern: str, edits: DataFrame | None = None) -> DataFrame:
    """For each row of docs its tokens before and after its edits, its pre-tokens then, and how many of them were
    encoded again for the edits: the trees are built, kept as a table, and edited there."""
    done = apply(checkpoint(build(docs, path, pattern)), path, pattern, edits)
    pieces = F.aggregate("size", F.lit(0).cast("long"), lambda t, x: t + x)
    return done.select("doc_id", F.col("n_before").alias("n_tokens"), F.col("tokens")[1].cast("long").alias("n_tokens_after"), pieces.alias("n_pieces"), F.col("n_encoded").alias("n_encoded_again"))
