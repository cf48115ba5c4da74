"""BPE by speculation: greedy longest match proposes, vectorised pair checks verify, failing words merge exactly.

A sequence of tokens is the BPE encoding of a word if and only if every two neighbours are compatible: no merge
that reaches across their border comes before the merges that bury the border's sides. Each side shows only a
few tokens at the border while it is being merged (its spine), so the check of a pair is a small table of merge
ranks, done for all pairs of a batch at once. Words with a pair that fails are merged exactly, one by one.

The vocabulary file is a parameter (tokenizers' JSON of a BPE with an end-of-word suffix); nothing is trained.

Defined results
* null or empty text: no ids; no ids decode to the empty text.
* a character outside the vocabulary's alphabet can't occur: words are byte-level.
* the strings of added tokens in a text are those tokens, whatever their surroundings.
* repeated rows and null doc_ids are encoded as any row; other columns of the input are not looked at.
* an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, give_back

#: The pre-token pattern of the vocabulary file, for code points below AGREED.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r\x20\x85\xa0\p{L}\p{N}]+")
#: Below this code point all versions of Unicode agree on letters, numbers and composition. Beyond, the
#: vocabulary file's own normalizer and splitter decide, with their library's version of Unicode.
AGREED = chr(0x250)
#: Texts are cut at these first; no pre-token and no added token crosses them.
BREAKS = "\n\t\r\x0b\x0c"
#: Entries that a worker's caches of words and of chunks hold before they start anew.
CACHE = 200_000
NEVER = np.int64(2**40)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.added_head = {x[0] for x in self.added}
        size = max([*self.vocab.values(), *self.added.values()]) + 1
        self.tokens = [""] * size
        for x, i in [*self.vocab.items(), *self.added.items()]:
            self.tokens[i] = x
        self.alphabet = byte_alphabet()
        self.byte_of = {c: b for b, c in enumerate(self.alphabet)}
        self.path, self.library = path, None
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}  # of a pair: its rank, and in the last 20 bits what it makes
        left, right, made = np.full(size, -1), np.full(size, -1), np.full(size, NEVER)
        for r, (a, b) in enumerate(pairs):
            i, j, k = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank.setdefault((i, j), (r << 20) | k)
            if made[k] == NEVER:
                left[k], right[k], made[k] = i, j, r
        code = np.array([(i << 20) | j for i, j in self.rank], dtype=np.int64)
        order = np.argsort(code)
        self.codes, self.ranks = code[order], np.array([*self.rank.values()], dtype=np.int64)[order] >> 20
        self.right_spine, self.right_until = self._spines(right, made)
        self.left_spine, self.left_until = self._spines(left, made)
        whole = left >= 0
        sound = np.ones(size, dtype=bool)
        sound[whole] = self.compatible(left[whole], right[whole], made[whole])
        for k in np.argsort(np.where(whole, made, NEVER), kind="stable")[: whole.sum()]:
            sound[k] &= sound[left[k]] and sound[right[k]]
        self.packed = [k.to_bytes(4, "little") for k in range(size)]
        self.words: dict[str, bytes] = {}
        # Only tokens that come out of their own string are proposed: those inside words, by all their beginnings
        # (-1 where a beginning is no token), and those at the ends of words, without the mark of the end.
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for x, i in self.vocab.items():
            if sound[i]:
                ends = bool(self.end) and x.endswith(self.end)
                x = x[: len(x) - len(self.end) * ends]
                for k in range(1, len(x)):
                    self.inner.setdefault(x[:k], -1)
                if ends:
                    self.final[x] = i
                else:
                    self.inner[x] = i
        self.known = np.zeros(0, dtype=np.int64)
        self.known_ok = np.zeros(0, dtype=bool)

    @staticmethod
    def _spines(child: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token: the tokens that its border shows, largest first, and the rank that ends each."""
        spine, until = [np.arange(len(child))], [np.full(len(child), NEVER)]
        while (spine[-1] >= 0).any():
            now = spine[-1]
            spine.append(np.where(now >= 0, child[now], -1))
            until.append(np.where(spine[-1] >= 0, made[now], -1))
        return np.stack(spine[:-1], 1), np.stack(until[:-1], 1)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge (of a rank below limit) reaches across the border of a and b before it is buried."""
        ok = np.ones(len(a), dtype=bool)
        for i in range(self.right_spine.shape[1]):
            x, x_until = self.right_spine[a, i], self.right_until[a, i]
            if not (x >= 0).any():
                break
            for j in range(self.left_spine.shape[1]):
                y, y_until = self.left_spine[b, j], self.left_until[b, j]
                there = np.flatnonzero((x >= 0) & (y >= 0) & ok)
                if not len(there):
                    break
                code = (x[there].astype(np.int64) << 20) | y[there]
                at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                rank = np.where(self.codes[at] == code, self.ranks[at], NEVER)
                # Of equal ranks the left one is merged first: the border's left side is buried, its right side isn't.
                across = (rank < x_until[there]) & (rank <= y_until[there]) & (rank < NEVER)
                if limit is not None:
                    across &= rank < limit[there]
                ok[there[across]] = False
        return ok

    def _check(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """compatible() for many pairs, each different pair once in a worker's life."""
        pairs, back = np.unique((a << 20) | b, return_inverse=True)
        at = np.searchsorted(self.known, pairs)
        old = np.zeros(len(pairs), dtype=bool)
        if len(self.known):
            old = self.known[np.minimum(at, len(self.known) - 1)] == pairs
        new = pairs[~old]
        if len(new):
            ok = self.compatible(new >> 20, new & 0xFFFFF)
            if len(self.known) > 4 * CACHE:
                self.known, self.known_ok = self.known[:0], self.known_ok[:0]
                return self._check(a, b)
            spots = np.searchsorted(self.known, new)
            self.known, self.known_ok = np.insert(self.known, spots, new), np.insert(self.known_ok, spots, ok)
        return self.known_ok[np.searchsorted(self.known, pairs)][back]

    def _symbols(self, word: str) -> str:
        return "".join([self.alphabet[b] for b in word.encode()])

    def propose(self, symbols: str) -> list[int] | None:
        """Greedy longest match from the left; None where a symbol has no usable token."""
        out, i, n, inner = [], 0, len(symbols), self.inner.get
        while i < n:
            best, end = -1, i
            for j in range(i + 1, n):
                k = inner(symbols[i:j])
                if k is None:
                    break
                if k >= 0:
                    best, end = k, j
            else:
                k = self.final.get(symbols[i:])
                if k is not None:
                    best, end = k, n
            if best < 0:
                return None
            out.append(best)
            i = end
        return out

    def merge(self, symbols: str) -> list[int]:
        """Exact merging: the lowest rank first, the leftmost of equals."""
        ids = [self.vocab[x] for x in symbols[:-1]] + [self.vocab[symbols[-1] + self.end]]
        if len(ids) > 256:
            return self._merge_long(ids)
        get, never = self.rank.get, 1 << 60
        ranks = [get(p, never) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != never:
            i = ranks.index(best)
            ids[i : i + 2] = [best & 0xFFFFF]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), never)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), never)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for words of any length."""
        import heapq

        rank, n = self.rank, len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(rank[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]
        heapq.heapify(heap)
        while heap:
            best, i, (a, b) = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = best & 0xFFFFF, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] >= 0 and (p := (ids[left], ids[after[left]])) in rank:
                    heapq.heappush(heap, (rank[p], left, p))
        out, i = [], 0
        while i >= 0:
            out.append(ids[i])
            i = after[i]
        return out

    def learn(self, words: set[str]) -> None:
        """Puts the encodings of words, packed, into self.words."""
        if len(self.words) + len(words) > CACHE:
            self.words = {w: self.words[w] for w in words if w in self.words}
        symbols = {w: self._symbols(w) for w in words if w not in self.words}
        tried = [(w, s, self.propose(s)) for w, s in symbols.items()]
        flat = np.array([k for _, _, ids in tried for k in ids or ()], dtype=np.int64)
        sizes = np.array([len(ids or ()) for _, _, ids in tried], dtype=np.int64)
        ends = np.cumsum(sizes)
        inner = np.ones(len(flat), dtype=bool)  # has a neighbour to its right in the same word
        inner[ends[sizes > 0] - 1] = False
        at = np.flatnonzero(inner)
        wrong = np.zeros(len(flat) + 1, dtype=np.int64)
        if len(at):
            wrong[at + 1] = ~self._check(flat[at], flat[at + 1])
        wrong = np.cumsum(wrong)
        failed = (wrong[ends] - wrong[ends - sizes]) > 0
        for (w, s, ids), bad in zip(tried, failed):
            found = self.merge(s) if bad or ids is None else ids
            self.words[w] = b"".join([self.packed[k] for k in found])

    def pieces(self, chunk: str) -> list[str | int]:
        """Words, and the ids of added tokens, of a text without breaks."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk.lower()]
            if chunk[:-1].isalpha() and chunk[-1] in ".,:;!?":
                return [chunk[:-1].lower(), chunk[-1]]
        if not any(x in chunk for x in self.added_head):
            return self.split(chunk)
        out: list[str | int] = []
        for x in self.split_added.split(chunk):
            if x in self.added:
                out.append(self.added[x])
            elif x:
                out += self.split(x)
        return out

    def split(self, text: str) -> list[str]:
        """Normalised words of a text without added tokens."""
        if text.isascii():
            return WORDS.findall(text.lower())
        if max(text) < AGREED:
            return WORDS.findall(unicodedata.normalize("NFC", text).lower())
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes([self.byte_of[c] for c in x]).decode() for x, _ in split]


def cut(text: str) -> list[str]:
    for c in BREAKS:
        text = text.replace(c, " ")
    return text.split(" ")


class Encoder:
    """A worker's encoder: ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.bpe, self.chunks = Bpe(path), {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [cut(t or "") for t in texts]
        new: set[str] = set()
        for x in split:
            new.update(set(x).difference(self.chunks))
        if len(self.chunks) + len(new) > CACHE:  # the chunks of these texts stay, and with them the frequent ones
            seen = set().union(*split)
            self.chunks = {c: ids for c, ids in self.chunks.items() if c in seen}
        chunks, pieces = self.chunks, {c: self.bpe.pieces(c) for c in new}
        self.bpe.learn({w for x in pieces.values() for w in x if isinstance(w, str)})
        words, packed = self.bpe.words, self.bpe.packed
        for c, x in pieces.items():
            chunks[c] = words[x[0]] if len(x) == 1 and isinstance(x[0], str) else b"".join([packed[w] if isinstance(w, int) else words[w] for w in x])
        get = chunks.__getitem__
        return [b"".join(map(get, x)) for x in split]


    def forget(self) -> None:
        """Gives the caches' memory back: Spark keeps workers, and with them what they hold, for other tasks."""
        self.chunks, self.bpe.words = {}, {}
        self.bpe.known, self.bpe.known_ok = self.bpe.known[:0].copy(), self.bpe.known_ok[:0].copy()


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=4)
def token_strings(path: str) -> np.ndarray:
    """By id; all that decoding needs."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids = spec["model"]["vocab"] | {x["content"]: x["id"] for x in spec["added_tokens"]}
    out = np.full(max(ids.values()) + 1, "", dtype=object)
    for x, i in ids.items():
        out[i] = x
    return out


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): ids are bytes, little-endian unsigned 32-bit integers, without special tokens around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield batch(["doc_id", "ids"], part.column(0), pa.array(own.encode(part.column(1).to_pylist()), pa.binary()))
        own.forget()
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): the tokens' strings with a space between them, special tokens too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_strings(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [" ".join(tokens[np.frombuffer(x or b"", dtype="<u4")]) for x in part.column(1).to_pylist()]
                yield batch(["doc_id", "ids", "decoded"], part.column(0), part.column(1), pa.array(texts, pa.string()))
        give_back()

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests() -> list[Column]:
    """n_tokens and the SHA-256 of the ids and of the decoded text, from the columns of decode()."""
    return [F.expr("length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")]


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and digests() for each document."""
    return decode(encode(docs, path), path).select("doc_id", *digests())
