import zlib
from collections import Counter, defaultdict
from math import isclose, log10

import numpy as np
import pytest

from tubeql.llm import ppm, queries
from tubeql.llm.common import table

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
END = 256


def symbols(text):
    return [ppm.PAD] * 5 + list((text or "").encode().translate(LOWER)) + [END]


class Trie:
    """A byte-context trie as nested counters, and a walk through it a symbol."""

    def __init__(self, texts):
        self.after = defaultdict(Counter)
        for text in texts:
            s = symbols(text)
            for i in range(5, len(s)):
                for k in range(6):
                    self.after[tuple(s[i - k : i])][s[i]] += 1

    def log10(self, context, symbol):
        total, excluded = 0.0, set()
        for k in range(5, -1, -1):
            seen = self.after.get(tuple(context[5 - k :]))
            if not seen:
                continue
            left = {s: n for s, n in seen.items() if s not in excluded}
            whole = sum(left.values())
            if symbol in left:
                return total + log10((left[symbol] - (0.5 if len(seen) < 257 else 0)) / whole)
            if left and len(seen) < 257:
                total += log10(len(left) / 2 / whole)
            excluded |= set(seen)
        return total - log10(257 - len(excluded))


def brute(rows):
    """rows: (doc_id, text)."""
    out = (lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0)
    tokens = lambda t: [*(t or "").encode().translate(LOWER).split(), None]
    train = [t for i, t in rows if not out(i)]
    counts = Counter(w for t in train for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    trie, known = Trie(train), {}
    result = []
    for i, t in rows:
        s, score = symbols(t), 0.0
        for at in range(5, len(s)):
            key = tuple(s[at - 5 : at + 1])
            if key not in known:
                known[key] = trie.log10(key[:5], key[5])
            score += known[key]
        own = tokens(t)
        base = sum(log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        result.append((i, out(i), len(own), sum(counts[w] > 0 for w in own), n, base, score))
    return result


def same(df, want):
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert len(got) == len(want)
    order = lambda rows: sorted(rows, key=lambda r: (str(r[:5]), r[6]))
    for a, b in zip(order(got), order(want)):
        assert a[:5] == b[:5] and all(isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a[5:], b[5:])), (a, b)


@pytest.fixture(scope="module")
def small(spark, sf):
    return table(spark, sf, "documents").where("n_chars < 4000").select("doc_id", "text")


def test_whole_table_beats_the_unigrams_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op13_lm(spark, sf).collect()
    assert len(rows) == table(spark, sf, "documents").count()
    held = [r for r in rows if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("most", [ppm.HEAD, 2_000, 0])
def test_against_a_trie(spark, small, most):
    """Heads of any size give the same: the rest is joined."""
    docs = small.limit(60).cache()  # a fixture, not the query's table
    same(ppm.scores(docs, most=most), brute([tuple(r) for r in docs.collect()]))


def test_probabilities_add_up_to_one():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcde "), 300)) for _ in range(4)] + ["zzzz", ""]
    trie = Trie(texts)
    keys = Counter(tuple(s[i - 5 : i + 1]) for s in map(symbols, texts) for i in range(5, len(s)))
    packed = lambda c, s: sum(b << (ppm.SYMBOL_BITS + 8 * k) for k, b in enumerate(c)) | s
    seen = sorted((packed(k[:5], k[5]), n) for k, n in keys.items())
    low = ppm.orders(*ppm.summed(ppm.shortened(np.array([k for k, _ in seen]), 5, 2), np.array([n for _, n in seen])), 2, 0, None)
    for context in [*{k[:5] for k in list(keys)[::40]}, tuple(b"qqqqq"), tuple(b"qqabc")]:
        run = np.array([packed(context, s) for s in range(257)])
        every = dict(seen) | {k: dict(seen).get(int(k), 0) for k in map(int, run)}
        mine = np.array(sorted(every))
        got = dict(zip(mine.tolist(), ppm.code_lengths(mine, np.array([every[int(k)] for k in mine]), low)))
        chances = [10 ** got[int(k)] for k in run]
        assert isclose(sum(chances), 1, rel_tol=1e-9)
        assert all(isclose(got[int(k)], trie.log10(context, s), rel_tol=1e-9) for s, k in enumerate(run))


def test_nulls_repeats_and_extra_columns(spark):
    rows = [(1, "Ab ab"), (2, None), (3, ""), (None, "ab ab cd"), (5, "x " * 40_000), (5, "x " * 40_000), (6, "Zoë ZOË\n\tzoË"), (29, "new words here"), (8, "\n\n")]
    df = spark.createDataFrame([(*r, 0, "y") for r in rows], "doc_id long, text string, n int, key string")
    same(ppm.scores(df), brute(rows))
    same(ppm.scores(df, most=3), brute(rows))


def test_long_texts_in_pieces(spark, monkeypatch):
    text = "the quick brown fox " * 300
    want = [np.concatenate([x[1] for x in f(np.frombuffer((text * 2).encode(), np.uint8), np.array([0, len(text), 2 * len(text)]))]) for f in (ppm.runs, ppm.words)]
    monkeypatch.setattr(ppm, "WINDOW", 64)
    got = [np.concatenate([x[1] for x in f(np.frombuffer((text * 2).encode(), np.uint8), np.array([0, len(text), 2 * len(text)]))]) for f in (ppm.runs, ppm.words)]
    assert all((a == b).all() for a, b in zip(want, got))
    monkeypatch.setattr(ppm, "MAX_HELD", 10)
    tally, out = ppm.Tally(ppm.RUN), []
    for at in range(0, len(want[0]), 100):
        out += tally.add(want[0][at : at + 100], np.arange(len(want[0][at : at + 100])) % 2 == 0)
    out += tally.out()
    total = Counter()
    for b in out:
        for key, n in zip(b.column(1).to_pylist(), b.column(3).to_pylist()):
            total[key] += n
    assert total == Counter(want[0].tolist())


def test_empty_table_and_no_training(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ppm.scores(empty).count() == 0
    rows = [(6, "only held out")]
    assert zlib.crc32(b"6") % 10 == 0
    same(ppm.scores(spark.createDataFrame(rows, "doc_id long, text string")), brute(rows))
