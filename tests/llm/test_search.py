import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tubeql.llm import queries, search
from tubeql.llm.common import table

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=10):
    """Every document against every item."""
    counts = [(i, Counter(words(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = defaultdict(Counter)
    for i, t in set(items):
        wanted[i] += Counter(words(t))
    out = []
    for item, query in wanted.items():
        found = []
        for i, c in counts:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, n in query.items() if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, k, None if lone else i, -s) for k, (s, lone, i) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def pairs(df, key):
    return [tuple(r) for r in df.select(key, "text").collect()]


def test_whole_tables_against_brute_force_and_sql(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    want = brute(pairs(docs, "doc_id"), pairs(items, "item_id"))
    assert rows(queries.op12_search(spark, sf)) == want
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    assert sorted(((int(a), int(b), int(c), int(d)) for a, b, c, d in con.execute(f"SELECT item_id, rank, doc_id, score FROM ({search.ORACLE})").fetchall()), key=str) == want


@pytest.mark.parametrize("size, postings, most", [(1, 10**6, 10**6), (7, 40, 10**6), (4096, 10**6, 5)])
def test_blocks_of_any_size_give_the_same(spark, size, postings, most):
    rng = random.Random(size)
    vocabulary = [f"w{k}" for k in range(40)]
    text = lambda n: " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(40)], k=n))
    docs = [(k, text(rng.choice([0, 1, 5, 30, 400]))) for k in range(150)]
    docs += [(200 + k, docs[k % 5][1]) for k in range(40)]  # ties
    items = [(k, text(rng.randint(1, 12))) for k in range(15)]
    got = search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), most=most, size=size, postings_a_block=postings)
    assert rows(got) == brute(docs, items)


def test_documents_that_cannot_win_are_skipped():
    rng = np.random.default_rng(0)
    n = 4_000
    heap = search.Heap(10)
    common, rare = np.arange(n), np.sort(rng.choice(n, 20, replace=False))
    doc, term = np.concatenate([common, rare]), np.concatenate([np.zeros(n, int), np.ones(20, int)])
    block = search.Block(n, doc, term, np.where(term == 0, 5 + doc % 3, 1000 + doc % 7))
    scored = block.search(np.array([0, 1]), np.array([1, 1]), np.arange(n), heap)
    assert scored <= 20 + search.WAVE and heap.threshold() >= 1000 and set(heap.docs) <= set(rare)
    assert search.Block(1, np.array([0]), np.array([0]), np.array([7])).search(np.array([0]), np.array([1]), np.array([9]), heap) == 0


def test_nulls_repeats_ties_and_extra_columns(spark):
    docs = [(1, "Über alles, ÜBER a"), (2, None), (3, ""), (4, "-- ... --"), (None, "alpha beta"), (5, "alpha beta"), (5, "alpha beta"), (6, "gamma " * 30_000 + "delta"), (7, "Alpha beta x9"), (8, "_a`b")]
    items = [(1, "ALPHA beta beta"), (2, None), (3, "?"), (4, "über Über"), (None, "gamma delta"), (5, "nothing like it"), (1, "ALPHA beta beta"), (6, "alpha"), (6, "delta")]
    df = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n int, term string")
    bench = spark.createDataFrame([(*r, 1, "x") for r in items], "item_id long, text string, doc_id int, score string")
    assert rows(search.search(df, bench)) == brute(docs, items)
    assert rows(search.search(df, bench, top=1)) == brute(docs, items, 1)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        got = search.search(d, i)
        assert got.count() == 0 and dict(got.dtypes)["rank"] == "int"
    assert rows(search.search(docs, items)) == brute([(1, "a")], [(1, "a")])
