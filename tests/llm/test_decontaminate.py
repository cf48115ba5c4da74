import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tubeql.llm import decontaminate, wordvec
from tubeql.llm.common import table

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def grams(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(docs, items, share=0.8):
    out = []
    for d, t in docs:
        for i, q in sorted(set(items), key=str):
            n = min(5, len((q or "").split()))
            want = grams(q, n) if n else set()
            shared = len(want & grams(t, n)) if n else 0
            if want and shared >= share * len(want) - 1e-9:
                out.append((d, i, shared, len(want), round(shared / len(want), 6)))
    return sorted(out, key=str)


def test_word_hashes_tell_words_apart():
    texts = ["Ab c\x0bd", None, "", "  x ", "ab C", "é\x1cé ab"]
    seen = {}
    for at, octets, offsets in wordvec.blocks(pa.array(texts)):
        starts, ends, first = wordvec.word_places(octets, offsets)
        h = wordvec.word_hashes(octets, starts, ends)
        for k in range(len(offsets) - 1):
            words = [bytes(octets[a:z]) for a, z in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]])]
            assert words == (texts[at + k] or "").encode().lower().split()
        for a, z, x in zip(starts, ends, h):
            assert seen.setdefault(int(x), bytes(octets[a:z])) == bytes(octets[a:z])
        ok = wordvec.runs_inside(first, len(h), 2)
        assert [int(i) for i in np.flatnonzero(ok)] == [i for i in range(len(h) - 1) if np.searchsorted(first, i, "right") == np.searchsorted(first, i + 1, "right")]
    assert sorted(seen.values()) == sorted({b"ab", b"c", b"d", b"x", "é\x1cé".encode()})


def made():
    rng = random.Random(2)
    word = lambda: rng.choice("abcdefgh") + rng.choice("ijklmnop") + str(rng.randint(0, 400))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 5, 6, 12, 40, 90])))) for i in range(60)]
    items += [(60, None), (61, " \n"), (62, items[5][1]), (None, items[5][1]), (0, items[0][1])]
    docs = []
    for k in range(150):
        body = [word() for _ in range(rng.choice([0, 4, 30, 300, 3000]))]
        for _ in range(rng.randint(0, 2)):
            q = (rng.choice(items)[1] or "x").split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                if q:
                    q[rng.randrange(len(q))] = word()
            cut = rng.randrange(len(q) + 1) if rng.random() < 0.3 else len(q)
            at = rng.randrange(len(body) + 1)
            body[at:at] = [x.upper() if rng.random() < 0.1 else x for x in q[:cut]]
        docs.append((k, rng.choice([" ", "\n", " \t"]).join(body)))
    return docs + [(200, None), (201, ""), (None, docs[3][1]), (3, docs[3][1]), (202, "z " * 400_000 + items[9][1])], items


@pytest.mark.parametrize("most", [decontaminate.MAX_SHINGLES, 300])
def test_against_brute_force(spark, most):
    docs, items = made()
    df, q = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    found = decontaminate.contained(df, q, most=most)
    got = sorted(((r.doc_id, r.item_id, r.n_shared, r.n_item, round(r.n_shared / r.n_item, 6)) for r in found.collect()), key=str)
    want = brute(docs, items)
    assert got == want and len(want) > 40
    assert sorted(str(r.doc_id) for r in decontaminate.clean(df, q, most=most).collect()) == sorted(str(d) for d, t in docs if not any(x[0] == d and d is not None for x in want) and not (d is None and any(x[0] is None for x in want)))


def test_documents_table_and_sql(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    got = sorted(map(tuple, decontaminate.report(docs, items).collect()))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]) or sorted(got, key=str) == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert sorted(con.execute(decontaminate.ORACLE).fetchall()) == got and got


def test_sketch_never_misses():
    for n in range(1, 3000):
        assert decontaminate.sketch_size(n, 0.8) > n - int(np.ceil(0.8 * n - 1e-9)) or decontaminate.sketch_size(n, 0.8) == n


def test_empty_tables_and_clashing_columns(spark):
    none_d, none_i = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    one_d = spark.createDataFrame([(1, "a b c", 7)], DOCS + ", item_id long")
    one_i = spark.createDataFrame([(5, "B C", 8)], ITEMS + ", doc_id long")
    assert decontaminate.report(none_d, one_i).collect() == [] and decontaminate.report(one_d, none_i).collect() == []
    assert [tuple(r) for r in decontaminate.report(one_d, one_i).collect()] == [(1, 5, 1, 1, 1.0)]
    assert decontaminate.clean(one_d, one_i).collect() == [] and decontaminate.clean(one_d, none_i).count() == 1
