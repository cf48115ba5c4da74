import collections
import math
import re

from tubeql.llm import quality
from tubeql.llm.common import table

SCHEMA = "doc_id long, text string"


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover), failed


TEXTS = [
    None, "", " \n\t ", "one two", "a b c d e a b c d e", "a b c d e f a b c d e f x", "a a a a a a a a a a a a", "é ñ ü 日本 語 #*$%&|<> ok w x y z", "x\ny\nx\n\n\nx \n  \nx", "p q r s t " * 30 + "u v w", "l1 l2 l3\n" * 4,
    "a\x1cb c\x85d e f g h i j k l m", "word " * 4 + "🙂 end " + "n " * 3, "x" * 50_000, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10",
]


def report(spark, rows, labels=()):
    docs = spark.createDataFrame(rows, SCHEMA)
    return quality.report(docs, spark.createDataFrame(list(labels), "doc_id long, quality int"))


def test_base_counts(spark):
    rows = list(enumerate(TEXTS)) + [(None, TEXTS[5]), (5, TEXTS[5])]
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in report(spark, rows).collect()), key=str)
    assert got == sorted([(d, *base(t)) for d, t in rows], key=str)


def test_documents_table(spark, sf):
    docs = table(spark, sf, "documents")
    got = {r.doc_id: r for r in quality.report(docs, table(spark, sf, "labels")).collect()}
    for r in docs.collect():
        x = got[r.doc_id]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == base(r.text)
        assert not (x.kept and x.base_failed)


def brute_scores(rows, trusted, n_buckets, hash_of):
    raw, target, each = collections.Counter(), collections.Counter(), []
    for d, t in rows:
        grams = hash_of[t]
        each.append(grams)
        raw.update(grams)
        if d in trusted:
            target.update(grams)
    n, m = sum(raw.values()), sum(target.values())
    w = {b: math.log((target[b] + quality.SMOOTH * m / n) / (m + quality.SMOOTH * m / n * n_buckets)) - math.log((raw[b] + quality.SMOOTH) / (n + quality.SMOOTH * n_buckets)) for b in raw}
    return [sum(w[b] for b in g) / max(len(g), 1) for g in each]


def test_scores(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").limit(60).collect()
    df = spark.createDataFrame(docs, SCHEMA)
    labels = [(r.doc_id, 1 if r.doc_id % 3 else 0) for r in docs[:40]] + [(docs[1].doc_id, 0), (10**9, 1), (None, 1)]
    good = {d for d, q in labels if q == 1} - {d for d, q in labels if q == 0}
    hash_of = {r.text: r.b for r in df.select("text", quality.buckets(df.text, 1024).alias("b")).collect()}
    want = dict(zip([r.doc_id for r in docs], brute_scores([tuple(r) for r in docs], good, 1024, hash_of)))
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    for most in (quality.MAX_DENSE, 0):  # the weights sent, and joined
        got = quality.report(df, labels, n_buckets=1024, most=most).collect()
        assert all(abs(r.score - want[r.doc_id]) < 2e-6 for r in got) and len(got) == len(docs)
    rows = df.select("doc_id", "text")
    few, many, long = (quality.counted(rows, labels, 1024, chars, most).collect() for chars, most in ((10**6, 100), (10**6, 1), (1 << 31, 100)))
    assert sorted(few) == sorted(many) == sorted(long)  # the trusted ids sent, and joined; both counts in one long, and apart


def test_labelled_classes_part(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    kept = {r.doc_id: (r.kept, r.base_failed) for r in quality.report(docs, labels).collect()}
    rows = labels.collect()
    assert all(kept[r.doc_id][0] or kept[r.doc_id][1] for r in rows if r.quality == 1)
    bad = [r for r in rows if r.quality == 0]
    assert sum(not kept[r.doc_id][0] for r in bad) >= 0.9 * len(bad)


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, TEXTS[7], 3, True)], SCHEMA + ", n_words int, kept boolean")
    labels = spark.createDataFrame([(1, 1, "x")], "doc_id long, quality int, text string")
    assert [(r.n_words, r.kept) for r in quality.report(docs, labels).collect()] == [(11, True)]
    assert report(spark, []).collect() == []


def test_buckets_follow_the_corpus(spark):
    docs = spark.createDataFrame([(1, "x" * 1000), (2, None), (3, "é🙂")], SCHEMA)
    assert quality.length_of(docs) == 1002 and quality.length_of(docs.limit(0)) == 0
    per = quality.LEAST_BUCKETS * quality.CHARS_A_BUCKET
    assert [quality.buckets_for(n) for n in (0, 1, per, per + 1, 4 * per, 5 * per)] == [quality.LEAST_BUCKETS * k for k in (1, 1, 1, 2, 4, 8)]


def test_catch_rate_holds_when_the_corpus_grows(spark, monkeypatch):
    """Documents are repeated with new words, so the number of different n-grams grows with them."""
    from pyspark.sql import functions as F

    docs, labels = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text"), table(spark, "/root/testdata/sf0.01", "labels").select("doc_id", "quality")
    monkeypatch.setattr(quality, "LEAST_BUCKETS", 1 << 13)
    caught, clean = [], []
    for times in (1, 8):
        copies = docs.crossJoin(spark.range(times)).select((F.col("doc_id") * 8 + F.col("id")).alias("doc_id"), F.when(F.col("id") == 0, F.col("text")).otherwise(F.regexp_replace("text", "([a-z]{7,})", F.concat(F.lit("$1"), F.col("id").cast("string")))).alias("text"))
        marks = labels.crossJoin(spark.range(times)).select((F.col("doc_id") * 8 + F.col("id")).alias("doc_id"), "quality")
        got = quality.report(copies, marks).join(marks, "doc_id").where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
        shares = {r.quality: r.kept for r in got}
        caught.append(1 - shares[0])
        clean.append(shares[1])
    assert caught[1] >= max(0.9, caught[0] - 0.03) and min(clean) > 0.95


def test_keep_passes_any_columns(spark):
    names = ["b", "w", "judged", "k1", "k2", "id", "t", "_b", "_w", "_kept", "_score", "_base", "c0", "C1", "raw", "target", "part", "a.b", "n", "score"]
    long_text = " ".join(f"word{i}" for i in range(50))
    docs = spark.createDataFrame([(1, long_text, *range(len(names))), (None, None, *range(len(names))), (1, long_text, *range(len(names)))], SCHEMA + "".join(f", `{x}` int" for x in names))
    labels = spark.createDataFrame([(1, 1, "x")], "doc_id long, quality int, text string")
    out = quality.keep(docs, labels)
    assert out.schema.simpleString() == docs.schema.simpleString()
    assert [tuple(r) for r in out.collect()] == [(1, long_text, *range(len(names)))] * 2


def test_buckets_of_a_hundred_terabytes(spark):
    """2**38 buckets: numbers beyond an int, weights met in a join."""
    rows = list(enumerate(TEXTS))
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(14, 1), (9, 1)], "doc_id long, quality int")
    assert quality.buckets_for(10**14) == 1 << 38
    far = {r.doc_id: r for r in quality.report(docs, labels, n_buckets=1 << 38).collect()}
    near = {r.doc_id: r for r in quality.report(docs, labels, n_buckets=1 << 22).collect()}
    assert {d: (r.kept, r.score) for d, r in far.items()} == {d: (r.kept, r.score) for d, r in near.items()}


def test_joined_weights_in_parts(spark, sf, monkeypatch):
    """Beyond MAX_DENSE what is shuffled is a row a slice and part, not a row an n-gram; scores are those of sent weights."""
    from pyspark.sql import functions as F

    for name, value in (("SPAN", 16), ("SALTS", 3), ("PACKED", 5000)):
        monkeypatch.setattr(quality, name, value)
    odd = [(-1, "again " * 700 + " ".join(f"w{i}" for i in range(50))), (-2, " ".join(f"v{i}" for i in range(20_000))), (-3, None), (-4, ""), (-2, " ".join(f"v{i}" for i in range(20_000)))]
    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(odd, SCHEMA))
    labels = table(spark, sf, "labels")
    sent, joined = ({(r.doc_id, r.n_words): r for r in quality.report(docs, labels, n_buckets=1 << 20, most=most).collect()} for most in (quality.MAX_DENSE, 0))
    assert sent.keys() == joined.keys() and all(abs(sent[k].score - joined[k].score) < 2e-6 for k in sent)
    each = docs.select(F.lit(1).cast("long").alias("k1"), F.lit(2).cast("long").alias("k2"), quality.buckets(F.col("text"), 1 << 20).alias("b"))
    cells = quality.packed(each.where("b IS NOT NULL"), 3)
    n_grams, rows, slices = each.agg(F.sum(F.size("b"))).first()[0], cells.count(), cells.where("part < 0").count()
    assert slices < 4 * (n_grams / 5000 + 4) and rows <= 17 * slices < n_grams / 20


def test_rows_of_n_grams_are_compiled_and_those_of_the_arrays(spark):
    """Counting takes words as rows, without lambdas, and splits each text once; the rows are buckets(text), whatever the text."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(list(enumerate(TEXTS)), SCHEMA)
    for n_buckets in (1 << 10, 1000, 1 << 38):
        rows = quality.gram_rows(docs, n_buckets, "doc_id")
        arrays = docs.select("doc_id", F.explode(quality.buckets(F.col("text"), n_buckets)).alias("b"))
        assert rows.dtypes == arrays.dtypes and sorted(map(tuple, rows.collect())) == sorted(map(tuple, arrays.collect()))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "lambda" not in plan and plan.count("split(") == 1


def test_weights_are_one_array(spark, monkeypatch):
    monkeypatch.setattr(quality, "CHUNK", 8)
    found = spark.createDataFrame([(b, b / 4) for b in (0, 7, 8, 30, 31)], "b int, w float")
    assert quality.dense(found, 32).first().w == [b / 4 if b in (0, 7, 8, 30, 31) else 0.0 for b in range(32)]


def test_keep_judges_a_text_once(spark):
    """A filter over a struct column takes its expression once for each mention."""
    docs, labels = spark.createDataFrame(list(enumerate(TEXTS)), SCHEMA), spark.createDataFrame([(14, 1)], "doc_id long, quality int")
    plan = quality.keep(docs, labels)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_join(") == 1


def test_longer_runs_are_made_only_where_four_words_come_again(spark):
    """Runs of four come twice in the first and last, runs of five only in the last."""
    texts = ["a b c d x1 a b c d x2 y1 y2 y3 y4", "a b c d x1 a b c x2 d y1 y2 y3 y4", "a b c d x1 y1 a b c d x1 y2 y3 y4", "a b c d", "a b c", "a"]
    assert {r.doc_id: r.n_repeat_words for r in report(spark, list(enumerate(texts))).collect()} == {k: base(t)[4] for k, t in enumerate(texts)}
