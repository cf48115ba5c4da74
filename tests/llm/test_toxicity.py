import numpy as np
import pyarrow as pa

from tubeql.llm import toxicity
from tubeql.llm.common import table
from tubeql.llm.wordvec import blocks


def test_ordinal_fit_orders_cuts_and_grades():
    rng = np.random.default_rng(1)
    n = 3000
    x = rng.integers(0, 5, n)
    latent = 1.5 * x + rng.logistic(size=n)
    grade = np.digitize(latent, [2, 4, 6])
    row = np.flatnonzero(x)
    w, cuts = toxicity.fit_ordinal(row, np.zeros(len(row), dtype=int), x[row].astype(float), grade, 1)
    assert np.all(np.diff(cuts) > 0) and abs(w[0] - 1.5) < 0.15 and np.allclose(cuts, [2, 4, 6], atol=0.3)


def test_features_are_those_of_the_words():
    texts = ["Idiot idiots, id", "", None, "é idiot"]
    ((_, octets, offsets),) = list(blocks(pa.array(texts)))
    words, found, text = toxicity.features(octets, offsets)
    by = {}
    for w, f in zip(words, found):
        by.setdefault(int(w), []).append(int(f))
    assert [len(by[k]) for k in sorted(by)] == [3, 4, 1, 1, 3] and text.tolist() == [0, 0, 0, 3, 3]
    assert by[0] == by[4] and len(set(by[0]) & set(by[1])) == 2  # the first 4 and 5 bytes


def test_margins_against_a_loop():
    rng = np.random.default_rng(2)
    ((_, octets, offsets),) = list(blocks(pa.array(["a bb ccc dddd eeeee ffffff"])))
    _, found, _ = toxicity.features(octets, offsets)
    known = np.unique(found)[::2]
    model = toxicity.Model(known, rng.normal(size=len(known)), np.array([0.0]))
    texts = ["eeeee ffffff eeeee", None, "dddd bb", "zz", "ffffff " * 5000]
    want = []
    for t in texts:
        total = 0.0
        if t:
            ((_, o, s),) = list(blocks(pa.array([t])))
            _, f, _ = toxicity.features(o, s)
            total = sum(model.weights[k] * np.log1p((f == x).sum()) for k, x in enumerate(known))
        want.append(total)
    assert np.allclose(model.margins(pa.array(texts)), want)


def test_held_out_accuracy(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.fit(docs, labels, limit=2_500)
    assert np.all(np.diff(model.cuts) > 0)
    fitted = {r[0] for r in labels.selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h", "doc_id").limit(2_500).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id not in fitted}
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == docs.count()
    found = [d for d, t in truth.items() if t and got[d].toxic]
    wrong = [d for d, t in truth.items() if not t and got[d].toxic]
    assert len(found) >= 0.9 * sum(truth.values()) and len(wrong) <= 0.02 * len(truth)
    assert all(0 <= r.severity <= 3 and 0 <= r.grade <= 3 and r.toxic == (r.p_toxic >= 0.5) for r in got.values())


def test_given_grades_and_odd_rows(spark):
    rows = [(i, "fine words here") for i in range(60)] + [(100 + i, "bad " * (1 + i % 3) + "words") for i in range(60)] + [(None, "bad words"), (500, None), (1, "bad bad bad bad")]
    docs = spark.createDataFrame([(d, t, 9) for d, t in rows], "doc_id long, text string, grade int")
    labels = spark.createDataFrame([(i, 0, "x") for i in range(60)] + [(100 + i, 1 + i % 3, "x") for i in range(60)] + [(None, 3, "x"), (101, None, "x"), (9999, 1, "x")], "doc_id long, toxic int, text string")
    got = toxicity.report(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.severity for r in got if r.doc_id is not None and r.doc_id > 1}
    assert by[2] < by[100] < by[101] < by[102]
    none = toxicity.report(docs, labels.where("toxic = 0")).collect()
    assert all(r.severity == 0 and not r.toxic for r in none)
    assert toxicity.report(docs.limit(0), labels).collect() == []


def brute_model(rows, labels):
    """Selection of features, grades and fit from their definitions: dictionaries of strings and a dense matrix."""
    grade = {}
    for d, t in labels:
        if d is not None and t is not None:
            grade[d] = max(grade.get(d, 0), t)
    fit = [(t or "", grade[d]) for d, t in rows if d in grade]

    def counts(text):
        out = {}
        for w in text.encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split():
            for f in {("whole", w), *((k, w[:k]) for k in toxicity.PREFIXES if len(w) >= k)}:
                out[f] = out.get(f, 0) + 1
        return out

    each, toxic = [counts(t) for t, _ in fit], np.array([g > 0 for _, g in fit])
    n1, n0 = toxic.sum(), (~toxic).sum()
    known = []
    for f in sorted({f for c in each for f in c}, key=str):
        has = np.array([f in c for c in each])
        t, c = (has & toxic).sum(), (has & ~toxic).sum()
        ratio = ((t + 0.5) / (n1 + 1)) / ((c + 0.5) / (n0 + 1))
        log = lambda k, share: k * np.log(k / ((t + c) * share)) if k else 0.0
        z = np.sqrt(2 * max(log(t, n1 / (n1 + n0)) + log(c, n0 / (n1 + n0)), 0))
        if max(ratio, 1 / ratio) >= toxicity.RATIO and z >= toxicity.Z:
            known.append(f)
    n = np.array([[c.get(f, 0) for f in known] for c in each], dtype=float)
    much = n.sum(1)
    low, high = np.quantile(much[toxic], [1 / 3, 2 / 3])
    y = np.where(toxic, 1 + (much > low) + (much > high), 0)
    x, top = np.log1p(n), 3

    def loss_slope(w, free):
        cuts = np.array([free[0], free[0] + np.exp(free[1]), free[0] + np.exp(free[1]) + np.exp(free[2])])
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        m = x @ w
        over = lambda c: 1 / (1 + np.exp(np.clip(c - m, -700, 700)))
        up, down = over(edge[y]), over(edge[y + 1])  # P(grade >= y), P(grade >= y + 1)
        p = np.maximum(up - down, 1e-12)
        d_m = -(up * (1 - up) - down * (1 - down)) / p / len(y)
        d_c = np.zeros(top)
        for k in range(1, top + 1):
            d_c[k - 1] = ((up * (1 - up) / p)[y == k].sum() - (down * (1 - down) / p)[y + 1 == k].sum()) / len(y)
        d_free = np.array([d_c.sum(), (d_c[1] + d_c[2]) * np.exp(free[1]), d_c[2] * np.exp(free[2])])
        return np.concatenate([x.T @ d_m + toxicity.RIDGE * w / len(w), d_free]), cuts

    at, a, b = np.concatenate([np.zeros(len(known)), [1.0, 0.0, 0.0]]), 0.0, 0.0
    for step in range(1, toxicity.STEPS + 1):
        g, _ = loss_slope(at[: len(known)], at[len(known) :])
        a, b = 0.9 * a + 0.1 * g, 0.999 * b + 0.001 * g * g
        at = at - toxicity.RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-12)
    _, cuts = loss_slope(at[: len(known)], at[len(known) :])
    weight = dict(zip(known, at))
    severity = lambda t: sum(1 / (1 + np.exp(np.clip(c - sum(weight[f] * np.log1p(k) for f, k in counts(t or "").items() if f in weight), -700, 700))) for c in cuts)
    return known, [(d, severity(t)) for d, t in rows]


def test_query_against_brute_force(spark):
    """Selection, grades, fit and scores of every document of a small table."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").limit(700)
    labels = table(spark, "/root/testdata/sf0.01", "labels").select("doc_id", "toxic")
    rows, marks = [tuple(r) for r in docs.collect()], [tuple(r) for r in labels.collect()]
    small = spark.createDataFrame(rows, "doc_id long, text string")
    known, want = brute_model(rows, marks)
    assert len(known) > 10 and len(toxicity.fit(small, labels).features) == len(known)
    got = {r.doc_id: r for r in toxicity.report(small, labels).collect()}
    assert all(abs(got[d].severity - s) < 1e-3 for d, s in want)


def test_rows_of_the_fit_are_bounded(spark):
    """Rows that share a doc_id are one document of the fit."""
    docs = spark.range(5000).selectExpr("1L AS doc_id", "concat('t', id) AS text")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert [tuple(r) for r in toxicity.labelled(docs, labels, 1).collect()] == [(1, "t0")]
