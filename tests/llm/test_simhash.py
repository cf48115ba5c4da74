import random

import numpy as np
import pytest
import xxhash

from tubeql.llm import components, families, simhash
from tubeql.llm.common import table

SCHEMA = "doc_id long, text string"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_print(text, words=4):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    sh = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints, limit):
    left, out = dict(enumerate(prints)), {}
    while left:
        seed, x = left.popitem()
        front, member = [x], [seed]
        while front:
            y = front.pop()
            for k in [k for k, z in left.items() if (y ^ z).bit_count() <= limit]:
                front.append(left.pop(k))
                member.append(k)
        for k in member:
            out[k] = frozenset(member)
    return [out[i] for i in range(len(prints))]


def brute(rows, limit=4):
    prints = [brute_print(t) for _, t in rows]
    out = []
    for (d, _), p, g in zip(rows, prints, brute_groups(prints, limit)):
        ids = [rows[k][0] for k in g if rows[k][0] is not None]
        out.append((d, f"{p:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def words(rng, n):
    return [rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randint(0, 99)) for _ in range(n)]


def made(seed=3):
    rng = random.Random(seed)
    rows, k = [], 1000
    for g in range(40):
        base = words(rng, rng.choice([5, 60, 300]))
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 9))
            rows.append((k, " ".join(w)))
            k -= 1
    base = words(rng, 200)
    rows += [(5000 + i, " ".join(base[:i] + [f"q{i % 7}"] + base[i + 1 :])) for i in range(150)]
    rows += [(7, None), (8, ""), (9, " \n "), (None, rows[0][1]), (rows[0][0], rows[0][1]), (None, "lone words here"), (11, "One"), (12, "one "), (13, "ÉTÉ one two three four")]
    return rows


def test_fingerprint_is_the_definition():
    for t in ["", "a", "A b", "a b c d", "a b c d e f g " * 50, "x\x0by\x1cz É é"]:
        assert simhash.fingerprint(simhash.shingle_hashes(t.encode(), 4)) == brute_print(t)


def test_against_brute_force(spark):
    rows = made()
    got = sorted((tuple(r) for r in simhash.report(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)


def test_documents_table(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in simhash.report(docs).collect()), key=str) == brute(rows)


def chains(rng, n):
    """Fingerprints in clusters and chains, where bits flip one to five at a time."""
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        x = rng.choice(out)
        for b in rng.sample(range(64), rng.randint(1, 5)):
            x ^= 1 << b
        out.append(x)
    return sorted(set(out))


def classes(spark, prints):
    rows = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    return spark.createDataFrame(rows, "id long").selectExpr("id", "array(id) AS fp")


@pytest.mark.parametrize("limit,m", [(4, None), (4, 2), (4, 3), (4, 4), (3, None), (7, None), (0, None)])
def test_no_link_is_lost(spark, limit, m):
    rng = random.Random(limit)
    prints = chains(rng, 300)
    df = classes(spark, prints)
    n, both = simhash.bit_statistics(df)
    both = both[0]
    assert n == len(prints)
    plan = simhash.make_plan(n, both, limit)
    if m:
        order = simhash.correlated_order(n, both)
        cut = np.array_split(np.array(order), m)
        plan = simhash.allocate(10**9, both * 1e9 / n, [list(map(int, x)) for x in cut], limit)
    assert sum(t + 1 for t in plan.thresholds) == limit + 1
    assert sorted(b for p in plan.parts for b in p) == list(range(64))
    edges = simhash.links(df, plan, limit)
    found = {r.node: r.root for r in components.components(edges).collect()}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    want = [frozenset(signed[k] for k in g) for g in brute_groups(prints, limit)]
    for x, g in zip(signed, want):
        assert found.get(x, x) == min(g)


def test_thresholds_are_unequal_where_bits_are(spark):
    n = 10**9
    both = np.full((64, 64), n / 4.0)
    np.fill_diagonal(both, n / 2)
    for b in range(21):
        both[b, b] = n / 1000  # bits that seldom differ
    plan = simhash.allocate(n, both, [list(range(21)), list(range(21, 42)), list(range(42, 64))], 4)
    assert plan.thresholds[0] < max(plan.thresholds[1:])


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, x) for x in range(501, 900)] + [(7, 7)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(101)}, **{i: 500 for i in range(500, 900)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


WIDE_WORDS = 2**64 - 1


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & WIDE_WORDS
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & WIDE_WORDS
    return x ^ (x >> 31)


def brute_wide(text, words=5, width=8):
    """The fingerprint of several words, from its definition, as one integer."""
    import re

    base = 0x9E3779B97F4A7C15
    hashes = []
    for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate(LOWER).encode()):
        hashes.append(mixed((sum((c + 1) * pow(base, i, 2**64) for i, c in enumerate(w)) + len(w)) & WIDE_WORDS))
    n = min(words, len(hashes))
    grams = []
    for i in range(len(hashes) - n + 1 if n else 0):
        g = n
        for k in range(n):
            g = mixed((g * base + hashes[i + k]) & WIDE_WORDS)
        grams.append(g)
    out = 0
    for k in range(width):
        each = [mixed((g + (k + 1) * base) & WIDE_WORDS) for g in grams]
        out |= sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in each) > len(each)) << (64 * k)
    return out


def shingles(text, n=5):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def brute_near(rows):
    """Rows that stay by comparing all pairs on their shingles: one of each group that a similarity of 0.8 connects."""
    sets = [shingles(t) for _, t in rows]
    left, out = set(range(len(rows))), []
    while left:
        front = [left.pop()]
        group = set(front)
        while front:
            x = front.pop()
            near = {k for k in left if jaccard(sets[x], sets[k]) >= 0.8}
            left -= near
            front.extend(near)
            group |= near
        out.append(min(group, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k)))
    return [rows[k] for k in sorted(out)]


def near_made(seed=5):
    rng = random.Random(seed)
    new = lambda n: ["".join(rng.choice("abcdefghijkl") for _ in range(4)) for _ in range(n)]
    passage, texts = new(40), []
    for _ in range(60):
        base = new(rng.choice([5, 12, 80, 400]))
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.choice([1, 2, 5])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = new(1)[0]
            texts.append(" ".join(w))
    texts += [None, "", " \n ", "One two", "one TWO", "word " * 5_000, "lone"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_wide_fingerprints_are_their_definition():
    import pyarrow as pa

    texts = ["", None, "a", "A b", "a b c d e", "a b c d e f g " * 90, "x\x0by\x1cz É é q", "w" * 3000] + [t for _, t in near_made()[:20]]
    got, names = simhash.wide_fingerprints(pa.array(texts), 5, 8)
    sets = [frozenset(shingles(t)) for t in texts]
    assert len({tuple(x) for x in names.tolist()}) == len(set(sets)) == len({(s, tuple(x)) for s, x in zip(sets, names.tolist())})
    assert [sum(int(x) << (64 * k) for k, x in enumerate(row)) for row in got] == [brute_wide(t) for t in texts]


def test_one_row_of_each_group_stays(spark):
    rows = near_made()
    df = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], SCHEMA + ", fp string, head int, k1 int")
    got = simhash.deduplicate(df)
    assert got.columns == df.columns
    kept, want = {r.doc_id for r in got.collect()}, {d for d, _ in brute_near(rows)}
    assert want <= kept  # nothing goes but near duplicates,
    assert len(rows) - len(kept) >= 0.9 * (len(rows) - len(want)) > 50  # and they do: the parts find 0.98 of the pairs at 0.8


def test_pairs_of_a_similarity_are_found(spark):
    """Recall over pairs from 0.8 on, at several sizes, of documents that have one other version only."""
    rng = random.Random(1)
    rows, pairs = [], []
    for _ in range(300):
        w = words(rng, 300)
        other = list(w)
        while True:
            changed = list(other)
            changed[rng.randrange(300)] = "edit" + str(rng.randint(0, 10**6))
            if jaccard(shingles(" ".join(w)), shingles(" ".join(changed))) < 0.8:
                break
            other = changed
        pairs.append((len(rows), len(rows) + 1))
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(other))]
    found = {r.doc_id: r.head.k1 for r in simhash.similar_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(found[a] == found[b] for a, b in pairs) >= 0.9 * len(pairs)
    assert len({found[a] for a, _ in pairs}) == len(pairs)


def template(rng, n, size, own):
    """n documents with a template of `size` words of which `own` words of each, in one run, are its own."""
    base = words(rng, size)
    out = []
    for k in range(n):
        at = rng.randrange(size - own)
        out.append(" ".join(base[:at] + [f"own{k}x{i}" for i in range(own)] + base[at + own :]))
    return out


@pytest.mark.parametrize("own", [60])
def test_a_crowd_that_is_not_similar_stays(spark, own):
    """400 documents of one template, most pairs of a similarity below 0.8: nothing goes but what all pairs on their
    shingles say; documents of the crowd whose only similar one is just at 0.8 may be found apart."""
    rows = list(enumerate(template(random.Random(own), 400, 400, own)))
    want = {d for d, _ in brute_near(rows)}
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert want <= kept and 400 - len(kept) >= 0.9 * (400 - len(want)) and len(want) > 1


def test_a_shingle_that_fills_a_text_links_nothing(spark):
    rng = random.Random(8)
    rows = [(k, "the " * 200 + " ".join(words(rng, 60))) for k in range(3)] + [(3, None), (4, ""), (5, "the " * 300), (6, "the " * 400)]
    assert sorted(r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()) == [0, 1, 2, 3, 5]


def mixed_families(seed):
    rng = random.Random(seed)
    rows, k = [], 0
    for family in range(12):
        texts = template(rng, rng.choice([2, 9, 40]), 120, rng.choice([3, 8, 13, 18]))
        texts += [t.replace("own", "other", rng.randint(0, 9)) for t in texts[:4]] + rng.choice([[], ["", " "], ["one two"]])
        rows += [(family, k + i, t) for i, t in enumerate(texts)]
        k += len(texts)
    return rows + rows[:5]


@pytest.mark.parametrize("small, leaders", [(1_000, 4), (0, 1), (20, 2)])
def test_families_of_any_size_are_searched_exactly(spark, monkeypatch, small, leaders):
    rows = mixed_families(small)
    monkeypatch.setattr(families.large_links, "__defaults__", (leaders,))
    pairs = families.similar_pairs(spark.createDataFrame(rows, "family long, id long, text string").repartition(3), 5, 0.8, small=small)
    found = {r.node: r.root for r in components.components(pairs).collect()}
    for family in {f for f, _, _ in rows}:
        mine = sorted({(i, t) for f, i, t in rows if f == family})
        sets, root = {i: shingles(t) for i, t in mine}, {}
        for i, _ in mine:
            if i in root:
                continue
            front, root[i] = [i], i
            while front:
                x = front.pop()
                near = [j for j, _ in mine if j not in root and jaccard(sets[x], sets[j]) >= 0.8]
                root |= dict.fromkeys(near, i)
                front += near
        assert {i: found.get(i, i) for i, _ in mine} == root


@pytest.mark.parametrize("block", [16, 2048])
def test_a_crowd_in_one_key_is_dealt_out(spark, block):
    """Keys larger than a block give the same components; with a crowd near the leader and classes that aren't."""
    rng = random.Random(2)
    base, other = rng.getrandbits(64), rng.getrandbits(64)
    prints = {base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)} | {other ^ (1 << a) for a in range(64)} | {(base & 0xFFFFFFFF) | (rng.getrandbits(32) << 32) for _ in range(200)}
    prints = sorted(prints)
    df = classes(spark, prints)
    n, both = simhash.bit_statistics(df)
    plan = simhash.make_plan(n, both, 4)
    found = {r.node: r.root for r in components.components(simhash.links(df, plan, 4, block)).collect()}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    for x, g in zip(signed, brute_groups(prints, 4)):
        assert found.get(x, x) == min(signed[k] for k in g)


def test_candidates_of_correlated_bits_are_not_underestimated():
    """A part of bits that always go together has as few values as one bit."""
    n = 10**6
    both = np.full((64, 64), n / 4.0)
    both[:8, :8] = n / 2
    np.fill_diagonal(both, n / 2)
    assert simhash.within(n, both, list(range(8)), 0)[0] == pytest.approx(0.5)
    assert simhash.within(n, both, list(range(8, 16)), 0)[0] == pytest.approx(2.0**-8)


def test_plan_that_cannot_keep_its_promise_is_an_error():
    both = np.full((64, 64), 250.0)
    np.fill_diagonal(both, 500.0)
    with pytest.raises(ValueError):
        simhash.make_plan(1000, both, 80)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skewed_join_deals_a_heavy_key_out(spark, how):
    from pyspark.sql import functions as F

    from tubeql.llm.common import skew_join

    fact = spark.range(8000).select(F.when(F.col("id") < 6000, 1).when(F.col("id") < 7000, F.col("id")).alias("k"), "id").repartition(4)
    dim = spark.range(0, 6500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skew_join(fact, dim, "k", how)
        assert joined.columns == ["k", "id", "v"]
        want = fact.join(dim, "k", how)
        assert sorted(map(str, joined.collect())) == sorted(map(str, want.collect()))
        sizes = [r[0] for r in joined.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert max(sizes) < 6000 <= sum(sizes)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.report(df).collect() == [] and simhash.deduplicate(df).collect() == []
