import hashlib
import math
import struct
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
import xxhash
from test_decontaminate import grams
from test_line_dedup import brute as brute_lines  # noqa: F401
from test_quality import base
from test_simhash import brute_near
from tokenizers import Tokenizer

from tubeql.llm import quality
from tubeql.llm.common import table


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def buckets(text):
    h = [xxhash.xxh64_intdigest(w, 42) for w in (text or "").encode().split()]
    pairs = [xxhash.xxh64_intdigest(struct.pack("<Q", b), xxhash.xxh64_intdigest(struct.pack("<Q", a), 42)) for a, b in zip(h, h[1:])]
    return [signed(x) % quality.LEAST_BUCKETS for x in h + pairs]


def brute_quality(rows, labels):
    good = {d for d, q in labels if q == 1} - {d for d, q in labels if q == 0}
    raw, target, each = Counter(), Counter(), []
    for d, t in rows:
        each.append(buckets(t))
        raw.update(each[-1])
        if d in good:
            target.update(each[-1])
    part = sum(target.values()) / max(1, sum(raw.values()))
    w = {b: math.log((target[b] / part + quality.SMOOTH) / (raw[b] + quality.SMOOTH)) for b in raw} if part else Counter()
    return [r for r, g in zip(rows, each) if not base(r[1])[5] and sum(w[b] for b in g) / max(1, len(g)) >= quality.THRESHOLD]


def brute_drop(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    return [(d, "\n".join(x for x in t.split("\n") if not key(x) or seen[key(x)] < 10)) for d, t in rows]


def brute_clean(rows, items):
    want = [grams(t, 5) for _, t in items]
    return [(d, t) for d, t in rows if not any(len(q & g) >= 0.8 * len(q) for g in [grams(t, 5)] for q in want)]


def brute_tokens(rows):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    out = []
    for d, t in rows:
        ids = tok.encode(t, add_special_tokens=False).ids
        packed = struct.pack(f"<{len(ids)}I", *ids)
        out.append((d, len(ids), sha(packed), sha(tok.decode(ids, skip_special_tokens=False).encode()), packed))
    return out


def test_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    labels = [(r.doc_id, r.quality) for r in table(spark, sf, "labels").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    sizes = [len(rows)]
    for step in (lambda x: brute_quality(x, labels), brute_drop, brute_near, lambda x: brute_clean(x, items)):
        rows = step(rows)
        sizes.append(len(rows))
    assert sizes[0] > sizes[1] and sizes[2] > sizes[3] and sizes[3] > sizes[4]
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids)) for r in got.collect()) == sorted(brute_tokens(rows))


#: Every working name of the stages.
NAMES = ["_kept", "_score", "_base", "_b", "_w", "b", "w", "judged", "t", "id", "k1", "k2", "_k1", "_k2", "bitmap", "_bitmap", "n_lines", "n_dropped", "fp", "head", "rows", "stays", "key", "grams", "c0", "C1", "a.b", "_salt", "_salts", "_n", "_k"]


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns_and_bear_odd_rows(spark, sf, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{x}` int" for x in NAMES)
    more = tuple(range(len(NAMES)))
    good = " ".join(f"the word{i} of" for i in range(40))
    odd = [(1, None, None, None, None, *more), (None, "", "x", "y", 0, *more), (1, None, None, None, None, *more), (2, "word " * 200_000, "en", "s", 1_000_000, *more), (3, good, "en", None, len(good), *more)]
    name, step = corpus_pipeline.STAGES[stage]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        out = step(spark, docs, sf)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        got = out.collect()
        assert len(got) == {"quality rules": 1, "line dedup": 5, "SimHash near-dedup": 3, "benchmark decontamination": 5}[name] * bool(rows)
        assert all(tuple(r)[5:] == more for r in got)
