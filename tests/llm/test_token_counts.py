import random

import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from tubeql.llm import token_counts as tc
from tubeql.llm.common import table

PATH = P.path("byte_bpe_50k.tiktoken")
OWN = tc.counter(PATH, P.PATTERN)
SCHEMA = "doc_id long, text string"


def full(text):
    return len(OWN.encoding.encode_ordinary(text))


def replaced(text, start, removed, insert):
    start = min(max(start, 0), len(text))
    return text[:start] + insert + text[start + max(removed, 0) :]


def test_random_edits_equal_full_counts():
    rng = random.Random(4)
    bits = ["the ", "a", "\n\n", "   ", " x", "'s", "'", "é", "12", "!!", " word", "\t", "🙂", " \n "]
    for _ in range(30):
        text = "".join(rng.choice(bits) for _ in range(rng.choice([0, 3, 200, 3000])))
        tree = tc.Tree(text, OWN)
        assert tree.total == full(text)
        for _ in range(25):
            start, removed = rng.randint(-3, len(text) + 3), rng.choice([0, 0, 1, 5, 40, 2000])
            insert = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 4, 60, 1500])))
            text = replaced(text, start, removed, insert)
            tree.edit(start, removed, insert)
            assert tree.text == text and tree.total == full(text) and tree.chars[1] == len(text)
            assert tree.pieces == len(OWN.pattern.findall(text)) == sum(tree.size)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=300), st.lists(st.tuples(st.integers(0, 300), st.integers(0, 20), st.text(max_size=20)), max_size=5))
def test_any_edits(text, edits):
    _, tree = tc.apply_edits(text, edits, OWN)
    for e in edits:
        text = replaced(text, *e)
    assert tree.total == full(text)


def test_a_small_edit_encodes_little():
    text = "some words of a long text, " * 20_000
    _, tree = tc.apply_edits(text, [(len(text) // 2, 3, "new"), (7, 1, "")], OWN)
    assert tree.encoded < 6 * tc.LEAF and tree.total == full(tree.text)


def test_documents_table(spark, sf):
    docs = table(spark, sf, "documents")
    got = {r.doc_id: r for r in tc.count(docs, PATH, P.PATTERN).collect()}
    for r in docs.collect():
        text = r.text
        for e in tc.standing_edits(len(r.text)):
            text = replaced(text, *e)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_tokens_after) == (full(r.text), full(text))


def test_edits_table_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "one two three", 3), (2, None, 3), (None, "free", 3), (1, "again", 3)], SCHEMA + ", seq int")
    edits = spark.createDataFrame([(1, 2, 0, 4, "", "x"), (1, 1, 4, 0, "and ", "x"), (9, 1, 0, 0, "q", "x"), (None, 1, 0, 0, "q", "x"), (2, 1, None, None, "new", "x"), (2, 2, 5, 5, None, "x")], "doc_id long, seq int, start int, removed int, insert string, text string")
    got = sorted(((r.doc_id, r.n_tokens, r.n_tokens_after) for r in tc.count(docs, PATH, P.PATTERN, edits).collect()), key=str)
    assert got == sorted([(1, full("one two three"), full("and two three")), (2, 0, full("new")), (None, full("free"), full("free")), (1, full("again"), full(replaced("againand "[0:4] + "and n", 0, 4, "")))], key=str)
    assert tc.count(spark.createDataFrame([], SCHEMA), PATH, P.PATTERN).collect() == []


def test_a_stored_table_is_edited_without_its_other_texts(spark, sf, tmp_path):
    """Trees are built once and written; two rounds of edits to the table equal full counts, and little is encoded."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    tc.build(docs, PATH, P.PATTERN).write.parquet(str(tmp_path / "0"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rng = random.Random(3)
    bits = ["the ", "a", "\n\n", "   ", " x", "'s", "'", "é", "12", "!!", " word", "🙂"]
    for step in range(2):
        rows = []
        for d in rng.sample(sorted(texts), 60):
            for seq in range(3):
                start, removed, insert = rng.randint(0, len(texts[d]) + 5), rng.choice([0, 3, 30]), "".join(rng.choice(bits) for _ in range(rng.choice([0, 2, 9])))
                rows.append((d, seq, start, removed, insert))
                texts[d] = replaced(texts[d], start, removed, insert)
        edits = spark.createDataFrame(rows, "doc_id long, seq int, start int, removed int, insert string")
        done = tc.apply(spark.read.parquet(str(tmp_path / str(step))), PATH, P.PATTERN, edits)
        done.write.parquet(str(tmp_path / str(step + 1)))
        after = spark.read.parquet(str(tmp_path / str(step + 1)))
        assert {r.doc_id: "".join(r.leaves) for r in after.collect()} == texts
        assert {r.doc_id: (r.n_tokens, r.n_pieces) for r in tc.counts(after).collect()} == {d: (full(t), len(OWN.pattern.findall(t))) for d, t in texts.items()}
        touched = {d for d, *_ in rows}
        encoded = {r.doc_id: r.n_encoded for r in after.collect()}
        assert all(n == 0 for d, n in encoded.items() if d not in touched)
        assert all(n <= 3 * 6 * tc.LEAF for n in encoded.values())
        assert sum(encoded.values()) <= len(rows) * 2 * tc.LEAF
