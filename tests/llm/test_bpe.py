import hashlib
import random
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tubeql.llm import bpe
from tubeql.llm.common import table

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(PATH)
    tok.no_truncation()
    tok.no_padding()
    return tok


def expected(tok, text):
    ids = tok.encode(text or "", add_special_tokens=False).ids
    return ids, tok.decode(ids, skip_special_tokens=False)


CASES = [
    "", " ", "\n\t", "Hello, World!", "don't we'll THEY'RE I'd 's'", "<|endoftext|>", "a<|startoftext|>b <|ENDOFTEXT|> <|endoftext", "aaaa" * 50, "a" * 1000, "ΑΣ ΣΑΣ Σ", "İstanbul ẞ ﬁ", "été Å",
    "12345 ½ ² ٣", "日本語テキスト", "🙂🙃 ok👍🏽", "x y z　w", "a\x1cb\x1fc\x85d", "​﻿x", "###*** $$$ &&&%%%", "  leading and   trailing  ", "naïve café ÉÇñ", "x'sy'tz'", "thththth ererererer inin", "\x00\x01\x7f",
]


@pytest.mark.parametrize("text", CASES)
def test_cases(library, text):
    (ids,) = bpe.encoder(PATH).encode([text])
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == expected(library, text)[0]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aAbehinorst' .,\n1é", max_size=80)))
def test_any_text(text):
    tok = Tokenizer.from_file(PATH) if not hasattr(test_any_text, "tok") else test_any_text.tok
    test_any_text.tok = tok
    (ids,) = bpe.encoder(PATH).encode([text])
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == tok.encode(text, add_special_tokens=False).ids


def test_verified_words_equal_exact_merging():
    own, rng = bpe.Bpe(PATH), random.Random(5)
    words = {"".join(rng.choice(["th", "er", "in", "ou", "a", "s", "tion", "e", "é", "qu"]) for _ in range(rng.randint(1, 9))) for _ in range(5000)}
    own.learn(words)
    learned = {w: list(struct.unpack(f"<{len(own.words[w]) // 4}I", own.words[w])) for w in words}
    assert all(learned[w] == own.merge(own._symbols(w)) for w in words)
    proposed = [own.propose(own._symbols(w)) for w in words]
    assert any(p != learned[w] for w, p in zip(words, proposed))  # some proposals are refused
    assert any(p == learned[w] and len(p) > 1 for w, p in zip(words, proposed))


def test_heap_equals_scan():
    own, rng = bpe.Bpe(PATH), random.Random(7)
    for n in (2, 40, 200):
        s = "".join(rng.choice("abeinorst") for _ in range(n))
        ids = [own.vocab[x] for x in s[:-1]] + [own.vocab[s[-1] + own.end]]
        assert own._merge_long(ids) == own.merge(s)


def test_documents_table(spark, sf, library):
    docs = table(spark, sf, "documents")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest(docs, PATH).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for r in docs.collect():
        ids, text = expected(library, r.text)
        assert got[r.doc_id] == (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(text.encode()))


def test_nulls_and_empty_table(spark):
    rows = bpe.digest(spark.createDataFrame([(1, None, "q"), (None, "", "r"), (1, None, "q")], "doc_id long, text string, ids string"), PATH).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, rows), key=str) == sorted([(1, 0, nothing, nothing), (None, 0, nothing, nothing), (1, 0, nothing, nothing)], key=str)
    assert bpe.digest(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
