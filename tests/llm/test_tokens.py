import random
from collections import Counter

import numpy as np
import pytest

from lexiquarry.llm import bpe, unigram
from lexiquarry.llm.queries import tokenizer_file

R = random.Random(3)
ALPHABET = "ab cd  \n\t'sdtlv re09éß中 \xa0\x85\x1c.,!?-<|endoftext|>$#ĠÁ"
TEXTS = ["", "a", "x" * 3000, " " * 50, "ab" * 900, "a<|endoftext|> b", "\n \n x \n\t y", " lead", "tail "] + ["".join(R.choice(ALPHABET) for _ in range(R.randint(1, 80))) for _ in range(3000)]


def test_bpe_equals_tokenizers():
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_file("byte_bpe_50k.json")
    theirs, ours = tokenizers.Tokenizer.from_file(path), bpe.Model(path)
    for text, a, b in zip(TEXTS, theirs.encode_batch(TEXTS, add_special_tokens=False), ours.encode(TEXTS), strict=True):
        assert np.array(a.ids, "<u4").tobytes() == b, text
        assert ours.decode(b).decode() == theirs.decode(a.ids, skip_special_tokens=False)


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_counts_equal_tokenizers(fallback):
    tokenizers = pytest.importorskip("tokenizers")
    pieces = unigram.vocabulary(tokenizer_file("piece_bpe_32k.model"))
    t = tokenizers.Tokenizer(tokenizers.models.Unigram(pieces, 0, fallback))
    t.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    c = unigram.Counter(pieces, fallback)
    for text in TEXTS:
        assert len(t.encode(text, add_special_tokens=False).ids) == unigram.count_text(c, text), repr(text)


def test_unigram_ties_and_nulls():
    tokenizers = pytest.importorskip("tokenizers")
    pieces = [("<unk>", 0.0)] + [(p, -float(s)) for p, s in (("▁", 1), ("a", 1), ("b", 1), ("ab", 2), ("ba", 2), ("aba", 3), ("▁a", 2))]
    t = tokenizers.Tokenizer(tokenizers.models.Unigram(pieces, 0, False))
    t.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    c = unigram.Counter(pieces, False)
    for _ in range(500):
        text = "".join(R.choice("abx ") for _ in range(R.randint(0, 12)))
        assert len(t.encode(text, add_special_tokens=False).ids) == unigram.count_text(c, text), repr(text)
    assert unigram.count_text(c, None) == 0


def test_token_counts_of_a_table(spark):
    path = tokenizer_file("piece_bpe_32k.model")
    c = unigram.Counter(unigram.vocabulary(path), True)
    rows = [(1, "some text"), (1, "some text"), (2, None), (3, ""), (None, "no id  here "), (4, "x" * 5000 + " " + "中" * 3000)]
    docs = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, n_tokens string")
    got = unigram.token_counts(docs, path)
    assert got.columns == ["doc_id", "n_tokens"]
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((d, unigram.count_text(c, t)) for d, t in rows), key=key)
    assert unigram.token_counts(docs.where("false"), path).count() == 0


def test_memories_are_bounded(monkeypatch):
    path = tokenizer_file("piece_bpe_32k.model")
    monkeypatch.setattr(unigram, "REMEMBERED", 50)
    c = unigram.Counter(unigram.vocabulary(path), True)
    for k in range(500):
        unigram.count_text(c, f"word{k} " + "long" * 40)
    assert len(c) <= 50 and max(map(len, c)) <= unigram.SHORT
    monkeypatch.setattr(bpe, "REMEMBERED", 20_000)
    m, fresh = bpe.Model(tokenizer_file("byte_bpe_50k.json")), bpe.Model(tokenizer_file("byte_bpe_50k.json"))
    for k in range(40):
        texts = [f"word{k} and{k}x{j} " + "long" * 40 for j in range(20)]
        assert m.encode(texts) == fresh.encode(texts)
        assert max(map(len, [*m.first, *m.later]), default=0) <= bpe.SHORT
    assert m.held < 40_000


def test_words_met_again_are_not_encoded_again(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20_000)
    m, done = bpe.Model(tokenizer_file("byte_bpe_50k.json")), Counter()
    many = m.encode_many
    monkeypatch.setattr(m, "encode_many", lambda pieces: done.update(pieces) or many(pieces))
    for k in range(200):
        once = "".join(chr(97 + int(c)) for c in str(k))
        m.encode([f"a common q{once} and common, too"])
    assert done[b" common"] == 1
