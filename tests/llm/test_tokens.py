"""Operators 1 and 4 against the tokenizers library."""

from __future__ import annotations

import random
from struct import unpack

import pytest
from cohortwise.llm import bpe, token_counts

PARTS = ["a", "the", "'re", "'s", "'ll", " ", "  ", "\n", "\t", "é", "ñ", "1", "2½", "Ⅷ", "!", "<|endoftext|>", "<|endo", "!!", "漢字", "ing", "\x1c", "ſ", "🙂", "_", "don't", "'", "'v"]


@pytest.fixture(scope="module")
def tables(vocabulary):
    return bpe.Vocabulary.parse(open(vocabulary, encoding="utf-8").read())


def ids_of(packed: bytes) -> list[int]:
    return list(unpack(f"<{len(packed) // 4}I", packed))


def test_every_prefix_and_every_id(tables, tokenizer):
    encode, counter = bpe.encoder(tables), token_counts.PrefixCounter(tables)
    random.seed(3)
    for _ in range(400):
        text = "".join(random.choice(PARTS) for _ in range(random.randint(0, 12)))
        assert ids_of(encode(text)) == tokenizer.encode(text, add_special_tokens=False).ids
        wanted = [len(tokenizer.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert counter.prefix_counts(text).tolist() == wanted, text


def test_pieces_of_every_character():
    from tokenizers.pre_tokenizers import ByteLevel

    split, find = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str, bpe.splitter()
    for low in range(0, 0x30000, 64):
        text = "".join(f"a{c}a 1{c}1 !{c}! {c}" for c in map(chr, range(low, low + 64)) if not 0xD800 <= ord(c) < 0xE000)
        assert [text[a:b] for _, (a, b) in split(text)] == find(text), hex(low)


def test_stale_entries_are_skipped():
    merges = {1 << 32 | 2: (0, 10), 2 << 32 | 3: (1, 11), 10 << 32 | 3: (2, 12)}
    assert bpe.merge_symbols([1, 2, 3], merges) == [12]
    assert bpe.merge_symbols([2, 3, 1, 2], merges) == [11, 10]


def test_documents(documents, tokenizer, vocabulary):
    decoded = {r["doc_id"]: r for r in bpe.decode(bpe.encode(documents, vocabulary), vocabulary).collect()}
    counted = {r["doc_id"]: r for r in token_counts.token_counts(documents, vocabulary, [512], keep_prefixes=True).collect()}
    for r in documents.select("doc_id", "text").collect():
        ids = tokenizer.encode(r["text"], add_special_tokens=False).ids
        d, c = decoded[r["doc_id"]], counted[r["doc_id"]]
        assert ids_of(d["ids"]) == ids and d["text"] == tokenizer.decode(ids, skip_special_tokens=False) == r["text"]
        assert c["n_tokens"] == len(ids) and c["n_bytes"] == len(r["text"].encode())
        assert len(c["prefix_counts"]) == len(r["text"]) + 1 and c["prefix_counts"][c["fits"][0]] <= 512


def test_truncation(documents, tokenizer, vocabulary):
    counted = token_counts.token_counts(documents, vocabulary, [64], keep_prefixes=False)
    for r in token_counts.truncate(documents, counted, 64, [64]).limit(40).collect():
        assert len(tokenizer.encode(r["text"], add_special_tokens=False).ids) <= 64


def test_any_budget_from_stored_prefixes(documents, tokenizer, vocabulary, spark):
    """Ten budgets answered from one stored table: the longest prefix within each, by the tokenizer itself."""
    some = documents.where("length(text) < 400").limit(12)
    counted = token_counts.token_counts(some, vocabulary, [], keep_prefixes=True).persist()
    count = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
    whole = {r["doc_id"]: r["text"] for r in some.collect()}
    random.seed(11)
    for budget in [0, 1, 10**6, *(random.randint(2, 120) for _ in range(7))]:
        for r in token_counts.truncate(documents, counted, budget).collect():
            text = whole[r["doc_id"]]
            longest = max(k for k in range(len(text) + 1) if count(text[:k]) <= budget)
            assert r["text"] == text[:longest]
    counted.unpersist()
    bare = token_counts.token_counts(some, vocabulary, [64], keep_prefixes=False)
    with pytest.raises(ValueError, match="cannot answer 65"):
        token_counts.truncate(documents, bare, 65, [64])


def test_odd_rows(odd, odd_rows, empty, tokenizer, vocabulary):
    got = sorted(map(tuple, bpe.encode(odd, vocabulary).select("n_tokens").collect()))
    wanted = sorted((len(tokenizer.encode(t or "", add_special_tokens=False).ids),) for _, t in odd_rows)
    assert got == wanted
    assert sorted(map(tuple, token_counts.token_counts(odd, vocabulary, [1], False).select("n_tokens").collect())) == wanted
    assert bpe.decode(bpe.encode(empty, vocabulary), vocabulary).count() == 0
    assert token_counts.token_counts(empty, vocabulary, [1]).count() == 0
