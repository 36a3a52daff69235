import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from longbox.llm import pairtree
from longbox.llm.memo import Memo

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def pairs():
    return pairtree.Pairs(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(packed):
    return np.frombuffer(packed, "<i4").tolist()


@settings(deadline=None, max_examples=300)
@given(st.lists(st.text(max_size=80), max_size=5))
def test_ids_and_texts_equal_the_librarys(pairs, library, texts):
    for text, packed in zip(texts, pairs.encode(texts)):
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids(packed) == expected
        assert pairs.decode(np.array(expected, np.int64)).tobytes().decode() == library.decode(expected, skip_special_tokens=False)


@settings(deadline=None, max_examples=200)
@given(st.binary(min_size=1, max_size=64))
def test_forest_and_tree_merge_alike(pairs, word):
    ranks = pairs.ranks
    leaves = 1 << (len(word) - 1).bit_length()
    assert ranks.merge_forest([word, word], leaves) == [ranks.merge_tree(word)] * 2


def least_pair_first(pairs, word):
    """All pairs are looked at before each merge."""
    rank_of = dict(zip(pairs.ranks.keys.tolist(), pairs.ranks.ranks.tolist()))
    parts = pairs.ranks.byte_ids[np.frombuffer(word, np.uint8)].tolist()
    while True:
        ranked = [(r, i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank_of.get((a << 32) | b)) is not None]
        if not ranked:
            return parts
        rank, i = min(ranked)
        parts[i : i + 2] = [int(pairs.ranks.results[rank])]


@settings(deadline=None, max_examples=100)
@given(st.text(alphabet="aethnr s", min_size=1, max_size=100))
def test_merges_equal_those_of_a_scan(pairs, text):
    word = text.encode()
    assert ids(pairs.ranks.merge([word])[0]) == least_pair_first(pairs, word)


def test_long_pre_tokens_and_added_tokens(pairs, library):
    texts = ["a" * 5000, "é$" * 3000, "  \n" * 2000 + "x", "", "<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftext", "thntreor" * 400]
    assert [ids(p) for p in pairs.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_plain_takes_added_tokens_as_text(library):
    plain = pairtree.Pairs(PATH, public_tokenizers.PATTERN, plain=True)
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    text = "x <|endoftext|> y"
    assert ids(plain.encode([text])[0]) == own.encode(text, add_special_tokens=False).ids


def test_bytes_that_are_no_text_decode_as_the_librarys(pairs, library, spark):
    lists = [[int(i) for i in pairs.ranks.byte_ids[list("é€😀".encode()[:n])]] for n in range(10)]
    rows = [(i, tokens) for i, tokens in enumerate(lists)] + [(10, None), (11, [])]
    out = pairtree.decode_descriptions(spark.createDataFrame(rows, "id BIGINT, tokens ARRAY<INT>"), PATH, public_tokenizers.PATTERN)
    got = {r["id"]: r["decoded"] for r in out.collect()}
    assert got == {i: library.decode(t, skip_special_tokens=False) for i, t in enumerate(lists)} | {10: None, 11: ""}


def test_an_unknown_id_is_an_error(pairs):
    for bad in (-1, 50257):
        with pytest.raises(ValueError, match="no token"):
            pairs.decode(np.array([bad]))


def test_edge_rows(spark, library):
    rows = [(1, "It's a first issue.", 0), (1, "It's a first issue.", 1), (2, None, 2), (3, "", 3), (None, "x<|endoftext|>" * 2000, 4)]
    issues = spark.createDataFrame(rows, "id BIGINT, description STRING, tokens INT")
    out = pairtree.encode_descriptions(issues, PATH, public_tokenizers.PATTERN)
    out = pairtree.decode_descriptions(out, PATH, public_tokenizers.PATTERN).collect()
    assert sorted((r["id"] or 0, r["decoded"]) for r in out) == sorted((a or 0, b or "") for a, b, _ in rows)
    for row in out:
        assert row["tokens"] == library.encode(row["decoded"], add_special_tokens=False).ids
    assert pairtree.encode_descriptions(issues.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_the_memo_keeps_what_it_meets_again():
    asked = []

    def packed_of(words):
        asked.extend(words)
        return [w.encode() for w in words]

    memo = Memo(packed_of, bound=700)
    assert memo.packed([["a", "b"], ["a"]]) == [b"ab", b"a"]
    assert memo.packed([["a", "c", "d"]]) == [b"acd"]
    assert memo.packed([["a", "e"]]) == [b"ae"]
    assert set(memo.known) == {"a", "e"} and asked.count("a") == 1
    assert memo.packed([[], ["b"]]) == [b"", b"b"] and asked.count("b") == 2
