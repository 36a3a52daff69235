import base64

import pytest
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from longbox.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def words():
    return bpe.Vocabulary(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(packed):
    return memoryview(packed).cast("i").tolist()


def test_perfect_hash_is_minimal_and_exact(words):
    table = words.whole
    assert (table.values >= 0).all() and len(set(table.values)) == len(table.keys)
    assert (table.lookup(table.keys) == table.values).all()
    assert table.lookup(bpe.np.array(["thntreor", "", "zzzzzzzqq"], dtype=object)).tolist() == [-1, -1, -1]


@settings(deadline=None, max_examples=300)
@given(st.text(max_size=60))
def test_ids_equal_the_librarys(words, library, text):
    got = ids(words.encode([text])[0])
    assert got == library.encode_ordinary(text)
    assert words.decode(bpe.np.array(got, int)).tobytes() == text.encode()


def test_long_pre_tokens(words, library):
    for text in ["a" * 5000, "é$" * 3000, "  \n" * 2000 + "x", "thntreor" * 400]:
        assert ids(words.encode([text])[0]) == library.encode_ordinary(text)


def test_edge_rows(spark, library):
    rows = [(1, "It's a first issue.", 0), (1, "It's a first issue.", 1), (2, None, 2), (3, "", 3), (None, "x" * 20000, 4)]
    issues = spark.createDataFrame(rows, "id BIGINT, description STRING, tokens INT")
    out = bpe.decode_descriptions(bpe.encode_descriptions(issues, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).collect()
    assert sorted((r["id"] or 0, bytes(r["decoded"]).decode()) for r in out) == sorted((a or 0, b or "") for a, b, _ in rows)
    for row in out:
        assert row["tokens"] == library.encode_ordinary(bytes(row["decoded"]).decode())
    assert bpe.encode_descriptions(issues.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet="a'sé1. \n\t\u00a0\x1c", max_size=30))
def test_white_space_of_all_kinds(words, library, text):
    assert ids(words.encode([text])[0]) == library.encode_ordinary(text)


def test_the_memo_is_bounded(words, library):
    words.encoder.memo = bpe.Memo(words._packed, bound=1500)
    for text in ["some words fill it", "other words fill it again", "some words fill it"] * 3:
        assert ids(words.encode([text])[0]) == library.encode_ordinary(text)
    assert words.encoder.memo.bytes < 1500 + 6 * 300


def test_decode_of_nulls_and_unknown_ids(spark, words):
    table = bpe.vocabulary(spark, PATH, public_tokenizers.PATTERN)
    rows = spark.createDataFrame([(1, [words.ranks[b"a"]] * 2), (2, None), (3, [])], "id INT, tokens ARRAY<INT>").coalesce(1)
    got = {r[0]: r[1] for r in rows.select("id", bpe.decode(rows["tokens"], table)).collect()}
    assert got == {1: b"aa", 2: None, 3: b""}
    for bad in (-1, 10**6):
        with pytest.raises(ValueError, match="no token"):
            words.decode(bpe.np.array([bad]))


@settings(deadline=None, max_examples=200)
@given(st.lists(st.binary(min_size=1, max_size=64), min_size=1, max_size=5))
def test_words_merged_together_and_alone_are_alike(words, pieces):
    assert words.merger.merge_many(pieces, 64) == [words.merger.merge_one(piece) for piece in pieces]


@settings(deadline=None, max_examples=100)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 50)), max_size=60))
def test_heaps_give_the_least_first(steps):
    held = [[5, 9], [], [1]]
    rows = bpe.np.array([[5, 9], [bpe.NONE] * 2, [bpe.NONE, 1]])
    heaps = bpe.Heaps(rows, 64)
    for row, value in steps:
        if value % 3 and held[row]:
            assert heaps.pop(bpe.np.array([row]))[0] == min(held[row])
            held[row].remove(min(held[row]))
        else:
            heaps.push(bpe.np.array([row]), bpe.np.array([value]))
            held[row].append(value)
    assert heaps.size.tolist() == [len(x) for x in held]
