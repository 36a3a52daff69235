import io

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from longbox.llm import memo, tokenfiles

PATH = public_tokenizers.path("byte_bpe_50k.json")
DDL = "id BIGINT, description STRING, ids STRING"


@pytest.fixture(scope="module")
def library():
    return tokenfiles.Library(PATH, public_tokenizers.PATTERN)


@settings(deadline=None, max_examples=300)
@given(st.text(max_size=60))
def test_ids_equal_the_librarys(library, text):
    assert np.frombuffer(library.encode([text])[0], "<i4").tolist() == library.tokenizer.encode(text, add_special_tokens=False).ids


def test_added_tokens_and_long_texts(library):
    for text in ["a<|endoftext|>b", "x  \n y" * 3000, "é" * 5000]:
        assert np.frombuffer(library.encode([text])[0], "<i4").tolist() == library.tokenizer.encode(text, add_special_tokens=False).ids


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet="ab1'.é \n\t\r\x1c\x85\u00a0\u2028\u3000", max_size=40))
def test_white_space(library, text):
    assert " ".join(memo.words(text)) == text
    assert np.frombuffer(library.encode([text])[0], "<i4").tolist() == library.tokenizer.encode(text, add_special_tokens=False).ids


def test_words_met_before_are_not_split_again(library, monkeypatch):
    library.encode(["x don't. stop, don't."])
    split = []
    monkeypatch.setattr(library, "split", lambda text: split.append(text) or [text])
    whole = library.encode(["x stop, don't. " * 50 + "stop,"])[0]
    assert split == ["x"] and len(whole) == 4 * len(library.tokenizer.encode("x stop, don't. " * 50 + "stop,").ids)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.text(alphabet="ab1'.é \n\t\x1c\u00a0", max_size=20) | st.just("a<|endoftext|>b"), max_size=6))
def test_texts_encoded_together(library, texts):
    # Words of all texts are new, and split together.
    library.memo = memo.Memo(library._after_spaces)
    got = [np.frombuffer(ids, "<i4").tolist() for ids in library.encode(texts)]
    assert got == [library.tokenizer.encode(text, add_special_tokens=False).ids for text in texts]


def test_a_word_is_looked_up_once_a_portion(library, monkeypatch):
    asked = []
    monkeypatch.setattr(library, "memo", memo.Memo(lambda new: asked.extend(new) or library._after_spaces(new)))
    monkeypatch.setattr(library.memo, "get", lambda word, get=library.memo.get: asked.append((word,)) or get(word), raising=False)
    texts = ["a few words. more words."] * 500 + ["a  few words."]
    got = library.encode(texts)
    assert sorted(x for x in asked if isinstance(x, tuple)) == sorted({("few",), ("words.",), ("more",), (" few",)})
    assert np.frombuffer(got[-1], "<i4").tolist() == library.tokenizer.encode(texts[-1]).ids


def test_older_words_of_a_memo():
    known = memo.Memo(lambda new: [word.encode() for word in new], bound=1000)
    for n in range(200):
        some = [f"w{i % 7}" for i in range(n, n + 5)]
        assert known.each(some) == [word.encode() for word in some]
        assert known.bytes == sum(2 * len(w) + memo.OVERHEAD for w in known) + known.older_bytes


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 2**32 - 1), st.integers(0, 32), st.integers(0, 3000), st.integers(0, 5))
def test_blocks_read_back(base, width, n, outliers):
    draw = np.random.default_rng(n)
    ids = (base + draw.integers(0, 2**width, n, dtype=np.uint64)).clip(0, 2**32 - 1).astype(np.uint32)
    ids[draw.integers(0, n, outliers) if n else []] = 2**32 - 1
    lengths = [n // 3, 0, n - n // 3]
    data = io.BytesIO(b"".join(tokenfiles.file_bytes([5, None, -7], lengths, ids)))
    got = list(tokenfiles.read_file(data.read))
    assert [(i, a) for i, a, _ in got] == [(5, 0), (None, n // 3), (-7, n // 3)]
    assert [len(x) for _, _, x in got] == lengths and np.array_equal(np.concatenate([x for _, _, x in got]), ids)
    assert not data.read()


def test_outliers_are_exceptions():
    ids = np.full(1024, 7, np.uint32)
    ids[::100] = 50_000
    block = tokenfiles.pack(ids)[0][0]
    assert tokenfiles._BLOCK_HEAD.unpack_from(block) == (7, 0, 11) and len(block) == 7 + 11 * 6


def test_files_read_back_in_order(spark, library, monkeypatch):
    monkeypatch.setattr(tokenfiles, "FILE_IDS", 300)
    rows = [((i * 37) % 101, f"issue {i} " * (i % 40), "x") for i in range(101)] + [(None, "no id", "x"), (5, None, "x"), (5, "", "x"), (-3, "w" * 9000, "x")]
    files = tokenfiles.write_token_files(spark.createDataFrame(rows, DDL).repartition(3), PATH, public_tokenizers.PATTERN, 2)
    assert files.agg({"issues": "sum"}).first()[0] == len(rows)
    got = tokenfiles.read_token_files(files).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for (issue_id, text, _), row in zip(order, got, strict=True):
        ids = library.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert (row["id"], row["start"], np.frombuffer(row["ids"], "<u4").tolist()) == (issue_id, at, ids)
        at += len(ids)
    empty = tokenfiles.write_token_files(spark.createDataFrame([], DDL), PATH, public_tokenizers.PATTERN, 2)
    assert tokenfiles.read_token_files(empty).count() == 0
