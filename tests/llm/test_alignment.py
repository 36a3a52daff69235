from collections import Counter
from urllib.parse import urlparse

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from longbox.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ARGS = (A, public_tokenizers.PATTERN, B)


@pytest.fixture(scope="module")
def both():
    return alignment.Aligner(*ARGS)


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(both, libraries, text):
    """Ids by the libraries, none where either changes the text."""
    if not text:
        return [], []
    a = libraries[0].encode(f" {text}", add_special_tokens=False).ids
    b = libraries[1].encode(text)
    joined = [b"".join(side.tokens[i] for i in ids) for side, ids in ((both.first, a), (both.second, b))]
    return (a, b) if joined == [f" {text}".encode()] * 2 else ([], [])


def ends(sizes, ids):
    out, at = [], 0
    for i in ids:
        at += int(sizes[i])
        out.append(at)
    return out


def by_sets(a, b):
    """Group sizes from the set of common ends."""
    common = sorted(set(a) & set(b))
    at_a, at_b = [a.index(x) + 1 for x in common], [b.index(x) + 1 for x in common]
    return [y - x for x, y in zip([0, *at_a], at_a)], [y - x for x, y in zip([0, *at_b], at_b)]


@settings(deadline=None, max_examples=300)
@given(st.text(max_size=60))
def test_ids_equal_the_libraries(both, libraries, text):
    a, b, sizes_a, sizes_b = both.align([text])[0]
    a, b = a.tolist(), b.tolist()
    assert (a, b) == tokens(both, libraries, text)
    assert (sizes_a.tolist(), sizes_b.tolist()) == by_sets(ends(both.a.sizes, a), ends(both.b.sizes, b))


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet="ab '.▁<s/>\n\t\u00a0\u3000", max_size=40))
def test_spaces_and_controls(both, libraries, text):
    a, b, *_ = both.align([text])[0]
    assert (a.tolist(), b.tolist()) == tokens(both, libraries, text)


def test_many_texts_at_once(both, libraries):
    texts = ["the ▁ stop", "", "x\u00e9x  two\n\n three ", " the stop, the \ufb01rst", "the stop", "😀\t \u00a0 \n x", "a\x00b \x1c c", "▁", " ", "the"] * 2
    for text, (a, b, sizes_a, sizes_b) in zip(texts, both.align(texts), strict=True):
        a, b = a.tolist(), b.tolist()
        assert (a, b) == tokens(both, libraries, text)
        assert (sizes_a.tolist(), sizes_b.tolist()) == by_sets(ends(both.a.sizes, a), ends(both.b.sizes, b))


def test_words_met_before_are_not_aligned_again(both, monkeypatch):
    first = both.align(["issue don't stop."])[0]
    monkeypatch.setattr(both.second, "encode", lambda texts: [pytest.fail(f"asked for {text}") for text in texts])
    again = both.align(["issue don't stop. " * 40 + "stop."])[0]
    assert again[0].tolist() == first[0].tolist() * 40 + both.align(["stop."])[0][0].tolist()


def groups(a, b):
    return tuple(sizes.tolist() for sizes in alignment.align(alignment.np.array(a), alignment.np.array(b)))


@settings(deadline=None, max_examples=300)
@given(st.sets(st.integers(1, 200)), st.sets(st.integers(1, 200)))
def test_groups_end_at_all_common_ends(a, b):
    a, b = sorted(a | {201}), sorted(b | {201})
    assert groups(a, b) == by_sets(a, b)


def test_long_equal_stretches():
    a = list(range(1, 5001))
    b = [x for x in a if x not in (7, 4000, 4001)]
    assert groups(a, b) == by_sets(a, b)
    assert groups(b, a) == by_sets(b, a)
    assert groups([], []) == ([], [])


def brute(both, libraries, rows):
    encoded = {i: tokens(both, libraries, t) for i, t in rows}
    links, groups = {}, {}
    for i, (a, b) in encoded.items():
        ends_a, ends_b = ends(both.a.sizes, a), ends(both.b.sizes, b)
        place = {e: y for e, y in zip(ends_b, b)}
        links[i] = [(x, place[e]) for e, x in zip(ends_a, a) if e in place]
        said, ia, ib = [], 0, 0
        for m, n in zip(*by_sets(ends_a, ends_b)):
            said.append(",".join(map(str, a[ia : ia + m])) + "|" + ",".join(map(str, b[ib : ib + n])))
            ia, ib = ia + m, ib + n
        groups[i] = ";".join(said)
    counts = Counter(link for own in links.values() for link in own)
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    return {
        i: (len(encoded[i][0]), len(encoded[i][1]), len(own), sum(counts[x] == highest[x[1]] for x in own), sum(counts[x] for x in own), groups[i])
        for i, own in links.items()
    }


def test_scores_equal_brute_force(spark, both, libraries):
    texts = ["It's a first issue, the first one.", "It's a first issue, the first one.", None, "", "a ▁ b", "<|endoftext|></s>", "日本語 😀 ok  two  \n"]
    texts += [f"issue {i} thntreor {'xé' * i} of the thirteenth volume" for i in range(30)] + ["word " * 4000]
    rows = list(enumerate(texts))
    issues = spark.createDataFrame([(i, t, "x") for i, t in rows], "id BIGINT, description STRING, a STRING").repartition(3)
    out = alignment.align_and_score(issues, *ARGS)
    out = out.withColumn("said", alignment.groups_text(*[out[c] for c in ("a", "b", "a_sizes", "b_sizes")])).collect()
    got = {r["id"]: (len(r["a"]), len(r["b"]), r["n_links"], r["n_best"], r["count_sum"], r["said"]) for r in out}
    assert got == brute(both, libraries, rows)


def test_edge_rows(spark):
    issues = spark.createDataFrame([(None, "no id"), (1, "twice"), (1, "twice"), (None, None)], "id BIGINT, description STRING")
    out = alignment.align_and_score(issues, *ARGS).collect()
    assert sorted((r["id"] is None, r["n_links"]) for r in out) == [(False, 1), (False, 1), (True, 0), (True, 2)]
    assert alignment.align_and_score(issues.limit(0), *ARGS).count() == 0


def test_row_groups_hold_few_rows(spark, monkeypatch):
    monkeypatch.setattr(alignment, "ROW_GROUP", 1 << 16)
    issues = spark.range(1000).selectExpr("id", "repeat(concat('word', id, ' '), 200) AS description").coalesce(1)
    files = alignment.align_and_score(issues, *ARGS).inputFiles()
    assert max(pq.ParquetFile(urlparse(file).path).metadata.row_group(0).num_rows for file in files) < 1000


def test_link_table_holds_what_ends_together(both):
    table = alignment.LinkTable({0: b"ab", 1: b"b", 2: b"c"}, {0: b"b", 1: b"xab", 2: b""})
    pairs = [(int(k) >> 32, int(k) & 0xFFFFFFFF) for k in table.keys]
    assert pairs == [(0, 0), (0, 1), (1, 0), (1, 1)]
