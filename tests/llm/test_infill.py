import hashlib

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from longbox.llm import infill


def by_code_points(issue_id, text, choice):
    """The same over Python's code points."""
    digest = hashlib.sha256(f"{choice.seed}:{'' if issue_id is None else issue_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= choice.plain_from:
        return n, "plain", None, None, text
    head, middle, tail = text[:a], text[a:b], text[b:]
    if h[3] % 100 < choice.spm_below:
        return n, "spm", a, b - a, f"<S>{tail}<P>{head}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{head}<S>{tail}<M>{middle}"


TEXTS = st.text(alphabet="ab<>PSM é€😀́\x00\n", max_size=40)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 10**12)), TEXTS), max_size=6))
def test_equals_cuts_by_code_points(rows):
    choice = infill.Choice(plain_from=80, spm_below=50)
    out = infill.transform_batch([i for i, _ in rows], pa.array([t for _, t in rows], pa.string()), choice)
    assert list(zip(*[c.to_pylist() for c in out.columns])) == [by_code_points(i, t, choice) for i, t in rows]


@settings(deadline=None, max_examples=100)
@given(TEXTS)
def test_cuts_go_there_and_back(text):
    index = infill.CutIndex(infill.np.frombuffer(text.encode(), infill.np.uint8))
    points = infill.np.arange(len(text) + 1)
    at = index.to_bytes(points)
    assert at.tolist() == [len(text[:i].encode()) for i in points]
    assert index.to_points(at).tolist() == points.tolist()


def test_slices_of_a_batch_count_from_their_own_start():
    texts = pa.array(["é" * 9, "x😀y" * 5, "plain"])
    whole = infill.transform_batch([1, 2, 3], texts, infill.Choice())
    assert infill.transform_batch([2, 3], texts.slice(1), infill.Choice()).to_pylist() == whole.slice(1).to_pylist()


def test_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(infill, "PORTION", 1000)
    rows = [(i, f"text {'é' * i} of issue {i} < > <P", "x") for i in range(60)]
    rows += [(7, "the same id", "y"), (60, None, "n"), (61, "", "n"), (62, "a <S> mark", "n"), (None, "no id 😀", "n"), (63, "ü" * 30000, "n")]
    issues = spark.createDataFrame(rows, "id BIGINT, description STRING, form STRING")
    out = infill.transform_descriptions(issues)
    out = out.withColumn("restored", infill.restored(out["output"], out["form"])).collect()
    key = lambda row: (row[0] is None, row)
    expected = [(i, *by_code_points(i, t or "", infill.Choice()), t or "") for i, t, _ in rows]
    assert sorted(map(tuple, out), key=key) == sorted(expected, key=key)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    assert infill.transform_descriptions(issues.limit(0)).count() == 0
