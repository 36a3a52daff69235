import random
import re

import pyarrow as pa

from longbox.llm import neardup

DDL = "id BIGINT, description STRING, label STRING"


def words(text):
    lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingles(text):
    own = words(text)
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def brute(rows):
    """(id, n, component, kept) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    least = {i: i for i, _ in rows if i is not None}
    pairs = [
        (rows[a][0], rows[b][0])
        for a in range(len(rows)) for b in range(a)
        if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b]
        and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return sorted(((i, len(s), least.get(i), i is not None and least[i] == i) for (i, _), s in zip(rows, sets)), key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], DDL)
    return sorted((tuple(r) for r in neardup.near_duplicates(df).collect()), key=repr)


def corpus(seed, groups=25, hot=60):
    draw = random.Random(seed)
    text = lambda n: [f"w{draw.randrange(3000)}" for _ in range(n)]
    rows = []
    for g in range(groups):
        base = text(draw.randrange(20, 120))
        for _ in range(hot if not g else draw.randrange(1, 8)):
            own = list(base)
            for _ in range(draw.randrange(0, 1 + len(own) // 30)):
                own[draw.randrange(len(own))] = f"x{draw.randrange(9999)}"
            rows.append(" ".join(own))
    rows += ["one two", "ONE  two\n", "one two three", "", None, " \t"]
    draw.shuffle(rows)
    return list(enumerate(rows))


def test_components_equal_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        wanted = brute(rows)
        assert run(spark, rows) == wanted
        assert len({r[2] for r in wanted}) < len(wanted) - 50


def test_rare_shingles_find_every_similar_pair(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SHARING", 3)
    draw = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for own in range(40):
        # A passage that all share, and something of one's own, below and above the threshold.
        texts.append(" ".join(base + [f"o{own}-{i}" for i in range(draw.randrange(2, 16))]))
    texts += [" ".join(t) for t in (base[:30], base[:29] + ["z"], ["z"] + base[:31], base[:5], base[:4], base[:6])]
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    wanted = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    made = neardup.shingle_sets(pa.array(texts))
    rows = [(i, [int(x) for x in s.view("int64")]) for i, s in enumerate(made)]
    df = spark.createDataFrame(rows + rows[:1], "id BIGINT, shingles ARRAY<BIGINT>")
    members = df.selectExpr("id % 2 AS bucket", "id AS rep", "size(shingles) AS n", "1 AS weight", "id AS label")
    pairs = neardup._rare(members, df)
    got = {(r["u"], r["v"]) for r in neardup._confirmed(pairs, df).collect()}
    assert got == wanted and 0 < len(wanted) < 40 * 39 // 2
    assert pairs.count() < 40 * 39 // 2
    # Pairs of one label are no longer asked for.
    assert neardup._rare(members.selectExpr("bucket", "rep", "n", "weight", "7 AS label"), df).isEmpty()


def test_edge_rows(spark):
    long = " ".join(f"w{i % 7919}" for i in range(40000))
    rows = [(5, long), (3, long + " end"), (None, long), (7, "a b c d e f"), (7, "q r s t u v"), (9, "A B C D E F"), (8, "q r\ts t u V"),
            (4, ""), (4, None), (2, "é è\x1c x"), (1, "É è\x1c x")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:0]) == []
    kept = neardup.without_near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in rows], DDL))
    assert kept.columns == ["id", "description", "label"]
    assert sorted(repr(r["id"]) for r in kept.collect()) == ["1", "2", "3", "4", "4", "7", "7", "None"]


def test_a_pair_at_the_threshold_is_linked(spark):
    # 6 of 8 shingles in common
    a = "a b c d e f g h i j k".split()
    rows = [(1, " ".join(a)), (2, " ".join(a[1:] + ["z"])), (3, " ".join(a[2:] + ["y", "z"]))]
    assert run(spark, rows) == brute(rows)


def test_words_are_split_at_ascii_white_space_only():
    texts = ["a\x1cb c\x85d e", " x\x0by\x0cz ", "ÀB\tcD"]
    sets = neardup.shingle_sets(pa.array(texts + ["a\x1cb  c\x85d e\r\n", "x y z", "Àb cd"]))
    assert [s.tolist() for s in sets[:3]] == [s.tolist() for s in sets[3:]] and all(len(s) == 1 for s in sets)


def test_signatures_estimate_similarity():
    draw = neardup.np.random.default_rng(1)
    circulant = neardup.Circulant()
    common, a, b = (draw.integers(0, 2**63, n).astype(neardup.np.uint64) for n in (600, 100, 100))
    one, two = (circulant.signature(neardup.np.concatenate([common, x])) for x in (a, b))
    assert abs((one == two).mean() - 0.75) < 0.15
