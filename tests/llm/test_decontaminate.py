import random
import re

from pyspark.sql import functions as F

from longbox.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    """(n_words, n_hit, item ids) by trying every window at every word."""
    own, hit, found = words(text), set(), set()
    for item_id, item in items:
        theirs = words(item)
        width = min(10, len(theirs))
        if item_id is None or not width:
            continue
        windows = {tuple(theirs[i : i + width]) for i in range(len(theirs) - width + 1)}
        for at in range(len(own) - width + 1):
            if tuple(own[at : at + width]) in windows:
                hit.update(range(at, at + width))
                found.add(item_id)
    return len(own), len(hit), sorted(found)


def material(seed):
    draw = random.Random(seed)
    text = lambda n, k: " ".join(f"w{draw.randrange(k)}" for _ in range(n))
    items = [(i, text(draw.randrange(1, 40), 30)) for i in range(30)] + [(90, "a a a a a a a a a a a a"), (91, "b b"), (None, "w1"), (92, None), (93, ".,")]
    items += [(94, items[3][1]), (95, "É È a b c d e f g h i")]
    rows = []
    for i in range(80):
        parts = [text(draw.randrange(0, 30), 60)]
        for _ in range(draw.randrange(3)):
            own = words(draw.choice(items)[1])
            start = draw.randrange(len(own) + 1)
            parts += [" ".join(own[start : start + draw.randrange(5, 30)]).upper(), text(3, 60)]
        rows.append((i, ", ".join(parts)))
    return rows + [(81, "a " * 30), (82, None), (83, ""), (None, "b-B"), (1, "b.b b"), (84, "x É È A b c d e f g h i y")], items


def run(spark, rows, items):
    issues = spark.createDataFrame([(i, t, 0) for i, t in rows], "id BIGINT, description STRING, matches INT")
    return issues, spark.createDataFrame([(i, t, "x") for i, t in items], "item_id BIGINT, text STRING, id STRING")


def test_hits_equal_brute_force(spark, monkeypatch):
    for seed, block in ((1, 1_000_000), (2, 60)):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        rows, items = material(seed)
        issues, evaluation = run(spark, rows, items)
        got = decontaminate.contamination(issues, evaluation).collect()
        found = [(r["id"], (r["n_words"], r["n_hit"], sorted({m["item_id"] for m in r["matches"]}))) for r in got]
        assert sorted(found, key=repr) == sorted(((i, brute(t, items)) for i, t in rows), key=repr)
        clean = [i for i, t in rows if not brute(t, items)[1]]
        left = decontaminate.without_contaminated(issues, evaluation)
        assert left.columns == issues.columns and sorted(map(repr, clean)) == sorted(repr(r["id"]) for r in left.collect())


def test_matches_are_the_longest(spark):
    item = " ".join(f"w{i}" for i in range(30))
    text = "start " + " ".join(f"W{i}" for i in range(5, 25)) + " middle " + item
    issues, evaluation = run(spark, [(1, text)], [(7, item)])
    row = decontaminate.contamination(issues, evaluation).first()
    assert sorted(tuple(m) for m in row["matches"]) == [(7, 0, 22, 30), (7, 5, 1, 20)] and row["n_hit"] == 50


def test_empty_tables(spark):
    issues, evaluation = run(spark, [(1, "some words")], [(7, "some words")])
    assert decontaminate.contamination(issues.limit(0), evaluation).count() == 0
    assert decontaminate.contamination(issues, evaluation.limit(0)).select("id", "n_words", "n_hit", F.size("matches")).first()[:] == (1, 2, 0, 0)
    assert decontaminate.without_contaminated(issues, evaluation.limit(0)).count() == 1


def brute_longest(text, item):
    """(word, n_words) of the matches from every window hit that no earlier one reaches beyond."""
    width, out, reach = min(10, len(item)), [], -1
    for at in range(len(text) - width + 1):
        lengths = [0]
        for there in range(len(item)):
            n = 0
            while at + n < len(text) and there + n < len(item) and text[at + n] == item[there + n]:
                n += 1
            lengths.append(n)
        if max(lengths) >= width and at + max(lengths) > reach:
            out.append((at, max(lengths)))
            reach = at + max(lengths)
    return out


def test_longest_matches_equal_brute_force():
    draw = random.Random(3)
    for _ in range(200):
        few = draw.choice([1, 2, 3, 8])
        item = [b"w%d" % draw.randrange(few) for _ in range(draw.randrange(1, 40))]
        text = [b"w%d" % draw.randrange(few + 1) for _ in range(draw.randrange(60))]
        for _ in range(draw.randrange(3)):
            start, at = draw.randrange(len(item)), draw.randrange(len(text) + 1)
            text[at:at] = item[start : start + draw.randrange(30)]
        items = decontaminate.Items([(7, item)])
        hit, owner, rows = decontaminate._matches(items, [[], [items.number.get(w, 0) for w in text], []])
        assert [(w, n) for _, _, w, n in rows.tolist()] == brute_longest(text, item) and set(owner) <= {1}
        assert all(i == 7 and item[q : q + n] == text[w : w + n] for i, q, w, n in rows.tolist())
        covered = {p for w, n in brute_longest(text, item) for p in range(w, w + n)}
        assert hit.tolist() == [0, len(covered), 0]


def test_repeated_words_take_no_product_of_places():
    import tracemalloc
    items = decontaminate.Items([(1, [b"a"] * 5000)])
    tracemalloc.start()
    hit, _, rows = decontaminate._matches(items, [[1] * 20000])
    assert hit.tolist() == [20000] and len(rows) == 15001 and tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
