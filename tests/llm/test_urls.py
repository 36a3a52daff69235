from pyspark.sql import functions as F

from longbox.llm import urls

DDL = "url_hash STRING, url STRING, bad INT, host INT"
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def judged(spark, rows, rules=RULES):
    return {r["url_hash"]: r for r in urls.judge(spark.createDataFrame([(*r, 0) for r in rows], DDL), rules).collect()}


def plain(url):
    """(host, path, rule, verdict of the rule) by string handling."""
    before, sep, rest = (url or "").partition("://")
    ends = [i for i in (rest.find(c) for c in "/?#") if i >= 0]
    host = rest[: min(ends, default=len(rest))]
    tail = rest[len(host) :]
    path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for text, verdict in RULES:
        name, _, start = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(text) > len(best[0])):
            best = (text, verdict)
    return host, path, best


def test_hosts_paths_and_rules(spark):
    texts = ["http://a.example.net/en/1?x=/b", "https://WWW.Example.NET/de/1", "http://example.net/en", "http://xexample.com/de/", "http://b.example.com/de/9#x", "x.org/fr/",
             "http://x.org/fr/1", "http://org/fr/", "http://net", "http://net/", None, "", "http://", "a://b://c/d", "http://h?q#/x", "http://é.NET/\n/y", "mailto:x", "http://É.com/a"]
    got = judged(spark, [(str(i), u, None) for i, u in enumerate(texts)])
    for i, url in enumerate(texts):
        host, path, best = plain(url)
        row = got[str(i)]
        assert (row["host"], row["path"], row["rule"]) == (host, path, best and best[0]), url
        assert row["verdict"] == (best[1] if best else "allow")


def test_templates_of_a_host(spark):
    rows = [(str(i), f"http://a.com/{'spam' if i % 2 else 'news'}/{i}.html", i % 2 if i < 60 else None) for i in range(400)]
    rows += [(f"b{i}", f"http://b.com/{'xy'[i % 2]}/{i}", 0) for i in range(40)] + [("c", "http://c.com/spam/1", None)]
    got = judged(spark, rows)
    assert all(got[str(i)]["verdict"] == ("block" if i % 2 else "allow") for i in range(400))
    assert all(got[f"b{i}"]["verdict"] == "allow" for i in range(40)) and got["c"]["verdict"] == "allow"
    parts = spark.createDataFrame([(*r, 0) for r in rows], DDL).select(urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"), "bad")
    named = {tuple(r) for r in urls.templates(parts).select("host", "template", "rejected").distinct().collect()}
    # x and y do not differ, so they are one branch
    assert {r for r in named if r[0] != "c.com"} == {("a.com", "/spam/*", True), ("a.com", "/news/*", False), ("b.com", "/x|y/*", False)}


def test_edge_rows(spark):
    rows = [("1", "http://h.com", 1), ("1", "http://h.com", 1), (None, "http://h.com/", 0), ("3", "http://h.com//a//", None), ("4", "http://h.com/" + "a/" * 30, 1), ("5", None, 1)]
    out = urls.judge(spark.createDataFrame([(*r, 0) for r in rows], DDL), RULES)
    assert out.columns == ["url_hash", "host", "path", "rule", "verdict"] and out.count() == len(rows)
    assert out.filter("verdict NOT IN ('allow', 'block') OR verdict IS NULL").isEmpty()
    assert judged(spark, []) == {}


def test_small_sections_are_judged_by_their_labels(spark):
    """25 sections of 4 % each, five of them bad; clean sections of 1 % among bad ones; many small ids."""
    rows = [(f"a{s:02}.{i}", f"http://a.com/s{s:02}/{i}.html", int(s < 5) if i % 2 else None) for s in range(25) for i in range(40)]
    rows += [(f"b{s:02}.{i}", f"http://b.com/t{s:02}/{i}.html", int(s >= 30) if i % 2 else None) for s in range(100) for i in range(40)]
    rows += [(f"c{i}", f"http://c.com/{i // 5}/{i}", int(i % 7 == 0)) for i in range(1000)]
    got = judged(spark, rows)
    assert all(got[f"a{s:02}.{i}"]["verdict"] == ("block" if s < 5 else "allow") for s in range(25) for i in range(40))
    assert all(got[f"b{s:02}.{i}"]["verdict"] == ("block" if s >= 30 else "allow") for s in range(100) for i in range(40))
    assert all(got[f"c{i}"]["verdict"] == "allow" for i in range(1000))
    parts = spark.createDataFrame([(*r, 0) for r in rows], DDL).select(urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"), "bad")
    named = {tuple(r) for r in urls.templates(parts).select("host", "template", "n").distinct().collect()}
    # chance does not make an id a template; a branch of 70 segments has a short name
    assert ("c.com", "/*/*", 1000) in named and max(len(t) for _, t, _ in named) < 120


def levels(rows):
    """Templates by host and path, segment by segment in plain Python."""
    import math
    trees, out = {}, {}
    for host, path, bad in rows:
        trees.setdefault((host, "", 0), {}).setdefault(path, []).append(bad)
    name = lambda x: "\\..." if x == "..." else "".join("\\" + c if c in "\\|*" else c for c in x)
    log = lambda a, b: a * math.log(a / b) if a else 0.0
    while trees:
        later = {}
        for (host, node, depth), paths in trees.items():
            by = {}
            for path, bads in paths.items():
                parts = path.split("/")
                if len(parts) == depth:
                    out[host, path] = node[1:]
                else:
                    by.setdefault(parts[depth], {})[path] = bads
            count = {s: (sum(map(len, p.values())), sum(b is not None for v in p.values() for b in v), sum(b or 0 for v in p.values() for b in v)) for s, p in by.items()}
            n, labelled, bad = (sum(c[i] for c in count.values()) for i in range(3))
            tested = [s for s, c in count.items() if c[0] >= urls.FEW and c[1]]
            unlike = lambda b, m: log(b, m * bad / labelled) + log(m - b, m * (1 - bad / labelled))
            kept = [s for s, c in count.items() if c[0] >= urls.COMMON * n or s in tested and 0 < bad < labelled
                    and unlike(c[2], c[1]) + unlike(bad - c[2], labelled - c[1]) >= math.log(len(tested) / urls.LEVEL)]
            steps = {}
            for s in kept:
                at = steps.setdefault(math.floor((count[s][2] + 0.5) / (count[s][1] + 1) * urls.STEPS + 0.5), [0, 0, []])
                at[0], at[1], at[2] = at[0] + count[s][1], at[1] + count[s][2], at[2] + [s]
            share = lambda m, b: (b + 0.5) / (m + 1)
            branches = []
            for m, b, own in sorted(steps.values(), key=lambda x: share(x[0], x[1])):
                if branches:
                    last = branches[-1]
                    pooled = share(last[0] + m + 0.0, last[1] + b)
                    error = math.sqrt(pooled * (1 - pooled) * (1 / (last[0] + 1) + 1 / (m + 1)))
                    if share(m, b) - share(last[0], last[1]) < urls.ERRORS * error:
                        last[0], last[1], last[2] = last[0] + m, last[1] + b, last[2] + own
                        continue
                branches.append([m, b, list(own)])
            called = {}
            for _, _, own in branches:
                parts = [name(s) for s in sorted(own)]
                called.update(dict.fromkeys(own, "|".join(parts[: urls.NAMED] + ["..."] * (len(parts) > urls.NAMED))))
            for s, inside in by.items():
                later.setdefault((host, f"{node}/{called.get(s, '*')}", depth + 1), {}).update(inside)
        trees = later
    return out


def test_templates_equal_brute_force(spark):
    import random
    draw = random.Random(5)
    rows = []
    for host in ("a", "b"):
        for i in range(600):
            parts = [draw.choice(["x", "y", "x|y", "*", "...", "s\\t"]), draw.choice(["news", "spam", f"{i}"]), *draw.choice([[], ["k", "k", f"{i % 7}"], ["k", "k"]])]
            bad = int(draw.random() < (0.9 if parts[1] == "spam" or parts[0] == "x|y" else 0.1)) if draw.random() < 0.7 else None
            rows.append((host, "/" + "/".join(parts), bad))
    rows += [("c", "/" + "a/" * 300, 1), ("d", "", 0), ("d", "/", 1), ("d", "/q", 0)]
    found = urls.templates(spark.createDataFrame(rows, "host STRING, path STRING, bad INT"))
    assert {(r["host"], r["path"]): r["template"] for r in found.select("host", "path", "template").collect()} == levels(rows)


def test_names_of_branches_and_segments_do_not_clash(spark):
    rows = [(f"b{i}", f"http://a.com/x|y/{i}", 1) for i in range(40)] + [(f"c{i}", f"http://a.com/{'xy'[i % 2]}/{i}", 0) for i in range(80)]
    got = judged(spark, rows)
    assert all(r["verdict"] == ("block" if k[0] == "b" else "allow") for k, r in got.items())


def test_templates_never_broadcast_their_counts(spark, capsys):
    rows = spark.sql("SELECT concat('h', id % 3) AS host, concat('/', id % 7, '/', id) AS path, CAST(id % 2 AS INT) AS bad FROM range(200)")
    nodes = urls._common(rows.selectExpr("host", "'' AS node", "split(path, '/') AS rest", "1L AS n", "1L AS labelled", "CAST(bad AS BIGINT) AS bad"))
    for made in (nodes, urls._level(nodes), urls.templates(rows)):
        assert made.count()
        made.explain()
        assert "Broadcast" not in capsys.readouterr().out
