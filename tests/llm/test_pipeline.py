"""The pipeline stage by stage against brute force, and its edge rows."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import test_decontaminate
import test_neardup

INSULTS = ["trash", "idiot", "moron"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with toxic, copied and leaked documents, and odd rows and columns."""
    draw = random.Random(5)
    text = lambda n: " ".join(f"w{draw.randrange(900)}" for _ in range(n))
    docs, labels = [], []
    items = [(i, text(25)) for i in range(5)]
    for i in range(240):
        own, toxic = text(60), i % 6 == 0
        if toxic:
            own = f"{draw.choice(INSULTS)}, {own} {draw.choice(INSULTS)} {draw.choice(INSULTS)}"
        if i % 40 == 7:
            own += " " + items[i % 5][1]
        docs.append((i, own, "en", None, len(own)))
        if i < 160:
            labels.append((i, 1, int(toxic)))
    docs += [(300 + i, docs[i][1] + " end", "en", "s", 1) for i in range(1, 60, 7)]
    docs += [(400, None, None, None, None), (401, "", "en", "s", 0), (None, "no id here", "en", "s", 1), (402, "no id here", "en", "s", 1), (402, "no id here", "en", "s", 1)]
    out = tmp_path_factory.mktemp("tables")
    wide = spark.createDataFrame(docs, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    wide.withColumns({"id": F.lit("x"), "row": F.lit(1), "p_toxic": F.lit(2.0)}).coalesce(2).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id BIGINT, text STRING").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def ids(rows):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in rows)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.storage.stored(stage(spark, docs, folder), name)
        kept[name] = docs.collect()
        if name != "byte_level_bpe":
            assert docs.columns == before.columns
    start = spark.read.parquet(f"{folder}/documents.parquet").collect()
    clean = [r for r in start if not any(w in (r["text"] or "") for w in INSULTS)]
    assert ids(kept["toxicity"]) == ids(clean)
    # A row without an id links to nothing; of an id's equal rows each stays.
    groups = {i: k for i, _, _, k in test_neardup.brute([(r["doc_id"], r["text"]) for r in clean])}
    assert ids(kept["minhash_near_duplicates"]) == ids(r for r in clean if r["doc_id"] is None or groups[r["doc_id"]])
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    left = [r for r in kept["minhash_near_duplicates"] if not test_decontaminate.brute(r["text"], items)[1]]
    assert ids(kept["benchmark_decontamination"]) == ids(left) and len(left) < len(kept["minhash_near_duplicates"])
    assert ids(kept["byte_level_bpe"]) == ids(left)


def test_registered():
    assert entry_module.queries()["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None
    names = [n for n in entry_module.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in sorted(names, key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 14))
