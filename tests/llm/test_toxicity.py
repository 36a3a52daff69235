import random

import pytest
from pyspark.sql import functions as F

from longbox.llm import queries, toxicity
from longbox.suite.registry import Tables

ISSUES, LABELS = "id BIGINT, description STRING, p_toxic STRING", "id BIGINT, insult INT, toxic INT, note STRING"


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(3)
    rows, marks = [], []
    for i in range(300):
        own = [f"w{draw.randrange(200)}" for _ in range(draw.randrange(20, 80))]
        insult, threat = draw.random() < 0.25, draw.random() < 0.25
        own += ["Vile!"] * insult + ["doom,"] * threat
        draw.shuffle(own)
        rows.append((i, " ".join(own), "x"))
        marks.append((i, int(insult), int(insult or threat), "x"))
    return spark.createDataFrame(rows, ISSUES).repartition(2).cache(), spark.createDataFrame(marks, LABELS).repartition(1).cache()


def test_held_out_accuracy(corpus):
    issues, labels = corpus
    chain = toxicity.fit(issues, labels.filter("id < 200"), ["insult", "toxic"])
    got = toxicity.toxicity(issues, chain, "toxic")
    wrong = got.withColumnRenamed("toxic", "said").join(labels, "id").filter("id >= 200").filter("said <> (toxic = 1)")
    assert wrong.count() <= 2 and got.count() == 300
    assert got.columns == ["id", "p_insult", "p_toxic", "toxic"]


def test_toxic_rows_go_and_all_columns_stay(spark, corpus):
    issues, labels = corpus
    odd = spark.createDataFrame([(None, None, None), (7, "", "y"), (7, "vile " * 20000, "z")], ISSUES)
    chain = toxicity.fit(issues, labels, ["insult", "toxic"])
    left = toxicity.without_toxic(issues.filter("id >= 200").unionByName(odd), chain, "toxic")
    assert left.columns == issues.columns
    rows = left.collect()
    assert {r["p_toxic"] for r in rows} == {"x", "y", None}
    assert not any("Vile" in (r["description"] or "") for r in rows)


def test_labels_of_one_kind_none_or_null(spark, corpus):
    issues, labels = corpus
    few = issues.filter("id < 30")
    for marks, wanted in ((labels.limit(0), 0.0), (labels.withColumn("toxic", F.lit(None).cast("int")), 0.0), (labels.withColumn("toxic", F.lit(1)), 1.0)):
        got = toxicity.toxicity(few, toxicity.fit(few, marks, ["toxic"]), "toxic")
        assert [r["p_toxic"] for r in got.select("p_toxic").distinct().collect()] == [wanted]
    none = issues.limit(0)
    assert toxicity.toxicity(none, toxicity.fit(none, labels, ["insult", "toxic"]), "toxic").count() == 0


def test_labels_of_the_given_tables(spark):
    t = Tables(spark, "/root/testdata/sf0.01")
    issues = t.documents.selectExpr("doc_id AS id", "text AS description")
    labels = queries.labels(t.labels)
    train = labels.filter(F.pmod(F.xxhash64("id"), F.lit(4)) > 0)
    chain = toxicity.fit(issues, train, queries.CATEGORIES)
    got = toxicity.toxicity(issues, chain, "toxic").withColumnRenamed("toxic", "said")
    test = got.join(labels.join(train, "id", "left_anti"), "id")
    right, n = test.agg(F.sum((F.col("said") == (F.col("toxic") == 1)).cast("int")), F.count("*")).first()
    assert right >= 0.9 * n


def test_rare_telling_words_among_many_common_ones(spark):
    """More common terms than a vocabulary by frequency held (20 000); the telling ones are rarer than all of them."""
    draw = random.Random(5)
    signs = "0123456789abcdefghijklmnopqrstuvwxyz"
    common = [a + b + c for a in signs for b in signs for c in signs][:21_000]
    told = ["vile", "scum", "doom", "gore", "kill"]
    texts = [[] for _ in range(280)]
    for word in common:
        for i in draw.sample(range(280), 12):
            texts[i].append(word)
    marks = [i % 6 == 0 for i in range(280)]
    for k, i in enumerate(i for i in range(280) if marks[i]):
        texts[i].append(told[k % 5])
    issues = spark.createDataFrame([(i, " ".join(w), "x") for i, w in enumerate(texts)], ISSUES).repartition(4)
    labels = spark.createDataFrame([(i, 0, int(m), "x") for i, m in enumerate(marks)], LABELS)
    chain = toxicity.fit(issues, labels.filter("id < 240"), ["toxic"])
    assert set(told) <= set(chain.vocabulary.stages[0].vocabulary)
    got = toxicity.toxicity(issues.filter("id >= 240"), chain, "toxic").collect()
    assert [r["toxic"] for r in got if marks[r["id"]]] == [True] * sum(marks[240:])


def test_the_models_choose_as_among_all_terms(spark, corpus):
    """What is chosen before the fit loses no term that a model of any row set chooses."""
    from pyspark.ml.feature import CountVectorizer

    issues, labels = corpus
    sample = issues.join(labels.select("id", "insult", "toxic"), "id").select("id", toxicity.terms(F.col("description")).alias("_terms"), "insult", "toxic")
    sample = sample.withColumn("_fold", F.pmod(F.xxhash64("id"), F.lit(toxicity.FOLDS))).localCheckpoint()
    chosen = {r["term"] for r in toxicity._telling(sample, ["insult", "toxic"]).collect()}
    every = CountVectorizer(inputCol="_terms", outputCol="_counts", minDF=toxicity.SHARED_BY).fit(sample)
    rows = [(r["_terms"], r["_fold"], r["insult"], r["toxic"]) for r in sample.collect()]
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.stat import ChiSquareTest

    for category in (2, 3):
        for fold in (None, 0, 1, 2):
            own = [r for r in rows if fold is None or r[1] != fold]
            for least in (1, 2):
                data = [(float(r[category]), Vectors.dense([float(r[0].count(w) >= least) for w in every.vocabulary])) for r in own]
                p = ChiSquareTest.test(spark.createDataFrame(data, ["label", "features"]), "features", "label").first().pValues
                assert {w for w, x in zip(every.vocabulary, p) if x < toxicity.LEVEL} <= chosen
