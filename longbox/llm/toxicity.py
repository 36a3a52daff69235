"""Toxic issue descriptions by a chain of classifiers.

The categories are predicted one after another, each by a logistic model
over the telling terms of the description and the probabilities of the categories
before it. A word counts as itself and by its first letters, which inflected
words and compounds share. In training, those probabilities are out of fold: no description
gets one from a model that has seen its own label. A last set of models, fitted
on the whole sample, makes up the chain that scores.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from statistics import NormalDist

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Binarizer, CountVectorizerModel, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longbox.llm.storage import stored

# Labelled descriptions that a chain is fitted on, at most: those of least hash.
SAMPLE = 8_000
FOLDS = 3
# Terms known to the models, at most: of those that several descriptions share, the ones a label depends on most.
TERMS, SHARED_BY = 50_000, 5
BEGINNINGS = (4, 5)
# A category's model looks at terms that depend on the label at this level.
LEVEL = 0.0001
PENALTY = 0.001
ITERATIONS = 30
LIMIT = 0.5


def terms(text: Column) -> Column:
    """Words (letters and digits, in lower case), and the beginnings of longer ones.

    Null gives none.
    """
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    starts = [
        F.transform(F.filter(words, lambda w, n=n: F.length(w) > n), lambda w, n=n: F.concat(F.substring(w, 1, n), F.lit("*")))
        for n in BEGINNINGS
    ]
    return F.concat(words, *starts)


@dataclass
class Link:
    """The model of one category; a rate instead where one class was all there was."""

    category: str
    model: PipelineModel | None
    rate: float

    def apply(self, df: DataFrame, column: str) -> DataFrame:
        if self.model is None:
            return df.withColumn(column, F.lit(self.rate))
        scored = self.model.transform(df).withColumn(column, vector_to_array("_probability")[1])
        return scored.drop("_telling", "_all", "_raw", "_probability", "_class")


def _fit(df: DataFrame, category: str, earlier: list[str]) -> Link:
    """Model of ``category`` over column _features, if there, and earlier probabilities."""
    n, positive = df.agg(F.count(category), F.coalesce(F.sum(category), F.lit(0))).first()
    if "_features" not in df.columns or not 0 < positive < n:
        return Link(category, None, positive / n if n else 0.0)
    # Both kinds weigh the same, however rare one is.
    weight = F.when(F.col(category) == 1, n / (2 * positive)).otherwise(n / (2 * (n - positive)))
    choose = UnivariateFeatureSelector(
        featuresCol="_features", labelCol=category, outputCol="_telling", selectionMode="fpr"
    )
    choose = choose.setFeatureType("categorical").setLabelType("categorical").setSelectionThreshold(LEVEL)
    learn = LogisticRegression(
        featuresCol="_all", labelCol=category, probabilityCol="_probability", rawPredictionCol="_raw",
        predictionCol="_class", weightCol="_weight", maxIter=ITERATIONS, regParam=PENALTY,
    )
    put = VectorAssembler(inputCols=["_telling", *earlier], outputCol="_all")
    known = df.filter(F.col(category).isNotNull()).withColumn("_weight", weight)
    chosen = choose.fit(known)
    if not chosen.selectedFeatures:
        return Link(category, None, positive / n)
    model = learn.fit(put.transform(chosen.transform(known)))
    return Link(category, PipelineModel(stages=[chosen, put, model]), positive / n)


@dataclass
class Chain:
    vocabulary: PipelineModel | None
    links: list[Link]

    @property
    def categories(self) -> list[str]:
        return [link.category for link in self.links]

    def score(self, df: DataFrame, text: str = "description") -> DataFrame:
        """All columns of ``df`` with struct ``row``, and a probability per category.

        Gives (row, p_<category>...), so no column name of ``df`` can clash.
        """
        out = df.select(F.struct("*").alias("row"), terms(F.col(text)).alias("_terms"))
        if self.vocabulary is not None:
            out = _featured(out, self.vocabulary)
        for link in self.links:
            out = link.apply(out, f"p_{link.category}")
        return out.select("row", *[f"p_{c}" for c in self.categories])


def fit(issues: DataFrame, labels: DataFrame, categories: list[str]) -> Chain:
    """A chain over ``categories``, in that order.

    ``issues``: id, description; ``labels``: id and one 0/1 column per category
    (null: unknown). Labels of one id count as 1 if any is. At most ``SAMPLE``
    labelled issues are used, those whose ids hash lowest. A category without
    labels of both kinds, or that no term tells, gets the share of its labels as
    constant probability (0 without any). Null descriptions count as empty.
    """
    marks = labels.filter("id IS NOT NULL").groupBy("id").agg(*[F.max(c).cast("double").alias(c) for c in categories])
    chosen = marks.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    # The bound of the broadcast is SAMPLE rows of a few numbers.
    sample = issues.select("id", "description").join(F.broadcast(chosen), "id")
    sample = sample.select("id", terms(F.col("description")).alias("_terms"), *categories)
    sample = stored(sample.withColumn("_fold", F.pmod(F.xxhash64("id"), F.lit(FOLDS))), "labelled")
    vocabulary = _vocabulary(sample, categories)
    if vocabulary is not None:
        sample = _featured(sample, vocabulary)
    sample = stored(sample.drop("_terms"), "labelled")
    links, earlier = [], []
    for category in categories:
        links.append(_fit(sample, category, earlier))
        if category != categories[-1]:
            parts = []
            for fold in range(FOLDS):
                rest, own = sample.filter(F.col("_fold") != fold), sample.filter(F.col("_fold") == fold)
                parts.append(_fit(rest, category, earlier).apply(own, f"p_{category}"))
            sample = stored(reduce(DataFrame.unionByName, parts), "labelled")
            earlier.append(f"p_{category}")
    return Chain(vocabulary, links)


def _featured(df: DataFrame, vocabulary: PipelineModel) -> DataFrame:
    """``df`` with column _features, without a description of each of its thousands of parts."""
    out = vocabulary.transform(df).drop("_counts", "_once", "_often")
    return out.withMetadata("_features", {"ml_attr": {"num_attrs": 2 * len(vocabulary.stages[0].vocabulary)}})


def _dependence(n: dict[str, int], held: Column, held_positive: Column) -> Column:
    """Chi-square statistic of a term and a label; ``n``: rows by label, ``held``: those with the term."""
    every, positive = n["n"], n["positive"]
    gap = held_positive * float(every) - held * float(positive)
    under = held * (every - held) * (float(positive) * (every - positive))
    return F.coalesce(F.try_divide(gap * gap * float(every), under), F.lit(0.0))


def _telling(sample: DataFrame, categories: list[str]) -> DataFrame:
    """(term, dependence) of the shared terms that some model may choose at ``LEVEL``.

    Each model chooses among the terms by its own rows: all that have the label,
    or those outside a fold. A term is given if it passes for any of these row
    sets, by occurring or by occurring again, so the models lose none.
    """
    numbered = sample.withColumn("_row", F.monotonically_increasing_id())
    within = numbered.select("_row", "_fold", *categories, F.explode("_terms").alias("term")).groupBy("_row", "_fold", *categories, "term").count()
    often = F.sum((F.col("count") > 1).cast("double")).alias("_often")
    kinds = within.groupBy("term", "_fold", *categories).agg(F.count("*").cast("double").alias("_once"), often)
    row_sets = {"all": F.lit(True)} | {f"but{f}": F.col("_fold") != f for f in range(FOLDS)}
    totals, sums, tests = [], [], []
    for c in categories:
        for name, own in row_sets.items():
            key, known, positive = f"{c}_{name}", own & F.col(c).isNotNull(), own & (F.col(c) == 1)
            totals += [F.count(F.when(known, 1)).alias(f"{key}_n"), F.count(F.when(positive, 1)).alias(f"{key}_positive")]
            for kind in ("_once", "_often"):
                sums += [F.sum(F.when(rows, F.col(kind)).otherwise(0.0)).alias(f"{key}{kind}{end}") for rows, end in ((known, ""), (positive, "_positive"))]
                tests.append((key, f"{key}{kind}"))
    n = sample.agg(*totals).first()
    counts = kinds.groupBy("term").agg(F.sum("_once").alias("_descriptions"), *sums)
    found = [_dependence({"n": n[f"{key}_n"], "positive": n[f"{key}_positive"]}, F.col(f"`{held}`"), F.col(f"`{held}_positive`")) for key, held in tests]
    # With one degree of freedom, the statistic at LEVEL is a squared normal quantile; the models decide close calls.
    least = 0.999 * NormalDist().inv_cdf(1 - LEVEL / 2) ** 2
    scored = counts.filter(F.col("_descriptions") >= SHARED_BY).select("term", F.array_max(F.array(*found)).alias("dependence"))
    return scored.filter(F.col("dependence") >= least)


def _vocabulary(sample: DataFrame, categories: list[str]) -> PipelineModel | None:
    """Terms to vectors that say what occurs, and what more than once; None if no term tells."""
    chosen = _telling(sample, categories).orderBy(F.desc("dependence"), "term").limit(TERMS)
    known = sorted(r["term"] for r in chosen.select("term").collect())
    if not known:
        return None
    return PipelineModel(stages=[
        CountVectorizerModel.from_vocabulary(known, inputCol="_terms", outputCol="_counts"),
        Binarizer(inputCol="_counts", outputCol="_once", threshold=0.5),
        Binarizer(inputCol="_counts", outputCol="_often", threshold=1.5),
        VectorAssembler(inputCols=["_once", "_often"], outputCol="_features"),
    ])


def toxicity(issues: DataFrame, chain: Chain, target: str) -> DataFrame:
    """(id, p_<category>..., toxic) of each row of ``issues``: id, description.

    ``toxic`` says that ``chain`` gives category ``target`` a probability of 0.5
    or more. One row per issue, whatever repeats or is null; an empty table
    gives no rows. Texts are taken whole; other columns are ignored.
    """
    scored = chain.score(issues.select("id", "description"))
    said = (F.col(f"p_{target}") >= LIMIT).alias("toxic")
    return scored.select("row.id", *[f"p_{c}" for c in chain.categories], said)


def without_toxic(issues: DataFrame, chain: Chain, target: str) -> DataFrame:
    """Rows of ``issues`` (all columns) that are not toxic."""
    return chain.score(issues).filter(F.col(f"p_{target}") < LIMIT).select("row.*")
