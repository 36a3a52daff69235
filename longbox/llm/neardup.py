"""Near-duplicate issue descriptions by circulant MinHash.

The set of a description are its distinct shingles of five words. Two
permutations of one universe give the whole signature: the first places the
shingles, the second, shifted by one more place for each coordinate, ranks
them, and a coordinate is the least rank. A shingle's ranks in all coordinates
are therefore neighbours in memory: a signature is one gather and one minimum.

Bands of coordinates make buckets. Descriptions with equal sets are one class
from the start, and a bucket is never paired out. Each class is compared with
the most central class it meets, then with the leaders of its buckets; links are
confirmed on the full sets, and classes that these tie get one label. What is
left in buckets of several labels is searched by the rarest shingles of each
set: two sets that are similar enough share one of them, so this last step
loses nothing, whatever the size of a bucket. Components are made once, of all
links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longbox.llm.components import components
from longbox.llm.storage import stored
from longbox.plans.scale import top_per_group

WORDS = 5
PERCENT = 75
# A pair at the threshold shares none of 32 bands of 4 coordinates once in 190 000.
BANDS, ROWS = 32, 4
UNIVERSE = 1 << 20
SEED = 20
# Places handled at a time, which bounds the memory of a very long text.
PLACES = 8192
# Links that a label crosses within a round.
HOPS = 2
# Sets that share a shingle are met in parts of about so many.
SHARING = 1000

_ODD = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _ODD
    return x ^ (x >> _SHIFT)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text (string array).

    Words are runs without ASCII white space, A-Z in lower case. Fewer than five
    words are one shingle; no words, or null, give an empty set.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = split.flatten()
    owner = pc.list_parent_indices(split).to_numpy()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    names = np.array(coded.dictionary.to_pylist(), dtype=object)
    hashes = pd.util.hash_array(names, categorize=False) if len(names) else np.empty(0, np.uint64)
    words = hashes[coded.indices.to_numpy()[full]]
    stops = np.searchsorted(owner[full], np.arange(len(texts) + 1))
    sets = []
    for start, stop in zip(stops[:-1], stops[1:]):
        own = words[start:stop]
        width = min(WORDS, len(own))
        if not width:
            sets.append(np.empty(0, np.uint64))
            continue
        last = len(own) - width + 1
        shingles = np.full(last, width, np.uint64)
        for i in range(width):
            shingles = _mix(shingles) + own[i : i + last]
        sets.append(np.unique(_mix(shingles)))
    return sets


class Circulant:
    """The two permutations and the signatures they give."""

    def __init__(self):
        draw = np.random.default_rng(SEED)
        self.place = draw.permutation(UNIVERSE).astype(np.int32)
        rank = draw.permutation(UNIVERSE).astype(np.int32)
        length = BANDS * ROWS
        self.ranks = sliding_window_view(np.concatenate([rank, rank[: length - 1]]), length)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(self.ranks.shape[1], UNIVERSE, np.int32)
        places = self.place[(shingles % np.uint64(UNIVERSE)).astype(np.int64)]
        for start in range(0, len(places), PLACES):
            np.minimum(least, self.ranks[places[start : start + PLACES]].min(axis=0), out=least)
        return least

    def bands(self, signature: np.ndarray) -> np.ndarray:
        """One 64-bit bucket number a band."""
        rows = signature.reshape(BANDS, ROWS).astype(np.uint64)
        bucket = np.arange(1, BANDS + 1, dtype=np.uint64)
        for i in range(ROWS):
            bucket = _mix(bucket) + rows[:, i]
        return _mix(bucket).view(np.int64)


SIGNED = "id BIGINT, n_shingles BIGINT, d1 BIGINT, d2 BIGINT, bands ARRAY<BIGINT>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    circulant = Circulant()
    for batch in batches:
        sets = shingle_sets(batch.column("description"))
        digests = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]
        bands = [circulant.bands(circulant.signature(s)) if len(s) else [] for s in sets]
        yield pa.RecordBatch.from_pydict(
            {
                "id": batch.column("id"),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "d1": pa.array([d[0] for d in digests], pa.int64()),
                "d2": pa.array([d[1] for d in digests], pa.int64()),
                "bands": pa.array(bands, pa.list_(pa.int64())),
            }
        )


def _shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s.view(np.int64) for s in shingle_sets(batch.column("description"))]
        yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "shingles": pa.array(sets, pa.list_(pa.int64()))})


def _by_key(df: DataFrame) -> DataFrame:
    """``df`` as a side of a sorted join: the driver builds no table of it."""
    return df.hint("merge")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, v, lu, lv) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("v"), F.col("shingles").alias("_b"))
    right = sets.select(F.col("id").alias("u"), F.col("shingles").alias("_a"))
    both = F.size(F.array_intersect("_a", "_b"))
    alike = 100 * both >= PERCENT * (F.size("_a") + F.size("_b") - both)
    found = pairs.join(_by_key(left), "v").join(_by_key(right), "u").filter(alike)
    return found.select("u", "v", "lu", "lv").distinct()


def _merged(links: DataFrame) -> DataFrame:
    """(label, lower): the least label within ``HOPS`` links of each label of ``links``.

    Leaders are hubs, so this is mostly the least label of all that are linked; what
    lies further apart is compared once more, and no link depends on it.
    """
    edges = links.select(F.col("lu").alias("a"), F.col("lv").alias("b")).distinct()
    edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = edges.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    for _ in range(HOPS - 1):
        reached = edges.join(_by_key(near.withColumnRenamed("a", "b")), "b").groupBy("a").agg(F.min("m").alias("far"))
        near = near.join(_by_key(reached), "a").select("a", F.least("m", "far").alias("m"))
    return near.withColumnsRenamed({"a": "label", "m": "lower"})


def _open(members: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one label."""
    mixed = members.groupBy("bucket").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).filter("_a < _b")
    return members.join(_by_key(mixed.select("bucket")), "bucket", "left_semi")


def _central(members: DataFrame) -> DataFrame:
    """``members`` with ``weight``: how many others the class meets over its buckets.

    The class in the middle of a group of copies shares most buckets with most of them.
    """
    sizes = members.groupBy("bucket").agg(F.count("*").alias("_size"))
    weights = members.join(_by_key(sizes), "bucket").groupBy("rep").agg(F.sum("_size").alias("weight"))
    return members.join(_by_key(weights), "rep")


def _pairs(met: DataFrame) -> DataFrame:
    """Distinct pairs (u, v, lu, lv) of a class with ``_rep``, of unlike labels and like sizes."""
    hopeful = (F.col("label") != F.col("_label")) & (100 * F.least("n", "_n") >= PERCENT * F.greatest("n", "_n"))
    return met.filter(hopeful).select(
        F.least("_rep", "rep").alias("u"), F.greatest("_rep", "rep").alias("v"),
        F.least("_label", "label").alias("lu"), F.greatest("_label", "label").alias("lv"),
    ).distinct()


def _led(members: DataFrame) -> DataFrame:
    """``members`` beside the leader of each bucket, the most central class in it."""
    leaders = top_per_group(members, ["bucket"], [F.desc("weight"), F.col("rep")], 1)
    return members.join(_by_key(leaders.select("bucket", *[F.col(c).alias(f"_{c}") for c in ("rep", "n", "label", "weight")])), "bucket")


def _rare(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, v, lu, lv) of all ``members`` that may be similar, by their rarest shingles.

    Shingles have one order: those of a single label, which tie nothing, then
    others from rare to common. At the first shingle that two sets share in it,
    at place p of a and q of b shingles, they share ``1 + min(a - p, b - q)`` at
    most, and three sevenths of ``a + b`` at least if they are similar enough.
    That place lies in the first quarter of each set and in the first seventh of
    the smaller one, so only these are joined. A common shingle is met in parts.
    """
    labels = members.select("rep", "label").distinct()
    # An id with several texts has several sets.
    said = sets.select(
        F.col("id").alias("rep"), F.xxhash64("shingles").alias("text"), F.size("shingles").cast("bigint").alias("n"), "shingles"
    ).join(_by_key(labels), "rep").dropDuplicates(["rep", "text"])
    said = stored(said.select("rep", "text", "n", "label", F.explode("shingles").alias("shingle")), "shingles")
    uses = said.groupBy("shingle").agg(F.count("*").alias("uses"), F.min("label").alias("_a"), F.max("label").alias("_b"))
    shared = said.join(_by_key(uses.filter("_a < _b").select("shingle", "uses")), "shingle")
    own = Window.partitionBy("rep", "text")
    places = shared.select(
        "*", (F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("uses", "shingle"))).alias("place")
    )
    first = places.filter(100 * (F.col("n") + 1 - F.col("place")) >= PERCENT * F.col("n")).withColumn(
        "parts", 1 + F.floor(F.col("uses") / SHARING)
    )
    first = stored(first, "rarest")
    larger = first.withColumn("part", F.pmod(F.xxhash64("rep"), "parts"))
    smaller = first.filter((100 + PERCENT) * (F.col("n") + 1 - F.col("place")) >= 2 * PERCENT * F.col("n"))
    smaller = smaller.select(
        "shingle", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"),
        *[F.col(c).alias(f"_{c}") for c in ("rep", "n", "label", "place")],
    )
    room = 1 + F.least(F.col("n") - F.col("place"), F.col("_n") - F.col("_place"))
    ordered = (F.col("_n") < F.col("n")) | ((F.col("_n") == F.col("n")) & (F.col("_rep") < F.col("rep")))
    enough = (100 + PERCENT) * room >= PERCENT * (F.col("n") + F.col("_n"))
    keys = (larger["shingle"] == smaller["shingle"]) & (larger["part"] == smaller["part"])
    alike = keys & ordered & enough & (F.col("label") != F.col("_label"))
    return _pairs(larger.join(_by_key(smaller), alike).select("rep", "n", "label", "_rep", "_n", "_label"))


def _links(members: DataFrame, sets: DataFrame) -> list[DataFrame]:
    """Confirmed links (u, v) that tie all similar ``members`` of open buckets.

    ``members``: bucket, rep, n, weight, label. Central members link most of a
    group at once, and who is linked need not be compared again. First each class
    meets one other, then the leader of each bucket that still holds several
    labels; the rarest shingles find the links between all that remain.
    """
    central = [F.desc("_weight"), F.col("_rep")]
    best = _pairs(top_per_group(_led(members).filter("_rep <> rep"), ["rep"], central, 1))
    confirmed = []
    for pairs_of in (lambda m: best, lambda m: _pairs(_led(m))):
        links = stored(_confirmed(pairs_of(members), sets), "links")
        confirmed.append(links.select("u", "v"))
        lower = members.join(_by_key(_merged(links)), "label", "left").withColumn("label", F.coalesce("lower", "label"))
        members = stored(_open(lower.drop("lower")), "members")
    confirmed.append(stored(_confirmed(_rare(members, sets), sets), "links").select("u", "v"))
    return confirmed


def near_duplicates(issues: DataFrame) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of ``issues``: id, description.

    Two descriptions are linked if ``100 * intersection >= 75 * union`` of their
    shingle sets. ``component_id`` is the least id reachable over links, the own
    id included; ``kept`` marks the rows that carry it. A description without
    words, empty or null, has no shingles and no links. Rows that share an id
    are one issue, linked by any of their texts. Rows without an id take no
    part: component null, not kept. An empty table gives no rows. Texts are
    taken whole; other columns, whatever their names, are ignored.
    """
    texts = issues.select(F.col("id").cast("bigint").alias("id"), "description")
    signed = stored(texts.mapInArrow(_sign, SIGNED), "signed")
    sets = signed.filter("n_shingles > 0 AND id IS NOT NULL")
    classes = sets.groupBy("d1", "d2").agg(F.min("id").alias("rep"))
    first = sets.join(_by_key(classes.withColumnRenamed("rep", "id")), ["d1", "d2", "id"], "left_semi")
    buckets = first.select(F.explode("bands").alias("bucket"), F.col("id").alias("rep"), F.col("n_shingles").alias("n"))
    members = stored(_open(buckets.withColumn("label", F.col("rep"))), "members")
    members = stored(_central(members), "members")
    met = members.select(F.col("rep").alias("id")).distinct()
    full = stored(texts.join(_by_key(met), "id", "left_semi").mapInArrow(_shingle, "id BIGINT, shingles ARRAY<BIGINT>"), "sets")
    links = _links(members, full)
    # An id with several texts belongs to several classes and so ties them.
    several = sets.groupBy("id").agg(
        (F.min("d1") < F.max("d1")).alias("_d1"), (F.min("d2") < F.max("d2")).alias("_d2")
    ).filter("_d1 OR _d2")
    ties = sets.join(several, "id", "left_semi").join(classes, ["d1", "d2"]).select(F.col("id").alias("u"), F.col("rep").alias("v"))
    labels = components(reduce(DataFrame.unionByName, links, ties)).withColumnRenamed("u", "rep")
    named = classes.join(labels, "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("_least"))
    whole = signed.drop("bands").withColumn("_in", F.col("n_shingles") > 0).join(named, ["d1", "d2"], "left")
    component = F.when(F.col("_in") & F.col("id").isNotNull(), F.col("_least")).otherwise(F.col("id"))
    return whole.select(
        "id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")
    )


def without_near_duplicates(issues: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, with all columns of ``issues``.

    Rows whose description has no words, or that have no id, stay. Of rows that
    share an id and are kept, each stays.
    """
    dropped = near_duplicates(issues).filter("NOT kept AND id IS NOT NULL").select("id").distinct()
    return issues.join(dropped, "id", "left_anti")
