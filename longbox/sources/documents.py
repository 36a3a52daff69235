"""Result documents: JSON columns, reading with repair, writing, patching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longbox.functions.text import is_blank
from longbox.functions.times import moment

MATCH = (
    "STRUCT<similarity: DOUBLE, url: STRING, local_url: STRING, meets_threshold: BOOLEAN, comic_name: STRING, "
    "issue_number: STRING, comic_vine_id: STRING, parent_comic_vine_id: STRING, source_image_index: INT, "
    "source_image_name: STRING>"
)
RESULT = (
    "STRUCT<image_name: STRING, image_url: STRING, image_base64: STRING, api_success: BOOLEAN, "
    "match_success: BOOLEAN, best_similarity: DOUBLE, status_code: INT, error: STRING, "
    f"matches: ARRAY<{MATCH}>, total_matches: INT, query_type: STRING, source_image_index: INT>"
)
DOCUMENT = (
    "session_id STRING, timestamp STRING, status STRING, series_name STRING, year INT, total_images INT, "
    "processed INT, successful_matches INT, failed_uploads INT, no_matches INT, overall_success BOOLEAN, "
    "best_similarity DOUBLE, similarity_threshold DOUBLE, total_covers_processed INT, "
    "total_urls_processed INT, query_type STRING, query_image_url STRING, query_image_base64 STRING, "
    f"error STRING, results ARRAY<{RESULT}>"
)


def encode_list(column: Column) -> Column:
    """List column to JSON text; null and empty lists are null."""
    return F.when(F.size(column) > 0, F.to_json(column))


def decode_list(column: Column, schema: str) -> Column:
    """JSON text to a list; null and blank text are empty, bad text fails the job."""
    parsed = F.from_json(F.when(is_blank(column), "[]").otherwise(column), schema, {"mode": "FAILFAST"})
    return parsed


def write_results(df: DataFrame, path: str) -> None:
    """Result rows as JSON, one folder per session.

    Each row is one image with its (at most k) matches, so a session of any
    size is written by many tasks into its folder. Making folders takes the
    time here, so sessions are dealt out by their names, however few parts
    ``df`` has; a large one is cut by its rows, a small one has one file or two.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{name}`") for name in df.columns if name != "session_id"])))
    dealt = df.repartitionByRange(tasks, "session_id", rest)
    dealt.write.mode("overwrite").partitionBy("session_id").json(path)


def read_images(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows that ``write_results`` wrote."""
    return spark.read.schema(schema).json(path)


def _parsed(column: Column) -> Column:
    return F.from_json(column, f"{DOCUMENT}, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"})


def repair_results(df: DataFrame, column: str, as_of: str, threshold: float = 0.55) -> DataFrame:
    """Parsed documents; unreadable ones lose stray NUL and U+FFFD characters
    and are tried again, and become a placeholder row if that fails too.

    Needs ``session_id``. Adds ``outcome``: loaded, repaired or corrupted.
    """
    clean = F.translate(column, "\u0000�", "")
    tried = df.withColumn("_a", _parsed(F.col(column)))
    broken = F.col("_a._corrupt").isNotNull()
    tried = tried.withColumn("_b", F.when(broken, _parsed(clean)))
    lost = broken & F.col("_b._corrupt").isNotNull()
    names = [f.split(" ")[0] for f in _top_level(DOCUMENT)]
    # The placeholder of a document nobody can read.
    placeholder = {
        "timestamp": moment(as_of).cast("string"),
        "status": F.lit("corrupted"),
        "series_name": F.lit("Unknown (Corrupted Data)"),
        "total_images": F.lit(0),
        "processed": F.lit(0),
        "successful_matches": F.lit(0),
        "failed_uploads": F.lit(0),
        "no_matches": F.lit(0),
        "overall_success": F.lit(False),
        "best_similarity": F.lit(0.0),
        "similarity_threshold": F.lit(threshold),
        "error": F.lit("Original file corrupted"),
        "results": F.array().cast(f"ARRAY<{RESULT}>"),
    }

    def field(name: str) -> Column:
        if name == "session_id":
            return F.col("session_id")
        good = F.when(broken, F.col(f"_b.{name}")).otherwise(F.col(f"_a.{name}"))
        return F.when(lost, placeholder.get(name)).otherwise(good).alias(name)

    outcome = F.when(lost, "corrupted").when(broken, "repaired").otherwise("loaded")
    return tried.select(*[field(n) for n in names], outcome.alias("outcome"))


def _top_level(ddl: str) -> list[str]:
    parts, depth, current = [], 0, ""
    for ch in ddl:
        depth += {"<": 1, ">": -1}.get(ch, 0)
        if ch == "," and depth == 0:
            parts.append(current.strip())
            current = ""
        else:
            current += ch
    return [*parts, current.strip()]


def read_results(spark: SparkSession, path: str, as_of: str, threshold: float = 0.55) -> DataFrame:
    """Documents of a folder, one ``<session>.json`` each, with repair."""
    texts = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
    name = F.substring_index(F.input_file_name(), "/", -1)
    named = texts.select(F.regexp_replace(name, r"\.json$", "").alias("session_id"), F.col("value").alias("body"))
    return repair_results(named, "body", as_of, threshold)


def list_results(df: DataFrame) -> DataFrame:
    """Eight fields per document with defaults, newest first."""
    return df.select(
        "session_id",
        "timestamp",
        "series_name",
        "year",
        F.coalesce("total_images", F.lit(0)).alias("total_images"),
        F.coalesce("successful_matches", F.lit(0)).alias("successful_matches"),
        F.coalesce("overall_success", F.lit(False)).alias("overall_success"),
        F.coalesce("status", F.lit("unknown")).alias("status"),
    ).orderBy(F.coalesce("timestamp", F.lit("")).desc(), "session_id")


def stored_name(kind: str, digest: Column, name: Column) -> Column:
    """``{kind}_{sha256}{ext}``; names without extension get .jpg."""
    ext = F.regexp_extract(name, r"[^/.][^/]*?(\.[^./]*)$", 1)
    return F.concat(F.lit(f"{kind}_"), digest, F.when(ext == "", ".jpg").otherwise(ext))


def store_names(df: DataFrame, store: DataFrame, kind: str = "query") -> DataFrame:
    """New content for the store: (session_id, stored_name, content) not held yet.

    ``df``: session_id, image_name, content (binary).
    """
    digest = F.sha2("content", 256)
    named = df.withColumn("stored_name", stored_name(kind, digest, F.col("image_name")))
    keys = ["session_id", "stored_name"]
    return named.join(store.select(*keys), keys, "left_anti").dropDuplicates(keys)


def _payload(column: Column) -> Column:
    """Bytes of base64 text with or without a data-url header."""
    return F.unbase64(F.when(column.startswith("data:image"), F.substring_index(column, ",", -1)).otherwise(column))


def migrate_inline(df: DataFrame, prefix: str = "/stored_images") -> tuple[DataFrame, DataFrame]:
    """(documents with urls in place of inline images, rows for the store).

    Only documents holding inline images come back; the rest needs no change.
    ``df``: session_id, query_image_base64, results (image_name, image_base64,
    image_url, …).
    """
    inline = F.exists("results", lambda r: F.coalesce(r["image_base64"] != "", F.lit(False)))
    has_query = F.coalesce(F.col("query_image_base64") != "", F.lit(False))
    todo = df.filter(has_query | F.coalesce(inline, F.lit(False)))

    def name_of(text: Column, name: Column) -> Column:
        return stored_name("query", F.sha2(_payload(text), 256), name)

    def url_of(text: Column, name: Column) -> Column:
        return F.concat(F.lit(prefix + "/"), F.col("session_id"), F.lit("/"), name_of(text, name))

    def item_name(r: Column) -> Column:
        return F.coalesce(r["image_name"], F.lit("migrated_image.jpg"))

    def moved(r: Column) -> Column:
        held = F.coalesce(r["image_base64"] != "", F.lit(False))
        linked = r.withField("image_url", F.when(held, url_of(r["image_base64"], item_name(r))).otherwise(r["image_url"]))
        return linked.withField("image_base64", F.lit(None).cast("string"))

    query_name = F.lit("query_image.jpg")
    documents = todo.withColumns(
        {
            "query_image_url": F.when(has_query, url_of(F.col("query_image_base64"), query_name)).otherwise(
                F.col("query_image_url") if "query_image_url" in df.columns else F.lit(None)
            ),
            "query_image_base64": F.lit(None).cast("string"),
            "results": F.transform("results", moved),
        }
    )
    items = F.transform(
        F.filter("results", lambda r: F.coalesce(r["image_base64"] != "", F.lit(False))),
        lambda r: F.struct(name_of(r["image_base64"], item_name(r)).alias("stored_name"), _payload(r["image_base64"]).alias("content")),
    )
    text = F.col("query_image_base64")
    own = F.when(
        has_query,
        F.array(F.struct(name_of(text, query_name).alias("stored_name"), _payload(text).alias("content"))),
    ).otherwise(F.array())
    stored = todo.select("session_id", F.inline(F.concat(own, F.coalesce(items, F.array()))))
    return documents, stored.dropDuplicates(["session_id", "stored_name"])


def patch_results(df: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents after the patches, patches that failed with their ``code``).

    ``patches``: session_id, series_name, year. Neither given is a bad
    request; a session without a document is not found.
    """
    named = F.coalesce(F.col("series_name") != "", F.lit(False))
    given = named | F.col("year").isNotNull()
    good = patches.filter(given).groupBy("session_id").agg(
        F.max(F.when(named, F.col("series_name"))).alias("_name"), F.max("year").alias("_year")
    )
    patched = df.join(good, "session_id", "left").withColumns(
        {"series_name": F.coalesce("_name", "series_name"), "year": F.coalesce("_year", "year")}
    ).drop("_name", "_year")
    lost = patches.filter(given).join(df.select("session_id"), "session_id", "left_anti")
    bad = patches.filter(~given).withColumn("code", F.lit(400))
    return patched.select(*df.columns), bad.unionByName(lost.withColumn("code", F.lit(404)))


def backfill(progress: DataFrame, series: DataFrame, results: DataFrame) -> DataFrame:
    """(outcome, count) of filling series name and year into result documents.

    Blank sessions and unknown series are skipped; a session without a
    document fails. The plan's rows come from ``backfill_plan``.
    """
    return backfill_plan(progress, series, results).groupBy("outcome").agg(F.count("*").alias("count"))


def backfill_plan(progress: DataFrame, series: DataFrame, results: DataFrame) -> DataFrame:
    names = series.select(F.col("id").alias("series_id"), F.col("name").alias("series_name"), F.col("start_year").alias("year"))
    held = results.select("session_id").distinct().withColumn("_held", F.lit(True))
    joined = progress.select("id", "session_id", "series_id").join(names, "series_id", "left").join(held, "session_id", "left")
    skipped = is_blank(F.col("session_id")) | F.col("series_name").isNull()
    outcome = F.when(skipped, "skipped").when(F.col("_held").isNotNull(), "updated").otherwise("failed")
    return joined.withColumn("outcome", outcome).drop("_held")


def purge_sessions(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of all sessions but the given ones."""
    return df.join(ids.select("session_id").distinct(), "session_id", "left_anti")


def retain(df: DataFrame, column: str, as_of: str, days: int = 7) -> DataFrame:
    return df.filter(F.col(column) >= moment(as_of) - F.make_dt_interval(F.lit(days)))
