"""Registered queries of the numbered operators.

Each maps the given tables to an operator's interface and its results back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from longbox.llm import (
    alignment,
    bpe,
    chat,
    decontaminate,
    extraction,
    infill,
    neardup,
    neighbours,
    pairtree,
    tokenfiles,
    toxicity,
    urls,
    warc,
)
from longbox.suite.registry import Suite, Tables

suite = Suite()
q = suite.add

# Rows per Arrow batch: bounds what a Python worker holds of long texts.
BATCH_ROWS = "256"


def batched(t: Tables) -> Tables:
    t.spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return t


def _descriptions(t: Tables):
    return batched(t).documents.select(F.col("doc_id").alias("id"), F.col("text").alias("description"))


@q("op1_byte_level_bpe")
def _(t):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode_descriptions(_descriptions(t), path, public_tokenizers.PATTERN)
    decoded = bpe.decode_descriptions(encoded, path, public_tokenizers.PATTERN)
    return decoded.select(
        F.col("id").alias("doc_id"),
        F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("tokens").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


CATEGORIES = ["low_quality", "toxic"]


def labels(df):
    """The ``labels`` table as the chain's categories, the first being poor quality."""
    return df.select(F.col("doc_id").alias("id"), (1 - F.col("quality")).alias("low_quality"), "toxic")


@q("op2_toxicity")
def _(t):
    issues = _descriptions(t)
    chain = toxicity.fit(issues, labels(t.labels), CATEGORIES)
    return toxicity.toxicity(issues, chain, "toxic").withColumnRenamed("id", "doc_id")


@q("op3_html_extraction")
def _(t):
    pages = batched(t).pages.select("page_id", "url", "html")
    found = extraction.extract(pages, extraction.learn(pages))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@q("op4_chat_formatting", rf"""
    WITH rows AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    marked AS (
      SELECT *, len(regexp_extract_all(text, '{chat.CONTROL}')) AS marks,
        CASE role WHEN 'user' THEN 6 WHEN 'assistant' THEN 7 ELSE 9 + length(role) END + length(text) + 4 AS plain
      FROM rows),
    said AS (
      SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
        sum(plain + CASE WHEN regexp_matches(text, '(?s)\\.') THEN marks + length(text) - length(replace(text, chr(92), ''))
          ELSE marks END) AS chars
      FROM marked GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
      CAST(chars AS BIGINT) AS formatted_chars FROM said""")
def _(t):
    odd = t.spark.range(1).selectExpr(
        "-1L AS conv_id", "inline(array(struct(0L AS turn, 'user' AS role), struct(1L AS turn, 'assistant' AS role)))", "'</s>[INST] ok [/INST]' AS text")
    rows = t.conversations.select("conv_id", "turn", "role", "text").unionByName(odd)
    formatted = chat.format_conversations(rows)
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    parts = chat.read_turns(formatted).select(
        "conv_id", "part", F.size("turns").alias("n"), said.alias("said"), "masked", F.length("formatted").alias("chars"))
    joined = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    whole = parts.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("part", "said", "masked"))).alias("parts"))
    return whole.select(
        "conv_id", "n_turns", F.sha2(joined("said"), 256).alias("turns_sha256"), F.length(joined("masked")).cast("long").alias("loss_chars"),
        F.sha2(joined("masked"), 256).alias("loss_sha256"), "formatted_chars")


@q("op5_minhash_near_duplicates")
def _(t):
    return neardup.near_duplicates(_descriptions(t)).withColumnRenamed("id", "doc_id")


@q("op6_token_files")
def _(t):
    path = public_tokenizers.path("byte_bpe_50k.json")
    files = tokenfiles.write_token_files(_descriptions(t), path, public_tokenizers.PATTERN, end_id=2)
    return tokenfiles.read_token_files(files).select(
        F.col("id").alias("doc_id"),
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


@q("op7_warc", """
    WITH said AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
    kept AS (SELECT payload, max(page_id) AS stored FROM said WHERE octet_length(payload) >= 1000 GROUP BY payload HAVING count(*) > 1)
    SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest,
      CASE WHEN stored IS NULL OR stored = page_id THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN stored <> page_id THEN stored END AS refers_to
    FROM said LEFT JOIN kept USING (payload)""")
def _(t):
    archives = warc.write_archives(batched(t).pages.select("page_id", "url", "html"), "2024-01-01T00:00:00Z")
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


RULES = [("net/", urls.BLOCK), ("example.net/en/", urls.ALLOW), ("example.com/de/", urls.BLOCK), ("org/fr/", urls.ALLOW)]


@q("op8_url_filters")
def _(t):
    # A page is labelled by the row of labels with its number.
    labelled = t.labels.groupBy("doc_id").agg(F.max(F.greatest(1 - F.col("quality"), F.col("toxic"))).alias("bad"))
    pages = t.pages.select("page_id", "url").join(labelled, F.col("page_id") == F.col("doc_id"), "left")
    judged = urls.judge(pages.select(F.col("page_id").alias("url_hash"), "url", "bad"), RULES)
    return judged.withColumnRenamed("url_hash", "page_id")


@q("op9_approximate_neighbours")
def _(t):
    rows = t.embeddings.select(F.col("vec_id").alias("kp_id"), F.col("embedding").alias("descriptor"))
    found = neighbours.nearest(rows, rows.filter("kp_id % 20 = 0"), 20)
    return found.withColumnRenamed("kp_id", "vec_id")


@q("op10_benchmark_decontamination")
def _(t):
    found = decontaminate.contamination(_descriptions(t), t.benchmark)
    items = F.array_sort(F.array_distinct(F.col("matches.item_id")).cast("array<string>"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@q("op11_tokenizer_alignment")
def _(t):
    first, second = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    found = alignment.align_and_score(_descriptions(t), first, public_tokenizers.PATTERN, second)
    groups = alignment.groups_text(F.col("a"), F.col("b"), F.col("a_sizes"), F.col("b_sizes"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("a").cast("long").alias("n_a"),
        F.size("b").cast("long").alias("n_b"),
        F.size("a_sizes").cast("long").alias("n_groups"),
        "n_links",
        "n_best",
        "count_sum",
        F.when(F.size("a_sizes") > 0, F.sha2(groups, 256)).otherwise("").alias("groups_sha256"),
    )


@q("op12_fill_in_middle", """
    WITH said AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    drawn AS (
      SELECT doc_id, text, length(text) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
        CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM said),
    cut AS (
      SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN n = 0 OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain'
          WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
    parts AS (
      SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM cut)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
      sha256(text) AS restored_sha256 FROM parts""")
def _(t):
    made = infill.transform_descriptions(_descriptions(t), infill.Choice(seed=1, plain_from=90, spm_below=20))
    return made.select(
        F.col("id").alias("doc_id"),
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


@q("op13_bpe_segment_tree")
def _(t):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = pairtree.encode_descriptions(_descriptions(t), path, public_tokenizers.PATTERN)
    decoded = pairtree.decode_descriptions(encoded, path, public_tokenizers.PATTERN)
    return decoded.select(
        F.col("id").alias("doc_id"),
        F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2(pairtree.packed(F.col("tokens")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
