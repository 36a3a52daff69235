"""Queries over the column functions (inventory section 2.7)."""

from pyspark.sql import functions as F

from longbox.functions import numbers, progress, text, times
from longbox.suite.registry import Suite

suite = Suite()
q = suite.add


def sub(expr, *pairs):
    """Nested global regexp_replace calls as SQL text."""
    for pattern, put in pairs:
        expr = f"regexp_replace({expr}, '{pattern}', '{put}', 'g')"
    return expr


def swap(expr, *pairs):
    for found, put in pairs:
        expr = f"replace({expr}, '{found}', '{put}')"
    return expr


BREAK = "\\1\n\n\\2"
PLAIN = sub("coalesce({0}, '''')".replace("''''", "''"), ("<[^>]*>", ""))
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&mdash;", "—"), ("&ndash;", "–")]
READABLE = sub(
    "trim(" + sub(swap(PLAIN, *ENTITIES), ("\\s+", " ")) + ")",
    ("([.!?])\\s*([A-Z])", BREAK), ("([.!?])\\s*([A-Z][^:]*:)", BREAK), ('([.!?])\\s*("[^"]*")', BREAK),
    ('("[^"]*")\\s*([A-Z])', BREAK), ("\\n{{3,}}", "\n\n"))
CLEAN = "trim(" + sub(swap(PLAIN, ENTITIES[0], ENTITIES[3], ENTITIES[4], ENTITIES[5]), ("\\s+", " ")) + ")"
EDGES = ("^[\\x00-\\x20]+|[\\x00-\\x20]+$", "")
BASIC = sub("{0}", ("([.!?])\\s*([A-Z][a-z]+[,:])", BREAK), ('([.!?])\\s*(")', BREAK), ("\\n{{3,}}", "\n\n"), EDGES)


def digest(sql):
    return f"md5({sql}) AS digest, length({sql}) AS size"


def digested(df, column):
    return df.select("kind", "id", F.md5(column).alias("digest"), F.length(column).cast("bigint").alias("size"))


def texts(t):
    """Every document and every page, whole."""
    docs = t.documents.select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("body"))
    return docs.unionByName(t.pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("body")))


TEXTS = "(SELECT 'doc' AS kind, doc_id AS id, text AS body FROM documents UNION ALL SELECT 'page', page_id, html FROM pages)"


@q("h01_make_readable", f"SELECT kind, id, {digest(READABLE.format('body'))} FROM {TEXTS}")
def _(t):
    return digested(texts(t), text.make_readable(F.col("body")))


@q("h02_basic_paragraphs", f"SELECT kind, id, {digest(BASIC.format('body'))} FROM {TEXTS}")
def _(t):
    return digested(texts(t), text.basic_paragraphs(F.col("body")))


@q("h03_clean_only", f"SELECT kind, id, {digest(CLEAN.format('body'))} FROM {TEXTS}")
def _(t):
    return digested(texts(t), text.clean_only(F.col("body")))


NAME = sub(
    "lower(replace(" + sub(f"strip_accents({sub('body', EDGES)})", ("[^a-zA-Z0-9\\s_-]", ""), ("\\s+", " ")) + ", ' ', '_'))",
    ("^[_-]+|[_-]+$", ""))
SLUG = sub(f"strip_accents(lower({sub('body', EDGES)}))", ("[\\s_]+", "-"), ("[^a-z0-9-]", ""), ("-+", "-"), ("^-+|-+$", ""))


def cut(sql, edge):
    return f"""CASE WHEN {sql} = '' THEN 'unknown' WHEN length({sql}) > 100 THEN regexp_replace(substr({sql}, 1, 100), '{edge}+$', '') ELSE {sql} END"""


@q("h04_normalize_name", f"SELECT kind, id, {cut(NAME, '_')} AS name FROM {TEXTS}")
def _(t):
    return texts(t).select("kind", "id", text.normalize_name(F.col("body")).alias("name"))


@q("h05_slug", f"SELECT kind, id, {cut(SLUG, '-')} AS slug FROM {TEXTS}")
def _(t):
    return texts(t).select("kind", "id", text.slug(F.col("body")).alias("slug"))


@q("h06_first_int", """SELECT doc_id, coalesce(TRY_CAST(nullif(regexp_extract(text, '[0-9]+'), '') AS BIGINT), 0) AS number FROM documents""")
def _(t):
    return t.documents.select("doc_id", numbers.first_int(F.col("text")).alias("number"))


@q("h07_sanitize_key", f"""SELECT doc_id, md5({sub('lower(text)', ('[^a-z0-9_-]', '_'), ('_{2,}', '_'), ('^_|_$', ''))}) AS key FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.md5(text.sanitize_key(F.col("text"))).alias("key"))


@q("h08_image_path", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source || '/' || doc_id WHEN 1 THEN lang || '/' || doc_id ELSE 'plain/' || doc_id END AS path FROM documents""")
def _(t):
    url = F.expr(
        "CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN concat('http://h/stored_images/', source, '/', doc_id) "
        "WHEN 1 THEN concat('http://h/api/image/', lang, '/', doc_id) ELSE concat('plain/', doc_id) END")
    return t.documents.select("doc_id", text.image_path(url).alias("path"))


@q("h09_normalize_barcode", """
    WITH c AS (SELECT o_orderkey, regexp_replace(CASE WHEN o_orderkey % 2 = 0 THEN '0' ELSE '5' END || lpad(CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey % 3 = 0 THEN 12 ELSE 9 END, '1'), '[^0-9]', '', 'g') AS d FROM orders)
    SELECT o_orderkey, CASE WHEN length(d) = 13 AND d[1] = '0' THEN d[2:] ELSE d END AS barcode FROM c""")
def _(t):
    code = F.expr("concat(CASE WHEN o_orderkey % 2 = 0 THEN '0-' ELSE 'x5 ' END, lpad(CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN 12 ELSE 9 END, '1'))")
    return t.orders.select("o_orderkey", text.normalize_barcode(code).alias("barcode"))


@q("h10_issue_number_match", """
    SELECT l_orderkey, l_partkey, l_linenumber, starts_with(lower(l_linenumber || 'a'), CAST(l_suppkey % 9 AS VARCHAR)) OR starts_with(CAST(l_suppkey % 9 AS VARCHAR), lower(l_linenumber || 'a')) AS hit FROM lineitem""")
def _(t):
    hit = text.issue_number_match(F.expr("concat('#', l_linenumber, '-A')"), F.expr("concat(' ', l_suppkey % 9, '.')"))
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", hit.alias("hit"))


@q("h11_absolute_url", """
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'https://cdn/' || doc_id WHEN 1 THEN 'https://site.example/' || doc_id WHEN 2 THEN 'https://site.example/rel/' || doc_id ELSE 'http://x/' || doc_id END AS url FROM documents""")
def _(t):
    url = F.expr("CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN concat('//cdn/', doc_id) WHEN 1 THEN concat('/', doc_id) WHEN 2 THEN concat('rel/', doc_id) ELSE concat('http://x/', doc_id) END")
    return t.documents.select("doc_id", text.absolute_url(url, "https://site.example").alias("url"))


@q("h12_id_from_url", "SELECT doc_id, doc_id AS id FROM documents")
def _(t):
    url = F.expr("concat('https://site.example/api/issue/', doc_id, '/?format=json', CASE WHEN doc_id % 2 = 0 THEN '/' ELSE '' END)")
    return t.documents.select("doc_id", text.id_from_url(url).alias("id"))


SIZED = "(SELECT doc_id, n_chars * (doc_id % 7) * (doc_id % 11) * (doc_id % 1000) AS b FROM documents)"
ONE = "printf('%.1f', floor(b / {0}.0::DOUBLE * 10 + 0.5) / 10)"
TWO = "regexp_replace(regexp_replace(printf('%.2f', floor(b / {0}.0::DOUBLE * 100 + 0.5) / 100), '0+$', ''), '\\.$', '')"


@q("h13_format_size", f"""
    SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN {ONE.format(1024)} || ' KB' WHEN b < 1073741824 THEN {ONE.format(1048576)} || ' MB' ELSE {ONE.format(1073741824)} || ' GB' END AS server,
      CASE WHEN b = 0 THEN '0 Bytes' WHEN b < 1024 THEN b || ' Bytes' WHEN b < 1048576 THEN {TWO.format(1024)} || ' KB' WHEN b < 1073741824 THEN {TWO.format(1048576)} || ' MB' ELSE {TWO.format(1073741824)} || ' GB' END AS browser
    FROM {SIZED}""")
def _(t):
    size = F.expr("n_chars * (doc_id % 7) * (doc_id % 11) * (doc_id % 1000)")
    return t.documents.select("doc_id", numbers.format_size(size).alias("server"), numbers.format_size_ui(size).alias("browser"))


def unit(word, size, rest):
    n = f"({rest} // {size})"
    return f"CASE WHEN {n} > 0 THEN {n} || ' {word}' || CASE WHEN {n} > 1 THEN 's' ELSE '' END END"


def long_words():
    rest, parts = "s", []
    for word, size in times.LONG_UNITS:
        parts.append(unit(word, size, rest))
        rest = f"({rest} % {size})"
    parts.append(f"CASE WHEN {rest} > 0 OR s < 1 THEN {rest} || ' second' || CASE WHEN {rest} <> 1 THEN 's' ELSE '' END END")
    return "concat_ws(' ', " + ", ".join(parts) + ")"


def two(sql):
    return f"CASE WHEN {sql} < 10 THEN '0' ELSE '' END || ({sql})"


@q("h14_durations", f"""
    WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 70 ELSE o_orderkey * 7919 % 90000000 END AS s FROM orders)
    SELECT o_orderkey, CASE WHEN s >= 3600 THEN {two('s // 3600')} || ':' ELSE '' END || {two('s % 3600 // 60')} || ':' || {two('s % 60')} AS hms,
      CASE WHEN s >= 3600 THEN s // 3600 || 'h ' || s % 3600 // 60 || 'm' WHEN s >= 60 THEN s // 60 || 'm ' || s % 60 || 's' ELSE s || 's' END AS short,
      {long_words()} AS long FROM d""")
def _(t):
    seconds = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 70 ELSE o_orderkey * 7919 % 90000000 END")
    return t.orders.select(
        "o_orderkey", times.fmt_hms(seconds).alias("hms"), times.fmt_short(seconds).alias("short"), times.fmt_long(seconds).alias("long"))


NOW = "2024-01-31 00:00:00"


@q("h15_relative_time", f"""
    WITH d AS (SELECT event_id, ts, date_sub('second', ts, TIMESTAMP '{NOW}') AS s FROM events)
    SELECT event_id, CASE WHEN s < 60 THEN 'Just now' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago'
        WHEN s < 604800 THEN s // 86400 || 'd ago' ELSE strftime(ts, '%b %-d, %Y') END AS coarse,
      CASE WHEN s < 10 THEN 'Just now' WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago'
        WHEN s < 172800 THEN 'Yesterday' WHEN s < 604800 THEN s // 86400 || 'd ago' ELSE strftime(ts, '%b %-d, %-I:%M %p') END AS fine
    FROM d""")
def _(t):
    return t.events.select(
        "event_id", times.relative_time(F.col("ts"), NOW).alias("coarse"), times.relative_time(F.col("ts"), NOW, fine=True).alias("fine"))


@q("h16_state_label", """
    SELECT id, CASE id % 5 WHEN 0 THEN 'Completed' WHEN 1 THEN 'In Progress' WHEN 2 THEN 'Error' WHEN 3 THEN 'Very Fine' ELSE 'Queue' END AS label FROM progress""")
def _(t):
    state = F.expr("element_at(array('Completed(Displayname=COMPLETED)', 'X(Value=IN_PROGRESS)', 'State.ERROR', 'VERY_FINE', 'QUEUE (old)'), CAST(id % 5 AS INT) + 1)")
    return t.progress.select("id", text.state_label(state).alias("label"))


@q("h17_derive_end_year", """
    WITH y AS (SELECT series_id, max(coalesce(year(TRY_CAST(cover_date AS DATE)), TRY_CAST(substr(cover_date, 1, 4) AS INT))) AS y FROM catalogue_issues GROUP BY 1)
    SELECT series_id, CASE WHEN 2003 - y >= 2 THEN y END AS end_year FROM y""")
def _(t):
    latest = F.max(times.end_year_candidate(F.col("cover_date")))
    years = t.catalogue_issues.groupBy("series_id").agg(latest.alias("y"))
    return years.select("series_id", times.derive_end_year(F.col("y"), "2003-05-01").cast("bigint").alias("end_year"))


@q("h18_name_year", "SELECT id, name, CASE WHEN id % 2 = 0 THEN start_year END AS year FROM series")
def _(t):
    folder = F.expr("concat('/data/x/', name, CASE WHEN id % 2 = 0 THEN concat(' (', start_year, ')') ELSE '' END, '/')")
    return t.series.select("id", text.name_year(folder).alias("n")).select("id", "n.name", "n.year")


@q("h19_hashes", """
    SELECT doc_id, rtrim(translate(to_base64(unhex(sha256(text))), '+/', '-_'), '=') AS etag, md5(text) AS url_hash, sha256(text) AS content_hash FROM documents""")
def _(t):
    body = F.col("text")
    return t.documents.select(
        "doc_id", text.etag(body).alias("etag"), text.url_hash(body).alias("url_hash"), text.content_hash(body).alias("content_hash"))


@q("h20_parse_threshold", """
    SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN (o_orderkey % 100)::DOUBLE / 100 WHEN 1 THEN CASE WHEN o_orderkey % 100 > 1 THEN (o_orderkey % 100)::DOUBLE / 100 ELSE o_orderkey % 100 END
      WHEN 2 THEN CAST('0.' || o_orderkey % 1000 AS DOUBLE) ELSE 0.55::DOUBLE END AS threshold FROM orders""")
def _(t):
    raw = F.expr(
        "CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN concat(' ', o_orderkey % 100, ' % ') WHEN 1 THEN CAST(o_orderkey % 100 AS STRING) "
        "WHEN 2 THEN concat('0.', o_orderkey % 1000) WHEN 3 THEN 'abc' WHEN 4 THEN 'x%' END")
    return t.orders.select("o_orderkey", numbers.parse_threshold(raw).alias("threshold"))


@q("h21_fallback_text", """
    SELECT id, CASE WHEN coalesce(title, '') <> '' THEN 'In "' || title || '", ' ELSE 'In issue #' || issue_number || ' of S' || series_id || ', ' END
      || 'the story continues with new adventures and challenges. This issue promises exciting developments in the ongoing narrative.'
      || CASE WHEN id % 2 = 0 THEN ' Published ' || CAST(cover_date AS VARCHAR) || '.' ELSE '' END AS body FROM issues""")
def _(t):
    body = text.fallback_text(
        F.expr("concat('S', series_id)"), F.col("issue_number"), F.col("title"), F.expr("CASE WHEN id % 2 = 0 THEN CAST(cover_date AS STRING) WHEN id % 3 = 0 THEN '' END"))
    return t.issues.select("id", body.alias("body"))


@q("h22_month_label", "SELECT id, strftime(time_started, '%b ''%y') AS label FROM progress")
def _(t):
    return t.progress.select("id", times.month_label(times.month_of(F.col("time_started"))).alias("label"))


@q("h23_parse_message", """
    SELECT event_id, CASE stage WHEN 'signup' THEN event_id % 9 + 1 END AS total,
      CASE stage WHEN 'signup' THEN event_id % 9 + 1 WHEN 'click' THEN event_id % 40 END AS current,
      CASE stage WHEN 'purchase' THEN 1 ELSE 0 END AS add_success, CASE stage WHEN 'error' THEN 1 ELSE 0 END AS add_failed,
      upper(stage[1]) || stage[2:] AS stage_label FROM events_bound""")
def _(t):
    parsed = progress.parse_message(F.col("message"), F.col("stage"))
    rows = t.events_bound.select("event_id", parsed.alias("p"))
    return rows.select(
        "event_id", F.col("p.total").cast("bigint").alias("total"), F.col("p.current").cast("bigint").alias("current"),
        "p.add_success", "p.add_failed", "p.stage_label")


@q("h24_duration_s", """
    SELECT id, date_diff('second', time_started, coalesce(time_finished, TIMESTAMP '2002-01-01 00:00:00')) AS seconds FROM progress""")
def _(t):
    return t.progress.select("id", times.duration_s(F.col("time_started"), F.col("time_finished"), "2002-01-01 00:00:00").alias("seconds"))


@q("h25_eta", """
    WITH e AS (SELECT id, percentage_complete AS p, date_diff('second', time_started, TIMESTAMP '2001-12-01 00:00:00')::DOUBLE AS s FROM progress),
    r AS (SELECT id, CASE WHEN p > 0 THEN greatest(s / (p / 100.0::DOUBLE) - s, 0.0::DOUBLE) END AS r FROM e), m AS (SELECT *, CAST(ceil(r / 60) AS BIGINT) AS m FROM r)
    SELECT id, CASE WHEN r IS NULL THEN NULL WHEN m <= 0 THEN 'Soon' WHEN m < 60 THEN m || 'm' ELSE m // 60 || 'h ' || m % 60 || 'm' END AS label FROM m""")
def _(t):
    left = times.eta(F.col("time_started"), F.col("percentage_complete"), "2001-12-01 00:00:00")
    return t.progress.select("id", left["label"].alias("label"))


@q("h26_safe_names", """
    SELECT doc_id, md5(rtrim(regexp_replace(text, '[^\\p{L}\\p{N} _-]', '', 'g'))) AS safe, CASE WHEN doc_id % 3 = 0 THEN '.png' ELSE '.jpg' END AS ext FROM documents""")
def _(t):
    url = F.expr("concat('http://h.x/a.b/', doc_id, CASE WHEN doc_id % 3 = 0 THEN '.png' ELSE '' END, '?q=1.gif')")
    return t.documents.select("doc_id", F.md5(text.safe_name(F.col("text"))).alias("safe"), text.url_ext(url).alias("ext"))


@q("h27_from_date_array", """
    SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN date_trunc('millisecond', ts) ELSE date_trunc('day', ts) END AS VARCHAR) AS at FROM events""")
def _(t):
    parts = F.expr(
        "CASE WHEN event_id % 2 = 0 THEN array(year(ts), month(ts), day(ts), hour(ts), minute(ts), second(ts), CAST(extract(SECOND FROM ts) * 1000000 % 1000000 AS INT) * 1000) "
        "ELSE array(year(ts), month(ts), day(ts)) END")
    return t.events.select("event_id", times.from_date_array(parts).cast("string").alias("at"))


@q("h28_completion_pct", """
    SELECT id, CASE WHEN issues_available_count > 25 THEN CAST(floor(issues_owned_count::DOUBLE / (issues_available_count - 25) * 100 + 0.5) AS BIGINT) ELSE 0 END AS pct FROM series_owned""")
def _(t):
    available = F.greatest(F.col("issues_available_count") - 25, F.lit(0))
    return t.series_owned.select("id", numbers.completion_pct(F.col("issues_owned_count"), available).alias("pct"))


@q("h29_default_title", """SELECT id, CASE WHEN title = '' THEN 'S' || series_id || ' #' || issue_number ELSE title END AS title FROM issues""")
def _(t):
    return t.issues.select("id", text.default_title(F.col("title"), F.expr("concat('S', series_id)"), F.col("issue_number")).alias("title"))


@q("h30_int_from_map", """
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(json_extract(props, '$.k') AS INTEGER) WHEN 1 THEN 7 END AS number FROM events""")
def _(t):
    values = F.expr(
        "CASE CAST(event_id % 3 AS INT) WHEN 0 THEN map('a', 'x', 'k', CAST(get_json_object(props, '$.k') AS STRING)) WHEN 1 THEN map('a', '7', 'k', '9') ELSE map('k', '1.5') END")
    return t.events.select("event_id", numbers.int_from_map(values, ["a", "k"]).alias("number"))


@q("h31_year_range", """
    SELECT id, CASE WHEN id % 5 = 0 THEN '' WHEN end_year IS NOT NULL AND end_year <> start_year THEN start_year || ' - ' || end_year ELSE CAST(start_year AS VARCHAR) END AS label FROM series""")
def _(t):
    start = F.expr("CASE WHEN id % 5 = 0 THEN NULL ELSE start_year END")
    return t.series.select("id", text.year_range(start, F.col("end_year")).alias("label"))
