import datetime as dt
import unicodedata

from pyspark.sql import functions as F

from longbox.functions import natural, numbers, progress, text, times


def test_make_readable(column):
    got = column(text.make_readable, [
        None, "<p>A &amp; B&nbsp;c.</p>Next", 'He said. "Go" Now', "a&lt;b&gt; &quot;x&quot; &#39;y&#39; &mdash;&ndash;",
        "One.   Two", "End. New York: late"])
    assert got == ["", "A & B c.\n\nNext", 'He said.\n\n"Go"\n\nNow', "a<b> \"x\" 'y' —–", "One.\n\nTwo", "End.\n\nNew York: late"]


def test_clean_only_keeps_other_entities(column):
    assert column(text.clean_only, [None, "<b>x</b>  &lt; &amp;"]) == ["", "x &lt; &"]


def test_basic_paragraphs(column):
    assert column(text.basic_paragraphs, ['Stop. Then, go. "Hi"', "No. break"]) == ['Stop.\n\nThen, go.\n\n"Hi"', "No. break"]


def test_names(column):
    values = [None, "  ", "Éclair  Man: №1!", "-_x_-", "a" * 120, "!!!"]
    assert column(text.normalize_name, values) == ["unknown", "unknown", "eclair_man_1", "x", "a" * 100, "unknown"]
    assert column(text.slug, values) == ["unknown", "unknown", "eclair-man-1", "x", "a" * 100, "unknown"]


def test_decomposition_matches_unicode(column):
    word = "Žluťoučký kůň"
    bare = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
    assert column(text.normalize_name, [word]) == [bare.lower().replace(" ", "_")]


def test_small_text_functions(column):
    assert column(text.sanitize_key, [None, "A b!!c_"]) == ["null", "a_b_c"]
    assert column(text.image_path, ["h/stored_images/a/b", "h/image/c", "d"]) == ["a/b", "c", "d"]
    assert column(text.normalize_barcode, ["0-12345678901 2", "1234567890123", "x"]) == ["123456789012", "1234567890123", ""]
    assert column(text.id_from_url, ["https://x/api/issue/17/?format=json", "https://x/api/issue/17/"]) == [17, None]
    assert column(lambda c: text.absolute_url(c, "https://b.c"), ["//x/y", "/y", "y", "http://z"]) == [
        "https://x/y", "https://b.c/y", "https://b.c/y", "http://z"]
    assert column(text.state_label, ["Completed(Displayname=Completed)", "A(Value=IN_PROGRESS)", "State.ERROR", "NEAR_MINT (x)"]) == [
        "Completed", "In Progress", "Error", "Near Mint"]
    assert [tuple(r) for r in column(text.name_year, ["/a/Green Lanterns (2016)/", "Plain"])] == [("Green Lanterns", 2016), ("Plain", None)]
    assert column(text.url_ext, ["http://a.b/c.png?x=1.gif", "http://a.b/c", "http://a.b/.hidden"]) == [".png", ".jpg", ".jpg"]
    assert column(text.safe_name, ["Spider-Man: é_1 "]) == ["Spider-Man é_1"]


def test_issue_number_match(spark):
    df = spark.createDataFrame([("#1", "1"), ("1A", "1"), ("2", "12"), (None, "1")], "a STRING, b STRING")
    got = [r[0] for r in df.select(text.issue_number_match(df.a, df.b)).collect()]
    assert got == [True, True, False, False]


def test_year_range(spark):
    df = spark.createDataFrame([(1990, 1995), (1990, 1990), (1990, None), (None, 1995)], "a INT, b INT")
    assert [r[0] for r in df.select(text.year_range(df.a, df.b)).collect()] == ["1990 - 1995", "1990", "1990", ""]


def test_format_size(column):
    sizes = [0, 1023, 1024, 1280, 1048575, 1048576, 1073741824]
    assert column(numbers.format_size, sizes, "BIGINT") == ["0 B", "1023 B", "1.0 KB", "1.3 KB", "1024.0 KB", "1.0 MB", "1.0 GB"]
    assert column(numbers.format_size_ui, [0, 1, 1536, 1048576, 1234567], "BIGINT") == ["0 Bytes", "1 Bytes", "1.5 KB", "1 MB", "1.18 MB"]


def test_parse_threshold(column):
    got = column(numbers.parse_threshold, ["55%", "55", "0.55", "1", "abc", None, "x%", " 40 % "])
    assert got == [0.55, 0.55, 0.55, 1.0, 0.55, 0.55, 0.55, 0.4]


def test_rounding_is_half_up(column):
    assert column(lambda c: numbers.round_half_up(c, 1), [0.25, 2.45, -0.25], "DOUBLE") == [0.3, 2.5, -0.2]


def test_first_int(column):
    assert column(numbers.first_int, [None, "", "x", "A12b3", "99999999999999999999"]) == [0, 0, 0, 12, 0]


def test_durations(column):
    seconds = [0, 59, 60, 3600, 90061, 32054461]
    assert column(times.fmt_hms, seconds, "BIGINT") == ["00:00", "00:59", "01:00", "01:00:00", "25:01:01", "8904:01:01"]
    assert column(times.fmt_short, [5, 65, 3661, -1, None], "BIGINT") == ["5s", "1m 5s", "1h 1m", "Invalid", ""]
    assert column(times.fmt_long, [0, 1, 60, 90061, 32054461], "BIGINT") == [
        "0 seconds", "1 second", "1 minute", "1 day 1 hour 1 minute 1 second", "1 year 6 days 1 minute 1 second"]


def test_relative_time(column):
    now = dt.datetime(2024, 1, 10, 12, 0, 0)
    ago = [now - dt.timedelta(seconds=s) for s in (5, 30, 90, 7200, 100000, 300000, 700000)]
    assert column(lambda c: times.relative_time(c, str(now)), ago, "TIMESTAMP_NTZ") == [
        "Just now", "Just now", "1m ago", "2h ago", "1d ago", "3d ago", "Jan 2, 2024"]
    assert column(lambda c: times.relative_time(c, str(now), fine=True), ago, "TIMESTAMP_NTZ")[:6] == [
        "Just now", "30s ago", "1m ago", "2h ago", "Yesterday", "3d ago"]


def test_from_date_array(column):
    got = column(times.from_date_array, [[2024, 2, 3], [2024, 2, 3, 4, 5, 6, 789000000], [2024, 2], None], "ARRAY<INT>")
    assert got == [dt.datetime(2024, 2, 3), dt.datetime(2024, 2, 3, 4, 5, 6, 789000), None, None]


def test_end_year(column):
    assert column(times.end_year_candidate, ["2019-05-01", "2019-xx", "", None]) == [2019, 2019, None, None]
    assert column(lambda c: times.derive_end_year(c, "2020-01-01"), [2019], "INT") == [None]
    assert column(lambda c: times.derive_end_year(c, "2021-01-01"), [2019], "INT") == [2019]


def order(spark, numbers, keys):
    df = spark.createDataFrame([(n,) for n in numbers], "n STRING")
    return [r.n for r in df.orderBy(*keys(F.col("n"))).collect()]


def test_natural_order(spark):
    for given, wanted in ((["10", "1", "2"], ["1", "2", "10"]), (["2", "1.5", "1"], ["1", "1.5", "2"]), (["2", "1B", "1", "1A"], ["1", "1A", "1B", "2"])):
        assert order(spark, given, natural.natural_key_a) == wanted
    assert order(spark, ["½", None, "Annual 1", "", "One-Shot", "2"], natural.natural_key_a)[:3] == ["Annual 1", "2", "One-Shot"]
    keys = lambda c: natural.natural_key_b(c, F.lit(None).cast("string"))
    assert order(spark, ["X1", "Annual 3", "2", "Special 1"], keys) == ["Special 1", "2", "Annual 3", "X1"]


def test_parse_message(spark):
    df = spark.createDataFrame([
        ("Processing 5 uploaded images", "processing_data"), ("Image 3/10", "x_y"), ("Completed image 1/2", "completed"),
        ("Failed image 1/2 - error", "error"), ("Completed: Successfully processed 3/5", "completed"), (None, "error")], "m STRING, s STRING")
    got = [r.p.asDict() for r in df.select(progress.parse_message(df.m, df.s).alias("p")).collect()]
    assert (got[0]["total"], got[0]["current"], got[0]["stage_label"]) == (5, 5, "Processing Data")
    assert (got[1]["total"], got[1]["current"], got[1]["stage_label"]) == (10, 3, "X Y")
    assert (got[2]["add_success"], got[2]["add_failed"], got[2]["stage_label"]) == (1, 0, "COMPLETED")
    assert (got[3]["add_success"], got[3]["add_failed"]) == (0, 1)
    assert (got[4]["set_success"], got[4]["set_failed"], got[4]["add_success"]) == (3, 2, 0)
    assert got[5]["stage_label"] is None
