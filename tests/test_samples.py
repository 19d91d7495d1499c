from pyspark.sql import functions as F

from corpuskit.operators import mapping as P
from corpuskit.operators import relate as J
from corpuskit.operators import stats as A
from corpuskit.operators.ordered import keep_first, lead_split, positional_index


def test_consecutive_pairs_min_length_and_clean(spark):
    m = spark.createDataFrame(
        [("c", 1.0, "hello <@U12> there"), ("c", 2.0, "see <https://x.io|docs>"), ("c", 3.0, "no"),
         ("c", 4.0, "a  b   <!here>"), ("d", 1.0, "x"), ("c", 5.0, None)],
        "channel_id string, ts double, text string")
    out = J.consecutive_pairs(m, min_length=2).orderBy("metadata.input_ts").collect()
    assert [(r.input, r.output) for r in out] == [("hello there", "see docs"), ("see docs", "no"), ("no", "a b")]


def test_lead_split_crosses_buckets(spark):
    rows = [("k", i, f"t{i}") for i in range(0, 50, 3)]
    d = spark.createDataFrame(rows, "k string, o int, v string")
    out = lead_split(d, ["k"], ["o"], ["v"], F.floor(F.col("o") / 4)).orderBy("o").collect()
    assert [r.next_o for r in out] == [r[1] for r in rows[1:]] + [None]


def test_keep_first_is_first_wins(spark):
    d = spark.createDataFrame([(3, "A "), (1, "a"), (2, "b"), (0, "B")], "seq int, input string")
    out = sorted(keep_first(d, F.lower(F.trim("input")), "seq").collect())
    assert out == [(0, "B"), (1, "a")]


def test_row_to_sample_errors(spark):
    d = spark.createDataFrame([(1, "x")], "a int, b string")
    import pytest
    with pytest.raises(KeyError):
        P.row_to_sample(d, {"input": "a"})
    with pytest.raises(KeyError):
        P.row_to_sample(d, {"input": "a", "output": "zz"})
    r = P.row_to_sample(d, {"input": "a", "output": "b"}, keep_raw=True).first()
    assert (r.input, r.output, r.metadata.source) == ("1", "x", "db")
    assert '"a":1' in r.metadata.raw_row


def test_alias_profiles(spark):
    d = spark.createDataFrame([("q", "a", "z")], "Question string, answer string, other string")
    assert P.alias_columns(d, "extract").first() == ("q", "a")
    d2 = spark.createDataFrame([("t", "l")], "text string, label string")
    assert P.alias_columns(d2, "upload").first() == ("t", "l")
    d3 = spark.createDataFrame([("x", "y")], "foo string, bar string")
    assert P.alias_columns(d3, "extract").first() == ("x", "y")


def test_positional_index(spark):
    d = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("v")).repartition(5)
    out = positional_index(d, "v").collect()
    assert sorted((r.v, r.pos) for r in out) == [(i, i) for i in range(1000)]


def test_summary_empty_is_zero(spark):
    e = spark.createDataFrame([], "input string, output string")
    assert tuple(A.dataset_summary(e).first()) == (0, 0.0, 0.0)


def test_validation_report(spark):
    lines = spark.createDataFrame(
        [(1, '{"input": "hi", "output": "hello there friend"}'), (2, ""), (3, "{bad"),
         (4, '{"input": "x"}'), (5, '{"input": "hi", "output": " "}')], "line_num int, line string")
    issues, stats = A.validation_report(lines)
    s = stats.first()
    assert (s.total_lines, s.valid_examples, s.invalid_json, s.missing_field, s.duplicates, s.empty_outputs) == (5, 2, 1, 1, 1, 1)
    got = sorted((r.line_num, r.issue) for r in issues.collect())
    assert (5, "duplicate_input") in got and (3, "invalid_json") in got and (4, "missing_output") in got


def test_flagship_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert set(["input", "output", "channel_id"]) <= set(df.columns)
    assert df.count() > 0


def test_consecutive_pairs_string_stamps_numeric_order(spark):
    m = spark.createDataFrame([("c", "1700000010.5", "third msg"), ("c", "999999999.9", "first msg"),
                               ("c", "1700000002.25", "second msg")], "channel_id string, ts string, text string")
    out = J.consecutive_pairs(m).orderBy(F.col("metadata.input_ts").cast("double")).collect()
    assert [(r.input, r.output) for r in out] == [("first msg", "second msg"), ("second msg", "third msg")]


def test_validation_report_hands_on_profile(spark):
    lines = spark.createDataFrame(
        [(1, '{"input": "hi", "output": "hello there friend"}'), (2, ""), (3, '{"output": "x"}'), (4, '{"input": " "}')],
        "line_num int, line string")
    issues, totals = A.validation_report_hands_on(lines)
    got = sorted((r.line_num, r.issue) for r in issues.collect())
    assert got == [(2, "invalid_json"), (3, "empty_input"), (3, "missing_input"), (3, "short_output"),
                   (4, "empty_input"), (4, "empty_output"), (4, "missing_output"), (4, "short_output")]
    t = totals.first()
    assert (t.total_lines, t.examples, t.issues) == (4, 3, 8)
