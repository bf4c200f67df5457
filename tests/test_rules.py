import datetime

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import text as T
from tallyweave.operators import rules as R

TODAY = datetime.date(2026, 5, 1)


def issues(df, rules, **options):
    return sorted((r.row_num, r.column, r.rule) for r in R.validate(df, R.parse_rules(rules), today=TODAY, **options).collect())


def test_six_issues_from_two_rows(spark):
    rows = [(2, "TASK-001", "Build validator", "Open", 50, TODAY + datetime.timedelta(1)), (3, "TASK-001", "", "Blocked", 120, TODAY - datetime.timedelta(2))]
    df = spark.createDataFrame(rows, "row_num long, `Task ID` string, `Task Name` string, Status string, `Completion %` int, `Due Date` date")
    rules = [
        {"column": "task id", "check": "unique"}, {"column": "Task Name", "check": "required"}, {"column": "Status", "check": "in", "values": ["open", "done"]},
        {"column": "Completion %", "check": "between", "min_value": 0, "max_value": 100}, {"column": "Due Date", "check": "date_not_past"},
    ]
    assert issues(df, rules) == [(2, "task id", "unique"), (3, "Completion %", "between"), (3, "Due Date", "date_not_past"), (3, "Status", "in"), (3, "Task Name", "required"), (3, "task id", "unique")]


def test_conditions_modes_and_blank_rows(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", ""), (3, None, " "), (4, "c - dar", None)], "row_num long, kind string, value string")
    rules = [{"column": "value", "check": "required", "when": [{"column": "kind", "operator": "not_blank"}]}]
    assert issues(df, rules) == [(2, "value", "required"), (4, "value", "required")]
    rules[0]["when"] = [{"column": "kind", "operator": "endswith", "value": "- DAR"}]
    assert issues(df, rules) == [(4, "value", "required")]
    plain = [{"column": "kind", "check": "equals", "value": "a"}]
    assert issues(df, plain) == [(2, "kind", "equals"), (4, "kind", "equals")]
    assert issues(df, [{"column": "value", "check": "not_equals", "value": "q"}, {"column": "value", "check": "required"}], modes={"missing_only"}) == [(2, "value", "required"), (4, "value", "required")]


def test_findings_follow_the_message(spark):
    df = spark.createDataFrame([("Title is required.",), ("got HTTP 404",), ("GENRE_MISMATCH: x",), ("odd",), ("fan page, 404",), ("PLACEHOLDER found",)], "m string")
    got = [r.f.finding_category for r in df.select(R.finding(F.col("m")).alias("f")).collect()]
    assert got == ["Needs Manual Review", "No Official Presence Found", "Suspected Incorrect", "Suspected Incorrect", "Fan Page Detected", "Placeholder Found"]


def test_arguments_are_checked():
    for bad in ([{"column": "a", "check": "regex"}], [{"column": "a", "check": "what"}], {"rules": 3}):
        with pytest.raises(ValueError):
            R.parse_rules(bad)
    assert len(R.parse_rules('{"rules": [{"column": "a", "check": "required", "extra": 1}]}')) == 1


def test_missing_columns(spark):
    df = spark.createDataFrame([(1, "a")], "row_num long, a string")
    with pytest.raises(ValueError):
        R.validate(df, R.parse_rules([{"column": "b", "check": "required", "sheet": "s"}]), sheet="s")


def test_urls_and_social_references(spark):
    df = spark.createDataFrame([(1, "https://facebook.com/p/x"), (2, "facebook.com/brand"), (3, "https://www.facebook.com/brand/"), (4, "https://facebook.com/a, https://facebook.com/groups/b")], "row_num long, facebook_page string")
    assert issues(df, [{"column": "facebook_page", "check": "url_not_contains_if_present", "tokens": ["/p/"]}]) == [(1, "facebook_page", "url_not_contains_if_present")]
    got = R.validate(df, R.parse_rules([{"column": "facebook_page", "check": "social_reference_format", "platform": "facebook"}])).collect()
    assert sorted(r.row_num for r in got) == [1, 4]
    assert "entry 2" in next(r.message for r in got if r.row_num == 4)


def test_numbers_and_dates(spark):
    cells = ["12", " 1_000 ", "12d", "1e3", "", None, "abc", "-.5", "inf"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert [r.n for r in df.select(T.number(F.col("c")).alias("n")).collect()] == [12.0, 1000.0, None, 1000.0, None, None, None, -0.5, float("inf")]
    cells = {"2024-01-05": (2024, 1, 5), "03-04-2021": (2021, 4, 3), "13-25-2021": None, "04-13-2021": (2021, 4, 13), "03/04/2021": (2021, 3, 4), "13/04/2021": (2021, 4, 13), "2021/3/4": (2021, 3, 4), "May 7, 2026": (2026, 5, 7), "7 May 2026": (2026, 5, 7), "2021-3-4": None, "x": None}
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert {r.c: r.d and (r.d.year, r.d.month, r.d.day) for r in df.select("c", T.date(F.col("c")).alias("d")).collect()} == cells


def test_plan_is_one_scan_without_python(spark):
    df = spark.range(10).select(F.col("id").alias("row_num"), F.col("id").cast("string").alias("a"))
    plan = R.validate(df, R.parse_rules([{"column": "a", "check": "required"}, {"column": "a", "check": "min", "value": 3}]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_clean_flagged_and_passed(spark):
    df = spark.createDataFrame([(1, "a"), (2, "")], "row_num long, a string").withColumn("b", F.lit("x"))
    found = R.validate(df, R.parse_rules([{"column": "a", "check": "required"}]))
    assert [r.row_num for r in R.clean_rows(df, found).collect()] == [1]
    assert [r.row_num for r in R.flagged_rows(df, found).collect()] == [2]
    assert R.with_passed_row(found, spark.range(1)).count() == 1
    [r] = R.with_passed_row(found.filter("row_num > 5"), spark.range(1)).collect()
    assert r.message == "All checks passed."


def test_reference_checks_run_on_tables_and_skip_without(spark):
    from tallyweave.operators import references

    df = spark.createDataFrame([(1, "Heat", "movies", "tt0113277", "Comedy"), (2, "Heat", "movies", "tt0113277", "Action"), (3, "Dune", "movies", "tt0000009", "")], "row_num long, title string, title_category string, imdb_id string, genre string")
    ref = spark.createDataFrame([("imdb", "tt0113277", ["Heat"], None, "movie"), ("imdb", "tt0000009", ["Other"], None, "movie")], "platform string, ref_id string, titles array<string>, wikidata_id string, type string")
    entities = spark.createDataFrame([("tt0113277", "movie", "heat", ["Action"], "1995-12-15", ["W"], [])], "imdb_id string, kind string, title_norm string, genres array<string>, release_date string, networks array<string>, companies array<string>")
    rules = [{"column": "genre", "check": "genre_taxonomy_audit"}, {"column": "imdb_id", "check": "reference_lookup_match", "platform": "imdb"}, {"column": "imdb_id", "check": "imdb_url_audit"}, {"column": "title", "check": "required"}, {"column": "elsewhere", "check": "required"}]
    got = issues(df, rules, refs=references.table_checks(entities=entities, references=ref))
    assert got == [(1, "genre", "genre_taxonomy_audit"), (3, "genre", "genre_taxonomy_audit"), (3, "imdb_id", "imdb_url_audit"), (3, "imdb_id", "reference_lookup_match")]
    assert issues(df, rules) == []
    labels = spark.createDataFrame([("@heatmovie", "Heat"), ("youtube.com/c/other", "Heat"), ("", "Heat"), ("youtube.com/channel/UC1", "Heat")], "v string, t string")
    assert [r.f for r in labels.select(references.youtube_label_fits(F.col("v"), F.col("t")).alias("f")).collect()] == [True, False, True, True]


def test_issues_are_written_in_one_pass(spark, tmp_path):
    rules = R.parse_rules([{"column": "name", "check": "required"}])
    bad, good = (spark.createDataFrame(rows, "row_num long, name string, n int") for rows in ([(1, "", 1), (2, "x", 1), (3, None, 1)], [(1, "x", 1)]))
    assert R.write_issues(R.validate(bad, rules), str(tmp_path / "out")) == 2
    assert {r.row_num for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1, 3}
    assert R.write_issues(R.validate(good, rules), str(tmp_path / "out")) == 0
    [r] = spark.read.parquet(str(tmp_path / "out")).collect()
    assert r.message == R.PASSED and r.row_num is None
