"""Operators that have no query of their own: look-ups by id, candidates, page parsers, sources, small helpers."""

import datetime

from pyspark.sql import functions as F

from tallyweave.functions import text as T
from tallyweave.operators import changes as C
from tallyweave.operators import duplicates as D
from tallyweave.operators import exports as E
from tallyweave.operators import extract as X
from tallyweave.operators import history as H
from tallyweave.operators import lookup as L
from tallyweave.operators import references as R
from tallyweave.operators import scoring as S
from tallyweave.operators import tickets as K
from tallyweave.sources import files
from tallyweave.streaming import queries as Z


def one(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_lookup_ids(spark):
    queries = one(spark, "q int, v string", (1, " TT0000001 "), (2, "nm0000009"), (3, "heat"), (4, None))
    titles = one(spark, "tconst string, name string", ("tt0000001", "One"))
    got = {r.q: (r.status, r.match.name if r.match else None) for r in L.lookup_ids(queries, titles, "v", "tconst").collect()}
    assert got == {1: ("matched", "One"), 2: ("not_found", None), 3: ("invalid", None), 4: ("invalid", None)}


def test_attach_ids_and_query_variants(spark):
    items = one(spark, "title string, year int", ("a", 1), ("b", 2))
    scored = one(spark, "title string, year int, id string, match_rank int", ("a", 1, "x", 1), ("a", 1, "y", 2))
    assert {(r.title, r.id) for r in L.attach_ids(items, scored, ["title", "year"], "id").collect()} == {("a", "x"), ("b", None)}
    got = one(spark, "t string", ("Salt & Iron (2020) - DAR",), ("Sand and Sea",)).select(L.query_variants(F.col("t")).alias("v")).collect()
    assert got[0].v == ["Salt & Iron (2020)", "Salt & Iron", "Salt and Iron (2020)"] and got[1].v == ["Sand and Sea", "Sand & Sea"]
    assert one(spark, "p string", ("film_actor,, writer",), (None,)).select(L.professions(F.col("p")).alias("p")).collect() == [("Film Actor; Writer",), ("",)]


def test_wikimedia_and_reference_records(spark):
    pages = one(spark, "page_title string, missing boolean, disambiguation boolean, item_id string, redirected_from string", ("A", False, False, "Q1", "Old A"), ("B", True, False, None, None), ("C", False, True, "Q3", None), ("D", False, False, None, None))
    items = one(spark, "item_id string, labels array<string>, aliases array<string>, instance_of array<string>", ("Q1", ["A", "Ah"], None, ["Q11424"]), ("Q3", [], [], []))
    got = {r.page_title: (r.reject_reason, r.titles, r.type) for r in R.merge_wikimedia(pages, items).collect()}
    assert got["A"] == (None, ["A", "Ah", "Old A"], "movie")
    assert [got[k][0] for k in "BCD"] == ["page is missing", "disambiguation page", "page has no item"]
    titles = one(spark, "tconst string, primary_title string, original_title string, title_type string", ("tt1", "A", None, "movie"))
    people = one(spark, "nconst string, primary_name string", ("nm1", "P"))
    assert {(r.ref_id, tuple(r.titles), r.type) for r in R.reference_records(titles, people).collect()} == {("tt1", ("A",), "movie"), ("nm1", ("P",), "person")}


def test_best_candidate(spark):
    rows = [(1, "Harbor", "movie", "movie", "Harbour Lights", 5.0, 1), (1, "Harbor", "movie", "tv", "Harbor", 1.0, 1), (2, "Zebra", "tv", "tv", "Quite another", 9.0, 1)]
    got = R.best_candidate(one(spark, "q int, query string, preferred_type string, type string, title string, popularity double, position int", *rows), query_id="q").collect()
    assert [(r.q, r.title) for r in got] == [(1, "Harbor")]
    pair = one(spark, "a string, b string", ("A b", "a  B!"), ("sea", "sea wolf"), ("x", None)).select(R.title_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert pair[0].s == 1.2 and pair[1].s >= 0.9 and pair[2].s == 0.0


def test_search_candidates(spark):
    rows = [(1, 1, "Orla Finch | Site", "short", "", "a.org"), (1, 2, "Finch Orla - News", "a longer one", "", "b.org"), (1, 3, "Other", None, "k", "c.org")]
    got = {r.label: (r.score, r.description, r.position) for r in S.build_candidates(one(spark, "q int, o int, title string, description string, key string, source_domain string", *rows), "q", "o").collect()}
    assert got == {"Orla Finch": (12.0, "a longer one", 1), "Other": (8.0, None, 3)}
    hits = one(spark, "q int, o int, name string, label string, description string", (1, 1, "Mira", "Mira", "town in a valley"), (1, 2, "Mira", "Mira", "singer"), (2, 1, "No", "x", ""))
    assert {(r.q, r.o, r.score) for r in S.select_artist(hits, "q", "o", {"singer": 10, "town": -10}).collect()} == {(1, 2, 15), (2, 1, 0)}
    found = R.hits_to_results(one(spark, "q int, item_id string, position int", (1, "Q7", 4), (1, "Q8", 9)), one(spark, "item_id string, article string", ("Q7", "Big Lake")), query_id="q")
    assert [(r.position, r.url) for r in found.orderBy("position").collect()] == [(1, "https://en.wikipedia.org/wiki/Big_Lake"), (2, "https://www.wikidata.org/wiki/Q8")]


def test_movie_checks(spark):
    movies = one(spark, "title_norm string, year int, us_date string, general_date string, release_type string, genres array<string>, page_url string", ("lanterns", 2020, "2020-05-01", None, "Wide", ["Drama"], "https://www.rottentomatoes.com/m/lanterns"))
    schema = "i int, title string, released_on string, release_type string, primary_genre string, film_page_url string"
    rows = [(1, "Lanterns", "2020-05-01", "wide", "Drama", "/m/lanterns"), (2, "Lanterns", "2020-05-02", "Limited", "Comedy", "/m/other"), (3, "Unknown", "2020-05-02", "Limited", "", None)]
    got = {(r.i, r.finding) for r in R.movie_checks(one(spark, schema, *rows), movies).collect()}
    assert got == {(2, "release_date"), (2, "release_type"), (2, "genre"), (2, "film_page")}


def test_page_parsers(spark):
    html = '<search-page-result type="tv"><search-page-media-row><a slot="title" href="/m/no">No</a></search-page-media-row></search-page-result><search-page-result type="movie"><search-page-media-row releaseyear="2001" startyear="" endyear=""><a slot="title" href="https://r.example/m/owl">Owl &amp; I</a></search-page-media-row></search-page-result>'
    pages = one(spark, "page_id int, html string", (1, html), (2, None))
    assert [(r.page_id, r.title, r.url, r.release_year) for r in X.media_rows(pages, "movie").collect()] == [(1, "Owl & I", "https://r.example/m/owl", "2001")]
    profile = '{"category_name":"Band","business_category_name":"Music","biography":"we \\\\"play\\\\""}<meta property="og:description" content="5 fans &amp; more">'
    [r] = X.profile_pages(one(spark, "page_id int, html string", (1, profile))).collect()
    assert (r.category_name, r.business_category, r.description) == ("Band", "Music", "5 fans & more")
    found = '<a class="result__a" href="//d.example/l/?uddg=https%3A%2F%2Fa.org%2Fx&amp;r=1">A <b>x</b></a><a class="result__a" href="https://b.org/">B</a><a class="result__a" href="/rel">C</a>'
    assert [(r.position, r.title, r.url) for r in X.search_results(one(spark, "page_id int, html string", (1, found))).orderBy("position").collect()] == [(1, "A x", "https://a.org/x"), (2, "B", "https://b.org/")]
    page = "<h2>Shows of 2024</h2><h3>Friday, May 3</h3><table><tr><td></td><td><strong>Lantern</strong> color trailer<br>($) International/Rom-Com: in love</td><td>ABC 9:30a<br>ABC 9p [app/VOD only]</td></tr><tr><td>x</td></tr></table>"
    [r] = X.tv_classification(one(spark, "page_id int, body string, base_year int", (1, page, 2020), (2, None, 2020))).collect()
    assert (r.release_date, r.title, r.network, r.language_type, r.genre_1, r.genre_2) == ("2024-05-03", "Lantern", "ABC", "Language Type - Other", "Rom Com", "")
    assert r.daypart.startswith("Daypart - Prime") and r.program_type == "Program Type - Other"


def test_sources_and_histories(spark, tmp_path):
    table = one(spark, "cat string, sub string", ("A", "x"), (" A ", "y"), ("A", "nan"), ("", "z"), (None, "z"))
    assert [(r.category, r.sub_categories) for r in files.taxonomy_table(table, "cat", "sub").collect()] == [("A", ["x", "y"])]
    roster = one(spark, "Artist string, Sex string, n int", ("Mo", "f", 1), ("MO", "", 2), (None, "m", 3))
    assert [(r.name, r.gender) for r in files.roster_table(roster, {"name": ["name", "artist"], "gender": ["gender", "sex"]}, "n").collect()] == [("MO", None)]
    files.write_run(one(spark, "a int", (1,)), str(tmp_path / "runs"), "2026-01-02", "r1")
    files.write_run(one(spark, "a int", (2,)), str(tmp_path / "runs"), "2026-01-02", "r2")
    assert {(r.a, r.run_id) for r in spark.read.parquet(str(tmp_path / "runs")).collect()} == {(1, "r1"), (2, "r2")}
    runs = one(spark, "id int, at int", (1, 5), (2, 9), (3, 7))
    assert [r.id for r in H.run_history(runs, "at", 2).collect()] == [2, 3]
    kept = H.weekly_append(one(spark, "a int, run string", (1, "w1"), (2, "w2"), (3, None)), one(spark, "a int", (9,)), "run", "w2")
    assert {(r.a, r.run) for r in kept.collect()} == {(1, "w1"), (3, None), (9, "w2")}
    out = H.export_rows(one(spark, "a int, b array<int>", (1, [1, 2]), (None, None)), ["b", "a", "gone"]).collect()
    assert [tuple(r) for r in out] == [("1, 2", "1", ""), ("", "", "")]
    assert E.export_table(one(spark, "title string, genre_1 string", ("A", None)), "tv").first().asDict()["Title"] == "A"


def test_small_helpers(spark):
    df = one(spark, "u string, d string, s string", ("https://a.org", "2026-03-04", 'site:x.org "Big  Lake" official (film) the'), (None, "-", None))
    got = df.select(T.stable_id(F.col("u")).alias("i"), T.display_date(F.col("d")).alias("d"), T.search_words(F.col("s")).alias("s"), T.shorten(F.lit("abcdef"), 4).alias("t")).collect()
    assert len(got[0].i) == 12 and (got[0].d, got[0].s, got[0].t) == ("04-03-2026", "Big Lake", "abc…") and got[1].d == ""
    risks = one(spark, "v string", ("the_real_mo",), ("mo",), (None,)).select(C.fan_risk(F.col("v")).alias("r")).collect()
    assert [r.r for r in risks] == [True, False, False]
    rows = one(spark, "k string, o int", ("A", 2), ("a", 1), ("b", 3))
    assert {(r.k, r.o) for r in D.keep_first(rows, [F.lower("k")], [F.col("o")]).collect()} == {("a", 1), ("b", 3)}
    urls = one(spark, "v string", ("@mo/",), ("https://x.com/mo",), ("not a handle",), ("",)).select(T.reference_url("twitter", F.col("v")).alias("u")).collect()
    assert [r.u for r in urls] == ["https://x.com/mo", "https://x.com/mo", None, None]


def test_ticket_states_over_batches(spark, tmp_path):
    events = [("t1", "approve", 1), ("t1", "complete", 2), ("t2", "complete", 1), ("t3", "reject", 1), ("t3", "approve", 2)]
    one(spark, "ticket_id string, action string, seq int", *events).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ticket_id string, action string, seq int").parquet(str(tmp_path / "in"))
    query = Z.ticket_states(stream).writeStream.foreachBatch(lambda batch, n: batch.write.parquet(str(tmp_path / f"out{n}"))).option("checkpointLocation", str(tmp_path / "state"))
    query.outputMode("update").trigger(availableNow=True).start().awaitTermination()
    assert {(r.ticket_id, r.status) for r in spark.read.parquet(str(tmp_path / "out0")).collect()} == {("t1", "completed"), ("t2", "pending_review"), ("t3", "rejected")}


def test_delta_stream_keeps_the_last_row_of_a_key(spark, tmp_path):
    rows = [(1, "old", 1), (1, "new", 2), (2, "b", 1)]
    one(spark, "k int, v string, o int", *rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    Z.delta_stream(spark.readStream.schema("k int, v string, o int").parquet(str(tmp_path / "in")), str(tmp_path / "d"), ["k"], ["o"])
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "d/v0")).collect()} == {(1, "new"), (2, "b")}


def test_chart_entries_against_a_roster(spark):
    chart = one(spark, "rank int, name string, last_week string, gender string", (1, "Mira Sol", "-", ""), (2, "Mirra Sol", "-", "x"), (3, "Old One", "4", ""), (4, "Nobody", None, None))
    got = R.chart_new_entries(chart, one(spark, "name string, gender string", ("mira sol", "f")), fill=("gender",))
    assert {(r.rank, r.in_roster, r.gender) for r in got.collect()} == {(1, True, "f"), (2, True, "x"), (4, False, None)}
    assert R.chart_totals(got).first() == (3, 1)




def test_taxonomy_in_parts(spark, monkeypatch):
    monkeypatch.setattr(K, "MOST_CATEGORIES", 3)
    taxonomy = one(spark, "category string, position int", *[(f"kind {c}", i) for i, c in enumerate("zyxwvutsrq")], ("Talent", 10), ("Movies and TV", 11), ("TV", 12))
    df = one(spark, "r int, c string", (1, "talent"), (2, "tv"), (3, "movies"), (4, "kind"), (5, "some kind q here"), (6, "none"), (7, None), (8, "TV shows"))
    assert {r.r: r.aligned for r in K.align_to_taxonomy(df, taxonomy, "c").collect()} == {1: "Talent", 2: "TV", 3: "Movies and TV", 4: "kind z", 5: "kind q", 6: "Other", 7: "Other", 8: "TV"}


def test_all_rows_of_a_conflict(spark):
    df = one(spark, "row_num long, title string", *[(i, "Same") for i in range(30)])
    found = D.duplicate_conflicts(df)
    all_of = {r.row_num: r.message for r in D.conflict_messages(df, found, most=None).collect()}
    assert all_of[3].endswith(", ".join(str(i) for i in range(30) if i != 3))
    assert D.conflict_messages(df, found).filter("row_num = 3").first().message.endswith(", 19, 20")


def test_window_counters_in_the_same_pass(spark, tmp_path):
    day = datetime.date
    rows = [(1, day(2026, 5, 1), "a"), (2, day(2026, 6, 1), "a"), (3, None, "b"), (4, day(2026, 5, 2), "skip")]
    items = one(spark, "i int, d date, k string", *rows)
    skip = {"special": F.col("k") == "skip"}
    kept, watch = H.observed_window(items, F.col("d"), day(2026, 5, 1), day(2026, 5, 31), skip)
    assert [r.i for r in kept.collect()] == [1]
    counts = {r.window_flag: r["items"] for r in H.window_counts(H.window_flags(items, F.col("d"), day(2026, 5, 1), day(2026, 5, 31), skip)).collect()}
    assert {k: v for k, v in watch.get.items() if v} == counts
    items.write.parquet(str(tmp_path / "in"))
    stream, none = H.observed_window(spark.readStream.schema(items.schema).parquet(str(tmp_path / "in")), F.col("d"), day(2026, 5, 1), day(2026, 5, 31), skip)
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    seen = [p["observedMetrics"]["window"] for p in query.recentProgress if p["numInputRows"]]
    assert none is None and sum(m["kept"] for m in seen) == 1 and sum(m["special"] for m in seen) == 1 and spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_stream_meets_reference_tables_as_they_are(spark, tmp_path):
    from tallyweave.operators import rules as Q

    rules = Q.parse_rules([{"column": "imdb_id", "check": "reference_lookup_match", "platform": "imdb"}, {"column": "title", "check": "required"}])
    schema = "row_num long, title string, title_category string, imdb_id string"
    reference = lambda *titles: one(spark, "platform string, ref_id string, titles array<string>, wikidata_id string, type string", *[("imdb", f"tt000000{i}", [t], None, "movie") for i, t in enumerate(titles)]).write.mode("overwrite").parquet(str(tmp_path / "ref"))
    tables = lambda: R.table_checks("row_num", references=spark.read.parquet(str(tmp_path / "ref")))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    batches = [one(spark, schema, (1, "Old", "Movies", "tt0000000"), (2, "", "Movies", "tt0000001")), one(spark, schema, (3, "Old", "Movies", "tt0000000"), (4, "New", "Movies", "tt0000000"))]
    want = set()
    for batch, titles in zip(batches, (("Old", "Two"), ("New", "Two")), strict=True):
        reference(*titles)
        batch.write.mode("append").parquet(str(tmp_path / "in"))
        Z.validate_with_tables(stream(), rules, tables, str(tmp_path / "run"))
        want |= {(r.row_num, r.column, r.message) for r in Q.validate(batch, rules, refs=tables()).collect()}
    got = {(r.row_num, r.column, r.message) for r in spark.read.parquet(str(tmp_path / "run" / "out")).collect()}
    assert got == want and {r[0] for r in got} == {2, 3}


def test_lookup_tables_stay_where_they_are(spark, tmp_path):
    titles = spark.range(2000).select(F.concat(F.lit("tt"), "id").alias("tconst"), F.concat(F.lit("name "), F.col("id") % 700).alias("norm"))
    queries = spark.range(3000).select("id", F.concat(F.lit("name "), F.col("id") % 900).alias("norm"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = files.write_lookup_table(titles, "titles_by_norm", "norm", buckets=4, path=str(tmp_path / "titles"))
        joined = queries.join(table, "norm")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan and joined.count() == queries.join(titles, "norm").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE IF EXISTS titles_by_norm")
