"""Duplicates, profiles, health, comparison, look-up."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.functions import text as T
from tallyweave.functions.similarity import jaro_winkler_of
from tallyweave.operators import compare as C
from tallyweave.operators import duplicates as D
from tallyweave.operators import lookup as L
from tallyweave.operators import profile as P


def test_exact_duplicates(spark):
    rows = [(1, "The Dark Knight", 2008), (2, " the dark knight ", 2008), (3, "Inception", 2010), (4, None, None), (5, "", None)]
    got = D.exact_duplicates(spark.createDataFrame(rows, "row_id long, title string, year int"), ["title", "year"]).collect()
    assert sorted((r.row_id, r.group_row, r.group_size) for r in got) == [(1, 1, 2), (2, 1, 2)]


@pytest.mark.parametrize("seed", [0, 1])
def test_fuzzy_groups_match_the_greedy_pass(spark, seed):
    rng = np.random.default_rng(seed)
    base = ["red river", "blue stone", "green valley", "the night", "old harbor"]
    rows = [(i, base[k] + "".join(rng.choice(list("abr "), int(rng.integers(0, 3))))) for i, k in enumerate(rng.integers(0, 5, 40))] + [(100, ""), (101, None)]
    norm = {i: " ".join(t.split()) for i, t in rows if t}
    free, want = sorted(i for i in norm if norm[i]), {}
    while free:
        lead, *rest = free
        near = [j for j in rest if jaro_winkler_of(norm[lead], norm[j]) >= 0.85]
        if near:
            best = round(max(jaro_winkler_of(norm[lead], norm[j]) for j in near), 4)
            want |= {j: (lead, best) for j in [lead, *near]}
        free = [j for j in rest if j not in near]
    got = D.fuzzy_duplicates(spark.createDataFrame(rows, "row_id long, t string"), "t", 0.85).collect()
    assert {r.row_id: (r.group_row, r.similarity) for r in got} == want


def test_fuzzy_groups_of_a_long_chain(spark):
    # each text is similar to its neighbours only, and takes a round of its own
    rng, chain = np.random.default_rng(2), ["abcdefghijklmnopqrst common"]
    letters = list("abcdefghijklmnopqrstuvwxyz0123456789")
    while len(chain) < 56:
        made = list(chain[-1])
        for k in rng.choice(20, 4, replace=False):
            made[k] = str(rng.choice(letters))
        made = "".join(made)
        if jaro_winkler_of(made, chain[-1]) >= 0.85 and all(jaro_winkler_of(made, t) < 0.85 for t in chain[:-1]):
            chain.append(made)
    got = D.fuzzy_duplicates(spark.createDataFrame(list(enumerate(chain)), "row_id long, t string"), "t", 0.85).collect()
    assert {r.row_id: r.group_row for r in got} == {i: i // 2 * 2 for i in range(56)}


def test_conflicts(spark):
    rows = [(2, "Title A", "page1"), (3, "title a", "page2"), (4, "Title B", "shared"), (5, "Title C", "SHARED"), (6, "", None)]
    df = spark.createDataFrame(rows, "row_num long, title string, facebook_page string")
    found = D.duplicate_conflicts(df)
    assert sorted((r.row_num, r.kind) for r in found.collect()) == [(2, "Duplicate entity"), (3, "Duplicate entity"), (4, "Conflicting handle"), (5, "Conflicting handle")]
    assert "3" in {r.row_num: r.message for r in D.conflict_messages(df, found).collect()}[2]


def test_outliers_and_rare_values(spark):
    years = [2020, 2021, 2022, 1920, 2021, 2022]
    df = spark.createDataFrame([(i, f"{y}-01-01", "x") for i, y in enumerate(years)], "row_id long, released_on string, title string")
    assert [(r.row_id, r.severity) for r in P.detect_all(df).collect()] == [(3, "high")]
    df = spark.createDataFrame([(i, "rare" if i == 7 else "common") for i in range(120)], "row_id long, genre string")
    assert [(r.row_id, r.value) for r in P.detect_all(df).collect()] == [(7, "rare")]
    assert P.rare_categories(df.limit(5), ["genre"]).count() == 0


def test_health(spark):
    schema = "row_id long, title string, released_on string, imdb_id string, wikipedia_url string, year string, digital_release_date string, trailer_release_date string"
    rows = [
        (1, "Inception", "2010-07-16", "tt1375666", "https://en.wikipedia.org/wiki/Inception", "2010", None, None),
        (2, "", "16 July", "bad", "nowhere", "1999", None, None),
        (3, "Inception", "2010-07-16", "tt1375666", "https://en.wikipedia.org/wiki/Inception", "2010", "2009-01-01", "2011-01-01"),
    ]
    got = {r.row_id: r.health for r in P.row_health(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1].overall_score, got[1].grade) == (100.0, "A")
    assert got[2].overall_score < 70 and got[2].grade in "DF"
    in_table = {r.row_id: r.health for r in P.row_health_in_table(spark.createDataFrame(rows, schema), "row_id").collect()}
    assert in_table[1].uniqueness == 50.0 and in_table[2].uniqueness == 100.0
    total = P.table_health(P.row_health_in_table(spark.createDataFrame(rows, schema), "row_id")).first()
    assert total.rows == 3 and sum(total.grades.values()) == 3
    assert P.table_health(P.row_health_in_table(spark.createDataFrame([], schema), "row_id")).first().grade == "F"


def test_compare(spark):
    a = spark.createDataFrame([("tt1", "A", 1), ("tt2", "B", 2)], "imdb_id string, title string, year int")
    b = spark.createDataFrame([("TT1 ", "A", 1), ("tt2", "B2", 2), ("tt3", "C", 3)], "imdb_id string, title string, year int")
    got = C.compare(a, b.withColumn("imdb_id", F.lower(F.trim("imdb_id"))), ["imdb_id"]).collect()
    assert sorted((r.row_key, r.status, r.column) for r in got) == [("tt1", "unchanged", None), ("tt2", "modified", "title"), ("tt3", "added", None)]
    counts = {r.status: r.rows for r in C.compare_counts(C.compare(a, b, ["imdb_id"])).collect()}
    assert sum(counts.values()) == 3
    with pytest.raises(ValueError):
        C.compare(a, b, ["nothing"])


def test_url_managers(spark):
    schema = "id long, url_managers string, facebook_page string, twitter_handle string, tiktok_user string"
    rows = [(1, "Facebook | https://www.facebook.com/a/ | co\nfacebook|https://facebook.com/b\nTwitter|@x", "facebook.com/b", "https://x.com/y\n@x", "t")]
    got = {r.platform: r.status for r in C.url_manager_check(spark.createDataFrame(rows, schema), ["id"]).collect()}
    assert got == {"facebook": "OK", "twitter": "OK", "tiktok": "MISSING"}


def titles(spark):
    rows = [("tt0000001", "Example", "Example", "movie", 2000), ("tt0000002", "Shared Name", "Shared Name", "tvSeries", 2010), ("tt0000003", "Shared Name", "Other", "movie", 2024)]
    df = spark.createDataFrame(rows, "tconst string, primary string, original string, title_type string, start_year int")
    return df.withColumns({"pn": T.norm_lookup(F.col("primary")), "on": T.norm_lookup(F.col("original"))})


def test_lookup_ranks_and_auto(spark):
    q = spark.createDataFrame([("Shared Name",), ("nothing",), ("other!",)], "q string").withColumn("n", T.norm_lookup(F.col("q")))
    found = L.lookup_titles(q, titles(spark), query_id="q", query_norm="n", id_col="tconst", primary_norm="pn", original_norm="on", year_col="start_year")
    assert sorted(((r.q, r.tconst, r.match_rank, r.total_matches, r.status) for r in found.collect()), key=str) == [
        ("Shared Name", "tt0000002", 2, 2, "multiple_matches"), ("Shared Name", "tt0000003", 1, 2, "multiple_matches"), ("nothing", None, None, 0, "not_found"), ("other!", "tt0000003", 1, 1, "matched"),
    ]
    people = spark.createDataFrame([("nm0000001", "shared name")], "id string, norm string")
    person = L.lookup_people(q, people, query_id="q", query_norm="n", id_col="id", name_norm="norm", order=[F.col("id")]).select("q", "id", "match_rank", "status")
    auto = L.merge_auto(found.select("q", F.col("tconst").alias("id"), "match_rank", "status"), person, "q")
    three = [r for r in auto.collect() if r.q == "Shared Name"]
    assert [r.id for r in sorted(three, key=lambda r: r.match_rank)] == ["tt0000003", "tt0000002", "nm0000001"]
    assert {r.status for r in three} == {"multiple_matches"} and {r.resolved_lookup for r in three} == {"auto:title_to_id", "auto:person_to_id"}


def test_scores_prefer_kind_and_year(spark):
    q = spark.createDataFrame([("Shared Name", "movie", 2024)], "q string, kind string, year int").withColumn("n", T.norm_lookup(F.col("q")))
    got = L.scored_title_matches(q, titles(spark), query_id="q", query_norm="n", want_kind="kind", want_year="year", id_col="tconst", primary_norm="pn", original_norm="on", kind_col="title_type", year_col="start_year").orderBy("match_rank").collect()
    assert [(r.tconst, r.score) for r in got] == [("tt0000003", 226.0), ("tt0000002", 104.0)]
    status = L.match_status(spark.createDataFrame([r.asDict() for r in got]), "q").first()
    assert status.status == "found"


def test_lookup_plans_have_no_nested_loop(spark):
    q = spark.createDataFrame([("a", "a")], "q string, n string")
    plan = L.lookup_titles(q, titles(spark), query_id="q", query_norm="n", id_col="tconst", primary_norm="pn", original_norm="on", year_col="start_year")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_episodes_and_windows(spark):
    rows = [("tt1", 1, "2026-05-03"), ("tt1", 1, "2026-05-10"), ("tt1", 2, "2026-05-03"), ("tt2", 1, None), ("tt1", None, None), ("tt1", 0, None)]
    df = spark.createDataFrame(rows, "p string, s int, d string").withColumn("d", F.to_date("d"))
    got = {r.parent: (r.season_count, r.latest_season_number, r.latest_season_episode_count, r.episode_count) for r in L.episode_counts(df, parent="p", season="s").collect()}
    assert got == {"tt1": (2, 2, 1, 5), "tt2": (1, 1, 1, 1)}
    window = {r.p: (str(r.start_date), str(r.end_date)) for r in L.season_windows(df, parent="p", season="s", date="d").collect()}
    assert window["tt1"] == ("2026-05-03", "2026-06-02")


def test_freshness_and_verification(spark):
    cached = spark.createDataFrame([(1, "old", True, "2026-01-01"), (2, "fresh", True, "2026-04-30"), (3, "bad", False, "2026-01-01")], "k int, v string, ok boolean, checked_at string")
    live = spark.createDataFrame([(1, "x", False, "2026-05-01"), (2, "new", True, "2026-05-01"), (3, "good", True, "2026-05-01")], "k int, v string, ok boolean, checked_at string")
    at = lambda df: df.withColumn("checked_at", F.to_timestamp("checked_at"))
    got = {r.k: r.v for r in L.fresh_reference(at(cached), at(live), "k", F.to_timestamp(F.lit("2026-05-01")), 7).collect()}
    assert got == {1: "old", 2: "fresh", 3: "good"}


def test_resolve_lists_keeps_order_and_unknown_ids(spark):
    rows = spark.createDataFrame([(1, "2, 462,1,2")], "r int, l string")
    names = spark.createDataFrame([("1", "one"), ("2", "two")], "id string, name string")
    assert L.resolve_lists(rows, names, row_id="r", list_col="l", id_col="id", name_col="name").first().names == "two; 462; one; two"


def test_every_similar_pair_is_found(spark, monkeypatch):
    from itertools import combinations

    from tallyweave.functions import similarity as S

    monkeypatch.setattr(S, "BLOCK", 40)
    rng = random.Random(3)
    stems = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 14))) for _ in range(25)]
    names = {"catherine", "katherine", "a", "ab", "é", "x" * 70, "x" * 71, "y" + "x" * 70, "", *stems}
    while len(names) < 160:
        word = list(rng.choice(stems))
        word[rng.randrange(len(word))] = rng.choice("abcdefgh ")
        names.add("".join(word))
    pairs = D.fuzzy_pairs(spark.createDataFrame([(n,) for n in names] * 2 + [(None,)], "v string"), "v", 0.85).collect()
    want = {(a, b): S.jaro_winkler_of(a, b) for a, b in combinations(sorted(names - {""}), 2)}
    assert {(r.a, r.b): round(r.similarity, 12) for r in pairs} == {k: round(v, 12) for k, v in want.items() if v >= 0.85}
    assert ("catherine", "katherine") in {(r.a, r.b) for r in pairs} and len(pairs) == len({(r.a, r.b) for r in pairs})

    targets, entries = sorted(names - {""})[:90], sorted(names - {""})[70:]
    near = S.ratio_pairs(spark.createDataFrame([(n,) for n in targets], "t string"), spark.createDataFrame([(n,) for n in entries], "e string"), 0.85).collect()
    want = {(a, b): SequenceMatcher(None, a, b).ratio() for a in targets for b in entries}
    assert {(r.target, r.entry): r.score for r in near} == {k: v for k, v in want.items() if v >= 0.85}


def test_blocks_meet_only_where_lengths_allow_it(spark, monkeypatch):
    from tallyweave.functions import similarity as S

    monkeypatch.setattr(S, "BLOCK", 50)
    rng = random.Random(5)
    texts = sorted({"".join(rng.choices("abcdefghij", k=rng.randint(3, 60))) for _ in range(1500)})
    rows = spark.createDataFrame([(t,) for t in texts], "v string")
    units, dealt = S.make_units(S.kinds_of_text(rows))
    assert sum(r["count"] for r in dealt.groupBy("unit", "block").count().collect()) == len(texts)
    one, two = S.meet(dealt, dealt, S.unit_pairs(spark, units, units, lambda ratio, first: ratio >= (0.55 if not first else 0.25), True), True)
    blocks = sum(u.blocks for u in units)
    assert one.count() + two.count() < 0.9 * len(texts) * blocks
    # the order of the two texts can matter; pairs of blocks keep the smaller one first
    left, right = texts[::2], texts[1::2]
    got = {(a, b): v for a, b, v in S.near_jaro_winkler(left, right, 0.7)}
    want = {(min(a, b), max(a, b)): S.jaro_winkler_of(min(a, b), max(a, b)) for a in left for b in right}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= 0.7})
