"""Rule validation: declarative checks compiled to columns, evaluated in one scan.

``validate(df, rules)`` returns one row per failed check:
sheet, row_num, column, rule, finding_category, confidence, confidence_reason,
message, value.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as T

ISSUE_COLUMNS = ["sheet", "row_num", "column", "rule", "finding_category", "confidence", "confidence_reason", "message", "value"]


@dataclass
class Condition:
    column: str
    operator: str
    value: str | None = None
    values: list = field(default_factory=list)
    ignore_case: bool = True


@dataclass
class Rule:
    column: str
    check: str
    name: str = ""
    sheet: str = "*"
    message: str | None = None
    value: object = None
    values: list = field(default_factory=list)
    tokens: list = field(default_factory=list)
    pattern: str | None = None
    min_value: float | None = None
    max_value: float | None = None
    platform: str | None = None
    ignore_case: bool = True
    when: list[Condition] = field(default_factory=list)


#: What a check can't do without.
NEEDED = {"not_blank_and_not_in": "tokens", "equals": "value", "not_equals": "value", "in": "values", "regex": "pattern", "min": "value", "max": "value", "between": "min_value", "contains": "value", "contains_any": "values", "url_not_contains_if_present": "tokens", "talent_subcategory_format": "tokens", "social_reference_format": "platform"}

#: Checks against reference tables, run by the functions given as ``refs`` (see ``references.table_checks``).
REFERENCE_CHECKS = [
    "social_reference_reachable", "reference_lookup_match", "movie_us_release_date_match", "movie_release_type_match", "movie_genre_match", "rottentomatoes_url_match",
    "genre_taxonomy_audit", "date_cross_check", "network_platform_audit", "wikipedia_url_audit", "imdb_url_audit",
]

CHECKS: dict[str, Callable[[Column, Rule, datetime.date], tuple[Column, Column]]] = {}


def register_check(name: str, function: Callable[[Column, Rule, datetime.date], tuple[Column, Column]]) -> None:
    """Add a check: (value, rule, today) -> (passes, default message)."""
    CHECKS[name] = function


def parse_rules(source: str | list | dict) -> list[Rule]:
    """Rules from JSON: a list, or an object with ``rules``; missing arguments are errors."""
    data = json.loads(source) if isinstance(source, str) else source
    data = data["rules"] if isinstance(data, dict) else data
    if not isinstance(data, list):
        raise ValueError("rules must be a list")
    known, rules = {f.name for f in fields(Rule)}, []
    for item in data:
        rule = Rule(**{k: v for k, v in item.items() if k in known and k != "when"}, when=[Condition(**c) for c in item.get("when", [])])
        if rule.check not in {"unique", *REFERENCE_CHECKS, *CHECKS}:
            raise ValueError(f"unknown check: {rule.check}")
        need = NEEDED.get(rule.check)
        if need and getattr(rule, need) in (None, [], ""):
            raise ValueError(f"{rule.check} on {rule.column} needs {need}")
        rules.append(rule)
    return rules


def _plain(name: str, passes: Callable[[Column, Rule], Column], says: Callable[[Rule], str]):
    register_check(name, lambda c, r, _: (passes(c, r), F.lit(says(r))))


def _norm(x, ignore_case: bool) -> str:
    x = "" if x is None else str(x).strip()
    return x.lower() if ignore_case else x


def _filled_and(c: Column, r: Rule, test: Callable[[Column], Column]) -> Column:
    value = T.norm_value(c, r.ignore_case)
    return (value != "") & test(value)


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _norms(items: list, r) -> list[str]:
    return [_norm(x, r.ignore_case) for x in items]


_plain("required", lambda c, r: ~T.is_blank(c), lambda r: f"{r.column} is required.")
_plain("not_blank_and_not_in", lambda c, r: _filled_and(c, r, lambda v: ~v.isin(_norms(r.tokens, r))), lambda r: f"{r.column} cannot be blank or use placeholder values.")
_plain("equals", lambda c, r: T.norm_value(c, r.ignore_case) == _norm(r.value, r.ignore_case), lambda r: f"{r.column} must equal {r.value!r}.")
_plain("not_equals", lambda c, r: T.norm_value(c, r.ignore_case) != _norm(r.value, r.ignore_case), lambda r: f"{r.column} must not equal {r.value!r}.")
_plain("in", lambda c, r: _filled_and(c, r, lambda v: v.isin(_norms(r.values, r))), lambda r: f"{r.column} must match one of the allowed values.")
_plain("regex", lambda c, r: (T.text(c) != "") & T.text(c).rlike(f"^(?:{r.pattern})\\z"), lambda r: f"{r.column} does not match the expected format.")
_plain("min", lambda c, r: F.coalesce(T.number(c) >= float(r.value), F.lit(False)), lambda r: f"{r.column} must be at least {r.value}.")
_plain("max", lambda c, r: F.coalesce(T.number(c) <= float(r.value), F.lit(False)), lambda r: f"{r.column} must be at most {r.value}.")
_plain("between", lambda c, r: F.coalesce(T.number(c).between(r.min_value, r.max_value), F.lit(False)) if r.max_value is not None else F.lit(False), lambda r: f"{r.column} must be between {r.min_value} and {r.max_value}.")
_plain("contains", lambda c, r: _filled_and(c, r, lambda v: v.contains(_norm(r.value, r.ignore_case))), lambda r: f"{r.column} must contain {r.value!r}.")
_plain("contains_any", lambda c, r: _filled_and(c, r, lambda v: _any([v.contains(x) for x in _norms(r.values, r)])), lambda r: f"{r.column} must contain one of the required values.")
_plain("talent_subcategory_format", lambda c, r: _filled_and(c, r, lambda v: v.contains(_norms(r.tokens, r)[0]) & _any([v.contains(x) for x in _norms(r.tokens, r)[1:]])), lambda r: f"{r.column} must include gender and talent type or subtype.")
register_check("date_not_past", lambda c, r, today: (F.coalesce(T.date(c) >= F.lit(today), F.lit(False)), F.lit(f"{r.column} cannot be earlier than today.")))
register_check("date_not_future", lambda c, r, today: (F.coalesce(T.date(c) <= F.lit(today), F.lit(False)), F.lit(f"{r.column} cannot be later than today.")))


def _url_tokens(c: Column, r: Rule, _) -> tuple[Column, Column]:
    value = T.norm_value(c, r.ignore_case)
    if r.column == "facebook_page":
        blocked = T.blocked_page_path(T.text(c))
    else:
        blocked = _any([value.contains(x) for x in _norms(r.tokens, r)])
    says = F.lit(r.message or f"{r.column} contains a blocked URL pattern.")
    if r.column == "youtube_channel_username":
        says = F.when(value.contains("%7"), "Remove %7 and add filter that we called pipe.").when(value.contains("%20"), "There is a syntax error in the URL. Please correct it by removing '%20' and replacing it with a space.").otherwise(says)
    return (value == "") | ~blocked, says


register_check("url_not_contains_if_present", _url_tokens)

# What one reference may look like on each platform; URLs are matched without scheme, www. and m.
SOCIAL_FORMS = {
    "facebook": r"(?:@?[A-Za-z0-9.]{2,}|facebook\.com/(?!p/|pages?/|profile\.php|groups/|watch|events/|posts/)[A-Za-z0-9.\-]+/?)",
    "instagram": r"(?:@?[A-Za-z0-9._]{1,30}|instagram\.com/(?!p/|reel/|reels/|explore/|stories/)[A-Za-z0-9._]+/?)",
    "twitter": r"(?:@?[A-Za-z0-9_]{1,15}|(?:twitter|x)\.com/(?!i/|home|search|hashtag/|intent/)[A-Za-z0-9_]{1,15}/?)",
    "tiktok": r"(?:@?[A-Za-z0-9._]{2,24}|tiktok\.com/@[A-Za-z0-9._]+/?)",
    "youtube": r"(?:@?[A-Za-z0-9._\- ]{2,}|youtube\.com/(?:@[A-Za-z0-9._\-]+|channel/[A-Za-z0-9_\-]+|c/[^/\s]+|user/[^/\s]+)/?)",
    "wikipedia": r"(?:[^/:\n]{2,}|(?:[a-z\-]+\.)?wikipedia\.org/wiki/[^\s?#]+)",
    "wikidata": r"(?i:q\d+|wikidata\.org/wiki/q\d+)",
    "imdb": r"(?i:(?:tt|nm)\d{7,}|imdb\.com/(?:title|name)/(?:tt|nm)\d{7,}/?)",
}


def reference_entries(c: Column) -> Column:
    """The references in a cell: its URLs if there are two or more, else its separated parts."""
    cell = F.coalesce(c.cast("string"), F.lit(""))
    urls = F.regexp_extract_all(cell, F.lit(r"(https?://[^\s,;|]+)"), F.lit(1))
    parts = F.filter(F.transform(F.split(cell, r"[\n,;|]+"), lambda x: F.regexp_replace(x, T.EDGES, "")), lambda x: x != "")
    return F.when(F.size(urls) > 1, urls).otherwise(parts)


def _social_form(c: Column, r: Rule, _) -> tuple[Column, Column]:
    entries = reference_entries(c)
    form = SOCIAL_FORMS[r.platform]
    bare = lambda x: F.regexp_replace(x, r"^(?i)https?://(?:www\.|m\.)?", "")
    bad = F.filter(F.transform(entries, lambda x, i: F.struct((i + 1).alias("i"), x.alias("x"))), lambda e: ~bare(e["x"]).rlike(f"^(?:{form})\\z") | e["x"].rlike(r"\p{Cntrl}"))
    detail = F.concat(F.lit("entry "), F.try_element_at(bad, F.lit(1))["i"].cast("string"), F.lit(": invalid "), F.lit(r.platform), F.lit(" reference"))
    says = F.concat(F.lit((r.message or f"{r.column} has an invalid format.") + " ("), detail, F.lit(")"))
    return (F.size(entries) > 0) & (F.size(bad) == 0), F.when(F.size(bad) > 0, says).otherwise(r.message or f"{r.column} has an invalid format.")


register_check("social_reference_format", _social_form)


def condition(df: DataFrame, c: Condition) -> Column:
    """A ``when`` condition as a boolean column."""
    column = F.col(f"`{resolve(df, c.column)}`")
    value, given = T.norm_value(column, c.ignore_case), _norm(c.value, c.ignore_case)
    tests = {
        "blank": lambda: T.is_blank(column), "not_blank": lambda: ~T.is_blank(column),
        "equals": lambda: value == given, "not_equals": lambda: value != given,
        "in": lambda: value.isin(_norms(c.values, c)), "not_in": lambda: ~value.isin(_norms(c.values, c)),
        "endswith": lambda: value.endswith(given), "not_endswith": lambda: ~value.endswith(given),
        "contains": lambda: value.contains(given),
    }
    if c.operator not in tests:
        raise ValueError(f"unknown condition: {c.operator}")
    return tests[c.operator]()


def resolve(df: DataFrame, name: str, aliases: dict[str, str] | None = None) -> str | None:
    """The column that a rule means: by name or alias, in any case."""
    names = {c.casefold(): c for c in df.columns}
    for display, canonical in (aliases or {}).items():
        if canonical.casefold() == name.casefold() and display.casefold() in names:
            return names[display.casefold()]
    if name.casefold() not in names:
        raise ValueError(f"no column {name!r}")
    return names[name.casefold()]


# Words in a message, category, confidence and reason, in order; the first that fits holds.
FINDINGS = [
    (("fan page", "fanpage"), "Fan Page Detected", "High", "Page content or attributes indicate this is a fan page, not an official account."),
    (("friends instead of followers",), "Suspected Incorrect", "High", "Profile shows friends count instead of followers, suggesting a personal timeline rather than an official page."),
    (("blocked url pattern", "cannot contain"), "Suspected Incorrect", "High", "The URL format contains path segments reserved for personal timelines or page setup templates."),
    (("404",), "No Official Presence Found", "High", "The social link returns HTTP 404 Not Found, indicating the account does not exist or has been deleted."),
    (("forbidden", "403"), "Unable to Verify", "Low", "Access to the profile is restricted or geoblocked (HTTP 403 Forbidden)."),
    (("timeout", "connect"), "Unable to Verify", "Low", "The server timed out or failed to connect while verifying the account."),
    (("does not appear related to title",), "Suspected Incorrect", "Medium", "The profile is reachable but its content does not match the title name."),
    (("unable to verify",), "Unable to Verify", "Low", "Validation check failed to verify the profile authenticity due to restricted access or missing metadata."),
    (("is required",), "Needs Manual Review", "High", "Field is required according to rules but is currently blank."),
    (("must match one of the allowed values", "approved list"), "Suspected Incorrect", "High", "Cell value is not in the list of approved classification tags."),
    (("genre_mismatch",), "Suspected Incorrect", "High", "Genre array does not align with IMDb/TMDB genre classifications."),
    (("date_mismatch",), "Suspected Incorrect", "High", "Release date year does not match official premiere or release timelines."),
    (("network_mismatch",), "Suspected Incorrect", "High", "Network or distributor does not match TMDB network/production data."),
    (("wikipedia_mismatch",), "Suspected Incorrect", "High", "Wikipedia URL resolves to a page whose title does not match this entity."),
    (("imdb_mismatch",), "Suspected Incorrect", "High", "IMDb record title does not match this entity."),
    (("format_error",), "Formatting Error", "High", "The value does not conform to the expected format (e.g. trailing newlines, invalid URL/date format)."),
    (("placeholder",), "Placeholder Found", "High", "The field contains a placeholder or blank space instead of actual metadata."),
    (("missing_wikipedia",), "Missing Data", "High", "Wikipedia URL is missing or empty."),
    (("missing_imdb",), "Missing Data", "High", "IMDb ID is missing or empty."),
]


def finding(message: Column) -> Column:
    """struct(finding_category, confidence, confidence_reason) of a message."""
    said = F.lower(message)
    make = lambda *x: F.struct(*[F.lit(v).alias(n) for v, n in zip(x, ("finding_category", "confidence", "confidence_reason"), strict=True)])
    cases = [F.when(_any([said.contains(w) for w in words]), make(*rest)) for words, *rest in FINDINGS]
    return F.coalesce(*cases, make("Suspected Incorrect", "High", ""))


# Which checks each review mode keeps.
SOCIAL_COLUMNS = ("facebook_page", "instagram", "twitter", "tiktok", "youtube_channel_username", "wikipedia_url", "imdb_id")


def select_rules(rules: list[Rule], modes: set[str] = frozenset({"full"}), platforms: set[str] | None = None) -> list[Rule]:
    """The rules that review modes and platforms keep; ``missing_only`` and ``existing_qa`` also gate rows."""
    if "full" in modes or not modes - {"missing_only", "existing_qa", "duplicate_conflict"}:
        kept = list(rules)
    else:
        social = lambda r: r.platform is not None or r.column in SOCIAL_COLUMNS
        kept = [r for r in rules if {"social_only", "platform_specific"} & modes and social(r) or "categorization" in modes and ("categor" in r.column.lower() or "genre" in r.column.lower())]
    if platforms:
        kept = [r for r in kept if r.platform in platforms or any(p in r.column for p in platforms)]
    return kept


def validate(df: DataFrame, rules: list[Rule], *, modes: set[str] = frozenset({"full"}), platforms: set[str] | None = None, today: datetime.date | None = None, sheet: str = "sheet", row_col: str = "row_num", aliases: dict[str, str] | None = None, refs: dict[str, Callable[[DataFrame, Rule], DataFrame]] | None = None) -> DataFrame:
    """All issues of a table; rows without a filled cell are skipped.

    Row checks share one scan and no shuffle.  ``unique`` rules share one count of
    values: they are unpivoted, counted map-side and met with those that occur
    twice; blank values are left out before that.  A rule for any sheet is
    skipped where the sheet lacks its columns; a rule for this sheet fails.
    ``refs`` holds for reference checks a function (rows, rule) that returns
    (row_num, message, value) of failures; checks without one are skipped, as
    are look-ups whose source is unavailable.
    """
    today = today or datetime.date.today()
    rules = [r for r in select_rules(rules, modes, platforms) if r.sheet in ("*", sheet)]
    data = [c for c in df.columns if c != row_col]
    active = df.filter(_any([~T.is_blank(F.col(f"`{c}`")) for c in data]))
    checks, unique, joined = [], [], []
    for rule in rules:
        try:
            column = F.col(f"`{resolve(df, rule.column, aliases)}`")
            gate = reduce(lambda a, b: a & b, [condition(df, c) for c in rule.when], F.lit(True))
        except ValueError:
            if rule.sheet == "*":
                continue
            raise
        if "missing_only" in modes and "full" not in modes:
            gate = gate & T.is_blank(column)
        if "existing_qa" in modes and "full" not in modes:
            gate = gate & ~T.is_blank(column)
        name = F.lit(rule.name or rule.check)
        if rule.check == "unique":
            value = T.norm_value(column, rule.ignore_case)
            says = rule.message or f"{rule.column} must be unique."
            unique.append(F.when(gate & (value != ""), F.struct(F.lit(rule.column).alias("column"), name.alias("rule"), F.lit(says).alias("message"), column.cast("string").alias("value"), value.alias("key"), F.lit(len(unique)).alias("n"))))
            continue
        if rule.check in REFERENCE_CHECKS:
            if rule.check in (refs or {}):
                failed = refs[rule.check](active.filter(gate), rule)
                joined.append(failed.select(F.col(row_col).cast("long").alias("row_num"), F.lit(rule.column).alias("column"), name.alias("rule"), "message", F.col("value").cast("string").alias("value")))
            continue
        passes, says = CHECKS[rule.check](column, rule, today)
        says = F.lit(rule.message) if rule.message and rule.check not in ("url_not_contains_if_present", "social_reference_format") else says
        checks.append(F.when(gate & ~passes, F.struct(F.lit(rule.column).alias("column"), name.alias("rule"), says.alias("message"), column.cast("string").alias("value"))))
    parts = joined
    if checks:
        # one scan for all; arrays of some twenty checks stay within one generated method
        found = [F.filter(F.array(*checks[i : i + 20]), lambda x: x.isNotNull()) for i in range(0, len(checks), 20)]
        parts.append(active.select(F.col(row_col).cast("long").alias("row_num"), F.inline(F.concat(*found))))
    if unique:
        found = F.filter(F.array(*unique), lambda x: x.isNotNull())
        each = active.select(F.col(row_col).cast("long").alias("row_num"), F.inline(found))
        # counted map-side, so that a common value doesn't gather in a task
        often = each.groupBy("n", "key").agg(F.count("*").alias("times")).filter("times > 1").select("n", "key")
        parts.append(each.join(often, ["n", "key"], "left_semi").select("row_num", "column", "rule", "message", "value"))
    if not parts:
        raise ValueError("no rule applies")
    issues = reduce(DataFrame.unionByName, parts)
    return issues.withColumn("f", finding(F.col("message"))).select(F.lit(sheet).alias("sheet"), "row_num", "column", "rule", "f.*", "message", "value").select(*ISSUE_COLUMNS)


def clean_rows(df: DataFrame, issues: DataFrame, row_col: str = "row_num") -> DataFrame:
    return df.join(issues.select(F.col("row_num").alias(row_col)).distinct(), row_col, "left_anti")


def flagged_rows(df: DataFrame, issues: DataFrame, row_col: str = "row_num") -> DataFrame:
    return df.join(issues.select(F.col("row_num").alias(row_col)).distinct(), row_col, "left_semi")


def run_metrics(issues: DataFrame) -> DataFrame:
    """Issues and flagged rows per sheet and rule, with totals (null rule, null sheet)."""
    return issues.rollup("sheet", "rule").agg(F.count("*").alias("issues"), F.count_distinct("row_num").alias("flagged_rows"))


PASSED = "All checks passed."


def passed_row(issues: DataFrame) -> DataFrame:
    """A single row, with the columns of issues, that says that all checks passed."""
    one = issues.sparkSession.range(1)
    return one.select(*[F.lit(PASSED if c == "message" else None).cast(t).alias(c) for c, t in issues.dtypes])


def with_passed_row(issues: DataFrame, spark_range: DataFrame) -> DataFrame:
    """The issues, or a single row that says that all checks passed; the checks run twice (see :func:`write_issues`)."""
    none = passed_row(issues).join(issues.limit(1).select(F.lit(1).alias("some")), F.lit(True), "left").filter("some IS NULL").drop("some")
    return issues.unionByName(none)


def write_issues(issues: DataFrame, path: str) -> int:
    """Write the issues as Parquet in one pass over the checks, or the row that says that all passed; returns their number."""
    watch = Observation("issues")
    issues.observe(watch, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    found = watch.get["n"]
    if not found:
        passed_row(issues).write.mode("append").parquet(path)
    return found
