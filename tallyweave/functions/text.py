"""Column helpers shared by all operators: blanks, normal forms, tokens, ids, URLs, dates."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

EDGES = r"(?U)^\s+|\s+$"
URL_FORM = (
    r"(?i)^(?:http|ftp)s?://(?:(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+(?:[a-z]{2,6}\.?|[a-z0-9-]{2,}\.?)"
    r"|localhost|\d{1,3}(?:\.\d{1,3}){3})(?::\d+)?(?:/?|[/?]\S+)\z"
)
NUMBER_FORM = r"^[+-]?(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?\z|^(?i)[+-]?(?:inf|infinity)\z"
ID_FORM = r"(?i)^(?:tt|nm)\d{7,}\z"

# Date shapes in the order in which they are tried.
DATE_FORMS = [
    (r"^\d{4}-\d{2}-\d{2}\z", "yyyy-MM-dd"),
    (r"^\d{8}\z", "yyyyMMdd"),
    (r"^\d{1,2}-\d{1,2}-\d{4}\z", "d-M-yyyy"),
    (r"^[A-Za-z]{3,9}-\d{1,2}-\d{4}\z", "MMMM-d-yyyy"),
    (r"^[A-Za-z]{3}-\d{1,2}-\d{4}\z", "MMM-d-yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}\z", "M-d-yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}\z", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}\z", "d/M/yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}\z", "yyyy/M/d"),
    (r"^[A-Za-z]{3,9} \d{1,2}, \d{4}\z", "MMMM d, yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}\z", "MMM d, yyyy"),
    (r"^\d{1,2} [A-Za-z]{3,9} \d{4}\z", "d MMMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}\z", "d MMM yyyy"),
]

# Spellings of one genre, after all but a-z and 0-9 became spaces.
GENRE_NAMES = {"scifi": "science fiction", "sci fi": "science fiction", "science fiction": "science fiction", "tv movie": "tv movie", "television movie": "tv movie"}
# Title kinds by their normalised spellings.
TITLE_KINDS = {"tvseries": "tvSeries", "tvminiseries": "tvMiniSeries", "tvepisode": "tvEpisode", "tvspecial": "tvSpecial", "tvmovie": "tvMovie", "podcastepisode": "podcastEpisode", "podcastseries": "podcastSeries"}
# What requests call kinds of titles.
REQUEST_KINDS = TITLE_KINDS | {"movie": "movie", "series": "tvSeries", "episode": "tvEpisode"}


def text(c: Column) -> Column:
    """A value as text, trimmed of Unicode white space; null is empty."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), EDGES, "")


def is_blank(c: Column) -> Column:
    return text(c) == ""


def norm_value(c: Column, ignore_case: bool = True) -> Column:
    return F.lower(text(c)) if ignore_case else text(c)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def norm_lookup(c: Column) -> Column:
    """Lower case, & as and, all but a-z and 0-9 as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), "&", " and "), "[^a-z0-9]+", " "))


def norm_title(c: Column) -> Column:
    """As ``norm_lookup``, without a " - dar" ending and bracketed parts."""
    bare = F.regexp_replace(F.regexp_replace(text(c), r"(?i)\s+-\s+dar\z", ""), r"\([^)]*\)", " ")
    return norm_lookup(bare)


def loosely_equal(a: Column, b: Column) -> Column:
    """Normalised titles are equal or one holds the other; empty ones match nothing."""
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def tokens(c: Column) -> Column:
    """The set of lower-case words of letters and digits of any script."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def number(c: Column) -> Column:
    """The number a cell holds, or null; text must be a number as a whole."""
    value = text(c)
    return F.when(value.rlike(NUMBER_FORM), F.regexp_replace(value, "_", "").try_cast("double"))


def date(c: Column) -> Column:
    """The date a cell holds by the first shape that fits, or null."""
    value = text(c)
    return F.coalesce(*[F.when(value.rlike(shape), F.try_to_date(value, form)) for shape, form in DATE_FORMS])


def first_year(c: Column) -> Column:
    """First run of exactly four digits as a word, as int, or null."""
    found = F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), r"\b(\d{4})\b", 1)
    return F.when(found != "", found.cast("int"))


def title_id(c: Column) -> Column:
    found = F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)\b((?:tt|nm)\d{7,})", 1))
    return F.when(found != "", found)


def item_id(c: Column) -> Column:
    found = F.upper(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)\b(q\d+)\b", 1))
    return F.when(found != "", found)


def wiki_slug(c: Column) -> Column:
    found = F.regexp_extract(F.coalesce(c, F.lit("")), r"/wiki/([^?#]+)", 1)
    return F.when(found != "", F.regexp_replace(F.try_url_decode(found), "_", " "))


def multi_values(c: Column) -> Column:
    """Parts of a cell with several values."""
    parts = F.transform(F.split(F.coalesce(c.cast("string"), F.lit("")), r"[,;/|\n]+"), lambda x: F.regexp_replace(x, EDGES, ""))
    return F.filter(parts, lambda x: x != "")


def line_set(c: Column) -> Column:
    """Distinct trimmed lines in order."""
    lines = F.transform(F.split(F.coalesce(c.cast("string"), F.lit("")), "\n"), lambda x: F.regexp_replace(x, EDGES, ""))
    return F.array_sort(F.array_distinct(F.filter(lines, lambda x: x != "")))


def renamed(c: Column, names: dict[str, str]) -> Column:
    """A value by a small table of names; others stay."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), c)


def genre(c: Column) -> Column:
    return renamed(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " ")), GENRE_NAMES)


def title_kind(c: Column, names: dict[str, str] = TITLE_KINDS) -> Column:
    """A title's kind in the datasets' spelling; unknown kinds stay as they are."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.regexp_replace(norm_lookup(c), " ", "")), text(c))


def host(c: Column) -> Column:
    """Lower-case host of a URL without www. and m."""
    found = F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^@/?#]*@)?([^:/?#]*)", 1))
    return F.regexp_replace(found, r"^(?:www\.|m\.)+", "")


def path(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)


def canonical_url(c: Column) -> Column:
    """https, bare host, no query, fragment or trailing slash; what isn't a URL gives null."""
    return F.when(host(c) != "", F.concat(F.lit("https://"), host(c), F.regexp_replace(path(c), r"/+\z", "")))


def segments(c: Column) -> Column:
    return F.filter(F.split(path(c), "/"), lambda x: x != "")


def handle(c: Column) -> Column:
    """The account name in a profile URL: first path segment without @, or null."""
    return F.regexp_replace(F.try_element_at(segments(c), F.lit(1)), "^@", "")


def blocked_page_path(c: Column) -> Column:
    """A page URL with a path segment that names no account."""
    return F.arrays_overlap(F.transform(segments(c), F.lower), F.array(*[F.lit(x) for x in ("p", "page", "pages", "php", "profile.php")]))


def valid_url(c: Column) -> Column:
    return c.rlike(URL_FORM)


def valid_title_id(c: Column) -> Column:
    return c.rlike(ID_FORM)


def valid_date_shape(c: Column) -> Column:
    return c.rlike(r"^\d{4}(?:[-/]\d{2}[-/]\d{2})?\z")


def grade(score: Column) -> Column:
    return banded(score, [(90, "A"), (80, "B"), (70, "C"), (60, "D")], "F")


def confidence_label(score: Column) -> Column:
    return banded(score, [(80, "Very High"), (65, "High"), (50, "Medium"), (35, "Low")], "Very Low")


def banded(score: Column, bands: list[tuple[float, str]], other: str) -> Column:
    """The label of the first band whose floor the score reaches."""
    first, *rest = bands
    return reduce(lambda case, band: case.when(score >= band[0], band[1]), rest, F.when(score >= first[0], first[1])).otherwise(other)


def stable_id(c: Column) -> Column:
    return F.substring(F.sha1(F.coalesce(c, F.lit("")).cast("binary")), 1, 12)


def shorten(c: Column, n: int = 240) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def display_date(c: Column) -> Column:
    """ISO dates as dd-MM-yyyy; "-" and blanks as empty; other text stays."""
    value = text(c)
    iso = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.date_format(F.try_to_date(value, "yyyy-MM-dd"), "dd-MM-yyyy"))
    return F.when(value.isin("", "-"), "").otherwise(F.coalesce(iso, value))


def search_words(c: Column, stop: tuple[str, ...] = ("official", "site", "or", "and", "the")) -> Column:
    """A search request without quotes, site: terms, bracketed and stop words."""
    words = F.split(squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), '"', " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~F.lower(w).isin(*stop) & ~F.lower(w).startswith("site:") & ~w.rlike(r"^[(\[].*[)\]]$")), " ")


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for equal texts, 0 if one is empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1.0 - F.levenshtein(a, b) / longer)


# What a bare reference may look like on each platform, and the address it stands for.
REFERENCE_URLS = {
    "facebook": (r".+", "https://www.facebook.com/", ""),
    "twitter": (r"[A-Za-z0-9_]{1,15}", "https://x.com/", ""),
    "instagram": (r"[A-Za-z0-9._]{1,30}", "https://www.instagram.com/", "/"),
    "tiktok": (r"[A-Za-z0-9._]{1,50}", "https://www.tiktok.com/@", ""),
    "wikidata": (r"Q\d+", "https://www.wikidata.org/wiki/", ""),
}


def reference_url(platform: str, value: Column) -> Column:
    """The address that a handle, id or page name of a platform means; addresses stay, null where the form doesn't fit."""
    v = text(value)
    handle = F.regexp_replace(v, r"^[@/]+", "") if platform == "facebook" else F.regexp_replace(F.regexp_replace(v, "^@+", ""), r"^/+|/+\z", "")
    if platform == "youtube":
        channel = F.when(v.startswith("@"), F.concat(F.lit("https://www.youtube.com/"), F.regexp_replace(v, r"^/+|/+\z", "")))
        made = channel.when(v.rlike(r"^[A-Za-z0-9._-]{1,100}\z"), F.concat(F.lit("https://www.youtube.com/@"), v))
    elif platform == "wikipedia":
        # a name in a path: spaces are underscores, and slashes stay
        made = F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace(F.replace(F.url_encode(F.replace(v, F.lit(" "), F.lit("_"))), F.lit("%2F"), F.lit("/")), F.lit("*"), F.lit("%2A")))
    elif platform == "imdb":
        made = F.when(v.rlike(r"^tt\d{7,}\z"), F.concat(F.lit("https://www.imdb.com/title/"), v, F.lit("/"))).when(v.rlike(r"^nm\d{7,}\z"), F.concat(F.lit("https://www.imdb.com/name/"), v, F.lit("/")))
    elif platform in REFERENCE_URLS:
        form, before, after = REFERENCE_URLS[platform]
        bare = F.upper(v) if platform == "wikidata" else handle
        made = F.when(bare.rlike(rf"^(?:{form})\z"), F.concat(F.lit(before), bare, F.lit(after)))
    else:
        raise ValueError(f"unknown platform: {platform}")
    return F.when(v == "", None).when(F.lower(v).rlike("^https?://"), v).otherwise(made)


@F.pandas_udf(StringType())
def ascii_letters(texts: pd.Series) -> pd.Series:
    """Text without accents (compatibility decomposition) and without what is not ASCII after that."""
    return pd.Series([None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts], dtype=object)
