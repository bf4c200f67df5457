"""Rows from HTML pages: release calendars, charts, box office, page identity."""

from __future__ import annotations

import html as html_lib
import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Month names and the pattern of a date in a heading.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DATE_IN_TEXT = rf"(?i)\b({MONTHS})\s+(\d{{1,2}})(?:,?\s+(\d{{4}}))?"
RENT_BUY = ["rent/buy", "rent / buy", "rent or buy", "vod"]


REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def unescape(c: Column, strict: bool = False) -> Column:
    """Character references decoded, as the HTML standard says; the names are those of the standard library's table.

    With ``strict`` a reference counts only with its semicolon, as in XML; others stay as they are.
    """
    reference = REFERENCE.replace(";?", ";") if strict else REFERENCE
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    # names that count without a semicolon, the longest first, and what numbers below 160 stand for
    bare = "^&(" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"
    low = F.from_json(F.lit(json.dumps([html_lib.unescape(f"&#{n};") for n in range(160)])), "array<string>")

    def character(number: Column) -> Column:
        gone = number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(0xFFFE) == 0xFFFE)
        plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return F.when(number.isNull() | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), "\ufffd").when(number < 160, F.get(low, number.cast("int"))).when(gone, "").otherwise(plain)

    def decoded(ref: Column) -> Column:
        digits = F.regexp_replace(F.regexp_replace(ref, "^&#[xX]?0*|;$", ""), "^$", "0")  # nine digits are beyond every character
        number = F.when(F.length(digits) < 10, F.when(ref.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits)).cast("long")
        prefix = F.regexp_extract(ref, bare, 1)
        named = ref if strict else F.when(prefix != "", F.concat(F.try_element_at(names, prefix), F.substring(ref, F.length(prefix) + 2, F.length(ref)))).otherwise(ref)
        return F.when(ref.startswith("&#"), character(number)).otherwise(F.coalesce(F.try_element_at(names, F.substring(ref, F.lit(2), F.length(ref))), named))

    def whole(text: Column) -> Column:
        between, refs = F.split(text, reference, -1), F.transform(F.regexp_extract_all(text, F.lit(reference), F.lit(0)), decoded)
        return F.when(text.contains("&"), F.array_join(F.zip_with(between, refs, lambda x, ref: F.concat(x, F.coalesce(ref, F.lit("")))), "")).otherwise(text)

    return F.get(F.transform(F.array(c), whole), F.lit(0))  # the text is worked out once


# The characters of Windows-1252 that Latin-1 lacks, and the Latin-1 characters of the same bytes.
ONLY_1252 = {bytes([n]).decode("cp1252"): chr(n) for n in range(0x80, 0xA0) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def repair_mojibake(c: Column | str) -> Column:
    """UTF-8 that was read as Latin-1 or Windows-1252, read again; other text stays.

    Built-in functions only: a Python function on decoded references is one that Spark
    at times leaves in the plan, where it can't be run.
    """
    special = "".join(ONLY_1252)

    def read_again(text: Column) -> Column:
        raw = F.encode(F.translate(text, special, "".join(ONLY_1252.values())), "ISO-8859-1").cast("string")
        return F.when(F.is_valid_utf8(raw), raw)

    def mend(t: Column) -> Column:
        by_1252 = F.when(~t.rlike(rf"[^\x00-\x7f\u00a0-\u00ff{special}]"), read_again(t))
        by_latin = F.when(~t.rlike(r"[^\x00-\u00ff]"), read_again(t))
        return F.when(t.rlike("Ã|Â|â€"), F.coalesce(by_1252, by_latin, t)).otherwise(t)

    return F.get(F.transform(F.array(c), mend), F.lit(0))  # the text is worked out once


def plain_text(c: Column, lines: bool = False) -> Column:
    """HTML without tags, references decoded; line breaks become spaces or, on request, stay as lines."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<shortcode[^>]*>.*?</shortcode>|<img[^>]*>|<script.*?</script>|<style.*?</style>", "")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n" if lines else " ")
    c = unescape(F.regexp_replace(c, r"(?s)<[^>]+>", ""))
    edges = r"(?U)^[\s\-]+|[\s\-]+$"
    if not lines:
        return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), edges, "")
    each = F.transform(F.split(c, r"\r?\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), edges, ""))
    return F.filter(each, lambda x: x != "")


def visible_text(c: Column) -> Column:
    return plain_text(c)


def page_blocks(pages: DataFrame, pattern: str, page_id: str, html: str) -> DataFrame:
    """The parts of each page that a pattern finds, numbered in page order."""
    return pages.select(page_id, F.posexplode(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(pattern), F.lit(0))).alias("pos", "block"))


def carried(value: Column, page_id: str) -> Column:
    """The last value before or at a block of the page that isn't null."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(page_id).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))


def rolled_dates(rows: DataFrame, page_id: str, base_year: str) -> DataFrame:
    """Add ``release_date``: month, day and optional year in page order, years rolling over.

    Without an explicit year, a date before the last one by six months or more
    (or January after December) is in the next year.  As the last one has the
    year that a row would have, month and day alone tell whether the year rolls
    over: a row's year is the last explicit one (or the first row's ``base_year``) and
    the number of times it rolled over since, running counts of the page.  Only
    pages with a 29 February without a year are folded, as what
    follows depends on whether there is such a day.
    """
    order = Window.partitionBy(page_id).orderBy("pos")
    run, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    number = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS.lower().split("|")) for x in (m, i + 1)])
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # of one order, so that windows share a pass
    new = {n: f"__{n}" for n in ("m", "d", "y", "seen", "base", "leap", "last", "turns", "days", "from")}
    c = lambda n: F.col(new[n])
    day = lambda year, month, day: F.to_date(F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0.0)))
    said = F.coalesce(F.col("year").cast("string"), F.lit("")) != ""
    given = rows.withColumns({new["m"]: F.try_element_at(number, F.lower("month")), new["d"]: F.col("day").try_cast("int"), new["y"]: F.when(said, F.col("year").cast("string").try_cast("int"))})
    # a day that exists: in its year, or in any year that isn't a leap year
    known = day(F.coalesce(c("y"), F.lit(2001)), c("m"), c("d")).isNotNull() & (~said | c("y").isNotNull())
    given = given.withColumn(new["seen"], F.when(known, F.struct(c("m").alias("m"), c("d").alias("d"))))
    marked = given.withColumns({
        new["base"]: F.first(F.col(base_year)).over(run), new["leap"]: F.max(F.coalesce(~said & (c("m") == 2) & (c("d") == 29), F.lit(False))).over(whole), new["last"]: F.last(c("seen"), ignorenulls=True).over(before),
    })
    over = c("y").isNull() & c("seen").isNotNull() & (c("seen") < c("last")) & (c("last")["m"] - c("m") >= 6)
    # only pages with a 29 February without a year keep their days for the fold
    days = F.when(c("leap"), F.struct(c("m").alias("m"), c("d").alias("d"), c("y").alias("y"), said.alias("said")))
    counted = marked.withColumns({new["turns"]: F.sum(F.coalesce(over.cast("int"), F.lit(0))).over(run), new["days"]: F.collect_list(days).over(run)})
    held = F.last(F.when(c("seen").isNotNull() & c("y").isNotNull(), F.struct(c("y").alias("y"), c("turns").alias("t"))), ignorenulls=True).over(run)
    found = counted.withColumn(new["from"], held)
    year = F.when(c("from").isNotNull(), c("from")["y"] + c("turns") - c("from")["t"]).otherwise(c("base").cast("int") + c("turns"))
    date = F.when(c("leap"), folded_date(c("days"), c("base"), day)).when(c("seen").isNotNull(), day(year.cast("int"), c("m"), c("d")))
    return found.withColumn("release_date", F.date_format(date, "yyyy-MM-dd")).drop(*new.values())


def folded_date(days: Column, base: Column, day: Callable[[Column, Column, Column], Column]) -> Column:
    """The date of the last of some days of a page, read one after the other."""
    empty = F.struct(base.cast("int").alias("year"), F.lit(None).cast("date").alias("last"), F.lit(None).cast("date").alias("now"))

    def step(state: Column, x: Column) -> Column:
        first = day(F.when(x["said"], x["y"]).otherwise(state["year"]), x["m"], x["d"])
        over = ~x["said"] & (first < state["last"]) & (F.month(state["last"]) - F.month(first) >= 6)
        now = F.when(F.coalesce(over, F.lit(False)), day(F.year(first) + 1, x["m"], x["d"])).otherwise(first)
        return F.struct(F.coalesce(F.year(now), state["year"]).alias("year"), F.coalesce(now, state["last"]).alias("last"), now.alias("now"))

    return F.aggregate(days, empty, step, lambda s: s["now"])


def premiere_items(pages: DataFrame, *, page_id: str = "page_id", section: str = "section", body: str = "body", base_year: str = "base_year") -> DataFrame:
    """Calendar items of pages: h2 sets the year, h3 the date, each table row is an item.

    In section games the date and provider stand in the row itself.
    """
    blocks = page_blocks(pages, r"(?is)<h2[^>]*>.*?</h2>|<h3[^>]*>.*?</h3>|<tr[^>]*>.*?</tr>", page_id, body).join(pages.select(page_id, section, base_year), page_id)
    low = F.lower(F.substring("block", 1, 3))
    heading = F.when(low == "<h3", plain_text(F.col("block")))
    h2_year = F.when(low == "<h2", F.regexp_extract("block", r"\b((?:19|20)\d{2})\b", 1))
    rows = blocks.withColumns({"heading": carried(heading, page_id), "h2_year": carried(F.when(h2_year != "", h2_year), page_id)}).filter(low == "<tr")
    cells = F.regexp_extract_all("block", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1))
    rows = rows.withColumn("cells", cells).filter(F.size("cells") >= 2).withColumns({"meta": F.get("cells", F.lit(0)), "data": F.get("cells", F.lit(1))})
    rows = rows.withColumn("availability", plain_text(F.try_element_at("cells", F.lit(3))))
    rows = rows.withColumn("lines", plain_text(F.col("data"), lines=True))
    link = F.regexp_extract("data", r"(?is)<a[^>]*href=[\"']([^\"']+)[\"'][^>]*>", 1)
    code = F.regexp_replace(F.regexp_extract("meta", r'(?is)<shortcode[^>]*api="([^"]*)"', 1), "&quot;", '"')
    first = F.try_element_at("lines", F.lit(1))
    title = F.coalesce(F.when(plain_text(F.regexp_extract("data", r"(?is)<(?:a|strong|b)[^>]*>(.*?)</(?:a|strong|b)>", 1)) != "", plain_text(F.regexp_extract("data", r"(?is)<(?:a|strong|b)[^>]*>(.*?)</(?:a|strong|b)>", 1))), F.get_json_object(code, "$.title"), first)
    rows = rows.withColumns({"title": title, "url": F.when(link.startswith("/"), F.concat(F.lit("https://www.metacritic.com"), link)).otherwise(link), "metascore": F.get_json_object(code, "$.metaScore").try_cast("int")}).filter("title IS NOT NULL AND title <> ''")
    games = F.col(section) == "games"
    tail = F.array_join(F.slice("lines", 2, 2**30), " | ")
    dated = F.when(games & tail.rlike(DATE_IN_TEXT), tail).otherwise(F.coalesce("heading", F.lit("")))
    rows = rows.withColumns({
        "provider": F.when(games, F.regexp_replace(F.replace(F.coalesce(first, F.lit("")), F.col("title"), F.lit("")), r"^[\s\-]+|[\s\-]+$", "")).otherwise(F.regexp_replace(F.coalesce(F.try_element_at("lines", F.lit(2)), F.lit("")), r"^\((.*)\)\z", "$1")),
        "details": F.when(games, F.regexp_replace(F.regexp_replace(tail, DATE_IN_TEXT, ""), r"^[\s\-|]+|[\s\-|]+$", "")).otherwise(F.array_join(F.slice("lines", 3, 2**30), " | ")),
        "month": F.regexp_extract(dated, DATE_IN_TEXT, 1), "day": F.regexp_extract(dated, DATE_IN_TEXT, 2),
        "year": F.coalesce(F.when(F.regexp_extract(dated, DATE_IN_TEXT, 3) != "", F.regexp_extract(dated, DATE_IN_TEXT, 3)), F.lit("")),
        "base_year": F.coalesce(F.col("h2_year").cast("int"), F.col(base_year)),
    })
    dated_rows = rolled_dates(rows, page_id, "base_year")
    movie = (F.col(section) == "tv") & (F.lower("url").contains("/movie/") | is_rent_buy(F.col("availability")) | F.col("data").rlike(r'(?is)<img[^>]*alt="[^"]*movie'))
    out = dated_rows.withColumn("section_out", F.when(movie, "movies").otherwise(F.col(section)))
    keep = (F.col("section_out") == "movies") | ~(is_rent_buy(F.col("availability")) | F.lower("title").contains("special"))
    return out.filter(keep).select(page_id, "pos", F.col("section_out").alias("section"), F.col("heading").alias("group_label"), F.coalesce("release_date", F.lit("")).alias("release_date"), "title", "url", "provider", "availability", "details", "metascore")


def is_rent_buy(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return low.contains("rent") & low.contains("buy") | low.isin(RENT_BUY)


def box_office_items(pages: DataFrame, *, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Releases of box-office pages: group-label rows carry the date of the rows below."""
    rows = page_blocks(pages, r"(?is)<tr[^>]*>.*?</tr>", page_id, html)
    label = F.col("block").rlike(r"(?i)group-label")
    date = F.date_format(F.try_to_date(plain_text(F.col("block")), "MMMM d, yyyy"), "yyyy-MM-dd")
    rows = rows.withColumn("release_date", carried(F.when(label, date), page_id)).filter(~label)
    cells = F.regexp_extract_all("block", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1))
    rows = rows.withColumn("cells", cells).filter(F.size("cells") >= 1).withColumn("cell", F.get("cells", F.lit(0)))
    title = plain_text(F.coalesce(F.when(F.col("cell").rlike("(?i)<h3"), F.regexp_extract("cell", r"(?is)<h3[^>]*>(.*?)</h3>", 1)), F.regexp_extract("cell", r"(?is)<a[^>]*href=[\"'][^\"']*/release/[^\"']*[\"'][^>]*>(.*?)</a>", 1)))
    path = F.regexp_extract("cell", r"(?is)href=[\"'](/release/[^\"'?]*)", 1)
    rows = rows.withColumns({"title": title, "url": F.when(path != "", F.concat(F.lit("https://www.boxofficemojo.com"), path)).otherwise(""), "lines": plain_text(F.regexp_replace("cell", r"(?i)</(?:h3|a|div|span|p)>", "<br>"), lines=True)}).filter("title <> ''")
    own = F.filter("lines", lambda x: (x != F.col("title")) & (x != "Cast, Crew, and Company Info"))
    runtime = r"^(?:\d+\s*hr\s*)?(?:\d+\s*min)\z|^\d+\s*hr\z"
    note = lambda x: F.lower(x).rlike("re-release|re release|anniversary|program|special engagement")
    rows = rows.withColumn("own", own)
    rest = F.filter("own", lambda x: ~x.startswith("With:") & ~x.rlike(runtime))
    plain = F.filter(rest, lambda x: ~note(x))
    notes = F.concat(F.filter(rest, note), F.slice(plain, 2, 2**30))
    return rows.select(
        page_id, "pos", "title", "url", "release_date", F.coalesce(F.try_element_at(plain, F.lit(1)), F.lit("")).alias("genres"),
        F.coalesce(F.regexp_replace(F.try_element_at(F.filter("own", lambda x: x.startswith("With:")), F.lit(1)), r"^With:\s*", ""), F.lit("")).alias("cast"),
        F.coalesce(F.try_element_at(F.filter("own", lambda x: x.rlike(runtime)), F.lit(1)), F.lit("")).alias("runtime"), F.array_join(notes, " | ").alias("notes"),
        plain_text(F.try_element_at("cells", F.lit(2))).alias("distributor"), plain_text(F.try_element_at("cells", F.lit(3))).alias("scale"),
    )


def chart_entries(pages: DataFrame, *, page_id: str = "page_id", html: str = "html", most: int = 100) -> DataFrame:
    """Chart rows: rank, name, slug, last week, peak, weeks; the first of equal names stays."""
    parts = pages.select(page_id, F.posexplode(F.split(F.coalesce(html, F.lit("")), "o-chart-results-list-row-container")).alias("rank", "part")).filter((F.col("rank") >= 1) & (F.col("rank") <= most))
    title = F.regexp_extract("part", r'(?is)<h3[^>]+class="[^"]*c-title[^"]*"[^>]*>(.*?)</h3>', 1)
    metric = lambda names: F.trim(F.regexp_extract("part", rf'(?is)<span[^>]*class="c-span[^"]*"[^>]*>\s*(?:{names})\s*\.?\s*</span>.*?<span[^>]*class="c-label[^"]*"[^>]*>\s*([^<]+?)\s*</span>', 1))
    made = parts.withColumns({"h3": title, "name": plain_text(title)}).filter("name <> ''")
    linked = F.regexp_extract("h3", r'href="[^"]*/artist/([^/"]+)', 1)
    spelled = F.regexp_replace(F.replace(F.replace(F.lower("name"), F.lit(" "), F.lit("-")), F.lit("&"), F.lit("and")), r"[^\p{L}\p{N}\-]", "")
    made = made.withColumns({"slug": F.when(linked != "", linked).otherwise(spelled), "last_week": metric(r"LW|LAST\s*WEEK"), "peak_position": metric(r"PEAK|PEAK\s*POS|PEAK\s*POSITION"), "weeks_on_chart": metric(r"WEEKS|WKS\s*ON\s*CHART|WEEKS\s*ON\s*CHART")})
    turn = F.row_number().over(Window.partitionBy(page_id, F.lower("name")).orderBy("rank"))
    return made.withColumn("__turn", turn).filter("__turn = 1").select(page_id, "rank", "name", "slug", "last_week", "peak_position", "weeks_on_chart", F.col("last_week").isin("-", "NEW", "new").alias("is_new"))


def episode_dates(pages: DataFrame, *, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Distinct dates of episode pages: release dates in their JSON, else dates in the visible text."""
    raw = F.coalesce(html, F.lit(""))
    found = F.regexp_extract_all(raw, F.lit(r'"releaseDate"\s*:\s*\{[^}]*?"day"\s*:\s*(\d+)[^}]*\}'), F.lit(0))
    part = lambda x, name: F.regexp_extract(x, rf'"{name}"\s*:\s*(\d+)', 1).cast("int")
    data = F.transform(found, lambda x: F.try_make_timestamp(part(x, "year"), part(x, "month"), part(x, "day"), F.lit(0), F.lit(0), F.lit(0.0)).cast("date"))
    text = F.regexp_replace(raw, r"(?s)<[^>]+>", " ")
    iso = F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), F.lit(1)), lambda x: F.try_to_date(x, "yyyy-MM-dd"))
    us = F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)\b((?:{MONTHS}) \d{{1,2}}, \d{{4}})\b"), F.lit(1)), lambda x: F.try_to_date(x, "MMMM d, yyyy"))
    other = F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)\b(\d{{1,2}} (?:{MONTHS}) \d{{4}})\b"), F.lit(1)), lambda x: F.try_to_date(x, "d MMMM yyyy"))
    seen = F.filter(F.concat(iso, us, other), lambda x: x.isNotNull())
    good = F.filter(data, lambda x: x.isNotNull())
    return pages.select(page_id, F.array_sort(F.array_distinct(F.when(F.size(good) > 0, good).otherwise(seen))).alias("dates"))


def page_identity(pages: DataFrame, *, page_id: str = "page_id", html: str = "html", strict: bool = False) -> DataFrame:
    """Title (from JSON-LD, else the title element, without the site's name) and release year of pages.

    With ``strict`` a title that was cut inside a character reference keeps what is left of it.
    """
    raw = F.coalesce(html, F.lit(""))
    data = F.regexp_extract(raw, r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>', 1)
    title = F.coalesce(F.get_json_object(data, "$.name"), F.regexp_extract(raw, r"(?is)<title[^>]*>(.*?)</title>", 1))
    title = F.regexp_replace(unescape(T.squeeze(title), strict), r"(?i)\s*[\-|–—]\s*(?:imdb|wikipedia|metacritic|rotten tomatoes)\s*\z", "")
    year = F.regexp_extract(F.coalesce(F.get_json_object(data, "$.datePublished"), title), r"\b((?:19|20)\d{2})\b", 1)
    return pages.select(page_id, title.alias("title"), F.when(year != "", year.cast("int")).alias("year"))


def spaced_text(c: Column) -> Column:
    """HTML with its tags as spaces, references decoded, white space squeezed."""
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(c, r"(?s)<[^>]+>", " ")), r"(?U)\s+", " "))


def search_results(pages: DataFrame, *, page_id: str = "page_id", html: str = "html", most: int = 10, reach: int = 2000) -> DataFrame:
    """Results of search pages: position, title, unwrapped URL, its host, and the snippet.

    The snippet is the first one in the ``reach`` characters after the result's
    anchor; positions count all anchors, and those without an address of a page are left out.
    """
    anchor = r'(?is)<a[^>]*class="[^"]*result__a[^"]*"[^>]*>.*?</a>'
    snippet = r'(?is)<a[^>]+class="result__snippet"[^>]*>(.*?)</a>|<div[^>]+class="result__snippet"[^>]*>(.*?)</div>'
    found = pages.select(page_id, F.coalesce(html, F.lit("")).alias("raw")).select(page_id, "raw", F.slice(F.regexp_extract_all("raw", F.lit(anchor), F.lit(0)), 1, most).alias("links"), F.transform(F.split("raw", anchor, most + 1), F.length).alias("gaps"))
    # where each anchor ends: all that is before it and the anchors up to it
    ends = F.transform(F.sequence(F.lit(1), F.size("links")), lambda i: F.aggregate(F.slice("gaps", 1, i), F.lit(0), lambda s, x: s + x) + F.aggregate(F.slice("links", 1, i), F.lit(0), lambda s, x: s + F.length(x)))
    rest = F.transform(ends, lambda end: F.substring(F.col("raw"), end + 1, F.lit(reach)))
    link = found.filter(F.size("links") > 0).select(page_id, F.posexplode(F.arrays_zip("links", rest.alias("rest"))).alias("pos", "r"))
    href = unescape(F.regexp_extract("r.links", r'(?is)href="([^"]*)"', 1))
    full = F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(href)
    inner = F.regexp_extract(full, r"[?&]uddg=([^&]*)", 1)
    url = F.when(inner != "", F.try_url_decode(inner)).otherwise(full)
    said = F.coalesce(F.nullif(F.regexp_extract("r.rest", snippet, 1), F.lit("")), F.regexp_extract("r.rest", snippet, 2))
    host = F.lower(F.regexp_extract("url", r"^https?://([^/?#]*)", 1))
    made = link.select(page_id, (F.col("pos") + 1).alias("position"), spaced_text(F.col("r.links")).alias("title"), url.alias("url"), spaced_text(said).alias("snippet"))
    return made.filter("title <> '' AND url LIKE 'http%'").withColumn("source_domain", host)


def media_rows(pages: DataFrame, kind: str, *, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Rows of a film-search page's section of one kind: title, /m/ URL and years."""
    section = F.regexp_extract(F.coalesce(html, F.lit("")), rf'(?is)<search-page-result[^>]*type="{kind}"[^>]*>(.*?)</search-page-result>', 1)
    rows = pages.select(page_id, F.posexplode(F.regexp_extract_all(section, F.lit(r"(?is)<search-page-media-row.*?</search-page-media-row>"), F.lit(0))).alias("pos", "row"))
    attribute = lambda n: F.regexp_extract("row", rf'(?i){n}="([^"]*)"', 1)
    return rows.select(page_id, "pos", plain_text(F.regexp_extract("row", r'(?is)<a[^>]*slot="title"[^>]*>(.*?)</a>', 1)).alias("title"), F.regexp_extract("row", r'(?i)href="([^"]*/m/[^"]*)"', 1).alias("url"), attribute("releaseyear").alias("release_year"), attribute("startyear").alias("start_year"), attribute("endyear").alias("end_year"))


def profile_pages(pages: DataFrame, *, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Category, business category, biography and description of profile pages."""
    field = lambda n: F.regexp_extract(F.coalesce(html, F.lit("")), rf'"{n}"\s*:\s*"((?:[^"\\]|\\.)*)"', 1)
    about = F.regexp_extract(F.coalesce(html, F.lit("")), r'(?is)<meta[^>]*property="og:description"[^>]*content="([^"]*)"', 1)
    return pages.select(page_id, field("category_name").alias("category_name"), field("business_category_name").alias("business_category"), field("biography").alias("biography"), unescape(about).alias("description"))


# Lines of a programme's classification.
PRIME_TIME, OTHER_TIME = "Daypart - Prime Time (8:00pm-11:00pm (M-Sat) / 7:00pm-11:00pm (Sun))", "Daypart - Other"
PROGRAM_TYPES = [("movie", "Program Type - Movie"), ("limited series", "Program Type - Mini-Series"), ("new series", "Program Type - Series")]
OTHER_PROGRAM = "Program Type - Other"
ENGLISH, OTHER_LANGUAGE = "Language Type - English", "Language Type - Other"
FOREIGN = ["foreign", "international"]
GENRE_NAMES = {"Sci-Fi": "Sci Fi", "Rom-Com": "Rom Com"}
TWO_GENRES = ["action-adventure", "action adventure"]


def daypart(text: Column) -> Column:
    """Prime time if any time of day in the text is from 7 to before 11 in the evening."""
    times = F.regexp_extract_all(text, F.lit(r"(?i)\b((?:1[0-2]|[1-9])(?::\d{2})?\s*[ap])\b"), F.lit(1))
    evening = lambda t: F.lower(t).endswith("p") & F.regexp_extract(t, r"^(\d+)", 1).try_cast("int").between(7, 10)
    return F.when(F.exists(times, evening), PRIME_TIME).otherwise(OTHER_TIME)


def network_names(lines: Column) -> Column:
    """Networks of a cell's lines, without air times, dates and marks, each once, joined by "; "."""
    clean = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?i)^Streaming\s*\(([^)]+)\)\z", "$1"), r"(?is)\b(?:1[0-2]|[1-9])(?::\d{2})?\s*[ap]\b.*\z|\btbd\b|\s*\[\s*app/VOD only\s*\]\s*", "")
    edges = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\s*\(\d{1,2}/\d{1,2}\)\s*\z", ""), r"(?U)\s+", " "), "^[ \\-/,\u00a0]+|[ \\-/,\u00a0]+\\z", "")
    return F.array_join(F.array_distinct(F.filter(F.transform(lines, lambda x: edges(clean(x))), lambda x: x != "")), "; ")


def tv_classification(pages: DataFrame, *, page_id: str = "page_id", body: str = "body", base_year: str = "base_year") -> DataFrame:
    """Programmes of calendar pages with their classification, a row each.

    h2 sets the year and h3 the date, as in :func:`premiere_items`; a table row
    has the programme in its second cell and networks with air times in its
    third. The first line under the title, up to a colon, has genres between
    slashes: "foreign" or "international" there says the language.
    """
    blocks = page_blocks(pages, r"(?is)<h2[^>]*>.*?</h2>|<h3[^>]*>.*?</h3>|<tr[^>]*>.*?</tr>", page_id, body).join(pages.select(page_id, F.col(base_year).alias("page_year")), page_id)
    kind = F.lower(F.substring("block", 1, 3))
    year = F.regexp_extract("block", r"\b(20\d{2})\b", 1)
    rows = blocks.withColumns({"heading": carried(F.when(kind == "<h3", plain_text(F.col("block"))), page_id), "own_year": carried(F.when((kind == "<h2") & (year != ""), year), page_id)}).filter(kind == "<tr")
    cells = F.regexp_extract_all("block", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1))
    rows = rows.withColumn("cells", cells).filter(F.size("cells") >= 2).withColumns({"data": F.get("cells", F.lit(1)), "network_cell": F.coalesce(F.try_element_at("cells", F.lit(3)), F.lit(""))})
    rows = rows.withColumns({"lines": plain_text(F.col("data"), lines=True), "network_lines": plain_text(F.col("network_cell"), lines=True)})
    code = F.replace(F.regexp_extract(F.get("cells", F.lit(0)), r'(?is)<shortcode[^>]*api="([^"]*)"', 1), F.lit("&quot;"), F.lit('"'))
    strong = plain_text(F.regexp_extract("data", r"(?is)<(?:strong|b|a)\b[^>]*>(.*?)</(?:strong|b|a)>", 1))
    link = F.regexp_extract("data", r"(?is)<a [^>]*href=[\"']([^\"']+)[\"']", 1)
    rows = rows.withColumns({
        "title": F.coalesce(F.nullif(strong, F.lit("")), F.get_json_object(code, "$.title"), F.try_element_at("lines", F.lit(1)), F.lit("")),
        "url": F.when(link.startswith("/"), F.concat(F.lit("https://www.metacritic.com"), link)).otherwise(link),
        "month": F.regexp_extract(F.coalesce("heading", F.lit("")), DATE_IN_TEXT, 1), "day": F.regexp_extract(F.coalesce("heading", F.lit("")), DATE_IN_TEXT, 2),
        "year": F.regexp_extract(F.coalesce("heading", F.lit("")), DATE_IN_TEXT, 3), "base_year": F.coalesce(F.col("own_year").cast("int"), F.col("page_year")),
    }).filter("title <> ''")
    # what a line says beside the title, trailers and price marks
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?i)\b(?:color\s+|b&w\s+)?trailer\b", ""), r"^\(\$\)\s*", "")
    after = lambda x: F.when(F.lower(x).startswith(F.lower("title")), F.substring(x, F.length("title") + 1, F.length(x))).otherwise(x)
    edges = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), "^[ \\-:\u00a0]+|[ \\-:\u00a0]+\\z", "")
    said = F.filter(F.transform("lines", lambda x: edges(F.substring_index(edges(after(bare(x))), ":", 1))), lambda x: (x != "") & (F.lower(x) != F.lower("title")))
    parts = F.filter(F.transform(F.split(F.coalesce(F.try_element_at(said, F.lit(1)), F.lit("")), "/"), edges), lambda x: x != "")
    names = F.create_map(*[F.lit(x) for pair in GENRE_NAMES.items() for x in pair])
    genres = F.flatten(F.transform(F.filter(parts, lambda x: ~F.lower(x).isin(FOREIGN)), lambda x: F.when(F.lower(x).isin(TWO_GENRES), F.array(F.lit("Action"), F.lit("Adventure"))).otherwise(F.array(F.coalesce(F.try_element_at(names, x), x)))))
    marks = F.transform(F.regexp_extract_all("data", F.lit(r'(?is)<img\b[^>]*\balt="([^"]*)"'), F.lit(1)), F.lower)
    program = F.when(F.col("data").rlike(r'(?i)["/]movie/'), PROGRAM_TYPES[0][1])
    for word, name in PROGRAM_TYPES:
        program = program.when(F.array_join(marks, "\n").contains(word), name)
    rows = rows.withColumns({
        "network": network_names(F.col("network_lines")), "daypart": daypart(plain_text(F.col("network_cell"))), "program_type": program.otherwise(OTHER_PROGRAM),
        "language_type": F.when(F.exists(parts, lambda x: F.lower(x).isin(FOREIGN)), OTHER_LANGUAGE).otherwise(ENGLISH), "genres": genres,
    })
    genre = lambda i: F.coalesce(F.try_element_at("genres", F.lit(i)), F.lit("")).alias(f"genre_{i}")
    return rolled_dates(rows, page_id, "base_year").select(page_id, "pos", F.coalesce("release_date", F.lit("")).alias("release_date"), "title", "url", "network", "daypart", "program_type", "language_type", genre(1), genre(2), genre(3))
