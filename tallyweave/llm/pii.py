"""Personal data by weak supervision, with built-in functions only.

Regular expressions find candidates: the strict base forms, whose valid matches
are always reported, and looser forms around them (a card or phone number that
a base match swallowed, spelled-out addresses, IPv6).  Labelers vote on each
candidate: a checksum or form, a gazetteer, words of the context, the
boundaries and the variety of its characters.  Votes are counted by pattern, and
expectation-maximisation on those counts estimates how often each labeler votes
which way for personal data and for other text.  The posteriors train the final
span classifier: the votes' odds, corrected by what the words around a candidate
and its shape say.

Everything stays in expressions: positions are running sums of the lengths
between matches, the EM is an ``aggregate`` over rounds on at most 3 ** 5 vote
patterns a kind, and the classifier's tables have ``BUCKETS`` rows a kind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, unused

KINDS = ("email", "ip", "card", "phone")
#: Buckets of a feature, context characters on the left and right, rounds of the EM, strength of its prior, and the limit of a feature's odds.
BUCKETS = 1024
LEFT, RIGHT = 48, 24
ROUNDS = 25
STRENGTH = 10.0
SHRINK, MOST_ODDS = 5.0, 1.0
#: How often each labeler is taken to be right before the EM: form, gazetteer, context, boundary, variety.
ACCURACY = (0.98, 0.7, 0.8, 0.7, 0.6)

LOCAL, HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
GROUP = "[0-9A-Fa-f]{1,4}"
BRACKET_AT, ANY_DOT = r"(?: ?[\[({](?:at|@)[\])}] ?)", r"(?: ?[\[({](?:dot|\.)[\])}] ?| dot |\.)"
# The base forms match what their contract's expressions match, leftmost and longest, but never scan a run of
# characters twice (look-behind at its start or \G after a match) and never backtrack into a group (possessive).
BASE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[{HOST}]++(?:\.[{HOST}]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?i)(?<![{LOCAL}])[{LOCAL}]{{1,64}}+(?:{BRACKET_AT}[{HOST}]{{1,63}}+(?:{ANY_DOT}[{HOST}]{{1,63}}+){{1,5}}+| at [{HOST}]{{1,63}}+(?: dot [{HOST}]{{1,63}}+){{1,5}}+)",
    "ip": rf"(?<![0-9A-Za-z:.])(?:(?:{GROUP}:){{7}}{GROUP}|{GROUP}(?::{GROUP}){{0,5}}::(?:{GROUP}(?::{GROUP}){{0,5}})?)(?![0-9A-Za-z:])|(?<![0-9])[0-9]{{1,3}}(?:\[\.\][0-9]{{1,3}}){{3}}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ ./-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}([ ./-])[0-9]{6}\2[0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4})(?![0-9])|(?<![0-9A-Za-z+.][ .-]?)[2-9][0-9]{2}([ .-])[0-9]{3}\1[0-9]{4}(?![ .-]?[0-9])",
}
#: What a text must hold for a form to occur in it, if that is quicker to see.
HINTS = {"email": "@", "phone": "+"}

# Gazetteers.
DOMAINS = "com org net edu gov mil int info biz name io ai app dev eu uk us ca au de at ch fr be nl es it pt pl cz se no fi dk ie ru ua cn jp kr in br mx ar cl za tr gr hu ro".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 420".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|35|6011|64|65|62|50|5[6-8]|60|81)"
RESERVED = r"^(?:0|10|127|255|192\.168|169\.254|172\.(?:1[6-9]|2[0-9]|3[01]))\."
# Words of the context that speak for a kind, and words that speak against any.
SPEAKS_FOR = {
    "email": "email e-mail mail contact write reach correo courriel kontakt".split(),
    "ip": "ip address addr host server client login logged visitor from dirección adresse".split(),
    "card": "card visa mastercard amex credit debit payment pay tarjeta carte karte".split(),
    "phone": "phone tel telephone call mobile cell fax contact dial ring teléfono móvil téléphone telefon handy".split(),
}
SPEAKS_AGAINST = "version release build chapter section isbn issn doi serial order invoice ticket reference sku part item model score page token hash id commit checksum".split()

FOUND = "array<struct<pattern:int,i:int,gap:int,text:string,left:string,right:string>>"


def occurrences(text: Column, number: int, pattern: str, hint: str | None) -> Column:
    """The matches of a pattern, each with what is before it up to the match before and what follows it."""
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.struct(F.length(p).alias("n"), F.substring(p, -LEFT, LEFT).alias("tail"), F.substring(p, 1, RIGHT).alias("head")))
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    cells = F.transform(
        F.arrays_zip(matches.alias("m"), pieces.alias("p"), F.slice(pieces, 2, F.size(pieces)).alias("q")),
        lambda x, i: F.struct(F.lit(number).alias("pattern"), i.alias("i"), x["p"]["n"].alias("gap"), x["m"].alias("text"), x["p"]["tail"].alias("left"), x["q"]["head"].alias("right")),
    )
    there = text.rlike(pattern) if hint is None else text.contains(hint) & text.rlike(pattern)
    return F.when(there, F.slice(cells, 1, F.size(matches))).otherwise(F.array()).cast(FOUND)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn_check(c: Column) -> Column:
    return F.call_function("luhn_check", c)


def per_kind(found: dict[str, Column]) -> Column:
    return reduce(lambda rest, kind: F.when(F.col("kind") == kind, found[kind]).otherwise(rest), KINDS, F.lit(None))


def is_base(match: Column) -> Column:
    """Whether a match of a base form is valid."""
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    small = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    card, phone = F.length(digits(match)), F.length(digits(match))
    return per_kind({"email": F.lit(True), "ip": small, "card": card.between(13, 19) & F.coalesce(luhn_check(digits(match)), F.lit(False)), "phone": phone.between(9, 15)})


def any_word(words: list[str], context: Column) -> Column:
    return context.rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(words) + r")(?![\p{L}\p{N}])")


def votes() -> list[Column]:
    """One vote per labeler on a candidate (kind, text, left, right): 1 for personal data, 0 against, 2 for neither."""
    text, yes = F.col("text"), lambda test: F.when(test, 1).otherwise(0)
    if_known = lambda test, other=2: F.when(test, 1).otherwise(other)
    domain = F.lower(F.regexp_extract(F.substring(text, -64, 64), "([A-Za-z0-9-]+)$", 1))
    v6 = text.contains(":")
    form = per_kind({
        "email": yes(domain.rlike("^[a-z]{2,}$")), "card": yes(F.coalesce(luhn_check(digits(text)), F.lit(False))),
        "ip": yes(~v6 | text.rlike("[0-9]")),
        "phone": F.when(text.rlike(r"^[+(]"), 1).otherwise(2),
    })
    code = F.regexp_extract(text, r"^\+([0-9]{1,3})", 1)
    called = reduce(lambda a, b: a | b, [F.substring(code, 1, n).isin([c for c in CALLING_CODES if len(c) == n]) for n in (1, 2, 3)])
    gazetteer = per_kind({
        "email": if_known(domain.isin(DOMAINS)), "card": yes(digits(text).rlike(ISSUERS)),
        "ip": F.when(text.rlike(RESERVED), 0).otherwise(2), "phone": F.when(code == "", 2).otherwise(yes(called)),
    })
    words = F.lower("left")
    context = F.when(any_word(SPEAKS_AGAINST, words), 0).when(per_kind({k: any_word(w, words) for k, w in SPEAKS_FOR.items()}), 1).otherwise(2)
    boundary = yes(~F.col("left").rlike(r"[\p{L}\p{N}_=/#]$") & ~F.col("right").rlike(r"^[\p{L}\p{N}_=/]"))
    kinds_of = F.size(F.array_distinct(F.split(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""), "")))
    return [form, gazetteer, context, boundary, yes(kinds_of >= 4)]


def features() -> list[Column]:
    """Buckets of the word before, the word after, the shape, and the characters next to a candidate."""
    before = F.lower(F.regexp_extract("left", r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1))
    after = F.lower(F.regexp_extract("right", r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)", 1))
    shape = F.regexp_replace(F.regexp_replace(F.substring("text", 1, 64), r"\p{L}+", "a"), r"\p{N}", "9")
    shape = F.when(F.col("kind").isin("email", "ip"), F.regexp_replace(shape, "9+", "9")).otherwise(shape)
    sides = F.concat_ws("|", *[F.regexp_replace(F.regexp_replace(c, r"\p{L}", "a"), r"\p{N}", "9") for c in (F.substring("left", -1, 1), F.substring("right", 1, 1))])
    return [F.pmod(F.xxhash64(f), F.lit(BUCKETS)).cast("int") for f in (before, after, shape, sides)]


def scan(docs: DataFrame, text_col: str) -> DataFrame:
    """Every column but the text, a row number and the matches of all forms."""
    names, text = [c for c in docs.columns if c != text_col], F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    forms = [(BASE[k], HINTS.get(k)) for k in KINDS] + [(LOOSE[k], None) for k in KINDS]
    found = F.concat(*[occurrences(text, n, pattern, hint) for n, (pattern, hint) in enumerate(forms)])
    kept = F.struct(*[F.col(c) for c in names]) if names else F.struct(F.lit(None).alias("none"))
    return cut(docs.select(kept.alias("kept"), F.monotonically_increasing_id().alias("row"), found.alias("found")), "pii-scan")


def candidates(scanned: DataFrame) -> DataFrame:
    """Valid base spans and the loose ones that touch none of them, with votes (cells) and features."""
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("pattern") % len(KINDS) + 1)
    each = scanned.filter(F.size("found") > 0).repartition("row").select("row", F.inline("found"))
    run = Window.partitionBy("row", "pattern").orderBy("i")
    placed = each.withColumns({"kind": kind, "base": F.col("pattern") < len(KINDS), "n": F.length("text").cast("long")})
    placed = placed.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(run)).withColumn("start", F.col("end") - F.col("n"))
    valid = placed.filter(~F.col("base") | is_base(F.col("text")))
    up, down = [Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1) for order in (("start", "end"), (F.desc("start"), F.desc("end")))]
    covered = (F.coalesce(F.max(F.when(F.col("base"), F.col("end"))).over(up), F.lit(0)) > F.col("start")) | F.coalesce(F.min(F.when(F.col("base"), F.col("start"))).over(down) < F.col("end"), F.lit(False))
    free = valid.withColumn("covered", covered).filter(F.col("base") | ~F.col("covered"))
    cells = F.array(*[v.cast("int") + 3 * j for j, v in enumerate(votes())])
    return free.select("row", "kind", "start", "end", "base", cells.alias("cells"), *[f.alias(f"f{i}") for i, f in enumerate(features())])


def labeler_model(found: DataFrame) -> DataFrame:
    """(kind, prior, pos, neg): how often each labeler casts each vote for personal data and for other text.

    Votes are numbered 3 * labeler + vote; expectation-maximisation runs on the counts of vote patterns.
    """
    right = [p for a in ACCURACY for p in (0.5 * (1 - a), 0.5 * a, 0.5)]
    wrong = [p for a in ACCURACY for p in (0.5 * a, 0.5 * (1 - a), 0.5)]
    start_pos, start_neg = (F.array(*[F.lit(p) for p in probs]) for probs in (right, wrong))
    cells = F.sequence(F.lit(0), F.lit(3 * len(ACCURACY) - 1))

    def step(state: Column, patterns: Column) -> Column:
        weighted = F.transform(patterns, lambda p: F.struct(p["cells"].alias("cells"), (p["n"] * chance(p["cells"], state)).alias("a"), (p["n"] * (1 - chance(p["cells"], state))).alias("b")))
        total = lambda w, side: F.aggregate(w, F.lit(0.0), lambda s, x: s + x[side])
        share = lambda w, side, start: F.transform(cells, lambda k: (F.lit(STRENGTH) * F.get(start, k) + F.aggregate(w, F.lit(0.0), lambda s, x: s + F.when(F.array_contains(x["cells"], k), x[side]).otherwise(0.0))) / (STRENGTH + total(w, side)))
        bound = F.transform(F.array(weighted), lambda w: F.struct(((total(w, "a") + 1) / (total(w, "a") + total(w, "b") + 2)).alias("prior"), share(w, "a", start_pos).alias("pos"), share(w, "b", start_neg).alias("neg")))
        return F.get(bound, F.lit(0))

    counts = found.groupBy("kind", "cells").agg(F.count("*").cast("double").alias("n"))
    patterns = counts.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("cells", "n"))).alias("patterns"))  # at most 3 ** 5 a kind
    first = F.struct(F.lit(0.5).alias("prior"), start_pos.alias("pos"), start_neg.alias("neg"))
    model = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), first, lambda state, _: step(state, F.col("patterns")))
    return cut(patterns.select("kind", model.alias("model")).select("kind", "model.*"), "pii-labelers")


def log_odds(cells: Column, state) -> Column:
    prior = F.log(state["prior"] / (1 - state["prior"]))
    return F.aggregate(cells, prior, lambda s, k: s + F.log(F.get(state["pos"], k) / F.get(state["neg"], k)))


def chance(cells: Column, state) -> Column:
    """Posterior probability of personal data, given the votes."""
    return 1 / (1 + F.exp(-log_odds(cells, state)))


def classify(found: DataFrame) -> DataFrame:
    """Candidates with the classifier's ``score``."""
    slots = [c for c in found.columns if c.startswith("f") and c[1:].isdigit()]
    labelers = labeler_model(found)
    labelled = found.join(F.broadcast(labelers), "kind")  # a row per kind
    labelled = labelled.withColumn("odds", log_odds(F.col("cells"), {c: F.col(c) for c in ("prior", "pos", "neg")})).withColumn("p", 1 / (1 + F.exp(-F.col("odds")))).drop("pos", "neg")
    entries = F.explode(F.array(*[F.struct(F.lit(i).alias("slot"), F.col(s).alias("bucket")) for i, s in enumerate(slots)]))
    sums = labelled.select("kind", "prior", "p", entries.alias("e")).groupBy("kind", "e.slot", "e.bucket").agg(F.max("prior").alias("prior"), F.sum("p").alias("a"), F.sum(1 - F.col("p")).alias("b"))
    lift = F.log((F.col("a") + SHRINK * F.col("prior")) / (F.col("b") + SHRINK * (1 - F.col("prior")))) - F.log(F.col("prior") / (1 - F.col("prior")))
    weights = cut(sums.select("kind", "slot", "bucket", F.greatest(F.lit(-MOST_ODDS), F.least(F.lit(MOST_ODDS), lift)).alias("w")), "pii-classifier")
    scored = labelled
    for i, s in enumerate(slots):
        mine = weights.filter(F.col("slot") == i).select("kind", F.col("bucket").alias(s), F.col("w").alias(f"w{i}"))
        scored = scored.join(F.broadcast(mine), ["kind", s])  # at most KINDS * BUCKETS rows
    total = reduce(lambda a, b: a + b, [F.col(f"w{i}") for i in range(len(slots))], F.col("odds"))
    return scored.withColumn("score", 1 / (1 + F.exp(-total)))


def find_personal_data(docs: DataFrame, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Every column but the text, and ``pii``: array of (kind, start, end, base, score) by kind, then start.

    Positions count code points from 0, ends are exclusive.  Valid matches of the base
    forms are always in it (``base``); the others are candidates of the looser
    forms that the classifier scores ``threshold`` or more, which touch no base
    span and no kept one that starts before them.  Null, empty and clean texts give an
    empty array; texts of any length are searched whole, in time that grows with
    their length; equal rows give equal results; an empty table
    gives an empty result.  A column named ``pii`` is replaced.
    """
    names = [c for c in docs.columns if c not in (text_col, "pii")]
    scanned = scan(docs.select(*names, text_col), text_col)
    found = cut(candidates(scanned), "pii-candidates")
    scored = classify(found)
    before = Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    kept = scored.filter(F.col("base") | (F.col("score") >= threshold))
    kept = kept.withColumn("busy", F.coalesce(F.max(F.when(~F.col("base"), F.col("end"))).over(before) > F.col("start"), F.lit(False))).filter(F.col("base") | ~F.col("busy"))
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    spans = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(number.alias("k"), "start", "end", "kind", "base", "score"))).alias("spans"))
    pii = F.transform(F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), s["score"].alias("score")))
    joined = scanned.select("row", "kept").join(spans, "row", "left")
    return joined.select(*[F.col("kept").getField(c).alias(c) for c in names], pii.alias("pii"))


def span_list(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))
    step = lambda a, s: F.struct(
        F.when(s["start"] >= a["at"], F.concat(a["done"], F.substring(text, a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]"))).otherwise(a["done"]).alias("done"),
        F.greatest(a["at"], s["end"]).alias("at"),
    )
    return F.aggregate(order, start, step, lambda a: F.concat(a["done"], F.substring(text, a["at"].cast("int") + 1, 2**31 - 1)))
