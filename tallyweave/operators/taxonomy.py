"""Categories and sub-category lines from profile texts and from reference entries.

Both are tables: a branch names its words, and lines whose value follows from
further words.  The first branch and the first value with a word hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words (found anywhere in lower-case text) and what they say, in order.
TALENT_WORDS = [
    "actor", "actress", "model", "musician", "singer", "rapper", "dj", "band", "artist", "athlete", "player", "coach", "chef",
    "public figure", "blogger", "creator", "comedian", "dancer", "journalist",
]
PROFILE_WOMAN = "she/her|she|her|hers|woman|female|actress"
PROFILE_MAN = "he/him|he|him|his|man|male|actor"
#: Words, type, subtypes by further words, subtype otherwise.
PROFILE_TALENTS = [
    (["musician", "singer", "rapper", "dj", "band"], "Musician", [(["rapper"], "Musician - Rapper"), (["dj"], "Musician - DJ / Producer"), (["band", "group"], "Musician - Band")], "Musician - Singer"),
    (
        ["athlete", "player", "coach", "footballer", "soccer", "basketball"], "Athlete",
        [
            (["coach"], "Athlete - Coach"), (["soccer", "footballer"], "Athlete - Soccer"), (["basketball", "nba"], "Athlete - Basketball"), (["football", "nfl"], "Athlete - Football"),
            (["baseball", "mlb"], "Athlete - Baseball"), (["cricket", "ipl"], "Athlete - Cricket"),
        ],
        "Athlete - Other",
    ),
    (["chef", "cook"], "Chef", [], "Internet Personality - Content Creator"),
    (["comedian", "comedy"], "Comedian", [], "Internet Personality - Content Creator"),
    (["journalist", "reporter"], "Journalist", [], "Media Personality - TV"),
    (["model"], "Model", [], "Internet Personality - Content Creator"),
]
OTHER_TALENT = ("Internet Personality", "Internet Personality - Influencer")
#: Words, category, lines (start, values by words, value otherwise).
PROFILE_BRANDS = [
    (
        ["restaurant", "cafe", "coffee", "baking", "bakery", "casual dining", "fast food"], "Restaurants",
        [
            ("Restaurant Category - ", [(["fast food", "quick service"], "Varied Menu"), (["coffee", "cafe"], "Coffee")], "Varied Menu"),
            ("Restaurant Type - ", [(["fast food", "quick service"], "Quick Service"), (["coffee", "cafe"], "Fast Casual")], "Casual Dining"),
        ],
    ),
    (
        ["clothing", "apparel", "fashion", "jewelry", "bag", "shoe", "watches", "handbag"], "Fashion",
        [("", [(["shoe", "footwear"], "Shoes"), (["jewelry", "accessory"], "Jewelry & Accessories"), (["bag", "handbag"], "Handbags"), (["watch"], "Watches"), (["men"], "Men's Apparel")], "Women's Apparel")],
    ),
    (["brewery", "beer"], "Breweries", [("Beverage Type - ", [], "Beer")]),
    (["beverage", "drink", "winery", "wine", "spirits", "whiskey", "soda", "coke"], "Beverages", [("Beverage Type - ", [(["wine"], "Wine"), (["spirit", "whiskey"], "Spirits")], "Soft Drinks")]),
    (["cosmetics", "beauty", "makeup", "skincare", "hair", "fragrance"], "Health & Beauty", [("Beauty Type - ", [(["skincare", "skin"], "Skincare"), (["hair"], "Hair"), (["fragrance", "perfume"], "Fragrance")], "Makeup")]),
    (["tv show", "television series", "tv series"], "TV Shows", [("Program Type - ", [], "Series")]),
    (["movie", "film"], "Movies", [("Studio - ", [], "Independent")]),
    (["tv channel", "tv network"], "TV Network", [("Region - ", [], "NA"), ("Location: Country - ", [], "United States")]),
    (["magazine", "publisher", "newspaper", "book", "news"], "Publishers", [("Publication Type - ", [(["newspaper"], "Newspaper"), (["magazine"], "Magazine")], "Publishing Company")]),
    (["video game", "gaming"], [(["publisher", "studio", "developer"], "Video Game Publishers")], "Video Game"),
    (["sports team", "sports club", "football club", "soccer club"], "Sports Franchise", [("Sports Type - ", [], "Soccer")]),
    (["hotel", "resort", "airline", "travel", "cruise"], "Travel", [("Travel Type - ", [(["airline"], "Airlines"), (["cruise"], "Cruise Lines")], "Hotels")]),
    (["electronics", "smartphone", "gadget"], "Consumer Electronics", []),
    (["retail", "store", "shop"], "Retail", [("Retail Type - ", [], "Retailer")]),
]

def both(*words: str) -> dict:
    """Words that count in the introduction and in the categories."""
    return {"text": list(words), "kinds": list(words)}


# Item ids and words of reference entries ("text" is the introduction, "kinds" the categories).
HUMAN = {"P31": ["Q5"], "kinds": ["births", "deaths", "people"]}
GENDERS = [
    ("Woman", {"P21": ["Q6581072"]}), ("Man", {"P21": ["Q6581097"]}), ("Non-Binary", {"P21": ["Q189125", "Q1052281", "Q1090279"]}),
    ("Woman", {"pattern": "she|her|hers|actress|woman|female"}), ("Man", {"pattern": "he|him|his|actor|man|male"}), ("Woman", {"kinds": ["women", "actresses"]}), ("Man", {"kinds": ["men"]}),
]
REFERENCE_TALENTS = [
    (
        "Athlete", {"P106": ["Q3665646", "Q11116515", "Q937857", "Q1165955", "Q10833314", "Q205312", "Q11774882", "Q378622", "Q53725", "Q206653", "Q11571", "Q1747444", "Q13382404"], "text": ["player"], "kinds": ["athlete", "footballer", "cricketer", "olympic"]},
        [
            ("Athlete - Coach", {"text": ["coach", "manager"], "kinds": ["coach"]}), ("Athlete - Basketball", {"P641": ["Q3962"], **both("basketball", "nba")}), ("Athlete - Football", {"P641": ["Q4113337"], **both("american football", "nfl")}),
            ("Athlete - Soccer", {"P641": ["Q413"], **both("soccer", "association football", "footballer")}), ("Athlete - Baseball", {"P641": ["Q1165955"], **both("baseball")}), ("Athlete - Cricket", {"P641": ["Q53725"], **both("cricket")}),
            ("Athlete - Tennis", {"P641": ["Q1914"], **both("tennis")}), ("Athlete - Golf", {"P641": ["Q205312"], **both("golf")}),
        ],
        "Athlete - Other",
    ),
    (
        "Musician", {"P106": ["Q2252262", "Q177220", "Q488205", "Q639669", "Q130857", "Q183944", "Q36834"], "kinds": ["musician", "singer", "rapper", "composer"]},
        [("Musician - Rapper", both("rapper")), ("Musician - Singer", {"text": ["singer", "vocalist"], "kinds": ["singer"]}), ("Musician - DJ / Producer", both("dj"))], "Musician - Singer",
    ),
    ("Actor", {"P106": ["Q33999", "Q2526255"], "kinds": ["actor", "actresses"], "text": ["actor", "actress"]}, [], "Actor"),
    (
        "Internet Personality", {"P106": ["Q112239616", "Q9062770", "Q11504930"], "kinds": ["youtubers", "tiktoker", "streamer"]},
        [("Internet Personality - Streamer", both("streamer")), ("Internet Personality - Content Creator", both("youtuber"))], "Internet Personality - Influencer",
    ),
    ("Journalist", {"P106": ["Q1930187", "Q482980", "Q214986", "Q16223067"], "kinds": ["journalists", "news anchors"]}, [], "Media Personality - TV"),
]
REFERENCE_OTHER_TALENT = ("Internet Personality", "Internet Personality - Content Creator")
REFERENCE_BRANDS = [
    ("Movies", {"P31": ["Q11424", "Q24869", "Q201658"], "kinds": ["films"], "text": ["movie"], "title": ["film"]}, [("Release Year - ", "year", "UNVERIFIED"), ("Studio - ", [(["warner", "disney", "universal", "paramount", "sony"], "Major")], "Independent")]),
    ("TV Shows", {"P31": ["Q5398119", "Q15416"], "kinds": ["television series", "television programs"], "text": ["television series", "television show"]}, [("Program Type - ", [], "Series"), ("Program Type - ", [(["reality"], "Reality TV")], None)]),
    ("Video Game", {"P31": ["Q7889"], "kinds": ["video games"], "text": ["video game"]}, [("", [], "PC")]),
    ("Video Game Publishers", {"P31": ["Q1137107", "Q210167"], "kinds": ["video game publishers", "video game developers"]}, []),
    ("Sports Franchise", {"P31": ["Q133936", "Q476028", "Q18420188"], "kinds": ["sports teams", "football clubs"], "text": ["sports team"]}, [("Sports Type - ", [(["basketball"], "Basketball"), (["football"], "Football")], "Soccer")]),
    ("Sports Franchise, Sports Organizations and Bodies", {"P31": ["Q15991273", "Q1339744"], "kinds": ["sports leagues"]}, []),
    ("TV Network", {"P31": ["Q229397", "Q2001305"], "kinds": ["television networks", "television channels"], "text": ["television network"]}, [("Region - ", [], "NA"), ("Location: Country - ", [], "United States")]),
    ("Publishers", {"P31": ["Q2085381", "Q1107", "Q41298"], "kinds": ["publishing companies", "newspapers", "magazines"]}, [("Publication Type - ", [(["newspaper"], "Newspaper"), (["magazine"], "Magazine")], "Publishing Company")]),
    ("Restaurants", {"P31": ["Q1142512", "Q11228519", "Q11707"], "kinds": ["restaurants", "fast food chains"]}, [("Restaurant Category - ", [], "Varied Menu"), ("Restaurant Type - ", [(["fast food"], "Quick Service")], "Casual Dining")]),
    ([(["beer"], "Breweries")], {"P31": ["Q11504938"], "kinds": ["beverage companies", "soft drink brands", "breweries"]}, [("Beverage Type - ", [(["beer"], "Beer")], "Soft Drinks")], "Beverages"),
    ("Fashion", {"kinds": ["fashion", "clothing brands"], "text": ["apparel"]}, [("", [], "Women's Apparel")]),
    ("Health & Beauty", {"kinds": ["cosmetics companies", "beauty brands"], "text": ["cosmetics"]}, [("Beauty Type - ", [], "Makeup")]),
    ("Travel", {"kinds": ["airlines", "hotel chains"], "text": ["airline"]}, [("Travel Type - ", [], "Hotels")]),
    ("Radio", {"kinds": ["radio stations", "radio networks"]}, []),
    ("Consumer Electronics", {"kinds": ["consumer electronics"], "text": ["consumer electronics"]}, []),
    ("Retail", {"kinds": ["retailers", "supermarkets"]}, [("Retail Type - ", [], "Retailer")]),
]


def _holds(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words], F.lit(False))


def _value(text: Column, values: list, otherwise: str | None) -> Column:
    return F.coalesce(*[F.when(_holds(text, words), value) for words, value in values], F.lit(otherwise))


def _lines(*lines: Column) -> Column:
    return F.concat_ws("\n", *lines)


def _brand_lines(text: Column, lines: list) -> Column:
    year = F.nullif(F.regexp_extract(text, r"\b(19\d\d|20\d\d)\b", 1), F.lit(""))
    made = [F.concat(F.lit(start), F.coalesce(year, F.lit(otherwise)) if values == "year" else _value(text, values, otherwise)) for start, values, otherwise in lines]
    return _lines(*made) if made else F.lit("")


def _talent(gender: Column, kind: Column, subtype: Column) -> Column:
    return _lines(F.concat(F.lit("Gender - "), gender), F.concat(F.lit("Talent Subtype - "), subtype), F.concat(F.lit("Talent Type - "), kind))


def _answer(category: Column | str, lines: Column) -> Column:
    return F.struct((F.lit(category) if isinstance(category, str) else category).alias("category"), lines.alias("sub_category"))


def classify_profiles(df: DataFrame, text_cols: list[str]) -> DataFrame:
    """Add ``category`` and ``sub_category`` lines of profile texts; null and empty where no word is found."""
    text = F.lower(F.concat_ws(" | ", *text_cols))
    woman = text.rlike(rf"\b(?:{PROFILE_WOMAN})\b")
    gender = F.when(woman, "Woman").when(text.rlike(rf"\b(?:{PROFILE_MAN})\b"), "Man").otherwise("UNVERIFIED")
    actor = F.when(gender == "Woman", "Actress").otherwise("Actor")
    talent = F.when(_holds(text, ["actor", "actress"]), _talent(gender, actor, actor))
    for words, kind, subtypes, otherwise in PROFILE_TALENTS:
        talent = talent.when(_holds(text, words), _talent(gender, F.lit(kind), _value(text, subtypes, otherwise)))
    talent = talent.otherwise(_talent(gender, *map(F.lit, OTHER_TALENT)))
    cases = [F.when(_holds(text, TALENT_WORDS), _answer("Talent", talent))]
    for words, category, lines in PROFILE_BRANDS:
        named = _answer(_value(text, category, lines), F.lit("")) if isinstance(category, list) else _answer(category, _brand_lines(text, lines))
        cases.append(F.when(_holds(text, words), named))
    found = F.coalesce(*cases, F.struct(F.lit(None).cast("string").alias("category"), F.lit("").alias("sub_category")))
    kept = [c for c in df.columns if c not in ("category", "sub_category")]
    return df.select(*kept, F.inline(F.array(found)))


def classify_reference(df: DataFrame) -> DataFrame:
    """Category and lines from (title, extract, categories array, claims map<string,array<string>>).

    People by their claims or categories, with gender, subtype and type; else the
    first kind of thing whose ids or words are found, and CPG without any.
    """
    text, title = F.lower(F.coalesce("extract", F.lit(""))), F.lower(F.coalesce("title", F.lit("")))
    kinds = F.lower(F.array_join(F.coalesce("categories", F.array().cast("array<string>")), " | "))
    claim = lambda p: F.coalesce(F.try_element_at(F.col("claims"), F.lit(p)), F.array().cast("array<string>"))

    def fits(signs: dict) -> Column:
        tests = [F.arrays_overlap(claim(p), F.array(*[F.lit(q) for q in ids])) for p, ids in signs.items() if p.startswith("P") and p[1:].isdigit()]
        tests += [_holds(c, signs[k]) for k, c in (("text", text), ("kinds", kinds)) if k in signs]
        tests += [(F.length(title) > 6) & _holds(title, signs["title"])] if "title" in signs else []
        tests += [text.rlike(rf"\b(?:{signs['pattern']})\b")] if "pattern" in signs else []
        return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))

    gender = F.coalesce(*[F.when(fits(signs), name) for name, signs in GENDERS], F.lit("UNVERIFIED"))
    talent = F.lit(None).cast("string")
    for kind, signs, subtypes, otherwise in reversed(REFERENCE_TALENTS):
        subtype = F.coalesce(*[F.when(fits(s), name) for name, s in subtypes], F.lit(otherwise))
        if kind == "Actor":
            subtype = F.when(gender == "Woman", "Actress").otherwise("Actor")
        talent = F.when(fits(signs), _talent(gender, subtype if kind == "Actor" else F.lit(kind), subtype)).otherwise(talent)
    talent = F.coalesce(talent, _talent(gender, *map(F.lit, REFERENCE_OTHER_TALENT)))
    cases = [F.when(fits(HUMAN), _answer("Talent", talent))]
    for category, signs, lines, *otherwise in REFERENCE_BRANDS:
        name = _value(text, category, otherwise[0]) if otherwise else category
        cases.append(F.when(fits(signs), _answer(name, _brand_lines(text, lines))))
    kept = [c for c in df.columns if c not in ("category", "sub_category")]
    return df.select(*kept, F.inline(F.array(F.coalesce(*cases, _answer("CPG", F.lit(""))))))
