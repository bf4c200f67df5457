import math
import time

import numpy as np
import pytest
from pyspark.sql import types as T

from tallyweave.llm import html_text
from tallyweave.llm.html_text import extract_main_text, main_text

PAGES = {
    "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=x>Menu</a></ul></nav><!-- ad --><div class='ad'>Buy now, really long advert text to read.</div><article><h1>Title &amp; more</h1><p><b>Bold&nbsp;text<br><p>Second&#33;  line\n here <i>in</i>line.</p><p>Ok.</p></article><footer>&copy; site</footer></body></html>": "Title & more Bold text Second! line here inline. Ok.",
    "<article><p>Kept text of the page, long enough to count.<div class='comments'><p>Reader says hi</div><aside>Side</aside><form>Name</form><p>End": "Kept text of the page, long enough to count. End",
    "<body><div id=top><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><div id=text><p>" + "Long running prose here. " * 20 + "</p><p>Short.</p></div><div><a href=4>Imprint of the site</a></div></body>": "Long running prose here. " * 20 + "Short.",
    "<header>Site</header><main><article><header><h1>Head</h1></header><p>Body of it.</p></article><section class='related'><p>Other</p></section></main>": "Head Body of it.",
    "plain text only": "plain text only",
    "": "",
    "<p>": "",
    "<nav>only menu</nav>": "",
    "<article><p>cut off <b": "cut off",
    "<article>&am &lt;b&gt; &#x41;</article></article></div>": "&am <b> A",
    "<div class='address'><p>Readme header of loads</p></div>": "Readme header of loads",
}


@pytest.mark.parametrize("page", PAGES)
def test_pages(page):
    assert main_text(page) == PAGES[page]


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar", "layout-nav", "category-social", "tag-legal", "nav", "widget"])
def test_class_names_around_the_text(name):
    page = "<div class='%s'><main><article class='post %s'><div class='article-header'><h1>Head</h1></div><p>Body of the page.</p></article></main></div>"
    assert main_text(page % (name, name)) == "Head Body of the page."
    assert main_text(f"<body><div class='{name}'><p>Body of the page, with words.</p></div><p>Short.</p>").startswith("Body of the page, with words.")


def test_furniture_is_still_dropped_beside_the_text():
    assert main_text("<article><p>Body of the page.</p><div class='main-nav'>Way</div><div class='post-comments'>" + "<p>A reader says a lot here.</p>" * 9 + "</div></article>") == "Body of the page."


def test_implied_ends_of_marked_elements():
    assert main_text("<article><p class='notice'>Mind this.<p>Body of it.<p>More.</article>") == "Body of it. More."
    assert main_text("<article><p>Body of it.</p><ul><li class='ad'>Buy<li>One<li>Two <ul><li class='ad'>Buy</ul><li>Three</ul></article>") == "Body of it. One Two Three"
    assert main_text("<article><p>Body of it.</p><table><tr class='ad'><td>Buy<tr><td class='ad'>Buy<td>Cell</table><dl><dt class='ad'>Buy<dd>Word</dl></article>") == "Body of it. Cell Word"


WRAPPED = {
    "<div class='content has-sidebar'>%s</div>": "Head Body of the page, with words.",
    "<article class='post no-sidebar'>%s</article>": "Head Body of the page, with words.",
    "<article class='post category-social'>%s</article>": "Head Body of the page, with words.",
    "<main><div id='page-with-banner'>%s</div></main>": "Head Body of the page, with words.",
    "<body><form id='aspnetForm'><div>%s</div></form></body>": "Head Body of the page, with words.",
    "<article><p>Before it.</p><section id='login'>%s</section></article>": "Before it. Head Body of the page, with words.",
    "<div class='sidebar'><a href=1>Way</a></div><p class='share'>Share%s": "Head Body of the page, with words.",
}


@pytest.mark.parametrize("page", WRAPPED)
def test_wrappers_keep_the_text(page):
    assert main_text(page % "<h2>Head</h2><p>Body of the page, with words.</p>") == WRAPPED[page]


def test_forms_lists_and_nested_articles():
    assert main_text("<form>Name <input> Mail <input></form>") == ""
    assert main_text("<article><p>Body of the page, with words.</p><article><p>A reader says so.</p></article></article>") == "Body of the page, with words."
    assert main_text("<article><p>See <a href=1>one <a href=2>two</a> and then plain words.</p></article>") == "See one two and then plain words."
    prose = "<p>Body of the page, with many words in it.</p>"
    assert main_text(f"<main>{prose}<div><a href=1>Other page</a> <a href=2>More of them</a></div>{prose}<p>Ok.</p></main>") == "Body of the page, with many words in it. Body of the page, with many words in it. Ok."
    assert main_text(f"<main><article>{prose}{prose}</article><div><b>Buy</b></div></main>") == "Body of the page, with many words in it. Body of the page, with many words in it."
    table = "<table><tr><td>1</td><td>2</td></tr></table><ul><li>A <a href=1>b</a> and more<li>C</ul>"
    assert main_text(f"<article>{prose}{table}</article>") == "Body of the page, with many words in it. 1 2 A b and more C"


def test_ratios_smoothing_and_clusters_by_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(30):
        texts = ["w" * int(rng.integers(1, 90)) for _ in range(int(rng.integers(1, 12)))]
        tags, links = rng.integers(0, 4, len(texts)), rng.integers(0, 2, len(texts))
        page = "".join("<p>" + "<b></b>" * int(t) + (f"<a>{x}</a>" if k else x) + "</p>" for x, t, k in zip(texts, tags, links))
        reader = html_text.LineReader()
        reader.feed(page)
        reader.close()
        reader.flush()
        # the start tag of a line counts for it, its end tag does not
        want = [(0 if k else len(x)) / (1 + 1 + 2 * int(t) + 2 * int(k)) for x, t, k in zip(texts, tags, links)]
        assert [x.plain / (x.tags + 1) for x in reader.lines] == pytest.approx(want)
        logs = [math.log1p(r) for r in want]
        for sigma in (0.5, 1.0, 2.5):
            reach = int(3 * sigma + 0.5)
            smoothed = []
            for i in range(len(logs)):
                near = [(math.exp(-(((i - j) / sigma) ** 2) / 2), logs[j]) for j in range(len(logs)) if abs(i - j) <= reach]
                smoothed.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
            assert html_text.smooth(np.array(logs), sigma) == pytest.approx(smoothed)
            at = html_text.two_clusters(np.array(smoothed))
            low, high = [x for x in smoothed if x < at], [x for x in smoothed if x >= at]
            assert high
            if low:  # every value is nearest to the mean of its own cluster
                assert at == pytest.approx((sum(low) / len(low) + sum(high) / len(high)) / 2, abs=1e-6)


def test_clusters_decide_within_an_article(monkeypatch):
    prose = "<p>Body of the page, with many words in it.</p>" * 3
    page = f"<article>{prose}</article><article><p>Hm.</p></article><main>{prose}<div><i>x</i> <a>More to see</a></div></main>"
    found = main_text(page)
    monkeypatch.setattr(html_text, "dense_lines", lambda lines, free, sigma: np.ones(len(lines), bool))
    everything = main_text(page)
    monkeypatch.setattr(html_text, "dense_lines", lambda lines, free, sigma: np.zeros(len(lines), bool))
    nothing = main_text(page)
    assert found != everything and found != nothing and "Hm." in everything and "Hm." not in found


@pytest.mark.parametrize("page", ["<b>" * 100_000, "<div>" * 100_000 + "</p>" * 100_000, "<i>" * 50_000 + "<h4>a</h4>" * 50_000, "<li>" * 100_000, "<div class=ad>" * 50_000])
def test_unclosed_tags_take_linear_time(page):
    begin = time.process_time()
    main_text(page)
    assert time.process_time() - begin < 4


def test_null_and_extra_columns(spark):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("html", T.StringType()), T.StructField("text", T.StringType())])
    rows = [(1, None, "old"), (1, None, "old"), (None, "<article>a" + "<p>word</p>" * 50_000, None)]
    got = extract_main_text(spark.createDataFrame(rows, schema)).collect()
    assert [r.text for r in got] == ["", "", "a" + " word" * 50_000]
    assert extract_main_text(spark.createDataFrame([], schema)).count() == 0


def prose(count, size, word="Word"):
    return "".join(f"<p>{(word + ' ') * (size // (len(word) + 1))}{word}.</p>" for _ in range(count))


def test_comments_never_replace_the_article():
    for name in ('class="comments"', 'id="comments"'):
        for tag in ("div", "section"):
            page = f'<body><div class="story">{prose(9, 60)}</div><{tag} {name}>{prose(33, 70, "Remark")}</{tag}></body>'
            assert "Remark" not in main_text(page) and main_text(page).count("Word.") == 9
            page = f"<body><article>{prose(3, 60)}</article><{tag} {name}>{prose(33, 70, 'Remark')}</{tag}></body>"
            assert "Remark" not in main_text(page) and main_text(page).count("Word.") == 3
    # unless the page has nothing else
    assert main_text(f'<body><div id="comments">{prose(3, 60)}</div></body>').count("Word.") == 3


def test_short_prose_beside_long_prose_stays():
    for outer in ("main", "body"):
        page = f"<{outer}><section>{prose(5, 400)}</section><section>{prose(3, 68, 'Short')}</section></{outer}>"
        assert main_text(page).count("Short.") == 3 and main_text(page).count("Word.") == 5
    page = "".join(f"<div>{'This is a sentence. ' * n}End {n}.</div>" for n in (9, 3, 8, 2, 10))
    assert [f"End {n}." in main_text(f"<body>{page}</body>") for n in (9, 3, 8, 2, 10)] == [True] * 5


def test_headings_of_link_boxes_go():
    box = "<div><h2><a href=x>Other story one</a></h2><h2><a href=y>Other story two</a></h2></div>"
    text = main_text(f"<main><article><h1>The title</h1>{prose(5, 200)}</article>{box}</main>")
    assert "Other" not in text and text.startswith("The title")


def test_a_cut_tag_takes_linear_time():
    began = time.time()
    main_text('<a x="' + "<b " * 350_000 + ">")
    assert main_text("<p>Some text here.</p><a <b <c") == "Some text here."
    assert time.time() - began < 5
