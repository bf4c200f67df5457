"""Base spans against Python's ``re``; the labelers' model against a plain EM; added spans on planted texts."""

import hashlib
import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm import pii, registry
from tallyweave.llm.pii import find_personal_data, labeler_model, redact, span_list

SCHEMA = T.StructType([T.StructField(n, t) for n, t in [("doc_id", T.LongType()), ("text", T.StringType()), ("row", T.StringType()), ("pii", T.StringType())]])
FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    return sum(int(d) if i % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for i, d in enumerate(reversed(number))) % 10 == 0


def valid(kind, match):
    number = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": all(int(p) <= 255 for p in match.split(".")) if kind == "ip" else True, "card": 13 <= len(number) <= 19 and luhn(number), "phone": 9 <= len(number) <= 15}[kind]


def base_spans(text):
    return [(k, m.start(), m.end()) for k, form in FORMS.items() for m in re.finditer(form, text or "") if valid(k, m.group())]


def search(spark, texts):
    return find_personal_data(spark.createDataFrame([(i, t, "r", "p") for i, t in enumerate(texts)], SCHEMA)).sort("doc_id").collect()


ODD = [
    None, "", "no data", "a@b.c.@d.e x_y@z.co_w@v.io", "@x.y a@b a@b. a@.b a@b..c a@b.c-d+e@f.g", "é@x.yz ñ.q@host.example.com,next", "Ünï 😀 mail me@x.org 😀 1.2.3.4",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 0000255.1.1.1 1.2.3 1..2.3.4 9.9.9.9.", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111", "41111111111111111111111 0 0 0 0 0 0 0 0 0 0 0 0 0",
    "+1 (498) 555-3296 4111111111111111", "+1 (826) 555-4081 190.137.223.204", "+44 20 7946 0958, +1, +12, ++123456789 +1)))2 +123456789012345 +1234567890123456", "4-1-1-1 1111 1111 11111 4111  1111",
]


def test_base_spans_equal_re(spark):
    rng = np.random.default_rng(5)
    letters = list("aB1234567890.@-+ ()_%é\n") + [".", "@", " ", "1", "4"]
    texts = ODD + ["".join(rng.choice(letters, int(rng.integers(1, 120)))) for _ in range(400)]
    for row, text in zip(search(spark, texts), texts, strict=True):
        assert [(s.kind, s.start, s.end) for s in row.pii if s.base] == base_spans(text), text
        loose = sorted((s.start, s.end) for s in row.pii if not s.base)
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(loose))
        assert not any(a < e and s < b for s, e in loose for _, a, b in base_spans(text))
        assert [(pii.KINDS.index(s.kind), s.start) for s in row.pii] == sorted((pii.KINDS.index(s.kind), s.start) for s in row.pii)
        assert row.row == "r"


def test_very_long_texts(spark):
    n = 300_000
    long = {
        "x" * n + "@": [], "1" * n: [], "1 " * n: [], "+" + "1" * n: [], "(at) " * n: [], "1:" * n: [], "x" * n + "@b.c": [("email", 0, n + 4)],
        "a@" + "b." * n + "c": [("email", 0, 2 * n + 3)], "1." * n: [("ip", 8 * i, 8 * i + 7) for i in range(n // 4)], "a@b.c " * 20_000: [("email", 6 * i, 6 * i + 5) for i in range(20_000)],
    }
    for row, want in zip(search(spark, long), long.values(), strict=True):
        assert [(s.kind, s.start, s.end) for s in row.pii] == want


def planted(count=300):
    rng = np.random.default_rng(6)
    texts, hidden = [], {}
    number = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))

    def card():
        head = "4" + number(14)
        return next(head + str(d) for d in range(10) if luhn(head + str(d)))

    for i in range(count):
        phone = f"+1 ({number(3)}) 555-{number(4)}"
        made = [f"{word()}@{word()}.example.com", ".".join(str(rng.integers(1, 255)) for _ in range(4)), card(), phone][i % 4]
        text = f"{word()} {word()} {made} {word()}"
        if i % 10 == 0:
            a, b = f"+1 ({number(3)}) 555-{number(4)}", card()
            text = f"{word()} {a} {b} {word()}"
            hidden[i] = {text[text.index(a) :][: len(a)], b}
        if i % 30 == 1:
            made = f"{word()} at {word()} dot com"
            text = f"please mail {made} {word()}"
            hidden[i] = {made}
        if i % 30 == 2:
            made = "2001:db8:85a3:0:0:8a2e:370:7334"
            text = f"host {made} {word()}"
            hidden[i] = {made}
        if i % 30 == 3:  # clean: a digest, a time, a hardware address, a checksum that fails
            bad = str((int(card()) // 10 * 10) + (int(card()[-1]) + 5) % 10)
            bad = bad if not luhn(bad) else bad[:-1] + str((int(bad[-1]) + 1) % 10)
            text = f"token = {word()}{number(14)}{word()} at 12:30:45 and 0a:1b:2c:3d:4e:5f order {bad} version 12 300"
            hidden[i] = set()
        texts.append(text)
    return texts, hidden


def test_added_spans(spark):
    texts, hidden = planted()
    for i, row in enumerate(search(spark, texts)):
        added = {texts[i][s.start : s.end] for s in row.pii if not s.base}
        assert added == hidden.get(i, set()), texts[i]


def plain_em(patterns):
    """patterns: votes -> count.  Returns prior and, per labeler and vote, its probability in both classes."""
    right = [[0.5 * (1 - a), 0.5 * a, 0.5] for a in pii.ACCURACY]
    wrong = [[0.5 * a, 0.5 * (1 - a), 0.5] for a in pii.ACCURACY]
    prior, pos, neg = 0.5, right, wrong
    for _ in range(pii.ROUNDS):
        q = {}
        for votes in patterns:
            yes = prior * math.prod(pos[j][v] for j, v in enumerate(votes))
            no = (1 - prior) * math.prod(neg[j][v] for j, v in enumerate(votes))
            q[votes] = yes / (yes + no)
        a, b = sum(n * q[v] for v, n in patterns.items()), sum(n * (1 - q[v]) for v, n in patterns.items())
        prior = (a + 1) / (a + b + 2)
        share = lambda start, side, total: [[(pii.STRENGTH * start[j][v] + sum(n * side(k) for k, n in patterns.items() if k[j] == v)) / (pii.STRENGTH + total) for v in range(3)] for j in range(5)]  # noqa: B023, E731
        pos, neg = share(right, lambda k: q[k], a), share(wrong, lambda k: 1 - q[k], b)  # noqa: B023
    return prior, sum(pos, []), sum(neg, [])


def test_model_equals_plain_em(spark):
    rng = np.random.default_rng(7)
    patterns = {tuple(int(v) for v in rng.integers(0, 3, 5)): int(rng.integers(1, 40)) for _ in range(60)}
    rows = [("card", [3 * j + v for j, v in enumerate(votes)]) for votes, n in patterns.items() for _ in range(n)]
    found = labeler_model(spark.createDataFrame(rows, "kind string, cells array<int>")).first()
    prior, pos, neg = plain_em(patterns)
    assert found.prior == pytest.approx(prior) and found.pos == pytest.approx(pos) and found.neg == pytest.approx(neg)


def test_empty_table_redaction_and_digest(spark, tmp_path):
    assert find_personal_data(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(1, "é me@x.org, 1.2.3.4 end"), (1, "é me@x.org, 1.2.3.4 end"), (None, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(registry.queries()["op11_pii"](spark, str(tmp_path)).collect(), key=str)
    want = "email:2:10,ip:12:19"
    assert [tuple(r) for r in got if r.doc_id] == [(1, 1, 1, 0, 0, hashlib.sha256(want.encode()).hexdigest(), want)] * 2
    assert [tuple(r) for r in got if r.doc_id is None] == [(None, 0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")]
    spans = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end")) for k, a, b in [("email", 2, 10), ("ip", 12, 19), ("x", 15, 21)]])
    row = docs.limit(1).select(redact(F.col("text"), spans).alias("t"), span_list(spans).alias("s")).first()
    assert row.t == "é [email], [ip]nd" and row.s == "email:2:10,ip:12:19,x:15:21"


def test_context_on_both_sides_votes(spark):
    texts = ["a 4242424242424242abc", "a 4242424242424242 abc", "order 4242424242424242", "my card is 4242424242424242."]
    found = pii.candidates(pii.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), "text")).filter("base").sort("row").collect()
    assert [r.cells[3] for r in found] == [9, 10, 10, 10] and [r.cells[2] for r in found] == [8, 8, 6, 7]
    assert len({found[0].f3, found[1].f3}) == 2
