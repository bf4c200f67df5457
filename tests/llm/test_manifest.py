"""The manifest against a plain tree built in one piece, and against DuckDB on whole tables."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm.manifest import manifest

SCHEMA = T.StructType([T.StructField(n, t) for n, t in [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("leaf", T.StringType())]])


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars, *_):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(nodes, fanout):
    """The root and, per node, its siblings level by level."""
    proofs, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, place in enumerate(at):
            first = place // fanout * fanout
            proofs[i].append((level[first:place], level[place + 1 : first + fanout]))
        at = [p // fanout for p in at]
        level = [sha("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
    return level[0], proofs


def edit(row):
    doc_id, text = row[0], row[1]
    if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None:
        text = text.replace("\n", "")
    return (doc_id, text, *row[2:])


def brute_force(rows, fanout=3):
    scopes = {}
    for r in rows:
        scopes.setdefault(r[3], []).append(r)
    names = sorted(scopes, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        mine = sorted(scopes[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = (mine, *plain_tree([leaf(*r) for r in mine], fanout))
    root, upper = plain_tree([trees[s][1] for s in names], fanout)
    found = []
    for s, above in zip(names, upper, strict=True):
        mine, subroot, proofs = trees[s]
        for pos, (r, proof) in enumerate(zip(mine, proofs, strict=True)):
            folded, copied = leaf(*edit(r)), []
            for left, right in proof + above:
                folded = sha("".join(left) + folded + "".join(right))
                copied.append(folded)
            proof_hash = sha("".join(d for left, right in proof + above for d in left + right))
            changed = leaf(*edit(r)) != leaf(*r)
            found.append((r[0], s, pos, leaf(*r), subroot, root, proof_hash, folded, folded == root, tuple(copied) if changed else None))
    return found


def check(spark, rows, **kwargs):
    docs = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = manifest(docs, edits={"text": F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))}, **kwargs)
    got = [(*r[:9], None if r[9] is None else tuple(r[9])) for r in found.collect()]
    want = brute_force(rows, kwargs.get("fanout", 3))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


def rows_of(sizes):
    rows, n = [], 0
    for source, size in sizes.items():
        for _ in range(size):
            rows.append((n * 7 % 1000, f"line {n}\nnext" if n % 3 else f"one line {n}", "en" if n % 5 else None, source, n if n % 4 else None))
            n += 1
    return rows


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_equals_a_plain_tree(spark, levels):
    rows = rows_of({"hot": 120, "a": 1, "b": 2, "c": 3, "d": 4, None: 10, "é": 28, "": 9, "z": 27})
    got = check(spark, rows, levels=levels)
    assert any(not r[8] for r in got) and any(r[8] for r in got)


def test_nulls_repeats_and_long_texts(spark):
    same = (5, "twice\nthe same", "en", "a", 3)
    rows = [same, same, same, (None, "no id\n", None, None, None), (None, None, None, None, None), (6, "", "", "", 0), (7, "x\n" * 500_000, "en", "a", 1), (2**53 + 1, "\n", "en", "a", 1), (2**53, "\n", "en", "a", 1)]
    check(spark, rows)


def test_one_row_and_none(spark):
    check(spark, [(2, "a\nb", "en", "s", 3)])
    check(spark, [(1, "a\nb", "en", None, 3)])
    assert manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_other_fanout_and_clashing_names(spark):
    check(spark, rows_of({"a": 33, "b": 5}), fanout=2, levels=3)
    with pytest.raises(ValueError, match="leaf"):
        manifest(spark.createDataFrame([], SCHEMA), id_col="leaf")
