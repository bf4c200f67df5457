"""Merkle manifest of a dataset: a persistent tree with path copying, built in aligned blocks.

Rows are leaves, in order within their scope (a source).  A run of ``fanout``
neighbours makes a node of the next level, up to one node per scope; the scopes'
nodes, in order, make the upper tree in the same way.  Leaves are numbered by one
range sort, so that an aligned block of ``fanout ** levels`` leaves is a group of
bounded size: a task builds its levels and hands one digest up, and the same is
done with the blocks' digests until one is left.  On the way down each block
gets the siblings of the nodes above it.

An edited leaf makes a new version of the tree.  A version is the copies of the
leaf's ancestors and nothing else: it shares all other nodes with the tree it
was made from.  The copies inside a block come from the block's levels; those
above it continue from the siblings handed down, so no version needs more than
its own row.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Levels built by one task: with runs of three, blocks of 729 nodes.
LEVELS = 6
RESULTS = ("pos", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "copied")
NODES = "scope string, pos long, size long, digest binary"
PATHS = "scope string, pos long, path array<binary>, subroot binary, root binary"


def field(value: Column) -> Column:
    """A value in the input of a leaf: its UTF-8 byte count, a colon and itself; ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 of a row's values as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(size: int, fanout: int, most: int) -> int:
    """Levels above ``size`` nodes until one is left, ``most`` at most."""
    up = 0
    while size > 1 and up < most:
        size, up = -(-size // fanout), up + 1
    return up


def block_levels(digests: list[str], fanout: int, up: int) -> list[list[str]]:
    """The nodes of a block, level by level."""
    levels = [digests]
    for _ in range(up):
        below = levels[-1]
        levels.append([sha("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return levels


def siblings(levels: list[list[str]], i: int, fanout: int) -> list[tuple[str, str]]:
    """Left and right siblings of node ``i`` and of its ancestors inside the block."""
    found = []
    for nodes in levels[:-1]:
        first = i - i % fanout
        found.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + fanout])))
        i //= fanout
    return found


def copied_path(digest: str, path: list[tuple[str, str]]) -> list[str]:
    """The ancestors of a leaf in the version where it has this digest."""
    copies = []
    for left, right in path:
        digest = sha(left + digest + right)
        copies.append(digest)
    return copies


def pack_path(path: list[tuple[str, str]]) -> list[bytes]:
    return [bytes.fromhex(side) for pair in path for side in pair]


def unpack_path(packed: list[bytes]) -> list[tuple[str, str]]:
    return [(packed[i].hex(), packed[i + 1].hex()) for i in range(0, len(packed), 2)]


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``pos`` (from 0) and ``size`` within their ``scope``, in the order of the columns ``order``.

    One range sort; the place inside a sorted part is known as it is written,
    and the parts' counts per scope (at most parts + scopes rows) give the rest.
    """
    dealt = rows.repartitionByRange("scope", *order).sortWithinPartitions("scope", *order)
    dealt = cut(dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "manifest-sorted")
    parts = dealt.groupBy("scope", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("scope").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"before": F.coalesce(F.sum("n").over(before), F.lit(0)), "size": F.sum("n").over(Window.partitionBy("scope"))})
    joined = dealt.join(parts.drop("n"), ["scope", "part"])
    return joined.withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("part", "at", "first", "before")


def blocked(nodes: DataFrame, span: int):
    return nodes.groupBy("scope", F.floor(F.col("pos") / span).alias("block"))


def climb(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """The nodes (scope, pos, size, digest), those of their blocks, and so on until every scope has one."""
    span = fanout**levels

    def block_root(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        size = table["size"][0].as_py()
        top = block_levels([d.hex() for d in table["digest"].to_pylist()], fanout, height(size, fanout, levels))[-1]
        return pa.table({"scope": [key[0].as_py()], "pos": [table["pos"][0].as_py() // span], "size": [-(-size // span)], "digest": [bytes.fromhex(top[0])]}, schema=ARROW_NODES)

    stages = [nodes]
    most = nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        stages.append(cut(blocked(stages[-1].select("scope", "pos", "size", "digest"), span).applyInArrow(block_root, NODES), "manifest-blocks"))
        most = -(-most // span)
    return stages


def descend(nodes: DataFrame, above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The paths of ``nodes`` up to the root, from those of their blocks (``above``)."""
    span = fanout**levels

    def block_paths(key: tuple[pa.Scalar, ...], table: pa.Table, upper: pa.Table) -> pa.Table:
        if not table.num_rows:
            return ARROW_PATHS.empty_table()
        table = table.sort_by("pos")
        tree = block_levels([d.hex() for d in table["digest"].to_pylist()], fanout, height(table["size"][0].as_py(), fanout, levels))
        rest, n = upper["path"][0].as_py(), table.num_rows
        paths = [pack_path(siblings(tree, i, fanout)) + rest for i in range(n)]
        one = lambda name: [upper[name][0].as_py()] * n
        return pa.table({"scope": table["scope"], "pos": table["pos"], "path": paths, "subroot": one("subroot"), "root": one("root")}, schema=ARROW_PATHS)

    met = blocked(nodes.select("scope", "pos", "size", "digest"), span).cogroup(above.withColumn("block", F.col("pos")).groupBy("scope", "block"))
    return cut(met.applyInArrow(block_paths, PATHS), "manifest-paths")


ARROW_NODES = pa.schema([("scope", pa.string()), ("pos", pa.int64()), ("size", pa.int64()), ("digest", pa.binary())])
ARROW_PATHS = pa.schema([("scope", pa.string()), ("pos", pa.int64()), ("path", pa.list_(pa.binary())), ("subroot", pa.binary()), ("root", pa.binary())])


def manifest(docs: DataFrame, *, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", scope_col: str = "source", edits: dict[str, Column] | None = None, fanout: int = 3, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``docs``: its leaf, its proof, and the version of the tree that ``edits`` to it alone make.

    ``fields`` are the columns that a leaf covers, ``edits`` values to put in
    place of some of them.  Returns id, scope, pos (place in the scope), leaf,
    subroot (of the scope), root, proof_sha256 (of the siblings from the leaf
    to the root), folded_root (the root recomputed from the edited leaf and the
    original siblings), verified (whether that is the root), and ``copied``:
    the digests of the nodes that the version copies, from the leaf's parent to
    its root (null where the edits change nothing: no version is made).

    Leaves ascend by id within their scope, null ids first; rows of one id are
    ordered by their digest, so only wholly equal rows tie, and they are leaves
    of their own.  A null scope is a scope of its own, before all others.  Nulls
    in any field differ from empty texts.  Texts of any length are hashed
    whole.  An empty table gives an empty result.  Other columns are not
    carried; an id or scope column with the name of a result is refused.
    """
    if clash := {c.lower() for c in (id_col, scope_col)} & set(RESULTS):
        raise ValueError(f"rename the columns {sorted(clash)}: results have these names")
    edits, span = edits or {}, fanout**levels
    edited = leaf_digest([edits.get(c, F.col(c)) for c in fields])
    scope = F.coalesce(F.concat(F.lit(":"), F.col(scope_col).cast("string")), F.lit("-"))  # in byte order, null first
    rows = docs.select(scope.alias("scope"), F.col(id_col).alias("id"), leaf_digest([F.col(c) for c in fields]).alias("digest"), edited.alias("edited"))
    rows = cut(rows.withColumn("edited", F.when(F.col("edited") != F.col("digest"), F.col("edited"))), "manifest-leaves")
    leaves = cut(numbered(rows, ["id", "digest"]), "manifest-numbered")
    stages = climb(leaves, fanout, levels)
    subroots = stages[-1].select("scope", "digest")
    sources = cut(numbered(subroots.select(F.lit("").alias("scope"), F.col("scope").alias("of"), "digest"), ["of"]), "manifest-scopes")
    upper = climb(sources, fanout, levels)
    paths = upper[-1].select("scope", "pos", F.array().cast("array<binary>").alias("path"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(upper[:-1]):
        paths = descend(nodes, paths, fanout, levels)
    paths = sources.join(paths.select("pos", "path", "root"), "pos").select(F.col("of").alias("scope"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root")
    for nodes in reversed(stages[1:-1]):
        paths = descend(nodes, paths, fanout, levels)
    result = pa.schema([("scope", pa.string()), ("pos", pa.int64()), ("id", rows_type(docs, id_col)), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("copied", pa.list_(pa.string()))])

    def versions(key: tuple[pa.Scalar, ...], table: pa.Table, above: pa.Table) -> pa.Table:
        if not table.num_rows:
            return result.empty_table()
        table = table.sort_by("pos")
        digests = [d.hex() for d in table["digest"].to_pylist()]
        tree = block_levels(digests, fanout, height(table["size"][0].as_py(), fanout, levels))
        rest = unpack_path(above["path"][0].as_py())
        subroot, root = above["subroot"][0].as_py().hex(), above["root"][0].as_py().hex()
        proofs, folded, copied = [], [], []
        for i, new in enumerate(table["edited"].to_pylist()):
            path = siblings(tree, i, fanout) + rest
            copies = copied_path(digests[i] if new is None else new.hex(), path)
            proofs.append(sha("".join(left + right for left, right in path)))
            folded.append(copies[-1] if copies else digests[i] if new is None else new.hex())
            copied.append(None if new is None else copies)
        n = table.num_rows
        return pa.table({"scope": table["scope"], "pos": table["pos"], "id": table["id"], "leaf": digests, "subroot": [subroot] * n, "root": [root] * n, "proof_sha256": proofs, "folded_root": folded, "copied": copied}, schema=result)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"scope string, pos long, id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, copied array<string>"
    found = blocked(leaves, span).cogroup(paths.withColumn("block", F.col("pos")).groupBy("scope", "block")).applyInArrow(versions, schema)
    found = found.withColumns({"of": F.when(F.col("scope") != "-", F.substring("scope", 2, 2**31 - 1)), "verified": F.col("folded_root") == F.col("root")})
    return found.select(F.col("id").alias(id_col), F.col("of").alias(scope_col), *RESULTS)


def rows_type(docs: DataFrame, id_col: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema[id_col].dataType)


#: The manifest of ``documents`` as DuckDB SQL: both trees as recursive tables, the checksum of ids bit by bit.
MANIFEST_SQL = r"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, *, CASE WHEN doc_id IS NULL THEN NULL ELSE
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) END AS crc FROM documents),
edited AS (SELECT *, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS text2 FROM docs),
fields AS (SELECT r, doc_id, source, text, text2, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM edited),
leaves AS (SELECT r, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(text2) || ':' || text2, '-')) AS leaf2 FROM fields),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves),
tree AS (SELECT source, 0 AS level, pos, leaf AS digest, n FROM placed
    UNION ALL SELECT source, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM tree WHERE n > 1 GROUP BY source, level, pos // 3, n),
tops AS (SELECT source, digest AS subroot, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
upper AS (SELECT 0 AS level, pos, subroot AS digest, n FROM tops
    UNION ALL SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM upper WHERE n > 1 GROUP BY level, pos // 3, n),
nodes AS (SELECT source, false AS up, level, pos, digest, n FROM tree UNION ALL SELECT NULL, true, level, pos, digest, n FROM upper),
runs AS (SELECT source, up, level, pos // 3 AS run, list(struct_pack(pos, digest) ORDER BY pos) AS members FROM nodes WHERE n > 1 GROUP BY ALL),
ups AS (SELECT a.r, a.doc_id, a.leaf, a.leaf2, a.source, a.pos, t.subroot, t.height, t.pos AS top, (SELECT digest FROM upper WHERE n = 1) AS root, (SELECT max(level) FROM upper) AS upper_height
    FROM placed a JOIN tops t ON a.source IS NOT DISTINCT FROM t.source),
steps AS (SELECT u.r, s.i AS step, s.i >= u.height AS up, CASE WHEN s.i >= u.height THEN s.i - u.height ELSE s.i END AS level,
    CAST(CASE WHEN s.i >= u.height THEN u.top // CAST(3 ** (s.i - u.height) AS BIGINT) ELSE u.pos // CAST(3 ** s.i AS BIGINT) END AS BIGINT) AS place, u.source
    FROM ups u, LATERAL (SELECT unnest(range(u.height + u.upper_height)) AS i) s),
sides AS (SELECT s.r, s.step, coalesce(list_aggregate(list_transform(list_filter(m.members, lambda x: x.pos < s.place), lambda x: x.digest), 'string_agg', ''), '') AS lefts,
    coalesce(list_aggregate(list_transform(list_filter(m.members, lambda x: x.pos > s.place), lambda x: x.digest), 'string_agg', ''), '') AS rights
    FROM steps s JOIN runs m ON m.up = s.up AND m.level = s.level AND m.run = s.place // 3 AND (s.up OR m.source IS NOT DISTINCT FROM s.source)),
proofs AS (SELECT r, list(struct_pack(l := lefts, r := rights) ORDER BY step) AS path, string_agg(lefts || rights, '' ORDER BY step) AS proof FROM sides GROUP BY r)
SELECT u.doc_id, u.leaf, u.subroot, u.root, sha256(coalesce(p.proof, '')) AS proof_sha256,
    list_reduce(list_prepend(struct_pack(l := u.leaf2, r := ''), coalesce(p.path, [])), lambda a, b: struct_pack(l := sha256(b.l || a.l || b.r), r := '')).l AS folded_root,
    list_reduce(list_prepend(struct_pack(l := u.leaf2, r := ''), coalesce(p.path, [])), lambda a, b: struct_pack(l := sha256(b.l || a.l || b.r), r := '')).l = u.root AS verified
FROM ups u LEFT JOIN proofs p ON p.r = u.r"""
