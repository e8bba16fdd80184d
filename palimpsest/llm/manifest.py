"""Merkle manifest of a dataset, rolled up as nested structs.

Every row is a leaf; the leaves of a source, in the order of their ids, form a tree of fan 16; the roots
of the sources form one more tree. A leaf's rank is written in digits of base 16. Within a block of
16**3 leaves the digits are grouped away one after the other: each ``groupBy`` turns the children of a
node into an array of structs and hashes them into the struct of the next digit. A block's digest is a
node of the next round, whose blocks are rolled up in the same way, until one node a tree is left. On
the way back one ``transform`` over the nested structs and one ``explode`` give each child its siblings
of all levels.

So no row holds more than one block, whatever a source holds, and no join is needed: a block and the
path above it meet in one group. The driver sees a few numbers a range of rows and two scalars.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from ._store import written

#: Fixed values of the contract: children of a node, the hash of a row by its fields in this order.
FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Digits that are grouped away within one block.
DIGITS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LEVEL = "array<struct<at:int,run:array<string>>>"


def h(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts (strings), one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """A value as the hash takes it: ``-`` for null, else its length in UTF-8 bytes, a colon, itself."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def every_fifth(id_: Column) -> Column:
    """The rows that the check of the contract tampers with; none whose id is null."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def ranked(rows: DataFrame, tree: str, by: list[str]) -> DataFrame:
    """``rows`` with ``rank`` (from 0, in the order of ``by`` within their ``tree``) and ``n``, the rows
    of that tree. Ranges of (tree, by) are numbered side by side. A range's first tree may have begun
    before it and its last may go on behind it: that much of each range reaches the driver."""
    order = [F.col(c).asc_nulls_first() for c in by]
    ranges = written(rows.repartitionByRange(F.col(tree).asc_nulls_first(), *order).withColumn("part", F.spark_partition_id()), "leaves")
    sizes = ranges.groupBy("part", tree).count()
    edge = F.struct(F.col(tree).isNotNull(), F.col(tree), F.col("count"))
    known = sizes.groupBy("part").agg(F.min(edge).alias("first"), F.max(edge).alias("last")).orderBy("part").collect()
    before, after, run, last = {}, {}, 0, None
    for r in known:
        run = run if last is not None and tuple(r["first"])[:2] == last else 0
        before[r["part"]] = run
        run = run + r["first"][2] if tuple(r["first"])[:2] == tuple(r["last"])[:2] else r["last"][2]
        last = tuple(r["last"])[:2]
    run, last = 0, None
    for r in reversed(known):
        run = run if last is not None and tuple(r["last"])[:2] == last else 0
        after[r["part"]] = run
        run = run + r["last"][2] if tuple(r["first"])[:2] == tuple(r["last"])[:2] else r["first"][2]
        last = tuple(r["first"])[:2]

    def of(edges: dict, begins: bool) -> Column:
        """What lies beyond the range, for rows of the range's first (last) tree."""
        rows_of = {r["part"]: (r["first"] if begins else r["last"]) for r in known if edges[r["part"]]}
        if not rows_of:
            return F.lit(0).cast("long")
        kind = ranges.schema[tree].dataType
        many = F.create_map(*[x for p in rows_of for x in (F.lit(p), F.lit(edges[p]).cast("long"))])
        names = F.create_map(*[x for p, e in rows_of.items() for x in (F.lit(p), F.lit(e[1]).cast(kind))])
        part = F.col("part")
        return F.when(names[part].eqNullSafe(F.col(tree)), F.coalesce(many[part], F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))

    local = Window.partitionBy("part", tree)
    rank = F.row_number().over(local.orderBy(*order)) - 1 + of(before, True)
    n = F.count("*").over(local) + of(before, True) + of(after, False)
    return ranges.withColumn("rank", rank.cast("long")).withColumn("n", n.cast("long")).drop("part")


def rolled(nodes: DataFrame, payload: list[str], fan: int, digits: int) -> DataFrame:
    """(tree, n, rank, digest, payload) -> one row a block: (tree, n, block, digest, kids).

    n: nodes of the tree. Level by level, ``fan`` children become their hash, unless the child is the
    only node of its level. kids: the nested structs of the block, the outermost digit first. Placed by
    (tree, block) once; the groupings by more digits need no further shuffle."""
    size = fan**digits
    d = nodes.withColumn("block", F.floor(F.col("rank") / size).cast("long"))
    for k in range(digits):
        d = d.withColumn(f"d{k}", (F.floor(F.col("rank") / fan**k) % fan).cast("int"))
    d = d.select("tree", "n", "block", *[f"d{k}" for k in range(digits)], "digest", F.struct("rank", *payload).alias("kids"))
    d = d.repartition("tree", "block")
    for k in range(digits):
        # kids of a node: (its digit, its digest, its own kids), in order
        d = d.groupBy("tree", "n", "block", *[f"d{j}" for j in range(k + 1, digits)]).agg(F.array_sort(F.collect_list(F.struct(F.col(f"d{k}").alias("at"), "digest", "kids"))).alias("kids"))
        alone = F.col("n") <= fan**k
        d = d.withColumn("digest", F.when(alone, F.col("kids")[0]["digest"]).otherwise(F.sha2(F.array_join(F.col("kids.digest"), ""), 256)))
    return d.select("tree", "n", "block", "digest", "kids")


def spread(blocks: DataFrame, payload: list[str], fan: int, digits: int) -> DataFrame:
    """One row a leaf of each block: (tree, rank, payload, path, top); ``blocks`` also hold ``path`` and
    ``top``, what stands above the block. path: (place in its run, the run's digests) level by level."""

    def below(kids: Column, above: Column, k: int) -> Column:
        run = F.transform(kids, lambda kid: kid["digest"])

        def step(kid: Column) -> Column:
            own = F.array(F.struct(kid["at"].alias("at"), run.alias("run"))).cast(LEVEL)
            path = F.when(F.col("n") > fan**k, F.concat(own, above)).otherwise(above)
            if k == 0:
                return F.array(F.struct(kid["kids"].alias("row"), path.alias("path")))
            return below(kid["kids"], path, k - 1)

        return F.flatten(F.transform(kids, step))

    leaf = blocks.select("tree", "top", F.explode(below(F.col("kids"), F.col("path"), digits - 1)).alias("leaf"))
    return leaf.select("tree", "leaf.row.rank", *[F.col(f"leaf.row.{c}").alias(c) for c in payload], "leaf.path", "top")


def paths(nodes: DataFrame, payload: list[str], finish: Callable[[DataFrame], DataFrame], fan: int, digits: int) -> DataFrame:
    """(tree, n, rank, digest, payload) -> (tree, rank, payload, path, top) of every node.

    ``finish`` takes (tree, digest), one row a tree, to (tree, path, top): what stands above the trees.
    """
    kind = nodes.schema["tree"].dataType.simpleString()
    blocks = written(rolled(nodes, payload, fan, digits), "blocks")
    if blocks.agg(F.max("block")).first()[0]:
        upper = blocks.select("tree", F.ceil(F.col("n") / fan**digits).cast("long").alias("n"), F.col("block").alias("rank"), "digest")
        above = paths(upper, [], finish, fan, digits).withColumnRenamed("rank", "block")
    else:
        above = finish(blocks.select("tree", "digest")).withColumn("block", F.lit(0).cast("long"))
    # a block and its path meet in one group of two rows
    there = blocks.select("tree", "block", "n", "kids", F.lit(None).cast(LEVEL).alias("path"), F.lit(None).cast("string").alias("top"))
    kids = blocks.schema["kids"].dataType
    path = above.select(F.col("tree").cast(kind), "block", F.lit(None).cast("long").alias("n"), F.lit(None).cast(kids).alias("kids"), "path", "top")
    met = there.unionByName(path).groupBy("tree", "block").agg(*[F.any_value(c, True).alias(c) for c in ("n", "kids", "path", "top")])
    return spread(met, payload, fan, digits)


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``path`` give."""
    def up(acc: Column, level: Column) -> Column:
        left, right = F.slice(level["run"], F.lit(1), level["at"]), F.slice(level["run"], level["at"] + 2, F.size(level["run"]))
        return F.sha2(F.concat(F.array_join(left, ""), acc, F.array_join(right, "")), 256)

    return F.aggregate(path, leaf, up)


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level and from left to right, as one string."""
    return F.array_join(F.transform(path, lambda level: F.array_join(F.filter(level["run"], lambda _, i: i != level["at"]), "")), "")


def manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    tampered: Callable[[Column], Column] | None = None,
    fan: int = FAN,
    digits: int = DIGITS,
) -> DataFrame:
    """One row per row of ``docs``: (id, leaf, seen, subroot, root, path).

    leaf: the row's hash; seen: its hash with its text in lower case where ``tampered`` (a condition on
    the id) holds, else the leaf; path: (place, digests of the run) of all levels from leaf to root,
    where a level that has one node only is left out; subroot and root: the tree's and the manifest's.

    Null fields count as ``-``, which no value gives. Null is a source of its own, the first. Rows of
    one id are ordered by their leaves, a null id comes first; repeated rows are leaves of their own.
    An empty table has no rows. Other columns are ignored, whatever their names. The digests depend on
    the rows alone, not on their order or partitions.
    """
    ship(docs.sparkSession)
    hashed = lambda text: h(*[field(text if c == text_col else F.col(c)) for c in fields])
    other = F.when(tampered(F.col(id_col)), hashed(lowered(F.col(text_col)))) if tampered else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("tree"), hashed(F.col(text_col)).alias("digest"), other.alias("other"))
    leaves = ranked(written(rows, "hashes"), "tree", ["id", "digest"])  # texts are read once

    def over_sources(tops: DataFrame) -> DataFrame:
        """The tree of the sources' roots; a source's top is its own root and the manifest's."""
        nodes = ranked(tops.select(F.lit(0).alias("tree"), F.col("tree").alias("source"), "digest"), "tree", ["source"])
        nodes = nodes.withColumn("subroot", F.col("digest"))
        end = lambda top: top.select("tree", F.array().cast(LEVEL).alias("path"), F.col("digest").alias("top"))
        root = paths(nodes, ["source", "subroot"], end, fan, digits)
        return root.select(F.col("source").alias("tree"), "path", F.concat_ws(" ", "subroot", "top").alias("top"))

    out = paths(leaves.withColumn("leaf", F.col("digest")), ["id", "leaf", "other"], over_sources, fan, digits)
    both = F.split("top", " ")
    return out.select(F.col("id").alias(id_col), "leaf", F.coalesce("other", "leaf").alias("seen"), both[0].alias("subroot"), both[1].alias("root"), "path")


def verified(docs: DataFrame, tampered: Callable[[Column], Column] = every_fifth, **more) -> DataFrame:
    """The manifest's proofs, and what becomes of them when rows are tampered with: (id, leaf, subroot,
    root, proof_sha256, folded_root, verified). Edge cases as in ``manifest``."""
    m = manifest(docs, tampered=tampered, **more)
    id_col = m.columns[0]
    m = m.select(id_col, "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded(F.col("seen"), F.col("path")).alias("folded_root"))
    return m.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(levels: int = 5, source_levels: int = 3) -> str:
    """``verified`` of table documents as DuckDB SQL, for sources of up to 16**levels rows."""
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)"]
    value = lambda c: f"COALESCE(octet_length(encode({c})) || ':' || {c}, '-')"
    head = " || ".join(map(value, fields))
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    # crc32 bit by bit: a byte is mixed in, then -1 stands for each of its eight shifts
    steps = "flatten(list_transform(range(length(CAST(doc_id AS VARCHAR))), lambda k: [CAST(ascii(CAST(doc_id AS VARCHAR)[k + 1]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"
    parts = [
        f"leaves AS (SELECT doc_id, source, sha256({head} || {value('text')}) AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN sha256({head} || {value(low)}) END AS other FROM documents)",
        "s0 AS (SELECT *, source AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h FROM leaves)",
    ]

    def tree(name: str, levels: int) -> None:
        for k in range(levels):
            run = f"PARTITION BY tree, i // {FAN} ORDER BY i ROWS BETWEEN"
            parts.append(
                f"{name}w{k} AS (SELECT tree, i, h, count(*) OVER (PARTITION BY tree) AS n, COALESCE(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
                f"COALESCE(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})"
            )
            parts.append(f"{name}{k + 1} AS (SELECT tree, i // {FAN} AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h FROM {name}w{k} GROUP BY tree, i // {FAN})")

    tree("s", levels)
    parts.append(f"t0 AS (SELECT 0 AS tree, tree AS source, h, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i FROM s{levels})")
    tree("t", source_levels)
    names = [*(f"s{k}" for k in range(levels)), *(f"t{k}" for k in range(source_levels))]
    joins = [f"JOIN sw{k} AS {n} ON {n}.tree IS NOT DISTINCT FROM s.source AND {n}.i = s.i // {FAN**k}" for k, n in enumerate(names[:levels])]
    joins.append("JOIN t0 AS o ON o.source IS NOT DISTINCT FROM s.source")
    joins += [f"JOIN tw{k} AS {n} ON {n}.i = o.i // {FAN**k}" for k, n in enumerate(names[levels:])]
    path = " || ".join(f"CASE WHEN {n}.n > 1 THEN {n}.l || {n}.r ELSE '' END" for n in names)
    folds = ", ".join(f"CASE WHEN {n}.n > 1 THEN sha256({n}.l || f{k} || {n}.r) ELSE f{k} END AS f{k + 1}" for k, n in enumerate(names))
    parts.append(
        f"found AS (SELECT s.doc_id, s.leaf, o.h AS subroot, (SELECT h FROM t{source_levels}) AS root, sha256({path}) AS proof_sha256, COALESCE(s.other, s.leaf) AS f0, {folds} FROM s0 AS s {' '.join(joins)})"
    )
    last = f"f{len(names)}"
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, proof_sha256, {last} AS folded_root, {last} = root AS verified FROM found"
