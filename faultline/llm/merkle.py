"""Merkle manifest of a dataset: a hash tree per source, and one over the sources, by lag and lead windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ORACLE, materialize, query, table
from ..functions.ordering import number_rows

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node; levels computed in one pass over windows of SPAN leaves.
FAN, LEVELS = 3, 7
SPAN = FAN**LEVELS
#: Sources up to which their table goes to every task; with more, Spark shuffles and splits skewed ones.
MAX_BROADCAST = 200_000
PATH = "array<struct<before: binary, after: binary>>"


def digest(text: Column) -> Column:
    """SHA-256 as bytes; `text` is a string, hashed as UTF-8."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def hexed(value: Column) -> Column:
    """Bytes, none for null, as lower-case hex text."""
    return F.coalesce(F.lower(F.hex(value)), F.lit(""))


def leaf(fields: list[Column]) -> Column:
    """Digest of a row: each value as UTF-8 byte count, `:` and text, or `-` where null, one after another."""
    texts = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and the siblings of a manifest's path give."""
    return F.aggregate(path, start, lambda at, step: digest(F.concat(hexed(step["before"]), hexed(at), hexed(step["after"]))))


def proof_text(path: Column) -> Column:
    """All siblings of a path as hex text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(hexed(step["before"]), hexed(step["after"]))), "")


def raise_levels(nodes: DataFrame) -> DataFrame:
    """`nodes` (tree, pos, n, h) with `top`, the digest LEVELS levels up at each SPAN-th row, and `path`, its siblings.

    Rows are put once into windows of SPAN consecutive leaves. On each level a node stands in the row of
    its first leaf, so its neighbours are a fixed number of rows away: slot and run length tell which of
    them are siblings, and the first child hashes the parent. The other leaves take over the siblings
    found in their node's row. A tree whose nodes have come to one stays as it is.
    """
    window = Window.partitionBy("tree", "span").orderBy("pos")
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Dealt by tree and span: a plan dealt by tree alone would do for the windows, with a source in one task.
    rows = nodes.withColumn("span", F.floor(F.col("pos") / SPAN)).repartition("tree", "span").withColumn("top", F.col("h"))
    none = F.lit(b"")
    for level in range(LEVELS):
        step = FAN**level
        slot = F.floor(F.col("pos") / step) % FAN
        here = (F.col("n") > step) & (F.col("pos") % step == 0)
        rows = rows.withColumns({f"_back{i}": F.lag("top", i * step).over(window) for i in range(1, FAN)}
                                | {f"_on{i}": F.lead("top", i * step).over(window) for i in range(1, FAN)})
        before = F.concat(*[F.when(slot >= i, F.col(f"_back{i}")).otherwise(none) for i in range(FAN - 1, 0, -1)])
        after = F.concat(*[F.when(slot + i < FAN, F.coalesce(f"_on{i}", none)).otherwise(none) for i in range(1, FAN)])
        rows = rows.withColumn(f"_s{level}", F.when(here, F.struct(before.alias("before"), after.alias("after"))))
        parent = digest(F.concat(hexed(F.col("top")), hexed(F.col(f"_s{level}.after"))))
        rows = rows.withColumn("top", F.when(here & (slot == 0), parent).otherwise(F.col("top")))
        if level:
            spread = F.last(f"_s{level}", ignorenulls=True).over(upto)
            rows = rows.withColumn(f"_s{level}", F.when(F.col("n") > step, spread))
    path = F.array_compact(F.array(*[f"_s{level}" for level in range(LEVELS)])).cast(PATH)
    return rows.select(*nodes.columns, "span", "top", path.alias("path"))


def climb(nodes: DataFrame, most: int, finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`nodes` (tree, pos, n, h, ...) with the path to the end, and what `finish` says of their tree.

    n is the number of leaves of the tree, `most` the largest n. `finish` gets one row per tree (tree, h)
    and returns it with a `path` beyond, and more columns.
    """
    if most <= 1:
        return finish(nodes.select("tree", "h"))
    rows = materialize(raise_levels(nodes), "merkle-levels")
    upper = rows.filter(F.col("pos") % SPAN == 0).select("tree", F.col("span").alias("pos"), F.ceil(F.col("n") / SPAN).alias("n"), F.col("top").alias("h"))
    fewer = -(-most // SPAN)
    ends = climb(upper, fewer, finish)
    if fewer <= 1:
        ends = ends.withColumn("pos", F.lit(0).cast("bigint"))
    ends = ends.select("tree", F.col("pos").alias("span"), F.col("path").alias("rest"), *[c for c in ends.columns if c in ("subroot", "root")])
    joined = rows.join(ends, ["tree", "span"])
    return joined.select(*nodes.columns, F.concat("path", "rest").alias("path"), *[c for c in ends.columns if c in ("subroot", "root")])


def over_sources(sources: DataFrame) -> DataFrame:
    """Trees (tree, h) with subroot, root and the path from the one to the other; trees in order of `tree`."""
    sources = materialize(sources, "merkle-sources")
    count = sources.count()
    leaves = number_rows(sources, ["tree"], "pos").select(
        F.lit("").alias("tree"), "pos", F.lit(count).cast("bigint").alias("n"), "h", F.col("tree").alias("name"))

    def root(top: DataFrame) -> DataFrame:
        return top.select("tree", F.array().cast(PATH).alias("path"), F.col("h").alias("root"))

    if count <= 1:
        return sources.select("tree", F.array().cast(PATH).alias("path"), F.col("h").alias("subroot"), F.col("h").alias("root"))
    return climb(leaves, count, root).select(F.col("name").alias("tree"), "path", F.col("h").alias("subroot"), "root")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, source: str = "source", key: str = "doc_id",
             carry: dict[str, Column] | None = None) -> DataFrame:
    """key, source, leaf, path, subroot, root of every row of `docs`, and the columns of `carry`.

    A row's leaf is the digest of its `fields`, null or not. The leaves of a source, by key, are the
    lowest level of its tree: three consecutive nodes become one on the next level, the last ones also
    if they are two or one, until one is left, the subroot. Subroots in order of their source, null
    first, then UTF-8 bytewise, become the root in the same way. `path` holds for each level the digests
    of the siblings before and after, from the leaf to the root: fold(leaf, path) is the root.

    A null key comes first. Rows of one key lie in the order of their leaves; equal rows are leaves each.
    A null source is a source, other than the empty string. An empty table gives no rows and has no
    root; other columns are ignored. Digests are binary. A source's leaves are spread over windows of
    2,187, and no later step gathers more than that of any source.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    extra = carry or {}
    rows = docs.select(tree.alias("tree"), F.col(key).alias("key"), leaf([F.col(f) for f in fields]).alias("h"),
                       *[c.alias(f"c_{name}") for name, c in extra.items()])
    rows = materialize(rows, "merkle-leaves")
    numbered = materialize(number_rows(rows, ["tree", "key", "h"], "at"), "merkle-order")
    trees = materialize(numbered.groupBy("tree").agg(F.min("at").alias("start"), F.count("*").alias("n")), "merkle-trees")
    count, most = trees.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    leaves = numbered.join(F.broadcast(trees) if count <= MAX_BROADCAST else trees, "tree").withColumn("pos", F.col("at") - F.col("start")).drop("at", "start")
    names = [F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)).alias("source"), F.col("h").alias("leaf")]
    if most <= 1:
        ends = over_sources(leaves.select("tree", "h"))
        done = leaves.join(ends, "tree")
    else:
        done = climb(leaves, most, over_sources)
    return done.select(F.col("key").alias(key), *names, "path", "subroot", "root", *[F.col(f"c_{name}").alias(name) for name in extra])


def verified(rows: DataFrame, now: Column) -> DataFrame:
    """Rows of a manifest with folded_root, what `now`, a leaf computed anew, gives by the path, and verified."""
    return rows.withColumn("folded_root", fold(now, F.col("path"))).withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op11_window_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    changed = F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    now = leaf([changed if f == "text" else F.col(f) for f in FIELDS])
    rows = verified(manifest(docs, carry={"now": now}), F.col("now"))
    texts = {c: hexed(F.col(c)) for c in ("leaf", "subroot", "root", "folded_root")}
    return rows.select("doc_id", texts["leaf"].alias("leaf"), texts["subroot"].alias("subroot"), texts["root"].alias("root"),
                       F.sha2(proof_text(F.col("path")).cast("binary"), 256).alias("proof_sha256"),
                       texts["folded_root"].alias("folded_root"), "verified")


_CRC = ("list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT), "
        "lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], "
        "lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))")


def _leaf_sql(text: str) -> str:
    return "sha256(concat(" + ", ".join(
        f"CASE WHEN {f} IS NULL THEN '-' ELSE concat(strlen(({f})::VARCHAR), ':', {f}) END"
        for f in ("doc_id", "source", "lang", "n_chars", text)) + "))"


ORACLE["op11_window_merkle_manifest"] = f"""
WITH RECURSIVE docs AS (SELECT *, coalesce(xor({_CRC}, 4294967295) % 2 = 0, false) AS hit FROM documents),
leaves AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf_sql("text")} AS leaf,
    CASE WHEN hit THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS now FROM docs),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
low AS (SELECT 0 AS level, tree, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM placed UNION ALL
    SELECT any_value(level) + 1, tree, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3)
    FROM low WHERE n > 1 GROUP BY tree, pos // 3),
subroots AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos FROM low WHERE n = 1),
high AS (SELECT 0 AS level, pos, h, count(*) OVER () AS n FROM subroots UNION ALL
    SELECT any_value(level) + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3) FROM high WHERE n > 1 GROUP BY pos // 3),
every AS (SELECT tree, level, pos, h, n FROM low WHERE n > 1 UNION ALL SELECT '#', level, pos, h, n FROM high WHERE n > 1),
steps AS (SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lh,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS rh
    FROM every a JOIN every b ON a.tree = b.tree AND a.level = b.level AND a.pos // 3 = b.pos // 3 GROUP BY a.tree, a.level, a.pos),
walk AS (SELECT p.doc_id, p.tree, p.pos, 0 AS k, p.tree AS t, 0::BIGINT AS level, p.pos AS at, p.now AS f, '' AS proof,
    (SELECT max(level) + 1 FROM steps s WHERE s.tree = p.tree) AS height FROM placed p UNION ALL
    SELECT w.doc_id, w.tree, w.pos, k + 1, CASE WHEN s.tree IS NULL THEN '#' ELSE t END, CASE WHEN s.tree IS NULL THEN 0 ELSE w.level + 1 END,
    CASE WHEN s.tree IS NULL THEN r.pos ELSE w.at // 3 END, CASE WHEN s.tree IS NULL THEN f ELSE sha256(s.lh || f || s.rh) END,
    CASE WHEN s.tree IS NULL THEN proof ELSE proof || s.lh || s.rh END, height
    FROM walk w JOIN subroots r ON r.tree = w.tree LEFT JOIN steps s ON s.tree = w.t AND s.level = w.level AND s.pos = w.at
    WHERE s.tree IS NOT NULL OR w.t <> '#'),
ends AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY tree, pos ORDER BY k DESC) = 1)
SELECT e.doc_id, p.leaf, r.h AS subroot, (SELECT h FROM high WHERE n = 1) AS root, sha256(proof) AS proof_sha256, f AS folded_root,
    f = (SELECT h FROM high WHERE n = 1) AS verified
FROM ends e JOIN placed p ON p.tree = e.tree AND p.pos = e.pos JOIN subroots r ON r.tree = e.tree"""
