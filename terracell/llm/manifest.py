"""Merkle manifest of a table: leaf digests, a tree for each group, one root, and a proof for every row.

Leaves are hashed where the rows lie and ranked within their group; only digests are shuffled. Ranks are cut
into aligned buckets of WIDTH ** HEIGHT leaves. The lowest runs of a bucket are grouped, then their nodes by
bucket, whose upper levels are arrays of digests: all in Spark's own functions, so that no Python worker takes
memory beside the executor's heap. Above the buckets there is one node for thousands of leaves: Spark groups those
level by level, and joins the outer part of each proof back to its bucket's runs. Nothing but the number of levels
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terracell.llm.common import dropped, ranked, shared_dir, written_to

#: Nodes under a parent, and levels within a bucket.
WIDTH, HEIGHT = 8, 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left:string,right:string>>"


def digest(*values: Column) -> Column:
    """Lower-case hex SHA-256 of values: `-` for null, else the count of UTF-8 bytes, a colon and the value as text."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(proof, leaf, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof as one text, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda p: F.concat(p["left"], p["right"])), "")


def levels_above(n: Column, width: int) -> Column:
    """Levels from n nodes up to one."""
    steps, k, size = [], 0, 1
    while size < 1 << 62:
        steps.append(F.when(n <= size, k))
        k, size = k + 1, size * width
    return F.coalesce(*steps, F.lit(k))


# inside a bucket


def raised(nodes: Column, width: int) -> Column:
    """The level above an array of digests: one for each run of width."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / width).cast("int"))
    return F.transform(runs, lambda r: F.sha2(F.array_join(F.slice(nodes, r * width + 1, width), ""), 256))


def beside(nodes: Column, i: Column, width: int) -> Column:
    """The siblings left and right of the node at i of an array of digests."""
    start = i - i % width
    pair = [F.array_join(x, "") for x in (F.slice(nodes, start + 1, i - start), F.slice(nodes, i + 2, start + width - 1 - i))]
    return F.struct(pair[0].alias("left"), pair[1].alias("right"))


def _bucketed(leaves: DataFrame, width: int, height: int, path: str) -> DataFrame:
    """(key, bucket, m, depth, levels), written to path: the levels of each bucket's tree above its leaves, lowest first.

    A level above depth isn't part of the tree. The one of a lone leaf is the leaf.
    """
    by = ["key", "bucket", "m", "depth"]
    runs = leaves.groupBy(*by, "run").agg(F.array_sort(F.collect_list(F.struct("pos", "leaf"))).alias("members"))
    runs = runs.select(*by, "run", F.when(F.col("depth") > 0, F.sha2(F.array_join("members.leaf", ""), 256)).otherwise(F.col("members")[0]["leaf"]).alias("h"))
    lowest = runs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("run", "h"))).alias("nodes"))
    # Each step of the fold reads the level below it once, as a bound variable.
    steps = F.array(*[F.lit(k) for k in range(1, height)]) if height > 1 else F.expr("cast(array() as array<int>)")
    levels = F.aggregate(steps, F.array(F.col("nodes.h")), lambda got, k: F.concat(got, F.array(raised(F.get(got, k - 1), width))))
    return written_to(lowest.select(*by, levels.alias("levels")), path)


def _upper(buckets: DataFrame, width: int, height: int) -> DataFrame:
    """(key, bucket, run, proof): the siblings of each lowest run's node and of its ancestors within the bucket."""
    level = lambda k: F.get("levels", F.lit(k - 1))
    pairs = lambda r: F.array(*[beside(level(k), F.floor(r / width ** (k - 1)).cast("int"), width) for k in range(1, height)]).cast(PROOF)
    run = lambda r: (F.col("bucket") * width ** (height - 1) + r).cast("long")
    proofs = F.transform(F.sequence(F.lit(0), F.size(level(1)) - 1), lambda r: F.struct(run(r).alias("run"), F.slice(pairs(r), F.lit(1), F.greatest(F.col("depth") - 1, F.lit(0))).alias("proof")))
    return buckets.select("key", "bucket", F.explode(proofs).alias("own")).select("key", "bucket", "own.run", "own.proof")


# above the buckets


def _climbed(nodes: DataFrame, width: int, name: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(key, first, proof), (key, h), and folders written: proofs of nodes (key, pos, m, h) up to their key's top, and the tops.

    m: nodes of the key; pos: the place, from 0. first is a node's pos. A run of `width` nodes is the largest group.
    """
    spark, made = nodes.sparkSession, []

    def kept(df: DataFrame, what: str) -> DataFrame:
        made.append(shared_dir(spark, f"{name}-{what}"))
        return written_to(df, made[-1])

    paths = nodes.select("key", F.col("pos").alias("first"), F.col("pos").alias("at"), F.expr(f"cast(array() as {PROOF})").alias("proof"))
    most = nodes.agg(F.max(levels_above(F.col("m"), width))).first()[0] or 0
    for _ in range(most):
        runs = nodes.groupBy("key", "m", F.expr(f"pos div {width}").alias("run")).agg(F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("members"))
        beside = runs.where("m > 1").select("key", "members", F.explode("members").alias("own")).select(
            F.col("key").alias("k"),
            F.col("own.pos").alias("p"),
            F.struct(
                F.expr("array_join(transform(filter(members, x -> x.pos < own.pos), x -> x.h), '')").alias("left"),
                F.expr("array_join(transform(filter(members, x -> x.pos > own.pos), x -> x.h), '')").alias("right"),
            ).alias("pair"),
        )
        longer = F.when(F.col("pair").isNull(), F.col("proof")).otherwise(F.concat("proof", F.array("pair")))
        paths = paths.join(beside, (F.col("key") == F.col("k")) & (F.col("at") == F.col("p")), "left").select("key", "first", F.expr(f"at div {width}").alias("at"), longer.alias("proof"))
        paths = kept(paths, "paths")
        whole = F.sha2(F.array_join("members.h", ""), 256)
        nodes = kept(runs.select("key", F.col("run").alias("pos"), F.ceil(F.col("m") / width).alias("m"), F.when(F.col("m") > 1, whole).otherwise(F.col("members")[0]["h"]).alias("h")), "nodes")
    return paths.select("key", "first", "proof"), nodes.select("key", "h"), made


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", order: str = "doc_id", width: int = WIDTH, height: int = HEIGHT, also: dict[str, Column] | None = None, name: str = "manifest") -> DataFrame:
    """(order, leaf, subroot, root, proof) for each row of docs, and what `also` takes from it (names other than these and group).

    A leaf is the digest of columns. In each group (null is one) leaves ascend by order, nulls first, equal ones
    by digest; every `width` consecutive nodes become their digest, a last run may be shorter, until one is left:
    the subroot (a lone leaf is its own). Subroots ascend by group, null first, bytewise, and give the root the
    same way. proof: array of struct(left, right) for each level from the leaf up to the root. Repeated rows are
    leaves of their own; an empty table has no rows and no root. Other columns of docs are not read.
    """
    spark, extra = docs.sparkSession, also or {}
    # A key that sorts null first and is never null, so that plain equality joins it.
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    rows = docs.select(key.alias("key"), F.col(f"`{order}`").alias("_order"), digest(*[F.col(f"`{c}`") for c in columns]).alias("leaf"), *[c.alias(f"_also_{n}") for n, c in extra.items()])
    held = shared_dir(spark, f"{name}-leaves")
    leaves = ranked(rows, ["key"], ["_order", "leaf"], f"{name}-ranks", rank="pos", total="m")
    leaves = leaves.withColumns({"bucket": F.expr(f"pos div {width**height}"), "run": F.expr(f"pos div {width}"), "depth": F.least(levels_above(F.col("m"), width), F.lit(height)).cast("int")})
    leaves = written_to(leaves, held)

    buckets = _bucketed(leaves, width, height, shared_dir(spark, f"{name}-buckets"))
    top = F.get(F.get("levels", F.greatest(F.col("depth") - 1, F.lit(0))), F.lit(0))
    nodes = buckets.select("key", F.col("bucket").alias("pos"), F.ceil(F.col("m") / width**height).alias("m"), top.alias("h"))
    inside, subroots, made = _climbed(nodes, width, f"{name}-group")
    groups = ranked(subroots.withColumn("all", F.lit("")), ["all"], ["key"], f"{name}-groups", rank="place", total="m").withColumnRenamed("h", "subroot")
    groups_at = shared_dir(spark, f"{name}-subroots")
    groups = written_to(groups, groups_at)
    above, roots, more = _climbed(groups.select(F.col("all").alias("key"), F.col("place").alias("pos"), "m", F.col("subroot").alias("h")), width, f"{name}-root")
    above = above.select(F.col("first").alias("place"), F.col("proof").alias("above"))
    outer = inside.join(groups.select("key", "place", "subroot", "all"), "key").join(above, "place").join(roots.select(F.col("key").alias("all"), F.col("h").alias("root")), "all")
    outer = outer.select("key", F.col("first").alias("bucket"), F.concat("proof", "above").alias("outer"), "subroot", "root")
    outer = written_to(outer, shared_dir(spark, f"{name}-outer"))
    for path in (groups_at, *made, *more):
        dropped(spark, path)

    above_runs = _upper(buckets, width, height).join(outer, ["key", "bucket"]).select(F.col("key").alias("_k"), F.col("run").alias("_r"), F.concat("proof", "outer").alias("above"), "subroot", "root")
    own = F.collect_list("leaf").over(Window.partitionBy("key", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    joined = leaves.withColumn("own", own).join(above_runs, (F.col("key") == F.col("_k")) & (F.col("run") == F.col("_r")))
    lowest = F.array(beside(F.col("own"), (F.col("pos") % width).cast("int"), width))
    proof = F.when(F.col("depth") > 0, F.concat(lowest, "above")).otherwise(F.col("above"))
    return joined.select(F.col("_order").alias(order), "leaf", "subroot", "root", proof.alias("proof"), *[F.col(f"_also_{n}").alias(n) for n in extra])


#: Levels by recursive queries over whole tables, apart from the buckets of the operator. CRC-32 is folded bit by bit.
ORACLE_SQL = """
WITH RECURSIVE raw AS (
  SELECT doc_id, lang, source, n_chars, text, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) AS crc FROM documents),
hashed AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS changed
  FROM (SELECT doc_id, lang, text, CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed,
      coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM raw)),
leaves AS (
  SELECT doc_id, lang, leaf, changed, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM hashed),
nodes AS (
  SELECT 0 AS level, lang, pos, leaf AS h, n FROM leaves
  UNION ALL
  SELECT level + 1, lang, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 7) // 8 FROM nodes WHERE n > 1 GROUP BY level, lang, pos // 8),
subroots AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper_nodes AS (
  SELECT 0 AS level, pos, h, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 7) // 8 FROM upper_nodes WHERE n > 1 GROUP BY level, pos // 8),
beside AS (
  SELECT level, lang, pos, {'l': coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), 'r': coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '')} AS pair
  FROM nodes WHERE n > 1 WINDOW run AS (PARTITION BY level, lang, pos // 8 ORDER BY pos)),
upper_beside AS (
  SELECT level, pos, {'l': coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), 'r': coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '')} AS pair
  FROM upper_nodes WHERE n > 1 WINDOW run AS (PARTITION BY level, pos // 8 ORDER BY pos)),
powers AS (SELECT k AS level, (8::HUGEINT ** k)::BIGINT AS size FROM range(20) r(k)),
inner_proofs AS (
  SELECT l.lang, l.pos, list(b.pair ORDER BY b.level) AS pairs FROM leaves l, powers p, beside b
  WHERE b.level = p.level AND b.lang IS NOT DISTINCT FROM l.lang AND b.pos = l.pos // p.size GROUP BY l.lang, l.pos),
outer_proofs AS (
  SELECT s.pos, list(b.pair ORDER BY b.level) AS pairs FROM subroots s, powers p, upper_beside b WHERE b.level = p.level AND b.pos = s.pos // p.size GROUP BY s.pos),
proofs AS (
  SELECT l.doc_id, l.leaf, l.changed, s.h AS subroot, (SELECT h FROM upper_nodes WHERE n = 1) AS root, list_concat(coalesce(i.pairs, []), coalesce(o.pairs, [])) AS pairs
  FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang LEFT JOIN inner_proofs i ON i.lang IS NOT DISTINCT FROM l.lang AND i.pos = l.pos LEFT JOIN outer_proofs o ON o.pos = s.pos),
folds AS (
  SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(pairs, lambda x: x.l || x.r), '')) AS proof_sha256,
    list_reduce(list_prepend({'l': changed, 'r': ''}, pairs), lambda a, x: {'l': sha256(x.l || a.l || x.r), 'r': ''}).l AS folded_root FROM proofs)
SELECT *, folded_root = root AS verified FROM folds
"""
