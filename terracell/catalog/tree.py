"""Trees of documents of any depth, from a table of nodes: where each lies, and its links under any base.

A node has an id, its parent's (NULL for the root) and a kind. Levels are joined one after the other by a recursive
query, so catalogs may be nested as deep as they like.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed names: a node's file by its kind, and how its parent calls it.
FILES = {"catalog": "catalog.json", "collection": "collection.json", "item": "item.json"}
RELATIONS = {"catalog": "child", "collection": "child", "item": "item"}
#: Levels beyond which a tree is taken for a cycle.
DEEPEST = 1000


def paths(nodes: DataFrame) -> DataFrame:
    """nodes (id, parent, kind) with depth, folder (ids below the root, with slashes; empty for the root), root (the kind of their root) and path (of the file, below a base).

    Nodes that no root leads to are not there; see unreached().
    """
    return nodes.sparkSession.sql(
        f"""WITH RECURSIVE reached(id, parent, kind, depth, folder, root) MAX RECURSION LEVEL {DEEPEST} AS (
              SELECT id, parent, kind, 0, CAST('' AS STRING), kind FROM {{nodes}} WHERE parent IS NULL
              UNION ALL
              SELECT n.id, n.parent, n.kind, r.depth + 1, concat(r.folder, n.id, '/'), r.root FROM {{nodes}} n JOIN reached r ON n.parent = r.id)
            SELECT id, parent, kind, depth, folder, root FROM reached""",
        nodes=nodes.select("id", "parent", "kind"),
    ).withColumn("path", F.concat("folder", _one_of(FILES, F.col("kind"))))


def _one_of(names: dict[str, str], key: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, name in names.items():
        out = F.when(key == kind, name).otherwise(out)
    return out


def unreached(nodes: DataFrame) -> DataFrame:
    """Nodes that no root leads to: their parents are missing, or they go round in a cycle."""
    return nodes.join(paths(nodes).select(F.col("id").alias("_i")), F.col("id") == F.col("_i"), "left_anti")


def links(located: DataFrame, base: str) -> DataFrame:
    """(id, rel, href): a node's links to itself, the root, its parent and its children, absolute under a base. located: paths()."""
    at = lambda c: F.concat(F.lit(f"{base.rstrip('/')}/"), c)
    up = located.select(F.col("id").alias("_p"), at(F.col("path")).alias("_up"))
    rows = located.join(up, F.col("parent") == F.col("_p"), "left")
    own = F.array(*[F.struct(F.lit(rel).alias("rel"), href.alias("href")) for rel, href in (("self", at(F.col("path"))), ("root", at(_one_of(FILES, F.col("root")))), ("parent", F.col("_up")))])
    down = located.where("parent is not null").select(F.col("parent").alias("id"), _one_of(RELATIONS, F.col("kind")).alias("rel"), at(F.col("path")).alias("href"))
    return rows.select("id", F.explode(own).alias("l")).select("id", "l.rel", "l.href").where("href is not null").unionByName(down)


def documents(nodes: DataFrame, bodies: list[DataFrame], write_base: str, publish_base: str | None = None) -> DataFrame:
    """(path, body): where each node's file is written, under one base, and its JSON, with links under another.

    bodies: tables (id, body) of structs that have links, one for each kind of body. The tree's links stand first, what
    a body links to itself behind them. The files' places and their links come from the same rows, so the two trees
    can't differ. Nodes without a body have no file.
    """
    located, out = paths(nodes), None
    tree = links(located, publish_base or write_base).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rel", "href"))).alias("_links"))
    rows = located.join(tree, "id").select("id", F.concat(F.lit(f"{write_base.rstrip('/')}/"), "path").alias("path"), "_links")
    for kind in bodies:
        own = F.transform("_links", lambda x: F.struct(x["rel"].alias("rel"), x["href"].alias("href"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("title")))
        part = rows.join(kind, "id").select("path", F.to_json(F.col("body").withField("links", F.concat(own, "body.links"))).alias("body"))
        out = part if out is None else out.unionByName(part)
    return out
