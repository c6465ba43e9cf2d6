"""Questions to the catalog. All of them are queries on its flat tables; no tree is walked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from terracell.catalog.tables import Catalog


def titled(df: DataFrame, key: str) -> DataFrame:
    """(key, title), the key where there is no title."""
    return df.select(key, F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col(key).cast("string")).alias("title"))


def themes(catalog: Catalog) -> DataFrame:
    return titled(catalog.themes, "theme_id").orderBy("theme_id")


def theme(catalog: Catalog, theme_id: str) -> Row | None:
    return titled(catalog.themes.where(F.col("theme_id") == theme_id), "theme_id").first()


def collections(catalog: Catalog, theme_id: str) -> DataFrame:
    """Collections of a theme; ValueError without a theme, KeyError for an unknown one, both naming those there are."""
    if not theme_id:
        raise ValueError(f"a theme is needed, one of {_names(catalog.themes, 'theme_id')}")
    if theme(catalog, theme_id) is None:
        raise KeyError(f"no theme {theme_id!r}; there are {_names(catalog.themes, 'theme_id')}")
    return titled(in_theme(catalog.collections, catalog.themes.where(F.col("theme_id") == theme_id), "theme_id"), "collection_id").orderBy("collection_id")


def in_theme(rows: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    return rows.join(chosen.select(key), key, "left_semi")


def version_lists(items: DataFrame, key: str, version: str) -> DataFrame:
    """(key, versions, n_versions): the sorted distinct versions of each collection."""
    return items.groupBy(key).agg(F.array_sort(F.collect_set(version)).alias("versions"), F.countDistinct(version).alias("n_versions"))


def collections_table(catalog: Catalog, theme_id: str) -> DataFrame:
    return collections(catalog, theme_id).join(version_lists(catalog.items, "collection_id", "version"), "collection_id", "left").withColumn("n_versions", F.coalesce("n_versions", F.lit(0))).orderBy("collection_id")


def ids(df: DataFrame, key: str) -> DataFrame:
    """The distinct values of a key, in order."""
    return df.select(key).distinct().orderBy(key)


def collection_ids(catalog: Catalog) -> DataFrame:
    """All collections' ids, in order."""
    return ids(catalog.collections, "collection_id")


def version_key(version: Column) -> Column:
    """Sorts versions as numbers part by part; those with another part come after, as text."""
    parts = F.split(version, r"\.")
    numeric = version.rlike(r"^\d+(\.\d+)*$")
    return F.struct((~numeric).alias("text"), F.when(numeric, F.transform(parts, lambda p: p.cast("bigint"))).alias("numbers"), version.alias("version"))


def version_of(item_id: Column, collection_id: Column, version: Column) -> Column:
    """The version that an item states, or else what follows collection_v in its id."""
    head = F.concat(collection_id, F.lit("_v"))
    return F.coalesce(version, F.when(item_id.startswith(head), F.substring(item_id, F.length(head) + 1, F.length(item_id))))


def versions(catalog: Catalog, collection_id: str, asset_key: str | None = None) -> DataFrame:
    """Distinct versions of a collection, in numeric order; with asset_key, of items that have it."""
    rows = catalog.items.where(F.col("collection_id") == collection_id)
    if asset_key is not None:
        rows = rows.join(catalog.assets.where(F.col("asset_key") == asset_key).select("item_id"), "item_id", "left_semi")
    found = rows.select(version_of(F.col("item_id"), F.col("collection_id"), F.col("version")).alias("version")).where("version is not null").distinct()
    return found.orderBy(version_key(F.col("version")))


def collection(catalog: Catalog, collection_id: str) -> Row:
    row = catalog.collections.where(F.col("collection_id") == collection_id).first()
    if row is None:
        raise KeyError(f"no collection {collection_id!r}; there are {_names(catalog.collections, 'collection_id')}")
    return row


def items(catalog: Catalog, collection_id: str) -> DataFrame:
    collection(catalog, collection_id)
    return catalog.items.where(F.col("collection_id") == collection_id).orderBy("item_id")


def item(catalog: Catalog, collection_id: str, item_id: str) -> Row:
    rows = items(catalog, collection_id)
    row = rows.where(F.col("item_id") == item_id).first()
    if row is None:
        raise KeyError(f"no item {item_id!r} in {collection_id}; there are {_names(rows, 'item_id')}")
    return row


def _names(df: DataFrame, key: str, most: int = 50) -> list[str]:
    return [r[0] for r in df.select(key).distinct().orderBy(key).take(most)]


def containing(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows in which any of the columns contains a text, whatever the case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())), F.lit(False))
    return df.where(hit)
