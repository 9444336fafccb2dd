"""Hashes, pins, fingerprints and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxeval.session import cut

#: Items of a fingerprint's node, about, and its levels at most: 256^7 nodes.
LEAF_ITEMS, _LEVELS = 4096, 7
HOT_GROUPS = 10_000


def content_hash(content: Column) -> Column:
    """SHA-256 in lower-case hex of a string's UTF-8 bytes or of binary."""
    return F.sha2(content, 256)


def verify_pins(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """``ok``, ``mismatch``, ``missing`` or ``untracked`` per key; both have ``sha256``."""
    e = expected.select(key, F.col("sha256").alias("pinned"))
    a = actual.select(key, F.col("sha256").alias("found"))
    status = (
        F.when(F.col("pinned").isNull(), F.lit("untracked"))
        .when(F.col("found").isNull(), F.lit("missing"))
        .when(F.col("pinned") == F.col("found"), F.lit("ok"))
        .otherwise(F.lit("mismatch"))
    )
    return e.join(a, key, "full").withColumn("status", status)


def set_fingerprint(df: DataFrame, group: str, key: str, leaf: int = LEAF_ITEMS) -> DataFrame:
    """One digest per group over its (id, hash) list, with the number of its items.

    The list is hashed as a tree.  An item's place is the hash of its id; items
    whose places begin alike make a node, about ``leaf`` of them at most, and
    256 nodes make the next.  Small groups are one node and are done after one
    shuffle; a group 256 times as large takes one more.  A node stays small
    whatever the size of its group, and equal lists give equal digests whatever
    their order.

    Ids may have any type that can be cast to a text; equal ids may repeat.  A
    null id, hash or group is none of the others.
    """
    item = F.concat_ws(":", F.coalesce(F.col("sha256"), F.lit("-")), F.col(key).cast("string"))
    place = F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")), 256)
    items = df.select(F.col(group).alias("_group"), place.alias("_place"), F.sha2(item, 256).alias("_item"))
    sizes = df.groupBy(F.col(group).alias("_of")).agg(F.count("*").alias("n"))
    # levels below the root, each of two digits
    depth = sum((F.col("n") > F.lit(float(leaf * 256**level))).cast("int") for level in range(_LEVELS))
    sizes = cut(sizes.withColumn("_depth", depth))
    rows, deepest = sizes.agg(F.sum("n"), F.max("_depth")).first()
    # a group that holds a good part of all items is not gathered for its size; there are at most HOT_GROUPS of them
    hot = F.col("n") >= (rows or 0) / HOT_GROUPS
    same = F.col("_group").eqNullSafe(F.col("_of"))
    large, small = F.broadcast(sizes.where(hot)), sizes.where(~hot)
    sized = items.join(large, same).unionByName(items.join(large, same, "left_anti").join(small, same)).drop("_of")
    nodes = sized.select("_group", "n", F.expr("substring(_place, 1, 2 * _depth)").alias("_node"), "_place", "_item")
    for level in range(deepest or 0, -1, -1):
        # nodes of smaller groups wait for their level
        at_level = F.length("_node") == 2 * level
        waiting = nodes.where(~at_level)
        joined = nodes.where(at_level).groupBy("_group", "n", "_node").agg(
            F.array_sort(F.collect_list(F.struct("_place", "_item"))).alias("_items")
        )
        joined = joined.select(
            "_group", "n", F.expr(f"substring(_node, 1, {max(2 * level - 2, 0)})").alias("_above"), "_node",
            F.sha2(F.array_join("_items._item", ""), 256).alias("_item"),
        )
        joined = joined.select("_group", "n", F.col("_above").alias("_node"), F.col("_node").alias("_place"), "_item")
        nodes = joined if level == 0 else joined.unionByName(waiting)
    return nodes.select(F.col("_group").alias(group), F.col("_item").alias("fingerprint"), "n")


def table_diff(old: DataFrame, new: DataFrame, key: str, vector: str) -> DataFrame:
    """Per entity: equal, number of changed elements, largest absolute change."""
    o, n = old.select(key, F.col(vector).alias("_o")), new.select(key, F.col(vector).alias("_n"))
    gap = F.zip_with("_o", "_n", lambda a, b: F.abs(a - b))
    both = F.col("_o").isNotNull() & F.col("_n").isNotNull()
    return o.join(n, key, "full").select(
        key,
        F.col("_o").eqNullSafe(F.col("_n")).alias("equal"),
        F.when(both, F.size(F.filter(gap, lambda g: g.isNull() | (g > 0)))).cast("bigint").alias("changed"),
        F.when(both, F.array_max(gap)).alias("max_change"),
    )


def repeatability(df: DataFrame, keys: list[str], stable: list[str]) -> DataFrame:
    """Groups whose stable fields take more than one value.

    Field tuples are made distinct before they are counted, so a large group is
    combined map-side and never held as a set.
    """
    kinds = df.select(*keys, F.struct(*stable).alias("_s")).distinct()
    counted = kinds.groupBy(*keys).agg(F.count("*").alias("variants"))
    return counted.where(F.col("variants") > 1)


def exact_copies(df: DataFrame, key: str, content: str) -> DataFrame:
    """Contents that occur more than once: smallest id and number of copies."""
    grouped = df.groupBy(content_hash(F.col(content)).alias("sha256")).agg(
        F.min(key).alias("first_id"), F.count("*").alias("copies")
    )
    return grouped.where(F.col("copies") > 1)


def order_alignment(df: DataFrame, group: str, first: str, second: str) -> DataFrame:
    """Do two position columns put the rows of each group in the same order?"""
    same = F.col(first).eqNullSafe(F.col(second))
    return df.groupBy(group).agg(F.bool_and(same).alias("aligned"), F.count("*").alias("n"))
