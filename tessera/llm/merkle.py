"""Merkle manifest of a dataset: a tree of SHA-256 digests for each group, and one over the groups' roots.

A row's leaf is the digest of its fields, each told with its length, so that no two rows of different fields are
hashed alike. A group's leaves ascend by id; every ``FAN`` consecutive nodes (the last run may be shorter, even one)
become one, until one is left, the group's subroot; subroots, ordered by group, become the root in the same way.

Places come from a sort by range over all tasks (``common.ordered_places``), so a group that holds a third of all
rows is spread like any other. Blocks of ``FAN ** LEVELS`` consecutive nodes are collapsed as ordered arrays by
sequence, transform, slice and aggregate; the blocks' roots are nodes again, until each group has one. The number of
such rounds is the logarithm of the rows to the base of a block; the driver sees one number a round. On the way
back each node gets the path of its block's root, so a leaf's path is put together without a join of leaves.

Defined cases: a null field is hashed as ``-``, an empty one as ``0:``; rows of a null group come first and form a
group; null ids come first in theirs; rows that share an id are ordered by leaf, and which of equal rows gets which
of their places makes no difference to the result as a whole; texts of any length are hashed whole; an empty table
gives no rows; columns that are not named as fields are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, ordered_places

FAN = 3
#: Levels that one block collapses: 729 nodes.
LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(fields: list[Column]) -> Column:
    """The digest of the fields, each its count of UTF-8 bytes, a colon and its value, or ``-`` if it is null."""
    told = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return digest(*[told(c.cast("string")) for c in fields])


def collapsed(nodes: Column, levels: Column) -> Column:
    """The levels above an ordered array of digests, themselves first: ``levels`` of them, each of every FAN nodes below."""

    def above(low: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(low) - 1) / FAN).cast("int"))
        return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(low, i * FAN + 1, FAN), ""), 256))

    steps = F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(nodes), lambda acc, _: F.concat(acc, F.array(above(F.element_at(acc, -1)))))


def path(levels: Column, at: Column) -> Column:
    """For the node at ``at`` of the lowest of ``levels``: what stands left and right of it in each run up to the block's root."""
    below = F.slice(levels, 1, F.greatest(F.size(levels) - 1, F.lit(0)))

    def run(nodes: Column, level: Column) -> Column:
        here = F.floor(at / F.pow(F.lit(FAN), level)).cast("int")
        start = here - here % FAN
        left = F.array_join(F.slice(nodes, start + 1, here % FAN), "")
        right = F.array_join(F.slice(nodes, here + 2, FAN - 1 - here % FAN), "")
        return F.struct(left.alias("left"), right.alias("right"))

    return F.transform(below, run)


def blocks(nodes: DataFrame, groups: list[str]) -> DataFrame:
    """Blocks of consecutive nodes (groups, place, group_rows, node, more): their members in order, their ``levels``,
    their number and how many blocks the group has."""
    block = FAN**LEVELS
    more = [c for c in nodes.columns if c not in (*groups, "place", "group_rows")]
    out = nodes.groupBy(*groups, F.floor(F.col("place") / block).alias("block")).agg(F.max("group_rows").alias("_rows"), F.array_sort(F.collect_list(F.struct("place", *more))).alias("members"))
    # levels left until the group has one node: the largest power of FAN below its rows, and one
    left = sum((F.when(F.col("_rows") > FAN**k, 1).otherwise(0) for k in range(LEVELS)), F.lit(0))
    out = out.withColumn("levels", collapsed(F.transform("members", lambda m: m["node"]), left.cast("int")))
    return out.select(*groups, "block", F.ceil(F.col("_rows") / block).alias("n_blocks"), "members", "levels")


def grown(nodes: DataFrame, groups: list[str]) -> list[DataFrame]:
    """Rounds of ``blocks`` of nodes (groups, place, group_rows, node, more); the last has one row a group."""
    rounds = [durable(blocks(nodes, groups))]
    while rounds[-1].where("n_blocks > 1").limit(1).count():
        up = rounds[-1].select(*groups, F.col("block").alias("place"), F.col("n_blocks").alias("group_rows"), F.element_at("levels", -1)[0].alias("node"))
        rounds.append(durable(blocks(up, groups)))
    return rounds


def same(groups: list[str], other: str) -> Column:
    return reduce(and_, [F.col(g).eqNullSafe(F.col(f"{other}{g}")) for g in groups])


def proven(rounds: list[DataFrame], groups: list[str], above: DataFrame) -> DataFrame:
    """The nodes that ``grown`` got, with their ``path``; ``above`` (groups, path, more) has a row for each group,
    the path of its root, and what else its nodes shall carry."""
    carried = [c for c in above.columns if c not in (*groups, "path")]
    above = above.withColumn("place", F.lit(0).cast("bigint"))
    for low in reversed(rounds):
        told = above.select(*[F.col(g).alias(f"_of_{g}") for g in groups], F.col("place").alias("_block"), F.col("path").alias("_up"), *carried)
        each = low.join(told, (F.col("block") == F.col("_block")) & same(groups, "_of_"))
        each = each.select(*groups, *carried, "_up", "levels", "block", F.explode("members").alias("m"))
        at = (F.col("m.place") - F.col("block") * FAN**LEVELS).cast("int")
        above = each.select(*groups, *carried, "m.*", F.concat(path(F.col("levels"), at), F.col("_up")).alias("path"))
    return above


def siblings(steps: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf gives with the siblings of its path."""
    return F.aggregate(steps, start, lambda acc, s: digest(s["left"], acc, s["right"]))


def manifest(docs: DataFrame, claims: dict[str, Column] | None = None, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, leaf, subroot, root, path, claimed) of every row; ``claimed`` is the leaf of the row as it is claimed to
    be: ``claims`` gives the claimed values of fields, others are as they are."""
    held = {f: F.col(f) for f in fields}
    leaves = docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("branch"), leaf([*held.values()]).alias("node"), leaf([*(held | (claims or {})).values()]).alias("claimed"))
    rounds = grown(ordered_places(durable(leaves), ["branch"], [F.col("id").asc_nulls_first(), F.col("node")]), ["branch"])
    subroots = rounds[-1].select("branch", F.element_at("levels", -1)[0].alias("node"), F.lit(0).alias("forest"))
    trees = grown(ordered_places(subroots, ["forest"], [F.col("branch").asc_nulls_first()]), ["forest"])
    top = trees[-1].select("forest", F.element_at("levels", -1)[0].alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    tops = proven(trees, ["forest"], top).select("branch", F.col("node").alias("subroot"), "root", "path")
    return proven(rounds, ["branch"], tops).select(F.col("id").alias(id_col), F.col("node").alias("leaf"), "subroot", "root", "path", "claimed")


def checked(rows: DataFrame) -> DataFrame:
    """``manifest``'s rows with the digest of their siblings, the root that their claimed leaf gives, and whether it is the root."""
    out = rows.withColumn("proof_sha256", F.sha2(siblings(F.col("path")), 256)).withColumn("folded_root", folded(F.col("claimed"), F.col("path")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).drop("path", "claimed")
