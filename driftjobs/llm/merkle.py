"""A Merkle manifest of a table: a tree of digests for each part, a tree over the parts, and a proof for every row.

Nodes are a table (part, level, place, digest). A proof needs the nodes beside a row's own path; which these are follows from
the row's place and the size of its part alone, so rows explode the coordinates, and a join looks them up.

Trees are made and proofs are looked up TIER levels at a time. Rows under one node share what lies above it, so only the
lowest tier is exploded for every row, the next for every ``group ** TIER``-th row, and so on: work is linear in rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftjobs.llm.common import attach, task_count, written

#: Levels that are made, or looked up, at a time. A block has ``group ** TIER`` nodes at most, whatever the table.
TIER = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:binary,after:binary>>"


def joined_hash(digests: Column) -> Column:
    """SHA-256 of digests put together as lower-case hex text. Digests are 32 bytes in tables, and any number of them lie in one value."""
    return F.unhex(F.sha2(hex_of(digests).cast("binary"), 256))


def hex_of(digest: Column | str) -> Column:
    return F.lower(F.hex(digest))


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row: for each value ``-`` if it is null, else its number of bytes as text, a colon and its text."""
    told = lambda v: F.concat(F.octet_length(v).cast("string").cast("binary"), F.lit(bytearray(b":")), v.cast("binary"))
    return F.unhex(F.sha2(F.concat(*[F.coalesce(told(v.cast("string")), F.lit(bytearray(b"-"))) for v in values]), 256))


def placed(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``rows`` (written) with ``place``: 0, 1, 2 and so on within each ``part``, by ``order``.

    Rows are sorted by range, so a large part spans many tasks. A task numbers its rows as they come, and a running
    sum over the counts of each part by task, one row each, says where a task begins.
    """
    keys = [F.col("part").asc_nulls_first(), *order]
    numbered = written(rows.repartitionByRange(task_count(rows), *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    key = F.struct("part", F.shiftright("__at", 33).alias("task"))
    counts = numbered.groupBy(key.alias("__own")).agg(F.min("__at").alias("__least"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__own.part").orderBy("__own.task")) - F.col("__n")
    shifts = written(counts.select("__own", (before - F.col("__least")).alias("__shift")))
    found = attach(numbered.withColumn("__own", key), shifts, "__own", width=3)
    return found.withColumn("place", F.col("__at") + F.col("__shift")).drop("__own", "__shift", "__at")


def _up(value: Column, group: int, levels: int) -> Column:
    """The place ``levels`` further up. Exact for tables of less than 2 ** 53 rows."""
    return F.floor(value / F.lit(group**levels)).cast("long")


def _less(size: Column, group: int, levels: int) -> Column:
    """How many nodes are left ``levels`` further up of a level of ``size``."""
    return F.ceil(size / F.lit(group**levels)).cast("long")


def _together(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(bytearray()), lambda all_, d: F.concat(all_, d))


def _raised(digests: Column, group: int) -> Column:
    """The next level of consecutive nodes that begin at a multiple of the group's size."""
    firsts = F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / group).cast("int"))
    return F.transform(firsts, lambda i: joined_hash(_together(F.slice(digests, i * group + 1, group))))


def tree(leaves: DataFrame, largest: int, group: int) -> list[DataFrame]:
    """All nodes over ``leaves`` (part, place, digest, and size: leaves of the part): a table for each tier, its lowest level first.

    Each has ``level`` and ``size``, the nodes of its level in its part; the node whose size is 1 is a part's root.
    ``largest`` is the greatest size. A block of a tier is one row of bounded arrays while its levels are made.
    """
    tiers = [leaves.select("part", F.lit(0).alias("level"), "place", "size", "digest")]
    while largest > 1:
        low = TIER * (len(tiers) - 1)
        lowest = tiers[-1].where((F.col("level") == low) & (F.col("size") > 1))
        blocks = lowest.groupBy("part", "size", _up(F.col("place"), group, TIER).alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("nodes"))
        grown = F.transform("nodes", lambda x: x["digest"])
        steps = F.array(*[F.struct(F.lit(k).alias("k"), _less(F.col("size"), group, k - 1).alias("below")) for k in range(1, TIER + 1)])
        step = lambda made, s: F.when(s["below"] > 1, F.concat(made, F.array(_raised(F.element_at(made, -1), group)))).otherwise(made)
        made = blocks.select("part", "size", "block", F.posexplode(F.aggregate(steps, F.array(grown), step)).alias("k", "digests")).where("k > 0")
        power = lambda e: F.element_at(F.array(*[F.lit(group**e_) for e_ in range(TIER + 1)]), e + 1)
        nodes = made.select("part", (F.col("k") + low).alias("level"), (F.col("block") * power(TIER - F.col("k"))).alias("first"), F.ceil(F.col("size") / power(F.col("k"))).cast("long").alias("size"), F.posexplode("digests").alias("i", "digest"))
        tiers.append(written(nodes.select("part", "level", (F.col("first") + F.col("i")).alias("place"), "size", "digest")))
        largest = -(-largest // group**TIER)
    return tiers


def _own_paths(rows: DataFrame, nodes: DataFrame, low: int, group: int) -> DataFrame:
    """For each of ``rows`` (part, place, size, and ``kept``, a struct of what else it has) the siblings in the tier that begins at level ``low``."""
    at = [F.struct(F.lit(low + k).alias("level"), _up(F.col("place"), group, k).alias("own"), _less(F.col("size"), group, k).alias("end")) for k in range(TIER)]
    wanted = rows.select("part", "place", F.explode(F.filter(F.array(*at), lambda x: x["end"] > 1)).alias("x")).select("part", "place", "x.*")
    first = F.col("own") - F.pmod("own", F.lit(group))
    wanted = wanted.withColumn("sibling", F.explode(F.sequence(first, F.least(first + group, F.col("end")) - 1))).where("sibling <> own")
    there = nodes.select("part", "level", F.col("place").alias("sibling"), "digest")
    found = wanted.join(there, ["part", "level", "sibling"]).select("part", "place", F.struct("level", "sibling", (F.col("sibling") < F.col("own")).alias("left"), "digest").alias("beside"))
    block = _up(F.col("place"), group, TIER).alias("block")
    both = rows.select("part", "place", block, "kept", "size").unionByName(found.select("part", "place", block, "beside"), allowMissingColumns=True)
    lists = both.repartition("part", "block").groupBy("part", "block", "place").agg(F.first("kept", ignorenulls=True).alias("kept"), F.max("size").alias("size"), F.sort_array(F.collect_list("beside")).alias("beside"))
    levels = F.filter(F.array(*[F.struct(F.lit(low + k).alias("level"), _less(F.col("size"), group, k).alias("end")) for k in range(TIER)]), lambda x: x["end"] > 1)
    side = lambda level, left: _together(F.transform(F.filter("beside", lambda b: (b["level"] == level) & (b["left"] == F.lit(left))), lambda b: b["digest"]))
    return lists.select("part", "block", "place", "kept", F.transform(levels, lambda x: F.struct(side(x["level"], True).alias("before"), side(x["level"], False).alias("after"))).alias("path"))


def paths(leaves: DataFrame, tiers: Sequence[DataFrame], group: int) -> DataFrame:
    """(part, place, kept, path) for each of ``leaves``, which has a struct ``kept``: for each level up to its part's root what lies before and after."""
    nodes = reduce(DataFrame.unionByName, tiers)
    above = None
    for t in reversed(range(len(tiers))):
        low = TIER * t
        rows = leaves if t == 0 else tiers[t].where((F.col("level") == low) & (F.col("size") > 1)).withColumn("kept", F.lit(None).cast("struct<none:int>"))
        own = _own_paths(rows, nodes, low, group)
        if above is not None:
            higher = above.select("part", F.col("place").alias("block"), F.col("path").alias("__above"))
            own = own.join(higher, ["part", "block"], "left").withColumn("path", F.concat("path", F.coalesce("__above", F.array().cast(PATH))))
        above = own.select("part", "place", "kept", "path")
        above = above if t == 0 else written(above)
    return above


def folded(start: Column, path: Column) -> Column:
    """The root that a proof leads to from a digest."""
    return F.aggregate(path, start, lambda d, x: joined_hash(F.concat(x["before"], d, x["after"])))


def proof_text(path: Column) -> Column:
    """The siblings of a proof in hex, level by level, from left to right."""
    return F.array_join(F.transform(path, lambda x: hex_of(F.concat(x["before"], x["after"]))), "")


def merkle_proofs(docs: DataFrame, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", part_col: str = "lang", group: int = 2, changed: Mapping[str, Column] | None = None) -> DataFrame:
    """One row for each row of ``docs``: its id and part, ``leaf``, ``subroot``, ``root``, ``proof`` (PATH), ``folded_root`` and ``verified``.

    A leaf is the digest of a row's ``columns``; ``changed`` says what some of them may hold by now: ``folded_root`` starts from
    a row's leaf as it is now, with the siblings as they were. Within a part leaves are in order of the id (nulls
    first), those of one id in order of their digests; parts are in order of their bytes, null first. Every ``group``
    consecutive nodes make one of the next level, also where fewer are left, until one is left.

    Null and empty values differ. Rows alike are leaves of their own. Bytes that aren't UTF-8 are hashed as they are. An empty
    table has no rows. Other columns don't count.
    """
    values = {c: F.col(f"`{c}`") for c in columns}
    now = leaf([(changed or {}).get(c, v) for c, v in values.items()])
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{part_col}`").alias("part"), leaf(list(values.values())).alias("digest"), (now if changed else F.lit(None).cast("binary")).alias("now"))
    rows = written(rows)
    numbered = placed(rows, [F.col("id").asc_nulls_first(), F.col("digest")])
    sizes = written(numbered.groupBy("part").agg(F.count(F.lit(1)).alias("size")))
    order = [F.col("name").asc_nulls_first()]
    parts = written(placed(written(sizes.select(F.lit(0).alias("part"), F.col("part").alias("name"), "size")), order).select(F.col("name").alias("part"), F.col("place").alias("no"), "size"))
    bounds = parts.agg(F.max("size"), F.count(F.lit(1))).first()
    leaves = attach(numbered, parts, "part", width=4).select(F.col("no").alias("part"), "place", "size", "digest", F.struct("id", F.col("part").alias("name"), "digest", "now").alias("kept"))
    tiers = tree(leaves, bounds[0] or 0, group)
    subroots = written(reduce(DataFrame.unionByName, tiers).where("size = 1").select("part", "digest"))
    tops = subroots.select(F.lit(0).alias("part"), F.col("part").alias("place"), F.lit(bounds[1]).cast("long").alias("size"), "digest", F.struct("digest").alias("kept"))
    top_tiers = tree(tops, bounds[1], group)
    root = reduce(DataFrame.unionByName, top_tiers).where("size = 1").select("digest").first()
    top = written(paths(tops, top_tiers, group).select(F.col("place").alias("part"), F.col("kept.digest").alias("__subroot"), F.col("path").alias("__top")))
    found = attach(paths(leaves, tiers, group), top, "part", width=64 * group)
    path = F.concat("path", "__top")
    found = found.select(
        F.col("kept.id").alias(id_col),
        F.col("kept.name").alias(part_col),
        F.col("kept.digest").alias("leaf"),
        F.col("__subroot").alias("subroot"),
        F.lit(bytearray(root[0]) if root else None).cast("binary").alias("root"),
        path.alias("proof"),
        F.coalesce("kept.now", "kept.digest").alias("__start"),
    )
    found = found.withColumn("folded_root", folded(F.col("__start"), F.col("proof"))).drop("__start")
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
