"""Links between rows that share a bucket, and connected components, at any bucket size.

No bucket is expanded into all pairs.  First every member is compared with
its bucket's first member only (one pair per member), and the links found so
far are contracted into components.  Then only buckets whose members lie in
two or more components are searched for pairs across components.  One member
of such a pair is outside the bucket's largest component, so blocks of those
members meet blocks of all members; every pair of blocks is a unit of work of
its own.  A first search lets every member name one partner at most, and its
links are contracted; a second one names every pair that is left.  A pair is
named in its first common bucket only.  No pair of a bucket escapes: a pair is
compared, or its two members are already in one component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_arrow

#: Members of a bucket that are searched together.
BUCKET = 4096
#: Rows and bytes that a task holds while it searches, unless one unit is larger.
HELD, HELD_BYTES = 1 << 15, 1 << 26
#: Edges up to which one task finds all components (it holds about 100 bytes for each).
CONTRACTED = 1 << 20
#: Bytes of a side that may be broadcast, as estimated from its rows; beyond it the join shuffles.
BROADCAST_BYTES = 24 << 20


def sized(small: DataFrame, width: Column | int = 48) -> DataFrame:
    """A kept table, marked for broadcast if the sum of its rows' widths in bytes is within the bound."""
    total = small.agg(F.sum(F.lit(width) if isinstance(width, int) else width)).first()[0]
    return F.broadcast(small) if (total or 0) <= BROADCAST_BYTES else small


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes of the edges (a, b), the smallest node that each is connected with)."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    x, y = place[: len(a)], place[len(a) :]
    while len(x):  # both ends are roots
        x, y = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(label, y, x)
        while (label[label] != label).any():
            label = label[label]
        x, y = label[x], label[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[label]


def contracted(edges: DataFrame) -> DataFrame:
    """(node, component) of kept edges (a, b), in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if ends:
            node, component = smallest(*(np.concatenate(x) for x in zip(*ends)))
            for k in range(0, len(node), HELD):
                yield pa.RecordBatch.from_arrays([pa.array(node[k : k + HELD]), pa.array(component[k : k + HELD])], ["node", "component"])

    return map_arrow(edges.coalesce(1), run, "node bigint, component bigint")


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of all nodes in edges (a, b); the component is its smallest node.

    Few edges go through one task, which saves the driver the plans of all
    rounds.  Many take alternating large-star and small-star steps; minima are
    pre-aggregated, so that a hub is one key of a sum and not one task's list.
    """

    def size(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = scratch.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = size(now)
    if before[0] <= CONTRACTED and dict(now.dtypes)["a"] == "bigint":
        return contracted(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.filter("m < a").select("a", F.col("m").alias("b"))).distinct()
        large = scratch.keep(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        new = scratch.keep(small)
        scratch.drop(now, large)
        after, now = size(new), new
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def pairs_by_lag(unit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index arrays (i, j) that together hold every pair i < j of one unit; ``unit`` is sorted."""
    i, lag = np.arange(len(unit) - 1), 1
    while len(i):
        i = i[unit[i] == unit[i + lag]]
        if len(i):
            yield i, i + lag
        lag += 1
        i = i[i + lag < len(unit)]


#: Columns of whole units (sorted by "unit") -> index arrays of candidate pairs.
Search = Callable[[dict[str, np.ndarray]], Iterator[tuple[np.ndarray, np.ndarray]]]


def _column(c: pa.Array) -> np.ndarray:
    if pa.types.is_binary(c.type):
        return np.array(c.to_pylist(), object)
    if pa.types.is_list(c.type):  # of equal lengths
        return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)
    return c.to_numpy(zero_copy_only=False)


def searched(rows: DataFrame, search: Search, one_each: bool) -> DataFrame:
    """Candidate pairs (a, b) of rows (unit, g, node, component, ...), those of one component left out.

    A column keys, if there is one, holds all buckets of the node, as many for each; a pair is then found in the first bucket that its keys share.
    one_each: for every row, one pair with an earlier row at most.
    """

    def work(table: pa.Table) -> pa.RecordBatch:
        cols = {n: _column(table.column(n).combine_chunks()) for n in table.column_names}
        node, component, found = cols["node"], cols["component"], []
        keys = cols.get("keys")
        last = np.full(len(node), -1)
        for i, j in search(cols):
            ok = (component[i] != component[j]) & (node[i] != node[j])
            i, j = i[ok], j[ok]
            for k in range(0, len(i), 1 << 14):
                x, y = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
                if keys is not None:
                    first = (keys[x] == keys[y]).argmax(1)
                    own = keys[x, first] == cols["g"][x]
                    x, y = x[own], y[own]
                if one_each:
                    np.maximum.at(last, np.maximum(x, y), np.minimum(x, y))
                else:
                    found.append(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])], 1))
        if one_each:
            x = np.flatnonzero(last >= 0)
            found.append(np.stack([np.minimum(node[x], node[last[x]]), np.maximum(node[x], node[last[x]])], 1))
        both = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < HELD and sum(b.nbytes for b in held) < HELD_BYTES:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            unit = table.column("unit").to_numpy()
            cut = int(np.searchsorted(unit, unit[-1]))  # the last unit may go on
            if cut:
                yield work(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held:
            yield work(pa.Table.from_batches(held))

    return map_arrow(rows.repartition("unit").sortWithinPartitions("unit"), run, "a bigint, b bigint")


def merged(parts: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) after more links (a, b)."""
    label = lambda side: parts.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))
    bridges = links.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    joined = scratch.keep(connected_components(bridges, scratch))
    new = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(parts, "node", "left_anti").withColumn("component", F.col("node"))
    nodes = parts.select("node", "component").unionByName(new)
    done = nodes.join(joined.select(F.col("node").alias("component"), F.col("component").alias("_final")), "component", "left")
    return scratch.keep(done.select("node", F.coalesce("_final", "component").alias("component")))


def units_across(labelled: DataFrame) -> DataFrame:
    """Kept rows (g, node, component, ...) -> those and unit: blocks that hold every pair across components."""
    sizes = labelled.groupBy("g", "component").agg(F.count(F.lit(1)).alias("_c"))
    mixed = sizes.groupBy("g").agg(F.max(F.struct("_c", "component")).alias("_top"), F.sum("_c").alias("_all")).filter("_all > _top._c")
    rows = labelled.join(mixed, "g")
    block = lambda n, size: F.ceil(n / size).cast("int")
    some, every = block(F.col("_all") - F.col("_top._c"), BUCKET // 4), block(F.col("_all"), BUCKET // 2)
    place = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    first = rows.filter(F.col("component") != F.col("_top.component")).select(*labelled.columns, place(some).alias("_x"), numbers(every).alias("_y"))
    second = rows.select(*labelled.columns, place(every).alias("_y"), numbers(some).alias("_x"))
    return first.unionByName(second).withColumn("unit", F.xxhash64("g", "_x", "_y")).drop("_x", "_y").dropDuplicates(["unit", "node"])


def across_components(groups: DataFrame, parts: DataFrame, checked: DataFrame, verify: Callable[[DataFrame], DataFrame], payload: DataFrame | None, search: Search, scratch: Scratch) -> DataFrame:
    """(node, component) after all pairs of groups (g, node, ...) that lie in two components of parts are compared.

    checked: pairs (a, b) that need no second look; payload: (node, ...) what ``search`` needs besides the columns of groups.
    """
    columns, seen = groups.columns, [checked]
    for one_each in (True, False):
        labelled = scratch.keep(groups.join(parts, "node", "left").select(*columns, F.coalesce("component", "node").alias("component")))
        units = units_across(labelled)
        across = searched(units.join(payload, "node") if payload is not None else units, search, one_each).distinct()
        for old in seen:
            across = across.join(old, ["a", "b"], "left_anti")
        across = scratch.keep(across)
        parts = merged(parts, verify(across), scratch)
        seen.append(across)
        groups = labelled.select(*columns)
    scratch.drop(*seen[1:])
    return parts


def link(members: DataFrame, verify: Callable[[DataFrame], DataFrame], payload: DataFrame, search: Search, scratch: Scratch) -> DataFrame:
    """(node, component) of nodes with links.

    members: (g, node) with repeated buckets g; verify: pairs (a, b) to kept links (a, b);
    payload: (node, keys, ...) what ``searched`` and ``search`` need.
    """
    counted = members.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).filter("n > 1")
    shared = scratch.keep(members.join(counted, "g"))
    star = scratch.keep(shared.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct())
    parts = scratch.keep(connected_components(verify(star), scratch))
    # a bucket of two has no other pair
    parts = across_components(shared.filter("n > 2").select("g", "node"), parts, star, verify, payload, search, scratch)
    scratch.drop(shared, star)
    return parts
