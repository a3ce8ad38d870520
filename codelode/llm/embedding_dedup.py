"""Near-duplicate vectors by passes over orders of concatenated random hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.common import connected_components, local_roots, saved

#: Random hashes of a key; each is the side of a random plane through the centre of all vectors.
HASHES = 128
#: Neighbours in the order that a vector is compared with on each side, at least.
WINDOW = 1024
#: Passes of a round. Rounds go on until one finds nothing new.
PASSES = 4
#: Components up to this size are compared as one matrix, larger ones by pivot and blocks of this many vectors.
BLOCK = 256


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)  # so that squares stay finite
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _of_each_width(column: pa.Array) -> Iterator[np.ndarray]:
    width = np.asarray(column.value_lengths())
    for w in np.unique(width):
        yield np.flatnonzero(width == w)


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, class or null) of every row, and (class, members, first, vector) of each different usable vector.

    Vectors that are null, all zero, or hold null or non-finite components have no class.
    """
    usable = F.coalesce(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0),
        F.lit(False),
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.select("vec_id", F.when(usable, F.xxhash64("embedding")).alias("class"), "embedding")
    different = (
        rows.where("class IS NOT NULL")
        .groupBy("class")
        .agg(F.count("*").alias("members"), F.min("vec_id").alias("first"), F.first("embedding").alias("vector"))
    )
    return rows.select("vec_id", "class"), different


def centres(different: DataFrame) -> DataFrame:
    """(width, centre): mean of the unit vectors of each width; sums of batches are added up, not vectors."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(at), _matrix(batch["vector"].take(pa.array(at))).sum(axis=0)) for at in _of_each_width(batch["vector"])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(x) for _, x in found], pa.int32()), pa.array([n for n, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.float64()))],
                ["width", "n", "total"],
            )

    parts = different.select("vector").mapInArrow(sums, "width int, n long, total array<double>")
    means = parts.select("width", "n", F.posexplode("total").alias("pos", "x")).groupBy("width", "pos").agg((F.sum("x") / F.sum("n")).alias("x"))
    return means.groupBy("width").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("centre"))


def _joined(unit: np.ndarray, root: np.ndarray, least: float) -> np.ndarray:
    """Groups (smallest place) of the vectors of a leaf by their cosines, begun from the groups `root`."""
    small = unit.astype(np.float32)
    for begin in range(0, len(unit), BLOCK):
        rows = slice(begin, begin + BLOCK)
        # single precision leaves out what is surely below, double precision decides
        close = (small[rows] @ small[begin:].T >= least - 1e-5) & (root[rows][:, None] != root[begin:][None, :])
        left, right = np.nonzero(close)
        for k in range(0, len(left), 1 << 16):
            a, b = left[k : k + (1 << 16)] + begin, right[k : k + (1 << 16)] + begin
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
            linked = np.einsum("ij,ij->i", unit[a], unit[b]) >= least
            if linked.any():
                nodes, lowest = local_roots(root[a[linked]], root[b[linked]])
                moved = np.arange(len(root))
                moved[nodes] = lowest
                root = moved[root]
    return root


def _planes(width: int, number: int) -> np.ndarray:
    """The random planes of a pass; the same in every task."""
    return np.random.default_rng([number, width]).normal(size=(width, HASHES))


def sorted_pass_links(rows: DataFrame, middle: DataFrame, numbers: list[int], least: float, window: int) -> DataFrame:
    """(left, right): links between components of `rows` (class, component, vector) that these passes find.

    Each pass orders the vectors by their hashes from its own planes, side by side as one key. The order is cut into
    blocks of `window` vectors, and each block is compared with itself and the next one, so a vector meets at least
    `window` neighbours on either side. The orders are ranges of keys and classes, so equal keys are no single task.
    """
    spark = rows.sparkSession

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in numbers:
                keys = np.zeros((len(batch), HASHES // 8), np.uint8)
                for at in _of_each_width(batch["vector"]):
                    of = pa.array(at)
                    unit = _matrix(batch["vector"].take(of))
                    centre = np.asarray(batch["centre"].take(of[:1]).flatten())
                    keys[at] = np.packbits((unit - centre) @ _planes(unit.shape[1], number) > 0, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(batch), number, np.int32)), batch["width"], pa.array([k.tobytes() for k in keys], pa.binary()), batch["class"], batch["component"], batch["vector"]],
                    ["pass", "width", "key", "class", "component", "vector"],
                )

    def compare(table: pa.Table) -> pa.Table:
        labels, group = np.unique(table["component"].to_numpy(), return_inverse=True)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        order = np.char.add(table["pass"].to_numpy().astype(str), np.char.add(" ", table["width"].to_numpy().astype(str)))
        vectors = table["vector"].combine_chunks()
        for kind in np.unique(order):
            at = np.flatnonzero(order == kind)
            unit = _matrix(vectors.take(pa.array(at)))
            present, begin = np.unique(group[at], return_inverse=True)
            first = np.zeros(len(present), np.int64)
            first[begin[::-1]] = np.arange(len(at))[::-1]
            root = _joined(unit, first[begin], least)
            top = root[first]
            left.append(labels[present[top != first]])
            right.append(labels[group[at]][top[top != first]])
        return pa.table({"left": np.concatenate(left), "right": np.concatenate(right)})

    known = rows.select("class", "component", "vector", F.size("vector").alias("width")).join(middle, "width")
    placed = known.mapInArrow(place, "pass int, width int, key binary, class long, component long, vector array<double>")
    order = ["pass", "width", "key", "class"]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = placed.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    ordered = ordered.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    ordered = saved(ordered.drop("key"), "sorted-pass")
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    block = F.floor((F.col("_before") + F.col("_row")) / window).cast("long")
    blocks = ordered.join(sizes.select("_part", before.alias("_before")), "_part").withColumn("block", F.explode(F.array(block, block - 1)))
    columns = ["block", "pass", "width", "class", "component", "vector"]
    return blocks.select(*columns).groupBy("block").applyInArrow(compare, "left long, right long")


def projection_components(different: DataFrame, *, least: float, window: int = WINDOW) -> DataFrame:
    """(node, component) of the classes that are linked with others.

    Rounds of passes with new planes go on until one finds no link between two components, so the number of passes
    follows from what dense directions still hide: a pair that a window misses in one order has a new chance in each.
    """
    middle, links, found, number = saved(centres(different), "vector-centres"), None, None, 0
    while True:
        rows = different.withColumn("component", F.col("class")) if found is None else different.join(
            found, F.col("class") == F.col("node"), "left"
        ).select("class", "vector", F.coalesce("component", "class").alias("component"))
        new = saved(sorted_pass_links(rows, middle, list(range(number, number + PASSES)), least, window), "pass-links")
        if new.isEmpty():
            return found if found is not None else saved(connected_components(new, "left", "right"), "vector-components")
        links = new if links is None else links.union(new)
        found = saved(connected_components(links, "left", "right"), "vector-components")
        number += PASSES


def _counts(members: DataFrame, least: float, bundles: int) -> DataFrame:
    """(class, links): links to other rows of the vectors of each component, by comparing its members exactly.

    Members of a large component within half the link angle of its pivot are all linked with each other, so they are
    counted without being compared; only the others meet every member, block by block. Small components are dealt
    into `bundles` tasks.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    placed = members.join(sizes, "component")
    small, large = placed.where(F.col("size") <= BLOCK), placed.where(F.col("size") > BLOCK)
    bundle = F.pmod(F.xxhash64("component"), F.lit(bundles))
    small = small.select("class", "members", "vector", "component", F.lit(True).alias("asks"), F.lit(False).alias("core"),
                         F.struct(F.lit(0).cast("long").alias("of"), bundle.alias("i"), F.lit(0).cast("long").alias("j")).alias("task"))
    half = float(np.cos(np.arccos(least) / 2)) + 1e-9
    pivots = large.groupBy("component").agg(F.min_by("vector", "class").alias("pivot"))

    @F.arrow_udf("boolean")
    def within(vector: pa.Array, pivot: pa.Array) -> pa.Array:
        out = np.zeros(len(vector), dtype=bool)
        same = np.asarray(vector.value_lengths()) == np.asarray(pivot.value_lengths())
        for at in _of_each_width(vector):
            at = at[same[at]]
            if len(at):
                rows = pa.array(at)
                out[at] = np.einsum("ij,ij->i", _matrix(vector.take(rows)), _matrix(pivot.take(rows))) >= half
        return pa.array(out)

    large = large.join(pivots, "component").withColumn("core", within("vector", "pivot")).drop("pivot")
    large = saved(large, "large-components")
    core = large.where("core").groupBy("component").agg(F.sum("members").alias("all"))
    inside = large.where("core").join(core, "component").select("class", (F.col("all") - 1).alias("links"))
    outer = large.where("NOT core").groupBy("component").agg(F.count("*").alias("outer"))
    blocked = large.join(outer, "component").select(
        "*", F.ceil(F.col("size") / BLOCK).alias("n"), F.ceil(F.col("outer") / BLOCK).alias("m"),
    ).select("*", F.pmod(F.xxhash64("class"), F.col("n")).alias("of_all"), F.pmod(F.xxhash64("class"), F.col("m")).alias("of_outer"))

    def task(i, j):
        return F.struct(F.col("component").alias("of"), i.cast("long").alias("i"), j.cast("long").alias("j")).alias("task")

    columns = ["class", "members", "vector", "component"]
    asking = blocked.where("NOT core").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    asked = blocked.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("k"))
    large_tasks = asking.select(*columns, F.lit(True).alias("asks"), "core", task(F.col("of_outer") + 1, F.col("k"))).union(
        asked.select(*columns, F.lit(False).alias("asks"), "core", task(F.col("k") + 1, F.col("of_all")))
    )

    def compare(table: pa.Table) -> pa.Table:
        ids, weight = table["class"].to_numpy(), table["members"].to_numpy()
        component, asks, is_core = (table[c].to_numpy() for c in ("component", "asks", "core"))
        blocks = bool(table["task"][0].as_py()["i"]) and not asks.all()
        vectors = table["vector"].combine_chunks()
        total = np.zeros(len(ids), np.int64)
        order = np.argsort(component, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(component[order])) + 1):
            unit = _matrix(vectors.take(pa.array(at)))
            a, b = (at[asks[at]], at[~asks[at]]) if blocks else (at, at)
            ua, ub = (unit[asks[at]], unit[~asks[at]]) if blocks else (unit, unit)
            linked = (ua @ ub.T >= least) & (ids[a][:, None] != ids[b][None, :])
            total[a] += linked @ weight[b]
            if blocks:
                total[b] += np.where(is_core[b], weight[a] @ linked, 0)
        return pa.table({"class": ids, "links": total})

    compared = small.groupBy("task").applyInArrow(compare, "class long, links long").union(
        large_tasks.groupBy("task").applyInArrow(compare, "class long, links long")
    )
    # a vector of several rows is linked with its own copies too
    own = placed.join(large.where("core").select("class"), "class", "left_anti").select("class", (F.col("members") - 1).alias("links"))
    return compared.union(inside).union(own).groupBy("class").agg(F.sum("links").alias("links"))


def near_vectors(vectors: DataFrame, *, least: float = 0.95, window: int = WINDOW) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Equal vectors are one class throughout and are linked with each other. Different vectors are linked if their cosine
    in double precision is at least `least` and they fall into one component of the links that the passes find; inside
    a component every such pair counts. Unusable vectors are linked with nothing, vectors of different length neither.
    A row without vec_id counts as a vector, and has a component only with others.
    """
    rows, different = classes(vectors)
    different = saved(different, "different-vectors")
    found = projection_components(different, least=least, window=window)
    grouped = different.join(found, F.col("class") == F.col("node"))
    counts = _counts(grouped.select("class", "members", "vector", "component"), least, 1 + different.count() // 4096)
    lowest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = grouped.select("class", "component").join(lowest, "component").join(counts, "class").select("class", "component_id", "links")
    alone = different.join(found, F.col("class") == F.col("node"), "left_anti").where("members > 1")
    linked = linked.union(alone.select("class", F.col("first").alias("component_id"), F.col("members") - 1))
    out = rows.join(linked, "class", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
