"""Helpers shared by the operators: table access, shared storage, word hashes and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.session import saved, stored

WHITE_SPACE = b"\x09\x0a\x0b\x0c\x0d\x20"
#: Edges that a task joins at once.
LOCAL_EDGES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused_names(frame: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, with signs added to those that the frame has (in any case)."""
    taken, out = {name.lower() for name in frame.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset of each row in them; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, data = column.buffers()
    if places is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(places, dtype=width, count=len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about `most` bytes of text; a longer text is a slice of its own."""
    _, offsets = text_bytes(batch[column])
    begin, rows = 0, len(offsets) - 1
    while begin < rows:
        end = int(np.searchsorted(offsets, offsets[begin] + most, side="right")) - 1
        end = min(max(end, begin + 1), rows)
        yield batch.slice(begin, end - begin)
        begin = end


def mix(values: np.ndarray) -> np.ndarray:
    """Bijective finaliser that spreads every input bit over all 64 output bits."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(WHITE_SPACE)] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray, *, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every white-space separated word, and the row that holds it, in reading order.

    Words are hashed eight bytes at a time for the whole batch; only words longer than that take more rounds.
    """
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_IS_SPACE[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    first = offsets[:-1]
    first = first[first < len(data)]
    opens[first] = inside[first]
    starts = np.flatnonzero(opens)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row = np.searchsorted(offsets, starts, side="right") - 1
    closes = ~inside
    gaps = np.append(np.flatnonzero(closes), len(data))
    ends = gaps[np.searchsorted(gaps, starts)]
    ends = np.minimum(ends, offsets[row + 1])
    del gaps, closes, opens, inside
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    np.take(_LOWER, data, out=padded[: len(data)]) if lower else np.copyto(padded[: len(data)], data)
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    length = ends - starts
    hashed = mix(length.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    live, at = np.arange(len(starts)), starts
    while len(live):
        left = np.minimum(ends[live] - at, 8)
        block = np.ascontiguousarray(words[at]).view("<u8").ravel()
        block = block & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - left) * 8).astype(np.uint64))
        hashed[live] = mix((hashed[live] ^ block) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        more = ends[live] - at > 8
        live, at = live[more], at[more] + 8
    assert row[-1] < rows
    return hashed, row


def shingle_sets(hashes: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of `size` words of each row, sorted by row and hash.

    A row with fewer words has its whole sequence as one shingle.
    """
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    count = np.diff(np.r_[begin, len(row)])
    parts, owners = [], []
    long = np.repeat(count >= size, count)
    last = np.arange(len(row)) - np.repeat(begin, count) < np.repeat(count - size + 1, count)
    at = np.flatnonzero(long & last)
    if len(at):
        value = np.full(len(at), size, np.uint64)
        for k in range(size):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + hashes[at + k])
        parts.append(value)
        owners.append(row[at])
    for n in range(1, size):
        at = begin[count == n]
        if len(at):
            value = np.full(len(at), n, np.uint64)
            for k in range(n):
                value = mix(value * np.uint64(0x9E3779B97F4A7C15) + hashes[at + k])
            parts.append(value)
            owners.append(row[at])
    value, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    keep = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]
    return value[keep], owner[keep]


def local_roots(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of the links of one task: every linked node with the smallest node reachable inside the task."""
    nodes, index = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = index[: len(left)], index[len(left) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            return nodes, nodes[root]


def _locally_joined(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components: each task gives its nodes one edge to the smallest node that it can reach there."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= LOCAL_EDGES:
                yield joined(held)
                held, rows = [], 0
        if held:
            yield joined(held)

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        nodes, roots = local_roots(table["a"].to_numpy(), table["b"].to_numpy())
        other = nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(x[other], table["a"].type) for x in (nodes, roots)], ["a", "b"])

    return edges.mapInArrow(per_task, edges.schema)


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): component is the smallest node reachable. Nodes without links are absent.

    Tasks first join what they hold themselves. Up to LOCAL_EDGES links, 16 bytes each, are read by one task and need no
    round: the driver keeps a thread for each exchange of each round, and each stored frame is a file for each task. Of more
    links, large-star and small-star steps alternate until each node has one edge, to its smallest one. Every round keeps at
    most as many edges as before. Minima are combined before each shuffle; hubs meet in plain joins that adaptive execution
    can split. Edges are cut from their lineage each round. `links` are read twice and should be stored.
    """
    first = links.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where("a <> b")
    edges = stored(_locally_joined(first.coalesce(1) if first.count() <= LOCAL_EDGES else first.distinct()))
    while not _settled(edges):
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(_locally_joined(small.union(least).distinct()))
    return edges.union(edges.select("b", "b")).toDF("node", "component").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether a node with a smaller one has no other node: then each edge leads to its component's smallest node."""
    ends = edges.selectExpr("a AS node", "b AS up", "false AS low").union(edges.selectExpr("b", "null", "true"))
    open_ = ends.groupBy("node").agg(F.min("up").alias("m"), F.max("up").alias("n"), F.bool_or("low").alias("low"))
    return open_.where("m <> n OR (low AND m IS NOT NULL)").isEmpty()
