"""Prefix trie of conversations: adaptive radix trees over fixed-width turn ids, one for each range of the sorted keys."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.common import saved

#: Bytes of a turn's id in a key.
WIDTH = 16
#: Turns of a range, so a task builds one tree of bounded size.
RANGE_TURNS = 50_000
#: Conversation ids are joined in slices of this many bits before a node's list is digested.
SLICE_BITS = 16
NODE_SCHEMA = (
    "node_id string, parent_id string, depth long, conv_id long, parent_conv long, n_convs long, n_children long,"
    " n_leaves long, saved_tokens long, shared boolean, parent_shared boolean"
)


class ArtNode:
    """A node of an adaptive radix tree: compressed path, and children in a layout that grows from 4 to 16, 48 and 256.

    Up to 16 children are kept sorted by their byte; up to 48 have a byte-indexed table of places; beyond that the byte
    is the place. `end` is the number of the key that ends here, or -1.
    """

    __slots__ = ("path", "end", "layout", "bytes", "children")

    def __init__(self, path: bytes, end: int = -1) -> None:
        self.path, self.end = path, end
        self.layout, self.bytes, self.children = 4, bytearray(), []

    def find(self, byte: int) -> ArtNode | None:
        if self.layout <= 16:
            at = bisect_left(self.bytes, byte)
            return self.children[at] if at < len(self.bytes) and self.bytes[at] == byte else None
        if self.layout == 48:
            return self.children[self.bytes[byte] - 1] if self.bytes[byte] else None
        return self.children[byte]

    def add(self, byte: int, child: ArtNode) -> None:
        if self.layout <= 16:
            if len(self.bytes) == 16:
                places = bytearray(256)
                for place, other in enumerate(self.bytes):
                    places[other] = place + 1
                self.layout, self.bytes = 48, places
            else:
                at = bisect_left(self.bytes, byte)
                self.bytes.insert(at, byte)
                self.children.insert(at, child)
                self.layout = 4 if len(self.bytes) <= 4 else 16
                return
        if self.layout == 48:
            if len(self.children) < 48:
                self.children.append(child)
                self.bytes[byte] = len(self.children)
                return
            full: list[ArtNode | None] = [None] * 256
            for other, place in enumerate(self.bytes):
                if place:
                    full[other] = self.children[place - 1]
            self.layout, self.bytes, self.children = 256, bytearray(), full
        self.children[byte] = child

    def ordered(self) -> list[tuple[int, ArtNode]]:
        """Bytes and children by byte."""
        if self.layout <= 16:
            return list(zip(self.bytes, self.children, strict=True))
        if self.layout == 48:
            return [(byte, self.children[place - 1]) for byte, place in enumerate(self.bytes) if place]
        return [(byte, child) for byte, child in enumerate(self.children) if child is not None]


def common_length(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def insert(root: ArtNode, key: bytes, number: int) -> None:
    """Add a key that isn't in the tree yet."""
    node, at = root, 0
    while True:
        path = node.path
        same = len(path) if key.startswith(path, at) else common_length(path, key[at : at + len(path)])
        if same < len(path):  # the path is split; what was here moves below
            lower = ArtNode(path[same + 1 :], node.end)
            lower.layout, lower.bytes, lower.children = node.layout, node.bytes, node.children
            node.path, node.end, node.layout, node.bytes, node.children = path[:same], -1, 4, bytearray(), []
            node.add(path[same], lower)
        at += same
        if at == len(key):
            node.end = number
            return
        child = node.find(key[at])
        if child is None:
            node.add(key[at], ArtNode(key[at + 1 :], number))
            return
        node, at = child, at + 1


def turn_nodes(
    keys: list[bytes], words: list[list[int]], convs: list[int], counts: list[int], before: bytes | None, after: bytes | None
) -> dict[str, list]:
    """Columns of NODE_SCHEMA of the trie of these sorted, different keys, which are a range of all keys.

    `before` and `after` are the last key of the range before and the first of the one after. A node that also lies in
    another range is `shared`; its figures, and those of the nodes above it, add up over the ranges: a node counts as a
    child and as its own first telling only in the first of its ranges, and as childless only if no longer key follows.
    """
    shared_before = common_length(keys[0], before) if before is not None else -1
    shared_after = common_length(keys[-1], after) if after is not None else -1
    root = ArtNode(keys[0])
    root.end = 0
    for number in range(1, len(keys)):
        insert(root, keys[number], number)

    # from the top: every byte depth at which a turn ends gets a row; other depths and branches get none
    ids: list[str] = [""]
    parents: list[int] = [-1]
    depths: list[int] = [0]
    order: list[tuple[ArtNode, int, int, int]] = []
    waiting: list[tuple[ArtNode, int, bytes, int]] = [(root, -1, b"", 0)]
    while waiting:
        node, above, lead, row = waiting.pop()
        part = lead + node.path  # begins where a turn does
        first = len(ids) if above >= 0 else 0
        whole = len(part) - len(part) % WIDTH
        for begin in range(0, whole, WIDTH):
            ids.append(hashlib.md5((ids[row] + part[begin : begin + WIDTH].hex()).encode()).hexdigest())
            parents.append(row)
            depths.append(depths[row] + 1)
            row = len(ids) - 1
        order.append((node, above, first, len(ids)))
        waiting += [(child, len(order) - 1, part[whole:] + bytes((byte,)), row) for byte, child in node.ordered()]

    # from below: figures of the subtrees
    conv, members, children, leaves, saved_words, shared = ([0] * len(ids) for _ in range(6))
    below = [[None, 0, 0, 0, 0, len(keys), -1] for _ in order]
    for here in range(len(order) - 1, -1, -1):
        node, above, first, stop = order[here]
        least, total, tops, ends, spared, low, high = below[here]
        if node.end >= 0:
            least = convs[node.end] if least is None else min(least, convs[node.end])
            total, low, high = total + counts[node.end], min(low, node.end), max(high, node.end)
        bare = not node.children
        for row in range(stop - 1, first - 1, -1):
            size = depths[row] * WIDTH
            told = low == 0 and size <= shared_before
            goes_on = high == len(keys) - 1 and size <= shared_after
            own = words[low][depths[row] - 1] if size else 0
            spared += total * own - (0 if told else own)
            ends += bare and not goes_on
            conv[row], members[row], children[row], leaves[row], saved_words[row] = least, total, tops, ends, spared
            shared[row] = told or goes_on
            tops, bare = int(not told), False
        if above >= 0:
            up = below[above]
            up[0] = least if up[0] is None else min(up[0], least)
            up[1], up[2], up[3], up[4] = up[1] + total, up[2] + tops, up[3] + ends, up[4] + spared
            up[5], up[6] = min(up[5], low), max(up[6], high)
    alone = [up < 0 or bool(shared[up]) for up in parents]
    return {
        "node_id": ids, "parent_id": [None if up < 0 else ids[up] for up in parents], "depth": depths, "conv_id": conv,
        "parent_conv": [None if none else conv[up] for up, none in zip(parents, alone, strict=True)],
        "n_convs": members, "n_children": children, "n_leaves": leaves, "saved_tokens": saved_words,
        "shared": [bool(x) for x in shared], "parent_shared": [up >= 0 and none for up, none in zip(parents, alone, strict=True)],
    }


def _turn_id(role: Column, text: Column) -> Column:
    """Hex digits of a turn's id: the first WIDTH bytes of a digest of role and text."""
    told = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.sha2(told.cast("binary"), 256), 1, 2 * WIDTH)


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_id, words) of each turn, pos from 1 by turn, null first, equal turns by their id.

    Null role and text are empty. Rows without conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", _turn_id(role, text).alias("turn_id"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "turn_id")
    return rows.select("conv_id", F.row_number().over(order).alias("pos"), "turn_id", "words")


def rebuilt_turns(turns: DataFrame, *, family: int = 20, heads: int = 4) -> DataFrame:
    """turn_rows of the rebuilt conversations, with one row (pos null) for each conversation.

    Conversation c begins with the first h turns of conversation c - c % family, if there are any, and goes on with its
    own turns after its first h; h is the checksum of its id modulo `heads`.
    """
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads))
    base = F.col("conv_id") - F.col("conv_id") % family
    own = turns.select("*", base.alias("base"), head.alias("head"))
    convs = own.select("conv_id", "base", "head").distinct()
    borrowed = convs.where("base <> conv_id").join(
        turns.where(F.col("pos") < heads).select(F.col("conv_id").alias("base"), "pos", "turn_id", "words"), "base"
    ).where("pos <= head")
    columns = ["conv_id", "pos", "turn_id", "words"]
    every = convs.select("conv_id", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("turn_id"), F.lit(None).cast("long").alias("words"))
    return every.union(own.where("base = conv_id OR pos > head").select(*columns)).union(borrowed.select(*columns))


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, key, words, node_id) of each conversation: its turn ids side by side, and the id of its last node.

    A conversation's turn ids and word counts (about 40 bytes a turn, no texts) are gathered in one row.
    """
    turn = F.when(F.col("pos").isNotNull(), F.struct("pos", "turn_id", "words"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    step = lambda above, t: F.md5(F.concat(above, t["turn_id"]).cast("binary"))
    return rows.select(
        "conv_id", F.unhex(F.array_join("turns.turn_id", "")).alias("key"), F.col("turns.words").alias("words"),
        F.aggregate("turns", F.lit(""), step).alias("node_id"),
    )


def member_digests(ends: DataFrame) -> DataFrame:
    """(node_id, ends_sha256) from (node_id, conv_id): digest of the ascending ids, joined by commas.

    Ids are joined in slices where they are; the slices of a node stream through one task in order, a digest's state at
    a time, so no node's whole list is held.
    """
    slices = ends.groupBy("node_id", F.shiftright("conv_id", SLICE_BITS).alias("slice")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, state = None, None
        for batch in batches:
            done: tuple[list[str], list[str]] = ([], [])
            for node_id, ids in zip(batch["node_id"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if node_id != open_id:
                    if state is not None:
                        done[0].append(open_id)
                        done[1].append(state.hexdigest())
                    open_id, state = node_id, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in done], ["node_id", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (open_id, state.hexdigest())], ["node_id", "ends_sha256"])

    return slices.repartition("node_id").sortWithinPartitions("node_id", "slice").select("node_id", "ids").mapInArrow(digest, "node_id string, ends_sha256 string")


def trie_nodes(found: DataFrame, *, range_turns: int = RANGE_TURNS) -> DataFrame:
    """(node_id, parent_id, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens) of every node.

    `found` has (conv_id, key, words) of each conversation. Equal sequences are counted first, so a sequence that a
    third of all conversations share is one key. Different keys are sorted into ranges of about `range_turns` turns and
    each range makes its own tree; a subtree that is larger than a range is made by several, and the figures of the
    few nodes on the ranges' borders are added up.
    """
    distinct = found.groupBy("key").agg(F.first("words").alias("words"), F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    distinct = saved(distinct, "trie-keys")
    turns = distinct.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    ranged = distinct.repartitionByRange(max(1, -(-turns // range_turns)), "key").withColumn("range", F.spark_partition_id())
    ranged = saved(ranged, "trie-ranges")
    by_range = Window.partitionBy().orderBy("range")
    borders = ranged.groupBy("range").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    borders = borders.select("range", F.lag("high").over(by_range).alias("before"), F.lead("low").over(by_range).alias("after"))

    def build(rows: pa.Table, border: pa.Table) -> pa.Table:
        order = sorted(range(len(rows)), key=(keys := rows["key"].to_pylist()).__getitem__)
        words, convs, copies = (rows[c].to_pylist() for c in ("words", "conv_id", "copies"))
        made = turn_nodes(
            [keys[i] for i in order], [words[i] for i in order], [convs[i] for i in order], [copies[i] for i in order],
            border["before"][0].as_py(), border["after"][0].as_py(),
        )
        kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
        return pa.table({name: pa.array(made[name], kinds[kind]) for name, kind in (x.split() for x in NODE_SCHEMA.split(", "))})

    parts = saved(ranged.groupBy("range").cogroup(borders.groupBy("range")).applyInArrow(build, NODE_SCHEMA), "trie-nodes")
    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    bordering = parts.where("shared").groupBy("node_id").agg(
        F.first("parent_id").alias("parent_id"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.first("parent_conv").alias("parent_conv"), *[F.sum(c).alias(c) for c in sums], F.first("parent_shared").alias("parent_shared"),
    )
    columns = ["node_id", "parent_id", "depth", "conv_id", "parent_conv", *sums, "parent_shared"]
    nodes = parts.where("NOT shared").select(*columns).union(bordering.select(*columns))
    tops = bordering.select(F.col("node_id").alias("_top"), F.col("conv_id").alias("_conv"))
    asks = F.when(F.col("parent_shared"), F.col("parent_id"))
    nodes = nodes.join(tops, asks == F.col("_top"), "left")
    return nodes.select(
        "node_id", "parent_id", "depth", "conv_id", F.coalesce("parent_conv", "_conv").alias("parent_conv_id"), *sums
    )


def conversation_trie(conversations: DataFrame, *, family: int = 20, heads: int = 4, range_turns: int = RANGE_TURNS) -> DataFrame:
    """trie_nodes of the rebuilt conversations, with ends_sha256.

    Repeated rows of a turn are turns of their own. An empty table has no conversation and no node.
    """
    found = saved(sequences(rebuilt_turns(saved(turn_rows(conversations), "turns"), family=family, heads=heads)), "sequences")
    nodes = trie_nodes(found.select("conv_id", "key", "words"), range_turns=range_turns)
    digests = member_digests(found.select("node_id", "conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return nodes.join(digests, "node_id", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none)))
