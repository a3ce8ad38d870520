"""Token packing: first-fit decreasing with a tournament tree, in randomised groups of pieces."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import text_slices

END_OF_TEXT = "<|endoftext|>"
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, lot long"


def special_tokens(vocabulary: str) -> dict[str, int]:
    from tokenizers import Tokenizer

    return {END_OF_TEXT: Tokenizer.from_file(vocabulary).token_to_id(END_OF_TEXT)}


def encoder(ranks: str, vocabulary: str, special: dict[str, int]):
    """Token ids of a text, by the rank file, and by the vocabulary file where the former gives up.

    Both files hold the same vocabulary. The rank file's library is several times faster, but its splitting pattern
    fails on runs of about a million white-space characters; only then is the other file loaded.
    """
    import tiktoken
    import public_tokenizers

    with open(ranks, "rb") as file:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)
    slow = []

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except ValueError:
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(vocabulary))
            return slow[0].encode(text, add_special_tokens=False).ids

    return encode


def token_pieces(
    docs: DataFrame, ranks: str, vocabulary: str, *, length: int = 1024, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """Tokens of each document with `end_id` at the end, cut into pieces of at most `length`.

    `lot` is a random number that depends on the row's place in its stored input. A null text is empty: its only
    token is `end_id`. `with_ids` adds the ids themselves and `piece`, a number of the piece.
    """
    special = special_tokens(vocabulary)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks, vocabulary, special)
        task = TaskContext.get().partitionId()
        rng, number = np.random.default_rng(task), task << 33
        for batch in (part for whole in batches for part in text_slices(whole, "text")):
            rows, lists = [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                for start in range(0, len(ids), length):
                    piece = ids[start : start + length]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), int(rng.integers(1 << 62))))
                    if with_ids:
                        lists.append(piece.astype(np.int32))
            frame = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "lot"])
            arrays = [pa.array(frame[name], pa.int64(), from_pandas=True) for name in frame.columns]
            names = list(frame.columns)
            if with_ids:
                arrays += [pa.array(np.arange(number, number + len(lists))), pa.array(lists, pa.list_(pa.int32()))]
                names += ["piece", "ids"]
                number += len(lists)
            yield pa.RecordBatch.from_arrays(arrays, names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(per_batch, PIECE_SCHEMA + (", piece long, ids array<int>" if with_ids else ""))


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every size: largest first, each into the first bin with room.

    The leaves of a complete binary tree hold the room left in the bins and every inner node the larger of its two
    children, so the first bin with room is found by going left wherever the left child has enough.
    """
    order = np.argsort(-sizes, kind="stable")
    leaves = 1 << max(0, int(len(sizes) - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for item in order.tolist():
        size, node = int(sizes[item]), 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[item], offsets[item] = node - leaves, capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets


def pack(pieces: DataFrame, *, capacity: int = 1024, group_rows: int = 8192, rows: int | None = None) -> DataFrame:
    """Every piece with its sequence_id and its offset there.

    Pieces are dealt at random (by `lot`) into groups of about `group_rows`, so neither a long document nor a
    repeated id gathers in one group; each group is packed on its own. `rows` is the number of pieces if known.
    """
    groups = max(1, -(-(pieces.count() if rows is None else rows) // group_rows))

    def per_group(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["lot", "doc_id", "start"], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(frame["length"].to_numpy(), capacity)
        frame["sequence_id"] = frame["_group"] * (1 << 32) + bins
        frame["offset"] = offsets
        return frame.drop(columns=["_group", "lot"])

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name != "lot"]
    return (
        pieces.withColumn("_group", F.pmod(F.xxhash64("lot"), F.lit(groups)))
        .groupBy("_group")
        .applyInPandas(per_group, ", ".join([*kept, "sequence_id long", "offset long"]))
    )


def packed_sequences(pieces: DataFrame, *, capacity: int = 1024, group_rows: int = 8192) -> DataFrame:
    """pack() of stored pieces with ids: places are found without the ids, which are joined to them afterwards."""
    placed = pack(pieces.drop("ids"), capacity=capacity, group_rows=group_rows)
    return placed.join(pieces.select("piece", "ids"), "piece").drop("piece")
