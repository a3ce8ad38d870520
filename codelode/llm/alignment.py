"""Tokens of two tokenizers aligned over the same bytes by merge-path partitioning."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.common import saved

SPACE = "▁"
#: Steps of the merge in one piece.
PIECE_STEPS = 1 << 16
#: Texts of a chunk, in characters; a chunk's different id pairs are looked up once. A longer text is a chunk of its own.
CHUNK_CHARS = 4 << 20
ALIGNED = (
    "doc_id long, a_ids array<int>, a_ends array<long>, b_ids array<int>, b_ends array<long>, group_ends array<long>,"
    " link_a array<int>, link_b array<int>"
)
CHUNKS = (
    "chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>,"
    " groups_sha256 array<string>, pair_a array<int>, pair_b array<int>, times array<long>, links binary"
)
SUMMARY = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """Character of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + n): b for n, b in enumerate(others)}


def byte_level(path: str) -> tuple[Callable[[str], list[int]], list[bytes]]:
    """Encoder of a byte-level BPE vocabulary file, and the bytes of each id.

    In such a file an id is the rank of its merge, so the ids by rank are the file's own ids; where that doesn't hold,
    and where the faster encoder gives up on a run of white space, the file's tokenizer encodes.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    alphabet = byte_alphabet()
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    table = [b""] * slow.get_vocab_size()
    special = {i for i, _ in slow.get_added_tokens_decoder().items()}
    for token, number in model["vocab"].items():
        if number not in special:
            table[number] = bytes(alphabet[c] for c in token)
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ranked = all(model["vocab"][a + b] == 256 + rank for rank, (a, b) in enumerate(merges))

    def by_file(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    if not ranked:
        return by_file, table
    ranks = {token: number for number, token in enumerate(table) if token}
    fast = tiktoken.Encoding("aligned", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def by_rank(text: str) -> list[int]:
        try:
            return fast.encode_ordinary(text)
        except ValueError:
            return by_file(text)

    return by_rank, table


def piece_level(path: str) -> tuple[Callable[[str], list[int]], list[bytes]]:
    """Encoder of a piece vocabulary file, and the bytes of each id; <0xHH> is a byte, U+2581 a space."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    table = []
    for i in range(pieces.get_piece_size()):
        piece = pieces.id_to_piece(i)
        table.append(bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace(SPACE, " ").encode())
    return pieces.encode, table


def diagonal_cuts(a: np.ndarray, b: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) at which the merge of two sorted lists is cut into pieces of `steps` steps.

    On each diagonal i + j = d the merge, which takes from `a` first at ties, has one place; all diagonals are searched
    by halving at once.
    """
    diagonals = np.append(np.arange(0, len(a) + len(b), steps), len(a) + len(b))
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        taken = np.zeros(len(low), bool)
        at, other = middle[open_], (diagonals - middle - 1)[open_]
        taken[open_] = a[at] <= b[other]
        low = np.where(open_ & taken, middle + 1, low)
        high = np.where(open_ & ~taken, middle, high)
    return low, diagonals - low


def piece_overlaps(a: np.ndarray, b: np.ndarray, i: int, k: int, j: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps that end inside the piece a[i:k], b[j:m], as places of both tokens, and whether both tokens end there.

    An end that is the last step of the piece before (equal ends that a cut parts) is no overlap of its own.
    """
    ends = np.union1d(a[i:k], b[j:m])
    if len(ends) and i and ends[0] == a[i - 1]:
        ends = ends[1:]
    left, right = i + np.searchsorted(a[i:k], ends), j + np.searchsorted(b[j:m], ends)
    return left, right, (a[left] == ends) & (b[right] == ends)


def overlaps(a: np.ndarray, b: np.ndarray, steps: int = PIECE_STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All overlaps of the tokens with these ends (strictly rising, the same last one): places of both tokens, and
    whether a group ends there. The pieces are independent; their lists follow each other, and a group that several
    pieces hold ends in the last of them."""
    left_cuts, right_cuts = diagonal_cuts(a, b, steps)
    found = [
        piece_overlaps(a, b, i, k, j, m)
        for i, k, j, m in zip(left_cuts[:-1], left_cuts[1:], right_cuts[:-1], right_cuts[1:], strict=True)
    ]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


@dataclass
class Aligned:
    """Tokens and overlaps of several texts side by side; `*_at` are where the tokens and links of each text begin."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    left: np.ndarray
    right: np.ndarray
    link_at: np.ndarray
    cut: np.ndarray

    def group_ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Last tokens of each group."""
        return self.left[self.cut], self.right[self.cut]


class Aligner:
    """Both tokenizers and the tables that their ids need; made once in each task."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.encode_a, self.bytes_a = byte_level(a_path)
        self.encode_b, self.bytes_b = piece_level(b_path)
        self.length_a, self.length_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        # an id with the sign that follows it: A's by 2 * id, B's after them
        self.written = [f"{i}{sign}" for i in range(len(self.bytes_a)) for sign in ",|"]
        self.written += [f"{i}{sign}" for i in range(len(self.bytes_b)) for sign in ",;"]

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both tokenizers; none if the text is null or empty, or if the bytes of either aren't space + text."""
        none = np.zeros(0, np.int32)
        if not text:
            return none, none
        a, b, whole = self.encode_a(" " + text), self.encode_b(text), b" " + text.encode()
        if b"".join([self.bytes_a[i] for i in a]) != whole or b"".join([self.bytes_b[i] for i in b]) != whole:
            return none, none
        return np.array(a, np.int32), np.array(b, np.int32)

    def align(self, texts: list[str | None], steps: int = PIECE_STEPS) -> Aligned:
        """The texts' tokens follow each other, so one merge aligns them all; texts end where both tokens end."""
        pairs = [self.tokens(text) for text in texts]
        a_ids, b_ids = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int32) for k in (0, 1))
        a_at, b_at = (np.cumsum([0, *(len(p[k]) for p in pairs)]) for k in (0, 1))
        a_ends, b_ends = np.cumsum(self.length_a[a_ids]), np.cumsum(self.length_b[b_ids])
        left, right, cut = overlaps(a_ends, b_ends, steps)
        return Aligned(a_ids, b_ids, a_ends, b_ends, a_at, b_at, left, right, np.searchsorted(left, a_at), cut)

    def group_digests(self, x: Aligned) -> list[str]:
        """Digest of the groups of each text as text; empty without tokens."""
        last_a, last_b = x.group_ends()
        i, j = np.arange(len(x.a_ids)), np.arange(len(x.b_ids))
        of_a, of_b = np.searchsorted(last_a, i), np.searchsorted(last_b, j)
        codes = np.zeros(len(i) + len(j), np.int64)
        codes[i + np.append(0, last_b + 1)[of_a]] = 2 * x.a_ids.astype(np.int64) + (last_a[of_a] == i)
        codes[j + last_a[of_b] + 1] = 2 * len(self.bytes_a) + 2 * x.b_ids.astype(np.int64) + (last_b[of_b] == j)
        out = []
        for begin, end in zip((x.a_at + x.b_at)[:-1].tolist(), (x.a_at + x.b_at)[1:].tolist(), strict=True):
            told = "".join([self.written[c] for c in codes[begin:end].tolist()])
            out.append(hashlib.sha256(told[:-1].encode()).hexdigest() if told else "")
        return out


def chunked(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[list[int | None], list[str | None]]]:
    """Ids and texts of consecutive rows with about so many characters."""
    ids: list[int | None] = []
    texts: list[str | None] = []
    size = 0
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            ids.append(doc_id)
            texts.append(text.as_py())
            size += len(texts[-1] or "") + 1
            if size >= chars:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))


def _lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One list for each text."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, kind))


def aligned_tokens(docs: DataFrame, a_path: str, b_path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The alignment itself: for every row both tokenizers' ids with the byte offsets at which they end, the offsets at
    which both end (the groups), and the places of both tokens of every overlap. Lists are empty without tokens."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_path, b_path)
        names = [x.split()[0] for x in ALIGNED.split(", ")]
        for ids, texts in chunked(batches, CHUNK_CHARS):
            x = aligner.align(texts)
            base = np.append(0, x.a_ends)[x.a_at[:-1]]  # bytes of the texts before
            last_a, _ = x.group_ends()
            groups_at = np.searchsorted(last_a, x.a_at)
            each = lambda at: np.repeat(np.arange(len(ids)), np.diff(at))
            columns = [
                pa.array(ids, pa.int64()), _lists(x.a_ids, x.a_at, pa.int32()), _lists(x.a_ends - base[each(x.a_at)], x.a_at, pa.int64()),
                _lists(x.b_ids, x.b_at, pa.int32()), _lists(x.b_ends - base[each(x.b_at)], x.b_at, pa.int64()),
                _lists(x.a_ends[last_a] - base[each(groups_at)], groups_at, pa.int64()),
                _lists(x.left - x.a_at[:-1][each(x.link_at)], x.link_at, pa.int32()),
                _lists(x.right - x.b_at[:-1][each(x.link_at)], x.link_at, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return _rows(docs, key, text).mapInArrow(per_batch, ALIGNED)


def alignment_chunks(docs: DataFrame, a_path: str, b_path: str, *, key: str, text: str, chars: int) -> DataFrame:
    """Chunks of documents with their counts and digests, the different id pairs of their links with how often each
    occurs, and for each link the place of its pair (compressed; frequent pairs have low places)."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        aligner, number = Aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        names, pack = [x.split()[0] for x in CHUNKS.split(", ")], zstandard.ZstdCompressor(level=1).compress
        for ids, texts in chunked(batches, chars):
            x = aligner.align(texts)
            width = len(aligner.bytes_b)
            pairs, place, times = np.unique(
                x.a_ids[x.left].astype(np.int64) * width + x.b_ids[x.right], return_inverse=True, return_counts=True
            )
            order = np.argsort(-times, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            last_a, _ = x.group_ends()
            per_text = [np.diff(x.a_at), np.diff(x.b_at), np.diff(np.searchsorted(last_a, x.a_at)), np.diff(x.link_at)]
            lists = [ids, *per_text, aligner.group_digests(x), pairs[order] // width, pairs[order] % width, times[order]]
            kinds = [pa.int64()] * 5 + [pa.string(), pa.int32(), pa.int32(), pa.int64()]
            columns = [
                pa.array([number], pa.int64()), *[pa.array([values], pa.list_(kind)) for values, kind in zip(lists, kinds, strict=True)],
                pa.array([pack(rank[place].tobytes())], pa.binary()),
            ]
            number += 1
            yield pa.RecordBatch.from_arrays(columns, names)

    return _rows(docs, key, text).mapInArrow(per_batch, CHUNKS)


def pair_counts(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunk, place, a, b, times) of the chunks' pairs, and (a, b, total, best) of the whole corpus.

    A pair meets here once for each chunk that has it, so frequent pairs are counted before anything moves. A B id has
    at most as many pairs as A has ids.
    """
    pairs = chunks.select("chunk", F.posexplode(F.arrays_zip("pair_a", "pair_b", "times")).alias("place", "pair")).select(
        "chunk", "place", F.col("pair.pair_a").alias("a"), F.col("pair.pair_b").alias("b"), F.col("pair.times").alias("times")
    )
    totals = pairs.groupBy("a", "b").agg(F.sum("times").alias("total"))
    return pairs, totals.select("*", (F.col("total") == F.max("total").over(Window.partitionBy("b"))).alias("best"))


def alignment_summary(
    docs: DataFrame, a_path: str, b_path: str, *, key: str = "doc_id", text: str = "text", chars: int = CHUNK_CHARS
) -> DataFrame:
    """SUMMARY of every row: numbers of tokens, groups and links, of the links whose id pair is the most frequent one of
    its B id in the corpus, the sum of the links' pair counts, and a digest of the groups.

    A null, empty or differently written text has zeros and an empty digest; rows with one id each have their row.
    Corpus counts come back by chunk: a chunk asks once for each pair it holds, however many links have it.
    """
    chunks = saved(alignment_chunks(docs, a_path, b_path, key=key, text=text, chars=chars), "alignment-chunks")
    pairs, totals = pair_counts(chunks)
    answers = pairs.select(F.col("chunk").alias("asked_by"), "place", "a", "b").join(totals, ["a", "b"]).select("asked_by", "place", "total", "best")

    def sums(own: pa.Table, answered: pa.Table) -> pa.Table:
        import zstandard

        place = answered["place"].to_numpy()
        total, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        total[place], best[place] = answered["total"].to_numpy(), answered["best"].to_numpy()
        row = {name: own[name][0] for name in own.column_names}
        links = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["links"].as_py()), np.uint32)
        at = np.cumsum([0, *row["n_links"].as_py()])
        n_best, count_sum = (np.diff(np.append(0, np.cumsum(values[links]))[at]) for values in (best, total))
        given = {name: row[name].values for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        return pa.table(given | {"n_best": n_best, "count_sum": count_sum, "groups_sha256": row["groups_sha256"].values})

    return chunks.drop("pair_a", "pair_b", "times").groupBy("chunk").cogroup(answers.groupBy("asked_by")).applyInArrow(sums, SUMMARY)
