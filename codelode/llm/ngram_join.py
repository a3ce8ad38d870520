"""Jaccard similarity join on word shingles: rare-first prefixes with length, positional and suffix filters."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import connected_components, mix, saved, shingle_sets, text_bytes, word_hashes

#: Text per slice, whose shingles are packed into one row for each part.
SLICE_BYTES = 4 << 20
#: Text whose words are hashed at once: the arrays of that take some twenty times its bytes.
HASHED_BYTES = 512 << 10
#: Shingles keep 48 bits of their hash, above them stands the frequency class: the global rare-first order.
HASH_BITS = 48
HUB_ROUNDS = 2

_PARTS = pa.schema([("part", pa.int64()), ("slice", pa.int64()), ("owner", pa.binary()), ("shingle", pa.binary()), ("rank", pa.binary())])
_PARTS_SQL = "part long, slice long, owner binary, shingle binary, rank binary"
_SETS_SQL = "doc_id long, n_shingles long, s1 long, s2 long, keys binary"


def _least_overlap(threshold: Fraction, size: np.ndarray) -> np.ndarray:
    """Smallest intersection that a set of this size needs with any partner."""
    return -(-size * threshold.numerator // threshold.denominator)


def _deal(docs: DataFrame, size: int, parts: int) -> DataFrame:
    """Shingle sets of slices of documents, dealt by shingle: one packed row for each slice and part.

    A negative part holds what belongs to the slice itself: its ids, set sizes and set digests.
    """

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            ids = batch["doc_id"].fill_null(0).to_numpy(zero_copy_only=False)
            begin, rows = 0, len(ids)
            while begin < rows:
                end = int(np.searchsorted(offsets, offsets[begin] + SLICE_BYTES, side="right")) - 1
                end = min(max(end, begin + 1), rows)
                part = offsets[begin : end + 1]
                yield slice_rows(number, ids[begin:end], data[part[0] : part[-1]], part - part[0])
                begin, number = end, number + 1

    def slice_rows(number: int, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        value, owner = _slice_sets(data, offsets, size)
        count = np.bincount(owner, minlength=len(ids)).astype("<i8")
        digests = np.zeros((2, len(ids)), dtype=np.uint64)
        if len(value):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            for k, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
                digests[k, owner[first]] = np.add.reduceat(mix(value ^ np.uint64(salt)), first)
        head = np.concatenate([ids.astype("<i8"), count, digests[0].view("<i8"), digests[1].view("<i8")]).tobytes()
        short = value >> np.uint64(64 - HASH_BITS)
        place = (short % np.uint64(parts)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        short, owner, place = short[order], owner[order].astype("<u4"), place[order]
        bounds = np.searchsorted(place, np.arange(parts + 1))
        table: list[list] = [[-1 - number % parts], [number], [head], [None], [None]]
        for k in np.flatnonzero(np.diff(bounds)):
            low, high = bounds[k], bounds[k + 1]
            for column, item in zip(table, (int(k), number, owner[low:high].tobytes(), _packed(short[low:high]), None), strict=True):
                column.append(item)
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(table, _PARTS, strict=True)], schema=_PARTS)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    return source.mapInArrow(per_batch, _PARTS_SQL)


def _slice_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """`shingle_sets` of the rows of a slice, made from about HASHED_BYTES of text at a time."""
    parts, begin, rows = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0, len(offsets) - 1
    while begin < rows:
        end = int(np.searchsorted(offsets, offsets[begin] + HASHED_BYTES, side="right")) - 1
        end = min(max(end, begin + 1), rows)
        part = offsets[begin : end + 1]
        value, owner = shingle_sets(*word_hashes(data[part[0] : part[-1]], part - part[0]), size)
        parts.append((value, owner + begin))
        begin = end
    value, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
    return value, owner


def _packed(short: np.ndarray) -> bytes:
    return (short & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (short >> np.uint64(32)).astype("<u2").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n = len(data) // 6
    low = np.frombuffer(data, "<u4", count=n).astype(np.uint64)
    return low | (np.frombuffer(data, "<u2", offset=4 * n, count=n).astype(np.uint64) << np.uint64(32))


def _arrays(column: pa.Array, kind: str) -> Iterator[np.ndarray]:
    """The packed array of each row, without copies of the column."""
    data, offsets = text_bytes(column)
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield np.frombuffer(data, kind, count=(end - begin) // 8, offset=begin)


def _rank(table: pa.Table) -> pa.Table:
    """Exact document frequency of the shingles of one part; only those of two or more documents go on."""
    if table["part"][0].as_py() < 0:
        return table
    pieces = [_unpacked(x) for x in table["shingle"].to_pylist()]
    _, index, count = np.unique(np.concatenate(pieces), return_inverse=True, return_counts=True)
    rank = np.minimum(8 * np.log2(count), 255).astype(np.uint8)[index]
    owners, shingles, ranks, at = [], [], [], 0
    for piece, owner in zip(pieces, table["owner"].to_pylist(), strict=True):
        own = rank[at : at + len(piece)]
        at += len(piece)
        shared = own > 0
        owners.append(np.frombuffer(owner, "<u4")[shared].tobytes())
        shingles.append(_packed(piece[shared]))
        ranks.append(own[shared].tobytes())
    return pa.Table.from_arrays(
        [table["part"], table["slice"], *(pa.array(x, pa.binary()) for x in (owners, shingles, ranks))], schema=_PARTS
    )


def shared_sets(docs: DataFrame, size: int, threshold: Fraction) -> DataFrame:
    """Per document: set size, set digests, and `keys`: its shingles that other documents have too, rarest first.

    Shingles of one document only can't be in an intersection, so `keys` is enough to verify a pair. It is null
    where too few shingles are shared for any partner. Frequencies are counted where the shingles meet, over packed
    arrays: each shingle moves once as six bytes and once more if it is shared. A slice is known by its task and its
    place there, so `docs` has to be a stored table, which a repeated task reads in the same order.
    """
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def assemble(table: pa.Table) -> pa.Table:
        owners, keys, head = [], [], None
        for part, owner, shingle, rank in zip(*(table[c].to_pylist() for c in ("part", "owner", "shingle", "rank")), strict=True):
            if part < 0:
                head = np.frombuffer(owner, "<i8").reshape(4, -1)
            else:
                owners.append(np.frombuffer(owner, "<u4"))
                keys.append((np.frombuffer(rank, np.uint8).astype(np.uint64) << np.uint64(HASH_BITS)) | _unpacked(shingle))
        ids, count, s1, s2 = head
        owner = np.concatenate(owners) if owners else np.zeros(0, np.uint32)
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.lexsort((key, owner))
        owner, key = owner[order], key[order]
        bounds = np.searchsorted(owner, np.arange(len(ids) + 1))
        enough = (np.diff(bounds) >= _least_overlap(threshold, count)) & (count > 0)
        packed = [key[bounds[i] : bounds[i + 1]].astype("<u8").tobytes() if enough[i] else None for i in range(len(ids))]
        columns = [pa.array(x) for x in (ids, count, s1, s2)] + [pa.array(packed, pa.binary())]
        return pa.Table.from_arrays(columns, ["doc_id", "n_shingles", "s1", "s2", "keys"])

    ranked = _deal(docs, size, parts).groupBy("part").applyInArrow(_rank, _PARTS_SQL)
    return saved(ranked.groupBy("slice").applyInArrow(assemble, _SETS_SQL), "shared-sets")


def _postings(sets: DataFrame, threshold: Fraction) -> DataFrame:
    """(key, class, n, pos, doc_id) of the prefix shingles; copies of one set are one class with its smallest doc_id."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch["n_shingles"].to_numpy()
            keys, rows, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for row, (size, need, own) in enumerate(zip(n, _least_overlap(threshold, n), _arrays(batch["keys"], "<i8"), strict=True)):
                alone = size - len(own)  # shingles of no other document come first in the order
                prefix = own[: size - need + 1 - alone]
                keys.append(prefix)
                rows.append(np.full(len(prefix), row))
                places.append(alone + np.arange(len(prefix)))
            row = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), batch["class"].take(pa.array(row)), pa.array(n[row]), pa.array(np.concatenate(places)),
                 batch["doc_id"].take(pa.array(row))],
                ["key", "class", "n", "pos", "doc_id"],
            )

    source = sets.where("keys IS NOT NULL").select("doc_id", "n_shingles", "keys", "class")
    rows = source.mapInArrow(per_batch, "key long, class long, n long, pos long, doc_id long")
    return rows.groupBy("key", "class", "n", "pos").agg(F.min("doc_id").alias("doc_id"))


def _suffix_may_reach(a: np.ndarray, b: np.ndarray, most: int, depth: int = 3) -> bool:
    """Whether two ordered sets can differ in at most `most` elements, by halving them around pivots of b."""
    spans = [(0, len(a), 0, len(b))]
    for _ in range(depth):
        spans, distance = [
            part
            for a0, a1, b0, b1 in spans
            for mid in [(b0 + b1) // 2]
            for cut in [a0 + int(np.searchsorted(a[a0:a1], b[mid])) if b1 > b0 else a0]
            for part in ((a0, cut, b0, mid), (cut, a1, mid, b1))
        ], 0
        distance = sum(abs((a1 - a0) - (b1 - b0)) for a0, a1, b0, b1 in spans)
        if distance > most:
            return False
    return True


def _verified(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """Links among the pairs (left, left_class, right, right_class); every pair is compared once."""
    t = threshold

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.zeros(len(batch), dtype=bool)
            sizes = (batch[c].to_pylist() for c in ("left_n", "right_n"))
            sets = (_arrays(batch[c], "<u8") for c in ("left_keys", "right_keys"))
            for i, (na, nb, a, b) in enumerate(zip(*sizes, *sets, strict=True)):
                need = -(-(na + nb) * t.numerator // (t.numerator + t.denominator))
                if min(len(a), len(b)) < need or not _suffix_may_reach(a, b, len(a) + len(b) - 2 * need):
                    continue
                hit[i] = len(np.intersect1d(a, b, assume_unique=True)) >= need
            keep = pa.array(hit)
            yield pa.RecordBatch.from_arrays([batch["left"].filter(keep), batch["right"].filter(keep)], ["left", "right"])

    side = sets.where("keys IS NOT NULL").select("doc_id", "class", F.col("n_shingles").alias("n"), "keys")
    for name in ("right", "left"):
        pairs = pairs.join(
            side.select(*[F.col(c).alias(f"{name}{'_' + c if c != 'doc_id' else ''}") for c in side.columns]), [name, f"{name}_class"]
        )
    source = pairs.select("left", "right", "left_n", "left_keys", "right_n", "right_keys")
    return source.mapInArrow(per_batch, "left long, right long")


def near_duplicates(docs: DataFrame, *, size: int, threshold: Fraction, hub_rounds: int = HUB_ROUNDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document, linked where the Jaccard similarity of its shingles with
    another one's reaches `threshold`.

    Documents without words are linked with nothing. Rows that share a doc_id are one node and give a row each. A row
    without a doc_id is a node of its own; its component is the smallest doc_id that it reaches, if any. Equal sets are one class before any pair is made. A list of documents that share a prefix shingle isn't
    paired with itself: first every document meets one hub of its list, and after that only documents of different
    components meet, until no list has such a pair that the filters allow. So no link is lost between components, and
    a large group of near copies costs one pair for each document, not for each two of them.
    """
    top, nameless = docs.agg(F.max(F.col("doc_id").cast("long")), F.count(F.when(F.col("doc_id").isNull(), 1))).first()
    if nameless:
        top = top if top is not None else -1
        own = F.lit(top + 1) + F.monotonically_increasing_id()
        named = saved(docs.select(F.coalesce(F.col("doc_id").cast("long"), own).alias("doc_id"), "text"), "named-rows")
        found = near_duplicates(named, size=size, threshold=threshold, hub_rounds=hub_rounds)
        real = lambda c: F.when(F.col(c) <= top, F.col(c)).alias(c)
        return found.select(real("doc_id"), "n_shingles", real("component_id"))
    sets = shared_sets(docs, size, threshold).withColumn("class", F.xxhash64("n_shingles", "s1", "s2"))
    postings = _postings(sets, threshold)
    # Counting doc_id keeps the exchange below both uses the same, so it is made once.
    lists = postings.groupBy("key").agg(F.count("doc_id").alias("len")).where("len > 1").select("key")
    postings = saved(postings.join(lists, "key"), "shared-postings")
    linked = sets.where("keys IS NOT NULL")
    smallest = linked.groupBy("class").agg(F.min("doc_id").alias("first"))
    links = linked.join(smallest, "class").where("doc_id <> first").select(F.col("doc_id").alias("left"), F.col("first").alias("right"))
    links = saved(links.distinct(), "links")
    low, high = f"least(n, hub.n) * {threshold.denominator}", f"greatest(n, hub.n) * {threshold.numerator}"
    for number in range(hub_rounds):
        placed = postings if number == 0 else _in_several(postings, links)
        # Few rare shingles before the key: close to what the list has in common. A drawn one gets another chance after that.
        draw = F.xxhash64("class", F.lit(number))
        order = F.struct(F.col("pos") if number == 0 else draw, draw)
        hubs = placed.groupBy("key").agg(F.min_by(F.struct("doc_id", "class", "n"), order).alias("hub"))
        pairs = (
            placed.join(hubs, "key")
            .where(f"class <> hub.class AND doc_id <> hub.doc_id AND {low} >= {high}")
            .select(
                F.col("hub.doc_id").alias("left"), F.col("hub.class").alias("left_class"),
                F.col("doc_id").alias("right"), F.col("class").alias("right_class"),
            )
            .distinct()
        )
        links = links.union(saved(_verified(pairs, sets, threshold), "links"))
    placed = saved(_in_several(postings, links), "open-postings")
    main = placed.groupBy("key", "component").agg(F.count("*").alias("len")).groupBy("key").agg(F.max_by("component", "len").alias("main"))
    marked = placed.join(main, "key")
    a, b = marked.where("component <> main").alias("a"), marked.alias("b")
    # The position filter is exact list by list: at the first shared key of a pair it is weakest, and that list has the pair.
    total = f"ceil((a.n + b.n) * {threshold.numerator} / {threshold.numerator + threshold.denominator})"
    met = a.join(b, F.expr(
        "a.key = b.key AND a.component <> b.component AND (b.component = b.main OR a.class < b.class)"
        f" AND least(a.n, b.n) * {threshold.denominator} >= greatest(a.n, b.n) * {threshold.numerator}"
        f" AND least(a.n - a.pos, b.n - b.pos) >= {total}"
    ))
    sides = [F.struct(*[F.col(f"{x}.{c}").alias(c) for c in ("class", "doc_id")]) for x in "ab"]
    pairs = (
        met.select(F.least(*sides).alias("l"), F.greatest(*sides).alias("r"))
        .select(F.col("l.doc_id").alias("left"), F.col("l.class").alias("left_class"), F.col("r.doc_id").alias("right"), F.col("r.class").alias("right_class"))
        .distinct()
    )
    links = links.union(saved(_verified(pairs, sets, threshold), "links"))
    found = connected_components(links, "left", "right")
    return sets.select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


def _in_several(postings: DataFrame, links: DataFrame) -> DataFrame:
    """Postings with their component, of the lists that hold more than one."""
    found = connected_components(links, "left", "right")
    placed = postings.join(found, F.col("doc_id") == F.col("node"), "left").select(
        *postings.columns, F.coalesce("component", "doc_id").alias("component")
    )
    several = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return placed.join(several.select("key"), "key")
