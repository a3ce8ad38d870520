"""Quality classifier: hashed word and character n-gram vectors, averaged per document, with a softmax on top."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import mix, text_bytes, word_hashes

BITS = 18
GRAMS = (3, 4)
ECHO = 8
CHUNK_BYTES = 1 << 19
_FLAT = np.arange(256, dtype=np.uint8)
_FLAT[[9, 10, 11, 12, 13]] = 32


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows with about CHUNK_BYTES of text; a longer text is a run of its own."""
    begin, rows = 0, len(offsets) - 1
    while begin < rows:
        end = int(np.searchsorted(offsets, offsets[begin] + CHUNK_BYTES, side="right")) - 1
        end = min(max(end, begin + 1), rows)
        yield begin, end
        begin = end


def _spread(values: np.ndarray) -> np.ndarray:
    return ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of words, word pairs, echoes and character n-grams, one kind at a time.

    An echo is a word n-gram of which only the pattern is hashed: how many words back the same word stands last.
    """
    hashes, row = word_hashes(data, offsets, lower=False)
    if not len(hashes):
        return
    yield row, _spread(hashes)
    same = row[1:] == row[:-1]
    pairs = mix(hashes[:-1] * np.uint64(3) + hashes[1:])[same]
    yield row[1:][same], _spread(pairs)
    back = np.zeros(len(hashes), np.uint64)
    for d in range(min(ECHO, len(hashes) - 1), 0, -1):
        back[d:][(hashes[d:] == hashes[:-d]) & (row[d:] == row[:-d])] = d
    yield row, _spread(mix(back + np.uint64(1 << 60)))
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    np.take(_FLAT, data, out=padded[: len(data)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 8)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for start in range(0, len(data), CHUNK_BYTES):
        at = np.arange(start, min(start + CHUNK_BYTES, len(data)))
        block = np.ascontiguousarray(windows[at[0] : at[-1] + 1]).view("<u8").ravel()
        rows = owner[at]
        left = offsets[rows + 1] - at
        for n in GRAMS:
            whole = left >= n
            gram = (block[whole] & np.uint64((1 << (8 * n)) - 1)) + np.uint64(n << 56)
            yield rows[whole], _spread(mix(gram))


class Model(NamedTuple):
    """What an average of vectors and a two-class softmax come to: one weight per bucket and a bias."""

    weights: np.ndarray
    bias: float

    def score(self, text: pa.Array) -> np.ndarray:
        data, offsets = text_bytes(text)
        out = np.empty(len(offsets) - 1)
        for begin, end in _chunks(offsets):
            total, count = np.zeros(end - begin), np.zeros(end - begin)
            part = offsets[begin : end + 1]
            for row, bucket in features(data[part[0] : part[-1]], part - part[0]):
                total += np.bincount(row, self.weights[bucket], minlength=end - begin)
                count += np.bincount(row, minlength=end - begin)
            out[begin:end] = 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -50, 50)))
        return out


def is_held_out(doc_id: Column) -> Column:
    """One third of the ids is never learned from. A null id isn't held out; it has no label either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct buckets and their shares of each text."""
    for batch in batches:
        data, offsets = text_bytes(batch["text"])
        labels, buckets, shares, ids = [], [], [], []
        for i in range(len(offsets) - 1):
            parts = [bucket for _, bucket in features(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))]
            bucket, count = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int32), np.zeros(0))
            ids.append(batch["doc_id"][i].as_py())
            labels.append(batch["label"][i].as_py())
            buckets.append(bucket.astype("<i4").tobytes())
            shares.append((count / max(count.sum(), 1)).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(labels, pa.int32()), pa.array(buckets, pa.binary()), pa.array(shares, pa.binary())],
            ["doc_id", "label", "buckets", "shares"],
        )


def fit(bags: pd.DataFrame, *, dim: int = 8, epochs: int = 6, rate: float = 20.0, seed: int = 7) -> Model:
    """Stochastic gradient descent, one document at a time, over vectors and softmax together."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    top, bias = rng.normal(0, 0.5, (2, dim)).astype(np.float32), np.zeros(2, np.float32)
    bags = bags.sort_values("doc_id", ignore_index=True)
    rows = [
        (int(y), np.frombuffer(b, "<i4"), np.frombuffer(s, "<f4"))
        for y, b, s in zip(bags["label"], bags["buckets"], bags["shares"], strict=True)
    ]
    seen = np.bincount(bags["label"].to_numpy(), minlength=2)
    if not seen.all():
        return Model(np.zeros(1 << BITS, np.float32), 0.0 if not seen.any() else (9.0 if seen[1] else -9.0))
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, bucket, share = rows[i]
            pace = rate * (1 - step / steps)
            step += 1
            mean = share @ vectors[bucket]
            logits = top @ mean + bias
            chance = np.exp(logits - logits.max())
            error = chance / chance.sum()
            error[label] -= 1
            back = error @ top
            top -= 0.02 * pace * np.outer(error, mean)
            bias -= 0.002 * pace * error
            vectors[bucket] -= pace * np.outer(share, back)
    return Model(vectors @ (top[1] - top[0]), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = 1500) -> Model:
    """Fit on at most `per_class` labelled documents of each class, chosen by a hash of their id.

    The bound is a parameter of the model's training only. Held-out ids are left out; null or other labels are
    ignored; of contradicting labels the lower counts, of several texts of one id the smallest by code points. The sample's ids (2 * per_class rows at most) are broadcast;
    features are made where the texts are, and one task runs the descent over them.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("label = 0").orderBy(*order).limit(per_class).union(known.where("label = 1").orderBy(*order).limit(per_class))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
    bags = texts.mapInArrow(_bag, "doc_id long, label int, buckets binary, shares binary")

    def descend(frame: pd.DataFrame) -> pd.DataFrame:
        model = fit(frame)
        return pd.DataFrame({"weights": [model.weights.astype("<f4").tobytes()], "bias": [model.bias]})

    found = bags.withColumn("task", F.lit(0)).groupBy("task").applyInPandas(descend, "weights binary, bias double").collect()
    if not found:
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    return Model(np.frombuffer(found[0]["weights"], "<f4"), found[0]["bias"])


def quality_score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the chance of label 1; null and empty texts get what the bias alone gives."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(Model(*shared.value).score(text))

    return docs.withColumn(out, score(F.col(text)))
