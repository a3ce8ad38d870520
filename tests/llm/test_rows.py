"""Rows without id, repeated ids, clashing names, and workers without the package."""

import subprocess
import sys
from fractions import Fraction
from pathlib import Path

from pyspark.sql import functions as F

from codelode.llm import line_dedup, ngram_join, quality


def test_rows_without_id_are_documents(spark, documents):
    rows = [(5, "a b c d e"), (None, "A b c d e"), (None, "x y z"), (None, "x  y z"), (None, None), (None, "lone words here"), (7, "x y z"), (8, None)]
    got = ngram_join.near_duplicates(documents(rows), size=3, threshold=Fraction(9, 10)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        [(5, 3, 5), (None, 3, 5), (None, 1, 7), (None, 1, 7), (None, 0, None), (None, 1, None), (7, 1, 7), (8, 0, 8)], key=repr)
    alone = ngram_join.near_duplicates(documents([(None, "x y z")] * 2), size=3, threshold=Fraction(9, 10)).collect()
    assert [tuple(r) for r in alone] == [(None, 1, None)] * 2


def test_line_dedup_keeps_clashing_columns(spark, documents):
    docs = documents([(1, "a line of text\nshort"), (2, "a line of text\nother line here")])
    for name in ("_doc", "_keys", "_out", "_KEYS_"):
        docs = docs.withColumn(name, F.lit(name))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[2].kept == "other line here" and got[2].n_dropped == 1 and got[1].n_dropped == 0
    assert (got[1]._doc, got[1]._keys, got[1]._out, got[1]._KEYS_) == ("_doc", "_keys", "_out", "_KEYS_")


def test_a_repeated_labelled_id_trains_by_its_smallest_text(spark, documents):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    rows = [(i, f"{'good words' if i % 2 else 'bad noise'} number {i}") for i in range(40)]
    plain = quality.train(documents(rows), labels)
    extra = [(i, "zz " + t) for i, t in rows]
    for mixed in (rows + extra, extra + rows):
        model = quality.train(documents(mixed), labels)
        assert model.bias == plain.bias and (model.weights == plain.weights).all()


def test_workers_need_no_copy_of_the_package(tmp_path):
    """The driver finds the package by its own path, the workers don't."""
    script = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
import public_tokenizers as P
from codelode.session import local_session
from codelode.llm import alignment, packing, prefix_trie, token_counts
from codelode.llm.common import saved
spark = local_session("ship", "2")
def absent(batches):
    import importlib.util
    assert importlib.util.find_spec("codelode") is None
    yield from batches
docs = saved(spark.createDataFrame([(1, "one text"), (2, None)], "doc_id long, text string"), "docs")
assert docs.mapInArrow(absent, docs.schema).count() == 2
print(token_counts.count_tokens(docs, P.path("piece_bpe_32k.model")).count())
pieces = packing.token_pieces(docs, P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json"))
print(packing.pack(saved(pieces, "pieces")).count())
print(alignment.alignment_summary(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).count())
print(prefix_trie.conversation_trie(saved(spark.createDataFrame([(20, 0, "user", "a")], "conv_id long, turn long, role string, text string"), "talks")).count())
"""
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and done.stdout.split() == ["2", "2", "2", "2"], done.stderr[-2000:]
