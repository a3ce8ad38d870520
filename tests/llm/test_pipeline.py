"""The pipeline against brute force, stage by stage on each stage's own input."""

import random
from collections import defaultdict
from itertools import combinations

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from codelode.llm.common import saved
from tests.llm.conftest import DOCS, words
from tests.llm.test_operators import component_of, lines_by_hand, sets_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def make_corpus(spark, folder):
    rng = random.Random(9)
    rows, labels, junk = [], [], set()
    shared = "this line stands in many documents of the corpus"
    item = " ".join(words(rng, 25, 5000))
    for i in range(120):
        if i % 4 == 3:
            junk.add(i)
            text = " ".join(f"{w}***" for w in words(rng, 60))
        else:
            text = "\n".join([" ".join(words(rng, 40)), shared if i % 2 else "short", " ".join(words(rng, 40))])
        rows.append((i, text))
        labels.append((i, int(i not in junk), 0))
    one_line = words(rng, 100, 2000)
    near = [*one_line]
    near[50] = "changed"
    rows += [(200, rows[4][1]), (201, " ".join(one_line)), (206, " ".join(near)), (202, f"before it {item.replace(' ', '  ', 3)} after it"), (203, rows[3][1]), (204, rows[0][1].upper())]
    changed = item.split(" ")
    changed[7] = "other"
    rows += [(205, " ".join(words(rng, 30)) + " " + " ".join(changed))]
    junk.add(203)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "too short")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return junk, item


def test_every_stage_equals_brute_force(spark, tmp_path):
    junk, item = make_corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs.collect()
        docs = saved(stage(spark, docs, str(tmp_path)), "test-stage")
        if name != "packing":
            assert docs.columns == COLUMNS
    inputs["end"] = docs.collect()

    assert {r.doc_id for r in inputs["line_dedup"]} == {r.doc_id for r in inputs["quality"]} - junk

    before = [(r.doc_id, r.text) for r in inputs["line_dedup"]]
    after = {(r.doc_id, r.text, r.n_chars) for r in inputs["near_duplicates"]}
    assert after == {(i, kept, len(kept)) for i, _, _, kept in lines_by_hand(before)}

    sets = {i: s[0] for i, s in sets_of([(r.doc_id, r.text) for r in inputs["near_duplicates"]], 5).items()}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    root = component_of(links)
    kept = {r.doc_id for r in inputs["decontamination"]}
    assert links and kept == {i for i in sets if root(i) == i} and 201 in kept and 206 not in kept

    clean = {r.doc_id for r in inputs["packing"]}
    theirs = item.split()

    def leaks(text):
        mine = text.lower().split()
        for shift in range(-len(theirs), len(mine)):
            agree = [mine[j + shift] == theirs[j] for j in range(len(theirs)) if 0 <= j + shift < len(mine)]
            if any(sum(agree[k : k + 13]) >= 11 for k in range(len(agree) - 12)):
                return True
        return False

    leaked = {r.doc_id for r in inputs["decontamination"] if leaks(r.text)}
    assert leaked == {202, 205} and clean == kept - leaked

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths, spans, written = defaultdict(int), defaultdict(list), defaultdict(list)
    for r in sorted(inputs["end"], key=lambda r: (r.doc_id, r.start)):
        assert len(r.ids) == r.length
        written[r.doc_id] += r.ids
        lengths[r.doc_id] += r.length
        spans[r.sequence_id].append((r.offset, r.length))
    assert written == {r.doc_id: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0] for r in inputs["packing"]}
    assert lengths == {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in inputs["packing"]}
    for pieces in spans.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_near_copies_are_removed_by_row(spark, documents):
    rng = random.Random(21)
    text = [words(rng, 60, 3000) for _ in range(6)]
    near = [*text[1]]
    near[30] = "changed"
    a, b, c, d, e, f = (" ".join(t) for t in text)
    rows = [(1, a), (5, a), (5, b), (5, c), (6, " ".join(near)), (None, d), (None, d), (None, c), (8, e), (8, e), (None, None), (9, ""), (9, f)]
    got = corpus_pipeline.near_stage(spark, documents(rows), "").collect()
    kept = sorted(((r.doc_id, r.text) for r in got), key=repr)
    assert kept == sorted([(1, a), (5, b), (5, c), (None, d), (8, e), (None, None), (9, ""), (9, f)], key=repr)


def test_leaking_rows_are_removed_by_row(spark, documents, tmp_path):
    item = " ".join(f"item{i}" for i in range(20))
    seed_only = " ".join([*item.split()[:7], *(f"other{i}" for i in range(13))])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(3, seed_only), (3, item), (None, item), (None, seed_only), (None, None), (4, "clean")]
    got = corpus_pipeline.decontamination_stage(spark, documents(rows), str(tmp_path))
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
    assert kept == sorted([(3, seed_only), (None, seed_only), (None, None), (4, "clean")], key=repr)
