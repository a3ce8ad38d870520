"""Operators against brute force on small tables with odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codelode.llm import common, decontam, embedding_dedup, license_scan, line_dedup, ngram_join, packing, quality, revisits, sharding, token_counts
from codelode.llm.common import connected_components

RANKS, VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SPACE = b" \t\n\x0b\x0c\r"


def component_of(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return lambda x: root(x)


# --- helpers

def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    links += [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    root = component_of(links)
    assert got == {x: root(x) for pair in links for x in pair if pair[0] != pair[1]}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_few_links_need_no_round(spark, monkeypatch):
    """Each round's exchanges keep threads in the driver, and a whole round was run to see that nothing changes."""
    rounds = []
    monkeypatch.setattr(common, "stored", lambda frame, put=common.stored: rounds.append(put(frame)) or rounds[-1])
    links = [(10 * i, 10 * i + k) for i in range(1, 6) for k in range(1, 6)] + [(13, 21), (25, 31)]
    root = component_of(links)
    found = connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert sorted(map(tuple, found)) == sorted((x, root(x)) for x in {x for pair in links for x in pair})
    assert len(rounds) == 1
    parted = lambda edges, join=common._locally_joined: join(edges.repartition(7, F.rand(1)))
    monkeypatch.setattr(common, "_locally_joined", parted)
    assert sorted(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect())) == sorted(map(tuple, found))


def test_few_links_are_joined_by_one_task_however_many_hold_them(spark, monkeypatch):
    """With partitions that aren't merged, each round stored a file for each of them."""
    puts = []
    monkeypatch.setattr(common, "stored", lambda frame, put=common.stored: puts.append(put(frame)) or puts[-1])
    merged = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)]
        frame = spark.createDataFrame(links, "a long, b long").repartition(9)
        found = {r.node: r.component for r in connected_components(frame, "a", "b").collect()}
        assert found == {x: 0 if x < 100 else 100 for pair in links for x in pair}
        assert [x.rdd.getNumPartitions() for x in puts] == [1]
        monkeypatch.setattr(common, "LOCAL_EDGES", 20)
        assert {r.node: r.component for r in connected_components(frame, "a", "b").collect()} == found
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)


def test_sets_of_a_slice_are_made_piece_by_piece(monkeypatch):
    texts = ["a b c d e", "", "a b", "x " * 50 + "y z", "a b c d e", "  ", "q"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    whole = common.shingle_sets(*common.word_hashes(data, offsets), 3)
    sizes = []
    hashed = lambda part, *rest: sizes.append(len(part)) or common.word_hashes(part, *rest)
    monkeypatch.setattr(ngram_join, "word_hashes", hashed)
    monkeypatch.setattr(ngram_join, "HASHED_BYTES", 12)
    pieces = ngram_join._slice_sets(data, offsets, 3)
    assert all((a == b).all() for a, b in zip(pieces, whole, strict=True))
    assert len(sizes) > 2 and sum(sizes) == len(data)


# --- 1 token counts

def test_counts_equal_a_unigram_model_on_the_same_pieces(spark, documents, odd_rows):
    import sentencepiece
    from tokenizers import models

    processor = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    vocabulary = [(processor.id_to_piece(i), processor.get_score(i)) for i in range(processor.get_piece_size())]
    scores, unknown, _ = token_counts.pieces(PIECES)
    hidden = unknown - 1e6  # control and byte pieces never stand in a text
    model = models.Unigram([(p, s if p in scores else hidden) for p, s in vocabulary], 0, True)
    lowest = unknown + token_counts.UNKNOWN_PENALTY
    trie = token_counts.Trie(scores, unknown, max(map(len, scores)))

    def brute(word):
        """Best (score, longest last piece) by plain dynamic programming over all splits."""
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            options = [(best[s][0] + scores[word[s:end]], -s, best[s][1] + 1) for s in range(end) if word[s:end] in scores]
            if word[end - 1] not in scores:
                options.append((best[end - 1][0] + lowest - 10, -(end - 1), best[end - 1][1] + len(word[end - 1].encode())))
            top = max(options)
            best.append((top[0], top[2]))
        return best[-1][1]

    texts = {t for _, t in odd_rows if t and len(t) < 5000}
    pre = {"▁" + w for t in texts for line in t.split("\n") if line for w in line.split(" ")}
    assert {w: trie.add(w) for w in pre} == {w: brute(w) for w in pre}
    plain = [w for w in pre if all(c in scores for c in w)]
    agree = [len(model.tokenize(w)) == trie.add(w) for w in plain]
    assert sum(agree) == len(agree)
    got = token_counts.count_tokens(documents(odd_rows, extra=True), PIECES).collect()
    expected = Counter()
    for i, t in odd_rows:
        parts = [w for line in (t or "").split("\n") if line for w in ("▁" + x for x in line.split(" "))]
        breaks = (t or "").count("\n")
        expected[i, len(parts) + breaks, sum(map(trie.add, parts)) + breaks * trie.add("\n")] += 1
    assert Counter(map(tuple, got)) == expected


def test_a_small_trie_gives_the_same_counts(monkeypatch):
    scores, unknown, longest = token_counts.pieces(PIECES)
    words = [f"▁{a}{b}" for a in ("th", "the", "then", "zzz", "日本") for b in ("", "re", "ere", "ing", "𝒳")]
    wide = token_counts.Trie(scores, unknown, longest)
    expected = [wide.add(w) for w in words]
    monkeypatch.setattr(token_counts, "TRIE_NODES", 5)
    monkeypatch.setattr(token_counts, "WORD_CHARS", 4)
    small = token_counts.Trie(scores, unknown, longest)
    assert [small.add(w) for w in words] == expected


# --- 2 licences

def test_rules_take_sequences_before_single_sentences(spark, documents):
    header = (
        'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\n'
        "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, "
    )
    rows = [
        (1, None), (2, ""), (3, "Words.\nReleased under the MIT License.\nMore words"), (4, "released under the mit license"),
        (5, "junk | word |\nLicensed under CC BY-NC 4.0.\nAll rights reserved."), (6, header), (7, "Licensed under the Secret License."),
        (None, "All rights reserved. All rights reserved!"), (3, "Words.\nReleased under the MIT License.\nMore words"), (9, "No such words."),
    ]
    got = Counter((r.doc_id, r.licence, r.statements) for r in license_scan.license_statements(documents(rows, extra=True)).collect())
    assert got[3, "MIT", 1] == 2 and got[4, "MIT", 1] == 1 and got[5, "CC-BY-NC-4.0", 1] == 1 and got[5, "all-rights-reserved", 1] == 1
    assert got[6, "Apache-2.0", 1] == 1 and got[7, "unknown", 1] == 1 and got[None, "all-rights-reserved", 2] == 1
    assert not [k for k in got if k[0] in (1, 2, 9)]
    assert license_scan.license_statements(documents([])).count() == 0


MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """Copyright 2020 Someone

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
BSD = """Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""


def test_standard_texts_in_wrapped_layout_are_whole_licences(spark, documents):
    texts = {1: MIT, 2: APACHE, 3: BSD, 4: GPL}
    rows = [(i, t) for i, t in texts.items()] + [(10 + i, "Words before\n\n" + t.replace("\n", "\r\n")) for i, t in texts.items()]
    got = {(r.doc_id, r.rule, r.licence) for r in license_scan.license_statements(documents(rows)).collect() if r.licence != "unknown"}
    whole = {1: (1, "MIT"), 2: (0, "Apache-2.0"), 3: (3, "BSD"), 4: (2, "GPL-3.0-or-later")}
    assert got == {(i + add, *x) for i, x in whole.items() for add in (0, 10)}


# --- 3 sharding

def test_slots_are_gapless_and_growth_only_fills_the_new_shard(spark, documents, odd_rows):
    rows = odd_rows + [(7000, "hot")] * 500
    got = sharding.assign_shards(documents(rows, extra=True), [1.0] * 4).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.text_crc32, r["size"]) for r in got) == Counter((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 4)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    assert sharding.assign_shards(documents([]), [1.0, 2.0]).count() == 0


def test_shares_follow_the_weights(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    share = {r.shard: r["count"] / 20_000 for r in keys.select(sharding.shard_of(F.col("k"), [1, 2, 0, 5]).alias("shard")).groupBy("shard").count().collect()}
    assert set(share) == {0, 1, 3} and abs(share[0] - 1 / 8) < 0.02 and abs(share[3] - 5 / 8) < 0.02


# --- 4 decontamination

def test_masks_meet_every_pattern_of_changes():
    for n in range(decontam.SPAN, decontam.WINDOW + 1):
        allowed = n * decontam.SUBSTITUTIONS // decontam.WINDOW
        for changed in combinations(range(n), allowed):
            assert any(
                not set(place + k for k in mask) & set(changed)
                for mask in decontam.MASKS
                for place in range(n - mask[-1])
            ), (n, changed)


def test_leaks_equal_brute_force(spark, documents):
    rng = random.Random(5)
    vocabulary = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([5, 7, 8, 9, 12, 13, 14, 20, 30, 40])]
    items += [(50, None), (51, ""), (9, items[9][1])]
    rows = [(1, None), (2, ""), (None, items[8][1])]
    for i in range(10, 110):
        parts = [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        planted = rng.choice([t for _, t in items if t]).split()
        begin = rng.randrange(max(1, len(planted) - 5))
        planted = planted[begin : begin + rng.randrange(5, 40)]
        for _ in range(rng.randrange(4)):
            planted[rng.randrange(len(planted))] = "CHANGED"
        rows.append((i, " ".join([*parts, *planted, *parts[:5]]).replace("t1 ", "T1, ")))
    benchmark = spark.createDataFrame(items, "item_id long, text string")

    def tokens(t):
        return "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()

    expected = {}
    for d, text in rows:
        mine = tokens(text)
        for b, item in set(items):
            theirs = tokens(item)
            window = min(13, len(theirs))
            hits = []
            for shift in range(-len(theirs), len(mine)):
                agree = [mine[j + shift] == theirs[j] for j in range(len(theirs)) if 0 <= j + shift < len(mine)]
                best = max((sum(agree[k : k + window]) for k in range(len(agree) - window + 1)), default=0)
                if len(theirs) >= 8 and best >= window - window * 2 // 13 or len(theirs) == best > 0:
                    hits.append(best)
            if hits:
                expected[d, b] = (len(hits), max(hits))
    got = {(r.doc_id, r.item_id): (r.alignments, r.matched) for r in decontam.leaks(documents(rows, extra=True), benchmark).collect()}
    assert got == expected and len(got) > 20
    assert decontam.leaks(documents([]), benchmark).count() == 0
    assert decontam.leaks(documents(rows), benchmark.limit(0)).count() == 0


def test_a_benchmark_beyond_the_broadcast_bound_gives_the_same_leaks(spark, documents, monkeypatch):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, "x y " + item.replace("delta", "DELTA!") + " z"), (2, "alpha beta gamma")]
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", 0)
    assert [tuple(r) for r in decontam.leaks(documents(rows), benchmark).collect()] == [(1, 1, 1, 10)]


def test_rows_of_one_id_and_without_id_are_aligned_on_their_own(spark, documents):
    item = " ".join(f"item{i}" for i in range(20))
    seed_only = " ".join([*item.split()[:7], *(f"other{i}" for i in range(13))])
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    for doc_id in (7, None):
        for rows in ([(doc_id, seed_only), (doc_id, item)], [(doc_id, item), (doc_id, seed_only)]):
            got = decontam.leaks(documents(rows).coalesce(1), benchmark).collect()
            assert [tuple(r) for r in got] == [(doc_id, 1, 1, 13)]


def test_short_items_and_items_of_scripts_without_spaces(spark, documents):
    seven, chinese = "only seven words stand in this item", "机器学习的模型需要大量的训练数据才能得到好的结果吗"
    benchmark = spark.createDataFrame([(1, seven), (2, chinese), (3, "一二三")], "item_id long, text string")
    rows = [(10, f"before. {seven.upper()}, after"), (11, seven.replace("words", "other")), (12, f"前面{chinese}后面"), (13, chinese.replace("大", "小")), (14, chinese[3:14]),
            (15, "一二三四 一二三"), (16, "一二四"), (None, seven), (17, None)]
    got = sorted((tuple(r) for r in decontam.leaks(documents(rows), benchmark).collect()), key=repr)
    assert got == sorted([(10, 1, 1, 7), (12, 2, 1, 13), (13, 2, 1, 13), (15, 3, 2, 3), (None, 1, 1, 7)], key=repr)


# --- 5 n-gram join

def sets_of(rows, size):
    out = defaultdict(list)
    for i, t in rows:
        w = [x.lower() for x in (t or "").encode().split()]
        out[i].append(frozenset(tuple(w[j : j + size]) for j in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    return out


@pytest.mark.parametrize("size,threshold,hubs", [(3, Fraction(9, 10), 2), (5, Fraction(8, 10), 2), (2, Fraction(1, 2), 0), (2, Fraction(7, 10), 1)])
def test_components_equal_all_pairs(spark, documents, odd_rows, size, threshold, hubs):
    rng = random.Random(11)
    rows = [*odd_rows]
    for family in range(8):
        base = [f"f{family}x{rng.randrange(50)}" for _ in range(60)]
        for k in range(12):
            copy = [*base]
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(len(copy))] = f"c{rng.randrange(5)}"
            rows.append((1000 + family * 100 + k, " ".join(copy[: rng.randrange(50, 61)])))
    got = ngram_join.near_duplicates(documents(rows, extra=True), size=size, threshold=threshold, hub_rounds=hubs).collect()
    sets = sets_of([r for r in rows if r[0] is not None], size)
    links = []
    for a, b in combinations(sorted(sets), 2):
        if any(x and y and threshold.denominator * len(x & y) >= threshold.numerator * len(x | y) for x in sets[a] for y in sets[b]):
            links.append((a, b))
    root = component_of(links)
    named = Counter((i, len(s), root(i)) for i, several in sets.items() for s in several)
    nameless = [next(iter(sets_of([(0, t)], size).values()))[0] for i, t in rows if i is None]  # these are linked with nothing
    assert Counter(map(tuple, got)) == named + Counter((None, len(s), None) for s in nameless)
    assert len(links) > 20


def test_no_documents_no_links(spark, documents):
    for rows in ([], [(1, None), (2, ""), (3, "")]):
        got = ngram_join.near_duplicates(documents(rows), size=3, threshold=Fraction(9, 10)).collect()
        assert sorted(map(tuple, got)) == [(i, 0, i) for i, _ in rows]


# --- 6 line dedup

def lines_by_hand(rows, least=10):
    def key(line):
        line = line.encode().strip(SPACE).lower()
        return line if len(line.decode()) >= least else None

    owner = defaultdict(set)
    for i, t in rows:
        if i is not None and t is not None:
            for line in t.split("\n"):
                owner[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or key(x) is None or min(owner[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return Counter(out)


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_lines_stay_in_their_first_document(spark, documents, odd_rows, batches):
    docs = documents(odd_rows, extra=True)
    got = line_dedup.dedup_lines(docs, batches=batches)
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect()) == lines_by_hand(odd_rows)
    assert line_dedup.dedup_lines(documents([])).count() == 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_runs_")]


# --- 7 revisits

def test_revisits_take_the_latest_earlier_response(spark):
    h = lambda **k: {x.replace("_", "-"): v for x, v in k.items()}
    rows = [
        (1, 100, "http://www.A.example/p/index.html#x", "response", h(etag='"1"', content_type="t", date="d1"), "D1"),
        (2, 5000, "https://a.example/p?utm_source=q", "response", h(etag='W/"2"', vary="v", x_cache="miss"), "D2"),
        (3, 5000, "https://a.example/p", "response", h(etag='"3"'), "D3"),
        (10, 100, "a.example/p", "revisit", h(etag='"1"'), None), (11, 101, "a.example/p", "revisit", h(etag='"1"', date="d2", x_cache="hit"), None),
        (12, 4999, "a.example/p/", "revisit", h(etag='"2"'), None), (13, 5001, "a.example:443/p", "revisit", h(etag='W/"3"'), None),
        (14, 90_000, "a.example/p?z=1", "revisit", h(etag='"1"'), None), (15, 90_000, "A.example/p", "revisit", h(last_modified="m"), "D3"),
        (16, 90_000, "a.example/p", "revisit", None, None), (17, None, "a.example/p", "revisit", h(etag='"3"'), None), (18, 90_000, None, "revisit", h(etag='"3"'), None),
        (None, 90_000, "a.example/p", "revisit", h(etag='"3"'), None), (4, None, "a.example/p", "response", h(etag='"9"'), "D9"),
    ]
    got = {r.record_id: (r.response_id, r.state, r.headers) for r in revisits.resolve_revisits(spark.createDataFrame(rows, revisits.RECORDS)).collect()}
    assert got[10] == (None, "missing", None)
    assert got[11] == (1, "resolved", {"etag": '"1"', "content-type": "t", "date": "d2"})
    assert got[12] == (1, "mismatch", None)
    assert got[13][:2] == (3, "resolved") and got[13][2] == {"etag": 'W/"3"'}
    assert got[14][1] == "missing" and got[15][:2] == (3, "resolved") and got[16][:2] == (3, "unproven")
    assert got[17][1] == "missing" and got[18][1] == "missing" and None not in got and len(got) == 9
    assert revisits.resolve_revisits(spark.createDataFrame([], revisits.RECORDS)).count() == 0


def test_as_of_over_blocks_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(40_000), f"h{rng.choice([0, 0, 0, 1, 2])}/x", rng.choice(["response", "revisit"]), {"etag": "e"}, "d") for i in range(600)]
    got = {r.record_id: r.response_id for r in revisits.resolve_revisits(spark.createDataFrame(rows, revisits.RECORDS)).collect()}
    for i, ts, url, kind, _, _ in rows:
        if kind == "revisit":
            earlier = [(t, j) for j, t, u, k, _, _ in rows if k == "response" and u == url and t < ts]
            assert got.pop(i) == (max(earlier)[1] if earlier else None)
    assert not got


def test_repeated_records_give_a_row_each(spark):
    rows = [(1, 10, "a/p", "response", {"etag": "1"}, "D1")] * 2 + [(1, 10, "a/p", "response", {"etag": "0"}, "D0"), (1, 5, "a/p", "response", {"etag": "9"}, "D9")]
    rows += [(2, 20, "a/p", "revisit", {"etag": "1"}, None)] * 2 + [(2, 20, "a/p", "revisit", {"etag": "x"}, None)]
    got = sorted((r.record_id, r.response_id, r.state, r.digest) for r in revisits.resolve_revisits(spark.createDataFrame(rows, revisits.RECORDS)).collect() if r.state == "resolved")
    assert got == [(2, 1, "resolved", "D1")] * 2
    assert revisits.resolve_revisits(spark.createDataFrame(rows, revisits.RECORDS)).count() == 3


# --- 8 packing

def first_fit_by_hand(sizes, capacity):
    bins, out = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = next((k for k, used in enumerate(bins) if used + sizes[i] <= capacity), len(bins))
        bins += [0] * (k == len(bins))
        out[i] = (k, bins[k])
        bins[k] += sizes[i]
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 400])
def test_tree_gives_first_fit_decreasing(n):
    rng = np.random.default_rng(n)
    sizes = rng.integers(1, 1025, n)
    bins, offsets = packing.first_fit_decreasing(sizes, 1024)
    assert list(zip(bins.tolist(), offsets.tolist())) == first_fit_by_hand(sizes.tolist(), 1024)


def test_every_token_lies_in_one_piece(spark, documents, odd_rows):
    from tokenizers import Tokenizer

    rows = [*odd_rows, (80, "a <|endoftext|> b"), (81, " " * 1_200_000 + "x"), (82, "y" * 50_000)]
    slow = Tokenizer.from_file(VOCABULARY)
    pieces = packing.token_pieces(documents(rows, extra=True), RANKS, VOCABULARY, with_ids=True)
    got = packing.pack(pieces, group_rows=50).collect()
    whole = defaultdict(list)
    for i, t in rows:
        whole[i].append([*slow.encode(t or "", add_special_tokens=False).ids, 0])
    parts, sequences = defaultdict(dict), defaultdict(list)
    for r in got:
        assert len(r.ids) == r.length <= 1024 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        parts[r.doc_id, r.doc_tokens].setdefault(r.start, []).append(r.ids)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, several in whole.items():
        for ids in several:
            got_ids = [x for start in sorted(parts[i, len(ids)]) for x in parts[i, len(ids)][start][0]]
            assert got_ids == ids
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(packing.token_pieces(documents([]), RANKS, VOCABULARY)).count() == 0


# --- 9 quality

def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.quality_score(docs.select("doc_id", "text"), quality.train(docs, labels, per_class=300))
    rows = scored.join(labels, "doc_id").where(quality.is_held_out(F.col("doc_id"))).select("score", "quality").collect()
    right = sum((r.score >= 0.5) == bool(r.quality) for r in rows) / len(rows)
    assert right > 0.97 and len(rows) > 1000


def test_scores_of_odd_rows_and_missing_labels(spark, documents, odd_rows):
    docs = documents(odd_rows, extra=True)
    for rows, expected in (([], 0.5), ([(10, 1, 0), (None, 0, 0), (11, None, 0), (12, 7, 0)], 1.0)):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        model = quality.train(docs, labels)
        got = quality.quality_score(docs, model).select("score").collect()
        assert len(got) == len(odd_rows) and all(abs(r.score - expected) < 0.01 for r in got)
    assert quality.quality_score(documents([]), model).count() == 0


def test_scores_do_not_depend_on_the_batch():
    import pyarrow as pa

    model = quality.Model(np.random.default_rng(1).normal(size=1 << quality.BITS).astype("f4"), 0.1)
    texts = ["some words here", "", None, "x" * 5000, "ümlaut ünd\tmore\nwords words"]
    together = model.score(pa.array(texts))
    assert np.allclose(together, [model.score(pa.array([t], pa.string()))[0] for t in texts])


# --- 10 embeddings

def test_links_of_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows, vectors = [], {}
    centres = rng.normal(size=(12, 16))
    for i in range(400):
        v = (centres[i % 12] + rng.normal(size=16) * 0.12).astype("f4") if i % 3 else rng.normal(size=16).astype("f4")
        vectors[i] = v
    for i in range(400, 1000):
        vectors[i] = (centres[0] + rng.normal(size=16) * rng.choice([0.05, 0.2])).astype("f4")
    for i in range(1000, 1100):
        vectors[i] = vectors[5]
    rows = [(i, [float(x) for x in v]) for i, v in vectors.items()]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [None] + [1.0] * 15), (2004, [float("nan")] * 16), (2005, [float("inf")] * 16), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (None, [9.0, -1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("class", F.lit("x")).withColumn("links", F.lit(1))
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(frame).collect()}
    ids = np.array(list(vectors))
    unit = np.array([vectors[i] for i in ids], dtype=float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    for i in np.flatnonzero(np.unique(unit, axis=0, return_inverse=True)[1] == np.unique(unit, axis=0, return_inverse=True)[1][5]):
        near[i, i] = True
    links = [(int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero(np.triu(near, 1)))]
    root = component_of(links)
    exact = {int(i): int(n) - 1 for i, n in zip(ids, near.sum(1))}
    assert {i: (got[i].n_links, got[i].component_id) for i in exact} == {i: (n, root(i)) for i, n in exact.items()}
    assert got[2006].n_links == got[2007].n_links == 1 and got[2007].component_id == 2006
    for i in range(2000, 2006):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].n_links == 0 and got[None].kept is False
    assert embedding_dedup.near_vectors(frame.limit(0)).count() == 0


def test_small_windows_find_the_links_of_large_tables(spark):
    """Windows of 40 places in 3,000 vectors, half of them in one direction: many blocks, ranges and rounds."""
    from codelode.llm.common import saved

    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(3_000, 24))
    vectors[:1500] = rng.normal(size=24) * 2 + vectors[:1500]
    vectors[1:3_000:10] = vectors[0:3_000:10] + rng.normal(size=(300, 24)) * 0.15
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = vectors.astype("f4").astype(float)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    root = component_of([(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near, 1)))])
    frame = saved(spark.createDataFrame(pa.table({"vec_id": np.arange(3_000), "embedding": list(vectors.astype("f4"))})), "test-vectors")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(frame, window=40).collect()}
    right = [got[i].component_id == root(i) and got[i].n_links == near[i].sum() - 1 for i in range(3_000) if near[i].sum() > 1]
    assert len(right) > 500 and np.mean(right) >= 0.99
    assert all(got[i].n_links <= near[i].sum() - 1 for i in range(3_000))


@pytest.mark.parametrize("cosine", [0.7, 0.85])
def test_planted_pairs_in_a_hot_direction_are_found(spark, cosine):
    from codelode.llm.common import saved

    rng = np.random.default_rng(8)
    rows, width, pairs = 100_000, 64, 2_000

    def unit(x):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)

    vectors = unit(rng.normal(size=(rows, width)))
    hot = rows // 3
    away = unit(rng.normal(size=(hot, width)))
    vectors[:hot] = unit(np.sqrt(cosine) * unit(rng.normal(size=width)) + np.sqrt(1 - cosine) * away)
    for begin in (0, hot):  # partners at cosine 0.955, half of them inside the hot third
        one = vectors[begin : begin + pairs]
        side = vectors[begin + pairs : begin + 2 * pairs]
        side = unit(side - (side * one).sum(1, keepdims=True) * one)
        vectors[begin + pairs : begin + 2 * pairs] = 0.955 * one + np.sqrt(1 - 0.955**2) * side
    frame = saved(spark.createDataFrame(pa.table({"vec_id": np.arange(rows), "embedding": list(vectors.astype("f4"))})), "test-vectors")
    got = embedding_dedup.near_vectors(frame).select("vec_id", "component_id", "n_links").toPandas().sort_values("vec_id")
    component, links = got["component_id"].to_numpy(), got["n_links"].to_numpy()
    for begin in (0, hot):
        ours, theirs = np.arange(begin, begin + pairs), np.arange(begin + pairs, begin + 2 * pairs)
        recall = np.mean((component[ours] == component[theirs]) & (links[ours] > 0))
        print(f"recall of planted pairs, cosine {cosine}, from {begin}: {recall:.4f}")
        assert recall >= 0.999
