"""Edge cases on miniature tables."""

import random

import numpy as np
from pyspark.sql import functions as F

from codelode.catalogue import Catalogue
from codelode.functions import text as X
from codelode.operators import evidence as E
from codelode.operators import graph as G
from codelode.operators import rank as K
from codelode.operators import report as N
from codelode.operators import retrieve as R
from codelode.operators import structure as C
from codelode.operators import sync as S


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_duplicate_names_are_rejected():
    catalogue = Catalogue()
    catalogue.query("a")(lambda spark, sf: None)
    try:
        catalogue.query("a")(lambda spark, sf: None)
    except ValueError:
        return
    raise AssertionError("duplicate accepted")


def test_phrasal_join_stems_the_first_word(spark):
    assert "login" in one(spark, X.query_terms(F.lit("users log in here")))
    assert "loggin" in one(spark, X.query_terms(F.lit("users logged in here")))
    assert one(spark, X.query_terms(F.lit("getUserName snake_case"))) == [
        "getusername", "get", "user", "name", "snake_case", "snake", "case"
    ]


SCOPE = "repository_id string, index_version int"


def ranked(spark, rows, scopes=(("a", 1),)):
    return spark.createDataFrame(
        [(1, *scope, i + 1000 * n, "f.py", s, e, score, "hybrid", ["lexical"], str(i)) for n, scope in enumerate(scopes) for i, (s, e, score) in enumerate(rows)],
        f"query_id int, {SCOPE}, chunk_id int, file_path string, start_line int, end_line int, score double, signal string, "
        "signals array<string>, content string",
    )


def test_half_overlap_is_kept_and_more_is_dropped(spark):
    kept = K.overlap_dedupe(ranked(spark, [(1, 10, 0.9), (6, 15, 0.8), (2, 11, 0.7)]))
    assert sorted(r.chunk_id for r in kept.collect()) == [0, 1]


def test_gap_of_five_merges_and_six_does_not(spark):
    merged = K.adjacent_merge(ranked(spark, [(1, 10, 0.9), (15, 20, 0.8), (26, 30, 0.7)]))
    assert sorted((r.start_line, r.end_line) for r in merged.collect()) == [(1, 20), (26, 30)]


def test_one_path_in_two_corpora_and_versions_stays_apart(spark):
    rows = [(1, 10, 0.9), (2, 11, 0.7), (15, 20, 0.8)]
    frame = ranked(spark, rows, (("a", 1), ("a", 2), ("b", 1)))
    assert sorted(r.chunk_id for r in K.overlap_dedupe(frame).collect()) == [0, 2, 1000, 1002, 2000, 2002]
    merged = K.adjacent_merge(frame).collect()
    assert sorted((r.repository_id, r.index_version, r.content) for r in merged) == [(a, v, "0\n1\n2") for a, v in (("a", 1), ("a", 2), ("b", 1))]


def test_symbols_are_owned_inside_their_corpus_version_only(spark):
    matches = spark.createDataFrame(
        [("q", "a", 1, 7, "run", "src/app.py", 5, 6, 1.0, "exact_case_sensitive")],
        f"query_id string, {SCOPE}, symbol_id int, name string, file_path string, start_line int, end_line int, score double, match_type string")
    chunks = spark.createDataFrame(
        [("a", 1, 1, "src/app.py", "run", 1, 9), ("a", 2, 2, "src/app.py", "run", 1, 9), ("b", 1, 3, "src/app.py", "run", 1, 9)],
        f"{SCOPE}, chunk_id int, file_path string, symbol_name string, start_line int, end_line int")
    assert [r.chunk_id for r in R.symbol_owner_chunks(matches, chunks).collect()] == [1]


def test_islands_across_line_blocks(spark):
    random.seed(1)
    spans = [(s, s + random.randint(0, 300)) for s in random.sample(range(1, 5000), 60)]
    frame = ranked(spark, [(s, e, 0.5) for s, e in spans])
    from codelode.functions import scale

    got = scale.islands(frame, ["query_id"], "start_line", "end_line", [F.asc("start_line"), F.asc("end_line"), F.asc("chunk_id")], 5)
    expected, reach, label = {}, None, None
    for i, (s, e) in sorted(enumerate(spans), key=lambda x: (x[1], x[0])):
        if reach is None or s - reach > 5:
            label = s
        reach = e if reach is None else max(reach, e)
        expected[i] = label
    assert {r.chunk_id: r.island for r in got.collect()} == expected


def test_equal_scores_normalise_to_one(spark):
    frame = spark.createDataFrame([(1, 1, "lexical", 2.0), (1, 2, "lexical", 2.0)], "query_id int, chunk_id int, signal string, raw_score double")
    assert {r.norm_score for r in K.normalize_scores(frame).collect()} == {1.0}


def test_budget_stops_at_the_first_oversize_item(spark):
    rows = [(1, str(i), "CODE", "r", f"f{i}", 1, 2, None, 1.0 - i / 100, False, c) for i, c in enumerate([100, 40000, 100])]
    frame = spark.createDataFrame(
        rows, "context_id int, evidence_id string, source_type string, repository_id string, file_path string, start_line int, "
        "end_line int, url string, score double, is_structural boolean, chars long")
    assert [r.evidence_id for r in E.context_budget(frame).collect()] == ["0"]


def vectors(spark, rows, key, column, start=0):
    data = [("a" if i % 2 else "b", 1, i + start, None if v is None else [float(x) for x in v]) for i, v in enumerate(rows)]
    return spark.createDataFrame(data, f"{SCOPE}, {key} int, {column} array<double>")


def test_vector_search_in_many_blocks_equals_numpy(spark, monkeypatch):
    """More questions and vectors than one block and slice hold, with nulls, zero vectors and equal vectors."""
    random.seed(2)
    monkeypatch.setattr(R, "SLICE_VECTORS", 7)
    monkeypatch.setattr(R, "BLOCK_QUESTIONS", 3)
    data = [[random.random() for _ in range(8)] for _ in range(60)] + [[0.0] * 8, [0.0] * 8, None, None]
    data += data[:6]
    asked = [[random.random() for _ in range(8)] for _ in range(20)] + [None, None]
    got = {}
    for r in R.semantic_topk(vectors(spark, data, "chunk_id", "embedding"), vectors(spark, asked, "query_id", "query_embedding"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id))
    expected = {}
    for q, v in enumerate(asked):
        if v is not None:
            rows = [(i, np.array(d)) for i, d in enumerate(data) if d is not None and i % 2 == q % 2]
            cosine = {i: round(float(d @ v / (np.linalg.norm(d) * np.linalg.norm(v) or 1)), 12) for i, d in rows}
            expected[q] = sorted(cosine, key=lambda i: (-cosine[i], i))[:5]
    assert {q: [c for _, c in sorted(rows)] for q, rows in got.items()} == expected


def test_short_questions_match_inside_words(spark):
    chunks = spark.createDataFrame(
        [("a", 1, 1, "f", 1, "the concatenate call"), ("a", 1, 2, "g", 1, "no hit"), ("a", 1, 3, "h", 1, "cat here"), ("b", 1, 4, "h", 1, "cat here")],
        f"{SCOPE}, chunk_id int, file_path string, start_line int, content string")
    queries = spark.createDataFrame([("a", 1, 1, "cat")], f"{SCOPE}, query_id int, query_text string")
    scores = {r.chunk_id: (r.hits, r.phrase) for r in R.lexical_scores(chunks, queries).collect()}
    assert scores == {1: (0, 1), 3: (1, 1)}


def test_fuzzy_score_equal_to_the_threshold_is_excluded(spark):
    def grams(x):
        p = f"  {x} "
        return [p[i:i + 3] for i in range(len(p) - 2)]

    names, asked = ["alpha", "alpine", "beta", "al"], ["alpaca", "bet"]
    symbols = spark.createDataFrame([("a", 1, n) for n in names], f"{SCOPE}, name string")
    queries = spark.createDataFrame([("a", 1, q, q) for q in asked], f"{SCOPE}, query_id string, query_text string")
    got = {(r.query_id, r.name): r.score for r in R.name_similarity(symbols, queries).collect()}
    expected = {}
    for q in asked:
        for n in names:
            a, b = grams(q), grams(n)
            score = (2 * sum(min(a.count(g), b.count(g)) for g in set(a)) / (len(a) + len(b)))
            if score > 0.3:
                expected[(q, n)] = score
    assert got == expected


def test_window_split_sizes(spark):
    rows = [(str(n), "x" * n) for n in (4000, 4001, 7700)]
    drafts = spark.createDataFrame(rows, "path string, content string").withColumns(
        {"start_line": F.lit(1), "end_line": F.lit(1), "parent_symbol": F.lit(None).cast("string"), "symbol_name": F.lit("s")})
    counts = {(r.path, r.segment_count): r.n for r in C.split_large_chunks(drafts).groupBy("path", "segment_count").agg(F.count("*").alias("n")).collect()}
    assert counts == {("4000", 1): 1, ("4001", 2): 2, ("7700", 3): 2}


def test_long_gap_lines_are_cut_and_packed(spark):
    content = "\n".join(["a" * 700, "b" * 700, "c" * 700, "d" * 3200, "e"]) + "\n"
    files = spark.createDataFrame([("r", "f.py", content)], "repository_id string, path string, content string")
    drafts = spark.createDataFrame([], "repository_id string, path string, start_line int, end_line int")
    got = sorted((r.start_line, r.end_line, len(r.content)) for r in C.module_gap_chunks(drafts, files).collect())
    assert got == [(1, 2, 1402), (3, 3, 701), (4, 4, 201), (4, 4, 1500), (4, 4, 1500), (5, 5, 2)]


def test_unknown_shas_count_as_unchanged(spark):
    schema = "repository_id string, path string, sha string"
    old = spark.createDataFrame([("r", "a", None), ("r", "b", "1"), ("r", "c", "1")], schema)
    new = spark.createDataFrame([("r", "a", None), ("r", "b", "2"), ("r", "d", "1")], schema)
    assert {r.path: r.change for r in S.snapshot_diff(old, new).collect()} == {
        "a": "UNCHANGED", "b": "CHANGED", "c": "DELETED", "d": "NEW"}


def test_all_unknown_tokens_stay_unknown(spark):
    calls = spark.createDataFrame([(1, "A", 5, None, None)], "run_id int, slot string, latency_ms long, input_tokens long, output_tokens long")
    assert N.model_totals(calls).first().input_tokens is None


def test_calls_on_imported_modules_are_unresolved(spark):
    nodes = spark.createDataFrame(
        [("n", "f", ["get", "save", "ValueError"], [], "requests.get(x); item.save()", "import requests\n", [])],
        "node_id string, symbol string, calls array<string>, direct_calls array<string>, source_text string, file_text string, explicit array<string>")
    none = spark.createDataFrame([], "node_id string")
    assert [tuple(r) for r in G.unresolved_calls(nodes, none).collect()] == [("n", "get")]


def parsed(spark, path, text):
    return C.extract_files(spark.createDataFrame([("r", path, text)], "repository_id string, path string, content string")).first()


def test_a_route_call_takes_the_method_of_its_own_arguments(spark):
    row = parsed(spark, "a.ts", "export function go() {\n  fetch('/a');\n  fetch('/b', { method: 'POST', body: pack(1) });\n}\n")
    assert [(c.path, c.method) for c in row.symbols[0].route_calls] == [("/a", "GET"), ("/b", "POST")]


def test_brackets_in_regular_expressions_strings_and_comments_pair_up(spark):
    text = "// (\nconst clean = (s) => {\n  return s.replace(/[(]\\(/g, '(').trim();\n};\n"
    row = parsed(spark, "a.js", text)
    assert row.parse_ok and [(x.name, x.start_line, x.end_line, x.lead_line, x.calls) for x in row.symbols] == [("clean", 2, 4, 1, ["replace", "trim"])]
    assert not parsed(spark, "a.js", "const f = () => {\n").parse_ok


def test_python_blocks_decorators_nested_functions_and_imports(spark):
    text = (
        "import os, sys as system\nfrom .pkg import (\n    one,\n    two as deux,\n)\n\n# lead\n@mark\n@app.post('/x')\nasync def outer(\n    a,\n):\n"
        "    def inner():\n        return a()\n    return inner(not_called)\n\n\nclass Box(Base, mod.Mixin):\n    '(text'\n    def get(self):\n        return self.put('(')\n"
    )
    row = parsed(spark, "test_a.py", text)
    got = [(x.name, x.declared, x.start_line, x.end_line, x.lead_line, x.parent, x.calls, x.direct_calls, x.bases, x.api_routes) for x in row.symbols]
    assert got == [
        ("outer", "function", 8, 15, 6, None, ["a", "inner"], ["a", "inner"], [], ["@app.post('/x')"]),
        ("Box", "class", 18, 21, 16, None, [], [], ["Base", "mod.Mixin"], []),
        ("get", "method", 20, 21, 20, "Box", ["put"], [], [], []),
    ]
    assert row.is_test and [(i.module, i.names, i.start_line, i.end_line) for i in row.imports] == [("os", ["os", "sys"], 1, 1), (".pkg", ["one", "two"], 2, 5)]


def test_line_offsets_count_characters(spark):
    texts = ["", "ab", "ab\n", "é\n\nx", "\n", "日本\ny\n", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(1)
    got = {r.i: r.o for r in frame.select("i", C.line_offsets(F.col("t")).alias("o")).collect()}
    assert [got[i] for i in range(7)] == [[0, 0], [0, 2], [0, 3], [0, 2, 3, 4], [0, 1], [0, 3, 5], [0, 0]]


def test_a_flow_walks_string_ids(spark):
    rows = [("a:1", "a:2", "two", "f.py", "CALLS"), ("a:2", "a:3", "Three", "g.py", "CALLS"), ("a:2", "a:1", "one", "f.py", "API_CALL")]
    neighbors = spark.createDataFrame(rows, "from_id string, to_id string, target_name string, target_file string, kind string")
    entries = spark.createDataFrame([("q", "a:1"), ("lone", "z:9")], "query_id string, symbol_id string")
    got = {r.query_id: (r.path, len(r.edges), r.is_partial) for r in G.flow_trace(entries, neighbors).collect()}
    assert got == {"q": (["a:1", "a:2", "a:3"], 3, False), "lone": (["z:9"], 0, False)}
