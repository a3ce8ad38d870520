"""Plans and steps that have to stay bounded when the tables grow."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from codelode.functions import lookup, scale
from codelode.operators import evidence as E
from codelode.operators import hybrid as H
from codelode.operators import memory as M
from codelode.operators import rank as K
from codelode.operators import retrieve as R
from codelode.sources.tables import Tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", ["resolve_edges", "unresolved_calls", "flow_walk"])
def test_symbols_are_not_sent_to_every_task(spark, key):
    """Exploded symbols look small to Spark, so it gathered them in the driver to broadcast them."""
    plan = entry.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


def test_related_chunks_are_not_gathered(spark):
    """Questions, seeds and their symbols are stored or exploded, so they looked small and went through the driver."""
    t = Tables(spark, SF)
    matches = R.symbol_matches(t.symbols(), t.symbol_queries())
    ranked = R.owner_pairs(matches, t.symbol_chunks()).select("query_id", *R.SCOPE, "chunk_id", "score", "file_path", "start_line", "end_line", F.lit("symbol").alias("signal"))
    added = K.structural_expand(ranked, ranked, t.symbol_chunks(), t.symbols(), t.edges())
    for frame in (ranked, added, entry.queries()["related_chunks"](spark, SF)):
        assert "BroadcastExchange" not in frame._jdf.queryExecution().executedPlan().toString()
    assert added.count()


@pytest.mark.parametrize("key", ["symbol_owner_chunks", "contained_symbols"])
def test_pairs_are_dealt_before_they_are_grouped(spark, key):
    """The join's tasks sorted or gathered all rows that they made, to group them before the shuffle."""
    plan = entry.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in next(line for line in plan.splitlines() if "Exchange" in line)


def test_fuzzy_names_meet_their_first_symbols_only(spark):
    """Every symbol of a name met every question close to that name before the best ten were taken."""
    rows = [("c", 1, 1000 + i, "load_thing") for i in range(400)] + [("c", 1, i, "load_think") for i in range(400)]
    symbols = spark.createDataFrame(rows, "repository_id string, index_version int, symbol_id long, name string")
    queries = spark.createDataFrame([("q", "c", 1, "load_thinz")], "query_id string, repository_id string, index_version int, query_text string")
    found = R.symbol_fuzzy(symbols, queries)
    assert [r.symbol_id for r in found.orderBy("name", "symbol_id").collect()] == list(range(1000, 1010))
    joined, ranked = [], [found._jdf.queryExecution().optimizedPlan()]
    while ranked:
        node = ranked.pop()
        ranked += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join" and "symbol_id" in node.output().mkString():
            joined.append(node)
    sides = [side.toString() for node in joined for side in (node.left(), node.right()) if "symbol_id" in side.output().mkString()]
    assert sides and all("row_number" in side for side in sides)


def test_context_texts_move_once(spark):
    """Texts went through every shuffle that looks for neighbouring intervals."""
    nodes, windows = [entry.queries()["build_context"](spark, SF)._jdf.queryExecution().optimizedPlan()], 0
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Window":
            windows += 1
            assert "content#" not in node.output().mkString()
    assert windows


def test_memories_of_contexts_are_not_shuffled_as_pairs(spark, monkeypatch):
    """Pairs were made once per shared keyword and shuffled to be made distinct; ids in two corpora are found once."""
    monkeypatch.setattr(lookup, "SLICE_ITEMS", 3)
    monkeypatch.setattr(lookup, "BLOCK_QUESTIONS", 2)
    memories = spark.createDataFrame(
        [("a", i, f"login token page {i}", False) for i in range(9)] + [("b", 1, "login token", False), ("b", 50, None, False), ("b", 51, "login", True), (None, 60, "login", False)],
        "repository_id string, memory_id long, topic string, is_stale boolean")
    contexts = spark.createDataFrame(
        [("x", "a", "token login", ""), ("x", "b", "token login", ""), ("y", "a", "?", ""), ("y", "b", "?", ""), ("z", "b", "ogi", ""), ("n", "a", None, None), (None, "b", "login", "")],
        "context_id string, repository_id string, query_text string, task_type string")
    found = E.memory_filter(memories, contexts)
    everything = range(9)
    expected = [("x", i) for i in everything] + [("y", i) for i in everything] + [("n", i) for i in everything] + [("y", 50), ("z", 1), (None, 1)]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    assert found._jdf.queryExecution().optimizedPlan().nodeName() == "FlatMapCoGroupsInArrow"


def test_found_memories_are_numbered_without_sorting_pairs(spark, monkeypatch):
    """Pairs were made once per shared word, shuffled to be made distinct and sorted to be numbered."""
    monkeypatch.setattr(lookup, "SLICE_ITEMS", 3)
    monkeypatch.setattr(lookup, "BLOCK_NUMBERED", 2)
    monkeypatch.setattr(lookup, "PIECE_QUESTIONS", 1)
    rows = [("a", i, "login tokens", f"page{i % 3} configuration_tables", False, i % 4) for i in range(9)]
    rows += [("a", 3, "login", "x", False, 9), ("b", 50, None, "login", False, None), ("b", 51, "login", "", True, 1), (None, 60, "login", "", False, 1), ("a", None, "login", "", False, 1)]
    memories = spark.createDataFrame(rows, "repository_id string, memory_id long, topic string, content string, is_stale boolean, updated_at int")
    asked = [("x", "a", "token login"), ("x", "a", "PAGE1"), ("y", "a", "?"), ("z", "a", "page2"), ("long", "a", "configuration_table"), ("not", "a", "configuration_lists"), ("n", "a", None), (None, "b", "ogi"), ("w", None, "login")]
    queries = spark.createDataFrame(asked, "query_id string, repository_id string, query_text string")

    def order(ids):
        dated = [(r[5], r[1]) for r in rows[:10] if r[1] in ids]
        return [i for _, i in sorted(dated, key=lambda p: (-p[0], p[1]))]

    def numbered(found):
        got = {}
        for r in found.collect():
            got.setdefault(r.query_id, {})[r.position] = r.memory_id
        return {q: [ids[at] for at in range(1, len(ids) + 1)] for q, ids in got.items()}

    everything, expected = order(range(9)), {None: [50]}
    expected |= {"x": everything, "y": everything, "long": everything, "z": order((2, 5, 8))}
    found = M.memory_search(memories, queries)
    assert numbered(found) == expected
    assert numbered(M.memory_search(memories, queries, limit=2)) == {q: ids[:2] for q, ids in expected.items()}
    several = queries.union(spark.createDataFrame([("y", "b", "absent"), ("y", "b", "login")], queries.schema))
    assert numbered(M.memory_search(memories, several)) == expected | {"y": [*everything, 50]}
    nodes = [found._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() in ("Window", "Aggregate"):
            said = node.output().mkString()
            assert not ("query_id#" in said and "memory_id#" in said)


def test_long_needles_meet_few_words(spark):
    """A needle met every word that holds its first three letters; now up to eight letters have to agree."""
    words = spark.createDataFrame([(w,) for w in ("authentication", "authenticated", "theorem", "them", "ab", "a" * 300)], "word string")
    needles = spark.createDataFrame([(n,) for n in ("the", "them", "authentic", "authenticate", "authentications", "entica", "a" * 250)], "needle string")
    pairs = lookup.word_pairs(words, needles)
    assert sorted(map(tuple, pairs.collect())) == sorted([
        ("the", "authentication"), ("the", "authenticated"), ("the", "theorem"), ("the", "them"), ("them", "them"), ("authentic", "authentication"), ("authentic", "authenticated"),
        ("authenticate", "authenticated"), ("entica", "authentication"), ("entica", "authenticated"), ("a" * 250, "a" * 300),
    ])
    assert "substring(needle" in pairs._jdf.queryExecution().optimizedPlan().toString() and "1, 8)" in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_keys_of_memories_are_numbers(spark):
    """Corpus and keyword were written out for each key of each copy of a memory and of a question."""
    plan = entry.queries()["memory_filter"](spark, SF)._jdf.queryExecution().optimizedPlan()
    for side in (plan.left(), plan.right()):
        assert any(f.name() == "keys" and f.dataType().simpleString() == "array<bigint>" for f in [side.schema().apply(i) for i in range(side.schema().size())])


def test_places_are_not_gathered_per_question(spark):
    """Each place of a word was shuffled once for every question that has the word."""
    nodes, seen = [entry.queries()["fulltext_rank"](spark, SF)._jdf.queryExecution().optimizedPlan()], 0
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Aggregate" and "chunk_id#" in node.output().mkString():
            seen += 1
            assert "query_id#" not in node.output().mkString()
    assert seen


def test_covers_are_ranked_where_texts_meet_questions(spark, monkeypatch):
    """Every chunk was joined to every question of its corpus version, and each word of the texts was stemmed before the words were distinct."""
    monkeypatch.setattr(R, "SLICE_CHUNKS", 2)
    monkeypatch.setattr(R, "BLOCK_QUESTIONS", 2)
    texts = ["logins token page", "the Tokens of a login; token", "page page", None, "", "login", "absent login page of tokens"]
    chunks = spark.createDataFrame(
        [("a", 1, i, text) for i, text in enumerate(texts)] + [("a", 1, 5, "tokens"), ("a", 1, None, "login token"), ("b", 1, 20, "login token"), (None, 1, 21, "login")],
        "repository_id string, index_version int, chunk_id long, content string")
    queries = spark.createDataFrame(
        [("a", 1, "both", "login token"), ("a", 1, "both", "login token"), ("a", 1, "any", "page missing"), ("a", 1, "none", "of the"), ("a", 1, "far", "missing"), ("a", 1, None, "login"), ("b", 1, "b", "tokens")],
        "repository_id string, index_version int, query_id string, query_text string")
    found = R.fulltext_rank(chunks, queries, 3)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.chunk_id, r.is_strict, r.raw_score)
    # The two rows of chunk 5 are one text whose first words share a place.
    assert got == {
        "both": {1: (5, True, 1.0), 2: (1, True, 0.75), 3: (None, True, 0.5)}, "any": {1: (2, False, 0.2), 2: (0, False, 0.1), 3: (6, False, 0.1)},
        "b": {1: (20, True, 0.1)},
    }
    nodes, met = [found._jdf.queryExecution().optimizedPlan()], 0
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        said = node.output().mkString() if node.nodeName() in ("Join", "Window") else ""
        assert not ("chunk_id#" in said and "query_id#" in said and "_terms#" in said)
        met += node.nodeName() == "FlatMapCoGroupsInArrow"
    assert met == 1


def test_lexical_pairs_are_not_shuffled(spark, monkeypatch):
    """Every pair of a question and a chunk that share a word was shuffled; now a task hands on its best k of each question."""
    monkeypatch.setattr(R, "SLICE_CHUNKS", 2)
    monkeypatch.setattr(R, "BLOCK_QUESTIONS", 2)
    texts = ["login token page", "the Token of a login; token", "concatenate", "page page", None, "", "login", "a token page of login"]
    chunks = spark.createDataFrame(
        [("a", 1, i, f"f{9 - i}" if i else None, 1, text) for i, text in enumerate(texts)] + [("b", 1, 20, "f", 1, "login token")],
        "repository_id string, index_version int, chunk_id long, file_path string, start_line int, content string")
    queries = spark.createDataFrame(
        [("a", 1, "both", "login token"), ("a", 1, "any", "login absent"), ("a", 1, "cat", " cat"), ("a", 1, "said", "Token of a login"), ("a", 1, "none", "of the"), ("b", 1, "b", "token")],
        "repository_id string, index_version int, query_id string, query_text string")
    found = R.lexical_topk(chunks, queries, 3)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.chunk_id, r.is_strict, r.raw_score)
    assert got == {
        "both": {1: (0, True, 4.0), 2: (1, True, 4.0), 3: (7, True, 3.0)},
        "any": {1: (0, False, 1.5), 2: (7, False, 1.5), 3: (6, False, 1.5)},
        "cat": {1: (2, False, 1.0)}, "said": {1: (1, True, 5.0), 2: (0, True, 3.0), 3: (7, True, 3.0)}, "b": {1: (20, True, 3.0)},
    }
    nodes, joins = [found._jdf.queryExecution().optimizedPlan()], 0
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        joined = node.output().mkString() if node.nodeName() == "Join" else ""
        assert not ("chunk_id#" in joined and "query_id#" in joined)
        joins += node.nodeName() == "FlatMapCoGroupsInArrow"
    assert joins == 1


def test_ranking_carries_no_texts(spark):
    """The texts of all candidates went through each step of the ranking, to be read for the first k rows only."""
    scope = "repository_id string, index_version int"
    chunks = spark.createDataFrame(
        [("a", 1, f"c{i}", "f", 10 * i, 10 * i + 9, f"text {i}", None) for i in (2, 10, 30)],
        f"{scope}, chunk_id string, file_path string, start_line int, end_line int, content string, symbol_name string")
    queries = spark.createDataFrame([("a", 1, "q", "words")], f"{scope}, query_id string, query_text string")
    found = spark.createDataFrame(
        [("q", f"c{i}", "lexical", float(i), []) for i in (2, 10, 30)],
        "query_id string, chunk_id string, signal string, raw_score double, matched array<struct<name:string,match_type:string>>")
    fused = H.fuse(found, chunks, queries)
    assert "content" not in fused.columns
    merged = K.merge_runs(K.adjacent_runs(K.overlap_survivors(fused.withColumn("start_line", F.expr("if(chunk_id = 'c10', 30, start_line)")), ["signals"])))
    top = H.with_texts(merged.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("start_line"))), chunks)
    assert [(r.source_ids, r.content) for r in top.orderBy("rank").collect()] == [(["c10", "c2"], "text 2\ntext 10"), (["c30"], "text 30")]


def test_citations_are_checked_once_for_their_summary(spark):
    """Totals and the histogram each read the checks, so all their joins ran twice."""
    checked = spark.createDataFrame(
        [("r", "a", None), ("r", "b", "X"), ("r", "a", None), ("r", "c", "X"), ("r", "d", "Y"), ("s", "a", None), ("t", "b", "Y"), ("u", None, None)],
        "response_id string, evidence_id string, reason string")
    got = {r.response_id: (r.total, r.accepted, r.rejected, r.kept_ids, r.reasons) for r in E.citation_summary(checked).collect()}
    assert got == {"r": (5, 2, 3, ["a"], {"X": 2, "Y": 1}), "s": (1, 1, 0, ["a"], {}), "t": (1, 0, 1, [], {"Y": 1}), "u": (1, 1, 0, [], {})}
    plan = entry.queries()["citation_summary"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 3


def test_intervals_are_ranked_once(spark):
    """Each pass over the intervals ranked all candidates again, and the survivors were looked up in them."""
    kept = entry.queries()["overlap_dedupe"](spark, SF)
    assert kept.inputFiles() and not any("lineitem" in name for name in kept.inputFiles())
    assert "LeftSemi" not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_evidence_is_read_once_to_reserve_web_rows(spark):
    """The evidence was made distinct anew for the budget, for its web rows and for the row to reserve."""
    plan = entry.queries()["web_reservation"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan
    rows = [(c, f"{c}{i}", "CODE", 10, 0.9 - i / 100, True) for c in ("a", "b", "c", None) for i in range(5)]
    rows += [("a", "aw", "WEB", 15, 0.1, True), ("a", "av", "WEB", 5, 0.05, True), ("b", "bw", "WEB", 5, 0.1, False), ("c", "cw", "WEB", 90, 0.1, True), (None, "w", "WEB", 12, 0.95, True), ("d", "dw", "WEB", 20, 0.5, None)]
    evidence = spark.createDataFrame(rows, "context_id string, evidence_id string, source_type string, chars int, score double, is_external boolean").selectExpr(
        "*", "false AS is_structural", "'f' AS file_path", "1 AS start_line")
    got = {}
    for r in E.web_reservation(evidence, items=4, chars=36).collect():
        got.setdefault(r.context_id, []).append(r.evidence_id)
    assert {c: sorted(ids) for c, ids in got.items()} == {
        "a": ["a0", "a1", "aw"], "b": ["b0", "b1", "b2"], "c": ["c0", "c1", "c2"], None: ["None0", "None1", "None2", "w"], "d": ["dw"]}


@pytest.mark.parametrize("longest", [0, 3, 100])
def test_islands_of_long_and_short_keys(spark, monkeypatch, longest):
    """Every key's rows went through eight shuffles to be cut into line blocks; now that is for long keys only."""
    monkeypatch.setattr(scale, "LONG_KEY", longest)
    spans = [("a", 1, 4, 1), ("a", 8, 9, 1), ("a", 700, 2000, 700), ("a", 900, 901, 700), ("a", 2004, 2005, 700), ("a", 2020, 2020, 2020), ("b", 5, None, 5), ("b", 9, 9, 9), ("c", 3, 3, 3), ("c", 3, 3, 3)]
    frame = spark.createDataFrame([(*x, i) for i, x in enumerate(spans)] + [(None, 1, 2, 0, 20), ("a", None, 2, 0, 21)], "k string, s int, e int, want int, id int")
    found = scale.islands(frame, ["k"], "s", "e", [F.asc("s"), F.asc("e"), F.asc("id")], 5)
    shuffles = found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles == 1 if longest == 100 else shuffles > 1
    assert sorted((r.id, r.island) for r in found.collect()) == [(i, x[3]) for i, x in enumerate(spans)]


@pytest.mark.parametrize("key", ["overlap_dedupe", "adjacent_merge"])
def test_intervals_move_once_to_find_their_runs(spark, key):
    plan = entry.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


@pytest.mark.parametrize("key", ["module_gap_chunks", "chunk_table"])
def test_parsed_files_are_not_gathered(spark, key):
    """Paths of parsed files and their drafts looked small, so they went through the driver to every task."""
    assert "BroadcastExchange" not in entry.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
