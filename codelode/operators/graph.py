"""Graph lookups, bounded forward flow and change impact over symbols and relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions import scale
from codelode.functions import text as X
from codelode.operators import rank as K
from codelode.operators import retrieve as R
from codelode.session import stored

# Bounds and priorities.
FAN_OUT = 2
EXPANSIONS = 5
MAX_ITEMS = 16
NEARBY_LINES = 5
FLOW_KINDS = ["CALLS", "API_CALL"]
TYPE_LIKE = ["CLASS", "INTERFACE", "TYPE"]
KIND_PRIORITY = {"CALLS": 3, "API_CALL": 3, "REFERENCES": 2, "EXTENDS": 2, "IMPORTS": 1}
IGNORED_WORDS = [
    "a", "an", "and", "from", "happens", "how", "in", "is", "of", "the", "to", "trace", "what", "when", "with",
]
PHRASAL = ["in", "on", "up", "out"]
MODULE = "<module>"
SCOPE = scale.SCOPE


# ---------------------------------------------------------------- lookups

def find_symbol(matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct matched symbols per query with the score of their best owning chunk."""
    pairs = R.owner_pairs(matches, chunks)
    best = pairs.groupBy("query_id", *SCOPE, "chunk_id").agg(F.max("score").alias("_chunk_score"))
    ranked = pairs.drop("score").join(best, ["query_id", *SCOPE, "chunk_id"])
    picked = ranked.groupBy("query_id", *SCOPE, "symbol_id").agg(
        F.min_by(
            F.struct("name", "file_path", "symbol_start", "symbol_end", "match_type", F.col("_chunk_score").alias("score")),
            F.struct((-F.col("_chunk_score")).alias("a"), "file_path", "start_line", "chunk_id"),
        ).alias("r")
    )
    return picked.select("query_id", *SCOPE, "symbol_id", "r.*")


def named_targets(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """Symbols of a name: exact spelling when it exists, else any case."""
    joined = R.symbol_exact(symbols, queries)
    tier = joined.groupBy("query_id").agg(F.max("score").alias("_tier"))
    return joined.join(tier, "query_id").where(F.col("score") == F.col("_tier")).drop("_tier", "score", "match_type")


def find_references(symbols: DataFrame, edges: DataFrame, queries: DataFrame) -> DataFrame:
    """Incoming relationships of a name with the place of source and target."""
    targets = named_targets(symbols, queries).select(
        "query_id", *SCOPE, F.col("symbol_id").alias("to_id"), F.col("file_path").alias("target_file"),
        F.col("start_line").alias("target_start"), F.col("end_line").alias("target_end"),
    )
    sources = symbols.select(
        *SCOPE, F.col("symbol_id").alias("from_id"), F.col("file_path").alias("file"), F.col("name").alias("symbol"),
        F.col("start_line").alias("line"),
    )
    return edges.join(targets, [*SCOPE, "to_id"]).join(sources, [*SCOPE, "from_id"]).select(
        "query_id", "file", "symbol", "line", "kind", "confidence", F.col("from_id").alias("source_id"),
        F.col("to_id").alias("target_id"), "target_file", "target_start", "target_end",
    )


def related_chunks(
    matches: DataFrame, chunks: DataFrame, symbols: DataFrame, edges: DataFrame, source_files: DataFrame | None = None
) -> DataFrame:
    """Seeds by symbol (exact matches only, when there are any), optionally of one file, then structural neighbours."""
    owners = R.symbol_owner_chunks(matches, chunks)
    exact = F.exists("matched_symbols", lambda s: s["match_type"].startswith("exact_"))
    has = owners.groupBy("query_id").agg(F.bool_or(exact).alias("_has"))
    seeds = owners.join(scale.unsent(has), "query_id").where(exact | ~F.col("_has"))
    if source_files is not None:
        seeds = seeds.join(source_files, ["query_id", "file_path"], "left_semi")
    ranked = stored(seeds.select("query_id", *SCOPE, "chunk_id", F.col("raw_score").alias("score"), F.lit("symbol").alias("signal")).join(
        scale.unsent(chunks.select(*SCOPE, "chunk_id", "file_path", "start_line", "end_line")), [*SCOPE, "chunk_id"]
    ))
    added = K.structural_expand(ranked, ranked, chunks, symbols, edges)
    return ranked.select("query_id", *SCOPE, "chunk_id", "score", "signal").unionByName(
        added.select("query_id", *SCOPE, "chunk_id", "score", F.lit("structural").alias("signal"))
    )


def covering_chunks(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """(scope, symbol_id, chunk_id): the chunk that covers a symbol, its namesake first, then the earliest."""
    points = symbols.select(
        *SCOPE, "symbol_id", "file_path", "name", F.col("start_line").alias("symbol_start"), F.col("end_line").alias("symbol_end")
    )
    inside = scale.points_in_intervals(
        points, chunks.select(*SCOPE, "chunk_id", "file_path", "symbol_name", "start_line", "end_line"),
        [*SCOPE, "file_path"], "symbol_start", "start_line", "end_line",
    ).where(F.col("end_line") >= F.col("symbol_end"))
    other = ~F.coalesce(F.col("symbol_name") == F.col("name"), F.lit(False))
    return inside.groupBy(*SCOPE, "symbol_id").agg(
        F.min_by("chunk_id", F.struct(other.alias("other"), "start_line", "chunk_id")).alias("chunk_id")
    )


def forward_neighbors(symbols: DataFrame, edges: DataFrame, chunks: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """First distinct call targets of every symbol that have a covering chunk.

    Order: functions before types, other files first, then file, name, line, id. Relationships are
    made distinct first, so a hub's repeated calls collapse before ranking.
    """
    calls = edges.where(F.col("kind").isin(FLOW_KINDS) & F.col("to_id").isNotNull()).groupBy(*SCOPE, "from_id", "to_id").agg(
        F.min("kind").alias("kind"), F.min("confidence").alias("confidence")
    )
    target = symbols.select(
        *SCOPE, F.col("symbol_id").alias("to_id"), F.col("file_path").alias("target_file"), F.col("name").alias("target_name"),
        F.col("symbol_type").alias("target_type"), F.col("start_line").alias("target_start"),
    ).join(scale.unsent(covering_chunks(symbols, chunks).withColumnRenamed("symbol_id", "to_id")), [*SCOPE, "to_id"])
    source = symbols.select(*SCOPE, F.col("symbol_id").alias("from_id"), F.col("file_path").alias("source_file"))
    joined = calls.join(scale.unsent(target), [*SCOPE, "to_id"]).join(scale.unsent(source), [*SCOPE, "from_id"])
    return scale.top_k(
        joined, [*SCOPE, "from_id"],
        [
            F.col("target_type").isin(TYPE_LIKE), F.col("target_file") == F.col("source_file"), F.asc("target_file"),
            F.asc("target_name"), F.asc("target_start"), F.asc("to_id"),
        ],
        fan_out,
    )


def flow_edges(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct resolved call edges with the place of both ends."""
    calls = edges.where(F.col("kind").isin(FLOW_KINDS) & F.col("to_id").isNotNull()).groupBy(*SCOPE, "from_id", "to_id", "kind").agg(
        F.min("confidence").alias("confidence")
    )
    side = lambda key, prefix: symbols.select(
        *SCOPE, F.col("symbol_id").alias(key), F.col("name").alias(f"{prefix}_symbol"), F.col("file_path").alias(f"{prefix}_file"),
        F.col("start_line").alias(f"{prefix}_start"), F.col("end_line").alias(f"{prefix}_end"),
    )
    return calls.join(side("from_id", "source"), [*SCOPE, "from_id"]).join(side("to_id", "target"), [*SCOPE, "to_id"])


# ---------------------------------------------------------------- entry and flow

def identifier_terms(name: Column) -> Column:
    parts = X.matches(F.replace(name, F.lit("_"), F.lit(" ")), X.WORD_PART)
    return F.array_distinct(F.transform(F.filter(parts, lambda p: F.length(p) >= 2), lambda p: X.stem(F.lower(p))))


def question_terms(text: Column) -> Column:
    """Stemmed terms of a question plus neighbouring words joined when the second is short."""
    words = F.transform(X.matches(text, "[A-Za-z]+"), lambda w: X.stem(F.lower(w)))
    nexts = F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1)))
    joined = F.filter(
        F.zip_with(words, nexts, lambda a, b: F.when(F.length(b) <= 3, F.concat(a, b))), lambda x: x.isNotNull()
    )
    return F.array_distinct(F.concat(F.transform(X.query_terms(text), X.stem), joined))


def _guesses(text: Column) -> Column:
    """(name, position, joined) guesses: neighbouring content words with an underscore, phrasal words run together."""
    raw = X.matches(text, "[A-Za-z]+")
    words = F.transform(F.filter(raw, lambda w: ~F.lower(w).isin(IGNORED_WORDS)), lambda w: X.stem(F.lower(w)))
    nexts = lambda items: F.slice(items, F.lit(2), F.greatest(F.size(items), F.lit(1)))
    pairs = F.transform(
        F.zip_with(words, nexts(words), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit("_"), b))),
        lambda name, i: F.struct(name.alias("name"), i.alias("position"), F.lit(False).alias("joined")),
    )
    phrasal = F.transform(
        F.zip_with(raw, nexts(raw), lambda a, b: F.when(F.lower(b).isin(PHRASAL), F.concat(X.stem(F.lower(a)), F.lower(b)))),
        lambda name, i: F.struct(name.alias("name"), (i + F.size(words)).alias("position"), F.lit(True).alias("joined")),
    )
    return F.filter(F.concat(pairs, phrasal), lambda g: g["name"].isNotNull())


def select_entry_symbol(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Best start symbol per question: front-end range rule, explicit mention, else term overlap with bonuses.

    Candidates hold query_id, name, file_path and is_route.
    """
    text = F.col("query_text")
    span = F.regexp_extract(text, r"(?i)\bfrom\b(.+?)\bto\b", 1)
    asked = questions.select(
        "query_id", "query_text", question_terms(text).alias("_terms"),
        X.explicit_identifiers(text).alias("_explicit"),
        text.rlike(r"(?i)\bwhen\b|\bendpoint\b|\broute\b").alias("_prefers_route"),
        F.when(span.rlike(r"(?i)\b(frontend|react|form|browser|client)\b"), question_terms(span)).alias("_front"),
    )
    known = candidates.groupBy("query_id", "name").agg(
        F.min("file_path").alias("file_path"), F.bool_or("is_route").alias("is_route")
    )
    guessed = questions.select("query_id", F.explode(_guesses(text)).alias("g")).groupBy(
        "query_id", F.col("g.name").alias("name")
    ).agg(F.max("g.position").alias("_guess"), F.bool_or("g.joined").alias("_joined"))
    rows = known.join(guessed, ["query_id", "name"], "full_outer").join(asked, "query_id")
    overlap = F.size(F.array_intersect(identifier_terms(F.col("name")), "_terms"))
    # A joined guess counts for every spelling of its name.
    joined_names = guessed.where("_joined").select("query_id", F.col("name").alias("_lower"), F.lit(1).alias("_bonus"))
    scored = (
        rows.withColumn("_lower", F.lower("name"))
        .join(joined_names, ["query_id", "_lower"], "left")
        .withColumn("_base", overlap + F.coalesce("_bonus", F.lit(0)))
        .withColumn(
            "_total",
            F.col("_base") + F.when(F.col("_prefers_route") & F.coalesce("is_route", F.lit(False)), 2).otherwise(0),
        )
        .withColumn("_observed", F.col("file_path").isNotNull().cast("int"))
    )
    front_count = F.when(
        F.col("_front").isNotNull() & F.coalesce(F.col("file_path").startswith("frontend/"), F.lit(False)),
        F.size(F.array_intersect(identifier_terms(F.col("name")), "_front")),
    )
    explicit_at = F.array_position(F.transform("_explicit", F.lower), F.lower("name"))
    is_known = F.col("is_route").isNotNull()
    best = scored.groupBy("query_id").agg(
        F.min(F.when(front_count > 0, F.struct((-front_count).alias("a"), "name"))).alias("_by_front"),
        F.min(F.when(is_known & (explicit_at > 0), F.struct(explicit_at.alias("a"), "name"))).alias("_by_name"),
        F.min(
            F.when(
                F.col("_total") > 0,
                F.struct(
                    (-F.col("_total")).alias("a"), (-F.col("_base")).alias("b"), (-F.col("_observed")).alias("c"),
                    (-F.coalesce("_guess", F.lit(-1))).alias("d"), "name",
                ),
            )
        ).alias("_by_terms"),
    )
    return best.select(
        "query_id", F.coalesce("_by_front.name", "_by_name.name", "_by_terms.name").alias("entry")
    )


def flow_trace(
    entries: DataFrame, neighbors: DataFrame, expansions: int = EXPANSIONS, first_hops: DataFrame | None = None,
    open_calls: DataFrame | None = None,
) -> DataFrame:
    """Bounded forward walk: (query_id, path, edges, visited, open, cut, is_partial).

    One row per question holds the open list, ordered by priority; it is bounded by `expansions` and the neighbours'
    fan-out. Every round expands its head by one equi-join with the neighbour lists; found nodes go ahead of the others
    and no node is expanded twice. Rounds are few and fixed, so lineage stays short.

    first_hops (symbol_id, target_id or null, tried): the walk goes from the entry to that target, and on from there;
    each call that was tried for it takes one expansion. open_calls (node_id, call): a node without neighbours ends in
    a node `unresolved:<node>:<call>`, which is listed in `open`. `cut` lists the nodes that were found, but not
    expanded, because the bound ended the walk. Both need string ids.
    """
    child = F.struct(
        F.col("target_name").rlike("^[A-Z]").alias("upper"), F.col("target_name").alias("name"),
        F.col("target_file").alias("file"), F.col("to_id").alias("id"), "kind",
    )
    lists = neighbors.groupBy(F.col("from_id").alias("_head")).agg(F.array_sort(F.collect_list(child)).alias("_children"))
    id_type = entries.schema["symbol_id"].dataType.simpleString()
    call = F.lit(None).cast("string")
    if open_calls is not None:
        lists = lists.join(open_calls.select(F.col("node_id").alias("_head"), F.col("call").alias("_call")), "_head", "full_outer")
        call = F.col("_call")
    lists = scale.unsent(lists.select("_head", "_children", call.alias("_call")))
    edge = f"struct<source:{id_type},target:{id_type},kind:string>"
    nothing = F.expr(f"cast(array() as array<{id_type}>)")
    begun = entries.select("query_id", "symbol_id")
    if first_hops is None:
        begun = begun.withColumns({"target_id": F.lit(None).cast(id_type), "tried": F.lit(0)})
    else:
        begun = begun.join(scale.unsent(first_hops.select("symbol_id", "target_id", "tried")), "symbol_id", "left")
    hops = F.col("target_id").isNotNull()
    state = begun.select(
        "query_id", F.array(F.coalesce("target_id", "symbol_id")).alias("queue"),
        F.when(hops, F.array("symbol_id", "target_id")).otherwise(F.array("symbol_id")).alias("path"),
        F.when(hops, F.array("symbol_id")).otherwise(nothing).alias("visited"),
        F.when(hops, F.array(F.struct(F.col("symbol_id").alias("source"), F.col("target_id").alias("target"), F.lit("CALLS").alias("kind"))))
        .otherwise(F.expr(f"cast(array() as array<{edge}>)")).alias("edges"),
        nothing.alias("open"), F.coalesce("tried", F.lit(0)).alias("used"),
    )
    for number in range(expansions):
        joined = state.withColumn("_head", F.when(F.col("used") + number < expansions, F.try_element_at("queue", F.lit(1)))).join(lists, "_head", "left")
        children = F.coalesce("_children", F.expr(f"cast(array() as array<struct<upper:boolean,name:string,file:string,id:{id_type},kind:string>>)"))
        ids = F.transform(children, lambda c: c["id"])
        rest = F.slice("queue", F.lit(2), F.greatest(F.size("queue") - 1, F.lit(0)))
        active = F.col("_head").isNotNull()
        seen = F.array_append("visited", F.col("_head"))
        found = F.filter(ids, lambda i: ~F.array_contains(seen, i) & ~F.array_contains(rest, i))
        links = F.transform(
            children, lambda c: F.struct(F.col("_head").alias("source"), c["id"].alias("target"), c["kind"].alias("kind"))
        )
        ends, end = nothing, F.expr(f"cast(array() as array<{edge}>)")
        if open_calls is not None:
            name = F.concat_ws(":", F.lit("unresolved"), "_head", "_call")
            ended = (F.size(children) == 0) & F.col("_call").isNotNull()
            ends = F.when(ended, F.array(name)).otherwise(nothing)
            end = F.when(ended, F.array(F.struct(F.col("_head").alias("source"), name.alias("target"), F.lit("CALLS").alias("kind")))).otherwise(end)
        state = joined.select(
            "query_id", "used",
            F.when(active, F.concat(found, rest)).otherwise(F.col("queue")).alias("queue"),
            F.when(active, F.array_distinct(F.concat("path", ids, ends))).otherwise(F.col("path")).alias("path"),
            F.when(active, seen).otherwise(F.col("visited")).alias("visited"),
            F.when(active, F.concat("edges", links, end)).otherwise(F.col("edges")).alias("edges"),
            F.when(active, F.concat("open", ends)).otherwise(F.col("open")).alias("open"),
        )
    partial = F.size("queue") > 0
    cut = F.when(partial, F.array_except(F.array_except("path", "visited"), "open")).otherwise(nothing)
    return state.select("query_id", "path", "edges", "visited", "open", cut.alias("cut"), partial.alias("is_partial"))


def ordered_path(trace: DataFrame) -> DataFrame:
    """(query_id, position, node_id, is_unresolved): depth-first order over observed edges, rest in discovery order."""
    begin = F.struct(F.col("path").alias("stack"), F.slice("path", 1, 0).alias("ordered"))

    def step(state: Column, _: Column) -> Column:
        head = F.try_element_at(state["stack"], F.lit(1))
        rest = F.slice(state["stack"], F.lit(2), F.greatest(F.size(state["stack"]) - 1, F.lit(0)))
        fresh = head.isNotNull() & ~F.array_contains(state["ordered"], head)
        nexts = F.transform(F.filter("edges", lambda e: e["source"] == head), lambda e: e["target"])
        return F.struct(
            F.when(fresh, F.concat(nexts, rest)).otherwise(rest).alias("stack"),
            F.when(fresh, F.array_append(state["ordered"], head)).otherwise(state["ordered"]).alias("ordered"),
        )

    walked = F.aggregate(F.sequence(F.lit(1), F.size("path") + F.size("edges")), begin, step)["ordered"]
    return trace.select("query_id", "open", "cut", F.posexplode(walked).alias("position", "node_id")).select(
        "query_id", (F.col("position") + 1).alias("position"), "node_id",
        (F.array_contains("cut", F.col("node_id")) | F.array_contains("open", F.col("node_id"))).alias("is_unresolved"),
    )


def client_first_hop(entries: DataFrame, direct_calls: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """First direct call by name of a front-end entry that leads to exactly one front-end symbol."""
    front = symbols.where(F.col("file_path").startswith("frontend/"))
    target = front.select(*SCOPE, F.col("symbol_id").alias("to_id"), F.col("name").alias("called"))
    links = edges.where((F.col("kind") == "CALLS") & F.col("to_id").isNotNull()).select(
        *SCOPE, F.col("from_id").alias("symbol_id"), "to_id").distinct()
    keys = [*SCOPE, "symbol_id"]
    calls = (
        entries.select(*keys).join(scale.unsent(front.select(*keys, F.col("name").alias("_own"))), keys)
        .join(scale.unsent(direct_calls), keys)
        .where(F.col("called") != F.col("_own"))
        .select(*keys, "called")
        .distinct()
    )
    hops = calls.join(scale.unsent(links), keys).join(scale.unsent(target), [*SCOPE, "to_id", "called"])
    single = hops.groupBy(*keys, "called").agg(
        F.count_distinct("to_id").alias("_n"), F.min("to_id").alias("target_id")
    ).where("_n = 1")
    return single.groupBy(*keys).agg(F.min(F.struct("called", "target_id")).alias("h")).select(*keys, "h.*")


def first_hops(entries: DataFrame, direct_calls: DataFrame, symbols: DataFrame, edges: DataFrame, bound: int = EXPANSIONS) -> DataFrame:
    """(symbol_id, target_id or null, tried) of every front-end entry, as client_first_hop finds it.

    A symbol's direct calls are tried by name until one leads to a single front-end symbol; `tried` counts them, at most `bound`.
    """
    keys = [*SCOPE, "symbol_id"]
    named = symbols.where(F.col("file_path").startswith("frontend/")).select(*keys, F.col("name").alias("_own"))
    calls = entries.select(*keys).join(scale.unsent(named), keys).join(scale.unsent(direct_calls), keys).where(F.col("called") != F.col("_own"))
    chosen = client_first_hop(entries, direct_calls, symbols, edges).withColumnRenamed("called", "_chosen")
    tried = calls.join(scale.unsent(chosen), keys, "left").groupBy(*keys).agg(
        F.count_distinct(F.when(F.col("_chosen").isNull() | (F.col("called") <= F.col("_chosen")), F.col("called"))).alias("n"),
        F.first("target_id").alias("target_id"),
    )
    return tried.select(
        "symbol_id", F.when(F.col("n") <= bound, F.col("target_id")).alias("target_id"), F.least("n", F.lit(bound)).cast("int").alias("tried")
    )


def unresolved_calls(nodes: DataFrame, resolved: DataFrame) -> DataFrame:
    """One unresolved call per node without outgoing edges.

    Direct calls come first, then calls on imported modules; exceptions are skipped; an explicitly
    asked name wins. Nodes hold node_id, symbol, calls, direct_calls, source_text, file_text, explicit.
    """
    open_nodes = nodes.join(scale.unsent(resolved.select("node_id").distinct()), "node_id", "left_anti")
    imported = X.matches(F.col("file_text"), r"(?m)^\s*import\s+([A-Za-z_][A-Za-z0-9_]*)", 1)
    used = r"\b([A-Za-z_][A-Za-z0-9_]*)\.([A-Za-z_][A-Za-z0-9_]*)\s*\("
    receivers = F.zip_with(
        X.matches(F.col("source_text"), used, 1), X.matches(F.col("source_text"), used, 2),
        lambda r, m: F.when(F.array_contains("_imported", r), m),
    )
    prepared = open_nodes.withColumn("_imported", imported).withColumn("_on_modules", receivers)
    kept = F.filter("calls", lambda c: (c != F.col("symbol")) & ~(c.rlike("^[A-Z]") & c.rlike("(Error|Exception)$")))
    ranked = F.array_sort(F.filter(
        F.transform(kept, lambda c: F.struct(
            F.when(F.array_contains("direct_calls", c), 0).when(F.array_contains("_on_modules", c), 1).alias("rank"), c.alias("call")
        )),
        lambda r: r["rank"].isNotNull(),
    ))
    asked = F.filter("explicit", lambda e: F.exists(ranked, lambda r: r["call"] == e))
    return prepared.select(
        "node_id", F.coalesce(F.try_element_at(asked, F.lit(1)), F.try_element_at(ranked, F.lit(1))["call"]).alias("call")
    ).where(F.col("call").isNotNull())


def flow_steps(path: DataFrame, node_evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """Ordered steps with nearby evidence, the relationship to the next step only, and unresolved flags.

    path: query_id, position, node_id, file, symbol, start_line, end_line, is_unresolved;
    node_evidence: query_id, node_id, rank, evidence_id, file, evidence_start, evidence_end.
    """
    item = F.struct("rank", "evidence_id", F.col("evidence_start").alias("s"), F.col("evidence_end").alias("e"))
    support = node_evidence.groupBy("query_id", "node_id", "file").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    visible = path.join(support, ["query_id", "node_id", "file"])

    def near(start: Column, end: Column) -> Column:
        return F.filter(
            "_items", lambda i: (F.abs(i["s"] - start) <= NEARBY_LINES) & (F.abs(i["e"] - end) <= NEARBY_LINES)
        )

    anchored = F.size(near(F.col("start_line"), F.col("end_line"))) == 0
    placed = visible.withColumns({
        "_start": F.when(anchored, F.col("_items")[0]["s"]).otherwise(F.col("start_line")),
        "_end": F.when(anchored, F.col("_items")[0]["e"]).otherwise(F.col("end_line")),
    })
    order = Window.partitionBy("query_id").orderBy("position")
    numbered = placed.withColumns({
        "step": F.row_number().over(order), "_next": F.lead("node_id").over(order),
        "evidence_ids": F.transform(near(F.col("_start"), F.col("_end")), lambda i: i["evidence_id"]),
    })
    links = edges.groupBy("query_id", F.col("source").alias("node_id"), F.col("target").alias("_next")).agg(
        F.min("kind").alias("_kind")
    )
    unresolved = F.col("is_unresolved") | (F.col("_next").isNotNull() & F.col("_kind").isNull())
    return numbered.join(links, ["query_id", "node_id", "_next"], "left").select(
        "query_id", "step", "node_id", "file", "symbol", F.col("_start").alias("start_line"), F.col("_end").alias("end_line"),
        F.when(~unresolved, F.col("_kind")).alias("relationship_to_next"), unresolved.alias("unresolved"), "evidence_ids",
    )


def flow_evidence_order(evidence: DataFrame, node_evidence: DataFrame, items: int = MAX_ITEMS) -> DataFrame:
    """Evidence with the first same-file item of every path node ahead, in path order, then the rest."""
    first = node_evidence.groupBy("query_id", "position").agg(F.min_by("evidence_id", "rank").alias("evidence_id"))
    places = first.groupBy("query_id", "evidence_id").agg(F.min("position").alias("_at"))
    ranked = evidence.join(places, ["query_id", "evidence_id"], "left").withColumn("_late", F.col("_at").isNull())
    return scale.top_k(
        ranked, ["query_id"], [F.asc("_late"), F.asc("_at"), F.asc("rank"), F.asc("evidence_id")], items, "new_rank"
    ).select("query_id", "evidence_id", "new_rank")


def flow_audit(proposed: DataFrame, observed: DataFrame) -> DataFrame:
    """Proposed steps where the whole list equals the observed path and every step is cited, else the observed steps."""
    left = proposed.select("query_id", "step", F.col("file").alias("_pf"), F.col("symbol").alias("_ps"), "cited", F.lit(1).alias("_p"))
    right = observed.select("query_id", "step", "file", "symbol", "relationship_to_next", "unresolved", F.lit(1).alias("_o"))
    joined = left.join(right, ["query_id", "step"], "full_outer")
    same = (
        F.col("_p").isNotNull() & F.col("_o").isNotNull() & F.col("_pf").eqNullSafe(F.col("file"))
        & F.col("_ps").eqNullSafe(F.col("symbol")) & F.coalesce("cited", F.lit(False))
    )
    verdict = joined.groupBy("query_id").agg(F.every(same).alias("accepted"))
    return observed.join(verdict, "query_id").select(
        "query_id", "step", "file", "symbol", "relationship_to_next", "unresolved", "accepted"
    )


# ---------------------------------------------------------------- change impact

def _supports(name: Column) -> Column:
    """Evidence of the same file names the symbol, holds its text or contains the symbol."""
    return (
        F.coalesce(F.col("evidence_symbol") == name, F.lit(False)) | F.contains("content", name)
        | F.array_contains("contained_names", name)
    )


def impact_direct(definitions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Definitions of the changed symbol (query_id, file, symbol) with supporting evidence ids."""
    joined = definitions.join(evidence, ["query_id", "file"]).where(_supports(F.col("symbol")))
    return joined.groupBy("query_id", "file", "symbol").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))


def kind_priority(kind: Column) -> Column:
    value = F.lit(0)
    for name, level in KIND_PRIORITY.items():
        value = F.when(kind == name, level).otherwise(value)
    return value


def impact_references(references: DataFrame, direct: DataFrame) -> DataFrame:
    """Best reference per file and symbol; the module row goes when the file has a named consumer."""
    keys = ["query_id", "file", "symbol"]
    best = references.groupBy(*keys).agg(
        F.min_by("kind", F.struct((-kind_priority(F.col("kind"))).alias("p"), "kind")).alias("kind")
    ).join(direct.select(*keys), keys, "left_anti")
    named = best.where(F.col("symbol") != MODULE).select("query_id", "file").distinct().withColumn("_named", F.lit(True))
    return best.join(named, ["query_id", "file"], "left").where(
        (F.col("symbol") != MODULE) | F.col("_named").isNull()
    ).drop("_named")


def impact_mentions(evidence: DataFrame, targets: DataFrame, taken: DataFrame) -> DataFrame:
    """Code evidence in test, schema, types or front-end paths that mentions the target and is not listed yet."""
    path = F.lower("file")
    area = (
        F.contains(path, F.lit("test")) | F.contains(path, F.lit("schema")) | F.contains(path, F.lit("types"))
        | path.startswith("frontend/") | path.rlike(r"\.(ts|tsx|js|jsx)$")
    )
    joined = evidence.where(F.col("evidence_symbol").isNotNull() & area).join(targets, "query_id")
    hits = joined.where((F.col("evidence_symbol") != F.col("target")) & F.contains("content", F.col("target")))
    rows = hits.groupBy("query_id", "file", F.col("evidence_symbol").alias("symbol")).agg(F.min("evidence_id").alias("evidence_id"))
    return rows.join(taken.select("query_id", "file", "symbol"), ["query_id", "file", "symbol"], "left_anti")


def impact_fields(evidence: DataFrame, fields: DataFrame) -> DataFrame:
    """Class fields and functions that use a named field: (query_id, file, symbol, bucket, evidence_id).

    Excerpts are short, so each is folded line by line inside its row. A declaration inside a class
    and a function whose signature holds the field are direct; other users are indirect and go when
    the file has a direct field of that class. Fields: query_id, fields (array).
    """
    rows = evidence.join(fields, "query_id").withColumn("_lines", F.split("content", "\n", -1))
    holds = lambda text: F.exists("fields", lambda f: F.contains(text, f))
    loosely = lambda text: F.exists(
        "fields", lambda f: F.contains(text, f) | F.contains(F.lower(text), F.lower(F.regexp_replace(f, "_id$", "")))
    )
    begin = F.struct(
        F.lit("").alias("cls"), F.lit("").alias("fn"), F.expr("cast(array() as array<string>)").alias("declared"),
        F.lit(None).cast("string").alias("owner"), F.lit(0).alias("n"),
    )

    def step(state: Column, line: Column) -> Column:
        header = F.regexp_extract(line, r"^class\s+([A-Za-z_]\w*)\b[^\n]*:\s*$", 1)
        function = F.regexp_extract(line, r"\b(?:function|def)\s+([A-Za-z_]\w*)\s*\(", 1)
        field = F.regexp_extract(line, r"^\s{4}([A-Za-z_]\w*)\s*(?::|=)", 1)
        cls = F.when(header != "", header).otherwise(state["cls"])
        fn = F.when(function != "", function).otherwise(state["fn"])
        declares = (state["cls"] != "") & (header == "") & (field != "") & ~field.startswith("__") & loosely(line)
        at = F.col("start_line") + state["n"]
        around = F.try_element_at(
            F.filter("contained", lambda c: (c["start_line"] <= at) & (at <= c["end_line"])), F.lit(1)
        )["name"]
        owner = F.when(holds(line), F.coalesce(around, F.when(fn != "", fn)))
        return F.struct(
            cls.alias("cls"), fn.alias("fn"),
            F.when(declares, F.array_append(state["declared"], F.concat(cls, F.lit("."), field))).otherwise(state["declared"]).alias("declared"),
            F.coalesce(state["owner"], owner).alias("owner"), (state["n"] + 1).alias("n"),
        )

    folded = rows.withColumn("_fold", F.aggregate("_lines", begin, step))
    declared = folded.select("query_id", "file", F.explode("_fold.declared").alias("symbol"), F.lit("direct").alias("bucket"), "evidence_id")
    users = folded.where(holds(F.col("content"))).withColumn("symbol", F.coalesce("_fold.owner", "evidence_symbol")).where(
        F.col("symbol").isNotNull()
    )
    signatures = F.filter(
        X.matches(F.col("content"), r"\b(?:def|function)\s+[A-Za-z_]\w*\s*\([^)]*\)"),
        lambda s: F.regexp_extract(s, r"^(?:def|function)\s+([A-Za-z_]\w*)", 1) == F.col("symbol"),
    )
    direct_use = F.coalesce(F.exists(signatures, holds), F.lit(False))
    used = users.select("query_id", "file", "symbol", F.when(direct_use, "direct").otherwise("indirect").alias("bucket"), "evidence_id")
    keys = ["query_id", "file", "symbol"]
    # A direct row wins over an indirect one of the same symbol.
    best = declared.unionByName(used).groupBy(*keys).agg(
        F.min("bucket").alias("bucket"), F.min_by("evidence_id", F.struct("bucket", "evidence_id")).alias("evidence_id")
    )
    owners = best.where((F.col("bucket") == "direct") & F.contains("symbol", F.lit("."))).select(
        "query_id", "file", F.substring_index("symbol", ".", 1).alias("symbol"), F.lit("indirect").alias("bucket")
    ).distinct()
    return best.join(owners, [*keys, "bucket"], "left_anti")


def impact_evidence_backfill(candidates: DataFrame, kept: DataFrame) -> DataFrame:
    """Candidates whose evidence was not kept get the first kept excerpt of their file that mentions symbol or field."""
    cited = candidates.select("query_id", "file", "symbol", F.explode("evidence_ids").alias("evidence_id"))
    alive = cited.join(kept.select("query_id", "evidence_id"), ["query_id", "evidence_id"], "left_semi").select(
        "query_id", "file", "symbol"
    ).distinct()
    lost = candidates.join(alive, ["query_id", "file", "symbol"], "left_anti")
    mention = F.contains("content", F.col("symbol")) | F.contains("content", F.substring_index("symbol", ".", -1))
    found = lost.join(kept.select("query_id", "file", "evidence_id", "rank", "content"), ["query_id", "file"]).where(mention)
    return found.groupBy("query_id", "file", "symbol").agg(F.min_by("evidence_id", F.struct("rank", "evidence_id")).alias("evidence_id"))


def impact_merge(proposed: DataFrame, observed: DataFrame) -> DataFrame:
    """Proposed items that were observed, with their valid ids, plus observed items nobody proposed."""
    keys = ["query_id", "bucket", "file", "symbol"]
    left = proposed.groupBy(*keys).agg(F.first("evidence_ids").alias("_proposed"))
    valid = F.array_intersect(F.coalesce("_proposed", F.col("evidence_ids")), F.col("evidence_ids"))
    joined = observed.join(left, keys, "left").withColumn("_valid", valid)
    ids = F.when(F.size("_valid") > 0, F.col("_valid")).otherwise(F.col("evidence_ids"))
    return joined.select(
        *keys, ids.alias("evidence_ids"),
        F.when(F.col("bucket") == "direct", "high").otherwise("medium").alias("confidence"),
        F.when(F.contains(F.lower("file"), F.lit("test")), F.col("file")).alias("test_to_inspect"),
    )
