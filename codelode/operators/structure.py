"""Text to symbols, relationships and chunks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelode.functions import layout
from codelode.functions import paths as P
from codelode.functions import scale
from codelode.functions import text as X

# Chunk size limits in characters.
LARGE_CHARS = 4000
LARGE_STEP = 3800
SECTION_CHARS = 1500
TINY_CHARS = 300
MODULE = "<module>"
CODE_SUFFIXES = [".py", ".js", ".jsx", ".ts", ".tsx"]
CONFIG_SUFFIXES = [".json", ".yaml", ".yml", ".toml"]
DOCUMENT_SUFFIXES = [".md", ".txt"]

# ---------------------------------------------------------------- extraction

def extract_files(files: DataFrame) -> DataFrame:
    """One row per code file with parse result, symbols, imports and exports, made inside the row."""
    return layout.parse(files.where(P.suffix(F.col("path")).isin(CODE_SUFFIXES) & F.col("content").isNotNull()))


def symbol_kind(language: Column, s: Column) -> Column:
    """HOOK, COMPONENT, METHOD, FUNCTION, CLASS, INTERFACE or TYPE of a declared symbol."""
    script = language != "python"
    function = s["declared"].isin("function", "arrow")
    return (
        F.when(script & function & s["name"].rlike("^use[A-Z]"), "HOOK")
        .when(script & function & s["name"].rlike("^[A-Z]") & s["has_jsx"], "COMPONENT")
        .when(s["declared"] == "arrow", "FUNCTION")
        .otherwise(F.upper(s["declared"]))
    )


def symbols_of(parsed: DataFrame) -> DataFrame:
    """Flat symbol table of parsable files."""
    rows = parsed.where("parse_ok").select(
        "repository_id", "path", P.language(F.col("path")).alias("language"), F.explode("symbols").alias("s")
    )
    return rows.select(
        "repository_id", "path", "language", "s.*", symbol_kind(F.col("language"), F.col("s")).alias("symbol_type")
    )


def module_symbols(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """One <module> symbol per parsable file with imports, spanning the file."""
    with_imports = parsed.where(F.col("parse_ok") & (F.size("imports") > 0)).select("repository_id", "path")
    return with_imports.join(
        scale.unsent(files.select("repository_id", "path", X.line_count(F.col("content")).alias("end_line"))), ["repository_id", "path"]
    ).select(
        "repository_id", "path", F.lit(MODULE).alias("name"), F.lit("MODULE").alias("symbol_type"),
        F.lit(1).alias("start_line"), "end_line", F.lit(None).cast("string").alias("parent"),
    )


def symbol_table(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """Declared and module symbols with a natural, deterministic id."""
    declared = symbols_of(parsed).select(
        "repository_id", "path", "name", "symbol_type", "start_line", "end_line", "parent"
    )
    both = declared.unionByName(module_symbols(parsed, files))
    return both.withColumn(
        "symbol_id", F.concat_ws(":", "repository_id", "path", F.col("start_line").cast("string"), "name")
    )


def extract_edges(parsed: DataFrame) -> DataFrame:
    """(repository_id, path, from_name, to_name, kind, confidence), distinct.

    A file is one row, so same-file lookups are array expressions and nothing is shuffled but the
    final distinct.
    """
    rows = parsed.where("parse_ok").select(
        "repository_id", "path", P.language(F.col("path")).alias("language"), "symbols", "imports",
        F.explode_outer("symbols").alias("s"),
    )
    known = F.transform("symbols", lambda s: s["name"])
    same = lambda name: F.filter("symbols", lambda s: s["name"] == name)

    def call_edge(target: Column) -> Column:
        found = same(target)
        parent = found[0]["parent"]
        high = (
            F.array_contains("s.direct_calls", target) & (F.size(found) == 1)
            & (parent.isNull() | parent.eqNullSafe(F.col("s.parent")))
        )
        return F.struct(target.alias("to_name"), F.lit("CALLS").alias("kind"), high.alias("high"))

    def base_edge(target: Column) -> Column:
        found = same(target)
        high = (F.size(found) == 1) & found[0]["declared"].isin("class", "interface")
        return F.struct(target.alias("to_name"), F.lit("EXTENDS").alias("kind"), high.alias("high"))

    def plain(kind: str) -> Callable[[Column], Column]:
        return lambda target: F.struct(target.alias("to_name"), F.lit(kind).alias("kind"), F.lit(False).alias("high"))

    used = F.filter(
        F.array_except("s.refs", "s.calls"),
        lambda name: F.array_contains(known, name) & (name != F.col("s.name")),
    )
    api = F.when(
        F.size(linked_routes(F.col("symbols"), F.col("s"))) > 0,
        F.array(F.struct(F.lit(None).cast("string").alias("to_name"), F.lit("API_CALL").alias("kind"), F.lit(False).alias("high"))),
    ).otherwise(F.array())
    per_symbol = rows.where(F.col("s").isNotNull()).select(
        "repository_id", "path", F.col("s.name").alias("from_name"),
        F.explode(
            F.concat(
                F.transform("s.calls", call_edge), F.transform(used, plain("REFERENCES")),
                F.transform("s.bases", base_edge), api,
            )
        ).alias("e"),
    )
    imported = parsed.where("parse_ok").select(
        "repository_id", "path", F.lit(MODULE).alias("from_name"),
        F.explode(F.transform(F.flatten(F.transform("imports", lambda i: i["names"])), plain("IMPORTS"))).alias("e"),
    )
    return per_symbol.unionByName(imported).select(
        "repository_id", "path", "from_name", "e.to_name", "e.kind",
        F.when(F.col("e.high"), "high").otherwise("low").alias("confidence"),
    ).distinct()


def linked_routes(symbols: Column, s: Column) -> Column:
    """Client calls of a symbol that go through fetch or a same-file wrapper around fetch."""
    wrappers = F.transform(F.filter(symbols, lambda x: F.array_contains(x["calls"], "fetch")), lambda x: x["name"])
    return F.filter(s["route_calls"], lambda c: (c["callee"] == "fetch") | F.array_contains(wrappers, c["callee"]))


def edge_sources(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Attach from_id: the last symbol of that name in the file."""
    return edges.join(
        scale.unsent(_file_names(symbols).withColumnsRenamed({"name": "from_name", "id": "from_id"})),
        ["repository_id", "path", "from_name"],
    )


def _file_names(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("repository_id", "path", "name").agg(
        F.max_by("symbol_id", F.struct("start_line", "symbol_id")).alias("id")
    )


def import_targets(parsed: DataFrame) -> DataFrame:
    """(repository_id, path, to_name, expected): module file paths an imported name may come from."""
    rows = parsed.where("parse_ok").select(
        "repository_id", "path", F.explode("imports").alias("i")
    ).select("repository_id", "path", F.explode("i.names").alias("to_name"), F.col("i.module").alias("module"))
    folder = F.regexp_replace("path", "[^/]*$", "")
    joined = F.concat(folder, F.col("module"))
    tidy = F.regexp_replace(F.regexp_replace(joined, r"(^|/)(\./)+", "$1"), r"[^/]+/\.\./", "")
    relative = F.array(*[F.concat(tidy, F.lit(x)) for x in (".js", ".jsx", ".ts", ".tsx")])
    absolute = F.array(F.concat(F.replace(F.col("module"), F.lit("."), F.lit("/")), F.lit(".py")))
    return rows.select(
        "repository_id", "path", "to_name",
        F.explode(F.when(F.col("module").startswith("."), relative).otherwise(absolute)).alias("expected"),
    )


def resolve_edges(edges: DataFrame, symbols: DataFrame, parsed: DataFrame) -> DataFrame:
    """Adds from_id and to_id: same file, else the only symbol of that name, else the imported module's symbol.

    Names are reduced to one row per name before they meet the edges, and module paths meet file
    path tails by equality, so a common name never pairs all its users with all its definitions.
    """
    known = symbols.where(F.col("name") != MODULE)
    sourced = edge_sources(edges, symbols)
    local = _file_names(symbols).withColumnsRenamed({"name": "to_name", "id": "local_id"})
    names = known.groupBy("repository_id", F.col("name").alias("to_name")).agg(
        F.count(F.lit(1)).alias("n"), F.min("symbol_id").alias("only_id")
    )
    pieces = F.split("path", "/")
    tails = F.transform(
        F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, i, F.size(pieces)), "/")
    )
    by_tail = known.select(
        "repository_id", F.col("name").alias("to_name"), "symbol_id", F.explode(tails).alias("expected")
    )
    imported = (
        import_targets(parsed)
        .join(scale.unsent(by_tail), ["repository_id", "to_name", "expected"])
        .groupBy("repository_id", "path", "to_name")
        .agg(F.count_distinct("symbol_id").alias("m"), F.min("symbol_id").alias("import_id"))
    )
    return (
        sourced.join(scale.unsent(local), ["repository_id", "path", "to_name"], "left")
        .join(scale.unsent(imported), ["repository_id", "path", "to_name"], "left")
        .join(scale.unsent(names), ["repository_id", "to_name"], "left")
        .select(
            "repository_id", "path", "from_name", "to_name", "kind", "confidence", "from_id",
            F.coalesce(
                "local_id", F.when(F.col("n") == 1, F.col("only_id")),
                F.when((F.col("n") > 1) & (F.col("m") == 1), F.col("import_id")),
            ).alias("to_id"),
        )
    )


def server_routes(parsed: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repository_id, method, route, symbol_id) of routes that exactly one handler serves."""
    python = symbols_of(parsed).where((F.col("language") == "python") & (F.size("api_routes") > 0))
    prefix = F.rtrim(
        F.regexp_extract("content", r"APIRouter\s*\(\s*prefix\s*=\s*['\"]([^'\"]+)['\"]", 1), F.lit("/")
    )
    call = r"(?i)\.(get|post|put|patch|delete)\s*\(\s*['\"]([^'\"]+)['\"]"
    rows = python.join(
        scale.unsent(files.select("repository_id", "path", prefix.alias("prefix"))), ["repository_id", "path"]
    ).select("repository_id", "path", "name", "prefix", F.explode("api_routes").alias("mark"))
    routed = rows.where(F.col("mark").rlike(call)).select(
        "repository_id", "path", "name", F.upper(F.regexp_extract("mark", call, 1)).alias("method"),
        F.concat(F.col("prefix"), F.lit("/"), F.ltrim(F.regexp_extract("mark", call, 2), F.lit("/"))).alias("route"),
    )
    return (
        routed.join(scale.unsent(_file_names(symbols)), ["repository_id", "path", "name"])
        .groupBy("repository_id", "method", "route")
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("to_id"))
        .where("n = 1")
        .drop("n")
    )


def resolve_api_routes(parsed: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Client calls linked to the unique server handler of the same method and path: (from_id, to_id)."""
    clients = parsed.where("parse_ok").select(
        "repository_id", "path", F.explode("symbols").alias("s"), "symbols"
    ).select(
        "repository_id", "path", F.col("s.name").alias("name"),
        F.explode(linked_routes(F.col("symbols"), F.col("s"))).alias("c"),
    ).select("repository_id", "path", "name", F.col("c.method").alias("method"), F.col("c.path").alias("route"))
    return (
        clients.join(scale.unsent(server_routes(parsed, files, symbols)), ["repository_id", "method", "route"])
        .join(scale.unsent(_file_names(symbols).withColumnRenamed("id", "from_id")), ["repository_id", "path", "name"])
        .select("repository_id", "from_id", "to_id", "method", "route")
        .distinct()
    )


# ---------------------------------------------------------------- chunks

@F.arrow_udf(T.ArrayType(T.IntegerType()))
def line_offsets(content: pa.Array) -> pa.Array:
    """Characters before each line, and the total at the end; computed for all texts of a batch together."""
    column = content.fill_null("").cast(pa.large_string())
    places = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset:]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[places[0]:places[-1]] if data is not None else np.zeros(0, np.uint8)
    places = places - places[0]
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters before each byte
    breaks = np.flatnonzero(data == 10) + 1
    row = np.searchsorted(places, breaks, side="left") - 1
    total = chars[places[1:]] - chars[places[:-1]]
    rows = np.arange(len(column))
    open_end = np.ones(len(column), dtype=bool)
    filled = rows[np.diff(places) > 0]
    open_end[filled] = data[places[filled + 1] - 1] != 10
    owner = np.concatenate([rows, row, rows[open_end]])
    value = np.concatenate([np.zeros(len(rows), np.int64), chars[breaks] - chars[places[row]], total[open_end]])
    order = np.argsort(owner, kind="stable")  # zeros, then line ends in reading order, then open totals
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(column)))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(value[order], pa.int32()))


def lines_text(content: Column, offsets: Column, start: Column, end: Column) -> Column:
    begin = F.element_at(offsets, start)
    return F.substring(content, begin + 1, F.element_at(offsets, end + 1) - begin)


def with_lines(files: DataFrame) -> DataFrame:
    """Adds normalised content, line offsets and the number of lines."""
    plain = files.withColumn("content", F.regexp_replace("content", r"\r\n?", "\n"))
    return plain.withColumn("offsets", line_offsets(F.col("content"))).withColumn(
        "n_lines", F.greatest(F.size("offsets") - 1, F.lit(1))
    )


def _breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _chars(offsets: Column, start: Column, end: Column) -> Column:
    return F.element_at(offsets, end + 1) - F.element_at(offsets, start)


def chunk_symbols(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """One draft per top-level symbol with its leading comments; a large class gives a header and its methods.

    Everything happens on one row per file, so a text is never copied per symbol.
    """
    keys = ["repository_id", "path"]
    rows = parsed.where("parse_ok").select(*keys, "symbols").join(
        scale.unsent(with_lines(files.select(*keys, "content"))), keys
    ).withColumn("language", P.language(F.col("path")))

    def placed(s: Column) -> Column:
        return F.struct(
            s["name"].alias("name"), symbol_kind(F.col("language"), s).alias("kind"), s["parent"].alias("parent"),
            s["start_line"].alias("start"), s["lead_line"].alias("lead"), F.least(s["end_line"], F.col("n_lines")).alias("last"),
        )

    def is_large(s: Column) -> Column:
        members = F.exists("_symbols", lambda m: (m["kind"] == "METHOD") & (m["parent"] == s["name"]))
        return (s["kind"] == "CLASS") & (_chars(F.col("offsets"), s["lead"], s["last"]) > LARGE_CHARS) & members

    def draft(s: Column, last: Column, whole: bool) -> Column:
        return F.struct(
            s["kind"].alias("chunk_type"), s["name"].alias("symbol_name"), s["kind"].alias("symbol_type"),
            s["parent"].alias("parent_symbol"), s["lead"].alias("start_line"), last.alias("end_line"),
            lines_text(F.col("content"), F.col("offsets"), s["lead"], last).alias("content"),
            F.lit(whole).alias("splittable"),
        )

    def header_end(s: Column) -> Column:
        members = F.filter("_symbols", lambda m: (m["kind"] == "METHOD") & (m["parent"] == s["name"]))
        return F.least(F.array_min(F.transform(members, lambda m: m["start"])) - 1, s["last"])

    marked = rows.withColumn("_symbols", F.transform("symbols", placed)).withColumn(
        "_large", F.filter("_symbols", is_large)
    )
    large_names = F.transform("_large", lambda s: s["name"])
    drafts = F.concat(
        F.transform(
            F.filter("_symbols", lambda s: (s["kind"] != "METHOD") & ~((s["kind"] == "CLASS") & F.array_contains(large_names, s["name"]))),
            lambda s: draft(s, s["last"], True),
        ),
        F.transform(F.filter("_large", lambda s: header_end(s) >= s["lead"]), lambda s: draft(s, header_end(s), False)),
        F.transform(
            F.filter("_symbols", lambda s: (s["kind"] == "METHOD") & F.array_contains(large_names, s["parent"])),
            lambda s: draft(s, s["last"], True),
        ),
    )
    exploded = marked.select(*keys, "language", F.explode(drafts).alias("d")).select(*keys, "language", "d.*")
    return exploded.where(F.col("splittable") | F.col("content").rlike(r"\S"))


def split_large_chunks(drafts: DataFrame) -> DataFrame:
    """Windows of 4,000 characters every 3,800 with their line numbers; smaller drafts pass unchanged."""
    if "splittable" not in drafts.columns:
        drafts = drafts.withColumn("splittable", F.lit(True))
    content, size = F.col("content"), F.length("content")
    small = (size <= LARGE_CHARS) | ~F.col("splittable")
    starts = F.filter(
        F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(LARGE_STEP)),
        lambda at: (at == 0) | (at - LARGE_STEP + LARGE_CHARS < size),
    )

    def window(at: Column, index: Column) -> Column:
        until = F.substring(content, F.lit(1), F.least(at + LARGE_CHARS, size))
        end_line = F.col("start_line") + _breaks(until) - F.when(until.endswith("\n"), 1).otherwise(0)
        return F.struct(
            (F.col("start_line") + _breaks(F.substring(content, F.lit(1), at))).alias("start_line"),
            F.greatest(end_line, F.col("start_line")).alias("end_line"),
            F.substring(content, at + 1, F.lit(LARGE_CHARS)).alias("content"),
            index.alias("segment_index"), F.ceil(size / LARGE_STEP).cast("int").alias("segment_count"),
            F.coalesce("parent_symbol", "symbol_name").alias("parent_symbol"),
        )

    whole = F.struct(
        "start_line", "end_line", "content", F.lit(0).alias("segment_index"), F.lit(1).alias("segment_count"), "parent_symbol"
    )
    pieces = F.when(small, F.array(whole)).otherwise(F.transform(starts, window))
    changed = {"start_line", "end_line", "content", "parent_symbol", "splittable"}
    kept = [c for c in drafts.columns if c not in changed]
    return drafts.select(*kept, F.explode(pieces).alias("p")).select(*kept, "p.*")


def merge_tiny_chunks(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Runs of small neighbouring chunks become one section while its text stays short.

    The greedy rule is a fold over one file's ordered chunks; a file is bounded by the size limit.
    """
    keys = ["repository_id", "path"]
    source = with_lines(files.select(*keys, "content")).withColumnRenamed("content", "source")
    item = F.struct(
        "start_line", "end_line", F.coalesce("symbol_name", F.lit("")).alias("symbol_name"),
        F.length("content").alias("chars"), "content", "chunk_type", "symbol_type", "parent_symbol",
    )
    grouped = chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_items")).join(scale.unsent(source), keys)
    begin = F.struct(
        F.lit(0).alias("g"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(False).alias("open"),
        F.expr("array()").cast("array<int>").alias("groups"),
    )

    def step(state: Column, x: Column) -> Column:
        tiny = x["chars"] <= TINY_CHARS
        near = x["start_line"] <= state["last"] + 2
        span = _chars(F.col("offsets"), F.greatest(state["first"], F.lit(1)), F.least(x["end_line"], F.col("n_lines")))
        joins = state["open"] & tiny & near & (span <= SECTION_CHARS)
        group = F.when(joins, state["g"]).otherwise(state["g"] + 1)
        return F.struct(
            group.alias("g"), F.when(joins, state["first"]).otherwise(x["start_line"]).alias("first"),
            x["end_line"].alias("last"), tiny.alias("open"), F.array_append(state["groups"], group).alias("groups"),
        )

    folded = grouped.withColumn("_groups", F.aggregate("_items", begin, step)["groups"])

    def section(group: Column) -> Column:
        at = F.array_position("_groups", group).cast("int")
        count = F.size(F.filter("_groups", lambda g: g == group))
        first, last = F.element_at("_items", at), F.element_at("_items", at + count - 1)
        single = count == 1
        text = lines_text(F.col("source"), F.col("offsets"), first["start_line"], F.least(last["end_line"], F.col("n_lines")))
        return F.struct(
            F.when(single, first["chunk_type"]).otherwise("MODULE_SECTION").alias("chunk_type"),
            F.when(single & (first["symbol_name"] != ""), first["symbol_name"]).alias("symbol_name"),
            F.when(single, first["symbol_type"]).alias("symbol_type"),
            F.when(single, first["parent_symbol"]).alias("parent_symbol"),
            first["start_line"].alias("start_line"), last["end_line"].alias("end_line"),
            F.when(single, first["content"]).otherwise(text).alias("content"),
            F.transform(F.slice("_items", at, count), lambda x: x["symbol_name"]).alias("merged_symbols"),
        )

    sections = F.transform(F.array_distinct("_groups"), section)
    return folded.select(*keys, F.explode(sections).alias("s")).select(*keys, "s.*")


def _gap_rows(drafts: DataFrame, files: DataFrame) -> DataFrame:
    """One row per file with its text, offsets and the runs of lines that no draft covers."""
    keys = ["repository_id", "path"]
    spans = drafts.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("start_line", "end_line"))).alias("_spans"))
    rows = with_lines(files.select(*keys, "content")).join(scale.unsent(spans), keys, "left")
    begin = F.struct(
        F.lit(0).alias("reach"), F.expr("array()").cast("array<struct<start_line:int,end_line:int>>").alias("gaps")
    )
    after = F.struct((F.col("n_lines") + 1).alias("start_line"), (F.col("n_lines") + 1).alias("end_line"))
    ordered = F.concat(F.coalesce("_spans", F.expr("array()").cast("array<struct<start_line:int,end_line:int>>")), F.array(after))

    def step(state: Column, x: Column) -> Column:
        gap = F.struct((state["reach"] + 1).alias("start_line"), (x["start_line"] - 1).alias("end_line"))
        return F.struct(
            F.greatest(state["reach"], x["end_line"]).alias("reach"),
            F.when(x["start_line"] > state["reach"] + 1, F.array_append(state["gaps"], gap)).otherwise(state["gaps"]).alias("gaps"),
        )

    gaps = F.filter(
        F.aggregate(ordered, begin, step)["gaps"],
        lambda g: lines_text(F.col("content"), F.col("offsets"), g["start_line"], g["end_line"]).rlike(r"\S"),
    )
    return rows.select(*keys, "content", "offsets", gaps.alias("_gaps"))


def module_gap_chunks(drafts: DataFrame, files: DataFrame) -> DataFrame:
    """Uncovered lines packed to sections of at most 1,500 characters; an over-long line is cut."""
    keys = ["repository_id", "path"]
    offsets = F.col("offsets")
    begin = F.struct(
        F.lit(0).alias("start"), F.lit(True).alias("cut"), F.expr("array()").cast("array<int>").alias("starts")
    )

    def step(state: Column, line: Column) -> Column:
        long = _chars(offsets, line, line) > SECTION_CHARS
        full = _chars(offsets, F.greatest(state["start"], F.lit(1)), line) > SECTION_CHARS
        opens = state["cut"] | long | full
        return F.struct(
            F.when(opens, line).otherwise(state["start"]).alias("start"), long.alias("cut"),
            F.when(opens, F.array_append(state["starts"], line)).otherwise(state["starts"]).alias("starts"),
        )

    def sections(gap: Column) -> Column:
        starts = F.aggregate(F.sequence(gap["start_line"], gap["end_line"]), begin, step)["starts"]
        ends = F.array_append(F.slice(F.transform(starts, lambda x: x - 1), F.lit(2), F.size(starts)), gap["end_line"])
        return F.arrays_zip(starts.alias("start_line"), ends.alias("end_line"))

    def cuts(part: Column) -> Column:
        text = lines_text(F.col("content"), offsets, part["start_line"], part["end_line"])
        at = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(SECTION_CHARS))
        return F.transform(at, lambda i: F.struct(
            part["start_line"].alias("start_line"), part["end_line"].alias("end_line"),
            F.substring(text, i, F.lit(SECTION_CHARS)).alias("content"),
        ))

    parts = F.flatten(F.transform("_gaps", sections))
    rows = _gap_rows(drafts, files).withColumn("_parts", parts)
    return rows.select(*keys, F.explode(F.flatten(F.transform("_parts", cuts))).alias("c")).select(*keys, "c.*")


def document_blocks(files: DataFrame) -> DataFrame:
    """Blocks between headings and blank lines: (keys, block, start_line, end_line, content, heading); blank blocks dropped."""
    keys = ["repository_id", "path"]
    text = F.regexp_replace("content", r"\r\n?", "\n")
    pieces = F.split(text, "\n", -1)
    kept = F.transform(
        pieces, lambda line, i: F.when(i < F.size(pieces) - 1, F.concat(line, F.lit("\n"))).otherwise(line)
    )
    rows = files.select(*keys, F.posexplode(F.filter(kept, lambda line: line != "")).alias("pos", "line"))
    order = Window.partitionBy(*keys).orderBy("pos")
    opens = F.col("line").rlike(r"^#{1,6}\s+") | ~F.lag("line", 1, "").over(order).rlike(r"\S")
    marked = rows.withColumn("_open", opens.cast("int")).withColumn("block", F.sum("_open").over(order))
    blocks = marked.groupBy(*keys, "block").agg(
        (F.min("pos") + 1).alias("start_line"), (F.max("pos") + 1).alias("end_line"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "").alias("content"),
    )
    return blocks.where(F.col("content").rlike(r"\S")).withColumn("heading", F.col("content").rlike(r"^\s*#"))


def chunk_documents(files: DataFrame) -> DataFrame:
    """Blocks packed to at most 1,500 characters; a heading starts a new chunk, an oversize block is cut."""
    keys = ["repository_id", "path"]
    item = F.struct("start_line", "end_line", "heading", F.length("content").alias("chars"), "content")
    grouped = document_blocks(files).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    begin = F.struct(
        F.lit(0).alias("g"), F.lit(0).alias("chars"), F.lit(True).alias("cut"),
        F.expr("array()").cast("array<int>").alias("groups"),
    )

    def step(state: Column, x: Column) -> Column:
        big = x["chars"] > SECTION_CHARS
        opens = state["cut"] | x["heading"] | big | (state["chars"] + x["chars"] > SECTION_CHARS)
        group = F.when(opens, state["g"] + 1).otherwise(state["g"])
        return F.struct(
            group.alias("g"), F.when(opens, x["chars"]).otherwise(state["chars"] + x["chars"]).alias("chars"),
            big.alias("cut"), F.array_append(state["groups"], group).alias("groups"),
        )

    groups = F.aggregate("_items", begin, step)["groups"]
    rows = grouped.select(*keys, F.explode(F.arrays_zip(groups.alias("g"), F.col("_items").alias("x"))).alias("z"))
    packed = rows.select(*keys, "z.g", "z.x.*").groupBy(*keys, "g").agg(
        F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("start_line", "content"))), lambda x: x["content"]), ""
        ).alias("content"),
    )
    big = F.length("content") > SECTION_CHARS

    def cut(at: Column) -> Column:
        piece = F.substring(F.col("content"), at + 1, F.lit(SECTION_CHARS))
        first = F.col("start_line") + _breaks(F.substring(F.col("content"), F.lit(1), at))
        last = first + _breaks(piece) - F.when(piece.endswith("\n") & (_breaks(piece) > 0), 1).otherwise(0)
        return F.struct(
            F.when(big, first).otherwise(F.col("start_line")).alias("start_line"),
            F.when(big, last).otherwise(F.col("end_line")).alias("end_line"), piece.alias("content"),
            F.floor(at / SECTION_CHARS).cast("int").alias("piece"),
        )

    cuts = F.transform(F.sequence(F.lit(0), F.length("content") - 1, F.lit(SECTION_CHARS)), cut)
    return packed.select(*keys, F.explode(cuts).alias("c")).select(*keys, "c.*")


def whole_file_chunks(files: DataFrame, chunk_type: str) -> DataFrame:
    return files.select(
        "repository_id", "path", F.lit(chunk_type).alias("chunk_type"), F.lit(1).alias("start_line"),
        X.line_count(F.col("content")).alias("end_line"), "content",
    )


def chunk_config(files: DataFrame) -> DataFrame:
    """One section per config file."""
    return whole_file_chunks(files.where(P.suffix(F.col("path")).isin(CONFIG_SUFFIXES)), "MODULE_SECTION")


def chunk_fallback(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """One full-file chunk for every file that did not parse."""
    failed = parsed.where(~F.col("parse_ok")).select("repository_id", "path")
    return whole_file_chunks(files.join(scale.unsent(failed), ["repository_id", "path"], "left_semi"), "FALLBACK")


def chunk_table(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """Route every file to its chunker and add language, line count and content hash."""
    keys = ["repository_id", "path"]
    ok = files.join(scale.unsent(parsed.where("parse_ok").select(*keys)), keys, "left_semi")
    drafts = split_large_chunks(chunk_symbols(parsed, ok))
    named = merge_tiny_chunks(drafts, ok).drop("merged_symbols")
    columns = [*keys, "chunk_type", "symbol_name", "symbol_type", "parent_symbol", "start_line", "end_line", "content", "source_type"]

    def padded(frame: DataFrame, kind: str | None, source_type: str) -> DataFrame:
        if kind is not None:
            frame = frame.withColumn("chunk_type", F.lit(kind))
        for name in ("symbol_name", "symbol_type", "parent_symbol"):
            if name not in frame.columns:
                frame = frame.withColumn(name, F.lit(None).cast("string"))
        return frame.withColumn("source_type", F.lit(source_type)).select(*columns)

    documents = files.where(P.suffix(F.col("path")).isin(DOCUMENT_SUFFIXES))
    every = (
        padded(named, None, "CODE")
        .unionByName(padded(module_gap_chunks(drafts, ok), "MODULE_SECTION", "CODE"))
        .unionByName(padded(chunk_documents(documents), "DOCUMENTATION", "DOCUMENTATION"))
        .unionByName(padded(chunk_config(files), None, "CODE"))
        .unionByName(padded(chunk_fallback(files, parsed), None, "CODE"))
    )
    counts = files.select(*keys, X.line_count(F.col("content")).alias("file_line_count"))
    return every.join(scale.unsent(counts), keys).withColumn("language", P.language(F.col("path"))).withColumn(
        "content_hash", F.sha2("content", 256)
    ).withColumn(
        "chunk_id",
        F.sha2(F.concat_ws(":", *keys, F.col("start_line").cast("string"), F.col("end_line").cast("string"), "content_hash"), 256),
    )
