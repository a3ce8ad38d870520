"""Candidate generation: vector, lexical and symbol search over tables of queries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions import scale
from codelode.functions import text as X
from codelode.functions.stemmer import english_stem
from codelode.session import stored

SEMANTIC_LIMIT = 30
LEXICAL_LIMIT = 30
FUZZY_LIMIT = 10
FUZZY_THRESHOLD = 0.3
SCOPE = scale.SCOPE
#: Rows that meet in a task; the result doesn't depend on them.
SLICE_VECTORS = SLICE_CHUNKS = 4096
SLICE_BYTES = 16 << 20
BLOCK_QUESTIONS = 4096
#: Questions of one score matrix.
MATRIX_QUESTIONS = 256
#: Float noise of a cosine lies below; equal vectors must score equal in any block.
COSINE_DIGITS = 12
#: Likewise for a sum of cover shares, which depends on the order of addition.
COVER_DIGITS = 9


# ---------------------------------------------------------------- vectors

def _best_rows(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best rows by (score desc, id asc), exact at the tie boundary."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= cut)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def _cosine(chunk_matrix: np.ndarray, query_matrix: np.ndarray) -> np.ndarray:
    left = np.linalg.norm(query_matrix, axis=1)[:, None]
    right = np.linalg.norm(chunk_matrix, axis=1)[None, :]
    norms = left * right
    dots = query_matrix @ chunk_matrix.T
    return np.round(np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0), COSINE_DIGITS)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def active_vectors(vectors: DataFrame, version: str) -> DataFrame:
    """Only vectors of the active model version are searchable."""
    return vectors.where(F.col("embedding").isNotNull() & (F.col("model_version") == version))


def semantic_topk(vectors: DataFrame, queries: DataFrame, k: int = SEMANTIC_LIMIT) -> DataFrame:
    """Exact top k by cosine similarity inside the corpus version of each query; zero norms score 0; ties by chunk id.

    The vectors of a corpus version are cut into slices and its questions into blocks, both of bounded size by their
    number of rows. A task scores one block against one slice, a bounded matrix at a time, and hands on at most k rows
    per question; one ranked merge finishes the job. Rows without a vector take no part.
    """
    kinds = {name: frame.schema[name].dataType.simpleString() for frame, name in (
        (queries, "query_id"), (vectors, "chunk_id"), (vectors, SCOPE[0]), (vectors, SCOPE[1]))}
    schema = ", ".join(f"{name} {kinds[name]}" for name in ("query_id", *SCOPE, "chunk_id")) + ", raw_score double"
    vectors = vectors.where("embedding IS NOT NULL").select(*SCOPE, "chunk_id", "embedding")
    queries = queries.where("query_embedding IS NOT NULL").select(*SCOPE, "query_id", "query_embedding")

    left, right = scale.cut_to_meet(
        vectors, queries, SCOPE, ("chunk_id", "query_id"), F.count("*") / SLICE_VECTORS, F.count("*") / BLOCK_QUESTIONS
    )

    def meet(key: tuple, chunk_part: pd.DataFrame, query_part: pd.DataFrame) -> pd.DataFrame:
        if not len(chunk_part) or not len(query_part):
            return pd.DataFrame({"query_id": [], SCOPE[0]: [], SCOPE[1]: [], "chunk_id": [], "raw_score": []})
        ids = chunk_part["chunk_id"].to_numpy()
        known, asked = _matrix(chunk_part["embedding"]), _matrix(query_part["query_embedding"])
        picks, best = [], []
        for begin in range(0, len(asked), MATRIX_QUESTIONS):
            for row in _cosine(known, asked[begin : begin + MATRIX_QUESTIONS]):
                picks.append(_best_rows(ids, row, k))
                best.append(row[picks[-1]])
        return pd.DataFrame({
            "query_id": np.repeat(query_part["query_id"].to_numpy(), [len(p) for p in picks]),
            SCOPE[0]: key[0], SCOPE[1]: key[1],
            "chunk_id": np.concatenate([ids[p] for p in picks]),
            "raw_score": np.concatenate(best),
        })

    partial = left.cogroup(right).applyInPandas(meet, schema)
    return scale.top_k(partial, ["query_id"], [F.desc("raw_score"), F.asc("chunk_id")], k)


# ---------------------------------------------------------------- lexical

def _phrase_tokens(text: Column) -> Column:
    """Tokens that must appear whole wherever the text appears: all but the first and the last."""
    raw = X.tokens(text)
    return F.array_distinct(F.slice(raw, F.lit(2), F.greatest(F.size(raw) - 2, F.lit(0))))


def _asked_terms(queries: DataFrame) -> DataFrame:
    """Questions with their terms, the inner tokens that select texts for the phrase test, their longest token and their phrase."""
    return (
        queries.withColumn("query_text", F.trim("query_text"))
        .withColumn("_terms", X.query_terms(F.col("query_text")))
        .withColumn("_all_inner", _phrase_tokens(F.col("query_text")))
        .where(F.size("_terms") > 0)
        # Inner tokens that are terms already select few texts; common words are used only when there are no others.
        .withColumn("_common", F.array_intersect("_all_inner", "_terms"))
        .withColumn("_inner", F.when(F.size("_common") > 0, F.col("_common")).otherwise(F.col("_all_inner")))
        .select(
            *SCOPE, "query_id", "_terms", "_inner", F.lower("query_text").alias("_phrase"),
            F.expr(
                "array_max(transform(regexp_extract_all(lower(query_text), '[A-Za-z0-9_]+', 0), "
                "t -> struct(length(t) AS n, t AS token))).token"
            ).alias("_longest"),
        )
    )


def _posting_lists(tokens: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of the rows; the rows that hold a word (ascending) and how often; the first place of each word in both."""
    coded = tokens.flatten().dictionary_encode()
    words = len(coded.dictionary)
    owners = np.repeat(np.arange(len(tokens)), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
    pairs, counts = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(tokens) + owners, return_counts=True)
    return coded.dictionary, pairs % len(tokens), counts, np.searchsorted(pairs, np.arange(words + 1) * len(tokens))


def _lexical_rows(texts: pa.Table, asked: pa.Table, place: Sequence[str], k: int | None) -> pa.Table:
    """Rows of one slice of chunks that score for each question of one block.

    With k only the k best rows of a question are taken, and only strict ones where there are any.
    """
    texts = texts.take(pc.sort_indices(texts, sort_keys=[(name, "ascending") for name in place], null_placement="at_start")).combine_chunks()
    asked = asked.combine_chunks()
    n, content = len(texts), pc.fill_null(texts["_text"], "").combine_chunks()
    words, rows, counts, first = _posting_lists(texts["_tokens"].combine_chunks())
    codes = {
        name: pc.index_in(asked[name].combine_chunks().flatten(), value_set=words).fill_null(-1).to_numpy(zero_copy_only=False)
        for name in ("_terms", "_inner")
    }
    ends = {name: np.cumsum(pc.list_value_length(asked[name]).to_numpy()) for name in codes}

    def holding_all(inner: np.ndarray) -> np.ndarray:
        if (inner < 0).any():
            return rows[:0]
        lists = sorted((rows[first[c] : first[c + 1]] for c in inner), key=len)
        held = lists[0]
        for other in lists[1:]:
            held = np.intersect1d(held, other, assume_unique=True)
        return held

    def with_piece(token: str | None) -> np.ndarray:
        if token is None:
            return rows[:0]
        holders = np.flatnonzero(pc.match_substring(words, token).to_numpy(zero_copy_only=False))
        return np.unique(np.concatenate([rows[first[c] : first[c + 1]] for c in holders])) if len(holders) else rows[:0]

    figures: dict[str, list[np.ndarray]] = {name: [] for name in ("chunk", "question", "n_terms", "hits", "matched", "phrase")}
    for i, (phrase, longest) in enumerate(zip(asked["_phrase"].to_pylist(), asked["_longest"].to_pylist())):
        terms, inner = (codes[name][(ends[name][i - 1] if i else 0) : ends[name][i]] for name in ("_terms", "_inner"))
        hits, matched, phrased = (np.zeros(n, np.int64) for _ in range(3))
        for c in terms[terms >= 0]:
            at = slice(first[c], first[c + 1])
            hits[rows[at]] += counts[at]
            matched[rows[at]] += 1
        suspects = holding_all(inner) if len(inner) else with_piece(longest)
        if len(suspects):
            phrased[suspects] = pc.match_substring(content.take(pa.array(suspects)), phrase).to_numpy(zero_copy_only=False)
        live = np.flatnonzero(hits + phrased)
        if k is not None:
            strict = live[matched[live] == len(terms)]
            live = strict if len(strict) else live
            live = live[_best_rows(live, hits[live] + phrased[live] + matched[live] / len(terms), k)]
        for name, values in (
            ("chunk", live), ("question", np.full(len(live), i)), ("n_terms", np.full(len(live), len(terms))),
            ("hits", hits[live]), ("matched", matched[live]), ("phrase", phrased[live]),
        ):
            figures[name].append(values)
    merged = {name: pa.array(np.concatenate(values)) for name, values in figures.items()}
    found, whose = texts.select(place).take(merged.pop("chunk")), asked.select(["query_id", *SCOPE]).take(merged.pop("question"))
    return pa.table({**{name: whose[name] for name in whose.column_names}, **{name: found[name] for name in place}, **merged})


def lexical_scores(chunks: DataFrame, queries: DataFrame, place: Sequence[str] = ("chunk_id",), k: int | None = None) -> DataFrame:
    """(query_id, scope, place, n_terms, hits, matched, phrase) for every chunk of the query's corpus version with a positive score.

    The chunks of a corpus version are cut into slices, by rows and by bytes of text, and its questions into blocks. A task
    makes the posting lists of one slice and scores the questions of one block by them, so pairs of a question and a chunk
    are never shuffled; with k a task hands on no more than k rows per question, the first of equal ones in the order of
    `place`. Texts are compared only where a chunk holds every inner token of the question; a question of one or two tokens
    can sit inside longer words, so its longest token is looked up in the slice's words.
    """
    kinds = {name: frame.schema[name].dataType.simpleString() for frame, names in ((queries, ["query_id", *SCOPE]), (chunks, place)) for name in names}
    left, right = scale.cut_to_meet(
        chunks.select(
            *SCOPE, *place, F.lower("content").alias("_text"), F.octet_length("content").alias("_bytes"),
            F.coalesce(X.tokens(F.col("content")), F.expr("cast(array() as array<string>)")).alias("_tokens"),
        ),
        _asked_terms(queries), SCOPE, ("chunk_id", "query_id"),
        F.greatest(F.count("*") / SLICE_CHUNKS, F.coalesce(F.sum("_bytes"), F.lit(0)) / SLICE_BYTES),
        F.count("*") / BLOCK_QUESTIONS,
    )
    numbers = ("n_terms", "hits", "matched", "phrase")

    def meet(texts: pa.Table, asked: pa.Table) -> pa.Table:
        if len(texts) and len(asked):
            return _lexical_rows(texts, asked, place, k)
        fields = [asked.schema.field(name) for name in ("query_id", *SCOPE)] + [texts.schema.field(name) for name in place]
        return pa.schema([*fields, *((name, pa.int64()) for name in numbers)]).empty_table()

    schema = [*(f"{name} {kind}" for name, kind in kinds.items()), *(f"{name} long" for name in numbers)]
    return left.cogroup(right).applyInArrow(meet, ", ".join(schema))


def lexical_topk(chunks: DataFrame, queries: DataFrame, k: int = LEXICAL_LIMIT) -> DataFrame:
    """All-terms tier when it has any hit, else the any-term tier; top k by score, path, line, id.

    One ranking serves both tiers: strict rows sort first, so the top k of the mixed order holds
    exactly the rows of the winning tier.
    """
    place = ["file_path", "start_line", "chunk_id"]
    scored = lexical_scores(chunks, queries, place, k).select(
        "query_id", *SCOPE, *place, (F.col("matched") == F.col("n_terms")).alias("is_strict"),
        (F.col("hits") + F.col("phrase") + F.col("matched") / F.col("n_terms")).alias("raw_score"),
    )
    ranked = scale.top_k(scored, ["query_id"], [F.desc("is_strict"), F.desc("raw_score"), *map(F.asc, place)], k)
    tier = F.max("is_strict").over(Window.partitionBy("query_id"))
    return ranked.withColumn("_tier", tier).where(F.col("is_strict") == F.col("_tier")).drop("_tier")


def _stems(words: DataFrame) -> DataFrame:
    """(word, term) of the distinct words, so a word is stemmed once, however often it stands in the corpus.

    A term that can't be null keeps joins from testing the stem of every word of the texts before they are made distinct.
    """
    return words.select("word").distinct().withColumn("term", F.coalesce(english_stem(F.col("word")), F.lit("")))


def _cover_rows(texts: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """The k best rows of one slice of chunks for each question of one block; only strict ones where there are any.

    Each asked word's places are one sorted run of numbers (chunk, place), so a question merges the runs of its own words.
    """
    texts, asked = texts.combine_chunks(), asked.combine_chunks()
    ids = texts["chunk_id"].combine_chunks()
    chunks = ids.unique()
    chunks = chunks.take(pc.array_sort_indices(chunks, null_placement="at_start"))
    tokens = pc.split_pattern(pc.fill_null(texts["_tokens"].combine_chunks(), ""), " ")
    sizes = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = tokens.flatten().dictionary_encode()
    sought = asked["_words"].combine_chunks().flatten()
    words = sought.unique()
    word = pc.index_in(coded.dictionary, value_set=words).fill_null(-1).to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)]
    held = np.flatnonzero(word >= 0)
    width = int(sizes.max(initial=0)) + 1
    first_token = np.repeat(np.cumsum(sizes) - sizes, sizes)[held]
    chunk = np.repeat(pc.index_in(ids, value_set=chunks).to_numpy(zero_copy_only=False).astype(np.int64), sizes)[held]
    place, word = chunk * width + (held - first_token), word[held]
    order = np.lexsort((place, word))
    place, first = place[order], np.searchsorted(word[order], np.arange(len(words) + 1))
    codes = pc.index_in(sought, value_set=words).to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.list_value_length(asked["_words"].combine_chunks()).to_numpy(zero_copy_only=False))

    figures: dict[str, list[np.ndarray]] = {name: [] for name in ("chunk", "question", "raw_score", "is_strict")}
    for i, (families, n_terms) in enumerate(zip(asked["_families"].to_pylist(), asked["n_terms"].to_pylist())):
        own = codes[(ends[i - 1] if i else 0) : ends[i]]
        terms, count = np.repeat(np.arange(len(families)), families), max(len(families), 1)
        runs = [place[first[c] : first[c + 1]] * count + t for c, t in zip(own, terms)]
        hits = np.sort(np.concatenate(runs), kind="stable") if runs else place[:0]
        if not len(hits):
            continue
        at, term = np.divmod(hits, count)
        owner = at // width
        opens = np.concatenate(([True], owner[1:] != owner[:-1]))
        group, live = np.cumsum(opens) - 1, owner[opens]
        covers = np.where(~opens[1:] & (term[1:] != term[:-1]), 1.0 / (np.diff(at) + 1), 0.0)
        density = np.bincount(group[1:], weights=covers, minlength=len(live))
        matched = np.bincount(np.unique(group * count + term) // count, minlength=len(live))
        scores = np.where(matched == 1, np.bincount(group) * 0.1, np.floor(density * 10**COVER_DIGITS + 0.5) / 10**COVER_DIGITS)
        strict = matched == n_terms
        kept = np.flatnonzero(strict) if strict.any() else np.arange(len(live))
        best = kept[_best_rows(live[kept], scores[kept], k)]
        for name, values in (("chunk", live[best]), ("question", np.full(len(best), i)), ("raw_score", scores[best]), ("is_strict", strict[best])):
            figures[name].append(values)
    kinds = {"chunk": np.int64, "question": np.int64, "raw_score": np.float64, "is_strict": np.bool_}
    merged = {name: pa.array(np.concatenate([np.zeros(0, kinds[name]), *values])) for name, values in figures.items()}
    whose = asked.select(["query_id", *SCOPE]).take(merged.pop("question"))
    return pa.table({**{name: whose[name] for name in whose.column_names}, "chunk_id": chunks.take(merged.pop("chunk")), **merged})


def fulltext_rank(chunks: DataFrame, queries: DataFrame, k: int = LEXICAL_LIMIT) -> DataFrame:
    """Stemmed full-text tiers ranked by cover density: the sum of 1 / length over covers.

    A cover is the span between two neighbouring hits of different terms; a lone term counts 1/10
    per hit. Stems are those of the English Porter algorithm. Questions' stems meet the stems of the
    corpus' vocabulary first, so a question goes on with the words that it asks for. Slices of chunks and blocks of
    questions then meet as in lexical_scores: a text moves once, and a task hands on no more than k rows per question, so
    pairs of a question and a chunk are never shuffled.
    """
    said = queries.select(*SCOPE, "query_id", F.explode(X.query_terms(F.col("query_text"))).alias("word"))
    asked = said.join(_stems(said), "word").select(*SCOPE, "query_id", "term").distinct()
    sizes = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms"))
    vocabulary = chunks.select(F.explode(F.array_distinct(X.tokens(F.col("content")))).alias("word")).distinct()
    families = _stems(vocabulary).join(asked.select("term").distinct(), "term").groupBy("term").agg(F.collect_list("word").alias("words"))
    questions = asked.join(scale.unsent(families), "term").groupBy("query_id", *SCOPE).agg(
        F.array_sort(F.collect_list(F.struct("term", "words"))).alias("_own")
    ).join(scale.unsent(sizes), "query_id").select(
        *SCOPE, "query_id", "n_terms", F.flatten(F.transform("_own", lambda t: t["words"])).alias("_words"),
        F.transform("_own", lambda t: F.size(t["words"])).alias("_families"),
    )
    # Rows of one chunk id are one chunk and stay together, so they count once.
    counted = chunks.groupBy(*SCOPE, "chunk_id").agg(F.sum(F.octet_length("content")).alias("_bytes"))
    left, right = scale.cut_to_meet(
        chunks.select(*SCOPE, "chunk_id", F.array_join(X.tokens(F.col("content")), " ").alias("_tokens")),
        stored(questions), SCOPE, ("chunk_id", "query_id"),
        F.greatest(F.count("chunk_id") / SLICE_CHUNKS, F.coalesce(F.sum("_bytes"), F.lit(0)) / SLICE_BYTES, F.lit(1)),
        F.count("*") / BLOCK_QUESTIONS, counted,
    )
    kinds = {name: frame.schema[name].dataType.simpleString() for frame, names in ((queries, ["query_id", *SCOPE]), (chunks, ["chunk_id"])) for name in names}

    def meet(texts: pa.Table, questions: pa.Table) -> pa.Table:
        if len(texts) and len(questions):
            return _cover_rows(texts, questions, k)
        fields = [*(questions.schema.field(name) for name in ("query_id", *SCOPE)), texts.schema.field("chunk_id")]
        return pa.schema([*fields, ("raw_score", pa.float64()), ("is_strict", pa.bool_())]).empty_table()

    schema = [*(f"{name} {kind}" for name, kind in kinds.items()), "raw_score double", "is_strict boolean"]
    scored = left.cogroup(right).applyInArrow(meet, ", ".join(schema))
    ranked = scale.top_k(
        scored, ["query_id"], [F.desc("is_strict"), F.desc("raw_score"), F.asc("chunk_id")], k
    )
    tier = F.max("is_strict").over(Window.partitionBy("query_id"))
    return ranked.withColumn("_tier", tier).where(F.col("is_strict") == F.col("_tier")).drop("_tier")


# ---------------------------------------------------------------- symbols

def symbol_exact(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """Case-sensitive name match scores 1.0, case-insensitive 0.95."""
    asked = queries.select(
        *SCOPE, "query_id", F.trim("query_text").alias("query_text"), F.lower(F.trim("query_text")).alias("_lower")
    ).where(F.col("query_text") != "")
    joined = scale.dealt(symbols, "symbol_id").withColumn("_lower", F.lower("name")).join(scale.unsent(asked), [*SCOPE, "_lower"])
    same = F.col("name") == F.col("query_text")
    return joined.withColumn("score", F.when(same, 1.0).otherwise(0.95)).withColumn(
        "match_type", F.when(same, "exact_case_sensitive").otherwise("exact_case_insensitive")
    ).drop("_lower", "query_text")


def gram_counts(rows: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Padded lower-case trigrams with their counts: (keys, gram, k)."""
    padded = F.concat(F.lit("  "), F.lower(text), F.lit(" "))
    starts = F.sequence(F.lit(1), F.length(text) + 1)
    return rows.select(
        *keys, F.explode(F.transform(starts, lambda i: F.substring(padded, i, F.lit(3)))).alias("gram")
    ).groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("k"))


def name_similarity(names: DataFrame, queries: DataFrame) -> DataFrame:
    """Dice similarity of distinct names and queries above the fuzzy threshold: (query_id, scope, name, score)."""
    left = gram_counts(names.select(*SCOPE, "name").distinct(), [*SCOPE, "name"], "name")
    asked = queries.select(*SCOPE, "query_id", F.trim("query_text").alias("query_text")).where(F.col("query_text") != "")
    right = gram_counts(asked, [*SCOPE, "query_id", "query_text"], "query_text").withColumnRenamed("k", "m")
    # A pair above the threshold has gram counts within this ratio of each other.
    ratio = (2 - FUZZY_THRESHOLD) / FUZZY_THRESHOLD
    n, m = F.length("name") + 1, F.length("query_text") + 1
    joined = left.join(scale.unsent(right), [*SCOPE, "gram"]).where(
        (n <= m * ratio) & (m <= n * ratio) & (F.lower("name") != F.lower("query_text"))
    )
    overlap = joined.groupBy(*SCOPE, "query_id", "query_text", "name").agg(F.sum(F.least("k", "m")).alias("_overlap"))
    score = 2.0 * F.col("_overlap") / (n + m)
    return overlap.select("query_id", *SCOPE, "name", score.alias("score")).where(F.col("score") > FUZZY_THRESHOLD)


def symbol_fuzzy(symbols: DataFrame, queries: DataFrame, k: int = FUZZY_LIMIT) -> DataFrame:
    """Trigram-close symbols strictly above the threshold, best k by score, name, id; exact names excluded.

    Names are ranked before they meet their symbols: each of the best k names has a symbol, so k names are enough, and
    of a name no more than its first k symbols can be among the best. So a pair of question and name makes at most k rows.
    """
    names = scale.top_k(name_similarity(symbols, queries), ["query_id"], [F.desc("score"), F.asc("name")], k).drop("rank")
    first = scale.top_k(scale.dealt(symbols, "symbol_id"), [*SCOPE, "name"], [F.asc("symbol_id")], k).drop("rank")
    scored = first.join(scale.unsent(names), [*SCOPE, "name"]).withColumn("match_type", F.lit("fuzzy"))
    ranked = scale.top_k(scored, ["query_id"], [F.desc("score"), F.asc("name"), F.asc("symbol_id")], k)
    return ranked.drop("rank")


def symbol_matches(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    return symbol_exact(symbols, queries).unionByName(symbol_fuzzy(symbols, queries))


def owner_join(points: DataFrame, chunks: DataFrame) -> DataFrame:
    """Join symbols (scope, file_path, name, symbol_start, ...) to owning chunks: same file and same name or start line inside.

    Both conditions become keys of one equi-join: a line block or a name. A pair that meets by name
    counts only when the start line lies outside, so no pair is produced twice.
    """
    block = lambda line: F.concat(F.lit("b"), F.floor(line / F.lit(scale.LINE_BLOCK)).cast("string"))
    by_name = lambda name: F.concat(F.lit("n"), name)
    left = points.withColumn("_key", F.explode(F.array(block(F.col("symbol_start")), by_name(F.col("name")))))
    blocks = F.transform(
        F.sequence(
            F.floor(F.col("start_line") / scale.LINE_BLOCK), F.floor(F.greatest("start_line", "end_line") / scale.LINE_BLOCK)
        ),
        lambda x: F.concat(F.lit("b"), x.cast("string")),
    )
    keys = F.filter(F.array_append(blocks, by_name(F.col("symbol_name"))), lambda k: k.isNotNull())
    right = chunks.select(*SCOPE, "chunk_id", "file_path", "start_line", "end_line", F.explode(keys).alias("_key"))
    inside = F.col("symbol_start").between(F.col("start_line"), F.col("end_line"))
    return left.join(scale.unsent(right), [*SCOPE, "file_path", "_key"]).where(F.col("_key").startswith("b") == inside).drop("_key")


def owner_pairs(matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """(match, chunk) pairs where the chunk owns the matched symbol."""
    return owner_join(matches.withColumnsRenamed({"start_line": "symbol_start", "end_line": "symbol_end"}), chunks)


def symbol_owner_chunks(matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """Best score per owning chunk with the matched symbols collected in place order.

    Pairs are dealt first: a task of the join would gather its sets in memory before, and each set once more after.
    """
    pairs = scale.dealt(owner_pairs(matches, chunks), "query_id", "chunk_id")
    return pairs.groupBy("query_id", *SCOPE, "chunk_id", "file_path").agg(
        F.max("score").alias("raw_score"),
        F.array_sort(
            F.collect_set(F.struct(
                "symbol_start", "symbol_end", "name", "match_type"
            ))
        ).alias("matched_symbols"),
    )


def contained_symbols(matches: DataFrame, chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Matched symbols of each chunk plus every symbol whose start line lies in it; a match wins over plain containment.

    Rows are dealt before the best type of each is picked: the join's few large tasks would sort all that they make.
    """
    hits = owner_pairs(matches, chunks).select(
        "query_id", *SCOPE, "chunk_id", "name", "symbol_start", "symbol_end", "match_type", F.lit(0).alias("_priority")
    )
    inside = scale.points_in_intervals(
        symbols.select(
            *SCOPE, "file_path", "name", F.col("start_line").alias("symbol_start"), F.col("end_line").alias("symbol_end")
        ),
        chunks.join(hits.select(*SCOPE, "chunk_id").distinct(), [*SCOPE, "chunk_id"], "left_semi").select(
            *SCOPE, "chunk_id", "file_path", "start_line", "end_line"
        ),
        [*SCOPE, "file_path"], "symbol_start", "start_line", "end_line",
    ).select(*SCOPE, "chunk_id", "name", "symbol_start", "symbol_end").distinct()
    added = hits.select("query_id", *SCOPE, "chunk_id").distinct().join(inside, [*SCOPE, "chunk_id"]).select(
        "query_id", *SCOPE, "chunk_id", "name", "symbol_start", "symbol_end",
        F.lit("contained").alias("match_type"), F.lit(1).alias("_priority"),
    )
    rows = scale.dealt(hits.unionByName(added), "query_id", "chunk_id")
    return rows.groupBy("query_id", *SCOPE, "chunk_id", "name", "symbol_start", "symbol_end").agg(
        F.min(F.struct("_priority", "match_type"))["match_type"].alias("match_type")
    )
