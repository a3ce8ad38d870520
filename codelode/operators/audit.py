"""Narration audit: claims of a text that the inspected facts do not hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions import text as X

# Claim patterns and word lists, in checking order.
MAX_TEXT = 1600
PATH = r"(?<!\w)([\w.-]+(?:/[\w.-]+)+/?)"
FILE = r"(?i)(?<!\w)([\w.-]+\.(?:py|js|jsx|ts|tsx|json|md|yaml|yml|toml|txt|pdf))\b"
FOLDER = r"(?i)(?<![\w./])([\w.-]+(?:/[\w.-]+)*)\s+(?:folder|directory)\b"
FRAMEWORK = r"(?i)\b([A-Za-z][\w.+-]*)\s+(?:framework|library)\b"
DETECTED = r"\b([A-Z][A-Za-z0-9.+-]*)\s+is\s+detected\b"
TECHNOLOGY = r"\b(?i:uses|built with|powered by|backed by)\s+([A-Z][A-Za-z0-9.+-]*)\b"
COMPONENT = r"\b([A-Z][a-z][A-Za-z0-9_]*)\s+(?:model|service|component|class)\b"
NUMBER = r"(?<![\w.])\d+(?:\.\d+)?(?![\w.])"
KNOWN_FRAMEWORKS = [
    "angular", "django", "express", "fastapi", "flask", "nestjs", "next.js", "react", "svelte", "vite", "vue",
]
KNOWN_LANGUAGES = [
    "python", "javascript", "typescript", "jsx", "tsx", "documentation",
]
NUMBER_WORDS = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve",
]
PLAIN_FOLDERS = ["top-level", "repository", "project", "source", "no", "application"]
PLAIN_FRAMEWORKS = ["web", "backend", "frontend", "application", "database", "ui"]


def narration_claims(texts: DataFrame) -> DataFrame:
    """(text_id, repository_id, pos, code, value, kind): one row per claim that needs a fact."""
    text = F.replace(F.col("text"), F.lit("\\"), F.lit("/"))

    def claims(values: Column, pos: int, code: str, kind: str) -> Column:
        return F.transform(
            values,
            lambda v: F.struct(F.lit(pos).alias("pos"), F.lit(code).alias("code"), F.lit(kind).alias("kind"), v.alias("value")),
        )

    def named(words: list[str], left: str) -> Column:
        hits = [
            F.when(text.rlike(rf"(?i){left}" + w.replace(".", r"\.") + r"(?!\w)"), F.lit(w)) for w in words
        ]
        return F.filter(F.array(*hits), lambda x: x.isNotNull())

    counted = [
        F.when(text.rlike(rf"(?i)\b{word}\b"), F.lit(str(value))) for value, word in enumerate(NUMBER_WORDS)
    ]
    lower = lambda values: F.transform(values, F.lower)
    every = F.concat(
        claims(F.transform(X.matches(text, PATH, 1), lambda p: F.regexp_replace(p, r"^\./", "")), 1, "unknown_path", "path"),
        claims(X.matches(text, FILE, 1), 2, "unknown_file", "file"),
        claims(F.filter(X.matches(text, FOLDER, 1), lambda v: ~F.lower(v).isin(PLAIN_FOLDERS)), 3, "unknown_folder", "folder"),
        claims(
            F.filter(lower(X.matches(text, FRAMEWORK, 1)), lambda v: ~v.isin(PLAIN_FRAMEWORKS)),
            4, "unknown_framework", "framework",
        ),
        claims(named(KNOWN_FRAMEWORKS, r"(?<!\w)"), 5, "unknown_framework", "framework"),
        claims(named(KNOWN_LANGUAGES, r"(?<![\w./])"), 6, "unknown_language", "language"),
        claims(lower(X.matches(text, DETECTED, 1)), 7, "unknown_detected_name", "technology"),
        claims(
            F.filter(lower(X.matches(text, TECHNOLOGY, 1)), lambda v: ~v.isin("a", "an", "the")),
            8, "unknown_technology", "technology",
        ),
        claims(X.matches(text, COMPONENT, 1), 9, "unknown_component", "name"),
        claims(X.matches(text, NUMBER), 10, "unknown_number", "number"),
        claims(F.filter(F.array(*counted), lambda x: x.isNotNull()), 11, "unknown_number", "number"),
    )
    return texts.select("text_id", "repository_id", F.explode(every).alias("c")).select("text_id", "repository_id", "c.*")


def allowed_facts(inventory: DataFrame, languages: DataFrame, versions: DataFrame) -> DataFrame:
    """(repository_id, kind, value) that a narration may state."""
    path_facts = inventory.where(F.col("fact").isin("entrypoint", "test", "database", "api", "auth"))
    paths = path_facts.select("repository_id", F.col("value").alias("path")).distinct()
    pieces = F.split("path", "/")
    parents = paths.where(F.contains("path", F.lit("/"))).select(
        "repository_id",
        F.explode(
            F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: F.array_join(F.slice(pieces, F.lit(1), i), "/"))
        ).alias("value"),
    )
    folders = (
        inventory.where(F.col("fact").isin("top_folder", "api_organization")).select("repository_id", "value")
        .unionByName(parents).distinct()
    )
    frameworks = inventory.where(F.col("fact") == "framework").select("repository_id", F.lower("value").alias("value"))
    spoken = languages.select("repository_id", F.lower("language").alias("value"))
    numbers = languages.select("repository_id", F.col("files").cast("string").alias("value")).unionByName(
        versions.select("repository_id", F.col("version").cast("string").alias("value"))
    )
    tops = inventory.where(F.col("fact") == "top_folder").select("repository_id", F.lower("value").alias("value"))

    def of(kind: str, frame: DataFrame) -> DataFrame:
        return frame.select("repository_id", F.lit(kind).alias("kind"), "value")

    names = paths.select("repository_id", F.col("path").alias("value"))
    return (
        of("path", names).unionByName(of("path", folders)).unionByName(of("name", names)).unionByName(of("name", folders))
        .unionByName(of("folder", folders))
        .unionByName(of("file", paths.select("repository_id", F.substring_index("path", "/", -1).alias("value"))))
        .unionByName(of("framework", frameworks)).unionByName(of("language", spoken))
        .unionByName(of("technology", frameworks)).unionByName(of("technology", spoken))
        .unionByName(of("number", numbers))
        .unionByName(of("segment", tops)).unionByName(of("segment", frameworks)).unionByName(of("segment", spoken))
        .distinct()
    )


def narration_audit(texts: DataFrame, facts: DataFrame) -> DataFrame:
    """First violation code per text, or OK; empty and over-long texts fail on length.

    Claims meet facts by equality. A path claim also holds without its trailing slash or
    punctuation, or when each of its segments is a known top name.
    """
    claims = narration_claims(texts)
    bare = F.regexp_replace("value", "/+$", "")
    unpunctuated = F.regexp_replace(F.regexp_replace("value", r"[.,;:!?]+$", ""), "/+$", "")
    options = F.when(F.col("kind") == "path", F.array("value", bare, unpunctuated)).otherwise(F.array("value"))
    keyed = claims.withColumn("option", F.explode(F.array_distinct(options)))
    known = facts.withColumnRenamed("value", "option").withColumn("_known", F.lit(1))
    held = keyed.join(known, ["repository_id", "kind", "option"], "left").groupBy(
        "text_id", "repository_id", "pos", "code", "kind", "value"
    ).agg(F.max("_known").alias("_known"))
    missing = held.where(F.col("_known").isNull()).drop("_known")
    segments = missing.where(F.col("kind") == "path").select(
        "text_id", "repository_id", "value", F.explode(F.array_distinct(F.split(F.lower(bare), "/"))).alias("option")
    )
    tops = facts.where(F.col("kind") == "segment").select("repository_id", F.col("value").alias("option"), F.lit(1).alias("_top"))
    composed = segments.join(tops, ["repository_id", "option"], "left").groupBy("text_id", "repository_id", "value").agg(
        (F.count("_top") == F.count(F.lit(1))).alias("_composed")
    )
    violations = (
        missing.join(composed, ["text_id", "repository_id", "value"], "left")
        .where(~((F.col("kind") == "path") & F.coalesce("_composed", F.lit(False))))
        .groupBy("text_id")
        .agg(F.min_by("code", F.struct("pos", "code")).alias("_code"))
    )
    too_long = (F.trim("text") == "") | (F.length("text") > MAX_TEXT)
    return texts.join(violations, "text_id", "left").select(
        "text_id", F.when(too_long, "length").otherwise(F.coalesce("_code", F.lit("OK"))).alias("verdict")
    )
