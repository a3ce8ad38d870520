"""Not-modified captures of a web archive, resolved to the full response that they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a not-modified answer may replace in the stored response.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Seconds of captures that are ordered together; a URL with very many captures is split at these borders.
BLOCK_SECONDS = 3600

RECORDS = "record_id long, ts long, url string, kind string, headers map<string,string>, digest string"


def canonical_url(url: Column) -> Column:
    """Without scheme, default port, www. or m. prefix, fragment, tracking parameters, index page, .html and last slash.

    Host and scheme lose their case; a null URL stays null.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z]+://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^(www|m)\\.|:(80|443)$", "")
    path = F.regexp_extract(bare, "^[^/?]*([^?]*)", 1)
    path = F.regexp_replace(path, "(/index)?(\\.html?)?/*$", "")
    query = F.regexp_extract(bare, "\\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref)(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _tag(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """(record_id, response_id, state, headers, digest) of every revisit record that has a record_id.

    Each revisit meets the latest full response of its canonical URL with an earlier time (equal times: none; among
    responses of one time the largest record_id). Validators decide: entity tags if both have one (weak ones compare
    without their mark), else last-modified if both have it, else the payload digest. `state` is resolved, mismatch,
    unproven (no validator in common) or missing (no earlier response or no URL). A resolved revisit gets the
    response's headers with its own permitted ones on top, and the response's digest; the payload itself isn't moved.
    A repeated revisit gives a row each time; of responses with one record_id and time the one with the largest digest counts.

    The latest response of each (URL, block of time) is found by a map-side aggregate and carried over later blocks;
    captures are ordered only within their block.
    """
    rows = records.select(
        "record_id", "ts", "kind", "headers", "digest", canonical_url(F.col("url")).alias("site"),
        F.floor(F.col("ts") / BLOCK_SECONDS).alias("block"),
    )
    answer = F.struct("ts", "record_id", "headers", "digest")
    full = rows.where("kind = 'response' AND site IS NOT NULL AND ts IS NOT NULL")
    asked = rows.where("kind = 'revisit' AND record_id IS NOT NULL").withColumn("new", F.struct("headers", "digest"))
    newest = full.groupBy("site", "block").agg(F.max(F.struct("ts", "record_id")).alias("top"))
    blocks = newest.select("site", "block", "top").unionByName(
        asked.where("site IS NOT NULL").select("site", "block").distinct().withColumn("top", F.lit(None).cast("struct<ts:bigint,record_id:bigint>"))
    ).groupBy("site", "block").agg(F.max("top").alias("top"))
    earlier = Window.partitionBy("site").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("site", "block", F.last("top", ignorenulls=True).over(earlier).alias("carried"))
    inside = Window.partitionBy("site", "block").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    slim = full.select("site", "block", "ts", "record_id", F.struct("ts", "record_id").alias("own")).unionByName(
        asked.select("site", "block", "ts", "record_id", F.lit(None).cast("struct<ts:bigint,record_id:bigint>").alias("own"), "new"),
        allowMissingColumns=True,
    )
    met = slim.withColumn("near", F.max("own").over(inside)).where("new IS NOT NULL").select("site", "block", "ts", "record_id", "near", "new")
    latest = F.coalesce(F.when(F.col("ts").isNotNull(), F.col("near")), F.col("carried"))
    met = met.join(carried, ["site", "block"], "left").select(
        "record_id", latest["record_id"].alias("response_id"), latest["ts"].alias("response_ts"),
        F.col("new.headers").alias("new"), F.col("new.digest").alias("new_digest"),
    )
    theirs = full.groupBy(F.col("record_id").alias("response_id"), F.col("ts").alias("response_ts")).agg(
        F.max_by(F.struct("headers", "digest"), F.coalesce("digest", F.lit(""))).alias("old")
    ).select("response_id", "response_ts", F.col("old.headers").alias("old"), F.col("old.digest").alias("old_digest"))
    joined = met.join(theirs, ["response_id", "response_ts"], "left")
    checks = [(_tag(F.col("new")["etag"]), _tag(F.col("old")["etag"])), (F.col("new")["last-modified"], F.col("old")["last-modified"]), (F.col("new_digest"), F.col("old_digest"))]
    state = F.when(F.col("response_id").isNull(), "missing")
    for a, b in checks:
        state = state.when(a.isNotNull() & b.isNotNull(), F.when(a == b, "resolved").otherwise("mismatch"))
    judged = joined.withColumn("state", state.otherwise("unproven"))
    ok = F.col("state") == "resolved"
    own = F.map_filter(F.coalesce("new", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(PERMITTED))
    kept = F.map_filter(F.coalesce("old", F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(own), k))
    return judged.select(
        "record_id", "response_id", "state", F.when(ok, F.map_concat(kept, own)).alias("headers"), F.when(ok, F.col("old_digest")).alias("digest")
    )


def captures(pages: DataFrame) -> DataFrame:
    """Archive records derived from a table of pages: a full response of each page and a later revisit of most.

    Times are seconds: page_id is the minute of the response. Revisits use other spellings of the URL; some come
    before their response, some have another entity tag, some only last-modified or a digest.
    """
    page, tag = F.col("page_id"), F.concat(F.lit('"'), F.substring(F.md5(F.col("html").cast("binary")), 1, 16), F.lit('"'))
    day = F.concat(F.lit("day "), F.floor(page / 1440).cast("string"))
    digest = F.sha2(F.col("html").cast("binary"), 256)
    response = pages.select(
        (page * 2).alias("record_id"), (page * 60).alias("ts"), "url", F.lit("response").alias("kind"),
        F.map_from_arrays(
            F.array(*map(F.lit, ["content-type", "cache-control", "date", "last-modified", "etag"])),
            F.array(F.lit("text/html"), F.lit("max-age=60"), (page * 60).cast("string"), day, tag),
        ).alias("headers"),
        digest.alias("digest"),
    )
    late = F.when(page % 13 == 0, page * 60 - 30).otherwise(page * 60 + 60 * (page % 200) + 30)
    bare = F.when(page % 11 == 0, F.lit(None)).when(page % 5 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag))
    again = F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("utm_medium=again#top"))
    revisit = pages.where(page % 3 != 2).select(
        (page * 2 + 1).alias("record_id"), late.alias("ts"), again.alias("url"), F.lit("revisit").alias("kind"),
        F.map_filter(
            F.map_from_arrays(
                F.array(*map(F.lit, ["x-cache", "cache-control", "date", "last-modified", "etag"])),
                F.array(F.lit("hit"), F.lit("max-age=120"), late.cast("string"), F.when(page % 22 == 0, F.lit(None)).otherwise(day), bare),
            ),
            lambda k, v: v.isNotNull(),
        ).alias("headers"),
        digest.alias("digest"),
    )
    return response.unionByName(revisit)
