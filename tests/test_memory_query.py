"""The registered memory search gives every match, as the service does."""

import __spark_entry__ as entry


def test_memory_search_returns_all_matches_newest_first(spark, tmp_path):
    docs = [(i, f"needle number{i}", "en", "s", 10) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(59, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, 0, "user", "needle")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(entry.queries()["memory_search"](spark, str(tmp_path)).collect(), key=lambda r: r.position)
    newest = sorted(range(59), key=lambda i: (-(i * 37 % 1000), i))
    assert [(r.query_id, r.memory_id, r.position) for r in got] == [("1-0", m, k + 1) for k, m in enumerate(newest)]
