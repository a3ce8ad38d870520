import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of (doc_id, text) as a stored table with the columns of documents and some that clash with results."""
    from codelode.llm.common import saved

    def make(rows, extra=False):
        frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
        if extra:
            from pyspark.sql import functions as F

            for name in ("score", "shard", "kept", "n_lines", "size", "slot", "component_id", "key", "tokens", "keys", "seed", "class"):
                frame = frame.withColumn(name, F.lit("x"))
        return saved(frame, "test-docs")

    return make


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, white space, repeated rows, a very long text, ties, copies and near copies."""
    rng = random.Random(3)
    base = words(rng, 120)
    near = [*base]
    near[60] = "changed"
    chain = [*near]
    chain[5] = "again"
    long_text = " ".join(words(rng, 30_000, 5000))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (6, "one two"), (7, "one  two\n"), (8, "Ünïcode ß ﬀ words İn line"),
        (10, " ".join(base)), (11, " ".join(base).upper()), (12, " ".join(near)), (13, " ".join(chain)), (13, " ".join(chain)),
        (20, long_text), (21, long_text + " tail"), (22, "x" * 200_000), (None, "no id here, none at all"), (None, None),
    ]
    for i in range(30, 60):
        rows.append((i, "\n".join(["A shared line that repeats", " ".join(words(rng, 30)), "short", "  a SHARED line that repeats\t"])))
    return rows
