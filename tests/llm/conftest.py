import pytest

CLASH = ["d", "h", "n", "src", "size", "shard", "least", "tokens", "item", "key", "sig", "u", "v", "g", "rule", "verdict", "file", "_bad", "held_out", "score", "_h", "_dear"]


@pytest.fixture(scope="session")
def docs_frame(spark):
    """Documents from (doc_id, text[, source]) rows, with columns whose names the operators use themselves."""
    def make(rows):
        rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), *(f"x{i}" for i in range(len(CLASH)))) for r in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
        return spark.createDataFrame(rows, schema)
    return make


LONG = " ".join(f"w{i * 7919 % 1000}" for i in range(30_000))
ODD = [(None, "a b c d e f g"), (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, LONG), (6, "twice seen words"), (6, "twice seen words"), (7, "\u00a0no\u2003break\x1c"), (None, None)]


@pytest.fixture(scope="session")
def odd_docs(docs_frame):
    return docs_frame(ODD)
