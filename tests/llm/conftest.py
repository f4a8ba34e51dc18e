import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; a table may have them too.
CLASHES = ("norm", "open", "rows", "band", "key", "start", "size", "place", "bucket", "terms", "range", "shard", "sha", "a", "b", "component", "text_key", "passes", "gone", "__len", "__pre", "__sha", "__gone", "__id", "__key", "__row", "__ranges", "norm_length", "prefix_hash", "g_id", "g_sha", "hint", "of_id", "of_key", "ranges", "row")

LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
BASE = " ".join(f"word{i}" for i in range(200))
NEAR = BASE.replace("word17 ", "changed ")
FAR = " ".join(f"other{i}" for i in range(200))


@pytest.fixture(scope="session")
def make(spark):
    def docs(rows, clashes=True):
        df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)
        if clashes:
            from pyspark.sql import functions as F

            for c in CLASHES:
                df = df.withColumn(c, F.lit(f"own {c}"))
        return df

    return docs


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty, blank, repeated and very long texts, ties and a null id."""
    return [
        (1, BASE, "s1"), (2, NEAR, "s1"), (3, BASE.replace(" ", "\n"), "s2"), (4, FAR, "s2"), (5, None, None), (6, "", "s1"), (7, " \t\n", "s1"), (8, "short text", "s3"), (8, "short text", "s3"),
        (9, LONG, "s1"), (10, "Short Text", "s3"), (None, "a row without an id", "s2"), (11, "shorttext", "s2"), (12, "dé à 😀 vu", "s1"),
    ]
