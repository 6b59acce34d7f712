import pytest

LONG = "lorem ipsum dolor sit amet " * 20_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids, texts and groups, empty and blank and very long texts, repeated rows and ids, and extra columns with clashing names."""
    same = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (None, "text of a row without id", "en", "s"), (1, None, "en", "s"), (2, "", "en", None), (3, " \n\t ", None, "s"), (4, LONG, "en", "s"),
        (5, same, "en", "s"), (5, same, "en", "s"), (5, same + " more", "de", "s"), (6, same, "en", "t"), (7, "x" * 50_000, "en", "s"), (None, None, None, None),
    ]
    extra = ["row", "start", "length", "key", "grp", "pos", "part", "shard", "slot", "mu", "f0", "n", "node", "words", "kept", "score", "rank"]
    frame = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return frame.selectExpr("*", *[f"'x' AS {c}" for c in extra])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
