import pytest

LONG = "wort " * 60_000
ROWS = [
    (1, "Mail ann@example.com or +1 (509) 555-6973, ip 10.0.0.1 card 4844508665317339"),
    (2, None),
    (3, ""),
    (4, LONG),
    (5, "the same text of several words that is repeated here"),
    (6, "the same text of several words that is repeated here"),
    (6, "the same text of several words that is repeated here"),
    (7, "token = \"b44e15e09fd311c3cf3163b66d5a9875b883d8ce\" é 😀 password: hunter2hunter2"),
    (None, "a row without an id that has some words of its own"),
    (8, " \n\t "),
    (9, "one"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeats, and columns whose names the operators use themselves."""
    rows = [(i, t, "en", "src", len(t or ""), 1, b"x", "y", 2.0, 3) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, part int, ids binary, body string, score double, n long")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("doc_id > 100")


@pytest.fixture(scope="session")
def documents():
    import duckdb

    return duckdb.connect().sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()


@pytest.fixture(scope="session")
def small_dir(tmp_path_factory, odd, spark):
    """A folder of tables like the driver's, made of the odd rows."""
    top = str(tmp_path_factory.mktemp("odd"))
    odd.write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (5, 1, 0), (None, 1, None), (9, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, "some words of its own"), (2, None), (3, ""), (None, "mail ann")], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top
