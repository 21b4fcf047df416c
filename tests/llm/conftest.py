import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents of every awkward kind: nulls in all columns, empty and very long texts, ties and repeated rows."""
    long = "word " * 200_000 + "\n" + "x" * 300_000
    rows = [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, " \n\t \x0b\n", None, None, 5),
        (4, long, "en", "b", len(long)),
        (5, "Same text in two rows, here and there.\nSecond line of it.", "en", "a", 57),
        (5, "Same text in two rows, here and there.\nSecond line of it.", "en", "a", 57),
        (6, "Same text in two rows, here and there.\nSecond line of it.", None, "b", 57),
        (None, "No id, but words all the same \U0001d11e é", "fr", None, 40),
        (None, None, None, None, None),
        (7, "12345 67890 !!!", "de", "", 15),
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with extra columns named like those that operators use or add."""
    from pyspark.sql import functions as F

    names = "_key _text _id _fp _u _v _s _z _size _items _overlap _score _sentence _of _lines _removed _gone _h _d _copy _times _main score kept shard depth _lang c0 c1"
    return odd.withColumns({n: F.lit(n) for n in names.split()})


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 0), (5, 1, 0), (6, 0, 1), (7, None, None), (None, 1, 1), (5, 1, 1)], "doc_id long, quality int, toxic int")
