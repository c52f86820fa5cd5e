import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, score double, shard int, slot long, words string, n int, fp long, component_id long, lines string, host string, n_lines long, kept string"
LONG = "palabra " * 30_000 + "\n" + "x" * 50_000
BASE = "the quick brown fox jumps over the lazy dog while the sun sets behind seven green hills tonight"


def doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), 7, "k", 0.5, 1, 2, "w", 3, 4, 5, "l", "h", 6, "x")


EDGE = [
    doc(1, BASE), doc(2, BASE), doc(3, BASE.upper()), doc(4, None), doc(5, ""), doc(6, "   \n\t\n"), doc(7, LONG), doc(8, "¿Qué? — ¡ÑANDÚ!", "es", None), doc(None, "no id here at all", None, "s"),
    doc(9, BASE + " z"), doc(9, BASE + " z"), doc(10, "!!! ??? ...", None), doc(11, "漢字 かな 한글", None, "t"), doc(12, "a"), doc(13, None, "fr"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    return spark.createDataFrame(EDGE, COLUMNS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
