import pytest

WORDS = ("alder birch cedar doum elm fig gum hazel ironwood juniper kapok larch maple neem oak pine quince rowan "
         "spruce teak upas viburnum willow xylia yew zelkova").split()
LONG = " ".join(f"{WORDS[i % 26]}{i * 7919 % 1013}" for i in range(6000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def line(seed: int, n: int) -> str:
    return " ".join(f"{WORDS[(seed * 31 + i * 7) % 26]}{(seed * 17 + i * i) % 97}" for i in range(n))


def hard_rows() -> list[tuple]:
    """Nulls in any column, empty, blank and very long texts, ties and repeated rows."""
    para = [line(s, 60) for s in range(6)]
    texts = [None, "", " \n\t ", "one", "A b c D", LONG, LONG, "\n".join(para), "\n".join(para),
             "\n".join([*para[:3], "end here"]), f"{para[0]}\n{para[0]}", "tie " * 200, "é ß 漢字 😀\x00  x", "a" * 30_000]
    rows = [(i, t, None if i == 3 else "en", None if i == 4 else f"src{i % 3}", None if t is None else len(t))
            for i, t in enumerate(texts)]
    return [*rows, (None, texts[7], "fr", "src0", None), (None, None, None, None, None), rows[5], rows[8], rows[8]]


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(hard_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(spark):
    """Extra columns under names that operators use themselves."""
    from pyspark.sql import functions as F
    names = ("lines key n label node a b words pos h g start end kept n_words score ids at part total block first last "
             "language lower upper th grams unit home visits").split()
    return spark.createDataFrame(hard_rows(), DOCS).withColumns({c: F.lit("x") for c in names})
