import pytest

from epicell.llm.common import ship_package

LONG = "The river of the and within this land. " * 20_000
ROWS = [
    (1, "Thou art a scum and idiot.\nSecond line here.", "en", "a", 40),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, "12 34 !!", "de", "b", 8),
    (5, LONG, "en", "a", len(LONG)),
    (6, "Der und die das ist ein.", "de", "b", 24),
    (6, "Der und die das ist ein.", "de", "b", 24),
    (None, "Der und die das ist ein.", "de", None, 24),
    (8, " \n\t ", "fr", "b", 4),
    (9, "mixed <|endoftext|> text  İ café \U0001f600", "fr", "b", 30),
]
EXTRA = "toxicity double, toxic_spans string, quality_score string, lang_pred string, lang_score string, ids string, decoded string, dropped_lines string, sequence_id long, text_hash long, key string, label string, block int"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every awkward case, and columns named like what operators add or use inside."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    names = [part.split()[0] for part in EXTRA.split(", ")]
    kinds = [part.split()[1] for part in EXTRA.split(", ")]
    return df.selectExpr("*", *[f"cast(7 as {k}) as `{n}`" for n, k in zip(names, kinds)]).repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
