import pytest

# Names of columns that operators make or use inside.
CLASHING = "length size place_ findings kind item_id copies size_ row_ id_ twin_ hi lo rep n token gid sub comp mark salt row_id bucket_ number_ before_ n_ source_ edge part score predicted figures z y kept mkey prefix sketch component_id lines text_hash".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in CLASHING)

# Nulls, empty and white-space texts, repeated rows and extra columns whose names clash with the operators' own.
ODD = [
    (1, None, "en", "a", 0),
    (2, "", "en", None, 0),
    (3, " \n\t ", None, "a", 4),
    (4, "one two three", "en", "b", 13),
    (4, "one two three", "en", "b", 13),
    (5, "İstanbul   café <|endoftext|> \x1c it's 12", None, None, 9),
    (6, "word " * 30_000, "en", "b", 150_000),
    (7, "x" * 120_000, "en", "b", 120_000),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([r + tuple(-7 - i for i in range(len(CLASHING))) for r in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
