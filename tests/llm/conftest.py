import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def inputs(spark):
    from docskein.llm.queries import Inputs
    from docskein.session import ship

    ship(spark)
    return Inputs(spark, SF)


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents from (doc_id, text[, source]) rows, with an extra column whose name operators use inside."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] else None, "x") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, fp string")
    return make
