import pytest


@pytest.fixture(scope="session")
def tiny(spark, tmp_path_factory):
    """Writes rows as the parquet tables of a small folder."""

    def write(**tables):
        folder = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(str(folder / f"{name}.parquet"))
        return str(folder)

    return write


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    def make(rows, extra=False):
        df = spark.createDataFrame([(i, t, lang, src, len(t) if t is not None else None) for i, t, lang, src in rows], DOCS)
        # columns whose names might clash with those that operators make on the way
        return df.selectExpr("*", "1 AS _o", "2 AS rank", "3 AS size", "4 AS copies", "5 AS _key") if extra else df

    return make
