import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from texts, numbered from 0, or from (doc_id, text) pairs."""

    def make(*texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)

    return make


@pytest.fixture
def awkward(docs):
    """Columns of the operators' own working names beside the usual ones."""

    def make(*texts):
        df = docs(*texts)
        for c in ("band", "key", "hash", "n", "name", "print", "score", "kept", "part", "_text", "doc", "component", "id"):
            df = df.selectExpr("*", f"'x' AS {c}")
        return df

    return make
def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}
