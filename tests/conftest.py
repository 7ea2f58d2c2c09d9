import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quire.session import clean_shared, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, partitions=4, memory="6g")
    yield session
    clean_shared(session)
    session.stop()


@pytest.fixture
def table(spark):
    def make(schema, *rows):
        return spark.createDataFrame(list(rows), schema)

    return make


@pytest.fixture
def pages(table):
    """The three-page sample document."""
    return table(
        "doc_id long, page int, width double, height double, rotation int, text string",
        (1, 0, 612.0, 792.0, 0, "Hello World"),
        (1, 1, 612.0, 792.0, 0, "Page Two Content test@example.com"),
        (1, 2, 612.0, 792.0, 0, "Page Three"),
    )


SPAN = (
    "doc_id long, page int, block int, line int, span int, text string, font string, size double, color int, flags int, "
    "x0 double, y0 double, x1 double, y1 double, origin_x double, origin_y double"
)


def span(doc, page, i, text, size=12.0, flags=0, font="Helvetica", x0=72.0, y0=72.0, x1=None, origin=True, color=0):
    x1 = x0 + 6.0 * len(text) if x1 is None else x1
    return (doc, page, i, 0, 0, text, font, size, color, flags, x0, y0, x1, y0 + size, x0, y0 + size - 2 if origin else None)


@pytest.fixture
def spans(table):
    """One span per page of the sample document."""
    return table(
        SPAN,
        span(1, 0, 0, "Hello World"),
        span(1, 1, 0, "Page Two Content test@example.com"),
        span(1, 2, 0, "Page Three"),
    )


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
