import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from shoplens.schemas import TABLES, conform, ddl
from shoplens.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def table(spark):
    """Build a shop table from dicts; times are ISO text, absent columns null."""

    def make(name, rows):
        if not rows:
            return spark.createDataFrame([], ddl(name))
        columns = [c for c in TABLES[name] if any(c in r for r in rows)]
        schema = ", ".join(
            f"`{c}` {'string' if TABLES[name][c] in ('timestamp', 'decimal(8,2)') else TABLES[name][c]}" for c in columns
        )
        values = [tuple(r.get(c) for c in columns) for r in rows]
        return conform(spark.createDataFrame(values, schema), name)

    return make


def rows_of(df, *columns):
    """Rows as sorted tuples of the named columns (all by default)."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda t: tuple((v is not None, str(v)) for v in t))
