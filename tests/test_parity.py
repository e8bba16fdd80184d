"""Every registered query with a DuckDB twin, side by side on the smallest tables; the large comparison
is tools/parity.py."""

import math
from pathlib import Path

import duckdb
import pytest

from palimpsest import plans
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple("NaN" if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_parity(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    found = duck.execute(plans.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert plain(df.columns, [tuple(r) for r in df.collect()]) == plain(columns, found.fetchall())


def test_llm_is_optional():
    """The rest never imports the llm subpackage."""
    root = Path(plans.__file__).parents[1]
    assert not [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and ("palimpsest.llm" in p.read_text() or "from ..llm" in p.read_text() or "from .llm" in p.read_text())]
