"""Every query of the subpackage that has SQL against DuckDB, on the smallest tables."""

import pytest

from gleaner.llm import queries
from tests.test_oracle import duck, plain  # noqa: F401


@pytest.mark.parametrize("name", list(queries.SQL))
def test_same_rows(spark, duck, sf_dir, name):  # noqa: F811
    df = queries.QUERIES[name](spark, sf_dir)
    found = duck.execute(queries.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    got = [tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()]
    want = [tuple(plain(dict(zip(columns, r))[c]) for c in sorted(columns)) for r in found.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
