"""Every registered query with a SQL twin gives the twin's rows; the others are in test_restated.py."""

import math
import os

import duckdb
import pytest

from peakloom.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1.1e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_twin(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    own = sorted((tuple(r) for r in df.select(columns).collect()), key=str)
    twin = con.sql(registry.ORACLE_SQL[name])
    assert sorted(twin.columns) == columns
    other = sorted(twin.project(", ".join(f'"{c}"' for c in columns)).fetchall(), key=str)
    assert len(own) == len(other)
    assert all(same(x, y) for a, b in zip(own, other, strict=True) for x, y in zip(a, b, strict=True))


def test_every_query_is_tested():
    own = open(os.path.join(os.path.dirname(__file__), "test_restated.py")).read() + open(__file__).read()
    assert all(f'QUERIES["{name}"]' in own for name in set(registry.QUERIES) - set(registry.ORACLE_SQL))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_every_missing_cell_is_filled(spark):
    from bisect import bisect_left

    from peakloom.plans import views as V

    large = "/root/testdata/sf0.01"  # all 20 samples have peaks
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{large}/lineitem.parquet'")
    rows = con.sql(f"with {V.FEATURES} select fid, part, sample_id, mz, rt, peak_height from features").fetchall()
    best, seen, own = {}, set(con.sql(f"with {V.MATRIX} select feature_id, sample_id from matrix").fetchall()), {}
    for fid, part, sample, mz, rt, height in rows:
        best[part] = max(best.get(part, (-1,)), (height, fid, mz, rt))
        own.setdefault(sample, []).append((mz, rt, height))
    own = {sample: sorted(x) for sample, x in own.items()}
    expected = {}
    for part, (_, _, m, t) in best.items():
        for sample in range(20):
            if (part, sample) in seen:
                continue
            scans = {}
            near = own.get(sample, [])
            for mz, rt, height in near[bisect_left(near, (m - 0.6,)) : bisect_left(near, (m + 0.6,))]:
                if abs(mz - m) <= 0.5 and abs(rt - t) <= 5:
                    scans[rt] = max(scans.get(rt, 0), height)
            if scans:
                x = sorted(scans.items())
                top = sorted(scans.values())[-3:]
                expected[part, sample] = (max(scans.values()), sum((b - a) * (i + j) / 2 for (a, i), (b, j) in zip(x, x[1:])) * 60, sum(top) / len(top))
    found = {(r.feature_id, r.sample_id): (r.peak_height, r.peak_area, r.top_average) for r in registry.QUERIES["gap_fill_matrix"](spark, large).collect()}
    assert set(found) == set(expected) and len({s for _, s in found}) == 20
    assert all(abs(a - b) <= 1.001 for k in found for a, b in zip(found[k], expected[k], strict=True))
