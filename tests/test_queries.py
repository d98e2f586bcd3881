"""Every query with SQL gives what DuckDB gives on the same tables."""

import math

import duckdb
import numpy as np
import pytest

from copse.operators import proximity
from copse.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()


@pytest.fixture(scope="session")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(v):
    if type(v).__name__ == "Decimal":
        v = float(v)
    return round(v, 6) + 0.0 if isinstance(v, float) and math.isfinite(v) else v


def rows(values, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in values]
    return sorted(names), sorted(out, key=lambda t: tuple((x is None, str(type(x)), x) for x in t))


def close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-6 * max(1.0, abs(a))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, db, name):
    df = registry.QUERIES[name](spark, sf_dir)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    cur = db.execute(registry.ORACLE_SQL[name])
    want = rows(cur.fetchall(), [d[0] for d in cur.description])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert all(close(x, y) for a, b in zip(got[1], want[1], strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_other_queries_have_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def mds_by_hand(a, n_components):
    """Power iteration on the whole matrix, from the alternating vector."""
    b = 0.5 * (a - a.mean(0) - a.mean(1)[:, None] + a.mean())
    out = []
    for _ in range(n_components):
        u = np.where(np.arange(len(a)) % 2 == 0, 1.0, -1.0) / np.sqrt(len(a))
        for _ in range(1000):
            v = b @ u
            lam = u @ v
            if np.linalg.norm(v - lam * u) < abs(lam) * 1e-7:
                break
            u = v / np.linalg.norm(v)
        out.append(u * np.sqrt(abs(lam)))
        b = b - lam * np.outer(u, u)
    return np.array(out).T


def test_mds_embedding_has_all_rows(spark, sf_dir, db):
    e = np.array([r[0] for r in db.execute("select embedding from embeddings order by vec_id").fetchall()], float)
    leaf = np.where(e[:, :3] <= 0, 1, 2) * 3 + np.where(e[:, 3:6] <= 0.05, 0, 1)
    a = (leaf[:, None] == leaf[None]).mean(2)
    got = registry.QUERIES["mds_embedding"](spark, sf_dir).orderBy("row_id").collect()
    ids = [r[0] for r in db.execute("select vec_id from embeddings order by 1").fetchall()]
    assert [r["row_id"] for r in got] == ids
    assert np.allclose([(r["c0"], r["c1"]) for r in got], mds_by_hand(a, 2), atol=1e-5)


@pytest.mark.parametrize("on_driver", [0, 1000])
def test_mds_of_classes_equals_numpy(spark, on_driver):
    kinds = [(0, 0), (0, 1), (1, 1), (2, 1), (2, 2)]
    rows = [(i * 3, t, kinds[(i * i + i // 3) % 5][t]) for i in range(17) for t in range(2)]
    leaf = np.array([kinds[(i * i + i // 3) % 5] for i in range(17)])
    a = (leaf[:, None] == leaf[None]).mean(2)
    members, leaves = proximity.leaf_classes(spark.createDataFrame(rows, "row_id long, tree_id int, leaf int"))
    got = proximity.mds(proximity.proximity(leaves), 2, members=members, on_driver=on_driver).orderBy("row_id").collect()
    assert [r["row_id"] for r in got] == list(range(0, 51, 3))
    assert np.allclose([(r["c0"], r["c1"]) for r in got], mds_by_hand(a, 2), atol=1e-5)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
