"""Near-duplicate embeddings against all pairs."""

import duckdb
import numpy as np
import pytest
from goldseam.llm import nn_descent as nn
from goldseam.llm.queries import ORACLE_SQL, QUERIES
from helpers import Components

SCHEMA = "vec_id long, embedding array<float>, label int, root long, n int, grp string, unit int"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, "g", 3) for r in rows], SCHEMA).repartition(parts)


def brute(rows, threshold=nn.THRESHOLD):
    """(vec_id, n_links, component_id, kept) of (vec_id, embedding, label) rows by all pairs."""

    def usable(v, label):
        return label is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)

    unit = []
    for _, v, label in rows:
        if usable(v, label):
            x = np.array(v, np.float32).astype(np.float64)
            unit.append(x / np.linalg.norm(x))
        else:
            unit.append(None)
    groups, n = Components(), [0] * len(rows)
    by = {}
    for i, (_, v, label) in enumerate(rows):
        groups.find(i)
        if unit[i] is not None:
            by.setdefault((label, len(v)), []).append(i)
    for places in by.values():
        x = np.array([unit[i] for i in places])
        linked = x @ x.T >= threshold
        np.fill_diagonal(linked, False)
        for i, row in zip(places, linked, strict=True):
            n[i] = int(row.sum())
            for j in np.flatnonzero(row):
                groups.join(i, places[j])
    ids = {}
    for i, r in enumerate(rows):
        ids.setdefault(groups.find(i), []).append(r[0])
    out = []
    for i, r in enumerate(rows):
        known = [x for x in ids[groups.find(i)] if x is not None]
        least = min(known) if known else None
        out.append((r[0], n[i], least, r[0] == least))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def around(random, centre, count, spread):
    """Vectors about as far from a centre as ``spread`` says."""
    return [(centre + spread * random.standard_normal(len(centre))).tolist() for _ in range(count)]


def mixed(seed=5, size=24, noise=600):
    """Noise, lone pairs, groups around the threshold, a crowd, chains and copies, over labels."""
    random = np.random.default_rng(seed)
    vectors = [(random.standard_normal(size).tolist(), i % 3) for i in range(noise)]
    vectors += [((np.array(vectors[i][0]) * 2 + 0.15 * random.standard_normal(size)).tolist(), vectors[i][1]) for i in range(40)]
    vectors += [(v, 1) for v in around(random, random.standard_normal(size), 150, 0.22)]
    vectors += [(v, 2) for v in around(random, random.standard_normal(size), 25, 0.25)]
    step = random.standard_normal(size)
    at = random.standard_normal(size)
    vectors += [((at + 0.25 * i * step).tolist(), 0) for i in range(20)]  # a chain
    vectors += [(vectors[0][0], 0)] * 60 + [(vectors[0][0], 1)] * 5  # copies, and in another label
    order = random.permutation(len(vectors))
    return [(int(order[i]) + 100, *v) for i, v in enumerate(vectors)]


def test_all_kinds_of_groups(spark):
    rows = mixed()
    got = nn.near_duplicates(table(spark, rows))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept", "audited_recall"]
    assert found(got) == brute(rows)
    assert {r.audited_recall for r in got.collect()} - {None} == {1.0}
    assert max(r[1] for r in brute(rows)) > 100


def test_blocks_of_a_crowd(spark, monkeypatch):
    """Small blocks: many pairs of blocks, some out of each other's reach."""
    monkeypatch.setattr(nn, "BLOCK_BYTES", 8 * 24 * 16)
    rows = mixed(6, noise=60)
    assert found(nn.near_duplicates(table(spark, rows))) == brute(rows)


def test_exact_way_after_failed_audits(spark, monkeypatch):
    monkeypatch.setattr(nn, "WAVES", 1)
    monkeypatch.setattr(nn, "RECALL", 1.1)
    monkeypatch.setattr(nn, "BLOCK_BYTES", 8 * 24 * 50)
    rows = mixed(7, noise=200)
    got = nn.near_duplicates(table(spark, rows))
    assert found(got) == brute(rows)


def test_longer_lists_in_later_waves(spark, monkeypatch):
    monkeypatch.setattr(nn, "WAVES", 2)
    monkeypatch.setattr(nn, "RECALL", 1.1)
    lists, real = [], nn._refined

    def refined(graph, nodes, size, orders, k, threshold):
        lists.append((k, orders))
        return real(graph, nodes, size, orders, k, threshold)

    monkeypatch.setattr(nn, "_refined", refined)
    rows = mixed(8, noise=60)
    assert found(nn.near_duplicates(table(spark, rows))) == brute(rows)
    assert [k for k, _ in lists] == [10, 20] and not {*lists[0][1]} & {*lists[1][1]}


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1)]
    rows += [(6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [], 1), (10, [1.0, 0.0], 2)]
    rows += [(None, [1.0, 0.02], 1), (None, [5.0, 5.0], 2), (None, None, None), (2, [1.0, 0.01], 1)]
    rows += [(11, [1.0, 0.0, 0.0], 1), (12, [3.0, 0.1, 0.0], 1), (13, [-1.0, 0.0], 1), (14, [-0.0, 1.0], 1), (15, [0.0, 2.0], 1)]
    rows += [(16, [3e38, 3e38], 3), (17, [1e-38, 1e-38], 3)]
    want = brute(rows)
    want = [(a, b, c, a == c) for a, b, c, _ in want]
    assert found(nn.near_duplicates(table(spark, rows))) == want
    empty = spark.createDataFrame([], SCHEMA)
    assert nn.near_duplicates(empty).collect() == []
    alone = found(nn.near_duplicates(table(spark, [(1, None, 1), (None, [1.0], None)])))
    assert alone == sorted([(1, 0, 1, True), (None, 0, None, True)], key=repr)


def test_recall_of_far_pairs_without_audit(spark, monkeypatch):
    """Pairs right above the threshold in noise, one wave only."""
    random = np.random.default_rng(11)
    rows = []
    for i in range(1500):
        x = random.standard_normal(64)
        x /= np.linalg.norm(x)
        y = random.standard_normal(64)
        y -= (x @ y) * x
        y /= np.linalg.norm(y)
        rows.append((2 * i, x.tolist(), 0))
        if i % 5 == 0:
            rows.append((2 * i + 1, (0.935 * x + np.sqrt(1 - 0.935**2) * y).tolist(), 0))
    monkeypatch.setattr(nn, "WAVES", 1)
    monkeypatch.setattr(nn, "RECALL", 0.0)
    got = found(nn.near_duplicates(table(spark, rows)))
    want = brute(rows)
    links = sum(r[1] for r in want)
    assert links >= 600 and sum(r[1] for r in got) >= 0.98 * links


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_registered_query_and_its_sql(spark, folder):
    where = f"/root/testdata/{folder}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{where}/embeddings.parquet'")
    want = con.execute(ORACLE_SQL["op13_nn_descent"]).fetchall()
    assert found(QUERIES["op13_nn_descent"](spark, where)) == sorted(want, key=repr)


def test_sql_on_groups():
    rows = [r for r in mixed(9, noise=50)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    assert sorted(con.execute(ORACLE_SQL["op13_nn_descent"]).fetchall(), key=repr) == brute(rows)
