import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def write(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).withColumn("v", F.lit(1)).withColumn("tile", F.lit("x")).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def odd_rows():
    nan, inf = float("nan"), float("inf")
    return [(9001, None, 1), (9002, [nan] * 8, 1), (9003, [inf] + [0.0] * 7, 1), (9004, [0.0] * 8, 1), (9050, [None] + [0.5] * 7, 1), (9006, [], 1), (None, [0.5] * 8, 1), (9007, [0.5, 0.5], 1)]


def test_top_k_as_brute_force(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.integers(-3, 4, 8) / 4).tolist(), 0) for i in range(300)]
    rows += [(300, rows[3][1], 0), (301, rows[3][1], 0), (7, rows[7][1], 0), *odd_rows()]
    got = vectors.op4_topk(spark, write(spark, tmp_path, rows)).collect()
    ok = {i: np.floor(256 * np.array(v, float)).astype(int) for i, v, _ in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all()}
    want = []
    for q in ok:
        if q % 50 == 0:
            best = sorted((-int(ok[q] @ ok[i]), i) for i in ok if i != q)[:5]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_with_many_tiles_and_few_rows(spark):
    rows = [(i, [i % 7, i % 5]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, v array<bigint>")
    one = sorted(map(tuple, vectors.top_k(df, df, 3).collect()))
    assert one == sorted(map(tuple, vectors.top_k(df, df, 3, query_rows=30, shard_rows=6).collect()))
    few = df.where("vec_id < 3")
    assert vectors.top_k(few, few, 5).count() == 6
    big = spark.createDataFrame([(1, [2**40]), (2, [2**20])], "vec_id long, v array<bigint>")
    assert {r.score for r in vectors.top_k(big, big, 5).collect()} == {2**60}


def clusters(seed, d=64):
    rng = np.random.default_rng(seed)
    x = []
    for _ in range(40):
        base = rng.standard_normal(d)
        x += [base + rng.standard_normal(d) * s * np.linalg.norm(base) / np.sqrt(d) for s in rng.uniform(0, 0.35, 12)]
    return np.array(x, np.float32)


def brute(x, threshold=0.95):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    c = u @ u.T >= threshold
    np.fill_diagonal(c, False)
    root = np.arange(len(x))
    while True:
        new = np.array([min([root[i], *root[c[i]]]) for i in range(len(x))])
        if (new == root).all():
            return c.sum(axis=1), root
        root = new


def test_near_vectors_as_brute_force(spark, tmp_path):
    x = clusters(1)
    x = np.concatenate([x, x[:1].repeat(30, axis=0), x[5:6] * 3])
    rows = [(int(i), v.tolist(), int(i % 3)) for i, v in enumerate(x)] + odd_rows()
    got = vectors.op5_embedding_dedup(spark, write(spark, tmp_path, rows)).collect()
    assert len(got) == len(rows)
    n, root = brute(x)
    mine = {r.vec_id: r for r in got if r.vec_id is not None and r.vec_id < 9000}
    links = sum(r.n_links for r in mine.values())
    assert links <= n.sum() and links >= 0.98 * n.sum()
    assert all(r.n_links <= n[i] for i, r in mine.items())
    assert np.mean([r.component_id == root[i] for i, r in mine.items()]) > 0.98
    assert all(r.kept == (r.vec_id == r.component_id) for r in mine.values())
    for r in got:
        if r.vec_id is None or r.vec_id >= 9000:
            assert r.n_links == 0 and r.component_id == r.vec_id and r.kept == (r.vec_id is not None)


def test_large_buckets_are_cut_without_loss(spark):
    x = np.float32(1) + np.random.default_rng(2).standard_normal((300, 16)).astype(np.float32) * np.float32(0.05)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(df, tile_rows=40).collect()}
    n, _ = brute(x)
    assert sum(got.values()) >= 0.99 * n.sum() and all(got[i] <= n[i] for i in got)


@pytest.mark.parametrize("d", [3, 16, 64, 100])
def test_codes_estimate_without_bias_and_bound(d):
    rng = np.random.default_rng(3)
    u = rng.standard_normal((400, d))
    u[200:] = u[:200] + rng.standard_normal((200, d)) * 0.2  # so that high products occur
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    codes = vectors.Codes.read(d, vectors.Codes.of(u).stored())
    error = codes.estimates(slice(None)) - u @ u.T
    assert abs(error.mean()) < 0.01
    for t in (0.0, 0.9):
        some = u @ u.T >= t
        assert (np.abs(error) > 3 * codes.deviation(slice(None), t))[some].mean() < 0.01
    near = u @ u.T >= 0.95
    assert codes.possible(0.95, slice(None))[near].mean() > 0.999


def test_codes_reject_what_is_far():
    u = np.random.default_rng(4).standard_normal((500, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    assert vectors.Codes.of(u).possible(0.95, slice(None)).mean() < 0.003  # little besides each with itself


@pytest.mark.parametrize("n", [0, 100, 10**5, 10**9])
def test_plan_reaches_its_recall(n):
    bits, tables = vectors.table_plan(n, 0.95)
    same = (1 - np.arccos(0.95) / np.pi) ** bits
    assert 1 - (1 - same) ** tables >= 0.995


def test_empty_table(spark, tmp_path):
    path = write(spark, tmp_path, [])
    assert vectors.op4_topk(spark, path).collect() == []
    assert vectors.op5_embedding_dedup(spark, path).collect() == []


def test_every_row_is_a_candidate_and_order_changes_nothing(spark):
    """A repeated row counts as often as it occurs; a repeated query id asks with its least vector; only equal lengths meet."""
    rows = [(0, [1, 2]), (0, [2, 1]), (1, [3, 3]), (1, [3, 3]), (2, [1, 0]), (3, [5, 5, 5]), (4, [1, 1, 1]), (1, [0, 1])]
    for by in (rows, rows[::-1]):
        df = spark.createDataFrame(by, "vec_id long, v array<bigint>").repartition(3)
        got = sorted(map(tuple, vectors.top_k(df.where("vec_id IN (0, 3)"), df, 4).collect()))
        assert got == [(0, 1, 1, 9), (0, 2, 1, 9), (0, 3, 1, 2), (0, 4, 2, 1), (3, 1, 4, 15)]


def test_sums_beyond_a_long_raise(spark):
    big = spark.createDataFrame([(1, [2**40, 2**40]), (2, [2**30, 2**30])], "vec_id long, v array<bigint>")
    with pytest.raises(Exception, match="fit a long"):
        vectors.top_k(big, big, 5).collect()
    close = spark.createDataFrame([(1, [2**31, -(2**31)]), (2, [2**32 - 1, 2**31])], "vec_id long, v array<bigint>")
    assert {r.score for r in vectors.top_k(close, close, 5).collect()} == {2**31 * (2**32 - 1) - 2**62}


def test_one_id_with_two_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.99, 0.01]), (3, [0.01, 0.99]), (0, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, vectors.near_vectors(df).collect()))
    assert got == [(0, 2, 0, True), (1, 1, 1, True), (1, 2, 0, False), (2, 1, 1, False), (3, 2, 0, False)]
