import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tallyforge.llm import common, embeddings


def brute(ids, x, least=0.95):
    unit = x / np.sqrt((x**2).sum(axis=1, keepdims=True))
    near = unit @ unit.T >= least
    np.fill_diagonal(near, False)
    low = np.arange(len(ids))
    while True:
        new = np.array([min(low[i], low[near[i]].min() if near[i].any() else low[i]) for i in range(len(ids))])
        if (new == low).all():
            return near.sum(axis=1), np.asarray(ids)[low]
        low = new


def test_query_equals_brute_force(spark, data):
    rows = sorted(embeddings.op9(spark, data).collect())
    table = sorted(spark.read.parquet(f"{data}/embeddings.parquet").collect())
    n, component = brute([r.vec_id for r in table], np.array([r.embedding for r in table], dtype=np.float64))
    assert [tuple(r) for r in rows] == [(r.vec_id, int(k), int(c), int(c) == r.vec_id) for r, k, c in zip(table, n, component)]


def test_recall_over_many_lists(spark):
    """Near copies around centres, with many lists and small tiles; no link below the bound."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(700, 32))
    x = np.concatenate([c + rng.normal(size=(int(k), 32)) * 0.18 for c, k in zip(centres, rng.integers(1, 12, 700))])
    x = np.concatenate((x, centres[0] + rng.normal(size=(900, 32)) * 0.15)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    old = embeddings.PER_LIST
    embeddings.PER_LIST = 64
    try:
        rows = sorted(embeddings.links(frame, tile=256).collect())
    finally:
        embeddings.PER_LIST = old
    n, _ = brute(list(range(len(x))), x.astype(np.float64))
    got = np.array([r.n_links for r in rows])
    assert (got <= n).all() and got.sum() >= 0.97 * n.sum()


def test_near_copies_cut_into_many_lists(spark, tmp_path):
    """A third of 40,000 vectors are near copies, so their links lie across dozens of lists."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40_000, 64))
    x[::3] = x[0] / np.linalg.norm(x[0]) + rng.normal(size=x[::3].shape) * 0.02
    x = x.astype(np.float32)
    vectors = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": vectors}), tmp_path / "x.parquet")
    got = embeddings.links(spark.read.parquet(str(tmp_path / "x.parquet"))).toPandas().sort_values("vec_id")
    unit = x.astype(np.float64)
    unit /= np.sqrt((unit**2).sum(axis=1, keepdims=True))
    n = np.concatenate([(unit[at : at + 2000] @ unit.T >= 0.95).sum(axis=1) - 1 for at in range(0, len(x), 2000)])
    assert n[::3].mean() > 10_000 and (got.n_links.to_numpy() == n).all()
    low = np.where(n[::3] > 0, 0, np.arange(0, len(x), 3))
    assert (got.component_id.to_numpy()[::3] == low).all()


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, None, 1), (4, [0.0, 0.0], 1), (5, [1.0, None], 1), (6, [nan, 1.0], 1),
            (7, [0.0, 1.0], 1), (None, [1.0, 0.0], 1), (8, [], 1), (9, [1.0], 1), (10, [1e300, 1e-300], 1), (11, [-1.0, 0.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component_id int")
    out = sorted(map(str, (tuple(r) for r in embeddings.links(frame).collect())))
    linked = [(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (9, 4, 1, False), (10, 4, 1, False)]
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 11)]
    assert out == sorted(map(str, [*linked, *alone, (None, 0, None, False)]))
    assert embeddings.links(frame.where("false")).count() == 0


def test_a_vector_at_the_bound(spark):
    """A cosine of 0.95 as double precision gives it links; the next double below does not."""
    at = 0.95
    rows = [(1, [1.0, 0.0]), (2, [at, (1 - at * at) ** 0.5]), (3, [at - 1e-9, -((1 - (at - 1e-9) ** 2) ** 0.5)])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = np.array([v for _, v in rows])
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    got = {r.vec_id: r.n_links for r in embeddings.links(frame).collect()}
    assert got[3] == 0 and got[2] == int(unit[0] @ unit[1] >= 0.95) == got[1]


def test_a_third_of_all_rows_in_one_class(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[::3] = x[0]
    rows = [(i, None if i % 30 == 1 else v.tolist()) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in embeddings.links(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert len(got) == 300 and all(got[i].n_links == 99 and got[i].component_id == 0 for i in range(0, 300, 3))
    assert all(got[i].n_links == 0 and got[i].kept for i in range(1, 300, 30))


def test_an_index_that_picked_nothing_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "SAMPLE", 0)
    monkeypatch.setattr(embeddings, "PER_CENTROID", 0)
    frame = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "vec_id long, embedding array<double>")
    with pytest.raises(RuntimeError, match="no vector was picked"):
        embeddings.links(frame)
