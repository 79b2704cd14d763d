"""Grid operators against plain NumPy on small random grids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import taxonomy as tx
from geoloom.operators import distance, grid
from geoloom.operators.components import grid_components, label_tile
from geoloom.operators.graph import connected_components
from geoloom.operators.rank import number_rows


def frame(spark, a, name="v"):
    r, c = np.indices(a.shape).reshape(2, -1)
    return spark.createDataFrame([(int(i), int(j), x) for i, j, x in zip(r, c, a.ravel().tolist())], f"r long, c long, {name} {'double' if a.dtype.kind == 'f' else 'boolean' if a.dtype.kind == 'b' else 'int'}")


def back(df, name, shape, dtype=float):
    out = np.zeros(shape, dtype)
    for r, c, v in df.select("r", "c", name).collect():
        out[r, c] = v
    return out


def flood(a, keyed):
    """Least row * 1000 + column of each 8-connected piece of equal keys; -1 off it."""
    out = np.full(a.shape, -1)
    for i, j in np.ndindex(a.shape):
        if keyed[i, j] and out[i, j] < 0:
            todo = [(i, j)]
            out[i, j] = i * 1000 + j
            while todo:
                y, x = todo.pop()
                for p in range(y - 1, y + 2):
                    for q in range(x - 1, x + 2):
                        if 0 <= p < a.shape[0] and 0 <= q < a.shape[1] and keyed[p, q] and out[p, q] < 0 and a[p, q] == a[i, j]:
                            out[p, q] = i * 1000 + j
                            todo.append((p, q))
    return out


@pytest.mark.parametrize("k", [3, 5, 7])
def test_box_mean_replicates_edges(spark, k):
    a = np.random.default_rng(k).integers(0, 50, (7, 9)).astype(float)
    p = np.pad(a, k // 2, mode="edge")
    want = np.array([[p[i : i + k, j : j + k].mean() for j in range(9)] for i in range(7)])
    assert np.allclose(back(grid.box_mean(frame(spark, a), "v", k, "m"), "m", a.shape), want)
    std = np.array([[p[i : i + k, j : j + k].std() for j in range(9)] for i in range(7)])
    assert np.allclose(back(grid.local_std(frame(spark, a), "v", k, "s"), "s", a.shape), std, atol=1e-6)


def test_even_window_is_refused(spark):
    with pytest.raises(AssertionError):
        grid.box_sum(frame(spark, np.zeros((2, 2))), "v", 4, "m")


@pytest.mark.parametrize("k", [2, 3, 4, 5])
def test_opening_is_idempotent_and_adds_nothing(spark, k):
    a = np.random.default_rng(k).random((12, 13)) < 0.7
    once = back(grid.opening(frame(spark, a), "v", k, "o"), "o", a.shape, bool)
    twice = back(grid.opening(frame(spark, once), "v", k, "o"), "o", a.shape, bool)
    assert (once <= a).all() and (once == twice).all()


def test_gradient_is_one_sided_at_edges(spark):
    a = np.random.default_rng(3).random((6, 5))
    gy, gx = np.gradient(a, 0.5)
    g = grid.gradient(frame(spark, a, "elev"), 0.5)
    assert np.allclose(back(g, "gy", a.shape), gy) and np.allclose(back(g, "gx", a.shape), gx)


@pytest.mark.parametrize("density", [0.0, 0.02, 0.3, 1.0])
def test_distance_is_exact(spark, density):
    a = np.random.default_rng(7).random((23, 37)) < density
    got = distance.nearest_d2(frame(spark, a), "v")
    seeds = np.argwhere(a)
    if not len(seeds):
        assert got.where("d2 is not null").count() == 0
        return
    want = [[min((seeds[:, 0] - i) ** 2 + (seeds[:, 1] - j) ** 2) for j in range(37)] for i in range(23)]
    assert (back(got, "d2", a.shape, int) == np.array(want)).all()


@pytest.mark.parametrize("tile", [4, 7, 512])
def test_components_dont_depend_on_tiles(spark, tile):
    rng = np.random.default_rng(tile)
    a, keyed = rng.integers(0, 3, (19, 23)), rng.random((19, 23)) < 0.9
    cells = frame(spark, a).join(frame(spark, keyed, "k"), ["r", "c"]).withColumn("key", F.when(F.col("k"), F.col("v")))
    got = np.full(a.shape, -1)
    for r, c, root in grid_components(cells, "key", 1000, tile).select("r", "c", "root").collect():
        got[r, c] = root
    assert (got == flood(a, keyed)).all()


def test_a_spiral_is_one_piece():
    a = np.zeros((31, 31), int)
    y, x, d = 0, 0, 0
    for n in [30, 30, 30, 28, 28, 26, 26, 24, 24, 22, 22, 20, 20]:
        for _ in range(n):
            a[y, x] = 1
            y, x = y + (0, 1, 0, -1)[d], x + (1, 0, -1, 0)[d]
        d = (d + 1) % 4
    r, c = np.nonzero(a)
    assert len(set(label_tile(r, c, np.ones(len(r), int), 1000).tolist())) == len(set(flood(a, a == 1)[a == 1].tolist()))


def test_star_components(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 11), (20, 21), (21, 22), (22, 20), (4, 50), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(pairs, "a long, b long")).distinct().collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 50: 1, 10: 10, 11: 10, 20: 20, 21: 20, 22: 20}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_number_rows_is_dense(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("x"), (F.col("id") % 3).alias("k"))
    got = number_rows(df, ["k", "x"], "n").orderBy("k", "x").select("n").collect()
    assert [r[0] for r in got] == list(range(1, 5001))


def test_transposing_changes_no_distance(spark):
    a = np.random.default_rng(1).random((11, 17)) < 0.1
    x = back(distance.nearest_d2(frame(spark, a), "v"), "d2", a.shape, int)
    y = back(distance.nearest_d2(frame(spark, a.T.copy()), "v"), "d2", a.T.shape, int)
    assert (x == y.T).all()


def test_taxonomy():
    assert len(tx.rows()) == 47 and [r[0] for r in tx.rows()] == list(range(47))
    d = lambda a, b: tx.class_distance(tx.class_id(a), tx.class_id(b))
    assert d("Batha", "Batha") == 0 and d("DryGrassland", "Maquis") == 0.75 and d("DirtRoadB", "DirtRoad") == 0.375
    assert d("LimestoneTerrace", "LimestoneBoulder") == 0.35 and d("LimestoneTerrace", "DolomiteTerrace") == 0.45 and d("LimestoneTerrace", "BasaltBoulder") == 0.7
    assert d("TerraRosa", "Rendzina") == 0.4 and d("House", "Water") == 1.0
    cat = lambda a, b: tx.change_category(tx.class_id(a), tx.class_id(b))
    assert cat("GreenGrassland", "DryGrassland") == "phenology" and cat("Batha", "Garigue") == "succession" and cat("Maquis", "DryGrassland") == "real-change"
    assert cat("LimestoneTerrace", "DolomiteTerrace") == "impossible" and cat("DirtRoad", "PavedRoad") == "infrastructure"
    assert cat("Batha", "House") == "construction" and cat("House", "Batha") == "demolition" and cat("Shadow", "Batha") == "noise"
    with pytest.raises(KeyError):
        tx.class_id("Greenhouse")
