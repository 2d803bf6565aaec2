import numpy as np
import pytest
from pyspark.sql import functions as F

from dwitable.operators import mosaic as MO
from dwitable.operators import voxels as V


def image(spark, a, subject=1):
    rows = [(subject, *map(int, at), float(v)) for at, v in np.ndenumerate(a)]
    names = "t long, i int, j int, k int" if a.ndim == 4 else "i int, j int, k int"
    if a.ndim == 4:
        rows = [(s, t, i, j, k, v) for s, i, j, k, t, v in rows]
    return spark.createDataFrame(rows, f"subject int, {names}, value double")


def array(rows, names, shape):
    out = np.full(shape, np.nan)
    for r in rows:
        out[tuple(r[n] for n in names)] = r["value"]
    return out


def dims(spark, shape, nt=1):
    return spark.createDataFrame([(1, *shape, nt)], "subject int, ni int, nj int, nk int, nt int")


@pytest.mark.parametrize("shape, n", [((3, 4, 2), 7), ((4, 4, 1), 4), ((5, 2, 2), 6), ((2, 3, 1), 8)])
def test_padding_is_centred(spark, shape, n):
    a = np.random.default_rng(1).normal(size=shape)
    got = V.padded(image(spark, a), dims(spark, shape), F.lit(n), {"k": V.upto("nk")}).collect()
    left = [(n - s) // 2 for s in shape[:2]]
    want = np.zeros((n, n, shape[2]))
    want[left[0]:left[0] + shape[0], left[1]:left[1] + shape[1]] = a
    np.testing.assert_array_equal(array(got, "ijk", want.shape), want)
    assert len(got) == want.size


@pytest.mark.parametrize("nk", [1, 2, 3, 5, 9, 10])
def test_mosaic_and_its_inverse(spark, nk):
    a = np.random.default_rng(2).normal(size=(3, 3, nk))
    d = dims(spark, a.shape)
    layout = MO.mosaic_layout(d, F.lit(3), F.col("nk"))
    side = layout.first()
    assert side.N == int(np.ceil(np.sqrt(nk))) and side.M == int(np.ceil(nk / side.N))
    pixels = MO.stack_mosaic(image(spark, a), d)[1].withColumn("tile", MO.pixel_tile("row", "col", F.lit(3), F.lit(side.M)))
    back = pixels.filter("tile < %d" % nk).select((F.col("row") % 3).alias("i"), (F.col("col") % 3).alias("j"), F.col("tile").alias("k"), "value")
    np.testing.assert_array_equal(array(back.collect(), "ijk", a.shape), a)
    assert pixels.count() == side.N * side.M * 9
    assert pixels.filter("isnan(value)").count() == (side.N * side.M - nk) * 9


@pytest.mark.parametrize("direction, axis", [("ax", 0), ("cor", 1), ("sag", 2)])
def test_middle_slice_is_square(spark, direction, axis):
    a = np.random.default_rng(3).normal(size=(4, 5, 3, 2))
    got = MO.middle_slices(image(spark, a), dims(spark, a.shape[:3], 2), (direction,)).collect()
    tile = np.take(a, a.shape[axis] // 2, axis=axis)
    n = max(tile.shape[:2])
    left = [(n - s) // 2 for s in tile.shape[:2]]
    want = np.zeros((n, n, 2))
    want[left[0]:left[0] + tile.shape[0], left[1]:left[1] + tile.shape[1]] = tile
    np.testing.assert_array_equal(array(got, "rct", want.shape), want)


def test_median_filter_over_cubes(spark):
    a = np.random.default_rng(4).normal(size=(9, 7, 5))
    present = np.random.default_rng(5).random(a.shape) < 0.6
    rows = [(1, *map(int, at), float(a[at])) for at in zip(*np.nonzero(present))]
    df = spark.createDataFrame(rows, "subject int, i int, j int, k int, value double")
    got = {(r.i, r.j, r.k): r.value for r in V.median_filter(df, 2, side=4).collect()}
    holed = np.where(present, a, np.nan)
    assert set(got) == set(zip(*map(lambda x: x.tolist(), np.nonzero(present))))
    for at, value in got.items():
        near = holed[tuple(slice(max(c - 2, 0), c + 3) for c in at)]
        assert value == pytest.approx(np.nanmedian(near), abs=1e-12)


def test_dilation(spark):
    a = (np.random.default_rng(6).random((6, 5, 4)) < 0.05).astype(float)
    got = {(r.i, r.j, r.k) for r in V.dilate(image(spark, a), dims(spark, a.shape)).collect()}
    want = {
        (i, j, k) for i in range(6) for j in range(5) for k in range(4)
        if a[max(i - 1, 0):i + 2, max(j - 1, 0):j + 2, max(k - 1, 0):k + 2].any()
    }
    assert got == want


def test_two_class_threshold(spark):
    rng = np.random.default_rng(8)
    a = np.concatenate([rng.normal(10, 2, 400), rng.normal(50, 5, 200)]).reshape(10, 10, 6)
    counts, edges = np.histogram(a, 256)
    centres = (edges[:-1] + edges[1:]) / 2
    best = max(
        range(255),
        key=lambda b: (0 if counts[:b + 1].sum() == 0 or counts[b + 1:].sum() == 0 else
                       counts[:b + 1].sum() * counts[b + 1:].sum() * (np.average(centres[:b + 1], weights=counts[:b + 1])
                                                                     - np.average(centres[b + 1:], weights=counts[b + 1:])) ** 2),
    )
    got = V.otsu_threshold(image(spark, a)).first().threshold
    assert got == pytest.approx(centres[best], rel=1e-9)
    mask = V.foreground_mask(image(spark, a)).agg(F.sum("value")).first()[0]
    assert 150 < mask < 250


def test_flat_image_has_no_foreground(spark):
    assert V.foreground_mask(image(spark, np.full((2, 2, 2), 3.0))).agg(F.sum("value")).first()[0] == 0


@pytest.mark.parametrize("matrix, axes, signs", [
    (np.diag([2, 2, 3]), (0, 1, 2), (1, 1, 1)),
    (np.diag([-2, 2, 3]), (0, 1, 2), (-1, 1, 1)),
    ([[0, 2, 0], [-2, 0, 0], [0, 0, 3]], (1, 0, 2), (-1, 1, 1)),
    ([[0, 0, 1], [1, 0, 0], [0, -1, 0]], (1, 2, 0), (1, -1, 1)),
    ([[1.9, 0.2, 0.1], [-0.3, 1.8, 0.2], [0.1, -0.1, -2.5]], (0, 1, 2), (1, 1, -1)),
])
def test_orientation(spark, matrix, axes, signs):
    flat = {f"a{r}{c}": float(np.asarray(matrix)[r][c]) if r < 3 and c < 3 else float(r == c) for r in range(4) for c in range(4)}
    got = V.orientation(spark.createDataFrame([{"subject": 1, **flat}])).first()
    assert (got.w0, got.w1, got.w2) == axes
    assert (got.s0, got.s1, got.s2) == signs


def test_reorientation_of_an_array(spark):
    a = np.random.default_rng(9).normal(size=(2, 3, 4))
    matrix = [[0, 2, 0, 0], [-2, 0, 0, 0], [0, 0, 3, 0], [0, 0, 0, 1]]
    flat = {f"a{r}{c}": float(matrix[r][c]) for r in range(4) for c in range(4)}
    got = V.reorient(image(spark, a), spark.createDataFrame([{"subject": 1, **flat}]), dims(spark, a.shape).drop("nt"))
    ras = np.swapaxes(a, 0, 1)[:, ::-1, :]
    want = np.swapaxes(ras, 0, 2)[::-1, ::-1, ::-1]
    np.testing.assert_array_equal(array(got.collect(), "ijk", want.shape), want)


def test_nearest_colour_is_the_closest_entry(spark):
    rng = np.random.default_rng(10)
    entries = rng.integers(0, 256, size=(300, 3))
    entries[200] = entries[5]
    colours = rng.integers(0, 256, size=(400, 3))
    cmap = spark.createDataFrame([(n, *map(int, c)) for n, c in enumerate(entries)], "idx int, r int, g int, b int")
    wanted = spark.createDataFrame([(n, *map(int, c)) for n, c in enumerate(colours)], "n int, r int, g int, b int")
    got = {r.n: (r.idx, r.mapped) for r in V.nearest_entry(wanted, cmap, -3.0, 5.0).collect()}
    for n, c in enumerate(colours):
        idx = int(np.argmin(((entries - c) ** 2).sum(axis=1)))
        assert got[n][0] == idx
        assert got[n][1] == pytest.approx(idx * 8.0 / 299 - 3)


def test_grey_scale_ignores_nan(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, float("nan")), (2, 5.0)], "subject int, value double")
    got = sorted((r.subject, str(r.grey)) for r in V.grey_scale(df).collect())
    assert got == [(1, "0.0"), (1, "255.0"), (1, "nan"), (2, "None")]


def test_regrid_outside_is_zero(spark):
    source = spark.createDataFrame([(1, 0, 0, 0, 5), (1, 1, 0, 0, 6)], "subject int, i int, j int, k int, label int")
    grid = spark.createDataFrame([(1, 4, 1, 1)], "subject int, ni int, nj int, nk int")
    shift = {f"a{r}{c}": float(r == c) for r in range(4) for c in range(4)} | {"a03": -1.0}
    got = V.regrid_nearest(source, grid, spark.createDataFrame([{"subject": 1, **shift}])).orderBy("i").collect()
    assert [r.label for r in got] == [0, 5, 6, 0]


def test_concatenation_of_nothing_and_one(spark):
    a = image(spark, np.ones((1, 1, 1, 3)))
    both = V.concatenate(a, a)
    assert sorted(r.t for r in both.collect()) == [0, 1, 2, 3, 4, 5]
    assert sorted(r.t for r in V.concatenate(a.filter("false"), a).collect()) == [0, 1, 2]


def test_default_affine(spark):
    m = V.default_affine(2.0, (10, 20, 30))
    got = spark.range(1).select(*[c.alias(f"a{r}{n}") for r, row in enumerate(m) for n, c in enumerate(row)]).first()
    assert (got.a00, got.a03, got.a13, got.a23, got.a33, got.a01) == (2.0, -10.0, -20.0, -30.0, 1.0, 0.0)


def test_plane_rejects_unknown_kind(spark):
    with pytest.raises(KeyError):
        V.plane(image(spark, np.ones((1, 1, 1))), dims(spark, (1, 1, 1)), "oblique", 0)


def test_a_frame_smaller_than_the_image_raises(spark):
    a = np.ones((6, 3, 2))
    with pytest.raises(Exception, match="smaller than the image"):
        V.padded(image(spark, a), dims(spark, a.shape), F.lit(4), {"k": V.upto("nk")}).collect()


def test_regrid_equals_a_lookup_voxel_by_voxel(spark):
    rnd = np.random.default_rng(6)
    source, mats, dims = {}, {}, {}
    for s in range(6):
        source[s] = {tuple(map(int, p)): int(rnd.integers(1, 9)) for p in rnd.integers(0, 30, (4000, 3))}
        turn, _ = np.linalg.qr(rnd.normal(size=(3, 3)))
        mats[s] = np.column_stack([turn * rnd.uniform(0.5, 1.6) if s else np.eye(3), rnd.uniform(-9, 20, 3) if s else np.full(3, 0.5)])
        dims[s] = rnd.integers(1, 23, 3)
    rows = [(s, *p, v) for s, found in source.items() for p, v in found.items()]
    df = spark.createDataFrame(rows, "subject int, i int, j int, k int, label int")
    grid = spark.createDataFrame([(s, *map(int, d)) for s, d in dims.items()] + [(99, 3, 2, 1)], "subject int, ni int, nj int, nk int")
    affines = spark.createDataFrame([(s, *map(float, m.reshape(-1))) for s, m in mats.items()] + [(99, *([1.0] * 12))],
                                    "subject int, " + ", ".join(f"a{r}{c} double" for r in range(3) for c in range(4)))
    affines = affines.withColumns({"a30": F.lit(0.0), "a31": F.lit(0.0), "a32": F.lit(0.0), "a33": F.lit(1.0)})
    want = {}
    for s, d in dims.items():
        for p in np.ndindex(*d):
            x = [np.floor(m[0] * p[0] + m[1] * p[1] + m[2] * p[2] + m[3] + 0.5) for m in mats[s]]
            want[(s, *p)] = source[s].get(tuple(int(v) for v in x), 0)
    want |= {(99, *p): 0 for p in np.ndindex(3, 2, 1)}
    for side in (16, 5):
        got = V.regrid_nearest(df, grid, affines, side).collect()
        assert len(got) == len(want) and {tuple(r)[:4]: r["label"] for r in got} == want


def test_regrid_sends_one_copy_and_rims(spark):
    n = 48
    df = spark.range(n**3).select(F.lit(1).alias("subject"), *[F.expr(e).cast("int").alias(a) for a, e in
                                  (("i", f"id div {n * n}"), ("j", f"id div {n} % {n}"), ("k", f"id % {n}"))], F.lit(1).alias("label"))
    grid = spark.createDataFrame([(1, n, n, n)], "subject int, ni int, nj int, nk int")
    affine = spark.createDataFrame([(1, *np.column_stack([np.eye(3), [0.3, -0.2, 0.1]]).reshape(-1).tolist())],
                                   "subject int, " + ", ".join(f"a{r}{c} double" for r in range(3) for c in range(4)))
    cubes = V.target_cubes(df, grid, affine)
    assert cubes.count() == 27
    assert V.sent_voxels(df, cubes).count() < (18 / 16) ** 3 * n**3
    plan = V.regrid_nearest(df, grid, affine)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [subject" in plan and not any("SortMergeJoin" in x and "bi#" in x for x in plan.splitlines())
