import numpy as np
import pytest
from pyspark.sql import functions as F

from dwitable.functions import maths as M
from dwitable.operators import motion as MT
from dwitable.operators import tensor as T
from dwitable.operators import volumes as V


def matrices(spark, rows):
    names = [f"a{r}{c}" for r in range(3) for c in range(4)]
    return spark.createDataFrame([(1, n, *map(float, np.asarray(m)[:3].ravel())) for n, m in enumerate(rows)], ["subject", "vol", *names])


def rotation(rx, ry, rz):
    """Matrix of the angles, as products of three plane rotations."""
    cx, sx, cy, sy, cz, sz = np.cos(rx), np.sin(rx), np.cos(ry), np.sin(ry), np.cos(rz), np.sin(rz)
    x = np.array([[1, 0, 0], [0, cx, sx], [0, -sx, cx]])
    y = np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]])
    z = np.array([[cz, sz, 0], [-sz, cz, 0], [0, 0, 1]])
    return np.column_stack([x @ y @ z, [1.0, 2.0, 3.0]])


def test_angles_round_trip(spark):
    rng = np.random.default_rng(0)
    angles = np.column_stack([rng.uniform(-3, 3, 40), rng.uniform(-1.5, 1.5, 40), rng.uniform(-3, 3, 40)])
    got = MT.motion_parameters(matrices(spark, [rotation(*a) for a in angles])).orderBy("vol").collect()
    np.testing.assert_allclose([[r.rx, r.ry, r.rz] for r in got], angles, atol=1e-9)
    assert (got[0].tx, got[0].ty, got[0].tz) == (1.0, 2.0, 3.0)


def test_gimbal_lock_gives_the_turn_to_one_angle(spark):
    r = MT.motion_parameters(matrices(spark, [rotation(0.3, np.pi / 2, 0.4)])).first()
    assert r.rx == 0.0 and r.rz == pytest.approx(0.7, abs=1e-6)


def test_artifact_flags(spark):
    rows = [(1, v, *([0.0] * 6)) for v in range(20)]
    rows[7] = (1, 7, 0.0, 0.0, 0.0, 4.0, 0.0, 0.0)
    moves = spark.createDataFrame(rows, "subject int, vol long, rx double, ry double, rz double, tx double, ty double, tz double")
    bright = moves.select("subject", "vol", F.when(F.col("vol") == 3, 100.0).otherwise(1.0).alias("intensity"))
    got = {r.vol: (r.motion_flag, r.intensity_flag) for r in MT.artifact_flags(moves, bright, intensity_threshold=4).collect()}
    assert [v for v, f in got.items() if f[0]] in ([7, 8], [8, 7])
    assert [v for v, f in got.items() if f[1]] == [3]


def test_vectors_are_rows_times_the_matrix(spark):
    m = np.array([[1, 2, 3, 9], [4, 5, 6, 9], [7, 8, 10, 9], [0.5, 0.25, 0.125, 1]])
    affine = spark.createDataFrame([(1, *map(float, m.ravel()))], ["subject", *[f"a{r}{c}" for r in range(4) for c in range(4)]])
    vols = spark.createDataFrame([(1, 0, 0.1, 0.2, 0.3)], "subject int, vol long, gx double, gy double, gz double")
    r = V.transform_vectors(vols, affine).first()
    np.testing.assert_allclose([r.gx, r.gy, r.gz], (np.array([0.1, 0.2, 0.3, 1]) @ m)[:3])


def test_matrix_product(spark):
    a, b = [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], [[1.0, 0.5, 2.0], [0.25, 1.0, -1.0]]
    got = spark.createDataFrame([(a, b)], "a array<array<double>>, b array<array<double>>").select(M.matmul("a", "b").alias("p")).first().p
    np.testing.assert_allclose(got, np.array(a) @ np.array(b))


def test_nearest_square(spark):
    got = spark.range(0, 200).select("id", M.nearest_square("id").alias("n")).collect()
    for r in got:
        assert r.n ** 2 >= r.id and (r.n == 0 or (r.n - 1) ** 2 < r.id)


def random_tensors(rng, n):
    out = []
    for _ in range(n):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        out.append(q @ np.diag(rng.uniform(1e-4, 2e-3, 3)) @ q.T)
    return out


def tensor_rows(spark, tensors):
    rows = [(1, n, 0.0, *map(float, (d[0, 0], d[1, 1], d[2, 2], d[0, 1], d[0, 2], d[1, 2]))) for n, d in enumerate(tensors)]
    return spark.createDataFrame(rows, ["subject", "voxel", "ln_s0", *T.ENTRIES])


def test_eigenvalues_and_colours(spark):
    tensors = random_tensors(np.random.default_rng(1), 50) + [np.eye(3) * 1e-3, np.diag([3e-3, 1e-3, 1e-3]), np.zeros((3, 3))]
    got = T.colour_fa(T.tensor_scalars(tensor_rows(spark, tensors))).orderBy("voxel").collect()
    for r, d in zip(got, tensors):
        w, v = np.linalg.eigh(d)
        np.testing.assert_allclose([r.e3, r.e2, r.e1], w, atol=1e-11)
        fa = np.sqrt(1.5 * ((w - w.mean()) ** 2).sum() / (w**2).sum()) if w.any() else 0.0
        assert r.fa == pytest.approx(fa, abs=1e-6)
        assert (r.md, r.ad, r.rd) == pytest.approx((w.mean(), w[2], (w[0] + w[1]) / 2), abs=1e-11)
        if fa > 0.01:
            np.testing.assert_allclose([r.r, r.g, r.b], np.abs(v[:, 2]) * fa, atol=1e-6)


def test_negative_eigenvalues_count_as_zero(spark):
    r = T.tensor_scalars(tensor_rows(spark, [np.diag([1e-3, 1e-3, -1e-4])])).first()
    assert r.e3 == 0.0 and r.md == pytest.approx(2e-3 / 3)


def gradients(rng, n):
    g = rng.normal(size=(n, 3))
    g /= np.linalg.norm(g, axis=1)[:, None]
    b = np.where(np.arange(n) % 6 == 0, 0.0, 1000.0)
    return b, g * (b > 0)[:, None]


def test_fit_matches_least_squares(spark):
    rng = np.random.default_rng(2)
    b, g = gradients(rng, 40)
    volumes = spark.createDataFrame([(1, n, float(b[n]), *map(float, g[n])) for n in range(40)], "subject int, vol long, bval double, gx double, gy double, gz double")
    design = np.column_stack([np.ones(40), -b * g[:, 0]**2, -b * g[:, 1]**2, -b * g[:, 2]**2, -2*b*g[:, 0]*g[:, 1], -2*b*g[:, 0]*g[:, 2], -2*b*g[:, 1]*g[:, 2]])
    rows, want = [], {}
    for voxel, d in enumerate(random_tensors(rng, 6)):
        signal = 800 * np.exp(-b * np.einsum("ni,ij,nj->n", g, d, g)) * rng.uniform(0.95, 1.05, 40)
        used = np.arange(40) if voxel else np.arange(0, 40, 2)
        rows += [(1, voxel, int(n), float(signal[n])) for n in used]
        x, y = design[used], np.log(signal[used])
        plain = np.linalg.lstsq(x, y, rcond=None)[0]
        w = np.exp(x @ plain)
        want[False, voxel] = plain
        want[True, voxel] = np.linalg.lstsq(x * w[:, None], y * w, rcond=None)[0]
    measured = spark.createDataFrame(rows, "subject int, voxel int, vol long, signal double")
    for weighted in (False, True):
        for clustered in (False, True):
            got = T.fit_tensor(measured, volumes, weighted, clustered).collect()
            assert len(got) == 6
            for r in got:
                np.testing.assert_allclose([r.ln_s0], want[weighted, r.voxel][:1], atol=1e-9)
                np.testing.assert_allclose([r[e] for e in T.ENTRIES], want[weighted, r.voxel][1:], atol=1e-11)


def test_signals_in_arrays(spark):
    voxels = spark.createDataFrame([(1, 7, [3.0, 2.0])], "subject int, voxel int, signal array<double>")
    assert sorted(map(tuple, T.from_arrays(voxels).collect())) == [(1, 7, 0, 3.0), (1, 7, 1, 2.0)]


def test_too_few_volumes_give_the_smallest_solution(spark):
    volumes = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 0.0), (1, 1, 1000.0, 1.0, 0.0, 0.0)], "subject int, vol long, bval double, gx double, gy double, gz double")
    signal = spark.createDataFrame([(1, 0, 0, 100.0), (1, 0, 1, 50.0), (1, 1, 0, 100.0), (1, 1, 1, 0.0)], "subject int, voxel int, vol long, signal double")
    got = {r.voxel: r for r in T.fit_tensor(signal, volumes).collect()}
    assert got[0].dxx == pytest.approx(np.log(2) / 1000) and got[0].dyy == pytest.approx(0.0) and got[0].ln_s0 == pytest.approx(np.log(100))
    assert got[1].dxx == pytest.approx((np.log(100) - np.log(T.MIN_SIGNAL)) / 1000)


def test_movement_is_measured_from_the_volume_before_that_is_there(spark):
    rows = [(1, v, float(v * v), *[0.0] * 5) for v in (0, 2, 3, 9)] + [(2, 5, 1.0, *[0.0] * 5)]
    names = ", ".join(f"{p} double" for p in MT.PARAMETERS)
    got = MT.frame_differences(spark.createDataFrame(rows, f"subject int, vol long, {names}")).collect()
    assert {(r.subject, r.vol): r.norm for r in got} == {(1, 0): 0.0, (1, 2): 4.0, (1, 3): 5.0, (1, 9): 72.0, (2, 5): 0.0}


def test_arrays_are_fitted_where_they_lie(spark, tmp_path):
    rng = np.random.default_rng(2)
    g = rng.standard_normal((30, 3))
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    b = np.where(np.arange(30) % 6 == 0, 0.0, 1000.0)
    d = np.array([[1.2, 0.1, 0.05], [0.1, 0.7, -0.02], [0.05, -0.02, 0.4]]) * 1e-3
    signal = 800 * np.exp(-b * np.einsum("ni,ij,nj->n", g, d, g))
    table = spark.createDataFrame([(1, n, float(b[n]), *map(float, g[n])) for n in range(30)],
                                  "subject int, vol long, bval double, gx double, gy double, gz double")
    part = [None if n % 4 == 1 else float(x) for n, x in enumerate(signal)]
    rows = [(1, 0, [float(x) for x in signal]), (1, 1, part), (1, 2, [*map(float, signal), 5.0])]
    spark.createDataFrame(rows, "subject int, voxel long, signal array<double>").write.parquet(str(tmp_path / "v"))
    fitted = T.fit_arrays(spark.read.parquet(str(tmp_path / "v")), table)
    assert "Exchange hash" not in fitted._jdf.queryExecution().executedPlan().toString()
    want = [d[0, 0], d[1, 1], d[2, 2], d[0, 1], d[0, 2], d[1, 2]]
    for r in fitted.collect():
        assert [getattr(r, e) for e in T.ENTRIES] == pytest.approx(want, rel=1e-6)
        assert r.ln_s0 == pytest.approx(np.log(800), rel=1e-9)
    raised = T.fit_arrays(spark.createDataFrame([(1, 0, [1e-9] * 30)], "subject int, voxel long, signal array<double>"), table, min_signal=2.0)
    assert raised.first().ln_s0 == pytest.approx(np.log(2.0))
