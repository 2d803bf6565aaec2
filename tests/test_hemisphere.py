import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwitable.operators import hemisphere as H


def table(spark, groups):
    rows = [(int(g), float(x), float(y), float(z)) for g, v in groups.items() for x, y, z in v]
    return spark.createDataFrame(rows, "label int, x double, y double, z double")


def solve(spark, groups, **options):
    got = H.hemispheres(table(spark, groups), **options).collect()
    return {r.label: (r.is_hemi, None if r.px is None else np.array([r.px, r.py, r.pz])) for r in got}


def unit(v):
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def every_pair(v):
    """The definition, over all ordered pairs."""
    corners = []
    for a, b in itertools.permutations(v, 2):
        c = np.cross(a, b)
        if np.linalg.norm(c) > 0:
            c = c / np.linalg.norm(c)
            if (v @ c).min() >= -1e-12:
                corners.append(c)
    if not corners:
        return False, np.zeros(3)
    mean = np.mean(corners, axis=0)
    length = np.linalg.norm(mean)
    return True, mean / length if length > 1e-9 else None


def hemisphere_points(rng, n):
    v = unit(rng.normal(size=(n, 3)))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    v[:, 2] = np.abs(v[:, 2])
    return v @ q.T


@pytest.mark.parametrize("options", [{}, {"chunk": 9}])
def test_same_as_all_pairs(spark, options):
    rng = np.random.default_rng(7)
    groups = {n: hemisphere_points(rng, 30 + n) for n in range(6)}
    groups |= {10 + n: unit(rng.normal(size=(25, 3))) for n in range(4)}
    groups |= {20 + n: unit(np.abs(rng.normal(size=(3 + n, 3)))) for n in range(5)}
    repeated = hemisphere_points(rng, 12)
    groups[30] = np.vstack([repeated, repeated[:5], repeated[:2]])
    got = solve(spark, groups, **options)
    for g, v in groups.items():
        is_hemi, pole = every_pair(v)
        assert got[g][0] == is_hemi, g
        np.testing.assert_allclose(got[g][1], pole, atol=1e-9)


def test_borders(spark):
    x, y, z = np.eye(3)
    s = np.sqrt(0.5)
    groups = {
        1: [x, y, z],
        2: [x, -x, y],
        3: [x, -x, y, -y, z],
        4: [x, -x],
        5: [x, -x, y, -y, z, -z],
        6: [x, y],
        7: [z, s * x + s * z, s * y + s * z, -s * x + s * z, -s * y + s * z],
        8: [x, s * x + s * y, y, z],
    }
    got = solve(spark, groups)
    for g, v in groups.items():
        is_hemi, pole = every_pair(np.array(v))
        assert got[g][0] == is_hemi, g
        if pole is None:
            assert got[g][1] is None, g
        else:
            np.testing.assert_allclose(got[g][1], pole, atol=1e-9)
    assert got[4][0] is False and got[5][0] is False


def test_single_vector_has_no_corner(spark):
    assert solve(spark, {1: [[0.0, 0.0, 1.0]]})[1][0] is False


def test_large_group_keeps_few_rows(spark):
    rng = np.random.default_rng(3)
    v = hemisphere_points(rng, 20_000)
    got = solve(spark, {1: v, 2: unit(rng.normal(size=(20_000, 3)))}, chunk=500)
    assert got[1][0] and (v @ got[1][1]).min() >= -1e-12
    assert not got[2][0]


def test_pole_check_and_unit_check(spark):
    vecs = table(spark, {1: [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]], 2: [[0.0, 0.0, 2.0]]})
    assert [r.label for r in H.non_unit_groups(vecs).collect()] == [2]
    poles = vecs.groupBy("label").agg(F.lit(0.0).alias("px"), F.lit(0.0).alias("py"), F.lit(1.0).alias("pz"))
    got = {r.label: (r.min_dot, r.contains_all) for r in H.farthest_from_pole(vecs, poles).collect()}
    assert got == {1: (0.0, True), 2: (2.0, True)}


@pytest.mark.parametrize("shape", ["arc", "cone"])
def test_groups_whose_every_vector_is_on_the_border(spark, shape):
    turn = np.linspace(0.1, 3.0, 20_000) if shape == "arc" else np.linspace(0, 2 * np.pi, 20_000, endpoint=False)
    tilt = 0.6 if shape == "cone" else 0.4
    v = unit(np.column_stack([np.cos(turn), np.sin(turn), np.full(turn.size, tilt)]))
    few = v[::500]
    got = solve(spark, {1: v, 2: few})
    assert got[1][0] and got[2][0]
    is_hemi, pole = every_pair(few)
    assert is_hemi
    np.testing.assert_allclose(got[2][1], pole, atol=1e-9)
    assert (v @ got[1][1]).min() >= -1e-9
    if shape == "cone":
        np.testing.assert_allclose(got[1][1], [0, 0, 1], atol=1e-6)
