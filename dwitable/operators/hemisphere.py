"""Whether the directions of a group lie in one hemisphere, and the hemisphere's central pole.

A hemisphere holds all vectors if some pole has a non-negative scalar product with each of them. The possible poles
form a spherical polygon whose corners are normals of the convex cone around the vectors, so only vectors on the
border of that cone matter. The border of a union is found among the borders of its parts: groups are cut into chunks,
each chunk keeps its border, and what is left is cut anew until a group fits one chunk. No pair of
vectors is ever formed across a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwitable.functions import maths as M
from dwitable.operators.indexing import paged
from dwitable.session import if_small, materialise

TOLERANCE = 1e-12
FLAT = 1e-9
CHUNK = 20_000
UNIT_RTOL, UNIT_ATOL = 1e-5, 1e-8


def non_unit_groups(vecs: DataFrame, group: str = "label") -> DataFrame:
    """Groups that hold a vector whose length is not 1."""
    off = F.abs(M.norm3(("x", "y", "z")) - 1) > UNIT_ATOL + UNIT_RTOL
    return vecs.groupBy(group).agg(F.count_if(off | F.isnull(off)).alias("n_bad")).filter("n_bad > 0")


def _closest_to_origin(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The point of the convex hull of ``v`` closest to the origin, and the rows that span it."""
    used = [int(np.argmin(np.einsum("ij,ij->i", v, v)))]
    weights = np.ones(1)
    point = v[used[0]]
    for _ in range(1000):
        dots = v @ point
        j = int(np.argmin(dots))
        if dots[j] >= point @ point - 1e-14 or j in used:
            break
        used, weights = used + [j], np.append(weights, 0.0)
        while True:
            s = v[used]
            system = np.ones((len(used) + 1, len(used) + 1))
            system[0, 0], system[1:, 1:] = 0.0, s @ s.T
            rhs = np.zeros(len(used) + 1)
            rhs[0] = 1.0
            target = np.linalg.lstsq(system, rhs, rcond=None)[0][1:]
            if target.min() >= -1e-13:
                weights = target
                break
            falling = target < weights
            step = np.min(weights[falling] / (weights - target)[falling])
            weights = weights + step * (target - weights)
            stay = weights > 1e-13
            used, weights = [u for u, k in zip(used, stay) if k], weights[stay]
        point = weights @ v[used]
    else:
        raise ArithmeticError("the point nearest to the origin was not reached")
    return point, np.array(used)


def _plane_axes(pole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    helper = np.eye(3)[np.argmin(np.abs(pole))]
    a = np.cross(pole, helper)
    a /= np.linalg.norm(a)
    return a, np.cross(pole, a)


def _unit_rows(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1)
    return v[n > 0] / n[n > 0][:, None]


def _hull(v: np.ndarray, pole: np.ndarray) -> np.ndarray:
    """Rows of the corners of the cone, counter-clockwise around ``pole`` (all ``v @ pole > 0``)."""
    a, b = _plane_axes(pole)
    depth = v @ pole
    flat = np.column_stack([v @ a / depth, v @ b / depth])
    order = np.lexsort((flat[:, 1], flat[:, 0]))

    def chain(rows: np.ndarray) -> list[int]:
        out: list[int] = []
        for r in rows:
            while len(out) > 1:
                n = np.cross(v[out[-2]], v[out[-1]])
                if n @ v[r] > TOLERANCE * np.linalg.norm(n):
                    break
                out.pop()
            out.append(int(r))
        return out

    return np.array(chain(order)[:-1] + chain(order[::-1])[:-1], dtype=int)


def _ring(v: np.ndarray, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The normals of the faces between neighbouring corners, and for each row of ``v`` the face whose angle it lies in.

    Face n lies between corner n and the next one; a corner lies in the face that begins with it.
    """
    ring = v[corners]
    normals = np.cross(ring, np.roll(ring, -1, axis=0))
    normals /= np.linalg.norm(normals, axis=1)[:, None]
    centre = ring.mean(axis=0)
    centre /= np.linalg.norm(centre)
    a, b = _plane_axes(centre)
    turn = np.arctan2(ring @ b, ring @ a)
    start = int(np.argmin(turn))
    turn, face = np.roll(turn, -start), np.roll(np.arange(len(corners)), -start)
    return normals, face[np.searchsorted(turn, np.arctan2(v @ b, v @ a), side="right") - 1]


def _ring_weights(v: np.ndarray, n: np.ndarray, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The normals of a cone's faces and how many pairs of vectors lie on each; every vector is looked at once."""
    normals, face = _ring(v, corners)
    is_corner = np.zeros(len(v), dtype=bool)
    is_corner[corners] = True
    on = (np.abs(np.einsum("ij,ij->i", v, normals[face])) <= TOLERANCE) & ~is_corner
    count = n.astype(float)
    total, squares = np.zeros(len(corners)), np.zeros(len(corners))
    np.add.at(total, face[on], count[on])
    np.add.at(squares, face[on], count[on] ** 2)
    for shift in (0, -1):  # both corners of a face
        at = count[np.roll(corners, shift)]
        total += at
        squares += at**2
    return normals, (total**2 - squares) / 2


def _faces(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate corners of the pole polygon (unit rows) and a mask of the rows of ``v`` worth keeping.

    No candidate means that no hemisphere holds ``v``; the kept rows then prove it.
    """
    none, keep = np.empty((0, 3)), np.zeros(len(v), dtype=bool)
    point, used = _closest_to_origin(v)
    if np.linalg.norm(point) > FLAT:
        pole = point / np.linalg.norm(point)
        corners = _hull(v, pole)
        if len(corners) < 3:
            keep[:] = True if len(v) <= 3 else False
            keep[corners] = True
            normals = _unit_rows(np.cross(v[corners], np.roll(v[corners], -1, axis=0)))
            keep |= np.abs(v @ normals.T).max(axis=1, initial=0.0) <= TOLERANCE
            return normals, keep
        normals, face = _ring(v, corners)
        keep[:] = np.abs(np.einsum("ij,ij->i", v, normals[face])) <= TOLERANCE
        keep[corners] = True
        return normals, keep
    keep[used] = True
    _, spread, axes = np.linalg.svd(v[used])
    rank = int((spread > FLAT).sum())
    if rank == 3:
        return none, keep
    if rank == 2:
        candidates = np.vstack([axes[2], -axes[2]])
    else:
        line = v[used[0]]
        side = v - np.outer(v @ line, line)
        real = np.flatnonzero(np.linalg.norm(side, axis=1) > FLAT)
        if len(real) == 0:
            return none, keep
        side = _unit_rows(side[real])
        inner, proof = _closest_to_origin(side)
        keep[real[proof]] = True
        if np.linalg.norm(inner) > FLAT:
            middle = inner / np.linalg.norm(inner)
            angle = np.arctan2(side @ np.cross(line, middle), side @ middle)
            proof = np.array([angle.argmin(), angle.argmax()])
            keep[real[proof]] = True
        normals = _unit_rows(np.cross(line, side[proof]))
        candidates = np.vstack([normals, -normals])
    dots = v @ candidates.T
    passing = dots.min(axis=0) >= -TOLERANCE
    border = np.abs(dots[:, passing]) <= TOLERANCE
    keep |= border.any(axis=1)
    for i in range(len(candidates)):
        keep[[dots[:, i].argmax(), dots[:, i].argmin()]] = True
    return np.unique(candidates[passing], axis=0), keep


def _pairs_on(v: np.ndarray, n: np.ndarray, normal: np.ndarray) -> float:
    """How many pairs of non-parallel vectors have this normal, counting repeated vectors."""
    on = np.abs(v @ normal) <= TOLERANCE
    rows, count = v[on], n[on].astype(float)
    lead = np.sign(np.take_along_axis(rows, (rows != 0).argmax(axis=1)[:, None], axis=1))
    _, line = np.unique(rows * lead, axis=0, return_inverse=True)
    per_line = np.bincount(line.ravel(), weights=count)
    return (count.sum() ** 2 - (per_line**2).sum()) / 2


def _border(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of a chunk that can still decide the result."""
    _, keep = _faces(pdf[["x", "y", "z"]].to_numpy())
    return pdf[keep]


def _decide(pdf: pd.DataFrame) -> tuple[bool, np.ndarray]:
    v, n = pdf[["x", "y", "z"]].to_numpy(), pdf["n"].to_numpy()
    point, _ = _closest_to_origin(v)
    corners = _hull(v, point / np.linalg.norm(point)) if np.linalg.norm(point) > FLAT else np.empty(0)
    if len(corners) >= 3:
        inside, weights = _ring_weights(v, n, corners)
    else:  # at most a plane's worth of normals
        inside, _ = _faces(v)
        if len(inside) == 0:
            return False, np.zeros(3)
        inside = inside[(v @ inside.T).min(axis=0) >= -TOLERANCE]
        weights = np.array([_pairs_on(v, n, c) for c in inside])
    pole = weights @ inside
    length = np.linalg.norm(pole)
    return True, pole / length if length > FLAT else np.full(3, np.nan)


def hemispheres(vecs: DataFrame, group: str = "label", chunk: int = CHUNK) -> DataFrame:
    """``(group, is_hemi, px, py, pz)``: the zero pole where there is no hemisphere.

    Groups are cut into chunks that keep their border, until the largest group fits one chunk or nothing more falls away, as
    when all its vectors lie on one arc or cone; the last step takes time in proportion to what is left.
    Where all vectors lie in one plane the corners cancel and the pole is not defined (NULL).
    """
    kind = vecs.schema[group].dataType.simpleString()
    schema = f"{group} {kind}, page long, x double, y double, z double, n long"
    merged = materialise(vecs.groupBy(group, "x", "y", "z").agg(F.count(F.lit(1)).alias("n")), "border")
    largest = None
    while True:
        found = merged.groupBy(group).count().agg(F.max("count")).first()[0] or 0
        if found <= chunk or (largest is not None and found > 0.9 * largest):
            break
        largest = found
        parts = paged(merged.select(group, "x", "y", "z", "n"), [group], ["x", "y", "z"], chunk)
        merged = materialise(parts.select(group, "page", "x", "y", "z", "n").groupBy(group, "page").applyInPandas(_border, schema), "border")

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        is_hemi, pole = _decide(pdf)
        row = {group: pdf[group].iloc[0], "is_hemi": is_hemi, "px": pole[0], "py": pole[1], "pz": pole[2]}
        return pd.DataFrame([row])

    out = f"{group} {kind}, is_hemi boolean, px double, py double, pz double"
    result = merged.groupBy(group).applyInPandas(decide, out)
    poles = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("px", "py", "pz")]
    return result.select(group, "is_hemi", *poles)


def farthest_from_pole(vecs: DataFrame, poles: DataFrame, group: str = "label") -> DataFrame:
    """Per group: the smallest scalar product of any vector with its pole, and whether the hemisphere holds all."""
    dot = M.dot3(("x", "y", "z"), ("px", "py", "pz"))
    return vecs.join(if_small(poles), group).groupBy(group).agg(F.min(dot).alias("min_dot")).withColumn(
        "contains_all", F.col("min_dot") >= -TOLERANCE
    )
