"""Voxel tables: selection, orientation, padding, masks, regridding, neighbourhoods.

A 4-D image is ``(subject, t, i, j, k, value)``, a 3-D image the same without ``t``. Joins and aggregations are keyed
on voxel coordinates, so even a third of all rows in one subject spreads evenly.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwitable.functions import maths as M
from dwitable.session import if_small, materialise, settled

AXES = ("i", "j", "k")
BINS = 256
BLOCK_SIDE = 16
#: The determinant of a matrix of unit columns up to which it counts as singular.
SINGULAR = 1e-9


def image_dims(voxels: DataFrame, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """Extent of each image along its three axes (``ni``, ``nj``, ``nk``)."""
    return voxels.groupBy(*keys).agg(*[(F.max(a) + 1).cast("int").alias(f"n{a}") for a in AXES])


def time_range(voxels: DataFrame, t_min: int = 0, t_size: int | None = 1) -> DataFrame:
    """Volumes from ``t_min`` on, ``t_size`` of them (all if None), renumbered from 0."""
    t = F.col("t")
    inside = t >= t_min if t_size is None else (t >= t_min) & (t < t_min + t_size)
    return voxels.filter(inside).withColumn("t", t - t_min)


def skip_first(voxels: DataFrame) -> DataFrame:
    """All volumes but the first."""
    return time_range(voxels, 1, None)


def concatenate(first: DataFrame, second: DataFrame) -> DataFrame:
    """Second image after the first along time."""
    lengths = first.groupBy("subject").agg((F.max("t") + 1).alias("_n"))
    moved = second.join(settled(lengths, "lengths"), "subject", "left").withColumn("t", F.col("t") + F.coalesce("_n", F.lit(0))).drop("_n")
    return first.unionByName(moved.select(*first.columns))


def binarise(voxels: DataFrame, column: str = "label", out: str = "value") -> DataFrame:
    """1.0 where the value is positive, else 0.0."""
    return voxels.withColumn(out, F.when(F.col(column) > 0, F.lit(1.0)).otherwise(F.lit(0.0)))


def with_rotation(affines: DataFrame) -> DataFrame:
    """Affines with the rotation (or reflection) nearest to their 3x3 part, ``r00`` to ``r22``, zooms and shears taken away.

    Columns of the affine are brought to length 1. The result B is the product of a rotation and the symmetric root U of B'B (polar
    decomposition). U and its inverse are polynomials in B'B whose coefficients follow from the eigenvalues, so all is done in
    column expressions. An affine without an inverse has no nearest rotation and keeps its B.
    """
    three = range(3)
    zoom = [F.sqrt(sum(F.col(f"a{x}{c}") * F.col(f"a{x}{c}") for x in three)) for c in three]
    out = affines.withColumns({f"_b{x}{c}": F.col(f"a{x}{c}") / F.when(zoom[c] > 0, zoom[c]).otherwise(1.0) for x in three for c in three})
    out = out.withColumns({f"_c{x}{c}": sum(F.col(f"_b{k}{x}") * F.col(f"_b{k}{c}") for k in three) for x in three for c in three})
    roots = [F.sqrt(F.greatest(e, F.lit(0.0))) for e in M.sym3_eigenvalues(*[f"_c{x}" for x in ("00", "11", "22", "01", "02", "12")])]
    out = out.withColumns(dict(zip(("_s0", "_s1", "_s2"), roots)))
    a, b, c = (F.col(f"_s{n}") for n in three)
    out = out.withColumns({"_i1": a + b + c, "_i2": a * b + a * c + b * c, "_i3": a * b * c})
    i1, i2, i3 = F.col("_i1"), F.col("_i2"), F.col("_i3")
    unit = lambda x, y: 1.0 if x == y else 0.0
    square = lambda x, y: sum(F.col(f"_c{x}{k}") * F.col(f"_c{k}{y}") for k in three)
    out = out.withColumns({f"_u{x}{y}": F.try_divide((i1 * i1 - i2) * F.col(f"_c{x}{y}") - square(x, y) + i1 * i3 * unit(x, y), i1 * i2 - i3)
                           for x in three for y in three})
    out = out.withColumns({f"_v{x}{y}": F.try_divide(F.col(f"_c{x}{y}") - i1 * F.col(f"_u{x}{y}") + i2 * unit(x, y), i3) for x in three for y in three})
    turned = {f"r{x}{y}": F.when(i3 > SINGULAR, sum(F.col(f"_b{x}{k}") * F.col(f"_v{k}{y}") for k in three)).otherwise(F.col(f"_b{x}{y}"))
              for x in three for y in three}
    return out.withColumns(turned).select(*affines.columns, *turned)


def orientation(affines: DataFrame) -> DataFrame:
    """World axis (0, 1, 2) and direction of each voxel axis, from the rotation in the affine.

    Voxel axes are taken in order; each gets the free world axis on which it has the largest component. Shears are taken away
    first: with them a voxel axis may lean over to the axis of another.
    """
    affines = with_rotation(affines)
    def strongest(axis: int, taken: list[Column]) -> Column:
        options = [F.struct(F.abs(f"r{r}{axis}").alias("w"), F.lit(-r).alias("r")) for r in range(3)]
        free = F.filter(F.array(*options), lambda o: ~F.array_contains(F.array(*taken), -o["r"])) if taken else F.array(*options)
        return -F.array_max(free)["r"]

    out = affines.withColumn("w0", strongest(0, []))
    out = out.withColumn("w1", strongest(1, [F.col("w0")])).withColumn("w2", 3 - F.col("w0") - F.col("w1"))
    signs = []
    for axis in range(3):
        component = F.element_at(F.array(*[F.col(f"r{r}{axis}") for r in range(3)]), F.col(f"w{axis}") + 1)
        signs.append(F.when(component < 0, F.lit(-1)).otherwise(F.lit(1)).alias(f"s{axis}"))
    return out.select("subject", "w0", "w1", "w2", *signs)


def to_ras(voxels: DataFrame, affines: DataFrame, dims: DataFrame) -> DataFrame:
    """Voxel indices along right, anterior, superior: permuted and flipped as the affine says."""
    o = if_small(orientation(affines).join(dims, "subject"))
    moved = [
        F.when(F.col(f"s{n}") > 0, F.col(a)).otherwise(F.col(f"n{a}") - 1 - F.col(a)) for n, a in enumerate(AXES)
    ]
    keep = [c for c in voxels.columns if c not in AXES]

    def along(world: int, source: Sequence[Column]) -> Column:
        return F.when(F.col("w0") == world, source[0]).when(F.col("w1") == world, source[1]).otherwise(source[2])

    extents = [F.col(f"n{a}") for a in AXES]
    return voxels.join(o, "subject").select(
        *keep,
        *[along(w, moved).cast("int").alias(a) for w, a in enumerate(AXES)],
        *[along(w, extents).cast("int").alias(f"n{a}") for w, a in enumerate(AXES)],
    )


def to_ipl(ras: DataFrame) -> DataFrame:
    """From right-anterior-superior to inferior-posterior-left: all axes flipped, first and last swapped."""
    keep = [c for c in ras.columns if c not in (*AXES, "ni", "nj", "nk")]
    flipped = {a: F.col(f"n{a}") - 1 - F.col(a) for a in AXES}
    return ras.select(
        *keep, flipped["k"].alias("i"), flipped["j"].alias("j"), flipped["i"].alias("k"),
        F.col("nk").alias("ni"), F.col("nj").alias("nj"), F.col("ni").alias("nk"),
    )


def reorient(voxels: DataFrame, affines: DataFrame, dims: DataFrame) -> DataFrame:
    """Voxels in the orientation the sprites are made from, with the new extents."""
    return to_ipl(to_ras(voxels, affines, dims))


def left_pad(n: Column, size: Column) -> Column:
    """Zeros put before ``size`` entries to centre them in ``n``."""
    return F.floor((n - size) / 2).cast("int")


#: Frame pixels that one task makes and meets with an image's.
TASK_PIXELS = 500_000


def padded(
    images: DataFrame, dims: DataFrame, n: Column, slices: dict[str, Column], axes: Sequence[str] = ("i", "j"),
    by: Sequence[str] = ("subject",),
) -> DataFrame:
    """Images centred in an ``n`` by ``n`` frame of zeros, every pixel present; an image larger than the frame raises.

    ``dims`` has the extents of both axes (``n<axis>``) per image (``by``); ``slices`` names the further coordinates of a
    picture and lists their values as an array over ``dims``. The frame is generated on the executors and meets the
    pixels in one aggregation. Both are dealt out by number: the table of pictures is a few bytes for what
    becomes many pixels, so the size of what a shuffle wrote says nothing about a task's work.
    """
    a, b = axes
    keys = [*by, *slices]
    fits = n >= F.greatest(F.col(f"n{a}"), F.col(f"n{b}"))
    frame = dims.withColumn("_n", F.when(fits, n).otherwise(F.raise_error("the frame is smaller than the image").cast("int")).cast("int"))
    frame = frame.select(*by, f"n{a}", f"n{b}", "_n", *[values.alias(name) for name, values in slices.items()])
    frame = materialise(frame, "frames")
    shifts = frame.select(
        *by, left_pad(F.col("_n"), F.col(f"n{a}")).alias("_da"), left_pad(F.col("_n"), F.col(f"n{b}")).alias("_db")
    )
    size = reduce(lambda x, name: x * F.size(name), slices, F.col("_n").cast("double") * F.col("_n"))
    parts = math.ceil((frame.agg(F.sum(F.greatest(size, F.lit(0.0)))).first()[0] or 0) / TASK_PIXELS) or 1
    pictures = frame
    for name in slices:
        pictures = pictures.withColumn(name, F.explode(name))
    line = F.sequence(F.lit(0), F.col("_n") - 1)
    zeros = (
        pictures.select(*keys, "_n").repartition(parts, *keys)
        .select(*keys, "_n", F.explode(line).alias(a)).select(*keys, a, F.explode(line).alias(b))
        .withColumn("value", F.lit(None).cast("double"))
    )
    placed = images.join(if_small(shifts), list(by)).select(
        *keys, (F.col(a) + F.col("_da")).cast("int").alias(a), (F.col(b) + F.col("_db")).cast("int").alias(b), "value"
    )
    both = zeros.unionByName(placed).repartition(parts, *keys, a, b)
    return both.groupBy(*keys, a, b).agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("value"))


def upto(n: Column | str) -> Column:
    """The indices 0 to n - 1."""
    return F.sequence(F.lit(0), (F.col(n) if isinstance(n, str) else n) - 1)


def masked(image: DataFrame, mask: DataFrame) -> DataFrame:
    """NaN where the mask has no positive voxel."""
    inside = mask.filter("value > 0").select("subject", *AXES, F.lit(True).alias("_in"))
    value = F.when(F.col("_in"), F.col("value")).otherwise(F.lit(float("nan")))
    return image.join(inside, ["subject", *AXES], "left").withColumn("value", value).drop("_in")


def world_coordinates(voxels: DataFrame, affines: DataFrame) -> DataFrame:
    """World position of each voxel: the affine times the 1-based index."""
    x, y, z = M.affine_times_point(M.affine_columns(), (F.col("i") + 1, F.col("j") + 1, F.col("k") + 1))
    return voxels.join(if_small(affines), "subject").select(*voxels.columns, x.alias("wx"), y.alias("wy"), z.alias("wz"))


def default_affine(voxel_size: float, origin: tuple[float, float, float]) -> list[list[Column]]:
    """The affine of an image that states only voxel size and origin."""
    return [
        [F.lit(voxel_size if r == c else 0.0) for c in range(3)] + [F.lit(-float(origin[r]))] for r in range(3)
    ] + [[F.lit(0.0)] * 3 + [F.lit(1.0)]]


CUBE = ("ci", "cj", "ck")


def target_cubes(source: DataFrame, grid: DataFrame, affines: DataFrame, side: int = BLOCK_SIDE) -> DataFrame:
    """The cubes of a target grid, each with its affine and the box of source voxels that its own are nearest to.

    ``(subject, ci, cj, ck, ni, nj, nk, a00 ..., lo0, hi0, ...)``. The box is that of the cube's corners, kept inside the source; it
    is empty (``hi`` below ``lo``) for a cube that lies outside.
    """
    extents = image_dims(source).select("subject", *[F.col(f"n{a}").alias(f"_n{x}") for x, a in enumerate(AXES)])
    cubes = grid.join(affines, "subject").join(settled(extents, "extents"), "subject", "left")
    for c, a in zip(CUBE, AXES):
        cubes = cubes.withColumn(c, F.explode(F.sequence(F.lit(0), F.floor((F.col(f"n{a}") - 1) / side).cast("int"))))
    corners = [(F.col(c) * side, F.least(F.col(c) * side + side, F.col(f"n{a}")) - 1) for c, a in zip(CUBE, AXES)]
    box = {}
    for r in range(3):
        ends = [(F.col(f"a{r}{c}") * lo, F.col(f"a{r}{c}") * hi) for c, (lo, hi) in enumerate(corners)]
        least = sum((F.least(x, y) for x, y in ends), F.lit(0.0)) + F.col(f"a{r}3")
        most = sum((F.greatest(x, y) for x, y in ends), F.lit(0.0)) + F.col(f"a{r}3")
        last = F.coalesce(F.col(f"_n{r}"), F.lit(0)) - 1
        # one voxel more on both sides: sums of rounded numbers may come out lower or higher
        box[f"lo{r}"] = F.greatest(F.floor(F.least(F.greatest(least, F.lit(-1e9)), F.lit(1e9)) + 0.5) - 1, F.lit(0)).cast("int")
        box[f"hi{r}"] = F.least(F.floor(F.least(F.greatest(most, F.lit(-1e9)), F.lit(1e9)) + 0.5) + 1, last).cast("int")
    return cubes.withColumns(box).select("subject", *CUBE, "ni", "nj", "nk", *[f"a{r}{c}" for r in range(3) for c in range(4)], *box)


def sent_voxels(source: DataFrame, cubes: DataFrame, side: int = BLOCK_SIDE) -> DataFrame:
    """Source voxels with the target cube that needs them: ``(subject, ci, cj, ck, si, sj, sk, label)``.

    Blocks of the source are matched with boxes, a few for each cube; of a block only what lies in the box is sent. A voxel
    on the rim of several boxes is sent to each.
    """
    blocks = ("bi", "bj", "bk")
    needed = cubes.where("lo0 <= hi0 and lo1 <= hi1 and lo2 <= hi2").select("subject", *CUBE, *[f"{e}{r}" for r in range(3) for e in ("lo", "hi")])
    for r, b in enumerate(blocks):
        needed = needed.withColumn(b, F.explode(F.sequence(F.floor(F.col(f"lo{r}") / side).cast("int"), F.floor(F.col(f"hi{r}") / side).cast("int"))))
    held = source.select("subject", *[F.col(a).cast("int").alias(s) for a, s in zip(AXES, ("si", "sj", "sk"))], "label",
                         *[F.floor(F.col(a) / side).cast("int").alias(b) for a, b in zip(AXES, blocks)])
    inside = F.lit(True)
    for r, s in enumerate(("si", "sj", "sk")):
        inside = inside & (F.col(s) >= F.col(f"lo{r}")) & (F.col(s) <= F.col(f"hi{r}"))
    return held.join(settled(needed, "boxes"), ["subject", *blocks]).where(inside).select("subject", *CUBE, "si", "sj", "sk", "label")


def _regrid_cube(cube: pd.DataFrame, voxels: pd.DataFrame, side: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Places of a target cube's voxels, and the row of ``voxels`` that each takes, -1 for none."""
    c = cube.iloc[0]
    ranges = [np.arange(int(c[n]) * side, min(int(c[n]) * side + side, int(c[f"n{a}"]))) for n, a in zip(CUBE, AXES)]
    places = [x.ravel() for x in np.meshgrid(*ranges, indexing="ij")]
    wanted = [np.floor(c[f"a{r}0"] * places[0] + c[f"a{r}1"] * places[1] + c[f"a{r}2"] * places[2] + c[f"a{r}3"] + 0.5) for r in range(3)]
    if not len(voxels):
        return places, np.full(places[0].size, -1)
    low, high = [int(c[f"lo{r}"]) for r in range(3)], [int(c[f"hi{r}"]) for r in range(3)]
    size = [h - w + 1 for w, h in zip(low, high)]
    number = lambda x: ((x[0] - low[0]) * size[1] + (x[1] - low[1])) * size[2] + (x[2] - low[2])
    inside = np.logical_and.reduce([(w >= a) & (w <= b) for w, a, b in zip(wanted, low, high)])
    own = number([voxels[s].to_numpy().astype(np.int64) for s in ("si", "sj", "sk")])
    order = np.argsort(own, kind="stable")
    asked = np.where(inside, number([np.where(inside, w, 0).astype(np.int64) for w in wanted]), -1)
    at = np.minimum(np.searchsorted(own[order], asked), len(own) - 1)
    return places, np.where(inside & (own[order][at] == asked), order[at], -1)


def regrid_nearest(source: DataFrame, grid: DataFrame, affines: DataFrame, side: int = BLOCK_SIDE) -> DataFrame:
    """A segmentation on another grid: each target voxel takes the value of the nearest source voxel, 0 outside.

    ``grid`` has the target extents per subject, ``affines`` maps target to source indices. The target is cut into cubes; each gets
    the source voxels of its pre-image, so the shuffle is one copy of the source and the rims of the boxes, and no target
    voxel is shuffled. Nearest voxels are looked up inside the cube.
    """
    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    cubes = target_cubes(source, grid, affines, side)
    sent = sent_voxels(source.withColumn("label", F.coalesce("label", F.lit(0).cast(kinds["label"]))), cubes, side)
    keys = ["subject", *CUBE]

    def place(cube: pd.DataFrame, voxels: pd.DataFrame) -> pd.DataFrame:
        if not len(cube):
            return pd.DataFrame(columns=["subject", *AXES, "label"])
        places, rows = _regrid_cube(cube, voxels, side)
        label = np.where(rows >= 0, voxels["label"].to_numpy()[rows], 0) if len(voxels) else np.zeros(rows.size, int)
        return pd.DataFrame({"subject": cube["subject"].iloc[0], **dict(zip(AXES, places)), "label": label})

    return cubes.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(
        place, f"subject {kinds['subject']}, i int, j int, k int, label {kinds['label']}")


def dilate(mask: DataFrame, dims: DataFrame, minimum: float = 0.5) -> DataFrame:
    """Voxels at or above ``minimum`` and their 26 neighbours inside the image.

    Dilation by a cube is done one axis after the other, so a voxel is copied three times per axis, not 27 times.
    """
    out = mask.filter(F.col("value") >= minimum).select("subject", *AXES).join(if_small(dims), "subject")
    for a in AXES:
        near = F.sequence(F.greatest(F.col(a) - 1, F.lit(0)), F.least(F.col(a) + 1, F.col(f"n{a}") - 1))
        rest = [c for c in out.columns if c not in (a, f"n{a}")]
        out = out.select(*rest, F.explode(near).alias(a)).distinct()
    return out.select("subject", *AXES)


def median_filter(image: DataFrame, radius: int = 2, side: int = BLOCK_SIDE) -> DataFrame:
    """Median of the voxels present within ``radius`` along every axis.

    The image is cut into cubes; voxels near a face are also sent to the neighbouring cubes, so each cube is filtered
    alone and holds at most ``(side + 2 * radius) ** 3`` voxels.
    """
    if 2 * radius > side:
        raise ValueError("the radius must not exceed half the block side")
    cubes = image.select("subject", *AXES, "value")
    for a in AXES:
        first, last = F.greatest(F.floor((F.col(a) - radius) / side), F.lit(0)), F.floor((F.col(a) + radius) / side)
        cubes = cubes.withColumn(f"_{a}", F.explode(F.sequence(first, last)))
    wide = side + 2 * radius

    def filtered(pdf: pd.DataFrame) -> pd.DataFrame:
        base = pdf[["_i", "_j", "_k"]].to_numpy()[0] * side - radius
        at = pdf[list(AXES)].to_numpy() - base
        cube = np.full((wide,) * 3, np.nan)
        cube[tuple(at.T)] = pdf["value"].to_numpy()
        own = ((at >= radius) & (at < radius + side)).all(axis=1)
        windows = np.lib.stride_tricks.sliding_window_view(cube, (2 * radius + 1,) * 3)
        around = windows[tuple((at[own] - radius).T)].reshape(int(own.sum()), (2 * radius + 1) ** 3)
        out = pdf.loc[own, ["subject", *AXES]].copy()
        ranked = np.sort(around, axis=1)
        n = np.count_nonzero(~np.isnan(ranked), axis=1)
        row = np.arange(len(ranked))
        out["value"] = (ranked[row, (n - 1) // 2] + ranked[row, n // 2]) / 2
        return out

    kind = image.schema["subject"].dataType.simpleString()
    schema = f"subject {kind}, " + ", ".join(f"{a} {image.schema[a].dataType.simpleString()}" for a in AXES) + ", value double"
    return cubes.groupBy("subject", "_i", "_j", "_k").applyInPandas(filtered, schema)


def otsu_threshold(image: DataFrame) -> DataFrame:
    """Threshold per subject that separates two intensity classes best, from a histogram of 256 equal bins.

    The threshold is the centre of the last bin of the lower class; only histograms meet in a window, never voxels.
    """
    span = image.groupBy("subject").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / BINS
    slot = F.least(F.coalesce(F.floor(F.try_divide(F.col("value") - F.col("lo"), width)), F.lit(0)), F.lit(BINS - 1))
    centre = F.col("lo") + (F.col("bin") + 0.5) * width
    bins = (
        image.join(settled(span, "span"), "subject").groupBy("subject", slot.cast("int").alias("bin"), "lo", "hi")
        .agg(F.count(F.lit(1)).alias("n")).withColumn("centre", centre)
    )
    w = Window.partitionBy("subject")
    below = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    mass = F.col("n") * F.col("centre")
    sums = bins.select(
        "subject", "bin", "centre",
        F.sum("n").over(below).alias("n1"), F.sum("n").over(w).alias("n_all"),
        F.sum(mass).over(below).alias("m1"), F.sum(mass).over(w).alias("m_all"),
    ).withColumn("n2", F.col("n_all") - F.col("n1"))
    gap = F.col("m1") / F.col("n1") - F.try_divide(F.col("m_all") - F.col("m1"), F.col("n2"))
    between = F.coalesce(F.col("n1") * F.col("n2") * gap * gap, F.lit(0.0))
    return sums.groupBy("subject").agg(F.max_by("centre", F.struct(between, -F.col("bin"))).alias("threshold"))


def foreground_mask(image: DataFrame, radius: int = 0, passes: int = 1) -> DataFrame:
    """1.0 above the two-class threshold, else 0.0; with a radius the image is median-filtered first."""
    smooth = image
    if radius:
        for _ in range(passes):
            smooth = median_filter(smooth, radius)
        smooth = materialise(smooth, "smooth")
    value = F.when(F.col("value") > F.col("threshold"), F.lit(1.0)).otherwise(F.lit(0.0))
    return smooth.join(settled(otsu_threshold(smooth), "otsu"), "subject").select("subject", *AXES, value.alias("value"))


def grey_scale(tiles: DataFrame, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """Values stretched to 0..255 per image; NaN does not count towards the range and stays."""
    v = F.when(~F.isnan("value"), F.col("value"))
    span = tiles.groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    grey = F.try_divide(F.col("value") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * 255
    return tiles.join(settled(span, "span"), list(keys)).withColumn("grey", grey).drop("_lo", "_hi")


def plane(voxels: DataFrame, dims: DataFrame, kind: str, at: int | Column) -> DataFrame:
    """One orthogonal plane of a stack as pixels ``(px, py)``, the vertical axis pointing up.

    ``sagittal`` fixes i and shows j against k, ``coronal`` fixes j and shows i against k, ``axial`` fixes k and
    shows j against i.
    """
    fixed, x, y = {"sagittal": ("i", "j", "k"), "coronal": ("j", "i", "k"), "axial": ("k", "j", "i")}[kind]
    position = F.lit(at) if isinstance(at, int) else at
    down = F.col("nk") - 1 - F.col(y) if y == "k" else F.col(y)
    return voxels.join(if_small(dims), "subject").filter(F.col(fixed) == position).select(
        *[c for c in voxels.columns if c not in AXES and c != "value"],
        F.col(x).cast("int").alias("px"), down.cast("int").alias("py"), "value",
    )


def nearest_entry(
    colours: DataFrame, colormap: DataFrame, low: float, high: float, n_entries: int | None = None, cell: int = 32
) -> DataFrame:
    """The colormap value of each ``(r, g, b)``: the entry closest in colour, the first on ties.

    Entry ``idx`` of ``n_entries`` (counted here if not given) stands for ``idx * (high - low) / (n - 1) + low``.

    Colours are compared once each. The colour cube is cut into cells; a cell needs only the entries that can be
    closest to some colour in it, so colours meet a short list by an equi-join on the cell.
    """
    channels = ("r", "g", "b")
    entries = colormap.groupBy(*channels).agg(F.min("idx").alias("idx"))
    last = (colormap.select("idx").distinct().count() if n_entries is None else n_entries) - 1
    per_axis = -(-256 // cell)
    spread = entries
    for c in channels:
        spread = spread.withColumn(f"_c{c}", F.explode(F.sequence(F.lit(0), F.lit(per_axis - 1))))

    def gaps(c: str) -> tuple[Column, Column]:
        lo, hi = F.col(f"_c{c}") * cell, F.col(f"_c{c}") * cell + cell - 1
        near = F.greatest(lo - F.col(c), F.col(c) - hi, F.lit(0))
        far = F.greatest(F.abs(F.col(c) - lo), F.abs(F.col(c) - hi))
        return near * near, far * far

    near = sum((gaps(c)[0] for c in channels), F.lit(0))
    far = sum((gaps(c)[1] for c in channels), F.lit(0))
    cells = [f"_c{c}" for c in channels]
    ranged = spread.withColumn("_near", near).withColumn("_far", far)
    bound = ranged.groupBy(*cells).agg(F.min("_far").alias("_bound"))
    short = ranged.join(bound, cells).filter("_near <= _bound").select(
        *cells, *[F.col(c).alias(f"_e{c}") for c in channels], "idx"
    )
    wanted = colours.select(*channels).distinct()
    for c in channels:
        wanted = wanted.withColumn(f"_c{c}", F.floor(F.col(c) / cell).cast("int"))
    distance = sum(
        ((F.col(c) - F.col(f"_e{c}")) * (F.col(c) - F.col(f"_e{c}")) for c in channels), F.lit(0)
    )
    best = wanted.join(short, cells).groupBy(*channels).agg(F.min(F.struct(distance.alias("d"), "idx")).alias("m"))
    value = F.try_divide(F.col("m.idx") * F.lit(float(high - low)), F.lit(float(last))) + F.lit(float(low))
    valued = best.select(*channels, F.col("m.idx").alias("idx"), value.alias("mapped"))
    return colours.join(settled(valued, "colours"), list(channels))
