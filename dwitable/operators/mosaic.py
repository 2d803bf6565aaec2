"""Mosaics ("sprites"): square tiles laid out row by row in one picture.

A mosaic is a pixel table. Its rows are collected into arrays of one picture line each; a whole picture is never put
into one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwitable.functions import maths as M
from dwitable.functions.columns import ColumnLike, col
from dwitable.operators import voxels as V
from dwitable.session import if_small, settled

# The axis each direction cuts, the axes that remain, and the names used in sprite records.
DIRECTIONS = {"ax": ("i", "j", "k"), "cor": ("j", "i", "k"), "sag": ("k", "i", "j")}
ORIENTATIONS = ("sag", "ax", "cor")
SERIES_TYPE = "4dsprite"
STILL_TYPE = "brainsprite"
CHANNELS = ("r", "g", "b")
LAYOUT_FIELDS = ("pix", "num_slices", "N", "M")


def tile_rows(n_tiles: ColumnLike) -> Column:
    """Number of tile rows."""
    return M.nearest_square(n_tiles)


def tile_columns(n_tiles: ColumnLike) -> Column:
    """Number of tiles in a row."""
    return F.ceil(F.try_divide(col(n_tiles), tile_rows(n_tiles))).cast("int")


def tile_offset(t: ColumnLike, n_columns: ColumnLike) -> tuple[Column, Column]:
    """Tile row and tile column of tile ``t``."""
    return F.floor(F.try_divide(col(t), col(n_columns))).cast("int"), F.pmod(col(t), col(n_columns)).cast("int")


def pixel_tile(row: ColumnLike, column: ColumnLike, pix: ColumnLike, n_columns: ColumnLike) -> Column:
    """The tile a mosaic pixel belongs to."""
    return (F.floor(col(row) / col(pix)) * col(n_columns) + F.floor(col(column) / col(pix))).cast("int")


def tile_dims(dims: DataFrame, directions: Sequence[str] = ORIENTATIONS) -> DataFrame:
    """Extents of the tiles (``nr``, ``nc``) per subject and direction, with the volume count ``nt``."""
    kinds = F.array(*[
        F.struct(F.lit(d).alias("orientation"), F.col(f"n{r}").alias("nr"), F.col(f"n{c}").alias("nc"))
        for d, (_, r, c) in DIRECTIONS.items() if d in directions
    ])
    return dims.select("subject", "nt", F.explode(kinds).alias("_k")).select("subject", "nt", "_k.*")


def middle_slices(image: DataFrame, dims: DataFrame, directions: Sequence[str] = ORIENTATIONS) -> DataFrame:
    """The middle slice along each direction, one square tile ``(r, c)`` per direction and volume.

    ``dims`` holds one row per subject with the image extents and ``nt``, the number of volumes. The image is read
    once for all directions; only voxels on a middle slice go on.
    """
    hits = F.array(*[
        F.when(
            F.col(cut) == F.floor(F.col(f"n{cut}") / 2),
            F.struct(F.lit(d).alias("orientation"), F.col(r).alias("r"), F.col(c).alias("c")),
        )
        for d, (cut, r, c) in DIRECTIONS.items() if d in directions
    ])
    extents = dims.select("subject", "ni", "nj", "nk")
    image = image.select("subject", "t", "i", "j", "k", "value")
    middle = image.join(if_small(extents), "subject").select("subject", "t", "value", F.explode(F.array_compact(hits)).alias("_h"))
    tiles = middle.select("subject", "_h.*", "t", "value")
    side = F.greatest("nr", "nc")
    return V.padded(tiles, tile_dims(dims, directions), side, {"t": V.upto("nt")}, ("r", "c"), ("subject", "orientation"))


def mosaic_layout(dims: DataFrame, pix: Column, n_tiles: Column, by: Sequence[str] = ("subject",)) -> DataFrame:
    """Layout of each mosaic: tile side, tile count, tile rows and columns."""
    sized = dims.select(*by, pix.cast("int").alias("pix"), n_tiles.cast("int").alias("num_slices"))
    return sized.withColumn("N", tile_rows("num_slices")).withColumn("M", tile_columns("num_slices"))


def mosaic(tiles: DataFrame, layout: DataFrame, tile: str, r: str = "r", c: str = "c") -> DataFrame:
    """Dense square tiles as one pixel table ``(row, col, value)``; places without a tile are NaN.

    Columns of the layout beyond its own fields are keys of the picture, like ``subject``.
    """
    keys = [x for x in layout.columns if x not in LAYOUT_FIELDS]
    down, right = tile_offset(tile, "M")

    def laid(df: DataFrame) -> DataFrame:
        row, column = down * F.col("pix") + F.col(r), right * F.col("pix") + F.col(c)
        return df.select(*keys, row.cast("int").alias("row"), column.cast("int").alias("col"), "value")

    n_places = F.col("N") * F.col("M")
    places = F.filter(F.sequence(F.col("num_slices"), n_places), lambda p: p < n_places)
    empty = layout.select("*", F.explode(places).alias(tile)).repartition(*keys, tile)
    empty = empty.select("*", F.explode(V.upto("pix")).alias(r)).select("*", F.explode(V.upto("pix")).alias(c))
    return laid(tiles.join(if_small(layout), keys)).unionByName(laid(empty.withColumn("value", F.lit(float("nan")))))


def mosaic_lines(pixels: DataFrame) -> DataFrame:
    """One array per picture line."""
    keys = [c for c in pixels.columns if c not in ("col", "value")]
    entries = F.sort_array(F.collect_list(F.struct("col", "value")))
    return pixels.groupBy(*keys).agg(F.transform(entries, lambda e: e["value"]).alias("pixels"))


def stack_mosaic(image: DataFrame, dims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Layout and pixels of a 3-D image whose slices along k are the tiles, padded to the larger in-plane extent."""
    dims = settled(dims, "dims")
    side = F.greatest("ni", "nj")
    tiles = V.padded(image, dims, side, {"k": V.upto("nk")})
    layout = mosaic_layout(dims, side, F.col("nk"))
    return layout, mosaic(tiles, layout, "k", "i", "j")


def series_layouts(dims: DataFrame) -> DataFrame:
    """Layouts of the three middle-slice mosaics over all volumes but the first.

    ``dims`` holds the extents of the oriented image and its volume count per subject.
    """
    tiles = tile_dims(dims.withColumn("nt", F.col("nt") - 1))
    layout = mosaic_layout(tiles, F.greatest("nr", "nc"), F.col("nt"), ("subject", "orientation"))
    return layout.withColumn("img_type", F.lit(SERIES_TYPE))


def series_pixels(image: DataFrame, dims: DataFrame) -> DataFrame:
    """Pixels of the three middle-slice mosaics of an oriented image, all volumes but the first."""
    dims = settled(dims, "dims")
    tiles = middle_slices(V.skip_first(image), dims.withColumn("nt", F.col("nt") - 1))
    return mosaic(tiles, series_layouts(dims).drop("img_type"), "t")


def still_layouts(dims: DataFrame) -> DataFrame:
    """Layouts of the b0, masked colour-FA and anatomy-mask mosaics, which share their geometry."""
    names = F.explode(F.array(F.lit("b0"), F.lit("colorFA"), F.lit("anat_mask"))).alias("image")
    kind = F.when(F.col("image") != "anat_mask", F.lit(STILL_TYPE))
    layout = mosaic_layout(dims, F.greatest("ni", "nj"), F.col("nk"))
    return layout.select("*", names).withColumn("img_type", kind)


def still_pixels(
    b0: DataFrame, colour_fa: DataFrame, anatomy_mask: DataFrame, dims: DataFrame, radius: int = 4, passes: int = 4
) -> DataFrame:
    """Pixels of the b0, masked colour-FA and anatomy-mask mosaics.

    The colour image has a ``channel`` column; it is NaN outside the foreground of the padded b0 image, which is
    median-filtered ``passes`` times first. All three are oriented already and share their extents.
    """
    dims = settled(dims, "dims")
    side = F.greatest("ni", "nj")
    slices = {"k": V.upto("nk")}
    channels = F.array(*[F.lit(c) for c in CHANNELS])
    layout = mosaic_layout(dims, side, F.col("nk"))
    b0_tiles = V.padded(b0, dims, side, slices)
    foreground = V.foreground_mask(b0_tiles, radius, passes)
    colour_tiles = V.masked(V.padded(colour_fa, dims, side, {**slices, "channel": channels}), foreground)
    mask_tiles = V.padded(anatomy_mask, dims, side, slices)
    per_channel = layout.select("*", F.explode(channels).alias("channel"))

    def picture(tiles: DataFrame, over: DataFrame, name: str) -> DataFrame:
        pixels = mosaic(tiles, over, "k", "i", "j").withColumn("image", F.lit(name))
        return pixels if "channel" in pixels.columns else pixels.withColumn("channel", F.lit(""))

    return (
        picture(b0_tiles, layout, "b0")
        .unionByName(picture(colour_tiles, per_channel, "colorFA"))
        .unionByName(picture(mask_tiles, layout, "anat_mask"))
    )
