"""Queries over voxel tables and mosaics."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwitable.functions import maths as M
from dwitable.operators import mosaic as MO
from dwitable.operators import volumes as VL
from dwitable.operators import voxels as V
from workload.registry import query


def _b0(t):
    return V.time_range(t.voxels4d, 0, 1).drop("t")


B0_SQL = "b0 AS (SELECT subject, i, j, k, value FROM voxels4d WHERE t = 0)"


@query("f8_first_volume", "voxels4d", "SELECT subject, CAST(t AS INT) AS t, i, j, k, value FROM voxels4d WHERE t = 0")
def f8(t):
    return V.time_range(t.voxels4d, 0, 1)


@query("f9_skip_first", "voxels4d", "SELECT subject, CAST(t - 1 AS INT) AS t, i, j, k, value FROM voxels4d WHERE t >= 1")
def f9(t):
    return V.skip_first(t.voxels4d)


@query("m5_binarise", "seg", "SELECT subject, i, j, k, CASE WHEN label > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS value FROM seg")
def m5(t):
    return V.binarise(t.seg).select("subject", "i", "j", "k", "value")


@query("a11_slice_count", "voxels4d", "SELECT subject, CAST(max(k) + 1 AS INT) AS n_slices FROM voxels4d GROUP BY subject")
def a11(t):
    return VL.slice_counts(t.voxels4d)


@query("j5_drop_volumes", "voxels4d", """+ v AS (SELECT DISTINCT subject, t FROM voxels4d),
kept AS (SELECT subject, t, row_number() OVER (PARTITION BY subject ORDER BY t) - 1 AS n FROM v WHERE t <> subject % 5)
SELECT x.subject, CAST(k2.n AS BIGINT) AS t, i, j, k, value FROM voxels4d x JOIN kept k2 ON x.subject = k2.subject AND x.t = k2.t""")
def j5_voxels(t):
    volumes = t.voxels4d.select("subject", F.col("t").alias("vol")).distinct()
    dropped = volumes.filter("vol = subject % 5")
    return VL.drop_volumes(t.voxels4d, volumes, dropped).select("subject", "t", "i", "j", "k", "value")


@query("w2_concatenate", "voxels4d dims", """
SELECT subject, CAST(t AS INT) AS t, i, j, k, value FROM voxels4d
UNION ALL SELECT x.subject, CAST(x.t + d.nt AS INT), i, j, k, -value FROM voxels4d x JOIN dims d ON x.subject = d.subject""")
def w2(t):
    return V.concatenate(t.voxels4d, t.voxels4d.withColumn("value", -F.col("value")))


ORIENTED_SQL = """o AS (SELECT v.*, ni, nj, nk, a00, a01, a10 FROM voxels4d v JOIN dims d ON v.subject = d.subject JOIN image_affines a ON v.subject = a.subject),
ras AS (SELECT subject, t, value,
  CASE WHEN a01 <> 0 THEN j WHEN a00 > 0 THEN i ELSE ni - 1 - i END AS x, CASE WHEN a01 <> 0 THEN ni - 1 - i ELSE j END AS y, k AS z,
  CASE WHEN a01 <> 0 THEN nj ELSE ni END AS nx, CASE WHEN a01 <> 0 THEN ni ELSE nj END AS ny, nk AS nz FROM o),
ipl AS (SELECT subject, t, nz - 1 - z AS i, ny - 1 - y AS j, nx - 1 - x AS k, nz AS ni, ny AS nj, nx AS nk, value FROM ras)"""


def _oriented(t):
    return V.reorient(t.voxels4d, t.image_affines, t.dims.drop("nt"))


def _oriented_dims(t):
    size = V.image_dims(t.voxels4d)
    swapped = size.join(V.orientation(t.image_affines), "subject")
    first, second = F.when(F.col("w0") == 0, F.col("ni")).otherwise(F.col("nj")), F.when(F.col("w0") == 0, F.col("nj")).otherwise(F.col("ni"))
    volumes = t.dims.select("subject", "nt")
    return swapped.select("subject", F.col("nk").alias("ni"), second.alias("nj"), first.alias("nk")).join(volumes, "subject")


@query("m7_reorient", "image_affines", f"""+ {ORIENTED_SQL}
SELECT subject, CAST(t AS INT) AS t, CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(k AS INT) AS k, value FROM ipl""")
def m7(t):
    return _oriented(t).select("subject", "t", "i", "j", "k", "value")


POLAR_SQL = """scaled AS (
  SELECT subject, a00 / sqrt(a00*a00 + a10*a10 + a20*a20) AS a, a01 / sqrt(a01*a01 + a11*a11 + a21*a21) AS b, a02 / sqrt(a02*a02 + a12*a12 + a22*a22) AS c,
    a10 / sqrt(a00*a00 + a10*a10 + a20*a20) AS d, a11 / sqrt(a01*a01 + a11*a11 + a21*a21) AS e, a12 / sqrt(a02*a02 + a12*a12 + a22*a22) AS f,
    a20 / sqrt(a00*a00 + a10*a10 + a20*a20) AS g, a21 / sqrt(a01*a01 + a11*a11 + a21*a21) AS h, a22 / sqrt(a02*a02 + a12*a12 + a22*a22) AS i
  FROM sheared_affines),
newton AS (
  SELECT 0 AS n, * FROM scaled
  UNION ALL
  SELECT n + 1, subject, (a + (e*i - f*h) / det) / 2, (b + (f*g - d*i) / det) / 2, (c + (d*h - e*g) / det) / 2,
    (d + (c*h - b*i) / det) / 2, (e + (a*i - c*g) / det) / 2, (f + (b*g - a*h) / det) / 2,
    (g + (b*f - c*e) / det) / 2, (h + (c*d - a*f) / det) / 2, (i + (a*e - b*d) / det) / 2
  FROM (SELECT *, a * (e*i - f*h) - b * (d*i - f*g) + c * (d*h - e*g) AS det FROM newton) AS m WHERE n < 60),
first_axis AS (
  SELECT *, CASE WHEN abs(a) > abs(d) AND abs(a) > abs(g) THEN 0 WHEN abs(d) > abs(g) THEN 1 ELSE 2 END AS w0 FROM newton WHERE n = 60),
second_axis AS (
  SELECT *, CASE w0 WHEN 0 THEN CASE WHEN abs(e) > abs(h) THEN 1 ELSE 2 END WHEN 1 THEN CASE WHEN abs(b) > abs(h) THEN 0 ELSE 2 END
    ELSE CASE WHEN abs(b) > abs(e) THEN 0 ELSE 1 END END AS w1 FROM first_axis)"""


@query("m7_sheared_axes", "sheared_affines", f"""+ {POLAR_SQL}
SELECT subject, w0, w1, 3 - w0 - w1 AS w2, CASE WHEN CASE w0 WHEN 0 THEN a WHEN 1 THEN d ELSE g END < 0 THEN -1 ELSE 1 END AS s0,
  CASE WHEN CASE w1 WHEN 0 THEN b WHEN 1 THEN e ELSE h END < 0 THEN -1 ELSE 1 END AS s1,
  CASE WHEN CASE 3 - w0 - w1 WHEN 0 THEN c WHEN 1 THEN f ELSE i END < 0 THEN -1 ELSE 1 END AS s2,
  round(a, 5) + 0.0 AS r00, round(e, 5) + 0.0 AS r11, round(g, 5) + 0.0 AS r20 FROM second_axis""", recursive=True)
def m7_sheared(t):
    axes = V.orientation(t.sheared_affines)
    turned = V.with_rotation(t.sheared_affines).select("subject", *[(F.round(c, 5) + 0.0).alias(c) for c in ("r00", "r11", "r20")])
    return axes.join(turned, "subject")


PAD_SQL = """frame AS (SELECT subject, ni, nj, CAST(floor((16 - ni) / 2) AS INT) AS da, CAST(floor((16 - nj) / 2) AS INT) AS db, unnest(range(0, nk)) AS k FROM dims),
cells AS (SELECT subject, k, da, db, a, unnest(range(0, 16)) AS b FROM (SELECT *, unnest(range(0, 16)) AS a FROM frame) AS f)"""


@query("m8_padded", "voxels4d dims", f"""+ {B0_SQL}, {PAD_SQL}
SELECT c.subject, CAST(c.k AS INT) AS k, CAST(c.a AS INT) AS i, CAST(c.b AS INT) AS j, coalesce(b0.value, 0) AS value FROM cells c
LEFT JOIN b0 ON c.subject = b0.subject AND c.k = b0.k AND c.a = b0.i + c.da AND c.b = b0.j + c.db""")
def m8(t):
    return V.padded(_b0(t), t.dims, F.lit(16), {"k": V.upto("nk")})


def _middle_sql(cut: str, r: str, c: str) -> str:
    return f"""fr AS (SELECT subject, n{cut} AS n, n{r} AS nr, n{c} AS nc, greatest(n{r}, n{c}) AS side, unnest(range(0, nt)) AS t FROM dims),
f2 AS (SELECT *, unnest(range(0, side)) AS r FROM fr), f3 AS (SELECT *, unnest(range(0, side)) AS c FROM f2)
SELECT f3.subject, CAST(f3.t AS INT) AS t, CAST(f3.r AS INT) AS r, CAST(f3.c AS INT) AS c, coalesce(v.value, 0) AS value FROM f3
LEFT JOIN voxels4d v ON v.subject = f3.subject AND v.t = f3.t AND v.{cut} = floor(f3.n / 2) AND v.{r} + floor((side - nr) / 2) = f3.r
  AND v.{c} + floor((side - nc) / 2) = f3.c"""


for _direction, (_cut, _row, _col) in MO.DIRECTIONS.items():
    query(f"m9_middle_slice_{_direction}", "dims", f"+ {_middle_sql(_cut, _row, _col)}")(
        lambda t, d=_direction: MO.middle_slices(t.voxels4d, t.dims, (d,)).drop("orientation")
    )


@query("m10_nearest_square", "", """
SELECT DISTINCT CAST(l_partkey AS BIGINT) AS n, CAST(ceil(sqrt(l_partkey)) AS INT) AS side FROM lineitem""")
def m10(t):
    keys = t.spark.read.parquet(f"{t.sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("n")).distinct()
    return keys.select("n", M.nearest_square("n").alias("side"))


STACK_SQL = """sides AS (SELECT *, greatest(ni, nj) AS pix, CAST(ceil(sqrt(nk)) AS INT) AS big_n, CAST(ceil(nk / ceil(sqrt(nk))) AS INT) AS big_m FROM dims),
px AS (SELECT *, unnest(range(0, big_n * pix)) AS row FROM sides),
py AS (SELECT *, unnest(range(0, big_m * pix)) AS col FROM px),
pixels AS (SELECT subject, row, col, floor(row / pix) * big_m + floor(col / pix) AS tile, row % pix - floor((pix - ni) / 2) AS i,
  col % pix - floor((pix - nj) / 2) AS j, nk, pix, big_m FROM py)"""


@query("m11_mosaic", "voxels4d dims", f"""+ {B0_SQL}, {STACK_SQL}
SELECT p.subject, CAST(p.row AS INT) AS row, CAST(p.col AS INT) AS col, CASE WHEN tile >= nk THEN NULL ELSE coalesce(b0.value, 0) END AS value
FROM pixels p LEFT JOIN b0 ON b0.subject = p.subject AND b0.k = p.tile AND b0.i = p.i AND b0.j = p.j""")
def m11(t):
    _, pixels = MO.stack_mosaic(_b0(t), t.dims)
    return pixels.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


@query("m12_inverse_mosaic", "dims", f"""+ {STACK_SQL}
SELECT subject, CAST(row AS INT) AS row, CAST(col AS INT) AS col, CAST(tile AS INT) AS tile, CAST(floor(tile / big_m) AS INT) AS tile_row,
  CAST(tile % big_m AS INT) AS tile_col FROM pixels""")
def m12(t):
    side = F.greatest("ni", "nj")
    layout = MO.mosaic_layout(t.dims, side, F.col("nk"))
    rows = layout.select("*", F.explode(F.sequence(F.lit(0), F.col("N") * F.col("pix") - 1)).alias("row"))
    pixels = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("M") * F.col("pix") - 1)).alias("col"))
    tiled = pixels.withColumn("tile", MO.pixel_tile("row", "col", "pix", "M"))
    down, right = MO.tile_offset("tile", "M")
    return tiled.select("subject", "row", "col", "tile", down.alias("tile_row"), right.alias("tile_col"))


@query("m13_planes", "voxels4d dims", """
SELECT v.subject, 'sagittal' AS plane, CAST(t AS INT) AS t, CAST(j AS INT) AS px, CAST(nk - 1 - k AS INT) AS py, value FROM voxels4d v JOIN dims d ON v.subject = d.subject WHERE i = 3
UNION ALL SELECT v.subject, 'coronal', CAST(t AS INT), CAST(i AS INT), CAST(nk - 1 - k AS INT), value FROM voxels4d v JOIN dims d ON v.subject = d.subject WHERE j = 4
UNION ALL SELECT v.subject, 'axial', CAST(t AS INT), CAST(j AS INT), CAST(i AS INT), value FROM voxels4d v JOIN dims d ON v.subject = d.subject WHERE k = 2""")
def m13(t):
    dims = t.dims.drop("nt")
    parts = [
        V.plane(t.voxels4d, dims, kind, at).select("subject", F.lit(kind).alias("plane"), "t", "px", "py", "value")
        for kind, at in (("sagittal", 3), ("coronal", 4), ("axial", 2))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("m14_world_coordinates", "seg image_affines", """
SELECT s.subject, i, j, k, round(a00*(i+1) + a01*(j+1) + a02*(k+1) + a03, 6) AS wx, round(a10*(i+1) + a11*(j+1) + a12*(k+1) + a13, 6) AS wy,
  round(a20*(i+1) + a21*(j+1) + a22*(k+1) + a23, 6) AS wz FROM seg s JOIN image_affines a ON s.subject = a.subject""")
def m14(t):
    world = V.world_coordinates(t.seg.drop("label"), t.image_affines)
    return world.select("subject", "i", "j", "k", *[F.round(c, 6).alias(c) for c in ("wx", "wy", "wz")])


@query("j7_masked", "voxels4d seg", f"""+ {B0_SQL}
SELECT b0.subject, b0.i, b0.j, b0.k, CASE WHEN s.label > 0 THEN b0.value END AS value FROM b0
LEFT JOIN seg s ON b0.subject = s.subject AND b0.i = s.i AND b0.j = s.j AND b0.k = s.k""")
def j7(t):
    out = V.masked(_b0(t), V.binarise(t.seg))
    return out.select("subject", "i", "j", "k", F.when(~F.isnan("value"), F.col("value")).alias("value"))


@query("j13_colormap_value", "colours cmap", """+ entries AS (SELECT r, g, b, min(idx) AS idx FROM cmap GROUP BY r, g, b),
d AS (SELECT DISTINCT r, g, b FROM colours),
best AS (SELECT d.r, d.g, d.b, min({'d': (d.r - e.r) * (d.r - e.r) + (d.g - e.g) * (d.g - e.g) + (d.b - e.b) * (d.b - e.b), 'idx': e.idx}).idx AS idx
  FROM d CROSS JOIN entries e GROUP BY d.r, d.g, d.b)
SELECT c.subject, c.t, c.i, c.j, c.k, b.idx, round(b.idx * 2.0 / ((SELECT count(*) FROM cmap) - 1) - 1, 6) AS mapped
FROM colours c JOIN best b ON c.r = b.r AND c.g = b.g AND c.b = b.b""")
def j13(t):
    out = V.nearest_entry(t.colours, t.cmap, -1.0, 1.0)
    return out.select("subject", "t", "i", "j", "k", "idx", F.round("mapped", 6).alias("mapped"))


@query("j14_regrid_nearest", "seg dims", """+ g AS (SELECT subject, i, j, unnest(range(0, nk)) AS k FROM (
    SELECT *, unnest(range(0, nj)) AS j FROM (SELECT *, unnest(range(0, ni)) AS i FROM dims) AS a) AS b),
n AS (SELECT subject, i, j, k, floor(0.8 * i + 0.1 * j + 0.4 + 0.5) AS si, floor(1.1 * j - 0.7 + 0.5) AS sj, floor(0.9 * k + 0.3 + 0.5) AS sk FROM g)
SELECT n.subject, CAST(n.i AS INT) AS i, CAST(n.j AS INT) AS j, CAST(n.k AS INT) AS k, CAST(coalesce(s.label, 0) AS BIGINT) AS label
FROM n LEFT JOIN seg s ON s.subject = n.subject AND s.i = n.si AND s.j = n.sj AND s.k = n.sk""")
def j14(t):
    entries = [[0.8, 0.1, 0.0, 0.4], [0.0, 1.1, 0.0, -0.7], [0.0, 0.0, 0.9, 0.3], [0.0, 0.0, 0.0, 1.0]]
    affines = t.dims.select("subject", *[F.lit(v).alias(f"a{r}{c}") for r, row in enumerate(entries) for c, v in enumerate(row)])
    out = V.regrid_nearest(t.seg, t.dims.drop("nt"), affines)
    return out.withColumn("label", F.col("label").cast("long"))


OTSU_SQL = """span AS (SELECT subject, min(value) AS lo, max(value) AS hi FROM img GROUP BY subject),
bins AS (SELECT i.subject, lo, hi, CAST(least(coalesce(floor((value - lo) / nullif((hi - lo) / 256, 0)), 0), 255) AS INT) AS bin, count(*) AS n
  FROM img i JOIN span s ON i.subject = s.subject GROUP BY 1, 2, 3, 4),
cent AS (SELECT *, lo + (bin + 0.5) * ((hi - lo) / 256) AS centre FROM bins),
cum AS (SELECT subject, bin, centre, sum(n) OVER (PARTITION BY subject ORDER BY bin) AS n1, sum(n) OVER (PARTITION BY subject) AS na,
  sum(n * centre) OVER (PARTITION BY subject ORDER BY bin) AS m1, sum(n * centre) OVER (PARTITION BY subject) AS ma FROM cent),
var AS (SELECT subject, bin, centre, coalesce(n1 * (na - n1) * power(m1 / n1 - (ma - m1) / nullif(na - n1, 0), 2), 0) AS v FROM cum),
otsu AS (SELECT subject, arg_max(centre, {'v': v, 'b': -bin}) AS threshold FROM var GROUP BY subject)"""


@query("a19_otsu_threshold", "voxels4d", f"+ img AS (SELECT subject, i, j, k, value FROM voxels4d WHERE t = 0), {OTSU_SQL}\nSELECT subject, round(threshold, 4) AS threshold FROM otsu")
def a19(t):
    return V.otsu_threshold(_b0(t)).select("subject", F.round("threshold", 4).alias("threshold"))


@query("a19_foreground_mask", "voxels4d", f"""+ {B0_SQL}, img AS (
  SELECT a.subject, a.i, a.j, a.k, median(b.value) AS value FROM b0 a JOIN b0 b ON a.subject = b.subject
  AND b.i BETWEEN a.i - 2 AND a.i + 2 AND b.j BETWEEN a.j - 2 AND a.j + 2 AND b.k BETWEEN a.k - 2 AND a.k + 2 GROUP BY 1, 2, 3, 4), {OTSU_SQL}
SELECT i.subject, i.i, i.j, i.k, CAST(CASE WHEN value > threshold THEN 1 ELSE 0 END AS DOUBLE) AS value FROM img i JOIN otsu o ON i.subject = o.subject""")
def a19_mask(t):
    return V.foreground_mask(_b0(t), 2, 1)


@query("a20_dilate", "seg dims", """+ m AS (SELECT subject, i, j, k FROM seg WHERE label = 1),
o AS (SELECT a - 1 AS di, b - 1 AS dj, c - 1 AS dk FROM range(3) x(a), range(3) y(b), range(3) z(c)),
n AS (SELECT DISTINCT subject, i + di AS i, j + dj AS j, k + dk AS k FROM m CROSS JOIN o)
SELECT n.subject, CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(k AS INT) AS k FROM n JOIN dims d ON n.subject = d.subject
WHERE i >= 0 AND i < ni AND j >= 0 AND j < nj AND k >= 0 AND k < nk""")
def a20(t):
    value = F.when(F.col("label") == 1, F.lit(1.0)).otherwise(F.lit(0.0))
    return V.dilate(t.seg.withColumn("value", value), t.dims.drop("nt"))


@query("a21_median_filter", "voxels4d", f"""+ {B0_SQL}
SELECT a.subject, a.i, a.j, a.k, round(median(b.value), 4) AS value FROM b0 a JOIN b0 b ON a.subject = b.subject
AND b.i BETWEEN a.i - 2 AND a.i + 2 AND b.j BETWEEN a.j - 2 AND a.j + 2 AND b.k BETWEEN a.k - 2 AND a.k + 2 GROUP BY 1, 2, 3, 4""")
def a21(t):
    return V.median_filter(_b0(t), 2).withColumn("value", F.round("value", 4))


@query("m19_grey_scale", "voxels4d", """+ s AS (SELECT subject, min(value) AS lo, max(value) AS hi FROM voxels4d GROUP BY subject)
SELECT v.subject, t, i, j, k, round((value - lo) / nullif(hi - lo, 0) * 255, 6) AS grey FROM voxels4d v JOIN s ON v.subject = s.subject""")
def m19(t):
    return V.grey_scale(t.voxels4d).select("subject", "t", "i", "j", "k", F.round("grey", 6).alias("grey"))


def _series(t):
    oriented = _oriented(t).select("subject", "t", "i", "j", "k", "value")
    return MO.series_pixels(oriented, _oriented_dims(t))


SERIES_SQL = f"""{ORIENTED_SQL},
odims AS (SELECT DISTINCT i.subject, ni, nj, nk, d.nt - 1 AS nt FROM ipl i JOIN (SELECT subject, nt FROM dims) d ON i.subject = d.subject),
kinds AS (
  SELECT subject, 'ax' AS orientation, nj AS nr, nk AS nc, nt FROM odims UNION ALL
  SELECT subject, 'cor', ni, nk, nt FROM odims UNION ALL SELECT subject, 'sag', ni, nj, nt FROM odims),
lay AS (SELECT *, greatest(nr, nc) AS pix, CAST(ceil(sqrt(nt)) AS INT) AS big_n, CAST(ceil(nt / ceil(sqrt(nt))) AS INT) AS big_m FROM kinds)"""

MIDDLE_SQL = """mid AS (
  SELECT subject, 'ax' AS orientation, t - 1 AS t, j AS r, k AS c, value FROM ipl WHERE i = floor(ni / 2) AND t >= 1 UNION ALL
  SELECT subject, 'cor', t - 1, i, k, value FROM ipl WHERE j = floor(nj / 2) AND t >= 1 UNION ALL
  SELECT subject, 'sag', t - 1, i, j, value FROM ipl WHERE k = floor(nk / 2) AND t >= 1),
sx AS (SELECT *, unnest(range(0, big_n * pix)) AS row FROM lay),
sy AS (SELECT *, unnest(range(0, big_m * pix)) AS col FROM sx),
sp AS (SELECT subject, orientation, row, col, nt, floor(row / pix) * big_m + floor(col / pix) AS tile,
  row % pix - floor((pix - nr) / 2) AS r, col % pix - floor((pix - nc) / 2) AS c FROM sy)"""


@query("n5_series_layouts", "image_affines", f"""+ {SERIES_SQL}
SELECT subject, orientation, big_n AS N, big_m AS M, CAST(pix AS INT) AS pix, CAST(nt AS INT) AS num_slices, '4dsprite' AS img_type FROM lay""")
def n5_layouts(t):
    return MO.series_layouts(_oriented_dims(t))


@query("n5_series_sprites", "image_affines", f"""+ {SERIES_SQL}, {MIDDLE_SQL}
SELECT p.subject, p.orientation, CAST(p.row AS INT) AS row, CAST(p.col AS INT) AS col, CASE WHEN tile >= nt THEN NULL ELSE coalesce(m.value, 0) END AS value
FROM sp p LEFT JOIN mid m ON m.subject = p.subject AND m.orientation = p.orientation AND m.t = p.tile AND m.r = p.r AND m.c = p.c""")
def n5(t):
    return _series(t).withColumn("value", F.when(~F.isnan("value"), F.col("value")))


@query("u5_sprite_lines", "image_affines", f"""+ {SERIES_SQL}, {MIDDLE_SQL},
f AS (SELECT p.subject, p.orientation, p.row, p.col, CASE WHEN tile >= nt THEN NULL ELSE coalesce(m.value, 0) END AS value
  FROM sp p LEFT JOIN mid m ON m.subject = p.subject AND m.orientation = p.orientation AND m.t = p.tile AND m.r = p.r AND m.c = p.c)
SELECT subject, orientation, CAST(row AS INT) AS row, CAST(count(*) AS INT) AS width, round(sum(value), 4) AS total FROM f GROUP BY subject, orientation, row""")
def u5(t):
    lines = MO.mosaic_lines(_series(t))
    total = F.aggregate(
        F.filter("pixels", lambda v: ~F.isnan(v)), F.lit(None).cast("double"), lambda acc, v: F.coalesce(acc, F.lit(0.0)) + v
    )
    return lines.select("subject", "orientation", "row", F.size("pixels").alias("width"), F.round(total, 4).alias("total"))


def _median_sql(source: str, out: str, radius: int) -> str:
    """One pass of the median over the neighbourhood that is present."""
    near = " AND ".join(f"b.{x} BETWEEN a.{x} - {radius} AND a.{x} + {radius}" for x in "ijk")
    return (f"{out} AS MATERIALIZED (SELECT a.subject, a.i, a.j, a.k, median(b.value) AS value FROM {source} a JOIN {source} b "
            f"ON a.subject = b.subject AND {near} GROUP BY 1, 2, 3, 4)")


# Four passes of radius 4, as the mask step of the sprites does.
MEDIANS_SQL = ", ".join(_median_sql(a, b, 4) for a, b in zip(("dense", "med1", "med2", "med3"), ("med1", "med2", "med3", "img")))


# Sprites of one image: b0, a colour image from the colour fixture, and the segmentation as mask.
STILL_SQL = f"""{STACK_SQL}, {B0_SQL},
cells AS (SELECT subject, CAST(tile AS INT) AS k, row, col, i, j, CAST(row % pix AS INT) AS pi, CAST(col % pix AS INT) AS pj, nk FROM pixels),
dense AS (SELECT c.subject, c.k, c.pi AS i, c.pj AS j, coalesce(b0.value, 0) AS value FROM cells c
  LEFT JOIN b0 ON b0.subject = c.subject AND b0.k = c.k AND b0.i = c.i AND b0.j = c.j WHERE c.k < nk),
{MEDIANS_SQL}, {OTSU_SQL},
fg AS (SELECT i.subject, i.i, i.j, i.k, value > threshold AS inside FROM img i JOIN otsu o ON i.subject = o.subject),
chan AS (SELECT subject, i, j, k, unnest(['r', 'g', 'b']) AS channel, unnest([r, g, b]) AS value FROM colours WHERE t = 0),
cc AS (SELECT cells.*, unnest(['r', 'g', 'b']) AS channel FROM cells)"""


@query("n4_still_sprites", "dims seg colours", f"""+ {STILL_SQL}
SELECT c.subject, 'b0' AS image, '' AS channel, CAST(row AS INT) AS row, CAST(col AS INT) AS col, CASE WHEN c.k < nk THEN coalesce(b0.value, 0) END AS value
FROM cells c LEFT JOIN b0 ON b0.subject = c.subject AND b0.k = c.k AND b0.i = c.i AND b0.j = c.j
UNION ALL SELECT c.subject, 'anat_mask', '', CAST(row AS INT), CAST(col AS INT), CASE WHEN c.k < nk THEN CAST(coalesce(s.label, 0) > 0 AS INT) END
FROM cells c LEFT JOIN seg s ON s.subject = c.subject AND s.k = c.k AND s.i = c.i AND s.j = c.j
UNION ALL SELECT c.subject, 'colorFA', c.channel, CAST(row AS INT), CAST(col AS INT), CASE WHEN c.k < nk AND f.inside THEN coalesce(x.value, 0) END
FROM cc c LEFT JOIN fg f ON f.subject = c.subject AND f.k = c.k AND f.i = c.pi AND f.j = c.pj
LEFT JOIN chan x ON x.subject = c.subject AND x.k = c.k AND x.i = c.i AND x.j = c.j AND x.channel = c.channel""")
def n4(t):
    colours = t.colours.filter("t = 0")
    channels = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("value")) for c in MO.CHANNELS]))
    colour_image = colours.select("subject", "i", "j", "k", channels.alias("v")).select("subject", "i", "j", "k", "v.*")
    mask = V.binarise(t.seg).select("subject", "i", "j", "k", "value")
    pixels = MO.still_pixels(_b0(t), colour_image, mask, t.dims)
    return pixels.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


@query("n4_still_layouts", "dims", f"""+ {STACK_SQL.split(',')[0]}, greatest(ni, nj) AS pix, CAST(ceil(sqrt(nk)) AS INT) AS big_n, CAST(ceil(nk / ceil(sqrt(nk))) AS INT) AS big_m FROM dims)
SELECT subject, image, big_n AS N, big_m AS M, CAST(pix AS INT) AS pix, nk AS num_slices, CASE WHEN image <> 'anat_mask' THEN 'brainsprite' END AS img_type
FROM (SELECT *, unnest(['b0', 'colorFA', 'anat_mask']) AS image FROM sides) AS s""")
def n4_layouts(t):
    return MO.still_layouts(t.dims)
