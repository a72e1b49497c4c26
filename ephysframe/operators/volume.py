"""Labelled 3-D volume as a long-form voxel table.

A voxel table has integer indices ``ml, dv, ap`` and a ``structure_id``
(0 = background; absent rows are background too). Images come back in long
form ``(y, x, r, g, b, a)`` with only the non-empty pixels, which is how a
distributed table holds a sparse image. Global maxima used for
normalisation are scalar subqueries: one small aggregate job whose single
value is inlined, never an unpartitioned window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ephysframe.functions import clamp01

# Atlas resolution and axis conventions.
RESOLUTION_UM = 25
AXES = ("ml", "dv", "ap")
PROJECTION_TO_AXIS = {"sagittal": "ml", "coronal": "ap", "horizontal": "dv"}
PROJECTION_YX = {"sagittal": ("dv", "ap"), "coronal": ("dv", "ml"), "horizontal": ("ap", "ml")}
GREY = 0.6


def _num(v: int | float | Column) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def axis_size(voxels: DataFrame, axis: str) -> Column:
    """Extent of the rows present along ``axis`` (max index + 1) as a scalar
    subquery. Only for a volume whose shape is not known: empty outer planes
    have no rows."""
    return voxels.select((F.max(axis) + 1).alias(f"n_{axis}")).scalar()


def midline(n_ml: int | Column) -> Column:
    """Midline in micrometres: resolution × 0.5 × number of ml planes."""
    return F.lit(RESOLUTION_UM * 0.5) * _num(n_ml)


def hemisphere(voxels: DataFrame, side: str = "left", n_ml: int | Column | None = None) -> DataFrame:
    """left = ``ml < n_ml // 2``, right = ``ml >= n_ml // 2``, both = all.
    ``n_ml`` is the volume's number of ml planes, empty ones included."""
    if side == "both":
        return voxels
    if n_ml is None:
        raise ValueError("a side needs the number of ml planes")
    half = F.floor(_num(n_ml) / 2)
    if side == "left":
        return voxels.where(F.col("ml") < half)
    if side == "right":
        return voxels.where(F.col("ml") >= half)
    raise ValueError(f"side must be left, right or both, not {side!r}")


def volume_ids(voxels: DataFrame, side: str = "left", n_ml: int | Column | None = None) -> DataFrame:
    """Distinct labels (column ``id``) in the chosen hemisphere.

    Absent voxels are background, so 0 is included whenever the volume
    table holds explicit zeros."""
    return hemisphere(voxels, side, n_ml).select(F.col("structure_id").alias("id")).distinct()


def region_mask(
    voxels: DataFrame,
    structure_ids: DataFrame | None = None,
    *,
    side: str = "left",
    n_ml: int | Column | None = None,
) -> DataFrame:
    """C17: voxels whose label is in ``structure_ids`` (column ``id``), e.g. the
    output of ``tree.frontier_descendants``; with no ids, every labelled voxel.
    The membership test is a semi-join (AQE broadcasts the id set when small)."""
    v = hemisphere(voxels, side, n_ml)
    if structure_ids is None:
        return v.where(F.col("structure_id") > 0)
    return v.join(structure_ids.select(F.col("id").alias("structure_id")).distinct(), "structure_id", "left_semi")


def project(
    mask: DataFrame,
    projection: str = "horizontal",
    *,
    depth_size: int | Column,
    center: int | Column | None = None,
    thickness: int | Column | None = None,
    with_opacity: bool = True,
    rgb: tuple[float, float, float] | tuple[Column, Column, Column] | None = None,
    normalize_rgb: bool = True,
) -> DataFrame:
    """Project a mask through a slab along the projection's depth axis.

    Slab ``[max(round(c - t/2), 0), min(round(c + t/2) + 1, n))`` with
    half-to-even rounding; defaults ``c = n // 2`` and ``t = n``. Alpha is
    the voxel count per pixel divided by the image maximum, or 1 when
    ``with_opacity`` is off. Colour is ``rgb`` (0..1) or grey, ×255 unless
    ``normalize_rgb``.
    """
    depth = PROJECTION_TO_AXIS[projection]
    y, x = PROJECTION_YX[projection]
    lo, hi = _slab(depth_size, center, thickness)
    slab = mask.where((F.col(depth) >= lo) & (F.col(depth) < hi))
    counts = slab.groupBy(F.col(y).alias("y"), F.col(x).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    return _image(counts, with_opacity, rgb, normalize_rgb)


def _slab(depth_size: int | Column, center: int | Column | None, thickness: int | Column | None) -> tuple[Column, Column]:
    n = _num(depth_size)
    c = F.floor(n / 2) if center is None else _num(center)
    t = n if thickness is None else _num(thickness)
    return F.greatest(F.bround(c - 0.5 * t, 0), F.lit(0)), F.least(F.bround(c + 0.5 * t, 0) + 1, n)


def _image(counts: DataFrame, with_opacity: bool, rgb: tuple | None, normalize_rgb: bool) -> DataFrame:
    """Pixels ``(y, x, r, g, b, a)`` of the voxel counts ``(y, x, n)``."""
    if with_opacity:
        peak = counts.select(F.max("n")).scalar()
        alpha = F.try_divide(F.col("n").cast("double"), peak)
    else:
        alpha = F.lit(1.0)
    colour = [GREY] * 3 if rgb is None else list(rgb)
    scale = 1.0 if normalize_rgb else 255.0
    return counts.select(
        "y", "x",
        *[(_num(v) * scale).cast("double").alias(name) for v, name in zip(colour, ("r", "g", "b"))],
        alpha.alias("a"),
    )


def running_counts(mask: DataFrame, projection: str = "horizontal", *, depth_size: int | Column) -> DataFrame:
    """``(y, x, upto)`` of a mask: a row for each pixel that is not empty.

    ``upto[i]`` is the number of the pixel's voxels at depths below ``i``, for
    ``i`` from 0 to ``depth_size``; voxels beyond the volume do not count.
    Written as a table it serves every slab of the projection
    (:func:`project_counts`) without the voxels. A pixel's windows and array
    hold at most the planes of the depth axis.
    """
    depth = PROJECTION_TO_AXIS[projection]
    y, x = PROJECTION_YX[projection]
    n = _num(depth_size).cast("int")
    planes = (
        mask.where((F.col(depth) >= 0) & (F.col(depth) < n))
        .groupBy(F.col(y).alias("y"), F.col(x).alias("x"), F.col(depth).cast("int").alias("d"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    column = Window.partitionBy("y", "x").orderBy("d")
    below = F.sum("n").over(column.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    steps = planes.select("y", "x", "d", below.alias("c"), (F.coalesce(F.lead("d").over(column), n) - F.col("d")).alias("planes"))
    steps = steps.groupBy("y", "x").agg(F.array_sort(F.collect_list(F.struct("d", "c", "planes"))).alias("s"))
    empty = F.array_repeat(F.lit(0).cast("long"), F.get("s", 0)["d"] + 1)
    filled = F.flatten(F.transform("s", lambda e: F.array_repeat(e["c"], e["planes"])))
    return steps.select("y", "x", F.concat(empty, filled).alias("upto"))


def project_counts(
    running: DataFrame,
    *,
    depth_size: int | Column,
    center: int | Column | None = None,
    thickness: int | Column | None = None,
    with_opacity: bool = True,
    rgb: tuple[float, float, float] | tuple[Column, Column, Column] | None = None,
    normalize_rgb: bool = True,
) -> DataFrame:
    """C18 from :func:`running_counts`: the image of :func:`project` for any
    centre and thickness, two array lookups a pixel and no shuffle of them."""
    lo, hi = (b.cast("int") for b in _slab(depth_size, center, thickness))
    counts = running.select("y", "x", (F.get("upto", hi) - F.get("upto", F.least(lo, hi))).alias("n")).where(F.col("n") > 0)
    return _image(counts, with_opacity, rgb, normalize_rgb)


def scatter_density(
    locations: DataFrame,
    projection: str = "horizontal",
    *,
    image_shape: tuple[int | Column, int | Column] | None = None,
    volume_shape: dict[str, int] | None = None,
    opacity_range: tuple[float, float] = (0.8, 1.0),
    rgb: tuple[float, float, float] = (1.0, 1.0, 1.0),
) -> DataFrame:
    """2-D histogram of unit positions in 25 µm bins, as an alpha image.

    Bins are ``[i, i+1)`` with the last bin closed at its right edge; points
    outside the image are dropped. Alpha = lo + (hi - lo) · n / max(n),
    zero at or below lo, clamped to [0, 1]; a zero-width range gives 0/1.
    Without ``image_shape`` the image has the shape of the projection of the
    left half of a volume of ``volume_shape`` (planes by axis). Pixels with
    points are white by default; the atlas view draws the
    tracks of missed insertions black (``rgb=(0, 0, 0)``).
    """
    lo, hi = opacity_range
    if hi < lo:
        raise ValueError(f"opacity_range must be increasing, got {opacity_range}")
    y, x = PROJECTION_YX[projection]
    if image_shape is None:
        if volume_shape is None:
            raise ValueError("give the image's shape or the volume's")
        half = {**volume_shape, "ml": volume_shape["ml"] // 2}
        image_shape = (half[y], half[x])
    h, w = (_num(s) for s in image_shape)
    fy = F.col(f"ccf_{y}") / RESOLUTION_UM
    fx = F.col(f"ccf_{x}") / RESOLUTION_UM

    def bin_of(v: Column, size: Column) -> Column:
        return F.when(v == size, size - 1).otherwise(F.floor(v)).cast("long")

    binned = (
        locations.where(fy.isNotNull() & fx.isNotNull() & (fy >= 0) & (fy <= h) & (fx >= 0) & (fx <= w))
        .select(bin_of(fy, h).alias("y"), bin_of(fx, w).alias("x"))
        .groupBy("y", "x")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if hi == lo:
        alpha = F.lit(1.0)
    else:
        peak = binned.select(F.max("n")).scalar()
        raw = F.lit(lo) + F.lit(hi - lo) * (F.col("n") / peak)
        alpha = clamp01(F.when(raw <= lo, F.lit(0.0)).otherwise(raw))
    img = binned.select("y", "x", alpha.alias("a")).where(F.col("a") > 0)
    return img.select("y", "x", *[F.lit(float(v)).alias(ch) for v, ch in zip(rgb, ("r", "g", "b"))], "a")
