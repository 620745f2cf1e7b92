"""Box geometry. Boxes are (ymin, xmin, ymax, xmax) on a 0-1000 grid unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORNERS = ["ymin", "xmin", "ymax", "xmax"]


def corners(prefix: str = "") -> list[Column]:
    return [F.col(prefix + c) for c in CORNERS]


def box_area(b: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(b["ymax"] - b["ymin"], zero) * F.greatest(b["xmax"] - b["xmin"], zero)


def overlap_area(a: Column, b: Column) -> Column:
    """Shared area of two box structs, 0 when they only touch."""
    zero = F.lit(0.0)
    height = F.least(a["ymax"], b["ymax"]) - F.greatest(a["ymin"], b["ymin"])
    width = F.least(a["xmax"], b["xmax"]) - F.greatest(a["xmin"], b["xmin"])
    return F.greatest(height, zero) * F.greatest(width, zero)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two box structs."""
    shared = overlap_area(a, b)
    union = box_area(a) + box_area(b) - shared
    return F.when((shared > 0) & (union > 0), shared / union).otherwise(0.0)


def touches(a: Column, b: Column) -> Column:
    """Do two boxes share any area? Stops at the first side that keeps them apart."""
    return (a["ymin"] < b["ymax"]) & (b["ymin"] < a["ymax"]) & (a["xmin"] < b["xmax"]) & (b["xmin"] < a["xmax"])


def with_centre(boxes: DataFrame) -> DataFrame:
    return boxes.withColumns({"cx": (F.col("xmin") + F.col("xmax")) / 2, "cy": (F.col("ymin") + F.col("ymax")) / 2})


def centre_distance(a: Column, b: Column) -> Column:
    """Distance of two structs with ``cx`` and ``cy``."""
    dx, dy = a["cx"] - b["cx"], a["cy"] - b["cy"]
    return F.sqrt(dx * dx + dy * dy)


def to_pixels(ymin: Column, xmin: Column, ymax: Column, xmax: Column, width: Column, height: Column) -> list[Column]:
    """0-1000 corners as x1, y1, x2, y2 in pixels."""
    k = F.lit(1000.0)
    return [xmin / k * width, ymin / k * height, xmax / k * width, ymax / k * height]


def from_pixels(y1: Column, x1: Column, y2: Column, x2: Column, width: Column, height: Column) -> list[Column]:
    """Pixel corners as ymin, xmin, ymax, xmax on the 0-1000 grid."""
    k = F.lit(1000.0)
    return [y1 / height * k, x1 / width * k, y2 / height * k, x2 / width * k]


def to_percent(ymin: Column, xmin: Column, ymax: Column, xmax: Column) -> list[Column]:
    """0-1000 corners as x, y, width, height in percent."""
    ten = F.lit(10.0)
    return [xmin / ten, ymin / ten, (xmax - xmin) / ten, (ymax - ymin) / ten]


def unit_to_pixels(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    """Annotation boxes (x, y, w, h in 0-1) as pixels."""
    return [x * width, y * height, w * width, h * height]


def is_box(bbox: Column) -> Column:
    """An array with all four numbers."""
    return F.coalesce((F.size(bbox) == 4) & ~F.exists(bbox, lambda v: v.isNull()), F.lit(False))


def valid_boxes(detections: Column) -> Column:
    """Keep the array elements whose ``bbox_2d`` is complete."""
    return F.filter(detections, lambda d: is_box(d["bbox_2d"]))


def with_tile(rows: DataFrame, grid: int = 3, overlap: float = 0.10) -> DataFrame:
    """Add the place of tile ``tile_idx`` (x, y, w, h in pixels, row-major) in the ``width`` x ``height`` of each row.

    Offsets are cut to whole pixels after each product, in the order written here. Tile -1 is the whole image.
    """
    share = 1.0 / grid

    def whole(c: Column) -> Column:
        return F.floor(c).cast("int")

    def start(side: str, step: Column) -> Column:
        lead = F.when(step > 0, whole(F.col(side) * F.lit(overlap) / 2)).otherwise(0)
        return F.greatest(whole(F.col(side) * F.lit(share) * step) - lead, F.lit(0))

    def stop(side: str, at: str) -> Column:
        return F.least(F.col(side), F.col(at) + whole(F.col(side) * F.lit(share + overlap)))

    idx = F.col("tile_idx").cast("int")
    return (
        rows.withColumn("tile_x", F.when(idx < 0, 0).otherwise(start("width", idx % grid)))
        .withColumn("tile_y", F.when(idx < 0, 0).otherwise(start("height", F.floor(idx / grid).cast("int"))))
        .withColumn("tile_w", F.when(idx < 0, F.col("width").cast("int")).otherwise(stop("width", "tile_x") - F.col("tile_x")))
        .withColumn("tile_h", F.when(idx < 0, F.col("height").cast("int")).otherwise(stop("height", "tile_y") - F.col("tile_y")))
    )


def add_tiles(images: DataFrame, grid: int = 3, overlap: float = 0.10) -> DataFrame:
    """One row per tile (idx, x, y, w, h in pixels, row-major) of each image's ``width`` x ``height``."""
    return with_tile(images.withColumn("tile_idx", F.explode(F.sequence(F.lit(0), F.lit(grid * grid - 1)))), grid, overlap)


def rebase(detections: DataFrame) -> DataFrame:
    """Move tile-local corners to the whole image.

    Needs width, height and the four tile columns of :func:`with_tile`. A row with an incomplete box
    stays as it is. ``tile_idx`` -1 marks a call on the whole image.
    """
    k = F.lit(1000.0)
    whole_box = F.lit(True)
    for c in corners():
        whole_box = whole_box & c.isNotNull()
    moved = {}
    for c in CORNERS:
        tile_side, offset, side = ("tile_h", "tile_y", "height") if c[0] == "y" else ("tile_w", "tile_x", "width")
        moved[c] = F.when(
            whole_box, (F.col(c) / k * F.col(tile_side) + F.col(offset)) / F.col(side) * k
        ).otherwise(F.col(c))
    source = F.when(F.col("tile_idx") < 0, "overview").otherwise(
        F.concat(F.lit("tile_"), F.col("tile_idx").cast("string"))
    )
    return detections.withColumns({**moved, "found_in": F.when(whole_box, source)})
