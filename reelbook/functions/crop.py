"""Thumbnail geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelbook import constants as C
from reelbook.functions.text import _c


def frame_second(duration: Column | str, time_code: Column | str) -> Column:
    """Whole second of the frame at a fraction of the duration."""
    return (_c(duration) * _c(time_code)).cast("int")


def aspect_crop(width: Column | str, height: Column | str) -> Column:
    """Largest 16:9 box anchored top-left, as struct(width, height)."""
    w, h = _c(width).cast("double"), _c(height).cast("double")
    wide = w / h > F.lit(16.0) / F.lit(9.0)
    return F.struct(
        F.when(wide, h * 16 / 9).otherwise(w).alias("width"),
        F.when(wide, h).otherwise(w * 9 / 16).alias("height"),
    )


def crop_window(x_offset: Column | str, y_offset: Column | str, zoom: Column | str) -> Column:
    """Window cut from the zoomed frame, as struct(left, top, right, bottom)."""
    width = (F.lit(C.FRAME_WIDTH) * _c(zoom)).cast("int")
    height = (F.lit(C.FRAME_HEIGHT) * _c(zoom)).cast("int")
    left = (_c(x_offset) * (width + C.OVERLAY_WIDTH - C.FRAME_WIDTH)).cast("int")
    top = (_c(y_offset) * (height - C.FRAME_HEIGHT)).cast("int")
    return F.struct(
        left.alias("left"),
        top.alias("top"),
        (left + C.FRAME_WIDTH).alias("right"),
        (top + C.FRAME_HEIGHT).alias("bottom"),
    )


def _clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    low = F.lit(low) if isinstance(low, (int, float)) else low
    high = F.lit(high) if isinstance(high, (int, float)) else high
    return F.least(F.greatest(value, low), high)


def normalise_crop(x_offset: Column | str, y_offset: Column | str, zoom: Column | str, *,
                   overlay: int = C.OVERLAY_WIDTH) -> Column:
    """Offsets and zoom pulled back into the frame, as struct(x_offset, y_offset, zoom).

    The box may travel over the part of the frame it does not cover, so an offset beyond [0, 1] is a
    box beyond the frame and goes to that edge. Without zoom there is no travel in height (nor in
    width, without overlay): the offset of a box that had to move is then 0.
    """
    x, y = _c(x_offset), _c(y_offset)
    z = _clamp(_c(zoom), C.ZOOM_MIN, C.ZOOM_MAX)
    stuck = ~(x.between(0.0, 1.0) & y.between(0.0, 1.0)) & (z == 1.0)
    x_in, y_in = _clamp(x, 0.0, 1.0), _clamp(y, 0.0, 1.0)
    return F.struct(
        (x_in if overlay else F.when(stuck, 0.0).otherwise(x_in)).alias("x_offset"),
        F.when(stuck, 0.0).otherwise(y_in).alias("y_offset"),
        z.alias("zoom"),
    )


def logo_size(width: Column | str, height: Column | str) -> Column:
    """Logo scaled to the fixed width, or to the fixed height when that overflows; struct(width, height)."""
    w, h = _c(width), _c(height)
    side = F.lit(C.LOGO_SIDE)
    scaled = (side * h / w).cast("int")
    return F.struct(
        F.when(scaled > side, (side * side / scaled).cast("int")).otherwise(side).alias("width"),
        F.least(scaled, side).alias("height"),
    )


def logo_box(width: Column | str, height: Column | str, centre: tuple[int, int]) -> Column:
    """Scaled logo put around a centre point, as struct(left, top, width, height)."""
    size = logo_size(width, height)
    w, h = size.getField("width"), size.getField("height")
    return F.struct(
        (F.lit(centre[0]) - (w / 2).cast("int")).alias("left"),
        (F.lit(centre[1]) - (h / 2).cast("int")).alias("top"),
        w.alias("width"),
        h.alias("height"),
    )


def title_pos(width: Column | str) -> Column:
    """Place of the title image, as struct(left, top)."""
    left = F.lit(C.FRAME_WIDTH) - F.floor(_c(width) * 3 / 4).cast("int") - C.TITLE_MARGIN
    return F.struct(left.alias("left"), F.lit(C.TITLE_TOP).alias("top"))
