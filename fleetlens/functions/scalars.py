"""Row-level expressions. Every function takes and returns Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.functions import vocab as V


def lookup(key: Column, table: dict, default: Column | None = None) -> Column:
    """A literal CASE over a small fixed table."""
    expr = None
    for k, v in table.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr.otherwise(default if default is not None else F.lit(None))


def filled(c: Column) -> Column:
    """NULL for blank text, so that ``coalesce`` skips both."""
    return F.nullif(c, F.lit(""))


def slug(name: Column) -> Column:
    """File-system form of a plate: other characters become ``_``, none at the ends."""
    return F.trim(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), F.lit("_"))


def session_slug(plate: Column) -> Column:
    """Session-folder form of a plate: other characters are dropped, ``no-plate`` if none is left."""
    kept = F.regexp_replace(F.coalesce(plate, F.lit("")), "[^A-Za-z0-9-]", "")
    return F.coalesce(filled(kept), F.lit("no-plate"))


def session_folder(started: Column, plate: Column, suffix: Column) -> Column:
    return F.concat_ws("_", F.date_format(started, "yyyy-MM-dd_HH-mm-ss"), session_slug(plate), suffix)


def view_of(filename: Column) -> Column:
    """The first known view named in the file name."""
    expr = F.when(filename.contains(V.VIEWS[0]), V.VIEWS[0])
    for view in V.VIEWS[1:]:
        expr = expr.when(filename.contains(view), view)
    return expr.when(filename.rlike(V.LEGACY_NAME), V.LEGACY_VIEW).otherwise(V.UNKNOWN_VIEW)


def min_side() -> Column:
    return F.least("width", "height")


def hard_fail_reasons() -> Column:
    """Why an image is unusable; an empty array if it is fine. All limits are strict."""
    dark, bright = V.BRIGHTNESS_RANGE
    checks = [
        (min_side() < V.MIN_SIDE, "low_resolution"),
        (F.col("sharpness") < V.MIN_SHARPNESS, "very_blurry"),
        (F.col("brightness") < dark, "too_dark"),
        (F.col("brightness") > bright, "too_bright"),
        (F.col("overexp_pct") > V.MAX_OVEREXPOSED, "burnt_out"),
        (F.col("underexp_pct") > V.MAX_UNDEREXPOSED, "black_out"),
        (F.col("saturation") < V.MIN_SATURATION, "monochrome"),
    ]
    return F.array_compact(F.array(*[F.when(cond, reason) for cond, reason in checks]))


def damage_class(type_: Column) -> Column:
    return lookup(type_, V.CLASS_OF_TYPE, F.lit("other"))


def damage_part(localized: Column, raw: Column) -> Column:
    return F.coalesce(filled(localized), filled(raw), F.lit("?"))


def damage_severity(localized: Column, raw: Column) -> Column:
    text = F.coalesce(filled(localized), filled(raw), F.lit(""))
    return F.lower(F.replace(F.replace(text, F.lit("SEVERITY_"), F.lit("")), F.lit("_"), F.lit(" ")))


def is_exterior(photo_type: Column) -> Column:
    return F.coalesce(photo_type.isin(V.EXTERIOR_TYPES), F.lit(False))


def exterior_filename(task_id: Column, photo_type: Column, idx: Column) -> Column:
    number = idx.cast("string")
    return F.when(
        photo_type == V.LEGACY_PHOTO_TYPE, F.concat(task_id, F.lit("_"), number, F.lit(".jpg"))
    ).otherwise(F.concat(task_id, F.lit("_"), photo_type, F.lit("_"), number, F.lit(".jpg")))


def damage_filename(photo_type: Column, photo_id: Column) -> Column:
    return F.concat(F.coalesce(photo_type, F.lit("UNKNOWN")), F.lit("__"), photo_id, F.lit(".jpeg"))


def session_filename(idx: Column, view: Column) -> Column:
    return F.format_string("%02d_%s.jpg", idx, view)


def group_allowed(group: Column) -> Column:
    """False for damage groups outside the taxonomy; a missing group stays."""
    return ~F.coalesce(group, F.lit("")).isin(V.EXCLUDED_GROUPS)


def signature_time(url: Column) -> Column:
    """Signing time in a download link; links without one sort last."""
    found = F.regexp_extract(url, r"X-Amz-Date=(\d{8}T\d{6}Z)", 1)
    return F.when(found == "", "99999999T999999Z").otherwise(found)


def safe_timestamp(text: Column) -> Column:
    """Zone-less ISO text as a timestamp, NULL when it is blank or malformed."""
    shaped = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$"), text)
    return F.try_to_timestamp(shaped, F.lit("yyyy-M-d'T'H:m:s"))


def is_retryable(status: Column, error: Column) -> Column:
    """Would a logged failure have been tried again?"""
    text = F.lower(F.coalesce(error, F.lit("")))
    by_text = F.lit(False)
    for phrase in V.NETWORK_PHRASES:
        by_text = by_text | text.contains(phrase)
    by_status = F.coalesce((status == 0) | (status == 429) | (status >= 500), F.lit(False))
    return by_status | by_text


def usd_cost(model: Column, prompt_tokens: Column, completion_tokens: Column, prices: dict | None = None) -> Column:
    """Token cost; unknown models cost nothing."""
    prices = V.PRICES if prices is None else prices
    per_prompt = lookup(model, {k: float(p[0]) for k, p in prices.items()}, F.lit(0.0))
    per_completion = lookup(model, {k: float(p[1]) for k, p in prices.items()}, F.lit(0.0))
    million = F.lit(1000000.0)
    return prompt_tokens / million * per_prompt + completion_tokens / million * per_completion


def price_key(model_key: Column) -> Column:
    """Every model key but ``flash`` is billed as the large model."""
    return F.when(model_key == "flash", "flash").otherwise("pro")


def position_hint(ymin: Column, xmin: Column, ymax: Column, xmax: Column) -> Column:
    """A 3x3 location text from the box centre; unknown when the box is incomplete."""
    cy, cx = (ymin + ymax) / 2.0, (xmin + xmax) / 2.0
    row = F.when(cy < 333, V.ROW_TEXT[0]).when(cy > 666, V.ROW_TEXT[2]).otherwise(V.ROW_TEXT[1])
    column = F.when(cx < 333, V.COLUMN_TEXT[0]).when(cx > 666, V.COLUMN_TEXT[2]).otherwise(V.COLUMN_TEXT[1])
    whole = ymin.isNotNull() & xmin.isNotNull() & ymax.isNotNull() & xmax.isNotNull()
    return F.when(whole, F.concat_ws(" ", row, column)).otherwise(V.UNKNOWN_POSITION)


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def label_text(label: Column) -> Column:
    return lookup(label, V.LABEL_TEXT, capitalised(F.replace(label, F.lit("_"), F.lit(" "))))


def severity_text(severity: Column) -> Column:
    return lookup(F.lower(severity), V.SEVERITY_TEXT, severity)


def panel_text(panel: Column) -> Column:
    return capitalised(F.trim(F.replace(panel, F.lit("_"), F.lit(" "))))


def config_badge(model: Column, max_side: Column, tile_mode: Column) -> Column:
    return F.concat_ws(
        " · ",
        lookup(model, V.MODEL_TEXT, model),
        F.when(max_side > 0, max_side.cast("string")).otherwise("Res?"),
        F.when(tile_mode, "Tile").otherwise("Single"),
    )


def base_model(model: Column) -> Column:
    return F.split_part(model, F.lit("#"), F.lit(1))


def is_tiled(model: Column) -> Column:
    return model.endswith("#tiled")


def scan_image_id(image_id: Column) -> Column:
    """``branch::pull::session::file`` split up; NULL when the text has another shape."""
    parts = F.split(image_id, "::")
    stem = F.regexp_replace(parts[3], r"\.[^.]*$", "")
    return F.when(
        (F.size(parts) == 4) & (parts[0] == "branch"),
        F.struct(
            parts[1].alias("pull_id"), parts[2].alias("session_id"), parts[3].alias("filename"),
            F.regexp_replace(stem, r"^\d+_", "").alias("view"),
        ),
    )


def known_label(label: Column) -> Column:
    return F.when(label.isin(V.DAMAGE_CLASSES), label).otherwise("other")


def round_even(x: Column, digits: int) -> Column:
    """Round half to even at ``digits`` decimals, as numpy does."""
    k = float(10 ** digits)
    return F.rint(x * F.lit(k)) / F.lit(k)


def truncated(text: Column, n: int = 200) -> Column:
    return F.substring(text, 1, n)


def confidence_route(confidence: Column) -> Column:
    return F.when(confidence > 0.85, "high").when(confidence < 0.5, "low").otherwise("medium")
