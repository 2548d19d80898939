"""Parsing, provenance and naming columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col, finite

# Words that place a sport in a family, tried in this order.
FAMILY_TERMS = {
    "run": ("run",),
    "ride": ("ride", "cycling", "bike"),
    "ski": ("ski", "snowboard"),
    "foot": ("walk", "hike"),
    "water": ("kayak", "row", "swim", "surf", "water", "paddl", "canoe"),
}
SUPPORTED_SUFFIXES = (".fit", ".fit.gz", ".gpx", ".gpx.gz", ".tcx", ".tcx.gz")
SOURCE_URL = "https://www.strava.com/activities/"
ID_SALT = "strava"
EPOCH = "1970-01-01T00:00:00Z"
NUMBER = r"^\s*[+-]?(\d+(_\d+)*\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}"
LOCAL_DATE = "MMM d, yyyy, h:mm:ss a"


def nonempty(c) -> Column:
    trimmed = F.trim(col(c))
    return F.when(trimmed != "", trimmed)


def first_nonempty(*cells, default: str | None = None) -> Column:
    found = [nonempty(c) for c in cells]
    return F.coalesce(*found, F.lit(default)) if default is not None else F.coalesce(*found)


def parse_number(c) -> Column:
    """Finite double, else null."""
    c = col(c)
    return finite(F.when(c.rlike(NUMBER), F.regexp_replace(c, "_", "")).try_cast("double"))


def parse_activity_timestamp(c) -> Column:
    """ISO text (``Z`` allowed) or ``Jan 02, 2025, 03:04:05 AM``; naive text is UTC."""
    c = F.trim(col(c))
    iso = F.when(c.rlike(ISO_DATE), c).try_cast("timestamp")
    return F.coalesce(iso, F.try_to_timestamp(c, F.lit(LOCAL_DATE)))


def activity_family(sport) -> Column:
    sport = F.lower(col(sport))
    family = F.lit("other")
    for name, terms in reversed(FAMILY_TERMS.items()):
        family = F.when(sport.rlike("|".join(terms)), name).otherwise(family)
    return family


def activity_id(source_id, start_text, checksum) -> Column:
    digest = F.sha2(
        F.concat_ws(":", F.lit(ID_SALT), F.coalesce(col(start_text), F.lit("")), col(checksum)), 256
    )
    return F.coalesce(nonempty(source_id), digest)


def basename(path) -> Column:
    return F.substring_index(col(path), "/", -1)


def plain_path(path) -> Column:
    """File path text with URI escapes resolved."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def source_type(path) -> Column:
    return F.regexp_extract(F.lower(col(path)), r"\.([^./]+?)(?:\.gz)?$", 1)


def is_supported(path) -> Column:
    endings = "|".join(s.replace(".", r"\.") for s in SUPPORTED_SUFFIXES)
    return F.lower(col(path)).rlike(f"({endings})$")


def source_url(source_id) -> Column:
    return F.concat(F.lit(SOURCE_URL), nonempty(source_id))


def clamp_negative(c) -> Column:
    """Negative sentinels of a magnitude become 0; null stays null."""
    c = col(c)
    return F.when(c < 0, 0.0).otherwise(c)


def start_or_epoch(c) -> Column:
    return F.coalesce(col(c), F.lit(EPOCH).cast("timestamp"))


def reject_record(path, source_id, stage, code, message) -> Column:
    def text(v) -> Column:
        return F.lit(v) if isinstance(v, str) else v

    return F.struct(
        basename(path).alias("source_path"),
        col(source_id).cast("string").alias("source_activity_id"),
        text(stage).alias("stage"),
        text(code).alias("reason_code"),
        F.substring(text(message), 1, 300).alias("message"),
    )


def clean_or_raw(name: str, clean: bool) -> Column:
    return F.coalesce(F.col(f"clean_{name}"), F.col(name)) if clean else F.col(name)


BUILD_ID = r"^[a-z0-9][a-z0-9.-]{0,79}$"


def valid_build_id(c) -> Column:
    return col(c).rlike(BUILD_ID)


def normalize_artifact_path(path, kind: str) -> Column:
    """Path from its ``kind/`` folder on; null when absolute, escaping or of another kind."""
    path = col(path)
    at = F.instr(path, f"{kind}/")
    unsafe = path.startswith("/") | F.array_contains(F.split(path, "/"), "..")
    return F.when((at > 0) & ~unsafe, F.substring(path, at, F.length(path)))


def dimension_kind(type_name: str) -> str | None:
    """Dimension kind of a Spark simple type name; nested and binary types do not qualify."""
    t = type_name.lower()
    if t.startswith(("array", "struct", "map", "binary", "variant", "geo")):
        return None
    if t.startswith(("timestamp", "date", "time")):
        return "temporal"
    if t.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")):
        return "numeric"
    return "categorical"


REJECTION_JSON = (
    "source_path string, source_activity_id string, stage string, reason_code string, message string"
)


def rejection_to_json(record) -> Column:
    return F.to_json(col(record))


def rejection_from_json(text) -> Column:
    return F.from_json(col(text), REJECTION_JSON)
