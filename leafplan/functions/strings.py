"""Scalar string rules as column expressions: names, keys, versions, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the wire and file formats.
PIPELINE_VERSION = "0.4.0"
SUPPORTED_EXTENSIONS = ("jpg", "jpeg", "png", "webp")
IGNORED_NAMES = ("thumbs.db", "desktop.ini", ".ds_store")
RESERVED_NAMES = ("CON", "PRN", "AUX", "NUL", *(f"{kind}{k}" for kind in ("COM", "LPT") for k in range(1, 10)))
TIMING_STAGES = ("segmentation_inference_ms", "mask_postprocess_ms", "quadrilateral_fitting_ms", "cv_refinement_ms", "total_detection_ms")


def natural_key(name: Column) -> Column:
    """Orders names by text without case and by the value of digit runs.

    Text and digit runs alternate; a run is its length without leading zeros
    and then its digits, so that arrays of strings compare as numbers would. A
    name that starts with digits has an empty text first, as in any split.
    """
    parts = F.split(F.regexp_replace(F.lower(name), r"(\d+)", "\u0001$1\u0001"), "\u0001")
    bare = lambda d: F.regexp_replace(d, r"^0+(?=\d)", "")
    return F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lpad(F.length(bare(p)).cast("string"), 4, "0"), bare(p))).otherwise(p))


def file_stem(name: Column) -> Column:
    """The name without its last extension; a leading dot begins none."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def file_extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def is_hidden(name: Column) -> Column:
    return name.startswith(".") | name.startswith("~$") | F.lower(name).isin(*IGNORED_NAMES)


def target_pdf(name: Column, collides: Column) -> Column:
    return F.when(collides, F.concat(file_stem(name), F.lit("__"), file_extension(name), F.lit(".pdf"))).otherwise(F.concat(file_stem(name), F.lit(".pdf")))


def scan_mode(mode: Column) -> Column:
    """The mode's own name, aliases folded."""
    low = F.lower(F.trim(mode))
    return F.when(low.isin("color_enhanced", "colored"), "color").when(low.isin("smart", "smart-document"), "smart_document").otherwise(low)


def version_for_mode(version: Column, mode: Column) -> Column:
    own = scan_mode(mode)
    return F.when(own == "gray", version).otherwise(F.concat_ws(":", version, own))


def group_key_text(employee: Column, year: Column, month: Column) -> Column:
    return F.format_string("%s:%04d-%02d", F.translate(employee, "\\", "/"), year, month)


def safe_component(value: Column) -> Column:
    """A name that any file system takes."""
    clean = F.regexp_replace(F.regexp_replace(value, '[<>:"/\\\\\\\\|?*\\x00-\\x1f]', "_"), r"^[ .]+|[ .]+$", "")
    return F.when(clean == "", F.lit("employee")).when(F.upper(clean).isin(*RESERVED_NAMES), F.concat(F.lit("_"), clean)).otherwise(clean)


def source_fingerprint(path: Column) -> Column:
    return F.substring(F.sha2(F.translate(path, "\\", "/"), 256), 1, 8)


def page_file_name(employee: Column, year: Column, month: Column, page_type: Column, page_order: Column, path: Column) -> Column:
    """Name of a page's own artifact: by its order if that is known, else by its path."""
    tail = F.when(page_order.isNotNull() & (page_type != "UNKNOWN"), F.format_string("p%02d", page_order)).otherwise(source_fingerprint(path))
    return F.concat(F.format_string("%04d-%02d_", year, month), safe_component(employee), F.lit("_"), tail, F.lit(".pdf"))


def root_id(path: Column) -> Column:
    return F.substring(F.sha2(F.translate(path, "\\", "/"), 256), 1, 24)


def flat_manifest_id(source: Column, target: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\n", source, target), 256), 1, 32)


def draft_name(path: Column, size: Column, mtime_ns: Column) -> Column:
    return F.concat(F.substring(F.sha2(F.concat_ws(":", path, size.cast("string"), mtime_ns.cast("string")), 256), 1, 24), F.lit(".pdf"))


def stable_key(seed: int, value: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), value), 256)


def split_of(seed: int, value: Column) -> Column:
    """60/20/20 by the first 32 bits of the stable key."""
    part = F.conv(F.substring(stable_key(seed, value), 1, 8), 16, 10).cast("long") % 10
    return F.when(part < 6, "train").when(part < 8, "tune").otherwise("acceptance")


def timing_stage(key: Column) -> Column:
    """The stage that a timing key names; null for none."""
    bare = F.regexp_replace(F.lower(key), "[^a-z0-9]", "")
    aliases = {"detect": "total_detection_ms"} | {s.replace("_", "").removesuffix("ms"): s for s in TIMING_STAGES}
    out = F.when(key.isin(*TIMING_STAGES), key)
    for short, stage in aliases.items():
        out = out.when(bare.isin(short, f"{short}ms"), F.lit(stage))
    return out


def failure_slug(text: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(text.isNotNull(), F.when(slug == "", F.lit("unknown_failure")).otherwise(slug))


#: Warning codes by the failure that they stand for, the first that is there decides.
FAILURE_PRECEDENCE = (
    ("HYBRID_AMBIGUOUS", ("HYBRID_AMBIGUOUS", "DETECTION_AMBIGUOUS")),
    ("PERSPECTIVE_INVALID", ("PERSPECTIVE_INVALID", "WARP_FALLBACK")),
    ("QUAD_FIT_FAILED", ("QUAD_FIT_FAILED", "DOCUMENT_CLIPPED")),
    ("MASK_INVALID", ("MASK_INVALID",)),
    ("MASK_AMBIGUOUS_COMPONENTS", ("MASK_AMBIGUOUS_COMPONENTS",)),
    ("REFINEMENT_REJECTED", ("REFINEMENT_REJECTED",)),
    ("SEGMENTATION_LOW_CONFIDENCE", ("SEGMENTATION_LOW_CONFIDENCE",)),
)


def detection_failure(detected: Column, warnings: Column, fallback: Column) -> tuple[Column, Column]:
    """Primary reason and reason list of a detection; null and empty where a document was found."""
    upper = F.transform(warnings, lambda w: F.upper(w))
    primary = F.lit("CV_NO_CANDIDATE")
    for reason, codes in reversed(FAILURE_PRECEDENCE):
        primary = F.when(F.arrays_overlap(upper, F.array(*map(F.lit, codes))), F.lit(reason)).otherwise(primary)
    fell = fallback | F.array_contains(upper, "FALLBACK_FULL_IMAGE")
    codes = F.array_distinct(F.array_compact(F.array(primary, F.when(fell, F.lit("FALLBACK_FULL_IMAGE")))))
    return F.when(~detected, primary), F.when(detected, F.array().cast("array<string>")).otherwise(codes)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def has_warning(warnings: Column, code: str) -> Column:
    """Whether a comma-separated list has ``code``; false for null."""
    return F.coalesce(F.array_contains(F.transform(F.split(warnings, ","), lambda w: F.trim(w)), code), F.lit(False))


def relative_path_ok(path: Column) -> Column:
    """Not empty, not absolute, without a step up."""
    normal = F.translate(path, "\\", "/")
    return (normal != "") & ~normal.rlike("^(/|[A-Za-z]:)") & ~F.array_contains(F.split(normal, "/"), "..")


def data_image_ok(value: Column) -> Column:
    """Whether a preview is a bounded base64 image URL."""
    body = F.regexp_extract(value, r"^data:image/(?:jpeg|png|webp);base64,([A-Za-z0-9+/=]*)$", 1)
    return F.coalesce((F.length(value) <= 2_000_000) & (body != "") & (F.coalesce(F.length(F.try_to_binary(body, F.lit("base64"))), F.lit(1_500_001)) <= 1_500_000), F.lit(False))
