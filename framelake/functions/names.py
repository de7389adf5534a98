"""Column functions for names, paths, dates, errors and class rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Class rules, the first needle that a lower-cased name contains decides its bucket.
CLASS_RULES = (
    ("drone", "drone"),
    ("hornet", "enemy"),
    ("yellowjacket", "enemy"),
    ("wasp", "enemy"),
    ("predator", "enemy"),
    ("intruder", "enemy"),
    ("foreign", "enemy"),
    ("enemy", "enemy"),
    ("worker", "worker"),
    ("forager", "worker"),
    ("guard", "worker"),
    ("fanning", "worker"),
    ("bee", "worker"),
)
#: File kinds, the name of a recording, the name of a frame.
VIDEO_EXTENSIONS = (".avi", ".mkv", ".mov", ".mp4", ".webm")
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png")
VIDEO_NAME = r"^(.+)@(\d{4}-\d{2}-\d{2})@(\d{2}-\d{2}-\d{2})(?:\.[^.]+)?$"
FRAME_NAME = r"^frame_(\d+)_t[\d.]+s\.jpg$"
#: HTTP codes for videos that don't exist, and for errors that pass.
GONE, PASSING = (403, 404, 410), (408, 429)


def parse_video_name(name: Column) -> Column:
    """STR-01: struct hive, day, time of `<hive>@YYYY-MM-DD@HH-MM-SS[.ext]`; null if the name is none."""
    part = lambda k: F.regexp_extract(name, VIDEO_NAME, k)
    parsed = F.struct(part(1).alias("hive"), F.try_to_date(part(2), "yyyy-MM-dd").alias("day"), F.replace(part(3), F.lit("-"), F.lit(":")).alias("time"))
    return F.when(name.rlike(VIDEO_NAME), parsed)


def build_video_name(hive: Column, day: Column, time: Column) -> Column:
    """STR-02."""
    return F.concat(hive, F.lit("@"), F.date_format(day, "yyyy-MM-dd"), F.lit("@"), F.replace(time, F.lit(":"), F.lit("-")), F.lit(".mp4"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def hive_of(path: Column) -> Column:
    """STR-03: the text before the first @ of the stem."""
    return F.split_part(stem(path), F.lit("@"), F.lit(1))


def slug(workspace: Column, project: Column) -> Column:
    return F.concat(workspace, F.lit("__"), project)


def slug_of(name: Column, missing: str = "<unknown>") -> Column:
    """STR-04: the text before the first `___`."""
    return F.when(F.instr(name, "___") > 0, F.split_part(name, F.lit("___"), F.lit(1))).otherwise(missing)


def url_of_source(path: Column, base: str, marker: str) -> Column:
    """STR-05: base and what follows the marker, `.h264` as `.mp4`, without leading slashes; null without the marker."""
    at = F.instr(path, marker)
    rest = F.regexp_replace(F.ltrim(F.substring(path, at + len(marker), F.length(path)), F.lit("/")), r"\.h264$", ".mp4")
    return F.when(at > 0, F.concat(F.lit(base), rest))


def percent_encoded(text: Column) -> Column:
    """STR-06: no safe characters but letters, digits and `_.-~`."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def safe_stem(text: Column) -> Column:
    """STR-07."""
    return F.translate(text, "/:", "_-")


def to_tenths(seconds: Column) -> Column:
    """The number of one decimal that is nearest to the exact binary value, the even one on ties.

    Whether x lies above m + 0.5 tenths is the sign of 20 x - (2 m + 1), taken as
    (16 x - (2 m + 1)) + 4 x, of which the first difference is exact: its terms are
    within a factor of two (or the sign is plain), and a sum has the sign of the exact one.
    """
    x = F.abs(seconds.cast("double"))
    m = F.floor(x * 10).cast("double")
    above = (16 * x - (2 * m + 1)) + 4 * x
    tenths = F.when((above > 0) | ((above == 0) & (m % 2 == 1)), m + 1).otherwise(m)
    return F.when(seconds < 0, -tenths / 10).otherwise(tenths / 10)


def frame_name(number: Column, seconds: Column) -> Column:
    """STR-08: numbers are padded and never cut; seconds are rounded as `to_tenths` does."""
    return F.format_string("frame_%06d_t%08.1fs.jpg", number.cast("long"), to_tenths(seconds))


def mask_name(frame: Column) -> Column:
    return F.concat(stem(frame), F.lit("_mask.png"))


def relative_to(path: Column, root: str) -> Column:
    """STR-09."""
    top = root.rstrip("/") + "/"
    return F.when(path.startswith(top), F.substring(path, len(top) + 1, 1 << 30)).otherwise(path)


def map_class(name: Column, rules=CLASS_RULES) -> Column:
    """JOIN-10, STR-10: the bucket of the first rule whose needle the name contains; null if none does. One CASE, no join."""
    lower, out = F.lower(name), None
    for needle, bucket in rules:
        hit = lower.contains(needle)
        out = F.when(hit, bucket) if out is None else out.when(hit, bucket)
    return out


def threshold_name(stem_: Column, threshold: Column) -> Column:
    """STR-11: `_t%03d` of the threshold in hundredths."""
    return F.concat(stem_, F.format_string("_t%03d", F.bround(threshold * 100).cast("int")))


def float_list(text: Column) -> Column:
    """STR-11: an array of doubles from comma-separated text; blanks are left out."""
    return F.transform(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""), lambda x: x.cast("double"))


#: What is stripped from the ends of dates and times: white space, as Unicode has it.
_OUTER = r"(?U)^\s+|\s+$"


def parse_date(text: Column) -> Column:
    """DAT-01: year-month-day, else month/day/year, with a year of four digits; null if neither. White space around it doesn't count."""
    bare = F.regexp_replace(text, _OUTER, "")
    known = lambda form, read: F.when(bare.rlike(form), F.try_to_date(bare, read))
    return F.coalesce(known(r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), known(r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"))


def parse_time(text: Column) -> Column:
    """DAT-02: HH:mm:ss of hours, minutes and seconds of a 24-hour time, else of a 12-hour one with AM or PM; null for any other form."""
    bare = F.upper(F.regexp_replace(text, _OUTER, ""))
    known = lambda form, read: F.when(bare.rlike(form), F.try_to_timestamp(F.regexp_replace(bare, r"\s+", " "), F.lit(read)))
    tries = [known(r"^\d{1,2}:\d{1,2}:\d{1,2}$", "H:m:s"), known(r"^\d{1,2}:\d{1,2}:\d{1,2}\s+[AP]M$", "h:m:s a")]
    return F.date_format(F.coalesce(*tries), "HH:mm:ss")


def retry_after_seconds(text: Column, now: Column) -> Column:
    """DAT-03: seconds as given or until an HTTP date, 0 at least; null if neither."""
    seconds = text.try_cast("double")
    when = F.try_to_timestamp(F.substring(text, 6, 40), F.lit("dd MMM yyyy HH:mm:ss zzz"))
    return F.greatest(F.coalesce(seconds, (F.unix_timestamp(when) - F.unix_timestamp(now)).cast("double")), F.lit(0.0))


def backoff_seconds(attempt: Column, delay: Column, retry_after: Column) -> Column:
    """MTH-10: Retry-After if above 0, else the delay or 2 ** attempt up to 60, the larger."""
    return F.when(retry_after > 0, F.greatest(delay, retry_after)).otherwise(F.greatest(delay, F.least(F.lit(60.0), F.pow(F.lit(2.0), attempt))))


def classify_error(code: Column, kind: Column) -> Column:
    """ERR-01: unavailable or failed, from an HTTP code (or null) and the kind of the error."""
    return (
        F.when(code.isin(*GONE), "unavailable").when(code.isin(*PASSING) | (code >= 500), "failed")
        .when(kind.isin("timeout", "network"), "failed").when(kind == "value", "unavailable").otherwise("failed")
    )


def signature(*fields: Column) -> Column:
    """JSN-01: a digest by which schedules are equal."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def download_destination(path: Column, is_dir: Column, name: Column) -> Column:
    """SNK-18: a folder or a path without suffix gets the name, a file path stays."""
    into = F.concat(F.rtrim(path, F.lit("/")), F.lit("/"), name)
    return F.when(is_dir, into).when(base_name(path).rlike(r".\.[^.]+$"), path).otherwise(into)
