"""Clock and label recovery from file names, folder names and free text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorgate.functions.exprs import as_col

# Month names and their three-letter forms, and media extensions.
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)
AUDIO_EXT = ("wav", "flac", "mp3", "ogg", "aif", "aiff")
VIDEO_EXT = ("mp4", "mov", "avi", "mkv", "m4v", "mts")
THERMAL_EXT = ("jpg", "jpeg", "png", "tiff", "tif", "seq", "csq")


def base_name(path) -> Column:
    return F.element_at(F.split(as_col(path), "/"), -1)


def stem(path) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    m = F.regexp_extract(c, pattern, group)
    return F.when(m != "", m)


def _ts(text: Column, fmt: str) -> Column:
    return F.try_to_timestamp(text, F.lit(fmt))


def _short_ts(text: Column, fmt: str) -> Column:
    """Two-digit years: 69..99 belong to the last century."""
    century = F.when(F.substring(text, 1, 2) >= "69", F.lit("19")).otherwise(F.lit("20"))
    return _ts(F.concat(century, text), f"yyyy{fmt}")


def month_number(name) -> Column:
    """1..12 for a full or three-letter English month name in any case, else NULL."""
    pairs = [(n, i) for i, n in enumerate(MONTHS, 1)] + [(n[:3], i) for i, n in enumerate(MONTHS, 1) if len(n) > 3]
    table = F.create_map(*[F.lit(x) for p in pairs for x in p])
    return F.try_element_at(table, F.lower(as_col(name)))


# The patterns and layouts in the functions below are the file-name, folder-name and header formats of the
# recorders, which parsing has to match.


def filename_start(path) -> Column:
    """Start clock in the file name (``YYYYMMDD_HHMMSS``)."""
    return _ts(_found(base_name(path), r"(\d{8}_\d{6})"), "yyyyMMdd_HHmmss")


def filename_datetime(path) -> Column:
    """Clock in the file name under three layouts, tried in order; an impossible date falls to the next one."""
    s = stem(path)
    return F.coalesce(
        _ts(_found(s, r"(\d{8}_\d{6})"), "yyyyMMdd_HHmmss"),
        _ts(F.regexp_replace(_found(s, r"(\d{8}T\d{6})"), "T", "_"), "yyyyMMdd_HHmmss"),
        _short_ts(_found(s, r"(\d{6}_\d{6})"), "MMdd_HHmmss"),
    )


def filename_date(path) -> Column:
    """Recording day in the file name: full date with clock, short date with take number, or a bare short date."""
    s = stem(path)
    return F.coalesce(
        _ts(_found(s, r"(\d{8})_\d{6}"), "yyyyMMdd"),
        _short_ts(_found(s, r"(\d{6})_\d{3}"), "MMdd"),
        _short_ts(_found(s, r"(\d{6})"), "MMdd"),
    ).cast("date")


def recording_start(path, header, modified) -> Column:
    """Struct (start, ts_source): file name, else text in the file header, else date prefix, else modification time."""
    name, head = base_name(path), as_col(header)
    by_name = _ts(_found(name, r"(\d{8}_\d{6})"), "yyyyMMdd_HHmmss")
    unit = _ts(_found(head, r"ZOOM\s*F6\s+(\d{14})"), "yyyyMMddHHmmss")
    stamp = r"(\d{4}-\d{2}-\d{2})[ T]?(\d{2}:\d{2}:\d{2})"
    day_clock = F.concat_ws(" ", _found(head, stamp, 1), _found(head, stamp, 2))
    embedded = F.coalesce(unit, _ts(day_clock, "yyyy-MM-dd HH:mm:ss"))
    prefix = _short_ts(_found(name, r"^(\d{6})[_\-]"), "MMdd")
    source = (
        F.when(by_name.isNotNull(), F.lit("filename"))
        .when(embedded.isNotNull(), F.lit("metadata"))
        .when(prefix.isNotNull(), F.lit("filedate"))
        .otherwise(F.lit("mtime"))
    )
    start = F.coalesce(by_name, embedded, prefix, as_col(modified).cast("timestamp"))
    return F.struct(start.alias("start"), source.alias("ts_source"))


def timecode_seconds(timecode, fps) -> Column:
    """``HH:MM:SS;FF`` -> seconds since midnight, frames as a fraction rounded to microseconds; NULL if malformed."""
    t, rate = F.translate(as_col(timecode), ";", ":"), as_col(fps)
    part = F.split(t, ":")
    hh, mm, ss, ff = (F.get(part, F.lit(i)).try_cast("int") for i in range(4))
    micro = F.when(rate != 0, F.round(ff / rate * 1e6)).otherwise(F.lit(0.0))
    good = (F.size(part) == 4) & mm.between(0, 59) & ss.between(0, 59) & micro.between(0, 999999)
    return F.when(good, F.pmod(hh, F.lit(24)) * 3600.0 + mm * 60.0 + ss + micro / 1e6)


def frame_rate(ratio) -> Column:
    """``num/den`` as a double; a zero denominator counts as one."""
    part = F.split(as_col(ratio), "/")
    num, den = (F.get(part, F.lit(i)).try_cast("double") for i in (0, 1))
    return num / F.when(den == 0, F.lit(1.0)).otherwise(den)


def month_of(label, year: int = 2025) -> Column:
    """Struct (month, month_iso) of a month name or ``YYYY-MM`` label."""
    key = F.lower(F.trim(as_col(label)))
    iso = _found(key, r"^(\d{4}-\d{2})$")
    full = F.create_map(*[F.lit(x) for i, n in enumerate(MONTHS, 1) for x in (n, i)])
    num = F.coalesce(F.try_element_at(full, key), F.substring(iso, 6, 2).try_cast("int"))
    return F.struct(
        num.alias("month"), F.coalesce(iso, F.concat(F.lit(f"{year}-"), F.lpad(num.cast("string"), 2, "0"))).alias("month_iso")
    )


def folder_date(path, default_year: int = 2025) -> Column:
    """Date of a day folder such as ``19 sep``, ``Aug 19`` or ``24Sep``; year from a ``Month YYYY`` folder above.

    The deepest folder with a day counts, and the last ``Month YYYY`` folder gives the year.
    """
    parts = F.transform(F.filter(F.split(as_col(path), "/"), lambda p: p != ""), lambda p: F.trim(p))
    my = r"^([A-Za-z]+)\s+(\d{4})$"
    years = F.transform(
        F.filter(parts, lambda p: p.rlike(my) & month_number(F.regexp_extract(p, my, 1)).isNotNull()),
        lambda p: F.regexp_extract(p, my, 2).cast("int"),
    )
    year = F.coalesce(F.try_element_at(years, F.lit(-1)), F.lit(default_year))
    dm, md = r"^(\d{1,2})\s*([A-Za-z]+)$", r"^([A-Za-z]+)\s*(\d{1,2})$"
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))

    def day_month(p):
        first = p.rlike(dm)
        text = F.when(first, F.regexp_extract(p, dm, 1)).otherwise(F.regexp_extract(p, md, 2))
        day = F.when(text != "", text.cast("int"))
        mon = month_number(F.when(first, F.regexp_extract(p, dm, 2)).otherwise(F.regexp_extract(p, md, 1)))
        return F.struct(day.alias("day"), mon.alias("mon"))

    found = F.filter(F.transform(folders, day_month), lambda d: d["mon"].isNotNull() & d["day"].between(1, 31))
    last = F.try_element_at(found, F.lit(-1))
    first = F.make_date(year, last["mon"], F.lit(1))
    return F.when(last["day"] <= F.day(F.last_day(first)), F.date_add(first, last["day"] - 1))


def dates_in_text(df: DataFrame, keys, text: str, year) -> DataFrame:
    """All dates a label implies: each number 1..31 takes the nearest month word by character position.

    Room numbers and modality words are blanked first; on equal distance the earlier month counts; impossible days
    are dropped. Tokens cover the whole text, so running lengths give positions. The month of a number is found
    inside the row's own arrays, so rows stay where they are: no shuffle, and no pairs are written out.
    """
    s = F.lower(F.col(text))
    s = F.regexp_replace(s, r"room\s*\d+", " ")
    s = F.regexp_replace(s, r"\b(audio|video|thermal|data)\b", " ")
    token = F.regexp_extract_all(s, F.lit(r"([a-z]+|[0-9]+|[^a-z0-9]+)"), F.lit(1))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,mon:int,day:int>>").alias("marks"))
    marks = F.aggregate(token, start, _add_mark, lambda acc: acc["marks"])

    def date_of(day, all_marks):
        gaps = F.transform(
            F.filter(all_marks, lambda m: m["mon"].isNotNull()),
            lambda m: F.struct(F.abs(m["at"] - day["at"]).alias("gap"), m["at"], m["mon"]),
        )
        first = F.make_date(as_col(year), F.array_min(gaps)["mon"], F.lit(1))
        return F.when(day["day"] <= F.day(F.last_day(first)), F.date_add(first, day["day"] - 1))

    # The marks go through a one-element array so that they are computed once per row.
    hits = F.flatten(
        F.transform(F.array(marks), lambda a: F.transform(F.filter(a, lambda m: m["day"].isNotNull()), lambda d: date_of(d, a)))
    )
    # The outer form keeps the optimiser from adding filters that would compute the array again.
    return df.select(*keys, F.explode_outer(hits).alias("date")).filter(F.col("date").isNotNull())


def _add_mark(acc, t):
    """Running text position, and the month words and day numbers seen so far."""
    num = F.when(t.rlike("^0*[0-9]{1,2}$"), t.cast("int"))  # a failing cast costs far more than the pattern
    mark = F.struct(acc["at"].alias("at"), month_number(t).alias("mon"), F.when(num.between(1, 31), num).alias("day"))
    kept = F.filter(F.array(mark), lambda m: m["mon"].isNotNull() | m["day"].isNotNull())
    return F.struct((acc["at"] + F.length(t)).alias("at"), F.concat(acc["marks"], kept).alias("marks"))


def room_label(path) -> Column:
    num = F.regexp_extract(F.lower(as_col(path)), r"room\s*(\d+)", 1)
    return F.when(num != "", F.concat(F.lit("Room"), num.try_cast("int").cast("string"))).otherwise(F.lit("Room?"))


def modality_label(path) -> Column:
    p = F.lower(as_col(path))
    out = F.lit("other")
    for word in ("audio", "thermal", "video"):
        out = F.when(p.contains(word), F.lit(word)).otherwise(out)
    return out


def extension_label(path) -> Column:
    e = F.lower(F.regexp_extract(base_name(path), r"\.([^.]+)$", 1))
    return (
        F.when(e.isin(*AUDIO_EXT), F.lit("audio")).when(e.isin(*VIDEO_EXT), F.lit("video")).when(e.isin(*THERMAL_EXT), F.lit("thermal"))
    )


def frame_clock(start, index, rate) -> Column:
    """Wall clock of frame ``index`` of a recording sampled at ``rate`` per second."""
    shift = F.round(as_col(index) * 1e6 / as_col(rate)).cast("long")
    return F.timestamp_micros(F.unix_micros(as_col(start).cast("timestamp")) + shift)
