"""Text functions: file names, coordinates as text, reports."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi


def name_of(path: Column) -> Column:
    return F.upper(F.regexp_extract(path, r"([^/\\]*)$", 1))


def exposure_of(path: Column) -> Column:
    """Seconds before SEC, else before S_ (a space between is allowed); 0 if there are none."""
    name = name_of(path)
    at = F.when(F.contains(name, F.lit("SEC")), F.regexp_extract(name, r"^(?:(?!SEC).)*?([0-9]*) ?SEC", 1)).otherwise(F.regexp_extract(name, r"^(?:(?!S_).)*?([0-9]*) ?S_", 1))
    return F.coalesce(at.try_cast("int"), F.lit(0))


def temperature_of(path: Column) -> Column:
    """Degrees before C. Of several, the one that ends in the lowest digit, and the first of these; 999 if none."""
    name = name_of(path)
    out = F.lit(None).cast("string")
    for d in range(9, -1, -1):
        out = F.when(F.contains(name, F.lit(f"{d}C")), F.regexp_extract(name, rf"^(?:(?!{d}C).)*?([-0-9]*{d})C", 1)).otherwise(out)
    return F.coalesce(F.regexp_extract(out, r"(-?[0-9]+)$", 1).try_cast("int"), F.lit(999))


def object_of(path: Column) -> Column:
    """Catalogue and number; the first catalogue in order of priority that the name holds."""
    name = name_of(path)
    out = F.lit("")
    for prefix in ("M", "UGC", "PGC", "SH2-", "IC", "NGC"):
        digits = F.regexp_extract(name, rf"^.*?{prefix} ?([0-9]*)", 1)
        out = F.when(F.contains(name, F.lit(prefix)), F.concat(F.lit(prefix), digits)).otherwise(out)
    return out


def extension_of(path: Column) -> Column:
    return F.upper(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def file_kind(path: Column) -> Column:
    """fits, tiff, image or raw by extension; other."""
    e = extension_of(path)
    return F.when(e.isin(".FIT", ".FITS", ".FTS", ".WCS", ".NEW"), "fits").when(e.isin(".TIF", ".TIFF"), "tiff").when(e.isin(".PNG", ".JPG", ".JPEG", ".BMP", ".PPM", ".PGM", ".PFM", ".XISF"), "image").when(e.isin(".CR2", ".CR3", ".CRW", ".NEF", ".ARW", ".DNG", ".ORF", ".RAF", ".RW2", ".PEF", ".RAW"), "raw").otherwise("other")


def angle_of(text: Column, hours: bool) -> Column:
    """Radians of a number or of up to three sexagesimal fields; null if it is no angle. With hours, the number counts
    hours, unless the text holds a D."""
    plain = text.try_cast("double")
    data = F.regexp_replace(F.replace(text, F.lit(","), F.lit(".")), "[^0-9.-]+", " ")
    fields = F.transform(F.filter(F.split(F.trim(data), " +"), lambda x: x != ""), lambda x: x.try_cast("double"))
    sign = F.when(F.contains(data, F.lit("-")), -1.0).otherwise(1.0)
    at = lambda k: F.coalesce(F.get(fields, F.lit(k)), F.lit(0.0))
    first = F.abs(at(0))
    if hours:
        first = F.when(F.contains(F.upper(text), F.lit("D")), first * (24.0 / 360.0)).otherwise(first)
    bad = (F.size(fields) == 0) | F.exists(F.slice(fields, 1, 3), lambda x: x.isNull())
    unit = PI / 12 if hours else PI / 180
    value = F.when(~bad, sign * (first + at(1) / 60.0 + at(2) / 3600.0) * unit)
    if hours:
        value = F.when(value <= 2 * PI, value)
    return F.coalesce(plain * unit, value)


def _units(x: Column, in_unit: float, half: float) -> Column:
    """Whole units, after half a unit was added."""
    return F.floor(x * in_unit + half).cast("long")


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def ra_text(ra: Column, sep: str = ":") -> Column:
    """HH:MM SS.s"""
    t = _units(ra, 12 / PI * 36000, 0.5)
    return F.concat(_two((t / 36000).cast("long")), F.lit(sep), _two((t / 600).cast("long") % 60), F.lit(" "), _two((t / 10).cast("long") % 60), F.lit("."), (t % 10).cast("string"))


def dec_text(dec: Column, sep: str = ":") -> Column:
    """+DD:MM SS"""
    t = _units(F.abs(dec), 180 / PI * 3600, 0.5)
    pad = " " * min(2, len(sep))
    return F.concat(F.when(dec < 0, "-").otherwise("+"), _two((t / 3600).cast("long")), F.lit(sep), _two((t / 60).cast("long") % 60), F.lit(pad), _two(t % 60))


def iau_designation(ra: Column, dec: Column) -> Column:
    """HHMMSS.s+DDMMSS"""
    t = _units(ra, 12 / PI * 36000, 0.5)
    d = _units(F.abs(dec), 180 / PI * 3600, 0.5)
    return F.concat(_two((t / 36000).cast("long")), _two((t / 600).cast("long") % 60), _two((t / 10).cast("long") % 60), F.lit("."), (t % 10).cast("string"), F.when(dec < 0, "-").otherwise("+"), _two((d / 3600).cast("long")), _two((d / 60).cast("long") % 60), _two(d % 60))


def shifted(text: Column) -> Column:
    """Characters shifted by their place (from 1) less 11, after a 1: an obfuscation, not a cipher."""
    codes = F.transform(F.split(text, ""), lambda c, i: F.char(F.pmod(F.ascii(c) + i + 1 - 11, F.lit(256))))
    return F.concat(F.lit("1"), F.array_join(codes, ""))


def unshifted(text: Column) -> Column:
    """Undoes shifted; empty if the text doesn't begin with 1."""
    codes = F.transform(F.split(F.substring(text, 2, 1 << 30), ""), lambda c, i: F.char(F.pmod(F.ascii(c) - (i + 1) + 11, F.lit(256))))
    return F.when((F.length(text) >= 2) & F.startswith(text, F.lit("1")), F.array_join(codes, "")).otherwise("")


def clean_name(text: Column) -> Column:
    """Up to the first comma, trimmed, underscores as spaces."""
    return F.replace(F.regexp_replace(F.substring_index(text, ",", 1), r"^[ \t\r\n]+|[ \t\r\n]+$", ""), F.lit("_"), F.lit(" "))


def without_special(text: Column) -> Column:
    return F.translate(text, '*"/\\:|<>?', "")


def tolerant_number(text: Column, default: float = 0.0) -> Column:
    """A number with a comma or point; default if it is none."""
    return F.coalesce(F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double"), F.lit(default))


def aliases(text: Column) -> Column:
    """Up to three names parted by slashes."""
    return F.slice(F.filter(F.split(text, "/"), lambda x: x != ""), 1, 3)


def report_row(name: Column, jd: Column, magnitude: Column, error: Column, snr: Column, band: Column, check: Column, check_magnitude: Column, air: Column, comp: Column | None = None, comp_catalog: Column | None = None, comp_magnitude: Column | None = None, delimiter: str = ",", group: str = "na", chart: str = "na", notes: str = "na") -> Column:
    """One row of a variable-star report; with a comparison star, magnitudes are shifted by its catalogue value."""
    used = (comp_catalog != 0) & (comp_magnitude != 0) if comp is not None else F.lit(False)
    shift = F.when(used, comp_catalog - comp_magnitude).otherwise(0.0) if comp is not None else F.lit(0.0)
    err = F.when((error <= 0) & (snr > 0), 2.0 / F.when(snr > 0, snr).otherwise(1.0)).otherwise(error)
    fixed = lambda x, n: F.format_string(f"%.{n}f", x)
    cname = F.when(used, F.when(comp == "", "COMP").otherwise(comp)).otherwise("ENSEMBLE") if comp is not None else F.lit("ENSEMBLE")
    cmag = F.when(used, fixed(comp_catalog, 3)).otherwise("na") if comp is not None else F.lit("na")
    return F.concat_ws(delimiter, name, fixed(jd, 5), fixed(magnitude + shift, 3), fixed(err, 4), band, F.lit("NO"), F.lit("STD"), cname, cmag, check, fixed(check_magnitude + shift, 3), F.when(air == "", "na").otherwise(air), F.lit(group), F.lit(chart), F.lit(notes))
