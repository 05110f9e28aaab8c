"""Scalar functions as column expressions that stay in the JVM."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters compared as pairs instead of words.
CJK = r"[㐀-䶿一-鿿豈-﫿]"


def tokens(text: Column) -> Column:
    """Latin words and pairs of neighbouring CJK characters, lower-cased."""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
    letters = F.regexp_extract_all(low, F.lit(CJK), F.lit(0))
    pairs = F.when(F.size(letters) > 1, F.zip_with(
        F.slice(letters, F.lit(1), F.size(letters) - 1), F.slice(letters, F.lit(2), F.size(letters) - 1), lambda a, b: F.concat(a, b))).otherwise(
        F.array().cast("array<string>"))
    return F.concat(words, pairs)


def spoken_units(text: Column) -> Column:
    """One per CJK character and one per Latin word."""
    latin = F.regexp_replace(text, CJK, " ")
    return F.regexp_count(text, F.lit(CJK)) + F.regexp_count(latin, F.lit("[a-z0-9]+"))


def hamming64(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 2 where the lengths differ or a vector has no length."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (size == 0), 2.0).otherwise(1 - dot(a, b) / size)


def apply_glossary(text: Column, glossary: Column) -> Column:
    """Replace what was heard by what was meant, in the order of the glossary array."""
    return F.aggregate(glossary, text, lambda t, g: F.replace(t, g["heard"], g["meant"]))


def blurred(reading: Column) -> Column:
    """A reading with the sounds often not told apart made the same."""
    flat = F.regexp_replace(F.regexp_replace(reading, "^([zcs])h", "$1"), "^l", "n")
    return F.regexp_replace(flat, "([ei])ng$", "$1n")


# Fixed value: names a camera gives its files.
CAMERA_NAME = (r"(?iU)^(img|dji|dsc|dscf|mvi|gopr|gx|gh|vid|video|pxl|mov|movie|clip|mah|sam|rec|record|screen|"
               r"screenshot|p|c)?[\W_]*\d[\d\W_]*[a-z]?$")


def file_label(path: Column) -> Column:
    """What a file's name says it is; empty when a camera named it."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.when(stem.rlike(CAMERA_NAME), "").otherwise(F.trim(F.regexp_replace(stem, r"^\d+[\s_\-.]+", "")))


def clock(us: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    s = F.floor(us / 1_000_000)
    h, m = F.floor(s / 3600), F.floor(s / 60) % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%d:%02d", m, s % 60))


def timecode(frames: Column, rate: int) -> Column:
    s = F.floor(frames / rate)
    return F.format_string("%02d:%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, frames % rate)


def to_db(amplitude: Column, floor: float = -120.0) -> Column:
    """Amplitude in decibels, no lower than the floor."""
    return F.when(amplitude > 0, F.greatest(F.lit(floor), 20 * F.log10(amplitude))).otherwise(F.lit(floor))


def from_db(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def luminance(color: Column) -> Column:
    """WCAG relative luminance of a colour written as six hex digits."""
    def channel(at):
        v = F.conv(F.substring(color, at, 2), 16, 10).cast("double") / 255
        return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, 2.4))
    return 0.2126 * channel(1) + 0.7152 * channel(3) + 0.0722 * channel(5)


def contrast(a: Column, b: Column) -> Column:
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def remaining(spent: Column, progress: Column, least: float = 0.05) -> Column:
    """Seconds left at the pace so far; NULL before the job has gone some way."""
    return F.when(progress >= least, F.round(spent * (1 - progress) / progress).cast("long"))


def site_of(url: Column, sites: Sequence[tuple[str, str]]) -> Column:
    """The allowed site an https link is on, by host or a host under it."""
    host = F.lower(F.regexp_extract(url, r"^https://([^/:?#]+)", 1))
    return functools.reduce(lambda c, s: F.when((host == s[1]) | host.endswith("." + s[1]), s[0]).otherwise(c),
                            list(reversed(sites)), F.lit(None).cast("string"))


def round_ms(seconds: Column) -> Column:
    return seconds.cast("decimal(20,9)").cast("decimal(12,3)")


def floor_ms(seconds: Column) -> Column:
    return F.floor(seconds * 1000) / 1000


def marker_pattern(marker: str) -> str:
    """A regular expression for a marker, whole words only where it is Latin."""
    import re
    quoted = re.sub(r"([^\w\s])", r"\\\1", marker)
    return rf"(?<![a-z0-9]){quoted}(?![a-z0-9])" if marker.isascii() else quoted
