"""Scalar expressions: levels, pitch, names of notes, angles, geometry, labels, paths. Columns in, columns out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Note names within an octave, reference pressure (Pa), MIDI number and Hz of A4, Bb transposition (semitones).
NOTE_NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
P_REF = 2e-5
A4_MIDI, A4_HZ = 69, 440.0
TRANSPOSE = 2
_STEPS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c) -> Column:
    """NaN as null."""
    return F.nanvl(col(c), F.lit(None).cast("double"))


# Levels


def amplitude_db(x, floor: float = 1e-12) -> Column:
    return F.lit(20.0) * F.log10(F.greatest(col(x), F.lit(floor)))


def power_db(x, floor: float = 1e-12) -> Column:
    return F.lit(10.0) * F.log10(F.greatest(col(x), F.lit(floor)))


def spl_db(pressure) -> Column:
    """Sound pressure level; null where the pressure isn't positive."""
    p = col(pressure)
    return F.when(p > 0, F.lit(20.0) * F.log10(p / P_REF))


def relative_db(var, avg, floor: float = -120.0) -> Column:
    """Variation relative to the mean in dB, not below floor."""
    x = 1 + col(var) / F.nullif(col(avg), F.lit(0.0))
    return F.when(x > 0, F.greatest(F.lit(floor), F.lit(20.0) * F.log10(x)))


def ratio_db(a, b) -> Column:
    x = col(a) / F.nullif(col(b), F.lit(0.0))
    return F.when(x > 0, F.lit(20.0) * F.log10(x))


def ratio_db_spread(a, a_var, b, b_var) -> Column:
    """Variation of the ratio of two levels in dB, both variations carried to it to the first order; null where it isn't positive."""
    x = col(a_var) / F.nullif(col(b), F.lit(0.0)) + col(b_var) * col(a) / F.nullif(col(b) * col(b), F.lit(0.0))
    return F.when(x > 0, F.lit(20.0) * F.log10(x))


def clipped(x, low, high) -> Column:
    """x, not below low or above high."""
    return F.greatest(F.lit(low) if isinstance(low, (int, float)) else col(low), F.least(F.lit(high) if isinstance(high, (int, float)) else col(high), col(x)))


def total_angle(a, b) -> Column:
    """Size of a turn about two axes at right angles."""
    return F.hypot(col(a), col(b))


# Pitch


def semitones(hz, ref: float = A4_HZ) -> Column:
    h = col(hz)
    return F.when(h > 0, F.lit(12.0) * F.log2(h / ref))


def cents(hz, expected, transpose: int = TRANSPOSE) -> Column:
    """Deviation from the score's frequency; the score is written `transpose` semitones above what sounds."""
    x = col(hz) / F.nullif(col(expected), F.lit(0.0))
    return F.when(x > 0, F.lit(1200.0) * F.log2(x) + 100 * transpose)


def hz_to_midi(hz) -> Column:
    h = col(hz)
    return F.when(h > 0, F.rint(A4_MIDI + 12 * F.log2(h / A4_HZ)).cast("int")).otherwise(F.lit(0))


def midi_to_hz(midi, transpose: int = 0) -> Column:
    return F.lit(A4_HZ) * F.pow(F.lit(2.0), (col(midi) - A4_MIDI - transpose) / 12.0)


def midi_to_name(midi) -> Column:
    m = col(midi).cast("int")
    name = F.element_at(F.array(*[F.lit(n) for n in NOTE_NAMES]), F.pmod(m, F.lit(12)) + 1)
    return F.concat(name, (F.floor(m / 12) - 1).cast("string"))


def name_to_midi(name) -> Column:
    """MIDI number of names such as C#4, Bb3; null for others."""
    n = F.translate(col(name), "♯♭", "#b")
    pattern = r"^([A-G])([#b]?)(-?\d+)$"
    step = F.create_map(*[F.lit(x) for kv in _STEPS.items() for x in kv])[F.regexp_extract(n, pattern, 1)]
    sign = F.when(F.regexp_extract(n, pattern, 2) == "#", 1).when(F.regexp_extract(n, pattern, 2) == "b", -1).otherwise(0)
    return F.when(n.rlike(pattern), (F.regexp_extract(n, pattern, 3).try_cast("int") + 1) * 12 + step + sign)


def round_half_even(x) -> Column:
    return F.rint(col(x))


def wrap(x, period) -> Column:
    """x shifted by whole periods into [-period/2, period/2)."""
    half = F.lit(float(period) / 2)
    return F.pmod(col(x) + half, F.lit(float(period))) - half


def next_power_of_two(x) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.log2(col(x)))).cast("long")


def nearest_power_of_two(x) -> Column:
    return F.pow(F.lit(2.0), F.rint(F.log2(col(x)))).cast("long")


# Geometry


def segment_angle(dx, dy) -> Column:
    """Angle of a segment in degrees, by the arc tangent of its slope; null where dx is 0."""
    return F.degrees(F.atan(col(dy) / F.nullif(col(dx), F.lit(0.0))))


def distance(x1, y1, x2, y2) -> Column:
    return F.hypot(col(x2) - col(x1), col(y2) - col(y1))


def point_line(px, py, x1, y1, x2, y2) -> Column:
    """Distance of a point from the line through two points, signed by side; null if they coincide."""
    dx, dy = col(x2) - col(x1), col(y2) - col(y1)
    return (dx * (col(py) - col(y1)) - dy * (col(px) - col(x1))) / F.nullif(F.hypot(dx, dy), F.lit(0.0))


def along_line(px, py, x1, y1, x2, y2) -> Column:
    """How far a point lies along the line through two points, from the first on; null if they coincide."""
    dx, dy = col(x2) - col(x1), col(y2) - col(y1)
    return (dx * (col(px) - col(x1)) + dy * (col(py) - col(y1))) / F.nullif(F.hypot(dx, dy), F.lit(0.0))


def rotate(x, y, degrees) -> tuple[Column, Column]:
    a = F.radians(col(degrees))
    return col(x) * F.cos(a) - col(y) * F.sin(a), col(x) * F.sin(a) + col(y) * F.cos(a)


def long_side_angle(w, h, theta) -> Column:
    """Angle of the long side of a rotated rectangle."""
    return F.when(col(h) > col(w), 90 + col(theta)).otherwise(col(theta))


def inner_rectangle(w, h, degrees) -> tuple[Column, Column]:
    """Width and height of the largest upright rectangle within a rectangle turned by `degrees`."""
    w, h = col(w).cast("double"), col(h).cast("double")
    a = F.radians(col(degrees).cast("double"))
    s, c = F.abs(F.sin(a)), F.abs(F.cos(a))
    long, short = F.greatest(w, h), F.least(w, h)
    half = (short <= 2.0 * s * c * long) | (F.abs(s - c) < 1e-10)
    x = 0.5 * short
    at_w = F.when(w >= h, x / F.nullif(s, F.lit(0.0))).otherwise(x / F.nullif(c, F.lit(0.0)))
    at_h = F.when(w >= h, x / F.nullif(c, F.lit(0.0))).otherwise(x / F.nullif(s, F.lit(0.0)))
    d = F.nullif(c * c - s * s, F.lit(0.0))
    return F.when(half, at_w).otherwise((w * c - h * s) / d), F.when(half, at_h).otherwise((h * c - w * s) / d)


def hsv_in_range(h, s, v, lo: tuple[float, float, float], hi: tuple[float, float, float]) -> Column:
    """Colour range; a hue range whose lower end is above its upper one goes around through 0."""
    hue = col(h).between(lo[0], hi[0]) if lo[0] <= hi[0] else (col(h) >= lo[0]) | (col(h) <= hi[0])
    return hue & col(s).between(lo[1], hi[1]) & col(v).between(lo[2], hi[2])


def complex_parts(re, im) -> tuple[Column, Column]:
    """Modulus and argument."""
    return F.hypot(col(re), col(im)), F.atan2(col(im), col(re))


# Text


#: All space separators of Unicode, which the SQL's trim removes.
BLANKS = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def remapped(x, mapping: Mapping[str, str]) -> Column:
    """x in small letters without outer blanks, replaced where the mapping has it."""
    key = F.lower(F.trim(col(x), F.lit(BLANKS)))
    return F.coalesce(F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])[key], key) if mapping else key


def leading_number(label) -> Column:
    return F.regexp_extract(col(label), r"^\s*(\d+)", 1).try_cast("int")


def first_word(text) -> Column:
    return F.regexp_extract(col(text), r"\w+", 0)


def note_label(index, rep, name) -> Column:
    return F.format_string("%d(%d) - %s", col(index), col(rep), col(name))


def sharps(text) -> Column:
    return F.translate(col(text), "♯", "#")


def extension_swapped(path, extension: str) -> Column:
    return F.regexp_replace(col(path), r"\.[^./\\]*$", extension)


def path_part(path, from_end: int) -> Column:
    """Part of a path counted from its end, 1 being the file."""
    return F.try_element_at(F.split(F.translate(col(path), "\\", "/"), "/"), F.lit(-from_end))


def little_endian(content, at: int) -> Column:
    """Unsigned 32-bit number at byte `at` (from 0) of a binary column."""
    return F.conv(F.hex(F.reverse(F.substring(col(content), at + 1, 4))), 16, 10).cast("long")


#: A time span as people type it: sign, number, unit.
SPAN = r"^([+-]? ?[0-9]*\.?[0-9]+(?:\.|e[+-]?[0-9]+)?) ?(ms|msec|milliseconds|s|sec|secs|seconds|min)?\.?$"


def seconds(text) -> Column:
    """Seconds of a time span as it was typed: decimal point or comma, unit ms, s or min (s if there's none); null if it is none."""
    plain = F.translate(F.lower(F.trim(F.regexp_replace(col(text), r"\s+", " "))), ",−", ".-")
    number = F.translate(F.regexp_extract(plain, SPAN, 1), " ", "").try_cast("double")
    unit = F.regexp_extract(plain, SPAN, 2)
    return F.when(unit.startswith("ms") | unit.startswith("milli"), number / 1000).when(unit == "min", number * 60).otherwise(number)


def without_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """df with the columns that start with prefix renamed to what follows it."""
    return df.withColumnsRenamed({c: c[len(prefix) :] for c in df.columns if c.startswith(prefix) and len(c) > len(prefix)})


# Means that don't depend on the order of rows


def exact_avg(x, digits: int = 6) -> Column:
    """Mean of values with at most `digits` decimals, summed as decimals: the same however rows are spread over tasks."""
    return F.sum(col(x).cast(f"decimal(28,{digits})")).cast("double") / F.count(col(x))


def circular_mean(angle) -> Column:
    return F.atan2(F.avg(F.sin(col(angle))), F.avg(F.cos(col(angle))))
