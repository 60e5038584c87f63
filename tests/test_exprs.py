import math

import pytest
from pyspark.sql import functions as F

from ostinato.functions import exprs


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "column, want",
    [
        (lambda: exprs.next_power_of_two(F.lit(1024)), 1024),
        (lambda: exprs.next_power_of_two(F.lit(1025)), 2048),
        (lambda: exprs.name_to_midi(F.lit("A4")), 69),
        (lambda: exprs.name_to_midi(F.lit("C#4")), 61),
        (lambda: exprs.name_to_midi(F.lit("Bb3")), 58),
        (lambda: exprs.name_to_midi(F.lit("C♯4")), 61),
        (lambda: exprs.name_to_midi(F.lit("H2")), None),
        (lambda: exprs.midi_to_name(F.lit(60)), "C4"),
        (lambda: exprs.hz_to_midi(F.lit(440.0)), 69),
        (lambda: exprs.hz_to_midi(F.lit(0.0)), 0),
        (lambda: exprs.midi_to_hz(F.lit(81)), 880.0),
        (lambda: exprs.semitones(F.lit(880.0)), 12.0),
        (lambda: exprs.semitones(F.lit(-1.0)), None),
        (lambda: exprs.cents(F.lit(440.0), F.lit(440.0)), 200.0),
        (lambda: exprs.amplitude_db(F.lit(10.0)), 20.0),
        (lambda: exprs.spl_db(F.lit(2e-5)), 0.0),
        (lambda: exprs.relative_db(F.lit(0.0), F.lit(1.0)), 0.0),
        (lambda: exprs.wrap(F.lit(0.75), 1), -0.25),
        (lambda: exprs.wrap(F.lit(4.0), 2 * math.pi), 4.0 - 2 * math.pi),
        (lambda: exprs.round_half_even(F.lit(2.5)), 2.0),
        (lambda: exprs.segment_angle(F.lit(1.0), F.lit(1.0)), 45.0),
        (lambda: exprs.segment_angle(F.lit(0.0), F.lit(1.0)), None),
        (lambda: exprs.point_line(F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(0.0)), 1.0),
        (lambda: exprs.long_side_angle(F.lit(1), F.lit(2), F.lit(10.0)), 100.0),
        (lambda: exprs.inner_rectangle(F.lit(4.0), F.lit(2.0), F.lit(0.0))[0], 4.0),
        (lambda: exprs.inner_rectangle(F.lit(4.0), F.lit(2.0), F.lit(90.0))[0], 2.0),
        (lambda: exprs.leading_number(F.lit("12(1) - G4")), 12),
        (lambda: exprs.leading_number(F.lit("x")), None),
        (lambda: exprs.note_label(F.lit(12), F.lit(1), F.lit("G4")), "12(1) - G4"),
        (lambda: exprs.path_part(F.lit("a\\b/c.wav"), 2), "b"),
        (lambda: exprs.extension_swapped(F.lit("a.b/c.wav"), ".TextGrid"), "a.b/c.TextGrid"),
        (lambda: exprs.hsv_in_range(F.lit(175), F.lit(50), F.lit(50), (170, 0, 0), (10, 255, 255)), True),
        (lambda: exprs.hsv_in_range(F.lit(90), F.lit(50), F.lit(50), (170, 0, 0), (10, 255, 255)), False),
    ],
)
def test_known_answers(spark, column, want):
    got = value(spark, column())
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


def test_exact_mean_and_circle(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.3,)], "x double")
    assert df.agg(exprs.exact_avg("x").alias("m")).first()["m"] == 0.6 / 3
    turns = spark.createDataFrame([(math.pi - 0.1,), (-math.pi + 0.1,)], "a double")
    assert abs(abs(turns.agg(exprs.circular_mean("a").alias("m")).first()["m"]) - math.pi) < 1e-9
