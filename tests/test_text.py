import re

from pyspark.sql import functions as F

from conftest import rows
from tidemark.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_tokens_keep_case_only_with_digits(spark):
    assert one(spark, "MAIN B bus O2 o2 MP-1.2_x -y", T.tokenize) == ["main", "b", "bus", "O2", "o2", "MP-1.2_x", "y"]


def test_salience_takes_phrases_then_lexicon_without_repeats(spark):
    assert one(spark, "We had a MAIN BUS B UNDERVOLT and a bang, 123, OK", T.salience) == "MAIN BUS B UNDERVOLT undervolt bang bus"
    assert one(spark, "the BUS on the bus", T.salience) == "BUS"
    assert one(spark, None, T.salience) == ""


def test_fallback_drops_stop_and_short_words(spark):
    assert one(spark, "water leak at the B-nut of it", T.fallback_tokens) == ["water", "leak", "b-nut"]


def test_turns(spark):
    assert one(spark, "Short. This one is long enough; and so is this one", T.turns) == ["This one is long enough;", "and so is this one"]
    assert one(spark, " tiny ", T.turns) == ["tiny"]


def test_diagnostic_text(spark):
    assert one(spark, "The valve stuck open. Redesign was recommended.", T.diagnostic_text) == "The valve stuck open."
    assert one(spark, "Redesign was recommended.", lambda c: T.diagnostic_text(c, True)) == "Redesign was recommended."


def test_durations(spark):
    assert one(spark, "55:55:39", T.elapsed_seconds) == 201339
    assert one(spark, "56:09:xx", T.elapsed_seconds) is None
    assert one(spark, "810", T.duration) == "13 min 30 s"
    assert one(spark, "59", T.duration) == "59 s"
    assert one(spark, "7260", T.duration) == "2 h 1 min"


def test_channels(spark):
    signals, speech = one(spark, "Houston MASTER ALARM came on with pressure 12 strange noise", T.channels)
    assert signals.split()[:2] == ["MASTER", "ALARM"] and "pressure" in signals and "12" in signals
    assert speech == "came strange noise"


def test_crew_lines(spark):
    quote = "[note] CREW REPORT first: 055:55:20 LMP: Okay, we've had a problem here. 055:55:28 CC: This is the ground. 055:55:35 CDR: (pause) Main B bus undervolt."
    assert one(spark, quote, T.crew_lines) == "Okay, we've had a problem here. Main B bus undervolt."


def test_normal_forms(spark):
    assert one(spark, "  Tank-2,  O2! ", T.normalized) == "tank 2 o2"
    assert one(spark, "O-ring B", T.squeezed) == "oringb"
    assert rows(spark.range(1).select(T.collapse(F.lit(" a \n b "), 3))) == [("a b",)]


def test_match_spans_against_re(spark):
    long = "".join(f"{'é' * (i % 3)}a{i}😀 " for i in range(2000))
    for text in (long, "a1", "xa1", "a1x", "none", "", None):
        got = one(spark, text, lambda c: T.match_spans(c, "a[0-9]+"))
        want = None if text is None else [(m.start(), m.end(), m.group()) for m in re.finditer("a[0-9]+", text)]
        assert (None if got is None else [tuple(m) for m in got]) == want
