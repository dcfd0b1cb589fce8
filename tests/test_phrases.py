"""Labels in free text: exact, contained, ambiguous, refused and odd texts."""

import pytest
from pyspark.sql import functions as F

from vialytics.functions import phrases

COLOURS = {
    "Black": ("BLACK", "exact_phrase_match", "valid"), "  OFF_WHITE ": ("WHITE", "exact_phrase_match", "valid"), "off-white": ("WHITE", "exact_phrase_match", "valid"), "It is dark  grey.": ("GREY", "contained_phrase_match", "valid"),
    "black or white": ("UNKNOWN", "ambiguous_multiple_labels", "ambiguous"), "maybe blue": ("UNKNOWN", "uncertain_response", "invalid"), "not visible!": ("UNKNOWN", "unknown_phrase", "generic_invalid"), "car": ("UNKNOWN", "generic_invalid_response", "generic_invalid"),
    None: ("UNKNOWN", "unknown_phrase", "unknown_phrase"), "": ("UNKNOWN", "unknown_phrase", "unknown_phrase"), "reddish": ("UNKNOWN", "unexpected_output", "invalid"), "tanned redwood": ("UNKNOWN", "unexpected_output", "invalid"), "blue, navy blue": ("BLUE", "contained_phrase_match", "valid"),
}
BODIES = {
    "coupé": ("COUPE", "exact_phrase_match"), "A sports utility vehicle": ("SUV", "contained_phrase_match"), "pick-up": ("PICKUP", "exact_phrase_match"), "van or minivan": ("UNKNOWN", "ambiguous_multiple_labels"), "minivan": ("MPV", "exact_phrase_match"),
    "caravan": ("UNKNOWN", "unexpected_output"), "Body_Type": ("UNKNOWN", "unknown_phrase"), None: ("UNKNOWN", "unknown_phrase"),
}
CAPTIONS = {
    "A jet black sedan on a road": ("A jet black sedan on a road", "SEDAN", "caption_keyword_match", "jet black", "BLACK", "caption_colour_phrase"),
    "white roof, COLOUR: navy blue; BODY TYPE: pick up": ("pick up", "PICKUP", "caption_keyword_match", "navy blue", "BLUE", "caption_colour_phrase"),
    "color: unclear; ivory van or suv": ("suv", "SUV", "caption_keyword_match", "ivory", "WHITE", "caption_colour_phrase"),
    "something in red": (None, "UNKNOWN", "no_explicit_body_type", "red", "RED", "caption_colour_phrase"),
    "HR 26 DK 8337": (None, "UNKNOWN", "plate_like_response_in_attribute_path", None, "UNKNOWN", "plate_like_response_in_attribute_path"),
    "22bh1234aa": (None, "UNKNOWN", "plate_like_response_in_attribute_path", None, "UNKNOWN", "plate_like_response_in_attribute_path"),
    "Vehicle.": (None, "UNKNOWN", "generic_caption", None, "UNKNOWN", "generic_caption"),
    None: (None, "UNKNOWN", "generic_caption", None, "UNKNOWN", "generic_caption"),
    "a bus": (None, "UNKNOWN", "no_explicit_body_type", None, "UNKNOWN", "no_vehicle_colour_phrase"),
}


def frame(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "t string")


@pytest.mark.parametrize("label, want", [(phrases.colour_label, {t: w[:2] for t, w in COLOURS.items()}), (phrases.body_type_label, BODIES)])
def test_labels(spark, label, want):
    assert {r.t: tuple(r.x) for r in frame(spark, want).withColumn("x", label(F.col("t"))).collect()} == want


def test_kinds_of_answers(spark):
    kind = phrases.response_kind(F.col("t"), phrases.colour_label(F.col("t"))["reason"])
    assert {r.t: r.k for r in frame(spark, COLOURS).withColumn("k", kind).collect()} == {t: w[2] for t, w in COLOURS.items()}


def test_captions(spark):
    assert {r.t: tuple(r.x) for r in frame(spark, CAPTIONS).withColumn("x", phrases.caption_attributes(F.col("t"))).collect()} == CAPTIONS
