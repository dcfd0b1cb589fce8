"""Labels from free text: colours, body types and the attributes that a caption names. Column expressions only.

A rule is a label with its phrases. A phrase is found where it stands between word boundaries.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import UNKNOWN

Rules = tuple[tuple[str, tuple[str, ...]], ...]

#: Phrases of colours in answers.
COLOUR_RULES: Rules = (
    ("BLACK", ("black", "jet black", "matte black", "gloss black")),
    ("WHITE", ("white", "pearl white", "off white", "off-white")),
    ("GREY", ("grey", "gray", "dark grey", "dark gray", "light grey", "light gray", "metallic grey", "metallic gray")),
    ("SILVER", ("silver", "metallic silver")),
    ("RED", ("red", "dark red", "light red", "maroon")),
    ("PINK", ("pink", "hot pink", "light pink", "bright pink")),
    ("BLUE", ("blue", "dark blue", "light blue", "navy blue")),
    ("GREEN", ("green", "dark green", "light green", "olive green")),
    ("YELLOW", ("yellow",)),
    ("ORANGE", ("orange",)),
    ("BROWN", ("brown", "dark brown", "light brown")),
    ("BEIGE", ("beige", "tan", "cream")),
    ("PURPLE", ("purple", "violet")),
    ("OTHER", ("other",)),
)
COLOUR_NONE = (
    "", "unknown", "unclear", "unanswerable", "not visible", "not sure", "cannot determine", "cant determine", "unable to determine", "cannot classify", "cannot tell", "cant tell", "not possible to determine",
)
COLOUR_GENERIC = ("qa", "q a", "yes", "no", "answer", "vehicle", "car", "colour", "color", "unanswerable", "cannot determine", "not visible")
UNCERTAIN = ("maybe", "possibly", "probably", "perhaps")
#: Phrases of body types in answers.
BODY_RULES: Rules = (
    ("SUV", ("sport utility vehicle", "sports utility vehicle", "suv")),
    ("SEDAN", ("sedan", "saloon")),
    ("HATCHBACK", ("hatchback", "hatch back")),
    ("MPV", ("multi purpose vehicle", "multi-purpose vehicle", "multipurpose vehicle", "multi utility vehicle", "muv", "mpv", "minivan")),
    ("VAN", ("van",)),
    ("PICKUP", ("pickup truck", "pickup", "pick-up", "pick up")),
    ("COUPE", ("coupé", "coupe")),
    ("CONVERTIBLE", ("convertible", "cabriolet")),
    ("WAGON", ("station wagon", "estate", "wagon")),
)
BODY_NONE = ("", "unknown", "unclear", "not visible", "cannot determine", "cant determine", "unable to determine", "cannot classify", "not sure", "unsure", "unanswerable", "car", "vehicle", "body type")
#: Phrases in captions; of several rules the first counts.
CAPTION_COLOURS: Rules = (
    ("BLACK", ("black", "jet black", "matte black")),
    ("WHITE", ("white", "pearl white", "off white", "off-white", "ivory")),
    ("GREY", ("gray", "grey", "dark gray", "dark grey", "light gray", "light grey", "charcoal", "graphite")),
    ("SILVER", ("silver", "metallic silver")),
    ("BLUE", ("blue", "navy blue", "cobalt", "azure")),
    ("RED", ("red", "maroon", "burgundy", "crimson", "scarlet")),
    ("PINK", ("pink", "hot pink", "light pink", "bright pink", "rose pink")),
    ("GREEN", ("green", "olive", "forest green", "emerald")),
    ("YELLOW", ("yellow", "mustard")),
    ("ORANGE", ("orange", "amber", "rust")),
    ("BROWN", ("brown", "bronze", "copper", "chocolate")),
    ("BEIGE", ("beige", "tan", "sand", "khaki", "cream")),
    ("PURPLE", ("purple", "violet", "plum", "lavender")),
)
CAPTION_BODIES: Rules = (
    ("SUV", ("sport utility vehicle", "sports utility vehicle", "suv")),
    ("SEDAN", ("sedan", "saloon")),
    ("HATCHBACK", ("hatchback", "hatch back")),
    ("MPV", ("multi-purpose vehicle", "multi purpose vehicle", "multi utility vehicle", "multipurpose vehicle", "muv", "mpv")),
    ("PICKUP", ("pickup truck", "pickup", "pick-up", "pick up")),
    ("VAN", ("van", "minivan")),
    ("COUPE", ("coupe",)),
    ("CONVERTIBLE", ("convertible", "cabriolet")),
    ("WAGON", ("station wagon", "estate", "wagon")),
)
CAPTION_NONE = ("", "vehicle", "car", "unknown", "unclear", "cannot determine", "not visible")
PLATE_LIKE = (r"^[A-Z]{2}\d{1,2}[A-Z]{1,3}\d{4}$", r"^\d{2}BH\d{4}[A-Z]{1,2}$")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pattern(phrases: tuple[str, ...]) -> str:
    """A regular expression that finds any of the phrases between word boundaries."""
    return r"\b(?:" + "|".join(re.escape(p).replace(r"\-", "-").replace(r"\ ", " ") for p in phrases) + r")\b"


def _found(text: Column, phrases: tuple[str, ...]) -> Column:
    return text.rlike("(?U)" + pattern(phrases))


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def cleaned(text: Column) -> Column:
    """Lower case, one space between words, underscores as spaces, punctuation but hyphens as spaces; null is empty."""
    low = _squeezed(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("_"), F.lit(" ")))
    return _squeezed(F.regexp_replace(low, r"(?U)[^\w\s-]", " "))


def plain(text: Column) -> Column:
    """Lower case, everything but a-z, 0-9, spaces and hyphens as spaces, one space between words; null is empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9 -]+", " "), r"\s+", " "))


def _answer(label: Column | str, reason: str) -> Column:
    return F.struct((F.lit(label) if isinstance(label, str) else label).alias("label"), F.lit(reason).alias("reason"))


def _by_rules(text: Column, rules: Rules) -> Column:
    """(label, reason) of cleaned text: a rule's phrase as the whole text, else the one rule that has a phrase in it."""
    exact = F.coalesce(*(F.when(text.isin(*phrases), F.lit(label)) for label, phrases in rules))
    held = F.filter(F.array(*(F.when(_found(text, phrases), F.lit(label)) for label, phrases in rules)), lambda x: x.isNotNull())
    several = lambda h: F.when(F.size(h) > 1, _answer(UNKNOWN, "ambiguous_multiple_labels")).when(F.size(h) == 1, _answer(F.get(h, 0), "contained_phrase_match")).otherwise(_answer(UNKNOWN, "unexpected_output"))
    return _let(exact, lambda label: F.when(label.isNotNull(), _answer(label, "exact_phrase_match")).otherwise(_let(held, several)))


def colour_label(text: Column) -> Column:
    """struct<label, reason> of an answer that should name a colour."""

    def label(t: Column) -> Column:
        refused = F.when(t.isin(*COLOUR_NONE), _answer(UNKNOWN, "unknown_phrase")).when(t.isin(*COLOUR_GENERIC), _answer(UNKNOWN, "generic_invalid_response"))
        return refused.when(_found(t, UNCERTAIN), _answer(UNKNOWN, "uncertain_response")).otherwise(_by_rules(t, COLOUR_RULES))

    return _let(cleaned(text), label)


def response_kind(text: Column, reason: Column) -> Column:
    """What kind of answer a reason of colour_label speaks of."""
    generic = cleaned(text).isin(*COLOUR_GENERIC) | (reason == "generic_invalid_response")
    return (
        F.when(generic, "generic_invalid").when(reason == "ambiguous_multiple_labels", "ambiguous").when(reason.isin("exact_phrase_match", "contained_phrase_match"), "valid")
        .when(reason == "unknown_phrase", "unknown_phrase").otherwise("invalid")
    )


def body_type_label(text: Column) -> Column:
    """struct<label, reason> of an answer that should name a body type."""
    return _let(cleaned(text), lambda t: F.when(t.isin(*BODY_NONE), _answer(UNKNOWN, "unknown_phrase")).otherwise(_by_rules(t, BODY_RULES)))


def first_phrase(text: Column, rules: Rules) -> Column:
    """struct<phrase, label> of the first rule with a phrase in plain text: the longest such phrase of that rule; null without one."""
    longest = lambda phrases: F.coalesce(*(F.when(_found(text, (p,)), F.lit(p)) for p in sorted(phrases, key=len, reverse=True)))
    return F.coalesce(*(F.when(_found(text, phrases), F.struct(longest(phrases).alias("phrase"), F.lit(label).alias("label"))) for label, phrases in rules))


def named_field(text: Column, *names: str) -> Column:
    """What follows the first of the names that stands with a colon in the text; null where none does or nothing follows."""
    value = lambda n: F.nullif(F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?i)\b{n}\s*:\s*([A-Za-z -]+)", 1)), F.lit(""))
    return F.coalesce(*map(value, names))


def looks_like_plate(text: Column) -> Column:
    bare = F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9]", "")
    return bare.rlike(PLATE_LIKE[0]) | bare.rlike(PLATE_LIKE[1])


def caption_attributes(caption: Column) -> Column:
    """struct<body_phrase, body_type, body_reason, colour_phrase, colour, colour_reason> of a caption.

    A named field (COLOUR:, BODY_TYPE:) comes before the rest of the text. Captions that look like a plate or say nothing
    have no attributes.
    """
    names = ("body_phrase", "body_type", "body_reason", "colour_phrase", "colour", "colour_reason")
    made = lambda *values: F.struct(*(v.cast("string").alias(n) for n, v in zip(names, values)))
    none = lambda reason: made(F.lit(None), F.lit(UNKNOWN), F.lit(reason), F.lit(None), F.lit(UNKNOWN), F.lit(reason))
    whole = lambda x: _let(body_type_label(x)["label"], lambda label: F.when(label != UNKNOWN, F.struct(x.alias("phrase"), label.alias("label"))))
    named = lambda said, rules: _let(plain(said), lambda t: first_phrase(t, rules))

    def parsed(text: Column) -> Column:
        colour = F.coalesce(_let(named_field(caption, "COLOUR", "COLOR"), lambda said: named(said, CAPTION_COLOURS)), first_phrase(text, CAPTION_COLOURS))
        in_field = _let(named_field(caption, "BODY_TYPE", "BODY TYPE"), lambda said: F.when(said.isNotNull(), F.coalesce(whole(said), named(said, CAPTION_BODIES))))
        body = F.coalesce(in_field, whole(caption), first_phrase(text, CAPTION_BODIES))
        found = lambda b, c: made(
            b["phrase"], F.coalesce(b["label"], F.lit(UNKNOWN)), F.when(b.isNotNull(), "caption_keyword_match").otherwise("no_explicit_body_type"),
            c["phrase"], F.coalesce(c["label"], F.lit(UNKNOWN)), F.when(c.isNotNull(), "caption_colour_phrase").otherwise("no_vehicle_colour_phrase"),
        )
        told = F.when(looks_like_plate(caption), none("plate_like_response_in_attribute_path")).when(text.isin(*CAPTION_NONE), none("generic_caption"))
        return told.otherwise(_let(body, lambda b: _let(colour, lambda c: found(b, c))))

    return _let(plain(caption), parsed)
