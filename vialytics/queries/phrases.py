"""Queries for labels in free text. A track's answer is made of its order's number and customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import phrases
from ..sources.testdata import read
from .registry import query

COLOURS = [
    "jet black", "Off-White", "light_grey", "metallic silver", "maroon", "hot pink", "navy blue", "olive green", "yellow", "dark orange", "brown!", "tan", "violet", "other", "greyish", "black and white", "maybe red", "possibly", "car", "not visible",
    "the colour is silver", "crimson", "ivory", "forest green", "rust", "charcoal", "",
]
BODIES = ["sedan", "Sports Utility Vehicle", "hatch back", "multi-purpose vehicle", "minivan", "van", "pick-up", "Pick_up truck", "coupe", "cabriolet", "station wagon", "estate", "bus", "suv or sedan", "body type", "HR26AB1234", "22 BH 1234 AA", "saloon."]
_TEMPLATES = [("", " ", ""), ("The vehicle is ", ". It may be a ", ""), ("COLOUR: ", "; BODY_TYPE: ", ""), ("A  parked ", " vehicle, ", " (unclear)"), ("color: ", ", ", "")]


def _listed(words: list[str], at: str) -> tuple[str, str]:
    """The word at a place, for Spark and for the other engine."""
    listed = ", ".join(repr(w) for w in words)
    return f"element_at(array({listed}), cast({at} as int))", f"[{listed}][{at}]"


_COLOUR, _COLOUR_SQL = _listed(COLOURS, f"(o_orderkey % {len(COLOURS)}) + 1")
_BODY, _BODY_SQL = _listed(BODIES, f"(o_custkey % {len(BODIES)}) + 1")
_PARTS = [_listed([t[i] for t in _TEMPLATES], f"((o_orderkey + o_custkey) % {len(_TEMPLATES)}) + 1") for i in range(3)]
_ANSWERS = f"a as (select o_orderkey as track_no, case when o_orderkey % 41 = 0 then null else {_COLOUR_SQL} end as colour_answer, case when o_orderkey % 43 = 0 then null else {_BODY_SQL} end as body_answer from orders)"
_CAPTIONS = f"c as (select o_orderkey as track_no, case when o_orderkey % 47 = 0 then null when o_orderkey % 7 = 0 then {_BODY_SQL} when o_orderkey % 11 = 0 then {_COLOUR_SQL} else concat({_PARTS[0][1]}, {_COLOUR_SQL}, {_PARTS[1][1]}, {_BODY_SQL}, {_PARTS[2][1]}) end as caption from orders)"


def _answers(spark, sf_dir):
    answer = "case when o_orderkey % {0} = 0 then null else {1} end as {2}".format
    return read(spark, sf_dir, "orders").selectExpr("o_orderkey as track_no", answer(41, _COLOUR, "colour_answer"), answer(43, _BODY, "body_answer"))


def _captions(spark, sf_dir):
    full = f"concat({_PARTS[0][0]}, {_COLOUR}, {_PARTS[1][0]}, {_BODY}, {_PARTS[2][0]})"
    caption = f"case when o_orderkey % 47 = 0 then null when o_orderkey % 7 = 0 then {_BODY} when o_orderkey % 11 = 0 then {_COLOUR} else {full} end as caption"
    return read(spark, sf_dir, "orders").selectExpr("o_orderkey as track_no", caption)


def _in(words) -> str:
    return "(" + ", ".join(repr(w) for w in words) + ")"


def _clean_sql(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(replace(lower(coalesce({c}, '')), '_', ' '), '[^\w\s-]', ' ', 'g'), '\s+', ' ', 'g'))"


def _plain_sql(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9 -]+', ' ', 'g'), '\s+', ' ', 'g'))"


def _held_sql(rules, c: str) -> str:
    return "list_filter([" + ", ".join(f"case when regexp_matches({c}, '{phrases.pattern(p)}') then '{label}' end" for label, p in rules) + "], lambda x: x is not null)"


def _exact_sql(rules, c: str) -> str:
    return "case " + " ".join(f"when {c} in {_in(p)} then '{label}'" for label, p in rules) + " end"


def _first_sql(rules, c: str) -> str:
    """The longest phrase of the first rule that has one."""
    return "case " + " ".join(f"when regexp_matches({c}, '{phrases.pattern((p,))}') then {{'phrase': '{p}', 'label': '{label}'}}" for label, ps in rules for p in sorted(ps, key=len, reverse=True)) + " end"


def _labels_sql(first: str) -> str:
    """label and reason from t, exact and held; first decides before the rules do."""
    label = f"case when {first} is not null then 'UNKNOWN' when exact is not null then exact when len(held) = 1 then held[1] else 'UNKNOWN' end"
    reason = f"coalesce({first}, case when exact is not null then 'exact_phrase_match' when len(held) > 1 then 'ambiguous_multiple_labels' when len(held) = 1 then 'contained_phrase_match' else 'unexpected_output' end)"
    return f"{label} as label, {reason} as reason"


_NO_COLOUR = f"case when t in {_in(phrases.COLOUR_NONE)} then 'unknown_phrase' when t in {_in(phrases.COLOUR_GENERIC)} then 'generic_invalid_response' when regexp_matches(t, '{phrases.pattern(phrases.UNCERTAIN)}') then 'uncertain_response' end"
_NO_BODY = f"case when t in {_in(phrases.BODY_NONE)} then 'unknown_phrase' end"


@query(
    f"""with {_ANSWERS}, r as (select *, {_clean_sql("colour_answer")} as t from a), s as (select *, {_exact_sql(phrases.COLOUR_RULES, "t")} as exact, {_held_sql(phrases.COLOUR_RULES, "t")} as held from r),
    l as (select track_no, t, {_labels_sql(_NO_COLOUR)} from s)
    select track_no, label, reason, case when t in {_in(phrases.COLOUR_GENERIC)} then 'generic_invalid' when reason = 'ambiguous_multiple_labels' then 'ambiguous' when reason like '%phrase_match' then 'valid' when reason = 'unknown_phrase' then 'unknown_phrase' else 'invalid' end as kind from l"""
)
def colour_answers(spark, sf_dir):
    """Colours from answers in free text, with the reason and the kind of answer."""
    rows = _answers(spark, sf_dir).withColumn("found", phrases.colour_label(F.col("colour_answer")))
    return rows.select("track_no", "found.label", "found.reason", phrases.response_kind(F.col("colour_answer"), F.col("found.reason")).alias("kind"))


@query(f"with {_ANSWERS}, r as (select *, {_clean_sql('body_answer')} as t from a), s as (select *, {_exact_sql(phrases.BODY_RULES, 't')} as exact, {_held_sql(phrases.BODY_RULES, 't')} as held from r) select track_no, {_labels_sql(_NO_BODY)} from s")
def body_type_answers(spark, sf_dir):
    """Body types from answers in free text."""
    return _answers(spark, sf_dir).withColumn("found", phrases.body_type_label(F.col("body_answer"))).select("track_no", "found.*")


def _field_sql(*names: str) -> str:
    return "coalesce(" + ", ".join(rf"nullif(trim(regexp_extract(coalesce(caption, ''), '(?i)\b{n}\s*:\s*([A-Za-z -]+)', 1)), '')" for n in names) + ")"


def _body_sql(c: str, alias: str) -> str:
    t = _clean_sql(c)
    known = f"case when {t} in {_in(phrases.BODY_NONE)} then null else coalesce({_exact_sql(phrases.BODY_RULES, t)}, case when len({_held_sql(phrases.BODY_RULES, t)}) = 1 then {_held_sql(phrases.BODY_RULES, t)}[1] end) end"
    return f"{known} as {alias}"


@query(
    f"""with {_CAPTIONS}, f as (select *, {_plain_sql("caption")} as t, {_field_sql("COLOUR", "COLOR")} as sc, {_field_sql("BODY_TYPE", "BODY TYPE")} as sb, regexp_replace(upper(coalesce(caption, '')), '[^A-Z0-9]', '', 'g') as bare from c),
    g as (select *, coalesce({_first_sql(phrases.CAPTION_COLOURS, _plain_sql("sc"))}, {_first_sql(phrases.CAPTION_COLOURS, "t")}) as colour_found, {_body_sql("sb", "b1")}, {_first_sql(phrases.CAPTION_BODIES, _plain_sql("sb"))} as b2, {_body_sql("caption", "b3")}, {_first_sql(phrases.CAPTION_BODIES, "t")} as b4 from f),
    h as (select *, case when sb is not null and b1 is not null then {{'phrase': sb, 'label': b1}} when sb is not null and b2 is not null then b2 when b3 is not null then {{'phrase': caption, 'label': b3}} else b4 end as body_found,
      case when regexp_matches(bare, '{phrases.PLATE_LIKE[0]}') or regexp_matches(bare, '{phrases.PLATE_LIKE[1]}') then 'plate_like_response_in_attribute_path' when t in {_in(phrases.CAPTION_NONE)} then 'generic_caption' end as none from g)
    select track_no, case when none is null then body_found.phrase end as body_phrase, case when none is null then coalesce(body_found.label, 'UNKNOWN') else 'UNKNOWN' end as body_type,
    coalesce(none, case when body_found is not null then 'caption_keyword_match' else 'no_explicit_body_type' end) as body_reason, case when none is null then colour_found.phrase end as colour_phrase,
    case when none is null then coalesce(colour_found.label, 'UNKNOWN') else 'UNKNOWN' end as colour, coalesce(none, case when colour_found is not null then 'caption_colour_phrase' else 'no_vehicle_colour_phrase' end) as colour_reason from h"""
)
def caption_attributes(spark, sf_dir):
    """Body type and colour that a caption names, with the phrase and the reason."""
    return _captions(spark, sf_dir).withColumn("found", phrases.caption_attributes(F.col("caption"))).select("track_no", "found.*")
