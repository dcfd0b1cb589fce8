"""Queries for repository lists: filters, joins with what belongs to a track, and orders."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.labels import COLOUR_ALIASES, short_track_id, track_number
from ..functions.plates import normalized
from ..operators import imports
from ..operators.records import canonical_plate, first_of, prefer_physical
from ..sources.testdata import OBSERVATIONS, VEHICLES, observations, read, vehicle_records
from .registry import query

ALL = f"with v as ({VEHICLES}) "
BOTH = f"with v as ({VEHICLES}), o as ({OBSERVATIONS}) "


@query(ALL + "select vehicle_id from v where upper(vehicle_class) = upper('car') and (vehicle_id like '%7' or split_part(vehicle_id, ':', 2) = 'TRACK_100') and first_seen_seconds <= 400 and coalesce(last_seen_seconds, first_seen_seconds) >= 100")
def flt_repository_list(spark, sf_dir):
    """Class without regard to case, short or full ids, and overlap with a time."""
    rows = vehicle_records(spark, sf_dir)
    named = F.col("vehicle_id").endswith("7") | (short_track_id(F.col("vehicle_id")) == "TRACK_100")
    overlap = (F.col("first_seen_seconds") <= 400) & (F.coalesce("last_seen_seconds", "first_seen_seconds") >= 100)
    return rows.where((F.upper("vehicle_class") == F.upper(F.lit("car"))) & named & overlap).select("vehicle_id")


@query(ALL + "select vehicle_id, plate_text from v where regexp_replace(upper(plate_text), '[^A-Z0-9]', '', 'g') = (select min(regexp_replace(upper(plate_text), '[^A-Z0-9]', '', 'g')) from v)")
def flt_plate_normalized(spark, sf_dir):
    """Records whose plate equals the smallest one, whatever its spelling; the smallest is one row."""
    rows = vehicle_records(spark, sf_dir).withColumn("plain", normalized(F.col("plate_text")))
    least = rows.agg(F.min("plain").alias("least"))
    return rows.join(F.broadcast(least), F.col("plain") == F.col("least")).select("vehicle_id", "plate_text")


@query(ALL + ", w as (select *, case when track_no % 9 = 0 then 'PINK' else colour end as c from v) select run_id, c as colour, count(*) as n from w where c in ('RED', 'PINK') group by 1, 2")
def flt_colour_search(spark, sf_dir):
    """A search for RED that also means PINK."""
    colour = F.when(F.col("track_no") % 9 == 0, "PINK").otherwise(F.col("colour"))
    return vehicle_records(spark, sf_dir).withColumn("colour", colour).where(F.col("colour").isin(*COLOUR_ALIASES["RED"])).groupBy("run_id", "colour").agg(F.count("*").alias("n"))


@query(BOTH + ", c as (select run_id, camera_id, count(*) as tracks, count(*) filter (status = 'COMPLETED') as done from v group by 1, 2) select run_id, camera_id from c where camera_id <> 'CAM_001' or tracks > 150")
def camera_participates(spark, sf_dir):
    """Cameras that are enabled (all but CAM_001) or have counted enough."""
    rows = vehicle_records(spark, sf_dir).groupBy("run_id", "camera_id").agg(F.count("*").alias("tracks"))
    return rows.where((F.col("camera_id") != "CAM_001") | (F.col("tracks") > 150)).select("run_id", "camera_id")


@query(
    BOTH
    + """, e as (select track_no, arg_max(raw_class_name, frame_number) as label, max(frame_number) as last_frame from o where confidence >= 0.7 group by 1) select vehicle_id, status, label, last_frame from v left join e using (track_no)"""
)
def tracks_enrichment_last(spark, sf_dir):
    """Tracks with their enrichment; of several the last counts, a track without one stays."""
    last = first_of(observations(spark, sf_dir).where("confidence >= 0.7"), ["track_no"], F.desc("frame_number"))
    return vehicle_records(spark, sf_dir).select("track_no", "vehicle_id", "status").join(last.select("track_no", F.col("raw_class_name").alias("label"), F.col("frame_number").alias("last_frame")), "track_no", "left").drop("track_no")


_MEDIA = "select distinct track_no, frame_number, concat('crops/', cast(track_no as varchar(20)), '_', cast(frame_number as varchar(20)), '.jpg') as path from o where frame_number % 2 = 0"


@query(
    BOTH
    + f""", m as ({_MEDIA}), n as (select track_no, frame_number, concat('plates/', cast(track_no as varchar(20))) as path from o where frame_number % 3 = 0), f as (select track_no, frame_number, concat('full/', cast(frame_number as varchar(20))) as path from o where frame_number % 5 = 0)
    select o.track_no, o.frame_number, m.path as crop, coalesce(n.path, f.path) as shown from o left join m using (track_no, frame_number) left join n using (track_no, frame_number) left join f using (track_no, frame_number)"""
)
def evidence_media(spark, sf_dir):
    """Evidence with its crop, and the annotated picture or else the source."""
    rows = observations(spark, sf_dir).select("track_no", "frame_number")
    media = lambda every, name, *parts: rows.where(F.col("frame_number") % every == 0).select("track_no", "frame_number", F.concat(*parts).alias(name))
    text = lambda c: F.col(c).cast("string")
    crop = media(2, "crop", F.lit("crops/"), text("track_no"), F.lit("_"), text("frame_number"), F.lit(".jpg"))
    plate, full = media(3, "a", F.lit("plates/"), text("track_no")), media(5, "b", F.lit("full/"), text("frame_number"))
    key = ["track_no", "frame_number"]
    return rows.join(crop, key, "left").join(plate, key, "left").join(full, key, "left").select(*key, "crop", F.coalesce("a", "b").alias("shown"))


@query(BOTH + ", a as (select camera_id, max(frame_number) as last_frame, count(*) as rows from o group by 1) select n_nationkey, a.camera_id, last_frame, coalesce(rows, 0) as rows from nation left join a on a.camera_id = concat('CAM_00', cast(cast(floor(n_nationkey / 5) as int) + 1 as varchar(10)))")
def camera_aggregate(spark, sf_dir):
    """Every place with its camera's last frame and number of observations."""
    sums = observations(spark, sf_dir).groupBy("camera_id").agg(F.max("frame_number").alias("last_frame"), F.count("*").alias("rows"))
    places = read(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("CAM_00"), (F.floor(F.col("n_nationkey") / 5) + 1).cast("int").cast("string")).alias("camera"))
    return places.join(sums, F.col("camera") == F.col("camera_id"), "left").select("n_nationkey", "camera_id", "last_frame", F.coalesce("rows", F.lit(0)).alias("rows"))


@query(ALL + ", r as (select run_id, max(last_seen_seconds) as ended, min(first_seen_seconds) as started from v group by 1) select run_id, cast(row_number() over (order by coalesce(ended, started) desc, run_id desc) as int) as place from r")
def list_runs_order(spark, sf_dir):
    """Runs, the one that ended last first; one row a run."""
    runs = vehicle_records(spark, sf_dir).groupBy("run_id").agg(F.max("last_seen_seconds").alias("ended"), F.min("first_seen_seconds").alias("started"))
    return runs.select("run_id", F.row_number().over(Window.orderBy(F.desc(F.coalesce("ended", "started")), F.desc("run_id"))).alias("place"))


@query(ALL + f"select run_id, camera_id, vehicle_id, cast(row_number() over (partition by run_id, camera_id order by camera_id desc, vehicle_id desc, track_no) as int) as place from v")
def list_tracks_order(spark, sf_dir):
    """Tracks of each run and camera, the largest id first."""
    own = Window.partitionBy("run_id", "camera_id").orderBy(F.desc("camera_id"), F.desc("vehicle_id"), "track_no")
    return vehicle_records(spark, sf_dir).select("run_id", "camera_id", "vehicle_id", F.row_number().over(own).alias("place"))


@query(ALL + f"select run_id, vehicle_id, last_seen_seconds, cast(row_number() over (partition by run_id, camera_id order by last_seen_seconds desc nulls last, vehicle_id desc, track_no) as int) as place from v")
def list_vehicles_order(spark, sf_dir):
    """Vehicles of each run and camera, the last seen first; those without an end come last."""
    own = Window.partitionBy("run_id", "camera_id").orderBy(F.desc_nulls_last("last_seen_seconds"), F.desc("vehicle_id"), "track_no")
    return vehicle_records(spark, sf_dir).select("run_id", "vehicle_id", "last_seen_seconds", F.row_number().over(own).alias("place"))


#: Evidence roles in the order in which lists show them.
ROLES = ("BEST_OVERALL", "SHARPEST", "LARGEST", "OTHER")
_ROLE = "case when frame_number % 7 = 0 then 'BEST_OVERALL' when frame_number % 5 = 0 then 'SHARPEST' when frame_number % 3 = 0 then 'LARGEST' else 'OTHER' end"


@query(BOTH + f", r as (select track_no, frame_number, confidence, {_ROLE} as role from o) select track_no, frame_number, role, cast(row_number() over (partition by track_no order by case role when 'BEST_OVERALL' then 0 when 'SHARPEST' then 1 when 'LARGEST' then 2 else 3 end, confidence desc nulls last, frame_number) as int) as place from r")
def list_evidence_roles(spark, sf_dir):
    """Evidence of each track by role, then confidence."""
    rank = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))
    own = Window.partitionBy("track_no").orderBy(rank, F.desc_nulls_last("confidence"), "frame_number")
    return observations(spark, sf_dir).select("track_no", "frame_number", "confidence", F.expr(_ROLE).alias("role")).select("track_no", "frame_number", "role", F.row_number().over(own).alias("place"))


#: Media of a source that names every n-th frame, every m-th of them as a plate; some have no relative path.
_NAME = "concat(cast(track_no as varchar(20)), '_', cast(frame_number as varchar(20)), '.jpg')"
_CROP = ["case when frame_number % {1} = 0 then 'plate' else 'crop' end as media_type", f"case when frame_number % 10 <> 0 then concat('crops/', {_NAME}) end as relative_path", f"concat('/runs/', run_id, '/', {_NAME}) as original_path", "track_no"]
_SOURCES = ((2, 6), (3, 6), (4, 12))


@query(
    BOTH
    + ", m as ("
    + " union all ".join(f"select {', '.join(_CROP).format(n, m)}, {i} as source from o where frame_number % {n} = 0" for i, (n, m) in enumerate(_SOURCES))
    + ") select media_type, relative_path, original_path, min(track_no) as track_no, min(source) as source, count(*) as seen from m group by 1, 2, 3"
)
def media_dedupe(spark, sf_dir):
    """Media that evidence, plates and enrichment name, each once."""
    seen = observations(spark, sf_dir)
    return imports.first_media(*(seen.where(F.col("frame_number") % n == 0).selectExpr(*(c.format(n, m) for c in _CROP)) for n, m in _SOURCES))


@query(ALL + "select owner, string_agg(vehicle_class, ',' order by first_no) as classes from (select owner, vehicle_class, min(track_no) as first_no from v group by 1, 2) x group by 1")
def ordered_dedupe(spark, sf_dir):
    """Classes of an owner's vehicles, each once, in the order in which they first came."""
    rows = vehicle_records(spark, sf_dir).groupBy("owner", "vehicle_class").agg(F.min("track_no").alias("first_no"))
    lists = rows.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("first_no", "vehicle_class"))).alias("l"))  # one entry a class
    return lists.select("owner", F.concat_ws(",", F.array_distinct(F.transform("l", lambda x: x["vehicle_class"]))).alias("classes"))


@query(
    BOTH
    + """, i as (select 'ERROR' as severity, 'invalid_observation_time' as code, count(*) as rows from o where timestamp_seconds < 1 union all
    select 'WARNING', 'orphan_track', count(*) from v where track_no not in (select track_no from o) union all select 'INFO', 'plate_without_detection', count(*) from v where plate_text is not null and not plate_detected)
    select severity, code, rows from i where rows > 0"""
)
def import_issues(spark, sf_dir):
    """What an import would complain about, by severity and code."""
    rows, tracks = observations(spark, sf_dir), vehicle_records(spark, sf_dir)
    return imports.issue_table(
        (rows.where("timestamp_seconds < 1"), "ERROR", "invalid_observation_time"),
        (tracks.join(rows.select("track_no").distinct(), "track_no", "left_anti"), "WARNING", "orphan_track"),
        (tracks.where("plate_text is not null and not plate_detected"), "INFO", "plate_without_detection"),
    )


@query(
    BOTH
    + """select (select count(*) from o where timestamp_seconds < 1) as errors, (select count(*) from v where track_no not in (select track_no from o)) as warnings, (select count(*) from o where timestamp_seconds < 1) = 0 as writable"""
)
def import_verdict(spark, sf_dir):
    """Whether the import may be written."""
    return imports.verdict(import_issues(spark, sf_dir))


@query(ALL + "select run_id, min(first_seen_seconds) as started, max(last_seen_seconds) as ended, greatest(0, max(last_seen_seconds) - min(first_seen_seconds)) as duration from v group by 1")
def run_durations(spark, sf_dir):
    """Start, end and length of each run."""
    ends = vehicle_records(spark, sf_dir).groupBy("run_id").agg(F.min("first_seen_seconds").alias("started"), F.max("last_seen_seconds").alias("ended"))
    return ends.withColumn("duration", F.greatest(F.lit(0.0), F.col("ended") - F.col("started")))


@query(
    """select conv_id, turn, trim(regexp_replace(regexp_replace(replace(lower(text), 'colour', 'color'), '[?,.!]', ' ', 'g'), '\\s+', ' ', 'g')) as plain from conversations"""
)
def query_text_normal(spark, sf_dir):
    """Questions in lower case without marks, colour as color, one space between words."""
    text = F.regexp_replace(F.replace(F.lower("text"), F.lit("colour"), F.lit("color")), "[?,.!]", " ")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim(F.regexp_replace(text, r"\s+", " ")).alias("plain"))


@query(ALL + "select vehicle_id, regexp_replace(vehicle_id, '[^A-Za-z0-9._-]+', '_', 'g') as safe, coalesce(nullif(split_part(vehicle_id, ':', 2), ''), vehicle_id) as short_id from v")
def safe_ids(spark, sf_dir):
    """Ids as file names, and without their camera."""
    return vehicle_records(spark, sf_dir).select("vehicle_id", F.regexp_replace("vehicle_id", "[^A-Za-z0-9._-]+", "_").alias("safe"), short_track_id(F.col("vehicle_id")).alias("short_id"))


_PATHS = """select track_no, concat(case track_no % 6 when 0 then '/runs/run_1/crops/' when 1 then 'crops/' when 2 then '/other/' when 3 then '../up/' when 4 then '/runs/run_1/x/../' else 'crops/a..b/' end, cast(track_no as varchar(20))) as path"""


@query(ALL + f", p as ({_PATHS} from v), q as (select *, list_contains(string_split(path, '/'), '..') as up from p) select track_no, case when up then null when starts_with(path, '/runs/run_1/') then substr(path, 13) when starts_with(path, '/') then null else path end as relative, case when up then 'invalid' when starts_with(path, '/runs/run_1/') then 'inside' when starts_with(path, '/') then 'outside' else 'relative' end as kind from q")
def path_relative(spark, sf_dir):
    """Paths inside a run's folder, and what is wrong with the others."""
    rows = vehicle_records(spark, sf_dir).selectExpr(*_PATHS.removeprefix("select ").split(", ", 1))
    return imports.relative_paths(rows, "path", "/runs/run_1/").select("track_no", "relative", "kind")


@query(ALL + "select run_id, camera_id, vehicle_id, cast(row_number() over (partition by run_id, camera_id, vehicle_class order by cast(split_part(vehicle_id, 'TRACK_', 2) as bigint), vehicle_id) as int) as place from v")
def list_tracks_natural(spark, sf_dir):
    """Tracks of a class at a camera in the natural order of their numbers: 2 comes before 10."""
    own = Window.partitionBy("run_id", "camera_id", "vehicle_class").orderBy(track_number(F.col("vehicle_id")), "vehicle_id")
    return vehicle_records(spark, sf_dir).select("run_id", "camera_id", "vehicle_id", F.row_number().over(own).alias("place"))


_RECORD = "run_id, vehicle_id, camera_id, vehicle_class, colour, first_seen_seconds, last_seen_seconds, status, plate_text, plate_detected"


@query(
    ALL
    + f""", p as (select {_RECORD.replace("status,", "'PHYSICAL_VEHICLE' as status,")} from v where track_no % 3 = 0 and run_id <> 'RUN_0'), c as (select {_RECORD.replace("plate_text,", "case when plate_detected then plate_text end as plate_text,")} from v where status = 'COMPLETED' and run_id = 'RUN_0')
    select * from p union all select * from c"""
)
def rec_source_preference(spark, sf_dir):
    """Physical vehicles where a scope has any, else completed tracks: RUN_0 has none, the other runs do."""
    rows = vehicle_records(spark, sf_dir)
    found = rows.where("track_no % 3 = 0 and run_id <> 'RUN_0'").withColumn("status", F.lit("PHYSICAL_VEHICLE"))
    of_run = lambda df, mine: df.where((F.col("run_id") == "RUN_0") == F.lit(mine))
    return prefer_physical(of_run(found, True), of_run(rows, True)).unionByName(prefer_physical(of_run(found, False), of_run(rows, False)))


_CANDIDATES = """case track_no % 5 when 0 then null when 1 then ' ' when 2 then 'NO PLATE' when 3 then concat(lower(substr(plate_text, 1, 2)), ' ', substr(plate_text, 3)) else plate_text end as c1,
  case when track_no % 3 = 0 then concat('22 bh ', cast(1000 + track_no % 9000 as varchar(8)), ' aa') when track_no % 3 = 1 then 'XX99' end as c2, plate_text as c3"""


@query(
    ALL
    + f""", c as (select run_id, vehicle_id, unnest([{{'i': 1, 'p': c1}}, {{'i': 2, 'p': c2}}, {{'i': 3, 'p': c3}}]) as x from (select run_id, vehicle_id, {_CANDIDATES} from v) a),
    n as (select run_id, vehicle_id, x.i as i, regexp_replace(upper(x.p), '[^A-Z0-9]', '', 'g') as p from c),
    k as (select * from n where regexp_matches(p, '^(HR|DL|MP)[0-9]{{1,2}}[A-Z]{{1,3}}[0-9]{{4}}$') or regexp_matches(p, '^[0-9]{{2}}BH[0-9]{{4}}[A-Z]{{1,2}}$'))
    select v.run_id, v.vehicle_id, plate from v left join (select run_id, vehicle_id, arg_min(p, i) as plate from k group by 1, 2) b using (run_id, vehicle_id)"""
)
def rec_canonical_plate(spark, sf_dir):
    """The first candidate of each vehicle that is a valid plate, in its canonical form."""
    rows = vehicle_records(spark, sf_dir)
    first, rest = _CANDIDATES.split(" as c1,")
    second, third = rest.split(" as c2, ")
    made = rows.selectExpr("run_id", "vehicle_id", f"{first} as c1", f"{second} as c2", third.replace(" as c3", "") + " as c3")
    return canonical_plate(made, ["c1", "c2", "c3"], "plate").select("run_id", "vehicle_id", "plate")


@query(ALL + ", d as (select * from (select *, row_number() over (partition by run_id, vehicle_id order by track_no) as k from (select run_id, concat('VEHICLE_', cast(owner as varchar(20))) as vehicle_id, track_no, vehicle_class, plate_text, plate_detected from v) a) b where k = 1) select run_id, vehicle_id, vehicle_class, case when plate_detected then plate_text end as plate_text from d")
def rec_physical_first(spark, sf_dir):
    """Records of physical vehicles; of rows that repeat a key the first counts, a plate only where one was detected."""
    rows = vehicle_records(spark, sf_dir).withColumn("vehicle_id", F.concat(F.lit("VEHICLE_"), F.col("owner").cast("string")))
    first = first_of(rows, ["run_id", "vehicle_id"], "track_no")
    return first.select("run_id", "vehicle_id", "vehicle_class", F.when(F.col("plate_detected"), F.col("plate_text")).alias("plate_text"))
