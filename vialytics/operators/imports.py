"""Checks on imported rows, and writes that keep keys unique."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def orphans(children: DataFrame, parents: DataFrame, key: str, code: str) -> DataFrame:
    """(code, key, rows): keys of children without a parent."""
    return children.join(parents.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.count("*").alias("rows")).select(F.lit(code).alias("code"), key, "rows")


def numbered_duplicates(rows: DataFrame, key: str, *order) -> DataFrame:
    """rows with place, unique_key and issue. Of rows that share a key the only COMPLETED one keeps it, wherever it stands.

    All others become key__DUPLICATE_place_status, also all COMPLETED ones if there are several: then each is an ERROR,
    any other renamed row an INFO. A key that occurs once stays.
    """
    own = Window.partitionBy(key)
    done = F.upper(F.coalesce("status", F.lit(""))) == "COMPLETED"
    counted = rows.withColumns({"place": F.row_number().over(own.orderBy(*order)), "_n": F.count("*").over(own), "_done": F.count_if(done).over(own)})
    keeps = (F.col("_n") == 1) | (done & (F.col("_done") == 1))
    status = F.coalesce(F.nullif(F.upper("status"), F.lit("")), F.lit("UNKNOWN"))
    named = F.concat(F.col(key), F.lit("__DUPLICATE_"), F.col("place").cast("string"), F.lit("_"), status)
    issue = F.when(~keeps & done, "duplicate_completed_logical_track_identity").when(~keeps, "duplicate_noncanonical_track_identity_remapped")
    return counted.withColumns({"unique_key": F.when(keeps, F.col(key)).otherwise(named), "issue": issue}).drop("_n", "_done")


def resolved(references: DataFrame, tracks: DataFrame, keys: list[str]) -> DataFrame:
    """references (ref_id, keys, frame_number) with the track meant: the only one around the frame, else the only completed one, else the first.

    A reference without a candidate keeps its row, with no track and how `unresolved`.
    """
    inside = F.col("frame_number").between(F.col("first_frame"), F.col("last_frame"))
    pairs = references.join(tracks.select(*keys, "track_no", "first_frame", "last_frame", "status"), keys, "left")
    found = pairs.groupBy("ref_id").agg(
        F.count_if(inside).alias("around"), F.min(F.when(inside, F.col("track_no"))).alias("a"), F.count_if(F.col("status") == "COMPLETED").alias("done"),
        F.min(F.when(F.col("status") == "COMPLETED", F.col("track_no"))).alias("c"), F.min("track_no").alias("first"),
    )
    how = F.when(F.col("first").isNull(), "unresolved").when(F.col("around") == 1, "containment").when(F.col("done") == 1, "completed").otherwise("first")
    return found.select("ref_id", F.when(F.col("around") == 1, F.col("a")).when(F.col("done") == 1, F.col("c")).otherwise(F.col("first")).alias("track_no"), how.alias("how"))


def relative_paths(rows: DataFrame, path: str, folder: str) -> DataFrame:
    """rows with relative and kind: paths inside folder lose it; outside it, or with a step upwards, they have no relative path."""
    p = F.col(path)
    inside, rooted, upwards = p.startswith(folder), p.startswith("/"), F.array_contains(F.split(p, "/"), "..")
    relative = F.when(~(upwards | (rooted & ~inside)), F.when(inside, F.substring(p, len(folder) + 1, 1 << 20)).otherwise(p))
    kind = F.when(upwards, "invalid").when(inside, "inside").when(rooted, "outside").otherwise("relative")
    return rows.withColumns({"relative": relative, "kind": kind})


def first_media(*sources: DataFrame) -> DataFrame:
    """(media_type, relative_path, original_path, track_no, source, seen): each medium once, as the first of the sources that
    names it does (of several rows there the smallest track), and how many rows name it."""
    rows = [s.select("media_type", "relative_path", "original_path", "track_no", F.lit(i).alias("source")) for i, s in enumerate(sources)]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    first = F.min(F.struct("source", "track_no")).alias("first")
    return every.groupBy("media_type", "relative_path", "original_path").agg(first, F.count("*").alias("seen")).select("media_type", "relative_path", "original_path", "first.track_no", "first.source", "seen")


def issue_table(*found: tuple[DataFrame, str, str]) -> DataFrame:
    """(severity, code, rows): how often each check (rows that fail it, severity, code) fails; checks that hold have no row."""
    counts = [rows.agg(F.count("*").alias("rows")).select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), "rows") for rows, severity, code in found]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.where("rows > 0")


def verdict(issues: DataFrame) -> DataFrame:
    """One row: errors, warnings and whether the import may be written: no ERROR may be left."""
    sums = issues.agg(*(F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("rows"))), F.lit(0)).alias(n) for s, n in (("ERROR", "errors"), ("WARNING", "warnings"))))
    return sums.withColumn("writable", F.col("errors") == 0)


def upserted(target: DataFrame, changes: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """target after `insert ... on conflict update`: changed rows take the new values but keep the columns in keep."""
    kept = target.select(*keys, *(F.col(c).alias(f"_{c}") for c in keep))
    new = changes.join(kept, keys, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in keep else F.col(c) for c in target.columns))
    return target.join(changes.select(*keys), keys, "left_anti").select(*target.columns).unionByName(new)


def inserted(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """target after `insert ... on conflict do nothing`."""
    return target.unionByName(changes.join(target.select(*keys), keys, "left_anti").select(*target.columns))


def replaced(target: DataFrame, changes: DataFrame, partition: str) -> DataFrame:
    """target with all rows of the partitions that occur in changes replaced by them."""
    return target.join(changes.select(partition).distinct(), partition, "left_anti").select(*target.columns).unionByName(changes.select(*target.columns))


def broken_rules(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule, rows): how many rows break each rule; a rule is a condition in SQL that holds where it is null."""
    flags = [F.count_if(~F.coalesce(F.expr(c), F.lit(True))).alias(n) for n, c in rules.items()]
    return rows.agg(*flags).unpivot([], list(rules), "rule", "rows")


def schema_differences(found: StructType, wanted: StructType) -> list[tuple[str, str]]:
    """(column, what is wrong) of a table against a contract: missing, another type, or not in the contract."""
    have, want = {f.name: f.dataType for f in found}, {f.name: f.dataType for f in wanted}
    wrong = [(n, "missing") for n in want if n not in have] + [(n, "type") for n in want if n in have and have[n] != want[n]]
    return sorted(wrong + [(n, "extra") for n in have if n not in want])
