"""Incidents: numbered windows, summaries, line listings, look-ups (A4..A6, I1..I8, I10, J1, J2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (FEATURES, INCIDENT_ID_PATTERN, MAX_COMPONENTS, MAX_LOG_CHARS, MAX_LOG_LINES,
                         OTHER_SEVERITY_RANK, SEVERE_LEVELS, SEVERITY_RANK, SIGNAL_NAMES)
from ..functions.ordering import number_by_day
from ..functions.timeparse import window_interval

LINE_COLUMNS = ["LineId", "Timestamp", "Level", "Component", "Pid", "EventId", "Content"]
ID_PREFIX = "INC-"


def _positive(name: str, value: int | None) -> None:
    if value is not None and (isinstance(value, bool) or not isinstance(value, int) or value < 1):
        raise ValueError(f"{name} must be a positive integer.")


def incident_id(number: Column) -> Column:
    return F.format_string(f"{ID_PREFIX}%03d", number)


def number_incidents(features: DataFrame) -> DataFrame:
    """Feature rows with incident_no (chronological, from 1) and incident_id."""
    numbered = number_by_day(features, "time_window", "incident_no")
    return numbered.withColumn("incident_id", incident_id(F.col("incident_no"))).select(
        "incident_no", "incident_id", *features.columns)


def incident_count(incidents: DataFrame) -> DataFrame:
    return incidents.agg(F.count(F.lit(1)).alias("n_incidents"))


def _reduced(lines: DataFrame) -> DataFrame:
    """Lines reduced to (window, level, component): the only pass over them for a summary."""
    severe = F.col("Level").isin(SEVERE_LEVELS)
    return lines.groupBy("time_window", "Level", "Component").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if((F.col(f"{s}_signal") == 1) & severe).alias(s) for s in SIGNAL_NAMES])


def level_counts(lines: DataFrame) -> DataFrame:
    """Lines per window and level, in long form (A4)."""
    return lines.groupBy("time_window", "Level").agg(F.count(F.lit(1)).alias("n"))


def signal_counts(lines: DataFrame) -> DataFrame:
    """WARN/ERROR/FATAL lines per window and signal (A5)."""
    severe = F.col("Level").isin(SEVERE_LEVELS)
    return lines.groupBy("time_window").agg(*[
        F.count_if((F.col(f"{s}_signal") == 1) & severe).alias(s) for s in SIGNAL_NAMES])


def component_lists(lines: DataFrame, limit: int = MAX_COMPONENTS) -> DataFrame:
    """First distinct components of a window in name order.

    Distinct pairs are ranked and cut before anything is collected, so a list never exceeds `limit`.
    """
    pairs = lines.select("time_window", "Component").distinct()
    return _component_lists(pairs, limit)


def _component_lists(pairs: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("time_window").orderBy("Component")
    kept = (pairs.filter(F.col("Component").isNotNull())
            .withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit))
    return kept.groupBy("time_window").agg(
        F.sort_array(F.collect_list("Component")).alias("components"))


def incident_summary(lines: DataFrame, incidents: DataFrame, window: str) -> DataFrame:
    """One summary row per incident: span, level counts, components, signals (I4)."""
    reduced = _reduced(lines)
    per_level = reduced.groupBy("time_window", "Level").agg(
        F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in SIGNAL_NAMES])

    def of(level: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("Level") == level, F.col("n"))), F.lit(0)).cast("long")

    totals = per_level.groupBy("time_window").agg(
        F.sum("n").alias("n_logs"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("Level", "n")))).alias("level_counts"),
        of("ERROR").alias("n_errors"), of("WARN").alias("n_warnings"), of("FATAL").alias("n_fatal"),
        *[F.sum(s).alias(s) for s in SIGNAL_NAMES])
    components = _component_lists(reduced.select("time_window", "Component").distinct(),
                                  MAX_COMPONENTS)
    signals = F.create_map(*[x for s in SIGNAL_NAMES for x in (F.lit(s), F.col(s))])
    end = F.col("time_window") + F.expr(f"INTERVAL '{window_interval(window).split()[0]}' "
                                        f"{window_interval(window).split()[1]}")
    return (incidents.select("incident_no", "incident_id", "time_window")
            .join(totals, "time_window")
            .join(components, "time_window", "left")
            .select("incident_no", "incident_id", F.col("time_window").alias("window_start"),
                    end.alias("window_end"), "n_logs", "level_counts",
                    "n_errors", "n_warnings", "n_fatal",
                    F.coalesce("components", F.array().cast("array<string>")).alias("components"),
                    signals.alias("signals")))


def incident_lines(lines: DataFrame, incidents: DataFrame, limit: int | None = None) -> DataFrame:
    """Chronological lines of every incident, optionally the first `limit` of each.

    Without a limit the order is a range-partitioned sort on (incident, time, line), which also
    splits one oversized incident. With a limit, each map task keeps `limit` lines per incident first.
    """
    _positive("limit", limit)
    kept = lines.select("time_window", *[c for c in LINE_COLUMNS if c in lines.columns])
    order = [F.asc("Timestamp"), F.asc_nulls_last("LineId")]
    if limit is not None:
        w = Window.partitionBy("time_window").orderBy(*order)
        kept = kept.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")
    ids = incidents.select("time_window", "incident_no", "incident_id")
    return (kept.join(ids, "time_window").drop("time_window")
            .orderBy("incident_no", *order))


def severity_rank(level: Column) -> Column:
    ranks = F.create_map(*[x for k, v in SEVERITY_RANK.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(ranks, level), F.lit(OTHER_SEVERITY_RANK))


def top_lines(lines: DataFrame, limit: int = MAX_LOG_LINES) -> DataFrame:
    """The most severe lines per window, with the shown and total counts.

    The rank filter is planned as a group limit on the map side: one task sends at most `limit` lines
    of a window, however many it holds.
    """
    _positive("limit", limit)
    order = (Window.partitionBy("time_window")
             .orderBy(severity_rank(F.col("Level")), F.col("Timestamp"), F.asc_nulls_last("LineId")))
    shown = (lines.withColumn("line_no", F.row_number().over(order))
             .filter(F.col("line_no") <= limit)
             .select("time_window", "line_no", "LineId", "Timestamp", "Level",
                     F.coalesce("Component", F.lit("nan")).alias("component"),
                     F.coalesce("EventId", F.lit("nan")).alias("event_id"),
                     F.substring(F.coalesce("Content", F.lit("nan")), 1, MAX_LOG_CHARS)
                     .alias("content")))
    return shown


def with_line_totals(shown: DataFrame, incidents: DataFrame, limit: int = MAX_LOG_LINES) -> DataFrame:
    """Attach incident ids, total_logs and shown to the listed lines."""
    ids = incidents.select("time_window", "incident_no", "incident_id",
                           F.col("logs_per_window").alias("total_logs"),
                           F.least("logs_per_window", F.lit(limit)).cast("long").alias("shown"))
    return shown.join(ids, "time_window").drop("time_window")


def requested_number(column: str) -> Column:
    """Incident number in a requested id of any accepted spelling, NULL when malformed."""
    return F.expr(f"try_cast(nullif(regexp_extract(`{column}`, r'{INCIDENT_ID_PATTERN}', 1), '') "
                  "AS BIGINT)")


def resolve_ids(ids: DataFrame, incidents: DataFrame, column: str = "raw_id") -> DataFrame:
    """Requested ids in any accepted spelling to incidents; unknown ones get found = false."""
    known = incidents.select("incident_no", "incident_id")
    return (ids.withColumn("incident_no", requested_number(column))
            .join(known, "incident_no", "left")
            .select(*ids.columns, "incident_id", F.col("incident_id").isNotNull().alias("found")))


def incident_features(incidents: DataFrame, incident: str) -> DataFrame:
    """Feature row of one incident, by id in any accepted spelling."""
    wanted = incidents.sparkSession.createDataFrame([(incident,)], "raw_id string")
    found = resolve_ids(wanted, incidents).filter("found").select("incident_id")
    return incidents.join(F.broadcast(found), "incident_id", "left_semi").select(
        "incident_id", "time_window", *FEATURES)


def list_incidents(incidents: DataFrame, limit: int | None = None, sort_by: str = "time") -> DataFrame:
    """All incidents by time, or by (fatal, error, warning) descending and then time (I8)."""
    if sort_by not in ("time", "severity"):
        raise ValueError("sort_by must be 'time' or 'severity'.")
    _positive("limit", limit)
    order = [F.asc("incident_no")]
    if sort_by == "severity":
        order = [F.desc("fatal_count"), F.desc("error_count"), F.desc("warning_count")] + order
    out = incidents.select("incident_no", "incident_id", F.col("time_window").alias("window_start"),
                           F.col("logs_per_window").alias("n_logs"),
                           "fatal_count", "error_count", "warning_count").orderBy(*order)
    return out.limit(limit) if limit else out


def join_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Feature rows that have a label."""
    missing = [c for c in ("time_window", "label") if c not in labels.columns]
    if missing:
        raise ValueError(f"Labels must have columns time_window and label; missing {missing}")
    typed = labels.select(F.col("time_window").cast("timestamp_ntz").alias("time_window"),
                          F.col("label").cast("int").alias("label"))
    return features.join(typed, "time_window", "inner")


def label_coverage(features: DataFrame, labels: DataFrame) -> DataFrame:
    """How many feature rows are labelled."""
    flagged = labels.select(F.col("time_window").cast("timestamp_ntz").alias("time_window"),
                            F.lit(1).alias("_l"))
    joined = features.select("time_window").join(flagged, "time_window", "left")
    n, hit = F.count(F.lit(1)), F.count("_l")
    return joined.agg(n.alias("n_windows"), hit.alias("n_labelled"),
                      F.coalesce(F.try_divide(hit.cast("double"), n), F.lit(0.0)).alias("coverage"))
