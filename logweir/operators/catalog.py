"""Saved searches and past jobs, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.errors import NotFoundError
from logweir.functions.columns import progress_status
from logweir.functions.patterns import checked_pattern
from logweir.operators.filters import ANY, check_positive, check_range
from logweir.schemas import JOB_DETAILS, KEYWORDS, PROGRESS, STATISTICS


# ---------------------------------------------------------------- saved searches


def decode_signatures(raw: DataFrame) -> DataFrame:
    """Turn the JSON text of ``keywords`` into an array."""
    return raw.withColumn("keywords", F.from_json("keywords", KEYWORDS))


def newest_first(rows: DataFrame, key: str) -> DataFrame:
    return rows.orderBy(F.desc("createdTime"), F.asc(key))


def _signature_matches(
    signatures: DataFrame, signature_id: str, keyword: str
) -> tuple[Column, Column]:
    """Whether the id matches and whether a keyword does.

    ``*`` on one side only switches that side off; on both it selects everything.
    """
    spark = signatures.sparkSession
    by_id = F.lit(signature_id == ANY and keyword == ANY)
    by_keyword = by_id
    if signature_id != ANY:
        by_id = F.col("signatureId").rlike(checked_pattern(spark, signature_id))
    if keyword != ANY:
        pattern = checked_pattern(spark, keyword)
        by_keyword = F.exists("keywords", lambda word: word.rlike(pattern))
    return tuple(F.coalesce(match, F.lit(False)) for match in (by_id, by_keyword))


def find_signatures(
    signatures: DataFrame, signature_id: str = ANY, keyword: str = ANY
) -> DataFrame:
    """Searches whose id or any keyword matches a regular expression, unordered.

    ``idMatch`` tells the two kinds apart; a search matching both is listed once.
    """
    by_id, by_keyword = _signature_matches(signatures, signature_id, keyword)
    return signatures.withColumn("idMatch", by_id).filter(F.col("idMatch") | by_keyword)


def _search_order() -> list[Column]:
    return [F.desc("idMatch"), F.desc("createdTime"), F.asc("signatureId")]


def search_signatures(
    signatures: DataFrame, signature_id: str = ANY, keyword: str = ANY
) -> DataFrame:
    """Id matches, newest first, then those that match by a keyword only, newest first."""
    found = find_signatures(signatures, signature_id, keyword)
    return found.orderBy(*_search_order()).drop("idMatch")


def signature_page(
    signatures: DataFrame,
    signature_id: str = ANY,
    keyword: str = ANY,
    start: int | None = None,
    end: int | None = None,
) -> tuple[DataFrame, int]:
    """Rows ``start`` to ``end`` (1-based, inclusive) of a search, and its total."""
    found = find_signatures(signatures, signature_id, keyword)
    if start is None or end is None:
        return found.orderBy(*_search_order()).drop("idMatch"), found.count()
    check_positive("start", start)
    check_range(start, end)
    # Counted per hour, of which a running sum tells those that the page meets. One task holds
    # an hour and the page, however far down that is.
    found = found.withColumn("_hour", F.date_trunc("hour", "createdTime"))
    hours = found.groupBy("idMatch", "_hour").agg(F.count(F.lit(1)).alias("n"))
    running = Window.orderBy(F.desc("idMatch"), F.desc("_hour")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = hours.withColumn("last", F.sum("n").over(running))
    placed = placed.withColumn("before", F.col("last") - F.col("n"))
    is_met = (F.col("last") >= start) & (F.col("before") < end)
    total, before = placed.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.min(F.when(is_met, F.col("before")))
    ).first()
    met = placed.filter(is_met).select(F.col("idMatch").alias("_kind"), F.col("_hour").alias("_of"))
    near = found.join(
        met,
        (F.col("idMatch") == F.col("_kind")) & F.col("_hour").eqNullSafe(F.col("_of")),
        "left_semi",
    )
    page = near.orderBy(*_search_order()).offset(start - 1 - (before or 0))
    return page.limit(end - start + 1).drop("idMatch", "_hour"), total


def signature_by_id(signatures: DataFrame, signature_id: str) -> DataFrame:
    """The one saved search of an id; raises when there is none."""
    found = signatures.filter(F.col("signatureId") == F.lit(signature_id))
    if not found.take(1):
        raise NotFoundError(f"signature {signature_id!r} not found")
    return found


# ---------------------------------------------------------------- jobs


def decode_jobs(raw: DataFrame) -> DataFrame:
    """Open the JSON columns of the job table. Statistics not written yet are null."""

    def statistics(name: str) -> Column:
        rows = F.from_json(name, STATISTICS)["totalRowCount"]
        return F.when(rows.isNotNull(), F.struct(rows.alias("totalRowCount")))

    def progress(name: str) -> Column:
        return F.from_json(name, PROGRESS)

    return raw.select(
        "jobId",
        "jobName",
        progress("logQueryProgress").alias("logQueryProgress"),
        progress("histogramProgress").alias("histogramProgress"),
        "createdTime",
        F.col("lastModifiedTime").alias("modifiedTime"),
        F.from_json("jobData", JOB_DETAILS).alias("jobDetails"),
        F.col("tagAppName").alias("appName"),
        statistics("logQueryStatistics").alias("logQueryStatistics"),
        statistics("histogramStatistics").alias("histogramStatistics"),
    )


def with_status(jobs: DataFrame) -> DataFrame:
    """Add the status word to both progress structs."""

    def worded(name: str) -> Column:
        percentage = F.col(f"{name}.percentage")
        return F.struct(
            percentage.alias("percentage"), progress_status(percentage).alias("status")
        )

    return jobs.withColumns(
        {name: worded(name) for name in ("logQueryProgress", "histogramProgress")}
    )


def with_stored_statistics(jobs: DataFrame, stored: DataFrame, query: str) -> DataFrame:
    """Fill the missing statistics of completed jobs from stored results (0 without one).

    ``query`` is ``logQuery`` or ``histogram``; ``stored`` has ``jobId, totalRowCount``.
    """
    name = f"{query}Statistics"
    counts = stored.select("jobId", F.col("totalRowCount").alias("_stored"))
    due = F.col(name).isNull() & (F.col(f"{query}Progress.percentage") == 100)
    filled = F.struct(F.coalesce("_stored", F.lit(0)).cast("long").alias("totalRowCount"))
    return (
        jobs.join(counts, "jobId", "left")
        .withColumn(name, F.when(due, filled).otherwise(F.col(name)))
        .drop("_stored")
    )


def list_jobs(jobs: DataFrame, app_name: str = ANY, search: str = ANY) -> DataFrame:
    """Jobs of one application whose name matches a regular expression, newest first."""
    if app_name != ANY:
        jobs = jobs.filter(F.col("appName") == F.lit(app_name))
    if search != ANY:
        jobs = jobs.filter(F.col("jobName").rlike(checked_pattern(jobs.sparkSession, search)))
    return newest_first(with_status(jobs), "jobId")
