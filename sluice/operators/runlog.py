"""Analysis of run logs: states, durations, rates and illegal steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_state(log: DataFrame, job: str, state: str, order: list[str]) -> DataFrame:
    """Last state of each job."""
    return log.groupBy(job).agg(F.max_by(state, F.struct(*order)).alias("state"))


def job_details(log: DataFrame, job: str, state: str, time: str, order: list[str]) -> DataFrame:
    """First and last time, seconds between them and last state of each job."""
    found = log.groupBy(job).agg(F.min(time).alias("started"), F.max(time).alias("ended"), F.max_by(state, F.struct(*order)).alias("state"))
    seconds = (F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1e6
    return found.withColumn("seconds", F.round(seconds, 2))


def next_run(log: DataFrame, pipeline: Column, job: str) -> DataFrame:
    """Number of the next run of each pipeline: its distinct jobs, exactly counted, and one."""
    return log.groupBy(pipeline.alias("pipeline")).agg((F.countDistinct(job) + 1).alias("next_run"))


def run_summary(log: DataFrame, job: str, time: str, rows: Column) -> DataFrame:
    """Rows, chunks, seconds and rows a second of each job."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    found = log.groupBy(job).agg(F.sum(rows).alias("n_rows"), F.count("*").alias("chunks"), ((F.max(micros) - F.min(micros)) / 1e6).alias("s"))
    return found.select(job, "n_rows", "chunks", F.round("s", 2).alias("seconds"), F.when(F.col("s") > 0, F.floor(F.col("n_rows") / F.col("s"))).alias("rows_per_second"))


def history(log: DataFrame, time: str, value: str, step: str) -> DataFrame:
    """Count, mean, 95th percentile (interpolated) and peak of a value for each interval of time.

    For the percentile rows are added up by interval and value first, and it is read off running counts over sorted
    values, which can spill, so no interval's values are held at once. The mean is that of the rows: sums by value round
    otherwise where it lies halfway.
    """
    start = F.window(F.col(time), step)["start"].alias("start")
    plain = log.groupBy(start).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"), F.max(value).alias("peak"))
    counts = log.where(F.col(value).isNotNull()).groupBy(start, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    by = Window.partitionBy("start")
    runs = counts.withColumn("upto", F.sum("c").over(by.orderBy("v"))).withColumn("at", 0.95 * (F.sum("c").over(by) - 1))
    low, high = (F.min(F.when(F.col("upto") > f("at"), F.col("v"))) for f in (F.floor, F.ceil))
    p95 = low + (high - low) * (F.max("at") - F.floor(F.max("at")))
    found = runs.groupBy("start").agg(F.round(p95, 4).alias("p95")).withColumnRenamed("start", "s")
    return plain.join(found, F.col("start") == F.col("s"), "left").select("start", "n", "mean", "p95", "peak")


def illegal_steps(log: DataFrame, job: str, state: str, order: list[str], allowed: list[tuple[str, str]]) -> DataFrame:
    """Steps between states of a job that are not allowed; one row per step."""
    before = F.lag(state).over(Window.partitionBy(job).orderBy(*order))
    steps = log.select("*", before.alias("from_state")).filter(F.col("from_state").isNotNull())
    edges = log.sparkSession.createDataFrame(allowed, "from_state string, to_state string")
    bad = [steps["from_state"] == edges["from_state"], steps[state] == edges["to_state"]]
    return steps.join(edges, bad, "left_anti").withColumnRenamed(state, "to_state")


def resume_points(checkpoints: DataFrame, job: str, chunk: str, done: Column) -> DataFrame:
    """The chunk at which each job goes on: the one after its last completed chunk."""
    return checkpoints.groupBy(job).agg((F.coalesce(F.max(F.when(done, F.col(chunk))), F.lit(-1)) + 1).alias("resume_at"))
