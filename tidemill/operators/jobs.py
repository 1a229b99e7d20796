"""Job lifecycle rules. ``now`` is always a parameter, so a run can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.catalog import age

# States and limits of the service.
RUNNING_STATES = ("running", "initializing")
TERMINAL_STATES = ("completed", "failed", "stopped", "stopping", "terminated")
MAX_RUNTIME_HOURS = 3
UPDATE_MINUTES = 1
CLEANUP_MINUTES = 10
MAX_RETRIES = 3
ACCELERATOR_STATES = {
    "CREATING": "provisioning",
    "READY": "ready",
    "STOPPING": "stopping",
    "STOPPED": "terminated",
    "DELETING": "terminated",
    "RESTARTING": "provisioning",
    "STARTING": "provisioning",
}


def due_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs to act on: ``cleanup`` when that is due, else ``update`` when that is."""
    cleanup = (F.col("status") == "cleanup") & (F.col("cleanup_at") <= now)
    update = F.col("next_update_at") <= now
    action = F.when(cleanup, "cleanup").when(update, "update")
    return jobs.withColumn("action", action).where(F.col("action").isNotNull())


def schedule_times(
    jobs: DataFrame, now: Column, update_minutes: int = UPDATE_MINUTES,
    cleanup_minutes: int = CLEANUP_MINUTES,
) -> DataFrame:
    return jobs.withColumns({
        "next_update_at": now + F.make_dt_interval(mins=F.lit(update_minutes)),
        "cleanup_at": now + F.make_dt_interval(mins=F.lit(cleanup_minutes)),
    })


def finetune_transition(
    jobs: DataFrame, now: Column, max_hours: int = MAX_RUNTIME_HOURS, tune: str = "tune_status",
    created: str = "created_at",
) -> DataFrame:
    """Next job status and error from the status of the tuning run."""
    state = F.col(tune)
    overdue = state.isin(*RUNNING_STATES) & (
        now > F.col(created) + F.make_dt_interval(hours=F.lit(max_hours)))
    return jobs.withColumns({
        "next_status": F.when(overdue | state.isin(*TERMINAL_STATES), "cleanup")
        .when(state == "error", "failed").otherwise(F.col("status")),
        "next_error": F.when(state == "error", "Fine-tuning job failed").otherwise(F.col("error")),
    })


def accelerator_transition(
    jobs: DataFrame, now: Column, accelerator: str = "accelerator_status",
    hours: str = "auto_shutdown_hrs", created: str = "created_at",
) -> DataFrame:
    """Ready machines live until their shutdown time, at once when they have none."""
    state = F.col(accelerator)
    no_limit = F.coalesce(F.col(hours), F.lit(0)) == 0
    expired = F.col(created) + F.make_dt_interval(hours=F.col(hours)) < now
    broken = state.isin("error", "failed")
    return jobs.withColumns({
        "next_status": F.when(
            state.isin("ready", "running"),
            F.when(no_limit | expired, "cleanup").otherwise(F.col("status")))
        .when(broken, "failed").otherwise("cleanup"),
        "next_error": F.when(broken, "Accelerator provisioning failed").otherwise(F.col("error")),
    })


def fail_jobs(
    jobs: DataFrame, errors: DataFrame, id_col: str = "job_id", max_retries: int = MAX_RETRIES
) -> DataFrame:
    """Failed attempts are counted and kept; a job fails for good when they run out."""
    per_job = errors.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("__n"), F.max_by("error", F.struct(age("seq"), F.col("error"))).alias("__e"))
    joined = jobs.join(per_job, id_col, "left")
    attempts = F.coalesce("__n", F.lit(0))
    return joined.withColumns({
        "attempts": attempts,
        "status": F.when(attempts >= max_retries, "failed").otherwise(F.col("status")),
        "error": F.coalesce("__e", F.col("error")),
    }).drop("__n", "__e")


def latest_status(updates: DataFrame, id_col: str = "tune_id", seq_col: str = "seq") -> DataFrame:
    """Status and progress of the newest update, the highest progress, and the final markers."""
    newest = F.max_by(F.struct("status", "progress"), F.struct(age(seq_col), F.col("status"), F.col("progress")))
    return updates.groupBy(id_col).agg(
        newest["status"].alias("status"),
        newest["progress"].alias("progress"),
        F.max("progress").alias("max_progress"),
        F.bool_or(F.col("status") == "completed").alias("done"),
        F.bool_or(F.col("status") == "failed").alias("failed"),
        F.count(F.lit(1)).alias("n_updates"),
    )
