"""Everyday flows, each one lazy plan; planned runs are ``schedules.planned_runs``."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tickloom.operators import logs, quality, queue


def admission_round(
    submissions: DataFrame, running_apps: DataFrame, capacity: int, now: int, pool_col: str = "pool"
) -> DataFrame:
    """Submissions to admitted jobs: derive times, drop bad rows, keep what may run, admit."""
    derived = queue.derive_submission(submissions, now)
    valid, _, _ = quality.validate(derived, quality.job_rules())
    return queue.admit(valid.filter(queue.is_runnable(now)), running_apps, capacity, pool_col)


def log_pages(texts: DataFrame, col: str) -> DataFrame:
    """Every page of every text with its neighbours' numbers."""
    return logs.page_nav(logs.paginate(texts, col, logs.LOG_CHUNK, logs.LOG_WINDOW))
