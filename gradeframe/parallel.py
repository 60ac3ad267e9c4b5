"""Independent Spark work side by side on one session."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import FIRST_EXCEPTION, CancelledError, ThreadPoolExecutor, wait
from functools import partial
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

Result = TypeVar("Result")


def run_together(spark: SparkSession, work: Sequence[Callable[[], Result]], width: int, name: str = "together") -> list[Result]:
    """Results of all calls, in order, with at most ``width`` of them running at a time.

    Threads inherit the caller's job group and local properties; their jobs carry
    one tag and the scheduler pool ``name``, which shares executors evenly where
    the session's scheduler is fair. At the first failure no further call starts,
    the running ones' Spark jobs are cancelled, and that failure is raised.
    """
    context, tag, failed = spark.sparkContext, f"{name}-{uuid.uuid4().hex}", threading.Event()

    def one(call: Callable[[], Result]) -> Result:
        if failed.is_set():
            raise CancelledError(name)
        context.addJobTag(tag)
        context.setLocalProperty("spark.scheduler.pool", name)
        try:
            return call()
        except BaseException:
            failed.set()
            raise

    with ThreadPoolExecutor(max(1, width)) as pool:
        # Wrapped one by one, so that each thread has its own copy of the properties.
        running = [pool.submit(inheritable_thread_target(spark)(partial(one, call))) for call in work]
        ended, rest = wait(running, return_when=FIRST_EXCEPTION)
        errors = [f.exception() for f in running if f in ended and f.exception() is not None]
        if errors:
            # A call may be between two of its jobs, so this is repeated until all threads have ended.
            while rest:
                context.cancelJobsWithTag(tag)
                rest = wait(rest, timeout=0.5).not_done
            raise next((e for e in errors if not isinstance(e, CancelledError)), errors[0])
        return [f.result() for f in running]
