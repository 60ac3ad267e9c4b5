"""Work side by side: order, bounds, cancelling."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from gradeframe.parallel import run_together


def test_results_in_order_and_never_more_than_the_width(spark):
    lock, running, most = threading.Lock(), [0], [0]

    def call(i):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        n = spark.range(i + 1).count()
        time.sleep(0.1)
        with lock:
            running[0] -= 1
        return n

    assert run_together(spark, [lambda i=i: call(i) for i in range(7)], 3) == list(range(1, 8))
    assert 1 < most[0] <= 3
    assert run_together(spark, [], 3) == []


def test_threads_have_the_callers_properties_and_their_own_pool(spark):
    context = spark.sparkContext
    context.setLocalProperty("mine", "yes")
    try:
        got = run_together(spark, [lambda: (context.getLocalProperty("mine"), context.getLocalProperty("spark.scheduler.pool"))] * 2, 2, "folds")
    finally:
        context.setLocalProperty("mine", None)
    assert got == [("yes", "folds")] * 2 and context.getLocalProperty("spark.scheduler.pool") is None


def test_first_failure_cancels_running_jobs_and_starts_no_more(spark):
    started = []
    slow = F.expr("java_method('java.lang.Thread', 'sleep', 60000L)")

    def long_job():
        started.append("long")
        spark.range(8).select(F.lit(1), slow.alias("s")).write.format("noop").mode("overwrite").save()

    def failing():
        time.sleep(2)
        raise ValueError("broken fold")

    begin = time.monotonic()
    with pytest.raises(ValueError, match="broken fold"):
        run_together(spark, [long_job, failing, lambda: started.append("third")], 2)
    assert time.monotonic() - begin < 30 and started == ["long"]
