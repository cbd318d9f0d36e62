"""stream_scores in a session that nobody prepared for streams."""

import os
import subprocess
import sys

from compare import compare, duck
from ledgerlens import session
from ledgerlens.plans import checks
from test_state import Job, pay

SF = "/root/testdata/sf0.001"


def test_stream_scores_bring_their_own_state_store(spark):
    default = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    before = spark.conf.get(session.STATE_PROVIDER)
    spark.conf.set(session.STATE_PROVIDER, default)
    try:
        ok, said = compare(spark, SF, "stream_scores", checks.QUERIES["stream_scores"], checks.SQL["stream_scores"], duck(SF))
        assert ok, said
        assert spark.conf.get(session.STATE_PROVIDER) == default
    finally:
        spark.conf.set(session.STATE_PROVIDER, before)


def test_the_drivers_worker_finds_the_package(spark, tmp_path):
    rest = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    given = spark.sparkContext.environment["PYTHONPATH"]
    done = subprocess.run([sys.executable, "-c", "import ledgerlens.streaming.scoring"], env=rest | {"PYTHONPATH": given}, cwd=tmp_path, capture_output=True)
    assert done.returncode == 0, done.stderr


class Counted:
    """A state of test_state whose calls are counted."""

    def __init__(self, state, calls):
        self.state, self.calls = state, calls

    def __getattr__(self, name):
        self.calls.append(name)
        return getattr(self.state, name)


def test_calls_to_the_state_do_not_grow_with_payments():
    job = Job()
    calls = []
    job.processor.stored = {k: Counted(v, calls) for k, v in job.processor.stored.items()}
    job.processor.at = Counted(job.processor.at, calls)
    job.registerTimer = lambda t, put=job.registerTimer: calls.append("timer") or put(t)
    job.feed(*[pay(f"{i:04}", 1_000_000 + i * 4_000, device=f"d{i % 7}") for i in range(900)])
    assert len(job.advance(1 << 60)) == 900 and job.empty()
    assert len(calls) < 50, len(calls)


def test_no_payments(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    assert checks.QUERIES["stream_scores"](spark, str(tmp_path)).collect() == []
