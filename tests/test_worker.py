"""The worker: transitions by event, timers, restarts, and nothing illegal on any path."""

from __future__ import annotations

import random
import time

import pytest

from loomwell.operators import lifecycle
from loomwell.streaming import worker
from loomwell.streaming.worker import Record, expire, react


def run(events, record=None):
    record = record or Record()
    return record, [m for e in events for m in (expire(record) if e == "timer" else react(record, *e))]


GOOD, BAD, CUT = ("result", True, 0, 0), ("result", False, 0, 0), ("result", True, 1, 0)
SUBMIT, BEGIN, SAVE = ("submit", None, 0, 0), ("begin", None, 0, 0), ("save", None, 0, 0)


def test_a_good_record_goes_all_the_way():
    record, moves = run([SUBMIT, BEGIN, ("result", True, 0, 2), SAVE, ("sent", False, 0, 0), "timer", ("sent", True, 1, 0), "timer", ("sent", True, 0, 0)])
    assert record.at == "SYNCHRONISE" and record.tries == 0
    assert [m[2] for m in moves] == [
        "EN_ATTENTE_IA", "TRAITE_IA", "A_REVISER", "VALIDE", "PATIENTE_LIEE", "ENREGISTRE", "ECHEC_SYNC", "ENREGISTRE", "ECHEC_SYNC", "ENREGISTRE", "SYNCHRONISE",
    ]


def test_an_outage_during_work_is_a_failed_try():
    record, moves = run([SUBMIT, BEGIN, CUT])
    assert record.at == "ECHEC_TRAITEMENT" and record.tries == 1 and moves[-1][3] == "outage during the work"


def test_three_failures_of_any_kind_ask_a_person():
    record, moves = run([SUBMIT, BEGIN, BAD, "timer", BEGIN, "timer", "timer", BEGIN, CUT])
    assert record.at == "REVISION_MANUELLE_REQUISE" and record.tries == 3
    assert "no answer in time" in [m[3] for m in moves]


def test_a_result_after_its_lease_is_passed_over():
    record, moves = run([SUBMIT, BEGIN, "timer", GOOD, "timer", GOOD])
    assert record.at == "EN_ATTENTE_IA" and [m[2] for m in moves][-1] == "EN_ATTENTE_IA"


def test_every_path_is_legal():
    rng = random.Random(0)
    kinds = ["submit", "begin", "result", "save", "sent"]
    for _ in range(3000):
        events = [rng.choice(["timer", (rng.choice(kinds), rng.random() < 0.6, rng.choice((0, 0, 1)), rng.choice((0, 2)))]) for _ in range(rng.randrange(25))]
        _, moves = run(events)
        assert all(b in lifecycle.ALLOWED[a] for _, a, b, _, _ in moves)
        assert [m[0] for m in moves] == list(range(1, len(moves) + 1))
        assert all(x[2] == y[1] for x, y in zip(moves, moves[1:]))


def drive(spark, folder, checkpoint, sink, timing, until):
    """Run until a condition holds; a query with timers never ends by itself."""
    stream = spark.readStream.schema(worker.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(folder))
    writer = worker.transitions(stream, timing).writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", str(checkpoint))
    query = writer.trigger(processingTime="300 milliseconds").start()
    end = time.time() + 90
    while time.time() < end and query.isActive and not until():
        time.sleep(0.2)
    failure = query.exception()
    query.stop()
    if failure:
        raise failure


def put(spark, folder, rows):
    spark.createDataFrame(rows, worker.EVENTS).coalesce(1).write.mode("append").parquet(str(folder))


def test_restart_in_mid_batch_brings_each_transition_once(spark, tmp_path):
    got, fail = {}, [True]

    def sink(batch, batch_id):
        rows = batch.collect()
        if rows and fail[0] and batch_id == 1:
            fail[0] = False
            raise OSError("the executor is gone")
        got[batch_id] = rows  # by batch: one that is sent again is the same one

    put(spark, tmp_path / "in", [(1, 0, "submit", None, 0, 0), (1, 1, "begin", None, 0, 0), (2, 0, "submit", None, 0, 0)])
    put(spark, tmp_path / "in", [(1, 2, "result", True, 0, 0), (2, 1, "begin", None, 0, 0), (1, 1, "begin", None, 0, 0)])
    timing = worker.Timing(lease=10**9, retry=10**9)
    rows = lambda: [r for batch in got.values() for r in batch]
    with pytest.raises(Exception, match="executor is gone"):
        drive(spark, tmp_path / "in", tmp_path / "ck", sink, timing, lambda: False)
    drive(spark, tmp_path / "in", tmp_path / "ck", sink, timing, lambda: len(rows()) >= 4)
    put(spark, tmp_path / "in", [(1, 3, "save", None, 0, 0), (1, 2, "result", False, 0, 0), (2, 2, "result", False, 0, 0)])
    drive(spark, tmp_path / "in", tmp_path / "ck", sink, timing, lambda: len(rows()) >= 7)
    assert sorted((r.rec_id, r.n, r.to) for r in rows()) == [
        (1, 1, "EN_ATTENTE_IA"), (1, 2, "TRAITE_IA"), (1, 3, "VALIDE"), (1, 4, "PATIENTE_LIEE"), (1, 5, "ENREGISTRE"), (2, 1, "EN_ATTENTE_IA"), (2, 2, "ECHEC_TRAITEMENT"),
    ]


def test_timers_retry_and_end_leases(spark, tmp_path):
    got = []
    put(spark, tmp_path / "in", [(1, 0, "submit", None, 0, 0), (1, 1, "begin", None, 0, 0), (2, 0, "submit", None, 0, 0), (2, 1, "begin", None, 0, 0), (2, 2, "result", False, 0, 0)])
    done = lambda: {(r.rec_id, r.reason) for r in got} >= {(1, "no answer in time"), (1, "retry"), (2, "retry")}
    drive(spark, tmp_path / "in", tmp_path / "ck", lambda b, _: got.extend(b.collect()), worker.Timing(lease=1500, retry=500), done)
    assert done()
    assert all(b in lifecycle.ALLOWED[a] for a, b in ((r["from"], r["to"]) for r in got))
    assert [r.to for r in sorted(got, key=lambda r: r.n) if r.rec_id == 1] == ["EN_ATTENTE_IA", "ECHEC_TRAITEMENT", "EN_ATTENTE_IA"]
