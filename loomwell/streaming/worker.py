"""The worker's queue as a keyed state machine with timers.

Each record has a state of its own: where it stands in the lifecycle, its tries, the attempt under way and the last event it has seen. One
timer runs in processing time: a *lease*, after which an attempt that hasn't answered has failed, or a *retry*, which
puts a failed record back into its queue; a record never waits for both. Every change goes through :func:`lifecycle.check`, so no illegal transition can come out.

Events (rec_id, seq, kind, ok, outages, questions), in order of seq for each record:

- ``submit``: the record enters the queue;
- ``begin``: an attempt starts (its lease runs from now);
- ``result``: the attempt's answer. It counts as good if ``ok`` and no outage came during the work, even if it was finished locally;
- ``save``: a person is done with the record: what is left of review, linking and saving happens at once;
- ``sent``: the answer of a delivery, judged like a result.

An event that was sent again, or comes after a later one, is passed over; so is a result without an attempt, as after its lease.
State of records that are synchronised or cancelled expires after ``keep``; all other state stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomwell.operators.lifecycle import MOST_TRIES, check
from loomwell.streaming.queue import to_saved

EVENTS = "rec_id long, seq long, kind string, ok boolean, outages int, questions int"
OUT = "rec_id long, n long, `from` string, `to` string, reason string, tries int"
ENDED = ("SYNCHRONISE", "ANNULE")


@dataclass(frozen=True)
class Timing:
    """Milliseconds of a lease, of the wait before a retry, and for which an ended record is remembered."""

    lease: int = 600_000
    retry: int = 1_000
    keep: int = 30 * 86_400_000


@dataclass
class Record:
    at: str = "CAPTURE"
    tries: int = 0
    n: int = 0
    seen: int = -1
    working: bool = False
    due: int = 0  # when the timer runs out, 0 without one

    def move(self, to: str, reason: str) -> tuple:
        was, self.at = self.at, check(self.at, to)
        self.n += 1
        return self.n, was, to, reason, self.tries


def failed(record: Record, reason: str, most: int) -> list[tuple]:
    """A failed attempt: back to the queue after a while, or to a person once the tries are used up."""
    record.working = False
    record.tries += 1
    out = [record.move("ECHEC_TRAITEMENT", reason)]
    if record.tries >= most:
        out.append(record.move("REVISION_MANUELLE_REQUISE", f"{record.tries} failed attempts"))
    return out


def react(record: Record, kind: str, ok: bool, outages: int, questions: int, most: int = MOST_TRIES) -> list[tuple]:
    """The transitions that one event brings."""
    good = bool(ok) and not outages
    if kind == "submit" and record.at == "CAPTURE":
        return [record.move("EN_ATTENTE_IA", "submitted")]
    if kind == "begin" and record.at == "EN_ATTENTE_IA":
        record.working = True
    elif kind == "result" and record.at == "EN_ATTENTE_IA" and record.working:
        if not good:
            return failed(record, "outage during the work" if outages else "failed", most)
        record.working = False
        done = record.move("TRAITE_IA", "read")
        return [done, record.move("A_REVISER", f"{questions} questions") if questions else record.move("VALIDE", "nothing to ask")]
    elif kind == "save":
        record.working = False
        return [record.move(to, "saved") for to in to_saved(record.at)]
    elif kind == "sent" and record.at == "ENREGISTRE":
        return [record.move("SYNCHRONISE", "received") if good else record.move("ECHEC_SYNC", "outage during delivery" if outages else "not received")]
    return []


def expire(record: Record, most: int = MOST_TRIES) -> list[tuple]:
    """What the timer brings: the end of a lease, or the retry of what has failed."""
    if record.working:
        return failed(record, "no answer in time", most)
    again = {"ECHEC_TRAITEMENT": "EN_ATTENTE_IA", "ECHEC_SYNC": "ENREGISTRE"}.get(record.at)
    return [record.move(again, "retry")] if again else []


STATE = "at string, tries int, n long, seen long, working boolean, due long"


def _step(timing: Timing, most: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        record, moves = Record(*state.get) if state.exists else Record(), []
        now = state.getCurrentProcessingTimeMs()
        if state.hasTimedOut:
            if record.at in ENDED:
                state.remove()
                return
            record.due = 0
            moves = expire(record, most)
        else:
            for row in pd.concat(list(batches)).sort_values("seq", kind="stable").itertuples(index=False):
                if row.seq <= record.seen:
                    continue
                record.seen = int(row.seq)
                before = (record.at, record.working)
                moves += react(record, row.kind, row.ok, int(row.outages or 0), int(row.questions or 0), most)
                if (record.at, record.working) != before:
                    record.due = 0
        wait = timing.lease if record.working else timing.retry if record.at in ("ECHEC_TRAITEMENT", "ECHEC_SYNC") else timing.keep if record.at in ENDED else 0
        record.due = record.due or (now + wait if wait else 0)
        state.update((record.at, record.tries, record.n, record.seen, record.working, record.due))
        if record.due:
            state.setTimeoutDuration(max(1, record.due - now))
        if moves:
            yield pd.DataFrame([(key[0], *m) for m in moves], columns=["rec_id", "n", "from", "to", "reason", "tries"])

    return step


def transitions(events: DataFrame, timing: Timing = Timing(), most: int = MOST_TRIES) -> DataFrame:
    """(rec_id, n, from, to, reason, tries): every transition of every record, numbered per record, as events and timers bring them.

    Timers keep the query going, so it is run by a trigger in processing time and stopped from outside, not by ``availableNow``.
    """
    return events.groupBy("rec_id").applyInPandasWithState(_step(timing, most), OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
