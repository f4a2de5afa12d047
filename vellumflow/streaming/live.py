"""Live conversations: speaker roles and answered questions while turns come in, by state of each conversation.

A stream of turns has encounter_id, utt_id, speaker, role, text, ts (event time) and ended (true for a row that says that the conversation
is over; it is no turn). What is costly (scores, cues, splitting into questions) is column code before the state; the state holds sums by
speaker, and turns and questions that wait.

* live_roles gives a conversation's roles again after each trigger that changes it, and marks them final when it ends or has been idle. A
  turn that comes after the end corrects them as long as the state is kept, that is until `idle` after the last turn.
* live_answers settles turns in order of utt_id: all at the end, else once the watermark has passed them, so turns within the delay may
  come in any order. A turn that comes after a later one was settled is left out.

State is kept in RocksDB and survives a restart from the stream's checkpoint. A turn that a source delivers twice counts once for answers
and twice for roles. Rows without encounter_id or ts are left out; those without utt_id come first (as -1), a missing speaker is UNKNOWN.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as T

TURN = "encounter_id string, utt_id long, speaker string, role string, text string, ts timestamp, ended boolean"
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextlib.contextmanager
def kept_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that these streams need, for those started within."""
    before = spark.conf.get(_PROVIDER[0], None)
    spark.conf.set(*_PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER[0]) if before is None else spark.conf.set(_PROVIDER[0], before)


def _ms(seconds: float) -> int:
    return int(seconds * 1000)


class RoleState(StatefulProcessor):
    """Sums of doctor scores by speaker."""

    def __init__(self, idle: float):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.speakers = handle.getMapState("speakers", "speaker string", "score long, first long, turns long")
        self.close_at = handle.getValueState("close_at", "at long, ended boolean")

    def handleInputRows(self, key, rows, timerValues):
        at, ended = self.close_at.get() if self.close_at.exists() else (0, False)
        for r in rows:
            at, ended = max(at, r.ms + _ms(self.idle)), ended or r.ended
            if not r.ended:
                score, first, turns = self.speakers.getValue((r.speaker,)) if self.speakers.containsKey((r.speaker,)) else (0, r.utt_id, 0)
                self.speakers.updateValue((r.speaker,), (score + r.score, min(first, r.utt_id), turns + 1))
        self.close_at.update((at, ended))
        self.handle.registerTimer(at)
        yield from self.ranked(key, ended)

    def ranked(self, key, final):
        speakers = sorted((-v[0], v[1], k[0], v[2]) for k, v in self.speakers.iterator())
        for rank, (score, _, speaker, turns) in enumerate(speakers, 1):
            role = {1: "DOCTOR", 2: "PATIENT"}.get(rank) or f"OTHER_{rank - 2}"
            yield Row(encounter_id=key[0], speaker=speaker, role=role, score=-score, turns=turns, final=final)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.close_at.exists():
            at, ended = self.close_at.get()
            if expiredTimerInfo.getExpiryTimeInMs() >= at:
                if not ended:
                    yield from self.ranked(key, True)
                self.speakers.clear()
                self.close_at.clear()


class AnswerState(StatefulProcessor):
    """Turns that wait for being settled, and questions that wait for an answer, each with the backchannels counted before it."""

    def __init__(self, window: int, idle: float):
        self.window, self.idle = window, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "utt_id long", "ms long, patient boolean, backchannel boolean, text string, questions array<string>")
        self.open = handle.getMapState("open", "question_utt long, part int", "question string, skips long")
        self.past = handle.getValueState("past", "settled long, skips long, close_at long")

    def handleInputRows(self, key, rows, timerValues):
        settled, skips, close_at = self.past.get() if self.past.exists() else (-(2**62), 0, 0)
        ended = False
        for r in rows:
            ended, close_at = ended or r.ended, max(close_at, r.ms + _ms(self.idle))
            if not r.ended and r.utt_id > settled:
                self.waiting.updateValue((r.utt_id,), (r.ms, r.patient, r.backchannel, r.text, r.questions))
                self.handle.registerTimer(r.ms + 1)
        self.past.update((settled, skips, close_at))
        self.handle.registerTimer(close_at)
        if ended:
            yield from self.settle(key, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.past.exists():
            yield from self.settle(key, timerValues.getCurrentWatermarkInMs())
            if expiredTimerInfo.getExpiryTimeInMs() >= self.past.get()[2]:
                yield from self.settle(key, None)
                for state in (self.waiting, self.open, self.past):
                    state.clear()

    def settle(self, key, watermark):
        """Takes the turns up to the watermark (all, if None) in order."""
        settled, skips, close_at = self.past.get()
        for (utt,), turn in sorted((k, v) for k, v in self.waiting.iterator() if watermark is None or v[0] <= watermark):
            _, patient, backchannel, text, questions = turn
            if patient and not backchannel:
                for (question_utt, part), (question, before) in sorted(self.open.iterator()):
                    if skips - before < self.window:
                        yield Row(encounter_id=key[0], question_utt=question_utt, part=part, question=question, answer_utt=utt, answer=text)
                self.open.clear()
            elif patient:
                skips += 1
            for part, question in enumerate(questions or []):
                self.open.updateValue((utt, part), (question, skips))
            self.waiting.removeKey((utt,))
            settled = max(settled, utt)
        self.past.update((settled, skips, close_at))


def _turns(stream: DataFrame, late: str) -> DataFrame:
    rows = stream.filter("encounter_id is not null and ts is not null").withColumns({"ended": F.coalesce("ended", F.lit(False)), "utt_id": F.coalesce(F.col("utt_id").cast("long"), F.lit(-1)), "ms": F.unix_millis("ts"), "text": F.coalesce("text", F.lit(""))})
    return rows.withWatermark("ts", late)


def live_roles(stream: DataFrame, late: str = "10 minutes", idle: float = 3600.0) -> DataFrame:
    """(encounter_id, speaker, role, score, turns, final), again after each change; in update mode."""
    rows = _turns(stream, late).select("encounter_id", F.coalesce("speaker", F.lit("UNKNOWN")).alias("speaker"), "utt_id", T.doctor_score(F.col("text")).cast("long").alias("score"), "ended", "ms", "ts")
    return rows.groupBy("encounter_id").transformWithState(RoleState(idle), "encounter_id string, speaker string, role string, score long, turns long, final boolean", "Update", "EventTime")


def live_answers(stream: DataFrame, window: int = 3, late: str = "10 minutes", idle: float = 3600.0) -> DataFrame:
    """The rows of dialogue.question_answers, each once, as soon as the answer is settled."""
    role = F.upper("role")
    asks = (role == "DOCTOR") & T.is_question(F.col("text"))
    parts = F.filter(F.transform(F.split("text", r"(?<=\?)"), T.strip), lambda q: (q != "") & T.is_question(q))
    patient = F.coalesce(role == "PATIENT", F.lit(False))
    rows = _turns(stream, late).select("encounter_id", "utt_id", patient.alias("patient"), F.coalesce(T.is_backchannel(F.col("text")), F.lit(False)).alias("backchannel"), "text", F.when(asks, parts).alias("questions"), "ended", "ms", "ts")
    return rows.groupBy("encounter_id").transformWithState(AnswerState(window, idle), "encounter_id string, question_utt long, part int, question string, answer_utt long, answer string", "Append", "EventTime")


def run(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there and appends its rows, with the number of their trigger (`trigger`), to a Parquet table: a trigger that is run again replaces its own rows."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/trigger={number}")

    with kept_in_rocksdb(stream.sparkSession):
        q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        finally:
            q.stop()


def latest_roles(written: DataFrame) -> DataFrame:
    """Of the rows that run() wrote for live_roles, those of each conversation's last trigger: encounter_id, speaker, role."""
    last = written.groupBy("encounter_id", "speaker").agg(F.max_by(F.struct("role", "final"), "trigger").alias("r"))
    return last.select("encounter_id", "speaker", "r.role", "r.final")
