"""Episodes and leases of a session as keyed state, with timers and a close event: the batch fold, fed by micro-batches.

State lives in RocksDB and is written with every batch, so a restart from the checkpoint goes on where it was. A session's
state is a short list of episodes that events can still join, a map of those that are open, read as a whole only when the
session closes, and a map of leases, each ended by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from annalist.operators.episodes import CHANGE, Session, as_frame, step

#: What a session's stream holds: events, closes and lease updates.
STEP = "session_id long, event_id long, ts timestamp, title string, entities array<string>, confidence double, closes boolean, lease_key string, value string, ttl long"
_EPISODE = "episode long, title string, status string, start_at timestamp, end_at timestamp, updated_at timestamp, entities array<string>, confidence double, events long"
_LEASE = ("issued_at", "refreshed_at", "expires_at")
#: A row of the result: a change of an episode (what = episode) or of a lease (what = lease, status active, expired or closed).
TOLD = "what string, " + CHANGE.strip() + ", lease_key string, value string, issued_at timestamp, refreshed_at timestamp, expires_at timestamp"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NAMES = [part.split()[0] for part in _EPISODE.split(", ")]


def _millis(at: datetime) -> int:
    return int(at.replace(tzinfo=timezone.utc).timestamp() * 1000)


class _Open(MutableMapping):
    """The open episodes of a session in the state store, read and written one by one."""

    def __init__(self, state):
        self.state = state

    def __getitem__(self, number: int) -> dict:
        return dict(zip(_NAMES, self.state.getValue((number,)), strict=True))

    def __setitem__(self, number: int, episode: dict) -> None:
        self.state.updateValue((number,), tuple(episode[n] for n in _NAMES))

    def __delitem__(self, number: int) -> None:
        self.state.removeKey((number,))

    def __iter__(self) -> Iterator[int]:
        return iter([key[0] for key in self.state.keys()])

    def __len__(self) -> int:
        return sum(1 for _ in self.state.keys())


class SessionFold(StatefulProcessor):
    """Episodes by gap and relatedness, leases by their time to live; a close ends both."""

    def __init__(self, gap_minutes: float, related_minutes: float):
        self.gap, self.related = timedelta(minutes=gap_minutes), timedelta(minutes=related_minutes)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "made long, seq long")
        self.recent = handle.getListState("recent", _EPISODE)
        self.open = handle.getMapState("open", "number long", _EPISODE)
        self.leases = handle.getMapState("leases", "lease_key string", "value string, issued_at timestamp, refreshed_at timestamp, expires_at timestamp")

    def _session(self) -> Session:
        session = Session(self.gap, self.related, _Open(self.open))
        if self.counts.exists():
            session.made, session.seq = self.counts.get()
        if self.recent.exists():
            session.recent = [dict(zip(_NAMES, e, strict=True)) for e in self.recent.get()]
        return session

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session, changes, told = self._session(), [], []
        batch = pd.concat(list(rows)).sort_values(["ts", "closes", "event_id"], kind="stable")  # one session's rows of a micro-batch
        for row in batch.itertuples(index=False):
            at = row.ts.to_pydatetime()
            if isinstance(row.lease_key, str):
                told += self._refresh(row.lease_key, row.value, at, int(row.ttl))
                continue
            changes += step(session, row)
            if row.closes:
                told += self._end(lambda lease: True, "closed", at)
        self.counts.update((session.made, session.seq))
        if session.recent:
            self.recent.put([tuple(e[n] for n in _NAMES) for e in session.recent])
        elif self.recent.exists():
            self.recent.clear()
        yield from self._rows(key, changes, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        yield from self._rows(key, [], self._end(lambda lease: _millis(lease["expires_at"]) <= now, "expired", None))

    def _held(self) -> list[tuple[str, dict]]:
        return sorted((k[0], dict(zip(("value", *_LEASE), v, strict=True))) for k, v in self.leases.iterator())

    def _refresh(self, lease_key: str, value: str | None, at: datetime, ttl: int) -> list[dict]:
        """A lease begun or refreshed; one of an earlier time than what is held changes nothing, one after the end begins anew."""
        held = dict(zip(("value", *_LEASE), self.leases.getValue((lease_key,)), strict=True)) if self.leases.containsKey((lease_key,)) else None
        if held and at < held["refreshed_at"]:
            return []
        issued = held["issued_at"] if held and at <= held["expires_at"] else at
        lease = {"value": value, "issued_at": issued, "refreshed_at": at, "expires_at": at + timedelta(seconds=ttl)}
        self.leases.updateValue((lease_key,), tuple(lease[n] for n in ("value", *_LEASE)))
        self.handle.registerTimer(_millis(lease["expires_at"]))
        return [{"lease_key": lease_key, "status": "active", **lease}]

    def _end(self, ends, status: str, at: datetime | None) -> list[dict]:
        """Leases that end; a timer of a lease that was refreshed since finds none."""
        out = []
        for lease_key, lease in self._held():
            if ends(lease):
                self.leases.removeKey((lease_key,))
                out.append({"lease_key": lease_key, "status": status, **lease, "expires_at": at or lease["expires_at"]})
        return out

    @staticmethod
    def _rows(key, changes: list[dict], leases: list[dict]) -> Iterator[pd.DataFrame]:
        names = [part.strip().split()[0] for part in TOLD.split(", ")]
        for what, rows in (("episode", as_frame(key[0], changes)), ("lease", pd.DataFrame([{"session_id": key[0], **x} for x in leases]))):
            if len(rows):
                yield rows.assign(what=what, **{n: None for n in names if n not in rows and n != "what"})[names]

    def close(self) -> None:
        pass


def session_changes(steps: DataFrame, gap_minutes: float = 20, related_minutes: float = 10, late: str = "1 hour") -> DataFrame:
    """The changes of episodes and leases (see TOLD) that a stream of steps (see STEP) brings, an append-only log.

    An upsert by session and episode, or by session and lease, is the current table. Rows of a micro-batch are taken in
    order of time; rows of later batches come later, whatever their time, as events are derived in order of arrival.
    Leases end when the watermark, `late` behind the newest time, passes their end, or with their session. Rows without a
    session or a time are left out.
    """
    steps.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = steps.where("session_id is not null and ts is not null").withColumn("closes", F.coalesce("closes", F.lit(False))).withWatermark("ts", late)
    return rows.groupBy("session_id").transformWithStateInPandas(SessionFold(gap_minutes, related_minutes), outputStructType=TOLD, outputMode="append", timeMode="eventTime")


def stream_steps(spark: SparkSession, path: str, a_batch: int = 1) -> DataFrame:
    """A folder of JSON lines as a stream of steps, so many files a micro-batch."""
    return spark.readStream.schema(STEP).option("maxFilesPerTrigger", a_batch).json(path)
