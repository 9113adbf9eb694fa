"""Episodes assigned one event after another: what an event joins depends on what earlier ones left open."""

from __future__ import annotations

import re
from collections.abc import Iterator, MutableMapping
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions.rules import TOPIC_STOP_WORDS

_WORD = re.compile(r"[a-z0-9_']+")
#: Latest episodes of a session that an event may be related to.
CANDIDATES = 12
#: Entities that stand for an episode.
DOMINANT = 4
#: A change of an episode, by an event or by its session's close (no event); seq numbers the changes of a session.
CHANGE = """
session_id long, seq long, event_id long, episode long, title string, status string, start_at timestamp, end_at timestamp, updated_at timestamp,
entities array<string>, confidence double, events long
""".replace("\n", " ")


def topic_words(title: str) -> frozenset[str]:
    long = {w for w in _WORD.findall(title.lower()) if len(w) >= 4 and w not in TOPIC_STOP_WORDS}
    return frozenset(long | {w[:-1] for w in long if w.endswith("s") and len(w) >= 6})


class Session:
    """The episodes of one session.

    recent: those that an event can still join, the latest updated last; of others only `open`, by number, knows, which is
    a mapping that a caller may keep elsewhere.
    """

    def __init__(self, gap: timedelta, related: timedelta, opened: MutableMapping[int, dict] | None = None):
        self.gap, self.related = gap, related
        self.recent: list[dict] = []
        self.open: MutableMapping[int, dict] = {} if opened is None else opened
        self.made = self.seq = 0

    def _place(self, episode: dict) -> None:
        """In order of updates, the last touched last; late events may put an episode back."""
        at = len(self.recent)
        while at and self.recent[at - 1]["updated_at"] > episode["updated_at"]:
            at -= 1
        self.recent.insert(at, episode)

    def _match(self, ts: datetime, title: str, named: set[str]) -> dict | None:
        newest = self.recent[::-1]
        same = next((e for e in newest if e["title"].lower() == title.lower() and e["status"] == "open" and e["updated_at"] >= ts - self.gap), None)
        words = topic_words(title)
        if same is not None or not words:
            return same
        best, found = 0, None
        for e in newest[:CANDIDATES]:
            if e["updated_at"] < ts - self.related or e["title"].lower() == title.lower():
                continue
            both, shared = len(words & topic_words(e["title"])), len(named & {n.lower() for n in e["entities"]})
            if (both >= 2 or (both and shared)) and 2 * both + shared > best:
                best, found = 2 * both + shared, e
        return found

    def join(self, ts: datetime, title: str, entities: list[str], confidence: float | None = None) -> dict:
        """The episode that an event joins or begins, as it is then."""
        entities = entities[:DOMINANT]
        found = self._match(ts, title, {e.lower() for e in entities})
        if found is None:
            self.made += 1
            found = {"episode": self.made, "title": title, "status": "open", "start_at": ts, "end_at": None, "entities": entities, "confidence": confidence, "events": 0}
        else:
            self.recent = [e for e in self.recent if e["episode"] != found["episode"]]
            found["entities"] = entities or found["entities"]
            found["confidence"] = max((c for c in (found["confidence"], confidence) if c is not None), default=None)
        found["events"] += 1
        found["updated_at"] = ts
        self._place(found)
        if found["status"] == "open":
            self.open[found["episode"]] = found
        if len(self.recent) > 4 * CANDIDATES:
            self.forget(ts)
        return self._told(found)

    def forget(self, now: datetime) -> None:
        """Leaves out of `recent` what no event from now on can join; events come in order of time but for those of the gap."""
        last = now - max(self.gap, self.related)
        old = self.recent[: -2 * CANDIDATES]
        self.recent = [e for e in old if e["updated_at"] >= last] + self.recent[-2 * CANDIDATES :]

    def close(self, ts: datetime) -> list[dict]:
        """Ends all open episodes, in the order of their numbers."""
        ended = [self.open[n] for n in sorted(self.open)]
        held = {e["episode"] for e in ended}
        self.recent = [e for e in self.recent if e["episode"] not in held]
        for e in ended:
            e |= {"status": "closed", "end_at": ts, "updated_at": ts}
            self._place(e)
        for n in held:
            del self.open[n]
        self.recent = self.recent[-4 * CANDIDATES :]
        return [self._told(e) for e in ended]

    def _told(self, episode: dict) -> dict:
        self.seq += 1
        return {**episode, "seq": self.seq}


def step(session: Session, row) -> list[dict]:
    """The changes that a row brings: an event's episode, or the end of all open ones."""
    ts = row.ts.to_pydatetime() if isinstance(row.ts, pd.Timestamp) else row.ts
    if row.closes:
        return [{**e, "event_id": None} for e in session.close(ts)]
    entities = [e for e in (row.entities if row.entities is not None else ()) if e]
    confidence = None if row.confidence is None or row.confidence != row.confidence else float(row.confidence)
    return [{**session.join(ts, row.title or "", entities, confidence), "event_id": row.event_id}]


def as_frame(session_id, changes: list[dict]) -> pd.DataFrame:
    names = [part.split()[0] for part in CHANGE.split(", ")]
    out = pd.DataFrame([{"session_id": session_id, **c} for c in changes], columns=names)
    for name in ("event_id", "episode", "seq", "events", "session_id"):
        out[name] = out[name].astype("Int64")
    return out


def steps_of(events: DataFrame, closes: DataFrame | None = None) -> DataFrame:
    """Events and closes (session_id, ts) as one table; rows without a session or a time are left out."""
    wanted = {"event_id": "long", "session_id": "long", "ts": "timestamp", "title": "string", "entities": "array<string>", "confidence": "double", "closes": "boolean"}

    def shaped(df: DataFrame, close: bool) -> DataFrame:
        have = {c: F.col(c) for c in df.columns} | {"closes": F.lit(close)}
        return df.select(*(have.get(c, F.lit(None)).cast(t).alias(c) for c, t in wanted.items())).where("session_id is not null and ts is not null")

    rows = shaped(events, False)
    return rows if closes is None else rows.unionByName(shaped(closes.select("session_id", "ts"), True))


def episode_changes(events: DataFrame, closes: DataFrame | None = None, gap_minutes: float = 20, related_minutes: float = 10) -> DataFrame:
    """A row for each change of an episode (see CHANGE) by events (event_id, session_id, ts, title, entities, confidence) and closes (session_id, ts).

    An event joins the newest open episode of its title that was updated within the gap; else, among the session's
    latest ones updated within related_minutes, open or not, that with the most topic words and entities in common (two
    words, or one and an entity, the first best one); else it begins one. The latest entities, at most four, and the
    highest confidence stand for an episode. A close ends all open ones, after the events of its time. Rows are sorted
    within partitions of whole sessions and streamed: memory holds a session's open episodes, never its events; a session
    is one task's work, as each of its steps depends on the one before.
    """
    gap, related = timedelta(minutes=gap_minutes), timedelta(minutes=related_minutes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, of = None, None
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                if row.session_id != of or session is None:
                    session, of = Session(gap, related), row.session_id
                found += [{"session_id": of, **c} for c in step(session, row)]
            if found:
                frame = as_frame(None, found)
                frame["session_id"] = pd.array([c["session_id"] for c in found], dtype="Int64")
                yield frame

    rows = steps_of(events, closes)
    return rows.repartition("session_id").sortWithinPartitions("session_id", "ts", "closes", "event_id").mapInPandas(run, CHANGE)


def episodes_of(changes: DataFrame) -> DataFrame:
    """Each episode as its latest change left it: what an upsert by (session_id, episode) of the changes ends in."""
    names = [c for c in changes.columns if c not in ("session_id", "episode", "event_id")]
    latest = changes.groupBy("session_id", "episode").agg(F.max_by(F.struct(*names), "seq").alias("e"))
    return latest.select("session_id", "episode", *(F.col(f"e.{c}").alias(c) for c in names if c != "seq"))


def assign_episodes(events: DataFrame, gap_minutes: float = 20, related_minutes: float = 10) -> DataFrame:
    """event_id, session_id and episode (a running number within the session) of events, as episode_changes tells them."""
    return episode_changes(events, None, gap_minutes, related_minutes).select("event_id", "session_id", "episode")
