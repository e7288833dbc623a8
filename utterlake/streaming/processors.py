"""Keyed state for streams: speech detection, stabilisation, fractional step credit, latency against arriving marks.

A key's rows come in any order within a micro-batch and are worked on by seq. One Arrow batch is sorted as it is; more are
parked in map state by blocks of seq and taken from there block by block, so that a hot key needs one block in memory, whatever the
micro-batch. A row at or below the last seq seen in an earlier batch, or a copy of one in this batch, changes no state; it
goes out with ``late`` set, so that nothing is lost without a trace. State is typed and bounded: of the committed text only the words the
overlap rule can reach are kept, as a list of their own that is written when it changes.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from utterlake.functions.text import WHITE
from utterlake.operators.tokens import collapse_words
from utterlake.params import StabilizerConfig, VadConfig

any_words = re.compile(f"[^{WHITE}]+").findall
#: White space that is no plain space.
other_white = re.compile(f"(?! )[{WHITE}]").search
SEARCH, LONGEST, SHORTEST, MAX_OVERLAP = 2048, 512, 4, 256
#: Words in one item of a list state.
ITEM = 128


def names_of(ddl: str) -> tuple[str, ...]:
    """Column names of a DDL string; types may be nested."""
    flat = re.sub(r"<[^<>]*(?:<[^<>]*>[^<>]*)*>", "", ddl)
    return tuple(c.split()[0] for c in flat.split(", "))


def split_words(text: str) -> list[str]:
    """The words of a text; nearly all texts have plain spaces only."""
    if other_white(text):
        return any_words(text)
    words = text.split(" ")
    return [w for w in words if w] if "" in words else words


class KeyedState(StatefulProcessor):
    """Takes a key's rows in order, sets late rows apart and keeps one typed value and lists of their own.

    ``takes`` are the input columns, ``fields`` those of the value, ``lists`` the lists of words (without spaces, so that many
    go into one item of a list state), and ``schema`` the output.
    With ``idle_ms`` a key that gets no rows for so long is told so by a timer, and its state goes after
    ``ttl_ms`` without a change; both need the job's time mode "ProcessingTime".
    """

    order = "seq"
    takes = ""
    fields = ""
    lists: tuple[str, ...] = ()
    schema = ""
    idle_ms: int | None = None
    ttl_ms: int | None = None
    #: Width of a block of seq that rows are parked under.
    block = 4096

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", f"last long, {self.fields}", self.ttl_ms)
        self.held = {name: handle.getListState(name, "item string", self.ttl_ms) for name in self.lists}
        self.parked = handle.getMapState("parked", "block long", f"rows array<struct<{self.takes}>>", self.ttl_ms)

    def close(self) -> None:
        pass

    def fresh(self) -> dict:
        raise NotImplementedError

    def rows(self, state: dict, row: dict) -> list[dict]:
        raise NotImplementedError

    def idle(self, state: dict, key: int) -> list[dict]:
        """Rows for a key that has been idle for ``idle_ms``."""
        return []

    def load(self) -> dict:
        value = self.value.get()
        if value is None:
            return {"last": None, **self.fresh()}
        state = dict(zip(names_of(f"last long, {self.fields}"), map(plain, value), strict=True))
        for name, held in self.held.items():
            state[name] = [w for x in held.get() for w in x[0].split(" ")] if held.exists() else []
        return state

    def store(self, state: dict, before: dict) -> None:
        self.value.update(tuple(state[c] for c in names_of(f"last long, {self.fields}")))
        for name, held in self.held.items():
            if state[name] is not before[name]:
                words = state[name]
                held.put([(" ".join(words[a : a + ITEM]),) for a in range(0, len(words), ITEM)]) if words else held.clear()

    def blocks(self, frames: Iterator[pd.DataFrame]) -> Iterator[list[dict]]:
        """The rows in order, in lists that fit in memory."""
        first = next(frames, None)
        if first is None:
            return
        second = next(frames, None)
        if second is None:
            columns = list(first.columns)
            yield sorted((dict(zip(columns, r)) for r in zip(*(first[c].tolist() for c in columns))), key=lambda r: r[self.order])
            return
        names = list(names_of(self.takes))
        keys: set[int] = set()
        for frame in (x for part in ([first, second], frames) for x in part):
            for block, own in frame.groupby(frame[self.order] // self.block):
                block = int(block)
                have = list(map(tuple, self.parked.getValue((block,))[0])) if block in keys else []
                own = own.astype(object).where(own.notna(), None)
                self.parked.updateValue((block,), (have + list(own[names].itertuples(index=False, name=None)),))
                keys.add(block)
        for block in sorted(keys):
            rows = [dict(zip(names, r, strict=True)) for r in self.parked.getValue((block,))[0]]
            self.parked.removeKey((block,))
            yield sorted(rows, key=lambda r: r[self.order])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.load()
        before = {name: state[name] for name in self.held}
        for part in self.blocks(rows):
            out: list[dict] = []
            late: list[dict] = []
            for row in part:
                if state["last"] is not None and row[self.order] <= state["last"]:
                    late.append({"stream": row["stream"], "seq": row["seq"]})
                    continue
                state["last"] = int(row[self.order])
                out += self.rows(state, row)
            yield from self.frames(out, late)
        self.store(state, before)
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.idle_ms is None or not self.value.exists():
            return
        state = self.load()
        before = {name: state[name] for name in self.held}
        out = self.idle(state, int(key[0]))
        self.store(state, before)
        yield from self.frames(out, [])

    def frames(self, out: list[dict], late: list[dict]) -> Iterator[pd.DataFrame]:
        columns = list(names_of(self.schema))
        if out:
            yield pd.DataFrame({**{c: [r[c] for r in out] for c in columns}, "late": [False] * len(out)})
        if late:
            yield pd.DataFrame(late).reindex(columns=columns).astype({c: object for c in columns[2:]}).replace({float("nan"): None}).assign(late=True)

    @property
    def output(self) -> str:
        return f"{self.schema}, late boolean"


def plain(value):
    """Rows and arrays of a state value as tuples and lists."""
    if isinstance(value, tuple):
        return tuple(map(plain, value))
    return list(map(plain, value)) if isinstance(value, list) else value


class VadProcessor(KeyedState):
    """Hysteresis speech flag from frame levels."""

    takes = "stream long, seq long, dbfs double, frame_ms double"
    fields = "hot double, quiet double, speech boolean"
    schema = "stream long, seq long, speech boolean"

    def __init__(self, config: VadConfig) -> None:
        self.config = config

    def fresh(self) -> dict:
        return {"hot": 0.0, "quiet": 0.0, "speech": False}

    def rows(self, state: dict, row: dict) -> list[dict]:
        return [{"stream": row["stream"], "seq": row["seq"], "speech": vad_step(self.config, state, row["dbfs"], row["frame_ms"])}]


def vad_step(config: VadConfig, state: dict, dbfs: float, frame_ms: float) -> bool:
    if state["speech"]:
        state["quiet"] = state["quiet"] + frame_ms if dbfs <= config.end_dbfs else 0.0
        if state["quiet"] >= config.min_silence_ms:
            state.update(speech=False, hot=0.0)
    else:
        state["hot"] = state["hot"] + frame_ms if dbfs >= config.start_dbfs else 0.0
        if state["hot"] >= config.min_speech_ms:
            state.update(speech=True, quiet=0.0)
    return state["speech"]


class CreditProcessor(KeyedState):
    """Whole encoder steps from fractional credit, for any minimum per emission."""

    takes = "stream long, seq long, frames long"
    fields = "pending double"
    schema = "stream long, seq long, steps long"

    def __init__(self, steps: int, window: int, minimum: int) -> None:
        self.steps, self.window, self.minimum = steps, window, minimum

    def fresh(self) -> dict:
        return {"pending": 0.0}

    def rows(self, state: dict, row: dict) -> list[dict]:
        state["pending"] += max(0, row["frames"]) * self.steps / self.window
        whole = math.floor(state["pending"] + 1e-9)
        emit = max(self.minimum, whole) if whole > 0 else 0
        state["pending"] = max(0.0, state["pending"] - emit)
        return [{"stream": row["stream"], "seq": row["seq"], "steps": emit}]


def shared(a: list[str], b: list[str]) -> int:
    """Length of the common prefix of two lists, which are compared whole and by halves."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n - 1
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if a[low : mid + 1] == b[low : mid + 1] else (low, mid)
    return low


def common_prefix(lists: list[list[str]]) -> list[str]:
    if not lists:
        return []
    return lists[0][: min(shared(lists[0], other) for other in lists)]


def end_overlap(a: list[str], b: list[str], limit: int) -> int:
    """Largest k up to ``limit`` with the last k of ``a`` equal to the first k of ``b``; only places of b's first word are tried."""
    end = a[-limit:][-len(b) :] if b else []
    n, at = len(end), -1
    for _ in range(end.count(b[0]) if b else 0):
        at = end.index(b[0], at + 1)
        if end[at:] == b[: n - at]:
            return n - at
    return 0


def fence(words: list[str]) -> str:
    return " " + " ".join(words) + " "


def appended(base: list[str], segment: list[str], reach: str | None = None) -> list[str]:
    """The part of a segment that the overlap rule appends to a base; ``reach`` is the fenced end of the base, if known."""
    if not base or not segment:
        return segment
    known = 0
    if len(segment) >= SHORTEST:
        reach = fence(base[-SEARCH:]) if reach is None else reach
        # Containment of a prefix implies that of every shorter one.
        low, high = SHORTEST - 1, min(len(segment), LONGEST)
        if fence(segment[:SHORTEST]) in reach:
            if fence(segment) in reach:
                return []
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if fence(segment[:mid]) in reach else (low, mid - 1)
        known = low if low >= SHORTEST else 0
    return segment[end_overlap(base, segment, MAX_OVERLAP) or known :]


def tail_after(confirmed: list[str], draft: list[str]) -> list[str]:
    if not confirmed or not draft:
        return draft
    cut = max(len(common_prefix([confirmed, draft])), end_overlap(confirmed, draft, 64))
    return draft[cut:]


class StabilizerProcessor(KeyedState):
    """Confirmed and draft text per stream.

    Input rows: stream, seq, action (hop, discard, discard_keep, finish), text, speech, dbfs, frame_ms.
    With a VadConfig the speech flag comes from levels instead of the column. Each event carries the
    segment's confirmed words, the words newly committed to the stream's text, the draft and the
    revision; a stream's text is its committed words in order. A stream idle for ``idle_ms`` is finished.
    """

    takes = "stream long, seq long, action string, text string, speech boolean, dbfs double, frame_ms double"
    fields = (
        "count long, agree array<array<string>>, drafts array<array<string>>, carry array<string>, shown array<string>, draft array<string>, "
        "revision long, run long, stagnant long, finger struct<count: long, shown: array<string>, draft: array<string>>, was boolean, "
        "hot double, quiet double, speech boolean"
    )
    lists = ("tail",)
    schema = (
        "stream long, seq long, part int, is_speech boolean, is_flush boolean, confirmed string, "
        "committed string, committed_words long, hypothesis string, revision long"
    )

    def __init__(self, config: StabilizerConfig | None = None, vad: VadConfig | None = None, collapse: bool = True, idle_ms: int | None = None, ttl_ms: int | None = None) -> None:
        self.config = config or StabilizerConfig()
        self.vad = vad
        self.collapse = collapse
        self.idle_ms, self.ttl_ms = idle_ms, ttl_ms
        self.norms: dict[str, str] = {}
        self.reach: tuple[list[str], str] = ([], "")

    def fresh(self) -> dict:
        return {
            "tail": [], "count": 0, "agree": [], "drafts": [], "carry": [], "shown": [], "draft": [],
            "revision": 0, "run": 0, "stagnant": 0, "finger": None, "was": False,
            "hot": 0.0, "quiet": 0.0, "speech": False,
        }

    def rows(self, s: dict, row: dict) -> list[dict]:
        self.row, self.parts = row, []
        if row["action"] == "hop":
            self.hop(s, row)
        else:
            if row["action"] == "finish":
                self.end_segment(s, speech=False)
            else:
                self.discard(s, keep=row["action"] == "discard_keep")
            s.update(run=0, stagnant=0, finger=None, was=False, hot=0.0, quiet=0.0, speech=False)
        return self.parts

    def idle(self, s: dict, key: int) -> list[dict]:
        return self.rows(s, {"stream": key, "seq": s["last"], "action": "finish"}) if s["agree"] or s["was"] else []

    def hop(self, s: dict, row: dict) -> None:
        c = self.config
        speech = vad_step(self.vad, s, row["dbfs"], row["frame_ms"]) if self.vad else bool(row["speech"])
        decode = speech or not c.decode_only_when_speech
        force = False
        if decode:
            self.update(s, row["text"] or "", speech)
            s["run"] += 1
            force = 0 < c.run_limit <= s["run"]
        if decode and speech:
            finger = (s["count"], s["shown"], s["draft"])
            s["stagnant"] = s["stagnant"] + 1 if finger == s["finger"] else 0
            s["finger"] = finger
            force = force or 0 < c.stagnation_limit <= s["stagnant"]
        else:
            s.update(stagnant=0, finger=None)
        if force:
            self.end_segment(s, speech)
        if c.flush_on_speech_end and not speech and s["was"]:
            self.end_segment(s, False)
        s["was"] = speech

    def update(self, s: dict, text: str, speech: bool) -> None:
        c = self.config
        words = collapse_words(split_words(text), self.norms) if self.collapse else split_words(text)
        if s["carry"] and words and not s["drafts"]:
            s.update(agree=[s["carry"]], drafts=[s["carry"]], carry=[])
        s["agree"] = (s["agree"] + [words])[-max(1, c.agreement) :]
        s["drafts"] = (s["drafts"] + [words])[-max(1, c.draft) :]
        confirmed = common_prefix(s["agree"]) if len(s["agree"]) == max(1, c.agreement) else []
        draft = tail_after(confirmed, common_prefix(s["drafts"]))
        self.show(s, self.past_tail(s, confirmed), draft)
        self.emit(s, speech, False, confirmed, [])

    def past_tail(self, s: dict, words: list[str]) -> list[str]:
        """What is appended to the committed text, whose end is joined once for all rows until it changes."""
        if self.reach[0] is not s["tail"]:
            self.reach = (s["tail"], fence(s["tail"][-SEARCH:]))
        return appended(s["tail"], words, self.reach[1])

    def end_segment(self, s: dict, speech: bool) -> None:
        latest = s["agree"][-1] if s["agree"] else []
        new = self.commit(s, self.past_tail(s, latest), [])
        s.update(agree=[], drafts=[], carry=[], run=0, stagnant=0, finger=None)
        self.emit(s, speech, True, latest, new)

    def discard(self, s: dict, keep: bool) -> None:
        draft: list[str] = []
        if keep:
            # The visible text past what is committed; the committed words themselves are its prefix.
            whole = s["tail"] + s["shown"]
            draft = tail_after(whole, whole + s["draft"])
        new = self.commit(s, s["shown"], draft)
        s.update(agree=[], drafts=[], carry=draft[-self.config.carry_words :])
        self.emit(s, False, False, new, new)

    def show(self, s: dict, shown: list[str], draft: list[str], committed: list[str] | None = None) -> None:
        """Set the visible words past the committed text; a change of the whole text is a revision."""
        now = (committed or []) + shown + draft
        if now != s["shown"] + s["draft"]:
            s["revision"] += 1
        s.update(shown=shown, draft=draft)

    def commit(self, s: dict, new: list[str], draft: list[str]) -> list[str]:
        self.show(s, [], draft, committed=new)
        if new:
            s["tail"] = (s["tail"] + new)[-SEARCH:]
        s["count"] += len(new)
        return new

    def emit(self, s: dict, speech: bool, flush: bool, confirmed: list[str], new: list[str]) -> None:
        self.parts.append(
            {
                "stream": self.row["stream"],
                "seq": self.row["seq"],
                "part": len(self.parts),
                "is_speech": speech,
                "is_flush": flush,
                "confirmed": " ".join(confirmed),
                "committed": " ".join(new),
                "committed_words": s["count"],
                "hypothesis": " ".join(s["draft"]),
                "revision": s["revision"],
            }
        )


class LatencyProcessor(KeyedState):
    """Milliseconds from the arrival of the audio an event needed to the time it was ready.

    Marks (``kind`` 0: the stream's audio up to ``cursor`` has come at ``time``) and events (``kind`` 1: needs audio up to ``cursor``, ready at ``time``) of a
    stream come together. An event takes the first mark at or past its cursor and waits for it where it has not come yet.
    Marks more than ``reach`` behind the latest one are dropped; nothing asks for them any more.
    """

    takes = "stream long, seq long, kind int, cursor long, time double"
    fields = "marks array<struct<cursor: long, time: double>>, waiting array<struct<cursor: long, seq: long, time: double>>"
    schema = "stream long, seq long, ms double"
    order = "place"

    def __init__(self, reach: int) -> None:
        self.reach = reach
        self.takes = f"{type(self).takes}, place long"

    def fresh(self) -> dict:
        return {"marks": [], "waiting": []}

    def rows(self, state: dict, row: dict) -> list[dict]:
        cursor, marks, waiting = int(row["cursor"]), state["marks"], state["waiting"]
        if row["kind"] == 1:
            at = bisect.bisect_left(marks, (max(1, cursor),))
            if at == len(marks):
                bisect.insort(waiting, (max(1, cursor), int(row["seq"]), float(row["time"])))
                return []
            return [self.ready(row["stream"], row["seq"], row["time"], marks[at][1])]
        if marks and cursor <= marks[-1][0]:
            return []
        marks.append((cursor, float(row["time"])))
        del marks[: bisect.bisect_left(marks, (cursor - self.reach,))]
        met = bisect.bisect_left(waiting, (cursor + 1,))
        out = [self.ready(row["stream"], seq, time, marks[-1][1]) for _, seq, time in waiting[:met]]
        del waiting[:met]
        return out

    def ready(self, stream: int, seq: int, time: float, arrived: float) -> dict:
        return {"stream": stream, "seq": int(seq), "ms": max(0.0, (time - arrived) * 1000)}
