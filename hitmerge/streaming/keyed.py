"""Keyed state of streams: the hit of a (query, URL), and an engine's part of a round until its deadline."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from hitmerge import schemas
from hitmerge.operators.hits import pack_signals

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MERGED_HIT = (
    "query_id string, url string, engine array<string>, ranks array<bigint>, title string, snippet string, date string, "
    "score double, score_level string, rerank_score double, authority_score double, source string, card_type string, "
    "lead string, first_ord bigint"
)
ANSWER = (
    "kind string, query_id string, engine string, round_start timestamp, outcome string, in_time bigint, too_late bigint, "
    "latency_ms bigint, arrived_at timestamp, row string"
)
# Texts of which the first that is not empty counts, in list order.
_FIRSTS = ("date", *schemas.SIGNAL_STRINGS)
_ENTRY = ("rank bigint, ord bigint, title string, title_ord bigint, snippet string, snippet_ord bigint, "
          + ", ".join(f"{n} string, {n}_ord bigint" for n in _FIRSTS) + ", " + ", ".join(f"{n} double" for n in schemas.SIGNAL_NUMBERS))


def _columns(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


_FIELDS = _columns(_ENTRY)


def start_keyed(writer: DataStreamWriter, spark: SparkSession, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query whose state lives in the store that keyed state needs; the session's own choice is put back."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(_PROVIDER, before)


def _text(value) -> str:
    return value if isinstance(value, str) else ""


def _number(value) -> float:
    return float(value) if value is not None and value == value else 0.0


def _longer(mine: dict, name: str, text: str, order: int) -> None:
    """Longest text in bytes; of equal ones the first in list order."""
    held = mine[name]
    if held is None or (-len(text.encode()), order) < (-len(held.encode()), mine[f"{name}_ord"]):
        mine[name], mine[f"{name}_ord"] = text, order


def add_sighting(mine: dict | None, row) -> dict:
    """What an engine says of a URL, with one more of its rows; the order in which rows come does not matter."""
    if mine is None:
        mine = dict.fromkeys(_FIELDS)
        mine.update({n: 0.0 for n in schemas.SIGNAL_NUMBERS})
    else:
        mine = dict(mine)
    order, rank = int(row.ord), int(row.rank)
    mine["rank"] = rank if mine["rank"] is None else min(mine["rank"], rank)
    mine["ord"] = order if mine["ord"] is None else min(mine["ord"], order)
    for name in ("title", "snippet"):
        if isinstance(value := getattr(row, name), str):
            _longer(mine, name, value, order)
    for name in _FIRSTS:
        value = _text(getattr(row, name))
        if value and (mine[name] is None or order < mine[f"{name}_ord"]):
            mine[name], mine[f"{name}_ord"] = value, order
    for name in schemas.SIGNAL_NUMBERS:
        mine[name] = max(mine[name], _number(getattr(row, name)))
    return mine


def merged(query_id: str, url: str, entries: dict[str, dict]) -> dict:
    """The hit of a URL from what each engine says of it, engines by name."""
    names = sorted(entries, key=lambda e: e.encode())
    out = {"query_id": query_id, "url": url, "engine": names, "ranks": [entries[e]["rank"] for e in names],
           "lead": names[0], "first_ord": entries[names[0]]["ord"]}
    for name in ("title", "snippet"):
        texts = [entries[e][name] for e in names if entries[e][name] is not None]
        out[name] = max(texts, key=lambda t: len(t.encode())) if texts else None       # the first of the longest
    for name in _FIRSTS:
        out[name] = next((entries[e][name] for e in names if entries[e][name]), None)
    for name in schemas.SIGNAL_NUMBERS:
        out[name] = max(entries[e][name] for e in names)
    return out


class MergedHit(StatefulProcessor):
    """Exact merge of one URL of a query: an entry per engine, whatever the number of its rows; read and written once a batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.engines = handle.getValueState("engines", f"entries array<struct<engine:string,{_ENTRY.replace(' ', ':').replace(',:', ',')}>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.engines.get()
        entries = {e[0]: dict(zip(_FIELDS, e[1:], strict=True)) for e in held[0]} if held is not None else {}
        before = merged(*key, entries) if entries else None
        now = dict(entries)
        for row in rows:
            now[row.engine] = add_sighting(now.get(row.engine), row)
        if now != entries:
            self.engines.update(([(engine, *(entry[f] for f in _FIELDS)) for engine, entry in now.items()],))
        after = merged(*key, now)
        if after != before:
            yield Row(**{c: after[c] for c in _columns(MERGED_HIT)})

    def close(self) -> None:
        pass


def as_hits(changed: DataFrame) -> DataFrame:
    """Hits of ``MERGED_HIT`` columns in the form of the pool, without its order."""
    packed = changed.select("query_id", "url", "engine", F.map_from_arrays("engine", "ranks").alias("positions"), "title", "snippet", "date",
                            F.struct(F.col("lead").alias("engine"), F.col("first_ord").alias("ord")).alias("first_seen"),
                            *[F.col(n).alias(f"__s_{n}") for n in schemas.SIGNAL_FIELDS])
    return pack_signals(packed)


def _answer(*values) -> Row:
    return Row(**dict(zip(_columns(ANSWER), values, strict=True)))


class RoundLedger(StatefulProcessor):
    """One engine's part of a round: rows in time and too late until the timer at the deadline closes it."""

    def __init__(self, limit_ms: int, forget_ms: int):
        self.limit_ms, self.forget_ms = limit_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.part = handle.getValueState("part", "asked boolean, in_time bigint, too_late bigint, last_ms bigint, closed boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.part.get()
        asked, in_time, too_late, last, closed = held if held is not None else (False, 0, 0, None, False)
        deadline, late = None, []
        for row in rows:
            deadline = row.deadline_ms
            if row.row is None:
                asked = True
            elif row.after_ms <= self.limit_ms:
                in_time, last = in_time + 1, max(last or 0, row.after_ms)
            else:
                too_late += 1
                late.append((row.arrived_at, row.row))
        if held is None and deadline is not None:
            self.handle.registerTimer(deadline)
        self.part.update((asked, in_time, too_late, last, closed))
        for at, row in late:
            yield _answer("late", *key, None, None, None, None, at, row)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        asked, in_time, too_late, last, closed = self.part.get()
        if closed:
            self.part.clear()
            return
        self.part.update((asked, in_time, too_late, last, True))
        self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.forget_ms)
        if asked:
            outcome = "ok" if in_time else "late" if too_late else "silent"
            yield _answer("status", *key, outcome, in_time, too_late, last, None, None)

    def close(self) -> None:
        pass
