"""Repair of the turn structure of conversations: cheapest edits by bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows read, state): 0 nothing kept, 1 after a system turn, 2 after a user turn, 3 after an
assistant turn. Keep, Rerole and Delete read a row, Insert reads none; a conversation may end in state 0 or 3. One heap
grows from the start and one from the ends; once their least costs sum to more than the best crossing, every crossing of
equal cost is known, and the least concatenated audit among them is taken. Two audits of equal cost that lead to one node
are never one the beginning of the other (only inserts could follow, which cost), so least halves make the least whole.

A conversation is sorted and streamed in one pass, its pattern of turns solved once for all conversations that have the
same. One of very many rows is split instead: its rows are dealt out by range, repeats of texts are found by a Spark
aggregate, pieces of a few hundred rows are solved for every pair of states at their ends, and the tables of the pieces
are joined level by level. Only its digest reads its texts in one task, as a stream: SHA-256 has no parallel form."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitmerge.llm.texts import small
from hitmerge.session import cut_lineage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
AFTER = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}      # state after a kept turn
NEXT = (2, 2, 3, 2)                                                            # state after a turn made to fit
MADE = {2: "user", 3: "assistant"}
LEGAL = {"su", "ua", "au"}
ENDS = (0, 3)
REACH = {0: (0, 1, 2, 3), 1: (1, 2, 3), 2: (2, 3), 3: (2, 3)}
_SPACE = r"[\x20\x09-\x0D]"


SIGNS = "suaxSUAX-"


def _edges(sign: str, s: int):
    """(letter, state, cost) of each edit that reads a row of this sign."""
    yield "D", s, DELETE
    if sign != "-":
        worn = TRUNCATED if sign.isupper() else 0
        if (sign.lower(), s) in AFTER:
            yield "K", AFTER[sign.lower(), s], KEEP + worn
        yield "R", NEXT[s], REROLE + worn


AHEAD = {(sign, s): list(_edges(sign, s)) for sign in SIGNS for s in range(4)}
BEHIND = {(sign, t): [(letter, s, cost) for s in range(4) for letter, to, cost in AHEAD[sign, s] if to == t] for sign in SIGNS for t in range(4)}
MADE_AHEAD = [[("I", NEXT[s], INSERT)] for s in range(4)]
MADE_BEHIND = [[("I", s, INSERT) for s in range(4) if NEXT[s] == t] for t in range(4)]


@lru_cache(1 << 15)
def cheapest(pattern: str, entry: int = 0, ends: tuple = ENDS) -> tuple[int, str] | None:
    """Least cost of the edits that lead from ``entry`` to one of ``ends``, and the least audit of that cost.

    :param pattern: a letter a row: s, u, a or x (any other role), a capital if truncated; - if it must go
    :return: None if no edits lead there
    """
    n = len(pattern)
    there: dict = {(0, entry): (0, "")}
    back: dict = {(n, s): (0, "") for s in ends}
    # At equal cost the node from which a Keep (which costs nothing) may come is settled first, so labels are final when popped.
    ahead, behind = [(0, 0, entry)], [(0, -n, s) for s in ends]
    heapq.heapify(behind)
    best = 0 if n == 0 and entry in ends else None
    done: tuple[set, set] = (set(), set())
    while ahead and behind and (best is None or ahead[0][0] + behind[0][0] <= best):
        forward = ahead[0][0] <= behind[0][0]
        heap, mine, other, closed = (ahead, there, back, done[0]) if forward else (behind, back, there, done[1])
        cost, i, s = heapq.heappop(heap)
        i = abs(i)
        if (i, s) in closed:
            continue
        closed.add((i, s))
        audit = mine[i, s][1]
        if forward:
            read, made, j = (AHEAD[pattern[i], s] if i < n else ()), MADE_AHEAD[s], i + 1
        else:
            read, made, j = (BEHIND[pattern[i - 1], s] if i else ()), MADE_BEHIND[s], i - 1
        for at, edges in ((j, read), (i, made)):
            for letter, t, more in edges:
                if (at, t) in closed:
                    continue
                label = (cost + more, audit + letter if forward else letter + audit)
                known = mine.get((at, t))
                if known is None or label < known:
                    mine[at, t] = label
                    if known is None or label[0] < known[0]:
                        heapq.heappush(heap, (label[0], at if forward else -at, t))
                    if (at, t) in other and (best is None or label[0] + other[at, t][0] < best):
                        best = label[0] + other[at, t][0]
    if best is None:
        return None
    return min((a[0] + back[x][0], a[1] + back[x][1]) for x, a in there.items() if x in back)


def repaired(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[str]:
    """``role:text`` of each turn that the edits leave or make, in order."""
    state = 0
    for letter in audit:
        if letter == "D":
            next(turns)
            continue
        if letter == "K":
            role, text = next(turns)
            state = AFTER[role[0], state]
        else:
            state = NEXT[state]
            role, text = MADE[state], "" if letter == "I" else next(turns)[1]
        yield f"{role}:{text}"


class _Digest:
    """SHA-256 of lines with a newline between them."""

    def __init__(self):
        self.sha, self.joint = hashlib.sha256(), b""

    def add(self, line: str) -> None:
        self.sha.update(self.joint + line.encode("utf-8", "surrogatepass"))
        self.joint = b"\n"


def digest(audit: str, turns: list[tuple[str, str]]) -> str:
    d = _Digest()
    for line in repaired(audit, iter(turns)):
        d.add(line)
    return d.sha.hexdigest()


def damage(turns: DataFrame) -> DataFrame:
    """The turns with faults made by rule, for tests of a repair: by crc32 of ``conv_id:turn`` modulo 20 a row is lost (0), emptied (1),
    robbed of its ``.!?`` (2), repeated (3) or given to the user (4). Nulls are read as one space.

    :param turns: ``conv_id``, ``turn``, ``role``, ``text``; other columns are not read, whatever their names
    :return: these four columns and ``lost``; a lost row stays with its mark, so that its conversation is known
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))), F.lit(20))
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), fault.alias("_fault"))
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_fault") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_fault") == 0).alias("lost"), "_fault")
    again = F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("_again", again).drop("_again", "_fault")


def _sign() -> Column:
    """Letter of a turn, before repeats are known."""
    role = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x")
    whole = F.col("text").rlike(rf"[.!?]{_SPACE}*\z")
    return F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.concat(F.lit("-"), role)).when(whole, role).otherwise(F.upper(role))


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_RESULT = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]


def _solved(rows: list[tuple]) -> tuple:
    """Result of one conversation; rows of (turn, role, text, sign) in order."""
    seen, pattern, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text, sign in rows:
        fault = None
        if sign[0] == "-":
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif sign.isupper():
            fault = "truncated"
        seen.add((role, text))
        if fault:
            count[fault] += 1
        pattern.append(sign if fault in (None, "truncated") else "-")
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
    cost, audit = cheapest("".join(pattern))
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest(audit, [r[1:3] for r in rows])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of a sorted partition, one at a time."""
    def packed(out):
        columns = list(zip(*out, strict=True)) if out else [[]] * 9
        kinds = [kind] + [pa.int64()] * 6 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _RESULT)

    now, name, rows, kind = None, None, [], pa.null()
    for b in small(batches, "text"):
        kind, out = b.schema.field("conv_id").type, []
        for conv, conv_id, turn, role, text, sign, lost in zip(*(b.column(c).to_pylist() for c in (
                "_conv", "conv_id", "turn", "role", "text", "_sign", "lost")), strict=True):
            if conv != now:
                if now is not None:
                    out.append((name, *_solved(rows)))
                now, name, rows = conv, conv_id, []
            if not lost:
                rows.append((turn, role, text, sign))
        yield packed(out)
    if now is not None:
        yield packed([(name, *_solved(rows))])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place of each row in its sorted partition, and whether it repeats the row before it in every part."""
    last, place = None, 0
    for b in batches:
        again = []
        for row in zip(*(b.column(c).to_pylist() for c in ("_conv", "turn", "_name")), strict=True):
            again.append(row == last)
            last = row
        yield pa.RecordBatch.from_arrays([b.column("_conv"), b.column("turn"), b.column("_name"), b.column("_sign"), pa.array(again, pa.bool_()),
                                          pa.array(range(place, place + b.num_rows), pa.int64())], ["_conv", "turn", "_name", "_sign", "again", "place"])
        place += b.num_rows


def _table(pattern: str) -> dict:
    """Cheapest edits of a piece for every state at its beginning and end, and what its neighbours must know."""
    return {(a, b): x for a in range(4) for b in REACH[a] if (x := cheapest(pattern, a, (b,)))}


def _chained(first: dict, then: dict) -> dict:
    out: dict = {}
    for (a, m), (cost, audit) in first.items():
        for (n, b), (more, rest) in then.items():
            if m == n:
                out[a, b] = min(out.get((a, b), (cost + more + 1, "")), (cost + more, audit + rest))
    return out


_TABLE = "_conv string, no long, ends array<struct<a:int,b:int,cost:long,audit:string>>"


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ends = [[{"a": x, "b": y, "cost": c, "audit": t} for (x, y), (c, t) in _table("".join(s["sign"] for s in signs)).items()]
                for signs in b.column("signs").to_pylist()]
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
        yield pa.RecordBatch.from_arrays([b.column("_conv"), b.column("no"), pa.array(ends, kind)], ["_conv", "no", "ends"])


def _folded(fold: int):
    """Tables of consecutive pieces as one."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("no")
        tables = [{(e["a"], e["b"]): (int(e["cost"]), e["audit"]) for e in ends} for ends in group["ends"]]
        while len(tables) > 1:
            tables = [_chained(*tables[i:i + 2]) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
        ends = [{"a": a, "b": b, "cost": c, "audit": t} for (a, b), (c, t) in tables[0].items()]
        return pd.DataFrame({"_conv": [group["_conv"].iloc[0]], "no": [int(group["no"].iloc[0]) // fold], "ends": [ends]})
    return run


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each conversation of a sorted partition: its audit comes first, then its turns, which are not held."""
    now, audit, at, state, d = None, "", 0, 0, _Digest()

    def inserts():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = NEXT[state]
            d.add(f"{MADE[state]}:")
            at += 1

    def packed(out):
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in (0, 1)], ["_conv", "repaired_sha256"])

    for b in small(batches, "text"):
        out = []
        for conv, edits, role, text in zip(*(b.column(c).to_pylist() for c in ("_conv", "audit", "role", "text")), strict=True):
            if edits is not None:
                if now is not None:
                    inserts()
                    out.append((now, d.sha.hexdigest()))
                now, audit, at, state, d = conv, edits, 0, 0, _Digest()
                continue
            inserts()
            letter = audit[at]
            at += 1
            if letter == "K":
                state = AFTER[role[0], state]
                d.add(f"{role}:{text}")
            elif letter == "R":
                state = NEXT[state]
                d.add(f"{MADE[state]}:{text}")
        yield packed(out)
    if now is not None:
        inserts()
        yield packed([(now, d.sha.hexdigest())])


def _long(rows: DataFrame, piece: int, fold: int = 64) -> DataFrame:
    """Results of conversations of very many rows; ``_conv`` names them."""
    kept = rows.where("not lost")
    name = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    order = ["_conv", "turn", "role", "text"]
    dealt = kept.withColumn("_name", name).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(dealt.select("_conv", "turn", "_name", "_sign").mapInArrow(
        _placed, "_conv string, turn long, _name string, _sign string, again boolean, place long").withColumn("part", F.spark_partition_id()))
    first = placed.where("_sign not like '-%'").groupBy("_conv", "_name").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct(F.col("turn").isNotNull().alias("k"), "turn")).alias("first")).where("times > 1")
    repeat = F.col("first").isNotNull() & (F.col("again") | (F.col("first") != F.struct(F.col("turn").isNotNull().alias("k"), "turn")))
    signed = cut_lineage(placed.join(first.drop("times"), ["_conv", "_name"], "left").withColumn(
        "fault", F.when(F.col("_sign").startswith("-"), "blank").when(repeat, "duplicate").when(F.col("_sign") == F.upper("_sign"), "truncated"))
        .withColumn("role", F.lower(F.regexp_replace("_sign", "-", ""))).drop("first"))
    # Pieces of consecutive rows, numbered within their conversation.
    inside = signed.withColumn("block", F.floor(F.col("place") / piece)).groupBy("_conv", "part", "block").agg(F.sort_array(F.collect_list(
        F.struct("place", F.when(F.col("fault").isin("blank", "duplicate"), "-").otherwise(F.col("_sign")).alias("sign"), "role"))).alias("signs"))
    pieces = cut_lineage(inside.withColumn("no", F.expr("row_number() over (partition by _conv order by part, block) - 1").cast("long")))
    tables = cut_lineage(pieces.select("_conv", "no", "signs").mapInArrow(_tables, _TABLE))
    most = tables.agg(F.max("no")).first()[0] or 0
    while most > 0:
        tables = cut_lineage(tables.groupBy("_conv", F.floor(F.col("no") / fold)).applyInPandas(_folded(fold), _TABLE))
        most //= fold
    best = F.array_min(F.transform(F.filter("ends", lambda e: (e["a"] == 0) & e["b"].isin(*ENDS)), lambda e: F.struct(e["cost"], e["audit"])))
    edits = cut_lineage(tables.select("_conv", best.alias("best")).select("_conv", F.col("best.cost"), F.col("best.audit")))
    within = F.aggregate(F.sequence(F.lit(1), F.size("signs") - 1), F.lit(0).cast("long"), lambda n, i: n + (~F.concat(
        F.element_at("signs", i)["role"], F.element_at("signs", i + 1)["role"]).isin(*LEGAL)).cast("long"))
    edges = pieces.select("_conv", "no", F.when(F.size("signs") > 1, within).otherwise(0).alias("n"), F.element_at("signs", 1)["role"].alias("head"),
                          F.element_at("signs", -1)["role"].alias("tail")).withColumn("before", F.expr("lag(tail) over (partition by _conv order by no)"))
    illegal = edges.groupBy("_conv").agg((F.sum("n") + F.count_if(F.col("before").isNotNull() & ~F.concat("before", "head").isin(*LEGAL))).alias("illegal"))
    counts = signed.groupBy("_conv").agg(*(F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")))
    gaps = signed.where("turn is not null").groupBy("_conv", "turn").count().groupBy("_conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    texts = kept.select("_conv", F.lit(None).cast("string").alias("audit"), "turn", "role", "text")
    stream = edits.select("_conv", "audit", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                          F.lit(None).cast("string").alias("text")).unionByName(texts)
    digests = stream.repartition("_conv").sortWithinPartitions("_conv", F.col("audit").isNull(), "turn", "role", "text") \
        .mapInArrow(_streamed, "_conv string, repaired_sha256 string")
    names = rows.groupBy("_conv").agg(F.first("conv_id").alias("conv_id"))
    zero = {c: 0 for c in _COUNTS}
    return names.join(counts, "_conv", "left").join(illegal, "_conv", "left").join(gaps, "_conv", "left").join(edits, "_conv", "left") \
        .join(digests, "_conv", "left").fillna({**zero, "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}).select(*_RESULT)


def repair(turns: DataFrame, long_rows: int = 1000, long_bytes: int = 16 << 20, piece: int = 256) -> DataFrame:
    """Cheapest edits that give each conversation the roles ``(s?(ua)+)?``, with counts of its faults.

    General: the project keeps no conversations of its own. Rows of a conversation are read by ``turn`` (nulls first; of
    equal turns by role, then text). The first fault of a row counts: blank (no character but white space), duplicate (role and
    text of an earlier row), truncated (the last character that is no white space is none of ``.!?``). Keep costs 0, Rerole to
    user or assistant 3, Delete 4 (blank and duplicate rows must go), Insert of an empty user or assistant turn 3; a truncated
    row that stays costs 3 more.

    :param turns: ``conv_id``, ``turn``, ``role``, ``text`` and optionally ``lost`` (a row of which only the conversation counts, so it
        keeps its place in the result); nulls of role and text are read as one space, a null ``conv_id`` is one conversation.
        Other columns are not read, whatever their names
    :param long_rows: conversations of more rows are split over many tasks
    :param long_bytes: so are those of more bytes of text
    :param piece: rows of a piece of such a conversation
    :return: ``conv_id``, ``gaps`` (turns missing between the first and the last), ``blank``, ``duplicate``, ``truncated``, ``illegal`` (neighbours
        whose role initials are not su, ua or au), ``cost``, ``audit`` (initials of the edits, least of all cheapest ones) and
        ``repaired_sha256`` (of the repaired ``role:text``, a newline between them). A conversation of lost rows only has zeros, an
        empty audit and the digest of the empty string. An empty table gives an empty result.
    """
    lost = F.coalesce("lost", F.lit(False)) if "lost" in turns.columns else F.lit(False)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("_conv"), "conv_id",
                        F.col("turn").cast("long").alias("turn"), text("role"), text("text"), lost.alias("lost"))
    signed = rows.withColumn("_sign", _sign())
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
    held = rows.groupBy("_conv").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))
    long = cut_lineage(held.where((F.col("rows") > long_rows) | (F.col("bytes") > long_bytes)).select("_conv"))
    few = long.count()
    short = signed
    if few:
        # A small list goes to every task; a large one is joined by its key.
        mark = F.broadcast(long) if few <= 100_000 else long
        short = signed.join(mark, "_conv", "left_anti")
    out = short.repartition("_conv").sortWithinPartitions("_conv", "turn", "role", "text").mapInArrow(_whole, schema)
    return out.unionByName(_long(signed.join(mark, "_conv", "left_semi"), piece)) if few else out
