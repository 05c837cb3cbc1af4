import hashlib
import itertools
import random
import zlib

from hitmerge.llm import conversations as C

TURNS = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\v\f\r"


def walk(signs):
    """All edit sequences in growing cost are too many; rows in order with the best label of each state are not."""
    edges = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    fit = {0: 2, 1: 2, 2: 3, 3: 2}

    def add(labels, s, label):
        if s not in labels or label < labels[s]:
            labels[s] = label

    def made(labels):
        for _ in range(2):
            for s, (c, a) in list(labels.items()):
                add(labels, fit[s], (c + 3, a + "I"))
        return labels

    now = made({0: (0, "")})
    for sign in signs:
        then = {}
        for s, (c, a) in now.items():
            add(then, s, (c + 4, a + "D"))
            if sign != "-":
                worn = 3 if sign.isupper() else 0
                if s in edges.get(sign.lower(), ()):
                    add(then, edges[sign.lower()][s], (c + worn, a + "K"))
                add(then, fit[s], (c + worn + 3, a + "R"))
        now = made(then)
    return min(now[s] for s in (0, 3) if s in now)


def model(rows):
    """One conversation by plain Python: rows of (turn, role, text), damaged already."""
    rows = sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), r[1].encode(), r[2].encode()))
    seen, signs, n = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        held = text.strip(BLANK)
        fault = "blank" if not held else "duplicate" if (role, text) in seen else "truncated" if held[-1] not in ".!?" else ""
        seen.add((role, text))
        r = role[:1] if role[:1] in ("s", "u", "a") else "x"
        signs += "-" if fault in ("blank", "duplicate") else r.upper() if fault else r
        if fault:
            n[fault] += 1
    turns = {r[0] for r in rows if r[0] is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit = walk(signs)
    lines, i, last = [], 0, "a"
    for e in audit:
        role, text = ("", "") if e == "I" else rows[i][1:]
        i += e != "I"
        if e == "D":
            continue
        if e in "RI":
            role = "assistant" if last == "u" else "user"
        last = role[0]
        lines.append(f"{role}:{text}")
    assert not lines or "".join(x[0] for x in lines).removeprefix("s").replace("ua", "") == ""
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def random_rows(seed, conversations, most):
    rng, rows = random.Random(seed), []
    for c in range(conversations):
        for t in range(rng.randrange(1, most)):
            turn = None if rng.random() < 0.05 else t + rng.randrange(3) - 1
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", "User", "ux"])
            rows.append((c, turn, role, rng.choice(["a.", "b!", "c?\n", "no end", "", " \t", "é…", "same.", "Longer text. "]) + rng.choice(["", "", "x."])))
    return rows


def test_cheapest_edits_against_a_walk_over_rows():
    for n in range(5):
        for p in itertools.product("suaxA-", repeat=n):
            assert C.cheapest("".join(p)) == walk(p)
    rng = random.Random(3)
    for _ in range(500):
        p = "".join(rng.choice("suauauaxSUAX-") for _ in range(rng.randrange(5, 60)))
        assert C.cheapest(p) == walk(p)


def test_tables_of_pieces_join_to_the_whole():
    rng = random.Random(5)
    for _ in range(100):
        p = "".join(rng.choice("suauauaxSUAX-") for _ in range(rng.randrange(1, 40)))
        cut = sorted({0, len(p), *(rng.randrange(len(p) + 1) for _ in range(3))})
        tables = [C._table(p[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
        while len(tables) > 1:
            tables[:2] = [C._chained(*tables[:2])]
        assert min(tables[0][0, e] for e in C.ENDS if (0, e) in tables[0]) == C.cheapest(p)


def test_repair_against_plain_python_whole_and_split(spark):
    rows = random_rows(11, 60, 14) + [(None, 1, "user", "hi."), (None, 2, "assistant", "yes.")]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' as audit", "'y' as place", "1 as part").repartition(5)
    want = {}
    for r in rows:
        want.setdefault(r[0], []).append(r[1:])
    want = {c: model(x) for c, x in want.items()}
    for sizes in ({}, {"long_rows": 4, "piece": 3}, {"long_rows": 0, "piece": 1}, {"long_bytes": 40, "piece": 2}):
        assert {r[0]: tuple(r)[1:] for r in C.repair(df, **sizes).collect()} == want


def test_one_long_conversation(spark):
    rng = random.Random(2)
    rows = [(7, t, "user" if t % 2 else "assistant", f"text {rng.randrange(800)}" + rng.choice([".", ".", ""])) for t in range(1500)]
    got = C.repair(spark.createDataFrame(rows, TURNS).repartition(4), piece=64).collect()
    assert [tuple(r)[1:] for r in got] == [model([r[1:] for r in rows])]


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, 5, "user", "x" * 300_000), (2, 5, "user", "x" * 300_000), (3, 0, "user", "ok."), (3, 0, "assistant", "ok.")]
    got = {r[0]: tuple(r)[1:] for r in C.repair(spark.createDataFrame(rows, TURNS)).collect()}
    assert got == {1: model([(None, " ", " ")]), 2: model([r[1:] for r in rows[1:3]]), 3: model([r[1:] for r in rows[3:]])}
    assert C.repair(spark.createDataFrame([], TURNS)).collect() == []
    text = spark.createDataFrame([("k", 1, "user", "hi.")], TURNS.replace("conv_id long", "conv_id string"))
    assert [r["conv_id"] for r in C.repair(text).collect()] == ["k"]


def test_damage_by_rule(spark):
    rows = [(c, t, "assistant", "A. b! c?") for c in range(40) for t in range(4)] + [(None, None, None, None)]
    got = sorted((tuple(r) for r in C.damage(spark.createDataFrame(rows, TURNS)).collect()), key=str)
    want = []
    for c, t, role, text in rows:
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", " " if text is None else text
        row = (c, t, "user" if f == 4 else role, {1: "", 2: text.translate({46: None, 33: None, 63: None})}.get(f, text), f == 0)
        want += [row] * (2 if f == 3 else 1)
    assert got == sorted(want, key=str) and len({r[4] for r in got}) == 2
    lost = spark.createDataFrame([(9, 1, "user", "hi.", True)], TURNS + ", lost boolean")
    assert [tuple(r) for r in C.repair(lost).collect()] == [(9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert [tuple(r) for r in C.repair(lost, long_rows=0).collect()] == [(9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
