import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from skyloom.llm import queries as Q
from skyloom.llm import repair as R

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
WHITE = " \t\n\x0b\x0c\r"


def hurt(rows):
    for conv, turn, role, text in rows:
        space = lambda v: " " if v is None else str(v)
        role, text = space(role), space(text)
        d = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        if d:
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            yield from [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)


def least(rows, damage=True):
    """Every edit sequence by plain recursion: (cost, audit, repaired)."""
    out = {}
    every = {r[0] for r in rows}
    after = list(hurt(rows)) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    for conv in every:
        mine = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults, seen = [], set()
        for _, _, role, text in mine:
            solid = text.rstrip(WHITE)
            faults.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

        @cache
        def best(k, state, inserted, mine=mine, faults=faults, step=step):
            found = [(0, "", ())] if k == len(mine) and state in ("", "a") else []
            if inserted < 2:
                for role in ("user", "assistant"):
                    if role[0] in step[state] and (x := best(k, role[0], inserted + 1)):
                        found.append((x[0] + 3, "I" + x[1], ((role, ""), *x[2])))
            if k < len(mine):
                _, _, role, text = mine[k]
                if x := best(k + 1, state, 0):
                    found.append((x[0] + 4, "D" + x[1], x[2]))
                if faults[k] not in ("b", "d"):
                    more = 3 * (faults[k] == "t")
                    if role[:1] in step[state] and (x := best(k + 1, role[:1], 0)):
                        found.append((x[0] + more, "K" + x[1], ((role, text), *x[2])))
                    for given in ("user", "assistant"):
                        if given[0] in step[state] and (x := best(k + 1, given[0], 0)):
                            found.append((x[0] + 3 + more, "R" + x[1], ((given, text), *x[2])))
            return min(found, key=lambda x: x[:2], default=None)

        for k in range(len(mine), -1, -25):  # so that the recursion stays flat
            for s in step:
                best(k, s, 0)
        cost, audit, repaired = best(0, "", 0)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[2][:1] for r in mine]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out[conv] = (conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, sha)
    return out


def made(rng, conv, n, roles=("system", "user", "assistant", "assistant", "user", "tool", "", None, "ux")):
    texts = ("Yes.", "No!", "cut", " ", "", None, "So? \n", "a" * 50, "Well.", "Right.")
    return [(conv, rng.choice([None, k, k, k + rng.randint(0, 3)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"text {k}{rng.choice('.! ')}") for k in range(n)]


SCHEMA = "conv_id long, turn long, role string, text string, at string, cost double"


def frame(spark, rows, n=3):
    return spark.createDataFrame([(*r, "clash", 1.0) for r in rows], SCHEMA).repartition(n)


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in Q.queries()["op12_repair"](spark, SF).collect()}
    assert got == least(rows)


def test_made_conversations(spark):
    rng = random.Random(11)
    rows = [r for conv in range(120) for r in made(rng, conv, rng.randint(1, 14))]
    rows += [(None, 0, "user", "who?"), (None, None, None, None), (500, None, "user", "Hi."), (501, -(1 << 62), "user", "a."), (501, 1 << 62, "assistant", "b."), *rows[:40]]
    rows += [(600 + k, k, "user", "one row") for k in range(60)]  # some lose it
    df = frame(spark, rows)
    want = least(rows)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in R.repair_report(R.damaged(df), df).collect()}
    assert got == want and any(not v[7] for v in want.values()) and {c for v in want.values() for c in v[7]} == set("DIKR")
    assert R.repair_report(R.damaged(df.where("conv_id < 0")), df.where("conv_id < 0")).count() == 0


@pytest.fixture
def ranges(spark):
    """Partitions stay as many as asked for, so that a conversation spreads over several."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_long_conversations_in_segments(spark, ranges):
    rng = random.Random(2)
    rows = made(rng, 1, 700) + made(rng, 2, 30) + [(3, k, ("user", "assistant")[k % 2], f"Say {k}.") for k in range(400)] + [(4, 5, "user", "same.")] * 90
    df = frame(spark, rows, 5)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in R.repair_report(df, df).collect()}
    assert R.placed(df).where("conv_id = 1").select("pid").distinct().count() > 2
    assert got == least(rows, damage=False)


def test_edits_give_the_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Go on."), (1, 1, "user", "What"), (1, 1, "user", "What"), (1, 2, "user", "")]
    edits = [tuple(r) for r in R.repaired(frame(spark, rows))[0].orderBy("at", "nth").select("edit", "times", "cost", "role", "text").collect()]
    assert edits == [("I", 1, 3, "user", ""), ("K", 1, 0, "assistant", "Go on."), ("D", 1, 4, None, None), ("D", 1, 4, None, None), ("D", 1, 4, None, None)]
    assert least(rows, damage=False)[1][6:8] == (15, "IKDDD")


def test_segments_and_checkpoints_do_not_matter():
    rng = random.Random(4)
    for _ in range(300):
        rows = [(rng.choice("suax"), rng.random() < 0.8, rng.random() < 0.3, rng.choice([0, 0, 0, 1, 2])) for _ in range(rng.randint(1, 40))]
        cut = rng.randint(0, len(rows))
        whole = list(R.walk(rows, 0, R.END, True))
        v = R.END
        for r in reversed(rows[cut:]):
            v = R.before(v, *r)
        m = R.matrix(rows[cut:])
        assert v == tuple(min(m[t][s] + R.END[t] for t in range(4)) for s in range(4))
        head = list(R.walk(rows[:cut], 0, v, False)) if cut else [(-1, "", 0, None, 0)]
        tail = list(R.walk(rows[cut:], head[-1][2], R.END, True)) if cut < len(rows) else None
        if tail:
            assert "".join(e * n for _, e, n, *_ in head[:-1] + tail[:-1]) == "".join(e * n for _, e, n, *_ in whole[:-1])
