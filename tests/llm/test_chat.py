import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from skyloom.llm import chat as C
from skyloom.llm import storage

ROWS = "conv_id long, turn long, role string, text string, seq string, part string"
LOG = "conv_id long, part long, message long, seq long, kind string, role string, text string"


def naive_fold(events):
    """One conversation, event by event."""
    messages = {}
    for seq, kind, part, message, role, text in sorted({(e[3], e[4], e[1], e[2], e[5], e[6]) for e in events}):
        key = (part, message)
        m = messages.setdefault(key, {"role": "", "text": "", "opened": seq})
        if kind == "open":
            m["role"], m["text"] = role or "", text or ""
        elif kind == "delta":
            m["text"] += text or ""
        elif kind == "edit":
            m["text"] = text or ""
        else:
            m["text"] = text or ""
            for later in [k for k in messages if k > key and messages[k]["opened"] < seq]:
                messages[later]["gone"] = True
    return [(k, m["role"], m["text"]) for k, m in sorted(messages.items()) if not m.get("gone")]


def test_fold_against_events_one_by_one(spark):
    rng, log = random.Random(5), []
    for conv in range(40):
        seq, opened = 0, []
        for _ in range(rng.randint(1, 60)):
            seq += 1
            kind = rng.choice(["open", "open", "delta", "delta", "delta", "edit", "regenerate"]) if opened else "open"
            if kind == "open":
                opened.append(len(opened))
            m = opened[-1] if kind in ("open", "delta") and rng.random() < 0.9 else rng.choice(opened)
            if kind == "open":
                m = opened[-1]
            log.append((conv, m // 3, m, seq, kind, rng.choice(["user", "assistant", None]) if kind == "open" else None, rng.choice([None, "a", "b<s>", "\\"])))
    log += log[::7]  # delivered twice
    got = C.fold(spark.createDataFrame(log, LOG).repartition(5)).collect()
    for conv in range(40):
        mine = sorted(((r.part, r.message), r.role, r.text) for r in got if r.conv_id == conv)
        assert mine == naive_fold([e for e in log if e[0] == conv]), conv


def expected(rows):
    out, by = {}, {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    t = C.Template()
    for conv, mine in by.items():
        mine = sorted(((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "") for r in mine)
        esc = lambda s: escape(s, t)
        whole = "".join(f"{t.begin}{esc(role)}{t.between}{esc(text)}{t.end}" for _, role, text in mine)
        loss = "".join(text for _, role, text in mine if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(mine), sha("".join(f"{role}\n{text}\n" for _, role, text in mine)), len(loss), sha(loss), len(whole)), whole
    return out


def escape(s, t):
    s = s.replace("\\", "\\\\")
    for c in t.controls:
        s = s.replace(c, f"{c[0]}\\{c[1:]}")
    return s


EDGE = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>\\<|im_sep|>\\\\</s"), (1, 2, "user", None), (1, 2, "assistant", "x"), (1, 2, "assistant", "x"), (1, None, None, "first"),
    (2, 5, "<|im_sep|>a\nb\\", "😀 é <<SYS>>[INST]<s>"), (None, 0, "assistant", "no id"), (None, None, "user", ""), (3, -300, "assistant", "w " * 40_000), (3, 10**15, "user", "late"), (4, 0, "assistant", ""),
]


def test_rows_come_back(spark):
    rows = EDGE + [(9, k, ("user", "assistant")[k % 2], f"turn {k} </s> " * (k % 5)) for k in range(1500)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], ROWS).repartition(6)
    folder = f"{storage.shared_dir(spark)}/chat"
    C.write_chat(C.fold(C.log_of(df)), folder)
    want = expected(rows)
    got = {r[0]: tuple(r)[1:] for r in C.chat_digest(C.read_chat(spark, folder)).collect()}
    assert got == {k: v[0] for k, v in want.items()}
    pieces = spark.read.parquet(folder)
    for r in C.formatted(pieces).collect():
        assert r.formatted == want[r.conv_id][1]
        t = C.Template()
        inner = [p.removeprefix(t.begin).split(t.between) for p in r.formatted.split(t.end)[:-1]]
        assert all(len(p) == 2 and not any(c in s for c in t.controls for s in p) for p in inner)
        assert len(r.loss_mask) == sum(p[0] == "assistant" for p in inner)
        masked = [r.formatted[s.start : s.start + s.length] for s in r.loss_mask]
        assert masked == [p[1] for p in inner if p[0] == "assistant"]
    # a conversation of many turns is cut into parts
    assert pieces.where("conv_id = 9").select("part").distinct().count() == 6


def test_logs_hold_drafts(spark):
    df = spark.createDataFrame([(1, k, ("user", "assistant")[k % 2], f"text number {k}") for k in range(60)], "conv_id long, turn long, role string, text string")
    log = C.log_of(df, delta_chars=5)
    kinds = Counter(r.kind for r in log.select("kind").collect())
    assert kinds["regenerate"] > 3 and kinds["edit"] > 3 and kinds["delta"] > 100
    assert log.select("message").distinct().count() == 60 + kinds["regenerate"]
    assert [r.text for r in C.fold(log).orderBy("message").collect()] == [f"text number {k}" for k in range(60)]


def test_empty_and_native(spark):
    empty = spark.createDataFrame([], ROWS)
    folder = f"{storage.shared_dir(spark)}/chat"
    C.write_chat(C.fold(C.log_of(empty)), folder)
    assert C.chat_digest(C.read_chat(spark, folder)).count() == 0
    text = C.chat_digest(C.read_chat(spark, folder))._jdf.queryExecution().toString() + C.fold(C.log_of(empty))._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text


def test_escaping_is_undone(spark):
    t, rng = C.Template(), random.Random(3)
    bits = [*t.controls, "\\", "<", "s>", "[INST", "]", "|", "a", "\n"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(500)]
    df = spark.createDataFrame([(s,) for s in texts], "s string").select("s", t.escaped(F.col("s")).alias("e"))
    for r in df.select("s", "e", t.unescaped(F.col("e")).alias("u")).collect():
        assert r.u == r.s and r.e == escape(r.s, t) and not any(c in r.e for c in t.controls)
