import hashlib
from collections import Counter, defaultdict

import pytest

from skyloom.llm import alignment as A
from skyloom.llm import queries as Q

SF = "/root/testdata/sf0.001"
P = pytest.importorskip("public_tokenizers")
FILES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [
    "", "a", " ", "  two  spaces ", "line\nbreak\n\n  x\t\ty", "x\r\ny;\r\n", "a▁b", "é ü ß Ærø", "日本語 と тест ع", "😀 a😀b", "<|endoftext|> and </s> <s>[INST]", "don't 'S we'll I'd",
    "12345 3.14 1e-5", "…“quoted”—dash", "a b c　", "\x00\x01\x1c\x85", "w" * 3000, "é ́x", "​﻿", "�", "tab\tend\t", "\n", "\r", "́", "x" * 47 + " " + "y" * 49,
]


def brute(rows):
    """The contract read plainly: whole texts, sets of ends, all pairs of occurrences that end together."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    tok, sp = Tokenizer.from_file(FILES[0]), SentencePieceProcessor(model_file=FILES[1])
    tok.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in visible}
    for b in range(256):
        if b not in visible:
            byte[chr(256 + len(byte) - len(visible))] = b
    docs, count = [], Counter()
    for doc_id, text in rows:
        a = tok.encode(f" {text}", add_special_tokens=False) if text else None
        ids_a, ids_b = (a.ids, sp.encode(text)) if text else ([], [])
        parts_a = [bytes(byte[c] for c in t) for t in a.tokens] if text else []
        pieces = [sp.id_to_piece(k) for k in ids_b]
        parts_b = [bytes.fromhex(p[3:5]) if sp.is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(ids_b, pieces, strict=True)]
        if not text or b"".join(parts_a) != f" {text}".encode() or b"".join(parts_b) != f" {text}".encode():
            docs.append((doc_id, 0, 0, [], ""))
            continue
        ends = [[sum(map(len, parts[: k + 1])) for k in range(len(parts))] if len(parts) < 50 else list(running(parts)) for parts in (parts_a, parts_b)]
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, links = [], []
        low = 0
        for e in both:
            groups.append("|".join(",".join(str(i) for i, x in zip(ids, en, strict=True) if low < x <= e) for ids, en in zip((ids_a, ids_b), ends, strict=True)) if len(both) < 400 else None)
            low = e
        if len(both) >= 400:
            side = []
            for ids, en in zip((ids_a, ids_b), ends, strict=True):
                by, k = defaultdict(list), 0
                for i, x in zip(ids, en, strict=True):
                    while both[k] < x:
                        k += 1
                    by[k].append(str(i))
                side.append(by)
            groups = [f"{','.join(side[0][k])}|{','.join(side[1][k])}" for k in range(len(both))]
        at = [defaultdict(list), defaultdict(list)]
        for s in (0, 1):
            for i, x in zip((ids_a, ids_b)[s], ends[s], strict=True):
                at[s][x].append(i)
        links = [(i, j) for e in both for i in at[0][e] for j in at[1][e]]
        count.update(links)
        docs.append((doc_id, len(ids_a), len(ids_b), links, ";".join(groups)))
    top = defaultdict(int)
    for (_, j), n in count.items():
        top[j] = max(top[j], n)
    return Counter(
        (d, na, nb, g.count(";") + bool(g), len(ls), sum(count[p] == top[p[1]] for p in ls), sum(count[p] for p in ls), hashlib.sha256(g.encode()).hexdigest() if g else "") for d, na, nb, ls, g in docs
    )


def running(parts):
    at = 0
    for p in parts:
        at += len(p)
        yield at


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def aligned_rows(df):
    return Counter(tuple(r) for r in A.scored(A.saved(A.alignments(df, *FILES)), *FILES).select(COLUMNS).collect())


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = Counter(tuple(r) for r in Q.queries()["op11_token_alignment"](spark, SF).select(COLUMNS).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_odd_texts(spark):
    rows = [*enumerate(ODD), (None, "no id"), (3, "  two  spaces "), (3, "  two  spaces "), (99, None), (100, " ".join(ODD)), (101, " ".join(f"w{k * k % 977}x" for k in range(3000)))]
    df = spark.createDataFrame([(d, t, "clash", b"x") for d, t in rows], "doc_id long, text string, n_a string, links binary")
    want = brute(rows)
    assert aligned_rows(df) == want and aligned_rows(df.repartition(5)) == want


def test_words_give_what_whole_texts_give():
    x = A.aligner(*FILES)
    texts = [t for t in ODD if t] + ["the same words and the same words, again. The\nsame words"]
    want = [x.whole(f" {t}") for t in texts]
    assert x.many(texts) == want and x.many(texts) == want  # from its memory too
    assert x.many([None, ""]) == [None, None]
    assert all(n == len(x.pairs.keys) for n in (len(x.pairs), len(set(x.pairs.keys.tolist()))))


def test_white_space_at_the_end_beside_other_new_words():
    for end in ("  ", " ", "\n", "\n\n", "\u2003 ", "\t \n"):
        for words in ("a  b", "a\n\nb", "  c   d", " \n e"):
            x = A.Aligner(*FILES)
            texts = [f"x{end}", words, f"{words}{end}", end]
            for part in (sorted(texts), sorted(texts, reverse=True)):
                x.memo = {}
                assert x.many(part) == [x.whole(f" {t}") for t in part]
                for order in ([end, "  b", "\n\nb"], ["  b", end, "\n\nb"]):  # whatever the order of a set
                    x.memo = {}
                    x.learn(order)
                    assert all(x.memo[w] == x.whole(w) for w in order)


def test_a_million_line_ends():
    x = A.aligner(*FILES)
    n = 1_200_000
    found = x.many(["a" + "\n" * n])[0]
    assert found[2] == len(x.tok.encode(" a" + "\n" * n, add_special_tokens=False).ids)


def test_memo_starts_anew(monkeypatch):
    monkeypatch.setattr(A, "MEMO", 10)
    x = A.Aligner(*FILES)
    texts = [" ".join(f"word{k}{c}" for k in range(9)) for c in "abcdef"]
    assert [x.many([t])[0] for t in texts] == [x.whole(f" {t}") for t in texts]


def test_groups_are_kept_on_demand_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "Hello there")], "doc_id long, text string")
    r = A.alignments(df, *FILES, groups=True).first()
    assert hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 and r.n_links * 4 == len(r.links)
    assert not aligned_rows(df.where("doc_id < 0"))


def test_common_ends():
    assert A.common_ends([2, 3, 7, 9], [1, 3, 4, 9]) == ([3, 9], [2, 4], [2, 4])
    assert A.common_ends([], []) == ([], [], [])
