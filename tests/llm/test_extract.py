"""Main text: a brute-force version over a parsed tree, pages without names, and what the ratios do."""

import html
import math
import re
from collections import Counter
from html.parser import HTMLParser

import pytest

from skyloom.llm import extract

SF = "/root/testdata/sf0.001"
A = "<p>One sentence here, with marks. And another one, with more.</p><p>A second paragraph, that is as long; it goes on and on.</p>"
PLAIN = html.unescape(re.sub("<[^>]+>", "\n", A)).strip().replace("\n\n", "\n")
BLOCKS = {"p", "h1", "div", "ul", "li", "nav", "article", "footer", "body", "html", "head"}


class Tree(HTMLParser):
    """Text nodes of a page as the test tables have them: (path of tags and classes, elements around, block number, text)."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.stack, self.nodes, self.block, self.made = [], [], 0, 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.block += 1
            if any(t == "p" for t, *_ in self.stack):
                while self.stack[-1][0] != "p":
                    self.stack.pop()
                self.stack.pop()
        if tag not in ("br", "meta"):
            self.made += 1
            name = tag + "".join(f".{v.split()[0]}" for k, v in attrs if k == "class")
            self.stack.append((tag, name, self.made))

    def handle_endtag(self, tag):
        if tag in [t for t, *_ in self.stack]:
            while self.stack[-1][0] != tag:
                self.stack.pop()
            self.stack.pop()
        if tag in BLOCKS:
            self.block += 1

    def handle_data(self, data):
        if not {"head", "script", "style", "title"} & {t for t, *_ in self.stack} and data.strip():
            self.nodes.append(("/".join(n for _, n, _ in self.stack), list(self.stack), self.block, " ".join(data.split())))


def brute_force(page: str) -> str:
    nodes = Tree(page).nodes
    if not nodes:
        return ""
    count, chars, marks, weight = Counter(), Counter(), Counter(), {}
    for path, around, _, text in nodes:
        tags = [t for t, *_ in around]
        count[path] += 1
        chars[path] += len(text)
        marks[path] += sum(c in ".,;:!?…。，、！？；：¿¡" for c in text)
        heading = "h1" in tags
        block = [t for t in tags if t in BLOCKS][-1:]
        weight[path] = math.prod([0.001 for t in tags if t in ("nav", "footer")] + [4 if "article" in tags else 1, 0.02 if "a" in tags and not heading else 1])
        weight[path] *= (1 if block in (["p"], ["h1"], ["li"]) else 0.25) * (0.001 if "ad" in path.replace("/", ".").split(".") else 1)

    def smooth(of):
        out = []
        for k in range(len(nodes)):
            near = [(math.exp(-((j - k) ** 2) / 0.98), of[nodes[j][0]] / count[nodes[j][0]]) for j in range(max(0, k - 3), min(len(nodes), k + 4))]
            out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
        return out

    total = Counter()
    for (path, *_), a, b in zip(nodes, smooth(chars), smooth(marks), strict=True):
        total[path] += math.log1p(a) * (1 + math.log1p(b)) * weight[path]
    score = {p: total[p] / count[p] for p in count}
    each = [score[n[0]] for n in nodes]
    mean = sum(each) / len(each)
    edge = min(math.sqrt(sum((s - mean) ** 2 for s in each) / len(each)), max(each) / 2)
    blocks: dict[int, list] = {}
    for n in nodes:
        blocks.setdefault(n[2], []).append(n)
    worth = {k: sum(score[p] * len(t) for p, _, _, t in b) / sum(len(t) for *_, t in b) for k, b in blocks.items()}
    size = {k: sum(len(t) + 1 for *_, t in b) - 1 for k, b in blocks.items()}
    held = Counter()
    for k, b in blocks.items():
        if worth[k] >= edge:
            for t, _, e in b[0][1]:
                held[e] += size[k] * (t in ("html", "body", "div", "article"))
    strong = sum(size[k] for k in blocks if worth[k] >= edge)
    holder = max(e for e, n in held.items() if n >= 0.9 * strong)
    inside = [k for k, b in blocks.items() if worth[k] >= 0.05 * edge and holder in [e for *_, e in b[0][1]]]
    return "\n".join(" ".join(t for *_, t in blocks[k]) for k in inside)


def neutral(page: str) -> str:
    page = re.sub(r"<(/?)(?:article|nav|footer|main|aside|header|section)\b", r"<\1div", page)
    return re.sub(r"\s(?:class|id|role)=\"[^\"]*\"", "", page)


@pytest.fixture(scope="module")
def pages(spark):
    return [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]


def test_same_as_brute_force(pages):
    assert [extract.main_text(p) for p in pages] == [brute_force(p) for p in pages]


def test_pages_without_names(pages):
    assert sum(extract.main_text(neutral(p)) == extract.main_text(p) for p in pages) >= 0.95 * len(pages)


def test_ratios_decide(pages, monkeypatch):
    want = [extract.main_text(neutral(p)) for p in pages]
    monkeypatch.setattr(extract, "path_scores", lambda nodes, *_: ([1.0] * len(nodes), 1.0))
    off = [extract.main_text(neutral(p)) for p in pages]
    assert sum(a != b for a, b in zip(want, off, strict=True)) > 0.25 * len(pages)


def test_ratios_decide_inside_of_an_article():
    links = "<ul>" + "<li><a href=/>Another page</a></li>" * 5 + "</ul>"
    assert extract.main_text(f"<article><h1>T</h1>{A}{links}</article>") == f"T\n{PLAIN}"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<body><div class="content no-sidebar"><h1>T</h1>{A}</div></body>', f"T\n{PLAIN}"),
        (f'<article><h2 class="section-head">Head</h2>{A}<p class="alert">Beware, this is part of it.</p><ul><li>one<li>two words</ul></article>', f"Head\n{PLAIN}\nBeware, this is part of it.\none\ntwo words"),
        (f"<main><p>Short.</p></main><article>{A * 4}</article>", "\n".join([PLAIN] * 4)),
        (f'<article class="post">{A}<section class="comments"><p>{"I differ, sir. " * 60}</p></section></article>', PLAIN),
        (f'<nav><a href="/">x</a></nav><h1><a href="/t">Title</a></h1><div>{A}</div><footer><p>About us, and more about us. Yes.</p></footer>', f"Title\n{PLAIN}"),
        (f'<form id="f"><div class="menu"><a>x</a> Home page</div><div>{A}</div></form>', PLAIN),
        (f"<article>{A}<aside><p>Aside, as long as it gets. Yes, it does.</p></aside><form><label>Your mail</label></form></article>", PLAIN),
    ],
)
def test_named_and_unnamed_parts(page, text):
    assert extract.main_text(page) == text
