"""Markup residue: find it, name its kind, and turn it into clean structured text.

Scanning a text gives candidate marks (a tag, an entity, ``**bold**``, ``[[link]]``,
``\\\\command{}`` ...).  A logistic classifier, fitted on texts made here with known marks and
look-alikes, gives each candidate a cost of being and of not being markup of a kind.  For each
kind the candidates of a text, and the lines that hold them, are labelled by a minimum cut: the costs
are the capacities to the two terminals; neighbours in the text, marks and their line, and marks that
belong together (an opening and a closing tag, the ends of an environment), are joined by smoothness
edges that weaken with distance.  The
cut of maximum flow separates marks from content, so a mark that several kinds share goes with
the kind of its surroundings, and a lone look-alike stays content.
"""

from __future__ import annotations

import html
import html.entities
import random
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("html", "markdown", "wiki", "latex")

#: HTML element names (fixed values of the public standard that occur in document bodies).
ELEMENTS = frozenset(
    "a abbr address article aside b blockquote body br caption center cite code col colgroup dd del details dfn div dl dt em figcaption figure font footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta nav ol option p pre q s samp script section select small "
    "span strong style sub summary sup table tbody td textarea tfoot th thead title tr tt u ul var".split()
)

#: Marks by name: the kinds a mark can belong to, and its pattern.  Order decides ties.
MARKS: list[tuple[str, tuple[str, ...], str]] = [
    ("md_fence", ("markdown",), r"^[ \t]*(?:```|~~~)[^\n`]*$"),
    ("html_comment", ("html",), r"<!--(?:[\s\S]*?-->|[^\n]*)"),
    ("html_escaped", ("html",), r"&lt;/?[A-Za-z][^&\n<>]*?&gt;"),
    ("md_autolink", ("markdown",), r"<(?:https?://|mailto:)[^>\s]+>"),
    ("wiki_ref", ("wiki",), r"</?(?:ref|nowiki|gallery|noinclude|references)\b[^<>\n]*>"),
    ("html_tag", ("html",), r"</?[A-Za-z][A-Za-z0-9]*(?:[ \t\n]+[A-Za-z-]+(?:=(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>]+))?)*[ \t]*/?>"),
    ("html_broken", ("html",), r"</?[A-Za-z][A-Za-z0-9]*(?:[ \t]+[A-Za-z-]+=(?:\"[^\"<>\n]*\"?|'[^'<>\n]*'?))+|</[A-Za-z][A-Za-z0-9]*\b"),
    ("html_entity", ("html",), r"&(?:#\d{2,7}|#[xX][0-9A-Fa-f]{2,6}|[A-Za-z][A-Za-z0-9]+);?"),
    ("tex_env", ("latex",), r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\{[^{}\n]*\})?|\\(?:begin|end)\b"),
    ("tex_argument", ("latex",), r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{(?:[^{}]|\{[^{}]*\})*\}"),
    ("tex_open", ("latex",), r"\\[A-Za-z]+\*?\{|\{\\[A-Za-z]+\b"),
    ("tex_command", ("latex",), r"\\[A-Za-z]+\b"),
    ("tex_math", ("latex",), r"\$(?=[^$\n]*[\\^_=])[^$\n\d][^$\n]*\$|\$\$[^$]+\$\$"),
    ("tex_bracket", ("latex",), r"\\[()\[\]]"),
    ("tex_break", ("latex",), r"\\\\"),
    ("tex_escape", ("latex",), r"\\[%&$#_{}]"),
    ("wiki_table", ("wiki",), r"^\{\|[^\n]*$|^\|\}|^\|-[ \t]*$|^\|\+[^\n]*$"),
    ("wiki_cells", ("wiki",), r"^[|!][^\n]*(?:\|\||!!)[^\n]*$"),
    ("wiki_head", ("wiki",), r"^={2,6}[ \t]*[^=\n]+?[ \t]*={2,6}[ \t]*$"),
    ("wiki_link", ("wiki",), r"\[\[[^\[\]\n]+\]\]|\[\[[^\[\]\n]+\]?(?!\])"),
    ("wiki_outer", ("wiki",), r"\[https?://[^\s\]]+(?: [^\]\n]*)?\]"),
    ("wiki_template", ("wiki",), r"\{\{[^{}\n]+\}\}|\{\{[a-z]+(?:\|[^{}\n]*)?"),
    ("wiki_quotes", ("wiki",), r"'{2,5}(?=\S)[^'\n]+?'{2,5}"),
    ("wiki_word", ("wiki",), r"__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION|NOINDEX)__|~~~~"),
    ("md_refdef", ("markdown",), r"^[ \t]*\[[^\]\n]+\]:[ \t]*\S+[^\n]*$"),
    ("md_link", ("markdown",), r"!?\[[^\]\n]*\]\([^)\s]*(?:[ \t]+\"[^\"\n]*\")?\)|!?\[[^\]\n]+\]\((?:https?://|#|/|\.|[\w-]+/)[^)\s]*"),
    ("md_reflink", ("markdown",), r"\[[^\]\n]+\]\[[^\]\n]*\]"),
    ("md_task", ("markdown",), r"^[ \t]*[-*+][ \t]+\[[ xX]\][ \t]"),
    ("md_rule", ("markdown",), r"(?<=\n\n)(?:\*{3,}|-{3,}|_{3,})[ \t]*$"),
    ("md_setext", ("markdown",), r"(?<=[^\s|\-=])[ \t]*\n(?:={3,}|-{3,})[ \t]*$"),
    ("md_row", ("markdown",), r"^\|(?![-}+])[^\n]*\|[ \t]*$"),
    ("md_divider", ("markdown",), r"^\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$"),
    ("md_heads", ("markdown",), r"^#{2,6}[ \t]+(?=\S)|^#{2,6}(?=[A-Za-z])"),
    ("one_hash", ("markdown", "wiki"), r"^#[ \t]+(?=\S)"),
    ("md_bold", ("markdown",), r"(?<![*\w])\*{2,3}(?=[^\s*])[^*\n]*[^\s*]\*{2,3}(?![*\w])"),
    ("md_italic", ("markdown",), r"(?<![*\w])\*(?=[^\s*])[^*\n]*[^\s*]\*(?![*\w])"),
    ("md_strong", ("markdown",), r"(?<![\w_])__(?=[^\s_])[^_\n]+__(?![\w_])"),
    ("md_under", ("markdown",), r"(?<![\w_])_(?=[^\s_])[^_\n]*[^\s_]_(?![\w_])"),
    ("md_strike", ("markdown",), r"~~(?=\S)[^~\n]+~~"),
    ("md_code", ("markdown",), r"(?<!`)`[^`\n]+`(?!`)"),
    ("md_quote", ("markdown",), r"^>[ \t]+(?=\S)"),
]
#: A mark begins with one of these characters, or with the white space that a line begins with.
_SCAN = re.compile(r"(?:(?=[<&\\$|!={\['_~*#>`\-:+\n])|(?=^[ \t])|(?=[ \t]+\n[=-]{3}))(?:" + "|".join(f"(?P<{name}>{pattern})" for name, _, pattern in MARKS) + ")", re.M)
#: Texts without any of these characters cannot hold a mark; tested before scanning.
_MAY = re.compile(r"[<>\\`*_#~{}\[]|&[#A-Za-z]|''|\$[A-Za-z\\$]|^[|!=]|^-{3,}|\n={3,}", re.M)
_KINDS_OF = {name: kinds for name, kinds, _ in MARKS}
#: Names that an entity may have without its semicolon: the standard's own, and common ones of text.
_BARE_ENTITIES = {k for k in html.entities.html5 if not k.endswith(";")} | set("ndash mdash hellip bull rsquo lsquo rdquo ldquo trade euro le ge".split())


def _is_entity(s: str) -> bool:
    """A character reference by number, or by a name of the public standard."""
    name = s[1:].rstrip(";")
    return name[0] == "#" or (f"{name};" in html.entities.html5 if s.endswith(";") else name in _BARE_ENTITIES)


class Mark:
    __slots__ = ("start", "end", "name", "features", "tag")

    def __init__(self, start: int, end: int, name: str, features: list[str], tag: str):
        self.start, self.end, self.name, self.features, self.tag = start, end, name, features, tag


_BRACES = re.compile(r"[{}]")


def _closing(text: str, start: int) -> int:
    """Behind the brace that closes the one before ``start``; 0 if none does."""
    depth = 1
    for m in _BRACES.finditer(text, start):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return m.end()
    return 0


def scan(text: str) -> list[Mark]:
    """Candidates of all kinds in order, each with its features."""
    found = []
    if not text or not _MAY.search(text):
        return found
    pos = 0
    while m := _SCAN.search(text, pos):
        name, s, end = m.lastgroup, m.group(), m.end()
        if name == "tex_open" and s[0] == "\\" and (close := _closing(text, end)) > 0:  # arguments nested deeper than the pattern goes
            name, end = "tex_argument", close
            s = text[m.start() : end]
        if name == "html_entity" and not _is_entity(s):
            pos = m.start() + 1
            continue
        features, tag = [name], ""
        if name in ("html_tag", "html_broken", "html_escaped"):
            tag = re.search(r"[A-Za-z][A-Za-z0-9]*", s[4:] if name == "html_escaped" else s).group().lower()
            features.append(f"{name}:{'element' if tag in ELEMENTS else 'other'}")
        elif name.startswith("tex_") and name not in ("tex_math", "tex_bracket", "tex_break", "tex_escape"):
            before = text[m.start() - 1] if m.start() else " "
            features.append(f"{name}:{'path' if before in ':/\\' or before.isalnum() else 'free'}")
            tag = s[s.find("{") :] if name == "tex_env" else ""
        elif name == "tex_break":
            features.append("break:" + ("end" if text[m.end() : m.end() + 1] in ("", " ", "\n", "[") else "path"))
        elif name == "one_hash":
            after = text[m.end() :].split("\n", 1)[0]
            features.append("hash:" + ("of" if after.startswith("of ") else "upper" if after[:1].isupper() else "lower"))
            features.append("hash:" + ("short" if len(after) < 45 and not after.rstrip().endswith((".", ":", ",")) else "long"))
        elif name in ("md_italic", "md_under", "md_bold", "md_strong", "wiki_quotes", "md_code"):
            features.append(f"{name}:{'short' if len(s) < 60 else 'long'}")
        found.append(Mark(m.start(), end, name, features, tag))
        pos = max(end, m.start() + 1)
        if name in ("tex_argument",):  # what is inside may hold marks of its own
            pos = m.start() + s.index("{") + 1
    return found


def min_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source, in the minimum cut with the fewest of them.

    ``costs[i]`` > 0 is the capacity from the source to ``i``, < 0 that from ``i`` to the sink;
    ``edges`` are undirected.  A node whose own cost outweighs all its edges lies on its side in every
    such cut; its edges then add to its neighbours' costs.  What is left undecided goes through
    maximum flow, one connected part at a time.
    """
    n, c = len(costs), list(costs)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    held = [sum(x.values()) for x in near]
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is not None or -held[i] < c[i] <= held[i]:
            continue
        side[i] = c[i] > held[i]
        for j, w in near[i].items():
            if side[j] is None:
                c[j] += w if side[i] else -w
                held[j] -= w
                queue.append(j)
    for i in range(n):
        if side[i] is None:
            part, stack = {i: 0}, [i]
            while stack:
                for j in near[stack.pop()]:
                    if side[j] is None and j not in part:
                        part[j] = len(part)
                        stack.append(j)
            inner = [(part[u], part[v], w) for u in part for v, w in near[u].items() if u < v and v in part]
            for u, with_source in zip(part, _max_flow([c[u] for u in part], inner)):
                side[u] = with_source
    return side


def _max_flow(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The source's side after a maximum flow by blocking flows in level graphs."""
    n = len(costs)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(u: int, v: int, forth: float, back: float) -> None:
        out[u].append(len(to))
        to.append(v)
        room.append(forth)
        out[v].append(len(to))
        to.append(u)
        room.append(back)

    for i, c in enumerate(costs):
        if c > 0:
            add(source, i, c, 0.0)
        elif c < 0:
            add(i, sink, -c, 0.0)
    for i, j, w in edges:
        add(i, j, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        tried, path, u = [0] * (n + 2), [], source
        while True:
            if u == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                full = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                u = to[path[full] ^ 1]
                del path[full:]
                continue
            while tried[u] < len(out[u]):
                e = out[u][tried[u]]
                if room[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    break
                tried[u] += 1
            if tried[u] < len(out[u]):
                path.append(out[u][tried[u]])
                u = to[path[-1]]
            elif path:
                u = to[path.pop() ^ 1]
                tried[u] += 1
            else:
                break


SMOOTH, NEAR, PAIRED, WITHIN = 1.2, 400.0, 2.5, 0.3


def _blocks(text: str, marks: list[Mark]) -> tuple[list[list[str]], list[int], list[tuple[int, int]]]:
    """The lines that hold marks, as features of each, which one each mark begins in, and their places."""
    rows, of, places = [], [], []
    at, start, end = -1, -1, -1
    for m in marks:
        if m.start >= end:
            start, at = text.rfind("\n", 0, m.start) + 1, at + 1
            end = text.find("\n", m.start) + 1 or len(text) + 1
            places.append((start, end))
            rows.append([0, 0])
        rows[at][0] += 1
        rows[at][1] += min(m.end, end) - m.start
        of.append(at)
    features = []
    for (count, covered), (a, b) in zip(rows, places):
        line = text[a:b].rstrip()
        features.append([f"block:{min(count, 3)}", f"covered:{int(4 * covered / max(1, len(line)))}", f"ended:{line.endswith(('.', '!', '?', ':'))},{min(count, 3)}"])
    return features, of, places


def _edges(marks: list[Mark]) -> list[tuple[int, int, float]]:
    edges, opened = [], {}
    for i, m in enumerate(marks):
        if i:
            gap = max(0, m.start - marks[i - 1].end)
            edges.append((i - 1, i, SMOOTH * float(np.exp(-gap / NEAR))))
        if m.tag:
            if m.tag in opened:
                edges.append((opened.pop(m.tag), i, PAIRED))
            else:
                opened[m.tag] = i
    return edges


def label(text: str, weights: dict[str, dict[str, float]] | None = None) -> list[tuple[Mark, str]]:
    """The marks of a text that are markup, each with its kind."""
    marks = scan(text)
    if not marks:
        return []
    weights = weights or classifier()
    chosen: dict[int, tuple[float, str]] = {}
    for kind in KINDS:
        own = [i for i, m in enumerate(marks) if kind in _KINDS_OF[m.name]]
        if not own:
            continue
        w = weights[kind]
        costs = [w[""] + sum(w.get(f, 0.0) for f in marks[i].features) for i in own]
        nodes = [marks[i] for i in own]
        if all(c > 0 for c in costs):
            kept = [True] * len(own)
        elif all(c <= 0 for c in costs):
            kept = [False] * len(own)
        else:  # marks, then the lines that hold them
            lines, of, places = _blocks(text, nodes)
            b, n = weights["block:" + kind], len(nodes)
            of_lines = [b[""] + sum(b.get(f, 0.0) for f in fs) for fs in lines]
            edges = _edges(nodes) + [(i, n + k, WITHIN) for i, k in enumerate(of)] + [(n + k, n + k + 1, WITHIN * float(np.exp(-(places[k + 1][0] - places[k][1]) / NEAR))) for k in range(len(lines) - 1)]
            kept = min_cut(costs + of_lines, edges)[:n]
        # a shared mark goes to the kind with the most evidence around it
        evidence = sum(c for c, m in zip(costs, nodes) if len(_KINDS_OF[m.name]) == 1 and c > 0)
        for i, keep in zip(own, kept):
            if keep and (i not in chosen or evidence > chosen[i][0]):
                chosen[i] = (evidence, kind)
    return [(marks[i], kind) for i, (_, kind) in sorted(chosen.items())]


# --- the classifier and the texts it is fitted on ------------------------------------------

_TOPICS = "rent ledger survey harbour notice ledger orchard copper valley offer tariff clause letter budget".split()
#: Sentences that look like markup and are none.
LOOKALIKES = [
    "Write <your name> and <team> here.", "Type <client id> first.", "a < b and c > d hold.", "Tick [x] or [ ] below.", "As noted [sic] in [4] (see 2).", "Costs marked * vary; ** by ruling.",
    "Take a = b * 3 * c here.", "Call snake_case_name or _private once.", "Open plan_v3_final.pdf now.", "File D:\\data\\item\\ref is locked.", "Share \\\\host\\begin\\open is mapped.", "Choose {this} now.",
    "# of rooms: 3, # of floors: 1.", "Level #3 applies.", "Smith & Sons; both agree.", "It rose 4% & fell.", "Use A|B or C|D.", "Paid $300 or $400.", "a | b | c", "x_1 and y_2 differ.", "5 < 7 > 2", "<effective date>", "<amount due> is open.",
    "# of copies = 2", "# of applicants: 2", "Path E:\\section\\textbf is old.", "Form <n/a> ok.", "<please sign>", "Enter <date> twice.", "<office> only.",
]


def _made(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A text with known marks: its kind's marks and some look-alikes, as spans."""
    word = lambda: rng.choice(_TOPICS)
    words = lambda n: " ".join(word() for _ in range(n))
    n = rng.randint
    bank = {
        "html": [lambda: f"<p>{words(4)}</p>", lambda: f"<{(t := rng.choice('b i em strong span u code td li h2 h3 div'.split()))}>{words(2)}</{t}>", lambda: f'<a href="/{word()}">{word()}</a>', lambda: "<br>", lambda: "<br/>", lambda: "<!-- note -->", lambda: "&nbsp;", lambda: "&amp;", lambda: f"&#{n(100, 9000)};", lambda: "&nbsp", lambda: f"&lt;p&gt;{word()}&lt;/p&gt;", lambda: f"<p class='{word()}", lambda: f'<div id="{word()}">', lambda: "<ul><li>" + word() + "</li></ul>", lambda: "<table><tr><td>" + word() + "</td></tr></table>", lambda: f"<H2>{word()}</H2>", lambda: "</span"],
        "markdown": [lambda: f"\n{'#' * n(1, 5)} {word().title()}\n", lambda: f"**{words(2)}**", lambda: f"*{words(2)}*", lambda: f"_{words(2)}_", lambda: f"__{words(2)}__", lambda: f"[{word()}](docs/{word()}.md)", lambda: f"`{word()} = {word()}`", lambda: f"\n```\n{word()}\n```\n", lambda: f"\n> {words(4)}\n", lambda: f"~~{words(3)}~~", lambda: f"\n- [ ] {words(2)}\n", lambda: f"\n| {word()} | {word()} |\n|---|---|\n| {word()} | {word()} |\n", lambda: f"\n{word().title()}\n{rng.choice('-=') * n(4, 12)}\n", lambda: f"<https://{word()}.example/>", lambda: f"[{word()}][{n(1, 9)}]", lambda: f"\n[{n(1, 9)}]: /{word()}.md\n", lambda: "\n\n***\n\n"],
        "wiki": [lambda: f"\n{'=' * (k := n(2, 4))} {word().title()} {'=' * k}\n", lambda: f"[[{word()}]]", lambda: f"[[{word()}|{words(2)}]]", lambda: f"'''{words(2)}'''", lambda: f"''{words(2)}''", lambda: f"{{{{{word()}|{word()}}}}}", lambda: f"\n{{| class=\"{word()}\"\n|-\n| {word()} || {word()}\n|}}\n", lambda: "\n__TOC__\n", lambda: f"[https://{word()}.example {word()}]", lambda: f"\n# {words(2)}\n# {words(3)}\n", lambda: "[[Category:" + word() + "]]", lambda: "<ref>" + word() + "</ref>"],
        "latex": [lambda: f"\\section{{{word()}}}", lambda: f"\\textbf{{{words(2)}}}", lambda: f"\\begin{{itemize}}\n\\item {words(2)}\n\\end{{itemize}}", lambda: f"${word()}_{{t}} \\leq {n(1, 90)}$", lambda: f"{n(1, 90)}\\% ", lambda: f"\\[ \\frac{{{word()}}}{{{word()}}} \\]", lambda: f"\\cite{{{word()}}}", lambda: f"{{\\bf {word()}}}", lambda: f"{word()} & {word()} \\\\", lambda: f"\\S~{n(1, 9)} \\& \\S~{n(1, 9)}", lambda: f"\\footnote{{{words(2)}}}", lambda: f"\\emph{{{words(3)}}}", lambda: "\\( x \\)", lambda: "\\item " + word(), lambda: "\\\\"],
    }
    text, spans = "", []
    kind = rng.choice(KINDS + ("none", "none"))
    for _ in range(n(1, 8)):
        text += words(n(2, 12)).capitalize() + ". "
        if kind != "none" and rng.random() < 0.7:
            piece = rng.choice(bank[kind])()
            spans.append((len(text), len(text) + len(piece), kind))
            text += piece + rng.choice([" ", " ", "\n"])
        if rng.random() < (0.5 if kind == "none" else 0.15):
            text += rng.choice(["", "\n"]) + rng.choice(LOOKALIKES) + rng.choice([" ", "\n"])
    return text, spans


@lru_cache(maxsize=2)
def classifier(texts: int = 3000, seed: int = 9) -> dict[str, dict[str, float]]:
    """Logistic weights by kind and feature ("" is the bias), of marks and of the lines ("block:" and
    the kind) that hold them, fitted by gradient descent."""
    rng = random.Random(seed)
    rows: dict[str, list[tuple[list[str], int]]] = {k: [] for kind in KINDS for k in (kind, "block:" + kind)}
    for _ in range(texts):
        text, spans = _made(rng)
        marks = scan(text)
        meets = lambda start, end, kind: int(any(a < end and start < b and k == kind for a, b, k in spans))
        for m in marks:
            for kind in _KINDS_OF[m.name]:
                rows[kind].append((m.features, meets(m.start, m.end, kind)))
        for kind in KINDS:
            features, _, places = _blocks(text, [m for m in marks if kind in _KINDS_OF[m.name]])
            rows["block:" + kind] += [(fs, meets(a, b, kind)) for fs, (a, b) in zip(features, places)]
    found = {}
    for kind, data in rows.items():
        names = sorted({f for fs, _ in data for f in fs})
        at = {f: i for i, f in enumerate(names)}
        x = np.zeros((len(data), len(names) + 1))
        y = np.array([label_ for _, label_ in data], dtype=float)
        for i, (fs, _) in enumerate(data):
            x[i, [at[f] for f in fs]] = 1
        x[:, -1] = 1
        w = np.zeros(len(names) + 1)
        for _ in range(400):
            p = 1 / (1 + np.exp(-x @ w))
            w -= 2.0 * (x.T @ (p - y) / len(y) + 1e-4 * w)
        found[kind] = {**{f: float(w[i]) for f, i in at.items()}, "": float(w[-1])}
    return found


# --- clean text ---------------------------------------------------------------------------

_BLOCKS = frozenset("p div br tr table ul ol dl section article blockquote header footer hr caption tbody thead".split())


def _html(s: str, tag: str) -> str:
    closing = s.startswith("</") or s.startswith("&lt;/")
    if re.fullmatch(r"h[1-6]", tag):
        return "\n" if closing else "\n" + "#" * int(tag[1]) + " "
    if tag in ("li", "dt", "dd"):
        return "" if closing else "\n- "
    if tag in ("td", "th"):
        return " | " if closing else ""
    if tag == "pre":
        return "\n```\n"
    if tag in ("code", "kbd", "samp"):
        return "`"
    return "\n" if tag in _BLOCKS else ""


def _tex(s: str) -> str:
    name = re.match(r"\\([A-Za-z]+)", s)
    name = name.group(1) if name else ""
    body = s[s.find("{") + 1 : -1] if s.endswith("}") and "{" in s else ""
    if name in ("section", "chapter", "part"):
        return f"\n# {body}\n"
    if name in ("subsection", "subsubsection", "paragraph"):
        return f"\n{'#' * (2 + name.count('subsub') + (name == 'paragraph'))} {body}\n"
    if name in ("cite", "ref", "label", "pageref", "eqref", "usepackage", "documentclass"):
        return ""
    if name == "footnote":
        return f" ({body})"
    if name in ("frac", "mathrm", "sqrt", "text"):
        return s  # a formula stays a formula
    return body


def _replacement(m: Mark, kind: str, s: str) -> str | None:
    """What a mark becomes; None keeps it."""
    name = m.name
    if name in ("html_tag", "html_broken", "html_escaped"):
        return _html(s, m.tag)
    if name == "html_entity":
        return html.unescape(s if s.endswith(";") else s + ";").replace("\u00a0", " ")
    if name in ("html_comment", "wiki_ref", "wiki_word", "md_refdef", "md_rule", "md_divider"):
        return ""
    if name in ("md_bold", "md_italic"):
        return s.strip("*")
    if name in ("md_strong", "md_under"):
        return s.strip("_")
    if name == "md_strike":
        return s.strip("~")
    if name in ("md_link", "md_reflink"):
        return s.lstrip("!")[1:].split("]")[0]
    if name == "md_autolink":
        return s[1:-1]
    if name == "md_task":
        return "- "
    if name == "md_quote":
        return ""
    if name == "md_row":
        return " | ".join(c.strip() for c in s.strip().strip("|").split("|"))
    if name == "wiki_head":
        level = len(s) - len(s.lstrip("="))
        return "#" * max(1, level - 1) + " " + s.strip("= \t")
    if name == "wiki_link":
        inner = s.strip("[]")
        return "" if inner.lower().startswith(("category:", "file:")) else inner.split("|")[-1]
    if name == "wiki_outer":
        return s[1:-1].split(" ", 1)[-1]
    if name == "wiki_template":
        return ""
    if name == "wiki_quotes":
        return s.strip("'")
    if name == "wiki_table":
        return ""
    if name == "wiki_cells":
        return " | ".join(c.strip() for c in re.split(r"\|\||!!", s[1:]))
    if name == "one_hash" and kind == "wiki":
        return "- "
    if name == "tex_escape":
        return s[1:]
    if name == "tex_break":
        return "\n"
    if name == "tex_bracket":
        return "$" if s[1] in "()" else "$$"
    if name == "tex_env":
        return "\n```\n" if "verbatim" in s or "lstlisting" in s else "$$" if re.search(r"equation|align|math", s) else "\n"
    if name == "tex_argument":
        return _tex(s)
    if name in ("tex_open", "tex_command"):
        return "\n- " if s.startswith("\\item") else "\u00a7" if s == "\\S" else "" if name == "tex_open" or s[1:] in ("maketitle", "newpage", "noindent", "par", "hline", "bf", "it", "em", "centering") else None
    return None


def clean(text: str | None, weights: dict[str, dict[str, float]] | None = None) -> str | None:
    """Clean text: headings as ``# ``, items as ``- ``, table cells split by `` | ``, code in
    backticks or fences, formulas between dollar signs; all other marks are gone.  Null stays
    null; a text without markup comes back unchanged."""
    if not text:
        return text
    touched = False
    while True:  # marks inside the argument of another come out one by one, each time from a shorter text
        marks, length = label(text, weights), len(text)
        parts, at, changed = [], 0, False
        for m, kind in marks:
            if m.start < at:
                continue
            new = _replacement(m, kind, text[m.start : m.end])
            if new is None or new == text[m.start : m.end]:
                continue
            parts += [text[at : m.start], new]
            at, changed = m.end, True
        if not changed:
            break
        text, touched = "".join(parts) + text[at:], True
        if len(text) >= length:
            break
    if not touched:
        return text
    text = re.sub(r"[ \t]+\n", "\n", re.sub(r" \| *(?=\n|$)", "", text))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def kinds_of(text: str | None) -> list[str]:
    """Kinds of markup that a text holds, in the order of ``KINDS``."""
    held = {kind for _, kind in label(text)} if text else set()
    return [k for k in KINDS if k in held]


def markup(df: DataFrame, id_col: str, text_col: str, weights: dict | None = None, cleaned: bool = True) -> DataFrame:
    """``row_id``, ``kinds`` (array) and ``clean_text`` (null unless ``cleaned``) of every row.

    Null and empty texts have no kinds and stay as they are; repeated rows are all kept; other
    columns are not read.  No shuffle.
    """
    weights = weights or classifier()
    source = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, texts = [], []
            for t in batch.column(1).to_pylist():
                held = {k for _, k in label(t, weights)} if t else set()
                kinds.append([k for k in KINDS if k in held])
                texts.append(None if not cleaned else clean(t, weights) if held else t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.list_(pa.string())), pa.array(texts, pa.string())], names=["row_id", "kinds", "clean_text"])

    return source.mapInArrow(run, f"row_id {source.schema['k'].dataType.simpleString()}, kinds array<string>, clean_text string")
