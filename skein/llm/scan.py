"""Noise in text from scanned pages: an averaged-perceptron character editor.

The editor predicts an operation for each character: keep it, replace it, delete it, insert a
character after it, or, for a hyphen that ends a line, join the line with the next: without the
hyphen, with it, or not at all (the hyphen belongs to its word).  It is trained on the
corpus's own lexicon, corrupted by a table of look-alikes; its features are the characters around, what
mixture of letters, digits and signs they are, and which operations would make a word of the
lexicon.  A second perceptron of the same kind labels whole lines as text, list item, running
header or page number, from their shape, their place on the page and how often the page's file
repeats them.  At a line's start the editor predicts whether its first character is a misread bullet.
All are linear models over named features, averaged over all updates.  One thing is left to rules:
whether a line that no hyphen ends goes on after a space or a line break (``_paragraphs``).

Words repeat, so the editor's operations are remembered by word: characters beyond the word do
not enter the features of a replacement.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOISE_KINDS = ("hyphen_break", "misread", "running_header", "page_number")
#: What is seen -> what may have been there (a table of look-alike characters; fixed values).
LOOKALIKES = {
    "|": "l", "!": "l", "1": "l", "0": "o", "5": "s", "@": "a", "†": "t", "c": "e", "q": "g", "8": "b", "6": "b", "9": "g", "i": "l", "€": "e", "$": "s", "¢": "c", "3": "e",
    "rn": "m", "cl": "d", "ii": "u", "vv": "w", "li": "h", "nn": "m", "ri": "n", "m": "rn", "d": "cl", "h": "li", "w": "vv",
}
_SIGNS = frozenset("|!@†€$¢")
_TOKEN = re.compile(r"[^\W_](?:[^\W_]|[|!@†€$¢](?=[^\W_]))*[|†]?|[|†@](?=[a-z]{3})(?:[^\W_]|[|!@†€$¢](?=[^\W_]))+")
_HYPHEN = "-‐¬­"
_BROKEN = re.compile(rf"[^\W\d_][{_HYPHEN}][ \t]*$")
BULLETS = frozenset("oe«©•·°¤»*")
_PROPER = frozenset("*•·")
#: A word belongs to the lexicon if at least this share of the texts have it ...
LEXICON_SHARE = 2e-4
#: ... and no word that looks like it is so many times more common.
OUTSHONE = 25


class Perceptron:
    """A multi-class perceptron whose weights are averaged over all updates."""

    def __init__(self) -> None:
        self.weights: dict[str, dict[str, float]] = {}

    def best(self, features: Iterable[str], classes: Iterable[str]) -> str:
        scores = dict.fromkeys(classes, 0.0)
        for f in features:
            for c, w in self.weights.get(f, {}).items():
                if c in scores:
                    scores[c] += w
        return max(scores, key=scores.get)

    def train(self, rows: list[tuple[list[str], str, list[str]]], rounds: int = 4, seed: int = 3) -> "Perceptron":
        """Rows are (features, the right class, the classes to choose from)."""
        rng, rows, step = random.Random(seed), list(rows), 0
        total: dict[tuple[str, str], float] = defaultdict(float)
        since: dict[tuple[str, str], int] = defaultdict(int)
        for _ in range(rounds):
            rng.shuffle(rows)
            for features, right, classes in rows:
                step += 1
                guess = self.best(features, classes)
                if guess == right:
                    continue
                for f in features:
                    known = self.weights.setdefault(f, {})
                    for c, by in ((right, 1.0), (guess, -1.0)):
                        total[f, c] += (step - since[f, c]) * known.get(c, 0.0)
                        since[f, c] = step
                        known[c] = known.get(c, 0.0) + by
        for f, known in self.weights.items():
            for c in known:
                known[c] = (total[f, c] + (step - since[f, c]) * known[c]) / max(1, step)
        return self


# --- characters ----------------------------------------------------------------------------


def _edits(word: str) -> list[tuple[int, str, str]]:
    """(place, seen, right) wherever a look-alike occurs in a lower-case word."""
    found = []
    for i, ch in enumerate(word):
        for n in (1, 2):
            seen = word[i : i + n]
            if len(seen) == n and seen in LOOKALIKES:
                found.append((i, seen, LOOKALIKES[seen]))
                if seen in ("|", "1", "!"):
                    found.append((i, seen, "i"))
    return found


def repairs(word: str, lexicon: dict[str, int] | set[str]) -> list[tuple[str, tuple[tuple[int, str, str], ...]]]:
    """Lexicon words that one or two look-alikes turn a lower-case word into, the fewest first."""
    edits = _edits(word)
    single, double = [], []
    for n, (i, seen, right) in enumerate(edits):
        one = word[:i] + right + word[i + len(seen) :]
        if one in lexicon:
            single.append((one, (edits[n],)))
        for j, seen2, right2 in edits[n + 1 :] if not single else ():
            if j >= i + len(seen):
                two = word[:i] + right + word[i + len(seen) : j] + right2 + word[j + len(seen2) :]
                if two in lexicon:
                    double.append((two, ((i, seen, right), (j, seen2, right2))))
    return single or double


def _operations(word: str, edits: Iterable[tuple[int, str, str]]) -> list[str]:
    """Edits as an operation for each character: K, R:x (replace), D (delete), I:x (insert after)."""
    ops = ["K"] * len(word)
    for i, seen, right in edits:
        ops[i] = f"R:{right[0]}" if right[0] != seen[0] else "K"
        for k in range(1, len(seen)):
            ops[i + k] = "D"
        if len(right) > len(seen):
            ops[i] = f"I:{right}"
    return ops


def _char_features(word: str, i: int, options: dict[int, str], known: bool) -> list[str]:
    ch, before, after = word[i], word[i - 1] if i else "^", word[i + 1] if i + 1 < len(word) else "$"
    shape = lambda c: "a" if c.isalpha() else "0" if c.isdigit() else c
    return [
        "bias", f"c={ch}", f"b={before}{ch}", f"a={ch}{after}", f"t={before}{ch}{after}", f"s={shape(before)}{shape(ch)}{shape(after)}",
        f"known={known}", f"fix={options.get(i, '-')}", f"fix={options.get(i, '-')[:1]},{known}", f"n={min(len(word), 6)},{i in options}",
    ]


def _classes(word: str, i: int) -> list[str]:
    found = {"K"}
    for n in (1, 2):
        seen = word[i : i + n]
        if seen in LOOKALIKES:
            found.update(_operations(seen, [(0, seen, LOOKALIKES[seen])])[:1])
        if seen in ("|", "1", "!"):
            found.add("R:i")
    if i and word[i - 1 : i + 1] in LOOKALIKES:
        found.add("D")
    return sorted(found)


#: Line ends at a hyphen: J joins without it, H joins and keeps it, S is no broken word.
JOINS = ["J", "H", "S"]
_SOFT = "¬\xad"
_ENDING = re.compile(rf"([^\W\d_]+)([{_HYPHEN}])[ \t]*$")
_OPENING = re.compile(r"[^\W\d_]+")
#: Words after which a suspended compound goes on, and made words for a corpus without a lexicon (fixed values).
_LINKS = "and or to but nor as und oder bis et ou y o e i oraz lub".split()
_PREFIXES = "pre post sub non anti multi re semi co self short long low high two three mid inter micro macro".split()
_MADE = "harvest meter garden valley river window cable engine ticket museum orchard tunnel lantern basket compass ladder payment document information account statement".split()


def _case(word: str) -> str:
    return "-" if not word else "U" if len(word) > 1 and word.isupper() else "T" if word[0].isupper() else "l"


def _join_features(line: str, after: str | None, gap: bool, lexicon) -> list[str]:
    """Of a line whose end matches ``_ENDING``; ``after`` is the next filled line, ``gap`` a blank between."""
    end = _ENDING.search(line)
    left, mark = end.group(1), end.group(2)
    s = (after or "").strip()
    begin = _OPENING.match(s)
    right = begin.group() if begin else ""
    l, r = left.lower(), right.lower()
    known = f"{l in lexicon},{r in lexicon},{l + r in lexicon}" if right else f"{l in lexicon}"
    alone = len(line.split()) == 1 or (len(line.split()) == 2 and bool(_LIST.match(line)))
    kind = "none" if not s else "list" if _LIST.match(s) else "hyphen" if len(s.split()) == 1 and _ENDING.search(s) else "word" if right else "digit" if s[0].isdigit() else "other"
    case = _case(left) + _case(right)
    link = r in _LINKS and s[begin.end() : begin.end() + 1] not in tuple(_HYPHEN)  # not that of buy-to-let
    return [
        "bias", f"known={known}", f"whole={bool(right) and l + r in lexicon}", f"case={case}", f"case,known={case},{known}", f"soft={mark in _SOFT}", f"link={r if link else '-'}", f"link={link},{l + r in lexicon}",
        f"next={kind}", f"next,alone={kind},{alone}", f"list={bool(_LIST.match(line))},{kind},{alone}", f"gap={gap},{case}", f"n={min(len(left), 4)},{kind}", f"next,known={kind},{l in lexicon}",
    ]


def _join_classes(after: str | None) -> list[str]:
    """Without the hyphen only letters can follow."""
    return JOINS if not after or _OPENING.match(after.strip()) else JOINS[1:]


def _made_ends(rng: random.Random, pool: list[str], lexicon, count: int) -> list[tuple[list[str], str, list[str]]]:
    """Ends of corrupted lines, and of lines whose hyphen is their own."""
    rows = []
    long = [w for w in pool if len(w) > 4] or _MADE
    pick = lambda k: " ".join(rng.choice(pool) for _ in range(k))
    for _ in range(count):
        mark, lead, trail = rng.choice("------‐"), pick(rng.randint(2, 8)) + " ", " " + pick(rng.randint(1, 6))
        kind, words, gap = rng.random(), lexicon, rng.random() < 0.05
        if kind < 0.45:  # a broken word, known or not
            word = rng.choice(long)
            at = rng.randint(2, len(word) - 2)
            if rng.random() < 0.1:
                mark = rng.choice(_SOFT)
            left, right, label = word[:at], word[at:], "J"
            p = rng.random()
            if p < 0.1:
                left, right = left.upper(), right.upper()
            elif p < 0.25:
                left = left.capitalize()
            if rng.random() < 0.15:
                lead = ""
            if rng.random() < 0.05:
                lead = "- " + lead
            if rng.random() < 0.25:
                words = ()
            after = None if rng.random() < 0.1 else right + trail
            lead = lead if after or lead else pick(3) + " "
        elif kind < 0.68:  # a compound broken at its hyphen
            left, right, label = rng.choice(pool), rng.choice([w for w in rng.sample(pool, min(5, len(pool))) if w not in _LINKS] or _MADE), "H"
            if rng.random() < 0.3:
                left = rng.choice(_PREFIXES)
            if (left + right).lower() in lexicon:
                continue
            p = rng.random()
            if p < 0.35:
                left, right = left.capitalize() if p < 0.25 else left, right.capitalize()
            elif p < 0.4:
                left, right = left.upper(), right.upper()
            elif p < 0.5:
                right = str(rng.randint(1, 99))
            elif p < 0.6:
                right = rng.choice(_LINKS) + "-" + right
            if rng.random() < 0.05:
                words = ()
            after = right + trail
        elif kind < 0.84:  # a suspended compound
            left, label = rng.choice(_PREFIXES + [rng.choice(pool)]), "S"
            after = rng.choice(_LINKS[:8] if rng.random() < 0.8 else _LINKS) + trail
        else:  # a list entry, or the last word before other text
            left, label = rng.choice(_PREFIXES + [rng.choice(pool)]), "S"
            lead = rng.choice(["", "", "- ", "* ", f"{rng.randint(1, 20)}. "])
            bullet = lead if lead and not lead[0].isdigit() else f"{rng.randint(2, 21)}. " if lead else ""
            after = rng.choice([bullet + rng.choice(_PREFIXES) + "-", bullet + rng.choice(_PREFIXES) + "-", (bullet or "- ") + pick(2), None])
        rows.append((_join_features(lead + left + mark, after, gap, words), label, _join_classes(after)))
    return rows


#: Operations at a line's start whose first character may be a misread bullet.
BULLET_CLASSES = ["R", "K"]
_BULLET_START = re.compile(r"[ \t]*(\S)[ \t]+(?=[^\W\d_])")


def _bullet_features(lines: list[str], i: int) -> list[str]:
    s = lines[i].strip()
    sign, rest = s[0], s[1:].split()
    stop = s.endswith((".", ",", ";", ":", "?", "!"))
    size = "1-3" if len(rest) < 4 else "4-6" if len(rest) < 7 else "7-11" if len(rest) < 12 else "12+"
    kind = "letter" if sign.isalpha() else "mark"
    near = []
    for j in (i - 1, i + 1):
        t = lines[j].strip() if 0 <= j < len(lines) else ""
        item = len(t) > 3 and t[1] == " " and (t[0] in BULLETS or t[0] in "-")
        near.append("none" if not t else "same" if item and t[0] == sign else "item" if item or _LIST.match(t) else "open" if t[-1] not in ".!?:;" else "colon" if t[-1] == ":" else "closed")
    return [
        "bias", f"sign={sign}", f"kind={kind},{size}", f"kind={kind},{size},{stop}", f"near={near[0]},{near[1]}", f"before={near[0]},{kind},{size}", f"after={near[1]},{kind},{size}", f"stop={stop},{kind}",
        f"case={rest[0][:1].isupper() if rest else False},{kind},{size}", f"long={len(s) > 70},{kind}", f"list={'same' in near or 'item' in near},{kind},{stop}",
    ]


def _made_bullets(rng: random.Random, pool: list[str], count: int) -> list[tuple[list[str], str, list[str]]]:
    """Lists whose bullets were misread, and lines that begin with such a character of their own."""
    rows = []
    words = lambda a, b: " ".join(rng.choice(pool) for _ in range(rng.randint(a, b)))
    prose = lambda: words(5, 11) + rng.choice(["", "", ".", ",", ";"])
    misread = sorted(BULLETS - _PROPER)
    for _ in range(count):
        if rng.random() < 0.6:  # a list, all or some of its bullets misread, or one item between other lines
            alone = rng.random() < 0.25
            items = [rng.choice(["cap", "low"]) and (words(1, 7).capitalize() if rng.random() < 0.5 else words(1, 7)) for _ in range(1 if alone else rng.randint(2, 6))]
            sign, some = rng.choice(misread), rng.random() < 0.3
            marks = [(rng.choice([sign, "-"]) if some else sign) for _ in items]
            lines = [prose() if rng.random() < 0.6 else rng.choice([words(1, 4).capitalize() + ":", ""])] + [f"{m} {x}" for m, x in zip(marks, items)] + [rng.choice(["", prose(), prose()])]
            rows += [(_bullet_features(lines, i + 1), "R", BULLET_CLASSES) for i, m in enumerate(marks) if m != "-"]
        else:  # a wrapped sentence, or a note, that begins so
            p = rng.random()
            sign = rng.choice("oe") if p < 0.6 else rng.choice("©°»")
            own = f"{sign} " + (words(7, 14) + rng.choice([".", ",", "", "."]) if p < 0.75 else words(2, 6) + rng.choice([".", ";", ",", ":"]))
            lines = [prose(), own, rng.choice(["", prose()])]
            rows.append((_bullet_features(lines, 1), "K", BULLET_CLASSES))
    return rows


class CharacterEditor:
    """Operations for words; ``lexicon`` maps words to how many texts have them."""

    def __init__(self, lexicon: dict[str, int]):
        self.lexicon = lexicon
        self.longest = max(map(len, lexicon), default=0)
        self.model = Perceptron()
        self.ends = Perceptron()
        self.starts = Perceptron()
        self.known: dict[str, str | None] = {}

    def _options(self, word: str) -> tuple[dict[int, str], bool]:
        known = word in self.lexicon
        if known:
            return {}, True
        found = repairs(word, self.lexicon)
        if not found:
            return {}, False
        _, edits = max(found, key=lambda x: self.lexicon[x[0]])
        ops = _operations(word, edits)
        return {i: op for i, op in enumerate(ops) if op != "K"}, False

    def fit(self, words: int = 2500, seed: int = 1) -> "CharacterEditor":
        """Trains on up to ``words`` lexicon words, each corrupted, left alone, or misspelt."""
        rng = random.Random(seed)
        right_to_seen = [(right, seen) for seen, right in LOOKALIKES.items()] + [("i", "|"), ("i", "1")]
        pool = sorted(w for w in self.lexicon if len(w) > 2 and w.isalpha())
        rows = []
        for _ in range(words if pool else 0):
            word = rng.choice(pool)
            kind = rng.random()
            text, ops = word, ["K"] * len(word)
            if kind < 0.6:
                fits = [(r, s, m.start()) for r, s in right_to_seen for m in re.finditer(re.escape(r), word)]
                if not fits:
                    continue
                right, seen, at = rng.choice(fits)
                text = word[:at] + seen + word[at + len(right) :]
                if text in self.lexicon:
                    continue
                ops = _operations(text, [(at, seen, right)])
            elif kind < 0.75:  # an ordinary misspelling is left alone
                at = rng.randrange(len(word))
                text = word[:at] + word[at + 1 :]
                ops = ["K"] * len(text)
            elif kind < 0.85:  # so are codes
                text = "".join(rng.choice("abcdefghjkmnpqrstuvwxyz0123456789") for _ in range(rng.randint(4, 14)))
                ops = ["K"] * len(text)
            options, known = self._options(text)
            if kind >= 0.6 and options:
                continue
            rows += [(_char_features(text, i, options, known), ops[i], _classes(text, i)) for i in range(len(text))]
        self.model.train(rows)
        self.ends.train(_made_ends(random.Random(seed + 1), pool or _MADE, self.lexicon or frozenset(_MADE), 4 * words), rounds=5)
        self.starts.train(_made_bullets(random.Random(seed + 2), pool or _MADE, words), rounds=5)
        return self

    def bullet(self, lines: list[str], i: int) -> str:
        """The operation at a line's start: R (the bullet ``-`` was read as another character) or K."""
        found = _BULLET_START.match(lines[i])
        if not found or found.group(1) not in BULLETS - _PROPER:
            return "K"
        return self.starts.best(_bullet_features(lines, i), BULLET_CLASSES)

    def join(self, line: str, after: str | None, gap: bool = False) -> str:
        """The operation at a line's end: J, H or S."""
        if not _ENDING.search(line):
            return "S"
        return self.ends.best(_join_features(line, after, gap, self.lexicon), _join_classes(after))

    def edit(self, word: str) -> str | None:
        """The repaired word, or None where every character is kept."""
        if word in self.known:
            return self.known[word]
        if len(self.known) > 300_000:
            self.known.clear()
        lower = word.lower()
        found = None
        # two look-alikes shorten a word by two letters at most: a longer one has no repair
        if 1 < len(lower) <= self.longest + 2 and lower not in self.lexicon and not word.isdigit():
            options, known = self._options(lower)
            if options:
                out = []
                for i in range(len(lower)):
                    op = self.model.best(_char_features(lower, i, options, known), _classes(lower, i))
                    if op == "K":
                        out.append(word[i])
                    elif op[0] == "R":
                        out.append(op[2:].upper() if word.isupper() or (i == 0 and word[1:].islower() and not word[0].islower() and word[0].isalpha()) else op[2:])
                    elif op[0] == "I":
                        out.append(op[2:])
                made = "".join(out)
                # two or three letters are too little to tell unless signs or digits are among them
                if made != word and made.lower() in self.lexicon and (len(made) > 3 or not word.isalpha()):
                    found = made
        self.known[word] = found
        return found


# --- lines ---------------------------------------------------------------------------------

_NUMBER_LINE = re.compile(r"^\W{0,3}\s*(?:p(?:a?[gq]e?)?\.?\s*)?\d{1,4}(?:\s*(?:of|/|von|de)\s*\d{1,4})?\s*\W{0,3}$|^\W{0,2}[ivxl]{1,6}\W{0,2}$", re.I)
_ROMAN = re.compile(r"^[ivxl]{1,6}$")
_CODE = re.compile(r"\b[A-Z]{1,4}-\d{1,5}\b")
_LIST = re.compile(r"^\s*(?:[-*•]|\d{1,3}[.)])\s+\S")


_DIGITS = re.compile(r"\d+")
_SMALL = re.compile("[a-z]+")
_VERSION = re.compile(r"(?i)rev[.] ?[0-9]|version")


@lru_cache(maxsize=10_000)
def _line_key(line: str) -> str:
    """What repeats in a running header: its words without case, digits and look-alikes."""
    s = " ".join(_DIGITS.sub("0", line.lower()).split())
    return s.replace("|", "l").replace("!", "l").replace("@", "a").replace("†", "t").replace("vv", "w").replace("rn", "m").replace("c", "e").replace("0", "o")


def _small(text: str) -> int:
    """A lower bound, cheap to have, of the small letters in a text."""
    return sum(map(len, _SMALL.findall(text)))


def _shouted(text: str) -> bool:
    """Whether a whole text is in capitals, or all its words begin with one, so that capitals say nothing about a line of it."""
    small = _small(text)
    if 3 * small < len(text) - small and sum(map(str.isupper, text)) > 3 * sum(map(str.islower, text)):
        return True
    first = "".join([w[0] for w in text.split()])
    if _small(first) > 0.11 * len(first):
        return False
    letters = [c for c in first if c.isalpha()]
    return len(letters) > 30 and sum(map(str.isupper, letters)) > 0.9 * len(letters)


def _capitals(s: str) -> bool:
    """Whether over 0.85 of a line's letters are capitals."""
    if _small(s) > 0.16 * len(s):
        return False
    letters = [c for c in s if c.isalpha()]
    return sum(map(str.isupper, letters)) / (len(letters) or 1) > 0.85


def _names_version(s: str) -> bool:
    if s.isascii():  # beyond, small and capital letters don't pair off
        small = s.lower()
        return "version" in small or "rev." in small and bool(_VERSION.search(s))
    return bool(_VERSION.search(s))


def _filled(lines: list[str]) -> list[tuple[int, str, str]]:
    """(place, the filled line before, the one after) of every filled line; "" where there is none."""
    at = [i for i, x in enumerate(lines) if x.strip()]
    shown = ["", *(lines[i].strip() for i in at), ""]
    return [(i, shown[n], shown[n + 2]) for n, i in enumerate(at)]


def _line_values(lines: list[str], i: int, before: str, after: str, page: int, pages: int, repeated: Counter, shouted: bool = False) -> tuple:
    """What :func:`line_features` puts into words; few lines differ in it."""
    s = lines[i].strip()
    words = s.split()
    blank_before, blank_after = i > 0 and not lines[i - 1].strip(), i + 1 < len(lines) and not lines[i + 1].strip()
    first, last = not before, not after
    ended = not before or before.endswith((".", "!", "?", ":"))
    number = bool(_NUMBER_LINE.match(s))
    kind = "number" if number else "other"
    if not number and not shouted:
        long_words = [w for w in words if len(w) > 2 and (w.isalpha() or any(map(str.isalpha, w)))]
        if len(long_words) > 2:
            kind = "caps" if _capitals(s) else "title" if sum([w.lstrip("(")[:1].isupper() for w in long_words]) / len(long_words) > 0.8 else "other"
    size = "1-3" if len(words) < 4 else "4-15" if len(words) < 16 else "16+"
    place = "only" if first and last else "first" if first else "last" if last else "mid"
    return (
        kind, size, place, number and bool(_ROMAN.match(s)), number, s.endswith((".", ",", ";")), s.endswith((".", ",", ";", ":")), min(2, repeated[_line_key(s)] - 1), first and blank_after, first and page <= 1 and blank_after,
        not ended and after[:1].islower(), blank_before, blank_after, min(s.count(" | "), 3), " | " in before or " | " in after, bool(_CODE.search(s)), bool(_LIST.match(s)), s[:1] in "#<{=*>|`!" or s[:1] == chr(92),
        "€" in s or "£" in s or "$" in s or "%" in s, _names_version(s), "60-" if len(s) < 60 else "140-" if len(s) < 140 else "140+", s[:1].islower(), len(s) > 8, " - " in s or " — " in s, number and s[:1] in "[(",
    )


def _line_names(values: tuple) -> list[str]:
    kind, size, place, roman, number, stop, pause, again, heading, opening, cuts, blank_before, blank_after, bars, bars_near, code, item, mark, money, version, length, lower, long, dashes, bracket = values
    return [
        "bias", f"kind={kind}", f"size={size}", f"kind,size={kind},{size}", f"place={place}", f"kind,place={kind},{place}",
        f"roman={roman},{number}", f"stop={stop}", f"kind,stop={kind},{pause}",
        f"again={again},{kind}", f"heading={heading},{kind}", f"opening={opening},{kind}",
        f"cuts={cuts},{kind}", f"blank={blank_before},{blank_after},{kind}",
        f"bars={bars},{bars_near},{kind}", f"code={code},{kind},{size}",
        f"list={item}", f"mark={mark}", f"money={money},{kind}", f"version={version},{kind}",
        f"length={length},{kind}", f"lower={lower},{long},{number}", f"lower,again={lower},{again},{size}",
        f"dashes={dashes},{kind}", f"bracket={bracket},{place}",
    ]


def line_features(lines: list[str], i: int, before: str, after: str, page: int, pages: int, repeated: Counter, shouted: bool = False) -> list[str]:
    return _line_names(_line_values(lines, i, before, after, page, pages, repeated, shouted))


LINE_CLASSES = ["text", "running_header", "page_number"]


def _made_page(rng: random.Random) -> tuple[list[str], list[str], int, int, Counter]:
    """A page with known lines, as scanners and page layouts produce them."""
    nouns = "harvest meter garden valve river window cable engine ticket museum orchard tunnel lantern basket compass ladder".split()
    w = lambda k: " ".join(rng.choice(nouns) for _ in range(k))
    n = rng.randint
    title = w(n(3, 6) if rng.random() < 0.8 else n(7, 22)).title() + rng.choice(["", "", f" {rng.choice(['AB', 'XY', 'Q', 'DOC'])}-{n(10, 9999)}"])
    firm = w(2).title()
    base = rng.choice([f"{title}", f"{firm} | {title} | For staff only", f"{firm.upper()} — {title}", f"RESTRICTED - {firm} - {title}", f"{title.upper()}", f"{title}   Rev. {n(1, 9)}", f"{title} (version {n(1, 9)}.{n(0, 9)})"])
    header = base.upper() if rng.random() < 0.25 else base
    if rng.random() < 0.15:
        header = "  " + header.replace(" ", "  ", 1)
    k = n(1, 90)
    roman = "i ii iii iv v vi vii viii ix x".split()
    number = rng.choice([f"Page {k}", f"Page {k} of {k + n(0, 30)}", f"p. {k}", f"- {k} -", f"— {k} —", f"{k}", f"[{k}]", f"Pg. {k}/{k + n(0, 20)}", f"page {k}", f"Paqe {k} of {k + 3}", rng.choice(roman), rng.choice(roman)])
    pages, page = rng.choice([(0, 0), (4, n(1, 4)), (6, n(1, 6))])
    lines, labels = [], []

    def put(line: str, label: str = "text") -> None:
        lines.append(line)
        labels.append(label)

    wrapped = rng.random() < 0.75
    if page <= 1 and rng.random() < 0.3:
        put(title)
        put("")
    at_top = pages > 0 and rng.random() < 0.5
    if at_top:
        if rng.random() < 0.6:
            put(header, "running_header")
        if rng.random() < 0.4:
            put(number, "page_number")
    for _ in range(n(2, 9)):
        text = w(n(6, 10) if rng.random() < 0.8 else n(15, 70))
        text = text if rng.random() < 0.1 else text.capitalize()
        if rng.random() < 0.2:
            text += f" {rng.choice('€£$')}{n(100, 99999)}"
        put(text + ("." if not wrapped or rng.random() < 0.3 else ""))
        if wrapped and rng.random() < 0.6:
            put(w(n(5, 9)) + rng.choice(["", ".", ". " + w(2).capitalize()]))
        p = rng.random()
        if p < 0.12:
            if rng.random() < 0.7:
                put(header, "running_header")
            if rng.random() < 0.7:
                put(number, "page_number")
            put(w(n(4, 9)) + ".")
        elif p < 0.18:
            put("")
            put(w(n(1, 2)).title())
            put("")
        elif p < 0.26:
            for _ in range(n(2, 4)):
                put(rng.choice(["- ", "* ", f"{n(1, 30)}. "]) + w(n(1, 4)))
        elif p < 0.33:
            put(" | ".join(w(1).title() for _ in range(n(2, 4))))
            for _ in range(n(2, 4)):
                put(f"{w(2)} | {n(1, 99)}% | {n(1, 90)} days")
        elif p < 0.38:
            put(rng.choice([f"Total: €{n(10, 999)},{n(100, 999)}", f"£{n(10, 999)},{n(100, 999)}", f"{n(1, 90)}.5%.", f"{n(2, 900)} days.", f"## {w(2).title()}", f"=== {w(3).title()} ===", f"AB-{n(10, 9999)}.", f"x_1 = {n(1, 99)}"]))
        elif p < 0.42:
            put("")
        elif p < 0.47:  # text that repeats itself is no header
            put(rng.choice([x for x, kind in zip(lines, labels) if kind == "text" and x] or [text]))
    if pages and not at_top:
        if rng.random() < 0.5:
            put(header, "running_header")
        if rng.random() < 0.7:
            put(number, "page_number")
    repeated = Counter(_line_key(x) for x in (lines if not pages else set(lines)) if x.strip())
    if pages > 1:
        repeated[_line_key(header)] += n(1, 3)
    return lines, labels, page, pages, repeated


@lru_cache(maxsize=2)
def line_model(pages: int = 1200, seed: int = 8) -> Perceptron:
    rng = random.Random(seed)
    rows = []
    for _ in range(pages):
        lines, labels, page, of, repeated = _made_page(rng)
        rows += [(line_features(lines, i, before, after, page, of, repeated), labels[i], LINE_CLASSES) for i, before, after in _filled(lines)]
    return Perceptron().train(rows, rounds=5)




def label_lines(lines: list[str], page: int, pages: int, repeated: Counter, model: Perceptron) -> list[str]:
    found = ["text"] * len(lines)
    shouted = _shouted("\n".join(lines))
    for i, before, after in _filled(lines):
        found[i] = _best_line(model, _line_values(lines, i, before, after, page, pages, repeated, shouted))
    return found


@lru_cache(maxsize=100_000)
def _best_line(model: Perceptron, values: tuple) -> str:
    return model.best(_line_names(values), LINE_CLASSES)


def analyse(text: str, editor: CharacterEditor, model: Perceptron, page: int = 0, pages: int = 0, repeated: Counter | None = None, repair: bool = False) -> tuple[set[str], str]:
    """Kinds of noise in a text or page, and (with ``repair``) the repaired text."""
    lines = text.split("\n")
    if repeated is None:
        repeated = Counter(_line_key(x) for x in lines if x.strip()) if len(lines) > 1 else Counter([_line_key(text)])
    labels = label_lines(lines, page, pages, repeated, model)
    kinds: set[str] = {x for x in labels if x != "text"}
    body: list[str] = []
    text_lines = [i for i, x in enumerate(labels) if x == "text"]
    ends: list[str] = []
    tail = ""  # the first half of a word broken at the end of the line before
    seen = editor.known
    for at, i in enumerate(text_lines):
        line = made = lines[i]
        stripped = line.strip()
        if not stripped:
            body.append(line)
            ends.append("S")
            continue
        if editor.bullet(lines, i) == "R":
            kinds.add("misread")
            made = "- " + stripped[2:]
        join = "S"
        if stripped[-1] in _HYPHEN and _BROKEN.search(stripped):
            after = next((j for j in text_lines[at + 1 :] if lines[j].strip()), None)
            join = editor.join(made.strip(), None if after is None else lines[after], after is not None and text_lines[at + 1] != after)
        broken = join == "J"
        if not broken and not tail:  # most lines: nothing but whole words, most of them looked at before
            strange = False
            for word in _TOKEN.findall(made):
                if (seen[word] if word in seen else editor.edit(word)) is not None:
                    strange = True
                    break
            if not strange:
                if join != "S":
                    kinds.add("hyphen_break")
                body.append(made)
                ends.append(join)
                continue
        words = list(_TOKEN.finditer(made))
        new: list[tuple[int, int, str]] = []
        for n, m in enumerate(words):
            word = m.group()
            if broken and n == len(words) - 1 and m.end() >= len(made.rstrip()) - 1:
                break  # half a word: looked at with its other half
            if n == 0 and tail and m.start() <= len(made) - len(made.lstrip()):
                whole = tail + word
                fixed = None if whole.lower() in editor.lexicon or word[:1].isupper() else editor.edit(whole)
                if fixed is not None:
                    kinds.add("misread")
                    if repair and body and len(fixed) >= len(tail):
                        body[-1] = body[-1].rstrip()[: -len(tail) - 1] + fixed[: len(tail)] + "-"
                        new.append((m.start(), m.end(), fixed[len(tail) :]))
                continue
            fixed = editor.edit(word)
            if fixed is not None:
                kinds.add("misread")
                new.append((m.start(), m.end(), fixed))
        if join != "S":
            kinds.add("hyphen_break")
        tail = words[-1].group() if broken and words else ""
        if repair and new:
            for start, end, fixed in reversed(new):
                made = made[:start] + fixed + made[end:]
        body.append(made)
        ends.append(join)
    return kinds, _paragraphs(body, ends) if repair else ""


def _paragraphs(lines: list[str], ends: list[str]) -> str:
    """Lines joined to paragraphs by the predicted ``ends``: J joins without the hyphen, H keeps it,
    after S comes a space, or a line break at list items, tables and marks."""
    out = ""
    for line, end in zip(lines, ["S", *ends]):
        s = line.strip()
        if not out or out.endswith("\n"):
            out += s if s else "" if out.endswith("\n\n") or not out else "\n"
            continue
        if not s:
            out += "\n\n"
        elif end != "S":
            out = out.rstrip()[:-1] + ("-" if end == "H" else "") + s
        elif _LIST.match(s) or s[:1] in "#|`<=" or " | " in s or _LIST.match(out.rsplit("\n", 1)[-1]) or " | " in out.rsplit("\n", 1)[-1]:
            out += "\n" + s
        else:
            out += " " + s
    return out.strip()


# --- the corpus ----------------------------------------------------------------------------


def word_counts(texts: DataFrame) -> DataFrame:
    """In how many texts (column ``t``) each lower-case word occurs: ``word``, ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        total = 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                total += 1
                counts.update(set(_TOKEN.findall(t)))
            if len(counts) > 500_000:
                yield _count_batch(counts)
                counts.clear()
        counts[""] += total
        yield _count_batch(counts)

    return texts.where("t is not null").select("t").mapInArrow(run, "word string, n bigint").groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n"))


def _count_batch(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def lexicon(texts: DataFrame, share: float = LEXICON_SHARE) -> dict[str, int]:
    """Words that at least ``share`` of all texts have (three texts at least), without those
    that are look-alikes of a much more common one.  Its size is bounded by the words of a text
    over ``share``, however large the corpus is."""
    from ..session import settle

    counts = settle(word_counts(texts), "words")
    total = (counts.where("word = ''").select("n").first() or [0])[0]
    rows = counts.where((F.length("word") > 1) & (F.col("n") >= max(3.0, share * total))).collect()
    found = {r["word"]: r["n"] for r in rows}
    return {w: n for w, n in found.items() if not any(found[x] > OUTSHONE * n for x, _ in repairs(w, found) if x != w)}


def page_noise(df: DataFrame, editor: CharacterEditor, model: Perceptron, repair: bool) -> DataFrame:
    """``k``, ``page_no``, ``kinds`` and ``repaired`` for each page of rows (``k``, ``pages``,
    ``paged``).  Null pages count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers, kinds, texts = [], [], [], []
            for i, (pages, paged) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                repeated = None
                if paged:
                    repeated = Counter(key for p in pages if p for key in {_line_key(x) for x in p.split("\n") if x.strip()})
                for number, p in enumerate(pages, 1 if paged else 0):
                    found, made = analyse(p, editor, model, number, len(pages) if paged else 0, repeated, repair) if p else (set(), p)
                    keys.append(i)
                    numbers.append(number)
                    kinds.append([k for k in NOISE_KINDS if k in found])
                    texts.append(made)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(numbers, pa.int32()), pa.array(kinds, pa.list_(pa.string())), pa.array(texts, pa.string())], names=["k", "page_no", "kinds", "repaired"])

    return df.select("k", "pages", "paged").mapInArrow(run, f"k {df.schema['k'].dataType.simpleString()}, page_no int, kinds array<string>, repaired string")


def scanned(chunks: DataFrame, chunk_id: str, chunk_text: str, files: DataFrame, file_id: str, pages: str, repair: bool = True) -> tuple[DataFrame, DataFrame]:
    """Noise of single texts (page 0) and of the pages of files (from 1).

    Both results have ``row_id``, ``page_no``, ``kinds`` and ``repaired``.  A null or empty text
    or page has no noise; null texts and files without pages give no row; repeated rows are all
    kept; other columns are not read.
    """
    single = chunks.select(F.col(chunk_id).alias("k"), F.col(chunk_text).alias("t")).where("t is not null")
    many = files.select(F.col(file_id).alias("k"), F.col(pages).alias("pages")).where(F.size("pages") > 0)
    texts = single.select("t").unionByName(many.select(F.explode("pages").alias("t")))
    editor = CharacterEditor(lexicon(texts)).fit()
    model = line_model()
    a = page_noise(single.select("k", F.array("t").alias("pages"), F.lit(False).alias("paged")), editor, model, repair)
    b = page_noise(many.withColumn("paged", F.lit(True)), editor, model, repair)
    return a.withColumnRenamed("k", "row_id"), b.withColumnRenamed("k", "row_id")
