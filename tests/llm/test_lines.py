"""A line's features: cheap to have, and what they were when each was counted letter by letter."""

import random
import re
from collections import Counter

from skein.llm import scan

ODD = ["CAPS AND CAPS ONLY", "ÉTÉ À LA PLAGE ÇA VA", "Ünder Ärger Öfter kommt", "ALL CAPS but Not Quite ALL", "VERſION 2", "Revİsion rev. 3", "REV 7 of it", "(Some (Title (Words Here", "†he co|d m0rning|", "1 234 of 56", "xii", "- item", "a | b | c", "€5 — 7%", " x y", "ß ẞ ǅ Ǆ ⅷ Ⅷ", "[12]", "`code` AB-12", "rn vv cc 007"]


def counted(lines, i, before, repeated, shouted):
    """The features that have shortcuts, in full."""
    s = lines[i].strip()
    words = s.split()
    letters = [c for c in s if c.isalpha()]
    upper = sum(c.isupper() for c in letters) / (len(letters) or 1)
    long_words = [w for w in words if len(w) > 2 and any(c.isalpha() for c in w)]
    title = sum(w.lstrip("(")[:1].isupper() for w in long_words) / (len(long_words) or 1)
    number = bool(scan._NUMBER_LINE.match(s))
    kind = "number" if number else "other" if shouted else "caps" if upper > 0.85 and len(long_words) > 2 else "title" if title > 0.8 and len(long_words) > 2 else "other"
    return {f"kind={kind}", f"again={min(2, repeated[key(s)] - 1)},{kind}", f"money={bool(re.search('[€£$%]', s))},{kind}", f"version={bool(re.search(r'(?i)rev[.] ?[0-9]|version', s))},{kind}", f"roman={bool(scan._ROMAN.match(s))},{number}"}


def key(line):
    s = re.sub(r"\s+", " ", re.sub(r"\d+", "0", line.strip().lower()))
    return s.translate(str.maketrans("|!@†", "llat")).replace("vv", "w").replace("rn", "m").replace("c", "e").replace("0", "o")


def shouted(text):
    if sum(map(str.isupper, text)) > 3 * sum(map(str.islower, text)):
        return True
    words = [w for w in text.split() if w[0].isalpha()]
    return len(words) > 30 and sum(w[0].isupper() for w in words) > 0.9 * len(words)


def test_features_against_counting():
    rng = random.Random(12)
    pages = [scan._made_page(rng)[0] for _ in range(150)] + [ODD, [x.upper() for x in ODD], [x.title() for x in ODD * 3]]
    pages += [[" ".join(rng.choice(["Word", "word", "WORD", "Été", "1"]) for _ in range(rng.randint(1, 40)))] for _ in range(200)]
    for lines in pages:
        assert scan._shouted("\n".join(lines)) == shouted("\n".join(lines))
        repeated = Counter(key(x) for x in lines if x.strip())
        for i, before, after in scan._filled(lines):
            assert scan._line_key(lines[i]) == key(lines[i])
            for loud in (False, True):
                assert counted(lines, i, before, repeated, loud) <= set(scan.line_features(lines, i, before, after, 2, 4, repeated, loud))


def test_features_are_named_once(monkeypatch):
    model, named, names = scan.line_model(), [], scan._line_names
    monkeypatch.setattr(scan, "_line_names", lambda values: named.append(values) or names(values))
    for n in range(200):  # other words, the same looks
        scan.label_lines([f"the w{n} garden was long and wide.", f"the river ran by the window {n} times."], 0, 0, Counter(), model)
    assert len(named) <= 4
