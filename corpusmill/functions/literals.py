"""What a pattern's matches must contain, so that few patterns are tried on a text."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa

_WORD = re.compile(r"(?:\\b|\\s\+| )([a-z0-9]{2,})")


def required_literals(pattern: str) -> list[str]:
    """Texts that every match contains; one empty text if none is certain. Groups and classes count for nothing."""
    runs, depth, k = [""], 0, 0
    while k < len(pattern):
        c = pattern[k]
        step = 2 if c == "\\" else 1
        if c == "[":
            step = pattern.index("]", k + 2) + 1 - k
        after = pattern[k + step : k + step + 1]
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            return [""]
        plain = pattern[k + 1] if c == "\\" and not pattern[k + 1].isalnum() else c if c not in "\\[](){}|.^$?*+" else ""
        if depth or c == ")":
            runs.append("")
        elif plain and after not in ("?", "*", "{"):
            runs[-1] += plain
        elif pattern[k : k + step] not in ("\\b", "^", "$"):  # these have no width
            runs.append("")
        if after == "+":
            runs.append("")
        if c == "{":
            step = pattern.index("}", k) + 1 - k
        k += step
    return list(dict.fromkeys(filter(None, runs))) or [""]


def required_literal(pattern: str) -> str:
    """The longest of them."""
    return max(required_literals(pattern), key=lambda x: (len(x), not x.isalnum()))  # of two letters the rarer: a sign


def required_words(pattern: str) -> list[str]:
    """Beginnings of words that every match contains, of two letters at least; none if no word is certain."""
    out = []
    for m in _WORD.finditer(pattern) if required_literal(pattern) else ():
        before, word = pattern[: m.start()], m[1]
        plain = re.sub(r"\[[^]]*\]|\\.", "", before)
        if before.endswith("[") or plain.count("(") > plain.count(")"):
            continue  # in a class, or in a group, which may be an alternative
        if pattern[m.end() : m.end() + 1] in ("?", "*", "{"):
            word = word[:-1]
        if len(word) > 1:
            out.append(word)
    return list(dict.fromkeys(out))


def longest_of(words: set[str]) -> str:
    """A pattern of the longest of the words that begins at a place; letters that words share are compared once."""
    rests: dict[str, set[str]] = {}
    for w in filter(None, words):
        rests.setdefault(w[0], set()).add(w[1:])
    branches = "|".join(c + longest_of(rest) for c, rest in sorted(rests.items()))
    return f"(?:{branches}){'?' if '' in words else ''}" if branches else ""


class Matcher:
    """Finds which of many patterns match a text. A pattern is tried only where all its required words begin in the text
    and its required literals stand there; one search finds the words of all patterns, however many there are."""

    def __init__(self, patterns: tuple[str, ...], flags: int = 0):
        self.needs = [set(required_words(p)) for p in patterns]
        self.literals = [[x.lower() for x in required_literals(p)] for p in patterns]
        self.tests = [re.compile(p, flags).search for p in patterns]
        words = set().union(*self.needs)
        self.words = re.compile(rf"(?<![a-z0-9_]){longest_of(words)}").findall
        self.begun = {w: {x for x in words if w.startswith(x)} for w in words} | {"": set()}
        first = [max(n, key=len) if n else "" for n in self.needs]
        self.by_word = {w: [k for k, f in enumerate(first) if f == w] for w in {*first, ""}}

    def found(self, text: str, lower: str):
        """Numbers of the patterns that match ``text``, in order; ``lower`` is the text as lower-case letters."""
        begun = {""}.union(*[self.begun[w] for w in set(self.words(lower))])
        tried = sorted(k for w in begun for k in self.by_word.get(w, ()) if self.needs[k] <= begun and all(x in lower for x in self.literals[k]))
        return (k for k in tried if self.tests[k](text))


@lru_cache(None)
def matcher(patterns: tuple[str, ...], flags: int = 0) -> Matcher:
    return Matcher(patterns, flags)


def each_text(texts: pa.Array, rows: int = 256):
    """The texts of an Arrow column; few of them are Python objects at a time. Null is empty."""
    for a in range(0, len(texts), rows):
        for x in texts.slice(a, rows).to_pylist():
            yield x or ""
