"""Problem 1: find personal items in free text and replace them with typed placeholders.

Generators with high recall propose overlapping spans of a kind: every stretch of up to six name-like words, every run
of digits that may be a phone or identity number, every place that looks like an address or mail address. Boosted trees
judge each from its format and context; a threshold per kind, calibrated on held-out labelled texts, and a choice of the
best of overlapping spans give the items. The trees are trained on a bounded sample of labelled texts (`labelled.py`).

A candidate's context is its line and what the line above announces, and of its digits only what `_facts` tells, so what
was found in a line is kept for the next line that reads the same.
"""

from __future__ import annotations

import math
import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipweave.llm import lexicon
from slipweave.llm.boosting import BoostedTrees
from slipweave.llm.lookalike import CYRILLIC, GREEK

KINDS = ["EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME"]
#: Words of a proposed name, at most; candidates judged together.
NAME_WORDS, JUDGED = 6, 100_000
#: Lines whose items are kept, and the longest of them; words and names whose scores are kept.
KEPT_LINES, KEPT_LENGTH, KEPT_WORDS = 150_000, 200, 100_000
#: Digits that make a number worth a look, at least.
DIGITS = 7

# Characters read as another of the same width; positions stay. All digits are read as those of ASCII.
_FOLD = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | dict.fromkeys([0xA0, 0x202F, 0x3000, *range(0x2000, 0x200B)], " ") | str.maketrans(CYRILLIC | GREEK)
_FOLD |= {c: str(unicodedata.decimal(chr(c))) for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) == "Nd"}
_FOLDED = re.compile(f"[{''.join(map(chr, _FOLD))}]").search
_ALIKE = bytes(48 if 48 <= b <= 57 else b for b in range(256))
_UNSEEN = "\\u00ad\\u200b-\\u200f\\u2060\\ufeff"
_LETTER = f"A-Za-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u024f\\u0300-\\u036f\\u0370-\\u03ff\\u0400-\\u052f\\u1e00-\\u1eff\\u0e01-\\u0e3a\\u0e40-\\u0e4e{_UNSEEN}"
_WORD = re.compile(f"[{_LETTER}][{_LETTER}.'’-]*")
_BETWEEN = re.compile(",?[ \t]+")
_INVISIBLE = re.compile(f"[{_UNSEEN}\\u0300-\\u036f]")
GLUED_TITLE = re.compile(r"(?:นางสาว|น\.\s?ส\.|นาง|นาย|คุณ|ดร\.)(?=[ก-ฮเ-ไ])")
SPACED = re.compile(f"(?<![ก-ฺเ-๎])(?:[ก-ฺเ-๎][{_UNSEEN}]*[ ]+[{_UNSEEN}]*){{2,}}[ก-ฺเ-๎](?![ก-ฺเ-๎])")

_AT, _DOT = r"(?:\s?@\s?|\s?[(\[{<]\s?at\s?[)\]}>]\s?)", r"(?:\s?\.\s?|\s?[(\[{<]\s?dot\s?[)\]}>]\s?|\sdot\s)"
_LOCAL, _HOST = r"[A-Za-z0-9][A-Za-z0-9._%+-]*", r"[A-Za-z0-9-]+"
EMAIL = re.compile(
    rf"{_LOCAL}{_AT}{_HOST}(?:{_DOT}{_HOST})+"
    rf"|{_LOCAL}\sat\s{_HOST}(?:\sdot\s{_HOST})+"
    rf"|[A-Za-z0-9][A-Za-z0-9%+-]*[._\d][A-Za-z0-9._%+-]*\sat\s{_HOST}(?:\.{_HOST})+"
    r"|[^\W\d_][\w.%+-]*@[\w-]+(?:\.[\w-]+)+",
    re.I,
)
_MAIL_SIGN = re.compile(r"@|[(\[{<]\s?at\s?[)\]}>]|\sat\s", re.I)
NUMBER = re.compile(r"[+(]?\d(?:(?:[\d (). ‐-―-]|(?<=\d)/(?=\d)){5,22}\d)?")
_NOT_NUMBER = re.compile(r"\d{4}([-/.])\d\d?\1\d\d?(?!\d)|\d\d?([-/.])\d\d?\2(?:\d{4}|\d\d)(?![\d.-])")
DOCUMENT = re.compile(r"(?<![A-Za-z0-9])(?=[A-Z]*\d)(?=\d*[A-Z])[A-Z0-9]{6,12}(?![A-Za-z0-9])|(?<![A-Za-z0-9])[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D](?![A-Za-z0-9])")
_MASKED = re.compile(r"\s?(?:[xX*]{1,4}[- ]?[xX*\d-]|\*)").match

# Words for streets, before or after the name of the street.
STREET = (
    "road|rd|street|st|lane|ln|avenue|ave|av|drive|way|court|ct|close|square|sq|boulevard|blvd|place|pl|crescent|cres|terrace|gardens?|grove|hill|mews|park|parade|quay|row|walk|highway|hwy|circle|alley|rise|"
    "strasse|straße|str\\.|weg|gasse|platz|allee|ring|damm|ufer|laan|straat"
)
STREET_FIRST = "avenue|rue|via|viale|piazza|corso|calle|avenida|plaza|paseo|carrera|rua|travessa|chemin|impasse|allée|quai|place|boulevard|jalan|jl\\.?|soi|thanon|moo|mu|tambon|ซ\\.|ซอย|ถ\\.|ถนน|หมู่|ม\\.(?!\\s?ค\\b)|ต\\.(?!\\s?ค\\b)|ตำบล|แขวง"
_OPEN = r"(?<![\w/.:,-])"
_UNIT = r"\b(?:unit|flat|apt|apartment|suite|room|block|blk|lot|house)\b\.?\s*#?[\dA-Z]+(?:[/-]\d+)?,?\s+"
_NO = r"\d+[a-z]?(?:[/-]\d+)?"
_POST = r"(?:\d{5}(?:-\d{4})?|[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}|\d{4} ?[A-Z]{2}|[A-Z]{2} \d{5})\b"
ADDRESS = re.compile(
    rf"(?:{_UNIT}|{_OPEN}){_NO},?\s*(?:bis\s|ter\s)?(?:{STREET_FIRST})(?![a-zà-ÿ])"
    rf"|(?:{_UNIT}|{_OPEN}){_NO}\s+(?:[^\W\d_][\w'’.-]*\s+){{1,4}}?(?:{STREET})(?!\w)"
    rf"|{_UNIT}{_NO}"
    rf"|(?:{_UNIT}|{_OPEN}){_NO},?\s+(?:[^\W\d_][\w'’.-]*,?\s+){{1,5}}?{_POST}"
    r"|(?:p\.?\s?o\.?\s?box|postfach|apartado)\s+\d+|ตู้\s?ปณ\.?\s*\d+"
    rf"|(?:\b(?:{STREET_FIRST})\s(?:[^\W\d_][\w'’.-]*\s){{0,4}}?[^\W\d_][\w'’.-]*,?\s{_NO}\b)"
    r"|(?:(?-i:[A-ZÄÖÜ])[\wäöüß.-]*\s(?:(?:dem|der|den|am|im|de|la)\s)?){0,3}(?-i:[A-ZÄÖÜ])[\wäöüß.-]*\s\d{1,4}[a-z]?,\s+(?:\d{5}\b|\d{4}\s(?-i:[A-Z])[a-z])"
    r"|(?-i:[A-ZÄÖÜ])[\wäöüß-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|damm|straat|laan)\s\d{1,4}[a-z]?\b",
    re.I,
)
_STREET_WORDS = {w for w in re.sub(r"\\.|\?|\([^)]*\)+", "", f"{STREET}|garden|{STREET_FIRST}").split("|") if w.isalpha()} | {"box", "unit", "flat", "apt", "apartment", "suite", "room", "block", "blk", "lot", "house", "postfach", "apartado", "jl"}
_LATIN_WORD = re.compile(r"[^\W\d_]+").findall
_ADDRESS_SIGN = re.compile(rf"ซ\.|ซอย|ถ\.|ถนน|หมู่|ม\.|ต\.|ตำบล|แขวง|ปณ|(?:traße|trasse|tr\.|weg|gasse|platz|allee|damm|straat|laan)\s0|[^\W\d_]\s0{{1,4}}[a-z]?,\s+0{{4,5}}\b|{_POST}").search
ADDRESS_END = re.compile(r"[,.;]?\s(?:ติดต่อ|mail|เลขบัตร|โทร|tel|phone|email|e-mail|อีเมล|call|mobile|and|to|with|is|for|ask|then|by|please|before|after|since|until|when|because|but|ครับ|ค่ะ)\b|\s[-/|]\s|[.!?;)](?:\s|$)")
ADDRESS_WORD = re.compile(rf"หมู่|ต\.|อ\.|ซ\.|ถนน|แขวง|เขต|\b(?:{STREET_FIRST})\b|amphoe|\bbox\b|\bunit\b|\b(?:{STREET})(?!\w)|gasse|stra(?:ß|ss)e|weg\b", re.I)
_PREVIOUS = re.compile(r"[^\W\d_][\w฀-๎'-]*|w(?=/)", re.I)

Candidate = tuple[int, int, int, list[float]]


class NameModel:
    """Character 3-gram model of persons (p), organisations (o) and other words (x)."""

    def __init__(self, names: Iterable[tuple[str, str]]):
        counts = {"p": Counter(), "o": Counter(), "x": Counter()}
        for text, kind in names:
            for word in text.split():
                counts[kind].update(self.grams(word))
        total = {k: sum(c.values()) + 1 for k, c in counts.items()}
        every = set().union(*counts.values())
        size = len(every) + 1
        log = {k: {g: math.log((n + 0.5) / (total[k] + 0.5 * size)) for g, n in c.items()} for k, c in counts.items()}
        least = {k: math.log(0.5 / (total[k] + 0.5 * size)) for k in counts}
        self.org = {g: log["p"].get(g, least["p"]) - log["o"].get(g, least["o"]) for g in every}
        self.other = {g: log["p"].get(g, least["p"]) - log["x"].get(g, least["x"]) for g in every}
        self.words: dict[str, tuple] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"words": {}}

    @staticmethod
    def grams(word: str) -> list[str]:
        s = f" {word.casefold()} "
        return [s[i : i + 3] for i in range(len(s) - 2)]

    def score(self, word: str) -> tuple[float, float]:
        """Mean log odds of a word in a person's name against one of an organisation and against other words."""
        g = self.grams(word)
        n = max(len(g), 1)
        return sum(self.org.get(x, 0.0) for x in g) / n, sum(self.other.get(x, 0.0) for x in g) / n

    def word(self, token: str) -> tuple:
        """(class, hard, title, initial, capital, upper, lower, Thai, org, other, letters, glued title, legal form) of a token."""
        out = self.words.get(token)
        if out is None:
            bare = _INVISIBLE.sub("", token).strip(".,'’-")
            exact = lexicon.exact_class(bare) if bare else 0
            thai = "฀" <= bare[:1] <= "๿"
            initial = len(bare) == 1 and bare.isupper()
            title = exact == lexicon.TITLE
            hard = not bare or (0 < exact < lexicon.TITLE and not initial) or token == "I"
            glued = GLUED_TITLE.match(token)
            glue = glued.end() if glued and len(token) > glued.end() + 1 else 0
            org, other = self.score(bare) if bare else (0.0, 0.0)
            out = (lexicon.word_class(bare) if bare else 0, hard, title, initial, bare[:1].isupper(), len(bare) > 1 and bare.isupper(), bare.islower() and not thai, thai, org, other, len(bare), glue, exact == lexicon.ORG)
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            self.words[token] = out
        return out


_CHARS = {"\n": 1, " ": 2, "": 0, ":": 6, "(": 7, ")": 7, "*": 8, "x": 8, "X": 8, "/": 9, ",": 10, "-": 11, ".": 12}


def _char(c: str) -> int:
    return _CHARS.get(c) if c in _CHARS else 4 if c.isdigit() else 3 if c.isalpha() else 5


def _before(line: str, at: int, above: int) -> tuple[int, int]:
    """Class of the nearest announcing word before a place and how far it is; for the first word, of the line above."""
    head = line[max(0, at - 60) : at]
    words = _PREVIOUS.findall(head)
    for k, w in enumerate(reversed(words[-4:])):
        c = lexicon.word_class(w)
        if c and c not in (lexicon.COMMON, lexicon.TITLE):
            return c, k
    return (above, 5) if above and not words and not head.strip() else (0, 9)


def _announces(line: str) -> int:
    """Class of a line that is nothing but an announcing word, or begins with one."""
    whole = line.strip().rstrip(":").strip()
    c = lexicon.word_class(whole) if whole else 0
    if not c and whole and len(whole) <= 30:
        c = lexicon.word_class(whole.split()[0])
    return c if c != lexicon.COMMON else 0


def _citizen(digits: list[int]) -> bool:
    return (11 - sum(d * (13 - i) for i, d in enumerate(digits[:12])) % 11) % 10 == digits[12]


def _facts(line: str) -> tuple[tuple[bool, bool, bool], ...]:
    """What the digits of each number of a line tell besides their number: begins with 0, with 00, has the checksum of an identity number."""
    out = []
    for m in NUMBER.finditer(line):
        raw = m.group().lstrip("+(")
        citizen = False
        if len(raw) >= 13:
            digits = [int(c) for c in raw if c.isdigit()]
            citizen = len(digits) == 13 and _citizen(digits)
        out.append((raw[0] == "0", raw[:2] == "00", citizen))
    return tuple(out)


def _context(line: str, above: int, kind: int, a: int, b: int) -> list[float]:
    word, far = _before(line, a, above)
    after = _PREVIOUS.match(line, b + 1)
    span, size = line[a:b], len(line)
    return [kind, b - a, span.count("0"), word, far, _char(line[a - 1]) if a else 1, _char(line[b]) if b < size else 1, lexicon.word_class(after.group()) if after else 0, min(a, 60), min(size - b, 60), span.count(" "), _char(line[a - 2]) if a > 1 else 1]


def _numbers(line: str, above: int, facts: tuple, mails: list[tuple[int, int]]) -> Iterator[Candidate]:
    """Candidates for phone and identity numbers, in a line whose digits are all alike."""
    for m, (zero, zeros, citizen) in zip(NUMBER.finditer(line), facts, strict=True):
        a, b = m.span()
        if b - a < 7 or any(x <= a < y for x, y in mails) or _NOT_NUMBER.match(line, a) or line[b : b + 1].isascii() and line[b : b + 1].isalpha():
            continue
        if line[a] == "(" and ")" not in line[a : a + 7]:
            a += 1
        raw = line[a:b]
        groups = re.findall(r"\d+", raw)
        n = sum(map(len, groups))
        if not 7 <= n <= 15:
            continue
        shape = [
            n, len(groups), len(groups[0]), len(groups[-1]), raw[0] == "+", zeros, zero, raw[0] == "(", citizen, raw.count("."), raw.count("-"), raw.count("/"), a > 0 and line[a - 1] in "-./:,#", max(map(len, groups)),
            a > 0 and line[a - 1].isalpha() and line[a - 1].isascii(), len(groups[1]) if len(groups) > 1 else 0,
        ]
        context = _context(line, above, 1, a, b)
        yield 1, a, b, context + shape
        if n >= 8:
            yield 2, a, b, [2.0, *context[1:], *shape]


def _names(line: str, above: int, model: NameModel, hidden: list[tuple[int, int]]) -> Iterator[Candidate]:
    """Candidates for names: stretches of up to NAME_WORDS words between words that are in no name."""
    size, thai_letters = len(line), line and "ก" <= max(line)
    spaced = [m.span() for m in SPACED.finditer(line)] if thai_letters else []
    for a, b in spaced:
        whole = _INVISIBLE.sub("", line[a:b]).replace(" ", "").replace("ํา", "ำ")
        if len(whole) < 5 or lexicon.word_class(whole):
            continue
        org, other = model.score(whole)
        word, far = _before(line, a, above)
        yield 4, a, b, [4, 2, b - a, 0, 0, 0, 0, 1, org, org, other, other, 0, 0, 0, 0, 0, 0, a == 0, b == size, _char(line[a - 1]) if a else 1, _char(line[b]) if b < size else 1, word, far, 0, 0, 0, False, 0, 0, (b - a) / 2, False]
    words = [(m.start(), m.end(), model.word(m.group())) for m in _WORD.finditer(line) if not spaced or not any(x <= m.start() < y for x, y in spaced)]
    n = len(words)
    joined = [0] * n  # 1 a blank, 2 a comma and a blank between a word and the next
    for k in range(n - 1):
        e, s = words[k][1], words[k + 1][0]
        if s - e == 1 and line[e] in " \t":
            joined[k] = 1
        elif (m := _BETWEEN.fullmatch(line, e, s)) is not None:
            joined[k] = 2 if m.group()[0] == "," else 1
    for i in range(n):
        s, _, w = words[i]
        if w[1] or w[2] or w[12] or (w[6] and w[9] < -1.5) or (hidden and any(x <= s < y for x, y in hidden)):
            continue
        prev = words[i - 1][2] if i and joined[i - 1] else None
        word, far = (above, 5) if not i and above else (0, 9)
        for back in range(1, min(i, 4) + 1):
            c = words[i - back][2][0]
            if c and c != lexicon.COMMON and c != lexicon.TITLE:
                word, far = c, back - 1
                break
        honorific = bool(prev and prev[3] and line[words[i - 1][0]] in "Kk")
        for start, title in ([(s, 2 if honorific else int(bool(prev and prev[2])))] + ([(s + w[11], 1)] if w[11] else [])):
            own = model.word(line[start : words[i][1]]) if start != s else w
            after_name = bool(prev and not title and not prev[1] and not prev[12] and (prev[4] or prev[7]))
            caps = ups = lows = thais = initials = listed = commas = letters = 0
            least_org = least_other = 9.0
            sum_org = sum_other = 0.0
            for j in range(i, min(i + NAME_WORDS, n)):
                if j > i and not joined[j - 1]:
                    break
                t = words[j][2] if j > i else own
                if j > i:
                    if t[2] or t[12] or (t[1] and line[words[j][0] : words[j][1]].casefold() not in lexicon.PARTICLES):
                        break
                    commas += joined[j - 1] == 2
                    if commas > 1:
                        break
                e = words[j][1]
                stop = False
                while e > start and (line[e - 1] in ",'’-" or (line[e - 1] == "." and not t[3] and t[10] > 2)):
                    stop = stop or line[e - 1] == "."
                    e -= 1
                caps, ups, lows, thais, initials, listed = caps + t[4], ups + t[5], lows + t[6], thais + t[7], initials + t[3], listed + (t[0] > 0)
                letters += t[10]
                sum_org, sum_other = sum_org + t[8], sum_other + t[9]
                if not t[3]:
                    least_org, least_other = min(least_org, t[8]), min(least_other, t[9])
                k = j - i + 1
                nxt = words[j + 1][2] if j + 1 < n and joined[j] and not stop else None
                # One word amid words that look like names is part of a longer candidate only.
                inner = k == 1 and (bool(nxt and not nxt[1] and not nxt[2] and not nxt[12] and (nxt[4] or (nxt[7] and not title))) or (after_name and not title))
                if letters >= 2 and (letters > 2 or thais) and not inner:
                    more = words[j + 2][2] if nxt and j + 2 < n and joined[j + 1] else None
                    yield 4, start, e, [
                        4, k, e - start, title, caps / k, ups / k, lows / k, thais / k, least_org, sum_org / k, least_other, sum_other / k,
                        prev[9] if prev else -9, nxt[9] if nxt else -9, prev[0] if prev else -1, nxt[0] if nxt else -1, (prev[4] + 2 * prev[1] + 4 * prev[2]) if prev else -1, (nxt[4] + 2 * nxt[1] + 4 * nxt[2]) if nxt else -1,
                        start == 0, e == size, _char(line[start - 1]) if start else 1, _char(line[e]) if e < size else 1, word, far, listed, initials, commas, _MASKED(line, e) is not None,
                        bool(nxt and nxt[0] == 9) or bool(more and more[0] == 9), own[11] > 0, letters / k, own[3] and line[start] in "Kk",
                    ]
                if stop:
                    break


def candidates(line: str, above: int, facts: tuple, model: NameModel) -> list[Candidate]:
    """(kind, start, end, features) of every proposed span of a line whose digits are all alike."""
    out: list[Candidate] = []
    mails: list[tuple[int, int]] = []
    if _MAIL_SIGN.search(line):
        for m in EMAIL.finditer(line):
            mails.append(m.span())
            s = m.group()
            out.append((0, *m.span(), [*_context(line, above, 0, *m.span()), "@" in s, s.count("."), "(" in s or "[" in s, " at " in s, " dot " in s, s.count(" ")]))
    hidden = list(mails)
    if facts:
        out += _numbers(line, above, facts, mails)
    if "0" in line:
        for m in DOCUMENT.finditer(line):
            if not any(x <= m.start() < y for x, y in mails):
                raw = m.group()
                n = raw.count("0")
                lead = len(raw) - len(raw.lstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
                out.append((2, *m.span(), [*_context(line, above, 2, *m.span()), n, 0, lead, len(raw), False, False, False, False, False, 0, 0, 0, False, 0, True, raw.count(" ")]))
        if not _STREET_WORDS.isdisjoint(_LATIN_WORD(line.lower())) or _ADDRESS_SIGN(line):
            at = 0
            while m := ADDRESS.search(line, at):
                a = m.start()
                at = a + len(line[a:].split(" ", 1)[0]) + 1  # another may begin behind the first word
                if any(x <= a < y for x, y in mails):
                    continue
                stop = ADDRESS_END.search(line, m.end())
                b = stop.start() if stop else len(line)
                b = min([b, *(x for x, _ in mails if x > a)])
                span = line[a:b]
                signs = [len(ADDRESS_WORD.findall(span)), bool(re.search(_POST, span)), span[0].isdigit(), span[:1].isupper(), "/" in span[:8], span.count(","), sum(w[:1].isupper() for w in span.split()), m.end() - a]
                out.append((3, a, b, [*_context(line, above, 3, a, b), *signs]))
    out += _names(line, above, model, hidden)
    return out


#: Scores from which on candidates of a kind count as alike.
LIKELY = (1.0, 1.0, 1.0, 0.75, 0.9)


class Finder:
    """Trained model: judges candidates, chooses among overlapping ones."""

    def __init__(self, model: NameModel, trees: list[BoostedTrees | None], thresholds: list[float]):
        self.model, self.trees, self.thresholds = model, trees, thresholds
        self.kept: dict[tuple, list] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"kept": {}}

    def score(self, proposed: list[Candidate]) -> np.ndarray:
        out = np.zeros(len(proposed))
        kinds = np.fromiter((c[0] for c in proposed), np.int64, len(proposed))
        for k, trees in enumerate(self.trees):
            rows = np.flatnonzero(kinds == k)
            if len(rows) and trees is not None:
                out[rows] = trees.predict(np.array([proposed[i][3] for i in rows], np.float64))
        return out

    def choose(self, proposed: list[Candidate], scores: np.ndarray) -> list[tuple[int, int, int]]:
        """(kind, start, end) of the best spans above their thresholds that do not overlap, by position."""
        good = [i for i in range(len(proposed)) if scores[i] >= self.thresholds[proposed[i][0]]]
        # Of spans that are all likely the longer one is whole; words inside an address are part of it.
        rank = lambda i: min(float(scores[i]), LIKELY[proposed[i][0]]) + (proposed[i][0] == 3)
        good.sort(key=lambda i: (-rank(i), proposed[i][1] - proposed[i][2], proposed[i][1]))
        taken: list[tuple[int, int, int]] = []
        for i in good:
            kind, a, b, _ = proposed[i]
            if not any(a < y and x < b for _, x, y in taken):
                taken.append((kind, a, b))
        return sorted(taken, key=lambda t: t[1])

    def _judge(self, fresh: list[tuple[list, list[Candidate]]]) -> None:
        scores = self.score([c for _, cs in fresh for c in cs])
        at = 0
        for entry, cs in fresh:
            entry[0] = self.choose(cs, scores[at : at + len(cs)])
            at += len(cs)

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """(kind, start, end) of the items of each text."""
        kept, fresh, waiting = self.kept, [], 0
        places: list[list[tuple[int, list]]] = []
        for text in texts:
            lines: list[tuple[int, list]] = []
            at, above = 0, 0
            if text:
                plain, same = _forms(text)
                for line, real in zip(same.split("\n"), plain.split("\n"), strict=True):
                    if line:
                        facts = _facts(real) if line.count("0") >= DIGITS else ()
                        key = (line, above, facts)
                        entry = kept.get(key)
                        if entry is None:
                            cs = candidates(line, above, facts, self.model)
                            entry = [[], _announces(line)]
                            if cs:
                                fresh.append((entry, cs))
                                waiting += len(cs)
                                if waiting > JUDGED:
                                    self._judge(fresh)
                                    fresh, waiting = [], 0
                            if len(line) <= KEPT_LENGTH:
                                if len(kept) >= KEPT_LINES:
                                    kept.clear()
                                kept[key] = entry
                        lines.append((at, entry))
                        above = entry[1]
                    else:
                        above = 0
                    at += len(line) + 1
            places.append(lines)
        self._judge(fresh)
        return [[(kind, at + a, at + b) for at, entry in lines for kind, a, b in entry[0]] for lines in places]

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the trained model to a folder that all machines share."""
        spark.createDataFrame([(bytearray(pickle.dumps(self)),)], "finder binary").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Finder:
        """A finder that `save` wrote. The file is unpickled: read only what you wrote."""
        return pickle.loads(bytes(spark.read.parquet(path).first().finder))


def _forms(text: str) -> tuple[str, str]:
    """A text with characters folded, and the same with its digits all alike; positions stay."""
    plain = text if text.isascii() or not _FOLDED(text) else text.translate(_FOLD)
    return plain, plain.encode("utf-8", "surrogatepass").translate(_ALIKE).decode("utf-8", "surrogatepass")


def propose(text: str, model: NameModel) -> Iterator[list[Candidate]]:
    """Candidates of a text by line, with their places in the text; for training."""
    at, above = 0, 0
    plain, same = _forms(text)
    for line, real in zip(same.split("\n"), plain.split("\n"), strict=True):
        if line:
            yield [(k, at + a, at + b, f) for k, a, b, f in candidates(line, above, _facts(real) if line.count("0") >= DIGITS else (), model)]
        above = _announces(line) if line else 0
        at += len(line) + 1


#: Candidates of one kind that the trees of a kind are fitted on, at most; a wider sample of texts than that is thinned by place.
FITTED = 16_000


def train(labelled: list[tuple[str, list[tuple[str, int]]]], held: list[tuple[str, list[tuple[str, int]]]], model: NameModel) -> Finder:
    """Fit trees per kind on the labelled texts; calibrate each threshold for the best F1 on the held-out ones."""
    data: list[list[list[tuple[list[float], int]]]] = [[[] for _ in KINDS] for _ in range(2)]
    missed = [0] * len(KINDS)
    for part, texts in enumerate((labelled, held)):
        for text, truth in texts:
            ends = {(KINDS.index(k), a): b for k, a, b in truth}
            seen = set()
            for c in propose(text, model):
                for kind, a, b, f in c:
                    want = ends.get((kind, a))
                    right = want is not None and (kind != 4 or b == want)
                    if right:
                        seen.add((kind, a))
                    data[part][kind].append((f, int(right)))
            if part:
                for kind, _ in set(ends) - seen:
                    missed[kind] += 1
    trees: list[BoostedTrees | None] = []
    thresholds = []
    for k in range(len(KINDS)):
        rows, tests = data[0][k], data[1][k]
        if len(rows) > FITTED:
            rows = rows[:: -(-len(rows) // FITTED)]
        if not rows or not tests:
            trees.append(None)
            thresholds.append(2.0)
            continue
        t = BoostedTrees(trees=60 if k == 4 else 40).fit(np.array([f for f, _ in rows], np.float64), np.array([y for _, y in rows], float))
        p, y = t.predict(np.array([f for f, _ in tests], np.float64)), np.array([y for _, y in tests])
        grid = np.linspace(0.05, 0.95, 37)
        f1 = [2 * (y[p >= g].sum()) / max((p >= g).sum() + y.sum() + missed[k], 1) for g in grid]
        # What is missed stays readable, so of thresholds that do about as well the lowest is taken.
        trees.append(t)
        thresholds.append(float(grid[np.flatnonzero(np.array(f1) >= max(f1) - 0.003)[0]]))
    return Finder(model, trees, thresholds)


def find(texts: DataFrame, finder: Finder, text: str = "text") -> DataFrame:
    """All columns but `text`, with kind, start_pos and end_pos of each item, one row per item.

    Null, empty and blank texts have no rows. Repeated rows give repeated items. Texts are read whole.
    """
    keep = [f for f in texts.schema.fields if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "kind string, start_pos bigint, end_pos bigint"])
    shared = texts.sparkSession.sparkContext.broadcast(finder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = shared.value
        for b in batches:
            for begin in range(0, len(b), 2000):
                part = b.iloc[begin : begin + 2000]
                found = f.find(list(part[text]))
                at = [i for i, spans in enumerate(found) for _ in spans]
                flat = [s for spans in found for s in spans]
                out = part.drop(columns=[text]).iloc[at].reset_index(drop=True)
                yield out.assign(kind=[KINDS[k] for k, _, _ in flat], start_pos=[a for _, a, _ in flat], end_pos=[e for _, _, e in flat])

    return texts.mapInPandas(run, schema)


def redact(texts: DataFrame, finder: Finder, text: str = "text", out: str = "redacted") -> DataFrame:
    """texts with `out`: the text with each item replaced by its kind in brackets; null stays null, the rest unchanged."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields), f"`{out}` string"])
    shared = texts.sparkSession.sparkContext.broadcast(finder)

    def one(s: str, spans: list[tuple[int, int, int]]) -> str:
        for kind, a, b in reversed(spans):
            s = f"{s[:a]}[{KINDS[kind]}]{s[b:]}"
        return s

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = shared.value
        for b in batches:
            values = [x if isinstance(x, str) else None for x in b[text]]
            yield b.assign(**{out: [None if s is None else one(s, spans) for s, spans in zip(values, f.find(values), strict=True)]})

    return texts.mapInPandas(run, schema)


def slip_texts(reads: DataFrame, reviews: DataFrame, blank: bool = False) -> DataFrame:
    """(text_field, record_id, text) of both free texts; null and blank texts, which hold no item, only if `blank`."""
    ocr = reads.select(F.lit("raw_ocr_text").alias("text_field"), F.col("read_id").alias("record_id"), F.col("raw_ocr_text").alias("text"))
    notes = reviews.select(F.lit("note").alias("text_field"), F.col("entry_id").alias("record_id"), F.col("note").alias("text"))
    both = ocr.unionByName(notes)
    return both if blank else both.where(F.col("record_id").isNotNull() & (F.length(F.trim("text")) > 0))
