"""Problem 9: cut texts above a token limit into overlapping pieces at natural boundaries.

Recursive bisection: a span that exceeds the limit minus the overlap is cut at the strongest boundary near its middle
(paragraph, line, sentence, clause, blank, anything), and both halves are treated alike. Where a span is cut does not
depend on the limit, so one bisection serves all limits: each stops where its spans are small enough. Then every piece
but the first is begun earlier by the overlap. Spans are cut between tokens and between characters; the tokens of a part
of a text are the part of its tokens, so sizes are sums of a running count.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipweave.llm.tokenizer import TABLE_LENGTH, TABLE_WORDS, VOCABULARY, Described, Transducer, in_parts, transducer

# What ends a sentence or a clause, if a blank follows; the wide forms end it whatever follows.
SENTENCE_END, CLAUSE_END = ".!?…", ",;:"
WIDE_SENTENCE_END, WIDE_CLAUSE_END = "。！？｡", "、，；：､"
#: Part of a span around its middle in which the cut is looked for.
WINDOW = 0.5
#: Limits served by one pass over the texts.
LIMITS_AT_ONCE = 1000
_ENDS = {c: k for k, cs in enumerate((CLAUSE_END, SENTENCE_END, WIDE_CLAUSE_END, WIDE_SENTENCE_END)) for c in cs}
_END_CLASS = (2, 3, 6, 7)


def _describe(t: Transducer, word: str) -> int:
    """Tokens and the classes of both ends of a pre-token, packed."""
    n, last = len(t.words[word]), word[-1]
    start = 1 if word[0] == " " else 0
    if last.isalnum():
        end = 0
    elif word.isspace():
        start = 2 if word[0] in "\r\n" else 1
        breaks = word.replace("\r\n", "\n").count("\n") + word.replace("\r\n", "").count("\r")
        end = 5 if breaks > 1 else 4 if breaks else 1
    else:
        end = _END_CLASS[_ENDS[last]] if last in _ENDS else 0
    return n << 8 | start << 4 | end


def _describe_numbers(n: np.ndarray, blank: np.ndarray) -> np.ndarray:
    return n << 8 | blank << 4


#: Strength of a place by the class of the word end before it and of the word start behind it.
_STRENGTH = np.array([[0, 1, 1], [0, 1, 1], [0, 2, 2], [0, 3, 3], [4, 1, 1], [5, 1, 1], [2, 2, 2], [3, 3, 3]], np.int8)
_BY_STRENGTH = (5, 4, 3, 2, 1, 0)


def _places(t: Transducer, word: str) -> list[tuple[int, int]]:
    """(characters, tokens) before each place inside a word that lies between two characters."""
    chars, pos, out = 0, 0, []
    data, ids = word.encode("utf-8", "replace"), t.words[word]
    one_byte = len(data) == len(word)
    for i, token in enumerate(ids[:-1]):
        end = pos + len(t.by_id[token])
        chars += end - pos if one_byte else sum(b & 0xC0 != 0x80 for b in data[pos:end])
        pos = end
        if data[pos] & 0xC0 != 0x80:
            out.append((chars, i + 1))
    return out


class _Inside(dict):
    """Places inside words met before; emptied when there are too many."""

    def __init__(self, t: Transducer):
        super().__init__()
        self.t = t

    def __missing__(self, word: str) -> list[tuple[int, int]]:
        out = _places(self.t, word)
        if len(word) <= TABLE_LENGTH:
            if len(self) > TABLE_WORDS:
                self.clear()
            self[word] = out
        return out


class Layout:
    """Where the texts of a part may be cut: characters, tokens before and strength of each place, ends included.

    All texts lie one behind another; a text is a range of places, and its positions are differences.
    """

    def __init__(self, t: Transducer, known: Described, inside: _Inside, texts: list[list[str]], long_word: int):
        """Words of more than long_word tokens may be cut inside; shorter ones fit beside another word in any piece."""
        self.t, self.inside, self.long_word = t, inside, long_word
        self.words = words = list(chain.from_iterable(texts))
        ends = np.cumsum([0, *map(len, texts)])
        packed = known.all(words)
        tokens, chars = packed >> 8, np.fromiter(map(len, words), np.int64, len(words))
        start, end = packed >> 4 & 15, packed & 15
        strength = np.zeros(len(packed) + 1, np.int8)
        after, before = start[1:], end[:-1]
        strength[1:-1] = _STRENGTH[before, after]
        twice = (before[1:] == 4) & (end[:-2] >= 4) & (after[1:] == 0)  # two line ends in two pre-tokens
        twice[[k - 1 for k in ends if 1 <= k <= len(twice)]] = False  # of one text
        strength[2:-1][twice] = 5
        at, before = np.concatenate([[0], np.cumsum(chars)]), np.concatenate([[0], np.cumsum(tokens)])
        # Views give plain integers without a copy.
        self.word_at, self.word_before = memoryview(at), memoryview(before)
        if len(tokens) and tokens.max() > long_word:
            at, before, strength, ends = self._open_long(tokens, at, before, strength, ends)
        self.at, self.before, self.places, self.strength = memoryview(at), memoryview(before), ends.tolist(), strength.tobytes()

    def _open_long(self, tokens: np.ndarray, at: np.ndarray, before: np.ndarray, strength: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """All of them with the places inside long words."""
        parts: list[list[np.ndarray]] = [[], [], []]
        done, more = 0, np.zeros(len(tokens) + 1, np.int64)
        for k in np.flatnonzero(tokens > self.long_word):
            for part, column in zip(parts, (at, before, strength), strict=True):
                part.append(column[done : k + 1])
            if places := self.inside[self.words[k]]:
                c, n = np.array(places).T
                for part, column in zip(parts, (at[k] + c, before[k] + n, np.zeros(len(places), np.int8)), strict=True):
                    part.append(column)
                more[k + 1] = len(places)
            done = k + 1
        out = [np.concatenate([*part, column[done:]]) for part, column in zip(parts, (at, before, strength), strict=True)]
        return *out, ends + np.cumsum(more)[ends]

    def cuts(self, first: int, last: int, limits: list[int]) -> list[list[int]]:
        """For each limit, largest first, the places that cut a text into spans of at most that many tokens, where the text
        has places that near."""
        before, strength = self.before, self.strength
        out: list[list[int]] = [[] for _ in limits]
        n = len(limits)
        todo = [(first, last, 0)]
        while todo:
            lo, hi, open_ = todo.pop()
            from_, to = before[lo], before[hi]
            size = to - from_
            while open_ < n and (size <= limits[open_] or hi - lo < 2):
                out[open_].append(lo)
                open_ += 1
            if open_ == n:
                continue
            middle = (from_ + to) / 2
            a = max(lo + 1, bisect_left(before, middle - size * WINDOW / 2, lo, hi))
            b = min(hi, bisect_right(before, middle + size * WINDOW / 2, lo, hi))
            if a >= b:
                a = min(max(lo + 1, a), hi - 1)
                b = a + 1
            m = min(max(bisect_left(before, middle, a, b), a), b - 1)
            for s in _BY_STRENGTH:
                left, right = strength.rfind(s, a, m), strength.find(s, m, b)
                if left >= 0 or right >= 0:
                    break
            cut = right if left < 0 or (right >= 0 and before[right] - middle < middle - before[left]) else left
            todo.append((cut, hi, open_))
            todo.append((lo, cut, open_))
        for places in out:
            places.append(last)
        return out

    def back(self, place: int, first: int, overlap: int, room: int) -> tuple[int, int]:
        """(character, tokens before) where a piece begins so that it shares `overlap` tokens with the one before.

        A place inside a character is moved back to share more if `room` allows, else forward to share less.
        """
        here = self.before[place]
        share = min(overlap, room)
        if share <= 0 or place == first:
            return self.at[place], here
        target = here - share
        if target <= self.before[first]:
            return self.at[first], self.before[first]
        j = bisect_right(self.before, target, first, place + 1) - 1
        if self.before[j] == target:
            return self.at[j], target
        spots = [(self.at[j], self.before[j]), (self.at[j + 1], self.before[j + 1])]
        k = bisect_right(self.word_before, target) - 1
        if self.word_before[k + 1] - self.word_before[k] <= self.long_word:  # places inside longer words are listed already
            spots[1:1] = [(spots[0][0] + c, spots[0][1] + n) for c, n in self.inside[self.words[k]]]
        fits = [s for s in spots if s[1] <= target and here - s[1] <= room]
        return fits[-1] if fits else next(s for s in spots if s[1] > target)

    def shorter_at_end(self, start: int, end: int) -> int:
        """Tokens saved where a piece ends behind blanks: before a word they are two pre-tokens, at the end one."""
        k = bisect_left(self.word_at, end)
        if k < 2 or self.word_at[k] != end or start >= self.word_at[k - 1] or not (self.words[k - 1].isspace() and self.words[k - 2].isspace()):
            return 0
        words, a, b = self.t.words, self.words[k - 2][max(0, start - self.word_at[k - 2]) :], self.words[k - 1]
        return len(words[a]) + len(words[b]) - len(words[a + b])

    def pieces(self, i: int, limits: list[tuple[int, int, int]]) -> Iterator[tuple]:
        """(limit_id, piece_no, start_char, new_from, end_char, n_tokens) of text i for each limit it exceeds. Limits have
        those of the largest spans first."""
        first, last = self.places[i], self.places[i + 1]
        at, before = self.at, self.before
        base, stop = at[first], at[last]
        total = before[last] - before[first]
        over = [x for x in limits if total > x[1]]
        if not over:
            return
        for (limit_id, most, overlap), cuts in zip(over, self.cuts(first, last, [m - o for _, m, o in over]), strict=True):
            for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                room = most - (before[hi] - before[lo])
                start, tokens = self.back(lo, first, overlap, room) if k else (base, before[first])
                end = at[hi]
                n = before[hi] - tokens - (self.shorter_at_end(start, end) if end < stop else 0)
                yield limit_id, k, start - base, at[lo] - base, end - base, n


_OUT = "doc_id long, limit_id int, piece_no int, start_char int, new_from int, end_char int, n_tokens int, text string"


def split(texts: DataFrame, limits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece of each text above a limit: doc_id, limit_id, piece_no, its characters from start_char to
    end_char (new_from is where it goes on from the piece before), n_tokens and text.

    Texts within a limit, null and empty texts have no rows for it. A limit row with a null or non-positive maximum is
    ignored; a negative or null overlap is none, one that leaves no room for a new token is the largest that does (the
    maximum less one). Overlaps differ from the wanted number only where a token would split a character. The new parts
    of all pieces make up the whole text. A single character of more tokens than the limit stays whole. limits is a
    parameter table; each LIMITS_AT_ONCE of its rows take one more pass over the texts.
    """
    wanted = limits.where("max_tokens > 0 and limit_id is not null").select("limit_id", "max_tokens", F.greatest(F.lit(0), F.least(F.coalesce("overlap_tokens", F.lit(0)), F.col("max_tokens") - 1)).alias("o")).distinct()
    rows, out = [], None
    for r in chain(wanted.toLocalIterator(), [None]):
        if r is not None:
            rows.append((r.limit_id, r.max_tokens, r.o))
        if len(rows) == LIMITS_AT_ONCE or r is None:
            more = _split(texts, sorted(rows, key=lambda x: (x[2] - x[1], x)), vocabulary)
            rows, out = [], more if out is None else out.unionByName(more)
    return out


def _split(texts: DataFrame, limits: list[tuple[int, int, int]], vocabulary: str) -> DataFrame:
    least = min((m for _, m, _ in limits), default=0)
    long_word = max(1, min((m - o for _, m, o in limits), default=3) // 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocabulary)
        known, inside = Described(t, _describe, _describe_numbers), _Inside(t)
        for b in batches:
            out: list[tuple] = []
            size = 0
            # A character has at most four bytes and a byte at most one token: shorter texts are within every limit.
            rows = [(doc, text) for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) if text and len(text) > least // 4]
            at = iter(rows)
            for part in in_parts([text for _, text in rows]):
                layout = Layout(t, known, inside, part, long_word)
                for i in range(len(part)):
                    doc, text = next(at)
                    for p in layout.pieces(i, limits):
                        out.append((doc, *p, text[p[2] : p[4]]))
                        size += p[4] - p[2]
                    if size > 4_000_000:
                        yield _table(out)
                        out, size = [], 0
            if out:
                yield _table(out)

    return texts.select("doc_id", "text").mapInArrow(run, _OUT)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    doc, *ints, text = zip(*rows, strict=True)
    names = [c.split()[0] for c in _OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), *(pa.array(c, pa.int32()) for c in ints), pa.array(text, pa.string())], names=names)
