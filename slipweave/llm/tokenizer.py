"""Problem 7: encode a corpus with a public byte-level BPE vocabulary through a finite-state transducer.

The merges are compiled into a transducer that reads bytes. Its state is the longest suffix of the input that may still
begin a token, with the last token of the encoding of every prefix that ends inside that suffix; a byte leads to one
next state and to the one token that ends the encoding of the longer prefix. States and transitions are made when first
met (lazy determinisation). A token is emitted as soon as all encodings still possible share it, which is at most one
token length behind the input, so memory stays bounded on a text without any break. Pre-tokens met before are
answered from a bounded table. Nothing is trained, and the vocabulary's path is a parameter.
"""

from __future__ import annotations

import gc
import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the vocabulary's pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for the standard library's engine, which is faster (what begins with an apostrophe may come third); it holds unless a text has one of _UNLIKE.
_FAST = re.compile(r" ?[^\W\d_]+| ?\d+|'(?:[sdmt]|ll|ve|re)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_EXACT = regex.compile(PATTERN)
#: Pre-tokens kept, and the longest of them in characters; states kept.
TABLE_WORDS, TABLE_LENGTH, MAX_STATES = 200_000, 48, 200_000
#: Characters of the texts prepared for together.
PART_CHARS = 2_000_000
#: Bytes read between two emissions.
BLOCK = 4096
#: Transitions met before one is made.
LAZINESS = 16
#: In a state: no token before the first byte.
START = -1


@cache
def _unlike() -> tuple[Callable[[str], object], frozenset[str]]:
    """Characters that the two pattern engines put in different classes: numbers that are no digits, odd separators.

    A search for those of the basic plane, or for any character beyond it, and all of them.
    """
    every = map(chr, range(sys.maxunicode + 1))
    odd = [c for c in every if unicodedata.category(c) in ("Nl", "No") or "\x1c" <= c <= "\x1f" or (unicodedata.category(c) in ("Lo", "Lm", "Nd") and not c.isalnum())]
    return re.compile(f"[{''.join(c for c in odd if c <= '\uffff')}\U00010000-\U0010ffff]").search, frozenset(odd)


def pre_tokens(text: str) -> list[str]:
    if text.isascii():
        alike = not ("\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text)
    else:
        search, odd = _unlike()
        alike = not search(text) or odd.isdisjoint(text)
    return (_FAST if alike else _EXACT).findall(text)


def byte_alphabet() -> dict[str, int]:
    """Printable character by byte, as byte-level vocabularies write them: visible Latin-1 stands for itself."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Byte-level BPE as a lazily determinised transducer; one per process."""

    def __init__(self, vocabulary: str = VOCABULARY):
        model = json.loads(Path(vocabulary).read_text(encoding="utf-8"))["model"]
        alphabet = byte_alphabet()
        spelled = {t: bytes(alphabet[c] for c in t) for t in model["vocab"] if all(c in alphabet for c in t)}
        ids = {t: model["vocab"][t] for t in spelled}
        # Tokens are numbered by the order of their merges; public ids come back at emission.
        self.spell: list[bytes] = []
        self.public: list[int] = []
        number: dict[str, int] = {}
        for t in sorted((t for t in spelled if len(spelled[t]) == 1), key=spelled.get):
            number[t] = len(self.spell)
            self.spell.append(spelled[t])
            self.public.append(ids[t])
        self.merged: dict[int, int] = {}  # by left << 20 | right
        self.left, self.right = [-1] * len(self.spell), [-1] * len(self.spell)
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            number[a + b] = self.merged[number[a] << 20 | number[b]] = len(self.spell)
            self.left.append(number[a])
            self.right.append(number[b])
            self.spell.append(spelled[a + b])
            self.public.append(ids[a + b])
        self.by_bytes = {b: i for i, b in enumerate(self.spell)}
        self.begun = {b[:k] for b in self.spell for k in range(len(b))}
        self.by_id = dict(zip(self.public, self.spell, strict=True))
        self._apart: dict[int, bool] = {}
        # Suffixes that may begin a token, with their open starts; bounded by the vocabulary.
        self.suffixes: list[tuple[bytes, tuple[int, ...]]] = [(b"", (0,))]
        self.suffix_of = {self.suffixes[0]: 0}
        self.plans: dict[int, tuple] = {}
        self.misses = 0
        self._reset()
        self.words: dict[str, tuple[int, ...]] = _Words(self)
        self.numbers: dict[str, tuple[int, ...]] = {}
        self.coder = NumberCoder(self)
        self.sizes = Described(self, lambda t, word: len(t.words[word]), lambda n, _: n)

    def _reset(self) -> None:
        self.states: list[tuple[int, tuple[int, ...]]] = [(0, (START,))]
        self.state_of = {self.states[0]: 0}
        self.step: dict[int, tuple[int, int]] = {}

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether BPE leaves tokens a, b side by side when it reads their bytes.

        The merges that made a and b are undone, latest first. At each point the two tokens that touch the seam must
        not form a merge that is due before the one undone last; of equal merges the left one is due first.
        """
        merged, lefts, rights = self.merged.get, self.left, self.right
        x, y, before, known = a, b, len(lefts), True
        while True:
            merge = merged(x << 20 | y)
            if merge is not None and merge < before:
                known = False
                break
            left, right = lefts[x], lefts[y]
            if right < 0:
                if left < 0:
                    break
                before, x = x, rights[x]
            elif left >= 0 and x > y:
                before, x = x, rights[x]
            else:
                before, y = y + 1, right
        if len(self._apart) > 1_000_000:
            self._apart.clear()
        self._apart[a << 20 | b] = known
        return known

    def _plan(self, suffix: int, byte: int) -> tuple:
        """What a byte does to a suffix, whatever the tokens before it.

        The next suffix; the tokens that may end here with the index of the start they need; the indices of the starts
        that stay open. Starts are listed from the earliest, and only while a longer token may still come of them.
        """
        text, starts = self.suffixes[suffix]
        s = text + bytes((byte,))
        ending = [(i, self.by_bytes[s[k:]]) for i, k in enumerate(starts) if s[k:] in self.by_bytes]
        kept = [i for i, k in enumerate(starts) if s[k:] in self.begun]
        opens = [starts[i] for i in kept] + [len(s)]
        new = (s[opens[0] :], tuple(k - opens[0] for k in opens))
        to = self.suffix_of.setdefault(new, len(self.suffixes))
        if to == len(self.suffixes):
            self.suffixes.append(new)
        out = self.plans[suffix << 8 | byte] = (to, tuple(ending), tuple(kept))
        return out

    def _advance(self, state: int, byte: int) -> tuple[int, int]:
        suffix, lasts = self.states[state]
        to_suffix, ending, kept = self.plans.get(suffix << 8 | byte) or self._plan(suffix, byte)
        apart = self._apart
        for i, token in ending:
            last = lasts[i]
            if last == START:
                break
            ok = apart.get(last << 20 | token)
            if self.stay_apart(last, token) if ok is None else ok:
                break
        new = (to_suffix, (*[lasts[i] for i in kept], token))
        to = self.state_of.get(new)
        if to is None:
            to = self.state_of[new] = len(self.states)
            self.states.append(new)
        out = self.step[state << 8 | byte] = (to, token)
        return out

    def _simulate(self, state: int, data: bytes, lasts_out: list[int]) -> tuple[int, tuple[int, ...]]:
        """Read data from a state without making states; the configuration it ends in."""
        suffix, lasts = self.states[state]
        plans, apart = self.plans, self._apart
        for byte in data:
            suffix, ending, kept = plans.get(suffix << 8 | byte) or self._plan(suffix, byte)
            for i, token in ending:
                last = lasts[i]
                if last == START:
                    break
                ok = apart.get(last << 20 | token)
                if self.stay_apart(last, token) if ok is None else ok:
                    break
            lasts = (*[lasts[i] for i in kept], token)
            lasts_out.append(token)
        return suffix, lasts

    def _short(self, data: bytes) -> tuple[int, ...]:
        """Ids of a pre-token of few bytes. A missing transition is made one time in LAZINESS; else the rest is simulated."""
        step, state, lasts = self.step, 0, []
        for k, byte in enumerate(data):
            nxt = step.get(state << 8 | byte)
            if nxt is None:
                self.misses += 1
                if self.misses % LAZINESS:
                    self._simulate(state, data[k:], lasts)
                    break
                nxt = self._advance(state, byte)
            state, token = nxt
            lasts.append(token)
        out, at, spell, public = [], len(lasts), self.spell, self.public
        while at > 0:
            t = lasts[at - 1]
            out.append(public[t])
            at -= len(spell[t])
        out.reverse()
        return tuple(out)

    def tokens(self, data: bytes) -> Iterator[list[int]]:
        """Public ids of one pre-token, in pieces: a piece holds what no further byte can change."""
        step, spell, state = self.step, self.spell, 0
        lasts: list[int] = []  # the last token of each prefix not yet emitted
        for begin in range(0, len(data), BLOCK):
            for byte in data[begin : begin + BLOCK]:
                nxt = step.get(state << 8 | byte)
                if nxt is None:
                    nxt = self._advance(state, byte)
                state, token = nxt
                lasts.append(token)
            end = len(lasts)
            if begin + BLOCK < len(data):
                # The earliest prefix that a later token may follow, and all in between, go back to a common one.
                starts = self.suffixes[self.states[state][0]][1]
                live = {end - starts[-1] + k for k in starts}
                while len(live) > 1:
                    top = max(live)
                    live.remove(top)
                    live.add(top - len(spell[lasts[top - 1]]))
                end = live.pop()
            piece = []
            at = end
            while at > 0:
                t = lasts[at - 1]
                piece.append(self.public[t])
                at -= len(spell[t])
            piece.reverse()
            del lasts[:end]
            yield piece

    def meet(self, words: Iterable[list[str]]) -> None:
        """Prepare for these pre-tokens: numbers not met before are encoded together, and kept until the next call."""
        self.numbers = {}
        self.numbers = self.coder.encode([w for w in set(chain.from_iterable(words)).difference(self.words) if w[-1].isdigit()])

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; null and empty texts give no ids."""
        return list(chain.from_iterable(map(self.words.__getitem__, pre_tokens(text)))) if text else []

    def count(self, text: str | None) -> int:
        return len(self.encode(text))

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(decode_stream(self.by_id, ids))


class NumberCoder:
    """The same transducer, run side by side over many numbers.

    Numbers make up most of the pre-tokens that are met only once. Their prefixes are read position by position for
    all of them at a time; a table answers which token ends at a place, a matrix which tokens stay apart. Numbers that
    hold a token of more than LONGEST symbols are left to the transducer itself.
    """

    LONGEST, BASE = 4, 11
    PLAIN = re.compile(" ?[0-9]{3,24}").fullmatch

    def __init__(self, t: Transducer):
        self.t = t
        own = [i for i, b in enumerate(t.spell) if b == b" " or re.fullmatch(rb" ?[0-9]+", b)]
        long = [t.spell[i].decode() for i in own if len(t.spell[i]) > self.LONGEST]
        # Long tokens with a blank can only begin a number; of the others those count that hold no other.
        self.skip_start = {x[: self.LONGEST + 1] for x in long if x[0] == " "}
        inner = [x for x in long if x[0] != " "]
        inner = [x for x in inner if not any(y != x and y in x for y in inner)]
        self.skip_inside = re.compile("|".join(inner) or "(?!)").search
        self.own = np.array([i for i in own if len(t.spell[i]) <= self.LONGEST])
        self.size = np.array([len(t.spell[i]) for i in self.own])
        self.public = np.array([t.public[i] for i in self.own])
        self.at = [np.full(self.BASE**k, -1, np.int32) for k in range(self.LONGEST + 1)]
        for j, i in enumerate(self.own):
            code = 0
            for byte in t.spell[i]:
                code = code * self.BASE + self._symbol(byte)
            self.at[len(t.spell[i])][code] = j
        # Rows are the token before (the last row: none), columns the token after; -1 is not known yet.
        self.apart = np.full((len(own) + 1, len(self.own)), -1, np.int8)
        self.start = len(own)
        self.apart[self.start] = 1
        self.keys = np.array(sorted(t.merged))
        self.ranks = np.array([t.merged[k] for k in self.keys])
        self.left, self.right = np.array(t.left), np.array(t.right)

    @staticmethod
    def _symbol(byte: int) -> int:
        return 10 if byte == 32 else byte - 48

    def _stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Transducer.stay_apart for arrays of tokens."""
        x, y = a.copy(), b.copy()
        before, known, open_ = np.full(len(x), len(self.left)), np.ones(len(x), bool), np.arange(len(x))
        while len(open_):
            key = x[open_] << 20 | y[open_]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            due = (self.keys[place] == key) & (self.ranks[place] < before[open_])
            known[open_[due]] = False
            open_ = open_[~due]
            left, right = self.left[x[open_]], self.left[y[open_]]
            more = (left >= 0) | (right >= 0)
            open_, left, right = open_[more], left[more], right[more]
            undo_x = (right < 0) | ((left >= 0) & (x[open_] > y[open_]))
            i, j = open_[undo_x], open_[~undo_x]
            before[i], before[j] = x[i], y[j] + 1
            x[i], y[j] = self.right[x[i]], right[~undo_x]
        return known

    def _read(self, words: Iterable[str]) -> Iterator[tuple[list[str], np.ndarray]]:
        """The numbers among the words, those of one length together, and the last token of each of their prefixes."""
        by_size: dict[int, list[str]] = {}
        for w in words:
            if self.PLAIN(w) and w[: self.LONGEST + 1] not in self.skip_start and not self.skip_inside(w):
                by_size.setdefault(len(w), []).append(w)
        for n, same in by_size.items():
            symbols = np.frombuffer("".join(same).encode(), np.uint8).reshape(len(same), n).astype(np.int64) - 48
            symbols[symbols < 0] = 10
            lasts = np.full((len(same), n + 1), self.start, np.int64)
            for i in range(1, n + 1):
                best, code, power = np.full(len(same), -1), np.zeros(len(same), np.int64), 1
                options = []
                for k in range(1, min(i, self.LONGEST) + 1):
                    code = code + symbols[:, i - k] * power
                    power *= self.BASE
                    options.append(self.at[k][code])
                for k in range(len(options), 0, -1):
                    token = options[k - 1]
                    rows = np.flatnonzero((token >= 0) & (best < 0))
                    prior, this = lasts[rows, i - k], token[rows]
                    fits = self.apart[prior, this]
                    if (fits < 0).any():
                        pairs = np.unique(prior[fits < 0] * len(self.own) + this[fits < 0])
                        p, q = np.divmod(pairs, len(self.own))
                        self.apart[p, q] = self._stay_apart(self.own[p], self.own[q])
                        fits = self.apart[prior, this]
                    best[rows[fits > 0]] = this[fits > 0]
                lasts[:, i] = best
            yield same, lasts

    def encode(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Public ids of the numbers among the words."""
        out: dict[str, tuple[int, ...]] = {}
        for same, lasts in self._read(words):
            place, every, back = np.full(len(same), lasts.shape[1] - 1), np.arange(len(same)), []
            while (place > 0).any():
                token = lasts[every, place]
                ended = place <= 0
                back.append(np.where(ended, -1, self.public[np.where(ended, 0, token)]))
                place = np.where(ended, 0, place - self.size[np.where(ended, 0, token)])
            for w, ids in zip(same, np.stack(back[::-1], 1).tolist(), strict=True):
                out[w] = tuple(x for x in ids if x >= 0)
        return out

    def sizes(self, words: Iterable[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """Numbers of tokens of the numbers among the words: lists of words, their sizes and whether they begin with a blank."""
        for same, lasts in self._read(words):
            n, open_ = np.zeros(len(same), np.int64), np.arange(len(same))
            place = np.full(len(same), lasts.shape[1] - 1)
            while len(open_):
                n[open_] += 1
                place = place - self.size[lasts[open_, place]]
                open_, place = open_[place > 0], place[place > 0]
            yield same, n, np.fromiter(map(str.isspace, [w[0] for w in same]), np.int64, len(same))


class _Words(dict):
    """Ids of pre-tokens met before; emptied when it holds too many."""

    def __init__(self, owner: Transducer):
        super().__init__()
        self.owner = owner

    def __missing__(self, word: str) -> tuple[int, ...]:
        out = self.owner.numbers.get(word)
        if out is not None:
            return out
        data = word.encode("utf-8", "replace")
        if len(self.owner.states) > MAX_STATES:
            self.owner._reset()
        out = self.owner._short(data) if len(data) <= BLOCK else tuple(chain.from_iterable(self.owner.tokens(data)))
        if len(word) <= TABLE_LENGTH:
            if len(self) >= TABLE_WORDS:
                self.clear()
            self[word] = out
        else:  # asked for again within a text, hardly after it
            if len(self.owner.numbers) >= TABLE_WORDS:
                self.owner.numbers.clear()
            self.owner.numbers[word] = out
        return out


def open_bytes(tail: bytes) -> int:
    """How many bytes at the end begin a character that is not complete yet."""
    for back in range(1, min(3, len(tail)) + 1):
        b = tail[-back]
        if b & 0b1100_0000 == 0b1000_0000:
            continue  # goes on
        need = 4 if b >= 0xF0 else 3 if b >= 0xE0 else 2 if b >= 0xC0 else 1
        return back if need > back else 0
    return 0


def decode_stream(by_id: dict[int, bytes], ids: Iterable[int]) -> Iterator[str]:
    """Text of ids as they come: complete characters at once, an open one when its last byte has come."""
    held = b""
    for i in ids:
        held += by_id[i]
        n = len(held) - open_bytes(held)
        if n:
            yield held[:n].decode("utf-8", "replace")
            held = held[n:]
    if held:
        yield held.decode("utf-8", "replace")


@cache
def transducer(vocabulary: str = VOCABULARY) -> Transducer:
    made = Transducer(vocabulary)
    gc.collect()
    gc.freeze()  # the tables live as long as the process: nothing to look for in them
    gc.set_threshold(100_000, 50, 100)
    return made


def _batches(of: Callable[[Transducer, list[str | None]], pa.Array], name: str, vocabulary: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocabulary)
        for b in batches:
            at = b.schema.get_field_index(name)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns) if i != at), of(t, b.column(at).to_pylist())], names=[*(n for i, n in enumerate(b.schema.names) if i != at), "_tok"])

    return run


def in_parts(texts: list[str | None]) -> Iterator[list[list[str]]]:
    """Pre-tokens of the texts, some texts at a time."""
    begin = 0
    while begin < len(texts):
        part, size = [], 0
        while begin < len(texts) and size < PART_CHARS:
            text = texts[begin]
            part.append(pre_tokens(text) if text else [])
            size += len(text or "") + 1
            begin += 1
        yield part


class Described(dict):
    """A number by pre-token, made by `of` when first met; emptied when it holds too many.

    Digits are met once and make up most of the new pre-tokens: those of a part are sized together, and left out after it.
    """

    def __init__(self, t: Transducer, of: Callable[[Transducer, str], int], of_number: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        super().__init__()
        self.t, self.of, self.of_number = t, of, of_number

    def __missing__(self, word: str) -> int:
        out = self.of(self.t, word)
        if len(word) <= TABLE_LENGTH:
            self[word] = out
        return out

    def all(self, words: list[str]) -> np.ndarray:
        """The numbers of these pre-tokens."""
        if len(self) > TABLE_WORDS:
            self.clear()
        digits: dict[str, int] = {}
        for same, sizes, blank in self.t.coder.sizes([w for w in set(words).difference(self) if w[-1].isdigit()]):
            digits.update(zip(same, self.of_number(sizes, blank).tolist(), strict=True))
        self.update(digits)
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        for w in digits:
            del self[w]
        return out


def _ids(t: Transducer, texts: list[str | None]) -> pa.Array:
    flat, sizes = [], []
    for part in in_parts(texts):
        t.meet(part)
        for words in part:
            flat.append(np.fromiter(chain.from_iterable(map(t.words.__getitem__, words)), np.int32))
            sizes.append(len(flat[-1]))
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32)))


def _counts(t: Transducer, texts: list[str | None]) -> pa.Array:
    known = t.sizes
    out = []
    for part in in_parts(texts):
        before = np.concatenate([[0], np.cumsum(known.all(list(chain.from_iterable(part))))])
        ends = np.cumsum([len(words) for words in part])
        out.append(np.diff(before[ends], prepend=0))
    return pa.array(np.concatenate(out) if out else np.empty(0, np.int64), pa.int64())


def _apply(df: DataFrame, text: str, out: str, kind: str, of: Callable, vocabulary: str) -> DataFrame:
    keep = [c for c in df.columns if c != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != text), f"`_tok` {kind}"])
    return df.mapInArrow(_batches(of, text, vocabulary), schema).select(*keep, F.col("_tok").alias(out))


def encode(df: DataFrame, text: str = "text", out: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """df with the column `text` replaced by `out`, the list of token ids; null and empty texts give an empty list.

    Rows are neither dropped nor merged; all other columns are kept. A text without any break is read whole.
    """
    return _apply(df, text, out, "array<int>", _ids, vocabulary)


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """df with the column `text` replaced by `out`, its number of tokens (0 for null and empty texts)."""
    return _apply(df, text, out, "bigint", _counts, vocabulary)


def decode(df: DataFrame, ids: str = "ids", out: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """df with the list column `ids` replaced by its text; an empty or null list gives an empty text."""

    def texts(t: Transducer, lists: list[list[int] | None]) -> pa.Array:
        return pa.array([t.decode(x or ()) for x in lists], pa.string())

    return _apply(df, ids, out, "string", texts, vocabulary)
