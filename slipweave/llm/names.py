"""Problem 5: link the spellings of one person or organisation within an owner's slips.

Names are brought to one form (problem 4), stripped of titles and legal forms and cut into tokens. A symmetric-delete
index finds candidates: each name is filed under every one-character deletion of each of its tokens together with the
first letter of another token, so two names meet if one token differs by at most one edit and the other keeps its
initial. Candidates are compared by the optimal assignment of their tokens: equal ones first, then those left, of which
one may be imperfect (an edit, a cut, an abbreviation or an initial) or two may have an edit each. A person's middle
names may be left out. An edit is believed unless both spellings are established tokens: the
rarer one is used by several owners and not much rarer than the other, or the nickname reference has both. A cut is
believed only while it is likelier than another party of that very name, judged by how often the token occurs in all
names and by the number of the owner's names.
Links are closed to groups; a name with an initial joins a group only if no other group fits it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipweave.llm import groups, lookalike
from slipweave.sources.tables import Scratch

# Titles, legal forms and branch words.
TITLES = {"mr", "mrs", "ms", "miss", "mx", "dr", "prof", "sir", "madam", "khun", "herr", "frau"}
THAI_TITLE = re.compile(r"^(?:นางสาว|น\.\s?ส\.|นาง|นาย|คุณ|ด\.\s?ช\.|ด\.\s?ญ\.|ดร\.)\s*")
LEGAL = {"co", "ltd", "company", "limited", "inc", "llc", "plc", "corp", "corporation", "gmbh", "ag", "the", "pte", "pcl"}
THAI_LEGAL = re.compile(r"^(?:บริษัท|บจก\.?|บมจ\.?|หจก\.?|ห้างหุ้นส่วนจำกัด|บ\.)\s*|\s*(?:จำกัด|จก\.?)(?:\s*\(มหาชน\))?$")
BRANCH = re.compile(r"[(\[]?\s*(?:branch|สาขา)\s*(?:no\.?\s*)?(?:ที่\s*)?(\d+)\s*[)\]]?")
NICK = re.compile(r"\([^()]*\)")
WORD = re.compile(r"[^\s,;/()&+-]+")

#: Chance that a spelling of a party has one given cut.
CUT_ODDS = 2e-3
#: A token of at least so many owners is established beside another one unless it is so many times rarer.
SPREAD, RIVAL = 3, 20
#: Share of parties with a relative of the same surname among the owner's names.
RELATIVES = 0.2
#: An abbreviation is so many times rarer than its word, and a misprint than the word it spoils.
RARER, MISPRINT = 5, 100
#: Letters of a token that may have an edit beside another token with one.
LONG_TOKEN = 6
#: Rows of one index key above which the rows of the key are spread over several tasks.
HOT_KEY = 20_000
#: Tokens of at least this share of all names are counted; at most (tokens a name) / LEAST_SHARE of them exist.
LEAST_SHARE = 1e-5


def parse(name: str) -> tuple[list[str], list[str], str, str]:
    """(full tokens, initials, branch, kind) of a name in its one form; kind is 'o', 'p' or '' where nothing tells."""
    s, kind, branch = name.casefold().strip(), "", ""
    if m := BRANCH.search(s):
        branch, kind = str(int(m.group(1))), "o"
        s = s[: m.start()] + " " + s[m.end() :]
    s = NICK.sub(" ", s).strip(" .,")
    while (cut := THAI_LEGAL.sub("", s).strip()) != s:
        s, kind = cut, "o"
    if kind != "o" and (cut := THAI_TITLE.sub("", s)) != s and cut:
        s, kind = cut, "p"
    words = WORD.findall(s)
    if len(words) >= 4 and sum(len(w.strip(".")) <= 2 for w in words) * 5 >= 4 * len(words):
        words = ["".join(words)]
    plain = [w.strip(".'\"") for w in words]
    if any(w in LEGAL - {"the"} for w in plain):
        kind = "o"
        words = [w for w, p in zip(words, plain, strict=True) if p not in LEGAL] or words
    while len(words) > 1 and words[0].strip(".") in TITLES:
        words, kind = words[1:], "p"
    if len(words) > 2 and words[0] in ("k.", "k") and sum(len(w.strip(".")) > 1 for w in words[1:]) > 1:
        words, kind = words[1:], "p"
    full, initials = [], []
    for w in words:
        bare = w.strip(".'\"")
        if len(bare) > 1:
            full.append(bare + "." if w.endswith(".") else bare)
        elif bare:
            initials.append(bare)
    full = [w if w.endswith(".") and kind != "p" and len(w) <= 6 else w.rstrip(".") for w in full]
    return full, initials, branch, kind


def deletions(token: str) -> set[str]:
    return {token, *(token[:i] + token[i + 1 :] for i in range(len(token)))} if len(token) > 3 else {token}


def one_edit(a: str, b: str) -> bool:
    """One insertion, deletion, substitution or swap of neighbours apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i + 1 : i + 2] == b[i : i + 1] and b[i + 1 : i + 2] == a[i : i + 1] and a[i + 2 :] == b[i + 2 :])


def abbreviates(short: str, long: str) -> bool:
    """Same first letter, and the letters of short occur in long in order."""
    if len(short) < 2 or len(short) >= len(long) or short[0] != long[0]:
        return False
    rest = iter(long)
    return all(c in rest for c in short)


class Matcher:
    """Compares two parsed names of one owner."""

    def __init__(self, shares: dict[str, float], total: int, nicknames: dict[str, set[str]], spread: set[str] = frozenset()):
        """spread has the tokens of at least SPREAD owners."""
        self.shares, self.least, self.nick, self.spread = shares, 0.5 / max(total, 1), nicknames, spread
        self.reference = {*nicknames, *(g for gs in nicknames.values() for g in gs)}

    def share(self, token: str) -> float:
        return self.shares.get(token, self.least)

    def given(self, token: str) -> set[str]:
        return self.nick.get(token, set())

    def relation(self, a: str, b: str) -> tuple[str, str]:
        """(kind, rarer token) with kind '=' equal, 'n' nickname, 'b' abbreviation, 'e' edit, 'c' cut, '' none."""
        x, y = a.rstrip("."), b.rstrip(".")
        if x == y:
            return "=", x
        if y in self.given(x) or x in self.given(y) or self.given(x) & self.given(y):
            return "n", x
        short, long = (x, y) if len(x) < len(y) else (y, x)
        rare = min(x, y, key=lambda t: (self.share(t), len(t)))
        dotted = (a if len(x) < len(y) else b).endswith(".")
        if dotted and abbreviates(short, long):
            return "b", short
        if min(len(x), len(y)) > 3 and one_edit(x, y):
            return "e", rare
        if len(short) >= 3 and long.startswith(short):
            return "c", short
        if abbreviates(short, long) and len(short) * 3 <= len(long) * 2 and self.share(short) * RARER < self.share(long):
            return "b", short
        return "", ""

    def established(self, rare: str, usual: str) -> bool:
        """Whether two tokens one edit apart are both names of their own; owner and table size do not matter."""
        return (rare in self.reference and usual in self.reference) or (rare in self.spread and self.share(rare) * RIVAL > self.share(usual))

    def likely(self, kind: str, rare: str, usual: str, other: str, names: int) -> bool:
        """Whether the difference is likelier than a second party of that name."""
        if kind in "=nb" or (kind == "e" and self.share(rare) * MISPRINT < self.share(usual)):
            return True
        if kind == "e":
            return not self.established(rare, usual)
        return max(names * self.share(other) * self.share(rare), RELATIVES * self.share(rare)) < CUT_ODDS

    def compare(self, a: tuple, b: tuple, names: int) -> str:
        """'s' for the same party, 'w' if only an initial speaks for it, '' for different parties."""
        (fa, ia, ba, ka), (fb, ib, bb, kb) = a, b
        if ba != bb or (ka and kb and ka != kb):
            return ""
        if "".join(fa).replace(".", "") == "".join(fb).replace(".", "") and (len(fa) > 1 or len(fb) > 1 or not (ia or ib)):
            return "s"
        if len(fa) > len(fb):
            fa, ia, fb, ib = fb, ib, fa, ia
        if len(fa) == len(fb) and len(fa) >= 2:
            return self._assign(fa, fb, names)
        if 2 <= len(fa) < len(fb):
            return self._dropped(fa, fb) if "o" not in (ka, kb) and not ia and not ib else ""
        if len(fa) == 1 and len(fb) == 1:
            if bool(ia) != bool(ib):
                return ""
            kind, rare = self.relation(fa[0], fb[0])
            if ia:
                return "s" if kind == "=" and set(ia) & set(ib) else ""
            return "s" if kind in ("e", "c") and len(fa[0]) > 5 and self.likely(kind, rare, max(fa[0], fb[0], key=self.share), rare, 1) else ""
        if len(fa) == 1 and len(fb) >= 2:
            if ia:
                for k, t in enumerate(fb):
                    kind, rare = self.relation(fa[0], t)
                    rest = [u for j, u in enumerate(fb) if j != k]
                    firsts = {u[0] for u in rest} | {g[0] for u in rest for g in self.given(u)}
                    if kind and firsts & set(ia) and self.likely(kind, rare, max(fa[0], t, key=self.share), rest[0], names):
                        return "w"
                return ""
            joined = ["".join(p) for p in permutations(x.rstrip(".") for x in fb)] if len(fb) <= 3 else ["".join(fb)]
            if fa[0] in joined:
                return "s"
            return "s" if any(one_edit(fa[0], j) for j in joined) and len(fa[0]) > 7 else ""
        return ""

    def _dropped(self, fa: list[str], fb: list[str]) -> str:
        """A person's name with middle names left out: first and last are the same, the others come in the same order."""
        same = lambda x, y: self.relation(x, y)[0] in ("=", "n")
        if not (same(fa[0], fb[0]) and same(fa[-1], fb[-1])):
            return ""
        rest = iter(fb[1:-1])
        return "s" if all(any(same(x, y) for y in rest) for x in fa[1:-1]) else ""

    def _assign(self, fa: list[str], fb: list[str], names: int) -> str:
        """Optimal assignment of as many tokens to as many, whatever their number.

        Equal tokens are paired first, which no better pairing can undo. Of those left all must be paired; a nickname of the
        reference is as good as the name itself, one token may be imperfect, or two long ones may have an edit each.
        """
        bare = lambda t: t.rstrip(".")
        common = Counter(map(bare, fa)) & Counter(map(bare, fb))

        def left(tokens: list[str]) -> list[str]:
            have, out = Counter(common), []
            for t in tokens:
                if have[bare(t)] > 0:
                    have[bare(t)] -= 1
                else:
                    out.append(t)
            return out

        ra, rb = left(fa), left(fb)
        if not ra:
            return "s"
        table = [[self.relation(x, y) for y in rb] for x in ra]
        best: tuple[int, tuple] = (3, ())
        todo = [(0, ())]  # cost so far, partners of the first tokens
        while todo:
            cost, order = todo.pop()
            if (cost, order) >= best:
                continue
            if len(order) == len(ra):
                best = (cost, order)
                continue
            todo += [(cost + (kind not in "=n"), (*order, j)) for j, (kind, _) in enumerate(table[len(order)]) if kind and j not in order]
        if best[0] > 2:
            return ""
        odd = [(ra[i], rb[j], *table[i][j]) for i, j in enumerate(best[1]) if table[i][j][0] not in "=n"]
        if len(odd) == 2 and not all(kind == "e" and min(len(x), len(y)) >= LONG_TOKEN for x, y, kind, _ in odd):
            return ""
        for x, _, kind, rare in odd:
            others = [t for t in fa if t != x] or [x]
            y = next(q for p, q, *_ in odd if p == x)
            if not self.likely(kind, rare, max(bare(x), bare(y), key=self.share), bare(min(others, key=self.share)), names):
                return ""
        return "s"


def keys_of(parsed: tuple, given: dict[str, set[str]]) -> set[str]:
    """Index keys of a name: deletions of a token with the initial of another one, and of the joined name."""
    full, initials, branch, _ = parsed
    bare = [t.rstrip(".") for t in full]
    out = set()
    for i, x in enumerate(bare):
        firsts = {u[0] for j, u in enumerate(bare) if j != i}
        near = {g[0] for j, u in enumerate(bare) if j != i for g in given.get(u, ())}
        if len(bare) == 1:
            firsts = set(initials)
        for d in deletions(x):
            out.update(f"{branch}|{d}|{c}" for c in firsts | near)
    if len(bare) == 1 and not initials:
        out.update(f"{branch}||{d}" for d in deletions(bare[0]))
    elif 1 < len(bare) <= 3:
        out.update(f"{branch}||{''.join(p)}" for p in permutations(bare))
        if not bare[0].isascii():
            out.update(f"{branch}||{d}" for d in deletions("".join(bare)))
    return out


_PARSED = "user_id string, form string, id long, full array<string>, initials array<string>, branch string, kind string"


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        p = [parse(x) for x in b["form"]]
        yield b.assign(full=[x[0] for x in p], initials=[x[1] for x in p], branch=[x[2] for x in p], kind=[x[3] for x in p])


def _unpack(b: pd.DataFrame, side: str) -> Iterator[tuple]:
    return zip(map(list, b["full" + side]), map(list, b["initials" + side]), b["branch" + side], b["kind" + side], strict=True)


def link_names(names: DataFrame, nicknames: DataFrame, scratch: Scratch) -> DataFrame:
    """(user_id, form, party) of every name form; party is one number for all spellings of a party within an owner.

    names has user_id and form; repeated rows count once, rows with a null in either are left out and blank names
    stay alone. nicknames has given_name and nickname (a reference table of a few dozen rows). An empty table gives no rows.
    """
    spark: SparkSession = names.sparkSession
    base = names.select("user_id", "form").where(F.col("user_id").isNotNull() & F.col("form").isNotNull()).distinct()
    # Numbers are given once and stored, so no two names share one.
    parsed = scratch.write(base.withColumn("id", F.monotonically_increasing_id()).mapInPandas(_parse_batches, _PARSED), "parsed")
    total = parsed.count()
    given: dict[str, set[str]] = {}
    for r in nicknames.where("given_name is not null and nickname is not null").select("given_name", "nickname").collect():  # a reference table
        given.setdefault(r.nickname.casefold(), set()).add(r.given_name.casefold())
    # Combined by owner first, so that no owner's rows of a frequent token meet in one task.
    tokens = parsed.select("user_id", F.explode(F.expr("array_distinct(transform(full, t -> rtrim('.', t)))")).alias("t")).groupBy("t", "user_id").agg(F.count("*").alias("n"))
    tokens = tokens.groupBy("t").agg(F.sum("n").alias("n"), (F.count("*") >= SPREAD).alias("spread")).where(F.col("n") >= max(2, total * LEAST_SHARE))
    shares: dict[str, float] = {}
    spread: set[str] = set()
    for t, n, wide in tokens.toLocalIterator():  # bounded by LEAST_SHARE
        shares[t] = n / total
        if wide:
            spread.add(t)
    known = spark.sparkContext.broadcast((shares, given, spread))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, nick, _ = known.value
        for b in batches:
            keys = [sorted(keys_of(p, nick)) for p in _unpack(b, "")]
            yield b[["user_id", "id"]].assign(k=keys)

    filed = parsed.select("user_id", "id", "full", "initials", "branch", "kind").mapInPandas(index, "user_id string, id long, k array<string>")
    filed = scratch.write(filed.select("id", F.explode("k").alias("k"), "user_id").select("id", F.xxhash64("user_id", "k").alias("k")), "keys")
    pairs = _meetings(filed).distinct()
    sizes = parsed.groupBy("user_id").agg(F.count("*").alias("names"))
    payload = parsed.select("id", "user_id", "full", "initials", "branch", "kind")
    side = lambda x: payload.select(*[F.col(c).alias(c + x) for c in payload.columns])
    joined = pairs.join(side("_a"), "id_a").join(side("_b"), "id_b").where(F.col("user_id_a") == F.col("user_id_b")).join(sizes.withColumnRenamed("user_id", "user_id_a"), "user_id_a")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sh, nick, wide = known.value
        matcher = Matcher(sh, total, nick, wide)
        for b in batches:
            says = [matcher.compare(p, q, n) for p, q, n in zip(_unpack(b, "_a"), _unpack(b, "_b"), b["names"], strict=True)]
            weak_a = b["full_a"].map(len).eq(1) & b["initials_a"].map(len).gt(0)
            yield b[["id_a", "id_b"]].assign(says=says, weak_a=weak_a)[lambda x: x["says"] != ""]

    links = scratch.write(joined.mapInPandas(verify, "id_a long, id_b long, says string, weak_a boolean"), "links")
    grouped = groups.connected_groups(links.where("says = 's'"), "id_a", "id_b", scratch)
    party = scratch.write(parsed.select("user_id", "form", "id").join(grouped, "id", "left").select("user_id", "form", "id", F.coalesce("group_id", "id").alias("g")), "groups")
    weak = links.where("says = 'w'").select(F.when(F.col("weak_a"), F.col("id_a")).otherwise(F.col("id_b")).alias("w"), F.when(F.col("weak_a"), F.col("id_b")).otherwise(F.col("id_a")).alias("f"))
    to = party.select("id", "g")
    weak = weak.join(to.withColumnsRenamed({"id": "w", "g": "gw"}), "w").join(to.withColumnsRenamed({"id": "f", "g": "gf"}), "f")
    only = weak.groupBy("gw").agg(F.min("gf").alias("lo"), F.max("gf").alias("hi")).where(F.col("lo") == F.col("hi")).select(F.col("gw").alias("g"), F.col("lo").alias("to"))
    return party.join(only, "g", "left").select("user_id", "form", F.coalesce("to", "g").alias("party"))


def _meetings(filed: DataFrame) -> DataFrame:
    """(id_a, id_b) of the names filed under one key. The rows of a key of many names are spread: each meets all others in
    one of several tasks, so none is dropped and no task holds all pairs."""
    hot = filed.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > HOT_KEY).select("k", F.ceil(F.col("n") / HOT_KEY).cast("int").alias("parts"))
    met = lambda a, b, keys: a.join(b, keys).where(F.col("id_a") < F.col("id_b")).select("id_a", "id_b")
    if not hot.take(1):  # nothing to spread: one shuffle of the keys is enough
        return met(filed.withColumnRenamed("id", "id_a"), filed.withColumnRenamed("id", "id_b"), ["k"])
    marked = filed.join(hot, "k", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    a = marked.select("k", F.col("id").alias("id_a"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    b = marked.select("k", F.col("id").alias("id_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return met(a, b, ["k", "part"])


def slip_names(reads: DataFrame) -> DataFrame:
    """(user_id, value, form) of receiver and sender names together; null values are left out."""
    field = lambda f: reads.select("user_id", F.col(f)["value"].alias("value"))
    both = field("receiver_name").unionByName(field("sender_name")).where(F.col("value").isNotNull() & F.col("user_id").isNotNull())
    return lookalike.with_one_form(both, "value", "form")


def slip_parties(reads: DataFrame, nicknames: DataFrame, scratch: Scratch) -> DataFrame:
    """(user_id, value, party) of every name as stored."""
    values = scratch.write(slip_names(reads), "values")
    linked = link_names(values, nicknames, scratch)
    return scratch.write(values.join(linked, ["user_id", "form"]).select("user_id", "value", "party"), "parties")
