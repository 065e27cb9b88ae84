"""Text read in another encoding than it was written in: noisy-channel decoding over byte lattices."""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.llm.wordlist import SortedTable, sorted_table
from reelspan.session import cut_lineage, small_rows

# Names of the codecs a text may have been read in, and those it may have been written in.
READ = ["cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "cp852", "cp866", "koi8-r", "mac-roman", "mac-cyrillic", "iso8859-2", "iso8859-5", "iso8859-15", "cp1254", "cp932", "gbk", "big5", "euc-kr", "euc-jp"]
WIDE = ["utf-8", "cp932", "euc-jp"]
NARROW = ["cp1252", "cp1250", "cp1251", "koi8-r", "cp866", "mac-roman", "iso8859-2", "cp437", "cp850"]
MULTIBYTE_READ = frozenset(["cp932", "gbk", "big5", "euc-kr", "euc-jp"])
LOST = "�"
#: Natural logarithms of the odds against entering a channel, by what was written, and for each further reading; of leaving it.
ENTER_WIDE, ENTER_NARROW, AGAIN, LEAVE = 5.0, 9.0, 2.0, 1.0
#: Against a narrow reading that turns what may be a word into none that the corpus has; again for each mark that becomes a letter.
DOUBT = 9.0
FLOOR = 1e-7
#: What is added to the count of a character: some two of a class are met for the first time, out of a thousand there are.
UNSEEN = 0.002
_NON_ASCII = re.compile(r"[^\x00-\x7f]")
_RUN = re.compile(r"[^\x00-\x7f]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_LETTER = re.compile(r"[^\W\d_]")
_JOINTS = frozenset("'’-")
_UNNATURAL = frozenset("zxyY")
#: Classes of letters of which the scripts are not written together.
_SCRIPTS = {**dict.fromkeys("aAlL", "l"), **dict.fromkeys("cC", "c"), **dict.fromkeys("gG", "g"), "o": "o"}


@lru_cache(maxsize=70_000)
def kind_of(c: str) -> str:
    """The class of a character that the transitions are counted over; there are about twenty."""
    o = ord(c)
    if o < 128:
        return "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if c.isdigit() else "."
    cat = unicodedata.category(c)
    if cat in ("Cc", "Co", "Cn", "Cs") or c == LOST:
        return "z"
    if o == 0xA0:
        return "_"
    if cat[0] == "L" or cat[0] == "M":
        name = unicodedata.name(c, "")
        for start, k in (("LATIN", "l"), ("CYRILLIC", "c"), ("GREEK", "g"), ("HIRAGANA", "h"), ("KATAKANA", "k"), ("HALFWIDTH", "w"), ("CJK", "H"), ("HANGUL", "o")):
            if name.startswith(start):
                return k.upper() if k in "lcg" and cat == "Lu" else k
        return "y" if cat[0] == "M" else "i" if c in "ªºµ" else "Y"
    if 0x2500 <= o <= 0x259F or 0x2300 <= o <= 0x23FF or o == 0x20A7:
        return "x"
    return "p" if cat[0] == "P" else "s"


class _Kinds(dict):
    """For ``str.translate``: the class of every character, found when it is first met."""

    def __missing__(self, o: int) -> str:
        self[o] = k = kind_of(chr(o))
        return k


_KINDS = _Kinds()


def kinds_of(s: str) -> str:
    """The classes of the characters of a text."""
    return s.translate(_KINDS)


def _to_bytes(s: str, codec: str) -> bytes | None:
    """What was read, as bytes; the bytes a Windows code page leaves open may have come through as control characters."""
    try:
        return s.encode(codec)
    except UnicodeEncodeError:
        if codec not in ("cp1252", "cp1250", "cp1251", "cp1254"):
            return None
    out = bytearray()
    for c in s:
        try:
            out += c.encode(codec)
        except UnicodeEncodeError:
            if 0x80 <= ord(c) <= 0x9F:
                out.append(ord(c))
            else:
                return None
    return bytes(out)


def _from_bytes(b: bytes, codec: str) -> str | None:
    try:
        return b.decode(codec)
    except UnicodeDecodeError as e:
        # an ending blank of two bytes may have lost its second to a trimming
        if codec == "utf-8" and e.start == len(b) - 1 and b[-1] in (0xC3, 0xC2) and len(b) > 1:
            try:
                return (b + b"\xa0").decode(codec)
            except UnicodeDecodeError:
                return None
        return None


def _natural(s: str) -> bool:
    return _UNNATURAL.isdisjoint(kinds_of(s))


def looks_misread(token: str) -> bool:
    """Whether a token may not be counted as written: it is a strict multi-byte text under some code page, or has lost characters."""
    if LOST in token or any("\x7f" < c < "\xa0" for c in token):
        return True
    for b, read in _as_bytes(token).items():
        for w in WIDE:
            t = _from_bytes(b, w) if read != [w] else None
            if t is None or t == token or not _natural(t):
                continue
            # of Japanese, kana are the sign: letters of other scripts come out as ideographs too
            if w == "utf-8" or sum(k in "hk" for k in kinds_of(t)) * 3 > len(t):
                return True
    return False


def _as_bytes(token: str) -> dict[bytes, list[str]]:
    """The bytes that a token may have been read from, and the codecs of ``READ`` that read them so."""
    out: dict[bytes, list[str]] = {}
    can = -1
    for c in _NON_ASCII.findall(token):
        can &= _codecs_with(c)
    for i, r in enumerate(READ):
        if can >> i & 1:
            b = _to_bytes(token, r)
            if b is not None:
                out.setdefault(b, []).append(r)
    return out


@lru_cache(maxsize=70_000)
def _codecs_with(c: str) -> int:
    """The codecs of ``READ`` that have a character, as bits."""
    return sum(1 << i for i, r in enumerate(READ) if _to_bytes(c, r) is not None)


@lru_cache(maxsize=100)
def _script(kind: str) -> frozenset[str]:
    """The script of a class of letters, of those that are not written together."""
    k = kind.lower()
    return frozenset((k if k in "cgo" else "l",) if k in "alcgo" else ())


def _mixed(word: str) -> bool:
    """Whether a word has letters of more than one of the scripts that are not written together."""
    return not word.isascii() and len({_SCRIPTS.get(k) for k in set(kinds_of(word))} - {None}) > 1


def pieces_of(token: str) -> Counter:
    """What a token adds to the counts: ``w`` words, ``c`` characters, ``t`` transitions of classes."""
    out: Counter = Counter()
    if any(_mixed(m[0]) for m in _WORD.finditer(token)):
        return out
    for m in _WORD.finditer(token):
        out["w" + m[0].lower()] += 1
    last = "^"
    for c in token:
        k = kind_of(c)
        out["c" + c] += 1
        out["t" + last + k] += 1
        last = k
    out["t" + last + "$"] += 1
    return out


def without_echoes(words: dict[str, int], times: int = 20, count: Callable[[str], int | None] | None = None) -> dict[str, int]:
    """``words`` less those that are a misreading, in narrow code pages, of words at least ``times`` as frequent by ``count``, if given, else in ``words``."""
    count = count or words.get

    def echo(word: str, n: int) -> bool:
        for channels, t in Model._undo(word):
            if channels[0][1] in NARROW:
                found = [m[0].lower() for m in _WORD.finditer(t)]
                if found and all((count(w) or 0) >= times * n for w in found):
                    return True
        return False

    return {w: n for w, n in words.items() if w.isascii() or not echo(w, n)}


def mask_of(word: str) -> str:
    return _RUN.sub(lambda m: LOST * len(m[0]), word)


@dataclass(frozen=True)
class RareWords:
    """Words too many for a broadcast, in the shared folder: their counts, and of each mask the sum and the most frequent."""

    words: SortedTable
    masks: SortedTable
    total: int

    def count(self, word: str) -> int | None:
        row = self.words.row(word)
        return row[0] if row else None


class Model:
    """Costs (negative logarithms) of texts under the counts of a corpus."""

    def __init__(self, words: dict[str, int], chars: dict[str, int], steps: dict[str, int], rare: RareWords | None = None) -> None:
        self.words, self.chars, self.rare = words, chars, rare
        self.n_words = max(1, sum(words.values()) + (rare.total if rare else 0))
        by_kind: Counter = Counter()
        for c, n in chars.items():
            by_kind[kind_of(c)] += n
        self.by_kind = by_kind
        from_: Counter = Counter()
        for s, n in steps.items():
            from_[s[0]] += n
        self.steps = steps
        self.step = {s: -math.log(max(FLOOR, n / from_[s[0]])) for s, n in steps.items()}
        self.masks: dict[str, list[tuple[int, str]]] = {}
        for w, n in words.items():
            self.masks.setdefault(mask_of(w), []).append((n, w))
        self.by_lead: dict[tuple[int, int], list[str]] = {}
        for c in sorted((c for c in chars if ord(c) > 127 and kind_of(c) not in "zx"), key=lambda c: -chars[c]):
            b = c.encode("utf-8", "replace")
            for lead in (b[0], -1):
                self.by_lead.setdefault((len(b), lead), []).append(c)
        self.sorted_words = sorted(words)
        self.count = lru_cache(maxsize=200_000)(self._count)
        self.after = lru_cache(maxsize=200_000)(self._after)
        self.matching = lru_cache(maxsize=20_000)(self._matching)
        self.cached_cost = lru_cache(maxsize=200_000)(self._cost)
        self.readings = lru_cache(maxsize=100_000)(self._readings)
        self.char = lru_cache(maxsize=70_000)(self._char)

    def _char(self, c: str) -> float:
        k = kind_of(c)
        if k == "z":
            return 14.0
        if k == "x":  # frames and technical signs: in running text, the marks of old code pages
            return 9.0
        return -math.log((self.chars.get(c, 0) + UNSEEN) / (self.by_kind.get(k, 0) + 8.0))

    def _cost(self, s: str) -> float:
        """Characters by class transition and frequency inside the class; a known word costs its own frequency if less."""
        total, at, last = 0.0, 0, "^"
        worst = -math.log(FLOOR)

        def spell(part: str, last: str) -> tuple[float, str]:
            cost = 0.0
            for c, k in zip(part, kinds_of(part)):
                cost += self.step.get(last + k, worst) + self.char(c)
                last = k
            return cost, last

        for m in _WORD.finditer(s):
            cost, last = spell(s[at : m.start()], last)
            total += cost
            known = self.count(m[0].lower())
            cost, after = spell(m[0], last)
            if _mixed(m[0]):
                cost += 8.0
            elif known:
                odd = m[0] not in (m[0].lower(), m[0].upper(), m[0].capitalize(), m[0].title())
                cost = min(cost, -math.log(known / self.n_words) + (8.0 if odd else 1.0))
            total, last, at = total + cost, after, m.end()
        cost, last = spell(s[at:], last)
        return total + cost + self.step.get(last + "$", worst)

    def _as_blanks(self, token: str) -> float:
        """The cost of a token whose no-break spaces are blanks between words, as written ones mostly are."""
        parts = token.split("\xa0")
        if len(parts) == 1:
            return math.inf
        blank = -math.log((self.chars.get("\xa0", 0) + 0.5) / (self.n_words + 1.0))
        # a part of ASCII only is a token of its own, which is never weighed: only its signs, as they are in any reading
        return sum(sum(map(self.char, p)) if p.isascii() else self.cached_cost(p) for p in parts) + blank * (len(parts) - 1)

    def _readings(self, token: str) -> dict[tuple, tuple[float, str]]:
        """Of each channel (read, written[, read, written]) that the token can have come through: (cost of what it was less cost as it is, what it was)."""
        own = min(self.cached_cost(token), self._as_blanks(token))
        natural = _natural(token) and not any(_mixed(m[0]) for m in _WORD.finditer(token))
        out: dict[tuple, tuple[float, str]] = {}
        if LOST in token:
            for channel, t in self._lattices(token).items():
                out[channel] = (self.cached_cost(t) - own, t)
            return out
        for channels, t in self._undo(token):
            kinds = kinds_of(t)
            wide = channels[0][1] not in NARROW
            if "z" not in kinds and "x" not in kinds and (channels[0][1] == "utf-8" or not wide or "h" in kinds or "k" in kinds):
                cost = self.cached_cost(t) - own
                if not wide and natural and cost < 0 and not all(self.count(m[0].lower()) for m in _WORD.finditer(t)):
                    cost += DOUBT * (1 + sum(kind_of(c) == "p" for c in token))
                if cost < 0:
                    out.update((channel, (cost, t)) for channel in channels)
            if channels[0][1] == "utf-8" and not t.isascii():
                for again, u in self._undo(t):
                    if again[0][1] == "utf-8" and u != token:
                        kinds = kinds_of(u)
                        cost = self.cached_cost(u) - own if "z" not in kinds and "x" not in kinds else 0.0
                        if cost < 0:
                            out.update((channel + a, (cost, u)) for channel in channels for a in again)
        return out

    @staticmethod
    def _undo(token: str) -> Iterator[tuple[list[tuple[str, str]], str]]:
        """(channels, text) of what a token may have been: codecs that read the same bytes are tried once."""
        for b, read in _as_bytes(token).items():
            narrow = [r for r in read if r not in MULTIBYTE_READ]
            for w in (*WIDE, *(NARROW if narrow else ())):
                by = narrow if w in NARROW else read
                t = _from_bytes(b, w) if by != [w] else None
                if t and t != token and min(t) >= " ":
                    yield [(r, w) for r in by if r != w], t

    def _lattices(self, token: str) -> dict[tuple, str]:
        """Best text of a token with lost characters, by channel: known bytes and wildcards, searched under the corpus."""
        out: dict[tuple, str] = {}
        # bytes of one narrow code page, each lost for itself when it was read as UTF-8: known words with letters in those places
        words, gone = [], False
        for m in re.finditer(rf"[\w{LOST}'’-]+|.", token):
            part = m[0]
            if LOST in part:
                best = self._masked(part.lower()) if part.strip(LOST) or len(part) > 2 else None
                if not best or best[1] < 0.6 * best[0]:
                    gone = True
                    break
                w = best[2]
                letters = [c for c in part if c.isalpha()]
                part = w.upper() if len(letters) > 1 and all(c.isupper() for c in letters) else w[:1].upper() + w[1:] if part[0].isupper() or part[0] == LOST and not words and w[:1] != w[:1].lower() else w
            words.append(part)
        if not gone:
            out["utf-8", "narrow"] = "".join(words)
        # bytes of UTF-8 of which some were not read: a lattice
        for r in READ:
            lattice: list[int] | None = []
            for c in token:
                if c == LOST:
                    lattice += [-1]
                    continue
                b = _to_bytes(c, r)
                if b is None:
                    lattice = None
                    break
                lattice += b
            if lattice and any(b > 127 for b in lattice):
                t = self._viterbi(lattice, r in MULTIBYTE_READ)
                if t is not None:
                    out[r, "utf-8"] = t
        return out

    def _count(self, word: str) -> int | None:
        n = self.words.get(word)
        return self.rare.count(word) if n is None and self.rare else n

    def _masked(self, mask: str) -> tuple[int, int, str] | None:
        """Of the words with ``mask``: the sum of their counts, and the most frequent with its count."""
        some = self.masks.get(mask, [])
        found = [(sum(n for n, _ in some), *max(some))] if some else []
        if self.rare and (row := self.rare.masks.row(mask)):
            found.append(row)
        return (sum(f[0] for f in found), *max(f[1:] for f in found)) if found else None

    def _matching(self, pattern: tuple[int, ...]) -> tuple[dict[str, list[str]], list[str]]:
        """Characters whose bytes match a pattern with wildcards (-1): all by their first letter in lower case, and the cheapest of each kind that a spelling tells apart."""
        letters: dict[str, list[str]] = {}
        best: dict[tuple, tuple[float, str]] = {}
        for c in self.by_lead.get((len(pattern), pattern[0]), ()):
            if all(x in (-1, y) for x, y in zip(pattern, c.encode())):
                key = (kind_of(c), _LETTER.match(c) is not None, c in _JOINTS)
                best[key] = min(best.get(key, (math.inf, "")), (self.char(c), c))
                if key[1] or key[2]:
                    for low in "σς" if c == "Σ" else c.lower()[:1]:
                        letters.setdefault(low, []).append(c)
        return letters, [c for _, c in best.values()]

    def _after(self, prefix: str) -> frozenset[str]:
        """The characters that follow ``prefix`` in known words."""
        out, i, n = set(), bisect_left(self.sorted_words, prefix), len(prefix)
        while i < len(self.sorted_words) and self.sorted_words[i].startswith(prefix):
            if len(self.sorted_words[i]) == n:
                i += 1
                continue
            c = self.sorted_words[i][n]
            out.add(c)
            i = bisect_left(self.sorted_words, prefix + chr(ord(c) + 1), i)
        if self.rare:
            word = self.rare.words.next_key(prefix + "\0")
            while word and word.startswith(prefix):
                out.add(word[n])
                word = self.rare.words.next_key(prefix + chr(ord(word[n]) + 1))
        return frozenset(out)

    def _viterbi(self, lattice: list[int], wide: bool) -> str | None:
        """The cheapest UTF-8 text, by ``_cost``, on a lattice of bytes and wildcards (-1); where ``wide``, a wildcard may stand for two bytes.

        Exact: of the ways to a position only those are dropped that another of the same state beats. A word is either
        spelled, where the state is the last class and the word's scripts, or a known one, where it is the word's prefix
        in lower case and the ways its capitals may still be usual; a known word's cost is added where it ends.
        """
        # states: (last class, "out" | "end", ...) between words, "end" where no letter may follow; (.., "spell", scripts, after a
        # joint); (.., "known", prefix, capitals, cased before, scripts, after a joint). Values: (cost, text, where the known word starts).
        ways: list[dict[tuple, tuple[float, str, int]]] = [{} for _ in range(len(lattice) + 1)]
        ways[0] = {("^", "out"): (0.0, "", 0)}
        worst = -math.log(FLOOR)

        def put(to: dict, state: tuple, way: tuple[float, str, int]) -> None:
            if state not in to or way < to[state]:
                to[state] = way

        def known_end(state: tuple, way: tuple[float, str, int]) -> float | None:
            if state[6] or len(state[5]) > 1:
                return None
            word = way[1][way[2] :].lower()
            n = self.count(word) if word == state[2] else None
            return way[0] - math.log(n / self.n_words) + (1.0 if any(state[3]) else 8.0) if n else None

        def spell(to: dict, state: tuple, way: tuple[float, str, int], c: str) -> None:
            """Adds ``c`` outside of known words."""
            k, letter = kind_of(c), _LETTER.match(c) is not None
            cost, s = way[0] + self.step.get(state[0] + k, worst) + self.char(c), way[1] + c
            if letter and state[1] != "end":
                before = state[2] if state[1] == "spell" else frozenset()
                scripts = before | _script(k)
                put(to, (k, "spell", scripts, False), (cost + 8.0 * (len(scripts) > 1 >= len(before)), s, 0))
            elif not letter:
                put(to, (k, "spell", state[2], True) if c in _JOINTS and state[1] == "spell" and not state[3] else (k, "out"), (cost, s, 0))

        def know(to: dict, state: tuple, way: tuple[float, str, int], c: str) -> None:
            """Adds ``c`` to a known word, or starts one."""
            k, joint = kind_of(c), c in _JOINTS
            new = state[1] != "known"
            prefix, forms, cased, scripts, pending = ("", (True,) * 4, False, frozenset(), False) if new else state[2:]
            if joint and (new or pending):
                return
            lower, upper, title = c == c.lower(), c == c.upper(), c == c.title()
            forms = (forms[0] and lower, forms[1] and upper, forms[2] and (title if new else lower), forms[3] and (lower if cased else title))
            for low in (c.lower(),) if c != "Σ" else "σς":
                if low[0] in self.after(prefix) and (len(low) == 1 or low[-1] in self.after((prefix + low)[:-1])):
                    put(to, (k, "known", prefix + low, forms, c.islower() or c.isupper() or c.istitle(), scripts | _script(k), joint), (way[0], way[1] + c, len(way[1]) if new else way[2]))

        def nexts(letters: dict[str, list[str]], prefix: str) -> list[str]:
            """Of ``letters``, those that go on with a known word after ``prefix``."""
            return [c for low in self.after(prefix) & letters.keys() for c in letters[low]]

        def closed(here: dict) -> None:
            """Adds the ends of known words to a position."""
            for state, way in list(here.items()):
                if state[1] == "known" and (cost := known_end(state, way)) is not None:
                    put(here, (state[0], "word"), (cost, way[1], 0))

        for i in range(len(lattice)):
            here, ways[i] = ways[i], {}
            closed(here)
            b = lattice[i]
            moves: list[tuple[int, dict[str, list[str]], list[str]]] = []
            if 0 <= b < 128:
                c = chr(b)
                moves.append((1, {c.lower(): [c]} if _LETTER.match(c) or c in _JOINTS else {}, [c]))
            else:
                for n in (2, 3, 4):
                    spans = [(n, lattice[i : i + n])]
                    if wide and -1 in lattice[i : i + n - 1]:  # the wildcard takes two of the bytes
                        have = lattice[i : i + n - 1]
                        at = have.index(-1)
                        spans.append((n - 1, have[: at + 1] + [-1] + have[at + 1 :]))
                    for used, part in spans:
                        if i + used <= len(lattice) and len(part) == n and not any(0 <= x < 128 for x in part):
                            moves.append((used, *self.matching(tuple(part))))
            for used, letters, cheapest in moves:
                to = ways[i + used]
                for state, way in here.items():
                    if state[1] == "known":
                        for c in nexts(letters, state[2]):
                            know(to, state, way, c)
                        continue
                    if state[1] == "word":  # the next sign is no letter; after a joint neither is the one after it
                        for c in cheapest:
                            if not _LETTER.match(c):
                                k = kind_of(c)
                                put(to, (k, "end" if c in _JOINTS else "out"), (way[0] + self.step.get(state[0] + k, worst) + self.char(c), way[1] + c, 0))
                        continue
                    for c in cheapest:
                        spell(to, state, way, c)
                # a known word costs the same after any class, so it starts from the cheapest way
                if start := min(((way, state) for state, way in here.items() if state[1] == "out"), default=None):
                    for c in nexts(letters, ""):
                        know(to, start[1], start[0], c)
        closed(ways[-1])
        full = [(way[0] + self.step.get(state[0] + "$", worst), way[1]) for state, way in ways[-1].items() if state[1] != "known"]
        return min(full)[1] if full else None

    def restore(self, text: str) -> tuple[str, int, int]:
        """(text as it was written as far as can be told, tokens that were misread, of those not restored).

        A Viterbi search over the text's tokens; the states are the channels that make any of them more likely, and
        none. A token of ASCII only is the same in all of them, so a damaged stretch holds together across it.
        """
        parts = re.split(r"([ \t\r\n\f\v]+)", text)
        options = [self.readings(p) if i % 2 == 0 and _NON_ASCII.search(p) else None for i, p in enumerate(parts)]
        gain: dict[tuple, float] = {}
        for o in options:
            for c, (cost, _) in o.items() if o else ():
                gain[c] = gain.get(c, 0.0) + min(0.0, cost)
        enter = {c: (ENTER_NARROW if c[1] in NARROW else ENTER_WIDE) + AGAIN * (len(c) > 2) for c in gain}
        # a channel that all its tokens together do not pay for is on no cheapest way
        channels = sorted((c for c in gain if gain[c] + enter[c] < 0), key=str)
        lost = [i for i, p in enumerate(parts) if LOST in p]
        if not channels:
            return text, len(lost), len(lost)
        states = [(), *channels]
        score = {s: 0.0 if not s else math.inf for s in states}
        back: list[dict] = []
        for o in options:
            if o is None:
                back.append({})
                continue
            leave = min((v + LEAVE, s) for s, v in score.items() if s) if channels else (math.inf, ())
            new, came = {}, {}
            clean = min((score[()], ()), leave)
            for s in states:
                if not s:
                    new[s], came[s] = clean
                    continue
                best = min((score[s], s), (clean[0] + enter[s], clean[1]), (leave[0] + enter[s], leave[1]), key=lambda x: x[0])
                hit = o.get(s)
                new[s] = best[0] + hit[0] if hit else math.inf
                came[s] = best[1]
            score = new
            back.append(came)
        state = min(score, key=lambda s: score[s])
        damaged = set(lost)
        for i in range(len(parts) - 1, -1, -1):
            if options[i] is None:
                continue
            hit = options[i].get(state) if state else None
            if hit:
                damaged.add(i)
                parts[i] = hit[1]
            state = back[i][state]
        return "".join(parts), len(damaged), sum(LOST in parts[i] for i in damaged)


def corpus_model(texts: DataFrame, text: str, vocabulary_share: float = 1e-5) -> Model:
    """Counts over all texts: words, characters and transitions of character classes, of tokens with a character beyond ASCII.

    Distinct tokens are counted first; tokens that look misread are not counted. What comes to the driver is bounded:
    characters by Unicode, transitions by the classes, and words by their share of all such words, of which at least
    ``vocabulary_share`` is asked, so there are at most its inverse. Rarer words are written, sorted, to the shared
    folder, where workers look them up: the share decides where a word is kept, not what is known.
    """
    token = F.explode(F.split(F.col(text), r"[ \t\r\n\f\x0B]+"))
    tokens = texts.where(F.col(text).rlike(r"[^\x00-\x7f]")).select(token.alias("token")).where(F.col("token").rlike(r"[^\x00-\x7f]"))
    tokens = tokens.groupBy("token").agg(F.count("*").alias("n"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            all_: Counter = Counter()
            for t, n in zip(f["token"], f["n"]):
                if not looks_misread(t):
                    for k, v in pieces_of(t).items():
                        all_[k] += v * int(n)
            yield pd.DataFrame({"key": list(all_.keys()), "n": list(all_.values())}, columns=["key", "n"])

    # a stated number of partitions is kept by adaptive execution: the tokens are few bytes, but much work. Written once, read for sums and words
    spread = max(tokens.sparkSession.sparkContext.defaultParallelism, int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = cut_lineage(tokens.repartition(spread, F.xxhash64("token")).mapInPandas(count, "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n")))
    kind = F.substring("key", 1, 1)
    sums = counts.where(kind == "w").agg(F.sum("n").alias("_total"))
    kept = counts.crossJoin(F.broadcast(sums)).where((kind != "w") | (F.col("n") >= F.col("_total") * vocabulary_share)).select("key", "n", "_total")
    rows = small_rows(kept, int(1 / vocabulary_share) + 1_200_000, "the corpus model")
    split: dict[str, dict[str, int]] = {"w": {}, "c": {}, "t": {}}
    for r in rows:
        split[r["key"][0]][r["key"][1:]] = int(r["n"])
    words = split["w"]
    total = int(rows[0]["_total"] or 0) if rows else 0
    if total <= sum(words.values()):
        return Model(without_echoes(words), split["c"], split["t"])
    few = counts.where(kind == "w").crossJoin(F.broadcast(sums)).where(F.col("n") < F.col("_total") * vocabulary_share)
    few = cut_lineage(few.select(F.expr("substring(key, 2)").alias("word"), "n"))
    return Model(without_echoes(words), split["c"], split["t"], _rare_words(few, words))


def _rare_words(few: DataFrame, words: dict[str, int]) -> RareWords:
    """The table of ``few`` (``word, n``), less echoes of any words, and of its masks."""
    all_few, box = sorted_table(few, "word"), few.sparkSession.sparkContext.broadcast(words)

    def clean(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def count(word: str) -> int | None:
            return box.value.get(word) or (row[0] if (row := all_few.row(word)) else None)

        for f in frames:
            left = without_echoes(dict(zip(f["word"], map(int, f["n"]))), count=count)
            yield pd.DataFrame({"word": list(left), "n": list(left.values()), "mask": [mask_of(w) for w in left]}, columns=["word", "n", "mask"])

    left = cut_lineage(few.mapInPandas(clean, "word string, n bigint, mask string"))
    top = F.max(F.struct("n", "word")).alias("top")
    masks = left.groupBy("mask").agg(F.sum("n").alias("total"), top).select("mask", "total", "top.n", "top.word")
    return RareWords(sorted_table(left.select("word", "n"), "word"), sorted_table(masks, "mask"), int(left.agg(F.sum("n")).first()[0] or 0))


def restored(texts: DataFrame, text: str, vocabulary_share: float = 1e-5) -> DataFrame:
    """``texts`` with ``restored`` (the text as it was written, as far as can be told), ``misread`` and ``unrestored`` (tokens).

    Null stays null with no misread tokens; a text of ASCII only comes out as it is. The model is one broadcast of
    bounded size and a table of rare words (see ``corpus_model``); texts are independent of each other, and whole. Columns of ``texts`` that are called
    like the three new ones are replaced.
    """
    texts = texts.drop("restored", "misread", "unrestored")
    m = corpus_model(texts, text, vocabulary_share)
    box = texts.sparkSession.sparkContext.broadcast((m.words, m.chars, m.steps, m.rare))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(*box.value)
        for f in frames:
            out = [model.restore(t) if isinstance(t, str) and _NON_ASCII.search(t) else (t, 0, 0) for t in f[text]]
            yield f.assign(restored=[o[0] for o in out], misread=[o[1] for o in out], unrestored=[o[2] for o in out])

    return texts.mapInPandas(run, f"{fields}, restored string, misread int, unrestored int")
