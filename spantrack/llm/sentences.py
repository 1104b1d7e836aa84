"""Sentence boundaries in any script: candidate marks classified by maximum entropy.

Every closing mark (with the quotes and brackets that follow it) is a candidate; empty lines and
the end of a text always end a unit. A logistic (maximum-entropy) model decides the candidates from
the neighbouring tokens, their case, length, digits and script. It is trained on reliable cases
only: marks before an empty line end a sentence; marks inside numbers and words, before a small
letter on the same line, or after tokens that are frequent before marks but (almost) never end a
block do not.

The token features are corpus statistics over all texts: how often a token before a full stop ends
a block, and how often a token begins one. Tokens are counted by a 64-bit hash in a distributed
aggregate; the ``TOKENS`` most frequent ones go to the tasks. Where a corpus has more, candidates
beside any other token leave their text as a few bytes and are joined with the counts, so every
token has its own rates. What makes a case reliable are rates within confidence bounds, where the evidence for a token is the
number of its different neighbours (a 64-bit sketch) and not its count: a corpus repeated ten times
labels every case as before. All scanning is vectorised over code points.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialise

#: Tokens whose statistics go to the tasks, documents and rows of the training sample, code points per chunk.
TOKENS, SAMPLE_DOCS, TRAIN_ROWS, CHUNK = 1 << 18, 4000, 60_000, 1_000_000

# Classes of code points.
(OTHER, LOWER, UPPER, LETTER, DIGIT, SPACE, NEWLINE, DOT, ELLIPSIS, STRONG, WIDE, DANDA, OPEN, CLOSE, QUOTE, PUNCT, JOINED) = range(17)

# Closing marks, quotes and brackets of the scripts.
_MARKS = {".": DOT, "…": ELLIPSIS, "‥": ELLIPSIS, "!": STRONG, "?": STRONG, "‼": STRONG, "⁇": STRONG, "⁈": STRONG, "⁉": STRONG, "؟": STRONG, "۔": STRONG,
          ";": STRONG, "。": WIDE, "！": WIDE, "？": WIDE, "．": WIDE, "｡": WIDE, "।": DANDA, "॥": DANDA}
_OPENERS, _CLOSERS = "([{（［【〔", ")]}）］】〕"
_QUOTES = "\"'“”„‟‘’‚«»‹›「」『』"
_SINGLE = "'‘’‚‹›"
_ALWAYS_OPEN, _ALWAYS_CLOSE = "„‟‚「『‘", "”’」』"
_LEFT_ANGLE, _RIGHT_ANGLE = "«‹", "»›"
_WIDE_SCRIPT = ((0x2E80, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x2FFFF))
_SCRIPTS = ((0x41, 0x24F), (0x370, 0x3FF), (0x400, 0x52F), (0x600, 0x6FF), (0x900, 0x97F), (0xE00, 0xE7F), (0x2E80, 0x9FFF))
THAI, MAIYAMOK = (0xE00, 0xE7F), 0xE46
_TOP = 0x30000


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.zeros(_TOP, dtype=np.uint8)
    by = {"Ll": LOWER, "Lu": UPPER, "Lt": UPPER, "Lo": LETTER, "Lm": LETTER, "Nd": DIGIT, "No": OTHER, "Mn": JOINED, "Mc": JOINED, "Me": JOINED,
          "Zs": SPACE, "Zl": NEWLINE, "Zp": NEWLINE, "Po": PUNCT, "Pd": PUNCT, "Pc": PUNCT, "Cf": JOINED}
    for i in range(_TOP):
        table[i] = by.get(unicodedata.category(chr(i)), OTHER)
    for c in "\t\r\v\f":
        table[ord(c)] = SPACE
    table[ord("\n")] = NEWLINE
    for chars, k in ((_OPENERS, OPEN), (_CLOSERS, CLOSE), (_QUOTES, QUOTE)):
        for c in chars:
            table[ord(c)] = k
    for c, k in _MARKS.items():
        table[ord(c)] = k
    return table


@lru_cache(maxsize=1)
def _scripts() -> np.ndarray:
    table = np.zeros(_TOP, dtype=np.uint8)
    for k, (a, b) in enumerate(_SCRIPTS, 1):
        table[a : b + 1] = k
    for a, b in _WIDE_SCRIPT:
        table[a : min(b, _TOP - 1) + 1] = len(_SCRIPTS)
    return table


# Further traits of code points.
OPENING, CLOSING, COLON, LEFT, RIGHT, SINGLE, SURE = (1 << i for i in range(7))


@lru_cache(maxsize=1)
def _traits() -> np.ndarray:
    table = np.zeros(_TOP, dtype=np.uint8)
    for chars, trait in ((_ALWAYS_OPEN, OPENING), (_ALWAYS_CLOSE, CLOSING), (":：︰", COLON), (_LEFT_ANGLE, LEFT), (_RIGHT_ANGLE, RIGHT), (_SINGLE, SINGLE),
                         ("”»›」』", SURE)):
        for c in chars:
            table[ord(c)] |= trait
    return table


_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INVERSE = np.uint64(pow(int(_B), -1, 2**64))


@lru_cache(maxsize=4)
def _powers(n: int, inverse: bool) -> np.ndarray:
    steps = np.full(n, _B_INVERSE if inverse else _B, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _last(where: np.ndarray) -> np.ndarray:
    """For every place the last place at or before it that is set, -1 if there is none."""
    return np.maximum.accumulate(np.where(where, np.arange(len(where)), -1))


def _next(where: np.ndarray) -> np.ndarray:
    """For every place the first place at or after it that is set, n if there is none."""
    n = len(where)
    return np.minimum.accumulate(np.where(where, np.arange(n), n)[::-1])[::-1]


class Text:
    """Several texts in one buffer, parted by empty lines, with all that is known by place."""

    def __init__(self, texts: list[str]):
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        joined = "\n\n".join(["", *texts, ""])
        self.begins = np.cumsum(np.concatenate(([2], self.lengths[:-1] + 2))) if texts else np.empty(0, np.int64)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.cp, self.n = cp, len(cp)
        low = np.minimum(cp, _TOP - 1)
        cls, script = _classes()[low], _scripts()[low]
        traits = self.traits = _traits()[low]
        before = np.concatenate(([NEWLINE], cls[:-1]))
        prior_script = np.concatenate(([0], script[:-1]))
        cls = cls.copy()
        cls[(cp == ord(";")) & (prior_script == 2)] = STRONG
        blank = (cls == SPACE) | (cls == NEWLINE)
        self.seen = _last(~blank)  # last visible place at or before
        self.ahead = _next(~blank)  # first visible place at or after
        prior = np.concatenate(([-1], self.seen[:-1]))
        cls[(cp == ord("|")) & (script[np.maximum(prior, 0)] == 5) & (prior >= 0)] = DANDA
        after = np.concatenate((cls[1:], [NEWLINE]))
        # Quotes that may open or close: closing after text and before blank, mark or bracket.
        quote = cls == QUOTE
        opens = quote & (traits & OPENING > 0)
        closes = quote & (traits & CLOSING > 0)
        free = quote & ~opens & ~closes
        left_blank = (before == SPACE) | (before == NEWLINE) | (before == OPEN)
        right_blank = (after == SPACE) | (after == NEWLINE) | (after >= DOT) & (after <= DANDA) | (after == CLOSE)
        # A quote behind other quotes stands where the first of them does.
        base = np.concatenate(([NEWLINE], cls[np.maximum(_last(~quote), 0)][:-1]))
        text_before = ((base == LOWER) | (base == UPPER) | (base == LETTER) | (base == DIGIT) | (base == JOINED) | (
            (base >= DOT) & (base <= DANDA)) | (base == CLOSE)) & ~np.concatenate(([False], opens[:-1]))
        colon = np.concatenate(([False], traits[:-1] & COLON > 0))
        closing = free & ~left_blank & ~colon & (right_blank | text_before)
        # Angle quotes point either way by language; blanks tell, and else their usual sense holds.
        left, right = traits & LEFT > 0, traits & RIGHT > 0
        closing = np.where(left, ~left_blank & right_blank, np.where(right, ~(left_blank & ~right_blank), closing)) & free
        self.q_open, self.q_close = opens | (free & ~closing), closes | closing
        letters = (before <= LETTER) & (before >= LOWER) & (after <= LETTER) & (after >= LOWER)
        self.q_ends = self.q_close & ~(letters & (traits & SINGLE > 0))  # no apostrophe
        self.b_open, self.b_close = cls == OPEN, cls == CLOSE
        self.cls, self.script, self.blank = cls, script, blank
        self.mark = (cls >= DOT) & (cls <= DANDA)
        # Empty lines: a line break with only blanks up to the next one.
        newline = cls == NEWLINE
        next_not_space = _next(cls != SPACE)
        follows = next_not_space[np.minimum(np.arange(self.n) + 1, self.n - 1)]
        self.gap = newline & newline[np.minimum(follows, self.n - 1)]
        self.block = np.cumsum(self.gap)
        self._tokens()

    def _tokens(self) -> None:
        cls, cp = self.cls, self.cp
        wide = (self.script == len(_SCRIPTS)) & ((cls == LETTER) | (cls == OTHER))
        split = self.blank | self.q_open | self.q_close | self.b_open | self.b_close | (cls == WIDE) | (cls == DANDA) | (
            cp == ord("¿")) | (cp == ord("¡"))
        prior = np.concatenate(([True], split[:-1]))
        prior_wide = np.concatenate(([False], wide[:-1]))
        self.starts = ~split & (prior | wide | prior_wide)
        self.start_of = _last(self.starts)
        stop = np.concatenate((split[1:] | self.starts[1:], [True]))
        self.end_of = _next(stop & ~split)
        self._cut = _next(self.mark | (cls == PUNCT))
        digit = cls == DIGIT
        keep = ~(digit & np.concatenate(([False], digit[:-1])))
        value = np.where(digit, np.uint64(48), cp.astype(np.uint64)) + np.uint64(7)
        at = np.cumsum(keep)
        powers = _powers(1 << (self.n + 1).bit_length(), False)
        self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.where(keep, value * powers[at], np.uint64(0)), dtype=np.uint64)))
        self.kept = np.concatenate(([0], at))
        self.inverse = _powers(1 << (self.n + 1).bit_length(), True)

    def word_cell(self, start: np.ndarray) -> np.ndarray:
        """Hashes of the tokens that begin at ``start``, without marks at their ends."""
        stop = np.minimum(self.end_of[start], self.n - 1) + 1
        return self.cell(start, np.maximum(np.minimum(stop, self._cut[np.minimum(start + 1, self.n - 1)]), start + 1))

    def cell(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the stretches [start, end)."""
        h = (self.prefix[end] - self.prefix[start]) * self.inverse[self.kept[start]]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(32))).view(np.int64)

    def block_ends(self) -> np.ndarray:
        """Last visible places of the blocks."""
        visible = np.flatnonzero(~self.blank)
        if not len(visible):
            return visible
        return visible[np.append(self.block[visible[1:]] != self.block[visible[:-1]], True)]

    def block_starts(self) -> np.ndarray:
        visible = np.flatnonzero(~self.blank)
        if not len(visible):
            return visible
        return visible[np.concatenate(([True], self.block[visible[1:]] != self.block[visible[:-1]]))]

    def openers(self) -> np.ndarray:
        """For every closing quote or bracket the place of its opener in the same text, else -1.

        Each sort (double quotes, single ones, brackets) has a stack, so a closer meets the last
        opener of its sort that is still open, at any distance."""
        out = np.full(self.n, -1, dtype=np.int64)
        opening = self.q_open | self.b_open
        at = np.flatnonzero(opening | self.q_ends | self.b_close)
        sort = np.where(self.b_open[at] | self.b_close[at], 2, (self.traits[at] & SINGLE > 0).astype(np.int64))
        text = np.searchsorted(self.begins, at, side="right")
        stacks: list[list[int]] = [[], [], []]
        current = -1
        for place, is_open, k, owner in zip(at.tolist(), opening[at].tolist(), sort.tolist(), text.tolist()):
            if owner != current:
                current, stacks = owner, [[], [], []]
            if is_open:
                stacks[k].append(place)
            elif stacks[k]:
                out[place] = stacks[k].pop()
        return out

    def candidates(self) -> Candidates:
        return Candidates(self)


class Candidates:
    """Closing marks with their closers, and Thai blanks."""

    def __init__(self, t: Text):
        n, cls, cp = t.n, t.cls, t.cp
        marks = np.flatnonzero(t.mark)
        # A mark goes on with the mark before it, also over any number of blanks of one line.
        nl = np.cumsum(cls == NEWLINE)
        joined = (t.seen[marks[1:] - 1] == marks[:-1]) & (nl[marks[1:]] == nl[marks[:-1]]) if len(marks) else np.empty(0, bool)
        first = marks[np.concatenate(([True], ~joined))] if len(marks) else marks
        last = marks[np.append(~joined, True)] if len(marks) else marks
        index = np.cumsum(np.concatenate(([True], ~joined))) - 1 if len(marks) else marks
        k = len(first)
        has = lambda c: np.bincount(index[cls[marks] == c], minlength=k) > 0
        dots = np.bincount(index, weights=(cls[marks] == DOT), minlength=k)
        strong, wide, danda = has(STRONG), has(WIDE), has(DANDA)
        ellipsis = ~strong & ~wide & ~danda & (has(ELLIPSIS) | (dots > 1))
        period = ~(strong | wide | danda | ellipsis)
        # All closers that follow, also behind one blank where they can't open anything.
        close = t.q_close | t.b_close
        sure = (t.b_close | (t.traits & SURE > 0)) & ~t.q_open
        follows = close | ((cls == SPACE) & np.append(sure[1:], False))
        end = np.minimum(_next(~follows)[np.minimum(last + 1, n - 1)] - 1, n - 1)
        first_quote = _next(t.q_close)[np.minimum(last + 1, n - 1)]
        first_bracket = _next(t.b_close)[np.minimum(last + 1, n - 1)]
        quoted, bracketed = first_quote <= end, first_bracket <= end
        # Thai blanks.
        thai = (cp >= THAI[0]) & (cp <= THAI[1])
        line_end = (cp == 13) & np.append(cls[1:] == NEWLINE, True)
        space = np.flatnonzero((cls == SPACE) & ~line_end & np.concatenate(([False], thai[:-1])))
        ahead = np.minimum(t.ahead[space], n - 1)
        thai_next = thai[ahead] | t.q_open[ahead] | t.b_open[ahead] | (cls[ahead] == DIGIT) | (cls[ahead] == UPPER) | (cls[ahead] == LOWER)
        space = space[thai_next]
        ahead = np.minimum(t.ahead[space], n - 1)
        guarded = (cls[space - 1] == DIGIT) | (cls[ahead] == DIGIT) | (cp[space - 1] == MAIYAMOK) | (cp[ahead] == MAIYAMOK)
        m = len(space)
        pad = lambda x, v: np.concatenate((x, np.full(m, v, dtype=x.dtype)))
        self.t, self.k = t, k + m
        self.first, self.last = np.concatenate((first, space)), np.concatenate((last, space))
        self.end = np.concatenate((end, space - 1))
        self.period, self.ellipsis, self.strong = pad(period, False), pad(ellipsis, False), pad(strong, False)
        self.wide, self.danda = pad(wide, False), pad(danda, False)
        self.thai = np.concatenate((np.zeros(k, bool), np.ones(m, bool)))
        self.guarded = np.concatenate((np.zeros(k, bool), guarded))
        self.quoted, self.bracketed = pad(quoted, False), pad(bracketed, False)
        self.quote_at, self.bracket_at = pad(np.where(quoted, first_quote, -1), -1), pad(np.where(bracketed, first_bracket, -1), -1)
        self.next = t.ahead[np.minimum(self.end + 1, n - 1)]
        inside = self.next < n
        at = np.minimum(self.next, n - 1)
        self.edge = ~inside | (t.block[at] != t.block[np.minimum(self.end, n - 1)])
        self.at = at
        self.direct = (at == self.end + 1) & ~self.edge
        self.newline = (nl[at] != nl[np.minimum(self.end, n - 1)]) & ~self.edge
        # The token before the mark.
        p = np.maximum(self.first - 1, 0)
        self.spaced = t.blank[p] & ~self.thai
        before = np.maximum(t.seen[p], 0)
        self.before = before
        start = np.maximum(t.start_of[before], 0)
        # Where the blank after a mark is missing, the token begins behind that mark.
        inner = _last(t.mark)[np.maximum(before - 1, 0)]
        glued = (inner >= start) & (before - inner >= 2) & (cls[np.minimum(inner + 1, n - 1)] == UPPER)
        self.prev_start = np.where(glued, inner + 1, start)
        self.prev_cell = t.cell(np.minimum(self.prev_start, before), before + 1)
        self.prev_length = before + 1 - self.prev_start
        # The token after it: in the next block where the mark ends its own.
        nxt_start = at
        letter = np.isin(cls[nxt_start], (QUOTE, OPEN))
        step = np.minimum(t.ahead[np.minimum(nxt_start + 1, n - 1)], n - 1)
        self.word = np.where(letter, step, nxt_start)
        self.next_cell = t.word_cell(self.word)

    def opened_at_start(self, closer: np.ndarray, openers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the opener of the closer stands at the start of a sentence; whether there is one."""
        t = self.t
        last = np.where(closer >= 0, openers[np.maximum(closer, 0)], -1)
        prior = np.where(last > 0, t.seen[np.maximum(last - 1, 0)], -1)
        safe = np.maximum(prior, 0)
        fresh = (prior < 0) | (t.block[safe] != t.block[np.maximum(last, 0)]) | t.mark[safe] | t.q_close[safe] | t.b_close[safe]
        return fresh & (last >= 0), last >= 0


class Cases:
    """What the features need of candidates besides the counts of their tokens: their hashes and a
    byte a trait, so that candidates can be joined with counts away from their text."""

    FLAGS = ("period", "ellipsis", "strong", "wide", "danda", "thai", "guarded", "quoted", "bracketed", "edge", "direct", "newline", "spaced",
             "punct", "quote_start", "quote_found", "bracket_start", "bracket_found")
    CODES = ("length", "now", "before", "script")

    def __init__(self, before_token: np.ndarray, next_token: np.ndarray, traits: dict[str, np.ndarray]):
        self.before_token, self.next_token, self.k = before_token, next_token, len(before_token)
        self.__dict__.update(traits)

    @classmethod
    def of(cls, c: Candidates) -> Cases:
        t = c.t
        openers = t.openers()
        traits = {name: getattr(c, name) for name in cls.FLAGS[:13]}
        traits["punct"] = np.isin(t.cls[c.at], (PUNCT, CLOSE)) & ~c.edge & ~np.isin(t.cp[c.at], [ord(x) for x in "¡¿-*—–·•#§"])
        traits["quote_start"], traits["quote_found"] = c.opened_at_start(c.quote_at, openers)
        traits["bracket_start"], traits["bracket_found"] = c.opened_at_start(c.bracket_at, openers)
        # No feature tells lengths above 4 apart.
        traits |= {"length": np.clip(c.prev_length, 0, 255).astype(np.uint8), "now": t.cls[c.word], "before": t.cls[c.before], "script": t.script[c.before]}
        return cls(c.prev_cell, c.next_cell, traits)

    def packed(self, rows: np.ndarray) -> pa.Array:
        table = np.stack([getattr(self, name)[rows].astype(np.uint8) for name in (*self.FLAGS, *self.CODES)], axis=1)
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(table.shape[1]), len(rows), [None, pa.py_buffer(table.tobytes())]).cast(pa.binary())

    @classmethod
    def unpacked(cls, before_token: np.ndarray, next_token: np.ndarray, packed: list[bytes]) -> Cases:
        table = np.frombuffer(b"".join(packed), dtype=np.uint8).reshape(-1, len(cls.FLAGS) + len(cls.CODES)).T
        flags = {name: column.astype(bool) for name, column in zip(cls.FLAGS, table)}
        return cls(before_token, next_token, flags | dict(zip(cls.CODES, table[len(cls.FLAGS) :])))


def _evidence(neighbours: np.ndarray) -> np.ndarray:
    """Number of different neighbours by linear counting over 64 bits, at most 266."""
    seen = np.bitwise_count(neighbours.view(np.uint64)).astype(float)
    return -64 * np.log1p(-np.minimum(seen, 63) / 64)


def _bound(rate: np.ndarray, n: np.ndarray, z: float) -> np.ndarray:
    """Wilson's bound of a rate seen ``n`` times: the upper one for z > 0, the lower one for z < 0."""
    m = np.maximum(n, 1e-9)
    return (rate + z * z / (2 * m) + z * np.sqrt(rate * (1 - rate) / m + z * z / (4 * m * m))) / (1 + z * z / m)


class Statistics:
    """Counts of the frequent tokens, by hash, with the totals over all tokens."""

    COUNTS = ("stops", "ends", "tokens", "starts")
    MASKS = ("after_stop", "after")

    def __init__(self, token: np.ndarray, table: np.ndarray, stops: int, ends: int):
        """``token``: hashes; ``table``: COUNTS and MASKS of each; the totals are over all tokens."""
        order = np.argsort(token)
        # The last row is that of all tokens that have none here.
        self.token = np.append(token[order], np.iinfo(np.int64).max)
        rows = np.concatenate((table[:, order], np.zeros((6, 1), np.int64)), axis=1)
        self.stops, self.ends, self.tokens, self.starts = rows[:4].astype(np.float64)
        self.stop_evidence, self.token_evidence = _evidence(rows[4].copy()), _evidence(rows[5].copy())
        self.end_rate = ends / stops if ends else 0.25
        self.start_rate = 0.2

    @classmethod
    def of(cls, token: np.ndarray, table: np.ndarray) -> Statistics:
        return cls(token, table, int(table[0].sum()), int(table[1].sum()))

    @staticmethod
    def count(t: Text, c: Candidates) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the tokens of some texts with their COUNTS and MASKS."""
        stop = np.flatnonzero(c.period)
        first = np.flatnonzero(t.starts)
        begin = t.block_starts()
        skip = np.isin(t.cls[begin], (QUOTE, OPEN))
        begin = np.where(skip, np.minimum(t.ahead[np.minimum(begin + 1, t.n - 1)], t.n - 1), begin)
        words = t.word_cell(first)
        parts = (c.prev_cell[stop], words, t.word_cell(begin))
        token = np.concatenate(parts)
        if not len(token):
            return token, np.zeros((6, 0), np.int64)
        sizes = [len(p) for p in parts]
        rows = np.zeros((6, len(token)), dtype=np.int64)
        a, b = sizes[0], sizes[0] + sizes[1]
        one = np.uint64(1)
        bit = lambda h: (one << (h.view(np.uint64) >> np.uint64(58))).view(np.int64)
        rows[0, :a], rows[1, :a], rows[4, :a] = 1, c.edge[stop], bit(c.next_cell[stop])
        rows[2, a:b], rows[5, a:b] = 1, bit(np.roll(words, -1))
        rows[3, b:] = 1
        order = np.argsort(token, kind="stable")
        token = token[order]
        at = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        return token[at], np.concatenate((np.add.reduceat(rows[:4, order], at, axis=1), np.bitwise_or.reduceat(rows[4:, order], at, axis=1)))

    def place(self, token: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.token, token)
        return np.where(self.token[np.minimum(at, len(self.token) - 1)] == token, at, len(self.token) - 1)

    def rare(self, token: np.ndarray) -> np.ndarray:
        """Whether the tokens have no row here."""
        return self.place(token) == len(self.token) - 1

    def places(self, c: Cases) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the tokens before and after the candidates."""
        return self.place(c.before_token), self.place(c.next_token)

    def end_score(self, c: Cases, at: np.ndarray) -> np.ndarray:
        """Log ratio of the rate at which the token before the stop ends a block to the mean rate,
        without the candidate itself."""
        own = c.period.astype(float)
        n, k = self.stops[at] - own, self.ends[at] - own * c.edge
        strength = 3.0
        return np.log((np.maximum(k, 0) + strength * self.end_rate) / (np.maximum(n, 0) + strength) / self.end_rate)

    def start_score(self, c: Cases, at: np.ndarray) -> np.ndarray:
        own = c.edge.astype(float)
        n, k = self.tokens[at] - 1, self.starts[at] - own
        strength = 3.0
        return np.log((np.maximum(k, 0) + strength * self.start_rate) / (np.maximum(n, 0) + strength) / self.start_rate)

    def end_rates(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rate at which the token before a stop ends a block, evidence for it)."""
        return self.ends[at] / np.maximum(self.stops[at], 1), self.stop_evidence[at]

    def start_rates(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.minimum(self.starts[at] / np.maximum(self.tokens[at], 1), 1), self.token_evidence[at]


class CaseStatistics(Statistics):
    """Counts with a row for each of some cases: those of its tokens among the frequent ones, else
    the joined ones."""

    def __init__(self, frequent: Statistics, c: Cases, joined: np.ndarray):
        """``joined``: COUNTS and MASKS of the tokens by case, used where they have no row in ``frequent``."""
        before_at, after_at = frequent.places(c)
        before_rare, after_rare = frequent.rare(c.before_token), frequent.rare(c.next_token)
        self.stops, self.ends = np.where(before_rare, joined[0], frequent.stops[before_at]), np.where(before_rare, joined[1], frequent.ends[before_at])
        self.tokens, self.starts = np.where(after_rare, joined[2], frequent.tokens[after_at]), np.where(after_rare, joined[3], frequent.starts[after_at])
        self.stop_evidence = np.where(before_rare, _evidence(joined[4]), frequent.stop_evidence[before_at])
        self.token_evidence = np.where(after_rare, _evidence(joined[5]), frequent.token_evidence[after_at])
        self.end_rate, self.start_rate = frequent.end_rate, frequent.start_rate

    def places(self, c: Cases) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(c.k)
        return at, at


def features(c: Candidates, s: Statistics) -> tuple[np.ndarray, np.ndarray]:
    """Feature matrix, and labels: 1 and 0 where reliable, -1 elsewhere."""
    return case_features(Cases.of(c), s)


def case_features(c: Cases, s: Statistics) -> tuple[np.ndarray, np.ndarray]:
    before_at, after_at = s.places(c)
    ends, starts = s.end_score(c, before_at), s.start_score(c, after_at)
    now = c.now
    lower, upper, digit = now == LOWER, now == UPPER, now == DIGIT
    # Beside a script without case, letter case says nothing.
    script = c.script
    bare = script >= 4
    foreign = (lower | upper) & bare  # a Latin word there: its start counts come from other texts
    caseless = (now == LETTER) | (now == JOINED) | foreign
    lower, upper = lower & ~bare, upper & ~bare
    symbol = now == OTHER
    starts = np.where(symbol | foreign, 0.0, starts)  # ornaments and such follow sentences anywhere
    run_on = c.ellipsis & (script == len(_SCRIPTS)) & ~c.spaced
    punct = c.punct
    open_start, open_found, brk_start, brk_found = c.quote_start, c.quote_found, c.bracket_start, c.bracket_found
    q, b = c.quoted, c.bracketed
    prev_digit = c.before == DIGIT
    single = (c.length == 1) & np.isin(c.before, (UPPER, LOWER, LETTER))
    in_number = c.direct & digit & prev_digit & (c.period | c.ellipsis)
    f = [
        np.ones(c.k), c.period, c.ellipsis, c.strong, c.wide | c.danda, c.thai & ~c.guarded, c.thai & c.guarded,
        np.where(c.period, ends, 0), np.where(c.period & (ends < -0.7), 1, 0), starts * ~c.thai, np.where(c.period, starts, 0),
        np.where(c.period, np.minimum(ends, 0) * np.minimum(starts, 0), 0),
        lower & ~c.newline, lower & c.newline, upper, digit, caseless, symbol, punct,
        c.direct & (c.period | c.ellipsis), c.direct & c.strong, c.direct & lower, c.direct & upper, in_number,
        c.spaced & c.ellipsis, c.spaced & ~c.ellipsis & ~c.thai, c.ellipsis & lower, c.ellipsis & digit, np.where(c.ellipsis & ~run_on, starts, 0),
        q & open_start, q & ~open_start & open_found, q & ~open_found, b & brk_start, b & ~brk_start & brk_found, b & ~brk_found,
        c.period & single, c.period & prev_digit, c.period & prev_digit & digit, c.period & prev_digit & (starts < -1), c.period & prev_digit & upper & (starts < -2.5), c.period & c.newline & upper & (starts < -2.5), c.period & (c.length <= 4) & ~single,
        run_on, c.newline, c.newline * np.clip(starts, -3, 1) * ~c.thai, c.newline & upper, c.newline & c.period & (ends > -0.4),
        c.period & (script == 0), c.period & ((script == 4) | (script == 5)),
    ]
    x = np.stack([np.asarray(v, dtype=np.float32) for v in f], axis=1)
    # Labels: rates by the confidence bounds that the evidence allows.
    end_p, end_n = s.end_rates(before_at)
    start_p, start_n = s.start_rates(after_at)
    often_ends = (end_p * end_n + 3 * s.end_rate) / (end_n + 3) > 0.67 * s.end_rate
    start_ratio = (start_p * start_n + 3 * s.start_rate) / (start_n + 3) / s.start_rate
    never_ends = c.period & (_bound(end_p, end_n, 2.0) < 0.4 * s.end_rate)
    rare_start, surely_rare = _bound(start_p, start_n, 1.0) < 0.1 * s.start_rate, _bound(start_p, start_n, 2.0) < 0.12 * s.start_rate
    # Where columns are read across, the next line says little about the end of this one.
    plain = ~q & ~b & ~c.direct & ~c.spaced
    ordinary = c.strong | c.wide | c.danda | (c.period & often_ends & (_bound(end_p, end_n, -1.0) > 0.4 * s.end_rate) & ~single & ~prev_digit)
    never_starts = rare_start & (c.period | c.ellipsis) & (~c.newline | ~often_ends | (upper & (prev_digit | surely_rare)))
    inside = b & ~brk_start & brk_found
    spoken = q & open_start & (lower | punct) & ~c.newline
    no = (lower & ~c.newline & ~c.direct) | in_number | (c.direct & lower) | (punct & ~c.newline) | never_ends | never_starts | (
        c.thai & c.guarded) | spoken | (inside & (lower | caseless | digit)) | (c.ellipsis & digit) | (c.spaced & c.ellipsis & ~c.edge & caseless) | (
        c.ellipsis & lower)
    # A block that ends in a quotation from its start was cut off before the speaker is named.
    whole = c.edge & ~inside & ~(q & open_start)
    yes = whole | (c.thai & ~c.guarded) | (
        plain & ordinary & (c.newline & (lower | caseless | (upper & ~rare_start)) | (upper | caseless | symbol) & ((start_ratio > 0.6) | symbol | foreign)))
    label = np.where((yes & ~no) | whole, 1, np.where(no & ~c.edge, 0, -1))
    return x, label


N_CASE = slice(12, 15)  # the features of letter case


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Maximum-entropy weights by Newton steps. Every row also enters without its letter case, as
    it would stand in a script that has none."""
    bare = x.copy()
    caseless = bare[:, 12] + bare[:, 13] + bare[:, 14]
    bare[:, N_CASE] = 0
    bare[:, 16] = np.maximum(bare[:, 16], caseless > 0)
    rows = caseless > 0
    x = np.concatenate((x, bare[rows])).astype(np.float64)
    y = np.concatenate((y, y[rows])).astype(np.float64)
    weight = np.where(np.arange(len(y)) < len(y) - rows.sum(), 1.0, 0.3)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge * w
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= CHUNK:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


COUNTED = (*Statistics.COUNTS, *Statistics.MASKS)


def token_counts(df: DataFrame, text: str) -> DataFrame:
    """(token, COUNTS, MASKS) of all tokens of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x for x in batch.column(0).to_pylist() if x]
            for a, b in _chunks(texts):
                t = Text(texts[a:b])
                token, table = Statistics.count(t, t.candidates())
                yield pa.RecordBatch.from_arrays([pa.array(token), *[pa.array(r) for r in table]], ["token", *COUNTED])

    parts = df.select(text).where(F.col(text).isNotNull()).mapInArrow(count, ", ".join(f"{c} long" for c in ["token", *COUNTED]))
    return materialise(parts.groupBy("token").agg(
        *[F.sum(c).alias(c) for c in Statistics.COUNTS], *[F.bit_or(c).alias(c) for c in Statistics.MASKS]))


def frequent_tokens(found: DataFrame, tokens: int) -> tuple[Statistics, bool]:
    """Statistics of the ``tokens`` most frequent tokens, with the totals over all; whether there are others."""
    n, stops, ends = found.agg(F.count("*"), F.sum("stops"), F.sum("ends")).first()
    top = found.orderBy(F.greatest("stops", "tokens").desc(), "token").limit(tokens).toArrow()
    table = np.stack([top.column(c).to_numpy() for c in COUNTED]).astype(np.int64) if top.num_rows else np.zeros((6, 0), np.int64)
    return Statistics(top.column("token").to_numpy().astype(np.int64), table, stops or 0, ends or 0), n > tokens


def statistics(df: DataFrame, text: str, tokens: int = TOKENS) -> Statistics:
    """Statistics of the ``tokens`` most frequent tokens, which reach the driver, with the totals over
    all texts. Candidates beside other tokens get their counts by ``joined_cases``."""
    return frequent_tokens(token_counts(df, text), tokens)[0]


def joined_cases(rows: DataFrame, stats, found: DataFrame, undecided: bool) -> DataFrame:
    """The candidates of ``rows`` (key, text), as (key, place, end, hashes, traits) with COUNTS and
    MASKS of their tokens, which are null where a token is among the frequent ones or was never
    counted. ``undecided``: only those inside a block and beside a token that isn't frequent."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in _chunks(texts):
                t = Text(texts[a:b])
                c = t.candidates()
                before_rare, next_rare = stats.value.rare(c.prev_cell), stats.value.rare(c.next_cell)
                at = np.flatnonzero((before_rare | next_rare) & ~c.edge) if undecided else np.arange(c.k)
                if len(at):
                    owner = np.searchsorted(t.begins, c.last[at], side="right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(a + owner)), pa.array(c.last[at] - t.begins[owner], pa.int64()),
                         pa.array(c.end[at] - t.begins[owner] + 1, pa.int32()), pa.array(c.prev_cell[at]), pa.array(c.next_cell[at]),
                         pa.array(before_rare[at]), pa.array(next_rare[at]), Cases.of(c).packed(at)],
                        ["key", "place", "end", "before_token", "next_token", "before_rare", "next_rare", "traits"])

    cases = rows.mapInArrow(scan, f"key {rows.schema['key'].dataType.simpleString()}, place long, end int, before_token long, next_token long, "
                                  "before_rare boolean, next_rare boolean, traits binary")
    for side, counted in (("before", ("stops", "ends", "after_stop")), ("next", ("tokens", "starts", "after"))):
        # What needs no counts is spread over the partitions by its place; counts it may meet aren't used.
        key = F.when(F.col(f"{side}_rare"), F.col(f"{side}_token")).otherwise(F.xxhash64("key", "place"))
        counts = found.where(" or ".join(f"{c} <> 0" for c in counted)).select(F.col("token").alias("__token"), *counted)
        cases = cases.join(counts, key == F.col("__token"), "left").drop("__token")
    return cases.select("key", "place", "end", "before_token", "next_token", "traits", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTED])


def _features_of_cases(batch: pa.RecordBatch, stats: Statistics) -> tuple[np.ndarray, np.ndarray]:
    column = lambda name: batch.column(name).to_numpy()
    c = Cases.unpacked(column("before_token"), column("next_token"), batch.column("traits").to_pylist())
    return case_features(c, CaseStatistics(stats, c, np.stack([column(name) for name in COUNTED])))


def train(df: DataFrame, doc_id: str, text: str, stats, rest: DataFrame | None = None) -> np.ndarray:
    """Weights from the reliable candidates of a sample of at most about SAMPLE_DOCS texts, and of
    those TRAIN_ROWS drawn by the hash of document and place. ``rest``: the counts of all tokens,
    where ``stats`` hasn't got them all."""
    total = df.count()
    if not total:
        return fit(*features_of([], stats.value))
    sample = df.where(F.pmod(F.xxhash64(doc_id), F.lit(total)) < SAMPLE_DOCS) if total > SAMPLE_DOCS else df

    def labelled(keys: pa.Array, places: pa.Array, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [keys, places, pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary()), pa.array(y, pa.int32())], ["key", "place", "x", "y"])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in _chunks(texts):
                t = Text(texts[a:b])
                c = t.candidates()
                x, y = features(c, stats.value)
                keep = np.flatnonzero(y >= 0)
                if len(keep):
                    owner = np.searchsorted(t.begins, c.last[keep], side="right") - 1
                    yield labelled(batch.column(0).take(pa.array(a + owner)), pa.array(c.last[keep] - t.begins[owner], pa.int64()), x[keep], y[keep])

    def label_cases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _features_of_cases(batch, stats.value)
            keep = np.flatnonzero(y >= 0)
            yield labelled(batch.column("key").take(pa.array(keep)), batch.column("place").take(pa.array(keep)), x[keep], y[keep])

    texts = sample.select(F.xxhash64(doc_id).alias("key"), text).where(F.col(text).isNotNull())
    rows, by = (texts, label) if rest is None else (joined_cases(texts, stats, rest, undecided=False), label_cases)
    rows = rows.mapInArrow(by, "key long, place long, x binary, y int")
    rows = rows.orderBy(F.xxhash64("key", "place"), "key", "place").limit(TRAIN_ROWS).select("x", "y").toArrow()
    width = features_of([], stats.value)[0].shape[1]
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), dtype=np.float32).reshape(-1, width)
    return fit(x, rows.column("y").to_numpy())


def features_of(texts: list[str], stats: Statistics) -> tuple[np.ndarray, np.ndarray]:
    x, y = features(Text(texts).candidates(), stats)
    return x[y >= 0], y[y >= 0]


def sentence_ends(texts: list[str], stats: Statistics, weights: np.ndarray, decided: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, number of code points up to the end) of every unit, in order. ``decided``:
    without those at candidates beside a token that has no row in ``stats``."""
    t = Text(texts)
    c = t.candidates()
    x, _ = features(c, stats)
    chosen = (x @ weights > 0) & ~c.edge
    if decided:
        chosen &= ~stats.rare(c.prev_cell) & ~stats.rare(c.next_cell)
    ends = np.unique(np.concatenate((c.end[chosen], t.block_ends())))
    owner = np.searchsorted(t.begins, ends, side="right") - 1
    return owner, ends - t.begins[owner] + 1


def split_sentences(df: DataFrame, doc_id: str, text: str, tokens: int = TOKENS) -> DataFrame:
    """(doc_id, end_pos) of every sentence unit: code points up to its last visible one.

    Null, empty and blank texts give no row. Texts of any length are read whole. Rows repeated
    with the same doc_id give the same ends once per row; extra columns are not read. The result
    doesn't depend on ``tokens``, the number of tokens whose statistics go to the tasks: candidates
    beside others are decided after a join with the counts, in a scan of their own.
    """
    rows = df.select(F.col(doc_id).alias("key"), F.col(text).alias("text"))
    context = df.sparkSession.sparkContext
    found = token_counts(rows, "text")
    frequent, more = frequent_tokens(found, tokens)
    stats = context.broadcast(frequent)  # seven arrays of at most ``tokens`` numbers
    weights = train(rows, "key", "text", stats, found if more else None)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in _chunks(texts):
                owner, ends = sentence_ends(texts[a:b], stats.value, weights, more)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner + a)), pa.array(ends, pa.int32())], ["key", "end_pos"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(np.flatnonzero(_features_of_cases(batch, stats.value)[0] @ weights > 0))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(keep), batch.column("end").take(keep)], ["key", "end_pos"])

    schema = f"key {rows.schema['key'].dataType.simpleString()}, end_pos int"
    texts = rows.where(F.col("text").isNotNull())
    ends = texts.mapInArrow(split, schema)
    if more:
        # No candidate inside a block shares its end with another one or with the block.
        ends = ends.unionAll(joined_cases(texts, stats, found, undecided=True).mapInArrow(decide, schema))
    return ends.withColumnRenamed("key", doc_id)


def block_ends(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, end_pos) of the last visible code points before empty lines and at the end of texts."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in _chunks(texts):
                t = Text(texts[a:b])
                ends = t.block_ends()
                owner = np.searchsorted(t.begins, ends, side="right") - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner + a)), pa.array(ends - t.begins[owner] + 1, pa.int32())], ["doc_id", "end_pos"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(doc_id, text).where(F.col(text).isNotNull()).mapInArrow(find, f"doc_id {kind}, end_pos int").withColumnRenamed("doc_id", doc_id)
