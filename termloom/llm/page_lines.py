"""What the lines of many pages look like, as arrays over all their letters at once.

A page is lines, a line has pieces: entries between marks, sentences. Lines and pieces are units. A unit's path is the unit without what
changes from page to page: bullet, numbers, addresses; further forms of it have a mark in place of a name (a run of capitalized words) at the
start, the end or inside. Paths are 64-bit hashes, taken from running sums over the letters, so each costs the same whatever its length.
"""

from __future__ import annotations

import numpy as np

LONG_LINE = 160
_TOP = 0xFFFF
_CHARS = [chr(i) for i in range(_TOP + 1)]


def _table(test) -> np.ndarray:
    return np.fromiter((test(c) for c in _CHARS), bool, _TOP + 1)


SPACE = _table(lambda c: c.isspace() and c != "\n")
UPPER = _table(lambda c: c.isupper() or c == "&")
ALNUM = _table(str.isalnum)
HAN = _table(lambda c: "㐀" <= c <= "鿿")
LOWER = np.fromiter((ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in _CHARS), np.uint32, _TOP + 1)
STOP = _table(lambda c: c in ".!?。！？…")
WIDE_STOP = _table(lambda c: c in "。！？")
SPLIT_STOP = _table(lambda c: c in ".!?")
CLOSING = _table(lambda c: c in "\"'”»」’)] \t\r�")
MARK = _table(lambda c: c in "|·•»›>/*–-")
BULLET = _table(lambda c: c in "-*•»›>·–")
#: Marks between the items of a list in one line.
BETWEEN = _table(lambda c: c in ",，、;|*•·/#")
NAME_END = _table(lambda c: c in ",.:;")
#: A bit for each class that is asked of all letters, so that one look-up finds them all.
_IS_SPACE, _IS_HAN, _IS_ALNUM, _IS_CLOSING, _IS_MARK, _IS_SPLIT, _IS_WIDE, _IS_BETWEEN = (np.uint8(1 << i) for i in range(8))
_CLASSES = sum(t * np.uint8(1 << i) for i, t in enumerate((SPACE, HAN, ALNUM, CLOSING, MARK, SPLIT_STOP, WIDE_STOP, BETWEEN)))
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Paths of forms of lines rather than of their words: so many titles or entries below one another, marked lists, menus in one line, and the way to the page.
TITLES, ENTRIES, MARKED, MENU, CRUMB = (np.uint64(x) for x in (101, 102, 103, 104, 105))
_HEAD, _TAIL = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 20)
            cls.up, cls.down = (np.full(size, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
            cls.up[0] = cls.down[0] = 1
            with np.errstate(over="ignore"):
                cls.up, cls.down = np.cumprod(cls.up), np.cumprod(cls.down)
        return cls.up, cls.down


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        for _ in range(2):
            x = (x ^ (x >> np.uint64(32))) * _MIX
        return x ^ (x >> np.uint64(32))


class _Sums:
    """Hashes of any stretch of a sequence of numbers."""

    def __init__(self, codes: np.ndarray):
        self.up, self.down = _Powers.of(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(np.multiply(codes, self.up[:len(codes)], dtype=np.uint64), out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mixed((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64))


def _first_at(at: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """The first position at or behind each of ``at`` that isn't one to skip; the length where there is none."""
    n, out = len(skip), at.copy()
    on = np.flatnonzero((at < n) & skip[np.minimum(at, n - 1)])
    if len(on):
        ends = np.append(np.flatnonzero(~skip & _before(skip)), n)
        out[on] = ends[np.searchsorted(ends, at[on])]
    return out


def _final_at(at: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """The last position at or before each of ``at`` that isn't one to skip; -1 where there is none."""
    out, on = at.copy(), np.flatnonzero(skip[at])
    if len(on):
        begins = np.append(-1, np.flatnonzero(~skip & _behind(skip)))
        out[on] = begins[np.searchsorted(begins, at[on]) - 1]
    return out


def _next(flags: np.ndarray) -> np.ndarray:
    """The first true position at or behind each; the length where there is none."""
    at = np.where(flags, np.arange(len(flags)), len(flags))
    return np.append(np.minimum.accumulate(at[::-1])[::-1], len(flags))


def _last(flags: np.ndarray) -> np.ndarray:
    """The last true position at or before each; -1 where there is none."""
    return np.maximum.accumulate(np.where(flags, np.arange(len(flags)), -1))


def _before(x: np.ndarray, first=False) -> np.ndarray:
    return np.concatenate([[first], x[:-1]])


def _behind(x: np.ndarray, last=False) -> np.ndarray:
    return np.concatenate([x[1:], [last]])


def expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(owner, place)`` of items of which owner i has ``counts[i]``."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


class PageLines:
    """Lines, units and their paths of a list of texts. Line arrays are over lines that aren't blank."""

    def __init__(self, texts: list[str]):
        c = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.minimum(c, _TOP).astype(np.uint16)
        flags = _CLASSES[c]
        # Runs of digits become one, words with an @ only that.
        digit = (c >= 48) & (c <= 57)
        keep = ~(digit & _before(digit))
        c[digit] = 48
        mail = np.flatnonzero(c == 64)
        if len(mail):
            blanks = np.append(-1, np.flatnonzero((flags & _IS_SPACE != 0) | (c == 10)))
            word = np.unique(np.searchsorted(blanks, mail))
            i, j = expand(blanks[word] - blanks[word - 1] - 1)
            j += blanks[word[i] - 1] + 1
            keep[j[c[j] != 64]] = False
        c, flags = c[keep], flags[keep]
        self.c, self._flags = c, flags
        space, self.nl = flags & _IS_SPACE != 0, c == 10
        edge = space | (c == 0xFFFD)
        ends = np.flatnonzero(self.nl)
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        per_page = np.array([t.count("\n") + 1 for t in texts], np.int64)
        page, place = expand(per_page)
        s, e = _first_at(starts, edge), _final_at(np.maximum(ends - 1, 0), edge) + 1
        full = s < np.minimum(e, ends)
        self.pages = len(texts)
        self.page, self.number, s, e, ends = page[full], place[full] + 1, s[full], e[full], ends[full]
        self.lines = len(s)
        self.is_title_line = self.number == 1
        # Pieces.
        apart = self.nl | ((flags & _IS_MARK != 0) & _before(space) & _behind(space)) | (c == 124) | (c == 9) | (space & _before(space))
        cut = ((flags & _IS_SPLIT != 0) & _behind(space | self.nl)) | (flags & _IS_WIDE != 0)
        a = np.flatnonzero(~apart & (_before(apart, True) | _before(cut)))
        b = np.flatnonzero(~apart & (_behind(apart, True) | cut)) + 1
        a, b = _first_at(a, edge), _final_at(b - 1, edge) + 1
        whole = a < b
        a, b = a[whole], b[whole]
        of = np.searchsorted(ends, a)
        self.pieces = np.bincount(of, minlength=self.lines)[:self.lines]
        many = self.pieces[of] > 1
        a, b, of = a[many], b[many], of[many]
        self.unit_line = np.concatenate([np.arange(self.lines), of])
        self.s, self.e = np.concatenate([s, a]), np.concatenate([e, b])
        self.marked = (c[s] == 187) | (c[s] == 0x203A)
        self._terms = None
        self._words(space, edge)
        self._shapes()
        self._paths()

    # --- words ---
    def _words(self, space: np.ndarray, edge: np.ndarray) -> None:
        c = self.c
        blank = space | self.nl
        self._begins = ~blank & _before(blank, True)
        self.ws = np.flatnonzero(self._begins)
        self.we = np.flatnonzero(~blank & _behind(blank, True)) + 1
        self._han = np.flatnonzero(self._flags & _IS_HAN)
        self._han_words = self.ws[HAN[c[self.ws]]]
        # The bullet is no part of the path.
        k = self.s
        after = c[np.minimum(k + 1, len(c) - 1)]
        later = c[np.minimum(k + 2, len(c) - 1)]
        one = BULLET[c[k]] & SPACE[after]
        two = (c[k] == 48) & ((after == 46) | (after == 41)) & SPACE[later]
        bare = np.where(one | two, _first_at(np.minimum(k + 1 + two, len(c)), edge), k)
        self.k = np.where(bare < self.e, bare, k)
        # The words that begin before a unit's first letter, and before its end.
        self._w0, self._w1 = np.searchsorted(self.ws, self.k), np.searchsorted(self.ws, self.e)
        self.weight = self._weight()

    def _weight(self) -> np.ndarray:
        """Words by spaces; Chinese characters count two to a word."""
        words = self._w1 - self._w0 + ~self._begins[self.k]
        han = np.searchsorted(self._han, self.e) - np.searchsorted(self._han, self.k)
        i = np.flatnonzero(han)
        latin = self._w1[i] - self._w0[i] - (np.searchsorted(self._han_words, self.e[i]) - np.searchsorted(self._han_words, self.k[i]))
        words[i] = (han[i] + 1) // 2 + latin
        return words

    # --- shapes ---
    def _shapes(self) -> None:
        c, n = self.c, self.lines
        last = _final_at(self.e - 1, self._flags & _IS_CLOSING != 0)
        self.stops = (last >= self.s) & STOP[c[np.maximum(last, 0)]]
        s, k, e = self.s[:n], self.k[:n], self.e[:n]
        self.size = e - s
        w, self.ends = self.weight[:n], self.stops[:n]
        self.para = self.ends & ((self.size > LONG_LINE) | (w >= 4))
        begins, closes = c[k], c[e - 1]
        #: Begins or ends with a number: a date, count, measure or numbered source.
        self.link = _starts(c, s, "http://") | _starts(c, s, "https://") | _starts(c, s, "www.")
        counted = (begins == 48) | (begins == 91) & (c[np.minimum(k + 1, len(c) - 1)] == 48)
        self.numeric = ~self.ends & ~self.link & (counted | (closes == 48))
        self.numbered_end = self.numeric & ~counted
        #: Items of a list by their bullet and number: lists belong to a text.
        self.counted_item = self.numeric & counted & (k > s)
        n_han = np.searchsorted(self._han, e) - np.searchsorted(self._han, s)
        han, self.chinese = n_han > 0, n_han * 3 >= e - s
        self.entry = ~self.ends & ~self.numeric & ~self.link & (w <= 3)
        self.title = ~self.ends & ~self.numeric & (self.size <= 120) & (w >= np.where(han, 3, 4))
        piece = np.arange(n, len(self.s))
        owner = self.unit_line[piece]
        self.sentence_pieces = np.bincount(owner[self.stops[piece]], minlength=n)
        long_ = np.bincount(owner[self.weight[piece] > 4], minlength=n)
        self.menu = (self.pieces > 1) & (long_ == 0) & (self.sentence_pieces == 0)
        between = np.flatnonzero(self._flags & _IS_BETWEEN)
        self.items = np.searchsorted(between, e) - np.searchsorted(between, s) + 1

    # --- paths ---
    def _paths(self) -> None:
        """``whole`` of each unit; ``form_unit, form_path`` further forms, in order of trial."""
        c, k, e = self.c, self.k, self.e
        self.sums = _Sums(c)
        self.whole = self.sums.of(k, e)
        ws, we = self.ws, self.we
        m = len(ws)
        up = UPPER[c[ws]] if m else np.zeros(0, bool)
        ends = NAME_END[c[we - 1]] if m else up
        w0, w1 = self._w0, self._w1
        ok = np.flatnonzero((w1 > w0) & (ws[np.minimum(w0, m - 1)] == k) & (c[k] != 48)) if m else np.zeros(0, np.int64)
        w0, w1, k, e = w0[ok], w1[ok], k[ok], e[ok]
        at = np.arange(m)
        stop = np.where(~up, at, np.where(ends, at + 1, m))
        run = np.append(np.minimum.accumulate(stop[::-1])[::-1], m) if m else np.zeros(1, np.int64)
        self.run = run
        head = np.minimum(run[w0], w1)
        with np.errstate(over="ignore"):
            # A name at the start; the mark behind it belongs to the form.
            i = np.flatnonzero((head > w0) & (head < w1))
            mark = np.where(ends[head[i] - 1], c[we[head[i] - 1] - 1], 0).astype(np.uint64)
            forms = [(ok[i], _mixed(self.sums.of(ws[head[i]], e[i]) + _HEAD * (mark + np.uint64(1))))]
            # A name at the end: any part of the run of capitalized words there.
            plain = _last(~up) if m else at
            tail = np.maximum(plain[w1 - 1] + 1, w0 + 1)
            last = c[e - 1]
            counts = np.where((last == 46) | (last == 33) | (last == 63), 0, np.maximum(w1 - tail, 0))
            i, j = expand(counts)
            forms.append((ok[i], _mixed(self.sums.of(k[i], we[w1[i] - 2 - j]) + _TAIL)))
            # One name inside.
            nxt = _next(up)
            a = nxt[np.maximum(w0 + 1, head)]
            i = np.flatnonzero((a < w1) & (counts == 0) & (w1 - w0 > 3))
            b = _next(~up)[a[i]]
            good = (b < w1[i]) & (nxt[b] >= w1[i])
            i, b = i[good], b[good]
            forms.append((ok[i], _mixed(self.sums.of(k[i], we[a[i] - 1]) * np.uint64(3) + self.sums.of(ws[b], e[i]))))
        self.form_unit, self.form_path = (np.concatenate(x) for x in zip(*forms))
        self._up = up

    def cuts(self, k: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ways to cut stretches in two before a capitalized word: ``(stretch, start of the second, path of the first, of the second, of the
        second without its name)``."""
        w0, w1 = np.searchsorted(self.ws, k), np.searchsorted(self.ws, e)
        i, j = expand(np.maximum(w1 - w0 - 1, 0))
        w = w0[i] + 1 + j
        cap = self._up[w]
        i, w = i[cap], w[cap]
        run = np.minimum(self.run[w], w1[i])
        rest = np.where(run < w1[i], run, w)
        with np.errstate(over="ignore"):
            bare = _mixed(self.sums.of(self.ws[rest], e[i]) + _HEAD)
        return i, self.ws[w], self.sums.of(k[i], self.we[w - 1]), self.sums.of(self.ws[w], e[i]), bare

    # --- terms ---
    def terms(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(line, term)`` of the words of the chosen lines, in order: hashes of lower-cased words, of pairs of Chinese characters."""
        if self._terms is None:
            c, n = self.c, self.lines
            han = self._flags & _IS_HAN != 0
            word = (self._flags & _IS_ALNUM != 0) & ~han
            begins, pair = word & ~_before(word), han & _behind(han)
            ends = np.flatnonzero(word & ~_behind(word)) + 1
            at = np.flatnonzero(begins | pair)
            end = at + 2
            latin = begins[at]
            end[latin] = ends
            bounds = np.searchsorted(at, self.e[:n])
            line = np.repeat(np.arange(n), np.diff(bounds, prepend=0))
            at, end = at[:len(line)], end[:len(line)]
            inside = at >= self.s[line]
            at, end, line = at[inside], end[inside], line[inside]
            self._terms = line, _Sums(LOWER[c]).of(at, end)
        line, term = self._terms
        chosen = lines[line]
        return line[chosen], term[chosen]


def _starts(c: np.ndarray, at: np.ndarray, text: str) -> np.ndarray:
    out = np.ones(len(at), bool)
    for i, x in enumerate(text):
        out &= c[np.minimum(at + i, len(c) - 1)] == ord(x)
    return out


def path(text: str) -> int:
    """The path of a line, as a signed number."""
    return int(PageLines([f"\n{text}"]).whole[:1].view(np.int64)[0])


def forms(text: str) -> list[int]:
    """All forms of a line's path."""
    p = PageLines([f"\n{text}"])
    return [int(x) for x in np.concatenate([p.whole[:1], p.form_path[p.form_unit == 0]]).view(np.int64)]


def hashed_words(words: list[str]) -> np.ndarray:
    """The terms that single words become."""
    p = PageLines([f"\n{w}" for w in words])
    return np.unique(p.terms(np.ones(p.lines, bool))[1])


def gaps(group: np.ndarray, term: np.ndarray) -> np.ndarray:
    """For each term, how many places before it the same one stands in its group (of neighbouring terms); 0 if none does."""
    order = np.lexsort((term, group))  # equal ones keep their order
    g, t = group[order], term[order]
    again = np.concatenate([[False], (g[1:] == g[:-1]) & (t[1:] == t[:-1])]) if len(order) else np.zeros(0, bool)
    out = np.zeros(len(term), np.int64)
    out[order[again]] = order[again] - order[np.flatnonzero(again) - 1]
    return out
