"""The parts of a web page: main text, site furniture, keyword and link lists.

Two passes over the records, each over arrays of all letters of many pages (see page_lines.py). In the first, every line, every entry or
sentence in a line and every container (titles or entries below one another, a menu in one line, the way to the page) gives its path, and the
paths are counted: on how many hosts of a language a path stands, on how many pages of its own host, and what follows it there. The
counts are the votes: a path on many hosts, or on most pages of its host, is furniture, unless it always introduces content, as a heading
does. In the second pass each page is cut again with the winning paths, those of its lines and those of its containers; what no winning path
covers is the page's own text, save lists of key words, which the gaps between recurrences of their words tell, and long lists of links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..runtime import materialize, small_side
from . import page_lines as pl
from .lines import LANGUAGES, label
from .page_lines import LONG_LINE, PageLines, gaps

#: Paths on a smaller share of a language's hosts have no vote beyond their own host.
HOST_SHARE = 0.01
#: Hosts with so many pages tell by their share of pages with a path whether it is the site's (most of them) or a page's own (few).
CONSENSUS_PAGES, SITE, OWN = 3, 0.4, 0.25
#: Without such hosts, a path is furniture where it stands on this share of a language's hosts, and on three at least.
FREQUENT = 0.05
#: The hosts' paths (some hundred numbers a host) go to every task up to so many hosts; beyond, pages are shuffled to them, each host's in SALT parts.
HOSTS_IN_MEMORY, SALT = 50_000, 64
#: A path is furniture of a host where it stands on this share of its pages, and on three at least.
PAGE_SHARE = 0.5
#: A word that stands among so many before it recurs (characters pairs: twice as many).
LAG = 16
#: Share of recurring words from which prose, lists and lines count as key words; that of sentences is below a third.
STUFFED, LISTED, REPEATED = 0.5, 0.5, 0.6
#: Among words with fewer function words than this, fewer recurrences will do.
BARE, BARE_LISTED = 0.12, 0.3
#: So many titles or addresses one below the other are a list of links, not a block of furniture.
LINKS = 12
FURNITURE, BLOCK_HEAD, HEADING = 1, 2, 3
#: Each language's bit in the set of labels that a host's pages have; the bit above them is for pages without one.
_LANG_BIT = {c: k for k, c in enumerate(LANGUAGES)}
_VOTES = "langs bigint, host bigint, page bigint, at timestamp, paths array<bigint>, counts array<bigint>"
_MOST = 0x7FFF
#: Letters that are looked at together, and pages.
_LETTERS, _PAGES = 1_500_000, 500
READ = "record_id string, content_hash bigint, spam boolean, furniture array<int>"


def _decoded(content) -> str:
    return content.decode("utf-8", "replace") if content else ""


def small(batches: Iterator[pa.RecordBatch], rows: int = _PAGES, letters: int = _LETTERS) -> Iterator[pa.RecordBatch]:
    """Batches cut to a size whose arrays take little memory; the first column is the content."""
    for b in batches:
        size = pc.binary_length(b.column(0)).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
        a = 0
        while a < b.num_rows:
            end = int(np.searchsorted(size, (size[a - 1] if a else 0) + letters, side="right"))
            end = min(max(end, a + 1), a + rows, b.num_rows)
            yield b.slice(a, end - a)
            a = end


# --- first pass ---
def _runs(flags: np.ndarray, page: np.ndarray) -> np.ndarray:
    """Length of the run of true lines that each line stands in; 0 for others."""
    n = len(flags)
    if not n:
        return np.zeros(0, np.int64)
    begin = flags & ~(np.concatenate([[False], flags[:-1] & (page[1:] == page[:-1])]))
    run = np.cumsum(begin)
    sizes = np.bincount(run[flags], minlength=int(run[-1]) + 1)
    return np.where(flags, sizes[run], 0)


def containers(p: PageLines) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(path, lines)`` of the containers."""
    body = ~p.is_title_line
    n = p.lines
    title_of = np.zeros(p.pages, np.uint64)
    title_of[p.page[~body]] = p.whole[:n][~body]
    final = np.zeros(n, np.uint64)
    final[p.unit_line[n:]] = p.whole[n:]  # the last piece of each line
    crumb = body & (p.pieces > 1) & (final == title_of[p.page])
    return [(pl.TITLES, body & (_runs(body & p.title & ~p.marked, p.page) >= 3)), (pl.ENTRIES, body & (_runs(body & p.entry, p.page) >= 3)),
            (pl.MARKED, body & p.marked), (pl.MENU, body & p.menu & ~crumb), (pl.CRUMB, crumb)]


def page_votes(p: PageLines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(page, path, counts)``, each path of a page once: lines, of them followed by content, by a title, behind the last paragraph, in 16
    bits each and 32,767 at most."""
    n = p.lines
    body = ~p.is_title_line
    same = np.concatenate([p.page[1:] == p.page[:-1], [False]]) if n else np.zeros(0, bool)
    content = np.concatenate([(p.para | p.numeric)[1:], [False]]) & same
    titles = np.concatenate([(p.title & ~p.numeric)[1:], [False]]) & same
    last = np.full(p.pages, -1)
    paragraphs = np.flatnonzero(p.para & (p.size > 60) & body)
    last[p.page[paragraphs]] = paragraphs
    trail = np.arange(n) > last[p.page]
    # Lines, with all forms unless they are long and of several sentences; entries with all forms; sentences in a line as they stand.
    single = np.concatenate([(p.sentence_pieces == 0) | (p.size <= LONG_LINE), ~p.stops[n:]])
    few = p.form_unit[single[p.form_unit]]
    unit = np.concatenate([np.arange(len(p.whole)), few])
    path = np.concatenate([p.whole, p.form_path[single[p.form_unit]]])
    line = p.unit_line[unit]
    voting = body[line]
    unit, path, line = unit[voting], path[voting], line[voting]
    is_line = unit < n
    # As an entry of a line it counts as behind the text: headings are never entries.
    cols = [is_line, is_line & content[line], is_line & titles[line], ~is_line | trail[line]]
    boxes = [(np.flatnonzero(rows), k) for k, rows in containers(p)]
    at = np.concatenate([r for r, _ in boxes])
    path = np.concatenate([path, *[np.full(len(r), k, np.uint64) for r, k in boxes]])
    cols = [np.concatenate([c, x]) for c, x in zip(cols, (np.ones(len(at), bool), np.zeros(len(at), bool), np.zeros(len(at), bool), np.ones(len(at), bool)))]
    page = np.concatenate([p.page[line], p.page[at]])
    order = np.lexsort((path, page))
    page, path = page[order], path[order]
    begin = np.flatnonzero(np.concatenate([[True], (page[1:] != page[:-1]) | (path[1:] != path[:-1])])) if len(order) else np.zeros(0, np.int64)
    counts = np.zeros(len(begin), np.int64)
    for k, c in enumerate(cols):
        if len(begin):
            counts |= np.minimum(np.add.reduceat(c[order].astype(np.int64), begin), _MOST) << (16 * k)
    return page[begin], path[begin].view(np.int64), counts


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        texts = [_decoded(x) for x in b.column(0).to_pylist()]
        rows = [i for i, t in enumerate(texts) if t.strip()]
        page, paths, counts = page_votes(PageLines([texts[i] for i in rows]))
        offsets = pa.array(np.searchsorted(page, np.arange(len(rows) + 1)).astype(np.int32))
        labels = b.column(1).to_pylist()
        rest = b.take(pa.array(rows, pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([1 << _LANG_BIT.get(label(labels[i]), len(LANGUAGES)) for i in rows], pa.int64()), rest.column(2), rest.column(3), rest.column(4),
             pa.ListArray.from_arrays(offsets, pa.array(paths)), pa.ListArray.from_arrays(offsets, pa.array(counts))],
            names=["langs", "host", "page", "at", "paths", "counts"])


def _places(records: DataFrame) -> DataFrame:
    """Records with hashes of their host and url. A null url has neither: such a page stands for itself by its content, so that different ones
    vote for their language, each as a host with one page, and equal ones once."""
    host = F.regexp_extract("url", r"^[a-zA-Z]+://([^/]*)", 1)
    alone = F.xxhash64(F.lit("no url"), "content")
    return records.withColumn("host", F.when(F.col("url").isNotNull(), F.xxhash64(host)).otherwise(alone)).withColumn(
        "page", F.when(F.col("url").isNotNull(), F.xxhash64("url")).otherwise(alone))


def vote(records: DataFrame) -> tuple[dict[int, int], DataFrame]:
    """``(winning paths of languages, (host, paths) of hosts)``.

    The latest capture of a url votes (by ``warc_date``, where there is one), repeated rows once. The languages' winners are few: each stands on a
    share HOST_SHARE of a language's hosts, so there are at most (paths of an average host) / HOST_SHARE of them a language, whatever the
    size of the crawl.
    """
    at = F.col("warc_date").cast("timestamp") if "warc_date" in records.columns else F.lit(None).cast("timestamp")
    raw = _places(records).select("content", "lang", "host", "page", at.alias("at")).mapInArrow(_first_pass, _VOTES)
    each = raw.groupBy("host", "page").agg(F.max(F.struct("at", "paths", "counts")).alias("v"), F.bit_or("langs").alias("langs"))  # one vote a page
    field = {c: F.shiftright("z.counts", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k, c in enumerate(("n", "content", "titles", "trail"))}
    on_host = (each.select("langs", "host", F.explode(F.arrays_zip("v.paths", "v.counts")).alias("z"))
               .groupBy(F.col("z.paths").alias("path"), "host")
               .agg(F.count(F.lit(1)).alias("pages"), *(F.sum(f).alias(c) for c, f in field.items()), F.bit_or("langs").alias("langs")))
    on_host = materialize(on_host, "path-votes")
    sizes = _places(records).where("octet_length(content) > 0").groupBy("host").agg(F.countDistinct("page").alias("all"))
    sizes = small_side(sizes.where(F.col("all") >= CONSENSUS_PAGES), "host-sizes")
    bits = range(len(LANGUAGES) + 1)
    has = [F.col("langs").bitwiseAND(F.lit(1 << k)) != 0 for k in bits]
    hosts = on_host.groupBy("host").agg(F.bit_or("langs").alias("langs")).agg(*(F.count_if(x) for x in has)).first()
    votes = on_host.join(sizes, "host", "left")
    part = {c: F.sum(F.least(F.col(c) / F.greatest("n", F.lit(1)), F.lit(1.0))).alias(c) for c in ("content", "titles", "trail")}
    # A host is one judge, whatever its pages' labels are; a language's hosts are those with a page of that label.
    of_lang = (votes.groupBy("path").agg(F.count("host").alias("h"), F.count_if(F.col("n") > 0).alias("n"), *part.values(), F.count("all").alias("judges"),
                                         F.sum(F.col("pages") / F.col("all")).alias("agree"), *(F.count_if(x).alias(f"h{k}") for k, x in zip(bits, has)))
               .where("h >= 2")
               .withColumn("share", F.greatest(*(F.when(F.col(f"h{k}") >= 2, F.col(f"h{k}") / F.lit(max(hosts[k], 1))).otherwise(0.0) for k in bits)))
               .where(F.col("share") >= HOST_SHARE).select("path", "share", "h", "n", *part, "judges", "agree"))
    winners = {r["path"]: k for r in of_lang.collect() if (k := kind(**{c: r[c] for c in r.asDict() if c != "path"}))}  # bounded, see above
    of_host = (votes.where("pages >= 3").where(F.col("pages") >= PAGE_SHARE * F.col("all"))
               .groupBy("host").agg(F.collect_set("path").alias("paths")))  # at most (paths of an average page) / PAGE_SHARE each
    return winners, of_host


def kind(share: float, h: int, n: int, content: float, titles: float, trail: float, judges: int, agree: float) -> int:
    """What a path is, from host averages; 0 for nothing in particular.

    Where hosts with several pages know it, their consensus decides: on most pages of each it is furniture. On few it is the pages' own, as
    headings are, unless it is frequent and mostly stands behind the text, as what changes from page to page around it does. Without
    such hosts a frequent path is furniture, unless it always stands before content and never behind it. Furniture before titles
    is a heading of links.
    """
    furniture = BLOCK_HEAD if n and titles >= 0.6 * n else FURNITURE
    if judges and agree >= SITE * judges:
        return furniture
    if share < FREQUENT or h < 3:
        return HEADING if judges and agree < OWN * judges and trail <= 0.1 * n and share >= FREQUENT / 2 else 0
    if judges:
        return HEADING if trail <= 0.1 * n else furniture if trail >= 0.3 * n else 0
    return HEADING if n and content >= 0.88 * n and trail <= 0.02 * n else furniture


# --- second pass ---
#: What a line is: title, blank, furniture, furniture above a block, key words, links, prose, item with a number, other main text.
TITLE, BLANK, SITES, BLOCK, KEYS, LINKED, PROSE, ITEM, OTHER = range(9)
NOT_MAIN = (SITES, BLOCK, KEYS, LINKED)


class Sorted:
    """Numbers to look up, with a value each."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def of(self, asked: np.ndarray) -> np.ndarray:
        """The value of each number asked; 0 where it isn't there."""
        if not len(self.keys):
            return np.zeros(len(asked), np.int8)
        i = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        return np.where(self.keys[i] == asked, self.values[i], 0)


class PageReader:
    """Cuts pages with the winning paths. ``function_words`` tells sentences and titles from mere lists of nouns."""

    def __init__(self, winners: dict[int, int], function_words: frozenset[str]):
        self.winners = Sorted(np.array(list(winners), np.int64).view(np.uint64), np.array(list(winners.values()), np.int8))
        self.function_words = pl.hashed_words(sorted(function_words))

    def read(self, texts: list[str], host: np.ndarray | None = None, own: list[np.ndarray] | None = None) -> tuple[PageLines, np.ndarray]:
        """The lines of the texts and what each is. ``own[host[i]]`` are the winning paths of the i-th text's host."""
        p = PageLines(texts)
        n = p.lines
        host = np.zeros(len(texts), np.int64) if host is None else host
        sizes = np.array([len(x) for x in own or []], np.int64)
        lookup = Sorted(self._at(np.concatenate([np.zeros(0, np.int64), *(own or [])]).view(np.uint64), np.repeat(np.arange(len(sizes)), sizes)),
                        np.full(int(sizes.sum()), FURNITURE, np.int8))

        def kinds(path: np.ndarray, unit: np.ndarray) -> np.ndarray:
            got = self.winners.of(path)
            left = np.flatnonzero(got == 0)
            got[left] = lookup.of(self._at(path[left], host[p.page[p.unit_line[unit[left]]]]))
            return got

        unit = np.arange(len(p.whole))
        known = kinds(p.whole, unit)
        open_ = known[p.form_unit] == 0
        at, found = p.form_unit[open_], kinds(p.form_path[open_], p.form_unit[open_])
        hit = np.flatnonzero(found)[::-1]  # of several forms the first
        known[at[hit]] = found[hit]
        known[(known == HEADING) & p.stops] = FURNITURE

        def wins(path: np.uint64) -> np.ndarray:
            """For each page."""
            pages = np.arange(len(texts))
            every = np.full(len(texts), path, np.uint64)
            got = self.winners.of(every)
            return (got == FURNITURE) | (got == BLOCK_HEAD) | (lookup.of(self._at(every, host)) > 0) if len(pages) else np.zeros(0, bool)

        boxes = {k: (rows, wins(k)[p.page]) for k, rows in containers(p)}
        covered = self._covered(p, known)
        out = np.full(n, OTHER, np.int8)
        line = known[:n]
        out[p.ends] = PROSE
        out[p.numeric] = ITEM
        menu = p.menu & ((p.pieces >= 3) | (self._known_pieces(p, known) > 0)) & boxes[pl.MENU][1]
        out[menu | boxes[pl.CRUMB][0] & boxes[pl.CRUMB][1]] = SITES
        out[self._key_words(p, out)] = KEYS
        out[covered] = SITES
        out[line == HEADING] = OTHER
        out[line == FURNITURE] = SITES
        out[line == BLOCK_HEAD] = BLOCK
        out[p.counted_item] = ITEM
        out[p.is_title_line] = TITLE
        shaped = (out == OTHER) & (line != HEADING)
        form = np.where(shaped, np.where(p.entry, 1, 2), 0).astype(np.int8)
        self._stuffed(p, out)
        self._lists(p, out, form, boxes)
        out[out == BLOCK] = SITES
        return p, out

    @staticmethod
    def _at(path: np.ndarray, host: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return path + (host.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)

    @staticmethod
    def _known_pieces(p: PageLines, known: np.ndarray) -> np.ndarray:
        k = known[p.lines:]
        return np.bincount(p.unit_line[p.lines:][(k == FURNITURE) | (k == BLOCK_HEAD)], minlength=p.lines)

    def _covered(self, p: PageLines, known: np.ndarray) -> np.ndarray:
        """Lines of whose words known pieces make up half, wherever they stand; so are texts set one behind the other without a mark."""
        n = p.lines
        good = (known == FURNITURE) | (known == BLOCK_HEAD)
        good = good.copy()
        unit = np.flatnonzero(~good & np.concatenate([p.pieces == 1, np.ones(len(known) - n, bool)]))
        k = p.k[unit]
        while len(unit):
            i, start, before, behind, bare = p.cuts(k, p.e[unit])
            on = np.flatnonzero(self.winners.of(before) == FURNITURE)
            i, start, behind, bare = i[on], start[on], behind[on], bare[on]
            done = (self.winners.of(behind) == FURNITURE) | (self.winners.of(bare) == FURNITURE)
            good[unit[i[done]]] = True
            left = ~good[unit[i]]
            unit, k = unit[i[left]], start[left]  # the rest may be several, too
        piece, w = p.unit_line[n:], p.weight[n:]
        total = np.bincount(piece, w, n)
        hit = np.bincount(piece[good[n:]], w[good[n:]], n)
        return np.where(p.pieces > 1, (hit * 2 >= total) & (total > 0), good[:n])

    # --- recurrence ---
    def _recurrence(self, p: PageLines, lines: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each line: ``(words, function words, content words, of them recurring)``. A word recurs where the gap to the same one before it, in its
        group of lines and function words aside, is at most LAG: the sum of its autocorrelation over these lags, word by word."""
        n = p.lines
        line, term = p.terms(lines)
        function = np.isin(term, self.function_words)
        at, words = line[~function], term[~function]
        gap = gaps(group[at], words)
        lag = np.where(p.chinese, 2 * LAG, LAG)[at]
        size = lambda x: np.bincount(x, minlength=n)
        return size(line), size(line[function]), size(at), size(at[(gap > 0) & (gap <= lag)])

    def _key_words(self, p: PageLines, out: np.ndarray) -> np.ndarray:
        """Lines that by themselves are lists of key words: the same ones again and again, or many items of a few words."""
        asked = ((out == OTHER) | (out == SITES)) & (p.size >= 40) & ~p.is_title_line
        words, function, content, again = self._recurrence(p, asked, np.arange(p.lines))
        r = np.where((words >= 12) & (content >= 6), again / np.maximum(content, 1), 0.0)
        bare = function <= BARE * words
        listed = (p.items >= 5) & ((words <= 3 * p.items) | (words <= 6 * p.items) & (bare | (r >= BARE_LISTED))) & (out == OTHER)
        return asked & (listed | (r >= REPEATED) | (r >= BARE_LISTED + 0.05) & bare)

    def _stuffed(self, p: PageLines, out: np.ndarray) -> None:
        """Key words made up as sentences: prose whose words recur at short gaps, line after line."""
        prose = out == PROSE
        _, _, content, again = self._recurrence(p, prose, p.page)
        at = np.flatnonzero(prose)
        page = np.concatenate([[-1, -1], p.page[at], [-2, -2]])

        def near(x: np.ndarray) -> np.ndarray:
            """Sums over five lines."""
            x = np.concatenate([[0, 0], x[at], [0, 0]])
            return sum(np.where(page[2 + d:len(page) - 2 + d] == page[2:-2], x[2 + d:len(x) - 2 + d], 0) for d in range(-2, 3))

        words, hits = near(content), near(again)
        out[at[(words >= 12) & (hits >= STUFFED * words) & (again[at] >= STUFFED / 2 * content[at])]] = KEYS

    # --- containers ---
    def _lists(self, p: PageLines, out: np.ndarray, form: np.ndarray, boxes: dict) -> None:
        words, function, content, again = (x.tolist() for x in self._recurrence(p, form > 0, p.page))
        winning = {k: w.tolist() for k, (_, w) in boxes.items()}
        weights, marked, kinds, forms = p.weight[:p.lines].tolist(), p.marked.tolist(), out.tolist(), form.tolist()
        loose = ((form > 0) | p.numbered_end & (out == ITEM)).tolist()
        bounds = np.searchsorted(p.page, np.arange(p.pages + 1)).tolist()
        for a, b in zip(bounds, bounds[1:]):
            if any(loose[a:b]):
                _Containers(kinds, forms, loose, weights, marked, (words, function, content, again), winning, a, b).settle()
        out[:] = kinds


class _Containers:
    """Runs of short lines of one page, the lines ``first`` to ``end`` of lists over many: what of them is a list of key words or links, and what is
    the site's by the winning paths of containers."""

    def __init__(self, out, form, loose, weight, marked, terms, wins, first: int, end: int):
        self.out, self.form, self.loose, self.weight, self.marked, self.terms, self.wins = out, form, loose, weight, marked, terms, wins
        self.first, self.end = first, end

    def settle(self) -> None:
        out, form, i = self.out, self.form, self.first
        while i < self.end:
            if not form[i]:
                i += 1
                continue
            j = i
            while j < self.end and (form[j] or out[j] in (SITES, BLOCK)):
                j += 1
            a = i
            while a > self.first and out[a - 1] in (SITES, BLOCK):
                a -= 1
            self._run(a, j)
            i = j
        # What is left between furniture and more furniture, or the end, belongs to it: a heading has its text below.
        before, i = TITLE, self.first
        while i < self.end:
            if out[i] in (OTHER, ITEM) and self.loose[i] and before in (SITES, BLOCK):
                j = i
                while j < self.end and out[j] in (OTHER, ITEM) and self.loose[j]:
                    j += 1
                if j == self.end or out[j] in (SITES, BLOCK) and all(form[i:j]):
                    out[i:j] = [SITES] * (j - i)
                before = out[j - 1]
                i = j
            else:
                before = out[i]
                i += 1

    def _run(self, a: int, b: int) -> None:
        out, form = self.out, self.form
        at = [i for i in range(a, b) if form[i]]
        if self._key_words(at):
            for i in at:
                out[i] = KEYS
            return
        if self._longest(a, b) >= LINKS and sum(form[i] == 2 for i in at) * 3 >= len(at):
            for i in at:
                out[i] = LINKED
            return
        i = a
        while i < b:
            below = i > self.first and out[i - 1] == BLOCK
            if form[i] == 2 or form[i] and (below or self.marked[i]):
                j = i
                while j < b and form[j]:
                    j += 1
                titles = sum(form[k] == 2 for k in range(i, j)) >= 3 and self.wins[pl.TITLES][i]
                if below or titles or any(self.marked[k] for k in range(i, j)) and self.wins[pl.MARKED][i]:
                    out[i:j] = [SITES if form[k] else out[k] for k in range(i, j)]
                i = j
            elif form[i] == 1:
                j = i
                while j < b and (form[j] == 1 or out[j] == SITES and self.weight[j] <= 4):
                    j += 1
                s = i
                while s > a and out[s - 1] == SITES and self.weight[s - 1] <= 4:
                    s -= 1
                known = any(out[k] == SITES and not form[k] for k in range(s, j))
                heads = j - i == 1 and j + 2 < b and form[j] == form[j + 1] == form[j + 2] == 2 and self.wins[pl.TITLES][i]
                if known or j - s >= 3 and self.wins[pl.ENTRIES][i] or heads:
                    out[i:j] = [SITES] * (j - i)
                i = j
            else:
                i += 1

    def _longest(self, a: int, b: int) -> int:
        best = now = 0
        for i in range(a, b):
            now = now + 1 if self.form[i] else 0
            best = max(best, now)
        return best

    def _key_words(self, at: list[int]) -> bool:
        """Many short lines of the same few words, or of products and addresses without function words."""
        if len(at) < 6:
            return False
        words, function, content, again = (sum(x[i] for i in at) for x in self.terms)
        r = again / content if words >= 12 and content >= 6 else 0.0
        return r >= LISTED or r >= BARE_LISTED and function <= BARE * words


def spam(p: PageLines, kinds: np.ndarray) -> np.ndarray:
    """Pages with more words in key-word and link lists than in sentences."""
    w = p.weight[:p.lines]
    lists, prose = ((kinds == KEYS) | (kinds == LINKED)), kinds == PROSE
    return np.bincount(p.page[lists], w[lists], p.pages) > np.bincount(p.page[prose], w[prose], p.pages)


def function_words(samples: DataFrame, share: float = 0.15, most: int = 100_000) -> frozenset[str]:
    """Lower-case words in at least ``share`` of a language's samples; ``samples`` is the labelled set of a few hundred texts.

    A language has at most (words of an average sample) / ``share`` of them; more than ``most`` in all is an error.
    """
    w = samples.where("lang IS NOT NULL AND text IS NOT NULL").select("sample_id", "lang", F.explode(F.array_distinct(
        F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1))).alias("w"))
    sizes = samples.groupBy("lang").agg(F.count(F.lit(1)).alias("all"))
    rows = w.groupBy("lang", "w").count().join(sizes, "lang").where(F.col("count") >= share * F.col("all")).select("w").distinct()
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} function words")
    return frozenset(r["w"] for r in got)


def with_own_paths(records: DataFrame, of_host: DataFrame, columns: list[str]) -> DataFrame:
    """``content``, ``columns``, ``host`` and the host's winning ``paths`` of records with content. Up to HOSTS_IN_MEMORY hosts their paths go to every task;
    beyond, records are shuffled by host and SALT, so that a host with a large share of them is many tasks."""
    rows = _places(records).where("octet_length(content) > 0").select("content", *columns, "host")
    written = materialize(of_host, "host-paths")
    if written.count() <= HOSTS_IN_MEMORY:
        out = rows.join(F.broadcast(written), "host", "left")
    else:
        out = rows.withColumn("salt", F.pmod(F.xxhash64("content"), F.lit(SALT))).join(
            written.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint")))), ["host", "salt"], "left")
    return out.select("content", *columns, "host", "paths")


def own_paths(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """``(number of each row's host, the paths of each host)``."""
    _, first, number = np.unique(hosts.fill_null(0).to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
    return number, [np.zeros(0, np.int64) if x is None else x.values.to_numpy() for x in (paths[int(i)] if paths[int(i)].is_valid else None for i in first)]


def pages_of(reader: PageReader, b: pa.RecordBatch) -> tuple[list[int], list[str], PageLines, np.ndarray]:
    """``(rows with text, their texts, lines, kinds)`` of a batch whose first column is the content and whose last are host and paths."""
    texts = [_decoded(x) for x in b.column(0).to_pylist()]
    rows = [i for i, t in enumerate(texts) if t.strip()]
    number, own = own_paths(b.column(b.num_columns - 2), b.column(b.num_columns - 1))
    texts = [texts[i] for i in rows]
    return rows, texts, *reader.read(texts, number[rows], own)


def read_pages(records: DataFrame, samples: DataFrame) -> DataFrame:
    """``(record_id, content_hash, spam, furniture)`` of every record with content, repeated rows included.

    ``furniture`` has the numbers, from 1, of lines that are not main text. Null ids are kept; content that isn't valid UTF-8 is read
    with marks in place of its bad bytes; null, empty and blank content has no row.
    """
    winners, of_host = vote(records)
    words_ = function_words(samples)
    rows = with_own_paths(records.withColumn("content_hash", F.xxhash64("content")), of_host, ["record_id", "content_hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = PageReader(winners, words_)
        for b in small(batches):
            at, texts, p, kinds = pages_of(reader, b)
            out = np.isin(kinds, NOT_MAIN)
            offsets = pa.array(np.searchsorted(p.page[out], np.arange(len(texts) + 1)).astype(np.int32))
            rest = b.take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [rest.column(1), rest.column(2), pa.array(spam(p, kinds)), pa.ListArray.from_arrays(offsets, pa.array(p.number[out].astype(np.int32)))],
                names=["record_id", "content_hash", "spam", "furniture"])

    return rows.mapInArrow(run, READ)


def spam_records(pages: DataFrame) -> DataFrame:
    """Each record once whose lists of key words, links or products outweigh its sentences."""
    return pages.where("spam").select("record_id").distinct()


def _one(pages: DataFrame) -> DataFrame:
    """One row of each record: of rows with different contents under one id that with the largest hash."""
    return pages.groupBy("record_id").agg(F.max(F.struct("content_hash", "spam", "furniture")).alias("r")).select("record_id", "r.*")


def boilerplate(pages: DataFrame) -> DataFrame:
    """``(record_id, line_no)`` of the lines that are not main text, each once; spam records have none."""
    return _one(pages).where("NOT spam").select("record_id", F.explode("furniture").alias("line_no"))


def main_text(pages: DataFrame, records: DataFrame) -> DataFrame:
    """``(record_id, text)``: each record's content without its furniture; title and blank lines stay."""
    content = records.where("content IS NOT NULL").withColumn("content_hash", F.xxhash64("content")).select("record_id", "content_hash", "content")
    content = content.dropDuplicates(["record_id", "content_hash"])
    numbered = F.transform(F.split(F.make_valid_utf8(F.col("content").cast("string")), "\n", -1), lambda x, i: F.struct((i + 1).alias("n"), x.alias("x")))
    return content.join(_one(pages).where("NOT spam"), ["record_id", "content_hash"]).select("record_id", F.array_join(F.transform(F.filter(
        numbered, lambda s: ~F.array_contains("furniture", s["n"])), lambda s: s["x"]), "\n").alias("text"))
