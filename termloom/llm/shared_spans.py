"""Long exact passages that more than one document holds.

Every text is reduced to its winnowed anchors (see anchors.py), which two texts share wherever they share a passage of
``min_chars``. Anchors found in one document only are dropped by one aggregation; what stands around the others, the candidate segments,
is all that can hold a shared passage. Segments are cut into shards of documents. Each shard is one FM-index over the letters of its
segments, and the segments of all documents with an anchor in common with the shard are streamed through it: backward search gives for the end of
every aligned block of ``min_chars / 2`` letters its matching statistics, the longest stretch of letters up to there that the shard holds, and
where. Stretches that go on to the right for ``min_chars`` letters in all are reported. A passage holds such a block and is taken up at its leftmost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import materialize, small_side
from .anchors import Winnower
from .fm_index import FMIndex

MIN_CHARS = 200
#: Letters that one shard holds on average; an index takes about 40 bytes a letter while it is built.
SHARD_CHARS = 1_000_000
#: Beyond so many shards a task takes several, one after the other.
MAX_TASKS = 20_000
RUNS = "doc_a bigint, doc_b bigint, start_a int, start_b int, length int"


def _long(docs: DataFrame, min_chars: int) -> DataFrame:
    """Texts long enough, with a digest."""
    return docs.where((F.char_length("text") >= min_chars) & F.col("doc_id").isNotNull()).select("doc_id", "text", F.sha2("text", 256).alias("digest"))


def text_digests(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, digest)`` of texts of at least ``min_chars``; only these are shuffled."""
    return _long(docs, min_chars).select("doc_id", "digest").distinct()


def classes(digests: DataFrame) -> DataFrame:
    """``(doc_id, rep, digest)``: the smallest doc_id with exactly the same text."""
    return digests.join(digests.groupBy("digest").agg(F.min("doc_id").alias("rep")), "digest").select("doc_id", "rep", "digest")


def winnowing(min_chars: int) -> tuple[int, int]:
    """``(gram, window)``: any run of ``min_chars`` holds a whole window, and anchors of a run leave no character between their grams."""
    gram = min_chars // 2 + 1
    return gram, min_chars - gram + 1


def find_anchors(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(hash, doc_id, pos)``."""
    gram, window = winnowing(min_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Winnower(gram, window)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            who, at, h = w.of_texts(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[who].astype(np.int64)), pa.array(at.astype(np.int32))],
                                             names=["hash", "doc_id", "pos"])

    return docs.select("doc_id", "text").mapInArrow(run, "hash bigint, doc_id bigint, pos int")


def segments(text: str, positions: list[int], gram: int, window: int) -> list[tuple[int, str]]:
    """``(start, letters)`` of the stretches of a text that can hold a passage with one of the anchors; overlapping ones are one."""
    spans: list[list[int]] = []
    for p in positions:
        begin, end = max(0, p - window + 1), p + gram + window - 1
        if spans and begin <= spans[-1][1]:
            spans[-1][1] = end
        else:
            spans.append([begin, end])
    return [(a, text[a:b]) for a, b in spans if a < len(text)]


class Stretches:
    """Segments of many documents as one array of letters, each followed by ``between``, which no text holds."""

    def __init__(self, rows: list[tuple[int, int, str]], between: int):
        self.doc = np.array([r[0] for r in rows], np.int64)
        self.offset = np.array([r[1] for r in rows], np.int64)
        self.size = np.array([len(r[2]) for r in rows], np.int64)
        self.end = np.cumsum(self.size + 1)
        self.begin = self.end - self.size - 1
        codes = np.frombuffer("\0".join([*[r[2] for r in rows], ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        codes[self.end - 1] = between
        self.codes = codes

    def where(self, at: np.ndarray) -> np.ndarray:
        """The segment of each position."""
        return np.searchsorted(self.end, at, side="right")


class Shard:
    """The FM-index of one shard's segments."""

    def __init__(self, rows: list[tuple[int, int, str]], min_chars: int):
        self.min_chars, self.block = min_chars, (min_chars + 1) // 2  # any passage holds an aligned block of this size
        self.held = Stretches(rows, -1)
        self.alphabet = np.unique(self.held.codes)  # the separator comes first and is symbol 0
        self.fm = FMIndex(np.searchsorted(self.alphabet, self.held.codes), len(self.alphabet), 2 * self.block)

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """Symbols of letters; 0 for those that the shard doesn't hold."""
        s = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[s] == codes, s, 0)

    def matches(self, asked: Stretches, least: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Matching statistics of block ends: ``(block start in asked, letters matched before it, start of the match in held)`` in parts.

        Each occurrence of a block is listed with the letters that match before it, less than one block: one that matches more
        belongs to the block before. Stretches with fewer than ``least`` occurrences are given up.
        """
        m, fm = self.block, self.fm
        n = asked.size // m
        at = np.repeat(asked.begin, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * m
        symbols = np.concatenate([np.zeros(m, np.int64), self.symbols(asked.codes)])  # shifted by m: the first block looks back, too
        s = symbols[at + m + m - 1]
        lo, hi = fm.symbol(s)
        on = (s > 0) & (hi - lo >= least)
        at, lo, hi = at[on], lo[on], hi[on]
        for k in range(m - 2, -m - 1, -1):
            if not len(at):
                return
            s = symbols[at + m + k]
            a, b = fm.extend(s, lo, hi)
            gone = s == 0
            b[gone] = a[gone]
            if k < 0:  # the block matches whole; here end the stretches of the occurrences that stay behind
                ends = np.flatnonzero(b - a < hi - lo)
                yield from self._listed(at[ends], -k - 1, s[ends], lo[ends], hi[ends])
            on = b - a >= least
            at, lo, hi = (x[on] for x in (at, a, b)) if not on.all() else (at, a, b)

    def _listed(self, at, before: int, s, lo, hi, most: int = 1 << 15):
        """Occurrences in the intervals that aren't preceded by ``s``; ``most`` at a time, so frequent passages need no more memory."""
        sizes = (hi - lo).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        for c in range(0, int(sizes.sum()), most):
            x = np.arange(c, min(c + most, int(sizes.sum())))
            i = np.searchsorted(first, x, side="right") - 1
            k = lo[i] + (x - first[i])
            out = (self.fm.letters[k] != s[i]) | (s[i] == 0)
            yield at[i[out]], np.full(int(out.sum()), before), self.fm.sa[k[out]].astype(np.int64)

    def runs(self, asked: Stretches | None = None) -> np.ndarray:
        """Rows of RUNS: passages of at least ``min_chars`` letters in the asked documents and in this shard's; without any asked, in
        two of this shard's."""
        same = asked is None
        q = self.held if same else asked
        found = []
        for at, before, j in self.matches(q, 1 + same):  # its own occurrence is always among them
            i = at - before
            a, b = q.where(i), self.held.where(j)
            keep = q.doc[a] > self.held.doc[b] if same else q.doc[a] != self.held.doc[b]
            i, j, at, before, a, b = (x[keep] for x in (i, j, at, before, a, b))
            n = before + self.block
            n += common(q.codes, i + n, self.held.codes, j + n)
            keep = n >= self.min_chars
            i, j, a, b, n = (x[keep] for x in (i, j, a, b, n))
            found.append(np.stack([q.doc[a], self.held.doc[b], i - q.begin[a] + q.offset[a], j - self.held.begin[b] + self.held.offset[b], n]))
        rows = np.concatenate(found, axis=1) if found else np.zeros((5, 0), np.int64)
        turn = rows[0] > rows[1]
        rows[:, turn] = rows[[1, 0, 3, 2, 4]][:, turn]
        return np.unique(rows, axis=1)


def common(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray, step: int = 64) -> np.ndarray:
    """Letters in common from ``x[i]`` and ``y[j]`` on; every text ends with a negative number."""
    n, on, k = np.zeros(len(i), np.int64), np.arange(len(i)), np.arange(step)
    while len(on):
        p, q = (i[on] + n[on])[:, None] + k, (j[on] + n[on])[:, None] + k
        letters = x[np.minimum(p, len(x) - 1)]
        unlike = (letters != y[np.minimum(q, len(y) - 1)]) | (letters < 0) | (p >= len(x)) | (q >= len(y))
        stop = unlike.any(axis=1)
        n[on] += np.where(stop, unlike.argmax(axis=1), step)
        on = on[~stop]
    return n


def find_runs(rows: DataFrame, min_chars: int, batch_chars: int = 1 << 20) -> DataFrame:
    """Runs from ``(shard, asked, doc_id, start, letters)``, placed by shard and sorted so that a shard's own segments come first.

    A task holds one shard and about ``batch_chars`` letters of the segments asked.
    """
    def batch(runs: np.ndarray) -> pa.RecordBatch:
        ids, places = [pa.array(r) for r in runs[:2]], [pa.array(r.astype(np.int32)) for r in runs[2:]]
        return pa.RecordBatch.from_arrays([*ids, *places], names=["doc_a", "doc_b", "start_a", "start_b", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, held, asked, size = None, None, [], [], 0
        for b in batches:
            for s, ask, doc, start, letters in zip(*(c.to_pylist() for c in b.columns)):
                if s != now:
                    if asked:
                        yield batch(shard.runs(Stretches(asked, -2)))
                    elif held:
                        yield batch(Shard(held, min_chars).runs())
                    now, shard, held, asked, size = s, None, [], [], 0
                if not ask:
                    held.append((doc, start, letters))
                    continue
                if held:
                    shard, held = Shard(held, min_chars), []
                    yield batch(shard.runs())
                if shard is not None:
                    asked.append((doc, start, letters))
                    size += len(letters)
                    if size >= batch_chars:
                        yield batch(shard.runs(Stretches(asked, -2)))
                        asked, size = [], 0
        if asked:
            yield batch(shard.runs(Stretches(asked, -2)))
        elif held:
            yield batch(Shard(held, min_chars).runs())

    return rows.select("shard", "asked", "doc_id", "start", "letters").mapInArrow(run, RUNS)


def shared_runs(docs: DataFrame, min_chars: int = MIN_CHARS, shard_chars: int = SHARD_CHARS) -> tuple[DataFrame, DataFrame]:
    """``(runs, classes)``: maximal common runs of at least ``min_chars`` between different texts (columns of RUNS, doc_a < doc_b, both
    representatives), and ``(doc_id, rep)`` of every document long enough.

    Runs are counted in characters as stored. Null and shorter texts have none; a passage repeated within one document is not shared; exact
    copies are one class, so they cost one document's work. Ids must not be null; of a repeated id with different texts each text counts.
    """
    digests = materialize(text_digests(docs, min_chars), "digests")
    members = materialize(classes(digests), "text-classes")
    copies = small_side(members.where("doc_id <> rep").select("doc_id", "digest").distinct(), "copies")
    unique = _long(docs, min_chars).join(copies, ["doc_id", "digest"], "left_anti").select("doc_id", "text")
    placed = find_anchors(unique, min_chars).repartition("hash")  # one exchange, read by both sides of the join
    common_ = placed.groupBy("hash").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("hash")
    shared = materialize(placed.join(common_, "hash"), "shared-anchors")
    gram, window = winnowing(min_chars)
    shards = max(1, -(-shared.count() * window // shard_chars))  # a segment has an anchor in about half a window
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")
    meet = shared.select("hash", shard.alias("shard")).distinct().groupBy("hash").agg(F.collect_set("shard").alias("others"))  # at most `shards` each
    others = (shared.select("hash", "doc_id").distinct().join(meet, "hash").select("doc_id", F.explode("others").alias("other"))
              .where(F.col("other") < shard).distinct().groupBy("doc_id").agg(F.collect_list("other").alias("others")))
    anchors = shared.groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("positions"))  # bounded by one text
    plan = small_side(anchors.join(others, "doc_id", "left"), "sharing-documents", 100_000)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists, starts, letters = [], [], [], []
            for doc, text, positions, rest in zip(*(c.to_pylist() for c in b.columns)):
                for start, piece in segments(text, positions, gram, window):
                    ids.append(doc)
                    lists.append(rest or [])
                    starts.append(start)
                    letters.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lists, pa.list_(pa.int32())), pa.array(starts, pa.int32()),
                                              pa.array(letters, pa.string())], names=["doc_id", "others", "start", "letters"])

    pieces = unique.join(plan, "doc_id").select("doc_id", "text", "positions", "others").mapInArrow(
        cut, "doc_id bigint, others array<int>, start int, letters string")
    to = F.concat(F.array(F.struct(shard.alias("shard"), F.lit(False).alias("asked"))),
                  F.transform("others", lambda x: F.struct(x.alias("shard"), F.lit(True).alias("asked"))))
    rows = pieces.select("doc_id", "start", "letters", F.explode(to).alias("to")).select("to.shard", "to.asked", "doc_id", "start", "letters")
    tasks = min(shards, MAX_TASKS)
    rows = rows.repartitionById(tasks, F.col("shard") % tasks).sortWithinPartitions("shard", "asked")
    return materialize(find_runs(rows, min_chars), "shared-runs"), members


def document_pairs(runs: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs ``doc_a < doc_b`` of documents that share a run, copies expanded."""
    links = runs.select("doc_a", "doc_b").distinct()
    a, b = (members.select(F.col("doc_id").alias(f"m{x}"), F.col("rep").alias(f"doc_{x}")) for x in "ab")
    between = links.join(a, "doc_a").join(b, "doc_b").select(F.least("ma", "mb").alias("doc_a"), F.greatest("ma", "mb").alias("doc_b"))
    m = members.select("rep", F.col("doc_id").alias("doc_a"))
    within = m.join(members.select("rep", F.col("doc_id").alias("doc_b")), "rep").where("doc_a < doc_b").select("doc_a", "doc_b")
    return between.unionByName(within).distinct()


def shared_per_document(docs: DataFrame, runs: DataFrame, members: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, shared_chars, share)`` of every document: characters inside some run, each counted once."""
    ends = [runs.select(F.col(f"doc_{x}").alias("rep"), F.col(f"start_{x}").alias("start"), (F.col(f"start_{x}") + F.col("length")).alias("end")) for x in "ab"]
    spans = ends[0].unionByName(ends[1]).groupBy("rep", "start").agg(F.max("end").alias("end"))
    before = Window.partitionBy("rep").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))
    covered = spans.select("rep", F.greatest(fresh, F.lit(0)).alias("n")).groupBy("rep").agg(F.sum("n").alias("n"))
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    per = members.join(sizes, "rep").join(covered, "rep", "left").select("doc_id", "copies", "n")
    chars = F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint")
    out = docs.select("doc_id", chars.alias("n_chars")).join(per, "doc_id", "left")
    shared = F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("n", F.lit(0)))
    return out.select("doc_id", "n_chars", shared.alias("shared_chars"), F.round(shared / F.greatest("n_chars", F.lit(1)), 6).alias("share"))
