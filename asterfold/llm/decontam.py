"""Benchmark decontamination: q-gram lemma filtering in overlapping diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asterfold.llm.common import as_text, filter_texts, texts_of

#: Characters of a q-gram, edits a match may have as a share of the item's length. Items under LEAST_CHARS characters
#: are searched without edits, from word edge to word edge.
Q, EDIT_RATE, LEAST_CHARS = 8, 0.1, 32
#: Shared q-grams that an item's budget must leave, as a share of its length; longer budgets are cut down to it.
LEAST_SHARED = 0.12
#: Characters of benchmark text that one broadcast holds; a larger benchmark is searched block by block.
BLOCK_CHARS = 4_000_000
#: Ratio of lengths within a class of items; slots of the presence table for each q-gram (a byte each), its bounds.
CLASS_RATIO, TABLE_SLOTS, TABLE_BITS = 1.3, 16, (16, 26)
#: Characters scanned at once, pairs of equal q-grams counted at once, diagonals aligned at once.
SCAN, PAIRS, DIAGONALS = 1 << 21, 1 << 20, 1 << 18

_BASE = np.uint32(2654435761)
_GAP = 0x110000  # no code point: stands between texts


def folded(text: str) -> str:
    """Lower-cased where that keeps the length: all but the one letter whose lower case is two characters."""
    return "\u0130".join(part.lower() for part in text.split("\u0130"))


def code_points(text: str) -> np.ndarray:
    """A text's characters, lower-cased where that keeps the length, ASCII white space as blanks."""
    out = np.frombuffer(folded(text).encode("utf-32-le", "surrogatepass"), "<u4").copy()
    out[(out >= 9) & (out <= 13)] = 32
    return out


def gram_hashes(points: np.ndarray, q: int = Q) -> np.ndarray:
    """A 32-bit hash of each q-gram by doubling; q is a power of two."""
    h, step, base = points.astype("<u4"), 1, int(_BASE)
    while step < q:
        h = h[:-step] * np.uint32(base) + h[step:]
        base, step = (base * base) & 0xFFFFFFFF, 2 * step
    h ^= h >> np.uint32(15)
    h *= np.uint32(2246822519)
    h ^= h >> np.uint32(13)
    return h


def edit_budget(m: int) -> int:
    """Edits that a match of an item of m characters may have: such that the lemma still asks for enough q-grams."""
    return max(0, min(int(EDIT_RATE * m), int((m - Q + 1 - LEAST_SHARED * m) // Q)))


def shared_least(m: int) -> int:
    """Q-gram lemma: a region within e edits shares m + 1 - Q * (e + 1) q-grams at least."""
    return m + 1 - Q * (edit_budget(m) + 1)


def banded_alignment(item: np.ndarray, region: np.ndarray, low: int, high: int, edits: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the item's best match in the region that begins on diagonals low..high, within edits.

    Semi-global: the match may begin and end anywhere. Cells off the band low - edits .. high + edits are not computed.
    Of equal distances the leftmost end wins.
    """
    m, n, first = len(item), len(region), low - edits
    width = high + edits - first + 1
    offsets = np.arange(width)
    big = m + n + 1
    column = first + offsets
    cost = np.where((column >= 0) & (column <= n), 0, big)
    begin = column.copy()
    padded = np.concatenate([np.full(max(0, -first) + 1, _GAP + 1, "<u4"), region, np.full(max(0, first + width + m - n) + 1, _GAP + 1, "<u4")])
    shift = max(0, -first) + 1
    for i in range(1, m + 1):
        column = first + offsets + i
        here = padded[shift + first + i - 1 : shift + first + i - 1 + width]
        take = cost + (here != item[i - 1])
        drop = np.append(cost[1:], big) + 1
        from_drop = drop < take
        best = np.where(from_drop, drop, take)
        start = np.where(from_drop, np.append(begin[1:], 0), begin)
        best = np.where((column >= 0) & (column <= n), best, big)
        run = best - offsets
        least = np.minimum.accumulate(run)
        at = np.maximum.accumulate(np.where(run == least, offsets, 0))
        cost, begin = np.minimum(least + offsets, big), start[at]
        if cost.min() > edits:
            return None
    k = int(np.argmin(cost))
    return (int(cost[k]), int(begin[k]), int(first + k + m)) if cost[k] <= edits else None


class ClassIndex:
    """Postings of the q-grams of items of like length: sorted by gram, with the item and the place in it."""

    def __init__(self, items: list[np.ndarray], first: int):
        hashes = [gram_hashes(p) for p in items]
        every = np.concatenate(hashes)
        order = np.argsort(every, kind="stable")
        self.owner = np.repeat(np.arange(len(items), dtype="<i4"), [len(h) for h in hashes])[order]
        self.place = np.concatenate([np.arange(len(h), dtype="<i4") for h in hashes])[order]
        self.grams, self.first = np.unique(every[order], return_index=True)
        self.first = np.append(self.first, len(every))
        lengths = [len(p) for p in items]
        self.step = np.array([edit_budget(m) + 1 for m in lengths], "int64")
        self.least = np.array([shared_least(m) for m in lengths], "int64")
        self.start, self.window = first, max(lengths) + edit_budget(max(lengths))

    def bands(self, at: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, lowest and highest diagonal) of runs of overlapping bands with enough q-grams; at: places of a text's grams.

        A band holds two cells of as many diagonals as the item has edits and one; the next overlaps it by half. The
        pairs of equal grams are numbered, so that a slice of bounded size can be counted whatever the text repeats.
        """
        found = np.searchsorted(self.grams, hashes)
        low, n = self.first[found], self.first[found + 1] - self.first[found]
        ends = np.cumsum(n)
        keys, counts = np.empty(0, "int64"), np.empty(0, "int64")
        for begin in range(0, int(ends[-1]), PAIRS):
            pair = np.arange(begin, min(begin + PAIRS, int(ends[-1])))
            k = np.searchsorted(ends, pair, "right")
            posting = low[k] + pair - (ends[k] - n[k])
            owner = self.owner[posting].astype("int64")
            cell = (at[k] - self.place[posting]) // self.step[owner]
            own, count = np.unique((owner << 33) + cell + (1 << 32), return_counts=True)
            keys, which = np.unique(np.concatenate([keys, own]), return_inverse=True)
            counts = np.bincount(which, np.concatenate([counts, count])).astype("int64")
        both = counts + np.where(np.append(keys[1:] == keys[:-1] + 1, False), np.append(counts[1:], 0), 0)
        good = keys[both >= self.least[keys >> 33]]
        if not len(good):
            return
        cuts = np.flatnonzero(np.diff(good) > 1) + 1
        for run in np.split(good, cuts):
            item, cell = int(run[0] >> 33), int(run[0] & ((1 << 33) - 1)) - (1 << 32)
            step, end = int(self.step[item]), cell + len(run)
            width = max(1, DIAGONALS // step)
            for c in range(cell, end, width):
                yield item, c * step, (min(c + width, end) + 1) * step - 1


class BenchmarkIndex:
    """Q-grams of benchmark items by classes of like length; items under LEAST_CHARS characters apart, word for word."""

    def __init__(self, items: list[tuple[int, str]]):
        known = [(i, code_points(text)) for i, text in sorted(items) if text]
        short = [(i, p.tobytes().decode("utf-32-le", "surrogatepass").strip()) for i, p in known if len(p) < LEAST_CHARS]
        self.short = [x for x in short if x[1]]
        self.items = sorted((x for x in known if len(x[1]) >= LEAST_CHARS), key=lambda x: len(x[1]))
        lengths = [len(p) for _, p in self.items]
        edges = [0] if lengths else []
        for k, m in enumerate(lengths):
            if m > CLASS_RATIO * lengths[edges[-1]] and len(edges) < 64:
                edges.append(k)
        points = [p for _, p in self.items]
        self.classes = [ClassIndex(points[a:b], a) for a, b in zip(edges, [*edges[1:], len(lengths)], strict=False)]
        self.grams = np.unique(np.concatenate([c.grams for c in self.classes])) if self.classes else np.empty(0, "<u4")
        self.kinds = np.zeros(len(self.grams), "<u8")
        for k, c in enumerate(self.classes):
            self.kinds[np.searchsorted(self.grams, c.grams)] |= np.uint64(1 << k)
        low, high = TABLE_BITS
        self.mask = np.uint32((1 << min(max((TABLE_SLOTS * len(self.grams)).bit_length(), low), high)) - 1)
        self.table = np.zeros(int(self.mask) + 1, bool)
        self.table[self.grams & self.mask] = True
        self.words = None

    def candidates(self, flat: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, ClassIndex, np.ndarray, np.ndarray]]:
        """(text, class, places of its grams that the class has, their hashes) of texts with a window that holds enough.

        flat: texts one after the other, a gap behind each. A window has as many characters as the class's longest
        item with all its edits; enough is what the class's least demanding item asks for.
        """
        if len(flat) < Q or not self.classes:
            return
        h = gram_hashes(flat)
        at = np.flatnonzero(self.table[h & self.mask])
        found = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        real = self.grams[found] == h[at]
        at, kinds = at[real], self.kinds[found[real]]
        text = np.searchsorted(starts, at, "right") - 1
        for k, c in enumerate(self.classes):
            own = np.flatnonzero(kinds >> np.uint64(k) & np.uint64(1))
            reach = int(c.least.min()) - 1
            if len(own) <= reach:
                continue
            p, t = at[own], text[own]
            full = (p[reach:] - p[: len(p) - reach] <= c.window - Q) & (t[reach:] == t[: len(t) - reach])
            for which in np.unique(t[reach:][full]).tolist():
                a, b = np.searchsorted(t, [which, which + 1])
                yield which, c, p[a:b] - starts[which], h[p[a:b]]

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item id, distance, start, end): the best verified region of each item in each text."""
        points = code_points("\U0010ffff".join([*texts, ""]))
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        points[starts[1:] - 1] = _GAP
        for t, c, at, hashes in self.candidates(points, starts):
            own, best = points[starts[t] : starts[t + 1] - 1], {}
            for item, low, high in c.bands(at, hashes):
                if item not in best or best[item][0]:
                    found = self._verify(self.items[c.start + item][1], own, low, high, int(c.step[item]) - 1)
                    if found and (item not in best or found < best[item]):
                        best[item] = found
            for item, found in best.items():
                yield t, self.items[c.start + item][0], *found
        if self.short:
            yield from self._word_for_word(points, starts)

    def _word_for_word(self, points: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """The first place of each short item in each text, if no letter or digit adjoins."""
        if self.words is None:
            import ahocorasick

            self.words, ids = ahocorasick.Automaton(), {}
            for i, word in self.short:
                ids.setdefault(word, []).append(i)
            for word, own in ids.items():
                self.words.add_word(word, (word, own))
            self.words.make_automaton()
        for t in range(len(starts) - 1):
            said, met = points[starts[t] : starts[t + 1] - 1].tobytes().decode("utf-32-le", "surrogatepass"), set()
            for last, (word, own) in self.words.iter(said):
                start, end = last + 1 - len(word), last + 1
                if word not in met and not (start and said[start - 1].isalnum()) and not said[end : end + 1].isalnum():
                    met.add(word)
                    yield from ((t, i, 0, start, end) for i in own)

    @staticmethod
    def _verify(item: np.ndarray, points: np.ndarray, low: int, high: int, edits: int) -> tuple[int, int, int] | None:
        a, b = max(0, low - edits), min(len(points), high + len(item) + 2 * edits)
        region = points[a:b]
        exact = region.tobytes().find(item.tobytes())
        if exact >= 0 and exact % 4 == 0:
            return 0, a + exact // 4, a + exact // 4 + len(item)
        found = banded_alignment(item, region, low - a, high - a, edits)
        return found and (found[0], a + found[1], a + found[2])


def _search(batch_texts: list[str | None], index: BenchmarkIndex) -> Iterator[tuple[int, int, int, int, int]]:
    held, size = [], 0
    for k, text in enumerate([*batch_texts, None]):
        if text:
            held.append(k)
            size += len(text)
        if held and (size >= SCAN or k == len(batch_texts)):
            for t, *found in index.search([batch_texts[j] for j in held]):
                yield held[t], *found
            held, size = [], 0


def _shared_indexes(benchmark: DataFrame, item_col: str, item_text_col: str) -> Iterator[Broadcast[BenchmarkIndex]]:
    """The benchmark's indexes as broadcasts, each of about BLOCK_CHARS characters; none for no searchable item."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("t")).where("t is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-total // BLOCK_CHARS))
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == block)
        index = BenchmarkIndex([(r.id, r.t) for r in own.collect()])
        if index.items or index.short:
            yield spark.sparkContext.broadcast(index)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, distance, start, end of the best match.

    Matching ignores case and the kind of ASCII white space; places are code points of the whole text. A match has
    EDIT_RATE edits per item character at most; items under LEAST_CHARS characters must occur as they are, from word
    edge to word edge. Null and blank items and null texts match nothing; rows of a null doc_id report null; repeated documents report each, repeated items as one each id and
    text. An empty benchmark or table gives no rows. The benchmark is broadcast in blocks of BLOCK_CHARS characters.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), as_text(docs, text_col).alias("text"))
    schema, out = "doc_id long, item_id long, distance int, start int, end int", None
    kinds = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *((x, pa.int32()) for x in ("distance", "start", "end"))])
    for shared in _shared_indexes(benchmark, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found = [(ids[k], i, d, a, b) for k, i, d, a, b in _search(texts_of(batch), shared.value)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], schema=kinds)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark item, all columns as they are; each row goes by its own text, whatever its id.

    One block of items filters the rows where they are. Of several blocks each has a scan and tasks of its own, so that a
    task never holds more than one index; the SHA-256 of the texts found is then taken out of the rows.
    """
    indexes = list(_shared_indexes(benchmark, item_col, item_text_col))
    if not indexes:
        return docs

    def test(shared: Broadcast[BenchmarkIndex], wanted: bool) -> Callable[[], Callable[[list[str | None]], list[bool]]]:
        def marked(texts: list[str | None]) -> list[bool]:
            held = {found[0] for found in _search(texts, shared.value)}
            return [(k in held) == wanted for k in range(len(texts))]

        return lambda: marked

    if len(indexes) == 1:
        return filter_texts(docs, test(indexes[0], False), text_col)
    sha, found = F.sha2(as_text(docs, text_col), 256), None
    for shared in indexes:
        part = filter_texts(docs.select(text_col), test(shared, True), text_col).select(F.sha2(F.col(text_col).cast("string"), 256).alias("__found"))
        found = part if found is None else found.unionByName(part)
    found = found.distinct()
    return docs.join(found, sha == found["__found"], "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))
