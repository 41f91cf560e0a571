"""Substring dedup by sliding sentence spans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from asterfold.llm.common import as_text, bit_filter, staged, texts_of

#: A run of consecutive sentences counts if it has so many sentences and words; a single sentence counts if it has
#: LONG_WORDS words. A span is the shortest such run that begins, or that ends, at a given sentence. A text with fewer
#: words than WORDS in all is one span.
SENTENCES, WORDS, LONG_WORDS = 2, 20, 25
#: A span that more than one in HOT_SHARE of the remaining rows hold is joined by broadcast, so at most HOT_SHARE are.
HOT_SHARE, HOT_LEAST = 2_000, 1_000

_SENTENCE = re.compile(r"[^.!?\n]*[.!?]+|[^.!?\n]+")
_LAST = (1 << 63) - 1


def sentences(text: str | None) -> list[tuple[int, int, list[str]]]:
    """(start, end, lower-case words) of each sentence that has a word; ends at . ! ? or a newline."""
    out = []
    for m in _SENTENCE.finditer(text or ""):
        words = m[0].lower().split()
        if words:
            out.append((*m.span(), words))
    return out


def counts(n_sentences: int, words: int) -> bool:
    return words >= WORDS and (n_sentences >= SENTENCES or words >= LONG_WORDS)


def spans(found: list[tuple[int, int, list[str]]]) -> Iterator[tuple[int, int, bytes]]:
    """(first sentence, last, 128-bit hash) of the spans that begin, and that end, at each sentence.

    Each sentence of a run that counts lies in a span inside the run: in the one that begins at the run's first
    sentence, or beyond its end in the one that ends at the sentence. So the spans find what all runs would.
    """
    from xxhash import xxh3_128_digest

    sizes = [len(w) for *_, w in found]
    joined = [" ".join(w) for *_, w in found]
    places, last, words = {}, -1, 0
    if 0 < sum(sizes) < WORDS:
        places[0, len(found) - 1] = None
    for first in range(len(found)):
        while last + 1 < len(found) and not counts(last - first + 1, words):
            last += 1
            words += sizes[last]
        if counts(last - first + 1, words):
            places[first, last] = None
        words -= sizes[first]
    first, words = 0, 0
    for last in range(len(found)):
        words += sizes[last]
        while first < last and counts(last - first, words - sizes[first]):
            words -= sizes[first]
            first += 1
        if counts(last - first + 1, words):
            places[first, last] = None
    for first, last in places:
        yield first, last, xxh3_128_digest("\n".join(joined[first : last + 1]).encode("utf-8", "surrogatepass"))


def halves(digests: list[bytes]) -> np.ndarray:
    """Two signed longs a digest."""
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def repeated_bits(rows: DataFrame, within: bool) -> np.ndarray:
    """A bit set by the low bits of a span's first long, with the bits of all spans that occur again.

    Only that long of a span is shuffled, once a row that holds it (as often as it occurs, if repeats within a document
    count). The driver sees the set's 64-bit words: 4 million at most.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[bytes] = []
            for text in texts_of(batch):
                own = [h for *_, h in spans(sentences(text))]
                held += own if within else set(own)
            h, n = np.unique(halves(held)[:, 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h1", "n"])

    again = staged(rows.select("text").mapInArrow(hashed, "h1 long, n long").groupBy("h1").agg(F.sum("n").alias("n")).where("n > 1").select("h1"), "repeated")
    return bit_filter(again, "h1")


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", within: bool = True) -> DataFrame:
    """One row per range to remove: doc_id, start, end (code points, end exclusive), n_sentences, first_doc_id, text_key.

    Every span is hashed twice: the first time only to learn which hashes occur in several rows, the second time to
    join those over the whole corpus. The first holder is the smallest doc_id, then the smallest hash of the text,
    and in a document the first place. All other occurrences are repeated: their sentences, joined to ranges, are
    listed with the smallest of the first holders. Without `within`, a span that one document alone holds stays. Null and empty texts have no span. Texts that share an id are documents of their own; rows alike in id
    and text are one document, listed once. Rows of a null id come last, are told apart and report null. text_key is
    xxhash64 of the text.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), as_text(docs, text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    shared = docs.sparkSession.sparkContext.broadcast(repeated_bits(rows, within))
    ints, longs = ("first", "last", "start", "end"), ("doc_id", "text_key", "copy", "h1", "h2")
    kinds = pa.schema([*((x, pa.int64()) for x in longs), *((x, pa.int32()) for x in ints), ("local", pa.bool_())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, copy = shared.value, TaskContext.get().partitionId() << 33
        mask = len(bits) * 8 - 1
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for doc, text, key in zip(batch.column(0).to_pylist(), texts_of(batch), batch.column(2).to_pylist(), strict=True):
                found = sentences(text)
                every = list(spans(found))
                copy += 1
                if not every:
                    continue
                h = halves([x for *_, x in every])
                low = h[:, 0] & mask
                seen = set()
                for k in np.flatnonzero(bits[low >> 3] >> (low & 7).astype("u1") & 1).tolist():
                    first, last, digest = every[k]
                    for column, x in zip(out, (doc, key, copy if doc is None else 0, *h[k].tolist(), first, last, found[first][0], found[last][1], digest in seen), strict=True):
                        column.append(x)
                    seen.add(digest)
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(out, kinds, strict=True)], schema=kinds)

    schema = ", ".join([*(f"{x} long" for x in longs), *(f"{x} int" for x in ints), "local boolean"])
    every = staged(rows.mapInArrow(hashed, schema), "spans")
    own = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), "text_key", "copy")
    counted = every.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(own).alias("holder"), F.max(own).alias("other"))
    again = staged(counted.where("n > 1" if within else "holder != other").drop("other"), "holders")
    hot = again.where(F.col("n") > max(HOT_LEAST, every.count() // HOT_SHARE))
    rest = every.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti")
    met = every.join(F.broadcast(hot), ["h1", "h2"]).unionByName(rest.join(again.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti"), ["h1", "h2"]))
    hit = met.where(F.col("local") | (own > F.col("holder"))).select("doc_id", "text_key", "copy", *ints, F.col("holder.doc").alias("holder"))
    by = Window.partitionBy("doc_id", "text_key", "copy").orderBy("first", "last")
    before = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    apart = hit.withColumn("new", (F.col("first") > F.coalesce(before, F.lit(-2)) + 1).cast("int")).withColumn("range", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = apart.groupBy("doc_id", "text_key", "copy", "range").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("last") - F.min("first") + 1).alias("n_sentences"), F.nullif(F.min("holder"), F.lit(_LAST)).alias("first_doc_id"))
    return ranges.select("doc_id", "start", "end", "n_sentences", "first_doc_id", "text_key")


def remove_ranges(docs: DataFrame, ranges: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the ranges cut out of the texts that they were found in; other columns stay.

    A range belongs to a row by its id and text_key. Rows of a null id stay as they are, as nothing tells them apart.
    """
    cut = ranges.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__cut"))
    joined = docs.join(cut, (docs[id_col] == F.col("__id")) & (F.xxhash64(as_text(docs, text_col)) == F.col("__key")), "left")
    edges = F.concat(F.array(F.lit(0)), F.flatten(F.transform("__cut", lambda c: F.array(c["start"], c["end"]))), F.array(F.length(text_col)))
    pieces = F.transform(F.sequence(F.lit(0), F.size("__cut")), lambda k: F.substring(F.col(text_col), F.get(edges, 2 * k) + 1, F.get(edges, 2 * k + 1) - F.get(edges, 2 * k)))
    return joined.withColumn(text_col, F.when(F.col("__cut").isNull(), F.col(text_col)).otherwise(F.array_join(pieces, ""))).drop("__cut", "__id", "__key")


def op6_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-first repeat, within a document as across documents."""
    return repeated_ranges(spark.read.parquet(f"{sf_dir}/documents.parquet"))
