"""Best-fit packing of token pieces into sequences by hierarchical residual packing."""

from __future__ import annotations

import itertools
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asterfold.llm.common import as_text, byte_bpe, staged, tokenizer_path

#: A bin whose free room is at most this share of the capacity leaves the tree.
SLACK = 1 / 128
#: Underfull bins that one task of a merge round takes at most, and rounds that must each win something.
FAN_IN, ROUNDS = 100_000, 12

PIECES = "array<struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long, offset: long>>"
BINS = f"sequence_id long, fill long, open boolean, pieces {PIECES}"


def best_fit(sizes: Iterable[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the bins as lists of positions in `sizes`. Ties go by position."""
    sizes = list(sizes)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, []  # bit r of rooms: some bin has room r
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        need = sizes[k]
        fits = rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[at].append(k)
        else:
            room, at = capacity, len(bins)
            bins.append([k])
        by_room[room - need].append(at)
        rooms |= 1 << (room - need)
    return bins


_PIECE = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())]


def _bins(sizes: np.ndarray, edges: np.ndarray, pieces: pa.StructArray, capacity: int, level: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Item k has sizes[k] tokens in pieces[edges[k]:edges[k + 1]], with offsets inside. Bins with ids that hold the level, the partition and a count."""
    if not len(sizes):
        return
    members = best_fit(sizes.tolist(), capacity)
    order, n = np.fromiter(itertools.chain.from_iterable(members), "int64", len(sizes)), np.fromiter(map(len, members), "int64", len(members))
    first = np.append(0, np.cumsum(n))
    reach = np.append(0, np.cumsum(sizes[order]))
    fill = np.diff(reach[first])
    count = np.diff(edges)[order]
    upto = np.append(0, np.cumsum(count))
    which = np.repeat(edges[:-1][order] - upto[:-1], count) + np.arange(upto[-1])
    inside = reach[:-1] - np.repeat(reach[first[:-1]], n)
    old = pieces.take(pa.array(which))
    offset = old.field("offset").to_numpy() + np.repeat(inside, count)
    placed = pa.StructArray.from_arrays([*(old.field(x) for x, _ in _PIECE[:-1]), pa.array(offset)], [x for x, _ in _PIECE])
    held = pa.ListArray.from_arrays(pa.array(upto[first].astype("int32")), placed)
    names = (level << 58) + (TaskContext.get().partitionId() << 32) + np.arange(len(members))
    batch = pa.RecordBatch.from_arrays([pa.array(names), pa.array(fill), pa.array((capacity - fill > SLACK * capacity) & (not last)), held], ["sequence_id", "fill", "open", "pieces"])
    yield from (batch.slice(k, 4096) for k in range(0, len(members), 4096))


def local_bins(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Level 0: each input partition encodes its documents, cuts long ones and packs by best fit."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = byte_bpe(tokenizer), end_id.to_bytes(4, "little")
        doc, null, piece, start, length, crc = (array("q") for _ in range(6))
        for batch in batches:
            owners = batch.column(0)
            for own, missing, found in zip(owners.fill_null(0).to_pylist(), owners.is_null().to_pylist(), bpe.all_ids(batch.column(1)), strict=True):
                ids = found + end
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(itertools.pairwise(edges)):
                    doc.append(own), null.append(missing), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(memoryview(ids)[4 * a : 4 * b]))
        numbers = [np.frombuffer(x, "int64") if len(x) else np.empty(0, "int64") for x in (doc, null, piece, start, length, crc)]
        sizes, columns = numbers[4], [pa.array(numbers[0], pa.int64(), mask=numbers[1] > 0), *(pa.array(x, kind) for x, (_, kind) in zip([*numbers[2:], np.zeros_like(numbers[0])], _PIECE[1:], strict=True))]
        yield from _bins(sizes, np.arange(len(sizes) + 1), pa.StructArray.from_arrays(columns, [x for x, _ in _PIECE]), capacity, 0, False)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), as_text(docs, text_col).alias("text"))
    return rows.mapInArrow(pack, BINS)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and end_id; only those longer than the capacity are cut, into pieces of the capacity of
    which the first may be shorter. Partitions pack by best fit; nearly full bins are done; the others go as items
    into further best-fit rounds of ever fewer tasks, none with more than FAN_IN bins, until one task has seen all
    that are left or a round wins nothing. Null texts count as empty (one piece of the end id alone); null ids and
    repeated rows are packed like any other row; an empty table gives no rows.
    """

    def merge(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met = pa.Table.from_batches(batches, pa.schema([("fill", pa.int64()), ("pieces", pa.list_(pa.struct(_PIECE)))])).combine_chunks()
            if met.num_rows:
                held = met.column("pieces").chunk(0)
                yield from _bins(met.column("fill").to_numpy(), held.offsets.to_numpy().astype("int64") - held.offsets[0].as_py(), held.flatten(), capacity, level, last)

        return run

    level = staged(local_bins(docs, tokenizer, capacity, end_id, id_col, text_col), "bins-0")
    done, left = [level.where("not open")], level.where("open")
    n, won = left.count(), True
    for k in range(1, ROUNDS + 1):
        if not n:
            break
        tasks = -(-n // FAN_IN)
        last = tasks == 1 or not won or k == ROUNDS
        dealt = left.repartition(tasks, F.xxhash64("sequence_id")) if tasks > 1 else left.coalesce(1)  # bins have ids of their own, however alike
        level = staged(dealt.select("fill", "pieces").mapInArrow(merge(k, last), BINS), f"bins-{k}")
        done.append(level.where("not open"))
        if last:
            break
        left = level.where("open")
        now = left.count()
        n, won = now, now < 0.98 * n
    bins = done[0]
    for other in done[1:]:
        bins = bins.unionByName(other)
    return bins.select("sequence_id", F.explode("pieces").alias("p")).select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", "p.offset")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("byte_bpe_50k.json"))
