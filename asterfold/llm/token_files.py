"""Token-id output: flat unsigned integer files plus 64-bit document offsets, read back through memory maps."""

from __future__ import annotations

import itertools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asterfold.llm.common import as_text, byte_bpe, scratch_path, tokenizer_path


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in folder and folder.startswith("file:"):
        folder = "file://" + folder[5:]
    return pafs.FileSystem.from_uri(folder)


def _mapped(fs: pafs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A file's values: a memory map on a local or mounted file system, else one read."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, kind, "r") if fs.get_file_info(path).size else np.empty(0, kind)
    with fs.open_input_file(path) as file:
        return np.frombuffer(file.read(), kind)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None
) -> dict:
    """Encodes every whole text, appends end_id, writes ids in ascending id order, returns the manifest.

    Each range partition writes three flat files: <part>.ids (uint16 if the vocabulary fits, else uint32),
    <part>.offsets (uint64, one more than documents, from 0 within the part) and <part>.docs (int64 ids). They are
    written under a name of the attempt and renamed, so a repeated task replaces equal content. Partition bases are
    prefix sums of the parts' token counts; the driver sees one row a part. Null texts count as empty; null ids come
    first, as 0 in the id file, and the manifest tells how many. Rows that share an id, null too, are dealt by the hash
    of their text and their place in the input, so no id's rows need one task. An empty table gives no parts.
    """
    width = 2 if byte_bpe(tokenizer).size <= 1 << 16 else 4

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = _open(folder)
        bpe, part, n_docs, nulls, n_ids = byte_bpe(tokenizer, width), f"part-{task.partitionId():06d}", 0, 0, 0
        names = [(f"{root}/.{part}.{task.taskAttemptId()}.{x}", f"{root}/{part}.{x}") for x in ("ids", "offsets", "docs")]
        files = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if files is None:
                files = [fs.open_output_stream(x) for x, _ in names]
                files[1].write(bytes(8))
            for found, ends in bpe.slices(batch.column(1)):
                n = len(ends)
                files[0].write(np.insert(found, ends, end_id).tobytes())
                files[1].write((n_ids + ends + np.arange(1, n + 1)).astype("<u8").tobytes())
                n_ids += len(found) + n
            files[2].write(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            n_docs += batch.num_rows
            nulls += batch.column(0).null_count
        if files is not None:
            for file, (written, final) in zip(files, names, strict=True):
                file.close()
                fs.move(written, final)
            yield pa.RecordBatch.from_pydict({"part": [part], "docs": [n_docs], "nulls": [nulls], "tokens": [n_ids]})

    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), as_text(docs, text_col).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("key"), F.monotonically_increasing_id().alias("place"))
    by = ("doc_id", "key", "place")
    dealt = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    parts = sorted(dealt.sortWithinPartitions(*by).select("doc_id", "text").mapInArrow(write, "part string, docs long, nulls long, tokens long").collect())
    bases = itertools.accumulate((x.tokens for x in parts), initial=0)
    manifest = {"width": width, "end_id": end_id, "parts": [x.asDict() | {"base": b} for x, b in zip(parts, bases, strict=False)]}
    with fs.open_output_stream(f"{root}/manifest.json") as file:
        file.write(json.dumps(manifest).encode())
    return manifest


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32, part.

    with_ids adds the ids themselves. A task maps one part; the count of parts sets the tasks.
    """

    def manifest() -> tuple[pafs.FileSystem, str, dict]:
        fs, root = _open(folder)
        with fs.open_input_stream(f"{root}/manifest.json") as file:
            return fs, root, json.loads(file.read())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root, all_parts = manifest()
        for part in (all_parts["parts"][int(k)] for batch in batches for k in batch.column(0).to_pylist()):
            at = f"{root}/{part['part']}"
            ids, offsets, owners = (_mapped(fs, f"{at}.{x}", kind) for x, kind in (("ids", f"<u{all_parts['width']}"), ("offsets", "<u8"), ("docs", "<i8")))
            for low in range(0, part["docs"], 2048):
                high = min(low + 2048, part["docs"])
                edges, own = offsets[low : high + 1].astype("int64"), np.asarray(owners[low:high])
                each = [np.asarray(ids[a:b]).astype("<u4") for a, b in itertools.pairwise(edges.tolist())]
                columns = {
                    "doc_id": pa.array(own, pa.int64(), mask=np.arange(low, high) < part["nulls"]),
                    "start": pa.array(edges[:-1] + part["base"]),
                    "n_tokens": pa.array(np.diff(edges)),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in each], pa.int64()),
                    "part": pa.array([part["part"]] * (high - low)),
                }
                yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array([x.astype("int64") for x in each], pa.list_(pa.int64()))} if with_ids else {}))

    n = len(manifest()[2]["parts"])
    return spark.range(0, n, 1, max(n, 1)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, part string" + ", ids array<long>" * with_ids)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, tokenizer_path("byte_bpe_50k.json"))
    return read_token_files(spark, folder)
