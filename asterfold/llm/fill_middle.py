"""Fill-in-the-middle: texts cut at two hashed places, put together in another order by pyarrow.compute."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from asterfold.llm.common import as_text

#: What stands before prefix, suffix and middle. A text that holds one of them stays plain, so an output can be undone.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of text whose units are alive at once; a longer text is cut into segments of so many.
SLICE_BYTES = 1 << 20


def segments(texts: pa.StringArray, most: int = SLICE_BYTES) -> tuple[pa.StringArray, np.ndarray]:
    """The texts in segments of at most `most` bytes, cut between code points, and where each text's segments begin and end.

    The segments share the texts' bytes. An empty text is one empty segment.
    """
    edges = np.frombuffer(texts.buffers()[1], "<i4")[texts.offset : texts.offset + len(texts) + 1]
    long = np.flatnonzero(np.diff(edges) > most)
    if not len(long):
        return texts, np.arange(len(texts) + 1)
    raw = np.frombuffer(texts.buffers()[2], "u1")
    cuts: list[int] = []
    extra = np.zeros(len(texts), "int64")
    for k in long.tolist():
        at, end, before = int(edges[k]) + most, int(edges[k + 1]), len(cuts)
        while at < end:
            while raw[at] & 0xC0 == 0x80:
                at -= 1
            cuts.append(at)
            at += most
        extra[k] = len(cuts) - before
    offsets = np.sort(np.append(edges, cuts)).astype("<i4")  # a cut lies inside a text, so order is all that counts
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), texts.buffers()[2]), np.append(0, np.cumsum(extra + 1))


def units(texts: pa.StringArray) -> pa.ListArray:
    """Each text as the list of its code points, which share the texts' bytes."""
    edges = np.frombuffer(texts.buffers()[1], "<i4")[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", "u1")[edges[0] : edges[-1]]
    begins = np.flatnonzero((raw & 0xC0) != 0x80)
    offsets = (np.append(begins, len(raw)) + edges[0]).astype("<i4")
    flat = pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), texts.buffers()[2] or pa.py_buffer(b""))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(begins, edges - edges[0]), pa.int32()), flat)


def pieces(texts: pa.StringArray, low: np.ndarray, high: np.ndarray, most: int = SLICE_BYTES) -> list[pa.Array]:
    """[prefix, middle, suffix] of each text: its units before `low`, from there to before `high`, and from `high` on."""
    parts, of_text = segments(texts, most)
    text_of = np.repeat(np.arange(len(texts)), np.diff(of_text))
    reach = np.cumsum(pc.binary_length(parts).to_numpy(zero_copy_only=False), dtype="int64")
    found: list[list[pa.Array]] = [[], [], []]
    a, read, text = 0, 0, -1  # `read` units of `text` lie before segment a
    while a < len(parts):
        b = max(a + 1, int(np.searchsorted(reach, most + (reach[a - 1] if a else 0), "right")))
        lists, of = units(parts[a:b]), text_of[a:b]
        flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
        begins, sizes = lists.offsets.to_numpy()[:-1].astype("int64"), pc.list_value_length(lists).to_numpy().astype("int64")
        base = np.zeros(b - a, "int64")
        if of[0] == text:
            base[0] = read  # only the first segment can go on with a text: all others of a slice begin one
        ordinal = pc.add(pc.subtract(pa.array(np.arange(len(flat))), pc.take(pa.array(begins), parent)), pc.take(pa.array(base), parent))
        in_front = pc.less(ordinal, pc.take(pa.array(low[of]), parent))
        behind = pc.greater_equal(ordinal, pc.take(pa.array(high[of]), parent))
        for role, chosen in enumerate((in_front, pc.invert(pc.or_(in_front, behind)), behind)):
            kept = pc.filter(parent, chosen).to_numpy()
            rebuilt = pa.ListArray.from_arrays(pa.array(np.searchsorted(kept, np.arange(b - a + 1)), pa.int32()), pc.filter(flat, chosen))
            found[role].append(pc.binary_join(rebuilt, ""))
        read, text, a = int(base[-1] + sizes[-1]), int(of[-1]), b
    whole = [pa.concat_arrays(x) if x else pa.array([], pa.string()) for x in found]
    return [pc.binary_join(pa.ListArray.from_arrays(pa.array(of_text, pa.int32()), x), "") for x in whole]


def rearranged(texts: pa.StringArray, form: pa.Array, low: np.ndarray, high: np.ndarray) -> pa.Array:
    """The texts in their form: plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle)."""
    plain = pc.equal(form, "plain")
    prefix, middle, suffix = pieces(pc.if_else(plain, "", texts), low, high)
    psm = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
    spm = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
    return pc.if_else(plain, texts, pc.if_else(pc.equal(form, "spm"), spm, psm))


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (code points), form, prefix_chars, middle_chars (null if plain) and output of every whole text; no shuffle.

    Cuts and form come from the SHA-256 of "seed:id", so repeated rows come out alike, and all rows without an id are
    cut by the hash of "seed:". Null texts count as empty; empty texts and those with a mark are plain. Columns of docs
    other than id and text are not read.
    """
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit(""))), 256)
    h1, h2, h3, h4 = (F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4))
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(as_text(docs, text_col), F.lit("")).alias("text"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    text, n = F.col("text"), F.length("text").cast("long")
    plain = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (F.col("h3") % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    a, b = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    rows = rows.withColumns({"n": n, "form": form}).select("id", "text", "n", "form", F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, n, form, low, high = batch.columns
            cut = [x.to_numpy(zero_copy_only=False) for x in (low, high)]
            output = rearranged(texts.cast(pa.string()), form, *cut)
            none = pc.equal(form, "plain")
            before, between = pc.if_else(none, None, low), pc.if_else(none, None, pc.subtract(high, low))
            yield pa.RecordBatch.from_arrays([ids, n, form, before, between, output], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the form was made from: no mark can begin inside another or inside a piece."""
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sha = lambda text: F.sha2(text, 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = """
with hashed as (
  select doc_id, coalesce(text, '') as t, cast(length(coalesce(text, '')) as bigint) as n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
cut as (
  select doc_id, t, n, cast('0x' || h[1:8] as bigint) % (n + 1) as a, cast('0x' || h[9:16] as bigint) % (n + 1) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or cast('0x' || h[17:24] as bigint) % 100 >= 90 then 'plain'
      when cast('0x' || h[25:32] as bigint) % 100 < 20 then 'spm' else 'psm' end as form
  from hashed),
parts as (select *, least(a, b) as lo, greatest(a, b) as hi from cut),
made as (
  select *, substr(t, 1, lo) as p, substr(t, lo + 1, hi - lo) as m, substr(t, hi + 1) as s from parts),
output as (
  select *, case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end as o from made)
select doc_id, n, form, case when form <> 'plain' then lo end as prefix_chars, case when form <> 'plain' then hi - lo end as middle_chars,
  sha256(o) as output_sha256, sha256(case when form = 'plain' then o when form = 'psm' then string_split(string_split(o, '<S>')[1], '<P>')[2] || string_split(o, '<M>')[2] || string_split(string_split(o, '<S>')[2], '<M>')[1]
    else string_split(string_split(o, '<P>')[2], '<M>')[1] || string_split(o, '<M>')[2] || string_split(string_split(o, '<S>')[2], '<P>')[1] end) as restored_sha256
from output
"""
