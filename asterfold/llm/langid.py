"""Language identification by compression with per-language zstandard raw-content dictionaries."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from asterfold.llm.common import as_text, filter_texts, texts_of

#: Bytes of a language's dictionary, and how many of its documents (lowest hashes of id) are drawn to fill it.
DICTIONARY, DRAWN = 112_640, 160
LEVEL = 6
#: A text is rejected if the second-best language's size exceeds the best one's by less than so many bytes and this
#: share of it. Chosen on held-out labelled rows together with random texts (README).
MARGIN_BYTES, MARGIN = 3, 0.01
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_COMPRESSORS: dict[int, tuple[list[str], list]] = {}


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the folds; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def learn_dictionaries(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Raw dictionary content by language from a bounded sample of the labelled rows that have a text.

    A language's distinct ids set its share: about 3 * DRAWN of them are drawn by their hash (all, if they are fewer),
    the DRAWN lowest are kept, and their texts, cut at a character after DICTIONARY bytes, fill the dictionary as far as
    they fit whole. An id counts once, with the least of its texts, null like any other, so however often rows repeat
    no language with a text is lost and the driver gets DRAWN texts a language at most, and of these no more than fill
    two dictionaries. A labelled language without any text has no dictionary: it is never predicted, and a warning names it.
    """
    text = F.substring(as_text(docs, text_col), 1, DICTIONARY)
    labelled = docs.where(train & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), text.alias("text"))
    with_text = F.octet_length("text") > 0
    distinct = F.approx_count_distinct(F.when(with_text, F.xxhash64("id")))
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(distinct.alias("n")).collect()}
    bare, sizes = sorted(k for k, n in sizes.items() if not n), {k: n for k, n in sizes.items() if n}
    if bare:
        warnings.warn(f"languages without a text are never predicted: {', '.join(bare)}", stacklevel=2)
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 3 * DRAWN / n))])
    drawn = labelled.where(with_text & (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)))
    once = drawn.groupBy("lang", "id").agg(F.min("text").alias("text"))
    ranked = once.selectExpr("*", "row_number() over (partition by lang order by xxhash64(id), id) as k").where(F.col("k") <= DRAWN)
    room = ranked.selectExpr("*", f"sum(least(octet_length(text), {DICTIONARY})) over (partition by lang order by k rows between unbounded preceding and 1 preceding) as before")
    texts: dict[str, list[tuple]] = {lang: [] for lang in sizes}
    for row in room.where(F.coalesce("before", F.lit(0)) < 2 * DICTIONARY).collect():
        texts[row.lang].append((row.id is None, row.id, row.text))
    out = {}
    for lang, rows in sorted(texts.items()):
        whole, free = [], DICTIONARY
        for *_, text in sorted(rows):
            data = text.lower().encode()[: DICTIONARY - 1].decode("utf-8", "ignore").encode()
            if len(data) + 1 <= free:
                whole.append(data)
                free -= len(data) + 1
        out[lang] = b"\n".join(whole)
    return out


def _compressors(key: int, dictionaries: dict[str, bytes]) -> tuple[list[str], list]:
    import zstandard

    if key not in _COMPRESSORS:
        made = []
        for data in dictionaries.values():
            content = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        _COMPRESSORS.clear()
        _COMPRESSORS[key] = list(dictionaries), made
    return _COMPRESSORS[key]


def classify(text: str | None, langs: list[str], compress: list) -> tuple[str, float, bool]:
    """(language, score, accepted): the smallest of the compressed sizes, ties by language name."""
    if not text or not langs or not _LETTER.search(text):
        return UNKNOWN, 0.0, False
    data = text.lower().encode()
    sizes = [len(c(data)) for c in compress]
    best = min(range(len(sizes)), key=lambda k: (sizes[k], k))
    if len(sizes) == 1:
        return langs[best], 1.0, True
    second = min(s for k, s in enumerate(sizes) if k != best)
    more = second - sizes[best]
    return langs[best], 0.5 + 0.5 * min(1.0, more / max(sizes[best], 1)), more >= MARGIN_BYTES + MARGIN * sizes[best]


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, lang_pred, score (0 to 1) and accepted of every whole text.

    `und`, 0.0 and not accepted: null text, no letter, or no dictionary. A narrow margin is not accepted either, but
    keeps its nearest language. Null ids and repeated rows pass through.
    """
    spark = docs.sparkSession
    shared, key = spark.sparkContext.broadcast(dictionaries), hash(tuple(dictionaries.items()))
    rows = docs.select(docs[id_col], as_text(docs, text_col).alias("__text"))
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, accepted boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, compress = _compressors(key, shared.value)
        for batch in batches:
            found = [classify(x, langs, compress) for x in texts_of(batch, "__text")]
            new = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *new], [id_col, "lang_pred", "score", "accepted"])

    return rows.mapInArrow(run, schema)


def keep_accepted(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """The rows whose language is accepted, all columns as they are; null ids and repeated rows are judged like any other."""
    shared, key = docs.sparkSession.sparkContext.broadcast(dictionaries), hash(tuple(dictionaries.items()))

    def test():
        langs, compress = _compressors(key, shared.value)
        return lambda texts: [classify(x, langs, compress)[2] for x in texts]

    return filter_texts(docs, test, text_col)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    dictionaries = learn_dictionaries(docs, ~held_out)
    return identify(docs, dictionaries).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")
