"""Token counts by a map-side two-tier lookup: a broadcast table of frequent pre-tokens, then a worker's cache."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asterfold.llm.common import as_text, texts_of, tokenizer_path

#: Entries of the broadcast table: at most about 1 MB.
TABLE = 50_000
#: Texts, none longer than WARM_CHARS, from which the driver learns which pre-tokens are frequent: drawn by chance from
#: all files, so many expected, 40 MB at most. The bound decides only what is looked up fast, never a count.
WARM_TEXTS, WARM_CHARS = 2_000, 20_000
#: Entries of one generation of a worker's cache; the draw's seed.
MOST, SEED = 400_000, 7


class _Inside(LookupError):
    """A run of blanks: the text must go to the library as a whole."""


class PieceCounts(dict):
    """Maps a pre-token to its count of pieces.

    A piece has blanks at its start only and none holds a newline, so no merge crosses from a visible character to a
    blank or newline, and a text's count is the sum over its pre-tokens. The library puts a blank before each text; a
    pre-token behind a newline has none, and the lone blank piece that the library then makes is taken off.
    """

    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        from sentencepiece import SentencePieceProcessor

        super().__init__()
        self.library = SentencePieceProcessor(model_file=path)
        self.frequent, self.old = frequent or {}, {}
        inner = [p for p in map(self.library.id_to_piece, range(len(self.library))) if "▁" in p.lstrip("▁") or "\n" in p]
        blanks = self.library.encode("  a", out_type=str)
        self.separable = not inner and "".join(blanks) == "▁▁▁a" and self.library.encode("\n", out_type=str)[:1] == ["▁"]

    def __missing__(self, word: str) -> int:
        found = self.frequent.get(word)
        if found is not None:
            return found
        found = self.old.get(word)
        if found is None:
            if not word:
                raise _Inside
            found = len(self.library.encode(word)) - (word[0] == "\n")
        if len(self) >= MOST:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.separable and "▁" not in text and "\0" not in text:
            try:
                return sum(map(self.__getitem__, text.replace("\n", " \n").split(" ")))
            except _Inside:
                pass
        return len(self.library.encode(text))


_COUNTS: dict[str, PieceCounts] = {}


def frequent_pretokens(docs: DataFrame, text_col: str, path: str) -> tuple[str, bytes]:
    """The most frequent pre-tokens of a draw over the whole table in one string, and their counts as bytes.

    Each row is drawn by itself, whatever its id or text, so the draw is bounded where rows repeat, too.
    """
    counts, drawn = Counter(), F.rand(SEED) < WARM_TEXTS / max(docs.count(), 1)
    for row in docs.select(as_text(docs, text_col).alias("text")).where(drawn & (F.length("text") <= WARM_CHARS)).collect():
        counts.update(row.text.replace("\n", " \n").split(" "))
    pieces = PieceCounts(path)
    words = [w for w, _ in counts.most_common(TABLE) if w and "\0" not in w and len(w) <= 100] if pieces.separable else []
    return "\0".join(words), np.array([pieces[w] for w in words], "<u2").tobytes()


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every whole text; no shuffle.

    Null and empty texts have 0 tokens; null ids and repeated rows pass through, row for row.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent_pretokens(docs, text_col, model))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _COUNTS.get(model)
        if pieces is None:
            words, lengths = table.value
            pieces = _COUNTS[model] = PieceCounts(model, dict(zip(words.split("\0"), np.frombuffer(lengths, "<u2").tolist(), strict=False)))
        for batch in batches:
            texts = texts_of(batch)
            n = np.fromiter(map(pieces.count, texts), "int64", len(texts))
            size = np.fromiter((len(x.encode()) if x else 0 for x in texts), "int64", len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), as_text(docs, text_col).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("piece_bpe_32k.model"))
