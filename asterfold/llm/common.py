"""What the operators share: scratch tables in the cluster's shared folder, salted joins, cached tokenizers."""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asterfold.sources.scratch import release, scratch_path, shared_dir, staged  # noqa: F401  one place for scratch tables

#: Where the named public tokenizers lie unless a caller gives a path.
TOKENIZER_DIR = "/opt/tokenizers"


def tokenizer_path(name: str) -> str:
    """A vocabulary file's place: the installed package if there is one, else TOKENIZER_DIR."""
    try:
        import public_tokenizers
    except ImportError:
        return f"{TOKENIZER_DIR}/{name}"
    return str(public_tokenizers.path(name))


def salted_join(rows: DataFrame, small: DataFrame, keys: Sequence[str], how: str, salt_by: Column, salts: int = 16) -> DataFrame:
    """Equi-join that deals a hot key's rows to `salts` tasks; `small` has one row a key and is repeated per salt."""
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


#: Bits of a filter of keys: FILTER_BITS a key, a power of two between these (32 MB at most). It loses no key; beyond
#: MOST_BITS it lets more through that aren't there.
FILTER_BITS, LEAST_BITS, MOST_BITS = 8, 1 << 16, 1 << 28


def bit_filter(keys: DataFrame, name: str) -> np.ndarray:
    """Bytes in which the bit at a key's low bits is set for each of the long keys, hashes of something.

    The driver sees the set's 64-bit words: 4 million at most.
    """
    bits = min(max(1 << (FILTER_BITS * keys.count()).bit_length(), LEAST_BITS), MOST_BITS)
    at = F.col(name).bitwiseAND(F.lit(bits - 1))
    words = keys.groupBy(F.shiftright(at, 6).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast({name} & 63L as int)))").alias("set")).toArrow()
    filled = np.zeros(bits // 64, "<i8")
    filled[words.column("word").to_numpy()] = words.column("set").to_numpy()
    return filled.view("u1")


#: Characters that the byte-level tokenizer's \s matches (Unicode White_Space). Fixed values.
WHITE = "\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, 0x2000, 0x2D, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


#: A mark behind a letter is a pre-token of its own.
MARKS = ",.;:!?"
#: Bytes of text whose chunks are looked up together, and new chunks that the library encodes in one string.
SLICE_BYTES, JOINED = 1 << 23, 250


class _Inside(LookupError):
    """A chunk ends in white space, so the text must be cut by pattern."""


class ByteBpe(dict):
    """Token ids of whole texts through a worker's cache of chunks.

    The byte-level pre-tokenizer never joins a visible character with white space that follows it, so a text's ids
    are those of its chunks (white space, then visible characters) in a row. Chunks repeat: Arrow numbers the distinct
    ones of a slice of texts, each is looked up once, and the library encodes only those that the cache lacks, many in
    one string. The dictionary maps a chunk to its ids as little-endian bytes. Two generations of at most `most` chunks
    each bound the memory.
    """

    def __init__(self, path: str, width: int = 4, most: int = 350_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        super().__init__()
        self.library, self.kind, self.most, self.old = Tokenizer.from_file(path), f"<u{width}", most, {}
        self.size = self.library.get_vocab_size()
        if width == 2 and self.size > 1 << 16:
            raise ValueError("the vocabulary doesn't fit 16 bits")
        self.lengths = None
        self.by_pattern = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall

    def encoded(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            last = chunk[-1:]
            if last.isspace():
                raise _Inside
            if len(chunk) > 2 and last in MARKS and chunk[-2].isalpha():
                return self[chunk[:-1]] + self[last]  # put together each time, which leaves room for others
            found = self.encoded(chunk) if chunk else b""
        return self._keep(chunk, found)

    def _keep(self, chunk: str, found: bytes) -> bytes:
        self._room()
        self[chunk] = found
        return found

    def _white(self, run: str) -> bytes:
        key = f"\0{run}"
        return self[key] if key in self else self._keep(key, self.encoded(run))

    def ids(self, text: str | None) -> bytes:
        """The ids as little-endian bytes; null counts as empty."""
        if not text:
            return b""
        if "\0" not in text:
            try:
                return b"".join(map(self.__getitem__, text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")))
            except _Inside:
                pass
        return b"".join(self._white(x) if x[-1].isspace() or "\0" in x else self[x] for x in self.by_pattern(text))

    def all_ids(self, texts: pa.Array | list[str | None]) -> Iterator[bytes]:
        """ids() of each text."""
        for ids, ends in self.slices(texts):
            data, width, a = ids.tobytes(), ids.itemsize, 0
            for b in ends.tolist():
                yield data[a * width : b * width]
                a = b

    def slices(self, texts: pa.Array | list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, the end of each text's ids) of one slice of about SLICE_BYTES of texts after the other."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        reach = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype="int64")
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(reach, SLICE_BYTES + (reach[low - 1] if low else 0), "right")))
            yield self._slice(texts[low:high])
            low = high
        pa.default_memory_pool().release_unused()

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n"), "\0")
        numbered = pc.dictionary_encode(cut.flatten())
        code, chunks = numbered.indices.to_numpy(), numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.get, chunks))
        odd = self._fill(chunks, found)
        table, size = np.frombuffer(b"".join(found), self.kind), np.fromiter(map(len, found), "int64", len(found)) // np.dtype(self.kind).itemsize
        n, first = size[code], np.cumsum(size) - size
        reach = np.append(0, np.cumsum(n))
        small = "int32" if reach[-1] < 1 << 31 else "int64"
        place = np.repeat((first[code] - reach[:-1]).astype(small), n)
        place += np.arange(reach[-1], dtype=small)
        ids = table[place]
        edges = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        ends = reach[edges]
        whole = pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False)
        if odd:
            bad = np.zeros(len(chunks), bool)
            bad[odd] = True
            whole |= np.diff(np.append(0, np.cumsum(bad[code]))[edges]) > 0
        if whole.any():  # white space at an end or in a run, or a zero character: cut by pattern
            parts = [np.frombuffer(self.ids(texts[k].as_py()), self.kind) if own else ids[ends[k] : ends[k + 1]] for k, own in enumerate(whole.tolist())]
            return np.concatenate(parts), np.cumsum([len(x) for x in parts])
        return ids, ends[1:]

    def _fill(self, chunks: list[str], found: list[bytes | None]) -> list[int]:
        """Looks up, learns and puts together what is not found yet; returns where a chunk ends in white space."""
        empty, odd = [k for k, v in enumerate(found) if v is None], []
        bases = [c[:-1] if c[-1:] in MARKS and c[-2:-1].isalpha() and len(c) > 2 else c for c in map(chunks.__getitem__, empty)]
        new = [c for c in dict.fromkeys(bases) if c not in self]
        known = [(c, v) for c, v in zip(new, map(self.old.get, new), strict=True) if v is not None]
        self._room()
        self.update(known)
        self._learn([c for c in new if c not in self and len(c) > 1 and c[0] in " \n" and not c[1].isspace() and not c[-1].isspace()])
        marks = {x: self[x] for x in MARKS}
        for k, base in zip(empty, bases, strict=True):
            try:
                value = self[base]
                found[k] = value if base is chunks[k] else value + marks[chunks[k][-1]]
            except _Inside:
                found[k] = b""
                odd.append(k)
        return odd

    def _room(self) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()

    def _learn(self, chunks: list[str]) -> None:
        """Encodes chunks that begin with white space in one string; cuts its ids where the chunks' bytes end."""
        import numpy as np

        if self.lengths is None:
            self.lengths = np.zeros(self.size, "int64")
            for token, k in self.library.get_vocab().items():
                self.lengths[k] = len(token)  # a byte is one character in the vocabulary
        for low in range(0, len(chunks), JOINED):
            some = chunks[low : low + JOINED]
            ids = np.array(self.library.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, self.kind)
            ends, own = np.cumsum(self.lengths[ids]), np.cumsum(np.fromiter(map(len, map(str.encode, some)), "int64", len(some)))
            at = np.searchsorted(ends, own)
            if at[-1] >= len(ends) or (ends[at] != own).any():
                continue  # each is then encoded by itself
            data, edges = ids.tobytes(), [0, *((at + 1) * ids.itemsize).tolist()]
            self._room()
            self.update(zip(some, [data[a:b] for a, b in itertools.pairwise(edges)], strict=True))


_BPE: dict[tuple[str, int], ByteBpe] = {}


def byte_bpe(path: str, width: int = 4) -> ByteBpe:
    """This worker's tokenizer with its cache."""
    if (path, width) not in _BPE:
        _BPE[path, width] = ByteBpe(path, width)
    return _BPE[path, width]


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def as_text(docs: DataFrame, text_col: str) -> Column:
    return docs[text_col].cast("string")


def filter_texts(docs: DataFrame, test: Callable[[], Callable[[list[str | None]], list[bool]]], text_col: str = "text") -> DataFrame:
    """The rows of docs whose whole text passes, all columns as they are; no shuffle. `test` makes a task's test of texts."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = test()
        for batch in batches:
            yield batch.filter(pa.array(passes(batch.column(at).cast(pa.string()).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
