"""MinHash near-duplicates with tensored banding: a table's key joins two keys of smaller collections."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asterfold.llm.common import as_text, bit_filter, salted_join, staged, texts_of
from asterfold.llm.simhash import components

SEED = 42
#: Minhashes of a half key, and the chance that a pair of just the wanted similarity may have to be missed.
ROWS, MISS = 3, 1e-5
#: Shingles of a batch's texts that are hashed together, members of a shared key that one task compares, members that
#: one task checks against a hub, and bins of the counts that bound an intersection from above.
SLICE, BLOCK, CHECKED, BINS = 1 << 19, 2_000, 2_000, 256
#: Cells (pairs times bins) that are compared at once.
CELLS = 1 << 23


def half_keys(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Keys of either collection, of `rows` minhashes each, so that a pair meets in one key of both with probability 1 - miss."""
    return max(1, math.ceil(math.log(miss / 2) / math.log(1 - similarity**rows))) if similarity < 1 else 1


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles of a text, A-Z in lower case; the whole sequence if it has fewer words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, "<u8")
    own = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxh64_intdigest, own, repeat(SEED)), "<u8", max(1, len(words) - width + 1)))


def minhash_keys(sets: list[np.ndarray], keys: int, rows: int) -> np.ndarray:
    """(sets, 2 * keys) words: a key mixes `rows` minhashes; the first `keys` are the left collection. No set is empty.

    Each minhash is the least of the set's hashes under an odd multiplier and an offset, so keys * rows * 2 of them
    serve keys * keys tables.
    """
    rng = np.random.default_rng(SEED)
    factor = rng.integers(0, 1 << 63, 2 * keys * rows, dtype="u8") * np.uint64(2) + np.uint64(1)
    offset = rng.integers(0, 1 << 63, 2 * keys * rows, dtype="u8")
    mix = rng.integers(0, 1 << 63, 2 * keys, dtype="u8")
    out = np.empty((len(sets), 2 * keys), "<u8")
    low = 0
    sizes = np.cumsum([len(s) for s in sets])
    while low < len(sets):
        high = max(low + 1, int(np.searchsorted(sizes, SLICE + (sizes[low - 1] if low else 0), "right")))
        flat = np.concatenate(sets[low:high])
        starts = np.append(0, np.cumsum([len(s) for s in sets[low : high - 1]])).astype("int64")
        for k in range(2 * keys):
            word = np.full(high - low, mix[k], "u8")
            for r in range(k * rows, (k + 1) * rows):
                word = (word ^ np.minimum.reduceat(flat * factor[r] + offset[r], starts)) * np.uint64(0x9E3779B97F4A7C15)
                word ^= word >> np.uint64(29)
            out[low:high, k] = word
        low = high
    return out


def _sketched(docs: DataFrame, width: int, keys: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row_key, s (128-bit hash of the set, null if empty), n, halves (null if empty) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            digests: list[bytes | None] = []
            sizes: list[int] = []
            halves: list[list[int] | None] = []
            held: list[np.ndarray] = []
            room = 0

            def flush(held: list[np.ndarray], halves=halves) -> None:
                made = iter(minhash_keys([x for x in held if len(x)], keys, ROWS).view("i8").tolist() if any(map(len, held)) else [])
                halves += [next(made) if len(x) else None for x in held]

            for text in texts_of(batch):
                own = shingles(text, width)
                digests.append(xxh3_128_digest(own.tobytes()) if len(own) else None)
                sizes.append(len(own))
                held.append(own)
                room += len(own)
                if room > SLICE:
                    flush(held)
                    held, room = [], 0
            flush(held)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(halves, pa.list_(pa.int64()))],
                ["doc_id", "row_key", "s", "n", "halves"])

    return _keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, row_key long, s binary, n long, halves array<long>")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, row_key (a hash of both)."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), as_text(docs, text_col).alias("text"))
    return rows.withColumn("row_key", F.xxhash64("doc_id", "text"))


def tensored(sets: DataFrame, keys: int) -> DataFrame:
    """key, node: the keys of all tables in which a set might meet another one.

    sets: node, halves. A table (i, j) has the key (left i, right j), so only half keys that several sets hold can make
    a shared one: they are counted first, and the pairs are formed from those alone.
    """
    each = sets.select("node", F.posexplode("halves").alias("place", "half"))
    again = staged(each.groupBy("half").agg(F.count("*").alias("__n")).where("__n > 1").select("half"), "halves")
    met = salted_join(each, again, ["half"], "inner", F.col("node"))
    side = lambda of: F.collect_list(F.when(of, F.col("half")))
    both = met.groupBy("node").agg(side(F.col("place") < keys).alias("left"), side(F.col("place") >= keys).alias("right"))
    left = both.select("node", F.explode("left").alias("left"), "right")
    return left.select("node", "left", F.explode("right").alias("right")).select(F.xxhash64("left", "right").alias("key"), "node")


def _contents(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """node, hashes (the sorted set as bytes) of the wanted nodes (node, s, row_key), from the rows that stand for them.

    Row keys pass a broadcast filter of bounded size first, which loses none; the join then is exact.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted, "row_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        bits = shared.value
        for batch in batches:
            keys = batch.column(2).to_numpy()
            low = keys & (len(bits) * 8 - 1)
            at = np.flatnonzero(bits[low >> 3] >> (low & 7).astype("u1") & 1)
            at = at[np.sort(np.unique(keys[at], return_index=True)[1])] if len(at) else at
            found = [shingles(batch.column(1)[k].as_py(), width) for k in at.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxh3_128_digest(x.tobytes()) for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], ["s", "hashes"])

    rows = _keyed(docs, id_col, text_col).mapInArrow(run, "s binary, hashes binary")
    return rows.join(wanted.select("s", "node"), "s").groupBy("node").agg(F.first("hashes").alias("hashes"))


def _checked(pairs: DataFrame, contents: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (hub, node) whose sets meet the similarity num / den, compared whole.

    A hub's set goes once to each of the tasks that check its pairs, CHECKED at a time, so no hub is hot.
    """
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / CHECKED).cast("int").alias("parts"))
    sets = contents.select("node", "hashes")
    dealt = salted_join(pairs, parts, ["hub"], "inner", F.col("node"))
    members = dealt.select("hub", "node", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind")).join(sets, "node")
    hubs = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(sets.withColumnRenamed("node", "hub"), "hub")
    both = hubs.select("hub", F.col("hub").alias("node"), "part", F.lit(0).alias("kind"), "hashes").unionByName(members.select("hub", "node", "part", "kind", "hashes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.empty(0, "<u8")
        for batch in batches:
            out: list[tuple[int, int]] = []
            for hub, node, kind, part, at in zip(*(batch.column(k).to_pylist() for k in range(4)), range(batch.num_rows), strict=True):
                its = np.frombuffer(batch.column(4)[at].as_buffer(), "<u8")
                if kind == 0:
                    now, own = (hub, part), its.copy()
                    continue
                if now != (hub, part):
                    raise ValueError("a hub's set is missing")
                place = np.minimum(np.searchsorted(own, its), len(own) - 1)
                same = int((own[place] == its).sum())
                if den * same >= num * (len(own) + len(its) - same):
                    out.append((node, hub))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["u", "v"])

    dealt_out = both.select("hub", "node", "kind", "part", "hashes").repartition("hub", "part").sortWithinPartitions("hub", "part", "kind")
    return dealt_out.mapInArrow(run, "u long, v long")


def bins(hashes: bytes) -> bytes:
    """How many of a set's hashes fall into each of BINS bins (as 16 bits, or all that these hold)."""
    n = np.bincount((np.frombuffer(hashes, "<u8") >> np.uint64(56)).astype("int64"), minlength=BINS)
    return np.minimum(n, (1 << 16) - 1).astype("<u2").tobytes()


def _possible(keyed: DataFrame, contents: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (hub, node) of a shared key whose components differ and whose sets may meet the similarity.

    keyed: key, n (its nodes), node, root. An intersection is at most the sum over bins of the smaller count, so no
    pair that meets the similarity is lost. A key of many nodes is compared in blocks of BLOCK by several tasks.
    """

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [x.as_buffer() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 8 for x in held], pa.int64()), pa.array([bins(x) for x in held], pa.binary())], ["node", "size", "bins"])

    sized = contents.select("node", "hashes").join(keyed.select("node").distinct(), "node", "left_semi").mapInArrow(binned, "node long, size long, bins binary")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = keyed.withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("node"), blocks).cast("int")}).join(sized, "node")
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")})
    names = ["key", "a", "b", "side", "node", "root", "size", "bins"]

    def near(part: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(part).combine_chunks()
        side, node, root, size = (whole.column(c).to_numpy() for c in ("side", "node", "root", "size"))
        counts = np.frombuffer(b"".join(whole.column("bins").to_pylist()), "<u2").reshape(-1, BINS)
        alone = whole.column("a")[0].as_py() == whole.column("b")[0].as_py()
        first, second = (np.arange(len(node)),) * 2 if alone else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        hubs, nodes = [], []
        step = max(1, CELLS // max(1, len(second) * BINS))
        for low in range(0, len(first), step):
            mine = first[low : low + step]
            small, large = np.minimum(size[mine, None], size[None, second]), np.maximum(size[mine, None], size[None, second])
            fits = (root[mine, None] != root[None, second]) & (den * small >= num * large)
            if alone:
                fits &= node[mine, None] < node[None, second]
            i, j = np.nonzero(fits)
            i, j = mine[i], second[j]
            shared = np.minimum(counts[i], counts[j]).sum(axis=1, dtype="int64")
            kept = (den + num) * shared >= num * (size[i] + size[j])
            hubs.append(np.minimum(node[i[kept]], node[j[kept]]))
            nodes.append(np.maximum(node[i[kept]], node[j[kept]]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (hubs, nodes)], ["hub", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in range(3)])
            edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges, edges[1:], strict=False):
                if held and tuple(key[:, low]) != now:
                    yield near(held)
                    held = []
                now = tuple(key[:, low])
                held.append(batch.slice(low, high - low))
        if held:
            yield near(held)

    return rows.select(*names).repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(run, "hub long, node long").distinct()


def _roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes with the root of their component, themselves if they have no link."""
    found = components(links)
    whole = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    return nodes.join(whole, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(docs: DataFrame, num: int = 80, den: int = 100, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept for every row: links of similarity num / den or more.

    Rows of one set are one node. A key's nodes are first checked against its smallest and largest node. Where a key of
    more than three nodes still holds several components, all its pairs across them that may meet the similarity are checked, so
    a link is lost only with the chance MISS that its sets share no table.

    Null and empty texts, and those of white space, have no shingle and no link: component_id is their own id. Rows
    with a null id belong to their component but never name it: component_id is null where no member has an id, and
    kept is then true. Repeated rows come back as often. Columns other than id and text are not read.
    """
    keys = half_keys(num / den)
    rows = staged(_sketched(docs, width, keys, id_col, text_col), "sketches")
    once = rows.where("s is not null").groupBy("s").agg(F.min("doc_id").alias("first"), F.min_by(F.struct("row_key", "halves"), F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("r"))
    sets = staged(once.select(F.monotonically_increasing_id().alias("node"), "s", "first", "r.row_key", "r.halves"), "sets")
    keyed = staged(tensored(sets, keys), "keys")
    hubs = staged(keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("low < high"), "hubs")
    met = staged(salted_join(keyed, hubs, ["key"], "inner", F.col("node")), "met")
    nodes = sets.join(met.select("node").distinct(), "node", "left_semi")
    contents = staged(_contents(docs, nodes.select("node", "s", "row_key"), width, id_col, text_col), "contents")
    ends = met.select("node", F.explode(F.array("low", "high")).alias("hub")).where("hub <> node")
    pairs = staged(ends.select(F.least("hub", "node").alias("hub"), F.greatest("hub", "node").alias("node")).distinct(), "pairs")
    links = staged(_checked(pairs, contents, num, den), "links")
    many = met.where("n > 3").select("key", "n", "node")
    rooted = _roots(many.select("node").distinct(), links)
    open_ = many.join(rooted, "node")
    several = open_.groupBy("key").agg(F.min("root").alias("__a"), F.max("root").alias("__b")).where("__a < __b").select("key")
    more = staged(_possible(salted_join(open_, several, ["key"], "inner", F.col("node")), contents, num, den).join(pairs, ["hub", "node"], "left_anti"), "more")
    if not more.isEmpty():
        links = links.unionByName(_checked(more, contents, num, den))
    named = _roots(sets.select("node", "s", "first"), links)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = salted_join(named.select("s", "root"), least, ["root"], "inner", F.col("s")).select("s", "component_id")
    out = salted_join(rows.select("doc_id", "n", "s"), named, ["s"], "left", F.coalesce("doc_id", F.lit(-1)))
    component = F.when(F.col("s").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 85, 100, 3)
