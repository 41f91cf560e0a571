"""SimHash near-duplicates: a binary-trie self-join of 64-bit fingerprints and the components of its links."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asterfold.llm.common import as_text, release, salted_join, staged, texts_of

SEED = 42
#: Fingerprints that one node pair of the trie may hold in a task; larger pairs are split at the next bits.
UNIT = 50_000
#: Bits by which a split goes down, and the size of the leaves below which pairs are compared as matrices.
STEP, LEAF = 6, 256


def fingerprint(text: str | None, width: int = 3) -> int:
    """Bit majority of the XXH64 of all word shingles; 0 without a word. Lower-cases A-Z only."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
    total, ones = 0, np.zeros(64, "int64")
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), "<u8", n)
    for low in range(0, n, 1 << 14):
        some = hashes[low : low + (1 << 14)]
        ones += np.unpackbits(some.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int64")
        total += len(some)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long) of every whole text, with the `carry` longs of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x, width) for x in texts_of(batch)), "u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(found.view("i8"))], ["doc_id", *carry, "fp"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), as_text(docs, text_col).alias("text"), *carry).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", *carry, "fp")))


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the classes of i and j; label: the smallest member known of each class."""
    while len(i):
        a, b = label[i], label[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        apart = low != high
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(label, high[apart], low[apart])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def trie_links(sides: list[np.ndarray], bits: int, errors: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links (member, smallest member) of the classes that pairs within `errors` bits make.

    sides: one sorted array of distinct values (its pairs with itself) or two (pairs across); only the lowest `bits`
    bits differ in one side, where `budget` errors are left. Node pairs go down the binary trie together: a child pair on
    unlike bits costs one error, and a pair whose errors exceed the budget is cut off. Pairs of small nodes are compared as a matrix.
    """
    both = np.concatenate(sides)
    label = np.arange(len(both))
    first, second = (0, len(sides[0])), (len(both) - len(sides[-1]), len(both))
    stack = [(*first, *second, bits, budget)]
    while stack:
        a0, a1, b0, b1, depth, budget = stack.pop()
        if a0 >= a1 or b0 >= b1 or (a0 == b0 and a1 - a0 == 1):
            continue
        if depth == 0 or (a1 - a0) * (b1 - b0) <= LEAF * LEAF:
            near = np.bitwise_count(both[a0:a1, None] ^ both[None, b0:b1]) <= errors
            i, j = np.nonzero(near)
            i, j = i + a0, j + b0
            _unite(label, i[i != j], j[i != j])
            continue
        bit = np.uint64(1) << np.uint64(depth - 1)
        cut = lambda lo, hi: lo + int(np.count_nonzero((both[lo:hi] & bit) == 0))
        am, bm = cut(a0, a1), cut(b0, b1)
        stack += [(a0, am, b0, bm, depth - 1, budget), (am, a1, bm, b1, depth - 1, budget)]
        if budget:
            stack.append((a0, am, bm, b1, depth - 1, budget - 1))
            if (a0, a1) != (b0, b1):
                stack.append((am, a1, b0, bm, depth - 1, budget - 1))
    member = np.nonzero(label != np.arange(len(label)))[0]
    return both[member], both[label[member]]


def _rotated(fp, block: int, sizes: tuple[int, ...]):
    """fp turned so that the block's bits come first: the trie's path."""
    left = sum(sizes[:block])
    return fp if not left else F.shiftleft(fp, left).bitwiseOR(F.shiftrightunsigned(fp, 64 - left))


def link_fingerprints(fps: DataFrame, errors: int = 2, unit: int = UNIT) -> DataFrame:
    """Links (u, v), u > v in the rotated order's sense, whose components are those of all pairs within `errors` bits.

    fps: distinct `fp`. Of errors + 1 blocks of bits two near fingerprints agree on one at least, so in the trie
    rotated to begin with that block their paths part only below it, with the whole budget. Each trie is dealt out by
    its first block; node pairs with more than `unit` fingerprints are split into child pairs within the budget, STEP
    bits at a time, until they fit a task. A task's links are stars, at most one a fingerprint.
    """
    blocks = errors + 1
    sizes = tuple(64 // blocks + (k < 64 % blocks) for k in range(blocks))
    paths = None
    for k in range(blocks):
        path = fps.select(F.lit(k).alias("trie"), _rotated(F.col("fp"), k, sizes).alias("path"))
        path = path.select("trie", "path", F.shiftrightunsigned("path", 64 - sizes[k]).alias("a"), F.lit(0).alias("side"))
        path = path.withColumns({"b": F.col("a"), "left": F.lit(64 - sizes[k]), "budget": F.lit(errors)})
        paths = path if paths is None else paths.unionByName(path)
    keys = ["trie", "left", "a", "b", "budget"]
    rows, found = paths, []
    while rows is not None:
        sized = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max("side").alias("high"), F.min("side").alias("low"))
        sized = staged(sized.where((F.col("n") > 1) & ((F.col("a") == F.col("b")) | (F.col("low") < F.col("high")))), "nodes")
        small = rows.join(sized.where((F.col("n") <= unit) | (F.col("left") == 0)).select(*keys), keys, "left_semi")
        found.append(small.repartition(*keys).sortWithinPartitions(*keys, "side", "path").mapInArrow(_units(errors, sizes), "u long, v long"))
        large = sized.where((F.col("n") > unit) & (F.col("left") > 0))
        if large.isEmpty():
            break
        few = large.count() <= 10_000
        rows = staged(_split(rows.join(F.broadcast(large.select(*keys)), keys, "left_semi") if few else salted_join(rows, large.select(*keys), keys, "left_semi", F.col("path"))), "split")
    links = found[0]
    for other in found[1:]:
        links = links.unionByName(other)
    return links.distinct()


def _split(rows: DataFrame) -> DataFrame:
    """Each row to the child pairs of its node pair that stay within the budget."""
    step = F.least(F.col("left"), F.lit(STEP))
    rows = rows.withColumns({"step": step, "below": F.col("left") - step})
    masks = F.array(*[F.lit(m).cast("long") for m in range(1 << STEP)])
    fits = F.filter(masks, lambda m: (F.bit_count(m) <= F.col("budget")) & (m < F.expr("shiftleft(1L, step)")))
    own = F.expr("shiftrightunsigned(path, below) & (shiftleft(1L, step) - 1)")
    out = rows.withColumn("own", own).withColumn("mask", F.explode(fits))
    out = out.withColumn("other", F.col("own").bitwiseXOR(F.col("mask")))
    same = F.col("a") == F.col("b")
    mine_first = F.when(same, F.col("own") <= F.col("other")).otherwise(F.col("side") == 0)
    first, second = F.when(mine_first, F.col("own")).otherwise(F.col("other")), F.when(mine_first, F.col("other")).otherwise(F.col("own"))
    down = lambda node, bits: F.expr(f"shiftleft({node}, step)").bitwiseOR(bits)
    return out.select("trie", "path", down("a", first).alias("a"), F.when(mine_first, 0).otherwise(1).alias("side"), down("b", second).alias("b"), F.col("below").alias("left"), (F.col("budget") - F.bit_count("mask")).alias("budget"))


def _units(errors: int, sizes: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(key: tuple, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            trie, left, a, b, budget = key
            side = np.concatenate([x for x, _ in parts])
            path = np.concatenate([x for _, x in parts]).view("u8")
            two = [np.unique(path)] if a == b else [np.unique(path[side == 0]), np.unique(path[side == 1])]
            u, v = trie_links(two, left, errors, budget)
            turn = np.uint64(sum(sizes[:trie]))
            if turn:
                u, v = ((x >> turn) | (x << (np.uint64(64) - turn)) for x in (u, v))
            return pa.RecordBatch.from_arrays([pa.array(u.view("i8")), pa.array(v.view("i8"))], ["u", "v"])

        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False).astype("i8") for x in ("trie", "left", "a", "b", "budget")]
            side, path = (batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("side", "path"))
            change = np.zeros(batch.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            edges = [0, *np.nonzero(change)[0].tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                key = tuple(int(c[lo]) for c in columns)
                if key != now and held:
                    yield links(now, held)
                    held = []
                now = key
                held.append((side[lo:hi], path[lo:hi].astype("i8")))
        if held:
            yield links(now, held)

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in a link; root: its component's smallest node. Two-phase stars, no driver state.

    Each round hangs a node's larger neighbours, then its smaller ones, on the smallest node it knows. Rounds grow
    with the logarithm of the longest path; each is written to the shared folder.
    """
    edges = staged(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = salted_join(both.where("v > u"), low, ["u"], "inner", F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, least, ["u"], "inner", F.col("v"))
        now = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        now = staged(now, "links")
        if not now.exceptAll(edges).head(1) and now.count() == edges.count():
            release(edges)
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        release(edges)
        edges = now


def _named(rows: DataFrame, errors: int, unit: int) -> DataFrame:
    """fp, root (one fingerprint a component) and component_id (its smallest doc_id) of the distinct fingerprints of rows."""
    classes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(link_fingerprints(classes.select("fp"), errors, unit))
    whole = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = classes.join(whole, classes.fp == whole.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    return salted_join(linked.select("fp", "root"), named, ["root"], "inner", F.col("fp"))


def near_duplicates(docs: DataFrame, errors: int = 2, width: int = 3, unit: int = UNIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for every row of docs.

    Texts without a word, null ones too, have fingerprint zero and link like any other. Rows with a null id belong to
    their component but never name it (null only where no member has an id); repeated rows come back as often.
    """
    rows = staged(fingerprints(docs, width, id_col, text_col), "fingerprints")
    named = _named(rows, errors, unit).select("fp", "component_id")
    out = salted_join(rows, named, ["fp"], "inner", F.coalesce("doc_id", F.lit(-1)))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def distinct_documents(docs: DataFrame, errors: int = 2, width: int = 3, unit: int = UNIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, all columns as they are.

    The row with the smallest id stays, null ids last; of rows that share it the one with the smallest hash of its
    text, and of rows alike in both the one with the smallest hash of all its columns.
    """
    same = F.xxhash64(as_text(docs, text_col))
    rows = staged(fingerprints(docs.withColumn("__same", same), width, id_col, text_col, ("__same",)), "fingerprints")
    rooted = salted_join(rows, _named(rows, errors, unit).select("fp", "root"), ["fp"], "inner", F.coalesce("doc_id", F.lit(-1)))
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "__same")).alias("k"))
    first = staged(first.select(F.col("k.doc_id").alias("__id"), F.col("k.__same").alias("__key")), "first")
    mine = lambda k: docs[id_col].cast("long").eqNullSafe(k["__id"]) & (same == k["__key"])
    repeated = staged(rows.groupBy(F.col("doc_id").alias("__id"), F.col("__same").alias("__key")).count().where("count > 1").drop("count"), "repeated")
    if repeated.isEmpty():
        return docs.join(first, mine(first), "left_semi")
    again = first.join(repeated, first["__id"].eqNullSafe(repeated["__id"]) & (first["__key"] == repeated["__key"]), "left_semi")
    once = first.join(repeated, first["__id"].eqNullSafe(repeated["__id"]) & (first["__key"] == repeated["__key"]), "left_anti")
    row = F.struct(*[docs[c] for c in docs.columns])
    some = docs.join(again, mine(again), "left_semi").groupBy(docs[id_col].alias("__id"), same.alias("__key"))
    some = some.agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("__row")).select("__row.*")
    return docs.join(once, mine(once), "left_semi").unionByName(some)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
