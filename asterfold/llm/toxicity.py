"""Toxicity: a factorization machine over hashed terms, so that pairs of terms can matter as such."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from asterfold.llm.common import as_text, staged, texts_of
from asterfold.llm.langid import fold

#: Buckets of the term hash.
BUCKETS = 1 << 20
#: Letters of a word's head, a term of its own.
PREFIX = 4
#: Labelled documents of either class that the fit takes at most, by the hash of their id, and the buckets of each: of a
#: longer text as many, evenly over the range of the hash. So the task that fits gets 290 MB at most.
TOXIC_ROWS, CLEAN_ROWS, ROW_BUCKETS = 6_000, 12_000, 4_096
#: The z-score from which a term counts in full, and the least that any term counts.
FULL_Z, LEAST_VALUE = 4.0, 0.1
FACTORS, EPOCHS, RATE, DECAY, BATCH = 8, 30, 0.1, 1e-4, 256

_WORD = re.compile(r"\w+")


def term_buckets(text: str | None) -> list[int]:
    """Distinct buckets of a text's lower-case words and of their first PREFIX letters, which inflected words share."""
    if not text:
        return []
    words = set(_WORD.findall(text.lower()))
    heads = {f"{w[:PREFIX]}-" for w in words}
    return list({zlib.crc32(w.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for w in words | heads})


@dataclass
class FactorizationMachine:
    """score(x) = bias + sum w_i + sum of <v_i, v_j> over pairs i < j of a text's terms."""

    terms: np.ndarray  # sorted buckets
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def positions(self, buckets: list[int]) -> np.ndarray:
        if not len(self.terms) or not buckets:
            return np.empty(0, "int64")
        own = np.asarray(buckets)
        at = np.minimum(np.searchsorted(self.terms, own), len(self.terms) - 1)
        return np.sort(at[self.terms[at] == own])

    def logit(self, at: np.ndarray) -> float:
        if not len(at):
            return self.bias
        v = self.factors[at]
        total = v.sum(axis=0)
        return float(self.bias + self.weights[at].sum() + 0.5 * (total @ total - (v * v).sum()))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(self.positions(term_buckets(text))), -30, 30))))


def weigh_terms(rows: list[np.ndarray], label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of the rows, sorted, and the value of each as an input: 1 from FULL_Z standard errors of log-odds on.

    Below, the value falls with the square of the z-score to LEAST_VALUE, so that no term is lost and the many without
    a signal of their own don't learn the rows by heart.
    """
    count = lambda some: np.bincount(np.concatenate(some), minlength=BUCKETS) if some else np.zeros(BUCKETS, "int64")
    every, marked = count(rows), count([x for x, y in zip(rows, label, strict=True) if y])
    terms = np.flatnonzero(every)
    toxic, clean = marked[terms], every[terms] - marked[terms]
    n1, n0 = label.sum(), len(label) - label.sum()
    a, b = toxic + 0.5, clean + 0.5
    odds = np.log(a / (n1 - toxic + 0.5)) - np.log(b / (n0 - clean + 0.5))
    z = odds / np.sqrt(1 / a + 1 / b + 1 / (n1 - toxic + 0.5) + 1 / (n0 - clean + 0.5))
    return terms.astype("int64"), np.clip((z / FULL_Z) ** 2, LEAST_VALUE, 1)


def fit(rows: list[np.ndarray], label: np.ndarray, seed: int = 7) -> FactorizationMachine:
    """Mini-batch AdaGrad on the log loss over every bucket of the rows. Without both classes: a constant.

    A step reads and writes its own rows' terms only; the weight decay of the steps since a term's last one is made up
    for when the term comes again, and at the end.
    """
    rng = np.random.default_rng(seed)
    label = np.asarray(label, "float64")
    rate = (label.sum() + 1) / (len(label) + 2) if len(label) else 0.0
    bias = float(np.log(rate / (1 - rate))) if 0 < rate < 1 else -30.0
    model = FactorizationMachine(np.empty(0, "int64"), bias, np.empty(0), np.empty((0, FACTORS)))
    if not label.any() or label.all():
        return model
    model.terms, scale = weigh_terms(rows, label)
    n = len(model.terms)
    state = np.zeros((n, 2 + 2 * FACTORS), "f4")  # a term's weight, factors, and the sums of their squared slopes
    state[:, 1 : 1 + FACTORS] = rng.normal(0, 0.02, (n, FACTORS))
    state[:, 1 + FACTORS :] = 1e-4
    scale, half = scale.astype("f4"), 1 + FACTORS
    place = np.zeros(BUCKETS, "i4")
    place[model.terms] = np.arange(n)
    at, sizes = [place[x] for x in rows], np.array([len(x) for x in rows])
    gb, decayed, where, step = 1e-4, np.zeros(n, "int64"), np.empty(n, "int64"), 0

    def decay(some: np.ndarray, missed: np.ndarray) -> None:
        some[:, :half] *= np.exp((-RATE * DECAY * missed[:, None]).astype("f4") / np.sqrt(some[:, half:]))

    for _ in range(EPOCHS):
        order = rng.permutation(len(at))
        for low in range(0, len(order), BATCH):
            own = order[low : low + BATCH]
            flat = np.concatenate([at[k] for k in own])
            doc, starts = np.repeat(np.arange(len(own)), sizes[own]), np.cumsum(sizes[own]) - sizes[own]
            met = np.zeros(n, bool)
            met[flat] = True
            terms = np.flatnonzero(met)
            where[terms] = np.arange(len(terms))
            place = where[flat]
            mine = state[terms]
            decay(mine, step - decayed[terms])
            x = scale[terms]
            scaled = mine[:, :half] * x[:, None]
            values, filled = scaled[place], np.flatnonzero(sizes[own])
            sums, squares = np.zeros((len(own), half), "f4"), np.zeros(len(own), "f4")
            if len(filled):
                sums[filled] = np.add.reduceat(values, starts[filled], axis=0)
                squares[filled] = np.add.reduceat((values[:, 1:] ** 2).sum(axis=1), starts[filled])
            logit = model.bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(axis=1) - squares)
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label[own]) / len(own)
            per_term = lambda of: np.bincount(place, of[doc], len(terms))
            down = np.empty((len(terms), half), "f4")
            down[:, 0] = slope = per_term(error)
            for k in range(1, half):
                down[:, k] = per_term(error * sums[:, k])
            down[:, 1:] -= scaled[:, 1:] * slope[:, None]
            down = down * x[:, None] + DECAY * mine[:, :half]
            db = float(error.sum())
            gb += db * db
            mine[:, half:] += down * down
            mine[:, :half] -= RATE * down / np.sqrt(mine[:, half:])
            state[terms] = mine
            model.bias -= RATE * db / np.sqrt(gb)
            step += 1
            decayed[terms] = step
    decay(state, step - decayed)
    model.weights = (state[:, 0] * scale).astype("f8")
    model.factors = (state[:, 1:half] * scale[:, None]).astype("f8")
    return model


def learn(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> FactorizationMachine:
    """Fits on at most TOXIC_ROWS and CLEAN_ROWS labelled documents; tasks turn their texts into buckets, one fits.

    An id with several labels counts as toxic if any says so; one with several texts is fitted by one of them, the
    least by its buckets. Null labels, and ids without a document, don't count, neither in the draw nor in the odds.
    The bias is shifted from the fitted classes' odds to those of all labelled documents, so a score doesn't hang on the
    caps. The driver gets the model only.
    """
    said = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & train).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    known = staged(said.join(docs.select(id_col), id_col, "left_semi"), "labelled")
    order = [F.xxhash64(id_col), F.col(id_col)]
    drawn = known.where("y = 1").orderBy(*order).limit(TOXIC_ROWS).unionByName(known.where("y = 0").orderBy(*order).limit(CLEAN_ROWS))
    rows = docs.select(F.col(id_col), as_text(docs, text_col).alias("text")).join(F.broadcast(drawn), id_col)

    def buckets(text: str | None) -> bytes:
        own = np.sort(np.asarray(term_buckets(text), "<i4"))
        return (own[np.linspace(0, len(own) - 1, ROW_BUCKETS).astype("i8")] if len(own) > ROW_BUCKETS else own).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [buckets(x) for x in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(batch.schema.get_field_index("y")).cast(pa.int32())], ["id", "buckets", "y"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches([b.select(["id", "buckets", "y"]) for b in batches], kept).sort_by("id").combine_chunks()
        packed = got.column("buckets").combine_chunks() if got.num_rows else pa.array([], pa.binary())
        label = got.column("y").to_numpy().astype("int64")
        model = fit([np.frombuffer(x.as_buffer(), "<i4") for x in packed], label)
        parts = (model.terms.astype("<i4"), model.weights.astype("<f8"), model.factors.astype("<f8"))
        yield pa.RecordBatch.from_arrays([*(pa.array([x.tobytes()], pa.binary()) for x in parts), pa.array([model.bias]), pa.array([int(label.sum())]), pa.array([int((1 - label).sum())])], ["terms", "weights", "factors", "bias", "toxic", "clean"])

    kept = pa.schema([("id", pa.int64()), ("buckets", pa.binary()), ("y", pa.int32())])
    held = rows.withColumn(id_col, F.col(id_col).cast("long")).mapInArrow(run, "id long, buckets binary, y int")
    sample = held.groupBy("id").agg(F.min("buckets").alias("buckets"), F.max("y").alias("y"))
    one = sample.repartition(1).mapInArrow(fitted, "terms binary, weights binary, factors binary, bias double, toxic long, clean long").toArrow()
    get = lambda name: one.column(name)[0]
    terms, weights, factors = (np.frombuffer(get(c).as_buffer(), kind) for c, kind in (("terms", "<i4"), ("weights", "<f8"), ("factors", "<f8")))
    model = FactorizationMachine(terms.astype("int64"), get("bias").as_py(), weights, factors.reshape(-1, FACTORS))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if toxic and clean and get("toxic").as_py() and get("clean").as_py():
        model.bias += float(np.log(toxic / clean) - np.log(get("toxic").as_py() / get("clean").as_py()))
    return model


def score_texts(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1) and predicted (score >= 0.5) of every whole text; null and empty ones get the bias alone.

    Rows of a null id and repeated rows are scored by their own text, each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            score = np.fromiter(map(own.score, texts_of(batch)), "float64", batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype("i4"))], [id_col, "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), as_text(docs, text_col).alias("text")).mapInArrow(run, f"{id_col} long, score double, predicted int")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    model = learn(docs, labels, ~held_out)
    return score_texts(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
