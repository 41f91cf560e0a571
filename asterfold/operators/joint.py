"""Joint retrieval from two embeddings: matched ridge heads, held-out rankings for structured queries, six readouts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asterfold.functions import hashing, scores
from asterfold.operators import heads, order, retrieval, toplists, validation
from asterfold.sources.scratch import staged

# Names of conditions, tasks and measures.
MODELS = ("image_only", "spectrum_only", "image_plus_spectrum")
ABLATIONS = ("fusion_shuffled_image", "fusion_shuffled_spectrum")
REFERENCES = ("oracle", "no_information")
TASKS = ("morphology", "redshift", "joint")
MEASURES = ("ndcg_at_k", "recall_at_k", "recall_at_k_ceiling", "precision_at_k", "top_k_morphology_strength", "top_k_redshift_distance")


@dataclass(frozen=True)
class Query:
    """An object kind within a redshift interval, and how many objects meet both."""

    name: str
    text: str
    morphology: str
    z_low: float
    z_high: float
    expected: int


@dataclass(frozen=True)
class Setup:
    """seeds and train_ratio of the splits, folds and alphas of the heads, seed of folds and noise, k, least strength."""

    seeds: tuple[int, ...]
    train_ratio: float
    folds: int
    alphas: tuple[float, ...]
    seed: int
    k: int
    threshold: float


@dataclass(frozen=True)
class Readout:
    """ranked: a row an object, query, task, condition and seed. metrics: a row each of these groups and population.
    tables: over seeds. comparisons: fusion less each baseline. selection: chosen alphas. splits: each object's side."""

    ranked: DataFrame
    metrics: DataFrame
    tables: DataFrame
    comparisons: DataFrame
    selection: DataFrame
    splits: DataFrame


def _checked(manifest: DataFrame, queries: list[Query], strengths: dict[str, Column], setup: Setup) -> DataFrame:
    """object_id, selection_reason, z, vector, s_<kind>, r_<kind>; one aggregate for ids, targets and expected counts."""
    if not queries:
        raise ValueError("at least one query is needed")
    if not 0 < setup.train_ratio < 1:
        raise ValueError("train_ratio must lie between 0 and 1")
    for q in queries:
        if not q.z_low < q.z_high or q.morphology not in strengths:
            raise ValueError(f"query {q.name}: an interval and a known morphology are needed")
    validation.require_columns(manifest, ["object_id", "selection_reason", "z", "image", "spectrum", *(f"reliable_{m}" for m in strengths)])
    rows = manifest.select(
        F.col("object_id").cast("string").alias("object_id"), F.col("selection_reason").cast("string").alias("selection_reason"), F.col("z").cast("double").alias("z"),
        F.concat("image", "spectrum").alias("vector"), F.size("image").alias("__image"), F.size("spectrum").alias("__spectrum"),
        *[c.alias(f"s_{m}") for m, c in strengths.items()], *[F.col(f"reliable_{m}").cast("boolean").alias(f"r_{m}") for m in strengths])
    rows = validation.require_unique(staged(rows, "joint"), "object_id")
    rules = {f"graded and binary {m} differ": ~(F.col(f"s_{m}") >= setup.threshold).eqNullSafe(F.col(f"r_{m}")) for m in strengths}
    rules |= {f"hits of {q.name}": F.col(f"r_{q.morphology}") & scores.in_interval(F.col("z"), q.z_low, q.z_high) for q in queries}
    ends = [f(c).alias(f"{n}_{c}") for c in ("__image", "__spectrum") for n, f in (("min", F.min), ("max", F.max))]
    found = rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()], *ends, F.count_if(F.col("vector").isNull()).alias("no vector")).first().asDict()
    wrong = {k: n for k, n in found.items() if n and (k.startswith("graded") or k == "no vector")}
    wrong |= {f"hits of {q.name}": (found[f"hits of {q.name}"], q.expected) for q in queries if found[f"hits of {q.name}"] != q.expected}
    if wrong:
        raise ValueError(f"rows break {wrong}")
    if any(found[f"min_{c}"] != found[f"max_{c}"] for c in ("__image", "__spectrum")):
        raise ValueError("embeddings differ in length")
    return rows


def _predictions(rows: DataFrame, test: DataFrame, kinds: list[str], setup: Setup) -> tuple[DataFrame, dict]:
    """test with a column <condition>|<target> of each model and ablation, and the heads.

    A fusion head is a sum of what it takes from either half, so a shuffled half needs only its number from the partner, no vector.
    """
    size = rows.select("__image", "__spectrum").first()
    dims = {"image_only": list(range(size[0])), "spectrum_only": list(range(size[0], size[0] + size[1]))}
    dims["image_plus_spectrum"] = dims["image_only"] + dims["spectrum_only"]
    train = rows.where("split = 'train'").withColumn("__fold", hashing.fold(F.concat_ws("|", "object_id", F.col("split_seed").cast("string")), setup.folds, setup.seed))
    targets = ["z", *(f"s_{m}" for m in kinds)]
    found = heads.fit_heads(train, "vector", targets, dims, "split_seed", "__fold", setup.folds, list(setup.alphas))
    columns: dict = {}
    for t in targets:
        for part in MODELS[:2]:
            columns[f"{part}|{t}"] = {s: (found[s, part, t].constant, found[s, part, t].weights) for s in setup.seeds}
        for half in MODELS[:2]:
            inside = [d in set(dims[half]) for d in range(size[0] + size[1])]
            columns[f"own_{half}|{t}"] = {s: (found[s, MODELS[2], t].constant if half == MODELS[1] else 0.0, found[s, MODELS[2], t].weights * inside) for s in setup.seeds}
    keep = [c for c in test.columns if c not in ("vector", "split_seed")]
    said = staged(heads.predicted(test, "vector", "split_seed", keep, columns), "predicted")
    partner = hashing.derangement(said, "object_id", setup.seed, ["split_seed"])
    fixed = partner.where(F.col("partner") == F.col("object_id")).limit(1).count()
    if fixed:
        raise ValueError("a shuffled half needs two held-out objects a seed at least")
    halves = said.select("split_seed", F.col("object_id").alias("partner"), *[F.col(f"`own_{h}|{t}`").alias(f"other_{h}|{t}") for h in MODELS[:2] for t in targets])
    met = said.join(partner, ["split_seed", "object_id"]).join(halves, ["split_seed", "partner"])
    sums = {}
    for t in targets:
        half = lambda whose, part, t=t: F.col(f"`{whose}_{part}|{t}`")
        sums[f"{MODELS[2]}|{t}"] = half("own", MODELS[0]) + half("own", MODELS[1])
        sums[f"{ABLATIONS[0]}|{t}"] = half("other", MODELS[0]) + half("own", MODELS[1])
        sums[f"{ABLATIONS[1]}|{t}"] = half("own", MODELS[0]) + half("other", MODELS[1])
    met = met.withColumns(sums)
    wide = [F.col(f"`{c}|{t}`") for c in (*MODELS, *ABLATIONS) for t in targets]
    return met.select(*keep, "split_seed", *wide), found


def _ranked(test: DataFrame, medians: DataFrame, queries: list[Query], setup: Setup) -> DataFrame:
    """A row an object, query, task, condition and seed, ranked by score, ties by object."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    rows = test.join(F.broadcast(medians), "split_seed")
    each = []
    for q in queries:
        kind, inside = q.morphology, scores.in_interval(F.col("z"), q.z_low, q.z_high)
        strength, reliable = F.col(f"s_{kind}"), F.col(f"r_{kind}")
        graded = {"morphology": strength, "redshift": inside.cast("double"), "joint": strength * inside.cast("double")}
        binary = {"morphology": reliable, "redshift": inside, "joint": reliable & inside}
        for task in TASKS:
            for condition in (*MODELS, *ABLATIONS, *REFERENCES):
                if condition == "oracle":
                    m, z, score = strength, F.col("z"), graded[task]
                elif condition == "no_information":
                    m, z = F.lit(0.0), F.col("__median")
                    score = hashing.fraction(F.lit(str(setup.seed)), F.col("split_seed").cast("string"), F.lit(q.name), F.lit(task), F.col("object_id"))
                else:
                    m, z = unit(F.col(f"`{condition}|s_{kind}`")), F.col(f"`{condition}|z`")
                    near = scores.interval_score(z, q.z_low, q.z_high)
                    score = {"morphology": m, "redshift": near, "joint": m * near}[task]
                cells = {
                    "query_name": F.lit(q.name), "query_text": F.lit(q.text), "task": F.lit(task), "condition": F.lit(condition), "score": F.round(score, 9) + 0.0, "graded_relevance": graded[task], "binary_relevance": binary[task],
                    "morphology_strength": strength, "reliable_morphology": reliable, "predicted_morphology": m, "predicted_z": z, "z_distance": F.greatest(q.z_low - F.col("z"), F.col("z") - q.z_high, F.lit(0.0))}
                each.append(F.struct(*[c.cast("double").alias(n) if n in ("score", "graded_relevance", "morphology_strength", "predicted_morphology", "predicted_z", "z_distance") else c.alias(n) for n, c in cells.items()]))
    flat = rows.select("object_id", "selection_reason", "z", "split_seed", F.explode(F.array(*each)).alias("c")).select("object_id", "selection_reason", "z", "split_seed", "c.*")
    return order.ranked_along(flat, ["query_name", "task", "condition", "split_seed"], [F.desc("score"), F.col("object_id")], "rank")


def joint_retrieval(manifest: DataFrame, strengths: dict[str, Column], queries: list[Query], setup: Setup) -> Readout:
    """Fits, ranks and reads out in one call.

    manifest: object_id, selection_reason, z, image, spectrum and reliable_<kind> of each kind of `strengths`. Raises for
    repeated ids, missing or uneven embeddings, strengths that disagree with the flags, and counts of hits other than
    expected. Scores are kept to nine digits.
    """
    rows = _checked(manifest, queries, strengths, setup)
    rows = rows.withColumn("split_seed", F.explode(F.array(*[F.lit(int(s)) for s in setup.seeds])))
    rows = rows.withColumn("split", F.when(hashing.fraction(F.col("object_id"), F.col("split_seed").cast("string")) < setup.train_ratio, "train").otherwise("test"))
    test = rows.where("split = 'test'").drop("split", "__image", "__spectrum")
    said, found = _predictions(rows, test, list(strengths), setup)
    medians = order.quantiles(rows.where("split = 'train'"), ["split_seed"], "z", [0.5]).select("split_seed", F.col("value").alias("__median"))
    ranked = staged(_ranked(said, medians, queries, setup), "ranked")
    by = ["query_name", "task", "condition", "split_seed", "candidate_population"]
    means = {"top_k_morphology_strength": F.col("morphology_strength"), "top_k_redshift_distance": F.col("z_distance")}
    per = toplists.group_metrics(retrieval.populations(ranked, "selection_reason"), by, "object_id", "graded_relevance", "binary_relevance", setup.k, means)
    names = {"n": "candidate_objects", "positives": "relevant_objects", "recall": "recall_at_k", "recall_ceiling": "recall_at_k_ceiling", "precision": "precision_at_k", f"ndcg_at_{setup.k}": "ndcg_at_k"}
    metrics = staged(per.withColumnsRenamed(names), "metrics").withColumn("k", F.lit(setup.k))
    table = retrieval.over_seeds(metrics.withColumn("positives", F.col("relevant_objects")), [c for c in (*by, "k") if c != "split_seed"], "split_seed", list(MEASURES))
    primary = metrics.where("task = 'joint' and candidate_population = 'enriched_all'")
    less = retrieval.fusion_differences(primary, ["query_name", "split_seed"], "condition", MODELS[2], [*MODELS[:2], *ABLATIONS], ["ndcg_at_k", "recall_at_k"])
    chosen = [(part, "spec_z" if t == "z" else t[2:], int(s), float(h.alpha), h.alpha == max(setup.alphas)) for (s, part, t), h in found.items()]
    selection = manifest.sparkSession.createDataFrame(chosen, "condition string, target string, split_seed int, ridge_alpha double, at_grid_max boolean")
    return Readout(ranked.drop("z_distance"), metrics, table, less, selection, rows.select("object_id", "split_seed", "split"))
