"""Queries that fit models: joint retrieval, logistic regressions over a grid, a spectrum encoder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from asterfold.functions import hashing, scores
from asterfold.operators import encoder, joint, logistic, stats
from asterfold.plans.queries import FRACTION, query, table
from asterfold.sources.scratch import scratch_path

INTERVALS = {"near": ("featured", 0.2, 0.6), "far": ("spiral", 0.5, 0.9)}
LEAST, RATIO, SEED, K = 0.6, 0.6, 5, 10


def kinds() -> dict[str, Column]:
    return {"featured": scores.path_strength(F.col("featured")), "spiral": scores.path_strength(F.col("featured"), F.col("spiral"))}


def objects(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as objects: two halves as embeddings, votes and redshift from the id."""
    k = F.col("vec_id")
    share = lambda m: (k * m % 100).cast("double") / 100.0
    half = F.floor(F.size("embedding") / 2).cast("int")
    rows = table(spark, d, "embeddings").select(
        k.cast("string").alias("object_id"), F.when(k % 3 == 0, "anchor_v1").when(k % 3 == 1, "morphology_priority").otherwise("hash_fill").alias("selection_reason"),
        share(13).alias("z"), share(37).alias("featured"), share(61).alias("spiral"), F.slice("embedding", F.lit(1), half).alias("image"), F.slice("embedding", half + 1, half).alias("spectrum"))
    return rows.withColumns({f"reliable_{m}": c >= LEAST for m, c in kinds().items()})


def joint_readout(spark: SparkSession, d: str) -> joint.Readout:
    rows = objects(spark, d)
    hits = {n: F.count_if(F.col(f"reliable_{m}") & scores.in_interval(F.col("z"), lo, hi)).alias(n) for n, (m, lo, hi) in INTERVALS.items()}
    counts = rows.agg(*hits.values()).first()
    asked = [joint.Query(n, f"{m} from {lo} to {hi}", m, lo, hi, counts[n]) for n, (m, lo, hi) in INTERVALS.items()]
    return joint.joint_retrieval(rows, kinds(), asked, joint.Setup((0, 1), RATIO, 4, (0.1, 1.0, 10.0), SEED, K, LEAST))


REFERENCES = f"""e as (select vec_id::varchar as object_id, case vec_id % 3 when 0 then 'anchor_v1' when 1 then 'morphology_priority' else 'hash_fill' end as selection_reason,
    (vec_id * 13 % 100) / 100.0::double as z, (vec_id * 37 % 100) / 100.0::double as featured, (vec_id * 61 % 100) / 100.0::double as spiral from embeddings),
  tested as (select e.*, s.split_seed from e cross join (select unnest([0, 1]) as split_seed) s where {FRACTION.format("e.object_id || '|' || s.split_seed")} >= {RATIO}),
  asked as (select * from (values {', '.join(f"('{n}', '{m}', {lo}::double, {hi}::double)" for n, (m, lo, hi) in INTERVALS.items())}) t(query_name, kind, lo, hi)),
  met as (select *, case kind when 'featured' then featured else least(featured, spiral) end as strength, z >= lo and z < hi as inside from tested cross join asked),
  tasks as (select *, case task when 'morphology' then strength when 'redshift' then inside::int::double else strength * inside::int end as graded,
    case task when 'morphology' then strength >= {LEAST} when 'redshift' then inside else strength >= {LEAST} and inside end as hit from met cross join (select unnest(['morphology', 'redshift', 'joint']) as task)),
  scored as (select *, 'oracle' as condition, round(graded, 9) + 0.0 as score from tasks union all
    select *, 'no_information', round({FRACTION.format(f"'{SEED}|' || split_seed || '|' || query_name || '|' || task || '|' || object_id")}, 9) + 0.0 from tasks),
  rows as (select *, unnest(list_filter(['enriched_all', case when selection_reason like 'anchor_%' then 'anchor' end, case when selection_reason = 'morphology_priority' then 'morphology_priority' end], lambda x: x is not null)) as candidate_population from scored),
  placed as (select *, row_number() over (partition by query_name, task, condition, split_seed, candidate_population order by score desc, object_id) as r,
    row_number() over (partition by query_name, task, condition, split_seed, candidate_population order by graded desc) as i from rows),
  summed as (select query_name, task, condition, split_seed, candidate_population, count(*) as candidate_objects, count(*) filter (hit) as relevant_objects, count(*) filter (hit and r <= {K}) as hits,
    sum((power(2.0, graded) - 1) / log2(r + 1)) filter (r <= {K}) as dcg, sum((power(2.0, graded) - 1) / log2(i + 1)) filter (i <= {K}) as idcg,
    round(avg(strength) filter (r <= {K}), 6) + 0.0 as top_k_morphology_strength, round(avg(greatest(lo - z, z - hi, 0.0::double)) filter (r <= {K}), 6) + 0.0 as top_k_redshift_distance from placed group by all),
  metrics as (select query_name, task, condition, split_seed, candidate_population, candidate_objects, relevant_objects, round(hits / nullif(relevant_objects, 0), 6) as recall_at_k,
    round(least({K}, relevant_objects) / nullif(relevant_objects, 0), 6) as recall_at_k_ceiling, round(hits / least({K}, candidate_objects), 6) as precision_at_k,
    top_k_morphology_strength, top_k_redshift_distance, round(coalesce(dcg / nullif(idcg, 0), 0), 6) + 0.0 as ndcg_at_k, {K} as k from summed)"""


@query(f"with {REFERENCES} select * from metrics")
def joint_reference_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The conditions that bound the others, by query, task, seed and population."""
    return joint_readout(spark, d).metrics.where(F.col("condition").isin(*joint.REFERENCES))


@query()
def joint_retrieval_tables(spark: SparkSession, d: str) -> DataFrame:
    """All seven conditions over seeds; ridge heads have no SQL form, they are tested against closed solutions."""
    return joint_readout(spark, d).tables


@query()
def joint_fusion_comparisons(spark: SparkSession, d: str) -> DataFrame:
    return joint_readout(spark, d).comparisons


@query()
def logistic_grid_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Held-out accuracy of every fold and C, all fitted at once; tested by the slopes of the penalized loss."""
    rows = table(spark, d, "embeddings").withColumn("fold", hashing.fold(F.col("vec_id"), 4, SEED))
    found = logistic.accuracies(rows, "embedding", "label", "fold", [0.01, 0.1, 1.0])
    return found.withColumn("accuracy", F.round("accuracy", 6) + 0.0)


@query()
def spectrum_encoder(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as spectra: an encoder fitted on the training split, saved, loaded again, and all rows embedded."""
    rows = table(spark, d, "embeddings").withColumns({"split": hashing.split(F.col("vec_id"), SEED, 0.7), "flux": F.transform("embedding", lambda x: x + 2.0), "wave": F.transform("embedding", lambda _, i: 3600.0 + 100.0 * i)})
    path = scratch_path(spark, "encoder")
    encoder.SpectrumPca(components=4, pixels=48, window=5).fit(rows.where("split = 'train'")).write().save(path)
    model = encoder.SpectrumPcaModel.load(path)
    return model.transform(rows).select("vec_id", "split", F.transform("embedding", lambda x: F.round(x.cast("double"), 5) + 0.0).alias("embedding"))


@query(f"""with s as (select quality as t, case when toxic = 1 then 0 else 1 end as p, cast(floor({FRACTION.format("doc_id || '|fold-2'")} * 3) as integer) as seed from labels), c as (select unnest([0, 1]) as label),
  per as (select seed, label, count(*) filter (p = label and t = label) as tp, count(*) filter (p = label) as said, count(*) filter (t = label) as support from s cross join c group by all),
  each as (select seed, (select round(avg(case when p = t then 1.0::double else 0.0 end), 6) + 0.0 from s where s.seed = per.seed) as accuracy, round(avg(coalesce(2.0 * tp / nullif(said + support, 0), 0)), 6) + 0.0 as macro_f1 from per where said + support > 0 group by seed),
  whole as (select count(*) as seeds, round(avg(accuracy), 6) + 0.0 as accuracy_mean, round(stddev_pop(accuracy), 6) + 0.0 as accuracy_std, round(avg(macro_f1), 6) + 0.0 as macro_f1_mean, round(stddev_pop(macro_f1), 6) + 0.0 as macro_f1_std from each)
  select whole.*, label::integer as label, round(coalesce(tp / nullif(said, 0), 0), 6) + 0.0 as precision, round(coalesce(tp / nullif(support, 0), 0), 6) + 0.0 as recall, round(coalesce(2.0 * tp / nullif(said + support, 0), 0), 6) + 0.0 as f1, support::bigint as support
  from whole cross join per where seed = (select min(seed) from s) and said + support > 0""")
def class_metrics_over_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy and macro-F1 over seeds, beside the classes of the first seed."""
    rows = table(spark, d, "labels").select(F.lit("all").alias("g"), hashing.fold(F.col("doc_id"), 3, 2).alias("seed"), F.col("quality").alias("t"), F.when(F.col("toxic") == 1, 0).otherwise(1).alias("p"))
    found = stats.class_seed_metrics(rows, ["g"], "seed", "p", "t")
    return found.select("seeds", "accuracy_mean", "accuracy_std", "macro_f1_mean", "macro_f1_std", F.explode("per_class").alias("c")).select("seeds", "accuracy_mean", "accuracy_std", "macro_f1_mean", "macro_f1_std", "c.*")
