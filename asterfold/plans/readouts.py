"""Queries that read results out: audits with intervals, populations and seeds, caches, pairs, judges' responses, guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asterfold.functions import hashing, morphology, scores, text, vectors
from asterfold.functions.binding import bound
from asterfold.operators import audits, caches, order, pairing, population, probes, retrieval, sphere, stats, validation
from asterfold.operators.stats import r6
from asterfold.plans.queries import FRACTION, JOINT, PLACES, RADIUS, TREES, pred, query, skies, table, trees, votes
from asterfold.plans.queries import PRED as PREDICTED
from asterfold.sources import tables


def boot_sql(key: str, draw: int, samples: int, by: str = "") -> str:
    """Intervals of the CTE `objects` (by, key, total, weight) as a query."""
    part = f"{by}, " if by else ""
    grouped, using = (f"group by {by}", f"join point using ({by})") if by else ("", "cross join point")
    return f"""draws as (select o.*, r.resample, {FRACTION.format(f"o.{key} || '|' || r.resample || '|bootstrap-{draw}'")} as u from objects o cross join (select unnest(generate_series(0, {samples - 1})) as resample) r),
  counted as (select *, case when u < 0.36787944117144233 then 0 when u < 0.73575888234288467 then 1 when u < 0.91969860292860584 then 2 when u < 0.98101184312384624 then 3 when u < 0.99634015317265634 then 4 when u < 0.9994058151824184 then 5 when u < 0.99991675885071201 then 6 when u < 0.99998975080332540 then 7 else 8 end as c from draws),
  means as (select {part}resample, sum(c * total) / nullif(sum(c * weight), 0) as m from counted group by {part}resample),
  point as (select {part}round(sum(total) / sum(weight), 6) + 0.0 as estimate, count(*) as objects from objects {grouped}),
  found as (select {part}round(quantile_cont(m, 0.025), 6) + 0.0 as ci_low, round(quantile_cont(m, 0.975), 6) + 0.0 as ci_high from means {grouped})
  select {part}ci_low, ci_high, estimate, objects from found {using}"""


ANSWERS = f"""{TREES}, answers as (select p_partkey, 'size' as question, case when h1 = j1 then 1.0::double else 0.0 end as ok from trees union all select p_partkey, 'brand', 1.0 from trees)"""


@query(f"""with {ANSWERS}, each as (select p_partkey, q as question, m as measure, case when m = 'accuracy' then ok else 0.0 end as x from answers cross join (select unnest(['accuracy', 'abstention']) as m) cross join lateral (select unnest(['', question]) as q)),
  objects as (select measure, question, p_partkey, sum(x) as total, count(*) as weight from each group by all), answered as (select measure, question, sum(weight)::bigint as answers from objects group by all),
  intervals as (with {boot_sql('p_partkey', 4, 60, 'measure, question')}) select measure, nullif(question, '') as question, ci_low, ci_high, estimate, objects, answers from intervals join answered using (measure, question)""")
def audit_intervals(spark: SparkSession, d: str) -> DataFrame:
    t = trees(spark, d).select("p_partkey", text.tree_answers(F.col("human")).alias("gold"), text.tree_answers(F.col("judge")).alias("said"))
    rows = audits.answer_rows(t.select("p_partkey", "gold"), t.select("p_partkey", "said"), "p_partkey", "gold", "said")
    return audits.audit_intervals(rows, "p_partkey", 60, 4)


@query(f"""with {TREES}, objects as (select p_partkey, case when h1 = j1 then 1.0::double else 0.5 end as total, 1 as weight from trees), intervals as (with {boot_sql('p_partkey', 5, 60)}) select *, 2.0::double as mean_human_nodes from intervals""")
def path_audit_metrics(spark: SparkSession, d: str) -> DataFrame:
    t = trees(spark, d)
    return audits.path_metrics(audits.path_rows(t.select("p_partkey", "human"), t.select("p_partkey", "judge"), "p_partkey", "human", "judge"), "p_partkey", 60, 5)


@query(f"""with {TREES}, objects as (select p_partkey, case when h1 = j1 then 0.0::double else 0.5 end as total, 1 as weight from trees), {boot_sql('p_partkey', 6, 60)}""")
def path_score_delta(spark: SparkSession, d: str) -> DataFrame:
    """A judge who says what people say, less one who draws the line between sizes elsewhere."""
    t = trees(spark, d)
    human = t.select("p_partkey", "human")
    of = lambda judge: audits.path_rows(human, t.select("p_partkey", F.col(judge).alias("j")), "p_partkey", "human", "j")
    return audits.paired_path_delta(of("human"), of("judge"), "p_partkey", 60, 6)


@query("select case when count(*) filter (b <> a) = 0 then 1.0::double else round(avg(case when a = b then 1.0::double else 0.0 end), 6) end as row_accuracy, round(avg(case when a = b then 1.0::double else 0.0 end), 6) + 0.0 as answer_accuracy from (select case when p_size > 25 then 'large' else 'small' end as a, case when p_size > 20 then 'large' else 'small' end as b from part)")
def calibration_accuracy(spark: SparkSession, d: str) -> DataFrame:
    p, of = table(spark, d, "part"), lambda t: F.create_map(F.lit("size"), F.when(F.col("p_size") > t, "large").otherwise("small"))
    return audits.calibration(p.select("p_partkey", of(25).alias("want")), p.select("p_partkey", of(20).alias("got")), "p_partkey", "want", "got")


READ = f"""{JOINT.rpartition('scored as')[0]} tested as (select p.*, s.split_seed, case when p_size <= 15 then 'anchor_v1' when p_size <= 25 then 'morphology_priority' else 'hash_fill' end as selection_reason
    from points p join part using (p_partkey) cross join (select unnest([0, 1]) as split_seed) s where {FRACTION.format("p_partkey || '|readout-' || s.split_seed")} >= 0.5),
  conditions as (select *, case condition when 'image_plus_spectrum' then strength * closeness when 'image_only' then strength else closeness end as raw from tested cross join (select unnest(['image_plus_spectrum', 'image_only', 'spectrum_only']) as condition)),
  rows as (select condition, split_seed, p_partkey, p_retailprice, strength, candidate_population, round(raw, 6) + 0.0 as score, case when p_retailprice >= 1200 and p_retailprice < 1500 then strength else 0.0 end as graded, p_retailprice >= 1200 and p_retailprice < 1500 and strength >= 0.6 as hit
    from conditions cross join lateral (select unnest(list_filter(['enriched_all', case when selection_reason like 'anchor_%' then 'anchor' end, case when selection_reason = 'morphology_priority' then 'morphology_priority' end], lambda x: x is not null)) as candidate_population)),
  placed as (select *, row_number() over (partition by condition, split_seed, candidate_population order by score desc, p_partkey) as r, row_number() over (partition by condition, split_seed, candidate_population order by graded desc, p_partkey) as i from rows),
  summed as (select condition, split_seed, candidate_population, count(*) as n, count(*) filter (hit) as positives, count(*) filter (hit and r <= 10) as hits, sum((power(2.0, graded) - 1) / log2(r + 1)) filter (r <= 10) as dcg, sum((power(2.0, graded) - 1) / log2(i + 1)) filter (i <= 10) as idcg,
    round(avg(strength) filter (r <= 10), 6) + 0.0 as top_k_strength, round(avg(greatest(1200 - p_retailprice, p_retailprice - 1500, 0.0::double)) filter (r <= 10), 6) + 0.0 as top_k_distance from placed group by all),
  metrics as (select condition, split_seed, candidate_population, n, positives, round(hits / nullif(positives, 0), 6) as recall, round(least(10, positives) / nullif(positives, 0), 6) as recall_ceiling, round(hits / least(10, n), 6) as precision, top_k_strength, top_k_distance,
    round(coalesce(dcg / nullif(idcg, 0), 0), 6) + 0.0 as ndcg_at_10 from summed)"""
MEASURES = ["ndcg_at_10", "recall", "recall_ceiling", "precision", "top_k_strength", "top_k_distance"]


def readout(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of three conditions over two held-out splits for each population."""
    price = F.col("p_retailprice").cast("double")
    closeness, inside = scores.interval_score(price, 1200.0, 1500.0), scores.in_interval(price, 1200.0, 1500.0)
    size = table(spark, d, "part").select("p_partkey", "p_size")
    rows = votes(spark, d).join(size, "p_partkey").withColumn("strength", scores.path_strength(F.col("featured"), F.col("spiral")))
    rows = rows.withColumn("split_seed", F.explode(F.array(F.lit(0), F.lit(1)))).where(hashing.fraction(F.col("p_partkey"), F.concat(F.lit("readout-"), F.col("split_seed").cast("string"))) >= 0.5)
    scored = {"image_plus_spectrum": F.col("strength") * closeness, "image_only": F.col("strength"), "spectrum_only": closeness}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("condition"), r6(v).alias("score")) for k, v in scored.items()])).alias("c")
    reason = F.when(F.col("p_size") <= 15, "anchor_v1").when(F.col("p_size") <= 25, "morphology_priority").otherwise("hash_fill")
    rows = rows.select("p_partkey", "split_seed", "strength", price.alias("price"), reason.alias("selection_reason"), F.when(inside, F.col("strength")).otherwise(0.0).alias("graded"), (inside & (F.col("strength") >= 0.6)).alias("hit"), each).select("*", "c.condition", "c.score")
    distance = F.greatest(1200 - F.col("price"), F.col("price") - 1500, F.lit(0.0))
    means = {"top_k_strength": F.col("strength"), "top_k_distance": distance}
    return retrieval.group_metrics(retrieval.populations(rows, "selection_reason"), ["condition", "split_seed", "candidate_population"], "p_partkey", "graded", "hit", 10, means)


@query(f"with {READ} select * from metrics")
def three_population_readout(spark: SparkSession, d: str) -> DataFrame:
    return readout(spark, d)


@query(f"with {READ} select condition, candidate_population, count(distinct split_seed) as split_seeds, min(positives) as relevant_objects_min, {', '.join(f'round(avg({m}), 6) + 0.0 as {m}_mean, round(stddev_pop({m}), 6) + 0.0 as {m}_split_std' for m in MEASURES)} from metrics group by all")
def readout_over_seeds(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.over_seeds(readout(spark, d), ["condition", "candidate_population"], "split_seed", MEASURES)


@query(f"""with {READ}, p as (select * from metrics where candidate_population = 'enriched_all') select f.split_seed, 'image_plus_spectrum_minus_' || b.condition as comparison, round(f.ndcg_at_10 - b.ndcg_at_10, 6) + 0.0 as ndcg_at_10_difference, round(f.recall - b.recall, 6) + 0.0 as recall_difference
  from p f join p b using (split_seed) where f.condition = 'image_plus_spectrum' and b.condition <> 'image_plus_spectrum'""")
def fusion_differences(spark: SparkSession, d: str) -> DataFrame:
    rows = readout(spark, d).where("candidate_population = 'enriched_all'")
    return retrieval.fusion_differences(rows, ["split_seed"], "condition", "image_plus_spectrum", ["image_only", "spectrum_only"], ["ndcg_at_10", "recall"])


@query(f"with {PLACES}, best as (select s_suppkey, c_custkey, round(degrees(2 * asin(least(sqrt(d2) / 2, 1))) * 3600, 6) + 0.0 as sep from pairs qualify row_number() over (partition by s_suppkey order by round(degrees(2 * asin(least(sqrt(d2) / 2, 1))) * 3600, 6), c_custkey) = 1) select s_suppkey, case when sep <= 1200 then 'matched' else 'absent' end as status, case when sep <= 1200 then c_custkey end as source_object_id, sep as separation_arcsec from best")
def coverage_with_separations(spark: SparkSession, d: str) -> DataFrame:
    c, s, on = skies(spark, d)
    found = sphere.full_coverage(s, c, 1200.0, (on[2], on[3], on[0], on[1]), "s_suppkey", "c_custkey")
    return validation.coverage(found, s.count())


@query(f"with {PLACES} select c_custkey, s_suppkey, separation_arcsec, cast(row_number() over (partition by c_custkey order by separation_arcsec, s_suppkey) as integer) as candidate_rank from near")
def sphere_untruncated(spark: SparkSession, d: str) -> DataFrame:
    """Every supplier in reach of a customer: the limit on a list is one more than there are suppliers, so none is cut."""
    c, s, on = skies(spark, d)
    limit = s.count() + 1
    return sphere.untruncated(sphere.nearest(c, s, RADIUS, on, "c_custkey", "s_suppkey", limit), limit).select("c_custkey", "s_suppkey", "separation_arcsec", "candidate_rank")


@query("""with s as (select quality as t, case when toxic = 1 then 0 else 1 end as p from labels), c as (select unnest([0, 1]) as label), per as (select label, count(*) filter (p = label and t = label) as tp, count(*) filter (p = label) as said, count(*) filter (t = label) as support from s cross join c group by label)
  select (select count(*) from s) as n, (select round(avg(case when p = t then 1.0::double else 0.0 end), 6) + 0.0 from s) as accuracy, round(avg(coalesce(2.0 * tp / nullif(said + support, 0), 0)), 6) + 0.0 as macro_f1 from per where said + support > 0""")
def classification_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").select(F.col("quality").alias("t"), F.when(F.col("toxic") == 1, 0).otherwise(1).alias("p"))
    return stats.classification_summary(rows, [], "p", "t")


@query(f"""with {PREDICTED.replace('l_returnflag,', 'l_orderkey, l_returnflag,')}, s as (select *, cast(floor({FRACTION.format("l_orderkey || '|fold-1'")} * 5) as integer) as seed from pred), m as (select l_returnflag, seed, avg(abs(p - t)) as mae from s group by all)
  select l_returnflag, count(*) as n, count(*) filter (mae < 2.5) as n_passed, bool_and(mae < 2.5) as all_passed from m group by l_returnflag""")
def seeds_all_passed(spark: SparkSession, d: str) -> DataFrame:
    per = pred(spark, d).withColumn("seed", hashing.fold(F.col("l_orderkey"), 5, 1)).groupBy("l_returnflag", "seed").agg(F.avg(F.abs(F.col("p") - F.col("t"))).alias("mae"))
    return stats.all_passed(per, ["l_returnflag"], F.col("mae") < 2.5)


@query(f"with f as (select p_brand, cast(floor({FRACTION.format(chr(39).join(['p_partkey || ', '|fold-7', '']))} * 10) as integer) as fold, p_retailprice from part), m as (select fold, round(avg(p_retailprice), 6) as price from f group by fold) select 1 as one, count(*) as folds, round(avg(price), 6) + 0.0 as mean, round(stddev_pop(price), 6) + 0.0 as std from m")
def ten_fold_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").groupBy(hashing.fold(F.col("p_partkey"), 10, 7).alias("fold")).agg(F.round(F.avg("p_retailprice"), 6).alias("price"))
    return retrieval.fold_summary(rows.withColumn("one", F.lit(1)), ["one"], "fold", "price")


@query("""select vec_id::varchar as object_id, 'label ' || label as text, 'document' as role, 'given' as model_id, 'v1' as revision, '' as instruction, sha256('') as instruction_hash, sha256('label ' || label) as source_checksum, len(embedding)::integer as output_dim,
  abs(sqrt(list_inner_product(cast(embedding as double[]), cast(embedding as double[]))) - 1) <= 0.001 as normalized from embeddings""")
def embedding_cache_ingest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").withColumn("text", F.concat(F.lit("label "), F.col("label").cast("string")))
    cache = caches.renormalized(caches.ingest(rows, "vec_id", "text", "embedding", "given", "v1"))
    return validation.validate_embedding_cache(cache).drop("embedding")


@query(f"""with {PLACES}, best as (select c_custkey, s_suppkey, separation_arcsec from near qualify row_number() over (partition by c_custkey order by separation_arcsec, s_suppkey) = 1), once as (select * from best qualify row_number() over (partition by s_suppkey order by separation_arcsec, c_custkey) = 1)
  select c_custkey::varchar as object_id, c_custkey::varchar as image_object_id, s_suppkey::varchar as spectrum_object_id, c_custkey as source_row_id, round((s_suppkey * 137.508::double + 0.3) % 360, 6) + 0.0 as spectrum_ra, round((s_suppkey % 1800) / 10.0::double - 90, 6) + 0.0 as spectrum_dec,
    abs(s_acctbal) / 10000 as z, 0.001::double as zerr, separation_arcsec from once join supplier using (s_suppkey)""")
def paired_manifest(spark: SparkSession, d: str) -> DataFrame:
    c, s, on = skies(spark, d)
    once = sphere.one_to_one(sphere.nearest(c, s, RADIUS, on, "c_custkey", "s_suppkey"), "c_custkey", "s_suppkey")
    raw = once.select(
        F.col("c_custkey").alias("id_source"), F.col("c_mktsegment").alias("survey_source"), F.col("c_ra").alias("ra_source"), F.col("c_dec").alias("dec_source"), F.col("c_custkey").alias("row_source"), F.lit("all").alias("why_source"), F.lit(0).alias("rank_source"),
        F.col("s_suppkey").alias("id_desi"), r6(F.col("s_ra")).alias("ra_desi"), r6(F.col("s_dec")).alias("dec_desi"), (F.abs("s_acctbal") / 10000).alias("z_desi"), F.lit(0.001).alias("zerr_desi"), F.lit(False).alias("warn_desi"), F.col("separation_arcsec").alias("_dist_arcsec"))
    left = {"object_id": "id", "survey": "survey", "ra": "ra", "dec": "dec", "source_row_id": "row", "selection_reason": "why", "selection_rank": "rank"}
    right = {"object_id": "id", "ra": "ra", "dec": "dec", "redshift": "z", "redshift_error": "zerr", "zwarn": "warn"}
    return pairing.paired_manifest(pairing.named_matches(raw, left, right))


@query("select o_orderkey::varchar as object_id, o_totalprice::double as z, o_custkey % 7 = 0 as zwarn from orders")
def spectrum_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 7 == 0).cast("int").alias("warn"))
    return pairing.labels(rows, "o_orderkey", "o_totalprice", "warn")


@query("select vec_id::varchar as object_id, len(embedding)::integer as pixels, round(list_sum(cast(embedding as double[])), 5) + 0.0 as total, 0::integer as masked from embeddings")
def spectra_on_one_grid(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    s = F.struct(e.alias("flux"), F.transform(e, lambda x, k: 3600.0 + 0.8 * k).alias("lambda"), F.transform(e, lambda x: F.lit(1.0)).alias("ivar"), F.transform(e, lambda x: x > 10).alias("mask"))
    rows, _ = pairing.spectra(table(spark, d, "embeddings").select("vec_id", s.alias("spectrum")), "vec_id", "spectrum", "flux", "lambda", "ivar", "mask")
    return rows.select("object_id", F.size("flux").alias("pixels"), (F.round(vectors.total(F.transform("flux", lambda x: x.cast("double"))), 5) + 0.0).alias("total"), F.size(F.filter("mask", lambda m: m)).alias("masked"))


@query("select vec_id, label, len(embedding)::integer as dim from embeddings where vec_id % 3 = 0")
def vectors_by_place(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    dim = e.select(F.size("embedding").alias("n")).first().n
    manifest = e.where("vec_id % 3 = 0").select("vec_id", "label", F.col("vec_id").alias("source_row_id"))
    source = e.select(F.col("vec_id").alias("place"), "vec_id", "embedding")
    found = pairing.rows_by_place(manifest, source, "source_row_id", "place", "vec_id", "embedding", dim)
    return found.select("vec_id", "label", F.size("embedding").alias("dim"))


RESPONSES = """parts as (select p_partkey, p_size, case when p_size % 3 = 0 then 'smooth' when p_size % 3 = 1 then 'featured-or-disk' else 'artifact' end as shape, case when p_size % 4 = 0 then 'round' when p_size % 4 = 1 then 'in-between' else 'not-mentioned' end as roundness,
  case when p_size % 5 = 0 then 'none' when p_size % 5 = 1 then 'merger' else 'not-mentioned' end as merging, case when p_size % 2 = 0 then 'edge-on-yes' else 'not-mentioned' end as edge from part)"""


def responses(spark: SparkSession, d: str) -> DataFrame:
    """Nested responses: by size smooth, featured or artifacts; sizes above 45 have text behind, those above 40 a number for an answer."""
    n = F.col("p_size")
    shape = F.when(n % 3 == 0, "smooth").when(n % 3 == 1, "featured-or-disk").otherwise("artifact")
    roundness = F.when(n % 4 == 0, "round").when(n % 4 == 1, "in-between").otherwise("not-mentioned")
    merging = F.when(n % 5 == 0, "none").when(n % 5 == 1, "merger").otherwise("not-mentioned")
    orientation = F.when(n % 2 == 0, F.lit('{"edge_on":"edge-on-yes","edge_on_bulge":"boxy"}')).otherwise(F.lit('{"edge_on":"not-mentioned"}'))
    rest = F.when(shape == "smooth", F.concat(F.lit(',"roundness":'), F.when(n > 40, F.lit("3")).otherwise(F.concat(F.lit('"'), roundness, F.lit('"'))), F.lit(',"merging":"'), merging, F.lit('"')))
    rest = rest.when(shape == "featured-or-disk", F.concat(F.lit(',"orientation":'), orientation, F.lit(',"merging":"'), merging, F.lit('"'))).otherwise("")
    whole = F.concat(F.lit('{"classification":{"overall_shape":"'), shape, F.lit('"'), rest, F.lit("}}"), F.when(n > 45, " and so on").otherwise(""))
    return table(spark, d, "part").select("p_partkey", whole.alias("response"))


@query(f"""with {RESPONSES} select p_partkey, case when p_size > 45 then 'no_json' when p_size > 40 and shape = 'smooth' then 'roundness' end as fault,
  case when p_size > 40 and (p_size > 45 or shape = 'smooth') then null else 'smooth-or-featured_' || shape || case shape when 'artifact' then '' when 'smooth' then case when roundness = 'not-mentioned' then ';how-rounded-not-mentioned' else ';how-rounded_' || roundness end
    else case when edge = 'edge-on-yes' then ';disk-edge-on_yes;edge-on-bulge_boxy' else ';disk-edge-on-not-mentioned' end end || case when shape = 'artifact' then '' when merging = 'not-mentioned' then ';merging-not-mentioned' else ';merging_' || merging end end as path from parts""")
def nested_judge_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = responses(spark, d).select("p_partkey", morphology.nested_fault(F.col("response")).alias("fault"), morphology.nested(F.col("response")).alias("tree"))
    return rows.select("p_partkey", "fault", F.when(F.col("fault").isNull(), F.array_join(morphology.path(F.col("tree")), ";")).alias("path"))


@query(f"""with {RESPONSES} select p_partkey, shape as shape_answer, case when shape = 'smooth' and roundness = 'not-mentioned' then 'not-stated' when shape = 'smooth' then roundness else 'not-applicable' end as rounded_answer,
  case when shape <> 'featured-or-disk' then 'not-applicable' when edge = 'edge-on-yes' then 'yes' else 'not-stated' end as edge_answer from parts where not (p_size > 45 or p_size > 40 and shape = 'smooth')""")
def nested_judge_answers(spark: SparkSession, d: str) -> DataFrame:
    good = responses(spark, d).where(morphology.nested_fault(F.col("response")).isNull())
    rows = good.select("p_partkey", bound(morphology.nested(F.col("response")), morphology.answers).alias("a"))
    return rows.select("p_partkey", *[F.col("a")[q].alias(n) for q, n in (("smooth-or-featured", "shape_answer"), ("how-rounded", "rounded_answer"), ("disk-edge-on", "edge_answer"))])


@query("select p_partkey, case p_size % 4 when 0 then null when 1 then 'spiral_arm_count' when 2 then 'no_json' else 'bar' end as fault from part")
def strict_judge_faults(spark: SparkSession, d: str) -> DataFrame:
    kinds = ['{"overall_shape":"smooth","roundness":"round"}', '{"overall_shape":"smooth","spiral_arm_count":2}', '{"overall_shape":"smooth"} trailing', '{"overall_shape":"artifact","bar":"very"}']
    response = F.get(F.array(*map(F.lit, kinds)), F.col("p_size") % 4)
    return table(spark, d, "part").select("p_partkey", morphology.fault(response).alias("fault"))


@query(f"""with v as (select p_partkey, (p_partkey * 37 % 100) / 100.0::double as featured, (p_partkey * 61 % 100) / 100.0::double as spiral from part), t as (select p_partkey, case when featured >= 0.7 and spiral >= 0.7 then 0 when featured >= 0.7 then 1 end as tier from v)
  select p_partkey, tier, cast(row_number() over (order by tier, sha256('priority|' || p_partkey || '|3'), p_partkey) as integer) as priority_rank from t where tier is not null""")
def priority_list(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    share = lambda m: (k * m % 100).cast("double") / 100.0
    spiral, featured = scores.path_flag(share(37), share(61), threshold=0.7), scores.path_flag(share(37), threshold=0.7)
    tier = F.when(spiral, 0).when(featured, 1)
    rows = table(spark, d, "part").select("p_partkey", tier.alias("tier"), hashing.selection_key("priority", k, 3).alias("h"), F.lit(0).alias("all")).where("tier is not null")
    return order.ranked(rows, ["all"], F.col("tier") * 256 + order.hex_bucket(F.col("h")), [F.col("tier"), F.col("h"), k], "priority_rank").select("p_partkey", "tier", "priority_rank")


@query("select o_orderkey, round(case when o_custkey % 3 = 0 then o_totalprice / 1e6 else (o_custkey * 0.4 + o_orderkey * 1.6) / 1e6 end, 9) + 0.0 as cost from orders")
def usage_cost(spark: SparkSession, d: str) -> DataFrame:
    reported = F.when(F.col("o_custkey") % 3 == 0, F.col("o_totalprice") / 1e6)
    return table(spark, d, "orders").select("o_orderkey", (F.round(scores.cost(reported, F.col("o_custkey"), F.col("o_orderkey"), (0.4, 1.6)), 9) + 0.0).alias("cost"))


@query("select 'returned' as name, 0.5::double as target, (select round(avg(case when l_returnflag = 'R' then 1.0::double else 0.0 end), 3) from lineitem) as value, false as passed union all select 'lines', 4.0, (select round(max(l_linenumber)::double, 3) from lineitem), false union all select 'absent', 1.0, null, false")
def reference_gate(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").agg(F.avg((F.col("l_returnflag") == "R").cast("double")).alias("returned"), F.max("l_linenumber").cast("double").alias("lines"))
    metrics = li.select(F.explode(F.create_map(F.lit("returned"), F.col("returned"), F.lit("lines"), F.col("lines"))).alias("name", "value"))
    return validation.gate(metrics, "name", F.col("value"), {"returned": 0.5, "lines": 4.0, "absent": 1.0})


CACHED = f"""cached as (select p_partkey, split_seed, encoder, p_retailprice / 1000 as z, p_retailprice / 1000 + case encoder when 'image_only' then (p_partkey % 7) / 20.0::double else (p_partkey % 5) / 40.0::double end as p from part cross join (select unnest([0, 1]) as split_seed) s cross join (select unnest(['image_only', 'spectrum_only']) as encoder) where {FRACTION.format("p_partkey || '|' || s.split_seed")} >= 0.5)"""


@query(f"""with {CACHED}, two as (select p_partkey, split_seed, encoder as condition, z, exp(-greatest(1.2 - p, p - 1.5, 0.0::double) / ((1.5 - 1.2) / 2)) as s from cached union all select distinct p_partkey, split_seed, 'oracle', z, case when z >= 1.2 and z < 1.5 then 1.0 else 0.0 end from cached),
  r as (select condition, split_seed, z >= 1.2 and z < 1.5 as hit, row_number() over (partition by condition, split_seed order by round(s, 6) desc, p_partkey) as r from two)
  select condition, split_seed, count(*) as n, count(*) filter (hit) as positives, round(count(*) filter (hit and r <= 10) / least(10, count(*)), 6) as precision from r group by all""")
def cached_distance_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Cached predictions ranked by how near they lie to an interval, without a fit, beside an oracle."""
    part = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") / 1000).alias("z"), F.explode(F.array(F.lit(0), F.lit(1))).alias("split_seed"))
    splits = part.withColumn("split", F.when(hashing.fraction(F.col("p_partkey"), F.col("split_seed").cast("string")) < 0.5, "train").otherwise("test"))
    test = splits.where("split = 'test'")
    off = {"image_only": (F.col("p_partkey") % 7) / 20.0, "spectrum_only": (F.col("p_partkey") % 5) / 40.0}
    said = F.explode(F.array(*[F.struct(F.lit(k).alias("encoder"), (F.col("z") + v).alias("p")) for k, v in off.items()])).alias("c")
    cached = validation.held_out_predictions(test.select("p_partkey", "split_seed", "z", said).select("p_partkey", "split_seed", "z", "c.*"), splits, "p_partkey", "encoder", "split_seed")
    hit = scores.in_interval(F.col("z"), 1.2, 1.5)
    rows = cached.select("p_partkey", "split_seed", F.col("encoder").alias("condition"), hit.alias("hit"), r6(scores.interval_score(F.col("p"), 1.2, 1.5)).alias("score"))
    oracle = test.select("p_partkey", "split_seed", F.lit("oracle").alias("condition"), hit.alias("hit"), hit.cast("double").alias("score"))
    rows = rows.unionByName(oracle).withColumn("graded", F.col("hit").cast("double"))
    return retrieval.group_metrics(rows, ["condition", "split_seed"], "p_partkey", "graded", "hit", 10).select("condition", "split_seed", "n", "positives", "precision")


@query("select conv_id, case when turn = 0 then 'canonical' else 'paraphrase_' || turn end as variant, replace('Say <slot> again', '<slot>', role) as prompt from conversations where turn = 0")
def canonical_prompts(spark: SparkSession, d: str) -> DataFrame:
    variant = F.when(F.col("turn") == 0, "canonical").otherwise(F.concat(F.lit("paraphrase_"), F.col("turn").cast("string")))
    rows = table(spark, d, "conversations").select("conv_id", variant.alias("variant"), text.filled("Say <slot> again", "<slot>", F.col("role")).alias("prompt"))
    return rows.where("variant = 'canonical'")


@query(r"select conv_id, turn, nullif(regexp_replace(text, '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g'), '') as caption, case when regexp_replace(text, '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g') = '' then 0 else len(regexp_split_to_array(regexp_replace(text, '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g'), '[\x09-\x0D\x20]+')) end::integer as words from conversations")
def restored_captions(spark: SparkSession, d: str) -> DataFrame:
    caption, words = text.restored(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", caption.alias("caption"), words.alias("words"))


@query("select p_partkey, (row_number() over (order by p_partkey) - 1)::bigint as benchmark_row from part where p_size > 10")
def frozen_row_index(spark: SparkSession, d: str) -> DataFrame:
    return tables.indexed(table(spark, d, "part").where("p_size > 10").select("p_partkey"), "p_partkey", "benchmark_row")


@query("select n_nationkey, n_name from nation")
def counted_table(spark: SparkSession, d: str) -> DataFrame:
    return validation.require_rows(table(spark, d, "nation").select("n_nationkey", "n_name"), 25, named=(F.col("n_name").isNotNull(), 25))


def split_embeddings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings").withColumns({"split": hashing.split(F.col("vec_id"), 5, 0.7), "fold": hashing.fold(F.col("vec_id"), 3, 5), "value": F.col("label").cast("double")})
    return e.where("split = 'train'"), e.where("split = 'validation'")


@query()
def probe_suite(spark: SparkSession, d: str) -> DataFrame:
    """Ridge, logistic and kNN probes on the same split; no SQL form, each is tested against a closed form or brute force."""
    train, test = split_embeddings(spark, d)
    return probes.probe_suite(train, test, "vec_id", "embedding", "value", "label", "fold", [0.1, 1.0, 10.0], [0.1, 1.0], 5, "given", "v1", 5)


def modalities(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    half = e.select(F.size("embedding").alias("n")).first().n // 2
    parts = {"image_only": list(range(half)), "spectrum_only": list(range(half, 2 * half)), "image_plus_spectrum": list(range(2 * half))}
    return probes.modality_comparison(e, "vec_id", "embedding", "label", parts, [0, 1], 0.7, 4, [0.1, 1.0, 10.0, 100.0])


@query()
def modality_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Ridge on either half of the vectors and on both; no SQL form, tested against closed solutions."""
    return modalities(spark, d).withColumn("y_pred_numeric", r6(F.col("y_pred_numeric")))


@query()
def modality_readout(spark: SparkSession, d: str) -> DataFrame:
    """Seed means of each condition's errors, beside whether its alpha ever lay at an end of the grid."""
    rows = modalities(spark, d)
    edges = probes.alpha_edges(rows, [0.1, 1.0, 10.0, 100.0]).groupBy("encoder").agg(F.bool_or(F.col("at_grid_min") | F.col("at_grid_max")).alias("alpha_at_edge"))
    return stats.seed_metrics(rows, ["encoder"], "split_seed", "y_pred_numeric", "y_true_numeric", 0.15).join(edges, "encoder")
