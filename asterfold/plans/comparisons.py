"""More queries over the driver's tables: comparisons of two sides, cells, judges' answers, spectra-like vectors, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from asterfold.functions import morphology, scores, text, vectors
from asterfold.operators import audits, cells, order, population, retrieval, sphere, stats, validation
from asterfold.operators.stats import r6
from asterfold.plans.queries import BOOT, JOINT, PLACES, RADIUS, SQL, manifest_build, place, query, skies, table, votes
from asterfold.sources.scratch import staged

@query(f"with m as ({SQL['manifest_build']}) select count(*) filter (benchmark_exclusion and split in ('train', 'validation')) as leaked, count(*) filter (split not in ('train', 'validation', 'excluded')) as unknown_split, count(*) filter (image_embedding_version is null) as no_version from m")
def leakage_check(spark: SparkSession, d: str) -> DataFrame:
    rules = {
        "leaked": F.col("benchmark_exclusion") & F.col("split").isin("train", "validation"), "unknown_split": ~F.col("split").isin("train", "validation", "excluded"),
        "no_version": F.col("image_embedding_version").isNull(),
    }
    return validation.violations(manifest_build(spark, d), rules)


@query("with s as (select p_brand, p_partkey, round(exp(-greatest(1200 - p_retailprice, p_retailprice - 1500, 0.0::double) / 150), 6) + 0.0 as score from part) select *, cast(row_number() over (partition by p_brand order by score desc, p_partkey) as integer) as rank from s")
def interval_score_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_brand", "p_partkey", r6(scores.interval_score(F.col("p_retailprice").cast("double"), 1200.0, 1500.0)).alias("score"))
    return retrieval.ranked(rows, ["p_brand"], "p_partkey")


ERRORS = "e as (select l_orderkey, l_returnflag, l_linestatus, l_linenumber, cast(l_extendedprice as double) / 10000 as t, cast(l_quantity as double) * 0.15 as p from lineitem)"


def errors(spark: SparkSession, d: str) -> DataFrame:
    t, p = F.col("l_extendedprice").cast("double") / 10000, F.col("l_quantity").cast("double") * 0.15
    return table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber", t.alias("t"), p.alias("p"))


@query(f"with {ERRORS}, s as (select l_returnflag, l_linenumber, avg(abs(p - t)) as mae from e group by all) select l_returnflag, count(mae) as n, round(avg(mae), 6) + 0.0 as mean, round(stddev_pop(mae), 6) + 0.0 as std, round(min(mae), 6) + 0.0 as min, round(max(mae), 6) + 0.0 as max from s group by 1")
def pooled_summary(spark: SparkSession, d: str) -> DataFrame:
    """Line numbers as seeds: 1 to 4 reused, 3 and later new; a seed on both sides counts once."""
    mae = errors(spark, d).groupBy("l_returnflag", "l_linenumber").agg(F.avg(F.abs(F.col("p") - F.col("t"))).alias("mae"))
    return stats.pooled(mae.where("l_linenumber <= 4"), mae.where("l_linenumber >= 3"), ["l_returnflag"], "l_linenumber", "mae")


@query(f"""with {ERRORS}, s as (select l_returnflag, l_linestatus, l_linenumber, round(avg(abs(p - t)), 6) + 0.0 as mae, round(1 - sum((p - t) * (p - t)) / (count(*) * nullif(var_pop(t), 0)), 6) + 0.0 as r2,
    round(avg(case when abs((p - t) / (1 + t)) > 0.15 then 1.0 else 0.0 end), 6) + 0.0 as o from e group by all)
  select l_returnflag, l_linestatus, count(*) as seeds, round(avg(mae), 6) + 0.0 as mae_mean, round(stddev_pop(mae), 6) + 0.0 as mae_std, round(avg(r2), 6) + 0.0 as r2_mean, round(stddev_pop(r2), 6) + 0.0 as r2_std,
    round(avg(o), 6) + 0.0 as outlier_fraction_mean, round(stddev_pop(o), 6) + 0.0 as outlier_fraction_std from s group by all""")
def metrics_from_predictions(spark: SparkSession, d: str) -> DataFrame:
    return stats.seed_metrics(errors(spark, d), ["l_returnflag", "l_linestatus"], "l_linenumber", "p", "t", 0.15)


@query(f"with objects as (select p_partkey as user_id, p_retailprice as total, 1 as weight from part), {BOOT}")
def bootstrap_mean_ci(spark: SparkSession, d: str) -> DataFrame:
    return stats.bootstrap(table(spark, d, "part").withColumn("weight", F.lit(1)), "p_partkey", "p_retailprice", "weight", 100, 9)


BOTH = f"""{ERRORS}, both_sides as (select l_orderkey, l_linenumber, unnest(['absolute', 'one_plus_z']) as scale, unnest([abs(p - t) - abs((p + t) / 2 - t) * 1.5, (abs(p - t) - abs((p + t) / 2 - t) * 1.5) / (1 + t)]) as less from e),
per as (select l_orderkey, l_linenumber, scale, avg(less) as less from both_sides group by all),
objects as (select l_orderkey as user_id, scale, avg(less) as total, 1 as weight from per group by all)"""


@query(f"""with {BOTH}, {BOOT[:BOOT.index('  select round(')].replace('select resample, sum', 'select scale, resample, sum').replace('group by resample', 'group by scale, resample')},
  ci as (select scale, round(quantile_cont(m, 0.025), 6) + 0.0 as ci_low, round(quantile_cont(m, 0.975), 6) + 0.0 as ci_high from means group by scale)
  select ci.*, round(avg(total), 6) + 0.0 as estimate, count(*) as objects, case when ci_low > 0 then 'improves' when ci_high < 0 then 'worsens' else 'undecided' end as decision from ci join objects using (scale) group by all""")
def paired_error_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """The quantity's guess against a guess halfway to the truth whose error counts one and a half times."""
    e = errors(spark, d)
    halfway = F.col("t") + F.abs((F.col("p") + F.col("t")) / 2 - F.col("t")) * 1.5
    kinds = F.explode(F.array(F.struct(F.lit("image").alias("condition"), F.col("p").alias("guess")), F.struct(F.lit("fusion").alias("condition"), halfway.alias("guess"))))
    long = e.select("l_orderkey", "l_linenumber", "t", kinds.alias("k")).select("l_orderkey", "l_linenumber", "t", "k.condition", "k.guess")
    return stats.paired_errors(long, "l_orderkey", "l_linenumber", "condition", "image", "fusion", "guess", "t", 100, 9)


@query(f"""with r as (select p_partkey, (case when (p_size > 25) = (p_size > 20) then 1 else 0 end) - (case when (p_size > 25) = (p_size > 40) then 1 else 0 end) + 1 - (case when p_partkey % 3 = 0 then 0 else 1 end) as diff from part),
  objects as (select p_partkey as user_id, diff::double as total, 2 as weight from r), {BOOT}""")
def paired_audit_delta(spark: SparkSession, d: str) -> DataFrame:
    """Two judges of a part's size class and brand; one misjudges the brand of every third part."""
    size = lambda t: F.when(F.col("p_size") > t, "large").otherwise("small")
    part = table(spark, d, "part")

    def judged(threshold: int, brand: Column) -> DataFrame:
        gold = part.select("p_partkey", F.create_map(F.lit("size"), size(25), F.lit("brand"), F.col("p_brand")).alias("gold_map"))
        said = part.select("p_partkey", F.create_map(F.lit("size"), size(threshold), F.lit("brand"), brand).alias("said_map"))
        return audits.answer_rows(gold, said, "p_partkey", "gold_map", "said_map")

    wrong = F.when(F.col("p_partkey") % 3 == 0, "another").otherwise(F.col("p_brand"))
    return audits.paired_delta(judged(20, F.col("p_brand")), judged(40, wrong), "p_partkey", 100, 9)


@query(f"with {PLACES}, q as (select c_mktsegment, unnest([0.0, 0.5, 0.9, 0.99, 1.0]::double[]) as quantile, unnest(quantile_cont(separation_arcsec, [0.0, 0.5, 0.9, 0.99, 1.0])) as value from near group by c_mktsegment) select c_mktsegment, quantile, round(value, 3) + 0.0 as separation from q")
def separation_quantiles(spark: SparkSession, d: str) -> DataFrame:
    c, s, on = skies(spark, d)
    found = stats.quantiles(sphere.pairs_within(c, s, RADIUS, on), ["c_mktsegment"], "separation_arcsec", [0.0, 0.5, 0.9, 0.99, 1.0])
    return found.select("c_mktsegment", "quantile", (F.round("value", 3) + 0.0).alias("separation"))


@query(f"""with {JOINT}, q(query, lo, hi, least) as (values ('cheap', 900.0::double, 950.0::double, 0.2::double), ('middle', 925, 975, 0.4), ('dear', 975, 2500, 0.3))
  select query, count(*) as targets, round(avg(strength), 6) + 0.0 as mean_strength from q join points on p_retailprice >= lo and p_retailprice < hi and strength >= least group by query""")
def query_targets(spark: SparkSession, d: str) -> DataFrame:
    rows = votes(spark, d).withColumn("strength", scores.path_strength(F.col("featured"), F.col("spiral")))
    found = retrieval.query_targets(rows, [("cheap", 900, 950, 0.2), ("middle", 925, 975, 0.4), ("dear", 975, 2500, 0.3)], F.col("p_retailprice").cast("double"), F.col("strength"))
    return found.groupBy("query").agg(F.count("*").alias("targets"), r6(F.avg("strength")).alias("mean_strength"))


@query("select vec_id, len(embedding)::integer as dim, case when vec_id % 2 = 0 then 'base' else 'new' end as cache from embeddings where label < 5")
def assembled_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    every = retrieval.assembled(e.where("label < 5").select("vec_id"), e.where("vec_id % 2 = 0"), e.where("vec_id % 2 <> 0"), "vec_id", "embedding")
    return every.select("vec_id", F.size("embedding").alias("dim"), F.when(F.col("vec_id") % 2 == 0, "base").otherwise("new").alias("cache"))


@query("select doc_id from documents intersect select doc_id from labels intersect select vec_id from embeddings")
def common_three_way(spark: SparkSession, d: str) -> DataFrame:
    return population.common_ids(table(spark, d, "documents"), table(spark, d, "labels"), table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), key="doc_id")


@query("select vec_id, list_bool_and([abs(x::double - round(x::double, 3)) <= 4.95e-4::double for x in embedding]) as close from embeddings")
def vectors_close(spark: SparkSession, d: str) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", vectors.all_close(e, F.transform(e, lambda x: F.round(x, 3)), 0.0, 4.95e-4).alias("close"))


@query("""with v as (select vec_id, [x::double for x in embedding] as f from embeddings),
  m as (select vec_id, [ {'x': f[k], 'm': list_sort([f[greatest(1, least(64, j))] for j in range(k - 2, k + 3)])[3]} for k in range(1, 65)] as r from v)
  select vec_id, round(list_sum([ln(greatest(case when y.m > 0 then y.x / y.m else 1 end, 0.001::double)) for y in r]), 6) + 0.0 as log_flux from m""")
def continuum_log_flux(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", r6(vectors.total(vectors.continuum_log(F.col("embedding"), 5))).alias("log_flux"))


@query("""with v as (select vec_id, [x::double for x in embedding] as f from embeddings)
  select vec_id, round(list_sum([f[k] + (f[k + 1] - f[k]) * 0.25 for k in range(1, 64)]) + f[64], 6) + 0.0 as resampled from v""")
def spectrum_resample(spark: SparkSession, d: str) -> DataFrame:
    """Every pixel moved a quarter of a step to the right; the last lies beyond the end and stays flat."""
    wave = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: k.cast("double"))
    moved = vectors.resampled(F.col("embedding"), wave, F.transform(wave, lambda w: w + 0.25))
    return table(spark, d, "embeddings").select("vec_id", r6(vectors.total(moved)).alias("resampled"))


@query(r"select conv_id, turn, sha256(regexp_replace(text, '[\x09-\x0D\x20]+$', '')) as stripped from conversations")
def trailing_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Replies end in special tokens, in some number; what is left hashes as the text without them."""
    marked = F.concat("text", F.element_at(F.array(F.lit("<eos>"), F.lit(" <end_of_turn>\n<eos>"), F.lit("  "), F.lit("")), (F.col("turn") % 4 + 1).cast("int")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2(text.without_trailing(marked, ["<eos>", "<end_of_turn>"]), 256).alias("stripped"))


@query("""with r as (select user_id, event_id, sum(value) over (partition by user_id order by event_id rows unbounded preceding) as running from events)
  select user_id, event_id, round(running, 4) + 0.0 as running from r where running > 200 qualify row_number() over (partition by user_id order by event_id) = 1""")
def cost_cap(spark: SparkSession, d: str) -> DataFrame:
    return stats.passes_cap(table(spark, d, "events"), ["user_id"], "event_id", "value", 200.0).withColumn("running", F.round("running", 4) + 0.0)


@query("select l_orderkey, count(*) as n from lineitem group by 1 having count(*) >= 6")
def truncation_guard(spark: SparkSession, d: str) -> DataFrame:
    return stats.at_cap(table(spark, d, "lineitem"), ["l_orderkey"], 6)


@query("""with g as (select f as l_returnflag, s as l_linestatus, k::integer as l_linenumber from (select unnest(['A', 'N', 'R', 'X']) as f) cross join (select unnest(['F', 'O']) as s) cross join (select unnest(range(1, 8)) as k)),
  c as (select l_returnflag, l_linestatus, l_linenumber, count(*) as n from lineitem group by all) select g.*, coalesce(n, 0) as n from g left join c using (l_returnflag, l_linestatus, l_linenumber)""")
def condition_grid(spark: SparkSession, d: str) -> DataFrame:
    return stats.grid_counts(table(spark, d, "lineitem"), {"l_returnflag": ["A", "N", "R", "X"], "l_linestatus": ["F", "O"], "l_linenumber": list(range(1, 8))})


@query(r"""with w as (select lang, case when regexp_replace(text, '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g') = '' then 0 else len(regexp_split_to_array(regexp_replace(text, '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g'), '[\x09-\x0D\x20]+')) end as n from documents)
  select lang, round(avg(n), 6) + 0.0 as mean, median(n)::double as median, max(n)::integer as max from w group by lang""")
def word_stats(spark: SparkSession, d: str) -> DataFrame:
    n = staged(table(spark, d, "documents").select("lang", text.word_count(F.col("text")).alias("n")), "words")  # texts are split once
    middle = order.quantiles(n, ["lang"], "n", [0.5]).select("lang", F.col("value").alias("median"))
    return n.groupBy("lang").agg(r6(F.avg("n")).alias("mean"), F.max("n").alias("max")).join(order.small(middle), "lang").select("lang", "mean", "median", "max")


@query("select c_custkey::varchar as object_id, c_mktsegment as survey, round((c_custkey * 137.508::double) % 360, 6) + 0.0 as ra, round((c_custkey % 1800) / 10.0::double - 90, 6) + 0.0 as dec, c_custkey::bigint as source_row_id from customer")
def normalized_source(spark: SparkSession, d: str) -> DataFrame:
    ra, dec = place("c_custkey")
    columns = {"object_id": F.col("c_custkey"), "survey": F.col("c_mktsegment"), "ra": ra, "dec": dec, "source_row_id": F.col("c_custkey")}
    return population.normalize_source(table(spark, d, "customer"), columns).withColumns({"ra": r6(F.col("ra")), "dec": r6(F.col("dec"))})


@query("""with geo as (select c_custkey, sin(radians((c_custkey % 1800) / 10.0::double - 90)) as z, ((c_custkey * 137.508::double) % 360) / 90 as turn from customer),
  dg as (select *, floor(8 * (0.5 + turn - 0.75 * z))::bigint as d, floor(8 * (0.5 + turn + 0.75 * z))::bigint as u, least(floor(turn), 3)::bigint as c, 8 * sqrt(3 * (1 - abs(z))) as reach from geo),
  ab as (select *, least(floor((turn - c) * reach), 7)::bigint as a, least(floor((c + 1 - turn) * reach), 7)::bigint as b, abs(z) <= 2.0::double / 3 as belt from dg),
  f as (select c_custkey, case when belt then case when d // 8 = u // 8 then (d // 8) % 4 + 4 when d // 8 < u // 8 then d // 8 else u // 8 + 8 end when z > 0 then c else c + 8 end as face,
    case when belt then u % 8 when z > 0 then 7 - b else a end as x, case when belt then 7 - d % 8 when z > 0 then 7 - a else b end as y from ab),
  p as (select c_custkey, face * 64 + (x & 1) + 2 * (y & 1) + 4 * ((x >> 1) & 1) + 8 * ((y >> 1) & 1) + 16 * ((x >> 2) & 1) + 32 * ((y >> 2) & 1) as pixel from f)
  select c_custkey, case when n > 20 then 3 else 1 end as cell_order, case when n > 20 then pixel else pixel // 16 end as cell_pixel from (select *, count(*) over (partition by pixel // 16) as n from p)""")
def sky_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Customers' places in leaves of order 1, or 3 where more than 20 lie in one of order 1."""
    c, _, on = skies(spark, d)
    return cells.assign_leaves(c, cells.adaptive_leaves(c, F.col(on[0]), F.col(on[1]), 1, 3, 20), on[0], on[1]).select("c_custkey", "cell_order", "cell_pixel")


# A judge's answers for a part, by arithmetic on its key: the field, its answers (none at times, two of them no answers at all), the divisor.
SAID = (
    ("overall_shape", ("smooth", "featured-or-disk", "featured-or-disk", "artifact", "odd"), 1), ("roundness", ("round", "in-between", "cigar-shaped", "not-mentioned", None), 5),
    ("edge_on", ("edge-on-yes", "edge-on-no", "edge-on-no", "not-mentioned", None), 7), ("edge_on_bulge", ("boxy", "none", "rounded", "not-mentioned", None), 11),
    ("has_spiral_arms", ("has-spiral-arms-yes", "has-spiral-arms-yes", "has-spiral-arms-no", "not-mentioned", None), 3), ("spiral_winding", ("tight", "medium", "loose", "not-mentioned", None), 13),
    ("spiral_arm_count", ("1", "2", "more-than-4", "not-mentioned", None), 2), ("bar", ("strong", "weak", "no", "not-mentioned", None), 17),
    ("bulge_size", ("dominant", "small", "none", "not-mentioned", None), 19), ("merging", ("none", "minor-disturbance", "merger", "not-mentioned", "later"), 4),
)
JUDGED = "judged as (select p_partkey, " + ", ".join(f"([{', '.join('null' if v is None else repr(v) for v in values)}])[(p_partkey // {by}) % 5 + 1] as {name}" for name, values, by in SAID) + " from part), good as (select * from judged where overall_shape <> 'odd' and merging <> 'later')"


def judged(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), (F.floor(F.col("p_partkey") / by) % 5).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.to_json(F.struct(*[pick(values, by).alias(name) for name, values, by in SAID])).alias("response"))


@query(f"with {JUDGED} select coalesce(nullif(concat_ws(';', case when overall_shape = 'odd' then 'overall_shape' end, case when merging = 'later' then 'merging' end), ''), 'none') as fault, count(*) as n from judged group by 1")
def judge_faults(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).groupBy(F.coalesce(morphology.fault(F.col("response")), F.lit("none")).alias("fault")).agg(F.count("*").alias("n"))


def _node(question: str, field: str, on: str) -> str:
    return f"case when {on} then case when {field} = 'not-mentioned' then '{question}-not-mentioned' else '{question}_' || replace(replace({field}, 'has-spiral-arms-', ''), 'edge-on-', '') end end"


ON = (
    ("smooth-or-featured", "overall_shape", "true"), ("how-rounded", "roundness", "overall_shape = 'smooth'"), ("disk-edge-on", "edge_on", "overall_shape = 'featured-or-disk'"),
    ("edge-on-bulge", "edge_on_bulge", "overall_shape = 'featured-or-disk' and edge_on = 'edge-on-yes'"), ("has-spiral-arms", "has_spiral_arms", "overall_shape = 'featured-or-disk' and edge_on = 'edge-on-no'"),
    ("spiral-winding", "spiral_winding", "overall_shape = 'featured-or-disk' and edge_on = 'edge-on-no' and has_spiral_arms = 'has-spiral-arms-yes'"),
    ("spiral-arm-count", "spiral_arm_count", "overall_shape = 'featured-or-disk' and edge_on = 'edge-on-no' and has_spiral_arms = 'has-spiral-arms-yes'"),
    ("bar", "bar", "overall_shape = 'featured-or-disk' and edge_on = 'edge-on-no'"), ("bulge-size", "bulge_size", "overall_shape = 'featured-or-disk' and edge_on = 'edge-on-no'"), ("merging", "merging", "overall_shape <> 'artifact'"),
)


@query(f"with {JUDGED} select p_partkey, concat_ws(';', {', '.join(_node(*x) for x in ON)}) as path from good")
def judge_paths(spark: SparkSession, d: str) -> DataFrame:
    good = judged(spark, d).where(morphology.fault(F.col("response")).isNull())
    return good.select("p_partkey", F.array_join(morphology.path(morphology.parsed(F.col("response"))), ";").alias("path"))


ANSWERED = " union all ".join(f"select '{q}' as question, case when {on} then case when coalesce({f}, 'not-mentioned') = 'not-mentioned' then 'not-stated' else replace(replace({f}, 'has-spiral-arms-', ''), 'edge-on-', '') end else 'not-applicable' end as answer from good" for q, f, on in ON)


@query(f"with {JUDGED}, a as ({ANSWERED}) select question, answer, count(*) as n from a group by all")
def judge_answers(spark: SparkSession, d: str) -> DataFrame:
    good = judged(spark, d).where(morphology.fault(F.col("response")).isNull())
    return good.select(F.explode(morphology.answers(morphology.parsed(F.col("response")))).alias("question", "answer")).groupBy("question", "answer").agg(F.count("*").alias("n"))
