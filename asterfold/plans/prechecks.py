"""Queries of the checks before a large run: a wider grid of penalties on cached vectors, and how far a catalog's labels cover pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from asterfold.functions import scores
from asterfold.operators import prechecks, validation
from asterfold.plans.queries import FRACTION, PLACES, RADIUS, query, skies, table
from asterfold.plans.readouts import boot_sql

SEEDS, RATIO, FOLDS, SAMPLES, DRAW = [0, 1, 2], 0.7, 4, 50, 17
BEFORE, AFTER = [0.1, 1.0, 10.0, 100.0], [0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0]
PARTS = {"image_only": [0], "spectrum_only": [1], "image_plus_spectrum": [0, 1]}
CONTRASTS = {"fusion_vs_image": ("image_only", "image_plus_spectrum"), "fusion_vs_spectrum": ("spectrum_only", "image_plus_spectrum")}

# Ridge on one or two standardized features in closed form.
FITS = f"""rows as (select vec_id, split_seed, embedding[1]::double as x1, embedding[2]::double as x2, label::double as y, {FRACTION.format("vec_id || '|' || split_seed")} < {RATIO} as train,
    floor({FRACTION.format("vec_id || '|fold-' || split_seed")} * {FOLDS})::integer as fold from embeddings cross join (select unnest({SEEDS}) as split_seed) s),
  sums as (select split_seed, held, count(*)::double as n, avg(x1) as m1, avg(x2) as m2, avg(y) as my, stddev_pop(x1) as d1, stddev_pop(x2) as d2, covar_pop(x1, x2) as c12, covar_pop(x1, y) as c1y, covar_pop(x2, y) as c2y
    from rows join (select unnest(generate_series(-1, {FOLDS - 1})) as held) h on train and fold <> held group by all),
  solved as (select split_seed, held, encoder, alpha, m1, m2, my, n * c12 / (d1 * d2) as c, n * c1y / d1 as t1, n * c2y / d2 as t2, n + alpha as g, d1, d2 from sums cross join (select unnest({AFTER})::double as alpha) a cross join (select unnest({list(PARTS)}) as encoder) e),
  weights as (select *, case encoder when 'image_only' then t1 / g when 'image_plus_spectrum' then (g * t1 - c * t2) / (g * g - c * c) else 0 end / d1 as w1,
    case encoder when 'spectrum_only' then t2 / g when 'image_plus_spectrum' then (g * t2 - c * t1) / (g * g - c * c) else 0 end / d2 as w2 from solved),
  trials as (select w.split_seed, held, encoder, alpha, avg(abs(my + w1 * (x1 - m1) + w2 * (x2 - m2) - y)) as off from weights w join rows r on r.split_seed = w.split_seed and train and fold = held group by all),
  scored as (select split_seed, encoder, alpha, round(avg(off), 12) as off from trials group by all),
  grids as (select 'before' as grid, unnest({BEFORE})::double as alpha union all select 'after', unnest({AFTER})::double),
  chosen as (select grid, split_seed, encoder, alpha from scored join grids using (alpha) qualify row_number() over (partition by grid, split_seed, encoder order by off, alpha) = 1)"""

CHANGES = f"""{FITS}, said as (select grid, vec_id, w.split_seed, encoder, y, abs(my + w1 * (x1 - m1) + w2 * (x2 - m2) - y) as e from chosen join weights w using (split_seed, encoder, alpha) join rows r on r.split_seed = w.split_seed and not train where held = -1),
  per as (select vec_id, split_seed, grid, comparison, scale, (avg(e) filter (encoder = base) - avg(e) filter (encoder = 'image_plus_spectrum')) / any_value(case scale when 'absolute' then 1 else 1 + y end) as less from said
    cross join (values ('fusion_vs_image', 'image_only'), ('fusion_vs_spectrum', 'spectrum_only')) c(comparison, base) cross join (select unnest({list(prechecks.SCALES)}) as scale) s group by all),
  sides as (select vec_id, grid, comparison, scale, avg(less) as total from per group by all),
  objects as (select *, 1 as weight from sides union all select vec_id, 'change', comparison, scale, sum(case grid when 'after' then total else -total end), 1 from sides group by all),
  found as (with {boot_sql('vec_id', DRAW, SAMPLES, 'grid, comparison, scale')}),
  wide as (select comparison, scale, max(objects) as objects, {', '.join(f"max({c}) filter (grid = '{g}') as {n}" for g in ('before', 'after', 'change') for c, n in (('estimate', g), ('ci_low', f'{g}_low'), ('ci_high', f'{g}_high')))} from found group by all)"""


def decided(side: str) -> str:
    return f"case when {side}_low > 0 then 'improves' when {side}_high < 0 then 'worsens' else 'undecided' end"


def sensitivity(spark: SparkSession, d: str) -> prechecks.Sensitivity:
    e = table(spark, d, "embeddings")
    given = {n: validation.fingerprint(e.select(F.col("vec_id").alias("object_id"), F.array(*[F.col("embedding")[x] for x in dims]).alias("vector"))).first().asDict() for n, dims in PARTS.items()}
    narrow = e.select("vec_id", "label", F.slice("embedding", 1, 2).alias("embedding"))
    return prechecks.alpha_sensitivity(narrow, "vec_id", "embedding", "label", PARTS, CONTRASTS, SEEDS, RATIO, FOLDS, BEFORE, AFTER, SAMPLES, DRAW, given)


@query(f"with {FITS} select grid, encoder, split_seed, alpha as hyperparameter_value, alpha = 0.1 as at_grid_min, alpha = case grid when 'before' then {max(BEFORE)} else {max(AFTER)} end as at_grid_max from chosen")
def alpha_selection(spark: SparkSession, d: str) -> DataFrame:
    """The alpha that each condition and seed picks of either grid; its two features have a closed form in SQL."""
    return sensitivity(spark, d).selection


@query(f"with {CHANGES} select *, (select count(*) from chosen where grid = 'after' and alpha = {max(AFTER)}) as selected_at_new_max, {decided('before')} as decision_before, {decided('after')} as decision_after, {decided('before')} = {decided('after')} as holds from wide")
def alpha_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Contrasts of the fused condition before and after the wider grid, and their change, from shared resamples."""
    return sensitivity(spark, d).contrasts


EDGES = [0.05, 0.1, 0.35, 0.36, 0.9]
LABELS = ("featured", "spiral")
MATCHED = f"""{PLACES}, best as (select c_custkey, s_suppkey, separation_arcsec from near qualify row_number() over (partition by c_custkey order by separation_arcsec, s_suppkey) = 1),
  every as (select c_custkey, s_suppkey, separation_arcsec, (c_custkey * 7919 % 1000) / 1000.0::double as z, coalesce(s_suppkey * 37 % 100 >= 60, false) as featured, coalesce(s_suppkey * 37 % 100 >= 60 and s_suppkey * 61 % 100 >= 60, false) as spiral from cu left join best using (c_custkey))"""


def audit(spark: SparkSession, d: str) -> prechecks.CoverageAudit:
    c, s, on = skies(spark, d)
    share = lambda m: (F.col("s_suppkey") * m % 100).cast("double") / 100.0
    pairs = c.select("c_custkey", "c_ra", "c_dec", ((F.col("c_custkey") * 7919 % 1000).cast("double") / 1000.0).alias("z"))
    labels: dict[str, Column] = {"featured": scores.path_flag(share(37), threshold=0.6), "spiral": scores.path_flag(share(37), share(61), threshold=0.6)}
    return prechecks.coverage_audit(pairs, s, RADIUS, on, "c_custkey", "s_suppkey", "z", labels, EDGES, expected_pairs=c.count(), catalog_print=validation.fingerprint(s).first().asDict(), shared=True)


@query(f"""with {MATCHED} select label, n as positive_objects, round(coalesce(n / nullif(met, 0), 0), 6) as fraction_of_matches, round(coalesce(n / nullif(total, 0), 0), 6) as fraction_of_all_pairs
  from (select count(*) as total, count(s_suppkey) as met, count(*) filter (featured) as f, count(*) filter (spiral) as s from every) cross join lateral (select 'featured' as label, f as n union all select 'spiral', s)""")
def audit_label_counts(spark: SparkSession, d: str) -> DataFrame:
    """Labels of customers' nearest suppliers, as shares of those matched and of all."""
    return audit(spark, d).counts


@query(f"""with {MATCHED}, edges(low, high) as (values {', '.join(f'({a}::double, {b}::double)' for a, b in zip(EDGES, EDGES[1:], strict=False))}),
  binned as (select low, high, count(c_custkey) as total_objects, count(s_suppkey) as matched_objects, count(*) filter (featured) as f, count(*) filter (spiral) as s from edges left join every on z >= low and z < high group by all)
  select low, high, total_objects, matched_objects, round(coalesce(matched_objects / nullif(total_objects, 0), 0), 6) as match_fraction, label, n as positive_objects from binned cross join lateral (select 'featured' as label, f as n union all select 'spiral', s)""")
def audit_label_crosstab(spark: SparkSession, d: str) -> DataFrame:
    """The same within unequal intervals, which leave out some of both ends."""
    return audit(spark, d).crosstab


@query(f"""with {MATCHED} select count(*) as total_pairs, count(s_suppkey) as matched_pairs, count(*) filter (z < {EDGES[0]} or z >= {EDGES[-1]}) as pairs_outside_bins, count(s_suppkey) filter (z < {EDGES[0]} or z >= {EDGES[-1]}) as matched_outside_bins,
  max(separation_arcsec) as separation_max, (select count(*) from (select 1 from every where s_suppkey is not null group by s_suppkey having count(*) > 1)) as shared_assignments,
  round(quantile_cont(separation_arcsec, 0.5), 6) + 0.0 as separation_median, round(quantile_cont(separation_arcsec, 0.95), 6) + 0.0 as separation_p95, round(coalesce(count(s_suppkey) / nullif(count(*), 0), 0), 6) as coverage_fraction from every""")
def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    return audit(spark, d).summary


@query(f"with {MATCHED} select c_custkey, z from every where s_suppkey is null")
def audit_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return audit(spark, d).unmatched.select("c_custkey", "z")
