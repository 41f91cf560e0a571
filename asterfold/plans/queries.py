"""Queries over the driver's tables: each operator on its stand-in columns, and its DuckDB SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from asterfold.functions import hashing, scores, text, vectors
from asterfold.operators import audits, bins, order, population, probes, retrieval, sphere, stats, validation
from asterfold.operators.stats import r6

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Every 20th vector is a query against all others.
SCORED = """scored as (
  select q.vec_id as query_id, c.vec_id, c.label, case when q.label = c.label then 1 else 0 end as rel,
    round(list_inner_product(cast(q.embedding as double[]), cast(c.embedding as double[])), 6) + 0.0 as score
  from embeddings q join embeddings c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0)"""


def nearest(spark: SparkSession, d: str, k: int, by: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The k best of each query (by `by`), and the counts of its positives: rows of its label less itself."""
    e = table(spark, d, "embeddings")
    e, part = (e.withColumn("fold", by), ["fold"]) if by is not None else (e, [])
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("query_label"), *[F.col(c).alias(f"own_{c}") for c in part])
    head = retrieval.top_scores(q, e, "query_id", "q", "vec_id", "embedding", k, ["label"], *part)
    known = head.join(F.broadcast(q.select("query_id", "query_label")) if q.count() <= 1_000_000 else q.select("query_id", "query_label"), "query_id")
    head = known.withColumn("rel", (F.col("label") == F.col("query_label")).cast("int")).drop("query_label")
    own = (F.col("own_fold") == F.col("fold")).cast("int") if part else F.lit(1)
    counts = e.groupBy("label", *part).agg(F.count("*").alias("n"))
    positives = q.join(counts, q.query_label == counts.label).select("query_id", *part, (F.col("n") - own).alias("positives"))
    return head, positives


NDCG = """ranked as (select *, row_number() over (partition by {by} order by score desc, vec_id) as r,
  row_number() over (partition by {by} order by rel desc, vec_id) as i from scored)
select {by}, round(coalesce(sum((power(2.0, rel) - 1) / log2(r + 1)) filter (r <= 10) / nullif(sum((power(2.0, rel) - 1) / log2(i + 1)) filter (i <= 10), 0), 0), 6) + 0.0 as ndcg_at_10
from ranked group by {by}"""


@query(f"with {SCORED}, {NDCG.format(by='query_id')}")
def vector_ndcg_at_10(spark: SparkSession, d: str) -> DataFrame:
    head, positives = nearest(spark, d, 10)
    return retrieval.top_ndcg(head, positives, ["query_id"], "rel", 10)


@query(f"with {SCORED} select query_id, vec_id, rel, score, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored qualify rank <= 10")
def vector_rank_topk(spark: SparkSession, d: str) -> DataFrame:
    return nearest(spark, d, 10)[0].select("query_id", "vec_id", "rel", "score", "rank")


@query(f"""with {SCORED}, ranked as (select query_id, rel, row_number() over (partition by query_id order by score desc, vec_id) as r from scored),
  firsts as (select query_id, min(r) filter (rel = 1) as f from ranked group by query_id)
  select k, round(avg(case when f <= k then 1.0 else 0.0 end), 6) as recall from firsts cross join (select unnest([1, 5, 10]) as k) group by k""")
def vector_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.recall(nearest(spark, d, 10)[0].withColumn("hit", F.col("rel") == 1), ["query_id"], "vec_id", "hit", [1, 5, 10])


FRACTION = "(('0x' || substr(sha256({0}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"


@query(f"with {SCORED.replace('scored as', 'base as')}, scored as (select *, cast(floor({FRACTION.format(chr(39).join(['vec_id || ', '|fold-7', '']))} * 10) as integer) as fold from base), {NDCG.format(by='query_id, fold')}")
def vector_fold_ndcg(spark: SparkSession, d: str) -> DataFrame:
    head, positives = nearest(spark, d, 10, hashing.fold(F.col("vec_id"), 10, 7))
    return retrieval.top_ndcg(head, positives, ["query_id", "fold"], "rel", 10)


@query(f"""with {SCORED}, near as (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from scored qualify r <= 5),
  votes as (select query_id, label, count(*) as n from near group by all)
  select query_id, arg_max(label, n * 1000 - label) as prediction from votes group by query_id""")
def knn_cosine_classify(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.vote(nearest(spark, d, 5)[0], ["query_id"], "label")


@query(f"""with {SCORED}, near as (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from scored qualify r <= 5)
  select query_id, round(avg(cast(label as double)), 6) + 0.0 as prediction from near group by query_id""")
def knn_cosine_regress(spark: SparkSession, d: str) -> DataFrame:
    return nearest(spark, d, 5)[0].groupBy("query_id").agg(r6(F.avg("label")).alias("prediction"))


@query(f"select o_orderkey, case when {FRACTION.format(chr(39).join(['o_orderkey || ', '|42', '']))} < 0.8 then 'train' else 'validation' end as split from orders")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", hashing.split(F.col("o_orderkey"), 42, 0.8).alias("split"))


@query("select c_custkey, c_name from customer order by sha256('smoke|' || c_custkey || '|7'), c_custkey limit 100")
def hash_sample_topn(spark: SparkSession, d: str) -> DataFrame:
    return hashing.sample(table(spark, d, "customer"), "c_custkey", 100, "smoke", 7).select("c_custkey", "c_name")


@query("select c_custkey, c_nationkey, cast((row_number() over (partition by c_nationkey order by sha256(c_custkey || '|fold-3'), c_custkey) - 1) % 5 as integer) as fold from customer")
def hash_kfold(spark: SparkSession, d: str) -> DataFrame:
    return hashing.exact_folds(table(spark, d, "customer"), "c_custkey", 5, 3, ["c_nationkey"]).select("c_custkey", "c_nationkey", "fold")


@query("""with o as (select c_custkey, c_nationkey, sha256(c_custkey || '|derange-5') as h from customer)
select c_custkey, c_nationkey, coalesce(lead(c_custkey) over w, first(c_custkey) over w) as partner from o window w as (partition by c_nationkey order by h, c_custkey)""")
def hash_derangement(spark: SparkSession, d: str) -> DataFrame:
    return hashing.derangement(table(spark, d, "customer"), "c_custkey", 5, ["c_nationkey"])


@query(f"with n as (select p_partkey, p_brand, round({FRACTION.format(chr(39).join(['', 'noise|', ' || p_partkey']))}, 6) as noise from part) select p_brand, p_partkey, noise, cast(row_number() over (partition by p_brand order by noise desc, p_partkey) as integer) as rank from n")
def hash_noise_rank(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_brand", "p_partkey", F.round(hashing.fraction("noise", F.col("p_partkey")), 6).alias("noise"))
    return order.ranked(p, ["p_brand"], F.floor((1 - F.col("noise")) * 256), [F.col("noise").desc(), F.col("p_partkey")], "rank")


EXCLUDED = "excluded as (select doc_id, string_agg(distinct reason, ';' order by reason) as reason from (select doc_id, 'toxic' as reason from labels where toxic = 1 union all select doc_id, 'low_quality' from labels where quality = 0) group by doc_id)"


def excluded(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "labels")
    return population.combine_exclusions(lab.where("toxic = 1").select("doc_id", F.lit("toxic").alias("reason")), lab.where("quality = 0").select("doc_id", F.lit("low_quality").alias("reason")), key="doc_id")


@query(f"with {EXCLUDED} select * from excluded")
def exclusion_reasons(spark: SparkSession, d: str) -> DataFrame:
    return excluded(spark, d)


@query(f"""with {EXCLUDED} select doc_id, source, coalesce(reason, '') as benchmark_exclusion_reason, reason is not null as benchmark_exclusion,
  case when reason is not null then 'excluded' when {FRACTION.format("doc_id || '|11'")} < 0.9 then 'train' else 'validation' end as split, cast(11 as integer) as split_seed, 'v1' as image_embedding_version
  from documents left join excluded using (doc_id)""")
def manifest_build(spark: SparkSession, d: str) -> DataFrame:
    return validation.no_leakage(population.build_manifest(table(spark, d, "documents").select("doc_id", "source"), excluded(spark, d), 11, 0.9, "v1", "doc_id"))


@query("select 'customers' as exclusion_set, l.doc_id as exclusion_id, case when c.c_custkey is null then 'absent' else 'matched' end as status, c.c_custkey as source_object_id, case when c.c_custkey is not null then cast(0 as double) end as separation_arcsec from labels l left join customer c on c.c_custkey = l.doc_id")
def exact_coverage(spark: SparkSession, d: str) -> DataFrame:
    return population.exact_coverage(table(spark, d, "customer").withColumnRenamed("c_custkey", "doc_id"), table(spark, d, "labels"), "customers", "doc_id")


@query("""with tagged as (select c_custkey, c_acctbal, case when s_suppkey is not null then 0 when c_acctbal > 9000 then 1 else 2 end as tier, sha256('pop|' || c_custkey || '|13') as h
    from customer left join supplier on s_suppkey = c_custkey and s_acctbal > 5000),
  top as (select *, case tier when 0 then 'anchor' when 1 then 'priority' else 'hash_fill' end as selection_reason from tagged order by tier, case when tier = 1 then -c_acctbal else 0 end, h, c_custkey limit (select count(*) // 3 from customer))
  select c_custkey, selection_reason, cast(row_number() over (order by h, c_custkey) - 1 as integer) as selection_rank from top""")
def population_anchor_priority_fill(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    anchors = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("c_custkey"))
    priorities = c.where("c_acctbal > 9000").select("c_custkey", (-F.col("c_acctbal")).alias("priority_rank"))
    return population.fill_population(c.select("c_custkey"), anchors, priorities, c.count() // 3, "pop", 13, "c_custkey")


PLACES = """cu as (select c_custkey, c_mktsegment, c_nationkey, radians((c_custkey * 137.508::double) % 360) as a, radians((c_custkey % 1800) / 10.0::double - 90) as e from customer),
su as (select s_suppkey, s_nationkey, s_acctbal, radians((s_suppkey * 137.508::double + 0.3) % 360) as a, radians((s_suppkey % 1800) / 10.0::double - 90) as e from supplier),
pairs as (select *, power(cos(cu.e) * cos(cu.a) - cos(su.e) * cos(su.a), 2) + power(cos(cu.e) * sin(cu.a) - cos(su.e) * sin(su.a), 2) + power(sin(cu.e) - sin(su.e), 2) as d2 from cu cross join su),
near as (select *, round(degrees(2 * asin(least(sqrt(d2) / 2, 1))) * 3600, 6) + 0.0 as separation_arcsec from pairs where d2 <= power(2 * sin(radians(2.0) / 2), 2))"""
RADIUS = 7200.0


def place(key: str, shift: float = 0.0) -> tuple[Column, Column]:
    k = F.col(key).cast("double")
    return (k * 137.508 + shift) % 360, (F.col(key) % 1800) / 10.0 - 90


def skies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, tuple[str, str, str, str]]:
    (a, b), (x, y) = place("c_custkey"), place("s_suppkey", 0.3)
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", a.alias("c_ra"), b.alias("c_dec"))
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal", x.alias("s_ra"), y.alias("s_dec"))
    return c, s, ("c_ra", "c_dec", "s_ra", "s_dec")


@query(f"with {PLACES} select c_custkey, s_suppkey, separation_arcsec from near qualify row_number() over (partition by c_custkey order by separation_arcsec, s_suppkey) = 1")
def sphere_nearest_within(spark: SparkSession, d: str) -> DataFrame:
    c, s, on = skies(spark, d)
    return sphere.nearest(c, s, RADIUS, on, "c_custkey", "s_suppkey").select("c_custkey", "s_suppkey", "separation_arcsec")


@query(f"with {PLACES} select c_custkey, s_suppkey, separation_arcsec, cast(row_number() over (partition by c_custkey order by separation_arcsec, s_suppkey) as integer) as candidate_rank from near qualify candidate_rank <= 8")
def sphere_knn8(spark: SparkSession, d: str) -> DataFrame:
    c, s, on = skies(spark, d)
    return sphere.nearest(c, s, RADIUS, on, "c_custkey", "s_suppkey", 8).select("c_custkey", "s_suppkey", "separation_arcsec", "candidate_rank")


@query(f"with {PLACES}, best as (select c_custkey, s_suppkey, separation_arcsec from near qualify row_number() over (partition by s_suppkey order by separation_arcsec, c_custkey) = 1) select s_suppkey, case when c_custkey is null then 'absent' else 'matched' end as status, c_custkey as source_object_id, separation_arcsec from su left join best using (s_suppkey)")
def sphere_coverage(spark: SparkSession, d: str) -> DataFrame:
    c, s, on = skies(spark, d)
    return sphere.coverage(s, c, RADIUS, (on[2], on[3], on[0], on[1]), "s_suppkey", "c_custkey")


@query(f"with {PLACES}, best as (select c_custkey, s_suppkey, separation_arcsec from near qualify row_number() over (partition by c_custkey order by separation_arcsec, s_suppkey) = 1) select * from best qualify row_number() over (partition by s_suppkey order by separation_arcsec, c_custkey) = 1")
def sphere_one_to_one(spark: SparkSession, d: str) -> DataFrame:
    return sphere.one_to_one(sphere_nearest_within(spark, d), "c_custkey", "s_suppkey")


@query(f"with {PLACES} select c_custkey, string_agg(distinct 'nation_' || s_nationkey, ';' order by 'nation_' || s_nationkey) as reason, min(separation_arcsec) as separation_arcsec from near group by c_custkey")
def sphere_exclusions(spark: SparkSession, d: str) -> DataFrame:
    c, s, on = skies(spark, d)
    named = s.withColumn("reason", F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string")))
    return sphere.exclusions(c, named, RADIUS, on, "c_custkey", "reason")


@query(f"""with {PLACES}, radii as (select unnest([1800.0::double, 3600.0, 7200.0]) as radius),
  per as (select radius, c_custkey, count(*) as n_any, count(*) filter (s_acctbal > 0) as n_valid from near join radii on separation_arcsec <= radius group by all),
  joined as (select radius, c_mktsegment, 'n' || c_nationkey as c_nationkey, coalesce(n_any, 0) as n_any, coalesce(n_valid, 0) as n_valid from cu cross join radii left join per using (radius, c_custkey)),
  cells as (select radius, c_mktsegment, c_nationkey, count(*) as sources, count(*) filter (n_any > 0) as any_match, count(*) filter (n_valid > 0) as valid_match, count(*) filter (n_valid > 1) as ambiguous, sum(n_valid)::bigint as valid_candidates,
    round(count(*) filter (n_valid > 0) / count(*), 6) as valid_fraction, grouping(c_mktsegment) + grouping(c_nationkey) = 2 as overall from joined group by grouping sets ((radius), (radius, c_mktsegment), (radius, c_nationkey))),
  chosen as (select radius, s_suppkey, count(*) as n from (select radius, c_custkey, s_suppkey from near join radii on separation_arcsec <= radius where s_acctbal > 0 qualify row_number() over (partition by radius, c_custkey order by separation_arcsec, s_suppkey) = 1) group by all),
  targets as (select radius, count(*) as selected_targets, count(*) filter (n > 1) as shared_targets from chosen group by radius)
  select radius, c_mktsegment, c_nationkey, sources, any_match, valid_match, ambiguous, valid_fraction, case when overall then valid_candidates end as valid_candidates,
    case when overall then coalesce(selected_targets, 0) end as selected_targets, case when overall then coalesce(shared_targets, 0) end as shared_targets from cells left join targets using (radius)""")
def match_summary_by_radius(spark: SparkSession, d: str) -> DataFrame:
    c, s, on = skies(spark, d)
    c = c.withColumn("c_nationkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")))
    near = sphere.pairs_within(c, s, RADIUS, on).select("c_custkey", "s_suppkey", "separation_arcsec", (F.col("s_acctbal") > 0).alias("is_valid"))
    return sphere.match_summary(c, near, [1800.0, 3600.0, 7200.0], "c_custkey", "s_suppkey", "c_mktsegment", "c_nationkey")


REASONS = """reasons as (select l_orderkey, l_linenumber, l_partkey, l_extendedprice, concat_ws(';', case when l_linenumber > 5 then 'zwarn_not_zero' end,
  case when l_quantity < 5 then 'redshift_below_minimum' end, case when l_discount <= 0 then 'redshift_error_not_positive' end) as reason from lineitem)"""


def reasons(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    warn = F.when(F.col("l_linenumber") > 5, 4).otherwise(0)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", scores.spectrum_reasons(warn, F.col("l_quantity").cast("double"), F.col("l_discount").cast("double"), 5.0).alias("reason"))


@query(f"with {REASONS} select reason, count(*) as n from reasons group by reason")
def quality_reasons(spark: SparkSession, d: str) -> DataFrame:
    return reasons(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""with {REASONS} select l_orderkey, l_linenumber, reason, cast(row_number() over w as integer) as candidate_rank,
  case when reason = '' then cast(sum(case when reason = '' then 1 else 0 end) over (w rows unbounded preceding) as integer) end as valid_candidate_rank
  from reasons window w as (partition by l_orderkey order by l_extendedprice, l_linenumber)""")
def candidate_ranks(spark: SparkSession, d: str) -> DataFrame:
    w = "over (partition by l_orderkey order by l_extendedprice, l_linenumber rows unbounded preceding)"
    rows = reasons(spark, d)
    return rows.select("l_orderkey", "l_linenumber", "reason", F.expr(f"cast(row_number() {w} as int)").alias("candidate_rank"), F.expr(f"case when reason = '' then cast(sum(if(reason = '', 1, 0)) {w} as int) end").alias("valid_candidate_rank"))


@query(f"with {REASONS} select l_orderkey, l_linenumber, l_partkey from reasons where reason = '' qualify row_number() over (partition by l_orderkey order by l_extendedprice, l_linenumber) = 1")
def nearest_valid(spark: SparkSession, d: str) -> DataFrame:
    rows = reasons(spark, d).where("reason = ''")
    return rows.withColumn("r", F.expr("row_number() over (partition by l_orderkey order by l_extendedprice, l_linenumber)")).where("r = 1").select("l_orderkey", "l_linenumber", "l_partkey")


# Vote-like shares of a part: two hashes of its key by multiplication, NaN for sizes divisible by ten.
VOTES = "votes as (select p_partkey, p_brand, p_retailprice, case when p_size % 10 = 0 then 'NaN'::double else (p_partkey * 37 % 100) / 100.0::double end as featured, (p_partkey * 61 % 100) / 100.0::double as spiral, (p_partkey * 13 % 100) / 100.0::double as bar from part)"


def votes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    share = lambda m: (k * m % 100).cast("double") / 100.0
    return table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice", F.when(F.col("p_size") % 10 == 0, float("nan")).otherwise(share(37)).alias("featured"), share(61).alias("spiral"), share(13).alias("bar"))


FLAGS = "flags as (select *, not isnan(featured) and featured >= 0.6 as f, not isnan(featured) and featured >= 0.6 and spiral >= 0.6 as s, not isnan(featured) and featured >= 0.6 and spiral >= 0.6 and bar >= 0.6 as b from votes)"


def flags(spark: SparkSession, d: str) -> DataFrame:
    f, s, b = (F.col(c) for c in ("featured", "spiral", "bar"))
    return votes(spark, d).withColumns({"f": scores.path_flag(f, threshold=0.6), "s": scores.path_flag(f, s, threshold=0.6), "b": scores.path_flag(f, s, b, threshold=0.6)})


@query(f"with {VOTES}, {FLAGS} select p_partkey, f as reliable_featured, s as reliable_spiral, b as reliable_bar from flags")
def path_gated_flags(spark: SparkSession, d: str) -> DataFrame:
    return flags(spark, d).select("p_partkey", F.col("f").alias("reliable_featured"), F.col("s").alias("reliable_spiral"), F.col("b").alias("reliable_bar"))


@query(f"with {VOTES}, {FLAGS} select case when b then 'bar' when s then 'spiral' when f then 'featured' end as tier, count(*) as n from flags group by 1")
def tier_assignment(spark: SparkSession, d: str) -> DataFrame:
    tier = scores.first_tier(("bar", F.col("b")), ("spiral", F.col("s")), ("featured", F.col("f")))
    return flags(spark, d).groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


@query(f"""with {VOTES}, {FLAGS}, edges(lo, hi) as (values (900.0::double, 1200.0::double), (1200.0, 1500.0), (1500.0, 1800.0), (1800.0, 2100.0), (2100.0, 9999.0))
  select lo, hi, count(p_partkey) as total, count(*) filter (f) as featured, count(*) filter (s) as spiral, count(*) filter (b) as bar from edges left join flags on p_retailprice >= lo and p_retailprice < hi group by lo, hi""")
def coverage_crosstab(spark: SparkSession, d: str) -> DataFrame:
    edges = spark.createDataFrame([(900.0, 1200.0), (1200.0, 1500.0), (1500.0, 1800.0), (1800.0, 2100.0), (2100.0, 9999.0)], "lo double, hi double")
    return bins.counted(flags(spark, d), "p_retailprice", edges, "lo", "hi", ["lo", "hi"], total=F.lit(1), featured=F.col("f"), spiral=F.col("s"), bar=F.col("b"))


JOINT = f"""{VOTES}, points as (select *, greatest(0, least(1, least(case when isnan(featured) then 0 else featured end, spiral))) as strength, exp(-greatest(1200 - p_retailprice, p_retailprice - 1500, 0.0::double) / 150) as closeness from votes),
scored as (select p_brand, p_partkey, round(strength * closeness, 6) + 0.0 as score, strength, case when p_retailprice >= 1200 and p_retailprice < 1500 and strength >= 0.6 then 1 else 0 end as rel from points)"""


def joint(spark: SparkSession, d: str) -> DataFrame:
    strength, price = scores.path_strength(F.col("featured"), F.col("spiral")), F.col("p_retailprice").cast("double")
    rows = votes(spark, d).withColumn("strength", strength)
    return rows.select("p_brand", "p_partkey", r6(F.col("strength") * scores.interval_score(price, 1200.0, 1500.0)).alias("score"), "strength", (scores.in_interval(price, 1200.0, 1500.0) & (F.col("strength") >= 0.6)).cast("int").alias("rel"))


@query(f"with {JOINT} select p_brand, p_partkey, score, cast(row_number() over (partition by p_brand order by score desc, p_partkey) as integer) as rank from scored")
def joint_score_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = joint(spark, d).select("p_brand", "p_partkey", "score", (-F.col("score")).alias("low"))
    return order.ranked_along(rows, ["p_brand"], [F.col("low"), F.col("p_partkey")], "rank").select("p_brand", "p_partkey", "score", "rank")


@query(f"""with {JOINT}, ranked as (select *, row_number() over (partition by p_brand order by score desc, p_partkey) as r, row_number() over (partition by p_brand order by rel desc, p_partkey) as i from scored),
  m as (select p_brand, count(*) as n, sum(rel)::bigint as positives, count(*) filter (rel = 1 and r <= 10) as hits, sum((power(2.0, rel) - 1) / log2(r + 1)) filter (r <= 10) as dcg, sum((power(2.0, rel) - 1) / log2(i + 1)) filter (i <= 10) as idcg from ranked group by p_brand)
  select p_brand, n, positives, round(hits / nullif(positives, 0), 6) as recall, round(least(10, positives) / nullif(positives, 0), 6) as recall_ceiling, round(hits / least(10, n), 6) as precision, round(coalesce(dcg / nullif(idcg, 0), 0), 6) + 0.0 as ndcg_at_10 from m""")
def population_readout(spark: SparkSession, d: str) -> DataFrame:
    rows = joint(spark, d).withColumn("hit", F.col("rel") == 1)
    return retrieval.group_metrics(rows, ["p_brand"], "p_partkey", "rel", "hit", 10)


@query(f"""with {JOINT}, noise as (select *, {FRACTION.format("'control|' || p_partkey")} as u from scored),
  two as (select p_brand, rel, row_number() over (partition by p_brand order by score desc, p_partkey) as r, row_number() over (partition by p_brand order by u desc, p_partkey) as c from noise)
  select p_brand, round(sum(rel) filter (r <= 10) / 10.0 - sum(rel) filter (c <= 10) / 10.0, 6) + 0.0 as precision_delta from two group by p_brand""")
def fusion_delta(spark: SparkSession, d: str) -> DataFrame:
    rows = joint(spark, d).withColumn("u", hashing.fraction("control", F.col("p_partkey")))
    both = retrieval.ranked(retrieval.ranked(rows, ["p_brand"], "p_partkey", "r"), ["p_brand"], "p_partkey", "c", "u")
    head = lambda c: F.sum(F.when(F.col(c) <= 10, F.col("rel"))) / 10.0
    return both.groupBy("p_brand").agg(r6(head("r") - head("c")).alias("precision_delta"))


# Predictions: the price that the quantity suggests.
PRED = "pred as (select l_returnflag, l_linestatus, cast(l_extendedprice as double) / 10000 as t, cast(l_quantity as double) * 0.15 as p from lineitem)"


def pred(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey", (F.col("l_extendedprice").cast("double") / 10000).alias("t"), (F.col("l_quantity").cast("double") * 0.15).alias("p"))


@query(f"with {PRED} select l_returnflag, count(*) as n, round(avg(abs(p - t)), 6) + 0.0 as mae, round(1 - sum((p - t) * (p - t)) / (count(*) * var_pop(t)), 6) + 0.0 as r2, round(avg(case when abs((p - t) / (1 + t)) > 0.15 then 1.0 else 0.0 end), 6) + 0.0 as outlier_fraction from pred group by 1")
def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    return stats.regression(pred(spark, d), ["l_returnflag"], "p", "t", 0.15)


@query(f"with {PRED}, r as (select l_returnflag, (p - t) / (1 + t) as x from pred), m as (select l_returnflag, median(x) as c from r group by 1) select l_returnflag, round(1.4826 * median(abs(x - c)), 6) + 0.0 as nmad from r join m using (l_returnflag) group by 1")
def nmad(spark: SparkSession, d: str) -> DataFrame:
    return stats.nmad(pred(spark, d).withColumn("x", stats.residual(F.col("p"), F.col("t"))), ["l_returnflag"], "x")


@query("with q as (select l_returnflag, unnest([0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]::double[]) as quantile, unnest(quantile_cont(l_extendedprice::double, [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0])) as value from lineitem group by 1) select l_returnflag, quantile, round(value, 6) + 0.0 as value from q")
def quantiles7(spark: SparkSession, d: str) -> DataFrame:
    return stats.quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0])


@query(f"with {PRED}, e as (select min(t) as lo, max(t) as hi from pred), b as (select least(cast(floor((t - lo) / (hi - lo) * 20) as integer), 19) as bin, count(*) as n from pred cross join e group by 1) select bin, coalesce(n, 0) as n from (select unnest(generate_series(0, 19))::integer as bin) left join b using (bin)")
def histogram20(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(pred(spark, d), "t", 20)


@query("""with s as (select quality as t, case when toxic = 1 then 0 else 1 end as p from labels), c as (select unnest([0, 1])::integer as label)
  select label, round(coalesce(tp / nullif(said, 0), 0), 6) + 0.0 as precision, round(coalesce(tp / nullif(support, 0), 0), 6) + 0.0 as recall, round(coalesce(2.0 * tp / nullif(said + support, 0), 0), 6) + 0.0 as f1, support
  from (select label, count(*) filter (p = label and t = label) as tp, count(*) filter (p = label) as said, count(*) filter (t = label) as support from s cross join c group by label) where said + support > 0""")
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").select(F.col("quality").alias("t"), F.when(F.col("toxic") == 1, 0).otherwise(1).alias("p"))
    return stats.report(rows, "p", "t")


@query("with c as (select p_brand, p_size, count(*) as n from part group by all) select p_brand, arg_max(p_size, n * 1000 - p_size) as majority from c group by p_brand")
def majority_baseline(spark: SparkSession, d: str) -> DataFrame:
    return stats.majority(table(spark, d, "part"), ["p_brand"], "p_size")


@query("select o_orderpriority, round(median(cast(o_totalprice as double)), 6) + 0.0 as prediction from orders group by 1")
def median_baseline(spark: SparkSession, d: str) -> DataFrame:
    return order.quantiles(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", [0.5]).select("o_orderpriority", r6(F.col("value")).alias("prediction"))


@query(f"""with {PRED.replace('l_returnflag,', 'l_orderkey, l_returnflag,')}, s as (select *, cast(floor({FRACTION.format("l_orderkey || '|fold-1'")} * 5) as integer) as seed from pred),
  m as (select l_returnflag, seed, avg(abs(p - t)) as mae from s group by all) select l_returnflag, count(mae) as n, round(avg(mae), 6) + 0.0 as mean, round(stddev_pop(mae), 6) + 0.0 as std, round(min(mae), 6) + 0.0 as min, round(max(mae), 6) + 0.0 as max from m group by 1""")
def seed_aggregate(spark: SparkSession, d: str) -> DataFrame:
    per = pred(spark, d).withColumn("seed", hashing.fold(F.col("l_orderkey"), 5, 1)).groupBy("l_returnflag", "seed").agg(F.avg(F.abs(F.col("p") - F.col("t"))).alias("mae"))
    return stats.summary(per, ["l_returnflag"], "mae")


BOOT = """draws as (select r.resample, o.*, ('0x' || substr(sha256(o.user_id || '|' || r.resample || '|bootstrap-9'), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 as u from objects o cross join (select unnest(generate_series(0, 99)) as resample) r),
  counted as (select *, case when u < 0.36787944117144233 then 0 when u < 0.73575888234288467 then 1 when u < 0.91969860292860584 then 2 when u < 0.98101184312384624 then 3 when u < 0.99634015317265634 then 4 when u < 0.9994058151824184 then 5 when u < 0.99991675885071201 then 6 when u < 0.99998975080332540 then 7 else 8 end as c from draws),
  means as (select resample, sum(c * total) / nullif(sum(c * weight), 0) as m from counted group by resample)
  select round(quantile_cont(m, 0.025), 6) + 0.0 as ci_low, round(quantile_cont(m, 0.975), 6) + 0.0 as ci_high, (select round(sum(total) / sum(weight), 6) + 0.0 from objects) as estimate, (select count(*) from objects) as objects from means"""


@query(f"with objects as (select user_id, sum(value) as total, count(*) as weight from events group by user_id), {BOOT}")
def cluster_bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    objects = table(spark, d, "events").groupBy("user_id").agg(F.sum("value").alias("total"), F.count("*").alias("weight"))
    return stats.bootstrap(objects, "user_id", "total", "weight", 100, 9)


@query(f"""with objects as (select user_id, avg(value) filter (event_id % 2 = 0) - avg(value) filter (event_id % 2 = 1) as total, 1 as weight from events group by user_id having count(*) filter (event_id % 2 = 0) > 0 and count(*) filter (event_id % 2 = 1) > 0), {BOOT}""")
def paired_bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    side = lambda k: F.avg(F.when(F.col("event_id") % 2 == k, F.col("value")))
    objects = table(spark, d, "events").groupBy("user_id").agg((side(0) - side(1)).alias("total"), F.lit(1).alias("weight")).where("total is not null")
    return stats.bootstrap(objects, "user_id", "total", "weight", 100, 9)


@query()
def ridge_cv_select(spark: SparkSession, d: str) -> DataFrame:
    """Ridge on the embeddings with alpha by cross-validation; no SQL form, tested against a closed solution."""
    e = table(spark, d, "embeddings").withColumns({"split": hashing.split(F.col("vec_id"), 5, 0.7), "fold": hashing.fold(F.col("vec_id"), 4, 5), "target": F.col("label").cast("double")})
    out = probes.ridge_probe(e.where("split = 'train'"), e.where("split = 'validation'"), "embedding", "target", "fold", [0.1, 1.0, 10.0, 100.0])
    return out.select("vec_id", "label", r6(F.col("prediction")).alias("prediction"), "alpha")


@query()
def pca_project(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return probes.pca(e, e, "embedding", 4).select("vec_id", "projection")


@query()
def logistic_classify(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("split", hashing.split(F.col("vec_id"), 5, 0.7))
    return probes.logistic_probe(e.where("split = 'train'"), e.where("split = 'validation'"), "embedding", "label", 1.0).select("vec_id", "label", F.col("prediction").cast("int").alias("prediction"))


TREES = """trees as (select p_partkey, p_size, p_brand, 'size_' || (case when p_size > 25 then 'large' else 'small' end) as h1, 'brand_' || p_brand as h2, 'size_' || (case when p_size > 20 then 'large' else 'small' end) as j1 from part)"""


def trees(spark: SparkSession, d: str) -> DataFrame:
    node = lambda q, a: F.struct(F.lit(None).cast("string").alias("node"), F.lit(q).alias("question"), a.alias("answer"))
    size = lambda t: F.when(F.col("p_size") > t, "large").otherwise("small")
    return table(spark, d, "part").select("p_partkey", F.to_json(F.array(node("size", size(25)), node("brand", F.col("p_brand")))).alias("human"), F.to_json(F.array(node("size", size(20)), node("brand", F.col("p_brand")))).alias("judge"))


@query(f"with {TREES} select p_partkey, cast(case when h1 = j1 then 2 else 1 end as integer) as matched_nodes, cast(2 as integer) as human_nodes, case when h1 = j1 then 1.0::double else 0.5 end as score from trees")
def json_path_overlap(spark: SparkSession, d: str) -> DataFrame:
    t = trees(spark, d)
    return audits.path_rows(t.select("p_partkey", "human"), t.select("p_partkey", "judge"), "p_partkey", "human", "judge").drop("human_path")


@query(f"""with {TREES}, rows as (select 'size' as question, (h1 = j1)::integer as ok from trees union all select 'brand', 1 from trees)
  select question, count(*) as n, round(avg(ok), 6) + 0.0 as accuracy, 0.0::double as abstention from rows group by grouping sets ((), (question))""")
def json_answer_audit(spark: SparkSession, d: str) -> DataFrame:
    t = trees(spark, d).select("p_partkey", text.tree_answers(F.col("human")).alias("gold"), text.tree_answers(F.col("judge")).alias("said"))
    return audits.audit_metrics(audits.answer_rows(t.select("p_partkey", "gold"), t.select("p_partkey", "said"), "p_partkey", "gold", "said"))


@query("""with e as (select o_custkey, count(*) as n_orders from orders where o_orderstatus = 'F' group by 1), o as (select o_custkey, count(*) as n_open from orders where o_orderstatus = 'O' group by 1)
  select o_custkey, n_orders, n_open, case when e.o_custkey is null then 'right_only' when o.o_custkey is null then 'left_only' else 'both' end as side from e full join o using (o_custkey)""")
def full_outer_indicator(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    count = lambda s, n: o.where(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.count("*").alias(n))
    return validation.paired(count("F", "n_orders"), count("O", "n_open"), ["o_custkey"])


@query("select c_custkey, c_nationkey, n_name from customer join nation on c_nationkey = n_nationkey where exists (select 1 from orders where o_custkey = c_custkey)")
def semi_common(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return c.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "n_name")


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def anti_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return population.resolve(table(spark, d, "customer"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").select("c_custkey", "c_name")


@query("select o_orderkey, o_custkey, o_orderpriority, c_mktsegment from orders join customer on c_custkey = o_custkey")
def one_to_one_guard(spark: SparkSession, d: str) -> DataFrame:
    c = validation.require_unique(table(spark, d, "customer"), "c_custkey").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    joined = table(spark, d, "orders").join(c, "o_custkey", "left")
    return validation.require(joined, {"no customer": F.col("c_mktsegment").isNull()}).select("o_orderkey", "o_custkey", "o_orderpriority", "c_mktsegment")


@query("with n as (select vec_id, embedding, list_inner_product(cast(embedding as double[]), cast(embedding as double[])) as q from embeddings) select vec_id, len(embedding)::integer as dim, round(sqrt(q), 5) + 0.0 as norm, abs(sqrt(q) - 1) <= 0.001 as normalized from n")
def cache_validate(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.size(e).alias("dim"), (F.round(vectors.norm(e), 5) + 0.0).alias("norm"), vectors.is_unit(e).alias("normalized"))


@query("""with x as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings), s as (select i, stddev_pop(x) as s, sum(x) as t, sum(x * x) as q, count(*) as n from x group by i)
  select round(avg(s), 6) + 0.0 as mean_std, round((sum(t * t) - sum(q)) / (max(n) * (max(n) - 1)), 6) + 0.0 as mean_similarity, avg(s) > 1e-4 and (sum(t * t) - sum(q)) / (max(n) * (max(n) - 1)) < 0.99 as noncollapsed from s""")
def collapse_check(spark: SparkSession, d: str) -> DataFrame:
    return stats.collapse_check(table(spark, d, "embeddings"), "embedding")


@query("""with h as (select ('0x' || substr(sha256(to_json({'o_custkey': o_custkey, 'o_orderkey': o_orderkey, 'o_orderpriority': o_orderpriority, 'o_orderstatus': o_orderstatus})::varchar), 1, 15))::ubigint::bigint as h from orders)
  select count(*) as n_rows, bit_xor(h) as xor_hash, sum(h)::varchar as sum_hash from h""")
def content_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return validation.fingerprint(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


@query("select doc_id, md5(text) as response from documents where length(trim(text)) > 0 and doc_id not in (select doc_id from labels)")
def resumable_generation(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents count as done: a resumed run generates for the others only."""
    from asterfold.streaming import generate

    todo = population.resolve(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")
    rows = generate.generated(todo, "doc_id", "text", lambda t: hashlib.md5(t.encode()).hexdigest())
    return rows.where("error is null").select("doc_id", "response")


@query("select event_type, user_id, round(sum(value) over (partition by event_type order by event_id rows unbounded preceding), 4) + 0.0 as running, event_id from events")
def running_totals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "user_id", "event_id", "value")
    return order.running_sum(e, ["event_type"], "event_id", "value", "running").select("event_type", "user_id", (F.round("running", 4) + 0.0).alias("running"), "event_id")


@query("select turn, role, count(*) as n, round(avg(len(string_split_regex(trim(text), '\\s+'))), 6) + 0.0 as mean_words from conversations where length(trim(text)) > 0 group by all")
def word_count_by_role(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").where(F.length(F.trim("text")) > 0)
    return c.groupBy("turn", "role").agg(F.count("*").alias("n"), r6(F.avg(text.word_count(F.col("text")))).alias("mean_words"))
