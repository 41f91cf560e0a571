"""Quality rules with host verdicts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from asterfold.llm.common import as_text, salted_join, staged
from asterfold.llm.secrets import bound

#: A host whose shrunk failure rate exceeds this fails as a whole.
HOST_LIMIT = 0.5
#: Words of a repeated window; the prior's weight in documents where all hosts fail alike.
WINDOW, FULL_WEIGHT = 8, 1000.0
#: Hosts that are broadcast at most (about 50 bytes each); more are joined by shuffle.
BROADCAST_HOSTS = 100_000

BLANK = "[\\x20\\x09-\\x0D]+"


def text_rules(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    blank = " \t\n\x0b\x0c\r"
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, blank, "")) > 0)
    words = F.filter(F.split(text, BLANK, -1), lambda w: w != "")

    def of(w: Column) -> Column:
        windows = F.when(F.size(w) < WINDOW, F.expr("cast(array() as array<bigint>)")).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (WINDOW - 1), F.lit(1))), lambda k: F.xxhash64(F.slice(w, k, WINDOW)))
        )
        return F.struct(F.size(w).cast("long").alias("n_words"), bound(windows, repeat_words).alias("n_repeat_words"))

    counted = bound(words, of)
    dup_lines = bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return bound(
        counted,
        lambda c: F.struct(
            c["n_words"].alias("n_words"),
            F.length(F.translate(text, blank, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            dup_lines.cast("long").alias("n_dup_lines"),
            c["n_repeat_words"].alias("n_repeat_words"),
        ),
    )


def repeat_words(windows: Column) -> Column:
    """Words that windows found twice or more cover: sorted by hash, equal ones are neighbours; their places overlap."""

    def covered(order: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(order, j)["h"] == x["h"], F.lit(False))
        twice = F.filter(order, lambda x, k: same(x, k - 1) | same(x, k + 1))
        places = F.array_sort(F.transform(twice, lambda x: x["at"]))
        step = lambda p: F.aggregate(p, F.expr("named_struct('end', 0L, 'n', 0L)"), lambda a, at: F.struct(
            (at.cast("long") + WINDOW).alias("end"), (a["n"] + WINDOW - F.greatest(a["end"] - at.cast("long"), F.lit(0).cast("long"))).alias("n")), lambda a: a["n"])
        return bound(places, step)

    order = F.array_sort(F.transform(windows, lambda h, k: F.struct(h.alias("h"), k.alias("at"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(bound(order, covered))


def failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def host_verdicts(rules: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """host, n_docs, n_failed, host_rate, host_failed. Rates shrink towards a beta prior by moments over the hosts.

    Of the hosts' rates with mean m and variance v the prior has weight m (1 - m) / v - 1 (at least 1, FULL_WEIGHT
    where v is 0), so a host of few documents stays near m.
    """
    hosts = rules.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    hosts = hosts.withColumn("raw", F.col("n_failed") / F.col("n_docs"))
    m, v = hosts.agg(F.avg("raw").alias("m"), F.var_pop("raw").alias("v")).select(F.coalesce(F.round("m", 9), F.lit(0.0)), F.coalesce(F.round("v", 12), F.lit(0.0))).first()
    weight = max(1.0, min(FULL_WEIGHT, m * (1 - m) / v - 1)) if v > 0 else FULL_WEIGHT
    rate = F.round((F.col("n_failed") + m * weight) / (F.col("n_docs") + weight), 6)
    return hosts.select("host", "n_docs", "n_failed", rate.alias("host_rate"), (rate > limit).alias("host_failed"))


def judge_documents(docs: DataFrame, host: Column | None = None, limit: float = HOST_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the rule counts, base_failed, host_rate, host_failed and kept.

    kept: the document passes the rules and its host's shrunk failure rate doesn't exceed the limit. Documents of a
    null host go by their own rules. Null texts have no words and fail. Null ids and repeated rows pass through.
    """
    host = F.col("source") if host is None else host
    rules = staged(docs.select(F.col(id_col).alias("doc_id"), host.cast("string").alias("host"), text_rules(as_text(docs, text_col)).alias("r")), "rules")
    rules = rules.select("doc_id", "host", "r.*").withColumn("base_failed", failed(F.col("n_words"), F.col("n_repeat_words")))
    verdicts = host_verdicts(rules, limit).select("host", "host_rate", "host_failed")
    if verdicts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        judged = rules.join(F.broadcast(verdicts), "host", "left")
    else:
        judged = salted_join(rules, verdicts, ["host"], "left", F.coalesce("doc_id", F.col("n_words")))
    bad = F.coalesce("host_failed", F.lit(False))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~bad).alias("kept"), "host_rate", bad.alias("host_failed"))


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: DuckDB SQL of op9.
SQL = r"""
with docs as (select row_number() over () as row, doc_id, source as host, coalesce(text, '') as text from documents),
words as (select row, doc_id, host, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from docs),
lines as (select row, list_filter(string_split(text, chr(10)), lambda x: length(translate(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0) as l from docs),
windows as (select row, unnest(generate_series(1, len(w) - 7)) as k, w from words where len(w) >= 8),
held as (select row, k, array_to_string(w[k:k+7], ' ') as x from windows),
twice as (select row, k from (select row, k, count(*) over (partition by row, x) as n from held) where n > 1),
covered as (select row, count(distinct k + d) as n_repeat_words from twice cross join (select unnest(generate_series(0, 7)) as d) group by row),
rules as (
  select row, doc_id, host, cast(len(w) as bigint) as n_words,
    cast(length(translate(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) as bigint) as word_chars,
    cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint) as n_symbols,
    cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from words join lines using (row) left join covered using (row)),
judged as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from rules),
hosts as (select host, count(*) as n, count(*) filter (base_failed) as f from judged where host is not null group by host),
moments as (select coalesce(round(avg(f / n), 9), 0) as m, coalesce(round(var_pop(f / n), 12), 0) as v from hosts),
prior as (select m, case when v > 0 then greatest(1.0, least(1000.0, m * (1 - m) / v - 1)) else 1000.0 end as weight from moments),
rated as (select host, round((f + m * weight) / (n + weight), 6) as host_rate from hosts cross join prior)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not coalesce(host_rate > 0.5, false) as kept, host_rate, coalesce(host_rate > 0.5, false) as host_failed
from judged left join rated using (host)
"""
