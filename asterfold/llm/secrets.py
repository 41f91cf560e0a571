"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from asterfold.llm.common import as_text, salted_join, staged

#: Patterns that the contract fixes, in the order of kinds; GENERIC is what ownership may add.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the contract's AKIA[A-Z0-9]+ of 18 characters: a run that starts later is shorter
HEX = r"[0-9a-f]{16,}"  # likewise
GENERIC = r"[A-Za-z0-9+/_-]{24,}"
KINDS = ("assign", "access", "hex", "generic")
ASSIGN_LEAST = 12
#: What a generic run needs to look like a credential: a digit, letters of either case, so many different characters,
#: and no word, which is so many letters of one case in a row.
DISTINCT, WORD = 12, r"[a-z]{7}|[A-Z]{7}"
#: A candidate that so many owners or so many repositories hold is a copied example; one that a single owner holds
#: in fewer repositories looks live.
COPIED_OWNERS, COPIED_REPOS = 3, 20

SPAN = "struct<start: int, kind: int, end: int, hash: string>"
#: Items that one fold goes through; longer arrays are folded chunk by chunk, so that the work is linear.
CHUNK = 128


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: a lambda's variable isn't inlined."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _grown(items: Column, of: Callable[[Column], Column], combine: Callable[[Column, Column], Column], start: Column) -> Column:
    """of() of all items before each item, and of all at the end, combined from `start` on. For short arrays."""
    step = lambda out, x: F.concat(out, F.array(combine(F.element_at(out, -1), of(x))))
    return F.aggregate(items, F.array(start), step)


def running(items: Column, of: Callable[[Column], Column], combine: Callable[[Column, Column], Column], start: Column) -> Column:
    """For each item, of() of all items before it combined, `start` for the first. Ints; `items` is a bound variable."""
    chunks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(CHUNK)), lambda at: F.slice(items, at, CHUNK))

    def of_chunks(own: Column) -> Column:
        totals = F.transform(own, lambda c: F.aggregate(c, start, lambda acc, x: combine(acc, of(x))))
        befores = _grown(totals, lambda t: t, combine, start)
        return bound(befores, lambda b: F.flatten(F.transform(own, lambda c, k: F.slice(_grown(c, of, combine, F.get(b, k)), 1, F.size(c)))))

    return F.when(F.size(items) > 0, bound(chunks, of_chunks)).otherwise(F.expr("cast(array() as array<int>)"))


def found_spans(text: Column, kind: int, pattern: str, secret_group: int, least: int = 0, accept: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches as spans (code points) with the SHA-256 of the secret, if its length and accept() allow.

    Places come from the lengths of the matches and of the pieces between them.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("match"), F.regexp_extract_all(text, F.lit(pattern), F.lit(secret_group)).alias("secret"))
    width = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["match"]), F.lit(0))

    def spans(every: Column) -> Column:
        placed = F.zip_with(every, running(every, width, lambda a, b: a + b, F.lit(0)), lambda x, at: F.struct(x["match"].alias("match"), x["secret"].alias("secret"), (at + F.length(x["gap"])).alias("start")))
        good = lambda x: (F.coalesce(F.length(x["secret"]), F.lit(-1)) >= least) & (F.lit(True) if accept is None else accept(x["secret"]))
        span = lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["match"])).alias("end"), F.sha2(x["secret"], 256).alias("hash"))
        return F.transform(F.filter(placed, good), span)

    return F.when(F.rlike(text, F.lit(pattern)), bound(parts, spans)).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def span_text(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined; spans are sorted."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def looks_random(run: Column) -> Column:
    """Whether a run looks like a credential and not like a word, a path or a rule."""
    mixed = F.rlike(run, F.lit("[0-9]")) & F.rlike(run, F.lit("[a-z]")) & F.rlike(run, F.lit("[A-Z]")) & ~F.rlike(run, F.lit(WORD))
    return mixed & (F.size(F.array_distinct(F.split(run, ""))) >= DISTINCT)


def generic_spans(text: Column) -> Column:
    return found_spans(text, 3, GENERIC, 0, 0, looks_random)


def apart(base: Column, runs: Column) -> Column:
    """The runs that no base span overlaps; both sorted. One pass forward for the furthest end before, one back for the next start."""
    far = 1 << 30

    def free(every: Column) -> Column:
        end = lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(F.lit(-1))
        start = lambda s: F.when(s["kind"] < 3, s["start"]).otherwise(F.lit(far))
        after = bound(F.reverse(every), lambda back: F.reverse(running(back, start, lambda a, b: F.least(a, b), F.lit(far))))
        near = F.arrays_zip(every.alias("s"), running(every, end, lambda a, b: F.greatest(a, b), F.lit(-1)).alias("before"), after.alias("after"))
        kept = F.filter(near, lambda x: (x["s"]["kind"] == 3) & (x["before"] <= x["s"]["start"]) & (x["after"] >= x["s"]["end"]))
        return F.transform(kept, lambda x: x["s"])

    return F.when((F.size(base) > 0) & (F.size(runs) > 0), bound(F.array_sort(F.concat(base, runs)), free)).otherwise(runs)


def candidates(docs: DataFrame, id_col: str, text_col: str, repo: Column, owner: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, repo, owner, base and generic spans of every whole text. Generic: runs that look random, off the base spans."""
    text = F.coalesce(as_text(docs, text_col), F.lit(""))
    base = F.array_sort(F.concat(found_spans(text, 0, ASSIGN, 2, ASSIGN_LEAST), found_spans(text, 1, ACCESS, 0), found_spans(text, 2, HEX, 0)))
    rows = docs.select(
        *[F.col(c) for c in carry],
        F.col(id_col).alias("__id"), repo.cast("string").alias("__repo"), owner.cast("string").alias("__owner"), base.alias("__base"), generic_spans(text).alias("__runs"),
    )
    return rows


def ownership(scanned: DataFrame, copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """hash, n_repos, n_owners, n_uses, verdict (live, shared, copied) of every candidate of the corpus."""
    each = scanned.select("__repo", "__owner", F.explode(F.concat("__base", "__runs")).alias("s")).select("__repo", "__owner", F.col("s.hash").alias("hash"))
    counted = each.groupBy("hash").agg(
        F.countDistinct(F.coalesce("__repo", F.lit(""))).alias("n_repos"), F.countDistinct(F.coalesce("__owner", F.lit(""))).alias("n_owners"), F.count("*").alias("n_uses")
    )
    verdict = F.when((F.col("n_owners") >= copied_owners) | (F.col("n_repos") >= copied_repos), "copied").when(F.col("n_owners") == 1, "live").otherwise("shared")
    return counted.withColumn("verdict", verdict)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None, owner: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, found.

    found holds every span (start, kind, end, verdict). A candidate that COPIED_OWNERS owners or COPIED_REPOS
    repositories hold is a copied example, else one that one owner alone holds is live. Base spans always stay;
    generic runs count only if they are live. Null texts are empty, null repositories and owners count as one, null
    ids pass through, repeated rows come back as often. Owners default to the `source` column; where no repository is
    named, each different text counts as one. `carry` columns of docs come along.
    """
    repo = F.xxhash64(F.coalesce(as_text(docs, text_col), F.lit(""))) if repo is None else repo
    owner = F.col("source") if owner is None else owner
    rows = candidates(docs, id_col, text_col, repo, owner, carry)
    scanned = staged(rows, "secrets").withColumn("__runs", apart(F.col("__base"), F.col("__runs")))
    counts = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("long")
    head = [*carry, F.col("__id").alias("doc_id"), counts(0).alias("n_assign"), counts(1).alias("n_access"), counts(2).alias("n_hex"), F.sha2(span_text(F.col("__base")), 256).alias("base_sha256")]
    clean = (F.size("__base") == 0) & (F.size("__runs") == 0)
    nothing = F.expr("cast(array() as array<struct<start: int, kind: int, end: int, verdict: string>>)")
    without = scanned.where(clean).select(*head, nothing.alias("found"))

    mine = F.concat("__base", "__runs")
    own_key = F.sha2(F.concat_ws("|", F.coalesce(F.col("__id").cast("string"), F.lit("")), F.to_json(F.struct(mine.alias("s"), F.col("__repo")))), 256)
    holding = scanned.where(~clean).withColumn("__key", own_key)
    each = holding.select("__key", F.explode(mine).alias("s")).select("__key", F.col("s.hash").alias("hash"), F.struct("s.start", "s.kind", "s.end").alias("s"))
    judged = salted_join(each, ownership(scanned).select("hash", "verdict"), ["hash"], "inner", F.col("__key"))
    held = judged.where((F.col("s.kind") < 3) | (F.col("verdict") == "live"))
    per = held.groupBy("__key").agg(F.array_sort(F.collect_set(F.struct("s.start", "s.kind", "s.end", "verdict"))).alias("found"))
    with_some = salted_join(holding, per, ["__key"], "left", F.monotonically_increasing_id()).select(*head, F.coalesce("found", nothing).alias("found"))
    number = lambda v: F.size(F.filter("found", lambda s: s["verdict"] == v)).cast("long")
    return without.unionByName(with_some).select(*carry, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", span_text(F.col("found")).alias("spans"), number("live").alias("n_live"), number("copied").alias("n_copied"), "found")


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with sorted spans (overlapping ones as one) replaced by the mask."""

    def cut(every: Column) -> Column:
        before = running(every, lambda s: s["end"], lambda a, b: F.greatest(a, b), F.lit(0))
        return F.filter(F.zip_with(every, before, lambda s, at: F.struct(at.alias("at"), s["start"].alias("start"))), lambda x: x["start"] >= x["at"])

    def pieces(gaps: Column) -> Column:
        """Each chunk's stretch of the text is cut out once, its gaps from that."""

        def of_chunk(c: Column) -> Column:
            low = F.get(c, F.lit(0))["at"]
            stretch = F.substring(text, low + 1, F.element_at(c, -1)["start"] - low)
            return bound(stretch, lambda t: F.transform(c, lambda g: F.concat(F.substring(t, g["at"] - low + 1, g["start"] - g["at"]), F.lit(mask))))

        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(gaps), F.lit(CHUNK)), lambda at: of_chunk(F.slice(gaps, at, CHUNK))))

    end = F.aggregate(spans, F.lit(0), lambda acc, s: F.greatest(acc, s["end"]))
    masked = F.concat(F.array_join(bound(bound(spans, cut), pieces), ""), F.substring(text, end + 1, F.length(text)))
    return F.when(F.size(spans) > 0, masked).otherwise(text)


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all found spans masked; other columns stay. Rows that share an id, null ids too, go by their own text."""
    same = F.xxhash64(docs[text_col])
    scanned = scan_secrets(docs.withColumn("__same", same), id_col, text_col, carry=("__same",)).where(F.size("found") > 0)
    found = scanned.select(F.col("doc_id").alias("__id"), F.col("__same").alias("__key"), F.col("found").alias("__found")).dropDuplicates(["__id", "__key"])
    keyed = docs.withColumn("__key", F.xxhash64(docs[id_col], same))
    small = found.select(F.xxhash64("__id", "__key").alias("__key"), "__found").dropDuplicates(["__key"])
    joined = salted_join(keyed, small, ["__key"], "left", F.monotonically_increasing_id())
    text = F.when(F.col("__found").isNull(), F.col(text_col)).otherwise(redact(F.col(text_col), F.col("__found")))
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("found")


#: DuckDB SQL of op1. Kinds are found with their own patterns; places are running sums over pieces and matches.
SQL = r"""
with docs as (select row_number() over () as row, doc_id, coalesce(source, '') as owner, coalesce(text, '') as text from documents),
kinds(kind, pattern, secret, least) as (values
  (0, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12),
  (1, 'AKIA[A-Z0-9]+', 0, 18), (2, '[0-9a-f]+', 0, 16), (3, '[A-Za-z0-9+/_-]+', 0, 24)),
cut as (
  select row, kind, least,
    case kind when 0 then regexp_extract_all(text, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0)
      when 1 then regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0) when 2 then regexp_extract_all(text, '[0-9a-f]+', 0) else regexp_extract_all(text, '[A-Za-z0-9+/_-]+', 0) end as m,
    case kind when 0 then regexp_extract_all(text, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)
      when 1 then regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0) when 2 then regexp_extract_all(text, '[0-9a-f]+', 0) else regexp_extract_all(text, '[A-Za-z0-9+/_-]+', 0) end as s,
    case kind when 0 then string_split_regex(text, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)')
      when 1 then string_split_regex(text, 'AKIA[A-Z0-9]+') when 2 then string_split_regex(text, '[0-9a-f]+') else string_split_regex(text, '[A-Za-z0-9+/_-]+') end as g
  from docs cross join kinds),
each as (select row, kind, least, unnest(m) as m, unnest(s) as s, unnest(g[1:len(m)]) as g, generate_subscripts(m, 1) as k from cut where len(m) > 0),
placed as (select *, cast(sum(length(g) + length(m)) over (partition by row, kind order by k) as bigint) as "end" from each),
base as (
  select row, kind, "end" - length(m) as start, "end", sha256(s) as hash, m from placed
  where length(s) >= least and (kind < 3 or regexp_matches(s, '[0-9]') and regexp_matches(s, '[a-z]') and regexp_matches(s, '[A-Z]')
    and not regexp_matches(s, '[a-z]{7}|[A-Z]{7}') and len(list_distinct(string_split(s, ''))) >= 12)),
cands as (
  select row, kind, start, "end", hash from base where kind < 3
  union all
  select row, kind, start, "end", hash from base g where kind = 3
    and not exists (select 1 from base b where b.row = g.row and b.kind < 3 and b.start < g."end" and g.start < b."end")),
owners as (select hash, count(distinct owner) as n, count(distinct text) as repos from cands join docs using (row) group by hash),
judged as (select c.*, case when n >= 3 or repos >= 20 then 'copied' when n = 1 then 'live' else 'shared' end as verdict from cands c join owners using (hash)),
held as (select * from judged where kind < 3 or verdict = 'live'),
named as (select *, (case kind when 0 then 'assign' when 1 then 'access' when 2 then 'hex' else 'generic' end) || ':' || start || ':' || "end" as name from held),
per as (
  select row, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
    coalesce(string_agg(name, ',' order by start, kind) filter (kind < 3), '') as base, string_agg(name, ',' order by start, kind) as spans,
    count(*) filter (verdict = 'live') as n_live, count(*) filter (verdict = 'copied') as n_copied
  from named group by row)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied
from docs left join per using (row)
"""
