"""Each operator applied to its whole table, with its production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_tree, fertility, filter_audit, line_crf, lm_scores, minhash, mixing, periodic_runs, phrase_dedup, pieces, secret_scan, suffix_dedup, url_filter
from .tables import importable, shared_folder, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: fn(importable(spark), sf_dir)
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def words_sha256(text):
    """SHA-256 of a text's words joined by one space."""
    joined = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.sha2(joined.cast("binary"), 256)


@query("op7_phrase_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = phrase_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", "n_factors", words_sha256(F.col("kept_text")).alias("kept_sha256"))


@query("op10_minhash_components")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op9_tokeniser_fertility")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judged(table(spark, sf_dir, "documents")).drop("text", "lang", "source", "n_chars")


@query("op4_capped_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: Sites whose pages are the list of query op5.
SPAM_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
_SPAM = rf"(^|[.])({'|'.join(SPAM_SITES)})[.]"

OP5_SQL = rf"""
with parts as (
  select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages),
canonical as (
  select *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') as canonical from parts),
listed as (select distinct canonical from canonical where regexp_matches(host, '{_SPAM}')),
ruled as (
  select page_id, host, path, canonical in (select canonical from listed) as listed,
    case when (host = 'example.org' or host like '%.example.org') and path like '/en/1%' then 'example.org/en/1'
         when (host = 'example.org' or host like '%.example.org') and path like '/es/%' then 'example.org/es/'
         when (host = 'com' or host like '%.com') and path like '/fr/%' then 'com/fr/'
         when (host = 'com' or host like '%.com') and path like '/de/%' then 'com/de/'
         when (host = 'org' or host like '%.org') and path like '/%' then 'org/' end as rule
  from canonical)
select page_id, host, path, rule, listed,
  case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
       when listed then 'block' else 'allow' end as verdict
from ruled
"""


@query("op5_url_filter", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    at, below = url_filter.host(F.col("url")), url_filter.path(F.col("url"))
    listed = pages.where(at.rlike(_SPAM)).select(url_filter.canonical(at, below).alias("url"))
    return url_filter.judged(pages, listed).drop("url")


@query("op6_sentencepiece")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = pieces.encoded(docs, decode=True)
    return back.select("doc_id", "n_tokens", "n_byte_tokens", F.xxhash64("ids").alias("ids_hash"), "parity",
                       F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


OP2_SQL = """
with whole as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from whole q join whole c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""


@query("op2_ball_tree", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").where(ball_tree.usable(F.col("embedding")))
    vectors = vectors.select("vec_id", ball_tree.quantised(F.col("embedding")).alias("vector"))
    return ball_tree.top_k(vectors, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))


@query("op3_line_crf")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = line_crf.train(docs, labels.where(~line_crf.held_out(F.col("doc_id"))))
    return line_crf.scored(docs, model).select("doc_id", line_crf.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_lines", "n_good_lines")


OP1_SQL = r"""
with words as (
  select rowid_ as doc, doc_id, unnest(w) as word, generate_subscripts(w, 1) as place
  from (select row_number() over () as rowid_, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from documents)),
pairs as (select *, lag(word) over (partition by doc order by place) as previous from words),
ones as (select word, count(*) as n from words group by word),
twos as (select previous, word, count(*) as n from pairs where previous is not null group by previous, word),
scored as (
  select doc, doc_id, p.previous is not null and t.n < 2 as backed_off,
    case when p.previous is null then o.n / total.n when t.n >= 2 then t.n / b.n else 0.4::double * (o.n / total.n) end as score
  from pairs p join ones o using (word) left join ones b on b.word = p.previous
  left join twos t on t.previous = p.previous and t.word = p.word cross join (select count(*) as n from words) total),
sums as (select doc, count(*) as n_words, count(*) filter (where backed_off) as n_backed_off, sum(ln(score)) as log_score from scored group by doc)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_backed_off, 0) as n_backed_off, round(coalesce(log_score, 0), 4) as log_score
from (select row_number() over () as doc, doc_id from documents) d left join sums using (doc)
"""


@query("op1_stupid_backoff", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scores.scores(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_backed_off", F.round("log_score", 4).alias("log_score"))


OP1_ORDER3_SQL = r"""
with words as (
  select rowid_ as doc, unnest(w) as word, generate_subscripts(w, 1) as place
  from (select row_number() over () as rowid_, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from documents)),
runs as (select *, lag(word) over (partition by doc order by place) as previous, lag(word, 2) over (partition by doc order by place) as first from words),
ones as (select word, count(*) as n from words group by word),
twos as (select previous, word, count(*) as n from runs where previous is not null group by previous, word),
threes as (select first, previous, word, count(*) as n from runs where first is not null group by first, previous, word),
shorter as (
  select r.doc, r.first, r.previous, r.word, t.n as pair_n,
    case when r.previous is null then o.n / total.n when t.n >= 2 then t.n / b.n else 0.4::double * (o.n / total.n) end as score
  from runs r join ones o using (word) left join ones b on b.word = r.previous
  left join twos t on t.previous = r.previous and t.word = r.word cross join (select count(*) as n from words) total),
scored as (
  select s.doc, case when s.first is null then s.previous is not null and s.pair_n < 2 else h.n < 2 end as backed_off,
    case when s.first is null then s.score when h.n >= 2 then h.n / c.n else 0.4::double * s.score end as score
  from shorter s left join threes h on h.first = s.first and h.previous = s.previous and h.word = s.word
  left join twos c on c.previous = s.first and c.word = s.previous),
sums as (select doc, count(*) as n_words, count(*) filter (where backed_off) as n_backed_off, sum(ln(score)) as log_score from scored group by doc)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_backed_off, 0) as n_backed_off, round(coalesce(log_score, 0), 4) as log_score
from (select row_number() over () as doc, doc_id from documents) d left join sums using (doc)
"""


@query("op1_stupid_backoff_order3", OP1_ORDER3_SQL)
def op1_order3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scores.scores(table(spark, sf_dir, "documents"), order=3)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_backed_off", F.round("log_score", 4).alias("log_score"))


@query("op8_suffix_array")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def made_periodic(doc_id, text):
    """The text of op11: of every tenth document by hash, the words from some place on repeat the first few of them."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    n = F.size(words)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    period = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    repeated = F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int")))
    whole = F.slice(F.concat(F.slice(words, F.lit(1), a.cast("int")), repeated), F.lit(1), n)
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), F.array_join(whole, " ")).otherwise(text)


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", made_periodic(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs.find_runs(docs).withColumn("best", periodic_runs.longest(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    length = -F.col("best.shorter")
    return found.select(
        "doc_id", "n_words", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"),
        F.col("best.period").alias("period"), F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


OP12_SQL = r"""
with docs as (select row_number() over () as r, doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
words as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by t) as least from docs),
failing as (
  select part, len(w) < 50 as a, 100 * len(list_distinct(w)) < 65 * len(w) as b,
    100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) as c, regexp_matches(t, '[#$%&*|]') as d,
    coalesce(doc_id > least, false) as e,
    coalesce(doc_id in (select doc_id from labels where quality = 1), false) as good,
    coalesce(doc_id in (select doc_id from labels where toxic = 1), false) as toxic
  from words),
fails as (
  select part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: case x when 'A' then a when 'B' then b when 'C' then c when 'D' then d else e end) as f,
    count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic
  from failing group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select [p.x, q.x, u.x, v.x, w.x] as o from letters p join letters q on q.x <> p.x join letters u on u.x not in (p.x, q.x)
  join letters v on v.x not in (p.x, q.x, u.x) join letters w on w.x not in (p.x, q.x, u.x, v.x)),
steps as (select o, unnest(range(1, 6)) as step from orders),
judged as (
  select part, o, step, n, good, toxic, list_contains(f, o[step]) as fails, list_has_any(f, o[:step - 1]) as gone, f = [o[step]] as alone
  from steps cross join fails),
counted as (
  select part, array_to_string(o, '') as filter_order, step, o[step] as letter,
    sum(n) filter (where not fails and not gone) as kept, sum(n) filter (where fails and not gone) as removed,
    sum(n) filter (where fails and gone) as redundant, sum(n) filter (where alone) as unique_fails,
    sum(good) filter (where fails and not gone) as good_lost, sum(toxic) filter (where fails and not gone) as toxic_lost
  from judged group by all)
select part, filter_order, step::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed,
  coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost,
  coalesce(toxic_lost, 0)::bigint as toxic_lost, (sum(coalesce(removed, 0)) over (partition by part, letter))::bigint as shapley
from counted
"""


@query("op12_filter_audit", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op13_kind(place: int, rule: secret_scan.Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""select r, {place} as place, '{rule.kind}' as kind, {rule.least} as least, string_split_regex(t, '{pattern}') as gaps,
      regexp_extract_all(t, '{pattern}') as whole, regexp_extract_all(t, '{pattern}', {rule.group}) as part
    from docs where regexp_matches(t, '{pattern}')"""


OP13_SQL = f"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
matched as ({" union all ".join(_op13_kind(i, rule) for i, rule in enumerate(secret_scan.RULES))}),
each as (select *, unnest(range(1, len(whole) + 1)) as i from matched),
spans as (
  select r, place, kind, len(whole[i]) as n,
    list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[:i - 1], lambda x: length(x))), 0) as a
  from each where length(part[i]) >= least),
found as (
  select r, count(*) filter (where place = 0) as n_assign, count(*) filter (where place = 1) as n_access, count(*) filter (where place = 2) as n_hex,
    string_agg(kind || ':' || a || ':' || (a + n), ',' order by a, place) filter (where place < 3) as base,
    string_agg(kind || ':' || a || ':' || (a + n), ',' order by a, place) as spans
  from spans group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join found using (r)
"""


@query("op13_secret_scan", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = secret_scan.open_ledger(spark, f"{shared_folder(spark)}/blob-ledger-{uuid.uuid4().hex}")
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), ledger)
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    count = lambda kind: F.size(of(kind)).cast("bigint").alias(f"n_{kind}")
    base = [rule.kind for rule in secret_scan.BASE]
    return found.select("doc_id", *map(count, base), F.sha2(secret_scan.listed(of(*base)).cast("binary"), 256).alias("base_sha256"),
                        secret_scan.listed(F.col("spans")).alias("spans"))
