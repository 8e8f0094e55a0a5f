"""One query for each operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import avi, bpe, decontamination, divergence, filter_audit, knn, lines, ngram_jaccard, packing, quality, toxicity, url_lists, warc
from .common import read


def fetched(pages: DataFrame) -> DataFrame:
    """pages has no fetch time: spread the captures over 180 days by their ids."""
    return pages.withColumn("fetched", F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 7919, F.lit(15552000))))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(read(spark, sf_dir, "documents"))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both derivatives of a response record of every page; the digests of the records' bytes stand for them."""
    out = warc.derive(warc.responses(fetched(read(spark, sf_dir, "pages"))))
    return out.select(
        F.col("record_key").cast("long").alias("page_id"), "kind", "record_id", "refers_to", "target_uri", "warc_date", "source_payload_digest", "digest_ok",
        "block_digest", "content_length", "title", "n_links", F.map_keys("source_headers").alias("source_header_names"), F.sha2("record", 256).alias("record_sha256"),
    )


def op3_avi_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.digests(read(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", knn.scaled(F.col("embedding")).alias("v"))
    return knn.top_k(vectors, vectors.where("vec_id % 100 = 0"))


OP5 = """
with v as (
  select vec_id, [floor(1024 * x::double) for x in embedding] as e from embeddings
  where len(embedding) > 0 and list_bool_and([x is not null and isfinite(x::double) for x in embedding])),
s as (
  select q.vec_id as query_id, x.vec_id, list_dot_product(q.e, x.e)::bigint as score
  from v q join v x on q.vec_id <> x.vec_id where q.vec_id % 100 = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.classes(read(spark, sf_dir, "documents"))


def entries(met: DataFrame) -> DataFrame:
    """List entries of events beside the hosts that they act on: a fifth of them on the domain above."""
    action = F.when(F.col("event_type").isin("error", "signup"), "block").when(F.col("event_type") == "purchase", "allow").otherwise("remove")
    key = F.when(F.col("event_id") % 5 == 0, F.substring_index("host", ".", -2)).otherwise(F.col("host"))
    return met.select(F.concat(F.lit("list"), F.col("event_id") % 3).alias("list_name"), key.alias("key"), action.alias("action"), F.col("value").alias("weight"), F.col("ts").cast("timestamp").alias("effective"))


def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated list entries, from the tables: every event acts on the hosts that share its user's bucket."""
    hosts = read(spark, sf_dir, "pages").select(url_lists.host(F.col("url")).alias("host")).where("host is not null").distinct()
    hosts = hosts.withColumn("bucket", F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("long") % 97)
    return entries(read(spark, sf_dir, "events").withColumn("bucket", F.col("user_id") % 97).join(hosts, "bucket"))


def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More of them, as a bucket may have no host: every event acts on the hosts of the pages in four slots, of as many as there are pages."""
    pages = read(spark, sf_dir, "pages").select("page_id", url_lists.host(F.col("url")).alias("host"))
    slots = F.lit(max(1, pages.count()))
    pages = pages.where("host is not null").select("host", F.pmod("page_id", slots).alias("slot")).distinct()
    events = read(spark, sf_dir, "events").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return entries(events.withColumn("slot", F.pmod(F.col("event_id") * 7 + F.col("j") * 1013, slots)).join(pages, "slot"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lists.as_of(fetched(read(spark, sf_dir, "pages")), list_entries(spark, sf_dir).union(page_entries(spark, sf_dir)))


OP9 = r"""
with c as (
  select page_id, to_timestamp(1704067200 + (page_id * 7919) % 15552000)::timestamp as fetched,
    nullif(rtrim(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.'), '') as host
  from pages),
h as (select distinct host, ('0x' || substr(md5(host), 1, 4))::bigint % 97 as bucket from c where host is not null),
z as (select greatest(count(*), 1) as slots from pages),
p as (select distinct host, (page_id % slots + slots) % slots as slot from c cross join z where host is not null),
t as (select event_id, ((event_id * 7 + j * 1013) % slots + slots) % slots as slot, event_type, value, ts from events cross join range(4) r(j) cross join z),
d as (
  select event_id, host, event_type, value, ts from events join h on user_id % 97 = bucket
  union all select event_id, host, event_type, value, ts from t join p using (slot)),
e as (
  select 'list' || (event_id % 3) as list_name,
    case when event_id % 5 = 0 then array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') else host end as key,
    case when event_type in ('error', 'signup') then 'block' when event_type = 'purchase' then 'allow' else 'remove' end as action,
    value as weight, ts::timestamp as valid_from
  from d),
l as (select list_name, key, valid_from, max({'action': action, 'weight': weight}) as last from e group by all),
i as (select list_name, key, valid_from, last.action as action, lead(valid_from) over (partition by list_name, key order by valid_from) as valid_to from l),
k as (
  select page_id, fetched, unnest([array_to_string(list_slice(string_split(host, '.'), n, len(string_split(host, '.'))), '.') for n in range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1)]) as key
  from c where host is not null),
m as (
  select page_id, list_name, action from k join i using (key)
  where action <> 'remove' and valid_from <= fetched and (valid_to is null or fetched < valid_to)),
g as (select page_id, count(distinct list_name) as n, string_agg(distinct list_name, ',' order by list_name) as lists, bool_or(action = 'allow') as a, bool_or(action = 'block') as b from m group by 1)
select c.page_id, host, coalesce(n, 0)::bigint as n_lists, coalesce(lists, '') as lists, coalesce(a, false) as allowed, coalesce(b, false) as blocked,
  case when coalesce(b, false) and not coalesce(a, false) then 'drop' else 'keep' end as decision
from c left join g using (page_id)
"""


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("items")


def op11_sql() -> str:
    """Every run of 1 to 10 words of a document, beside every window of as many."""
    words = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    leads = ", ".join(f"lead(word, {k}) over (partition by r order by pos) as w{k}" for k in range(1, 10))
    runs = " union all ".join(f"select r, pos, {k} as size, {" || ' ' || ".join(['word', *(f'w{i}' for i in range(1, k))])} as passage from n" for k in range(1, 11))
    return f"""
with b as (select item_id, {words} as words from benchmark),
s as (select item_id, words, unnest(range(1, greatest(len(words) - 8, 2))) as start from b where len(words) > 0),
k as (select distinct item_id, least(len(words), 10) as size, array_to_string(words[start:start + 9], ' ') as passage from s),
d as (select row_number() over () as r, doc_id, coalesce({words}, []) as words from documents),
w as (select r, unnest(words) as word, generate_subscripts(words, 1) as pos from d),
n as (select *, {leads} from w),
h as (select r, pos, size, item_id from ({runs}) join k using (size, passage)),
c as (select r, count(distinct hit) as n_hit from (select r, unnest(range(pos, pos + size)) as hit from h) group by 1),
i as (select r, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from h group by 1)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from d left join c using (r) left join i using (r)
"""


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP12 = r"""
with d as (select doc_id, coalesce(text, '') as text, coalesce(source, '') as part from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from d),
o as (select text, min(doc_id) as first from d group by 1),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by 1),
x as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    (len(words) < 50)::int + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::int + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::int
    + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(first < doc_id, false)::int as fails
  from w join o using (text) left join l using (doc_id)),
c as (select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from x group by 1, 2),
f as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(x, b)),
p as (
  select a.x || b.x || c.x || d.x || e.x as filter_order, [a.b, b.b, c.b, d.b, e.b] as bits
  from f a join f b on a.b <> b.b join f c on c.b not in (a.b, b.b) join f d on d.b not in (a.b, b.b, c.b) join f e on e.b not in (a.b, b.b, c.b, d.b)),
s as (select filter_order, step::int as step, bits[step] as bit, list_sum(bits[1:step])::int - bits[step] as seen from p, range(1, 6) t(step)),
r as (
  select part, filter_order, step, bit, sum(n) filter (fails & (seen | bit) = 0) as kept, sum(n) filter (fails & bit > 0 and fails & seen = 0) as removed,
    sum(n) filter (fails & bit > 0 and fails & seen > 0) as redundant, sum(n) filter (fails = bit) as unique_fails,
    sum(good) filter (fails & bit > 0 and fails & seen = 0) as good_lost, sum(toxic) filter (fails & bit > 0 and fails & seen = 0) as toxic_lost
  from c, s group by 1, 2, 3, 4)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
  coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost, coalesce(sum(removed) over (partition by part, bit), 0)::bigint as shapley
from r
"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


OP13 = r"""
with d as (select row_number() over () as r, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
w as (
  select r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from d),
k as (select lang, term, count(*) as in_lang from w group by 1, 2 having count(distinct r) >= 30),
v as (select lang, count(*) as v, sum(in_lang) as n from k group by 1),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from w join k using (lang, term) group by 1, 2, 3),
t as (select lang, source, coalesce(sum(n), 0) as total from g left join c using (lang, source) group by 1, 2),
p as (
  select lang, source, term, coalesce(c.n, 0) as n, 1 + ((coalesce(c.n, 0) + 5)::hugeint * 1000000000) // (total + 5 * v)::hugeint as p,
    1 + ((in_lang + 5)::hugeint * 1000000000) // (v.n + 5 * v)::hugeint as q
  from t join k using (lang) join v using (lang) left join c using (lang, source, term)),
s as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b using (lang, term) where a.source <> b.source group by 1, 2, 3),
o as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source
  union all select lang, source, 'term', term, (p - q)::bigint from p where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from o)
select lang, source, part, item, value, rank from r where part = 'pair' or rank <= 50
"""

FUNCTIONS = (op1_line_dedup, op2_warc_derivatives, op3_avi_motion_jpeg, op4_best_fit_packing, op5_voronoi_knn, op6_toxicity, op7_quality, op8_ngram_jaccard, op9_url_filters, op10_byte_bpe, op11_decontamination, op12_filter_interactions, op13_source_divergence)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in FUNCTIONS}

ORACLES: dict[str, str] = {"op5_voronoi_knn": OP5, "op9_url_filters": OP9, "op11_decontamination": op11_sql(), "op12_filter_interactions": OP12, "op13_source_divergence": OP13}
