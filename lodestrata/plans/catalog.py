"""Queries by name, each beside the SQL that gives the same rows (where SQL can say it)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import filters, json_safe, lenient
from ..functions import labels as lb
from ..functions import text as t
from ..operators import answers
from ..operators import collections as co
from ..operators import entities as en
from ..operators import exports, image_index, kept, layout, plugs
from ..operators import postprocess as pp
from ..operators import regions, resolution, rollups, search, segment, state, summary
from ..operators import vectors as ve
from ..sources import documents as dc
from ..sources import tables as tb
from ..streaming import files, ingest, transcripts
from .adapters import chunks, flags, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


CHUNKS = """
c0 as (select doc_id, lang, source as filename, sha256(text) as file_hash, string_split(text, chr(10)) as l from documents),
c1 as (select doc_id, lang, filename, file_hash, unnest(l) as text, generate_subscripts(l, 1) - 1 as ord from c0),
c as (select doc_id || ':' || ord as node_id, doc_id, ord, filename, lang, file_hash, text from c1 where regexp_matches(text, '\\S'))"""


def blanks(columns: tuple[str, ...], **given: str) -> str:
    """The select list of an export: what is given, else an empty cell."""
    return ", ".join(f"{given.get(c, repr(''))} as {c}" for c in columns)


def referenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with a reference to what they were taken from."""
    ref = F.struct(F.upper("filename").alias("network"), F.lit("posting").alias("type"), F.col("doc_id").alias("text_id"), F.lit(" ").alias("author"))
    return chunks(spark, sf_dir).withColumns({"reference": ref, "row": F.col("ord")})


MENTIONS = (
    CHUNKS
    + r""",
m0 as (
  select doc_id, ord, filename, 'CAP' as kind, regexp_extract_all(text, '[A-Z][a-z]{4,}') as l from c
  union all select doc_id, ord, filename, 'EMAIL', regexp_extract_all(text, '[\w.+-]+@[\w-]+\.[\w.]+') from c),
m1 as (select doc_id, ord, filename, kind, unnest(l) as text, generate_subscripts(l, 1) - 1 as pos from m0),
m as (
  select *, 1.0::double / (1 + pos) as score, {'d': doc_id, 'o': ord, 'k': kind, 'p': pos} as first,
    KEY || '::' || lower(kind) as key
  from m1)"""
)
ORTHOGRAPHIC = "coalesce(nullif(lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')), ''), lower(trim(text)))"
M = MENTIONS.replace("KEY", ORTHOGRAPHIC)
ENTITIES = """,
v as (select key, text, count(*) as n, max(score) as score, min(first) as first from m group by key, text),
e as (
  select v.key, arg_min(text, {'a': -n, 'b': -score, 'f': first}) as text, min(first) as first, sum(n)::bigint as mentions, max(score) as best_score,
    any_value(source_count) as source_count
  from v join (select key, count(distinct filename) as source_count from m group by key) s on s.key = v.key group by v.key)"""
TOP = """
select row_number() over (order by mentions desc, lower(text), first)::int as rank, text, first.k as type, mentions, round(best_score, 6) as best_score, source_count
from e order by 1 limit 20"""


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.mentions(chunks(spark, sf_dir))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.aggregate(found(spark, sf_dir))


@query("with " + M + ENTITIES + TOP)
def entity_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.top(entities(spark, sf_dir))


@query("with " + MENTIONS.replace("KEY", "lower(trim(text))") + ENTITIES + TOP)
def entity_top_k_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.top(en.aggregate(found(spark, sf_dir), "exact"))


ANY_CASE = {"CAP": "[A-Z][A-Za-z]{4,}"}


@query("with " + M.replace("[A-Z][a-z]{4,}", ANY_CASE["CAP"]) + """
select key, text, count(*) as mentions, round(max(score), 6) as best_score, count(*) over (partition by key) as spellings from m group by key, text
qualify count(*) over (partition by key) > 1""")
def entity_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.variants(en.mentions(chunks(spark, sf_dir), en.PATTERNS | ANY_CASE))


@query("with " + M + ENTITIES + " select first.k as type, count(*) as entities, sum(mentions)::bigint as mentions, round(max(best_score), 6) as best_score from e group by 1")
def entity_type_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.types(entities(spark, sf_dir))


@query("with " + M + """
select filename, count(*) as entity_mentions, count(distinct key) as unique_entities, count(distinct (doc_id, ord)) as ie_source_count,
  round(count(*) / count(distinct (doc_id, ord)), 6) as entity_density
from m group by filename""")
def entity_doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.per_file(found(spark, sf_dir))


RANKED = """,
r as (
  select key, text, first.k as type, mentions, case
    when lower(text) = 'thing' then 0 when lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) = 'thing' then 0
    when length(text) >= 3 and contains('thing', lower(text)) then 1
    when contains(lower(text), 'thing') then 2 when contains(lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')), 'thing') then 2 end as match_rank
  from e)"""


@query("with " + M + ENTITIES + RANKED + " select match_rank::int as match_rank, key, text, type, mentions from r where match_rank is not null order by match_rank, mentions desc, lower(text), key limit 20")
def entity_search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.search(entities(spark, sf_dir), "Thing")


@query("with " + M + """
select node_id, filename, length(text) as chars from c
where exists (select 1 from m where m.doc_id = c.doc_id and m.ord = c.ord and lower(m.text) = 'thing')""")
def entity_sources_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    return en.sources_with(en.mentions(c), c, "thing").select("node_id", "filename", F.length("text").cast("long").alias("chars"))


@query("with " + M + """,
p as (select key as head_key, lead(key) over (partition by doc_id, ord, kind order by pos) as tail_key, score from m)
select head_key, tail_key, count(*) as mentions, round(max(score), 6) as best_score, 'rel' as label from p where tail_key <> head_key
group by 1, 2 order by mentions desc, head_key, tail_key limit 20""")
def relation_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.relations(found(spark, sf_dir))


EDGES = ENTITIES + """,
n as (select key, text from e order by mentions desc, lower(text), first limit 50),
k as (select distinct doc_id, ord, key from m where key in (select key from n)),
g as (
  select a.key as source, b.key as target, count(*) as weight from k a join k b on a.doc_id = b.doc_id and a.ord = b.ord and a.key < b.key
  group by 1, 2 having count(*) >= 2)"""


FIRST = 50  #: nodes of the graphs that are returned themselves


def graph(spark: SparkSession, sf_dir: str, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all entities, or of the ``most`` with most mentions. Mentions, found once for both, and edges are kept, as are few nodes."""
    m = kept.keep(found(spark, sf_dir), "mentions")
    n = en.nodes(en.aggregate(m), most)
    if most is not None:
        n = kept.keep(n, "nodes")
    return n, kept.keep(en.co_occurrence(m, None if most is None else n, 2), "edges")


@query("with " + M + EDGES + " select source, target, weight, 'co_occurs' as label from g")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir, FIRST)[1]


NEAR = """,
t1 as (select source from g order by weight desc, source, target limit 1),
u as (select source as a, target as b, weight from g union all select target, source, weight from g),
s1 as (select b, weight from u where a = (select source from t1) and b <> (select source from t1)),
s2 as (select u.b, weight from u join (select distinct b from s1) f on u.a = f.b where u.b <> (select source from t1)),
x as (select b, weight / 1.0 as gain, 1 as depth from s1 union all select b, weight / 2.0, 2 from s2)"""


def centre_of(edges: DataFrame) -> str:
    """One end of the strongest edge; empty without edges."""
    best = edges.orderBy(F.desc("weight"), "source", "target").limit(1).collect()
    return best[0].source if best else ""


@query("with " + M + EDGES + NEAR + " select b as key, round(sum(gain), 6) as score, min(depth)::int as depth from x group by 1")
def graph_neighbors_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph(spark, sf_dir, FIRST)[1]
    return en.neighbours(edges, centre_of(edges))


WHOLE = EDGES.replace(" order by mentions desc, lower(text), first limit 50", "")  # every entity is a node


@query("with " + M + WHOLE + NEAR + """,
y as (select b, round(sum(gain), 6) as score, min(depth) as depth from x group by 1),
z as (select y.*, n.text from y join n on n.key = y.b order by score desc, depth, lower(n.text) limit 6)
select (select source from t1) || chr(10) || chr(10) || 'Related entities for retrieval: ' || string_agg(text, ', ' order by score desc, depth, lower(text)) as expanded from z""")
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, edges = graph(spark, sf_dir)
    centre = centre_of(edges)
    near = en.neighbours(edges, centre).join(n.select("key", "text"), "key").orderBy(F.desc("score"), "depth", F.lower("text")).limit(6)
    names = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "depth", F.lower("text").alias("l"), "text"))), lambda x: x["text"])
    return near.agg(F.concat(F.lit(f"{centre}\n\nRelated entities for retrieval: "), F.array_join(names, ", ")).alias("expanded"))


@query("with " + M + """,
k as (select filename, string_agg(distinct kind, ';' order by kind) as entity_types from m group by 1)
select c.filename, count(*) as node_count, count(distinct doc_id) as page_count, sum(length(text))::bigint as characters,
  arg_min(file_hash, {'d': doc_id, 'o': ord}) as file_hash, coalesce(any_value(entity_types), '') as entity_types
from c left join k on k.filename = c.filename group by c.filename""")
def doc_list_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    return rollups.documents(c, en.mentions(c).select("filename", "kind").distinct())


@query("""
with f as (
  select case lang when 'en' then 'text/plain' when 'de' then 'text/markdown' when 'fr' then 'application/x-thing' else 'text/csv' end as mimetype, n_chars as nodes from documents
  union all select 'text/html', length(html) from pages)
select case mimetype when 'text/plain' then 'TXT' when 'text/markdown' then 'MD' when 'text/csv' then 'CSV' when 'text/html' then 'HTML' else 'THING' end as label,
  count(*) as documents, sum(nodes)::bigint as nodes
from f group by 1""")
def filetype_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    mime = F.when(F.col("lang") == "en", "text/plain").when(F.col("lang") == "de", "text/markdown").when(F.col("lang") == "fr", "application/x-thing").otherwise("text/csv")
    d = table(spark, sf_dir, "documents").select(mime.alias("mimetype"), F.col("n_chars").alias("nodes"))
    return rollups.file_types(d.union(table(spark, sf_dir, "pages").select(F.lit("text/html"), F.length("html").cast("long"))))


@query("""
select count(*) as points, count(*) filter (event_type <> 'error') as social_points, count(*) filter (event_type = 'error') as table_points, count(distinct user_id) as authors,
  count(*) filter (event_type <> 'error') * 2 > count(*) as is_social, count(*) filter (event_type = 'error') * 2 > count(*) as is_table_heavy,
  case when count(*) filter (event_type <> 'error') * 2 > count(*) then 'posts' else 'documents' end as coverage_unit
from events""")
def collection_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("event_type") != "error").alias("is_social"), (F.col("event_type") == "error").alias("is_table"), F.col("user_id").alias("author"))
    return rollups.profile(e)


@query("with " + CHUNKS + """
select count(*) as total, count(*) filter (length(text) >= 40) as indexed, count(*) filter (length(text) < 40) as missing,
  case when count(*) filter (length(text) >= 40) = 0 then 'not_indexed' when count(*) filter (length(text) < 40) > 0 then 'partial' else 'ok' end as status
from c""")
def search_index_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.coverage(chunks(spark, sf_dir).withColumn("search_text", F.when(F.length("text") >= 40, F.col("text"))))


@query("with " + CHUNKS + """
select node_id, filename, 'toxicity' as category, 'high' as confidence, length(text) as chars from c join labels using (doc_id) where toxic = 1 and quality = 1""")
def flagged_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.flagged(chunks(spark, sf_dir), flags(spark, sf_dir), "medium").select("node_id", "filename", "category", "confidence", F.length("text").cast("long").alias("chars"))


def filtered(name: str, source: str, columns: str, rules: list[dict], where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return filters.matching(table(spark, sf_dir, source), rules, strict=True).select(*columns.split(", "))

    run.__name__ = name
    query(f"select {columns} from {source} where {where}")(run)


filtered("filter_eq", "events", "event_id, user_id, event_type", [{"field": "event_type", "operator": "eq", "value": " error "}], "event_type = 'error'")
filtered("filter_neq", "events", "event_id, event_type", [{"field": "event_type", "operator": "neq", "value": "view"}], "event_type is distinct from 'view'")
filtered("filter_range", "orders", "o_orderkey, o_totalprice", [{"field": "o_totalprice", "operator": "gte", "value": "100000"}, {"field": "o_totalprice", "operator": "lt", "value": 150000}], "o_totalprice >= 100000 and o_totalprice < 150000")
filtered("filter_in", "orders", "o_orderkey, o_orderpriority", [{"field": "o_orderpriority", "operator": "in", "values": ["1-URGENT", "5-LOW"]}], "o_orderpriority in ('1-URGENT', '5-LOW')")
filtered("filter_contains", "pages", "page_id, url", [{"field": "url", "operator": "contains", "value": "EXAMPLE.ORG"}], "contains(lower(url), 'example.org')")
filtered("filter_mime", "part", "p_partkey, p_type", [{"field": "p_type", "operator": "mime_match", "value": " Economy"}], "lower(p_type) = 'economy'")
filtered("filter_date", "events", "event_id, ts", [{"field": "ts", "operator": "date_on_or_after", "value": "2024-01-05"}, {"field": "ts", "operator": "date_before", "value": "2024-01-09"}], "ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-09 23:59:59.999999'")
filtered("filter_multi_field_or", "orders", "o_orderkey, o_orderstatus, o_orderpriority", [{"fields": ["o_orderstatus", "o_orderpriority"], "operator": "in", "values": ["F", "2-HIGH"]}], "o_orderstatus in ('F', '2-HIGH') or o_orderpriority in ('F', '2-HIGH')")
filtered("filter_json_path", "events", "event_id, props", [{"field": "props.k", "operator": "gt", "value": 90}], "try_cast(json_extract_string(props, '$.k') as double) > 90")


@query("with " + CHUNKS + r"""
select node_id, filename, left(text, 600) as preview, length(text) > 600 as truncated, ceil(length(text) / 3.5)::bigint as est_tokens from c
where regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])thing') and regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])with') and contains(regexp_replace(lower(trim(text)), '\s+', ' ', 'g'), 'with thing')""")
def fulltext_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hits(search.find(chunks(spark, sf_dir), "with  Thing"))


@query("with " + CHUNKS + r"""
select node_id, filename, left(text, 600) as preview, length(text) > 600 as truncated, ceil(length(text) / 3.5)::bigint as est_tokens from c
where regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])idiot')""")
def fulltext_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hits(search.find(chunks(spark, sf_dir), "Idiot"))


@query("select event_id, user_id, event_type from events where user_id::varchar = '77' or event_type = '77'")
def fulltext_field_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.find(table(spark, sf_dir, "events"), "77", [], ["user_id", "event_type"]).select("event_id", "user_id", "event_type")


@query("select doc_id, source, n_chars from documents where doc_id > 49 order by doc_id limit 50")
def fulltext_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.page(table(spark, sf_dir, "documents"), "doc_id", 50, search.encode_cursor(49)).select("doc_id", "source", "n_chars")


@query("with " + CHUNKS + " select " + blanks(exports.SEARCH, marked="case when node_id = '733:0' then 'true' else 'false' end", kind="'text'", source="filename", row="ord::varchar", chunk_id="node_id", chunk_text="text", network="upper(filename)", type="'posting'", author="' '") + r"""
from c where regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])pathetic')""")
def search_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.search(search.find(referenced(spark, sf_dir), "pathetic"), ["733:0"])


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and those that ask: every one whose id is divisible by 100."""
    v = table(spark, sf_dir, "embeddings")
    return v, v.where("vec_id % 100 = 0")


def labelled(hits: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id").select("query_id", "vec_id", "label", "score", "rank")


COSINE = """
with s as (
  select q.vec_id as query_id, x.vec_id, x.label, round(list_cosine_similarity(x.embedding::double[], q.embedding::double[]), 6) as score, q.label as q_label
  from embeddings x join embeddings q on q.vec_id % 100 = 0 and x.vec_id <> q.vec_id)"""


@query(COSINE + " select query_id, vec_id, label, score, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s qualify rank <= 5")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(ve.nearest(*vectors(spark, sf_dir), 5), spark, sf_dir)


@query(COSINE + " select query_id, vec_id, label, score, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s where label = q_label qualify rank <= 5")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(ve.nearest(*vectors(spark, sf_dir), 5, same="label"), spark, sf_dir)


@query("""
with s as (
  select q.vec_id as query_id, x.vec_id, round(list_cosine_similarity(x.embedding::double[], q.embedding::double[]), 6) as score
  from embeddings x join embeddings q on q.label = x.label and x.vec_id <> q.vec_id and q.vec_id % 100 = 0)
select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s where score >= 0.3 qualify rank <= 5""")
def vector_threshold_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = vectors(spark, sf_dir)
    return ve.candidates(q, v, "label", 0.3)


TERMS = r"""
w as (select item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: length(x) between 2 and 30)) as token from benchmark),
q as (select item_id, token, 1 + ln(count(*)) as weight from w group by 1, 2),
b as (select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: length(x) between 2 and 30)) as token from documents),
d as (select doc_id, token, 1 + ln(count(*)) as weight from b group by 1, 2),
s as (select item_id, doc_id, round(sum(d.weight * q.weight), 6) as score from d join q using (token) group by 1, 2)"""


def sparse(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return ve.sparse_top(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k, "doc_id", "item_id")


@query("with " + TERMS + " select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from s qualify rank <= 10")
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse(spark, sf_dir, 10)


@query("with " + TERMS.replace("s as (", "t as (") + """,
c as (
  select q.vec_id as query_id, x.vec_id, round(list_cosine_similarity(x.embedding::double[], q.embedding::double[]), 6) as score
  from embeddings x join embeddings q on q.vec_id in (select item_id from benchmark) and x.vec_id <> q.vec_id),
d0 as (select * from c qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20),
l as (select item_id as query_id, doc_id as vec_id, score from t qualify row_number() over (partition by item_id order by score desc, doc_id) <= 20),
dd as (select query_id, vec_id, case when max(score) over w = min(score) over w then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as d from d0 window w as (partition by query_id)),
p as (select query_id, vec_id, case when max(score) over w = min(score) over w then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as s from l window w as (partition by query_id)),
f as (select query_id, vec_id, round(0.5 * coalesce(d, 0) + 0.5 * coalesce(s, 0), 6) as score from dd full join p using (query_id, vec_id))
select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from f qualify rank <= 20""")
def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the benchmark ask: by their words for documents, and by the vector of their id for vectors of documents."""
    v = table(spark, sf_dir, "embeddings")
    q = v.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")).distinct(), "vec_id", "left_semi")
    lexical = sparse(spark, sf_dir, 20).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("vec_id"), "score", "rank")
    return ve.fuse(ve.nearest(v, q, 20), lexical, "query_id", "vec_id")


@query(COSINE + " select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s qualify rank <= 5")
def image_index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as those of images, stored by coarse cells, and read whole again."""
    v, q = vectors(spark, sf_dir)
    return image_index.search(image_index.build(v, kept.new_path(spark, "images")), q, 5, exact=True)


@query()
def image_index_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that each query probes are all that is read for it."""
    v, q = vectors(spark, sf_dir)
    return image_index.search(image_index.build(v, kept.new_path(spark, "images")), q, 5)


@query("with " + CHUNKS + " select count(*) as rows, sum(ceil(length(text) / 3.5))::bigint as tokens, max(ceil(length(text) / 3.5))::bigint as largest from c where length(text) <= 100000")
def guarded_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks written behind a guard of their budget, and what it observed while they were."""
    c = chunks(spark, sf_dir).where(F.length("text") <= 100_000)
    rows, seen = segment.guarded(c, "text", 30_000)
    kept.keep(rows, "payloads")
    return spark.createDataFrame([tuple(seen.get[x] for x in ("rows", "tokens", "largest"))], "rows long, tokens long, largest long")


@query()
def mmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = vectors(spark, sf_dir)
    return ve.mmr(ve.nearest(v, q, 40).join(v.select("vec_id", "embedding"), "vec_id"), 10)


@query(COSINE + """,
h as (select query_id, vec_id, label, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from s qualify rank <= 20),
r as (select *, round(score * (1 + label / 10.0), 6) as rerank from h),
f as (select query_id, vec_id, rerank, rank from r where label >= 5 or rerank >= 0.35)
select query_id, vec_id, rerank, row_number() over (partition by query_id order by rerank desc, rank, vec_id)::int as rerank_rank from f qualify rerank_rank <= 5""")
def rerank_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = labelled(ve.nearest(*vectors(spark, sf_dir), 20), spark, sf_dir)
    return ve.rerank(h, F.col("score") * (1 + F.col("label") / 10.0), 5, 0.35, F.col("label") < 5).select("query_id", "vec_id", "rerank", "rerank_rank")


@query("with " + CHUNKS + " select doc_id, node_id, length(text) as chars from c qualify row_number() over (partition by doc_id order by length(text) desc, ord) = 1")
def parent_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir).withColumn("chars", F.length("text").cast("long"))
    return pp.first_per_parent(c, "doc_id", [F.desc("chars"), F.col("ord")]).select("doc_id", "node_id", "chars")


@query()
def parent_pack_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's own lines, longest first, are one query's hits; the document is their parent."""
    c = chunks(spark, sf_dir).withColumn("child_tokens", t.estimated_tokens(F.col("text")))
    hits = c.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("child_tokens"), "ord")))
    parents = table(spark, sf_dir, "documents").select("doc_id", t.estimated_tokens(F.col("text")).alias("parent_tokens"))
    h = hits.join(parents, "doc_id").select(F.col("doc_id").alias("query_id"), "position", "node_id", F.col("doc_id").cast("string").alias("parent_id"), "parent_tokens", "child_tokens")
    return pp.pack_parents(h, 8000)


@query("""
with recursive e as (
  select event_id, user_id, event_type, value, coalesce(user_id::varchar, 'unknown') || '::' || coalesce(strftime(ts, '%Y-%m-%dT%H'), 'undated') as bucket,
    row_number() over (partition by user_id, event_type, value order by event_id) = 1 as kept from events),
r as (
  select *, true as moved from e
  union all
  select event_id, user_id, event_type, value, bucket, fresh as kept, bool_or(fresh <> kept) over () as moved from (
    select *, not again and coalesce(sum(case when kept and not again then 1 else 0 end) over (partition by bucket order by event_id rows between unbounded preceding and 1 preceding), 0) < 2 as fresh from (
      select *, coalesce(bool_or(kept) over (partition by user_id, event_type, value order by event_id rows between unbounded preceding and 1 preceding), false) as again from r where moved)))
select event_id, bucket, row_number() over (partition by bucket order by event_id)::int as bucket_rank from r where kept and not moved""")
def social_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two posts of an author and hour at most; a post that a full hour turned away may enter with a later one of its identity."""
    e = table(spark, sf_dir, "events").withColumns({"identity": F.concat_ws("|", "user_id", "event_type", "value"), "bucket": t.hour_bucket(F.col("user_id").cast("string"), F.col("ts"))})
    return pp.diverse(e, "identity", "bucket", 2, [F.col("event_id")]).select("event_id", "bucket", "bucket_rank")


@query("""
with h as (select l_orderkey, min(l_linenumber) as l_linenumber from lineitem where l_quantity >= 49 group by 1)
select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber)::int as link_rank
from lineitem l where l_orderkey in (select l_orderkey from h) and not exists (select 1 from h where h.l_orderkey = l.l_orderkey and h.l_linenumber = l.l_linenumber)
qualify link_rank <= 12""")
def link_following(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    hits = li.where("l_quantity >= 49").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("l_linenumber"))
    return pp.follow_links(hits, li.select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


@query("""
with a as (select label, vec_id, round(list_sum(embedding::double[]), 6) as score from embeddings),
b as (select * from a qualify row_number() over (partition by label order by score desc, vec_id) <= 10)
select label, vec_id, score, row_number() over (partition by label order by score desc, vec_id)::int as citation from b""")
def citation_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("score"))
    return pp.numbered(ve.top_k(s, 10, "label").drop("rank"), "label", [F.desc("score"), F.col("vec_id")])


@query("""
with want(position, node_id) as (values (0, '3:0'), (1, 'nowhere'), (2, '1:1'), (3, 'b7'), (4, '3:1')),
""" + CHUNKS.replace("\nc0", "c0", 1) + """
select position::int as position, node_id, case when node_id in (select node_id from c) then 'main' when node_id in (select 'b' || item_id from benchmark) then 'companion' else 'missing' end as found from want""")
def scoped_fetch_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("node_id"))
    return pp.scoped(["3:0", "nowhere", "1:1", "b7", "3:1"], chunks(spark, sf_dir), other, "node_id")


@query("""
with k as (select c_custkey::varchar as k, c_name from customer)
select o_orderkey, coalesce(a.c_name, b.c_name) as c_name from orders
left join k a on a.k = (case when o_orderkey % 3 = 0 then null else o_custkey::varchar end)
left join k b on b.k = (o_orderkey % 100)::varchar where coalesce(a.c_name, b.c_name) is not null""")
def media_link_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by their customer's key, else by a key of second choice."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    keys = [F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")), F.col("o_orderkey") % 100]
    return pp.first_key_join(o, keys, table(spark, sf_dir, "customer"), "c_custkey", "c_name").where("c_name is not null").select("o_orderkey", "c_name")


@query("""
with d as (select doc_id, sha256(text) as file_hash from documents), known as (select sha256(text) as h from documents where doc_id in (select doc_id from labels))
select file_hash, count(*) as copies from d where file_hash not in (select h from known) group by 1""")
def hash_dedupe_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))
    known = d.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("file_hash").distinct()
    return d.groupBy("file_hash").agg(F.count(F.lit(1)).alias("copies")).join(known, "file_hash", "left_anti")


@query("select sha256(text) as file_hash, count(*) as copies, min(doc_id) as first_doc, max(doc_id) as last_doc from documents group by 1 having count(*) > 1")
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("file_hash")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    return g.where("copies > 1")


@query(r"""
select doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g')) as cleaned from documents""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(t.clean(F.col("text")), 256).alias("cleaned"))


@query()
def squeeze_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one character in pages; RE2 has no back references, so a test holds the rule."""
    c = t.squeeze(F.col("html"), 3)
    return table(spark, sf_dir, "pages").select("page_id", F.length("html").alias("chars"), F.length(c).alias("squeezed"), F.sha2(c, 256).alias("text_hash"))


@query(r"""
with a as (select page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>', ' ', 'g'), '(?is)<[^>]*>', ' ', 'g'), '(?is)^$', '', 'g') as x from pages)
select page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))) as text_hash from a""")
def html_strip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(t.html_text(F.col("html")), 256).alias("text_hash"))


@query("select user_id || '::' || strftime(ts, '%Y-%m-%dT%H') as bucket, count(*) as members, min(event_id) as first_event, round(sum(value), 2) as value from events group by 1")
def unit_partition_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = t.hour_bucket(F.col("user_id").cast("string"), F.col("ts"))
    return table(spark, sf_dir, "events").groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("members"), F.min("event_id").alias("first_event"), F.round(F.sum("value"), 2).alias("value"))


@query("with " + CHUNKS + """
select doc_id as unit_key, count(*) as members, sha256(string_agg(left(sha256(text), 16), '|' order by ord)) as fingerprint from c group by 1""")
def unit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.units(chunks(spark, sf_dir), F.col("doc_id"), ["ord"])


@query("""
with recursive k as (select conv_id, turn, length(text) as n, row_number() over (partition by conv_id order by turn) as i from conversations),
w as (
  select conv_id, turn, i, n, n as used, 0 as "window" from k where i = 1
  union all select k.conv_id, k.turn, k.i, k.n, case when w.used + k.n > 1200 then k.n else w.used + k.n end, case when w.used + k.n > 1200 then w."window" + 1 else w."window" end
  from w join k on k.conv_id = w.conv_id and k.i = w.i + 1)
select conv_id, turn, "window"::int as "window" from w""")
def window_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.windows(table(spark, sf_dir, "conversations").withColumn("n", F.length("text")), "conv_id", "turn", "n", 1200)


@query("""
with recursive n as (select count(*) as n from documents),
t as (select 0 as tier, n as inputs, ceil(n / 10.0)::bigint as outputs from n union all select tier + 1, outputs, ceil(outputs / 10.0)::bigint from t where outputs > 1)
select tier::int as tier, inputs, outputs from t where inputs > 0""")
def fold_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.tiers(table(spark, sf_dir, "documents").select("doc_id"))


def told(df: DataFrame) -> DataFrame:
    """Answers to prompts without a model: a hash of the prompt, and an evidence line."""
    return df.select("*", F.concat(F.lit("S"), F.substring(F.md5("prompt"), 1, 12), F.lit("\nEVIDENCE_INDICES: 2, 1")).alias("response"), F.lit(None).cast("string").alias("error")).drop("prompt")


def summarised(spark: SparkSession, sf_dir: str, max_calls: int) -> summary.Build:
    """Documents as units, their lines as chunks; every third document was summarised before."""
    c = chunks(spark, sf_dir).select(F.col("doc_id").cast("string").alias("unit_key"), F.col("ord").alias("ord"), F.col("node_id").alias("chunk_id"), "text")
    d = table(spark, sf_dir, "documents")
    units = d.select(F.col("doc_id").cast("string").alias("unit_key"), F.when(F.col("lang") == "en", "document").otherwise("social_bucket").alias("kind"), F.col("source").alias("label"), F.col("doc_id").alias("position"), F.sha2("text", 256).alias("fingerprint"))
    cache = units.where("position % 3 = 0").select("unit_key", "fingerprint", F.concat(F.lit("kept "), F.substring("fingerprint", 1, 8)).alias("summary"), F.array().cast("array<string>").alias("evidence_ids"))
    return summary.build(units, c, told, cache, max_calls=max_calls, window_chars=2000)


@query()
def summary_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = summarised(spark, sf_dir, 50_000).units
    return u.select("unit_key", "kind", "summary", F.array_join("evidence_ids", ";").alias("evidence"), "from_cache", "truncated")


@query()
def summary_build_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget that the units nearly use up: what is left doesn't fold all briefs."""
    b = summarised(spark, sf_dir, 500)
    return b.totals.crossJoin(b.tiers.agg(F.count(F.lit(1)).alias("folds"), F.coalesce(F.max("tier"), F.lit(0)).alias("tiers")))  # one row each


@query()
def source_budget_alloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return summary.allocate(c, "conv_id", "turn", "n", 1500)


@query("""
with u as (select conv_id, arg_min(text, turn) as text from conversations where role = 'user' group by 1)
select c.conv_id, case when length(any_value(u.text)) > 50 then left(any_value(u.text), 50) || '...' else any_value(u.text) end as title, count(*) as turns, arg_max(role, turn) as last_role
from conversations c left join u on u.conv_id = c.conv_id group by 1""")
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.sessions(table(spark, sf_dir, "conversations"))


EXCHANGES = """
with n as (select conv_id, turn, role, text, lead(role) over w as next_role, lead(text) over w as next_text from conversations window w as (partition by conv_id order by turn)),
x as (
  select conv_id, row_number() over w as number, text as question, case when next_role = 'assistant' then next_text end as answer, lag(text) over w as prior_question
  from n where role = 'user' window w as (partition by conv_id order by turn))"""


@query(EXCHANGES + " select conv_id, number::int as number, question, answer from x")
def session_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.exchanges(table(spark, sf_dir, "conversations")).drop("prior_question")


@query(EXCHANGES + " select conv_id, number::int as number, prior_question from x where prior_question is not null")
def prior_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.exchanges(table(spark, sf_dir, "conversations")).select("conv_id", "number", "prior_question").where("prior_question is not null")


@query("""
with i as (select source, lang, min(doc_id) as first, count(*) as n from documents join labels using (doc_id) where toxic = 1 group by 1, 2)
select source, string_agg(lang, '; ' order by first, lang) as labels, sum(n)::bigint as items, min(first) as position from i group by 1""")
def report_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")
    return state.collapse(items, "source", "doc_id", "lang")


@query("with " + TERMS + """,
k as (select item_id, doc_id from s qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10),
x as (select b.item_id, d.doc_id from benchmark b join documents d on contains(d.text, b.text)),
h as (select item_id, list(doc_id) as wanted from x group by 1),
g as (select item_id, list(doc_id) as found from k group by 1),
j as (select g.item_id, coalesce(list_has_any(found, wanted), false) as hit, wanted is not null as has from g left join h using (item_id))
select 'sparse' as mode, count(*) as queries, count(*) filter (has) as expected_queries, round(avg(case when has then hit::int end), 6) as hit_rate from j""")
def eval_hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sparse(spark, sf_dir, 10).groupBy(F.col("item_id").alias("query_id")).agg(F.collect_list("doc_id").alias("found"))
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    wanted = rollups.containing(table(spark, sf_dir, "documents"), passages).groupBy("query_id").agg(F.collect_list("doc_id").alias("wanted"))
    return rollups.hit_rates(got.withColumn("mode", F.lit("sparse")), wanted)


@query("""
with l as (select l_orderkey as k, count(*) as l from lineitem where l_quantity > 10 group by 1), r as (select o_orderkey as k, count(*) as r from orders where o_orderstatus <> 'P' group by 1)
select count(*) filter (l is not null and r is not null) as in_both, count(*) filter (r is null) as left_only, count(*) filter (l is null) as right_only,
  coalesce(sum(l), 0)::bigint as left_rows, coalesce(sum(r), 0)::bigint as right_rows from l full join r using (k)""")
def verify_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("k"))
    return rollups.reconcile(li, table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k")), "k")


@query()
def resolve_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("name "), "vec_id").alias("surface"), F.concat(F.lit("T"), "label").alias("entity_type"), (F.col("vec_id") % 17).alias("mentions"), "embedding")
    return resolution.resolve(v, 0.3)


def surfaces_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("name "), "vec_id").alias("surface"), F.concat(F.lit("T"), "label").alias("entity_type"), (F.col("vec_id") % 17).alias("mentions"), "embedding")


def no_entities(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], "entity_id string, canonical_name string, type string, embedding array<float>"), spark.createDataFrame([], "entity_id string, surface string, type string")


def first_or_none(ties: DataFrame) -> DataFrame:
    """Of every second question the answer is the candidate asked for first, of the others none."""
    named = F.when(F.pmod(F.crc32("surface"), F.lit(2)) == 0, F.element_at("candidates", 1)["entity_id"]).otherwise("NONE")
    return ties.select("pos", F.concat(F.lit("It is "), named, F.lit(".")).alias("reply"))


@query()
def resolve_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.resolve_into(*no_entities(spark), surfaces_of(spark, sf_dir), first_or_none, threshold=0.3).surfaces


@query("select count(*) as processed, 0::bigint as minted, 0::bigint as attached, count(*) as skipped from embeddings")
def resolve_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run over what the first has stored: everything is skipped."""
    first = resolution.resolve_into(*no_entities(spark), surfaces_of(spark, sf_dir), threshold=0.3)
    return resolution.resolve_into(first.entities, first.aliases, surfaces_of(spark, sf_dir), threshold=0.3).counts.drop("entities_touched")


@query("select doc_id, case when not contains(text, '#') then length(text) end as chars, case when contains(text, '#') then 'ValueError: a mark' end as error from documents")
def enriched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plug that refuses texts with a certain mark: its other rows are whole."""

    def call(client: None, rows: list[dict]) -> list[int]:
        if any("#" in r["text"] for r in rows):
            raise ValueError("a mark")
        return [len(r["text"]) for r in rows]

    good, failed = plugs.split(plugs.enrich(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], plugs.Plug(call, "long", retries=0), "chars"))
    return good.select("doc_id", "chars", F.lit(None).cast("string").alias("error")).unionByName(failed.select("doc_id", "chars", "error"))


@query("""
select event_id, json_extract_string(props, '$.k') as k, event_type as category, case when value > 90 then null else value end as value,
  strftime(ts::timestamp, '%Y-%m-%dT%H:%M:%S') || case when date_part('microsecond', ts::timestamp)::bigint % 1000000 = 0 then '' else strftime(ts::timestamp, '.%f') end as at
from events""")
def answers_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties and types of events as a model would tell them, read back; values and times as JSON can hold them."""
    said = F.concat(F.lit("Of {course}:\n```json\n"), "props", F.lit("\n``` and {\"category\": \""), F.upper("event_type"), F.lit("\"} too"))
    flag = F.concat(F.lit("<think>{\"category\": \"no\"}</think> {\"category\": \""), F.upper("event_type"), F.lit("\", \"hate_speech\": 1"), F.lit("} {"))
    e = table(spark, sf_dir, "events").withColumn("wild", F.when(F.col("value") > 90, F.lit(float("inf"))).otherwise(F.col("value")))
    safe = json_safe.safe_columns(e.select("event_id", "wild", F.col("ts").cast("timestamp_ntz").alias("at")))
    e = e.select("event_id", F.get_json_object(lenient.first_object(said), "$.k").alias("k"), lenient.flag_of(flag)["category"].alias("category"))
    return e.join(safe.withColumnRenamed("wild", "value"), "event_id")


@query("select 'c' as collection, sha256(text) as file_hash, 'completed' as status, count(*) as documents from documents where regexp_matches(text, '\\S') group by text")
def ingested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the ingest stream; the manifest beside how many documents have each text."""
    root = kept.new_path(spark, "ingest")
    docs = table(spark, sf_dir, "documents")
    ingest.ingest(ingest.stream_documents(spark, f"{sf_dir}/documents.parque[t]", docs.schema), f"{root}/chunks", f"{root}/manifest", f"{root}/checkpoint", "c").awaitTermination()
    n = docs.groupBy(F.sha2("text", 256).alias("file_hash")).agg(F.count(F.lit(1)).alias("documents"))
    return ingest.manifest(spark, f"{root}/manifest").join(n, "file_hash").select("collection", "file_hash", "status", "documents")


@query("select sha256(html) as file_hash, 'said ' || length(html) as transcript, count(*) as places from pages group by html")
def transcripts_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as media, twice: the second time a plug that refuses everything is asked for nothing."""
    cache = transcripts.cache_table(kept.new_path(spark, "transcripts"))
    media = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").cast("binary").alias("content"))

    def once(client: None, rows: list[dict]) -> list[str]:
        return [f"said {len(r['content'].decode())}" for r in rows]

    def refuse(client: None, rows: list[dict]) -> list[str]:
        raise RuntimeError("asked again")

    transcripts.transcribe(media, cache, plugs.Plug(once))
    again = transcripts.transcribe(media, cache, plugs.Plug(refuse))
    return again.where("cached and error is null").groupBy("file_hash", "transcript").agg(F.count(F.lit(1)).alias("places"))


@query("""
with c as (select conv_id, turn, trim(text) as text, role, trim(text) as answer from conversations)
select conv_id, turn, answer, case when turn % 4 = 3 then null else role end as thought,
  length(answer) < 40 or list_bool_or(list_transform(['""" + "', '".join(t.WEAK_PHRASES).replace("couldn't", "couldn''t") + """'], lambda x: contains(lower(answer), x))) as weak,
  case when regexp_matches(lower(text), 'entity|extract|ner|relation') then 'ner' when regexp_matches(lower(text), 'table|row|column|csv') then 'table' when regexp_matches(lower(text), 'summary|summarize|overview') then 'summary' else 'qa' end as intent
from c""")
def answers_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as answers of models that tell their thoughts before, or after, or without an opening or a closing tag."""
    c = table(spark, sf_dir, "conversations").withColumn("text", F.trim("text"))
    k = F.col("turn") % 4
    said = F.when(k == 0, F.concat(F.lit("<think>"), "role", F.lit("</think> "), "text")).when(k == 1, F.concat("role", F.lit("</think>"), "text")).when(k == 2, F.concat("text", F.lit("<think>"), "role")).otherwise(F.col("text"))
    answer = t.without_reasoning(said)
    return c.select("conv_id", "turn", answer.alias("answer"), t.reasoning(said).alias("thought"), t.weak_answer(answer).alias("weak"), t.intent(F.col("text")).alias("intent"))


@query("""
with e as (
  select event_id, event_type, user_id, value, case event_id % 3 when 0 then event_type || '.pdf' when 1 then user_id || '.csv' end as filename,
    case when event_id % 3 = 2 then md5(event_id::varchar) end as h, case event_id % 4 when 0 then event_id % 50 + 1 when 1 then user_id + 1 end as page from events)
select 'e' || event_id as id, event_type || ' ' || user_id as text, filename, h as file_hash, '/sources/preview?collection=c&file_hash=' || h as preview_url, page::int as page,
  case when event_id % 5 = 0 then user_id::int end as "row" from e""")
def payload_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stored payloads, their fields in one of the places where readers put them."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    text = F.concat_ws(" ", "event_type", F.col("user_id").cast("string"))
    origin = F.struct(F.when(k % 3 == 0, F.concat("event_type", F.lit(".pdf"))).alias("filename"), F.when(k % 4 == 0, k % 50 + 1).alias("page_no"))
    provenance = F.when(k % 4 == 1, F.array(F.struct((F.col("user_id") + 1).alias("page_no"))))
    payload = F.to_json(F.struct(
        origin.alias("origin"), F.when(k % 3 == 1, F.concat(F.col("user_id").cast("string"), F.lit(".csv"))).alias("file_name"), F.when(k % 3 == 2, F.struct(F.md5(k.cast("string")).alias("file_hash"))).alias("metadata"),
        provenance.alias("provenance"), F.when(k % 5 == 0, F.struct(F.col("user_id").alias("row_index"))).alias("table"), F.when(k % 2 == 0, text).alias("chunk"), F.when(k % 2 == 1, F.to_json(F.struct(text.alias("text")))).alias("_node_content"),
    ))
    rows = answers.source_rows(e.select(F.concat(F.lit("e"), k).alias("node_id"), payload.alias("payload")), "c")
    return rows.select("id", "text", "filename", "file_hash", "preview_url", "page", "row")


@query("""
with n as (select *, row_number() over (partition by conv_id order by turn) as n from conversations qualify n <= 6)
select conv_id, string_agg('Source ' || n || ' [c' || conv_id || ' | page=' || turn || ' | row=n/a]:' || chr(10) || '- Author: ' || role || case when text = '' then '' else chr(10) || 'Text: ' || text end, chr(10) || chr(10) order by n) as sources, false as truncated
from n group by conv_id""")
def answer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as the sources of one answer."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("position"), F.concat(F.lit("c"), "conv_id").alias("filename"), F.col("turn").alias("page"), F.lit(None).cast("int").alias("row"), "text", F.struct(F.col("role").alias("author")).alias("reference"))
    return answers.sources_text(c, "conv_id")


@query("""
with i as (select user_id, event_id, event_id % 7 as chunk, event_type as label, case when value > 50 then 'note ' || event_type end as note from events),
f as (select user_id, chunk, label, min(event_id) as seen from i group by all),
m as (select user_id, chunk, note, min(event_id) as seen from i where note is not null group by all),
l as (select user_id, chunk, string_agg(label, ' · ' order by seen) as labels from f group by all),
n as (select user_id, chunk, string_agg(note, ' · ' order by seen) as notes from m group by all)
select 'r' || user_id as report_id, 'c' || chunk as key, min(event_id) as position, any_value(labels) as labels, any_value(notes) as notes, count(*) as entities from i join l using (user_id, chunk) left join n using (user_id, chunk) group by user_id, chunk""")
def report_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as findings of a user's report, each in one of seven chunks."""
    none = lambda c: F.lit(None).cast("string").alias(c)
    items = table(spark, sf_dir, "events").select(
        F.concat(F.lit("r"), "user_id").alias("report_id"), F.col("event_id").alias("position"), F.concat(F.lit("c"), F.col("event_id") % 7).alias("chunk_id"), none("filename"), none("page"), none("row"), none("chunk_text"),
        F.col("event_type").alias("entity_label"), F.when(F.col("value") > 50, F.concat(F.lit("note "), "event_type")).alias("note"), F.array("event_type").alias("entities"), none("translation"))
    return state.merged_findings(items).select("report_id", "key", "position", "labels", "notes", F.size("entities").cast("long").alias("entities"))


@query()
def keyframe_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ve.prune_near(table(spark, sf_dir, "embeddings"), "label", 0.35)


@query("""
with e as (
  select 'c' || (user_id % 3) as collection, md5(user_id::varchar) as file_hash, ts as t,
    case event_type when 'purchase' then 'completed' when 'error' then 'failed' else 'started' end as status, case when event_type = 'error' then event_id::varchar end as error from events),
a as (
  select collection, file_hash, min(t) filter (status = 'started') as started_at, max(t) filter (status = 'started') as last_start, max(t) as updated_at,
    arg_max(status, t) filter (status <> 'started') as d, arg_max(coalesce(error, ''), t) filter (status <> 'started') as error, max(t) filter (status <> 'started') as d_at
  from e group by 1, 2),
s as (select *, case when d is null or (d = 'failed' and last_start > d_at) then 'in_progress' else d end as status from a)
select collection, file_hash, status, started_at, updated_at, case when status = 'failed' then error end as error from s""")
def manifest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("started")
    return state.merge_manifest(e.select(F.concat(F.lit("c"), F.col("user_id") % 3).alias("collection"), F.md5(F.col("user_id").cast("string")).alias("file_hash"), F.col("ts").alias("at"), status.alias("status"), F.when(F.col("event_type") == "error", F.col("event_id").cast("string")).alias("error")))


@query("""
select p_name || chr(10) || p_brand as text, to_json({'p_partkey': p_partkey, 'p_type': p_type, 'p_size': p_size, 'p_retailprice': p_retailprice})->>'$.p_partkey' as partkey, 'table' as style from part where p_size > 20""")
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tb.rows(table(spark, sf_dir, "part"), ["p_name", "p_brand"], where="p_size > 20")
    return r.select("text", F.get_json_object("metadata", "$.p_partkey").alias("partkey"), "style")


@query()
def hierarchical_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.hierarchy(table(spark, sf_dir, "documents"))


@query()
def budget_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir).select("node_id", "text")
    return segment.budget_split(c, 128).select("node_id", "part_index", "total_parts", F.length("text").alias("chars"))


@query("""
select 'c' || conv_id as source_file, (row_number() over (partition by conv_id order by turn) - 1)::int as sentence_index, turn * 2.5 as start_seconds,
  printf('%02d:%02d:%02d', (turn * 2 // 3600)::int, (turn * 2 // 60 % 60)::int, (turn * 2 % 60)::int) as end_ts, trim(text) as text
from conversations where trim(text) <> ''""")
def transcript_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as segments of a recording: starts are given in seconds, ends as clock."""
    turn = F.col("turn")
    clock = F.format_string("%02d:%02d:%02d", F.floor(turn * 2 / 3600), F.floor(turn * 2 / 60) % 60, turn * 2 % 60)
    s = table(spark, sf_dir, "conversations").select("text", (turn * 2.5).cast("double").alias("start_seconds"), clock.alias("end_ts"), F.concat(F.lit("c"), "conv_id").alias("source_file"))
    return dc.transcript(s).select("source_file", "sentence_index", "start_seconds", "end_ts", "text")


@query("select date_trunc('hour', ts) as hour, event_type, count(*) as events, round(sum(value), 2) as value from events group by 1, 2")
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("value"))


PAGE_BANDS = """
b as (
  select source as doc_id, doc_id as page_index, 'top' as band, string_split(text, chr(10))[1] as text from documents
  union all select source, doc_id, 'bottom', string_split(text, chr(10))[-1] from documents)"""


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of their source; their first and last lines are the bands."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_index"), F.split("text", "\n", -1).alias("l"))
    return d.select("doc_id", "page_index", F.inline(F.array(F.struct(F.lit("top").alias("band"), F.element_at("l", 1).alias("text")), F.struct(F.lit("bottom").alias("band"), F.element_at("l", -1).alias("text")))))


FURNITURE = PAGE_BANDS + r""",
k as (select *, lower(trim(regexp_replace(regexp_replace(text, '\d+', '#', 'g'), '\s+', ' ', 'g'))) as key from b),
p as (select doc_id, count(distinct page_index) as pages from b group by 1),
f as (
  select k.doc_id, band, key, count(distinct page_index) as on_pages, any_value(pages) as pages,
    bool_or(regexp_matches(lower(trim(text)), '^(page|seite|p\.)?\s*[-–]?\s*\d{1,4}\s*[-–]?(\s*(/|of|von)\s*\d{1,4})?$|^[ivxlc]{1,7}$')) as is_number
  from k join p on p.doc_id = k.doc_id where key <> '' group by 1, 2, 3)"""


@query("with " + FURNITURE + " select doc_id, band, key, on_pages, is_number from f where is_number or on_pages >= greatest(2, round_even(pages * 0.02, 0))")
def page_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.furniture(bands(spark, sf_dir), 0.02)


@query("select page_id, round(length(url) / length(html)::double * 1000, 6) as text_coverage, round(length(url) / length(html)::double * 1000, 6) < 10 as needs_ocr from pages")
def page_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.length("url").alias("chars"), F.length("html").cast("double").alias("area"))
    return layout.triage(p, 10.0).select("page_id", "text_coverage", "needs_ocr")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of documents on pages of two columns, 400 words each, as a stand-in for a layout analyser."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.regexp_replace("text", r"\s+", " "), " ")).alias("i", "text"))
    at = F.col("i") % 400
    x0, y0 = (at / 200).cast("int") * 300 + at % 5 * 55.0, (at % 200 / 5).cast("int") * 12.0
    return d.select("doc_id", (F.col("i") / 400).cast("long").alias("page_index"), "text", x0.alias("x0"), y0.alias("y0"), (x0 + 50.0).alias("x1"), (y0 + 10.0).alias("y1"), F.lit(10.0).alias("font_size"))


@query("""
with e as (
  select 'c' || (user_id % 3) as collection, md5(user_id::varchar) as file_hash, ts::timestamp as t, event_id,
    case event_type when 'purchase' then 'completed' when 'error' then 'failed' else 'started' end as status, case when event_type = 'error' then event_id::varchar end as error from events),
s as (
  select collection, file_hash, max(t) as updated_at, min(t) as started_at, max(t) filter (status = 'started') as last_start,
    arg_max(status, {'t': t, 'r': case status when 'completed' then 1 else 2 end}) filter (status <> 'started') as d, max(t) filter (status <> 'started') as d_at
  from e group by 1, 2)
select collection, file_hash, case when d is null or (d = 'failed' and last_start > d_at) then 'in_progress' else d end as status, started_at, updated_at from s""")
def file_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as those of files, followed as a stream whose time limits are longer than the table's time."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("started")
    root = kept.new_path(spark, "states")
    stream = spark.readStream.schema(e.schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as the table may be one file
    stream = stream.select(F.concat(F.lit("c"), F.col("user_id") % 3).alias("collection"), F.md5(F.col("user_id").cast("string")).alias("file_hash"), status.alias("status"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") == "error", F.col("event_id").cast("string")).alias("error"))
    manifest = files.manifest_table(f"{root}/manifest")
    files.follow(stream, manifest, f"{root}/checkpoint", late="3650 days", limit=10**9, memory=10**9).awaitTermination()
    rows = manifest.read(spark)
    return rows.select("collection", "file_hash", "status", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("started_at", "updated_at")))


REGION_LINES = r"""
l0 as (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from documents),
l as (
  select doc_id, line, trim(case line % 11 when 3 then 'Table ' || line || ': ' || text when 5 then replace(text, ', ', '   ') when 7 then '' when 8 then left(text, 40) else text end, ' ' || chr(9) || chr(13)) as text
  from l0)"""


def region_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as those of pages, some made captions, rows of tables, and blank."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    k = F.col("line") % 11
    text = F.when(k == 3, F.concat(F.lit("Table "), "line", F.lit(": "), "text")).when(k == 5, F.replace("text", F.lit(", "), F.lit("   "))).when(k == 7, "").when(k == 8, F.left("text", F.lit(40))).otherwise(F.col("text"))
    return d.select("doc_id", F.lit(0).cast("long").alias("page_index"), "line", F.btrim(text, F.lit(" \t\r")).alias("text"))


@query("with " + REGION_LINES + r""",
f as (
  select *, regexp_matches(text, '(?i)^table\s+\d+\s*[:.]') as caption, length(regexp_replace(text, '\s{2,}', chr(1), 'g')) - length(replace(regexp_replace(text, '\s{2,}', chr(1), 'g'), chr(1), '')) as gaps,
    coalesce(lag(text) over (partition by doc_id order by line) = '', false) as after_blank from l),
b as (
  select *, text <> '' and (regexp_matches(text, '^\d+(\.\d+)*\s+[A-Z]') or regexp_matches(text, '(?i)^(table|figure)\s+\d+\s*[:.]')
    or not (gaps >= 2 or (gaps >= 1 and length(text) < 60) or (not after_blank and length(text) < 60))) as stops from f),
s as (select doc_id, line, (select min(line) from b x where x.doc_id = c.doc_id and x.line > c.line and x.stops) as stop from b c where caption)
select doc_id, line::int as start, (select max(x.line) from b x where x.doc_id = s.doc_id and x.line < coalesce(s.stop, 1000000000) and x.text <> '')::int as "end" from s""")
def table_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.text_regions(region_lines(spark, sf_dir)).select("doc_id", "start", "end")


@query("with " + REGION_LINES + r""",
w as (select doc_id, line // 40 as block, text, length(text) as n, len(string_split_regex(text, '\s+')) as words from l where text <> ''),
a as (select doc_id, block, count(*) as lines, count(*) filter (words <= 2) as short, median(n) as m from w group by 1, 2)
select doc_id, block, lines, lines >= 15 and short >= 0.6 * lines and m <= 8 as is_figure_text from a""")
def figure_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty lines are a block."""
    lines = region_lines(spark, sf_dir).withColumn("block", F.floor(F.col("line") / 40))
    return regions.figure_texts(lines.where("text <> ''")).select("doc_id", "block", "lines", "is_figure_text")


@query("""
with c as (select l_orderkey as doc_id, l_linenumber as line, l_quantity::double * 10 as y0, l_quantity::double * 10 + l_linenumber as y1 from lineitem),
r as (select o_orderkey as doc_id, (o_totalprice::bigint % 500)::double as top from orders),
n as (
  select r.doc_id, arg_min(line, {'g': y0 - top, 'l': line}) as caption from r join c on r.doc_id = c.doc_id and y0 - top >= -greatest(y1 - y0, 1) and y0 - top <= 8 * greatest(y1 - y0, 1) group by 1)
select r.doc_id, caption::int as caption from r left join n using (doc_id)""")
def captions_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of an order as captions on its page, at a height by their quantity; the order as a region."""
    y0, page = F.col("l_quantity").cast("double") * 10, F.lit(0).cast("long").alias("page_index")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), page, F.col("l_linenumber").cast("int").alias("line"), F.concat(F.lit("Table "), "l_linenumber", F.lit(":")).alias("text"), y0.alias("y0"), (y0 + F.col("l_linenumber")).alias("y1"))
    top = (F.bround("o_totalprice", 0).cast("long") % 500).cast("double")
    boxes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), page, F.lit(0).alias("region"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(0.0).alias("x1"), top.alias("y1"))
    return regions.captions_above(boxes, lines).select("doc_id", "caption")


@query()
def reading_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_order(cells(spark, sf_dir))


@query("""
with e as (
  select 'j' || (user_id % 500) as job_id, ts as t, case event_type when 'error' then 'warning' when 'purchase' then 'done' else 'progress' end as kind, 'step ' || event_id || '/' || user_id as message from events)
select job_id, max_by(case when kind = 'progress' then regexp_replace(message, '\\d+', '#', 'g') end, case when kind = 'progress' then {'t': t, 'm': message} end) as last_progress,
  count(*) filter (kind = 'warning') as warnings, least(count(*) filter (kind = 'warning'), 100)::bigint as warnings_kept,
  case when bool_or(kind = 'done') then 'done' else 'running' end as state, max(t) as updated_at
from e group by 1""")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "warning").when(F.col("event_type") == "purchase", "done").otherwise("progress")
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("j"), F.col("user_id") % 500).alias("job_id"), F.col("ts").alias("at"), kind.alias("kind"), F.concat(F.lit("step "), "event_id", F.lit("/"), "user_id").alias("message"))
    return co.fold_jobs(e)


@query("select 'u' || left(sha256(source), 12) || '__' || lang as physical, source as owner, lang as logical from (select distinct source, lang from documents)")
def collection_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.owned(table(spark, sf_dir, "documents").select(F.col("source").alias("owner"), F.col("lang").alias("logical")))


@query("select sha256(text) as image_id, count(*) as found, string_agg(distinct source, ';' order by source) as places from documents group by 1")
def image_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.images(table(spark, sf_dir, "documents").select(F.col("text").cast("binary").alias("content"), F.col("source").alias("place")))


@query("""
with w as (select user_id, event_id % 50 as token_id, value - 20 as weight from events),
b as (select user_id, token_id, max(weight) as weight from w where weight > 0 group by 1, 2)
select user_id, list(token_id order by token_id) as indices, list(weight order by token_id) as values from b group by 1""")
def sparse_vector_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.sparse_vectors(table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 50).alias("token_id"), (F.col("value") - 20).alias("weight")), "user_id")


@query(r"""
with """ + CHUNKS + r""" select node_id, regexp_replace(text, '(?i)\b(idiot\w*)', '**\1**', 'g') as marked from c where regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])idiot')""")
def keyword_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.find(chunks(spark, sf_dir), "idiot").select("node_id", co.highlighted(F.col("text"), ["idiot"]).alias("marked"))


@query("""
with e as (select doc_id, md5(text) as h from documents), l as (select e.*, row_number() over (partition by h order by doc_id) as n from e)
select (h2.doc_id is not null) as known, count(*) as documents, count(*) filter (n = 1) as distinct_texts from l left join (select distinct doc_id from labels) h2 using (doc_id) group by 1""")
def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("first"))
    known = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("k", F.lit(True))
    x = d.join(first, "doc_id", "left").join(known, "doc_id", "left")
    return x.groupBy(F.coalesce("k", F.lit(False)).alias("known")).agg(F.count(F.lit(1)).alias("documents"), F.count("first").alias("distinct_texts"))


@query("""
select l_orderkey, count(*) as children, string_agg(l_returnflag || l_linestatus, ';' order by l_linenumber, l_returnflag || l_linestatus) as merged, case when count(distinct l_returnflag) = 1 then any_value(l_returnflag) else 'mixed' end as source_mix
from lineitem group by 1""")
def parent_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of children joined in their order for the parent, and one value or 'mixed'."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.array(F.concat("l_returnflag", "l_linestatus")).alias("tags"))
    arrays = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("children"), F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "tags"))), lambda x: x["tags"])), ";").alias("merged"),
        F.when(F.min("l_returnflag") == F.max("l_returnflag"), F.min("l_returnflag")).otherwise("mixed").alias("source_mix"),
    )
    return arrays


# -- exports


@query("with " + M + ENTITIES + """
select (row_number() over (order by mentions desc, lower(text), first))::varchar as rank, text as entity, first.k as type, mentions::varchar as mentions
from e where mentions >= 2 qualify row_number() over (order by mentions desc, lower(text), first) <= 100""")
def entity_stats_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.entities(en.top(entities(spark, sf_dir).where("mentions >= 2"), 100))


@query("with " + M + " select " + blanks(exports.ENTITY_SOURCES, entity="'Thing'", source="filename", row="ord::varchar", chunk_id="node_id", chunk_text="text", network="upper(filename)", ref_type="'posting'", text_id="doc_id::varchar", author="' '") + """
from c where exists (select 1 from m where m.doc_id = c.doc_id and m.ord = c.ord and lower(m.text) = 'thing')""")
def entity_source_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = referenced(spark, sf_dir)
    return exports.entity_sources(en.sources_with(en.mentions(c), c, "thing"), "Thing")


@query("with " + CHUNKS + " select " + blanks(exports.FLAGGED, source="filename", row="ord::varchar", chunk_id="node_id", category="'toxicity'", confidence="case when quality = 1 then 'high' else 'low' end", chunk_text="text", network="upper(filename)", ref_type="'posting'", text_id="c.doc_id::varchar", author="' '") + """
from c join labels using (doc_id) where toxic = 1""")
def flagged_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.flagged(rollups.flagged(referenced(spark, sf_dir), flags(spark, sf_dir)))


@query("with " + M + """,
f as (select filename, count(*) as n, count(distinct doc_id) as p, arg_min(file_hash, {'d': doc_id, 'o': ord}) as h, max(ord) as r from c group by 1),
k as (select filename, string_agg(distinct kind, ';' order by kind) as t from m group by 1)
select filename, 'application/octet-stream' as mimetype, h as file_hash, n::varchar as node_count, p::varchar as page_count, case when r = 0 then '' else r::varchar end as max_rows, '' as max_duration, coalesce(t, '') as entity_types
from f left join k using (filename)""")
def document_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    listed = rollups.documents(c, en.mentions(c)).join(c.groupBy("filename").agg(F.max("ord").alias("max_rows")), "filename")
    return exports.documents(listed.withColumn("mimetype", t.mime_of_name(F.col("filename"))))


# -- entities: statistics, endpoints, resolved names


@query("with " + M + ENTITIES + " select count(*) as unique_entities, sum(mentions)::bigint as entity_mentions, count(*) filter (mentions >= 2) as ranked from e where lower(first.k) = 'cap'")
def entity_totals_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.totals(entities(spark, sf_dir), "Cap")


@query("with " + M + """,
s as (select filename, count(distinct (doc_id, ord)) as ie_source_count from m group by 1),
f as (select filename, count(*) as entity_mentions, count(distinct key) as unique_entities from m where kind = 'CAP' group by 1)
select filename, entity_mentions, unique_entities, ie_source_count, round(entity_mentions / ie_source_count, 6) as entity_density from f join s using (filename) where entity_mentions >= 2""")
def entity_doc_stats_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.per_file_of(found(spark, sf_dir), "cap")


@query("with " + M + """,
d as (select doc_id, ord, lower(text) as low, lower(kind) as low_kind, arg_min(text, pos) as text, min(pos) as pos from m group by all)
select doc_id, ord::int as ord, low_kind, text, pos::int as pos from d""")
def entity_distinct_per_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.distinct_per_chunk(found(spark, sf_dir))


ENDS = """
n as (
  select doc_id, ord, upper(text) as head, lead(text) over (partition by doc_id, ord, kind order by pos) as tail, pos, score from m),
r as (select doc_id, ord, head, case pos % 3 when 0 then tail || '!' when 1 then 'The ' || tail else tail end as tail, score from n where tail is not null),
x as (select distinct doc_id, ord, lower(text) as low, lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) as small, key from m),
ll as (select doc_id, ord, low, min(key) as key from x group by 1, 2, 3 having min(key) = max(key)),
ls as (select doc_id, ord, small, min(key) as key from x where small <> '' group by 1, 2, 3 having min(key) = max(key)),
gl as (select low, min(key) as key from x group by 1 having min(key) = max(key)),
gs as (select small, min(key) as key from x where small <> '' group by 1 having min(key) = max(key)),
i as (select row_number() over () as id, r.* from r),
p as (select id, doc_id, ord, 'h' as side, head as raw from i union all select id, doc_id, ord, 't', tail from i),
q as (
  select p.id, p.side, coalesce(ll.key, ls.key, gl.key, gs.key, lower(p.raw)) as key from p
  left join ll on ll.doc_id = p.doc_id and ll.ord = p.ord and ll.low = lower(p.raw)
  left join ls on ls.doc_id = p.doc_id and ls.ord = p.ord and ls.small = lower(regexp_replace(p.raw, '[^A-Za-z0-9]', '', 'g'))
  left join gl on gl.low = lower(p.raw)
  left join gs on gs.small = lower(regexp_replace(p.raw, '[^A-Za-z0-9]', '', 'g')))"""


@query("with " + M + "," + ENDS + """
select h.key as head_key, 'rel' as label, t.key as tail_key, count(*) as mentions, max(i.score) as best_score
from i join q h on h.id = i.id and h.side = 'h' join q t on t.id = i.id and t.side = 't' group by 1, 3""")
def relation_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations between neighbours whose ends are written in other ways than the mentions."""
    m = kept.keep(found(spark, sf_dir), "mentions")
    tail = F.lead("text").over(Window.partitionBy("doc_id", "ord", "kind").orderBy("pos"))
    written = F.when(F.col("pos") % 3 == 0, F.concat("tail", F.lit("!"))).when(F.col("pos") % 3 == 1, F.concat(F.lit("The "), "tail")).otherwise(F.col("tail"))
    r = m.withColumn("tail", tail).where("tail is not null").select("doc_id", "ord", F.upper("text").alias("head"), F.lit("").alias("label"), written.alias("tail"), "score")
    return en.endpoints(r, m)


ALIASES = """
a as (
  select lower(surface) as surface, low_kind, min({'id': id, 'name': name}) as e
  from (select left(text, 2) as id, 'Group ' || left(text, 2) as name, lower(kind) as low_kind, unnest([text, 'Group ' || left(text, 2)]) as surface from mm where length(text) % 2 = 0) group by 1, 2),
m as (select mm.* exclude (key), coalesce('ent::' || e.id, mm.key) as key from mm left join a on surface = lower(mm.text) and low_kind = lower(mm.kind))"""


def stored_entities(m: DataFrame) -> DataFrame:
    """Stored entities, from the mentions: names of even length belong to the entity of their first two letters."""
    own = m.where(F.length("text") % 2 == 0).groupBy(F.substring("text", 1, 2).alias("entity_id"), "kind", "text").agg(F.lit(1).alias("one"))
    return own.select("entity_id", F.concat(F.lit("Group "), "entity_id").alias("canonical"), "kind", F.array("text").alias("aliases"))


@query("with " + M.replace("m as (\n  select *", "mm as (\n  select *") + "," + ALIASES + ENTITIES + """
select key, case when starts_with(key, 'ent::') then 'Group ' || substr(key, 6) else text end as text, first.k as type, mentions, round(best_score, 6) as best_score, source_count from e""")
def entity_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = found(spark, sf_dir)
    return en.aggregate_resolved(m, en.alias_index(stored_entities(m))).select("key", "text", "type", "mentions", F.round("best_score", 6).alias("best_score"), "source_count")


@query("with " + M.replace("m as (\n  select *", "mm as (\n  select *") + "," + ALIASES + """
select e.id as entity_id, surface, low_kind from a where e.id in (select e.id from a where surface = 'group th')""")
def entity_alias_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.siblings(en.alias_index(stored_entities(found(spark, sf_dir))), "Group Th")


# -- search by field, totals, pages


POSTS = "select event_id, ts as timestamp, case when event_id % 11 = 0 then 'INTERNAL' else event_type end as network, 'User ' || user_id || ' Smith' as author, user_id as author_id, md5(event_id::varchar) as uuid, case when event_id % 3 = 0 then 'Poster ' || (user_id % 7) end as posting_author, ' ' || event_type || ' ' as text from events".replace("INTERNAL", lb.INTERNAL_NETWORKS[0])


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as posts of a network."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").alias("timestamp"), F.when(F.col("event_id") % 11 == 0, lb.INTERNAL_NETWORKS[0]).otherwise(F.col("event_type")).alias("network"),
        F.concat(F.lit("User "), "user_id", F.lit(" Smith")).alias("author"), F.col("user_id").alias("author_id"), F.md5(F.col("event_id").cast("string")).alias("uuid"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Poster "), F.col("user_id") % 7)).alias("posting_author"), F.concat(F.lit(" "), "event_type", F.lit(" ")).alias("text"),
    )


SEVEN = hashlib.md5(b"7").hexdigest()


def by_field(name: str, field: str, q: str, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.by_field(posts(spark, sf_dir), field, q).select("event_id", "network", "author")

    run.__name__ = name
    query(f"with p as ({POSTS}) select event_id, network, author from p where {where}")(run)


by_field("search_author_phrase", "author", "user 7 smith", "lower(author) like '%user 7 smith%' or lower(coalesce(posting_author, '')) like '%user 7 smith%'")
by_field("search_author_name", "author", "poster", "posting_author is not null")
by_field("search_author_id", "author", "77", r"author_id = 77 or regexp_matches(lower(author), '(^|[^\p{L}\p{N}_])77')")
by_field("search_network", "network", "purch", "network like 'purch%'")
by_field("search_uuid", "uuid", f"{SEVEN[:8]}-{SEVEN[8:12]}-{SEVEN[12:16]}-{SEVEN[16:20]}-{SEVEN[20:]}".upper(), f"uuid = '{SEVEN}'")


@query(f"with p as ({POSTS}) select count(*) as total from p where network = 'purchase'")
def search_total_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.total(search.by_field(posts(spark, sf_dir), "network", "purchase"), "purchase")


@query("with " + CHUNKS + """
select node_id, filename, text from c join labels using (doc_id) where toxic = 1 and node_id > '2' order by node_id limit 20""")
def flagged_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of flagged findings behind a cursor."""
    hits = rollups.flagged(chunks(spark, sf_dir), flags(spark, sf_dir))
    return search.page(hits, "node_id", 20, search.encode_cursor("2")).select("node_id", "filename", "text")


@query("with " + M + """
select node_id, filename from c where exists (select 1 from m where m.doc_id = c.doc_id and m.ord = c.ord and lower(m.text) = 'thing') and node_id > '1' order by node_id limit 20""")
def entity_sources_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    return search.page(en.sources_with(en.mentions(c), c, "thing"), "node_id", 20, search.encode_cursor("1")).select("node_id", "filename")


@query("with a as (select source, count(*) as documents from documents where lang = 'xx' or not exists (select 1 from documents where lang = 'xx') group by 1) select * from a")
def sources_narrowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter that nothing meets is no filter."""
    return search.narrowed(table(spark, sf_dir, "documents"), F.col("lang") == "xx").groupBy("source").agg(F.count(F.lit(1)).alias("documents"))


# -- lanes, windows and labels of sources


@query("""
with d as (select doc_id, source, case when doc_id % 4 <> 0 then md5(text) end as image_id from documents),
x as (select doc_id, image_id, 'text' as lane from d where doc_id % 2 = 0
      union all select doc_id, image_id, 'image' from d o where doc_id % 2 = 1 and not exists (select 1 from d where doc_id % 2 = 0 and image_id = o.image_id))
select * from x""")
def image_lane_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.md5("text")).alias("image_id"))
    return pp.with_images(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"))


@query("""
with d as (select doc_id, md5(coalesce(source, '') || (doc_id % 50)) as file_hash from documents), h as (select distinct file_hash from d where doc_id % 2 = 0)
select vec_id, source_hash, row_number() over (partition by source_hash order by vec_id)::int as place
from (select e.vec_id, d.file_hash as source_hash from embeddings e join d on d.doc_id = e.vec_id) where source_hash in (select file_hash from h)
qualify row_number() over (partition by source_hash order by vec_id) <= 3""")
def images_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.concat(F.coalesce("source", F.lit("")), F.col("doc_id") % 50)).alias("file_hash"))
    images = table(spark, sf_dir, "embeddings").select("vec_id").join(d.select(F.col("doc_id").alias("vec_id"), F.col("file_hash").alias("source_hash")), "vec_id")
    return pp.images_of(d.where("doc_id % 2 = 0"), images, 3, [F.col("vec_id")]).select("vec_id", "source_hash", "place")


@query(r"""
select l.doc_id, sha256(coalesce(case when d.doc_id % 2 = 0 and regexp_matches(d.text, '\S') then d.text end, b.text, 'none')) as text_hash
from (select distinct doc_id from labels) l left join documents d on d.doc_id = l.doc_id left join benchmark b on b.item_id = l.doc_id""")
def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("text"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    got = pp.texts_of(table(spark, sf_dir, "labels").select("doc_id").distinct(), d, b, "doc_id")
    return got.select("doc_id", F.sha2(F.coalesce("text", F.lit("none")), 256).alias("text_hash"))


@query()
def parent_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """600 characters around every line of a document; a test holds the rule."""
    c = chunks(spark, sf_dir)
    parents = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("parent"))
    return pp.parent_windows(c.join(parents, "doc_id"), "parent", "text", 600).select("node_id", F.length("window").alias("chars"), F.sha2("window", 256).alias("window_hash"))


@query(f"with p as ({POSTS})" + r"""
select event_id, 'network: ' || network || chr(10) as head,
  concat_ws(chr(10), '- Network: ' || network, '- UUID: ' || uuid, '- Posting Author: ' || posting_author, '- Author: ' || author, '- Author ID: ' || author_id, '- Text: ' || trim(text)) as block,
  coalesce(posting_author, case when network = 'INTERNAL' then '' else author end) as posted_by, 5 + (posting_author is not null)::int as items, uuid as posting_group
from p""".replace("INTERNAL", lb.INTERNAL_NETWORKS[0]))
def reference_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["network", "uuid", "author", "author_id", "posting_author", "text"]
    p = posts(spark, sf_dir).select("event_id", "network", F.struct(*fields).alias("ref"))
    return p.select(
        "event_id", F.concat(F.lit("network: "), "network", F.lit("\n")).alias("head"), lb.reference_block(F.col("ref"), fields).alias("block"), lb.posting_value(F.col("ref"), fields, "author").alias("posted_by"),
        F.size(lb.reference_items(F.col("ref"), fields)).alias("items"), lb.first_text(F.lit(" "), F.col("ref.uuid")).alias("posting_group"),
    )


@query(r"""
select c_custkey, c_name || ' (p' || c_nationkey || case when c_custkey % 2 = 0 then ', row ' || c_custkey else '' end || ')' as label,
  case when c_custkey % 3 = 0 then c_name || ' (Row ' || c_custkey || ')' else c_name || ' (Page ' || c_nationkey || ')' end || ' ' || format('[{:.3f}]', round(c_custkey / 8.0, 3)::double) as line,
  replace(c_mktsegment || '|' || c_name, '|', '\|') || '<br>x' as cell, regexp_replace(c_name, '[^A-Za-z0-9._-]+', '_', 'g') as fragment, false as has_blank, c_acctbal as amount
from customer""")
def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    odd = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey"))
    page = F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey"))
    return c.select(
        "c_custkey", lb.source_label(F.col("c_name"), F.col("c_nationkey"), odd).alias("label"), lb.source_line(F.col("c_name"), page, F.col("c_custkey"), F.col("c_custkey") / 8).alias("line"),
        lb.markdown_cell(F.concat("c_mktsegment", F.lit("|"), "c_name", F.lit("\r\nx "))).alias("cell"), lb.file_fragment(F.concat(F.lit(" "), "c_name", F.lit("_ "))).alias("fragment"),
        lb.has_blank(F.col("c_mktsegment")).alias("has_blank"), lb.number(F.col("c_acctbal").cast("string")).alias("amount"),
    )


@query("""
with s as (select o_orderkey, o_orderdate, (o_totalprice * (o_orderkey % 5 - 1))::double as x, trunc(o_totalprice * (o_orderkey % 5 - 1))::bigint as n from orders)
select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, case when n <= 0 then '00:00' when n >= 86400 then format('{}d {:02d}:{:02d}:{:02d}', n // 86400, n // 3600 % 24, n // 60 % 60, n % 60)
  when n >= 3600 then format('{}:{:02d}:{:02d}', n // 3600, n // 60 % 60, n % 60) else format('{:02d}:{:02d}', n // 60, n % 60) end as elapsed from s""")
def elapsed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" or so")))
    return o.select("o_orderkey", lb.date_only(day).alias("day"), lb.elapsed(F.col("o_totalprice") * (F.col("o_orderkey") % 5 - 1)).alias("elapsed"))


@query("""
select conv_id, turn, case when turn % 3 = 2 then ['a'] when turn % 3 = 1 then ['b', 'a'] else ['c'] end as evidence, sha256(trim(text)) as text_hash from conversations""")
def evidence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers whose last line names the chunks that they rest on: usable numbers, in their order, else the first chunk."""
    end = F.when(F.col("turn") % 3 == 1, "\nEVIDENCE_INDICES: 2, 9, 1, 3").when(F.col("turn") % 3 == 0, "\nEVIDENCE_INDICES: 3").otherwise("")
    c = table(spark, sf_dir, "conversations").withColumn("said", F.concat("text", end))
    return c.select("conv_id", "turn", lb.evidence(F.col("said"), F.array(*map(F.lit, "abc"))).alias("evidence"), F.sha2(lb.without_evidence(F.col("said")), 256).alias("text_hash"))


@query("""
select conv_id, turn, case when turn >= 2 then null when length(text) % 10 < 5 and length(text) % 3 = 0 then 'low confidence, missing entities' when length(text) % 10 < 5 then 'low confidence' when length(text) % 3 = 0 then 'missing entities' end as reason
from conversations""")
def clarifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    names = F.when(n % 3 != 0, F.array(F.col("role"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", lb.clarification((n % 10) / 10, names, F.col("turn"), need_entities=True).alias("reason"))


# -- sessions, reports, owners and jobs


@query("""
select conv_id, string_agg('**' || role || ':** ' || coalesce(text, ''), chr(10) || chr(10) order by turn) as markdown from conversations group by 1""")
def session_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.transcript(table(spark, sf_dir, "conversations"))


CITED = CHUNKS + """,
k as (select conv_id, turn, row_number() over () * 0 + 1 as position, (conv_id % 200) || ':0' as node_id, case when turn % 2 = 0 then 'own name' end as filename from conversations where role = 'assistant')"""


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    k = turns.where("role = 'assistant'").select("conv_id", "turn", F.lit(1).alias("position"), F.concat(F.col("conv_id") % 200, F.lit(":0")).alias("node_id"), F.when(F.col("turn") % 2 == 0, "own name").alias("filename"), F.lit(None).cast("string").alias("text"))
    return state.citations(turns, k, chunks(spark, sf_dir))


@query("with " + CITED + " select conv_id, turn, position::int as position, k.node_id, coalesce(k.filename, c.filename) as filename, c.text from k left join c on c.node_id = k.node_id")
def session_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cited(spark, sf_dir)


@query("with " + CITED + " select distinct conv_id, coalesce(k.filename, c.filename) as filename from k left join c on c.node_id = k.node_id where coalesce(k.filename, c.filename) is not null")
def session_source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.cited_files(cited(spark, sf_dir))


LOG = "select user_id, event_id as t, case event_id % 7 when 0 then 'drop' when 1 then 'open' when 2 then 'scope' when 3 then 'validation' else 'open' end as kind, 'v' || event_id as value from events"


@query(f"""
with l as ({LOG}), d as (select user_id, max(t) as dropped from l where kind = 'drop' group by 1),
a as (select l.* from l left join d using (user_id) where dropped is null or t > dropped)
select user_id as conv_id, max_by(value, t) filter (kind = 'open') as collection, max_by(value, t) filter (kind = 'scope') as scope, max_by(value, t) filter (kind = 'validation') as validation, max(t) as updated_at
from a group by 1 having count(*) filter (kind = 'open') > 0""")
def session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 7
    kind = F.when(n == 0, "drop").when(n == 2, "scope").when(n == 3, "validation").otherwise("open")
    return state.fold_sessions(table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("at"), kind.alias("kind"), F.concat(F.lit("v"), "event_id").alias("value")))


@query("""
with l as (select user_id % 50 as report_id, user_id % 20 as item_id, event_id as t, case event_id % 6 when 0 then 'remove' when 1 then 'note' else 'add' end as kind, event_id from events),
g as (select report_id, item_id, max(t) as gone from l where kind = 'remove' group by 1, 2),
a as (select l.* from l left join g using (report_id, item_id) where gone is null or t > gone),
i as (
  select report_id, item_id, min(t) filter (kind = 'add') as added_at, 'k' || (min_by(event_id, t) filter (kind = 'add') % 4) as dedupe_key, 'n' || max_by(event_id, t) filter (kind = 'note') as note
  from a group by 1, 2 having count(*) filter (kind = 'add') > 0),
f as (select * from i qualify row_number() over (partition by report_id, dedupe_key order by added_at, item_id) = 1)
select *, row_number() over (partition by report_id order by added_at, item_id)::int as position from f""")
def report_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 6
    kind = F.when(n == 0, "remove").when(n == 1, "note").otherwise("add")
    value = F.when(n == 1, F.concat(F.lit("n"), "event_id")).otherwise(F.concat(F.lit("k"), F.col("event_id") % 4))
    return state.fold_items(table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("report_id"), (F.col("user_id") % 20).alias("item_id"), F.col("event_id").alias("at"), kind.alias("kind"), value.alias("value")))


@query("""
with r as (select o_custkey % 40 as owner, o_orderkey as report_id, o_orderdate as updated_at from orders)
select owner, report_id, row_number() over (partition by owner order by updated_at desc, report_id)::int as place from r""")
def report_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("owner"), F.col("o_orderkey").alias("report_id"), F.col("o_orderdate").alias("updated_at"))
    return state.listed(o).drop("updated_at")


@query("""
with l as (select user_id as collection, event_id as t, case when event_id % 3 = 0 then 'bump' else 'store' end as kind, event_id % 4 as expected, 'p' || event_id as payload from events),
s as (select *, count(*) filter (kind = 'bump') over (partition by collection order by t) as revision from l),
o as (select collection, max(revision) as revision, max({'at': t, 'r': revision, 'p': payload}) filter (kind = 'store' and expected = revision) as s from s group by 1)
select collection, revision, case when s.r = revision then s.p end as payload from o""")
def summary_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("collection"), F.col("event_id").alias("at"), F.when(F.col("event_id") % 3 == 0, "bump").otherwise("store").alias("kind"), (F.col("event_id") % 4).alias("expected"), F.concat(F.lit("p"), "event_id").alias("payload"))
    return state.published(e)


OWNED = """
l as (select 'o' || (user_id % 20) as owner, event_type as logical, max({'at': event_id, 'kind': case when event_id % 2 = 0 then 'claim' else 'release' end}) as e from events group by 1, 2),
n as (select owner, logical, 'u' || left(sha256(owner), 12) || '__' || logical as physical from l where e.kind = 'claim' union all select 'legacy', source, source from (select distinct source from documents where source is not null))"""


def owned_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 2 == 0, "claim").otherwise("release")
    log = table(spark, sf_dir, "events").select(F.concat(F.lit("o"), F.col("user_id") % 20).alias("owner"), F.col("event_type").alias("logical"), F.col("event_id").alias("at"), kind.alias("kind"))
    return co.owned_after(log, table(spark, sf_dir, "documents").where("source is not null").select(F.col("source").alias("physical")))


@query("with " + OWNED + " select * from n")
def owned_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owned_names(spark, sf_dir)


@query("with " + OWNED + ", x as (select distinct unnest([physical, logical]) as typed, physical from n) select typed, min(physical) as physical from x group by 1 having count(*) = 1")
def collection_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.by_name(owned_names(spark, sf_dir))


@query("""
with j as (select o_custkey % 40 as owner, o_orderkey as job_id, o_orderdate as updated_at from orders where o_orderstatus = 'O')
select owner, job_id from j qualify row_number() over (partition by owner order by updated_at desc, job_id) = 1""")
def active_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("owner"), F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("updated_at"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("state"))
    return co.active(o).select("owner", "job_id")


# -- roll-ups of collections


@query("""
with f as (select lang, doc_id, case doc_id % 3 when 0 then 'PDF' when 1 then 'CSV' else 'UNKNOWN' end as label, n_chars from documents where lang is not null),
k as (select lang, label, count(*) as n, sum(n_chars) as nodes from f group by 1, 2)
select lang, sum(n)::bigint as document_count, sum(nodes)::bigint as node_count, string_agg(label || ':' || n, ';' order by n desc, label) as file_types from k group by 1""")
def collection_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 0, "application/pdf").when(F.col("doc_id") % 3 == 1, "text/csv")
    return rollups.overview(table(spark, sf_dir, "documents").where("lang is not null").select("lang", kind.alias("mimetype"), F.col("n_chars").alias("node_count")), "lang")


@query("with " + CHUNKS + """,
i as (select distinct doc_id || ':0' as node_id from labels union select 'nowhere')
select count(c.node_id) as found, count(*) filter (c.node_id is null) as missing, coalesce(sum(ceil(length(c.text) / 3.5)), 0)::bigint as est_tokens, coalesce(sum(ceil(length(c.text) / 3.5)), 0) <= 100000 as fits
from i left join c using (node_id)""")
def scope_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "labels").select(F.concat("doc_id", F.lit(":0")).alias("node_id")).union(spark.range(1).select(F.lit("nowhere")))
    return rollups.scope(chunks(spark, sf_dir), ids, 100_000)


@query(r"""
with d as (select case when doc_id % 3 = 0 then 'had' else '' end as s, case when doc_id % 5 = 0 then ' ' else text end as t from documents)
select count(*) as scanned, count(*) filter (s = '' and coalesce(regexp_matches(t, '\S'), false)) as written, count(*) filter (s <> '') as skipped, count(*) filter (s = '' and not coalesce(regexp_matches(t, '\S'), false)) as empty from d""")
def search_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("search_text", F.when(F.col("doc_id") % 3 == 0, "had").otherwise(""))
    return rollups.backfill_counts(rollups.backfilled(d, F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.col("text"))))


@query(r"""
with p as (select lower(regexp_extract(regexp_replace(url, '^.*://[^/]*', ''), '(\.[^./?#]+)(?:[?#].*)?$', 1)) as ending, length(html) as n from pages)
select ending, count(*) as files, coalesce(sum(n), 0)::bigint as bytes, coalesce(nullif(ending, ''), '(none)') || ': ' || count(*) || ' (' || coalesce(sum(n), 0) || ' B)' as label from p group by 1""")
def input_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.inventory(table(spark, sf_dir, "pages"), F.regexp_replace("url", "^.*://[^/]*", ""), F.length("html").cast("long"))


@query("""
with g as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) - row_number() over (partition by user_id, event_type order by event_id) as island from events)
select user_id, event_id, event_type, count(*) over (partition by user_id, event_type, island) as run from g""")
def style_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many neighbours of one kind each row stands among."""
    return layout.style_runs(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")
