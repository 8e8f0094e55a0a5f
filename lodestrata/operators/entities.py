"""Entities: mentions, aggregates, variants, relations, graph, search and query expansion.

Mentions are counted per (key, spelling, file) first, so that frequent entities cross the network as a few
rows for each task, and everything above works on these counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from .kept import keep

PATTERNS = {"CAP": "[A-Z][a-z]{4,}", "EMAIL": r"[\w.+-]+@[\w-]+\.[\w.]+"}


def mentions(chunks: DataFrame, patterns: dict[str, str] = PATTERNS) -> DataFrame:
    """(doc_id, ord, filename, kind, pos, text, score): a default extractor; any table of this shape will do."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("text", F.lit(p), 0).alias("found")) for k, p in patterns.items()])
    each = chunks.select("doc_id", "ord", "filename", F.inline(kinds))
    each = each.select("doc_id", "ord", "filename", "kind", F.posexplode("found").alias("pos", "text"))
    return each.withColumn("score", 1.0 / (1 + F.col("pos")))


def normalized(found: DataFrame) -> DataFrame:
    """Mentions without blank texts, with a type and a numeric score."""
    return found.select("doc_id", "ord", "filename", "pos", t.strip(F.col("text")).alias("text"), t.entity_type(F.col("kind")).alias("kind"), F.col("score").cast("double").alias("score")).where("text <> ''")


def counted(found: DataFrame, mode: str = "orthographic") -> DataFrame:
    """(key, text, filename): mentions, best_score, first place; found's own column ``key`` goes before the mode's."""
    key = F.col("key") if "key" in found.columns else t.cluster_key(F.col("text"), F.col("kind"), mode).alias("key")
    return found.groupBy(key, "text", "filename").agg(
        F.count(F.lit(1)).alias("n"), F.max("score").alias("score"), F.min(F.struct("doc_id", "ord", "kind", "pos")).alias("first")
    )


def aggregate(found: DataFrame, mode: str = "orthographic") -> DataFrame:
    """key, text (the commonest spelling), type (as first seen), mentions, best_score, source_count, first."""
    once = F.col("text") == F.min("text").over(Window.partitionBy("key", "filename"))  # a file counts with one of its spellings
    found = counted(found, mode).withColumn("files", (once & F.col("filename").isNotNull()).cast("long"))
    spelt = found.groupBy("key", "text").agg(F.sum("n").alias("n"), F.max("score").alias("score"), F.min("first").alias("first"), F.sum("files").alias("files"))
    order = F.struct(-F.col("n"), -F.coalesce("score", F.lit(-1.0)), F.col("first"))
    return spelt.groupBy("key").agg(
        F.min_by("text", order).alias("text"), F.min("first").alias("first"), F.sum("n").alias("mentions"), F.max("score").alias("best_score"),
        F.sum("files").alias("source_count"),
    ).withColumn("type", F.col("first.kind"))


def top(entities: DataFrame, k: int = 20) -> DataFrame:
    """The k entities with most mentions: rank, text, type, mentions, best_score, source_count."""
    best = entities.orderBy(F.desc("mentions"), F.lower("text"), "first").limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("mentions"), F.lower("text"), "first"))
    return best.select(rank.alias("rank"), "text", "type", "mentions", F.round("best_score", 6).alias("best_score"), "source_count")


def variants(found: DataFrame, mode: str = "orthographic") -> DataFrame:
    """Spellings of every entity that has more than one: key, text, mentions, best_score."""
    spelt = counted(found, mode).groupBy("key", "text").agg(F.sum("n").alias("mentions"), F.round(F.max("score"), 6).alias("best_score"))
    many = spelt.groupBy("key").agg(F.count(F.lit(1)).alias("spellings")).where("spellings > 1")
    return spelt.join(many, "key").select("key", "text", "mentions", "best_score", "spellings")


def types(entities: DataFrame) -> DataFrame:
    return entities.groupBy("type").agg(F.count(F.lit(1)).alias("entities"), F.sum("mentions").alias("mentions"), F.round(F.max("best_score"), 6).alias("best_score"))


def per_file(found: DataFrame, mode: str = "orthographic") -> DataFrame:
    """filename, ie_source_count (chunks with an entity), entity_mentions, unique_entities, entity_density."""
    by_chunk = found.groupBy("filename", "doc_id", "ord", t.cluster_key(F.col("text"), F.col("kind"), mode).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    keys = by_chunk.groupBy("filename", "key").agg(F.sum("n").alias("n")).groupBy("filename").agg(F.sum("n").alias("entity_mentions"), F.count(F.lit(1)).alias("unique_entities"))
    chunks = by_chunk.groupBy("filename", "doc_id", "ord").agg(F.lit(1).alias("one")).groupBy("filename").agg(F.count(F.lit(1)).alias("ie_source_count"))
    return keys.join(chunks, "filename").withColumn("entity_density", F.round(F.col("entity_mentions") / F.col("ie_source_count"), 6))


def acronym(c: Column) -> Column:
    """First letters of the words with two letters or more, if there are two of them; else null."""
    parts = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) >= 2)
    return F.when(F.size(parts) >= 2, F.array_join(F.transform(parts, lambda x: F.substring(x, 1, 1)), ""))


def match_rank(c: Column, query: str) -> Column:
    """0 equal (as written, compact or as acronym 1), 1 the name is in the query, 2 the query is in the name; null: no match."""
    q = query.strip().lower()
    low, small = F.lower(c), t.compact_ascii(c)
    qc = "".join(x for x in q if x.isascii() and x.isalnum())
    ladder = F.when(low == q, 0)
    if qc:
        ladder = ladder.when(small == qc, 0)
    ladder = ladder.when((F.length(low) >= 3) & F.contains(F.lit(q), low), 1)
    if qc:
        ladder = ladder.when(acronym(c) == qc, 1)
    ladder = ladder.when(F.contains(low, F.lit(q)), 2)
    return ladder.when(F.contains(small, F.lit(qc)), 2) if qc else ladder


def search(entities: DataFrame, query: str, k: int = 20) -> DataFrame:
    """Entities that match a query, by (match, mentions, name)."""
    hit = entities.withColumn("match_rank", match_rank(F.col("text"), query)).where("match_rank is not null")
    return hit.orderBy("match_rank", F.desc("mentions"), F.lower("text"), "key").limit(k).select("match_rank", "key", "text", "type", "mentions")


def sources_with(found: DataFrame, chunks: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """Chunks with an entity of this name, by lower-case or compact form."""
    want = F.lit(name)
    own = found.where((F.lower("text") == F.lower(want)) | (t.compact_unicode(F.col("text")) == t.compact_unicode(want)))
    if kind:
        own = own.where(F.lower("kind") == kind.lower())
    return chunks.join(own.select("doc_id", "ord").distinct(), ["doc_id", "ord"], "left_semi")


def keys_per_chunk(found: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(doc_id, ord, keys): the sorted keys of every chunk with two or more; of these few nodes only, if there are any given."""
    keyed = found.select("doc_id", "ord", t.cluster_key(F.col("text"), F.col("kind")).alias("key"))
    if nodes is not None:
        keyed = keyed.join(F.broadcast(nodes.select("key")), "key", "left_semi")
    return keyed.groupBy("doc_id", "ord").agg(F.array_sort(F.collect_set("key")).alias("keys")).where(F.size("keys") > 1)


def nodes(entities: DataFrame, most: int | None = None) -> DataFrame:
    """All entities, or the first ``most``: so few that they may be broadcast."""
    if most is not None:
        entities = entities.orderBy(F.desc("mentions"), F.lower("text"), "first").limit(most)
    return entities.select("key", "text", "type", "mentions")


def co_occurrence(found: DataFrame, graph_nodes: DataFrame | None = None, least: int = 3) -> DataFrame:
    """Undirected edges between all entities, or these few nodes: source < target, weight = chunks that hold both. A chunk's pairs are made one by one."""
    rows = keys_per_chunk(found, graph_nodes)
    lefts = rows.select("keys", F.posexplode("keys").alias("i", "source"))
    pairs = lefts.select("source", F.explode(F.slice("keys", F.col("i") + 2, F.size("keys"))).alias("target"))
    each = pairs.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))
    return each.where(F.col("weight") >= least).withColumn("label", F.lit("co_occurs"))


def relations(found: DataFrame, k: int = 20) -> DataFrame:
    """Directed relations between one mention and the next of its chunk: head, tail, label, mentions; endpoints are named by their entity."""
    keyed = found.withColumn("key", t.cluster_key(F.col("text"), F.col("kind")))
    after = F.lead("key").over(Window.partitionBy("doc_id", "ord", "kind").orderBy("pos"))
    pairs = keyed.withColumn("tail_key", after).where("tail_key is not null and tail_key <> key")
    each = pairs.groupBy(F.col("key").alias("head_key"), "tail_key").agg(F.count(F.lit(1)).alias("mentions"), F.round(F.max("score"), 6).alias("best_score"))
    return each.orderBy(F.desc("mentions"), "head_key", "tail_key").limit(k).withColumn("label", F.lit("rel"))


def neighbours(edges: DataFrame, centre: str, hops: int = 2) -> DataFrame:
    """Nodes within ``hops`` of the centre: every edge of a frontier to another node adds weight / depth.

    A loop of joins whose number is ``hops``; edges are those of a bounded graph or of any table of this shape.
    """
    both = edges.select(F.col("source").alias("u"), F.col("target").alias("v"), "weight").union(edges.select("target", "source", "weight"))
    spark = edges.sparkSession
    seen = spark.createDataFrame([(centre, 0)], "v string, depth int")
    frontier, scores = seen, None
    for depth in range(1, hops + 1):
        step = both.join(frontier.select(F.col("v").alias("u")), "u").where(F.col("v") != centre)
        gained = step.select("v", (F.col("weight") / depth).alias("gain"), F.lit(depth).alias("depth"))
        scores = gained if scores is None else scores.union(gained)
        frontier = step.select("v").distinct().join(seen.select("v"), "v", "left_anti").withColumn("depth", F.lit(depth))
        seen = seen.union(frontier)
    return scores.groupBy("v").agg(F.round(F.sum("gain"), 6).alias("score"), F.min("depth").alias("depth")).withColumnRenamed("v", "key")


def totals(entities: DataFrame, kind: str | None = None, least: int = 2) -> DataFrame:
    """unique_entities and entity_mentions of a type (any case) or of all, whatever their mentions, and how many reach ``least``."""
    own = entities.where(F.lower("type") == kind.lower()) if kind else entities
    return own.agg(F.count(F.lit(1)).alias("unique_entities"), F.coalesce(F.sum("mentions"), F.lit(0)).alias("entity_mentions"), F.count_if(F.col("mentions") >= least).alias("ranked"))


def per_file_of(found: DataFrame, kind: str, least: int = 2, mode: str = "orthographic") -> DataFrame:
    """per_file for the entities of one type and at least ``least`` mentions; ie_source_count still counts chunks with any entity."""
    own = per_file(found.where(F.lower("kind") == kind.lower()), mode).drop("ie_source_count", "entity_density").where(F.col("entity_mentions") >= least)
    chunks = found.groupBy("filename", "doc_id", "ord").agg(F.lit(1).alias("one")).groupBy("filename").agg(F.count(F.lit(1)).alias("ie_source_count"))
    return own.join(chunks, "filename").withColumn("entity_density", F.round(F.col("entity_mentions") / F.col("ie_source_count"), 6))


def distinct_per_chunk(found: DataFrame) -> DataFrame:
    """Each entity of a chunk once in any case, in the casing of its first place."""
    return found.groupBy("doc_id", "ord", F.lower("text").alias("low"), F.lower("kind").alias("low_kind")).agg(F.min_by("text", "pos").alias("text"), F.min("pos").alias("pos")).drop("low")


def alias_index(stored: DataFrame) -> DataFrame:
    """(surface, low_kind, entity_id, canonical) of stored entities (entity_id, canonical, kind, aliases); a surface of several entities is the least id's."""
    each = stored.select("entity_id", "canonical", F.lower("kind").alias("low_kind"), F.explode(F.array_union("aliases", F.array("canonical"))).alias("surface"))
    each = each.select(F.lower(t.strip(F.col("surface"))).alias("surface"), "low_kind", "entity_id", "canonical").where("surface <> ''")
    return each.groupBy("surface", "low_kind").agg(F.min(F.struct("entity_id", "canonical")).alias("e")).select("surface", "low_kind", "e.*")


def siblings(index: DataFrame, name: str) -> DataFrame:
    """All surfaces of the entities that have this one."""
    own = index.where(F.col("surface") == name.strip().lower()).select("entity_id").distinct()
    return index.join(own, "entity_id", "left_semi").select("entity_id", "surface", "low_kind")


def aggregate_resolved(found: DataFrame, index: DataFrame) -> DataFrame:
    """aggregate() where a surface that the index knows counts for its entity (key ``ent::id``) under the stored name."""
    keyed = found.withColumns({"surface": F.lower(t.strip(F.col("text"))), "low_kind": F.lower("kind")}).join(index, ["surface", "low_kind"], "left")
    keyed = keyed.withColumn("key", F.coalesce(F.concat(F.lit("ent::"), "entity_id"), t.cluster_key(F.col("text"), F.col("kind"))))
    names = index.groupBy(F.concat(F.lit("ent::"), "entity_id").alias("key")).agg(F.min("canonical").alias("canonical"))
    return aggregate(keyed).join(names, "key", "left").withColumn("text", F.coalesce("canonical", "text")).drop("canonical")


def endpoints(relations_: DataFrame, found: DataFrame) -> DataFrame:
    """Relations (doc_id, ord, head, label, tail, score) whose ends are named by entities: head_key, label, tail_key, mentions, best_score.

    An end takes the key that its text has in its chunk, else its compact form there, else the text's and the compact form's
    among all mentions, each only if there is one such key; else it is its own lower-case text. Relations without an end are none.
    The forms of a chunk are kept, as eight lookups read them.
    """
    m = normalized(found).select("doc_id", "ord", F.lower("text").alias("low"), t.compact_ascii(F.col("text")).alias("small"), t.cluster_key(F.col("text"), F.col("kind")).alias("key")).distinct()
    m = keep(m, "forms")

    def only(by: list[str], name: str) -> DataFrame:
        return m.where(F.col(by[-1]) != "").groupBy(*by).agg(F.min("key").alias(name), F.max("key").alias("most")).where(F.col(name) == F.col("most")).drop("most")

    chunk = ["doc_id", "ord"]
    r = relations_.select(*chunk, t.strip(F.col("head")).alias("head"), F.coalesce(t.non_blank(F.col("label")), F.lit("rel")).alias("label"), t.strip(F.col("tail")).alias("tail"), F.col("score").try_cast("double").alias("score"))
    r = r.where("head <> '' and tail <> ''")
    for end in ("head", "tail"):
        r = r.withColumns({"low": F.lower(end), "small": t.compact_ascii(F.col(end))})
        for by, place in ((chunk, "l"), ([], "g")):
            for form in ("low", "small"):
                r = r.join(only([*by, form], f"{place}_{form}"), [*by, form], "left")
        r = r.withColumn(f"{end}_key", F.coalesce("l_low", "l_small", "g_low", "g_small", "low")).drop("l_low", "l_small", "g_low", "g_small", "low", "small")
    return r.groupBy("head_key", F.lower("label").alias("label"), "tail_key").agg(F.count(F.lit(1)).alias("mentions"), F.max("score").alias("best_score"))
