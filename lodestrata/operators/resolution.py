"""Entity resolution: surfaces become canonical entities, one type at a time.

The rule is sequential (a surface may attach to what an earlier one minted), but who mints is a greedy choice that
Spark rounds settle (see nearness); the others then meet what was minted before them, in blocks of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import nearness
from .kept import keep

RESOLVED = "surface string, entity_type string, entity_id string, action string, similarity double"


@F.pandas_udf(T.StringType())
def alias(surface: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([f"{k.lower()}:{s.strip().casefold()}" for s, k in zip(surface, kind)], dtype=object)


def resolve(surfaces: DataFrame, threshold: float = 0.86, k: int = 5) -> DataFrame:
    """(surface, entity_type, mentions, embedding) in the order (-mentions, surface): a surface met before in any case is skipped,
    one near an entity of its type is attached to the nearest, any other mints one."""
    s = surfaces.select("surface", "entity_type", "mentions", F.col("embedding").alias("v"), F.lower("entity_type").alias("g"), alias("surface", "entity_type").alias("alias"))
    s = nearness.numbered(s, [F.col("g"), F.desc("mentions"), F.col("surface"), F.col("entity_type")]).drop("mentions")
    firsts = nearness.keep(s.groupBy("g", "alias").agg(F.min("pos").alias("pos")))
    r = nearness.keep(s.join(firsts.select("pos"), "pos", "left_semi").select("g", "pos", "v"))
    minted = nearness.keep(nearness.independent(r, threshold, digits=6))
    near = nearness.nearest_before(r.join(minted.select("pos"), "pos", "left_anti"), minted, 6)
    fate = minted.select("pos", F.col("pos").alias("to"), F.lit("minted").alias("action"), F.lit(0.0).alias("similarity"))
    fate = fate.unionByName(near.select("pos", "to", F.lit("attached").alias("action"), "similarity"))
    entity = minted.select(F.col("pos").alias("to")).join(firsts.select(F.col("pos").alias("to"), F.substring(F.sha2("alias", 256), 1, 16).alias("entity_id")), "to")
    fate = nearness.keep(firsts.join(fate.join(entity, "to"), "pos").select("g", "alias", F.col("pos").alias("first"), "entity_id", "action", "similarity"))
    skipped = F.col("pos") != F.col("first")
    return s.join(fate, ["g", "alias"]).select(
        "surface", "entity_type", "entity_id", F.when(skipped, "skipped").otherwise(F.col("action")).alias("action"), F.when(skipped, 1.0).otherwise(F.col("similarity")).alias("similarity"),
    )


class Resolved(NamedTuple):
    """surfaces: (surface, entity_type, entity_id, action, method, similarity); entities and aliases: the store after the run, in
    resolve_into()'s form; counts: one row (processed, minted, attached, skipped, entities_touched)."""

    surfaces: DataFrame
    entities: DataFrame
    aliases: DataFrame
    counts: DataFrame


def chosen_by_reply(reply: Column, candidates: Column) -> Column:
    """The candidates' only id that is a word of the reply; null if there is none or several."""
    words = F.regexp_extract_all(F.coalesce(reply, F.lit("")), F.lit(r"(?U)([\w-]+)"), 1)
    named = F.filter(candidates, lambda c: F.array_contains(words, c["entity_id"]))
    return F.when(F.size(named) == 1, F.element_at(named, 1)["entity_id"])


def question(surface: Column, candidates: Column) -> Column:
    line = F.transform(candidates, lambda c, i: F.concat((i + 1).cast("string"), F.lit(". id="), c["entity_id"], F.lit(" name="), c["canonical_name"], F.lit(" type="), c["type"]))
    return F.concat(F.lit("Which of these is meant? Answer with its id, or NONE.\n\nSurface form: "), surface, F.lit("\nCandidates:\n"), F.array_join(line, "\n"))


def candidates_of(rows: DataFrame, entities: DataFrame, threshold: float, k: int) -> DataFrame:
    """(pos, found): of each row the k most similar entities of its group before it at the threshold or more, as (-similarity, to)."""

    def best(p: np.ndarray, q: np.ndarray, s: np.ndarray) -> dict[str, np.ndarray]:
        i, j, v = nearness.near(s, threshold, 6)
        use = p[i] > q[j]
        i, j, v = i[use], j[use], v[use]
        order = np.lexsort((j, -v, i))
        i, j, v = i[order], j[order], v[order]
        use = np.arange(len(i)) - np.searchsorted(i, i) < k
        return {"pos": p[i[use]], "minus": -v[use], "to": q[j[use]]}

    found = nearness.meet(rows, entities, best, "pos long, minus double, to long")
    return found.groupBy("pos").agg(F.slice(F.sort_array(F.collect_list(F.struct("minus", "to"))), 1, k).alias("found"))


def resolve_into(
    entities: DataFrame, aliases: DataFrame, surfaces: DataFrame, decide: Callable[[DataFrame], DataFrame] | None = None, *,
    threshold: float = 0.86, k: int = 5, case_normalize: bool = True,
) -> Resolved:
    """Surfaces resolved against a store, in the order (-mentions, surface), and merged into it; a second run skips all.

    entities: (entity_id, canonical_name, type, embedding); aliases: (entity_id, surface, type); surfaces: (surface, entity_type,
    mentions, embedding). A surface that is an alias of its type already is skipped. Others look for entities of their
    type, stored or minted before them, among the k most similar those at the threshold: none mints one, a single one is taken, and of
    several ``decide`` names one or none, which mints (without decide the most similar is taken). decide: from (pos, surface, entity_type,
    candidates, prompt) to (pos, reply); no question is asked twice. A surface that differs from an earlier one in case (if
    ``case_normalize``) and outer blanks only goes where that one went.

    Who mints is a choice that Spark rounds settle: a guess, made as if nobody abstained, is corrected until it agrees with
    itself, and as rows depend on earlier ones only, that is the result of the sequential rule. Rows meet entities in blocks.
    """
    norm = F.lower(F.trim("surface")) if case_normalize else F.trim("surface")
    s = surfaces.select("surface", "entity_type", "mentions", F.col("embedding").alias("v"), F.col("entity_type").alias("g"), F.struct(F.lower("entity_type"), norm).alias("key"))
    s = nearness.numbered(s, [F.desc("mentions"), F.col("surface"), F.col("entity_type")]).drop("mentions")
    firsts = keep(s.groupBy("key").agg(F.min("pos").alias("first")), "firsts")
    r = s.join(firsts.select(F.col("first").alias("pos")), "pos", "left_semi")
    known = aliases.groupBy("surface", F.col("type").alias("entity_type")).agg(F.min("entity_id").alias("known"))
    r = keep(r.join(known, ["surface", "entity_type"], "left").select("pos", "surface", "entity_type", "g", "v", "known"), "rows")
    open_ = keep(r.where("known is null").select("g", "pos", "v"), "open")
    stored = entities.select(F.col("type").alias("g"), F.col("embedding").alias("v"), "entity_id", "canonical_name")
    stored = keep(nearness.numbered(stored, [F.col("entity_id")]).withColumn("pos", F.col("pos") - (1 << 62)), "stored")
    new_id = F.substring(F.sha2(F.concat_ws(":", "entity_type", "surface"), 256), 1, 16)
    names = keep(r.where("known is null").select("pos", "g", new_id.alias("entity_id"), F.col("surface").alias("canonical_name")), "names")

    near = candidates_of(open_, stored.select("g", "pos", "v"), threshold, 1).select("pos")
    minted = keep(nearness.independent(keep(open_.join(near, "pos", "left_anti"), "far"), threshold, digits=6).select("pos"), "minted")
    asked = None
    while True:
        chosen = stored.select("g", "pos", "v").unionByName(open_.join(minted, "pos", "left_semi"))
        id_of = stored.select("pos", "entity_id", "canonical_name", "g").unionByName(names.join(minted, "pos", "left_semi").select("pos", "entity_id", "canonical_name", "g"))
        found = candidates_of(open_, chosen, threshold, k).select("pos", F.posexplode("found").alias("i", "c"))
        found = found.select("pos", "i", F.col("c.minus").alias("minus"), F.col("c.to").alias("to")).join(id_of.withColumnRenamed("pos", "to"), "to")
        listed = F.array_sort(F.collect_list(F.struct("i", "entity_id", "canonical_name", F.col("g").alias("type"), (-F.col("minus")).alias("score"))))
        found = keep(found.groupBy("pos").agg(listed.alias("candidates")), "found")
        fate = open_.select("pos").join(found, "pos", "left").withColumn("n", F.coalesce(F.size("candidates"), F.lit(0)))
        top = F.element_at("candidates", 1)["entity_id"]
        if decide is None:
            fate = fate.withColumn("to", F.when(F.col("n") > 0, top))
        else:
            ids = F.transform("candidates", lambda c: c["entity_id"])
            ties = found.where(F.size("candidates") > 1).join(r.select("pos", "surface", "entity_type"), "pos").withColumn("ids", ids)
            if asked is not None:
                ties = ties.join(asked.select("pos", "ids"), ["pos", "ids"], "left_anti")
            ties = ties.withColumn("prompt", question(F.col("surface"), F.col("candidates")))
            replies = ties.select("pos", "ids", "candidates").join(decide(ties.select("pos", "surface", "entity_type", "candidates", "prompt")).select("pos", "reply"), "pos", "left")
            replies = replies.select("pos", "ids", chosen_by_reply(F.col("reply"), F.col("candidates")).alias("named"))
            asked = keep(replies if asked is None else asked.unionByName(replies), "asked")
            fate = fate.withColumn("ids", ids).join(asked, ["pos", "ids"], "left").withColumn("to", F.when(F.col("n") == 1, top).when(F.col("n") > 1, F.col("named")))
        fate = keep(fate.select("pos", "n", "to", F.transform("candidates", lambda c: F.struct(c["entity_id"].alias("entity_id"), c["score"].alias("score"))).alias("candidates")), "fate")
        mints = keep(fate.where("to is null").select("pos"), "minted")
        if mints.join(minted, "pos", "left_anti").isEmpty() and minted.join(mints, "pos", "left_anti").isEmpty():
            break
        minted = mints

    method = F.when(F.col("known").isNotNull(), "skipped").when(F.col("to").isNull(), "minted").when(F.col("n") == 1, "vector_single").otherwise("vector_topk" if decide is None else "vector_llm")
    score = F.element_at(F.filter("candidates", lambda c: c["entity_id"] == F.col("to")), 1)["score"]
    own = r.join(fate, "pos", "left").join(names.select("pos", F.col("entity_id").alias("own")), "pos", "left").select(
        F.col("pos").alias("first"), F.coalesce("known", "to", "own").alias("entity_id"), method.alias("method"), F.when(method == "minted", 0.0).when(method == "skipped", 1.0).otherwise(score).alias("similarity"))
    out = s.join(firsts, "key").join(own, "first").withColumn("again", F.col("pos") != F.col("first"))
    method = F.when(F.col("again"), "cache").otherwise(F.col("method"))
    action = F.when(F.col("again") | F.col("method").startswith("vector"), "attached").otherwise(F.col("method"))
    out = keep(out.select("surface", "entity_type", "entity_id", action.alias("action"), method.alias("method"), F.when(F.col("again"), 1.0).otherwise(F.col("similarity")).alias("similarity"), "v"), "resolved")

    fresh = out.where("action = 'minted'").select("entity_id", F.col("surface").alias("canonical_name"), F.col("entity_type").alias("type"), F.col("v").alias("embedding"))
    all_entities = keep(entities.select("entity_id", "canonical_name", "type", "embedding").unionByName(fresh), "entities")
    new_aliases = out.select("entity_id", "surface").join(all_entities.select("entity_id", "type"), "entity_id")
    all_aliases = keep(aliases.select("entity_id", "surface", "type").unionByName(new_aliases.select("entity_id", "surface", "type")).distinct(), "aliases")
    count = lambda x: F.count_if(F.col("action") == x).alias(x)
    counts = out.agg(F.count(F.lit(1)).alias("processed"), count("minted"), count("attached"), count("skipped"), F.count_distinct("entity_id").alias("entities_touched"))
    return Resolved(out.drop("v"), all_entities, all_aliases, counts)
