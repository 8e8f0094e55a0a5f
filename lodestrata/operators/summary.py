"""Map-reduce summaries: units, fingerprints, windows, tiers, budgets and the cache of finished maps."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import labels as lb
from ..functions import text as t
from .kept import keep


def units(points: DataFrame, unit_key: Column, order: list[str], text: str = "text") -> DataFrame:
    """unit_key, members, fingerprint: the hash of the ordered members' hashes, the same for any order of the input.

    Only 16 letters of each member's hash are gathered. Where a unit may hold very many members, give a key
    that splits it (units of units).
    """
    each = points.select(unit_key.alias("unit_key"), F.struct(*order, t.short_hash(F.coalesce(F.col(text), F.lit(""))).alias("h")).alias("m"))
    return each.groupBy("unit_key").agg(F.count(F.lit(1)).alias("members"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["h"]), "|"), 256).alias("fingerprint"))


def stale(new: DataFrame, cache: DataFrame) -> DataFrame:
    """Units to map again: not in the cache, or with another fingerprint."""
    return new.join(cache.select("unit_key", "fingerprint"), ["unit_key", "fingerprint"], "left_anti")


def windows(chunks: DataFrame, unit: str, order: str, size: str, most: int) -> DataFrame:
    """Greedy packing of each unit's chunks, in order, into windows of at most ``most``; a larger chunk has a window of its own.

    The running sum starts anew at every overflow, so a unit is folded in one pass by one task.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        at, used, out = 0, 0, []
        for n in pdf[size]:
            if used and used + n > most:
                at, used = at + 1, 0
            used += int(n)
            out.append(at)
        return pdf[[unit, order]].assign(window=out)

    kinds = dict(chunks.dtypes)
    return chunks.select(unit, order, size).groupBy(unit).applyInPandas(pack, f"{unit} {kinds[unit]}, {order} {kinds[order]}, window int")


def tiers(units_: DataFrame, fan_in: int = 10) -> DataFrame:
    """How many summaries each level of a reduce has: (tier, inputs, outputs), until one is left."""
    n = units_.agg(F.count(F.lit(1)).cast("long").alias("n"))
    level = F.expr(
        f"aggregate(sequence(1, 20), array(struct(0 as tier, n as inputs, cast(ceil(n / {float(fan_in)}) as bigint) as outputs)), "
        f"(a, i) -> if(element_at(a, -1).outputs <= 1, a, concat(a, array(struct(i as tier, element_at(a, -1).outputs as inputs, cast(ceil(element_at(a, -1).outputs / {float(fan_in)}) as bigint) as outputs)))))"
    )
    return n.select(F.inline(level)).where("inputs > 0")


def allocate(sources: DataFrame, by: str, key: str, size: str, budget: int) -> DataFrame:
    """Water-filling: the shortest first, each gets its size or an equal share of what is left. Sources of one answer are a bounded list."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([size, key])
        left, out = budget, []
        for i, n in enumerate(pdf[size]):
            got = min(int(n), left // (len(pdf) - i))
            left -= got
            out.append(got)
        return pdf[[by, key]].assign(allowance=out)

    kinds = dict(sources.dtypes)
    return sources.select(by, key, size).groupBy(by).applyInPandas(fill, f"{by} {kinds[by]}, {key} {kinds[key]}, allowance long")


class Prompts(NamedTuple):
    """How prompts are worded, as Columns."""

    map: Callable[[Column, Column], Column] = lambda label, block: F.concat(F.lit("Summarise this part of "), label, F.lit(". End with EVIDENCE_INDICES.\n\n"), block)
    fold: Callable[[Column], Column] = lambda block: F.concat(F.lit("Fold these summaries into one.\n\n"), block)
    synthesis: Callable[[Column, Column, Column, Column], Column] = lambda briefs, covered, total, partial: F.concat(
        F.lit("Summarise the collection. Units: "), covered.cast("string"), F.lit(" of "), total.cast("string"), F.when(partial, ", cut short").otherwise(""), F.lit(".\n\n"), F.array_join(briefs, "\n\n")
    )


class Build(NamedTuple):
    """units: (unit_key, kind, label, position, summary, evidence_ids, from_cache, truncated); tiers: (tier, position, brief), one
    table for each level; totals: one row (response, covered, total, partial, calls); fresh: rows for the cache."""

    units: DataFrame
    tiers: DataFrame
    totals: DataFrame
    fresh: DataFrame


def planned(misses: DataFrame, texts: DataFrame, max_calls: int, window_chars: int) -> DataFrame:
    """What the budget allows: (unit_key, position, ..., n windows, start, allowed windows, fold) for units that are begun, in order.

    A unit costs a call for each window and one more to fold several; it begins after the costs of all units before it.
    Each unit with text costs a call at least, so that the first ``max_calls`` of them are all that need be looked at.
    """
    begun = misses.join(texts.select("unit_key").distinct(), "unit_key", "left_semi").orderBy("position").limit(max_calls)
    own = texts.join(begun.select("unit_key"), "unit_key", "left_semi")
    n = windows(own.withColumn("chars", F.length("text")), "unit_key", "ord", "chars", window_chars).groupBy("unit_key").agg((F.max("window") + 1).alias("n"))
    cost = F.col("n") + (F.col("n") > 1).cast("int")
    order = Window.orderBy("position")  # of max_calls rows at most
    start = F.coalesce(F.sum(cost).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return begun.join(n, "unit_key").withColumn("start", start).where(F.col("start") < max_calls).withColumns({
        "allowed": F.least(F.col("n"), F.lit(max_calls) - F.col("start")), "fold": (F.col("n") > 1) & (F.col("start") + F.col("n") < max_calls)})


def mapped(plan: DataFrame, texts: DataFrame, complete: Callable[[DataFrame], DataFrame], prompts: Prompts, window_chars: int) -> tuple[DataFrame, int]:
    """(unit_key, summary, evidence_ids, truncated) of the plan's units whose calls all went well, and how many calls were made."""
    own = texts.join(plan.select("unit_key"), "unit_key", "left_semi")
    at = windows(own.withColumn("chars", F.length("text")), "unit_key", "ord", "chars", window_chars)
    parts = own.join(at, ["unit_key", "ord"]).groupBy("unit_key", "window").agg(F.array_sort(F.collect_list(F.struct("ord", "chunk_id", "text"))).alias("parts"))
    block = F.array_join(F.transform("parts", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["text"])), "\n\n")
    asked = parts.join(plan.select("unit_key", "label", "allowed"), "unit_key").where("window < allowed")
    asked = asked.select("unit_key", "window", F.col("parts.chunk_id").alias("ids"), prompts.map(F.col("label"), block).alias("prompt"))
    told = keep(complete(asked), "mapped")
    each = F.struct("window", lb.without_evidence(F.col("response")).alias("summary"), lb.evidence(F.col("response"), F.col("ids")).alias("ids"))
    units_ = told.groupBy("unit_key").agg(F.array_sort(F.collect_list(each)).alias("w"), F.bool_or(F.col("error").isNotNull()).alias("failed")).where("not failed")
    units_ = units_.join(plan.select("unit_key", "n", "allowed", "fold"), "unit_key").select(
        "unit_key", F.col("w.summary").alias("s"), F.slice(F.array_distinct(F.flatten("w.ids")), 1, 2).alias("evidence_ids"), ((F.col("n") > 1) & ~F.col("fold")).alias("truncated"), "fold")
    lines = F.array_join(F.transform("s", lambda x: F.concat(F.lit("- "), x)), "\n")
    folded = keep(complete(units_.where("fold").select("unit_key", prompts.fold(lines).alias("prompt"))), "folded")
    joined = units_.join(folded.select("unit_key", "response", "error"), "unit_key", "left").where("error is null")
    summary = F.when(F.col("fold"), F.col("response")).otherwise(F.array_join("s", "\n\n"))
    return joined.select("unit_key", summary.alias("summary"), "evidence_ids", "truncated"), told.count() + folded.count()


def failed(told: DataFrame) -> None:
    """A failing fold or synthesis fails the build."""
    bad = told.where("error is not null").select("error").take(1)
    if bad:
        raise RuntimeError(f"a call failed after all units were summarised: {bad[0].error}")


def build(
    units_: DataFrame, chunks: DataFrame, complete: Callable[[DataFrame], DataFrame], cache: DataFrame | None = None, *,
    fan_in: int = 10, max_calls: int = 500, window_chars: int = 12_000, prompts: Prompts = Prompts(),
) -> Build:
    """A summary of all units under a budget of calls that they share.

    units_: (unit_key, kind, label, position, fingerprint), positions being distinct; chunks: (unit_key, ord, chunk_id, text);
    complete: from (..., prompt) to (..., response, error), see plugs.completer; cache: (unit_key, fingerprint, summary, evidence_ids).

    Units in the cache cost nothing. The others are served in the order of their positions: where the budget ends within a unit,
    it is summarised by the windows that were allowed, without a fold, counts as truncated, and is no row for the cache. Blank
    chunks are left out, longer ones than a window are cut to it. A unit one of whose calls fails is not covered; as its windows
    run at once, all of them are spent. Then briefs are folded in groups of ``fan_in``, tier by tier, while the budget lasts:
    a tier that it can't finish keeps the folds it has paid for, or the first ``fan_in`` briefs if there are none.
    The last synthesis is always made. All that is ordered by one task is bounded by max_calls * fan_in rows.
    """
    spark = units_.sparkSession
    total = units_.count()
    none = spark.createDataFrame([], "unit_key string, fingerprint string, summary string, evidence_ids array<string>")
    cache = none if cache is None else cache.select("unit_key", "fingerprint", "summary", "evidence_ids").dropDuplicates(["unit_key", "fingerprint"])
    texts = chunks.select("unit_key", "ord", "chunk_id", F.substring(t.strip(F.col("text")), 1, window_chars).alias("text")).where("text <> ''")
    key = ["unit_key", "fingerprint"]
    misses = units_.join(cache.select(key), key, "left_anti")
    plan = keep(planned(misses, texts, max_calls, window_chars), "plan")
    made, calls = mapped(plan, texts, complete, prompts, window_chars)
    columns = [F.col(c) for c in ("unit_key", "kind", "label", "position", "fingerprint", "summary", "evidence_ids")]
    hits = units_.join(cache, key).select(*columns, F.lit(True).alias("from_cache"), F.lit(False).alias("truncated"))
    results = keep(hits.unionByName(units_.join(made, "unit_key").select(*columns, F.lit(False).alias("from_cache"), "truncated")), "units")
    fresh = results.where("not from_cache and not truncated").select(*cache.columns)

    spent = plan.agg(F.coalesce(F.sum(F.col("allowed") + F.col("fold").cast("int")), F.lit(0)), F.max("position")).first()
    late = misses if spent[1] is None else misses.where(F.col("position") > F.lit(spent[1]))
    partial = spent[0] >= max_calls and not late.isEmpty() or not plan.where("n > 1 and not fold").isEmpty()
    n = covered = results.count()
    kind = F.when(F.col("kind") == "document", "Document").otherwise("Posts")
    briefs = results.select("position", F.concat(F.lit("- "), kind, F.lit(": "), "label", F.lit("\n  "), "summary").alias("brief"))
    levels = []
    while n > fan_in:
        groups, room = -(-n // fan_in), max(0, max_calls - calls)
        n = min(groups, room)
        partial |= n < groups
        if not n:
            break
        taken = briefs.orderBy("position").limit(n * fan_in).withColumn("group", F.floor((F.row_number().over(Window.orderBy("position")) - 1) / fan_in))
        block = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "brief"))), lambda x: x["brief"]), "\n\n")
        told = keep(complete(taken.groupBy("group").agg(prompts.fold(block).alias("prompt"))), "tier")
        failed(told)
        calls += n
        briefs = told.select(F.col("group").alias("position"), F.col("response").alias("brief"))
        levels.append(briefs.select(F.lit(len(levels) + 1).alias("tier"), F.col("position").cast("long").alias("position"), "brief"))
        if n < groups:
            break
    last = briefs.orderBy("position").limit(max(fan_in, n))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "brief"))), lambda x: x["brief"])
    said = last.agg(prompts.synthesis(listed, F.lit(covered), F.lit(total), F.lit(partial)).alias("prompt")).where(F.lit(total > 0))
    said = keep(complete(said), "synthesis")
    failed(said)
    response = said.select("response").first()
    totals = spark.createDataFrame([(response[0] if response else "", covered, total, partial, calls + (total > 0))], "response string, covered long, total long, partial boolean, calls long")
    empty = spark.createDataFrame([], "tier int, position long, brief string")
    return Build(results.drop("fingerprint"), reduce(DataFrame.unionByName, levels, empty), totals, fresh)
