"""Summaries under a budget against one loop that makes its calls in turn; plugs that fail."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import plugs, summary

UNITS = "unit_key string, kind string, label string, position long, fingerprint string"
CHUNKS = "unit_key string, ord long, chunk_id string, text string"
CACHE = "unit_key string, fingerprint string, summary string, evidence_ids array<string>"


def answer(prompt):
    return f"S{hashlib.md5(prompt.encode()).hexdigest()[:8]}"


def complete(df):
    return df.select("*", F.concat(F.lit("S"), F.substring(F.md5("prompt"), 1, 8), F.lit("\nEVIDENCE_INDICES: 9, 2,1,")).alias("response"), F.lit(None).cast("string").alias("error")).drop("prompt")


class Loop:
    """The calls one after another, each counted before it is made."""

    def __init__(self, budget, chars, fan_in):
        self.budget, self.chars, self.fan_in, self.calls, self.partial = budget, chars, fan_in, 0, False

    def full(self):
        return self.calls >= self.budget

    def say(self, prompt):
        self.calls += 1
        return answer(prompt)

    def unit(self, label, chunks):
        usable = [(i, x.strip()[: self.chars]) for i, x in chunks if x and x.strip()]
        packs = []
        for i, x in usable:
            if not packs or sum(len(y) for _, y in packs[-1]) + len(x) > self.chars:
                packs.append([])
            packs[-1].append((i, x))
        said, ids, cut = [], [], False
        for pack in packs:
            if self.full():
                cut = self.partial = True
                break
            block = "\n\n".join(f"[{k}] {x}" for k, (_, x) in enumerate(pack, 1))
            said.append(self.say(f"M{label}|{block}"))
            named = [pack[k][0] for k in (1, 0) if k < len(pack)]
            ids += [i for i in named if i not in ids]
        if not said:
            return None
        text = said[0]
        if len(said) > 1 and self.full():
            cut = self.partial = True
            text = "\n\n".join(said)
        elif len(said) > 1:
            text = self.say("F" + "\n".join(f"- {s}" for s in said)) + "\nEVIDENCE_INDICES: 9, 2,1,"
        return text, ids[:2], False, cut

    def build(self, units, chunks, cache):
        got = {u[0]: (*cache[u[0], u[4]], True, False) for u in units if (u[0], u[4]) in cache}
        for u in units:
            if u[0] in got:
                continue
            if self.full():
                self.partial = True
                break
            if one := self.unit(u[2], chunks.get(u[0], [])):
                got[u[0]] = one
        briefs = [f"- {'Document' if u[1] == 'document' else 'Posts'}: {u[2]}\n  {got[u[0]][0]}" for u in units if u[0] in got]
        folds = []
        while len(briefs) > self.fan_in:
            folded, stopped = [], False
            for i in range(0, len(briefs), self.fan_in):
                if self.full():
                    stopped = self.partial = True
                    break
                folded.append(self.say("F" + "\n\n".join(briefs[i : i + self.fan_in])) + "\nEVIDENCE_INDICES: 9, 2,1,")
            if folded:
                folds.append(folded)
            briefs = folded or briefs[: self.fan_in]
            if stopped:
                break
        last = self.say("Z" + f"{len(got)}/{len(units)}/{str(self.partial).lower()}" + "\n\n".join(briefs)) if units else ""
        return got, folds, (last + "\nEVIDENCE_INDICES: 9, 2,1," if units else "", len(got), len(units), self.partial, self.calls)


PROMPTS = summary.Prompts(
    lambda label, block: F.concat(F.lit("M"), label, F.lit("|"), block), lambda block: F.concat(F.lit("F"), block),
    lambda briefs, covered, total, partial: F.concat(F.lit("Z"), covered.cast("string"), F.lit("/"), total.cast("string"), F.lit("/"), partial.cast("string"), F.array_join(briefs, "\n\n")),
)


def check(spark, units, chunks, cache, **how):
    rows = [(u, k, f"{u}-{k}", x) for u, xs in chunks.items() for k, x in enumerate(xs)]
    got = summary.build(
        spark.createDataFrame(units, UNITS).orderBy(F.rand(1)), spark.createDataFrame(rows, CHUNKS).orderBy(F.rand(2)), complete,
        spark.createDataFrame([(*k, *v) for k, v in cache.items()], CACHE), prompts=PROMPTS, **how,
    )
    loop = Loop(how["max_calls"], how["window_chars"], how["fan_in"])
    want, folds, totals = loop.build(sorted(units, key=lambda u: u[3]), {u: [(f"{u}-{k}", x) for k, x in enumerate(xs)] for u, xs in chunks.items()}, cache)
    assert {r.unit_key: (r.summary, list(r.evidence_ids), r.from_cache, r.truncated) for r in got.units.collect()} == want
    assert tuple(got.totals.first()) == totals
    tiers = {(r.tier, r.position): r.brief for r in got.tiers.collect()}
    assert tiers == {(i, k): x for i, fold in enumerate(folds, 1) for k, x in enumerate(fold)}
    assert {r.unit_key for r in got.fresh.collect()} == {u for u, x in want.items() if not x[2] and not x[3]}


@pytest.mark.parametrize("budget", [0, 7, 31, 1000])
def test_build_equals_calls_in_turn(spark, budget):
    r = random.Random(budget)
    units = [(f"u{i:02d}", r.choice(["document", "social_bucket"]), f"label {i}", 100 - 3 * i, f"f{i}") for i in range(14)]
    chunks = {u[0]: ["x" * r.choice([5, 20, 60, 99, 140, 300]) + str(i) for i in range(r.choice([0, 1, 1, 2, 4, 6]))] for u in units}
    chunks |= {"u03": [" ", "\n"], "u04": ["  one ", " ", "two"]}
    cache = {("u05", "f5"): ("kept five", ["e"]), ("u06", "other"): ("old", []), ("u13", "f13"): ("kept", [])}
    check(spark, units, chunks, cache, max_calls=budget, window_chars=100, fan_in=3)


def test_a_tier_keeps_the_folds_it_has_paid_for(spark):
    units = [(f"u{i:02d}", "document", "l", i, f"f{i}") for i in range(10)]
    cache = {(u[0], u[4]): (f"s{u[0]}", []) for u in units}
    for budget in (0, 4, 9):
        check(spark, units, {}, cache, max_calls=budget, window_chars=100, fan_in=2)
    check(spark, [], {}, {}, max_calls=5, window_chars=100, fan_in=2)


def test_failing_units_are_not_covered_and_a_failing_fold_is_an_error(spark):
    units = spark.createDataFrame([(u, "document", u, i, "f") for i, u in enumerate("abc")], UNITS)
    chunks = spark.createDataFrame([(u, k, f"{u}{k}", "x" * 80) for u in "abc" for k in range(2)], CHUNKS)

    def failing(on):
        def call(client, rows):
            if any(on in r["prompt"] for r in rows):
                raise RuntimeError("model down")
            return ["ok\nEVIDENCE_INDICES: 1" for _ in rows]

        return plugs.completer(plugs.Plug(call, retries=0))

    got = summary.build(units, chunks, failing("Mb"), window_chars=100, prompts=PROMPTS)
    assert {r.unit_key: list(r.evidence_ids) for r in got.units.collect()} == {"a": ["a0", "a1"], "c": ["c0", "c1"]}
    assert got.totals.first()[1:] == (2, 3, False, 6 + 2 + 1)
    with pytest.raises(RuntimeError, match="model down"):
        summary.build(units, chunks, failing("Z"), window_chars=100, prompts=PROMPTS)


def test_plugs_isolate_failing_rows(spark):
    def call(client, rows):
        assert client == "client"
        if any(r["x"] is None or r["x"] % 10 == 3 for r in rows):
            raise ValueError("bad " + "y" * 600)
        return [r["x"] * 2 for r in rows]

    df = spark.createDataFrame([(i, f"n{i}") for i in range(40)] + [(None, "null")], "x long, name string").repartition(3)
    plug = plugs.Plug(call, "long", lambda: "client", batch=8, retries=2)
    good, failed = plugs.split(plugs.enrich(df, ["x"], plug, "double"))
    assert {r.x: r.double for r in good.collect()} == {i: 2 * i for i in range(40) if i % 10 != 3}
    bad = failed.collect()
    assert {r.x for r in bad} == {3, 13, 23, 33, None} and all(r.double is None and r.error.startswith("ValueError: bad y") and len(r.error) == 512 for r in bad)
    assert good.count() + failed.count() == df.count() and good.columns == ["x", "name", "double", "calls"]
    short = plugs.Plug(lambda client, rows: [1], "long", retries=0)
    assert {r.error for r in plugs.enrich(df, ["x"], short).collect()} == {None}  # alone, each row gets its one answer
    wrong = plugs.Plug(lambda client, rows: ["text"] * len(rows), "long", retries=0)
    assert all("Arrow" in r.error for r in plugs.enrich(df, ["x"], wrong).collect())
    assert plugs.enrich(df.limit(0), ["x"], plug).count() == 0
