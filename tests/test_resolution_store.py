"""Resolution into a store against one loop over the surfaces, with ties, abstentions and a second run."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import nearness, resolution

ENTITY, ALIAS, SURFACE = "entity_id string, canonical_name string, type string, embedding array<double>", "entity_id string, surface string, type string", "surface string, entity_type string, mentions long, embedding array<double>"


def cosine(a, b):
    return round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 6)


def loop(entities, aliases, surfaces, reply, threshold, k):
    entities, known, cache, out = list(entities), {(s, t): e for e, s, t in aliases}, {}, {}
    for s, t, _, v in sorted(surfaces, key=lambda x: (-x[2], x[0], x[1])):
        key = (s.strip().lower(), t.lower())
        if key in cache:
            out[s, t] = cache[key], "cache"
            continue
        if (s, t) in known:
            e, how = known[s, t], "skipped"
        else:
            near = sorted(((-cosine(v, x[3]), i) for i, x in enumerate(entities) if x[2] == t and cosine(v, x[3]) >= threshold))[:k]
            found = [entities[i] for _, i in near]
            if len(found) > 1 and reply:
                tokens = re.findall(r"[\w-]+", reply(s, [x[0] for x in found]))
                named = [x[0] for x in found if x[0] in tokens]
                e, how = (named[0], "vector_llm") if len(named) == 1 else (None, "minted")
            elif found:
                e, how = found[0][0], "vector_single" if len(found) == 1 else "vector_topk"
            else:
                e, how = None, "minted"
            if how == "minted":
                e = f"{t}-{s}".replace(" ", "_")
                entities.append((e, s, t, v))
        cache[key], out[s, t] = e, (e, how)
    return out, entities


def run(spark, entities, aliases, surfaces, decide, **how):
    return resolution.resolve_into(spark.createDataFrame(entities, ENTITY), spark.createDataFrame(aliases, ALIAS), spark.createDataFrame(surfaces, SURFACE).repartition(3), decide, **how)


def compare(got, want, surfaces):
    rows = {(r.surface, r.entity_type): r for r in got.surfaces.collect()}
    assert {x: r.method for x, r in rows.items()} == {x: how for x, (_, how) in want.items()}
    place = {}
    for x, (e, _) in want.items():  # the same ids, whatever they are called
        assert place.setdefault(rows[x].entity_id, e) == e
    assert len(set(place.values())) == len(place)
    n = got.counts.first()
    methods = [how for _, how in want.values()]
    assert (n.processed, n.minted, n.skipped) == (len(surfaces), methods.count("minted"), methods.count("skipped")) and n.attached == n.processed - n.minted - n.skipped
    assert n.entities_touched == len(place)


@pytest.mark.parametrize("answers", ["none", "mixed"])
def test_resolution_equals_one_loop(spark, answers, monkeypatch):
    monkeypatch.setattr(nearness, "FEW", 16)
    r = random.Random(4)
    vector = lambda: [r.gauss(0, 1) for _ in range(3)]
    surfaces = {(f"Name {i}", r.choice(["loc", "loc", "org"])): (r.randrange(6), vector()) for i in range(45)}
    surfaces |= {(f" nAME {i} ", "loc"): (r.randrange(6), vector()) for i in range(0, 30, 3)} | {("Name 1", "LOC"): (3, vector())}
    surfaces = [(s, t, m, v) for (s, t), (m, v) in surfaces.items()]
    entities = [(f"e-{i}", f"E {i}", r.choice(["loc", "org"]), vector()) for i in range(9)]
    aliases = [(f"e-{i}", f"Name {3 * i}", entities[i][2]) for i in range(9)] + [("e-1", "E 1", entities[1][2])]
    if answers == "none":
        decide = reply = None
    else:
        # by the surface and the first candidate's name, as ids of minted ones differ from the loop's
        even = lambda s: len(s) % 2 == 0
        reply = lambda s, ids: f"it is {ids[0]}." if even(s) else "NONE"
        pick = F.length("surface") % 2 == 0
        decide = lambda ties: ties.select("pos", F.when(pick, F.concat(F.lit("it is "), F.element_at("candidates", 1)["entity_id"], F.lit("."))).otherwise("NONE").alias("reply"))
    want, after = loop(entities, aliases, surfaces, reply, 0.8, 3)
    got = run(spark, entities, aliases, surfaces, decide, threshold=0.8, k=3)
    compare(got, want, surfaces)
    assert {"minted", "skipped", "cache", "vector_single"} <= {how for _, how in want.values()} and got.entities.count() == len(after)
    again = resolution.resolve_into(got.entities, got.aliases, spark.createDataFrame(surfaces, SURFACE), decide, threshold=0.8, k=3)
    n = again.counts.first()
    assert (n.minted, n.skipped + n.attached) == (0, len(surfaces)) and {r.method for r in again.surfaces.collect()} <= {"skipped", "cache"}
    assert again.entities.count() == got.entities.count() and again.aliases.count() == got.aliases.count()


def test_one_several_abstaining_and_disabled_ties(spark):
    replies = [("e-1-{}", "vector_llm", "e-1-{}"), ("I think e-12-{}, yes", "vector_llm", "e-12-{}"), ("NONE", "minted", None), ("e-1-{0} e-12-{0}", "minted", None), ("e-2-{0} or e-12-{0}3", "minted", None), (None, "minted", None)]
    entities = [(f"{e}-{k}", name, f"t{k}", v) for k in range(len(replies)) for e, name, v in (("e-1", "Berlin", [1.0, 0.0]), ("e-12", "Berlin City", [0.98, 0.1]))] + [("p", "Berlin", "person", [1.0, 0.0])]
    surfaces = [("berlin", f"t{k}", 1, [0.99, 0.02]) for k in range(len(replies))] + [("berlin", "person", 1, [0.99, 0.02])]
    said = F.create_map(*(F.lit(x) for k, (r, _, _) in enumerate(replies) for x in (f"t{k}", r and r.format(k))))
    asked = []

    def decide(ties):
        asked.extend(r.entity_type for r in ties.select("entity_type").collect())
        return ties.select("pos", said[F.col("entity_type")].alias("reply"))

    got = {r.entity_type: r for r in run(spark, entities, [], surfaces, decide, threshold=0.9).surfaces.collect()}
    for k, (_, method, entity) in enumerate(replies):
        assert got[f"t{k}"].method == method and (entity is None or got[f"t{k}"].entity_id == entity.format(k))
    assert (got["person"].method, got["person"].entity_id) == ("vector_single", "p") and sorted(asked) == [f"t{k}" for k in range(len(replies))]  # each once, and no single one
    got = run(spark, entities, [], surfaces[:1], None, threshold=0.9).surfaces.first()
    assert (got.method, got.entity_id) == ("vector_topk", "e-1-0")
    assert run(spark, [], [], [], None).counts.first().processed == 0


def test_most_mentioned_is_canonical_and_types_stay_apart(spark):
    got = run(spark, [], [], [("United States", "loc", 2, [0.98, 0.2]), ("USA", "loc", 5, [1.0, 0.0]), ("USA", "org", 1, [1.0, 0.0])], None)
    assert {(e.canonical_name, e.type) for e in got.entities.collect()} == {("USA", "loc"), ("USA", "org")}
    assert {a.surface for a in got.aliases.where("type = 'loc'").collect()} == {"USA", "United States"}
