"""JSON in the answers of models: found among prose and fences, mended where it was cut short, read into fixed fields.

Brackets and strings are told apart by one pass of a regular expression, and a fold over its tokens counts the depth, so that all of
it stays in Spark's expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as t

TOKENS = r'("[^"]*"|[{}\[\]]|[^"{}\[\]]+|")'


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tokens(c: Column) -> Column:
    """Whole strings, brackets, what lies between, and a quote that never closes; as long together as c. Escaped characters are blanked first."""
    return F.regexp_extract_all(F.regexp_replace(c, r"(?s)\\.", "__"), F.lit(TOKENS), 1)


def step(state: Column, token: Column) -> Column:
    """Depth of brackets and length so far."""
    deeper = F.when(token.isin("{", "["), 1).when(token.isin("}", "]"), -1).otherwise(0)
    return F.struct((state["depth"] + deeper).alias("depth"), (state["n"] + F.length(token)).alias("n"), state["ends"].alias("ends"))


def ends_at_depth(c: Column, depth: int, brackets: tuple[str, ...]) -> Column:
    """How long c is up to each of these closing brackets that leads back to ``depth``."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("ends"))

    def fold(state: Column, token: Column) -> Column:
        new = step(state, token)
        ends = F.when(token.isin(*brackets) & (new["depth"] == depth), F.concat(state["ends"], F.array(new["n"]))).otherwise(state["ends"])
        return F.struct(new["depth"].alias("depth"), new["n"].alias("n"), ends.alias("ends"))

    return F.aggregate(tokens(c), start, fold, lambda s: s["ends"])


def is_json(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def balanced_object(c: Column) -> Column:
    """The object with which c begins; null if it isn't complete and right."""
    right = lambda whole: F.when(is_json(whole), whole)
    return bound(F.get(ends_at_depth(c, 0, ("}",)), F.lit(0)), lambda n: F.when(n.isNotNull(), bound(F.substring(c, F.lit(1), n), right)))


def first_object(c: Column) -> Column:
    """The first complete JSON object in a text, whatever stands around it; null if there is none.

    Each { is tried in turn until one begins an object, so that answers with very many stray brackets take long.
    """
    parts = F.split(c, r"\{", -1)
    start = F.struct(F.lit(None).cast("string").alias("found"), F.length(F.element_at(parts, 1)).alias("at"))

    def attempt(state: Column, part: Column) -> Column:
        here = F.substring(c, state["at"] + 1, F.length(c))
        found = F.when(state["found"].isNotNull(), state["found"]).otherwise(bound(here, balanced_object))
        return F.struct(found.alias("found"), (state["at"] + 1 + F.length(part)).alias("at"))

    return F.when(F.size(parts) > 1, F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), start, attempt, lambda s: s["found"]))


def object_of(answer: Column) -> Column:
    """The JSON object of a model's answer: without its reasoning, the whole if it is one, else the first in it; null if there is none.

    An answer that is other JSON (a list, a number) holds none.
    """
    bare = t.strip(t.without_reasoning(F.coalesce(answer, F.lit(""))))
    return bound(bare, lambda c: F.when(is_json(c), F.when(c.startswith("{"), c)).otherwise(first_object(c)))


def kind_of(c: Column, key: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(c), f"$.{key}", "variant"))


def truth(c: Column, key: str) -> Column:
    """Whether a member counts as true: not null, false, zero, or empty."""
    value, kind = F.get_json_object(c, f"$.{key}"), kind_of(c, key)
    return F.coalesce(
        F.when(kind == "BOOLEAN", value == "true").when(kind == "STRING", value != "").when(kind.startswith("ARRAY"), value != "[]").when(kind.startswith("OBJECT"), value != "{}").when(kind == "VOID", False)
        .otherwise(value.try_cast("double") != 0), F.lit(False),
    )


def word(c: Column, key: str, default: str) -> Column:
    """A member as a word in small letters; the default where it is missing or counts as false."""
    return F.coalesce(F.nullif(F.lower(t.strip(F.when(truth(c, key), F.get_json_object(c, f"$.{key}")))), F.lit("")), F.lit(default))


def flag_of(answer: Column) -> Column:
    """struct<flag, category, confidence, reason> of a classifier's answer; a fixed one for answers that are JSON, but no object."""
    bad = F.struct(F.lit(False).alias("flag"), F.lit("none").alias("category"), F.lit("low").alias("confidence"), F.lit("Invalid model response format").alias("reason"))

    def good(found: Column) -> Column:
        confidence = word(found, "confidence", "low")
        return F.struct(
            truth(found, "hate_speech").alias("flag"), word(found, "category", "none").alias("category"), F.when(confidence.isin("high", "medium", "low"), confidence).otherwise("low").alias("confidence"),
            t.strip(F.coalesce(F.when(truth(found, "reason"), F.get_json_object(found, "$.reason")), F.lit(""))).alias("reason"),
        )

    whole = t.strip(t.without_reasoning(F.coalesce(answer, F.lit(""))))
    return bound(whole, lambda c: F.when(is_json(c) & ~c.startswith("{"), bad).otherwise(bound(F.coalesce(F.when(is_json(c), c).otherwise(first_object(c)), F.lit("{}")), good)))


def tags_of(answer: Column) -> Column:
    """struct<description, tags> of an image tagger's answer: tags of one to three words; both empty where there is no object."""

    def read(found: Column) -> Column:
        text = F.when(truth(found, "description"), F.get_json_object(found, "$.description"))
        listed = F.try_variant_get(F.try_parse_json(found), "$.tags", "array<string>")
        tags = F.filter(F.transform(listed, lambda x: t.strip(F.coalesce(x, F.lit("None")))), lambda x: (x != "") & (F.size(F.split(x, r"(?U)\s+")) <= 3))
        return F.struct(t.strip(F.coalesce(text, F.lit(""))).alias("description"), F.coalesce(tags, F.array().cast("array<string>")).alias("tags"))

    return bound(F.coalesce(object_of(answer), F.lit("{}")), read)


def array_of(answer: Column) -> Column:
    """The JSON array of an answer without fences and prose; if it was cut short, up to its last complete object. '' if there is none."""
    c = t.strip(F.regexp_replace(F.regexp_replace(t.strip(F.coalesce(answer, F.lit(""))), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    c = F.substring(c, F.locate("[", c), F.length(c))
    to = F.length(c) - F.locate("]", F.reverse(c)) + 1
    whole = F.substring(c, F.lit(1), to)
    cut = F.transform(F.reverse(ends_at_depth(c, 1, ("}",))), lambda n: F.concat(F.substring(c, F.lit(1), n), F.lit("]")))
    mended = F.aggregate(cut, F.lit(None).cast("string"), lambda found, x: F.when(found.isNotNull(), found).otherwise(F.when(is_json(x), x)))
    return F.when(~F.contains(F.coalesce(answer, F.lit("")), F.lit("[")), "").when(F.contains(c, F.lit("]")) & is_json(whole), whole).otherwise(F.coalesce(mended, F.lit("")))


def unfenced(answer: Column) -> Column:
    """What a Markdown fence at the beginning holds, without the word json; other answers as they are."""
    c = t.strip(answer)
    inside = F.element_at(F.split(c, "```", 3), 2)
    return F.when(c.startswith("```") & (F.size(F.split(c, "```", 3)) >= 3), F.when(inside.startswith("json"), F.substring(inside, 5, 1 << 30)).otherwise(inside)).otherwise(c)
