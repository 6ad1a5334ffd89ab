"""Reading the JSON of models and of hint files; a field of the wrong type counts as missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekeep.functions.concepts import normalize_concept
from lorekeep.functions.whitespace import trim_ws


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _texts(v: Column, path: str) -> tuple[Column, Column]:
    """The array of texts at a path, empty where the path is missing, and whether what stands there is one."""
    kind = _kind(v, path)
    listed = kind.isin("ARRAY<STRING>", "ARRAY<VOID>")
    none = F.array().cast("array<string>")
    found = F.when(listed, F.coalesce(F.try_variant_get(v, path, "array<string>"), none)).otherwise(none)
    return found, kind.isNull() | (listed & (F.size(F.array_compact(found)) == F.size(found)))


def enrichment_key(synopsis: Column, version: int = 1) -> Column:
    """Under which a section's enrichment is kept: a digest of prompt version and synopsis."""
    return F.sha2(F.concat(F.lit(f"{version}:"), synopsis), 256)


def name_list(names: Column) -> Column:
    """Normalised names, each once, in order, without empty ones."""
    return F.array_distinct(F.filter(F.transform(names, normalize_concept), lambda x: x.isNotNull() & (x != "")))


def parsed_enrichment(raw: Column) -> Column:
    """(concepts, defines, refs, see_also, confidence) of a model's JSON; null where it does not have the right shape.

    Missing lists are empty; a list that holds anything but texts, or a confidence that is no number from 0 to 1, spoils the
    whole output. Names are normalised; see_also titles are trimmed, and null if there are none.
    """
    v = F.try_parse_json(raw)
    concepts, ok1 = _texts(v, "$.concepts")
    defines, ok2 = _texts(v, "$.definesConcepts")
    refs, ok3 = _texts(v, "$.referencesConcepts")
    also, ok4 = _texts(v, "$.seeAlsoTitles")
    number = F.try_variant_get(v, "$.confidence", "double")
    ok5 = _kind(v, "$.confidence").isNull() | (number.between(0, 1) & ~_kind(v, "$.confidence").isin("STRING", "BOOLEAN"))
    titles = F.filter(F.transform(also, trim_ws), lambda x: x != "")
    good = v.isNotNull() & F.startswith(F.schema_of_variant(v), F.lit("OBJECT")) & ok1 & ok2 & ok3 & ok4 & F.coalesce(ok5, F.lit(False))
    return F.when(
        good,
        F.struct(
            name_list(concepts).alias("concepts"),
            name_list(defines).alias("defines"),
            name_list(refs).alias("refs"),
            F.when(F.size(titles) > 0, titles).alias("see_also"),
            number.alias("confidence"),
        ),
    )


def supported_defines(defines: Column, synopsis: Column) -> Column:
    """The defined concepts that stand in the synopsis, in any case of letters."""
    low = F.lower(synopsis)
    return F.filter(defines, lambda c: (c != "") & F.contains(low, c))


def parsed_hints(raw: Column) -> Column:
    """document -> topic -> pages of a hint file: under ``byDocument`` or bare; null where nothing usable is there.

    Topics whose value is no array and pages that are no numbers are left out, and so are documents without topics.
    """
    shape = "map<string,variant>"
    v = F.try_parse_json(raw)
    inner = F.try_variant_get(v, "$.byDocument", "variant")
    top = F.try_variant_get(F.coalesce(inner, v), "$", shape)
    docs = F.map_filter(top, lambda k, x: ~k.isin("version", "byDocument") & F.startswith(F.schema_of_variant(x), F.lit("OBJECT")))

    def pages(x: Column) -> Column:
        each = F.try_variant_get(x, "$", "array<variant>")
        numbers = F.filter(each, lambda y: F.schema_of_variant(y).isin("BIGINT") | F.startswith(F.schema_of_variant(y), F.lit("DECIMAL")))
        return F.transform(numbers, lambda y: F.try_variant_get(y, "$", "int"))

    def topics(x: Column) -> Column:
        all_topics = F.try_variant_get(x, "$", shape)
        lists = F.map_filter(all_topics, lambda _, y: F.startswith(F.schema_of_variant(y), F.lit("ARRAY")))
        return F.transform_values(lists, lambda _, y: pages(y))

    kept = F.map_filter(F.transform_values(docs, lambda _, x: topics(x)), lambda _, t: F.size(t) > 0)
    return F.when(F.size(kept) > 0, kept)
