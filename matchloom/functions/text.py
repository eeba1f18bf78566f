"""Tokens, token-set scores and text assembly, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what a token is.
TOKEN = r"[A-Za-z][A-Za-z0-9_+-]{1,}"
#: Weights of the overall knowledge score and of explanation consistency.
OVERALL_WEIGHTS = {"jaccard": 0.45, "requirement": 0.20, "additional": 0.10, "criteria": 0.25}
CONSISTENCY_WEIGHTS = {"jaccard": 0.45, "requirement": 0.25, "additional": 0.15, "criteria": 0.15}


def tokenize(text: Column) -> Column:
    """Tokens in order, lower-cased; null gives none. Accented letters split tokens."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def token_set(text: Column) -> Column:
    return F.array_distinct(tokenize(text))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, 0 where the whole is 0 or null."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token sets (arrays without repeats): 1 for two empty ones, 0 for one."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(ratio(both, F.size(a) + F.size(b) - both))


def overlap(source: Column, items: Column) -> Column:
    """Share of ``items`` (a token set) that ``source`` holds; 0 if there are none."""
    return ratio(F.size(F.array_intersect(source, items)), F.size(items))


def mean_of(values: Column) -> Column:
    """Mean of an array of doubles; 0 if it is empty."""
    return ratio(F.aggregate(values, F.lit(0.0), lambda s, x: s + x), F.size(values))


def item_sets(items: Column) -> Column:
    """The token set of each text of an array, of those that have tokens."""
    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), token_set), lambda s: F.size(s) > 0)


def coverage_of_sets(source: Column, sets: Column) -> Column:
    """Mean share of each set of ``item_sets`` that ``source`` holds; 0 if there are none.

    ``source`` is looked up once for each set: make it a column of its own first.
    """
    return mean_of(F.transform(sets, lambda s: F.size(F.array_intersect(source, s)) / F.size(s)))


def coverage(source: Column, items: Column) -> Column:
    return coverage_of_sets(source, item_sets(items))


def entries_of(*maps: Column) -> Column:
    """All entries of some maps as one array; a key in two maps counts twice."""
    empty = F.array().cast("array<struct<key:string,value:double>>")
    return F.concat(*(F.coalesce(F.map_entries(m.cast("map<string,double>")), empty) for m in maps))


def criteria_sets(entries: Column) -> Column:
    """``keys`` (a token set) and ``weight`` of each criterion; null and 0 weigh 1."""
    weight = lambda e: F.when(e["value"].isNull() | (e["value"] == 0), 1.0).otherwise(e["value"])
    return F.transform(entries, lambda e: F.struct(token_set(e["key"]).alias("keys"), weight(e).alias("weight")))


def criteria_of_sets(source: Column, criteria: Column) -> Column:
    """Weighted share of criteria: the whole weight if all tokens of a key are in ``source``, half if any; keys without tokens count in the whole."""
    def gained(c: Column) -> Column:
        held = F.size(F.array_intersect(source, c["keys"]))
        return F.when((held > 0) & (held == F.size(c["keys"])), c["weight"]).when(held > 0, 0.5 * c["weight"]).otherwise(0.0)

    total = F.aggregate(criteria, F.lit(0.0), lambda s, c: s + c["weight"])
    return F.when(total > 0, ratio(F.aggregate(criteria, F.lit(0.0), lambda s, c: s + gained(c)), total)).otherwise(0.0)


def criteria_overlap(source: Column, entries: Column) -> Column:
    return criteria_of_sets(source, criteria_sets(entries))


def knowledge_components(own: Column, job: Column, requirements: Column, additional: Column, criteria: Column) -> dict[str, Column]:
    """The four parts of the knowledge score, from columns that hold token sets, ``item_sets`` and ``criteria_sets``.

    Criteria are looked for in the candidate's tokens and the job's together.
    """
    return {"jaccard": jaccard(own, job), "requirement": coverage_of_sets(own, requirements), "additional": jaccard(own, additional), "criteria": criteria_of_sets(F.array_union(own, job), criteria)}


def weighted(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.lit(w) * parts[name]
    return out


def pair_features(r: Column, c: Column, q: Column) -> dict[str, Column]:
    """Coverage features from the token sets of a candidate, a job, and all requirements together."""
    covered = overlap(r, c)
    return {"kg_skill_coverage": covered, "skill_overlap_count": F.size(F.array_intersect(r, c)).cast("double"),
            "missing_skill_ratio": F.when(F.size(c) == 0, 0.0).otherwise(1.0 - covered), "requirement_coverage": overlap(r, q)}


# --- nulls, lists and assembly ---------------------------------------------------------------


def safe_text(value: Column, kind: str) -> Column:
    """Any value as text: null is empty, a list is its non-null items on a line each, a map or struct its JSON, True ``True``."""
    if kind.startswith("array<"):
        inner = kind[6:-1]
        return F.coalesce(F.array_join(F.transform(F.filter(value, lambda x: x.isNotNull()), lambda x: safe_text(x, inner)), "\n"), F.lit(""))
    if kind.startswith(("map<", "struct<")):
        return F.coalesce(F.to_json(value), F.lit(""))
    if kind == "boolean":
        return F.when(value.isNull(), "").when(value, "True").otherwise("False")
    return F.coalesce(value.cast("string"), F.lit(""))


def safe_list(value: Column, kind: str) -> Column:
    """Null is an empty list, a lone value a list of one."""
    if kind.startswith("array<"):
        return F.coalesce(value, F.array().cast(kind))
    return F.when(value.isNull(), F.array().cast(f"array<{kind}>")).otherwise(F.array(value))


def assemble(*parts: Column) -> Column:
    """Parts that aren't blank, with an empty line between them."""
    return F.concat_ws("\n\n", *(F.when(F.trim(F.coalesce(p, F.lit(""))) != "", p) for p in parts))


def either(a: Column, b: Column) -> Column:
    """``a``, or ``b`` where ``a`` is null or empty."""
    return F.coalesce(F.nullif(a, F.lit("")), b)
