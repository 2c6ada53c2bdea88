"""Names, tokens, ranges, settings and phrases as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column, separator: str = ";") -> Column:
    """Trimmed, non-empty parts; null text has none."""
    return F.coalesce(F.filter(F.transform(F.split(text, separator), lambda t: F.trim(t)), lambda t: t != ""), F.array().cast("array<string>"))


def joined(parts: Column, separator: str = ";") -> Column:
    """Non-empty parts joined."""
    return F.array_join(F.filter(parts, lambda t: t.isNotNull() & (t != "")), separator)


def plain_name(text: Column) -> Column:
    """Lower case letters and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def name_score(name: Column, query: Column) -> Column:
    """100 for the same plain name, 80 for one that starts with the query, 60 for one that contains it, else null."""
    n, q = plain_name(name), plain_name(query)
    return F.when(q == "", None).when(n == q, 100).when(n.startswith(q), 80).when(n.contains(q), 60)


def expand_ranges(text: Column, most: int = 10_000) -> Column:
    """``1-3,7`` -> [1, 2, 3, 7], distinct, in order; unreadable parts, and ranges that fall or exceed ``most``, are left out."""
    part = lambda p: F.regexp_extract_all(p, F.lit(r"(\d+)"), 1)
    good = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p.rlike(r"^\d{1,9}(\s*-\s*\d{1,9})?$"))
    ends = F.transform(good, lambda p: F.struct(F.element_at(part(p), 1).cast("int").alias("a"), F.element_at(part(p), -1).cast("int").alias("b")))
    sound = F.filter(ends, lambda e: (e["a"] <= e["b"]) & (e["b"] - e["a"] < most))
    return F.array_distinct(F.flatten(F.transform(sound, lambda e: F.sequence(e["a"], e["b"]))))


def settings(text: Column) -> Column:
    """Lines ``KEY = value`` -> map in upper case, comments after ! or # cut, of equal keys the last."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.trim(F.regexp_replace(s, "[!#].*$", "")))
    pairs = F.filter(lines, lambda s: s.rlike(r"^[A-Za-z_][A-Za-z0-9_]*\s*=\s*\S"))
    entries = F.transform(pairs, lambda s: F.struct(F.upper(F.trim(F.substring_index(s, "=", 1))).alias("k"), F.upper(F.trim(F.regexp_replace(s, r"^[^=]*=", ""))).alias("v")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"])))


def canonical_path(label: Column) -> Column:
    """Letters of a path label in upper case; named Greek letters become signs."""
    greek = label
    for word, sign in (("gamma", "Γ"), ("sigma", "Σ"), ("lambda", "Λ"), ("delta", "Δ")):
        greek = F.regexp_replace(greek, rf"(?i)\\?\b{word}\b|(?i)\\{word}", sign)
    return F.upper(F.regexp_replace(greek, r"[^\p{L}]+", ""))


def either_way(path: Column) -> Column:
    """The smaller of a path and its reverse: equal for both directions."""
    return F.least(path, F.reverse(path))


def expanded_atoms(formula: Column) -> Column:
    """``B2N`` -> [B, B, N]; null unless the text is symbols and whole counts of at most three digits."""
    text = F.regexp_replace(formula, r"\s+", "")
    names, counts = (F.regexp_extract_all(text, F.lit(r"([A-Z][a-z]?)(\d*)"), g) for g in (1, 2))
    atoms = F.flatten(F.zip_with(names, counts, lambda e, n: F.array_repeat(e, F.when(n == "", 1).otherwise(n.try_cast("int")))))
    return F.when(text.rlike(r"^([A-Z][a-z]?\d{0,3})+$"), atoms)


def concept_score(answer: Column, required: list[list[str]]) -> Column:
    """Share of phrase groups of which the answer holds any; 1 without groups. Case doesn't matter, null answers are empty."""
    text = F.lower(F.coalesce(answer, F.lit("")))
    if not required:
        return F.lit(1.0)
    hit = lambda group: sum((F.when(text.contains(p.lower()), 1).otherwise(0) for p in group), F.lit(0)) > 0
    return sum((F.when(hit(g), 1.0).otherwise(0.0) for g in required), F.lit(0.0)) / len(required)


def missing_groups(answer: Column, required: list[list[str]]) -> Column:
    text = F.lower(F.coalesce(answer, F.lit("")))
    any_of = lambda g: F.greatest(F.lit(False), *[text.contains(p.lower()) for p in g])
    return F.filter(F.array(*[F.when(~any_of(g), F.lit(g[0])) for g in required]), lambda x: x.isNotNull())


def forbidden_hits(answer: Column, forbidden: list[str]) -> Column:
    text = F.lower(F.coalesce(answer, F.lit("")))
    return F.filter(F.array(*[F.when(text.contains(p.lower()), F.lit(p)) for p in forbidden]), lambda x: x.isNotNull())
