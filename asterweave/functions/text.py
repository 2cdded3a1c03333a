"""Designations and names: tokens, lists of names, famous labels, catalogue weights.

Texts hold lists parted by commas. All functions are column expressions; a null
text is an empty list.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from asterweave.functions import lookups


def tokens(text: Column) -> Column:
    """The trimmed, non-empty parts of a comma list, in order."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda t: F.trim(t))
    return F.filter(parts, lambda t: t != "")


def id_tokens(texts: Column) -> Column:
    """The distinct tokens of an array of comma lists, without ``nan`` in any letter case."""
    flat = F.flatten(F.transform(texts, tokens))
    return F.array_distinct(F.filter(flat, lambda t: F.lower(t) != "nan"))


def joined_sorted(items: Column) -> Column:
    """Items in code-point order, joined by a comma and a space."""
    return F.array_join(F.array_sort(items), ", ")


def distinct_names(texts: Column) -> Column:
    """One list of names out of an array of comma lists.

    A leading "the " is dropped; a name contained in a longer kept one (in any
    letter case) is dropped; the rest is in code-point order. Of equally long
    names the one first in code-point order goes first.
    """
    flat = F.flatten(F.transform(texts, tokens))
    named = F.filter(flat, lambda t: ~F.lower(t).isin("nan", "none"))
    bare = F.transform(named, lambda t: F.when(F.lower(t).startswith("the "), F.trim(F.substring(t, 5, 2_000_000))).otherwise(t))
    longest = F.array_sort(F.transform(F.array_distinct(F.filter(bare, lambda t: t != "")), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))

    def keep(kept: Column, item: Column) -> Column:
        inside = F.exists(kept, lambda k: F.contains(F.lower(k), F.lower(item["t"])))
        return F.when(inside, kept).otherwise(F.array_append(kept, item["t"]))

    return joined_sorted(F.aggregate(longest, F.array().cast("array<string>"), keep))


def _numbered(token: Column, prefix: str, most: int | None, strict: bool) -> Column:
    """Whether a token is a prefix and a number from 1 to ``most``. ``strict``: exact letter case, no inner space."""
    t = F.trim(token) if strict else F.upper(F.trim(token))
    shape = t.rlike(rf"^{prefix}[0-9]+$" if strict else rf"^{prefix}\s*[0-9]+$")
    if most is None:
        return shape
    return shape & F.coalesce(_number(t).between(1, most), F.lit(False))


def _number(token: Column) -> Column:
    return F.regexp_extract(token, r"([0-9]+)$", 1).try_cast("int")


def fame_of(token: Column, strict: bool = False) -> Column:
    """M, C or H of a token that is a designation of one of the three lists, else null."""
    chosen = None
    for prefix, most in lookups.FAMOUS_RANGES.items():
        here = _numbered(token, prefix, most, strict)
        chosen = F.when(here, prefix) if chosen is None else chosen.when(here, prefix)
    return chosen


def fame_flags(extra_info: Column, strict: bool = False) -> dict[str, Column]:
    """is_messier, is_caldwell, is_herschel of a list of designations."""
    found = F.transform(tokens(extra_info), lambda t: fame_of(t, strict))
    return {f"is_{name}": F.array_contains(F.array_compact(found), letter) for name, letter in (("messier", "M"), ("caldwell", "C"), ("herschel", "H"))}


def last_number(extra_info: Column, prefix: str) -> Column:
    """The number of the last designation of a list (strict form), or null."""
    own = F.filter(tokens(extra_info), lambda t: F.coalesce(fame_of(t, strict=True) == prefix, F.lit(False)))
    return F.when(F.size(own) > 0, _number(F.element_at(own, -1)))


def famous_labels(extra_info: Column) -> Column:
    """The labels like M33 of a list, of any number, each once in order."""
    up = F.transform(tokens(extra_info), lambda t: F.upper(t))
    famous = F.filter(up, lambda t: t.rlike(r"^[MCH]\s*[0-9]+$"))
    plain = F.transform(famous, lambda t: F.concat(F.substring(t, 1, 1), F.regexp_replace(F.regexp_extract(t, r"([0-9]+)$", 1), r"^0+(?=.)", "")))
    return F.array_distinct(plain)


def name_with_labels(name: Column, ident: Column, labels: Column) -> Column:
    """The name with labels in brackets at its end; merged into brackets that are there, so repeating changes nothing."""
    current = F.trim(F.coalesce(name, ident))
    has = F.contains(current, F.lit("(")) & current.endswith(")")
    main = F.trim(F.substring_index(current, "(", 1))
    inner = F.regexp_replace(F.regexp_extract(current, r"^[^(]*\((.*)$", 1), r"\)+$", "")
    merged = F.array_distinct(F.concat(tokens(inner), labels))
    bracketed = F.when(has, F.concat(main, F.lit(" ("), F.array_join(merged, ", "), F.lit(")"))).otherwise(
        F.concat(current, F.lit(" ("), F.array_join(labels, ", "), F.lit(")"))
    )
    return F.when((F.size(labels) == 0) | (F.trim(F.coalesce(ident, F.lit(""))) == ""), name).otherwise(bracketed)


def catalog_rank(ident: Column) -> Column:
    """Place of a designation's catalogue in the order of preference, 99 for others."""
    t, rank = F.lower(F.trim(ident)), None
    for i, prefix in enumerate(lookups.CATALOG_ORDER):
        rank = F.when(t.startswith(prefix), i) if rank is None else rank.when(t.startswith(prefix), i)
    return rank.otherwise(99)


def best_id(ident: Column, others: Column) -> Column:
    """The designation of the preferred catalogue among ``ident`` and the array ``others``, by rank and then code points."""
    candidates = F.concat(F.array(F.trim(ident)), F.transform(others, lambda t: F.trim(t)))
    return F.array_min(F.transform(candidates, lambda t: F.struct(catalog_rank(t).alias("r"), t.alias("t"))))["t"]


def plan_weight(ident: Column, names: Column) -> Column:
    """The highest weight of a catalogue whose prefix begins the id or one of the names; at least 10."""
    cleaned = F.regexp_replace(F.coalesce(names, F.lit("")), r"[()]", "")
    candidates = F.concat(F.array(F.coalesce(ident, F.lit(""))), F.split(cleaned, ","))

    def weight(t: Column) -> Column:
        bare, w = F.regexp_replace(F.lower(F.trim(t)), r"[ -]", ""), None
        for prefix, value in lookups.PLAN_WEIGHTS.items():
            w = F.when(bare.startswith(prefix), value) if w is None else w.when(bare.startswith(prefix), value)
        return w.otherwise(lookups.PLAN_WEIGHT_OTHER)

    return F.array_max(F.transform(candidates, weight))


def ordered_designations(extra_info: Column) -> Column:
    """Designations without famous labels, by catalogue, then prefix, then code points of the lower-case text."""
    famous = famous_labels(extra_info)
    items = F.filter(tokens(extra_info), lambda t: ~F.array_contains(famous, t))

    def key(t: Column) -> Column:
        low = F.lower(t)
        letters = F.regexp_extract(low, r"^([a-z]+)", 1)
        prefix = F.when(low.startswith("sh2"), "sh2").when(letters != "", letters).otherwise(F.substring(low, 1, 3))
        return F.struct((-lookups.lookup(lookups.LABEL_PRIORITY, prefix, 0)).alias("p"), prefix.alias("x"), low.alias("k"), t.alias("t"))

    return F.transform(F.array_sort(F.transform(items, key)), lambda s: s["t"])


def cut(text: Column, most: int) -> Column:
    """A text of at most ``most`` characters; a longer one ends in three dots."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def designation_lines(extra_info: Column, items: int = 24, lines: int = 3, width: int = 65) -> Column:
    """The printed list of designations: at most ``items`` on ``lines`` lines of ``width`` characters; ``brak`` for none given."""
    per = items // lines
    chosen = F.slice(ordered_designations(extra_info), 1, items)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(chosen) / per).cast("int") - 1, F.lit(0)))
    rows = F.transform(starts, lambda i: cut(F.array_join(F.slice(chosen, i * per + 1, F.lit(per)), ", "), width))
    text = F.array_join(F.slice(rows, 1, lines), ",\n" + " " * 16)
    return F.when(F.coalesce(extra_info, F.lit("")) == "", "brak").otherwise(text)


def display_name(names: Column, name: Column, ident: Column) -> Column:
    """The first of common names, name and id that is not blank."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in (names, name, ident)))


def thousands(n: Column) -> Column:
    """A whole number with spaces between groups of three digits."""
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit(" "))


def whole_number(text: Column) -> Column:
    """The digits of a number written as whole or with a fraction (24.0 is 24); empty for anything else."""
    return F.coalesce(F.trim(text).try_cast("double").try_cast("int").cast("string"), F.lit(""))


def params_hash(*values: Column, year: Column | None = None) -> Column:
    """MD5 of numbers with six decimals, and a year without any, joined by a bar."""
    parts = [F.format_string("%.6f", v.cast("double")) for v in values]
    return F.md5(F.concat_ws("|", *parts, *([] if year is None else [year.cast("int").cast("string")])))
