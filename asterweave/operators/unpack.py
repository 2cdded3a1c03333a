"""Fields that pack several values in one string, split by their cheapest dialect.

A dialect is a set of delimiters, with or without quoting. The description
length of a parse is the code length of its values, learned over all fields of
the table, plus that of naming the dialect; each field takes the dialect with
the shortest description.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asterweave.functions.stated import is_nothing
from asterweave.runtime import materialize, small_side

#: Delimiters by bit of a dialect's mask, as regular expressions.
DELIMITERS = (",", ";", r"\|", "\t", r"(?<=\s)/(?=\s)", r"[\n\r]+")
QUOTED = 1 << len(DELIMITERS)
#: Stands for a delimiter between parsing steps; U+0001 in a text never counts as a delimiter of its own.
MARK = "\x01"
#: Bits to name one delimiter or quoting, and to spell one letter of a word not seen elsewhere.
NAME_BITS, CHAR_BITS = 3.0, 5.0
#: Parts into which the values of one hot key are spread.
SALTS = 8


def _outside(text: Column, quoted: Column) -> Column:
    """The segments of ``text`` between quotes: those at even places lie outside; one segment if not ``quoted``."""
    return F.when(quoted, F.split(text, '"', -1)).otherwise(F.array(text))


def _delimiters_in(text: Column) -> Column:
    """Mask of the delimiters that occur in a text."""
    return sum((F.when(text.rlike(d), 1 << i).otherwise(0) for i, d in enumerate(DELIMITERS)), F.lit(0))


def _balanced(text: Column) -> Column:
    """Whether a text has quotes, and an even number of them."""
    return text.contains('"') & (F.length(F.regexp_replace(text, '[^"]', "")) % 2 == 0)


def _pattern(mask: Column) -> Column:
    """A regular expression of the delimiters in a mask."""
    return F.array_join(
        F.array_compact(F.array(*(F.when(mask.bitwiseAND(1 << i) > 0, F.lit(d)) for i, d in enumerate(DELIMITERS)))), "|"
    )


def trimmed(text: Column) -> Column:
    """``text`` without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^[\s\u00a0]+|[\s\u00a0]+$", "")


def parse(text: Column, dialect: Column) -> Column:
    """The raw values of ``text`` under a dialect: trimmed, quotes kept, blanks dropped."""
    quoted = dialect.bitwiseAND(QUOTED) > 0
    pattern = _pattern(dialect)
    safe = F.replace(text, F.lit(MARK), F.lit(" "))

    def cut(segment: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.regexp_replace(segment, pattern, F.lit(MARK))).otherwise(segment)

    marked = F.when(pattern == "", safe).otherwise(F.array_join(F.transform(_outside(safe, quoted), cut), '"'))
    return F.filter(F.transform(F.split(marked, MARK, -1), trimmed), lambda v: v != "")


def _enclosed(value: Column) -> Column:
    return (F.length(value) >= 2) & value.startswith('"') & value.endswith('"')


def unquoted(value: Column, dialect: Column) -> Column:
    """A raw value freed of enclosing quotes, doubled quotes inside given once, where the dialect quotes."""
    inner = F.replace(value.substr(F.lit(2), F.length(value) - 2), F.lit('""'), F.lit('"'))
    return F.when((dialect.bitwiseAND(QUOTED) > 0) & _enclosed(value), inner).otherwise(value)


def _well_formed(value: Column) -> Column:
    """A value that has quotes must be enclosed by them, and have them doubled inside."""
    inner = F.replace(value.substr(F.lit(2), F.length(value) - 2), F.lit('""'), F.lit(""))
    return ~value.contains('"') | (_enclosed(value) & ~inner.contains('"'))


def finest_dialect(text: Column) -> Column:
    """All delimiters, and quotes where they are balanced: its parse holds a value if any parse does."""
    return F.when(_balanced(text), F.lit(2 * QUOTED - 1)).otherwise(QUOTED - 1)


def holds_value(text: Column) -> Column:
    """Whether a packed text has at least one value that is not a word for nothing."""
    dialect = finest_dialect(text)
    return F.coalesce(F.exists(parse(text, dialect), lambda v: ~is_nothing(unquoted(v, dialect))), F.lit(False))


def _tokens(value: Column) -> Column:
    """The words and signs of a value, each with the sign before it, or ^ at the start, as its context."""
    found = F.regexp_extract_all(value, F.lit(r"[\p{L}\p{M}]+|[^\p{L}\p{M}\s]"), F.lit(0))

    # a neighbour is reached by shifting the list: looked up by its place it would be found anew at every token
    before = F.concat(F.array(F.lit(None).cast("string")), found)

    def pair(token: Column, last: Column) -> Column:
        after = F.when(last.isNull(), F.lit("^")).when(last.rlike(r"^[\p{P}\p{S}]$"), last).otherwise("")
        return F.struct(after.alias("after"), token.alias("token"))

    return F.filter(F.zip_with(found, before, pair), lambda t: t["token"].isNotNull())


def _prices(values: DataFrame, counts: DataFrame, totals: Column) -> DataFrame:
    """(field, value, bits) of each value: known ones by their frequency, new ones by that of their words and signs."""
    tokens = _tokens(F.col("value"))
    words = counts.select("field", F.explode(tokens).alias("t"), "uses").select("field", "t.*", "uses")
    words = materialize(words.groupBy("field", "after", "token").agg(F.sum("uses").alias("met")), "words")
    of_context = words.groupBy("field", "after").agg((F.sum("met") + F.count("*") + 1).alias("all_met"))
    words = words.join(small_side(of_context), ["field", "after"]).select(
        "field", "after", "token", F.log2(F.col("all_met") / F.col("met")).alias("price")
    )
    marked = values.join(counts, ["field", "value"], "left")
    known = marked.where("uses > 1").select("field", "value", F.log2(totals["uses"] / F.col("uses")).alias("bits"))
    spelled = F.log2(totals["uses"]) + F.when(F.col("token").rlike(r"^\p{L}"), CHAR_BITS * F.length("token")).otherwise(0.0)
    fresh = marked.where("uses is null or uses <= 1").select("field", "value", F.explode_outer(tokens).alias("t")).select("field", "value", "t.*")
    fresh = fresh.join(small_side(words), ["field", "after", "token"], "left").select(
        "field", "value", F.coalesce("price", spelled, F.lit(0.0)).alias("bits")
    )
    return known.union(fresh.groupBy("field", "value").agg((F.sum("bits") + totals["new_bits"]).alias("bits")))


def cheapest_dialects(texts: DataFrame) -> DataFrame:
    """(field, text, dialect) of every distinct text of a field that has more than one possible parse.

    Values are priced as in a two-part code, learned for each field: one used
    before costs the logarithm of its frequency, a new one the share of new
    values and its words. What counts as a value is learned from the finest parse
    of each text, so that many copies of a packed text don't make it one value.
    The joins on values are salted, since one value may
    hold a third of all rows.
    """
    t, d = F.col("text"), F.col("dialect")
    can_quote = _balanced(t)
    inside_dropped = F.transform(F.split(t, '"', -1), lambda s, i: F.when(i % 2 == 0, s).otherwise(""))
    bare = F.when(can_quote, F.array_join(inside_dropped, '"')).otherwise(t)

    def masks(within: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.lit(QUOTED - 1)), lambda m: m.bitwiseAND(within) == m)

    shaped = (
        texts.where("text is not null").groupBy("field", "text").agg(F.count("*").alias("n"))
        .select("field", "text", "n", can_quote.alias("q"), _delimiters_in(t).alias("all"), _delimiters_in(bare).alias("out"))
    )
    shaped = materialize(shaped, "packed")
    plain = masks(F.col("all"))
    dialects = F.when(F.col("q"), F.concat(F.transform(masks(F.col("out")), lambda m: m.bitwiseOR(F.lit(QUOTED))), plain)).otherwise(plain)
    several = F.col("q") | (F.col("all") > 0)
    parses = shaped.where(several).select("field", "text", "n", F.explode(dialects).alias("dialect"))
    raw = parses.select("field", "text", "n", "dialect", parse(t, d).alias("values"))
    sound = (d.bitwiseAND(QUOTED) == 0) | F.forall("values", _well_formed)
    parses = raw.where(sound).withColumn("values", F.transform("values", lambda v: F.lower(unquoted(v, d))))
    # The values seen: whole fields that can be read one way only, and the finest parse of the others,
    # by their quotes where these are well formed.
    rank = F.struct(d.bitwiseAND(QUOTED), F.bit_count("dialect"))
    finest = parses.groupBy("field", "text").agg(F.max_by(F.struct("values", "n"), rank).alias("best"))
    seen = finest.select("field", F.explode("best.values").alias("value"), F.col("best.n").alias("n")).union(
        shaped.where(~several).select("field", F.lower(trimmed(t)), "n")
    )
    counts = materialize(seen.where("value <> ''").groupBy("field", "value").agg(F.sum("n").alias("uses")), "values")
    # By the share of values met once, the next one is new. One row for each packed field.
    sums = counts.groupBy("field").agg(F.sum("uses").alias("uses"), F.count_if(F.col("uses") == 1).alias("once")).collect()
    pairs = [x for r in sums for x in (F.lit(r.field), F.struct(F.lit(r.uses + 1.0).alias("uses"), F.lit(math.log2((r.uses + 2) / (r.once + 1))).alias("new_bits")))]
    nothing = F.struct(F.lit(1.0).alias("uses"), F.lit(0.0).alias("new_bits"))
    totals = F.coalesce(F.create_map(*pairs)[F.col("field")], nothing) if pairs else nothing

    items = parses.select("field", "text", "dialect", F.explode_outer("values").alias("value"))
    prices = _prices(items.where("value is not null").select("field", "value").distinct(), counts, totals)
    items = items.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)))
    salts = F.array(*(F.lit(i).cast("long") for i in range(SALTS)))
    spread = prices.select("field", "value", "bits", F.explode(salts).alias("salt"))
    priced = items.join(spread, ["field", "value", "salt"], "left").groupBy("field", "text", "dialect").agg(F.sum(F.coalesce("bits", F.lit(0.0))).alias("bits"))
    cost = F.col("bits") + NAME_BITS * F.bit_count("dialect")
    # On a tie the parse with more delimiters stands.
    return priced.groupBy("field", "text").agg(F.min_by("dialect", F.struct(F.round(cost, 6), -F.bit_count("dialect"), "dialect")).alias("dialect"))


def unpack_fields(df: DataFrame, fields: list[str], key: str = "row_id", at_least: int = 1) -> DataFrame:
    """(key, field, pos, item): the values of each packed field, one row for each, in their order.

    ``pos`` counts from 1. Values are trimmed and freed of enclosing quotes, a
    doubled quote inside them is given once; blank values are dropped and take no
    position; repeated values are kept. ``at_least`` keeps fields of so many
    values or more. Null, empty and blank fields give no rows; unbalanced quotes
    are ordinary characters. Texts may be of any length. Rows with a repeated
    key are split each for itself. Other columns are ignored.
    """
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields))
    long = df.select(F.col(key).alias("__key"), F.explode(each).alias("f")).select("__key", "f.field", "f.text").where("text is not null")
    t, d = F.col("text"), F.col("dialect")
    several = (_delimiters_in(t) > 0) | _balanced(t)
    packed = long.where(several).join(cheapest_dialects(long), ["field", "text"]).select("__key", "field", "text", "dialect")
    if at_least < 2:
        packed = packed.union(long.where(~several).select("__key", "field", "text", F.lit(0)))
    values = F.transform(parse(t, d), lambda v: trimmed(unquoted(v, d)))
    items = packed.select("__key", "field", F.filter(values, lambda v: v != "").alias("items"))
    items = items.where(F.size("items") >= at_least).select("__key", "field", F.posexplode("items").alias("pos", "item"))
    return items.select(F.col("__key").alias(key), "field", (F.col("pos") + 1).alias("pos"), "item")
