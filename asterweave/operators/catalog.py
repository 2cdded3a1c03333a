"""From raw catalogues to one table: parsing, normalizing, union, filters, patches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asterweave.functions import lookups
from asterweave.functions.stated import blank_trim
from asterweave.runtime import number

#: Columns of a normalized catalogue, in order.
NORMALIZED = {
    "id": "string", "ra": "double", "dec": "double", "size": "double", "mag": "double", "type": "string",
    "extra_info": "string", "common_names": "string", "priority": "int", "catalog": "string",
}


def safe_number(text: Column) -> Column:
    """A number written in a text, null where blank, no number, or not finite."""
    return number(F.trim(text))


def sexagesimal(text: Column, right_ascension: bool) -> Column:
    """Degrees of HH:MM:SS or ±DD:MM:SS; null unless it has exactly three numeric parts.

    Inner spaces are ignored. The sign of a right ascension is ignored; that of a
    declination counts for the whole, so that -00:30:00 is -0.5.
    """
    bare = F.regexp_replace(text, r"\s+", "")
    parts = F.split(F.regexp_replace(bare, r"^[+-]", ""), ":")
    a, b, c = (F.get(parts, F.lit(i)).try_cast("double") for i in range(3))
    value = F.when(F.size(parts) == 3, a + b / 60.0 + c / 3600.0)
    return value * 15.0 if right_ascension else F.when(bare.startswith("-"), -value).otherwise(value)


def preferred_magnitude(v: Column, b: Column, j: Column, h: Column, k: Column, surface: Column, kind: Column) -> Column:
    """V if given; of a galaxy (type G) else its surface brightness; else the least of B, J, H, K; else null."""
    v, b, j, h, k, surface = (safe_number(x) for x in (v, b, j, h, k, surface))
    return F.coalesce(v, F.when(F.trim(kind) == "G", surface), F.least(b, j, h, k))


def _padded(text: Column) -> Column:
    """A number padded with zeros to four places, never cut."""
    return F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text)


def famous_designations(name: Column, m: Column, ngc: Column, ic: Column, herschel: dict[str, int] | None = None) -> Column:
    """M, H and C designations of a row, joined by commas.

    The Herschel key is the padded NGC cross-reference, else the name; the
    Caldwell key the NGC, else the IC cross-reference, else the name. Keys that
    differ in their padding from those of the lists do not match.
    """
    n, i, own = (F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit("")) for c in (ngc, ic, name))
    by_ngc = F.when(n.isNotNull(), F.concat(F.lit("NGC"), _padded(n)))
    by_ic = F.when(i.isNotNull(), F.concat(F.lit("IC"), _padded(i)))
    messier = safe_number(m).try_cast("int")
    h = lookups.lookup(lookups.HERSCHEL_SAMPLE if herschel is None else herschel, F.coalesce(by_ngc, own))
    c = lookups.lookup(lookups.CALDWELL, F.coalesce(by_ngc, by_ic, own))
    return F.concat_ws(",", F.concat(F.lit("M"), messier), F.concat(F.lit("H"), h), F.concat(F.lit("C"), c))


def ngc_catalog(raw: DataFrame, herschel: dict[str, int] | None = None) -> DataFrame:
    """(id, extra_info, type, ra, dec, mag, size, base_score, common_names) of raw rows; rows with a blank name are left out."""
    return raw.where(F.coalesce(blank_trim(F.col("name")), F.lit("")) != "").select(
        F.trim("name").alias("id"),
        famous_designations(F.col("name"), F.col("m"), F.col("ngc"), F.col("ic"), herschel).alias("extra_info"),
        F.trim("type").alias("type"),
        F.round(sexagesimal(F.col("ra"), True), 5).alias("ra"),
        F.round(sexagesimal(F.col("dec"), False), 5).alias("dec"),
        F.round(preferred_magnitude(*(F.col(c) for c in ("v_mag", "b_mag", "j_mag", "h_mag", "k_mag", "surfbr", "type"))), 2).alias("mag"),
        F.round(safe_number(F.col("majax")), 1).alias("size"),
        F.lit("").alias("base_score"),
        F.trim("common_names").alias("common_names"),
    )


def _normal(df: DataFrame, catalog: str, **columns: Column) -> DataFrame:
    """A catalogue in the normal form: what it does not state is null; rows without coordinates are left out."""
    fixed = {"priority": F.lit(lookups.PRIORITIES[catalog]), "catalog": F.lit(catalog)}
    given = columns | fixed
    out = df.select(*(given.get(c, F.lit(None)).cast(t).alias(c) for c, t in NORMALIZED.items()))
    ra, dec = number(F.col("ra")), number(F.col("dec"))
    return out.where(ra.isNotNull() & dec.isNotNull()).withColumns({"ra": F.round(F.pmod(ra, F.lit(360.0)), 5), "dec": F.round(dec, 5)})


def _coordinates() -> dict[str, Column]:
    return {"ra": F.col("raj2000").try_cast("double"), "dec": F.col("dej2000").try_cast("double")}


def normal_ngc(df: DataFrame) -> DataFrame:
    """A result of ``ngc_catalog`` in the normal form."""
    return _normal(df, "ngc", **{c: F.col(c) for c in ("id", "ra", "dec", "size", "mag", "type", "extra_info", "common_names")})


def normal_sh2(df: DataFrame) -> DataFrame:
    """Sharpless regions (raj2000, dej2000, sh2, diam)."""
    number_of = F.col("sh2").try_cast("int")
    ident = F.coalesce(F.concat(F.lit("Sh2-"), number_of), F.lit(""))
    names = lookups.lookup(lookups.SH2_NAMES, ident, "")
    return _normal(df, "sh2", **_coordinates(), id=ident, size=safe_number(F.col("diam")), type=F.lit("HII"), common_names=names)


def normal_barn(df: DataFrame) -> DataFrame:
    """Barnard's dark nebulae (raj2000, dej2000, barn, diam)."""
    return _normal(df, "barn", **_coordinates(), id=F.concat(F.lit("B"), F.trim("barn")), size=safe_number(F.col("diam")), type=F.lit("DN"))


def normal_rcw(df: DataFrame) -> DataFrame:
    """RCW regions (raj2000, dej2000, rcw, majaxis)."""
    return _normal(df, "rcw", **_coordinates(), id=F.concat(F.lit("RCW"), F.trim("rcw")), size=safe_number(F.col("majaxis")), type=F.lit("HII"))


def normal_ced(df: DataFrame) -> DataFrame:
    """Cederblad nebulae (raj2000, dej2000, ced, m_ced, dim1, dim2, vmag): the mean of both diameters, the first if there is one."""
    sub = F.trim(F.coalesce(F.col("m_ced"), F.lit("")))
    sub = F.when(F.lower(sub).isin("nan", "none", "null", "-"), "").otherwise(sub)
    d1, d2 = safe_number(F.col("dim1")), safe_number(F.col("dim2"))
    size = F.when(d2 > 0, (d1 + d2) / 2).otherwise(d1)
    return _normal(df, "ced", **_coordinates(), id=F.concat(F.lit("Ced"), F.trim(F.col("ced").cast("string")), sub), size=size, mag=safe_number(F.col("vmag")), type=F.lit("NB"))


def normal_lbn(df: DataFrame) -> DataFrame:
    """Lynds' bright nebulae (raj2000, dej2000, seq, diam1)."""
    return _normal(df, "lbn", **_coordinates(), id=F.concat(F.lit("LBN"), F.col("seq").cast("string")), size=safe_number(F.col("diam1")), type=F.lit("NB"))


def normal_ldn(df: DataFrame) -> DataFrame:
    """Lynds' dark nebulae (raj2000, dej2000, ldn, area): the root of an area in square degrees, in arcmin."""
    return _normal(df, "ldn", **_coordinates(), id=F.concat(F.lit("LDN"), F.col("ldn").cast("string")), size=F.sqrt(safe_number(F.col("area"))) * 60.0, type=F.lit("DN"))


def normal_pgc(df: DataFrame) -> DataFrame:
    """Galaxies (raj2000, dej2000, pgc, majaxis, btot): sizes are divided by 60."""
    ident = F.coalesce(F.concat(F.lit("PGC"), F.col("pgc").try_cast("int")), F.lit(""))
    return _normal(df, "pgc", **_coordinates(), id=ident, size=safe_number(F.col("majaxis")) / 60.0, mag=safe_number(F.col("btot")), type=F.lit("Gx"))


NORMALIZERS = {
    "ngc": normal_ngc, "sh2": normal_sh2, "barn": normal_barn, "rcw": normal_rcw,
    "ced": normal_ced, "lbn": normal_lbn, "ldn": normal_ldn, "pgc": normal_pgc,
}


def unified(catalogs: dict[str, DataFrame]) -> DataFrame:
    """All given raw catalogues in the normal form, one after the other; a missing one adds nothing."""
    return reduce(DataFrame.unionByName, (NORMALIZERS[name](df) for name, df in catalogs.items()))


def patched(df: DataFrame, key: str, patch: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``columns`` replaced where ``patch`` (key and those columns) states another value."""
    new = patch.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in columns)).dropDuplicates(["__key"])
    joined = df.join(new, F.col(key) == F.col("__key"), "left")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns))


def without_trash(df: DataFrame, max_mag: float = 18.0, min_size: float = 0.9) -> DataFrame:
    """Rows that are neither fainter than ``max_mag`` nor smaller than ``min_size``; unknown values stay."""
    faint = F.coalesce(number(F.col("mag")) > max_mag, F.lit(False))
    tiny = F.coalesce(number(F.col("size")) < min_size, F.lit(False))
    return df.where(~(faint | tiny))


def targets(df: DataFrame, min_size: float = 5.0, max_mag: float = 17.0) -> DataFrame:
    """Rows whose size is unknown or at least, and whose magnitude is unknown or at most, the limit."""
    size, mag = number(F.col("size")), number(F.col("mag"))
    return df.where((size.isNull() | (size >= min_size)) & (mag.isNull() | (mag <= max_mag)))
