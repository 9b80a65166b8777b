"""String expressions for names, barcodes, logs and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Spellings of a missing value, of true and of false.
MISSING = ("", "nan", "none", "na", "<na>", "null")
TRUE, FALSE = ("true", "1", "yes"), ("false", "0", "no")


def missing_to_null(c: Column) -> Column:
    """Trimmed text; null for the spellings of a missing value."""
    t = F.trim(c)
    return F.when(~F.lower(t).isin(*MISSING), t)


def strip_suffixes(c: Column, suffixes: list[str]) -> Column:
    """Trimmed upper-case text without the given suffix patterns, removed in order, whatever their case."""
    out = F.trim(c)
    for s in suffixes:
        out = F.regexp_replace(out, f"(?i)(?:{s})$", "")
    return F.upper(F.trim(out))


def tri_state(c: Column) -> Column:
    """true, false, or null for missing; anything else raises."""
    t = F.lower(F.trim(c))
    bad = F.raise_error(F.concat(F.lit("not a boolean: "), c)).cast("boolean")
    return F.when(c.isNull() | t.isin(*MISSING), F.lit(None).cast("boolean")).when(t.isin(*TRUE), True).when(t.isin(*FALSE), False).otherwise(bad)


def settings(c: Column, pair: str = ",", key: str = "=") -> Column:
    """``k=v,k=v`` as a map; the last of equal keys wins."""
    parts = F.filter(F.split(c, pair), lambda x: F.contains(x, F.lit(key)))
    entries = F.transform(parts, lambda x: F.struct(F.trim(F.substring_index(x, key, 1)).alias("key"), F.trim(F.substr(x, F.instr(x, key) + len(key))).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def safe_name(c: Column) -> Column:
    """Everything but letters, digits, _ and - as _."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "_")


def site_batch(c: Column) -> Column:
    """``site1_donor2_assay`` as (site, donor, assay, batch 's1d2')."""
    site, donor = F.regexp_extract(c, r"site(\d+)", 1), F.regexp_extract(c, r"donor(\d+)", 1)
    return F.struct(site.alias("site"), donor.alias("donor"), F.element_at(F.split(c, "_"), -1).alias("assay"), F.concat(F.lit("s"), site, F.lit("d"), donor).alias("batch"))


def strict_number(c: Column) -> Column:
    """A finite number or null; words for infinity and not-a-number are no numbers."""
    return F.when(F.trim(c).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(c).try_cast("double"))


def distinct_names(df: DataFrame, name: str, order: str, out: str = "name_unique") -> DataFrame:
    """Repeated names get -1, -2, ... in order; the first keeps its name."""
    n = F.row_number().over(W.partitionBy(name).orderBy(order)) - 1
    return df.withColumn(out, F.when(n == 0, F.col(name)).otherwise(F.concat_ws("-", name, n)))
