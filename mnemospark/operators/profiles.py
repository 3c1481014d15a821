"""Facts of nested profiles as rows: every value with the path to it, whatever the schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

_ROW = "array<struct<path: string, value: string>>"


def _walked(at: Column, kind: DataType, path: Column) -> Column:
    """The values below a column as an array of (path, value): fields by name, map entries by key, array members by place."""
    below = lambda name: F.when(path == "", name).otherwise(F.concat(path, F.lit("."), name))
    none = F.array().cast(_ROW)
    if isinstance(kind, StructType):
        return F.flatten(F.array(none, *(F.coalesce(_walked(at[f.name], f.dataType, below(F.lit(f.name))), none) for f in kind.fields)))
    if isinstance(kind, MapType):
        keys = F.array_sort(F.map_keys(at))
        return F.flatten(F.transform(keys, lambda k: F.coalesce(_walked(at[k], kind.valueType, below(k.cast("string"))), none)))
    if isinstance(kind, ArrayType):
        return F.flatten(F.transform(at, lambda x, i: F.coalesce(_walked(x, kind.elementType, below((i + 1).cast("string"))), none)))
    value = at.cast("string")
    return F.when(F.trim(value) != "", F.array(F.struct(path.alias("path"), value.alias("value")))).otherwise(none)


def leaves(rows: DataFrame, key: list[str], profile: str) -> DataFrame:
    """key, path and value: every value of the nested column `profile` that is neither null nor empty, in one pass."""
    kind = rows.schema[profile].dataType
    return rows.select(*key, F.inline(_walked(F.col(profile), kind, F.lit(""))))


#: What of a profile may be contradicted, and how a family's counts are told.
FIELDS = ("Name", "Gender", "Birthdate", "Birthplace", "Education_Background.Highest_Degree", "Education_Background.Major", "Education_Background.University")
PARENT = {"Mother": ("Name", "Birth_Date"), "Father": ("Name", "Birth_Date")}
SIBLING, FAMILY = ("Type", "Name", "Birth_Date"), "Family_Information"


def static_facts(profiles: DataFrame, profile: str = "profile", key: str = "persona") -> DataFrame:
    """persona, path and value: what of each profile can be contradicted. Basic and educational fields and relatives' details
    that are there, and for everybody whether there are a mother, a father and siblings, and how many.

    The profile's family is a map of relatives (Mother, Father, Sibling_1 ...), each a struct or map. A relative that is in the map
    counts even if nothing is known of them. Null profiles give no rows.
    """
    there = profiles.where(F.col(profile).isNotNull())
    below = leaves(there, [key], profile)
    relatives = [f"{FAMILY}.{p}.{f}" for p, fields in PARENT.items() for f in fields]
    known = below.where(F.col("path").isin(*FIELDS, *relatives) | F.col("path").rlike(rf"^{FAMILY}\.Sibling_[^.]*\.(?:{'|'.join(SIBLING)})$"))
    family = F.coalesce(F.map_keys(F.col(f"{profile}.{FAMILY}")), F.array().cast("array<string>"))
    siblings = F.size(F.filter(family, lambda k: F.startswith(k, F.lit("Sibling_"))))
    yes = lambda test: F.when(test, "Yes").otherwise("No")
    told = F.array(
        *(F.struct(F.lit(f"{FAMILY}.Has_{p}").alias("path"), yes(F.array_contains(family, p)).alias("value")) for p in PARENT),
        F.struct(F.lit(f"{FAMILY}.Has_Siblings").alias("path"), yes(siblings > 0).alias("value")), F.struct(F.lit(f"{FAMILY}.Sibling_Count").alias("path"), siblings.cast("string").alias("value")),
    )
    return known.unionByName(there.select(key, F.inline(told)))
