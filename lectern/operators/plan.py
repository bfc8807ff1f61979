"""Coercion of plans that a model answered with as JSON, on the variant type; errors are a column, so a bad plan doesn't fail the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the section that rows without one go into.
FLAT_SECTION = "Работы технического обслуживания"


def required_text(value: Column) -> Column:
    """The text of a variant; null, which makes the plan invalid, if it isn't a string or is blank."""
    text = F.try_variant_get(value, "$", "string")
    return F.when((F.schema_of_variant(value) == "STRING") & text.rlike(r"\S"), text)


def optional_text(value: Column) -> Column:
    """As required_text, but a missing value, null and the word `null` in any case are null (see optional_valid)."""
    return F.when(~_absent(value), required_text(value))


def _absent(value: Column) -> Column:
    return F.coalesce(F.is_variant_null(value), F.lit(True)) | F.coalesce(F.lower(F.try_variant_get(value, "$", "string")) == "null", F.lit(False))


def optional_valid(value: Column) -> Column:
    return _absent(value) | required_text(value).isNotNull()


def description(value: Column) -> Column:
    """A string as an array of it, a nonempty array of texts as it is, else null."""
    items = F.try_variant_get(value, "$", "array<variant>")
    texts = F.transform(items, required_text)
    listed = F.when((F.size(items) > 0) & F.forall(texts, lambda t: t.isNotNull()), texts)
    return F.when(F.schema_of_variant(value) == "STRING", F.when(required_text(value).isNotNull(), F.array(required_text(value)))).otherwise(listed)


def _get(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def plan_rows(plans: DataFrame, plan: str = "plan", json: str = "json") -> DataFrame:
    """(plan, section, name, position, number, deviceName, maintenanceType, description, registrationNumber, frequency, valid): the rows of every plan.

    If all items of `sections` have `number` and none has `rows`, they are the rows of one section of fixed name. A row is valid if its
    texts and description are there; `number` is the text of the value, for positive_numbers and renumber. Plans that aren't JSON, that
    lack the arrays `sections` or `consumables`, and sections without a name, or without rows, give one row with valid false and null
    fields. A plan with no sections gives no row."""
    v = plans.select(F.col(plan).alias("plan"), F.try_parse_json(json).alias("__v"))
    v = v.withColumns({"__s": F.try_variant_get("__v", "$.sections", "array<variant>"), "__ok": F.try_variant_get("__v", "$.consumables", "array<variant>").isNotNull()})
    has = lambda s, name: F.coalesce(_get(s, name).isNotNull(), F.lit(False))
    flat = (F.size("__s") > 0) & F.forall("__s", lambda s: has(s, "number") & ~has(s, "rows"))
    nested = F.transform("__s", lambda s: F.struct(required_text(_get(s, "name")).alias("name"), F.try_variant_get(s, "$.rows", "array<variant>").alias("rows")))
    sections = F.when(F.col("__s").isNull() | ~F.col("__ok"), F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("array<variant>").alias("rows")))).when(
        flat, F.array(F.struct(F.lit(FLAT_SECTION).alias("name"), F.col("__s").alias("rows")))
    )
    s = v.select("plan", F.posexplode(F.coalesce(sections, nested)).alias("section", "__x"))
    none = F.array(F.lit(None).cast("variant"))
    rows = F.when((F.size("__x.rows") > 0) & F.col("__x.name").isNotNull(), F.col("__x.rows")).otherwise(none)
    r = s.select("plan", "section", F.col("__x.name").alias("name"), F.posexplode(rows).alias("position", "__r"))
    g = lambda name: _get(F.col("__r"), name)
    made = r.select(
        "plan", "section", "name", "position", F.try_variant_get("__r", "$.number", "string").alias("number"),
        *[required_text(g(c)).alias(c) for c in ("deviceName", "maintenanceType", "frequency")],
        description(g("maintenanceWorkDescription")).alias("description"), optional_text(g("registrationNumber")).alias("registrationNumber"), optional_valid(g("registrationNumber")).alias("__opt"),
    )
    whole = F.col("__opt") & F.forall(F.array("number", "deviceName", "maintenanceType", "frequency"), lambda c: c.isNotNull()) & F.col("description").isNotNull()
    return made.withColumn("valid", whole).drop("__opt")
