"""Records of a registry from the JSON of its search answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import safe_date

_SCHEMA = "struct<content:array<struct<id:bigint,noRu:string,name:string,producer:struct<name:string>,status:struct<code:string>,endDateRu:string>>>"


def _text(value: Column) -> Column:
    return F.when(value.rlike(r"\S"), value)


def read_records(answers: DataFrame, json: str = "json") -> DataFrame:
    """(id, registration, name, producer, active, expires): one row per record with a number and a name.

    The rows serve as registry of operators.registry.lookup. Answers that aren't JSON, and null, have no records; dates that aren't dates are null."""
    r = answers.select(F.explode(F.from_json(json, _SCHEMA)["content"]).alias("r")).select("r.*")
    made = r.select(
        "id", _text(F.col("noRu")).alias("registration"), _text(F.col("name")).alias("name"), _text(F.col("producer.name")).alias("producer"),
        F.coalesce(F.lower("status.code") == "active", F.lit(False)).alias("active"), safe_date(F.col("endDateRu")).alias("expires"),
    )
    return made.where("registration is not null and name is not null")
