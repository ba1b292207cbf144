"""Structured extraction as column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.plans.policy import CHARSETS, FieldRule


def extract_structured(rows: DataFrame, payload: str, schema: dict[str, FieldRule]) -> DataFrame:
    """Adds ok and value (JSON of the schema's fields only): every field must be a string that its rule allows.

    A payload that isn't an object, lacks a field or breaks a rule is rejected whole.
    """
    fields = F.from_json(payload, "map<string,string>")
    types = F.transform_values(F.from_json(payload, "map<string,variant>"), lambda _, v: F.schema_of_variant(v))
    ok = F.col("_f").isNotNull()
    for name, rule in schema.items():
        v = F.col("_f")[name]
        test = v.isin(*rule.values) if rule.kind == "enum" else F.length(v).between(1, rule.max_length) & v.rlike(f"^{CHARSETS[rule.charset]}$") & ~v.contains("\n")
        ok = ok & F.coalesce(test & (F.col("_t")[name] == "STRING"), F.lit(False))
    kept = F.to_json(F.struct(*(F.col("_f")[n].alias(n) for n in schema)))
    out = rows.withColumn("_f", fields).withColumn("_t", types).withColumn("ok", ok)
    return out.withColumn("value", F.when(F.col("ok"), kept)).drop("_f", "_t")
