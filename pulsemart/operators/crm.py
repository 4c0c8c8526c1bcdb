"""Customers, devices and models joined into one row per active device."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import full_name

# The columns the mart takes from the customer side.
MART_COLUMNS = [
    "customer_id",
    "user_id",
    "customer_name",
    "customer_email",
    "customer_region",
    "customer_branch",
    "prosthesis_id",
    "prosthesis_serial",
    "chip_id",
    "prosthesis_model",
    "prosthesis_category",
    "firmware_version",
    "last_updated_at",
]


def is_active() -> Column:
    return F.col("status") == "active"


def has_chip(allow_empty: bool = True) -> Column:
    """Devices bound to a chip; an empty text counts as bound only where the source never writes one."""
    bound = F.col("chip_id").isNotNull()
    return bound if allow_empty else bound & (F.col("chip_id") != "")


def customer_prosthesis(
    customers: DataFrame, prostheses: DataFrame, models: DataFrame, version: str | None = None
) -> DataFrame:
    """One row per active device with its owner and model; with `version`, also the newest version of the three.

    No side is hinted for broadcast: models and customers grow with the business, so the size check of the
    optimizer and its runtime statistics decide, and a skewed model or owner is split by adaptive execution.
    """
    c = customers.select(
        "customer_id",
        F.col("external_id").alias("user_id"),
        "first_name",
        "last_name",
        "middle_name",
        full_name(F.col("last_name"), F.col("first_name"), F.col("middle_name")).alias("customer_full_name"),
        F.col("email").alias("customer_email"),
        "phone",
        F.col("region").alias("customer_region"),
        F.col("branch").alias("customer_branch"),
        F.col("updated_at").alias("customer_updated_at"),
        *_version_as(version, "_cv"),
    )
    p = prostheses.filter(is_active()).select(
        "prosthesis_id",
        F.col("serial_number").alias("prosthesis_serial"),
        "model_id",
        "customer_id",
        "chip_id",
        F.col("status").alias("prosthesis_status"),
        "firmware_version",
        "sold_date",
        "warranty_end_date",
        F.col("updated_at").alias("prosthesis_updated_at"),
        *_version_as(version, "_pv"),
    )
    m = models.select(
        "model_id",
        "model_code",
        F.col("model_name").alias("prosthesis_model"),
        F.col("category").alias("prosthesis_category"),
        *_version_as(version, "_mv"),
    )
    newest = [F.greatest("_cv", "_pv", "_mv").alias(version)] if version else []
    return (
        p.join(m, "model_id")
        .join(c, "customer_id")
        .withColumn("last_updated_at", F.greatest("customer_updated_at", "prosthesis_updated_at"))
        .select(
            "customer_id",
            "user_id",
            "first_name",
            "last_name",
            "middle_name",
            "customer_full_name",
            "customer_email",
            "phone",
            "customer_region",
            "customer_branch",
            "prosthesis_id",
            "prosthesis_serial",
            "chip_id",
            "prosthesis_status",
            "firmware_version",
            "model_code",
            "prosthesis_model",
            "prosthesis_category",
            "sold_date",
            "warranty_end_date",
            "customer_updated_at",
            "prosthesis_updated_at",
            "last_updated_at",
            *newest,
        )
    )


def _version_as(version: str | None, name: str) -> list[Column]:
    return [F.col(version).alias(name)] if version else []


def mart_source(view: DataFrame, allow_empty_chip: bool = True, keep: list[str] | None = None) -> DataFrame:
    """The customer side of the mart join: devices bound to a chip, with the name under its mart column."""
    return (
        view.filter(has_chip(allow_empty_chip))
        .withColumnRenamed("customer_full_name", "customer_name")
        .select(*MART_COLUMNS, *(keep or []))
    )
