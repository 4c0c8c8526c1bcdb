"""User profiles and consent, from event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import defaults
from . import upsert


def merge_profiles(logins: DataFrame) -> DataFrame:
    """One profile per user from login records: a field missing in a later login keeps its older value; the
    identity provider and the login time are always those of the last login."""
    return upsert.coalesce_latest(logins, ["keycloak_user_id"], "last_login_at", always=["identity_provider"])


def consent_history(events: DataFrame, limit: int = defaults.CONSENT_HISTORY_LIMIT) -> DataFrame:
    """The newest consent events of every profile. The rank limit is applied before the shuffle as well, so a
    profile with very many events sends few of them."""
    newest_first = Window.partitionBy("user_profile_id").orderBy(F.desc("created_at"), F.desc("id"))
    return (
        events.withColumn("_rank", F.row_number().over(newest_first))
        .filter(F.col("_rank") <= limit)
        .select("user_profile_id", "client_id", "scopes", "action", "created_at")
    )


def current_consent(events: DataFrame) -> DataFrame:
    """Consent as of the last event of each profile: a grant sets the scopes, a revocation clears them but
    leaves the time of the last grant."""
    granted = F.col("action") == "granted"
    return (
        events.groupBy("user_profile_id")
        .agg(
            F.max(F.struct("created_at", "id", "action", "scopes")).alias("_last"),
            F.max(F.when(granted, F.col("created_at"))).alias("consent_given_at"),
        )
        .select(
            "user_profile_id",
            (F.col("_last.action") == "granted").alias("consent_given"),
            "consent_given_at",
            F.when(F.col("_last.action") == "granted", F.col("_last.scopes")).alias("consent_scopes"),
        )
    )


