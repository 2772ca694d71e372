"""How a catalog covers a provider's metadata: one outcome a record, and a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import identity_name, is_blank
from .identity import REFERENCE, resolve

ACTIVE = "active"


def coverage(records: DataFrame, canonical: DataFrame, mappings: DataFrame, competitions: DataFrame | None = None, competition_mappings: DataFrame | None = None) -> DataFrame:
    """Outcome, canonical ids, name status and context status of each record.

    records: provider, provider_id, provider_match_id, name; for seasons also parent_provider_id. canonical: id, name,
    status; for seasons also competition_id. Two lookups, and one join on the normalized name whose matches are gathered
    by id; one cascade of cases decides.
    """
    season = competitions is not None
    named = ~(F.col("name").isNull() | is_blank(F.col("name")))
    rows = resolve(records, mappings, "mapped_id").withColumn("named", named)
    entity = canonical.select(F.col("id").alias("mapped_id"), F.col("name").alias("m_name"), F.col("status").alias("m_status"), (F.col("competition_id") if season else F.lit(None).cast("long")).alias("m_parent"))
    rows = rows.join(entity, "mapped_id", "left")
    if season:
        parent = competition_mappings.select(F.col("provider").alias("_p"), F.col("provider_id").alias("_i"), F.col("canonical_id").alias("parent_id"))
        rows = rows.join(parent, (F.col("provider") == F.col("_p")) & (F.col("parent_provider_id") == F.col("_i")), "left").drop("_p", "_i")
        rows = rows.join(competitions.select(F.col("id").alias("parent_id"), F.col("status").alias("p_status")), "parent_id", "left")
    else:
        rows = rows.withColumn("parent_id", F.lit(None).cast("long")).withColumn("p_status", F.lit(None).cast("string"))
    by_name = canonical.groupBy(identity_name(F.col("name")).alias("_key")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("id"), F.col("status"), (F.col("competition_id") if season else F.lit(None).cast("long")).alias("parent")))).alias("exact")
    )
    rows = rows.withColumn("_key", F.when(F.col("named"), identity_name(F.col("name")))).join(by_name, "_key", "left")
    exact = F.coalesce("exact", F.array().cast("array<struct<id:bigint,status:string,parent:bigint>>"))
    under = F.filter(exact, lambda x: x["parent"] == F.col("parent_id"))
    unmapped_parent, sleeping = F.col("parent_id").isNull(), F.col("p_status") != ACTIVE
    if season:
        conflict = ~unmapped_parent & ~sleeping & (F.size(exact) > 0) & (F.size(under) == 0)
        kept = F.when(unmapped_parent, exact).when(conflict, exact).otherwise(under)
    else:
        conflict, kept = F.lit(False), exact
    rows = rows.withColumn("_kept", kept).withColumn("_conflict", conflict)
    mapped = F.col("mapped_id").isNotNull()
    live = F.filter("_kept", lambda x: x["status"] == ACTIVE)
    outcome = (
        F.when(mapped, F.when(F.col("m_status") == ACTIVE, "mapped_active").otherwise("mapped_inactive"))
        .when(~F.col("named"), "missing_name")
        .when(F.col("_conflict"), "no_exact_match")
        .when(F.size(live) == 1, "exact_match")
        .when(F.size(live) > 1, "ambiguous_exact_match")
        .when(F.size("_kept") > 0, "inactive_exact_match")
        .otherwise("no_exact_match")
    )
    ids = (
        F.when(mapped, F.array("mapped_id"))
        .when(~F.col("named"), F.array().cast("array<bigint>"))
        .when(F.col("_conflict") | (F.size(live) == 0), F.transform("_kept", lambda x: x["id"]))
        .otherwise(F.transform(live, lambda x: x["id"]))
    )
    name_status = (
        F.when(~F.col("named"), "missing")
        .when(mapped, F.when(F.col("_key") == identity_name(F.col("m_name")), "agreeing").otherwise("conflicting"))
        .when(F.size("_kept") > 0, "agreeing")
        .otherwise("missing")
    )
    if season:
        context = (
            F.when(unmapped_parent, "missing")
            .when(sleeping, "inactive")
            .when(mapped, F.when(F.col("m_parent") == F.col("parent_id"), "agreeing").otherwise("conflicting"))
            .when(F.col("named") & F.col("_conflict"), "conflicting")
            .otherwise("agreeing")
        )
    else:
        context = F.lit("not_applicable")
    return rows.select(*REFERENCE, "name", outcome.alias("outcome"), ids.alias("canonical_ids"), name_status.alias("name_status"), context.alias("context_status"))


def ordered(records: DataFrame) -> DataFrame:
    return records.orderBy("provider", "provider_id", F.asc_nulls_first("provider_match_id"))


def summary(records: DataFrame) -> DataFrame:
    """Twelve counts over coverage records."""
    n = lambda condition: F.count_if(F.expr(condition))
    return records.agg(
        F.count(F.lit(1)).alias("provider_records"),
        n("outcome = 'mapped_active'").alias("mapped_active"),
        n("outcome = 'mapped_inactive'").alias("mapped_inactive"),
        n("outcome = 'exact_match'").alias("unmapped_exact_matches"),
        n("outcome = 'ambiguous_exact_match'").alias("ambiguous_exact_matches"),
        n("outcome = 'inactive_exact_match'").alias("inactive_exact_matches"),
        n("outcome = 'no_exact_match'").alias("no_exact_matches"),
        F.count_if(F.col("name").isNull() | is_blank(F.col("name"))).alias("missing_names"),
        n("outcome in ('mapped_active', 'mapped_inactive') and name_status = 'conflicting'").alias("mapped_name_mismatches"),
        n("context_status = 'missing'").alias("parent_context_missing"),
        n("context_status = 'conflicting'").alias("parent_context_conflicts"),
        n("context_status = 'inactive'").alias("parent_context_inactive"),
    )
