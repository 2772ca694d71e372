"""Provider references against a canonical catalog: lookups, event resolution, and the changes that renames and merges make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REFERENCE = ["provider", "provider_id", "provider_match_id"]


def same_reference(left: DataFrame, right: DataFrame) -> Column:
    """Equality of references; an unscoped one equals only an unscoped one."""
    return (left["provider"] == right["provider"]) & (left["provider_id"] == right["provider_id"]) & left["provider_match_id"].eqNullSafe(right["provider_match_id"])


def resolve(references: DataFrame, mappings: DataFrame, out: str = "canonical_id") -> DataFrame:
    """Add the canonical id of each reference, null where it has none. A reference has one mapping at most."""
    m = mappings.select(F.col("provider").alias("_p"), F.col("provider_id").alias("_i"), F.col("provider_match_id").alias("_m"), F.col("canonical_id").alias(out))
    on = (F.col("provider") == F.col("_p")) & (F.col("provider_id") == F.col("_i")) & F.col("provider_match_id").eqNullSafe(F.col("_m"))
    return references.join(m, on, "left").drop("_p", "_i", "_m")


def unresolved(references: DataFrame, mappings: DataFrame) -> DataFrame:
    """References without a mapping."""
    return references.join(mappings, same_reference(references, mappings), "left_anti")


def event_keys(events: DataFrame) -> DataFrame:
    """Events with the keys that find their identities: team and player by id, unscoped; without an id by name, scoped to the match. A present id that no mapping knows never falls back to the name."""
    match = F.col("match_id").cast("string")
    keys = {"_match_key": match}
    for who in ("team", "player"):
        by_id = F.col(f"{who}_id").isNotNull()
        keys[f"_{who}_key"] = F.when(by_id, F.col(f"{who}_id").cast("string")).otherwise(F.col(f"{who}_name"))
        keys[f"_{who}_scope"] = F.when(~by_id, match)
    return events.withColumns(keys)


def resolve_events(events: DataFrame, match_mappings: DataFrame, team_mappings: DataFrame, player_mappings: DataFrame) -> DataFrame:
    """Add canonical_match_id, canonical_team_id and canonical_player_id; the provider's own ids stay. Three equi-joins; the optimizer broadcasts a catalog that is small."""
    out = event_keys(events)
    for who, mappings, scope in (("match", match_mappings, F.lit(None).cast("string")), ("team", team_mappings, F.col("_team_scope")), ("player", player_mappings, F.col("_player_scope"))):
        m = mappings.select(F.col("provider").alias("_p"), F.col("provider_id").alias("_i"), F.col("provider_match_id").alias("_m"), F.col("canonical_id").alias(f"canonical_{who}_id"))
        on = (F.col("provider") == F.col("_p")) & (F.col(f"_{who}_key") == F.col("_i")) & scope.eqNullSafe(F.col("_m"))
        out = out.join(m, on, "left").drop("_p", "_i", "_m")
    return out.drop("_match_key", "_team_key", "_team_scope", "_player_key", "_player_scope")


def deduplicated(records: DataFrame, keys: list[str], payload: list[str], order: str = "_ord") -> DataFrame:
    """One record a key, the first by order, with `conflict`: whether records of the key differ in their payload; a null there is a value."""
    same = F.struct(*payload)
    first = F.min_by(F.struct(*[c for c in records.columns if c not in keys]), order).alias("_first")
    got = records.groupBy(*keys).agg(first, (F.count_distinct(same) > 1).alias("conflict"))
    return got.select(*keys, "_first.*", "conflict")


def require_agreement(records: DataFrame, keys: list[str]) -> DataFrame:
    """Raises if any deduplicated record conflicts; returns the records without that column."""
    first = records.where("conflict").select(F.concat_ws(":", *keys).alias("key")).agg(F.min("key")).first()[0]
    if first is not None:
        raise ValueError(f"Conflicting provider metadata for '{first}'")
    return records.drop("conflict")
