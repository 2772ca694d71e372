"""Candidates for review: entities by equal names, matches by weighted evidence."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import identity_name, is_blank, score_text
from ..settled import positions
from .identity import REFERENCE, unresolved

# fixed values: the evidence's weights, in the order in which they are added, and the default tolerances
WEIGHTS = (("home_team", 0.25), ("away_team", 0.25), ("kickoff", 0.20), ("score", 0.15), ("competition", 0.10), ("season", 0.05))
AGREE_SECONDS, CONFLICT_SECONDS, LEAST_CONFIDENCE = 300, 86_400, 0.70
#: What names a candidate.
ENTITY_KEYS, MATCH_KEYS = [*REFERENCE, "canonical_id"], ["l_provider", "l_id", "r_provider", "r_id"]
FIELDS = ("competition", "season", "kickoff", "home_team", "away_team", "score")


@dataclass(frozen=True)
class MatchOptions:
    agree_seconds: int = AGREE_SECONDS
    conflict_seconds: int = CONFLICT_SECONDS
    least_confidence: float = LEAST_CONFIDENCE

    def __post_init__(self) -> None:
        if not 0 <= self.agree_seconds <= self.conflict_seconds:
            raise ValueError("Kickoff tolerances must be ordered and not negative")
        if not (math.isfinite(self.least_confidence) and 0 <= self.least_confidence <= 1):
            raise ValueError("The least confidence must be between 0 and 1")


def entity_candidates(records: DataFrame, canonical: DataFrame, mappings: DataFrame, parent_mappings: DataFrame | None = None) -> DataFrame:
    """Pairs of unmapped provider records and active canonical entities of equal normalized names.

    records: provider, provider_id, provider_match_id, name and, for seasons, parent_provider_id; one a reference.
    canonical: id, name, status and, for seasons, competition_id. With parent_mappings, a record whose parent is mapped
    pairs only with that parent's entities, at confidence 1; one whose parent isn't keeps all pairs, at 0.9.
    """
    named = unresolved(records, mappings).where(F.col("name").isNotNull() & ~is_blank(F.col("name")))
    left = named.withColumn("_key", identity_name(F.col("name")))
    right = canonical.where(F.col("status") == "active").select(F.col("id").alias("canonical_id"), F.col("name").alias("canonical_name"), identity_name(F.col("name")).alias("_key"), *(["competition_id"] if parent_mappings is not None else []))
    none = F.lit(None).cast("long")
    if parent_mappings is not None:
        parents = left.select(*REFERENCE, "name", "_key", "parent_provider_id")
        lookup = parent_mappings.select(F.col("provider").alias("_pp"), F.col("provider_id").alias("_pi"), F.col("canonical_id").alias("parent_id"))
        left = parents.join(lookup, (F.col("provider") == F.col("_pp")) & (F.col("parent_provider_id") == F.col("_pi")), "left").drop("_pp", "_pi")
    else:
        left = left.withColumn("parent_id", none)
        right = right.withColumn("competition_id", none)
    pairs = left.join(right, "_key").where(F.col("parent_id").isNull() | (F.col("parent_id") == F.col("competition_id")))
    known = F.col("parent_id").isNotNull()
    confidence = F.lit(1.0) if parent_mappings is None else F.when(known, 1.0).otherwise(0.9)
    return pairs.select(*REFERENCE, "name", "canonical_id", "canonical_name", F.when(known, "agreeing").otherwise("missing").alias("context"), confidence.cast("double").alias("confidence"))


def entity_order() -> list[str | Column]:
    """The order of review: unscoped references before scoped ones."""
    return ["provider", "provider_id", F.asc_nulls_first("provider_match_id"), "canonical_id"]


def evidence(status: Column, left: Column, right: Column, canonical: Column) -> Column:
    text = lambda c: c.cast("string")
    return F.struct(status.alias("status"), text(left).alias("left_value"), text(right).alias("right_value"), text(canonical).alias("canonical_value"))


def _label(field: str) -> Column:
    """Canonical ids decide where both sides have one; else ids of one provider; else names."""
    side = {s: {c: F.col(f"{s}_{field}_{c}") for c in ("id", "name", "canonical")} for s in ("l", "r")}
    l, r = side["l"], side["r"]
    both = l["canonical"].isNotNull() & r["canonical"].isNotNull()
    one_provider = F.col("l_provider") == F.col("r_provider")
    named = l["name"].isNotNull() & r["name"].isNotNull()
    same_name = identity_name(l["name"]) == identity_name(r["name"])
    status = (
        F.when(both, F.when(l["canonical"] == r["canonical"], "agreeing").otherwise("conflicting"))
        .when(one_provider, F.when(l["id"] == r["id"], "agreeing").otherwise("conflicting"))
        .when(~named, "missing")
        .when(same_name, "agreeing")
        .otherwise("uncertain")
    )
    found = F.when(both & (l["canonical"] == r["canonical"]), l["canonical"].cast("string")).when(~both & ~one_provider & named & same_name, identity_name(l["name"]))
    return evidence(status, F.coalesce(l["name"], l["id"]), F.coalesce(r["name"], r["id"]), found)


def _kickoff(options: MatchOptions) -> Column:
    apart = F.abs(F.col("l_kickoff") - F.col("r_kickoff"))
    status = F.when(apart.isNull(), "missing").when(apart <= options.agree_seconds, "agreeing").when(apart <= options.conflict_seconds, "uncertain").otherwise("conflicting")
    return evidence(status, F.col("l_kickoff"), F.col("r_kickoff"), F.lit(None))


def _team(side: str) -> Column:
    l, r = F.col(f"l_{side}_canonical"), F.col(f"r_{side}_canonical")
    opposite = "away" if side == "home" else "home"
    lo, ro = F.col(f"l_{opposite}_canonical"), F.col(f"r_{opposite}_canonical")
    twice = (l == r) & (lo == ro) & (l == lo)
    status = F.when(l.isNull() | r.isNull(), "missing").when(F.coalesce(twice, F.lit(False)), "conflicting").when(l == r, "agreeing").otherwise("conflicting")
    return evidence(status, F.col(f"l_{side}_team"), F.col(f"r_{side}_team"), F.when(status == "agreeing", l))


def _score() -> Column:
    l, r = score_text(F.col("l_home_score"), F.col("l_away_score")), score_text(F.col("r_home_score"), F.col("r_away_score"))
    status = F.when(l.isNull() | r.isNull(), "missing").when(l == r, "agreeing").otherwise("conflicting")
    return evidence(status, l, r, F.when(status == "agreeing", l))


def compared(pairs: DataFrame, options: MatchOptions = MatchOptions()) -> DataFrame:
    """Evidence of each pair of matches, its confidence, and whether it is a candidate. pairs has both sides' columns, prefixed l_ and r_."""
    made = {"competition": _label("competition"), "season": _label("season"), "kickoff": _kickoff(options), "home_team": _team("home"), "away_team": _team("away"), "score": _score()}
    out = pairs.withColumns({f: made[f] for f in FIELDS})
    share = lambda f: F.when(F.col(f"{f}.status") == "agreeing", 1.0).when(F.col(f"{f}.status") == "uncertain", 0.5).otherwise(0.0)
    total = F.lit(0.0)
    for f, w in WEIGHTS:
        total = total + F.lit(w) * share(f)
    fine = (F.col("home_team.status") == "agreeing") & (F.col("away_team.status") == "agreeing")
    for f in FIELDS:
        fine = fine & (F.col(f"{f}.status") != "conflicting")
    return out.withColumn("confidence", total).withColumn("is_candidate", fine & (F.col("confidence") >= options.least_confidence))


def side(matches: DataFrame, prefix: str) -> DataFrame:
    return matches.select(*[F.col(c).alias(f"{prefix}_{c}") for c in matches.columns])


def distinct_references() -> Column:
    return ~((F.col("l_provider") == F.col("r_provider")) & (F.col("l_id") == F.col("r_id")))


def match_candidates(left: DataFrame, right: DataFrame, options: MatchOptions = MatchOptions()) -> DataFrame:
    """All candidate pairs. A candidate's teams agree on both sides and differ from one another, so an equi-join on the canonical teams finds the same pairs as comparing all with all."""
    ready = lambda df: df.where("home_canonical is not null and away_canonical is not null and home_canonical <> away_canonical")
    l, r = side(ready(left), "l"), side(ready(right), "r")
    pairs = l.join(r, (F.col("l_home_canonical") == F.col("r_home_canonical")) & (F.col("l_away_canonical") == F.col("r_away_canonical"))).where(distinct_references())
    return compared(pairs, options).where("is_candidate")


def match_order() -> list[str | Column]:
    """Best first; ties by references, then by source order."""
    return [F.desc("confidence"), *MATCH_KEYS, "l__ord", "r__ord"]


def with_canonical_sides(matches: DataFrame, teams: DataFrame, competitions: DataFrame, seasons: DataFrame) -> DataFrame:
    """Provider matches with the canonical ids of their teams, competition and season."""
    out = matches
    for column, source, mappings in (("home_canonical", "home_team", teams), ("away_canonical", "away_team", teams), ("competition_canonical", "competition_id", competitions), ("season_canonical", "season_id", seasons)):
        m = mappings.where(F.col("provider_match_id").isNull()).select(F.col("provider").alias("_p"), F.col("provider_id").alias("_i"), F.col("canonical_id").alias(column))
        out = out.join(m, (F.col("provider") == F.col("_p")) & (F.col(source) == F.col("_i")), "left").drop("_p", "_i")
    return out


def upserted(new: DataFrame, existing: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """New candidates whose key isn't known yet, each key once, with ids that follow the greatest one; known ones keep their rows. A null in a key equals a null. Ids are dense in `order`; the ranking runs over range-partitioned rows, not in one task."""
    first = Window.partitionBy(*keys).orderBy(*order)
    known = existing.select(*[F.col(k).alias(f"_known_{k}") for k in keys])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_known_{k}")) for k in keys])
    fresh = new.join(known, same, "left_anti").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return numbered(fresh, order, existing)


def numbered(rows: DataFrame, order: list[str | Column], existing: DataFrame) -> DataFrame:
    """Add ids that follow the greatest of `existing`, dense in `order`."""
    top = existing.agg(F.max("id")).first()[0] or 0
    return positions(rows.orderBy(*order), "id").withColumn("id", F.col("id") + F.lit(top).cast("long") + 1)
