"""The canonical catalog's control plane: a few maps on the driver, changed by one writer at a time.

The data plane never reads these maps; it joins with the frames that `Catalog.frames` makes of them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

KINDS = ("competition", "season", "team", "player", "match")
LIVING = KINDS[:4]  # matches have no lifecycle
ACTIVE, DEPRECATED, MERGED = "active", "deprecated", "merged"


class CatalogError(ValueError):
    """A change that the catalog's rules forbid; nothing has changed."""


class Reference(NamedTuple):
    provider: str
    id: str
    match_id: str | None = None

    @property
    def order(self) -> tuple:
        return self.provider, self.id, self.match_id is not None, self.match_id or ""

    def __str__(self) -> str:
        return f"{self.provider}:{self.id}" + (f"@{self.match_id}" if self.match_id is not None else "")


@dataclass(frozen=True, slots=True)
class Entity:
    id: int
    name: str
    status: str = ACTIVE
    merged_into: int | None = None
    competition_id: int | None = None  # of a season


@dataclass(frozen=True, slots=True)
class Match:
    id: int
    competition: str
    season: str
    home_team_id: int
    away_team_id: int
    kickoff: int | None = None
    home_score: int | None = None
    away_score: int | None = None

    @property
    def name(self) -> str:
        return f"{self.competition} {self.season}"


def blank(text: str | None) -> bool:
    return text is None or re.fullmatch(r"[ \t\n\x0b\f\r]*", text) is not None


def _require(condition: bool, message: str) -> None:
    if not condition:
        raise CatalogError(message)


@dataclass
class Catalog:
    entities: dict[str, dict[int, Entity | Match]] = field(default_factory=lambda: {k: {} for k in KINDS})
    mappings: dict[str, dict[Reference, int]] = field(default_factory=lambda: {k: {} for k in KINDS})

    def copy(self) -> Catalog:
        return Catalog({k: dict(v) for k, v in self.entities.items()}, {k: dict(v) for k, v in self.mappings.items()})

    # lookups

    def find(self, kind: str, id: int) -> Entity | Match | None:
        return self.entities[kind].get(id)

    def resolve(self, kind: str, reference: Reference) -> int | None:
        return self.mappings[kind].get(reference)

    def listed(self, kind: str) -> list[Entity | Match]:
        return [self.entities[kind][i] for i in sorted(self.entities[kind])]

    def mapped(self, kind: str) -> list[tuple[Reference, int]]:
        return sorted(self.mappings[kind].items(), key=lambda x: x[0].order)

    def active(self, kind: str, id: int) -> Entity:
        got = self.find(kind, id)
        _require(got is not None, f"unknown canonical {kind} {id}")
        _require(got.status == ACTIVE, f"canonical {kind} {id} is not active")
        return got

    # additions

    def add(self, kind: str, new: Entity | Match) -> None:
        _require(new.id > 0, f"canonical {kind} id must be positive")
        _require(new.id not in self.entities[kind], f"canonical {kind} {new.id} already exists")
        if isinstance(new, Match):
            _require(not blank(new.competition) and not blank(new.season), "match labels must not be blank")
            _require(new.home_team_id != new.away_team_id, "canonical match teams must be different")
            for t in (new.home_team_id, new.away_team_id):
                self.active("team", t)
            scores = (new.home_score, new.away_score)
            _require(scores == (None, None) or None not in scores and min(scores) >= 0, "canonical match scores must be non-negative and both present or missing")
        else:
            _require(not blank(new.name), f"canonical {kind} name must not be blank")
            _require(new.status == ACTIVE and new.merged_into is None, f"a new {kind} must be active")
            if kind == "season":
                self.active("competition", new.competition_id)
        self.entities[kind][new.id] = new

    def map(self, kind: str, reference: Reference, id: int) -> None:
        _require(not blank(reference.provider) and not blank(reference.id), "provider reference must not be blank")
        _require(reference.match_id is None or kind in ("team", "player"), "only team and player references can be scoped to a match")
        if kind == "match":
            _require(self.find(kind, id) is not None, f"unknown canonical match {id}")
        else:
            target = self.active(kind, id)
            if kind == "season":
                self.active("competition", target.competition_id)
        known = self.resolve(kind, reference)
        _require(known in (None, id), f"{reference} already maps to canonical {kind} {known}")
        self.mappings[kind][reference] = id

    def map_sides(self, provider: str, match_id: str, home: int, away: int) -> None:
        """The names Home and Away of one match; the first stays if the second fails."""
        self.map("team", Reference(provider, "Home", match_id), home)
        self.map("team", Reference(provider, "Away", match_id), away)

    # lifecycle

    def _relabel(self, where, **labels: str) -> None:
        for m in self.listed("match"):
            if where(m):
                self.entities["match"][m.id] = replace(m, **labels)

    def rename(self, kind: str, id: int, name: str) -> None:
        """Competitions and seasons take along every match that bears their label."""
        _require(kind in LIVING, f"a {kind} can't be renamed")
        _require(not blank(name), f"canonical {kind} name must not be blank")
        old = self.active(kind, id)
        self.entities[kind][id] = replace(old, name=name)
        if kind == "competition":
            self._relabel(lambda m: m.competition == old.name, competition=name)
        elif kind == "season":
            parent = self.entities["competition"][old.competition_id].name
            self._relabel(lambda m: (m.competition, m.season) == (parent, old.name), season=name)

    def deprecate(self, kind: str, id: int) -> None:
        _require(kind in LIVING, f"a {kind} can't be deprecated")
        old = self.find(kind, id)
        _require(old is not None, f"unknown canonical {kind} {id}")
        _require(old.status != MERGED, f"canonical {kind} {id} is merged")
        if kind == "competition":
            _require(not any(s.competition_id == id and s.status == ACTIVE for s in self.listed("season")), f"canonical competition {id} has active seasons")
        self.entities[kind][id] = replace(old, status=DEPRECATED)

    def merge(self, kind: str, source: int, target: int) -> None:
        """The source's mappings, seasons, matches and earlier aliases go to the target."""
        _require(kind in LIVING, f"a {kind} can't be merged")
        _require(source != target, f"a {kind} can't be merged into itself")
        a, b = self.active(kind, source), self.active(kind, target)
        if kind == "season":
            _require(a.competition_id == b.competition_id, "seasons of different competitions can't be merged")
        if kind == "team":
            both = {source, target}
            _require(not any({m.home_team_id, m.away_team_id} == both for m in self.listed("match")), "a match would have the merged team on both sides")
        if kind == "competition":
            for s in self.listed("season"):
                if s.competition_id == source:
                    self.entities["season"][s.id] = replace(s, competition_id=target)
            self._relabel(lambda m: m.competition == a.name, competition=b.name)
        elif kind == "season":
            parent = self.entities["competition"][a.competition_id].name
            self._relabel(lambda m: (m.competition, m.season) == (parent, a.name), season=b.name)
        elif kind == "team":
            for m in self.listed("match"):
                swap = lambda t: target if t == source else t
                self.entities["match"][m.id] = replace(m, home_team_id=swap(m.home_team_id), away_team_id=swap(m.away_team_id))
        for r, i in list(self.mappings[kind].items()):
            if i == source:
                self.mappings[kind][r] = target
        for e in self.listed(kind):
            if e.merged_into == source:
                self.entities[kind][e.id] = replace(e, merged_into=target)
        self.entities[kind][source] = replace(a, status=MERGED, merged_into=target)

    # frames

    def mapping_frame(self, spark: SparkSession, kind: str) -> DataFrame:
        return spark.createDataFrame([(*r, i) for r, i in self.mapped(kind)], "provider string, provider_id string, provider_match_id string, canonical_id long")

    def entity_frame(self, spark: SparkSession, kind: str) -> DataFrame:
        if kind == "match":
            return spark.createDataFrame([(m.id, m.competition, m.season, m.kickoff, m.home_team_id, m.away_team_id, m.home_score, m.away_score) for m in self.listed(kind)], "id long, competition string, season string, kickoff long, home_team_id long, away_team_id long, home_score int, away_score int")
        return spark.createDataFrame([(e.id, e.name, e.status, e.merged_into, e.competition_id) for e in self.listed(kind)], "id long, name string, status string, merged_into long, competition_id long")
