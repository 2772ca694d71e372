"""The review store: an audited catalog, candidates with decisions, and one revision number for all of it."""

from __future__ import annotations

import copy
import time
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import lru_cache
from sys import intern

from pyspark.sql import DataFrame, SparkSession

from .catalog import DEPRECATED, KINDS, MERGED, Catalog, CatalogError, Entity, Match, Reference, blank

UNRESOLVED, ACCEPTED, REJECTED = "unresolved", "accepted", "rejected"
MOST = 2**63 - 1


@dataclass(frozen=True, slots=True)
class Provenance:
    actor: str
    source: str
    reason: str
    recorded_at: int = field(default_factory=lambda: int(time.time()))

    def check(self) -> Provenance:
        for name in ("actor", "source", "reason"):
            if blank(getattr(self, name)):
                raise CatalogError(f"{name} must not be blank")
        return self


@dataclass(frozen=True, slots=True)
class Change:
    revision: int
    action: str
    kind: str
    canonical_id: int
    canonical_name: str
    provenance: Provenance
    reference: Reference | None = None
    related_id: int | None = None


@dataclass(frozen=True, slots=True)
class Evidence:
    status: str
    left: str | None = None
    right: str | None = None
    canonical: str | None = None
    left_source: str = ""
    right_source: str = ""


@dataclass(frozen=True, slots=True)
class MatchCandidate:
    left: Reference
    right: Reference
    confidence: float
    evidence: dict[str, Evidence]
    is_candidate: bool = True
    id: int = 0
    status: str = UNRESOLVED
    accepted_match_id: int | None = None
    rejection_reason: str | None = None
    decision: Provenance | None = None

    @property
    def key(self) -> tuple:
        return self.left, self.right


@dataclass(frozen=True, slots=True)
class EntityCandidate:
    kind: str
    reference: Reference
    canonical_id: int
    source: str
    confidence: float
    evidence: dict[str, Evidence]
    id: int = 0
    status: str = UNRESOLVED
    rejection_reason: str | None = None
    decision: Provenance | None = None

    @property
    def key(self) -> tuple:
        return self.kind, self.reference, self.canonical_id


class ReviewStore:
    def __init__(self, catalog: Catalog | None = None, revision: int = 0):
        self.catalog = catalog or Catalog()
        self.revision = revision
        self.changes: list[Change] = []
        self.matches: dict[int, MatchCandidate] = {}
        self.entities: dict[int, EntityCandidate] = {}

    def copy(self) -> ReviewStore:
        other = copy.copy(self)
        other.catalog = self.catalog.copy()
        other.changes, other.matches, other.entities = list(self.changes), dict(self.matches), dict(self.entities)
        return other

    def _next(self) -> int:
        if self.revision >= MOST:
            raise CatalogError("the store has no revision left")
        return self.revision + 1

    def _record(self, action: str, kind: str, id: int, provenance: Provenance, reference: Reference | None = None, related: int | None = None) -> Change:
        self.revision = self._next()
        change = Change(self.revision, action, kind, id, self.catalog.find(kind, id).name, provenance, reference, related)
        self.changes.append(change)
        return change

    # audited catalog changes: each returns its audit row, None where nothing had to change

    def add(self, kind: str, new: Entity | Match, provenance: Provenance) -> Change:
        provenance.check()
        self._next()
        self.catalog.add(kind, new)
        return self._record("add", kind, new.id, provenance)

    def map(self, kind: str, reference: Reference, id: int, provenance: Provenance) -> Change | None:
        if self.catalog.resolve(kind, reference) == id:
            return None
        provenance.check()
        self._next()
        self.catalog.map(kind, reference, id)
        return self._record("map", kind, id, provenance, reference)

    def rename(self, kind: str, id: int, name: str, provenance: Provenance) -> Change | None:
        known = self.catalog.find(kind, id)
        if known is None:
            raise CatalogError(f"unknown canonical {kind} {id}")
        if kind != "match" and known.name == name:
            return None
        provenance.check()
        self._next()
        self.catalog.rename(kind, id, name)
        return self._record("rename", kind, id, provenance)

    def deprecate(self, kind: str, id: int, provenance: Provenance) -> Change | None:
        known = self.catalog.find(kind, id)
        if kind != "match" and known is not None and known.status == DEPRECATED:
            return None
        provenance.check()
        self._next()
        self.catalog.deprecate(kind, id)
        return self._record("deprecate", kind, id, provenance)

    def merge(self, kind: str, source: int, target: int, provenance: Provenance) -> Change | None:
        known, into = self.catalog.find(kind, source), self.catalog.find(kind, target)
        if kind != "match" and source != target and known is not None and known.status == MERGED and into is not None:
            final = into.merged_into if into.status == MERGED else target
            if known.merged_into == final:
                return None
        provenance.check()
        self._next()
        self.catalog.merge(kind, source, target)
        return self._record("merge", kind, source, provenance, related=target)

    # candidates

    def add_match_candidates(self, found: Iterable[MatchCandidate]) -> list[int]:
        """Ids of those that were new; one revision for all of them."""
        found = list(found)
        for c in found:
            if not c.is_candidate or c.left == c.right or not 0 <= c.confidence <= 1:
                raise CatalogError("only qualified comparisons can become candidates")
        return self._take(self.matches, found)

    def add_entity_candidates(self, found: Iterable[EntityCandidate]) -> list[int]:
        found = list(found)
        for c in found:
            if blank(c.source) or blank(c.reference.provider) or blank(c.reference.id) or c.canonical_id <= 0 or not 0 < c.confidence <= 1 or c.evidence["name"].status != "agreeing":
                raise CatalogError("malformed entity candidate")
            self.catalog.active(c.kind, c.canonical_id)
        return self._take(self.entities, found)

    def _take(self, store: dict, found: list) -> list[int]:
        known = {c.key for c in store.values()}
        fresh = []
        for c in found:
            if c.key not in known:
                known.add(c.key)
                fresh.append(c)
        del known
        if not fresh:
            return []
        self.revision = self._next()
        top = max(store, default=0)
        for i, c in enumerate(fresh, top + 1):
            store[i] = replace(c, id=i, status=UNRESOLVED)
        return list(range(top + 1, top + 1 + len(fresh)))

    def known_entities(self, spark: SparkSession, kind: str) -> DataFrame:
        """Keys and ids of the stored candidates of a kind; ids count over all kinds."""
        rows = [(*c.reference, c.canonical_id, i) if c.kind == kind else (None, None, None, None, i) for i, c in self.entities.items()]
        return spark.createDataFrame(rows, "provider string, provider_id string, provider_match_id string, canonical_id long, id long")

    def known_matches(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c.left.provider, c.left.id, c.right.provider, c.right.id, i) for i, c in self.matches.items()], "l_provider string, l_id string, r_provider string, r_id string, id long")

    def _get(self, store: dict, id: int):
        if id not in store:
            raise CatalogError(f"unknown candidate {id}")
        return store[id]

    def match_candidates(self, status: str | None = None) -> list[MatchCandidate]:
        return [c for _, c in sorted(self.matches.items()) if status in (None, c.status)]

    def entity_candidates(self, kind: str | None = None, status: str | None = None) -> list[EntityCandidate]:
        return [c for _, c in sorted(self.entities.items()) if status in (None, c.status) and kind in (None, c.kind)]

    def accept_match(self, id: int, canonical_id: int, provenance: Provenance) -> bool:
        """Maps both provider matches, after checking both; no audit row: the candidate keeps the provenance."""
        c = self._get(self.matches, id)
        if c.status == ACCEPTED and c.accepted_match_id == canonical_id:
            return False
        if c.status != UNRESOLVED:
            raise CatalogError(f"candidate {id} is already {c.status}")
        provenance.check()
        if self.catalog.find("match", canonical_id) is None:
            raise CatalogError(f"unknown canonical match {canonical_id}")
        for r in (c.left, c.right):
            if self.catalog.resolve("match", r) not in (None, canonical_id):
                raise CatalogError(f"{r} already maps to another canonical match")
        revision = self._next()
        for r in (c.left, c.right):
            self.catalog.map("match", r, canonical_id)
        self.matches[id] = replace(c, status=ACCEPTED, accepted_match_id=canonical_id, decision=provenance)
        self.revision = revision
        return True

    def accept_entity(self, id: int, provenance: Provenance) -> bool:
        """Maps the reference through the audited call; a conflict leaves the candidate as it was."""
        c = self._get(self.entities, id)
        if c.status == ACCEPTED:
            return False
        if c.status == REJECTED:
            raise CatalogError(f"candidate {id} is already rejected")
        provenance.check()
        if self.map(c.kind, c.reference, c.canonical_id, provenance) is None:
            self.revision = self._next()
        self.entities[id] = replace(c, status=ACCEPTED, decision=provenance)
        return True

    def _reject(self, store: dict, id: int, provenance: Provenance) -> bool:
        c = self._get(store, id)
        if c.status == REJECTED and c.rejection_reason == provenance.reason:
            return False
        if c.status != UNRESOLVED:
            raise CatalogError(f"candidate {id} is already {c.status}")
        provenance.check()
        self.revision = self._next()
        store[id] = replace(c, status=REJECTED, rejection_reason=provenance.reason, decision=provenance)
        return True

    def reject_match(self, id: int, provenance: Provenance) -> bool:
        return self._reject(self.matches, id, provenance)

    def reject_entity(self, id: int, provenance: Provenance) -> bool:
        return self._reject(self.entities, id, provenance)

    # integrity, checked when a store is read

    def _check_change(self, c: Change, bad) -> None:
        """An audit row against the catalog as it is now: what was added is there, what was mapped leads to its entity, what was deprecated or merged is so still."""
        entity = self.catalog.find(c.kind, c.canonical_id)
        bad(c.action not in ("add", "map", "rename", "deprecate", "merge"), f"unknown audit action '{c.action}'")
        if c.kind == "match":
            bad(c.action in ("rename", "deprecate", "merge"), "matches have no lifecycle")
            return
        if c.action == "map":
            bad(self.catalog.resolve(c.kind, c.reference) != (entity.merged_into or c.canonical_id), "an audited mapping isn't in the catalog")
        elif c.action == "deprecate":
            bad(entity.status != DEPRECATED, "an audited deprecation isn't in the catalog")
        elif c.action == "merge":
            into = self.catalog.find(c.kind, c.related_id)
            bad(into is None or entity.status != MERGED or entity.merged_into != (into.merged_into or c.related_id), "an audited merge isn't in the catalog")

    def check(self) -> None:
        bad = lambda condition, message: (_ for _ in ()).throw(CatalogError(message)) if condition else None
        last = 0
        for c in self.changes:
            bad(c.revision <= last or c.revision > self.revision, "audit revisions must rise and not pass the store's")
            bad(self.catalog.find(c.kind, c.canonical_id) is None, "an audit row names an unknown entity")
            bad(blank(c.canonical_name), "an audit row has a blank name")
            bad((c.action == "map") != (c.reference is not None), "only mappings have a provider reference")
            bad((c.action == "merge") != (c.related_id is not None), "only merges have a related entity")
            c.provenance.check()
            last = c.revision
            self._check_change(c, bad)
        living = {(k, e.id): e for k in KINDS[:4] for e in self.catalog.listed(k)}
        named = {(c.kind, c.canonical_id): c.canonical_name for c in self.changes if c.action in ("add", "rename", "deprecate", "merge")}
        for key, name in named.items():
            bad(key in living and living[key].name != name, "an entity's name differs from its last audit row's")
        for store in (self.matches, self.entities):
            bad(len({c.key for c in store.values()}) < len(store), "candidates must be distinct")
            for i, c in store.items():
                bad(i <= 0 or i != c.id, "candidate ids must be positive")
                bad((c.status == REJECTED) != (c.rejection_reason is not None), "a rejection has a reason, and only a rejection")
                bad(c.status == UNRESOLVED and c.decision is not None, "an unresolved candidate has no decision")
        for c in self.matches.values():
            bad(not c.is_candidate, "stored comparisons must be qualified")
            bad((c.status == ACCEPTED) != (c.accepted_match_id is not None), "an accepted candidate names its match")
            if c.status == ACCEPTED:
                bad(any(self.catalog.resolve("match", r) != c.accepted_match_id for r in c.key), "an accepted candidate's matches must be mapped")
        for c in self.entities.values():
            bad(c.status != UNRESOLVED and c.decision is None, "a decision on an entity has its provenance")
            if c.status == ACCEPTED:
                mapped, own = self.catalog.resolve(c.kind, c.reference), self.catalog.find(c.kind, c.canonical_id)
                bad(own is None or mapped != (own.merged_into or c.canonical_id), "an accepted candidate's reference must be mapped to its entity, or to what that was merged into")


def from_row(row, kind: str, source: str) -> EntityCandidate:
    """A candidate of the data plane's row."""
    return EntityCandidate(kind, Reference(intern(row["provider"]), row["provider_id"], row["provider_match_id"]), row["canonical_id"], source, row["confidence"], name_evidence(row["name"], row["canonical_name"], row["context"]))


@lru_cache(4_096)
def name_evidence(left: str | None, right: str | None, context: str) -> dict[str, Evidence]:
    """One for all candidates that agree in it; evidence is never changed."""
    return {"name": Evidence("agreeing", left, right), "context": Evidence(context)}


def from_pair(row) -> MatchCandidate:
    fields = ("competition", "season", "kickoff", "home_team", "away_team", "score")
    made = {f: Evidence(row[f]["status"], row[f]["left_value"], row[f]["right_value"], row[f]["canonical_value"], row["l_provider"], row["r_provider"]) for f in fields}
    return MatchCandidate(Reference(row["l_provider"], row["l_id"]), Reference(row["r_provider"], row["r_id"]), row["confidence"], made)


