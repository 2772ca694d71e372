"""Review stores as JSON files: versions 1 to 4, written as 4, with a lock and a check of the revision."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import repeat
from sys import intern
from typing import TextIO

from ..operators.catalog import KINDS, Catalog, CatalogError, Entity, Match, Reference
from ..operators.review import Change, EntityCandidate, Evidence, MatchCandidate, Provenance, ReviewStore

#: Written as the format's name; any name that ends so is read.
SUFFIX = "-match-review"
FORMAT = "touchline" + SUFFIX
VERSION = 4
PLURAL = {"competition": "competitions", "season": "seasons", "team": "teams", "player": "players", "match": "matches"}


class ReviewFileError(ValueError):
    """A store that can't be read or written; files stay as they are."""


class _Rows(list):
    """A list for `json.dump` alone, whose elements are made as they are written."""

    def __init__(self, made: Iterable, n: int):
        super().__init__()
        self.made, self.n = made, n

    def __iter__(self) -> Iterator:
        return iter(self.made)

    def __len__(self) -> int:
        return self.n


def _reference(r: Reference, scoped: bool) -> dict:
    return {"provider": r.provider, "id": r.id, **({"match_id": r.match_id} if scoped else {})}


def _provenance(p: Provenance | None) -> dict | None:
    return p and {"actor": p.actor, "source": p.source, "reason": p.reason, "recorded_at_seconds": p.recorded_at}


def _entity(kind: str, e: Entity | Match) -> dict:
    if isinstance(e, Match):
        return {"id": e.id, "competition": e.competition, "season": e.season, "kickoff_seconds": e.kickoff, "home_team_id": e.home_team_id, "away_team_id": e.away_team_id, "home_score": e.home_score, "away_score": e.away_score}
    return {"id": e.id, **({"competition_id": e.competition_id} if kind == "season" else {}), "name": e.name, "status": e.status, "merged_into": e.merged_into}


def _mapping(kind: str, mapping: tuple[Reference, int]) -> dict:
    return {**_reference(mapping[0], kind in ("team", "player")), "canonical_id": mapping[1]}


def to_document(store: ReviewStore, rows: Callable[[Iterable, int], list] = lambda made, n: list(made)) -> dict:
    catalog: dict[str, list] = {}
    for kind in KINDS:
        catalog[PLURAL[kind]] = rows(map(_entity, repeat(kind), store.catalog.listed(kind)), len(store.catalog.entities[kind]))
        mapped = store.catalog.mapped(kind)
        catalog[f"{kind}_mappings"] = rows(map(_mapping, repeat(kind), mapped), len(mapped))
    decided = lambda c: {"id": c.id, "status": c.status, "rejection_reason": c.rejection_reason, "decision_provenance": _provenance(c.decision)}
    return {
        "format": FORMAT,
        "version": VERSION,
        "revision": store.revision,
        "catalog": catalog,
        "catalog_changes": rows((
            {
                "revision": c.revision,
                "action": c.action,
                "entity_type": c.kind,
                "canonical_id": c.canonical_id,
                "canonical_name": c.canonical_name,
                "provider": c.reference and c.reference.provider,
                "provider_id": c.reference and c.reference.id,
                "provider_match_id": c.reference and c.reference.match_id,
                "related_canonical_id": c.related_id,
                "provenance": _provenance(c.provenance),
            }
            for c in store.changes
        ), len(store.changes)),
        "entity_candidates": rows((
            decided(c)
            | {"entity_type": c.kind, "provider": _reference(c.reference, True), "canonical_id": c.canonical_id, "source": c.source, "confidence": c.confidence, "evidence": {k: {"status": e.status, "provider_value": e.left, "canonical_value": e.right} for k, e in c.evidence.items()}}
            for c in store.entity_candidates()
        ), len(store.entities)),
        "candidates": rows((
            decided(c)
            | {
                "accepted_match_id": c.accepted_match_id,
                "left_match": _reference(c.left, False),
                "right_match": _reference(c.right, False),
                "confidence": c.confidence,
                "is_candidate": c.is_candidate,
                "evidence": {k: {"status": e.status, "left_source": e.left_source, "right_source": e.right_source, "left_value": e.left, "right_value": e.right, "canonical_value": e.canonical} for k, e in c.evidence.items()},
            }
            for c in store.match_candidates()
        ), len(store.matches)),
    }


@lru_cache(4_096)
def _known_provenance(actor: str, source: str, reason: str, recorded_at: int) -> Provenance:
    return Provenance(actor, source, reason, recorded_at)


def _read_provenance(v: dict | None) -> Provenance | None:
    return v and _known_provenance(v["actor"], v["source"], v["reason"], v["recorded_at_seconds"])


@lru_cache(4_096)
def _known_evidence(*fields: tuple) -> dict[str, Evidence]:
    """One for all candidates that agree in it; evidence is never changed."""
    return {name: Evidence(*values) for name, *values in fields}


def _shared(text):
    """Texts that many records have are held once."""
    return intern(text) if isinstance(text, str) else text


def _read_reference(v: dict) -> Reference:
    return Reference(intern(v["provider"]), v["id"], v.get("match_id"))


def _read_entity(e: dict) -> Entity:
    return Entity(e["id"], _shared(e["name"]), intern(e.get("status", "active")), e.get("merged_into"), e.get("competition_id"))


def _read_match(e: dict) -> Match:
    return Match(e["id"], e["competition"], e["season"], e["home_team_id"], e["away_team_id"], e.get("kickoff_seconds"), e.get("home_score"), e.get("away_score"))


def _read_change(c: dict) -> Change:
    r = Reference(intern(c["provider"]), c["provider_id"], c.get("provider_match_id")) if c.get("provider") is not None else None
    return Change(c["revision"], intern(c["action"]), intern(c["entity_type"]), c["canonical_id"], _shared(c["canonical_name"]), _read_provenance(c["provenance"]), r, c.get("related_canonical_id"))


def _read_entity_candidate(c: dict) -> EntityCandidate:
    evidence = _known_evidence(*((k, e["status"], e["provider_value"], e["canonical_value"]) for k, e in c["evidence"].items()))
    return EntityCandidate(intern(c["entity_type"]), _read_reference(c["provider"]), c["canonical_id"], intern(c["source"]), c["confidence"], evidence, c["id"], intern(c["status"]), _shared(c.get("rejection_reason")), _read_provenance(c.get("decision_provenance")))


def _read_match_candidate(c: dict) -> MatchCandidate:
    evidence = {k: Evidence(e["status"], e["left_value"], e["right_value"], e["canonical_value"], e.get("left_source", ""), e.get("right_source", "")) for k, e in c["evidence"].items()}
    left, right = (Reference(c[s]["provider"], c[s]["id"]) for s in ("left_match", "right_match"))
    return MatchCandidate(left, right, c["confidence"], evidence, c["is_candidate"], c["id"], c["status"], c.get("accepted_match_id"), c.get("rejection_reason"), _read_provenance(c.get("decision_provenance")))


#: What each array's elements become, by the array's place in the document.
READERS: dict[tuple[str, ...], Callable[[dict], object]] = {("catalog", PLURAL[k]): _read_match if k == "match" else _read_entity for k in KINDS}
READERS |= {("catalog", f"{k}_mappings"): lambda m: (_read_reference(m), m["canonical_id"]) for k in KINDS}
READERS |= {("catalog_changes",): _read_change, ("entity_candidates",): _read_entity_candidate, ("candidates",): _read_match_candidate}


class _Stream:
    """A JSON document read a part at a time."""

    def __init__(self, file: TextIO):
        self.file, self.text, self.at, self.decoder = file, "", 0, json.JSONDecoder()

    def more(self) -> bool:
        part = self.file.read(1 << 18)
        self.text, self.at = self.text[self.at :] + part, 0
        return bool(part)

    def next(self) -> str:
        """The next character that is no white space; empty at the end."""
        while True:
            while self.at < len(self.text) and self.text[self.at] in " \t\r\n":
                self.at += 1
            if self.at < len(self.text) or not self.more():
                return self.text[self.at : self.at + 1]

    def take(self, *wanted: str) -> str:
        got = self.next()
        if got not in wanted:
            raise ValueError(f"expected {' or '.join(wanted)}, not '{got}'")
        self.at += 1
        return got

    def value(self):
        self.next()
        while True:
            try:
                got, end = self.decoder.raw_decode(self.text, self.at)
            except ValueError:
                if not self.more():
                    raise
                continue
            if end == len(self.text):  # a number may go on
                start = self.at
                if self.more():
                    continue
                end -= start
            self.at = end
            return got

    def items(self) -> Iterator:
        self.take("[")
        if self.next() == "]":
            self.take("]")
            return
        while True:
            yield self.value()
            if self.take(",", "]") == "]":
                return

    def document(self, readers: dict, at: tuple[str, ...] = ()):
        if self.next() == "[" and at in readers:
            return [readers[at](v) for v in self.items()]
        if self.next() != "{" or at not in ((), ("catalog",)):
            return self.value()
        out = {}
        self.take("{")
        if self.next() == "}":
            self.take("}")
            return out
        while True:
            key = self.value()
            if not isinstance(key, str):
                raise ValueError("a name is no text")
            self.take(":")
            out[key] = self.document(readers, (*at, key))
            if self.take(",", "}") == "}":
                return out


def _parsed(file: TextIO, readers: dict):
    """The document, its known arrays' elements read as they come."""
    stream = _Stream(file)
    got = stream.document(readers)
    if stream.next():
        raise ValueError("text after the document")
    return got


def from_document(document: dict) -> ReviewStore:
    """The final state is stored and restored as it is: renames and merges are not done again."""
    def read(v, at=()):
        if isinstance(v, dict) and at in ((), ("catalog",)):
            return {k: read(x, (*at, k)) for k, x in v.items()}
        return [READERS[at](x) for x in v] if at in READERS else v

    return _restored(read(document))


def _restored(document: dict) -> ReviewStore:
    if not isinstance(document, dict) or not str(document.get("format", "")).endswith(SUFFIX):
        raise CatalogError("the format is not a match review")
    version = document.get("version")
    if version not in range(1, VERSION + 1):
        raise CatalogError(f"unsupported version {version}")
    store = ReviewStore(revision=document["revision"] if version >= 2 else 0)
    raw = document["catalog"]
    for kind in KINDS:
        if version == 1 and kind in ("competition", "season"):
            continue
        for new in raw.pop(PLURAL[kind]):
            if new.id <= 0 or new.id in store.catalog.entities[kind]:
                raise CatalogError(f"canonical {kind} ids must be positive and distinct")
            store.catalog.entities[kind][new.id] = new
        for r, target in raw.pop(f"{kind}_mappings"):
            if r in store.catalog.mappings[kind] or target not in store.catalog.entities[kind]:
                raise CatalogError(f"{kind} mappings must be distinct and have a target")
            store.catalog.mappings[kind][r] = target
    _check_catalog(store.catalog)
    if version >= 2:
        store.changes = document.pop("catalog_changes")
    for held, key, since in ((store.entities, "entity_candidates", 3), (store.matches, "candidates", 1)):
        found = document.pop(key) if version >= since else []
        held |= {c.id: c for c in found}
        if len(held) < len(found):
            raise CatalogError("candidate ids must be distinct")
    store.check()
    return store


def _check_catalog(catalog: Catalog) -> None:
    for kind in KINDS[:4]:
        for e in catalog.listed(kind):
            if not e.name or (e.status == "merged") != (e.merged_into is not None):
                raise CatalogError(f"malformed canonical {kind} {e.id}")
            if e.merged_into is not None and e.merged_into not in catalog.entities[kind]:
                raise CatalogError(f"canonical {kind} {e.id} is merged into an unknown one")
            if kind == "season" and e.competition_id not in catalog.entities["competition"]:
                raise CatalogError(f"canonical season {e.id} has no competition")
    for m in catalog.listed("match"):
        if m.home_team_id == m.away_team_id or any(t not in catalog.entities["team"] for t in (m.home_team_id, m.away_team_id)):
            raise CatalogError(f"malformed canonical match {m.id}")


def load(path: str) -> ReviewStore:
    try:
        with open(path, encoding="utf-8") as f:
            return _restored(_parsed(f, READERS))
    except OSError as e:
        raise ReviewFileError(f"Unable to read match review file '{path}'") from e
    except (ValueError, KeyError, TypeError) as e:
        raise ReviewFileError(f"Invalid match review file '{path}': {e}") from e


def _locked(path: str, write: Callable[[], None]) -> None:
    """One writer at a time, by a directory beside the file; a temporary file left by a dead writer is an error, too."""
    lock, part = f"{path}.lock", f"{path}.tmp"
    try:
        os.mkdir(lock)
    except OSError as e:
        raise ReviewFileError(f"Match review file '{path}' is locked") from e
    try:
        if os.path.exists(part):
            raise ReviewFileError(f"Stale temporary file '{part}'")
        write()
    finally:
        os.rmdir(lock)


def _replace(path: str, store: ReviewStore) -> None:
    part = f"{path}.tmp"
    try:
        with open(part, "x", encoding="utf-8") as f:
            json.dump(to_document(store, _Rows), f, indent=2, ensure_ascii=False)
            f.write("\n")
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)


def create(path: str, store: ReviewStore | None = None) -> None:
    def write() -> None:
        if os.path.exists(path):
            raise ReviewFileError(f"Match review file '{path}' already exists")
        _replace(path, store or ReviewStore())

    _locked(path, write)


def save(path: str, store: ReviewStore, loaded_revision: int) -> None:
    """Fails if another writer has saved since the store was loaded."""

    def write() -> None:
        try:
            with open(path, encoding="utf-8") as f:
                there = _parsed(f, dict.fromkeys(READERS, lambda _: None)).get("revision", 0)
        except (OSError, ValueError) as e:
            raise ReviewFileError(f"Unable to read match review file '{path}'") from e
        if there != loaded_revision:
            raise ReviewFileError(f"Match review file '{path}' has revision {there}, not {loaded_revision}")
        _replace(path, store)

    _locked(path, write)
