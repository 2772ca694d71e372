"""Text forms of results and stores."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Row

from .operators.catalog import Catalog, Reference
from .operators.manifest import CONFLICT, CREATE, INVALID, UNCHANGED, Report
from .operators.review import Change, EntityCandidate, MatchCandidate, ReviewStore

NULL = "NULL"
FIELDS = ("competition", "season", "kickoff", "home_team", "away_team", "score")


def cell(value: object) -> str:
    """Six significant digits for reals, plain digits for whole numbers and times."""
    if value is None:
        return NULL
    return f"{value:.6g}" if isinstance(value, float) else str(value)


def _table(names: Iterable[str], rows: Iterable[Iterable[object]]) -> str:
    return "".join("\t".join(line) + "\n" for line in [list(names), *([cell(v) for v in r] for r in rows)])


def _count(n: int, one: str, many: str | None = None) -> str:
    return f"{n} {one if n == 1 else many or one + 's'}"


def projection(df: DataFrame) -> str:
    rows = df.collect()
    return f"Matched {_count(len(rows), 'event')}\n" + _table(df.columns, rows)


def aggregation(df: DataFrame) -> str:
    rows = df.collect()
    return f"Result rows: {len(rows)}\n" + _table(df.columns, rows)


def _point(row: Row, name: str) -> str:
    x, y = row[f"{name}_x"], row[f"{name}_y"]
    return NULL if x is None or y is None else f"({x:.6f}, {y:.6f})"


def imported(counts: Row, provider: str, match_id: int, columns: int, preview: list[Row], saved: tuple[str, int] | None = None) -> str:
    out = [
        f"Imported {counts['rows']} events",
        f"Provider: {provider}",
        f"Match ID: {match_id}",
        f"Columns: {columns}",
        f"Events with player data: {counts['player_data']}",
        f"Events with start locations: {counts['start_locations']}",
        f"Events with end locations: {counts['end_locations']}",
    ]
    if saved:
        out += [f"Saved database: {saved[0]}", f"Database size: {saved[1]} bytes"]
    if preview:
        out += ["", "Preview"]
        out += [
            f"{i}: id={r['provider_event_id']} type={r['event_type']} team={cell(r['team_name'])} player={cell(r['player_name'])} start={_point(r, 'start')} end={_point(r, 'end')} source_start={_point(r, 'source_start')} source_end={_point(r, 'source_end')}"
            for i, r in enumerate(preview)
        ]
    return "\n".join(out) + "\n"


def generated(found: int, added: list[int], entity: bool = False) -> str:
    word = "entity " if entity else ""
    out = f"Generated {found} qualified {word}{'comparison' if found == 1 else 'comparisons'}\nAdded {len(added)} new {word}{'candidate' if len(added) == 1 else 'candidates'}\n"
    if added:
        out += f"{'Entity candidate' if entity else 'Candidate'} IDs: {' '.join(map(str, added))}\n"
    return out


def _match_line(c: MatchCandidate) -> str:
    return "\t".join((str(c.id), c.status, cell(c.confidence), f"{c.left.provider}:{c.left.id}", f"{c.right.provider}:{c.right.id}")) + "\n"


def match_list(found: list[MatchCandidate]) -> str:
    return f"Candidates: {len(found)}\nid\tstatus\tconfidence\tleft_match\tright_match\n" + "".join(map(_match_line, found))


def _decision(c: MatchCandidate | EntityCandidate) -> str:
    out = f"Rejection reason: {c.rejection_reason}\n" if c.rejection_reason else ""
    if d := c.decision:
        out += f"Decision actor: {d.actor}\nDecision source: {d.source}\nDecision reason: {d.reason}\nDecision recorded at: {d.recorded_at}\n"
    return out


def match_detail(c: MatchCandidate) -> str:
    accepted = f"Canonical match: {c.accepted_match_id}\n" if c.accepted_match_id else ""
    rows = ((f, e.status, e.left, e.right, e.canonical) for f in FIELDS for e in [c.evidence[f]])
    return _match_line(c) + accepted + _decision(c) + _table(("field", "status", "left_value", "right_value", "canonical_value"), rows)


def _entity_line(c: EntityCandidate) -> str:
    return "\t".join((str(c.id), c.status, c.kind, cell(c.confidence), str(c.reference), str(c.canonical_id))) + "\n"


ENTITY_HEAD = "id\tstatus\tentity\tconfidence\tprovider\tcanonical_id\n"


def entity_list(found: list[EntityCandidate]) -> str:
    return f"Entity candidates: {len(found)}\n" + ENTITY_HEAD + "".join(map(_entity_line, found))


def entity_detail(c: EntityCandidate) -> str:
    rows = ((f, c.evidence[f].status, c.evidence[f].left, c.evidence[f].right) for f in ("name", "context"))
    return ENTITY_HEAD + _entity_line(c) + f"Source: {c.source}\n" + _decision(c) + _table(("field", "status", "provider_value", "canonical_value"), rows)


def entity_accepted(c: EntityCandidate) -> str:
    return f"Accepted entity candidate {c.id}: {c.kind} {c.reference} -> {c.canonical_id}\n"


def created(path: str) -> str:
    return f"Created match review store: {path}\nReview revision: 0\n"


def catalog(store: ReviewStore) -> str:
    c: Catalog = store.catalog
    out = [f"Review revision: {store.revision}"]
    for kind, title in (("competition", "Competitions"), ("season", "Seasons"), ("team", "Teams"), ("player", "Players"), ("match", "Matches")):
        out.append(f"{title}: {len(c.entities[kind])}")
        for e in c.listed(kind):
            if kind == "match":
                out.append(f"match\t{e.id}\t{e.competition}\t{e.season}\t{e.home_team_id}\t{e.away_team_id}")
            else:
                parent = f"{e.competition_id}\t" if kind == "season" else ""
                out.append(f"{kind}\t{e.id}\t{parent}{e.name}\t{e.status}\t{cell(e.merged_into)}")
    out.append("Provider mappings:")
    out += [f"{kind}\t{r}\t{i}" for kind in c.mappings for r, i in c.mapped(kind)]
    return "\n".join(out) + "\n"


def history(changes: list[Change]) -> str:
    names = "revision action entity canonical_id canonical_name provider_reference related_canonical_id actor source reason recorded_at".split()
    rows = ((c.revision, c.action, c.kind, c.canonical_id, c.canonical_name, c.reference and str(c.reference), c.related_id, c.provenance.actor, c.provenance.source, c.provenance.reason, c.provenance.recorded_at) for c in changes)
    return f"Catalog changes: {len(changes)}\n" + _table(names, rows)


def mutation(revision: int, change: Change | None) -> str:
    if change is None:
        return f"Catalog unchanged at revision {revision}\n"
    source = f" <- {change.reference}" if change.reference else ""
    target = f" -> {change.related_id}" if change.related_id is not None else ""
    return f"Catalog revision {revision}: {change.action} {change.kind} {change.canonical_id}{source}{target}\n"


def coverage(entity: str, revision: int, summary: Row, records: list[Row]) -> str:
    s = summary
    out = [
        f"Catalog validation: {entity}",
        f"Review revision: {revision}",
        f"Provider records: {s['provider_records']}",
        f"Mapped active: {s['mapped_active']}",
        f"Mapped inactive: {s['mapped_inactive']}",
        f"Unmapped records: {s['provider_records'] - s['mapped_active'] - s['mapped_inactive']}",
        f"Unmapped exact matches: {s['unmapped_exact_matches']}",
        f"Ambiguous exact matches: {s['ambiguous_exact_matches']}",
        f"Inactive exact matches: {s['inactive_exact_matches']}",
        f"No exact matches: {s['no_exact_matches']}",
        f"Missing names: {s['missing_names']}",
        f"Mapped name mismatches: {s['mapped_name_mismatches']}",
        f"Parent context missing: {s['parent_context_missing']}",
        f"Parent context conflicts: {s['parent_context_conflicts']}",
        f"Parent context inactive: {s['parent_context_inactive']}",
    ]
    names = "provider_reference provider_name outcome canonical_ids name_status context_status".split()
    rows = ((str(Reference(r["provider"], r["provider_id"], r["provider_match_id"])), r["name"], r["outcome"], ",".join(map(str, r["canonical_ids"])) or None, r["name_status"], r["context_status"]) for r in records)
    return "\n".join(out) + "\n" + _table(names, rows)


def manifest(report: Report, dry_run: bool, applied: bool) -> str:
    out = [
        "Catalog manifest import",
        f"Mode: {'dry-run' if dry_run else 'apply'}",
        f"Manifest version: {report.version}",
        f"Store revision: {report.base_revision}",
        f"Planned revision: {report.planned_revision}",
        f"Batch: {'rejected' if not report.importable else 'applied' if applied else 'ready'}",
        f"Create: {report.count(CREATE)}",
        f"Unchanged: {report.count(UNCHANGED)}",
        f"Conflicts: {report.count(CONFLICT)}",
        f"Invalid: {report.count(INVALID)}",
    ]
    for r in report.results:
        out += ["", f"{r.kind} {r.canonical_id}" + (f" {r.name}" if r.name else "")]
        if r.reference and r.reference.provider is not None:
            out.append(f"  provider mapping: {r.reference}")
        out.append(f"  action: {r.action}")
        if r.reason:
            out.append(f"  reason: {r.reason}")
    return "\n".join(out) + "\n"


