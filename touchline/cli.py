"""The command line: import, query, reconcile and catalog commands."""

from __future__ import annotations

import argparse
import os
import sys
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import render
from .operators import candidates as cand
from .operators import coverage as cov
from .operators import manifest as mani
from .operators.catalog import Catalog, Entity, Match, Reference
from .operators.identity import deduplicated, require_agreement
from .operators.review import Provenance, ReviewStore, from_pair, from_row
from .plans.language import aggregation_query, event_query, whole_number
from .plans.query import counters, execute
from .schema import EVENT_COLUMNS, ORD
from .sources import metadata, metrica, review_file, statsbomb, store, wyscout

ENTITIES = ("competition", "season", "team", "player", "match")
STATUSES = ("unresolved", "accepted", "rejected")


class UsageError(ValueError):
    pass


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise UsageError(message)


class _Once(argparse.Action):
    """An option that may be given once."""

    def __call__(self, parser, namespace, values, option=None):
        if getattr(namespace, self.dest) is not None:
            parser.error(f"{option} may only be specified once")
        setattr(namespace, self.dest, values)


def _positive(text: str) -> int:
    value = whole_number(text)
    if value <= 0:
        raise argparse.ArgumentTypeError(f"'{text}' must be positive")
    return value


def _nonnegative(text: str) -> int:
    value = whole_number(text)
    if value < 0:
        raise argparse.ArgumentTypeError(f"'{text}' must not be negative")
    return value


def _source_options(p: argparse.ArgumentParser, required: bool) -> None:
    p.add_argument("--provider", required=required)
    p.add_argument("--match-id", type=_positive, required=required)
    p.add_argument("--input", required=required)
    p.add_argument("--home-first-half-direction", action=_Once, choices=(metrica.LEFT_TO_RIGHT, metrica.RIGHT_TO_LEFT))


def _provenance_options(p: argparse.ArgumentParser) -> None:
    for name in ("--actor", "--source", "--reason"):
        p.add_argument(name, required=True)


def parser() -> argparse.ArgumentParser:
    top = _Parser(prog="touchline", allow_abbrev=False)
    commands = top.add_subparsers(dest="command", required=True, parser_class=_Parser)
    new = lambda sub, name: sub.add_parser(name, allow_abbrev=False)
    p = new(commands, "import")
    _source_options(p, True)
    p.add_argument("--output")
    p.add_argument("--limit", type=_nonnegative, default=0)
    p = new(commands, "query")
    _source_options(p, False)
    p.add_argument("--database")
    p.add_argument("--project", action=_Once)
    p.add_argument("--group-by", action=_Once)
    p.add_argument("--aggregate", action="append", default=[])
    p.add_argument("--filter", action="append", default=[])
    actions = new(commands, "reconcile").add_subparsers(dest="action", required=True, parser_class=_Parser)
    for name in ("generate", "list", "inspect", "accept", "reject"):
        p = new(actions, name)
        p.add_argument("--review", required=True)
        if name == "generate":
            for side in ("left", "right"):
                p.add_argument(f"--{side}-provider", required=True)
                p.add_argument(f"--{side}-input", required=True)
        elif name == "list":
            p.add_argument("--status", choices=STATUSES)
        else:
            p.add_argument("--candidate-id", type=_positive, required=True)
        if name == "accept":
            p.add_argument("--canonical-match-id", type=_positive, required=True)
        if name in ("accept", "reject"):
            _provenance_options(p)
    actions = new(commands, "catalog").add_subparsers(dest="action", required=True, parser_class=_Parser)
    for name in ("init", "list", "history"):
        new(actions, name).add_argument("--review", required=True)
    p = new(actions, "import")
    p.add_argument("--manifest", required=True)
    p.add_argument("--store", required=True)
    p.add_argument("--dry-run", action="store_true")
    for name in ("add", "map", "rename", "deprecate", "merge"):
        p = new(actions, name)
        p.add_argument("--review", required=True)
        p.add_argument("--entity", choices=ENTITIES, required=True, action=_Once)
        p.add_argument("--canonical-id", type=_positive, required=True)
        if name in ("add", "rename"):
            p.add_argument("--name", required=name == "rename")
        if name == "add":
            p.add_argument("--competition-id", type=_positive)
            p.add_argument("--competition")
            p.add_argument("--season")
            p.add_argument("--home-team-id", type=_positive)
            p.add_argument("--away-team-id", type=_positive)
            p.add_argument("--kickoff-seconds", type=whole_number)
            p.add_argument("--home-score", type=_nonnegative)
            p.add_argument("--away-score", type=_nonnegative)
        if name == "map":
            p.add_argument("--provider", required=True)
            p.add_argument("--provider-id", required=True)
            p.add_argument("--provider-match-id")
        if name == "merge":
            p.add_argument("--target-canonical-id", type=_positive, required=True)
        _provenance_options(p)
    for name, sub in (("validate", actions), *((n, None) for n in ("generate", "list", "inspect", "accept", "reject"))):
        if sub is None:
            if "inner" not in locals():
                inner = new(actions, "candidates").add_subparsers(dest="step", required=True, parser_class=_Parser)
            sub = inner
        p = new(sub, name)
        p.add_argument("--review", required=True)
        if name in ("validate", "generate"):
            p.add_argument("--entity", choices=ENTITIES[:4], required=True, action=_Once)
            p.add_argument("--provider", required=True)
            p.add_argument("--input", required=True)
        elif name == "list":
            p.add_argument("--entity", choices=ENTITIES[:4], action=_Once)
            p.add_argument("--status", choices=STATUSES)
        else:
            p.add_argument("--candidate-id", type=_positive, required=True)
        if name in ("accept", "reject"):
            _provenance_options(p)
    return top


def parse(arguments: Sequence[str]) -> argparse.Namespace:
    """Options that fit together; queries are bound to columns here, before anything is read."""
    o = parser().parse_args(arguments)
    if o.command in ("import", "query"):
        raw = (o.provider, o.match_id, o.input)
        if o.command == "query":
            if o.database:
                if any(x is not None for x in raw):
                    raise UsageError("--database cannot be combined with --provider, --match-id, or --input")
            elif None in raw:
                raise UsageError("query requires --database or --provider, --match-id, and --input")
            if bool(o.project) == bool(o.aggregate):
                raise UsageError("query requires exactly one of --project or --aggregate")
            if o.group_by is not None and not o.aggregate:
                raise UsageError("--group-by requires --aggregate")
            o.bound = event_query(o.project, o.filter) if o.project else aggregation_query(o.aggregate, o.group_by, o.filter)
        if o.home_first_half_direction and o.provider != "metrica":
            raise UsageError("--home-first-half-direction is only valid with --provider metrica")
        if o.provider == "metrica" and not o.home_first_half_direction:
            raise UsageError("--provider metrica requires --home-first-half-direction")
    elif o.command == "catalog" and o.action == "add":
        match = (o.competition, o.season, o.home_team_id, o.away_team_id)
        if o.entity == "match":
            if None in match or o.name or o.competition_id:
                raise UsageError("catalog add match requires --competition, --season, and positive --home-team-id and --away-team-id")
            if (o.home_score is None) != (o.away_score is None):
                raise UsageError("--home-score and --away-score must be specified together")
        else:
            if not o.name:
                raise UsageError("--name is required for this catalog entity")
            if any(x is not None for x in (*match, o.kickoff_seconds, o.home_score, o.away_score)):
                raise UsageError("match fields are only valid when adding a canonical match")
            if (o.entity == "season") != (o.competition_id is not None):
                raise UsageError("--competition-id belongs to a canonical season, and only to one")
    elif o.command == "catalog" and o.action == "map":
        if o.entity == "match":
            raise UsageError("provider match mappings are created by reconciliation decisions")
        if o.provider_match_id is not None and o.entity not in ("team", "player"):
            raise UsageError("--provider-match-id is only valid for team or player mappings")
    return o


def raw_events(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    if o.provider == "statsbomb":
        return statsbomb.load_events(spark, o.input, o.match_id)
    if o.provider == "metrica":
        return metrica.load_events(spark, o.input, o.match_id, o.home_first_half_direction)
    if o.provider == "wyscout":
        return wyscout.load_events(spark, o.input, o.match_id)
    raise UsageError(f"Unsupported provider '{o.provider}'")


def _size(path: str) -> int:
    return os.path.getsize(path) if os.path.isfile(path) else sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)


def _import(spark: SparkSession, o: argparse.Namespace) -> str:
    events = raw_events(spark, o)
    if o.output:
        store.save_events(events, o.output)
        events = store.load_events(spark, o.output, check=False)
    first = events.orderBy(ORD).limit(max(o.limit, 1)).collect()
    provider = first[0]["provider"] if first else o.provider
    return render.imported(counters(events).first(), provider, o.match_id, len(EVENT_COLUMNS), first[: o.limit], (o.output, _size(o.output)) if o.output else None)


def _query(spark: SparkSession, o: argparse.Namespace) -> str:
    events = store.load_events(spark, o.database) if o.database else raw_events(spark, o)
    made = execute(events, o.bound)
    return render.projection(made) if o.project else render.aggregation(made)


def _matches(spark: SparkSession, provider: str, path: str, catalog: Catalog) -> DataFrame:
    if provider not in metadata.MATCH_LOADERS:
        raise UsageError(f"No match metadata for provider '{provider}'")
    found = metadata.MATCH_LOADERS[provider](spark, path)["matches"]
    return cand.with_canonical_sides(found, *(catalog.mapping_frame(spark, k) for k in ("team", "competition", "season")))


def _unique_records(spark: SparkSession, o: argparse.Namespace, whole: bool) -> DataFrame:
    """One record a reference. Candidates need equal names only, coverage equal records."""
    records = metadata.entity_records(spark, o.provider, o.entity, o.input)
    keys = ["provider", "provider_id", "provider_match_id"]
    rest = [c for c in records.columns if c not in (*keys, "name", ORD)] if whole else []
    return require_agreement(deduplicated(records, keys, ["name", *rest]), keys)


def _entity_generate(spark: SparkSession, o: argparse.Namespace, kept: ReviewStore) -> DataFrame:
    c = kept.catalog
    records = _unique_records(spark, o, whole=False)
    if o.entity != "season" and (bad := records.where(F.col("name").isNull() | (F.trim("name") == "")).first()):
        raise ValueError(f"Blank provider name for '{bad['provider']}:{bad['provider_id']}'")
    found = cand.entity_candidates(records, c.entity_frame(spark, o.entity), c.mapping_frame(spark, o.entity), c.mapping_frame(spark, "competition") if o.entity == "season" else None)
    return found


def _decide(o: argparse.Namespace) -> Provenance:
    return Provenance(o.actor, o.source, o.reason, int(time.time()))


def _reconcile(spark, o: argparse.Namespace) -> str:
    kept = review_file.load(o.review)
    loaded = kept.revision
    if o.action == "generate":
        session = spark()
        found = cand.match_candidates(*(_matches(session, getattr(o, f"{s}_provider"), getattr(o, f"{s}_input"), kept.catalog) for s in ("left", "right")))
        new = cand.upserted(found, kept.known_matches(session), cand.MATCH_KEYS, cand.match_order()).orderBy("id")
        ids = kept.add_match_candidates(from_pair(r) for r in new.toLocalIterator())
        if ids:
            review_file.save(o.review, kept, loaded)
        return render.generated(found.count(), ids)
    if o.action == "list":
        return render.match_list(kept.match_candidates(o.status))
    if o.action == "inspect":
        return render.match_detail(kept._get(kept.matches, o.candidate_id))
    if o.action == "accept":
        kept.accept_match(o.candidate_id, o.canonical_match_id, _decide(o))
        text = f"Accepted candidate {o.candidate_id} as canonical match {o.canonical_match_id}\n"
    else:
        kept.reject_match(o.candidate_id, _decide(o))
        text = f"Rejected candidate {o.candidate_id}: {o.reason}\n"
    review_file.save(o.review, kept, loaded)
    return text


def _catalog_import(o: argparse.Namespace) -> tuple[str, int]:
    entries = mani.load(o.manifest)
    there = os.path.exists(o.store)
    current = review_file.load(o.store) if there else ReviewStore()
    report, planned = mani.plan(entries, current)
    applied = report.importable and not o.dry_run
    if applied:
        if not there:
            review_file.create(o.store, planned)
        elif report.has_changes:
            review_file.save(o.store, planned, current.revision)
    return render.manifest(report, o.dry_run, applied), 0 if report.importable else 1


def _change(o: argparse.Namespace, kept: ReviewStore):
    p = _decide(o)
    if o.action == "add":
        new = Match(o.canonical_id, o.competition, o.season, o.home_team_id, o.away_team_id, o.kickoff_seconds, o.home_score, o.away_score) if o.entity == "match" else Entity(o.canonical_id, o.name, competition_id=o.competition_id)
        return kept.add(o.entity, new, p)
    if o.action == "map":
        return kept.map(o.entity, Reference(o.provider, o.provider_id, o.provider_match_id), o.canonical_id, p)
    if o.action == "rename":
        return kept.rename(o.entity, o.canonical_id, o.name, p)
    if o.action == "deprecate":
        return kept.deprecate(o.entity, o.canonical_id, p)
    return kept.merge(o.entity, o.canonical_id, o.target_canonical_id, p)


def _candidates(spark, o: argparse.Namespace, kept: ReviewStore) -> str:
    loaded = kept.revision
    if o.step == "generate":
        s = spark()
        found = _entity_generate(s, o, kept)
        # only what the store doesn't know yet comes to the driver
        new = cand.upserted(found, kept.known_entities(s, o.entity), cand.ENTITY_KEYS, cand.entity_order()).orderBy("id")
        ids = kept.add_entity_candidates(from_row(r, o.entity, o.input) for r in new.toLocalIterator())
        if ids:
            review_file.save(o.review, kept, loaded)
        return render.generated(found.count(), ids, entity=True)
    if o.step == "list":
        return render.entity_list(kept.entity_candidates(o.entity, o.status))
    c = kept._get(kept.entities, o.candidate_id)
    if o.step == "inspect":
        return render.entity_detail(c)
    if o.step == "accept":
        kept.accept_entity(o.candidate_id, _decide(o))
        text = render.entity_accepted(c)
    else:
        kept.reject_entity(o.candidate_id, _decide(o))
        text = f"Rejected entity candidate {o.candidate_id}: {o.reason}\n"
    review_file.save(o.review, kept, loaded)
    return text


def _catalog(spark, o: argparse.Namespace) -> tuple[str, int]:
    if o.action == "import":
        return _catalog_import(o)
    if o.action == "init":
        review_file.create(o.review)
        return render.created(o.review), 0
    kept = review_file.load(o.review)
    if o.action == "list":
        return render.catalog(kept), 0
    if o.action == "history":
        return render.history(kept.changes), 0
    if o.action == "validate":
        c, s = kept.catalog, spark()
        records = _unique_records(s, o, whole=True)
        season = o.entity == "season"
        extra = (c.entity_frame(s, "competition"), c.mapping_frame(s, "competition")) if season else ()
        found = cov.coverage(records, c.entity_frame(s, o.entity), c.mapping_frame(s, o.entity), *extra)
        return render.coverage(o.entity, kept.revision, cov.summary(found).first(), cov.ordered(found).collect()), 0
    if o.action == "candidates":
        return _candidates(spark, o, kept), 0
    loaded, rows = kept.revision, len(kept.changes)
    change = _change(o, kept)
    if len(kept.changes) > rows:
        review_file.save(o.review, kept, loaded)
    return render.mutation(kept.revision, change), 0


def run(arguments: Sequence[str], spark=None) -> tuple[str, int]:
    """Output and exit status of a command. spark: a function that gives the session, called by commands that read data."""
    from .session import session

    o = parse(arguments)
    start = spark or session
    if o.command == "import":
        return _import(start(), o), 0
    if o.command == "query":
        return _query(start(), o), 0
    if o.command == "reconcile":
        return _reconcile(start, o), 0
    return _catalog(start, o)


def main() -> int:
    try:
        text, status = run(sys.argv[1:])
    except (ValueError, OSError) as e:
        print(f"touchline: {e}", file=sys.stderr)
        return 1
    print(text, end="")
    return status


if __name__ == "__main__":
    sys.exit(main())
