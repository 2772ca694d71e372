import json
import os

import pytest

from touchline import cli, render
from touchline.operators import manifest as mani
from touchline.operators.candidates import MatchOptions, compared, match_candidates, match_order, side, with_canonical_sides
from touchline.operators.catalog import Catalog, CatalogError, Entity, Match, Reference
from touchline.operators.review import EntityCandidate, Evidence, MatchCandidate, Provenance, ReviewStore
from touchline.sources import review_file
from touchline.sources.review_file import ReviewFileError

P = Provenance("ann", "sheet", "checked", 100)


def filled():
    c = Catalog()
    for i, name in ((1, "Cup"), (2, "Cup"), (3, "Liga")):
        c.add("competition", Entity(i, name))
    for i, parent, name in ((10, 1, "2018"), (11, 1, "2019"), (12, 3, "2018")):
        c.add("season", Entity(i, name, competition_id=parent))
    for i, name in ((20, "Reds"), (21, "Blues"), (22, "Greens")):
        c.add("team", Entity(i, name))
    c.add("player", Entity(30, "Ann"))
    c.add("match", Match(40, "Cup", "2018", 20, 21, 1000, 1, 0))
    c.map("team", Reference("W", "7"), 20)
    c.map("competition", Reference("W", "1"), 1)
    return c


def test_additions_are_checked():
    c = filled()
    for kind, bad in (("team", Entity(0, "X")), ("team", Entity(20, "X")), ("team", Entity(9, " ")), ("season", Entity(9, "X", competition_id=99)), ("match", Match(41, "Cup", "2018", 20, 20)), ("match", Match(41, "Cup", "2018", 20, 21, None, 1)), ("match", Match(41, "", "2018", 20, 21))):
        with pytest.raises(CatalogError):
            c.add(kind, bad)


def test_rename_takes_labels_along():
    c = filled()
    c.rename("competition", 2, "Pokal")  # a namesake: labels hold no ids
    assert c.find("match", 40).competition == "Pokal"
    c.rename("competition", 1, "Pokal")
    c.rename("season", 10, "2018/19")
    assert c.find("match", 40).season == "2018/19"


def test_deprecation_and_mappings():
    c = filled()
    with pytest.raises(CatalogError, match="active seasons"):
        c.deprecate("competition", 1)
    c.deprecate("team", 20)
    assert c.resolve("team", Reference("W", "7")) == 20
    with pytest.raises(CatalogError):
        c.map("team", Reference("W", "8"), 20)
    with pytest.raises(CatalogError):
        c.map("competition", Reference("W", "1", "5"), 1)


def test_merges():
    c = filled()
    with pytest.raises(CatalogError, match="both sides"):
        c.merge("team", 20, 21)
    c.merge("team", 20, 22)
    assert c.find("match", 40).home_team_id == 22 and c.resolve("team", Reference("W", "7")) == 22
    c.add("team", Entity(23, "Whites"))
    c.merge("team", 22, 23)
    assert c.find("team", 20).merged_into == 23
    with pytest.raises(CatalogError):
        c.merge("season", 10, 12)
    c.merge("competition", 1, 3)
    assert c.find("season", 11).competition_id == 3 and c.find("match", 40).competition == "Liga"
    with pytest.raises(CatalogError):
        c.deprecate("competition", 1)


def store():
    s = ReviewStore()
    s.add("competition", Entity(1, "Cup"), P)
    s.add("season", Entity(2, "2018", competition_id=1), P)
    s.add("team", Entity(3, "Reds"), P)
    s.add("team", Entity(4, "Blues"), P)
    s.add("match", Match(5, "Cup", "2018", 3, 4, 1000), P)
    return s


def pair(left="1", right="2"):
    return MatchCandidate(Reference("S", left), Reference("W", right), 0.9, {f: Evidence("agreeing", "a", "b") for f in render.FIELDS})


def entity(id="7", target=3):
    return EntityCandidate("team", Reference("W", id), target, "file", 1.0, {"name": Evidence("agreeing", "Reds", "Reds"), "context": Evidence("missing")})


def test_revisions_and_repeats():
    s = store()
    assert s.revision == 5 and s.changes[-1].canonical_name == "Cup 2018"
    assert s.map("team", Reference("W", "7"), 3, P).revision == 6
    assert s.map("team", Reference("W", "7"), 3, Provenance("", "", "")) is None
    for bad in (lambda: s.map("team", Reference("W", "7"), 4, P), lambda: s.rename("team", 3, "X", Provenance("a", " ", "c")), lambda: s.rename("match", 5, "X", P)):
        with pytest.raises(CatalogError):
            bad()
    assert s.revision == 6
    assert s.rename("team", 3, "Reds", P) is None and s.rename("team", 3, "Reds FC", P).action == "rename"
    assert s.deprecate("team", 4, P) and s.deprecate("team", 4, P) is None
    s.add("team", Entity(6, "Greens"), P)
    s.add("team", Entity(7, "Whites"), P)
    assert s.merge("team", 6, 7, P).related_id == 7 and s.merge("team", 6, 7, P) is None
    s.check()


def test_match_decisions():
    s = store()
    assert s.add_match_candidates([pair(), pair("3", "4"), pair()]) == [1, 2] and s.revision == 6
    assert s.add_match_candidates([pair()]) == [] and s.revision == 6
    assert s.accept_match(1, 5, P) and s.revision == 7 and len(s.changes) == 5
    assert not s.accept_match(1, 5, P)
    assert s.catalog.resolve("match", Reference("W", "2")) == 5
    with pytest.raises(CatalogError):
        s.reject_match(1, P)
    assert s.reject_match(2, P) and not s.reject_match(2, P) and s.revision == 8
    with pytest.raises(CatalogError):
        s.reject_match(2, Provenance("a", "b", "another"))
    assert [c.id for c in s.match_candidates("rejected")] == [2]
    s.check()


def test_entity_decisions():
    s = store()
    assert s.add_entity_candidates([entity(), entity("8"), entity("9", 4)]) == [1, 2, 3] and s.revision == 6
    assert s.accept_entity(1, P) and s.revision == 7 and s.changes[-1].action == "map"
    assert not s.accept_entity(1, P)
    s.map("team", Reference("W", "9"), 3, P)
    with pytest.raises(CatalogError):
        s.accept_entity(3, P)
    assert s.entity_candidates(status="unresolved")[-1].id == 3
    s.reject_entity(3, P)
    with pytest.raises(CatalogError):
        s.accept_entity(3, P)
    s.check()


def test_files(tmp_path):
    path = str(tmp_path / "r.json")
    s = store()
    s.add_match_candidates([pair()])
    s.add_entity_candidates([entity()])
    s.accept_entity(1, P)
    review_file.create(path, s)
    with pytest.raises(ReviewFileError, match="exists"):
        review_file.create(path)
    a, b = review_file.load(path), review_file.load(path)
    assert review_file.to_document(a) == review_file.to_document(s)
    a.rename("team", 3, "A", P)
    review_file.save(path, a, b.revision)
    with pytest.raises(ReviewFileError, match="revision"):
        review_file.save(path, b, b.revision)
    assert review_file.load(path).catalog.find("team", 3).name == "A"
    (tmp_path / "r.json.lock").mkdir()
    with pytest.raises(ReviewFileError, match="locked"):
        review_file.save(path, a, a.revision)
    (tmp_path / "r.json.lock").rmdir()
    (tmp_path / "r.json.tmp").write_text("x")
    with pytest.raises(ReviewFileError, match="Stale"):
        review_file.save(path, a, a.revision)
    (tmp_path / "r.json.tmp").unlink()
    assert not (tmp_path / "r.json.lock").exists()
    doc = json.loads((tmp_path / "r.json").read_text())
    for change in ({"version": 5}, {"format": "x"}, {"revision": 1}):
        (tmp_path / "bad.json").write_text(json.dumps(doc | change))
        with pytest.raises(ReviewFileError):
            review_file.load(str(tmp_path / "bad.json"))
    old = {"format": "x-match-review", "version": 1, "catalog": {k: v for k, v in doc["catalog"].items() if "competition" not in k and "season" not in k}, "candidates": doc["candidates"]}
    (tmp_path / "old.json").write_text(json.dumps(old))
    assert review_file.load(str(tmp_path / "old.json")).revision == 0


WHO = {"author": "ann", "source": "s", "reason": "r"}


def manifest(**changes):
    doc = {
        "format": "touchline-canonical-manifest",
        "version": 1,
        "competitions": [{"id": 1, "name": "Cup", "provenance": WHO, "mappings": [{"provider": "W", "provider_id": "1", "provenance": WHO}]}],
        "seasons": [{"id": 2, "competition_id": 1, "name": "2018", "provenance": WHO}],
        "teams": [{"id": i, "name": n, "provenance": WHO, "mappings": [{"provider": "W", "provider_id": n, "provenance": WHO}]} for i, n in ((3, "Reds"), (4, "Blues"))],
        "players": [{"id": 9, "name": "Ann", "provenance": WHO}],
        "matches": [{"id": 5, "season_id": 2, "home_team_id": 3, "away_team_id": 4, "provenance": WHO}],
    }
    return mani.parse(doc | changes)


def test_manifest_is_applied_once():
    report, after = mani.plan(manifest(), ReviewStore(), 1)
    assert report.importable and report.count("create") == 9 and report.planned_revision == 9 == len(after.changes)
    again, same = mani.plan(manifest(), after, 1)
    assert again.count("unchanged") == 9 and not again.has_changes and same.revision == 9
    assert [r.kind for r in report.results if r.reference is None] == ["competition", "season", "team", "team", "player", "match"]


@pytest.mark.parametrize(
    "changes, action, reason",
    [
        ({"teams": [{"id": 3, "name": "Reds", "provenance": WHO}] * 2}, "invalid", "team 3 is given twice"),
        ({"seasons": [{"id": 2, "competition_id": 8, "name": "x", "provenance": WHO}]}, "invalid", "season names competition 8, which isn't there"),
        ({"players": [{"id": 9, "name": " ", "provenance": WHO, "age": 3}]}, "invalid", "unknown key 'age'; 'name' is blank"),
        ({"players": [{"id": 0, "name": "x"}]}, "invalid", "'id' is not above zero; provenance is missing"),
        ({"players": [{"id": 1, "name": "x", "provenance": WHO, "mappings": [{"provider": "W", "provider_id": "1", "provenance": WHO}] * 2}]}, "invalid", "gives this mapping twice"),
        ({"players": [{"id": i, "name": "x", "provenance": WHO, "mappings": [{"provider": "W", "provider_id": "1", "provenance": WHO}]} for i in (1, 2)]}, "conflict", "to several player entries"),
        ({"competitions": [{"id": 1, "name": "Cup", "provenance": WHO, "mappings": [{"provider": "W", "provider_id": "1", "provider_match_id": "4", "provenance": WHO}]}]}, "invalid", "only teams and players"),
        ({"matches": [{"id": 5, "season_id": 2, "home_team_id": 3, "away_team_id": 4, "home_score": 1, "provenance": WHO}]}, "invalid", "one score without the other"),
    ],
)
def test_manifest_problems_reject_the_batch(changes, action, reason):
    report, after = mani.plan(manifest(**changes), ReviewStore(), 1)
    assert not report.importable and after.revision == report.planned_revision == 0
    assert any(r.action == action and reason in r.reason for r in report.results)


def test_manifest_files():
    for bad in ([], {"format": "x"}, {"format": "a-canonical-manifest", "version": 2}, {"format": "a-canonical-manifest", "version": 1, "extra": 1}, {"format": "a-canonical-manifest", "version": 1, "teams": {}}):
        with pytest.raises(mani.ManifestError):
            mani.parse(bad)


MATCH = "provider string, id string, competition_id string, competition_name string, season_id string, season_name string, kickoff long, home_team string, away_team string, home_score int, away_score int, _ord long"


def sides(spark, left, right):
    teams = spark.createDataFrame([("S", "1", None, 100), ("S", "2", None, 200), ("W", "8", None, 100), ("W", "9", None, 200)], "provider string, provider_id string, provider_match_id string, canonical_id long")
    none = teams.limit(0)
    make = lambda r: with_canonical_sides(spark.createDataFrame(r, MATCH), teams, none, none)
    return make(left), make(right)


LEFT = ("S", "m1", "1", "La Liga", "2", "2018", 10_000, "1", "2", 2, 1, 0)
RIGHT = ("W", "m2", "5", "Primera", "6", None, 10_120, "8", "9", 2, 1, 0)


@pytest.mark.parametrize(
    "changes, confidence, candidate",
    [
        ({}, 0.90, True),
        ({3: "la  LIGA "}, 0.95, True),
        ({6: 10_000 + 3 * 3600}, 0.80, True),
        ({6: 10_000 + 25 * 3600}, 0.70, False),
        ({6: None, 9: None}, 0.55, False),
        ({9: 0}, 0.75, False),
        ({7: "9", 8: "8"}, 0.40, False),
        ({8: "77"}, 0.65, False),
    ],
)
def test_match_scores(spark, changes, confidence, candidate):
    left, right = sides(spark, [LEFT], [tuple(changes.get(i, v) for i, v in enumerate(RIGHT))])
    row = compared(side(left, "l").crossJoin(side(right, "r"))).first()
    assert (round(row["confidence"], 9), row["is_candidate"]) == (confidence, candidate)
    assert match_candidates(left, right).count() == candidate


def test_candidates_equal_comparing_all_with_all(spark):
    import random

    dice = random.Random(5)
    def make(p, teams):
        return [(p, f"m{i}", str(dice.randrange(3)), dice.choice(["A", "a ", None]), "1", dice.choice(["x", None]), dice.choice([None, *range(0, 900, 100)]), *dice.sample(teams, 2), dice.choice([None, 1, 2]), 1, i) for i in range(30)]

    left, right = sides(spark, make("S", ["1", "2", "3"]), make("W", ["8", "9", "7"]))
    want = compared(side(left, "l").crossJoin(side(right, "r"))).where("is_candidate and not (l_provider = r_provider and l_id = r_id)").select("l_id", "r_id")
    got = match_candidates(left, right)
    assert sorted(got.select("l_id", "r_id").collect()) == sorted(want.collect()) and got.count() > 0
    ranked = [(-r["confidence"], r["l_provider"], r["l_id"], r["r_provider"], r["r_id"]) for r in got.orderBy(*match_order()).collect()]
    assert ranked == sorted(ranked)


def test_options():
    for bad in ((-1, 5, 0.5), (9, 5, 0.5), (1, 5, 1.1), (1, 5, float("nan"))):
        with pytest.raises(ValueError):
            MatchOptions(*bad)


def run(*arguments, spark=None):
    return cli.run(arguments, (lambda: spark) if spark else None)[0]


WHY = ("--actor", "ann", "--source", "s", "--reason", "r")


def test_catalog_commands(tmp_path):
    r = ("--review", str(tmp_path / "r.json"))
    assert run("catalog", "init", *r).endswith("Review revision: 0\n")
    add = lambda e, i, *more: run("catalog", "add", *r, "--entity", e, "--canonical-id", str(i), *more, *WHY)
    assert add("competition", 1, "--name", "Cup") == "Catalog revision 1: add competition 1\n"
    add("season", 2, "--name", "2018", "--competition-id", "1")
    add("team", 3, "--name", "Reds")
    add("team", 4, "--name", "Blues")
    add("match", 5, "--competition", "Cup", "--season", "2018", "--home-team-id", "3", "--away-team-id", "4")
    mapped = ("catalog", "map", *r, "--entity", "team", "--canonical-id", "3", "--provider", "W", "--provider-id", "7", "--provider-match-id", "5", *WHY)
    assert run(*mapped) == "Catalog revision 6: map team 3 <- W:7@5\n"
    assert run(*mapped) == "Catalog unchanged at revision 6\n"
    add("team", 6, "--name", "Greens")
    assert run("catalog", "merge", *r, "--entity", "team", "--canonical-id", "3", "--target-canonical-id", "6", *WHY) == "Catalog revision 8: merge team 3 -> 6\n"
    assert "team\t3\tReds\tmerged\t6\n" in run("catalog", "list", *r) and "team\tW:7@5\t6\n" in run("catalog", "list", *r)
    assert run("catalog", "history", *r).startswith("Catalog changes: 8\nrevision\taction\t")


@pytest.mark.parametrize(
    "line",
    [
        "query --database d",
        "query --database d --project minute --aggregate count(*)",
        "query --database d --project minute --group-by period",
        "query --database d --provider x --project minute",
        "query --provider statsbomb --match-id 1 --project minute",
        "query --database d --project nothing",
        "query --database d --project minute --limit 3",
        "import --provider metrica --match-id 1 --input x",
        "import --provider statsbomb --match-id 0 --input x",
        "import --provider statsbomb --match-id 1 --input x --home-first-half-direction left-to-right",
        "catalog add --review r --entity season --canonical-id 1 --name x --actor a --source b --reason c",
        "catalog map --review r --entity match --canonical-id 1 --provider p --provider-id 1 --actor a --source b --reason c",
        "catalog rename --review r --entity team --canonical-id 1 --actor a --source b --reason c",
        "reconcile accept --review r --candidate-id 1 --actor a --source b --reason c",
        "reconcile list --review r --status maybe",
        "catalog",
        "",
    ],
)
def test_bad_commands(line):
    with pytest.raises(ValueError):
        cli.parse(line.split())


def test_import_query_and_reconcile_commands(spark, tmp_path):
    events = [{"id": "a", "period": 1, "timestamp": "00:00:01.5", "minute": 0, "second": 1, "type": {"name": "Pass"}, "location": [60, 40]}, {"id": "b", "period": 1, "timestamp": "00:00:02", "minute": 0, "second": 2, "type": {"name": "Shot"}}]
    (tmp_path / "e.json").write_text(json.dumps(events))
    raw = ("--provider", "statsbomb", "--match-id", "3", "--input", str(tmp_path / "e.json"))
    text = run("import", *raw, "--output", str(tmp_path / "db"), "--limit", "1", spark=spark)
    assert text.startswith("Imported 2 events\nProvider: StatsBomb\nMatch ID: 3\nColumns: 22\nEvents with player data: 0\nEvents with start locations: 1\n")
    assert "\nPreview\n0: id=a type=Pass team=NULL player=NULL start=(50.000000, 50.000000) end=NULL" in text
    assert run("query", "--database", str(tmp_path / "db"), "--aggregate", "count(*)", "--group-by", "event_type", spark=spark) == "Result rows: 2\nevent_type\tcount(*)\nPass\t1\nShot\t1\n"
    assert run("query", *raw, "--project", "provider_event_id,timestamp", "--filter", "event_type=Shot", spark=spark) == "Matched 1 event\nprovider_event_id\ttimestamp\nb\t2000\n"

    (tmp_path / "teams.json").write_text(json.dumps([{"wyId": 8, "name": " REDS "}, {"wyId": 9, "name": "Blues"}]))
    r = ("--review", str(tmp_path / "r.json"))
    run("catalog", "init", *r)
    for i, n in ((3, "Reds"), (4, "Blues")):
        run("catalog", "add", *r, "--entity", "team", "--canonical-id", str(i), "--name", n, *WHY)
        run("catalog", "map", *r, "--entity", "team", "--canonical-id", str(i), "--provider", "StatsBomb", "--provider-id", str(i), *WHY)
    run("catalog", "add", *r, "--entity", "match", "--canonical-id", "5", "--competition", "Cup", "--season", "2018", "--home-team-id", "3", "--away-team-id", "4", *WHY)
    of = ("--entity", "team", "--provider", "wyscout", "--input", str(tmp_path / "teams.json"))
    assert "Unmapped exact matches: 2\n" in run("catalog", "validate", *r, *of, spark=spark)
    assert run("catalog", "candidates", "generate", *r, *of, spark=spark) == "Generated 2 qualified entity comparisons\nAdded 2 new entity candidates\nEntity candidate IDs: 1 2\n"
    assert run("catalog", "candidates", "generate", *r, *of, spark=spark).endswith("Added 0 new entity candidates\n")
    for i in "12":
        assert "Accepted entity candidate" in run("catalog", "candidates", "accept", *r, "--candidate-id", i, *WHY)
    assert "name\tagreeing\t REDS \tReds\n" in run("catalog", "candidates", "inspect", *r, "--candidate-id", "1")
    one = {"match_id": 1, "match_date": "2020-01-01", "kick_off": "12:00:00", "competition": {"competition_id": 1, "competition_name": "Cup"}, "season": {"season_id": 1, "season_name": "2018"}, "home_team": {"home_team_id": 3, "home_team_name": "Reds"}, "away_team": {"away_team_id": 4, "away_team_name": "Blues"}, "home_score": 1, "away_score": 0}
    two = {"wyId": 2, "competitionId": 1, "seasonId": 1, "dateutc": "2020-01-01 12:04:00", "teamsData": {"8": {"teamId": 8, "side": "home", "score": 1}, "9": {"teamId": 9, "side": "away", "score": 0}}}
    (tmp_path / "s.json").write_text(json.dumps([one]))
    (tmp_path / "w.json").write_text(json.dumps([two]))
    generate = ("reconcile", "generate", *r, "--left-provider", "statsbomb", "--left-input", str(tmp_path / "s.json"), "--right-provider", "wyscout", "--right-input", str(tmp_path / "w.json"))
    assert run(*generate, spark=spark) == "Generated 1 qualified comparison\nAdded 1 new candidate\nCandidate IDs: 1\n"
    assert run("reconcile", "list", *r) == "Candidates: 1\nid\tstatus\tconfidence\tleft_match\tright_match\n1\tunresolved\t0.85\tStatsBomb:1\tWyscout:2\n"
    assert run("reconcile", "accept", *r, "--candidate-id", "1", "--canonical-match-id", "5", *WHY) == "Accepted candidate 1 as canonical match 5\n"
    assert "Canonical match: 5\n" in run("reconcile", "inspect", *r, "--candidate-id", "1")


def test_manifest_command(tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"format": "touchline-canonical-manifest", "version": 1, "teams": [{"id": 3, "name": "Reds", "provenance": WHO}]}))
    at = ("--manifest", str(tmp_path / "m.json"), "--store", str(tmp_path / "s.json"))
    assert "Batch: ready\nCreate: 1\n" in run("catalog", "import", *at, "--dry-run") and not (tmp_path / "s.json").exists()
    assert run("catalog", "import", *at).endswith("\n\nteam 3 Reds\n  action: create\n")
    assert "Batch: applied\nCreate: 0\nUnchanged: 1\n" in run("catalog", "import", *at)
    assert review_file.load(str(tmp_path / "s.json")).revision == 1


def test_review_file_is_read_and_written_a_record_at_a_time(tmp_path, monkeypatch):
    """Memory follows the store, not the document's text and its objects; evidence and provenance that agree are held once."""
    import tracemalloc

    kept = ReviewStore()
    kept.add("team", Entity(1, "Reds"), P)
    same = {"name": Evidence("agreeing", "Reds", "Reds"), "context": Evidence("missing")}
    kept.add_entity_candidates(EntityCandidate("team", Reference("parts", str(k)), 1, "parts", 1.0, dict(same)) for k in range(5_000))
    for k in range(1, 5_001, 2):
        kept.reject_entity(k, P)
    path = str(tmp_path / "r.json")
    tracemalloc.start()
    try:
        review_file.create(path, kept)
        written = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        again = review_file.load(path)
        read = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert again.entities == kept.entities and again.changes == kept.changes
    size = os.path.getsize(path)
    assert written < size / 2 and read < 1.2 * size
    for text in ('{"format": 1', (tmp_path / "r.json").read_text() + "x", (tmp_path / "r.json").read_text()[:-3], "7", "", '{"a" 1}'):
        (tmp_path / "b.json").write_text(text)
        with pytest.raises(review_file.ReviewFileError):
            review_file.load(str(tmp_path / "b.json"))
