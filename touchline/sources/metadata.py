"""Provider metadata: competitions, seasons, teams, players and matches as frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import epoch_seconds
from ..functions.validation import require_sound
from ..schema import ORD
from .variants import Record, integer, records

STATSBOMB, WYSCOUT = "StatsBomb", "Wyscout"


def _checked(rows: DataFrame, r: Record, provider: str, path: str) -> DataFrame:
    """Rows with what the record reads of them, after one job that checks them all."""
    rows = r.bound(rows)
    require_sound(rows.withColumn("_error", r.error()), "_error", provider + f" metadata file '{path}' record at index {{}}")
    return rows


def _entity(rows: DataFrame, provider: str, key: Column, name: Column, **more: Column) -> DataFrame:
    null = F.lit(None).cast("string")
    return rows.select(F.lit(provider).alias("provider"), key.cast("string").alias("provider_id"), null.alias("provider_match_id"), name.alias("name"), *[c.alias(n) for n, c in more.items()], ORD)


def _named(r: Record, path: str, what: str) -> Column:
    name = r.required(path, "string")
    r.complain(name == "", f"{what} is empty")
    return name


def statsbomb_matches(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """matches, and for each match one competition, one season and two teams; what repeats is left for reconciliation to merge."""
    rows = records(spark, path, f"{STATSBOMB} metadata")
    r = Record(F.col("v"))
    for o in ("competition", "season", "home_team", "away_team"):
        r.object(f"$.{o}", required=True)
    team = {s: (r.required(f"$.{s}_team.{s}_team_id", "bigint"), _named(r, f"$.{s}_team.{s}_team_name", "team name")) for s in ("home", "away")}
    match = r.required("$.match_id", "bigint")
    competition, competition_name = r.required("$.competition.competition_id", "bigint"), r.required("$.competition.competition_name", "string")
    season, season_name = r.required("$.season.season_id", "bigint"), r.required("$.season.season_name", "string")
    date, clock = r.required("$.match_date", "string"), r.optional("$.kick_off", "string")
    kickoff = epoch_seconds(date, clock)
    r.complain(clock.isNotNull() & kickoff.isNull(), "date or time is malformed")
    scores = {s: r.optional(f"$.{s}_score", "int") for s in ("home", "away")}
    for s in scores.values():
        r.complain(s < 0, "a score is negative")
    rows = _checked(rows, r, STATSBOMB, path)
    text = lambda c: c.cast("string")
    matches = rows.select(
        F.lit(STATSBOMB).alias("provider"), text(match).alias("id"), text(competition).alias("competition_id"), competition_name.alias("competition_name"), text(season).alias("season_id"), season_name.alias("season_name"),
        kickoff.alias("kickoff"), text(team["home"][0]).alias("home_team"), text(team["away"][0]).alias("away_team"), scores["home"].alias("home_score"), scores["away"].alias("away_score"), ORD,
    )
    teams = [_entity(rows, STATSBOMB, *team[s]).withColumn(ORD, F.col(ORD) * 2 + i) for i, s in enumerate(("home", "away"))]
    return {
        "matches": matches,
        "competitions": _entity(rows, STATSBOMB, competition, competition_name),
        "seasons": _entity(rows, STATSBOMB, season, season_name, parent_provider_id=text(competition)),
        "teams": teams[0].unionByName(teams[1]),
    }


def statsbomb_lineups(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """teams, and players with the team whose lineup names them."""
    rows = records(spark, path, f"{STATSBOMB} metadata")
    r = Record(F.col("v"))
    team, name = r.required("$.team_id", "bigint"), _named(r, "$.team_name", "team name")
    r.complain(~r.is_array("$.lineup"), "field 'lineup' is no array")
    rows = _checked(rows, r, STATSBOMB, path)
    each = rows.select(ORD, team.cast("string").alias("_team"), F.posexplode(F.try_variant_get("v", "$.lineup", "array<variant>")).alias("_at", "v"))
    p = Record(F.col("v"), "p")
    player, player_name = p.required("$.player_id", "bigint"), _named(p, "$.player_name", "player_name")
    each = _checked(each, p, STATSBOMB, path)
    players = _entity(each.withColumn(ORD, F.col(ORD) * 1000 + F.col("_at")), STATSBOMB, player, player_name, current_team=F.col("_team"))
    return {"teams": _entity(rows, STATSBOMB, team, name), "players": players}


def _wyscout_named(spark: SparkSession, path: str, what: str) -> DataFrame:
    rows = records(spark, path, f"{WYSCOUT} metadata")
    r = Record(F.col("v"))
    key, name = r.required("$.wyId", "bigint"), _named(r, "$.name", f"{what} name")
    rows = _checked(rows, r, WYSCOUT, path)
    return _entity(rows, WYSCOUT, key, name)


def wyscout_competitions(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {"competitions": _wyscout_named(spark, path, "competition")}


def wyscout_teams(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {"teams": _wyscout_named(spark, path, "team")}


def wyscout_players(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Names are the short name, or else first and last name; a current team of null, "null" or 0 is none."""
    rows = records(spark, path, f"{WYSCOUT} metadata")
    r = Record(F.col("v"))
    key = r.required("$.wyId", "bigint")
    short = F.nullif(r.value("$.shortName", "string"), F.lit(""))
    parts = [r.value(f"$.{p}", "string") for p in ("firstName", "lastName")]
    for p, c in zip(("firstName", "lastName"), parts):
        r.complain(short.isNull() & r.absent(f"$.{p}"), f"field '{p}' is missing")
        r.complain(short.isNull() & c.isNull(), f"field '{p}' has the wrong type")
    full = F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in parts])
    name = F.coalesce(short, full)
    r.complain(name == "", "a player's name is empty")
    word, team = (r.value("$.currentTeamId", t) for t in ("string", "bigint"))
    r.complain(~r.absent("$.currentTeamId") & team.isNull() & ~F.coalesce(word == "null", F.lit(False)), "field 'currentTeamId' has the wrong type")
    rows = _checked(rows, r, WYSCOUT, path)
    return {"players": _entity(rows, WYSCOUT, key, name, current_team=F.nullif(team, F.lit(0).cast("long")).cast("string"))}


def wyscout_matches(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """matches, and seasons without names; teamsData becomes a home and an away side."""
    rows = records(spark, path, f"{WYSCOUT} metadata")
    v = F.col("v")
    r = Record(v)
    match, competition, season = (r.required(f"$.{k}", "bigint").cast("string") for k in ("wyId", "competitionId", "seasonId"))
    date = r.required("$.dateutc", "string")
    r.complain((F.length(date) != 19) | (F.substring(date, 11, 1) != " "), "dateutc is not of the form YYYY-MM-DD hh:mm:ss")
    kickoff = epoch_seconds(F.substring(date, 1, 10), F.substring(date, 12, 8))
    r.complain(date.isNotNull() & kickoff.isNull(), "date or time is malformed")
    r.complain(~r.is_object("$.teamsData"), "field 'teamsData' is no object")
    entries = F.map_entries(F.try_variant_get(v, "$.teamsData", "map<string,variant>"))
    r.complain(F.exists(entries, lambda e: ~F.schema_of_variant(e["value"]).like("OBJECT<%")), "a side of teamsData is no object")
    r.complain(F.exists(entries, lambda e: integer(e["value"], "$.teamId").isNull()), "a side has no teamId")
    r.complain(F.exists(entries, lambda e: e["key"] != integer(e["value"], "$.teamId").cast("string")), "a side's key differs from its teamId")
    r.complain(F.exists(entries, lambda e: integer(e["value"], "$.score") < 0), "a score is negative")
    on = lambda s: F.filter(entries, lambda e: F.try_variant_get(e["value"], "$.side", "string") == s)
    r.complain((F.size(on("home")) != 1) | (F.size(on("away")) != 1) | (F.size(entries) != 2), "teamsData has other sides than one home and one away")
    rows = _checked(rows, r, WYSCOUT, path)
    one = {s: F.get(on(s), 0) for s in ("home", "away")}
    none = F.lit(None).cast("string")
    matches = rows.select(
        F.lit(WYSCOUT).alias("provider"), match.alias("id"), competition.alias("competition_id"), none.alias("competition_name"), season.alias("season_id"), none.alias("season_name"), kickoff.alias("kickoff"),
        *[one[s]["key"].alias(f"{s}_team") for s in one], *[integer(one[s]["value"], "$.score").cast("int").alias(f"{s}_score") for s in one], ORD,
    )
    return {"matches": matches, "seasons": _entity(rows, WYSCOUT, season, none, parent_provider_id=competition)}


#: Loader of each provider's matches, and of each provider's records by entity.
MATCH_LOADERS = {"statsbomb": statsbomb_matches, "wyscout": wyscout_matches}
ENTITY_LOADERS = {
    ("statsbomb", "competition"): (statsbomb_matches, "competitions"),
    ("statsbomb", "season"): (statsbomb_matches, "seasons"),
    ("statsbomb", "team"): (statsbomb_matches, "teams"),
    ("statsbomb", "player"): (statsbomb_lineups, "players"),
    ("wyscout", "competition"): (wyscout_competitions, "competitions"),
    ("wyscout", "season"): (wyscout_matches, "seasons"),
    ("wyscout", "team"): (wyscout_teams, "teams"),
    ("wyscout", "player"): (wyscout_players, "players"),
}


def entity_records(spark: SparkSession, provider: str, entity: str, path: str) -> DataFrame:
    try:
        load, part = ENTITY_LOADERS[provider, entity]
    except KeyError:
        raise ValueError(f"No {entity} metadata for provider '{provider}'") from None
    return load(spark, path)[part]
