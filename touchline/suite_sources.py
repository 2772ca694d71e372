"""Queries that put the driver's tables into providers' file formats and read them back through the sources that users call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schema import EVENT_COLUMNS, ORD
from .settled import positions, settle, shared_folder
from .sources import metadata, metrica, statsbomb, store, wyscout
from .suite import FE, football, query, table

EVENTS = [c.name for c in EVENT_COLUMNS]
NO_EVENT = {c.name: f"cast(null as {c.spark_type.simpleString().replace('string', 'varchar')})" for c in EVENT_COLUMNS}


def all_columns(**sql: str) -> str:
    return ", ".join(f"{sql.get(c, NO_EVENT[c])} as {c}" for c in EVENTS)


def written(records: DataFrame, file: str, order: str, text: str, head: str = "[", separator: str = ",", tail: str = "]") -> str:
    """One document a value of `file`, of the texts in order; the folder of the files game=1, game=2, ... A text is a row until it is written: no task holds a document."""
    path = shared_folder(records.sparkSession)
    rows = records.select(F.col(file).alias("game"), F.col(order).alias("o"), F.col(text).alias("t"))
    by = Window.partitionBy("game").orderBy("o", "t")
    rows = rows.withColumns({"first": F.row_number().over(by) == 1, "last": F.lead(F.lit(True)).over(by).isNull()})
    value = F.concat(F.when(F.col("first"), head).otherwise(""), "t", F.when(F.col("last"), tail).otherwise(separator.removesuffix("\n")))
    rows.sortWithinPartitions("game", "o", "t").select("game", value.alias("value")).write.partitionBy("game").text(path)
    return path


def game() -> Column:
    return F.regexp_extract("file", r"game=(\d+)", 1).cast("long")


# ---- events ----

MS = "(event_id * 250 % 2700000)"
PLACED = "with e as (select *, event_id % 40 + 1 as game, row_number() over (partition by event_id % 40 order by event_id) - 1 as spot from events) "
BOMB_END = "case when event_id % 3 = 0 then (event_id * 53 % {n})::double / 10 when event_id % 5 = 0 then (event_id * 17 % {n})::double / 10 end"


@query(
    PLACED
    + "select "
    + all_columns(
        provider_event_id="'e' || event_id", match_id="game", period="cast(event_id % 2 + 1 as int)", timestamp=MS, minute=f"cast({MS} // 60000 as int)", second=f"cast({MS} // 1000 % 60 as int)", possession_id="nullif(event_id % 7, 0)",
        team_id="case when user_id % 5 <> 0 then user_id % 20 + 1 end", team_name="case when user_id % 5 <> 0 then 'Team ' || (user_id % 20 + 1) end", player_id="nullif(user_id % 11, 0)", player_name="'Player ' || nullif(user_id % 11, 0)", event_type="event_type",
        outcome="coalesce(case when event_id % 6 = 0 then 'pass' end, case when event_id % 4 = 0 then 'shot' end, case when event_id % 7 = 0 then 'duel' end)",
        start_x="case when event_id % 9 <> 0 then (event_id * 37 % 1201)::double / 10 / 120 * 100 end", start_y="case when event_id % 9 <> 0 then (event_id * 91 % 801)::double / 10 / 80 * 100 end",
        end_x=BOMB_END.format(n=1201) + " / 120 * 100", end_y=BOMB_END.format(n=801) + " / 80 * 100", provider="'StatsBomb'",
        source_start_x="case when event_id % 9 <> 0 then (event_id * 37 % 1201)::double / 10 end", source_start_y="case when event_id % 9 <> 0 then (event_id * 91 % 801)::double / 10 end", source_end_x=BOMB_END.format(n=1201), source_end_y=BOMB_END.format(n=801),
    )
    + ", spot as place from e"
)
def s1_f10_f11_statsbomb_events(spark, sf):
    """Events of many files, each of one match; outcomes and ends in their order of preference, places within the file."""
    i = F.col("event_id")
    ms = i * 250 % 2_700_000
    tenths = lambda c, n: (c % n).cast("double") / 10
    named = lambda key, name: F.struct(key.alias("id"), name.alias("name"))
    team, player = F.col("user_id") % 20 + 1, F.col("user_id") % 11
    outcome = lambda name: F.struct(F.lit(name).alias("name"))
    record = F.struct(
        F.concat(F.lit("e"), i.cast("string")).alias("id"),
        (i % 2 + 1).alias("period"),
        F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000).alias("timestamp"),
        F.floor(ms / 60_000).alias("minute"),
        (F.floor(ms / 1000) % 60).alias("second"),
        F.nullif(i % 7, F.lit(0)).alias("possession"),
        F.when(F.col("user_id") % 5 != 0, named(team, F.concat(F.lit("Team "), team.cast("string")))).alias("team"),
        F.when(player != 0, named(player, F.concat(F.lit("Player "), player.cast("string")))).alias("player"),
        F.struct(F.col("event_type").alias("name")).alias("type"),
        F.when(i % 9 != 0, F.array(tenths(i * 37, 1201), tenths(i * 91, 801))).alias("location"),
        F.when(i % 3 == 0, F.struct(F.array(tenths(i * 53, 1201), tenths(i * 53, 801), F.lit(1.2)).alias("end_location"), F.when(i % 2 == 0, outcome("pass")).alias("outcome"))).alias("pass"),
        F.when(i % 4 == 0, F.struct(outcome("shot").alias("outcome"))).alias("shot"),
        F.when(i % 7 == 0, F.struct(outcome("duel").alias("outcome"))).alias("duel"),
        F.when(i % 5 == 0, F.struct(F.array(tenths(i * 17, 1201), tenths(i * 17, 801)).alias("end_location"))).alias("carry"),
    )
    path = written(table(spark, sf, "events").select((i % 40 + 1).alias("game"), "event_id", F.to_json(record).alias("record")), "game", "event_id", "record")
    return statsbomb.load_events(spark, path, game()).select(*EVENTS, F.col(ORD).alias("place"))


METRICA_X = "case when event_id % 9 <> 0 then (event_id * {a} % 1101)::double / 1000 end"
LEFTWARDS = "(case when event_id % 2 = 1 then 1 else 0 end + case when event_id // 2 % 2 = 1 then 1 else 0 end) % 2 = 1"


def _metrica_point(a: int, b: int) -> dict[str, str]:
    x, y = METRICA_X.format(a=a), METRICA_X.format(a=b)
    inside = f"({x}) <= 1 and ({y}) <= 1"
    return {"x": f"case when {inside} then case when {LEFTWARDS} then 100 - ({x}) / 1 * 100 else ({x}) / 1 * 100 end end", "y": f"case when {inside} then ({y}) / 1 * 100 end", "sx": x, "sy": y}


_MS, _ME = _metrica_point(37, 91), _metrica_point(53, 17)


@query(
    PLACED
    + "select "
    + all_columns(
        provider_event_id="'metrica:' || game || ':' || (event_id * 3) || ':' || spot", match_id="game", period="cast(event_id // 2 % 2 + 1 as int)", timestamp=MS, minute=f"cast({MS} // 60000 as int)", second=f"cast({MS} // 1000 % 60 as int)",
        team_name="case when event_id % 2 = 0 then 'Home' else 'Away' end", player_name="'Player' || nullif(user_id % 11, 0)", event_type="upper(substr(event_type, 1, 1)) || substr(event_type, 2) || ' Of-Play'", outcome="case when event_id % 4 = 0 then 'A, \"x\"' end", provider="'Metrica'",
        start_x=_MS["x"], start_y=_MS["y"], end_x=_ME["x"], end_y=_ME["y"], source_start_x=_MS["sx"], source_start_y=_MS["sy"], source_end_x=_ME["sx"], source_end_y=_ME["sy"],
    )
    + " from e"
)
def s2_metrica_events(spark, sf):
    """Many files with quoted fields, blank lines and points off the pitch; ids count a file's own events."""
    i = F.col("event_id")
    ms = i * 250 % 2_700_000
    coordinate = lambda a: F.when(i % 9 == 0, F.when(i % 2 == 0, "NaN").otherwise("")).otherwise(((i * a % 1101).cast("double") / 1000).cast("string"))
    line = F.concat_ws(
        ",",
        F.when(i % 2 == 0, "Home").otherwise("Away"),
        F.upper(F.concat("event_type", F.lit(" of-play"))),
        F.when(i % 4 == 0, '"A, ""x"""').otherwise(""),
        (F.floor(i / 2) % 2 + 1).cast("string"),
        (i * 3).cast("string"),
        (ms / 1000.0).cast("decimal(12,3)").cast("string"),
        F.lit("0"),
        F.lit("0"),
        F.coalesce(F.concat(F.lit("Player"), F.nullif(F.col("user_id") % 11, F.lit(0)).cast("string")), F.lit("")),
        F.lit(""),
        *map(coordinate, (37, 91, 53, 17)),
    )
    head = "Team,Type,Subtype,Period,Start Frame,Start Time [s],End Frame,End Time [s],From,To,Start X,Start Y,End X,End Y\r\n"
    lines = table(spark, sf, "events").select((i % 40 + 1).alias("game"), "event_id", F.concat(line, F.when(i % 10 == 0, "\r\n").otherwise("")).alias("line"))
    return metrica.load_events(spark, written(lines, "game", "event_id", "line", head, "\r\n", ""), game(), metrica.LEFT_TO_RIGHT).select(*EVENTS)


@query(
    "select "
    + all_columns(
        provider_event_id="cast(event_id as varchar)", match_id="7", period="cast(event_id % 5 + 1 as int)", timestamp=MS, minute=f"cast({MS} // 60000 + [0, 45, 90, 105, 120][event_id % 5 + 1] as int)", second=f"cast({MS} // 1000 % 60 as int)",
        team_id="user_id % 20 + 1", player_id="nullif(user_id % 11, 0)", event_type="event_type", outcome="case when event_id % 4 = 0 then 'Accurate' end", provider="'Wyscout'",
        start_x="(event_id * 37 % 101)::double", start_y="(event_id * 91 % 101)::double", end_x="case when event_id % 13 <> 0 then (event_id * 53 % 101)::double end", end_y="case when event_id % 13 <> 0 then (event_id * 17 % 101)::double end",
        source_start_x="(event_id * 37 % 101)::double", source_start_y="(event_id * 91 % 101)::double", source_end_x="case when event_id % 13 <> 0 then (event_id * 53 % 101)::double end", source_end_y="case when event_id % 13 <> 0 then (event_id * 17 % 101)::double end",
    )
    + " from events where event_id % 40 + 1 = 7"
)
def s3_p7_f13_wyscout_events(spark, sf):
    """One match out of files that hold a whole competition."""
    i = F.col("event_id")
    point = lambda a, b: F.struct((i * a % 101).alias("x"), (i * b % 101).alias("y"))
    record = F.struct(
        i.alias("id"),
        (i % 40 + 1).alias("matchId"),
        (F.col("user_id") % 20 + 1).alias("teamId"),
        (F.col("user_id") % 11).alias("playerId"),
        F.col("event_type").alias("eventName"),
        F.get(F.array(*map(F.lit, ("1H", "2H", "E1", "E2", "P"))), (i % 5).cast("int")).alias("matchPeriod"),
        (i * 250 % 2_700_000 / 1000.0).alias("eventSec"),
        F.when(i % 13 != 0, F.array(point(37, 91), point(53, 17))).otherwise(F.array(point(37, 91))).alias("positions"),
        F.array(F.struct(F.lit(5).alias("id")), F.struct(F.when(i % 4 == 0, 1801).otherwise(6).alias("id"))).alias("tags"),
    )
    path = written(table(spark, sf, "events").select((i % 8).alias("game"), "event_id", F.to_json(record).alias("record")), "game", "event_id", "record")
    return wyscout.load_events(spark, path, 7).select(*EVENTS)


# ---- metadata ----

DAY = "cast(epoch(o_orderdate) as bigint) // 86400 * 86400"


def _bomb_matches(spark: SparkSession, sf_dir: str) -> str:
    i, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda word, n: F.concat(F.lit(word), n.cast("string"))
    record = F.struct(
        i.alias("match_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("match_date"),
        F.when(i % 11 != 0, F.format_string("%02d:30:07.900", i % 24)).alias("kick_off"),
        F.struct((i % 4).alias("competition_id"), text("League ", i % 4).alias("competition_name")).alias("competition"),
        F.struct((i % 6).alias("season_id"), text("S", i % 6).alias("season_name")).alias("season"),
        F.struct(c.alias("home_team_id"), text("T", c).alias("home_team_name")).alias("home_team"),
        F.struct((c + 1).alias("away_team_id"), text("T", c + 1).alias("away_team_name")).alias("away_team"),
        F.when(i % 13 != 0, i % 5).alias("home_score"),
        F.when(i % 13 != 0, i % 3).alias("away_score"),
    )
    return written(table(spark, sf_dir, "orders").select((i % 16).alias("game"), i, F.to_json(record).alias("record")), "game", "o_orderkey", "record")


MATCH = "id competition_id competition_name season_id season_name kickoff home_team away_team home_score away_score".split()


@query(
    f"""select cast(o_orderkey as varchar) as id, cast(o_orderkey % 4 as varchar) as competition_id, 'League ' || o_orderkey % 4 as competition_name, cast(o_orderkey % 6 as varchar) as season_id, 'S' || o_orderkey % 6 as season_name,
    case when o_orderkey % 11 <> 0 then {DAY} + o_orderkey % 24 * 3600 + 1807 end as kickoff, cast(o_custkey as varchar) as home_team, cast(o_custkey + 1 as varchar) as away_team, cast(case when o_orderkey % 13 <> 0 then o_orderkey % 5 end as int) as home_score, cast(case when o_orderkey % 13 <> 0 then o_orderkey % 3 end as int) as away_score from orders"""
)
def s4_statsbomb_matches(spark, sf):
    return metadata.statsbomb_matches(spark, _bomb_matches(spark, sf))["matches"].select(*MATCH)


@query(
    """select 'team' as entity, cast(o_custkey as varchar) as provider_id, 'T' || o_custkey as name, null::varchar as parent from orders union all select 'team', cast(o_custkey + 1 as varchar), 'T' || (o_custkey + 1), null from orders
    union all select 'competition', cast(o_orderkey % 4 as varchar), 'League ' || o_orderkey % 4, null from orders union all select 'season', cast(o_orderkey % 6 as varchar), 'S' || o_orderkey % 6, cast(o_orderkey % 4 as varchar) from orders"""
)
def s4_statsbomb_entities(spark, sf):
    """What each match tells of its teams, competition and season, repeats included."""
    got = metadata.statsbomb_matches(spark, _bomb_matches(spark, sf))
    part = lambda k, parent: got[k + "s"].select(F.lit(k).alias("entity"), "provider_id", "name", parent.cast("string").alias("parent"))
    return part("team", F.lit(None)).unionByName(part("competition", F.lit(None))).unionByName(part("season", F.col("parent_provider_id")))


@query("select cast(c_custkey as varchar) as provider_id, c_name as name, cast(c_nationkey as varchar) as current_team, n_name as team from customer join nation on n_nationkey = c_nationkey")
def s5_statsbomb_lineups(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    lineup = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.collect_list(F.struct(F.col("c_custkey").alias("player_id"), F.col("c_name").alias("player_name"))).alias("lineup"))
    record = F.to_json(F.struct(F.col("n_nationkey").alias("team_id"), F.col("n_name").alias("team_name"), "lineup"))
    teams = n.join(lineup, "n_nationkey").select((F.col("n_nationkey") % 4).alias("game"), "n_nationkey", record.alias("record"))
    got = metadata.statsbomb_lineups(spark, written(teams, "game", "n_nationkey", "record"))
    names = got["teams"].select(F.col("provider_id").alias("current_team"), F.col("name").alias("team"))
    return got["players"].join(names, "current_team").select("provider_id", "name", "current_team", "team")


def _wyscout_names(spark: SparkSession, sf_dir: str, source: str, key: str, name: str) -> str:
    rows = table(spark, sf_dir, source).select((F.col(key) % 3).alias("game"), key, F.to_json(F.struct(F.col(key).alias("wyId"), F.col(name).alias("name"))).alias("record"))
    return written(rows, "game", key, "record")


@query("select 'Wyscout' as provider, cast(r_regionkey as varchar) as provider_id, null::varchar as provider_match_id, r_name as name from region")
def s6_wyscout_competitions(spark, sf):
    return metadata.wyscout_competitions(spark, _wyscout_names(spark, sf, "region", "r_regionkey", "r_name"))["competitions"].select("provider", "provider_id", "provider_match_id", "name")


@query("select 'Wyscout' as provider, cast(s_suppkey as varchar) as provider_id, null::varchar as provider_match_id, s_name as name from supplier")
def s7_wyscout_teams(spark, sf):
    return metadata.wyscout_teams(spark, _wyscout_names(spark, sf, "supplier", "s_suppkey", "s_name"))["teams"].select("provider", "provider_id", "provider_match_id", "name")


@query(
    """select cast(c_custkey as varchar) as provider_id, case c_custkey % 4 when 0 then c_name when 1 then 'Ann ' || c_custkey when 2 then 'Ann' else c_custkey || '' end as name,
    case when c_custkey % 5 in (0, 1) or c_custkey % 5 = 2 and c_nationkey = 0 then null when c_custkey % 5 = 2 then cast(c_nationkey as varchar) end as current_team from customer"""
)
def s8_wyscout_players(spark, sf):
    """Short names, or first and last ones; teams that are absent, null, "null" or 0."""
    k = F.col("c_custkey").cast("string")
    kind, team = F.col("c_custkey") % 4, F.col("c_custkey") % 5
    name = F.when(kind == 0, F.concat(F.lit(',"shortName":"'), "c_name", F.lit('"'))).when(kind == 1, F.concat(F.lit(',"shortName":"","firstName":"Ann","lastName":"'), k, F.lit('"'))).when(kind == 2, F.lit(',"firstName":"Ann","lastName":""')).otherwise(F.concat(F.lit(',"shortName":null,"firstName":"","lastName":"'), k, F.lit('"')))
    current = F.when(team == 0, ',"currentTeamId":"null"').when(team == 1, ',"currentTeamId":null').when(team == 2, F.concat(F.lit(',"currentTeamId":'), F.col("c_nationkey").cast("string"))).otherwise("")
    rows = table(spark, sf, "customer").select((F.col("c_custkey") % 8).alias("game"), "c_custkey", F.concat(F.lit('{"wyId":'), k, name, current, F.lit("}")).alias("record"))
    return metadata.wyscout_players(spark, written(rows, "game", "c_custkey", "record"))["players"].select("provider_id", "name", "current_team")


@query(
    f"""select cast(o_orderkey as varchar) as id, cast(o_orderkey % 4 as varchar) as competition_id, null::varchar as competition_name, cast(o_orderkey % 6 as varchar) as season_id, null::varchar as season_name, {DAY} + o_orderkey % 24 * 3600 + 1807 as kickoff,
    cast(o_custkey as varchar) as home_team, cast(o_custkey + 1 as varchar) as away_team, cast(o_orderkey % 5 as int) as home_score, cast(o_orderkey % 3 as int) as away_score from orders"""
)
def s9_wyscout_matches(spark, sf):
    i, c = F.col("o_orderkey"), F.col("o_custkey")
    of = lambda team, name, goals: (team.cast("string"), F.struct(team.alias("teamId"), F.lit(name).alias("side"), goals.alias("score")))
    record = F.struct(i.alias("wyId"), (i % 4).alias("competitionId"), (i % 6).alias("seasonId"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.format_string(" %02d:30:07", i % 24)).alias("dateutc"), F.create_map(*of(c + 1, "away", i % 3), *of(c, "home", i % 5)).alias("teamsData"))
    path = written(table(spark, sf, "orders").select((i % 16).alias("game"), i, F.to_json(record).alias("record")), "game", "o_orderkey", "record")
    return metadata.wyscout_matches(spark, path)["matches"].select(*MATCH)


# ---- stores and sinks ----


@query(FE + "select * exclude (_ord), _ord as place from fe")
def s10_s11_store_round_trip(spark, sf):
    """Every event written to a store and read again, checked."""
    path = shared_folder(spark)
    store.save_events(football(spark, sf), path, ("provider",))
    return store.load_events(spark, path).select(*EVENTS, F.col(ORD).alias("place"))


@query(FE + "select row_number() over (order by _ord) - 1 as place, provider_event_id, team_id, outcome from fe where event_type = 'purchase'")
def p3_o1_project_ordered(spark, sf):
    """The order that `project` returns rows in."""
    from .plans.language import event_query
    from .plans.query import project

    return positions(project(football(spark, sf), event_query("provider_event_id,team_id,outcome", ["event_type=purchase"])), "place")


def _lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.rstrip("\n").split("\n"))), "place long, line string")


@query(FE + """, r as (select 1 + row_number() over (order by _ord) as place, provider_event_id || chr(9) || coalesce(cast(team_id as varchar), 'NULL') || chr(9) || minute as line from fe where team_id = 7)
    select 0::bigint as place, 'Matched ' || (select count(*) from r) || ' event' || case when (select count(*) from r) = 1 then '' else 's' end as line union all select 1, 'provider_event_id' || chr(9) || 'team_id' || chr(9) || 'minute' union all select * from r""")  # fmt: skip
def s14_projection_text(spark, sf):
    from . import render
    from .plans.language import event_query
    from .plans.query import project

    return _lines(spark, render.projection(project(football(spark, sf), event_query("provider_event_id,team_id,minute", ["team_id=7"]))))


@query(FE + """, r as (select 1 + row_number() over (order by min(_ord)) as place, coalesce(outcome, 'NULL') || chr(9) || count(*) || chr(9) || max(timestamp) as line from fe group by outcome)
    select 0::bigint as place, 'Result rows: ' || (select count(*) from r) as line union all select 1, 'outcome' || chr(9) || 'count(*)' || chr(9) || 'max(timestamp)' union all select * from r""")  # fmt: skip
def s15_aggregate_text(spark, sf):
    from . import render
    from .plans.language import aggregation_query
    from .plans.query import aggregate

    return _lines(spark, render.aggregation(aggregate(football(spark, sf), aggregation_query(["count(*)", "max(timestamp)"], "outcome"))))


@query(FE + """select place, line from (select 0::bigint as place, 'Imported ' || count(*) || ' events' as line from fe union all select 1, 'Provider: Metrica' union all select 2, 'Match ID: 3' union all select 3, 'Columns: 22'
    union all select 4, 'Events with player data: ' || count(*) filter (where player_id is not null or player_name is not null) from fe union all select 5, 'Events with start locations: ' || count(start_x) from fe union all select 6, 'Events with end locations: ' || count(end_x) from fe
    union all select 7, '' union all select 8, 'Preview' union all select 9 + i, i || ': id=' || provider_event_id || ' type=' || event_type from (select row_number() over (order by _ord) - 1 as i, provider_event_id, event_type from fe) where i < 3)""")  # fmt: skip
def s16_o8_import_summary(spark, sf):
    """The summary, and of the first rows' preview the part before the team."""
    from . import render
    from .plans.query import counters

    events = football(spark, sf)
    text = render.imported(counters(events).first(), "Metrica", 3, len(EVENT_COLUMNS), events.orderBy(ORD).limit(3).collect())
    return _lines(spark, text).select("place", F.regexp_replace("line", " team=.*$", "").alias("line"))


@query(FE + "select error, n from (select 'period must be positive' as error, count(*) as n from fe where _ord % 5 = 0)")
def v2_v6_append_checked(spark, sf):
    """Appending events checks them first, and names the first bad one."""
    from .functions.validation import InvalidEvents, event_error, require_sound

    bad = settle(football(spark, sf).withColumn("period", F.when(F.col(ORD) % 5 == 0, 0).otherwise(F.col("period")).cast("int")).withColumn("_error", event_error()))
    try:
        require_sound(bad, "_error", "event {}")
        text = "none"
    except InvalidEvents as e:
        text = str(e).partition(": ")[2]
    return bad.where(F.col("_error") == text).groupBy(F.col("_error").alias("error")).agg(F.count(F.lit(1)).alias("n"))
