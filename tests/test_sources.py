import json

import pytest
from pyspark.sql import functions as F

from touchline.functions.validation import InvalidEvents
from touchline.sources import metadata, metrica, statsbomb, store, wyscout
from touchline.sources.variants import InvalidSource


def write(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def bomb(**more):
    return {"id": "a1", "period": 1, "timestamp": "00:12:34.567", "minute": 12, "second": 34, "type": {"id": 30, "name": "Pass"}} | more


FULL = bomb(possession=4, team={"id": 217, "name": "Home FC"}, player={"id": 9, "name": "Ann"}, location=[42.5, 31.25], **{"pass": {"end_location": [60.0, 40.0, 1.2], "outcome": {"name": "Incomplete"}}})


def test_statsbomb(spark, tmp_path):
    carry = bomb(id="a2", type={"name": "Carry"}, carry={"end_location": [120, 80]})
    got = statsbomb.load_events(spark, write(tmp_path / "e.json", [FULL, carry]), 22912).orderBy("_ord").collect()
    assert [r["_ord"] for r in got] == [0, 1]
    a, b = got
    assert (a["timestamp"], a["match_id"], a["team_id"], a["player_name"], a["outcome"], a["provider"]) == (754567, 22912, 217, "Ann", "Incomplete", "StatsBomb")
    assert a["start_x"] == 42.5 / 120 * 100 and a["start_y"] == 39.0625 and a["end_x"] == 50.0
    assert (a["source_start_x"], a["source_end_y"]) == (42.5, 40.0)
    assert (b["end_x"], b["end_y"], b["start_x"], b["team_id"], b["outcome"]) == (100.0, 100.0, None, None, None)


@pytest.mark.parametrize(
    "event, message",
    [
        (bomb(location=[121, 3]), "location"),
        (bomb(id=" "), "provider_event_id"),
        (bomb(id=None), "field 'id' is missing"),
        (bomb(period="1"), "field 'period' has the wrong type"),
        (bomb(period=True), "field 'period' has the wrong type"),
        (bomb(timestamp="00:61:00"), "no clock time"),
        (bomb(team=[1]), "field 'team' is no object"),
        (bomb(location=[1]), "no pair of numbers"),
        (bomb(second=60), "second must be"),
        ([1], "expected an object"),
    ],
)
def test_statsbomb_errors_name_the_event(spark, tmp_path, event, message):
    with pytest.raises(InvalidEvents, match="event at index 1") as e:
        statsbomb.load_events(spark, write(tmp_path / "e.json", [FULL, event]), 1)
    assert message in str(e.value)


def test_json_documents(spark, tmp_path):
    with pytest.raises(InvalidSource, match="is not JSON"):
        statsbomb.load_events(spark, write(tmp_path / "a.json", '[{"id": '), 1)
    with pytest.raises(InvalidSource, match="an array at the top"):
        statsbomb.load_events(spark, write(tmp_path / "b.json", {"id": 1}), 1)
    with pytest.raises(ValueError):
        statsbomb.load_events(spark, write(tmp_path / "c.json", []), 0)
    assert statsbomb.load_events(spark, write(tmp_path / "d.json", []), 1).count() == 0


HEAD = "Team,Type,Subtype,Period,Start Frame,Start Time [s],End Frame,End Time [s],From,To,Start X,Start Y,End X,End Y"
ROWS = [
    "Away,SET PIECE,KICK OFF,1,51,2.04,51,2.04,Player23,,NaN,NaN,NaN,NaN",
    'Away,"PASS",,1,51,2.04,96,3.84,"Pl ""X""",Player20,0.45,0.39,1.02,0.37',
    "",
    "Home,BALL-LOST,,2,9,2885.4,9,2885.4,Player9,,0.2,0.5,0.3,0.6",
]


def test_metrica(spark, tmp_path):
    path = write(tmp_path / "m.csv", "\r\n".join([HEAD, *ROWS]) + "\r\n")
    a, b, c = metrica.load_events(spark, path, 3, "left-to-right").orderBy("_ord").collect()
    assert (a["provider_event_id"], a["event_type"], a["outcome"], a["start_x"], a["team_name"]) == ("metrica:3:51:0", "Set Piece", "KICK OFF", None, "Away")
    assert (b["player_name"], b["start_x"], b["source_end_x"], b["end_x"], b["outcome"]) == ('Pl "X"', 100 - 0.45 / 1 * 100, 1.02, None, None)
    assert (c["provider_event_id"], c["event_type"], c["minute"], c["second"], c["timestamp"], c["start_x"]) == ("metrica:3:9:2", "Ball-Lost", 48, 5, 2885400, 80.0)
    other = metrica.load_events(spark, path, 3, "right-to-left").orderBy("_ord").collect()
    assert (other[1]["start_x"], other[2]["start_x"]) == (45.0, 20.0)


@pytest.mark.parametrize(
    "rows, message",
    [
        (["Home,PASS,,3,1,1.0,1,1.0,A,,0,0,0,0"], "line 2: Period is neither 1 nor 2"),
        (["Home,PASS,,1,1,1.0,1,1.0,A,,0,0,0,0", "", "Us,PASS,,1,1,1.0,1,1.0,A,,0,0,0,0"], "line 4: Team is neither"),
        (["Home,PASS,,1,1,1.0,1,1.0,A,,0,NaN,0,0"], "only one is given"),
        (["Home,PASS,,1,1,x,1,1.0,A,,0,0,0,0"], "is no finite number"),
        (["Home,PASS,,1,1,1.0,1"], "number of fields"),
        (["Home,,,1,1,1.0,1,1.0,A,,0,0,0,0"], "Type is empty"),
        (['Home,PASS,"x,1,1,1.0,1,1.0,A,,0,0,0,0'], "a quoted field has no end"),
    ],
)
def test_metrica_errors_name_the_row(spark, tmp_path, rows, message):
    with pytest.raises(InvalidEvents) as e:
        metrica.load_events(spark, write(tmp_path / "m.csv", "\n".join([HEAD, *rows])), 3, "left-to-right")
    assert message in str(e.value)


def test_metrica_header(spark, tmp_path):
    with pytest.raises(InvalidSource, match="header lacks 'End Y'"):
        metrica.load_events(spark, write(tmp_path / "m.csv", HEAD.removesuffix(",End Y") + "\n"), 3, "left-to-right")
    with pytest.raises(InvalidSource, match="repeated"):
        metrica.load_events(spark, write(tmp_path / "n.csv", HEAD + ",Team\n"), 3, "left-to-right")
    with pytest.raises(ValueError, match="direction"):
        metrica.load_events(spark, write(tmp_path / "o.csv", HEAD + "\n"), 3, None)


def test_metrica_many_files(spark, tmp_path):
    """Each file has a header, line numbers and a match of its own; a long file takes no longer per line."""
    row = "Home,PASS,,1,{i},1.0,1,1.0,A,,0.5,0.5,0.5,0.5"
    for k, n in ((1, 500), (2, 500), (3, 20_000)):
        lines = [HEAD, *(row.format(i=i) for i in range(n))]
        if k == 2:
            lines = [",".join(reversed(x.split(","))) for x in lines]
        write(tmp_path / f"game_{k}.csv", "\n\n".join(lines))
    match = F.regexp_extract("file", r"game_(\d+)", 1).cast("long")
    events = metrica.load_events(spark, str(tmp_path / "game_*.csv"), match, "left-to-right")
    got = {r["match_id"]: (r["n"], r["ids"], r["top"]) for r in events.groupBy("match_id").agg(F.count("*").alias("n"), F.count_distinct("provider_event_id").alias("ids"), F.max("_ord").alias("top")).collect()}
    assert got == {1: (500, 500, 499), 2: (500, 500, 499), 3: (20_000, 20_000, 19_999)}
    assert events.where("match_id = 2 and _ord = 7").first()["provider_event_id"] == "metrica:2:7:7"


def scout(**more):
    return {"id": 177959171, "matchId": 7, "teamId": 1609, "playerId": 25413, "eventName": "Pass", "matchPeriod": "2H", "eventSec": 125.0, "positions": [{"x": 49, "y": 51}, {"x": 31, "y": 78}], "tags": [{"id": 1801}]} | more


def test_wyscout(spark, tmp_path):
    rows = [scout(), scout(matchId=8, positions="junk"), scout(playerId=0, matchPeriod="1H", eventSec=2.4175, positions=[{"x": 0, "y": 100}], tags=[{"id": 5}])]
    a, b = wyscout.load_events(spark, write(tmp_path / "w.json", rows), 7).orderBy("_ord").collect()
    assert (a["minute"], a["second"], a["period"], a["timestamp"], a["outcome"], a["player_id"], a["end_y"]) == (47, 5, 2, 125000, "Accurate", 25413, 78.0)
    assert (b["timestamp"], b["minute"], b["player_id"], b["outcome"], b["start_y"], b["end_x"], b["_ord"]) == (2418, 0, None, None, 100.0, None, 2)
    with pytest.raises(ValueError, match="no events of match 123"):
        wyscout.load_events(spark, str(tmp_path / "w.json"), 123)
    for bad in (scout(positions=[{"x": 101, "y": 0}]), scout(matchPeriod="3H"), scout(positions=[{"x": 1}]), scout(tags=[{}]), scout(positions=[{"x": 1, "y": 1}] * 3), scout(matchId="7")):
        with pytest.raises(InvalidEvents, match="index 0"):
            wyscout.load_events(spark, write(tmp_path / "x.json", [bad]), 7)


def test_statsbomb_metadata(spark, tmp_path):
    match = {"match_id": 22912, "match_date": "2019-06-01", "kick_off": "21:00:00.000", "competition": {"competition_id": 16, "competition_name": "CL"}, "season": {"season_id": 4, "season_name": "2018/2019"}, "home_team": {"home_team_id": 38, "home_team_name": "T"}, "away_team": {"away_team_id": 24, "away_team_name": "L"}, "home_score": 0, "away_score": 2}
    got = metadata.statsbomb_matches(spark, write(tmp_path / "m.json", [match, match | {"match_id": 2, "kick_off": None, "home_score": None, "away_score": None}]))
    a, b = got["matches"].orderBy("_ord").collect()
    assert (a["id"], a["kickoff"], a["home_team"], a["away_score"], a["competition_id"]) == ("22912", 1559422800, "38", 2, "16")
    assert (b["kickoff"], b["home_score"]) == (None, None)
    assert got["teams"].count() == 4 and got["seasons"].first()["parent_provider_id"] == "16"
    lineups = [{"team_id": 38, "team_name": "T", "lineup": [{"player_id": 3, "player_name": "Ann"}, {"player_id": 4, "player_name": "Bea"}]}]
    players = metadata.statsbomb_lineups(spark, write(tmp_path / "l.json", lineups))["players"].orderBy("_ord").collect()
    assert [(p["provider_id"], p["name"], p["current_team"]) for p in players] == [("3", "Ann", "38"), ("4", "Bea", "38")]
    with pytest.raises(InvalidEvents, match="record at index 0"):
        metadata.statsbomb_matches(spark, write(tmp_path / "n.json", [match | {"match_date": "2019-02-30"}]))


def test_wyscout_metadata(spark, tmp_path):
    players = [{"wyId": 1, "shortName": "A. B"}, {"wyId": 2, "shortName": "", "firstName": "Ann", "lastName": "", "currentTeamId": "null"}, {"wyId": 3, "firstName": "Ann", "lastName": "Bo", "currentTeamId": 9}, {"wyId": 4, "shortName": "X", "currentTeamId": 0}]
    got = metadata.wyscout_players(spark, write(tmp_path / "p.json", players))["players"].orderBy("_ord").collect()
    assert [(p["name"], p["current_team"]) for p in got] == [("A. B", None), ("Ann", None), ("Ann Bo", "9"), ("X", None)]
    match = {"wyId": 5, "competitionId": 364, "seasonId": 181150, "dateutc": "2017-08-11 18:45:00", "teamsData": {"1609": {"teamId": 1609, "side": "home", "score": 4}, "1631": {"teamId": 1631, "side": "away", "score": 3}}}
    m = metadata.wyscout_matches(spark, write(tmp_path / "m.json", [match]))
    r = m["matches"].first()
    assert (r["kickoff"], r["home_team"], r["away_team"], r["home_score"], r["season_name"]) == (1502477100, "1609", "1631", 4, None)
    assert m["seasons"].first()["name"] is None
    one = dict(list(match["teamsData"].items())[:1])
    for bad in (match | {"teamsData": one}, match | {"teamsData": {"7": match["teamsData"]["1609"], "1631": match["teamsData"]["1631"]}}, match | {"dateutc": "2017-08-11"}):
        with pytest.raises(InvalidEvents, match="record at index 0"):
            metadata.wyscout_matches(spark, write(tmp_path / "b.json", [bad]))
    assert metadata.wyscout_teams(spark, write(tmp_path / "t.json", [{"wyId": 1609, "name": "Arsenal"}]))["teams"].first()["provider_id"] == "1609"


def test_store(spark, tmp_path):
    events = statsbomb.load_events(spark, write(tmp_path / "e.json", [FULL, bomb(id="a2")]), 5)
    path = str(tmp_path / "store")
    store.save_events(events, path)
    again = store.load_events(spark, path)
    assert again.schema == events.schema or again.columns == events.columns
    assert sorted(again.collect()) == sorted(events.collect())
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        store.save_events(events, path)
    parts = str(tmp_path / "parts")
    store.save_events(events, parts, ("provider", "match_id"))
    assert sorted(store.load_events(spark, parts).collect()) == sorted(events.collect())
    plan = store.load_events(spark, path, check=False).where("event_type = 'Pass'").select("minute")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,Pass)]" in plan and "ReadSchema: struct<minute:int,event_type:string>" in plan
    spark.range(3).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="Event store"):
        store.load_events(spark, str(tmp_path / "other"))


TRICKY = ['}', '{"', '\\', '\\"}', '"', '[{', ']},{"x":1}', "\n}\t", "é} {", ""]


@pytest.mark.parametrize("most", ["134217728", "64"])
def test_json_read_in_pieces(spark, tmp_path, most):
    """Elements of any kind, with braces and quotes in their texts, from files that are split anywhere."""
    from touchline.sources.variants import records

    wanted = {}
    for n in range(6):
        elements = [{"a": TRICKY[(k + n) % 10], TRICKY[(k * 3 + n) % 10]: [{"b": {TRICKY[k % 10] + "k": k}}, [[], {}]]} for k in range(n * 7)]
        elements += [[], ["}", {"c": "{"}]] * (n % 2)
        wanted[write(tmp_path / f"{n}.json", json.dumps(elements, indent=n % 3 or None, ensure_ascii=n < 3))] = elements
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    try:
        rows = records(spark, str(tmp_path), "a").select("file", "_ord", F.to_json("v").alias("v")).orderBy("_ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {f: [json.loads(r["v"]) for r in rows if r["file"].endswith(f)] for f in wanted}
    assert got == wanted


@pytest.mark.parametrize("text", [" ", "[", '[{"a":1}', '[{"a":1},]', '[{"a":1},,{"b":2}]', '[{"a":1}] x', '[{"a":1}]]', '[{"a":1}{"b":2}]', '[,{"a":1}]', '[{"a":"}]', '{"a":1', '[{"a":1}],[{"b":2}]', '[{"a":1}\\,{"b":2}]', "[1,]"])
def test_json_that_is_none(spark, tmp_path, text):
    from touchline.sources.variants import records

    write(tmp_path / "a.json", [{"a": 1}])
    with pytest.raises(InvalidSource, match="b.json' is not JSON"):
        records(spark, str(tmp_path), "a") if write(tmp_path / "b.json", text) else None


def test_elements_carry_only_their_own_names(spark, tmp_path):
    """An element of a parsed document would keep the names of all others."""
    from touchline.sources.variants import records

    rows = records(spark, write(tmp_path / "a.json", [{f"key{i}": i} for i in range(3_000)]), "a").collect()
    assert len(rows) == 3_000 and max(len(r["v"].metadata) for r in rows) < 50


def test_documents_are_written_a_record_at_a_time(spark):
    """No row holds a whole file's text, and what is written is one document a file all the same."""
    from touchline.suite_sources import written

    rows = spark.range(3_000).select((F.col("id") % 3).alias("game"), F.col("id"), F.to_json(F.struct("id")).alias("record"))
    path = written(rows.repartition(7), "game", "id", "record")
    assert spark.read.text(path).agg(F.max(F.length("value"))).first()[0] < 20
    files = spark.read.text(path, wholetext=True).collect()
    assert {r["game"]: [x["id"] for x in json.loads(r["value"])] for r in files} == {k: list(range(k, 3_000, 3)) for k in range(3)} and len(files) == 3
    lines = written(rows, "game", "id", "record", "head\r\n", "\r\n", "")
    assert spark.read.text(lines, wholetext=True).where("game = 2").first()["value"].split("\r\n")[:2] == ["head", '{"id":2}']
