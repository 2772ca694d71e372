import pytest

from touchline import render
from touchline.plans.language import aggregate_call, aggregation_query, column_list, equality, event_query
from touchline.plans.query import Aggregate, AggregationQuery, Equals, EventQuery, Millis, aggregate, counters, project
from touchline.schema import EVENT_SCHEMA_ORD


def event(i, **changes):
    base = dict(
        provider_event_id=f"e{i}", match_id=1, period=1, timestamp=1000 * i, minute=12, second=5, possession_id=None, team_id=7, team_name="Reds", player_id=None, player_name=None, event_type="Pass", outcome=None,
        start_x=None, start_y=None, end_x=None, end_y=None, provider="P", source_start_x=None, source_start_y=None, source_end_x=None, source_end_y=None, _ord=i,
    )
    return base | changes


@pytest.fixture(scope="module")
def events(spark):
    rows = [event(0, player_name="Ann", start_x=35.0, start_y=1.0), event(1, event_type="Carry", minute=12, start_x=28.5, start_y=2.0), event(2, minute=13, start_x=50.0, start_y=3.0)]
    return spark.createDataFrame([tuple(r[f.name] for f in EVENT_SCHEMA_ORD) for r in rows], EVENT_SCHEMA_ORD).repartition(3)


def values(df):
    return [tuple(r) for r in df.collect()]


def test_projection_keeps_source_order_and_nulls(events):
    assert values(project(events, EventQuery(["provider_event_id", "player_name"]))) == [("e0", "Ann"), ("e1", None), ("e2", None)]


def test_filters_are_anded_and_null_never_matches(events):
    assert values(project(events, event_query("provider_event_id", ["event_type=Pass", "minute=13"]))) == [("e2",)]
    assert values(project(events, event_query("provider_event_id", ["player_name="]))) == []


def test_grouping_in_first_seen_order(events):
    q = aggregation_query(["count(*)", "count(player_name)", "avg(start_x)", "min(minute)", "max(minute)"], "event_type")
    got = aggregate(events, q)
    assert got.columns == ["event_type", "count(*)", "count(player_name)", "avg(start_x)", "min(minute)", "max(minute)"]
    assert values(got) == [("Pass", 2, 1, 42.5, 12, 13), ("Carry", 1, 0, 28.5, 12, 12)]


def test_global_sums(events):
    assert values(aggregate(events, aggregation_query(["sum(minute)", "sum(start_x)"]))) == [(37, 113.5)]


def test_empty_inputs(events):
    none = ["event_type=none"]
    assert values(aggregate(events, aggregation_query(["count(*)", "sum(minute)"], filters=none))) == [(0, None)]
    assert values(aggregate(events, aggregation_query(["count(*)"], "event_type", none))) == []


def test_null_forms_a_group(events):
    assert values(aggregate(events, aggregation_query(["count(*)"], "player_name"))) == [("Ann", 1), (None, 2)]


@pytest.mark.parametrize(
    "make",
    [
        lambda: EventQuery([]),
        lambda: EventQuery(["minute", "minute"]),
        lambda: EventQuery(["Minute"]),
        lambda: Equals("minute", "12"),
        lambda: Equals("minute", True),
        lambda: Equals("minute", 2**31),
        lambda: Equals("timestamp", 5),
        lambda: Equals("start_x", float("nan")),
        lambda: Equals("start_x", 1),
        lambda: Aggregate("sum", "team_id"),
        lambda: Aggregate("avg", "timestamp"),
        lambda: Aggregate("median", "minute"),
        lambda: Aggregate("max"),
        lambda: AggregationQuery([]),
        lambda: AggregationQuery([Aggregate("count"), Aggregate("count")]),
        lambda: AggregationQuery([Aggregate("count")], ["period", "period"]),
        lambda: column_list("minute,,second"),
        lambda: equality("minute"),
        lambda: equality("minute=1x"),
        lambda: equality("start_x=inf"),
        lambda: aggregate_call("sum(*)"),
        lambda: aggregate_call("SUM(minute)"),
        lambda: aggregate_call("sum minute"),
    ],
)
def test_bad_queries_fail_before_spark(make):
    with pytest.raises(ValueError):
        make()


def test_literals():
    assert equality("team_name=a=b").value == "a=b"
    assert equality("timestamp=5").value == Millis(5)
    assert equality("start_x=1e1").value == 10.0


def test_counters(events):
    assert values(counters(events)) == [(3, 1, 3, 0)]


def test_rendering(events):
    one = project(events, event_query("event_type,player_name,start_x,timestamp", ["minute=13"]))
    assert render.projection(one) == "Matched 1 event\nevent_type\tplayer_name\tstart_x\ttimestamp\nPass\tNULL\t50\t2000\n"
    assert render.aggregation(aggregate(events, aggregation_query(["avg(start_x)"]))) == "Result rows: 1\navg(start_x)\n37.8333\n"
