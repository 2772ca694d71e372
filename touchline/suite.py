"""Queries over the driver's tables, one for each operator, and the SQL that each is held against.

The tables hold no football, so football-like relations are derived from them by the same arithmetic on both sides.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import pitch, text, times, validation
from .operators import candidates as cand
from .operators import coverage as cov
from .operators import identity as ident
from .plans.language import aggregation_query, event_query
from .plans.query import Equals, EventQuery, aggregate, counters, matching, project
from .schema import ORD
from .settled import positions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str, name: str | None = None):
    """Registers a query with its SQL."""

    def add(f):
        QUERIES[name or f.__name__] = f
        ORACLES[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


#: Events in the 22-column form, from the table `events`.
FOOTBALL = {
    "provider_event_id": "cast(event_id as string)",
    "match_id": "event_id % 40 + 1",
    "period": "cast(event_id % 2 + 1 as int)",
    "timestamp": "event_id * 250 % 2700000",
    "minute": "cast(floor((event_id * 250 % 2700000) / 60000) as int)",
    "second": "cast(floor((event_id * 250 % 2700000) / 1000) % 60 as int)",
    "possession_id": "nullif(event_id % 7, 0)",
    "team_id": "case when user_id % 5 <> 0 then user_id % 20 + 1 end",
    "team_name": "case when user_id % 5 <> 0 then concat('Team ', cast(user_id % 20 + 1 as string)) when event_id % 2 = 0 then 'Home' else 'Away' end",
    "player_id": "nullif(user_id % 11, 0)",
    "player_name": "case when user_id % 11 <> 0 then concat('Player ', cast(user_id % 11 as string)) end",
    "event_type": "event_type",
    "outcome": "case when event_id % 4 = 0 then 'Complete' when event_id % 4 = 1 then 'Incomplete' end",
    "start_x": "case when event_id % 9 <> 0 then cast(event_id * 37 % 10001 as double) / 100 end",
    "start_y": "case when event_id % 9 <> 0 then cast(event_id * 91 % 10001 as double) / 100 end",
    "end_x": "case when event_id % 13 <> 0 then cast(event_id * 53 % 10001 as double) / 100 end",
    "end_y": "case when event_id % 13 <> 0 then cast(event_id * 17 % 10001 as double) / 100 end",
    "provider": "case event_id % 3 when 0 then 'StatsBomb' when 1 then 'Metrica' else 'Wyscout' end",
    "source_start_x": "case when event_id % 9 <> 0 then value end",
    "source_start_y": "case when event_id % 9 <> 0 then value / 2 end",
    "source_end_x": "case when event_id % 13 <> 0 then value end",
    "source_end_y": "case when event_id % 13 <> 0 then value / 4 end",
}
FE = "with fe as (select " + ", ".join(f"{sql} as {c}" for c, sql in FOOTBALL.items()) + ", event_id as _ord from events) "
FE = FE.replace("as string)", "as varchar)")


def football(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(*[F.expr(sql).alias(c) for c, sql in FOOTBALL.items()], F.col("event_id").alias(ORD))


def renamed(df: DataFrame, *names: str) -> DataFrame:
    """Names without brackets, which SQL can't spell plainly."""
    return df.toDF(*names)


# ---- filters and projections ----


@query(FE + "select provider_event_id, event_type from fe where event_type = 'purchase'")
def p1_filter_equals(spark, sf):
    return project(football(spark, sf), EventQuery(["provider_event_id", "event_type"], [Equals("event_type", "purchase")]))


@query(FE + "select provider_event_id, team_id, period from fe where event_type = 'click' and team_id = 7 and period = 2")
def p2_filter_and(spark, sf):
    return project(football(spark, sf), event_query("provider_event_id,team_id,period", ["event_type=click", "team_id=7", "period=2"]))


@query(FE + "select count(*) as n from fe where outcome = 'Complete' and outcome = 'Incomplete'")
def p2_contradiction(spark, sf):
    return matching(football(spark, sf), [Equals("outcome", "Complete"), Equals("outcome", "Incomplete")]).agg(F.count(F.lit(1)).alias("n"))


@query(FE + "select count(*) as n, count(player_id) as with_player from fe where player_id = 3")
def p2_null_never_matches(spark, sf):
    return matching(football(spark, sf), [Equals("player_id", 3)]).agg(F.count(F.lit(1)).alias("n"), F.count("player_id").alias("with_player"))


@query(FE + "select provider_event_id, start_x, team_name, row_number() over (order by _ord) - 1 as place from fe where provider = 'Metrica'")
def p3_project_ordered(spark, sf):
    return positions(project(football(spark, sf), EventQuery(["provider_event_id", "start_x", "team_name"], [Equals("provider", "Metrica")])), "place")


@query(FE + "select provider_event_id, timestamp, minute from fe where timestamp = 500000")
def p4_duration_literal(spark, sf):
    return project(football(spark, sf), event_query("provider_event_id,timestamp,minute", ["timestamp=500000"]))


@query(
    FE + "select provider_event_id, case when start_x is not null and start_y is not null then start_x end as x, case when start_x is not null and start_y is not null then start_y end as y, timestamp as t from fe"
)
def p6_rebuilt_rows(spark, sf):
    from .plans.query import rebuilt

    return rebuilt(football(spark, sf)).select("provider_event_id", F.col("start_location.x").alias("x"), F.col("start_location.y").alias("y"), F.col("time.timestamp").alias("t"))


# ---- aggregates ----

ALL = "count(*) as n, count(outcome) as n_outcome, cast(sum(minute) as bigint) as sum_minute, round(sum(start_x), 6) as sum_x, round(avg(start_x), 6) as avg_x, round(avg(minute), 6) as avg_minute, min(event_type) as min_type, max(timestamp) as max_time, min(start_y) as min_y, max(team_id) as max_team"
ALL_NAMES = ["n", "n_outcome", "sum_minute", "sum_x", "avg_x", "avg_minute", "min_type", "max_time", "min_y", "max_team"]
ALL_CALLS = ["count(*)", "count(outcome)", "sum(minute)", "sum(start_x)", "avg(start_x)", "avg(minute)", "min(event_type)", "max(timestamp)", "min(start_y)", "max(team_id)"]


def _all(events: DataFrame, group_by: str | None = None, filters=()) -> DataFrame:
    groups = group_by.split(",") if group_by else []
    out = renamed(aggregate(events, aggregation_query(ALL_CALLS, group_by, filters)), *groups, *ALL_NAMES)
    return out.withColumns({c: F.round(c, 6) for c in ("sum_x", "avg_x", "avg_minute")})


@query(FE + f"select {ALL} from fe")
def a1_a7_global(spark, sf):
    return _all(football(spark, sf))


@query(FE + f"select {ALL} from fe where event_type = 'none'")
def a10_global_empty(spark, sf):
    return _all(football(spark, sf), filters=["event_type=none"])


@query(FE + f"select event_type, {ALL} from fe group by event_type")
def a8_group_one(spark, sf):
    return _all(football(spark, sf), "event_type")


@query(FE + f"select provider, period, {ALL} from fe group by provider, period")
def a8_group_two(spark, sf):
    return _all(football(spark, sf), "provider,period")


@query(FE + f"select outcome, {ALL} from fe group by outcome")
def a8_null_key(spark, sf):
    return _all(football(spark, sf), "outcome")


@query(FE + "select count(*) as n from (select event_type, count(*) from fe where event_type = 'none' group by event_type)")
def a11_group_empty(spark, sf):
    return _all(football(spark, sf), "event_type", ["event_type=none"]).agg(F.count(F.lit(1)).alias("n"))


@query(FE + f"select team_name, {ALL} from fe where provider = 'Wyscout' group by team_name")
def a12_filter_then_group(spark, sf):
    return _all(football(spark, sf), "team_name", ["provider=Wyscout"])


@query(FE + "select period, count(possession_id) as n_ids, min(team_name) as least_text, max(player_name) as greatest_text, min(timestamp) as least_time, max(end_y) as greatest_number, cast(sum(second) as bigint) as sum_int from fe group by period")
def a3_a6_a7_types(spark, sf):
    calls = ["count(possession_id)", "min(team_name)", "max(player_name)", "min(timestamp)", "max(end_y)", "sum(second)"]
    return renamed(aggregate(football(spark, sf), aggregation_query(calls, "period")), "period", "n_ids", "least_text", "greatest_text", "least_time", "greatest_number", "sum_int")


@query(FE + "select team_name, count(*) as n, row_number() over (order by min(_ord)) - 1 as place from fe group by team_name")
def a9_first_seen(spark, sf):
    """The order of first appearance that `aggregate` returns groups in."""
    return positions(renamed(aggregate(football(spark, sf), aggregation_query(["count(*)"], "team_name")), "team_name", "n"), "place")


@query(FE + ", g as (select event_type, count(*) as n, max(team_id) as top from fe group by event_type) select 0 as spot, 'event_type' as name, event_type as value from g union all select 1, 'count(*)', cast(n as varchar) from g union all select 2, 'max(team_id)', cast(top as varchar) from g")
def a14_names(spark, sf):
    """Names and values of a result's columns, in their order."""
    out = aggregate(football(spark, sf), aggregation_query(["count(*)", "max(team_id)"], "event_type"))
    cells = F.array(*[F.struct(F.lit(i).alias("spot"), F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(out.columns)])
    return out.select(F.inline(cells))


@query(FE + 'select count(*) as "rows", count(*) filter (where player_id is not null or player_name is not null) as player_data, count(start_x) as start_locations, count(end_x) as end_locations from fe')
def a15_counters(spark, sf):
    return counters(football(spark, sf))


# ---- expressions ----


@query("select event_id, (event_id % 121)::double / 120 * 100 as x, (event_id % 81)::double / 80 * 100 as y, ((event_id % 125)::double between 0 and 120) as inside from events")
def f1_f2_f3_statsbomb_pitch(spark, sf):
    e = table(spark, sf, "events")
    x, y = pitch.canonical((F.col("event_id") % 121).cast("double"), (F.col("event_id") % 81).cast("double"), *pitch.STATSBOMB_PITCH)
    return e.select("event_id", x.alias("x"), y.alias("y"), pitch.on_pitch((F.col("event_id") % 125).cast("double"), F.lit(1.0), *pitch.STATSBOMB_PITCH).alias("inside"))


@query(
    """with t as (select event_id, (event_id % 11)::double / 10 as sx, case when event_id % 2 = 0 then 'Home' else 'Away' end as team, event_id // 2 % 2 + 1 as period, event_id % 3 = 0 as ltr from events)
    select event_id, case when (case when team = 'Away' then 1 else 0 end + case when period = 2 then 1 else 0 end + case when ltr then 0 else 1 end) % 2 = 1 then 100 - sx / 1 * 100 else sx / 1 * 100 end as x from t"""
)
def f4_metrica_direction(spark, sf):
    e = table(spark, sf, "events").select("event_id", ((F.col("event_id") % 11).cast("double") / 10).alias("sx"), F.when(F.col("event_id") % 2 == 0, "Home").otherwise("Away").alias("team"), (F.floor(F.col("event_id") / 2) % 2 + 1).alias("period"), (F.col("event_id") % 3 == 0).alias("ltr"))
    x, _ = pitch.canonical(F.col("sx"), F.lit(0.0), *pitch.METRICA_PITCH, pitch.attacks_left(F.col("team"), F.col("period"), F.col("ltr")))
    return e.select("event_id", x.alias("x"))


@query(
    """select event_id, event_id % 7 * 3600000 + event_id % 60 * 60000 + event_id * 7 % 60 * 1000 + event_id % 1000 as ms,
    case when event_id % 70 < 60 then event_id % 70 * 60000::bigint end as checked from events"""
)
def f5_clock(spark, sf):
    e = table(spark, sf, "events")
    i = F.col("event_id")
    clock = F.format_string("%02d:%02d:%02d.%03d", i % 7, i % 60, i * 7 % 60, i % 1000)
    return e.select("event_id", times.clock_millis(clock).alias("ms"), times.clock_millis(F.format_string("0:%d:00", i % 70)).alias("checked"))


@query(
    """select event_id, cast(floor(value * 1000.0::double + 0.5::double) as bigint) as ms, cast(floor(floor(value) / 60) as int) + 45 as minute, cast(floor(value) % 60 as int) as second from events"""
)
def f6_split_seconds(spark, sf):
    ms, minute, second = times.split_seconds(F.col("value"), F.lit(45))
    return table(spark, sf, "events").select("event_id", ms.alias("ms"), minute.alias("minute"), second.alias("second"))


@query(
    """select event_id, case event_id % 6 when 0 then 1 when 1 then 2 when 2 then 3 when 3 then 4 when 4 then 5 end as n, case event_id % 6 when 0 then 0 when 1 then 45 when 2 then 90 when 3 then 105 when 4 then 120 end as start from events"""
)
def f7_wyscout_period(spark, sf):
    names = F.array(*map(F.lit, ("1H", "2H", "E1", "E2", "P", "X")))
    n, start = times.wyscout_period(F.get(names, (F.col("event_id") % 6).cast("int")))
    return table(spark, sf, "events").select("event_id", n.alias("n"), start.alias("start"))


@query(
    """select p_partkey, array_to_string(list_transform(string_split(lower(p_type || ' set-piece'), ' '), lambda w: array_to_string(list_transform(string_split(w, '-'), lambda v: upper(substr(v, 1, 1)) || substr(v, 2)), '-')), ' ') as title from part"""
)
def f8_title_case(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.title_case(F.upper(F.concat("p_type", F.lit(" set-piece")))).alias("title"))


@query("select event_id, 'metrica:' || (event_id % 40 + 1) || ':' || (event_id * 3) || ':' || event_id as id from events")
def f9_metrica_id(spark, sf):
    from .sources.metrica import event_identifier

    return table(spark, sf, "events").select("event_id", event_identifier(F.col("event_id") % 40 + 1, (F.col("event_id") * 3).cast("string"), F.col("event_id")).alias("id"))


@query("select p_partkey, case when p_partkey % 3 = 0 then 'Accurate' end as outcome from part")
def f12_tags(spark, sf):
    from .sources.wyscout import ACCURATE, tag_outcome

    tags = F.array(F.struct(F.when(F.col("p_partkey") % 3 == 0, ACCURATE).otherwise(1).alias("id")), F.struct(F.lit(2).alias("id")))
    return table(spark, sf, "part").select("p_partkey", tag_outcome(F.transform(tags, lambda t: t["id"])).alias("outcome"))


@query("select event_id, case when event_id % 4 = 0 then null else value end as x from events")
def f14_missing_coordinate(spark, sf):
    from .sources.metrica import coordinate_number

    raw = F.when(F.col("event_id") % 8 == 0, "NaN").when(F.col("event_id") % 8 == 4, "").otherwise(F.col("value").cast("string"))
    return table(spark, sf, "events").select("event_id", coordinate_number(raw).alias("x"))


@query("""select p_partkey, lower(trim(regexp_replace('  ' || upper(p_name) || chr(9) || '  X ', '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) as name, p_partkey % 5 = 0 as blank from part""")
def f15_f16_names(spark, sf):
    p = table(spark, sf, "part")
    padded = F.concat(F.lit("  "), F.upper("p_name"), F.lit("\t  X "))
    blank = F.when(F.col("p_partkey") % 5 == 0, F.lit(" \t ")).otherwise(F.col("p_name"))
    return p.select("p_partkey", text.identity_name(padded).alias("name"), text.is_blank(blank).alias("blank"))


@query("select o_orderkey, cast(epoch(o_orderdate) as bigint) // 86400 * 86400 + o_orderkey % 24 * 3600 + 30 * 60 + 7 as t from orders")
def f17_epoch_seconds(spark, sf):
    o = table(spark, sf, "orders")
    clock = F.format_string("%02d:30:07.9", F.col("o_orderkey") % 24)
    return o.select("o_orderkey", times.epoch_seconds(F.date_format(F.col("o_orderdate"), "yyyy-MM-dd"), clock).alias("t"))


@query("select event_id, (event_id % 5) || '-' || nullif(event_id % 3, 0) as score, 'P:' || event_id || coalesce('@' || nullif(event_id % 4, 0), '') as ref from events")
def f18_f19_texts(spark, sf):
    i = F.col("event_id")
    scoped = F.nullif(i % 4, F.lit(0)).cast("string")
    return table(spark, sf, "events").select("event_id", text.score_text(i % 5, F.nullif(i % 3, F.lit(0))).alias("score"), text.reference_text(F.lit("P"), i.cast("string"), scoped).alias("ref"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def f23_json_field(spark, sf):
    from .sources.variants import integer

    v = F.parse_json("props")
    return table(spark, sf, "events").select("event_id", integer(v, "$.k").alias("k"))


@query(
    FE
    + """, bad as (select * replace (case when _ord % 17 = 0 then '  ' else provider_event_id end as provider_event_id, case when _ord % 19 = 0 then 0 else match_id end as match_id, case when _ord % 23 = 0 then 60 else second end as second, case when _ord % 29 = 0 then 100.5 else start_x end as start_x, case when _ord % 31 = 0 then null else end_y end as end_y) from fe)
    select case when trim(provider_event_id) = '' then 'provider_event_id must not be blank' when match_id <= 0 then 'match_id must be positive' when second not between 0 and 59 then 'second must be between 0 and 59'
      when (start_x is null) <> (start_y is null) then 'start coordinates must be present together' when start_x > 100 then 'start_x must be between 0 and 100' when (end_x is null) <> (end_y is null) then 'end coordinates must be present together' end as error, count(*) as n from bad group by 1"""
)
def v1_v4_validation(spark, sf):
    bad = football(spark, sf)
    for column, every, value in (("provider_event_id", 17, F.lit("  ")), ("match_id", 19, F.lit(0).cast("long")), ("second", 23, F.lit(60)), ("start_x", 29, F.lit(100.5)), ("end_y", 31, F.lit(None).cast("double"))):
        bad = bad.withColumn(column, F.when(F.col(ORD) % every == 0, value).otherwise(F.col(column)))
    return bad.groupBy(validation.event_error().alias("error")).agg(F.count(F.lit(1)).alias("n"))


# ---- identities ----

MAPPINGS = {
    "match": "select 'StatsBomb' as provider, cast(c_custkey as {s}) as provider_id, cast(null as {s}) as provider_match_id, c_custkey * 10 as canonical_id from customer",
    "team": "select case c_custkey % 3 when 0 then 'StatsBomb' when 1 then 'Metrica' else 'Wyscout' end as provider, cast(c_custkey as {s}) as provider_id, cast(null as {s}) as provider_match_id, c_custkey + 1000 as canonical_id from customer union all select 'Metrica', case when c_custkey % 2 = 0 then 'Home' else 'Away' end, cast(c_custkey as {s}), c_custkey + 2000 from customer",
    "player": "select 'Wyscout' as provider, cast(c_custkey as {s}) as provider_id, cast(null as {s}) as provider_match_id, c_custkey + 3000 as canonical_id from customer",
}


def mappings(spark: SparkSession, sf_dir: str, what: str) -> DataFrame:
    return spark.sql(MAPPINGS[what].format(s="string").replace("from customer", "from {customer}"), customer=table(spark, sf_dir, "customer"))


M_SQL = ", ".join(f"{k}_m as ({v.format(s='varchar')})" for k, v in MAPPINGS.items())
RESOLVED = (
    FE
    + f", {M_SQL}, r as (select fe.*, a.canonical_id as canonical_match_id, b.canonical_id as canonical_team_id, c.canonical_id as canonical_player_id from fe"
    + " left join match_m a on a.provider = fe.provider and a.provider_id = cast(fe.match_id as varchar)"
    + " left join team_m b on b.provider = fe.provider and b.provider_id = case when fe.team_id is not null then cast(fe.team_id as varchar) else fe.team_name end and b.provider_match_id is not distinct from case when fe.team_id is null then cast(fe.match_id as varchar) end"
    + " left join player_m c on c.provider = fe.provider and c.provider_id = case when fe.player_id is not null then cast(fe.player_id as varchar) else fe.player_name end and c.provider_match_id is not distinct from case when fe.player_id is null then cast(fe.match_id as varchar) end) "
)


@query(f"with {M_SQL} select c_custkey, canonical_id from customer left join team_m on provider = 'Metrica' and provider_id = cast(c_custkey as varchar) and provider_match_id is null")
def j1_resolve_reference(spark, sf):
    refs = table(spark, sf, "customer").select("c_custkey", F.lit("Metrica").alias("provider"), F.col("c_custkey").cast("string").alias("provider_id"), F.lit(None).cast("string").alias("provider_match_id"))
    return ident.resolve(refs, mappings(spark, sf, "team")).select("c_custkey", "canonical_id")


def resolved_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ident.resolve_events(football(spark, sf_dir), *(mappings(spark, sf_dir, w) for w in ("match", "team", "player")))


@query(RESOLVED + "select provider_event_id, canonical_match_id, canonical_team_id, canonical_player_id from r")
def j2_resolve_events(spark, sf):
    return resolved_events(spark, sf).select("provider_event_id", "canonical_match_id", "canonical_team_id", "canonical_player_id")


@query(RESOLVED + "select canonical_team_id, count(*) as n, count(player_name) as with_player, round(avg(start_x), 6) as avg_x, min(minute) as first_minute from r where event_type = 'purchase' group by canonical_team_id")
def flagship_events_by_team(spark, sf):
    """Events resolved to the catalog, filtered, and grouped by canonical team in order of first appearance."""
    rows = resolved_events(spark, sf).where(Equals("event_type", "purchase").condition())
    return (
        rows.groupBy("canonical_team_id")
        .agg(F.count(F.lit(1)).alias("n"), F.count("player_name").alias("with_player"), F.round(F.avg("start_x"), 6).alias("avg_x"), F.min("minute").alias("first_minute"), F.min(ORD).alias("_first"))
        .orderBy("_first")
        .drop("_first")
    )


@query(RESOLVED + f"select distinct fe.provider, cast(team_id as varchar) as provider_id from fe where team_id is not null and not exists (select 1 from team_m b where b.provider = fe.provider and b.provider_id = cast(team_id as varchar) and b.provider_match_id is null)")
def j4_unresolved(spark, sf):
    refs = football(spark, sf).where("team_id is not null").select("provider", F.col("team_id").cast("string").alias("provider_id"), F.lit(None).cast("string").alias("provider_match_id")).distinct()
    return ident.unresolved(refs, mappings(spark, sf, "team")).select("provider", "provider_id")


@query(
    """with s as (select s_suppkey, s_name, s_suppkey as o from supplier union all select s_suppkey, case when s_suppkey % 4 = 0 then s_name || '!' else s_name end, s_suppkey + 100000 from supplier where s_suppkey % 2 = 0)
    select s_suppkey, arg_min(s_name, o) as s_name, count(distinct s_name) > 1 as conflict from s group by s_suppkey"""
)
def a19_deduplicated(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", F.col("s_suppkey").alias(ORD))
    again = s.where("s_suppkey % 2 = 0").select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, F.concat("s_name", F.lit("!"))).otherwise(F.col("s_name")).alias("s_name"), (F.col(ORD) + 100000).alias(ORD))
    return ident.deduplicated(s.unionByName(again), ["s_suppkey"], ["s_name"]).select("s_suppkey", "s_name", "conflict")


# ---- candidates ----

PROVIDER_TEAMS = "select 'Wyscout' as provider, cast(p_partkey as {s}) as provider_id, cast(null as {s}) as provider_match_id, case when p_partkey % 13 = 0 then '  ' else concat('  ', upper(p_name), ' ') end as name from part"
CANONICAL_TEAMS = "select row_number() over (order by p_name) as id, p_name as name, case row_number() over (order by p_name) % 7 when 0 then 'deprecated' when 1 then 'merged' else 'active' end as status from (select distinct p_name from part) q union all select row_number() over (order by p_name) + 100000 as id, p_name as name, case when row_number() over (order by p_name) % 5 = 0 then 'active' else 'deprecated' end as status from (select distinct p_name from part) q"
TEAM_MAPPED = "select 'Wyscout' as provider, cast(p_partkey as {s}) as provider_id, cast(null as {s}) as provider_match_id, p_partkey % 60 + 1 as canonical_id from part where p_partkey % 10 = 0"
T_SQL = f"with pt as ({PROVIDER_TEAMS.format(s='varchar')}), ct as ({CANONICAL_TEAMS}), tm as ({TEAM_MAPPED.format(s='varchar')}) "
NAME = "lower(trim(regexp_replace({}, '[ ]+', ' ', 'g')))"


def _team_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    return tuple(spark.sql(q.format(s="string").replace("from part", "from {part}"), part=part) for q in (PROVIDER_TEAMS, CANONICAL_TEAMS, TEAM_MAPPED))


@query(T_SQL + f"select pt.provider_id, pt.name, ct.id as canonical_id, ct.name as canonical_name, 'missing' as context, 1.0::double as confidence from pt join ct on {NAME.format('pt.name')} = {NAME.format('ct.name')} where ct.status = 'active' and trim(pt.name) <> '' and not exists (select 1 from tm where tm.provider_id = pt.provider_id)")
def r1_entity_candidates(spark, sf):
    records, canonical, mapped = _team_tables(spark, sf)
    return cand.entity_candidates(records, canonical, mapped).select("provider_id", "name", "canonical_id", "canonical_name", "context", "confidence")


SEASONS = """ps as (select 'Wyscout' as provider, cast(n_nationkey as varchar) as provider_id, n_name as name, cast(n_regionkey as varchar) as parent from nation),
 cs as (select n_nationkey + 1 as id, lower(n_name) as name, case when n_nationkey % 6 = 5 then 'deprecated' else 'active' end as status, case when n_nationkey % 4 = 3 then 9 else n_regionkey + 1 end as competition_id from nation),
 cm as (select cast(r_regionkey as varchar) as provider_id, r_regionkey + 1 as canonical_id from region where r_regionkey <> 2),
 sm as (select cast(n_nationkey as varchar) as provider_id, n_nationkey + 1 as canonical_id from nation where n_nationkey % 8 = 0)"""


def _season_tables(spark: SparkSession, sf_dir: str):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    none, key = F.lit(None).cast("string").alias("provider_match_id"), F.col("n_nationkey")
    wyscout = F.lit("Wyscout").alias("provider")
    records = n.select(wyscout, key.cast("string").alias("provider_id"), none, F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("parent_provider_id"))
    seasons = n.select((key + 1).cast("long").alias("id"), F.lower("n_name").alias("name"), F.when(key % 6 == 5, "deprecated").otherwise("active").alias("status"), F.when(key % 4 == 3, 9).otherwise(F.col("n_regionkey") + 1).cast("long").alias("competition_id"))
    competitions = r.where("r_regionkey <> 2").select(wyscout, F.col("r_regionkey").cast("string").alias("provider_id"), none, (F.col("r_regionkey") + 1).cast("long").alias("canonical_id"))
    mapped = n.where(key % 8 == 0).select(wyscout, key.cast("string").alias("provider_id"), none, (key + 1).cast("long").alias("canonical_id"))
    return records, seasons, competitions, mapped


@query(f"with {SEASONS} select ps.provider_id, cs.id::bigint as canonical_id, case when cm.canonical_id is null then 'missing' else 'agreeing' end as context, case when cm.canonical_id is null then 0.9 else 1.0 end::double as confidence from ps join cs on lower(ps.name) = cs.name left join cm on cm.provider_id = ps.parent where cs.status = 'active' and (cm.canonical_id is null or cm.canonical_id = cs.competition_id) and ps.provider_id not in (select provider_id from sm)")
def j5_season_candidates(spark, sf):
    records, seasons, competitions, mapped = _season_tables(spark, sf)
    return cand.entity_candidates(records, seasons, mapped, competitions).select("provider_id", "canonical_id", "context", "confidence")


def _matches(spark: SparkSession, sf_dir: str, left: bool) -> DataFrame:
    """Matches of all orders, a customer's being of one home team; the other provider's are shifted copies."""
    return table(spark, sf_dir, "orders").selectExpr(
        f"'{'StatsBomb' if left else 'Wyscout'}' as provider",
        "cast(o_orderkey as string) as id",
        "cast(o_orderkey % 4 as string) as competition_id",
        f"case when o_orderkey % 5 = 0 then null else {'concat(\'League \', o_orderkey % 4)' if left else 'upper(concat(\'League  \', o_orderkey % 4))'} end as competition_name",
        "case when o_orderkey % 8 = 1 then o_orderkey % 4 end as competition_canonical",
        "cast(o_orderkey % 6 as string) as season_id",
        "case when o_orderkey % 7 <> 0 then concat('S', o_orderkey % 6) end as season_name",
        "cast(null as bigint) as season_canonical",
        f"case when o_orderkey % 11 <> 0 then o_orderkey * 1000 + {'0' if left else '(o_orderkey % 5) * 200'} end as kickoff",
        "cast(o_custkey as string) as home_team",
        "cast(o_custkey + 1 as string) as away_team",
        "case when o_custkey % 9 <> 0 then o_custkey end as home_canonical",
        "case when o_custkey % 10 = 4 then o_custkey else o_custkey + 1 end as away_canonical",
        f"cast(o_orderkey % 4 as int) as home_score",
        f"cast(case when o_orderkey % 13 = 0 then null when o_orderkey % 17 = 0 then {'1' if left else '2'} else o_orderkey % 3 end as int) as away_score",
        f"o_orderkey as {ORD}",
    )


def _match_sql(left: bool) -> str:
    name = NAME.format("'League ' || o_orderkey % 4" if left else "upper('League  ' || o_orderkey % 4)")
    return f"""(select '{'StatsBomb' if left else 'Wyscout'}' as provider, cast(o_orderkey as varchar) as id, case when o_orderkey % 5 = 0 then null else {name} end as cname, case when o_orderkey % 8 = 1 then o_orderkey % 4 end as ccan,
      case when o_orderkey % 7 <> 0 then 'S' || o_orderkey % 6 end as sname, case when o_orderkey % 11 <> 0 then o_orderkey * 1000 + {'0' if left else '(o_orderkey % 5) * 200'} end as kickoff,
      case when o_custkey % 9 <> 0 then o_custkey end as home, case when o_custkey % 10 = 4 then o_custkey else o_custkey + 1 end as away, o_orderkey % 4 as hs,
      case when o_orderkey % 13 = 0 then null when o_orderkey % 17 = 0 then {'1' if left else '2'} else o_orderkey % 3 end as aws from orders)"""


def _compared_sql(pairs: str) -> str:
    return f"""pairs as ({pairs}), ev as (select l_id, r_id,
      case when l_ccan is not null and r_ccan is not null then case when l_ccan = r_ccan then 'agreeing' else 'conflicting' end when l_cname is null or r_cname is null then 'missing' when l_cname = r_cname then 'agreeing' else 'uncertain' end as competition,
      case when l_sname is null or r_sname is null then 'missing' when lower(l_sname) = lower(r_sname) then 'agreeing' else 'uncertain' end as season,
      case when l_kickoff is null or r_kickoff is null then 'missing' when abs(l_kickoff - r_kickoff) <= 300 then 'agreeing' when abs(l_kickoff - r_kickoff) <= 86400 then 'uncertain' else 'conflicting' end as kickoff,
      case when l_home is null or r_home is null then 'missing' when l_home = r_home and l_away = r_away and l_home = l_away then 'conflicting' when l_home = r_home then 'agreeing' else 'conflicting' end as home_team,
      case when l_away is null or r_away is null then 'missing' when l_home = r_home and l_away = r_away and l_home = l_away then 'conflicting' when l_away = r_away then 'agreeing' else 'conflicting' end as away_team,
      case when l_aws is null or r_aws is null then 'missing' when l_hs = r_hs and l_aws = r_aws then 'agreeing' else 'conflicting' end as score from pairs),
    sc as (select *, round({' + '.join(f"{w} * case {f} when 'agreeing' then 1.0 when 'uncertain' then 0.5 else 0.0 end" for f, w in cand.WEIGHTS)}, 6)::double as confidence from ev),
    fin as (select *, home_team = 'agreeing' and away_team = 'agreeing' and competition <> 'conflicting' and season <> 'conflicting' and kickoff <> 'conflicting' and score <> 'conflicting' and confidence >= 0.70 as is_candidate from sc)"""


_SIDES = ", ".join(f"{s}.{c} as {s}_{c}" for s in "lr" for c in ("id", "cname", "ccan", "sname", "kickoff", "home", "away", "hs", "aws"))
_STATUSES = ["l_id", "r_id", *cand.FIELDS, "confidence", "is_candidate"]


def _statuses(df: DataFrame) -> DataFrame:
    return df.select("l_id", "r_id", *[F.col(f"{f}.status").alias(f) for f in cand.FIELDS], F.round("confidence", 6).alias("confidence"), "is_candidate")


@query(f"with {_compared_sql(f'select {_SIDES} from {_match_sql(True)} l join {_match_sql(False)} r on l.id = r.id')} select {', '.join(_STATUSES)} from fin")
def r2_match_evidence(spark, sf):
    """All evidence of given pairs, candidates or not."""
    l, r = cand.side(_matches(spark, sf, True), "l"), cand.side(_matches(spark, sf, False), "r")
    return _statuses(cand.compared(l.join(r, F.col("l_id") == F.col("r_id"))))


@query(f"with {_compared_sql(f'select {_SIDES} from {_match_sql(True)} l cross join {_match_sql(False)} r')} select {', '.join(_STATUSES)} from fin where is_candidate")
def r3_match_candidates(spark, sf):
    """The SQL compares all matches with all."""
    return _statuses(cand.match_candidates(_matches(spark, sf, True), _matches(spark, sf, False)))


RANKED = "0.0::double" + "".join(f" + {w}::double * case {f} when 'agreeing' then 1.0::double when 'uncertain' then 0.5::double else 0.0::double end" for f, w in cand.WEIGHTS)


@query(f"with {_compared_sql(f'select {_SIDES} from {_match_sql(True)} l join {_match_sql(False)} r on l.home = r.home')} select l_id, r_id, row_number() over (order by {RANKED} desc, l_id, r_id) as id from fin where is_candidate")
def o2_j10_match_candidate_ids(spark, sf):
    """Ids follow the order of review."""
    found = cand.match_candidates(_matches(spark, sf, True), _matches(spark, sf, False))
    none = found.select(*cand.MATCH_KEYS, F.lit(0).cast("long").alias("id")).limit(0)
    return cand.upserted(found, none, cand.MATCH_KEYS, cand.match_order()).select("l_id", "r_id", "id")


@query(T_SQL + f""", c as (select pt.provider_id, ct.id as canonical_id from pt join ct on {NAME.format('pt.name')} = {NAME.format('ct.name')} where ct.status = 'active' and trim(pt.name) <> '' and not exists (select 1 from tm where tm.provider_id = pt.provider_id)),
    old as (select provider_id, canonical_id from c where canonical_id > 100000) select provider_id, canonical_id, (select count(*) from old) + 500 + row_number() over (order by provider_id, canonical_id) as id from c where canonical_id <= 100000""")
def o3_j10_entity_candidate_ids(spark, sf):
    """Candidates that are known keep their ids, the others follow the greatest."""
    found = cand.entity_candidates(*_team_tables(spark, sf))
    old = cand.numbered(found.where("canonical_id > 100000"), cand.entity_order(), spark.createDataFrame([(500,)], "id long"))
    return cand.upserted(found, old, cand.ENTITY_KEYS, cand.entity_order()).select("provider_id", "canonical_id", "id")


# ---- coverage and manifests ----

COVERED = (
    T_SQL
    + f""", byname as (select {NAME.format('name')} as k, list(id order by id) as ids, list(id order by id) filter (where status = 'active') as live from ct group by 1),
    c as (select pt.provider_id, pt.name, tm.canonical_id as mapped, e.name as m_name, e.status as m_status, trim(pt.name) = '' as noname, b.ids, coalesce(len(b.live), 0) as n_live, coalesce(len(b.ids), 0) as n_all, b.live from pt left join tm on tm.provider_id = pt.provider_id left join ct e on e.id = tm.canonical_id left join byname b on b.k = {NAME.format('pt.name')} and trim(pt.name) <> ''),
    cov as (select provider_id, name, noname, case when mapped is not null then case when m_status = 'active' then 'mapped_active' else 'mapped_inactive' end when noname then 'missing_name' when n_live = 1 then 'exact_match' when n_live > 1 then 'ambiguous_exact_match' when n_all > 0 then 'inactive_exact_match' else 'no_exact_match' end as outcome,
      case when mapped is not null then cast(mapped as varchar) when noname then '' when n_live > 0 then array_to_string(live, ',') else coalesce(array_to_string(ids, ','), '') end as canonical_ids,
      case when noname then 'missing' when mapped is not null then case when {NAME.format('name')} = {NAME.format('m_name')} then 'agreeing' else 'conflicting' end when n_all > 0 then 'agreeing' else 'missing' end as name_status, 'not_applicable' as context_status from c) """
)


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.coverage(*_team_tables(spark, sf_dir))


@query(COVERED + "select provider_id, outcome, canonical_ids, name_status, context_status from cov")
def r4_coverage_records(spark, sf):
    return _covered(spark, sf).select("provider_id", "outcome", F.array_join(F.col("canonical_ids").cast("array<string>"), ",").alias("canonical_ids"), "name_status", "context_status")


@query(
    COVERED
    + """select count(*) as provider_records, count(*) filter (where outcome = 'mapped_active') as mapped_active, count(*) filter (where outcome = 'mapped_inactive') as mapped_inactive, count(*) filter (where outcome = 'exact_match') as unmapped_exact_matches,
    count(*) filter (where outcome = 'ambiguous_exact_match') as ambiguous_exact_matches, count(*) filter (where outcome = 'inactive_exact_match') as inactive_exact_matches, count(*) filter (where outcome = 'no_exact_match') as no_exact_matches, count(*) filter (where noname) as missing_names,
    count(*) filter (where outcome in ('mapped_active', 'mapped_inactive') and name_status = 'conflicting') as mapped_name_mismatches, 0::bigint as parent_context_missing, 0::bigint as parent_context_conflicts, 0::bigint as parent_context_inactive from cov"""
)
def a16_coverage_summary(spark, sf):
    return cov.summary(_covered(spark, sf))


@query(
    f"""with {SEASONS}, cc as (select r_regionkey + 1 as id, case when r_regionkey = 4 then 'deprecated' else 'active' end as status from region),
    j as (select ps.provider_id, lower(ps.name) as k, cm.canonical_id as parent, cc.status as pstatus, sm.canonical_id as mapped, e.name as m_name, e.status as m_status, e.competition_id as m_parent, x.id as xid, x.status as xstatus, x.competition_id as xparent from ps left join cm on cm.provider_id = ps.parent left join cc on cc.id = cm.canonical_id left join sm on sm.provider_id = ps.provider_id left join cs e on e.id = sm.canonical_id left join cs x on x.name = lower(ps.name)),
    f as (select *, xid is not null and parent is not null and pstatus = 'active' and xparent <> parent as conflict, xid is not null and (parent is null or xparent = parent) as kept from j)
    select provider_id, case when mapped is not null then case when m_status = 'active' then 'mapped_active' else 'mapped_inactive' end when conflict then 'no_exact_match' when kept and xstatus = 'active' then 'exact_match' when kept then 'inactive_exact_match' else 'no_exact_match' end as outcome,
      case when mapped is not null then cast(mapped as varchar) when conflict or kept then cast(xid as varchar) else '' end as canonical_ids,
      case when mapped is not null then case when k = m_name then 'agreeing' else 'conflicting' end when conflict or kept then 'agreeing' else 'missing' end as name_status,
      case when parent is null then 'missing' when pstatus <> 'active' then 'inactive' when mapped is not null then case when m_parent = parent then 'agreeing' else 'conflicting' end when conflict then 'conflicting' else 'agreeing' end as context_status from f"""
)
def r4_coverage_seasons(spark, sf):
    records, seasons, competition_mappings, mapped = _season_tables(spark, sf)
    competitions = table(spark, sf, "region").select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.when(F.col("r_regionkey") == 4, "deprecated").otherwise("active").alias("status"))
    out = cov.coverage(records, seasons, mapped, competitions, competition_mappings)
    return out.select("provider_id", "outcome", F.array_join(F.col("canonical_ids").cast("array<string>"), ",").alias("canonical_ids"), "name_status", "context_status")


@query(COVERED + "select row_number() over (order by provider_id) - 1 as place, provider_id, outcome from cov")
def o4_coverage_order(spark, sf):
    return positions(cov.ordered(_covered(spark, sf)).select("provider_id", "outcome"), "place")


from . import suite_catalog, suite_sources  # noqa: E402, F401 - their queries register themselves
