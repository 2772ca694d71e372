from tests.test_queries import event

from touchline.plans.language import event_query
from touchline.schema import EVENT_SCHEMA_ORD
from touchline.streaming.events import read_events, resolved, select_events, sound_and_broken


def test_stream_equals_batch(spark, tmp_path):
    rows = [event(0), event(1, match_id=0), event(2, event_type="Shot", team_id=9)]
    frame = spark.createDataFrame([tuple(r[f.name] for f in EVENT_SCHEMA_ORD) for r in rows], EVENT_SCHEMA_ORD)
    frame.write.parquet(str(tmp_path / "in"))
    good, bad = sound_and_broken(read_events(spark, str(tmp_path / "in")))
    mapping = spark.createDataFrame([("P", "9", None, 90)], "provider string, provider_id string, provider_match_id string, canonical_id long")

    def drain(df, name):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return [tuple(r) for r in spark.table(name).collect()]

    assert drain(bad.select("provider_event_id", "error"), "bad") == [("e1", "match_id must be positive")]
    assert drain(select_events(good, event_query("provider_event_id", ["event_type=Shot"])), "shots") == [("e2",)]
    named = resolved(good, mapping.limit(0), mapping, mapping.limit(0)).select("provider_event_id", "canonical_team_id")
    assert sorted(drain(named, "named")) == [("e0", None), ("e2", 90)]
