"""Context feeds from small bodies; bodies that are empty, broken or of another kind give no rows."""

from __future__ import annotations

import json

import pytest

from headcast.sources import feeds

BAD = [None, "", "not json", "{}", "[]", '{"entity": null}']


def bodies(spark, *made):
    rows = [(i, json.dumps(b)) for i, b in enumerate(made)] + [(100 + i, b) for i, b in enumerate(BAD)]
    return spark.createDataFrame(rows, "poll_id long, body string")


CASES = {
    "vehicle_positions": ({"entity": [{"id": "e", "vehicle": {"trip": {"route_id": "Red"}, "vehicle": {"id": "7"}, "position": {"latitude": 41.9}, "current_status": "STOPPED_AT", "timestamp": 1767254400}}, {"id": "x"}]}, {"vehicle": "7", "line": "Red", "lat": 41.9, "status": "stopped_at"}),
    "realtime_alerts": ({"entity": {"id": "a", "alert": {"cause": "MAINTENANCE", "header_text": {"translation": [{"text": "hello"}, {"text": "hola"}]}, "active_period": [{"start": 1}]}}}, {"alert_id": "a", "cause": "maintenance", "header": "hello"}),
    "service_alerts": ({"CTAAlerts": {"Alert": {"AlertId": "9", "Headline": "h", "ShortDescription": {"#cdata-section": "wrapped"}, "SeverityScore": "25", "MajorAlert": "1", "ImpactedService": {"Service": []}}}}, {"alert_id": "9", "headline": "h", "description": "wrapped", "severity": 25, "major": True}),
    "weather": ({"current": {"time": "2026-01-01T08:00", "temperature_2m": -3.5, "weather_code": 71}}, {"temperature": -3.5, "code": 71}),
    "air_quality": ([{"DateForecast": "2026-01-02 ", "ParameterName": "PM2.5", "AQI": 51, "Category": {"Number": 2}, "ActionDay": False}], {"is_forecast": True, "aqi": 51, "category": 2, "action_day": False}),
    "sports_events": ({"events": [{"id": "1", "date": "2026-01-01T20:00Z", "status": {"type": {"state": "post", "completed": True}}, "competitions": [{"competitors": [{"homeAway": "away", "score": "3", "team": {"displayName": "B"}}, {"homeAway": "home", "score": "5", "team": {"displayName": "A"}}]}]}]}, {"home": "A", "away": "B", "home_score": 5, "completed": True}),
    "venue_events": ({"_embedded": {"events": [{"id": "v", "name": "show", "_embedded": {"venues": [{"name": "hall"}]}, "classifications": [{"segment": {"name": "Music"}}]}]}}, {"event_id": "v", "venue": "hall", "kind": "Music"}),
    "social_posts": ({"statuses": [{"id": "s", "account": {"acct": "me"}, "content": "<p>late</p>", "created_at": "2026-01-01T08:00:00.000Z"}]}, {"network": "b", "author": "me", "text": "late"}),
    "traffic": ([{"segmentid": "4", "street": "Main", "_traffic": "-1", "_last_updt": "2026-01-01 08:00:00.0"}], {"kind": "segment", "place_id": "4", "name": "Main", "speed_mph": None}),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_feed(spark, name):
    body, want = CASES[name]
    rows = getattr(feeds, name)(bodies(spark, body)).collect()
    assert len(rows) == 1 and rows[0].poll_id == 0
    assert {k: rows[0][k] for k in want} == want


def test_open_data_and_catalogue(spark):
    rows = feeds.open_data(bodies(spark, [{"id": "a", "v": 1}, {"v": 2}])).collect()
    assert len(rows) == 2 and rows[0].record_id == "a" and len(rows[1].record_id) == 64 and json.loads(rows[0].record) == {"id": "a", "v": 1}
    stations = spark.createDataFrame([(2, "Main", ["Red", "Blue"]), (1, "Main", ["Red"]), (3, "Oak", [])], "map_id int, name string, served_lines array<string>")
    made = feeds.station_catalogue(stations)
    assert made["by_line"].count() == 3 and {r.name: r.map_id for r in made["by_name"].collect()} == {"Main": 1, "Oak": 3}
