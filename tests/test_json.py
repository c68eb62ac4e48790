"""JSON files: lists, objects that hold lists, single records, mixed types."""

import json

import pytest

from clearbrook.sources.tables import read_json


@pytest.mark.parametrize(
    "given,want",
    [
        ([{"id": 1, "tags": ["a", "b", "c"]}], [{"id": 1, "tags": '["a","b","c"]'}]),
        ([{"id": 1, "tags": ["a"]}, {"id": 2, "tags": []}], [{"id": 1, "tags": '["a"]'}, {"id": 2, "tags": "[]"}]),
        ({"b": [1, 2], "rows": [{"x": 1}, {"x": 2.5}, {"x": None}]}, [{"x": 1.0}, {"x": 2.5}, {"x": None}]),
        ({"z": [{"x": "first"}], "a": [{"x": "second"}]}, [{"x": "first"}]),
        ({"id": 7, "of": {"k": "v"}}, [{"id": 7, "of": '{"k":"v"}'}]),
        ([{"id": 1}, {"id": "A-2", "y": True}], [{"id": "1", "y": None}, {"id": "A-2", "y": True}]),
        ([3, 1], [{"value": 3}, {"value": 1}]),
    ],
)
def test_records_of_a_file(spark, tmp_path, given, want):
    (tmp_path / "t.json").write_text(json.dumps(given, indent=1))
    got = [r.asDict() for r in read_json(spark, str(tmp_path / "t.json")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_one_file_is_dealt_over_tasks(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"rows": [{"i": i, "s": {"n": [i]}} for i in range(5000)]}))
    df = read_json(spark, str(tmp_path / "t.json"))
    assert df.count() == 5000 and df.rdd.getNumPartitions() > 1 and df.agg({"i": "sum"}).first()[0] == sum(range(5000)) and df.where("i = 7").first().s == '{"n":[7]}'
    (tmp_path / "e.json").write_text("[]")
    with pytest.raises(ValueError, match="empty"):
        read_json(spark, str(tmp_path / "e.json"))
