import gzip
import json

from loggrove.sources import cloudtrail, records


def pieces(text, n):
    return [text[i:i + n] for i in range(0, len(text), n)]


def test_elements_in_pieces_of_any_size():
    values = [{"a": 'x ] } "Records": [ \\ "'}, {"n": [1, {"Records": 2}]}, {}, None, {"long": "y" * 500}]
    text = json.dumps({"head": 'a "Records" of [', "Records": values}, indent=1) + "\n" + json.dumps({"Records": []}) + json.dumps({"Records": values[:2]})
    for n in (1, 2, 7, 100, 10_000):
        assert [json.loads(e) for e in records.elements(pieces(text, n))] == values + values[:2]
    assert list(records.elements([])) == list(records.elements(["{}"])) == []
    assert list(records.elements(['{"Records": [{"a": 1}, {"b": '])) == ['{"a": 1}']
    assert list(records.elements(['{"Records": [{"a": 1}, oops, {"b": 2}]}'])) == ['{"a": 1}']


def test_gzip_is_told_by_content(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "BATCH", 100)
    document = lambda name, n: json.dumps({"Records": [{"eventName": name, "eventID": str(i)} for i in range(n)]}).encode()
    (tmp_path / "a.json").write_bytes(gzip.compress(document("packed", 3)))  # misnamed both ways
    (tmp_path / "b.json.gz").write_bytes(document("plain", 2))
    (tmp_path / "c.json.gz").write_bytes(gzip.compress(document("first", 1)) + gzip.compress(document("second", 1)))
    (tmp_path / "d.json").write_bytes(document("many", 20_000))
    (tmp_path / "e.json").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(document("hidden", 1))
    found = cloudtrail.read_records(spark, str(tmp_path)).selectExpr("arrival_seq", "record.eventName AS name", "record.eventID AS id").collect()
    counts = {}
    for r in found:
        counts[r["name"]] = counts.get(r["name"], 0) + 1
        assert r["name"] == "second" or r["arrival_seq"] == int(r["id"])
    assert counts == {"packed": 3, "plain": 2, "first": 1, "second": 1, "many": 20_000}
