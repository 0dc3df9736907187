import json

from assaylake.sources.strict import extent, read_document, strict_documents

FIELDS = {"": {"id": True, "records": True, "more": False}, "records[]": {"case_id": True, "role": True, "payload": True}}


def read(text):
    return read_document(text, FIELDS, "records", "case_id", "role", ("BLIND",))


def test_sound_document():
    record = {"case_id": "a", "role": "FIT", "payload": {"x": [1, -2.5e3, "é\"}"], "y": None}}
    faults, found = read("﻿" + json.dumps({"id": 1, "records": [record]}, indent=1))
    assert faults == [] and json.loads(found[0]["record"]) == record and found[0]["decoded"] == 6


def test_every_fault_has_a_path():
    text = '{"id":1,"id":2,"odd":0,"records":[{"case_id":"a","role":"FIT","payload":{"x":NaN,"y":1,"y":[Infinity]},"z":1},{"case_id":"b","role":"FIT"},7]}'
    faults, found = read(text)
    assert faults == [("REPEATED_KEY", "id"), ("UNKNOWN_FIELD", "odd"), ("UNKNOWN_FIELD", "records[0].z"), ("REPEATED_KEY", "records[0].payload.y"), ("NON_FINITE", "records[0].payload.x"), ("NON_FINITE", "records[0].payload.y[0]"), ("MISSING_FIELD", "records[1].payload"), ("NOT_A_RECORD", "records[2]")]
    assert [f["record"] for f in found] == [None, None]


def test_payload_of_sealed_records_is_not_decoded():
    """What a sealed payload holds can't be told from the outside: neither its faults nor that it isn't JSON at all."""
    for payload in ('{"x":NaN,"x":1}', "[nonsense, 1e999]", '"}]"'):
        faults, found = read('{"id":1,"records":[{"payload":%s,"case_id":"a","role":"BLIND"}]}' % payload)
        assert faults == [] and found == [{"position": 0, "identity": "a", "record": None, "decoded": 2, "skipped": len(payload)}]
    faults, found = read('{"id":1,"records":[{"case_id":"a","role":"BLIND","role":"FIT","payload":NaN}]}')
    assert faults == [("REPEATED_KEY", "records[0].role")] and found[0]["skipped"] == 3


def test_malformed():
    for text in ("", "[]", "{", '{"id":1,"records":[}', '{"id" 1}', '{"id":1,"records":[]} x', '{"id":tru,"records":[]}', '{"id":"a\nb","records":[]}', '{"records":{}, "id":1}'):
        faults, found = read(text)
        assert faults[-1] == ("MALFORMED", "") and not found, text


def test_extent_of_long_and_deep_values():
    deep = "[" * 50_000 + "]" * 50_000
    assert extent(deep, 0) == 100_000 and extent('"' + 'a\\"' * 100_000 + '"', 0) == 300_002


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id":1,"records":[{"case_id":"a","role":"FIT","payload":1}]}')
    (tmp_path / "b.json").write_bytes(b'{"id":"\xff","records":[]}')
    (tmp_path / "it's").mkdir()
    (tmp_path / "it's" / "c.json").write_text('{"records":[]}')
    rows = strict_documents(spark, str(tmp_path), FIELDS).collect()
    assert sorted((r["source"].rsplit("/", 1)[1], r["kind"], r["path"], r["fault"], r["sound"]) for r in rows) == [("a.json", "RECORD", "records[0]", None, True), ("b.json", "FAULT", "", "MALFORMED", False), ("c.json", "FAULT", "id", "MISSING_FIELD", False)]
