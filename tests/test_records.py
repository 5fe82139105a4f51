"""Strict decoding, and tables that are rewritten by bucket."""

import os

from pyspark.sql import functions as F

from colloquy.operators import incremental
from colloquy.sources import records


def test_decode_lines(spark):
    good = '{"rowid":9007199254740993,"guid":"g","is_from_me":true,"extra":1,"attachment_rowids":[1,2],"edit_history":[{"text":"a","edited_at":null}],"tapback":{"kind":"loved","target_guid":"t"}}'
    plain = '{"rowid":1,"guid":"g","tapback":null,"attachment_rowids":null,"service":null}'
    bad = {
        '{"rowid":1': "not_json", "": "not_json", None: "not_json", "[1]": "not_object", "3": "not_object", "null": "not_object", '{"guid":"g"}': "missing:rowid", '{"rowid":1}': "missing:guid",
        '{"rowid":"1","guid":"g"}': "type:rowid", '{"rowid":1.5,"guid":"g"}': "type:rowid", '{"rowid":1,"guid":null}': "type:guid", '{"rowid":1,"guid":"g","date":5}': "type:date", '{"rowid":1,"guid":"g","is_from_me":"yes"}': "type:is_from_me",
        '{"rowid":1,"guid":"g","tapback":[]}': "type:tapback", '{"rowid":1,"guid":"g","tapback":{"kind":1,"target_guid":"t"}}': "type:tapback.kind", '{"rowid":1,"guid":"g","tapback":{"kind":"x"}}': "type:tapback.target_guid",
        '{"rowid":1,"guid":"g","tapback":{"kind":"x","target_guid":"t","emoji":7}}': "type:tapback.emoji", '{"rowid":1,"guid":"g","tapback":{"kind":"x","target_guid":"t","action":"zap"}}': "tapback_action",
        '{"rowid":1,"guid":"g","edit_history":[1]}': "type:edit_history", '{"rowid":1,"guid":"g","edit_history":{}}': "type:edit_history", '{"rowid":1,"guid":"g","attachment_rowids":["x"]}': "type:attachment_rowids",
    }
    lines = spark.createDataFrame([(x,) for x in [good, plain, *bad]], "line string")
    done = {r["line"]: r for r in records.decode_lines(lines).collect()}
    assert {x: done[x]["problem"] for x in bad} == bad and all(done[x]["guid"] is None and done[x]["service"] is None for x in bad)
    first, second = done[good], done[plain]
    assert (first["rowid"], first["guid"], first["is_from_me"], first["unknown_fields"], first["problem"]) == (9007199254740993, "g", True, ["extra"], None)
    assert first["attachment_rowids"] == [1, 2] and first["edit_history"][0]["text"] == "a" and first["tapback"].asDict() == {"kind": "loved", "emoji": None, "action": "added", "target_guid": "t"}
    assert (second["service"], second["attachment_rowids"], second["edit_history"], second["tapback"], second["is_from_me"]) == ("unknown", [], [], None, False)
    kept, refused = records.quarantined(records.decode_lines(lines, refuse_unknown=True))
    assert kept.columns[0] == "rowid" and kept.count() == 1 and refused.count() == len(bad) + 1
    assert refused.where("problem = 'unknown:extra'").count() == 1
    assert records.decode_lines(lines.limit(0)).count() == 0


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_upsert_rewrites_what_changes(spark, tmp_path):
    rows = [(i, f"n{i}", "x", 0) for i in range(200)] + [(None, "nobody", "x", 0)]
    schema = "id long, name string, note string, updated_at int"
    table = incremental.create_buckets(spark.createDataFrame(rows, schema), str(tmp_path / "t"), ["id"], 8)
    before = files(tmp_path / "t")
    same = spark.createDataFrame([(3, "n3", "other"), (None, "nobody", "y")], "id long, name string, note string")
    assert incremental.upsert_buckets(table, same, ["name"], now=F.lit(1)) == 0 and files(tmp_path / "t") == before
    more = spark.createDataFrame([(3, "new", "z"), (5, "n5", "z"), (1000, "n1000", "z")], "id long, name string, note string")
    assert incremental.upsert_buckets(table, more, ["name"], now=F.lit(1)) in (1, 2)
    want = {i: (name, note, at) for i, name, note, at in rows} | {3: ("new", "x", 1), 1000: ("n1000", "z", 1)}
    assert {r["id"]: (r["name"], r["note"], r["updated_at"]) for r in table.rows.collect()} == want
    after = files(tmp_path / "t")
    assert before & after and len({os.path.dirname(f) for f in before - after}) <= 2
    assert incremental.upsert_buckets(table, more.limit(0), ["name"]) == 0
