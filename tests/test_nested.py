import json

from quire.operators import nested
from quire.operators.nested import Rule

RULES = [Rule("s", "", ("xs", "*?")), Rule("c", "s", ("in?", "cols", "*")), Rule("c", "c", ("children", "*")), Rule("e", "s", ("one",))]


def test_shred_paths_hashes_and_odd_bodies(spark):
    leaf = {"n": 1, "children": [None, "bare", {"n": 2}]}
    body = {"xs": [None, {"in": {"cols": [leaf, leaf]}}, json.dumps({"in": json.dumps({"cols": {"k": leaf}}), "one": {"m": 1}}), "plain", {"in": None, "one": [1]}], "ys": [{"cols": [{"n": 9}]}]}
    rows = [("r1", json.dumps(body), "x"), ("r1", json.dumps(body), "x"), ("r2", "{", "x"), ("r3", None, "x"), ("r4", "[]", "x"), (None, json.dumps(body), "x"), ("r5", "{}", "x"), ("r6", json.dumps({"xs": [{"one": {"m": 1}}]}), "x")]
    df = spark.createDataFrame(rows, "record_id string, body string, node_path string")
    s = nested.shred(df, "record_id", "body", RULES)
    occ = nested.occurrences(s).collect()
    by = {(r["record_id"], r["node_path"]): r for r in occ}
    assert len(by) == len(occ)
    assert {p for (r, p), x in by.items() if r == "r1" and x["node_kind"] != nested.INNER} == {"xs[1]", "xs[1].in.cols[0]", "xs[1].in.cols[1]", "xs[1].in.cols[0].children[2]", "xs[1].in.cols[1].children[2]", "xs[2]", "xs[2].in.cols.k", "xs[2].in.cols.k.children[2]", "xs[2].one", "xs[4]"}
    assert by["r1", "xs[1].in.cols[0].children[2]"]["parent_path"] == "xs[1].in.cols[0]" and by["r1", "xs[2]"]["parent_path"] == ""
    assert by["r1", "xs[1].in.cols[0]"]["node_hash"] == by["r1", "xs[2].in.cols.k"]["node_hash"]
    assert by["r6", "xs[0].one"]["node_hash"] == by["r1", "xs[2].one"]["node_hash"]
    objects = {r["node_hash"]: json.loads(r["content"]) for r in nested.objects(s).collect()}
    assert {r["node_hash"] for r in occ} == set(objects)

    def whole(o):  # the stored objects put together again
        if isinstance(o, dict):
            return whole(objects[o["$"]]) if set(o) == {"$"} else {k: whole(v) for k, v in o.items()}
        return [whole(v) for v in o] if isinstance(o, list) else o

    assert whole(objects[by["r1", "xs[1]"]["node_hash"]]) == body["xs"][1]
    assert by["r1", "xs[1].in"]["parent_path"] == "xs[1]" and by["r1", "xs[1].in"]["parent_hash"] == by["r1", "xs[1]"]["node_hash"]
    flat = nested.shred(df, "record_id", "body", RULES, inline=True)
    assert nested.flat(flat, "c", {"n": "$.n"}).count() == 6 and not flat.filter(flat.node_kind == nested.INNER).count()
    assert {(r["record_id"], r["node_path"]): r["node_hash"] for r in flat.collect()} == {k: r["node_hash"] for k, r in by.items() if r["node_kind"] != nested.INNER}
    again = {(r["record_id"], r["node_path"]): r for r in nested.rebuilt(nested.objects(s), nested.occurrences(s)).collect()}
    assert json.loads(again["r1", "xs[1]"]["json"]) == body["xs"][1] and json.loads(again["r1", "xs[2]"]["json"]) == json.loads(body["xs"][2]) and again["r1", "xs[4]"]["leaves"] == 2
    assert nested.shred(spark.createDataFrame([], "record_id string, body string"), "record_id", "body", RULES).count() == 0


def test_deep_nesting_does_not_crash(spark):
    deep = '{"xs": [{"in": {"cols": [' + '{"children": [' * 800 + "{}" + "]}" * 800 + "]}}]}"
    too_deep = "[" * 200_000
    df = spark.createDataFrame([("a", deep), ("b", too_deep)], "id string, body string")
    assert nested.occurrences(nested.shred(df, "id", "body", RULES)).count() >= 0
