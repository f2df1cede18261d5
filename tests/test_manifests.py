import json

from textwarden.operators.manifests import manifest_commands, manifest_features, menu_contributions

MANIFEST = {
    "contributes": {
        "commands": [{"command": "a", "title": "A"}, {"command": "b", "title": "B"}, {"command": "a", "title": "A2"}],
        "menus": {
            "z": [{"command": "a", "when": "w1", "group": "g1"}, {"command": "new", "when": "n"}],
            "m": [{"command": "a", "when": "w2"}, {"command": "new", "group": "late"}],
        },
        "configuration": {},
    }
}


def test_inventory(spark):
    rows = [("r", json.dumps(MANIFEST)), ("bad", "{"), ("none", "{}"),
            ("off", json.dumps({"contributes": {"configuration": None}}))]
    df = spark.createDataFrame(rows, "repo_id STRING, manifest STRING")
    got = {(r.title, r.command, r.when, r.group, r.added) for r in manifest_commands(df).collect()}
    assert got == {
        ("A", "a", "w2", None, False), ("B", "b", None, None, False), ("A2", "a", None, None, False),
        ("new", "new", None, "late", True),
    }
    menus = menu_contributions(df).orderBy("menu_pos").collect()
    assert [m.location for m in menus] == ["z", "m"] and json.loads(menus[0]["items"])[1] == {"command": "new", "when": "n"}
    features = [(r.type, r.name) for r in manifest_features(df).collect()]
    assert sorted(features) == sorted([
        ("command", "a"), ("command", "b"), ("command", "a"), ("command", "new"), ("menu", "Menu: z"),
        ("menu", "Menu: m"), ("configuration", "Extension Configuration"),
    ])
