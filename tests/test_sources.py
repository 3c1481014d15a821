import json

import pytest
from pyspark.sql import functions as F

from mnemospark import schemas
from mnemospark.sources import generations as G
from mnemospark.sources import jsonl as J
from mnemospark.sources import reports as R

PERSONA = {
    "ID": "p1",
    "Full_Session_Chain": [
        {"Session_ID": 0, "Date": "2022-01-03", "Session_Type": "initial", "Session_Dialogue": {"dialogue_turn_2": [{"role": "user", "content": "second"}], "dialogue_turn_10": [{"role": "user", "content": "tenth"}], "dialogue_turn_1": [{"role": "user", "content": "I live in Darwin."}, {"role": "assistant", "content": "Noted."}]},
         "Static_Conflict_Information": [{"Conflict_ID": "c", "Role": "Point_A", "Value": "x"}, {"Conflict_ID": "c", "Role": "Distractor", "Value": "y"}]},
        {"Session_ID": 1, "Date": "2022-02-25", "Session_Questions": [{"question_id": "Q_001", "question": "Where?", "answer": "Melbourne", "conflict_type": "dynamic_conflict"}], "Updated_Attributes": [{"Attribute": "Residence", "Before": "Darwin", "After": "Melbourne"}],
         "Static_Conflict_Information": [{"Conflict_ID": "c", "Role": "Point_B", "Value": "z"}]},
    ],
}


def test_personas(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text(json.dumps(PERSONA) + "\n\n" + json.dumps({"ID": "p2"}) + "\n")
    p = J.read_personas(spark, str(tmp_path / "p.jsonl"))
    assert p.where("ID IS NOT NULL").count() == 2 and [r.ID for r in J.positions(p, 1, 2).collect()] == ["p2"]
    s = J.sessions(p).cache()
    assert [r.content for r in J.turns(s).orderBy("session", "turn").collect()] == ["I live in Darwin.", "Noted.", "second", "tenth"]
    assert [(r.session, r.question_id, r.answer) for r in J.session_questions(s).collect()] == [(1, "Q_001", "Melbourne")]
    assert {r.session: r.removed for r in J.without_distractors(s).collect()} == {0: 1, 1: 0}
    assert {r.session: r.triggers for r in J.triggers(s).collect()} == {0: [], 1: ["dynamic_conflict", "static_conflict"]}


def test_bad_line_fails(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"ID": "a"}\n{"ID": \n')
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILFAST"):
        J.read_lines(spark, str(tmp_path / "bad.jsonl"), "ID string").collect()


def test_dialogue_files(spark, tmp_path):
    keyed = {"session_2": [{"speaker": "Bo", "text": "until then", "dia_id": "D2:1"}, "a bare line"], "session_10": [], "session_1": [{"speaker": "Ann", "text": " look ", "blip_caption": "a red kite", "query": "kite"}], "session_1_date_time": "9:15 am on 2 June, 2021", "speaker_a": "Ann"}
    examples = [{"sample_id": "keyed", "conversation": keyed}, {"sample_id": "list", "messages": [{"role": "user", "content": "one", "time": "noon", "turn_id": 7}, {"role": "agent", "message": "two"}]}, {"sample_id": "nested", "sessions": [{"turns": [{"speaker": "Cy", "text": "x"}], "timestamp": "t"}, [{"text": "y"}]]}, {"sample_id": "none"}]
    (tmp_path / "d.json").write_text(json.dumps(examples))
    got = [tuple(r) for r in J.dialogue_files(spark, str(tmp_path / "d.json")).orderBy("conversation", "session", "place").collect()]
    assert got == [
        ("keyed", 1, "9:15 am on 2 June, 2021", 0, "1", "Ann", "Ann", "look Image caption: a red kite Image query: kite"),
        ("keyed", 2, None, 0, "D2:1", "Bo", "Bo", "until then"), ("keyed", 2, None, 1, "2", "unknown", "unknown", "a bare line"),
        ("list", 0, "noon", 0, "7", "user", "user", "one"), ("list", 0, None, 1, "2", "agent", "agent", "two"),
        ("nested", 0, "t", 0, "1", "Cy", "Cy", "x"), ("nested", 1, None, 0, "1", "unknown", "unknown", "y"),
    ]


def test_flat_turns(spark, tmp_path):
    lines = [{"id": "a", "turns": [{"role": "user", "content": "p"}, "q"]}, {"id": "b", "conversation": [{"session_id": 4, "timestamp": "t", "turns": [{"text": "r"}]}]}, {"id": "c", "content": "alone", "role": "user"}]
    (tmp_path / "f.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = sorted((r.conversation, r.session, r.when, r.place, r.role, r.text) for r in J.flat_turns(spark, str(tmp_path / "f.jsonl")).collect())
    assert got == [("a", 0, None, 0, "user", "p"), ("a", 0, None, 1, "unknown", "q"), ("b", 4, "t", 0, "unknown", "r"), ("c", 0, None, 0, "user", "alone")]


def test_generations(spark, tmp_path):
    store = G.Generations(spark, str(tmp_path / "store"))
    chains = spark.createDataFrame([("c1", "s", "t", "")], schemas.CHAIN)
    nodes = spark.createDataFrame([(f"n{i}", "s", "c1", "event", "x", [], None, None, None, None, 1.0, 1.0, "{}") for i in range(3)], schemas.NODE)
    edges = spark.createDataFrame([("e1", "s", "n0", "n1", "CAUSES", "explicit", 1.0)], schemas.EDGE)
    with pytest.raises(LookupError):
        store.read("nodes")
    assert store.publish({"chains": chains, "nodes": nodes, "edges": edges}, 0) == 1 and store.ready()
    with pytest.raises(G.Conflict):
        store.publish({"nodes": nodes, "chains": chains}, 0)
    lost = edges.withColumn("target", F.lit("gone"))
    with pytest.raises(ValueError, match="edges without a target"):
        store.publish({"chains": chains, "nodes": nodes, "edges": lost}, 1)
    assert store.read("nodes").count() == 3
    more = G.upsert(store.read("nodes"), nodes.where("id = 'n0'").withColumn("text", F.lit("new")).unionByName(nodes.where("id = 'n1'").withColumn("id", F.lit("n9"))), ["id"])
    assert store.publish({"chains": chains, "nodes": more, "edges": edges}, 1) == 2 and store.clean() == 1
    assert {r.id: r.text for r in store.read("nodes").collect()} == {"n0": "new", "n1": "x", "n2": "x", "n9": "x"}


def test_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    J.write_lines(df, str(tmp_path / "out"))
    J.write_lines(df, str(tmp_path / "out"), append=True)
    assert J.read_lines(spark, str(tmp_path / "out"), "x int, y string").count() == 4
    J.write_report(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_publishers_race(spark, tmp_path):
    chains = spark.createDataFrame([("c1", "s", "t", "")], schemas.CHAIN)
    store = G.Generations(spark, str(tmp_path / "race"))
    assert store.publish({"chains": chains}, 0, {"model": {"name": "x", "api_key_env": "KEY"}}) == 1
    other = G.Generations(spark, str(tmp_path / "race"))
    other.manifest = lambda: {"revision": 0}  # read before the first was done
    with pytest.raises(G.Conflict, match="meanwhile"):
        other.publish({"chains": chains}, 0)
    assert store.manifest()["config"] == {"model": {"name": "x", "api_key_env": "KEY"}} and store.ready() and store.clean() == 0
    with pytest.raises(ValueError, match="config.a.0.api-key"):
        store.publish({"chains": chains}, 1, {"a": [{"api-key": "s3cret"}]})
    copy = store.snapshot(str(tmp_path / "copy"))
    assert copy.ready() and copy.read("chains").count() == 1
    with pytest.raises(Exception, match="exist|store already"):
        store.snapshot(str(tmp_path / "copy"))


def test_vectors(spark, tmp_path):
    v = spark.createDataFrame([("n0", [3.0, 4.0]), ("n1", [0.0, 0.0]), ("n2", [float("nan"), 1.0]), ("n3", None), ("n4", [])], "id string, v array<double>")
    assert [(r.id, r.v) for r in G.unit_vectors(v).collect()] == [("n0", [0.6, 0.8])]
    assert G.broken({"vectors": v}) == {"bad vectors": 4}
    ragged = spark.createDataFrame([("n0", [1.0]), ("n1", [1.0, 0.0])], "id string, v array<double>")
    assert G.broken({"vectors": ragged}) == {"bad vectors": 1}
    store = G.Generations(spark, str(tmp_path / "v"))
    assert store.publish({"vectors": G.unit_vectors(v)}, 0) == 1 and store.read("vectors").count() == 1


def test_replace_derived(spark):
    old = spark.createDataFrame([("e1", "a", 1), ("e2", "a", 2), ("e3", "b", 3), ("e4", "c", 4)], "id string, chain_id string, n int")
    new = spark.createDataFrame([("e1", "a", 10), ("e4", "a", 40)], "id string, chain_id string, n int")
    got = G.replace_derived(old, new, "id", spark.createDataFrame([("a",)], "chain_id string"))
    assert sorted(map(tuple, got.collect())) == [("e1", "a", 10), ("e3", "b", 3), ("e4", "a", 40)]


def test_markdown(spark):
    rows = [("dynamic_conflict", 3, 2, 0.5, 1.0, 0.75, 0.5), ("static_conflict", 3, 0, None, None, None, None), ("conditional_conflict", 3, 1, 1.0, 0.0, 0.0, None)]
    m = spark.createDataFrame(rows, "conflict_type string, k int, n long, aa double, seh double, srs double, ch double")
    assert R.metric_table(m, 3, 3, "ours").split("\n")[2] == "| ours | 0.5000 | 1.0000 | – | – | 1.0000 | 0.0000 | 0.7500 |"
    assert R.metric_table(m, 5, 3, "o|s").split("\n")[0] == "| Method | Dynamic AA↑ | Dynamic UOCS↑ | Static AA↑ | Static CRS↑ | Conditional AA↑ | Average AA↑ |"
    assert R.metric_table(m, 6, 3, "ours").endswith("| 0.5000 | 0.3750 |") and R.by_k_table(m, "ours").count("\n") == 4


def test_recorded_calls(spark, tmp_path):
    def model(text):
        if text == "bad":
            raise ValueError("no")
        return text.upper(), len(text), 1

    R_ = R.recorded(spark.createDataFrame([("hello",), ("bad",)], "q string"), "q", model, "m", "p", "x")
    J.write_lines(R_, str(tmp_path / "log"), append=True)
    got = {r.request: (r.response, r.prompt_tokens, r.success, r.error) for r in J.read_lines(spark, str(tmp_path / "log"), R.CALL).collect()}
    assert got == {"hello": ('{"content": "HELLO"}', 5, True, None), "bad": (None, None, False, "ValueError: no")}
