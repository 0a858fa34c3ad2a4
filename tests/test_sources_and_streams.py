import json

from pyspark.sql import functions as F

from quarrystone import cli
from quarrystone.sources import files as sources
from quarrystone.streaming import changes


def write(folder, **texts):
    for name, text in texts.items():
        path = folder / name.replace("__", "/").replace("_dot_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def workspace(tmp_path):
    write(
        tmp_path, src__user_dot_service_dot_ts="import { Db } from './db';\nexport class UserService {\n  find() { return new Db(); }\n}\n", src__db_dot_ts="export class Db {}\n",
        src__user_dot_spec_dot_ts="import { UserService } from './user.service';\n", node_modules__x__a_dot_ts="export {}", src__a_dot_min_dot_js="x", _dot_git__b_dot_ts="x", alone_dot_py="def f():\n    pass\n",
    )
    return str(tmp_path)


def test_scan(spark, tmp_path):
    folder = workspace(tmp_path)
    got = sources.scan(spark, folder)
    assert [(r["path"], r["is_ts"]) for r in got.collect()] == [("alone.py", False), ("src/db.ts", True), ("src/user.service.ts", True), ("src/user.spec.ts", True)]
    assert sources.scan(spark, folder, most_files=2).count() == 2 and sources.scan(spark, folder, most_bytes=25).count() == 2


def test_cli(spark, tmp_path, capsys):
    folder = workspace(tmp_path)

    def run(*argv):
        code = cli.main(list(argv), spark)
        return code, capsys.readouterr().out

    assert json.loads(run("index", folder)[1]) == {"files": 4, "symbols": 4, "edges": 2}
    assert json.loads(run("impact", folder, "db.ts")[1]) == ["src/user.service.ts", "src/user.spec.ts"]
    assert json.loads(run("path", folder, "src/db.ts", "spec")[1])["path"] == ["src/db.ts", "src/user.service.ts", "src/user.spec.ts"]
    assert run("impact", folder, "nothing")[0] == 1
    found = json.loads(run("search", folder, "fix", "user", "service")[1])
    assert found["files"][0]["path"] in ("src/user.service.ts", "src/user.spec.ts") and found["symbols"][0]["name"] == "UserService"
    assert "Hubs" in run("report", folder)[1]


def test_log_round_trip(spark, tmp_path):
    place = str(tmp_path / "log")
    rows = spark.createDataFrame([("t", "sent", 5, "the prompt")], "task string, outcome string, promptBytes long, prompt string")
    sources.append_log(rows, place)
    (tmp_path / "log" / "bad.json").write_text("not json\n\n")
    got = sources.read_log(spark, place).collect()
    assert len(got) == 1 and got[0]["promptSha256"] and got[0]["id"] and got[0]["timestamp"].endswith("Z")


def test_vector_round_trip(spark):
    frame = spark.createDataFrame([("a", [1.5, -2.0]), ("b", None), ("c", [])], "id string, vector array<float>")
    coded = sources.encode_vectors(frame)
    assert {r["id"]: r["vector"] for r in sources.decode_vectors(coded).collect()} == {"a": [1.5, -2.0], "b": None, "c": None}
    assert sources.decode_vectors(spark.createDataFrame([("x", "%%%")], "id string, vector string")).first()["vector"] is None


def test_git_error_is_a_field(spark, tmp_path):
    row = sources.git_changes(spark, str(tmp_path / "nowhere")).first()
    assert row["changed"] == [] and row["diff"] == "" and row["error"]


def test_changes_applied_by_a_stream(spark, tmp_path):
    index = changes.StoredIndex(spark, str(tmp_path / "index"))
    assert not index.exists()
    index.replace(spark.createDataFrame([("a", "h1"), ("b", "h1"), ("c", "h1")], "path string, content_hash string"))
    events, seen = tmp_path / "events", []
    events.mkdir()

    def put(name, *rows):
        (events / name).write_text("\n".join(json.dumps(dict(zip(("path", "content_hash", "op", "seq"), r))) for r in rows))

    def run():
        changes.run_changes(spark, str(events), "path string, content_hash string, op string, seq long", index, str(tmp_path / "checkpoint"), after=lambda d: seen.append(d.count())).awaitTermination()
        return {(r["path"], r["content_hash"]) for r in index.read().collect()}

    put("1.json", ("a", "h2", "upsert", 1), ("b", "x", "delete", 2), ("b", "h3", "upsert", 3), ("c", "h1", "upsert", 4), ("d", "h1", "upsert", 5), ("d", None, "delete", 6))
    assert run() == {("a", "h2"), ("b", "h3"), ("c", "h1")}
    put("2.json", ("c", None, "upsert", 7))
    assert run() == {("a", "h2"), ("b", "h3")} == run()
    assert seen == [4, 1]
    index.clear()
    assert not index.exists()


def test_windows_of_a_table(spark):
    frame = spark.createDataFrame([("2025-01-01 10:05:00", "x"), ("2025-01-01 10:59:00", "x"), ("2025-01-01 11:00:00", "x")], "ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert sorted(r["n"] for r in changes.windowed_counts(frame, "ts").collect()) == [1, 2]
