import json
import os
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from sparkveil import cli, options, providers, storage
from sparkveil.functions.text import is_generic
from sparkveil.operators import gate
from sparkveil.plans.pipeline import deidentify
from sparkveil.sources import sinks, transcripts
from sparkveil.streaming.files import watch


def put(folder, **files):
    for name, content in files.items():
        (folder / name.replace("__", ".")).write_bytes(content if isinstance(content, bytes) else content.encode())


def test_reads_text_and_json_and_lists_errors(spark, tmp_path):
    put(
        tmp_path, a__txt="﻿Interviewer: Hello\n\n  \nno label here\r\n10:30 we met\nhttps://x.org/a\n: odd\nBob:\n" + "x" * 81 + ": y", notes__md="Q: no",
        b__JSON=json.dumps({"transcript_id": "own", "turns": [{"text": "x", "speaker": "P"}, {"raw_text": "y"}, {}, {"text": "", "raw_text": "z"}]}),
        c__json='{"turns": [{"text": null}]}', d__json="[1]", e__json='{"turns": []}', f__json=b"\xef\xbb\xbf{}", g__txt=b"\xff\xfe", h__json='{"turns": [1]}', i__json='{"turns": [{"speaker": null}]}', j__json="{", k__txt=" \n",
    )
    (tmp_path / "sub").mkdir()
    put(tmp_path / "sub", z__txt="A: hidden")
    loaded = transcripts.load(transcripts.discover(spark, str(tmp_path)))
    rows = [(r.transcript_id, r.turn_id, r.speaker, r.text) for r in loaded.turns.orderBy("transcript_id", "turn_id").collect()]
    assert rows == [
        ("a", 0, "Interviewer", "Hello"), ("a", 1, "unknown", "no label here"), ("a", 2, "10", "30 we met"), ("a", 3, "https", "//x.org/a"), ("a", 4, "unknown", ": odd"), ("a", 5, "Bob", ""), ("a", 6, "unknown", "x" * 81 + ": y"),
        ("own", 0, "P", "x"), ("own", 1, "unknown", "y"), ("own", 2, "unknown", ""), ("own", 3, "unknown", ""),
    ]
    assert {os.path.basename(r.path) for r in loaded.errors.collect()} == {f"{c}.json" for c in "cdefhij"} | {"g.txt", "k.txt"}


def test_two_files_of_one_id(spark, tmp_path):
    put(tmp_path, a__json='{"turns": [{"text": "1"}]}', a__txt="A: 2")
    loaded = transcripts.load(transcripts.discover(spark, str(tmp_path)))
    assert [r.text for r in loaded.turns.collect()] == ["2"] and loaded.errors.count() == 1


def test_sinks_leave_no_raw_text(spark, tmp_path):
    turns = spark.createDataFrame([("a/../b", 0, "P", "Mail a.b@x.org"), ("c", 0, "P", "nothing é")], "transcript_id string, turn_id int, speaker string, text string")
    result = deidentify(turns, metadata={"model": "m", "model_digest": None, "pipeline_version": "1", "started_at_utc": "2026-01-01T00:00:00Z"})
    assert sinks.write_files(result, str(tmp_path)).count() == 2
    plain = (tmp_path / "anonymised" / "a_.._b.json").read_text()
    assert "x.org" not in plain and json.loads(plain)["turns"] == [{"turn_id": 0, "speaker": "P", "text": "Mail [EMAIL_1]"}]
    report = json.loads((tmp_path / "sensitive" / "a_.._b.deid-report.json").read_text())
    assert list(report) == ["transcript_id", "run_metadata", "spans", "registry", "review_items", "status"]
    assert report["registry"] == {"a.b@x.org": "[EMAIL_1]"} and report["spans"][0]["start"] == 5 and report["run_metadata"]["model_digest"] is None
    assert (tmp_path / "sensitive" / "c.review-queue.jsonl").read_text() == "" and "é" in (tmp_path / "anonymised" / "c.json").read_text()
    many = deidentify(spark.createDataFrame([("p", i, "P", f"Mail a{i}.b@x.org") for i in range(7)], "transcript_id string, turn_id int, speaker string, text string"))
    assert [tuple(r) for r in sinks.write_files(many, str(tmp_path / "parts"), size=3).collect()] == [("p", "clean")]
    parts = [json.loads((tmp_path / "parts" / "sensitive" / f"p{x}.deid-report.json").read_text()) for x in ("", ".part-1", ".part-2")]
    assert [[s["token"] for s in x["spans"]] for x in parts] == [["[EMAIL_1]", "[EMAIL_2]", "[EMAIL_3]"], ["[EMAIL_4]", "[EMAIL_5]", "[EMAIL_6]"], ["[EMAIL_7]"]] and len(parts[1]["registry"]) == 3
    assert len(json.loads((tmp_path / "parts" / "anonymised" / "p.part-2.json").read_text())["turns"]) == 1
    sinks.write_tables(result, str(tmp_path / "tables"))
    assert spark.read.parquet(str(tmp_path / "tables/sensitive/spans")).count() == 1


def test_generic_words(spark):
    yes = ["at home", "your home", "the kids", "undergrad", "sir", "my husband", "I", "sorry", "okay", "thanks", "your name", "where you study", "who is your doctor", "teacher", "front age", "another department"]
    no = ["Oak Park School", "Sarah's sister", "27 Wattlebird Lane", "", "  "]
    df = spark.createDataFrame([(x,) for x in yes + no], "x string")
    assert {r.x: r.g for r in df.select("x", is_generic("x").alias("g")).collect()} == {x: True for x in yes} | {x: False for x in no}


def test_options():
    assert options.from_env({}).model == "qwen3:8b"
    assert options.from_env({"DEID_LLM_MODEL": "", "OLLAMA_MODEL": "x"}).model == ""
    with pytest.raises(ValueError):
        options.from_env({"VLLM_BASE_URL": "http://far.example/v1"})
    with pytest.raises(ValueError):
        options.from_env({"OLLAMA_BASE_URL": "ftp://localhost"})
    with pytest.raises(ValueError):
        options.from_env({"OLLAMA_MODEL": "big-cloud"})
    far = options.from_env({"VLLM_BASE_URL": "http://far.example/v1/", "DEID_ALLOW_REMOTE_LLM": "Yes"})
    assert (far.provider, far.base_url, far.loopback) == ("vllm", "http://far.example/v1", False)


def test_options_are_read_by_their_names():
    far = options.from_env({"DEID_REQUEST_TIMEOUT_SECONDS": "7", "VLLM_BASE_URL": ""} | {"DEID_LLM_BASE_URL": "http://localhost:1/v1"})
    assert far.timeout_seconds == 7 and far.provider == "ollama"
    with pytest.raises(ValueError):
        options.from_env({"OLLAMA_MODEL": "X-Cloud"})
    assert "DEID_ALLOW_REMOTE_LLM=false" in options.template(True) and "DEID_REQUEST_TIMEOUT_SECONDS" in options.template()


def test_json_with_something_behind_it_is_none(spark, tmp_path):
    put(tmp_path, a__json='{"turns": [{"text": "x"}]} trailing', b__json='{"turns": [{"text": "x"}]}, {"turns": []}', c__json='{"turns": [{"text": "x"}]}\n')
    loaded = transcripts.load(transcripts.discover(spark, str(tmp_path)))
    assert [r.transcript_id for r in loaded.turns.collect()] == ["c"] and {r.message for r in loaded.errors.collect()} == {"not JSON"}


def test_tables_of_a_run_are_dropped(spark, tmp_path):
    with storage.temporary_tables(spark) as folder:
        kept = storage.cut_lineage(spark.range(3))
        assert kept.count() == 3 and os.listdir(folder)
    assert not os.path.exists(folder)
    before = set(os.listdir(storage.shared_folder(spark)))
    data = tmp_path / "in"
    data.mkdir()
    put(data, a__txt="P: mail a.b@x.org")
    watch(spark, str(data), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert cli.process(str(data), str(tmp_path / "o"), model=False, spark=spark) == 0
    assert set(os.listdir(storage.shared_folder(spark))) == before


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        storage.shared_folder(Session)


class Model(BaseHTTPRequestHandler):
    """Names Ann wherever it is asked; fails for texts with "crash", and answers no JSON for those with "odd"."""

    protocol_version = "HTTP/1.1"
    connections: set = set()

    def do_POST(self):
        type(self).connections.add(self.client_address)
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"]
        text = asked[1]["content"]
        answer = {"mentions": [{"text": "Ann", "pii_type": "person_name", "confidence": 0.9}] if "Ann" in text else []} if "mentions" in asked[0]["content"] else {"identifiers": []}
        content = "{" if "odd" in text or ("late" in text and "mentions" not in asked[0]["content"]) else json.dumps(answer)
        body = json.dumps({"choices": [{"message": {"content": content}}]}).encode()
        self.send_response(500 if "crash" in text else 200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        body = json.dumps({"models": [{"name": "m:latest", "digest": "d"}], "data": [{"id": "m"}]}).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_a_failing_transcript_does_not_stop_the_others(spark, tmp_path, capsys, monkeypatch):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("OLLAMA_BASE_URL", f"http://127.0.0.1:{server.server_port}/v1")
    monkeypatch.setenv("OLLAMA_MODEL", "m")
    monkeypatch.chdir(tmp_path)
    data = tmp_path / "in"
    data.mkdir()
    put(data, a__txt="P: I am Ann.\nQ: Who?\nP: Ann.", b__txt="P: crash\nP: more", c__txt="P: odd", d__txt="P: late", e__json="[")
    assert cli.process(str(data), str(tmp_path / "o"), spark=spark) == 1
    out, err = capsys.readouterr()
    assert sorted(os.listdir(tmp_path / "o" / "anonymised")) == ["a.json"]
    assert "a: status=clean, 2 replacements, 0 review items" in out and "processed 5, needs review 0, failed 4" in out
    assert [os.path.basename(line.split(": ")[0]) for line in err.splitlines() if line.startswith("FAILED")] == ["b.txt", "c.txt", "d.txt", "e.json"]
    assert cli.main(["doctor"]) == 0
    server.shutdown()


def test_errors_of_functions_are_raised(spark):
    turns = spark.createDataFrame([("t", 0, "P", "x")], "transcript_id string, turn_id int, speaker string, text string")

    def broken(_, text):
        raise ValueError("no")

    with pytest.raises(RuntimeError):
        providers.from_function(turns, broken)


def test_validate_on_its_own(spark):
    turns = spark.createDataFrame([("t", 0, "Ann met [NAME_1] on 1/2/2020", "Ann")], "transcript_id string, turn_id int, anonymised_text string, text string")
    spans = spark.createDataFrame([("t", 0, 0, 3, "Bo Lee", "person_name", 0.2, "llm"), ("t", 0, 0, 3, "you", "person_name", 0.2, "llm")], "transcript_id string, turn_id int, span_start int, span_end int, text string, pii_type string, confidence double, source string")
    residuals = spark.createDataFrame([("t", 0, 0, "Ann"), ("t", 0, 1, "NAME_1"), ("t", 0, 2, "elsewhere")], "transcript_id string, turn_id int, ord int, text string")
    items = [(r.text, r.reason) for r in gate.validate(turns, spans, residuals).orderBy("item_ord").collect()]
    assert items == [("Ann", gate.RESIDUAL), ("1/2/2020", gate.RESIDUAL), ("2020", gate.RESIDUAL), ("Bo Lee", gate.LOW)]


def test_answers_of_a_model():
    good = providers.parse_answer('{"mentions":[{"text":"Alex","pii_type":"person_name","confidence":0.9}]}\n<|end|>')
    assert providers.mentions_of(good) == [("Alex", "person_name", 0.9)]
    for bad in ('{"mentions": [}', 3, "[1]"):
        with pytest.raises(RuntimeError):
            providers.parse_answer(bad)
    with pytest.raises(RuntimeError):
        providers.mentions_of({"mentions": [{"text": "x", "pii_type": "alien"}]})


def test_functions_and_gazetteers_as_detectors(spark):
    turns = spark.createDataFrame([("t", 0, "P", "Ann met Bo Lee."), ("t", 1, "P", None)], "transcript_id string, turn_id int, speaker string, text string")
    said = providers.from_function(turns, lambda _, text: [("Ann", "person_name", 0.9)])
    listed = providers.from_gazetteer(turns, spark.createDataFrame([("Bo Lee", "person_name", 1.0), ("Bo", "person_name", 1.0), ("Zed", "person_name", 1.0)], "text string, pii_type string, confidence double"))
    result = deidentify(turns, said.unionByName(listed), lambda redacted: providers.residuals_from_function(redacted, lambda _, text: ["met"]))
    assert [r.anonymised_text for r in result.turns.orderBy("turn_id").collect()] == ["[NAME_1] [PII_1] [NAME_2].", None]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    settings = tmp_path / "env"
    assert cli.main(["init-config", "-o", str(settings)]) == 0 and cli.main(["init-config", "-o", str(settings)]) == 1
    assert cli.main(["init-config", "-o", str(settings), "--local", "--force"]) == 0 and "11434" in settings.read_text()
    empty = tmp_path / "empty"
    empty.mkdir()
    assert cli.process(str(empty), str(tmp_path / "o"), model=False, spark=spark) == 1
    data = tmp_path / "in"
    data.mkdir()
    put(data, a__txt="P: call 212-555-0147")
    assert cli.process(str(data), str(tmp_path / "o"), model=False, spark=spark) == 0
    assert cli.process(str(data / "a.txt"), str(tmp_path / "o"), "other", model=False, spark=spark) == 0
    assert sorted(os.listdir(tmp_path / "o" / "anonymised")) == ["a.json", "other.json"]
    put(data, b__json="{")
    assert cli.process(str(data), str(tmp_path / "o"), model=False, spark=spark) == 1


def test_stream_of_files(spark, tmp_path):
    data = tmp_path / "in"
    data.mkdir()
    put(data, a__txt="P: mail a.b@x.org", b__json="{")
    watch(spark, str(data), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    put(data, c__txt="P: call 212-555-0147")
    watch(spark, str(data), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    texts = sorted(r.text for r in spark.read.parquet(str(tmp_path / "out/batch=*/anonymised")).collect())
    assert texts == ["call [PHONE_1]", "mail [EMAIL_1]"]
