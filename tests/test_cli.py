from __future__ import annotations

import json

import pytest

from lychgate import cli, settings


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"detection": {"jurisdictions": ["SG"]}, "policy": {"block_entities": ["my_label"]}, "redaction": {"strategies": {"IBAN": "hash"}}}))
    s = settings.load(str(path), {settings.SALT: " pepper "})
    assert s.jurisdictions == ("SG",) and s.policy.block == ("MY_LABEL",) and s.salt == "pepper"
    assert s.strategies == {"CREDIT_CARD": "mask", "IBAN": "hash"}
    assert settings.load(None, {settings.CONFIG: str(path)}) == settings.load(str(path), {})


@pytest.mark.parametrize("env", [{settings.SALT: ""}, {settings.AUDIT: " "}, {settings.RETENTION: "0"}, {settings.RETENTION: "x"}, {settings.CONFIG: ""}])
def test_refused_settings(env):
    with pytest.raises(ValueError):
        settings.load(None, env)


def test_missing_settings_file_is_refused():
    with pytest.raises(FileNotFoundError):
        settings.load(None, {settings.CONFIG: "/nowhere.json"})


def test_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv(settings.AUDIT, str(tmp_path / "audit.jsonl"))
    assert cli.main(["decide", "--text", "SSN 123-45-6789"]) == 4
    assert cli.main(["decide", "--text", "j@x.com"]) == 3
    assert cli.main(["decide", "--text", "hello"]) == 0
    assert "123-45-6789" not in (tmp_path / "audit.jsonl").read_text()
    capsys.readouterr()
    assert cli.main(["redact-text", "--text", "to j@x.com"]) == 0
    assert json.loads(capsys.readouterr().out)["redacted"] == "to <EMAIL_ADDRESS>"
    (tmp_path / "p.csv").write_text("email\n" + "\n".join(f"p{k}@x.com" for k in range(30)))
    assert cli.main(["classify-columns", str(tmp_path / "p.csv"), "--fail-on-pii"]) == 4
    assert json.loads(capsys.readouterr().out)["category"] == "PII_DIRECT"
    assert cli.main(["classify-columns", "x.unknown"]) == 2


def ocr():
    """Words of a made image: an address over four boxes in a row."""

    def words(png):
        assert png.startswith(b"\x89PNG")
        return [{"text": t, "left": 4 + 10 * k, "top": 4, "width": 6, "height": 2, "confidence": 90.0 if t != "dim" else 10.0} for k, t in enumerate(["4111", "1111", "1111", "1111", "dim", "ok"])]

    return words


def adjudicator():
    return lambda table, column, summary: json.dumps({"is_pii": True, "confidence": 1, "rationale": summary})


def test_images(spark, tmp_path, capsys, monkeypatch):
    import numpy as np

    from lychgate.operators import images

    monkeypatch.setenv(settings.AUDIT, str(tmp_path / "audit.jsonl"))
    p = np.random.default_rng(1).integers(1, 256, (12, 64, 3), dtype=np.uint8)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(images.png(p))
    assert cli.main(["scan-image", str(tmp_path / "in")]) == 2
    assert cli.main(["scan-image", str(tmp_path / "in"), "--ocr", "tests.test_cli:ocr"]) == 0
    row = json.loads(capsys.readouterr().out)
    assert [f["entity_type"] for f in row["findings"]] == ["CREDIT_CARD"] and [b["left"] for b in row["boxes"]] == [4, 14, 24, 34]
    assert cli.main(["redact-image", str(tmp_path / "in"), "--ocr", "tests.test_cli:ocr", "--out", str(tmp_path / "out")]) == 0
    (made,) = (tmp_path / "out").iterdir()
    got = images.read(spark, str(made)).select("image.*").first()
    q = images.pixels(got.height, got.width, got.nChannels, got.data)
    want = p.copy()
    for k in range(4):
        want[2:9, 2 + 10 * k : 13 + 10 * k] = 0
    assert (q == want).all()
    assert [json.loads(x)["kind"] for x in (tmp_path / "audit.jsonl").read_text().splitlines()] == ["scan_text", "scan_image"] * 2
    (tmp_path / "in" / "b.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="can't be read"):
        cli.main(["scan-image", str(tmp_path / "in"), "--ocr", "tests.test_cli:ocr"])


def test_channels(spark):
    """Grey and transparent images keep their kind; a box over the edge is clipped; no boxes, no change."""
    import numpy as np
    from pyspark.sql import functions as F

    from lychgate.operators import images

    box = "array<struct<left int, top int, width int, height int>>"
    for channels in (1, 4):
        p = np.full((3, 5, channels), 9, np.uint8)
        rows = [(("o", 3, 5, channels, 0, bytearray(p.tobytes())), b) for b in ([(0, 0, 1, 0)], [], None, [(-9, -9, 2, 2)])]
        df = spark.createDataFrame(rows, f"image struct<origin string, height int, width int, nChannels int, mode int, data binary>, boxes {box}")
        got = [bytes(r[0]) for r in df.select(images.painted(F.col("image"), F.col("boxes"), 0)).collect()]
        assert got[1] == got[2] == got[3] == images.png(p)
        black = p.copy()
        black[:1, :2] = [0, 0, 0, 255][:channels] if channels == 4 else 0
        assert got[0] == images.png(black)


def test_columns_are_adjudicated_and_recorded(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv(settings.AUDIT, str(tmp_path / "audit.jsonl"))
    (tmp_path / "t.csv").write_text("email,gender,code\n" + "\n".join(f"p{k}@x.com,{'fm'[k % 2]},{k % 2}" for k in range(60)))
    plain = cli.main(["classify-columns", str(tmp_path / "t.csv")]), capsys.readouterr().out
    again = cli.main(["classify-columns", str(tmp_path / "t.csv"), "--adjudicator", "tests.test_cli:adjudicator"]), capsys.readouterr().out
    first, second = ({r["column"]: r for r in map(json.loads, out.splitlines())} for _, out in (plain, again))
    for name, row in first.items():
        assert second[name]["llm_adjudicated"] == row["needs_review"] and ("@" not in second[name].get("llm_rationale", ""))
    assert any(r["needs_review"] for r in first.values())
    event = json.loads((tmp_path / "audit.jsonl").read_text().splitlines()[0])
    assert (event["kind"], event["columns"]) == ("classify_columns", 3) and "email" in event["pii"]


def test_samples_do_not_follow_the_order_of_a_file(spark):
    from lychgate.sources import router

    df = spark.createDataFrame([(f"v{k}", k, [k], 1.5) for k in range(40)], "`a.b` string, n long, l array<int>, d double")
    a, b = (sorted(map(tuple, router.sampled(d, "t", 7).select("column", "value").collect())) for d in (df, df.repartition(5)))
    assert a == b and len(a) == 28
    with pytest.raises(ValueError):
        router.sampled(df.select(), "t", 7)


def test_text_formats(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv(settings.AUDIT, str(tmp_path / "audit.jsonl"))
    (tmp_path / "x.txt").write_text("to j@x.com")
    assert cli.main(["redact-text", str(tmp_path / "x.txt"), "--out", str(tmp_path / "o"), "--format", "text"]) == 0
    assert [r.value for r in spark.read.text(str(tmp_path / "o")).collect()] == ["to <EMAIL_ADDRESS>"]
    assert cli.main(["decide", "--text", "x", "--out", str(tmp_path / "p"), "--format", "text"]) == 2
    assert [json.loads(x)["kind"] for x in (tmp_path / "audit.jsonl").read_text().splitlines()] == ["scan_text", "redact_text"]
    with pytest.raises(SystemExit):
        cli.main(["decide", "--text", "x", "--engine", "nowhere:make"])


def counting():
    """An engine that notes every time it is asked, in the file that the environment names."""
    import os

    def ask(text):
        with open(os.environ["ASKED"], "a") as f:
            f.write(text + "\n")
        return json.dumps({"entities": [{"type": "PERSON_NAME", "text": "Ann"}]})

    return ask


def test_an_engine_is_asked_once_a_text(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv(settings.AUDIT, str(tmp_path / "audit.jsonl"))
    spark.createDataFrame([(k, f"Ann has u{k}@x.com") for k in range(6)], "doc_id int, text string").write.parquet(str(tmp_path / "t.parquet"))
    asked = tmp_path / "asked"
    spark.sparkContext.environment["ASKED"] = str(asked)
    for command, code in (("scan-text", 0), ("redact-text", 0), ("decide", 3)):
        asked.write_text("")
        assert cli.main([command, str(tmp_path / "t.parquet"), "--engine", "tests.test_cli:counting"]) == code
        assert sorted(asked.read_text().splitlines()) == [f"Ann has u{k}@x.com" for k in range(6)]
        assert len(capsys.readouterr().out.splitlines()) == 6
    events = [json.loads(x) for x in (tmp_path / "audit.jsonl").read_text().splitlines()]
    assert all(e["findings"] == {"EMAIL_ADDRESS": 6, "PERSON_NAME": 6} for e in events if e["kind"] == "scan_text") and len(events) == 5


def test_an_adjudicator_is_told_the_name(spark):
    from lychgate.operators import classify, engines, profile
    from lychgate.sources import router

    p = profile.profile(router.inline(spark, {"full_name": [f"N {k}" for k in range(40)]}, "staff"))
    (r,) = classify.for_review(classify.classify(p)).collect()
    told = json.loads(r.summary)
    assert (told["table"], told["column"], told["cardinality_ratio"], told["null_ratio"]) == ("staff", "full_name", 1.0, 0.0) and 0 < told["digit_ratio"] < 1
    assert "full_name" in engines.column_prompt(r.summary) and "N 1" not in r.summary
