"""Readers, writers, archives, extractors and the incremental intake."""

import gzip
import io
import json
import tarfile

from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import extractors
from tessera.sources import files, sinks
from tessera.streaming import incremental


def _write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text) if isinstance(text, str) else path.write_bytes(text)


def test_read_results(spark, tmp_path):
    doc = {"metadata": {"Name": "A", "Language": ["ar", "en"]}, "validation": {"AVERAGE": 0.5}, "cost": {"cost": 1, "input_tokens": 3}, "config": {"model_name": "m"}, "error": None}
    _write(tmp_path, "set_a/1410.1/zero_shot/m-browsing-results.json", json.dumps(doc, indent=1))
    _write(tmp_path, "set_a/1410.2_arXiv/few_shot/3/m-results.json", json.dumps({**doc, "metadata": {"Language": "ar"}, "error": "Timeout"}))
    _write(tmp_path, "set_b/1410.3/zero_shot/m-results.json", "{broken")
    got = {r.paper_id: r for r in files.read_results(spark, str(tmp_path)).collect()}
    assert set(got) == {"1410.1", "1410.2"}
    a, b = got["1410.1"], got["1410.2"]
    assert (a.result_set, a.shot, a.model, a.is_browsing, a.metadata.Languages, a.metadata.Language) == ("set_a", 0, "m-browsing", True, ["ar", "en"], None)
    assert (b.shot, b.metadata.Language, b.metadata.Languages, b.error, a.cost.cost) == (3, "ar", None, "Timeout", 1.0)
    assert files.read_results(spark, str(tmp_path), "set_b", keep_broken=True).count() == 1


def test_read_gold(spark, tmp_path):
    _write(tmp_path, "ar/test/x.json", json.dumps({"Name": "X", "Language": "ar", "Volume": 3, "annotations_from_paper": {"Name": 1}}))
    row = files.read_gold(spark, str(tmp_path)).first()
    assert (row.schema_name, row.split, row.metadata.Name, row.metadata.Volume, row.annotations_from_paper) == ("ar", "test", "X", 3.0, {"Name": 1})


def test_latex_and_pages(spark, tmp_path):
    _write(tmp_path, "p/b.tex", "B")
    _write(tmp_path, "p/sub/c.tex", "C")
    _write(tmp_path, "p/paper.pdf", b"%PDF one|two")
    assert [(r.text, r.n_files) for r in files.read_latex(spark, str(tmp_path)).collect()] == [("BC", 2)]
    pdf = files.read_binary(spark, str(tmp_path), "*.pdf")
    assert files.sniff(pdf).first().file_type == "pdf"
    assert files.parse_pages(pdf, lambda b: b.decode().split("|")).first().text == "%PDF one two"
    assert files.parse_pages(pdf, lambda b: 1 / 0).first().text == ""
    assert files.parse_layout(pdf, lambda b, mode: mode).first().text == "markdown"


def test_archives(spark):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w:gz") as tar:
        for name in ("a.tex", "../evil.tex"):
            info = tarfile.TarInfo(name)
            info.size = 1
            tar.addfile(info, io.BytesIO(b"x"))
    rows = [("tar", raw.getvalue()), ("gz", gzip.compress(b"tex")), ("bad", b"\x1f\x8bxx"), ("pdf", b"%PDF")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    assert sorted((r.path, r.member, bytes(r.content)) for r in files.extract_archives(df).collect()) == [("gz", "source.tex", b"tex"), ("pdf", "source.pdf", b"%PDF"), ("tar", "a.tex", b"x")]


def test_fetch_and_feed(spark):
    links = spark.createDataFrame([("https://github.com/a",), ("https://page",), ("https://none",), (None,)], "link string")
    pages = {"https://github.com/a": b"readme", "https://page": b"<title>T</title><p>x</p>"}
    got = {r.link: r.readme for r in files.repository_readme(links, pages.__getitem__).collect()}
    assert got["https://github.com/a"] == "readme" and got["https://page"] == "Title: T\n\nx" and got["https://none"] is None
    atom = "<feed><entry><title>T</title><published>2024-01-02T00:00:00Z</published><summary>s</summary><author><name>A</name></author><author><name>B</name></author></entry></feed>"
    row = files.read_feed(spark.createDataFrame([(atom,)], "xml string")).first()
    assert (row.title, row.authors, row.year) == ("T", ["A", "B"], 2024)


def test_timed_extraction(spark):
    df = spark.createDataFrame([("p", "ab"), ("q", None)], "paper_id string, text string")
    got = {(r.paper_id, r.method): r.n_chars for r in files.timed_extraction(df, {"ok": str, "bad": lambda t: 1 / 0}).collect()}
    assert got == {("p", "ok"): 2, ("p", "bad"): 0, ("q", "ok"): 0, ("q", "bad"): 0}


def test_sinks(spark, tmp_path):
    runs = spark.createDataFrame([("s", 0, "m", "p", 1)], "result_set string, shot int, model string, paper_id string, v int")
    sinks.write_results(runs, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).where("model = 'm'").count() == 1
    sinks.write_texts(spark.createDataFrame([("p", "t")], "paper_id string, text string"), str(tmp_path / "t"))
    sinks.write_bench(runs, runs, str(tmp_path / "b"))
    sinks.write_bibliography(spark.createDataFrame([("@a",)], "bibtex string"), str(tmp_path / "bib"))
    assert spark.read.text(str(tmp_path / "bib")).first()[0] == "@a"
    made = sinks.rewrite_gold(spark.createDataFrame([("1,234.5",), ("x",), (None,)], "Volume string")).collect()
    assert [r.Volume for r in made] == [1234.5, None, None] and made[0]["Other Tasks"] == []


def test_ask(spark):
    answers = {"good": '```json\n{"Name": "A", "Tasks": ["x"], "Year": 2020, "Link": null}\n```', "bad": "no"}

    def client(model, prompt):
        if prompt == "slow":
            raise TimeoutError
        return answers[prompt], 10, 2, 0.5

    work = spark.createDataFrame([(1, "m", "good"), (2, "m", "bad"), (3, "m", "slow")], "id int, model string, prompt string")
    got = {r.id: r for r in extractors.ask(work, client, ["id"]).collect()}
    assert got[1].raw == {"Name": "A", "Tasks": '["x"]', "Year": "2020", "Link": None} and got[1].error is None and got[1].input_tokens == 10
    assert got[2].raw == {} and "Expecting value" in got[2].error and got[2].cost == 1.5
    assert got[3].error == "Timeout"


def test_extractors(spark):
    papers = spark.createDataFrame([("p", "ar")], "paper_id string, schema_name string")
    attrs = spark.createDataFrame([("ar", 0, "Form", "str", 0, None, ["text", "images"], "CONTENT"), ("ar", 1, "Link", "url", 0, None, None, "ACCESSABILITY")], "schema_name string, ordinal int, attribute string, answer_type string, answer_min int, answer_max int, options array<string>, validation_group string")
    assert {r.attribute: r.text for r in extractors.baseline(papers, attrs, "first", 2025).collect()} == {"Form": "text", "Link": ""}
    assert extractors.dummy(papers, {"Name": "x"}).first().raw == {"Name": "x"}
    empty = dict.fromkeys(schemas.RECORD_FIELDS)
    rows = [(i, "p", "ar", 0, m, None, tuple({**empty, "Form": f, "Link": link}.values())) for i, (m, f, link) in enumerate([("a-pro", "text", "u"), ("b", "images", "v"), ("b-browsing", "images", "w"), ("jury", "x", "x")])]
    results = spark.createDataFrame(rows, f"result_id long, paper_id string, schema_name string, shot int, model string, error string, metadata {schemas.RECORD_DDL}")
    pick = lambda kind: {r.attribute: r.winners for r in extractors.judge(results, attrs, kind).collect()}
    assert pick("jury")["Form"] == ["images"] and pick("jury")["Link"] == ["u", "v", "w"]
    assert pick("composer") == {"Form": ["text"], "Link": ["w"]}
    gold = spark.createDataFrame([(1, "p", rows[0][-1], None)], f"record_id long, paper_id string, metadata {schemas.RECORD_DDL}, annotations_from_paper map<string,int>")
    assert extractors.human(papers, gold).first().metadata.Form == "text"
    assert extractors.poll(iter([None, {"cost": 1}]).__next__, pause=0) == {"cost": 1}


def test_incremental(spark, tmp_path):
    ddl = "paper_id string, model string, shot int, v int"
    source, table = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in ([("p", "m", 0, 1), ("p", "m", 0, 1), ("q", "m", 0, 2)], [("p", "m", 0, 9), ("r", "m", 0, 3)]):
        spark.createDataFrame(batch, ddl).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ddl).parquet(source)
        incremental.ingest_new(stream, table, str(tmp_path / "cp")).awaitTermination(120)
    assert sorted((r.paper_id, r.v) for r in spark.read.parquet(table).collect()) == [("p", 1), ("q", 2), ("r", 3)]
    late = incremental.error_rates(spark.createDataFrame([("2024-01-01 01:00:00", "m", "x"), ("2024-01-01 02:00:00", "m", None)], "t string, model string, error string").select(F.to_timestamp("t").alias("created_at"), "model", "error"))
    assert [(r.n_runs, r.n_errors) for r in late.collect()] == [(2, 1)]
