"""Readers, writers and guards on temporary files."""

import gzip
import hashlib
import io
import tarfile
import zipfile

import pandas as pd
import pyarrow as pa
import pytest

from quarrylens.sources import archives, catalog, files, html_tables, jdbc, manifest
from quarrylens.streaming.rowwise import run_rowwise

CSV = "id; name ;empty\n1;ann;\n2;bob;\n;;\n3;eve;\n"


def test_csv_delimiter_header_and_empty_parts(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text(CSV)
    assert files.detect_delimiter(spark, str(p)) == ";"
    df = files.read_any(spark, str(p))
    assert df.columns == ["id", "name"] and df.count() == 3
    assert files.read_csv(spark, str(p), nrows=2).count() == 2


def test_latin1_csv_and_encoding_report(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("n,v\né,1\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes("n,v\né,1\n".encode("utf-16"))
    (tmp_path / "c.csv").write_text("n,v\né,1\n")
    got = {r["path"][-5]: r["encoding"] for r in files.encoding_report(spark, str(tmp_path)).collect()}
    assert got == {"a": "latin-1", "b": "utf-16", "c": "utf-8"}
    assert files.read_csv(spark, str(tmp_path / "a.csv"), encoding="latin-1").first()["n"] == "é"
    assert files.read_csv(spark, str(tmp_path / "a.csv"), encoding="auto").first()["n"] == "é"
    m = manifest.file_manifest(spark, str(tmp_path / "c.csv")).first()
    assert m["format"] == "csv" and len(m["sha256"]) == 64


def test_json_lines_nested_json_and_xml(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert files.read_any(spark, str(tmp_path / "l.jsonl")).agg({"a": "sum"}).first()[0] == 3
    (tmp_path / "n.json").write_text('{"meta": 1, "rows": [{"a": 1, "b": {"c": 2, "d": {"e": 3}}}, {"a": 4, "b": {"c": 5, "d": {"e": 6}}}]}')
    df = files.read_any(spark, str(tmp_path / "n.json"))
    assert df.columns == ["a", "b.c", "b.d.e"] and df.count() == 2
    (tmp_path / "r.xml").write_text("<rs><r><k>1</k></r><r><k>2</k></r></rs>")
    assert files.read_xml(spark, str(tmp_path / "r.xml"), "r").agg({"k": "sum"}).first()[0] == 3


def test_parquet_orc_feather(spark, tmp_path):
    df = spark.range(5).selectExpr("id", "id * 2 as b")
    df.write.parquet(str(tmp_path / "p"))
    df.write.orc(str(tmp_path / "o"))
    assert files.read_parquet(spark, str(tmp_path / "p"), ["b"], 3).count() == 3
    assert files.read_orc(spark, str(tmp_path / "o"), ["b"]).columns == ["b"]
    with pa.OSFile(str(tmp_path / "f.feather"), "wb") as f, pa.ipc.new_file(f, pa.schema([("x", pa.int64()), ("s", pa.string())])) as w:
        w.write_table(pa.table({"x": [1, 2], "s": ["a", None]}))
    assert [tuple(r) for r in files.read_feather(spark, str(tmp_path / "f.feather")).orderBy("x").collect()] == [(1, "a"), (2, None)]
    got = files.sql_on_file(spark, str(tmp_path / "p"), select="b", where="id > 3").collect()
    assert [r["b"] for r in got] == [8]


def test_archives(spark, tmp_path):
    with gzip.open(tmp_path / "g.csv.gz", "wt") as f:
        f.write("a,b\n1,x\n")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("readme.md", "no table")
        z.writestr("d/t.csv", 'a,b\n1,"x,y"\n2,z\n')
        z.writestr("u.jsonl", '{"k": 1}\n{"k": 2}\n')
    with tarfile.open(tmp_path / "t.tar", "w") as t:
        data = b"a,b\n7,q\n"
        info = tarfile.TarInfo("../evil.csv")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
        info = tarfile.TarInfo("ok.csv")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    assert files.read_any(spark, str(tmp_path / "g.csv.gz")).first()["b"] == "x"
    assert [tuple(r) for r in files.read_any(spark, str(tmp_path / "z.zip")).collect()] == [("1", "x,y"), ("2", "z")]
    assert archives.read_compressed(spark, str(tmp_path / "z.zip"), member="u.jsonl").agg({"k": "sum"}).first()[0] == 3
    lines = archives.archive_lines(spark, str(tmp_path / "t.tar")).collect()
    assert {r["member"] for r in lines} == {"ok.csv"}
    with pytest.raises(ValueError):
        archives.archive_lines(spark, str(tmp_path / "z.zip"), "../x.csv")


def test_html_tables(spark):
    page = ("<table class='a b'><tr><th>h1<th>h2</tr><tr><td>1</td><td>x <b>y</b></td></tr></table>"
            "<div><table><tr><td>only<table><tr><td>inner</td></tr></table></td></tr></table></div>")
    df = spark.createDataFrame([(1, page), (2, "<p>none</p>"), (3, None)], "id int, html string")
    got = [(r["table_no"], r["row_no"], list(r["cells"])) for r in html_tables.html_tables(df, "id").collect()]
    assert (0, 0, ["h1", "h2"]) in got and (0, 1, ["1", "x y"]) in got and (2, 0, ["inner"]) in got
    assert html_tables.html_tables(df, "id", css_class="b").count() == 2
    assert html_tables.html_tables(df, "id", table_no=1).count() == 1


def test_guards(spark, tmp_path):
    for bad in ("DROP TABLE x", "", "  insert into x values (1)"):
        with pytest.raises(ValueError):
            catalog.query_table(spark, bad)
    with pytest.raises(ValueError):
        catalog.register_table(spark.range(1), "bad name")
    with pytest.raises(ValueError):
        jdbc.read_jdbc(spark, "jdbc:none", table="a; drop")
    with pytest.raises(ValueError):
        jdbc.read_jdbc(spark, "jdbc:none", table="a", query="select 1")
    assert jdbc.jdbc_url("sqlserver", "h", 1, "d") == "jdbc:sqlserver://h:1;databaseName=d"
    out = catalog.export_table(spark.range(3), "outputs/t", "parquet", base=str(tmp_path))
    assert spark.read.parquet(out).count() == 3
    for bad in ("/etc/x", "outputs/../../x", "outputs_evil/x"):
        with pytest.raises(ValueError):
            catalog.export_table(spark.range(1), bad, base=str(tmp_path))


def test_catalogue(spark):
    c = catalog.Catalogue(spark)
    c.add("numbers", spark.range(3), "made here")
    assert [(r["table_name"], r["column_name"], r["origin"]) for r in c.columns().collect()] == [("numbers", "id", "made here")]
    c.remove("numbers")
    with pytest.raises(KeyError):
        c.get("numbers")


def test_rowwise_stream(spark, tmp_path):
    from quarrylens.operators.health import clinical_flags

    src = str(tmp_path / "in")
    spark.createDataFrame(pd.DataFrame({"v": [1.0, 50.0]})).write.parquet(src)
    stream = spark.readStream.schema("v double").parquet(src)
    q = run_rowwise(stream, lambda d: clinical_flags(d, {"v": {"high": 10}}), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sorted(r["v_abnormal"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [False, True]


def test_manifest_counts_in_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "CHUNK", 7)
    texts = {"a.csv": 'x;y\n1;"two\nlines"\r\n\n2;z', "b.jsonl": '{"a": 1, "b": 2}\n{"a": 3}\n', "c.json": '[{"a": 1},\n{"a": 2}]',
             "d.txt": "one\ntwo", "e.csv": "", "f.tsv": "h1\th2\th3\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    got = {name: manifest.file_facts(str(tmp_path / name), name[2:]) for name in texts}
    assert {n: g[1:] for n, g in got.items()} == {
        "a.csv": (2, 2), "b.jsonl": (2, 2), "c.json": (None, None), "d.txt": (None, None), "e.csv": (0, None), "f.tsv": (0, 3)}
    rows = {r["path"].rsplit("/", 1)[1]: r for r in manifest.file_manifest(spark, str(tmp_path)).collect()}
    assert set(rows) == set(texts) - {"e.csv"}  # Spark lists no empty files
    for name, text in texts.items():
        if not text:
            continue
        assert rows[name]["sha256"] == hashlib.sha256(text.encode()).hexdigest() and rows[name]["bytes"] == len(text.encode())


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Two runs over one checkpoint write every row once; a third one without news writes nothing."""
    from quarrylens.operators.classify import classify_intent

    path, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for part in (0, 1, None):
        if part is not None:
            spark.range(part * 50, part * 50 + 50).selectExpr("id", "concat('show me ', id) AS text").write.mode("append").parquet(path)
        stream = spark.readStream.schema("id bigint, text string").parquet(path)
        run_rowwise(stream, lambda s: classify_intent(s, "text"), out, mark).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).select("id").collect()) == list(range(100))
