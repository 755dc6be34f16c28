import datetime as dt
import gzip
import json
import re
import sys
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evidara import catalog, schemas
from evidara.operators import quality
from evidara.plans.tables import LEXICON
from evidara.sources import cases, decisions, documents, links, records, sinks, worksheet
from evidara.streaming.ingest import scan_new

NUMBER = "00909208520083000000"


def test_json_layouts(spark, tmp_path):
    rows = [{"a": "1", "b": {"c": 2}}, {"a": "é", "b": None}]
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "pretty.json").write_text(json.dumps(rows, indent=2))
    (tmp_path / "one.json").write_text(json.dumps(rows[0]))
    (tmp_path / "tail.json").write_text(json.dumps(rows)[:-4])
    with gzip.open(tmp_path / "packed.json.gz", "wt") as f:
        f.write(json.dumps(rows))
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr("x.json", json.dumps(rows))
        z.writestr("bad.json", "{")
        z.writestr("note.txt", "no")
    (tmp_path / "broken.zip").write_bytes(b"nothing")
    df = records.read_records(spark, str(tmp_path))
    assert {r.source_file: r.n for r in df.groupBy("source_file").agg(F.count("*").alias("n")).collect()} == {"lines.json": 2, "pretty.json": 2, "one.json": 1, "tail.json": 1, "packed.json.gz": 2, "all.zip": 2}
    assert df.where("source_file = 'lines.json' AND position = 0").first().record == {"a": "1", "b": '{"c": 2}'}
    assert records.read_records(spark, str(tmp_path / "lines.json"), ("a",), 1).first().record == {"a": "1"}
    assert [tuple(r) for r in records.unexpected_fields(df, ("a",)).collect()] == [("b", 10)]


def test_files_are_streamed(spark, tmp_path):
    """A task holds a piece of a file and one object, not the file: here the reader may use 32 MB for one of 64 MB."""
    import tracemalloc

    path = tmp_path / "a large one.json"
    with open(path, "w") as f:
        for i in range(16):
            f.write(("[" if i == 0 else ",\n") + json.dumps({"i": i, "text": "x" * (4 << 20)}, indent=1))
        f.write("]")
    for store in (records.STREAMED, ()):  # a store that only Spark reads gives the same
        with pytest.MonkeyPatch.context() as m:
            m.setattr(records, "STREAMED", store)
            rows = records.read_records(spark, str(path), ("i",))
            assert [(r.source_file, r.position, r.record) for r in rows.orderBy("position").collect()] == [(path.name, i, {"i": str(i)}) for i in range(16)]
    tracemalloc.start()
    with records.opened(f"file:{path}") as raw:
        assert sum(len(x["text"]) for x in records.file_objects(str(path), raw)) == 64 << 20
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
    scan = records.read_records(spark, str(path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in scan.split("ReadSchema: ")[1]


def test_texts_are_decoded_without_another_worker(spark, tmp_path):
    """Bytes that are no UTF-8 become U+FFFD as Python has it, and only one Python stage reads members."""
    import random

    r = random.Random(5)
    odd = [b"\xff", b"\xc3", b"\xc3\xa4", b"\xe2\x82", b"\xe2\x82\xac", b"\xf0\x9f\x98", b"\xf0\x9f\x98\x80", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xc0\x80", b"\x80", b"a", b"<BR />", b"\r\n", b"\x00", b"\xe0\x80", b"\xf5", b"\xf8\x88"]
    made = {i: b"".join(r.choices(odd, k=r.randrange(12))) for i in range(1, 400)}
    with zipfile.ZipFile(tmp_path / "20240101.zip", "w") as z:
        for i, data in made.items():
            z.writestr(f"{i}.txt", data)
    df = documents.read_texts(spark, f"file://{tmp_path}/*.zip")
    want = {i: re.sub(r"(?i)<br\s*/?>", "\n", data.decode("utf-8", "replace")).replace("\r", "") for i, data in made.items()}
    assert {x.seq_documento: x.text for x in df.collect()} == want
    assert df._jdf.queryExecution().executedPlan().toString().count("Python") == 0


def test_faults_end_a_streamed_file():
    import io

    good = '[{"a": 1}, "x{", 3, {"b": "}"}'
    for tail in ("", "]", ', {"c": 1', ', {"c": }, {"d": 1}]', " oops {}", "}{}", '"'):
        assert list(records.streamed(io.BytesIO((good + tail).encode()))) == list(records.objects(io.StringIO(good + tail))) == [{"a": 1}, {"b": "}"}]


def test_links(spark, tmp_path):
    party = {"partes": [{"nomeParte": "someone"}], "nomeMinistroRelator": " minister "}
    rows = [
        {"numeroUnico": NUMBER, "numeroRegistro": " 2008 ", "codigoOrgaoJulgador": "S3 ", "dataUltimaDistribuicao": 1, **party}, {"numeroUnico": NUMBER, "numeroRegistro": ""},
        {"numeroUnico": "12", "numeroRegistro": "3"}, {"numeroUnico": NUMBER[:7] + "99" + NUMBER[9:], "numeroRegistro": "4", "dataHoraDistribuicao": "x"},
    ]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    found = links.read_links(spark, str(tmp_path), "acervo", b"s")
    assert found.columns == schemas.BRIDGE.names and "someone" not in str(found.collect())
    a, b = found.orderBy("numero_registro").collect()
    assert (a.cnj_formatted, a.cnj_year, a.tribunal, a.codigo_orgao_julgador, a.numero_registro) == ("0090920-85.2008.3.00.0000", 2008, "3.00", "S3", "2008")
    assert a.datajud_alias == "api_publica_stj" and len(a.relator_hash) == 32 and a.data_distribuicao == "1" and not b.cnj_valid and b.data_distribuicao is None
    assert links.read_links(spark, str(tmp_path), "ata", b"s").where("numero_registro = '4'").first().data_distribuicao == "x"
    with pytest.raises(ValueError):
        schemas.without_personal_fields(spark.createDataFrame([("x",)], "partes string"))


def test_links_of_a_large_file(spark, tmp_path):
    """A task's Python holds a chunk and a batch, not the file: one of 81 MB takes less than 64 MB more than a small one."""
    objects, taken = records.file_objects, []

    def watched(path, raw):
        most = 0
        for n, x in enumerate(objects(path, raw)):
            if n % 1000 == 0:
                most = max(most, int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]))
            yield x
        (tmp_path / "taken").write_text(str(most))

    for n in (2_000, 40_000):
        path = tmp_path / f"{n}.json"
        with open(path, "w") as f:
            for i in range(n):
                f.write(json.dumps({"numeroUnico": NUMBER, "numeroRegistro": str(i), "partes": "x" * 2000}) + "\n")
        with pytest.MonkeyPatch.context() as m:
            m.setattr(records, "file_objects", watched)
            found = links.read_links(spark, str(path), "acervo", b"s")
            assert found.select(F.count_distinct("numero_registro")).first()[0] == n
        taken.append(int((tmp_path / "taken").read_text()))
    assert taken[1] - taken[0] < 64 << 10


def test_links_look_for_digits_once(spark, tmp_path):
    """Once where rows are filtered and once where fields are made, not for each part of each field."""
    (tmp_path / "a.json").write_text("[]")
    plan = links.read_links(spark, str(tmp_path), "acervo", b"s")._jdf.queryExecution().executedPlan().toString()
    assert 2 <= plan.count("regexp_replace(") <= 4


def test_documents(spark, tmp_path):
    rows = [{"SeqDocumento": 1, "dataPublicacao": "2021-05-06", "NM_MINISTRO": "Ação", "assuntos": "1.9596,2.7", "processo": "AREsp 1826238", "tipoDocumento": "ACÓRDÃO"}]
    (tmp_path / "metadados20210506.json").write_text(json.dumps(rows))
    rows = [{"seqDocumento": "2", "dataPublicacao": 1686711600000, "ministro": "acao", "dataDistribuição": 1686711600000, "assuntos": "3372;14689", "processo": None}]
    (tmp_path / "metadados20230614.json").write_text(json.dumps(rows))
    a, b = documents.read_metadata(spark, str(tmp_path), b"s").orderBy("seq_documento").collect()
    assert (a.key, a.data_publicacao, a.tipo_documento, a.classe, a.assuntos_leaf) == ("20210506", dt.date(2021, 5, 6), "ACORDAO", "AREsp", "9596;7")
    assert (b.data_publicacao, b.data_distribuicao, b.assuntos_leaf, b.classe) == (dt.date(2023, 6, 14), dt.date(2023, 6, 14), "3372;14689", None)
    assert a.relator_hash == b.relator_hash and len(a.relator_hash) == 24


def test_texts(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "textos20230614.zip", "w") as z:
        z.writestr("d/1.txt", b"a<br/>b\r\nc\xff")
        z.writestr("e/1.txt", b"again")
        z.writestr("2.txt", b"")
        z.writestr("x.pdf", b"no")
    (tmp_path / "textos20230615.zip").write_bytes(b"PK broken")
    t = documents.read_texts(spark, str(tmp_path))
    assert [(r.seq_documento, r.key, r.text, r.nchar) for r in t.orderBy("seq_documento").collect()] == [(1, "20230614", "a\nb\nc�", 6), (2, "20230614", "", 0)]
    meta = spark.createDataFrame([(2, "20230614"), (3, "20230614")], "seq_documento bigint, key string")
    assert documents.kept_texts(t, meta).count() == 1
    c = quality.text_coverage(meta, t)
    assert tuple(c.first()) == ("20230614", 2, 1, 50.0) and quality.low_coverage(c).count() == 0
    assert quality.missing_keys(c, spark.createDataFrame([("20230614",), ("20230699",)], "key string")).first().key == "20230699"


def test_decisions(spark, tmp_path):
    row = {"id": "7", "numeroRegistro": "None", "ementa": "x", "dataPublicacao": "DJE DATA:19/06/2024", "dataDecisao": "20240617", "jurisprudenciaCitada": "STJ - <<REsp 1>>-SP <<RE 2>>", "referenciasLegislativas": "['LEG:FED LEI:010406 ANO:2002']"}
    (tmp_path / "d.json").write_text(json.dumps([row, {"id": "-"}, {"id": None, "numeroRegistro": "9"}]))
    d, c, l = decisions.read_decisions(spark, str(tmp_path), "body", b"s")
    a, b = d.orderBy("espelho_id").collect()
    assert (a.espelho_id, a.journal, a.data_decisao, a.n_citations, a.n_legislation, a.numero_registro) == ("7", "DJE", dt.date(2024, 6, 17), 2, 1, None)
    assert b.espelho_id == "body:9" and c.count() == 2 and l.first().number == "10406"
    assert decisions.decision_text(d).where("key = 'body:7'").first().text.strip() == "x"


def test_cases(spark, tmp_path):
    doc = {
        "id": "e1", "numeroProcesso": NUMBER, "grau": "G1", "dataAjuizamento": "20221022085739", "classe": {"codigo": 7, "nome": "c"}, "assuntos": [{"codigo": 7779, "nome": "a"}, {"codigo": 10431, "nome": "b"}],
        "orgaoJulgador": {"codigo": 5, "codigoMunicipioIBGE": 3550308}, "movimentos": [
            {"codigo": 999, "nome": "undated"}, {"codigo": 123, "dataHora": "2026-07-10T09:00:00.000Z"},
            {"codigo": 581, "dataHora": "2026-07-02T14:55:29.000Z", "complementosTabelados": [{"codigo": 4, "valor": 107}], "orgaoJulgador": {"codigo": 9}},
        ],
    }
    (tmp_path / "a.jsonl").write_text(json.dumps(doc) + "\n" + json.dumps({"id": "e2", "numeroProcesso": "1"}))
    docs = cases.read_answers(spark, str(tmp_path))
    m = cases.movements(docs, "tjx").orderBy("ordem").collect()
    assert [(r.ordem, r.codigo) for r in m] == [(1, 581), (2, 123), (3, 999)] and m[0].complementos == "4:107" and m[0].orgao_codigo == "9" and m[2].data_hora is None
    c = cases.cases(docs, "tjx").where("es_id = 'e1'").first()
    assert (c.assuntos_codigos, c.assuntos_nomes, c.n_movimentos, c.municipio_ibge) == ("7779;10431", "a|b", 3, 3550308)
    assert (c.primeiro_movimento, c.ultimo_movimento, c.data_ajuizamento) == (dt.datetime(2026, 7, 2, 14, 55, 29), dt.datetime(2026, 7, 10, 9), dt.datetime(2022, 10, 22, 8, 57, 39))


def test_index_requests(spark):
    sys.path.insert(0, str(Path(__file__).parent))
    import fake_index

    asked = []
    docs = list(cases.fetch(lambda b: asked.append(len(b["query"]["terms"]["numeroProcesso"])) or fake_index.answer(b), [str(n) for n in range(8)], size=6))
    assert len(docs) == 16 and asked == [8, 4, 2, 2, 4, 2, 2]
    waits, left = [], [cases.Transient(), cases.Transient()]
    assert cases.with_retries(lambda b: (_ for _ in ()).throw(left.pop()) if left else {"ok": 1}, waits.append)({}) == {"ok": 1} and waits == [1.0, 2.0]
    assert cases.public_key("<p>APIKey&nbsp;" + "x" * 40 + "</p>") == "x" * 40
    with pytest.raises(ValueError):
        cases.public_key("nothing")
    with pytest.raises(ValueError):
        list(cases.batched([1], 0))


def test_index_source(tmp_path):
    reader = cases.CaseReader({"numbers": "1,2,3", "batch": "2", "transport": "fake_index:answer"})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(reader.partitions()) == 2 and len(rows) == 6 and "secret" not in str(rows)


S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
WORKBOOK = {
    "xl/workbook.xml": f'<workbook {S} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="one" sheetId="1" r:id="rId3"/><sheet name="two" sheetId="2" r:id="rId4"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId4" Target="worksheets/sheet2.xml"/><Relationship Id="rId3" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/sharedStrings.xml": f"<sst {S}><si><t>doc_id</t></si><si><r><t>a &amp;</t></r><r><t> b</t></r></si><si><t> day </t></si></sst>",
    "xl/styles.xml": f'<styleSheet {S}><numFmts><numFmt numFmtId="165" formatCode="&quot;d&quot;0.0"/><numFmt numFmtId="166" formatCode="dd/mm/yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="165"/><xf numFmtId="166"/></cellXfs></styleSheet>',
    "xl/worksheets/sheet1.xml": f"""<worksheet {S}><sheetData>
        <row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>2</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c><c r="E1" t="str"><v>note</v></c></row>
        <row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2" s="1"><v>46297</v></c><c r="C2"><v>3.0</v></c><c r="E2" t="b"><v>1</v></c></row><row r="3"><c r="A3"/></row>
        <row r="4"><c r="A4"><v>2</v></c><c r="B4" s="3"><v>46297.5</v></c><c r="C4" s="2"><v>2.5</v></c></row>
        <row r="5"><c r="A5" t="inlineStr"><is><t>in line</t></is></c><c r="C5"><v>7</v></c><c r="E5" t="str"><f>A1</f><v>x=1</v></c></row></sheetData></worksheet>""",
}


def test_worksheets(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿doc_id; stratum ;x\n1;a,b;\n2;\"c;d\";y\n".encode())
    (tmp_path / "b.csv").write_text("doc_id,stratum\n1,a\n")
    a = worksheet.read_worksheet(spark, str(tmp_path / "a.csv"))
    assert a.columns == ["doc_id", "stratum", "x"] and [tuple(r) for r in a.collect()] == [("1", "a,b", ""), ("2", "c;d", "y")]
    assert worksheet.read_worksheet(spark, str(tmp_path / "b.csv")).first().stratum == "a"
    with zipfile.ZipFile(tmp_path / "c.xlsx", "w") as z:
        for name, xml in WORKBOOK.items():
            z.writestr(name, xml)
    c = worksheet.read_worksheet(spark, str(tmp_path / "c.xlsx"))
    assert c.columns == ["doc_id", "day", "n", "note"]
    assert [tuple(r) for r in c.collect()] == [("a & b", "2026-10-02", "3", "True"), ("2", "2026-10-02 12:00:00", "2.5", ""), ("in line", "", "7", "x=1")]
    for bad in (b"nothing", b"PK\x05\x06" + bytes(18)):
        (tmp_path / "d.xlsx").write_bytes(bad)
        with pytest.raises(ValueError, match="not a workbook"):
            worksheet.read_worksheet(spark, str(tmp_path / "d.xlsx"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a_1", 2, 1.5), ("b&", None, 2.0)], "name string, n int, x double")
    assert r"a\_1 & 2 & 1.5 \\" in (tex := sinks.booktabs(df, "50 %", "tab:x")) and r"\begin{tabular}{lrr}" in tex and r"50 \%" in tex
    assert sinks.csv_text(df).startswith("﻿name,n,x\na_1,2,1.5\n")
    assert sinks.numbers_tex({"rows": 12345, "share": {"value": 2.5, "decimals": 1}}) == "\\newcommand{\\rows}{12\\,345}\n\\newcommand{\\share}{2.5}\n"
    with pytest.raises(ValueError):
        sinks.numbers_tex({"a1": 1})
    out = str(tmp_path / "t")
    assert not sinks.write_unless_empty(df.where("false"), out) and not sinks.write_csv(df.where("false"), out)
    sinks.write_shards(df, out, "name")
    assert catalog.create_views(spark, str(tmp_path), ("t", "missing")) == {"t": 2, "missing": None}
    for _ in range(2):
        sinks.append_log(spark.createDataFrame([("k",)], "key string"), str(tmp_path / "log"))
    assert quality.latest(spark.read.parquet(str(tmp_path / "log")), ["key"]).count() == 1
    (tmp_path / "raw/x").mkdir(parents=True)
    (tmp_path / "raw/x/f.txt").write_text("abc")
    m = sinks.manifest(spark, str(tmp_path / "raw"), str(tmp_path / "raw"), "src", "lic").collect()
    assert [(r.file, r.bytes) for r in m] == [("x/f.txt", 3)] and m[0].sha256.startswith("ba7816bf")
    assert sinks.manifest(spark, str(tmp_path / "raw"), str(tmp_path / "raw"), "src", "lic", spark.createDataFrame(m, sinks.MANIFEST)).count() == 0


def test_point_lookup(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y")], "seq_documento bigint, key string, text string")
    rows.write.parquet(str(tmp_path / "document_text"))
    assert catalog.document(spark, str(tmp_path), "a", 2).first().text == "y"


def test_stream_resumes(spark, tmp_path):
    texts, out = str(tmp_path / "texts"), str(tmp_path / "out")
    new = lambda *rows: spark.createDataFrame(list(rows), "seq_documento bigint, key string, text string").write.mode("append").parquet(texts)
    new((1, "a", "an idiot"), (2, "a", "fine"))
    schema = spark.read.parquet(texts).schema
    scan_new(spark, texts, schema, LEXICON, out, str(tmp_path / "c"))
    new((3, "b", "a moron"))
    scan_new(spark, texts, schema, LEXICON, out, str(tmp_path / "c"))
    assert sorted(r.seq_documento for r in spark.read.parquet(f"{out}/candidates").collect()) == [1, 3]
    assert spark.read.parquet(f"{out}/candidate_hits").count() == 2


def test_staging(tmp_path):
    import io

    from evidara.sources import staging

    listed = list(staging.resources({"success": True, "result": {"resources": [{"url": "http://x/a.json", "format": "JSON", "size": "3"}, {"url": "http://x/b.pdf"}, {"url": "http://x/c.zip?v=1", "format": "ZIP"}, {"url": "http://x/d.csv", "size": 9}]}}))
    assert [(r["name"], r["size"]) for r in listed] == [("a.json", 3), ("c.zip", None), ("d.csv", 9)]
    out = staging.download_all(listed, tmp_path, 2, lambda url: io.BytesIO(b"abc"))
    assert out["a.json"] == out["c.zip"] == "new" and out["d.csv"].startswith("error") and not (tmp_path / "d.csv").exists()
    assert staging.download_all(listed[:2], tmp_path, 2, None) == {"a.json": "kept", "c.zip": "kept"}
    with pytest.raises(ValueError):
        list(staging.resources({"success": False}))
    assert sinks.macro("rows", "tier 2", "x_1") == "rowsTierTwoXOne"


def test_bibliography():
    from evidara.sources.bibliography import entry

    text = entry("k", {"type": "journal-article", "title": ["A {title}"], "author": [{"family": "F", "given": "G"}, {"name": "Org"}], "issued": {"date-parts": [[2024, 1]]}, "page": "1-9"})
    assert text == "@article{k,\n  author = {F, G and Org},\n  title = {A title},\n  year = {2024},\n  pages = {1--9},\n}"
    assert entry("k", {}) == "@misc{k,\n}"


def test_reports_have_a_limit(spark):
    df = spark.range(5)
    assert len(sinks.small(df, 5)) == 5
    with pytest.raises(ValueError, match="at most"):
        sinks.small(df, 4)
    assert [sinks.aligned(c) for c in (["1", "-2.5", ""], ["1", "x"], [], [""])] == ["r", "l", "l", "r"]
    assert [sinks.number(x) for x in (1234567, 2.0, 2.5, "a_b")] == [r"1\,234\,567", "2", "2.50", r"a\_b"] and sinks.number(3.14159, 3) == "3.142"


def test_scratch_is_shared(spark):
    from evidara import session

    class Cluster:
        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(dict)

    with pytest.raises(ValueError, match="checkpoint"):
        session.scratch(Cluster, "x")
    df = session.stored(spark.range(3), "three")
    assert df.count() == 3 and len(df.inputFiles()) >= 1


def test_members_of_one_archive_in_several_tasks(spark, tmp_path, monkeypatch):
    """One archive, dealt by places in it: more tasks than one read it, and the first member of a number stays."""
    from evidara.sources import zip_members

    monkeypatch.setattr(zip_members, "SPAN", 500)
    with zipfile.ZipFile(tmp_path / "20240102.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(60):
            z.writestr(f"a/{i}.txt", f"text {i} " * (i % 7), zipfile.ZIP_STORED if i % 2 else zipfile.ZIP_DEFLATED)
        z.writestr("b/5.txt", "a later one")
        z.writestr("b/none.txt", "no number")
        z.writestr("c/7.pdf", "no text")
    (tmp_path / "broken.zip").write_bytes(b"PK nothing of that kind")
    (tmp_path / "_hidden.zip").write_bytes(b"")
    path = f"file://{tmp_path}"
    assert documents.read_texts(spark, path).count() == 60
    got = {r.seq_documento: (r.key, r.member, r.text) for r in documents.read_texts(spark, path).collect()}
    assert got == {i: ("20240102", f"a/{i}.txt", f"text {i} " * (i % 7)) for i in range(60)}
    wanted = zip_members.members(spark, path)
    parts = zip_members.contents(wanted).withColumn("task", F.spark_partition_id()).groupBy("task").count().count()
    assert parts > 1
    data = (tmp_path / "20240102.zip").read_bytes()
    (tmp_path / "20240102.zip").write_bytes(data.replace(b"text 3 text 3", b"text 3 text X"))
    with pytest.raises(Exception, match="checksum"):
        documents.read_texts(spark, path).collect()
