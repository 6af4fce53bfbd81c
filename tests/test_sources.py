import datetime as dt
import io
import json
import zipfile

from pyspark.sql import functions as F

from docsignal.sources import api, files, listing, reader

D = dt.date


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


def docx(*paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    return archive(**{"word__document.xml": f'<w:document xmlns:w="urn:w"><w:body>{body}</w:body></w:document>'})


def xlsx():
    return archive(**{
        "xl__sharedStrings.xml": '<sst xmlns="urn:s"><si><t>Name</t></si><si><r><t>Su</t></r><r><t>m</t></r></si></sst>',
        "xl__worksheets__sheet1.xml": '<worksheet xmlns="urn:s"><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row><c t="inlineStr"><is><t>a  b</t></is></c><c><v>5</v></c><c/></row></sheetData></worksheet>',
    })


def test_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx("One", " ", "Two"))
    (tmp_path / "b.xlsx").write_bytes(xlsx())
    (tmp_path / "c.zip").write_bytes(archive(**{"in__d.docx": docx("Deep"), ".hidden.txt": "no", "e.zip": b"x", "f.html": "<p>Page<script>x</script>"}))
    (tmp_path / "broken.docx").write_bytes(b"not a zip")
    (tmp_path / "g.doc").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.extracted(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert got["a.docx"].text == "One\nTwo" and got["b.xlsx"].text == "Name | Sum\na b | 5"
    assert got["c.zip"].text == "[f.html]\nPage\n\n[in/d.docx]\nDeep"
    assert got["broken.docx"].error.startswith("BadZipFile") and got["g.doc"].error == "old binary format"


def test_listing(spark):
    html = '<nav><a href="/m">Menu</a></nav><p>Text <a href="doc.pdf">A <b>file</b></a><a href="#">x</a>'
    df = spark.createDataFrame([(1, "http://h.org/a/b", html), (2, None, None)], "page_id long, url string, html string")
    got = [(r.href, r.title, r.absolute) for r in listing.links(df).orderBy("ordinal").collect()]
    assert got == [("/m", "Menu", "http://h.org/m"), ("doc.pdf", "A file", "http://h.org/a/doc.pdf"), ("#", "x", "http://h.org/a/b")]
    assert {r.page_id: r.text for r in listing.texts(df).collect()} == {1: "Text\nA\nfile\nx", 2: ""}


def test_payloads(spark):
    body = {"item1": {"items": [{"title": " Grant  one ", "activityId": "7", "startDate": "2024-02-01T00:00:00", "isActive": True}, {"title": "again", "id": "7"}, {"shortName": "Two", "id": "8", "startDate": "5.3.2024"}], "totalPages": 1}}
    df = spark.createDataFrame([("s", 1, json.dumps(body)), ("s", 2, "not json")], "source_name string, page int, body string")
    got = api.paged_posts(df, "http://x/").orderBy("ordinal").collect()
    assert [(r.title, r.url, r.published_on) for r in got] == [("Grant one", "http://x/7", D(2024, 2, 1)), ("Two", "http://x/8", D(2024, 3, 5))]
    assert got[0].raw_text == "Grant one\nStart: 2024-02-01T00:00:00\nStatus: active"

    many = {"items": [{"eoNumber": str(i), "name": f"Act {i}", "publishDateShort": "1.2.2024"} for i in range(30)]}
    df = spark.createDataFrame([("s", a, json.dumps(many).replace('"eoNumber": "', f'"eoNumber": "{a}')) for a in ("p", "q")], "source_name string, authority string, body string")
    got = api.by_authority(df, "http://x/", 24).collect()
    assert len(got) == 24 and len({r.url for r in got}) == 24

    flat = [{"href": None, "title": "On land", "num": "5", "type": {"title": "Law"}, "date": [2024, 1, 2], "id": "9"}, {"href": "http://y", "title": "Old", "date": [2020, 1, 1]}]
    df = spark.createDataFrame([("s", json.dumps(flat))], "source_name string, body string")
    assert [(r.title, r.url) for r in api.flat_list(df, "http://x/", F.lit(D(2023, 1, 1))).collect()] == [("Law № 5 On land", "http://x/9")]

    xml = '<projects total="2"><project id="3"><title>Draft</title><publishDate>2024-04-01</publishDate><stage>talks</stage></project><project id="4"><title>Next</title></project></projects>'
    got = api.xml_projects(spark.createDataFrame([("s", 1, xml)], "source_name string, page int, body string"), "http://x/").orderBy("ordinal").collect()
    assert [(r.title, r.url, r.published_on) for r in got] == [("Draft", "http://x/3", D(2024, 4, 1)), ("Next", "http://x/4", None)]


def test_pages_source(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"p{i}.html").write_text(f"<a href=x?page={i + 1}>next</a>")
    spark.dataSource.register(reader.PageSource)
    options = {"url": f"file://{tmp_path}/p{{page}}.html", "pages": "3", "source_name": "s", "retries": "0"}
    got = {r.page: r for r in spark.read.format("pages").options(**options).load().collect()}
    assert got[2].body == "<a href=x?page=3>next</a>" and got[3].body is None and got[3].error
    q = spark.readStream.format("pages").options(**options).load().writeStream.format("memory").queryName("seen_pages").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(r.page for r in spark.table("seen_pages").collect()) == [1, 2, 3]
    assert reader.next_page(["/l?page=2", "/l?page=5", "/l?page=3"], 2) == 3 and reader.next_page([], 1) is None


def test_merge_pages(spark):
    df = spark.createDataFrame([(1, 1, "A  a"), (1, 2, "a A"), (1, 3, "B"), (1, 4, "C"), (1, 5, "D"), (2, 1, " ")], "doc long, n int, t string")
    assert {r.doc: r.t for r in files.merge_pages(df, "doc", "n", "t").collect()} == {1: "A  a\n\nB\n\nC"}
