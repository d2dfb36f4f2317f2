import json
import zipfile

import pytest
from pyspark.sql import functions as F

from fiscalith.sources import awards, sinks
from fiscalith.sources.discovery import document_links, is_html_body, read_page_texts, scan_folder
from fiscalith.sources.tables import read_table
from fiscalith.streaming.ingest import ingest_records, record_stream, run_to_memory, windowed_counts


def test_scan(spark, tmp_path):
    for name in ("2024/rdtee/army_r2.pdf", "2025/procurement/navy_p40.pdf", "x/notes.txt"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("a\fb")
    rows = {r.filename: r for r in scan_folder(spark, str(tmp_path)).collect()}
    assert set(rows) == {"army_r2.pdf", "navy_p40.pdf"} and rows["army_r2.pdf"].fiscal_year == 2024 and rows["navy_p40.pdf"].exhibit_type == "procurement"
    assert scan_folder(spark, str(tmp_path), fiscal_years=[2025]).count() == 1
    assert [r.text for r in read_page_texts(spark, str(tmp_path)).collect()] == ["a\fb"]


def test_links(spark):
    html = "<a class=x href='/d/fy2024_r2_army.pdf'>A</a><a href=\"b.zip\">B</a><a href='c.html'>C</a>"
    pages = spark.createDataFrame([("https://h.org/p/i.html", html), ("https://h.org/", None)], "u string, h string")
    rows = {r.url: r for r in document_links(pages, "u", "h").collect()}
    assert set(rows) == {"https://h.org/d/fy2024_r2_army.pdf", "https://h.org/p/b.zip"}
    assert rows["https://h.org/d/fy2024_r2_army.pdf"].exhibit_type == "rdtee" and rows["https://h.org/p/b.zip"].exhibit_type is None
    body = spark.createDataFrame([(bytearray(b"<HTML>"),), (bytearray(b"%PDF"),)], "b binary").select(is_html_body(F.lit(None).cast("string"), F.col("b")))
    assert [r[0] for r in body.collect()] == [True, False]


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "a, \"b\"", 2024), (2, None, 2025)], "id int, t string, fy int")
    want = sorted(map(tuple, df.collect()))
    sinks.save(df, f"{tmp_path}/p.parquet")
    assert sorted(map(tuple, read_table(spark, str(tmp_path), "p").collect())) == want
    sinks.save(df, f"{tmp_path}/c", "csv", one_file=True)
    assert sorted(map(tuple, spark.read.schema(df.schema).option("header", True).option("escape", "\\").csv(f"{tmp_path}/c").collect())) == want
    sinks.save(df, f"{tmp_path}/j", "json")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    sinks.save_by(df, f"{tmp_path}/by", ["fy"])
    sinks.save_by(df.where("fy = 2025").withColumn("t", F.lit("new")), f"{tmp_path}/by", ["fy"])
    assert sorted((r.id, r.t) for r in spark.read.parquet(f"{tmp_path}/by").collect()) == [(1, 'a, "b"'), (2, "new")]
    nested = {r.fy: json.loads(r.json) for r in sinks.as_nested_json(df, "fy").collect()}
    assert nested[2024] == [{"id": 1, "t": 'a, "b"'}]


def test_workbook(spark, tmp_path):
    df = spark.createDataFrame([("A & B", 1.0, -2.0, -300.0)], "agency string, `2024` double, `2025` double, total_delta_pct double")
    path = sinks.write_workbook({"Trends": df}, f"{tmp_path}/r.xlsx")
    with zipfile.ZipFile(path) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert "A &amp; B" in sheet and "sparkline" in sheet and "'Trends'!B2:C2" in sheet


def test_award_pages():
    answers = {1: {"results": [{"a": 1}], "page_metadata": {"hasNext": True}}, 2: {"results": [], "page_metadata": {"hasNext": True}}}
    assert list(awards.pages(answers.__getitem__)) == [(1, {"a": 1})]
    assert awards.award_filters("097", 2024, ["A"], [])["time_period"] == [{"start_date": "2023-10-01", "end_date": "2024-09-30"}]
    assert [(p.agency, p.fiscal_year) for p in awards.AwardReader({"agencies": "097,021", "fiscalyears": "2024"}).partitions()] == [("097", 2024), ("021", 2024)]


def test_stream_is_idempotent(spark, tmp_path):
    rows = [(1, "2020,Army,0601102A,T,7,01,1,2,3"), (2, "bad")]
    spark.createDataFrame(rows, "raw_id bigint, line_text string").write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        source = record_stream(spark, f"{tmp_path}/in", "raw_id bigint, line_text string")
        ingest_records(source, "raw_id", "line_text", f"{tmp_path}/rows", f"{tmp_path}/bad", f"{tmp_path}/ck").awaitTermination()
    assert [r.raw_id for r in spark.read.parquet(f"{tmp_path}/rows").collect()] == [1]
    assert [(r.raw_id, r.reason) for r in spark.read.parquet(f"{tmp_path}/bad").collect()] == [(2, "columns")]


def test_stream_windows(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:01:00' ts, 'a' k union all select timestamp'2024-01-01 00:03:00', 'a'").write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema("ts timestamp, k string").parquet(f"{tmp_path}/e")
    assert [r.n for r in run_to_memory(windowed_counts(stream, "ts", "k"), "counted").collect()] == [2]


class _Answer:
    def __init__(self, body, kind="application/pdf", length=None):
        self.body, self.headers = body, {"Content-Type": kind, **({"Content-Length": str(length)} if length else {})}

    def read(self, size):
        part, self.body = self.body[:size], self.body[size:]
        return part

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


def test_fetch_rules(tmp_path):
    import urllib.error

    from fiscalith.sources.download import fetch

    asked = []

    def opener(request, timeout):
        asked.append(request.full_url)
        if "gone" in request.full_url:
            raise urllib.error.HTTPError(request.full_url, 404, "", {}, None)
        if "busy" in request.full_url:
            raise urllib.error.HTTPError(request.full_url, 503, "", {}, None)
        return _Answer(b"<html>" if "page" in request.full_url else b"%PDF", "text/plain")

    path = f"{tmp_path}/d/a.pdf"
    assert fetch("http://h/gone", path, pause=0, opener=opener) == ("http 404", None) and len(asked) == 1
    assert fetch("http://h/busy", path, pause=0, opener=opener) == ("http 503", None) and len(asked) == 4
    assert fetch("http://h/page", path, pause=0, opener=opener) == ("html", None)
    assert fetch("http://h/good", path, pause=0, opener=opener) == ("saved", 4)
    assert fetch("http://h/good", path, pause=0, opener=opener) == ("present", 4) and len(asked) == 6
    # An answer that breaks off is no document.
    assert fetch("http://h/cut", f"{tmp_path}/d/b.pdf", pause=0, opener=lambda r, timeout: _Answer(b"%PDF", length=9)) == ("failed", None)
    assert [f.name for f in (tmp_path / "d").iterdir()] == ["a.pdf"]


def test_download_table(spark, tmp_path):
    import http.server
    import threading

    from fiscalith.sources.download import as_links, download

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if "b" in self.path else 404)
            self.end_headers()
            self.wfile.write(b"%PDF-1")

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    rows = [(2024, 0, f"{base}/a"), (2024, 1, f"{base}/b"), (2023, 0, f"{base}/c")]
    links = as_links(spark.createDataFrame(rows, "fy int, attempt int, url string"), str(tmp_path), ["fy"], "law_{}.pdf")
    got = {r.path.rsplit("/", 1)[1]: (r.status, r.attempt) for r in download(links, pause=0).collect()}
    assert got == {"law_2024.pdf": ("saved", 1), "law_2023.pdf": ("http 404", 0)}
    again = {r.path.rsplit("/", 1)[1]: r.status for r in download(links, pause=0).collect()}
    server.shutdown()
    assert again["law_2024.pdf"] == "present"


def test_award_source(spark):
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def reply(self, data):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(data).encode())

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if "page" in body:
                self.reply({"results": [{"Award ID": f"A{body['page']}", "Award Amount": 5, "Start Date": "2024-01-02"}], "page_metadata": {"hasNext": body["page"] < 2}})
            else:
                self.reply({"results": [{"name": body["type"], "amount": 1}]})

        def do_GET(self):
            self.reply({"results": [{"toptier_code": "097"}]})

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    raw = awards.read_awards(spark, ["097", "021"], [2024], url=url)
    rows = awards.typed_awards(raw).collect()
    levels = {r.level for r in awards.read_spending(spark, ["097"], [2024], url=url).collect()}
    top = spark.read.format("fiscal_awards").options(kind="toptier", url=url).load().count()
    server.shutdown()
    assert sorted((r.agency, r.award_id, r.award_amount) for r in rows) == [("021", "A1", 5.0), ("021", "A2", 5.0), ("097", "A1", 5.0), ("097", "A2", 5.0)]
    assert rows[0].start_date.year == 2024 and levels == set(awards.LEVELS) and top == 1


def test_pipelines(spark, tmp_path):
    from fiscalith.plans.listing import SAMPLE_PAGE
    from fiscalith.plans.pipeline import load_star, parse_listings, parse_policies

    def extract(content):
        if content == b"broken":
            raise ValueError("no text layer")
        return content.decode()

    files = spark.createDataFrame(
        [("x/2025/fy2025_r1.pdf", bytearray((SAMPLE_PAGE * 1).encode())), ("x/fy2024_r1.pdf", bytearray(b"")), ("x/bad.pdf", bytearray(b"broken"))],
        "path string, content binary",
    )
    rows, bad = parse_listings(files, extract, lambda b: SAMPLE_PAGE, f"{tmp_path}/rows")
    got = rows.collect()
    assert {(r.fiscal_year, r.extraction_method) for r in got} == {(2025, "native"), (2024, "ocr")} and len(got) == 8
    assert [(r.path, r.error) for r in bad.collect()] == [("x/bad.pdf", "ValueError: no text layer")]
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 8
    counts = [{k: v.count() for k, v in load_star(rows, f"{tmp_path}/star").items()} for _ in range(2)]
    assert counts[0] == counts[1] and counts[0]["source_documents"] == 2
    para = "word " * 60
    texts = spark.createDataFrame([("ndaa_2024.pdf", "NDAA", f"SEC. 1. Radios.\n{para}"), ("nds_2022.pdf", "NDS", para)], "filename string, doc_type string, text string")
    chunks = parse_policies(texts)
    assert sorted((r.filename, r.doc_year, r.fiscal_year) for r in chunks.collect()) == [("ndaa_2024.pdf", 2024, 2024), ("nds_2022.pdf", 2022, None)]
    assert parse_policies(texts, chunks).count() == 2 and parse_policies(texts, chunks, years=[2022]).count() == 2


def test_policies_without_a_type(spark):
    from fiscalith.plans.pipeline import parse_policies

    texts = spark.createDataFrame([("nds_2022.txt", None, "strategy words here " * 40)], "filename string, doc_type string, text string")
    assert [(r.filename, r.doc_type, r.doc_year, r.fiscal_year, r.chunk_index) for r in parse_policies(texts).collect()] == [("nds_2022.txt", None, 2022, None, 0)]


def test_report(spark, tmp_path):
    from fiscalith.plans.pipeline import executive_report

    executive_report(spark, "/root/testdata/sf0.001", ["Radio", ""], 2020, 2025, f"{tmp_path}/r.xlsx")
    with zipfile.ZipFile(f"{tmp_path}/r.xlsx") as z:
        assert len([n for n in z.namelist() if "sheet" in n]) == 3


def test_budget_run(spark, tmp_path):
    import http.server
    import threading

    from fiscalith.sources.remote import budget_documents

    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            if "2024" in self.path and self.path.endswith("/"):
                body = b"<a href='army_r2.pdf'>a</a><a href='navy_p40.pdf'>n</a><a href='af-r2.pdf'>f</a><a href='x.html'>x</a>"
            elif self.path.endswith(".pdf") or self.path == "/":
                body = b"%PDF-1" * 400_000
            else:
                self.send_error(404)
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    address = base + "/Budget{year}/"
    manifest, none, unread = budget_documents(spark, [2024, 2025], str(tmp_path), discover_only=True, address=address, home=base + "/")
    assert none is None and [(r.fiscal_year, r.error.split(":")[0]) for r in unread.collect()] == [(2025, "HTTPError")]
    assert {(r.fiscal_year, r.component, r.exhibit_type) for r in manifest.collect()} == {(2024, "army", "rdtee"), (2024, "navy", "procurement"), (2024, "af", "rdtee")}
    assert "/" in asked and not [p for p in asked if p.endswith(".pdf")]
    _, outcome, _ = budget_documents(spark, [2024], str(tmp_path), ["rdtee"], ["army"], address=address)
    server.shutdown()
    assert [(r.path, r.status, r.size_bytes) for r in outcome.collect()] == [(f"{tmp_path}/2024/rdtee/army_r2.pdf", "saved", 2_400_000)]
    from fiscalith.sources.discovery import scan_folder

    scanned = scan_folder(spark, str(tmp_path), components=["army"]).collect()
    assert [(r.fiscal_year, r.exhibit_type, r.component) for r in scanned] == [(2024, "rdtee", "army")]
    assert scan_folder(spark, str(tmp_path), components=["navy"]).count() == 0


def test_policy_folders(spark, tmp_path):
    from fiscalith.plans.pipeline import parse_policies, read_policies
    from fiscalith.sources.remote import policy_manifest

    para = "word " * 60
    for name, text in (("NDAA/NDAA_2024.pdf", f"SEC. 1. Radios.\n{para}"), ("NDS/NDS_2022.pdf", para), ("NDS/NDS_2018.pdf", "broken")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)

    def read(content):
        if content == b"broken":
            raise ValueError("no text")
        return content.decode()

    texts, bad = read_policies(spark, {t: f"{tmp_path}/{t}" for t in ("NDAA", "NDS")}, read)
    assert sorted((r.filename, r.doc_type) for r in texts.collect()) == [("NDAA_2024.pdf", "NDAA"), ("NDS_2022.pdf", "NDS")]
    assert [r.error for r in bad.collect()] == ["ValueError: no text"]
    assert sorted((r.filename, r.section_id, r.doc_year) for r in parse_policies(texts).collect()) == [("NDAA_2024.pdf", "SEC. 1", 2024), ("NDS_2022.pdf", None, 2022)]
    got = {(r.doc_type, r.year, r.size_kb) for r in policy_manifest(spark, str(tmp_path)).collect()}
    assert got == {("NDAA", 2024, 0), ("NDS", 2022, 0), ("NDS", 2018, 0)}


def test_extractors_in_turn():
    from fiscalith.sources.pages import first_that_works

    def broken(content):
        raise RuntimeError("not installed")

    assert first_that_works(broken, bytes.decode)(b"x") == "x"
    with pytest.raises(RuntimeError):
        first_that_works(bytes.decode, broken)(b"\xff")


def test_refused_levels_are_marked(spark):
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if body["type"] == "object_class":
                self.send_error(422)
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"results": [{"name": body["type"]}]}).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rows = awards.read_spending(spark, ["097"], [2024], url=f"http://127.0.0.1:{server.server_port}").collect()
    server.shutdown()
    assert {(r.level, r.record is None, r.error) for r in rows} == {("federal_account", False, None), ("program_activity", False, None), ("object_class", True, "http 422")}


def test_skipped_pages_and_missing_subpackage(spark):
    from fiscalith.plans.listing import SAMPLE_PAGE, file_rows

    other = SAMPLE_PAGE.replace("Research, Development, Test and Evaluation, Army", "Defense Health Program").replace("0601102A", "0601199A")
    rows = file_rows(spark.createDataFrame([("f", other + "\f" + SAMPLE_PAGE)], "f string, t string"), "f", "t").collect()
    assert "0601199A" not in {r.pe_number for r in rows} and {r.page for r in rows} == {1} and len(rows) == 4
