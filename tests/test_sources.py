import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from test_operators import ITEM, items, make_docx

from redline import config
from redline.functions import geometry as G, text as T
from redline.functions.kernels import verify_signature
from redline.operators import align as A, compare as R, layout as L, locate as P, recognition as Q, review as V, tables as B
from redline.plans.compare import compare, gated_raw_compare, locate_targets, report_documents, view_counts, with_segments
from redline.schemas import REPORT
from redline.sinks import annotations as N, logs
from redline.sources import docx, pages as J, replies as S, storage
from redline.streaming import progress as E


def test_report_round_trip(spark, tmp_path):
    word = ["第一条 金额100万元", "第二条 交货", "第三条 验收标准按国标执行"]
    pdf = ["第一条 金额200万元", "第二条 交货", "第九条 新增条款"]
    boxed = items(spark, word, pdf).withColumn("bbox", F.when(F.col("side") == "pdf", F.array(F.lit(10.0), F.lit(20.0), F.lit(110.0), F.lit(40.0)))).withColumn("page_index", F.lit(0))
    meta = spark.createDataFrame([(1, 0, 200.0, 400.0)], "pair_id long, page_index int, pdf_width_pt double, pdf_height_pt double")
    result = compare(boxed)
    made = report_documents(result, meta)
    assert made.schema.simpleString() == StructType.fromDDL(REPORT).simpleString()
    storage.write_reports(made, str(tmp_path / "reports"))
    r = storage.read_report(spark, str(tmp_path / "reports"), 1).first()
    assert storage.read_report(spark, str(tmp_path / "reports"), 2).count() == 0
    assert r == made.first() and r["overall_risk"] == "high" and r["recognition_status"] == "reliable" and list(r["unreliable_pages"]) == []
    assert r["status_counts"] == {"identical": 1, "modified": 1, "added": 1, "deleted": 1} and sum(r["risk_distribution"].values()) == r["total_alignments"] == 4
    (d,) = r["diffs"]
    assert (d["alignment_id"], d["status"], d["risk_level"], d["judged_by"]) == ("al0", "modified", "high", "rule")
    assert [(s["op"], s["text"]) for s in d["segments"]] == [("equal", "金额"), ("delete", "1"), ("insert", "2"), ("equal", "00万元")]
    assert [(x["page_index"], list(x["bbox"])) for x in d["page_regions"]] == [(0, [0.05, 0.05, 0.55, 0.1])]
    assert [(u["status"], u["segments"][0]["op"]) for u in r["unmatched"]] == [("added", "insert"), ("deleted", "delete")] and r["unmatched"][1]["page_regions"] == []
    assert [(k["alignment_id"], k["kind"], k["word_value"], k["pdf_value"]) for k in r["key_elements"]] == [("al0", "amount", "100万元", "200万元")]
    assert {(t["target_id"], t["number"], t["status"]) for t in locate_targets(result.diffs).collect()} == {(0, "一", "modified"), (3, "三", "deleted")}
    assert view_counts(result.reports).first().asDict() == {"pair_id": 1, "n_total": 3, "n_modified": 1, "n_added": 1, "n_deleted": 1, "n_unmatched": 2}


def test_report_of_tables_and_empty_pairs(spark):
    schema = ITEM + ", tbl struct<headers: array<string>, rows: array<array<string>>>"
    rows = [(1, side, 0, "table", 0, f"品名 | 价格\n甲 | {v}", (["品名", "价格"], [["甲", v]])) for side, v in (("word", "100元"), ("pdf", "300元"))]
    got = report_documents(compare(spark.createDataFrame(rows, schema))).first()
    assert got["diffs"][0]["risk_level"] == "high" and ("amount", "100元", "300元") in {(k["kind"], k["word_value"], k["pdf_value"]) for k in got["key_elements"]}
    assert report_documents(compare(items(spark, [], []))).count() == 0


def test_blank_cell_is_a_change(spark):
    schema = ITEM + ", tbl struct<headers: array<string>, rows: array<array<string>>>"
    rows = []
    for side in ("word", "pdf"):
        own = [[f"名称{i}", f"{i}"] for i in range(30)]
        own[7][0] = "" if side == "pdf" else own[7][0]
        rows.append((1, side, 0, "table", 0, "\n".join(" | ".join(r) for r in own), (["品名", "数量"], own)))
    d = compare(spark.createDataFrame(rows, schema)).diffs
    assert (d.first()["status"], d.first()["risk_level"]) == ("modified", "medium")
    assert any(s["op"] == "delete" and "名称7" in s["text"] for s in with_segments(d).first()["segments"])


def test_review(spark):
    result = compare(items(spark, ["第一条 金额100万元", "第二条 甲"], ["第一条 金额200万元", "第二条 甲"]))
    diffs = with_segments(result.diffs)

    def level(reviewer):
        r = V.review(diffs, reviewer, 0).where("status = 'modified'").first()
        return r["risk_level"], list(r["risk_reasons"]), r["judged_by"]

    def lost(text):
        raise ConnectionError

    assert level(lambda t: 'so: {"risk_level": " LOW ", "reason": "typo"}' if "[-1-][+2+]" in t else "") == ("low", ["review: typo"], "llm")
    assert level(lambda t: '{"risk_level": "medium"}') == ("medium", ["reviewed"], "llm")
    assert level(lambda t: '{"risk_level": "fatal"}') == ("high", [V.INVALID], "llm")
    assert level(lambda t: "[]") == ("high", [V.INVALID], "llm")
    assert level(lost) == ("high", [V.FAILED], "llm")
    assert level(None) == ("high", [V.NOT_SET], "llm")


def test_retries_and_delivery(spark):
    waits, calls = [], []

    def call(x):
        calls.append(x)
        if len(calls) < 4:
            raise TimeoutError
        return x

    assert S.retried(call, 3, waits.append, lambda: 0.5)(7) == 7 and waits == [1.5, 2.5, 4.5] and S.backoff(9) == 8
    with pytest.raises(TimeoutError):
        calls.clear()
        S.retried(call, 1, waits.append)(1)
    sent = []

    def send(body, headers):
        sent.append(headers)
        return 500 if len(sent) < 3 else 204

    waits.clear()
    assert N.send_event("b", "sig", "e", send, sleep=waits.append) == 3 and waits == [1, 4]
    assert sent[0] == {"Content-Type": "application/json", "X-Signature": "sig", "X-Event-Id": "e"}
    assert N.send_event("b", "sig", "e", lambda b, h: 404, sleep=waits.append) == 0 and waits[-3:] == [1, 4, 16]
    body = N.webhook_body(F.lit(5), F.lit("done"), F.struct(F.lit(1).alias("n")))
    signed = N.signed_webhooks(spark.range(1).select(body.alias("body")), "key")
    row = signed.first()
    assert verify_signature("key", row["body"].encode(), row["signature"]) and not verify_signature("other", row["body"].encode(), row["signature"])
    got = N.deliver(signed, lambda b, h: 200 if json.loads(b)["event_id"] == h["X-Event-Id"] else 500, ()).first()
    assert (got["attempts"], got["delivered"]) == (1, True)


def test_plain_blocks(spark):
    text = "标题\n<table><tr><th>a&amp;b</th><td>x<br>y</td></tr><tr><td> 1 </td></tr></table>\n| c | d |\n|---|---|\n| 2 | 3 |\n尾<TABLE><tr><td>one</td></tr></TABLE>"
    got = S.plain_blocks(spark.createDataFrame([(1, 0, text), (1, 1, None)], "doc_id long, page_index int, content string"), ["doc_id", "page_index"])
    rows = got.orderBy("block_ord").collect()
    assert [(r["block_id"], r["label"], r["content"]) for r in rows] == [
        ("p0-b0", "text", "标题"), ("p0-b1", "table", "a&b | x y\n1 | "), ("p0-b2", "table", "c | d\n2 | 3"), ("p0-b3", "text", "尾"), ("p0-b4", "text", "<TABLE><tr><td>one</td></tr></TABLE>"),
    ]
    assert S.parse_counts(got, ["doc_id"]).first()["n_tables"] == 2


def test_native_pages(spark, tmp_path):
    line = lambda block, text, *box: {"block": block, "text": text, "box": list(box)}
    page = {
        "doc_id": 1, "page_index": 2, "raw_text": "第一条 总则 甲方应按约定付款 品名 数量 甲 3",
        "lines": [line(0, "第一条", 0, 10, 30, 18), line(0, "总则", 40, 11, 60, 18), line(1, "甲方应按约定付款", 0, 30, 90, 38), line(2, "品名", 5, 102, 20, 110), line(1, " ", 0, 1, 2, 3)],
        "tables": [{"box": [0, 100, 200, 200], "rows": [["品\n名", "数量", ""], ["甲　 乙", None], ["", "", "3"]]}, {"box": [0, 300, 9, 310], "rows": [["x"]]}],
    }
    (tmp_path / "pages.json").write_text(json.dumps(page) + "\n" + json.dumps({"doc_id": 1, "page_index": 3, "raw_text": "短", "lines": [], "tables": []}))
    keys = ["doc_id", "page_index"]
    pages = J.read_pages(spark, str(tmp_path / "pages.json"))
    blocks = J.native_blocks(pages, keys)
    got = blocks.orderBy("block_ord").collect()
    assert [(r["block_id"], r["label"], r["content"]) for r in got] == [
        ("p2-native-text-0", "text", "第一条总则\n甲方应按约定付款".replace("第一条总则", "第一条总则")), ("p2-native-table-0", "table", "品名 | 数量\n甲 乙\n3"),
    ]
    diag = {r["page_index"]: r for r in J.native_diagnostics(pages, blocks, keys).collect()}
    assert diag[2]["reliable"] and diag[2]["table_count"] == 1 and not diag[3]["reliable"] and list(diag[3]["reasons"]) == [J.FEW_CHARS]
    assert Q.page_counts(J.native_diagnostics(pages, blocks, keys), ["doc_id"]).first()["n_unreliable"] == 1


def test_tails(spark, tmp_path):
    rows = [(1, 1, "running"), (1, 2, "running"), (1, 3, "done"), (1, 4, "running"), (2, 1, "pending")]
    events = spark.createDataFrame([(t, f"2026-01-01 00:0{s}:00", s, f"s{s}", 0.1, st) for t, s, st in rows], "task_id long, ts string, seq int, stage string, progress double, status string")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    seen = spark.createDataFrame([(1, 1)], "task_id long, seq int")
    assert sorted((r["task_id"], r["seq"], r["final"]) for r in E.unseen(events, seen).collect()) == [(1, 2, False), (1, 3, True), (2, 1, False)]
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    got = E.drain(E.tail_stream(stream), "tail", str(tmp_path / "c"))
    assert sorted((r["task_id"], r["seq"], r["final"]) for r in got.collect()) == [(1, 1, False), (1, 2, False), (1, 3, True), (2, 1, False)]
    assert {r["stage"]: r["mean_s"] for r in E.stage_times(events).collect()} == {"s1": 60.0, "s2": 60.0, "s3": 60.0}
    share = spark.range(1).select(E.stage_progress(F.lit("align"), F.lit(0.5)).alias("p"), E.stage_progress(F.lit("done"), F.lit(2.0)).alias("q")).first()
    assert share["p"] == pytest.approx((0.78 + 0.85) / 2) and share["q"] == 1.0


def test_settings():
    shown = config.masked({"api_key": "abcdefghijkl", "model": "m", "judge_token": "abc"})
    assert shown == {"api_key": "********ijkl", "model": "m", "judge_token": "***"}
    kept = config.merged({"api_key": "abcdefghijkl", "model": "m"}, {"api_key": "********ijkl", "model": None, "n": 3})
    assert kept == {"api_key": "abcdefghijkl", "n": 3}
    assert config.CompareConfig().updated({"semantic": "false"}).semantic is False
    assert config.checked_suffix("word", "A.DOCX") == ".docx"
    for role, name in (("word", "a.pdf"), ("pdf", "a"), ("x", "a.pdf")):
        with pytest.raises(ValueError):
            config.checked_suffix(role, name)


def test_uploads_and_logs(spark, tmp_path):
    storage.save_upload(spark, str(tmp_path), "t-1", "word", ".docx", b"abc")
    storage.save_upload(spark, str(tmp_path), "t-1", "pdf", ".pdf", b"d")
    (tmp_path / "other.txt").write_bytes(b"x")
    uploads = storage.read_uploads(spark, str(tmp_path))
    assert sorted((r["task_id"], r["role"], r["suffix"], bytes(r["content"])) for r in uploads.collect()) == [("t-1", "pdf", ".pdf", b"d"), ("t-1", "word", ".docx", b"abc")]
    assert storage.find_upload(uploads, "t-1", "word").first()["suffix"] == ".docx" and storage.find_upload(uploads, "t-2", "word").count() == 0
    url = spark.range(1).select(T.data_url(F.lit(b"png")).alias("u")).first()["u"]
    got = spark.createDataFrame([(f'{{"a": "{url}"}}',), (None,), ("no image",)], "r string").select(logs.scrubbed(F.col("r")).alias("r")).collect()
    data = url.split(",")[1]
    assert got[0]["r"] == f'{{"a": "data:image/png;length={len(data)};sha256={hashlib.sha256(data.encode()).hexdigest()}"}}'
    assert got[1]["r"] is None and got[2]["r"] == "no image"


def test_docx_tables_and_paragraphs(spark, tmp_path):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    row = lambda *cells: "<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in cells) + "</w:tr>"
    table = f"<w:tbl>{row('品名', '数量', '')}{row('', '', '')}{row('甲', '3', '')}</w:tbl>"
    (tmp_path / "a.docx").write_bytes(make_docx(p("一") + table + p("二")))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    rows = docx.read_docx(spark, str(tmp_path)).where("kind = 'table'").collect()
    assert [(r["text"], list(r["tbl"]["headers"]), [list(x) for x in r["tbl"]["rows"]]) for r in rows] == [("品名 | 数量\n甲 | 3", ["品名", "数量"], [["甲", "3"]])]
    assert [r["text"] for r in docx.read_paragraphs(spark, str(tmp_path)).orderBy("para_ord").collect()] == ["一", "二", "品名", "数量", "", "", "", "", "甲", "3", ""]
    s = docx.summary(docx.read_docx(spark, str(tmp_path)).where("kind <> 'error'"), ["path"]).first()
    assert (s["n_paragraph"], s["n_table"], s["most_rows"], s["most_columns"], s["heading_levels"]) == (2, 1, 1, 2, {})


def test_raw_gate(spark):
    texts = spark.createDataFrame([(1, "word", "a\nb\nc"), (1, "pdf", "a\nx\nc")], "pair_id long, side string, text string")
    diag = spark.createDataFrame([(1, 0, True), (1, 1, False)], "pair_id long, page_index int, reliable boolean")
    hunks, stats = gated_raw_compare(texts, diag)
    s = stats.first()
    assert hunks.count() == 1 and s["recognition_status"] == "needs_review" and list(s["unreliable_pages"]) == [2] and s["similarity_percent"] == 66.67


def test_small_functions(spark):
    row = spark.range(1).select(
        T.mask_key(F.lit("abcdefgh")).alias("key"), G.pixels(F.lit(595.0), 300).alias("px"),
        B.canonical_rows(F.array(F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("")), F.array(F.lit(""), F.lit("x"), F.lit(""), F.lit("")))).alias("rows"),
        Q.native_reliable(F.lit(20), F.lit(24), F.lit(0)).alias("good"), Q.native_reliable(F.lit(20), F.lit(40), F.lit(0)).alias("bad"), Q.native_reliable(F.lit(0), F.lit(0), F.lit(1)).alias("table"),
    ).first()
    assert row["key"].endswith("efgh") and "abcd" not in row["key"] and row["px"] == 2479
    assert [list(r) for r in row["rows"]] == [["a", "b", "c"], ["x"]] and (row["good"], row["bad"], row["table"]) == (True, False, True)
    boxes = spark.createDataFrame([(1, "b", [50.0, 1.04, 60.0, 2.0]), (1, "a", [1.0, 1.01, 2.0, 2.0]), (1, "c", [0.0, 9.0, 1.0, 10.0])], "page long, text string, box array<double>")
    assert [r["text"] for r in L.reading_order(boxes, ["page"]).orderBy("read_ord").collect()] == ["a", "b", "c"]
    kinds = spark.createDataFrame([("amount", True), ("date", False), ("breach", True)], "kind string, changed boolean")
    assert [r["kind"] for r in R.severe(kinds).collect()] == ["amount"]
    asked = S.recognise(spark.createDataFrame([(1, b"xyz")], "page_id long, image binary"), lambda image: "a" * len(image), most=3).first()
    assert (asked["reply"], asked["cut"]) == ("aaa", True)
    vectors = S.embed(spark.createDataFrame([("ab",), ("ab",), ("c",)], "t string"), "t", lambda ts: [[float(len(t))] for t in ts])
    assert sorted((r["t"], r["embedding"][0]) for r in vectors.collect()) == [("ab", 2.0), ("ab", 2.0), ("c", 1.0)]


def test_containing_and_dense_matching(spark):
    texts = [(1, "x one two three four five y"), (2, "one two three"), (3, None), (4, "prefone two three four fivesuf"), (5, "tiny"), (1, "other")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    wanted = ["one two three four five", "iny", None, "absent words are not to be found"]
    passages = spark.createDataFrame([(p,) for p in wanted], "passage string")
    want = sorted((d, t) for d, t in texts if t is not None and any(p in t for p in wanted if p))
    assert sorted(map(tuple, P.containing(docs, passages).collect())) == want
    rest = P.containing(docs, passages, how="left_anti").collect()
    assert len(rest) == len(texts) - len(want)
    rows = [(1, side, i, [float((i * 7 + k * 3 + n) % 5) for k in range(4)]) for n, side in enumerate(("word", "pdf")) for i in range(30 - 3 * n)]
    v = spark.createDataFrame([*rows, (2, "pdf", 0, [1.0, 0.0, 0.0, 0.0]), (3, "word", 0, None)], "pair_id long, side string, pos int, embedding array<double>")
    word, pdf = v.where("side = 'word'"), v.where("side = 'pdf'")
    cross = pdf.select("pair_id", F.col("pos").alias("pi"), F.col("embedding").alias("y")).join(word.select("pair_id", F.col("pos").alias("wi"), F.col("embedding").alias("x")), "pair_id")
    sims = cross.select("pair_id", "pi", "wi", F.round(G.cosine(F.col("x"), F.col("y")), 6).alias("sim"))
    sizes = spark.createDataFrame([(1, 27, 30)], "pair_id long, n_pdf int, n_word int")
    rounded = lambda df: sorted((r["pair_id"], r["pi"], r["wi"], round(r["sim"], 5)) for r in df.where("pair_id = 1").collect())
    near = sims.where("abs(pi - wi) <= 5")
    assert sorted(map(tuple, A.window_similarities(word, pdf).select("pair_id", "pi", "wi", F.round("sim", 6)).collect())) == sorted(map(tuple, near.collect()))
    best = sims.groupBy("pair_id", "pi").agg(F.max_by("wi", F.struct("sim", -F.col("wi"))).alias("wi"), F.max("sim").alias("sim"))
    assert rounded(A.best_dense(word, pdf)) == rounded(best)
    found = A.greedy_dense(word, pdf, 0.9)
    assert [r[2] is None for r in rounded(found)] == [r[2] is None for r in rounded(A.greedy(sims, sizes, 0.9))]
    assert found.where("pair_id = 2").collect()[0]["wi"] is None
