import io
import os
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from redline.config import CompareConfig
from redline.operators import align as A, clauses as C, compare as R, layout as L, locate as P, rawdiff as D, recognition as Q, tables as B
from redline.plans.compare import compare, raw_compare, with_segments
from redline.sinks import annotations as N
from redline.sources import docx, replies as S
from redline.streaming import progress as E

ITEM = "pair_id long, side string, item_ord int, kind string, heading_level int, text string"


def items(spark, word, pdf):
    rows = [(1, side, i, "paragraph", 0, t) for side, ts in (("word", word), ("pdf", pdf)) for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, ITEM)


def test_identical_is_clean(spark):
    texts = ["第一条 总则", "本合同金额100万元。", "第二条 付款", "电汇。"]
    got = compare(items(spark, texts, texts))
    assert got.reports.first()["overall_risk"] == "clean"
    assert got.diffs.where("status <> 'identical'").count() == 0


def test_amount_tamper_is_high(spark):
    got = compare(items(spark, ["第一条 金额100万元"], ["第一条 金额200万元"]))
    assert got.reports.first()["overall_risk"] == "high"
    d = got.diffs.first()
    assert (d["status"], d["risk_level"], list(d["changed_kinds"])) == ("modified", "high", ["amount"])
    segments = with_segments(got.diffs).first()["segments"]
    assert [(s["op"], s["text"]) for s in segments] == [("equal", "金额"), ("delete", "1"), ("insert", "2"), ("equal", "00万元")]


def test_tables_are_compared(spark):
    """One plain cell of a large table makes a medium change, one amount in a cell a high one, with segments; equal tables none."""
    schema = ITEM + ", tbl struct<headers: array<string>, rows: array<array<string>>>"
    rows = [[f"品名规格型号第{i}种", f"产地某某市某某区{i}"] for i in range(60)]
    cases = {1: "产地某某市某某县30", 2: rows[30][1], 3: "金额200万元"}
    made = []
    for pair, cell in cases.items():
        for side in ("word", "pdf"):
            own = [list(r) for r in rows]
            own[30][1] = cell if side == "pdf" else "金额100万元" if pair == 3 else rows[30][1]
            text = "\n".join(" | ".join(r) for r in [["品名", "产地"], *own])
            made += [(pair, side, 0, "paragraph", 0, "第一条 供货清单", None), (pair, side, 1, "table", 0, text, (["品名", "产地"], own))]
    got = compare(spark.createDataFrame(made, schema))
    assert {r["pair_id"]: (r["status"], r["risk_level"]) for r in got.diffs.collect()} == {1: ("modified", "medium"), 2: ("identical", "none"), 3: ("modified", "high")}
    assert {r["pair_id"]: r["overall_risk"] for r in got.reports.collect()} == {1: "medium", 2: "clean", 3: "high"}
    segments = {r["pair_id"]: r["segments"] for r in with_segments(got.diffs).collect()}
    alone = {r["pair_id"]: r["segments"] for r in with_segments(got.diffs.drop("w_tables", "p_tables")).collect()}
    assert set(segments) == {1, 3} and all(len(segments[p]) > len(alone[p]) for p in segments)


def test_gate_lowers_risk(spark):
    diag = spark.createDataFrame([(1, 0, False), (1, 1, True)], "pair_id long, page_index int, reliable boolean")
    got = compare(items(spark, ["第一条 金额100万元"], ["第一条 金额200万元"]), diag)
    assert got.diffs.first()["risk_level"] == "low" and R.GATE_REASON in got.diffs.first()["risk_reasons"]
    report = got.reports.first()
    assert report["overall_risk"] == "needs_review" and list(report["unreliable_pages"]) == [1]


def test_segmentation_table(spark):
    rows = [
        (0, "title", 0, "采购合同"), (1, "paragraph", 0, "甲方：A公司\n乙方：B公司"), (2, "paragraph", 0, "第一条 质量要求\n按国标。\n\n续行"), (3, "heading", 2, "无编号标题"), (4, "paragraph", 0, "付款方式：电汇"), (5, "paragraph", 0, "   "),
    ]
    df = spark.createDataFrame([(1, "word", *r) for r in rows], ITEM)
    got = [(r["level"], r["number"], r["text"], r["field_key"]) for r in C.segment(df, ["pair_id", "side"]).orderBy("clause_ord").collect()]
    assert got == [
        (1, "", "采购合同", ""), (0, "", "A公司", "甲方"), (0, "", "B公司", "乙方"), (1, "一", "质量要求\n按国标。\n续行", "section:质量要求"), (2, "", "无编号标题", ""), (1, "", "付款方式：电汇".replace("：", ":"), "section:付款方式"),
    ]


def test_signature_table_and_boxes(spark):
    schema = "doc_id long, item_ord int, kind string, heading_level int, text string, bbox array<double>, page_index int, tbl struct<headers: array<string>, rows: array<array<string>>>"
    rows = [(1, 0, "table", 0, "t", [0.0, 0.0, 1.0, 1.0], 0, (["甲方:A", "乙方:B"], [["日期:1", ""]])), (1, 1, "paragraph", 0, "第一条 a\nb", [10.0, 20.0, 210.0, 100.0], 0, None)]
    got = C.segment(spark.createDataFrame(rows, schema), ["doc_id"]).orderBy("clause_ord").collect()
    assert [r["field_key"] for r in got] == ["甲方", "乙方", "日期", ""]
    assert [list(b["bbox"]) for b in got[3]["boxes"]] == [[10, 20, 210, 60], [10, 60, 210, 100]]


def test_alignment_is_a_partial_bijection(spark):
    rng = random.Random(3)
    rows = []
    for pair in range(20):
        for side in ("word", "pdf"):
            for i in range(rng.randint(0, 7)):
                rows.append((pair, side, i + 1, rng.choice(["", "1", "2"]), 1, rng.choice(["", "甲方"]), "", "条款" + rng.choice("甲乙丙丁") * 3))
    c = spark.createDataFrame(rows, "pair_id long, side string, clause_ord int, number string, level int, field_key string, title string, text string")
    got = A.align(c, 0.5).collect()
    for side in ("word", "pdf"):
        seen = sorted((r["pair_id"], r[f"{side}_clause_ord"]) for r in got if r[f"{side}_clause_ord"] is not None)
        assert seen == sorted((r[0], r[2]) for r in rows if r[1] == side)
    for pair in {r["pair_id"] for r in got}:
        assert sorted(r["align_idx"] for r in got if r["pair_id"] == pair) == list(range(sum(r["pair_id"] == pair for r in got)))


def test_assign_prefers_window_then_global():
    s = np.zeros((2, 9))
    s[0, 8], s[0, 1], s[1, 8] = 0.95, 0.8, 0.9
    pi, wi = np.nonzero(s)
    assert A.assign(pi, wi, s[pi, wi], 2, 9, 0.7, 5) == [(0, 1, 0.8), (1, 8, 0.9)]
    assert A.assign(pi, wi, s[pi, wi], 2, 9, 0.85, 5)[0] == (0, 8, 0.95)
    assert A.assign(np.zeros(0, int), np.zeros(0, int), np.zeros(0), 1, 0, 0.7, 5) == [(0, None, 0.0)]


def test_covered_fragment(spark):
    rows = [(1, "word", 1, "1", 1, "", "", "付款方式为电汇"), (1, "word", 2, "", 0, "", "", "三十日内付清"), (1, "pdf", 1, "1", 1, "", "", "付款方式为电汇三十日内付清")]
    c = spark.createDataFrame(rows, "pair_id long, side string, clause_ord int, number string, level int, field_key string, title string, text string")
    assert A.covered(A.align(c, 0.99), c).count() == 1


def brute_anchors(word, pdf):
    out, last = [], -1
    for i, line in enumerate(word):
        if word.count(line) == 1 and pdf.count(line) == 1 and (j := pdf.index(line)) > last:
            out.append((i, j))
            last = j
    return out


def test_anchors_and_hunks(spark):
    rng = random.Random(5)
    texts, rows = {}, []
    for pair in range(15):
        for side in ("word", "pdf"):
            texts[pair, side] = [rng.choice("abcdefghij") for _ in range(rng.randint(1, 12))]
            rows.append((pair, side, "\n".join(texts[pair, side])))
    df = spark.createDataFrame(rows, "pair_id long, side string, text string")
    lines = D.to_lines(df, ["pair_id", "side"])
    found = D.anchors(lines)
    got = {p: [(r["word_ord"], r["pdf_ord"]) for r in sorted(found.where(F.col("pair_id") == p).collect(), key=lambda r: r["word_ord"])] for p in range(15)}
    assert got == {p: brute_anchors(texts[p, "word"], texts[p, "pdf"]) for p in range(15)}
    hunks, stats = raw_compare(df)
    for s in stats.collect():
        hs = [h for h in hunks.collect() if h["pair_id"] == s["pair_id"]]
        lost = sum(len(h["word_lines"]) for h in hs)
        assert s["equal_lines"] == s["word_lines"] - lost == s["pdf_lines"] - sum(len(h["pdf_lines"]) for h in hs)
    same = raw_compare(spark.createDataFrame([(1, "word", "a\nb"), (1, "pdf", "a\nb")], "pair_id long, side string, text string"))
    assert same[0].count() == 0 and same[1].first()["similarity"] == 1.0


def test_char_refinement_and_context(spark):
    df = spark.createDataFrame([(1, "word", "甲\n金额1\n乙"), (1, "pdf", "甲\n金额2\n乙")], "pair_id long, side string, text string")
    h = raw_compare(df)[0].first()
    assert h["tag"] == "replace" and [(s["op"], s["text"]) for s in h["char_segments"]] == [("equal", "金额"), ("delete", "1"), ("insert", "2")]
    assert (list(h["context_before"]), list(h["context_after"])) == (["甲"], ["乙"])
    assert raw_compare(df, CompareConfig(char_level=False))[0].first()["char_segments"] == []


def test_delimited_tables(spark):
    cases = [("| a | b |\n|---|---|\n| 1 |  |", ["a", "b"], [["1", ""]]), ("h | k\n" + "x | y\n" * 5 + "z | w", ["h", "k"], [["x", "y"], ["z", "w"]]), ("only", None, None)]
    for text, heads, rows in cases:
        got = spark.createDataFrame([(text,)], "x string").select(B.delimited_table(F.col("x")).alias("t")).first()["t"]
        if heads is None:
            assert got is None
        else:
            assert list(got["headers"]) == heads
            assert [list(r) for r in got["rows"]] == rows


def test_first_change_order(spark):
    schema = "pair_id long, table_index int, tbl struct<headers: array<string>, rows: array<array<string>>>"
    w = spark.createDataFrame([(1, 0, (["a", "b"], [["1", "2"], ["3", "4"]])), (2, 0, (["a"], [])), (3, 0, (["a"], [["x"]]))], schema)
    p = spark.createDataFrame([(1, 0, (["a", "b"], [["1", ""], ["9", "4"]])), (2, 0, (["c"], [])), (3, 0, (["a"], [["x"]])), (4, 0, (["z"], []))], schema)
    got = {r["pair_id"]: (r["change"], r["row_index"], r["col_index"]) for r in B.first_change(w, p, ["pair_id"]).collect()}
    assert got == {1: ("cell_missing", 0, 1), 2: ("header", -1, -1), 4: ("table_added", -1, -1)}


def test_layout(spark):
    frags = [(1, 0, "名称", [0.0, 10.0, 20.0, 18.0]), (1, 1, "abc", [30.0, 12.0, 50.0, 20.0]), (1, 2, "def", [60.0, 13.0, 80.0, 20.0]), (1, 3, "下行", [0.0, 30.0, 10.0, 38.0])]
    rows = L.visual_rows(spark.createDataFrame(frags, "page long, frag_ord int, text string, box array<double>"), ["page"])
    assert [r["text"] for r in L.join_rows(rows, ["page"]).orderBy("row_ord").collect()] == ["名称abc def", "下行"]
    lines = spark.createDataFrame([(1, 0, "1. 短", [0.0, 0.0, 1.0, 1.0]), (1, 1, "接上", [0.0, 1.0, 2.0, 2.0]), (1, 2, "2. 另起", [0.0, 2.0, 1.0, 3.0])], "page long, line_ord int, text string, box array<double>")
    assert [r["text"] for r in L.merge_continuations(lines, ["page"]).orderBy("line_ord").collect()] == ["1. 短\n接上", "2. 另起"]


def test_fallback_quality(spark):
    schema = "page long, content string, tbl struct<headers: array<string>, rows: array<array<string>>>"
    rows = [(1, "短", None), (2, "重复的一行\n" * 4 + "足够多的字符", None), (3, "足够多的字符在这里", (["a", "b"], [["1"]])), (4, "足够多的字符在这里", None), (5, "足够多的字符在这里", (["a"], []))]
    got = {r["page"]: (r["reliable"], len(r["reasons"])) for r in Q.fallback_quality(spark.createDataFrame(rows, schema), ["page"]).collect()}
    assert got == {1: (False, 1), 2: (False, 1), 3: (False, 1), 4: (True, 0), 5: (False, 1)}


def test_locate(spark):
    ps = spark.createDataFrame([(1, 0, "3.2 交货地点在上海"), (1, 1, "3.21 其他"), (1, 2, "违约责任按约定执行"), (1, 3, "无关内容")], "pair_id long, para_ord int, text string")
    ts = spark.createDataFrame([(1, 0, "3.2", "交货"), (1, 1, "", "违约责任按约定"), (1, 2, "", "zzzz")], "pair_id long, target_id int, number string, text string")
    got = {r["target_id"]: r["para_ord"] for r in P.locate(ts, ps).collect()}
    assert got == {0: 0, 1: 2, 2: None}


def make_docx(body):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {ns}><w:style w:styleId="H2"><w:name w:val="Heading 2"/></w:style></w:styles>')
    return out.getvalue()


def test_docx_round_trip(spark, tmp_path):
    p = lambda t, s="": f"<w:p>{s}<w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('品名')}{cell('数量')}</w:tr><w:tr>{cell('甲')}{cell('3')}</w:tr></w:tbl>"
    content = make_docx(p("标题", '<w:pPr><w:pStyle w:val="H2"/></w:pPr>') + p(" ") + p("正文") + table)
    (tmp_path / "a.docx").write_bytes(content)
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    rows = docx.read_docx(spark, str(tmp_path)).orderBy("path", "item_ord").collect()
    assert [(r["kind"], r["heading_level"], r["text"]) for r in rows[:3]] == [("heading", 2, "标题"), ("paragraph", 0, "正文"), ("table", 0, "品名 | 数量\n甲 | 3")]
    assert rows[3]["kind"] == "error"
    shaded = N.shade_paragraphs(N.shade_paragraphs(content, {0: "FFEB3B"}), {0: "FFCDD2"})
    xml = zipfile.ZipFile(io.BytesIO(shaded)).read("word/document.xml").decode()
    assert xml.count("FFCDD2") == 1 and "FFEB3B" not in xml
    assert [i["text"] for i in docx.parse(shaded)] == [i["text"] for i in docx.parse(content)]


def test_replies(spark):
    reply = '好的\n```json\n{"items": [{"label": "table", "content": "", "table": {"headers": ["a", "", "b"], "rows": [["1\\n2", "3"], "x"]}, "box": [1, 2, 3, 4]}, "junk", {"text": " "}]}\n```'
    df = spark.createDataFrame([(1, reply), (2, "not json"), (3, '[{"text": "hi"}]')], "page long, reply string")
    got = {r["page"]: r for r in S.reply_blocks(df, ["page"]).collect()}
    assert set(got) == {1, 3} and got[3]["content"] == "hi" and got[3]["label"] == "text"
    assert list(got[1]["tbl"]["headers"]) == ["a", "b"] and [list(r) for r in got[1]["tbl"]["rows"]] == [["1 2", "3"]] and list(got[1]["bbox"]) == [1, 2, 3, 4]
    assert S.parse_html("<p>a&amp;b<br>c</p><table><tr><th>x</th><td>y</td></tr></table>tail<script>no</script>") == [("text", "a&b c", None), ("table", "x | y", [["x", "y"]]), ("text", "tail", None)]


def test_streams_equal_batch(spark, tmp_path):
    rows = [(1, "2026-01-01 00:00:00", 1, "align", 0.1, "running"), (1, "2026-01-01 00:01:00", 2, "done", 1.0, "done"), (1, "2026-01-01 00:02:00", 3, "late", 0.5, "running"), (2, "2026-01-02 00:00:00", 1, "align", 0.2, "pending")]
    batch = spark.createDataFrame(rows, "task_id long, ts string, seq int, stage string, progress double, status string").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = lambda: spark.readStream.schema(batch.schema).parquet(str(tmp_path / "e"))
    got = E.drain(E.latest(stream()), "latest", str(tmp_path / "c1"), "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, E.latest(batch).collect()))
    got = E.drain(E.monotone_stream(stream()), "monotone", str(tmp_path / "c2"))
    assert sorted((r["task_id"], r["seq"]) for r in got.collect()) == sorted((r["task_id"], r["seq"]) for r in E.monotone(batch).collect()) == [(1, 1), (1, 2), (2, 1)]


def test_config():
    c = CompareConfig().updated({"neighbourhood": "3", "semantic": None})
    assert c.neighbourhood == 3 and c.semantic is True
    for bad in ({"nope": 1}, {"render_dpi": 20}):
        with pytest.raises(ValueError):
            CompareConfig().updated(bad)


def test_contracts_by_pair_are_the_rows_of_their_sql(spark):
    from redline import fixtures as X

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("driver tables")
    by_sql, by_pair = X.rows(spark, sf, X.CONTRACTS), X.rows(spark, sf, X.CONTRACTS_BY_PAIR)
    assert by_sql.columns == by_pair.columns
    assert sorted(map(repr, by_sql.collect())) == sorted(map(repr, by_pair.collect()))


def test_a_comparison_read_once_deals_its_lines_once_and_writes_no_checkpoint(spark, tmp_path):
    from redline import fixtures as X
    from redline.plans.compare import compare_clauses

    line = "1L l_orderkey, 1L l_partkey, 1L l_suppkey, 1 l_linenumber, 1D l_quantity, 1D l_extendedprice, 0D l_discount, 0D l_tax, 'N' l_returnflag, 'O' l_linestatus, timestamp_ntz'1996-01-01 00:00:00' l_shipdate"
    spark.sql(f"select {line}").write.parquet(f"{tmp_path}/lineitem.parquet")
    diffs = compare_clauses(X.rows(spark, str(tmp_path), X.CONTRACTS_BY_PAIR), keep=False).diffs
    plan = diffs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert diffs.select("status").first()[0] == "identical"


def test_marked_pairs_are_the_rows_of_their_sql_and_no_line_travels(spark):
    from redline import fixtures as X

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("driver tables")
    marked = X.rows(spark, sf, X.MARKED_PAIRS)
    assert sorted(map(tuple, marked.collect())) == sorted(map(tuple, X.rows(spark, sf, X.DOCUMENT_PAIRS).collect()))
    assert dict(X.rows(spark, sf, "SELECT explode({line_marks}) AS m FROM {documents}").dtypes) == {"m": "struct<a:bigint,b:bigint>"}


def test_documents_with_common_lines_pair_as_by_brute_force(spark, monkeypatch, tmp_path):
    """Copies, sets within sets, items of a few and of nearly all, over several levels; and the rows of the pairs' SQL where all documents have two lines."""
    from redline import fixtures as X

    for seed, few in ((1, 2), (2, 3), (3, 100)):
        monkeypatch.setattr(D, "OFTEN", few)
        rng = random.Random(seed)
        sets = {d: {int(rng.expovariate(0.2)) if rng.random() < 0.8 else rng.randrange(100) for _ in range(rng.randint(1, 7))} for d in rng.sample(range(1000), 150)}
        want = {d: min([(-len(s & sets[b]), b) for b in sets if b < d and len(s & sets[b]) > 1], default=None) for d, s in sets.items()}
        got = D.most_shared(spark.createDataFrame([(d, sorted(s)) for d, s in sets.items()], "doc long, set array<long>")).collect()
        assert sorted((r["doc"], (-r["n"], r["base"])) for r in got) == sorted((d, x) for d, x in want.items() if x)
    lines = [f"this is the common line number {i}" for i in range(12)]
    text = lambda d: None if d == 7 else "\n".join([*lines[:2], *rng.sample(lines, d % 4), f"a line that two documents have, {d // 2}", "short", "short"][d % 5 == 4 :])
    docs = [(d, text(d)) for d in range(60)]
    spark.createDataFrame([*docs, (70, docs[30][1]), (71, docs[30][1]), (None, docs[31][1])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(D, "OFTEN", 5)
    pairs = X.document_pairs(spark, str(tmp_path))
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, X.rows(spark, str(tmp_path), X.DOCUMENT_PAIRS).collect()))


def odd_sides(spark, seed):
    """Two texts of each pair: repeated and crossing lines, blanks, empty and null texts, a side without a text, one that stands twice."""
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma 1", "gamma 2", "付款", "  付款方式", "ß", "", "12"]
    text = lambda: rng.choice([None, "", "\n", " "]) if rng.random() < 0.1 else "\r\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(0, 9)))
    rows = [(k, side, text()) for k in range(120) for side in ("word", "pdf") if k % 40 or side == "word"]
    return spark.createDataFrame(rows, "pair_id long, side string, text string")


def same_rows_in_one_exchange(got, want):
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Generate" not in plan
    assert got.dtypes == want.dtypes and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def marked(sides):
    return sides.select("pair_id", "side", *D.line_marks(F.col("text")))


def test_paired_bags_are_the_similarities_of_exploded_terms(spark):
    sides = odd_sides(spark, 6)
    sides = sides.unionByName(sides.where("pair_id = 3"))  # a document that stands twice
    both = sides.withColumn("pos", F.lit(0))
    want = A.bag_similarities(both.where("side = 'word'"), both.where("side = 'pdf'"))
    same_rows_in_one_exchange(D.paired_bags(sides).withColumn("sim", F.round("sim", 9)), want.select("pair_id", F.round("sim", 9).alias("sim")))


def test_paired_similarity_is_that_of_the_multisets(spark):
    sides = odd_sides(spark, 2)
    sides = sides.unionByName(sides.where("pair_id = 3"))  # a document that stands twice
    same_rows_in_one_exchange(D.paired_similarity(marked(sides)), D.multiset_similarity(D.to_lines(sides, ["pair_id", "side"], unicode=False)))


def test_paired_hunks_are_those_with_context(spark):
    sides = odd_sides(spark, 5)
    lines = D.to_lines(sides, ["pair_id", "side"], unicode=False)
    got = D.paired_hunks(sides.select("pair_id", "side", *D.whole_lines(F.col("text"))))
    same_rows_in_one_exchange(got, D.with_context(D.hunks(D.gap_table(lines, D.anchors(lines))), lines).select(*got.columns))


def test_paired_gap_table_is_that_of_the_lines(spark):
    sides = odd_sides(spark, 4)
    lines = D.to_lines(sides, ["pair_id", "side"], unicode=False)
    want, texts = D.gap_table(lines, D.anchors(lines)), sides.select("pair_id", "side", *D.whole_lines(F.col("text")))
    same_rows_in_one_exchange(D.paired_gap_table(texts), want)
    same_rows_in_one_exchange(D.paired_gap_table(texts, ("insert", "delete")), want.where("kind <> 'both'"))


def test_paired_anchors_are_the_anchors_of_the_lines(spark):
    sides = odd_sides(spark, 1)
    same_rows_in_one_exchange(D.paired_anchors(marked(sides)), D.anchors(D.to_lines(sides, ["pair_id", "side"], unicode=False)))


def test_paired_statistics_are_those_of_the_hunks(spark):
    sides = odd_sides(spark, 3)
    lines = D.to_lines(sides, ["pair_id", "side"], unicode=False)
    found = D.anchors(lines)
    same_rows_in_one_exchange(D.paired_statistics(marked(sides)), D.line_statistics(D.hunks(D.gap_table(lines, found), False), found, lines))


def test_compact_keys_joins_its_pairs_to_the_texts_alone(spark):
    """Lines that documents share are not joined in its plan; before, they were for all documents with two common ones."""
    from redline.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("driver tables")
    plan = QUERIES["compact_keys"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 1


def test_gap_classes_deals_marks_twice_and_joins_its_pairs_to_them_alone(spark):
    from redline.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("driver tables")
    plan = QUERIES["gap_classes"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Exchange hashpartitioning") <= 3 and "Generate explode(transform" not in plan


def test_brief_verdicts_are_those_of_the_whole_comparison(spark):
    """Odd keys and texts: repeated numbers, fields, covered fragments, null texts and pairs, blanks, values that no single run of digits decides."""
    from redline.functions import values as V
    from redline.functions.kernels import normal_text
    from redline.plans.compare import compare_briefly, compare_clauses

    rng = random.Random(5)
    parts = ["供货", "12,345.67元", " ", "1996年3月13日", "４%", "百分之五", "¥ 12万元", "壹佰元整", "违约", "3 个 工作日", "2020-1-2", "12", "元", "　", "\r\n\n", "abc", "法院", "30天", "。", ""]
    text = lambda: None if rng.random() < 0.05 else "".join(rng.choice(parts) for _ in range(rng.randint(0, 7)))
    rows = []
    for pair in [None, *range(150)]:
        base = [text() for _ in range(6)]
        for side in ("word", "pdf"):
            for n in range(rng.randint(0, 6)):
                t = base[n] if rng.random() < 0.5 else text()
                rows.append((pair, side, n + 1, rng.choice(["1", "2", "3", "", None]), rng.choice([1, 1, 2, None]), rng.choice(["日期", "", None]), "t", t))
    clauses = spark.createDataFrame(rows, "pair_id long, side string, clause_ord int, number string, level int, field_key string, title string, text string")
    columns = ["pair_id", "align_idx", "status", "risk_level", "number", "changed_kinds", "risk_reasons"]
    want = sorted(map(repr, compare_clauses(clauses).diffs.select(*columns).collect()))  # texts made normal by built-ins, values found by them
    got = compare_briefly(clauses)
    assert want and sorted(map(repr, got.select(*columns).collect())) == want
    together = compare_briefly(clauses.coalesce(1).sort("pair_id"), together=True)
    assert sorted(map(repr, together.select(*columns).collect())) == want
    pairs = [(text() or "", text() or "") for _ in range(3000)]
    df = spark.createDataFrame([(normal_text(a), normal_text(b)) for a, b in pairs], "a string, b string")
    for r in df.select("*", *[(V.of_kind(F.col("a"), k) != V.of_kind(F.col("b"), k)).alias(k) for k in V.KINDS]).collect():
        assert V.changed_kinds(r["a"], r["b"]) == [k for k in V.KINDS if r[k]], r


def test_texts_of_one_form_are_searched_once(monkeypatch):
    """Values of texts that differ in digits alone are compared by place, as a search of each text has them; blanks, other digits and lone forms included."""
    import pyarrow as pa

    from redline.functions import values as V

    rng = random.Random(11)
    parts = ["供货", "{}2,3{}5.67元", "{}9{}6年{}月1{}日", "{}%", "百分之五", "百分之{}", "¥ {}万元", "壹佰元整", "违约", "{} 个 工作日", "20{}0-{}-2", "{}", "٣天", "４{}%", "仲裁", ",", "V" * 600]
    made = [("".join(rng.choices(parts, k=rng.randint(0, 4))), "".join(rng.choices(parts, k=rng.randint(0, 4)))) for _ in range(300)]
    made += [(a, a) for a, _ in made]
    fill = lambda t: "".join(rng.choice("129") if c == "{" else c for c in t if c != "}")
    pairs = [(fill(a), fill(b)) for a, b in made for _ in range(rng.randint(1, 4))]
    want = [V.changed_kinds(a, b) for a, b in pairs]
    got = V.changed_kinds_of(*(pa.array(["", *x]).slice(1) for x in zip(*pairs, strict=True)))
    assert got == want and {k for x in got for k in x} == set(V.KINDS) - {"effective"}
    assert V.changed_kinds_of(pa.array([], pa.string()), pa.array([], pa.string())) == []

    def never(*_):
        raise AssertionError("searched again")

    monkeypatch.setattr(V, "changed_kinds", never)
    years = pa.array([f"供货金额{n}00.25元,交货1996年3月13日,折扣4%" for n in range(10, 90)])
    later = pa.array([f"供货金额{n}00.25元,交货199{n % 10}年3月13日,折扣4%" for n in range(10, 90)])
    assert V.changed_kinds_of(years, later) == [["date"] if n % 10 != 6 else [] for n in range(10, 90)]
    assert all(len({r.translate(str.maketrans("123456789", "0" * 9)) for r in p}) == 1 for p in zip(years.to_pylist(), V.forms(years).to_pylist(), strict=True))


def test_leftovers_of_one_side_alone_take_no_turn(monkeypatch):
    """Clauses whose pair has nothing on the other side, or that have no pair, are unmatched without a look at their texts."""
    import pyarrow as pa

    rows = [(1, "pdf", 1, "1", "甲"), (1, "pdf", 2, "", "乙"), (1, "word", 1, "1", "甲"), (2, "word", 1, "1", "丙"), (2, "word", 2, "", "丁"), (None, "pdf", 1, "1", "戊"), (None, "word", 1, "1", "戊")]
    pair, side, order, number, text = (pa.array(x) for x in zip(*rows, strict=True))
    col = {"pair_id": pair, "side": side, "clause_ord": order.cast(pa.int32()), "number": number, "level": pa.array([1] * 7, pa.int32()), "field_key": pa.array([""] * 7), "text": text}
    monkeypatch.setattr(A, "_left", None)
    w, p, kind, similarity, _, index = A.aligned(col, 0.7, 5, True, 4)
    got = list(zip(w.tolist(), p.tolist(), [A.KINDS[k] for k in kind], similarity.tolist(), index.tolist(), strict=True))
    assert got == [(2, 0, "number", 1.0, 0), (-1, 1, "unmatched", 0.0, 1), (3, -1, "unmatched", 0.0, 0), (4, -1, "unmatched", 0.0, 1), (-1, 5, "unmatched", 0.0, 0), (6, -1, "unmatched", 0.0, 1)]


def test_few_leftovers_meet_as_many_do(monkeypatch):
    """Bags that meet directly give the places and similarities that an index of terms gives, empty and null texts included."""
    rng = random.Random(13)
    words = ["付款", "交货", "ABC", "12", "3", "", "é", "x"]
    some = lambda: [rng.choice([None, "", " ".join(rng.choices(words, k=rng.randint(1, 8)))]) for _ in range(rng.randint(1, 4))]
    cases = [(some(), some(), rng.choice([0.0, 0.3, 0.7])) for _ in range(400)]
    few = [A._nearest(w, p, t, 1) for w, p, t in cases]
    monkeypatch.setattr(A, "FEW", 0)
    assert [A._nearest(w, p, t, 1) for w, p, t in cases] == few
    assert any(w is not None for x in few for w, _ in x)


def test_verdicts_of_contracts_send_no_text_on(spark):
    """The lines are dealt out once, and no value pattern or bag is looked for outside the task that matches them."""
    from redline.queries import QUERIES

    plan = QUERIES["status_histogram"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "regexp" not in plan and plan.count("Exchange hashpartitioning(pair_id") == 1 and plan.count("Sort [pair_id") <= 1


def test_places_and_previews_by_brute_force(spark):
    """Repeated and long numbers, blanks, null texts and pairs; beginnings of paragraphs are not dealt out."""
    from redline.functions.kernels import longest_common_substring

    rng = random.Random(8)
    bits = ["1", "2", "1.2", "、", "付款", "交货", " ", "验收合格", "A", "9" * 30]
    some = lambda n: None if rng.random() < 0.05 else "".join(rng.choice(bits) for _ in range(rng.randint(0, n)))
    ps = [(k, i, some(6)) for k in [None, *range(60)] for i in range(rng.randint(0, 5))]
    ts = [(k, i, rng.choice(["1", "2", "1.2", "9" * 30, "", " ", None]), some(5), f"s{i}", f"r{i}") for k in [None, *range(60)] for i in range(rng.randint(0, 5))]
    tight = lambda x: "".join((x or "").split())

    def hits(k, number):
        n, found = tight(number), [(o, tight(x)) for q, o, x in ps if q is not None and q == k]
        follows = lambda c: c[len(n) : len(n) + 1].isascii() and c[len(n) : len(n) + 1].isalnum()
        return found, [(o, c) for o, c in found if n and c.startswith(n) and not follows(c)]

    def place(k, number, text):
        found, numbered = hits(k, number)
        t = tight(text)
        ratio = lambda c: longest_common_substring(c, t) / min(len(c), len(t)) if c and t else 0.0
        if len(numbered) == 1:
            return numbered[0][0]
        best = max(((ratio(c), -o) for o, c in numbered or found), default=None)
        return -best[1] if best and (numbered or best[0] >= 0.5) else None

    pdf = spark.createDataFrame(ps, "pair_id long, para_ord int, text string")
    tdf = spark.createDataFrame(ts, "pair_id long, target_id int, number string, text string, status string, risk_level string")
    got = {(r["pair_id"], r["target_id"], r["para_ord"], r["n"]) for r in P.numbered_candidates(tdf, pdf).collect()}
    assert got == {(k, i, o, len(hits(k, n)[1])) for k, i, n, *_ in ts for o, _ in hits(k, n)[1]} and got
    want = {(k, i): place(k, n, x) for k, i, n, x, *_ in ts}
    placed = P.locate(tdf, pdf)
    assert {(r["pair_id"], r["target_id"]): r["para_ord"] for r in placed.collect()} == want and placed.count() == len(ts)
    shown = sorted(map(repr, P.preview(pdf, tdf, placed).collect()))
    rows = P.roles(tdf, pdf).join(tdf.select("pair_id", F.lit("target").alias("role"), F.col("target_id").alias("ord"), "status", "risk_level"), ["pair_id", "role", "ord"], "left")
    rows = rows.drop("n").coalesce(1).sort("pair_id")
    assert sorted(map(repr, P.previewed(rows).collect())) == shown
    from redline.queries import QUERIES

    for name in ("locate_prefix", "locate_lcs", "preview_rows"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan


def test_gap_sizes_are_those_of_the_gap_table(spark):
    """Repeated and crossing lines, empty and null texts, a side without a text; lines are not dealt out by themselves."""
    rng = random.Random(4)
    text = lambda: rng.choice([None, "", "\n"]) if rng.random() < 0.1 else "\n".join(rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(rng.randint(0, 12)))
    texts = spark.createDataFrame([(k, side, text()) for k in range(200) for side in ("word", "pdf") if k % 50 or side == "word"], "pair_id long, side string, text string")
    lines = D.to_lines(texts, ["pair_id", "side"], unicode=False)
    table = D.gap_table(lines, D.anchors(lines)).select("pair_id", "gap", "kind", F.size("word_lines").cast("long").alias("n_word"), F.size("pdf_lines").cast("long").alias("n_pdf"))
    got = D.gap_sizes(texts.select("pair_id", "side", *D.line_marks(F.col("text"))))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan
    assert got.dtypes == table.dtypes and sorted(got.collect()) == sorted(table.collect())


def test_lines_with_two_sides_are_judged_as_their_clauses(spark, tmp_path):
    """Prices that are no whole cents, negative or large, and null keys included; a text that both sides have travels once, and counts alone leave the task."""
    from redline import fixtures as X
    from redline.plans.compare import compare_briefly, compare_clauses

    rng = random.Random(17)
    prices = [84197.04, 0.0, 0.005, 1.005, 2.675, -5.25, -0.004, 99.995, 123456789012.34, 3e13, 0.1 + 0.2, 100.0, None]
    rows = [(rng.choice([None, *range(0, 190, 19), 1, 2]), rng.choice([0, 10, 13, 23, 29, 31, 46, 130, 299, 7, 8, 9, None]), rng.randint(0, 20), rng.choice([1, 2, 3, None]), float(rng.randint(1, 50)), rng.choice(prices),
             rng.randint(0, 10) / 100, i / 1000, "N", "O", f"199{i % 10}-{1 + i % 12:02}-{1 + i % 28:02} 00:00:00") for i in range(400)]
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, day string"
    lines = spark.createDataFrame(rows, kinds).withColumn("l_shipdate", F.col("day").cast("timestamp_ntz")).drop("day")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    made = {name: X.rows(spark, str(tmp_path), getattr(X, name)) for name in ("CONTRACTS", "CONTRACTS_BY_PAIR", "CONTRACTS_FOLDED")}
    assert sorted(map(repr, made["CONTRACTS"].collect())) == sorted(map(repr, made["CONTRACTS_BY_PAIR"].collect()))
    columns = ["pair_id", "align_idx", "status", "risk_level", "number", "changed_kinds"]
    want = compare_clauses(made["CONTRACTS"]).diffs.select(*columns)
    got = compare_briefly(made["CONTRACTS_FOLDED"], together=True).select(*columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    counts = A.verdict_counts(made["CONTRACTS_FOLDED"], together=True)
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, want.groupBy("status", "risk_level").count().collect()))
    assert made["CONTRACTS_FOLDED"].where("p_text = w_text").count() == 0
    with pytest.raises(ValueError):
        A.verdicts(made["CONTRACTS_FOLDED"])


def test_tables_of_whole_pairs_have_the_size_that_is_asked():
    import pyarrow as pa

    rng = random.Random(19)
    pairs = sorted(rng.randint(0, 40) for _ in range(300)) + [None] * 5
    batches = [pa.RecordBatch.from_pydict({"p": pa.array(pairs[i : i + 7], pa.int64()), "i": list(range(i, min(i + 7, len(pairs))))}) for i in range(0, len(pairs), 7)]
    for rows, size in ((1, 0), (50, 1 << 30), (1 << 30, 1 << 30), (1 << 30, 400)):
        tables = list(A.whole_pairs(iter(batches), rows, size))
        assert [x for t in tables for x in t.column("i").to_pylist()] == list(range(len(pairs)))
        seen = [set(t.column("p").to_pylist()) for t in tables]
        assert sum(map(len, seen)) == len(set(pairs))
    assert len(list(A.whole_pairs(iter(batches), 1 << 30, 1 << 30))) == 1 and all(t.num_rows >= 50 for t in list(A.whole_pairs(iter(batches), 50, 1 << 30))[:-1])


def test_severity_is_ordered_in_the_task_that_judges(spark):
    """As ``by_severity`` orders the verdicts, null pairs included; nothing is dealt out again for it."""
    from redline.operators import compare as R
    from redline.queries import QUERIES

    rng = random.Random(23)
    texts = ["供货100元", "供货200元", "付款30天", "甲乙丙丁", "甲乙丙丁。", "违约", ""]
    rows = [(pair, side, n, rng.choice(["1", "2", "3", ""]), 1, rng.choice(["日期", ""]), rng.choice(texts)) for pair in [None, *range(60)] for side in ("word", "pdf") for n in range(1, rng.randint(1, 6))]
    clauses = spark.createDataFrame(rows, "pair_id long, side string, clause_ord int, number string, level int, field_key string, text string")
    want = R.by_severity(A.verdicts(clauses).where("status <> 'identical'")).select("pair_id", "align_idx", "risk_level", "severity_ord")
    got = A.severities(clauses)
    assert got.schema.names == want.schema.names and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) != []
    plan = QUERIES["severity_sorted"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
