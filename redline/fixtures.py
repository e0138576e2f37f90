"""Deterministic document pairs derived from the driver's tables.

Each is one SQL text that Spark and DuckDB both read, so that a query and its
oracle start from the same rows; ``{name}`` stands for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from redline.lineage import materialized
from redline.operators.rawdiff import most_shared

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


def _text(amount: str, year: str, pct: str, qty: str) -> str:
    return (
        f"'供货金额' || CAST({amount} AS STRING) || '元,交货' || CAST({year} AS STRING) || '年' || CAST(month(l_shipdate) AS STRING) || '月' || "
        f"CAST(day(l_shipdate) AS STRING) || '日,折扣' || CAST({pct} AS STRING) || '%,数量' || CAST({qty} AS STRING) || '件' || "
        "CASE WHEN qty > 40 THEN ',违约金另计' ELSE '' END"
    )


#: Orders as contracts: one clause for each line; the pdf side is altered by rules on part and supplier.
CONTRACTS = f"""
WITH base AS (
  SELECT l_orderkey AS pair_id, l_linenumber, l_partkey, l_suppkey, l_orderkey, l_shipdate, CAST(l_quantity AS INT) AS qty,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS amt, CAST(round(l_discount * 100) AS INT) AS pct,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS ord
  FROM {{lineitem}}
),
altered AS (
  SELECT *, CASE WHEN l_partkey % 10 = 0 THEN amt + 100 ELSE amt END AS amt2, year(l_shipdate) + CASE WHEN l_partkey % 13 = 0 THEN 1 ELSE 0 END AS year2,
         pct + CASE WHEN l_suppkey % 7 = 0 THEN 1 ELSE 0 END AS pct2, qty + CASE WHEN l_partkey % 31 = 0 THEN 1 ELSE 0 END AS qty2
  FROM base WHERE (l_partkey + l_suppkey) % 17 <> 0
),
pdf AS (
  SELECT pair_id, ord, CASE WHEN l_partkey % 23 = 0 OR l_partkey % 29 = 0 THEN '' ELSE CAST(l_linenumber AS STRING) END AS number,
         CASE WHEN l_partkey % 23 = 0 THEN '日期' ELSE '' END AS field_key, {_text("amt2", "year2", "pct2", "qty2")} AS text
  FROM altered
  UNION ALL
  SELECT pair_id, 1000 AS ord, '99' AS number, '' AS field_key, '补充条款第' || CAST(pair_id AS STRING) || '号,争议提交仲裁' AS text
  FROM base WHERE l_orderkey % 19 = 0 AND ord = 1
)
SELECT pair_id, 'word' AS side, CAST(ord AS INT) AS clause_ord, CASE WHEN l_partkey % 23 = 0 THEN '' ELSE CAST(l_linenumber AS STRING) END AS number, 1 AS level,
       CASE WHEN l_partkey % 23 = 0 THEN '日期' ELSE '' END AS field_key, CAST(l_linenumber AS STRING) AS title, {_text("amt", "year(l_shipdate)", "pct", "qty")} AS text
FROM base
UNION ALL
SELECT pair_id, 'pdf' AS side, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY ord) AS INT) AS clause_ord, number, 1 AS level, field_key, number AS title, text
FROM pdf
"""

def _cents(more: int) -> str:
    """The price and ``more`` as text, from the cents where a price has them: the decimal of any other price is slow to make and to write."""
    c, d = (f"(cents + {100 * more})", f"CAST(l_extendedprice AS DECIMAL(18,2)) + {more}") if more else ("cents", "CAST(l_extendedprice AS DECIMAL(18,2))")
    return f"CASE WHEN cents IS NULL THEN CAST({d} AS STRING) ELSE concat({c} div 100, CASE WHEN {c} % 100 < 10 THEN '.0' ELSE '.' END, {c} % 100) END"


def _line_text(amount: str, year: str, pct: str, qty: str) -> str:
    return f"concat('供货金额', {amount}, '元,交货', {year}, '年', month_day, '日,折扣', {pct}, '%,数量', {qty}, '件', CASE WHEN qty > 40 THEN ',违约金另计' ELSE '' END)"


#: Lines with the text of their word clause and, where it is altered, of their pdf clause, for Spark alone. A double below 1e12 that
#: equals a whole number of cents over 100 is that decimal: it has 15 digits at most, and no two of those are one double.
_LINES = f"""
named AS (SELECT l_orderkey AS pair_id, * FROM {{lineitem}}),
base AS (
  SELECT pair_id, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_shipdate,
         row_number() OVER (PARTITION BY pair_id ORDER BY {_ORDER}) AS ord,
         count_if((l_partkey + l_suppkey) % 17 <> 0) OVER (PARTITION BY pair_id ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS pdf_ord,
         count_if((l_partkey + l_suppkey) % 17 <> 0) OVER (PARTITION BY pair_id) AS n_pdf
  FROM named
),
parsed AS (
  SELECT pair_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, ord, pdf_ord, n_pdf, CAST(l_quantity AS INT) AS qty, CAST(round(l_discount * 100) AS INT) AS pct,
         year(shipped) AS year, concat(month(shipped), '月', day(shipped)) AS month_day, CASE WHEN l_extendedprice >= 0 AND l_extendedprice < 1e12D AND c / 100D = l_extendedprice THEN c END AS cents
  FROM (SELECT *, CAST(l_shipdate AS DATE) AS shipped, floor(l_extendedprice * 100 + 0.5D) AS c FROM base) b
),
lines AS (
  SELECT *, {_line_text(_cents(0), "year", "pct", "qty")} AS word_text,
         CASE WHEN l_partkey % 10 = 0 OR l_partkey % 13 = 0 OR l_suppkey % 7 = 0 OR l_partkey % 31 = 0 THEN {_line_text(
           f"CASE WHEN l_partkey % 10 = 0 THEN {_cents(100)} ELSE {_cents(0)} END", "year + CASE WHEN l_partkey % 13 = 0 THEN 1 ELSE 0 END",
           "pct + CASE WHEN l_suppkey % 7 = 0 THEN 1 ELSE 0 END", "qty + CASE WHEN l_partkey % 31 = 0 THEN 1 ELSE 0 END")} END AS pdf_text
  FROM parsed
)"""  # fmt: skip
_ADDED = "'补充条款第' || CAST(pair_id AS STRING) || '号,争议提交仲裁'"

#: The rows of CONTRACTS for Spark alone, in one pass over the lines: an order's rows travel once and stay together by pair_id.
CONTRACTS_BY_PAIR = f"""
WITH {_LINES},
copied AS (
  SELECT *, copy = 2 AS added, l_partkey % 23 = 0 OR (copy = 1 AND l_partkey % 29 = 0) AS bare
  FROM (SELECT *, explode(array(0, 1, 2)) AS copy FROM lines) c
  WHERE copy = 0 OR (copy = 1 AND (l_partkey + l_suppkey) % 17 <> 0) OR (copy = 2 AND ord = 1 AND pair_id % 19 = 0)
)
SELECT pair_id, CASE WHEN copy = 0 THEN 'word' ELSE 'pdf' END AS side, CAST(CASE copy WHEN 0 THEN ord WHEN 1 THEN pdf_ord ELSE n_pdf + 1 END AS INT) AS clause_ord,
       CASE WHEN added THEN '99' WHEN bare THEN '' ELSE CAST(l_linenumber AS STRING) END AS number, 1 AS level, CASE WHEN NOT added AND l_partkey % 23 = 0 THEN '日期' ELSE '' END AS field_key,
       CASE WHEN copy = 0 THEN CAST(l_linenumber AS STRING) WHEN added THEN '99' WHEN bare THEN '' ELSE CAST(l_linenumber AS STRING) END AS title,
       CASE WHEN copy = 0 THEN word_text WHEN added THEN {_ADDED} ELSE coalesce(pdf_text, word_text) END AS text
FROM copied
"""

#: The same clauses but their titles, those of a line's two sides in one row (see ``align.verdicts``): without an ordinal a side has no clause there,
#: and a number or text of the pdf side that is null is that of the word side.
CONTRACTS_FOLDED = f"""
WITH {_LINES},
copied AS (SELECT * FROM (SELECT *, explode(CASE WHEN ord = 1 AND pair_id % 19 = 0 THEN array(false, true) ELSE array(false) END) AS added FROM lines) c)
SELECT pair_id, CAST(CASE WHEN NOT added THEN ord END AS INT) AS word_clause_ord, CAST(CASE WHEN added THEN n_pdf + 1 WHEN (l_partkey + l_suppkey) % 17 <> 0 THEN pdf_ord END AS INT) AS pdf_clause_ord,
       CASE WHEN added THEN '99' WHEN l_partkey % 23 = 0 THEN '' ELSE CAST(l_linenumber AS STRING) END AS w_number, CASE WHEN NOT added AND l_partkey % 29 = 0 THEN '' END AS p_number, 1 AS level,
       CASE WHEN NOT added AND l_partkey % 23 = 0 THEN '日期' ELSE '' END AS field_key, CASE WHEN added THEN {_ADDED} ELSE word_text END AS w_text, CASE WHEN NOT added THEN pdf_text END AS p_text
FROM copied
"""

#: Conversations and the one after each: turns as numbers, roles as fields.
TURNS = """
SELECT conv_id AS pair_id, 'word' AS side, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS INT) AS clause_ord,
       CASE WHEN turn % 2 = 0 THEN CAST(turn AS STRING) ELSE '' END AS number, 1 AS level, role AS field_key, role AS title, text
FROM {conversations}
UNION ALL
SELECT conv_id - 1 AS pair_id, 'pdf' AS side, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS INT) AS clause_ord,
       CASE WHEN turn % 2 = 0 THEN CAST(turn AS STRING) ELSE '' END AS number, 1 AS level, role AS field_key, role AS title, text
FROM {conversations}
"""

#: Documents and the lower id with which they share most lines of 20 characters or more (two at least; ties to the lowest).
#: Documents of equal lines count as one, by the lowest id of them. Two that share two lines share one beside the
#: commonest line of either, so that line makes no candidates, however many documents have it.
DOCUMENT_PAIRS = """
WITH lines AS (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, {explode_lines} AS line FROM {documents}) x WHERE length(line) >= 20),
alike AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY line_set) AS head, n FROM (SELECT doc_id, {line_set} AS line_set, count(*) AS n FROM lines GROUP BY doc_id) s),
heads AS (SELECT l.doc_id, l.line FROM lines l JOIN alike a ON a.doc_id = l.doc_id AND a.head = l.doc_id),
often AS (SELECT line, count(*) AS n FROM heads GROUP BY line HAVING count(*) > 1),
ranked AS (SELECT h.doc_id, h.line, row_number() OVER (PARTITION BY h.doc_id ORDER BY o.n DESC, h.line) AS rn FROM heads h JOIN often o ON o.line = h.line),
met AS (SELECT DISTINCT a.doc_id AS base_id, b.doc_id AS head FROM ranked a JOIN ranked b ON a.line = b.line AND a.doc_id <> b.doc_id WHERE b.rn > 1),
shared AS (
  SELECT m.base_id, m.head, count(*) AS n FROM met m JOIN ranked a ON a.doc_id = m.base_id JOIN ranked b ON b.doc_id = m.head AND b.line = a.line
  GROUP BY m.base_id, m.head HAVING count(*) >= 2
),
offered AS (
  SELECT s.base_id, a.doc_id AS cand_id, s.n FROM shared s JOIN alike a ON a.head = s.head WHERE s.base_id < a.doc_id
  UNION ALL SELECT head AS base_id, doc_id AS cand_id, n FROM alike WHERE head < doc_id AND n >= 2
),
best AS (SELECT cand_id, base_id, row_number() OVER (PARTITION BY cand_id ORDER BY n DESC, base_id) AS rn FROM offered)
SELECT cand_id AS pair_id, base_id, cand_id FROM best WHERE rn = 1
"""

#: The rows of DOCUMENT_PAIRS for Spark alone, by the same steps (``document_pairs`` has fewer): lines travel as marks of 128 bits (two 64-bit hashes), never as text.
MARKED_PAIRS = (
    DOCUMENT_PAIRS.replace("SELECT DISTINCT doc_id, line FROM (SELECT doc_id, {explode_lines} AS line FROM {documents}) x WHERE length(line) >= 20",
                           "SELECT DISTINCT doc_id, line FROM (SELECT doc_id, explode({line_marks}) AS line FROM {documents}) x")
    .replace("{line_set}", "{mark_set}")
)

#: Contracts whose word clauses are cut in two at the first comma, while the pdf keeps them whole.
SPLIT_CONTRACTS = f"""
WITH c AS ({CONTRACTS})
SELECT pair_id, side, CAST(2 * clause_ord - 1 AS INT) AS clause_ord, number, level, field_key, title, split_part(text, ',', 1) AS text FROM c WHERE side = 'word'
UNION ALL
SELECT pair_id, side, CAST(2 * clause_ord AS INT) AS clause_ord, '' AS number, 0 AS level, '' AS field_key, '' AS title, substr(text, length(split_part(text, ',', 1)) + 2) AS text
FROM c WHERE side = 'word'
UNION ALL
SELECT pair_id, side, clause_ord, number, level, field_key, title, text FROM c WHERE side = 'pdf'
"""

#: Tables of an order's lines; the pdf copy is altered like the contracts.
ORDER_CELLS = f"""
WITH base AS (
  SELECT l_orderkey AS pair_id, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT) AS qty, CAST(l_extendedprice AS DECIMAL(18,2)) AS amt, l_shipdate,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) - 1 AS INT) AS row_index
  FROM {{lineitem}}
)
SELECT pair_id, 'word' AS side, row_index, CAST(l_linenumber AS STRING) AS c0, 'P' || CAST(l_partkey AS STRING) AS c1, CAST(qty AS STRING) AS c2, CAST(amt AS STRING) || '元' AS c3
FROM base
UNION ALL
SELECT pair_id, 'pdf' AS side, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY row_index) - 1 AS INT) AS row_index, CAST(l_linenumber AS STRING) AS c0, CASE WHEN l_partkey % 37 = 0 THEN '' ELSE 'P' || CAST(l_partkey AS STRING) END AS c1,
       CAST(qty AS STRING) AS c2, CAST(CASE WHEN l_partkey % 10 = 0 THEN amt + 100 ELSE amt END AS STRING) || '元' AS c3
FROM base WHERE NOT (pair_id % 11 = 0 AND row_index = 2)
"""

#: Lines of text by order line: each numbering, fields and section titles in turn, and lines that are none of them.
PATTERN_LINES = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 12
  WHEN 0 THEN '第' || CAST(l_linenumber AS STRING) || '条 付款方式' WHEN 1 THEN '第十二章：总则' WHEN 2 THEN CAST(l_linenumber AS STRING) || '.' || CAST(l_suppkey % 20 AS STRING) || ' 交货'
  WHEN 3 THEN CAST(l_linenumber AS STRING) || '.2.' || CAST(l_suppkey % 9 AS STRING) || '、验收' WHEN 4 THEN '（四）其他' WHEN 5 THEN '(' || CAST(l_suppkey % 30 AS STRING) || ') 备注'
  WHEN 6 THEN '二、质量要求' WHEN 7 THEN CAST(l_suppkey % 40 AS STRING) || '. 违约责任:按约定' WHEN 8 THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) || '元' WHEN 9 THEN '正文没有编号'
  WHEN 10 THEN {word} || CASE l_suppkey % 4 WHEN 0 THEN ':' WHEN 1 THEN '（签字/盖章）：' WHEN 2 THEN ' ：' ELSE '说明' END || CAST(l_orderkey AS STRING)
  ELSE {title} || CASE l_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN '：合格' WHEN 2 THEN ' :' ELSE '说明' END END AS line
FROM {lineitem}
"""

#: Order tables as lines of a page, between a title and a last line; every other order has tabs for pipes, and blank lines.
ISLAND_LINES = f"""
WITH cells AS ({ORDER_CELLS}), w AS (SELECT * FROM cells WHERE side = 'word')
SELECT pair_id AS page_id, 0 AS line_ord, '订单' || CAST(pair_id AS STRING) AS line FROM w WHERE row_index = 0
UNION ALL SELECT pair_id, 1, replace('line | part | qty | price', ' | ', CASE WHEN pair_id % 2 = 0 THEN ' | ' ELSE chr(9) END) FROM w WHERE row_index = 0
UNION ALL SELECT pair_id, 2, CASE WHEN pair_id % 2 = 0 THEN '|---|---|---|---|' ELSE ' ' END FROM w WHERE row_index = 0
UNION ALL SELECT pair_id, 3 + row_index, replace(c0 || ' | ' || c1 || ' | ' || c2 || ' | ' || c3, ' | ', CASE WHEN pair_id % 2 = 0 THEN ' | ' ELSE chr(9) END) FROM w
UNION ALL SELECT pair_id, 1000, '合计' FROM w WHERE row_index = 0
"""

#: Users' events as the progress of tasks.
PROGRESS = """
SELECT user_id AS task_id, CAST(ts AS TIMESTAMP) AS ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS seq, event_type AS stage,
       CAST(event_id % 100 AS DOUBLE) / 100 AS progress,
       CASE WHEN event_type = 'purchase' THEN 'done' WHEN event_type = 'error' THEN 'failed' WHEN event_id % 7 = 0 THEN 'pending' ELSE 'running' END AS status
FROM {events}
"""

_MARK = "named_struct('a', xxhash64({x}), 'b', xxhash64(7, {x}))"
_MARKS = {
    "line_marks": f"transform(array_distinct(filter(split(text, '\\n'), x -> length(x) >= 20)), x -> {_MARK.format(x='x')})",
    "mark_set": _MARK.format(x="array_sort(collect_list(line))"),
}
_ENGINE = {
    "spark": {"explode_lines": "explode(split(text, '\\n'))", "line_set": "array_join(array_sort(collect_list(line)), '\\n')", **_MARKS},
    "duckdb": {"explode_lines": "unnest(string_split(text, chr(10)))", "line_set": "array_to_string(list_sort(list(line)), chr(10))"},
}


def _for(engine: str, sql: str) -> str:
    for name, text in _ENGINE[engine].items():
        sql = sql.replace("{" + name + "}", text)
    return sql


def rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of one of the texts above, over the tables of ``sf_dir``."""
    sql = _for("spark", sql)
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of DOCUMENT_PAIRS without the pairs of all documents that have two common lines."""
    marks = rows(spark, sf_dir, "SELECT doc_id AS doc, {line_marks} AS marks FROM {documents} WHERE doc_id IS NOT NULL").where("size(marks) > 0")
    sets = marks.groupBy("doc").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("marks")))).alias("set"))
    return materialized(most_shared(sets).select(F.col("doc").alias("pair_id"), F.col("base").alias("base_id"), F.col("doc").alias("cand_id")))


def duckdb_sql(sql: str) -> str:
    """The same text for DuckDB, where the tables are views."""
    return re.sub(r"\{(\w+)\}", r"\1", _for("duckdb", sql))
