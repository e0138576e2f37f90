"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from redline.functions.kernels import nfkc

# Numbering, field and section vocabularies.
SEPARATOR = r"(?=[\s，,。：:、]|$)"
NUMBERING = [
    (r"^(第([一二三四五六七八九十百千零〇\d]+)(?:条|章))" + SEPARATOR, 1),
    (r"^((\d+\.\d+(?:\.\d+)?))" + SEPARATOR, 2),
    (r"^([（(]([一二三四五六七八九十\d]+)[)）])", 3),
    (r"^(([一二三四五六七八九十]+)、)", 2),
    (r"^((\d+)[\.、])", 2),
]
ROLES = ["甲方", "乙方", "供方", "需方", "出租方", "承租方", "买方", "卖方", "发包方", "承包方", "许可方", "被许可方", "委托方", "受托方", "转让方", "受让方"]
FIELDS = [
    "统一社会信用代码(?:[/／]身份证号)?", "身份证号", "法定代表人", "负责人", "联系电话", "联系地址", "开户行", "开户银行", "账户名", "账户名称", "账号", "帐号",
    r"账\s*号", "日期", "时间", "签约日期", "签订日期", "签约代表", "地址", "电话", "传真", "邮编", "邮箱", "电子邮箱",
]
SYNONYMS = {
    "联系电话": "电话", "联系地址": "地址", "开户银行": "开户行", "账户名称": "账户名", "账号": "账号", "帐号": "账号",
    "统一社会信用代码/身份证号": "统一社会信用代码", "签约日期": "日期", "签订日期": "日期", "时间": "日期",
}
SECTIONS = ["采购产品明细", "质量要求", "产品包装", "交货地点", "产品验收", "付款方式", "违约责任", "争议解决", "其他约定"]
ROLE_FIELD = rf"(?U)^((?:({'|'.join(ROLES)}))(?:[（(][^)）]*[)）])?\s*(?:[（(]?(?:签字|盖章)[/／]?(?:签字|盖章)?[)）]?)?\s*[:：])"
PLAIN_FIELD = rf"(?U)^(({'|'.join(FIELDS)})\s*[:：])"
SECTION = rf"(?U)^({'|'.join(SECTIONS)})(?:\s*[:：]|$)"
# End of fixed values.

_left = r"(?U)^\s+"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, where it would stand in the expression several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_text(c: Column, unicode: bool = True) -> Column:
    """NFKC, LF line ends, other blank runs as one space, LF runs as one LF, stripped; null gives ''."""
    s = nfkc(F.coalesce(c, F.lit(""))) if unicode else F.coalesce(c, F.lit(""))
    n = F.regexp_replace(s, r"\r\n?", "\n")
    n = F.regexp_replace(n, r"(?U)[^\S\n]+", " ")
    return F.when(s.rlike(r"(?U)\s"), strip(F.regexp_replace(n, r"\n{2,}", "\n"))).otherwise(s)  # most clauses have no blank: one look at them


def without_blanks(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def compact(c: Column, unicode: bool = True) -> Column:
    """NFKC without any blank: the key by which texts are looked for in one another."""
    return without_blanks(nfkc(F.coalesce(c, F.lit(""))) if unicode else F.coalesce(c, F.lit("")))


def char_count(c: Column) -> Column:
    return F.length(without_blanks(F.coalesce(c, F.lit(""))))


def lines(c: Column) -> Column:
    """The lines of a normalised text; an empty text has none."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, "\n"))


def table_row(line: Column) -> Column:
    """The cells of one line: an outer pipe peeled on each side, split at pipes or tabs, blanks collapsed, empty ends dropped."""
    peeled = F.regexp_replace(F.regexp_replace(strip(line), r"(?U)^\|\s*", ""), r"(?U)\s*\|$", "")
    cells = F.transform(F.split(peeled, r"(?U)\s*\|\s*|\t"), lambda x: strip(F.regexp_replace(x, r"(?U)[^\S\n]+", " ")))
    filled = F.filter(F.sequence(F.lit(1), F.size(cells)), lambda i: F.element_at(cells, i) != "")
    return F.when(F.size(filled) == 0, F.array().cast("array<string>")).otherwise(
        F.slice(cells, F.array_min(filled), F.array_max(filled) - F.array_min(filled) + 1)
    )


def is_rule_line(line: Column) -> Column:
    """Only blanks, colons, pipes and hyphens, with a hyphen: the line under a Markdown header."""
    return line.rlike(r"(?U)^[\s:|\-]+$") & line.contains("-")


def normalize_table_text(c: Column) -> Column:
    """Each line as 'cell | cell'; blank and rule lines dropped. Doing it twice changes nothing."""
    kept = F.filter(F.split(F.coalesce(c, F.lit("")), r"\r\n|[\n\r]"), lambda x: (strip(x) != "") & ~is_rule_line(strip(x)))
    rows = F.filter(F.transform(kept, table_row), lambda cells: F.size(cells) > 0)
    return F.array_join(F.transform(rows, lambda cells: F.array_join(cells, " | ")), "\n")


def detect_number(c: Column) -> Column:
    """struct(prefix, number, level) of the numbering at a line's start, or null; the first pattern wins."""
    t = F.regexp_replace(c, _left, "")
    found = None
    for pattern, level in NUMBERING:
        unicode = "(?U)" + pattern
        number = F.regexp_extract(t, unicode, 2)
        depth = F.when(number.contains("."), F.lit(1) + F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))).otherwise(level)
        hit = F.struct(F.regexp_extract(t, unicode, 1).alias("prefix"), number.alias("number"), depth.cast("int").alias("level"))
        found = F.when(t.rlike(unicode), hit) if found is None else found.when(t.rlike(unicode), hit)
    return found


def canonical_field(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, without_blanks(c)), strip(c))


def detect_field(c: Column) -> Column:
    """struct(prefix, field_key) of a party role or field name before a colon, or null."""
    t = F.regexp_replace(c, _left, "")
    hit = lambda p: F.struct(F.regexp_extract(t, p, 1).alias("prefix"), canonical_field(F.regexp_extract(t, p, 2)).alias("field_key"))
    return F.when(t.rlike(ROLE_FIELD), hit(ROLE_FIELD)).when(t.rlike(PLAIN_FIELD), hit(PLAIN_FIELD))


def detect_section(c: Column) -> Column:
    """The fixed section title at a text's start, or null; its key is 'section:' and the title."""
    t = F.regexp_replace(c, _left, "")
    return F.when(t.rlike(SECTION), F.regexp_extract(t, SECTION, 1))


def split_body(c: Column, prefix: Column) -> Column:
    """What follows the prefix, without separators before it."""
    rest = F.substr(F.regexp_replace(c, _left, ""), F.length(prefix) + 1)
    return strip(F.regexp_replace(rest, r"^[ .、．)）:：]+", ""))


def starts_with_number(c: Column, number: Column) -> Column:
    """Does the compact text start with the number, no letter or digit behind it? (3.2 is not 3.21.)"""
    rest = F.substr(c, F.length(number) + 1, F.lit(1))
    return (number != "") & F.startswith(c, number) & ~rest.rlike("^[0-9A-Za-z]")


def side_text(segments: Column, *ops: str) -> Column:
    """The text of one side of a diff: equal with delete, or equal with insert."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["op"].isin("equal", *ops)), lambda s: s["text"]), "")


def marked_text(segments: Column) -> Column:
    """Deletions as [-x-], insertions as [+x+]."""
    one = lambda s: (
        F.when(s["op"] == "delete", F.concat(F.lit("[-"), s["text"], F.lit("-]")))
        .when(s["op"] == "insert", F.concat(F.lit("[+"), s["text"], F.lit("+]")))
        .otherwise(s["text"])
    )
    return F.array_join(F.transform(segments, one), "")


def tokens(c: Column) -> Column:
    """Single CJK characters and lower-cased ASCII words, in order."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([\x{4e00}-\x{9fff}]|[a-zA-Z0-9]+)"), 1)
    return F.transform(found, lambda t: F.lower(t))


def bag_terms(c: Column) -> Column:
    """Adjacent token pairs joined, then the tokens: the terms of the bag vector, with repeats."""
    def terms(ts: Column) -> Column:
        pairs = F.zip_with(ts, F.slice(ts, 2, F.greatest(F.size(ts), F.lit(1))), lambda a, b: F.concat(a, b))
        return F.concat(F.filter(pairs, lambda x: x.isNotNull()), ts)

    return let(tokens(c), terms)


def mask_key(c: Column) -> Column:
    return F.when(F.length(c) <= 4, F.repeat(F.lit("*"), F.length(c))).otherwise(F.concat(F.repeat(F.lit("*"), F.length(c) - 4), F.right(c, F.lit(4))))


def data_url(png: Column) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.base64(png))


def fragment_separator(left: Column, right: Column, gap: Column) -> Column:
    """A space between fragments more than 2 points apart whose meeting characters are ASCII letters or digits."""
    edges = F.right(left, F.lit(1)).rlike("[0-9A-Za-z]") & F.left(right, F.lit(1)).rlike("[0-9A-Za-z]")
    return F.when((gap > 2) & edges, " ").otherwise("")
