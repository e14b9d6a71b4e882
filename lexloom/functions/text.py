"""Text functions as columns: all JVM expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind, in a form that Java and RE2 read alike.
SPACE = r"[\t-\r\x{85}\p{Z}]"


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def trim_left(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+", "")


def trim_right(c: Column) -> Column:
    return F.regexp_replace(c, rf"{SPACE}+$", "")


def any_of(c: Column, parts: list[str]) -> Column:
    """Whether the text contains one of ``parts``."""
    return reduce(lambda a, b: a | b, (c.contains(p) for p in parts))


def starts_any(c: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.startswith(p) for p in parts))


def occurrences(c: Column, part: str) -> Column:
    """How often ``part`` stands in the text, without overlaps."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")


def distinct_hits(hay: Column, terms: list[str]) -> Column:
    """The terms that stand in ``hay``, in the list's order."""
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(hay, t)) if terms else F.array().cast("array<string>")


def has_word(hay: Column, term: Column) -> Column:
    """Lower-case ASCII terms as words (plural allowed), others as parts of the text."""
    word = F.regexp(hay, F.concat(F.lit("(?<![a-zA-Z0-9])"), term, F.lit("(?:e?s)?(?![a-zA-Z0-9])")))
    # Most terms stand nowhere: no pattern is made for those.
    return F.contains(hay, term) & F.when(term.rlike("^[a-z]+$"), word).otherwise(F.lit(True))


def word_hits(hay: Column, terms: Column) -> Column:
    return F.filter(terms, lambda t: has_word(hay, t))


def has_leader_or_page(line: Column) -> Column:
    """A line of a table of contents: dot leaders, or a page number at its end."""
    return line.contains("....") | line.contains("…") | ((F.length(line) >= 5) & line.rlike(r"[\t-\r\x{85}\p{Z}.…][0-9]+$"))


#: Beginnings of captions (fixed values).
CAPTION_STARTS = ["Figure", "Fig.", "Table", "Tab.", "Schema", "Diagram", "Photo", "图", "表", "插图"]


def is_caption(c: Column) -> Column:
    return starts_any(trim_left(c), CAPTION_STARTS)


#: Wordings of a model that asks or explains instead of translating (fixed values).
META_REPLIES = [
    "请补充", "请提供", "请输入", "请告诉我", "我没有收到", "翻译要求", "正文内容", "完整文本", "无法翻译", "只提供了",
    "请您提供", "请发送", "请上传", "需要翻译的", "请重新发送", "我无法翻译", "仅包含图片引用", "没有需要翻译", "您提供的内容",
]


def is_meta_reply(c: Column) -> Column:
    return any_of(c, META_REPLIES)


def normalize_translated(kind: Column, c: Column) -> Column:
    """Tables and code trimmed, contents line by line, everything else on one line."""
    lines = F.filter(F.transform(F.split(c, "\r?\n", -1), trim_all), lambda x: x != "")
    flat = F.regexp_replace(trim_all(c), f"{SPACE}+", " ")
    return F.when(kind.isin("table", "code"), trim_all(c)).when(kind == "toc", F.array_join(lines, "  \n")).otherwise(flat)


#: Image references: path in group 1.
IMAGE = r"(?s)!\[.*?\]\((.*?)\)"


def image_refs(c: Column) -> Column:
    """Distinct local image paths, first seen first."""
    paths = F.transform(F.regexp_extract_all(c, F.lit(IMAGE), F.lit(1)), trim_all)
    return F.array_distinct(F.filter(paths, lambda p: (p != "") & ~p.startswith("http")))


def first_image(c: Column) -> Column:
    path = trim_all(F.regexp_extract(c, IMAGE, 1))
    return F.when((path != "") & ~path.startswith("http"), path)


def is_pure_image(c: Column, strict: bool = True) -> Column:
    """Whether nothing but image references stands in the text. Not ``strict``: text
    before the last reference is overlooked."""
    rest = F.regexp_replace(c, IMAGE, "") if strict else F.regexp_replace(c, r"(?s)^.*!\[.*?\]\(.*?\)", "")
    return trim_all(rest) == ""


_ITEM = {
    "bullet": r"^[-*•·–]",
    "circled": r"^[①②③④⑤⑥⑦⑧⑨⑩]",
    "bracketed": r"(?s)^(?:\([0-9一二三四五六七八九十]+\)|（[0-9一二三四五六七八九十]+）|\[[0-9一二三四五六七八九十]+\]|【[0-9一二三四五六七八九十]+】)(?=.)",
    "ordinal": r"^[0-9一二三四五六七八九十]+[、.．)）](?![0-9])",
}


def strip_item_marker(c: Column) -> Column:
    """A list item without its bullet or number; section numbers like 2.1 stay."""
    t = trim_left(c)
    out = F.lit(None).cast("string")
    for pattern in _ITEM.values():
        out = F.coalesce(out, F.when(t.rlike(pattern), trim_left(F.regexp_replace(t, pattern, ""))))
    return F.coalesce(out, t)


def count_item_markers(c: Column) -> Column:
    pieces = F.transform(F.split(c, "[；;]", -1), trim_all)
    return F.size(F.filter(pieces, lambda s: (s != "") & (strip_item_marker(s) != s)))


def normalize_list(c: Column) -> Column:
    """One item a line; items run together in one line are parted at semicolons."""
    t = trim_all(c)
    cited = occurrences(t, "[段落") + occurrences(t, "[Paragraph")
    several = ~t.contains("\n") & ((cited >= 2) | (count_item_markers(t) >= 2))
    pieces = F.when(several, F.split(t, "[；;]", -1)).otherwise(F.split(t, "\r?\n", -1))
    return F.array_join(F.filter(F.transform(pieces, strip_item_marker), lambda x: x != ""), "\n")


def has_citation(c: Column) -> Column:
    return any_of(c, ["引用缺失", "[段落", "段落 ", "（段落"])


#: Names that a file must not have (fixed values).
RESERVED = ["CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))]


def sanitize_name(c: Column) -> Column:
    """A name that is safe as a file name everywhere."""
    kept = F.substring(F.regexp_replace(c, r'[/\\:*?"<>|\x00-\x1f\x{7f}-\x{9f}]', ""), 1, 120)
    bare = trim_all(F.regexp_replace(trim_all(kept), r"[. ]+$", ""))
    return F.when(bare == "", F.lit("未命名笔记")).when(F.upper(bare).isin(RESERVED), F.concat(bare, F.lit("_"))).otherwise(bare)


def shorten_title(c: Column, most: int = 48) -> Column:
    """A title of at most ``most`` letters, cut at its last mark where that isn't too
    early; the place of the mark is measured in bytes, as file systems do."""
    head = F.substring(c, 1, most)
    before = F.regexp_extract(head, r"(?s)^(.*)[ ,，:：]", 1)
    marked = head.rlike(r"[ ,，:：]") & (F.octet_length(before) >= most // 2)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(trim_right(F.when(marked, before).otherwise(head)), F.lit("…")))


def note_name(title: Column, authors: Column, year: Column, day: Column) -> Column:
    """day-title-first author-year-阅读笔记; what is missing is left out."""
    first = trim_all(F.element_at(F.split(authors, "[,;，；、]", -1), 1))
    some = lambda x: F.when(x != "", x)
    return F.concat_ws("-", day, some(shorten_title(trim_all(title))), some(first), year.cast("string"), F.lit("阅读笔记"))


def same_title(a: Column, b: Column) -> Column:
    """Whether two titles agree but for case, spaces and marks."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"[\t-\r\x{85}\p{Z}\p{P}\p{S}]", "")
    return (bare(a) != "") & (bare(a) == bare(b))


def mask_key(c: Column) -> Column:
    return F.when(F.length(c) <= 8, F.lit("***")).otherwise(F.concat(F.substring(c, 1, 6), F.lit("***")))


def parse_mixed_ts(c: Column) -> Column:
    """Epoch milliseconds or ISO text as a timestamp without zone; null otherwise."""
    bare = trim_all(c)
    millis = F.when(bare.rlike("^[0-9]{10,17}$"), F.timestamp_millis(bare.cast("bigint")).cast("timestamp_ntz"))
    iso = F.when(bare.rlike("^[0-9]{4}-"), F.try_to_timestamp(bare).cast("timestamp_ntz"))
    return F.coalesce(millis, iso)


def coded_error(code: str, message: Column) -> Column:
    return F.concat(F.lit(f"[{code}] "), message)


def direction(c: Column) -> Column:
    return F.when(c == "zh_to_en", F.lit("zh_to_en")).otherwise(F.lit("en_to_zh"))


#: Signs that a call failed for want of a valid key (fixed values).
CREDENTIAL_SIGNS = ["401", "403", "API Key", "api key", "API key", "鉴权", "无效", "未授权", "Unauthorized", "invalid_api_key"]


def is_credential_error(category: Column, message: Column) -> Column:
    return F.coalesce((category == "config") | any_of(message, CREDENTIAL_SIGNS), F.lit(False))


def failure_label(category: Column, message: Column) -> Column:
    """What a reader is told of a failed field (labels are fixed values)."""
    keyed = (category == "config") | message.rlike("401|403|API Key|鉴权|未授权|Unauthorized|无效")
    return F.when(keyed, F.lit("接口鉴权失败")).when(category == "network", F.lit("网络不可达")).when(category == "llm", F.lit("模型返回异常")).when(category == "internal", F.lit("处理出错")).otherwise(F.lit("拆解失败"))


#: Codes of what went wrong with a call (fixed values).
CATEGORY_CODES = {"network": "E-3014", "config": "E-3015", "llm": "E-3016"}


def category_code(category: Column) -> Column:
    """The code of a category of errors; the general one for any other."""
    out = F.lit("E-3001")
    for name, code in CATEGORY_CODES.items():
        out = F.when(category == name, code).otherwise(out)
    return out


def network_error(kind: Column, detail: Column) -> Column:
    """What is told of a failed connection: of kind timeout, connect, or any other
    (messages are fixed values)."""
    told = F.when(kind == "timeout", "请求超时: ").when(kind == "connect", "无法连接到 API 服务器: ").otherwise("网络请求失败: ")
    hint = (
        F.when(kind == "timeout", "网络连接不稳定或 API 响应过慢。请检查网络后重试")
        .when(kind == "connect", "可能的原因：① 本机未联网或网络受限；② API 地址（Base URL）填写错误。请检查网络与设置页配置")
        .otherwise("可能的原因：① 本机未联网或网络受限；② 域名无法解析（DNS）。请检查网络后重试")
    )
    return F.struct(F.lit("network").alias("category"), F.concat(told, F.coalesce(detail, F.lit(""))).alias("message"), hint.alias("hint"))


def retryable(status: Column) -> Column:
    return (status == 429) | (status >= 500)


def error_detail(body: Column) -> Column:
    """The message of a JSON error body, or the first 200 letters of the body."""

    def text(path: str) -> Column:
        # Only strings count: numbers and objects read alike in get_json_object.
        keys = path.split(".")
        quoted = F.get_json_object(body, "$." + path)
        kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), "$." + path, "variant"))
        return F.when(kind == "STRING", quoted) if keys else quoted

    bare = trim_all(body)
    short = F.when(F.length(bare) > 200, F.concat(F.substring(bare, 1, 200), F.lit("…"))).when(bare != "", bare)
    return F.coalesce(text("error.message"), text("error.code"), text("message"), text("error"), short)


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def _toggle(c: Column, mark: str, opening: str, closing: str, skip_empty: bool = False) -> Column:
    """Every second piece between marks goes into a tag."""
    wrap = lambda p: F.concat(F.lit(opening), p, F.lit(closing))
    tagged = F.transform(F.split(c, mark, -1), lambda p, i: F.when((i % 2 == 1) & ((p != "") if skip_empty else F.lit(True)), wrap(p)).otherwise(p))
    return F.array_join(tagged, "")


def inline_html(c: Column) -> Column:
    """Code, bold and italic of one line."""
    out = _toggle(escape_html(c), "`", "<code>", "</code>")
    out = _toggle(out, r"\*\*", "<strong>", "</strong>")
    return _toggle(out, r"\*", "<em>", "</em>", skip_empty=True)


def strip_inline(c: Column) -> Column:
    """A heading's plain text."""
    out = F.regexp_replace(c, r"^#{1,6}[\t-\r\x{85}\p{Z}]*", "")
    out = F.regexp_replace(out, r'<a id="[^"]*"></a>', "")
    return trim_all(F.regexp_replace(out, r"\*\*|__|`|\*|~~", ""))


def heading_level(c: Column) -> Column:
    hashes = F.regexp_extract(c, r"^(#{1,6})[\t-\r\x{85}\p{Z}]", 1)
    return F.when(hashes != "", F.length(hashes))


def excerpt(c: Column, place: Column, title: Column) -> Column:
    """A quotation and where it stands; the title where no place is known."""
    source = F.coalesce(F.when(trim_all(place) != "", trim_all(place)), F.concat(F.lit("《"), F.coalesce(title, F.lit("文献")), F.lit("》")))
    return F.concat(F.lit("> "), F.regexp_replace(c, "\n+", "\n> "), F.lit("\n> —— "), source)


def clean_field(c: Column) -> Column:
    """A field's text without the JSON or fence it may come in."""
    t = trim_all(c)
    inner = F.when(t.startswith("{") & t.contains('"zh"'), trim_all(F.get_json_object(t, "$.zh")))
    unfenced = trim_all(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "^(?:```json)+", ""), "^(?:```)+", ""), "(?:```)+$", ""))
    return F.coalesce(inner, unfenced)
