"""SQL that gives the same rows as a query of the core, for DuckDB."""

from lexloom.operators import lexicons as L

_S = r"[\t-\r\x{85}\p{Z}]"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


def rtrim(x: str) -> str:
    return f"regexp_replace({x}, '{_S}+$', '')"


def ltrim(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+', '')"


MD = "md_docs AS (SELECT doc_id, max(row(parsed_at, content)) AS n FROM parsed_docs GROUP BY doc_id), docs AS (SELECT doc_id, n[2] AS md FROM md_docs)"

LINES = rf"""{MD},
cut AS (SELECT doc_id, string_split_regex(md, '\r?\n') AS ls FROM docs WHERE md IS NOT NULL),
lines AS (SELECT doc_id, pos, line, {trim('line')} AS t FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM cut)),
fenced AS (SELECT *, coalesce(sum(starts_with(t, '```')::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inc FROM lines)"""

SEGMENTS = rf"""{LINES},
cls AS (SELECT *, CASE WHEN starts_with(t, '```') THEN CASE WHEN inc THEN 'close' ELSE 'open' END WHEN inc THEN 'code' WHEN starts_with(t, '#') THEN 'heading'
  WHEN starts_with(t, '|') OR starts_with(t, '<table') THEN 'table' WHEN t = '' THEN 'blank'
  WHEN starts_with(t, '![') OR starts_with(t, '**Figure') OR starts_with(t, '**图') THEN 'cap' ELSE 'text' END AS cls FROM fenced),
lagged AS (SELECT *, lag(cls) OVER (PARTITION BY doc_id ORDER BY pos) AS was,
  coalesce(max((cls = 'heading' AND regexp_matches(t, '^#+{_S}*(References|REFERENCES|Reference|Bibliography|BIBLIOGRAPHY|参考文献|引用文献){_S}*#*$'))::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS refs FROM cls),
grouped AS (SELECT *, sum(CASE WHEN cls = 'code' OR (cls IN ('text', 'table') AND was IS NOT DISTINCT FROM cls) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM lagged),
joined AS (SELECT doc_id, grp, min(pos) AS pos, arg_min(cls, pos) AS c, arg_min(refs, pos) AS refs, string_agg(line, chr(10) ORDER BY pos) AS body, string_agg(t, '  ' || chr(10) ORDER BY pos) AS flat, count(*) AS n,
  sum((contains(t, '....') OR contains(t, '…') OR (length(t) >= 5 AND regexp_matches(t, '[\t-\r\x{{85}}\p{{Z}}.…][0-9]+$')))::INT) AS hits
  FROM grouped WHERE cls <> 'blank' GROUP BY doc_id, grp),
kinds AS (SELECT *, CASE WHEN c IN ('open', 'close', 'code') THEN 'code' WHEN c = 'cap' THEN 'image_caption' WHEN c = 'text' THEN CASE WHEN refs = 1 THEN 'reference' ELSE 'paragraph' END ELSE c END AS k FROM joined),
shaped AS (SELECT doc_id, pos, CASE WHEN k = 'paragraph' AND n >= 3 AND hits * 10 >= n * 6 THEN 'toc' ELSE k END AS kind,
  CASE WHEN k = 'paragraph' AND n >= 3 AND hits * 10 >= n * 6 THEN flat ELSE {rtrim('body')} END AS content FROM kinds),
seg AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS seg_index, kind, content FROM shaped WHERE content <> '')"""

NUMBERED = rf"""{SEGMENTS},
numbered AS (SELECT doc_id, row_number() OVER w - 1 AS ord, CASE WHEN kind = 'paragraph' THEN (sum((kind = 'paragraph')::INT) OVER w)::BIGINT END AS no,
  CASE WHEN kind = 'heading' THEN {trim("regexp_replace(content, '^#+', '')")} END AS heading, CASE WHEN kind = 'paragraph' THEN content ELSE '' END AS content
  FROM seg WHERE kind IN ('paragraph', 'heading') WINDOW w AS (PARTITION BY doc_id ORDER BY seg_index))"""
RENDERED = "CASE WHEN no IS NOT NULL THEN '[段落 ' || no || ']' || chr(10) || content || chr(10) || chr(10) ELSE '【章节】' || coalesce(heading, '') || chr(10) || chr(10) END"

BLOCKS = rf"""{MD},
bcut AS (SELECT doc_id, string_split(md, chr(10)) AS ls FROM docs WHERE md IS NOT NULL),
blines AS (SELECT doc_id, pos, line, {trim('line')} AS t FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM bcut)),
bfenced AS (SELECT *, coalesce(sum(starts_with(t, '```')::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inc FROM blines),
bcls AS (SELECT *, CASE WHEN starts_with(t, '```') THEN CASE WHEN inc THEN 'code' ELSE 'open' END WHEN inc THEN 'code' WHEN t = '' THEN 'blank'
  WHEN regexp_matches(t, '^#{{1,6}}{_S}') OR starts_with(t, '|') OR starts_with(t, '![') OR starts_with(t, '> ') THEN 'held' ELSE 'body' END AS cls FROM bfenced),
blag AS (SELECT *, lag(cls) OVER (PARTITION BY doc_id ORDER BY pos) AS was FROM bcls),
bgrp AS (SELECT *, sum(CASE WHEN cls = 'code' OR (cls IN ('held', 'body') AND was IS NOT DISTINCT FROM cls) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM blag),
bjoin AS (SELECT doc_id, min(pos) AS pos, arg_min(cls, pos) = 'body' AS interactive, {trim("string_agg(line, chr(10) ORDER BY pos)")} AS body FROM bgrp WHERE cls <> 'blank' GROUP BY doc_id, grp),
blocks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS block, interactive, body FROM bjoin WHERE body <> '')"""

# A mark of its own stands where a sentence ends; formulas were taken out before.
_HAN_CUT = r"regexp_replace(c, '([。！？；])', '\1' || chr(30), 'g')"
_LATIN_CUT = rf"regexp_replace(regexp_replace(c, '([.!?]){_S}+([A-Z])', '\1' || chr(30) || '\2', 'g'), '([.!?]){_S}+([A-Z])', '\1' || chr(30) || '\2', 'g')"
SENTENCES = rf"""{BLOCKS},
around AS (SELECT doc_id, block, string_split_regex(body, '(?s)\$\$.*?\$\$|\$[^$\n]+\$') AS o, regexp_extract_all(body, '(?s)\$\$.*?\$\$|\$[^$\n]+\$') AS m FROM blocks WHERE interactive),
chunks AS (SELECT doc_id, block, i * 2 AS part, {trim('o[i]')} AS c, false AS math FROM (SELECT *, unnest(range(1, len(o) + 1)) AS i FROM around)
  UNION ALL SELECT doc_id, block, i * 2 + 1, m[i], true FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM around)),
pieces AS (SELECT doc_id, block, part, CASE WHEN math THEN [c] ELSE string_split(CASE WHEN regexp_matches(c, '[\x{{4e00}}-\x{{9fff}}]') THEN {_HAN_CUT} ELSE {_LATIN_CUT} END, chr(30)) END AS ss, math FROM chunks),
flat AS (SELECT doc_id, block, part, j, CASE WHEN math THEN ss[j] ELSE {trim('ss[j]')} END AS s FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS j FROM pieces)),
sentences AS (SELECT doc_id, block, row_number() OVER (PARTITION BY doc_id, block ORDER BY part, j) - 1 AS sentence_no, s AS sentence FROM flat WHERE s <> '')"""

_LEVEL = rf"CASE WHEN NOT interactive AND regexp_matches(string_split(body, chr(10))[1], '^#{{1,6}}{_S}') THEN length(regexp_extract(string_split(body, chr(10))[1], '^(#{{1,6}})', 1)) END"


_ANCHOR = '<a id="[^"]*"></a>'


def plain(x: str) -> str:
    bare = f"regexp_replace(regexp_replace({x}, '^#{{1,6}}{_S}*', ''), '{_ANCHOR}', '', 'g')"
    return trim(rf"regexp_replace({bare}, '\*\*|__|`|\*|~~', '', 'g')")


_UPTO = "OVER (PARTITION BY doc_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_STEPS = ", ".join(
    f"CASE WHEN last_value(CASE WHEN level = {d} THEN block END IGNORE NULLS) {_UPTO} > coalesce(max(CASE WHEN level < {d} THEN block END) {_UPTO}, -1) THEN nullif(last_value(CASE WHEN level = {d} THEN head END IGNORE NULLS) {_UPTO}, '') END AS h{d}"
    for d in range(1, 7)
)
LOCATED = rf"""{SENTENCES},
entry AS (SELECT doc_id, block, interactive, {_LEVEL} AS level, {plain("string_split(body, chr(10))[1]")} AS head FROM blocks),
steps AS (SELECT doc_id, block, interactive, sum(interactive::INT) {_UPTO} AS no, {_STEPS} FROM entry),
located AS (SELECT doc_id, block, CASE WHEN interactive THEN CASE WHEN concat_ws(' › ', h1, h2, h3, h4, h5, h6) <> '' THEN concat_ws(' › ', h1, h2, h3, h4, h5, h6) || ' · ' ELSE '' END || '第 ' || no || ' 段' ELSE '' END AS locator FROM steps)"""

_IMAGE = r"(?s)!\[.*?\]\((.*?)\)"
_ESC = """replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')"""


def toggled(x: str, mark: str, tag: str, skip: bool = False) -> str:
    extra = " AND p <> ''" if skip else ""
    return f"array_to_string(list_transform(string_split({x}, '{mark}'), lambda p, i: CASE WHEN i % 2 = 0{extra} THEN '<{tag}>' || p || '</{tag}>' ELSE p END), '')"


def inline_html(x: str) -> str:
    return toggled(toggled(toggled(_ESC.format(x=x), "`", "code"), "**", "strong"), "*", "em", skip=True)


_KW_T = trim(r"regexp_replace(t, '^(?:\*\*)+', '')")
_KEYWORDS = rf"""kw AS (SELECT doc_id, pos, k, {trim("CASE WHEN regexp_matches(k, '[:：]') THEN regexp_replace(k, '(?s)^.*?[:：]', '') ELSE k END")} AS b FROM (SELECT doc_id, pos, {_KW_T} AS k FROM lines)),
keywords AS (SELECT doc_id, arg_min(b, pos) AS keywords FROM kw WHERE regexp_matches(lower(k), '^(keywords|关键词|key words)') AND b <> '' AND strlen(b) < 400 GROUP BY doc_id)"""

SIGNALS = rf"""{SEGMENTS}, {_KEYWORDS},
heads AS (SELECT doc_id, list(h ORDER BY seg_index) AS hs FROM (SELECT doc_id, seg_index, {trim("regexp_replace(content, '^#+', '')")} AS h FROM seg WHERE kind = 'heading') WHERE h <> '' GROUP BY doc_id),
paras AS (SELECT doc_id, list(content ORDER BY seg_index) AS ps FROM seg WHERE kind = 'paragraph' GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) FILTER (kind = 'table') AS tables, count(*) FILTER (kind = 'image_caption') AS caps FROM seg GROUP BY doc_id),
signals AS (SELECT d.doc_id,
  CASE WHEN x.title IS NULL OR {trim('x.title')} = '' OR x.title = '未命名' THEN coalesce(hs[1], '') ELSE x.title END AS title,
  coalesce(array_to_string(ps[1:3], ' '), '') || CASE WHEN coalesce(keywords, '') <> '' THEN ' 关键词：' || keywords ELSE '' END AS abstract,
  coalesce(hs, []) AS headings, substring(coalesce(array_to_string(ps[1:14], ' '), ''), 1, 6000) AS body_sample, coalesce(keywords, '') AS keywords,
  coalesce(tables, 0) AS table_count, greatest(coalesce(caps, 0), (length(md) - length(replace(md, '![', ''))) // 2) AS image_count, (length(md) - length(replace(md, '$', '')))::BIGINT AS math_symbols
  FROM docs d LEFT JOIN heads USING (doc_id) LEFT JOIN paras USING (doc_id) LEFT JOIN counts USING (doc_id) LEFT JOIN keywords USING (doc_id) LEFT JOIN documents x USING (doc_id))"""

SQL: dict[str, str] = {
    "segments": f"WITH {SEGMENTS} SELECT doc_id, seg_index, kind, content FROM seg",
    "segment_kinds": f"WITH {SEGMENTS} SELECT kind, count(*) AS n_segments, count(DISTINCT doc_id) AS n_docs, sum(length(content))::BIGINT AS n_chars FROM seg GROUP BY kind",
    "toc_segments": f"WITH {SEGMENTS} SELECT doc_id, seg_index, len(string_split(content, '  ' || chr(10))) AS n_lines FROM seg WHERE kind = 'toc'",
    "numbered_paragraphs": f"WITH {NUMBERED} SELECT doc_id, ord, no, heading, {RENDERED} AS rendered FROM numbered",
    "interactive_blocks": f"WITH {BLOCKS} SELECT doc_id, block, interactive, body FROM blocks",
    "block_sentences": f"WITH {SENTENCES} SELECT doc_id, block, sentence_no, sentence FROM sentences",
    "contents_table": rf"""WITH {LINES}
        SELECT doc_id, 'toc-' || (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1) AS id, length(regexp_extract(t, '^(#{{1,4}}){_S}', 1))::BIGINT AS level, regexp_extract(t, '(?s)^#{{1,4}}{_S}+(.*?){_S}*$', 1) AS title
        FROM fenced WHERE NOT inc AND NOT starts_with(t, '```') AND regexp_matches(t, '^#{{1,4}}{_S}')""",
    "heading_anchors": rf"""WITH {BLOCKS}, marked AS (SELECT *, (NOT inc AND NOT starts_with(t, '```') AND regexp_matches(t, '^#{{1,4}}{_S}')) AS head FROM bfenced),
        n AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS n FROM marked)
        SELECT doc_id, string_agg(CASE WHEN head THEN line || ' <a id="toc-' || n || '"></a>' ELSE line END, chr(10) ORDER BY pos) AS md FROM n GROUP BY doc_id""",
    "citation_edges": rf"""WITH {LINES}, cited AS (SELECT doc_id, pos, unnest(regexp_extract_all(line, '\[(\d+(?:[\t-\r\x{{85}}\p{{Z}},，\-–—]\s*\d+){{0,7}})\](?:[^(]|$)', 1)) AS body FROM lines),
        refs AS (SELECT doc_id, pos, unnest(string_split_regex(body, '[^0-9]+'))::BIGINT AS ref FROM cited)
        SELECT doc_id, ref, count(*) AS n_cited, min(pos)::BIGINT AS first_line FROM refs GROUP BY doc_id, ref""",
    "locator_paths": f"WITH {LOCATED} SELECT doc_id, block, locator FROM located",
    "excerpts": rf"""WITH {LOCATED}
        SELECT l.doc_id, l.block, '> ' || regexp_replace(s.sentence, '\n+', chr(10) || '> ', 'g') || chr(10) || '> —— ' || l.locator AS excerpt
        FROM located l JOIN blocks b USING (doc_id, block) LEFT JOIN (SELECT * FROM sentences WHERE sentence_no = 0) s USING (doc_id, block) WHERE b.interactive AND l.locator <> ''""",
    "excerpt_targets": rf"""WITH {LOCATED} SELECT b.doc_id, b.block, coalesce(s.sentence, b.body) AS text, l.locator FROM blocks b JOIN located l USING (doc_id, block) LEFT JOIN (SELECT * FROM sentences WHERE sentence_no = 1) s USING (doc_id, block)""",
    "image_references": rf"""WITH {MD}, found AS (SELECT doc_id, list_transform(regexp_extract_all(md, '{_IMAGE}', 1), lambda p: {trim('p')}) AS ps FROM docs),
        kept AS (SELECT doc_id, list_filter(ps, lambda p: p <> '' AND NOT starts_with(p, 'http')) AS ps FROM found),
        firsts AS (SELECT doc_id, list_filter(ps, lambda p, i: list_position(ps, p) = i)[1:12] AS ps FROM kept)
        SELECT doc_id, generate_subscripts(ps, 1) - 1 AS ord, unnest(ps) AS path FROM firsts""",
    "captions": rf"""WITH {SEGMENTS}
        SELECT doc_id, seg_index, CASE WHEN p <> '' AND NOT starts_with(p, 'http') THEN p END AS path, {trim(f"regexp_replace(content, '{_IMAGE}', '', 'g')")} = '' AS pure,
          {trim(r"regexp_replace(content, '(?s)^.*!\[.*?\]\(.*?\)', '', 'g')")} = '' AS pure_after_image, regexp_matches({ltrim('content')}, '^(Figure|Fig\.|Table|Tab\.|Schema|Diagram|Photo|图|表|插图)') AS captioned
        FROM (SELECT *, {trim(f"regexp_extract(content, '{_IMAGE}', 1)")} AS p FROM seg WHERE kind = 'image_caption')""",
    "title_authors": rf"""WITH {LINES},
        a AS (SELECT *, max(starts_with(t, '#')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS past, {trim("string_split(t, ',')[1]")} AS name FROM lines),
        b AS (SELECT *, (past = 1 AND NOT starts_with(t, '#') AND t <> '' AND strlen(t) > 120)::INT AS long FROM a),
        c AS (SELECT *, sum(long) OVER (PARTITION BY doc_id ORDER BY pos) AS stop FROM b),
        d AS (SELECT *, (past = 1 AND stop = 0 AND NOT starts_with(t, '#') AND t <> '' AND name <> '' AND strlen(name) <= 60 AND NOT contains(name, 'https://'))::INT AS fits FROM c),
        e AS (SELECT *, coalesce(max(fits) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM d),
        f AS (SELECT *, coalesce(max((t = '' AND seen = 1)::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM e),
        g AS (SELECT doc_id, name, min(pos) AS pos FROM f WHERE fits = 1 AND ended = 0 GROUP BY doc_id, name),
        names AS (SELECT doc_id, array_to_string(list(name ORDER BY pos)[1:5], ', ') AS authors FROM g GROUP BY doc_id),
        titles AS (SELECT doc_id, arg_min({trim("regexp_replace(t, '^#+', '')")}, pos) FILTER (starts_with(t, '#')) AS h FROM lines GROUP BY doc_id)
        SELECT doc_id, CASE WHEN h <> '' AND strlen(h) <= 200 THEN h END AS title, authors FROM titles LEFT JOIN names USING (doc_id)""",
    "document_signals": f"WITH {SIGNALS} SELECT doc_id, title, array_to_string(headings, ' | ') AS headings, length(abstract)::BIGINT AS abstract_chars, body_sample, keywords, table_count, image_count, math_symbols FROM signals",
    "inline_markup": f"WITH {SEGMENTS} SELECT doc_id, seg_index, {inline_html('content')} AS html FROM seg WHERE kind IN ('image_caption', 'table')",
    "inline_markup_all": f"WITH {SEGMENTS} SELECT doc_id, seg_index, {inline_html('content')} AS html FROM seg WHERE kind <> 'code'",
    "heading_texts": rf"WITH {SEGMENTS} SELECT doc_id, seg_index, CASE WHEN regexp_matches(content, '^#{{1,6}}{_S}') THEN length(regexp_extract(content, '^(#{{1,6}})', 1)) END AS level, {plain('content')} AS plain FROM seg WHERE kind = 'heading'",
}


# Classification, with the terms as literals.
def _list(terms) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + "]" if terms else "[]::VARCHAR[]"


def _hits(hay: str, terms) -> str:
    return f"list_filter({_list(terms)}, lambda t: contains({hay}, t))"


def _in_heads(terms) -> str:
    return f"list_filter({_list(terms)}, lambda t: len(list_filter(heads, lambda h: contains(h, t))) > 0)"


def _words(hay: str, terms) -> str:
    plain_terms, other = [t for t in terms if t.isascii() and t.isalpha() and t.islower()], [t for t in terms if not (t.isascii() and t.isalpha() and t.islower())]
    return f"(len(list_filter({_list(plain_terms)}, lambda t: regexp_matches({hay}, '(^|[^a-zA-Z0-9])' || t || '(e?s)?([^a-zA-Z0-9]|$)'))) + len({_hits(hay, other)}))"


_HAY = f"""{SIGNALS},
hay AS (SELECT *, list_transform(headings, lambda h: lower(h)) AS heads, lower(concat_ws(' ', title, abstract, body_sample, array_to_string(headings, ' '))) AS hay FROM signals),
emp AS (SELECT *, len({_in_heads(L.STRUCTURE_TERMS)}) AS n_structure, len({_hits('hay', L.STATISTICS_TERMS)}) AS n_statistics FROM hay)"""


def _score_rows() -> str:
    rows = []
    for i, p in enumerate(L.PARADIGMS):
        prior = " + ".join(["0.0::DOUBLE", *(f"CASE WHEN len({_hits('hay', terms)}) > 0 THEN {0.06 if first == i else 0.03}::DOUBLE ELSE 0.0::DOUBLE END" for terms, first, second in L.PRIORS if i in (first, second))])
        section = f"least(len({_in_heads(p.sections)}) / 2.0::DOUBLE, 1.0::DOUBLE)" if p.sections else "CASE WHEN n_structure >= 2 OR (n_structure = 1 AND n_statistics >= 2) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END"
        test = {"tables": "table_count > 0", "formulas": "math_symbols >= 4", "images": "image_count > 0"}
        shown = " OR ".join([test[k] for k, ids in L.OBJECTS.items() if p.id in ids] or ["false"])
        rows.append(
            f"SELECT doc_id, {i}::BIGINT AS ord, '{p.id}' AS id, {section} AS section_hit, least(len({_hits('hay', p.keywords)}) / 4.0::DOUBLE, 1.0::DOUBLE) AS keyword_hit, "
            f"CASE WHEN {shown} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS object_hit, {prior} AS prior, {_hits('hay', p.keywords)}[1:5] AS found FROM emp"
        )
    return " UNION ALL ".join(rows)


SCORES = f"""{_HAY},
raw AS ({_score_rows()}),
scores AS (SELECT *, CASE WHEN section_hit > 0 OR keyword_hit > 0 THEN 0.45::DOUBLE * section_hit + 0.40::DOUBLE * keyword_hit + 0.15::DOUBLE * object_hit + prior ELSE 0.0::DOUBLE END AS score FROM raw),
ranks AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS rk FROM scores),
told AS (SELECT doc_id, max(CASE WHEN rk = 1 THEN id END) AS best, max(CASE WHEN rk = 1 THEN score END) AS b, coalesce(max(CASE WHEN rk = 2 AND score >= 0.15 THEN score END), 0.0) AS second, sum((score >= 0.15)::INT) AS many,
  coalesce(string_agg(CASE WHEN rk > 1 AND score >= 0.15 THEN id END, ', ' ORDER BY rk), '') AS secondary FROM ranks GROUP BY doc_id),
recognised AS (SELECT *, CASE WHEN b < 0.50 THEN '单学科' WHEN many >= 3 THEN '多学科交叉' WHEN b >= 0.75 AND second < 0.25 THEN '单学科' WHEN second >= 0.25 THEN '双学科交叉' ELSE '单学科' END AS cross_type FROM told)"""


def _literal(x: object) -> str:
    return "'" + str(x).replace("'", "''") + "'"


def _fields(definitions: tuple[L.FieldDef, ...]) -> str:
    rows = (f"({_literal(d.family)}, {i}, {_literal(d.name)}, {_literal(d.label)}, {_literal(d.ftype)}, {_literal(d.description)}, {str(d.required).lower()}, {_literal(', '.join(d.values))})" for i, d in enumerate(definitions))
    return "fields(family, ford, name, label, ftype, description, required, choices) AS (VALUES " + ", ".join(rows) + ")"


_FIELDS = _fields(L.FIELDS)
_CLASHING = _fields(L.FIELDS + tuple(L.FieldDef(p.id, "source", "来源", "string", "") for p in L.PARADIGMS))
_SHORT = "CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.SHORT_NAMES.items()) + " END"
PLAN = f"""{SCORES}, {_FIELDS},
levels AS (
  SELECT doc_id, cross_type, 0 AS level, 'common' AS family, '通用' AS source FROM recognised
  UNION ALL SELECT doc_id, cross_type, 1, best, '主范式·' || {_SHORT.format(x='best')} FROM recognised
  UNION ALL SELECT r.doc_id, r.cross_type, k.rk, k.id, '次范式·' || {_SHORT.format(x='k.id')} FROM recognised r JOIN ranks k USING (doc_id)
    WHERE k.rk > 1 AND k.score >= 0.15 AND k.score >= CASE r.cross_type WHEN '多学科交叉' THEN 0.15 WHEN '双学科交叉' THEN 0.25 END
  UNION ALL SELECT doc_id, cross_type, 1000, 'dialogue', '交叉对话' FROM recognised WHERE cross_type = '多学科交叉'),
every AS (SELECT doc_id, cross_type, level, source, name, label, ftype, description, required, choices, row_number() OVER (PARTITION BY doc_id ORDER BY level, ford) AS pos FROM levels JOIN fields USING (family)),
uniq AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY pos) = 1),
near AS (SELECT *, name = 'validation_metrics' AND level BETWEEN 2 AND 999 AND coalesce(min(CASE WHEN name = 'evaluation_metrics' THEN pos END) OVER (PARTITION BY doc_id) < pos, false) AS close FROM uniq),
plan AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS ord, name, CASE WHEN close THEN label || '（次范式视角）' ELSE label END AS label, ftype, description, required, choices,
  CASE WHEN close THEN replace(source, '次范式·', '次范式视角·') ELSE source END AS source, cross_type,
  CASE cross_type WHEN '单学科' THEN '通用字段 + 主范式特有字段' WHEN '双学科交叉' THEN '通用字段 + 主范式特有字段 + 次范式特有字段' ELSE '通用字段 + 各范式特有字段 + 交叉对话字段' END AS strategy FROM near)"""

_HAN_LABEL = r"regexp_replace(label, '[\x00-\x7f\p{Z}]', '', 'g')"
_TERMS = (
    "list_sort(list_distinct(list_concat(list_filter(list_transform(string_split_regex(name || ' ' || description, '[^A-Za-z0-9]+'), lambda w: lower(w)), lambda w: length(w) >= 4), "
    f"CASE WHEN length({_HAN_LABEL}) >= 2 THEN list_transform(range(1, length({_HAN_LABEL})), lambda i: substring({_HAN_LABEL}, i, 2)) ELSE [] END)))"
)


def _contexts(cap: int) -> str:
    numbered = NUMBERED[len(SEGMENTS) :]
    take = "CASE WHEN a[1] + x[1] <= {room} THEN list_concat([a[1] + x[1]], a[2:], [x[2]]) ELSE a END"
    return f"""{PLAN}{numbered},
segs AS (SELECT doc_id, list(lower(content) ORDER BY ord) AS low, list(length({RENDERED})::BIGINT ORDER BY ord) AS sizes, list(no ORDER BY ord) AS nos FROM numbered GROUP BY doc_id),
searched AS (SELECT p.doc_id, p.name, p.label, p.ftype, s.sizes, s.nos, s.low, {_TERMS.replace('name ||', 'p.name ||').replace('description', 'p.description').replace('label', 'p.label')} AS terms FROM plan p JOIN segs s USING (doc_id)),
scored AS (SELECT *, list_transform(low, lambda c: len(list_filter(terms, lambda t: contains(c, t)))) AS sc FROM searched),
queue AS (SELECT *, list_transform(range(1, len(low) + 1), lambda i: [sizes[i], i - 1]) AS entries,
  list_transform(list_sort(list_transform(list_filter(range(1, len(low) + 1), lambda i: sc[i] > 0), lambda i: [-sc[i], i])), lambda e: [sizes[e[2]], e[2] - 1]) AS hits FROM scored),
first AS (SELECT *, list_reduce(hits, lambda a, x: {take.format(room=cap * 7 // 10)}, [0::BIGINT]) AS h FROM queue),
filled AS (SELECT *, list_reduce(list_filter(entries, lambda e: NOT list_contains(h[2:], e[2])), lambda a, x: {take.format(room=cap)}, h) AS f FROM first),
contexts AS (SELECT doc_id, name, label, len(f) - 1 AS n_chosen, f[1] AS context_chars, array_to_string(list_filter(list_transform(list_sort(f[2:]), lambda o: nos[o + 1]), lambda n: n IS NOT NULL), ',') AS paragraphs FROM filled)"""


def _found(d: L.Discipline) -> str:
    """The terms of a discipline that a document has, in the table's order."""
    word = "regexp_matches({h}, '(^|[^a-zA-Z0-9])' || t || '(e?s)?([^a-zA-Z0-9]|$)')"
    told = lambda h: f"CASE WHEN regexp_matches(t, '^[a-z]+$') THEN contains({h}, t) AND {word.format(h=h)} ELSE contains({h}, t) END"
    return f"list_filter({_list(d.terms)}, lambda t: CASE WHEN list_contains({_list(L.WEAK_TERMS)}, t) THEN {told('narrow')} ELSE {told('hay')} END)"


def _discipline_sql(hay: str) -> str:
    rows = [f"SELECT doc_id, '{k}' AS scheme, {i} AS ord, {_literal(d.group)} AS grp, {_literal(d.code)} AS code, {_literal(d.name)} AS name, {_found(d)} AS found FROM nar" for k, t in L.SCHEMES.items() for i, d in enumerate(t)]
    none = "CASE b.scheme " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.UNIDENTIFIED.items()) + " END"
    return f"""{hay}, nar AS (SELECT *, lower(concat_ws(' ', title, keywords)) AS narrow FROM hay), dis AS (SELECT *, len(found) AS hits FROM ({' UNION ALL '.join(rows)})),
      rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, scheme ORDER BY hits DESC, ord) AS r FROM dis), more AS (SELECT * FROM rk WHERE r > 1 AND hits >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id, scheme ORDER BY r) <= 3),
      disciplines AS (SELECT b.doc_id, b.scheme, CASE WHEN b.hits > 0 THEN b.grp END AS "group", CASE WHEN b.hits > 0 THEN b.code END AS code, CASE WHEN b.hits = 0 THEN {none} ELSE b.name END AS name, least(b.hits / 4.0, 1.0)::DOUBLE AS confidence,
        array_to_string(b.found[1:5], ', ') AS basis, coalesce(m.s, '') AS secondary
        FROM rk b LEFT JOIN (SELECT doc_id, scheme, string_agg(name, ', ' ORDER BY r) AS s FROM more GROUP BY doc_id, scheme) m USING (doc_id, scheme) WHERE b.r = 1)"""


def _direction_sql() -> str:
    rows = [f"SELECT doc_id, {i} AS ord, {_literal(d.name)} AS name, {_words('hay', d.terms)} AS hits FROM hay" for i, d in enumerate(L.DIRECTIONS)]
    return f"""directions AS (SELECT doc_id, r - 1 AS rank, name AS direction, round(least(hits / 3.0, 1.0)::DOUBLE, 6) AS weight
      FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, ord) AS r FROM ({' UNION ALL '.join(rows)}) WHERE hits >= 2) WHERE r <= 3)"""


def _papers() -> str:
    rows = ", ".join(f"({p[0]}::BIGINT, {_literal(p[1])}, {_literal(p[2])}, {_list(p[3])}, {_literal(p[4])}, {_literal(p[5])}, {p[6]}, {p[7]}, {p[8]})" for p in L.SAMPLE_PAPERS)
    return f"signals(doc_id, title, abstract, headings, body_sample, keywords, table_count, image_count, math_symbols) AS (VALUES {rows})"


_PAPERS = _papers() + SCORES[len(SIGNALS) :]
SQL |= {
    "lexicon_hits": f"WITH {_HAY} " + " UNION ALL ".join(f"SELECT doc_id, '{p.id}' AS id, len({_hits('hay', p.keywords)}) AS parts, {_words('hay', p.keywords)} AS words FROM hay" for p in L.PARADIGMS),
    "recognise_scores": f"WITH {SCORES} SELECT doc_id, ord, id, round(section_hit, 6) AS section_hit, round(keyword_hit, 6) AS keyword_hit, round(object_hit, 6) AS object_hit, round(prior, 6) AS prior, round(score, 6) AS score, array_to_string(found, ', ') AS found FROM scores",
    "recognise_primary": f"WITH {SCORES} SELECT doc_id, best AS paradigm, round(least(b, 1.0), 6) AS confidence, cross_type, b < 0.50 AS review, secondary FROM recognised",
    "disciplines_top": f"WITH {_discipline_sql(_HAY)} SELECT * FROM disciplines",
    "directions_top": f"WITH {_HAY}, {_direction_sql()} SELECT * FROM directions",
    "sample_recognition": f"""WITH {_discipline_sql(_PAPERS)}, {_direction_sql()}
        SELECT r.doc_id, r.best AS paradigm, round(least(r.b, 1.0), 6) AS confidence, r.cross_type, d.domestic, d.international, coalesce(t.directions, '') AS directions FROM recognised r
        JOIN (SELECT doc_id, max(CASE WHEN scheme = 'domestic' THEN name END) AS domestic, max(CASE WHEN scheme = 'international' THEN name END) AS international FROM disciplines GROUP BY doc_id) d USING (doc_id)
        LEFT JOIN (SELECT doc_id, string_agg(direction, ', ' ORDER BY rank) AS directions FROM directions GROUP BY doc_id) t USING (doc_id)""",
    "plan_notes": f"""WITH {SCORES}, {_CLASHING}, levels AS (SELECT doc_id, 0 AS level, 'common' AS family FROM recognised UNION ALL SELECT doc_id, 1, best FROM recognised
          UNION ALL SELECT r.doc_id, k.rk, k.id FROM recognised r JOIN ranks k USING (doc_id) WHERE k.rk > 1 AND k.score >= 0.15 UNION ALL SELECT doc_id, 1000, 'dialogue' FROM recognised),
        every AS (SELECT doc_id, level, name, label, row_number() OVER (PARTITION BY doc_id ORDER BY level, ford) - 1 AS pos FROM levels JOIN fields USING (family)),
        nth AS (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY pos) AS nth FROM every)
        SELECT doc_id, pos, '字段「' || label || '」同名冲突：采用主范式定义，跳过次范式同名项' AS note FROM nth WHERE nth > 1 AND level BETWEEN 2 AND 999""",
    "field_plan": f"WITH {PLAN} SELECT doc_id, ord, name, label, ftype, description, required, choices, source, cross_type, strategy FROM plan",
    "field_terms": f"WITH {_FIELDS} SELECT family, name, array_to_string({_TERMS}, ' ') AS terms FROM fields",
    "field_context": f"WITH {_contexts(3000)} SELECT doc_id, name, label, n_chosen, context_chars, paragraphs FROM contexts",
    "field_context_full": f"WITH {_contexts(60000)} SELECT doc_id, name, label, n_chosen, context_chars, paragraphs FROM contexts",
    "flagship": f"WITH {_contexts(60000)} SELECT doc_id, name, n_chosen, context_chars FROM contexts",
}

_MS = "CASE WHEN regexp_matches({x}, '^[0-9]{{10,17}}$') THEN epoch_ms({x}::BIGINT) WHEN regexp_matches({x}, '^[0-9]{{4}}-') THEN (try_cast({x} AS TIMESTAMPTZ) AT TIME ZONE 'UTC') END"


def stamp(x: str) -> str:
    return _MS.format(x=trim(x))


# Extraction results.
_FIELD_TYPE = """'[{"name":"VARCHAR","label":"VARCHAR","ftype":"VARCHAR","source":"VARCHAR","zh":"VARCHAR","en":"VARCHAR","table":"VARCHAR","failed":"BOOLEAN","error_category":"VARCHAR","error_message":"VARCHAR","content":"VARCHAR"}]'"""
VERSIONS = f"""versions AS (SELECT doc_id, version, max(row(field_schema, content, score, created_at)) AS n FROM digest_versions GROUP BY doc_id, version),
fs AS (SELECT doc_id, version, from_json(CASE WHEN json_valid(n[2]) THEN n[2] ELSE '[]' END, {_FIELD_TYPE}) AS f FROM versions),
flat AS (SELECT doc_id, version, generate_subscripts(f, 1) - 1 AS ord, unnest(f) AS x FROM fs),
dfields AS (SELECT doc_id, version, ord, x.name AS name, x.label AS label, x.ftype AS ftype, x.source AS source, coalesce(x.zh, x.content, '') AS zh, coalesce(x.en, '') AS en, x."table" AS "table",
  coalesce(x.failed, false) AS failed, coalesce(x.error_category, '') AS error_category, coalesce(x.error_message, '') AS error_message FROM flat),
top AS (SELECT doc_id, max(version) AS version FROM versions GROUP BY doc_id)"""
_SKIP = f"(failed OR {trim('zh')} IN ('', '引用缺失'))"
_FAIL_LABEL = "CASE WHEN error_category = 'config' OR regexp_matches(error_message, '401|403|API Key|鉴权|未授权|Unauthorized|无效') THEN '接口鉴权失败' WHEN error_category = 'network' THEN '网络不可达' WHEN error_category = 'llm' THEN '模型返回异常' WHEN error_category = 'internal' THEN '处理出错' ELSE '拆解失败' END"


def clean(x: str) -> str:
    t = trim(x)
    unfenced = trim(f"regexp_replace(regexp_replace(regexp_replace({t}, '^(?:```json)+', ''), '^(?:```)+', ''), '(?:```)+$', '')")
    return f"coalesce(CASE WHEN starts_with({t}, '{{') AND contains({t}, '\"zh\"') AND json_valid({t}) THEN {trim(f'''json_extract_string({t}, '$.zh')''')} END, {unfenced})"


_ORD = "0-9一二三四五六七八九十"
_MARKERS = (
    r"^[-*•·–]", r"^[①②③④⑤⑥⑦⑧⑨⑩]", rf"(?s)^(?:\([{_ORD}]+\)|（[{_ORD}]+）|\[[{_ORD}]+\]|【[{_ORD}]+】)", rf"^[{_ORD}]+[、.．)）]",
)


def strip_marker(x: str) -> str:
    t = ltrim(x)
    tests = [f"regexp_matches({t}, '{_MARKERS[0]}')", f"regexp_matches({t}, '{_MARKERS[1]}')", f"regexp_matches({t}, '{_MARKERS[2]}.')", f"regexp_matches({t}, '{_MARKERS[3]}([^0-9]|$)')"]
    return "CASE " + " ".join(f"WHEN {test} THEN {ltrim(f'''regexp_replace({t}, '{m}', '')''')}" for test, m in zip(tests, _MARKERS)) + f" ELSE {t} END"


def count_markers(x: str) -> str:
    return f"len(list_filter(list_transform(string_split_regex({x}, '[；;]'), lambda p: {trim('p')}), lambda s: s <> '' AND ({strip_marker('s')}) <> s))"


def normalize_list(x: str) -> str:
    t = trim(x)
    cited = f"(length({t}) - length(replace({t}, '[段落', ''))) // 3 + (length({t}) - length(replace({t}, '[Paragraph', ''))) // 10"
    pieces = f"CASE WHEN NOT contains({t}, chr(10)) AND ({cited} >= 2 OR {count_markers(t)} >= 2) THEN string_split_regex({t}, '[；;]') ELSE string_split_regex({t}, '\\r?\\n') END"
    return f"array_to_string(list_filter(list_transform({pieces}, lambda l: {strip_marker('l')}), lambda y: y <> ''), chr(10))"


_DIGEST_MD = f"""dmd AS (SELECT t.doc_id, '# ' || coalesce(any_value(d.title), '') || chr(10) || chr(10) || coalesce(string_agg('## ' || label || chr(10) || chr(10) || CASE WHEN coalesce("table", '') <> '' THEN "table" || chr(10) ELSE '' END || ({clean('zh')}) || chr(10)
  || CASE WHEN ({clean('en')}) <> '' THEN chr(10) || '_English:_ ' || ({clean('en')}) || chr(10) ELSE '' END || chr(10), '' ORDER BY ord) FILTER (label IS NOT NULL AND NOT {_SKIP}), '') AS markdown
  FROM top t LEFT JOIN dfields f USING (doc_id, version) LEFT JOIN documents d ON d.id = t.doc_id GROUP BY t.doc_id)"""

# Bilingual rows, the last load of each segment.
NEWEST = "newest AS (SELECT doc_id, seg_index, n[3] AS kind, n[4] AS original, n[5] AS translated, n[6] AS target_lang FROM (SELECT doc_id, seg_index, max(row(loaded_at, seg_id, kind, original, translated, target_lang)) AS n FROM bilingual_segments GROUP BY doc_id, seg_index))"


def sentence_count(x: str) -> str:
    around = rf"string_split_regex({x}, '(?s)\$\$.*?\$\$|\$[^$\n]+\$')"
    cut = lambda c: f"CASE WHEN regexp_matches({c}, '[\\x{{4e00}}-\\x{{9fff}}]') THEN {_HAN_CUT.replace('(c,', f'({c},')} ELSE {_LATIN_CUT.replace('(c,', f'({c},')} END"
    pieces = f"list_filter(list_transform(flatten(list_transform(list_transform({around}, lambda ch: {trim('ch')}), lambda c: string_split({cut('c')}, chr(30)))), lambda s: {trim('s')}), lambda s: s <> '')"
    return rf"(len({pieces}) + len(regexp_extract_all({x}, '(?s)\$\$.*?\$\$|\$[^$\n]+\$')))"


_META = ["请补充", "请提供", "请输入", "请告诉我", "我没有收到", "翻译要求", "正文内容", "完整文本", "无法翻译", "只提供了", "请您提供", "请发送", "请上传", "需要翻译的", "请重新发送", "我无法翻译", "仅包含图片引用", "没有需要翻译", "您提供的内容"]
ASSEMBLED = f"{NEWEST}, full_texts AS (SELECT doc_id, count(*) AS n_segments, string_agg(coalesce(translated, original), chr(10) || chr(10) ORDER BY seg_index) AS full_text FROM newest GROUP BY doc_id)"

# Tasks, the last row of each.
TASKS = f"latest AS (SELECT id, n[2] AS doc_id, n[3] AS type, n[4] AS status, n[5] AS progress, n[6] AS stage, n[7] AS error, n[8] AS created_at, n[9] AS updated_at, n[10] AS detail FROM (SELECT id, max(row(coalesce({stamp('updated_at')}, {stamp('created_at')}), doc_id, type, status, progress, stage, error, created_at, updated_at, detail)) AS n FROM tasks GROUP BY id))"
_DURATION = f"greatest(date_diff('millisecond', {stamp('created_at')}, {stamp('updated_at')}), 0)"

_KEPT_NAME = r"""substring(regexp_replace({x}, '[/\\:*?"<>|\x00-\x1f\x{7f}-\x{9f}]', '', 'g'), 1, 120)"""


_CANONICAL = r"regexp_replace(regexp_replace(file_path, '^\\\\\?\\', ''), '/+', '/', 'g')"


def _picked(x: str) -> str:
    """The words of a JSON text or of an array's items."""
    keys = ", ".join(f"CASE WHEN json_type(i, '$.{k}') = 'VARCHAR' THEN {trim(f"json_extract_string(i, '$.{k}')")} END" for k in ("term", "text", "item", "label", "definition", "zh"))
    item = f"CASE json_type(i) WHEN 'VARCHAR' THEN {trim("json_extract_string(i, '$')")} WHEN 'OBJECT' THEN coalesce({keys}, i::VARCHAR) ELSE '' END"
    lines = f"array_to_string(list_filter(list_transform(from_json({x}, '[\"JSON\"]'), lambda i: {item}), lambda t: t <> ''), chr(10))"
    return f"nullif(CASE json_type({x}) WHEN 'VARCHAR' THEN {trim(f"json_extract_string({x}, '$')")} WHEN 'ARRAY' THEN {lines} END, '')"


def sanitize(x: str) -> str:
    bare = trim("regexp_replace(" + trim(_KEPT_NAME.replace("{x}", x)) + ", '[. ]+$', '')")
    reserved = ", ".join(f"'{r}'" for r in ["CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))])
    return f"CASE WHEN {bare} = '' THEN '未命名笔记' WHEN upper({bare}) IN ({reserved}) THEN {bare} || '_' ELSE {bare} END"


def shorten(x: str, most: int) -> str:
    head = f"substring({x}, 1, {most})"
    before = f"regexp_extract({head}, '(?s)^(.*)[ ,，:：]', 1)"
    return f"CASE WHEN length({x}) <= {most} THEN {x} ELSE {rtrim(f'''CASE WHEN regexp_matches({head}, '[ ,，:：]') AND strlen({before}) >= {most // 2} THEN {before} ELSE {head} END''')} || '…' END"


_TITLE = "coalesce(title, '')"
_NAME = f"concat_ws('-', '08-24', nullif({shorten(trim(_TITLE), 48)}, ''), nullif({trim('''string_split_regex(authors, '[,;，；、]')[1]''')}, ''), year::VARCHAR, '阅读笔记')"
_BARE_TITLE = r"regexp_replace(lower({x}), '[\t-\r\x{85}\p{Z}\p{P}\p{S}]', '', 'g')"

_PARTS = f"""parts AS (SELECT x.doc_id, coalesce(x.title, '') AS title, d.md AS original, f.full_text AS translated, m.markdown AS digest FROM documents x JOIN docs d ON d.doc_id = x.doc_id
  LEFT JOIN full_texts f ON f.doc_id = x.doc_id LEFT JOIN dmd m ON m.doc_id = x.id)"""
_N2 = "chr(10) || chr(10)"

SQL |= {
    "digest_fields": f'WITH {VERSIONS} SELECT doc_id, version, ord, name, label, ftype, source, zh, en, "table", failed, error_category, error_message FROM dfields',
    "latest_digest": f"WITH {VERSIONS} SELECT doc_id, version, n[3] AS score FROM versions JOIN top USING (doc_id, version)",
    "next_version": f"WITH {VERSIONS} SELECT d.id AS doc_id, coalesce(t.version, 0) + 1 AS next_version FROM documents d LEFT JOIN top t ON t.doc_id = d.id",
    "version_list": f"WITH {VERSIONS} SELECT v.doc_id, v.version, {stamp('v.n[4]')} AS created, len(f)::BIGINT AS n_fields FROM versions v JOIN fs USING (doc_id, version)",
    "rollback_versions": f"WITH {VERSIONS}, firsts AS (SELECT doc_id, min(version) AS version FROM versions GROUP BY doc_id) SELECT v.doc_id, t.version + 1 AS version, '' AS field_schema, 0.0::DOUBLE AS score, length(v.n[2])::BIGINT AS content_chars FROM versions v JOIN firsts USING (doc_id, version) JOIN top t ON t.doc_id = v.doc_id",
    "failure_rollup": f"""WITH {VERSIONS}, lab AS (SELECT *, {_SKIP} AS skip, {_FAIL_LABEL} AS label2 FROM dfields JOIN top USING (doc_id, version)),
        c AS (SELECT doc_id, count(*) FILTER (skip) AS n_skipped, count(*) FILTER (skip AND failed AND label2 = '接口鉴权失败') AS credential, count(*) FILTER (skip AND failed AND label2 = '网络不可达') AS network, count(*) FILTER (skip AND failed AND label2 = '模型返回异常') AS llm FROM lab GROUP BY doc_id)
        SELECT *, n_skipped - credential - network - llm AS missing FROM c""",
    "failure_labels": f"WITH {VERSIONS} SELECT {_FAIL_LABEL} AS label, error_category = 'config' OR regexp_matches(error_message, '401|403|API Key|api key|API key|鉴权|无效|未授权|Unauthorized|invalid_api_key') AS credential, count(*) AS n FROM dfields WHERE failed GROUP BY ALL",
    "digest_markdown": f"WITH {VERSIONS}, {_DIGEST_MD} SELECT doc_id, markdown FROM dmd",
    "digest_citations": f"WITH {VERSIONS} SELECT name, ftype, count(*) AS n, count(*) FILTER (contains(zh, '引用缺失') OR contains(zh, '[段落') OR contains(zh, '段落 ') OR contains(zh, '（段落')) AS n_cited, count(*) FILTER ({_SKIP}) AS n_skipped FROM dfields GROUP BY name, ftype",
    "list_fields": f"WITH {VERSIONS} SELECT doc_id, version, name, {normalize_list('zh')} AS items, {count_markers('zh')} AS n_markers FROM dfields",
    "authors_as_list": f"SELECT doc_id, {normalize_list('a')} AS items FROM (SELECT doc_id, '1. ' || replace(authors, ';', '; - ') AS a FROM documents WHERE authors IS NOT NULL)",
    "bilingual": f"WITH {SEGMENTS}, {NEWEST} SELECT s.doc_id, s.seg_index, s.kind, length(s.content)::BIGINT AS n_original, coalesce(n.translated, '') AS translated FROM seg s LEFT JOIN newest n ON n.doc_id = s.doc_id AND n.seg_index = s.seg_index",
    "pending_segments": f"WITH {SEGMENTS}, {NEWEST} SELECT s.doc_id, s.kind, count(*) AS n_pending FROM seg s WHERE NOT EXISTS (SELECT 1 FROM newest n WHERE n.doc_id = s.doc_id AND n.seg_index = s.seg_index AND n.translated IS NOT NULL) GROUP BY s.doc_id, s.kind",
    "assembled_translation": f"WITH {ASSEMBLED} SELECT doc_id, n_segments, full_text FROM full_texts",
    "readable_translation": f"WITH {NEWEST} SELECT doc_id, string_agg(translated, chr(10) || chr(10) ORDER BY seg_index) AS text FROM newest WHERE {trim('translated')} <> '' GROUP BY doc_id",
    "checkpoint_rows": f"WITH {NEWEST} SELECT doc_id, seg_index::BIGINT AS seg_index, length(translated)::BIGINT AS n_chars FROM newest WHERE translated IS NOT NULL",
    "normalized_translations": rf"""WITH {NEWEST} SELECT doc_id, seg_index::BIGINT AS seg_index, kind, CASE WHEN kind IN ('table', 'code') THEN {trim('translated')} WHEN kind = 'toc' THEN array_to_string(list_filter(list_transform(string_split_regex(translated, '\r?\n'), lambda l: {trim('l')}), lambda l: l <> ''), '  ' || chr(10))
        ELSE regexp_replace({trim('translated')}, '{_S}+', ' ', 'g') END AS normalized, {' OR '.join(f"contains(translated, '{m}')" for m in _META)} AS meta_reply FROM newest WHERE translated IS NOT NULL""",
    "image_notes": f"""WITH {SEGMENTS}, p AS (SELECT *, {trim(f"regexp_extract(content, '{_IMAGE}', 1)")} AS p FROM seg), c AS (SELECT *, CASE WHEN kind = 'image_caption' AND contains(content, '![') THEN CASE WHEN p <> '' AND NOT starts_with(p, 'http') THEN p ELSE '' END END AS here FROM p)
        SELECT doc_id, seg_index, nullif(last_value(here IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seg_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS image FROM c""",
    "sentence_pairs": f"""WITH {NEWEST}, sized AS (SELECT doc_id, seg_index::BIGINT AS seg_index, {sentence_count('original')} AS n, {sentence_count("coalesce(translated, '')")} AS m FROM newest WHERE kind = 'paragraph')
        SELECT doc_id, seg_index, i AS orig_no, least(i, m - 1) AS trans_no FROM (SELECT *, unnest(range(0, n)) AS i FROM sized WHERE n > 0 AND m > 0)""",
    "glossary_lines": f"WITH t AS (SELECT DISTINCT lower({trim('language')}) AS language, {trim('term')} AS term, {trim('translation')} AS translation FROM term_glossary WHERE term IS NOT NULL AND translation IS NOT NULL) SELECT language, string_agg(term || ' = ' || translation, chr(10) ORDER BY term, translation) AS lines FROM t GROUP BY language",
    "live_segments": "SELECT doc_id, seg_index::BIGINT AS seg_index, length(n[3])::BIGINT AS n_chars FROM (SELECT doc_id, seg_index, max(row(coalesce(translated, '') <> '', loaded_at, coalesce(translated, ''))) AS n FROM bilingual_segments GROUP BY doc_id, seg_index)",
    "task_list": f"WITH {TASKS} SELECT t.id, coalesce(d.title, '未知文献') AS title, t.type, t.status, t.progress, t.stage, coalesce({stamp('t.updated_at')}, {stamp('t.created_at')}) AS happened FROM latest t LEFT JOIN documents d ON d.id = t.doc_id",
    "task_counts": f"WITH {TASKS} SELECT status, count(*) AS n FROM latest GROUP BY status UNION ALL SELECT 'all', count(*) FROM latest",
    "task_times": f"WITH {TASKS} SELECT id, {stamp('created_at')} AS created, {stamp('updated_at')} AS updated FROM latest",
    "task_stats": f"WITH {TASKS}, d AS (SELECT type AS event, {_DURATION} AS ms FROM latest) SELECT event, count(*) AS n, coalesce(sum(ms), 0)::BIGINT AS total_ms, round(coalesce(sum(ms), 0) / count(*), 3) AS mean_ms FROM d GROUP BY event",
    "event_stats": "WITH e AS (SELECT event_type AS event, round(coalesce(value, 0.0) * 100)::BIGINT AS ms FROM events) SELECT event, count(*) AS n, sum(ms)::BIGINT AS total_ms, round(sum(ms) / count(*), 3) AS mean_ms FROM e GROUP BY event",
    "diagnostics": f"WITH {TASKS} SELECT (SELECT count(*) FROM documents) AS n_documents, count(*) FILTER (status = 'failed') AS n_failed, count(*) FILTER (status IN ('running', 'queued')) AS n_active FROM latest",
    "tasks_after_exit": f"WITH {TASKS} SELECT CASE WHEN status IN ('running', 'queued') THEN 'failed' ELSE status END AS status, coalesce(stage = '已取消', false) AS cancelled, count(*) AS n FROM latest GROUP BY ALL",
    "tasks_unfinished": f"WITH {TASKS} SELECT id, status FROM latest WHERE coalesce(status NOT IN ('done', 'failed'), true)",
    "parse_regression": f"WITH {TASKS}, d AS (SELECT status, {_DURATION} AS ms FROM latest WHERE type = 'parse' AND status IN ('done', 'failed')) SELECT count(*) AS n, count(*) FILTER (status = 'failed') AS n_failed, round(count(*) FILTER (status = 'done') / count(*), 6) AS rate, round(avg(ms / 1000), 3) AS mean_s, count(*) FILTER (status = 'done') / count(*) >= 0.95 AS passed FROM d",
    "document_list": f"SELECT doc_id, title, status, read_status, {stamp('created_at')} AS created FROM documents",
    "unread_readable": "SELECT doc_id, status FROM documents WHERE coalesce(read_status, 'unread') = 'unread' AND status IN ('parsed', 'translated', 'digested')",
    "imported_paths": rf"WITH a AS (SELECT doc_id, file_path FROM documents UNION ALL SELECT doc_id + 1000000000000, '\\?\' || replace(file_path, '/', '//') FROM documents), p AS (SELECT doc_id, {_CANONICAL} AS path FROM a WHERE file_path IS NOT NULL), f AS (SELECT path, min(doc_id) AS first_doc FROM p GROUP BY path HAVING count(*) > 1) SELECT doc_id, first_doc FROM p JOIN f USING (path) WHERE doc_id <> first_doc",
    "import_checks": rf"""WITH known AS (SELECT DISTINCT {_CANONICAL} AS path FROM documents),
        cases("case", n, head) AS (VALUES ('again', 0, '%PDF-1.7'), ('new', 1, '%PDF-1.4'), ('damaged', 1, '%PD'), ('unreadable', 1, NULL), ('other', 2, '%PDF-1.7')),
        files AS (SELECT "case", head, CASE n WHEN 0 THEN file_path WHEN 1 THEN '/new' || file_path ELSE file_path || '.docx' END AS file_path FROM documents, cases),
        told AS (SELECT "case", CASE WHEN file_path IS NULL OR lower(regexp_extract(file_path, '\.([^./\\]+)$', 1)) <> 'pdf' THEN 'E-1001' WHEN head IS NULL THEN 'E-1003' WHEN NOT starts_with(head, '%PDF-') THEN 'E-1001' WHEN {_CANONICAL} IN (SELECT path FROM known WHERE path IS NOT NULL) THEN 'E-1002' END AS code FROM files)
        SELECT "case", code, count(*) AS n FROM told GROUP BY ALL""",
    "read_marks": "SELECT CASE WHEN id = (SELECT min(id) FROM documents) THEN 'read' ELSE read_status END AS read_status, count(*) AS n FROM documents GROUP BY 1",
    "config_list": "SELECT * FROM (VALUES ('a', 'one', 'sk-123***', 0::BIGINT), ('b', 'two too', '***', 0), ('c', 'three', 'sk-abc***', 1)) AS t(id, name, key_ref, is_default)",
    "coded_failures": f"WITH {VERSIONS} SELECT doc_id, version, name, '[' || CASE error_category WHEN 'network' THEN 'E-3014' WHEN 'config' THEN 'E-3015' WHEN 'llm' THEN 'E-3016' ELSE 'E-3001' END || '] ' || error_message AS told FROM dfields WHERE failed",
    "network_errors": f"""WITH {TASKS}, k AS (SELECT id, error, CASE WHEN regexp_matches(lower(error), 'time(d )?out|超时') THEN 1 WHEN regexp_matches(lower(error), 'connect|连接') THEN 2 ELSE 3 END AS k FROM latest WHERE error IS NOT NULL)
        SELECT id, 'network' AS category, ['请求超时: ', '无法连接到 API 服务器: ', '网络请求失败: '][k] || error AS message,
          ['网络连接不稳定或 API 响应过慢。请检查网络后重试', '可能的原因：① 本机未联网或网络受限；② API 地址（Base URL）填写错误。请检查网络与设置页配置', '可能的原因：① 本机未联网或网络受限；② 域名无法解析（DNS）。请检查网络后重试'][k] AS hint FROM k""",
    "directions_asked": "SELECT id, language, CASE WHEN language = 'zh_to_en' THEN 'zh_to_en' ELSE 'en_to_zh' END AS direction, CASE WHEN language IS NULL THEN '[E-9999] ' || term END AS error FROM term_glossary",
    "first_names": "SELECT doc_id, coalesce(nullif(trim(note_name), ''), nullif(trim(title), ''), nullif(trim(id), '')) AS name FROM documents",
    "rescued_answers": f"""WITH {VERSIONS}, forms AS (SELECT doc_id, version, name, unnest(['plain', 'object', 'list', 'items', 'broken']) AS form,
          unnest([zh, to_json({{'text': en, 'definition': zh}})::VARCHAR, to_json({{'list': [zh, en]}})::VARCHAR, '[' || to_json({{'term': zh}})::VARCHAR || ', {{"item": " x "}}, 7, {{"other":1}}, "last"]', '{{' || zh]) AS raw FROM dfields),
        j AS (SELECT *, {trim('raw')} AS t FROM forms), v AS (SELECT *, CASE WHEN t[1] IN ('{{', '[') AND json_valid(t) THEN t::JSON END AS x FROM j)
        SELECT doc_id, version, name, form, coalesce({", ".join(_picked(f"json_extract(x, '$.{k}')") for k in ("zh", "en", "text", "content", "term", "definition", "list"))}, CASE WHEN t[1] = '[' THEN {_picked('x')} END, raw) AS words FROM v""",
    "parsed_answers": f"""WITH {VERSIONS}, forms AS (SELECT doc_id, version, name, zh AS z, en AS e, unnest(['fenced', 'fenced', 'plain', 'plain']) AS form, unnest(['text', 'table', 'text', 'table']) AS ftype FROM dfields)
        SELECT doc_id, version, name, form, ftype, CASE WHEN form = 'plain' THEN {trim('z')} WHEN z <> '' THEN z ELSE '```json' || chr(10) || to_json({{'zh': z, 'en': e, 'table': '|a|'}})::VARCHAR || chr(10) || '```' END AS zh,
          CASE WHEN form = 'fenced' AND z <> '' THEN e ELSE '' END AS en, CASE WHEN form = 'fenced' AND z <> '' AND ftype = 'table' THEN '|a|' END AS "table" FROM forms""",
    "vision_choice": "SELECT * FROM (VALUES (1::BIGINT, 'm'), (2, 'd'), (3, 'd'), (4, NULL), (5, 'm')) AS t(id, model)",
    "edited_versions": f"WITH {VERSIONS} SELECT v.doc_id, v.version + 1 AS version, 0.0::DOUBLE AS score, length(v.n[2]) + 1 AS content_chars FROM versions v JOIN top USING (doc_id, version)",
    "first_version_fields": f"WITH {VERSIONS} SELECT doc_id, version, ord, name, zh FROM dfields WHERE version = (SELECT min(version) FROM digest_versions d WHERE d.doc_id = dfields.doc_id)",
    "glossary_changes": f"""WITH c AS (SELECT {trim('term')} AS term, {trim('tr')} AS tr FROM (SELECT term, translation || '！' AS tr FROM term_glossary UNION ALL SELECT journal, '期刊' FROM documents)),
        m AS (SELECT term, max(tr) AS tr FROM c WHERE term <> '' AND tr <> '' GROUP BY term),
        a AS (SELECT g.id, g.term, coalesce(m.tr, g.translation) AS translation FROM term_glossary g LEFT JOIN m USING (term) UNION ALL SELECT sha256(term), term, tr FROM m WHERE term NOT IN (SELECT term FROM term_glossary WHERE term IS NOT NULL))
        SELECT * FROM a WHERE term IS NULL OR term NOT IN (SELECT term FROM term_glossary WHERE term LIKE '% %')""",
    "renamed_notes": f"""WITH d AS (SELECT title, journal FROM documents WHERE title IS NOT NULL AND journal IS NOT NULL), k AS (SELECT DISTINCT {sanitize('title')} AS name FROM d),
        r AS (SELECT title AS name, max(journal) AS new_name FROM d GROUP BY title), s AS (SELECT new_name AS name, max(name) AS new_name FROM r GROUP BY new_name),
        f AS (SELECT name, {sanitize('name')} AS old, {sanitize('new_name')} AS new_name FROM (SELECT * FROM r UNION ALL SELECT * FROM s))
        SELECT name, new_name, CASE WHEN old NOT IN (SELECT name FROM k) THEN '笔记「' || name || '」不存在' WHEN old <> new_name AND new_name IN (SELECT name FROM k) THEN '已存在同名笔记「' || new_name || '」，请换一个名称' END AS error FROM f""",
    "quiet_events": "SELECT event_id, user_id FROM (SELECT event_id, user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS after FROM events) WHERE after IS NULL OR date_diff('microsecond', ts, after) >= 3600000000",
    "cleared_documents": "WITH chosen AS (SELECT DISTINCT id FROM documents WHERE status = 'translated') SELECT 'pending' AS what, count(*) AS n FROM documents WHERE status IN ('pending', 'translated') UNION ALL SELECT 'tasks', count(*) FROM tasks WHERE doc_id IS NULL OR doc_id NOT IN (SELECT id FROM chosen) UNION ALL SELECT 'versions', count(*) FROM digest_versions WHERE doc_id IS NULL OR doc_id NOT IN (SELECT id FROM chosen)",
    "note_names": f"SELECT doc_id, note, {sanitize('note')} AS file_name, short FROM (SELECT doc_id, {_NAME} AS note, {shorten(_TITLE, 20)} AS short FROM documents)",
    "masked_keys": "SELECT doc_id, CASE WHEN length(id) <= 8 THEN '***' ELSE substring(id, 1, 6) || '***' END AS masked, CASE WHEN length(source) <= 8 THEN '***' ELSE substring(source, 1, 6) || '***' END AS masked_source, base64(encode(source)) AS coded FROM documents",
    "retitled_headings": f"WITH {LINES}, titles AS (SELECT doc_id, arg_min({trim(chr(114) + 'egexp_replace(t, ' + chr(39) + '^#+' + chr(39) + ', ' + chr(39) * 2 + ')')}, pos) FILTER (starts_with(t, '#')) AS h FROM lines GROUP BY doc_id) SELECT t.doc_id, coalesce(CASE WHEN h <> '' AND strlen(h) <= 200 THEN {_BARE_TITLE.replace('{x}', 'h')} <> '' AND {_BARE_TITLE.replace('{x}', 'h')} = {_BARE_TITLE.replace('{x}', 'd.title')} END, false) AS same FROM titles t JOIN documents d USING (doc_id)",
    "replace_counts": "SELECT doc_id AS name, (length(text) - length(replace(text, 'the', ''))) // 3 AS n_replaced, length(replace(text, 'the', 'THE'))::BIGINT AS n_chars FROM documents WHERE contains(text, 'the')",
    "note_excerpts": f"WITH {NEWEST} SELECT doc_id, count(*) AS n, string_agg(original, chr(10) || '---' || chr(10) || chr(10) ORDER BY seg_index) AS note FROM newest WHERE kind = 'image_caption' GROUP BY doc_id",
    "segment_excerpts": f"WITH {NEWEST} SELECT doc_id, count(*) AS n, string_agg(original, chr(10) || '---' || chr(10) || chr(10) ORDER BY seg_index) AS note FROM newest GROUP BY doc_id",
    "export_markdown": f"""WITH {MD}, {ASSEMBLED}, {VERSIONS}, {_DIGEST_MD}, {_PARTS}, scopes(scope, o, t, g) AS (VALUES ('all', true, true, true), ('no-original', false, true, true), ('bilingual', true, true, false), ('translated', false, true, false), ('digest', false, false, true))
        SELECT doc_id, scope, '# ' || title || {_N2} || '> exported' || {_N2} || CASE WHEN o AND original IS NOT NULL THEN '---' || {_N2} || '## 原文' || {_N2} || original || {_N2} ELSE '' END
          || CASE WHEN t AND translated IS NOT NULL THEN '---' || {_N2} || '## 译文' || {_N2} || translated || {_N2} ELSE '' END || CASE WHEN g AND digest IS NOT NULL THEN '---' || {_N2} || '## AI 拆解' || {_N2} || digest || chr(10) ELSE '' END AS markdown FROM parts, scopes""",
    "table_html": rf"""WITH {SEGMENTS}, r AS (SELECT doc_id, seg_index, content, list_filter(list_transform(string_split(content, chr(10)), lambda l: {trim('l')}), lambda l: starts_with(l, '|') AND NOT regexp_matches(l, '^\|[\s:|-]+\|$')) AS rs FROM seg WHERE kind = 'table'),
        h AS (SELECT *, list_transform(rs, lambda r, i: '<tr>' || array_to_string(list_transform(string_split(regexp_replace(regexp_replace(r, '^\|', ''), '\|$', ''), '|'), lambda c: CASE WHEN i = 1 THEN '<th>' || {trim('c')} || '</th>' ELSE '<td>' || {trim('c')} || '</td>' END), '') || '</tr>') AS hs FROM r)
        SELECT doc_id, seg_index, CASE WHEN len(rs) < 2 THEN content ELSE '<table><thead>' || hs[1] || '</thead><tbody>' || array_to_string(hs[2:], '') || '</tbody></table>' END AS html FROM h""",
    "http_errors": """WITH e AS (SELECT event_id, [400, 401, 403, 404, 429, 500, 503, 418][(event_id % 8 + 1)::INT]::BIGINT AS status, props FROM events)
        SELECT event_id, status, status = 429 OR status >= 500 AS retryable, CASE status WHEN 400 THEN 'too_long_or_malformed' WHEN 401 THEN 'bad_key' WHEN 403 THEN 'no_access_or_balance' WHEN 404 THEN 'wrong_address_or_model' WHEN 429 THEN 'too_frequent' ELSE CASE WHEN status >= 500 THEN 'server_trouble' ELSE 'unknown' END END AS code,
          CASE WHEN json_type(props, '$.message') = 'VARCHAR' THEN json_extract_string(props, '$.message') WHEN trim(props) = '' THEN NULL ELSE CASE WHEN length(props) > 200 THEN substring(props, 1, 200) || '…' ELSE props END END AS detail FROM e""",
}

_ENGLISH = "'the', 'of', 'and', 'to', 'was', 'were', 'for', 'in', 'that', 'with', 'is', 'than', 'by', 'at'"
_TASK = r"""CASE WHEN kind = 'heading' THEN 'Give the Chinese title of this section heading, nothing else.' || chr(10) || chr(10)
  WHEN kind = 'reference' THEN 'Translate only the title in this reference into Chinese; keep names, journal, year, pages and numbers.' || chr(10) || chr(10)
  WHEN kind = 'image_caption' OR captioned THEN CASE WHEN contains(content, '![') THEN 'Keep the image syntax; translate only the other words.' || chr(10) || chr(10) ELSE '' END ELSE '' END"""
SQL |= {
    "paper_language": rf"""WITH c AS (SELECT doc_id, substring(text, 1, 2000) AS c FROM documents WHERE length(trim(text)) > 0),
        n AS (SELECT doc_id, length(regexp_replace(c, '[^\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(c, '[^\x{{4e00}}-\x{{9fff}}]', '', 'g')) AS han, length(regexp_replace(c, '[^\x{{3040}}-\x{{30ff}}]', '', 'g')) AS kana, string_split_regex(lower(c), '[^\p{{L}}]+') AS ws FROM c),
        e AS (SELECT *, len(list_filter(ws, lambda w: w IN ({_ENGLISH}))) AS english FROM n)
        SELECT doc_id, CASE WHEN han > 0.4 * letters AND kana * 20 < letters THEN '中文' WHEN english >= 2 AND english * 12 >= len(ws) THEN '英文' ELSE '其他' END AS language FROM e""",
    "translation_requests": rf"""WITH {SEGMENTS}, c AS (SELECT *, kind = 'image_caption' AND {trim(f"regexp_replace(content, '{_IMAGE}', '', 'g')")} = '' AS passthrough, regexp_matches({ltrim('content')}, '^(Figure|Fig\.|Table|Tab\.|Schema|Diagram|Photo|图|表|插图)') AS captioned FROM seg)
        SELECT doc_id, seg_index, passthrough, CASE WHEN NOT passthrough THEN length('Answer with the translation alone.' || chr(10) || chr(10) || {_TASK} || content)::BIGINT END AS n_chars FROM c""",
    "field_prompts": f"""WITH {PLAN} SELECT doc_id, count(*) AS n_prompts, sum(length('Field: ' || label || chr(10) || 'Holds: ' || description || chr(10) || 'Answer: ' || CASE ftype WHEN 'table' THEN 'a markdown table' WHEN 'list[string]' THEN 'an array, an item an element' WHEN 'enum' THEN 'one of ' || replace(choices, ', ', '、') WHEN 'integer' THEN 'a whole number' ELSE 'a short passage' END
          || chr(10) || 'Cite paragraphs as [段落 N]; answer 引用缺失 where none supports it.' || chr(10) || 'Reply with one JSON object: {{"zh": ..., "en": ..., "table": ...}}'))::BIGINT AS n_chars FROM plan GROUP BY doc_id""",
}


def _basis_rows() -> str:
    rows = []
    for i, p in enumerate(L.PARADIGMS):
        object_line = f"CASE WHEN s.object_hit > 0 THEN 'object: {p.object_label}' END" if p.object_label else "NULL"
        section_line = f"CASE WHEN len({_in_heads(p.sections)}) > 0 THEN 'sections: ' || array_to_string({_in_heads(p.sections)}, ', ') END"
        want = "NULL" if p.sections else "CASE WHEN NOT (n_structure >= 2 OR (n_structure = 1 AND n_statistics >= 2)) THEN 'no empirical sections' END"
        rows.append(f"SELECT e.doc_id, {i}::BIGINT AS ord, '{p.id}' AS id, concat_ws('; ', {section_line}, CASE WHEN len(s.found) > 0 THEN 'keywords: ' || array_to_string(s.found, ', ') END, {object_line}, CASE WHEN s.prior > 0 THEN 'field of study' END, {want}) AS basis FROM emp e JOIN scores s ON s.doc_id = e.doc_id AND s.ord = {i}")
    return " UNION ALL ".join(rows)


_CHECKS = {
    "paradigm-experimental-baseline": "fair baselines, complete metrics, ablations that explain each part", "paradigm-rct": "randomisation and blinding, sample size, registered outcomes, harms",
    "paradigm-empirical-stat": "identification, endogeneity, robustness, causal claims", "paradigm-theoretical": "definitions, consistent reasoning, answers to objections",
    "paradigm-case-study": "choice of cases, several sources of evidence, fitting analysis", "paradigm-systematic-review": "reproducible search, criteria, quality tools, heterogeneity and bias",
    "paradigm-computational-sim": "verification apart from validation, convergence, uncertainty", "paradigm-design-science": "aims that match the design, fitting evaluation, contribution to theory",
}
_NAMES = "CASE best " + " ".join(f"WHEN '{p.id}' THEN '{p.name}'" for p in L.PARADIGMS) + " END"
_CITE = r"\[(\d+(?:[\t-\r\x{85}\p{Z},，\-–—]\s*\d+){0,7})\]"
SQL |= {
    "recognise_basis": f"WITH {SCORES} {_basis_rows()}",
    "system_prompts": f"WITH {SCORES} SELECT doc_id, 'Take this paper apart field by field. Kind of study: ' || {_NAMES} || ' (' || cross_type || '). Cite paragraphs; invent nothing. Look closely at: ' || CASE best {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in _CHECKS.items())} END AS system FROM recognised",
    # Links that stand already are masked, so that no look-ahead is needed.
    "citation_links": rf"""WITH {BLOCKS}, masked AS (SELECT doc_id, pos, line, t, regexp_replace(line, '{_CITE}\(', chr(1) || '\1' || chr(2) || '(', 'g') AS m,
          coalesce(max((lower({trim(f"replace(regexp_replace(t, '^#+{_S}*', ''), '**', '')")}) IN ('references', 'reference', 'bibliography', '参考文献', '引用文献'))::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS refs FROM blines),
        cutup AS (SELECT *, string_split_regex(m, '{_CITE.replace('(\\d+', '(?:\\d+', 1)}') AS o, regexp_extract_all(m, '{_CITE}', 1) AS b FROM masked),
        linked AS (SELECT doc_id, pos, t, refs, replace(replace(array_to_string(list_transform(o, lambda p, i: p || coalesce(array_to_string(list_transform(list_filter(string_split_regex(b[i], '[^0-9]+'), lambda n: n <> ''), lambda n: '[' || n || '](#ref-' || n || ')'), ', '), '')), ''), chr(1), '['), chr(2), ']') AS l FROM cutup)
        SELECT doc_id, string_agg(CASE WHEN refs = 1 AND regexp_matches(t, '^\[\d+\]([.:、．]|{_S}|$)') THEN '<a id="ref-' || regexp_extract(t, '^\[(\d+)\]', 1) || '"></a>' || l ELSE l END, chr(10) ORDER BY pos) AS md FROM linked GROUP BY doc_id""",
}
