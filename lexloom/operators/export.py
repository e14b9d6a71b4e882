"""Exports: markdown by scope, HTML with a theme, tables.

Defined results: an unknown scope is "all"; missing parts are left out; a table with
fewer than two rows stays text in :func:`table_html`.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import digests

#: Which parts a scope takes (fixed values).
SCOPES = {"no-original": ("translated", "digest"), "bilingual": ("original", "translated"), "translated": ("translated",), "digest": ("digest",)}
TITLES = {"original": "原文", "translated": "译文", "digest": "AI 拆解"}
#: Background, text, quiet text, rules, headings and code of a theme (fixed values).
THEMES = {"sepia": ("#f5ecd9", "#3a3226", "#8a7f6a", "#ddd0b4", "#2b2418", "#efe4c9"), "light": ("#ffffff", "#1f2937", "#6b7280", "#e5e7eb", "#111827", "#f3f4f6")}


def takes(scope: Column, part: str) -> Column:
    named = [s for s, ps in SCOPES.items() if part in ps]
    return F.coalesce(~scope.isin(*SCOPES) | scope.isin(*named), F.lit(True))


def parts(documents: DataFrame, originals: DataFrame, translations: DataFrame, versions: DataFrame) -> DataFrame:
    """(doc_id, title, original, translated, digest) of documents that were parsed."""
    titles = documents.select("doc_id", "id", F.coalesce("title", F.lit("")).alias("title"))
    told = digests.markdown(versions, titles.select(F.col("id").alias("doc_id"), "title")).select(F.col("doc_id").alias("id"), F.col("markdown").alias("digest"))
    joined = titles.join(originals.select("doc_id", F.col("md").alias("original")), "doc_id")
    joined = joined.join(translations.select("doc_id", F.col("full_text").alias("translated")), "doc_id", "left").join(told, "id", "left")
    return joined.select("doc_id", "title", "original", "translated", "digest")


def compose_markdown(scope: Column) -> Column:
    """The parts that the scope takes, as one markdown text."""
    out = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n> exported\n\n"))
    for part, title in TITLES.items():
        end = "\n" if part == "digest" else "\n\n"
        section = F.concat(F.lit(f"---\n\n## {title}\n\n"), F.col(part), F.lit(end))
        out = F.concat(out, F.when(takes(scope, part) & F.col(part).isNotNull(), section).otherwise(""))
    return out


def theme_css(theme: str) -> str:
    ground, ink, quiet, rule, head, code = THEMES.get(theme, THEMES["light"])
    return (
        f"body{{background:{ground};color:{ink};line-height:1.75}}main{{max-width:820px;margin:0 auto}}h1,h2{{border-bottom:1px solid {rule}}}h3,h4{{color:{head}}}"
        f".meta,blockquote{{color:{quiet}}}th,td{{border:1px solid {rule}}}th,code,pre{{background:{code}}}img{{max-width:100%}}"
    )


def table_html(c: Column) -> Column:
    """A markdown table as HTML, its first row as the head."""
    rows = F.filter(F.transform(F.split(c, "\n", -1), T.trim_all), lambda r: r.startswith("|") & ~r.rlike(r"^\|[\s:|-]+\|$"))
    cells = lambda r, tag: F.concat(
        F.lit("<tr>"), F.array_join(F.transform(F.split(F.regexp_replace(F.regexp_replace(r, r"^\|", ""), r"\|$", ""), r"\|", -1), lambda x: F.concat(F.lit(f"<{tag}>"), T.trim_all(x), F.lit(f"</{tag}>"))), ""), F.lit("</tr>")
    )
    body = F.array_join(F.transform(F.slice(rows, 2, 100000), lambda r: cells(r, "td")), "")
    return F.when(F.size(rows) < 2, c).otherwise(F.concat(F.lit("<table><thead>"), cells(F.get(rows, 0), "th"), F.lit("</thead><tbody>"), body, F.lit("</tbody></table>")))


#: Images that a page holds itself, in number and bytes, and their kinds (fixed values).
MOST_IMAGES, IMAGE_ROOM = 25, 15_000_000
MIME_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp"}


def embedded(sizes: Column, most: int = MOST_IMAGES, room: int = IMAGE_ROOM) -> Column:
    """Which of a document's images (their sizes, in order) are put into its page: up to
    ``most``, and ``room`` bytes; one that doesn't fit is passed over."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("used"), F.array().cast("array<boolean>").alias("takes"))

    def step(s: Column, size: Column) -> Column:
        fits = (s["n"] < most) & (s["used"] + size <= room)
        return F.struct((s["n"] + fits.cast("int")).alias("n"), (s["used"] + F.when(fits, size).otherwise(0)).cast("bigint").alias("used"), F.array_append(s["takes"], fits).alias("takes"))

    return F.aggregate(sizes, start, step, lambda s: s["takes"])


class Renderer:
    """Markdown to HTML, block by block. A table stands where it was, also before a
    fence or as a single row."""

    def __init__(self, images: dict[str, bytes] | None = None, most: int = MOST_IMAGES, room: int = IMAGE_ROOM) -> None:
        self.images, self.most, self.room = images or {}, most, room
        self.out: list[str] = []
        self.kind, self.held = "", []

    @staticmethod
    def inline(s: str) -> str:
        for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            s = s.replace(raw, safe)
        for mark, tag in (("`", "code"), ("**", "strong"), ("*", "em")):
            s = "".join(f"<{tag}>{p}</{tag}>" if i % 2 and (p or tag != "em") else p for i, p in enumerate(s.split(mark)))
        return s

    def embed(self, source: str) -> str:
        """The image itself while the page has room for it, else where it is."""
        data = self.images.get(source.removeprefix("./"))
        if data is None or source.startswith(("data:", "http")) or self.most < 1 or len(data) > self.room:
            return source
        self.most, self.room = self.most - 1, self.room - len(data)
        kind = MIME_TYPES.get(source.rpartition(".")[2].lower(), "application/octet-stream")
        return f"data:{kind};base64,{base64.b64encode(data).decode()}"

    def close(self) -> None:
        held, self.held = self.held, []
        if not held:
            return
        if self.kind == "code":
            escaped = "\n".join(held).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
            self.out.append(f"<pre><code>{escaped}</code></pre>")
        elif self.kind == "list":
            self.out.append("<ul>\n" + "\n".join(f"<li>{self.inline(x)}</li>" for x in held) + "\n</ul>")
        elif self.kind == "table":
            rows = [[c.strip() for c in r.strip().strip("|").split("|")] for r in held]
            self.out.append("<table>\n" + "\n".join("<tr>" + "".join(f"<{'td' if i else 'th'}>{self.inline(c)}</{'td' if i else 'th'}>" for c in r) + "</tr>" for i, r in enumerate(rows)) + "\n</table>")
        else:
            lines, line = [], ""
            for x in held:
                line = f"{line} {x.strip()}".strip()
                if x.endswith("  "):
                    lines.append(line)
                    line = ""
            self.out.append("<p>" + "<br>".join(self.inline(x) for x in [*lines, line] if x) + "</p>")

    def add(self, kind: str, line: str) -> None:
        if kind != self.kind:
            self.close()
            self.kind = kind
        self.held.append(line)

    def render(self, md: str) -> str:
        fenced = False
        for raw in md.split("\n"):
            t = raw.strip()
            if t.startswith("```"):
                if fenced:
                    self.held = self.held or [""]
                self.close()
                fenced = not fenced
                self.kind = "code" if fenced else ""
            elif fenced:
                self.held.append(raw.rstrip())
            elif t.startswith("|"):
                if set(t.strip("|")) <= set("|-: ") and "-" in t:
                    continue
                self.add("table", t)
            elif t.startswith("#") and (level := len(t) - len(t.lstrip("#"))) <= 4 and t[level : level + 1] in ("", " "):
                self.close()
                self.out.append(f"<h{level}>{self.inline(t[level:].strip())}</h{level}>")
            elif t.startswith(">"):
                self.close()
                self.out.append(f"<blockquote>{self.inline(t.lstrip('>').strip())}</blockquote>")
            elif t.startswith("!["):
                self.close()
                alt, _, rest = t[2:].partition("](")
                source = rest.partition(")")[0].split(" ")[0].strip("\"'")
                if source:
                    self.out.append(f'<img alt="{self.inline(alt)}" src="{self.inline(self.embed(source))}"/>')
            elif t in ("---", "***", "___"):
                self.close()
                self.out.append("<hr/>")
            elif t[:2] in ("- ", "* "):
                self.add("list", t[2:])
            elif t[:1].isdigit() and t.partition(". ")[0].isdigit() and ". " in t:
                self.add("list", t.partition(". ")[2])
            elif not t:
                self.close()
                self.kind = ""
            else:
                self.add("text", raw)
        if fenced:
            self.kind = "code"
        self.close()
        return "\n".join(self.out)


def render(md: str | None) -> str | None:
    return None if md is None else Renderer().render(md)


def chosen_images(parts: DataFrame, images: DataFrame, scope: str = "all") -> DataFrame:
    """(doc_id, images): of the images (doc_id, path, content) that a page shows, those
    that fit into it, in order of appearance. Sizes are chosen from before any image is
    gathered, so a page's images never exceed ``IMAGE_ROOM``."""
    shown = F.concat_ws("\n", *(F.col(p) for p in TITLES if scope not in SCOPES or p in SCOPES[scope]))
    bare = lambda p: F.regexp_replace(p, r"^\./", "")
    refs = parts.select("doc_id", F.posexplode(F.array_distinct(F.transform(T.image_refs(shown), bare))).alias("pos", "path"))
    known = images.select("doc_id", bare(F.col("path")).alias("path"), "content").dropDuplicates(["doc_id", "path"])
    sized = refs.join(known.select("doc_id", "path", F.length("content").alias("size")), ["doc_id", "path"])
    lists = sized.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "path", "size"))).alias("l"))
    takes = embedded(F.transform("l", lambda x: x["size"].cast("bigint")))
    taken = lists.select("doc_id", F.explode(F.arrays_zip(F.transform("l", lambda x: x["path"]).alias("path"), takes.alias("takes"))).alias("x")).filter("x.takes").select("doc_id", "x.path")
    return taken.join(known, ["doc_id", "path"]).groupBy("doc_id").agg(F.collect_list(F.struct("path", "content")).alias("images"))


def compose_html(parts: DataFrame, theme: str = "light", scope: str = "all", images: DataFrame | None = None) -> DataFrame:
    """(doc_id, html): a page of its own for each document, with its ``images`` (doc_id,
    path, content) inside as far as they fit. The formatter is procedural, so it runs in
    Arrow batches; its cost follows the text."""
    css, chosen = theme_css(theme), [p for p in TITLES if scope not in SCOPES or p in SCOPES[scope]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pages = []
            for row in batch.to_dict("records"):
                held = {x["path"]: bytes(x["content"]) for x in (row["images"] if row["images"] is not None else ())}
                renderer, sections = Renderer(held), []
                for p in chosen:
                    if isinstance(row[p], str):
                        renderer.out = []
                        sections.append(f"<section><h2>{TITLES[p]}</h2>{renderer.render(row[p])}</section>")
                pages.append(page(row["title"] or "", "\n<hr/>\n".join(sections), css))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "html": pages})

    if images is None:
        held = parts.withColumn("images", F.lit(None).cast("array<struct<path:string,content:binary>>"))
    else:
        held = parts.join(chosen_images(parts, images, scope), "doc_id", "left")
    return held.select("doc_id", "title", "original", "translated", "digest", "images").mapInPandas(run, "doc_id bigint, html string")


def page(title: str, body: str, css: str) -> str:
    name = Renderer.inline(title)
    return f'<!DOCTYPE html><html lang="zh-CN"><head><meta charset="utf-8"/><title>{name}</title><style>{css}</style></head><body><main><h1>{name}</h1>\n{body}</main></body></html>'


def note_pages(notes: DataFrame, theme: str = "light") -> DataFrame:
    """(name, html): a page for each note (name, body); an unreadable one has an empty page."""
    css = theme_css(theme)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"name": batch["name"], "html": [page(n, render(b) if isinstance(b, str) else "", css) for n, b in zip(batch["name"], batch["body"])]})

    return notes.select("name", "body").mapInPandas(run, "name string, html string")
