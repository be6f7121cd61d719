"""Markup residue in text documents (problem 6): HTML, Markdown, wiki and LaTeX to clean text that keeps its structure."""

from __future__ import annotations

import html
import re
from bisect import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, materialize

KINDS = ("heading", "list_item", "code", "formula")

# Element and environment names.
INLINE_TAGS = "a abbr acronym b big bdi bdo center cite code del dfn em font i ins kbd label mark nobr nowiki q ref s samp small span strike strong sub sup time tt u var wbr references gallery img input button"
BLOCK_TAGS = "address article aside blockquote body br caption col colgroup dd details div dl dt fieldset figcaption figure footer form head header hr html iframe legend link main meta nav noscript ol option p section select summary table tbody td textarea tfoot th thead title tr ul"
CODE_ENVIRONMENTS = "verbatim Verbatim lstlisting minted alltt"
MATH_ENVIRONMENTS = "equation align gather multline eqnarray displaymath math"
SECTION_COMMANDS = "part chapter section subsection subsubsection paragraph subparagraph"
DROPPED_COMMANDS = "cite citep citet label ref eqref pageref bibliography bibliographystyle usepackage documentclass pagestyle vspace hspace includegraphics input include index"

_CODE, _MATH, _END, _HEAD, _ITEM = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"
_PRIVATE = re.compile("[\ue000-\ue004]")

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})([^\n]*)$", re.M)
_OPEN = re.compile(
    r"(?P<fence>^ {0,3}(?:`{3,}|~{3,})[^\n]*$)|(?P<comment><!--)"
    r"|<(?P<raw>script|style|pre|syntaxhighlight|source|math|nowiki)\b[^<>]*?(?P<self>/)?>"
    rf"|\\begin\{{(?P<env>(?:{'|'.join((CODE_ENVIRONMENTS + ' ' + MATH_ENVIRONMENTS).split())})\*?)\}}"
    r"|(?P<esc>\\[$%#&_{}\\])|(?P<dd>\$\$)|(?P<br>\\\[)|(?P<par>\\\()"
    r"|(?P<tick>`+)|(?P<dollar>(?<![\w$])\$(?=[^\s$]))",
    re.M | re.I,
)
_INLINE_MATH = re.compile(r"\$([^$\n]*[^$\s])\$(?!\d)")
_MATHY = re.compile(r"[\\^_=+*/<>{}|-]|^[A-Za-z]$")
_TAG = re.compile(rf"</?(?P<name>h[1-6]|li|pre|script|style|syntaxhighlight|source|math|{'|'.join((INLINE_TAGS + ' ' + BLOCK_TAGS).split())})\b(?:\s[^<>\n]*|/)?(?:>|$)", re.M | re.I)
_ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,30}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});")
_SECTION = re.compile(
    rf"\\(?:{'|'.join(SECTION_COMMANDS.split())})\*?\s*(?:\[[^\]\n]*\])?\{{([^{{}}\n]*(?:\{{[^{{}}\n]*\}}[^{{}}\n]*)*)\}}")
_LATEX = re.compile(rf"\\(?:begin|end)\{{[A-Za-z]+\*?\}}|\\(?:{'|'.join((SECTION_COMMANDS + ' ' + DROPPED_COMMANDS).split())}|item|textbf|emph|textit|texttt|textsc|underline|href|url|footnote|title|author|maketitle)\b")
_DROP = re.compile(rf"~?\\(?:{'|'.join(DROPPED_COMMANDS.split())})\*?\s*(?:\[[^\]\n]*\])?(?:\{{[^{{}}\n]*\}})?")
_HREF = re.compile(r"\\href\{[^{}\n]*\}\{([^{}\n]*)\}")
_COMMAND = re.compile(r"\\[A-Za-z]+\*?\s*(?:\[[^\]\n]*\])?\{([^{}\n]*)\}")
_ENVIRONMENT = re.compile(r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\]|\{[^{}\n]*\})*")
_TEX_COMMENT = re.compile(r"(?<!\\)%.*$", re.M)
_WIKI_HEAD = re.compile(r"^(={1,6})\s*([^=\n].*?)\s*\1\s*$")
_ATX = re.compile(r"^ {0,3}#{1,6}[ \t]+(.*?)[ \t]*#*[ \t]*$")
_BULLET = re.compile(r"^\s*(?:[-*+]|\d{1,9}[.)])[ \t]+(\S.*)$")
_WIKI_ITEM = re.compile(r"^(?:[*#]+[:;]?|[:;]*[*#]+)[ \t]*(\S.*)$")
_HASHES = re.compile(r"^#[ \t]+\S")
_SETEXT = re.compile(r"^ {0,3}(?:={3,}|-{3,})[ \t]*$")
_FRONT = re.compile(r"\A---[ \t]*\n(?:[\w-]+:[^\n]*\n|[ \t-][^\n]*\n)*---[ \t]*(?:\n|\Z)")
_MD_INLINE = re.compile(
    r"(?<![\w*\\])(\*{1,3})(?=[^\s*])([^*\n]*[^\s*\n])\1(?![\w*])|(?<![\w\\])(_{1,3})(?=[^\s_])((?:[^_\n]|(?<=\w)_(?=\w))*[^\s_\n])\3(?!\w)|~~(?=\S)([^~\n]+)~~")
_MD_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\((?:<[^<>\n]*>|[^()\s]*)(?:\s+\"[^\"\n]*\")?\)")
_WIKI_LINK = re.compile(r"\[\[([^\[\]\n]*)\]\]")
_EXT_LINK = re.compile(r"\[(?:https?:)?//[^\s\]]+(?:[ \t]+([^\]\n]*))?\]")
_TEMPLATE = re.compile(r"\{\{([^{}]*)\}\}")
_QUOTES = re.compile(r"'{2,5}")
_QUOTE_LINE = re.compile(r"^ {0,3}>[ \t]?")


def _close(low: str, mark: str, start: int, missing: dict[str, int]) -> int:
    """Where ``mark`` comes next, or -1; a miss is remembered so that many openers stay linear."""
    if missing.get(mark, len(low) + 1) <= start:
        return -1
    at = low.find(mark, start)
    if at < 0:
        missing[mark] = start
    return at


def _protect(text: str, kept: list[tuple[str, str]]) -> tuple[str, bool]:
    """Code, formulas, comments and scripts out of the way: code and formulas become marks with a number."""
    low, out, at, found, missing = text.lower(), [], 0, False, {}

    def keep(mark: str, kind: str, body: str) -> str:
        kept.append((kind, body.strip("\n")))
        return f"{mark}{len(kept) - 1}{_END}"

    while m := _OPEN.search(text, at):
        end, put = m.end(), None
        kind = m.lastgroup
        if m.group("esc"):
            put = m.group()
        elif m.group("fence"):
            fence = _FENCE.match(text, m.start())
            mark = fence.group(1)
            if mark[0] == "`" and "`" in fence.group(2):
                put = m.group()
            else:
                close = re.compile(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", re.M).search(text, end)
                body = text[end : close.start() if close else len(text)]
                end = close.end() if close else len(text)
                put = "\n" + keep(_CODE, "code", body) + "\n"
        elif m.group("comment"):
            close = _close(low, "-->", end, missing)
            end, put = (close + 3 if close >= 0 else len(text)), ""
        elif m.group("raw"):
            tag = m.group("raw").lower()
            close = -1 if m.group("self") else _close(low, f"</{tag}", end, missing)
            stop = close if close >= 0 else len(text)
            body = text[m.end() : stop]
            after = low.find(">", stop) + 1 if close >= 0 else len(text)
            if m.group("self") or (close < 0 and tag in ("math", "nowiki", "source")):
                put = ""
            else:
                end = after or len(text)
                if tag in ("script", "style"):
                    put = ""
                elif tag == "math":
                    put = keep(_MATH, "formula", html.unescape(body))
                elif tag == "nowiki":
                    put = body
                else:
                    put = "\n" + keep(_CODE, "code", html.unescape(re.sub(r"</?code\b[^<>]*>", "", body, flags=re.I))) + "\n"
        elif m.group("env"):
            env = m.group("env")
            close = _close(text, f"\\end{{{env}}}", end, missing)
            code = env.rstrip("*") in CODE_ENVIRONMENTS.split()
            if close >= 0 or code:
                body = text[end : close if close >= 0 else len(text)]
                end = close + len(env) + 6 if close >= 0 else len(text)
                put = "\n" + keep(_CODE if code else _MATH, "code" if code else "formula", body) + "\n"
            else:
                put = "\n"
        elif kind in ("dd", "br", "par"):
            mark = {"dd": "$$", "br": "\\]", "par": "\\)"}[kind]
            close = _close(text, mark, end, missing)
            if close >= 0 and (kind == "dd" or "\n\n" not in text[end:close]) and text[end:close].strip():
                put = keep(_MATH, "formula", text[end:close])
                end = close + 2
            else:
                put = m.group()
        elif kind == "tick":
            close = _close(text, m.group(), end, missing)
            line = text.find("\n", end)
            if close >= 0 and (line < 0 or close < line):
                put = text[end:close].translate(_SHIELD)
                end, found = close + len(m.group()), True
            else:
                put = m.group()
        else:
            inner = _INLINE_MATH.match(text, m.start())
            if inner and _MATHY.search(inner.group(1)):
                put, end = keep(_MATH, "formula", inner.group(1)), inner.end()
            else:
                put = m.group()
        found |= kind in ("comment", "raw", "env", "self") or (kind != "esc" and put != m.group())
        out.append(text[at : m.start()])
        out.append(put)
        at = end
    out.append(text[at:])
    return "".join(out), found


# what stands in inline code is text: its marks are shifted out of reach and back at the end
_SHIELDED = "*_[]{}<>#'$=~&\\|"
_SHIELD = {ord(c): 0xE100 + i for i, c in enumerate(_SHIELDED)}
_UNSHIELD = {0xE100 + i: c for i, c in enumerate(_SHIELDED)}


def _hidden(text: str) -> str:
    """Without page heads and footnote bodies, which are no running text."""
    low, out, at, missing = text.lower(), [], 0, {}
    for m in re.finditer(r"<(head|ref)\b[^<>]*(?<!/)>", text, re.I):
        close = _close(low, f"</{m.group(1).lower()}", m.end(), missing) if m.start() >= at else -1
        if close >= 0:
            out.append(text[at : m.start()])
            at = close
    return "".join(out) + text[at:]


def _link(m: re.Match) -> str:
    body = m.group(1)
    if re.match(r"\s*(?:Category|File|Image)\s*:", body, re.I):
        return ""
    return body.rsplit("|", 1)[-1] if "|" in body else body.split("#")[0]


def _template(m: re.Match) -> str:
    if "\n" in m.group(1) or "|" not in m.group(1):
        return ""
    return m.group(1).rsplit("|", 1)[-1] if "=" not in m.group(1) else ""


def _lines(lines: list[str], furniture: frozenset[str]) -> tuple[list[tuple[str, str]], bool]:
    """Blocks of (kind, text) from protected lines."""
    blocks: list[tuple[str, str]] = []
    found = False
    n = len(lines)
    hashes = [bool(_HASHES.match(x)) for x in lines]
    for i, line in enumerate(lines):
        bare = line.strip()
        if not bare:
            blocks.append(("", ""))
            continue
        if bare[0] == _HEAD or bare[0] == _ITEM:
            kind = "heading" if bare[0] == _HEAD else "list_item"
            if bare[1:].strip():
                blocks.append((kind, bare[1:].strip()))
            continue
        if quote := _QUOTE_LINE.match(line):
            found, line = True, line[quote.end() :]
            bare = line.strip()
            if not bare:
                continue
        listed = hashes[i] and ((i and hashes[i - 1]) or (i + 1 < n and hashes[i + 1]))
        if m := _WIKI_HEAD.match(bare):
            blocks.append(("heading", m.group(2)))
        elif not listed and (m := _ATX.match(line)):
            if m.group(1).strip():
                blocks.append(("heading", m.group(1)))
            found = True
        elif _SETEXT.match(line):
            # under a line of text it makes that line a heading, else it is a rule
            if blocks and blocks[-1][0] == "text" and i and lines[i - 1].strip():
                blocks[-1] = ("heading", blocks[-1][1])
            found = True
        elif (m := _BULLET.match(line)) or ((line[0] in "*#" or re.match(r"[:;]+[*#]", line)) and (m := _WIKI_ITEM.match(line)) and (
            line[0] != "#" or listed)):
            blocks.append(("list_item", m.group(1)))
        elif m := re.match(r"^[:;]+[ \t]+(\S.*)$", line):
            found = True
            blocks.append(("text", m.group(1)))
        elif bare in furniture and _MATH not in bare and _CODE not in bare:
            continue
        else:
            blocks.append(("text", bare))
    return blocks, found


def parse(content: str | None, furniture: frozenset[str] = frozenset()) -> tuple[bool, list[tuple[str, str]], str]:
    """Whether the content holds markup, its (kind, text) elements in reading order, and the clean text. Furniture is
    left out only where there is markup."""
    if not content:
        return False, [], content or ""
    if furniture:
        whole = parse(content)
        if not whole[0]:
            return whole
    text = _PRIVATE.sub("", content.replace("\r\n", "\n").replace("\r", "\n"))
    kept: list[tuple[str, str]] = []
    found = False
    if front := _FRONT.match(text):
        found, text = True, text[front.end() :]
    text, hit = _protect(text, kept)
    found |= hit or bool(kept)

    def tag(m: re.Match) -> str:
        name, closing = m.group("name").lower(), m.group().startswith("</")
        if re.fullmatch("h[1-6]", name):
            return "\n" if closing else f"\n{_HEAD}"
        if name == "li":
            return "\n" if closing else f"\n{_ITEM}"
        return "\n" if name in _BLOCKS else ""

    found |= bool(_TAG.search(text))
    text = _hidden(text)
    text = _TAG.sub(tag, text)
    if _LATEX.search(text):
        found = True
        text = _TEX_COMMENT.sub("", text)
        text = _SECTION.sub(lambda m: f"\n{_HEAD}{m.group(1)}\n", text)
        text = _DROP.sub("", text)
        text = _HREF.sub(r"\1", text)
        text = re.sub(r"[ \t]*\\item\b[ \t]*(?:\[[^\]\n]*\])?", f"\n{_ITEM}", text)
        text = _ENVIRONMENT.sub("\n", text)
        for _ in range(4):
            text, k = _COMMAND.subn(r"\1", text)
            if not k:
                break
        text = text.replace("~", " ")
    for _ in range(4):
        text, k = _TEMPLATE.subn(_template, text)
        found |= bool(k)
        if not k:
            break
    text, a = _WIKI_LINK.subn(_link, text)
    text, b = _EXT_LINK.subn(lambda m: m.group(1) or "", text)
    text, c = _MD_LINK.subn(r"\1", text)
    text, d = _QUOTES.subn("", text)
    found |= bool(a or b or c or d)
    blocks, hit = _lines(text.split("\n"), furniture)
    found |= hit or any(k in ("heading", "list_item") for k, _ in blocks)

    elements: list[tuple[str, str]] = []
    clean: list[str] = []
    for kind, body in blocks:
        body, e = _MD_INLINE.subn(lambda m: m.group(2) or m.group(4) or m.group(5), body)
        body, f = _ENTITY.subn(lambda m: html.unescape(m.group()), body)
        if f and (re.search(r"</?(?:%s)\b[^<>]*>" % "|".join(_ALL_TAGS), body, re.I)):
            body = re.sub(r"</?(?:%s)\b[^<>]*>" % "|".join(_ALL_TAGS), "", body, flags=re.I)
        found |= bool(e or f)
        inner: list[tuple[str, str]] = []

        def put(m: re.Match) -> str:
            what, raw = kept[int(m.group(2))]
            inner.append((what, raw))
            return f"\n```\n{raw}\n```\n" if what == "code" else f"${raw.strip()}$"

        body = re.sub(f"([{_CODE}{_MATH}])(\\d+){_END}", put, body).translate(_UNSHIELD)
        body = re.sub(r"[ \t\xa0]+", " ", body).strip(" ") if not any(w == "code" for w, _ in inner) else body.strip("\n ")
        if kind in ("heading", "list_item"):
            elements.append((kind, body))
        elements.extend(inner)
        clean.append({"heading": "# ", "list_item": "- "}.get(kind, "") + body)
    return found, elements, re.sub(r"\n{3,}", "\n\n", "\n".join(clean)).strip("\n")


_BLOCKS = frozenset(BLOCK_TAGS.split())
_ALL_TAGS = (INLINE_TAGS + " " + BLOCK_TAGS + " h1 h2 h3 h4 h5 h6 li pre").split()


def crossing(at: list[tuple[int, str, int]]) -> list[str]:
    """Classes of a page, given as (rank, class, line number), that neither lie in one slot of each better ranked one
    nor have it in one of theirs."""
    where: dict[tuple[int, str], list[int]] = {}
    for rank, vec, pos in sorted(at):
        where.setdefault((rank, vec), []).append(pos)
    kept: list[list[int]] = []
    out = []
    for (_, vec), mine in sorted(where.items()):
        if all(bisect(a, b[0]) == bisect(a, b[-1]) or bisect(b, a[0]) == bisect(b, a[-1]) for a, b in ((k, mine) for k in kept)):
            kept.append(mine)
        else:
            out.append(vec)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _crossing(at: pd.Series) -> pd.Series:
    return pd.Series([crossing([(x["rank"], x["vec"], x["pos"]) for x in a]) for a in at], dtype=object)


def page_template(pages: DataFrame, site: str, page: str, text: str, min_pages: int = 5, min_tokens: int = 2,
    min_share: float = 0.2) -> DataFrame:
    """page, furniture: the lines of each page that belong to the template of its site.

    Lines are the tokens. Lines of a site with the same occurrence vector (the same pages, as often on each) form an
    equivalence class; the vector is compared by page count and an additive hash over pages, so no page list is ever
    gathered. A class is valid if it has ``min_tokens`` lines on ``min_pages`` different pages, each once a page and
    always in the same order, on ``min_share`` of the site's pages, and if the pages differ in what it leaves: on
    average two other lines and a quarter of its own number, else they are near-copies of one text. Valid classes
    nest: on each page one lies in a single slot (between two lines, before or after all) of any other, else the one
    on fewer pages is no template. The slots are left to the markup grammar. Pages with equal text count once; null
    texts and sites take no part."""
    texts = pages.select(site, page, text).where(f"{text} is not null and {site} is not null")
    once = texts.groupBy(F.col(site).alias("site"), F.xxhash64(text).alias("h")).agg(
        F.min(F.struct(F.col(page), F.col(text))).alias("x")).select("site", F.col(f"x.{page}").alias("page"),
            F.col(f"x.{text}").alias("text"))
    lines = once.select("site", "page", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line")).withColumn("line",
        F.trim("line")).where("line <> ''")
    per = lines.groupBy("site", "page", "line").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    per = materialize(per, "template-lines")
    vector = per.groupBy("site", "line").agg(F.count("*").alias("pages"), F.max("n").alias("n"),
        F.sum(F.xxhash64("page", "n").cast("decimal(20,0)")).alias("vec")).where(F.col("pages") >= min_pages)
    classes = vector.where("n = 1").groupBy("site", "pages", "vec").agg(F.count("*").alias("tokens")).where(F.col("tokens") >= min_tokens)
    sites = per.groupBy("site").agg(F.countDistinct("page").alias("all"))
    classes = classes.join(sites, "site").where(F.col("pages") >= min_share * F.col("all"))
    members = vector.join(classes.select("site", "pages", "vec"), ["site", "pages", "vec"], "left_semi").select("site", "line", "vec",
        "pages")
    placed = per.join(members, ["site", "line"]).select("site", "page", "vec", "pages", "pos", "line")
    order = placed.groupBy("site", "page", "vec").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: F.xxhash64(x.line).cast("string")), ",").alias("seq"))
    valid = order.groupBy("site", "vec").agg(F.countDistinct("seq").alias("orders")).where("orders = 1").select("site", "vec")
    # lines a page has besides those of the class
    length = per.groupBy("site", "page").agg(F.count("*").alias("length"))
    own = placed.groupBy("site", "page", "vec").agg(F.count("*").alias("tokens")).join(length, ["site", "page"])
    own = own.groupBy("site", "vec").agg(F.avg(F.col("length") - F.col("tokens")).alias("own"), F.max("tokens").alias("tokens"))
    valid = valid.join(own.where(F.col("own") >= F.greatest(F.lit(2), 0.25 * F.col("tokens"))), ["site", "vec"], "left_semi")
    placed = placed.join(valid, ["site", "vec"], "left_semi")
    crossed = placed.groupBy("site", "page").agg(F.collect_list(
        F.struct((-F.col("pages")).alias("rank"), F.col("vec").cast("string").alias("vec"), "pos")).alias("at")).where(
            F.size(F.array_distinct(F.transform("at", lambda x: x.vec))) > 1)
    crossed = crossed.select("site", F.explode(_crossing("at")).alias("v"))
    valid = valid.join(crossed.select("site", F.col("v").cast("decimal(38,0)").alias("vec")).distinct(), ["site", "vec"], "left_anti")
    lines_of = members.join(valid, ["site", "vec"], "left_semi").select("site", "line").distinct()
    # back to every page, copies too
    hits = texts.select(F.col(site).alias("site"), F.col(page).alias("page"),
        F.explode(F.array_distinct(F.transform(F.split(F.col(text), r"\r?\n"), lambda x: F.trim(x)))).alias("line")).where("line <> ''")
    out = materialize(hits.join(lines_of, ["site", "line"], "left_semi").groupBy("page").agg(F.collect_set("line").alias("furniture")),
        "template")
    discard(per)
    return out


SCHEMA = "record_id long, marked boolean, clean string, elements array<struct<kind:string,pos:int,text:string>>"


def clean_markup(records: DataFrame, site: str = "source", template: bool = True) -> DataFrame:
    """record_id, marked, clean, elements for every record of ``record_id, content, <site>``.

    Page furniture is deduced as the template of each site, the slots that remain are read by one grammar for HTML,
    Markdown, wiki and LaTeX, also mixed or broken. Code keeps its text untouched; what stands in code, scripts,
    styles and comments is no further element. elements counts pos from 1 within record and kind in reading order.
    Null content gives clean null and nothing else; empty content stays empty; a repeated record_id comes out each
    time; whole texts are read in time linear in their length."""
    rows = records.select("record_id", "content", *([site] if site in records.columns else []))
    if template and site in records.columns:
        found = page_template(rows, site, "record_id", "content")
        rows = rows.join(found.withColumnRenamed("page", "record_id"), "record_id", "left")
    else:
        rows = rows.withColumn("furniture", F.lit(None).cast("array<string>"))

    def run(batches):
        for b in batches:
            out = []
            for rid, content, lines in zip(b.record_id, b.content, b.furniture):
                marked, elements, clean = parse(content, frozenset(lines) if lines is not None else frozenset())
                count = dict.fromkeys(KINDS, 0)
                rows_ = []
                for kind, text in elements:
                    count[kind] += 1
                    rows_.append({"kind": kind, "pos": count[kind], "text": text})
                out.append((rid, marked, clean if content is not None else None, rows_))
            yield pd.DataFrame(out, columns=["record_id", "marked", "clean", "elements"])

    return rows.select("record_id", "content", "furniture").mapInPandas(run, SCHEMA)


def markup_rows(cleaned: DataFrame) -> DataFrame:
    """record_id, kind, pos: residue 0 for each record with markup, and each element its clean text keeps."""
    marked = cleaned.where("marked")
    kinds = F.concat(F.array(F.struct(F.lit("residue").alias("kind"), F.lit(0).alias("pos"))),
        F.transform("elements", lambda e: F.struct(e.kind.alias("kind"), e.pos.alias("pos"))))
    return marked.select("record_id", F.explode(kinds).alias("x")).select("record_id", "x.kind", "x.pos")
