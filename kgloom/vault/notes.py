"""A directory of Markdown notes: links, front matter, audit, diff, merge and organization plans."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lookup import known_type, migrated_type
from ..functions.text import folded, norm_name, parse_wikilink
from ..schemas import ENTITY_TYPES, LEGACY_TYPES, PROTECTED_DIRS

# What a link and a fence look like.
_LINK = re.compile(r"(!?)\[\[([^\]\r\n]+)\]\]")
_FENCE = re.compile(r"^[ \t]{0,3}(`{3,}|~{3,})(.*)$")


def _fences(text: str) -> list[tuple[int, int]]:
    """Fenced blocks: closed by at least as long a fence of the same kind alone on its line, else to the end."""
    out, at, mark, begin = [], 0, "", 0
    for line in text.splitlines(keepends=True):
        m = _FENCE.match(line.rstrip("\r\n"))
        if mark:
            if m and m.group(1)[0] == mark[0] and len(m.group(1)) >= len(mark) and not m.group(2).strip(" \t"):
                out.append((begin, at + len(line)))
                mark = ""
        elif m and not (m.group(1)[0] == "`" and "`" in m.group(2)):
            mark, begin = m.group(1), at
        at += len(line)
    return [*out, (begin, len(text))] if mark else out


def code_spans(text: str) -> list[tuple[int, int]]:
    """Where fenced blocks and inline code stand, in order and without overlap. Inline code runs from backticks to the
    next as many, also over line breaks but not over a fenced block; backticks after an odd number of backslashes are
    plain text."""
    fenced = _fences(text)
    spans = list(fenced)
    block = 0
    waiting: dict[int, int] = {}
    for m in re.finditer(r"(\\*)(`+)", text):
        start = m.start(2)
        while block < len(fenced) and start >= fenced[block][1]:
            block += 1
            waiting.clear()
        if len(m.group(1)) % 2 or (block < len(fenced) and start >= fenced[block][0]):
            continue
        size = len(m.group(2))
        opened = waiting.pop(size, None)
        if opened is None:
            waiting[size] = start
        else:
            spans.append((opened, m.end()))
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def wikilinks(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, raw) of ``[[...]]`` outside code; embeds are no links."""
    if not text or "[[" not in text:
        return []
    spans = code_spans(text)
    starts = [a for a, _ in spans]
    out = []
    for m in _LINK.finditer(text):
        # the last span that begins before the link ends
        i = bisect_left(starts, m.end()) - 1
        if not m.group(1) and (i < 0 or spans[i][1] <= m.start()):
            out.append((m.start(), m.end(), m.group(2)))
    return out


LINKS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("raw", T.StringType())]))


@F.pandas_udf(LINKS)
def find_links(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"start": a, "end": b, "raw": r} for a, b, r in wikilinks(t)])


def front_matter(text: str | None) -> dict[str, str]:
    """``key: value`` lines of the leading block, quotes taken off."""
    if not text or not text.startswith("---"):
        return {}
    lines = text.splitlines()
    if lines[0].strip() != "---":
        return {}
    out = {}
    for line in lines[1:]:
        if line.strip() == "---":
            return out
        if ":" in line and not line.startswith((" ", "\t")):
            k, v = line.split(":", 1)
            out[k.strip()] = v.strip().strip("\"'")
    return {}


def listed(value: str | None) -> list[str]:
    v = (value or "").strip()
    v = v[1:-1] if v.startswith("[") and v.endswith("]") else v
    return [x for x in (p.strip().strip("\"'") for p in v.split(",")) if x]


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def read_front(text: pd.Series) -> pd.Series:
    return text.map(front_matter)


@F.pandas_udf(T.ArrayType(T.StringType()))
def alias_list(v: pd.Series) -> pd.Series:
    return v.map(lambda x: listed(x if isinstance(x, str) else None))


def rewrite_links(text: str, to: dict[str, str]) -> str:
    """Link targets whose folded form is a key get their new target; heading, display and code stay."""
    out, at = [], 0
    for a, b, raw in wikilinks(text):
        left, bar, display = raw.partition("|")
        target, hash_, heading = left.partition("#")
        new = to.get(folded(target.strip()) or "")
        if new and new != target.strip():
            out += [text[at:a], "[[", new, hash_, heading, bar, display, "]]"]
            at = b
    return "".join(out) + text[at:]


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.md$", "")


def entity_files(files: DataFrame) -> DataFrame:
    """relative, domain, name, normalized, fields, aliases, content_hash of ``entities/<domain>/<name>.md`` notes;
    names with a leading underscore are no entities; legacy domains are mapped (``raw_domain`` keeps the folder)."""
    parts = F.split("path", "/")
    e = files.where(F.col("path").rlike(r"(^|/)entities/[^/]+/[^/_][^/]*\.md$"))
    e = e.select(F.col("path").alias("relative"), F.try_element_at(parts, F.lit(-2)).alias("raw_domain"), stem(F.col("path")).alias("name"),
        read_front("text").alias("fields"), F.col("hash").alias("content_hash"), "text")
    return e.withColumn("domain", known_type(F.col("raw_domain"))).withColumn("normalized", norm_name("name")).withColumn("aliases",
        alias_list(F.coalesce(F.col("fields")["aliases"], F.lit(""))))


def target_index(files: DataFrame) -> DataFrame:
    """key, path: every folded stem, alias and relative path a link may use."""
    fields = files.select("path", alias_list(F.coalesce(read_front("text")["aliases"], F.lit(""))).alias("aliases"))
    plain = files.select("path", F.explode(F.array(stem(F.col("path")), F.regexp_replace("path", r"\.md$", ""))).alias("k"))
    both = plain.unionByName(fields.select("path", F.explode("aliases").alias("k")))
    return both.select(norm_name("k").alias("key"), "path").where("key <> ''").distinct()


def link_rows(files: DataFrame) -> DataFrame:
    """file, raw, target, heading, display of every link."""
    rows = files.select(F.col("path").alias("file"), F.explode(find_links("text")).alias("l")).select("file", F.col("l.raw").alias("raw"))
    return rows.withColumn("p", parse_wikilink(F.col("raw"))).select("file", "raw", "p.*")


def audit(files: DataFrame) -> DataFrame:
    """kind, severity, path, detail: what is wrong with notes and their links. A link takes the first kind that fits."""
    e = entity_files(files)
    ns = F.col("name")
    domain = F.concat_ws("/", F.coalesce("domain", "raw_domain"), "normalized")
    bad = [
        e.where(F.col("domain").isNull()).select(F.lit("unknown_domain").alias("kind"), F.lit("error").alias("severity"), "relative",
            F.col("raw_domain").alias("detail")),
        e.where(F.col("raw_domain").isin(list(LEGACY_TYPES))).select(F.lit("legacy_entity_domain").alias("kind"),
            F.lit("warning").alias("severity"), "relative", F.col("raw_domain").alias("detail")),
        e.where(F.coalesce("normalized", F.lit("")) == "").select(F.lit("no_letters_or_digits").alias("kind"),
            F.lit("error").alias("severity"), "relative", ns.alias("detail")),
        e.where(F.trim("text") == "").select(F.lit("empty_note").alias("kind"), F.lit("error").alias("severity"), "relative",
            ns.alias("detail")),
        e.where(_not_nfc("name")).select(F.lit("unicode_normalization").alias("kind"), F.lit("warning").alias("severity"), "relative",
            ns.alias("detail")),
        e.where(F.col("fields")["name"].isNotNull() & (norm_name(F.col("fields")["name"]) != F.col("normalized"))).select(
            F.lit("frontmatter_name_mismatch").alias("kind"), F.lit("warning").alias("severity"), "relative",
                F.col("fields")["name"].alias("detail")),
        *([files.where(~F.col("readable")).select(F.lit("unreadable_note").alias("kind"), F.lit("error").alias("severity"),
            F.col("path").alias("relative"), F.col("path").alias("detail"))] if "readable" in files.columns else []),
        files.where(F.col("path").rlike(r"(^|/)entities/([^/]+\.md|[^/]+/[^/]+/.*)$") & ~stem(F.col("path")).startswith("_")).select(
            F.lit("unexpected_entity_path").alias("kind"), F.lit("warning").alias("severity"), F.col("path").alias("relative"),
                F.col("path").alias("detail")),
    ]
    same = e.groupBy(domain.alias("k")).agg(F.array_sort(F.collect_set("relative")).alias("p"),
        F.countDistinct(F.lower("name")).alias("spelled")).where(F.size("p") > 1)
    bad.append(same.select(F.when(F.col("spelled") == 1, "case_only_duplicate").otherwise("duplicate_entity").alias("kind"),
        F.lit("error").alias("severity"), F.col("p")[0].alias("relative"), F.array_join("p", ",").alias("detail")))
    al = e.select("domain", "relative", F.explode("aliases").alias("a")).withColumn("a", norm_name("a")).groupBy("domain",
        "a").agg(F.array_sort(F.collect_set("relative")).alias("p")).where(F.size("p") > 1)
    bad.append(al.select(F.lit("duplicate_entity_alias").alias("kind"), F.lit("warning").alias("severity"), F.col("p")[0].alias("relative"),
        F.array_join("p", ",").alias("detail")))
    out = bad[0]
    for b in bad[1:]:
        out = out.unionByName(b)
    links = link_rows(files)
    index = target_index(files).groupBy("key").agg(F.array_sort(F.collect_set("path")).alias("hits"))
    l = links.withColumn("key", norm_name("target")).join(index, "key", "left")
    one = F.try_element_at("hits", F.lit(1))
    folder = F.regexp_extract("target", r"(?:^|/)entities/([^/]+)/", 1)
    kind = (
        F.when((folder != "") & known_type(folder).isNull(), "invalid_entity_domain_link").when(F.col("hits").isNull() & (folder != ""),
            "wrong_entity_domain_link").when(F.col("hits").isNull(), "unresolved_wikilink")
        .when(F.size("hits") > 1, "ambiguous_wikilink").when(one == F.col("file"),
            "self_wikilink").when(norm_name(stem(one)) != F.col("key"),
                F.when(F.contains("target", F.lit("/")), F.lit(None)).otherwise("alias_wikilink"))
        .when((stem(one) != F.col("target")) & ~F.contains("target", F.lit("/")), "noncanonical_wikilink")
    )
    lk = l.withColumn("kind", kind).where("kind is not null")
    out = out.unionByName(lk.select("kind", F.when(F.col("kind").isin("unresolved_wikilink", "ambiguous_wikilink",
        "invalid_entity_domain_link", "wrong_entity_domain_link"), "error").otherwise("warning").alias("severity"),
            F.col("file").alias("relative"), F.col("raw").alias("detail")))
    aimed = l.where(F.size("hits") == 1).where(one != F.col("file")).select(one.alias("relative")).distinct()
    return out.unionByName(e.join(aimed, "relative", "left_anti").select(F.lit("orphan_entity").alias("kind"),
        F.lit("warning").alias("severity"), "relative", ns.alias("detail")))


@F.pandas_udf(T.BooleanType())
def _not_nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x is not None and unicodedata.normalize("NFC", x) != x)


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """change, path, target, hash, before: added, deleted, modified (with the hash before), and moved: one deleted and
    one added path of one hash."""
    b, a = before.select("path", F.col("hash").alias("h0")), after.select("path", F.col("hash").alias("h1"))
    j = b.join(a, "path", "full")
    gone, came = j.where("h1 is null"), j.where("h0 is null")
    g1 = gone.groupBy(F.col("h0").alias("hash")).agg(F.count("*").alias("n"), F.min("path").alias("src")).where("n = 1")
    c1 = came.groupBy(F.col("h1").alias("hash")).agg(F.count("*").alias("n"), F.min("path").alias("dst")).where("n = 1")
    moved = g1.select("hash", "src").join(c1.select("hash", "dst"), "hash")

    def rows(df: DataFrame, kind: str, path: str, hash_: str, target: Column | None = None, old: Column | None = None) -> DataFrame:
        none = F.lit(None).cast("string")
        return df.select(F.lit(kind).alias("change"), F.col(path).alias("path"), (target if target is not None else none).alias("target"),
            F.col(hash_).alias("hash"), (old if old is not None else none).alias("before"))

    out = rows(moved, "moved", "src", "hash", F.col("dst"))
    out = out.unionByName(rows(gone.join(moved.select(F.col("src").alias("path")), "path", "left_anti"), "deleted", "path", "h0"))
    out = out.unionByName(rows(came.join(moved.select(F.col("dst").alias("path")), "path", "left_anti"), "added", "path", "h1"))
    return out.unionByName(rows(j.where("h0 <> h1"), "modified", "path", "h1", old=F.col("h0")))


def change_plan(changes: DataFrame) -> DataFrame:
    """Moves can be repaired automatically, all else is for review."""
    return changes.withColumn("action", F.when(F.col("change") == "moved", "AUTO").otherwise("REVIEW"))


def merge_plan(entities: DataFrame) -> DataFrame:
    """action, domain, key, canonical, duplicates, reason over entity notes (relative, domain, name, normalized, fields,
    aliases): AUTO for equal names with equal front matter, REVIEW if it differs or an alias names another entity,
    SKIP for one name in several domains or an alias of several entities."""
    e = entities.where("domain is not null and normalized <> ''")
    plain = F.map_filter("fields", lambda k, v: k != "name")
    text = F.to_json(F.array_sort(F.map_entries(plain)))
    rank = F.struct((F.col("name") != F.initcap(F.lower("name"))).alias("a"),
        (F.col("name") != F.regexp_replace("name", r"\s+", " ")).alias("b"), "relative")
    g = e.withColumn("t", text).groupBy("domain", "normalized").agg(F.min_by("relative", rank).alias("canonical"),
        F.array_sort(F.collect_set("relative")).alias("all"), F.countDistinct("t").alias("kinds")).where(F.size("all") > 1)
    same = g.select(F.when(F.col("kinds") == 1, "AUTO").otherwise("REVIEW").alias("action"), "domain", F.col("normalized").alias("key"),
        "canonical", F.array_join(F.array_remove("all", F.col("canonical")), ",").alias("duplicates"),
            F.when(F.col("kinds") == 1, "same_name").otherwise("metadata_conflict").alias("reason"))
    cross = e.groupBy("normalized").agg(F.array_sort(F.collect_set("domain")).alias("d"),
        F.array_sort(F.collect_set("relative")).alias("all")).where(F.size("d") > 1)
    cross = cross.select(F.lit("SKIP").alias("action"), F.array_join("d", ",").alias("domain"), F.col("normalized").alias("key"),
        F.col("all")[0].alias("canonical"), F.array_join("all", ",").alias("duplicates"), F.lit("cross_domain").alias("reason"))
    al = e.select("domain", "relative", "normalized", F.explode("aliases").alias("a")).withColumn("a", norm_name("a"))
    hit = al.join(e.select("domain", F.col("normalized").alias("a"), F.col("relative").alias("other")),
        ["domain", "a"]).where("relative <> other")
    hit = hit.groupBy("domain", "a").agg(F.array_sort(F.collect_set("relative")).alias("from"), F.min("other").alias("other"))
    alias = hit.select(F.when(F.size("from") > 1, "SKIP").otherwise("REVIEW").alias("action"), "domain", F.col("a").alias("key"),
        F.col("other").alias("canonical"), F.array_join("from", ",").alias("duplicates"), F.lit("alias_names_entity").alias("reason"))
    return same.unionByName(cross).unionByName(alias)


def organization_plan(files: DataFrame, root: str = "20_Entities") -> DataFrame:
    """action, source, target, entity_type, file_hash, reason: entity notes to ``root/<domain>/<file>``; the folder and
    the front matter must agree, targets must be free; protected folders are left alone."""
    first = F.split_part(F.col("path"), F.lit("/"), F.lit(1))
    fields = read_front("text")
    folder = known_type(F.try_element_at(F.split("path", "/"), F.lit(-2)))
    said = known_type(F.coalesce(fields["entity_type"], fields["type"], F.lit("")))
    f = files.where(~first.isin(PROTECTED_DIRS)).select("path", "hash", folder.alias("folder"),
        said.alias("said")).where("folder is not null or said is not null")
    dom = F.coalesce("folder", "said")
    f = f.withColumn("entity_type", dom).withColumn("target",
        F.concat_ws("/", F.lit(root), "entity_type", F.regexp_replace("path", r"^.*/", "")))
    taken = files.select(F.col("path").alias("target"), F.col("hash").alias("there"))
    many = f.groupBy("target").agg(F.count("*").alias("n"))
    f = f.join(taken, "target", "left").join(many, "target")
    why = F.when(F.col("path") == F.col("target"), "in_place").when(
        F.col("folder").isNotNull() & F.col("said").isNotNull() & (F.col("folder") != F.col("said")),
            "domain_conflict").when(F.col("n") > 1, "target_collision").when(F.col("there") == F.col("hash"),
                "identical_target").when(F.col("there").isNotNull(), "target_exists").otherwise("move")
    f = f.withColumn("reason", why)
    act = F.when(F.col("reason") == "move", "AUTO").when(F.col("reason").isin("in_place", "identical_target"), "SKIP").otherwise("REVIEW")
    return f.select(act.alias("action"), F.col("path").alias("source"), "target", "entity_type", F.col("hash").alias("file_hash"), "reason")


def consistency(
    notes: DataFrame, entities: DataFrame, documents: DataFrame | None = None, aliases: DataFrame | None = None,
        relations: DataFrame | None = None,
    document_entities: DataFrame | None = None, entity_sources: DataFrame | None = None, files: DataFrame | None = None,
) -> DataFrame:
    """class, domain, key: entity notes against the tables, by (domain, folded name), as far as tables are given.

    vault_only, table_only and both; table_without_note (table_only with aliases); vault_without_provenance (no source
    row); links of the notes to entities the tables lack; links of documents and sources to entities or documents that
    are not there; relation ends without a table entity or a note; aliases without entity; invalid types; documents
    without hash. Each fact once."""
    v = notes.select(F.col("domain"), F.col("normalized").alias("key"),
        F.lit(True).alias("in_vault")).where("domain is not null").distinct()
    packed = F.size(F.coalesce(F.col("aliases"), F.array().cast("array<string>"))) > 0 if dict(entities.dtypes).get(
        "aliases") == "array<string>" else F.coalesce(F.trim("aliases"), F.lit("")) != "" if "aliases" in entities.columns else F.lit(False)
    t = entities.select(known_type(F.col("entity_type")).alias("domain"), norm_name("name").alias("key"), "name",
        packed.alias("packed")).where("domain is not null")
    t = t.groupBy("domain", "key").agg(F.max("packed").alias("packed"), F.lit(True).alias("in_table"))
    side = F.when(F.col("in_table").isNull(), "vault_only").when(F.col("in_vault").isNull(), "table_only").otherwise("both")
    joined = v.join(t, ["domain", "key"], "full")
    out = joined.select(side.alias("class"), "domain", "key")

    def add(df: DataFrame, name: str, domain: Column, key: Column) -> None:
        nonlocal out
        out = out.unionByName(df.select(F.lit(name).alias("class"), F.coalesce(domain, F.lit("")).alias("domain"),
            key.alias("key")).distinct())

    add(joined.where("in_vault is null and packed"), "table_without_note", F.col("domain"), F.col("key"))
    add(entities.where(~F.coalesce(F.col("entity_type"), F.lit("")).isin(ENTITY_TYPES)), "table_invalid_type", F.col("entity_type"),
        F.col("name"))
    there = t.select("domain", "key")
    named = entities.select(norm_name("name").alias("key")).distinct()
    exact = entities.select("name").distinct()
    if aliases is not None:
        lost = aliases.select(norm_name("canonical_name").alias("key"), "entity_type").join(named, "key", "left_anti")
        add(lost, "alias_without_entity", F.col("entity_type"), F.col("key"))
    if relations is not None:
        triple = F.concat_ws("|", "source_name", "relation", "target_name")
        ends = relations.select(triple.alias("fact"), F.explode(F.array("source_name", "target_name")).alias("name"))
        add(ends.join(exact, "name", "left_anti"), "relation_without_entity", F.lit(""), F.col("fact"))
        add(ends.withColumn("key", norm_name("name")).join(v.select("key").distinct(), "key", "left_anti"), "relation_without_note",
            F.lit(""), F.col("fact"))
    if documents is not None:
        add(documents.where("content_hash is null or content_hash = ''"), "document_without_hash", F.lit(""), F.col("id"))
    known = documents.select(F.col("id").alias("document_id")).distinct() if documents is not None else None
    for name, links in (("document_entity", document_entities), ("entity_source", entity_sources)):
        if links is None:
            continue
        rows = links.select("document_id", "entity_name", F.coalesce(migrated_type(F.col("entity_type")), F.lit("")).alias("domain"),
            norm_name("entity_name").alias("key"))
        fact = F.concat_ws("|", "document_id", "entity_name")
        add(rows.join(there, ["domain", "key"], "left_anti"), f"{name}_without_entity", F.col("domain"), fact)
        if known is not None:
            add(rows.join(known, "document_id", "left_anti"), f"{name}_without_document", F.col("domain"), fact)
    if entity_sources is not None:
        told = entity_sources.select(migrated_type(F.col("entity_type")).alias("domain"), norm_name("entity_name").alias("key")).distinct()
        both = joined.where("in_vault and in_table").select("domain", "key")
        add(both.join(told, ["domain", "key"], "left_anti"), "vault_without_provenance", F.col("domain"), F.col("key"))
    if files is not None:
        index = target_index(files).groupBy("key").agg(F.min("path").alias("relative"),
            F.max("path").alias("hi")).where("relative = hi").select(F.col("key").alias("aim"), "relative")
        aimed = link_rows(files).withColumn("aim", norm_name("target")).join(index,
            "aim").join(notes.select("relative", "domain", F.col("normalized").alias("key")), "relative")
        add(aimed.join(there, ["domain", "key"], "left_anti"), "link_without_entity", F.col("domain"), F.concat_ws("|", "file", "target"))
    return out
