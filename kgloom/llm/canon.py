"""Mapping free-entered values to a canonical list (problem 3)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_ascii, strip_space
from ..operators.skew import salted_join
from ..session import materialize
from .edits import deletes, edit_bound, osa

# Words people use for the entries, by canonical name.
TERMS = {
    "People": "person, human, individual, author, writer, singer, artist, musician, composer, actor, poet, scientist, researcher, politician, founder, performer, ppl, pers, 인물, 사람, 작가, 가수, 人物, 作家, 作者, 歌手",
    "Organizations": "organization, organisation, org, company, corporation, corp, firm, brand, business, enterprise, vendor, publisher, startup, nonprofit, non profit, club, ngo, 조직, 회사, 기업, 단체, 组织, 公司, 企业, 品牌",
    "Countries": "country, nation, sovereign state, ctry, 국가, 나라, 国家",
    "Places": "place, location, loc, city, town, village, region, river, island, building, district, mountain, lake, 장소, 도시, 지역, 地点, 城市, 地区, 地方",
    "Products": "product, prod, device, gadget, appliance, merchandise, consumer good, goods, 제품, 상품, 产品, 商品",
    "Technologies": "technology, tech, framework, protocol, algorithm, software, programming language, technical method, 기술, 技术, 编程语言",
    "Concepts": "concept, idea, theory, principle, hypothesis, notion, abstract notion, 개념, 이론, 概念, 理论",
    "Events": "event, evt, conference, festival, battle, ceremony, summit, meeting, 행사, 축제, 사건, 事件, 活动, 会议",
    "Institutions": "institution, inst, university, school, museum, ministry, court, agency, government agency, public body, 기관, 대학교, 대학, 학교, 박물관, 机构, 大学, 学校, 博物馆",
    "MusicTracks": "track, song, tune, single, music track, recording, 노래, 곡, 歌曲, 单曲",
    "MusicAlbums": "album, lp, ep, long player, music album, 앨범, 음반, 专辑, 唱片",
}
# Words that only announce a value or say nothing about it.
MARKERS = "entity, type, kind, category, class"
STOP = "a, an, and, or, the, of, for, other, that, at, in, are, is"


def _words(text: str) -> list[str]:
    return [w.strip() for w in text.split(",")]


def folded_tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def plural(c: Column) -> Column:
    return F.when(c.rlike("[^aeiou]y$"), F.concat(F.expr("substr(term, 1, length(term) - 1)"), F.lit("ies"))).when(c.rlike("(s|x|ch|sh)$"),
        F.concat(c, F.lit("es"))).otherwise(F.concat(c, F.lit("s")))


def type_vocabulary(types: DataFrame, terms: dict[str, str] | None = None, learned: DataFrame | None = None) -> DataFrame:
    """type_id, phrase: the names and known aliases of the list and the synonyms of ``terms`` (type_name to a comma
    list), with regular plurals of Latin words, then what ``learned`` (type_id, term) adds. Its size is that of the
    list, of the parameter ``terms``, and of the words people use for types."""
    spark = types.sparkSession
    listed = types.select("type_id", F.explode(F.concat(F.array("type_name"),
        F.coalesce("known_aliases", F.array().cast("array<string>")))).alias("term"))
    given = [(k, w) for k, v in (TERMS if terms is None else terms).items() for w in _words(v)]
    more = spark.createDataFrame(given, "type_name string, term string").join(types.select("type_id", "type_name"),
        "type_name").select("type_id", "term")
    every = listed.unionByName(more).where("term is not null").withColumn("term",
        F.array_join(folded_tokens(F.col("term")), " ")).where("term <> ''")
    both = every.unionByName(every.where(F.col("term").rlike("^[a-z ]{3,}$")).withColumn("term", plural(F.col("term"))))
    out = both.groupBy(F.col("term").alias("phrase")).agg(F.min("type_id").alias("type_id"))
    if learned is None:
        return out
    return out.unionByName(learned.select(F.col("term").alias("phrase"), "type_id").join(out, "phrase", "left_anti"))


@F.pandas_udf(T.IntegerType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([osa(x, y, 2) for x, y in zip(a, b)], dtype="int32")


def repair_tokens(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """token, word, sim: each distinct token with the reference words within its edit bound, found through shared
    deletion neighbourhoods and verified. Exact words win: a token that is one gets no other."""
    words = vocabulary.select("word").distinct()
    exact = tokens.join(words, tokens.token == words.word).select("token", "word", F.lit(1.0).alias("sim"))
    left = tokens.join(words, tokens.token == words.word, "left_anti").select("token", F.explode(deletes(F.col("token"))).alias("h"))
    right = words.select("word", F.explode(deletes(F.col("word"))).alias("h"))
    near = left.join(right, "h").select("token", "word").distinct()
    near = near.withColumn("d", _distance("token", "word"))
    size = F.greatest(F.length("token"), F.length("word"))
    # a word of four letters may have lost one
    bound = F.when(size == 4, 1).otherwise(F.least(edit_bound(F.col("token")), edit_bound(F.col("word"))))
    near = near.where(F.col("d") <= bound)
    # the closest words only; on ties those that begin alike
    same = F.substring("token", 1, 1) == F.substring("word", 1, 1)
    near = near.select("token", "word", (1 - F.col("d") / size - F.when(same, 0.0).otherwise(0.02)).alias("sim"))
    best = near.groupBy("token").agg(F.max("sim").alias("top"))
    return exact.unionByName(near.join(best, "token").where("sim >= top - 0.05").select("token", "word", "sim"))


def _typed(records: DataFrame) -> DataFrame:
    return records.select(F.explode("entities").alias("e")).select(nfkc(F.col("e.name")).alias("name"),
        F.col("e.entity_type").alias("value"))


def learned_terms(records: DataFrame, entities: DataFrame, types: DataFrame, least: int = 5, purity: float = 0.9,
    mixed: float = 0.6) -> DataFrame:
    """type_id, term: the typed-in values whose meaning the data show. An entity often stands in several records, once
    with a listed type and elsewhere with a typed one: a value is a term of a type if the entities it was given to,
    ``least`` of them at least, have that listed type elsewhere in a share of ``purity``. Values that say nothing
    ("misc") go with entities of all types: below the share ``mixed`` a value is a term of no type (0). Entities with
    several listed types do not vote."""
    name = F.array_join(folded_tokens(F.col("name")), " ").alias("name")
    listed = types.select(F.col("type_name").alias("value"), "type_id").where("value is not null")
    every = _typed(records).unionByName(entities.select(nfkc(F.col("name")).alias("name"), F.col("entity_type").alias("value"))).select(
        name, "value")
    known = every.join(F.broadcast(listed), "value").groupBy("name").agg(F.min("type_id").alias("type_id"),
        F.max("type_id").alias("hi")).where("name <> '' and type_id = hi").select("name", "type_id")
    free = every.join(F.broadcast(listed.select("value")), "value", "left_anti").select("name",
        F.array_join(folded_tokens(nfkc(F.col("value"))), " ").alias("term")).where("name <> '' and term <> ''").distinct()
    per = free.join(known, "name").groupBy("term", "type_id").agg(F.count("*").alias("n"))
    best = per.groupBy("term").agg(F.sum("n").alias("all"), F.max(F.struct("n", (-F.col("type_id")).alias("neg"))).alias("x"))
    share = F.col("x.n") / F.col("all")
    best = best.where((F.col("all") >= least) & ((share < mixed) | ((share >= purity) & (F.col("x.n") >= least))))
    return best.select(F.when(share >= purity, -F.col("x.neg")).otherwise(0).alias("type_id"), "term")


def map_values(values: DataFrame, types: DataFrame, terms: dict[str, str] | None = None, learned: DataFrame | None = None,
    accept: float = 0.41) -> DataFrame:
    """value, type_id, score for each distinct non-blank value: the entry it stands for, 0 if none reaches ``accept``.

    Each distinct token is repaired against the reference words by edit distance; the repaired tokens rank the entries
    by soft TF-IDF: a phrase scores the share of its inverse-frequency weight that the value covers, times the
    similarity of the tokens and their place (the last word of the first part heads a value, words before it and
    parts after brackets, slashes or dashes qualify it). Ties go to the smaller type_id. Null and blank values give no
    row; very long values are scored like any other; an empty list maps all values to 0."""
    clean = values.select(F.col("value")).where(strip_space(F.col("value")) != "").distinct()
    parts = F.split(nfkc(F.col("value")), r"\s+[-–—]+\s+|[()/|;:,\[\]]+")
    marker = [F.lit(w) for w in _words(MARKERS)]
    seg = F.filter(F.transform(parts, folded_tokens), lambda t: F.size(F.filter(t, lambda w: ~w.isin(marker))) > 0)
    seg = F.transform(seg, lambda t: F.filter(t, lambda w: ~w.isin(marker)))
    rows = clean.select("value", F.posexplode(seg).alias("seg", "toks"))
    rows = rows.select("value", "seg", F.size("toks").alias("n"), F.posexplode("toks").alias("pos", "token"))
    place = F.when(F.col("seg") == 0, 1.0).otherwise(0.7) * F.when(F.col("pos") == F.col("n") - 1, 1.0).otherwise(0.6)
    rows = rows.groupBy("value", "token").agg(F.max(place).alias("place"))

    # written once: each branch below reads it
    phrases = materialize(type_vocabulary(types, terms, learned), "vocabulary")
    vocab = phrases.select("phrase", "type_id", F.explode(F.array_distinct(F.split("phrase", " "))).alias("word")).where(
        ~F.col("word").isin(_words(STOP)))
    idf = vocab.groupBy("word").agg((1 / F.log(1.0 + F.countDistinct("phrase") + 1)).alias("idf"))
    vocab = vocab.join(idf, "word")
    norm = vocab.groupBy("phrase").agg(F.sum("idf").alias("norm"))
    vocab = materialize(vocab.join(norm, "phrase").withColumn("share", F.col("idf") / F.col("norm")), "vocabulary-words")

    repaired = repair_tokens(rows.select("token").distinct(), vocab)
    hit = rows.join(repaired, "token").join(vocab.select("word", "phrase", "type_id", "share"), "word")
    hit = hit.groupBy("value", "phrase", "type_id", "word").agg(F.max(F.col("sim") * F.col("place") * F.col("share")).alias("part"),
        F.max("place").alias("place"))
    # words of one phrase count at the place of its best placed word
    scored = hit.groupBy("value", "phrase", "type_id").agg((F.sum(F.col("part") / F.col("place")) * F.max("place")).alias("score"))
    best = scored.groupBy("value").agg(F.max(F.struct(F.round("score", 6).alias("score"), (-F.col("type_id")).alias("neg"))).alias("x"))
    best = best.where(F.col("x.score") >= accept).select("value", (-F.col("x.neg")).cast("int").alias("type_id"),
        F.col("x.score").alias("score"))
    return clean.join(best, "value", "left").select("value", F.coalesce("type_id", F.lit(0)).alias("type_id"),
        F.coalesce("score", F.lit(0.0)).alias("score"))


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    import unicodedata

    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc(c: Column) -> Column:
    """ASCII strings are as they are; only the others go to Python."""
    return F.when(is_ascii(c), c).otherwise(_nfkc(F.when(~is_ascii(c), c)))


def free_types(records: DataFrame, types: DataFrame) -> DataFrame:
    """record_id, entity_pos, value: entities whose entity_type is given, not blank and not exactly a listed name.
    Records without entities, and null entities, give no rows; repeated records each count."""
    names = types.select(F.col("type_name").alias("value")).where("value is not null").distinct()
    rows = records.select("record_id", F.posexplode("entities").alias("entity_pos", "e")).select("record_id", "entity_pos",
        F.col("e.entity_type").alias("value"))
    rows = rows.where(strip_space(F.col("value")) != "")
    # the list is a parameter of fixed size, small enough to broadcast
    return rows.join(F.broadcast(names), "value", "left_anti")


def map_entity_types(records: DataFrame, types: DataFrame, terms: dict[str, str] | None = None,
    entities: DataFrame | None = None) -> DataFrame:
    """record_id, entity_pos, type_id for every row of ``free_types``. With ``entities`` the reference vocabulary also
    takes the terms that these and the records' own entities show (``learned_terms``)."""
    rows = free_types(records, types)
    learned = materialize(learned_terms(records, entities, types), "learned") if entities is not None else None
    mapped = map_values(rows.select("value"), types, terms, learned).select("value", "type_id")
    return salted_join(rows, mapped, "value", F.struct("record_id", "entity_pos")).select("record_id", "entity_pos",
        F.coalesce("type_id", F.lit(0)).alias("type_id"))
