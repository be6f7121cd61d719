"""Subject area of each document (problem 10)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_ascii
from ..session import discard, materialize

#: The weight of an item that only ever comes with one subject, however many subjects there are.
CERTAIN = 2.3


def _lift(p: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """How far ``p`` lies between the prior (0) and certainty (``CERTAIN``), in logs."""
    prior = np.minimum(prior, 0.5)
    return CERTAIN * np.log(p / prior) / -np.log(prior)


def sentences(text: Column) -> Column:
    """Lines, and sentences within them: a full stop ends one only before a capital, digit or letter without case."""
    marked = F.regexp_replace(text, r"([.!?][\"”’)\]]?)[ \t\xa0]+(?=[\"“‘«(\[]?[\p{Lu}\p{Lo}\d])", "$1\n")
    marked = F.when(is_ascii(text) | ~text.rlike("[。！？]"), marked).otherwise(F.regexp_replace(marked, r"(?<=[。！？])(?=[^\n])", "\n"))
    return F.filter(F.split(marked, r"[\r\n]+"), lambda s: s.rlike(r"[\p{L}\p{N}]"))


def sentence_items(s: Column) -> Column:
    """What a sentence holds for the rules: words of three letters or more without plural s, hyphenated words whole,
    and pairs of neighbouring characters of Hangul and Han runs."""

    def words(letter: str) -> Column:
        found = F.regexp_extract_all(F.lower(s), F.lit(f"({letter}+(?:-{letter}+)*)"), F.lit(1))
        return F.transform(F.filter(found, lambda w: F.length(w) >= 3),
            lambda w: F.when(w.endswith("s"), F.regexp_replace(w, f"(?<={letter}{{2}}[^s])s$", "")).otherwise(w))

    runs = F.regexp_extract_all(s, F.lit(r"(\p{IsHangul}{2,}|\p{IsHan}{2,})"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1),
        lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.when(is_ascii(s), words("[a-z]")).otherwise(F.concat(words(r"\p{IsLatin}"), pairs)))


def document_bags(documents: DataFrame) -> DataFrame:
    """doc_id, kind, bag: the items of each sentence, sentences on lines of their own; the whole text is read."""
    bag = F.array_join(F.transform(sentences(F.col("text")), lambda s: F.array_join(sentence_items(s), " ")), "\n")
    return documents.select("doc_id", F.coalesce(F.lower(F.trim("document_type")), F.lit("")).alias("kind"),
        F.coalesce(bag, F.lit("")).alias("bag"))


# --- documents as numbers ------------------------------------------------------------------------------------------
# Items of the vocabulary go by their number from here on, so that all passes over the corpus are array operations.

_numbered: dict[str, dict[str, int]] = {}

CODED = "doc_id long, items array<int>, sizes array<int>"


def _mark(kind: str) -> str:
    """The item that stands for a document's kind."""
    return "@" + kind.replace(" ", "_")


def encode_bags(bags: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, items, sizes: the numbers of the items of all sentences one after another, and how many each sentence
    has; items outside the vocabulary are left out, sentences are not."""
    sent = bags.sparkSession.sparkContext.broadcast(vocabulary)
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _numbered:
            _numbered.clear()
            _numbered[key] = {w: i for i, w in enumerate(sent.value)}
        number = _numbered[key]
        for b in batches:
            items, sizes, at, lines = [], [], [0], [0]
            for bag, kind in zip(b.column("bag").to_pylist(), b.column("kind").to_pylist()):
                if bag:
                    mark = number.get(_mark(kind)) if kind else None
                    for line in bag.split("\n"):
                        got = [i for w in line.split(" ") if (i := number.get(w)) is not None]
                        if mark is not None:
                            got.append(mark)
                        items += got
                        sizes.append(len(got))
                at.append(len(items))
                lines.append(len(sizes))
            pack = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pack(at, items), pack(lines, sizes)], ["doc_id", "items", "sizes"])

    return bags.select("doc_id", "kind", "bag").mapInArrow(run, CODED)


class Batch:
    """The arrays of one batch: items, the line of each item, the document of each line."""

    def __init__(self, b: pa.RecordBatch):
        items, sizes = b.column("items"), b.column("sizes")
        self.items = items.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.sizes = sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.per_doc = np.diff(sizes.offsets.to_numpy())
        self.docs, self.lines = b.num_rows, len(self.sizes)
        self.line = np.repeat(np.arange(self.lines), self.sizes)
        self.doc = np.repeat(np.arange(self.docs), self.per_doc)


def top_two(weights: np.ndarray, line: np.ndarray, lines: int) -> np.ndarray:
    """Per line and subject the sum of the two greatest weights (0 where there is none): words that always come
    together must not outvote a clear one. ``line`` is in order."""
    k = weights.shape[1]
    one, two = np.zeros((lines, k)), np.zeros((lines, k))
    count = np.bincount(line, minlength=lines)
    start = np.cumsum(count) - count
    rest = np.flatnonzero(count)
    j = 0
    while len(rest):
        w = weights[start[rest] + j]
        two[rest] = np.maximum(two[rest], np.minimum(one[rest], w))
        one[rest] = np.maximum(one[rest], w)
        j += 1
        rest = rest[count[rest] > j]
    return one + two


def clear_lines(e: np.ndarray, sure: float, lead: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per line the subject with most evidence, whether that is enough, and whether it also leads the next clearly."""
    at = e.argmax(axis=1)
    top = e[np.arange(len(e)), at]
    gap = top - np.partition(e, -2, axis=1)[:, -2] if e.shape[1] > 1 else top
    return at, top >= sure, (top >= sure) & (gap >= lead)


def settle(e: np.ndarray, doc: np.ndarray, docs: int, sure: float, lead: float) -> tuple[np.ndarray, np.ndarray]:
    """The subject of each line (k: none) and the main one of each document. A line counts only for a subject that holds
    a share of its document's clear lines, so that one stray word settles nothing."""
    k = e.shape[1]
    at, _, clear = clear_lines(e, sure, lead)
    votes = np.bincount(doc[clear] * k + at[clear], minlength=docs * k).reshape(docs, k)
    n = votes.sum(axis=1)
    main = np.where((n > 0) & (votes.max(axis=1) >= 0.6 * n), votes.argmax(axis=1), k)
    return np.where(clear & (votes[doc, at] >= 0.15 * n[doc]), at, k), main


def labelled(labels: DataFrame, limit: int, seed: int = 7) -> DataFrame:
    """doc_id, subjects of at most ``limit`` labelled documents: the training sample, chosen by hash. Null subjects
    make an empty list."""
    per = labels.where("doc_id is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set("subject_id")).alias("subjects"))
    return per.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(limit)


def item_weights(n_tc: np.ndarray, n_t: np.ndarray, prior: np.ndarray, strength: float, least: float) -> np.ndarray:
    """Per item the log of how much more often each subject comes with it than in general: the lower end of the
    estimate, so that rare items and words of every subject count little (0)."""
    p = (n_tc + strength * prior) / (n_t + strength)[:, None]
    p = np.maximum(p - np.sqrt(p * (1 - p) / (n_t + strength)[:, None]), 1e-6)
    w = _lift(p, prior)
    keep = (n_t >= least) & (w.max(axis=1) > 0.5)
    return np.where(keep[:, None], np.maximum(w, 0.0), 0.0)


def _summed(rows: DataFrame, size: int, k: int) -> np.ndarray:
    """The matrix (item, subject) that ``item, c, n`` rows add up to. Its size is that of the vocabulary."""
    got = rows.groupBy("item", "c").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((size, k + 1))
    out[got["item"].to_numpy(), got["c"].to_numpy()] = got["n"].to_numpy()
    return out


def _counts(total: np.ndarray, k: int) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(at // (k + 1), pa.int64()), pa.array(at % (k + 1), pa.int32()),
        pa.array(total[at], pa.float64())], ["item", "c", "n"])


COUNTS = "item long, c int, n double"


def _lines_evidence(w: np.ndarray, told: np.ndarray, b: Batch) -> np.ndarray:
    """``top_two`` over the items that tell something."""
    have = told[b.items]
    return top_two(w[b.items[have]], b.line[have], b.lines)


def recount(coded: DataFrame, weights: np.ndarray, sure: float, lead: float, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often each item comes with each subject and at all, over all documents, and the subjects' shares; summed per
    task before anything is shuffled. ``whole`` counts a document's items for its main subject, which words of every
    subject share alike; else each sentence for its own."""
    size, k = weights.shape
    wb = coded.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = wb.value
        told = w.max(axis=1) > 0
        # the last row counts documents or lines
        total = np.zeros((size + 1) * (k + 1))
        for raw in batches:
            b = Batch(raw)
            each, main = settle(_lines_evidence(w, told, b), b.doc, b.docs, sure, lead)
            if whole:
                at = np.unique(b.doc[b.line] * size + b.items)
                code, units = at % size * (k + 1) + main[at // size], main[b.per_doc > 0]
            else:
                code, units = b.items * (k + 1) + each[b.line], each
            total += np.bincount(np.concatenate([code, size * (k + 1) + units]), minlength=len(total))
        yield _counts(total, k)

    got = _summed(coded.mapInArrow(run, COUNTS), size + 1, k)
    wb.unpersist()
    every = got[size, :k] + 1
    return got[:size, :k], got[:size].sum(axis=1), every / every.sum()


def label_counts(taught: DataFrame, size: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for labelled documents (items, sizes, told), each item once a document and a document shared by its
    subjects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1) * (k + 1))
        for raw in batches:
            b = Batch(raw)
            told = raw.column("told").to_pylist()
            of = b.doc[b.line]
            for d in range(b.docs):
                items = np.unique(b.items[np.searchsorted(of, d) : np.searchsorted(of, d, "right")])
                total[items * (k + 1) + k] += 1
                for c in told[d]:
                    total[items * (k + 1) + c] += 1 / len(told[d])
                    total[size * (k + 1) + c] += 1 / len(told[d])
        yield _counts(total, k)

    got = _summed(taught.mapInArrow(run, COUNTS), size + 1, k)
    return got[:size, :k], got[:size, k], got[size, :k] + 1


def pairs_of(items: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(smaller item, greater item, line) of each pair of items of a line; items are different within one."""
    order = np.lexsort((items, line))
    items, line = items[order], line[order]
    _, start, count = np.unique(line, return_index=True, return_counts=True)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
    for m in np.unique(count[count > 1]):
        first = start[count == m]
        block = items[first[:, None] + np.arange(m)]
        for i in range(m - 1):
            rest = block[:, i + 1 :]
            out.append((np.repeat(block[:, i], m - 1 - i), rest.ravel(), np.repeat(line[first], m - 1 - i)))
    return tuple(np.concatenate(x) for x in zip(*out))


def mine_rules(coded: DataFrame, weights: np.ndarray, sure: float, lead: float, n_t: np.ndarray | None = None, least_count: int = 5,
    least_share: float = 2e-5) -> DataFrame:
    """x, y (-1: none), subject, support, confidence: class-association rules with antecedents of one or two items.

    A transaction is the informative items of a sentence with the subject it is surely about, if any. Every item and
    every pair of items of every transaction is counted, summed per batch before the shuffle: with antecedents of at
    most two items these are all frequent sets. Items rarer than ``least_count`` (``n_t``, where given) have no frequent
    set. A rule is redundant if a part of its antecedent gives the subject with about the same confidence."""
    size, k = weights.shape
    told = weights.max(axis=1) >= 1.0
    if n_t is not None:
        told &= n_t >= least_count
    wb = coded.sparkSession.sparkContext.broadcast((weights, told))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, keep = wb.value
        some = w.max(axis=1) > 0
        for raw in batches:
            b = Batch(raw)
            each, _ = settle(_lines_evidence(w, some, b), b.doc, b.docs, sure, lead)
            have = keep[b.items]
            items, line = b.items[have], b.line[have]
            x, y, at = pairs_of(items, line)
            lines = np.unique(line)
            none = np.full(len(items), -1)
            # the transactions themselves are counted as the set of nothing
            x = np.concatenate([x, items, np.full(len(lines), -1)])
            y = np.concatenate([y, none, np.full(len(lines), -1)])
            c = np.concatenate([each[at], each[line], np.full(len(lines), k)])
            code, n = np.unique(((x + 1) * (size + 1) + y + 1) * (k + 1) + c, return_counts=True)
            c, code = code % (k + 1), code // (k + 1)
            yield pa.RecordBatch.from_arrays([pa.array(code // (size + 1) - 1, pa.int32()), pa.array(code % (size + 1) - 1, pa.int32()),
                pa.array(c, pa.int32()), pa.array(n, pa.int64())], ["x", "y", "c", "freq"])

    per = coded.mapInArrow(run, "x int, y int, c int, freq long").groupBy("x", "y", "c").agg(F.sum("freq").alias("freq"))
    # few sets come with more than one subject often enough, so a set's list has at most k entries
    per = per.groupBy("x", "y").agg(F.sum("freq").alias("n"),
        F.collect_list(F.when((F.col("c") < k) & (F.col("freq") >= least_count), F.struct("c", "freq"))).alias("s"))
    sets = materialize(per.where("size(s) > 0 or x < 0"), "itemsets")
    n = sets.where("x < 0").select("n").first()
    # the lowest support still frequent: an absolute least count, then a share, which bounds the number of rules
    least = max(least_count, least_share * (n[0] if n else 0))
    rules = sets.select("x", "y", "n", F.explode("s").alias("s")).where(F.col("s.freq") >= least).select("x", "y",
        F.col("s.c").alias("subject"), F.col("s.freq").alias("support"), "n")
    rules = rules.withColumn("confidence", (F.col("support") + 0.1) / (F.col("n") + 0.1 * (k + 1))).select("x", "y", "subject", "support",
        "confidence")
    single = rules.where("y < 0")
    part = single.select(F.col("x").alias("p"), "subject", F.col("confidence").alias("pc"))
    double = rules.where("y >= 0").join(part.withColumnRenamed("p", "x").withColumnRenamed("pc", "cx"), ["x", "subject"],
        "left").join(part.withColumnRenamed("p", "y").withColumnRenamed("pc", "cy"), ["y", "subject"], "left")
    useful = double.where(F.col("confidence") > F.greatest(F.coalesce("cx", F.lit(0.0)), F.coalesce("cy", F.lit(0.0))) + 0.05)
    kept = single.where("confidence >= 0.05").unionByName(useful.where("confidence >= 0.5").select(*single.columns))
    out = materialize(kept, "rules")
    wb.unpersist()
    discard(sets)
    return out


class RuleBook:
    """Evidence of matching rules for the subjects of a sentence: per subject the two strongest."""

    def __init__(self, rules: pa.Table, size: int, prior: np.ndarray):
        k = len(prior)
        x, y, c = (rules[n].to_numpy().astype(np.int64) for n in ("x", "y", "subject"))
        w = np.maximum(0.0, _lift(rules["confidence"].to_numpy(), prior[c]))
        one = y < 0
        self.size, self.k = size, k
        self.single = np.zeros((size, k))
        self.single[x[one], c[one]] = w[one]
        self.codes, at = np.unique(x[~one] * size + y[~one], return_inverse=True)
        self.double = np.zeros((len(self.codes) + 1, k))
        self.double[at, c[~one]] = w[~one]
        self.paired = np.zeros(size, bool)
        self.paired[x[~one]] = self.paired[y[~one]] = True

    def evidence(self, b: Batch) -> np.ndarray:
        have = self.single[b.items].max(axis=1) > 0
        weights, line = self.single[b.items[have]], b.line[have]
        two = self.paired[b.items]
        x, y, at = pairs_of(b.items[two], b.line[two])
        code = x * self.size + y
        pos = np.searchsorted(self.codes, code)
        hit = np.flatnonzero(pos < len(self.codes))
        hit = hit[self.codes[pos[hit]] == code[hit]]
        weights, line = np.concatenate([weights, self.double[pos[hit]]]), np.concatenate([line, at[hit]])
        order = np.argsort(line, kind="stable")
        return top_two(weights[order], line[order], b.lines)

    def shares(self, b: Batch, e: np.ndarray, sure: float, lead: float = 0.7) -> np.ndarray:
        """Per document the share of its sentences that are about each subject; one that fits two goes with the clear
        ones around it."""
        at, enough, clear = clear_lines(e, sure, lead)
        around = np.bincount(b.doc[clear] * self.k + at[clear], minlength=b.docs * self.k).reshape(b.docs, self.k)
        best = (e + (around / np.maximum(1, around.sum(axis=1))[:, None])[b.doc]).argmax(axis=1)
        about = np.bincount(b.doc[enough] * self.k + best[enough], minlength=b.docs * self.k).reshape(b.docs, self.k)
        return about / np.maximum(1, b.per_doc)[:, None]


SURE, CUTS = (0.75, 1.0, 1.5, 2.0, 2.5, 3.0), (0.12, 0.14, 0.16, 0.18, 0.2, 0.22)


def calibrate(book: Broadcast, taught: DataFrame, shares_at: float = 0.2) -> tuple[float, float]:
    """The evidence a sentence needs and the share of sentences a subject needs, as fit the labelled sample best; what
    lies nearest to the stated share wins ties. Only sums come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b_ = book.value
        for raw in batches:
            b = Batch(raw)
            truth = np.zeros((b.docs, b_.k), bool)
            for d, told in enumerate(raw.column("told").to_pylist()):
                truth[d, told] = True
            e = b_.evidence(b)
            out = []
            for sure in SURE:
                share = b_.shares(b, e, sure)
                out += [(sure, cut, int((mine & truth).sum()), int(mine.sum()),
                    int(truth.sum())) for cut in CUTS for mine in [share >= cut - 1e-9]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["sure", "cut", "hit", "got", "want"])

    got = taught.mapInArrow(run, "sure double, cut double, hit long, got long, want long").groupBy("sure",
        "cut").agg(*[F.sum(c).alias(c) for c in ("hit", "got", "want")]).collect()
    best = (-1.0, 0.0, 1.5, shares_at)
    for r in got:
        near = -abs(r.cut - shares_at) - 0.01 * abs(r.sure - 1.5)
        best = max(best, (round(2 * r.hit / max(1, r.got + r.want), 3), near, r.sure, r.cut))
    return best[2], best[3]


def assign_subjects(documents: DataFrame, subjects: DataFrame, labels: DataFrame, label_limit: int = 20_000, passes: int = 3,
    least_items: int = 3, item_share: float = 5e-6) -> DataFrame:
    """doc_id, subject_id, share: the subjects that at least about a fifth of a document's sentences or lines are about.

    Items of labelled documents (at most ``label_limit``, the bounded training sample) and the words of the subject
    list give first evidence; passes over the sentences of all documents refine it; class-association rules are mined
    from them by counting all sentences and pruned; every sentence of every document is scored by its matching rules,
    calibrated on the labelled sample. Items count from ``item_share`` of all sentences, which bounds the vocabulary
    and with it all that is sent to the executors: one number per item and subject.
    Documents of any status, null or empty text (no rows), repeated rows (each comes out) and wrong labels are fine;
    without labels the subject list alone gives the evidence; without subjects the result is empty."""
    spark = documents.sparkSession
    listed = sorted((r.subject_id, f"{r.subject_name or ''} {r.description or ''}") for r in subjects.where(
        "subject_id is not null").collect())
    out = "doc_id long, subject_id int, share double"
    if not listed:
        return spark.createDataFrame([], out)
    ids = [i for i, _ in listed]
    at = {s: i for i, s in enumerate(ids)}
    k = len(ids)
    bags = materialize(document_bags(documents), "bags")
    n_lines = bags.select(F.sum(F.size(F.split("bag", "\n")))).first()[0] or 0
    least = max(least_items, int(item_share * n_lines))
    counted = bags.select(F.explode(F.split("bag", "[ \n]")).alias("item")).where("item <> ''").groupBy("item").count().where(
        F.col("count") >= least).select("item")
    marks = bags.where("kind <> ''").select(F.concat(F.lit("@"), F.replace("kind", F.lit(" "), F.lit("_"))).alias("item")).groupBy(
        "item").count().where(F.col("count") >= least).select("item")
    vocabulary = sorted({w for w in counted.unionByName(marks).toArrow()["item"].to_pylist()})
    number = {w: i for i, w in enumerate(vocabulary)}
    size = len(vocabulary)
    coded = materialize(encode_bags(bags, vocabulary), "coded")
    discard(bags)

    # the labelled sample has a bounded number of rows, and only their numbers are sent
    taught = labelled(labels, label_limit).select("doc_id",
        F.array_compact(F.transform("subjects", lambda s: F.create_map(*[F.lit(x) for kv in at.items() for x in kv])[s])).alias("told"))
    taught = materialize(coded.join(F.broadcast(taught), "doc_id").select("items", "sizes", "told"), "taught")
    n_tc, n_t, every = label_counts(taught, size, k)
    words = spark.createDataFrame(listed, "i int, d string").select("i", sentence_items(F.col("d")).alias("w")).collect()
    for r in words:
        for t in r.w:
            if t in number:
                n_t[number[t]] += 2
                n_tc[number[t], at[r.i]] += 2
    weights = item_weights(n_tc, n_t, every / every.sum(), 2.0, 2)
    sure, lead = 1.5, 0.7
    for whole in (True,) * (passes - 1) + (False,):
        n_tc, n_t, prior = recount(coded, weights, sure, lead, whole)
        weights = item_weights(n_tc, n_t, prior, 3.0, least)
    rules = mine_rules(coded, weights, sure, lead, n_t)
    shared = spark.sparkContext.broadcast(RuleBook(rules.toArrow(), size, prior))
    need, cut = calibrate(shared, taught)
    discard(rules, taught)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b_ = shared.value
        for raw in batches:
            b = Batch(raw)
            share = b_.shares(b, b_.evidence(b), need)
            doc, c = np.nonzero((share >= cut - 1e-9) & (b.per_doc > 0)[:, None])
            yield pa.RecordBatch.from_arrays([raw.column("doc_id").take(pa.array(doc)), pa.array(np.array(ids, np.int32)[c]),
                pa.array(share[doc, c])], ["doc_id", "subject_id", "share"])

    return coded.mapInArrow(score, out)
