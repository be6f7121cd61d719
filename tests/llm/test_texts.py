import random
from collections import Counter, defaultdict

import numpy as np
from kgloom.llm import markup, mixing, packing, subjects, tokens

DOC = "doc_id long, text string, source string, document_type string, kind string, part int"


def kinds(text):
    found, elements, clean = markup.parse(text)
    return found, Counter(k for k, _ in elements), clean


def test_markup_kinds():
    assert kinds("Q&A: a < b and c > d, C#, {rough}, $5, 3*4*5, x_y_z [293]")[:2] == (False, Counter())
    assert kinds(None) == (False, Counter(), "") and kinds("") == (False, Counter(), "")
    f, k, clean = kinds("<html><head><title>x</title><script>var a='<li>';</script></head><h1 id=s>H</h1><ul><li>a<li>b <b>c</b></ul><pre><code># no\n- no</code></pre>\\(x^2\\) &amp; <!-- <h2>no</h2> -->")
    assert f and k == Counter(heading=1, list_item=2, code=1, formula=1) and "# no" in clean and "<" not in clean
    f, k, clean = kinds("---\ntags: [x]\n---\n\nTitle\n=====\n\n# One\n\n1. a\n2. b **c**\n\n~~~py\n# no\n~~~\n\n$$\na^2\n$$ and $b_1$ `# no` [t](http://u)")
    assert k == Counter(heading=2, list_item=2, code=1, formula=2) and "tags" not in clean and "[t]" not in clean and "# One" in clean
    f, k, clean = kinds("{{Infobox\n| a = b\n}}\n== H ==\n# one\n# two\n* three '''x'''\n<math>x</math>{{quote|see}} [[Page 3|shown]] [[Category:Law]]\n<syntaxhighlight lang=text>\n* no\n</syntaxhighlight>")
    assert k == Counter(heading=1, list_item=3, formula=1, code=1) and "shown" in clean and "Infobox" not in clean and "see" in clean
    f, k, clean = kinds("\\documentclass{a}\n\\begin{document}\n\\section*{S \\emph{t}}\n\\begin{itemize}\n\\item a \\textbf{b}\n\\item c\n\\end{itemize}\n\\[ x \\]\n\\begin{equation}\ny\n\\end{equation}\n\\begin{verbatim}\n\\item no\n\\end{verbatim}\ntext % note\n\\end{document}")
    assert k == Counter(heading=1, list_item=2, formula=2, code=1) and "\\item no" in clean and "note" not in clean and "# S t" in clean
    for broken in ("it </p>took", "say &lt;b&gt;the&lt;/b&gt;", "x <img src='x.png' alt=''", "{{note|My}} own", "a ''b c"):
        f, k, clean = kinds(broken)
        assert f and not k and not any(c in clean for c in "<>{}")
    big = ("<pre> \\[ $$ `` {{ [[ " * 40_000)
    assert kinds(big)[0]


def test_markup_operator(spark):
    shell = "\\documentclass{article}\n\\begin{document}\n{}\n\\end{document}\nFiled by the desk\nOne of many"
    rows = [(i, shell.replace("{}", f"Body {i}\n\n\\section{{H{i}}}", 1).replace("{article}", "{article}"), "s") for i in range(8)] + [
        (90, None, "s"), (91, "", None), (92, "plain", "s"), (92, "plain", "s")]
    df = spark.createDataFrame(rows, "record_id long, content string, source string")
    out = {r.record_id: r for r in markup.clean_markup(df).collect()}
    assert out[3].clean == "Body 3\n\n# H3" and out[90].clean is None and out[91].clean == ""
    got = sorted(tuple(r) for r in markup.markup_rows(markup.clean_markup(df)).collect())
    assert got == sorted((i, k, p) for i in range(8) for k, p in (("residue", 0), ("heading", 1)))
    assert markup.clean_markup(df.limit(0)).count() == 0


def test_best_fit_is_tight_and_keeps_conflicts():
    random.seed(1)
    sizes = [random.randrange(1, 60) for _ in range(300)]
    copies = [1 << (i % 7) if i % 5 == 0 else 0 for i in range(300)]
    where = packing.best_fit(sizes, 100, copies, [0] * 300)
    bins = defaultdict(list)
    for i, b in enumerate(where):
        bins[b].append(i)
    assert all(sum(sizes[i] for i in v) <= 100 for v in bins.values())
    assert all(max(Counter(copies[i] for i in v if copies[i]).values(), default=1) == 1 for v in bins.values())
    assert len(bins) <= -(-sum(sizes) // 100) + 2
    apart = packing.best_fit([10, 10], 100, [0, 0], [(1 << 64) | 2, (2 << 64) | 1])
    assert apart[0] != apart[1]


def docs(spark, rows):
    return spark.createDataFrame([(*r, "note", "x", 1) for r in rows], DOC)


def test_packing(spark):
    rows = [(i, f"word {i} " * (i % 40 + 1), "s") for i in range(200)] + [(900, "long text " * 3000, "t"), (901, None, None),
        (902, "", "s"), (903, "same", "s"), (904, "same", "s"), (903, "same", "s")]
    box = spark.createDataFrame([("small", 64), ("big", 512), ("none", 0)], "container_kind string, capacity_tokens int")
    got = packing.pack(docs(spark, rows), box, shard_rows=60).collect()
    size = {i: len(tokens.encode(t)) for i, t, _ in rows}
    for kind, cap in (("small", 64), ("big", 512)):
        mine = [r for r in got if r.container_kind == kind]
        load, same, parts = Counter(), Counter(), defaultdict(list)
        for r in mine:
            load[r.container_id] += r.n_tokens
            parts[r.doc_id].append((r.token_start, r.n_tokens))
            if r.doc_id in (903, 904):
                same[r.container_id] += 1
        assert max(load.values()) <= cap and max(same.values()) == 1 and len(parts) == 205 and len(parts[903]) == 2
        assert all(sum(n for _, n in p) == size[d] * (2 if d == 903 else 1) for d, p in parts.items())
        assert all(len(p) == 1 for d, p in parts.items() if size[d] <= cap and d != 903)
    assert {r.container_kind for r in got} == {"small", "big"}
    assert packing.pack(docs(spark, []), box).count() == 0


def test_permutation():
    for n in (1, 2, 3, 100, 1000):
        assert sorted(mixing.permute(np.arange(n), n, 5).tolist()) == list(range(n))
    assert mixing.plan_size({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}) <= 40


def test_mix(spark):
    rows = [(i, f"some words here {i} " * 40, "Big") for i in range(120)] + [
        (500 + i, f"rare text {i} " * 40, " small ") for i in range(30)] + [(900, None, "big"), (901, "x", None), (902, "y", "other"),
            (903, "", "small")]
    src = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("zero", 0.0, 1)],
        "source string, target_share double, max_repeats int")
    d = docs(spark, rows)
    got = mixing.mix(d, src, length=32, shard_slots=16).collect()
    text = {i: tokens.encode(t) for i, t, _ in rows}
    used = Counter((r.source, r.block) for r in got)
    assert got and all(n <= {"big": 1, "small": 3}[s] for (s, _), n in used.items()) and len({(r.shard, r.slot) for r in got}) == len(got)
    for r in got[:200]:
        assert sum(len(p.tokens) for p in r.pieces) == r.n_tokens <= 32
        assert all(text[p.doc_id][p.token_start : p.token_start + len(p.tokens)] == p.tokens for p in r.pieces)
    share = {r.source: r.share for r in mixing.mix_shares(mixing.mix(d, src, length=32, shard_slots=16), src).collect()}
    assert abs(share["small"] - 0.4) < 0.12 and share["zero"] == 0
    assert mixing.mix(d.limit(0), src).count() == 0


def test_long_texts_encode_whole():
    t = "line one two\n" * 9000 + "tail  \n\n x"
    assert tokens.encode(t) == tokens.encoder(tokens.TOKENIZER).encode_ordinary(t)


def test_subjects(spark):
    random.seed(5)
    words = {1: "atom cell lens probe enzyme crystal".split(), 2: "court judge statute clause verdict jury".split(),
        3: "goal match coach league stadium referee".split()}
    frame = ["The {} came before the {}.", "Nobody expected the {} or the {}.", "A second {} joined this {}.",
        "Notes on the {} mention the {}."]
    rows, truth, labels = [], {}, []
    for i in range(360):
        s = i % 3 + 1
        other = s % 3 + 1
        text = " ".join(random.choice(frame).format(*random.sample(words[s], 2)) for _ in range(8))
        if i % 9 == 0:
            text += " " + " ".join(random.choice(frame).format(*random.sample(words[other], 2)) for _ in range(5))
        elif i % 4 == 0:
            text += f" It was a {words[other][0]} day."
        rows.append((i, text, "s"))
        truth[i] = {s, other} if i % 9 == 0 else {s}
        if i < 120:
            labels += [(i, x, "a") for x in truth[i]]
    rows += [(900, None, "s"), (901, "", "s"), (902, "Nothing to see here.", "s"), (903, "atom enzyme " * 20_000, "s")]
    listed = spark.createDataFrame([(1, "science", "atoms and cells"), (2, "law", "courts"), (3, "sport", None)],
        "subject_id int, subject_name string, description string")
    lab = spark.createDataFrame(labels + [(5, None, "b")], "doc_id long, subject_id int, labeler string")
    out = subjects.assign_subjects(docs(spark, rows), listed, lab)
    got = defaultdict(set)
    for r in out.collect():
        got[r.doc_id].add(r.subject_id)
    held = [i for i in truth if i >= 120]
    hit = sum(len(got[i] & truth[i]) for i in held)
    assert 2 * hit / sum(len(got[i]) + len(truth[i]) for i in held) > 0.95
    assert not got[900] and not got[901] and not got[902] and got[903] == {1}
    assert subjects.assign_subjects(docs(spark, rows), listed.limit(0), lab).count() == 0


def test_rules_count_every_sentence(spark):
    words = sorted(["solo", *(f"w{i:02}" for i in range(14))])
    at = {w: i for i, w in enumerate(words)}
    long = " ".join(w for w in words if w != "solo")

    def mined(text, weight):
        bags = spark.createDataFrame([(i, "", t) for i, t in enumerate(text)], "doc_id long, kind string, bag string")
        found = subjects.mine_rules(subjects.encode_bags(bags, words), np.tile(np.array(weight), (len(words), 1)), 1.5, 0.7).collect()
        return {(words[r.x], words[r.y] if r.y >= 0 else ""): (r.subject, r.support) for r in found}

    got = mined(["\n".join(["solo"] * 40), "\n".join([long] * 30), ""], [2.0, 0.0])
    # sentences of one item count each time they occur
    assert got["solo", ""] == (0, 40) and got["w13", ""] == (0, 30)
    # either item alone is of no subject, both together are, though they stand far apart
    got = mined(["\n".join(["w00"] * 60 + ["w13"] * 60 + [long] * 30)], [1.0, 0.1])
    assert got["w00", "w13"] == (0, 30)
    assert at["w00"] == 1


def test_array_passes_against_loops():
    r = np.random.default_rng(3)
    line = np.sort(r.integers(0, 40, 200))
    w = r.random((200, 4))
    got = subjects.top_two(w, line, 41)
    for i in range(41):
        want = np.sort(np.vstack([w[line == i], np.zeros((2, 4))]), axis=0)[-2:].sum(axis=0)
        assert np.allclose(got[i], want)
    items = np.array([5, 2, 9, 7, 1, 3, 3])
    x, y, at = subjects.pairs_of(items, np.array([0, 0, 0, 1, 3, 3, 4]))
    assert sorted(zip(x.tolist(), y.tolist(), at.tolist())) == [(1, 3, 3), (2, 5, 0), (2, 9, 0), (5, 9, 0)]
    # a subject with less than 0.15 of a document's clear lines settles none of them
    e = np.array([[3.0, 0], [3, 0], [3, 0], [3, 0], [3, 0], [3, 0], [0, 3.0], [1, 1]])
    each, main = subjects.settle(e, np.zeros(8, int), 1, 1.5, 0.7)
    assert each.tolist() == [0] * 6 + [2, 2] and main.tolist() == [0]


def test_template_keeps_body_text(spark):
    assert markup.parse("one\ntwo", frozenset(["one"])) == (False, [], "one\ntwo")
    body = [f"A sentence number {j} of the record" for j in range(9)]
    # near-copies, with markup and without, and a rare group of pages
    rows = [(i, "\n".join([*body, f"# Edited {i}"]), "a") for i in range(8)] + [
        (20 + i, "\n".join([*body, f"edited {i}"]), "b") for i in range(8)]
    rows += [(100 + i, f"# H{i}\nfirst {i}\nFoot one\nsecond {i}\nFoot two", "c") for i in range(6)] + [
        (200 + i, f"# other {i}", "c") for i in range(60)]
    out = {r.record_id: r for r in markup.clean_markup(spark.createDataFrame(rows,
        "record_id long, content string, source string")).collect()}
    assert all(s in out[3].clean for s in body) and out[3].marked
    assert out[23].clean == rows[11][1] and not out[23].marked
    assert "Foot one" in out[102].clean
    # what crosses a better class is none; what lies in one slot is
    assert markup.crossing([(-9, "a", 1), (-9, "a", 5), (-6, "b", 2), (-6, "b", 3), (-5, "c", 4), (-5, "c", 6)]) == ["c"]


def test_file_splits_change_nothing(spark, rows):
    random.seed(9)
    words = "alpha beta gamma delta epsilon zeta".split()
    texts = [(i, " ".join(random.choice(words) for _ in range(random.randrange(1, 60))), random.choice("ab")) for i in range(60)]
    texts += [texts[3]] * 5
    kinds = spark.createDataFrame([("k", 64)], "container_kind string, capacity_tokens int")
    given = spark.createDataFrame([("a", 0.6, 3), ("b", 0.4, 3), ("missing", 0.2, 2)],
        "source string, target_share double, max_repeats int")
    one, many = docs(spark, texts).coalesce(1), docs(spark, texts[::-1]).repartition(7)
    got = [rows(packing.pack(d, kinds).drop("container_id")) for d in (one, many)]
    assert got[0] == got[1] and len(got[0]) >= 65
    faults = packing.container_faults(packing.pack(many, kinds, [("a", "b")]).where("doc_id <> 3"), many, kinds, [("a", "b")]).first()
    assert tuple(faults)[2:] == (0, 0, 0, 0, 0)
    # a listed source without texts is left out and reported, the others go on
    mixed = mixing.mix(many, given, length=16)
    share = {r.source: r for r in mixing.mix_shares(mixed, given).collect()}
    assert mixed.count() > 0 and share["missing"].tokens == 0 and share["missing"].shortfall == 0.2 and abs(share["a"].share - 0.6) < 0.25
    blocks = [rows(mixing.mix(d, given, length=16).select("shard", "slot", "source", "block", "use")) for d in (one, many)]
    assert blocks[0] == blocks[1]
