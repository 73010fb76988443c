import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import merkle, spelling, toxicity
from tickloom.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = {"size": "x", "n": "y", "tree": 1, "place": 2, "leaf": "z", "word": "w", "other": "o", "score": 0.5, "held_out": True}


def docs(spark, rows, clash=True):
    d = spark.createDataFrame(rows, DOCS)
    return d.withColumns({k: F.lit(v) for k, v in CLASH.items()}) if clash else d


# --- spelling variants


def _one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _plain_spelling(rows, least=5, ratio=5):
    import re

    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= least}
    near = {w: [x for x in n if _one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def test_spelling_is_that_of_all_pairs(spark):
    r = random.Random(4)
    letters = "abcéÿ"
    stems = ["".join(r.choice(letters) for _ in range(r.randint(6, 9))) for _ in range(25)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababab", "abababab"]
    words = []
    for s in stems:
        words += [s] * r.choice([5, 30, 200])
        for _ in range(4):
            k, how = r.randrange(len(s)), r.random()
            v = s[:k] + s[k + 1 :] if how < 0.3 else s[:k] + r.choice(letters) + s[k:] if how < 0.6 else s[:k] + r.choice(letters) + s[k + 1 :]
            words += [v] * r.choice([5, 6, 40])
    words += ["chainaa"] * 5 + ["chainab"] * 30 + ["chaincb"] * 200  # each a form of the next
    words = [w.upper() if r.random() < 0.2 and w.isascii() else w for w in words]
    r.shuffle(words)
    rows = [(i, " ".join(words[k : k + 50]), "en", "s", 0) for i, k in enumerate(range(0, len(words), 50))]
    rows += [(None, " ".join(stems * 3), "en", None, None), (7, None, None, "s", 1), (8, "", None, "s", 1), (9, "x" * 4_000 + "," + "x" * 3_999 + " " + "y" * 100_000, "en", "s", 1)] * 5
    got = sorted(tuple(x) for x in spelling.spelling_groups(docs(spark, rows)).collect())
    want = _plain_spelling(rows)
    assert [x[:1] + x[3:5] for x in got] == [x[:1] + x[3:5] for x in want]
    assert got == want
    assert sum(x[1] is not None for x in got) > 20 and any(x[1] and x[2] != x[1] for x in got) and "y" * 100_000 in {x[0] for x in got}


def test_cells_lose_no_pair():
    r = random.Random(6)
    for trial in range(400):
        letters = "ab" if trial % 2 else "abcd"
        words = {"".join(r.choice(letters) for _ in range(r.randint(6, 9))) for _ in range(14)}
        for w in list(words):
            k = r.randrange(len(w))
            words |= {w[:k] + r.choice(letters) + w[k:], w[:k] + r.choice(letters) + w[k + 1 :]} | ({w[:k] + w[k + 1 :]} if len(w) > 6 else set())
        counts = Counter(w[k : k + 2] for w in words for k in range(len(w) - 1))
        own = {w: spelling.cells(w, spelling.rarest(w, counts), False) for w in words}
        longer = {w: spelling.cells(w, spelling.rarest(w, counts), True) for w in words}
        for a in words:
            for b in words:
                assert spelling.one_edit(a, b) == _one_edit(a, b)
                if _one_edit(a, b) and len(a) <= len(b):
                    assert own[a] & (own[b] if len(a) == len(b) else longer[b]), (a, b)


def test_spelling_of_nothing(spark):
    assert spelling.spelling_groups(docs(spark, [])).collect() == []
    assert spelling.spelling_groups(docs(spark, [(1, None, None, None, None), (2, "", None, None, None)])).collect() == []


def test_hot_cells_lose_no_pair(spark):
    r = random.Random(8)
    words = {"qqqqqq" + "".join(r.choice("mnop") for _ in range(3)) for _ in range(64)}
    rows = [(w, 5) for w in words]
    got = spelling.near_words(Scratch(spark), spark.createDataFrame(rows, "word string, n long"))
    want = {(a, b) for a in words for b in words if _one_edit(a, b)}
    assert {(x.word, x.other) for x in got.collect()} == want and got.count() == len(want)


def test_held_words_are_passed_on(spark):
    d = docs(spark, [(i, "lorem ipsumx dolores " * 3 + f"unique{'abcdefgh'[i % 8]}", "en", "s", 0) for i in range(40)])
    a, b = (sorted(spelling.word_counts(d, held=h).collect()) for h in (1, 1 << 17))
    assert a == b and len(a) > 5


# --- toxicity


def test_toxic_words_are_found_and_groups_are_not(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))
    rows, labels = [], []
    for i in range(1200):
        words, bad = [word() for _ in range(30)], i % 6 == 0
        if bad:
            words[3] = r.choice(["vilest", "vilely", "wretch"])
        # In these labels one group is mostly named where a text is toxic.
        if bad and r.random() < 0.8 or not bad and r.random() < 0.05:
            words[7] = "muslims"
        rows.append((i, " ".join(words) + ".", "en", "s", 0))
        labels.append((i, 1, int(bad)))
    d, lab = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(d, lab)
    plain = toxicity.fit_toxicity(d, lab, terms=())
    out = {x.doc_id: x for x in toxicity.score_toxicity(d, model).collect()}
    held = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(out[i].held_out == (i in set(held)) for i in range(1200))
    truth = dict((i, t) for i, _, t in labels)
    assert sum(out[i].predicted == truth[i] for i in held) / len(held) > 0.97
    said = "we met some {} at the market today."
    change = lambda m: abs(m.scorer()(said.format("muslims")) - m.scorer()(said.format("believers")))
    assert change(model) < 0.02
    gap = abs(model.weight.get(toxicity._hashed("muslims", 24), 0.0) - model.weight.get(toxicity._hashed("christians", 24), 0.0))
    assert gap < abs(plain.weight.get(toxicity._hashed("muslims", 24), 0.0)) or gap < 0.05


def test_penalty_makes_swapped_words_equal():
    r = np.random.default_rng(2)
    labels = (r.random(600) < 0.3).astype("int64")
    # 1 marks toxic texts, 2 goes with them in most of these rows, 3 stands for the group that 2 is swapped with.
    rows = [np.array(sorted({10 + int(r.integers(5)), *([1] if y and r.random() < 0.6 else []), *([2] if r.random() < (0.7 if y else 0.2) else [3] if r.random() < 0.3 else [])}), "int32") for y in labels]
    changes = [(np.array([2], "int32"), np.array([3], "int32"))] * 40
    free = toxicity.fit_toxic(labels, rows, changes, bits=24, fair=0.0, min_docs=5)
    fair = toxicity.fit_toxic(labels, rows, changes, bits=24, fair=20.0, min_docs=5)
    gap = lambda m: abs(m.weight.get(2, 0.0) - m.weight.get(3, 0.0))
    assert gap(free) > 0.5 and gap(fair) < 0.2 * gap(free) and fair.weight[1] > 1


def test_toxicity_of_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n", "en", "s", 0), (4, "some words " * 40_000, "en", "s", 0), (5, "same", "en", "s", 0), (5, "same", "en", "s", 0), (None, "same", "en", "s", 0)]
    d = docs(spark, rows)
    lab = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    for labels in (lab, lab.where("false"), lab.where("toxic = 0")):
        out = toxicity.score_toxicity(d, toxicity.fit_toxicity(d, labels)).collect()
        assert len(out) == 7 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in out)
        assert len({x.score for x in out if x.doc_id in (1, 2, 3)}) == 1 and len({x.score for x in out if x.doc_id in (5, None)}) == 1
        assert {x.held_out for x in out if x.doc_id == 5} == {zlib.crc32(b"5") % 4 == 2}
    assert toxicity.score_toxicity(d.where("false"), toxicity.fit_toxicity(d.where("false"), lab)).collect() == []


# --- Merkle manifest


def _h(*parts):
    return hashlib.sha256("".join(parts).encode("utf-8")).hexdigest()


def _leaf(row, text=False):
    values = [row[0], row[3], row[2], row[4], row[1] if text is False else text]
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([_h(*low[k : k + 3]) for k in range(0, len(low), 3)])
    return levels


def _plain_manifest(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r))) for s in sources}
    low = {s: _tree([_leaf(r) for r in trees[s]]) for s in sources}
    high = _tree([low[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(trees[s]):
            cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = _leaf(r, None if r[1] is None else r[1].replace("\n", "")) if cut else _leaf(r)
            proof = []
            for levels, at in ((low[s], i), (high, k)):
                for level in levels[:-1]:
                    first = at // 3 * 3
                    run = level[first : first + 3]
                    proof += run[: at - first] + run[at - first + 1 :]
                    node = _h(*run[: at - first], node, *run[at - first + 1 :])
                    at //= 3
            out.append((r[0], _leaf(r), low[s][-1][0], high[-1][0], _h(*proof), node, node == high[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [[1], [2], [243, 1], [244, 3, 4], [800, 10, 9, 28, 1, 1, 1, 1, 1, 1, 1]])
def test_manifest_is_that_of_a_loop(spark, sizes):
    rows = [(k * 1000 + i, f"line {i}\nmore\n" if i % 3 else f"line {i}", "en", None if k == 1 else f"s{k}é", i) for k, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(rows)
    got = sorted((tuple(x) for x in merkle.manifest(docs(spark, rows), parts=3).collect()), key=str)
    assert got == _plain_manifest(rows)
    changed = {r[0] for r in rows if "\n" in r[1] and zlib.crc32(str(r[0]).encode()) % 2 == 0}
    assert {x[0] for x in got if not x[6]} == changed


def test_manifest_of_several_supersteps(spark):
    rows = [(i, f"{i}\n", "en", "a" if i < 2 * 3**merkle.LEVELS + 5 else "b", i) for i in range(2 * 3**merkle.LEVELS + 3000)]
    assert merkle.height(2 * 3**merkle.LEVELS + 5) > merkle.LEVELS
    assert sorted((tuple(x) for x in merkle.manifest(docs(spark, rows), parts=3).collect()), key=str) == _plain_manifest(rows)


def test_supersteps_have_few_tasks(spark):
    """As many as their vertices need, also where a session has many shuffle partitions."""
    leaves = spark.sparkContext.parallelize([((0, i), (7, bytes([i]) * 32)) for i in range(7)], 2)
    ran = []

    def store(rdd, name):
        ran.append(rdd.getNumPartitions())
        return rdd

    vertices = merkle.climb(leaves, merkle.LEVELS + 1, 211, store)
    assert len(vertices) == 2 and ran == [211, 1]
    made = merkle.manifest(docs(spark, [(i, f"{i}\n", "en", "a", i) for i in range(300)]), parts=211)
    assert made.rdd.getNumPartitions() == 1 and made.count() == 300


def test_manifest_of_odd_rows(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "no id\n", "en", "a", 3), (2, "", "en", "a", 0), (3, "x\n" * 100_000, "fr", "a", 5), (4, "-", "-", "-", 1), (5, "a\nb", "en", "", 3)]
    got = sorted((tuple(x) for x in merkle.manifest(docs(spark, rows)).collect()), key=str)
    assert got == _plain_manifest(rows)
    assert merkle.manifest(docs(spark, [])).collect() == []


def test_an_incomplete_vertex_is_an_error(spark):
    sc = spark.sparkContext
    leaves = sc.parallelize([((0, i), (7, bytes([i]) * 32)) for i in range(6)], 2)  # of seven
    with pytest.raises(Exception, match="has heard from 6 children"):
        merkle.climb(leaves, merkle.height(7), 2, lambda rdd, name: rdd)[0].collect()


# --- cases that earlier rounds got wrong


def test_token_ids_stay_whole_beside_null_ids(spark):
    from tickloom.llm import queries, token_counts

    d = docs(spark, [(2**60 + 1, "a b c", "en", "s", 0), (None, "a b c", "en", "s", 0), (2**60 + 3, "word " * 9000, "en", "s", 0), (5, None, "en", "s", 0)]).coalesce(1)
    got = {x.doc_id: x for x in token_counts.count_tokens_of(d, queries.tokenizer_path()).collect()}
    assert set(got) == {2**60 + 1, None, 2**60 + 3, 5}
    assert got[None].n_tokens == got[2**60 + 1].n_tokens > 0 and got[5].n_tokens == 0 and got[2**60 + 3].over_limit
    named = d.withColumn("doc_id", F.concat(F.lit("id"), F.col("doc_id").cast("string")))
    assert {x.doc_id for x in token_counts.count_tokens_of(named, queries.tokenizer_path()).collect()} == {f"id{2**60 + 1}", None, f"id{2**60 + 3}", "id5"}


def test_stable_positions_by_a_loop():
    from tickloom.llm import token_counts

    r = random.Random(3)
    for _ in range(50):
        text = "".join(r.choice("ab \n　.") for _ in range(r.randint(0, 60)))
        space = lambda x: x in token_counts._SPACE
        for first, stop in ((0, len(text)), (5, 20), (7, 8), (0, 0)):
            assert token_counts.stable(text, first, stop) == [k for k in range(max(first, 1), min(stop, len(text))) if space(text[k]) and not space(text[k - 1])]


def test_overlaps_are_measured_whole(spark):
    from tickloom.llm import spaced_seeds

    item = [f"w{i}" for i in range(1000)]
    middle = item[:375] + [f"x{i}" for i in range(250)] + item[625:]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    before = [f"a{i}" for i in range(200)]
    d = docs(spark, [(1, " ".join(middle), "en", "s", 0), (2, " ".join(before + middle + before), "en", "s", 0), (3, " ".join(before), "en", "s", 0), (4, " ".join(before + item[100:160]), "en", "s", 0)])
    got = {(x.doc_id, x.n_words, x.n_equal) for x in spaced_seeds.find_leaks(d, bench).collect()}
    assert got == {(1, 1000, 750), (2, 1000, 750), (4, 60, 60)}


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html><head><title>x</title><body><article><p>Hello</p></article>", "Hello"), ("<html><head><meta charset=utf-8><p>One", "One"), ("<p title=don't>one</p><p title=\"a>b\">two</p>", "one\ntwo"),
        ("<article><p>E is <math><mi>m</mi></math> here</p></article>", "E is m here"), ("<article><p class=ad>Buy<p>Text</article>", "Text"), ("<ul><li class='share'>a<li>b</ul>c", "b\nc"),
        ("<h1 class='page-header'>Title</h1><p>Text", "Title\nText"), ("<table><tr><td class=ad>q<td>r<tr><td>s</table>", "r\ns"),
    ],
)
def test_pages_of_odd_markup(spark, page, text):
    from tickloom.llm import page_diff

    got = page_diff.extract_pages(spark.createDataFrame([(1, "http://a/b", page)], "page_id long, url string, html string")).collect()
    assert [(x.text, x.n_chars) for x in got] == [(text, len(text))]
