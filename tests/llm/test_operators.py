import base64
import hashlib
import itertools
import math
import pathlib
import random
import textwrap

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import license_digest, line_spread, ngram_join, ordinal_quality, page_diff, pivot_topk, queries, source_mix, spaced_seeds, token_counts, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: A column whose name operators use themselves, or might.
CLASH = {"size": "x", "n": "y", "rank": "z", "key": "k", "digest": "q", "node": "w", "label": "v"}


def docs(spark, rows, clash=True):
    d = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)
    return d.withColumns({k: F.lit(v) for k, v in CLASH.items()}) if clash else d


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, a very long one, repeated rows, ties."""
    words = [f"w{i}" for i in range(40)]
    long = " ".join(random.Random(1).choice(words) + str(i) for i in range(30_000))
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n\t ", None), (4, long, "c"), (5, "one two three four five", "a"), (5, "one two three four five", "a"), (None, "no id here at all", "b"), (6, "one two three four five", "c"), (7, "héllo 　 wörld <|endoftext|> x", "a")]
    return docs(spark, rows)


@pytest.fixture(scope="module")
def nothing(spark):
    return docs(spark, [])


def test_sql_gives_the_same_rows(spark, sf, compare):
    for name, sql in queries.SQL.items():
        compare(queries.QUERIES[name](spark, sf), sql)


# --- quality


def test_quality_finds_bad_words_and_keeps_the_rest(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    rows, labels = [], []
    for i in range(1500):
        words, kind = [word() for _ in range(40)], i % 10
        if kind == 0:
            words[5] = words[20] = "vile"
        if kind == 1:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 0 if kind == 1 else 1, int(kind == 0)))
    d, lab = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = ordinal_quality.fit_quality(d, lab.where("doc_id < 1000"))
    assert model.cut == sorted(model.cut) and len(model.cut) == 2
    kept = {x.doc_id for x in ordinal_quality.rate_quality(d, model).where("keep and doc_id >= 1000").collect()}
    want = {i for i in range(1000, 1500) if i % 10 > 1}
    assert len(kept & want) >= 0.99 * len(want) and len(kept - want) <= 2
    assert ordinal_quality.keep_good(d, model).columns == d.columns


def test_quality_odd_rows(spark, odd, nothing):
    lab = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = ordinal_quality.fit_quality(odd, lab)
    got = ordinal_quality.rate_quality(odd, model).collect()
    assert len(got) == odd.count() and len({r.expected_grade for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert ordinal_quality.rate_quality(nothing, ordinal_quality.fit_quality(nothing, lab)).count() == 0


def test_quality_sample_is_bounded(spark):
    d = docs(spark, [(i % 30, f"word{i} again", "s") for i in range(300)])
    lab = spark.createDataFrame([(i % 40, 1, i % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    seen, fit = [], ordinal_quality.fit_ordinal
    try:
        ordinal_quality.fit_ordinal = lambda grades, rows, **k: seen.append(len(rows)) or fit(grades, rows, **k)
        for sample in (7, 1000):
            ordinal_quality.fit_quality(d, lab, sample=sample)
    finally:
        ordinal_quality.fit_ordinal = fit
    assert seen[0] <= 7 and seen[1] == 30


def brute_likelihood(grades, rows, cut, weight):
    """Mean log likelihood of a cumulative-link model, each grade weighing the same by row."""
    total = 0.0
    for g, ids in zip(grades, rows):
        score = sum(weight.get(int(i), 0.0) for i in ids)
        tail = [1.0, *(1 / (1 + math.exp(c - score)) for c in cut), 0.0]
        total += math.log(tail[g] - tail[g + 1])
    return total / len(grades)


def test_fitted_model_is_likelier_than_others_near_it():
    r = np.random.default_rng(3)
    rows = [np.unique(r.integers(0, 30, 8)) for _ in range(600)]
    score = np.array([sum((x % 5 - 2) * 0.8 for x in ids) for ids in rows]) + r.logistic(size=600)
    grades = np.digitize(score, [-1.0, 1.5])
    m = ordinal_quality.fit_ordinal(grades, rows, bits=5, noise=0.0, ridge=0.0, steps=2000, rate=0.1)
    best = brute_likelihood(grades, rows, m.cut, m.weight)
    for k in list(m.weight)[:10]:
        for by in (-0.2, 0.2):
            assert brute_likelihood(grades, rows, m.cut, m.weight | {k: m.weight[k] + by}) < best
    for k in range(2):
        for by in (-0.2, 0.2):
            assert brute_likelihood(grades, rows, [c + by * (i == k) for i, c in enumerate(m.cut)], m.weight) < best
    # Given the words, higher grades are told from lower ones on rows of the same kind.
    mean = [np.mean([sum(m.weight.get(int(i), 0) for i in ids) for ids, g in zip(rows, grades) if g == k]) for k in range(3)]
    assert mean == sorted(mean)


# --- WARC

INNER = "WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


@pytest.mark.parametrize("split", ["64m", "97b"])
def test_warc_round_trip_with_magic_inside(spark, split):
    rows = [(1, "http://a", f"x{INNER}y"), (2, "http://b", "WARC/1.0\r\n"), (3, None, None), (4, "http://c é", INNER * 3), (5, "u", "plain"), (6, "u", "plain"), (None, "n", "no id"), (7, "w", "WARC/1.0\r\nWARC/1.0\r\nContent-Length: 3"), (8, "q", "é" * 5000 + INNER), (8, "q", "é" * 5000 + INNER)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).coalesce(1)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = warc.round_trip(pages).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        r = next(x for x in got if x.page_id == i)
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    by = {x.page_id: x for x in got}
    assert by[5].record_type == "revisit" and by[5].refers_to == 6 and by[6].record_type == "response" and by[None].record_type == "response"


def test_warc_read_with_other_splits_the_second_time(spark, monkeypatch):
    rows = [(i, f"http://h/{i}", f"page {i} {INNER if i % 2 else ''} end" * 9) for i in range(40)] + [(41, "u", "long " * 100_000 + INNER)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    read, before, splits = warc._segments, spark.conf.get("spark.sql.files.maxPartitionBytes"), iter(["999b", "4000b", "211b"])

    def other(*args):
        spark.conf.set("spark.sql.files.maxPartitionBytes", next(splits))
        return read(*args)

    monkeypatch.setattr(warc, "_segments", other)
    try:
        got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {i: got[i].payload_digest for i in got} == {i: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() for i, _, h in rows}


def test_warc_headers(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a"), (1, "u", "a")], "page_id long, url string, html string").coalesce(1)
    warc.write_warc(pages, f"file://{tmp_path}/w")
    text = "".join(x.read_bytes().decode() for x in (tmp_path / "w").glob("part-*"))
    ids = [x for x in text.split("\r\n") if x.startswith("WARC-Record-ID: ")]
    assert len(set(ids)) == 2 and text.count("\r\nWARC-Date: 20") == 2 and text.count("\r\nContent-Length: 1\r\n\r\na\r\n\r\n") == 2


def test_warc_of_nothing(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- tokens


@pytest.mark.parametrize("limits", [{}, {"huge": 300, "chunk": 100, "overlap": 4}, {"huge": 50, "chunk": 20, "overlap": 1}])
def test_token_counts(spark, odd, limits):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    r = random.Random(5)
    texts = ["".join(r.choice(["a", "Bc", " ", "  ", "\n", "\t", "é", "\xa0", " ", "\x1c", "12", "...", "'s", "日本", "😀", "<|endoftext|>", "<|endof"]) for _ in range(r.randint(1, 400))) for _ in range(60)] + ["x" * 2000, " " * 700]
    d = docs(spark, [(100 + i, x, "s") for i, x in enumerate(texts)]).unionByName(odd if not limits else odd.where("doc_id is null or doc_id <> 4"))  # with the very long text
    got = token_counts.count_tokens_of(d, path, **limits).collect()
    want = {x.doc_id: x.text or "" for x in d.collect()}
    assert len(got) == d.count()
    for x in got:
        assert x.n_tokens == len(t.encode(want[x.doc_id], add_special_tokens=False).ids), want[x.doc_id]
        assert x.n_bytes == len(want[x.doc_id].encode()) and x.over_limit == (x.n_tokens > 1024)


def test_token_counts_of_long_texts_and_of_none(spark, nothing):
    from tokenizers import Tokenizer

    path, r = queries.tokenizer_path(), random.Random(7)
    t = Tokenizer.from_file(path)
    texts = {1: "x" * 60_000, 2: " " * 40_000, 3: ("ab " * 9000 + "y" * 9000) * 2, 4: "".join(r.choice("ab \n\u3000é") for _ in range(50_000)), 5: "日本" * 20_000 + " z"}
    got = {x.doc_id: x.n_tokens for x in token_counts.count_tokens_of(docs(spark, [(i, x, "s") for i, x in texts.items()]), path).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in texts.items()}
    assert token_counts.count_tokens_of(nothing, path).count() == 0


def test_token_counts_of_other_tokenizers(spark, odd):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts.count_tokens_of(odd, path).collect()
    texts = {x.doc_id: x.text or "" for x in odd.collect()}
    assert all(x.n_tokens == len(p.encode(texts[x.doc_id])) for x in got)


# --- lines


def test_shared_lines(spark, odd, nothing):
    shared, own = "a line that stands on many sites", "a line of one site, and one only"
    rows = [(i, f"{shared}\n{own} {i}\nshort\n{shared.upper()} ", f"s{i % 4}") for i in range(1, 9)] + [(20, own + "\n" + own, "s1"), (21, own, "s1"), (30, shared, None), (31, None, "s9")]
    got = {r.doc_id: r for r in line_spread.drop_shared_lines(docs(spark, rows)).collect()}
    assert got[1].n_removed == 0 and got[1].text.startswith(shared)
    assert all(got[i].text == f"{own} {i}\nshort" and got[i].n_removed == 2 for i in range(2, 9))
    assert got[20].n_removed == 0 and got[30].text == "" and got[31].text is None and got[31].n_lines == 0
    kept = line_spread.without_shared_lines(docs(spark, rows))
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {30} and kept.columns == docs(spark, []).columns
    assert line_spread.drop_shared_lines(odd).count() == odd.count() and line_spread.drop_shared_lines(nothing).count() == 0


def test_hot_lines_and_rows_without_ids(spark):
    line, r = "a very common line, on most documents", random.Random(5)
    rows = [(i if i % 5 else None, f"{line}\nown line of document {i}\n" + (f"line of four sites {i // 8}" if i % 2 else ""), f"s{r.randrange(9)}") for i in range(3000)]
    got = line_spread.drop_shared_lines(docs(spark, rows)).collect()
    sites = {}
    for i, t, s in rows:
        for x in t.split("\n"):
            sites.setdefault(x, set()).add(s)
    first = {}
    for i, t, _ in rows:
        for x in t.split("\n"):
            if i is not None:
                first[x] = min(first.get(x, i), i)
    want = sorted((str(i), "\n".join(x for x in t.split("\n") if len(x) < 20 or len(sites[x]) < 3 or first.get(x) == i and i is not None)) for i, t, _ in rows)
    assert sorted((str(x.doc_id), x.text) for x in got) == want


@pytest.mark.parametrize("sites", [11, 12, 13])
def test_near_the_threshold_counts_are_exact(spark, sites):
    rows = [(i, "the line that is looked at here", f"s{i}") for i in range(sites)]
    got = line_spread.drop_shared_lines(docs(spark, rows), min_sites=12, lg_k=4).agg(F.sum("n_removed")).first()[0]
    assert got == (sites - 1 if sites >= 12 else 0)


# --- mix


def test_mix(spark, odd, nothing):
    r = random.Random(9)
    rows = [(i, " ".join("w" for _ in range(r.randint(1, 60))), r.choice(["a"] * 6 + ["b", "c", None])) for i in range(3000)]
    got = source_mix.mix_sources(docs(spark, rows)).collect()
    assert sorted(got) == sorted(source_mix.mix_sources(docs(spark, rows).repartition(7)).collect())
    of = {i: s for i, _, s in rows}
    for s in {of[x.doc_id] for x in got}:
        mine = [x for x in got if of[x.doc_id] == s]
        assert abs(sum(x.taken for x in mine) - mine[0].target) <= 61 and mine[0].target <= 3 * mine[0].source_size and all(x.taken <= 3 * x.size and x.taken % x.size == 0 for x in mine)
    assert abs(sum({of[x.doc_id]: x.target for x in got}.values()) - sum(x.size for x in got)) < 1e-6
    assert source_mix.mix_sources(odd).count() == odd.count() and source_mix.mix_sources(nothing).count() == 0


def test_mix_takes_short_documents_more_often(spark):
    r = random.Random(12)
    sizes = {i: r.choice([3, 20, 150, 1200]) for i in range(4000)}
    d = docs(spark, [(i, " ".join(["w"] * n), "a" if i % 2 else "b") for i, n in sizes.items()])
    copies = {}
    for power in (0.0, 0.25, 1.0):
        got = source_mix.mix_sources(d, length_power=power).collect()
        for s in (0, 1):
            mine = [x for x in got if x.doc_id % 2 == s]
            assert abs(sum(x.taken for x in mine) - mine[0].target) <= 1200 and all(x.taken <= 3 * x.size for x in mine)
            for n in (3, 20, 150, 1200):
                part = [x.taken / n for x in mine if x.size == n]
                copies[power, s, n] = sum(part) / len(part)
    for s in (0, 1):
        means = [copies[0.25, s, n] for n in (3, 20, 150, 1200)]
        assert means == sorted(means, reverse=True) and means[0] > 1.1 * means[-1]
        # Copies of classes that aren't capped are in proportion to their odds, within what chance allows.
        assert abs(copies[0.25, s, 150] / copies[0.25, s, 1200] - 2 ** (3 * 0.25)) < 0.2
        assert max(copies[0.0, s, n] for n in (3, 20, 150, 1200)) - min(copies[0.0, s, n] for n in (3, 20, 150, 1200)) < 0.1


def test_mix_of_one_source_with_texts_that_take_nothing(spark):
    got = source_mix.mix_sources(docs(spark, [(1, "", None), (2, None, None), (3, "", "a")])).collect()
    assert sorted((x.doc_id, x.size, x.taken) for x in got) == [(1, 0, 0), (2, 0, 0), (3, 0, 0)]
    got = source_mix.mix_sources(docs(spark, [(1, "one two", "a"), (2, "", "a"), (3, "a b c " * 99, "a")])).collect()
    assert sum(x.taken for x in got) > 0 and all(x.taken <= 3 * x.size for x in got)


# --- leaks


def test_leaks_with_substitutions(spark, odd, nothing):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(5))
    items = [[word() for _ in range(n)] for n in (30, 50, 9, 120)]
    rows, want = [], set()
    for i in range(120):
        body = [word() for _ in range(r.randint(5, 200))]
        if i % 3 == 0:
            k = r.randrange(len(items))
            leak = [w if j % 9 != 4 or len(items[k]) < 13 else word() for j, w in enumerate(items[k])]
            at = r.randrange(len(body))
            body[at:at] = leak
            want.add((i, k))
        rows.append((i, (" ".join(body).upper() if i % 2 else ", ".join(body)), "s"))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(90, None), (None, "a b c")], "item_id long, text string")
    for bits in (27, 5):
        got = {(x.doc_id, x.item_id) for x in spaced_seeds.find_leaks(docs(spark, rows), bench, filter_bits=bits).collect()}
        assert got == want
    assert spaced_seeds.find_leaks(odd, bench).count() == 0 and spaced_seeds.find_leaks(nothing, bench).count() == 0
    assert spaced_seeds.find_leaks(odd, bench.limit(0)).count() == 0


def most_equal(masks, n):
    """For each length up to n, the most equal words of a stretch in which no mask fits, over all stretches."""
    keep, best, out = (1 << max(map(len, masks)) - 1) - 1, {0: 0}, [0]
    for i in range(1, n + 1):
        new = {}
        for state, count in best.items():
            for bit in (0, 1):
                s = state << 1 | bit
                if not any(i >= len(m) and s & int(m, 2) == int(m, 2) for m in masks):
                    new[s & keep] = max(new.get(s & keep, 0), count + bit)
        best = new
        out.append(max(best.values()))
    return out


def test_masks_fit_every_overlap():
    assert [n for n, most in enumerate(most_equal(spaced_seeds.MASKS, 300)) if n >= 10 and most >= 0.75 * n] == []
    assert [n for n, most in enumerate(most_equal(spaced_seeds.SHORT, 9)) if n >= 3 and most >= 0.75 * n] == []


def test_leaks_wherever_words_are_substituted(spark):
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in (1, 2, 3, 4, 5, 8, 9, 12, 13, 40)}
    places = [(n, x) for n in items if n <= 13 for k in range(n // 4 + 2) for x in itertools.combinations(range(n), k)]
    places += [(40, tuple(range(k, 40, 4))) for k in range(4)] + [(40, tuple(k for k in range(40) if k % 3 == 0))]
    rows = [(i, " ".join(f"d{i}{w}" if k in gone else w for k, w in enumerate(items[n])), "s") for i, (n, gone) in enumerate(places)]
    rows = [(i, f"a{i} b{i} {t} c{i}", s) for i, t, s in rows]
    want = {(i, n, n, n - len(gone)) for i, (n, gone) in enumerate(places) if n - len(gone) >= 0.75 * n}
    bench = spark.createDataFrame([(n, " ".join(x)) for n, x in items.items()], "item_id long, text string")
    assert {tuple(x) for x in spaced_seeds.find_leaks(docs(spark, rows), bench).collect()} == want


def brute_leaks(texts, items, min_words=13, share=0.75):
    """The longest overlap of each text and item, over all ways to lay one along the other and all stretches."""
    out = {}
    for d, text in texts.items():
        for k, item in items.items():
            for shift in range(1 - len(item), len(text)):
                start, stop = max(0, shift), min(len(text), shift + len(item))
                eq = [text[x] == item[x - shift] for x in range(start, stop)]
                if stop - start == len(item) and sum(eq) >= share * len(item):
                    out[d, k] = max(out.get((d, k), (0, 0)), (len(eq), sum(eq)))
                upto = [0, *itertools.accumulate(eq)]
                for i in range(len(eq)):
                    for j in range(i + min_words, len(eq) + 1):
                        if eq[i] and eq[j - 1] and upto[j] - upto[i] >= share * (j - i):
                            out[d, k] = max(out.get((d, k), (0, 0)), (j - i, upto[j] - upto[i]))
    return out


def test_leaks_are_as_by_brute_force(spark):
    r = random.Random(31)
    vocabulary = [f"w{i}" for i in range(60)]  # few words, so that there are chance hits
    items = {k: [r.choice(vocabulary) for _ in range(r.choice([2, 4, 8, 13, 20, 45]))] for k in range(10)}
    texts = {}
    for d in range(60):
        body = [r.choice(vocabulary) for _ in range(r.randint(0, 50))]
        if d % 4:
            item, at = items[r.randrange(10)], r.randrange(len(body) + 1)
            a = r.randrange(len(item))
            part = [x if r.random() > 0.2 else r.choice(vocabulary) for x in (item if d % 3 else item[a:])]
            body[at:at] = part
        texts[d] = body
    got = spaced_seeds.find_leaks(docs(spark, [(d, " ".join(x), "s") for d, x in texts.items()]), spark.createDataFrame([(k, " ".join(x)) for k, x in items.items()], "item_id long, text string"))
    want = brute_leaks(texts, items)
    assert {(x.doc_id, x.item_id): (x.n_words, x.n_equal) for x in got.collect()} == want and len(want) > 30


def test_best_overlap_is_the_longest():
    r = random.Random(4)
    for _ in range(300):
        n = r.randint(1, 14)
        eq = [r.random() < 0.7 for _ in range(n)]
        a, b = np.arange(n, dtype="uint64"), np.array([i if e else 99 + i for i, e in enumerate(eq)], "uint64")
        want = max(((j - i, sum(eq[i:j])) for i in range(n) for j in range(i + 1, n + 1) if eq[i] and eq[j - 1] and sum(eq[i:j]) >= 0.75 * (j - i)), default=(0, 0))
        assert spaced_seeds.best_overlap(a, b, 0.75) == want


# --- top k


@pytest.mark.parametrize("shape", [{}, {"rows": 16, "pivots": 4, "first": 1}])
def test_top_k_is_exact(spark, shape):
    r = np.random.default_rng(6)
    base = r.normal(size=(300, 8)) * 0.3
    base[50:150] = base[50]  # many equal vectors
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)] + [(400, None), (401, [1.0, None] * 4), (402, [float("nan")] * 8), (503, [0.5] * 3), (None, [0.5] * 8), (7, [float(x) for x in base[7]])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0))
    got = [tuple(x) for x in pivot_topk.top_k(d, every=10, k=5, **shape).orderBy("query_id", "rank").collect()]
    v = np.floor(base * 1024).astype("int64")
    want = []
    for q in range(0, 300, 10):
        order = sorted((j for j in range(300) if j != q), key=lambda j: (-int(v[q] @ v[j]), j))[:5]
        want += [(q, k + 1, j, int(v[q] @ v[j])) for k, j in enumerate(order)]
    assert got == want
    assert pivot_topk.top_k(d.limit(0)).count() == 0
    assert [tuple(x) for x in pivot_topk.top_k(d.where("vec_id in (0, 3)")).collect()] == [(0, 1, 3, int(v[0] @ v[3]))]


def brute_top(rows, every, k):
    """Exact integers, by length; all vectors given take part."""
    v = {i: [math.floor(1024 * x) for x in e] for i, e in rows}
    out = []
    for q in sorted(v):
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v[q], v[j])), j) for j in v if j != q and len(v[j]) == len(v[q]))[:k]
            out += [(q, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    return out


def test_top_k_of_several_lengths_and_large_components(spark):
    r = random.Random(1)
    rows = [(i, [r.uniform(-1, 1) for _ in range(2 if i % 3 else 3)]) for i in range(240)] + [(1000, []), (1001, []), (1100, [7.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [tuple(x) for x in pivot_topk.top_k(d, every=10, k=4).orderBy("query_id", "rank").collect()] == brute_top(rows, 10, 4)
    for size, shape in ((1e4, {"rows": 8, "pivots": 3, "first": 1}), (1e6, {})):  # products beyond 2**53
        large = [(i, [r.uniform(-size, size) for _ in range(3)]) for i in range(100)]
        d = spark.createDataFrame(large, "vec_id long, embedding array<double>")
        assert [tuple(x) for x in pivot_topk.top_k(d, every=10, k=4, **shape).orderBy("query_id", "rank").collect()] == brute_top(large, 10, 4)


def test_top_k_of_vectors_too_long_for_the_index(spark):
    r = random.Random(2)
    rows = [(i, [r.uniform(-1, 1) for _ in range(3)]) for i in range(600)]
    rows += [(600, [1e300, -0.5, 0.25]), (610, [-1e17, 3.0, 1e-3]), (613, [1.7e308, 1e308, -1e308]), (614, [5e9 + 0.0001, 1.0, 2.0]), (620, [4e9] * 3), (621, [4e9] * 3), (630, [1.0, 2.0]), (631, [-1e12, 1e12]), (640, [])]
    d = spark.createDataFrame([*rows, (614, [5e9 + 0.00011, 1.0, 2.0])], "vec_id long, embedding array<double>").withColumn("n", F.lit("x"))

    def exact(c):
        return int(c) * 1024 if abs(c) >= 2.0**52 else math.floor(c * 1024)

    v, want = {i: [exact(x) for x in e] for i, e in rows}, []
    assert max(len(str(x)) for x in v[613]) > 300
    for q in sorted(x for x in v if x % 10 == 0):
        scores = sorted((-sum(a * b for a, b in zip(v[q], v[j])), j) for j in v if j != q and len(v[j]) == len(v[q]))[:4]
        want += [(q, n + 1, j, max(min(-s, 2**63 - 1), -(2**63))) for n, (s, j) in enumerate(scores)]
    assert [tuple(x) for x in pivot_topk.top_k(d, every=10, k=4).orderBy("query_id", "rank").collect()] == want
    only = d.where("vec_id in (600, 613, 640)")
    assert [tuple(x) for x in pivot_topk.top_k(only, every=10, k=4).collect()] == [(600, 1, 613, 2**63 - 1)]


# --- licences


def test_licences(spark, odd, nothing):
    mit = dict((x, y) for x, y in license_digest.LICENSES if len(y) > 500)["MIT"]
    changed = mit.replace("<year> <holder>", "1999 Someone").replace("license", "licence").replace("Permission", "  PERMISSION").replace(",", "")
    rows = [(1, mit, "a"), (2, changed, "a"), (3, mit + " extra", "a"), (4, "Hello\nReleased under the MIT Licence", "a"), (5, "\n", "a")]
    got = {r.doc_id: r for r in license_digest.scan_licenses(docs(spark, rows)).collect()}
    assert [got[i].license_id for i in (1, 2, 3, 4, 5)] == ["MIT", "MIT", None, None, None] and got[4].notices == 1 and got[1].digest == got[2].digest
    assert license_digest.scan_licenses(odd).count() == odd.count() and license_digest.scan_licenses(nothing).count() == 0


def test_whole_licence_texts(spark):
    folder = pathlib.Path(license_digest.__file__).parent / "licenses"
    texts = [(x.stem, x.read_text()) for x in sorted(folder.glob("*.txt"))]
    short = {x: y for x, y in license_digest.LICENSES if len(y) > 500}
    texts += [("GPL-3.0", (folder / "GPL-3.0.txt").read_text().split("END OF TERMS")[0]), ("MIT", short["MIT"].split("\n", 2)[2])]
    texts += [("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, A\n" + short["BSD-3-Clause"]), ("0BSD", "BSD Zero Clause License\n" + short["0BSD"]), ("Apache-2.0", (folder / "Apache-2.0.txt").read_text().replace("\n", "\r\n"))]
    got = {r.doc_id: r.license_id for r in license_digest.scan_licenses(docs(spark, [(i, y, "a") for i, (_, y) in enumerate(texts)])).collect()}
    assert len(texts) == 19 and [got[i] for i in range(19)] == [x for x, _ in texts]


def test_copyright_statements_go_and_terms_stay(spark):
    short = {x: y for x, y in license_digest.LICENSES if len(y) > 500}
    isc = short["ISC"].split("\n", 2)[2]
    wrapped = next(x for w in range(60, 90) if "\ncopyright notice" in (x := textwrap.fill(isc.replace("\n", " "), w)))
    rows = [f"ISC License\n\nCopyright (c) 2004 A\nCopyright 2010-2020 B Inc.\n© 2021 C\nCopyright Jane Doe\nAll rights reserved.\n\n{wrapped}"]
    for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "BSL-1.0", "Unlicense", "0BSD"):
        body = short[name].split("\n", 2)[2] if name == "MIT" else short[name]
        rows += [textwrap.fill(body.replace("\n", " "), width) for width in (40, 60, 72, 90)]
    rows.append("\n".join(x.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ") for x in short["BSD-3-Clause"].split("\n")))
    got = {r.doc_id: r.license_id for r in license_digest.scan_licenses(docs(spark, [(i, x, "a") for i, x in enumerate(rows)])).collect()}
    assert [got[i] for i in range(len(rows))] == ["ISC", *(x for x in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "BSL-1.0", "Unlicense", "0BSD") for _ in range(4)), "BSD-3-Clause"]


def test_licence_sql_knows_whole_texts(spark):
    import duckdb

    texts = [x for _, x in license_digest.all_texts()] + ["A favour\nCopyright (c) 2001 X\nSub-licence, non-infringement; behaviour whilst HTTPS://a.b", "", None]
    d = docs(spark, [(i, x, "a") for i, x in enumerate(texts)])
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = con.execute(f"SELECT doc_id, digest, license_id, notices FROM ({license_digest.sql()})").fetchall()
    got = [tuple(r) for r in license_digest.scan_licenses(d).collect()]
    assert sorted(got) == sorted(want) and sum(x[2] is not None for x in got) == len(texts) - 3


# --- pages


def test_pages(spark):
    page = "<html><head><title>T</title></head><body><div id=top>Site name</div><p>One &amp; text {}</p><p>Second<br>{}</p><div>Bye all</div><div class=comments><p>hi</p></div><form>f</form><script>var a='<p>';</script></body>"
    marked = "<nav>menu</nav><article><header><h1>Title</h1></header><p>  A&nbsp;b\n c <b>d</b>e <div class='ad-slot'>buy</div><p>last &copy</article><footer>end</footer>"
    rows = [(i, f"http://h/x/{i}", page.format(i, i * 7)) for i in range(6)] + [(9, None, None), (9, None, None), (10, "http://alone/", page.format(1, 2)), (11, "http://m/1", marked), (12, "", ""), (None, "http://h/x/9", "<p>x")]
    got = page_diff.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(by[i] == f"One & text {i}\nSecond {i * 7}" for i in range(6))
    assert by[9] == by[12] == "" and by[10].startswith("Site name") and by[11] == "Title\nA b c de\nlast ©" and by[None] == "x"
    assert page_diff.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def page_texts(spark, rows):
    return {r.page_id: r.text for r in page_diff.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_pages_with_marks_are_compared_too(spark):
    page = "<body><div>Site name</div><p>Lead {0}</p><article><p>Text {0}</p><p>Said twice</p></article><div>Bye all</div></body>"
    assert page_texts(spark, [(i, f"http://h/{i}", page.format(i)) for i in range(4)]) == {i: f"Lead {i}\nText {i}\nSaid twice" for i in range(4)}


def test_short_articles_in_a_long_template(spark):
    page = "<nav>" + "<p>menu</p>" * 30 + "</nav>" + "".join(f"<p>Template {i}</p>" for i in range(20)) + "<p>Text {0}</p><p>More {0}</p>"
    assert page_texts(spark, [(i, f"http://h/{i}", page.replace("{0}", str(i))) for i in range(3)]) == {i: f"Text {i}\nMore {i}" for i in range(3)}


def test_copies_side_by_side_are_compared_with_other_pages(spark):
    page = "<p>Site name</p><div class=ad>{1}</div><p>Text {0}</p><article>Article {2}</article><p>Bye all</p>"
    rows = [(i, f"http://{h}/{i:05}", page.format(h if 2 <= i < 700 else i, i, h)) for h in ("h", "k") for i in range(900)]
    rows = [(i if h == "h" else i + 1000, u, p) for (i, u, p), h in zip(rows, ["h"] * 900 + ["k"] * 900)] + [(5000, "http://h/00005x", ""), (5001, "http://h/00699x", "<nav>menu</nav>")]
    want = {i + n: f"Text {h if 2 <= i < 700 else i}\nArticle {h}" for h, n in (("h", 0), ("k", 1000)) for i in range(900)} | {5000: "", 5001: ""}
    assert page_texts(spark, rows) == want
    only = [(i, f"http://o/{i}", "<p>Site name</p><p>Text</p>") for i in range(3)]
    assert page_texts(spark, only) == {i: "Site name\nText" for i in range(3)}


@pytest.mark.parametrize("around", ["body class='no-sidebar'", "body class='has-sidebar'", "body class='logged-in search-results'", "body class=sidebar", "section class='related-work'", "div class='legal social'", "div id=search", "form", "main class=widget"])
def test_layout_classes_leave_the_article(around):
    page = f"<html><{around}><div class=ad-slot>Buy</div><article class='post tag-legal'><p>Text</p><div class=social>Share</div></article></{around.split()[0]}>"
    assert [x for x, kind in page_diff.page_lines(page) if kind >= 0] == ["Text"]


def test_off_elements_stay_off():
    page = "<body><section class=comments><article class=comment>Hi</article></section><aside><article>Teaser</article></aside><div class=cookie-banner>Yes</div><div class=sidebar>Side</div><form>f</form><p class='related-work'>Text</p>"
    assert [x for x, kind in page_diff.page_lines(page) if kind >= 0] == ["Text"]


def brute_pages(rows):
    """Pages (page_id, url, parts), parts of kind 'open', 'main' or 'off': every page against the nearest other ones of its host, by plain tables."""

    def lcs(a, b):
        best = {(i, j): () for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                best[i, j] = best[i - 1, j - 1] + (a[i - 1],) if a[i - 1] == b[j - 1] else max(best[i - 1, j], best[i, j - 1], key=len)
        return best[len(a), len(b)]

    out = {}
    for i, url, parts in rows:
        host = sorted((u, k, p) for k, u, p in rows if u.split("/")[2] == url.split("/")[2])
        at, said = host.index((url, i, parts)), [x for x in parts if x[0] != "off"]
        gone = set()
        for side in (host[:at][::-1], host[at + 1 :]):
            other = next(([x for x in p if x[0] != "off"] for _, _, p in side if [x for x in p if x[0] != "off"] not in (said, [])), [])
            gone |= set(lcs([x for k, x in said if k == "open"], [x for k, x in other if k == "open"]))
        out[i] = "\n".join(x for k, x in said if k == "main" or x not in gone)
    return out


def test_pages_are_as_by_brute_force(spark):
    r = random.Random(21)
    rows = []
    for i in range(120):
        host, n = r.randrange(6), r.randrange(3)
        template = [("open", f"{w} of site {host}") for w in ("Name", "Search", "About", "Terms")]
        parts = [*template[: r.randint(1, 2)], ("off", f"Menu {i}"), *((r.choice(["open", "main"]), f"Text {host} {x} {r.randrange(3)}") for x in range(n)), *template[2:]]
        rows.append((i, f"http://h{host}/{r.randrange(40):02}", parts if r.random() < 0.9 else []))
    tag = {"open": "<p>{}</p>", "main": "<article><p>{}</p></article>", "off": "<nav>{}</nav>"}
    html = [(i, u, "<body>" + "".join(tag[k].format(x) for k, x in p)) for i, u, p in rows]
    assert page_texts(spark, html) == brute_pages(rows)


def test_long_pages(spark):
    lines = [f"Text {i}" for i in range(60_000)]
    rows = [(k, f"http://h/{k}", "<p>Site</p>" + "".join(f"<p>{x} {k}</p>" for x in lines) + "<p>Bye</p>" * 3000) for k in range(2)]
    assert page_texts(spark, rows) == {k: "\n".join(f"{x} {k}" for x in lines) for k in range(2)}


def test_common_lines_are_a_longest_subsequence():
    r = random.Random(8)
    for _ in range(200):
        a, b = ([r.randint(0, 5) for _ in range(r.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got = page_diff.common_lines(a, b)
        left = iter(b)
        assert len(got) == table[-1][-1] and got == sorted(got) and all(a[i] in left for i in got)


# --- groups


def brute_groups(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split(" ")
        w = [x for y in w for x in y.split("\n") if x]
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_groups_are_exact(spark, size, percent):
    r = random.Random(percent)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for g in range(12):
        base = [r.choice(words) + str(r.randint(0, 40)) for _ in range(r.choice([3, 8, 20, 60, 150]))]
        for _ in range(r.choice([1, 2, 14])):
            t = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((len(rows), " ".join(t) if g % 2 else "\n".join(t).upper()))
    rows += [(900, None), (901, ""), (902, "two words"), (903, "Two  words")]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.similar_groups(docs(spark, [(i, t, "s") for i, t in rows]), size=size, percent=percent).collect()}
    assert got == brute_groups(rows, size, percent)


def test_words_are_hashed_in_bulk(monkeypatch):
    digested = []
    monkeypatch.setattr(ngram_join, "blake2b", lambda word, digest_size: digested.append(len(word)) or hashlib.blake2b(word, digest_size=digest_size))
    assert len(ngram_join.shingles(" ".join(f"word{i}" for i in range(70_000)) + " " + "x" * 65, 4)) == 69_998
    assert digested == [65]


def test_sets_of_shingles_are_those_of_plain_words():
    r = random.Random(5)
    texts = [None, "", " \n", "a", "A b", "a b c d", "\x00 \x00\x00 a b c", "é\u00a0ü q", "x" * 64, "X" * 65, "lead " * 300_000]
    texts += ["".join(r.choice("aAb \n\x0b\x1c") for _ in range(r.randint(0, 40))) for _ in range(500)] + [" ".join("w" * r.randint(1, 90) for _ in range(6)) for _ in range(100)]
    for size in (1, 4, 5):
        named = {}
        got = ngram_join.shingle_sets(pa.array(texts), size)
        for text, x in zip(texts, got, strict=True):
            w = (text or "").encode().lower().split()
            plain = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
            assert len(x) == len(plain) and (x[1:] > x[:-1]).all() and named.setdefault(plain, x.tobytes()) == x.tobytes()
        assert len(set(named.values())) == len(named)
        assert [x.tobytes() for x in ngram_join.shingle_sets(pa.array(texts).slice(3, 40), size)] == [x.tobytes() for x in got[3:43]]


def test_bounded_pairs_are_those_of_two_loops():
    r = np.random.default_rng(3)
    sizes = [1, 2, 2, 3, 40, 130]  # the last is compared row by row
    cut, rows = np.cumsum([0, *sizes]), sum(sizes)
    n, bits = r.integers(600, 900, rows), r.integers(0, 2**63, (rows, 16)).astype("uint64") | r.integers(0, 2**63, (rows, 16)).astype("uint64")
    labels, own, bands = r.integers(0, 5, rows), r.integers(0, 2, rows), r.integers(7, 9, rows)
    crossing, tile = np.repeat([False, True, False, True, False, True], sizes), np.full(rows, 8)
    got = [(int(a), int(b)) for i, j in ngram_join.bound_pairs(cut, n, bits, labels, own, crossing, bands, tile, 60) for a, b in zip(i, j, strict=True)]
    want = []
    for x, y in zip(cut, cut[1:], strict=False):
        for a in range(x, y):
            for b in range(a + 1, y):
                most = min(n[a] - np.bitwise_count(bits[a] & ~bits[b]).sum(dtype="int64"), n[b] - np.bitwise_count(bits[b] & ~bits[a]).sum(dtype="int64"))
                if labels[a] != labels[b] and max(bands[a], bands[b]) == 8 and (own[a] != own[b] or not crossing[x]) and most * 100 >= (n[a] + n[b] - most) * 60:
                    want.append((a, b))
    assert sorted(got) == want and 0 < len(want) < 4000


def test_groups_odd_rows(spark, odd, nothing):
    got = [tuple(x) for x in ngram_join.similar_groups(odd).collect()]
    assert len(got) == odd.count() and (None, 2, None) in got and sorted(x for x in got if x[0] in (5, 6)) == [(5, 2, 5), (5, 2, 5), (6, 2, 5)]
    assert ngram_join.similar_groups(nothing).count() == 0


def test_chains_become_one_component(spark):
    from tickloom.llm.common import Scratch

    links = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {x.node: x.label for x in ngram_join.components(Scratch(spark), links, "chain").collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_bitmaps_grow_with_sets_and_fold():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 2**63, k).astype("uint64")) for k in (0, 1, 1024, 1025, 2048, 2049, 8000)]
    bitmaps = ngram_join._bitmaps(sets)
    assert [len(x) for x in bitmaps.to_pylist()] == [16, 16, 16, 32, 32, 64, 128]
    got = {}
    for rows, cut, bits in ngram_join.folded(bitmaps, np.array([0, 2, 4, 5, 7])):
        assert cut[-1] == len(rows) == len(bits)
        got |= {int(k): {64 * i + 8 * (b // 8) + 7 - b % 8 for i, x in enumerate(m.tolist()) for b in range(64) if x >> b & 1} for k, m in zip(rows, bits, strict=True)}
        assert all(got[int(k)] == {int(x >> np.uint64(20)) % (64 * bits.shape[1]) for x in sets[k]} for k in rows)
    assert sorted(got) == list(range(7))


def test_dealt_pairs_link_as_two_loops_say(spark):
    from tickloom.llm.common import Scratch

    r = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(r.choice(base) if r.random() < r.choice([0, 0.02, 0.05]) else x for x in base[: r.choice([3, 100, 120])])) for i in range(70)]
    rows += [(5, rows[9][1] + " more"), (5, rows[9][1] + " more"), (6, None), (90, None)]
    sets = [(i, {*ngram_join.shingles(t, 2).tolist()}) for i, t in rows]
    pairs = [(i, j) for i in [*range(70), 90] for j in range(70) if i > j and (i + j) % 3]
    want = {(i, j) for i, j in pairs for a, x in sets if a == i for b, y in sets if b == j and x & y and 100 * len(x & y) >= 80 * len(x | y)}
    table, near, sizes = docs(spark, [(i, t, "s") for i, t in rows]).select("doc_id", "text"), spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame([(i, len(x)) for i, x in sets], "node long, n long")
    for room, groups in ((1 << 19, 3), (4000, 6)):  # groups at most and at least
        scratch = Scratch(spark)
        dealt = ngram_join.deal(scratch, near, sizes, "t", room)
        n = len({(p.label, p.i, p.j) for x in dealt.collect() for p in x.places})
        assert n <= groups if room > 4000 else n >= groups
        assert {tuple(x) for x in ngram_join.verify(scratch, table, dealt, 2, 80, "t").collect()} == want and len(want) > 100


@pytest.mark.parametrize("stage", [False, True])
def test_large_sets_that_do_not_link_make_no_pairs(spark, monkeypatch, stage):
    import corpus_pipeline
    from tickloom.llm.common import Scratch

    made, write = {}, Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name: made.setdefault(name, write(self, df, name)))
    r = random.Random(2)
    word = lambda: f"{r.randrange(10**6)}"
    base = [word() for _ in range(3600)]
    table = docs(spark, [(i, " ".join(base + [word() for _ in range(2400)]), "s") for i in range(16)])
    if stage:
        assert corpus_pipeline.near_copies(spark, table, "").count() == 16
    else:
        assert all(x.component_id == x.doc_id and x.n_shingles > 5900 for x in ngram_join.similar_groups(table).collect())
    assert made["more_pairs"].count() == 0  # 120 pairs share tiles
