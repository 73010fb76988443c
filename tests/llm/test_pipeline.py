import re
from collections import Counter

import corpus_pipeline as cp
import pytest
from tickloom.llm import ordinal_quality
from tickloom.llm.common import Scratch, table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    names, scratch, before = docs.columns, Scratch(spark), docs
    for name, stage in cp.STAGES[:-1]:
        after = scratch.write(stage(spark, before, sf), name)
        assert after.columns == names
        assert after.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        before = after
    out = cp.STAGES[-1][1](spark, before, sf)
    assert out.count() == before.count()
    assert sorted(out.collect()) == sorted(cp.run(spark, sf).collect())


def test_extra_and_odd_rows(spark, sf):
    docs = table(spark, sf, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None, 1), (-1, "", "en", "x", 0, 2), (-2, "  ", None, None, 2, 3)], docs.schema.simpleString()[7:-1].replace(":", " ") + ", keep int")
    d = docs.selectExpr("*", "0 as keep").unionByName(odd)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, d, sf)
        assert out.columns == d.columns and out.count() > 0
        if name != "quality":  # which rates them as the empty text that it is fitted without
            assert {r.keep for r in out.where("keep > 0").collect()} == {1, 2, 3}


def _prose(k, n=40):
    """Words that no other k has."""
    return [f"t{k}x{i}" for i in range(n)]


@pytest.fixture(scope="module")
def made(spark, sf):
    """Documents with known shared lines, near copies, benchmark passages, nulls and repeated rows."""
    item = table(spark, sf, "benchmark").where("length(text) > 120").first().text
    rows, boiler = [], "this line stands on every site of the web"
    for k in range(12):
        rows.append((k, " ".join(_prose(k)), "en", f"s{k % 4}", 1))
    rows += [(100 + k, boiler + "\n" + " ".join(_prose(100 + k)), "en", f"s{k}", 1) for k in range(4)]
    rows += [(200 + k, " ".join(_prose(0) + ["end"] * (k + 1)), "en", "s1", 1) for k in range(2)]  # near copies of 0
    rows += [(300, " ".join(_prose(300)) + " " + item, "en", "s2", 1), (301, item, "en", "s2", 1)]
    rows += [(400, None, None, None, None), (401, "", "en", None, 0), (None, "no id", "en", "s1", 1), (5, " ".join(_prose(5)), "en", "s1", 1)]
    return spark.createDataFrame(rows, DOCS), rows, boiler


def _key(x):
    return (x.doc_id is None, x.doc_id or 0, x.text or "", x.source or "")


def test_quality_stage_keeps_what_a_loop_keeps(spark):
    sf = "/root/testdata/sf0.01"  # a smaller sample has too few poor texts to learn from
    docs = table(spark, sf, "documents").limit(300)
    whole = table(spark, sf, "documents")
    model = ordinal_quality.fit_quality(whole, table(spark, sf, "labels"))
    want = {}
    for r in docs.collect():
        score = sum(model.weight.get(ordinal_quality._hashed(x, model.bits), 0.0) for x in ordinal_quality.names(r.text or ""))
        tails = model.tails(score)
        want[r.doc_id] = (sum(tails), tails[-1])
    got = {r.doc_id: r for r in ordinal_quality.rate_quality(docs, model).collect()}
    assert all(abs(got[k].expected_grade - v[0]) < 1e-9 and abs(got[k].tail_probability - v[1]) < 1e-9 and got[k].keep == (v[1] >= 0.5) for k, v in want.items())
    kept = {r.doc_id for r in ordinal_quality.keep_good(docs, model).collect()}
    assert kept == {k for k, v in want.items() if v[1] >= 0.5} and 0 < len(kept) < 300


def test_line_stage_is_that_of_a_loop(spark, sf, made):
    d, rows, boiler = made
    sites = {}
    for doc_id, text, _, source, _ in rows:
        for line in (text or "").split("\n"):
            sites.setdefault(line, set()).add(source)
    assert len(sites[boiler]) == 4
    want = []
    for doc_id, text, lang, source, n in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if not (x == boiler and doc_id != 100)]
        want.append((doc_id, text if text is None else "\n".join(keep), source))
    got = [(r.doc_id, r.text, r.source) for r in cp.shared_lines(spark, d, sf).collect()]
    assert Counter(got) == Counter(want)


def test_copy_stage_is_that_of_all_pairs(spark, sf, made):
    d, rows, _ = made

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            sets.setdefault(doc_id, shingles(text))
    linked = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert (0, 200) in linked
    gone = {b for _, b in linked}
    want = sorted([x for x in sets if x not in gone])
    got = [r.doc_id for r in cp.near_copies(spark, d, sf).collect()]
    assert sorted(x for x in got if x is not None) == want and got.count(None) == 1


def test_leak_stage_is_that_of_a_loop(spark, sf, made):
    d, rows, _ = made
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = [words(r.text) for r in table(spark, sf, "benchmark").collect()]
    runs = {tuple(i[k : k + 13]) for i in items for k in range(len(i) - 12)}
    leaks = {doc_id for doc_id, text, *_ in rows if any(tuple(words(text)[k : k + 13]) in runs for k in range(len(words(text)) - 12))}
    assert leaks == {300, 301}
    got = Counter(r.doc_id for r in cp.leaks(spark, d, sf).collect())
    assert got == Counter(x[0] for x in rows if x[0] not in leaks)


def test_mix_stage_meets_its_targets(spark, sf, made):
    d, rows, _ = made
    got = cp.mix(spark, d, sf).collect()
    sizes = Counter((x[0], len(re.findall(r"[^\x20\x09-\x0D]+", x[1] or ""))) for x in rows)
    assert Counter((r.doc_id, r["size"]) for r in got) == sizes
    assert all(0 <= r.taken <= 3 * r["size"] for r in got) and abs(sum(r.taken for r in got) - sum(r["size"] for r in got)) < 0.35 * sum(r["size"] for r in got)


def test_stages_of_nothing(spark, sf):
    none = spark.createDataFrame([], DOCS)
    for name, stage in cp.STAGES:
        assert stage(spark, none, sf).collect() == [], name
