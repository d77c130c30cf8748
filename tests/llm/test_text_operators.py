"""Text operators against plain versions, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import glob
import hashlib
import os
import random
import re
import sys

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import bpe, catalog, crf, decontaminate, licences, minhash, perspectives, simhash, sql, substrings, urls, wordpiece

SF = "/root/testdata/sf0.001"
mounted = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not mounted")
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
DOCS = "doc_id long, text string"


def corpus(seed=3, n=60):
    """Short vocabulary, copies, near copies, shared passages, null and empty texts, a null id, a long text, a repeated row."""
    rnd = random.Random(seed)
    words = [a + b for a in ("ka", "Lo", "mé", "tu", "ri") for b in ("sa", "no", "pe", "vi", "da", "xu")]
    text = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    passage = text(30)
    rows = [(i, text(rnd.choice([3, 12, 13, 14, 40, 90]))) for i in range(n)]
    rows += [(100 + i, rows[i][1]) for i in range(0, n, 7)]
    rows += [(200 + i, rows[i][1] + " " + text(1)) for i in range(0, n, 5)]
    rows += [(300 + i, text(9) + "\n" + passage + "\t" + text(11)) for i in range(8)]
    rows += [(400, None), (401, ""), (402, " \n "), (None, passage), (403, "ka " * 400), (404, "ka " * 30), (405, text(4_000)), (405, rows[0][1])]
    return [*rows, rows[3]]


@mounted
@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from check import close, norm
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(([norm(v) for v in r] for r in df.select(*cols).collect()), key=str)
    rel = con.execute(sql.ORACLES[name])
    idx = [[d[0] for d in rel.description].index(c) for c in cols]
    want = sorted(([norm(r[i]) for i in idx] for r in rel.fetchall()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(close(x, y) for x, y in zip(a, b)), (a, b)


# ---- 1 -------------------------------------------------------------------------------------------------------------
@mounted
def test_language_held_out_accuracy(spark):
    got = {r.doc_id: r for r in catalog.QUERIES["op1_crf_language"](spark, "/root/testdata/sf0.01").collect()}
    want = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [d for d, r in got.items() if r.held_out]
    assert len(got) == len(want) and len(held) > 150
    assert sum(got[d].lang_pred == want[d] for d in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_forward_backward_equals_enumeration():
    import itertools
    rng = np.random.default_rng(0)
    moves, lengths = rng.normal(size=(3, 3)).astype(np.float32), np.array([1, 4, 2])
    scored = rng.normal(size=(7, 3)).astype(np.float32)
    got, at = crf.marginals(scored, lengths, moves), 0
    for n in lengths:
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            p = np.exp(sum(scored[at + t, k] for t, k in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            for t, k in enumerate(path):
                want[t, k] += p
        np.testing.assert_allclose(got[at:at + n], want / want.sum(axis=1, keepdims=True), atol=1e-5)
        at += n


def test_pair_marginals_equal_enumeration():
    import itertools
    rng = np.random.default_rng(1)
    moves, lengths = 2 * rng.normal(size=(3, 3)).astype(np.float32), np.array([2, 1, 5])
    scored = rng.normal(size=(8, 3)).astype(np.float32)
    _, words, got = crf.pair_marginals(scored, lengths, moves)
    want, at = [], 0
    for n in lengths:
        pair = np.zeros((n - 1, 3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            p = np.exp(sum(scored[at + t, k] for t, k in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            for t, (a, b) in enumerate(zip(path, path[1:])):
                pair[t, a, b] += p
        want += [x / x.sum() for x in pair]
        at += n
    assert words.tolist() == [0, 3, 4, 5, 6]
    np.testing.assert_allclose(got, np.array(want), atol=1e-5)


def test_code_switched_words_and_undetermined_texts(spark, docs_of):
    rows = [(" ".join(["alfa bravo charlie delta echo"] * 9), "a"), (" ".join(["uno dos tres cuatro cinco"] * 9), "b")]
    model = crf.train(rows)
    (_, words, p), = crf.label_words(["alfa bravo charlie uno dos tres"], model)
    assert [model.labels[k] for k in p.argmax(axis=1)] == list("aaabbb")
    got = [(r.lang_pred, r.score) for r in crf.predict(docs_of([(1, None), (2, "12 ½ _"), (3, ""), (4, "Dos TRES")]), model).orderBy("doc_id").collect()]
    assert [g[0] for g in got] == ["und", "und", "und", "b"] and got[0][1] == 0
    assert crf.predict(docs_of([], DOCS), model).count() == 0
    assert crf.predict(docs_of([(1, "x")]), crf.train([])).first().lang_pred == "und"


def test_training_sample_counts_different_texts(spark, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(crf, "SAMPLE_DOCS", 20)
    monkeypatch.setattr(crf, "SAMPLE_CHARS", 50)
    rows = [(f"word{i} text", "a") for i in range(30) for _ in range(25)] + [(f"word{i} text", "b") for i in range(5)]
    rows += [("".join(chr(97 + i % 26) for i in range(1_000)) + str(k), "c") for k in range(3)] + [(None, "a"), ("", "a"), ("x", None)]
    got = crf.sample(spark.createDataFrame(rows, "text string, lang string"), F.lit(True))
    assert len(set(got)) == len(got)
    assert [sum(lab == k for _, lab in got) for k in "abc"] == [20, 5, 3]
    pieces = [t for t, lab in got if lab == "c"]
    assert all(len(t) == 50 and any(t in x for x, lab in rows if lab == "c") for t in pieces)


# ---- 2 -------------------------------------------------------------------------------------------------------------
def test_perspectives(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", None), (1, 2, "cy", "yo"), (1, 2, "cy", "yo"), (1, -1, "system", "s"), (1, None, None, "?"), (2, 0, "system", "x"), (None, 0, "ann", "n")]
    got = {(r.conv_id, r.speaker, r.part): r for r in perspectives.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 2).collect()}
    assert {k[:2] for k in got} == {(1, "ann"), (1, "bob"), (1, "cy"), (None, "ann")}
    bob = got[1, "bob", 0]
    assert bob.text == "<|user name=ann|>\nhi<|end|>\n<|assistant|>\n<|end|>\n" and bob.mask == f"{len('<|user name=ann|>') + 1 + 10}:0,14:8"
    assert got[1, "cy", 1].n_turns == 2 and "<|user name=unknown|>" in got[1, "cy", -1].text


# ---- 3 -------------------------------------------------------------------------------------------------------------
def brute_contamination(rows, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for d, t in rows:
        w, hit, found = cut(t), set(), set()
        for item, x in items:
            iw = cut(x)
            for s in range(max(1, len(iw) - 9)) if iw else ():
                win = iw[s:s + 10]
                for a in range(len(w) - len(win) + 1):
                    if w[a:a + len(win)] == win:
                        hit |= set(range(a, a + len(win)))
                        found.add(str(item))
        out.append((d, len(w), len(hit), len(found), sorted(found)))
    return sorted(out, key=str)


def test_contamination_equals_brute_force(spark, docs_of):
    rows = corpus()
    items = [(1, rows[5][1]), (2, rows[8][1]), (2, rows[9][1]), (3, "ka sa"), (4, None), (5, "?!"), (6, "KASA, lono;\x00kasa"), (7, "ka ka ka ka ka ka ka ka ka ka ka")]
    got = decontaminate.scan(docs_of(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.item_ids) for r in got), key=str) == brute_contamination(rows, items)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan(docs_of(rows[:3]), none).where("contaminated").count() == 0
    assert decontaminate.scan(docs_of([], DOCS), none).count() == 0


# ---- 4 -------------------------------------------------------------------------------------------------------------
def test_licences_equal_brute_force(spark, docs_of):
    t = licences.TEMPLATES
    rows = corpus() + [(500 + i, f"{x} one two three {x.upper()}") for i, x in enumerate(t.values())]
    rows += [(600, rows[5][1] + " " + t["gpl-3.0-header"].replace("hope", "wish").replace("free software", "open software")), (601, t["mit"])]
    want = []
    for d, text in rows:
        w, found = licences.words_of(text), {}
        for name, x in t.items():
            m, s = len(licences.words_of(x)), licences.shingle_set(licences.words_of(x))
            share = max((len(s & licences.shingle_set(w[a:a + 2 * m])) / len(s) for a in range(0, max(1, len(w)), m)), default=0)
            if share >= 0.8:
                found[name] = share
        want.append((d, len(w), ",".join(sorted(found)), round(max(found.values(), default=0.0), 9)))
    got = licences.scan(docs_of(rows)).collect()
    assert sorted(((r.doc_id, r.n_words, r.licences, round(r.best, 9)) for r in got), key=str) == sorted(want, key=str)
    assert sum(bool(r.licences) for r in got) == len(t) + 2
    assert licences.scan(docs_of([], DOCS)).count() == 0


def test_licences_with_insertions_at_every_start(spark, docs_of):
    """Real notices have more words than the template; they are found wherever they start."""
    t = licences.TEMPLATES
    mit = t["mit-notice"].replace("documentation files,", 'documentation files (the "Software"),')
    long = t["mit-notice"].replace("free of charge,", "free of charge, " + "and then more " * 15)
    rows = [(i, "w " * i + mit + " x" * (200 - i)) for i in range(120)] + [(200 + i, "w " * i + long + " x" * (200 - i)) for i in range(60)]
    rows += [(300 + i, "w " * i + t["gpl-3.0-header"].replace("or at your option", "or if so at your option") + " x" * 9) for i in range(0, 90, 7)]
    want = []
    for d, text in rows:
        w, found = licences.words_of(text), {}
        for name, x in t.items():
            m, s = len(licences.words_of(x)), licences.shingle_set(licences.words_of(x))
            share = max(len(s & licences.shingle_set(w[a:a + 3 * m])) / len(s) for a in range(max(1, len(w) - 3 * m + 1)))
            if share >= 0.8:
                found[name] = share
        want.append((d, ",".join(sorted(found)), round(max(found.values(), default=0.0), 9)))
    assert all(x[1] for x in want)
    assert sorted((r.doc_id, r.licences, round(r.best, 9)) for r in licences.scan(docs_of(rows)).collect()) == want


# ---- 5 -------------------------------------------------------------------------------------------------------------
def brute_fingerprint(text):
    w = [x for x in re.split("[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    sh = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups_equal_brute_force(spark, docs_of):
    rows = corpus()
    fps = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    while True:
        new = [min(group[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 2) for i in range(len(rows))]
        if new == group:
            break
        group = new
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    want = sorted(((rows[i][0], f"{fps[i]:016x}", least[group[i]]) for i in range(len(rows))), key=str)
    got = simhash.near_groups(docs_of(rows)).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want
    assert simhash.near_groups(docs_of([], DOCS)).count() == 0


def test_components_of_a_long_chain(spark):
    n = 40
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(n)}, 1000: 1000, 1001: 1000}


# ---- 6 -------------------------------------------------------------------------------------------------------------
def brute_substrings(rows, window=13):
    cut = lambda t: [x for x in re.split("[\x20\x09-\x0D]+", t or "") if x]
    first: dict[tuple, float] = {}
    order = lambda d: float("inf") if d is None else d
    for d, t in rows:
        w = cut(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            first[k] = min(order(d), first.get(k, float("inf")))
    out = []
    for d, t in rows:
        w = cut(t)
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i:i + window])] < order(d) for j in range(i, i + window)}
        out.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [3, 4])
def test_substrings_equal_brute_force(spark, docs_of, seed):
    rows = corpus(seed)
    got = substrings.remove_repeats(docs_of(rows)).select("rest.doc_id", "text", "n_words", "n_removed").collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text or "") for r in got), key=str) == brute_substrings(rows)
    assert substrings.remove_repeats(docs_of([], DOCS)).count() == 0


@pytest.mark.parametrize("heavy", [0, 3])
def test_windows_of_heavy_minimizers_equal_brute_force(spark, docs_of, monkeypatch, heavy):
    monkeypatch.setattr(substrings, "HEAVY", heavy)
    rows = corpus(5)
    got = substrings.remove_repeats(docs_of(rows)).select("rest.doc_id", "text", "n_words", "n_removed").collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text or "") for r in got), key=str) == brute_substrings(rows)


def test_no_shard_holds_all_variants_of_a_minimizer(spark, docs_of, monkeypatch):
    monkeypatch.setattr(substrings, "HEAVY", 20)
    rnd = random.Random(6)
    text = lambda n: " ".join(f"w{rnd.randint(0, 10 ** 6)}" for _ in range(n))
    passage = text(30)
    rows = [(i, f"{text(20)} {passage} {text(20)}") for i in range(200)]
    packed = substrings._packed(docs_of(rows))
    met = substrings.passages_to_meet(packed, substrings._firsts(packed), substrings.WINDOW)
    held = met.groupBy("h", "part").agg({"words": "count"}).count(), met.select("h", "part", "words").distinct().groupBy("h", "part").count().agg({"count": "max"}).first()[0]
    assert held[0] > 200 and held[1] <= 20
    loop = substrings._packed(docs_of([(i, "ka " * 500 + text(3)) for i in range(30)]))
    most = substrings.passages_to_meet(loop, substrings._firsts(loop), substrings.WINDOW).groupBy("h", "part").count().agg({"count": "max"}).first()[0]
    assert most == 30  # once per document, however often it holds the window
    got = substrings.remove_repeats(docs_of(rows)).select("rest.doc_id", "text", "n_words", "n_removed").collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text or "") for r in got), key=str) == brute_substrings(rows)


def test_automaton_matches_equal_scan():
    rnd = random.Random(2)
    for _ in range(60):
        known = [[rnd.choice("ab") for _ in range(rnd.randint(1, 12))] for _ in range(3)]
        a = substrings.SuffixAutomaton()
        for k in known:
            a.add(k)
        q = [rnd.choice("abc") for _ in range(15)]
        inside = lambda x: any(k[i:i + len(x)] == x for k in known for i in range(len(k)))
        assert a.matches(q) == [max(n for n in range(e + 2) if n == 0 or inside(q[e + 1 - n:e + 1])) for e in range(len(q))]


# ---- 7 -------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("per_bucket", [5, 4_000])
def test_edited_texts_follow_the_order(spark, docs_of, per_bucket, monkeypatch):
    monkeypatch.setattr(minhash, "ROWS_PER_BUCKET", per_bucket)
    rows = [(i * 3, t) for i, (_, t) in enumerate(corpus())]
    random.Random(1).shuffle(rows)
    got = {r.doc_id: r for r in minhash.edited(docs_of(rows)).collect()}
    order = sorted(((d, t or "") for d, t in rows), reverse=True)
    assert len(got) == len(rows)
    for (d, a), (_, b) in zip(order, order[1:] + order[:1]):
        half = len(a) // 2
        text = a[:len(a) - half] + b[:half]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(a), hashlib.sha256(text.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and (r.near_edited == 1 or a != text)
    by = {}
    for d, t in order:
        assert by.setdefault(t, got[d].fingerprint) == got[d].fingerprint
    one = minhash.edited(docs_of([(7, "a b c")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert minhash.edited(docs_of([], DOCS)).count() == 0
    assert minhash.edited(docs_of([(None, "x y"), (None, "z"), (3, "q")])).count() == 3


def test_likeness_estimates_jaccard_and_search_finds_all(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randint(0, 10 ** 6)}" for _ in range(600)]
    texts = [" ".join(base[i:i + 500]) for i in range(0, 100, 4)]
    from tidemark.llm.common import word_hasher
    sigs = [minhash.signature(t, word_hasher()) for t in texts]
    for i, s in enumerate(sigs):
        shared = 496 - 4 * i
        assert abs(minhash.likeness(sigs[0], s) - shared / (992 - shared)) < 0.2
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {(r.query_id, r.doc_id) for r in minhash.search(docs, docs.where("doc_id % 5 = 0")).collect()}
    want = {(q, d) for q in range(0, 25, 5) for d in range(25) if (496 - 4 * abs(q - d)) / (496 + 4 * abs(q - d)) >= 0.8}
    assert got <= want and len(got) >= 0.99 * len(want)


def test_near_counts_equal_brute_force(spark, docs_of):
    """Copies, near copies, null and empty texts, null and repeated ids, repeated rows: counts against all pairs of texts."""
    rows = corpus(n=100) + [(1000 + i, None if i % 2 else corpus()[i][1]) for i in range(40)]
    got = minhash.with_search(docs_of(rows), F.col("doc_id") % 5 == 0).collect()

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    held = {}
    for d, t in rows:
        held.setdefault(t or "", []).append(d)
    sets = {t: shingles(t) for t in held}
    near = lambda a, b: len(a & b) / len(a | b) >= 0.8 if a | b else True
    want, linked = [], 0
    for d, t in rows:
        t = t or ""
        if d is None or d % 5:
            want.append((d, None, None, None))
            continue
        others = [o for o in held if o != t and near(sets[t], sets[o])]
        linked += len(others)
        docs = [x for o in (t, *others) for x in held[o]]
        want.append((d, len(others), len(docs) - 1, min(x for x in docs if x is not None)))
    assert linked > 10
    order = lambda rs: sorted(rs, key=lambda r: tuple((x is not None, x or 0) for x in r))
    assert order((r.doc_id, r.near_texts, r.near_docs, r.near_first) for r in got) == order(want)
    assert minhash.with_search(docs_of([], DOCS), F.col("doc_id") % 5 == 0).count() == 0


@pytest.mark.parametrize("asked_per_block, rows_per_part", [(128, 512), (7, 11)])
def test_many_different_near_copies_make_no_row_per_pair(spark, docs_of, asked_per_block, rows_per_part, monkeypatch):
    monkeypatch.setattr(minhash, "ASKED_PER_BLOCK", asked_per_block, raising=False)
    monkeypatch.setattr(minhash, "ROWS_PER_PART", rows_per_part, raising=False)
    rnd, rows, tables = random.Random(3), [], {}
    words = [f"w{i}" for i in range(200)]
    for i in range(300):
        t = list(words)
        for at in rnd.sample(range(200), 1 + i % 3):
            t[at] = f"x{rnd.random()}"
        rows.append((i, " ".join(t)))
    rows += [(None, rows[7][1] + " end"), (301, ""), (302, " "), (303, None)]
    kept = minhash.stored
    monkeypatch.setattr(minhash, "stored", lambda d, name: tables.setdefault(name, kept(d, name)))
    got = {r.doc_id: r for r in minhash.with_search(docs_of(rows), F.col("doc_id") % 3 == 0).collect()}
    held = {}
    for d, t in rows:
        held.setdefault(t or "", []).append(d)
    sets = {t: {tuple(t.split()[i:i + 5]) for i in range(max(1, len(t.split()) - 4))} if t.split() else set() for t in held}
    near = lambda a, b: len(a & b) / len(a | b) >= 0.8 if a | b else True
    pairs = 0
    for d, t in rows:
        if d is not None and d % 3 == 0:
            others = [o for o in held if o != (t or "") and near(sets[t or ""], sets[o])]
            docs = [x for o in (t or "", *others) for x in held[o]]
            pairs += len(others)
            assert (got[d].near_texts, got[d].near_docs, got[d].near_first) == (len(others), len(docs) - 1, min(x for x in docs if x is not None))
    if asked_per_block == 128:
        assert pairs > 5_000 and max(t.count() for t in tables.values()) < 2_000


# ---- 8 -------------------------------------------------------------------------------------------------------------
def test_urls(spark):
    rows = [(1, "http://A.Example.ORG/es/x?q"), (2, "https://example.org/en/17"), (3, "x://org/"), (4, "x://borg/fr/"), (5, "no scheme"), (6, None), (7, "http://a.com"),
            (8, "http://a.com#/fr/"), (9, "http://a.com/fr/1?/x"), (10, "http://b.example.org/a/b/c/d/e/f"), (11, "a://b://c.com/de/")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host", "2 as g")).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict if got[i].rule else None) for i, _ in rows] == [
        ("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/17", "example.org/en/1", "block"), ("org", "/", "org/", "allow"), ("borg", "/fr/", None, None),
        ("", "", None, None), ("", "", None, None), ("a.com", "", None, None), ("a.com", "", None, None), ("a.com", "/fr/1", "com/fr/", "allow"), ("b.example.org", "/a/b/c/d/e/f", "org/", "allow"), ("b:", "//c.com/de/", None, None)]
    assert {r.verdict for r in got.values()} <= {"allow", "block"} and got[10].template == "/a/b/c/d/**"
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_an_unlabelled_sibling_changes_no_verdict(spark):
    rules = (("allow", "h.com/good/x"), ("block", "h.com/bad/x"), ("allow", "h.com/fine/x"))
    base = [(f"http://h.com/{a}/x{i}", a) for a in ("good", "bad", "fine") for i in range(40)] + [(f"http://h.com/{a}/y", a) for a in ("good", "bad", "fine")]
    other = [(f"http://h.com/other/{i}", "other") for i in range(21)]
    verdicts = lambda rows: {a: {r.verdict for r in urls.judge(spark.createDataFrame([(i, u) for i, (u, b) in enumerate(rows) if b], "page_id long, url string"), rules).collect()
                                 if f"/{a}/" in r.path and r.rule is None} for a in ("good", "bad", "fine", "other")}
    monday = verdicts(base)
    assert monday["good"] <= {"allow"} and monday["fine"] <= {"allow"} and monday["bad"] == {"block"}
    assert {k: v for k, v in verdicts(base + other).items() if k != "other"} == {k: v for k, v in monday.items() if k != "other"}


def test_pooled_groups_keep_opposites_apart(spark):
    from pyspark.sql import functions as F
    leaves = [(p, t, n, b) for p, t, n, b in [(0.0, "a", 50, 0), (0.0, "b", 3, 0), (0.4, "c", 6, 2), (0.5, "d", 40, 20), (1.0, "e", 60, 60)]]
    d = spark.createDataFrame([([*leaves],)], "leaves array<struct<purity:double,template:string,labelled:bigint,blocked:bigint>>")
    got = d.select(F.aggregate("leaves", F.array().cast(urls.GROUPS), lambda acc, x: urls.pooled(acc, x)).alias("g")).first().g
    assert [x.templates for x in got] == [["a", "b"], ["c", "d"], ["e"]]
    assert [(x.l, x.b) for x in got] == [(53, 0), (46, 22), (60, 60)]


# ---- 9 and 10 ------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def vocabulary():
    pytest.importorskip("public_tokenizers")
    return catalog.vocabulary_path()


def greedy(symbols, vocab):
    n = 0
    while symbols:
        k = next((k for k in range(len(symbols), 0, -1) if "".join(symbols[:k]) in vocab), 0)
        if not k:
            return 1
        symbols, n = symbols[k:], n + 1
    return n


def test_wordpiece_counts_equal_greedy(spark, docs_of, vocabulary):
    rows = corpus() + [(700, "Ünïcode 漢字 supercalifragilistic " + "x" * 200)]
    vocab, letters = set(bpe.load(vocabulary)["vocab"]), bpe.byte_letters()
    counts = [[greedy([letters[b] for b in w] + [bpe.END], vocab) for w in (t or "").encode().lower().split()] for _, t in rows]
    got = wordpiece.count_tokens(docs_of(rows), vocabulary).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_pieces) for r in got), key=str) == sorted(((d, len(c), sum(c)) for (d, _), c in zip(rows, counts)), key=str)
    rnd = random.Random(3)
    for _ in range(200):
        small = {"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(1, 6))}
        a = wordpiece.Automaton(sorted(small))
        for _ in range(10):
            w = [rnd.choice("ab") for _ in range(rnd.randint(1, 9))]
            assert a.count(w) == greedy(w, small), (small, w)


def test_bpe_equals_tokenizer(spark, docs_of, vocabulary):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary)
    rnd = random.Random(1)
    rows = corpus() + [(800 + i, "".join(rnd.choice("aabcdé ΣİK' 漢字🙂½1!?\n\x1c\x85\u3000\u0301<|endoftext|>'s") for _ in range(80))) for i in range(60)]
    rows += [(900, "a<|endoftext|> b<|startoftext|>"), (901, "".join(rnd.choice("abcdeinthr") for _ in range(3_000))), (902, "ab" * 700), (903, "a" * 999)]
    got = bpe.encode(docs_of(rows), vocabulary, leaf=6)
    want = {}
    for d, x in rows:
        e = t.encode(x or "", add_special_tokens=False).ids
        want.setdefault(d, []).append((e, hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(t.decode(e, skip_special_tokens=False).encode()).hexdigest()))
    kept = got.collect()
    assert len(kept) == len(rows)
    for r in kept:
        assert (r.ids, r.ids_sha256, r.decoded_sha256) in want[r.doc_id] and r.n_tokens == len(r.ids)
    text = {r.doc_id: r.decoded for r in bpe.decode(got, vocabulary).where("doc_id >= 800").collect()}
    assert all(text[d] == t.decode(w[0][0], skip_special_tokens=False) for d, w in want.items() if d and d >= 800)
    assert bpe.encode(docs_of([], DOCS), vocabulary).count() == 0


# ---- pipeline ------------------------------------------------------------------------------------------------------
@mounted
def test_worker_cache_holds_one_operator():
    from tidemark.llm.common import forget, worker_cache
    forget()
    first = worker_cache("a", list)
    assert worker_cache("a", list) is first
    other = worker_cache("b", list)
    assert worker_cache("b", list) is other and worker_cache("a", list) is not first
    forget()


def test_clean_tells_rows_of_one_id_apart(spark, docs_of):
    passage, other = " ".join("abcdefghijkl"), " ".join("mnopqrstuvwx")
    rows = [(None, passage), (None, other), (None, None), (1, passage), (1, other), (1, "short"), (2, f"x {passage} y"), (3, ""), (3, ""), (3, passage)]
    got = decontaminate.clean(docs_of(rows), spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([x for x in rows if passage not in (x[1] or "")], key=str)


def test_near_dedup_keeps_one_row_of_each_group(spark, docs_of):
    rnd = random.Random(4)
    text = lambda: " ".join(f"w{rnd.randint(0, 10 ** 6)}" for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    near = "\t".join(a.upper().split())  # the same fingerprint
    # a group with ids, one of null ids only, one id twice in one group and in two groups, one row three times
    rows = [(5, a), (None, near), (7, near), (None, b), (None, "  ".join(b.split())), (None, b), (9, c), (9, "  ".join(c.split())), (9, d), *[(11, e)] * 3]
    got = [(r.doc_id, " ".join(r.text.split())) for r in simhash.keep_first(docs_of(rows)).collect()]
    assert sorted(got, key=str) == sorted([(5, a), (None, b), (9, c), (9, d), (11, e)], key=str)
    assert simhash.keep_first(docs_of([], DOCS)).count() == 0


def test_pipeline_stages_equal_brute_force(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept, now = [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF).cache()
        assert sorted(now.columns) == sorted(docs.columns)
        kept.append({r.doc_id: r.text for r in now.collect()})
    first = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept[0]) <= set(first) and len(kept[0]) > 0.95 * len(first)
    fps = {d: brute_fingerprint(t) for d, t in kept[0].items()}
    group = {d: d for d in fps}
    while True:
        new = {d: min(group[e] for e in fps if (fps[d] ^ fps[e]).bit_count() <= 2) for d in fps}
        if new == group:
            break
        group = new
    assert set(kept[1]) == set(group.values())
    left = {d: t for d, n, gone, t in brute_substrings(sorted(kept[1].items())) if gone < n or not gone}
    assert set(kept[2]) == set(left) and all(" ".join(kept[2][d].split()) == left[d] for d in left)
    assert set(kept[3]) == {d for d, _, hit, _, _ in brute_contamination(sorted(kept[2].items()), items) if not hit}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == set(kept[3])
