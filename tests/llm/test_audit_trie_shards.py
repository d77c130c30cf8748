"""Operators 11 to 13 against plain versions, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import audit, hilbert, trie

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, row long, curve long"


def documents(spark, rows):
    """Rows (doc_id, text, lang, source) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 7, "x", 1, 2) for r in rows], DOCS)


def corpus(seed=5, n=80):
    rnd = random.Random(seed)
    words = ["ka", "Lo", "mé", "tu#", "RI", "sa", "no", "pe"]
    text = lambda k: rnd.choice(["", " ", "\n"]) + " ".join(rnd.choice(words[:rnd.choice([2, 8])]) for _ in range(k)) + rnd.choice(["", "\t"])
    rows = [(i, text(rnd.choice([0, 1, 30, 250])), rnd.choice(["de", "en", None, ""]), rnd.choice(["src1", "src10", "src2", None])) for i in range(n)]
    rows += [(200 + i, rows[i % 9][1], "de", "src1") for i in range(60)]
    rows += [(400, None, "en", None), (401, "", "en", "src1"), (None, rows[3][1], "de", "src2"), (None, "only", None, None), (402, "Long " * 30_000, "fr", "x"), (402, "other", "fr", "x")]
    return [*rows, rows[5], rows[5]]


# ---- 11 ------------------------------------------------------------------------------------------------------------
def brute_audit(rows, labels):
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    bad = {d for d, _, x in labels if x == 1 and d is not None}
    fails = defaultdict(list)
    for d, t, lang, _ in rows:
        t = t or ""
        w = t.encode().split()
        f = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), d is not None and d > least[t])
        fails[lang or ""].append(({x for x, y in zip("ABCDE", f) if y}, d in good, d in bad))
    out = {}
    for part, docs in fails.items():
        shapley = defaultdict(int)
        for order in itertools.permutations("ABCDE"):
            left = docs
            for i, x in enumerate(order):
                gone, left = [r for r in left if x in r[0]], [r for r in left if x not in r[0]]
                shapley[x] += len(gone)
                out[part, "".join(order), i + 1] = [len(left), len(gone), sum(x in r[0] for r in docs) - len(gone), sum(r[0] == {x} for r in docs), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, order, i), v in out.items():
            if p == part:
                v.append(shapley[order[i - 1]])
    return out


@pytest.mark.parametrize("sizes", [{}, {"bound": 0, "region_bits": 6, "region_rows": 5}])
def test_audit_equals_brute_force(spark, sizes):
    rows = corpus()
    labels = [(i, i % 2, (i + 1) % 3) for i in range(0, 260, 3)] + [(3, 0, 1), (3, 1, None), (None, 1, 1), (9_999, 1, 1)]
    got = audit.audit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), **sizes).collect()
    want = brute_audit(rows, labels)
    assert len(got) == len(want) == 600 * len({r[2] or "" for r in rows})
    for r in got:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == want[r.part, r.filter_order, r.step], r


def test_audit_of_no_documents(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(documents(spark, []), labels).count() == 0
    assert audit.audit(documents(spark, [(None, None, None, None)]), labels).where("removed > 0").count() == 120 * 1


def test_sketch_clears_only_unique_texts(spark):
    from tidemark.llm.storage import stored
    hashes = [hash((i, "x")) for i in range(3_000)] + [5, 5, 6, 6, 6]
    rows = stored(spark.createDataFrame([(i, h) for i, h in enumerate(hashes)], "row long, h long"), "t")
    for sizes in ({}, {"bound": 0, "region_bits": 12, "region_rows": 700}):
        got = audit.possible_repeats(rows, "h", **sizes).collect()
        assert len(got) == len(rows.collect()) and all(r.maybe for r in got if r.h in (5, 6))
        assert sum(not r.maybe for r in got) > 2_500  # most unique texts are cleared before the shuffle
    region, slots = audit.places(np.array(hashes), 12, 6)
    assert all(len(set(s)) == audit.K for s in slots.tolist()) and set(region.tolist()) == set(range(6))


# ---- 12 ------------------------------------------------------------------------------------------------------------
def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            r, t = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()), (r, t)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    nodes, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        s = tuple(own.get(base, [])[:h] + own[c][h:])
        ends[s].append(c)
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
            if d:
                kids[s[:d - 1]].add(s[:d])
    saved = {k: (len(v) - 1) * len(k[-1][1].encode().split()) if k else 0 for k, v in nodes.items()}
    leaves = {k: not kids[k] for k in list(nodes)}
    out = []
    for k, v in nodes.items():
        below = [x for x in nodes if x[:len(k)] == k]
        out.append((v[0], len(k), nodes[k[:-1]][0] if k else None, len(v), len(kids[k]), sum(leaves[x] for x in below), sum(saved[x] for x in below),
                    hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n, depth, alphabet):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-60, 400), n):
        turns = [("ab"[i % 2], " ".join(["w"] * rnd.choice(alphabet))) for i in range(rnd.randint(1, depth))]
        rows += [(c, i - 2 if i else None, r if rnd.random() < .9 else None, t if t or rnd.random() < .5 else None, 1, 2) for i, (r, t) in enumerate(turns)]
    return rows


TURNS = "conv_id long, turn long, role string, text string, size long, high long"


@pytest.mark.parametrize("seed,n,depth,alphabet,eighths", [(1, 120, 6, [1, 2], (1, 8)), (2, 60, 40, [3], (1, 2, 8)), (3, 150, 9, [0, 1, 2, 5], (1, 2, 4, 8)), (4, 30, 3, [1], (8,))])
def test_trie_equals_brute_force(spark, seed, n, depth, alphabet, eighths):
    rows = conversations(seed, n, depth, alphabet)
    rows += [(None, 0, "a", "x", 1, 2), (500, 3, "a", "tie", 1, 2), (500, 3, "b", "tie", 1, 2), (500, 3, "b", "tie", 1, 2), (501, 1, "a", "long " * 50_000, 1, 2)]
    rows += [(600 + i, j, "a", f"copy {j}", 1, 2) for i in range(90) for j in range(5)]
    rnd = random.Random(seed)
    rnd.shuffle(rows)
    got = trie.prefix_trie(spark.createDataFrame(rows, TURNS), eighths).collect()
    assert sorted([(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got], key=str) == brute_trie(rows)


def test_trie_of_turnless_and_no_conversations(spark):
    assert trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    c = next(i for i in range(21, 40) if zlib.crc32(str(i).encode()) % 4 == 3)
    rows = [(c, 0, "a", "x", 1, 2)]  # its base is absent and its own turn is cut off
    got = trie.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()
    assert len(got) == 1 and (got[0].depth, got[0].n_convs, got[0].n_children, got[0].n_leaves) == (0, 1, 0, 1)
    assert got[0].ends_sha256 == hashlib.sha256(str(c).encode()).hexdigest()


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(0, 40) for b in range(a + 1, 41)]
    got = spark.createDataFrame(pairs, "a int, b int").select("a", "b", trie.two_fattest(F.col("a"), F.col("b")).alias("f")).collect()
    assert all(r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x) for r in got)


# ---- 13 ------------------------------------------------------------------------------------------------------------
def test_curve_visits_every_point_in_steps_of_one(spark):
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        points = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=n)), ", ".join(f"x{i} int" for i in range(n)))
        got = sorted((r[-1], r[:-1]) for r in points.withColumn("c", hilbert.curve_index([F.col(f"x{i}") for i in range(n)], bits)).collect())
        assert [c for c, _ in got] == list(range(1 << n * bits))
        assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for (_, p), (_, q) in zip(got, got[1:]))


def test_shards_hold_their_law(spark, monkeypatch):
    monkeypatch.setattr(hilbert, "LEAST_BUCKET", 3)
    rows = corpus()
    for k in (1, 7, 24):
        got = hilbert.shard(documents(spark, rows), k).collect()
        text = sorted((str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
        assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == text
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert sorted(slots) == list(range(k)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
        order = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
        assert order == sorted(order)  # shards are runs of the curve


def test_few_and_no_documents(spark):
    assert hilbert.shard(documents(spark, [])).count() == 0
    got = hilbert.shard(documents(spark, [(None, None, None, None)] * 3)).collect()
    assert len({r.shard for r in got}) == 3 and all(r.slot == 0 and r.size == 8 and r.text_crc32 == 0 for r in got)


def test_files_in_curve_order_prune(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, "w " * rnd.randint(1, 400), rnd.choice(["de", "en", "es", "fr"]), f"src{rnd.randint(1, 20)}") for i in range(3_000)]
    docs = documents(spark, rows)
    hilbert.write_files(docs, f"{tmp_path}/h", 32)
    docs.repartition(32, "doc_id").write.parquet(f"{tmp_path}/p")
    back = spark.read.parquet(f"{tmp_path}/h")
    assert sorted(back.columns) == sorted(docs.columns) and back.exceptAll(docs.select(back.columns)).count() == 0 and back.count() == 3_000
    kept = {}
    for name in "hp":
        m = hilbert.manifest(spark.read.parquet(f"{tmp_path}/{name}")).cache()
        kept[name] = [hilbert.prune(m, **cond).count() / m.count() for cond in ({"lang": ("de", "de")}, {"size": (0, 100)}, {"lang": ("en", "en"), "size": (700, 9_999)})]
    assert all(a < 0.6 * b for a, b in zip(kept["h"], kept["p"])), kept
