"""Sharding, near-duplicates, substrings and the pipeline against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import common, near_docs, near_vectors, queries, sharding, substring

SF, SF1 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


class Union(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def frame(spark, rows, extra=""):
    return spark.createDataFrame([(*r, *(["x"] if extra else [])) for r in rows], "doc_id bigint, text string" + extra)


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components(spark, one_task):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(40)] + [(1, None), (2, 2)]
    u = Union()
    for a, b in edges:
        if a != b and b is not None:
            u.join(a, b)
    out = common.components(spark.createDataFrame(edges, "a bigint, b bigint"), one_task).collect()
    assert {r.node: r.component for r in out} == {x: u.find(x) for x in list(u)} and len(out) == len(u)


def test_shards(spark):
    docs = pq.read_table(f"{SF1}/documents.parquet").to_pylist()
    rows = queries.op3_sharding(spark, SF1).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d["doc_id"] for d in docs)
    text = {d["doc_id"]: d["text"].encode() for d in docs}
    size, slots, shards_of = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        assert r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.law == "bytes" and r.grown_shard is None
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        shards_of[text[r.doc_id]].add(r.shard)
    assert set(size) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) - min(size.values()) <= 2 * max(r.size for r in rows)
    assert all(len(s) == 1 for s in shards_of.values())


def test_shards_cut_a_hot_group_and_odd_rows(spark):
    rows = [(i, "same text here") for i in range(3000)] + [(3000 + i, f"text {i} " * (1 + i % 7)) for i in range(3000)] + [(None, None), (-1, ""), (7, None)]
    out = sharding.assign_shards(frame(spark, rows, ", shard string"), shards=4).collect()
    size = Counter()
    for r in out:
        size[r.shard] += r.size
    assert len(out) == len(rows) and max(size.values()) <= 1.03 * min(size.values())
    assert sharding.assign_shards(frame(spark, [])).count() == 0
    assert {r.shard for r in sharding.assign_shards(frame(spark, [(1, "a")] * 5)).collect()} <= set(range(16))


def brute_near(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(frozenset(near_docs.shingle_set((t or "").encode(), k)))
    u, ids = Union(), [(i, s) for i, ss in sets.items() for s in ss if i is not None]
    for x, (i, a) in enumerate(ids):
        u.find(i)
        for j, b in ids[:x]:
            c = len(a & b)
            if a and b and 100 * c >= percent * (len(a) + len(b) - c):
                u.join(i, j)
    return u


def near_rows(seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["the", "of"] * 40
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "é"), (7, "É")]
    n = 10
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(2, 120))]
        for _ in range(rng.randint(1, 8)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 12))):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((n, " ".join(t)))
            n += 1
    return rows


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_documents_match_brute_force(spark, shingle):
    rows = near_rows()
    out = {r.doc_id: r for r in near_docs.near_duplicates(frame(spark, rows, ", component_id string"), shingle=shingle).collect()}
    u = brute_near(rows, shingle)
    for i, t in rows:
        assert out[i].n_shingles == len(near_docs.shingle_set((t or "").encode(), shingle))
        assert out[i].component_id == u.find(i) and out[i].kept == (u.find(i) == i), i


def test_blocks_find_what_stars_miss(spark, monkeypatch):
    monkeypatch.setattr(near_docs, "STARS", 0)
    monkeypatch.setattr(near_docs, "BLOCK", 3)
    rows = near_rows(5)
    u = brute_near(rows, 2)
    assert {r.doc_id: r.component_id for r in near_docs.near_duplicates(frame(spark, rows), shingle=2).collect()} == {i: u.find(i) for i, _ in rows}


def test_blocks_emit_no_more_than_rows(spark, monkeypatch):
    """2,000 variants of one text, of Jaccard 0.70 to 0.79 to each other: their pairs are four million, their links a few."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(160)]
    rows = []
    for i in range(2000):
        t = list(base)
        for k, at in enumerate(rng.sample(range(0, 160, 2), 7)):
            t[at] = f"x{i}_{k}"
        rows.append((i, " ".join(t)))
    sets = [near_docs.shingle_set(t.encode(), 2) for _, t in rows]
    at = {x: k for k, x in enumerate(sorted(set().union(*sets)))}
    has = np.zeros((len(rows), len(at)), np.float32)
    for i, own in enumerate(sets):
        has[i, [at[x] for x in own]] = 1
    common, n = has @ has.T, has.sum(1)
    near = np.triu(100 * common >= 80 * (n[:, None] + n - common), 1)
    u = Union()
    for i, j in np.argwhere(near).tolist():
        u.join(i, j)
    assert near.sum() < 10 and (common / (n[:, None] + n - common)).mean() > 0.7
    given = []
    kept = near_docs._by_prefix

    def counted(*x):
        found = kept(*x)
        given.append(found.count())
        return found

    monkeypatch.setattr(near_docs, "_by_prefix", counted)
    out = near_docs.near_duplicates(frame(spark, rows), shingle=2)
    assert given and given[0] < len(rows)
    assert {r.doc_id: r.component_id for r in out.collect()} == {i: u.find(i) for i in range(len(rows))}


def test_near_documents_long_and_repeated_texts(spark):
    rng = random.Random(3)
    long = [f"w{rng.randint(0, 3000)}" for _ in range(60_000)]
    other = list(long)
    for at in range(0, len(other), 60):
        other[at] = "changed"
    rows = [(1, " ".join(long)), (2, " ".join(other)), (3, "a " * 50_000), (4, "a a"), (5, "x" * 100_000), (5, "x" * 100_000)]
    out = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_docs.near_duplicates(frame(spark, rows), shingle=2).collect())
    n = [len(near_docs.shingle_set(t.encode(), 2)) for _, t in rows]
    assert out == [(1, n[0], 1), (2, n[1], 1), (3, 1, 3), (4, 1, 3), (5, 1, 5), (5, 1, 5)]


def test_near_documents_on_the_table(spark):
    rows = [(d["doc_id"], d["text"]) for d in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    u = brute_near(rows, 2)
    out = queries.op4_minhash(spark, SF).collect()
    assert {r.doc_id: r.component_id for r in out} == {i: u.find(i) for i, _ in rows} and len(out) == len(rows)


def test_near_documents_repeated_and_null_ids(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (3, "x")]
    out = near_docs.near_duplicates(frame(spark, rows), shingle=2).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in out) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    left = near_docs.drop_near_duplicates(frame(spark, rows), shingle=2).collect()
    assert sorted(r.doc_id or 0 for r in left) == [0, 1, 3]
    assert near_docs.near_duplicates(frame(spark, [])).count() == 0


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 1200).astype(np.uint64) * np.uint64(2)
    a, b = np.unique(pool[:1000]), np.unique(pool[100:1100])
    ra, rb = near_docs.registers(a), near_docs.registers(b)
    same, filled = ((ra == rb) & (ra != near_docs.EMPTY)).sum(), ((ra != near_docs.EMPTY) | (rb != near_docs.EMPTY)).sum()
    assert same / filled == pytest.approx(900 / 1100, abs=0.1)


def test_vectors_recall_and_counts(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "CHUNK", 16)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 32))
    near = np.repeat(base[:30], 12, 0) + rng.normal(0, 0.05, (360, 32))
    edge = base[40:80] + rng.normal(0, 0.3, (40, 32))
    vectors = np.concatenate([base, near, edge, base[:3], base[:3]]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(5000, None), (5001, [0.0] * 32), (5002, [float("nan")] * 32), (5003, [1.0, None] * 16), (5004, [1.0]), (5005, [])]
    got = {r.vec_id: r for r in near_vectors.near_vectors(spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, n_links int")).collect()}
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.95) & ~np.eye(len(unit), dtype=bool)
    found = np.array([got[i].n_links for i in range(len(unit))])
    assert (found <= links.sum(1)).all() and found.sum() >= 0.9 * links.sum()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(5000, 5006))
    assert got[len(unit) - 1].n_links >= 2 and got[len(unit) - 1].component_id == 2


def test_vectors_of_other_lengths_and_an_empty_table(spark):
    rng = np.random.default_rng(6)
    rows = []
    for n, length in ((400, 16), (300, 8), (6, 5), (4, 1)):
        base = rng.normal(size=(n // 2, length))
        rows += [v.tolist() for v in np.concatenate([base, base + rng.normal(0, 0.02, base.shape)])]
    rows.append(rng.normal(size=20_000).tolist())
    table = [(i, v) for i, v in enumerate(rows)] + [(None, rows[0])]
    got = {r.vec_id: r for r in near_vectors.near_vectors(spark.createDataFrame(table, "vec_id bigint, embedding array<double>")).collect() if r.vec_id is not None}
    want, found = 0, 0
    for i, a in enumerate(rows):
        n = sum(len(a) == len(b) and j != i and float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)) >= 0.95 for j, b in enumerate(rows))
        want, found = want + n, found + got[i].n_links
        assert got[i].n_links <= n
    assert found >= 0.9 * want and len(got) == len(rows)
    assert all(got[700 + i].n_links >= 1 and got[700 + i].component_id < 703 for i in range(6))  # the rare length
    assert near_vectors.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_vectors_on_the_table(spark):
    t = pq.read_table(f"{SF1}/embeddings.parquet").to_pylist()
    e = np.array([r["embedding"] for r in t], float)
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    want = int((e @ e.T >= 0.95).sum() - len(e))
    out = queries.op5_pivot_index(spark, SF1).collect()
    assert len(out) == len(t) and 0.9 * want <= sum(r.n_links for r in out) <= want


def test_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(3)
    for _ in range(40):
        h, least = rng.integers(0, 12, rng.integers(1, 60)).astype(np.uint64), int(rng.integers(1, 12))
        want = []

        def split(a, b):
            if b - a + 1 >= least:
                c = a + int(np.argmin(h[a : b + 1]))
                want.append((a, c, b))
                split(a, c - 1)
                split(c + 1, b)

        split(0, len(h) - 1)
        assert sorted(zip(*(x.tolist() for x in substring.compact_windows(h, least))), key=lambda w: w[1]) == sorted(want, key=lambda w: w[1])


def covered(out):
    got = defaultdict(set)
    for r in out:
        got[r.doc_id].update(range(r.start_word, r.end_word))
    return got


def test_repeated_passages_match_brute_force(spark):
    docs = {d["doc_id"]: near_docs.words_of(d["text"].encode()) for d in pq.read_table(f"{SF1}/documents.parquet").to_pylist()}
    own, want = defaultdict(set), defaultdict(set)
    for i, w in docs.items():
        for p in range(len(w) - 49):
            own[tuple(w[p : p + 50])].add(i)
    for i, w in docs.items():
        for p in range(len(w) - 49):
            if len(own[tuple(w[p : p + 50])]) > 1:
                want[i].update(range(p, p + 50))
    got = covered(queries.op2_substring_dedup(spark, SF1).collect())
    assert all(want[i] <= got[i] for i in want)
    # what has no verbatim stretch has a near one: some other document's words, slid along, reach the similarity
    grams = {i: [tuple(w[p : p + 5]) for p in range(len(w) - 4)] for i, w in docs.items()}
    holders = defaultdict(set)
    for i, g in grams.items():
        for x in g:
            holders[x].add(i)
    for i in set(got) - set(want):
        span = sorted(got[i])
        tokens = grams[i][span[0] : span[-1] - 3]
        others = Counter(y for x in set(tokens) for y in holders[x] if y != i)
        best = 0.0
        for size in sorted({46, (46 + len(tokens)) // 2, len(tokens)}):  # its best part, or all of it
            for at in range(0, len(tokens) - size + 1):
                own = set(tokens[at : at + size])
                for y, _ in others.most_common(5):
                    places = [p for p, x in enumerate(grams[y]) if x in own]
                    for p in places[:3]:
                        for q in places[-3:]:
                            b = set(grams[y][p : q + 1])
                            best = max(best, len(own & b) / len(own | b))
                if best >= 0.8:
                    break
        assert best >= 0.8, i


def test_planted_passages_and_odd_rows(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    passage, near = text(60), text(120).split()
    changed = list(near)
    for i in (20, 75):
        changed[i] = "other"
    rows = [(1, text(30) + " " + passage + " " + text(50)), (2, passage.upper() + " " + text(9)), (3, text(200)), (4, text(40) + " " + " ".join(near)), (5, " ".join(changed)), (6, None), (7, ""), (8, "short"), (None, passage), (9, text(49) + " x"), (10, None)]
    rows += [(11, rows[9][1]), (12, rows[2][1] + " z")]
    out = substring.repeated_passages(frame(spark, rows, ", score string")).collect()
    got = covered(out)
    assert set(got) == {1, 2, 3, 4, 5, 9, 11, 12}
    assert got[1] == set(range(30, 90)) and got[2] == set(range(60)) and got[9] == set(range(50)) and len(got[5]) >= 100
    assert {r.class_id for r in out if r.doc_id in (1, 2)} == {1}
    assert substring.repeated_passages(frame(spark, [])).count() == 0


def varied(rng, words, changes):
    out = list(words)
    for i in rng.sample(range(3, len(words) - 3), changes):
        out[i] = f"v{rng.randint(0, 10**6)}"
    return out


def test_passages_meet_beside_variants_that_own_their_signatures(spark):
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    rows = []
    for family in range(12):
        passage = words(60)
        for k in range(10):
            new = list(passage)
            for i in (rng.randint(10, 25), rng.randint(34, 49)):
                new[i] = f"v{rng.randint(0, 10**6)}"
            rows.append((family * 100 + k, " ".join(words(40) + new + words(40))))
        rows += [(family * 100 + k, " ".join(words(40) + passage + words(40))) for k in (50, 51)]
    out = substring.repeated_passages(frame(spark, rows)).collect()
    got, classes = covered(out), {(r.doc_id, r.class_id) for r in out}
    for family in range(0, 1200, 100):
        assert all(set(range(40, 100)) <= got[family + k] for k in (50, 51))
        assert {c for d, c in classes if d == family + 50} & {c for d, c in classes if d == family + 51}


def test_covered_tie_still_counts_for_its_other_document(spark):
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    rows = []
    for family in range(0, 1200, 100):
        passage = words(200)
        near = lambda places: [f"v{rng.randint(0, 10**6)}" if i in places else w for i, w in enumerate(passage)]
        low, high = near((40, 90, 140)), near((65, 115, 165))  # 0.86 to the passage, 0.74 to each other
        rows += [(family + k, " ".join(words(30) + x + words(30))) for k, x in enumerate((low, high, passage))]
    anywhere = lambda x, y: substring.similar_stretches(*(substring.tokens_of(t.encode()) for t in (x, y)), [(i, i) for i in range(26, 226)], 150, 0.8)
    assert anywhere(rows[2][1], rows[1][1]) and not anywhere(rows[1][1], rows[0][1])
    got = covered(substring.repeated_passages(frame(spark, rows), min_words=154).collect())
    assert set(got) == {r[0] for r in rows}


def test_similar_parts_of_a_longer_edited_copy():
    rng = random.Random(13)
    for _ in range(20):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
        # a change every 10 words around 100 words with two changes
        places = [*range(4, 100, 10), 133, 167, *range(204, 300, 10)]
        texts = words, [f"v{rng.randint(0, 10**6)}" if i in places else w for i, w in enumerate(words)]
        a, b = (substring.tokens_of(" ".join(x).encode()) for x in texts)
        anchors = [(i, i) for i in np.flatnonzero(a == b).tolist()]
        got = set()
        for a0, a1, b0, b1, score in substring.similar_stretches(a, b, anchors, 46, 0.8):
            x, y = set(a[a0 : a1 + 1].tolist()), set(b[b0 : b1 + 1].tolist())
            assert score == len(x & y) / len(x | y) >= 0.8 and min(a1 - a0, b1 - b0) + 1 >= 46
            got.update(range(a0, a1 + 1))
        want = set()
        for p in range(len(a)):  # brute force over all parts of equal places
            for q in range(p + 45, len(a)):
                same = int((a[p : q + 1] == b[p : q + 1]).sum())
                if a[p] == b[p] and a[q] == b[q] and same >= 0.8 * (2 * (q - p + 1) - same):
                    want.update(range(p, q + 1))
        assert want <= got and set(range(100, 196)) <= got


def test_every_place_of_a_passage_is_reported(spark):
    rng = random.Random(14)
    words = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    passage = words(60)
    rows = [(1, " ".join(passage + words(100) + passage)), (2, " ".join(words(30) + passage + words(70) + passage + words(70) + passage))]
    out = substring.repeated_passages(frame(spark, rows)).collect()
    assert {(r.doc_id, r.start_word, r.end_word) for r in out} == {(1, 0, 60), (1, 160, 220), (2, 30, 90), (2, 160, 220), (2, 290, 350)}


def test_pipeline_stages_match_plain_python(spark):
    import corpus_pipeline as cp
    from gaugeflow.llm import bpe, decontam, secrets

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["language_id", "minhash_near_dedup", "decontamination", "secret_scan", "bpe"]
    out = {r.doc_id: r for r in cp.run(spark, SF).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    lettered = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    u = brute_near(lettered, 5)
    single = [(i, t) for i, t in lettered if u.find(i) == i]
    q = decontam.Queries([(b["item_id"], b["text"].encode()) for b in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()])
    clean = [(i, t) for i, t in single if not decontam._hits(q, [t.encode()])[1][0]]
    assert set(out) == {i for i, _ in clean}
    codec = bpe.BpeCodec(bpe.default_path())
    for i, t in clean:
        done = 0
        masked = []
        for _, a, b in sorted(secrets.scan(t), key=lambda s: (s[1], -s[2])):
            if a >= done:
                masked += [t[done:a], "[secret]"]
            done = max(done, b)
        assert bytes(out[i].ids) == codec.encode("".join([*masked, t[done:]]))


def test_pipeline_keeps_columns_and_odd_rows(spark):
    import corpus_pipeline as cp

    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "plain words here", None, "s", 16), (3, "123", "en", "s", 3), (2, "plain words here", None, "s", 16)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.count() == 0 or {r.doc_id for r in docs.collect()} <= {2}


def test_pipeline_fills_languages_and_takes_an_empty_table(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    blank = docs.select("doc_id", "text", F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("lang"), "source", "n_chars")
    out = {r.doc_id: r.lang for r in cp.language_id(spark, blank, SF).collect()}
    known = {r.doc_id: r.lang for r in docs.collect()}
    assert all(out[i] == known[i] for i in out if i % 3 > 0) and np.mean([out[i] == known[i] for i in out]) > 0.95 and None not in out.values()
    none = docs.limit(0)
    for _, stage in cp.STAGES:
        none = stage(spark, none, SF)
    assert none.count() == 0 and none.columns == ["doc_id", "lang", "n_tokens", "ids", "decoded_sha256"]


def test_a_divergent_smallest_id_loses_no_family(spark):
    """Two documents share 55 words; a lower id holds them with two words changed, which is too far from both."""
    rng = random.Random(9)
    rows, fresh = [], lambda n: [f"v{rng.randint(0, 10**9)}" for _ in range(n)]
    for f in range(150):
        passage = fresh(55)
        far = list(passage)
        far[15], far[40] = fresh(2)
        for k, part in enumerate((far, passage, passage)):
            rows.append((3 * f + k, " ".join(fresh(20) + part + fresh(20))))
    got = covered(substring.repeated_passages(frame(spark, rows)).collect())
    assert all(set(range(20, 75)) <= got[3 * f + k] for f in range(150) for k in (1, 2))


def test_near_passages_are_recalled(spark):
    """Passages of 70 words with one word changed in the copy: similarity 0.8 or more, no verbatim run of 50 words."""
    rng = random.Random(12)
    rows, fresh = [], lambda n: [f"v{rng.randint(0, 10**9)}" for _ in range(n)]
    for f in range(120):
        passage = fresh(70)
        near = list(passage)
        near[35] = fresh(1)[0]
        rows += [(2 * f, " ".join(fresh(30) + passage + fresh(30))), (2 * f + 1, " ".join(fresh(10) + near + fresh(50)))]
    line = fresh(30)  # a line that all of these share and nothing else
    rows += [(1000 + i, " ".join(fresh(40) + line + fresh(40))) for i in range(300)]
    got = covered(substring.repeated_passages(frame(spark, rows)).collect())
    assert np.mean([len(got[2 * f] & set(range(30, 100))) >= 60 for f in range(120)]) >= 0.9
    assert not any(i >= 1000 for i in got)


def test_passages_that_repeat_themselves_are_kept(spark):
    """Sixty words that are ten words six times, in two documents beside lower ids with three rounds of them."""
    rng = random.Random(14)
    rows, fresh, top = [], lambda n: [f"v{rng.randint(0, 10**9)}" for _ in range(n)], 12
    for f in range(40):
        unit = fresh(10)
        for k in range(top):
            rows.append((f * 20 + k, " ".join(fresh(25) + unit * 3 + fresh(25))))
        for k in (top, top + 1):
            rows.append((f * 20 + k, " ".join(fresh(20) + unit * 6 + fresh(20))))
    got = covered(substring.repeated_passages(frame(spark, rows)).collect())
    assert all(set(range(20, 80)) <= got[f * 20 + k] for f in range(40) for k in (top, top + 1))


def test_swapped_blocks_of_one_stem_are_kept(spark):
    """Four blocks of 52 words with a stem of 40 in common; the other document has two of them in another order."""
    rng = random.Random(15)
    rows, fresh = [], lambda n: [f"v{rng.randint(0, 10**9)}" for _ in range(n)]
    for f in range(60):
        stem = fresh(40)
        blocks = [fresh(6) + stem + fresh(6) for _ in range(4)]
        for k, order in enumerate(((0, 1, 2, 3), (0, 2, 1, 3))):
            rows.append((2 * f + k, " ".join(w for x in order for w in [*fresh(15), *blocks[x]])))
    got = covered(substring.repeated_passages(frame(spark, rows)).collect())
    assert all(set(range(15 + 67 * x, 67 + 67 * x)) <= got[i] for i in range(120) for x in range(4))


def test_passages_at_the_threshold_are_recalled(spark):
    """94 words with two changed: 80 of 100 distinct tokens in common."""
    rng = random.Random(16)
    rows, fresh = [], lambda n: [f"v{rng.randint(0, 10**9)}" for _ in range(n)]
    for f in range(200):
        passage = fresh(94)
        near = list(passage)
        near[31], near[62] = fresh(2)
        rows += [(2 * f, " ".join(fresh(30) + passage + fresh(30))), (2 * f + 1, " ".join(fresh(12) + near + fresh(40)))]
    got = covered(substring.repeated_passages(frame(spark, rows)).collect())
    assert np.mean([len(got[2 * f] & set(range(30, 124))) >= 80 for f in range(200)]) > 0.97


def test_fewest_distinct_tokens():
    rng = np.random.default_rng(5)
    for _ in range(200):
        t = rng.integers(0, rng.integers(2, 60), rng.integers(1, 60))
        least, c = int(rng.integers(1, 30)), int(rng.integers(0, len(t)))
        if len(t) >= least:
            want = min(len(set(t[s : s + least].tolist())) for s in range(max(0, c - least + 1), min(c, len(t) - least) + 1))
            assert substring._fewest(t, c, least) == want
            # where nothing repeats near the place, the short way gives the same
            again, lo, hi = substring._again(t, 2 * least), max(c - least + 1, 0), min(c + least, len(t))
            if again[hi] == again[lo]:
                assert want == min(least, hi - lo) and len(set(t[lo:hi].tolist())) == hi - lo


def test_surroundings_that_may_hold_a_passage():
    """Every stretch of `least` tokens around a signature is held against all tokens of the other, one by one."""
    rng, least = np.random.default_rng(5), 20
    base = rng.permutation(1000)[:39].astype(np.uint32)
    near, at = [base], [19]
    for k in range(40):
        other = base.copy()
        some = rng.choice(39, int(rng.integers(0, 30)), replace=False) if k % 2 else np.arange(int(rng.integers(0, 19)))
        other[some] = 2000 + 50 * k + np.arange(len(some))
        near.append(other)
        at.append(19)
    near.append(np.sort(base[:25]))  # tokens that repeat: only what is in common counts
    at.append(-1)
    got = substring._alike(near, np.array(at), np.full(len(near), least), least, 0.8)
    for i in range(len(near)):
        for j in range(len(near)):
            dense = lambda x, y: at[x] < 0 or max(np.isin(near[x][s : s + least], near[y]).sum() for s in range(20)) >= 16
            want = i != j and len(np.intersect1d(near[i], near[j])) >= 16 and (dense(i, j) or dense(j, i))
            assert got[i, j] == want, (i, j)
    assert got.any() and not got.all()


def test_equal_surroundings_stand_for_one_another(spark):
    """Of holders with the same surroundings the smallest meets the rest, and each is tied to it; one passage in many texts leaves none out."""
    rng = np.random.default_rng(6)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    passage = word(120)
    rows = [(k, " ".join(word(30 + k) + passage + word(30))) for k in range(1, 40)] + [(100 + k, " ".join(word(150))) for k in range(5)]
    found = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == set(range(1, 40)) and {r.class_id for r in found} == {1}
    assert all(r.start_word <= 30 + r.doc_id and r.end_word >= 150 + r.doc_id for r in found)


def test_slots_are_the_plain_order(spark):
    """Shards are stretches of one order by text's CRC-32 and hashed id, and slots count along it."""
    rows = queries.op3_sharding(spark, SF1).withColumn("d", F.shiftrightunsigned(F.xxhash64("doc_id"), 12)).collect()
    plain = sorted(rows, key=lambda r: (r.text_crc32, r.d, r.doc_id))
    assert [r.shard for r in plain] == sorted(r.shard for r in rows)
    seen = Counter()
    for r in plain:
        assert r.slot == seen[r.shard]
        seen[r.shard] += 1



def test_pairs_are_verified_on_tokens_written_once(spark):
    rng = random.Random(31)
    line = [f"l{k}" for k in range(60)]
    words = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    rows = {1: sum((words(9) + line for _ in range(30)), []), 2: sum((words(4) + line for _ in range(20)), []), 3: words(200)}
    rows = {k: " ".join(w) for k, w in rows.items()}
    tokens = substring.tokenized(spark.createDataFrame(list(rows.items()), "id bigint, text string").selectExpr("id", "CAST(text AS BINARY) AS text"))
    held = {r.id: np.frombuffer(r.tokens, np.uint32) for r in tokens.collect()}
    assert {k: len(t) for k, t in held.items()} == {k: len(w.split()) - 4 for k, w in rows.items()}
    assert all((held[k] == substring.tokens_of(w.encode()) >> np.uint64(32)).all() for k, w in rows.items())
    places = lambda k, at: np.flatnonzero(held[k] == held[2][4 + at]).tolist()
    anchors = [(places(1, at), places(2, at)) for at in (5, 20, 50)]  # every place of a signature meets every other
    found = substring._verified(spark.createDataFrame([(1, 2, anchors), (3, 2, [([7], [9])])], "a bigint, b bigint, anchors array<struct<ca: array<int>, cb: array<int>>>"), tokens, 46, 0.8).collect()
    every = [(x, y) for ca, cb in anchors for x in ca for y in cb]
    assert sorted(tuple(r) for r in found) == sorted((1, 2, *x) for x in substring.similar_stretches(held[1], held[2], every, 46, 0.8))
    assert {r.a for r in found} == {1} and len(found) >= 20
    # what is crossed at once is what is crossed one by one, above and below the bound
    x, y = np.arange(9000), np.arange(5000)
    for nx, ny in (([9000], [5000]), ([3000, 6000], [4999, 1]), ([4500, 4500], [2, 4998])):
        got = substring._crossed(x, np.array(nx), y, np.array(ny), x % 500 == 0)
        a, b = np.split(x, nx[:1]) if len(nx) > 1 else [x], np.split(y, ny[:1]) if len(ny) > 1 else [y]
        want = np.concatenate([substring._met(p[p % 500 == 0], q) for p, q in zip(a, b)])
        assert np.array_equal(np.unique(got), np.unique(want))


def test_meetings_are_those_that_the_plain_test_allows():
    """Looked at many groups at a time, with the bound of two stretches of `least` tokens: nothing that a dense stretch of both shows is left out, and groups stay apart."""
    rng, least, reach = np.random.default_rng(8), 20, 25
    near, at, own = [], [], []
    for group in range(3):
        base = rng.permutation(1000)[: 2 * reach - 1].astype(np.uint32)  # groups may share tokens
        for k in range(25):
            other = base.copy()
            some = rng.choice(len(base), int(rng.integers(0, 24)), replace=False) if k % 2 else np.arange(int(rng.integers(0, 24)))
            other[some] = 2000 + 1000 * group + 40 * k + np.arange(len(some))
            near.append(other)
            at.append(reach - 1)
            own.append(group)
    at, own, need = np.array(at), np.array(own), np.full(len(near), least)
    around = substring._Around(own, near, at, need, least, reach, 0.8)
    i, j, _ = around.alike(around.possible(np.arange(len(near))))
    got, share = {(min(x), max(x)) for x in zip(i.tolist(), j.tolist())}, 1.6 / 1.8

    def dense(x, y):  # a stretch of any length from `least` on around the signature
        hit = np.append(0, np.cumsum(np.isin(near[x], near[y])))
        return any(hit[e] - hit[s] >= share * (e - s) - 1e-9 for s in range(reach) for e in range(max(reach, s + least), len(hit)))

    want = {(x, y) for x in range(len(near)) for y in range(x + 1, len(near)) if own[x] == own[y] and (dense(x, y) or dense(y, x))}
    assert got == want and got
    plain = substring._alike(near, at, need, least, 0.8)
    assert all(plain[x, y] for x, y in got)


def test_runs_of_one_word_do_not_hide_the_diagonal(spark):
    """Documents of runs of one word share 70 words at another place; the runs' signatures lie on diagonals beside that of the passage."""
    rng = random.Random(41)
    fresh = lambda: f"v{rng.randint(0, 10**9)}"
    for _ in range(30):
        run = fresh()
        passage = [run] * 12 + [fresh()] * 30 + [fresh()] * 28
        texts = [fresh()] * 40 + [run] * 4 + passage, [fresh()] * 60 + [run] * 18 + passage
        a, b = (substring.tokens_of(" ".join(x).encode()) for x in texts)
        places = np.intersect1d(a, b)
        anchors = [(x, y) for t in places for x in np.flatnonzero(a == t) for y in np.flatnonzero(b == t)]
        found = substring.similar_stretches(a, b, anchors, 46, 0.8)
        assert any(p <= 56 and q >= len(a) - 3 for p, q, *_ in found)
