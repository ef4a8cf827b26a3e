"""Merkle manifest, whitening and archive against plain Python and numpy, and their odd rows."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import merkle, queries, warc, whiten

SF, SF1 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf_of(row, fields):
    return h(*["-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in fields])


def levels_of(nodes, arity):
    """Root and, for each node, its siblings left and right of it at each level."""
    paths, own = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(s, min(s + arity, len(nodes))) for s in range(0, len(nodes), arity)]
        for r in runs:
            for k in r:
                for i in own[k]:
                    paths[i].append(("".join(nodes[j] for j in r if j < k), "".join(nodes[j] for j in r if j > k)))
        own = [[i for k in r for i in own[k]] for r in runs]
        nodes = [h(*[nodes[k] for k in r]) for r in runs]
    return nodes[0], paths


def brute_manifest(rows, arity=2, fields=("doc_id", "source", "lang", "n_chars", "text")):
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, fields), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs, leaf_paths = [], {}
    for g in order:
        found = sorted(groups[g], key=lambda x: x[:3])
        sub, paths = levels_of([x[2] for x in found], arity)
        subs.append(sub)
        leaf_paths[g] = [(x[3], x[2], p) for x, p in zip(found, paths)]
    root, tops = levels_of(subs, arity)
    out = []
    for g, sub, top in zip(order, subs, tops):
        for r, leaf, path in leaf_paths[g]:
            whole = path + top
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
            cur = leaf_of(r | {"n_chars": r["n_chars"] + 1}, fields) if hit else leaf
            for a, b in whole:
                cur = h(a, cur, b)
            out.append((r["doc_id"], leaf, sub, root, h(*[a + b for a, b in whole]), cur, cur == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sf", [SF, SF1])
def test_merkle_query_is_the_plain_tree(spark, sf):
    rows = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    got = queries.op11_merkle(spark, sf).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_manifest(rows)
    assert {r.verified for r in got} == {True, False}


def documents(spark, rows, extra=""):
    return spark.createDataFrame([(*r, *(["x"] * bool(extra))) for r in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string" + extra)


@pytest.mark.parametrize("arity, levels", [(2, 1), (2, 3), (3, 1), (3, 2), (2, 10)])
def test_blocks_of_any_size_give_one_tree(spark, arity, levels):
    """Null, repeated and lone rows, groups of every size around a block's, a null group, long text, clashing columns."""
    rng = random.Random(3)
    rows = [(i, "s", g, i, f"text {i}") for g, n in (("a", 17), ("b", 1), ("c", 8), ("é", 9), ("z", 2)) for i in rng.sample(range(1000), n)]
    rows += [(None, None, None, None, None)] * 3 + [(5, "s", None, None, ""), (7, "s", "a", 2**63 - 1, "x" * 300_000), (7, "s", "a", 3, "y"), (7, "s", "a", 3, "y")]
    names = ("doc_id", "source", "lang", "n_chars", "text")
    df = documents(spark, rows, ", digest string")
    crc = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    plus = F.when(crc, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)")).cast("string")
    found = merkle.verified_against(merkle.manifest(df, "doc_id", "lang", list(names), {"n_chars": plus}, arity, levels))
    got = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("p"), "folded_root", "verified").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_manifest([dict(zip(names, r)) for r in rows], arity)


def test_merkle_of_nothing_and_of_one(spark):
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    assert merkle.manifest(documents(spark, []), "doc_id", "lang", names).count() == 0
    [r] = merkle.verified_against(merkle.manifest(documents(spark, [(1, "s", "en", 2, "t")]), "doc_id", "lang", names)).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.verified and r.path == []


def brute_whiten(vectors, k=16):
    x = np.array([np.floor(64 * np.asarray(v, np.float64)) for v in vectors]).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    values, vecs = np.linalg.eigh(c.T @ c / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    white = (x - s / n) @ vecs[:, :k] / np.sqrt(values[:k])
    dev = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return n, dev, white, values[:k] / np.trace(c.T @ c / n)


def test_whitening_query_is_numpy(spark):
    rows = pq.read_table(f"{SF1}/embeddings.parquet").to_pylist()
    n, dev, white, explained = brute_whiten([r["embedding"] for r in rows])
    place = {r["vec_id"]: i for i, r in enumerate(rows)}
    got = queries.op12_whitening(spark, SF1).collect()
    assert len(got) == 16 * len(rows) and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert 0 <= got[0].identity_error < 1e-9
    mine = np.zeros((len(rows), 16))
    for r in got:
        mine[place[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == dev[place[r.vec_id]] and abs(r.explained / explained[r.component - 1] - 1) < 1e-9
    signs = np.sign((mine * white).sum(0))
    assert np.abs(mine - white * signs).max() < 1e-7


def test_chan_merging_is_one_pass(spark):
    rng = np.random.default_rng(5)
    data = rng.integers(-500, 500, (1000, 7)) + np.array([0, 10**9, 0, -(10**9), 3, 4, 5])
    whole = whiten.State.of(data)
    parts = [whiten.State.of(p) for p in np.array_split(data, [1, 17, 400, 401])]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.merged(p)
    assert merged.n == 1000 and merged.sums == whole.sums == data.sum(0).tolist()
    exact = np.cov(data.T - data[0][:, None], bias=True) * 1000
    assert np.abs(merged.scatter - exact).max() < 1e-6 * np.abs(exact).max()


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (None, [3.0, 1.0]), (7, [0.0, 5.0]), (7, [0.0, 5.0]),
            (8, [-2.0, 1.0]), (9, [1e300, -1e300]), (10, [1.0]), (11, [1.0])]
    df = spark.createDataFrame([(*r, 9.0, 1) for r in rows], "vec_id bigint, embedding array<double>, vec double, component int")
    got = whiten.whiten(df).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in got) == sorted(
        [(False, i, c) for i in (1, 7, 7, 8, 9) for c in (1, 2)] + [(True, 0, 1), (True, 0, 2)] + [(False, 10, 1), (False, 11, 1)])
    assert all(r.n == 5 for r in got if r.vec_id not in (10, 11)) and all((r.n, r.whitened, r.explained, r.identity_error) == (1, None, None, None) for r in got if r.vec_id in (10, 11))
    assert all((r.deviation is None) == (r.vec_id not in (10, 11)) or r.deviation >= 0 for r in got)
    flat = spark.createDataFrame([(i, [float(i), float(i), 1.0]) for i in range(5)], "vec_id bigint, embedding array<float>")
    one = whiten.whiten(flat).collect()
    assert len(one) == 15 and {r.component for r in one if r.whitened is not None} == {1} and all(r.identity_error < 1e-12 for r in one)
    assert whiten.whiten(flat.limit(0)).count() == 0
    huge = spark.createDataFrame([(i, [float(i % 3) * 2**30, 1.0 * (i % 2)]) for i in range(6)], "vec_id bigint, embedding array<double>")
    x = [[(i % 3) * 2**36, 64 * (i % 2)] for i in range(6)]
    s = [sum(c) for c in zip(*x)]
    want = [sum((6 * a - b) ** 2 for a, b in zip(v, s)) for v in x]
    assert {r.vec_id: r.deviation for r in whiten.whiten(huge).collect()} == {i: w if w < 2**63 else None for i, w in enumerate(want)}


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, digest string, header string")


ODD = [(3, "u3", "same"), (1, "u1", "same"), (2, None, None), (9, "u9", ""), (None, "n", "same"), (None, "n", "lone"), (None, "m", "lone"), (4, "a\r\nWARC-Type: fake\nb", "é" * 5),
       (5, "five", "r\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n"), (5, "five", "r\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n"), (6, "long", "z" * 400_000)]


@pytest.mark.parametrize("shelf", [1, 2, 4096])
def test_archive_restores_records(spark, tmp_path, monkeypatch, shelf):
    monkeypatch.setattr(warc, "SHELF", shelf)
    root = str(tmp_path / "a")
    warc.write_archive(pages(spark, ODD), root)
    records, payloads = warc.read_archive(spark, root)
    assert payloads.count() == len({r[2] or "" for r in ODD}) and records.count() == len(ODD)
    got = warc.described(warc.restore(spark, root)).collect()
    want = []
    for text in {r[2] or "" for r in ODD}:
        ids = sorted([r[0] for r in ODD if (r[2] or "") == text], key=lambda i: (i is None, i))
        raw = text.encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want += [(ids[0], len(raw), digest, "response", None)] + [(i, len(raw), digest, "revisit", ids[0]) for i in ids[1:]]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def parsed(raw):
    """The records of a WARC file by Content-Length: (fields, block)."""
    out = []
    while raw:
        head, rest = raw.split(b"\r\n\r\n", 1)
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        out.append((fields, rest[:n]))
        raw = rest[n + 4 :]
    return out


def test_exported_files_are_warc(spark, tmp_path):
    root = str(tmp_path / "a")
    warc.write_archive(pages(spark, ODD), root)
    warc.export_warc(spark, root, str(tmp_path / "w"))
    found = [r for f in sorted((tmp_path / "w").glob("part-*")) for r in parsed(f.read_bytes())]
    assert len(found) == len(ODD) and len({f["WARC-Record-ID"] for f, _ in found}) == len(ODD)
    ids = {f["WARC-Record-ID"]: f for f, _ in found}
    for f, block in found:
        http, payload = block.split(b"\r\n\r\n", 1)
        if f["WARC-Type"] == "revisit":
            assert payload == b"" and ids[f["WARC-Refers-To"]]["WARC-Payload-Digest"] == f["WARC-Payload-Digest"] and ids[f["WARC-Refers-To"]]["WARC-Type"] == "response"
        else:
            assert f["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode() and http.endswith(str(len(payload)).encode())
    whole = warc.restore(spark, root).select(warc.record_bytes(F.col("header"), F.col("payload")).alias("r")).collect()
    assert sorted(b"".join(bytes(r.r) for r in whole)) == sorted(b"".join(f.read_bytes() for f in (tmp_path / "w").glob("part-*")))


def test_a_wrong_payload_is_found(spark, tmp_path):
    root = str(tmp_path / "a")
    warc.write_archive(pages(spark, ODD[:3]), root)
    _, payloads = warc.read_archive(spark, root)
    bad = payloads.withColumn("payload", F.concat("payload", F.lit(b"!")))
    bad.write.parquet(str(tmp_path / "b/payloads"))
    warc.read_archive(spark, root)[0].write.parquet(str(tmp_path / "b/records"))
    with pytest.raises(Exception, match="differs from its address"):
        warc.restore(spark, str(tmp_path / "b")).collect()
    payloads.limit(1).write.parquet(str(tmp_path / "c/payloads"))
    warc.read_archive(spark, root)[0].write.parquet(str(tmp_path / "c/records"))
    with pytest.raises(Exception, match="without its payload"):
        warc.restore(spark, str(tmp_path / "c")).collect()


def test_archive_minimum_and_empty(spark, tmp_path):
    got = warc.described(warc.archived(pages(spark, ODD), min_bytes=5)).collect()
    assert all(r.record_type == "response" and r.refers_to is None for r in got if r.payload_bytes < 5)
    assert sum(r.record_type == "revisit" for r in got) == 1
    assert warc.archived(pages(spark, [])).count() == 0
