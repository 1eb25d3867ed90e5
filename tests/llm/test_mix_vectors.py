"""The source mix, centroid clusters and whitening against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from faultline.llm import centroid_clusters as cc
from faultline.llm import source_mix as sm
from faultline.llm import whitening as wh

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, source string, slot string, rank string, start string, n bigint, h bigint, need int, cell int, _p int"


def corpus(seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        source = rng.choice(["b", "b", "b", "b", "a", "c", "", "Zé", "\U00010000", "￿", None])
        text = rng.choice([None, "", " \n "]) if rng.random() < 0.1 else " ".join("w" for _ in range(rng.choice([1, 2, 3, 40, 90])))
        rows.append((rng.choice([None, i]) if rng.random() < 0.1 else i, text, source))
    rows += [(7, "same row again", "b")] * 40 + [(None, "no id", "b")] * 5 + [(900, None, "empty")] + [(901, "x " * 5000, "a")] + [(902, "one", "tiny")]
    return [(*r, "s", "r", "t", 1, 2, 3, 4, 5) for r in rows]


def goals(sizes):
    """Targets by the rule as it is stated: share, cut at three times, share the excess again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in full]
        rest, w = total - sum(full.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / w > 3 * sizes[s]]
        if not over:
            return {s: full[s] if s in full else rest * weight[s] / w for s in order}, order
        full.update({s: 3 * sizes[s] for s in over})


def test_mix_takes_its_targets_and_each_document_as_stated(spark):
    rows = corpus()
    mix = sm.source_mix(spark.createDataFrame(rows, DOCS))
    got = [tuple(r) for r in sm.taken_words(mix).select("doc_id", "size", "source_size", "target", "taken").collect()]
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, text, source, *_ in rows:
        sizes[source] += len(WORD.findall(text or ""))
    targets, _ = goals(sizes)
    expected = []
    for source in sizes:
        mine = [(hashlib.sha256(f"mix:{'' if i is None else i}".encode()).hexdigest()[:15], i if i is not None else -1, len(WORD.findall(t or ""))) for i, t, s, *_ in rows if s == source]
        at, need, whole = 0, math.floor(targets[source] + 1e-9), sizes[source]
        for _, i, size in sorted(mine):
            taken = sum(max(0, min(c * whole + at + size, need) - (c * whole + at)) for c in range(4)) if size else 0
            assert taken <= 3 * size
            expected.append((None if i == -1 else i, size, whole, round(targets[source], 6), taken))
            at += size
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(((a, b, c, round(d, 6), e) for a, b, c, d, e in got), key=key) == sorted(expected, key=key)


def test_mix_schedule_against_listed_points(spark, monkeypatch):
    monkeypatch.setattr(sm, "BLOCK", 3)
    docs = spark.createDataFrame(corpus(), DOCS)
    sources = sm.targets(sm.sized(docs))
    known = sources.orderBy("source_no").collect()
    n = sum(r["slots"] for r in known)
    seen, expected = collections.Counter(), []
    for k in range(n):
        x = int(f"{k:032b}"[::-1], 2)
        s = next(r for r in known if r["lo"] <= x < r["hi"])
        if seen[s["source_no"]] < s["slots"]:
            expected.append((k, s["source_no"], seen[s["source_no"]]))
        seen[s["source_no"]] += 1
        share = s["slots"] / n
        assert abs(seen[s["source_no"]] - share * (k + 1)) < 2 + math.log2(k + 2)  # low discrepancy, at each slot
    for r in known:
        for rank in range(min(seen[r["source_no"]], r["slots"]), r["slots"]):
            expected.append((len(expected) and n + sum(e[0] >= n for e in expected), r["source_no"], rank))
    assert sorted(map(tuple, sm.schedule(sources).collect())) == sorted(expected)
    pieces = sm.source_mix(docs).where("slot is not null").orderBy("slot", "at").collect()
    places = collections.defaultdict(list)
    for p in pieces:
        places[p["slot"]].append((p["at"], p["length"], p["source_no"]))
        assert 0 <= p["word"] and p["word"] + p["length"] <= p["size"]
    for slot, held in places.items():  # blocks are gapless, of one source, and full but for a source's last
        assert [a for a, _, _ in held] == [sum(x[1] for x in held[:i]) for i in range(len(held))] and len({s for *_, s in held}) == 1
    short = [slot for slot, held in places.items() if sum(x[1] for x in held) < 3]
    assert len(short) <= len(known) and len(places) == n


def test_mix_ranks_beyond_a_period_and_bits(spark):
    for k, lo, hi in ((0, 0, 1 << 32), (1, 0, 1), (12345, 77, 1 << 31), (1 << 16, 5, 900_000_000), ((3 << 32) + 9, 10, 1 << 30), (2**32, 1, 4)):
        low = min(k & 0xFFFFFFFF, 1 << 17)
        here = (k >> 32 << 32) + low
        count = sum(lo <= int(f"{i:032b}"[::-1], 2) < hi for i in range(low)) + (k >> 32) * (hi - lo)
        row = spark.createDataFrame([(here, lo, hi)], "k long, lo long, hi long")
        assert row.selectExpr(sm._RANK.format(k="k")).first()[0] == count
    rows = spark.createDataFrame([(x,) for x in (0, 1, 2, 0xFFFFFFFF, 0x80000000, (5 << 32) + 6)], "k long")
    assert [r[0] for r in rows.select(sm.reversed_bits(rows.k)).collect()] == [int(f"{x & 0xFFFFFFFF:032b}"[::-1], 2) for x in (0, 1, 2, 0xFFFFFFFF, 0x80000000, (5 << 32) + 6)]


def test_mix_with_many_sources_and_without_rows(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(), DOCS)
    few = sorted(map(str, sm.taken_words(sm.source_mix(docs)).collect()))
    monkeypatch.setattr(sm, "SOURCES", 0)
    assert sorted(map(str, sm.taken_words(sm.source_mix(docs.repartition(7))).collect())) == few
    empty = sm.source_mix(spark.createDataFrame([], DOCS))
    assert empty.count() == 0 and sm.taken_words(empty).count() == 0
    blank = sm.taken_words(sm.source_mix(spark.createDataFrame([(1, None, None)] * 3, "doc_id long, text string, source string")))
    assert [tuple(r) for r in blank.collect()] == [(1, 0, 0, 0.0, 0)] * 3


# --- centroids ---

VECTORS = "vec_id bigint, embedding array<float>, q string, cluster string, distance string"


def vectors(rng, n, dims=64, spread=1.0):
    rows = [(i, [float(np.float32(rng.gauss(0, spread))) for _ in range(dims)]) for i in range(n)]
    rows += [rows[3], rows[3], (5000, rows[3][1]), (5001, None), (5002, []), (5003, [1.0] * (dims - 1)), (5004, [None] + [1.0] * (dims - 1))]
    rows += [(5005, [float("nan")] + [1.0] * (dims - 1)), (5006, [float("inf")] * dims), (None, [0.25] * dims), (5007, [0.0] * dims), (5008, [-0.0] * dims)]
    return [(*r, "q", "c", "d") for r in rows]


def lloyd(rows, k, rounds, dims, scale=64, seed=1):
    """The rule in plain integers."""
    kept = []
    for i, v, *_ in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * x) for x in v]))
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest()))[:k]
    centres = [q for _, q in first]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        members = collections.defaultdict(list)
        for _, q in kept:
            members[near(q)[1]].append(q)
        centres = [[sum(x) // len(members[j]) for x in zip(*members[j])] if members[j] else c for j, c in enumerate(centres)]
    return [(i, near(q)[1], near(q)[0]) for i, q in kept], centres


def by_text(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("spread", [0.1, 0.004, 300.0])
def test_clusters_against_plain_integers(spark, spread):
    rows = vectors(random.Random(2), 90, spread=spread)
    clusters, centres = cc.centroid_clusters(spark.createDataFrame(rows, VECTORS), k=8)
    expected, expected_centres = lloyd(rows, 8, 3, 64)
    assert centres.tolist() == expected_centres and by_text(tuple(r) for r in clusters.collect()) == by_text(expected)
    out = cc.digest(clusters, centres).collect()
    assert {r["inertia"] for r in out} == {sum(d for *_, d in expected)}
    for r in out:
        assert r["cluster_inertia"] == sum(d for _, c, d in expected if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, expected_centres[r["cluster"]])).encode()).hexdigest()


def test_screening_decides_ties_and_near_ties_exactly():
    rng = np.random.default_rng(4)
    for size in (3, 1 << 10, 1 << 20, cc.LARGEST):
        centres = rng.integers(-size, size + 1, (12, 64))
        centres[5] = centres[2]  # a tie for all
        centres[7] = centres[2] + (np.arange(64) == 9)  # one unit away
        q = np.vstack([rng.integers(-size, size + 1, (300, 64)), centres, (centres[:6] + centres[6:]) // 2])
        best, unsure = cc.nearest(q, centres)
        exact = ((q[:, None, :] - centres[None, :, :]).astype(object) ** 2).sum(axis=2)
        assert best.tolist() == [min(range(12), key=lambda j: (row[j], j)) for row in exact] and unsure > 0
    # float32 alone would choose wrongly among these
    centres = np.full((16, 64), cc.LARGEST - 20)
    centres[:, 0] += np.arange(16)[::-1]
    q = np.full((16, 64), cc.LARGEST - 20)
    q[:, 0] += np.arange(16)
    assert cc.nearest(q, centres)[0].tolist() == list(range(15, -1, -1))


def test_clusters_of_few_or_no_vectors(spark):
    empty = cc.digest(*cc.centroid_clusters(spark.createDataFrame([], VECTORS)))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    rows = [(1, [0.5] * 64, "", "", ""), (1, [0.5] * 64, "", "", ""), (2, [1e30] * 64, "", "", "")]
    clusters, centres = cc.centroid_clusters(spark.createDataFrame(rows, VECTORS))
    assert [tuple(r) for r in clusters.collect()] == [(1, 0, 0)] * 2 and centres.tolist() == [[32] * 64] * 2
    doubles = spark.createDataFrame([(1, ["0.5"] * 64)], "vec_id int, embedding array<string>")
    assert [tuple(r) for r in cc.centroid_clusters(doubles)[0].collect()] == [(1, 0, 0)]


# --- whitening ---


def white(rows, dims, k=4):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    fit = np.array(sorted({tuple(q) for _, q in kept}), dtype=float)
    mean = fit.mean(axis=0)
    e, u = np.linalg.eigh((fit - mean).T @ (fit - mean) / len(fit))
    e, u = e[::-1], u[:, ::-1]
    sums, n = [int(x) for x in fit.sum(axis=0)], len(fit)
    return [(i, c + 1, n, sum((n * a - b) ** 2 for a, b in zip(q, sums)), abs(float((np.array(q) - mean) @ u[:, c] / math.sqrt(e[c]))), float(e[c] / e.sum())) for i, q in kept for c in range(k)]


@pytest.mark.parametrize("fan", [2, 16])
def test_whitening_against_the_covariance(spark, monkeypatch, fan):
    monkeypatch.setattr(wh, "FAN", fan)
    rows = vectors(random.Random(9), 400, dims=12)
    scales = np.linspace(3, 0.2, 12)
    rows = [(i, [None if x is None else float(np.float32(x * s)) for x, s in zip(v, scales)] if v and len(v) == 12 else v, *rest) for i, v, *rest in rows]
    out, fit = wh.whitening(spark.createDataFrame(rows, VECTORS).repartition(9))
    got, expected = out.collect(), white(rows, 12)
    assert len(got) == len(expected) and {r["n"] for r in got} == {expected[0][2]} and max(r["identity_error"] for r in got) < 1e-9
    key = lambda r: (r[0] is None, r[0], r[1], r[3])
    for a, b in zip(sorted((tuple(r) for r in got), key=key), sorted(expected, key=key)):
        assert a[:4] == b[:4] and abs(abs(a[4]) - b[4]) < 1e-8 and abs(a[5] - b[5]) < 1e-10
    assert len(fit.s) == 12  # all dimensions are kept
    signs = {(r["vec_id"], r["component"]): r["whitened"] for r in got if r["vec_id"] in (3, 5000)}
    assert all(signs[3, c] == signs[5000, c] for c in range(1, 5))


def test_fit_over_a_tree_of_partitions(spark, monkeypatch):
    monkeypatch.setattr(wh, "FAN", 2)
    rng = np.random.default_rng(8)
    x = rng.integers(-300, 300, (500, 7))
    rows = spark.createDataFrame([(bytearray(b),) for b in wh.packed(x)], "x binary").repartition(11)
    fit = wh.fitted(rows, 7)
    assert fit.n == 500 and fit.sums == x.sum(axis=0).tolist()
    assert np.allclose(fit.s, np.linalg.svd(x - x.mean(axis=0), compute_uv=False), rtol=1e-12) and np.allclose(fit.vt @ fit.vt.T, np.eye(7), atol=1e-12)
    assert wh.fitted(rows.limit(0), 7) is None


def test_merging_is_that_of_all_rows():
    rng = np.random.default_rng(3)
    x = rng.integers(-5000, 5000, (700, 9)) + 10**9
    cuts = [0, 1, 2, 40, 300, 301, 700]
    merged = wh.merged([wh.leaf(x[a:b]) for a, b in zip(cuts, cuts[1:])])
    whole = wh.leaf(x)
    exact = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    assert merged.n == 700 and merged.sums == [int(v) for v in x.sum(axis=0)] and np.allclose(merged.s, exact, rtol=1e-12) and np.allclose(whole.s, exact, rtol=1e-12)
    wide = np.array([[1, -1], [127, -128], [128, 0], [40000, 2], [1 << 40, -(1 << 40)], [0, 0]])
    assert wh.unpacked(wh.packed(wide), 2).tolist() == wide.tolist() and [len(r) for r in wh.packed(wide)] == [2, 2, 4, 8, 16, 2]


def test_whitening_of_constant_few_or_no_vectors(spark):
    assert wh.whitening(spark.createDataFrame([], VECTORS))[0].count() == 0
    rows = [(i, [0.5] * 6, "", "", "") for i in range(3)]
    out = wh.whitening(spark.createDataFrame(rows, VECTORS))[0].collect()
    assert len(out) == 12 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in out} == {(1, 0, 0.0, 0.0, 0.0)}
    two = wh.whitening(spark.createDataFrame(rows + [(9, [1.5] * 6, "", "", "")], VECTORS))[0].collect()
    assert sorted((r["vec_id"], abs(round(r["whitened"], 9))) for r in two if r["component"] == 1) == [(0, 1.0), (1, 1.0), (2, 1.0), (9, 1.0)]
    assert {r["whitened"] for r in two if r["component"] > 1} == {0.0} and max(r["identity_error"] for r in two) < 1e-9
    narrow = wh.whitening(spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.4, 0.1]), (3, [1e30, 0.0]), (4, [])], "vec_id long, embedding array<double>"))[0]
    assert sorted((r["vec_id"], r["component"]) for r in narrow.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]
