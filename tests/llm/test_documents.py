"""Operators on documents against brute-force versions, with nulls, empties, repeats, ties and clashing columns."""

import collections
import hashlib
import math
import random
import re
import statistics
import zlib

import numpy as np
import pytest
import zstandard

from faultline.llm import compression_bands as cb
from faultline.llm import hilbert_shards as hs
from faultline.llm import ordinal_quality as oq
from faultline.llm import packing, pii, tokens, training_order
from faultline.llm.components import components
from faultline.llm.ngram_join import SKETCH_BITS, ngram_join, segment_keys, size_classes
from faultline.llm.token_rollup import WORDS, Rollup, counted, signed, token_rollup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, slot string, key string, prefix string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" + rng.choice(["", "", ",", ".\n"]) for _ in range(n))


def sample(seed=3):
    """Texts with every hard case: null, empty, blank, one word, repeated rows, near copies, long ones."""
    rng = random.Random(seed)
    texts = [None, "", " \n\t ", "word", "a b", "a b c", "Résumé ½ x y   z", "x" * 9000, prose(rng, 9000, 50), "<|endoftext|> </s> [INST]"]
    for _ in range(12):
        base = prose(rng, rng.randint(30, 200)).split(" ")
        texts.append(" ".join(base))
        for edits in (0, 1, 3, 8):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts.append("UPPER " + texts[10])
    return [(i, t, rng.choice(["en", "fr", None]), f"s{rng.randrange(4)}", None if t is None else len(t), 1, "x", "k", "p") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_compression_counts(docs, none):
    want = {}
    for row in sample():
        t = row[1] or ""
        w = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        want[row[0]] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))
    rows = cb.compression_bands(docs).collect()
    assert {r.doc_id: tuple(r)[1:7] for r in rows} == want
    assert not any(r.kept and r.base_failed for r in rows) and cb.compression_bands(none).count() == 0


def _usual(rng, words):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(words))


def test_compression_bands_reject_both_sides(spark):
    """Bands fitted to ordinary texts reject repetitive and incompressible ones that pass the base rule, whole or in part, and nothing else; one large group of copies moves no band."""
    rng = random.Random(1)
    usual = {i: _usual(rng, rng.randint(60, 1500)) for i in range(3000)}
    usual |= {i: usual[7] for i in range(3000, 4400)}
    stock = [f"{w * 4} {w * 5}" for w in _usual(rng, 12).split()]  # pairs, so few windows of three words repeat
    copied = " ".join(f"{rng.choice(stock)} {_usual(rng, 1)}" for _ in range(150))
    noise = " ".join("".join(chr(rng.randrange(33, 127)) for _ in range(9)) for _ in range(300))
    half = _usual(rng, 900)[:4096] + " ".join("".join(chr(rng.randrange(33, 127)) for _ in range(9)) for _ in range(450))[:4096]
    planted = {9000: copied, 9001: noise, 9002: half, 9003: None, 9004: ""}
    rows = [(i, t) for i, t in (usual | planted).items()]
    measures = cb.measured(spark.createDataFrame(rows, "doc_id long, text string"))
    limits = cb.bands(measures)
    got = {r.doc_id: r for r in cb.judged(measures, limits).collect()}
    assert {i for i in got if i < 9000 and not got[i].kept} == set()
    assert not any(got[i].base_failed for i in (9000, 9001, 9002)) and not any(got[i].kept for i in planted)
    assert got[9000].ratio > got[9000].high and got[9001].ratio < got[9001].low and got[9002].n_bad_chunks >= 1

    # brute force, by plain Python
    press, by = zstandard.ZstdCompressor(level=cb.LEVEL), collections.defaultdict(collections.Counter)

    def kind(n):
        return math.floor(math.log(n) / math.log(2) * cb.CLASSES)

    for t in {t for i, t in rows if t and not got[i].base_failed}:
        b = t.encode()
        by[kind(len(b))][round(math.log(len(b) / len(press.compress(b))) * cb.BINS)] += 1
    middles = {}
    for c, n in by.items():
        x = sorted(math.exp(b / cb.BINS) for b in n.elements())
        if len(x) >= cb.CLASS_TEXTS:
            m = x[(len(x) - 1) // 2]
            middles[c] = m, sorted(abs(v - m) for v in x)[(len(x) - 1) // 2]
    assert set(middles) == set(limits) and len(limits) > 5
    for c, (low, high) in limits.items():
        near = [middles[d] for d in range(c - cb.NEIGHBOURS, c + cb.NEIGHBOURS + 1) if d in middles]
        m, w = (statistics.median(x) for x in zip(*near))
        wide = cb.WIDTH * 1.4826 * w
        assert low == pytest.approx(m - max(wide, cb.LEAST_BELOW * m)) and high == pytest.approx(m + max(wide, cb.LEAST_ABOVE * m))
    for i, t in rows:
        b = (t or "").encode()
        if got[i].base_failed:
            assert not got[i].kept
            continue

        def inside(x):
            low, high = limits.get(kind(len(x)), cb.WIDE)
            return low <= len(x) / len(press.compress(x)) <= high

        chunks = [x for x in (b[k : k + cb.CHUNK] for k in range(0, len(b), cb.CHUNK)) if len(x) >= cb.MIN_CHUNK]
        wrong = sum(not inside(x) for x in chunks)
        assert (got[i].n_chunks, got[i].n_bad_chunks) == (len(chunks), wrong)
        assert got[i].kept == (inside(b) and wrong <= cb.CHUNK_SHARE * len(chunks))


def test_compression_of_small_tables(spark):
    """Without enough texts of a length the wide band holds."""
    rng = random.Random(1)
    texts = [(1, _usual(rng, 600)), (2, "line of much the same text\n" * 300), (3, None)]
    got = {r.doc_id: r for r in cb.compression_bands(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1].kept and (got[1].low, got[1].high) == cb.WIDE and not got[2].kept and not got[3].kept and got[3].ratio is None


def reference_join(rows, k, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent, links = {i: i for i in sets}, collections.Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), links[i]) for i in ids}


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_ngram_join(docs, k, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join(docs, k, percent).collect()}
    assert got == reference_join([(r[0], r[1]) for r in sample()], k, percent)


def test_ngram_join_large_group_and_odd_rows(spark, none):
    rng = random.Random(8)
    base = prose(rng, 80).split(" ")
    rows = []
    for i in range(250):  # several blocks, similarities around the threshold
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(80)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == reference_join(rows, 4, 85)
    odd = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (3, "x y z u v")], "doc_id bigint, text string")
    out = collections.Counter((r.doc_id, r.component_id) for r in ngram_join(odd).collect())
    assert out == {(None, None): 1, (7, 7): 2, (3, 3): 1}
    assert ngram_join(none).count() == 0


def test_linked_sets_share_a_key():
    rng, counts = np.random.default_rng(1), np.random.default_rng(2).integers(0, 5000, 1 << SKETCH_BITS)
    first = size_classes(85)
    assert all(first[i + 1] * 85 <= 100 * first[i] + 84 + 85 for i in range(60))
    for _ in range(400):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * 2)
        drop = int(rng.integers(0, n // 8 + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[: len(a) - drop], rng.integers(0, 2**63, int(rng.integers(0, n // 8 + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= 85 * (len(a) + len(b) - both):
            assert len(np.intersect1d(segment_keys(a, counts, 85, 2000)[0], segment_keys(b, counts, 85, 2000)[0]))


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(1, 200)] + [(3, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges + [(None, 1)], "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in list(parent)}


def test_hilbert_neighbours_and_shards(docs, none):
    side = 8
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    order = hs.hilbert_index(cells, 3)
    assert sorted(order) == list(range(side**3))
    walk = cells[np.argsort(order)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
    rows = hs.hilbert_shards(docs, shards=7).collect()
    by = collections.defaultdict(list)
    texts = {r[0]: r[1] for r in sample()}
    for r in rows:
        by[r.shard].append(r.slot)
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "rows", None)
    assert len(rows) == len(texts) and set(by) == set(range(7)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert hs.hilbert_shards(none).count() == 0


def test_encoder_equals_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole, encode, rng = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER)), tokens.encoder(), random.Random(3)
    pool = "abcdeéèßñ AB'sΣς½²12-_.,<|>\x00\x1c\t\n\x85  中😀İ"
    texts = ["", "<|endoftext|> x <|startoftext|>", "it's 'S we'll I've", "a" * 200] + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += [" ".join("".join(rng.choice("etaoinshrdlué") for _ in range(rng.randint(1, 14))) for _ in range(20)) for _ in range(300)]
    for t, want in zip(texts, whole.encode_batch(texts, add_special_tokens=False)):
        assert encode(t) == np.array(want.ids, "<u4").tobytes()


def test_packing(docs, none):
    encode, texts = tokens.encoder(), {r[0]: r[1] for r in sample()}
    rows = packing.best_fit_packing(docs).collect()
    ids = {i: encode(t or "") + np.array([1], "<u4").tobytes() for i, t in texts.items()}
    seen = collections.Counter()
    for r in rows:
        part = ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]
        assert r.start == r.piece * 4096 and len(part) == 4 * r.length and zlib.crc32(part) == r.ids_crc32
        seen[r.doc_id] += r.length
    assert seen == {i: len(x) // 4 for i, x in ids.items()}
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(seen.values()) // 4096) + 1
    assert packing.best_fit_packing(none).count() == 0


def test_genetic_search_beats_best_fit():
    rng, capacity, ours, plain = np.random.default_rng(4), 1000, 0, 0
    for k in range(20):
        size = []
        for _ in range(8):  # triples that fill a bin exactly, on which best-fit decreasing isn't optimal
            a, b = int(rng.integers(260, 400)), int(rng.integers(260, 350))
            size += [a, b, capacity - a - b]
        start = packing.best_fit(([], []), range(len(size)), size, capacity)
        (bins, fills), generations, crossovers = packing.evolve(size, [], capacity, k, 40)
        assert sorted(i for b in bins for i in b) == list(range(len(size))) and fills == [sum(size[i] for i in b) for b in bins] and max(fills) <= capacity
        assert len(bins) <= len(start[0]) and generations > 0 and crossovers > 0
        ours, plain = ours + len(bins), plain + len(start[0])
    assert ours < plain
    a, b = packing.best_fit(([], []), range(24), size, capacity), packing.placed(([], []), range(24), size, capacity)
    child = packing.crossover(a, b, size, capacity, rng)
    assert sorted(i for x in child[0] for i in x) == list(range(24)) and sum(x in child[0] for x in b[0]) >= int(len(b[0]) * packing.INJECTED)


def test_many_blocks_are_pooled(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 50)
    rng = random.Random(2)
    items = spark.createDataFrame([(f"k{i}", rng.randint(1, 4096)) for i in range(400)], "key string, length bigint")
    rows = packing.pack(items).join(items, "key").collect()
    assert sum(r.generations > 0 and r.crossovers > 0 for r in rows) > 300
    fill = collections.Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert len(rows) == 400 and max(fill.values()) <= 4096 and len(fill) <= 1.06 * sum(fill.values()) / 4096 + 1


def test_training_order(docs, none, spark, tmp_path):
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        s = training_order.slots(np.arange(n), n)
        assert sorted(s) == list(range(n)) and (training_order.slots(s, n, inverse=True) == np.arange(n)).all()
    assert (training_order.slots(np.arange(1000), 1000, 1) != training_order.slots(np.arange(1000), 1000, 2)).any()
    encode, folder, width = tokens.encoder(), str(tmp_path / "o"), training_order.RECORD_BYTES
    n = training_order.materialise(docs, folder, shard_size=16)
    rows = {r.slot: r for r in training_order.read_index(spark, folder).collect()}
    assert sorted(rows) == list(range(n))
    whole = list(training_order.read_records(spark, folder, 0, n + 5, shard_size=16))
    assert len(whole) == n and {len(x) for x in whole} == {1024}
    files = {int(p.parent.name[6:]): p for p in (tmp_path / "o/records").glob("shard=*/part-*")}
    assert sorted(files) == list(range(-(-n // 16))) and sum(p.stat().st_size for p in files.values()) == n * width
    for slot in (0, 5, 16, 21, n - 1):  # a plain reader finds a record by its place
        with files[slot // 16].open("rb") as f:
            f.seek(slot % 16 * width)
            assert f.read(1024) == whole[slot]
    assert list(training_order.read_records(spark, folder, 21, 30, shard_size=16)) == whole[21:51] and not list(training_order.read_records(spark, folder, n, 3, shard_size=16))
    assert {r.slot: bytes(r.record) for r in training_order.read_shards(spark, folder, shard_size=16).collect()} == dict(enumerate(whole))
    got = collections.defaultdict(bytes)
    for r in sorted(rows.values(), key=lambda r: r.number):
        assert r.shard == r.slot // 16 and r.slot == training_order.slots(np.array([r.number]), n)[0] and r.starts[0] == 0 and not any(whole[r.slot][2 * r.length :])
        for doc, a, b in zip(r.doc_ids, r.starts, [*r.starts[1:], r.length]):
            got[doc] += whole[r.slot][2 * a : 2 * b]
    assert got == {r[0]: np.append(np.frombuffer(encode(r[1] or ""), "<u4"), 1).astype("<u2").tobytes() for r in sample()}
    assert sum(r.length < 512 for r in rows.values()) <= docs.rdd.getNumPartitions()
    out = training_order.training_order(docs)
    assert out.count() == n and out.where("record_bytes <> 1024 or place <> slot").count() == 0
    assert training_order.training_order(none).count() == 0


def test_rollup(docs, none, spark, tmp_path):
    encode, want = tokens.encoder(), collections.Counter()
    for _, t, lang, source, *_ in sample():
        want[(source, lang, tokens.TOKENIZER)] += len(encode(t or "")) // 4
        want[(source, lang, WORDS)] += 0
    got = {(r.source, r.lang, r.version): r for r in token_rollup(docs).collect()}
    assert {k: r.tokens for k, r in got.items()} == dict(want)
    assert all((r.docs == 0) == (k[2] == WORDS) for k, r in got.items())
    roll = Rollup(spark, str(tmp_path / "r"))
    one = signed(counted(docs.where("doc_id < 12"), WORDS), 1)
    assert roll.commit("a", one) and not roll.commit("a", one)
    roll.commit("b/odd name", signed(counted(docs.where("doc_id < 4"), WORDS), -1))
    before = sorted(map(str, roll.totals().collect()))
    roll.compact("base", ["a", "b/odd name"])
    assert sorted(map(str, roll.totals().collect())) == before and not roll.commit("a", one)
    assert sum(r.docs for r in roll.totals().collect()) == 8
    assert not roll.commit("b/odd name", one) and roll.commit("c", signed(counted(docs.where("doc_id = 20"), WORDS), 1))
    roll.compact("base2", ["base", "c", "never committed"])
    roll.compact("base3", ["base2"])
    after = sorted(map(str, roll.totals().collect()))
    assert roll.batches() == ["base3"] and not any(roll.commit(b, one) for b in ("a", "b/odd name", "c", "base", "base2", "base3"))
    assert sum(r.docs for r in roll.totals().collect()) == 9 and sorted(map(str, roll.totals().collect())) == after and all(r.version for r in roll.totals().collect())
    assert roll.commit("half", one) and sum(r.docs for r in roll.totals().collect()) == 21
    roll._fs.delete(roll._path(roll._at("half") + "/_SUCCESS"), False)  # as a writer leaves it that is lost before its commit
    assert sorted(map(str, roll.totals().collect())) == after and not roll.committed("half")
    assert roll.commit("half", one) and sum(r.docs for r in roll.totals().collect()) == 21 and roll.commit("never committed", one)
    assert token_rollup(none).count() == 0


def brute_rules(text):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append((2, m.start(), m.end()))
    return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@pytest.fixture(scope="module")
def net():
    return pii.trained()


def test_rules():
    rng = random.Random(6)
    for _ in range(8000):
        t = "".join(rng.choice("ab.@-+%_1234567890 ()é@@..") for _ in range(rng.randint(0, 40)))
        assert pii.rules(t) == brute_rules(t)
    assert pii.rules("4111111111111111 +1 (555) 010-1234 a@b.co 1.2.3.4 1.2.3.456") == [(0, 35, 41), (1, 42, 49), (2, 0, 16), (3, 17, 34)]
    assert len(pii.rules("a" * 200_000 + "@" + "@b" * 50_000)) == 0  # in linear time


def test_gradients():
    rng = np.random.default_rng(0)
    net = pii.train(pii.examples(4), steps=1, batch=2, length=8)
    net.trans = rng.standard_normal(net.trans.shape) * 0.1
    for p in net.parts()[:6]:
        p += (rng.standard_normal(p.shape) * 0.1).astype(p.dtype)
    big = pii.Network(*[p.astype(np.float64) for p in net.parts()])
    x, y = rng.integers(0, pii.CHARS, (3, 6)), rng.integers(0, pii.TAGS, (3, 6))
    _, grads = pii._gradients(big, x, y)
    for p, g in zip(big.parts(), grads):
        for at in [tuple(rng.integers(0, s) for s in p.shape) for _ in range(3)] + [np.unravel_index(np.abs(g).argmax(), g.shape)]:
            old, eps = p[at], 1e-2
            p[at] = old + eps
            up = pii._gradients(big, x, y)[0]
            p[at] = old - eps
            down = pii._gradients(big, x, y)[0]
            p[at] = old
            assert abs((up - down) / (2 * eps) - g[at]) < 2e-2 * max(1, abs(g[at]))


def test_network_on_held_out_texts(net):
    hit = wrong = missed = 0
    for text, spans in pii.examples(200, seed=12345):
        got = set(pii.added(net, [text], [[]])[0])
        hit, wrong, missed = hit + len(got & set(spans)), wrong + len(got - set(spans)), missed + len(set(spans) - got)
    assert hit / (hit + wrong) > 0.95 and hit / (hit + missed) > 0.9


def test_windows_without_triggers_change_nothing(net, monkeypatch):
    texts = [t for t, _ in pii.examples(10, seed=77)]
    text = ("plain words only. " * 40).join(texts)
    some = pii.added(net, [text], [pii.rules(text)])[0]
    monkeypatch.setattr(pii, "_window_numbers", lambda t: np.arange(max(1, -(-(len(t) - pii.WINDOW) // pii.STEP) + 1)))
    assert some == pii.added(net, [text], [pii.rules(text)])[0]


def test_personal_data_query(spark, none, net):
    texts = [None, "", "mail a@b.co or +1 (555) 010-1234", "x" * 5000 + " call (555) 010-1234 now " + "y" * 5000, "John.Doe [at] mail [dot] com"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id bigint, text string, spans string")
    rows = {r.doc_id: r for r in pii.personal_data(df, net).collect()}
    assert rows[0].spans == rows[1].spans == "" and rows[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[2].spans == "email:5:11,phone:15:32" and rows[2].base_sha256 == hashlib.sha256(rows[2].spans.encode()).hexdigest()
    assert rows[3].n_phone == 0 and rows[3].n_added == 1
    masked = {r.doc_id: r.text for r in pii.masked(df, net).collect()}
    assert masked[2] == "mail [EMAIL] or [PHONE]" and masked[0] is None and "010-1234" not in masked[3]
    assert pii.personal_data(none, net).count() == 0


def labelled(rng, n):
    bad, rows, labels = ["scum", "idiot", "moron", "trash"], [], []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(20, 120))]
        kind = rng.choice("gggtj")
        if kind == "t":
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(bad)
        if kind == "j":
            words = [w + "***" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind != "j"), int(kind == "t")))
    return rows, labels


def test_ordinal_quality(spark, none):
    rows, labels = labelled(random.Random(9), 900)
    docs = spark.createDataFrame(rows + [(9001, None), (9002, " "), (None, "w1 w2")], "doc_id bigint, text string")
    marks = spark.createDataFrame([x for x in labels if x[0] % 3] + [(None, 1, 0), (5, None, None), (7, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = oq.fit(docs, oq.graded(marks))
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in oq.score(docs, model).collect()}
    held = [(r, y) for r, y in zip(rows, labels) if r[0] % 3 == 0]
    right = [got[r[0]].kept == (y[1] == 1 and y[2] == 0) for r, y in held]
    assert sum(right) / len(right) > 0.97
    assert got[9001].kept is False and got[9002].kept is False and 0 <= got[1].tail <= 1 and 0 <= got[1].expected_grade <= 2
    kept = {r.doc_id for r in oq.selected(docs, model).collect()}
    assert kept == {i for i, r in got.items() if r.kept}
    blank = oq.ordinal_quality(docs, marks.where("false"))
    assert {r.kept for r in blank.where("doc_id < 900").collect()} == {True}
    assert oq.score(none, model).count() == 0
    few = oq.fit(docs, oq.graded(marks), sample=50)
    assert few is None or len(few.weights) == oq.BUCKETS


def test_ordinal_likelihood_falls():
    rng = np.random.default_rng(1)
    at = [np.array([i % 50, 60 + i % 7], np.int32) for i in range(2000)]
    value = [np.ones(2, np.float32)] * 2000
    truth = rng.standard_normal(100)
    grade = np.array([int(np.searchsorted([-0.5, 0.5], truth[a].sum() + rng.standard_normal() * 0.1)) for a in at])
    m = oq.train(at, value, grade)
    s = np.array([m.weights[a].sum() for a in at])
    assert ((s[:, None] > m.thresholds).sum(1) == grade).mean() > 0.9


def test_ngram_join_without_broadcasts(docs, monkeypatch):
    import faultline.llm.ngram_join as module

    monkeypatch.setattr(module, "BROADCAST_DOCS", 0)
    monkeypatch.setattr(module, "HOT", -10**9)  # every key is salted
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in module.ngram_join(docs).collect()}
    assert got == reference_join([(r[0], r[1]) for r in sample()], 4, 85)


def test_spelled_out_addresses_in_any_case(net):
    forms = ["jane.roe [AT] mail [DOT] com", "jane.roe AT mail DOT com", "jane.roe at mail.com", "jane.roe [at] mail.com", "jane.roe (AT) mail (DOT) com", "jane.roe at mail dot com"]
    assert all(pii.plausible(0, f) and pii._TRIGGER.search(f) for f in forms)
    assert not pii.plausible(0, "jane at mail. Com") and not pii.plausible(0, "at home") and not pii.plausible(0, "jane [at] mail")
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["an", "re", "tion", "ou", "st", "er", "la", "que", "en", "ber", "do", "the", "in", "mi", "ra"]) for _ in range(rng.randint(1, 3)))
    for f in forms:
        hit = 0
        for _ in range(50):
            before, found = " ".join(word() for _ in range(40)) + " ", f.replace("jane.roe", f"{word()}.{word()}").replace("mail", word())
            text = f"{before}{found} " + " ".join(word() for _ in range(40))
            hit += any(k == 0 and a <= len(before) and b >= len(before + found) for k, a, b in pii.added(net, [text], [pii.rules(text)])[0])
        assert hit >= 47, f


def test_ngram_join_over_many_blocks_and_fragments(spark, monkeypatch):
    import faultline.llm.ngram_join as module

    monkeypatch.setattr(module, "BLOCK", 12)
    monkeypatch.setattr(module, "FRAGMENT", 8)
    rng = random.Random(18)
    passage = prose(rng, 40)
    rows, near, other = [], prose(rng, 80).split(" "), prose(rng, 60).split(" ")
    for i in range(90):  # near copies, copies, and documents that share a passage only
        base = near if i % 3 == 0 else other if i % 3 == 1 else [passage, *prose(rng, 14).split(" ")]
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, rows[3 * i % 90][1]) for i in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in module.ngram_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == reference_join(rows, 4, 85)


def test_partial_overlaps_sum_to_the_whole():
    import faultline.llm.ngram_join as module

    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64) * 2)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: int(rng.integers(150, 300))], rng.integers(0, 2**63, int(rng.integers(0, 40))).astype(np.uint64)])) for _ in range(30)]
    for same in (True, False):
        parts = []
        for f in range(8):
            lo, hi = (f << 64) // 8, ((f + 1) << 64) // 8
            cut = [s[(s >= lo) & (s.astype(object) < hi)] if f < 7 else s[s >= np.uint64(lo)] for s in sets]
            people, pairs = module.counted([(0 if same or i < 14 else 1, i, 1000 + i, 2, len(sets[i]), c) for i, c in enumerate(cut) if len(c)], same, 60)
            if len(pairs):
                parts.append((people, pairs))
        want = collections.Counter()
        for i in range(30):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if (same or (j < 14 <= i)) and 100 * both >= 60 * (len(sets[i]) + len(sets[j]) - both):
                    want[1000 + i] += 2
                    want[1000 + j] += 2
        assert len(parts) > 1 and {doc: links for doc, _, links in module.summed(parts, 60)} == want and len(want) > 5


def test_triggers_reach_as_far_as_they_go(net):
    far = "jane.roe at " + "mail" * 40 + " dot com"
    text = "plain words only " * 30 + far + " and more plain words" * 30
    m = pii._TRIGGER.search(text)
    assert m and m.end() - m.start() > 160
    numbers = pii._window_numbers(text)
    covered = {c for k in numbers.tolist() for c in range(k * pii.STEP, k * pii.STEP + pii.WINDOW)}
    assert covered >= set(range(text.index("jane"), text.index("jane") + len(far)))
    assert len(pii._window_numbers(" at " + "a" * 300_000 + " at " + "." * 300_000)) == 0  # in linear time
    assert pii._window_numbers("no trigger").size == 0


def test_decoding_equals_exhaustive_search(net):
    import itertools

    rng = random.Random(2)
    pool = "1239@. atdo-+x"
    for _ in range(6):
        x = pii.coded("".join(rng.choice(pool) for _ in range(4)))[None]
        e = pii._emissions(net, pii._lstm(net, x, False)[1])[:, 0]
        score = lambda y: net.start[y[0]] + sum(e[t, y[t]] for t in range(4)) + sum(net.trans[y[t], y[t + 1]] for t in range(3))
        best = max(itertools.product(range(pii.TAGS), repeat=4), key=score)
        assert abs(score(best) - score(tuple(pii.tagged(net, x)[0].tolist()))) < 1e-4


def test_repeated_labelled_rows_count_once(spark):
    rows, labels = labelled(random.Random(9), 300)
    plain = spark.createDataFrame([(i, t, i, 0.5) for i, t in rows], "doc_id bigint, text string, grade bigint, score double")  # clashing names
    marks = oq.graded(spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    many = plain.unionByName(plain.where("doc_id < 5").crossJoin(spark.range(50)).drop("id"))
    a, b = oq.fit(plain, marks), oq.fit(many, marks)
    assert (a.weights == b.weights).all() and (a.thresholds == b.thresholds).all()
    assert oq.score(many, a).count() == 300 + 250 and oq.selected(many, a).columns == plain.columns


def test_probabilities_against_plain_formulas(spark):
    rows, labels = labelled(random.Random(10), 200)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = oq.fit(docs, oq.graded(spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")))
    for r in oq.score(docs, model).collect():
        at, value = oq.features(rows[r.doc_id][1].encode(), oq._Features())
        s = sum(float(model.weights[i]) * float(v) for i, v in zip(at, value))
        below = [1 / (1 + 2.718281828459045 ** -(t - s)) for t in model.thresholds]
        grades = [below[0], below[1] - below[0], 1 - below[1]]
        assert abs(r.score - s) < 1e-3 and abs(r.tail - grades[2]) < 1e-3 and abs(r.expected_grade - (grades[1] + 2 * grades[2])) < 2e-3 and r.kept == (r.tail >= oq.SELECT_TAIL)
