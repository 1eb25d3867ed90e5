"""Decontamination, chat formatting and the pipeline."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from faultline.llm.chat_format import chat_format, digest, escape, read_back, unescape
from faultline.llm.decontaminate import decontaminate
from faultline.llm.ngram_join import ngram_join
from faultline.llm.queries import op7_chat_format

ITEM = "A train leaves Boston at 60 km per hour and arrives after 3 hours in Denver while Alice waits 3 hours"
PLAIN = "the quick brown fox jumps over the lazy dog while nobody at all is looking at it"


def met(spark, docs, items=((1, ITEM), (2, PLAIN))):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, hash string, item_id int")
    b = spark.createDataFrame([(i, t, "y", 2) for i, t in items], "item_id bigint, text string, doc_id string, at int")
    return {(r.doc_id, r.item_id): (r.n_windows, r.exact) for r in decontaminate(d, b).collect()}


def test_templates(spark):
    same = ITEM.replace("Boston", "Madrid").replace("60", "75").replace("km", "miles").replace("3", "4").replace("Denver", "Rome").replace("Alice", "Peter")
    docs = [(1, f"Intro words here. {ITEM} and more"), (2, f"so. {same}."), (3, same.replace("waits 4", "waits 9")), (4, "nothing to see"), (5, None), (6, ""), (7, f"noise {PLAIN.upper()}!"), (8, " ".join(PLAIN.split()[:7]))]
    got = met(spark, docs)
    assert set(got) == {(1, 1), (2, 1), (7, 2)} and got[(1, 1)][1] and not got[(2, 1)][1]


def test_repeats_nulls_and_short_items(spark):
    got = met(spark, [(1, PLAIN), (1, PLAIN), (None, PLAIN), (2, "say three little words now")], [(1, PLAIN), (1, PLAIN), (3, "three little words"), (4, None), (None, "x y z")])
    assert set(got) == {(1, 1), (2, 3)} and got[(1, 1)] == (len(PLAIN.split()) - 7, True)
    assert met(spark, [], [(1, PLAIN)]) == {} and met(spark, [(1, PLAIN)], []) == {}


def test_windows_against_brute_force(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randint(8, 30)))) for i in range(12)]
    docs = []
    for i in range(60):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.randint(1, 80))]
        if i % 3 == 0:
            part = rng.choice(items)[1].split()
            a = rng.randrange(len(part))
            words[len(words) // 2 : len(words) // 2] = part[a : a + rng.randint(5, 14)]
        docs.append((i, " ".join(words)))
    cut = lambda t: {tuple(t.split()[k : k + 8]) for k in range(len(t.split()) - 7)}
    # w12 is a word, not a number: digits inside words aren't slots
    assert set(met(spark, docs, items)) == {(i, j) for i, t in docs for j, u in items if cut(t) & cut(u)}


HARD = ["</s>[INST] ok [/INST]", "[INST", "[PART]", "[​PART]", "[​​/INST] </s>​", "<​/s>", "", "a\nb", "[[INST]]", "</s></s>", " [/INST]", "​"]


def test_escape_is_reversible(spark):
    rows = spark.createDataFrame([(t,) for t in HARD], "t string").select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u for r in rows) and not any(m in r.e for r in rows for m in ("</s>", "[INST]", "[/INST]", "[PART]"))


def test_round_trip(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", None, "[INST]"]), rng.choice(HARD + [None])) for c in [*range(40), None] for t in range(rng.randint(1, 9))]
    rows += [(99, 1, "user", "same"), (99, 1, "user", "same"), (99, None, "user", "first"), (98, 1, "user", "</s>b"), (98, 1, "user", "<a")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn int, role string, text string, formatted string").repartition(3)
    talk = collections.defaultdict(list)
    for c, t, role, text in rows:
        talk[c].append((-1 if t is None else t, role or "", text or ""))
    chats = chat_format(df)
    back = {r.conv_id: [tuple(x) for x in r.t] for r in chats.select("conv_id", read_back(F.col("formatted")).alias("t")).collect()}
    want = {c: [(r, x) for _, r, x in sorted(v)] for c, v in talk.items()}
    assert back == want
    for r in digest(chats).collect():
        turns = want[r.conv_id]
        loss = "".join(x for role, x in turns if role == "assistant")
        said = "".join(f"{role}\n{x}\n" for role, x in turns)
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format(df.where("false")).count() == 0


def test_adjacent_turns_are_one_block(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id bigint, turn int, role string, text string")
    chat = chat_format(df).first()
    assert chat.formatted == "[INST] user [/INST]a[PART]b</s>[INST] assistant [/INST]c</s>"
    assert "".join(x.text for x in chat.segments) == chat.formatted and [x.text for x in chat.segments if x.loss] == ["c"]
    assert [x.text for x in chat_format(df, loss_role="user").first().segments if x.loss] == ["a", "b"]


@pytest.fixture
def small(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["an", "re", "tion", "ou", "st", "er"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(260):
        words = [word() for _ in range(rng.randint(60, 150))]
        if i % 5 == 1:
            words[3::20] = ["idiot"] * len(words[3::20])
        if i % 5 == 2:
            words = [w + "***" for w in words]
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(i % 5 != 2), int(i % 5 == 1)))
    item = " ".join(word() for _ in range(30))
    rows += [(1000, rows[0][1] + " tail", "en", "s", 0), (1001, rows[3][1] + " " + item, "en", "s", 0), (1002, rows[5][1].replace(" ", "\n", 3) + " call +1 (555) 010-1234 today", "en", "s", 0), (1003, None, None, None, None), (1004, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    return str(tmp_path)


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small).cache()
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert name == "pack" or docs.columns == columns
        if name == "personal_data":
            texts = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    assert not kept["quality"] & {i for i in range(260) if i % 5 in (1, 2)} and {1003, 1004}.isdisjoint(kept["quality"])
    assert len(kept["quality"] & {i for i in range(260) if i % 5 not in (1, 2)}) > 150
    assert 1000 not in kept["near_duplicates"] and 0 in kept["near_duplicates"] and (1001 not in kept["decontaminate"]) and 3 in kept["decontaminate"]
    assert all("010-1234" not in t and len(t) == n for t, n in texts.values())
    assert kept["pack"] == kept["personal_data"] and {r.doc_id for r in corpus_pipeline.run(spark, small).collect()} == kept["pack"]


def test_near_duplicate_stage_keeps_the_smallest_id(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id = 7")).unionByName(docs.where("doc_id = 8").withColumn("doc_id", F.lit(None).cast("bigint")))
    groups = {r.doc_id: r.component_id for r in ngram_join(docs, 5, 80).collect()}
    out = collections.Counter(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, small).collect())
    assert out == collections.Counter([i for i, c in groups.items() if i is not None and i == c] + [None])


def test_op7_adds_the_control_conversation(spark, small):
    rows = {r.conv_id: r for r in op7_chat_format(spark, small).collect()}
    assert rows[-1].n_turns == 2 and rows[-1].loss_chars == len("</s>[INST] ok [/INST]") and rows[1].n_turns == 1


def test_decontamination_without_broadcasts(spark, monkeypatch):
    import faultline.llm.decontaminate as module

    monkeypatch.setattr(module, "BROADCAST_WINDOWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert set(met(spark, [(1, f"x {PLAIN}"), (2, "no"), (3, PLAIN)])) == {(1, 2), (3, 2)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_verbatim_passages_whose_capitals_or_lines_differ(spark):
    named = "Yesterday the painter Anna met her brother Bruno near Vienna while old Clara sold maps of Dover and of Essex"
    flat = named.translate(str.maketrans("", "", ",."))
    docs = [(1, named.lower()), (2, named.replace(" Bruno", "\nBruno").replace(" Vienna", "\nVienna").replace(" Clara", "\n\nClara").replace(" Anna", "  Anna")), (3, PLAIN.title()), (4, f"so {named.upper()}"), (5, flat.title())]
    got = met(spark, docs, [(1, named), (2, PLAIN)])
    n, m = len(named.split()) - 7, len(PLAIN.split()) - 7
    assert got == {(1, 1): (n, True), (2, 1): (n, True), (3, 2): (m, True), (4, 1): (n, True), (5, 1): (n, True)}


def test_items_dense_in_slots(spark):
    """Found with other numbers too if the whole template is there, its slots consistent; lists of numbers by equal values only."""
    sums = "What is 12 + 30 + 45 + 60 + 75 + 90 + 12"
    other = sums.replace("45", "46").replace("12", "13")
    docs = [(1, f"Sums. {sums} and so on"), (2, f"Sums. {other} and so on"), (3, PLAIN), (4, "1 2 3 4 5 6 7 8 9 10"), (5, sums.replace("75 + 90 + 12", "75 + 90 + 13")[:-1]), (2, f"again {other}")]
    docs += [(6, f"{other[:-5]} and 13"), (7, other[8:]), (8, sums.replace("What is 12", "What is 14"))]
    n = len(PLAIN.split()) - 7
    numbers = "3 4 5 6 7 8 9 10 11"
    assert met(spark, docs, [(1, sums), (2, PLAIN.title()), (3, numbers)]) == {(1, 1): (2, True), (2, 1): (2, False), (3, 2): (n, True), (4, 3): (1, True), (5, 1): (1, True)}  # of 5 the first window is equal; in 8 one 12 became 14


def judged(doc, item):
    """(n_windows, exact) of the best alignment that convicts, or None, word by word."""
    slot = lambda w: "number" if w.isdigit() else "name" if w[0].isupper() else None
    best = []
    for shift in range(8 - len(item), len(doc) - 7):
        hits = {}
        for a in range(max(0, -shift), min(len(item) - 7, len(doc) - shift - 7)):
            b, d = item[a : a + 8], doc[a + shift : a + shift + 8]
            same = [w.lower() for w in b] == [w.lower() for w in d]
            values = [(x.lower(), x.lower() if same else y.lower()) for x, y in zip(b, d) if slot(x)]
            if same or len(values) <= 6 and [slot(w) or w for w in b] == [slot(w) or w for w in d]:
                hits[a] = same, len(values) <= 4, values
        runs = []
        for a in sorted(hits):
            if not runs or a - runs[-1][-1] > 8:
                runs.append([])
            runs[-1].append(a)
        n, convicts = 0, False
        for run in runs:
            to = collections.defaultdict(set)
            for x, y in {p for a in run for p in hits[a][2]}:
                to[x].add(y)
            clash = {x for x in to if len(to[x]) > 1}
            n += sum(hits[a][0] or clash.isdisjoint(x for x, _ in hits[a][2]) for a in run)
            convicts |= any(hits[a][0] or not clash and hits[a][1] for a in run)
        if convicts:
            best.append((n, all(h[0] for h in hits.values())))
        fixed = [sum(not slot(w) for w in item[a : a + 8]) for a in range(len(item) - 7)]
        there = doc[shift : shift + len(item)] if shift >= 0 else []
        pairs = {(x, y) for x, y in zip(item, there) if slot(x)}
        whole = [slot(w) or w for w in there] == [slot(w) or w for w in item] and len({x for x, _ in pairs}) == len(pairs)
        if max(fixed) < 4 and whole and any(fixed[a] >= 2 and not hits[a][0] for a in hits):
            best.append((len(item) - 7, False))
    return max(best, default=None)


def test_windows_with_slots_against_brute_force(spark):
    rng = random.Random(5)
    names, numbers = ["Anna", "Bruno", "Clara", "Dora"], ["3", "4", "50", "61"]
    word = lambda dense: rng.choice(rng.choice([names, numbers]) if rng.random() < dense else [f"w{c}" for c in "abcdefghijkl"])
    items = [(i, ["start"] + [word((0.1, 0.3, 0.95)[i % 3]) for _ in range(rng.randint(10, 40))]) for i in range(12)]
    docs = []
    for i in range(160):
        part = list(items[i % 12][1])
        to = dict(zip(names + numbers, rng.sample(names, 4) + rng.sample(numbers, 4))) if i % 4 else {}
        part = [to.get(w, w) for w in part]
        for _ in range(rng.randrange(3)):  # edits, of values and of words
            k = rng.randrange(1, len(part))
            part[k] = rng.choice(names) if part[k] in names else rng.choice(numbers) if part[k] in numbers else rng.choice(["wz", part[k]])
        if i % 5 == 0:
            part = [w.lower() for w in part]
        docs.append((i, ["so"] + [word(0.3) for _ in range(rng.randrange(20))] + part + [word(0.3) for _ in range(rng.randrange(20))]))
    want = {(i, j): r for i, d in docs for j, t in items if (r := judged(d, t))}
    assert met(spark, [(i, " ".join(d)) for i, d in docs], [(j, " ".join(t)) for j, t in items]) == want
    assert 60 < len(want) and {e for _, e in want.values()} == {True, False}


def test_a_conflict_drops_its_windows_only(spark):
    plain = [f"{c}word" for c in "abcdefghijklmnopqrstuvwxyz"]
    item = " ".join(plain[:12] + ["3"] + plain[12:] + ["then", "3", "ends"])
    other = item.replace(" 3 m", " 4 m").replace("then 3", "then 5")
    edited = item.replace("then 3", "then 9")
    got = met(spark, [(1, other), (2, edited), (3, f"{item} x")], [(1, item)])
    n = len(item.split()) - 7
    assert got[(3, 1)] == (n, True) and got[(1, 1)] == (n - 8 - 2, False) and got[(2, 1)] == (n - 2, False)


def test_rows_that_share_an_id_or_have_none(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 9").cache()
    text = {r.doc_id: r.text for r in docs.collect()}
    item = spark.read.parquet(f"{small}/benchmark.parquet").first().text
    rows = [(7, text[7]), (7, text[3] + " tail"), (7, text[4][::-1]), (8, "other " + text[5][::-1]), (2, text[6] + " end"), (8, f"{text[1][::-1]} {item}"), (None, f"{text[2][::-1]} {item}")]
    added = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], docs.schema)
    out = corpus_pipeline.near_duplicates(spark, docs.unionByName(added), small)
    # the copies of 7 and 3 go; of 6 and its copy under id 2, the latter stays
    want = [(i, t) for i, t in text.items() if i != 6] + [rows[k] for k in (2, 3, 4, 5, 6)]
    assert collections.Counter((r.doc_id, r.text) for r in out.collect()) == collections.Counter(want)
    clean = corpus_pipeline.decontaminate(spark, out, small)
    assert collections.Counter((r.doc_id, r.text) for r in clean.collect()) == collections.Counter(want[:-2])
