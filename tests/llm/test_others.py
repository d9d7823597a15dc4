import glob
import hashlib
import os
import time
from collections import Counter

import duckdb
import numpy as np
import pytest

from tapquarry.llm import op1_html, op2_mixing, op4_weighted_sampling, op5_decontaminate, op6_sharding, op8_token_shards, op9_toxicity, registry

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
con = duckdb.connect()
for f in glob.glob(f"{SF}/*.parquet"):
    con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_duckdb(spark, name):
    df = registry.QUERIES[name](spark, SF)
    columns, want = sorted(df.columns), con.sql(registry.ORACLES[name])
    names = want.columns
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in want.fetchall()), key=repr)


def test_html_layout():
    page = "<title>t</title><p>one <b>two<p>three<br>four<ul><li>a<li>b<ol start=9><li>x<li>y</ol></ul><div hidden>no</div><i style='DISPLAY : none'>no</i><table><tr><th>Name<th>n<tr><td>ab<td>3</table><pre> k\n  l</pre>&lt;end&gt;<script>if (a<b) x()</script>"
    assert op1_html.text_of(page) == "one two\n\nthree\nfour\n\n- a\n- b\n   9. x\n  10. y\n\nName  n\nab    3\n\n k\n  l\n\n<end>"


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("plain", "plain"), ("<p>a</div></p></x>b", "a\n\nb"), ("a < b", "a < b"), ("<!-- open", ""), ("<a href='x", "<a href='x"), ("<details><summary>s</summary>h</details>", "s"), ("<div>" * 3000 + "deep", "deep")])
def test_html_odd_pages(page, text):
    assert op1_html.text_of(page) == text


@pytest.mark.parametrize("page,lines", [("<div>" * 50_000 + "deep", 1), ("<table><tr><td>" * 5000 + "deep", 1), ("<table><tr><td>a" * 3000 + "deep", 5999), ("<p><table><tr><td>" + "<div>" * 50_000 + "x", 1), ("<ul><li>" * 20_000 + "x", 1), ("<b>" * 50_000 + "</i>" * 50_000, 1)])
def test_html_deep_pages_take_little_time(page, lines):
    began = time.time()
    assert len(op1_html.text_of(page).split("\n")) == lines
    assert time.time() - began < 4


def test_html_content_of_a_table_outside_cells():
    page = "<p>p</p><table>stray<tr><td>a<td>b</tr><div>box</div><tbody>more<tr>in row<td>c</table>after"
    assert op1_html.text_of(page) == "p\n\nstray\nbox\nmorein row\na  b\nc\n\nafter"
    assert op1_html.text_of("<table><tr><td>out<table><tr><td>in<td>x</table><td>y</table>") == "out    y\n\nin  x"


def test_html_clashing_names_and_no_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>a", "old")], "page_id long, url string, html string, html__ string")
    assert op1_html.extract(df, ("page_id", "html__")).collect() == [(1, "old", "a")]
    assert op1_html.extract(df.limit(0)).count() == 0


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>a"), (2, None, None)], "page_id long, url string, html string")
    assert sorted((r["page_id"], r["text"]) for r in op1_html.extract(df).collect()) == [(1, "a"), (1, "a"), (2, "")]


def test_mixing_meets_weights(spark):
    docs = [(i, "x" * 100, "en", "big" if i % 4 else "small", 100) for i in range(4000)] + [(None, None, None, None, None)] * 2
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as copy")
    out = op2_mixing.mix_sources(df, {"big": 1.0, "small": 3.0})
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["small"] / 3000 - 1) < 0.1 and abs(n["big"] / 1000 - 1) < 0.1
    keys = [r["shuffle_key"] for r in out.collect()]
    assert keys == sorted(keys)
    assert op2_mixing.mix_sources(spark.createDataFrame([], DOCS)).count() == 0


def test_sharding_splits_only_what_is_full(spark):
    docs = [(i, "x" * (i % 50), "en", "s", 0) for i in range(2000)] + [(7, "y" * 400, "en", "s", 0)] * 9 + [(None, None, None, None, None), (9999, "z" * 5000, "en", "s", 0)]
    rows = op6_sharding.shard(spark.createDataFrame(docs, DOCS).selectExpr("*", "'a' as shard"), 2000).collect()
    assert len(rows) == len(docs)
    size = {}
    for r in rows:
        size[r["shard"], r["part"]] = size.get((r["shard"], r["part"]), 0) + r["n_bytes"]
    assert all(v <= 2000 or v == 5000 for v in size.values())
    shards = {s for s, _ in size}
    assert not any(a != b and b.startswith(a) for a in shards for b in shards)
    assert op6_sharding.shard(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_sharding_of_one_hot_id(spark, monkeypatch, broadcast):
    """A third of all rows have no id; the caller's columns have the operator's own names."""
    monkeypatch.setattr(op6_sharding, "BROADCAST", broadcast)
    docs = [(None if i % 3 == 0 else i, "t" * (i % 40)) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'c' as cell", "'o' as own", "1 as deep", "2 as number", "3 as piece", "4 as part").repartition(5)
    out = op6_sharding.shard(df, 1500)
    assert out.columns == ["doc_id", "text", "cell", "own", "deep", "number", "piece", "shard", "depth", "part", "n_bytes"]
    rows = out.collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in rows) == sorted((str(d), t) for d, t in docs) and {r["number"] for r in rows} == {2}
    size = Counter()
    for r in rows:
        size[r["shard"], r["part"]] += r["n_bytes"]
    assert max(size.values()) <= 1500
    # no bucket could be joined with its sibling: their parent is over the limit
    parent = Counter()
    for r in rows:
        for d in range(len(r["shard"]) + 1):
            parent[r["shard"][:d]] += r["n_bytes"]
    assert all(parent[s[:-1]] > 1500 for s, _ in size if s)


def test_mixing_odd_weights_and_names(spark):
    docs = [(i, "x" * 50, "en", "s", 50) for i in range(300)] + [(400 + i, "", "en", "none", 0) for i in range(200)]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "7 as own", "8 as mean", "9 as salt")
    out = op2_mixing.mix_sources(df, {"absent": 1.0, "none": 2.0})
    assert out.columns == [*df.columns, "copy", "shuffle_key"]
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert "s" not in n and 140 < n["none"] < 260
    with pytest.raises(ValueError, match="negative"):
        op2_mixing.mix_sources(df, {"s": -1.0})
    by = [sorted(map(tuple, op2_mixing.mix_sources(df, broadcast=b).collect())) for b in (0, 10)]
    assert by[0] == by[1] and {r[5:8] for r in by[0]} == {(7, 8, 9)}


def test_fingerprints(spark):
    docs = [(3, "a b c d e f g h " * 4), (1, "the quick brown fox"), (9, ""), (12, None), (5, "ü" * 9), (5, "ü" * 9), (None, "null id")]
    got = {(r["doc_id"], r["n_chars"]): r for r in op4_weighted_sampling.fingerprints(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as block")).collect()}
    order = sorted(((d if d is not None else -1), t or "") for d, t in docs)
    for i, (d, t) in enumerate(order):
        nxt, m = order[(i + 1) % len(order)][1], len(t) // 4
        row = got[d if d >= 0 else None, len(t)]
        if d != 5:
            assert row["edited_sha256"] == hashlib.sha256((t[: len(t) - m] + nxt[:m]).encode()).hexdigest()
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
    assert got[9, 0]["near_next"] == 1 and got[9, 0]["fingerprint"] == "" == got[12, 0]["fingerprint"]
    assert op4_weighted_sampling.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_likeness_follows_weighted_jaccard(spark):
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(f"w{x}" for x in rng.integers(0, 4000, 600))) for i in range(40)]
    rows = op4_weighted_sampling.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert abs(np.mean([r["near_edited"] for r in rows]) - 0.6) < 0.08 and np.mean([r["near_next"] for r in rows]) < 0.15


@pytest.mark.parametrize("n,heavy,other", [(31, (100, 100), 1), (31, (100, 10), 31), (400, None, 200)])
def test_likeness_on_skewed_counts(spark, n, heavy, other):
    """One heavy word among other words, the same words with another heavy count, and Zipf-like counts with the rare half replaced."""
    truth, docs = [], []
    for pair in range(30):
        counts = [[h, *[1] * (n - 1)] for h in heavy] if heavy else [[max(1, 400 // (i + 1)) for i in range(n)]] * 2
        a, b = ({f"p{pair}w{i}" if i < other or not side else f"p{pair}x{i}": c for i, c in enumerate(counts[side])} for side in (0, 1))
        truth.append(sum(min(a.get(w, 0), b.get(w, 0)) for w in a | b) / sum(max(a.get(w, 0), b.get(w, 0)) for w in a | b))
        docs += [(2 * pair + side, " ".join(w for w, c in x.items() for _ in range(c))) for side, x in enumerate((a, b))]
    rows = op4_weighted_sampling.fingerprints(spark.createDataFrame(docs, "doc_id long, text string"), blocks=4).collect()
    assert abs(np.mean([r["near_next"] for r in rows if r["doc_id"] % 2 == 0]) - np.mean(truth)) < 0.05


@pytest.mark.parametrize("slack", [0.5, 3.0])
def test_samples_do_not_depend_on_the_first_bound(spark, slack):
    """Whatever the bound leaves out, a second pass finds: the fingerprints are those of all draws."""
    rng = np.random.default_rng(2)
    docs = [(int(i // 2), " ".join(f"w{x}" for x in rng.zipf(1.4, int(rng.integers(0, 90))) % 300)) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    columns = ["doc_id", "n_chars", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    few, all_ = (sorted(map(tuple, op4_weighted_sampling.fingerprints(df, blocks=b, slack=s).select(*columns).collect())) for b, s in ((3, slack), (1, 1e6)))
    assert few == all_


def test_likeness_against_exact_similarity_of_whole_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    got = {r["doc_id"]: r["near_edited"] for r in op4_weighted_sampling.query(spark, SF).collect()}
    short, long_ = [], []
    for i, (d, t) in enumerate(docs):
        m = len(t) // 4
        a, b = (Counter(x.lower().translate(str.maketrans("\t\n\x0b\f\r", "     ")).split(" ")) for x in (t, t[: len(t) - m] + docs[(i + 1) % len(docs)][1][:m]))
        del a[""], b[""]
        truth = sum((a & b).values()) / max(1, sum((a | b).values())) if a or b else 1.0
        (short if len(a) < 32 else long_).append(got[d] - truth)
    for error in (short, long_):
        assert abs(np.mean(error)) < 0.03 and np.sqrt(np.mean(np.square(error))) < 0.075, (np.mean(error), len(error))


def test_decontamination(spark):
    item = "A train leaves at 9 with 120 riders and 9 more board in Paris so how many minutes until all riders leave again"
    other = item.replace("9", "4").replace("120", "77").replace("Paris", "Oslo")
    broken = item.replace("at 9", "at 5")
    docs = [(1, "Intro words. " + item + " tail"), (2, other), (3, broken), (4, "nothing of it"), (5, None), (6, "")]
    bench = spark.createDataFrame([(10, item), (11, item), (12, None), (13, "")], "item_id long, text string")
    for block in (1_000_000, 5):
        got = {r["doc_id"]: (r["contaminated"], r["item_id"], r["exact"]) for r in op5_decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), bench, block=block).collect()}
        assert got[1] == (True, 10, True) and got[2] == (True, 10, False) and got[3] == (True, 10, True) and not got[4][0] and not got[5][0] and not got[6][0]
    assert not op5_decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), bench.limit(0)).where("contaminated").count()


def test_decontamination_of_parts_of_a_run(spark):
    item = "A train leaves at 9 with 120 riders and 9 more board in Paris so how many minutes until all riders leave again"
    chance = "A 1 2 3 ran 4 5 6 far 7 8 9 on 10 11 12 by"  # mostly slots
    docs = [(3, item.replace("at 9", "at 5")), (4, item.replace("9 more", "5 more").replace("Paris", "Oslo")), (5, "A 7 7 7 ran 7 7 7 far 7 7 7 on 7 7 7 by"), (6, chance)]
    bench = spark.createDataFrame([(10, item), (11, chance)], "item_id long, text string")
    got = {r["doc_id"]: (r["item_id"], r["words"], r["exact"]) for r in op5_decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {3: (10, 18, True), 4: (10, 18, False), 5: (None, 0, False), 6: (11, 17, True)}


def test_decontamination_of_names_that_open_sentences(spark):
    item = "Anna has 3 red apples and 4 green pears. Anna gives 2 to Ben. How many fruits are left?"
    other = "Omar has 5 red apples and 9 green pears. Omar gives 1 to Lena. How many fruits are left?"
    mixed = "Omar has 5 red apples and 9 green pears. Lena gives 1 to Lena. Why many fruits are left?"  # two names for one, one for two
    docs = [(1, other), (2, mixed), (3, "Peter sells 7 old boats"), (4, item.lower().replace("anna", "Anna").replace("ben", "Ben"))]
    bench = spark.createDataFrame([(10, item), (11, "Maria sells 2 old boats")], "item_id long, text string")
    got = {r["doc_id"]: r["item_id"] for r in op5_decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {1: 10, 2: None, 3: 11, 4: 10}


def plain_stretches(x, y, slots, need):
    """All stretches of a run that count: tried one by one."""
    out = set()
    for a in range(len(x)):
        for b in range(a + need, len(x) + 1):
            pairs = {(p, q) for p, q, s in zip(x[a:b], y[a:b], slots[a:b], strict=True) if s}
            consistent = len({p for p, _ in pairs}) == len(pairs) == len({q for _, q in pairs})
            if (consistent and 2 * sum(slots[a:b]) <= b - a) or list(x[a:b]) == list(y[a:b]):
                out.add((a, b))
    return out


def test_stretches_same_as_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(400):
        n, need = int(rng.integers(1, 14)), int(rng.integers(1, 6))
        slots = rng.random(n) < 0.5
        x, y = rng.integers(0, 4, n), rng.integers(0, 4, n)
        y = np.where(slots & (rng.random(n) < 0.6), y, x)
        got, want = set(op5_decontaminate.stretches(x, y, slots, need)), plain_stretches(x, y, slots, need)
        assert got <= want and {b for _, b in got} == {b for _, b in want}
        assert max([b - a for a, b in got], default=0) == max([b - a for a, b in want], default=0)


def test_decontamination_of_short_items_and_odd_rows(spark):
    bench = spark.createDataFrame([(1, "Yes"), (2, "blue whale"), (3, "7"), (4, "line one\nline two\nwas here")], "item_id long, text string")
    docs = [(1, "yes"), (2, "yes or no"), (3, "Blue whale!"), (4, "blue whale song"), (5, "7"), (6, "8"), (7, "line one line two was here"), (None, "yes"), (7, ""), (7, "line one line two was here")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as evidence_items", "2 as evidence", "3 as item_id")
    for block in (1, 1_000_000):
        got = sorted(str((r["doc_id"], r["item_id"])) for r in op5_decontaminate.decontaminate(df, bench, block=block).collect())
        assert got == sorted(map(str, [(1, 1), (2, None), (3, 2), (4, None), (5, 3), (6, None), (7, 4), (None, 1), (7, None), (7, 4)]))
        kept = op5_decontaminate.cleaned(df, bench, block=block)
        assert kept.columns == df.columns and sorted(r["text"] for r in kept.collect()) == ["", "8", "blue whale song", "yes or no"]
    assert op5_decontaminate.decontaminate(df.limit(0), bench).count() == 0


def test_token_shards(spark, tmp_path):
    docs = [(1, "hello world " * 300), (2, ""), (3, None), (None, "x"), (3, "y")]
    pieces = op8_token_shards.materialise(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), length=64, per_shard=4)
    rows = op8_token_shards.sequences(pieces, 64, 4).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    enc = op8_token_shards.encoder(op8_token_shards.default_vocabulary())
    ids = [*enc.encode_ordinary(docs[0][1]), 50256]
    for r in rows:
        if r["doc_id"] == 1:
            part = ids[r["seq"] * 64 : r["seq"] * 64 + 64]
            assert r["sha256"] == hashlib.sha256(np.array(part + [50256] * (64 - len(part)), np.uint16).tobytes()).hexdigest()
    written = {r["shard"]: r for r in op8_token_shards.write_shards(pieces, str(tmp_path / "out")).collect()}
    assert sorted(written) == sorted({r["shard"] for r in rows}) and sorted(os.listdir(tmp_path / "out")) == [f"shard-{x:08d}.bin" for x in sorted(written)]
    for r in rows:
        data = (tmp_path / "out" / f"shard-{r['shard']:08d}.bin").read_bytes()
        assert hashlib.sha256(data[r["offset"] : r["offset"] + 128]).hexdigest() == r["sha256"]
        here = op8_token_shards.read_slots("file://" + written[r["shard"]]["path"], r["slot"] - written[r["shard"]]["first"], 1, 64)
        assert hashlib.sha256(here.tobytes()).hexdigest() == r["sha256"]


def test_token_shards_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert op8_token_shards.sequences(op8_token_shards.materialise(spark.createDataFrame([], schema))).count() == 0
    long_ = "word and another word, " * 60_000
    df = spark.createDataFrame([(1, long_), (1, long_), (1, "other")], schema).selectExpr("*", "5 as slot", "6 as shard", "'t' as tokens")
    rows = op8_token_shards.sequences(op8_token_shards.materialise(df)).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    enc = op8_token_shards.encoder(op8_token_shards.default_vocabulary())
    ids = [*enc.encode_ordinary(long_), 50256]
    assert sum(r["n_tokens"] for r in rows) == 2 * len(ids) + len(enc.encode_ordinary("other")) + 1
    for r in rows[:40]:
        if r["n_tokens"] == 512:
            assert r["sha256"] == hashlib.sha256(np.array(ids[r["seq"] * 512 : r["seq"] * 512 + 512], np.uint16).tobytes()).hexdigest()


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_feistel_is_a_permutation(n):
    assert sorted(op8_token_shards.permuted(np.arange(n), n).tolist()) == list(range(n))


def test_channel_restores_words():
    words = "idiot moron trash stupid the river runs and a clown was there with another person".split()
    counts = np.zeros((28,) * 4)
    for w in words * 50:
        s = [0, 0, 0, *(ord(c) - 96 for c in w), 0]
        for i in range(len(s) - 3):
            counts[tuple(s[i : i + 4])] += 1
    p = (counts + 0.01) / (counts.sum(-1, keepdims=True) + 0.28)
    channel = op9_toxicity.Channel(np.log(p).astype(np.float32))
    for seen in (b"an 1d10t was", b"an i d i o t was", b"an idiooooot was", b"an i.d.i.o.t was", b"an !di0t was", b"an idi" + b"o" * 90 + b"t was", b"an " + b"river/" * 30 + b"1d1ot was", b"an 1d|0t was", b"an i.d.i.o.t was", b"an i d i o t"):
        data = np.frombuffer(seen, np.uint8)
        assert b"idiot" in channel.restore(data, np.array([0, len(data)]))[0].tobytes(), seen


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in op9_toxicity.query(spark, sf).collect()}
    labels = dict(duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet'").fetchall())
    held = [(labels[d], r["predicted"]) for d, r in rows.items() if d in labels and r["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.9
    assert all(p == 0 for a, p in held if a == 0)


def test_decoding_takes_linear_time():
    channel = op9_toxicity.Channel(np.full((28,) * 4, -3.3, np.float32))
    took = []
    for n in (2_000, 40_000):
        token, began = b"a1b$c3" * n, time.time()
        channel.decode(token)
        took.append(time.time() - began)
    assert took[1] < 60 * took[0] + 1


def test_regression_finds_the_least_loss():
    rng = np.random.default_rng(4)
    m = rng.random((300, 12)) < 0.3
    y = (m[:, 0] | m[:, 1]).astype(float)
    docs, index = np.nonzero(m)
    w, b = op9_toxicity.regression(y, docs, index, 12, 1.0)
    loss = lambda w, b: np.logaddexp(0, np.where(y > 0, -1, 1) * (m @ w + b)).sum() + 0.5 * (w * w).sum()
    best = loss(w, b)
    assert all(loss(w + rng.normal(0, 0.01, 12), b + rng.normal(0, 0.01)) >= best - 1e-9 for _ in range(200))


def test_toxicity_of_repeated_rows_and_long_texts(spark):
    docs = [(i, ("vile scum " if i % 2 else "calm lake ") * 20 + f"w{i}") for i in range(400)]
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(400)] + [(1, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    rows = [*docs, docs[1], docs[1], (900, "calm lake " * 100_000), (901, "v1le $cum " * 9), (None, "vile scum " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "3 as score", "'l' as label").repartition(3)
    model = op9_toxicity.fit(df, labels)
    got = [(r["doc_id"], r["score__"]) for r in op9_toxicity.scored(df, model).collect()]
    assert len(got) == len(rows) and len({s for d, s in got if d == 1}) == 1
    score = dict(got)
    assert score[900] < 0.3 and score[901] > 0.7 and score[None] > 0.7 and score[1] > 0.7 and score[2] < 0.3
    kept = op9_toxicity.filtered(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {900, *range(0, 400, 2)}


def test_toxicity_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (None, "x"), (2, "")], "doc_id long, text string")
    model = op9_toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [r["score__"] < 0.7 for r in op9_toxicity.scored(docs, model).collect()] == [True] * 3
    assert op9_toxicity.filtered(docs.selectExpr("*", "1 as score"), model).count() == 3
    assert op9_toxicity.scored(docs.limit(0), model).count() == 0
