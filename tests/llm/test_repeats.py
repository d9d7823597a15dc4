import random

import numpy as np
import pytest

from tapquarry.llm import induced, op3_suffix_dedup, op7_debruijn_dedup, op10_minhash, repeats
from tapquarry.llm.graph import _joined, components

from . import brute

SCHEMA = "doc_id long, text string"
EDGE_CASES = [(1, None), (2, ""), (3, "a" * 500), (4, "a" * 500), (5, " \n\t "), (6, "word"), (7, "word"), (8, "x y " * 60), (8, "x y " * 60), (9, "é" * 120)]


def mixed(rng, letters, n=90):
    base = "".join(rng.choice(letters) for _ in range(3000))
    line = "".join(rng.choice("xyz ") for _ in range(160))
    docs = []
    for d in range(n):
        t = ""
        for _ in range(rng.randint(0, 4)):
            a = rng.randint(0, 2800)
            t += base[a : a + rng.randint(1, 500)] + "".join(rng.choice(letters) for _ in range(rng.randint(0, 120)))
            if rng.random() < 0.4:
                t += line
        docs.append((d, t))
    return docs


@pytest.mark.parametrize("hot", [4, repeats.HOT])
@pytest.mark.parametrize("operator,model", [(op3_suffix_dedup.suffix_dedup, brute.op3), (op7_debruijn_dedup.debruijn_dedup, brute.op7)])
def test_same_as_brute_force(spark, operator, model, hot):
    docs = mixed(random.Random(5), "ab  cd") + [(1000 + d, t) for d, t in EDGE_CASES]
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 as lo", "'x' as key").repartition(3)
    assert sorted(map(tuple, operator(df, hot=hot).collect())) == model(docs)


@pytest.mark.parametrize("operator,model", [(op3_suffix_dedup.suffix_dedup, brute.op3), (op7_debruijn_dedup.debruijn_dedup, brute.op7)])
def test_many_rows_of_one_id(spark, monkeypatch, operator, model):
    """Unlike rows of one id, none among them, and an anchor that is hot though no task sees it often."""
    monkeypatch.setattr(repeats, "THIN", 2)
    docs = [((None if d % 3 == 1 else 7 if d % 3 else d), t) for d, t in mixed(random.Random(8), "ab  cd", 60)]
    df = spark.createDataFrame(docs + docs[:9], SCHEMA).repartition(5)
    named = {(r["doc_id"], r["text"]): r["h"] for r in df.selectExpr("*", "xxhash64(text) as h").collect()}
    order = sorted(set(docs), key=lambda x: (-1 if x[0] is None else x[0], named[x]))
    judged = dict(zip(order, (x[1:] for x in model(list(enumerate(x[1] for x in order)))), strict=True))
    assert sorted(map(str, map(tuple, operator(df).collect()))) == sorted(str((x[0], *judged[x])) for x in docs + docs[:9])


@pytest.mark.parametrize("operator", [op3_suffix_dedup.suffix_dedup, op7_debruijn_dedup.debruijn_dedup])
def test_empty_and_null_ids(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    got = operator(spark.createDataFrame([(None, text), (3, text)], SCHEMA), texts=True).collect()
    assert {r["doc_id"]: r["n_removed"] > 0 for r in got} == {None: False, 3: True}
    assert {r["doc_id"]: bytes(r["kept"]).decode() for r in got} == {None: text, 3: ""}


def suffixes(t, cap):
    order = sorted(range(len(t)), key=lambda i: t[i:])
    lcp = [0]
    for a, b in zip(order, order[1:], strict=False):
        k = 0
        while k < cap and max(a, b) + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        lcp.append(k)
    return order, lcp


@pytest.mark.parametrize("base", [0, 6, 1 << 19])
def test_induced_sorting(monkeypatch, base, tmp_path):
    monkeypatch.setattr(induced, "BASE", base)
    monkeypatch.setattr(induced, "IN_MEMORY", 8)  # queues go to files
    rng = np.random.default_rng(base)
    for _ in range(120):
        t = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(0, 90)), 0).astype(np.int64)
        cap = int(rng.integers(2, 30))
        order, lcp = induced.sort_suffixes(t, cap, str(tmp_path))
        assert (order.tolist(), lcp.tolist()) == suffixes(t.tolist(), cap)


def test_a_lot_larger_than_memory_goes_to_disk_and_recurses(monkeypatch, tmp_path):
    """With the production bounds: a lot's queues go to files, and its LMS string is sorted by recursion."""
    rng = np.random.default_rng(1)
    text = rng.integers(0, 4, 2_400_000).astype(np.uint8)
    text[700_000:700_400] = text[100_000:100_400]
    text[[99_999, 100_400]], text[[699_999, 700_400]] = 0, 1
    files, depths = [], []
    disk, sort = induced.on_disk, induced.sort_suffixes
    monkeypatch.setattr(induced, "on_disk", lambda x, folder: files.append(out := disk(x, folder)) or out)
    monkeypatch.setattr(induced, "sort_suffixes", lambda t, cap=0, folder=None: depths.append(len(t)) or sort(t, cap, folder))
    monkeypatch.setattr(op3_suffix_dedup, "sort_suffixes", induced.sort_suffixes)
    one = lambda x, kind: np.array([x], kind)
    (d, p), _ = op3_suffix_dedup.repeats_in(one(5, np.uint64), one(1, np.int64), one(0, np.int64), one(len(text), np.int64), one(0, np.uint8), text, 100)
    assert sorted(p.tolist()) == list(range(700_000, 700_301)) and set(d.tolist()) == {1}
    assert len(depths) > 1 and sum(isinstance(x, np.memmap) for x in files) > 5


@pytest.mark.parametrize("hot,crowded,block", [(2, 2, 3), (32, 16, 512)])
def test_near_duplicates_same_as_brute_force(spark, hot, crowded, block):
    rng, docs = random.Random(5), []
    vocabulary = [f"w{i}" for i in range(300)]
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.choice([1, 1, 2, 3, 12])):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            docs.append((len(docs) * 3, " ".join(own)))
    docs += [(9990, ""), (9991, None), (9992, "a"), (9993, "A"), (9994, "")]
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "0 as n", "'k' as keys").coalesce(1)
    assert sorted(map(tuple, op10_minhash.near_duplicates(df, hot=hot, crowded=crowded, block=block).collect())) == brute.op10(docs)


@pytest.mark.parametrize("block", [100, 512])
def test_near_duplicates_of_a_large_family(spark, block):
    """Several hundred copies of one text, edited on their own, so that their similarity lies around the threshold."""
    rng = random.Random(11)
    base, docs = [f"b{i}" for i in range(300)], []
    for d in range(600):
        own = list(base)
        for p in rng.sample(range(300), rng.randint(6, 39)):
            own[p] = f"d{d}x{p}"
        docs.append((d, " ".join(own)))
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    got = op10_minhash.near_duplicates(df, shingle=1, block=block).collect()
    assert sorted(map(tuple, got)) == brute.op10(docs, 1)


def test_near_duplicates_along_drifting_chains(spark):
    """Each document is near the one before it, and the ends are far apart."""
    rng, docs = random.Random(3), []
    for chain in range(8):
        own = [f"c{chain}w{i}" for i in range(200)]
        for step in range(50):
            for p in rng.sample(range(200), 9):
                own[p] = f"c{chain}s{step}p{p}"
            docs.append((len(docs), " ".join(own)))
    rng.shuffle(docs)
    got = op10_minhash.near_duplicates(spark.createDataFrame(docs, SCHEMA), shingle=1, crowded=4, block=7).collect()
    assert sorted(map(tuple, got)) == brute.op10(docs, 1)


def test_near_duplicates_odd_tables(spark):
    assert op10_minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    got = op10_minhash.near_duplicates(spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (5, "z")], SCHEMA)).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == [("4", "None", False), ("4", "None", False), ("5", "5", True), ("None", "None", True)]


def test_texts_of_one_id_are_judged_each_for_itself(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    near = b + " more"
    docs = [(7, a), (7, b), (8, near), (9, c), (None, c)]
    got = op10_minhash.near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == [("7", "7"), ("7", "7"), ("8", "7"), ("9", "None"), ("None", "None")]


def test_deduplicated_keeps_unlike_rows(spark):
    texts = [" ".join(f"{x}{i}" for i in range(40)) for x in "abcde"]
    docs = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4])]
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 as kept_id__x", "'n' as node", "2 as component")
    assert sorted(map(str, op10_minhash.deduplicated(df).collect())) == sorted(map(str, df.collect()))
    docs += [(None, texts[0])] * 3 + [(1, texts[0] + " z"), (2, ""), (2, ""), (3, None), (None, "")]
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "'n' as node")
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in op10_minhash.deduplicated(df).collect())
    assert got == sorted([(str(d), str(t)) for d, t in docs[:5]] + [("2", ""), ("2", ""), ("3", "None"), ("None", "")])
    assert op10_minhash.deduplicated(df.limit(0)).count() == 0


@pytest.mark.parametrize("in_one_task", [0, 10_000])
def test_components_by_stars_and_in_one_task(spark, in_one_task):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(250)] + [(1000, x) for x in range(1001, 1100)] + [(5, 5)]
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long"), in_one_task).collect()}
    want = {x: find(x) for p in links for x in p}
    assert {x: c for x, c in want.items() if x in got} == got and all(want[x] == x for x in want.keys() - got.keys())


def test_components_of_a_chain():
    import pyarrow as pa

    u, v = np.arange(0, 99), np.arange(1, 100)
    rows = {}
    for b in _joined([pa.RecordBatch.from_arrays([pa.array(u[::-1]), pa.array(v[::-1])], names=["u", "v"])]):
        rows |= dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    assert set(rows.values()) == {0} and len(rows) == 100
