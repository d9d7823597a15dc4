"""Toxicity of texts behind a noisy channel.

1. A character model (four letters deep, add-k back-off) counts every text of the corpus. Tasks send counts
   for every few MB of text; the model itself has 28^4 cells, a fixed size.
2. Words that look disguised (a stand-in next to a letter, letters held down or doubled twice, letters set apart), of any length, become lattices:
   each character lists the letters it may stand for. Viterbi finds the likeliest letters under the model,
   and they take the word's place.
3. Restored texts give character 5- and 6-grams, spaces counted. Those that stand out in toxic rows
   of a labelled sample (at most `sample` rows, by hash) are the features (at most `FEATURES`) of a logistic regression.

Labels are read only from rows whose crc32(doc_id as text) mod 3 is not 1. Nulls: a null text is
empty; a null doc_id keeps its row, is not held out and has no label. Several labels of one row count as
toxic if one is. Without labels of both kinds every score is the share of toxic labels (0 without any). Rows
that repeat are scored alike; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats as R
from .common import buffers, free_name, mix, slabs, sql_text, stored, table

U64 = np.uint64
LETTERS, ORDER = 28, 4
SIZE = LETTERS**ORDER
BOUNDARY, OTHER = 0, 27
#: Letters that a character may stand for.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c"}
APART = b" .-_*\t"
LEAD, TRAIL = b".,?;:\"'([", b".,!?;:\"')]"
#: Bytes of a word up to which its decoding is remembered; longer ones are decoded each time, in a time linear in their length.
REMEMBERED = 64
#: Bounds of the model: rows of the labelled sample, and features, those with the greatest z.
SAMPLE, FEATURES = 24_000, 8192
PENALTY = 0.5
THRESHOLD = 0.7
#: Doubled letters, separators inside a word and letters set apart from which a word is taken as disguised.
DOUBLED, DOTS, APART_WORDS = 2, 2, 3

SYMBOL = np.full(256, OTHER, np.uint8)
SYMBOL[:128] = BOUNDARY
SYMBOL[48:58] = OTHER
for _c in range(26):
    SYMBOL[[65 + _c, 97 + _c]] = _c + 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_LETTER = np.zeros(256, bool)
IS_LETTER[97:123] = True
IS_LEET = np.zeros(256, bool)
IS_LEET[[ord(c) for c in STANDS_FOR]] = True
IS_APART = np.zeros(256, bool)
IS_APART[list(APART)] = True
#: What n-grams see: letters in lower case, other ASCII as a space, bytes of other letters as they are.
SEEN = np.where(IS_LETTER[LOWER] | (np.arange(256) >= 128), LOWER, 32).astype(np.uint8)


def count_grams(batches):
    """(code, n) of the character 4-grams of a few MB of text at a time."""
    schema = pa.schema([("code", pa.int32()), ("n", pa.int64())])
    for batch in batches:
        data, at = buffers(batch.column(0))
        for lo, hi in slabs(at, 4 << 20):
            s = SYMBOL[data[at[lo] : at[hi]]].astype(np.int32)
            if len(s) < ORDER:
                continue
            code = ((s[:-3] * LETTERS + s[1:-2]) * LETTERS + s[2:-1]) * LETTERS + s[3:]
            inside = np.ones(len(code), bool)
            for back in range(1, ORDER):
                cut = at[lo + 1 : hi] - at[lo] - back
                inside[cut[(cut >= 0) & (cut < len(code))]] = False
            n = np.bincount(code[inside], minlength=SIZE)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some])], schema=schema)


def language_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities [a, b, c, d] of d after abc, from all texts."""
    rows = docs.select("text").mapInArrow(count_grams, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = np.zeros(SIZE)
    found = rows.toArrow()  # at most 28^4 rows
    counts[np.asarray(found.column("code"))] = np.asarray(found.column("n"))
    n = counts.reshape((LETTERS,) * ORDER)
    p = (n.sum((0, 1, 2)) + 1) / (n.sum() + LETTERS)
    for level in (2, 1, 0):
        m = n.sum(tuple(range(level)))
        p = (m + 5 * p) / (m.sum(-1, keepdims=True) + 5)
    return np.log(p).astype(np.float32)


class Channel:
    def __init__(self, model: np.ndarray):
        self.model = model
        self.restored = lru_cache(50_000)(self.decode)

    def lattice(self, token: bytes):
        """For each place, what it may stand for: (symbols, log probability)."""
        text, i, out = token.decode("latin-1").lower(), 0, []
        while i < len(text):
            c, j = text[i], i + 1
            if "a" <= c <= "z":
                while j < len(text) and text[j] == c:
                    j += 1
                s = ord(c) - 96
                out.append([((s,), 0.0)] if j == i + 1 else [((s,), -0.7), ((s, s), -0.7)])
            elif c in STANDS_FOR:
                while j < len(text) and text[j] == c:
                    j += 1
                options = [(ord(x) - 96,) for x in STANDS_FOR[c]]
                if j > i + 1:
                    options += [x * 2 for x in options]
                out.append([(x, -0.2 - np.log(len(options))) for x in options] + [((OTHER,), -3.0)])
            elif ord(c) < 128 and IS_APART[ord(c)]:
                out.append([((), -0.1), ((BOUNDARY,), -2.5)])
            else:
                out.append([((OTHER,), 0.0)])
            i = j
        return out

    def decode(self, token: bytes) -> bytes:
        states = {(0, 0, 0): (0.0, ())}
        for place in self.lattice(token):
            new = {}
            for (a, b, c), (score, path) in states.items():
                for symbols, cost in place:
                    x, y, z, s = a, b, c, score + cost
                    for d in symbols:
                        s += self.model[x, y, z, d]
                        x, y, z = y, z, d
                    if (x, y, z) not in new or s > new[x, y, z][0]:
                        new[x, y, z] = (s, (path, symbols))
            states = new
        (_, path) = max(((s + self.model[k + (BOUNDARY,)], p) for k, (s, p) in states.items()), key=lambda x: x[0])
        out = []
        while path:
            path, symbols = path
            out.append(symbols)
        return bytes(32 if d == BOUNDARY else 63 if d == OTHER else d + 96 for x in reversed(out) for d in x)

    def restore(self, data: np.ndarray, at: np.ndarray):
        """Texts with disguised words restored: bytes and offsets."""
        data, offsets, start, end = R.word_edges(data, at)
        if not len(start):
            return data, offsets
        low = LOWER[data]
        letter, leet = IS_LETTER[low], IS_LEET[data]
        nxt = np.concatenate([low[1:], [0]])
        nxt2 = np.concatenate([low[2:], [0, 0]])[: len(low)]
        last = np.zeros(len(low), bool)
        last[end - 1] = True

        def per_word(x):
            total = np.concatenate([[0], np.cumsum(x)])
            return total[end] - total[start]

        before = np.concatenate([[False], letter[:-1]])
        hit = leet & ((IS_LETTER[nxt] & ~last) | (before & last & (data < 58)))
        size, n_letters, n_leet = end - start, per_word(letter), per_word(leet)
        pair = letter & (low == nxt) & ~last
        held = per_word(pair & (nxt == nxt2)) > 0
        doubled = per_word(pair & ~np.concatenate([[False], pair[:-1]])) >= DOUBLED
        dots = per_word(IS_APART[data] & before & IS_LETTER[nxt] & ~last)
        dotted = (dots >= DOTS) & (2 * dots + 1 >= size - 2)
        lone = (size == 1) | ((size == 2) & IS_APART[data[np.minimum(start + 1, len(data) - 1)]])
        lone &= letter[start] | leet[start]
        word_doc = np.searchsorted(offsets, start, "right")
        edge = np.flatnonzero(np.concatenate([[True], (lone[1:] != lone[:-1]) | (word_doc[1:] != word_doc[:-1]), [True]]))
        flagged = (per_word(hit) > 0) & (3 * n_letters >= n_leet) | held | doubled | dotted
        spans = [(int(start[i]), int(end[i])) for i in np.flatnonzero(flagged & ~lone)]
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if b - a >= APART_WORDS and lone[a]:
                spans.append((int(start[a]), int(end[b - 1])))
        if not spans:
            return data, offsets
        spans.sort()
        raw, out, cut, done = data.tobytes(), [], [], 0
        for a, b in spans:
            token = raw[a:b]
            inner = token.lstrip(LEAD)
            core = inner.rstrip(TRAIL)
            a += len(token) - len(inner) if core else 0
            new = self.restored(core) if len(core) <= REMEMBERED else self.decode(core)
            out += [raw[done:a], new]
            done = a + len(core)
            cut.append((done, len(new) - len(core)))
        out.append(raw[done:])
        ends, delta = np.array([c[0] for c in cut]), np.concatenate([[0], np.cumsum([c[1] for c in cut])])
        return np.frombuffer(b"".join(out), np.uint8), offsets + delta[np.searchsorted(ends, offsets, "right")]


def grams(data, offsets):
    """(code, document) of all character 5- and 6-grams inside documents."""
    low = SEEN[data].astype(U64)
    five = low[:-4].copy() if len(low) >= 5 else low[:0]
    for i in range(1, 5):
        five = (five << U64(8)) | low[i : len(low) - 4 + i]
    six = (five[:-1] << U64(8)) | low[5:] if len(low) >= 6 else low[:0]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for code, k in ((five, 5), (six, 6)):
        d = doc[: len(code)]
        yield code, d, d == doc[k - 1 : k - 1 + len(code)]


def padded(data, offsets):
    """Texts with a space before and after each."""
    n = len(offsets) - 1
    out = np.full(len(data) + 2 * n, 32, np.uint8)
    out[np.arange(len(data)) + 1 + 2 * np.repeat(np.arange(n), np.diff(offsets))] = data
    return out, offsets + 2 * np.arange(n + 1)


class Features:
    """Exact membership in a sorted list of codes, behind a bitmap of 2^22 hashes."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.sort(codes)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.slot(self.codes)] = True

    @staticmethod
    def slot(code):
        return ((code * U64(0x9E3779B97F4A7C15)) >> U64(42)).astype(np.int64)

    def present(self, data, offsets):
        """(document, index) of each feature once."""
        docs, index, width = [], [], max(1, len(self.codes))
        if len(self.codes):
            for code, doc, inside in grams(*padded(data, offsets)):
                at = np.flatnonzero(self.bits[self.slot(code)])
                at = at[inside[at]]
                i = np.minimum(np.searchsorted(self.codes, code[at]), len(self.codes) - 1)
                ok = self.codes[i] == code[at]
                docs.append(doc[at][ok])
                index.append(i[ok])
        pair = np.unique(np.concatenate([*docs, np.zeros(0, np.int64)]) * width + np.concatenate([*index, np.zeros(0, np.int64)]))
        return pair // width, pair % width


def restored_slabs(batch, column, channel, size=1 << 20):
    data, at = buffers(batch.column(column))
    for lo, hi in slabs(at, size):
        yield lo, hi, *channel.restore(data, at[lo : hi + 1])


def gram_labels(batches, model):
    """(code, toxic, clean): sampled rows that hold a gram."""
    channel, schema = Channel(model.value), pa.schema([("code", pa.int64()), ("toxic", pa.int64()), ("clean", pa.int64())])
    for batch in batches:
        label = np.asarray(batch.column(1)).astype(np.int64)
        for lo, hi, data, offsets in restored_slabs(batch, 0, channel):
            data, offsets = padded(data, offsets)
            for code, doc, inside in grams(data, offsets):
                code, doc = code[inside], doc[inside]
                order = np.argsort(code, kind="stable")  # documents stay in order within a code
                code, doc = code[order], doc[order]
                new = np.concatenate([[True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])]) if len(code) else np.zeros(0, bool)
                code, y = code[new], label[lo:hi][doc[new]]
                first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
                if len(first):
                    toxic = np.add.reduceat(y, first)
                    n = np.diff(np.append(first, len(code)))
                    yield pa.RecordBatch.from_arrays([pa.array(code[first].view(np.int64)), pa.array(toxic), pa.array(n - toxic)], schema=schema)


def encode(batches, model, codes):
    channel, features, schema = Channel(model.value), Features(codes), pa.schema([("y", pa.int32()), ("at", pa.binary())])
    for batch in batches:
        label = batch.column(1).to_pylist()
        for lo, hi, data, offsets in restored_slabs(batch, 0, channel):
            doc, index = features.present(data, offsets)
            cut = np.searchsorted(doc, np.arange(hi - lo + 1))
            yield pa.RecordBatch.from_arrays([pa.array(label[lo:hi], pa.int32()), pa.array([index[a:b].astype(np.int16).tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())], schema=schema)


def regression(y, docs, index, width, penalty=PENALTY, rounds=10, inner=12):
    """Logistic regression on presence features: Newton's steps, each by conjugate gradients. docs is sorted."""
    n, x, p0 = len(y), np.zeros(width + 1), np.clip(y.mean(), 1e-3, 1 - 1e-3)
    x[-1] = np.log(p0 / (1 - p0))  # the last one is the bias
    weights = np.append(np.full(width, penalty), 1e-6)
    forth = lambda v: np.bincount(docs, weights=v[index], minlength=n) + v[-1]
    back = lambda g: np.append(np.bincount(index, weights=g[docs], minlength=width), g.sum())
    loss = lambda v, z: np.logaddexp(0, np.where(y > 0, -z, z)).sum() + 0.5 * (weights * v * v).sum()
    z = forth(x)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        curve = np.maximum(p * (1 - p), 1e-9)
        residual = -(back(p - y) + weights * x)
        size = start = float(residual @ residual)
        scale = back(curve) + weights  # the Hessian's diagonal, since features are 0 or 1
        step, lead = np.zeros_like(x), residual / scale
        fit = float(residual @ lead)
        for _ in range(inner):
            if size <= 1e-4 * start or fit <= 0:
                break
            image = back(curve * forth(lead)) + weights * lead
            rate = fit / float(lead @ image)
            step, residual = step + rate * lead, residual - rate * image
            size, ahead = float(residual @ residual), residual / scale
            fit, before = float(residual @ ahead), fit
            lead = ahead + fit / before * lead
        was, length = loss(x, z), 1.0
        while length > 1e-4 and loss(x + length * step, forth(x + length * step)) > was:
            length /= 2
        if length <= 1e-4:
            break
        x = x + length * step
        z = forth(x)
        if was - loss(x, z) < 1e-3 * was:
            break
    return x[:-1], float(x[-1])


class Model:
    def __init__(self, language, codes, weights, bias):
        self.language, self.codes, self.weights, self.bias = language, codes, weights, bias


def held_out(column="doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", sql_text().alias("text"))
    language = language_model(docs)
    shared = spark.sparkContext.broadcast(language)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.join(known, "doc_id").groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("y").alias("y")).select("text", "y")
    rows = stored(rows, "labelled")
    total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    n, n1 = int(total[0]), int(total[1])
    if not n1 or n1 == n:
        return Model(language, np.zeros(0, U64), np.zeros(0), 30.0 * (1 if n1 else -1))
    counts = rows.mapInArrow(lambda it: gram_labels(it, shared), "code long, toxic long, clean long").groupBy("code").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    share = (F.col("toxic") + F.col("clean")) / n
    z = (F.col("toxic") / n1 - F.col("clean") / (n - n1)) / F.sqrt(share * (1 - share) * (1 / n1 + 1 / (n - n1)))
    best = counts.where("toxic >= 3").withColumn("z", z).where("z >= 5").orderBy(F.desc("z"), "code").limit(FEATURES).select("code").toArrow()
    codes = np.sort(np.asarray(best.column("code")).astype(np.int64).view(U64))
    coded = rows.mapInArrow(lambda it: encode(it, shared, codes), "y int, at binary").toArrow()  # at most `sample` rows
    y = np.asarray(coded.column("y")).astype(float)
    at = [np.frombuffer(x, np.int16).astype(np.int64) for x in coded.column("at").to_pylist()]
    width = max(1, len(codes))
    w, b = regression(y, np.repeat(np.arange(len(y)), [len(x) for x in at]), np.concatenate([*at, np.zeros(0, np.int64)]), width)
    return Model(language, codes, w, b)


def score_batches(batches, model, at, drop, name):
    """Adds scores of the texts in column `at`; leaves that column out if `drop`."""
    m = model.value
    channel, features = Channel(m.language), Features(m.codes)
    for batch in batches:
        out = np.zeros(batch.num_rows)
        texts = pa.RecordBatch.from_arrays([pc.fill_null(batch.column(at), "")], names=["text"])
        for lo, hi, data, offsets in restored_slabs(texts, 0, channel):
            doc, index = features.present(data, offsets)
            total = m.bias + (np.bincount(doc, weights=m.weights[index], minlength=hi - lo) if len(doc) else np.zeros(hi - lo))
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        keep = [i for i in range(batch.num_columns) if not (drop and i == at)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(out)], names=[*(batch.schema.names[i] for i in keep), name])


def scored(docs: DataFrame, model: Model, keep: list[str] = ("doc_id",), name: str = "score__") -> DataFrame:
    """The columns `keep` of docs and the score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    drop = "text" not in keep
    part = docs.select(*keep, *(["text"] if drop else [])).withColumn("text", F.col("text").cast("string"))
    at = part.columns.index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema if f.name in keep) + f", {name} double"
    return part.mapInArrow(lambda it: score_batches(it, shared, at, drop, name), fields)


def filtered(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose texts score below the threshold, with their columns."""
    name = free_name(docs.columns, "score__")
    return scored(docs, model, docs.columns, name).where(F.col(name) < threshold).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, model).withColumnRenamed("score__", "score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
