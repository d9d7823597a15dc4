"""Benchmark decontamination through templates.

Words lose edge punctuation and case; numbers, units and names become typed placeholders. Windows of
`window` template words of the documents probe a chained hash table of the benchmark's (a hash join whose build side is broadcast). Hits of one item on one
diagonal chain to runs of words; a stretch of a run counts if its slots are consistent, that is if equal values in
the item have equal values in the document and different ones different, so that a question asked again
with other numbers or names is found and a chance template is not. A document is contaminated if such a stretch has
`least` words, or all words of a shorter item, and half of its words are no slots, or if a stretch of
that length is verbatim. An item of one or two words is found where it is the whole document.

A capitalised word that opens a sentence is a literal word in one pass and a name in a second one, so that a question
whose sentences begin with a name is found with other names, and a copy without its capitals is too.

Items with equal templates and equal slot patterns are one class, named by the least item_id. The benchmark's
windows are broadcast in blocks of at most BLOCK windows (an item is in one block); after each block but the last what was
found is written with the documents and the broadcast ends, so that memory and plan do not grow with the benchmark.
Nulls: a null text has no words; null ids are kept. Rows that repeat are judged alike. Other columns are
kept under their names or ignored. An empty benchmark contaminates nothing; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats as R
from .common import BYTE_WORDS, Rolling, buffers, free_name, slabs, sql_text, stored, table

U64 = np.uint64
WINDOW, LEAST = 8, 13
#: Windows of the benchmark that are broadcast at once (about 32 MB).
BLOCK = 1_000_000

#: Words for numbers, and units.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half twice"
UNIT_WORDS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces lb pound pounds ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degrees mph kmh meter meters metre metres"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
ENDS = np.zeros(256, bool)
ENDS[list(b".!?:")] = True
NUMBER, UNIT, NAME = (U64(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333))


def hashes_of(words: str) -> np.ndarray:
    data = np.frombuffer(words.encode(), np.uint8)
    _, _, start, end = R.word_edges(data, np.array([0, len(data)]))
    return np.sort(Rolling(BYTE_WORDS[data]).spans(start, end))


NUMBERS, UNITS = hashes_of(NUMBER_WORDS), hashes_of(UNIT_WORDS)


def among(h, known):
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def template(data, at):
    """Template words, the same with every capitalised first word of a sentence or line as a name, literal words
    (hashes), and documents' offsets in words."""
    data, offsets, start, end = R.word_edges(data, at)
    if not len(start):
        return np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, U64), np.zeros(len(at), np.int64)
    n, index = len(data), np.arange(len(data))
    alnum = ALNUM[data]
    first = np.minimum.accumulate(np.where(alnum, index, n)[::-1])[::-1]
    last = np.maximum.accumulate(np.where(alnum, index, -1))
    word_doc = np.searchsorted(offsets, start, "right")
    s, e = first[start], last[end - 1] + 1
    real = (s < end) & (e > start)
    prev_end = np.concatenate([[0], end[:-1]])
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    opens = np.concatenate([[True], word_doc[1:] != word_doc[:-1]]) | ENDS[data[prev_end - 1]] | (lines[start] > lines[prev_end])
    s, e, opens, word_doc = s[real], e[real], opens[real], word_doc[real]
    counts = [np.concatenate([[0], np.cumsum(x)]) for x in (DIGIT[data], UPPER[data], alnum)]
    digits, uppers, letters = (c[e] - c[s] for c in counts)
    letters = letters - digits
    h = Rolling(BYTE_WORDS[LOWER[data]]).spans(s, e)
    out, wide = h.copy(), h.copy()
    name = (UPPER[data[s]]) & (uppers == 1) & (e - s > 1)
    unit, number = among(h, UNITS), ((digits > 0) & (letters <= 3) & DIGIT[data[s]]) | among(h, NUMBERS)
    for t, names in ((out, name & ~opens), (wide, name)):
        t[names], t[unit], t[number] = NAME, UNIT, NUMBER
    return out, wide, h, np.searchsorted(word_doc, np.arange(len(offsets)), "right")


class Items:
    """The benchmark: classes of items, and a hash table of their windows (hash, class, place), chained by the hash's first bits.

    `wide` holds them once more, with first words of sentences as names.
    """

    def __init__(self, texts: list[tuple[int, str]], window: int, wide: bool = False):
        self.ids, self.words, self.values, self.members = [], [], [], []
        self.wide = None if wide else Items(texts, window, True)
        self.whole: dict[bytes, list[int]] = {}  # classes of items under three words by their templates
        seen, rows = {}, []
        for item, text in texts:
            data = np.frombuffer((text or "").encode(), np.uint8)
            narrow, open_too, v, _ = template(data, np.array([0, len(data)]))
            t = open_too if wide else narrow
            slots = np.isin(t, [NUMBER, UNIT, NAME])
            _, pattern = np.unique(v[slots], return_inverse=True)
            key = (t.tobytes(), pattern.tobytes())
            if not len(t):
                continue
            if key in seen:
                self.members[seen[key]].add(item)
                continue
            k, width = seen.setdefault(key, len(self.ids)), min(window, len(t))
            self.members.append({item})
            self.ids.append(item)
            self.words.append(t)
            self.values.append(v)
            if len(t) < 3:
                self.whole.setdefault(t.tobytes(), []).append(k)
                continue
            rolling = Rolling(t)
            place = np.arange(len(t) - width + 1)
            rows.append((rolling.spans(place, place + width), np.full(len(place), k), place))
        cols = [np.concatenate(x) for x in zip(*rows, strict=True)] if rows else [np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        order = np.argsort(cols[0], kind="stable")
        self.hash, self.item, self.place = (c[order] for c in cols)
        self.widths = sorted({min(window, len(t)) for t in self.words if len(t) > 2})
        self.shift = U64(64 - max(10, (2 * len(self.hash)).bit_length()))
        slots = (self.hash >> self.shift).astype(np.int64)
        self.chain = np.concatenate([[0], np.cumsum(np.bincount(slots, minlength=1 << (64 - int(self.shift))))]).astype(np.int32)

    def probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index in h, row of the table) of all equal hashes."""
        slot = (h >> self.shift).astype(np.int64)
        first = self.chain[slot]
        n = self.chain[slot + 1] - first
        at = np.flatnonzero(n)
        index = np.repeat(at, n[at])
        row = np.arange(len(index)) - np.repeat(np.cumsum(n[at]) - n[at], n[at]) + first[index]
        same = self.hash[row] == h[index]
        return index[same], row[same]


def stretches(x, y, slots, need: int):
    """Stretches (start, end) of a run that count as evidence. x, y: values of item and document.

    For each end the longest stretch with consistent slots, half of whose words are no slots, and the longest one
    that is verbatim; both of `need` words at least.
    """
    there, back, lo, same = {}, {}, 0, 0
    x, y, slot = x.tolist(), y.tolist(), slots.tolist()
    before = np.concatenate([[0], np.cumsum(slots)])
    spare = np.arange(len(before)) - 2 * before  # does not fall from start to end if half of the words are no slots
    for i, (p, q) in enumerate(zip(x, y, strict=True)):
        same = same if p == q else i + 1
        if slot[i]:
            lo = max(lo, seen_with(there, p, q, i) + 1, seen_with(back, q, p, i) + 1)
        if i + 1 - same >= need:
            yield same, i + 1
        if i + 1 - lo >= need:
            starts = np.flatnonzero(spare[lo : i + 2 - need] <= spare[i + 1])
            if len(starts):
                yield lo + int(starts[0]), i + 1


def seen_with(last: dict, value: int, partner: int, place: int) -> int:
    """The last place of value with another partner, -1 if there is none; notes this place. last: the two latest partners of each value."""
    known = last.get(value, ())
    other = max((at for o, at in known if o != partner), default=-1)
    last[value] = ((partner, place), *[x for x in known if x[0] != partner][:1])
    return other


def match(t, v, items: Items, hits, least: int):
    """Evidence of one document from its hits (word, row of items.hash): {class: (words, exact)}."""
    best: dict[int, tuple[int, bool]] = {}
    chains: dict[tuple[int, int], list[int]] = {}
    for p, r in hits:
        chains.setdefault((int(items.item[r]), p - int(items.place[r])), []).append(p)
    for (k, shift), starts in chains.items():
        words, values = items.words[k], items.values[k]
        width, need = min(WINDOW, len(words)), min(least, len(words))
        starts = sorted(set(starts))
        lo = 0
        while lo < len(starts):
            hi = lo
            while hi + 1 < len(starts) and starts[hi + 1] == starts[hi] + 1:
                hi += 1
            a, b = starts[lo], starts[hi] + width
            lo = hi + 1
            part = slice(a - shift, b - shift)
            if b - a < need or not np.array_equal(t[a:b], words[part]):
                continue
            x, y = values[part], v[a:b]
            for p, q in stretches(x, y, np.isin(words[part], [NUMBER, UNIT, NAME]), need):
                best[k] = max(best.get(k, (0, False)), (q - p, bool((x[p:q] == y[p:q]).all())))
    return best


EVIDENCE = pa.schema([("item_id", pa.int64()), ("words", pa.int64()), ("exact", pa.bool_())])


def hits_of(t, offsets, doc_of, items: Items, width_of):
    """{document: (word, row of items.hash)} of the windows that the benchmark has."""
    rolling, hits = Rolling(t), {}
    for width in items.widths:
        place = np.arange(max(0, len(t) - width + 1))
        place = place[doc_of[place] == doc_of[place + width - 1]]
        index, row = items.probe(rolling.spans(place, place + width))
        right = width_of[items.item[row]] == width
        for p, r in zip(place[index[right]].tolist(), row[right].tolist(), strict=True):
            d = int(doc_of[p])
            hits.setdefault(d, []).append((p - int(offsets[d]), r))
    return hits


def whole_matches(t, v, items: Items):
    """Evidence of a document of one or two words."""
    best = {}
    for k in items.whole.get(t.tobytes(), ()):
        x = items.values[k]
        if any(b - a == len(t) for a, b in stretches(x, v, np.isin(t, [NUMBER, UNIT, NAME]), len(t))):
            best[k] = (len(t), bool((x == v).all()))
    return best


def search(batches, shared, least, last):
    """Adds evidence to the three lists before the text, which comes last and is left out if `last`."""
    both = (shared.value, shared.value.wide)
    width_of = [np.array([min(WINDOW, len(w)) for w in items.words] or [0]) for items in both]
    for batch in batches:
        data, at = buffers(batch.column(batch.num_columns - 1))
        found = [list(zip(*x, strict=True)) for x in zip(*(batch.column(i).to_pylist() for i in range(-4, -1)), strict=True)]
        for lo, hi in slabs(at, R.SLAB):
            *templates, v, offsets = template(data, at[lo : hi + 1])
            sizes = np.diff(offsets)
            doc_of = np.repeat(np.arange(hi - lo), sizes)
            known: dict[int, set] = {}
            for items, t, width in zip(both, templates, width_of, strict=True):
                evidence = []
                for d, pairs in hits_of(t, offsets, doc_of, items, width).items():
                    part = slice(int(offsets[d]), int(offsets[d + 1]))
                    evidence.append((d, match(t[part], v[part], items, pairs, least)))
                if items.whole:
                    for d in np.flatnonzero((sizes > 0) & (sizes < 3)).tolist():
                        part = slice(int(offsets[d]), int(offsets[d + 1]))
                        evidence.append((d, whole_matches(t[part], v[part], items)))
                for d, best in evidence:
                    # a class whose items are known from the narrow templates is no news
                    best = {k: x for k, x in best.items() if items is both[0] or not items.members[k] & known.get(d, set())}
                    known.setdefault(d, set()).update(items.ids[k] for k in best)
                    found[lo + d] += sorted((items.ids[k], n, exact) for k, (n, exact) in best.items())
        lists = [pa.array([[x[i] for x in f] for f in found], pa.list_(kind)) for i, kind in enumerate((pa.int64(), pa.int64(), pa.bool_()))]
        columns = [*batch.columns[:-4], *lists] + ([] if last else [batch.column(batch.num_columns - 1)])
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[: len(columns)])


def blocks_of(benchmark: DataFrame, block: int):
    """Items in blocks of about `block` windows; equal texts once. They stream through the driver, one block at a time."""
    held, size = [], 0
    rows = benchmark.groupBy(sql_text().alias("text")).agg(F.min(F.col("item_id").cast("long")).alias("item_id"))
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        held.append((row["item_id"], row["text"]))
        size += len(row["text"].split()) + 1
        if size > block:
            yield Items(held, WINDOW)
            held, size = [], 0
    yield Items(held, WINDOW)


def evidence(docs: DataFrame, benchmark: DataFrame, keep: list[str], least: int = LEAST, block: int = BLOCK) -> tuple[DataFrame, list[str]]:
    """The columns `keep` of docs, a row per row, and three lists: ids of matched classes, words, exact. And the lists' names."""
    spark = docs.sparkSession
    own = free_name(keep, "evidence")
    lists = {f"{own}_items": "array<bigint>", f"{own}_words": "array<bigint>", f"{own}_exact": "array<boolean>"}
    out = docs.select(*keep, *[F.array().cast(kind).alias(c) for c, kind in lists.items()], sql_text().alias(f"{own}_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema]
    blocks = blocks_of(benchmark, block)
    items = next(blocks)
    while items:
        shared, items = spark.sparkContext.broadcast(items), next(blocks, None)
        last = items is None
        out = out.mapInArrow(lambda it, s=shared, last=last: search(it, s, least, last), ", ".join(fields[:-1] if last else fields))
        if not last:
            out = stored(out, "evidence")
            shared.unpersist()
    return out, list(lists)


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """doc_id, contaminated, item_id (least of the matched classes), n_items, words (longest run), exact (a run without other slot values)."""
    found, (items, words, exact) = evidence(docs, benchmark, ["doc_id"], least, block)
    n = F.size(items)
    return found.select("doc_id", (n > 0).alias("contaminated"), F.array_min(items).alias("item_id"), n.alias("n_items"), F.coalesce(F.array_max(words), F.lit(0)).alias("words"), F.exists(exact, lambda x: x).alias("exact"))


def cleaned(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """The rows of docs without evidence of the benchmark, with their columns."""
    found, (items, *_) = evidence(docs, benchmark, docs.columns, least, block)
    return found.where(F.size(items) == 0).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
