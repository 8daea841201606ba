"""Benchmark decontamination by the q-gram lemma.

An item of m characters that lies in a text with at most k edits shares at least m + 1 - q (k + 1) of its
q-grams with it, on diagonals (text position less item position) that differ by at most 2k.  Every text
q-gram is looked up in an index of the items; hits are counted in diagonal bands that overlap by half, so
some band holds all hits of a true match; bands that meet the bound are verified by banded alignment.

Items up to a checked number of bytes are sent to all tasks as one index, and texts are scanned once.  Beyond
it, texts are scanned once as well: those q-grams that a filter of fixed size lets through are joined by value
with the items' disjoint q-grams (of an item's m // q, all but k must be there), and only the texts and items
that meet so are brought together, to be counted in bands and aligned as above.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.columns import map_in_arrow, named
from .scratch import Scratch

U64 = np.uint64
Q = 8
#: Edits allowed, as a share of an item's characters.
BUDGET = 0.1
#: Bytes of text scanned at once, and the most bytes of items that are sent to all tasks.
SPAN, BLOCK = 1 << 20, 4 << 20
#: Bits of the filter of q-grams when the items are not sent (8 MB).
FILTER_BITS = 26
_MULTIPLIER = U64(0x9E3779B97F4A7C15)


def _plain_table() -> np.ndarray:
    t = np.full(256, 0x20, np.uint8)
    for r in (range(0x30, 0x3A), range(0x61, 0x7B), range(0x80, 0x100)):
        t[list(r)] = list(r)
    t[0] = 0
    return t


_PLAIN = _plain_table()


def plain(raw: bytes) -> np.ndarray:
    """Lower-case UTF-8 bytes with every run of other ASCII than letters and digits as one space; zero bytes stay."""
    a = _PLAIN[np.frombuffer(raw, np.uint8)]
    space = a == 0x20
    space[1:] &= space[:-1].copy()
    space[:1] = False
    return a[~space]


def _lower(text: str | None) -> bytes:
    return (text or "").lower().replace("\x00", " ").encode("utf-8", "surrogatepass")


def normal(text: str | None) -> bytes:
    """The form in which texts and items are compared; edits count its bytes."""
    return plain(_lower(text)).tobytes().strip()


def grams(a: np.ndarray) -> np.ndarray:
    """All q-grams of a byte array, as 64-bit words."""
    if len(a) < Q:
        return np.zeros(0, np.uint64)
    w = a.astype(np.uint64)
    for width in (1, 2, 4):
        w = w[:-width] | w[width:] << U64(8 * width)
    return w


@dataclass(frozen=True)
class Index:
    """Items with their edit budgets, least hits and band shifts; q-grams in order with their places (item, position)."""

    ids: list[int | None]
    items: list[bytes]
    edits: np.ndarray
    least: np.ndarray
    shift: np.ndarray
    codes: np.ndarray
    starts: np.ndarray
    item: np.ndarray
    place: np.ndarray
    table: np.ndarray
    lift: np.uint64

    @property
    def reach(self) -> int:
        """Bytes of text that a match can span, at most."""
        return max((len(x) + int(k) for x, k in zip(self.items, self.edits, strict=True)), default=0)


def allowed(m: int, budget: float) -> int:
    """Edits allowed in an item of m bytes: always fewer than its disjoint q-grams."""
    return min(int(m * budget), m // Q - 1)


def build_index(rows: list[tuple[int | None, str | None]], budget: float = BUDGET) -> Index:
    """An index of (id, text). Items of under Q normalised characters match nothing and are left out."""
    kept = [(i, t) for i, t in ((i, normal(t)) for i, t in rows) if len(t) >= Q]
    kept.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    m = np.array([len(t) for _, t in kept], np.int64)
    edits = np.array([allowed(len(t), budget) for _, t in kept], np.int64)
    words = [grams(np.frombuffer(t, np.uint8)) for _, t in kept]
    code = np.concatenate(words) if words else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(kept), dtype=np.int32), [len(w) for w in words])
    place = np.concatenate([np.arange(len(w), dtype=np.int32) for w in words]) if words else np.zeros(0, np.int32)
    order = np.argsort(code, kind="stable")
    codes, starts = np.unique(code[order], return_index=True)
    bits = min(22, max(10, (len(codes) * 16).bit_length()))
    table, lift = np.zeros(1 << bits, bool), U64(64 - bits)
    table[(codes * _MULTIPLIER >> lift).astype(np.int64)] = True
    shift = np.array([max(4, int(4 * k + 1).bit_length()) for k in edits], np.int64)
    return Index([i for i, _ in kept], [t for _, t in kept], edits, m + 1 - Q * (edits + 1), shift, codes, np.append(starts, len(code)), item[order], place[order], table, lift)


def banded(item: bytes, text: bytes, low: int, high: int, most: int) -> tuple[int, int] | None:
    """(edits, end) of the best alignment of the whole item inside text on diagonals low to high; None over `most` edits.

    The start in the text is free on those diagonals; of equal ends the first is taken.
    """
    width = high - low + 1
    a, t = np.frombuffer(item, np.uint8), np.frombuffer(text, np.uint8)
    far = len(item) + most + 1
    steps = np.arange(width)
    cost = np.where((low + steps >= 0) & (low + steps <= len(t)), 0, far)
    padded = np.zeros(max(0, -low) + max(len(t), high + len(a)) + 1, np.uint8)
    base = max(0, -low)
    padded[base : base + len(t)] = t
    for i in range(len(a)):
        at = base + low + i
        differ = padded[at : at + width] != a[i]
        best = cost + differ
        best[:-1] = np.minimum(best[:-1], cost[1:] + 1)
        column = low + i + 1 + steps
        best[(column < 1) | (column > len(t))] = far
        best = np.minimum.accumulate(best - steps) + steps
        cost = np.minimum(best, far)
        if cost.min() > most:
            return None
    j = int(cost.argmin())
    return (int(cost[j]), low + len(a) + j) if cost[j] <= most else None


def _bands(index: Index, piece: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, lowest and highest diagonal) of the bands that meet the bound; piece joins documents that begin at starts."""
    words = grams(piece)
    at = np.flatnonzero(index.table[(words * _MULTIPLIER >> index.lift).astype(np.int64)])
    if not len(at):
        return
    slot = np.searchsorted(index.codes, words[at])
    slot[slot == len(index.codes)] = 0
    real = index.codes[slot] == words[at]
    at, slot = at[real], slot[real]
    times = index.starts[slot + 1] - index.starts[slot]
    total = int(times.sum())
    if not total:
        return
    entry = np.repeat(index.starts[slot] - (np.cumsum(times) - times), times) + np.arange(total)
    pos, item = np.repeat(at, times), index.item[entry]
    doc = np.searchsorted(starts, pos, side="right") - 1
    diagonal = pos - starts[doc] - index.place[entry]
    pair = doc * len(index.ids) + item
    # A pair of document and item needs its least hits on all diagonals before bands are worth counting.
    kinds, which, count = np.unique(pair, return_inverse=True, return_counts=True)
    enough = (count >= index.least[kinds % len(index.ids)])[which]
    pair, item, diagonal, place = pair[enough], item[enough], diagonal[enough], index.place[entry][enough]
    if not len(pair):
        return
    shift, lift = index.shift[item], 1 << 30
    half = 1 << (shift - 1)
    bands = np.concatenate([(diagonal + lift >> shift) * 2, (diagonal + lift + half >> shift) * 2 + 1])
    order = np.lexsort((np.tile(diagonal, 2), bands, np.tile(pair, 2)))
    diagonal, place = np.tile(diagonal, 2)[order], np.tile(place, 2)[order]
    p, b = np.tile(pair, 2)[order], bands[order]
    first = np.ones(len(p), bool)
    first[1:] = (p[1:] != p[:-1]) | (b[1:] != b[:-1])
    heads = np.flatnonzero(first)
    count = np.diff(np.append(heads, len(p)))
    likely = count >= index.least[p[heads] % len(index.ids)]
    heads, count = heads[likely], count[likely]
    for h, n in zip(heads, count, strict=True):
        i = int(p[h]) % len(index.ids)
        least = int(index.least[i])
        # Within the band: some 2k + 1 diagonals that hit enough different places of the item.
        if np.count_nonzero(np.bincount(place[h : h + n])) < least:
            continue
        on, reach = diagonal[h : h + n], 2 * int(index.edits[i])
        until = np.searchsorted(on, on + reach, side="right")
        wide = until - np.arange(n) >= least
        wide[1:] &= until[1:] > until[:-1]  # else the window before holds it
        full = [j for j in np.flatnonzero(wide) if np.count_nonzero(np.bincount(place[h + j : h + until[j]])) >= least]
        if full:
            yield int(p[h]) // len(index.ids), i, int(on[full[0]]), int(on[until[full[-1]] - 1])


def leaks(index: Index, texts: list[str | None]) -> dict[tuple[int, int], tuple[int, int]]:
    """{(row, item): (edits, end)} of items found in texts; of several places that of fewest edits, then the first."""
    found: dict[tuple[int, int], tuple[int, int]] = {}
    if not index.ids:
        return found
    held, held_size = [], 0
    overlap = 2 * index.reach

    def flush():
        joined = np.concatenate([np.append(a, np.uint8(0)) for _, _, a in held])
        starts = np.cumsum([0] + [len(a) + 1 for _, _, a in held[:-1]])
        done: set[tuple[int, int]] = set()
        for d, i, low, high in _bands(index, joined, starts):
            row, offset, a = held[d]
            item, k = index.items[i], int(index.edits[i])
            if (d, i) in done:
                continue
            begin, end = max(0, low - k), min(len(a), high + len(item) + k)
            region = a[begin:end].tobytes()
            exact = region.find(item)
            hit = (0, exact + len(item)) if exact >= 0 else banded(item, region, low - k - begin, high + k - begin, k)
            if hit:
                best = (hit[0], offset + begin + hit[1])
                if best < found.get((row, i), (1 << 60, 0)):
                    found[row, i] = best
                if hit[0] == 0:
                    done.add((d, i))

    for row, text in enumerate(texts):
        a = plain(_lower(text))
        for offset in range(0, max(1, len(a) - overlap), SPAN):
            piece = a[offset : offset + SPAN + overlap]
            held.append((row, offset, piece))
            held_size += len(piece)
            if held_size >= SPAN:
                flush()
                held, held_size = [], 0
    if held:
        flush()
    return found


_HITS = "doc_id bigint, item_id bigint, edits int, end_at bigint, item_length int"


def _texts_of(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the items that have a text; an item may lack an id."""
    return benchmark.where(named(text_col).isNotNull()).select(named(id_col).cast("bigint").alias("id"), named(text_col).alias("text"))


def sent_index(items: DataFrame, budget: float, most: int):
    """The broadcast index of all items (id, text), or None if they have over `most` bytes."""
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > most:
        return None
    return items.sparkSession.sparkContext.broadcast(build_index([(r[0], r[1]) for r in items.collect()], budget))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", budget: float = BUDGET, most: int = BLOCK) -> DataFrame:
    """One row per row of docs and benchmark item within its edit budget: doc_id, item_id, edits, end_at, item_length.

    Texts and items are lower-cased, and each run of ASCII other than letters and digits becomes a space;
    edits and end_at (where the best match ends) count UTF-8 bytes of that form.  An item of m bytes may
    have min(m * budget, m // 8 - 1) edits; items of under 8 match nothing.  Null and empty texts and items
    match nothing; an item without an id counts, with a null item_id.  Rows repeated on either side give rows
    repeated; an empty table on either side gives no rows.
    """
    items = _texts_of(benchmark, item_col, item_text)
    plain = docs.select(named(id_col).cast("bigint").alias("doc_id"), named(text_col).alias("text"))
    index = sent_index(items, budget, most)
    if index is not None:
        return plain.mapInArrow(_find(index), _HITS)
    leaked = _met(plain.select("text"), items, budget)
    return plain.select("doc_id", F.sha2("text", 256).alias("sha")).join(leaked, "sha").select("doc_id", "item_id", "edits", "end_at", "item_length")


def _find(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            hits = sorted(leaks(index.value, batch.column(1).to_pylist()).items())
            x = index.value
            cols = [[ids[r] for (r, _), _ in hits], [x.ids[i] for (_, i), _ in hits], [h[0] for _, h in hits], [h[1] for _, h in hits], [len(x.items[i]) for (_, i), _ in hits]]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "edits", "end_at", "item_length"])

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", budget: float = BUDGET, most: int = BLOCK) -> DataFrame:
    """docs, all columns, without the rows in which ``find_leaks`` finds an item."""
    items = _texts_of(benchmark, item_col, item_text)
    index = sent_index(items, budget, most)
    if index is not None:
        return map_in_arrow(docs, _drop(index, docs.columns.index(text_col)), docs.schema)
    leaked = _met(docs.select(named(text_col).alias("text")), items, budget).select(F.col("sha").alias("leaked_sha")).distinct()
    return docs.join(leaked, F.sha2(docs[f"`{text_col}`"], 256) == leaked["leaked_sha"], "left_anti")


def _drop(index, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = {row for row, _ in leaks(index.value, batch.column(at).to_pylist())}
            yield batch.take(pa.array([i for i in range(batch.num_rows) if i not in bad], pa.int64())) if bad else batch

    return run


def _seeds(budget: float):
    """Of items (item, id, text): rows (item, code, times, least) of their disjoint q-grams; a text within the budget holds `least` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                form = np.frombuffer(normal(text), np.uint8)
                if len(form) >= Q:
                    codes, times = np.unique(grams(form)[::Q], return_counts=True)
                    least = len(form) // Q - allowed(len(form), budget)
                    rows += [(item, c, t, least) for c, t in zip(codes.view(np.int64).tolist(), times.tolist(), strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item", "code", "times", "least"])

    return run


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes * _MULTIPLIER >> U64(64 - FILTER_BITS)).astype(np.int64)


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, bits) of the filter for codes."""
    for batch in batches:
        slot = _slot(batch.column(0).to_numpy().view(np.uint64))
        word, at = np.unique(slot >> 5, return_inverse=True)
        bits = np.zeros(len(word), np.int64)
        np.bitwise_or.at(bits, at, 1 << (slot & 31))
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits)], names=["word", "bits"])


def _codes(passed):
    """(sha, code) of the q-grams of texts that the filter lets through, each once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas = batch.column(0).to_pylist()
            for sha, text in zip(shas, batch.column(1).to_pylist(), strict=True):
                form, kept = plain(_lower(text)), []
                for i in range(0, len(form), SPAN):
                    words = grams(form[i : i + SPAN + Q - 1])
                    slot = _slot(words)
                    kept.append(words[(passed.value[slot >> 5] >> (slot & 31) & 1).astype(bool)])
                codes = np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.uint64)
                if len(codes):
                    yield pa.RecordBatch.from_arrays([pa.array([sha] * len(codes), pa.string()), pa.array(codes.view(np.int64))], names=["sha", "code"])

    return run


def _align(budget: float):
    """Rows (sha, item_id, edits, end_at, item_length) of (sha, text, id, item_text) within the budget."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sha, text, i, item in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                index = build_index([(i, item)], budget)
                rows += [(sha, i, edits, end, len(index.items[0])) for edits, end in leaks(index, [text]).values()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["sha", "item_id", "edits", "end_at", "item_length"])

    return run


def _met(texts: DataFrame, items: DataFrame, budget: float) -> DataFrame:
    """(sha, item_id, edits, end_at, item_length) of distinct texts and items within the budget; nothing that grows is sent to all tasks."""
    spark = texts.sparkSession
    scratch = Scratch(spark, "decontaminate")
    items = scratch.cut(items.withColumn("item", F.monotonically_increasing_id()).select("item", "id", "text"), "items")
    seeds = scratch.cut(items.mapInArrow(_seeds(budget), "item bigint, code bigint, times bigint, least bigint"), "seeds")
    found = seeds.select("code").mapInArrow(_slots, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    keyed = texts.where("text IS NOT NULL").select(F.sha2("text", 256).alias("sha"), "text")
    codes = keyed.mapInArrow(_codes(spark.sparkContext.broadcast(bits)), "sha string, code bigint").distinct()
    met = codes.join(seeds, "code").groupBy("sha", "item").agg(F.sum("times").alias("times"), F.first("least").alias("least")).where("times >= least").select("sha", "item")
    met = scratch.cut(met, "met")
    once = keyed.join(met.select("sha").distinct(), "sha", "left_semi").dropDuplicates(["sha"])
    both = met.join(items.select("item", "id", F.col("text").alias("item_text")), "item").join(once, "sha").select("sha", "text", "id", "item_text")
    return scratch.cut(both.mapInArrow(_align(budget), "sha string, item_id bigint, edits int, end_at bigint, item_length int"), "leaked")
