"""Exact n-gram Jaccard join through parity sketches.

A document's set holds the 64-bit hashes of its distinct word shingles.  A parity sketch XORs a hash of every
shingle into one of its words.  A pair at the threshold has at most D = (1 - t) / (1 + t) * (|A| + |B|)
elements apart; dealt by hash into P > D words, some word must agree (the pigeonhole key), and the Hamming
distance of sketches of one bit a shingle never exceeds the number of elements apart (the filter).

Sizes fall into bands, each 1/t times the last, so that linked sets lie in one band or in neighbours.  A
document has words for its own band's scheme and for the next one's.  In any order of keys that all sets
share, at most D words of either set come before the first that both hold, so the first D + 1, D for its
largest partner, are enough.  The order puts frequent keys last (a passage that many documents hold fills
words of its own) and words of few elements after fuller ones: strangers seldom meet.  Which keys count as
frequent changes only the work, never the links.

Keys are never stored: they are worked out from the texts for the counts, from the texts again for the
first meeting, and from the sets of those that met after that.

Documents of equal sets are one class.  Classes that hold a key are compared pair by pair, never through
others: first each with one head of the key's bucket; then buckets whose members are not yet in one
component get other heads; what is left is compared in full, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from ..operators.columns import named
from .scratch import Scratch
from .words import U64, mix, shingle_set, word_hashes

#: Bytes of sets, and sets, that are held in a task at once, about: a block. Two blocks meet in a task.
BLOCK_BYTES, BLOCK_SETS = 2 << 20, 250
#: Keys in the list of frequent ones (8 bytes each, sent to all tasks), and the least count that makes a key frequent.
FREQUENT, FREQUENT_FROM = 1 << 17, 32
#: Most rounds in which the members of mixed buckets meet one head each, before the rest meet each other; none
#: are needed while every mixed bucket fits so many blocks.
ROUNDS, IN_FULL = 4, 8


class Bands:
    """Size bands and part counts for a Jaccard threshold num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.low = num, den, [1]
        self.schemes: dict[int, list[tuple[int, int, int]]] = {}
        self.salts: dict[int, np.ndarray] = {}

    def of(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(self.den * self.low[-1] // self.num + 1)
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def salt(self, scheme: int, words: int) -> np.ndarray:
        """A hash of each word's place in the scheme."""
        if scheme not in self.salts:
            self.salts[scheme] = mix(mix(np.arange(words, dtype=np.uint64)) + U64(scheme))
        return self.salts[scheme].copy()

    def most_apart(self, total: int) -> int:
        """Largest symmetric difference of a linked pair with |A| + |B| = total."""
        return (self.den - self.num) * total // (self.den + self.num)

    def parts(self, band: int) -> int:
        """Parts of the scheme that meets sets of this band with each other and the band below: half more than needed, to choose from; none if only equal sets link."""
        apart = self.most_apart(2 * self.high(band))
        return (apart + 1) * 3 // 2 if apart else 0

    def high(self, band: int) -> int:
        """The largest size in a band."""
        while len(self.low) < band + 2:
            self.low.append(self.den * self.low[-1] // self.num + 1)
        return self.low[band + 1] - 1


def part_words(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The bit sketch: `parts` words of 64 bits, each element's bit flipped."""
    at = mix(hashes) % U64(parts * 64)
    odd = np.bincount(at.astype(np.int64), minlength=parts * 64).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.uint64)


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    """A bit sketch of about 8 bits a shingle; the number of words is a power of 2."""
    return part_words(hashes, 1 << max(0, (len(hashes) // 8).bit_length() - 1))


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch of fewer words (both powers of 2) of the same set."""
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def schemes(n: int, bands: Bands) -> list[tuple[int, int, int]]:
    """(scheme, words, words that a set of n must be known by) of the schemes that it takes part in."""
    if n not in bands.schemes:
        band = bands.of(n)
        found = ((scheme, bands.parts(scheme)) for scheme in (band, band + 1))
        bands.schemes[n] = [(scheme, parts, bands.most_apart(n + min(n * bands.den // bands.num, bands.high(scheme))) + 1) for scheme, parts in found if parts]
    return bands.schemes[n]


def digests(hashes: np.ndarray, bands: Bands, at: np.ndarray | None = None) -> np.ndarray:
    """64-bit keys of all words of both schemes, scheme by scheme, fuller words first; sets share a key iff a word agrees (or by a rare collision). at: mix(hashes), if known."""
    keys, at = [], mix(hashes) if at is None else at
    for scheme, parts, _ in schemes(len(hashes), bands):
        part = (at >> U64(32)) * U64(parts) >> U64(32)
        part = part.astype(np.uint16 if parts <= 1 << 16 else np.int64)  # short numbers are sorted by radix
        count = np.bincount(part, minlength=parts)
        some = np.flatnonzero(count)
        held = bands.salt(scheme, parts)
        held[some] ^= np.bitwise_xor.reduceat(hashes[np.argsort(part, kind="stable")], (np.cumsum(count) - count)[some])
        key = mix(held)
        keys.append(key[np.lexsort((key, -count))])
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def signature(hashes: np.ndarray, at: np.ndarray | None = None) -> tuple[int, int]:
    """128 bits of a set, as two signed integers."""
    one, two = int((mix(hashes) if at is None else at).sum(dtype=np.uint64)), int(hashes.sum(dtype=np.uint64))
    return one - (one >> 63 << 64), two - (two >> 63 << 64)


class Counts:
    """The most frequent of many keys: exact counts while there are few kinds, else a lower bound."""

    def __init__(self, kinds: int = 1 << 15, gather: int = 1 << 20):
        self.kinds, self.gather, self.held = kinds, gather, 0
        self.new: list[np.ndarray] = []
        self.keys, self.times = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        self.new.append(keys)
        self.held += len(keys)
        if self.held >= self.gather:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        found, times = np.unique(np.concatenate(self.new), return_counts=True)
        found, times = found[times > 1], times[times > 1]
        keys, where = np.unique(np.concatenate([self.keys, found]), return_inverse=True)
        times = np.bincount(where, np.concatenate([self.times, times]), len(keys)).astype(np.int64)
        if len(keys) > self.kinds:
            best = np.sort(np.argpartition(-times, self.kinds)[: self.kinds])
            keys, times = keys[best], times[best]
        self.keys, self.times, self.new, self.held = keys, times, [], 0


#: Rows of documents (frequent false), and of frequent keys (n their count, h1 the key).
_SIGN = "doc_id bigint, n bigint, h1 bigint, h2 bigint, frequent boolean"
#: A class is known by so many bits of h1 where its keys first meet; pairs of labels lead to all classes that have them.
LABEL = 2**63 - 1


def _sign_batch(ids, n, h1, h2, frequent: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array([frequent] * len(n), pa.bool_())], names=["doc_id", "n", "h1", "h2", "frequent"])


class Seen:
    """The classes whose keys a task has worked out: up to a bound, each does so once."""

    def __init__(self, most: int = 100_000):
        self.most, self.signs = most, set()

    def new(self, sign: tuple[int, int]) -> bool:
        if sign in self.signs:
            return False
        if len(self.signs) < self.most:
            self.signs.add(sign)
        return True


def _signatures(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen, counts = Bands(num, den), Seen(), Counts()
        for batch in batches:
            n, h1, h2 = [], [], []
            named = batch.column(0).is_valid().to_pylist()
            for i, words in word_hashes(batch.column(1)):
                s = shingle_set(words, k)
                n.append(len(s))
                at = mix(s)
                one, two = signature(s, at)
                h1.append(one)
                h2.append(two)
                if len(s) and named[i] and seen.new((one, two)):  # only rows that join
                    counts.add(digests(s, bands, at))
            yield _sign_batch(batch.column(0).cast(pa.int64()), n, h1, h2, False)
        counts.flush()
        m = len(counts.keys)
        yield _sign_batch(pa.nulls(m, pa.int64()), counts.times, counts.keys.view(np.int64), np.zeros(m, np.int64), True)

    return run


class Chosen:
    """The keys by which sets are known: of each scheme the first that are enough, frequent keys last."""

    def __init__(self, num: int, den: int, frequent: np.ndarray):
        """frequent: keys, the least frequent first."""
        self.bands = Bands(num, den)
        order = np.argsort(frequent)
        self.known, self.rank = frequent[order], order + 1

    def of(self, nodes: list[int], sizes: list[int], raws: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(key, node) rows."""
        keys = np.frombuffer(b"".join([r for r in raws if r]), "<u8")
        node, enough, lengths = [], [], []
        for x, n, raw in zip(nodes, sizes, raws, strict=True):
            if raw:
                for _, parts, most in schemes(n, self.bands):
                    node.append(x)
                    lengths.append(parts)
                    enough.append(most)
        if not node:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lengths = np.array(lengths, np.int64)
        segment = np.repeat(np.arange(len(node)), lengths)
        place = np.arange(len(keys)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        rank = np.zeros(len(keys), np.int64)
        if len(self.known):
            at = np.searchsorted(self.known, keys)
            at[at == len(self.known)] = 0
            hit = self.known[at] == keys
            rank[hit] = self.rank[at[hit]]
            moved = np.zeros(len(node), bool)
            moved[segment[hit]] = True
            if len(some := np.flatnonzero(moved[segment])):
                keys = keys.copy()
                keys[some] = keys[some[np.lexsort((place[some], rank[some], segment[some]))]]
        keep = place < np.array(enough, np.int64)[segment]
        return keys[keep].view(np.int64), np.array(node, np.int64)[segment[keep]]


def _stars(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (key, node): the least node of each key's run, and (node, least) of its other rows."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    least = node[np.flatnonzero(first)[np.cumsum(first) - 1]]
    rest = least != node
    return order[first], node[rest], least[rest]


#: Rows of (key, node) that a task gathers before it combines them.
COMBINE_ROWS = 1 << 20


def _explode(k: int, num: int, den: int, frequent):
    """Of rows (doc_id, text): (key, label, -1) of keys to be dealt out and (random, label, least) of those that met here already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, seen = Chosen(num, den, frequent.value), Seen()
        keys, nodes, held = [], [], 0
        labels, sizes, raws, waiting = [], [], [], 0

        def out(a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(linked)], names=["key", "node", "linked"])

        def flush():
            key, node = np.concatenate(keys), np.concatenate(nodes)
            kept, a, b = _stars(key, node)
            yield out(key[kept], node[kept], np.full(len(kept), -1, np.int64))
            if len(a):
                pair = np.unique(np.stack([a, b], axis=1), axis=0)
                yield out(mix(pair[:, 0].astype(np.uint64)).view(np.int64), pair[:, 0], pair[:, 1])

        def choose() -> int:
            key, node = chosen.of(labels, sizes, raws)
            keys.append(key)
            nodes.append(node)
            return len(key)

        for batch in batches:
            named = batch.column(0).is_valid().to_pylist()
            for i, words in word_hashes(batch.column(1)):
                if not named[i] or not len(words):
                    continue
                s = shingle_set(words, k)
                at = mix(s)
                sign = signature(s, at)
                if not seen.new(sign):
                    continue
                labels.append(sign[0] & LABEL)
                sizes.append(len(s))
                raws.append(digests(s, chosen.bands, at).astype("<u8").tobytes())
                waiting += len(raws[-1])
                if waiting >= BLOCK_BYTES:
                    held += choose()
                    labels, sizes, raws, waiting = [], [], [], 0
                    if held >= COMBINE_ROWS:
                        yield from flush()
                        keys, nodes, held = [], [], 0
        held += choose()
        if held:
            yield from flush()

    return run


def _members(num: int, den: int, frequent):
    """Rows (key, node, root) of (node, set, root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = Chosen(num, den, frequent.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 250):
                part = batch.slice(i, 250)
                sets = [_words(x.as_py()) for x in part.column(1)]
                key, at = chosen.of(list(range(len(sets))), [len(s) for s in sets], [digests(s, chosen.bands).astype("<u8").tobytes() for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(key), part.column(0).take(pa.array(at)), part.column(2).take(pa.array(at))], names=["key", "node", "root"])

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of each key's nodes with its least one, with those found before; runs of a key may span batches of the sorted input."""
    held_key, held_node = None, None
    for batch in batches:
        key, node, linked = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        done = linked >= 0
        a, b = [node[done]], [linked[done]]
        key, node = key[~done], node[~done]
        if len(key):
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            head = node[np.flatnonzero(first)[np.cumsum(first) - 1]]
            if held_key == key[0]:
                head[: int(np.flatnonzero(first)[1]) if first.sum() > 1 else len(head)] = held_node
            held_key, held_node = key[-1], head[-1]
            a.append(head[head != node])
            b.append(node[head != node])
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])


_SET = "node bigint, h1 bigint, h2 bigint, n bigint, sketch binary, set binary"


def _sets(k: int):
    """The sets of nodes, each once: rows repeated with one doc_id lie together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None)
        for batch in batches:
            node, h1, h2 = (batch.column(i).to_pylist() for i in (0, 2, 3))
            rows, held = [], 0
            for i, words in word_hashes(batch.column(1)):
                if last[0] != node[i]:
                    last = (node[i], set())
                if (h1[i], h2[i]) in last[1]:
                    continue
                s = shingle_set(words, k)
                if (h1[i], h2[i]) != signature(s):  # another text under the same doc_id
                    continue
                last[1].add((h1[i], h2[i]))
                rows.append((node[i], h1[i], h2[i], len(s), sketch_of(s).astype("<u8").tobytes(), s.astype("<u8").tobytes()))
                held += len(s) * 9
                if held > 8 << 20:
                    yield _set_batch(rows)
                    rows, held = [], 0
            yield _set_batch(rows)

    return run


def _set_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 4 else pa.binary()) for i, c in enumerate(cols)], names=["node", "h1", "h2", "n", "sketch", "set"])


def _linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    if len(a) < len(b):
        a, b = b, a
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int(np.count_nonzero(a[at] == b))
    return den * both >= num * (len(a) + len(b) - both)


def _words(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])


def _with_head(num: int, den: int):
    """Links of heads with their members; of each (head, salt) the head's rows come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heads = None, []
        for batch in batches:
            head, salt, member, node, n, sketch, sets = (batch.column(i) if i > 4 else batch.column(i).to_pylist() for i in range(7))
            found = []
            for i, now in enumerate(zip(head, salt, strict=True)):
                if now != key:
                    key, heads = now, []
                mine = _words(sketch[i].as_py())
                if not member[i]:
                    heads.append((n[i], mine, _words(sets[i].as_py())))
                    continue
                for size, other, whole in heads:
                    total, words = size + n[i], min(len(mine), len(other))
                    if den * min(size, n[i]) < num * max(size, n[i]) or int(np.bitwise_count(folded(mine, words) ^ folded(other, words)).sum()) * (den + num) > (den - num) * total:
                        continue
                    if _linked(whole, _words(sets[i].as_py()), num, den):
                        found.append((head[i], node[i]))
                        break
            if found:
                yield _pairs(found)

    return run


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, block_sets: int, scratch: Scratch, name: str) -> DataFrame:
    """Those pairs (a, b) whose sets link. A head a with many members is dealt to several tasks, each with its set; a task holds one head."""
    heads = scratch.cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(block_sets)).cast("int").alias("salts")), f"{name}_heads")
    members = pairs.join(heads, "a").select(F.col("a").alias("head"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("member"), F.col("b").alias("node"))
    firsts = heads.select(F.col("a").alias("head"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("member"), F.col("a").alias("node"))
    full = members.unionByName(firsts).join(sets, "node").select("head", "salt", "member", "node", "n", "sketch", "set")
    dealt = full.repartition("head", "salt").sortWithinPartitions("head", "salt", "member")
    found = scratch.cut(dealt.mapInArrow(_with_head(num, den), "a bigint, b bigint"), name)
    scratch.tidy()
    return found


def _between_blocks(num: int, den: int):
    """Links among the sets of a block, or between two, that join what no link has joined; the input is sorted by (head, bi, bj), so one unit is held at a time."""

    def links(key: tuple, rows: list[tuple]) -> list[tuple[int, int]]:
        rows.sort(key=lambda r: (r[3], r[1]))  # block, node, root, n, sketch, set
        sizes = np.array([r[3] for r in rows])
        block, node = np.array([r[0] for r in rows]), [r[1] for r in rows]
        _, comp = np.unique([r[2] for r in rows], return_inverse=True)
        sets = [_words(r[5]) for r in rows]
        words = min(len(r[4]) // 8 for r in rows)
        sketch = np.stack([folded(_words(r[4]), words) for r in rows])
        out = []
        for i in range(len(rows) - 1):
            j = np.arange(i + 1, int(np.searchsorted(sizes, sizes[i] * den // num, side="right")))
            j = j[(comp[j] != comp[i]) & ((block[j] != block[i]) | (key[1] == key[2]))]
            if not len(j):
                continue
            near = j[np.bitwise_count(sketch[j] ^ sketch[i]).sum(axis=1) * (den + num) <= (den - num) * (sizes[i] + sizes[j])]
            for x in near:
                if comp[x] != comp[i] and _linked(sets[i], sets[x], num, den):
                    comp[comp == comp[x]] = comp[i]
                    out.append((node[i], node[x]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
            columns, done = [b.column(i).to_pylist() for i in range(3, 9)], []
            for i, now in enumerate(keys):
                if now != key:
                    done += links(key, rows) if rows else []
                    key, rows = now, []
                rows.append(tuple(c[i] for c in columns))
            if done:
                yield _pairs(done)
        if rows:
            yield _pairs(links(key, rows))

    return run


def _in_full(mixed: DataFrame, sets: DataFrame, num: int, den: int, block_bytes: int, block_sets: int, scratch: Scratch, name: str) -> DataFrame:
    """Links among all members of the buckets (key, node, root, least); buckets of one least node are compared together, so that a pair seldom meets twice."""
    group = scratch.cut(mixed.select(F.col("least").alias("head"), "node", "root").distinct().join(sets.select("node", "n"), "node"), f"{name}_group")
    blocks = F.ceil(F.greatest(F.sum(F.col("n") * 9) / F.lit(block_bytes), F.count("*") / F.lit(block_sets))).cast("int")
    sized = scratch.cut(group.groupBy("head").agg(blocks.alias("blocks")), f"{name}_blocks")
    spread = group.join(sized, "head").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    units = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("head", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "node", "root")
    full = units.join(sets, "node").select("head", "bi", "bj", "block", "node", "root", "n", "sketch", "set")
    dealt = full.repartition("head", "bi", "bj").sortWithinPartitions("head", "bi", "bj")
    found = scratch.cut(dealt.mapInArrow(_between_blocks(num, den), "a bigint, b bigint"), name)
    scratch.tidy()
    return found


def parity_join(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, block_sets: int = BLOCK_SETS, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, class_size.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a set holds the distinct k-word shingles, with
    fewer words the whole sequence as one, and is empty without words or with a null text.  Two rows link
    when den * |A and B| >= num * |A or B|; empty sets link with nothing.  component_id is the least doc_id
    that links reach, itself included; class_size counts the rows of the same set (1 for empty ones).
    Shingles are compared by 64-bit hashes, sets by 128 bits.  Rows repeated with one doc_id share a
    component.  A null doc_id is left out of joins: its component_id is null.  Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "parity_join")
    pairs = docs.select(named(id_col).cast("bigint").alias("doc_id"), named(text_col).alias("text"))
    signed = scratch.cut(pairs.mapInArrow(_signatures(k, num, den), _SIGN), "signed")
    often = signed.where("frequent").groupBy("h1").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_FROM).orderBy(F.desc("n"), "h1").limit(FREQUENT).toArrow()
    frequent = spark.sparkContext.broadcast(often.column(0).to_numpy()[::-1].astype(np.int64).view(np.uint64))
    full = signed.where("NOT frequent AND n > 0 AND doc_id IS NOT NULL")
    classes = scratch.cut(full.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.count("*").alias("class_size"), F.first("n").alias("n")), "classes")
    rows = pairs.mapInArrow(_explode(k, num, den, frequent), "key bigint, node bigint, linked bigint")
    met = rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_meet, "a bigint, b bigint")
    met = scratch.cut(met.distinct(), "met")
    scratch.tidy()
    labelled = classes.select(F.col("h1").bitwiseAND(F.lit(LABEL)).alias("label"), "node")
    one, two = (labelled.select(F.col("label").alias(c), F.col("node").alias(x)) for c, x in (("a", "x"), ("b", "y")))
    stars = met.join(one, "a").join(two, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    stars = scratch.cut(stars.distinct(), "stars")
    involved = stars.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes, "node")
    texts = involved.join(pairs.withColumnRenamed("doc_id", "node"), "node").select("node", "text", "h1", "h2")
    sets = scratch.cut(texts.mapInArrow(_sets(k), _SET), "sets")
    scratch.tidy()
    links = [_verified(stars, sets, num, den, block_sets, scratch, "links0")]

    def roots(name: str) -> DataFrame:
        joined = links[0]
        for more in links[1:]:
            joined = joined.unionByName(more)
        return components(joined, scratch, name, stored=True)

    mixed = None
    for step in range(1, rounds + 1):
        up = roots(f"joined{step}").withColumnRenamed("root", "up")
        if mixed is None:
            known = sets.join(up, "node", "left").select("node", "set", F.coalesce("up", "node").alias("root"))
            members = known.mapInArrow(_members(num, den, frequent), "key bigint, node bigint, root bigint")
        else:
            members = mixed.select("key", "node", "root").join(up, "node", "left").select("key", "node", F.coalesce("up", "root").alias("root"))
            members = scratch.cut(members, f"members{step}")
        # Two numbers a key move for all keys; heads and sizes are found for the mixed ones only, which are few.
        apart = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        held = scratch.cut(members.join(apart, "key"), f"held{step}")
        scratch.tidy()
        head = F.min(F.struct(F.xxhash64("node", F.lit(step)).alias("h"), F.col("node").alias("a"), F.col("root").alias("head_root")))
        of_key = held.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("size"), head.alias("head"))
        mixed = scratch.cut(held.join(of_key.select("key", "least", "size", "head.a", "head.head_root"), "key"), f"mixed{step}")
        largest = mixed.agg(F.max("size")).first()[0]
        if largest is None:
            break
        if step == rounds or largest <= IN_FULL * block_sets:
            links.append(_in_full(mixed, sets, num, den, block_bytes, block_sets, scratch, f"links{step}"))
            break
        meet = scratch.cut(mixed.where("root <> head_root").select("a", F.col("node").alias("b")).distinct(), f"meet{step}")
        links.append(_verified(meet, sets, num, den, block_sets, scratch, f"links{step}"))
    light = signed.where("NOT frequent")
    least = classes.join(roots("linked"), "node", "left").select("h1", "h2", "node", "class_size", F.coalesce("root", "node").alias("root"))
    least = scratch.cut(least, "rooted")
    names = least.groupBy("root").agg(F.min("node").alias("component_id"))
    final = least.join(names, "root").select("h1", "h2", "component_id", "class_size")
    members = light.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", F.col("n").alias("n_shingles"), "h1", "h2").join(final, ["h1", "h2"])
    rest = light.where("NOT (n > 0 AND doc_id IS NOT NULL)").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(1).cast("bigint").alias("class_size"))
    scratch.drop_all_but("signed", "rooted")
    scratch.tidy()
    return members.select("doc_id", "n_shingles", "component_id", "class_size").unionByName(rest)
