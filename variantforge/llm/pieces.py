"""SentencePiece (merge type) encoding with seeded merge-dropout, and lossless decoding.

Pieces come from a public model file; nothing is trained.  As in the reference algorithm, the best-scored
adjacent pair whose concatenation is a piece is merged, leftmost first, until none is left.  With dropout,
a candidate merge (its start, middle and end in a word) is skipped for good if a keyed hash of the seed, the
word, a variant and the candidate falls under the rate, so a decision depends on no order of processing.
The variant of a word's occurrence is a keyed hash of the document's id plus its place in the document, so
each occurrence is decided for itself.  One that skips none of the merges made without dropout comes out as
without it; only the others are worked out one by one.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.columns import map_in_arrow, with_fields
from .words import U64, mix, mix1, mix_int

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 17
#: Words of more characters go through a heap, one by one; shorter ones through arrays, many at once.
ARRAY_CHARS = 48
#: Characters of text whose words are worked out together.
SPAN = 1 << 20
#: Words, and their characters, whose pieces and merges without dropout a worker remembers from span to span.
REMEMBERED, REMEMBERED_CHARS = 300_000, 4 << 20
_NO_RANK = np.int32(2**31 - 1)
_K = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


class Numbers(dict):
    """Numbers of words, in the order in which they are asked for."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class Known:
    """Words by number, with their pieces and merges without dropout (steps: start, middle and end, in order of words)."""

    def __init__(self):
        self.index = Numbers()
        self.lengths, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.values, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.steps = np.zeros((3, 0), np.int16)

    def full(self) -> bool:
        return len(self.index) > REMEMBERED or int(self.lengths.sum()) > REMEMBERED_CHARS

    def learn(self, pieces: Pieces) -> None:
        """Works out the words that are in the index since the last call."""
        new = list(islice(self.index, len(self.lengths), None))
        if not new:
            return
        trace: list = []
        values, offsets = _encode_words(pieces, new, np.zeros(len(new), np.uint64), 0, 0.0, trace)
        self.lengths = np.concatenate([self.lengths, np.fromiter(map(len, new), np.int64, len(new))])
        self.values, self.offsets = np.concatenate([self.values, values]), np.concatenate([self.offsets, self.offsets[-1] + offsets[1:]])
        word = np.concatenate([t[0] for t in trace]) if trace else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        steps = [np.concatenate([t[k] for t in trace])[order] if trace else np.zeros(0, np.int16) for k in (1, 2, 3)]
        self.steps = np.concatenate([self.steps, np.stack(steps)], axis=1)
        self.count = np.concatenate([self.count, np.bincount(word, minlength=len(new))])


class Pieces:
    """The vocabulary of a model file, as tables."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        normal = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        self.byte = np.full(256, sp.unk_id(), np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte[int(self.names[i][3:5], 16)] = i
        self.id = {p: i for i, (p, ok) in enumerate(zip(self.names, normal, strict=True)) if ok}
        order = sorted(self.id.values(), key=lambda i: (-sp.get_score(i), i))
        self.rank = np.full(n, _NO_RANK, np.int32)
        self.rank[order] = np.arange(len(order), dtype=np.int32)
        self.rank_list = self.rank.tolist()
        self.by_rank = np.array(order, np.int32)
        self.char = {(" " if p == "▁" else p): i for p, i in self.id.items() if len(p) == 1}
        self.lut = np.full(0x110000, -1, np.int32)
        for c, i in self.char.items():
            self.lut[ord(c)] = i
        pairs = {}
        for p, i in self.id.items():
            for cut in range(1, len(p)):
                a, b = self.id.get(p[:cut]), self.id.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.pairs = pairs
        self._table(pairs)
        self.bytes_of = [
            bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() if normal[i] else b"" for i, p in enumerate(self.names)
        ]
        self.bytes_column = pa.array(self.bytes_of, pa.large_binary())
        inner = [p for p in self.id if re.search("[^▁]▁", p)]
        newline = [p for p in self.id if "\n" in p]
        self.known = Known()
        self.words = re.compile(r" *[^ \n]+|\n| +") if not inner and not newline else re.compile(r" *[^ ]+| +") if not inner else re.compile(r"(?s).+")

    def _table(self, pairs: dict[int, int]) -> None:
        """An open hash table of pairs: at most `probes` steps find any key."""
        bits = max(10, (len(pairs) * 8).bit_length())
        self._shift, mask = U64(64 - bits), (1 << bits) - 1
        keys, values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NO_RANK, np.int32)
        self._probes = 1
        for key, value in pairs.items():
            at = (key * int(_K[0]) & (2**64 - 1)) >> (64 - bits)
            step = 0
            while keys[at + step & mask] >= 0:
                step += 1
            keys[at + step & mask], values[at + step & mask] = key, self.rank[value]
            self._probes = max(self._probes, step + 1)
        self._keys, self._values, self._mask = keys, values, mask

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the piece that each pair makes, _NO_RANK if none (as with a negative symbol, whose key is in no slot but an empty one)."""
        key = left.astype(np.int64) << 32 | right
        slot = (key.view(np.uint64) * _K[0] >> self._shift).view(np.int64)
        there = self._keys[slot]
        out = np.where(there == key, self._values[slot], _NO_RANK)
        todo = np.flatnonzero((there != key) & (there >= 0))
        for step in range(1, self._probes):
            if not len(todo):
                break
            at = slot[todo] + step & self._mask
            there = self._keys[at]
            hit = there == key[todo]
            out[todo[hit]] = self._values[at[hit]]
            todo = todo[~hit & (there >= 0)]
        return out


@lru_cache(maxsize=2)
def load(model: str) -> Pieces:
    return Pieces(model)


def _dropped(key, start, mid, end, limit):
    """Whether keyed hashes fall under the limit (arrays or integers of one shape)."""
    return mix(key + U64(1) * start * _K[1] + mid * _K[2] + end * _K[3]) < limit


def word_keys(chars: np.ndarray, lengths: np.ndarray, variant: np.ndarray, seed: int) -> np.ndarray:
    """A keyed hash of each row of a padded matrix of code points with its variant."""
    key = mix(variant.astype(np.uint64) + U64(mix1(seed)))
    at = np.arange(chars.shape[1])
    for j in at:
        key = np.where(j < lengths, mix(key ^ (chars[:, j].astype(np.uint64) + U64(1))), key)
    return key


def _limit(rate: float) -> np.uint64:
    return U64(min(2**64 - 1, int(rate * 2**64)))


def encode_word(pieces: Pieces, word: str, variant: int, seed: int, rate: float) -> list[int]:
    """The pieces of one word by agenda: a heap of candidates, best score first, then leftmost; its hashes are those of the arrays, in Python integers."""
    n = len(word)
    codes = [ord(c) for c in word]
    key, limit = mix_int(int(variant) + mix1(seed)), int(_limit(rate))
    for c in codes if rate else ():
        key = mix_int(key ^ (c + 1))
    one, two, three = (int(x) for x in _K[1:])
    lut = pieces.lut
    sym = [int(lut[c]) for c in codes]
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int, int, int]] = []
    rank, pairs = pieces.rank_list, pieces.pairs

    def offer(a: int) -> None:
        b = after[a]
        if b >= n or sym[a] < 0 or sym[b] < 0:
            return
        made = pairs.get(sym[a] << 32 | sym[b])
        if made is not None and not (rate and mix_int(key + a * one + b * two + end[b] * three) < limit):
            heapq.heappush(heap, (rank[made], a, b, end[b], made))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, a, b, stop, made = heapq.heappop(heap)
        if sym[a] == -2 or sym[b] == -2 or after[a] != b or end[b] != stop or pairs.get(sym[a] << 32 | sym[b]) != made:
            continue
        sym[a], sym[b], end[a], after[a] = made, -2, stop, after[b]
        if after[b] < n:
            before[after[b]] = a
        if before[a] >= 0:
            offer(before[a])
        offer(a)
    out: list[int] = []
    i = 0
    while i < n:
        out += [sym[i]] if sym[i] >= 0 else [int(pieces.byte[b]) for b in word[i].encode("utf-8", "surrogatepass")]
        i = after[i]
    return out


def _encode_rows(pieces: Pieces, codes: np.ndarray, lengths: np.ndarray, variant: np.ndarray, seed: int, rate: float, trace: list | None = None) -> np.ndarray:
    """The symbols of many words at once, each at the place of its first character (-3 elsewhere); all rows advance by their best merge together. trace gathers (row, start, middle, end) of the merges."""
    n, width = codes.shape
    key = word_keys(codes, lengths, variant, seed) if rate else np.zeros(n, np.uint64)
    limit, bits = _limit(rate), width.bit_length()
    # By place and row, flat; a word's end is a place too, with no symbol.
    sym = np.full((width + 1, n), -3, np.int32)
    sym[:width] = np.where(np.arange(width)[:, None] < lengths, pieces.lut[codes.T], np.int32(-3))
    after, before = (np.repeat(np.arange(k, width + 1 + k, dtype=np.int16), n) for k in (1, -1))
    flat = sym.reshape(-1)

    def offered(row, start, mid, end, left, right):
        """Ranks of candidates with their places below, so that the smallest is the best and leftmost."""
        rank = pieces.merged(left, right)
        out = np.full(len(rank), _NO_RANK, np.int32)
        some = np.flatnonzero(rank < _NO_RANK)
        if rate:
            some = some[~_dropped(key[row[some]], *(x[some].astype(np.uint64) for x in (start, mid, end)), limit)]
        out[some] = rank[some] << bits | start[some]
        return out

    best_of = np.full((width, n), _NO_RANK, np.int32)
    at, row = np.nonzero(np.arange(1, width + 1)[:, None] < lengths)
    best_of[at, row] = offered(row, at, at + 1, at + 2, sym[at, row], sym[at + 1, row])
    rows = np.arange(n)
    while len(rows):
        best = best_of.min(axis=0)
        live = np.flatnonzero(best < _NO_RANK)
        if 2 * len(live) < len(rows):
            best_of, rows, best = best_of[:, live], rows[live], best[live]
            live = np.arange(len(live))
        best, row = best[live], rows[live]
        a = (best & (1 << bits) - 1).astype(np.int64)
        made = pieces.by_rank[best >> bits]
        at = a * n + row
        b = after[at].astype(np.int64)
        e = after[b * n + row].astype(np.int64)
        if trace is not None and len(live):
            trace.append((row, *(x.astype(np.int16) for x in (a, b, e))))
        flat[at], flat[b * n + row] = made, -3
        stop = e * n + row
        after[at], before[stop] = e, a
        best_of[b, live] = _NO_RANK
        p = before[at].astype(np.int64)
        ok = np.flatnonzero(p >= 0)
        p = p[ok]
        start, mid, end = np.concatenate([p, a]), np.concatenate([a[ok], e]), np.concatenate([e[ok], after[stop]])
        left, right = np.concatenate([flat[p * n + row[ok]], made]), np.concatenate([made[ok], flat[stop]])
        best_of[start, np.concatenate([live[ok], live])] = offered(np.concatenate([row[ok], row]), start, mid, end, left, right)
    return np.ascontiguousarray(sym[:width].T)


def _encode_words(pieces: Pieces, words: list[str], variant: np.ndarray, seed: int, rate: float, trace: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(all pieces, offsets) of many words; trace gathers the merges of those up to ARRAY_CHARS."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows, counts, pieces
    low = 0
    for high in (6, 10, 16, 28, ARRAY_CHARS):
        rows = np.flatnonzero((lengths > low) & (lengths <= high))
        low = high
        for i in range(0, len(rows), 16_384):
            some = rows[i : i + 16_384]
            flat = np.frombuffer("".join([words[r] for r in some]).encode("utf-32-le", "surrogatepass"), "<u4")
            codes = np.zeros((len(some), high), np.uint32)
            codes[np.arange(high) < lengths[some][:, None]] = flat
            merges = None if trace is None else []
            sym = _encode_rows(pieces, codes, lengths[some], variant[some], seed, rate, merges)
            if merges:
                trace += [(some[m[0]], *m[1:]) for m in merges]
            r, c = np.nonzero(sym >= -1)
            value = sym[r, c]
            times = np.ones(len(value), np.int64)
            lost = np.flatnonzero(value == -1)
            if len(lost):  # characters outside the vocabulary become their bytes
                raw = [chr(x).encode("utf-8", "surrogatepass") for x in codes[r[lost], c[lost]]]
                times[lost] = [len(x) for x in raw]
                value = np.repeat(value, times)
                value[value == -1] = pieces.byte[np.frombuffer(b"".join(raw), np.uint8)]
                r = np.repeat(r, times)
            parts.append((some, np.bincount(r, minlength=len(some)), value))
    for row in np.flatnonzero(lengths > ARRAY_CHARS):
        ids = encode_word(pieces, words[row], int(variant[row]), seed, rate)
        parts.append((np.array([row]), np.array([len(ids)]), np.array(ids, np.int32)))
    count = np.zeros(len(words), np.int64)
    for rows, c, _ in parts:
        count[rows] = c
    offsets = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(offsets[-1], np.int32)
    for rows, c, value in parts:
        at = np.repeat(offsets[rows] - (np.cumsum(c) - c), c) + np.arange(len(value))
        out[at] = value
    return out, offsets


def _skips(known: Known, names: list[str], which: np.ndarray, variant: np.ndarray, seed: int, rate: float) -> np.ndarray:
    """Whether each occurrence skips one of its word's merges without dropout, or has a word too long for a trace."""
    lengths, count = known.lengths, known.count
    out = (lengths > ARRAY_CHARS)[which]
    if not known.steps.size:
        return out
    before = np.cumsum(count) - count
    by_length = np.argsort(lengths[which], kind="stable")
    for i in range(0, len(by_length), 65_536):
        some = by_length[i : i + 65_536]
        some = some[~out[some]]
        if not len(some):
            continue
        wide = lengths[which[some]]
        codes = np.zeros((len(some), int(wide.max())), np.uint32)
        codes[np.arange(codes.shape[1]) < wide[:, None]] = np.frombuffer("".join([names[k] for k in which[some]]).encode("utf-32-le", "surrogatepass"), "<u4")
        key, n = word_keys(codes, wide, variant[some], seed), count[which[some]]
        row = np.repeat(np.arange(len(some)), n)
        at = np.repeat(before[which[some]] - (np.cumsum(n) - n), n) + np.arange(len(row))
        out[some[row[_dropped(key[row], *known.steps[:, at].astype(np.uint64), _limit(rate))]]] = True
    return out


def encode_texts(pieces: Pieces, texts: list[str | None], keys: list[int | None], seed: int = SEED, rate: float = DROPOUT) -> tuple[np.ndarray, np.ndarray]:
    """(pieces of all texts, offsets). keys give each text's first variant; null and empty texts have no pieces."""
    out, sizes, i = [], [], 0
    while i < len(texts):
        if pieces.known.full():
            pieces.known = Known()
        known = pieces.known
        index = known.index
        uses, bounds, size = [], [0], 0
        variant_of = []
        while i < len(texts) and (size == 0 or size + len(texts[i] or "") <= SPAN):
            found = pieces.words.findall(" " + texts[i]) if texts[i] else []
            size += len(texts[i] or "") + 1
            uses += map(index.__getitem__, found)
            first = mix1((keys[i] or 0) ^ mix1(seed + 1)) if rate else 0
            variant_of.append(np.arange(len(found), dtype=np.uint64) + U64(first))
            bounds.append(bounds[-1] + len(found))
            i += 1
        if not uses:
            sizes += [0] * (len(bounds) - 1)
            continue
        known.learn(pieces)
        which, names, value, offsets = np.array(uses, np.int64), list(index), known.values, known.offsets
        if rate:
            variant = np.concatenate(variant_of)
            own = np.flatnonzero(_skips(known, names, which, variant, seed, rate))
            more, ends = _encode_words(pieces, [names[k] for k in which[own]], variant[own], seed, rate)
            value, offsets = np.concatenate([value, more]), np.concatenate([offsets, offsets[-1] + ends[1:]])
            which[own] = len(names) + np.arange(len(own))
        count = np.diff(offsets)[which]
        at = np.repeat(offsets[which] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        out.append(value[at])
        ends = np.concatenate([[0], np.cumsum(count)])[bounds]
        sizes += list(np.diff(ends))
    return (np.concatenate(out) if out else np.zeros(0, np.int32)), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def decode_ids(pieces: Pieces, ids: list[int]) -> str:
    """The text of pieces; the one space that encoding puts first is taken off again."""
    raw = b"".join([pieces.bytes_of[i] for i in ids])
    return raw[1 if raw[:1] == b" " else 0 :].decode("utf-8", "surrogatepass")


def decode_lists(pieces: Pieces, values: np.ndarray, offsets: np.ndarray) -> list[memoryview]:
    """The UTF-8 bytes of many texts (those of ``decode_ids``), all pieces taken at once; one piece list begins at each offset."""
    raw = pieces.bytes_column.take(pa.array(values, pa.int32()))
    _, places, data = raw.buffers()
    ends, data = np.frombuffer(places, np.int64)[offsets].tolist(), memoryview(data or b"")
    return [data[a + (a < b and data[a] == 32) : b] for a, b in zip(ends, ends[1:], strict=False)]


def _path(model: str) -> str:
    return model if model.startswith("/") else SparkFiles.get(model)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, seed: int = SEED, rate: float = DROPOUT, keep_text: bool = False, check: bool = False) -> DataFrame:
    """One row per row: doc_id, pieces (array of int) and, if asked, text and lossless; the same seed gives the same pieces.

    A null text has null pieces, an empty one none. A null doc_id counts as 0 for the variants. model is a
    path that every executor has, or the name of a file that SparkContext.addFile has sent. Other columns
    are not read. Characters outside the vocabulary, the marker U+2581 among them, become their bytes, so
    decoding gives every text back; lossless says whether it did (null for a null text).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(_path(model))
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                values, offsets = encode_texts(pieces, part.column(1).to_pylist(), part.column(0).to_pylist(), seed, rate)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()), mask=pc.is_null(part.column(1)))
                columns, names = [part.column(0), lists], ["doc_id", "pieces"]
                if keep_text:
                    columns, names = [*columns, part.column(1)], [*names, "text"]
                if check:
                    raw = part.column(1).cast(pa.binary())
                    same = [None if not t.is_valid else t.as_buffer() == pa.py_buffer(found) for t, found in zip(raw, decode_lists(pieces, values, offsets), strict=True)]
                    columns, names = [*columns, pa.array(same, pa.bool_())], [*names, "lossless"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, pieces array<int>" + ", text string" * keep_text + ", lossless boolean" * check)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded (with a column pieces) and the decoded text as column decoded; null pieces decode to null."""
    at = encoded.columns.index("pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(_path(model))
        for batch in batches:
            lists = batch.column(at)
            texts = [None if not x.is_valid else decode_ids(pieces, x.values.to_numpy(zero_copy_only=False).tolist()) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return map_in_arrow(encoded, run, with_fields(encoded.schema, "decoded string"))
