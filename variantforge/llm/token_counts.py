"""Edit-aware token counts: a segment tree of pre-tokens per document, kept as a column, and recounts of only what edits touch.

``build`` puts a tree beside each text; ``update`` reads it with edits and returns the edited text and its tree.
The pattern that cuts a text into pre-tokens reads left to right and looks at most two characters past a
pre-token's end, and tokens never cross pre-tokens.  So after an edit, cutting restarts at the pre-token
that holds the character three before the edit and stops at the first old boundary behind it that a new
one falls on; the counts of all other pre-tokens stand, and the sums above the touched leaves are updated.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..operators.columns import map_in_arrow, named, with_fields

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern of the rank file's public tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens of a leaf, context before an edit in characters, pre-tokens whose counts a worker remembers.
LEAF, CONTEXT, REMEMBERED = 64, 3, 400_000
#: A tree: characters and tokens of each pre-token (4 bytes each), pre-tokens of each leaf, and for every node
#: of the tree (the root is node 1, the children of i are 2i and 2i + 1) its pre-tokens, characters and tokens.
TREE = "struct<lengths: binary, counts: binary, leaves: binary, sums: binary>"


class Counter:
    """Pre-tokens and their token counts under a rank file."""

    def __init__(self, ranks: str):
        import regex
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.plain = regex.compile(r" \p{L}+")
        self.known: dict[str, int] = {}
        self.bytes_of = np.zeros(max(table.values()) + 1, np.int64)
        for raw, i in table.items():
            self.bytes_of[i] = len(raw)

    def learn(self, pre_tokens: Iterable[list[str]]) -> None:
        """Encodes what is not known yet."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = set().union(*pre_tokens).difference(known)
        # Words that begin with a space stay apart when joined: one call encodes them, and bytes tell whose each token is.
        words = [t for t in new if self.plain.fullmatch(t)]
        if words:
            ends = np.cumsum([len(t.encode()) for t in words])
            stops = np.cumsum(self.bytes_of[self.encoding.encode_ordinary("".join(words))])
            counts = np.diff(np.searchsorted(stops, ends, side="right"), prepend=0)
            known.update(zip(words, counts.tolist(), strict=True))
        for t in new.difference(words):
            known[t] = len(self.encoding.encode_ordinary(t))

    def count(self, pre_tokens: list[str]) -> np.ndarray:
        if not all(map(self.known.__contains__, pre_tokens)):
            self.learn([pre_tokens])
        return np.fromiter(map(self.known.__getitem__, pre_tokens), np.int32, len(pre_tokens))

    def trees(self, texts: list[str]) -> list[Tree]:
        """New trees of whole texts."""
        found = [self.pattern.findall(t) for t in texts]
        self.learn(found)
        return [Tree.new(np.fromiter(map(len, f), np.int32, len(f)), np.fromiter(map(self.known.__getitem__, f), np.int32, len(f))) for f in found]

    def tree(self, text: str) -> Tree:
        return self.trees([text])[0]


_NONE = np.zeros(0, np.int32)


class Tree:
    """A segment tree over leaves of about LEAF pre-tokens; each node sums (pre-tokens, characters, tokens)."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, leaves: np.ndarray, sums: np.ndarray):
        self.lengths, self.counts, self.sizes, self.sums = lengths, counts, leaves, sums
        self.size = len(sums) // 2
        self.ends: list[int] | None = None
        self.starts = np.concatenate([[0], np.cumsum(leaves)])

    @classmethod
    def new(cls, lengths: np.ndarray, counts: np.ndarray) -> Tree:
        n = len(lengths)
        leaves = np.full(max(1, -(-n // LEAF)), LEAF, np.int32)
        leaves[-1] = n - LEAF * (len(leaves) - 1)
        size = 1 << (len(leaves) - 1).bit_length()
        sums = np.zeros((2 * size, 3), np.int64)
        at = np.arange(len(leaves)) * LEAF
        sums[size : size + len(leaves), 0] = leaves
        if n:
            sums[size : size + len(leaves), 1] = np.add.reduceat(lengths, at, dtype=np.int64)
            sums[size : size + len(leaves), 2] = np.add.reduceat(counts, at, dtype=np.int64)
        while size > 1:
            half = size // 2
            sums[half:size] = sums[size : 2 * size : 2] + sums[size + 1 : 2 * size : 2]
            size = half
        return cls(lengths, counts, leaves, sums)

    @classmethod
    def load(cls, lengths: bytes, counts: bytes, leaves: bytes, sums: bytes) -> Tree:
        return cls(*(np.frombuffer(x, "<i4") for x in (lengths, counts, leaves)), np.frombuffer(sums, "<i8").reshape(-1, 3).copy())

    def dump(self) -> tuple[bytes, bytes, bytes, bytes]:
        return (*(np.asarray(x, "<i4").tobytes() for x in (self.lengths, self.counts, self.sizes)), self.sums.astype("<i8").tobytes())

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 2])

    @property
    def pre_tokens(self) -> int:
        return int(self.sums[1, 0])

    def before(self, x: int) -> tuple[int, int]:
        """(number of pre-tokens that end at or before character x, where the last of them ends), by descent from the root or, after ``spread``, in the list of all ends."""
        if self.ends is not None:
            k = bisect_right(self.ends, x)
            return k, self.ends[k - 1] if k else 0
        if x >= self.sums[1, 1]:
            return int(self.sums[1, 0]), int(self.sums[1, 1])
        node, k, end = 1, 0, 0
        while node < self.size:
            node *= 2
            if end + self.sums[node, 1] <= x:
                k, end = k + int(self.sums[node, 0]), end + int(self.sums[node, 1])
                node += 1
        ends = end + np.cumsum(self.lengths[k : k + int(self.sums[node, 0])])
        inside = int(np.searchsorted(ends, x, side="right"))
        return k + inside, int(ends[inside - 1]) if inside else end

    def spread(self) -> None:
        """Lists where all pre-tokens end: cheaper than descents for many edits."""
        self.ends = np.cumsum(self.lengths).tolist()

    def replace(self, changes: list[tuple[int, int, np.ndarray, np.ndarray]]) -> None:
        """Replaces pre-tokens first to stop by others, for all changes (in order, apart); only the touched leaves and the sums above them change."""
        starts, last, self.ends = self.starts, len(self.sizes) - 1, None
        groups: list[list] = []
        for change in changes:
            a = min(int(np.searchsorted(starts, change[0], side="right")) - 1, last)
            b = min(max(a, int(np.searchsorted(starts, max(change[0], change[1] - 1), side="right")) - 1), last)
            if groups and a <= groups[-1][1]:
                groups[-1][1] = max(b, groups[-1][1])
                groups[-1][2].append(change)
            else:
                groups.append([a, b, [change]])
        sizes = self.sizes.copy()
        parts: tuple[list, list] = ([], [])
        at, touched = 0, set()
        for a, b, own in groups:
            low, high = int(starts[a]), int(starts[b + 1])
            for old, out, k in ((self.lengths, parts[0], 2), (self.counts, parts[1], 3)):
                out.append(old[at:low])
                leaf, pos = [], low
                for change in own:
                    leaf += [old[pos : change[0]], change[k]]
                    pos = change[1]
                leaf = np.concatenate([*leaf, old[pos:high]])
                out.append(leaf)
                self.sums[self.size + a, k - 1] = leaf.sum(dtype=np.int64)
            at = high
            sizes[a : b + 1] = 0
            sizes[a] = self.sums[self.size + a, 0] = len(leaf)
            self.sums[self.size + a + 1 : self.size + b + 1] = 0
            touched.update(range(self.size + a, self.size + b + 1))
        self.lengths, self.counts = (np.concatenate([*out, old[at:]]) for out, old in zip(parts, (self.lengths, self.counts), strict=True))
        self.sizes, self.starts = sizes, np.concatenate([[0], np.cumsum(sizes)])
        while touched and touched != {1}:
            touched = {i // 2 for i in touched if i > 1}
            for i in touched:
                self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    def replace_many(self, first: np.ndarray, stop: np.ndarray, size: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> None:
        """``replace`` for many changes: pre-tokens first to stop by the next `size` of lengths and counts; whole columns at once, with the same leaves and sums."""
        n, last = len(self.lengths), len(self.sizes) - 1
        gone = np.zeros(n + 1, np.int64)
        np.add.at(gone, first, 1)
        np.add.at(gone, stop, -1)
        kept = np.cumsum(gone[:n]) == 0
        before = np.concatenate([[0], np.cumsum(kept)])
        put = np.cumsum(np.bincount(first, size, n + 1)).astype(np.int64)
        at_old = (before[:n] + put[:n])[kept]
        at_new = np.repeat(before[first], size) + np.arange(len(lengths))
        leaf_old = np.repeat(np.arange(last + 1), self.sizes)[kept]
        leaf_of = np.minimum(np.searchsorted(self.starts, first, side="right") - 1, last)
        total = len(at_old) + len(at_new)
        out, leaf = (np.empty(total, np.int32), np.empty(total, np.int32)), np.empty(total, np.int64)
        for new, old, more in ((out[0], self.lengths, lengths), (out[1], self.counts, counts)):
            new[at_old], new[at_new] = old[kept], more
        # What a change puts in goes to the leaf where it begins, and so does what is left of the leaves that it reaches into.
        reach = np.minimum(np.searchsorted(self.starts, np.maximum(first, stop - 1), side="right") - 1, last)
        to = np.arange(last + 1)
        for a, b in zip(leaf_of[reach > leaf_of].tolist(), reach[reach > leaf_of].tolist(), strict=True):
            to[a + 1 : b + 1] = to[a]
        leaf[at_old], leaf[at_new] = to[leaf_old], np.repeat(to[leaf_of], size)
        self.lengths, self.counts, self.ends = *out, None
        self.sizes = np.bincount(leaf, minlength=last + 1).astype(np.int32)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        row = slice(self.size, self.size + last + 1)
        self.sums[row, 0] = self.sizes
        self.sums[row, 1], self.sums[row, 2] = (np.bincount(leaf, x, last + 1) for x in out)
        level = self.size
        while level > 1:
            half = level // 2
            self.sums[half:level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level = half

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        return self.lengths, self.counts


def clean_edits(edits, length: int) -> list[tuple[int, int, str]]:
    """Edits (start, stop, text) in order, bounds clipped to the text; of overlapping ones the first by start, stop and text stays."""
    out: list[tuple[int, int, str]] = []
    for start, stop, new in sorted((min(max(0, s), length), min(max(0, e), length), t or "") for s, e, t in edits if s is not None and e is not None):
        if stop >= start and (not out or start >= out[-1][1] and (start, stop) != out[-1][:2]):
            out.append((start, stop, new))
    return out


def apply_edits(counter: Counter, tree: Tree, text: str, edits: list[tuple[int, int, str]]) -> tuple[str, int]:
    """The edited text and how many pre-tokens were cut anew; tree then holds the edited text's counts."""
    if not edits:
        return text, 0
    parts, at = [], 0
    places = []  # (old start, old stop, new start, new stop)
    size = 0
    for start, stop, new in edits:
        parts += [text[at:start], new]
        size += start - at
        places.append((start, stop, size, size + len(new)))
        size += len(new)
        at = stop
    after = "".join([*parts, text[at:]])
    many = len(edits) * 32 > len(tree.sizes)
    if many:
        tree.spread()
    found, cuts = [], []  # all new pre-tokens; (first, stop, from, to) of each change
    match = counter.pattern.match
    k = 0
    while k < len(places):
        start, stop, new_start, new_stop = places[k]
        first, end = tree.before(max(0, start - CONTEXT))
        pos, begin = end + new_start - start, len(found)
        while True:
            back = pos - new_stop + stop  # where this position was, if behind the edit
            while k + 1 < len(places) and places[k + 1][0] - CONTEXT <= back:
                k += 1
                start, stop, new_start, new_stop = places[k]
                back = pos - new_stop + stop
            if pos >= new_stop:
                last, end = tree.before(back)
                if end == back:
                    break
            m = match(after, pos)
            if m is None:
                last = tree.pre_tokens
                break
            found.append(m.group())
            pos = m.end()
        cuts.append((first, last, begin, len(found)))
        k += 1
    lengths, counts = np.fromiter(map(len, found), np.int32, len(found)), counter.count(found)
    if many and len(cuts) > 2:
        first, last, a, b = (np.array(x, np.int64) for x in zip(*cuts, strict=True))
        tree.replace_many(first, last, b - a, lengths, counts)
    else:
        tree.replace([(first, last, lengths[a:b], counts[a:b]) for first, last, a, b in cuts])
    return after, len(found)


def masking_edits(docs: DataFrame, pattern: str = "[0-9]{4,}|[*#$%&!]{2,}", mask: str = "0", head: str = "", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """docs with edits, in place of any column so named, that put head before the text and mask for each match of pattern; a null text has no edits.

    Rows repeated give rows repeated; empty texts get the head only.
    """
    import re

    found = re.compile(pattern)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("text", pa.string())]))
    names = [c for c in docs.columns if c != edits_col]
    plain, at = docs.select(*[named(c) for c in names]), names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, stops, offsets, new, null = [], [], [0], [], []
            for t in batch.column(at).to_pylist():
                if t is not None:
                    if head:
                        starts.append(0)
                        stops.append(0)
                        new.append(head)
                    spans = [m.span() for m in found.finditer(t)]
                    starts += [a for a, _ in spans]
                    stops += [b for _, b in spans]
                    new += [mask] * len(spans)
                null.append(t is None)
                offsets.append(len(starts))
            edits = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(stops, pa.int64()), pa.array(new, pa.string())], fields=list(kind.value_type))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), edits, mask=pa.array(null, pa.bool_()))], names=[*names, edits_col])

    return map_in_arrow(plain, run, T.StructType([*plain.schema.fields, T.StructField(edits_col, T._parse_datatype_string("array<struct<start: bigint, stop: bigint, text: string>>"))]))


@lru_cache(maxsize=2)
def load(ranks: str) -> Counter:
    return Counter(ranks if ranks.startswith("/") else SparkFiles.get(ranks))


_TREE = pa.struct([(name, pa.binary()) for name in ("lengths", "counts", "leaves", "sums")])


def _tree_column(trees: list[Tree]) -> pa.Array:
    columns = list(zip(*(t.dump() for t in trees), strict=True)) if trees else [[]] * 4
    return pa.StructArray.from_arrays([pa.array(c, pa.binary()) for c in columns], fields=list(_TREE))


def _building(names: list[str], at: int, ranks: str):
    """Batches of columns names, texts at `at`, with n_tokens and tree behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(ranks)
        for batch in batches:
            for i in range(0, batch.num_rows, 250):
                part = batch.slice(i, 250)
                trees = counter.trees(pc.fill_null(part.column(at), "").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([t.tokens for t in trees], pa.int64()), _tree_column(trees)], names=[*names, "n_tokens", "tree"])

    return run


def build(docs: DataFrame, text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """docs with n_tokens and tree (see TREE) in place of any columns so named.

    A null text counts as empty, with no pre-tokens.  Rows repeated give rows repeated.
    """
    names = [c for c in docs.columns if c not in ("n_tokens", "tree")]
    plain = docs.select(*[named(c) for c in names])
    return map_in_arrow(plain, _building(names, names.index(text_col), ranks), with_fields(plain.schema, f"n_tokens bigint, tree {TREE}"))


def _edit_lists(edits: pa.Array) -> tuple[list[int], list[list]]:
    """(where each row's edits begin, and end; starts, stops and texts of all edits); a null list has none."""
    bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(edits), 0).to_numpy(zero_copy_only=False))]).tolist()
    flat = edits.flatten()
    return bounds, [x.to_pylist() for x in flat.flatten()]


_RESULTS = ("n_edits", "n_tokens_after", "n_pre_tokens", "n_cut_anew")


def _updating(names: list[str], text_col: str, edits_col: str, ranks: str, keep: bool):
    """(which of the columns names stay, a function of batches of those columns that gives these and _RESULTS)."""
    text_at, tree_at, edits_at = (names.index(c) for c in (text_col, "tree", edits_col))
    gone = {edits_at} if keep else {edits_at, text_at, tree_at}
    kept = [i for i in range(len(names)) if i not in gone]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(ranks)
        for batch in batches:
            for i in range(0, batch.num_rows, 250):
                part = batch.slice(i, 250)
                columns, rows, texts, trees = list(part.columns), [], [], []
                held = list(zip(*(columns[tree_at].field(k).to_pylist() for k in range(4)), strict=True))
                whole, bounds, lists = columns[tree_at].is_valid().to_pylist(), *_edit_lists(columns[edits_at])
                for k, text in enumerate(columns[text_at].to_pylist()):
                    tree = counter.tree(text or "") if not whole[k] or None in held[k] else Tree.load(*held[k])
                    size = tree.pre_tokens
                    todo = clean_edits(zip(*(x[bounds[k] : bounds[k + 1]] for x in lists), strict=True), len(text or ""))
                    after, anew = apply_edits(counter, tree, text or "", todo)
                    rows.append((len(todo), tree.tokens, size, anew))
                    if keep:
                        texts.append(after if todo else text)
                        trees.append(tree)
                if keep:
                    columns[text_at], columns[tree_at] = pa.array(texts, columns[text_at].type), _tree_column(trees)
                found = list(zip(*rows, strict=True)) if rows else [[]] * len(_RESULTS)
                yield pa.RecordBatch.from_arrays([*(columns[k] for k in kept), *(pa.array(c, pa.int64()) for c in found)], names=[*(names[k] for k in kept), *_RESULTS])

    return kept, run


def update(built: DataFrame, text_col: str = "text", edits_col: str = "edits", ranks: str = RANKS, keep: bool = True) -> DataFrame:
    """What ``build`` gave, with a column of edits, after the edits: text and tree are the edited ones, n_tokens is as it was.

    New are n_edits, n_tokens_after, n_pre_tokens (before) and n_cut_anew, in place of any columns so named; the
    edits go.  Without keep, text and tree go too.  edits is an array of struct(start, stop, text) in characters
    of the text; null counts as none, bounds are clipped to the text, a null replacement deletes, and of
    overlapping or equal ones the first stays (n_edits counts those that stay).  A null text counts as empty and
    stays null without edits; a null tree is built.  Only pre-tokens at edits are cut and counted.
    """
    names = [c for c in built.columns if c not in _RESULTS]
    plain = built.select(*[named(c) for c in names])
    kept, run = _updating(names, text_col, edits_col, ranks, keep)
    return map_in_arrow(plain, run, with_fields(T.StructType([plain.schema.fields[k] for k in kept]), ", ".join(f"{c} bigint" for c in _RESULTS)))


def recount(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", ranks: str = RANKS) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_edits, n_tokens_after, n_pre_tokens, n_cut_anew.

    What ``build`` and ``update`` do, one after the other in one worker: trees never leave it, and words are remembered once.
    """
    chosen = docs.select(named(id_col).cast("bigint").alias("doc_id"), named(text_col).alias("text"), named(edits_col).alias("edits"))
    built = _building(chosen.columns, 1, ranks)
    _, updated = _updating([*chosen.columns, "n_tokens", "tree"], "text", "edits", ranks, keep=False)
    return map_in_arrow(chosen, lambda batches: updated(built(batches)), with_fields(T.StructType([]), ", ".join(f"{c} bigint" for c in ("doc_id", "n_tokens", *_RESULTS))))
