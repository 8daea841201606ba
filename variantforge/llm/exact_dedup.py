"""Exact deduplication by Patricia-trie owners.

Texts are equal when they agree byte for byte after every character of ``[\\x20\\x09-\\x0D]`` is deleted.
Each map task inserts its normalised texts into a compressed radix trie (so a group of copies leaves the
task as one row), the distinct texts are dealt by length and content hash, and each partition's trie
decides the owner of every text: terminal nodes keep the smallest identifier among the longest originals.
A trie over its memory budget gives up its heaviest subtree; on the map side those partial groups are
simply sent on, in a partition they go, complete, to another round through the shared folder.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes that a trie may take before it gives up a subtree.
TRIE_BYTES = 64 << 20
_GONE = object()


#: Bytes that a node, and the value of a terminal one, take besides their label.
NODE_BYTES, VALUE_BYTES = 240, 420


class _Node:
    __slots__ = ("children", "count", "label", "value", "weight")

    def __init__(self, label: bytes, value=None):
        self.label, self.value, self.weight, self.count = label, value, len(label) + NODE_BYTES, 0
        self.children: dict[int, object] = {}


class PatriciaTrie:
    """A compressed radix trie over whole byte strings; values sit on terminal nodes.

    Each node knows the bytes of its subtree (labels, nodes and values) and how many terminal nodes it has.
    """

    def __init__(self):
        self.root = _Node(b"")

    @property
    def weight(self) -> int:
        return self.root.weight

    @property
    def size(self) -> int:
        return self.root.count

    def insert(self, key: bytes, make):
        """The value stored for key, made by make() if new; None if the key falls into a removed subtree."""
        node, at, path = self.root, 0, [self.root]
        while at < len(key):
            child = node.children.get(key[at])
            if child is _GONE:
                return None
            if child is None:
                child = _Node(key[at:])
                node.children[key[at]] = child
                self._grow(path, child.weight)
                node, at = child, len(key)
                path.append(child)
                break
            label = child.label
            if not key.startswith(label, at):
                same = _shared(label, key, at)
                upper = _Node(label[:same])
                child.label = label[same:]
                child.weight -= same
                upper.weight += child.weight
                upper.count = child.count
                upper.children[child.label[0]] = child
                node.children[key[at]] = upper
                self._grow(path, NODE_BYTES)
                child = upper
            at += len(child.label)
            path.append(child)
            node = child
        if node.value is None:
            node.value = make()
            self._grow(path, VALUE_BYTES, 1)
        return node.value

    @staticmethod
    def _grow(path: list[_Node], weight: int, count: int = 0) -> None:
        for x in path:
            x.weight += weight
            x.count += count

    def remove_heaviest(self, stub: bool) -> Iterator[tuple[bytes, object]]:
        """Takes out a heavy subtree (not over half of the whole where that can be) and yields its entries, one key at a time.

        With stub, later keys of that subtree are refused by ``insert``.  The last entry never goes, so a
        text larger than any budget is decided all the same and every round of spilling decides some text.
        """
        node, prefix, path = self.root, b"", [self.root]
        while True:
            live = [c for c in node.children.values() if c is not _GONE]
            if not live:
                return iter(())
            top = max(live, key=lambda c: c.weight)
            if top.weight * 2 <= self.weight or not top.children:
                break
            prefix, node = prefix + top.label, top
            path.append(node)
        if top.weight * 2 > self.weight and len(live) > 1:
            live.remove(top)
            top = max(live, key=lambda c: c.weight)
        if top.count == self.size:
            return iter(())
        if stub:
            node.children[top.label[0]] = _GONE
        else:
            del node.children[top.label[0]]
        self._grow(path, -top.weight, -top.count)
        return self.entries(top, prefix)

    def entries(self, node: _Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, object]]:
        """(key, value) of all terminal nodes; one key is put together at a time."""
        key, stack = bytearray(prefix), [(node or self.root, len(prefix))]
        while stack:
            node, depth = stack.pop()
            del key[depth:]
            key += node.label
            if node.value is not None:
                yield bytes(key), node.value
            stack.extend((c, len(key)) for c in node.children.values() if c is not _GONE)


def _shared(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of label and key[at:]."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == key[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


#: Sorts after every identifier; stands for a null doc_id.
_NO_ID = 2**63 - 1
_MAP = pa.schema(
    [("kind", pa.int32()), ("doc_id", pa.int64()), ("row", pa.int64()), ("part", pa.int64()), ("sha", pa.string())]
    + [("klen", pa.int64()), ("khash", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("points", pa.int64()), ("crc", pa.int64())]
)
_MAP_SQL = "kind int, doc_id bigint, row bigint, part bigint, sha string, klen bigint, khash bigint, key binary, n bigint, points bigint, crc bigint"


def _better(state: list, points: int, doc_id: int | None, row: int) -> None:
    """Keeps in state[1:] the best of what it has and (points, doc_id, row)."""
    mine = (-points, _NO_ID if doc_id is None else doc_id, row)
    if mine < (-state[1], _NO_ID if state[2] is None else state[2], state[3]):
        state[1], state[2], state[3] = points, doc_id, row


def _group_rows(entries: Iterable[tuple[bytes, list]]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 1: a text with its number of rows and its best row so far. value: [n, points, doc_id, row, part, sha]."""
    out, size = [], 0

    def batch():
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _MAP, strict=True)], schema=_MAP)

    for key, (n, points, doc_id, row, part, sha) in entries:
        out.append((1, doc_id, row, part, sha, len(key), int.from_bytes(bytes.fromhex(sha[:16]), "big", signed=True), key, n, points, None))
        size += len(key)
        if size > 8 << 20 or len(out) == 4096:
            yield batch()
            out, size = [], 0
    if out:
        yield batch()


def _local(trie_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seen, trie = TaskContext.get().partitionId() << 33, 0, PatriciaTrie()
        for batch in batches:
            ids, text = batch.column(0).to_pylist(), pc.fill_null(batch.column(1), "")
            points = pc.utf8_length(text).to_pylist()
            rows, parts, shas, crcs = [], [], [], []
            for i, raw in enumerate(text.cast(pa.binary() if text.type == pa.string() else pa.large_binary()).to_pylist()):
                key, row = raw.translate(None, WHITE), base + seen
                seen += 1
                state = trie.insert(key, lambda: [0, -1, None, row, row, hashlib.sha256(key).hexdigest()])  # noqa: B023
                state[0] += 1
                _better(state, points[i], ids[i], row)
                rows.append(row)
                parts.append(state[4])
                shas.append(state[5])
                crcs.append(zlib.crc32(raw))
                if trie.weight > trie_bytes:
                    yield from _group_rows(trie.remove_heaviest(stub=False))
            n = len(rows)
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * n, pa.int32()), batch.column(0).cast(pa.int64()), pa.array(rows, pa.int64()), pa.array(parts, pa.int64()), pa.array(shas, pa.string()), none, none, pa.nulls(n, pa.binary()), none, none, pa.array(crcs, pa.int64())],
                schema=_MAP,
            )
        yield from _group_rows(trie.entries())

    return run


_OWN = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("text_no", pa.int64()), ("owner", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), *[_MAP.field(i) for i in (1, 2, 4, 5, 6, 7, 8, 9)]])
_OWN_SQL = "kind int, part bigint, text_no bigint, owner bigint, keep_id bigint, group_size bigint, doc_id bigint, row bigint, sha string, klen bigint, khash bigint, key binary, n bigint, points bigint"
#: Kinds of rows: which text a part belongs to; a decided text; a text (or a part of one) for the next round.
_LINK, _DECIDED, _LATE = range(3)


def _own_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({f.name: [r.get(f.name) for r in rows] for f in _OWN}, schema=_OWN)


def _owners(trie_bytes: int):
    """Links (part, text_no) of all rows, then the owners of decided texts; texts of subtrees given up leave as one row each, under their text_no.

    Links leave at once, so a text holds no more in memory when more parts of it arrive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, base, texts = PatriciaTrie(), TaskContext.get().partitionId() << 33, 0

        def late(rows: Iterable[dict]) -> Iterator[pa.RecordBatch]:
            out, size = [], 0
            for r in rows:
                out.append(r)
                size += len(r.get("key") or b"")
                if size > 8 << 20 or len(out) == 4096:
                    yield _own_batch(out)
                    out, size = [], 0
            if out:
                yield _own_batch(out)

        def given_up(entries: Iterable[tuple[bytes, list]]) -> Iterator[dict]:
            for key, (n, points, doc_id, row, text_no, sha, khash) in entries:
                yield {"kind": _LATE, "part": text_no, "n": n, "points": points, "doc_id": doc_id, "row": row, "sha": sha, "khash": khash, "klen": len(key), "key": key}

        for batch in batches:
            links = []
            for r in batch.to_pylist():
                state = trie.insert(r["key"], lambda: [0, -1, None, 2**63 - 1, base + texts, r["sha"], r["khash"]])  # noqa: B023
                if state is None:
                    links += [{"kind": _LINK, "part": r["part"], "text_no": base + texts}, {**r, "kind": _LATE, "part": base + texts}]
                    texts += 1
                    continue
                if not state[0]:
                    texts += 1
                state[0] += r["n"]
                _better(state, r["points"], r["doc_id"], r["row"])
                links.append({"kind": _LINK, "part": r["part"], "text_no": state[4]})
                while trie.weight > trie_bytes and trie.size > 1:
                    before = trie.size
                    yield from late(given_up(trie.remove_heaviest(stub=True)))
                    if trie.size == before:
                        break
            yield from late(links)
        yield from late({"kind": _DECIDED, "text_no": state[4], "owner": state[3], "keep_id": state[2], "group_size": state[0]} for _, state in trie.entries())

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, text_crc.

    A null text counts as empty, and all empty texts form one group. Of equal texts the row with the most
    code points in the original stays, then the smallest doc_id; a null doc_id sorts last. Of rows repeated
    with one doc_id, exactly one is kept. Other columns of docs are not read. An empty table gives no rows.
    text_sha256 is of the normalised text in UTF-8, text_crc (crc32) of the original.  The result reads the
    tables of scratch, which a caller that has stored it may delete.
    """
    scratch = scratch or Scratch(docs.sparkSession, "exact_dedup")
    pairs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    local = scratch.cut(pairs.mapInArrow(_local(trie_bytes), _MAP_SQL), "local")
    groups = local.where("kind = 1").drop("kind", "crc")
    rounds = []
    while True:
        dealt = groups.repartition("klen", "khash")
        rounds.append(scratch.cut(dealt.mapInArrow(_owners(trie_bytes), _OWN_SQL), f"owners{len(rounds)}"))
        groups = rounds[-1].where(F.col("kind") == _LATE).drop("kind", "text_no", "owner", "keep_id", "group_size")
        if groups.isEmpty():
            break
    found = None  # (part, owner, keep_id, group_size), from the last round back to the first
    for out in reversed(rounds):
        decided = out.where(F.col("kind") == _DECIDED).select("text_no", "owner", "keep_id", "group_size")
        if found is not None:
            decided = decided.unionByName(found.withColumnRenamed("part", "text_no"))
        found = out.where(F.col("kind") == _LINK).select("part", "text_no").join(decided, "text_no").drop("text_no")
    rows = local.where("kind = 0").select("doc_id", "row", "part", F.col("sha").alias("text_sha256"), F.col("crc").alias("text_crc"))
    return rows.join(found, "part").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("owner")).alias("kept"), "text_sha256", "text_crc")
