"""Exact dedup, the Jaccard join and components, against brute force."""

import hashlib
import random
import re
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from variantforge.llm.components import components
from variantforge.llm.exact_dedup import PatriciaTrie, exact_dedup
from variantforge.llm.parity_join import Bands, Chosen, Counts, digests, folded, parity_join, part_words, sketch_of
from variantforge.llm.scratch import Scratch, checkpoint_root
from variantforge.llm.words import shingle_set, word_hashes

WS = re.compile("[\x20\x09-\x0d]+")


def test_trie_against_a_dict():
    r = random.Random(2)
    trie, want = PatriciaTrie(), {}
    for i in range(3000):
        key = bytes(r.choice(b"ab") for _ in range(r.randrange(12))) * r.choice([1, 1, 40])
        trie.insert(key, list).append(i)
        want.setdefault(key, []).append(i)
    assert dict(trie.entries()) == want
    out = dict(trie.remove_heaviest(stub=True))
    assert out and all(want[k] == v for k, v in out.items())
    rest = dict(trie.entries())
    assert rest.keys() | out.keys() == want.keys() and not rest.keys() & out.keys()
    for key in out:
        assert trie.insert(key, list) is None
    for key in rest:
        assert trie.insert(key, list) is want[key] or trie.insert(key, list) == want[key]


def brute_exact(rows):
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(WS.sub("", t or ""), []).append((-len(t or ""), 2**63 if i is None else i))
    return {n: (None if min(g)[1] == 2**63 else min(g)[1], len(g)) for n, g in groups.items()}


EXACT = [(5, "a b"), (3, "ab"), (9, "a  b"), (1, "ab c"), (2, None), (4, ""), (6, " \n"), (7, "é\u00a0x"), (8, "éx"), (None, "z"), (10, "z"), (11, "t\x0bq"), (12, "tq"), (13, "x" * 300_000), (14, "x " * 300_000)]


@pytest.mark.parametrize("budget", [64 << 20, 6000])
def test_exact_dedup(docs, budget):
    r = random.Random(4)
    rows = EXACT + [(100 + i, r.choice(["hot text", "hot  text", f"cold {i % 37}", f"only {i}"])) for i in range(400)]
    got = exact_dedup(docs(rows), trie_bytes=budget).collect()
    want = brute_exact(rows)
    assert len(got) == len(rows)
    text = dict(rows)
    for g in got:
        norm = WS.sub("", text[g["doc_id"]] or "")
        assert (g["keep_id"], g["group_size"]) == want[norm], g
        assert g["text_sha256"] == hashlib.sha256(norm.encode()).hexdigest()
        assert g["kept"] == (g["doc_id"] == g["keep_id"])


def test_tries_stay_in_their_budget():
    """Texts with a long common start: a trie's weight covers what it takes, and giving up a subtree puts one key together at a time."""
    r, start = random.Random(5), b"s" * 100_000
    trie = PatriciaTrie()
    tracemalloc.start()
    for i in range(3000):
        trie.insert(start + b"%d" % r.randrange(10**9), lambda: [0, -1, None, 2**63 - 1, i, hashlib.sha256(b"%d" % i).hexdigest(), i])  # noqa: B023
    held, _ = tracemalloc.get_traced_memory()
    assert 300_000 < held < 1.2 * trie.weight < 4 * held  # the keys themselves are 300 MB
    tracemalloc.reset_peak()
    gone = sum(len(key) > 100_000 for key, _ in trie.remove_heaviest(stub=True))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert gone > 100 and peak - held < 2_000_000


def test_exact_dedup_of_repeated_rows_and_none(docs):
    got = exact_dedup(docs([(1, "a"), (1, "a"), (1, "a"), (2, "b")])).collect()
    assert sorted((g["doc_id"], g["kept"], g["group_size"]) for g in got) == [(1, False, 3), (1, False, 3), (1, True, 3), (2, True, 1)]
    assert exact_dedup(docs([])).count() == 0


def shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) if x]
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def brute_join(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def family(r, base, n, first):
    """Chains of edits of one text, so that links reach further than any pair."""
    words = [f"w{r.randrange(5000)}" for _ in range(base)]
    out = []
    for i in range(n):
        for _ in range(r.randrange(1, 4)):
            words[r.randrange(len(words))] = f"e{r.randrange(9999)}"
        out.append((first + i, " ".join(words)))
    return out


@pytest.mark.parametrize(("block_bytes", "block_sets", "rounds"), [(2 << 20, 500, 3), (3000, 8, 1), (2 << 20, 5, 3)])
def test_parity_join(docs, block_bytes, block_sets, rounds):
    r = random.Random(7)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "a b"), (7, "A  b"), (8, "a b c"), (9, "x " * 50_000), (10, "x " * 60_000), (11, "É a b"), (12, "é a b")]
    for k, base in enumerate((12, 40, 90, 90, 200, 600)):
        rows += family(r, base, 25, 1000 * (k + 1))
    rows += [(50_000 + i, rows[20 + i % 9][1].upper()) for i in range(60)]
    got = {g["doc_id"]: (g["n_shingles"], g["component_id"]) for g in parity_join(docs(rows), 3, 9, 10, block_bytes=block_bytes, block_sets=block_sets, rounds=rounds).collect()}
    assert got == brute_join(rows)


def test_parity_join_of_repeated_null_and_no_rows(docs):
    text = " ".join(f"w{i}" for i in range(40))
    got = parity_join(docs([(3, text), (3, text), (7, text + " end"), (None, text), (9, "")]), 3, 9, 10).collect()
    assert sorted((str(g["doc_id"]), str(g["component_id"])) for g in got) == [("3", "3"), ("3", "3"), ("7", "3"), ("9", "9"), ("None", "None")]
    assert parity_join(docs([])).count() == 0


def test_sketch_bounds_and_shared_words():
    r = np.random.Generator(np.random.PCG64(3))
    bands = Bands(9, 10)
    for n in (9, 10, 20, 57, 300, 2000):
        for _ in range(30):
            pool = r.integers(0, 2**63, 2 * n, dtype=np.uint64)
            a = np.sort(pool[:n])
            drop = r.integers(0, n // 12 + 1)
            b = np.sort(np.concatenate([pool[drop:n], pool[n : n + r.integers(0, n // 12 + 1)]]))
            apart, both = len(np.setxor1d(a, b)), len(np.intersect1d(a, b))
            for parts in (1, 7, 40):
                assert np.bitwise_count(part_words(a, parts) ^ part_words(b, parts)).sum() <= apart
            assert (folded(part_words(a, 16), 4) == part_words(a, 4)).all()
            words = min(len(sketch_of(a)), len(sketch_of(b)))
            assert np.bitwise_count(folded(sketch_of(a), words) ^ folded(sketch_of(b), words)).sum() <= apart
            if 10 * both >= 9 * (len(a) + len(b) - both) and apart:
                assert apart <= bands.most_apart(len(a) + len(b))
                keys = [digests(x, bands) for x in (a, b)]
                common = np.intersect1d(*keys)
                for frequent in (np.zeros(0, np.uint64), common[:-1], common[::-1], common):  # whatever counts as frequent, a shared key stays
                    chosen = Chosen(9, 10, frequent)
                    mine, theirs = (chosen.of([1], [len(x)], [y.tobytes()])[0] for x, y in zip((a, b), keys, strict=True))
                    assert len(np.intersect1d(mine, theirs))


def test_counts():
    counts = Counts(kinds=50, gather=1000)
    r = np.random.Generator(np.random.PCG64(4))
    for _ in range(100):
        counts.add(np.concatenate([np.arange(20, dtype=np.uint64), r.integers(100, 2**60, 80, dtype=np.uint64)]))
    counts.flush()
    assert len(counts.keys) <= 50 and dict(zip(counts.keys.tolist(), counts.times.tolist(), strict=True)).items() >= {(i, 100) for i in range(20)}


def test_strangers_with_common_passages_meet_no_one(spark, docs):
    """Candidate pairs of random texts that share passages stay few, and the join stays exact."""
    r = random.Random(12)
    passages = [[f"p{i}_{j}" for j in range(50)] for i in range(3)]
    rows = []
    for i in range(1500):
        own = [f"w{r.randrange(10**6)}" for _ in range(150)]
        at = r.randrange(150)
        rows.append((i, " ".join(own[:at] + passages[i % 3] + own[at:])))
    rows += [(9000 + i, rows[i][1] + " tail") for i in range(30)]
    got = {g["doc_id"]: g["component_id"] for g in parity_join(docs(rows)).collect()}
    assert got == {i: i - 9000 if i >= 9000 else i for i, _ in rows}
    bands, keys, node = Bands(8, 10), [], []
    for i, (_, text) in enumerate(rows[:1500]):
        own = digests(shingle_set(dict(word_hashes(pa.array([text])))[0], 5), bands)
        keys.append(own)
        node.append(i)
    kinds, times = np.unique(np.concatenate(keys), return_counts=True)
    pick = Chosen(8, 10, kinds[np.argsort(times, kind="stable")][np.sort(times) >= 32])
    size = len(shingle_set(dict(word_hashes(pa.array([rows[0][1]])))[0], 5))
    key, _ = pick.of(node, [size] * len(node), [k.tobytes() for k in keys])
    _, met = np.unique(key, return_counts=True)
    assert (met * (met - 1) // 2).sum() < 100  # about 190,000 pairs share a passage


def test_words():
    texts = ["Ab\tcd", None, "", "x" * 3_000_000 + " y", "é É", "ab CD"]
    got = dict(word_hashes(pa.array(texts)))
    assert [len(got[i]) for i in range(6)] == [2, 0, 0, 2, 2, 2]
    assert (got[0] == got[5]).all() and got[4][0] != got[4][1]
    assert len(shingle_set(got[0])) == 1 and len(shingle_set(got[1])) == 0
    assert (dict(word_hashes(pa.chunked_array([texts]).combine_chunks().slice(4)))[1] == got[5]).all()


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(0, 3000) if i % 100] + [(5000, 5000 + i) for i in range(1, 900)] + [(7000, 7000)]
    r.shuffle(links)
    import variantforge.llm.components as module

    limit, module.LAST_LINKS = module.LAST_LINKS, 50
    try:
        got = components(spark.createDataFrame(links, "a bigint, b bigint"), Scratch(spark, "t"), "c").collect()
    finally:
        module.LAST_LINKS = limit
    root = {g["node"]: g["root"] for g in got}
    assert len({root[i] for i in range(5000, 5900)}) == 1
    for i in range(0, 2900, 100):
        assert len({root[j] for j in range(i + 1, i + 101)}) == 1
    assert len(set(root.values())) == 31


def test_scratch_needs_a_shared_folder_and_goes_with_the_application(spark):
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(cluster)
    scratch = Scratch(spark, "t")
    kept = scratch.cut(spark.range(3), "a")
    assert kept.count() == 3 and scratch.root.startswith(checkpoint_root(spark))
    scratch.drop("a", "never written")
    path, fs = scratch._path("a")
    assert not fs.exists(path)


def test_operators_leave_the_session_alone(spark, docs):
    names = ("maxRecordsPerBatch", "maxBytesPerBatch")
    before = [spark.conf.get(f"spark.sql.execution.arrow.{n}") for n in names]
    parity_join(docs([(1, "a b c d e f"), (2, "a b c d e f g")])).collect()
    exact_dedup(docs([(1, "a")])).collect()
    assert [spark.conf.get(f"spark.sql.execution.arrow.{n}") for n in names] == before


def test_join_stores_no_keys(spark, docs, monkeypatch):
    """Of strangers, which meet no one, the tables of a join hold a few numbers each, not the keys that outweigh their texts."""
    r, stored, cut = random.Random(3), {}, Scratch.cut

    def seen(self, df, name):
        out = cut(self, df, name)
        path, fs = self._path(name)
        stored[name] = fs.getContentSummary(path).getLength()
        return out

    monkeypatch.setattr(Scratch, "cut", seen)
    rows = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(300))) for i in range(600)]
    rows += [(9000 + i, rows[i][1] + " tail") for i in range(5)]
    got = {g["doc_id"]: g["component_id"] for g in parity_join(docs(rows)).collect()}
    assert got == {i: i - 9000 if i >= 9000 else i for i, _ in rows}
    assert sum(stored.values()) < sum(len(t) for _, t in rows) / 4
