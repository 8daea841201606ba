"""Cases of the first review."""

import random

import corpus_pipeline

from variantforge.llm import licences, pieces, pseudonyms
from variantforge.llm.parity_join import parity_join

from .test_texts import prose


def word_sets(text, k):
    w = text.split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_components(rows, k, num, den):
    """Least linked id of each row, by brute force."""
    sets, up = {i: word_sets(t, k) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        return x if up[x] == x else root(up[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in sets}


def near_rows(r):
    rows = []
    for base in (4, 9, 25, 60, 100, 100, 300):
        words = prose(r, base).split()
        for _ in range(20):
            rows.append((len(rows), " ".join(words)))
            for _ in range(r.randrange(1, 2 + base // 40)):
                words[r.randrange(base)] = f"e{r.randrange(9999)}"
    return rows


def test_near_copies_by_five_words(spark, docs):
    rows = near_rows(random.Random(5))
    words = [f"w{i}" for i in range(100)]
    rows += [(900, " ".join(words)), (901, " ".join([*words[:30], "x", *words[31:70], "y", *words[71:]]))]
    want = near_components(rows, 5, 8, 10)
    assert want[901] == 900 and near_components(rows, 3, 9, 10) != want
    got = corpus_pipeline.drop_near_copies(spark, docs(rows), "").collect()
    assert sorted(g["doc_id"] for g in got) == sorted(set(want.values()))
    for k, num, den in ((2, 1, 2),):
        want = near_components(rows, k, num, den)
        assert {g["doc_id"]: g["component_id"] for g in parity_join(docs(rows), k, num, den).collect()} == want


def test_copies_without_id_leave_the_keys_to_others(docs):
    words = [f"w{i}" for i in range(60)]
    text, near = " ".join(words), " ".join([*words[:-1], "end"])
    rows = docs([(7, near), (None, text), (3, text)], parts=1).coalesce(1).sortWithinPartitions("doc_id")
    got = {g["doc_id"]: g["component_id"] for g in parity_join(rows).collect()}
    assert got == {None: None, 3: 3, 7: 3}


def test_cards_beside_other_numbers_and_dates_with_times():
    key, r = b"test key", random.Random(6)
    card = "4111 1111 1111 1111"
    for text, kinds in (
        (card + " 12/25", ["card"]),
        ("6011000990139424 4845168114407329", ["card", "card"]),
        ("12 " + card, ["card"]),
        (card + " 1980-05-17 and 1980-05-17T00:00:00Z", ["card", "day", "day"]),
        (card + " 12/31/1999", ["card", "day"]),
        (card + " " + card, ["card", "card"]),
        (card + " 10.0.0.1", ["card", "ipv4"]),
    ):
        new, found = pseudonyms.pseudonymise(text, key)
        assert found == kinds and pseudonyms.pseudonymise(new, key, inverse=True) == (text, kinds), text
        assert new[:19] != text[:19]
    assert pseudonyms.pseudonymise("1980-05-17Tx", key)[1] == []
    for _ in range(1000):  # whatever stands in a run, it can be undone
        text = "".join(r.choice([card, "378282246310005", "call 555-0123", "123-45-6789", "2001-02-03", "10.0.0.1", str(r.randrange(10 ** r.randrange(1, 9)))]) + r.choice("  -/") for _ in range(6))
        new, kinds = pseudonyms.pseudonymise(text, key)
        assert pseudonyms.pseudonymise(new, key, inverse=True) == (text, kinds), text


def test_shortened_and_widened_notices_in_long_texts():
    r = random.Random(7)
    index = licences.Templates(licences.TEMPLATES)
    for _, text in licences.TEMPLATES:
        for kind in range(2):
            w = licences.normal(text).decode().split()
            if len(w) < 10:
                continue
            w = w[: len(w) * 3 // 4 + 1] if kind == 0 else w[: len(w) // 2] + prose(r, len(w) // 5).split() + w[len(w) // 2 :]
            (_, alone), (_, inside) = licences._words([" ".join(w), prose(r, 50) + " " + " ".join(w) + " " + prose(r, 50)])
            best, held = (max((h[1] for h in licences.scan(index, x)), default=0) for x in (alone, inside))
            assert held == best and best >= licences.THRESHOLD, text
    (_, words), = licences._words([prose(r, 30) + " Licensed under the GNU General Public License, version 3. " + prose(r, 30)])
    assert [(h[0], round(h[1], 3)) for h in licences.scan(index, words)] == [("GPL-3.0", 0.842)]


def test_each_occurrence_of_a_word_is_decided_for_itself():
    p, text = pieces.load(pieces.MODEL), "wonderful considerations " * 2000 + "x" * 60
    key = pieces.mix1(5 ^ pieces.mix1(pieces.SEED + 1))
    ids, offsets = pieces.encode_texts(p, [text], [5])
    one_by_one = [pieces.encode_word(p, w, (key + i) % 2**64, pieces.SEED, pieces.DROPOUT) for i, w in enumerate(p.words.findall(" " + text))]
    assert ids.tolist() == [x for found in one_by_one for x in found]
    assert len({tuple(x) for x in one_by_one[:-1:2]}) > 8


def test_different_texts_under_one_id_are_both_judged(spark, docs):
    r = random.Random(8)
    one, two, three = (prose(r, 60) for _ in range(3))
    rows = [(5, one), (5, two), (5, two), (3, three), (5, three + " tail"), (None, one)]
    got = corpus_pipeline.drop_near_copies(spark, docs(rows), "")
    assert sorted((str(g["doc_id"]), g["text"]) for g in got.collect()) == sorted([("5", one), ("5", two), ("3", three), ("None", one)])
    assert got.columns == docs([]).columns
