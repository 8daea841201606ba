"""Decontamination, encoding, token counts, pseudonyms and licences, against brute force and round trips."""

import random

import numpy as np
import pytest
import sentencepiece

from variantforge.llm import decontaminate, licences, pieces, pseudonyms, token_counts

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def prose(r, n):
    return " ".join("".join(r.choice(LETTERS) for _ in range(r.randrange(2, 8))) for _ in range(n))


def least_edits(item: bytes, text: bytes) -> int:
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edited(r, text, k):
    s = list(text)
    for _ in range(k):
        i = r.randrange(len(s))
        what = r.random()
        if what < 0.4:
            s[i] = r.choice(LETTERS)
        elif what < 0.7:
            del s[i]
        else:
            s.insert(i, r.choice(LETTERS))
    return "".join(s)


def test_leaks_against_brute_force(spark, docs):
    r = random.Random(3)
    items = [(i, prose(r, r.choice([3, 12, 30]))) for i in range(12)] + [(50, None), (51, ""), (52, "short"), (53, prose(r, 20).upper() + "!"), (54, items_repeat := "the the the the the the the the the the")]
    rows = [(1, None), (2, ""), (3, "the " * 3000), (4, items[3][1].replace(" ", "...\n").upper()), (5, prose(r, 200)), (6, prose(r, 60_000) + " " + items[1][1] + " " + prose(r, 9_000))]
    for i in range(60):
        item = items[r.randrange(12)][1]
        rows.append((10 + i, prose(r, 30) + " " + edited(r, item, r.randrange(0, len(item) // 6 + 1)) + " " + prose(r, 30)))
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = {(g["doc_id"], g["item_id"]): g["edits"] for g in decontaminate.find_leaks(docs(rows), bench).collect()}
    index = decontaminate.build_index([x for x in items])
    want = {}
    for i, text in rows:
        form = decontaminate.normal(text)
        for item_id, item, k in zip(index.ids, index.items, index.edits, strict=True):
            if len(form) > 50_000:
                if item in form:
                    want[i, item_id] = 0
                continue
            if (e := least_edits(item, form)) <= k:
                want[i, item_id] = e
    assert got == want and (4, 3) in got and (6, 1) in got and (3, 54) in got and items_repeat
    kept = {x["doc_id"] for x in decontaminate.drop_leaks(docs(rows), bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in want}
    assert decontaminate.drop_leaks(docs(rows), bench).columns == docs([]).columns
    assert decontaminate.find_leaks(docs([]), bench).count() == 0 and decontaminate.find_leaks(docs(rows), bench.where("false")).count() == 0
    assert decontaminate.drop_leaks(docs(rows), bench.where("false")).count() == len(rows)


def test_many_items_meet_by_value(spark, docs):
    """Items over the limit are not sent; the same rows come out, items without id and repeated rows among them."""
    r = random.Random(9)
    items = [(i, prose(r, r.choice([2, 8, 25]))) for i in range(40)] + [(None, prose(r, 12)), (3, "again and again and again"), (3, "again and again and again"), (60, None), (61, "")]
    rows = [(1, None), (2, ""), (3, "again and " * 300), (4, prose(r, 150)), (5, "x " + items[40][1] + " y"), (5, "x " + items[40][1] + " y"), (None, max((x[1] for x in items[:40]), key=len))]
    for i in range(60):
        item = items[r.randrange(40)][1]
        rows.append((10 + i, prose(r, 30) + " " + edited(r, item, r.randrange(0, len(item) // 8 + 1)) + " " + prose(r, 30)))
    rows.append((90, prose(r, 200_000) + " " + max((x for x in items[:40]), key=lambda x: len(x[1]))[1] + " " + prose(r, 9000)))
    bench = spark.createDataFrame(items, "item_id int, text string")
    sent, met = (sorted(decontaminate.find_leaks(docs(rows), bench, most=most).collect(), key=str) for most in (1 << 20, 100))
    assert sent == met and len(sent) > 30 and {g["item_id"] for g in sent} >= {None, 3} and {g["doc_id"] for g in sent} >= {None, 5, 90}
    assert sum(g["doc_id"] == 5 and g["item_id"] is None for g in sent) == 2 and sum(g["doc_id"] == 3 and g["item_id"] == 3 for g in sent) == 2
    kept = [sorted((str(x["doc_id"]), x["text"] or "") for x in decontaminate.drop_leaks(docs(rows), bench, most=most).collect()) for most in (1 << 20, 100)]
    assert kept[0] == kept[1] and len(kept[0]) == len(rows) - len({g["doc_id"] for g in sent}) - 1
    assert decontaminate.find_leaks(docs([]), bench, most=100).count() == 0 and decontaminate.find_leaks(docs(rows), bench.where("false"), most=-1).count() == 0


TEXTS = ["", " ", "  two  spaces ", "a\n\nb ", "日本語 é \t ﬁ 😀", "x" * 100 + " " + "ab" * 60, "tab\tx\r\n", " \n \n", "marker ▁ inside▁", "Hello world, hello World!"]


def test_encoding_equals_the_library_without_dropout():
    p = pieces.load(pieces.MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [t for t in TEXTS if "▁" not in t] + [prose(random.Random(i), 60) for i in range(20)]
    ids, offsets = pieces.encode_texts(p, texts, [0] * len(texts), rate=0.0)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == sp.encode(t), t


def test_dropout_is_keyed_lossless_and_varied():
    p = pieces.load(pieces.MODEL)
    texts = TEXTS + [prose(random.Random(i), 60) for i in range(20)]
    for rate in (0.0, 0.1, 0.6, 1.0):
        ids, offsets = pieces.encode_texts(p, texts, list(range(len(texts))), rate=rate)
        for i, t in enumerate(texts):
            assert pieces.decode_ids(p, ids[offsets[i] : offsets[i + 1]].tolist()) == t
        again, _ = pieces.encode_texts(p, texts, list(range(len(texts))), rate=rate)
        assert (again == ids).all()
        assert rate < 1 or len(ids) >= sum(len(t) for t in texts)
    one, two = (pieces.encode_texts(p, texts, [0] * len(texts), seed=s, rate=0.3)[0] for s in (1, 2))
    assert len(one) != len(two) or (one != two).any()
    ids, _ = pieces.encode_texts(p, ["wonderful " * 50], [1], rate=0.3)
    plain, _ = pieces.encode_texts(p, ["wonderful " * 50], [1], rate=0.0)
    assert len(ids) > len(plain) and len(set(ids.tolist())) > len(set(plain.tolist()))


def test_words_are_worked_out_once_for_many_spans(monkeypatch):
    """Spans share what they know of words; forgetting changes nothing."""
    r = random.Random(9)
    texts = [prose(r, 3000) for _ in range(6)] + ["x" * 300, "", None]
    own, calls, work = pieces.Pieces(pieces.MODEL), [], pieces._encode_words
    monkeypatch.setattr(pieces, "_encode_words", lambda p, words, variant, seed, rate, *a: (calls.extend(words if not rate else []), work(p, words, variant, seed, rate, *a))[1])
    want = [pieces.encode_texts(own, [t], [i])[0].tolist() for i, t in enumerate(texts)]
    assert len(calls) == len(set(calls))
    monkeypatch.setattr(pieces, "REMEMBERED", 0)
    assert [pieces.encode_texts(own, [t], [i])[0].tolist() for i, t in enumerate(texts)] == want
    assert len(calls) > 2 * len(set(calls))


def test_a_merge_looks_up_its_two_neighbours_only(monkeypatch):
    """What a merge makes is known from its rank; only the pairs to its left and right are looked up."""
    p, seen, work = pieces.load(pieces.MODEL), [], pieces.Pieces.merged
    words = sorted(set(p.words.findall(" " + prose(random.Random(4), 400))))
    monkeypatch.setattr(pieces.Pieces, "merged", lambda self, left, right: (seen.append(len(left)), work(self, left, right))[1])
    ids, _ = pieces._encode_words(p, words, np.zeros(len(words), np.uint64), 0, 0.0)
    places = sum(map(len, words))
    assert 0 < sum(seen) <= places - len(words) + 2 * (places - len(ids))


def test_texts_of_a_batch_are_decoded_together():
    p = pieces.load(pieces.MODEL)
    texts = [*TEXTS, prose(random.Random(5), 50)]
    ids, offsets = pieces.encode_texts(p, texts, list(range(len(texts))), rate=0.3)
    assert [bytes(x).decode() for x in pieces.decode_lists(p, ids, offsets)] == texts
    changed = np.where(np.arange(len(ids)) == offsets[-2] + 3, p.byte[0xFF], ids)  # no UTF-8 any more
    assert [bytes(x) == t.encode() for x, t in zip(pieces.decode_lists(p, changed, offsets), texts, strict=True)] == [True] * (len(texts) - 1) + [False]
    assert pieces.decode_lists(p, ids[:0], offsets[:1] * 0) == [] and [bytes(x) for x in pieces.decode_lists(p, ids[:0], offsets[:4] * 0)] == [b""] * 3


def test_agenda_and_arrays_agree():
    p = pieces.load(pieces.MODEL)
    words = sorted({w for t in TEXTS + [prose(random.Random(3), 300)] for w in p.words.findall(" " + t)})
    for rate in (0.0, 0.2, 0.7):
        variant = np.arange(len(words)) % 3
        ids, offsets = pieces._encode_words(p, words, variant, 5, rate)
        for i, w in enumerate(words):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == pieces.encode_word(p, w, int(variant[i]), 5, rate), (w, rate)


def test_encode_frames(docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, None), (None, "no id"), (1, " ")]
    got = pieces.decode(pieces.encode(docs(rows), keep_text=True, check=True)).collect()
    assert len(got) == len(rows)
    for g in got:
        assert g["decoded"] == g["text"] and g["lossless"] == (None if g["text"] is None else True) and (g["pieces"] is None) == (g["text"] is None)
    assert pieces.encode(docs([])).count() == 0


def test_recounts_equal_full_counts(spark, docs):
    r = random.Random(1)
    counter = token_counts.load(token_counts.RANKS)
    alphabet = list("ab  \n\n\t'sé1!.")
    for n in range(300):
        text = "".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 30, 900])))
        edits = []
        for _ in range(r.choice([1, 2, 6])):
            start = r.randrange(len(text) + 1)
            edits.append((start, start + r.choice([0, 1, 5, 40]), "".join(r.choice(alphabet) for _ in range(r.randrange(6)))))
        edits = token_counts.clean_edits(edits, len(text))
        tree = counter.tree(text)
        assert tree.tokens == len(counter.encoding.encode_ordinary(text))
        after, _ = token_counts.apply_edits(counter, tree, text, edits)
        want = text
        for start, stop, new in reversed(edits):
            want = want[:start] + new + want[stop:]
        one = counter.tree(text)
        for start, stop, new in reversed(edits):  # one by one, from the back
            token_counts.apply_edits(counter, one, text, [(start, stop, new)])
            text = text[:start] + new + text[stop:]
        assert text == after and one.tokens == tree.tokens and one.sums[1].tolist() == tree.sums[1].tolist()
        for t in (one, tree):
            assert [int(x) for x in t.sums[t.size : t.size + len(t.sizes), 0]] == t.sizes.tolist() and t.sizes.sum() == len(t.lengths)
            assert [int(t.lengths[a:b].sum()) for a, b in zip(t.starts, t.starts[1:], strict=False)] == t.sums[t.size : t.size + len(t.sizes), 1].tolist()
            assert (t.sums[1 : t.size] == t.sums[2 : 2 * t.size : 2] + t.sums[3 : 2 * t.size : 2]).all()
        full = counter.tree(after)
        assert after == want and tree.tokens == len(counter.encoding.encode_ordinary(want))
        assert [x.tolist() for x in tree.flat()] == [x.tolist() for x in full.flat()]
    long = prose(r, 4000)
    tree = counter.tree(long)
    _, anew = token_counts.apply_edits(counter, tree, long, [(9000, 9003, "xyz")])
    assert anew < 10
    rows = [(1, "id 12345 ***"), (2, None), (3, ""), (1, "id 12345 ***")]
    edits = token_counts.masking_edits(docs(rows), head="# T\n")
    assert edits.columns == [*docs([]).columns, "edits"]
    built = token_counts.update(token_counts.build(edits)).drop("lang")
    got = {g["doc_id"]: g for g in built.collect()}
    assert got[1]["text"] == "# T\nid 0 0" and got[1]["n_edits"] == 3 and got[1]["n_tokens_after"] == len(counter.encoding.encode_ordinary("# T\nid 0 0"))
    assert (got[2]["n_tokens"], got[2]["n_edits"], got[3]["n_tokens_after"]) == (0, 0, len(counter.encoding.encode_ordinary("# T\n"))) and got[2]["text"] is None
    assert token_counts.recount(edits).count() == 4 and token_counts.recount(token_counts.masking_edits(docs([]))).count() == 0
    assert token_counts.clean_edits([(0, 2, "a"), (1, 3, "b"), (5, 99, None), (None, 1, "x")], 6) == [(0, 2, "a"), (5, 6, "")]


def test_recounts_build_and_update_in_one_worker(spark, docs):
    """As build and update give them, but by one Python function: no second worker, no trees between two."""
    r = random.Random(6)
    edits = token_counts.masking_edits(docs([(i, prose(r, 2000) + f" id {i}12345 ***") for i in range(40)] + [(90, None), (91, "")]), head="# T\n").localCheckpoint()
    got = token_counts.recount(edits)
    apart = token_counts.update(token_counts.build(edits), keep=False).select(*got.columns)
    assert got.collect() and sorted(got.collect()) == sorted(apart.collect())
    plans = [df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") for df in (got, apart)]
    assert plans[0] * 2 == plans[1]


def test_trees_are_kept_and_untouched_text_is_never_encoded(spark, docs, tmp_path):
    """Trees outlive the run that built them; an update cuts, counts and encodes only what lies at its edits."""
    r = random.Random(4)
    texts = {i: prose(r, 30_000) if i == 2 else prose(r, 3000) for i in range(4)} | {4: "", 5: "x" * 300_000}
    token_counts.build(docs(list(texts.items()))).write.parquet(f"{tmp_path}/trees")
    edits = {i: [(max(0, len(t) // 2 - 5), len(t) // 2, "new words 12")] for i, t in texts.items()}
    for _ in range(2):  # update what an update gave
        kept = spark.read.parquet(f"{tmp_path}/trees").collect()
        counter = token_counts.Counter(token_counts.RANKS)
        seen: list[str] = []
        encode = counter.encoding.encode_ordinary
        counter.learn = lambda lists, learn=counter.learn, seen=seen: (seen.extend(x for f in lists for x in f), learn(lists))  # noqa: B023
        for row in kept:
            before = len(seen)
            tree = token_counts.Tree.load(*row["tree"])
            after, anew = token_counts.apply_edits(counter, tree, row["text"], edits[row["doc_id"]])
            touched = sum(map(len, seen[before:]))
            assert tree.tokens == len(encode(after)) and tree.sums[1].tolist() == [len(tree.lengths), len(after), int(tree.counts.sum())]
            assert anew < 12 and (row["doc_id"] == 5 or touched < 120), (row["doc_id"], anew, touched)
        rows = [(g["doc_id"], g["text"], g["tree"], [dict(zip(("start", "stop", "text"), e, strict=True)) for e in edits[g["doc_id"]]]) for g in kept]
        df = spark.createDataFrame(rows, "doc_id bigint, text string, tree " + token_counts.TREE + ", edits array<struct<start: bigint, stop: bigint, text: string>>")
        token_counts.update(df).drop("edits").write.mode("overwrite").parquet(f"{tmp_path}/next")
        for g in spark.read.parquet(f"{tmp_path}/next").collect():
            assert g["n_tokens_after"] == len(encode(g["text"]))
        spark.read.parquet(f"{tmp_path}/next").select("doc_id", "text", "tree").write.mode("overwrite").parquet(f"{tmp_path}/trees")


KEY = b"test key"


@pytest.mark.parametrize("size", [2, 10, 73049, 10**7, 2**32])
def test_permutation(size):
    r = random.Random(size)
    xs = range(size) if size <= 10 else [r.randrange(size) for _ in range(50)]
    ys = [pseudonyms.permute(x, size, KEY, "t") for x in xs]
    assert all(0 <= y < size for y in ys) and [pseudonyms.permute(y, size, KEY, "t", inverse=True) for y in ys] == list(xs)
    assert size > 10 or sorted(ys) == list(range(size))


def test_pseudonyms(docs):
    text = 'mail a.b-12@x.example.com, 4111 1111 1111 1111 and 4111-1111-1111-1111; +1 (017) 555-7713 or call 555-0123; 10.0.0.255 on 2024-02-29, 12/31/1999, 31.12.1999; 123-45-6789; DE89 3704 0044 0532 0130 00; token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end'
    new, kinds = pseudonyms.pseudonymise(text, KEY)
    assert sorted(set(kinds)) == ["card", "day", "iban", "ipv4", "mail", "phone", "secret", "ssn"] and len(kinds) == 12
    assert pseudonyms.pseudonymise(new, KEY, inverse=True)[0] == text and pseudonyms.pseudonymise(text, KEY)[0] == new and pseudonyms.pseudonymise(text, b"other")[0] != new
    assert "".join("9" if c.isdigit() else c for c in new[27:47]) == "9999 9999 9999 9999 " and new[5:25].endswith(".com") and "example" not in new
    cards = [new[27:46], new[51:70]]
    assert cards[0].replace(" ", "") == cards[1].replace("-", "") and pseudonyms.luhn(cards[0].replace(" ", "")[:-1]) == int(cards[0][-1])
    for clean in ("4111 1111 1111 1112", "9656005089711094", "999.1.1.1", "2023-02-29", "000-12-3456", "version 1.2", "plain text", "a @ b", "0000 0000 0000 0000", 'say = "words without any number"', "item 123-4567", "part 123-456-7890", "see https://example.com/a1b2c3d4e5f6a7b8c9d0e1f2", "time: 12345678901234567890 x", "ask-me-anything-about-the-year-2001"):
        assert pseudonyms.pseudonymise(clean, KEY) == (clean, [])
    rows = [(1, text), (2, None), (3, ""), (4, "clean"), (1, text), (5, "x" * 500_000 + " 4111111111111111")]
    got = pseudonyms.private(docs(rows), KEY).collect()
    assert sorted((g["doc_id"], g["n_private"]) for g in got) == [(1, 12), (1, 12), (2, 0), (3, 0), (4, 0), (5, 1)]
    assert {g["text"] for g in got if g["doc_id"] == 1} == {new} and {g["doc_id"]: g["text"] for g in got if 1 < g["doc_id"] < 5} == {2: None, 3: "", 4: "clean"}
    assert pseudonyms.private(docs([]), KEY).count() == 0


def naive_private(text):
    """(start, end) of private values in texts of words and values parted by spaces, found one word at a time by plain rules."""

    def luhn_ok(d):
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    out, at, last = [], 0, ""
    for word in text.split(" "):
        parts, digits = word.split("."), word.replace("-", "")
        if word.isdigit() and len(word) == 16 and luhn_ok(word) and (word[0] in "4" or 51 <= int(word[:2]) <= 55 or 2221 <= int(word[:4]) <= 2720 or word[0] == "6" or word[:2] in ("56", "57", "58", "59", "50", "36", "38", "39") or 3000 <= int(word[:4]) <= 3059 or 3528 <= int(word[:4]) <= 3589):
            out.append((at, at + len(word)))
        elif len(parts) == 4 and all(p.isdigit() and int(p) < 256 for p in parts):
            out.append((at, at + len(word)))
        elif [len(p) for p in word.split("-")] == [3, 2, 4] and digits.isdigit():
            if 0 < int(digits[:3]) < 900 and digits[:3] != "666" and digits[3:5] != "00" and digits[5:] != "0000":
                out.append((at, at + len(word)))
        elif [len(p) for p in word.split("-")] in ([3, 3, 4], [3, 4]) and digits.isdigit():
            fits = len(digits) == 10 and digits[0] > "1" and digits[3] > "1" and digits[1:3] != "11" and digits[4:6] != "11"
            if fits or last in ("call", "tel:", "Phone"):
                out.append((at, at + len(word)))
        elif word.count("@") == 1 and "." in word.split("@")[1]:
            out.append((at, at + len(word)))
        elif word.startswith(("AKIA", "sk-", "token=")) and any(c.isdigit() for c in word) and len(word) >= 26:
            out.append((at, at + len(word)))
        at, last = at + len(word) + 1, word
    return out


def test_pseudonyms_against_a_naive_scan():
    r = random.Random(11)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    blob = lambda n, c: "".join(r.choice(c) for _ in range(n))
    makers = [
        lambda: "4" + digits(15),
        lambda: digits(16),
        lambda: ".".join(str(r.randrange(300)) for _ in range(4)),
        lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        lambda: f"{digits(3)}-{digits(3)}-{digits(4)}",
        lambda: f"{digits(3)}-{digits(4)}",
        lambda: r.choice(["call ", "tel: ", "Phone "]) + f"{digits(3)}-{digits(4)}",
        lambda: blob(5, LETTERS) + "." + digits(2) + "@mail" + digits(1) + ".example.org",
        lambda: "AKIA" + blob(22, "ABCDEFGH234567"),
        lambda: "sk-" + blob(24, LETTERS + "0123456789"),
        lambda: "token=" + blob(24, LETTERS + "0123456789"),
        lambda: blob(30, LETTERS),
        lambda: digits(r.randrange(1, 9)),
    ]
    hit = 0
    for _ in range(1500):
        text = " w ".join(r.choice(makers)() for _ in range(8)) + " w"
        new, kinds = pseudonyms.pseudonymise(text, KEY)
        found = naive_private(text)
        assert len(kinds) == len(found), (text, kinds, found)
        old, now = text.split(" "), new.split(" ")
        starts = [sum(len(w) + 1 for w in old[:i]) for i in range(len(old))]
        assert len(old) == len(now) and all((a == b) == (s not in {x for x, _ in found}) or (a == b and s in {x for x, _ in found} and r is None) for a, b, s in zip(old, now, starts, strict=True)), (text, new)
        assert pseudonyms.pseudonymise(new, KEY, inverse=True)[0] == text
        hit += len(found)
    assert hit > 4000


def brute_dice(a, b):
    from collections import Counter

    x, y = Counter(zip(a, a[1:], strict=False)), Counter(zip(b, b[1:], strict=False))
    return 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values()))


def test_licences(docs):
    r = random.Random(2)
    words = lambda t: licences.normal(t).decode().split()
    rows, planted = [(1, None), (2, ""), (3, "of the this license " * 400), (4, prose(r, 500)), (5, "MIT")], {}
    for i, (name, text) in enumerate(licences.TEMPLATES):
        rows.append((100 + i, prose(r, 40) + ".\n" + text.upper() + "\n" + prose(r, 40)))
        planted[100 + i] = (name, text)
    got = licences.licences(docs(rows)).collect()
    by = {}
    for g in got:
        by.setdefault(g["doc_id"], []).append(g)
    assert set(by) == set(planted)
    for i, (name, text) in planted.items():
        best = max(by[i], key=lambda g: g["dice"])
        assert best["dice"] == pytest.approx(1.0), (name, text)
        window = words(dict(rows)[i])[best["first_word"] : best["first_word"] + best["n_words"]]
        assert brute_dice(window, words(text)) == pytest.approx(best["dice"])
    index = licences.Templates(licences.TEMPLATES)
    for _ in range(20):
        name, text = r.choice(licences.TEMPLATES)
        w = words(text)
        w[r.randrange(len(w))] = "changed"
        (_, found), = licences._words([prose(r, 9) + " " + " ".join(w) + " " + prose(r, 9)])
        hits = licences.scan(index, found)
        want = max(brute_dice(w, words(t)) for _, t in licences.TEMPLATES)
        assert (max((h[1] for h in hits), default=0) >= want - 1e-9) or want < licences.THRESHOLD
    assert licences.licences(docs([])).count() == 0
    long = docs([(1, prose(r, 60_000) + " " + licences.TEMPLATES[0][1]), (2, "x" * 1_000_000), (3, None), (3, licences.TEMPLATES[0][1]), (3, licences.TEMPLATES[0][1])])
    assert sorted(g["doc_id"] for g in licences.licences(long).collect()) == [1, 3, 3]


def test_all_windows_and_ties():
    """No window that brute force finds beats what scan gives; of templates of equal Dice the name that sorts first stays."""
    r = random.Random(8)
    words = lambda t: licences.normal(t).decode().split()
    index = licences.Templates(licences.TEMPLATES)
    for _ in range(12):
        name, text = r.choice([x for x in licences.TEMPLATES if len(words(x[1])) < 16])
        w = prose(r, 4).split() + words(text) + prose(r, 4).split()
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = "changed"
        (_, found), = licences._words([" ".join(w)])
        best = max((brute_dice(w[a:b], words(t)) for _, t in licences.TEMPLATES for a in range(len(w)) for b in range(a + 2, len(w) + 1)), default=0)
        hits = licences.scan(index, found)
        assert max((h[1] for h in hits), default=0) == pytest.approx(best if best >= licences.THRESHOLD else 0)
    twins = licences.Templates([("B", "one two three four five"), ("A", "one two three four five"), ("C", "one two three four six")])
    (_, found), = licences._words(["x one two three four five y"])
    assert [h[:2] for h in licences.scan(twins, found)] == [("A", 1.0)]
