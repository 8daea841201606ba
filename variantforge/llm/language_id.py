"""Language identification with error-correcting output codes.

Every language has a codeword of bits; one regularised logistic classifier per bit reads hashed character
n-grams.  A text gets the language whose codeword has the least loss, each bit's logistic loss weighted by
that bit's accuracy in training; a small gap to the next codeword is flagged as ambiguous.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.columns import map_in_arrow, named, with_fields

#: Hashed n-gram features, n-gram sizes, and characters that are counted at once.
DIMS, SIZES, SPAN = 4096, (1, 2, 3), 1 << 18
#: Documents that training reads, about: its documented sample bounds, of one language and of all together
#: (with over TOTAL / PER_LANGUAGE languages each has its share of TOTAL, so the driver's matrix never grows).
PER_LANGUAGE, TOTAL = 1500, 12_000
#: A text is ambiguous if the two nearest codewords' mean losses differ by less than this (a coin's loss is 0.69):
#: texts of no known language lie under it, of held-out documents fewer than 1 in 1000, all of a few words.
AMBIGUOUS = 0.15
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def ngram_vector(text: str | None) -> np.ndarray | None:
    """Square roots of the n-gram shares of the lower-cased text, unit length; None if it has no letter.

    Runs of other characters count as one space.  Whole texts count, SPAN characters at a time.
    """
    if not text:
        return None
    counts, any_letter = np.zeros(DIMS, np.int64), False
    tail = np.zeros(1, np.uint32)
    for i in range(0, len(text), SPAN):
        code = np.frombuffer(text[i : i + SPAN].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letter = _letters()[code]
        any_letter = any_letter or bool(letter.any())
        code = np.concatenate([tail, np.where(letter, code, 0), np.zeros(int(i + SPAN >= len(text)), np.uint32)])
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
        code, before = code[keep], len(tail) - 1
        tail = code[-2:]
        h = np.zeros(len(code), np.uint32)
        for n in range(1, max(SIZES) + 1):
            m = len(code) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint32(0x01000193) + code[n - 1 :] + np.uint32(n)
            if n in SIZES:  # those that end in this span
                at = (h[max(0, before + 2 - n) :] * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12)
                counts += np.bincount(at, minlength=DIMS)
    if not any_letter:
        return None
    v = np.sqrt(counts, dtype=np.float64)
    return (v / math.sqrt(counts.sum())).astype(np.float32)


def codewords(k: int) -> np.ndarray:
    """k codewords of +1 and -1. Up to 7 languages: all distinct two-way splits; beyond, the best of seeded random codes."""
    if k <= 7:
        cols = [c for r in range(1, k) for c in combinations(range(k), r) if 0 in c]
        return np.array([[1 if i in c else -1 for c in cols] for i in range(k)], np.float32).reshape(k, -1)
    bits, best, gap = math.ceil(10 * math.log2(k)), None, -1
    for seed in range(100):
        code = np.random.Generator(np.random.PCG64(seed)).choice(np.array([-1, 1], np.float32), (k, bits))
        apart = (bits - code @ code.T) / 2
        np.fill_diagonal(apart, bits)
        if apart.min() > gap:
            best, gap = code, apart.min()
    return best


@dataclass(frozen=True)
class EcocModel:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, score 0 to 1, ambiguous) of each row of x."""
        k = len(self.languages)
        if k == 1:
            return np.zeros(len(x), int), np.ones(len(x)), np.zeros(len(x), bool)
        margin = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]) @ self.trust
        order = np.sort(loss, axis=1)
        share = np.exp(-(loss - order[:, :1]) * self.code.shape[1])
        return loss.argmin(axis=1), 1 / share.sum(axis=1), order[:, 1] - order[:, 0] < AMBIGUOUS


def fit_bits(x: np.ndarray, y: np.ndarray, languages: tuple[str, ...], steps: int = 150, penalty: float = 1e-5) -> EcocModel:
    """Logistic classifiers for all bits at once, by accelerated gradient descent; languages weigh the same."""
    code = codewords(len(languages))
    bits = code.shape[1]
    w, b = np.zeros((x.shape[1], bits), np.float32), np.zeros(bits, np.float32)
    trust = np.full(bits, 1 / max(1, bits))
    if bits:
        target = code[y]
        weight = (1 / np.bincount(y, minlength=len(languages))[y]).astype(np.float32)
        weight = (weight / weight.sum())[:, None]
        vw, vb, rate = w.copy(), b.copy(), np.float32(12.0)
        for t in range(steps):
            g = -target / (1 + np.exp(np.clip(target * (x @ vw + vb), -30, 30))) * weight
            nw, nb = vw - rate * (x.T @ g + np.float32(penalty) * vw), vb - rate * 0.3 * g.sum(axis=0)
            m = np.float32(t / (t + 3))
            vw, vb, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
        right = ((x @ w + b) * target > 0).mean(axis=0)
        trust = np.maximum(right - 0.5, 0.01)
        trust = trust / trust.sum()
    return EcocModel(languages, code, w, b, trust)


def train(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, total: int = TOTAL) -> EcocModel | None:
    """A model from rows with text and lang for which the Column held_out is not true; None without any.

    About per_language rows of each language are read, chosen by a hash of id and text; rows alike in id, text
    and language count as one there.  Null ids are hashed as such.
    """
    labelled = docs.where(named(lang_col).isNotNull() & named(text_col).isNotNull() & ~F.coalesce(held_out, F.lit(False)))
    rows_of = {r[0]: r[1] for r in labelled.groupBy(named(lang_col)).count().collect()}
    if not rows_of:
        return None
    most = min(per_language, max(1, total // len(rows_of)))
    top = (1 << 63) - 1
    limits = F.create_map(*[F.lit(v) for name in sorted(rows_of) for v in (name, min(top, most * (1 << 63) // rows_of[name]))])
    hashed = labelled.select(named(text_col).alias("text"), named(lang_col).alias("lang"), F.xxhash64(named(id_col), named(text_col), F.lit("sample")).bitwiseAND(F.lit(top)).alias("h"))
    chosen = hashed.where(F.col("h") <= limits[F.col("lang")]).dropDuplicates(["h", "lang"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(lang, v.astype(np.float16).tobytes()) for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (v := ngram_vector(text)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["lang", "v"])

    rows = chosen.select("text", "lang").mapInArrow(vectors, "lang string, v binary").toArrow()
    if not rows.num_rows:
        return None
    langs = rows.column("lang").to_pylist()
    order = sorted(range(len(langs)), key=lambda i: (langs[i], rows.column("v")[i].as_py()))  # the same sums whatever order tasks end in
    x = np.stack([np.frombuffer(rows.column("v")[i].as_py(), np.float16) for i in order]).astype(np.float32)
    names = tuple(sorted(set(langs)))
    return fit_bits(x, np.array([names.index(langs[i]) for i in order]), names)


def identify(docs: DataFrame, model: EcocModel | None, text_col: str = "text", batch: int = 256) -> DataFrame:
    """docs with lang_pred, score and ambiguous in place of any columns so named.

    A text that is null or has no letter gets `und`, score 0, ambiguous; so does every text without a model.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    plain = docs.select(*[named(c) for c in keep])
    at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                found = [ngram_vector(t) if model else None for t in part.column(at).to_pylist()]
                lang, score, unsure = ["und"] * len(found), [0.0] * len(found), [True] * len(found)
                if have := [j for j, v in enumerate(found) if v is not None]:
                    best, s, a = model.predict(np.stack([found[j] for j in have]))
                    for j, k, p, q in zip(have, best, s, a, strict=True):
                        lang[j], score[j], unsure[j] = model.languages[k], float(p), bool(q)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang), pa.array(score), pa.array(unsure)], names=[*part.schema.names, "lang_pred", "score", "ambiguous"])

    return map_in_arrow(plain, run, with_fields(plain.schema, "lang_pred string, score double, ambiguous boolean"))
