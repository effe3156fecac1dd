"""Applying a fitted language model to texts.

Python workers that predict import this module and not Spark ML, which keeps
them small.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

DIM = 4096                # hashed features
UND = "und"
#: Texts turned into Python strings at a time.
AT_A_TIME = 64


@functools.cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _letters(text: str) -> np.ndarray:
    """Code points of the folded text, each run of other characters one blank,
    a blank at both ends."""
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(_is_letter()[c], c, np.uint32(32))
    gap = c == 32
    return c[~(gap & np.roll(gap, 1)) | (np.arange(len(c)) == 0)]


def features(c: np.ndarray) -> np.ndarray:
    """Unit vector of the hashed bigrams and trigrams of the letters ``c``."""
    c = c * np.uint32(0x9E3779B1)
    two = (c[:-1] ^ (c[1:] >> np.uint32(7))) * np.uint32(0x85EBCA6B) + c[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE35) + c[2:]
    bits = np.uint32(32 - int(math.log2(DIM)))
    n = np.zeros(DIM)
    for h in (two, three):
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x27D4EB2F)
        n += np.bincount((h >> bits).astype(np.int64), minlength=DIM)
    n = np.sqrt(n)
    return n / max(1e-12, float(np.linalg.norm(n)))


@dataclass
class Model:
    """Fitted coefficients. ``families`` in the order of ``family_coef``;
    ``pairs``: (language, language, coefficients, intercept), positive margins
    for the first."""
    families: list[str]
    members: dict[str, list[str]]
    family_coef: np.ndarray = field(default_factory=lambda: np.zeros((0, DIM)))
    family_bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    pairs: list[tuple[str, str, np.ndarray, float]] = field(default_factory=list)
    alphabet: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the score is the family's probability, times the
        winner's mean pairwise confidence, times the share of the text's
        letters that the learned languages use."""
        c = _letters(text) if text else np.zeros(0, np.uint32)
        letters = c[c != 32]
        if not len(letters) or not self.families:
            return UND, 0.0
        x = features(c)
        z = self.family_coef @ x + self.family_bias
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        langs = self.members[self.families[best]]
        votes = dict.fromkeys(langs, 0.0)
        sure = dict.fromkeys(langs, 0.0)
        for a, b, w, bias in self.pairs:
            if a in votes and b in votes:
                margin = float(w @ x) + bias
                votes[a if margin > 0 else b] += 1
                sure[a] += (q := 1 / (1 + math.exp(-max(-30.0, min(30.0, 3 * margin)))))
                sure[b] += 1 - q
        lang = max(langs, key=lambda v: (votes[v], sure[v], v))
        trust = sure[lang] / (len(langs) - 1) if len(langs) > 1 else 1.0
        known = float(np.isin(letters, self.alphabet).mean())
        return lang, min(1.0, max(0.0, float(p[best]) * trust * known))


def predict_all(model: Model, texts: pa.Array) -> pa.Array:
    """Structs (lang, score) of an Arrow column of texts."""
    found = [model.predict(t) for at in range(0, len(texts), AT_A_TIME) for t in texts.slice(at, AT_A_TIME).to_pylist()]
    lang, score = zip(*found) if found else ((), ())
    return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])


def featurize(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, x) of a sample's rows (lang, text)."""
    for batch in batches:
        for at in range(0, batch.num_rows, AT_A_TIME):
            part = batch.slice(at, AT_A_TIME)
            x = np.stack([features(_letters(t)) for t in part.column("text").to_pylist()]).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * DIM), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("lang"), lists], ["lang", "x"])


def count_letters(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, n): code points of a sample's folded texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, AT_A_TIME):
            found = [_letters(t) for t in batch.column("text").slice(at, AT_A_TIME).to_pylist()]
            code, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n)], ["code", "n"])
