"""Language ID by a mixture of languages inside each document.

Every language has a distribution over hashed letter trigrams (lower case, letters only, one space between words),
learned with additive smoothing. A document's language proportions are those that maximise the likelihood of its
trigrams under the mixture, found by expectation-maximisation; a uniform background takes what fits no language.
Languages leave the set one by one, smallest proportion first, while the penalised likelihood (half the logarithm of
the trigram count for each language; trigrams overlap, so the likelihood counts a third) doesn't fall.

Training is on about ``sample`` documents of each language (documented bound, 1,500 by default): a document is taken
if the hash of its id falls under ``sample / n_of_its_language``. Trigram counts are summed by Spark; what reaches
the driver, and each task, is one row of at most ``2**bits`` counts a language, 256 KB. There may be ``most``
languages (512 by default, 128 MB); a column with more values than that isn't one of languages and raises
``ValueError``.

Defined cases: null texts and texts without letters are ``und`` with score 0; one- and two-letter texts are padded
with spaces and judged; whole texts count, however long; ties go to the language first by name; repeated rows are
judged each; with no learned language every row is ``und``; an empty table gives an empty table; extra columns don't
reach the result and may have any name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.llm.common import fold, keep_rows, map_texts, saved, slices

OTHER = re.compile(r"[\W\d_]+")
SAMPLE, BITS, UNKNOWN = 1_500, 15, "und"
WINDOW, MOST = 1 << 20, 512


def trigrams(text: str | None, bits: int = BITS, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of the trigrams; empty if there is no letter.

    The text is normalised as a whole, in strings; only the arrays of numbers are made for ``window`` characters at a
    time, each with the two characters that follow, so the counts don't depend on it.
    """
    words = OTHER.sub(" ", (text or "").lower()).strip()
    if not any(map(str.isalpha, words)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = f" {words} "
    if len(words) <= window + 2:
        return np.unique(_places(words, bits), return_counts=True)
    total = np.zeros(1 << bits, np.int64)
    for start in range(0, len(words) - 2, window):
        total += np.bincount(_places(words[start : start + window + 2], bits), minlength=1 << bits)
    places = np.flatnonzero(total)
    return places, total[places]


def _places(words: str, bits: int) -> np.ndarray:
    points = np.frombuffer(words.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    mixed = (points[:-2] * np.uint64(0x9E3779B1) + points[1:-1]) * np.uint64(0x85EBCA77) + points[2:]
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Languages:
    """names in order of code points; chances: a row for each name and a last one for the background."""

    names: list[str]
    chances: np.ndarray

    def proportions(self, places: np.ndarray, counts: np.ndarray, within: list[int], rounds: int = 40) -> tuple[np.ndarray, float]:
        """Proportions of the chosen rows, and the likelihood's logarithm."""
        given = self.chances[within][:, places]
        share = np.full(len(within), 1 / len(within))
        total = counts.sum()
        for _ in range(rounds):
            joint = share[:, None] * given
            new = (joint / joint.sum(0)) @ counts / total
            moved, share = np.abs(new - share).max(), new
            if moved < 1e-4:
                break
        return share, float(np.log(share @ given) @ counts)

    def judge(self, text: str | None, bits: int = BITS) -> tuple[str, float, dict[str, float]]:
        """Language, score (its proportion) and the proportions of the chosen set."""
        places, counts = trigrams(text, bits)
        if not len(places) or not self.names:
            return UNKNOWN, 0.0, {}
        background = len(self.names)
        chosen = [*range(background), background]
        step = np.log(counts.sum() + 1) / 2
        share, fit = self.proportions(places, counts, chosen)
        while len(chosen) > 2:
            least = int(np.argmin(share[:-1]))
            fewer = chosen[:least] + chosen[least + 1 :]
            next_share, next_fit = self.proportions(places, counts, fewer)
            if (fit - next_fit) / 3 > step:
                break
            chosen, share, fit = fewer, next_share, next_fit
        best = int(np.argmax(share[:-1]))
        names = {self.names[k]: float(p) for k, p in zip(chosen, share) if k != background}
        return self.names[chosen[best]], float(min(1.0, share[best])), names


def learn(docs: DataFrame, sample: int = SAMPLE, bits: int = BITS, held_out: int = 2, most: int = MOST) -> Languages:
    """Languages from (doc_id, text, lang), outside the held-out fold."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", 4) != held_out))
    sizes = saved(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-sizes")  # a known size, so that texts aren't shuffled for the join
    if sizes.count() > most:
        raise ValueError(f"more than {most} languages")
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    taken = known.join(sizes, "lang").where(place * F.col("n") < sample).select("lang", "text")

    def make():
        def kernel(batch: pa.RecordBatch):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                places, counts = trigrams(text.as_py(), bits)
                yield from ((lang, p, c) for p, c in zip(places.tolist(), counts.tolist()))

        return kernel

    counted = map_texts(taken, "lang string, place int, n long", make).groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counted.column("lang").to_pylist()), key=lambda s: s.encode())
    table = np.zeros((len(names), 1 << bits))
    order = {name: k for k, name in enumerate(names)}
    rows = np.array([order[x] for x in counted.column("lang").to_pylist()], np.int64)
    table[rows, counted.column("place").to_numpy()] = counted.column("n").to_numpy()
    table += 0.05
    table /= table.sum(1, keepdims=True)
    return Languages(names, np.vstack([table, np.full((1, 1 << bits), 1 / (1 << bits))]))


def identify(docs: DataFrame, languages: Languages, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score, proportions map) of every row."""
    kind = docs.schema[id_column].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(languages)  # 256 KB a language, which ``learn`` bounds

    def make():
        known = shared.value
        bits = int(np.log2(known.chances.shape[1]))

        def kernel(batch: pa.RecordBatch):
            for part in slices(batch, 1):
                for key, text, held in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist()):
                    name, p, shares = known.judge(text.as_py(), bits)
                    yield key, held, name, p, list(shares.items())

        return kernel

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), (fold(id_column, 4) == 2).alias("held_out"))
    return map_texts(rows, f"`{id_column}` {kind}, held_out boolean, lang_pred string, score double, proportions map<string,double>", make)


def keep_known(docs: DataFrame, languages: Languages, least: float = 0.3, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose main language makes up ``least`` of the text or more, columns untouched."""
    shared = docs.sparkSession.sparkContext.broadcast(languages)

    def make():
        known = shared.value
        bits = int(np.log2(known.chances.shape[1]))

        def passes(text: str | None) -> bool:
            name, share, _ = known.judge(text, bits)
            return name != UNKNOWN and share >= least

        return passes

    return keep_rows(docs, text_column, make)
