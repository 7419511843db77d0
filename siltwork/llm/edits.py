"""Edit-aware token counts: pre-token segment trees, kept per document, that re-encode only what an edit touches.

``build_trees`` encodes texts once and returns a tree column beside each text: the lengths and token counts of its
pre-tokens, the leaves of a segment tree whose inner nodes hold sums. ``apply_edits`` takes such rows and edits and
returns rows of the same kind, ready for the next edits: an edit finds its leaves by descending the length sums,
re-cuts the text from the start of the last leaf that ends two characters before the edit or nearer (the pattern
looks at most two characters past a pre-token's end) and goes on until a new boundary falls on an old one after the
edit. Only the pre-tokens cut anew are encoded; the sums above the changed leaves follow. No other part of a text is
cut or encoded again, and a row without edits passes as it is. Inner sums are rebuilt from the leaves by additions.

Every pre-token is a leaf, however long the text.

Defined cases: a null text is the empty text with no tokens; edits are applied in order, in the coordinates of the
text as it then is; null edits are none; ranges are cut to the text; a null replacement deletes; repeated rows give
repeated results; an empty table gives an empty table; extra columns don't reach the result and may have any name.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.llm.common import TwoGenerationCache, map_texts, saved, slices

MARGIN, BLOCK = 2, 1 << 16
TREE = "tree struct<chars: binary, tokens: binary, n_tokens: bigint>"


class PieceCounter:
    """Token counts of pre-tokens of a byte-level BPE given as tiktoken ranks, with a bounded cache."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        compiled = regex.compile(pattern)
        self.findall, self.finditer = compiled.findall, compiled.finditer
        self.cache = TwoGenerationCache(200_000)

    def counts(self, pieces: list[str]) -> list[int]:
        young, old, out = self.cache.young, self.cache.old, []
        for p in pieces:
            n = young.get(p)
            if n is None:
                n = old.get(p) or len(self.encoding.encode_ordinary(p))
                if len(p) <= 64:
                    young[p] = n
            out.append(n)
        self.cache.turn()
        return out

    def leaves(self, text: str, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and token counts of the pre-tokens; strings are held for ``block`` of them at a time."""
        found, sizes, counts = self.finditer(text), [], []
        while pieces := [m[0] for m in islice(found, block)]:
            sizes.append(np.fromiter(map(len, pieces), np.int64, len(pieces)))
            counts.append(np.array(self.counts(pieces), np.int64))
        return (np.concatenate(sizes), np.concatenate(counts)) if sizes else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def pack(values: np.ndarray) -> bytes:
    """Values in the narrowest of one, two, four or eight bytes that holds them all; the first byte tells which."""
    kind = next(k for k in ("u1", "<u2", "<u4", "<u8") if not len(values) or values.max() < 1 << 8 * np.dtype(k).itemsize)
    return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()


def packed(sizes: np.ndarray, counts: np.ndarray) -> dict:
    """The tree column's value."""
    return {"chars": pack(sizes), "tokens": pack(counts), "n_tokens": int(counts.sum())}


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


class TokenTree:
    """The segment tree of one text. Leaves are slices of the first text, but for those that edits have replaced."""

    def __init__(self, text: str, counter: PieceCounter, stored: tuple[np.ndarray, np.ndarray] | None = None):
        self.counter, self.recounted = counter, 0
        self._grow(text, *(stored or counter.leaves(text)))

    def _grow(self, text: str, sizes: np.ndarray, counts: np.ndarray) -> None:
        self.first, self.pieces = text, len(sizes)
        self.starts = np.append(0, np.cumsum(sizes))
        self.edited: dict[int, list[tuple[str, int]]] = {}  # leaf: its pre-tokens and their counts
        self.width = 1 << max(0, (self.pieces - 1).bit_length())
        level = np.zeros((2, self.width), np.int64)
        level[0, : self.pieces], level[1, : self.pieces] = sizes, counts
        levels = [level]
        while level.shape[1] > 1:
            level = level[:, ::2] + level[:, 1::2]
            levels.append(level)
        #: Node 1 is the top, the children of node k are 2k and 2k + 1; row 0 has characters, row 1 tokens.
        self.sums = np.concatenate([np.zeros((2, 1), np.int64), *levels[::-1]], axis=1)

    def leaf(self, k: int) -> str:
        new = self.edited.get(k)
        return self.first[self.starts[k] : self.starts[k + 1]] if new is None else "".join(p for p, _ in new)

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def __len__(self) -> int:
        return int(self.sums[0, 1])

    def text(self) -> str:
        parts, at = [], 0
        for k in sorted(self.edited):
            parts += [self.first[self.starts[at] : self.starts[k]], self.leaf(k)]
            at = k + 1
        return "".join(parts) + self.first[self.starts[at] :]

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and token counts of the pre-tokens as they are now."""
        sizes, counts, at = [], [], 0
        for k in [*sorted(self.edited), self.pieces]:
            sizes.append(self.sums[0, self.width + at : self.width + k])
            counts.append(self.sums[1, self.width + at : self.width + k])
            if new := self.edited.get(k):
                sizes.append(np.array([len(p) for p, _ in new], np.int64))
                counts.append(np.array([n for _, n in new], np.int64))
            at = k + 1
        return np.concatenate(sizes), np.concatenate(counts)

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at ``place`` (the last one past the end) and the place of its start."""
        node, start, lengths = 1, 0, self.sums[0]
        while node < self.width:
            left = int(lengths[2 * node])
            if place < start + left or not lengths[2 * node + 1]:
                node = 2 * node
            else:
                start += left
                node = 2 * node + 1
        return node - self.width, start

    def _set(self, leaf: int, pieces: list[str], counts: list[int]) -> None:
        self.edited[leaf] = list(zip(pieces, counts))
        node = leaf + self.width
        change = np.array([sum(map(len, pieces)), sum(counts)]) - self.sums[:, node]
        if change.any():
            while node:
                self.sums[:, node] += change
                node //= 2

    def replace(self, start: int, end: int, text: str | None) -> None:
        """Put ``text`` in the place of characters ``start`` to ``end``."""
        text, size = text or "", len(self)
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        if start == end and not text:
            return
        if not size:
            self._grow(text, *self.counter.leaves(text))
            self.recounted += self.pieces
            return
        first, at = self.leaf_at(max(0, start - MARGIN))
        if at and at > start - MARGIN - 1:
            first, at = self.leaf_at(at - 1)
        last, last_at = self.leaf_at(end)
        stop = last_at + len(self.leaf(last))
        old = "".join(map(self.leaf, range(first, last + 1)))
        buffer = old[: start - at] + text + old[end - at :]
        settled = start - at + len(text)  # boundaries from here on can meet old ones
        borders = {len(buffer): last}
        if end == last_at and last > first:
            borders[settled] = last - 1  # the edit ends where the last leaf starts
        pieces: list[str] = []
        done, reach = 0, 4
        while True:
            whole = stop >= size
            meets = None
            for m in self.counter.finditer(buffer, done):
                upto = m.end()
                if not whole and upto + MARGIN > len(buffer):
                    break
                pieces.append(m[0])
                done = upto
                if upto >= settled and upto in borders:
                    meets = borders[upto]
                    break
            if meets is not None or whole:
                break
            for _ in range(reach):  # go on into the leaves that follow
                last += 1
                if last == self.pieces:
                    break
                more = self.leaf(last)
                stop += len(more)
                buffer += more
                borders[len(buffer)] = last
            reach *= 2
        upto = self.pieces - 1 if meets is None else meets
        self.recounted += len(pieces)
        self._set(first, pieces, self.counter.counts(pieces))
        for leaf in range(first + 1, upto + 1):
            self._set(leaf, [], [])


#: A run that could begin an address is tried from its start only, so that a long word costs its length.
EMAIL_OR_NUMBER = re.compile(r"(?P<email>(?<![\w.+-])[\w.+-]++@[\w-]+(?:\.[\w-]+)+)|(?P<number>(?<!\w)\+?\d(?:[\d ().-]{6,18})\d(?!\w))")


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Edits that replace e-mail addresses and long numbers, in coordinates of the text as it is edited."""
    out, moved = [], 0
    for m in EMAIL_OR_NUMBER.finditer(text):
        mark = "<email>" if m["email"] else "<number>"
        out.append((m.start() + moved, m.end() + moved, mark))
        moved += len(mark) - (m.end() - m.start())
    return out


def build_trees(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text, tree) of every row of ``docs``: whole texts encoded once."""

    def make():
        counter = PieceCounter(ranks_path, pattern)

        def kernel(batch: pa.RecordBatch):
            for part in slices(batch, 1):
                for key, text in zip(part.column(0).to_pylist(), part.column(1)):
                    text = text.as_py() or ""
                    yield key, text, packed(*counter.leaves(text))

        return kernel

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return map_texts(rows, f"`{id_column}` {kind}, text string, {TREE}", make)


def apply_edits(
    trees: DataFrame,
    ranks_path: str,
    pattern: str,
    rule: Callable[[str], Iterable[tuple[int, int, str | None]]] | None = redactions,
    edits_column: str | None = None,
    id_column: str = "doc_id",
    keep_trees: bool = True,
) -> DataFrame:
    """(id, n_tokens, n_edits, n_tokens_edited, n_pieces, n_recounted[, text, tree]) of rows of ``build_trees``.

    Edits come from ``edits_column`` (array of struct start, end, replacement) or else from ``rule`` of the text.
    ``n_recounted`` is how many pre-tokens were cut and encoded anew.
    """

    def make():
        counter = PieceCounter(ranks_path, pattern)

        def kernel(batch: pa.RecordBatch):
            for part in slices(batch, 1):
                given = part.column(3) if edits_column else None
                for k, (key, text, stored) in enumerate(zip(*part.columns[:3])):
                    key, text = key.as_py(), text.as_py()
                    if given is not None:
                        edits = [tuple(e.values()) for e in given[k].as_py() or () if e is not None]
                    else:
                        edits = list(rule(text))
                    before = after = stored["n_tokens"].as_py()
                    sizes = stored["chars"].as_py()
                    pieces, recounted = (len(sizes) - 1) // sizes[0], 0
                    if edits:
                        tree = TokenTree(text, counter, (unpack(sizes), unpack(stored["tokens"].as_py())))
                        for start, end, new in edits:
                            if start is not None and end is not None:
                                tree.replace(start, end, new)
                        after, recounted = tree.tokens, tree.recounted
                    row = (key, before, len(edits), after, pieces, recounted)
                    if not keep_trees:
                        yield row
                    elif edits:
                        yield *row, tree.text(), packed(*tree.leaves())
                    else:
                        yield *row, text, stored.as_py()

        return kernel

    kind = trees.schema[id_column].dataType.simpleString()
    columns = [F.col(id_column).alias("id"), "text", "tree"] + ([F.col(edits_column).alias("edits")] if edits_column else [])
    schema = f"`{id_column}` {kind}, n_tokens long, n_edits int, n_tokens_edited long, n_pieces long, n_recounted long"
    return map_texts(trees.select(*columns), schema + (f", text string, {TREE}" if keep_trees else ""), make)


def count_edits(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", keep_trees: bool = False) -> DataFrame:
    """Token counts before and after redaction: trees of all texts as a table in the shared folder, then its edits."""
    trees = saved(build_trees(docs, ranks_path, pattern, id_column, text_column), "edit-trees", "zstd")
    return apply_edits(trees, ranks_path, pattern, id_column=id_column, keep_trees=keep_trees)
