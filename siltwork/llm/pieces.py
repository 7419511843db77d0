"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps a score-ordered agenda of adjacent symbol pairs: the best-scored pair (leftmost on ties) is merged
until no adjacent pair is in the vocabulary. Two facts make it fast without changing any id:

* No piece has a space mark after another character, so no merge crosses the start of a run of space marks, and
  characters that occur in no longer piece (line feeds, for one) are merged with nothing. A text therefore falls
  into segments whose agendas don't interact. Both facts are read from the vocabulary at load time.
* Equal segments have equal ids, so each task keeps a bounded cache of segments.

Every segment that enters the cache is checked, once per Arrow batch, against the sentencepiece library; a
difference raises ``ValueError``.

Defined cases: a null text is the empty text (begin and end ids only); empty texts, very long texts and texts
without spaces are encoded whole; repeated rows give repeated results; an empty table gives an empty table; extra
columns are ignored by the query and may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.llm.common import TwoGenerationCache, map_texts, slices

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            value = data[at : at + size]
            at += size
        yield key >> 3, value


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    options: dict[str, int]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        out = cls([], [], [], {"model_type": 1, "byte_fallback": 0, "dummy_prefix": 1, "remove_extra": 1, "escape": 1, "charsmap": 0})
        with open(path, "rb") as file:
            model = file.read()
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                out.pieces.append(piece[1].decode())
                out.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                out.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                spec = dict(_fields(value))
                out.options |= {"model_type": spec.get(3, 1), "byte_fallback": spec.get(35, 0)}
            elif number == 3:
                spec = dict(_fields(value))
                out.options |= {"charsmap": len(spec.get(2, b"")), "dummy_prefix": spec.get(3, 1), "remove_extra": spec.get(4, 1), "escape": spec.get(5, 1)}
        return out


class AgendaEncoder:
    """Encoder for one model file; raises ``ValueError`` for models whose rules it doesn't follow."""

    def __init__(self, path: str, cache: int = 300_000, longest_cached: int = 48):
        import sentencepiece

        v = Vocabulary.read(path)
        if v.options["model_type"] != 2 or v.options["charsmap"] or v.options["remove_extra"] or not v.options["escape"] or not v.options["byte_fallback"] or not v.options["dummy_prefix"]:
            raise ValueError(f"not a merge-type model with identity normalisation and byte fallback: {v.options}")
        if {USER_DEFINED, UNUSED} & set(v.kinds):
            raise ValueError("user-defined and unused pieces aren't supported")
        self.rank = {p: -s for p, s, k in zip(v.pieces, v.scores, v.kinds) if k == NORMAL}
        self.id = {p: i for i, (p, k) in enumerate(zip(v.pieces, v.kinds)) if k == NORMAL}
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(v.pieces, v.kinds)) if k == BYTE}
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece has a space mark after another character")
        merging = set("".join(p for p in self.id if len(p) > 1))
        self.alone = "".join(c for c in "\n\r\t\0" if c not in merging)
        part = re.escape(self.alone)
        pattern = re.compile(f"{SPACE}+[^{SPACE}{part}]*|[^{SPACE}{part}]+" + (f"|[{part}]" if part else ""))
        self.segments, self.finder = pattern.findall, pattern.finditer
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.cache, self.longest = TwoGenerationCache(cache), longest_cached
        self.unchecked: list[tuple[str, bytes]] = []
        self.vectors = True
        self._tables()

    def merge(self, segment: str) -> list[int]:
        """The agenda itself, for one segment."""
        symbols, rank = list(segment), self.rank
        last = len(symbols) - 1
        after, before = list(range(1, last + 2)), list(range(-1, last))
        agenda = []
        for i in range(last):
            pair = symbols[i] + symbols[i + 1]
            if pair in rank:
                agenda.append((rank[pair], i, i + 1, pair))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, pair = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if not a or not b or after[left] != right or len(a) + len(b) != len(pair):
                continue
            symbols[left], symbols[right] = pair, ""
            follows = after[left] = after[right]
            if follows <= last:
                before[follows] = left
                wider = pair + symbols[follows]
                if wider in rank:
                    heapq.heappush(agenda, (rank[wider], left, follows, wider))
            precedes = before[left]
            if precedes >= 0:
                wider = symbols[precedes] + pair
                if wider in rank:
                    heapq.heappush(agenda, (rank[wider], precedes, left, wider))
        ids = []
        for s in symbols:
            if s:
                i = self.id.get(s)
                if i is None:
                    ids += [self.byte[b] for b in s.encode()]
                else:
                    ids.append(i)
        return ids

    def merge_many(self, segments: list[str]) -> list[bytes]:
        """Ids of many short segments: their agendas advance together, one best pair of every segment a step.

        Rows are segments, columns symbol places. ``cost`` is the agenda: the rank of the pair that starts at a
        place, or infinity. The first smallest cost of a row is what the heap of ``merge`` would pop.
        """
        width = max(map(len, segments))
        points = np.array(segments, f"<U{width}").view("<u4").reshape(len(segments), width)
        symbols = self.symbol_of_point[np.minimum(points, len(self.symbol_of_point) - 1)]
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        places = np.arange(width)
        live = places < sizes[:, None]
        symbols = np.where(live, symbols, -1)
        odd = ((symbols < 0) & live).any(1)
        after = np.broadcast_to(places + 1, symbols.shape).copy()
        before = np.broadcast_to(places - 1, symbols.shape).copy()
        cost = np.full(symbols.shape, np.inf)
        if width > 1:
            cost[:, :-1] = self._pair(symbols[:, :-1], symbols[:, 1:])[0]
        rows = np.arange(len(segments))[~odd]
        while len(rows):
            left = cost[rows].argmin(1)
            going = np.isfinite(cost[rows, left])
            rows, left = rows[going], left[going]
            if not len(rows):
                break
            right = after[rows, left]
            merged = self._pair(symbols[rows, left], symbols[rows, right])[1]
            follows, precedes = after[rows, right], before[rows, left]
            symbols[rows, left], symbols[rows, right] = merged, -1
            live[rows, right] = False
            cost[rows, right] = np.inf
            after[rows, left] = follows
            more = follows < sizes[rows]
            cost[rows, left] = np.inf
            r, f, m = rows[more], follows[more], merged[more]
            before[r, f] = left[more]
            cost[r, left[more]] = self._pair(m, symbols[r, f])[0]
            more = precedes >= 0
            r, p = rows[more], precedes[more]
            cost[r, p] = self._pair(symbols[r, p], merged[more])[0]
        found = self.id_of_symbol[symbols[live]].astype("<u4").tobytes()
        ends = (np.cumsum(live.sum(1)) * 4).tolist()
        out, start = [], 0
        for k, end in enumerate(ends):
            out.append(found[start:end])
            start = end
        for k in np.flatnonzero(odd).tolist():  # characters outside the vocabulary become bytes
            out[k] = array("I", self.merge(segments[k])).tobytes()
        return out

    def _tables(self) -> None:
        """Symbols numbered by first use, ids by symbol, and rank and result of every pair that can merge."""
        number: dict[str, int] = {}
        ids: list[int] = []
        for piece, i in self.id.items():
            number[piece] = len(ids)
            ids.append(i)
        pairs = {}
        for piece, rank in self.rank.items():
            for cut in range(1, len(piece)):
                a, b = number.get(piece[:cut]), number.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = (rank, number[piece])
                elif a is None and cut == 1 or b is None and cut == len(piece) - 1:
                    self.vectors = False  # a piece is made of characters that aren't pieces: heap only
        self.keys = np.array(sorted(pairs), np.int64)
        self.costs = np.array([pairs[k][0] for k in self.keys.tolist()] + [np.inf])
        self.results = np.array([pairs[k][1] for k in self.keys.tolist()] + [-1], np.int64)
        self.id_of_symbol = np.array(ids, np.int64)
        singles = {ord(p): n for p, n in number.items() if len(p) == 1}
        self.symbol_of_point = np.full(max(singles) + 2, -1, np.int64)
        for point, n in singles.items():
            self.symbol_of_point[point] = n

    def _pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of pairs; infinity and -1 for pairs that don't merge."""
        keys = a << 32 | b
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        at = np.where((self.keys[at] == keys) & (a >= 0) & (b >= 0), at, len(self.keys))
        return self.costs[at], self.results[at]

    def _learn(self, missing: dict[str, bytes]) -> None:
        """Fill in the ids of new segments and remember them for the check."""
        short = [s for s in missing if len(s) <= self.longest] if self.vectors else []
        for width in (8, 16, self.longest):  # like lengths together, so that rows are full
            group = [s for s in short if len(s) <= width]
            short = [s for s in short if len(s) > width]
            for start in range(0, len(group), 8192):
                part = group[start : start + 8192]
                missing.update(zip(part, self.merge_many(part)))
        for s, ids in missing.items():
            if not ids:
                missing[s] = array("I", self.merge(s)).tobytes()
        self.unchecked += missing.items()

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids with begin and end of each text as little-endian unsigned 32-bit integers."""
        begin, end = struct.pack("<I", self.begin), struct.pack("<I", self.end)
        parts: list[list[bytes]] = [[begin] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        count = 0
        for k, text in enumerate(texts):
            if text:
                for run in self._runs(SPACE + text.replace(" ", SPACE)):
                    held.append((k, run))
                    count += len(run)
                    if count > 200_000:
                        self._place(held, parts)
                        held, count = [], 0
        self._place(held, parts)
        return [b"".join(p) + end for p in parts]

    def _runs(self, text: str):
        """Segments of a text, in lists of bounded length."""
        if len(text) <= 1_000_000:
            yield self.segments(text)
            return
        run: list[str] = []
        for m in self.finder(text):
            run.append(m[0])
            if len(run) == 200_000:
                yield run
                run = []
        yield run

    def _place(self, held: list[tuple[int, list[str]]], parts: list[list[bytes]]) -> None:
        young, old = self.cache.young, self.cache.old
        new = set().union(*(run for _, run in held)).difference(young)
        missing = {}
        for s in new:
            ids = old.get(s)
            if ids is None:
                missing[s] = b""
            else:
                young[s] = ids
        self._learn(missing)
        young |= missing
        ids_of = young.__getitem__
        for k, run in held:
            parts[k].append(b"".join(map(ids_of, run)))
        for s in missing:
            if len(s) > self.longest:
                del young[s]
        self.cache.turn()

    def encode_bytes(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def check(self) -> None:
        """Hold the segments merged since the last call against the library, in one text with line feeds between."""
        for start in range(0, len(self.unchecked), 20_000):
            part = self.unchecked[start : start + 20_000]
            mark = struct.pack("<I", self.id[SPACE])
            feed = b"".join(struct.pack("<I", i) for i in self.merge("\n"))
            ours = mark + b"".join(feed + ids for _, ids in part)
            theirs = array("I", self.library.encode("\n" + "\n".join(s for s, _ in part))).tobytes()
            if ours != theirs:
                raise ValueError("agenda and library differ")
        self.unchecked.clear()

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


def encode(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, ids array<int>) of every text; ``keep_ids=False`` leaves ids out."""

    def make():
        encoder = AgendaEncoder(model)

        def kernel(batch: pa.RecordBatch):
            for part in slices(batch, 1):
                encoded = encoder.encode_many(part.column(1).to_pylist())
                encoder.check()
                for key, ids in zip(part.column(0).to_pylist(), encoded):
                    decoded = encoder.decode(ids).encode()
                    row = (key, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest())
                    yield row + (np.frombuffer(ids, "<u4").astype(np.int32),) if keep_ids else row

        return kernel

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    schema = f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    return map_texts(rows, schema, make)
