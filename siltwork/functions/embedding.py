"""Embedding in adaptive batches over an injected callable; retry delays; a deterministic stand-in model."""

from __future__ import annotations

import random
import time
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from siltwork.functions.expr import RETRYABLE_EMBED

BATCH, COLD_START_S = 32, 5.0
EmbedFn = Callable[[list[str], str], list[list[float]]]


class EmbedError(Exception):
    """A failed call, with the status that decides about another try."""

    def __init__(self, status: int, message: str = "", cancelled: bool = False):
        super().__init__(message or f"status {status}")
        self.status, self.cancelled = status, cancelled

    @property
    def retryable(self) -> bool:
        return self.status in RETRYABLE_EMBED and not self.cancelled


@dataclass
class Stats:
    batches: int = 0
    retries: int = 0
    final_batch_size: int = 0
    cold_start_batches: int = 0


def retry_delay_ms(attempt: int, jitter: Callable[[], float] = random.random) -> float:
    """Half a second doubled for each attempt up to ten seconds, a fifth of jitter within that cap."""
    delay = min(500.0 * 2 ** min(max(attempt, 1) - 1, 16), 10_000.0)
    return min(delay + jitter() * delay / 5, 10_000.0)


def embed_batches(texts: list[str], embed: EmbedFn, dimension: int | None = None, batch: int = BATCH, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random, clock: Callable[[], float] = time.monotonic) -> tuple[list[list[float]], Stats]:
    """Vectors of the texts in order. A retryable failure halves the batch, a success doubles it up to the first size;
    at size one a failure is final, as is one that isn't retryable."""
    size, first, at, failures = max(1, batch), max(1, batch), 0, 0
    out: list[list[float]] = []
    stats = Stats(final_batch_size=size)
    while at < len(texts):
        part = texts[at : at + size]
        began = clock()
        try:
            vectors = embed(part, "search_document")
        except EmbedError as e:
            if not e.retryable or size == 1:
                raise
            failures += 1
            stats.retries += 1
            size = max(1, size // 2)
            sleep(retry_delay_ms(failures, jitter) / 1000)
            continue
        if len(vectors) != len(part):
            raise EmbedError(502, f"{len(vectors)} vectors for {len(part)} texts")
        if dimension is not None and any(len(v) != dimension for v in vectors):
            raise EmbedError(502, f"a vector has not {dimension} components")
        stats.batches += 1
        stats.cold_start_batches += clock() - began >= COLD_START_S
        out += vectors
        at, failures = at + len(part), 0
        if size < first:
            size = min(first, size * 2)
    stats.final_batch_size = size
    return out, stats


def embed_query(text: str, embed: EmbedFn) -> list[float]:
    text = text.strip()
    if not text:
        raise EmbedError(400, "the query is blank")
    return embed([text], "search_query")[0]


def hashed_words(dimension: int = 64) -> EmbedFn:
    """A stand-in model: words hashed with signs into ``dimension`` places, unit length."""

    def embed(texts: list[str], task: str) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(dimension)
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                v[h % dimension] += 1.0 if h & 1 << 31 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out

    return embed
