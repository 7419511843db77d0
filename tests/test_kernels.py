"""Pure kernels: blocks, chunks, sentences, batches, delays."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltwork.functions import blocks as B
from siltwork.functions import chunking as C
from siltwork.functions import embedding as E
from siltwork.functions.tokens import words
from siltwork.sources import fetch as S
from siltwork.streaming.queues import next_waits

LONG = "This sentence is certainly long enough to pass the least length of a block."


def block(text, kind="paragraph", path="", level=0, title=""):
    return B.Block(title, path, level, kind, text)


def test_prefix_counts_against_the_budget():
    path = "Fetcher > Retry Policy > Exponential Backoff"
    text = "The system retries transient failures with jittered exponential backoff. " * 8
    chunks = C.Chunker(words, 30, 1).chunk([block(text, path=path, level=3)], "Ingestion Guide", "https://example.com")
    assert chunks
    for c in chunks:
        assert words(c.embed_text) <= 30
        assert f"Section: {path}" in c.embed_text and "Document: Ingestion Guide" in c.embed_text
        assert "Document:" not in c.content


def test_sections_end_chunks():
    found = C.Chunker(words, 200, 1).chunk([block("Part A explains ingestion.", path="A > O"), block("Part B explains retrieval.", path="B > O")])
    assert [c.metadata["section_path"] for c in found] == ["A > O", "B > O"]


def unit(text, n, kind="paragraph"):
    return C.Unit(text, n, kind, 0)


def test_overlap_is_for_flowing_text_only():
    before = [unit("SELECT", 5, "code"), unit("a", 6), unit("b", 5)]
    assert [u.text for u in C.overlap(before, "paragraph", 100, 2)] == ["a", "b"]
    assert C.overlap(before, "code", 100, 2) == []


def test_overlap_keeps_the_oldest_that_fit():
    assert [u.text for u in C.overlap([unit("A", 50), unit("B", 300), unit("C", 50)], "paragraph", 100, 3)] == ["A"]


def test_ties_prefer_code():
    assert C.dominant_type({"paragraph": 2, "code": 2, "list": 2}) == "code"


@pytest.mark.parametrize("text", ["Install Go; Configure GOPATH; Run go test", "- first\n- second\n3. third"])
def test_list_formats(text):
    assert len(C.items(text)) == 3


def test_metadata():
    (c,) = C.Chunker(words, 150, 1).chunk([block("Install dependencies; Configure environment; Run migration", "list", "Setup > Install", 2, "Install")], "Guide", "u")
    expected = {"section_title": "Install", "section_path": "Setup > Install", "heading_level": 2, "block_type": "list", "total_chunks": 1, "chunk_index": 0, "document_title": "Guide"}
    assert expected.items() <= c.metadata.items() and c.token_count > 0


@pytest.mark.parametrize(
    ("text", "n"),
    [("Hello world. How are you?", 2), ("Dr. Smith went home. He was tired.", 2), ("This costs $3.50 per unit. Buy now.", 2), ("Go is great! Really? Yes.", 3), ("e.g. this is an example. It works.", 2), ("Single sentence without period", 1), ("in 2024. Next", 1), ("", 0)],
)
def test_sentences(text, n):
    assert len(C.sentences(text)) == n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ab .!\n;", max_size=120), st.sampled_from(["paragraph", "code", "list", "table"]), st.sampled_from(["x", "y"])), max_size=8), st.integers(2, 12))
def test_chunks_lose_no_word(parts, limit):
    found = C.Chunker(words, limit, 0).chunk([block(t, k, p) for t, k, p in parts])
    assert [c.index for c in found] == list(range(len(found)))
    assert all(c.token_count == words(c.content) and c.metadata["total_chunks"] == len(found) for c in found)
    lost = lambda t: [w.strip(";") for w in t.replace(";", " ").split() if w.strip(";")]
    assert lost(" ".join(c.content for c in found)) == lost(" ".join(t for t, _, _ in parts))


def test_markdown_first():
    found, method = B.extract(f"<h1>Introduction</h1><p>{LONG}</p>")
    assert method == "markdown" and found[0].type == "paragraph" and found[0].section_path == "Introduction"


def test_no_content():
    with pytest.raises(B.NoContent):
        B.extract("<p>short</p>")
    assert B.clean(None) == ([], "plain_text")


def test_plain_text_lines():
    assert len(B.from_plain(f"{LONG}\n{LONG} More.")) == 2
    assert len(B.from_plain(f"{LONG}\n{LONG}\n\n{LONG}")) == 2


@pytest.mark.parametrize(("line", "is_table"), [("| grep main", False), ("| name | value |", True), ("| ---- | ---- |", True), ("|---|", False)])
def test_table_lines(line, is_table):
    assert B.is_table_line(line) is is_table


def test_code_fence():
    (b,) = B.from_markdown('```go\nfmt.Println("hello")\n```')
    assert b.type == "code" and b.text.startswith("language: go\n")


def test_numbered_item():
    assert B.list_item("10. install dependencies") == "install dependencies"
    assert B.list_item("3.x") is None


def test_tables_and_lists():
    text = "# One\n### Three\n| name | value |\n| --- | --- |\n| alpha alpha alpha | 1 |\n| beta beta beta | |\n\n- first item of all\n- second item of all\n"
    table, items = B.from_markdown(text)
    assert table.type == "table" and table.text == "name: alpha alpha alpha, value: 1. name: beta beta beta"
    assert table.section_path == "One > Three" and items.text == "first item of all; second item of all"


def test_open_fence_comes_before_the_table_above():
    text = "| aaaaaaaaaaaa | bbbbbbbbbbbb |\n| cccccccccccc | dddddddddddd |\n```\nsome code that is long enough\n```\n\nend"
    assert [b.type for b in B.from_markdown(text)][:2] == ["code", "table"]


def test_misnested_html():
    html = f'<article><p><b>{LONG}<br><p>{LONG} Two.</p></article><script>var t="</p>";</script><footer>{LONG} Three.</footer>'
    found, _ = B.clean(html)
    assert [LONG in b.text for b in found] == [True, True]


def test_adaptive_batches():
    sizes = []

    def model(texts, task):
        sizes.append(len(texts))
        if len(texts) > 4:
            raise E.EmbedError(429)
        return [[float(len(t))] for t in texts]

    out, stats = E.embed_batches([str(k) * k for k in range(20)], model, 1, 16, sleep=lambda s: None)
    assert [v[0] for v in out] == [len(str(k) * k) for k in range(20)]
    assert stats.retries > 0 and sizes[:3] == [16, 8, 4] and sizes[3] == 8


@pytest.mark.parametrize(("error", "batch"), [(E.EmbedError(429), 1), (E.EmbedError(400), 8), (E.EmbedError(503, cancelled=True), 8)])
def test_final_failures(error, batch):
    def model(texts, task):
        raise error

    with pytest.raises(E.EmbedError):
        E.embed_batches(["a"], model, batch=batch, sleep=lambda s: None)


def test_delays():
    assert [E.retry_delay_ms(n, lambda: 0) for n in (1, 2, 5, 6, 40)] == [500, 1000, 8000, 10000, 10000]
    assert E.retry_delay_ms(5, lambda: 1) == 9600 and E.retry_delay_ms(6, lambda: 1) == 10000
    assert [S.backoff_s(n, lambda: 0) for n in (1, 2, 5)] == [0.5, 1, 5]
    assert next_waits([False, False, True, False], 2, 5) == [4, 5, 2, 4]


def page(status=200, kind="text/html", body=f"<article><p>{LONG}</p></article>".encode(), retry=0.0):
    return S.Response(status, kind, body, "http://x", retry)


@pytest.mark.parametrize(("response", "code"), [(page(404), 404), (page(kind="application/pdf"), 415), (page(body=b""), 204), (page(body=b"<p> </p>"), 422)])
def test_fetch_checks(response, code):
    with pytest.raises(S.FetchError) as e:
        S.check(response)
    assert e.value.status == code


def test_fetch_retries_and_waits():
    answers, waits = [page(503, retry=7), page(429), page()], []
    _, text, _ = S.fetch("http://x/a", lambda u, t: answers.pop(0), sleep=waits.append, jitter=lambda: 0)
    assert LONG in text and waits == [7, 1.0]
    with pytest.raises(S.FetchError):
        S.fetch("ftp://x", lambda u, t: page())
    calls = []
    with pytest.raises(S.FetchError):
        S.fetch("http://x", lambda u, t: calls.append(1) or page(404), sleep=waits.append)
    assert len(calls) == 1
