"""Markdown, HTML or plain text to content blocks with their sections. Pure Python; runs inside Arrow batches.

Kept quirks: an opening fence does not end an open table, so that code comes out before the table above it; a
heading's title needs two characters; emphasis marks stay in the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import NamedTuple

from siltwork.functions import markup

LEAST = {"paragraph": 30, "table": 30, "code": 20, "list": 20}
MAX_BLOCKS, MAX_LINE = 2000, 2 << 20
# Line patterns.
HEADING = re.compile(r"^(#{1,6})\s+(.+\S)\s*$")
NUMBERED = re.compile(r"^\d+\.\s+")
SEPARATOR = re.compile(r"^\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?$")
IMAGE, LINK = re.compile(r"!\[[^\]]*\]\([^)]+\)"), re.compile(r"\[([^\]]+)\]\([^)]+\)")
# Tags that the tree walk leaves out, and those whose text is a block.
SKIPPED_TAGS = {"script", "nav", "menu", "sidebar", "toc", "breadcrumb", "footer", "header"}
WALKED = {"p": "paragraph", "blockquote": "paragraph", "code": "code", "pre": "code", "td": "table", "th": "table", "dd": "paragraph", "dt": "paragraph"}


class Block(NamedTuple):
    section_title: str
    section_path: str
    heading_level: int
    type: str
    text: str


class NoContent(ValueError):
    pass


def collapse(text: str) -> str:
    return " ".join(text.split())


def normalise(text: str) -> str:
    return collapse(LINK.sub(r"\1", IMAGE.sub("", text)))


def list_item(line: str) -> str | None:
    """A bulleted line's text, or what follows the first point and space of a numbered one; null for other lines."""
    if line[:2] in ("- ", "* ", "+ "):
        return normalise(line[2:])
    head, mark, rest = line.partition(". ")
    return normalise(rest) if mark and rest and NUMBERED.match(line) else None


def cells(line: str) -> list[str]:
    inner = line.strip().strip("|")
    return [c.strip() for c in inner.split("|")] if inner else []


def is_table_line(line: str) -> bool:
    if SEPARATOR.match(line):
        return True
    return len(line) > 1 and line[0] == "|" == line[-1] and len(cells(line)) >= 2


@dataclass
class Machine:
    """What is open while lines are read."""

    blocks: list[Block] = field(default_factory=list)
    seen: set[tuple[str, str, str]] = field(default_factory=set)
    stack: list[str] = field(default_factory=list)
    paragraph: list[str] = field(default_factory=list)
    items: list[str] = field(default_factory=list)
    code: list[str] = field(default_factory=list)
    table: list[str] = field(default_factory=list)
    language: str = ""
    level: int = 0

    def emit(self, kind: str, text: str) -> None:
        text = text.strip()
        path = " > ".join(s for s in self.stack if s)
        if len(text.encode()) < LEAST[kind] or (path, kind, text) in self.seen:
            return
        self.seen.add((path, kind, text))
        self.blocks.append(Block(self.stack[-1] if self.stack else "", path, self.level, kind, text))

    def end_paragraph(self) -> None:
        lines, self.paragraph = self.paragraph, []
        if lines:
            self.emit("paragraph", normalise(" ".join(lines)))

    def end_list(self) -> None:
        items, self.items = self.items, []
        if items:
            self.emit("list", normalise("; ".join(items)))

    def end_code(self) -> None:
        lines, self.code = self.code, []
        body = "\n".join(x.rstrip(" \t") for x in lines).strip()
        language, self.language = self.language, ""
        if body:
            self.emit("code", f"language: {language}\n{body}" if language else body)

    def end_table(self) -> None:
        lines, self.table = self.table, []
        if not lines:
            return
        if len(lines) < 2:
            self.emit("paragraph", normalise(" ".join(lines)))
            return
        headed = bool(SEPARATOR.match(lines[1]))
        header = [collapse(c) for c in cells(lines[0])] if headed else []
        rows = []
        for line in lines[2:] if headed else lines:
            if SEPARATOR.match(line):
                continue
            named = [(header[k] if k < len(header) else "", collapse(c)) for k, c in enumerate(cells(line))]
            shown = ", ".join(f"{h}: {c}" if h else c for h, c in named if c)
            if shown:
                rows.append(shown)
        self.emit("table", ". ".join(rows))

    def enter(self, level: int, title: str) -> None:
        if not title:  # an image alone names no section
            return
        del self.stack[level - 1 :]
        self.stack += [""] * (level - 1 - len(self.stack)) + [title]
        self.level = level


def from_markdown(text: str) -> list[Block]:
    m, fenced = Machine(), False
    for raw in text.split("\n"):
        raw = raw.removesuffix("\r")
        if 4 * len(raw) > MAX_LINE and len(raw.encode()) > MAX_LINE:
            raise ValueError("a line is too long")
        line = raw.strip()
        if line.startswith("```"):
            if fenced:
                m.end_code()
            else:
                m.end_paragraph()
                m.end_list()
                m.language = line[3:].strip()
            fenced = not fenced
            continue
        if fenced:
            m.code.append(raw)
            continue
        if is_table_line(line):
            m.end_paragraph()
            m.end_list()
            m.table.append(line)
            continue
        m.end_table()
        if not line:
            m.end_paragraph()
            m.end_list()
        elif heading := HEADING.match(line):
            m.end_paragraph()
            m.end_list()
            m.enter(len(heading[1]), normalise(heading[2]))
        elif line in ("---", "***", "___"):
            m.end_paragraph()
            m.end_list()
        elif (item := list_item(line)) is not None:
            m.end_paragraph()
            m.items.append(item)
        else:
            m.end_list()
            m.paragraph.append(line)
    m.end_paragraph()
    m.end_list()
    m.end_code()
    m.end_table()
    return m.blocks


def from_tree(tree: markup.Node) -> list[Block]:
    """Blocks by a walk of the tree, for pages whose Markdown has none. List items are left out."""
    blocks, seen, section, level = [], set(), "", 0
    todo: list[markup.Node | str] = [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            continue
        if node.tag in SKIPPED_TAGS:
            continue
        if node.tag in markup.HEADINGS:
            if title := node.text("").strip():
                section, level = title, markup.HEADINGS[node.tag]
            continue
        if node.tag in WALKED:
            text = node.text("").strip()
            if len(text.encode()) >= 30 and (section, node.tag, text) not in seen:
                seen.add((section, node.tag, text))
                blocks.append(Block(section, section, level, WALKED[node.tag], text))
            continue
        todo.extend(reversed(node.children))
    return blocks


def from_plain(text: str) -> list[Block]:
    parts = text.split("\n\n") if "\n\n" in text else text.split("\n")
    return [Block("", "", 0, "paragraph", t) for p in parts if len((t := collapse(p)).encode()) >= 30]


def extract(html: str) -> tuple[list[Block], str]:
    """(blocks, method): markdown, or legacy (the tree walk); ``NoContent`` if neither has any."""
    tree = markup.parse(html)
    if found := from_markdown(markup.markdown(tree)):
        return found, "markdown"
    if found := from_tree(tree):
        return found, "legacy"
    raise NoContent("no content")


def clean(html: str | None, text: str | None = None) -> tuple[list[Block], str]:
    """Blocks of a page's article with the fallbacks: too many blocks or none give plain text."""
    try:
        tree = markup.article(markup.parse(html or ""))
        found, method = from_markdown(markup.markdown(tree)), "markdown"
        if not found:
            found, method = from_tree(tree), "legacy"
    except ValueError:
        found, method = [], ""
    if found and len(found) <= MAX_BLOCKS:
        return found, method
    return from_plain(text if text is not None else markup.article(markup.parse(html or "")).text()), "plain_text"
