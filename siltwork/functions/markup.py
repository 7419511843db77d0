"""HTML to a small tree, to the article, to Markdown lines. Pure Python; runs inside Arrow batches."""

from __future__ import annotations

from dataclasses import dataclass, field
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
DROPPED = {"script", "style", "noscript", "iframe", "canvas", "template", "head"}
#: Start tags that end an open paragraph, as in HTML's own rules.
ENDS_PARAGRAPH = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
ENDS_SAME = {"li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
HEADINGS = {f"h{n}": n for n in range(1, 7)}
ASIDE = {"nav", "footer", "aside", "header", "form", "button"}


@dataclass
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    def text(self, line_break: str = "\n") -> str:
        parts, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                parts.append(n)
            elif n.tag == "br":
                parts.append(line_break)
            else:
                todo.extend(reversed(n.children))
        return "".join(parts)

    def walk(self):
        todo: list[Node] = [self]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(c for c in reversed(n.children) if isinstance(c, Node))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = Node("document")
        self.open = [self.top]
        self.skipping: str | None = None

    def _close_to(self, tags: set[str], barrier: set[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                del self.open[k:]
                return
            if self.open[k].tag in barrier:
                return

    def handle_starttag(self, tag, attrs):
        if self.skipping:
            return
        if tag in DROPPED and tag not in VOID:
            self.skipping = tag
            return
        if tag in ENDS_PARAGRAPH:
            self._close_to({"p"}, {"table", "td", "th", "li", "div", "article", "section", "body"})
        if tag in ENDS_SAME:
            self._close_to(*ENDS_SAME[tag])
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and not self.skipping and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        if self.skipping:
            if tag == self.skipping:
                self.skipping = None
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        if not self.skipping:
            self.open[-1].children.append(data)


def parse(html: str) -> Node:
    """A tree without scripts, styles and the like; unclosed and misnested tags are closed."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.top


def title_of(html: str) -> str:
    class Title(HTMLParser):
        inside, text = False, ""

        def handle_starttag(self, tag, attrs):
            self.inside = tag == "title" and not self.text

        def handle_endtag(self, tag):
            self.inside = False

        def handle_data(self, data):
            if self.inside:
                self.text += data

    t = Title()
    t.feed(html)
    return " ".join(t.text.split())


def article(tree: Node) -> Node:
    """The content: the longest article or main, else the densest block, without navigation and asides."""
    named = [n for n in tree.walk() if n.tag in ("article", "main")]
    if named:
        best = max(named, key=lambda n: len(n.text()))
    else:
        best = max((n for n in tree.walk() if n.tag in ("div", "section", "body", "td", "document")), key=_score, default=tree)
    return _without(best, ASIDE)


def _score(node: Node) -> float:
    own = sum(len(c.text()) for c in node.children if isinstance(c, Node) and c.tag in ("p", "pre", "blockquote", "ul", "ol", "table", *HEADINGS))
    linked = sum(len(n.text()) for n in node.walk() if n.tag == "a")
    return own - linked


def _without(node: Node, tags: set[str]) -> Node:
    out = Node(node.tag, node.attributes)
    todo = [(node, out)]
    while todo:
        old, new = todo.pop()
        for c in old.children:
            if isinstance(c, str):
                new.children.append(c)
            elif c.tag not in tags:
                copy = Node(c.tag, c.attributes)
                new.children.append(copy)
                todo.append((c, copy))
    return out


def markdown(tree: Node) -> str:
    """Markdown of the tree: headings, paragraphs, lists, fences, tables, quotes, links, images, emphasis, rules.

    Special characters in text are not escaped.
    """
    lines: list[str] = []
    _blocks(tree, lines, 0)
    return "\n".join(lines)


def _inline(node: Node, depth: int = 0) -> str:
    if depth > 200:
        return node.text()
    parts = []
    for c in node.children:
        if isinstance(c, str):
            parts.append(c)
        elif c.tag == "br":
            parts.append("\n")
        elif c.tag == "img":
            parts.append(f"![{c.attributes.get('alt', '')}]({c.attributes.get('src', '')})")
        elif c.tag == "a" and c.attributes.get("href"):
            inner = " ".join(_inline(c, depth + 1).split())
            parts.append(f"[{inner}]({c.attributes['href']})" if inner else "")
        elif c.tag in ("strong", "b", "em", "i"):
            inner, mark = _inline(c, depth + 1), "**" if c.tag in ("strong", "b") else "*"
            body = inner.strip()
            parts.append(inner.replace(body, f"{mark}{body}{mark}", 1) if body and "\n" not in body else inner)
        elif c.tag == "code":
            parts.append(f"`{c.text()}`")
        else:
            parts.append(_inline(c, depth + 1))
    return "".join(parts)


INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "u", "var", "br", "wbr"}


def _has_block(node: Node) -> bool:
    return any(n is not node and n.tag not in INLINE for n in node.walk())


def _paragraph(text: str, lines: list[str], prefix: str = "") -> None:
    kept = [" ".join(part.split()) for part in text.split("\n")]
    kept = [k for k in kept if k]
    if kept:
        lines += [prefix + k for k in kept] + [""]


def _blocks(node: Node, lines: list[str], depth: int) -> None:
    if depth > 200:
        _paragraph(node.text(), lines)
        return
    run = Node("run")

    def flush():
        if run.children:
            _paragraph(_inline(run), lines)
            run.children.clear()

    for c in node.children:
        if isinstance(c, str) or c.tag in INLINE and not _has_block(c):
            run.children.append(c)
            continue
        flush()
        if c.tag in HEADINGS:
            text = " ".join(_inline(c).split())
            lines += [f"{'#' * HEADINGS[c.tag]} {text}", ""] if text else []
        elif c.tag in ("ul", "ol"):
            _list(c, lines, depth + 1)
            lines.append("")
        elif c.tag == "pre":
            code = next((n for n in c.walk() if n.tag == "code"), c)
            kind = next((k.removeprefix("language-") for k in code.attributes.get("class", "").split() if k.startswith("language-")), "")
            lines += [f"```{kind}", *c.text().strip("\n").split("\n"), "```", ""]
        elif c.tag == "table":
            _table(c, lines)
        elif c.tag == "hr":
            lines += ["---", ""]
        elif c.tag == "blockquote":
            inner: list[str] = []
            _blocks(c, inner, depth + 1)
            lines += [f"> {x}" if x else ">" for x in inner if x] + [""]
        elif c.tag == "p" and not _has_block(c):
            _paragraph(_inline(c), lines)
        else:
            _blocks(c, lines, depth + 1)
    flush()


def _list(node: Node, lines: list[str], depth: int) -> None:
    n = 0
    for c in node.children:
        if isinstance(c, str) or c.tag != "li":
            continue
        n += 1
        own, nested = Node("li"), []
        for x in c.children:
            (nested if isinstance(x, Node) and x.tag in ("ul", "ol") else own.children).append(x)
        text = " ".join(_inline(own).split())
        if text:
            lines.append(f"{n}. {text}" if node.tag == "ol" else f"- {text}")
        for x in nested:
            _list(x, lines, depth + 1)


def _table(node: Node, lines: list[str]) -> None:
    rows = [[" ".join(_inline(c).split()).replace("|", "\\|") for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in node.walk() if r.tag == "tr"]
    rows = [r for r in rows if any(r)]
    if rows:
        width = max(map(len, rows))
        rows = [r + [""] * (width - len(r)) for r in rows]
        lines += ["| " + " | ".join(r) + " |" for r in [rows[0]]] + ["| " + " | ".join(["---"] * width) + " |"]
        lines += ["| " + " | ".join(r) + " |" for r in rows[1:]] + [""]
