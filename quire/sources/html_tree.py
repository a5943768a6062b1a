"""An HTML tree by the published parsing rules: implied end tags, active formatting elements, adoption agency."""

from __future__ import annotations

from html.parser import HTMLParser

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEAD = set("base link meta title style script noscript template".split())
FORMAT = set("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
SPECIAL = CLOSES_P | VOID | set("body html td th tr tbody thead tfoot caption button object applet marquee select textarea template iframe noscript script style title head".split())
SCOPE = set("html table td th caption button object applet marquee template".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())


class Element:
    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], None

    def append(self, node) -> None:
        if isinstance(node, Element):
            if node.parent:
                node.parent.children.remove(node)
            node.parent = self
            self.children.append(node)
        elif self.children and isinstance(self.children[-1], str):
            self.children[-1] += node
        else:
            self.children.append(node)

    def walk(self):
        stack = [self]
        while stack:
            e = stack.pop()
            yield e
            stack.extend(c for c in reversed(e.children) if isinstance(c, Element))

    def all(self, *tags: str):
        return (e for e in self.walk() if e.tag in tags and e is not self)

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            e = stack.pop()
            if isinstance(e, str):
                out.append(e)
            else:
                stack.extend(reversed(e.children))
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.html, self.head, self.body = Element("html"), Element("head"), Element("body")
        self.html.append(self.head)
        self.html.append(self.body)
        self.open: list[Element] = [self.html, self.body]
        self.formats: list[Element | None] = []
        self.started = False

    # Stack helpers
    def scoped(self, tags: set[str], also: frozenset[str] = frozenset()) -> bool:
        for e in reversed(self.open):
            if e.tag in tags:
                return True
            if e.tag in SCOPE or e.tag in also:
                return False
        return False

    def pop_to(self, tags: set[str]) -> None:
        while len(self.open) > 2:
            if self.open.pop().tag in tags:
                return

    def imply(self, but: str = "") -> None:
        while len(self.open) > 2 and self.open[-1].tag in {"dd", "dt", "li", "p", "option", "optgroup"} and self.open[-1].tag != but:
            self.open.pop()

    def close_p(self) -> None:
        if self.scoped({"p"}):
            self.imply("p")
            self.pop_to({"p"})

    def insert(self, tag: str, attrs: dict[str, str]) -> Element:
        e = Element(tag, attrs)
        at = self.open[-1]
        if at.tag in {"table", "tbody", "thead", "tfoot", "tr"} and tag not in {"caption", "colgroup", "col", "tbody", "thead", "tfoot", "tr", "td", "th", "script", "style", "template"}:
            self.foster(e)
        else:
            at.append(e)
        if tag not in VOID:
            self.open.append(e)
        return e

    def foster(self, node) -> None:
        """Content that may not stand in a table goes before it."""
        t = next(e for e in reversed(self.open) if e.tag == "table")
        up = t.parent or self.body
        k = up.children.index(t) if t in up.children else len(up.children)
        if isinstance(node, Element):
            if node.parent:
                node.parent.children.remove(node)
            node.parent = up
        up.children.insert(k, node)

    def reconstruct(self) -> None:
        if not self.formats or self.formats[-1] is None or self.formats[-1] in self.open:
            return
        k = len(self.formats) - 1
        while k > 0 and self.formats[k - 1] is not None and self.formats[k - 1] not in self.open:
            k -= 1
        for j in range(k, len(self.formats)):
            old = self.formats[j]
            self.formats[j] = self.insert(old.tag, dict(old.attrs))

    def remember(self, e: Element) -> None:
        same = []
        for f in reversed(self.formats):
            if f is None:
                break
            if f.tag == e.tag and f.attrs == e.attrs:
                same.append(f)
        if len(same) >= 3:  # at most three alike
            self.formats.remove(same[-1])
        self.formats.append(e)

    def adopt(self, tag: str) -> None:
        if self.open[-1].tag == tag and self.open[-1] not in self.formats:
            self.open.pop()
            return
        for _ in range(8):
            entry = None
            for f in reversed(self.formats):
                if f is None:
                    break
                if f.tag == tag:
                    entry = f
                    break
            if entry is None:
                return self.end_other(tag)
            if entry not in self.open:
                self.formats.remove(entry)
                return None
            if not self.scoped({tag}):
                return None
            at = self.open.index(entry)
            block = next((e for e in self.open[at + 1 :] if e.tag in SPECIAL), None)
            if block is None:
                del self.open[at:]
                self.formats.remove(entry)
                return None
            common, mark = self.open[at - 1], self.formats.index(entry)
            node = last = block
            k, steps = self.open.index(block), 0
            while True:
                steps += 1
                k -= 1
                node = self.open[k]
                if node is entry:
                    break
                if steps > 3 and node in self.formats:
                    mark -= self.formats.index(node) < mark
                    self.formats.remove(node)
                if node not in self.formats:
                    del self.open[k]
                    continue
                fresh = Element(node.tag, dict(node.attrs))
                self.formats[self.formats.index(node)] = fresh
                self.open[k] = fresh
                if last is block:
                    mark = self.formats.index(fresh) + 1
                fresh.append(last)
                last = fresh
            if common.tag in {"table", "tbody", "thead", "tfoot", "tr"}:
                self.foster(last)
            else:
                common.append(last)
            fresh = Element(entry.tag, dict(entry.attrs))
            for c in list(block.children):
                if isinstance(c, Element):
                    fresh.append(c)
                else:
                    fresh.children.append(c)
            block.children = []
            block.append(fresh)
            old = self.formats.index(entry)
            self.formats.insert(mark, fresh)
            self.formats.pop(old if old < mark else old + 1)
            self.open.remove(entry)
            self.open.insert(self.open.index(block) + 1, fresh)
        return None

    def end_other(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 1, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if self.open[k].tag in SPECIAL:
                return

    # Tokens
    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        got: dict[str, str] = {}
        for k, v in attrs:
            got.setdefault(k, v or "")
        if tag in ("html", "head", "body"):
            into = {"html": self.html, "head": self.head, "body": self.body}[tag]
            for k, v in got.items():
                into.attrs.setdefault(k, v)
            self.started |= tag == "body"
            return
        if tag in HEAD:
            e = Element(tag, got)
            (self.open[-1] if self.started else self.head).append(e)
            if tag not in VOID:
                self.open.append(e)
            return
        self.started = True
        if tag in {"caption", "colgroup", "tbody", "thead", "tfoot", "tr", "td", "th"}:
            return self.table_part(tag, got)
        if tag == "li" or tag in {"dd", "dt"}:
            mine = {"li"} if tag == "li" else {"dd", "dt"}
            for e in reversed(self.open):
                if e.tag in mine:
                    self.imply(e.tag)
                    self.pop_to({e.tag})
                    break
                if e.tag in SPECIAL and e.tag not in {"address", "div", "p"}:
                    break
        if tag in CLOSES_P:
            self.close_p()
            if tag in HEADINGS and self.open[-1].tag in HEADINGS:
                self.open.pop()
            self.insert(tag, got)
            return
        if tag == "a":
            entry = next((f for f in reversed(self.formats) if f is None or f.tag == "a"), None)
            if entry is not None:
                self.adopt("a")
                if entry in self.formats:
                    self.formats.remove(entry)
                if entry in self.open:
                    self.open.remove(entry)
        self.reconstruct()
        if tag == "image":
            tag = "img"
        e = self.insert(tag, got)
        if tag in FORMAT:
            self.remember(e)

    def table_part(self, tag: str, got: dict[str, str]) -> None:
        if not any(e.tag == "table" for e in self.open):
            return
        stops = {"td": {"table", "tbody", "thead", "tfoot", "tr"}, "th": {"table", "tbody", "thead", "tfoot", "tr"}, "tr": {"table", "tbody", "thead", "tfoot"}}.get(tag, {"table"})
        while self.open[-1].tag not in stops:
            if self.open.pop().tag in {"td", "th", "caption"}:
                self.unmark()
        if tag in {"td", "th"} and self.open[-1].tag != "tr":
            self.table_part("tr", {})
        if tag == "tr" and self.open[-1].tag == "table":
            self.insert("tbody", {})
        self.insert(tag, got)
        if tag in {"td", "th", "caption"}:
            self.formats.append(None)

    def unmark(self) -> None:
        while self.formats and self.formats.pop() is not None:
            pass

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body", "head"):
            self.started |= tag == "head"
            return
        if tag in HEAD:
            if self.open[-1].tag == tag:
                self.open.pop()
        elif tag == "p":
            if not self.scoped({"p"}):
                self.insert("p", {})
            self.close_p()
        elif tag == "br":
            self.handle_starttag("br", [])
        elif tag in {"table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"}:
            if any(e.tag == tag for e in self.open):
                while len(self.open) > 2:
                    e = self.open.pop()
                    if e.tag in {"td", "th", "caption"}:
                        self.unmark()
                    if e.tag == tag:
                        break
        elif tag in FORMAT:
            self.adopt(tag)
        elif tag in HEADINGS:
            if self.scoped(HEADINGS):
                self.imply()
                self.pop_to(HEADINGS)
        elif tag in CLOSES_P:
            if self.scoped({tag}, frozenset({"ul", "ol"}) if tag == "li" else frozenset()):
                self.imply(tag)
                self.pop_to({tag})
        else:
            self.end_other(tag)

    def handle_data(self, data: str) -> None:
        at = self.open[-1]
        if at.tag in HEAD or at.tag in {"textarea"}:
            at.append(data)
        elif at.tag in {"table", "tbody", "thead", "tfoot", "tr"}:
            if data.strip():
                self.foster(data)
        else:
            if not data.strip() and not self.started:
                return
            self.started = True
            self.reconstruct()
            self.open[-1].append(data)


def parse_html(html: str) -> Element:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.html
