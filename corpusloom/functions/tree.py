"""HTML tree construction: a document tree of any markup, repaired as the standard says.

Tokens come from the standard library's parser. The builder holds the stack of open elements, the list of active formatting elements and an insertion mode; implied elements
are made, misnested formatting is adopted, and what may not be in a table is placed before it. `created` lists nodes as they were made, `walk` as they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

# Fixed values of the HTML standard: names of elements by what the parser does with them.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes script style template title".split())
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
SPECIAL = BLOCKS | HEADINGS | VOID - {"keygen"} | RAW | frozenset("applet body button caption colgroup dd dt form frameset head html li listing marquee object plaintext pre select tbody td template tfoot th thead tr".split())
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
TABLE_PARTS = frozenset("caption colgroup tbody td tfoot th thead tr".split())
SCOPE = frozenset("applet caption html table td th marquee object template".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
FOREIGN_SCOPE = {("math", n) for n in ("mi", "mo", "mn", "ms", "mtext", "annotation-xml")} | {("svg", n) for n in ("foreignObject", "desc", "title")}
#: Names that are written otherwise in SVG.
SVG_NAMES = {n.lower(): n for n in "altGlyph altGlyphDef altGlyphItem animateColor animateMotion animateTransform clipPath feBlend feColorMatrix feComponentTransfer feComposite feConvolveMatrix feDiffuseLighting feDisplacementMap feDistantLight feDropShadow feFlood feFuncA feFuncB feFuncG feFuncR feGaussianBlur feImage feMerge feMergeNode feMorphology feOffset fePointLight feSpecularLighting feSpotLight feTile feTurbulence foreignObject glyphRef linearGradient radialGradient textPath".split()}
#: Beginnings of public identifiers that stand for quirks, the common ones.
QUIRKS = ("-//ietf//dtd html", "-//w3c//dtd html 3", "-//w3c//dtd html 4.0 transitional", "-//w3c//dtd html 4.0 frameset", "-//netscape", "-//microsoft")

SPACE = " \t\n\f\r"


class Node:
    """An element (`name`), a text (`name` "#text"), or a comment ("#comment")."""

    __slots__ = ("name", "kind", "attrs", "parent", "children", "text")

    def __init__(self, name: str, kind: str = "html", attrs: dict[str, str] | None = None, text: str = ""):
        self.name, self.kind, self.attrs, self.text = name, kind, attrs or {}, text
        self.parent: Node | None = None
        self.children: list[Node] = []

    def leave(self) -> None:
        if self.parent is not None:
            self.parent.children.remove(self)
            self.parent = None

    def take(self, node: Node, before: Node | None = None) -> None:
        node.leave()
        node.parent = self
        self.children.insert(self.children.index(before) if before is not None else len(self.children), node)


def walk(root: Node) -> Iterator[Node]:
    """Nodes in the order of the document."""
    todo = list(reversed(root.children))
    while todo:
        node = todo.pop()
        yield node
        todo.extend(reversed(node.children))


class Builder(HTMLParser):
    """Feed it markup and close it: `document` is the tree, `created` its nodes in the order they were made."""

    CDATA_CONTENT_ELEMENTS = tuple(sorted(RAW))
    RCDATA_CONTENT_ELEMENTS = ()  # character references of titles and text areas are read in handle_data

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.document, self.created = Node("#document"), []
        self.open: list[Node] = []
        self.formatting: list[Node | None] = []  # None: a marker
        self.mode = self.back = "initial"
        self.templates: list[str] = []
        self.head = self.form = None
        self.quirks, self.frames_ok, self.foster, self.plain = True, True, False, False
        self.pending: list[str] = []  # text directly in a table

    # What the standard library's parser calls

    def set_cdata_mode(self, elem: str, **more) -> None:
        if self.open and self.open[-1].kind == "html" and self.open[-1].name == elem.lower():
            super().set_cdata_mode(elem, **more)

    def handle_decl(self, decl: str) -> None:
        if self.mode == "initial":
            words = decl.lower().replace("'", '"').split('"')
            name = words[0].split()
            public = words[1] if len(words) > 1 and "public" in words[0] else ""
            loose = public.startswith(("-//w3c//dtd html 4.01 frameset", "-//w3c//dtd html 4.01 transitional")) and len(words) < 4
            self.quirks = name[:2] != ["doctype", "html"] or public.startswith(QUIRKS) or loose
            self.mode = "before_html"

    def handle_comment(self, data: str) -> None:
        self._flush()
        comment = Node("#comment", text=data)
        if self.mode in ("initial", "before_html", "after_after_body"):
            self.document.take(comment)
        elif self.mode == "after_body":
            self.open[0].take(comment)
        else:
            self._place(comment)

    def unknown_decl(self, data: str) -> None:
        self.handle_comment(data)

    def handle_pi(self, data: str) -> None:
        self.handle_comment(data)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._start(tag, attrs, True)
        if self.mode == "text":  # a slash does not close these
            self.set_cdata_mode(tag)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._start(tag, attrs, False)

    def _start(self, tag: str, attrs: list[tuple[str, str | None]], closed: bool) -> None:
        if self.plain:
            return
        self._flush()
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        self.start(tag, own, closed)

    def handle_endtag(self, tag: str) -> None:
        if not self.plain:
            self._flush()
            self.end(tag)

    def handle_data(self, data: str) -> None:
        if self.mode == "text":
            self._text(unescape(data) if self.open[-1].name in ("title", "textarea") else data)
        elif self.plain:
            self._text(data)
        else:
            self.chars(data)

    def close(self) -> None:
        if self.cdata_elem is not None and self.rawdata:  # raw text that nothing ends
            rest, self.rawdata = self.rawdata, ""
            self.handle_data(rest)
        super().close()
        self._flush()
        if self.mode == "text":
            self.open.pop()
            self.mode = self.back
        while self.templates:
            self._end_in_head("template")
        for _ in range(8):  # what the end of a document implies
            if self.mode in ("initial", "before_html", "before_head", "in_head", "after_head"):
                self._imply()

    # The tree

    def _target(self) -> tuple[Node, Node | None]:
        """Where a node goes: (parent, the child it goes before)."""
        at = self.open[-1]
        if self.foster and at.name in ("table", "tbody", "tfoot", "thead", "tr"):
            tables = [i for i, n in enumerate(self.open) if n.name == "table"]
            templates = [i for i, n in enumerate(self.open) if n.name == "template"]
            if templates and (not tables or templates[-1] > tables[-1]):
                return self.open[templates[-1]], None
            if not tables:
                return self.open[0], None
            table = self.open[tables[-1]]
            return (table.parent, table) if table.parent is not None else (self.open[tables[-1] - 1], None)
        return at, None

    def _place(self, node: Node) -> Node:
        parent, before = self._target()
        parent.take(node, before)
        return node

    def _text(self, data: str) -> None:
        if not data or not self.open:
            return
        parent, before = self._target()
        at = parent.children.index(before) if before is not None else len(parent.children)
        if at and parent.children[at - 1].name == "#text":
            parent.children[at - 1].text += data
            return
        node = Node("#text", text=data)
        self.created.append(node)
        parent.take(node, before)

    def _insert(self, tag: str, attrs: dict[str, str] | None = None, kind: str = "html") -> Node:
        node = Node(tag, kind, attrs)
        self.created.append(node)
        if self.open:
            self._place(node)
        else:
            self.document.take(node)
        self.open.append(node)
        return node

    def _insert_void(self, tag: str, attrs: dict[str, str]) -> None:
        self._insert(tag, attrs)
        self.open.pop()

    def _insert_raw(self, tag: str, attrs: dict[str, str]) -> None:
        self._insert(tag, attrs)
        self.back, self.mode = self.mode, "text"

    # The stack

    def _in_scope(self, names: str | frozenset[str] | Node, more: tuple[str, ...] = (), only: frozenset[str] | None = None) -> bool:
        for node in reversed(self.open):
            if node is names or (node.kind == "html" and (node.name == names or isinstance(names, frozenset) and node.name in names)):
                return True
            if only is not None:
                if node.name not in only:
                    return False
            elif (node.kind == "html" and (node.name in SCOPE or node.name in more)) or (node.kind, node.name) in FOREIGN_SCOPE:
                return False
        return False

    def _in_table_scope(self, names: str | frozenset[str]) -> bool:
        for node in reversed(self.open):
            if node.name == names or isinstance(names, frozenset) and node.name in names:
                return True
            if node.name in ("html", "table", "template"):
                return False
        return False

    def _imply_ends(self, but: str = "") -> None:
        while self.open[-1].name in IMPLIED and self.open[-1].name != but:
            self.open.pop()

    def _pop_to(self, names: str | frozenset[str]) -> None:
        """Pop up to and with the first element of a name."""
        while len(self.open) > 1:
            node = self.open.pop()
            if node.kind == "html" and (node.name == names or isinstance(names, frozenset) and node.name in names):
                return

    def _close_p(self) -> None:
        if self._in_scope("p", ("button",)):
            self._imply_ends("p")
            self._pop_to("p")

    def _back_to(self, *names: str) -> None:
        while self.open[-1].name not in (*names, "template", "html"):
            self.open.pop()

    def _reset(self) -> None:
        """The insertion mode that the open elements call for."""
        for node in reversed(self.open):
            mode = {"select": "in_select", "td": "in_cell", "th": "in_cell", "tr": "in_row", "tbody": "in_table_body", "thead": "in_table_body", "tfoot": "in_table_body", "caption": "in_caption", "colgroup": "in_column_group", "table": "in_table", "head": "in_head", "body": "in_body", "frameset": "in_frameset"}.get(node.name)
            if node.name == "template":
                mode = self.templates[-1]
            elif node.name in ("td", "th") and node is self.open[0]:
                mode = None
            elif node.name == "select" and any(n.name == "table" for n in self.open):
                mode = "in_select_in_table"
            elif node.name == "html":
                mode = "before_head" if self.head is None else "after_head"
            if mode:
                self.mode = mode
                return
        self.mode = "in_body"

    # Formatting

    def _remember(self, node: Node) -> None:
        same = 0
        for other in reversed(self.formatting):
            if other is None:
                break
            if (other.name, other.kind, other.attrs) == (node.name, node.kind, node.attrs):
                same += 1
                first = other
        if same >= 3:
            self.formatting.remove(first)
        self.formatting.append(node)

    def _reconstruct(self) -> None:
        """Open again the formatting elements that were closed by others."""
        if not self.formatting or self.formatting[-1] is None or self.formatting[-1] in self.open:
            return
        i = len(self.formatting) - 1
        while i and self.formatting[i - 1] is not None and self.formatting[i - 1] not in self.open:
            i -= 1
        for k in range(i, len(self.formatting)):
            old = self.formatting[k]
            self.formatting[k] = self._insert(old.name, dict(old.attrs))

    def _to_marker(self) -> None:
        while self.formatting and self.formatting.pop() is not None:
            pass

    def _since_marker(self, tag: str) -> Node | None:
        for node in reversed(self.formatting):
            if node is None:
                return None
            if node.name == tag:
                return node
        return None

    def _adopt(self, tag: str) -> None:
        """Close a formatting element whose end comes after the start of others: blocks opened in it keep its formatting by a copy of their own."""
        if self.open[-1].name == tag and self.open[-1] not in self.formatting:
            self.open.pop()
            return
        for _ in range(8):
            made = self._since_marker(tag)
            if made is None:
                self._end_other(tag)
                return
            if made not in self.open:
                self.formatting.remove(made)
                return
            if not self._in_scope(made):
                return
            at = self.open.index(made)
            block = next((n for n in self.open[at + 1 :] if n.kind == "html" and n.name in SPECIAL or (n.kind, n.name) in FOREIGN_SCOPE), None)
            if block is None:
                del self.open[at:]
                self.formatting.remove(made)
                return
            above, mark = self.open[at - 1], self.formatting.index(made)
            last, place, inner = block, self.open.index(block), 0
            while True:
                inner += 1
                place -= 1
                node = self.open[place]
                if node is made:
                    break
                if inner > 3 and node in self.formatting:
                    if self.formatting.index(node) < mark:
                        mark -= 1
                    self.formatting.remove(node)
                if node not in self.formatting:
                    del self.open[place]
                    continue
                copy = Node(node.name, node.kind, dict(node.attrs))
                self.created.append(copy)
                self.formatting[self.formatting.index(node)] = copy
                self.open[place] = copy
                if last is block:
                    mark = self.formatting.index(copy) + 1
                copy.take(last)
                last = copy
            self._adopted_place(above, last)
            copy = Node(made.name, made.kind, dict(made.attrs))
            self.created.append(copy)
            for child in list(block.children):
                copy.take(child)
            block.take(copy)
            old = self.formatting.index(made)
            self.formatting.remove(made)
            self.formatting.insert(mark - (old < mark), copy)
            self.open.remove(made)
            self.open.insert(self.open.index(block) + 1, copy)

    def _adopted_place(self, above: Node, node: Node) -> None:
        if above.name in ("table", "tbody", "tfoot", "thead", "tr"):
            kept, self.foster = self.foster, True
            open_ = self.open
            self.open = open_[: open_.index(above) + 1]
            try:
                self._place(node)
            finally:
                self.open, self.foster = open_, kept
        else:
            above.take(node)

    # Tokens

    def _imply(self) -> None:
        """The next step that any other token calls for before the body."""
        if self.mode == "initial":
            self.mode = "before_html"
        elif self.mode == "before_html":
            self._insert("html")
            self.mode = "before_head"
        elif self.mode == "before_head":
            self.head = self._insert("head")
            self.mode = "in_head"
        elif self.mode == "in_head":
            self._pop_to("head")
            self.mode = "after_head"
        elif self.mode == "after_head":
            self._insert("body")
            self.mode = "in_body"

    def _flush(self) -> None:
        """The text gathered in a table: blank text stays there, other text goes before the table."""
        if not self.pending:
            return
        text, self.pending = "".join(self.pending), []
        if text.strip(SPACE):
            self.foster = True
            self._body_chars(text)
            self.foster = False
        else:
            self._text(text)

    def chars(self, data: str) -> None:
        data = data.replace("\0", "")
        if not data:
            return
        mode = self.mode
        if mode in ("initial", "before_html", "before_head"):
            data = data.lstrip(SPACE)
            if data:
                self._imply()
                self.chars(data)
        elif mode in ("in_head", "after_head"):
            rest = data.lstrip(SPACE)
            self._text(data[: len(data) - len(rest)])
            if rest:
                self._imply()
                self.chars(rest)
        elif mode in ("in_table", "in_table_body", "in_row") and self.open[-1].kind == "html":
            if self.open[-1].name in ("table", "tbody", "template", "tfoot", "thead", "tr"):
                self.pending.append(data)
            else:
                self._body_chars(data)
        elif mode == "in_column_group":
            rest = data.lstrip(SPACE)
            self._text(data[: len(data) - len(rest)])
            if rest and self.open[-1].name == "colgroup":
                self.open.pop()
                self.mode = "in_table"
                self.chars(rest)
        elif mode in ("after_body", "after_after_body"):
            if data.strip(SPACE):
                self.mode = "in_body"
                self._body_chars(data)
            else:
                self._body_chars(data)
        elif mode in ("in_frameset", "after_frameset", "after_after_frameset"):
            self._text("".join(c for c in data if c in SPACE))
        elif mode in ("in_select", "in_select_in_table"):
            self._text(data)
        else:
            self._body_chars(data)

    def _body_chars(self, data: str) -> None:
        if self.open[-1].kind == "html":
            self._reconstruct()
        self._text(data)
        if data.strip(SPACE):
            self.frames_ok = False

    def _foreign(self) -> bool:
        """Whether a start tag now is one of foreign content."""
        at = self.open[-1] if self.open else None
        return at is not None and at.kind != "html" and (at.kind, at.name) not in {("svg", "foreignObject"), ("svg", "desc"), ("svg", "title")} and not (at.kind == "math" and at.name in ("mi", "mo", "mn", "ms", "mtext"))

    def start(self, tag: str, attrs: dict[str, str], closed: bool = False) -> None:
        if self._foreign():
            if tag in BREAKOUT or tag == "font" and {"color", "face", "size"} & attrs.keys():
                while self.open[-1].kind != "html" and self._foreign():
                    self.open.pop()
            else:
                kind = self.open[-1].kind
                self._insert(SVG_NAMES.get(tag, tag) if kind == "svg" else tag, attrs, kind)
                if closed:
                    self.open.pop()
                return
        getattr(self, f"_start_{self.mode}", self._start_in_body)(tag, attrs, closed)

    def end(self, tag: str) -> None:
        if self.mode == "text":
            self.open.pop()
            self.mode = self.back
        elif self.open and self.open[-1].kind != "html":
            if tag in ("br", "p"):
                while self._foreign():
                    self.open.pop()
                getattr(self, f"_end_{self.mode}", self._end_in_body)(tag)
                return
            for i in range(len(self.open) - 1, 0, -1):
                node = self.open[i]
                if node.kind == "html":
                    getattr(self, f"_end_{self.mode}", self._end_in_body)(tag)
                    return
                if node.name.lower() == tag:
                    del self.open[i:]
                    return
        else:
            getattr(self, f"_end_{self.mode}", self._end_in_body)(tag)

    # Before the body

    def _start_initial(self, tag, attrs, closed) -> None:
        self._imply()
        self.start(tag, attrs, closed)

    def _start_before_html(self, tag, attrs, closed) -> None:
        if tag == "html":
            self._insert(tag, attrs)
            self.mode = "before_head"
        else:
            self._start_initial(tag, attrs, closed)

    def _start_before_head(self, tag, attrs, closed) -> None:
        if tag == "html":
            self._start_in_body(tag, attrs, closed)
        elif tag == "head":
            self.head = self._insert(tag, attrs)
            self.mode = "in_head"
        else:
            self._start_initial(tag, attrs, closed)

    def _end_before(self, tag) -> None:
        if tag in ("head", "body", "html", "br"):
            self._imply()
            self.end(tag)

    _end_initial = _end_before_html = _end_before_head = _end_before

    def _start_in_head(self, tag, attrs, closed) -> None:
        if tag == "html":
            self._start_in_body(tag, attrs, closed)
        elif tag in ("base", "basefont", "bgsound", "link", "meta"):
            self._insert_void(tag, attrs)
        elif tag in ("title", "noscript", "noframes", "style", "script"):
            self._insert_raw(tag, attrs)
        elif tag == "template":
            self._insert(tag, attrs)
            self.formatting.append(None)
            self.frames_ok, self.mode = False, "in_template"
            self.templates.append("in_template")
        elif tag != "head":
            self._start_initial(tag, attrs, closed)

    def _end_in_head(self, tag) -> None:
        if tag == "head":
            self._imply()
        elif tag == "template":
            if any(n.name == "template" for n in self.open):
                while self.open[-1].name in IMPLIED | TABLE_PARTS - {"template"}:
                    self.open.pop()
                self._pop_to("template")
                self._to_marker()
                self.templates.pop()
                self._reset()
        elif tag in ("body", "html", "br"):
            self._imply()
            self.end(tag)

    def _start_after_head(self, tag, attrs, closed) -> None:
        if tag == "html":
            self._start_in_body(tag, attrs, closed)
        elif tag == "body":
            self._insert(tag, attrs)
            self.frames_ok, self.mode = False, "in_body"
        elif tag == "frameset":
            self._insert(tag, attrs)
            self.mode = "in_frameset"
        elif tag in IN_HEAD:
            self.open.append(self.head)
            self._start_in_head(tag, attrs, closed)
            self.open.remove(self.head)
        elif tag != "head":
            self._start_initial(tag, attrs, closed)

    def _end_after_head(self, tag) -> None:
        if tag == "template":
            self._end_in_head(tag)
        elif tag in ("body", "html", "br"):
            self._imply()
            self.end(tag)

    # The body

    def _start_in_body(self, tag, attrs, closed=False) -> None:
        if tag == "image":
            tag = "img"
        if tag == "html":
            if not any(n.name == "template" for n in self.open):
                self.open[0].attrs = attrs | self.open[0].attrs
        elif tag in IN_HEAD:
            self._start_in_head(tag, attrs, closed)
        elif tag == "body":
            if len(self.open) > 1 and self.open[1].name == "body" and not any(n.name == "template" for n in self.open):
                self.frames_ok = False
                self.open[1].attrs = attrs | self.open[1].attrs
        elif tag == "frameset":
            if self.frames_ok and len(self.open) > 1 and self.open[1].name == "body":
                self.open[1].leave()
                del self.open[1:]
                self._insert(tag, attrs)
                self.mode = "in_frameset"
        elif tag in BLOCKS or tag in ("pre", "listing", "plaintext"):
            self._close_p()
            self._insert(tag, attrs)
            self.frames_ok &= tag not in ("pre", "listing")
            self.plain = tag == "plaintext"
        elif tag in HEADINGS:
            self._close_p()
            if self.open[-1].name in HEADINGS:
                self.open.pop()
            self._insert(tag, attrs)
        elif tag == "form":
            in_template = any(n.name == "template" for n in self.open)
            if self.form is None or in_template:
                self._close_p()
                node = self._insert(tag, attrs)
                self.form = self.form if in_template else node
        elif tag in ("li", "dd", "dt"):
            self._start_item(tag, attrs)
        elif tag == "button":
            if self._in_scope("button"):
                self._imply_ends()
                self._pop_to("button")
            self._reconstruct()
            self._insert(tag, attrs)
            self.frames_ok = False
        elif tag in FORMATTING:
            self._start_formatting(tag, attrs)
        elif tag in ("applet", "marquee", "object"):
            self._reconstruct()
            self._insert(tag, attrs)
            self.formatting.append(None)
            self.frames_ok = False
        elif tag == "table":
            if not self.quirks:
                self._close_p()
            self._insert(tag, attrs)
            self.frames_ok, self.mode = False, "in_table"
        elif tag in ("area", "br", "embed", "img", "keygen", "wbr", "input"):
            self._reconstruct()
            self._insert_void(tag, attrs)
            self.frames_ok &= tag == "input" and attrs.get("type", "").lower() == "hidden"
        elif tag in ("param", "source", "track"):
            self._insert_void(tag, attrs)
        elif tag == "hr":
            self._close_p()
            self._insert_void(tag, attrs)
            self.frames_ok = False
        elif tag in ("textarea", "iframe", "noembed", "noscript", "xmp"):
            if tag == "xmp":
                self._close_p()
                self._reconstruct()
            self.frames_ok &= tag in ("noembed", "noscript")
            self._insert_raw(tag, attrs)
        elif tag == "select":
            self._reconstruct()
            self._insert(tag, attrs)
            self.frames_ok = False
            self.mode = "in_select_in_table" if self.mode in ("in_table", "in_caption", "in_table_body", "in_row", "in_cell") else "in_select"
        elif tag in ("optgroup", "option"):
            if self.open[-1].name == "option":
                self.open.pop()
            self._reconstruct()
            self._insert(tag, attrs)
        elif tag in ("rb", "rtc", "rp", "rt"):
            if self._in_scope("ruby"):
                self._imply_ends("" if tag in ("rb", "rtc") else "rtc")
            self._insert(tag, attrs)
        elif tag in ("math", "svg"):
            self._reconstruct()
            self._insert(tag, attrs, tag)
            if closed:
                self.open.pop()
        elif tag not in TABLE_PARTS and tag not in ("col", "frame", "head"):
            self._reconstruct()
            self._insert(tag, attrs)

    def _start_item(self, tag, attrs) -> None:
        """A list item ends the one before it, as far as no other block is between."""
        self.frames_ok = False
        ends = ("li",) if tag == "li" else ("dd", "dt")
        for node in reversed(self.open):
            if node.name in ends:
                self._imply_ends(node.name)
                self._pop_to(node.name)
                break
            if node.name in SPECIAL and node.name not in ("address", "div", "p"):
                break
        self._close_p()
        self._insert(tag, attrs)

    def _start_formatting(self, tag, attrs) -> None:
        if tag == "a" and (old := self._since_marker("a")) is not None:
            self._adopt("a")
            if old in self.formatting:
                self.formatting.remove(old)
            if old in self.open:
                self.open.remove(old)
        self._reconstruct()
        if tag == "nobr" and self._in_scope("nobr"):
            self._adopt("nobr")
            self._reconstruct()
        self._remember(self._insert(tag, attrs))

    def _end_in_body(self, tag) -> None:
        if tag == "template":
            self._end_in_head(tag)
        elif tag in ("body", "html"):
            if self._in_scope("body"):
                self.mode = "after_body"
                if tag == "html":
                    self.end(tag)
        elif tag == "p":
            if not self._in_scope("p", ("button",)):
                self._insert("p")
            self._close_p()
        elif tag == "form" and not any(n.name == "template" for n in self.open):
            node, self.form = self.form, None
            if node is not None and self._in_scope(node):
                self._imply_ends()
                self.open.remove(node)
        elif tag in BLOCKS or tag in ("button", "listing", "pre", "form"):
            if self._in_scope(tag):
                self._imply_ends()
                self._pop_to(tag)
        elif tag in ("li", "dd", "dt"):
            if self._in_scope(tag, ("ol", "ul") if tag == "li" else ()):
                self._imply_ends(tag)
                self._pop_to(tag)
        elif tag in HEADINGS:
            if self._in_scope(HEADINGS):
                self._imply_ends()
                self._pop_to(HEADINGS)
        elif tag in FORMATTING:
            self._adopt(tag)
        elif tag in ("applet", "marquee", "object"):
            if self._in_scope(tag):
                self._imply_ends()
                self._pop_to(tag)
                self._to_marker()
        elif tag == "br":
            self._start_in_body("br", {})
        else:
            self._end_other(tag)

    def _end_other(self, tag) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            node = self.open[i]
            if node.kind == "html" and node.name == tag:
                self._imply_ends(tag)
                del self.open[i:]
                return
            if node.kind == "html" and node.name in SPECIAL:
                return

    # Tables

    def _fostered(self, use, *token) -> None:
        """What a table may not hold goes before it."""
        self.foster = True
        try:
            use(*token)
        finally:
            self.foster = False

    def _start_in_table(self, tag, attrs, closed) -> None:
        if tag == "caption":
            self._back_to("table")
            self.formatting.append(None)
            self._insert(tag, attrs)
            self.mode = "in_caption"
        elif tag in ("colgroup", "col"):
            self._back_to("table")
            self._insert("colgroup", attrs if tag == "colgroup" else {})
            self.mode = "in_column_group"
            if tag == "col":
                self.start(tag, attrs, closed)
        elif tag in ("tbody", "tfoot", "thead", "td", "th", "tr"):
            self._back_to("table")
            own = tag in ("tbody", "tfoot", "thead")
            self._insert(tag if own else "tbody", attrs if own else {})
            self.mode = "in_table_body"
            if not own:
                self.start(tag, attrs, closed)
        elif tag == "table":
            if self._in_table_scope("table"):
                self._pop_to("table")
                self._reset()
                self.start(tag, attrs, closed)
        elif tag in ("style", "script", "template"):
            self._start_in_head(tag, attrs, closed)
        elif tag == "input" and attrs.get("type", "").lower() == "hidden":
            self._insert_void(tag, attrs)
        elif tag == "form":
            if self.form is None and not any(n.name == "template" for n in self.open):
                self.form = self._insert(tag, attrs)
                self.open.pop()
        else:
            self._fostered(self._start_in_body, tag, attrs, closed)

    def _end_in_table(self, tag) -> None:
        if tag == "table":
            if self._in_table_scope("table"):
                self._pop_to("table")
                self._reset()
        elif tag == "template":
            self._end_in_head(tag)
        elif tag not in ("body", "col", "html") and tag not in TABLE_PARTS:
            self._fostered(self._end_in_body, tag)

    def _leave_caption(self) -> bool:
        if not self._in_table_scope("caption"):
            return False
        self._imply_ends()
        self._pop_to("caption")
        self._to_marker()
        self.mode = "in_table"
        return True

    def _start_in_caption(self, tag, attrs, closed) -> None:
        if tag in TABLE_PARTS or tag in ("col", "table"):
            if self._leave_caption():
                self.start(tag, attrs, closed)
        else:
            self._start_in_body(tag, attrs, closed)

    def _end_in_caption(self, tag) -> None:
        if tag == "caption":
            self._leave_caption()
        elif tag == "table":
            if self._leave_caption():
                self.end(tag)
        elif tag not in ("body", "col", "html") and tag not in TABLE_PARTS:
            self._end_in_body(tag)

    def _start_in_column_group(self, tag, attrs, closed) -> None:
        if tag == "html":
            self._start_in_body(tag, attrs, closed)
        elif tag == "col":
            self._insert_void(tag, attrs)
        elif tag == "template":
            self._start_in_head(tag, attrs, closed)
        elif self.open[-1].name == "colgroup":
            self.open.pop()
            self.mode = "in_table"
            self.start(tag, attrs, closed)

    def _end_in_column_group(self, tag) -> None:
        if tag == "template":
            self._end_in_head(tag)
        elif tag != "col" and self.open[-1].name == "colgroup":
            self.open.pop()
            self.mode = "in_table"
            if tag != "colgroup":
                self.end(tag)

    def _leave_body(self) -> bool:
        if not self._in_table_scope(frozenset(("tbody", "thead", "tfoot"))):
            return False
        self._back_to("tbody", "tfoot", "thead")
        self.open.pop()
        self.mode = "in_table"
        return True

    def _start_in_table_body(self, tag, attrs, closed) -> None:
        if tag in ("tr", "td", "th"):
            self._back_to("tbody", "tfoot", "thead")
            self._insert("tr", attrs if tag == "tr" else {})
            self.mode = "in_row"
            if tag != "tr":
                self.start(tag, attrs, closed)
        elif tag in ("caption", "col", "colgroup", "tbody", "tfoot", "thead"):
            if self._leave_body():
                self.start(tag, attrs, closed)
        else:
            self._start_in_table(tag, attrs, closed)

    def _end_in_table_body(self, tag) -> None:
        if tag in ("tbody", "tfoot", "thead"):
            if self._in_table_scope(tag):
                self._leave_body()
        elif tag == "table":
            if self._leave_body():
                self.end(tag)
        elif tag not in ("body", "caption", "col", "colgroup", "html", "td", "th", "tr"):
            self._end_in_table(tag)

    def _leave_row(self) -> bool:
        if not self._in_table_scope("tr"):
            return False
        self._back_to("tr")
        self.open.pop()
        self.mode = "in_table_body"
        return True

    def _start_in_row(self, tag, attrs, closed) -> None:
        if tag in ("td", "th"):
            self._back_to("tr")
            self._insert(tag, attrs)
            self.formatting.append(None)
            self.mode = "in_cell"
        elif tag in ("caption", "col", "colgroup", "tbody", "tfoot", "thead", "tr"):
            if self._leave_row():
                self.start(tag, attrs, closed)
        else:
            self._start_in_table(tag, attrs, closed)

    def _end_in_row(self, tag) -> None:
        if tag == "tr":
            self._leave_row()
        elif tag == "table" or tag in ("tbody", "tfoot", "thead") and self._in_table_scope(tag):
            if self._leave_row():
                self.end(tag)
        elif tag not in ("body", "caption", "col", "colgroup", "html", "td", "th", "tbody", "tfoot", "thead"):
            self._end_in_table(tag)

    def _leave_cell(self) -> None:
        self._imply_ends()
        self._pop_to(frozenset(("td", "th")))
        self._to_marker()
        self.mode = "in_row"

    def _start_in_cell(self, tag, attrs, closed) -> None:
        if tag in TABLE_PARTS or tag == "col":
            if self._in_table_scope(frozenset(("td", "th"))):
                self._leave_cell()
                self.start(tag, attrs, closed)
        else:
            self._start_in_body(tag, attrs, closed)

    def _end_in_cell(self, tag) -> None:
        if tag in ("td", "th"):
            if self._in_table_scope(tag):
                self._imply_ends()
                self._pop_to(tag)
                self._to_marker()
                self.mode = "in_row"
        elif tag in ("table", "tbody", "tfoot", "thead", "tr"):
            if self._in_table_scope(tag):
                self._leave_cell()
                self.end(tag)
        elif tag not in ("body", "caption", "col", "colgroup", "html"):
            self._end_in_body(tag)

    # Selects, templates, frames, the end

    def _start_in_select(self, tag, attrs, closed) -> None:
        if tag == "html":
            self._start_in_body(tag, attrs, closed)
        elif tag in ("option", "optgroup", "hr"):
            if self.open[-1].name == "option":
                self.open.pop()
            if tag != "option" and self.open[-1].name == "optgroup":
                self.open.pop()
            self._insert(tag, attrs)
            if tag == "hr":
                self.open.pop()
        elif tag in ("select", "input", "keygen", "textarea"):
            if self._in_select_scope():
                self._pop_to("select")
                self._reset()
                if tag != "select":
                    self.start(tag, attrs, closed)
        elif tag in ("script", "template"):
            self._start_in_head(tag, attrs, closed)

    def _in_select_scope(self) -> bool:
        return self._in_scope("select", only=frozenset(("optgroup", "option", "select")))

    def _end_in_select(self, tag) -> None:
        if tag == "optgroup":
            if self.open[-1].name == "option" and self.open[-2].name == "optgroup":
                self.open.pop()
            if self.open[-1].name == "optgroup":
                self.open.pop()
        elif tag == "option":
            if self.open[-1].name == "option":
                self.open.pop()
        elif tag == "select":
            if self._in_select_scope():
                self._pop_to("select")
                self._reset()
        elif tag == "template":
            self._end_in_head(tag)

    def _start_in_select_in_table(self, tag, attrs, closed) -> None:
        if tag in ("caption", "table", "tbody", "tfoot", "thead", "tr", "td", "th"):
            self._pop_to("select")
            self._reset()
            self.start(tag, attrs, closed)
        else:
            self._start_in_select(tag, attrs, closed)

    def _end_in_select_in_table(self, tag) -> None:
        if tag in ("caption", "table", "tbody", "tfoot", "thead", "tr", "td", "th"):
            if self._in_table_scope(tag):
                self._pop_to("select")
                self._reset()
                self.end(tag)
        else:
            self._end_in_select(tag)

    def _start_in_template(self, tag, attrs, closed) -> None:
        if tag in IN_HEAD:
            self._start_in_head(tag, attrs, closed)
            return
        mode = {"caption": "in_table", "colgroup": "in_table", "tbody": "in_table", "tfoot": "in_table", "thead": "in_table", "col": "in_column_group", "tr": "in_table_body", "td": "in_row", "th": "in_row"}.get(tag, "in_body")
        self.templates[-1] = self.mode = mode
        self.start(tag, attrs, closed)

    def _end_in_template(self, tag) -> None:
        if tag == "template":
            self._end_in_head(tag)

    def _start_after_body(self, tag, attrs, closed) -> None:
        if tag == "html":
            self._start_in_body(tag, attrs, closed)
        else:
            self.mode = "in_body"
            self.start(tag, attrs, closed)

    _start_after_after_body = _start_after_body

    def _end_after_body(self, tag) -> None:
        if tag == "html":
            self.mode = "after_after_body"
        else:
            self.mode = "in_body"
            self.end(tag)

    def _end_after_after_body(self, tag) -> None:
        self.mode = "in_body"
        self.end(tag)

    def _start_in_frameset(self, tag, attrs, closed) -> None:
        if tag == "frameset":
            self._insert(tag, attrs)
        elif tag == "frame":
            self._insert_void(tag, attrs)
        elif tag == "noframes":
            self._start_in_head(tag, attrs, closed)
        elif tag == "html":
            self._start_in_body(tag, attrs, closed)

    def _end_in_frameset(self, tag) -> None:
        if tag == "frameset" and len(self.open) > 1:
            self.open.pop()
            if self.open[-1].name != "frameset":
                self.mode = "after_frameset"

    def _start_after_frameset(self, tag, attrs, closed) -> None:
        if tag == "noframes":
            self._start_in_head(tag, attrs, closed)
        elif tag == "html":
            self._start_in_body(tag, attrs, closed)

    _start_after_after_frameset = _start_after_frameset

    def _end_after_frameset(self, tag) -> None:
        if tag == "html":
            self.mode = "after_after_frameset"

    def _end_after_after_frameset(self, tag) -> None:
        pass


def parse(markup: str) -> Builder:
    """The finished builder of a document."""
    builder = Builder()
    builder.feed(markup)
    builder.close()
    return builder
