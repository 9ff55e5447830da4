"""HTML into flat node tables: one row per element or run of text, in page order."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noframes xmp iframe".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - frozenset("body dd dt head html legend li noscript option select tbody td tfoot th thead title tr".split())
#: What an opening tag closes: the tags, and the tags past which it does not look.
CLOSED_BY = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
}
WALLS = frozenset("html body table td th ul ol dl article aside div section main nav footer header form blockquote".split())
TEXT = "#text"

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")


@dataclass
class Page:
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)  # class, id and role, as written
    text: list[str] = field(default_factory=list)  # of text rows, undecoded
    block: list[int] = field(default_factory=list)  # texts of one block share its number
    breaks: set[int] = field(default_factory=set)  # texts that a line break parts from what is before

    def add(self, parent: int, tag: str, attributes: str = "", text: str = "", block: int = 0) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tag.append(tag)
        self.attributes.append(attributes)
        self.text.append(text)
        self.block.append(block)
        return len(self.tag) - 1


def parse(html: str | None) -> Page:
    """Row 0 is the page itself. Unclosed and stray tags are forgiven as browsers do, but formatting is not reopened."""
    page = Page()
    page.add(-1, "#page")
    stack, block, at, broken = [0], 0, 0, False
    html = html or ""
    n = len(html)
    while at < n:
        m = MARKUP.search(html, at)
        start = m.start() if m else n
        if start > at:
            run = html[at:start]
            if broken:
                page.breaks.add(len(page.tag))
                broken = False
            if not run.isspace() or page.tag[-1] == TEXT:
                page.add(stack[-1], TEXT, text=run, block=block)
            elif page.tag[stack[-1]] not in ("ul", "ol", "table", "tr"):
                page.add(stack[-1], TEXT, text=run, block=block)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in BLOCK:
                block += 1
            for k in range(len(stack) - 1, 0, -1):
                if page.tag[stack[k]] == tag:
                    del stack[k:]
                    break
                if tag not in BLOCK and page.tag[stack[k]] in WALLS:
                    break
            continue
        if tag in BLOCK:
            block += 1
        if tag == "br":
            broken = True
        if tag in CLOSES_P:
            close(page, stack, frozenset(["p"]), WALLS)
        if tag in CLOSED_BY:
            close(page, stack, *CLOSED_BY[tag])
        attributes = m[3] or m[6] or ""
        names = " ".join(a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(attributes)) if "=" in attributes else ""
        row = page.add(stack[-1], tag, names)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            stop = end.start() if end else n
            page.add(row, TEXT, text=html[at:stop], block=block)
            closing = html.find(">", stop)
            at = n if closing < 0 else closing + 1
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(row)
    return page


def close(page: Page, stack: list[int], tags: frozenset, walls: frozenset) -> None:
    for k in range(len(stack) - 1, 0, -1):
        tag = page.tag[stack[k]]
        if tag in tags:
            del stack[k:]
            return
        if tag in walls:
            return


def tokens(attributes: str) -> list[str]:
    """Words of class, id and role names; camelCase and digits are cut."""
    return WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", attributes).lower()) if attributes else []
