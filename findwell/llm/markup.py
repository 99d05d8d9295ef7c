"""Problem 5: clean text and structure from HTML, Markdown, wiki text, LaTeX and plain text.

Each text is read once as a stream of parser events; html.parser gives them for HTML, small line
readers for the others. The events build blocks: headings, list items, code, formulas and running
text, each with what a reader sees: inline markup and markers gone, links as their label,
entities and escapes as the character. To select what belongs to the content, every line gets the
ratio of its text to its tags; the ratios are smoothed with a Gaussian and clustered around a
threshold, and blocks on lines of the lower cluster are left out of the clean text.

Null and empty texts have no blocks. Every run of white space in a block is one blank. Markup
without an end runs to the end of the text where its language says so (a fence, a pre), else it is
text. What stands in comments, scripts or code is nothing but that. Whole texts of any length are
read.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findwell.llm.arrow import list_array, slices
from findwell.operators.state import current_contents

KINDS = ("heading", "list_item", "code", "formula")
Block = tuple[str, str, int] | tuple[str, str, int, int]  # kind, text, line, and of running text the last line

_SPACE = re.compile(r"[\s\xa0]+")


_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);")


def unescape(text: str) -> str:
    """Entities with their semicolon as the character; ``R&D`` and ``&copy`` stay."""
    return _ENTITY.sub(lambda m: html.unescape(m[0]), text)


def tidy(text: str) -> str:
    """One blank for every run of white space, none at the ends."""
    return _SPACE.sub(" ", text).strip()


# --- which markup a text uses ------------------------------------------------------------------

_SIGNS = {
    "html": re.compile(r"</?(?:html|body|p|div|h[1-6]|ul|ol|li|table|span|a|b|em|strong)\b[^<>]*>", re.I),
    "latex": re.compile(r"\\(?:documentclass|begin\{|end\{|(?:sub)*section\b|chapter\b|emph\{|text(?:bf|tt|it)\{|href\{|item\b|underline\{)"),
    "wiki": re.compile(r"^(={2,6})(?!=)[^\n]*[^=\s][ \t]*\1[ \t]*$|'''|\[\[|<ref\b|\{\{|^\{\||<math>|<(?:syntaxhighlight|source)\b|\[https?://\S+ |^\*(?![* \n])[^*\n]*$|^\*\*+[^*\n]+$|^#+ ?[^\n]*\n#+ ?[^#\n]", re.M),
    "markdown": re.compile(r"^(?:`{3,}|~{3,})|\*\*[^*\n]+\*\*|\]\([^()\n]*\)|^[^\n]*\S\n(?:={3,}|-{3,})[ \t]*$|^#{1,6} [^\n]*\n(?:\n|\Z)|(?<!\w)__\w|~~|^> |^[-+] |^\d+\. |`[^`\n]+`|^    \S", re.M),
}


_ELEMENT_TAG = re.compile(r"<(/?)(?:html|body|head|div|p|h[1-6]|ul|ol|li|table|tr|td|th|thead|tbody|section|article|header|footer|nav|main|blockquote|pre|dl|dt|dd|form|figure|script|style)\b[^<>]*>", re.I)
_MARKDOWN_BLOCK = re.compile(r"^(?:#{1,6} +\S|[-*+] +\S|\d+\. +\S|`{3,}|~{3,})", re.M)


def _between_elements(text: str) -> str:
    """What stands outside of all HTML block elements."""
    parts, depth, at = [], 0, 0
    for m in _ELEMENT_TAG.finditer(text):
        if not depth:
            parts.append(text[at : m.start()])
        depth = max(0, depth + (-1 if m[1] else 1))
        at = m.end()
    return "\n".join(parts) + ("" if depth else text[at:])


def markup_of(text: str) -> str:
    """html, latex, wiki or markdown, by the number of each one's signs; markdown if there are none.

    HTML with Markdown between its elements is Markdown, which may hold HTML elements and whose reader reads them as such.
    """
    counts = {kind: sum(1 for _ in sign.finditer(text)) for kind, sign in _SIGNS.items()}
    if counts["html"] >= 2 * counts["wiki"] and counts["html"] > counts["latex"] and counts["html"] >= counts["markdown"] / 2 and counts["html"]:
        return "markdown" if counts["markdown"] and _MARKDOWN_BLOCK.search(_between_elements(text)) else "html"
    if counts["latex"] > max(counts["wiki"], counts["html"]) and counts["latex"] * 2 >= counts["markdown"]:
        return "latex"
    return "wiki" if counts["wiki"] and counts["wiki"] * 2 > counts["markdown"] else "markdown"


# --- formulas in running text ------------------------------------------------------------------

_FORMULA = re.compile(r"\\\((.+?)\\\)|\\\[(.+?)\\\]|(?<!\\)\$\$(.+?)(?<!\\)\$\$", re.S)
_DOLLARS = re.compile(r"\\\((.+?)\\\)|\\\[(.+?)\\\]|(?<!\\)\$\$(.+?)(?<!\\)\$\$|(?<![\\$])\$(?![\s$])((?:[^$\\]|\\.)*?[^\s\\$]|[^\s\\$])\$(?![\d$])", re.S)


def take_formulas(text: str, line: int, out: list[Block], dollars: bool) -> None:
    """Add the formulas of a stretch of running text; single dollars count only where they delimit."""
    at = 0
    for m in (_DOLLARS if dollars else _FORMULA).finditer(text):
        line, at = line + text.count("\n", at, m.start()), m.start()
        out.append(("formula", tidy(next(g for g in m.groups() if g is not None)), line))


# --- HTML --------------------------------------------------------------------------------------

_HEADINGS = {f"h{i}" for i in range(1, 7)}
_BREAKS = {"p", "div", "table", "tr", "section", "article", "header", "footer", "nav", "main", "blockquote", "hr", "body", "html", "dl", "dt", "dd", "form", "figure"}
_SILENT = {"script", "style", "template", "noscript", "head"}


class _Html(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[list] = []  # [kind, list depth, parts, line]
        self.depth = self.silent = 0
        self.text: list[str] = []
        self.line = self.last = 0  # the first and last line of the text

    def flush(self):
        text = tidy("".join(self.text))
        if text:
            take_formulas("".join(self.text), self.line, self.blocks, False)
            self.blocks.append(("text", text, self.line, self.last))
        self.text, self.line = [], 0

    def shut(self, kind, depth=-1):
        """Close what is open down to the last ``kind`` at ``depth`` or deeper."""
        while any(o[0] == kind and o[1] >= depth for o in self.open):
            name, _, parts, line = self.open.pop()
            text = "".join(parts)
            if name in ("heading", "list_item"):
                take_formulas(text, line, self.blocks, False)
            if tidy(text):
                self.blocks.append((name, tidy(text), line))

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += tag != "head"
        elif self.open and self.open[-1][0] == "code":
            if tag == "br":
                self.handle_data("\n")
        elif tag in _HEADINGS:
            self.flush()
            self.shut("heading")
            self.open.append(["heading", self.depth, [], self.getpos()[0]])
        elif tag in ("ul", "ol"):
            self.flush()
            self.shut("heading")
            self.depth += 1
        elif tag == "li":
            self.flush()
            self.shut("heading")
            self.shut("list_item", self.depth)
            self.open.append(["list_item", self.depth, [], self.getpos()[0]])
        elif tag == "pre":
            self.flush()
            self.open.append(["code", self.depth, [], self.getpos()[0]])
        elif tag == "math":
            self.open.append(["formula", self.depth, [], self.getpos()[0]])
        elif tag in _BREAKS:
            self.flush()
            if not self.depth:
                self.shut("list_item")
                self.shut("heading")
            self.handle_data(" ")
        elif tag in ("br", "td", "th"):
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - (tag != "head"))
        elif tag in _HEADINGS:
            self.shut("heading")
        elif tag == "pre":
            self.shut("code")
        elif tag == "math":
            self.shut("formula")
        elif self.open and self.open[-1][0] == "code":
            pass
        elif tag == "li":
            self.shut("list_item", self.depth)
        elif tag in ("ul", "ol"):
            self.shut("list_item", self.depth)
            self.depth = max(0, self.depth - 1)
        elif tag in _BREAKS:
            self.flush()
            self.handle_data(" ")

    def handle_data(self, data):
        if not self.silent:
            (self.open[-1][2] if self.open else self.text).append(data)
            if not self.open and data.strip():
                at = self.getpos()[0]
                self.line = self.line or at + data[: len(data) - len(data.lstrip())].count("\n")
                self.last = at + data.rstrip().count("\n")


def read_html(text: str) -> list[Block]:
    parser = _Html()
    parser.feed(re.sub(r"<[/!]?[A-Za-z][^<>]*\Z", "", text))  # a tag cut off at the end shows nothing
    parser.close()
    parser.flush()
    while parser.open:
        parser.shut(parser.open[-1][0])
    return parser.blocks


# --- Markdown ----------------------------------------------------------------------------------

_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
_RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_ITEM = re.compile(r"([ \t]*)(?:[-*+]|\d{1,9}[.)])(?:[ \t]+(.*)|$)")
_DEFINITION = re.compile(r" {0,3}\[[^\]]+\]:\s*\S+")
_SPAN = re.compile(r"(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
_ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")
_INLINE = [
    (re.compile(r"!\[([^\]]*)\]\([^()]*(?:\([^()]*\)[^()]*)*\)"), r"\1"),
    (re.compile(r"\[([^\[\]]*)\]\([^()]*(?:\([^()]*\)[^()]*)*\)"), r"\1"),
    (re.compile(r"\[([^\[\]]+)\]\[[^\[\]]*\]"), r"\1"),
    (re.compile(r"<((?:https?|mailto):[^>\s]+)>"), r"\1"),
    (re.compile(r"</?[A-Za-z][^<>]*>"), ""),
    (re.compile(r"\*\*\*(?=\S)(.+?)(?<=\S)\*\*\*", re.S), r"\1"),
    (re.compile(r"\*\*(?=\S)(.+?)(?<=\S)\*\*", re.S), r"\1"),
    (re.compile(r"(?<![\w_])__(?=\S)(.+?)(?<=\S)__(?![\w_])", re.S), r"\1"),
    (re.compile(r"\*(?=[^\s*])([^*]*?)(?<=[^\s*])\*", re.S), r"\1"),
    (re.compile(r"(?<![\w_])_(?=[^\s_])(.+?)(?<=[^\s_])_(?![\w_])", re.S), r"\1"),
    (re.compile(r"~~(?=\S)(.+?)(?<=\S)~~", re.S), r"\1"),
]


def markdown_inline(text: str) -> str:
    """What a reader sees of a stretch of Markdown. Code spans and escaped characters stay as they are."""
    kept: list[str] = []

    def keep(s: str) -> str:
        kept.append(s)
        return f"\ue000{len(kept) - 1}\ue001"

    text = text.replace("\ue000", "").replace("\ue001", "")
    text = _SPAN.sub(lambda m: keep(m[2].strip() if m[2].strip() else m[2]), text)
    text = _DOLLARS.sub(lambda m: keep(next(g for g in m.groups() if g is not None)), text)
    text = _ESCAPED.sub(lambda m: keep(m[1]), text)
    for pattern, by in _INLINE:
        text = pattern.sub(by, text)
    text = unescape(text)
    while "\ue000" in text:
        text = re.sub("\ue000(\\d+)\ue001", lambda m: kept[int(m[1])], text)
    return tidy(text)


def _without_spans(text: str) -> str:
    return _SPAN.sub(lambda m: " " * len(m[0]), text)


def _drop_comments(lines: list[str], at: int) -> None:
    """Blank out all comments that begin in a line, to their ends or the end of the text."""
    kept, begin, here = [], 0, at
    while (a := lines[here].find("<!--", begin)) >= 0:
        kept.append(lines[here][begin:a])
        stop, begin = here, lines[here].find("-->", a)
        while begin < 0 and stop + 1 < len(lines):
            stop += 1
            begin = lines[stop].find("-->")
        if stop > here:
            lines[here] = "".join(kept)
            lines[here + 1 : stop] = [""] * (stop - here - 1)
            lines[stop] = lines[stop][begin + 3 :] if begin >= 0 else ""
            return
        if begin < 0:
            lines[here] = "".join(kept)
            return
        begin += 3
    lines[here] = "".join(kept) + lines[here][begin:]


_HTML_BLOCK = re.compile(r" {0,3}<(h[1-6]|ul|ol|pre|dl|table)\b[^<>]*>", re.I)


def _html_block(lines: list[str], at: int) -> int:
    """The line behind the HTML element that begins in a line: where it is closed, else the next empty line."""
    name, depth, empty = _HTML_BLOCK.match(lines[at])[1], 0, None
    tag = re.compile(rf"<(/?){name}\b[^<>]*>", re.I)
    for i in range(at, len(lines)):
        if empty is None and not lines[i].strip():
            empty = i
        for m in tag.finditer(lines[i]):
            depth += -1 if m[1] else 1
            if depth <= 0:
                return i + 1
        if empty is not None and i - empty > 1000:  # far behind: it isn't closed
            break
    return empty if empty is not None else len(lines)


def read_markdown(text: str, first: int = 1) -> list[Block]:
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    out: list[Block] = []
    para: list[str] = []
    kind, start, i = "text", 0, 0

    def end():
        nonlocal para, kind
        if para:
            body = "\n".join(para)
            take_formulas(_without_spans(body), first + start, out, True)
            out.append((kind, markdown_inline(body), first + start, first + start + len(para) - 1))
        para, kind = [], "text"

    listing = False
    while i < len(lines):
        line = lines[i]
        at, i = i, i + 1
        if not line.strip():
            end()
            continue
        if "<!--" in line and not line.startswith("    "):
            _drop_comments(lines, at)
            i = at
            continue
        if _HTML_BLOCK.match(line):  # allowed in Markdown: read as what it is
            end()
            i, listing = _html_block(lines, at), False
            out += [(b[0], b[1], *[n + first + at - 1 for n in b[2:]]) for b in read_html("\n".join(lines[at:i]))]
            continue
        indent = len(line) - len(line.lstrip(" \t")) + 3 * line[: len(line) - len(line.lstrip())].count("\t")
        item = _ITEM.match(line)
        if item and (indent < 4 or (listing and para)) and not _RULE.match(line):
            end()
            kind, para, start, listing = "list_item", [item[2] or ""], at, True
            continue
        if indent >= 4 and not para:
            code = [line]
            while i < len(lines) and (lines[i].startswith(("    ", "\t")) or not lines[i].strip()):
                code.append(lines[i])
                i += 1
            out.append(("code", tidy("\n".join(code)), first + at))
            listing = False
            continue
        if fence := _FENCE.match(line):
            end()
            code, close = [], re.compile(rf" {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}[ \t]*$")
            while i < len(lines) and not close.match(lines[i]):
                code.append(lines[i])
                i += 1
            i += 1
            if body := tidy("\n".join(code)):
                out.append(("code", body, first + at))
            listing = False
            continue
        if line.lstrip().startswith("$$") and not para:
            stop = at
            while stop < len(lines) and lines[stop]:  # no formula goes over an empty line
                stop += 1
            body = "\n".join(lines[at:stop])
            a = body.index("$$")
            b = body.find("$$", a + 2)
            if b > 0:
                out.append(("formula", tidy(body[a + 2 : b]), first + at))
                i = at + body.count("\n", 0, b) + 1
                if rest := body[b + 2 :].split("\n", 1)[0].strip():
                    start, para = i - 1, [rest]
                continue
        if (atx := _ATX.match(line)) and indent < 4:
            end()
            if title := markdown_inline(atx[2] or ""):
                take_formulas(_without_spans(atx[2]), first + at, out, True)
                out.append(("heading", title, first + at))
            listing = False
            continue
        if para and kind == "text" and _SETEXT.match(line):
            kind = "heading"
            end()
            continue
        if _RULE.match(line):
            end()
            listing = False
            continue
        if line.lstrip().startswith(">") and indent < 4:
            end()
            quote = [line]
            while i < len(lines) and lines[i].lstrip().startswith(">"):
                quote.append(lines[i])
                i += 1
            out += read_markdown("\n".join(re.sub(r"^\s*> ?", "", q) for q in quote), first + at)
            listing = False
            continue
        if not para and _DEFINITION.match(line):
            continue
        if not para:
            start, listing = at, False
        para.append(line)
    end()
    return [b for b in out if b[1]]


# --- wiki text ---------------------------------------------------------------------------------

_WIKI_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(syntaxhighlight|source|pre|math|nowiki)\b[^<>]*?(?<!/)>(.*?)</\1\s*>|<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref\s*>", re.S | re.I)
_WIKI_HEADING = re.compile(r"(={1,6})(.+?)\1[ \t]*$")
_WIKI_ITEM = re.compile(r"([*#:;]*[*#])[ \t]*(.*)$")
_WIKI_INLINE = [
    (re.compile(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]"), r"\1"),
    (re.compile(r"\[(?:https?:)?//[^\s\]]+\s+([^\]]*)\]"), r"\1"),
    (re.compile(r"\[(?:https?:)?//[^\s\]]+\]"), ""),
    (re.compile(r"'{2,5}"), ""),
    (re.compile(r"<br\s*/?>", re.I), " "),
    (re.compile(r"</?[A-Za-z][^<>]*>"), ""),
]


def _breaks(text: str) -> list[int]:
    """The places of the line feeds."""
    return [m.start() for m in re.finditer("\n", text)]


def wiki_inline(text: str) -> str:
    while (shorter := re.sub(r"\{\{[^{}]*\}\}", " ", text)) != text:
        text = shorter
    for pattern, by in _WIKI_INLINE:
        text = pattern.sub(by, text)
    return tidy(unescape(text))


def read_wiki(text: str) -> list[Block]:
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    out: list[Block] = []
    kept: list[str] = []
    text = text.replace("\ue000", "").replace("\ue001", "")
    breaks = _breaks(text)

    def tag(m: re.Match) -> str:
        name, lines = (m[1] or "").lower(), "\n" * m[0].count("\n")
        line = 1 + bisect_left(breaks, m.start())
        if name == "nowiki":
            kept.append(m[2])
            return f"\ue000{len(kept) - 1}\ue001" + lines
        if name and tidy(m[2]):
            body = unescape(m[2]) if name == "pre" else m[2]
            out.append(("formula" if name == "math" else "code", tidy(body), line))
        return " " + lines if name == "math" or not name else lines or "\n\ue001"  # a break that the text doesn't have

    body = _WIKI_TAG.sub(tag, text)
    para: list[str] = []
    start, last, number, table = 0, 0, 0, False

    def see(s: str) -> str:
        return re.sub("\ue000(\\d+)\ue001", lambda m: kept[int(m[1])], wiki_inline(s))

    def end():
        nonlocal para
        if seen := see("\n".join(para)):
            out.append(("text", seen, start, last))
        para = []

    for line in body.split("\n"):
        number += not line.startswith("\ue001")
        line = line.removeprefix("\ue001")
        table = (table or line.startswith("{|")) and not line.startswith("|}")
        heading, item = _WIKI_HEADING.match(line), _WIKI_ITEM.match(line)
        if not table and ((heading and heading[2].strip("= \t")) or item or not line.strip()):
            end()
            if heading and heading[2].strip("= \t"):
                out.append(("heading", see(heading[2]), number))
            elif item:
                out.append(("list_item", see(item[2]), number))
            continue
        if re.match(r"-{4,}\s*$|\{\||\|[-}+]", line):
            end()
            continue
        if not para:
            start = number
        last = number
        para.append(re.sub(r"^[|!]", " ", line))
    end()
    return [b for b in sorted(out, key=lambda b: b[2]) if b[1]]


# --- LaTeX -------------------------------------------------------------------------------------

_VERBATIM = r"verbatim\*?|Verbatim|lstlisting|minted"
_BEGIN_CODE = re.compile(rf"\\begin\{{({_VERBATIM})\}}")
_EVENT = re.compile(
    r"(?<!\\)\\(?:(?P<heading>part|chapter|(?:sub)*section|(?:sub)?paragraph)\*?\s*(?:\[[^\]]*\]\s*)?(?=\{)"
    r"|(?P<item>item)(?![A-Za-z])\s*(?:\[[^\]]*\])?"
    r"|(?P<begin>begin|end)\{(?P<env>[^{}]*)\}"
    r"|(?P<paren>\()|(?P<bracket>\[)(?!\d))"
    r"|(?<!\\)(?P<dollar>\$\$?)|(?P<blank>\n[ \t]*\n)|\ue000(?P<code>\d+)\ue001"
)
_MATH_ENV = {"equation", "align", "gather", "multline", "displaymath", "math", "eqnarray", "flalign", "alignat"}
_DROPPED = re.compile(r"\\(?:footnote|label|cite[tp]?|ref|vspace|hspace|index|thanks|documentclass|usepackage|pagestyle|includegraphics|bibliography|bibliographystyle)\*?\s*(?:\[[^\]]*\])?(?=\{)")
_HREF = re.compile(r"\\href\s*(?=\{)")
_GROUP = re.compile(r"\\.|[{}]", re.S)
_KEPT_CHARACTER = re.compile(r"\\([&%#_${}])")


def _braced(text: str, at: int) -> int:
    """End of the group that opens at ``at``, or -1."""
    depth = 0
    for m in _GROUP.finditer(text, at):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if not depth:
            return m.end()
    return -1


def latex_inline(text: str) -> str:
    """What a reader sees of a stretch of LaTeX."""
    parts, at = [], 0
    while m := _DROPPED.search(text, at):
        end = _braced(text, m.end())
        parts += [text[at : m.start()], " " * (not m[0].startswith("\\footnote"))]
        at = end if end > 0 else len(text)
    text = "".join(parts) + text[at:]
    parts, at, closed = [], 0, True
    while m := _HREF.search(text, at):
        end = _braced(text, m.end()) if closed else -1
        closed = end > 0  # if one isn't closed, those behind it aren't either
        parts.append(text[at : m.start()])
        at = end if closed else m.end() + 1
    text = "".join(parts) + text[at:]
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(m[1])
        return f"\ue002{len(kept) - 1}\ue003"

    text = re.sub(r"\\\\(?:\[[^\]]*\])?", " ", text)
    text = _KEPT_CHARACTER.sub(keep, text)
    text = re.sub(r"\\(?:begin|end)\{[^{}]*\}", " ", text)
    text = re.sub(r"\\[A-Za-z]+\*?[ \t]*(?:\[[^\]]*\])?", "", text)
    text = re.sub(r"\\[,;:! ]", " ", text).replace("~", " ").replace("{", "").replace("}", "")
    return tidy(re.sub("\ue002(\\d+)\ue003", lambda m: kept[int(m[1])], text))


def read_latex(text: str) -> list[Block]:
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\ue000", "").replace("\ue001", "")
    codes: list[str] = []
    lines, numbers, source = [], [], text.split("\n")
    i = 0
    while i < len(source):
        line = re.sub(r"(?<!\\)((?:\\\\)*)%.*", r"\1", source[i])
        i += 1
        here = i
        if m := _BEGIN_CODE.search(line):
            stop, body = f"\\end{{{m[1]}}}", source[i - 1][m.end() :]
            held, skipped = [body], 0
            while stop not in held[-1] and i < len(source):
                held.append(source[i])
                i, skipped = i + 1, skipped + 1
            head, found, tail = "\n".join(held).partition(stop)
            head = re.sub(r"^(?:[ \t]*\[[^\]\n]*\])?" + (r"(?:[ \t]*\{[^}\n]*\})?" if m[1] == "minted" else ""), "", head)
            codes.append(tidy(head))
            line = line[: m.start()] + f"\n\n\ue000{len(codes) - 1}\ue001" + "\n" * max(0, skipped - 2) + tail
        elif line != source[i - 1] and not line.strip():
            continue  # a line that is a comment as a whole
        lines.append(line)
        numbers += [min(here + k, i) for k in range(line.count("\n") + 1)]
    body = "\n".join(lines)
    breaks, missing = _breaks(body), set()
    out: list[Block] = []
    kind, start, p, at, parts, depth = "text", 0, 0, 0, [], 0

    def number(p: int) -> int:
        """The line of the source, of which ``body`` lacks the comments."""
        return numbers[bisect_left(breaks, p)] if numbers else 1

    def end():
        nonlocal parts, kind
        if seen := latex_inline("".join(parts)):
            shown = body[start:p]
            out.append((kind, seen, number(start + len(shown) - len(shown.lstrip())), number(start + len(shown.rstrip()))))
        parts, kind = [], "text"

    while m := _EVENT.search(body, at):
        parts.append(body[at : m.start()])
        p, at = m.start(), m.end()
        if m["heading"]:
            close = _braced(body, at)
            if close < 0:
                parts.append(body[p:at])
                continue
            end()
            out.append(("heading", latex_inline(body[at + 1 : close - 1]), number(p)))
            start = at = close
        elif m["item"]:
            end()
            kind, start = ("list_item" if depth else "text"), p
        elif m["begin"]:
            name = m["env"].rstrip("*")
            if name in _MATH_ENV and m["begin"] == "begin":
                close = -1 if m["env"] in missing else body.find(f"\\end{{{m['env']}}}", at)
                if close < 0:
                    missing.add(m["env"])  # behind here there is none, so it isn't looked for again
                if close > 0:
                    out.append(("formula", tidy(body[at:close]), number(p)))
                    at = close + len(m["env"]) + 6
                    continue
            if name in ("itemize", "enumerate", "description"):
                end()
                depth = max(0, depth + (1 if m["begin"] == "begin" else -1))
                start = at
                if option := re.compile(r"\[[^\]\n]*\]").match(body, at):
                    at = option.end()
            elif name in ("tabular", "document", "center", "figure", "table", "abstract", "quote"):
                end()
                start = at
                if name == "tabular" and body.startswith("{", at) and m["begin"] == "begin":
                    at = max(at, _braced(body, at))
        elif m["code"] is not None:
            end()
            if codes[int(m["code"])]:
                out.append(("code", codes[int(m["code"])], number(p)))
            start = at
        elif m["blank"]:
            if kind == "text":
                end()
                start = at
                at = m.start() + 1
        else:
            close_by = {"(": r"\)", "[": r"\]"}.get(m["paren"] or m["bracket"] or "", m["dollar"])
            close = None if close_by in missing else re.compile(r"(?<!\\)" + re.escape(close_by)).search(body, at)
            if close is None:
                missing.add(close_by)
            inner = body[at : close.start()] if close else ""
            if close and inner.strip() and "\n\n" not in inner:
                out.append(("formula", tidy(inner), number(p)))
                parts.append(" " + tidy(inner).replace("\\", "\\\\") * 0)
                at = close.end()
            else:
                parts.append(m[0])
    parts.append(body[at:])
    p = len(body)
    end()
    return [b for b in out if b[1]]


READERS = {"html": read_html, "markdown": read_markdown, "wiki": read_wiki, "latex": read_latex}


def read_blocks(text: str | None) -> list[Block]:
    """(kind, text, line) of the blocks of a text in the markup it uses, in order."""
    return [b[:3] for b in READERS[markup_of(text)](text)] if text else []


# --- content regions ---------------------------------------------------------------------------

_TAG = re.compile(r"<[/!]?[A-Za-z-][^<>]*>|\\[A-Za-z]+\*?|[=*#|{}\[\]]{2,}")


def content_lines(text: str, width: float = 1.0) -> np.ndarray:
    """Whether each line belongs to the content, by its smoothed ratio of text to tags.

    The ratios are smoothed with a Gaussian, and their logarithms form two clusters; the threshold lies
    midway between the clusters' means. Lines with tags below it are left out. Lines without a tag stay,
    however short they are beside others.
    """
    lines = text.split("\n")
    tags = np.array([len(_TAG.findall(x)) for x in lines])
    ratio = np.array([len(_TAG.sub("", x).strip()) for x in lines], dtype=np.float64) / np.maximum(1, tags)
    reach = max(1, math.ceil(3 * width))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / width) ** 2)
    smooth = np.log1p(np.convolve(np.pad(ratio, reach, mode="edge"), kernel / kernel.sum(), mode="valid"))
    cut = smooth.mean()
    for _ in range(20):
        low, high = smooth[smooth <= cut], smooth[smooth > cut]
        new = (low.mean() + high.mean()) / 2 if len(low) and len(high) else cut
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return (smooth > cut) | ((tags == 0) & (ratio > 0)) if (smooth > cut).any() else np.ones(len(lines), dtype=bool)


def clean_text(text: str | None) -> str:
    """The content as text: headings after #, items after -, code in fences, formulas in dollars.

    Running text stays if any of its lines belongs to the content.
    """
    if not text:
        return ""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    keep, out = content_lines(text), []
    dress = {"heading": "# {}", "list_item": "- {}", "code": "```\n{}\n```", "formula": "$${}$$", "text": "{}"}
    for kind, seen, line, *last in READERS[markup_of(text)](text):
        if kind != "text" or keep[line - 1 : max([line, *last])].any():
            out.append(dress[kind].format(seen))
    return "\n\n".join(out)


# --- Spark -------------------------------------------------------------------------------------

_ELEMENT = pa.struct([("element", pa.string()), ("element_text", pa.string())])


def _elements(batches):
    for batch in slices(batches, 512):
        counts, kinds, texts = [], [], []
        for text in batch.column("content").to_pylist():
            found = dict.fromkeys((k, t) for k, t, _ in read_blocks(text) if k != "text")
            counts.append(len(found))
            kinds += [k for k, _ in found]
            texts += [t for _, t in found]
        values = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(texts, pa.string())], fields=list(_ELEMENT))
        names = [n for n in batch.schema.names if n != "content"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], list_array(counts, values, _ELEMENT)], names=[*names, "found"])


def _texts(batches):
    for batch in slices(batches, 512):
        texts = [clean_text(t) for t in batch.column("content").to_pylist()]
        names = [n for n in batch.schema.names if n != "content"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(texts, pa.string())], names=[*names, "text"])


def _current(stored: DataFrame, run, result: str) -> DataFrame:
    return current_contents(stored, ["content"]).mapInArrow(run, "id string, " + result)


def current_elements(stored: DataFrame) -> DataFrame:
    """(id, element, element_text): the distinct elements of each current content. Superseded contents aren't read."""
    found = _current(stored, _elements, "found array<struct<element:string,element_text:string>>")
    return found.select("id", F.explode("found").alias("f")).select("id", "f.*")


def current_texts(stored: DataFrame) -> DataFrame:
    """(id, text): the clean text of each current content; empty for a null or empty one."""
    return _current(stored, _texts, "text string")


def p5_found(spark, d):
    """The headings, list items, code blocks and formulas of every current content."""
    return current_elements(spark.read.parquet(f"{d}/stored_documents.parquet"))


def p5_text(spark, d):
    """Every current content as clean text that keeps its structure."""
    return current_texts(spark.read.parquet(f"{d}/stored_documents.parquet"))


QUERIES = {"p5_found": p5_found, "p5_text": p5_text}
