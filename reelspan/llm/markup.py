"""Markup residue: which notations a text holds, and the text without them but with its structure."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names of HTML, of caption files and of wiki text. Any other name in angle brackets is text.
TAGS = frozenset(
    "a abbr acronym address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col "
    "colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark marquee menu meta meter "
    "nav nobr noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script section select small "
    "source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul "
    "var video wbr c lang v gallery math noinclude nowiki onlyinclude ref references syntaxhighlight".split()
)
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form header html main nav ol p section table tbody tfoot thead ul".split())
DROPPED = frozenset("script style template head noscript".split())
# TeX commands that stand for a symbol or for nothing.
TEX_SYMBOLS = {"ldots": "…", "dots": "…", "textendash": "–", "textemdash": "—", "LaTeX": "LaTeX", "TeX": "TeX", "quad": " ", "qquad": " ", "par": "\n\n", "newline": "\n", "noindent": "", "centering": "", "maketitle": "", "hline": ""}

# Marks of what the events leave in a text while it is read, one for each notation: characters for private use, which a text that holds them has replaced meanwhile.
HTML, LATEX, MARKDOWN, OVERRIDE, WIKI, STRUCTURE, LINK, LINKED, KEEP, KEPT = map(chr, range(0xE000, 0xE00A))
KINDS = {"html": HTML, "latex": LATEX, "markdown": MARKDOWN, "override": OVERRIDE, "wiki": WIKI}
_MARKS = f"[{HTML}-{LINKED}]"
_RESERVED = re.compile(f"[{HTML}-{KEPT}]")
#: Signs that a notation needs.
SIGNS = r"(?m)[<&*_`~$\\\[{|#=]|''|^\s{0,3}>"
ANY = re.compile(SIGNS)
# Bodies without their own closing sign are taken whole and never given back, and other pairs are looked for by ``_pairs``: both read a text once, whatever a span's length.
_ASS = re.compile(r"\{\\[A-Za-z0-9][^{}\n]*+\}")
_FENCE = re.compile(r"(?:^|(?<=[ \n])|(?<=%s))(```|~~~)([\w+-]*+)[ \t]*+\n" % _MARKS)
_TICKS = re.compile(r"(?<![`\\])`(?!`)([^`\n]++)(?<!\\)`(?!`)")
_DOLLARS = re.compile(r"\$\$([^$]++)\$\$")
_DISPLAY = re.compile(r"\\\[|\\begin\{(?P<env>(?:equation|align|gather|displaymath|math|eqnarray|multline)\*?)\}")
_ROUND = re.compile(r"\\\(")
_INLINE = re.compile(r"(?<![\\$\w])\$(?=[^\s$\d]|\d[^$\n\\^_=]*+[\\^_=])([^$\n]++)(?<![\s\\])\$(?![\w$])")
_COMMAND = re.compile(r"\\(?:begin|end|item|section|subsection|subsubsection|chapter|paragraph|textbf|textit|texttt|textsc|emph|underline|cite[pt]?|ref|label|footnote|href|url|caption|title|author|ldots|dots|LaTeX|TeX|textendash|textemdash|quad|qquad|noindent|centering|maketitle|hline|includegraphics|documentclass|usepackage|frac|sqrt)(?![A-Za-z])")
_LINK = re.compile(r"(!?)\[([^\[\]\n]*+)\]\(\s*+<?([^()\s<>]++)>?(?:\s++(?:\"[^\"\n]*+\"|'[^'\n]*+'))?\s*+\)")
_WIKI_LINK = re.compile(r"\[\[([^\[\]\n]++)\]\]")
_WIKI_URL = re.compile(r"\[(?:https?|ftp)://[^\s\]]++(?:\s++([^\]\n]++))?\]")
_WIKI_HEAD = re.compile(r"(?:^|(?<=\s)|(?<=%s))(={2,6})[ \t]*+([^=\n]*[^=\s])[ \t]*+\1(?=\s|%s|$)" % (_MARKS, _MARKS))
_HEAD = re.compile(r"^(?P<m>%s*)(?P<h>#{1,6})[ \t]++(?P<t>\S[^\n]*?)[ \t]*#*(?P<n>%s*)$|(?<=[ \t])(?P<h2>#{1,6})[ \t]++(?P<t2>[^\s#\d][^\n#]*+)(?=\n)" % (_MARKS, _MARKS), re.M)
_BOLD = re.compile(r"(?<![*\\])\*\*(?=[^\s*])([^*\n]++)(?<!\s)\*\*(?!\*)|(?<![\w\\_])__(?=[^\s_])((?:[^_\n]|_(?!_))++)(?<![\s_])__(?![\w_]|\.\w)")
_ITALIC = re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]++)(?<!\s)\*(?![\w*])|(?<![\w_\\/])_(?=[^\s_])([^_\n]++)(?<!\s)_(?![\w_/])")
_STRIKE = re.compile(r"(?<![~\\])~~(?=[^\s~])([^~\n]++)(?<!\s)~~(?!~)")
_MD_RULE = re.compile(r"[ \t]*+\|?(?:[ \t]*+:?-{3,}+:?[ \t]*+\|)++(?:[ \t]*+:?-{3,}+:?[ \t]*+)?%s*" % _MARKS)
_BLOCKQUOTE = re.compile(r"^(%s*)[ \t]{0,3}>[ \t]?(?=\S)" % _MARKS, re.M)
_RULE = re.compile(r"^%s*[ \t]*+(?:-{3,}+|\*{3,}+|_{3,}+)[ \t]*+%s*$" % (_MARKS, _MARKS), re.M)
_BULLET = re.compile(r"^(%s*)[ \t]*+[*+][ \t]++(?=\S)" % _MARKS, re.M)


def _pairs(t: str, opening: re.Pattern, closing: Callable[[re.Match], re.Pattern], made: Callable[[re.Match, str, re.Match], str]) -> str:
    """``t`` with each span from an ``opening`` to the first ``closing`` after it replaced. A closing that is not found is not looked for again."""
    out, at, missing = [], 0, set()
    while m := opening.search(t, at):
        want = closing(m)
        end = want.search(t, m.end()) if want not in missing else None
        if end is None:
            missing.add(want)
            out.append(t[at : m.end()])
            at = m.end()
            continue
        out += [t[at : m.start()], made(m, t[m.end() : end.start()], end)]
        at = end.end()
    return "".join(out) + t[at:]


@lru_cache(maxsize=1000)
def _literal(s: str, before: str = "", after: str = "") -> re.Pattern:
    return re.compile(before + re.escape(s) + after)


_ALL_MARKS = frozenset(map(chr, range(0xE000, 0xE008)))


class _Events(HTMLParser):
    """Reads a text by the parser's events into lines, in which each tag leaves a mark; an element that HTML does not know is text."""

    def __init__(self, text: str) -> None:
        super().__init__(convert_charrefs=False)
        self.any = False
        self.lines: list[list[str]] = [[]]
        self.lists: list[list] = []
        self.skip, self.pre, self.title = 0, 0, 0
        self.cell: list[str] | None = None
        self._starts = [0]
        for m in re.finditer("\n", text):
            self._starts.append(m.end())
        self._source = text
        self.feed(text)
        self.close()

    def set_cdata_mode(self, elem: str, *args: object, **kwargs: object) -> None:
        """Scripts and styles are text up to their end tag only if there is one; else the rest would vanish."""
        if re.search(rf"</{re.escape(elem)}\s*>", self._source[self._at():], re.I):
            super().set_cdata_mode(elem, *args, **kwargs)

    def _at(self) -> int:
        line, col = self.getpos()
        return self._starts[line - 1] + col

    def write(self, s: str) -> None:
        if self.skip:
            return
        first, *rest = s.split("\n")
        self.lines[-1].append(first)
        self.lines += [[x] for x in rest]

    def mark(self, *marks: str) -> None:
        """A mark for an event, also inside of what is left out."""
        self.any = True
        self.lines[-1] += marks

    def empty(self, line: int = -1) -> bool:
        return not any(x.strip() and x not in _ALL_MARKS for x in self.lines[line])

    def fresh(self, blank: bool = False) -> None:
        if self.skip:
            return
        if not self.empty():
            self.lines.append([])
        if blank and len(self.lines) > 1 and not self.empty(-2):
            self.lines.append([])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        raw = self.get_starttag_text() or ""
        name = tag.split(".")[0]
        if name not in TAGS or (name in ("v", "c") and tag == "v" and not attrs):
            self.write(raw)
            return
        self.mark(WIKI if name in ("ref", "nowiki", "references", "gallery") else HTML)
        if raw.endswith("/>") and name == "ref":
            return
        a = {k: v or "" for k, v in attrs}
        if name in DROPPED or name == "ref":
            self.skip += 1
        elif name == "v":
            self.write(" ".join(k for k, _ in attrs).title() + ": ")
        elif name == "br":
            self.write("\n")
        elif name == "hr":
            self.fresh(True)
        elif re.fullmatch("h[1-6]", name):
            self.fresh(True)
            self.write("#" * int(name[1]) + " ")
            self.mark(STRUCTURE)
        elif name in ("ul", "ol", "menu", "dir"):
            self.lists.append([name, 0])
            self.fresh()
        elif name == "li":
            self.fresh()
            if self.lists and self.lists[-1][0] == "ol":
                self.lists[-1][1] += 1
                self.write(f"{self.lists[-1][1]}. ")
            else:
                self.write("- ")
            self.mark(STRUCTURE)
        elif name == "pre":
            self.fresh()
            self.pre += 1
            self.mark(STRUCTURE)
            self.write("```\n" + STRUCTURE)
        elif name == "tr":
            self.fresh()
            self.mark(STRUCTURE)
        elif name in ("td", "th"):
            if not self.empty():
                self.write(" | ")
        elif name == "img":
            self.write(a.get("alt", ""))
        elif name == "a" and "href" in a:
            self.write(LINK)
        elif name in BLOCKS:
            self.fresh(True)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in DROPPED:
            self.skip = max(0, self.skip - 1)

    def handle_endtag(self, tag: str) -> None:
        name = tag.split(".")[0]
        if name not in TAGS:
            at = self._at()
            end = self._source.find(">", at)
            self.write(self._source[at : end + 1] if end >= 0 else f"</{tag}>")
            return
        self.mark(HTML)
        if name in DROPPED or name == "ref":
            self.skip = max(0, self.skip - 1)
        elif name == "pre" and self.pre:
            self.fresh()
            self.pre -= 1
            self.mark(STRUCTURE)
            self.write("```\n")
        elif name == "a":
            self.write(LINKED)
        elif name in ("ul", "ol", "menu", "dir"):
            if self.lists:
                self.lists.pop()
            self.fresh(not self.lists)
        elif re.fullmatch("h[1-6]|li|tr", name):
            self.fresh()
        elif name in BLOCKS:
            self.fresh(True)

    def handle_data(self, data: str) -> None:
        self.write(data.replace("\n", "\n" + STRUCTURE) if self.pre else data)

    def handle_entityref(self, name: str) -> None:
        self._reference(name)

    def handle_charref(self, name: str) -> None:
        self._reference("#" + name)

    def _reference(self, name: str) -> None:
        end = self._at() + 1 + len(name)
        closed = self._source[end : end + 1] == ";"
        if closed and (name[0] == "#" or name + ";" in html5):
            self.mark(HTML)
            self.write(html.unescape(f"&{name};"))
        else:
            self.write(f"&{name}" + (";" if closed else ""))

    def handle_comment(self, data: str) -> None:
        self.mark(HTML)

    def handle_decl(self, decl: str) -> None:
        if decl.lower().startswith("doctype"):
            self.mark(HTML)
        else:
            self.write(f"<!{decl}>")

    def unknown_decl(self, data: str) -> None:
        self.write(f"<![{data}]>")

    def handle_pi(self, data: str) -> None:
        self.write(f"<?{data}>")


#: Clusters of lines are regions of their own where their ratios differ at least by this factor, as a logarithm.
APART = math.log(8)


def content_lines(lines: list[tuple[str, int, bool]], sigma: float = 1.5) -> list[bool]:
    """Which ``lines`` (text, tags, whether kept in any case) are content, by the text-to-tag ratio of each, smoothed by a Gaussian and cut into two clusters.

    The ratio of a line is its characters by its tags, at least one, taken as a logarithm, so that one long paragraph does not set
    the measure; blank lines have no ratio and stay. The two clusters are found by two-means on the smoothed ratios. A line is navigation and the like where its smoothed ratio is in the lower cluster
    and under one standard deviation, and its own is too. In a short text no line is farther from the content than the Gaussian
    reaches, so all of it is one region.
    """
    at = [i for i, x in enumerate(lines) if x[0].strip()]
    ratio = [math.log1p(len(lines[i][0].strip()) / max(1, lines[i][1])) for i in at]
    if not ratio:
        return [True] * len(lines)
    reach = math.ceil(2 * sigma)
    kernel = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-reach, reach + 1)]
    smooth = []
    for i in range(len(ratio)):
        w = [(kernel[j + reach], ratio[i + j]) for j in range(-reach, reach + 1) if 0 <= i + j < len(ratio)]
        smooth.append(sum(a * b for a, b in w) / sum(a for a, _ in w))
    low, high = min(smooth), max(smooth)
    for _ in range(20):
        cut = (low + high) / 2
        under, over = [x for x in smooth if x < cut], [x for x in smooth if x >= cut]
        if not under or not over:
            return [True] * len(lines)
        before = low, high
        low, high = sum(under) / len(under), sum(over) / len(over)
        if before == (low, high):
            break
    if high - low < APART:
        return [True] * len(lines)
    least = (low + high) / 2
    fine = [True] * len(lines)
    for i, s, r in zip(at, smooth, ratio):
        fine[i] = lines[i][2] or s >= least or r >= least
    return fine


def clean_markup(text: str | None) -> tuple[str | None, list[str]]:
    """(text without markup, sorted names of the notations in it: ``html``, ``latex``, ``markdown``, ``override``, ``wiki``).

    Every piece of a notation is an event that leaves its mark in its line: HTML by the events of the standard library's parser,
    the other notations by theirs. A text with marks is read as lines with a text-to-tag ratio, of which ``content_lines`` tells
    those that are content. Headings come out as ``#`` lines, list items as ``-`` or numbered lines, table rows with ``|`` between
    cells, code blocks between fences, formulas as TeX between dollar signs; such lines stay unless they are links only. A text
    without markup comes out as it is; null stays null.
    """
    if text is None or not ANY.search(text):
        return text, []
    own = sorted(set(_RESERVED.findall(text)))
    if own:  # the text has such signs itself: others stand for them meanwhile
        free = (chr(c) for c in range(0xF0000, 0x110000) if chr(c) not in text)
        there = {ord(c): next(free) for c in own}
        clean, kinds = clean_markup(text.translate(there))
        return clean.translate({ord(v): chr(k) for k, v in there.items()}), kinds
    kept: list[str] = []

    def keep(s: str) -> str:
        kept.append(s)
        return f"{KEEP}{len(kept) - 1}{KEPT}"

    def around(mark: str) -> Callable[[re.Match], str]:
        return lambda m: mark + next(g for g in m.groups() if g is not None) + mark

    def ends(m: re.Match) -> re.Pattern:
        return _literal("\\]" if m[0] == "\\[" else f"\\end{{{m['env']}}}")

    t = _ASS.sub(OVERRIDE, text)
    if OVERRIDE in t:
        t = re.sub(r"\\[Nn](?![a-z])|\\[Nn](?=[A-Z])", "\n", t).replace("\\h", " ")
    if "```" in t or "~~~" in t:
        t = _pairs(t, _FENCE, lambda m: _literal(m[1], r"\n?[ \t]*", r"(?=\s|$)"), lambda m, body, _: f"\n{MARKDOWN}{STRUCTURE}" + keep(f"```{m[2]}\n{body}\n```") + "\n")
    t = _TICKS.sub(lambda m: MARKDOWN + keep(m[1]) + MARKDOWN, t)
    t = _DOLLARS.sub(lambda m: LATEX + keep("$$" + m[1].strip() + "$$"), t)
    t = _pairs(t, _DISPLAY, ends, lambda m, body, _: LATEX + keep("$$" + body.strip() + "$$"))
    t = _pairs(t, _ROUND, lambda m: _literal("\\)"), lambda m, body, _: LATEX + keep("$" + body.strip() + "$"))
    t = _INLINE.sub(lambda m: LATEX + keep("$" + m[1].strip() + "$"), t)

    if "{|" in t:
        t = _pairs(t, _literal("{|"), lambda m: _literal("\n|}"), lambda m, body, _: f"\n{WIKI}" + _wiki_rows(body) + "\n")
    if "{{" in t:
        t = _templates(t)
    if "[[" in t:
        t = _WIKI_LINK.sub(lambda m: WIKI + LINK + _wiki_link(m[1]) + LINKED, t)
    t = _WIKI_URL.sub(lambda m: WIKI + LINK + (m[1] or "") + LINKED, t)

    if "<" in t or "&" in t:
        e = _Events(t)
        if e.any:
            t = "\n".join("".join(x) for x in e.lines)

    if "\\" in t and _COMMAND.search(t):
        t = _tex(t)
    t = _LINK.sub(lambda m: MARKDOWN + LINK * (not m[1]) + m[2] + LINKED * (not m[1]), t)
    if "---" in t:
        t = _md_tables(t)
    if "''" in t:
        t = "\n".join(_quotes(x) if "''" in x else x for x in t.split("\n"))
    if "==" in t:
        t = "\n".join(_WIKI_HEAD.sub(lambda m: f"\n{'#' * len(m[1])} {m[2]}{WIKI}{STRUCTURE}\n", x) if "==" in x else x for x in t.split("\n"))
    if "#" in t and not any(x in t for x in (HTML, WIKI, LATEX)):  # whose headings have become such lines above
        t = _HEAD.sub(lambda m: ("\n" if m["h2"] else m["m"]) + f"{m['h'] or m['h2']} {(m['t'] or m['t2']).rstrip()}{MARKDOWN}{STRUCTURE}" + (m["n"] or ""), t)
    for pattern in (_BOLD, _ITALIC, _STRIKE):
        t = pattern.sub(around(MARKDOWN), t)
    return _content(t, kept) if _RESERVED.search(t) else (text, [])


def _content(t: str, kept: list[str]) -> tuple[str, list[str]]:
    """What is content of a text with marks, without them, and the notations that the marks are of."""
    t = _BLOCKQUOTE.sub(r"\1", t)
    t = _RULE.sub("", t)
    t = _BULLET.sub(rf"\1- {STRUCTURE}", t)
    lines, linked = [], False
    counts: Counter = Counter()
    for x in t.split("\n"):
        marks = Counter(m for m in x if HTML <= m <= LINKED)
        counts.update(marks)
        bare, free, linked = _unmarked(x, linked)
        # a list of links is no list of the text's own
        only_links = (marks[LINK] or marks[LINKED]) and not re.search(r"\w", re.sub(r"^(?:- |\d+\. |#+ )", "", free))
        listed = marks[STRUCTURE] or re.match(r"\s*(?:- |\d+[.)] )", bare)
        lines.append((bare, sum(marks[k] for k in KINDS.values()), bool(listed) and not only_links))
    fine = content_lines(lines)
    t = "\n".join(x[0] for x, f in zip(lines, fine) if f)
    for _ in range(len(kept) and 3):
        t = re.sub(f"{KEEP}(\\d+){KEPT}", lambda m: kept[int(m[1])], t)
    t = _RESERVED.sub("", t)
    t = re.sub(r"[ \t]+\n", "\n", t)
    return re.sub(r"\n{3,}", "\n\n", t).strip(), sorted(k for k, m in KINDS.items() if counts[m])


def _unmarked(line: str, linked: bool) -> tuple[str, str, bool]:
    """(text of a line, its text outside of links, whether a link is open at its end)."""
    free = []
    for i, x in enumerate(re.split(f"([{LINK}{LINKED}])", line)):
        if i % 2:
            linked = x == LINK
        elif not linked:
            free.append(x)
    strip = lambda s: re.sub(_MARKS, "", s)
    return strip(line), strip("".join(free)), linked


def _wiki_rows(body: str) -> str:
    rows: list[list[str]] = [[]]
    for line in body.split("\n")[1:]:
        line = line.strip()
        if line.startswith("|-"):
            rows.append([])
        elif line.startswith("|+"):
            rows[-1].append(line[2:].strip())
        elif line[:1] in "|!" and line:
            rows[-1] += [c.split("|")[-1].strip() if line[0] == "|" else c.strip() for c in re.split(r"\|\||!!", line[1:])]
        elif rows[-1]:
            rows[-1][-1] += " " + line
    return "\n".join(" | ".join(r) + WIKI * len(r) + STRUCTURE for r in rows if r)


def _templates(t: str) -> str:
    """Templates from the inside out, however deep."""
    stack: list[list[str]] = [[]]
    for i, x in enumerate(re.split(r"(\{\{|\}\})", t)):
        if i % 2 == 0:
            stack[-1].append(x)
        elif x == "{{":
            stack.append([])
        elif len(stack) > 1:
            body = "".join(stack.pop())
            stack[-1].append(WIKI + _template(body) if body.strip() and not re.search(r"[{}]", body) else "{{" + body + "}}")
        else:
            stack[-1].append(x)
    while len(stack) > 1:
        body = "".join(stack.pop())
        stack[-1].append("{{" + body)
    return "".join(stack[0])


def _template(body: str) -> str:
    parts = [p.strip() for p in body.split("|")]
    values = [p for p in parts[1:] if not re.match(r"[\w ]+=", p)]
    return ": ".join(values) if re.sub(_MARKS, "", parts[0]).lower().startswith("quote") else " ".join(values)


def _wiki_link(body: str) -> str:
    target, _, label = body.partition("|")
    if re.match(r"(?i)\s*(file|image|media|category)\s*:", target):
        caption = label.rpartition("|")[2]
        return "" if re.match(r"(?i)\s*category", target) else caption
    return label or target


def _md_tables(t: str) -> str:
    """Tables of rows between bars, under a line of dashes the head."""
    lines, out, i = t.split("\n"), [], 0
    while i < len(lines):
        bar = lines[i].find("|")
        if bar >= 0 and i + 1 < len(lines) and _MD_RULE.fullmatch(lines[i + 1]) and re.sub(_MARKS, "", lines[i]).rstrip().endswith("|") and lines[i].rfind("|") > bar + 1:
            end = i + 2
            while end < len(lines) and re.sub(_MARKS, "", lines[end]).lstrip().startswith("|"):
                end += 1
            before = lines[i][:bar].rstrip()
            out += [before] if before else [""]
            out += [" | ".join(c.strip() for c in re.sub(rf"^({_MARKS}*)[ \t]*\||\|[ \t]*({_MARKS}*)$", r"\1\2", r.strip()).split("|")) + MARKDOWN * max(1, r.count("|")) + STRUCTURE for r in (lines[i][bar:], *lines[i + 2 : end])]
            out += [""]
            i = end
        else:
            out.append(lines[i])
            i += 1
    return "\n".join(out)


_QUOTE = re.compile(r"'{2,}")


def _quotes(line: str) -> str:
    """Bold and italic of wiki text in a line: signs of two, three or five quotes, closed by as many after a letter or sign."""
    signs = [(m.start(), m.end()) for m in _QUOTE.finditer(line)]
    out, at, i = [], 0, 0
    while i < len(signs):
        a, b = signs[i]
        n = b - a
        j = i + 1
        if n in (2, 3, 5) and b < len(line) and not line[b].isspace():
            while j < len(signs) and (signs[j][1] - signs[j][0] != n or line[signs[j][0] - 1].isspace()):
                j += 1
            if j < len(signs):
                inner = line[b : signs[j][0]]
                out += [line[at:a], WIKI, _quotes(inner) if n == 3 and "''" in inner else inner, WIKI]
                at, i = signs[j][1], j + 1
                continue
        i += 1
    return "".join(out) + line[at:]


_BRACE = re.compile(r"(?<!\\)[{}]|\\(?:textbf|textit|texttt|textsc|emph|underline|caption|title|author|url|footnote)\{")


def _tex(t: str) -> str:
    """TeX commands with their arguments outside of formulas; a backslash with any other word, as in a path, is text."""
    arg, opt = r"\{([^{}\n]*+)\}", r"(?:\[[^\]\n]*+\])"
    head = lambda level: lambda m: f"\n{level} {m[m.lastindex]}{LATEX}{STRUCTURE}\n"
    t = re.sub(r"\\(?:section|chapter)\*?" + arg, head("#"), t)
    t = re.sub(r"\\subsection\*?" + arg, head("##"), t)
    t = re.sub(r"\\(?:subsubsection|paragraph)\*?" + arg, head("###"), t)
    t = re.sub(r"\\(?:begin|end)\{(?:tabular|array)\*?\}(?:\{[^{}\n]*+\})?", f"\n{LATEX}", t)
    t = re.sub(r"\\(?:begin|end)\{[A-Za-z]++\*?\}" + opt + "?", f"\n{LATEX}", t)
    t = re.sub(r"(?<![ \t\n])[ \t]*+\n?[ \t]*+\\item(?:\[([^\]\n]*+)\])?[ \t]*+|\\item(?:\[([^\]\n]*+)\])?[ \t]*+", lambda m: f"\n- {LATEX}{STRUCTURE}" + (m[1] or m[2] or "") + (" " if m[1] or m[2] else ""), t)
    t = re.sub(r"~?\\(?:cite[pt]?|ref|label|footnotemark|includegraphics|documentclass|usepackage)" + opt + "*" + arg, LATEX, t)
    t = re.sub(r"\\href\{[^{}\n]*+\}" + arg, rf"{LATEX}{LINK}\1{LINKED}", t)
    # arguments inside arguments, however deep
    stack: list[tuple[str, list[str]]] = [("", [])]
    at = 0
    for m in _BRACE.finditer(t):
        stack[-1][1].append(t[at : m.start()])
        at = m.end()
        if m[0] == "}" and len(stack) > 1:
            opened, body = stack.pop()
            stack[-1][1].append(LATEX + "".join(body) + LATEX if opened != "{" else "{" + "".join(body) + "}")
        elif m[0] == "}":
            stack[-1][1].append("}")
        else:
            stack.append((m[0], []))
    stack[-1][1].append(t[at:])
    while len(stack) > 1:
        opened, body = stack.pop()
        stack[-1][1].append((LATEX if opened != "{" else "") + opened + "".join(body))
    t = "".join(stack[0][1])
    t = re.sub(r"\\(?:frac|sqrt)(?:\{[^{}\n]*+\}){1,2}", lambda m: f"{LATEX}${m[0]}$", t)
    return re.sub(r"\\(" + "|".join(TEX_SYMBOLS) + r")(?![A-Za-z])[ ]?(?:\{\})?", lambda m: LATEX + TEX_SYMBOLS[m[1]], t)


CLEAN = T.StructType([T.StructField("clean", T.StringType()), T.StructField("notations", T.ArrayType(T.StringType()))])


@F.pandas_udf(CLEAN)
def _clean(texts: pd.Series) -> pd.DataFrame:
    rows = [clean_markup(t) for t in texts]
    return pd.DataFrame({"clean": [r[0] for r in rows], "notations": [r[1] for r in rows]})


def may_hold_markup(col: Column) -> Column:
    """Whether a text has any character that a notation needs; the others need no parser."""
    return col.rlike(SIGNS)


def without_markup(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``clean`` and ``notations`` (empty where there is no markup). Texts are independent: no shuffle.

    Null, empty and blank texts come out as they are, with no notations. Very long texts are read whole, and a notation's span has
    any length. Columns of ``df`` that are called ``clean`` or ``notations`` are replaced.
    """
    kept = [c for c in df.columns if c not in ("clean", "notations")]
    box = "_cleaned"
    while box in kept:
        box += "_"
    both = df.select(*[F.col(f"`{c}`") for c in kept], _clean(F.col(f"`{text}`")).alias(box))
    return both.select(*[F.col(f"`{c}`") for c in kept], F.col(f"{box}.clean").alias("clean"), F.col(f"{box}.notations").alias("notations"))
