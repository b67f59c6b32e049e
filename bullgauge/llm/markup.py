"""HTML, Markdown, wiki and LaTeX residue in text -> plain text whose structure can still be seen.

Method: tag-path ratios. Every piece of markup of the four dialects opens or closes a node; a node's tag path runs from the root to the
leaf (``root/div/p/strong``, ``root/md:li/md:a``, ``root/tex:h``). A text is marked if it has a node below the root. The lines of
text in the nodes are counted per path with their characters, punctuation and links, over all documents of a source (``repair.strip_markup``); the means are
smoothed over a path's parent, children and siblings and fused into one ratio; paths below ``SHARE`` of the source's mean ratio are not content.

Inline elements belong to the path of their block. Headings, cells, items, code and formulas are structure and stay unless they
consist of links or stand in navigation; scripts, styles and comments never stay; what is at the root is the text itself.

Output: headings as ``# x``, list items as ``- x``, table rows as ``a | b``, code indented by four
blanks, formulas between dollar signs; bold, italics, links, anchors, comments and attributes go.

Defined results: null -> null, no case; text without markup is returned as the same object; elements nested beyond ``DEEP``
levels have a path with the levels beyond as one hash.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable

import xxhash

from bullgauge.llm.lookalike import fold

#: Element names of HTML and of the wiki dialect; fixed values of the formats.
TAGS = (
    "a abbr address article aside b big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em "
    "embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label "
    "legend li link main map mark meta nav nobr noscript object ol option p param pre q s samp script section select small span strike strong "
    "style sub summary sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video wbr "
    "ref references nowiki gallery math syntaxhighlight includeonly noinclude onlyinclude poem source"
).split()
VOID = frozenset("br hr img input link meta wbr col param embed source".split())
SILENT = frozenset("script style head title noscript template".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody tfoot thead tr ul".split())
#: Commands of LaTeX with no argument that stand in running text.
COMMANDS = "begin end item frac dfrac sqrt times cdot div pm leq geq le ge neq approx sum prod int alpha beta gamma delta Delta sigma mu lambda theta rho par quad qquad newline noindent hline toprule midrule bottomrule centering left right ldots dots infty partial clearpage newpage maketitle tableofcontents".split()

_TAG = r"</?(?:" + "|".join(sorted(TAGS, key=len, reverse=True)) + r"|[a-z]{1,4}:[a-z]+)(?:\s[^<>\n]*)?/?>"
_COMMENT = r"<!--.*?(?:-->|$)|<!\[CDATA\[|\]\]>|<!DOCTYPE[^>]*>|<\?xml[^>]*>"
_ENTITY = r"&(?:#\d{2,6}|#[xX][0-9a-fA-F]{2,5}|[A-Za-z]{2,8}\d?);"
_BULLET = r"^[ \t　]*(?:[-+*]|[*#]{2,4}|#) +(?!-?\d+ *-\s*$)(?=\S)"
_HTML = re.compile(f"{_COMMENT}|{_TAG}|{_ENTITY}", re.I | re.S)
_INLINE = re.compile(r"`[^`\n]+`|\*\*[^*\s][^*\n]*\*\*|(?<![\w*])\*[^\s*][^*\n]*\*(?![\w*])|__[^_\s][^_\n]*__|(?<![\w_])_[^_\s][^_\n]*_(?![\w_])|~~[^~\n]+~~|!?\[[^\]\n]*\]\([^)\n]*\)")
_LINE = re.compile(
    r"^[ \t　]*(?:#{1,6} +\S|```|> ?(?=[^\s>])|\|.*\|[ \t\r]*$)|^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*\|[-:| \t]*\r?$|" + _BULLET,
    re.M,
)
_WIKI = re.compile(r"^[ \t　]*(={2,6})[^=\n].*?\1[ \t\r]*$|'{2,5}[^'\n]+'{2,5}|\[\[[^\]\n]+\]\]|\{\{[^{}\n]+\}\}|^\{\||^\|\}|^\|-|\[https?://[^\s\]]+[^\]\n]*\]|__(?:TOC|NOTOC)__", re.M)
_TEX = re.compile(
    r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{|\\(?:" + "|".join(COMMANDS) + r")(?![A-Za-z])|\\[%&_#$](?![A-Za-z\\])|\\[()\[\]](?=[^\n]*\\[()\[\]])|(?<!\w)\$\$?[^$\n]*[\\^_{=][^$\n]*\$\$?|\\\\[ \t\r]*$", re.M
)
#: kind -> (strings of which one must be there, patterns); looking for the strings first is many times faster.
KINDS = {
    "html": ((("<", "&"), _HTML),),
    "markdown": ((("`", "*", "_", "~~", "]("), _INLINE), (("#", "`", "> ", "|", "- ", "+ ", "* ", ">"), _LINE)),
    "wiki": ((("==", "''", "[[", "{{", "{|", "|}", "|-", "[http", "__"), _WIKI),),
    "latex": ((("\\", "$"), _TEX),),
}


_STARTS = frozenset("#>|-+*:`")


def _has_line(text: str) -> bool:
    """_LINE.search, on the lines only that begin with one of its signs."""
    for line in text.split("\n"):
        x = line.lstrip(" \t　")
        if x and x[0] in _STARTS and _LINE.search(line):
            return True
    return False


def kinds(text: str | None, folded: bool = False) -> list[str]:
    """The kinds of markup in a text, look-alike characters aside."""
    if not text:
        return []
    if not folded and not text.isascii():
        text = fold(text)
    out = []
    for k, checks in KINDS.items():
        for signs, p in checks:
            if any(s in text for s in signs) and (_has_line(text) if p is _LINE else p.search(text)):
                out.append(k)
                break
    return out


# ------------------------------------------------------------------ nodes
DEEP = 64
#: Elements that end where one of the same kind begins.
_ENDS_ITSELF = {n: g for g in (frozenset(("p",)), frozenset(("li",)), frozenset(("dt", "dd")), frozenset(("td", "th")), frozenset(("tr",)), frozenset(("option",))) for n in g}
_PUNCT = re.compile(r"[，。；：！？、,.;:!?]")
_TOKEN = re.compile(f"(?P<html>{_COMMENT}|{_TAG})", re.I | re.S)
_ENTITIES = re.compile(_ENTITY)
_NAME = re.compile(r"</?\s*([A-Za-z0-9:]+)")
_TEX_NAME = re.compile(r"\\([A-Za-z]+)")
_SECTIONS = frozenset("part chapter section subsection subsubsection paragraph subparagraph title".split())


def _markdown_name(s: str) -> str:
    if s[:2] in ("**", "__"):
        return "md:strong"
    return {"`": "md:code", "*": "md:em", "_": "md:em", "~": "md:del", "!": "md:img", "[": "md:a"}[s[0]]


def _line_name(s: str) -> str:
    x = s.lstrip(" \t　")
    if x.startswith("```"):
        return "md:pre"
    if x[:1] == "#" and x.lstrip("#")[:1] == " ":
        return f"md:h{min(6, len(x) - len(x.lstrip('#')))}"
    return "md:quote" if x[:1] == ">" else "md:tr" if x[:1] in "|:" or "|" in x else "md:li"


def _wiki_name(s: str) -> str:
    x = s.lstrip(" \t　")
    if x.startswith("=="):
        return "wiki:h"
    return {"''": "wiki:b", "[[": "wiki:a", "[h": "wiki:a", "{{": "wiki:template", "__": "wiki:toc"}.get(x[:2], "wiki:table")


def _tex_name(s: str) -> str:
    if s[0] == "$" or s[1:2] in ("(", ")", "[", "]"):
        return "tex:math"
    m = _TEX_NAME.match(s)
    if not m:
        return "tex:char"
    return "tex:h" if m[1] in _SECTIONS else "tex:li" if m[1] == "item" else "tex:env" if m[1] in ("begin", "end") else "tex:cmd"


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, name) of every node of Markdown, wiki and LaTeX and of every entity; a node that is a line's ends with the line."""
    out = []

    def eol(at: int) -> int:
        end = text.find("\n", at)
        return len(text) if end < 0 else end

    if "&" in text:
        out += [(*m.span(), "entity") for m in _ENTITIES.finditer(text)]
    for kind, named in (("markdown", _markdown_name), ("wiki", _wiki_name), ("latex", _tex_name)):
        for signs, p in KINDS[kind]:
            if not any(x in text for x in signs):
                continue
            if p is _LINE:
                at = 0
                for line in text.split("\n"):
                    x = line.lstrip(" \t　")
                    if x and x[0] in _STARTS and _LINE.search(line):
                        out.append((at, at + len(line), _line_name(line)))
                    at += len(line) + 1
            else:
                for m in p.finditer(text):
                    name = named(m[0])
                    out.append((m.start(), eol(m.end()) if name == "tex:h" else m.end(), name))
    return out


def nodes(text: str) -> list[tuple[str, str]]:
    """(tag path, text) of every text node in order, with (path, NUL + name) for each HTML tag; a path without markup is ``root``."""
    tokens = list(_TOKEN.finditer(text)) if "<" in text or "]]>" in text else []
    found = spans(text)
    if not tokens and not found:
        return [("root", text)] if text else []
    events: list[tuple[int, int, object]] = [(m.start(), 1, m) for m in tokens]
    for a, b, name in found:
        events += [(a, 2, name), (b, 0, name)]
    events.sort(key=lambda e: e[:2])
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str, int]] = [("", "root", 0)]  # name, path, hash of the path
    names: Counter[str] = Counter()
    inner: list[str] = []
    at = 0

    def path() -> str:
        return "/".join((stack[-1][1], *inner)) if inner else stack[-1][1]

    def push(name: str) -> None:
        _, above, h = stack[-1]
        h = xxhash.xxh3_64_intdigest(name, seed=h)
        if len(stack) < DEEP:
            here = f"{above}/{name}"
        else:
            here = f"{stack[DEEP - 1][1]}/~{h:x}"
        stack.append((name, here, h))
        names[name] += 1

    def pop() -> str:
        name = stack.pop()[0]
        names[name] -= 1
        return name

    for pos, what, e in events:
        if pos > at:
            out.append((path(), text[at:pos]))
            at = pos
        if what == 0:
            if e in inner:
                del inner[len(inner) - 1 - inner[::-1].index(e)]
        elif what == 2:
            inner.append(e)
        elif e.start() >= at:
            at = e.end()
            n = _NAME.match(e[0])
            if not n:
                out.append((f"{path()}/comment", "\0comment"))
                continue
            name, closing = n[1].lower(), e[0][1] == "/"
            if closing:
                if names[name]:
                    while pop() != name:
                        pass
            elif name in VOID or e[0].endswith("/>"):
                out.append((f"{path()}/{name}", f"\0{name}"))
                continue
            else:
                if stack[-1][0] in _ENDS_ITSELF.get(name, ()):
                    pop()
                push(name)
            out.append((path(), "\0" + ("/" if closing else "") + name))
    if at < len(text):
        out.append((path(), text[at:]))
    return out


def is_marked(found: list[tuple[str, str]]) -> bool:
    """Has the text a node below the root? An end tag whose element was never opened is one too."""
    return any(path != "root" or piece[:1] == "\0" for path, piece in found)


def dialects(found: list[tuple[str, str]]) -> list[str]:
    """The kinds of markup that nodes belong to."""
    names = {n for path, piece in found for n in (*path.split("/")[1:], *([piece[1:]] if piece[:1] == "\0" else []))}
    prefixes = {n.split(":")[0] if n[:3] in ("md:", "tex") or n[:5] == "wiki:" else "html" for n in names}
    return [k for k, p in (("html", "html"), ("markdown", "md"), ("wiki", "wiki"), ("latex", "tex")) if p in prefixes]


# ------------------------------------------------------------------ ratios
SHARE = 0.01
_INLINE_NAMES = frozenset("b i strong em span font sub sup u s small big mark tt code kbd samp var cite abbr ins del strike time md:strong md:em md:code md:del wiki:b tex:cmd tex:char entity".split())
_LINKS = frozenset(("a", "md:a", "wiki:a"))
_STRUCTURE = frozenset("h1 h2 h3 h4 h5 h6 li td th tr caption figcaption dt dd pre code blockquote math md:h1 md:h2 md:h3 md:h4 md:h5 md:h6 md:li md:tr md:pre md:quote wiki:h wiki:table tex:h tex:li tex:math tex:env".split())
_ASIDE = frozenset("nav footer aside button select option form menu".split())


def leaf(path: str) -> str:
    """The path of a node's block: without inline elements at its end; links stay as leaves."""
    parts = path.split("/")
    link = ""
    while len(parts) > 1 and (parts[-1] in _INLINE_NAMES or parts[-1] in _LINKS):
        link = link or parts[-1] * (parts[-1] in _LINKS)
        parts.pop()
    return "/".join([*parts, *([link] if link else [])])


_BARE = "-+*#>|`=:'[]! "


def statistics(found: list[tuple[str, str]]) -> dict[str, list[int]]:
    """Path -> lines of text, characters, punctuation, characters in links. A link within a block with words of its own belongs to the block."""
    out: dict[str, list[int]] = {}
    for path, piece in found:
        if piece[:1] == "\0":
            continue
        p = leaf(path)
        for line in piece.split("\n"):
            if (x := line.strip()) and (p == "root" or x.strip(_BARE)):  # the sign of an item alone is no text
                c = out.setdefault(p, [0, 0, 0, 0])
                c[0] += 1
                c[1] += len(x)
                c[2] += len(_PUNCT.findall(x))
                c[3] += len(x) * (p.rpartition("/")[2] in _LINKS)
    for p in [p for p in out if p.rpartition("/")[2] in _LINKS]:
        block = p.rpartition("/")[0]
        if block in out:
            out[block] = [a + b for a, b in zip(out[block], out.pop(p), strict=True)]
    return out


#: Weights of a path's parent and children (one step of the tree away) and of its siblings (two) beside its own 1: exp(-steps ** 2).
NEAR, FAR = math.exp(-1), math.exp(-4)


def exempt(path: str) -> bool | None:
    """True: content whatever the ratio; False: never content; None: the ratio decides."""
    names = path.split("/")[1:]
    if not SILENT.isdisjoint(names) or "comment" in names:
        return False
    if not names:
        return True
    if names[-1] in _LINKS or not _ASIDE.isdisjoint(names):
        return None
    return True if names[-1] in _STRUCTURE or any(n in ("pre", "code", "md:pre", "math") for n in names) else None


def ratio(length: float, punctuation: float, linked: float) -> float:
    """The fused ratio of smoothed means per line: characters, punctuation, share of characters in links."""
    return length * (1 + punctuation) * (1 - 0.97 * linked)


def path_ratios(counts: dict[str, list[int]]) -> dict[str, float]:
    """Path -> fused ratio of its counts (as of ``statistics``)."""
    children: dict[str, list[str]] = {}
    for p in counts:
        children.setdefault(p.rpartition("/")[0], []).append(p)
    means = {p: (c[1] / c[0], c[2] / c[0], c[3] / c[1]) for p, c in counts.items()}
    sums = {up: [sum(means[p][f] for p in ps) for f in range(3)] for up, ps in children.items()}

    def smooth(p: str, f: int) -> float:
        up = p.rpartition("/")[0]
        below, beside = children.get(p, ()), len(children[up]) - 1
        total = means[p][f] + FAR * (sums[up][f] - means[p][f]) + NEAR * (sums[p][f] if below else 0.0)
        weight = 1 + FAR * beside + NEAR * len(below)
        if up in means:
            total, weight = total + NEAR * means[up][f], weight + NEAR
        return total / weight

    return {p: ratio(*(smooth(p, f) if f < 2 else means[p][f] for f in range(3))) for p in counts}


def content_paths(found: list[tuple[str, str]] | dict[str, list[int]], share: float = SHARE) -> set[str]:
    """The paths that hold content, by the counts of one text or of all texts of a source."""
    counts = found if isinstance(found, dict) else statistics(found)
    ratios = path_ratios(counts)
    least = share * sum(r * counts[p][0] for p, r in ratios.items()) / max(1, sum(c[0] for c in counts.values()))
    return {p for p, r in ratios.items() if (r >= least if (e := exempt(p)) is None else e)}


def dropped_paths(counts: dict[str, list[int]], share: float = SHARE) -> set[str]:
    return set(counts) - content_paths(counts, share)


# ------------------------------------------------------------------ plain text
_ARG = r"\{((?:[^{}\n]|\{[^{}\n]*\})*)\}"
_TEX_HEAD = re.compile(r"\\(?:part|chapter|(?:sub)*section|(?:sub)?paragraph|title)\*?" + _ARG)
_TEX_DROP = re.compile(r"\\(?:label|ref|cite|vspace|hspace|usepackage|documentclass|bibliography|includegraphics)\*?(?:\[[^\]\n]*\])?" + _ARG)
_TEX_ENV = re.compile(r"\\(?:begin|end)\{([A-Za-z*]+)\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?")
_TEX_BRACE = re.compile(r"\\[{}]|\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{|[{}]")
_TEX_BARE = re.compile(r"\\(?:" + "|".join(COMMANDS) + r")(?![A-Za-z])\s?")
_FORMULA = re.compile(r"\\\((.+?)\\\)|\\\[(.+?)\\\]|(?<!\w)\$\$?([^$\n]*[\\^_{=][^$\n]*)\$\$?")


def _unwrapped(line: str) -> str:
    """Commands replaced by their arguments, however deep they stand in each other, in one pass; what has no closing brace stays."""
    out: list[str] = []
    open_: list[int] = []  # places of the heads of commands, -1 for a brace of its own
    at = 0
    for m in _TEX_BRACE.finditer(line):
        out.append(line[at : m.start()])
        at = m.end()
        sign = m[0]
        if sign == "}" and open_ and (head := open_.pop()) >= 0:
            out[head] = ""
            continue
        if sign[-1] == "{" and sign != "\\{":
            open_.append(-1 if sign == "{" else len(out))
        out.append(sign)
    return "".join(out) + line[at:]


def _tex(line: str, head: str) -> str:
    if "\\" not in line and "$" not in line:
        return line
    held: list[str] = []

    def hold(m: re.Match) -> str:
        held.append(next(g for g in m.groups() if g is not None))
        return f"\1{len(held) - 1}\2"

    line = _FORMULA.sub(hold, line)
    line = _TEX_ENV.sub("", line)
    line = _TEX_DROP.sub("", line)
    line = _TEX_HEAD.sub(lambda m: head + m[1], line)
    line = re.sub(r"\\item(?![A-Za-z])(?:\[[^\]\n]*\])?\s?", "- " if head else "", line)
    line = re.sub(r"\\footnote" + _ARG, r"（\1）" if head else "", line)
    line = _unwrapped(line)
    line = _TEX_BARE.sub("", line)
    line = re.sub(r"\\([%&_#${}])", r"\1", line)
    line = re.sub(r"\\\\[ \t]*(?=\r?$)", "", line)
    return re.sub("\1(\\d+)\2", lambda m: f"${held[int(m[1])]}$" if head else held[int(m[1])], line)


def _wiki(line: str, head: str) -> str:
    m = re.match(r"^([ \t　]*)(={2,6})[ \t]*([^=\n].*?)[ \t]*\2([ \t\r]*)$", line)
    if m:
        line = m[1] + head + m[3] + m[4]
    if "[[" in line:
        line = re.sub(r"\[\[(?:File|Image|文件|图像):[^\]\n]*\]\]", "", line)
        line = re.sub(r"\[\[(?:[^|\]\n]*\|)?([^\]\n]*)\]\]", r"\1", line)
    if "{{" in line:
        line = re.sub(r"\{\{([^{}\n]*)\}\}", lambda m: m[1].split("|")[-1] if "|" in m[1] and "=" not in m[1].split("|")[-1] else "", line)
    if "''" in line:
        line = re.sub(r"'{2,5}([^'\n]+)'{2,5}", r"\1", line)
    line = re.sub(r"\[https?://[^\s\]]+[ \t]*([^\]\n]*)\]", r"\1", line)
    return re.sub(r"__(?:TOC|NOTOC)__", "", line)


def _markdown(line: str, head: str, wiki: bool) -> str:
    if re.match(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*\|[-:| \t]*\r?$", line) or re.match(r"^\{\||^\|\}|^\|-", line):
        return ""
    end = "\r" if line.endswith("\r") else ""
    if re.match(r"^[ \t　]*\|.*\|[ \t\r]*$", line):
        cells = [c.strip() for c in line.strip().strip("|").split("|")]
        line = (" | " if head else " ").join(cells) + end
    line = re.sub(r"^([ \t　]*)#{2,6} +(?=\S)", lambda m: m[1] + head, line)
    if not wiki:
        line = re.sub(r"^([ \t　]*)# +(?=\S)", lambda m: m[1] + head, line)
    line = re.sub(r"^([ \t　]*)> ?(?=[^\s>])", r"\1", line)
    line = re.sub(_BULLET, "- " if head else "", line)
    line = re.sub(r"^((?:- )?)\[[ xX]\] ", r"\1", line)
    line = re.sub(r"!\[([^\]\n]*)\]\([^)\n]*\)", "", line)
    line = re.sub(r"\[([^\]\n]*)\]\([^)\n]*\)", r"\1", line)
    line = re.sub(r"`+([^`\n]+)`+", r"\1", line)
    for _ in range(2):
        line = re.sub(r"\*{2,3}([^*\s][^*\n]*?)\*{2,3}|(?<![\w*])\*([^\s*][^*\n]*)\*(?![\w*])|__([^_\s][^_\n]*)__|(?<![\w_])_([^_\s][^_\n]*)_(?![\w_])|~~([^~\n]+)~~", lambda m: next(g for g in m.groups() if g is not None), line)
    return line


_SIGN = re.compile(r"[*_`~\\$\[{|<>&#=+'-]")


def _entities(line: str) -> str:
    return re.sub(_ENTITY, lambda m: html.unescape(m[0]).replace("\xa0", " "), line) if "&" in line else line


def _lines(text: str, head: str) -> str:
    out, fence = [], False
    wiki = bool(_WIKI.search(text))  # there a single # begins an item of a list
    for line in text.split("\n"):
        if re.match(r"^[ \t　]*```", line):
            fence = not fence
            out.append("")
        elif fence:
            out.append("    " + line if head else line)
        else:
            out.append(_entities(_markdown(_wiki(_tex(line, head), head), head, wiki)) if _SIGN.search(line) else line)
    return "\n".join(out).replace("\3", "# ")


def plain_text(text: str | None, marks: bool = True, dropped: Iterable[str] | None = None) -> str | None:
    """The text without markup. dropped: paths that are no content (by default, those of this text alone). ``marks=False`` drops the signs of structure too and keeps every line where it stands (for comparing texts)."""
    if not text or not kinds(text, not marks):
        return text
    head = "\3" if marks else ""
    if not marks:
        text = re.sub(f"{_COMMENT}|{_TAG}", lambda m: "\n" * m[0].count("\n"), text, flags=re.I | re.S)
        return _lines(text, head)
    found = nodes(text)
    counts = statistics(found)
    gone = dropped_paths(counts) if dropped is None else {p for p in counts if exempt(p) is False}.union(dropped)
    memo: dict[str, bool] = {}

    def stays(path: str) -> bool:
        """By the path of its block; a link goes with its block where that has words of its own."""
        if path not in memo:
            p = leaf(path)
            if p not in counts and p.rpartition("/")[2] in _LINKS:
                p = p.rpartition("/")[0]
            memo[path] = p not in gone
        return memo[path]

    out: list[str] = []
    pre = 0
    for path, piece in found:
        if piece[:1] == "\0":
            name = piece[1:]
            closing, bare = name[0] == "/", name.lstrip("/")
            pre += (bare == "pre") * (-1 if closing else 1)
            if bare in ("td", "th"):
                if not closing and out and out[-1].strip() and not out[-1].endswith("\n"):
                    out.append(" | ")
            elif bare in BLOCK:
                if out and not "".join(out[-2:]).endswith("\n") and (closing or "".join(out[-2:]).strip()):
                    out.append("\n")
                if not closing and re.fullmatch(r"h[1-6]", bare):
                    out.append("\3")
                elif not closing and bare == "li":
                    out.append("- ")
        elif not piece.strip() or stays(path):
            fresh = not out or out[-1].endswith("\n")  # a line of code begins here
            out.append(("    " if fresh else "") + piece.replace("\n", "\n    ") if pre > 0 else piece)
    text = "".join(out)
    if gone:
        text = re.sub(r"^[ \t]*[-+*][ \t]*(?:\r?\n|\Z)", "", text, flags=re.M)  # items whose link has gone
    return re.sub(r"\n{3,}", "\n\n", _lines(text, head))
