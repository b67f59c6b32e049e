"""Notes -> opinion blocks, one per product and note.

The block structure of a note is order-dependent (headings at several levels, continuations, merges), so this one operator is
Python, streamed over Arrow batches: a note in, an array of blocks out. Headings are told by small parsers of a line; a note is
then one pass over its blocks, in which each block opens views on products or goes on with the open ones; the driver never sees a text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bullgauge import lexicon
from bullgauge.functions.products import find
from bullgauge.settings import DEFAULT, Settings

# The words by which headings, labels and legal text are told.
LEGAL_BLOCK = ("免责声明", "分析师声明", "版权所有", "不构成投资建议", "据此操作，风险自担", "投资咨询业务资格", "证监许可", "期货从业资格", "本报告的著作权", "联系我们", "客服电话", "风险自担", "风险自负", "自行承担", "概不负责", "不承担任何", "仅供参考", "据此入市", "请投资者", "投资者应当", "风险提示如下")
WARRANTY = ("不保证", ("准确", "完整", "可靠"))  # the one, then one of the others within 6 characters
LEGAL_ADVICE = ("风险自担", "风险自负", "自行承担", "自担风险", "概不负责", "不承担", "不保证", "不构成", "仅供参考", "据此操作", "据此入市", "请投资者", "投资者应", "谨慎决策", "市场有风险", "入市需谨慎")
LEGAL_HEADS = ("免责声明", "重要声明", "法律声明", "特别声明", "分析师声明", "免责条款", "版权声明")
HEADER_WORDS = ("日报", "周报", "晨报", "晨会", "早评", "月报", "专题报告", "研究所", "发布时间", "发布日期", "投资咨询号", "分析师:", "分析师：")
MACRO_WORDS = ("宏观", "综述", "概述", "总览", "汇总", "要闻", "资讯", "市场", "大盘", "大势", "摘要", "导读", "热点", "焦点", "金融", "海外", "全球")
ADVICE_HINTS = ("建议", "策略", "思路", "操作", "为主", "持有", "观望")
WEAK_LABELS = ("建议", "策略", "观点", "操作上", "思路", "展望", "小结", "总结")
ORNAMENTS = "★☆●•·◆■※-—–*#>》、,，。:："
NUMERALS = "一二三四五六七八九十"
SENTENCE_ENDS = "。！？；!?;\n"

_COLON = ":："
_TITLE_ENDS = frozenset("，,。：:；;（(")


# ------------------------------------------------------------------ words
def _says(words: tuple[str, ...]) -> Callable[[str], object]:
    """Does a text hold one of the words?"""
    return re.compile("|".join(map(re.escape, words))).search


_legal_word, _legal_advice, _header_word, _macro_word, _hint = map(_says, (LEGAL_BLOCK, LEGAL_ADVICE, HEADER_WORDS, MACRO_WORDS, ADVICE_HINTS))
_strong_labels = re.compile("(?<!构成)(?:" + lexicon.ADVICE_LABELS + ")")
_weak_labels = re.compile("|".join(WEAK_LABELS))


def is_legal(text: str) -> bool:
    if _legal_word(text):
        return True
    word, claims = WARRANTY
    places = (m.end() for m in re.finditer(word, text))
    return any(text.startswith(claims, k) for at in places for k in range(at, at + 7) if "\n" not in text[at:k])


# ------------------------------------------------------------------ sentences and advice
def sentences(text: str) -> list[str]:
    """Sentences with their end marks; a line feed ends one too."""
    cuts = [k + 1 for k, c in enumerate(text) if c in SENTENCE_ENDS]
    return [x for a, b in pairwise([0, *cuts, len(text)]) if (x := text[a:b].strip())]


def tidy(text: str, size: int) -> str:
    """Without ornaments in front, with single blanks, cut to size."""
    bare = text.strip()
    while bare and (bare[0] in ORNAMENTS or bare[0].isspace()):
        bare = bare[1:]
    return " ".join(bare.split())[:size]


def _lawful(parts: list[str]) -> list[str]:
    return [x for x in parts if not _legal_advice(x)]


def _labels(text: str, strong: bool) -> list[int]:
    """Where what the advice labels announce begins, the last label first. A weak label needs a colon, a strong one may have it."""
    out = []
    for m in (_strong_labels if strong else _weak_labels).finditer(text):
        rest = text[m.end() :].lstrip()
        colon = rest[:1] != "" and rest[0] in _COLON
        if strong or colon:
            out.append(len(text) - len((rest[1:] if colon else rest).lstrip()))
    return out[::-1]


def advice_of(text: str, s: Settings = DEFAULT) -> str:
    """The advice of a block: after the last strong label, else the last weak one, else the last sentence with a hint, else the last; legal sentences never count."""
    for at in (*_labels(text, True), *_labels(text, False)):
        said = sentences(text[at:])
        short = said[:1] and len(said[0]) < 6  # a word or two go on in the next sentence
        first = tidy("".join(said[: 1 + bool(short)]), s.max_advice_len)
        if kept := tidy("".join(_lawful(sentences(first))), s.max_advice_len):
            return kept
    said = _lawful(sentences(text))
    hinted = list(filter(_hint, said))
    return tidy((hinted or said or [""])[-1], s.max_advice_len)


# ------------------------------------------------------------------ headings
def _bracketed(line: str) -> tuple[str, str] | None:
    """(title in brackets at the beginning of a line, what follows)."""
    x = line.lstrip()
    if x[:1] not in ("【", "[", "［"):
        return None
    close = min((k for c in "】]］" if (k := x.find(c)) > 0), default=0)
    title = x[1:close].strip()
    return (title, x[close + 1 :].strip()) if 0 < len(title) <= 20 else None


def _by_bracket(line: str, s: Settings) -> str:
    """A title that names a product stands for itself; another is told by the word after it, too."""
    if not (got := _bracketed(line)):
        return ""
    title, rest = got
    if find(title):
        return title
    end = next((k for k, c in enumerate(rest) if c in _TITLE_ENDS or c.isspace()), len(rest))
    return f"{title} {rest[:end][: s.max_title_tail].strip()}".strip()


def _by_hashes(line: str, s: Settings) -> str:
    x = line.lstrip()
    title = x.lstrip("#")
    level = len(x) - len(title)
    if not 1 <= level <= 6 or not title[:1].isspace():
        return ""
    title = title.lstrip()
    return title.strip(" #") if 1 <= len(title) <= 61 else ""


def _by_number(line: str, s: Settings) -> str:
    """After a number with its sign: 一、 (二) 3."""
    x = line.lstrip()
    framed = x[:1] in ("（", "(")
    body = x[framed:]
    is_digit = lambda c: c.isdecimal() or framed and c in NUMERALS
    kind = is_digit if framed or body[:1].isdecimal() else NUMERALS.__contains__
    n = next((k for k, c in enumerate(body) if not kind(c)), len(body))
    ends = "）)" if framed else "、．.)" if kind is is_digit else "、．."
    if not 1 <= n <= (2 if kind is is_digit and not framed else 3) or body[n : n + 1] not in tuple(ends):
        return ""
    title = body[n + 1 :].lstrip()
    return title.strip() if 1 <= len(title) <= 31 else ""


#: Levels of headings, the strongest first.
LEVELS = (_by_bracket, _by_hashes, _by_number)


@dataclass(frozen=True)
class Block:
    anchor: str
    text: str


def _preamble(lines: list[str], s: Settings) -> list[Block]:
    """What stands before the first heading, without title lines; kept only if it is long enough to be a summary."""
    if is_legal("\n".join(lines)):
        return []
    rest = [x for x in lines if x.strip()]
    begin = next((k for k, x in enumerate(rest) if not _header_word(x) and len(x.strip()) >= 20), len(rest))
    body = "\n".join(rest[begin:]).strip()
    return [Block("", body)] if len(body) >= s.min_preamble_len else []


def _by_paragraph(text: str, s: Settings) -> list[Block]:
    """Without headings, a paragraph on exactly one product, and another than before, begins a block."""
    paragraphs = [x for x in map(str.strip, text.split("\n")) if x]
    alone = [named[0] if len(named := find(x)) == 1 else None for x in paragraphs]
    about = [None, *accumulate(alone, lambda now, own: own or now)]
    begins = [k for k, own in enumerate(alone) if k == 0 or own and own != about[k]]
    cut = [*begins, len(paragraphs)]
    return [Block(paragraphs[a][: s.max_title_tail] if alone[a] else "", "\n".join(paragraphs[a:b])) for a, b in pairwise(cut)]


def blocks(text: str, s: Settings = DEFAULT) -> list[Block]:
    """The strongest level of headings of which there are at least two cuts the note."""
    lines = text.split("\n")
    for level in LEVELS:
        heads = {k: title for k, x in enumerate(lines) if (title := level(x, s))}
        if len(heads) > 1:
            cut = pairwise([*heads, len(lines)])
            found = [Block(heads[a], body) for a, b in cut if (body := "\n".join(lines[a:b]).strip())]
            return _preamble(lines[: min(heads)], s) + found
    return _by_paragraph(text, s)


def products_of(block: Block, s: Settings = DEFAULT) -> tuple[tuple[str, ...], bool]:
    """(products, told by the heading). A heading decides; else a product counts if the first sentence or two sentences name it, and too many are none."""
    if titled := block.anchor and find(block.anchor):
        return titled, True
    if block.anchor and _macro_word(block.anchor):
        return (), False
    named = sorted((k, c) for k, x in enumerate(sentences(block.text)) for c in find(x))
    first = {c: k for k, c in reversed(named)}
    again = {c for k, c in named if k != first[c]}
    kept = sorted((c for c, k in first.items() if k == 0 or c in again), key=lambda c: (first[c], c))
    return tuple(kept if len(kept) <= s.max_body_products else ()), False


def own_parts(block: Block, named: tuple[str, ...]) -> dict[str, str] | None:
    """The text of each product of a heading if every paragraph speaks of at most one and each has one; what comes before the first is shared."""
    head, *rest = [x for x in block.text.split("\n") if x.strip()] or [""]
    pairs = [(k, c) for k, x in enumerate(rest) for c in find(x) if c in named]
    owner = dict(pairs)
    if len(rest) < 2 or len(owner) < len(pairs) or set(owner.values()) != set(named):
        return None
    belongs = list(accumulate((owner.get(k) for k in range(len(rest))), lambda now, own: own or now))
    return {c: "\n".join([head, *(x for x, o in zip(rest, belongs, strict=True) if o in (None, c))]) for c in named}


# ------------------------------------------------------------------ one note
@dataclass
class View:
    """What a note says on one product (None: macro)."""

    code: str | None
    texts: list[str]
    advice: str
    titled: bool = False

    def go_on(self, text: str, advice: str) -> None:
        self.texts[-1] += "\n" + text
        self.advice = advice or self.advice

    def merge(self, later: View) -> None:
        """A later part speaks for both unless this one has a better claim: a heading, then an advice."""
        self.texts += later.texts
        one, two = (self, later) if (self.titled, bool(self.advice)) > (later.titled, bool(later.advice)) else (later, self)
        self.titled, self.advice = one.titled, one.advice or two.advice


@dataclass
class Views:
    """The views of a note in order of first appearance; those of the last block are open, as a block without a product may go on with them."""

    done: dict[str | None, View] = field(default_factory=dict)
    open: list[View] = field(default_factory=list)
    any_product: bool = False

    def begin(self, views: list[View]) -> None:
        for v in self.open:
            if v.code in self.done:
                self.done[v.code].merge(v)
            else:
                self.done[v.code] = v
        self.open = views
        self.any_product |= any(v.code for v in views)


def _shared(named: tuple[str, ...], body: str) -> str:
    names = "、".join(lexicon.BY_CODE[c].name for c in named)
    return f"[多品种合并块｜{len(named)} 个品种：{names}｜以下原文为这些品种共享，未能按段落拆开]\n{body}"


def _read(b: Block, views: Views, s: Settings) -> None:
    body = b.text.strip()
    named, titled = products_of(b, s)
    if not body or not titled and is_legal(body):
        return
    if named:
        parts = own_parts(b, named) if titled and len(named) > 1 else None
        whole = _shared(named, body) if len(named) > 1 else body
        texts = parts or dict.fromkeys(named, whole)
        views.begin([View(c, [texts[c]], advice_of(parts[c] if parts else body, s), titled) for c in named])
    elif len(body) >= s.min_macro_len:
        if not views.any_product or b.anchor and _macro_word(b.anchor):
            views.begin([View(None, [body], advice_of(body, s))])
        elif views.open and views.open[0].code:
            advice = advice_of(body, s) if _strong_labels.search(body) else ""
            for v in views.open:
                v.go_on(body, "" if _legal_advice(advice) else advice)


def _without_legal_end(text: str) -> str:
    """Cut at the first legal heading after three tenths of the text; blank lines before it go with it."""
    at = begin = 0
    for line in text.split("\n"):
        x = line.strip()
        if x:
            x = x[1:].lstrip() if x[0] in "【[［" else x
            if begin > len(text) * 0.3 and x.startswith(LEGAL_HEADS):
                return text[:begin].strip()
        at += len(line) + 1
        if x:
            begin = at
    return text


def segment(text: str | None, s: Settings = DEFAULT) -> list[dict]:
    """The blocks of a note in order of first appearance; [] for null and blank ones."""
    text = _without_legal_end((text or "").strip())
    views = Views()
    for b in blocks(text, s) if text else []:
        _read(b, views, s)
    views.begin([])
    out = []
    for seq, v in enumerate(views.done.values()):
        p = lexicon.BY_CODE.get(v.code or "")
        raw = "\n\n".join(v.texts)
        out.append({"product_code": v.code, "product_name": p and p.name, "sector": p and p.sector, "raw_text": raw, "advice_text": v.advice or advice_of(raw, s), "seq": seq})
    return out


# ------------------------------------------------------------------ in the cluster
_BLOCK = pa.list_(pa.struct([("product_code", pa.string()), ("product_name", pa.string()), ("sector", pa.string()), ("raw_text", pa.string()), ("advice_text", pa.string()), ("seq", pa.int32())]))


def segment_notes(notes: DataFrame, key: str, text: str, s: Settings = DEFAULT) -> DataFrame:
    """key, product_code, product_name, sector, raw_text, advice_text, seq: a row per block."""
    kind = notes.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([segment(t, s) for t in b.column(1).to_pylist()], _BLOCK)
            yield pa.record_batch([b.column(0), found], names=["key", "found"])

    schema = f"key {kind}, found array<struct<product_code:string,product_name:string,sector:string,raw_text:string,advice_text:string,seq:int>>"
    return notes.select(key, text).mapInArrow(run, schema).select(F.col("key").alias(key), F.inline("found"))
