"""Text decoded with the wrong character encoding: find the spans and restore them.

Method: the garbled sequence of every character of a reference vocabulary (the characters of GB 2312, of the first level of Big5, of
JIS and KS X 1001 syllables, letters of further scripts, signs of print) is precomputed for every encoding pair
(written in -> read as) of ``PAIRS``. One multi-pattern automaton finds these sequences in a line; only pairs
that the automaton reports are tried, and only the spans around its hits are decoded again. Text
outside these spans stays as it is.

UTF-8 read as GBK shares a byte between two characters: there a sequence is a character's first two bytes and its last one with each
possible first byte of the next. Where both codes have two bytes a character, a sequence is one character, taken if ordinary
text lacks it. A byte that UTF-8 could not read is U+FFFD, a sequence of its own.

A span is restored only if the restored text, written and read again in the same way, gives the span. Of several pairs
that fit, the one with the more ordinary text wins.

Defined results: a null text gives a null text and no case; an empty text stays empty; text without
a garbled sequence is returned as the same object; a byte that the wrong decoder threw away becomes
U+FFFD unless only one value of it is possible.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache
from operator import itemgetter

import ahocorasick

LOST = "�"
PUNCT = "，。：；、？！（）【】《》〈〉「」『』“”‘’…—·～％＋－／＝×÷°℃￥±‰→★●○◆■□▲△　"
LATIN = "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿšŠžŽœŒ"
SIGNS = "«»§©®°±²³µ¶·¹º¼½¾¿×÷€£¥¢–—‘’“”„•…†‡‰‹›™"


def _gb2312(first: int, last: int) -> str:
    return "".join(bytes([a, b]).decode("gb2312", "ignore") for a in range(first, last + 1) for b in range(0xA1, 0xFF))


@lru_cache(1)
def common_han() -> frozenset[str]:
    """Level 1 of GB 2312: the everyday characters."""
    return frozenset(_gb2312(0xB0, 0xD7))


def _rows(codec: str, first: int, last: int, trail: range) -> str:
    return "".join(bytes([a, b]).decode(codec, "ignore") for a in range(first, last + 1) for b in trail)


@lru_cache(1)
def traditional() -> frozenset[str]:
    """Level 1 of Big5: the everyday traditional characters."""
    return frozenset(c for c in _rows("big5", 0xA4, 0xC6, range(0x40, 0xFF)) if c >= "\u3400")


@lru_cache(1)
def other_scripts() -> frozenset[str]:
    """Kana and Hangul of the Japanese and Korean codes, and the letters of alphabets that have a code page."""
    kana = _rows("euc_jp", 0xA4, 0xA5, range(0xA1, 0xFF))
    hangul = _rows("euc_kr", 0xB0, 0xC8, range(0xA1, 0xFF))
    letters = "".join(bytes(range(0x80, 0x100)).decode(c, "ignore") for c in ("cp1251", "cp1253", "cp1255", "cp1256", "cp874", "cp1250", "cp1258"))
    return frozenset(c for c in kana + hangul + letters if c.isalpha() and c >= "\u0100")


@lru_cache(1)
def vocabulary() -> frozenset[str]:
    """The characters of Chinese print."""
    return frozenset(_gb2312(0xB0, 0xF7)) | frozenset(PUNCT + LATIN + SIGNS) | frozenset(_gb2312(0xA1, 0xA3))


def _single_byte(codec: str) -> dict[int, str]:
    """Character -> its byte (as a character below 256); undefined bytes pass through as C1 controls."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            table[ord(bytes([b]).decode(codec))] = chr(b)
        except UnicodeDecodeError:
            pass
    return table


SINGLE = ("cp1252", "cp1251", "cp437", "koi8_r")


@lru_cache(1)
def _tables() -> dict[str, dict[int, str]]:
    latin = {c: chr(c) for c in range(0x80, 0x100)}
    controls = {c: chr(c) for c in range(0x80, 0xA0)}
    return {"cp1252": latin | _single_byte("cp1252"), "cp1251": controls | _single_byte("cp1251") | {0x98: "\x98"}, "cp437": _single_byte("cp437"), "koi8_r": _single_byte("koi8_r")}


@lru_cache(4)
def _double_byte(codec: str) -> dict[str, str]:
    """Character -> its two bytes (as characters below 256) in a double-byte code."""
    table = {}
    for a in range(0x81, 0xFF):
        for b in [*range(0x40, 0x7F), *range(0x80, 0xFF)]:
            c = bytes([a, b]).decode(codec, "ignore")
            if len(c) == 1:
                table.setdefault(c, chr(a) + chr(b))
    return table


#: (written in, read as); the order settles ties.
PAIRS = [
    ("utf-8", "cp1252"), ("utf-8", "cp1251"), ("utf-8", "gbk"), ("gbk", "cp1252"), ("gbk", "big5"), ("big5", "gbk"), ("big5", "cp1252"), ("gbk", "utf-8"),
    ("utf-8", "cp437"), ("utf-8", "koi8_r"), ("gbk", "cp1251"), ("big5", "cp1251"), ("gbk", "cp437"),
]

_UTF8 = r"(?:[\xe0-\xef](?:[\x80-\xbf]|�){2}|[\xc2-\xdf][\x80-\xbf�]|[\xf0-\xf4][\x80-\xbf]{3})"
_SPAN = {
    "utf-8": re.compile(_UTF8 + r"(?:[\xa0 ]?" + _UTF8 + r")*(?:[\xe2-\xe9\xef](?:[\x80-\xbf�]|$))?"),
    "gbk": re.compile(r"(?:[\x81-\xfe�](?:[\xa1-\xfe]|[\x40-\x7e\x80-\xa0�](?=[\xa1-\xfe]|$)))+"),
    "big5": re.compile(r"(?:[\xa1-\xf9](?:[\x40-\x7e\xa1-\xfe]))+"),
}


def _read(raw: str, written: str) -> str:
    """Bytes held as characters below 256 -> text. A lost byte is one that begins no GBK pair with the byte after it; where no everyday character fits, the character stays lost."""
    if LOST not in raw:
        return raw.encode("latin-1").decode(written, "replace")
    if written != "utf-8":
        out, i = [], 0
        while i < len(raw):
            two = raw[i : i + 2]
            if LOST in two or len(two) < 2:
                out.append(LOST)
            else:
                out.append(two.encode("latin-1").decode(written, "replace"))
            i += 2
        return "".join(out)

    def unit(m: re.Match) -> str:
        s = m[0]
        if LOST not in s:
            try:
                return s.encode("latin-1").decode("utf-8")
            except UnicodeDecodeError:
                return LOST
        if s.count(LOST) > 1:
            return LOST
        k = s.index(LOST)
        after = s[k + 1 : k + 2] or raw[m.end() : m.end() + 1]
        if after in ("", LOST) or after < "\x80":
            return "。" if s == "\xe3\x80" + LOST else LOST  # the other signs of this row hardly end a line
        fits = []
        for b in [*range(0x81, 0xC0), 0x80]:
            if chr(b) + after not in _valid_gbk():
                c = (s[:k] + chr(b) + s[k + 1 :]).encode("latin-1").decode("utf-8", "replace")
                if c in common_han() or c in PUNCT or c in LATIN:
                    fits.append(c)
        return min(fits, key=_rank) if fits else LOST

    return re.sub(_UTF8 + r"|[^\x00-\x7f]+", unit, raw)


_LATIN_SIGNS = frozenset(LATIN + SIGNS)


def _sequences() -> dict[str, set[tuple[str, str]]]:
    """Garbled sequence -> the pairs that give it."""
    found: dict[str, set[tuple[str, str]]] = {}
    for written in dict.fromkeys(w for w, _ in PAIRS):
        words = vocabulary() | (traditional() if written != "gbk" else frozenset()) | (other_scripts() if written == "utf-8" else frozenset())
        raws = [(c, raw.decode("latin-1")) for c in words if len(raw := c.encode(written, "ignore")) > 1]
        for read in (r for w, r in PAIRS if w == written and r in SINGLE):
            tables = [{ord(v): k for k, v in _tables()[read].items()}]
            if read == "cp1252":  # read as Latin-1, all of it C1 controls, or as the code page
                tables = [{}, {ord(v): k for k, v in _single_byte("cp1252").items()}]
            pair = (written, read)
            latin = written == "big5" or read in ("cp437", "koi8_r")
            for c, raw in raws:
                if c in _LATIN_SIGNS and (latin or written != "utf-8" and c in SIGNS and c not in PUNCT):
                    continue
                for t in tables:
                    found.setdefault(raw.translate(t), set()).add(pair)
    # UTF-8 read as GBK: two bytes of a character, then its last byte and the first of what follows
    two = {v: k for k, v in _double_byte("gbk").items()}
    nexts = [chr(b) for b in (*range(0xE2, 0xEA), 0xEF)]
    for c in vocabulary() | traditional():
        raw = c.encode("utf-8").decode("latin-1")
        if len(raw) == 3 and (head := two.get(raw[:2])):
            for n in nexts:
                if tail := two.get(raw[2] + n):
                    found.setdefault(head + tail, set()).add(("utf-8", "gbk"))
            found.setdefault(head + LOST, set()).add(("utf-8", "gbk"))
    # one two-byte code read as the other: characters that ordinary text lacks
    for c in _odd("big5", "gbk"):
        found.setdefault(c, set()).add(("gbk", "big5"))
    for c in _odd("gbk", "big5"):
        found.setdefault(c, set()).add(("big5", "gbk"))
    found.setdefault(LOST, set()).add(("gbk", "utf-8"))
    return found


@lru_cache(2)
def _odd(read: str, written: str) -> frozenset[str]:
    """Characters of a two-byte code which the bytes of everyday characters of another give and which Chinese print lacks."""
    known = vocabulary()
    out = set()
    for c, two in _double_byte(read).items():
        if c > "\u3100" and c not in known:
            was = two.encode("latin-1").decode(written, "ignore")
            if len(was) == 1 and (read == "gbk" or was in known and ord(two[1]) >= 0xA1):
                out.add(c)
    return frozenset(out)


@lru_cache(1)
def automaton() -> tuple[ahocorasick.Automaton, list[tuple[int, tuple[tuple[str, str], ...]]]]:
    """The automaton, whose values are numbers, and for each number the length of a sequence and its pairs."""
    a = ahocorasick.Automaton()
    number: dict[tuple, int] = {}
    for g, pairs in _sequences().items():
        a.add_word(g, number.setdefault((len(g), tuple(sorted(pairs))), len(number)))
    a.make_automaton()
    return a, list(number)


def _hits(line: str) -> dict[tuple[str, str], int]:
    """Characters in sequences of each pair."""
    a, kinds = automaton()
    tried: dict[tuple[str, str], int] = {}
    for k, times in Counter(map(itemgetter(1), a.iter(line))).items():
        n, pairs = kinds[k]
        for p in pairs:
            tried[p] = tried.get(p, 0) + n * times
    return tried


#: Frequent characters of modern Chinese, most frequent first; settles which of several fitting characters lost a byte.
FREQUENT = "的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里用道行所然家种事成方多经么去法学如都同现当没动面起看定天分还进好小部其些主样理心她本前开但因只从想实日军者意无力它与长把机十民第公此已工使情明性知全三又关点正业外将两高间由问很最重并物手应战向头文体政美相见被利什二等产或新己制身果加西斯月话合回特代内信表化老给世位次度门任常先海通教儿原东声提立及比员解水名真论处走义各入几口认条平系气题活尔更别打女变四神总何电数安少报才结反受目太量再感建务做接必场件计管期市直德资命山金指克许统区保至队形社便空决治展马科司五基眼书非则听白却界达光放强即像难且权思王象完设式色路记南品住告类求据程北边死张该交规万取拉格望觉术领共确传师观清今切院让识候带导争运"


def _rank(c: str) -> int:
    return FREQUENT.find(c) % 10_000


@lru_cache(1)
def _valid_gbk() -> frozenset[str]:
    return frozenset(_double_byte("gbk").values())


@lru_cache(1)
def _gbk_classes() -> tuple[re.Pattern, re.Pattern]:
    """Byte classes of UTF-8 read as GBK: A two leading bytes, B a last and a next leading byte, C two last bytes."""
    kind: dict[str, list[str]] = {"A": [], "B": [], "C": []}
    for c, two in _double_byte("gbk").items():
        a, b = map(ord, two)
        if a in (*range(0xE2, 0xEA), 0xEF) and 0x80 <= b <= 0xBF:
            kind["A"].append(c)
        elif 0x80 <= a <= 0xBF and b in (*range(0xE2, 0xEA), 0xEF):
            kind["B"].append(c)
        elif 0x80 <= a <= 0xBF and 0x80 <= b <= 0xBF:
            kind["C"].append(c)
    x = {k: "[" + re.escape("".join(sorted(v))) + "]" for k, v in kind.items()}
    run = re.compile(f"{x['A']}(?:{x['B']}{x['C']}|{x['B']}{LOST}|{LOST}{x['A']}|{LOST}(?![{LOST}]))")
    return run, re.compile(r"[A-Za-z](?:脙|[" + "".join(bytes([0xC3, b]).decode("gbk", "ignore") for b in range(0x81, 0xBF)) + r"])[a-z]")


@lru_cache(1)
def _big5_runs() -> re.Pattern:
    """Characters of Big5 that GBK bytes of everyday characters give and that GB 2312 lacks."""
    return re.compile("[" + re.escape("".join(sorted(_odd("big5", "gbk")))) + "]")


#: A line without any of these is clean: two characters of a high code page side by side, a lost byte, an odd ideograph.
_HIGH = "\x80-\xff€‚ƒ„†‡ˆ‰Š‹ŒŽ•–˜™š›œžŸЀ-џҐґ№─-▟ıˆ˜ΓΘΣΦΩαδεπστφ∞∩≈≡≤≥⌐⌠⌡ⁿ₧√∂∆∏∑∫◊≠"


@lru_cache(1)
def suspect() -> re.Pattern:
    run, latin = _gbk_classes()
    return re.compile(f"[{_HIGH}]{{2}}|{LOST}|{run.pattern}|{latin.pattern}|(?:{_big5_runs().pattern}.?){{3}}|[ㄛㄩ﹝﹛銆锛]")


@lru_cache(1)
def _screens() -> tuple[re.Pattern, ...]:
    """What every suspect text holds, as patterns that begin with one class of characters each and so run at the speed of a scan."""
    run, latin = _gbk_classes()
    lead, rest = run.pattern[: run.pattern.index("](?:") + 1], run.pattern[run.pattern.index("](?:") + 4 :]
    last = rest[: rest.index("]") + 1][:-1] + LOST + "]"
    odd = _big5_runs().pattern
    row = "[" + latin.pattern[latin.pattern.index("脙") : latin.pattern.rindex("])[a-z]")].replace("|[", "") + "]"
    return tuple(map(re.compile, (f"[{_HIGH}][{_HIGH}]", f"[{LOST}ㄛㄩ﹝﹛銆锛]", lead + last, f"{odd}.?{odd}.?{odd}", row + "[a-z]")))


def is_suspect(text: str) -> bool:
    return not text.isascii() and any(p.search(text) for p in _screens()) and suspect().search(text) is not None


class _Weights(dict):
    """Character -> what it says for a restored span; characters that none may hold weigh against it."""

    def __init__(self, known: dict[str, int], written: str):
        super().__init__(known)
        self.written = written

    def __missing__(self, c: str) -> int:
        if c == LOST or c <= "\xa0" or c == "\xad":
            x = 0
        elif self.written == "utf-8":  # what is well-formed is hardly there by chance; but it must be a character
            x = 1 if unicodedata.category(c)[0] in "LMNPS" else -1_000_000
        else:  # rare ideographs of the code say nothing, signs speak against it
            x = 0 if "\u3400" <= c <= "\u9fff" else -1_000_000
        self[c] = x
        return x


@lru_cache(16)
def _weights(written: str, read: str) -> _Weights:
    if written == "utf-8" and read == "gbk":  # ordinary words are well-formed there, as letters of other scripts
        return _Weights(dict.fromkeys(vocabulary() | traditional(), 1) | dict.fromkeys(common_han(), 2), "gbk")
    common = traditional() if written == "big5" else common_han() | traditional() | other_scripts() if written == "utf-8" else common_han()
    known = vocabulary() | common
    if written == "big5":
        known -= common_han() - common  # simplified forms that Big5 has by chance
    return _Weights({c: 2 if c in common else 1 for c in known}, written)


def _good(text: str, written: str, read: str) -> tuple[int, int]:
    """Characters that speak for a restored span, and how many speak against it."""
    x = sum(map(_weights(written, read if read == "gbk" else "").__getitem__, text))
    minus = (999_999 - x) // 1_000_000 if x < 0 else 0
    return x + 1_000_000 * minus, minus


def _again(piece: str, new: str, written: str) -> bool:
    """Do the bytes of the restored text give the span's? A character cut off at the end, and bytes that the wrong decoder lost, cannot."""
    if LOST in piece:
        return True
    whole = new.rstrip(LOST)
    try:
        back = whole.encode(written).decode("latin-1")
    except UnicodeEncodeError:
        return False
    return piece.startswith(back) and len(piece) - len(back) < 4


def _spans(line: str, written: str, read: str) -> list[tuple[int, int, str]]:
    if read in ("gbk", "big5"):
        table = _double_byte(read)
        parts = [table.get(c, c if ord(c) < 0x80 or c == LOST else "Ā") for c in line]
        raw = "".join(parts)
        starts, at = [], 0
        for k, p in enumerate(parts):
            starts += [k] * len(p)
            at += len(p)
    else:
        raw, starts = line.translate({k: v for k, v in _tables()[read].items()}), None
    out = []
    for m in _SPAN[written].finditer(raw):
        a, b = m.span()
        if starts is not None:
            if a and starts[a] == starts[a - 1]:
                continue  # it begins inside a character
            a, b0 = starts[a], b
            b = starts[b0 - 1] + 1
            piece = raw[m.start() : m.end()]
            if b0 < len(raw) and starts[b0] == starts[b0 - 1]:
                piece += raw[b0]
        else:
            piece = m[0]
        new = _read(piece, written)
        if _again(piece, new, written):
            out.append((a, b, new))
    return out


def _accept(old: str, new: str, written: str, read: str, before: str, after: str) -> bool:
    plus, minus = _good(new, written, read)
    size = len(new)
    if all("─" <= c <= "▟" for c in old):
        return False  # the lines of a drawn table
    if written == "utf-8" and read == "cp1252":  # read twice, the first step gives signs and controls
        table, known = _tables()["cp1252"], vocabulary()
        if all(c < "\x80" or c in known or ord(c) in table for c in new):
            return True
    if minus > 0.1 * size or not plus:
        return False
    if written == "utf-8" and not any(c in vocabulary() for c in new):  # other scripts: a word at least
        return sum(c in other_scripts() or c in traditional() for c in new) >= (2 if any(c > "\u2fff" for c in new) else 3)
    if read == "gbk" and written == "utf-8":
        if size == 1 and new in LATIN:
            return before.isascii() and before.isalpha() and after.isascii() and after.isalpha()
        return "銆" in old or "锛" in old or len(old) >= 3 and plus >= 1.2 * size
    if written == "utf-8":
        return len(old) >= 3
    if read in SINGLE:
        if size == 1:  # one sign or letter of the rows that nobody writes side by side
            return read == "cp1252" and (new in LATIN and old[0] == "¨" or new in PUNCT and old[0] in "¡£")
        if read == "cp1251":  # Cyrillic words are pairs of such bytes too
            return plus >= 1.5 * size and size >= 3 and not old.isalpha()
        return plus >= 1.5 * size or size > 6 and plus >= 0.8 * size
    # double-byte read as another: many characters that nobody writes become everyday ones
    strange = _odd(read, written)
    odd = sum(c in strange for c in old)
    return odd >= 3 and odd >= 0.4 * len(old) and plus >= 1.5 * size


def _better(line: str, written: str, read: str) -> tuple[str, int, float]:
    """The line with its spans restored for this pair, how many characters went into them, and these weighed by how ordinary the restored text is. Where one span of a line is sure, the shorter ones beside it need less."""
    spans = [(a, b, line[a:b], new) for a, b, new in _spans(line, written, read) if not line[a:b].isascii()]
    sure = [_accept(old, new, written, read, line[a - 1 : a], line[b : b + 1]) for a, b, old, new in spans]
    if not any(sure):
        return line, 0, 0.0
    out, last, gain, worth = [], 0, 0, 0.0
    for (a, b, old, new), ok in zip(spans, sure, strict=True):
        if a < last:
            continue
        plus, minus = _good(new, written, read)
        if not ok:
            if minus > 0.2 * len(new) or plus < len(new.replace(LOST, "")) or old.strip("\xa0\xad") == "" or read == "gbk" and len(new) < 2:
                continue
        out += [line[last:a], new]
        last = b
        gain += len(old)
        # well-formed UTF-8 proves itself, of other codes nearly all bytes make sense
        worth += len(old) * (3.0 if written == "utf-8" and minus == 0 else plus / len(new))
    return "".join(out) + line[last:], gain, worth


#: Pairs of which only odd characters or every second sequence are in the automaton.
_SPARSE = frozenset((("gbk", "utf-8"), ("gbk", "big5"), ("big5", "gbk"), ("utf-8", "gbk")))


def repair_line(line: str) -> tuple[str, bool]:
    """The line as it was written, as far as that can be told, and whether any of it was garbled."""
    if not is_suspect(line):
        return line, False
    hit = False
    for _ in range(len(line)):  # some text went through several wrong decoders; each round makes the line shorter or ends it
        tried = _hits(line)
        if _gbk_classes()[1].search(line):  # an accented letter within a Latin word
            tried["utf-8", "gbk"] = 1
        best, gain, most_worth = line, 0, 0.0
        most = sum(c >= "\x80" for c in line)
        likely = max(tried.values(), default=0) / 4  # the sequences of the right pair are all there, of another some by chance
        for p in sorted(tried, key=lambda p: (p[0] != "utf-8", -tried[p], PAIRS.index(p))):  # what proves itself comes first
            if tried[p] < likely and p[0] != "utf-8" and p not in _SPARSE:
                continue
            if p == ("gbk", "utf-8"):
                hit = True  # the bytes are lost: found, but nothing can be restored
                continue
            new, g, worth = _better(line, *p)
            if worth > most_worth:
                best, gain, most_worth = new, g, worth
                if g >= 0.9 * most and worth >= 1.6 * g:  # no pair can be much better
                    break
        if not gain or len(best) >= len(line):
            if gain:
                line, hit = best, True
            break
        line, hit = best, True
        if not is_suspect(line):
            break
    return line, hit


def repair_text(text: str | None) -> tuple[str | None, bool]:
    """All lines of a text; line feeds stay where they are."""
    if not text or not is_suspect(text):
        return text, False
    lines, hit = text.split("\n"), False
    for k, x in enumerate(lines):
        lines[k], h = repair_line(x)
        hit |= h
    return ("\n".join(lines), True) if hit else (text, False)
