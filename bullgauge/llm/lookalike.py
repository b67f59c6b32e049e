"""Texts that look alike but differ in their characters -> one form.

Method: the pieces of a text (runs between punctuation, or phrases around words of another alphabet) that hold an odd character are mapped by
look-alike tables in SQL; mapped values that are equal under the accent-sensitive Unicode collation
form a class (the collation sees through zero-width characters and composes accents); each class has
one deterministic canonical member, which is joined back to every piece of the class.

Odd are: full-width letters, digits and the signs of ``WIDE_SIGNS``; compatibility forms of letters and ideographs; a
letter with a separate combining accent; invisible characters; spaces other than the ASCII one; Latin
words with letters of another alphabet. Chinese punctuation, composed accents, line ends, circled
numbers, units and words of other scripts stay.

Letters of another alphabet are judged word by word. A word is Latin if all its foreign letters look like Latin ones and
it has a Latin letter too, or is a known code (``CODES``), or stands beside a Latin word and not beside a
word that is really foreign. So real words of other languages stay, even those made of look-alikes only.

Defined results: null stays null and is no case; empty stays empty; a text without odd characters is
returned unchanged; equal pieces always get the same canonical member, whatever the row order.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from bullgauge import lexicon
from bullgauge.llm.shared import written

WIDE_SIGNS = "％＋．"
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Letters of the Cyrillic and Greek alphabets that look like a Latin letter: fixed values of their shapes.
SHAPES = dict(zip("АВЕЅІЈКМНОРСТУХаеоорсухіјѕһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονυικρ", "ABESIJKMHOPCTYXaeoopcyxijshdqwABEZHIKMNOPTYXovuikp", strict=True))


def _alphabets() -> dict[str, str]:
    """SHAPES and, by the rule of canonical decomposition, the letters made of one of them and accents."""
    out = dict(SHAPES)
    for c in map(chr, [*range(0x370, 0x400), *range(0x400, 0x530)]):
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and base in SHAPES:
            x = unicodedata.normalize("NFC", SHAPES[base] + "".join(marks))
            if len(x) == 1:
                out[c] = x
    return out


ALIKE = _alphabets()
#: Codes of products: a word of look-alikes alone that spells one is that code.
CODES = tuple(sorted({a for p in lexicon.PRODUCTS for a in (p.code, *p.aliases) if a.isascii() and len(a) > 1}))
_FOREIGN = "Ͱ-ϿЀ-ԯ"
#: Blocks of compatibility forms: radicals, ideographs, ligatures, half-width kana, mathematical letters.
BLOCKS = ((0x2E80, 0x2FD5), (0xF900, 0xFAD9), (0xFB00, 0xFB06), (0xFF66, 0xFF9F), (0x1D400, 0x1D7FF), (0x2F800, 0x2FA1D))


@lru_cache(1)
def compatibility() -> dict[str, str]:
    """Compatibility form -> ordinary form, by the rule NFKC."""
    out = {chr(c): unicodedata.normalize("NFKC", chr(c)) for a, b in BLOCKS for c in range(a, b + 1)}
    out = {k: v for k, v in out.items() if k != v}
    for c in [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), *map(ord, WIDE_SIGNS)]:
        out[chr(c)] = chr(c - 0xFEE0)
    return out


@lru_cache(1)
def _python_table() -> dict[int, str | None]:
    return str.maketrans(compatibility() | dict.fromkeys(SPACES, " ") | dict.fromkeys(INVISIBLE, None))


#: Character class of what makes a piece odd, but for letters of other alphabets.
ODD = (
    f"\uff10-\uff19\uff21-\uff3a\uff41-\uff5a{WIDE_SIGNS}\u0300-\u036f\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u2069\ufeff"
    f"\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000\u2e80-\u2fd5\uf900-\ufad9\ufb00-\ufb06\uff66-\uff9f"
)
_ODD = re.compile(f"[{ODD}\U0001d400-\U0001d7ff\U0002f800-\U0002fa1d]")
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_FOREIGN_RE = re.compile(f"[{_FOREIGN}]")
#: Words of one phrase: one Latin word, words with foreign letters, one Latin word, each after a space.
_PHRASE = re.compile(f"(?:(?<![{_LATIN}{_FOREIGN}])[{_LATIN}]{{1,40}} )?(?:[{_LATIN}]*[{_FOREIGN}][{_LATIN}{_FOREIGN}]*)(?: [{_LATIN}]*[{_FOREIGN}][{_LATIN}{_FOREIGN}]*)*(?: [{_LATIN}]{{1,40}})?")


@lru_cache(1)
def _alike() -> dict[int, str]:
    return str.maketrans(ALIKE)


def _is_latin(c: str) -> bool:
    return c < "\u0250"


def _latin(m: re.Match) -> str:
    """The phrase with its Latin words in Latin letters: word by word, by their letters and their neighbours."""
    words = m[0].split(" ")
    latin = [any(map(_is_latin, w)) for w in words]
    other = [any(not _is_latin(c) and c not in ALIKE for c in w) for w in words]
    out = []
    for k, w in enumerate(words):
        new = w.translate(_alike())
        near = [j for j in (k - 1, k + 1) if 0 <= j < len(words)]
        beside = any(latin[j] for j in near) and not any(other[j] for j in near)
        out.append(new if len(w) > 1 and not other[k] and (latin[k] or new in CODES or beside) else w)
    return " ".join(out)


def fold(text: str) -> str:
    """One text in its ordinary form, without a look at others (for comparing texts line by line)."""
    if text.isascii():
        return text
    if _ODD.search(text):
        text = unicodedata.normalize("NFC", text.translate(_python_table()))
    if _FOREIGN_RE.search(text):
        text = _PHRASE.sub(_latin, text)
    return text


# ------------------------------------------------------------------ the operator
def _java(chars: str) -> str:
    """Characters for a Java character class."""
    return "".join(c if c == "-" else f"\\x{{{ord(c):x}}}" for c in chars)


_SUP = "\\x{1d400}-\\x{1d7ff}\\x{2f800}-\\x{2fa1d}"
ODD_JAVA = f"[{_java(ODD)}{_SUP}]"
FOREIGN_JAVA = f"[{_java(_FOREIGN)}]"
_LATIN_JAVA = f"{_java(_LATIN)}"
ALIKE_JAVA = f"[{''.join(f'\\x{{{ord(c):x}}}' for c in ALIKE)}{_LATIN_JAVA}]"
#: A word of at least two letters that are all Latin or like Latin, one of them of another alphabet.
MIXED_JAVA = f"(?<![{_LATIN_JAVA}{_java(_FOREIGN)}])(?={ALIKE_JAVA}{{2}})(?=[{_LATIN_JAVA}]*{FOREIGN_JAVA}){ALIKE_JAVA}+(?![{_LATIN_JAVA}{_java(_FOREIGN)}])"
BREAKS = " \n\r\t，。：；、！？（）【】《》“”「」«»,:;!?()\\[\\]|"
#: Letters of a word before it is mapped: full-width and mathematical ones, accents and invisible characters may stand in it.
_LETTERS = f"{_LATIN_JAVA}{_java('Ａ-Ｚａ-ｚ')}\\x{{300}}-\\x{{36f}}\\x{{1d400}}-\\x{{1d7ff}}"
_WORD = f"{_LETTERS}{_java(INVISIBLE)}"
_ANY = f"[{_WORD}{_java(_FOREIGN)}]"
_OTHER = f"[{_WORD}]*+{FOREIGN_JAVA}{_ANY}*+"
_GAP = f"[ {_java(SPACES)}]"
PHRASE = f"(?:(?<!{_ANY})[{_WORD}]{{1,40}}+{_GAP})?{_OTHER}(?:{_GAP}{_OTHER})*(?:{_GAP}[{_WORD}]{{1,40}}+(?!{_ANY}))?"
PIECES = f"{PHRASE}|[{_LETTERS}][{_WORD}]*|[^{BREAKS}{_java(_FOREIGN)}{_LETTERS}]+|[{BREAKS}]+"


def _visible(text):
    """A text without invisible characters, between which a word is still one word."""
    return F.translate(text, INVISIBLE, "")


def odd_rows(texts: DataFrame, text: str) -> DataFrame:
    """Rows whose text may be odd: a filter beside the scan, without Python."""
    return texts.filter(F.col(text).rlike(ODD_JAVA) | F.col(text).rlike(FOREIGN_JAVA) & F.col(text).rlike(MIXED_JAVA))


def _latin_words(x: Column) -> Column:
    """``_latin`` in SQL: words and gaps in turn, each word with its neighbours two places on."""
    keys, values = "".join(ALIKE), "".join(ALIKE.values())
    word = f"[{_LATIN_JAVA}{_java(_FOREIGN)}]+"
    parts = F.regexp_extract_all(x, F.lit(f"({word}|[^{_LATIN_JAVA}{_java(_FOREIGN)}]+)"), 1)
    codes = F.array(*map(F.lit, CODES))
    latin = lambda w: w.rlike(f"[{_LATIN_JAVA}]")
    other = lambda w: w.rlike(f"(?![{''.join(f'\\x{{{ord(c):x}}}' for c in ALIKE)}]){FOREIGN_JAVA}")

    def turn(ws: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            # beside: the gap between is one space
            before, after = (F.coalesce(F.when(F.get(ws, i + k) == " ", F.get(ws, i + 2 * k)), F.lit("")) for k in (-1, 1))
            beside = (latin(before) | latin(after)) & ~other(before) & ~other(after)
            new = F.translate(w, keys, values)
            own = w.rlike(FOREIGN_JAVA) & (F.length(w) > 1) & ~other(w)
            return F.when(own & (latin(w) | F.array_contains(codes, new) | beside), new).otherwise(w)

        return F.array_join(F.transform(ws, one), "")

    return F.get(F.transform(F.array(parts), turn), F.lit(0))


def mapped(piece: Column) -> Column:
    """Look-alike mapping of a piece: spaces, single-letter compatibility forms, ligatures, letters of other alphabets inside Latin words."""
    single = {k: v for k, v in compatibility().items() if len(v) == 1}
    x = F.translate(_visible(piece), "".join(single) + SPACES, "".join(single.values()) + " " * len(SPACES))
    for k, v in compatibility().items():
        if len(v) > 1 and 0xFB00 <= ord(k) <= 0xFB06:
            x = F.replace(x, F.lit(k), F.lit(v))
    return F.when(x.rlike(FOREIGN_JAVA), _latin_words(x)).otherwise(x)


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", unicodedata.normalize("NFKC", t) if any(c in compatibility() for c in t) else t))


def odd_pieces(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per odd piece: keys, pos, piece."""
    pieces = rows.select(*keys, F.posexplode(F.regexp_extract_all(text, F.lit(f"({PIECES})"), 1)).alias("pos", "piece"))
    return odd_rows(pieces, "piece")


def canonical_members(pieces: DataFrame) -> DataFrame:
    """(piece, canonical) of each distinct piece. The class of a piece is its mapped value under the collation UNICODE; its canonical member is the least mapped value of the class, accents composed."""
    values = pieces.groupBy("piece").agg(F.count("*").alias("n"))  # pre-aggregated, so a piece in a third of all texts is one row
    values = values.withColumn("mapped", mapped(F.col("piece")))
    values = values.withColumn("class", F.collate("mapped", "UNICODE"))
    # accents: a composed member sorts before one with a separate accent only by chance, so count these
    marks = F.regexp_count("mapped", F.lit("[\\x{300}-\\x{36f}]"))
    members = values.groupBy("class").agg(F.min(F.struct(marks.alias("marks"), F.col("mapped").alias("member"))).alias("m"))
    members = members.withColumn("canonical", F.when(F.col("m.marks") > 0, _composed("m.member")).otherwise(F.col("m.member")))
    return values.join(members, "class").select("piece", "canonical")


def unify(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, text in one form, changed (whether it differs) of the rows that may be odd; all other rows are in that form already."""
    rows = odd_rows(texts, text)
    pieces = written(texts.sparkSession, odd_pieces(rows, keys, text), "pieces")
    # of each text the positions of its odd pieces in order and what stands there instead
    to = pieces.join(canonical_members(pieces), "piece").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "canonical"))).alias("to"))
    every = F.regexp_extract_all(text, F.lit(f"({PIECES})"), 1)

    def upto(t: Column, i: Column) -> Column:
        """What stands between the odd piece before and this one, and this one's canonical member."""
        begin = F.coalesce(F.get(F.col("to"), i - 1)["pos"] + 1, F.lit(0))
        return F.concat(F.array_join(F.slice("every", begin + 1, t["pos"] - begin), ""), t["canonical"])

    rest = F.array_join(F.slice("every", F.get(F.col("to"), F.size("to") - 1)["pos"] + 2, F.size("every")), "")
    new = F.concat(F.array_join(F.transform("to", upto), ""), rest)
    out = rows.join(to, keys, "left").withColumn("every", every).withColumn("__new", F.when(F.col("to").isNull(), F.col(text)).otherwise(new))
    out = out.withColumn("__new", F.translate("__new", SPACES + INVISIBLE, " " * len(SPACES)))
    return out.select(*keys, F.col("__new").alias("unified"), (F.col("__new") != F.col(text)).alias("changed"))


def found(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys of the texts with at least one piece that is not its class's canonical member."""
    pieces = written(texts.sparkSession, odd_pieces(odd_rows(texts, text), keys, text), "pieces")  # read twice; cutting texts is the costly part
    return pieces.join(canonical_members(pieces), "piece").filter(F.col("piece") != F.col("canonical")).select(*keys).distinct()
