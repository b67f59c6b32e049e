"""Products named in a text: longest alias first, a character belongs to one alias only."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from bullgauge import lexicon

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_EDGE = ("(?<![0-9A-Za-z])", "(?![0-9A-Za-z])")


def _pattern(alias: str) -> str:
    return _EDGE[0] + alias + _EDGE[1] if alias.isascii() else alias


def match_products(text: Column) -> Column:
    """Codes in order of first place, then of code; null and empty texts name none. A fold over the aliases in which a hit is replaced by a filler of the same length: U+0001 for ideographs, Z for letters (which no lower-case alias holds, and which still ends a word). A text is searched for an alias as it is; a pattern, for the edges of a word, is used only where the letters of one are there."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    aliases = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(_pattern(a) if a.isascii() else None).cast("string").alias("p"), F.lit(c).alias("code"), F.lit(("Z" if a.isascii() else "\x01") * len(a)).alias("fill")) for a, c in lexicon.alias_index()))
    none = F.array().cast("array<struct<at:int,code:string>>")

    def step(state: Column, a: Column) -> Column:
        rest, p = state["rest"], a["p"]
        at = F.when(~rest.contains(a["a"]), 0).when(p.isNull(), F.instr(rest, a["a"])).otherwise(F.regexp_instr(rest, p))
        new = F.when(p.isNull(), F.replace(rest, a["a"], a["fill"])).otherwise(F.regexp_replace(rest, p, a["fill"]))
        return F.when(at > 0, F.struct(new.alias("rest"), F.concat(state["hits"], F.array(F.struct(at.alias("at"), a["code"].alias("code")))).alias("hits"))).otherwise(state)

    found = F.aggregate(aliases, F.struct(low.alias("rest"), none.alias("hits")), step, lambda s: s["hits"])
    return F.array_distinct(F.transform(F.array_sort(found), lambda h: h["code"]))


def match_one(text: Column) -> Column:
    """The first product or null."""
    return F.try_element_at(match_products(text), F.lit(1))


def sector_of(code: Column) -> Column:
    """Sector by code (blanks and case aside), else by name; null if unknown."""
    by = {**{p.name: p.sector for p in lexicon.PRODUCTS}, **{p.code: p.sector for p in lexicon.PRODUCTS}}
    pairs = F.create_map(*(F.lit(x) for kv in by.items() for x in kv))
    key = F.trim(code)
    return F.coalesce(F.try_element_at(pairs, F.upper(key)), F.try_element_at(pairs, key))


def name_of(code: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for p in lexicon.PRODUCTS for x in (p.code, p.name)))
    return F.try_element_at(pairs, F.upper(F.trim(code)))


# ------------------------------------------------------------------ in Python, for segmentation
@lru_cache(1)
def _by_first() -> dict[str, list[tuple[str, str]]]:
    out: dict[str, list[tuple[str, str]]] = {}
    for alias, code in lexicon.alias_index():
        out.setdefault(alias[0], []).append((alias, code))
    return out


_ALNUM = frozenset("0123456789" + _UPPER + _LOWER)


@lru_cache(65_536)
def find(text: str) -> tuple[str, ...]:
    """Codes in order of first place: hits of all aliases compete, longer ones first."""
    low = lexicon.ascii_lower(text)
    hits = []
    for i, c in enumerate(low):
        for alias, code in _by_first().get(c, ()):
            if low.startswith(alias, i):
                end = i + len(alias)
                if not alias.isascii() or low[i - 1 : i] not in _ALNUM and low[end : end + 1] not in _ALNUM:
                    hits.append((-len(alias), alias, i, end, code))
    taken = bytearray(len(low))
    first: dict[str, int] = {}
    for _, _, a, b, code in sorted(hits):
        if not any(taken[a:b]):
            taken[a:b] = b"\1" * (b - a)
            first[code] = min(first.get(code, a), a)
    return tuple(sorted(first, key=lambda c: (first[c], c)))
