"""Stance of an advice text as Spark expressions: clauses, ordered rules, negation, intensity, evidence.

All of it stays in the JVM. A text is cut into clauses once; each clause is held against the rules in one ordered CASE, so the first
rule in order wins; the first clause with a direction speaks for the text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from bullgauge import lexicon
from bullgauge.settings import DEFAULT, Settings

#: White space as Unicode defines it, and the separators below the blank.
_BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_SENT = "。！？；\\n!?;"
_SEP = "，。；、：！？,;:.!?（）()【】\\[\\]“”\"'《》\\n\\t·—\\- 　"
_CLAUSE = "[，,；;。！？!?、\\n\\t]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NEG = "|".join(sorted(lexicon.NEGATIONS, key=len, reverse=True))
RESULT = "struct<direction:double,confidence:double,evidence:string,matched:string,rule:int,negated:boolean>"


def compact(text: Column) -> Column:
    """Without white space, ASCII in lower case."""
    return F.translate(text, _UPPER + _BLANKS, _LOWER)


def _extract(text: Column, pattern: Column) -> Column:
    """The first group of a pattern that is a column."""
    return F.call_function("regexp_extract", text, pattern, F.lit(1))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(_BLANKS))


#: For x.xx5 held as a double: whether its exact value lies above the tie or, on the tie, rounds to even; by the rule of correctly rounded decimals.
_UP = [round(n / 1000, 2) > n / 1000 for n in range(5, 4000, 10)]


def round2(x: Column) -> Column:
    """Two decimals, nearest to the exact value of the double; |x| < 4."""
    a = F.abs(x)
    n = F.round(a * 1000).cast("int")
    tie = (n % 10 == 5) & (a == n / F.lit(1000.0))
    up = F.get(F.array(*map(F.lit, _UP)), ((n - 5) / 10).cast("int"))
    r = F.when(tie, (F.floor(n / 10) + up.cast("int")) / F.lit(100.0)).otherwise(F.round(a, 2))
    return F.when(x < 0, -r).otherwise(r)


def intensity(scope: Column) -> Column:
    """Product of the factors of the words in a text."""
    out = F.lit(1.0)
    for word, factor in lexicon.INTENSITY.items():
        out = out * F.when(scope.rlike(lexicon.SLIGHT) if word == "略" else scope.contains(word), F.lit(factor)).otherwise(F.lit(1.0))
    return out


def _guards() -> dict[str, int]:
    """The sets of characters of which a rule needs one, numbered."""
    return {chars: k for k, chars in enumerate(dict.fromkeys(lexicon.needed_by(r.pattern) for r in lexicon.RULES))}


def _first_rule(clause: Column, weak: Column | bool = True) -> Column:
    """Number of the first rule that fits; ``weak``: do trend words count. Which characters a clause holds is looked up once, so hardly any pattern is tried in vain."""
    guards = _guards()
    holds = [clause.contains(c) if len(c) == 1 else clause.rlike(f"[{c}]") for c in guards]

    def numbered(has: Column) -> Column:
        found = [has[k] for k in range(len(guards))]
        case = None
        for r in lexicon.RULES:
            fits = found[guards[lexicon.needed_by(r.pattern)]] & clause.rlike(r.pattern)
            if r.group == "weak" and weak is not True:
                fits = fits & weak
            case = (F if case is None else case).when(fits, r.ord)
        return case

    return F.when(clause.rlike(f"[{lexicon.needed_characters()}]"), let(F.array(*holds), numbered))  # most clauses end here


def _of_rule(ord_: Column, values: list) -> Column:
    """The rule's entry in a list, written as one literal array."""
    items = ",".join(f"r'{v}'" if isinstance(v, str) else f"{v}D" if isinstance(v, float) else str(v).lower() for v in values)
    return F.get(F.expr(f"array({items})"), ord_ - 1)


def _by_rule(ord_: Column, of: Callable[[Column], Column], rules: list[lexicon.Rule]) -> Column:
    """``of(pattern)`` for the rule's pattern, which stays a literal, so it is compiled once for all rows."""
    case = F
    for r in rules:
        case = case.when(ord_ == r.ord, of(F.lit(r.pattern)))
    return case


def _spaced(matched: Column) -> Column:
    """A pattern for the match in the original text, where white space may stand inside."""
    return F.regexp_replace(matched, "(?s)(.)(?=.)", r"$1(?U:\\s*)")


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once and written once in the plan, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _judge(part: Column, weak: Column, s: Settings) -> Column:
    """What a part (raw, sentence, whole: is it the text itself) says; null if no rule fits."""
    rules, n = lexicon.RULES, s.negation_window

    def rule(x: Column) -> Column:
        o, c = x["o"], x["c"]
        found = F.struct(
            *(x[k].alias(k) for k in ("c", "o", "raw", "sentence", "whole")),
            _by_rule(o, lambda p: F.regexp_substr(c, p), list(rules)).alias("m"),
            _of_rule(o, [r.direction for r in rules]).alias("d"),
            _of_rule(o, [r.confidence for r in rules]).alias("conf"),
            _of_rule(o, [r.group == "special" or r.direction == 0 for r in rules]).alias("plain"),
        )
        return F.when(o.isNotNull(), let(found, place))

    def place(x: Column) -> Column:
        # the words of a match stand nowhere before it, but where a pattern looks behind
        behind = [r for r in rules if "(?<" in r.pattern]
        at = F.coalesce(_by_rule(x["o"], lambda p: F.regexp_instr(x["c"], p), behind), F.instr(x["c"], x["m"]))
        return let(F.struct(*(x[k].alias(k) for k in ("c", "o", "raw", "sentence", "whole", "m", "d", "conf", "plain")), at.alias("at")), scope)

    def scope(x: Column) -> Column:
        at = x["at"]
        left = F.substring(x["c"], F.greatest(at - n, F.lit(1)), F.least(at - 1, F.lit(n)))
        return let(F.struct(x.alias("x"), F.regexp_extract(left, f"([^{_SEP}]*)$", 1).alias("left")), weigh)

    def weigh(z: Column) -> Column:
        x = z["x"]
        negated = ~x["plain"] & (F.regexp_count(z["left"], F.lit(_NEG)) % 2 == 1)
        factor = let(F.concat(z["left"], x["m"]), intensity)
        around = _extract(x["sentence"], F.concat(F.lit(f"(?i)([^{_SENT}]*"), _spaced(x["m"]), F.lit(f"[^{_SENT}]*)")))
        line = strip(F.when(x["whole"], around).otherwise(x["sentence"]))
        # without white space in the text the match stands at the same place in it
        matched = F.when(F.length(x["c"]) == F.length(x["raw"]), F.substring(x["raw"], x["at"], F.length(x["m"]))).otherwise(_extract(x["raw"], F.concat(F.lit("(?i)("), _spaced(x["m"]), F.lit(")"))))
        return let(F.struct(z.alias("z"), negated.alias("negated"), factor.alias("f"), line.alias("line"), matched.alias("matched")), result)

    def result(w: Column) -> Column:
        x, f = w["z"]["x"], w["f"]
        d, conf, negated = x["d"], x["conf"], w["negated"]
        scaled = ~x["plain"] & ~negated & (f != 1.0)
        size = F.least(F.lit(s.max_abs_direction), F.greatest(F.lit(s.min_scaled_abs), F.abs(d) * f))
        sure = F.least(F.lit(0.99), F.greatest(F.lit(0.05), conf * (0.6 + 0.4 * f)))
        direction = F.when(negated, -F.signum(d) * s.negation_magnitude).when(scaled, F.signum(d) * let(size, round2)).otherwise(d)
        confidence = F.when(negated, F.lit(s.negation_confidence)).when(scaled, let(sure, round2)).otherwise(conf)
        piece = strip(_extract(x["raw"], F.concat(F.lit(f"(?i)([^{_SEP}]*"), _spaced(x["m"]), F.lit(f"[^{_SEP}]*)"))))
        evidence = F.when(F.length(w["line"]) <= 60, w["line"]).otherwise(let(let(piece, lambda p: F.when(p == "", w["line"]).otherwise(p)), _cut))
        return F.struct(direction.alias("direction"), confidence.alias("confidence"), evidence.alias("evidence"), w["matched"].alias("matched"), x["o"].alias("rule"), negated.alias("negated"))

    def numbered(x: Column) -> Column:
        return let(F.struct(x["c"].alias("c"), _first_rule(x["c"], weak).alias("o"), *(x[k].alias(k) for k in ("raw", "sentence", "whole"))), rule)

    return let(F.struct(compact(part["raw"]).alias("c"), *(part[k].alias(k) for k in ("raw", "sentence", "whole"))), numbered)


def _cut(piece: Column) -> Column:
    return F.when(F.length(piece) > 120, F.concat(F.left(piece, F.lit(120)), F.lit("…"))).otherwise(piece)


def _candidates(*options: tuple[bool, bool]) -> Column:
    """(do trend words count, does the last clause speak) of each candidate text, each first by clauses, then as a whole: words that a break cuts in two are found only there."""
    return F.array(*(F.struct(F.lit(k).alias("number"), F.lit(weak).alias("weak"), F.lit(last).alias("last"), F.lit(whole).alias("whole")) for k, (weak, last) in enumerate(options) for whole in (False, True)))


def _first_said(candidates: Column, texts: list[Column], s: Settings) -> Column:
    """The stance of the first candidate text that has one: a fold that stops looking once it has a result, so later texts are not even cut out, with one copy of the rules in the plan."""

    def pick(x: Column) -> Column:
        end = F.when(x["last"], -1).otherwise(1)
        some = F.filter(x["said"], lambda r: r["direction"] != 0)
        return F.coalesce(F.try_element_at(some, end), F.try_element_at(x["said"], end))

    def says(x: Column) -> Column:
        text = texts[0] if len(texts) == 1 else reduce(lambda case, k: case.when(x["number"] == k, texts[k]), range(1, len(texts)), F.when(x["number"] == 0, texts[0]))
        return let(F.struct(text.alias("text"), *(x[k].alias(k) for k in ("weak", "last", "whole"))), of)

    def of(x: Column) -> Column:
        t = x["text"]
        sentences = F.filter(F.split(t, f"[{_SENT}]", -1), lambda y: strip(y) != "")
        clauses = F.flatten(F.transform(sentences, lambda y: F.transform(F.filter(F.split(y, _CLAUSE, -1), lambda c: c != ""), lambda c: F.struct(c.alias("raw"), y.alias("sentence"), F.lit(False).alias("whole")))))
        itself = F.when(F.size(F.split(t, _CLAUSE, -1)) > 1, F.array(F.struct(t.alias("raw"), t.alias("sentence"), F.lit(True).alias("whole"))))
        parts = F.when(x["whole"], itself).otherwise(clauses)
        said = F.filter(F.transform(parts, lambda p: _judge(p, x["weak"], s)), lambda r: r.isNotNull())
        return F.when(strip(t) != "", let(F.struct(said.alias("said"), x["last"].alias("last")), pick))

    return F.aggregate(candidates, F.lit(None).cast(RESULT), lambda found, x: F.coalesce(found, says(x)).cast(RESULT))


def classify(text: Column, weak: bool = True, last: bool = False, s: Settings = DEFAULT) -> Column:
    """Struct of the stance, or null where no rule fits. ``weak``: trend words count; ``last``: the last clause speaks, as in whole blocks."""
    return _first_said(_candidates((weak, last)), [text], s)


def miss_evidence(text: Column) -> Column:
    """The last sentence, for people who look at what no rule fits."""

    def last(t: Column) -> Column:
        line = strip(F.regexp_extract(t, f"(?s)^(?:.*[{_SENT}])?([^{_SENT}]*.)$", 1))
        piece = strip(F.regexp_extract(t, f"(?s)^(?:.*[{_SEP}])?([^{_SEP}]*.)$", 1))
        return F.when(F.length(t) <= 60, t).otherwise(let(line, lambda x: F.when(F.length(x) <= 60, x).otherwise(let(F.when(piece == "", x).otherwise(piece), _cut))))

    return let(strip(F.coalesce(text, F.lit(""))), last)


def after_label(raw: Column) -> Column:
    """What follows the last advice label; empty without one."""
    return strip(F.regexp_extract(raw, f"(?s)^.*(?<!构成)(?:{lexicon.ADVICE_LABELS}|操作上|策略上)(?U:\\s*)[:：]?(?U:\\s*)(.*)$", 1))


def tail(raw: Column, size: int = DEFAULT.fallback_tail_chars) -> Column:
    """The last characters, from the first sentence that begins among them."""
    t = strip(raw)
    end = F.right(t, F.lit(size))
    rest = strip(F.regexp_extract(end, f"(?s)^[^{_SENT}]*[{_SENT}](.*)$", 1))
    return F.when(F.length(t) <= size, t).when(rest != "", rest).otherwise(strip(end))


def score_segment(advice: Column, raw: Column, s: Settings = DEFAULT) -> Column:
    """Struct of a segment's score: the advice, else the part after a label, else the tail and the whole block without trend words, else the whole block with them; confidence 0 where nothing fits."""

    def cascade(x: Column) -> Column:
        a, r = x["a"], x["r"]
        label, end = after_label(r), tail(r, s.fallback_tail_chars)
        texts = [a, label, F.when(end != label, end), F.when(r != end, r), r]
        found = _first_said(_candidates((True, False), (True, False), (False, True), (False, True), (True, True)), texts, s)
        rest = miss_evidence(F.when(r != "", r).otherwise(a))
        none = F.struct(F.lit(0.0).alias("direction"), F.lit(0.0).alias("confidence"), rest.alias("evidence"), F.lit("").alias("matched"), F.lit(None).cast("int").alias("rule"), F.lit(False).alias("negated"))
        return F.coalesce(found, none.cast(RESULT))

    return let(F.struct(strip(F.coalesce(advice, F.lit(""))).alias("a"), strip(F.coalesce(raw, F.lit(""))).alias("r")), cascade)
