"""The correction rules, in their order, as data.

A rule is a list of substitutions (``Sub``) or one of the few that need a state (quotation marks,
nested parentheses) or a table outside regular expressions (normalisation). ``apply`` makes a Column
of them, ``run`` does the same to a Python string and also gives the log; both read one definition.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from glyphmill.functions import arrow, dims, regex
from glyphmill.functions.dims import BOM, NBSP, NNBSP, THIN, ZWNJ, ZWSP

CAPITAL = r"[A-ZÀ-ɏ]"
LETTER = r"\p{L}"
Edit = tuple[int, str, str, str]  # position, original, replacement, rule id


@dataclass(frozen=True)
class Sub:
    """A pattern template and its replacement. guard: text that any match holds, for a cheap test first in Python.

    Where a match holds a fixed sign the pattern begins with it and looks behind afterwards, as a
    search for a sign is the fastest there is.
    """

    pattern: str
    replacement: str
    guard: str | None = None
    rule: str | None = None

    def apply(self, c: Column) -> Column:
        return F.regexp_replace(c, F.lit(regex.java(self.pattern)), F.lit(regex.java_replacement(self.replacement)))

    def counted(self, text: str) -> tuple[str, int]:
        """The text after it, and the number of matches."""
        if self.guard and self.guard not in text:
            return text, 0
        pattern, template, _ = _compiled(self.pattern, self.replacement)
        return pattern.subn(template, text)

    def run(self, text: str, rule: str, log: list[Edit] | None) -> str:
        if self.guard and self.guard not in text:
            return text
        pattern, template, put = _compiled(self.pattern, self.replacement)
        if log is None:
            return pattern.sub(template, text)

        def one(m: re.Match) -> str:
            new = put(m)
            log.append((m.start(), m[0], new, self.rule or rule))
            return new

        return pattern.sub(one, text)


@cache
def _compiled(pattern: str, replacement: str) -> tuple:
    return regex.python(pattern.replace(LETTER, r"[^\W\d_]")), regex.python_template(replacement), regex.python_replacement(replacement)


@dataclass(frozen=True)
class Rule:
    name: str
    subs: Callable[[str], list[Sub]] | None = None
    langs: tuple[str, ...] = ()
    risky: bool = False  # left out when strict
    column: Callable[[Column, str], Column] | None = None
    python: Callable[[str, str, list[Edit] | None], str] | None = None
    #: What any text that the rule changes holds, for one cheap test first in Python.
    need: str | None = None

    def holds(self, lang: str, strict: bool = False) -> bool:
        return (not self.langs or lang in self.langs) and not (strict and self.risky)

    def apply(self, c: Column, lang: str) -> Column:
        if self.column:
            return self.column(c, lang)
        subs = self.subs(lang)
        done = c
        for s in subs:
            done = s.apply(done)
        # one test for all steps; a test a step would repeat the text's expression at each
        guards = {s.guard for s in subs}
        if len(subs) < 3 or None in guards:
            return done
        return F.when(c.rlike("|".join(sorted(re.escape(g) for g in guards))), done).otherwise(c)

    def run(self, text: str, lang: str, log: list[Edit] | None) -> str:
        """The text after the rule; the corrections go to log, if there is one."""
        if self.need and not regex.python(self.need).search(text):
            return text
        if self.python:
            return self.python(text, lang, log)
        for s in _steps(self, lang):
            text = s.run(text, self.name, log)
        return text

    def counted(self, text: str, lang: str) -> tuple[str, int]:
        """The text after the rule, and the number of corrections."""
        if self.python:
            log: list[Edit] = []
            return self.run(text, lang, log), len(log)
        if self.need and not regex.python(self.need).search(text):
            return text, 0
        n = 0
        for s in _steps(self, lang):
            text, more = s.counted(text)
            n += more
        return text, n


def linted(c: Column, rule: Rule, lang: str) -> Column:
    """struct(corrected, n): as ``apply``, by the rule's Python form, which takes a fraction of the time, and the number of matches in all its steps; null where the text is."""
    kind = pa.struct([("corrected", pa.string()), ("n", pa.int64())])
    returns = StructType([StructField("corrected", StringType()), StructField("n", LongType())])
    return arrow.mapped(lambda x: None if x is None else dict(zip(("corrected", "n"), rule.counted(x, lang), strict=True)), kind, returns, c, once=True)


@cache
def _steps(rule: Rule, lang: str) -> tuple[Sub, ...]:
    return tuple(rule.subs(lang))


def _begin(letter: str) -> str:
    """A word's first letter; the test of what is before it comes second, as few places get that far."""
    return f"{letter}(?<!§w§{letter})"


def _words(pairs: dict[str, str]) -> list[Sub]:
    return [Sub(f"{_begin(a[0])}{re.escape(a[1:])}(?!§w§)", b, guard=a) for a, b in pairs.items()]


def _ligatures(lang: str) -> list[Sub]:
    out = []
    for word, right in dims.LIGATURES.items():
        rest = re.escape(word[1:])
        out.append(Sub(f"{_begin(word[0].upper())}§i§{rest})(?!§w§)", right[0].upper() + right[1:]))
        out.append(Sub(f"{_begin(word[0])}§i§{rest})(?!§w§)", right))
    return out


def _homoglyphs(lang: str) -> list[Sub]:
    subs = [Sub(r"([§d§])º([CFK])§b§", rf"\1{NBSP}°\2", "º"), Sub(r"([§d§])°([CFK])§b§", rf"\1{NBSP}°\2", "°"), Sub(r"([§d§])º(?![a-zA-Z])", r"\1°", "º")]
    return [*subs, Sub("β", "ß", "β")] if lang == "de-DE" else subs


def _legal(lang: str) -> list[Sub]:
    return [Sub(rf"\(§i§{mark})\)", sign, "(", rule) for mark, sign, rule in (("c", "©", "copyright_sign"), ("r", "®", "registered_sign"), ("tm", "™", "trademark_sign"))]


def _fractions(lang: str) -> list[Sub]:
    return [Sub(rf"{a}(?<![§d§]{a})(?![§d§/])", b, a) for a, b in dims.FRACTIONS.items()]


_AFTER_MARK = r"(?=[§s§,;:.!?)\]}]|§end§)"


def _primes(lang: str) -> list[Sub]:
    return [Sub(r"""([§d§]+)'([§d§]+)(?:"|'')?""", r"\1′\2″", "'"), Sub(rf"([§d§]+)'{_AFTER_MARK}", r"\1′", "'"), Sub(rf'([§d§]+)"{_AFTER_MARK}', r"\1″", '"')]


def _dashes(lang: str) -> list[Sub]:
    new, rule = ("—", "em_dash") if lang == "en-US" else (" – ", "en_dash")
    return [Sub(r" - (?<=[^\-§d§] - )(?=[^\-§d§])", new, " - ", rule)]


def _units(lang: str) -> list[Sub]:
    space = NNBSP if lang == "fr-FR" else NBSP
    return [Sub(rf"([§d§])({'|'.join(re.escape(u) for u in dims.UNITS)})(?=[§s§.,;:!?)\]}}]|§end§)", rf"\1{space}\2")]


def _high(lang: str) -> list[Sub]:
    out = []
    for mark, ahead in ((";", ""), ("!", ""), (r"\?", ""), (":", r"(?!//|\\[\s\S])")):
        plain = mark[-1]
        out.append(Sub(rf"[ {NBSP}{THIN}]{mark}{ahead}", NNBSP + plain, plain))
        out.append(Sub(rf"(?<=[^ {NBSP}{THIN}{NNBSP}\n\r\t]){mark}{ahead}", NNBSP + plain, plain))
    return out


def _add_period(words: str) -> list[Sub]:
    return [Sub(rf"{_begin(w[0])}{w[1:]}(?!\.)(?=[§s§]+{CAPITAL})", w + ".", w) for w in words.split()]


def _drop_period(words: str, ahead: str) -> list[Sub]:
    return [Sub(rf"{_begin(w[0])}{w[1:]}\.(?=[§s§]{ahead})", w, w + ".") for w in words.split()]


def _ordinals(lang: str) -> list[Sub]:
    masculine = "o" if lang.startswith("pt") else "(?:er|o)"
    return [Sub(rf"([§d§]+){masculine}§b§", r"\1.º"), Sub(r"([§d§]+)a§b§", r"\1.ª")]


def _din(lang: str) -> list[Sub]:
    literal = [Sub(re.escape(a), NNBSP.join(p + "." for p in a.rstrip(".").split(".")), a) for a in dims.DIN_5008]
    return [*literal, Sub(r"§b§([a-zäöü])\.([a-zA-ZäöüÄÖÜ])\.", rf"\1.{NNBSP}\2.")]


def _titles(lang: str) -> list[Sub]:
    return [Sub(rf"{re.escape(t)} (?={CAPITAL})", t + NBSP, t + " ") for t in dims.titles(lang)]


def _singles(lang: str) -> list[Sub]:
    out = []
    for w in dims.SINGLE_LETTERS[lang]:
        for x in (w, w.upper()):
            before = rf"""(?:(?<=[§s§—–‒(\[{{"'«“„‘‹]{x})|(?<![\s\S]{x}))"""
            out.append(Sub(rf"{x}{before} (?=[^§s§])", x + NBSP, x + " "))
    return out


def _nfc(column: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in column.to_pylist()], pa.string())


def _nfc_column(c: Column, lang: str) -> Column:
    # only texts with other than ASCII characters go to Python
    return F.coalesce(F.arrow_udf(_nfc, StringType())(F.when(c.rlike(r"[^\x00-\x7f]"), c)), c)


def _nfc_python(text: str, lang: str, log: list[Edit] | None) -> str:
    if text.isascii() or unicodedata.is_normalized("NFC", text):
        return text
    new = unicodedata.normalize("NFC", text)
    if log is not None:
        log.append((0, "(composite characters)", "(NFC-normalized)", "nfc_normalization"))
    return new


def _joined(parts: Column, mark: Callable[[Column, Column], Column]) -> Column:
    """The parts, each but the first with what ``mark`` gives for it and its place before it."""
    return F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.concat(mark(x, i), x))), "")


def _quotes_column(c: Column, lang: str) -> Column:
    opening, closing, _, _, space = dims.QUOTES[lang]
    if lang != "en-GB":
        mark = lambda x, i: F.when(i % 2 == 1, F.lit(opening + space)).otherwise(F.lit(space + closing))
        return F.when(F.contains(c, F.lit('"')), _joined(F.split(c, '"'), mark)).otherwise(c)
    # at each apostrophe: whether a letter or digit is before and after it; then a fold over these alone, which gives
    # a digit each, 0 as it is, 1 opening, 2 closing; the pieces are joined once
    word = r"[\p{L}\p{Nd}]"
    parts = F.split(c, "'")
    ends = F.transform(parts, lambda x: F.rlike(F.right(x, F.lit(1)), F.lit(word)))
    begins = F.transform(parts, lambda x: F.rlike(F.left(x, F.lit(1)), F.lit(word)))
    sides = F.arrays_zip(F.slice(ends, F.lit(1), F.size(parts) - 1).alias("before"), F.slice(begins, F.lit(2), F.size(parts)).alias("after"))

    def step(s: Column, x: Column) -> Column:
        opens, closes = ~s.open & ~x["before"], s.open & ~x["after"]
        mark = F.when(x["before"] & x["after"], "0").when(opens, "1").when(closes, "2").otherwise("0")
        inside = F.when(x["before"] & x["after"], s.open).otherwise((s.open | opens) & ~closes)
        return F.struct(F.concat(s.marks, mark).alias("marks"), inside.alias("open"))

    marks = F.aggregate(sides, F.struct(F.lit("-").alias("marks"), F.lit(False).alias("open")), step)["marks"]
    both = F.arrays_zip(parts.alias("part"), F.split(marks, "").alias("mark"))
    new = lambda m: F.when(m == "1", F.lit(opening)).when(m == "2", F.lit(closing)).otherwise(F.lit("'"))
    done = F.array_join(F.transform(both, lambda x: F.when(x["mark"] == "-", x["part"]).otherwise(F.concat(new(x["mark"]), x["part"]))), "")
    return F.when(F.contains(c, F.lit("'")), done).otherwise(c)


def _quotes_python(text: str, lang: str, log: list[Edit] | None) -> str:
    opening, closing, _, _, space = dims.QUOTES[lang]
    mark = "'" if lang == "en-GB" else '"'
    parts = text.split(mark)
    if len(parts) == 1:
        return text
    out, inside, at = [parts[0]], False, len(parts[0])
    word = lambda c: c.isalpha() or c.isdigit()
    for x in parts[1:]:
        new = mark
        if lang != "en-GB":
            new = space + closing if inside else opening + space
            inside = not inside
        else:
            before, after = at > 0 and word(text[at - 1]), at + 1 < len(text) and word(text[at + 1])
            if not (before and after):
                if not inside and not before:
                    new, inside = opening, True
                elif inside and not after:
                    new, inside = closing, False
        if log is not None and new != mark:
            log.append((at, mark, new, "quotation_marks"))
        out += [new, x]
        at += 1 + len(x)
    return "".join(out)


def _nested_column(c: Column, lang: str) -> Column:
    """Depths come from the marks alone; the pieces between them are joined once."""
    marks = F.regexp_extract_all(c, F.lit("[()]"), F.lit(0))

    def step(s: Column, x: Column) -> Column:
        opens = x == "("
        mark = F.when(opens, F.when(s.depth >= 1, F.lit("[")).otherwise(F.lit("("))).otherwise(F.when(s.depth > 1, F.lit("]")).otherwise(F.lit(")")))
        return F.struct(F.concat(s.marks, mark).alias("marks"), F.when(opens, s.depth + 1).otherwise(F.greatest(F.lit(0), s.depth - 1)).alias("depth"))

    new = F.aggregate(marks, F.struct(F.lit("-").alias("marks"), F.lit(0).alias("depth")), step)["marks"]
    both = F.arrays_zip(F.split(c, "[()]").alias("part"), F.split(new, "").alias("mark"))
    done = F.array_join(F.transform(both, lambda x: F.when(x["mark"] == "-", x["part"]).otherwise(F.concat(x["mark"], x["part"]))), "")
    return F.when(F.contains(c, F.lit("(")), done).otherwise(c)


def _nested_python(text: str, lang: str, log: list[Edit] | None) -> str:
    parts, depth, at = [], 0, 0
    for m in re.finditer(r"[()]", text):
        inner = depth >= 1 if m[0] == "(" else depth > 1
        depth = depth + 1 if m[0] == "(" else max(0, depth - 1)
        if inner:
            new = "[" if m[0] == "(" else "]"
            parts += [text[at : m.start()], new]
            at = m.end()
            if log is not None:
                log.append((m.start(), m[0], new, "nested_parentheticals"))
    return "".join(parts) + text[at:]


def _initials_python(text: str, lang: str, log: list[Edit] | None) -> str:
    def one(m: re.Match) -> str:
        if log is not None:
            log.append((m.start(), m[0] + m[1], m[0] + NBSP + m[1], "nbsp_between_initials"))
        return m[0] + NBSP

    return re.sub(r"[A-Z]\.(?=([A-Z]\.))", one, text)


def _containers_python(text: str, lang: str, log: list[Edit] | None) -> str:
    unit = rf"[A-Z]\.{NBSP}"

    def one(m: re.Match) -> str:
        new = m[1] + m[2][:-1].replace(NBSP, " ") + NBSP + m[3]
        if log is not None:
            log.append((m.start(), m[0], new, "breakable_containers"))
        return new

    return re.sub(rf"({unit})((?:{unit}){{2,}})([A-Za-zÀ-ɏ]+)", one, text)


def _only(*subs: Sub) -> Callable[[str], list[Sub]]:
    return lambda lang: list(subs)


_PT, _ES, _EN = ("pt-PT", "pt-BR"), ("es-ES", "es-MX"), ("en-US", "en-GB")

RULES: tuple[Rule, ...] = (
    Rule("nfc_normalization", column=_nfc_column, python=_nfc_python),
    Rule("zero_width_chars", _only(Sub(rf"{ZWSP}(?<={LETTER}{ZWSP})(?={LETTER})", " ", ZWSP), Sub(rf"{ZWSP}|(?<=[\s\S]){BOM}", "")), need=f"[{ZWSP}{BOM}]"),
    Rule("romanian_diacritics", _only(*(Sub(a, b, a) for a, b in zip(*dims.CEDILLAS, strict=True))), ("ro-RO",)),
    Rule("french_ligatures", _ligatures, ("fr-FR",), need="[oO][eE]"),
    Rule("french_capital_accents", lambda lang: _words(dims.FRENCH_CAPITALS), ("fr-FR",)),
    Rule("homoglyph_detection", _homoglyphs, need="[º°β]"),
    Rule("ellipsis", _only(Sub(r"\.{3}", "…", "..."))),
    Rule("legal_symbols", _legal),
    Rule("fractions", _fractions, need="/"),
    Rule("primes", _primes, need="['\"](?<=[§d§].)"),
    Rule("quotation_marks", column=_quotes_column, python=_quotes_python),
    Rule("apostrophe", _only(Sub(r"'(?<=§w§')(?=§w§)", "’", "'"))),
    Rule("dashes", _dashes, _EN, True),
    Rule("range_dash", _only(Sub(r"(?<![a-zA-Z\-])([§d§]+)-([§d§]+)(?![a-zA-Z\-])", r"\1–\2", "-")), risky=True, need="-(?<=[§d§]-)[§d§]"),
    Rule("minus_sign", _only(Sub(r"-(?<=[§s§(=:,]-)(?=[§d§])", "−", "-"), Sub(r"-(?<![\s\S]-)(?=[§d§])", "−", "-"), Sub(r"([§d§]) - ([§d§])", r"\1 − \2", " - ")), risky=True, need="-(?: ?[§d§])"),
    Rule("multiplication_sign", _only(Sub(r"([§d§])[§s§]?[xX][§s§]?([§d§])", rf"\1{THIN}×{THIN}\2")), risky=True, need="[xX][§s§]?[§d§]"),
    Rule("double_space", _only(Sub(r"([.!?;:,])  +", r"\1 ", "  "))),
    Rule("number_unit_spacing", _units),
    Rule("nested_parentheticals", column=_nested_column, python=_nested_python, need=r"\("),
    Rule("nbsp_between_initials", _only(Sub(r"([A-Z]\.)(?=[A-Z]\.)", rf"\1{NBSP}")), python=_initials_python, need=r"\.[A-Z]\."),
    Rule("french_high_punctuation", _high, ("fr-FR",)),
    Rule("abbreviations_pt", lambda lang: _add_period("Sr Sra Dr Dra Prof Eng"), _PT),
    Rule("ordinals", _ordinals, (*_PT, *_ES), True),
    Rule("abbreviations_en_us", lambda lang: _add_period("Ave Dr Gen Jr Mr Mrs Ms Prof Rev Sr St"), ("en-US",)),
    Rule("abbreviations_en_gb", lambda lang: [*_drop_period("Dr Jr Mr Mrs Ms Sr St", f"+{CAPITAL}"), *_add_period("Gen Prof Rev Vol")], ("en-GB",)),
    Rule("abbreviations_fr", lambda lang: [*_add_period("M"), *_drop_period("Mme Mlle Dr", "")], ("fr-FR",)),
    Rule("german_eszett", lambda lang: _words(dims.ESZETT), ("de-DE",)),
    Rule("german_din5008_spacing", _din, ("de-DE",)),
    Rule("ligature_suppression", lambda lang: _words({w.replace("|", ""): w.replace("|", ZWNJ) for w in dims.NO_LIGATURE[lang]}), ("de-DE", *_EN)),
    Rule("nbsp_after_title", _titles),
    Rule("nbsp_page_abbrev", _only(Sub(rf"({'|'.join(re.escape(p) for p in dims.PAGES)}) ([§d§])", rf"\1{NBSP}\2")), need="[.§] [§d§]"),
    Rule("single_letter_nbsp", _singles, tuple(dims.SINGLE_LETTERS), True),
    Rule("breakable_containers", _only(Sub(rf"(?<=[A-Z]\.{NBSP}[A-Z]\.){NBSP}(?=[A-Z]\.{NBSP}[A-Za-zÀ-ɏ])", " ", NBSP)), python=_containers_python, need=NBSP),
    Rule("abbreviation_haplology", _only(Sub(r"(§w§\.)\.(?=[§s§]|§end§)", r"\1", ".."))),
)
BY_NAME = {r.name: r for r in RULES}
#: The log names all abbreviation rules alike.
LOGGED_AS = {n: "abbreviation_periods" for n in BY_NAME if n.startswith("abbreviations_")}


def apply(name: str, c: Column, lang: str) -> Column:
    """The text after one rule."""
    return BY_NAME[name].apply(c, lang)


@cache
def of_language(lang: str, strict: bool = False) -> tuple[Rule, ...]:
    return tuple(r for r in RULES if r.holds(lang, strict))


def run_all(text: str, lang: str, strict: bool = False, before: tuple[Rule, ...] = (), after: tuple[Rule, ...] = ()) -> tuple[str, list[Edit]]:
    """A masked text after all rules of a language, and others before and after them, with the log."""
    log: list[Edit] = []
    for rule in _chain(lang, strict, before, after):
        own: list[Edit] = []
        text = rule.run(text, lang, own)
        log += [(p, a, b, LOGGED_AS.get(r, r)) for p, a, b, r in own]
    return text, log


def run_quietly(text: str, lang: str, strict: bool = False, before: tuple[Rule, ...] = (), after: tuple[Rule, ...] = ()) -> str:
    """The same without a log."""
    for rule in _chain(lang, strict, before, after):
        text = rule.run(text, lang, None)
    return text


@cache
def _chain(lang: str, strict: bool, before: tuple[Rule, ...], after: tuple[Rule, ...]) -> tuple[Rule, ...]:
    return (*(r for r in before if r.holds(lang, strict)), *of_language(lang, strict), *(r for r in after if r.holds(lang, strict)))
