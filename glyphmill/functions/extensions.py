"""Corrections beyond the 34 rules: specified by style guides, but not part of the default chain. Each has to be asked for.

They are ``Rule`` objects like the others. Most run after the default rules; NESTED runs before them and
takes the place of the quotation marks' rule. What a pattern can't tell is named at each.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from glyphmill.functions import dims
from glyphmill.functions.dims import NBSP, NNBSP, THIN
from glyphmill.functions.rules import LETTER, Edit, Rule, Sub, _begin, _only, _words

_EN, _DE, _FR = ("en-US", "en-GB"), ("de-DE",), ("fr-FR",)
_SPACED = ("de-DE", "es-ES", "fr-FR", "it-IT", "pt-PT", "ro-RO")
_NL = ("nl-NL", "nl-BE")
_SIGNS, _GAP = "€$£¥", f"[ {NBSP}{NNBSP}{THIN}]"


def _arrow(sign: str, arrow: str) -> Sub:
    return Sub(rf"{sign}(?<=[§s§]{sign})(?=[§s§])", arrow, sign)


def _currency(lang: str) -> list[Sub]:
    if lang in _EN:
        return [Sub(rf"([{_SIGNS}]){_GAP}+(?=[§d§])", r"\1")]
    if lang in _NL:
        return [Sub(rf"€{_GAP}?(?=[§d§])", "€" + NBSP, "€")]
    return [Sub(rf"([§d§]){_GAP}?([{_SIGNS}])(?![§d§])", rf"\1{NBSP}\2")]


def _percent(lang: str) -> list[Sub]:
    if lang in _EN:
        return [Sub(rf"([§d§]){_GAP}+%", r"\1%", "%")]
    return [Sub(rf"([§d§]){_GAP}?%", rf"\1{NNBSP if lang in _FR else NBSP}%", "%")]


AND = {"de": "und|oder", "es": "y|e|o|u", "fr": "et|ou", "it": "e|ed|o", "pt": "e|ou", "nl": "en|of", "ro": "și|sau"}


def _serial(lang: str) -> list[Sub]:
    item = "(?:§w§|[’\\-])+"
    if lang == "en-US":
        return [Sub(rf"(, {item}) (and|or)(?= §w§)", r"\1, \2", ", ")]
    return [Sub(rf"(, {item}), ({AND[lang[:2]]})(?=[ {NBSP}])", r"\1 \2", ", ")]


#: What begins a clause of its own, and what begins none, after a colon.
CLAUSE = {"en-US": "he she it they we you there".split(), "de-DE": "er sie es wir ihr ich du".split()}
FRAGMENT = {"en-US": ["To"], "fr": "Il Elle Ils Elles On Le La Les Un Une Des Ce Cette Je Tu Nous Vous".split(), "es": "El La Los Las Un Una Es Son".split(), "it": "Il Lo La I Gli Le Un Una Non".split(), "pt": "O A Os As Um Uma Ele Ela Não".split()}


def _colon(lang: str) -> list[Sub]:
    up = [Sub(rf": {w}(?= §w§)", f": {w.capitalize()}", f": {w} ") for w in CLAUSE.get(lang, ())]
    down = [Sub(rf": {w}(?= §w§)", f": {w.lower()}", f": {w} ") for w in FRAGMENT.get(lang, FRAGMENT.get(lang[:2], ()) if lang not in ("en-US", "en-GB") else ())]
    return [*up, *down]


_END = "(?=[§s§]|§end§)"


def _placement(lang: str) -> list[Sub]:
    closing, space = dims.QUOTES[lang][1], dims.QUOTES[lang][4]
    if lang == "en-US":
        return [Sub(r"”(?<=[^.,!?…:;]”)([.,])(?![.,])", r"\1”", "”")]
    gap = f"([{space}]?)" if space else "()"
    return [Sub(rf"([.,]){gap}{closing}{_END}", rf"\2{closing}\1", closing)]


_RAISED = "[⁰¹²³⁴⁵⁶⁷⁸⁹]"


def _footnotes(lang: str) -> list[Sub]:
    if lang[:2] in ("fr", "es"):
        return [Sub(rf"(?<={LETTER})([.,])({_RAISED}+)", r"\2\1")]
    return [Sub(rf"(?<={LETTER})({_RAISED}+)([.,])", r"\2\1")]


_ASKED = {"Donde": "Dónde", "Que": "Qué", "Como": "Cómo", "Cuando": "Cuándo", "Quien": "Quién", "Cual": "Cuál", "Cuanto": "Cuánto", "Por que": "Por qué"}
SPANISH = {w: new for w, new in (p.split("=") for p in "increible=increíble dificil=difícil facil=fácil tambien=también despues=después ademas=además".split())}


def _inverted(lang: str) -> list[Sub]:
    """Whole sentences only; a clause that begins inside one isn't found."""
    begins = r"(?:(?<![\s\S])|(?<=[.!?…][§s§])|(?<=\n))"
    sentence = lambda mark, first: Sub(rf"{begins}(§w§[^.!?…¿¡\n]*)\{mark}", rf"{first}\1{mark}", mark)
    opened = [Sub(rf"{first}{a}(?!§w§)", f"{first}{b}", first + a) for first in "¿¡" for a, b in _ASKED.items()]
    return [sentence("?", "¿"), sentence("!", "¡"), *opened, *_words(SPANISH)]


_ACUTE = "perché poiché affinché finché benché giacché né".split()
_GRAVE = "è cioè caffè città così più già può però università".split()
_PLAIN = str.maketrans("éèàìòù", "eeaiou")


def _italian(lang: str) -> list[Sub]:
    out = []
    for w in (*_ACUTE, *_GRAVE):
        for x in (w, w[0].upper() + w[1:]):
            bare = x.translate(_PLAIN) if x[0] not in "ÈÉ" else "E" + x[1:].translate(_PLAIN)
            out.append(Sub(f"{_begin(bare[0])}{bare[1:]}['’](?!§w§)", x, bare))
    return out


_CAPITALS = {
    "es": dict(p.split("=") for p in "MEXICO=MÉXICO BOGOTA=BOGOTÁ AREA=ÁREA LINGUISTICA=LINGÜÍSTICA NUMERO=NÚMERO PAGINA=PÁGINA TELEFONO=TELÉFONO".split()),
    "it": dict(p.split("=") for p in "CITTA=CITTÀ UNIVERSITA=UNIVERSITÀ PIU=PIÙ CAFFE=CAFFÈ LIBERTA=LIBERTÀ".split()),
    "pt": dict(p.split("=") for p in "AGUA=ÁGUA SAO=SÃO NAO=NÃO AREA=ÁREA NUMERO=NÚMERO PAGINA=PÁGINA".split()),
}
_UPPER = "[A-ZÀ-ÖØ-Þ]"


def _dashes(lang: str) -> list[Sub]:
    if lang == "es-ES":
        return [Sub(r" - ([^\-\n]+) - ", r" —\1— ", " - ")]
    new = f"{NNBSP}—{NNBSP}" if lang == "fr-FR" else " – "
    return [Sub(r" - (?<=[^\-§d§] - )(?=[^\-§d§])", new, " - ")]


def nested_quotes(text: str, lang: str, log: list[Edit] | None = None) -> str:
    """A mark opens where white space, a bracket or another opening mark is before it and none after it; within an open quote it opens the inner kind."""
    outer, inner = dims.QUOTES[lang][:2], dims.QUOTES[lang][2:4]
    space = dims.QUOTES[lang][4]
    straight = "'" if lang == "en-GB" else '"'
    out, depth, opened = [], 0, True
    for i, c in enumerate(text):
        if c != straight:
            out.append(c)
            opened = c.isspace() or c in "([{—–-"
            continue
        after = text[i + 1 : i + 2]
        between = lang == "en-GB" and i and text[i - 1].isalnum() and after.isalnum()
        opens = opened and after and not after.isspace()
        if between or (not opens and not depth):
            out.append(c)
            opened = False
            continue
        if not opens:
            depth -= 1
        marks = inner if depth else outer
        new = marks[0] + (space if not depth else "") if opens else (space if not depth else "") + marks[1]
        if opens:
            depth += 1
        if log is not None:
            log.append((i, c, new, "quotation_marks"))
        out.append(new)
        opened = bool(opens)
    return "".join(out)


def _nested_column(c: Column, lang: str) -> Column:
    run = lambda x: pa.array([None if t is None else nested_quotes(t, lang) for t in x.to_pylist()], pa.string())
    return F.arrow_udf(run, StringType())(c)


_WHITE = re.compile(r"\s")


def _widows_python(text: str, lang: str, log: list[Edit] | None) -> str:
    """Each line's end alone: a search by the pattern reads four words again from every character."""
    out, at = [], 0
    for line in text.split("\n"):
        first, *words = line.rsplit(" ", 3)
        if len(words) == 3 and all(words) and first and not first[-1].isspace() and not any(map(_WHITE.search, words)):
            first = first.rsplit(None, 1)[-1]
            old, new = " ".join((first, *words)), f"{first} {words[0]} {words[1]}{NBSP}{words[2]}"
            if log is not None:
                log.append((at + len(line) - len(old), old, new, "widows"))
            out.append(line[: len(line) - len(old)] + new)
        else:
            out.append(line)
        at += len(line) + 1
    return "\n".join(out)


NESTED = Rule("nested_quotes", column=_nested_column, python=nested_quotes, need="['\"]")
RULES: tuple[Rule, ...] = (
    Rule("arrows", _only(_arrow("<->", "↔"), _arrow("->", "→"), _arrow("<-", "←"))),
    Rule("currency", _currency, (*_EN, *_SPACED, *_NL), need=f"[{_SIGNS}]"),
    Rule("percent", _percent, (*_EN, *_SPACED)),
    Rule("thousands", _only(Sub("(?<=[§d§]) (?=[§d§]{3}(?![§d§]))", NNBSP)), _FR),
    Rule("serial_comma", _serial, ("en-US", *_SPACED, *_NL)),  # by single words: can't tell a list from other commas
    Rule("colon_capitalisation", _colon, ("en-US", "de-DE", "fr-FR", "es-ES", "es-MX", "it-IT", "pt-PT", "pt-BR"), need=": "),  # names stay, as only listed words change
    Rule("quote_punctuation", _placement),  # can't tell whether punctuation belongs to what is quoted
    Rule("footnote_marks", _footnotes, need=_RAISED),
    Rule("inverted_marks", _inverted, ("es-ES", "es-MX")),
    Rule("italian_accents", _italian, ("it-IT",), need="['’]"),
    Rule("capital_accents", lambda lang: _words(_CAPITALS[lang[:2]]), ("es-ES", "es-MX", "it-IT", "pt-PT", "pt-BR")),
    Rule("french_capital_a", _only(Sub(rf"A(?<!§w§A)(?= {_UPPER}{{2}})", "À")), _FR),
    Rule("locale_dashes", _dashes, ("de-DE", "it-IT", "fr-FR", "es-ES"), need=" - "),
    Rule("initials_exemption", _only(Sub(rf"(?<![A-Z]\.{NBSP})([A-Z]\.){NBSP}([A-Z]\.)(?!{NBSP}[A-Z]\.)", r"\1\2", NBSP)), _EN),  # U.S., not J. R. R.
    Rule("whitespace", _only(Sub(r"[ \t]+(?=\n|§end§)", ""), Sub(r"(?<=[^§s§])(?:  +|[ \t]*\t[ \t]*)(?=[^§s§])", " "))),
    Rule("widows", _only(Sub(r"([^§s§]+ [^§s§]+ [^§s§]+) ([^§s§]+)(?=\n|§end§)", rf"\1{NBSP}\2")), python=_widows_python),
)
BY_NAME = {r.name: r for r in (NESTED, *RULES)}
#: Those that don't change what a whole document looks like.
USUAL = tuple(r.name for r in RULES if r.name not in ("widows", "whitespace", "locale_dashes", "thousands"))


def chosen(names: tuple[str, ...]) -> tuple[bool, tuple[Rule, ...]]:
    """Whether quotes are nested, and the rules that run after the others, in their order."""
    unknown = set(names) - BY_NAME.keys()
    if unknown:
        raise ValueError(f"no such extensions: {sorted(unknown)}")
    return "nested_quotes" in names, tuple(r for r in RULES if r.name in names)
