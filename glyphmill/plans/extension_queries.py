"""One query for each correction beyond the default chain, over all documents with the same noise on both sides, and its DuckDB equivalent."""

from __future__ import annotations

from glyphmill.functions.dims import NBSP, NNBSP, THIN
from glyphmill.plans.rule_queries import DASHED, NW, Query, q, rx, word

WS = rf"[\s{NBSP}{NNBSP}{THIN}]"
NOT = rf"[^\s{NBSP}{NNBSP}{THIN}]"
GAP = f"[ {NBSP}{NNBSP}{THIN}]"
W = r"[\p{L}\p{N}_]"
UP = "[A-ZÀ-ÖØ-Þ]"


def _initials(x: str) -> str:
    """Chains of initials; those of two lose the space."""
    chain = q(rf"[A-Z]\.(?:{NBSP}[A-Z]\.)+")
    return f"array_to_string(list_transform(string_split_regex({x}, {chain}), lambda v, i: v || coalesce(CASE WHEN length(regexp_extract_all({x}, {chain})[i]) = 5 THEN replace(regexp_extract_all({x}, {chain})[i], {q(NBSP)}, '') ELSE regexp_extract_all({x}, {chain})[i] END, '')), '')"


def _inverted(x: str) -> str:
    x = rx(x, (rf"(^|[.!?…]{WS}|\n)({W}[^.!?…¿¡\n]*)\?", r"\1¿\2?", 2), (rf"(^|[.!?…]{WS}|\n)({W}[^.!?…¿¡\n]*)!", r"\1¡\2!", 2))
    asked = [("Donde", "Dónde"), ("Que", "Qué"), ("Como", "Cómo"), ("Cuando", "Cuándo"), ("Quien", "Quién"), ("Cual", "Cuál"), ("Cuanto", "Cuánto"), ("Por que", "Por qué")]
    x = rx(x, *[(rf"{first}{a}($|{NW})", rf"{first}{b}\1") for first in "¿¡" for a, b in asked])
    words = [("increible", "increíble"), ("dificil", "difícil"), ("facil", "fácil"), ("tambien", "también"), ("despues", "después"), ("ademas", "además")]
    return rx(x, *[word(a, b) for a, b in words])


_ITALIAN = "perche perché Perche Perché poiche poiché Poiche Poiché affinche affinché Affinche Affinché finche finché Finche Finché benche benché Benche Benché giacche giacché Giacche Giacché ne né Ne Né e è E È cioe cioè Cioe Cioè caffe caffè Caffe Caffè citta città Citta Città cosi così Cosi Così piu più Piu Più gia già Gia Già puo può Puo Può pero però Pero Però universita università Universita Università".split()
_SPANISH = [("MEXICO", "MÉXICO"), ("BOGOTA", "BOGOTÁ"), ("AREA", "ÁREA"), ("LINGUISTICA", "LINGÜÍSTICA"), ("NUMERO", "NÚMERO"), ("PAGINA", "PÁGINA"), ("TELEFONO", "TELÉFONO")]
_CLAUSE = [("er", "Er"), ("sie", "Sie"), ("es", "Es"), ("wir", "Wir"), ("ihr", "Ihr"), ("ich", "Ich"), ("du", "Du")]

QUERIES: dict[str, Query] = {
    "ext_arrows": Query("arrows", "en-US", " a -> b <- c <-> d ->e f-> g => h -> -> # <-", lambda x: rx(x, *[(rf"({WS}){a}({WS})", rf"\1{b}\2", 2) for a, b in (("<->", "↔"), ("->", "→"), ("<-", "←"))]), ((", ", " -> "), (". ", " <- "))),
    "ext_currency": Query("currency", "en-US", f" $ 10 £{NBSP}5 €  # $x 10 $ ¥ y", lambda x: rx(x, (rf"([€$£¥]){GAP}+([0-9])", r"\1\2"))),
    "ext_currency_fr": Query("currency", "fr-FR", f" 10 € 5$ #{NNBSP}£, 7€8 9  € x€", lambda x: rx(x, (rf"([0-9]){GAP}?([€$£¥])($|[^0-9])", rf"\1{NBSP}\2\3", 2))),
    "ext_percent": Query("percent", "en-US", f" 5 % #{NBSP}% 7% 8  % x %", lambda x: rx(x, (rf"([0-9]){GAP}+%", r"\1%"))),
    "ext_percent_fr": Query("percent", "fr-FR", f" 5 % #% 7{NBSP}% 8  % x %", lambda x: rx(x, (rf"([0-9]){GAP}?%", rf"\1{NNBSP}%"))),
    "ext_thousands": Query("thousands", "fr-FR", " 1 000 000 12 34 5 6789 7 # 100 000", lambda x: rx(x, (r"([0-9]) ([0-9]{3})($|[^0-9])", rf"\1{NNBSP}\2\3", 4))),
    "ext_serial_comma": Query("serial_comma", "en-US", " red, white and blue or salt and pepper, ab, c or d, #-x, e’f and g", lambda x: rx(x, (rf"(, (?:{W}|[’\-])+) (and|or)( {W})", r"\1, \2\3")), ((" the ", ", this and "),)),
    "ext_serial_comma_de": Query("serial_comma", "de-DE", " rot, weiß, und blau, a, b, oder c, und #", lambda x: rx(x, (rf"(, (?:{W}|[’\-])+), (und|oder)([ {NBSP}])", r"\1 \2\3")), ((" und ", ", x, und "),)),
    "ext_colon": Query("colon_capitalisation", "de-DE", " klar: er war: es : wir, X: ich gehe: dumm #", lambda x: rx(x, *[(rf": {a}( {W})", rf": {b}\1") for a, b in _CLAUSE]), ((", ", ": er "),)),
    "ext_quote_punctuation": Query("quote_punctuation", "en-US", " “a”. “b.”, “c”.. “d?”. “#”, ”.", lambda x: rx(x, (r"([^.,!?…:;])”([.,])($|[^.,])", r"\1\2”\3", 2)), ((", ", "”, "),)),
    "ext_footnotes": Query("footnote_marks", "en-US", " a¹. b²³, 5². c.¹ d⁴! #¹.", lambda x: rx(x, (r"(\p{L})([⁰¹²³⁴⁵⁶⁷⁸⁹]+)([.,])", r"\1\3\2")), ((", ", "¹, "),)),
    "ext_footnotes_fr": Query("footnote_marks", "fr-FR", " a.¹ b,²³ 5.² c¹. #.¹", lambda x: rx(x, (r"(\p{L})([.,])([⁰¹²³⁴⁵⁶⁷⁸⁹]+)", r"\1\3\2")), ((", ", ",¹ "),)),
    "ext_inverted_marks": Query("inverted_marks", "es-ES", " fin. Donde? Como estas? Que increible! ya.\nCuando # fue? ¿Que? Quienes!", _inverted, ((", ", "? "),)),
    "ext_italian_accents": Query("italian_accents", "it-IT", " perche' Perche’, e' un caffe' citta'x ne' l'e' E' # piu'", lambda x: rx(x, *[(rf"(^|{NW}){a}['’]($|{NW})", rf"\1{b}\2", 2) for a, b in zip(_ITALIAN[::2], _ITALIAN[1::2], strict=True)]), ((" the ", " piu' "),)),
    "ext_capital_accents": Query("capital_accents", "es-ES", " MEXICO DF BOGOTA, AREAS AREA AREA #PAGINA", lambda x: rx(x, *[word(a, b) for a, b in _SPANISH])),
    "ext_french_capital_a": Query("french_capital_a", "fr-FR", " A PARIS A Lyon LA VILLE A A NICE #A BC", lambda x: rx(x, (rf"(^|{NW})A( {UP}{UP})", r"\1À\2", 2))),
    "ext_dashes_de": Query("locale_dashes", "de-DE", " 5 - 3 a - b - c -- d  - -e # - x", lambda x: rx(x, (r"([^\-0-9]) - ([^\-0-9])", r"\1 – \2", 2)), DASHED),
    "ext_initials": Query("initials_exemption", "en-US", f" U.{NBSP}S. J.{NBSP}R.{NBSP}R. Tolkien A.{NBSP}B.{NBSP}Cd E. F. # X.{NBSP}Y.{NBSP}Z.", _initials),
    "ext_whitespace": Query("whitespace", "en-US", " a\tb  c \nd \t e   \n\n f #  ", lambda x: rx(x, (r"[ \t]+(\n|$)", r"\1"), (rf"({NOT})(?:  +|[ \t]*\t[ \t]*)({NOT})", r"\1 \2", 2)), ((", ", "  \t"), (". ", " \n"))),
    "ext_widows": Query("widows", "en-US", " this is a # sentence.", lambda x: rx(x, (rf"({NOT}+ {NOT}+ {NOT}+) ({NOT}+)(\n|$)", rf"\1{NBSP}\2\3")), ((". ", ".\n"),)),
}
