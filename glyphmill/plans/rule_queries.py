"""One query a rule over all documents, and its DuckDB equivalent.

The corpus itself has little to correct, therefore both sides first put the same noise into every
text: replacements inside it and a tail with matches and look-alikes. The SQL isn't derived from the
rules' definitions: it has no lookaround, and works by capture groups that are applied again where
neighbours overlap, by splitting at the marks, or by window functions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import dims, extensions, rules
from glyphmill.functions.dims import BOM, NBSP, NNBSP, THIN, ZWNJ, ZWSP

ANY = rules.BY_NAME | extensions.BY_NAME
NW = r"[^\p{L}\p{N}_]"
CAP = r"[A-ZÀ-ɏ]"
WS = r"[\s ]"
AFTER = r"($|[\s  ,;:.!?)\]}])"


def q(s: str) -> str:
    """As an SQL literal, spelling out what could be read wrongly."""
    parts, plain = [], ""
    for c in s:
        if c == "'" or ord(c) < 32:
            parts += [f"'{plain}'"] if plain else []
            parts.append(f"chr({ord(c)})")
            plain = ""
        else:
            plain += c
    parts += [f"'{plain}'"] if plain or not parts else []
    return parts[0] if len(parts) == 1 else "(" + " || ".join(parts) + ")"


def rx(x: str, *steps: tuple) -> str:
    """x after each (pattern, replacement, times) in turn."""
    for pattern, new, *times in steps:
        for _ in range(times[0] if times else 1):
            x = f"regexp_replace({x}, {q(pattern)}, {q(new)}, 'g')"
    return x


def lit(x: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def word(w: str, new: str, flags: str = "") -> tuple:
    return (rf"(^|{NW}){w}($|{NW})", rf"\1{new}\2", 2)


def gained(*marks: str) -> str:
    """How many more of the marks y has than x."""
    return " + ".join(f"(length(y) - length(replace(y, {q(m)}, ''))) - (length(x) - length(replace(x, {q(m)}, '')))" for m in marks)


@dataclass(frozen=True)
class Query:
    rule: str
    lang: str
    tail: str  # '#' stands for doc_id % 90 + 10
    sql: Callable[[str], str] | None
    inside: tuple[tuple[str, str], ...] = ()
    n: str | None = None  # number of matches, in x (before) and y (after)

    def noised(self) -> Column:
        c = F.col("text")
        for a, b in self.inside:
            c = F.replace(c, F.lit(a), F.lit(b))
        parts = [F.lit(p) for p in self.tail.split("#")]
        number = (F.col("doc_id") % 90 + 10).cast("string")
        out = [parts[0]]
        for p in parts[1:]:
            out += [number, p]
        return F.concat(c, *out)

    def noised_sql(self) -> str:
        c = lit("text", list(self.inside))
        return f"({c} || " + " || (doc_id % 90 + 10)::VARCHAR || ".join(q(p) for p in self.tail.split("#")) + ")"

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", self.noised().alias("x"))
        rule = ANY[self.rule]
        done = docs.select("doc_id", "x", rules.linted(F.col("x"), rule, self.lang).alias("r"))
        if self.n is None or rule.column:
            return done.select("doc_id", "r.corrected", (F.col("r.corrected") != F.col("x")).alias("changed"))
        # no step makes or hides another's matches, so that their numbers add up to those in the text as it was
        return done.select("doc_id", "r.corrected", "r.n")

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        counted = f"({self.n})::BIGINT AS n" if self.n and not ANY[self.rule].column else "y <> x AS changed"
        if self.sql is nested_sql:
            return nested_sql(self.noised_sql())
        return f"SELECT doc_id, y AS corrected, {counted} FROM (SELECT doc_id, x, {self.sql('x')} AS y FROM (SELECT doc_id, {self.noised_sql()} AS x FROM documents))"


def nested_sql(noised: str) -> str:
    """Depth is the running sum less its running minimum below 0; a mark of depth 2 and more changes."""
    return f"""WITH t AS (SELECT doc_id, {noised} AS x FROM documents),
p AS (SELECT doc_id, x, string_split_regex(x, '[()]') AS seg, regexp_extract_all(x, '[()]') AS marks FROM t),
m AS (SELECT doc_id, unnest(marks) AS mark, generate_subscripts(marks, 1) AS i FROM p),
s AS (SELECT *, sum(CASE mark WHEN '(' THEN 1 ELSE -1 END) OVER w AS total FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
d AS (SELECT *, total - least(0, min(total) OVER w) AS depth FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY doc_id ORDER BY i), 0) AS before FROM d),
g AS (SELECT doc_id, list(CASE WHEN mark = '(' AND depth > 1 THEN '[' WHEN mark = ')' AND before > 1 THEN ']' ELSE mark END ORDER BY i) AS changed FROM b GROUP BY doc_id),
j AS (SELECT p.doc_id, x, CASE WHEN changed IS NULL THEN x ELSE array_to_string(list_transform(seg, lambda v, i: CASE WHEN i <= len(changed) THEN v || changed[i] ELSE v END), '') END AS y FROM p LEFT JOIN g USING (doc_id))
SELECT doc_id, y AS corrected, y <> x AS changed FROM j"""


def _quotes(lang: str) -> Callable[[str], str]:
    opening, closing, _, _, space = dims.QUOTES[lang]
    return lambda x: f"array_to_string(list_transform(string_split({x}, '\"'), lambda v, i: CASE WHEN i = 1 THEN v WHEN i % 2 = 0 THEN {q(opening + space)} || v ELSE {q(space + closing)} || v END), '')"


def _ligature_steps() -> list[tuple]:
    steps = []
    for w, new in dims.LIGATURES.items():
        steps.append(word(f"{w[0].upper()}(?i:{w[1:]})", new[0].upper() + new[1:]))
        steps.append(word(f"{w[0]}(?i:{w[1:]})", new))
    return steps


def _high(x: str) -> str:
    x = rx(lit(x, [("://", "\1")]), (r":(\\[\s\S])", "\2\\1"))
    for mark in (";", "!", r"\?", ":"):
        x = rx(x, (rf"[ {NBSP}{THIN}]{mark}", NNBSP + mark[-1]), (rf"([^ {NBSP}{THIN}{NNBSP}\n\r\t]){mark}", rf"\1{NNBSP}{mark[-1]}", 2))
    return lit(x, [("\1", "://"), ("\2", ":")])


def _periods(words: str) -> list[tuple]:
    return [(rf"(^|{NW}){w}({WS}+{CAP})", rf"\1{w}.\2", 2) for w in words.split()]


def _no_periods(words: str, ahead: str) -> list[tuple]:
    return [(rf"(^|{NW}){w}\.({WS}{ahead})", rf"\1{w}\2", 2) for w in words.split()]


def _tables(pairs: dict[str, str]) -> Callable[[str], str]:
    return lambda x: rx(x, *[word(a, b) for a, b in pairs.items()])


def _titles(lang: str) -> Callable[[str], str]:
    names = sorted([*("Mr.", "Mrs.", "Ms.", "Dr.", "Prof."), *{"en": (), "fr": ("Mme", "Mlle", "M."), "de": ("Fr.", "Hr.")}[lang[:2]]], key=len, reverse=True)
    return lambda x: rx(x, *[(rf"{t.replace('.', '[.]')} ({CAP})", rf"{t}{NBSP}\1", 2) for t in names])


def _no_ligature(lang: str) -> dict[str, str]:
    return {w.replace("|", ""): w.replace("|", ZWNJ) for w in dims.NO_LIGATURE[lang]}


_SINGLE_BEFORE = rf"""(^|[\s{NBSP}{NNBSP}{THIN}—–‒(\[{{"'«“„‘‹])"""


def _singles(letters: str) -> Callable[[str], str]:
    return lambda x: rx(x, *[(rf"{_SINGLE_BEFORE}{w} ([^\s{NBSP}{NNBSP}{THIN}])", rf"\1{w}{NBSP}\2", 2) for c in letters for w in (c, c.upper())])


_CHAIN = f"[{NBSP}\1]"
DASHED = ((", ", " - "),)
QUERIES: dict[str, Query] = {
    "rule_nfc_normalization": Query("nfc_normalization", "en-US", " e\u0301te\u0301 A\u030a # n\u0303", lambda x: f"nfc_normalize({x})"),
    "rule_zero_width_chars": Query("zero_width_chars", "en-US", f" a{ZWSP}b{ZWSP}c 1{ZWSP}2 x{ZWSP} {ZWSP}{ZWSP} z{BOM}w {BOM} u\u200dv #{ZWSP}", lambda x: f"(left({lit(rx(x, (rf'(\p{{L}}){ZWSP}(\p{{L}})', r'\1 \2', 2)), [(ZWSP, '')])}, 1) || replace(substring({lit(rx(x, (rf'(\p{{L}}){ZWSP}(\p{{L}})', r'\1 \2', 2)), [(ZWSP, '')])}, 2), {q(BOM)}, ''))"),
    "rule_romanian_diacritics": Query("romanian_diacritics", "ro-RO", " şi ţară Şi Ţara ș ț #", lambda x: "translate(" + x + ", 'şţŞŢ', 'șțȘȚ')", n=gained(*"șțȘȚ")),
    "rule_french_ligatures": Query("french_ligatures", "fr-FR", " coeur Soeur OEUVRE hors-d'oeuvre coeurs boeuf boeuf, noeud. coefficient #oeuf manoeuvre", lambda x: rx(x, *_ligature_steps()), n=gained("œ", "Œ")),
    "rule_french_capital_accents": Query("french_capital_accents", "fr-FR", " ETAT ETAT ÉTAT ETATS FORET HOTEL, ILE. AGE MEME Etat #ECOLE", _tables(dims.FRENCH_CAPITALS), n=gained(*"ÉÊÎÔ")),
    "rule_homoglyph_detection": Query("homoglyph_detection", "de-DE", " #ºC 5°F 90º 1º2º 3ºa 7ºK. Straβe 1ºCa 5° C", lambda x: lit(rx(x, (rf"([0-9])º([CFK])($|{NW})", rf"\1{NBSP}°\2\3"), (rf"([0-9])°([CFK])($|{NW})", rf"\1{NBSP}°\2\3"), (r"([0-9])º($|[^a-zA-Z])", r"\1°\2", 2)), [("β", "ß")])),
    "rule_ellipsis": Query("ellipsis", "en-US", " a.... b.. c...... #...", lambda x: rx(x, (r"[.][.][.]", "…")), ((", ", "... "),), gained("…")),
    "rule_legal_symbols": Query("legal_symbols", "en-US", " (c) (C) 2020 Foo(r) (R) (tm) (TM) (Tm) (cc) (t) ( c) #", lambda x: rx(x, (r"\([cC]\)", "©"), (r"\([rR]\)", "®"), (r"\([tT][mM]\)", "™")), n=gained("©", "®", "™")),
    "rule_fractions": Query("fractions", "en-US", " 1/2 1/2 cup 3/4, 11/2 1/2/3 1/3. 2/3 1/4 5/6 #1/2 1/25", lambda x: rx(x, *[(rf"(^|[^0-9]){a}($|[^0-9/])", rf"\1{b}\2", 2) for a, b in dims.FRACTIONS.items()]), n=gained(*"½¼¾⅓⅔")),
    "rule_primes": Query("primes", "en-US", " 5'#\" tall, 6' 10\" 45'30 7'' 3', 5\"x 9\" it's 12'", lambda x: rx(x, ("([0-9]+)'([0-9]+)(\"|'')?", "\\1′\\2″"), (f"([0-9]+)'{AFTER}", "\\1′\\2"), (f'([0-9]+)"{AFTER}', "\\1″\\2"))),
    "rule_quotation_marks": Query("quotation_marks", "en-US", ' He said "yes" and "no # "', _quotes("en-US"), ((". ", '." "'),)),
    "rule_quotation_marks_fr": Query("quotation_marks", "fr-FR", ' Il dit "oui" et "non" #', _quotes("fr-FR"), ((". ", '." "'),)),
    "rule_quotation_marks_gb": Query("quotation_marks", "en-GB", " 'hello' don't 'tis dogs' 'a'b' #''", None, ((", ", "', '"),)),
    "rule_apostrophe": Query("apostrophe", "en-US", " don't l'eau dogs' 'tis a'1'b x'_y''z #'s", lambda x: rx(x, (r"([\p{L}\p{N}_])'([\p{L}\p{N}_])", r"\1’\2", 2)), ((" the ", " th'e "),), gained("’")),
    "rule_em_dash": Query("dashes", "en-US", " 5 - 3 a - b - c -- d  - -e # - x", lambda x: rx(x, (r"([^\-0-9]) - ([^\-0-9])", r"\1—\2", 2)), DASHED, gained("—")),
    "rule_en_dash": Query("dashes", "en-GB", " 5 - 3 a - b - c -- d  - -e # - x", lambda x: rx(x, (r"([^\-0-9]) - ([^\-0-9])", r"\1 – \2", 2)), DASHED, gained("–")),
    "rule_range_dash": Query("range_dash", "en-US", " pp. 10-20 2020-2025 a1-2 a12-3 3-4b 1-2-3 10-20-30 10-20a -5-6 7--8 #-99", lambda x: rx(x, (r"(^|[^a-zA-Z\-])([0-9])-([0-9])($|[^a-zA-Z\-])", r"\1\2–\3\4", 3)), n=gained("–")),
    "rule_minus_sign": Query("minus_sign", "en-US", " x -5 (-3) =-2 a-7 5 - 3 - 1 :-1 ,-4 - 6 -# #", lambda x: rx(x, (rf"([\s(=:,{NBSP}])-([0-9])", r"\1−\2"), (r"^-([0-9])", r"−\1"), (r"([0-9]) - ([0-9])", r"\1 − \2")), DASHED, gained("−")),
    "rule_multiplication_sign": Query("multiplication_sign", "en-US", " 3x4 2x3x4 1920 X 1080 3 x y 5xx6 #x#", lambda x: rx(x, (r"([0-9])\s?[xX]\s?([0-9])", f"\\1{THIN}×{THIN}\\2")), n=gained("×")),
    "rule_double_space": Query("double_space", "en-US", " a.  b;   c  d #,  ", lambda x: rx(x, (r"([.!?;:,])  +", r"\1 ")), ((". ", ".   "),), "len(regexp_extract_all(x, '[.!?;:,]  +'))"),
    "rule_number_unit_spacing": Query("number_unit_spacing", "en-US", " 10kg 5m 20A 3km/h, 7kgs 12mm. 4px) 100GHz 6mins 8kWh 9min 3 kg #GB", lambda x: rx(x, (rf"([0-9])({'|'.join(dims.UNITS)}){AFTER}", rf"\1{NBSP}\2\3")), n=gained(NBSP)),
    "rule_number_unit_spacing_fr": Query("number_unit_spacing", "fr-FR", " 10kg 5m 20A 3km/h, 7kgs 12mm. #GB", lambda x: rx(x, (rf"([0-9])({'|'.join(dims.UNITS)}){AFTER}", rf"\1{NNBSP}\2\3")), n=gained(NNBSP)),
    "rule_nested_parentheticals": Query("nested_parentheticals", "en-US", " ((a (b)) c) d) (e (f # )", nested_sql, ((", ", " (("), (". ", ")) "))),
    "rule_nbsp_between_initials": Query("nbsp_between_initials", "en-US", " J.R.R. Tolkien U.S. A.B c.D. E.F.G.H. #", lambda x: rx(x, (r"([A-Z]\.)([A-Z]\.)", rf"\1{NBSP}\2", 2)), n=gained(NBSP)),
    "rule_french_high_punctuation": Query("french_high_punctuation", "fr-FR", f" a ; b! c ? d: e http://x f !! g:\\h i{NNBSP}; j{NBSP}! # :", _high, ((", ", "; "), (". ", " ! ")), gained(NNBSP)),
    "rule_abbreviations_pt": Query("abbreviations_pt", "pt-PT", " O Sr Silva e a Dra Ana, Dr. Rui, Eng  Costa Srx Ana Sr silva # Prof Sr Ana", lambda x: rx(x, *_periods("Sr Sra Dr Dra Prof Eng")), n=gained(".")),
    "rule_ordinals_pt": Query("ordinals", "pt-PT", " 5o 3a #o 10as 2o. 7oa", lambda x: rx(x, (rf"([0-9]+)o($|{NW})", r"\1.º\2"), (rf"([0-9]+)a($|{NW})", r"\1.ª\2")), n=gained("º", "ª")),
    "rule_ordinals_es": Query("ordinals", "es-ES", " 3er 5o 3a #er 10as 2o. 7ero", lambda x: rx(x, (rf"([0-9]+)(?:er|o)($|{NW})", r"\1.º\2"), (rf"([0-9]+)a($|{NW})", r"\1.ª\2")), n=gained("º", "ª")),
    "rule_abbreviations_en_us": Query("abbreviations_en_us", "en-US", " Mr Smith and Dr Jones, Mrs. Hill St Mary Mr smith XMr Lee # Gen Prof Lee", lambda x: rx(x, *_periods("Mr Mrs Ms Dr St Jr Sr Ave Prof Rev Gen")), n=gained(".")),
    "rule_abbreviations_en_gb": Query("abbreviations_en_gb", "en-GB", " Mr. Smith and Dr. Jones, Prof Hill St. Mary Mr. smith Vol Two # Rev. Lee", lambda x: rx(x, *_no_periods("Mr Mrs Ms Dr St Jr Sr", f"{WS}*{CAP}"), *_periods("Prof Rev Gen Vol"))),
    "rule_abbreviations_fr": Query("abbreviations_fr", "fr-FR", " M Dupont et Mme. Durand, Dr. Blanc Mlle. # M dupont", lambda x: rx(x, *_periods("M"), *_no_periods("Mme Mlle Dr", ""))),
    "rule_german_eszett": Query("german_eszett", "de-DE", " STRASSE GROSSE GROSSE, WISSEN GRUSSE Strasse STRASSEN SPASS. #HEISS", _tables(dims.ESZETT), n=gained("ẞ")),
    "rule_german_din5008": Query("german_din5008_spacing", "de-DE", " z.B. d.h. u.v.m. i.d.R. a.k. xz.B. Z.B. (o.k. #) v.l.", lambda x: rx(lit(x, [("z.B.", f"z.{NNBSP}B."), ("d.h.", f"d.{NNBSP}h."), ("u.a.", f"u.{NNBSP}a."), ("e.V.", f"e.{NNBSP}V."), ("u.U.", f"u.{NNBSP}U."), ("o.g.", f"o.{NNBSP}g."), ("s.o.", f"s.{NNBSP}o."), ("s.u.", f"s.{NNBSP}u."), ("u.v.m.", f"u.{NNBSP}v.{NNBSP}m."), ("i.d.R.", f"i.{NNBSP}d.{NNBSP}R."), ("m.E.", f"m.{NNBSP}E.")]), (rf"(^|{NW})([a-zäöü])\.([a-zA-ZäöüÄÖÜ])\.", rf"\1\2.{NNBSP}\3."))),
    "rule_ligature_suppression": Query("ligature_suppression", "de-DE", " Auflage Auflagen, Schifffahrt auflagen Auflagenx Aufführung Staffel Staffel #", _tables(_no_ligature("de-DE")), n=gained(ZWNJ)),
    "rule_ligature_suppression_en": Query("ligature_suppression", "en-US", " shelfful halflife leaflike, shelffuls halflifes #", _tables(_no_ligature("en-US")), n=gained(ZWNJ)),
    "rule_nbsp_after_title": Query("nbsp_after_title", "en-US", " Mr. Smith met Dr. Élan and Prof. Mr. Lee Mrs. x Ms.  Y # Dr. Dr. No", _titles("en-US"), n=gained(NBSP)),
    "rule_nbsp_after_title_fr": Query("nbsp_after_title", "fr-FR", " Mme Dupont M. Noir femme Anne Mlle X # M. M. Y", _titles("fr-FR"), n=gained(NBSP)),
    "rule_nbsp_page_abbrev": Query("nbsp_page_abbrev", "en-US", " p. 5 pp. 6 stop. 7 no. 8 No. 9 § 1 art. 2 fig. 3 tab. 4 p.5 p.  6 #", lambda x: rx(x, (r"(fig\.|art\.|tab\.|pp\.|no\.|No\.|p\.|s\.|§) ([0-9])", rf"\1{NBSP}\2")), ((". ", "s. 12 "),), gained(NBSP)),
    "rule_single_letter_nbsp": Query("single_letter_nbsp", "fr-FR", " il va à Paris, y à l'eau (à voir) À y ô ville #", _singles("àyôû"), n=gained(NBSP)),
    "rule_single_letter_nbsp_es": Query("single_letter_nbsp", "es-ES", " pan y vino o agua a ella Y él «y no» #", _singles("yoeau"), n=gained(NBSP)),
    "rule_breakable_containers": Query("breakable_containers", "en-US", f" J.{NBSP}R.{NBSP}R.{NBSP}Tolkien A.{NBSP}B.{NBSP}C.{NBSP}D.{NBSP}E.{NBSP}Word X.{NBSP}Y.{NBSP}Z K.{NBSP}L.{NBSP}M.{NBSP}N.{NBSP}# J.{NBSP}K", lambda x: lit(rx(x, (rf"([A-Z]\.{_CHAIN}[A-Z]\.){NBSP}([A-Z]\.{_CHAIN}[A-Za-zÀ-ɏ])", "\\1\1\\2", 6)), [("\1", " ")])),
    "rule_abbreviation_haplology": Query("abbreviation_haplology", "en-US", " etc.. Wait.. a... b.. .. # x..", lambda x: rx(x, (r"([\p{L}\p{N}_]\.)\.($|\s)", r"\1\2")), ((". ", ".. "),), "length(x) - length(y)"),
}
