"""The 83 sentences by which a correction engine is judged, with what is to change in each.

A line is the rule, the case's number, and the sentence, in which {old|new} marks a change.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BATCHES: dict[str, int] = {
    rule: batch
    for batch, names in enumerate(
        (
            "accents dashes ellipsis french_spacing inverted_punctuation measurements ordinals quotation range",
            "code_exclusion normalization zero_width_characters",
            "capital_accents diacritic_correctness eszett_capitalisation homoglyph_detection orthographic_ligatures",
            "din5008_abbreviations high_punctuation_spacing nbsp_obligations single_letter_line_end",
            "abbreviation_haplology abbreviation_periods colon_capitalisation footnote_mark_placement nested_parentheticals quote_punctuation_placement serial_comma",
            "ligature_suppression orthographic_ligature_preservation",
            "bidi_isolate_preservation breakable_containers screen_reader_typography",
        )
    )
    for rule in names.split()
}
SENTENCES = {
    "de-DE": """
quotation 4 Er sagte {"|„}danke{"|“} und ging.
zero_width_characters 26 Auf\u200clage
eszett_capitalisation 33 STRA{SS|ẞ}E
eszett_capitalisation 34 GRO{SS|ẞ}E
homoglyph_detection 39 Es sind 5{º|\u00a0°}C draußen.
homoglyph_detection 40 Die Stra{β|ß}e ist lang.
din5008_abbreviations 44 z.{|\u202f}B. ist das interessant.
din5008_abbreviations 45 d.{|\u202f}h. wir kommen morgen.
din5008_abbreviations 46 Der e.{|\u202f}V. tagt morgen u.{|\u202f}a. zum Thema.
colon_capitalisation 58 Das Ergebnis war klar: {e|E}r war schuldig.
serial_comma 61 rot, weiß{,|} und blau
quote_punctuation_placement 64 Er nannte es „großartig{|“}.{“|}
footnote_mark_placement 72 Typografie ist wichtig{|.}¹{.|}
ligature_suppression 74 Auf{|\u200c}lage
ligature_suppression 75 Schiff{|\u200c}fahrt
""",
    "en-GB": """
quotation 2 She whispered {'|‘}be careful{'|’} to him.
dashes 9 The project {-|–} a massive undertaking {-|–} succeeded.
quote_punctuation_placement 63 He called it ‘magnificent{|’}.{’|}
abbreviation_periods 66 Mr{.|} Smith and Dr{.|} Jones arrived.
""",
    "en-US": """
quotation 1 She whispered {"|“}be careful{"|”} to him.
dashes 8 The project{ - |—}a massive undertaking{ - |—}succeeded.
range 10 See chapters 3{-|–}7.
ellipsis 15 And then{...|…}
measurements 16 Display: 2560{x|\u2009×\u2009}1440 resolution.
code_exclusion 19 Use `"hello"` in your code, but {"|“}hello{"|”} in prose.
code_exclusion 20 The URL https://example.com/path?q="test" should stay.
normalization 22 r{e\u0301|é}sum{e\u0301|é}
zero_width_characters 24 Hello{\u200b|} world
zero_width_characters 25 Copy{\u200b| }paste{\u200b| }artifact
homoglyph_detection 38 The temperature is 20{º|\u00a0°}C.
nbsp_obligations 47 J.{|\u00a0}R.{|\u00a0}R. Tolkien wrote The Hobbit.
nbsp_obligations 50 See p.{ |\u00a0}42 for details.
colon_capitalisation 55 The verdict was clear: {h|H}e was guilty.
colon_capitalisation 56 She had one goal: {T|t}o win.
serial_comma 59 red, white{|,} and blue
quote_punctuation_placement 62 He called it {"|“}magnificent{"|}.{|”}
abbreviation_periods 65 Mr{ |.\u00a0}Smith and Dr{ |.\u00a0}Jones arrived.
abbreviation_haplology 68 They sell fruit, vegetables, etc.{.|}
abbreviation_haplology 69 He works for Acme Corp.{.|}
footnote_mark_placement 70 Typography matters{|.}¹{.|}
nested_parentheticals 73 The result (as noted by Smith {(|[}2020{)|]}) was significant.
ligature_suppression 76 shelf{|\u200c}ful
breakable_containers 79 J.\u00a0R.{\u00a0| }R.\u00a0Tolkien
bidi_isolate_preservation 80 The name is \u2066\u05e9\u05dc\u05d5\u05dd\u2069 in Hebrew.
screen_reader_typography 81 See pages 10{-|–}20 for details.
screen_reader_typography 82 Mix {1/4|¼} cup of flour{...|…}
""",
    "es-ES": """
quotation 6 Ella dijo {"|«}gracias{"|»} y{ |\u00a0}se fue.
inverted_punctuation 12 {|¿}D{o|ó}nde vives?
inverted_punctuation 13 {|¡}Qu{e|é} incre{i|í}ble!
ordinals 18 El 3{er|.º} piso.
single_letter_line_end 52 Pan y{ |\u00a0}agua.
""",
    "es-MX": """
quotation 7 Ella dijo {"|“}gracias{"|”} y{ |\u00a0}se fue.
""",
    "fr-FR": """
quotation 3 Il a dit {"|«\u202f}merci{"|\u202f»} et est parti.
french_spacing 11 Vraiment{|\u202f}? Oui{|\u202f}!
code_exclusion 21 La variable `nom_d'utilisateur` contient {"|«\u202f}Jean{"|\u202f»}.
normalization 23 {E\u0301|É}TAT
capital_accents 30 L{'E|’É}TAT
capital_accents 31 {A|À} PARIS
capital_accents 32 H{O|Ô}TEL DE VILLE
orthographic_ligatures 35 Il a du c{oe|œ}ur.
orthographic_ligatures 36 C{'|’}est une {oe|œ}uvre magistrale.
orthographic_ligatures 37 Ma s{oe|œ}ur est partie.
high_punctuation_spacing 41 Pourquoi{|\u202f}? Parce que{|\u202f}: c{'|’}est ainsi.
high_punctuation_spacing 42 Attention{|\u202f}; ceci est important{|\u202f}!
high_punctuation_spacing 43 Il a dit{|\u202f}: {"|«\u202f}Oui{|\u202f}!{"|\u202f»}
nbsp_obligations 48 Mme{ |\u00a0}Curie a decouvert le radium.
single_letter_line_end 51 Il va à{ |\u00a0}la gare.
colon_capitalisation 57 Le verdict est clair\u202f: {I|i}l est coupable.
serial_comma 60 rouge, blanc{,|} et bleu
abbreviation_periods 67 M{ |.\u00a0}Dupont et Mme{. |\u00a0}Curie sont arrivés.
footnote_mark_placement 71 La typographie est importante{|¹}.{¹|}
orthographic_ligature_preservation 77 Il a du c{oe|œ}ur et sa s{oe|œ}ur aussi.
orthographic_ligature_preservation 78 C’est une {oe|œ}uvre de b{oe|œ}uf.
""",
    "it-IT": """
quotation 5 Ha detto {"|«}grazie{"|»} ed è andato via.
accents 14 Perch{e'|é} non vieni con noi?
single_letter_line_end 53 Pane e{ |\u00a0}acqua.
""",
    "pt-PT": """
quotation 0 Ele disse {"|«\u2009}obrigado{"|\u2009»} e{ |\u00a0}saiu.
ordinals 17 O{ |\u00a0}5{o|.º} andar do edifício.
nbsp_obligations 49 O{ |\u00a0}Sr.{ |\u00a0}Silva chegou.
single_letter_line_end 54 Pão e{ |\u00a0}água.
""",
    "ro-RO": """
diacritic_correctness 27 {ş|ș}coa{ţ|ț}lă
diacritic_correctness 28 Bucure{ş|ș}ti
diacritic_correctness 29 cuno{ş|ș}tin{ţ|ț}e
""",
}
_CHANGE = re.compile(r"\{([^{|}]*)\|([^{|}]*)\}")


def rows() -> list[tuple[int, str, str, str, str]]:
    """(case_id, language, rule, input, expected), by case."""
    out = []
    for lang, lines in SENTENCES.items():
        for line in lines.strip().split("\n"):
            rule, number, marked = line.split(" ", 2)
            out.append((int(number), lang, rule, _CHANGE.sub(r"\1", marked), _CHANGE.sub(r"\2", marked)))
    return sorted(out)


def cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "case_id int, language string, rule string, input string, expected string")
