"""Characters that fonts may lack: names, tiers of risk and what to fall back to."""

from __future__ import annotations

#: Name and code point; without one it only stands for several characters.
_PRIMITIVES = (
    "ae_ligature=E6 ae_ligature_cap=C6 ampersand=26 apostrophe=2019 asterisk=2A asterism=2042 bullet=2022 capital_sharp_s=1E9E cent_sign=A2 comma=2C "
    "copyright_sign=A9 dagger=2020 degree_sign=B0 dollar_sign=24 double_S= double_dagger=2021 double_prime=2033 ellipsis=2026 em_dash=2014 en_dash=2013 "
    "euro_sign=20AC fraction_half=BD fraction_one_third=2153 fraction_quarter=BC fraction_slash=2044 fraction_three_quarters=BE fraction_two_thirds=2154 "
    "fsi=2068 hair_space=200A hyphen=2D hyphen_minus=2D interrobang=203D inverted_exclamation=A1 inverted_question=BF left_angle_quote=AB left_arrow=2190 "
    "left_double_quote=201C left_single_angle_quote=2039 left_single_quote=2018 low_double_quote=201E low_single_quote=201A lri=2066 middle_dot=B7 "
    "minus_sign=2212 multiplication_sign=D7 narrow_no_break_space=202F non_breaking_space=A0 numero_sign=2116 oe_ligature=153 oe_ligature_cap=152 "
    "ordinal_indicator_fem=AA ordinal_indicator_masc=BA paragraph_sign=B6 pdi=2069 per_mille=2030 percent=25 period=2E pound_sign=A3 prime=2032 "
    "registered_sign=AE regular_space=20 right_angle_quote=BB right_arrow=2192 right_double_quote=201D right_single_angle_quote=203A "
    "right_single_quote=2019 rli=2067 s_cedilla=15F s_comma_below=219 section_sign=A7 solidus=2F straight_double_quote=22 straight_single_quote=27 "
    "t_cedilla=163 t_comma_below=21B thin_space=2009 trademark_sign=2122 word_joiner=2060 yen_sign=A5 zwj=200D zwnj=200C "
)
PRIMITIVES: dict[str, int | None] = {k: int(v, 16) if v else None for k, v in (x.split("=") for x in _PRIMITIVES.split())}
SEVERAL = {"asterisk_asterisk": "**", "double_S": "SS", "letter_x": "x", "question_exclamation": "?!", "text_AE": "AE", "text_EUR": "EUR", "text_GBP": "GBP", "text_JPY": "JPY", "text_OE": "OE", "text_ae": "ae", "text_arrow_left": "<-", "text_arrow_right": "->", "text_cent": "c", "text_copyright": "(c)", "text_degree": "deg", "text_fraction_1_2": "1/2", "text_fraction_1_3": "1/3", "text_fraction_1_4": "1/4", "text_fraction_2_3": "2/3", "text_fraction_3_4": "3/4", "text_numero": "No.", "text_oe": "oe", "text_per_mille": "‰", "text_registered": "(R)", "text_section": "Sec.", "text_trademark": "(TM)", "three_periods": "..."}
_CHAINS = (
    "ae_ligature>text_ae ae_ligature_cap>text_AE bullet>hyphen_minus capital_sharp_s>double_S cent_sign>text_cent copyright_sign>text_copyright "
    "dagger>asterisk degree_sign>text_degree double_dagger>asterisk_asterisk double_prime>straight_double_quote ellipsis>three_periods "
    "em_dash>en_dash,hyphen_minus en_dash>hyphen_minus euro_sign>text_EUR fraction_half>text_fraction_1_2 fraction_one_third>text_fraction_1_3 "
    "fraction_quarter>text_fraction_1_4 fraction_slash>solidus fraction_three_quarters>text_fraction_3_4 fraction_two_thirds>text_fraction_2_3 fsi> "
    "hair_space>thin_space,regular_space interrobang>question_exclamation left_angle_quote>left_double_quote,straight_double_quote "
    "left_arrow>text_arrow_left left_double_quote>straight_double_quote left_single_angle_quote>left_single_quote,straight_single_quote "
    "left_single_quote>straight_single_quote low_double_quote>straight_double_quote low_single_quote>straight_single_quote lri> minus_sign>hyphen_minus "
    "multiplication_sign>letter_x narrow_no_break_space>thin_space,non_breaking_space,regular_space numero_sign>text_numero oe_ligature>text_oe "
    "oe_ligature_cap>text_OE pdi> per_mille>text_per_mille pound_sign>text_GBP prime>straight_single_quote registered_sign>text_registered "
    "right_angle_quote>right_double_quote,straight_double_quote right_arrow>text_arrow_right right_double_quote>straight_double_quote "
    "right_single_angle_quote>right_single_quote,straight_single_quote right_single_quote>straight_single_quote rli> s_comma_below>s_cedilla "
    "section_sign>text_section t_comma_below>t_cedilla thin_space>non_breaking_space,regular_space trademark_sign>text_trademark word_joiner>zwnj "
    "yen_sign>text_JPY zwj> zwnj> "
)
TIERS: dict[int, frozenset[int]] = {
    1: frozenset(range(0x20, 0x7F)),
    2: frozenset(map(ord, "\u00a0¡£¥§©®°¼½¾¿Æ×æŒœ–—‘’“”•…€™")),
    3: frozenset(map(ord, "ª«¶·º»\u2009\u200a‚„†‡\u202f‰′″‹›\u2044№⅓⅔−")),
    4: frozenset(map(ord, "șțẞ\u200c‽⁂\u2060\u2066\u2067\u2068\u2069←→")),
}


def resolve(name: str) -> int | str | None:
    """A code point, several characters, or nothing."""
    return PRIMITIVES.get(name) if PRIMITIVES.get(name) is not None else SEVERAL.get(name)


CHAINS: dict[int, list[int | str]] = {}
for _entry in _CHAINS.split():
    _head, _, _rest = _entry.partition(">")
    if PRIMITIVES.get(_head) is not None:
        CHAINS[PRIMITIVES[_head]] = [r for r in map(resolve, filter(None, _rest.split(","))) if r is not None]
#: Of the names of one code point the first here.
NAMES: dict[int, str] = {}
for _name in sorted(PRIMITIVES, key=lambda n: (n == "apostrophe", n)):
    if PRIMITIVES[_name] is not None:
        NAMES.setdefault(PRIMITIVES[_name], _name)


def tier(cp: int) -> int:
    return next((t for t, members in TIERS.items() if cp in members), 0)


def char_name(cp: int) -> str:
    return f"U+{cp:04X} {NAMES[cp]}" if cp in NAMES else f"U+{cp:04X}"
