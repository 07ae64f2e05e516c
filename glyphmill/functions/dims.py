"""Language-dependent constants: quote styles, word tables and the languages' inheritance."""

from __future__ import annotations

NBSP, NNBSP, THIN, ZWNJ, ZWSP, BOM = " ", " ", " ", "‌", "​", "﻿"

_CURLY, _ANGLE = ("“", "”", "‘", "’"), ("«", "»", "“", "”")
#: Language: opening and closing mark, the same for quotes within quotes, and the space inside the outer ones.
QUOTES: dict[str, tuple[str, str, str, str, str]] = {
    **{lang: (*_CURLY, "") for lang in "en-US es-MX nl-BE nl-NL pt-BR".split()},
    **{lang: (*_ANGLE, "") for lang in "es-ES it-IT sc".split()},
    "fr-FR": (*_ANGLE, NNBSP),
    "pt-PT": (*_ANGLE, THIN),
    "en-GB": ("‘", "’", "“", "”", ""),
    "de-DE": ("„", "“", "‹", "›", ""),
    "ro-RO": ("„", "”", "«", "»", ""),
}
LANGUAGES = tuple(sorted(QUOTES))
#: Of the corpus's two-letter codes.
LOCALES = {"en": "en-US", "fr": "fr-FR", "de": "de-DE", "es": "es-ES"}
PARENT = {"pt-BR": "pt-PT", "en-GB": "en-US", "es-MX": "es-ES", "sc": "it-IT", "nl-BE": "nl-NL"}
NAMES = dict(
    pair.split("=")
    for pair in (
        "sc=Sardinian;nl-NL=Dutch;nl-BE=Belgian Dutch;it-IT=Italian;ro-RO=Romanian;fr-FR=French;de-DE=German;"
        "es-ES=European Spanish;es-MX=Latin American Spanish;en-US=American English;en-GB=British English;"
        "pt-PT=European Portuguese;pt-BR=Brazilian Portuguese"
    ).split(";")
)

UNITS = tuple(
    sorted(
        "A GB GHz GW Hz L MB MHz MPa MW MWh PB Pa TB THz V W cl cm dl dpi em fps g hPa kB kHz kPa kV kW kWh kg km km/h l lb m m/s mA mV mg min ml mm ms nm ns oz pm ppi pt px rem rpm sec".split(),
        key=lambda u: (-len(u), u),
    )
)
FRACTIONS = {"2/3": "⅔", "1/3": "⅓", "3/4": "¾", "1/4": "¼", "1/2": "½"}
_OE = "coeur soeur oeuf oeuvre oeuvres boeuf boeufs voeu voeux noeud noeuds moeurs oeil oeillade oeillet oeillets oesophage".split()
#: In the order in which they are applied.
LIGATURES = {
    **{w: w.replace("oe", "œ") for w in _OE},
    **{"oedeme": "œdème", "oenologie": "œnologie", "oenologue": "œnologue", "oecumenique": "œcuménique"},
    **{w: w.replace("oe", "œ") for w in ("manoeuvre", "manoeuvres", "hors-d'oeuvre")},
}
FRENCH_CAPITALS = {
    **{w: "É" + w[1:] for w in "ECOLE ELECTION ENERGIE EPOQUE EQUIPE ETAIT ETAT ETUDE".split()},
    **{w: "Ê" + w[1:] for w in ("ETRE",)},
    **{w: "Î" + w[1:] for w in ("ILES", "ILE")},
    **{w: w.replace("HO", "HÔ", 1) for w in ("HOPITAL", "HOTE", "HOTEL")},
    **{"TETE": "TÊTE", "FETE": "FÊTE", "FORET": "FORÊT"},
}
ESZETT = {w: w.replace("SS", "ẞ") for w in "AUSSEN DRAUSSEN FLIESSEN FUSSBALL GIESSEN GROSSE GROSSEN GROSSER GROSSES GRUSS HEISS HEISSE MASSE MASSEN REISSEN SCHLIESSEN SPASS STRASSE WEISS WEISSE".split()} | {"GRUSSE": "GRÜẞE"}
#: In the order in which they are applied.
DIN_5008 = "z.B. d.h. u.a. e.V. u.U. o.g. s.o. s.u. u.v.m. i.d.R. m.E.".split()
#: A bar where the ligature is suppressed.
NO_LIGATURE = {
    "de-DE": "Auf|lage Auf|lagen Schiff|fahrt Schiff|fahrts Auf|lauf auf|lagen Staf|fel staf|fel Grif|fel grif|fel Kraft|fahrzeug Auf|findung Auf|führung".split(),
    "en-US": "half|life leaf|like shelf|ful shelf|fuls".split(),
}
NO_LIGATURE["en-GB"] = NO_LIGATURE["en-US"]
_TITLES = {"pt": "Sr. Sra. Dra. Eng.", "fr": "Mme Mlle M.", "de": "Fr. Hr.", "es": "Sr. Sra. Srta.", "it": "Sig. Sig.ra Dott."}
PAGES = ("fig.", "art.", "tab.", "pp.", "no.", "No.", "p.", "s.", "§")
SINGLE_LETTERS = {"fr-FR": "àyôû", "it-IT": "eoai", "es-ES": "yoeau", "es-MX": "yoeau", "pt-PT": "eéóao", "pt-BR": "eéóao"}
CEDILLAS = ("şţŞŢ", "șțȘȚ")


def titles(lang: str) -> list[str]:
    """Longest first, those of all languages before the language's own of the same length."""
    own = _TITLES.get(lang[:2], "") if lang not in ("sc",) else ""
    return sorted([*"Mr. Mrs. Ms. Dr. Prof.".split(), *own.split()], key=len, reverse=True)
