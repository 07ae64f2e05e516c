"""Patterns written once for Java's and Python's regular expressions.

Python's classes are Unicode-aware, Java's aren't by default. A template names a class between
section signs, and both dialects spell it out with the same meaning:

§w§ word character   §b§ word boundary    §s§ white space, for use inside brackets
§d§ digit, inside brackets                §end§ end of text or before a final line feed
§i§ opens a group that ignores case
"""

from __future__ import annotations

import re
from functools import lru_cache

_WORD = r"[\p{L}\p{N}_]"
_SPACE = r"\t\n\x0B\f\r \x1c-\x1f\x85\xA0  -     　"
#: One white-space character.
SPACE = f"[{_SPACE}]"
_JAVA = {"w": _WORD, "b": rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))", "s": _SPACE, "d": r"\p{Nd}", "end": r"(?=\n?\z)", "i": "(?iu:"}
_PYTHON = {"w": r"\w", "b": r"\b", "s": r"\s", "d": r"\d", "end": r"(?=\n?\Z)", "i": "(?i:"}


def _fill(template: str, names: dict[str, str]) -> str:
    return re.sub("§(\\w+)§", lambda m: names[m[1]], template)


def java(template: str) -> str:
    return _fill(template, _JAVA)


@lru_cache(maxsize=1024)
def python(template: str) -> re.Pattern:
    return re.compile(_fill(template, _PYTHON))


def java_replacement(template: str) -> str:
    r"""\1 .. \9 stand for groups in a template; everything else is literal."""
    out = []
    for part in re.split(r"(\\\d)", template):
        out.append("$" + part[1] if re.fullmatch(r"\\\d", part) else part.replace("\\", "\\\\").replace("$", "\\$"))
    return "".join(out)


def python_template(template: str) -> str:
    """For re.sub."""
    return "".join(rf"\g<{p[1]}>" if re.fullmatch(r"\\\d", p) else p.replace("\\", r"\\") for p in re.split(r"(\\\d)", template))


def python_replacement(template: str):
    parts = re.split(r"(\\\d)", template)
    return lambda m: "".join(m[int(p[1])] if re.fullmatch(r"\\\d", p) else p for p in parts)
