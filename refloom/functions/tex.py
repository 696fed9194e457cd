"""TeX to plain text: accents in an Arrow UDF, all else as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from refloom.functions.idents import CITE
from refloom.functions.text import squeeze, strip_chars, strip_comments

#: The mark that each accent command sets, and letters that are commands of their own.
ACCENTS = {
    "'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "u": "\u0306", "v": "\u030c", "H": "\u030b",
    "r": "\u030a", "c": "\u0327", "k": "\u0328", "d": "\u0323", "b": "\u0331",
}
LETTERS = {"o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "ss": "ß", "aa": "å", "AA": "Å", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "i": "i", "j": "j"}
#: Commands whose argument says nothing, whose argument is the text, and that only switch a font.
DROPPED = ("label", "ref", "cref", "vspace", "hspace", "resizebox", "footnote", "rowcolor", "cellcolor", "columncolor", "colorbox", "textcolor", "color")
UNWRAPPED = ("textbf", "textit", "texttt", "textsc", "emph", "mathrm", "mathbf", "text", "bm", "underline", "scalebox", "makecell", "thead", "tabincell")
SWITCHES = ("small", "footnotesize", "scriptsize", "tiny", "large", "Large", "normalsize", "centering", "bf", "it")
PROSE_CITES = ("cite", "citep", "citet", "citealp", "citealt", "citeauthor", "citeyear", "citenum", "parencite", "textcite", "autocite", "footcite")
HEADINGS = ("section", "subsection", "subsubsection", "chapter", "paragraph")


def decode_accents(text: str | None) -> str | None:
    r"""The characters that accent commands denote: \"o and \"{o} are both o with two dots."""
    if not text or "\\" not in text:
        return text
    out, at = [], 0
    while at < len(text):
        found = _accent(text, at) if text[at] == "\\" else None
        if found is None:
            out.append(text[at])
            at += 1
        else:
            out.append(found[0])
            at = found[1]
    return "".join(out)


_AFTER = re.compile(r"\s*(?:\{\s*([A-Za-z])\s*\}|([A-Za-z]))")


def _accent(text: str, at: int) -> tuple[str, int] | None:
    """(character, end) of the command that begins at a backslash, if it sets an accent or is a letter."""
    name = re.compile(r"[A-Za-z]+|.", re.DOTALL).match(text, at + 1)
    if name is None:
        return None
    command, end = name.group(), name.end()
    if command in ACCENTS and (not command.isalpha() or re.compile(r"[{\s]").match(text, end)):
        base = _AFTER.match(text, end)
        return (unicodedata.normalize("NFC", (base.group(1) or base.group(2)) + ACCENTS[command]), base.end()) if base else None
    if command in LETTERS:
        return LETTERS[command], re.compile(r"\s*\{?\}?").match(text, end).end()
    return None


@F.pandas_udf(StringType())
def tex_accents(texts: pd.Series) -> pd.Series:
    return texts.map(decode_accents, na_action="ignore")


def accents(c: Column) -> Column:
    """Accent commands as the characters that they denote; texts without a backslash don't leave the JVM."""
    return F.coalesce(tex_accents(F.when(F.contains(c, F.lit("\\")), c)), c)


def strip_tex(c: Column) -> Column:
    """Prose of a piece of TeX: citations and headings go with their arguments, formatting commands leave theirs, a tie is a space."""
    c = accents(F.coalesce(c, F.lit("")))
    c = F.regexp_replace(c, r"\\(?:" + "|".join(PROSE_CITES) + r")\*?\s*(?:\[[^\]]*\]\s*){0,2}\{[^}]*\}", " ")
    c = F.regexp_replace(c, r"\\(?:" + "|".join(HEADINGS) + r")\*?\s*\{[^}]*\}", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"\\newblock", " "), r"\\(?:emph|textit|textbf|texttt|url|href)\s*\{([^}]*)\}", "$1")
    c = F.regexp_replace(F.replace(c, F.lit("\\&"), F.lit("&")), r"\\[a-zA-Z]+\*?", " ")
    c = F.regexp_replace(F.replace(c, F.lit("~"), F.lit(" ")), r"[{}]", "")
    return strip_chars(F.regexp_replace(c, r"\s+", " "), " .,")


def strip_cell(c: Column) -> Column:
    """Text of a table cell, header or caption; escaped signs are kept, so that 84.21\\% is a number."""
    raw = c = F.coalesce(c, F.lit(""))
    c = F.regexp_replace(strip_comments(c), CITE, " ")
    c = F.regexp_replace(c, r"\\(?:" + "|".join(DROPPED) + r")\s*(?:\[[^\]]*\])?\s*\{[^}]*\}", " ")
    for _ in range(6):  # innermost first
        c = F.regexp_replace(c, r"\\(?:" + "|".join(UNWRAPPED) + r")\s*(?:\{[^{}]*\})?\s*\{([^{}]*)\}", "$1")
    c = F.regexp_replace(F.regexp_replace(c, r"\\(?:" + "|".join(SWITCHES) + r")\b", " "), r"\\([%&_#\$])", "$1")
    c = F.regexp_replace(F.regexp_replace(c, r"\\[a-zA-Z@]+\s*(?:\[[^\]]*\])?", " "), r"[{}$]", "")
    # most cells hold no TeX, and none of the above changes them
    plain = F.when(raw.rlike(r"[\\{}$%~]"), F.replace(c, F.lit("~"), F.lit(" "))).otherwise(raw)
    return strip_chars(squeeze(plain), " .,;:")


def heading_text(c: Column) -> Column:
    """A heading without commands."""
    return squeeze(F.regexp_replace(c, r"\\[a-zA-Z]+", ""))
