"""Text clean-up as column expressions; Python only for what Spark has no function for, and only on cells that need it."""

from __future__ import annotations

import html.parser
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Zero-width characters, the byte order mark and the soft hyphen.
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff\u00ad"
#: Control characters that go; tab, line feed and carriage return stay.
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
#: What ends a URL.
URLS = (r"https?://[^\s<>\"']+", r"www\.[^\s<>\"']+")
#: White space at either end as Python's strip takes it.
ENDS = r"(?U)\A[\s\x1C-\x1F]+|[\s\x1C-\x1F]+\z"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, ENDS, "")


def without_zero_width(c: Column) -> Column:
    return F.translate(c, ZERO_WIDTH, "")


def without_controls(c: Column) -> Column:
    return F.regexp_replace(c, CONTROLS, "")


def normal_spaces(c: Column) -> Column:
    """Runs of spaces and tabs to one space, three line feeds or more to two, both ends stripped."""
    # a space alone is left as it is
    return strip(F.regexp_replace(F.regexp_replace(c, r" [ \t]+|\t[ \t]*", " "), r"\n{3,}", "\n\n"))


def without_urls(c: Column) -> Column:
    for pattern in URLS:
        c = F.regexp_replace(c, pattern, "")
    return c


def words(c: Column) -> Column:
    """Between runs of Unicode white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def literal(replacement: str) -> str:
    """A replacement that regexp_replace takes as it stands."""
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


@F.pandas_udf(T.StringType())
def _nfc(cells: pd.Series) -> pd.Series:
    return cells.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


#: Characters that the normal form C leaves as they are and that join with none before them (checked in the tests); with others alone a text may change.
SETTLED = r"\x{0}-\x{2FF}\x{388}-\x{482}\x{48A}-\x{590}\x{2002}-\x{20CF}\x{3001}-\x{3029}\x{3030}-\x{3098}\x{309B}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}\x{1F000}-\x{1FAFF}"


def nfc(c: Column) -> Column:
    """Only cells that may change go to Python. Its functions are asked before any condition around them is looked at, so the others are null there."""
    return F.coalesce(_nfc(F.when(c.rlike(f"[^{SETTLED}]"), c)), c)


def repaired(text: str) -> str:
    """UTF-8 that was read as Windows-1252 or Latin-1, read right; other text unchanged."""
    for codec in ("cp1252", "latin-1"):
        try:
            return text.encode(codec).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
    return text


@F.pandas_udf(T.StringType())
def _repaired(cells: pd.Series) -> pd.Series:
    return cells.map(repaired, na_action="ignore")


def encoding_fixed(c: Column) -> Column:
    """Only cells with a lead byte's character and a continuation byte's behind it are looked at."""
    return F.when(c.rlike("[ÂÃâ][\u0080-¿Œ-˜–-™]"), _repaired(c)).otherwise(c)


class _Text(html.parser.HTMLParser):
    """Text nodes outside scripts, style sheets and templates."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden, self.going = [], 0, False

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "template")
        self.going = False

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "template") and self.hidden > 0
        self.going = False

    def handle_comment(self, data):
        self.going = False

    handle_decl = handle_pi = unknown_decl = handle_comment

    def handle_data(self, data):
        # the parser may give one text node in pieces
        if self.going and not self.hidden:
            self.parts[-1] += data
        elif not self.hidden:
            self.parts.append(data)
            self.going = True


def html_text(markup: str) -> str:
    parser = _Text()
    parser.feed(markup)
    parser.close()
    return " ".join(parser.parts)


@F.pandas_udf(T.StringType())
def _html_text(cells: pd.Series) -> pd.Series:
    return cells.map(html_text, na_action="ignore")


def without_tags(c: Column) -> Column:
    """Texts with both < and > only."""
    return F.when(c.contains("<") & c.contains(">"), _html_text(c)).otherwise(c)


def without_tags_jvm(c: Column) -> Column:
    """The same by patterns, without Python: scripts, styles, comments and tags to spaces, and the five basic entities."""
    c0 = c
    for pattern, to in ((r"(?is)<(script|style|template)\b.*?</\1\s*>", " "), (r"(?s)<!--.*?-->", " "), (r"(?s)<[^>]*>", " ")):
        c = F.regexp_replace(c, pattern, to)
    for entity, to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(to))
    return F.when(c0.contains("<") & c0.contains(">"), c).otherwise(c0)
