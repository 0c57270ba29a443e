"""Text normalisation built from JVM string functions, without Python UDFs."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

from atalaya.constants import PLACEHOLDER

# Behind the last block whose characters decompose into something that is kept.
LAST_POINT = 0x30000


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Compatibility decompositions to ASCII, derived by rule from the Unicode database.

    The translate pair holds one-to-one characters followed by characters of the common blocks
    that fold to nothing, which translate deletes. One-to-many characters form the map.
    """
    one_from, one_to, gone, many = [], [], [], {}
    for point in range(0x80, LAST_POINT):
        char = chr(point)
        if 0xAC00 <= point <= 0xD7FF or 0xD800 <= point <= 0xDFFF:
            continue
        plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            one_from.append(char)
            one_to.append(plain)
        elif len(plain) > 1:
            many[char] = plain
        elif point < 0x2600:
            gone.append(char)
    return "".join(one_from + gone), "".join(one_to), many


@lru_cache(maxsize=1)
def _mark_tables() -> tuple[str, str]:
    """Base letter of every precomposed character whose decomposition is letter + marks."""
    source, target = [], []
    for point in range(0x80, LAST_POINT):
        char = chr(point)
        if 0xAC00 <= point <= 0xD7FF or 0xD800 <= point <= 0xDFFF:
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", char)
                       if unicodedata.category(c) != "Mn")
        if base != char and len(base) == 1:
            source.append(char)
            target.append(base)
    return "".join(source), "".join(target)


def _is_ascii(col: Column) -> Column:
    """As many bytes as characters: a check without a regular expression."""
    return F.octet_length(col) == F.char_length(col)


def ascii_fold(col: Column) -> Column:
    """Compatibility-decompose, keep ASCII, drop everything else.

    ASCII text is returned as it is. Otherwise one hash-table translation settles nearly all
    characters; only text that still holds something else is mapped character by character.
    """
    source, target, many = _fold_tables()
    other = r"[^\x00-\x7F]"
    # One JSON literal keeps plan building cheap; the optimizer folds it into a map constant.
    table = F.from_json(F.lit(json.dumps(many)), "map<string,string>")
    plain = F.translate(col, source, target)
    mapped = F.array_join(F.transform(
        F.split(plain, ""), lambda ch: F.when(ch.rlike(other), F.coalesce(table[ch], F.lit(""))).otherwise(ch)), "")
    return F.when(_is_ascii(col), col).when(_is_ascii(plain), plain).otherwise(mapped)


def strip_marks(col: Column, lower: bool = True) -> Column:
    """Remove combining marks only; other characters stay as they are."""
    source, target = _mark_tables()
    bare = F.regexp_replace(F.translate(col, source, target), r"\p{Mn}", "")
    bare = F.when(_is_ascii(col), col).otherwise(bare)
    return F.lower(bare) if lower else F.upper(bare)


def norm_text(col: Column, placeholder: str = PLACEHOLDER) -> Column:
    """Canonical upper-case ASCII label without bracketed suffixes; blanks become the placeholder."""
    bare = F.when(F.contains(col, F.lit("(")), F.regexp_replace(col, r"\(.*?\)", "")).otherwise(col)
    # Folding turns no-break and other spaces into plain ones, so all white space is trimmed after it.
    text = F.trim(F.regexp_replace(ascii_fold(F.upper(bare)), r"\s+", " "))
    # One reference to `text` keeps the expression small: blanks are replaced by pattern.
    return F.coalesce(F.regexp_replace(text, "^(NAN)?$", placeholder), F.lit(placeholder))


def unaccent_lower(col: Column) -> Column:
    """Lower case with Spanish accents removed, the form used on both sides of a search."""
    return F.translate(F.lower(col), "áéíóúüñ", "aeiouun")


def category_canon(col: Column) -> Column:
    """Drop a leading `ARTICULO n.` and join words with underscores."""
    return F.regexp_replace(F.regexp_replace(col, r"^ARTICULO \d+\.\s*", ""), r"\s+", "_")


def words(col: Column) -> Column:
    """Upper-case ASCII words of a text, in order."""
    return F.regexp_extract_all(F.upper(ascii_fold(col)), F.lit("[A-Z0-9]+"), F.lit(0))
