"""Text functions: lines, words, tokens, estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import TOKENS_PER_WORD

#: After each of these a new line begins (CR has become LF when the file was read).
_LINE_END = "(?<=[\n\x0b\f\x1c-\x1e\x85\u2028\u2029])"
#: What Python's str.split() takes for white space, ASCII range and the common others.
BLANK = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def decoded(raw: Column) -> Column:
    """Bytes as text: invalid UTF-8 replaced, line ends unified."""
    return F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "\r\n?", "\n")


def lines(text: Column) -> Column:
    """Lines with their ends; an empty text has none."""
    return F.filter(F.split(text, _LINE_END, -1), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, BLANK, -1), lambda x: x != ""))


def estimated_tokens(text: Column) -> Column:
    """Words times a fixed factor, cut to a whole number."""
    return F.floor(word_count(F.coalesce(text, F.lit(""))) * F.lit(TOKENS_PER_WORD)).cast("int")


#: Accented Latin letters and what they fold to; covers Latin-1 and Latin Extended-A.
def _folding() -> tuple[str, str]:
    import unicodedata

    pairs = []
    for code in range(0xC0, 0x180):
        plain = unicodedata.normalize("NFD", chr(code))
        if len(plain) > 1 and plain[0].isascii():
            pairs.append((chr(code), plain[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _folding()


def fts_tokens(text: Column) -> Column:
    """Runs of letters and digits, lower case, without diacritics."""
    low = F.regexp_replace(F.translate(F.lower(text), _ACCENTED, _PLAIN), r"\p{M}+", "")
    return F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def bare_name(name: Column) -> Column:
    """What follows the last colon and then the last slash."""
    return F.element_at(F.split(F.element_at(F.split(name, ":"), -1), "/"), -1)
