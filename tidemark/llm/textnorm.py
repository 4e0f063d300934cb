"""Normal forms of texts shared by the operators of this subpackage (plain Python, no Spark)."""

from __future__ import annotations

import re
import unicodedata

# Letters of other scripts that look like a Latin letter, in alphabetical order of the Latin one.
LOOKALIKES = {
    "а": "a", "α": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "ε": "e", "ɡ": "g", "һ": "h", "н": "h",
    "і": "i", "ı": "i", "ι": "i", "ј": "j", "к": "k", "κ": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "ο": "o",
    "р": "p", "ρ": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "τ": "t", "υ": "u", "ν": "v", "ѵ": "v", "ԝ": "w",
    "х": "x", "χ": "x", "у": "y", "γ": "y",
    "А": "A", "Α": "A", "В": "B", "Β": "B", "С": "C", "Е": "E", "Ε": "E", "Н": "H", "Η": "H", "І": "I", "Ι": "I",
    "Ј": "J", "К": "K", "Κ": "K", "М": "M", "Μ": "M", "Ν": "N", "О": "O", "Ο": "O", "Р": "P", "Ρ": "P", "Ѕ": "S",
    "Т": "T", "Τ": "T", "Х": "X", "Χ": "X", "У": "Y", "Υ": "Y", "Ζ": "Z",
}
#: Characters without a width of their own: soft hyphen, joiners, direction marks, byte-order mark, variation selectors.
INVISIBLE = "­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩︀︎️﻿"
_FOLD = {ord(k): v for k, v in LOOKALIKES.items()} | {ord(c): None for c in INVISIBLE}
_TAG = re.compile(r"</?[a-zA-Z][a-zA-Z0-9]{0,9}(?:\s[^<>]{0,80})?/?>")
_MARK = re.compile(r"\*\*|__|~~|`+|(?<!\w)[*_](?=\S)|(?<=\S)[*_](?!\w)|^\s{0,3}(?:#{1,6}|>|[-*+]|\d{1,3}[.)])\s+", re.M)
_START = re.compile(r"^\s{0,3}(?:#{1,6}|>|[-*+]|\d{1,3}[.)])\s+", re.M)
_WORD = re.compile(r"[^\W_]+")
#: Anything but ASCII, the letters of Latin-1 and common punctuation; texts without it need no compatibility form.
_UNUSUAL = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ÿ¿¡«»“”„‘’–—€]")


def fold(text: str) -> str:
    """NFKC, look-alike letters as Latin ones, nothing invisible, lower case."""
    if text.isascii() or not _UNUSUAL.search(text):
        return text.casefold()
    return unicodedata.normalize("NFKC", text.translate(_FOLD)).translate(_FOLD).casefold()


def strip_markup(text: str) -> str:
    """Without HTML tags, emphasis, code marks and marks at the start of a line."""
    if "<" in text:
        text = _TAG.sub("", text)
    # without marks inside of lines only their starts matter
    return (_MARK if "*" in text or "_" in text or "~" in text or "`" in text else _START).sub("", text)


def words(text: str | None) -> list[str]:
    """The words of a text in their normal form; none for null."""
    return _WORD.findall(fold(strip_markup(text))) if text else []
