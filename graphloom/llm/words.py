"""Words of a text, with what does not count as a difference taken away."""

from __future__ import annotations

import html
import re
import unicodedata

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans(
    "аеорсухіјѕԁһԛԝкмтвнгАВЕКМНОРСТХУІЈЅ" "αεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeopcyxijsdhqwkmtbhrABEKMHOPCTXYIJS" "aeiknoptuxABEZHIKMNOPTYX",
)
#: Tags that stand inside words.
INLINE = "a|abbr|b|code|em|font|i|mark|s|small|span|strong|sub|sup|tt|u"
_INLINE = re.compile(rf"</?(?:{INLINE})(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_WORD = re.compile(r"[^\W_]+")


def _uncommented(text: str) -> str:
    parts, at = [], 0
    while (low := text.find("<!--", at)) >= 0 and (high := text.find("-->", low)) >= 0:
        parts.append(text[at:low])
        at = high + 3
    return " ".join([*parts, text[at:]])


def plain(text: str) -> str:
    """Lower-case text without markup, escapes, invisible and disguised characters."""
    if "&" in text:
        text = html.unescape(text)
    if "\\u" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m.group(1), 16)), text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", _uncommented(text)))
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if unicodedata.category(c) not in ("Mn", "Cf")).translate(LOOKALIKES)
    return text.lower()


def words(text: str) -> list[str]:
    """Runs of letters and digits of the plain text."""
    return _WORD.findall(plain(text))
