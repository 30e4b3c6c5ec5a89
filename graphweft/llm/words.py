"""Words of a text regardless of how it is laid out or typed."""

from __future__ import annotations

import html
import re
import unicodedata

#: Letters of other scripts that look like a Latin one.
LOOKALIKES = str.maketrans(
    {
        "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
        "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ı": "i", "ο": "o", "α": "a", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u",
    }
)
INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]")
MARKS = re.compile("[\u0300-\u036f]")
BROKEN_WORD = re.compile(r"(?<=[^\W\d_])[-\u2010\u2011][ \t]*(?:\r\n|\r|\n)[ \t>]*(?=[^\W\d_])")
TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
ESCAPE = re.compile(r"\\[nrt\"]")
#: Blocks of scripts that are written without spaces (Thai, Lao, Burmese, Khmer, Kana, Han); each of their characters is a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(rf"[^\W_{UNSPACED}]+|(?!_)\w")


def plain(text: str) -> str:
    """Lower-case text without tags, entities, escapes, invisible characters, accents, look-alike letters and words broken at line ends."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub(" ", text)
    if "\\" in text:
        text = ESCAPE.sub(" ", text)
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFKD", INVISIBLE.sub("", text))).lower().translate(LOOKALIKES)
    else:
        text = text.lower()
    if "-\n" in text or "-\r" in text or "\u2010" in text or "- " in text:
        text = BROKEN_WORD.sub("", text)
    return text


def words(text: str) -> list[str]:
    return WORD.findall(plain(text))
