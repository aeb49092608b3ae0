"""Rules on single characters: decomposition, combining classes, look-alikes, invisible ones."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

# Letters of other scripts, and marks, with the Latin letter or ASCII mark that they look like.
LOOKALIKES = dict(
    pair.split()
    for pair in """
А A|В B|С C|Е E|Н H|І I|Ј J|К K|М M|О O|Р P|Ѕ S|Т T|Х X|У Y|Ү Y|Ԛ Q|Ԝ W|Ӏ I
а a|с c|е e|һ h|і i|ј j|о o|р p|ѕ s|х x|у y|ԁ d|ԛ q|ԝ w|ѵ v|ӏ l|ү y
Α A|Β B|Ε E|Ζ Z|Η H|Ι I|Κ K|Μ M|Ν N|Ο O|Ρ P|Τ T|Υ Y|Χ X
α a|γ y|ι i|ν v|ο o|ρ p|υ u|ϲ c|ϳ j
ı i|ɑ a|ɡ g|ո n|ս u|օ o|հ h|զ q
Ꭺ A|Ᏼ B|Ꮯ C|Ꭰ D|Ꭼ E|Ꮐ G|Ꮋ H|Ꭻ J|Ꮶ K|Ꮮ L|Ꮇ M|Ꮲ P|Ꮪ S|Ꭲ T|Ꮩ V|Ꮃ W|Ꮓ Z
‘ '|’ '|ʼ '|′ '|‐ -|‑ -|‒ -|– -|— -|− -
""".replace("\n", "|").split("|")
    if pair
)
# Kinds of compatibility forms that look like what they stand for.
SAME_LOOK = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>"}
# Characters without a shape beside those of category Cf.
INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


def is_space(c: str) -> bool:
    return c.isspace() or unicodedata.category(c) == "Zs"


@cache
def decompose(c: str) -> str:
    """What a character is made of, as far as it looks the same; nothing for an invisible one, a space for white space."""
    if is_space(c):
        return " "
    if ord(c) in INVISIBLE or unicodedata.category(c) == "Cf":
        return ""
    if 0xAC00 <= ord(c) <= 0xD7A3:
        return unicodedata.normalize("NFD", c)
    parts = unicodedata.decomposition(c).split()
    if not parts:
        return c
    if parts[0].startswith("<"):
        if parts[0] not in SAME_LOOK:
            return c
        parts = parts[1:]
    return "".join(decompose(chr(int(p, 16))) for p in parts)


def combining(c: str) -> int:
    """The combining class; conjoining vowels and final consonants of Hangul count as marks of the lowest class."""
    return 1 if 0x1161 <= ord(c) <= 0x1175 or 0x11A8 <= ord(c) <= 0x11C2 else unicodedata.combining(c)


def changing() -> list[tuple[str, str]]:
    """(character, what it becomes) for all that change or combine: a fixed number of rows, set by the Unicode database."""
    out = []
    for i in range(sys.maxunicode + 1):
        if 0xD800 <= i <= 0xDFFF or 0xE000 <= i <= 0xF8FF or i >= 0xF0000:
            continue
        c = chr(i)
        d = decompose(c)
        if d != c or combining(c):
            out.append((c, d))
    return out


def compositions() -> list[tuple[str, str]]:
    """(base with ordered marks, composed character) for all that normal form C composes."""
    out = []
    for i in range(sys.maxunicode + 1):
        if 0xD800 <= i <= 0xDFFF:
            continue
        d = unicodedata.normalize("NFD", chr(i))
        if len(d) > 1 and unicodedata.normalize("NFC", d) == chr(i):
            out.append((d, chr(i)))
    return out


def plain(text: str) -> str:
    """One consistent form of a text that looks the same: composed, without invisible characters, spaces as U+0020."""
    if text.isascii() and text.isprintable():
        return text
    return unicodedata.normalize("NFC", "".join(map(decompose, text)))


def skeleton(text: str) -> str:
    """``plain`` with look-alike letters as the Latin ones."""
    if text.isascii() and text.isprintable():
        return text
    return unicodedata.normalize("NFC", "".join(LOOKALIKES.get(c, c) for k in text for c in decompose(k)))
