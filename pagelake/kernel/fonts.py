"""Character codes, glyph names and widths."""

from __future__ import annotations

#: The characters of the WinAnsi codes 80 to 9F; a code without one has a space here.
_HIGH = "€ ‚ƒ„…†‡ˆ‰Š‹Œ Ž  ‘’“”•–—˜™š›œ žŸ"
WINANSI = {chr(c): c for r in (range(0x20, 0x7F), range(0xA0, 0x100)) for c in r} | {x: 0x80 + k for k, x in enumerate(_HIGH) if x != " "}

#: Advance widths, in thousandths of the size, of the codes 20 to 7E.
HELVETICA = [int(x) for x in """
278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556
1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556
333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584""".split()]  # fmt: skip
HELVETICA_BOLD = [int(x) for x in """
278 333 474 556 556 889 722 238 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 333 333 584 584 584 611
975 722 722 722 722 667 611 778 722 278 556 722 611 833 722 778 667 778 722 667 611 722 667 944 667 667 611 333 278 333 584 556
333 556 611 556 611 556 333 611 611 278 278 556 278 889 611 611 611 611 389 556 333 611 556 778 556 556 500 389 280 389 584""".split()]  # fmt: skip
#: Widths over 7E, the same in both weights but for those in the second table.
HELVETICA_HIGH = {0x96: 556, 0x97: 1000, 0xA0: 278, 0xDF: 611, 0xE1: 556, 0xE4: 556, 0xE9: 556, 0xED: 278, 0xF1: 556, 0xF3: 556, 0xF6: 556, 0xFA: 556, 0xFC: 556}
HELVETICA_BOLD_HIGH = HELVETICA_HIGH | {0xF1: 611, 0xF3: 611, 0xF6: 611, 0xFA: 611, 0xFC: 611}
#: The fonts that every reader has.
BUILTIN = "Helvetica Helvetica-Oblique Helvetica-Bold Helvetica-BoldOblique Times-Roman Times-Bold Times-Italic Times-BoldItalic Courier Courier-Bold Courier-Oblique Courier-BoldOblique Symbol ZapfDingbats".split()

#: Glyph names of more than one letter and their characters.
GLYPHS = dict(
    zip(
        """space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash
        zero one two three four five six seven eight nine colon semicolon less equal greater question at bracketleft backslash bracketright
        asciicircum underscore grave braceleft bar braceright asciitilde quoteleft quoteright quotedblleft quotedblright quotesinglbase quotedblbase
        endash emdash bullet ellipsis dagger daggerdbl perthousand guilsinglleft guilsinglright guillemotleft guillemotright fi fl degree plusminus
        multiply divide copyright registered trademark currency cent sterling yen euro section paragraph periodcentered nbspace minus fraction
        nonbreakingspace""".split(),
        " !\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~‘’“”‚„–—•…†‡‰‹›«»ﬁﬂ°±×÷©®™¤¢£¥€§¶·\xa0−⁄\xa0",
        strict=True,
    )
)


def glyph_char(name: str) -> str:
    """The character that a glyph name stands for, empty where it is unknown."""
    if len(name) == 1:
        return name
    digits = name[3:] if name.startswith("uni") and len(name) == 7 else name[1:] if name.startswith("u") and 5 <= len(name) <= 7 else ""
    if digits:
        try:
            return chr(int(digits, 16)) if digits.isalnum() else ""
        except (ValueError, OverflowError):
            return GLYPHS.get(name, "")
    return GLYPHS.get(name, "")


def encode(text: str) -> bytes:
    """WinAnsi codes, a question mark for what has none."""
    return text.encode() if text.isascii() and text.isprintable() else bytes(WINANSI.get(c, 0x3F) for c in text)


def widths(font: str) -> list[int]:
    """The 256 advance widths of a built-in font. Only Helvetica and Courier have their own; a code without one is as wide as a question mark."""
    if font.startswith("Courier"):
        return [600] * 256
    bold = font in ("Helvetica-Bold", "Helvetica-BoldOblique")
    low, high = (HELVETICA_BOLD, HELVETICA_BOLD_HIGH) if bold else (HELVETICA, HELVETICA_HIGH)
    return [low[c - 0x20] if 0x20 <= c <= 0x7E else high.get(c, low[0x1F]) for c in range(256)]


_widths: dict[str, list[int]] = {}


def string_width(font: str, text: str, size: float) -> float:
    if font not in _widths:
        _widths[font] = widths(font)
    table = _widths[font]
    return sum(map(table.__getitem__, encode(text))) / 1000 * size


def styled(family: str, bold: bool, italic: bool) -> str:
    """The built-in font of a family in a weight and slant; an unknown family gives Helvetica."""
    base = family.split("-", 1)[0]
    if base == "Times":
        return "Times-" + ({(False, False): "Roman", (True, False): "Bold", (False, True): "Italic", (True, True): "BoldItalic"}[bold, italic])
    if base not in ("Helvetica", "Courier"):
        return base if base in BUILTIN else styled("Helvetica", bold, italic)
    tail = ("Bold" if bold else "") + ("Oblique" if italic else "")
    return f"{base}-{tail}" if tail else base
