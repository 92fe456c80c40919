"""Prices, titles and links of scraped rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named entities that scraped titles hold.
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "scaron": "š", "Scaron": "Š", "zcaron": "ž", "Zcaron": "Ž", "ccaron": "č", "Ccaron": "Č",
    "cacute": "ć", "Cacute": "Ć", "dstrok": "đ", "Dstrok": "Đ", "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“", "ndash": "–", "mdash": "—",
    "hellip": "…", "middot": "·", "deg": "°", "times": "×", "reg": "®", "trade": "™", "copy": "©", "plusmn": "±", "euro": "€", "micro": "µ", "sup2": "²",
    "sup3": "³", "frac12": "½", "frac14": "¼", "frac34": "¾", "agrave": "à", "aacute": "á", "acirc": "â", "atilde": "ã", "auml": "ä", "aring": "å",
    "egrave": "è", "eacute": "é", "ecirc": "ê", "euml": "ë", "igrave": "ì", "iacute": "í", "icirc": "î", "iuml": "ï", "ntilde": "ñ", "ograve": "ò",
    "oacute": "ó", "ocirc": "ô", "otilde": "õ", "ouml": "ö", "ugrave": "ù", "uacute": "ú", "ucirc": "û", "uuml": "ü", "yacute": "ý", "ccedil": "ç",
    "szlig": "ß", "Agrave": "À", "Aacute": "Á", "Acirc": "Â", "Auml": "Ä", "Egrave": "È", "Eacute": "É", "Ecirc": "Ê", "Iacute": "Í", "Ntilde": "Ñ",
    "Oacute": "Ó", "Ocirc": "Ô", "Ouml": "Ö", "Uacute": "Ú", "Uuml": "Ü", "Ccedil": "Ç", "amp": "&",
}

# Shop names and addresses at the end of a title, titles that are no product, links
# that lead to a list.
VENDOR_SUFFIXES = [
    r"(?i)\s*[|–—-]\s*[A-Za-z0-9.\- ]*\.(rs|com|net|co\.rs)\s*$",
    r"(?iu)\s*[|–—-]\s*apoteka\s+[\p{L}\d.\- ]+$",
    r"(?i)\s*[|–—-]\s*(apothecary|apoteka|eapoteka|gymbeam)\s*$",
]
JUNK_TITLE = r"(?i)^(test\b|testtest|placeholder|lorem ipsum|undefined|null|n/a)$"
LIST_LINKS = [r"(?i)/sr/(cajevi|brendovi|kozmetika|lekovi|proizvod)/?$", r"(?i)/proizvodjaci/"]

_REFERENCE = r"&(#x[0-9a-fA-F]+|#X[0-9a-fA-F]+|#[0-9]+|[a-zA-Z][a-zA-Z0-9]*);"
_CHAR_LIMIT = 0x10FFFF


def _code_point(n: Column) -> Column:
    """The character of a code point, by its UTF-8 bytes."""
    byte = lambda x: F.lpad(F.hex(x), 2, "0")
    tail = lambda shift: byte(F.shiftright(n, shift).bitwiseAND(F.lit(0x3F)) + F.lit(0x80))
    spelled = (
        F.when(n < 0x80, byte(n))
        .when(n < 0x800, F.concat(byte(F.shiftright(n, 6) + 0xC0), tail(0)))
        .when(n < 0x10000, F.concat(byte(F.shiftright(n, 12) + 0xE0), tail(6), tail(0)))
        .otherwise(F.concat(byte(F.shiftright(n, 18) + 0xF0), tail(12), tail(6), tail(0)))
    )
    return F.decode(F.unhex(spelled), "UTF-8")


def _decode_once(c: Column) -> Column:
    """Text between references, and what each stands for, put together again."""
    named = F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv])
    between = F.split(c, _REFERENCE, -1)
    found = F.regexp_extract_all(c, F.lit(_REFERENCE), 1)

    def meaning(body):
        digits = F.regexp_replace(body, "^#[xX]?", "")
        n = F.when(body.rlike("^#[xX]"), F.conv(digits, 16, 10)).when(body.startswith("#"), digits)
        n = n.try_cast("bigint")
        ok = (n > 0) & (n <= _CHAR_LIMIT) & ~n.between(0xD800, 0xDFFF)
        full = F.concat(F.lit("&"), body, F.lit(";"))
        return F.coalesce(F.when(body.startswith("#"), F.when(ok, _code_point(n.cast("int")))).otherwise(F.try_element_at(named, body)), full)

    pieces = F.zip_with(between, F.concat(F.transform(found, meaning), F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    return F.array_join(pieces, "")


def decode_entities(c: Column) -> Column:
    """Named and numeric references, twice, as markup may be encoded twice."""
    c = F.coalesce(c, F.lit(""))
    once = F.when(F.contains(c, F.lit("&")), _decode_once(c)).otherwise(c)
    return F.when(F.contains(once, F.lit("&")), _decode_once(once)).otherwise(once)


def clean_title(c: Column) -> Column:
    """References decoded, shop names at the end cut, white space made even."""
    c = decode_entities(c)
    for suffix in VENDOR_SUFFIXES:
        c = F.regexp_replace(c, suffix, "")
    return F.trim(F.regexp_replace(F.translate(c, "\u00a0\u200b", "  "), r"\s+", " "))


def is_product(title: Column, price: Column) -> Column:
    """A finite price over 1 and a title that is neither short nor a placeholder."""
    t = F.trim(F.coalesce(title, F.lit("")))
    finite = price.isNotNull() & ~F.isnan(price) & (F.abs(price) != float("inf"))
    return finite & (price > 1) & (F.length(t) >= 3) & ~t.rlike(JUNK_TITLE)


def is_resolvable(link: Column) -> Column:
    """False for links with two hosts and for lists; a missing link passes."""
    t = F.trim(F.coalesce(link, F.lit("")))
    bad = F.size(F.regexp_extract_all(t, F.lit("https?://"), 0)) > 1
    for pattern in LIST_LINKS:
        bad = bad | t.rlike(pattern)
    return ~bad


def parse_price(c: Column) -> Column:
    """Whole dinars of a price as written in European or US style; 0 if there is none."""
    p = F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9.,]", "")
    dots = F.length(p) - F.length(F.replace(p, F.lit("."), F.lit("")))
    commas = F.length(p) - F.length(F.replace(p, F.lit(","), F.lit("")))
    dot, comma = F.instr(p, "."), F.instr(p, ",")
    after_comma = F.length(F.regexp_replace(F.coalesce(F.get(F.split(p, ","), F.lit(1)), F.lit("")), "[^0-9]", ""))
    lead, rest = F.get(F.split(p, r"\."), F.lit(0)), F.coalesce(F.get(F.split(p, r"\."), F.lit(1)), F.lit(""))
    thousands = (dots == 1) & (commas == 0) & (F.length(lead) <= 3) & ((F.length(rest) == 3) | (p.endswith("000") & (F.length(lead) > 0)))
    european = ((commas == 1) & (after_comma == 2)) | ((commas == 1) & (dots > 0) & (comma > dot)) | thousands | ((dots > 1) & (commas == 0))
    plain = F.when(european, F.replace(F.replace(p, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(p, F.lit(","), F.lit("")))
    number = F.regexp_extract(plain, r"^[0-9]*\.?[0-9]*", 0).try_cast("double")
    return F.floor(F.coalesce(number, F.lit(0.0)) + 0.5).cast("double")


def format_price(v: Column) -> Column:
    """Whole dinars with dots between thousands."""
    return F.replace(F.format_number(F.floor(v + 0.5), 0), F.lit(","), F.lit("."))
