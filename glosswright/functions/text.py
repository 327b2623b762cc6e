"""Column functions on text: cleaning, markers, buckets, labels, addresses, fonts.

Every function takes and returns columns; nothing here leaves the JVM.  A null
input gives a null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tidy_extract(x: ColumnOrName) -> Column:
    """Collapses runs of spaces and of hyphens, deletes line feeds (F1)."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(_c(x), " +", " "), "-+", "-"), "\n", "")


def drop_span_tags(x: ColumnOrName) -> Column:
    """Removes opening and closing span tags, keeps what they hold."""
    return F.regexp_replace(_c(x), "</?span(?:\\s[^>]*)?>", "")


def bare_anchors(x: ColumnOrName) -> Column:
    """Anchors without their attributes."""
    return F.regexp_replace(_c(x), "<a\\s[^>]*>", "<a>")


def strip_tags(x: ColumnOrName) -> Column:
    """Text without anything between angle brackets (F15, text part)."""
    return F.regexp_replace(_c(x), "<[^>]*>", "")


def ascii_only(x: ColumnOrName) -> Column:
    """Text without code points over 127 (F17, text part)."""
    return F.regexp_replace(_c(x), "[^\\x00-\\x7F]", "")


def normalize_before(x: ColumnOrName) -> Column:
    """Lower case; "et al.", "/" and "et al" become spaces, in that order; a space after a small delta."""
    y = F.lower(_c(x))
    for old in ("et al.", "/", "et al"):
        y = F.replace(y, F.lit(old), F.lit(" "))
    return F.replace(y, F.lit("\u03b4"), F.lit("\u03b4 "))


def normalize_after(tokens: ColumnOrName) -> Column:
    """The hook after lemmas are taken; no rule so far."""
    return _c(tokens)


def normal_tokens(x: ColumnOrName, lemma=None) -> Column:
    """Tokens of the normalized text without quotes and question marks.

    ``lemma`` maps a token column to its lemma's; without one tokens stay as they are.
    """
    words = F.filter(F.split(normalize_before(x), "\\s+"), lambda w: w != "")
    if lemma is not None:
        words = F.transform(words, lemma)
    return F.filter(normalize_after(words), lambda w: ~w.isin("`", "'", "?", "``", "''"))


#: The markers that are counted, in feature order.
MARKERS = ("iiii", "PPPP")


def marker_count(x: ColumnOrName, marker: str) -> Column:
    return F.regexp_count(_c(x), F.lit(marker))


def before_marker(x: ColumnOrName) -> Column:
    """The text up to the first marker, all of it if there is none."""
    at = [F.when(F.instr(_c(x), m) > 0, F.instr(_c(x), m)) for m in MARKERS]
    first = F.least(*at)
    return F.when(first.isNull(), _c(x)).otherwise(F.substring(_c(x), F.lit(1), first - 1))


def equal_chunks(x: ColumnOrName, n: int) -> Column:
    """``n`` pieces of ceil(length / n) characters, the last ones shorter or empty."""
    size = F.ceil(F.length(_c(x)) / F.lit(n)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substr(_c(x), i * size + 1, size))


def drop_brackets(x: ColumnOrName) -> Column:
    """Without round and square brackets."""
    return F.regexp_replace(_c(x), "[()\\[\\]]", "")


def join_paragraphs(parts: ColumnOrName, mark: str = " ") -> Column:
    """Paragraphs as one text, spaces collapsed."""
    return F.regexp_replace(F.concat_ws(mark, parts), " +", " ")


def normal_label(x: ColumnOrName) -> Column:
    """A tag up to its first ASCII colon, trimmed, in lower case."""
    return F.lower(F.trim(F.substring_index(_c(x), ":", 1)))


#: Token buckets by whole-token pattern, tried in this order after number and unit.
BUCKET_PATTERNS = (("A1-A1", "^(?:\\w+-)+\\w+$"), ("UPPER", "^[A-Z]+\\d*$"), ("CamelCase", "^(?:[A-Z][a-z]+){2,}$"))
BUCKETS = ("number", "unit", "A1-A1", "UPPER", "CamelCase")
#: Our own short list of measurement units; any other list can be given.
UNITS = ("mg", "g", "kg", "ml", "l", "mm", "cm", "m", "nm", "h", "min", "s", "%", "mol", "mM", "rpm", "bp", "kb", "kDa", "U")


def token_bucket(w: ColumnOrName, units=UNITS) -> Column:
    """The first bucket that a token falls into, null if none does (A5).

    A number is a token that starts with digits, dots or hyphens.
    """
    out = F.when(_c(w).rlike("^[\\d.-]+"), "number").when(_c(w).isin(*units), "unit")
    for name, pattern in BUCKET_PATTERNS:
        out = out.when(_c(w).rlike("(?U)" + pattern), name)
    return out


def full_text_url(url: ColumnOrName) -> Column:
    """An article address as its full-text address."""
    u = F.trim(_c(url))
    return (
        F.when(u.startswith("http://aem.asm.org") & ~u.endswith(".full"), F.concat(u, F.lit(".full")))
        .when(u.startswith("https://onlinelibrary.wiley.com"), F.replace(u, F.lit("abs"), F.lit("full")))
        .otherwise(u)
    )


def preferred_url(url: ColumnOrName, doi_url: ColumnOrName, prefer: str = "url") -> Column:
    """The first of both that is neither null nor empty."""
    a, b = (_c(url), _c(doi_url)) if prefer == "url" else (_c(doi_url), _c(url))
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def local_path(url: ColumnOrName) -> Column:
    """A file address as a path, '' if there is none."""
    return F.coalesce(F.regexp_replace(_c(url), "^file://", ""), F.lit(""))


def hex_colour(r: ColumnOrName, g: ColumnOrName, b: ColumnOrName) -> Column:
    """#rrggbb (P19)."""
    return F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex(_c(x).cast("long")), 2, "0")) for x in (r, g, b)))


def next_marker(link: ColumnOrName) -> Column:
    """The cursor in a paging link."""
    return F.parse_url(_c(link), F.lit("QUERY"), F.lit("marker"))


#: What an address must hold to belong to a publisher, tried in this order.
PUBLISHERS = (
    ("sciencedirect.com", "elsevier"), ("asm.org", "asm"), ("nature.com", "nature"), ("biomedcentral.com", "bmc"),
    ("springer.com", "springer"), ("embopress.org", "embo"), ("wiley.com", "wiley"), ("pmc", "pubmed"),
)
UNKNOWN_PUBLISHER = "WARNING"


def meta_content(html: ColumnOrName, name: str) -> Column:
    """The content of a meta element, its attributes in either order; null if there is none."""
    a = F.regexp_extract(_c(html), f"(?is)<meta\\s[^>]*name\\s*=\\s*[\"']{name}[\"'][^>]*content\\s*=\\s*[\"']([^\"']*)[\"']", 1)
    b = F.regexp_extract(_c(html), f"(?is)<meta\\s[^>]*content\\s*=\\s*[\"']([^\"']*)[\"'][^>]*name\\s*=\\s*[\"']{name}[\"']", 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def publisher(html: ColumnOrName) -> Column:
    """Whose page this is, by its citation addresses."""
    at = F.coalesce(meta_content(html, "citation_pdf_url"), meta_content(html, "citation_abstract_html_url"), F.lit(""))

    def named(a: Column) -> Column:
        out = F.lit(UNKNOWN_PUBLISHER)
        for part, name in reversed(PUBLISHERS):
            out = F.when(F.contains(a, F.lit(part)), name).otherwise(out)
        return out

    return F.transform(F.array(at), named)[0]  # so that the page is searched once, not for every publisher


#: Font names that say bold or italic by none of the rules.
BOLD_FONTS, ITALIC_FONTS = ("AdvPTimesB", "AdvPTimesBI"), ("AdvPTimesI", "AdvPTimesBI")


def bold_font(name: ColumnOrName, known: tuple[str, ...] = BOLD_FONTS) -> Column:
    """Whether a font's name says bold."""
    return _c(name).rlike("[bB]old|[._-][bB][iI]?$|Bd(It)?$") | _c(name).isin(*known)


def italic_font(name: ColumnOrName, known: tuple[str, ...] = ITALIC_FONTS) -> Column:
    """Whether a font's name says italic."""
    return _c(name).rlike("[iI]talic|[._-][bB]?[iI]$|It$") | _c(name).isin(*known)


def qualified_lines(x: ColumnOrName, marker: str = "\u2028", tag: str = "hl") -> Column:
    """Short lines give way to the marker: under 4 tokens or 31 characters, and without the tag (P10)."""
    def line(v: Column) -> Column:
        long_ = (F.size(F.filter(F.split(v, "\\s+"), lambda w: w != "")) > 3) & (F.length(v) > 30)
        return F.when(long_ | F.contains(v, F.lit(tag)), v).otherwise(F.lit(marker))

    return F.array_join(F.transform(F.split(_c(x), "\n"), line), "\n")


#: The ways in which pages write a line break, and lines that are table cells.
_BREAK = "(?:<br>|</br>|<br/>|<br />)"
CELL_LINES = ("\n[0-9.\u00b1+\\-%() ]*" + _BREAK, "(?U)\n\\w*" + _BREAK)


def drop_cells(x: ColumnOrName, marker: str = "\u2028") -> Column:
    """Lines that are table cells become the marker."""
    y = _c(x)
    for cell in CELL_LINES:
        y = F.regexp_replace(y, cell, marker)
    return y


def outward_highlights(x: ColumnOrName) -> Column:
    """Drops empty highlights, moves the others out of any run of tags around them."""
    y = F.regexp_replace(_c(x), "<hl>\\s*</hl>", "")
    y = F.regexp_replace(y, "((?:<(?!/|hl>)[^<>]*>)+)<hl>", "<hl>$1")
    return F.regexp_replace(y, "</hl>((?:</(?!hl>)[^<>]*>)+)", "$1</hl>")


def escaped(x: ColumnOrName) -> Column:
    """ASCII text with backslash escapes for all other characters."""
    def one(c: Column) -> Column:
        n = F.ascii(c)
        return (
            F.when(n < 128, c)
            .when(n < 256, F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(n), 2, "0"))))
            .otherwise(F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0"))))
        )

    return F.array_join(F.transform(F.filter(F.split(_c(x), ""), lambda c: c != ""), one), "")


def glyph_rows(x: ColumnOrName) -> Column:
    """A text's characters as an array, to be exploded with their places."""
    return F.filter(F.split(_c(x), ""), lambda c: c != "")


def nonblank_words(x: ColumnOrName) -> Column:
    """Words between runs of white space."""
    return F.filter(F.split(_c(x), "\\s+"), lambda w: w != "")
