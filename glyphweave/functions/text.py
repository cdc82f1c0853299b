"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What changes from page to page in a running head, and what stands around it: fixed values.
PAGE_ROMAN = r"\b(?:page\s+)?[ivxlcdm]{1,8}\b(?=\s*$)"
AROUND_HEADS = " -|–—•·"

SAFE_SCHEMES = ("http", "https", "mailto", "tel")
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&"))


def normalised(text: Column) -> Column:
    """White space as single spaces, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def title_key(text: Column) -> Column:
    """A title for comparing: lower case, anything but letters, digits and underscores as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def slug(text: Column, fallback: Column) -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(made == "", fallback).otherwise(made)


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def html_unescaped(text: Column) -> Column:
    """The five references that html_escaped makes."""
    for a, b in _ENTITIES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def safe_href(uri: Column) -> Column:
    """The address if it can't run or fetch anything unexpected: a fragment or one of the safe schemes, without blanks; else null."""
    href = F.trim(html_unescaped(F.coalesce(uri, F.lit(""))))
    scheme = F.lower(F.regexp_extract(href, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    clean = (href != "") & ~href.rlike(r"[\x00-\x20\x7f]")
    fragment = href.rlike(r"^#[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]+$")
    return F.when(clean & (fragment | (~href.startswith("#") & scheme.isin(*SAFE_SCHEMES))), href)


def safe_asset(uri: Column) -> Column:
    """As safe_href, and embedded images and relative paths that don't climb; else null."""
    href = F.trim(html_unescaped(F.coalesce(uri, F.lit(""))))
    clean = (href != "") & ~href.rlike(r"[\x00-\x20\x7f]")
    embedded = href.rlike(r"(?i)^data:image/(?:png|jpeg|jpg|gif|webp|svg\+xml);base64,[A-Za-z0-9+/=]+$")
    parts = F.split(href, r"[\\/]+")
    relative = ~href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & ~href.rlike(r"^[/\\~]") & F.forall(parts, lambda p: p.rlike(r"^[A-Za-z0-9._~@%+-]+$") & ~p.isin(".", ".."))
    return F.coalesce(safe_href(uri), F.when(clean & embedded, href), F.when(clean & relative, F.replace(href, F.lit("\\"), F.lit("/"))))


def markdown_normalised(text: Column) -> Column:
    """One kind of line end, no blanks before it, at most one empty line in a row, trimmed."""
    t = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.regexp_replace(t, r"[ \t]+(\n|$)", "$1")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def markdown_escaped(text: Column) -> Column:
    t = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    t = F.regexp_replace(t, r"([`*~\[\]<>])", r"\\$1")
    return F.regexp_replace(t, r"(?<![\p{L}\p{N}_])_|_(?![\p{L}\p{N}_])", r"\\_")


def fence_size(text: Column, mark: str = "`", least: int = 3) -> Column:
    """Length of a code fence that no run in the text closes."""
    runs = F.regexp_extract_all(text, F.lit(f"{mark}+"), F.lit(0))
    return F.greatest(F.lit(least), F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)) + 1)


def alpha_value(marker: Column) -> Column:
    """a, b, ... z, aa: 1, 2, ... 26, 27; 0 for anything else."""
    letters = F.split(F.lower(marker), "")
    value = F.aggregate(letters, F.lit(0).cast("long"), lambda acc, c: F.when(c == "", acc).otherwise(acc * 26 + F.ascii(c) - 96))
    return F.when(marker.rlike("^[A-Za-z]+$"), value).otherwise(F.lit(0).cast("long"))


def roman_value(marker: Column) -> Column:
    """A roman numeral's value, smaller signs before larger ones taken off; 0 for anything else."""
    worth = F.create_map(*[x for k, v in {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    signs = F.transform(F.filter(F.split(F.reverse(F.lower(marker)), ""), lambda c: c != ""), lambda c: worth[c])
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("most"))
    step = lambda acc, v: F.struct((acc["total"] + F.when(v < acc["most"], -v).otherwise(v)).alias("total"), F.greatest(acc["most"], v).alias("most"))
    return F.when(marker.rlike("^[ivxlcdmIVXLCDM]+$"), F.aggregate(signs, zero, step, lambda acc: acc["total"])).otherwise(F.lit(0).cast("long"))


def list_label(label: Column) -> Column:
    """A list label without the brackets and dots around it."""
    t = F.regexp_replace(F.trim(label), r"^[\[(]\s*", "")
    return F.trim(F.regexp_replace(t, r"\s*[\]).]+$", ""))


def marker_style(label: Column) -> Column:
    m = list_label(label)
    return (
        F.when(m.rlike("^[+-]?[0-9]+$"), "decimal").when(m.rlike("^[IVXLCDM]{2,}$"), "upper-roman").when(m.rlike("^[ivxlcdm]{2,}$"), "lower-roman")
        .when(m.rlike("^[A-Z]$"), "upper-alpha").when(m.rlike("^[a-z]$"), "lower-alpha").otherwise("disc")
    )


def list_record(line: Column) -> Column:
    """A Markdown list line as a struct: kind, indent, ordered, marker, task, checked, content."""
    pattern = r"^( *)(-|[0-9]+\.|[A-Za-z]+\.)(?:\s+\[([ xX])\])?\s+(.*)$"
    part = lambda i: F.regexp_extract(line, pattern, i)
    item = line.rlike(pattern)
    return F.struct(
        F.when(item, "item").otherwise("continuation").alias("kind"),
        F.when(item, F.length(part(1))).alias("indent"),
        F.when(item, part(2) != "-").alias("ordered"),
        F.when(item, F.regexp_replace(part(2), r"\.$", "")).alias("marker"),
        F.when(item, part(3) != "").alias("task"),
        F.when(item, F.lower(part(3)) == "x").alias("checked"),
        F.trim(F.when(item, part(4)).otherwise(line)).alias("content"),
    )


def quote_depth(line: Column) -> Column:
    """How many quote marks open a line, each with one blank after it at most."""
    lead = F.regexp_extract(line, r"^((?:> ?)*)", 1)
    return F.length(F.replace(lead, F.lit(" "), F.lit(""))).cast("long")


def gfm_alignments(row: Column) -> Column:
    """Alignments of a table's delimiter row; null for any other line."""
    cells = F.transform(F.split(F.regexp_replace(F.trim(row), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    is_row = F.trim(row).rlike(r"^\|.*\|$") & F.forall(cells, lambda c: c.rlike(r"^:?-{3,}:?$"))
    align = lambda c: F.when(c.startswith(":") & c.endswith(":"), "center").when(c.endswith(":"), "right").when(c.startswith(":"), "left").otherwise("")
    return F.when(is_row, F.transform(cells, align))


def gfm_cells(row: Column) -> Column:
    """Cells of a table row; an escaped bar stays within its cell."""
    inner = F.regexp_replace(F.trim(row), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))


def edit_ratio(a: Column, b: Column) -> Column:
    """Edit distance over the longer length; 1 if just one side is empty."""
    return F.when(a == b, F.lit(0.0)).otherwise(F.levenshtein(a, b).cast("double") / F.greatest(F.length(a), F.length(b)))


def field_kind(field_type: Column, flags: Column) -> Column:
    """What a form field is, from its type and flag bits."""
    bit = lambda n: flags.bitwiseAND(F.lit(1 << n)) != 0
    button = F.when(bit(16), "pushbutton").when(bit(15), "radio").otherwise("checkbox")
    return F.when(field_type == "Btn", button).when(field_type == "Ch", F.when(bit(17), "combo").otherwise("listbox")).when(field_type == "Sig", "signature").otherwise("text")


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    return F.struct(*[(1 - F.least(F.lit(1.0), x + k)).alias(n) for n, x in (("r", c), ("g", m), ("b", y))])


def contents_entry(line: Column) -> Column:
    """Title and page of a line of contents with leaders of two or more marks before a number or roman numeral; else both null."""
    page = F.regexp_extract(F.trim(line), "([0-9]+|[ivxlcdmIVXLCDM]+)$", 1)
    before = F.substring(F.trim(line), F.lit(1), F.length(F.trim(line)) - F.length(page))
    title = F.rtrim(before, F.lit(".·… "))
    leaders = F.replace(F.substring(before, F.length(title) + 1, F.length(before)), F.lit(" "), F.lit(""))
    good = (page != "") & (title != "") & ((F.length(leaders) > 1) | F.contains(leaders, F.lit("…")))
    return F.struct(F.when(good, F.trim(title)).alias("title"), F.when(good, page).alias("page"))


#: Words that point at something, and what they point at.
POINTER_KINDS = {"figure": "figure", "fig.": "figure", "table": "table", "section": "section", "sec.": "section", "equation": "equation", "eq.": "equation", "appendix": "appendix"}


def pointers(text: Column) -> Column:
    """Every pointing word of a text with the label after it, as written."""
    words = "|".join(w.replace(".", "[.]").capitalize() for w in POINTER_KINDS)
    return F.regexp_extract_all(text, F.lit(rf"((?:{words})\s+[A-Za-z0-9]+)"), 1)


def pointer_kind(word: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in POINTER_KINDS.items() for x in pair])
    return kinds[F.lower(word)]
