"""Whether a piece of text says where something was published: points for what such a text has."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of publishing and of identifiers, without marks around them and in lower case.
IDENTIFIERS = ("doi", "isbn", "issn", "arxiv", "urn", "pmid")
PRINTED = ("press", "verlag", "journal", "proceedings", "proc", "conference", "transactions", "thesis", "dissertation", "university", "publisher", "ed", "eds", "vol", "volume", "pp", "issue")
ADDRESSES = ("http://", "https://", "www.")
#: Points of an identifier or address, of a word of publishing, of a name with an initial, of a year, of three or more marks; and how many it takes.
POINTS = {"located": 2, "printed": 2, "named": 1, "dated": 1, "marked": 1}
ENOUGH = 2
SHORTEST = 8
FIRST_YEAR, LAST_YEAR = 1500, 2099
MARKS = ".,;:"
_AROUND = "()[]{}.,;:\"'“”‘’!?"


def cites(text: str) -> bool:
    words = text.split()
    if len(" ".join(words)) < SHORTEST:
        return False
    bare = [w.strip(_AROUND).lower() for w in words]
    has = {
        "located": any(w in IDENTIFIERS for w in bare) or any(w.lower().startswith(ADDRESSES) for w in words),
        "printed": any(w in PRINTED for w in bare),
        "named": any(a.endswith(",") and len(b) == 2 and b[0].isupper() and b[1] == "." for a, b in zip(words, words[1:], strict=False)),
        "dated": any(len(w) == 4 and w.isdecimal() and FIRST_YEAR <= int(w) <= LAST_YEAR for w in bare),
        "marked": sum(text.count(c) for c in MARKS) > 2,
    }
    return sum(POINTS[k] for k, v in has.items() if v) >= ENOUGH


def cites_column(text: Column) -> Column:
    """The same as a column expression; of names, only those in plain capitals count."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.lower(F.btrim(w, F.lit(_AROUND))))
    year = lambda w: w.rlike("^[0-9]{4}$") & w.try_cast("int").between(FIRST_YEAR, LAST_YEAR)
    pairs = F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("b"))
    has = {
        "located": F.arrays_overlap(bare, F.array(*map(F.lit, IDENTIFIERS))) | F.exists(words, lambda w: F.lower(w).rlike("^(https?://|www[.])")),
        "printed": F.arrays_overlap(bare, F.array(*map(F.lit, PRINTED))),
        "named": F.exists(pairs, lambda p: F.endswith(p["a"], F.lit(",")) & p["b"].rlike("^[A-Z][.]$")),
        "dated": F.exists(bare, year),
        "marked": F.length(text) - F.length(F.translate(text, MARKS, "")) > 2,
    }
    points = sum((F.when(F.coalesce(v, F.lit(False)), POINTS[k]).otherwise(0) for k, v in has.items()), F.lit(0))
    return (F.length(F.array_join(words, " ")) >= SHORTEST) & (points >= ENOUGH)
