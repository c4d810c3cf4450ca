"""Text expressions over columns; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ"
PLAIN = "aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_blank(c) -> Column:
    return F.coalesce(F.trim(col(c)), F.lit("")) == ""


def fold_accents(c) -> Column:
    return F.translate(col(c), ACCENTED, PLAIN)


def normalise_symbols(c) -> Column:
    """One line, single spaces, all quotes as double quotes, lower case."""
    one_line = F.regexp_replace(F.regexp_replace(F.trim(col(c)), r"[\r\n]+", " "), " +", " ")
    return F.lower(F.translate(one_line, "“”'", '"""'))


def normalise_long_text(c) -> Column:
    """<br>, CRLF and CR become line feeds; outer white space goes."""
    return F.regexp_replace(F.regexp_replace(col(c), r"(?i)<br\s*/?>|\r\n|\r", "\n"), r"^\s+|\s+$", "")


def short_value(c) -> Column:
    return F.regexp_replace(col(c).cast("string"), r"[\r\n]+", " ")


def excerpt(c, head: int = 200, tail: int = 100) -> Column:
    """The head, a mark and the tail of a longer text."""
    x = col(c)
    return F.when(F.length(x) <= head + tail, x).otherwise(F.concat(F.substring(x, 1, head), F.lit(" [..] "), F.right(x, F.lit(tail))))


def slug(c) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(fold_accents(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def sentences(c) -> Column:
    """Parts after . ! ? ; : and at line ends, without blank ones."""
    return F.filter(F.transform(F.split(col(c), r"(?<=[.!?;:])\s+|\n+"), F.trim), lambda x: x != "")


def lines(c) -> Column:
    return F.filter(F.transform(F.split(col(c), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def word_count(c) -> Column:
    x = F.regexp_replace(col(c), r"^\s+|\s+$", "")
    return F.when(F.coalesce(x, F.lit("")) == "", 0).otherwise(F.size(F.split(x, r"\s+")))


def token_estimate(c) -> Column:
    """A quarter of the length, where no tokenizer is plugged in."""
    return F.floor(F.length(col(c)) / 4)


def jaccard_distance(a, b, extra: list[Column] | None = None) -> Column:
    """1 - |A & B| / |A | B| of array columns, weighted by the union's size with further distances."""
    x, y = F.array_distinct(col(a)), F.array_distinct(col(b))
    union = F.size(F.array_union(x, y))
    own = F.coalesce(1 - F.try_divide(F.size(F.array_intersect(x, y)), union), F.lit(0.0))
    if not extra:
        return own
    total = sum(extra[1:], extra[0])
    return (own * union + total) / (union + len(extra))


def token_windows(tokens, size: int, overlap: float) -> Column:
    """Overlapping slices of an array: step int(size * (1 - overlap)), ending with the last token."""
    step = max(1, int(size * (1 - overlap)))
    x = col(tokens)
    last = F.greatest(F.lit(0), F.ceil((F.size(x) - size) / step)).cast("int")
    return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(x, i * step + 1, size))).otherwise(F.array())


def build_prompt(text, template: str, variable: str) -> Column:
    """The variable in the template replaced by the text; else the text after the template and a blank line."""
    if variable and variable in template:
        return F.replace(F.lit(template), F.lit(variable), col(text))
    return F.concat(F.lit(template + "\n\n"), col(text))


def canonical_label(c, aliases: dict[str, str] | None = None) -> Column:
    """Snake case without accents, \\uXXXX remnants repaired, then an alias."""
    repaired = col(c)
    for code, char in (("u00e1", "á"), ("u00e9", "é"), ("u00ed", "í"), ("u00f3", "ó"), ("u00fa", "ú"), ("u00e7", "ç"), ("u00e3", "ã"), ("u00f5", "õ"), ("u00ea", "ê"), ("u00f4", "ô")):
        repaired = F.regexp_replace(repaired, rf"\\?{code}", char)
    plain = slug(repaired)
    if not aliases:
        return plain
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.coalesce(F.try_element_at(table, plain), plain)


def string_list(c) -> Column:
    """Null, one string or a JSON list of strings -> array of non-blank strings."""
    x = col(c)
    parsed = F.when(F.trim(x).startswith("["), F.from_json(x, "array<string>"))
    return F.filter(F.transform(F.coalesce(parsed, F.when(x.isNull(), F.array().cast("array<string>")).otherwise(F.array(x))), F.trim), lambda y: y != "")
