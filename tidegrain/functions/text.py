"""Texts as column expressions.

``octet_length`` measures bytes where a rule is in bytes, ``length`` characters.
A null text gives null, an empty one zero counts and empty lists.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of the shortest form of a text (fixed values).
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "into", "is", "it", "of", "on", "or", "that", "the", "their", "this", "to", "with"]


def one_line(text: Column) -> Column:
    """White-space runs as one blank, trimmed; Unicode blanks included."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def fields(text: Column) -> Column:
    """The runs between white space."""
    return F.filter(F.split(one_line(text), " "), lambda x: x != "")


def word_count(text: Column) -> Column:
    """Number of ``fields``, without making them."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def word_bytes(text: Column) -> Column:
    """Mean bytes of ``fields``, 0 if there are none."""
    n = word_count(text)
    return F.when(n > 0, F.octet_length(F.regexp_replace(text, r"(?U)\s+", "")) / n).otherwise(0.0)


def line_count(text: Column) -> Column:
    """Number of ``lines``, without making them."""
    return F.regexp_count(text, F.lit(r"(?U)\S[^\n]*"))


def sentence_count(text: Column) -> Column:
    """Number of ``sentences``, without making them."""
    return F.regexp_count(text, F.lit(r"(?U)[^\s.!?][^.!?]*"))


def marks(text: Column) -> Column:
    """Number of the marks . ! ? ; : in a text."""
    return F.octet_length(text) - F.octet_length(F.translate(text, ".!?;:", ""))


def lines(text: Column) -> Column:
    """Lines that are not blank, trimmed."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def mean_length(items: Column, measure=F.length) -> Column:  # noqa: ANN001
    """Mean length of an array of texts, 0 if it is empty."""
    total = F.aggregate(items, F.lit(0), lambda a, x: a + measure(x))
    return F.when(F.size(items) > 0, total / F.size(items)).otherwise(0.0)


def share(items: Column, holds) -> Column:  # noqa: ANN001
    """Share of the items for which a condition holds, 0 if there are none."""
    return F.when(F.size(items) > 0, F.size(F.filter(items, holds)) / F.size(items)).otherwise(0.0)


def trimmed_of(word: Column, signs: str) -> Column:
    """A word without any of the signs at its ends."""
    return F.regexp_replace(word, f"^[{signs}]+|[{signs}]+$", "")


def all_upper(word: Column) -> Column:
    """Holds upper-case ASCII letters and no lower-case ones."""
    return word.rlike("[A-Z]") & ~word.rlike("[a-z]")


_ENDS = r"\[\](){}<>\"'`,"


def title_like_share(text: Column) -> Column:
    """Share of words of two characters or more that begin in upper case or are
    all upper case, signs at their ends left out; one pass over the text."""
    two = rf"(?=[{_ENDS}]*+[^ {_ENDS}][^ ]*[^ {_ENDS}])"
    like = F.regexp_count(one_line(text), F.lit(rf"(?<![^ ]){two}(?:[{_ENDS}]*+[A-Z]|[^ a-z]*[A-Z][^ a-z]*(?![^ ]))"))
    n = word_count(text)
    return F.when(n > 0, like / n).otherwise(0.0)


def identifier_line(line: Column) -> Column:
    """At least half of the words hold ``_``, ``-`` or a digit or are upper case."""
    bare = F.transform(fields(line), lambda w: trimmed_of(w, "\"'`,"))
    return share(bare, lambda w: w.rlike("[_0-9-]") | all_upper(w)) >= 0.5


def symbolic_line(line: Column) -> Column:
    """Holds one of the signs of code."""
    return line.rlike(r"[_=:`{}\[\]();\\]")


def sentences(text: Column) -> Column:
    """Pieces between . ! ? that are not blank, each on one line."""
    return F.filter(F.transform(F.split(text, "[.!?]+"), one_line), lambda x: x != "")


def alnum_only(text: Column) -> Column:
    """Lower case, all but a-z and 0-9 as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def long_tokens(text: Column) -> Column:
    """Distinct words of three letters or more of ``alnum_only``, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]{3,})")))


def covered(text: Column, terms: Column) -> Column:
    """The terms that occur in a text, both as ``alnum_only``."""
    plain = F.concat(F.lit(" "), alnum_only(text), F.lit(" "))
    return F.filter(terms, lambda t: plain.contains(F.concat(F.lit(" "), alnum_only(t), F.lit(" "))) & (alnum_only(t) != ""))


def looks_like_junk(text: Column) -> Column:
    """A brace, a function head or more than four addresses."""
    addresses = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("http"), F.lit("")))) / 4
    return text.contains("{") | text.contains("function(") | (addresses > 4)


def display(text: Column) -> Column:
    """One line without control and format characters, no blank before marks."""
    plain = F.regexp_replace(one_line(text), r"[\p{Cc}\p{Cf}]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\s+([,.:;!?])", "$1"), " +", " "))


def head(text: Column, size: int) -> Column:
    """A text of at most ``size`` characters, cut between words."""
    plain = one_line(text)
    cut = F.regexp_replace(F.substring(plain, 1, size), r"\s+\S*$", "")
    return F.when(F.length(plain) <= size, plain).otherwise(F.rtrim(cut))


def shortest(text: Column) -> Column:
    """The first sentence; of more than 8 words without stop words; at most 14
    words, or the first 10 words of the text if nothing is left."""
    first = fields(F.coalesce(F.get(sentences(text), F.lit(0)), F.lit("")))
    content = F.filter(first, lambda w: ~F.lower(F.regexp_replace(w, r"^[,;:]+|[,;:]+$", "")).isin(STOPWORDS))
    chosen = F.slice(F.when(F.size(first) > 8, content).otherwise(first), 1, 14)
    return F.array_join(F.when(F.size(chosen) > 0, chosen).otherwise(F.slice(fields(text), 1, 10)), " ")


def token_estimate(text: Column) -> Column:
    return F.size(fields(text))


def first_tokens(text: Column, n: int) -> Column:
    return F.array_join(F.slice(fields(text), 1, n), " ")
