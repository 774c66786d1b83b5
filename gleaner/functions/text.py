"""Text columns: cleaning, lexical form, n-grams, sentences, flags. All but `normalise` stay in the JVM."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NO_WORD = r"[^\p{L}\p{N}]+"
#: What Java's \b doesn't know: borders of words with letters beyond ASCII.
BEFORE, AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: In a class of characters, what words lose at their ends.
PUNCTUATION = r".,!?;:\"'()\[\]{}"
SPACE = r"[\s\p{Z}\x85]+"
SHORT_BELOW, LONG_ABOVE, FEWEST_LETTERS = 20, 2000, 20
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


@F.pandas_udf(T.StringType())
def _folded(value: pd.Series) -> pd.Series:
    """HTML entities and NFKC, for which Spark has no function."""
    return value.map(lambda s: _CONTROL.sub("", unicodedata.normalize("NFKC", html.unescape(s))), na_action="ignore")


def spaced(text: Column) -> Column:
    """Runs of white space as one space, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normalise(text: Column) -> Column:
    """Entities decoded, NFKC, no control characters, single spaces; null as empty."""
    return spaced(_folded(F.coalesce(text, F.lit(""))))


def repeats_title(title: Column, body: Column) -> Column:
    """Whether the body is the title or begins with it at the end of a word, cases folded."""
    t, b = F.lower(title), F.lower(body)
    follows = F.substring(b, F.length(t) + 1, F.lit(1))
    return (t != "") & (b != "") & ((t == b) | (F.startswith(b, t) & ~follows.rlike(r"[\p{L}\p{N}]")))


def joined(title: Column, body: Column) -> Column:
    """Title and body as one text; a title that the body repeats goes. Both normalised."""
    # \z, as $ also stands before a line end.
    mark = F.when(title.rlike(r"[.!?\p{So}\p{Sk}]\z"), " ").otherwise(". ")
    return F.when(repeats_title(title, body) | (title == ""), body).when(body == "", title).otherwise(F.concat(title, mark, body))


def lexical(text: Column) -> Column:
    """Lower case, contractions spelled out, words of letters and digits joined by single spaces. `text` is normalised."""
    plain = t = F.translate(F.lower(text), "’‘ʼ`", "''''")
    for found, put in ((f"{BEFORE}can't{AFTER}", "cannot"), (f"{BEFORE}won't{AFTER}", "will not"), (f"n't{AFTER}", " not"), (f"'re{AFTER}", " are"), (f"'ve{AFTER}", " have"), (f"'ll{AFTER}", " will"), (f"'m{AFTER}", " am"), (f"'d{AFTER}", " would"), (r"(?<=[\p{L}\p{N}_])'(?=[\p{L}\p{N}_])", "")):
        t = F.regexp_replace(t, found, put)
    t = F.when(F.contains(plain, F.lit("'")), t).otherwise(plain)  # all of them need an apostrophe
    return F.trim(F.regexp_replace(t, NO_WORD, " "))


def words(lexical_text: Column) -> Column:
    """The words of a lexical text; none of an empty one."""
    return F.filter(F.split(lexical_text, " "), lambda w: w != "")


def ngrams(tokens: Column, most: int = 3, fewest: int = 1) -> Column:
    """The distinct n-grams of an array of words, joined by spaces. Each length is zipped from the one before: linear in the words.

    No lambda refers to `tokens`, so that it is never evaluated again for each word, wherever Spark pushes the expression.
    """
    longer, parts = tokens, [tokens] if fewest == 1 else []
    for n in range(2, most + 1):
        longer = F.array_compact(F.zip_with(longer, F.slice(tokens, n, F.size(tokens)), lambda a, b: F.concat(a, F.lit(" "), b)))
        if n >= fewest:
            parts.append(longer)
    return F.array_distinct(F.concat(*parts))


def sentences(text: Column) -> Column:
    """Sentences in order: cut after . ! ? and white space, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])[\s\p{Z}\x85]+"), lambda s: F.trim(s)), lambda s: s != "")


def flags(text: Column, title: Column, body: Column, language: Column, source_flags: Column) -> Column:
    """Quality flags in order, each once. `text` is the joined text, title and body as delivered."""
    blank = F.trim(F.coalesce(body, F.lit(""))) == ""
    titled = F.trim(F.coalesce(title, F.lit(""))) != ""
    made = F.array(
        F.when(blank, "empty_body"),
        F.when(blank & titled, "title_only"),
        F.when((text != "") & ~text.rlike(r"[\p{L}\p{N}]"), "emoji_only"),
        F.when(F.length(text) < SHORT_BELOW, "short"),
        F.when(F.length(text) > LONG_ABOVE, "long_text"),
        F.when(repeats_title(F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))), "duplicate_title_body"),
        F.when(text == "", "no_text"),
        F.when((text != "") & ~language.isin("en", "und"), "non_english"),
    )
    return F.array_distinct(F.array_compact(F.concat(F.coalesce(source_flags, F.array().cast("array<string>")), made)))


def scored_flags(flags: Column, truncated: Column) -> Column:
    """Flags after scoring: `truncated` comes last if the model cut the text; null for a text that wasn't scored is no cut."""
    return F.array_distinct(F.concat(F.coalesce(flags, F.array().cast("array<string>")), F.when(F.coalesce(truncated, F.lit(False)), F.array(F.lit("truncated"))).otherwise(F.array().cast("array<string>"))))


def analysable(text: Column, language: Column) -> Column:
    return (text != "") & language.isin("en", "und")


def excerpt(text: Column, most: int = 300) -> Column:
    t = F.trim(text)
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.left(t, F.lit(most - 3))), F.lit("..."))).otherwise(t)


def csv_safe(text: Column) -> Column:
    """A TAB before what a spreadsheet could take for a formula."""
    return F.when(text.rlike(r"^[=+\-@\t\r\n＝＋－＠]"), F.concat(F.lit("\t"), text)).otherwise(text)


def displayable(phrase: Column, blocked: Sequence[str] | Column) -> Column:
    """Whether a phrase has a word with a letter that isn't blocked."""
    listed = blocked if isinstance(blocked, Column) else F.array(*[F.lit(w) for w in blocked])
    return F.exists(F.split(phrase, " "), lambda w: ~F.array_contains(listed, w) & w.rlike(r"\p{L}"))


def stripped_words(text: Column) -> Column:
    """Words in lower case without the punctuation at their ends."""
    return F.transform(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: F.regexp_replace(w, f"^[{PUNCTUATION}]+|[{PUNCTUATION}]+$", ""))
