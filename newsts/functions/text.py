"""Text column functions (F20, T2, T18) and fixed word tables.

Tokenising is a built-in ``regexp_extract_all``: a token is a run of
letters/digits/underscore, or a run of other non-space characters
(punctuation).  It is applied to the whole text of each document.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: tokenizer pattern (word runs, or punctuation runs)
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
# the same in Python, where white space beyond ASCII counts as white space
find_tokens = re.compile(r"\w+|[^\w \t\n\x0b\f\r]+").findall
# fixed value: characters a frequency tokenizer treats as separators
FILTER_CHARS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n"
# fixed value: ASCII punctuation removed inside tokens by the cleaner
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# fixed values: the common English stop-word list (179 words, in its usual order)
STOP_WORDS = """i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
yourselves he him his himself she she's her hers herself it it's its itself they them their theirs
themselves what which who whom this that that'll these those am is are was were be been being have has
had having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over under
again further then once here there when where why how all any both each few more most other some such
no nor not only own same so than too very s t can will just don don't should should've now d ll m o re
ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn
isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren
weren't won won't wouldn wouldn't""".split()


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c, lower: bool = True) -> Column:
    """Whole-text token array."""
    s = F.lower(_c(c)) if lower else _c(c)
    return F.regexp_extract_all(s, F.lit(TOKEN_PATTERN), 0)


def is_stop(t: Column) -> Column:
    """Stop-word membership as an IN list (planned as a hash-set lookup)."""
    return t.isin(STOP_WORDS)


def drop_stop_words(arr: Column) -> Column:
    return F.filter(arr, lambda t: ~is_stop(t))


def normalize_text(c) -> Column:
    """lower-case, split into tokens, join with single spaces."""
    return F.array_join(tokens(c), " ")


def basic_clean(c) -> Column:
    """Lower → tokenize → drop stop words → tokens joined by a space,
    each followed by one space (trailing space kept)."""
    kept = drop_stop_words(tokens(c))
    return F.concat(F.array_join(kept, " "), F.when(F.size(kept) > 0, F.lit(" ")).otherwise(F.lit("")))


def frequency_tokens(c) -> Column:
    """Split cleaned text the way a frequency tokenizer does: lower-case,
    the filter characters act as separators, empty pieces dropped."""
    return F.filter(F.split(F.translate(F.lower(_c(c)), FILTER_CHARS, " " * len(FILTER_CHARS)), r"\s+"),
                    lambda t: t != "")


def first_token(c) -> Column:
    """First word of a multi-word field."""
    return F.split(_c(c), " ").getItem(0)


def strip_punctuation(c) -> Column:
    return F.translate(_c(c), PUNCTUATION, "")
