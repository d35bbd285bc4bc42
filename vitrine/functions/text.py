"""Word tokens and the English stop list used by text search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a run of two or more letters, digits or underscores.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

# The common English stop list of natural-language toolkits.
ENGLISH_STOPWORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours
yourself yourselves he him his himself she she's her hers herself it it's its
itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in
out on off over under again further then once here there when where why how all
any both each few more most other some such no nor not only own same so than too
very s t can will just don don't should should've now d ll m o re ve y ain aren
aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven
haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't
shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()


def word_array(c: Column | str, stopwords: list[str] | None = None) -> Column:
    """Lower-case words of at least two characters, stop words dropped, in text order."""
    text = F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    words = F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))
    stop = ENGLISH_STOPWORDS if stopwords is None else stopwords
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def ngram_array(words: Column, low: int = 1, high: int = 1) -> Column:
    """Space-joined runs of ``low`` to ``high`` neighbouring words.

    ``words`` must be a plain column, because it is read several times.
    """
    parts = []
    for n in range(low, high + 1):
        runs = F.greatest(F.size(words) - n + 1, F.lit(0))
        grams = F.slice(words, 1, runs)
        for shift in range(1, n):
            following = F.slice(words, shift + 1, runs)
            grams = F.zip_with(grams, following, lambda a, b: F.concat_ws(" ", a, b))
        parts.append(grams)
    return parts[0] if len(parts) == 1 else F.concat(*parts)
