"""Column expressions on page addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The English stop words that Spark's own remover uses by default.
STOP_WORDS = tuple(
    """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it
its itself they them their theirs themselves what which who whom this that these those am is are was were be been
being have has had having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over under again further
then once here there when where why how all any both each few more most other some such no nor not only own same so
than too very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't
hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's
ought that's there's what's when's where's who's why's would
""".split()
)

# Fixed patterns, applied in this order.
HTML_ENDING = r"\.html?$"
LAST_DOT = r"\.[^.]*$"
FILE_ENDING = r"^((?:https?://)?+[^/?#]+/[^?#]*)\.[^./?#]+(?=$|[?#])"
PROTOCOL = r"https?://|www\."
NOT_WORD = r"[^\p{L}\p{N}_]+"


def url_tokens(col: Column | str, mode: str = "reference") -> Column:
    """Words of a page address, in order; NULL for NULL.

    ``mode="reference"`` drops an HTML ending, then everything from the last dot on, wherever that dot is: an address
    whose only dots are in the host loses its path. ``mode="path"`` drops only the ending of a file name.
    """
    col = F.col(col) if isinstance(col, str) else col
    if mode == "reference":
        col = F.regexp_replace(F.regexp_replace(col, HTML_ENDING, ""), LAST_DOT, "")
    elif mode == "path":
        col = F.regexp_replace(col, FILE_ENDING, "$1")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    words = F.split(F.regexp_replace(col, PROTOCOL, ""), NOT_WORD)
    return F.filter(words, lambda w: w != "")


def drop_stopwords(tokens: Column | str) -> Column:
    """The tokens that are not English stop words in any case."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.filter(tokens, lambda w: ~F.lower(w).isin(*STOP_WORDS))


def remove_stopwords(df: DataFrame, col: str = "tokens", out: str = "filtered") -> DataFrame:
    return df.withColumn(out, drop_stopwords(col))
