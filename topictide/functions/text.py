"""Token expressions: everything stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default English stop list shipped with Spark MLlib.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is are
was were be been being have has had having do does did doing a an the and but if or because as until while of
at by for with about against between into through during before after above below to from up down in out on
off over under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don should now i'll you'll he'll she'll
we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't
mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split()

# Contractions and filler removed from documents, not from events.
EXTRA_STOP_WORDS = """
im ive id youre theyre weve dont didnt doesnt cant couldnt wouldnt wont isnt arent wasnt werent thats theres
here also via etc amp
""".split()

DOCUMENT_STOP_WORDS = sorted(set(ENGLISH_STOP_WORDS) | set(EXTRA_STOP_WORDS))
EVENT_STOP_WORDS = sorted(set(ENGLISH_STOP_WORDS))

TOKEN_PATTERN = "[a-z0-9]+"
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"

# Fixed values of the label noise rule.
URL_SCHEMES = ["http", "https", "ftp", "www"]
LONG_TOKEN = 8
MIN_VOWEL_SHARE = 0.30


def raw_tokens(text: Column, pattern: str = TOKEN_PATTERN) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def content_tokens(text: Column, stop_words=DOCUMENT_STOP_WORDS, pattern: str = TOKEN_PATTERN) -> Column:
    """Lower-cased tokens without stop words; null text gives an empty array."""
    stop = list(stop_words)
    return F.filter(raw_tokens(text, pattern), lambda t: ~t.isin(stop))


def normalized(text: Column, stop_words=DOCUMENT_STOP_WORDS) -> Column:
    return F.array_join(content_tokens(text, stop_words), " ")


def bigrams(tokens: Column) -> Column:
    """Neighbouring token pairs; the last entry is null because it has no partner."""
    return F.zip_with(tokens, F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))),
                      lambda a, b: F.concat(a, F.lit(" "), b))


def is_noise_token(t: Column) -> Column:
    """Tracking ids, URL schemes and bare numbers, which never make a label."""
    vowels = F.length(F.regexp_replace(t, "[^aeiou]", ""))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    long_noise = (
        t.rlike("^[0-9a-f]{8,}$")
        | t.rlike(r"^\p{Nd}[a-z0-9]{7,}$")
        | (t.rlike(r"\p{Nd}") & t.rlike(r"\p{L}"))
        | F.coalesce(vowels / F.when(letters > 0, letters) < F.lit(MIN_VOWEL_SHARE), F.lit(False))
    )
    return t.isin(URL_SCHEMES) | t.rlike(r"^\p{Nd}+$") | ((F.length(t) >= LONG_TOKEN) & long_noise)


def strip_noise_tokens(text: Column) -> Column:
    return F.array_join(F.filter(raw_tokens(text), lambda t: ~is_noise_token(t)), " ")


def clean_label(terms: Column, n_top: int = 3) -> Column:
    kept = F.filter(terms, lambda t: ~is_noise_token(t))
    return F.when(F.size(kept) > 0, F.array_join(F.slice(kept, 1, n_top), ", ")).otherwise("unlabelled")
