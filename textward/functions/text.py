"""Text normalisation as Column expressions; no UDFs, so all of it stays in generated code.

Patterns avoid \\s, \\w and \\b, whose meaning differs between engines, and spell out the Unicode classes instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# White space in the sense of Unicode, with U+001C to U+001F.
WS = r"\x09-\x0d\x1c-\x20\x{85}\p{Z}"
# The same, character by character: Z has a space separator in each of these places, and the line and paragraph separators.
_WS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
EDGE = r"(?:^|[^\p{L}\p{N}_])"
TAIL = r"(?:$|[^\p{L}\p{N}_])"

# Patterns of what is stripped.
URL_EMAIL = (
    rf"https?://[^{WS}<>\"']+|www\.[^{WS}<>\"']+|[a-z\p{{Nd}}._+-]+@[a-z\p{{Nd}}.-]+\.[a-z]{{2,}}(?:\.[a-z]{{2,}})?"
)
TAGS_LAZY = r"<[^\n>]*>"
TAGS = r"<[^>]+>"
MENTION = rf"(?i)\[(?:id|club|public)\p{{Nd}}+\|[^\]]+\],?[{WS}]*"
MENTION_ID = rf"\[id\p{{Nd}}+\|[^\]]*\],?[{WS}]*"
ENTITIES_GREEDY = r"&#\p{Nd}+;|&[^\n]+;"
ENTITIES = r"&#\p{Nd}+;|&[a-z]+;"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
_MARKS = ("<", "&", "@", "[", "http", "www.")
_SPAM_MARKS = ("<", "&", "[")
# a capital sigma and a dotted capital I
_ALONE = "\u03a3\u0130"
# punctuation to a space and runs of spaces to one, in a single search
_GAPS = rf"[{WS}{PUNCTUATION[1:]}{{2,}}|{PUNCTUATION}"
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]+"
SPACES = rf"[{WS}]{{2,}}"
# The stop words of the spam side (Russian).
SPAM_STOP_WORDS = (
    "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только её их или еще из ли ну от до для это если при там тут"
).split()
TOKEN_EDGE = r"[.,!?;:\-()\[\]{}\"'…]"


def clean(text: Column) -> Column:
    """Null text counts as empty."""
    return F.coalesce(text, F.lit(""))


def replace(text: Column, pattern: str, by: str = " ") -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(by))


def strip(text: Column) -> Column:
    """Without the white space of WS at both ends."""
    return F.btrim(text, F.lit(_WS_CHARS))


def lower(text: Column, alone: str = _ALONE) -> Column:
    """The characters in alone each by itself, as SQL's lower has them: F.lower tells a sigma at a word's end and makes two characters of a dotted I."""
    return F.lower(F.when(_has(text, tuple(alone)), F.translate(text, alone, "\u03c3i")).otherwise(text))


def collapse(text: Column) -> Column:
    """Two or more white spaces become one space; ends are stripped."""
    return strip(replace(text, SPACES))


def _has(text: Column, marks: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(m) for m in marks])


def normalise(text: Column, punctuation: bool = True) -> Column:
    """The whole chain of the toxicity side: lower, links, tags, mentions, entities, punctuation, spaces."""
    steps = [(URL_EMAIL, " "), (TAGS_LAZY, " "), (MENTION, ""), (ENTITIES_GREEDY, " ")]
    low = lower(clean(text), _ALONE[0])  # a dotted I stays two characters here
    # marks tell texts in which none of the four can match; most are such
    out = F.when(_has(low, _MARKS), reduce(lambda t, s: replace(t, *s), steps, low)).otherwise(low)
    return strip(replace(out, _GAPS)) if punctuation else collapse(out)


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, rf"[{WS}]+"), lambda w: w != "")


def drop_words(text: Column, words: list[str]) -> Column:
    return F.array_join(F.filter(tokens(text), lambda w: ~F.lower(w).isin(words)), " ")


def process(text: Column, stop_words: list[str] | None = None, punctuation: bool = True) -> Column:
    """normalise, then stop words; blank in, blank out."""
    words = StopWordsRemover.loadDefaultStopWords("russian") if stop_words is None else stop_words
    return drop_words(normalise(text, punctuation), words)


def process_spam(text: Column, stop_words: list[str] = SPAM_STOP_WORDS) -> Column:
    """The spam side keeps case, digits and links: tags, mentions, entities, spaces, then case-blind stop words."""
    out = replace(replace(replace(clean(text), TAGS), MENTION_ID, ""), ENTITIES)
    return drop_words(collapse(F.when(_has(clean(text), _SPAM_MARKS), out).otherwise(clean(text))), stop_words)


def core(word: Column) -> Column:
    """A token without the punctuation at its ends."""
    return replace(word, rf"^{TOKEN_EDGE}+|{TOKEN_EDGE}+$", "")


def is_caps(word: Column) -> Column:
    """At least two letters, and a letter after the first that is upper case."""
    letters = replace(core(word), r"[^\p{L}]", "")
    return letters.rlike(r"(?s)^.+\p{Lu}")


def split_caps(text: Column) -> tuple[Column, Column]:
    """The caps tokens unchanged, and the rest lower-cased."""
    words = tokens(clean(text))
    rest = F.transform(F.filter(words, lambda w: ~is_caps(w)), lambda w: F.lower(w))
    return F.array_join(F.filter(words, is_caps), " "), F.array_join(rest, " ")


def cache_key(text: Column, case_sensitive: bool = False) -> Column:
    own = strip(clean(text))
    return F.concat(F.lit("moderation:cache:"), F.sha2(own if case_sensitive else F.lower(own), 256))


def gram_counts(rows: DataFrame, keys: list[str], text: Column, least: int, most: int) -> DataFrame:
    """keys, term, tf: character n-grams inside words, each padded by one space, counted per keys.

    A word that is shorter than n with its spaces is emitted once, at the first such n. Words are counted first, then
    every place of a word gives its n-grams of all sizes: no step leaves generated code. Where rows are dealt by some of
    the keys, nothing is sent; the n-grams of a text never are.
    """
    words = rows.select(*keys, F.explode(F.split(text, rf"[{WS}]+")).alias("word")).where("word <> ''")
    padded = words.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("times")).select(*keys, F.concat(F.lit(" "), "word", F.lit(" ")).alias("padded"), "times")
    placed = padded.select(*keys, "padded", "times", F.explode(F.sequence(F.lit(1), F.char_length("padded"))).alias("at"))
    sized = F.inline(F.array(*[F.struct(F.substring("padded", F.col("at"), F.lit(n)).alias("term"), F.lit(n).alias("n")) for n in range(least, most + 1)]))
    grams = placed.select(*keys, "times", "at", sized).where((F.char_length("term") == F.col("n")) | ((F.col("at") == 1) & (F.col("n") == least)))
    return grams.groupBy(*keys, "term").agg(F.sum("times").alias("tf"))


def char_ngrams(text: Column, least: int, most: int, lower: bool = True) -> Column:
    """Character n-grams of a text as an array: words padded by one space, a word shorter than n once, then no longer n."""

    def of_word(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        size = F.length(padded)

        def of_size(n: Column) -> Column:
            return F.when(size <= n, F.array(padded)).otherwise(
                F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(padded, i, n))
            )

        sizes = F.filter(F.sequence(F.lit(least), F.lit(most)), lambda n: (n == least) | (size >= n))
        # after the first n that is not below the padded length nothing follows
        sizes = F.filter(sizes, lambda n: (n == least) | (size > n - 1))
        return F.flatten(F.transform(sizes, of_size))

    return F.flatten(F.transform(tokens(F.lower(clean(text)) if lower else clean(text)), of_word))
