"""Hand-made spam features of the raw stripped text, one Column each, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import EDGE, TAIL, TOKEN_EDGE, WS, clean, core, strip, tokens

# Patterns of links, endings, parameters, typos, phones, capitals.
URL = rf"(?i)https?://[^{WS}]+|www\.[^{WS}]+|bit\.ly/[^{WS}]+|tinyurl\.com/[^{WS}]+|t\.co/[^{WS}]+|goo\.gl/[^{WS}]+"
SHORT = r"(?i)bit\.ly|tinyurl\.com|t\.co|goo\.gl|is\.gd|v\.gd|ow\.ly|adf\.ly"
ENDINGS = r"(?i)\.(?:xyz|top|work|click|link|info|biz|win|tk|ml|ga|cf|gq|cc|ws|buzz|rest|download|loan|money|stream)" + TAIL
PARAMETERS = r"(?i)\?(?:ref=|promo=|utm_|aff=)|&(?:ref=|utm_)"
DIGIT_INSIDE = r"[а-яА-Яa-zA-Z][0-9]|[0-9][а-яА-Яa-zA-Z]"
DOTS_INSIDE = EDGE + r"[a-zA-Zа-яА-Я][.]{1,2}[a-zA-Zа-яА-Я]"
PHONE = rf"(?<!\p{{Nd}})(?:\+?\p{{Nd}}[{WS}\-()]*)(?:\p{{Nd}}[{WS}\-()]*){{9,14}}(?!\p{{Nd}})"
CAPS_SHOUT = EDGE + rf"[A-ZА-ЯЁ]{{5,}}[{WS}]*!{{2,}}"
CAPS_WORD = EDGE + r"[A-ZА-ЯЁ]{7,}" + TAIL
WEIRD = rf"[^\p{{L}}\p{{Nd}}{WS}.,!?;:\-()\[\]{{}}\"'…]"

NAMES = [
    "caps_ratio", "url_count", "max_url_length_log1p", "has_short_domain", "has_suspicious_tld", "has_suspicious_params", "repeated_chars_ratio",
    "length_chars_log1p", "typo_score", "max_excl_run_log1p", "max_q_run_log1p", "upper_words_count", "upper_words_ratio", "space_ratio",
    "single_letter_token_ratio", "weird_char_ratio", "has_phone",
]
MINIMAL = ["length_chars_log1p", "space_ratio"]


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def _longest(text: Column, pattern: str) -> Column:
    runs = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda r: F.length(r))
    return F.log1p(F.coalesce(F.array_max(runs), F.lit(0)).cast("double"))


def _letter_tokens(text: Column) -> Column:
    return F.filter(F.transform(tokens(text), core), lambda w: w.rlike(r"\p{L}"))


def matches_caps_shout(text: Column) -> Column:
    return clean(text).contains("!!") & clean(text).rlike(CAPS_SHOUT)


def matches_caps_word(text: Column) -> Column:
    return clean(text).rlike(r"[A-ZА-ЯЁ]{7}") & clean(text).rlike(CAPS_WORD)


def _shared(t: Column) -> tuple[Column, Column, Column]:
    """What several features need of a stripped text: its words, those with letters without their edges, and its links."""
    return tokens(t), _letter_tokens(t), F.regexp_extract_all(t, F.lit(URL), 0)


def feature(name: str, text: Column) -> Column:
    """One feature of a text; null and blank texts give 0."""
    t = strip(clean(text))
    return _feature(name, t, *_shared(t))


def _feature(name: str, t: Column, words: Column, letters: Column, urls: Column) -> Column:
    n = F.length(t)
    joined = F.array_join(urls, " ")
    made = {
        "caps_ratio": lambda: _share(_count(t, r"\p{Lu}"), _count(t, r"\p{L}")),
        "url_count": lambda: F.size(urls).cast("double"),
        "max_url_length_log1p": lambda: F.log1p(F.coalesce(F.array_max(F.transform(urls, lambda u: F.length(u))), F.lit(0)).cast("double")),
        "has_short_domain": lambda: _flag(joined.rlike(SHORT)),
        "has_suspicious_tld": lambda: _flag(joined.rlike(ENDINGS)),
        "has_suspicious_params": lambda: _flag(t.rlike(PARAMETERS)),
        "repeated_chars_ratio": lambda: _share(n - F.length(F.regexp_replace(t, r"(?s)(.)\1{2,}", "")), n),
        "length_chars_log1p": lambda: F.log1p(n.cast("double")),
        "typo_score": lambda: _share(F.size(F.filter(words, lambda w: w.rlike(f"{DIGIT_INSIDE}|{DOTS_INSIDE}"))), F.size(words)),
        "max_excl_run_log1p": lambda: _longest(t, "!+"),
        "max_q_run_log1p": lambda: _longest(t, r"\?+"),
        "upper_words_count": lambda: F.size(F.filter(letters, lambda w: ~w.rlike(r"[\p{L}&&[^\p{Lu}]]"))).cast("double"),
        "upper_words_ratio": lambda: _share(F.size(F.filter(letters, lambda w: ~w.rlike(r"[\p{L}&&[^\p{Lu}]]"))), F.size(letters)),
        "space_ratio": lambda: _share(n - F.length(F.replace(t, F.lit(" "), F.lit(""))), n),
        "single_letter_token_ratio": lambda: _share(F.size(F.filter(letters, lambda w: F.length(w) == 1)), F.size(letters)),
        "weird_char_ratio": lambda: _share(_count(t, WEIRD), n),
        "has_phone": lambda: _flag(t.rlike(PHONE)),
    }
    return made[name]().alias(name)


def features(text: Column, names: list[str] | None = None) -> list[Column]:
    """Feature Columns in the fixed order; an unknown name is an error."""
    unknown = set(names or ()) - set(NAMES)
    if unknown:
        raise ValueError(f"unknown features {sorted(unknown)}; known are {NAMES}")
    return [feature(n, text) for n in NAMES if names is None or n in names]


def with_features(df: DataFrame, text: str, names: list[str], keep: list[str]) -> DataFrame:
    """keep and the features of df, as features(): words and links of a text are made once for all of them."""
    features(F.col(text), names)  # names are known
    rows = df.select(*keep, strip(clean(F.col(text))).alias("_stripped"))
    rows = rows.select("*", *[c.alias(k) for k, c in zip(("_words", "_letters", "_urls"), _shared(F.col("_stripped")))])
    return rows.select(*keep, *[_feature(n, *map(F.col, ("_stripped", "_words", "_letters", "_urls"))) for n in NAMES if n in names])
