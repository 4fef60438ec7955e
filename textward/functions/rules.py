"""Pattern rule sets: one rlike per category, no UDF."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import EDGE, TAIL, WS, clean

def dialect(pattern: str) -> str:
    """A pattern with \\b, \\w, \\s, \\S, \\d in their Unicode sense, spelled out so that all engines agree.

    A word boundary before a word becomes the text's start or a character of no word, one after a word the end or such a
    character: the same texts match, though a match takes the character in.
    """
    out, k, inside = "", 0, False
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two == "\\b":
            out += EDGE if k == 0 or pattern[k - 1] in "(|" else TAIL
        elif two == "\\s":
            out += WS if inside else f"[{WS}]"
        elif two == "\\S":
            out += f"[^{WS}]"
        elif two == "\\w":
            out += r"[\p{L}\p{N}_]"
        elif two == "\\d":
            out += r"\p{Nd}"
        else:
            inside = pattern[k] == "[" or inside and pattern[k] != "]"
            out += pattern[k]
            k += 1
            continue
        k += 2
    return out


# Spam categories (Russian).
_SPAM = {
    "earnings": r"\bбез\s*вложений\b"
    r"|(?:заработ\w*|доход\w*)[^\n]{0,25}без\s*вложений"
    r"|без\s*вложений[^\n]{0,25}(?:заработ|доход)"
    r"|\bпассивн\w*\s+доход\b"
    r"|\bсхем\w*\s+(?:заработ|доход)"
    r"|\b(?:реферал\w*\s+(?:ссылк|код)|реферальн\w*\s+ссылк)"
    r"|\bбонус\w*\s+за\s+(?:регистрац|рег)\b"
    r"|\b(?:заработ|доход)\w*\s+от\s+\d"
    r"|\bвывод\w*\s+(?:на\s+)?(?:карт|кошел)",
    "cta_links": r"(?:перейд|переход|(?:на)?жми|кликай|тыкай)\w*[^\n]{0,20}(?:ссылк|линк|link)\b"
    r"|\b(?:на)?пиши\s+(?:в\s+)?(?:лс|личк|директ)\b"
    r"|\bподпис\w*\s+на\s+канал\b"
    r"|\bканал\w*\s+подпис",
    "recruitment": r"шабашк|халтурк?а|зарабатывай",
}
# Toxicity categories (Russian insults).
_TOXIC = {
    "хуй": r"\b(?:(?:по|ни|на|а|о)?ху[ейяию]|аху)\S*|\bхеров|херн|\b(?:хули|ху?[\sй]?н[яюе]|х\s?у?ета?|хер)\b|титьк|сиськ",
    "бля": r"\bбл[яеэ]+(?:[тд]ь?)?\b|бляд|жоп|залуп\S*|г[ао]ндон|д[еи]бил|ч[ьъ]?мо|идиот|ублюд|шлюх|урод|д[оа]лб[ао]",
    "пиздец": r"п[еи]?зде?ц?|\bпиз\b|пид[оа]?р|\bтрах",
    "говно": r"г[ао]вн|\bдерьмо\b",
}
SPAM = {name: dialect(pattern) for name, pattern in _SPAM.items()}
TOXIC = {name: dialect(pattern) for name, pattern in _TOXIC.items()}


def alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern at its outermost level."""
    parts, depth, escaped = [""], 0, False
    for ch in pattern:
        if ch == "|" and depth == 0:
            parts.append("")
            continue
        if not escaped:
            depth += (ch in "([") - (ch in ")]")
        escaped = ch == "\\" and not escaped
        parts[-1] += ch
    return parts


#: Letters that match another one whatever their case, beyond lower().
_ALIKE = str.maketrans({"ſ": "s", "ς": "σ"})


def folded(text: str) -> str:
    return text.lower().translate(_ALIKE)


def literal(part: str) -> str:
    """The longest run of plain characters that a match of an alternative must contain; empty if there is none.

    Groups, classes, escapes and dots end a run, and a character that may be absent is not part of one.
    """
    best, run, k, depth = "", "", 0, 0
    while k < len(part):
        ch, plain = part[k], ""
        if ch == "\\":
            if k + 1 < len(part) and not part[k + 1].isalnum():
                plain = part[k + 1]
            elif part[k + 1 : k + 2] in ("p", "P", "x", "u") and part[k + 2 : k + 3] == "{":
                k = part.index("}", k)
            k += plain == "" and part[k] == "\\"
            k += plain != ""
        elif ch == "[":
            k += 1 + (part[k + 1 : k + 2] == "^")
            k += part[k : k + 1] == "]"
            while k < len(part) and part[k] != "]":
                k += 1 + (part[k] == "\\")
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        elif ch == "{":
            k = part.index("}", k)
        elif ch not in ".^$*+?|":
            plain = ch
        k += 1
        follows = part[k : k + 1]
        if plain and depth == 0 and follows not in ("?", "*", "{"):
            run += plain
            best = max(best, run, key=len)
        if not plain or depth or follows in ("?", "*", "{", "+"):
            run = ""
    return folded(best)


#: Letters beyond ASCII that match one of ASCII in a case-blind search.
_FOLDED = {"ı": "i", "İ": "i", "ſ": "s", "\u212a": "k"}


def _groups(part: str) -> list[str]:
    """What stands in the groups (?:...) of an alternative that it can't do without, those inside others left out."""
    found, start, depth, k = [], 0, 0, 0
    while k < len(part):
        ch = part[k]
        if ch == "\\":
            k += 1
        elif ch == "[":
            k += 1 + (part[k + 1 : k + 2] == "^")
            k += part[k : k + 1] == "]"
            while k < len(part) and part[k] != "]":
                k += 1 + (part[k] == "\\")
        elif ch == "(":
            start = k if depth == 0 else start
            depth += 1
        elif ch == ")":
            depth -= 1
            if depth == 0 and part.startswith("(?:", start) and part[k + 1 : k + 2] not in ("?", "*", "{"):
                found.append(part[start + 3 : k])
        k += 1
    return found


def needed(pattern: str) -> list[str] | None:
    """Plain ASCII runs of which each match of a pattern contains one (case aside); None if there are no such."""
    out = []
    for part in alternatives(pattern):
        own = [literal(part)]
        if not own[0]:
            own = next((x for x in map(needed, _groups(part)) if x), None)
        if not own:
            return None
        out += own
    return out if all(x.isascii() for x in out) else None


def is_cyrillic(pattern: str) -> bool:
    """Whether every alternative needs a Cyrillic letter, so that texts without one can be passed over."""
    return all(re.search("[а-яё]", part) for part in alternatives(pattern))


def _search(text: Column, pattern: str, cyrillic: bool) -> Column:
    found = clean(text).rlike("(?iu)" + pattern)
    if cyrillic:
        return clean(text).rlike("[а-яА-ЯёЁ]") & found
    runs = needed(pattern)
    if not runs:
        return found
    # looked up before the search, with the letters beyond ASCII that match i, s or k whatever their case
    likely = [F.lower(clean(text)).contains(run) for run in dict.fromkeys(runs)]
    likely += [clean(text).contains(ch) for ch, plain in _FOLDED.items() if any(plain in run for run in runs)]
    return reduce(or_, likely) & found


def hits(text: Column, pattern: str) -> Column:
    """Case-blind match; blank text never hits."""
    return _search(text, pattern, is_cyrillic(pattern))


def categories(text: Column, patterns: dict[str, str]) -> Column:
    """Map of the categories that hit, each with score 1.0."""
    pairs = F.array(*[F.when(hits(text, p), F.struct(F.lit(k).alias("key"), F.lit(1.0).alias("value"))) for k, p in patterns.items()])
    return F.map_from_entries(F.filter(pairs, lambda x: x.isNotNull()))


def any_hit(text: Column, patterns: dict[str, str]) -> Column:
    """Whether some category hits: one pattern, so a text is searched once; one by one where plain runs rule out most searches."""
    if all(map(needed, patterns.values())):
        return reduce(or_, [hits(text, p) for p in patterns.values()])
    return _search(text, "|".join(f"(?:{p})" for p in patterns.values()), all(map(is_cyrillic, patterns.values())))


def mask(text: Column, patterns: dict[str, str]) -> Column:
    """One bit per pattern, packed."""
    bits = [F.when(hits(text, p), F.lit(1 << k)).otherwise(F.lit(0)) for k, p in enumerate(patterns.values())]
    return sum(bits[1:], bits[0]).cast("long")


def names(categories: Column) -> Column:
    """Categories sorted and joined by commas."""
    return F.array_join(F.sort_array(F.map_keys(categories)), ",")
