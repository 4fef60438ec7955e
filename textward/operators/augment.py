"""Seeded text noise in Arrow batches; each row's draws come from a hash of seed and key, never from its partition."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .corpus import hash_order

# The neighbours of each key, look-alike characters (a letter may stand for itself), the alphabet.
NEAR = {
    "й": "цф", "ц": "йуы", "у": "цке", "к": "уен", "е": "кнг", "н": "егш", "г": "ншщ", "ш": "гщз", "щ": "шзх", "з": "щхъ", "х": "зъ", "ъ": "х",
    "ф": "йыв", "ы": "фва", "в": "ыап", "а": "впр", "п": "аро", "р": "пол", "о": "рлд", "л": "одж", "д": "лжэ", "ж": "дэ", "э": "ж",
    "я": "чсм", "ч": "ясм", "с": "чми", "м": "сит", "и": "мть", "т": "иьб", "ь": "тбю", "б": "ью", "ю": "б",
}
LEET = {"а": "4@", "о": "0о", "е": "3ё", "и": "1|", "с": "$с", "з": "3з", "т": "7т", "б": "6б"}
ALPHABET = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
KINDS = ("qwerty", "insert", "delete", "replace", "leet")
#: How likely each kind is when a kind is drawn; the rest falls to combined.
SHARES = {"qwerty": 0.25, "insert": 0.25, "delete": 0.25, "replace": 0.25, "leet": 0.25}
# Latin texts get the same noise by keys and letters of their own.
_LATIN_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_LATIN_NEAR = {ch: row[max(0, k - 1) : k] + row[k + 1 : k + 2] for row in _LATIN_ROWS for k, ch in enumerate(row)}
_LATIN_LEET = dict(zip("aeiostbg", "43105786"))


@dataclass(frozen=True)
class Script:
    """What noise draws from: neighbours, look-alikes, alphabet."""

    near: dict[str, str]
    leet: dict[str, str]
    alphabet: str


CYRILLIC = Script(NEAR, LEET, ALPHABET)
#: Rows that a task makes noisy at once: it holds their texts, not those of a whole batch.
PIECE = 200
LATIN = Script(_LATIN_NEAR, _LATIN_LEET, "abcdefghijklmnopqrstuvwxyz")


def _places(kind: str, chars: list[str], n: int, rng: random.Random, script: Script) -> None:
    """n draws of a place, each changed once at most by what its letter may become; case is kept."""
    options = {"qwerty": script.near.get, "leet": lambda ch: script.leet.get(ch) or (ch if ch in script.alphabet else None), "replace": lambda ch: script.alphabet if ch in script.alphabet else None}[kind]
    changed = set()
    for k in (rng.randrange(len(chars)) for _ in range(n)):
        found = None if k in changed else options(chars[k].lower())
        if found:
            new = rng.choice(found)
            chars[k] = new.upper() if chars[k].isupper() else new
            changed.add(k)


def apply(kind: str | None, text: str, intensity: float, rng: random.Random, script: Script = CYRILLIC, shares: dict[str, float] = SHARES) -> tuple[str, str]:
    """The noisy text and the kind of noise; blank text stays, as original. Without a kind one is drawn by cumulative shares.

    A kind changes max(1, int(length x intensity)) places. Combined takes each kind by its share (one at random if none),
    splits the intensity over those taken, and applies the first two of them.
    """
    if not text.strip():
        return text, "original"
    if kind is None:
        drawn, upto, kind = rng.random(), 0.0, "combined"
        for name in KINDS:
            upto += shares.get(name, 0.0)
            if drawn < upto:
                kind = name
                break
    if kind == "combined":
        taken = [name for name in KINDS if rng.random() < shares.get(name, 0.0)] or [rng.choice(KINDS)]
        for name in taken[:2]:
            text = apply(name, text, intensity / len(taken), rng, script, shares)[0]
        return text, "char_noise_combined"
    chars, n = list(text), max(1, int(len(text) * intensity))
    if kind == "insert":
        for _ in range(n):
            chars.insert(rng.randint(0, len(chars)), rng.choice(script.alphabet))
    elif kind == "delete":
        gone = set(rng.sample(range(len(chars)), min(n, len(chars) - 1)))
        chars = [ch for k, ch in enumerate(chars) if k not in gone]
    else:
        _places(kind, chars, n, rng, script)
    return "".join(chars), f"char_noise_{kind}"


def _noisy(kind: str | None, names: list[str], script: Script, shares: dict[str, float]):
    """Batches of (names, text, _x, _draw) with noisy texts, piece by piece."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, PIECE):
                batch = whole.slice(a, PIECE)
                made = [apply(kind, t, x, random.Random(s), script, shares) for t, x, s in zip(*[batch.column(c).to_pylist() for c in ("text", "_x", "_draw")])]
                columns = {c: batch.column(c) for c in names}
                yield pa.RecordBatch.from_pydict(columns | {"text": pa.array([m[0] for m in made], pa.string()), "kind": pa.array([m[1] for m in made], pa.string())})

    return work


def noise(df: DataFrame, kind: str | None = None, intensity: float = 0.05, seed: str = "noise-1", key: str = "doc_id", script: Script = CYRILLIC, shares: dict[str, float] = SHARES) -> DataFrame:
    """df (key, text and more) with text made noisy and kind added; null texts count as empty.

    A column intensity of df, where it has one, is the row's own. Draws come from seed, key and text.
    """
    names = [c for c in df.columns if c not in ("text", "intensity")]
    own = F.col("intensity") if "intensity" in df.columns else F.lit(intensity)

    text = F.coalesce("text", F.lit(""))
    rows = df.select(*names, text.alias("text"), own.cast("double").alias("_x"), hash_order(seed, F.concat_ws("|", F.col(key).cast("string"), F.md5(text))).alias("_draw"))
    kinds = dict(df.dtypes)
    return rows.mapInArrow(_noisy(kind, names, script, shares), ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", text string, kind string")


def _stage(df: DataFrame, translate: Callable[[list[str]], list[str]], size: int) -> DataFrame:
    """df with made translated in lists of `size`; a list that fails, or texts that are null, give null."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made: list[str | None] = [None] * len(pdf)
            given = [k for k, t in enumerate(pdf["made"]) if isinstance(t, str)]
            for a in range(0, len(given), size):
                part = given[a : a + size]
                try:
                    answers = list(translate([pdf["made"].iloc[k] for k in part]))
                except Exception:  # a failing plug-in leaves the originals
                    continue
                for k, t in zip(part, answers):
                    made[k] = t
            yield pdf.assign(made=pd.Series(made, index=pdf.index, dtype=object))

    return df.mapInPandas(work, df.schema)


def round_trip(df: DataFrame, there: Callable[[list[str]], list[str]], back: Callable[[list[str]], list[str]], most: int = 500, size: int = 16, key: str = "doc_id") -> DataFrame:
    """key, text, kind: texts through two plug-ins; blank or longer than `most`, failed, empty or unchanged ones stay original."""
    own = F.coalesce("text", F.lit(""))
    asked = df.select(key, own.alias("text"), F.when((strip(own) != "") & (F.length(own) <= most), own).alias("made"))
    done = _stage(_stage(asked, there, size), back, size)
    new = (F.coalesce("made", F.lit("")) != "") & (F.col("made") != F.col("text"))
    return done.select(key, F.when(new, F.col("made")).otherwise(F.col("text")).alias("text"), F.when(new, "back_translation").otherwise("original").alias("kind"))


def dataset(df: DataFrame, p: float = 0.5, more: float = 1.5, intensity: float = 0.05, seed: str = "noise-1", key: str = "doc_id", script: Script = CYRILLIC) -> DataFrame:
    """Originals and noisy copies (key, text, label, kind); positives are drawn more often (up to always) and get more noise (up to 0.1).

    Blank texts get no copy, unchanged copies are dropped. The copy is made where its row is, so repeated ids stay apart.
    """
    positive = F.col("label") == 1
    share = F.when(positive, min(1.0, p * more)).otherwise(p)
    rows = df.select(key, F.coalesce("text", F.lit("")).alias("text"), "label")
    chosen = rows.where((strip(F.col("text")) != "") & (hash_order(seed + "-gate", F.concat_ws("|", F.col(key).cast("string"), F.md5("text"))) / float(2**32) < share))
    chosen = chosen.withColumns({"intensity": F.when(positive, min(0.1, intensity * more)).otherwise(intensity), "before": F.col("text")})
    noisy = noise(chosen, None, intensity, seed, key, script).where("text <> before")
    return df.select(key, "text", "label", F.lit("original").alias("kind")).unionByName(noisy.select(key, "text", "label", "kind"))
