"""Rules as a table (name, pattern) of any size: each text runs only the expressions whose literals it contains.

Every alternative of a pattern that must contain some plain letters gives a literal. All literals form one automaton, which
walks a text once; the patterns it names are then searched. Patterns with an alternative without a literal are searched
in every text, so give them one where you can.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import alternatives, folded, literal
from ..functions.text import clean

#: Rules at most: the table goes to every task (some 100 bytes a rule).
MAX_RULES = 100_000
_LEAST = 2


def literals(pattern: str) -> list[str] | None:
    """A literal of each alternative of a pattern; None if one has none."""
    found = [literal(part) for part in alternatives(pattern)]
    return found if all(len(x) >= _LEAST for x in found) else None


def searchable(pattern: str) -> regex.Pattern:
    """A pattern of the JVM's dialect (code points as \\x{...}) as it is searched here, case-blind."""
    plain = regex.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", pattern)
    return regex.compile(plain, regex.IGNORECASE)


class Matcher:
    """The rules of a worker."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = [(name, searchable(pattern)) for name, pattern in rules]
        self.always, named = [], {}
        for k, (_, pattern) in enumerate(rules):
            own = literals(pattern)
            if own is None:
                self.always.append(k)
            for x in own or []:
                named.setdefault(x, []).append(k)
        self.automaton = ahocorasick.Automaton()
        for x, ks in named.items():
            self.automaton.add_word(x, ks)
        if named:
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[str]:
        """Names of the rules that match, in order of name."""
        asked = set(self.always)
        if len(self.automaton):
            for _, ks in self.automaton.iter(folded(text)):
                asked.update(ks)
        return sorted({self.rules[k][0] for k in asked if self.rules[k][1].search(text)})


_kept: dict = {}


def _matcher(rules: tuple[tuple[str, str], ...]) -> Matcher:
    if _kept.get("rules") != rules:
        _kept.update(rules=rules, matcher=Matcher(list(rules)))
    return _kept["matcher"]


def collected(rules: DataFrame) -> tuple[tuple[str, str], ...]:
    """The table of rules, counted before it is fetched."""
    own = rules.where("name IS NOT NULL AND pattern IS NOT NULL").select(F.col("name").cast("string"), F.col("pattern").cast("string")).distinct()
    if own.limit(MAX_RULES + 1).count() > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules; cut the table and union the hits")
    return tuple(sorted(map(tuple, own.collect())))


def matched(df: DataFrame, rules: DataFrame, text: Column | str = "text") -> DataFrame:
    """df with hits, the sorted names of the rules (name, pattern) that match its text, case-blind; blank text never hits.

    Rows stay in their tasks. Several patterns may have one name.
    """
    table = collected(rules)
    value = F.col(text) if isinstance(text, str) else text
    rows = df.withColumn("_text", clean(value))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(table)
        for batch in batches:
            found = [matcher.hits(t) if t.strip() else [] for t in batch.column("_text").to_pylist()]
            at = batch.schema.get_field_index("_text")
            yield batch.set_column(at, pa.field("_text", pa.list_(pa.string())), pa.array(found, pa.list_(pa.string())))

    names = [f"`{f.name}` {'array<string>' if f.name == '_text' else f.dataType.simpleString()}" for f in rows.schema]
    return rows.mapInArrow(work, ", ".join(names)).withColumnRenamed("_text", "hits")
