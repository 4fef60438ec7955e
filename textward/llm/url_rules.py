"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern over host and path: literal text with * (anything), ^ (a separator or either end) and, in front,
|| (the start of the host or of one of its parent domains). Each rule is filed under one literal token that every
matching URL must hold as a whole token: the rarest of its tokens, by count over all URLs of the table. A URL looks up
its own tokens; only the rules found there run their regular expression. Rules without such a token run always.

Up to MAX_RULES rules are sent to the tasks as an index, and URLs are judged where they are read, without a shuffle. A
larger table of rules meets the URLs in a join on tokens, hot tokens salted; each different URL is judged once there.
Token counts are one partial aggregation over all URLs.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import all_salts, hot_values, salt

#: More rules than this are joined instead of sent (about 1 kB each with their compiled expressions).
MAX_RULES = 50_000
SALTS = 64
_TOKEN = re.compile("[A-Za-z0-9]+")
_URL = re.compile(r".*?://([^/?#]*)([^?#]*)", re.S)
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """Decision of URLs that the pattern fits; named rules decide before unnamed ones, longest name first."""

    pattern: str
    verdict: str
    name: str | None = None


def site(name: str, verdict: str) -> Rule:
    """A rule for a host with all subdomains and a path prefix, such as com/en/."""
    return Rule(f"||{name}" + ("" if "/" in name else "^"), verdict, name)


def read_rules(path: str | Path) -> tuple[Rule, ...]:
    """Rules of a local text file: verdict, pattern and perhaps a name on each line; # begins a comment."""
    lines = (line.split("#")[0].split() for line in Path(path).read_text(encoding="utf-8").splitlines())
    return tuple(Rule(pattern, verdict, *name) for verdict, pattern, *name in filter(None, lines))


# The rules of the contract.
SITES = (site("com/en/", "block"), site("example.com/en/7", "allow"), site("net/de/", "allow"), site("example.net/de/8", "block"), site("org/es/", "block"))
#: Patterns of junk sites, a parameter of judge like any other list.
JUNK = read_rules(Path(__file__).with_name("junk_rules.txt"))


def expression(pattern: str) -> str:
    """The regular expression of a pattern, to be searched in host + path; a * at either end says nothing."""
    start, pattern = "", pattern.strip("*")
    if pattern.startswith("||"):
        start, pattern = r"^(?:[^/]*\.)?", pattern[2:]
    parts = {"*": ".*", "^": r"(?:^|$|[^A-Za-z0-9])"}
    return start + "".join(parts.get(ch) or re.escape(ch) for ch in pattern)


def literals(pattern: str) -> list[str]:
    """The tokens that a matching URL must hold as whole tokens: those with a boundary on both sides."""
    anchored = pattern.startswith("||")
    body = pattern[2:] if anchored else pattern
    found = []
    for m in _TOKEN.finditer(body):
        left = anchored if m.start() == 0 else body[m.start() - 1] != "*"
        right = m.end() < len(body) and body[m.end()] != "*"
        if left and right:
            found.append(m[0])
    return found


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    m = _URL.match(url or "")
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


class Index:
    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.rules = [(r, re.compile(expression(r.pattern), re.S)) for r in rules]
        self.by_token: dict[str, list[int]] = defaultdict(list)
        self.always: list[int] = []
        for k, r in enumerate(rules):
            tokens = literals(r.pattern)
            if tokens:
                self.by_token[min(tokens, key=lambda t: (counts.get(t, 0), t))].append(k)
            else:
                self.always.append(k)

    def candidates(self, text: str) -> list[int]:
        found = list(self.always)
        for token in set(_TOKEN.findall(text)):
            found += self.by_token.get(token, ())
        return found

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        """The named rule that decides (else null), and the verdict."""
        text = host + path
        fits = [self.rules[k][0] for k in self.candidates(text) if self.rules[k][1].search(text)]
        named = [r for r in fits if r.name is not None]
        if named:
            best = min(named, key=lambda r: (-len(r.name), r.verdict != "block", r.name))
            return best.name, best.verdict
        verdicts = {r.verdict for r in fits}
        return None, "block" if "block" in verdicts and "allow" not in verdicts else "allow"


def token_counts(pages: DataFrame) -> DataFrame:
    """token, n: in how many URLs (host lower-cased, path) each token is."""
    host, path = _host_path()
    tokens = F.array_distinct(F.regexp_extract_all(F.concat(host, path), F.lit("[A-Za-z0-9]+"), 0))
    return pages.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def _host_path():
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


_JUDGED = "page_id long, host string, path string, rule string, verdict string"


def judge(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = SITES + JUNK) -> DataFrame:
    """page_id, host, path, rule, verdict for every row.

    rules are a list, or a table with pattern, verdict and name (null for none). Named rules win by length; of equally
    long ones a block. Without a named rule, unnamed patterns decide: block if some fits and no unnamed allow does, else
    allow. Null URLs have empty host and path and are allowed. Repeated rows are judged alike, very long URLs whole;
    other columns are not read. An empty table gives no rows.
    """
    if not isinstance(rules, DataFrame) and len(rules) > MAX_RULES:
        rules = pages.sparkSession.createDataFrame([(r.pattern, r.verdict, r.name) for r in rules], "pattern string, verdict string, name string")
    if isinstance(rules, DataFrame):
        if rules.limit(MAX_RULES + 1).count() > MAX_RULES:
            return _joined(pages, rules)
        rules = tuple(Rule(*r) for r in rules.select("pattern", "verdict", "name").toLocalIterator())
    tokens = sorted({t for r in rules for t in literals(r.pattern)})
    counts: dict[str, int] = {}
    if tokens:
        counts = {r["token"]: r["n"] for r in token_counts(pages).where(F.col("token").isin(tokens)).collect()}  # a row for each of the rules' tokens at most
    index = Index(list(rules), counts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [parts(u.as_py()) for u in batch.column("url")]
            judged = [index.judge(*s) for s in split]
            columns = {
                "page_id": batch.column("page_id"),
                "host": pa.array([s[0] for s in split], pa.string()),
                "path": pa.array([s[1] for s in split], pa.string()),
                "rule": pa.array([j[0] for j in judged], pa.string()),
                "verdict": pa.array([j[1] for j in judged], pa.string()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(work, _JUDGED)


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rules with their regular expression and the tokens they could be filed under."""
    for batch in batches:
        patterns = batch.column("pattern").to_pylist()
        made = {"id": batch.column("id"), "search": pa.array([f"(?s){expression(p)}" for p in patterns]), "tokens": pa.array([sorted(set(literals(p))) for p in patterns], pa.list_(pa.string()))}
        yield pa.RecordBatch.from_pydict(made | {c: batch.column(c) for c in ("verdict", "name")})


def _joined(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """As judge, with rules filed under their rarest token by joins. Rules without a token (few, as they run always) are sent whole."""
    numbered = rules.select("pattern", "verdict", "name").distinct().withColumn("id", F.xxhash64("pattern", "verdict", "name"))
    filed = numbered.mapInArrow(_filed, "id long, search string, tokens array<string>, verdict string, name string")
    counted = filed.select("*", F.explode_outer("tokens").alias("token")).join(token_counts(pages), "token", "left")
    rarest = F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token"))
    filed = counted.groupBy("id", "search", "verdict", "name").agg(rarest.alias("token"))
    host, path = _host_path()
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    urls = rows.select("host", "path").distinct().withColumn("text", F.concat("host", "path"))
    asked = urls.select("*", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), 0)))).alias("token"))
    filed = filed.withColumn("token", F.coalesce("token", F.lit("")))
    asked = asked.join(filed.select("token").distinct(), "token", "left_semi")
    hot = hot_values(asked.select("token"), "token")
    spread = filed.withColumn("salt", F.explode(all_salts(F.col("token"), hot, SALTS)))
    met = asked.withColumn("salt", salt(F.col("token"), hot, F.col("text"), SALTS)).join(spread, ["token", "salt"]).where(F.expr("text RLIKE search"))
    named = F.col("name").isNotNull()
    best = F.min(F.when(named, F.struct((-F.length("name")).alias("long"), (F.col("verdict") != "block").alias("late"), "name", "verdict")))
    is_any = lambda v: F.coalesce(F.max(~named & (F.col("verdict") == v)), F.lit(False))
    judged = met.groupBy("host", "path").agg(best.alias("best"), is_any("block").alias("blocked"), is_any("allow").alias("allowed"))
    verdict = F.coalesce("best.verdict", F.when(F.col("blocked") & ~F.col("allowed"), "block"), F.lit("allow"))
    many = hot_values(rows.select("host"), "host")
    judged = judged.select("host", "path", F.col("best.name").alias("rule"), verdict.alias("verdict"), F.explode(all_salts(F.col("host"), many, SALTS)).alias("salt"))
    out = rows.withColumn("salt", salt(F.col("host"), many, F.monotonically_increasing_id(), SALTS)).join(judged, ["host", "path", "salt"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def _sql_case() -> tuple[str, str]:
    when = []
    for r in sorted(SITES, key=lambda r: (-len(r.name), r.name)):
        host, _, path = r.name.partition("/")
        when.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')", r))
    name = " ".join(f"WHEN {c} THEN '{r.name}'" for c, r in when)
    verdict = " ".join(f"WHEN {c} THEN '{r.verdict}'" for c, r in when)
    return f"CASE {name} END", f"CASE {verdict}"


_JUNK_SQL = " OR ".join(f"regexp_matches(host || path, '(?s){expression(r.pattern)}')" for r in JUNK)
ORACLE = rf"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
)
SELECT page_id, host, path, {_sql_case()[0]} AS rule,
       {_sql_case()[1]} WHEN {_JUNK_SQL} THEN 'block' ELSE 'allow' END AS verdict
FROM u
"""
