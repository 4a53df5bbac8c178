"""Operator 4: URL filter by a weighted vocabulary, under host and path rules.

Host and path are taken by array-free string functions; one Aho-Corasick pass finds all terms of the lower-cased (A-Z) url. A hit counts
only between boundaries (no ASCII letter or digit on either side). One strict term, or SOFT_LIMIT distinct soft terms, block.
Rules come first: the longest that fits the host (or a parent domain of it) and the start of the path decides; equally long
ones: block before allow, then by name. No shuffle; a url that a third of all rows share costs what any other does.

Defined cases: a null url, or one without ``://``, has empty host and path and fits no rule; a null url has no terms and is allowed; a null
page_id is kept; repeated rows are judged one by one; a very long url is one linear pass; equally long rules are a tie, see above; an empty
table gives no rows; of other columns, whatever their names, only page_id and url are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import batched

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The vocabulary.
STRICT = ("casino", "cheap-pills", "escort", "hentai", "malware", "phishing", "porn", "porno", "spam-farm", "torrent", "viagra", "warez", "xxx")
SOFT = ("adult", "bet", "bonus", "cheap", "crack", "dating", "deal", "free", "gambling", "loan", "nude", "pharmacy", "pills", "poker", "promo", "sex", "slots", "spam", "win")
SOFT_LIMIT = 2
# The rules of the contract.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def ranked(rules: Sequence[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-len(r.name()), r.verdict != "block", r.name()))


def automaton(strict: Sequence[str], soft: Sequence[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, term in enumerate([*strict, *soft]):
        a.add_word(term, (k, len(term), k < len(strict)))
    if len(a):
        a.make_automaton()
    return a


def hits(a, url: str | None) -> tuple[int, int]:
    """Distinct strict and distinct soft terms between boundaries."""
    if not url or not len(a):
        return 0, 0
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url) if not url.isascii() else url.lower()
    edge = lambda k: not (0 <= k < len(low) and low[k].isascii() and low[k].isalnum())
    found = {(k, strict) for end, (k, n, strict) in a.iter(low) if edge(end + 1) and edge(end - n)}
    strict = sum(s for _, s in found)
    return strict, len(found) - strict


def judge(pages: DataFrame, rules: Sequence[Rule], *, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, n_strict, n_soft."""
    strict, soft = tuple(strict), tuple(soft)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(strict, soft)
        for b in batches:
            n = [hits(a, u) for u in b.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in n], pa.int64()), pa.array([y for _, y in n], pa.int64())], [*b.schema.names, "n_strict", "n_soft"])

    counted = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).transform(batched).mapInArrow(count, "page_id long, url string, n_strict long, n_soft long")
    part = lambda p: F.coalesce(F.regexp_extract("url", p, 1), F.lit(""))
    host, path = F.col("host"), F.col("path")
    rule = verdict = None
    for r in reversed(ranked(rules)):
        rule = F.when(r.fits(host, path), F.lit(r.name())).otherwise(F.lit(None).cast("string") if rule is None else rule)
        verdict = F.when(r.fits(host, path), F.lit(r.verdict)).otherwise(F.lit(None).cast("string") if verdict is None else verdict)
    method = F.when((F.col("n_strict") > 0) | (F.col("n_soft") >= soft_limit), "block").otherwise("allow")
    placed = counted.withColumns({"host": F.translate(part("://([^/?#]*)"), UPPER, LOWER), "path": part("://[^/?#]*([^?#]*)")})
    none = F.lit(None).cast("string")
    return placed.select("page_id", "host", "path", (none if rule is None else rule).alias("rule"), F.coalesce(none if verdict is None else verdict, method).alias("verdict"), "n_strict", "n_soft")


def sql(rules: Sequence[Rule], strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_limit: int = SOFT_LIMIT) -> str:
    has = lambda t: f"CAST(coalesce(regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])'), FALSE) AS BIGINT)"
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    order = ranked(rules)
    return f"""WITH p AS (SELECT page_id, translate(url, '{UPPER}', '{LOWER}') AS low,
 coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
 coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
n AS (SELECT *, {' + '.join(map(has, strict))} AS n_strict, {' + '.join(map(has, soft))} AS n_soft FROM p)
SELECT page_id, host, path, CASE {' '.join(f"WHEN {fits(r)} THEN '{r.name()}'" for r in order)} END AS rule,
 CASE {' '.join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in order)} WHEN n_strict > 0 OR n_soft >= {soft_limit} THEN 'block' ELSE 'allow' END AS verdict,
 n_strict, n_soft FROM n"""


CONTRACT = tuple(Rule(*r) for r in RULES)
ORACLE_SQL = sql(CONTRACT)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), CONTRACT)
