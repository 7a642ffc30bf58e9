"""URL filters as a sort-merge range join.

A url's canonical key is its host reversed by label, each label closed by "." ("net.example.www."), so that a host and
all its subdomains are the keys with one prefix: one interval. Urls are range-partitioned
and sorted by (key, path, page_id), which deals a hot host out over many partitions. Each task sweeps its sorted rows
beside the sorted rule intervals: an interval is pushed on a stack as its start is passed and popped at its end, and as
prefix intervals nest or are disjoint, the stack holds just the rules whose host fits the current url. Their paths are
then tried, and the longest rule that fits wins.

Rules are broadcast only up to MAX_RULE_BYTES, which is checked; beyond that the urls' host suffixes are joined to the
rules by equality, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm.common import fresh, schema_plus

#: The production rules: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MAX_RULE_BYTES = 64 << 20
#: What urls get that no rule fits.
DEFAULT = "allow"


def rules_table(spark: SparkSession, rules: tuple = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no "://"."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """Labels from the last to the first, each closed by a dot; empty for an empty host."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


class Sweep:
    """Walks keys in order beside the sorted host intervals of the rules."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        by: dict[str, list[tuple[int, int, bool, str, str, str]]] = {}
        for verdict, host, path in rules:
            prefix = ".".join(reversed(host.split("."))) + "."
            by.setdefault(prefix, []).append((len(host) + len(path), len(host), verdict == "block", verdict, host + path, path))
        self.starts = sorted(by)
        self.rules = [sorted(by[p], reverse=True) for p in self.starts]
        self.next, self.stack = 0, []

    def judge(self, key: str, path: str) -> tuple[str | None, str | None]:
        """Rule and verdict for the next key, which must not sort before the last one."""
        while self.stack and not key.startswith(self.starts[self.stack[-1]]):
            self.stack.pop()
        while self.next < len(self.starts) and self.starts[self.next] <= key:
            if key.startswith(self.starts[self.next]):
                self.stack.append(self.next)
            self.next += 1
        best = max((r for k in self.stack for r in self.rules[k] if path.startswith(r[5])), default=None)
        return (best[4], best[3]) if best else (None, None)


def _swept(df: DataFrame, key: str, path: str, rules: list[tuple[str, str, str]], out: tuple[str, str]) -> DataFrame:
    """df, sorted by key and path within each partition, with the rule and verdict of each row."""
    shared = df.sparkSession.sparkContext.broadcast(rules)
    at = [df.columns.index(c) for c in (key, path)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(shared.value)
        for batch in batches:
            got = [sweep.judge(k, p) for k, p in zip(*(batch.column(i).to_pylist() for i in at))]
            new = [pa.array([g[i] for g in got], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *out])

    return df.mapInArrow(run, schema_plus(df, dict.fromkeys(out, "string")))


def judge_urls(pages: DataFrame, rules: DataFrame, max_rule_bytes: int = MAX_RULE_BYTES, default: str = DEFAULT) -> DataFrame:
    """pages (with url) and host, path, rule and verdict.

    A rule (verdict, host, path) fits its host and all subdomains if the url's path starts with the rule's; the longest
    (host and path together; then the longer host; then block) wins, else rule is null and the verdict is default. Null
    urls, and those without "://", have an empty host and path and fit no rule. Each row gives one row, repeated ones
    equal results; no rules means default everywhere. Names that clash with columns of pages get a leading _.
    """
    names = [fresh(pages, c) for c in ("host", "path", "rule", "verdict")]
    key = fresh(pages, "host_key")
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.withColumns({names[0]: host, names[1]: path}).withColumn(key, reversed_host(F.col(names[0])))
    rules = rules.select("verdict", F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path")).where("host <> ''").distinct()
    size = rules.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 64), F.lit(0))).first()[0]
    if size > max_rule_bytes:
        return _joined(rows, names, key, rules, default)
    fixed = [tuple(r) for r in rules.select("verdict", "host", "path").collect()]
    # rows of equal host and path are dealt out over partitions too: any order of them will do
    spread = F.xxhash64(*pages.columns[:1], "url")
    dealt = rows.repartitionByRange(key, names[1], spread).sortWithinPartitions(key, names[1])
    swept = _swept(dealt, key, names[1], fixed, (names[2], names[3]))
    return swept.withColumn(names[3], F.coalesce(names[3], F.lit(default))).select(*pages.columns, *names)


def _joined(rows: DataFrame, names: list[str], key: str, rules: DataFrame, default: str) -> DataFrame:
    """The same by equality of host suffixes, for more rules than a task can hold."""
    base = [c for c in rows.columns if c not in (*names, key)]
    h, p, won = (fresh(rows, c) for c in ("h", "p", "best"))
    urls = rows.select(F.col(names[0]).alias("h"), F.col(names[1]).alias("p"), F.col(key).alias("k")).where("h <> ''").distinct()
    labels = F.slice(F.split("k", r"\."), 1, F.size(F.split("k", r"\.")) - 1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.reverse(F.slice(labels, 1, n)), "."))
    hits = urls.select("h", "p", F.explode(suffixes).alias("s")).join(rules, F.col("s") == rules.host).where(F.startswith("p", "path"))
    order = F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("m"), (F.col("verdict") == "block").alias("b"), F.concat("host", "path").alias("rule"), F.col("verdict").alias("v"))
    best = hits.groupBy(F.col("h").alias(h), F.col("p").alias(p)).agg(F.max(order).alias(won))
    out = rows.join(best, (F.col(names[0]) == F.col(h)) & (F.col(names[1]) == F.col(p)), "left")
    return out.select(*base, names[0], names[1], F.col(won)["rule"].alias(names[2]), F.coalesce(F.col(won)["v"], F.lit(default)).alias(names[3]))
