"""URL allow and block rules by a sort-merge range join, in DataFrame functions alone.

A host's labels in reverse, each followed by a dot, make a host and all its subdomains one range of keys: those
that start with the rule's key. Ranges of prefixes nest or are apart, so a sweep in key order needs only a stack
of the open ones. What the stack holds after each start or end of a range is known from the rules alone; the
sweep merges these events with the urls' keys and gives each url the state of the last event before it. A first
sweep finds the rule hosts around each url, a second, over (rule host, path), the path rules.

The sweep runs in groups of bounded size: key ranges (from a sample of the keys, for layout only), each dealt
over several groups where it is large, with the range's events in all of them and the open rules at its start; there are
no more copies of the events than there are shuffle partitions. Very common urls get their answer by broadcast.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule; of rules with
equal host and path a block wins; rules with a null or empty host are ignored, a null path counts as empty; of
rules of equal length that with the longer host wins; repeated urls and ids are kept as they stand; an empty table gives
an empty result; further columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.shared import checkpointed, joined_by_key

#: Urls of a sweep's group, about; key ranges at most; keys of the sample, about.
GROUP_ROWS, MOST_RANGES, SAMPLE = 20_000, 64, 20_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def _host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _stacks(keys: DataFrame, prefixes: DataFrame) -> DataFrame:
    """For each distinct ``key`` the prefixes it starts with, as structs, shortest first; ``key`` is from few rows."""
    parts = keys.select("key").distinct().where("key <> ''")
    parts = parts.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.substring("key", F.lit(1), i))))
    return parts.join(prefixes, "prefix").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("prefix", "verdict"))).alias("stack"))


def _range_of(key: Column, bounds: list[str]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= key)) if bounds else F.lit(0)


def sweep(points: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``points`` with ``stack``: the prefixes (with verdicts) their ``key`` starts with, shortest first.

    ``points`` is read several times, so it should be a table or a checkpoint; ``prefixes`` has distinct
    ``prefix``, none empty, and ``verdict``.
    """
    rows = points.count()
    ranges = max(1, min(MOST_RANGES, rows // GROUP_ROWS))
    partitions = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = max(1, min(-(-rows // (ranges * GROUP_ROWS)), -(-partitions // ranges)))  # more groups than tasks would gain nothing
    sample = sorted(r.key for r in points.select("key").sample(min(1.0, SAMPLE / max(1, rows)), 7).collect()) if ranges > 1 else []
    bounds = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)} - {""}) if sample else []

    stacks = _stacks(prefixes.select(F.col("prefix").alias("key")), prefixes)
    opened = stacks.select("key", F.encode("key", "utf-8").alias("at"), F.lit(1).alias("kind"), "stack")
    closed = stacks.select("key", F.concat(F.encode("key", "utf-8"), F.lit(b"\xff")).alias("at"), F.lit(1).alias("kind"), F.expr("slice(stack, 1, size(stack) - 1)").alias("stack"))
    events = opened.union(closed).withColumn("range", _range_of(F.col("at"), [b.encode() for b in bounds]))
    if bounds:  # the rules that are open where a range begins
        spark = points.sparkSession
        starts = spark.createDataFrame([(b, i + 1) for i, b in enumerate(bounds)], "key string, range int")
        carried = starts.join(_stacks(starts, prefixes), "key").select("key", F.encode("key", "utf-8").alias("at"), F.lit(0).alias("kind"), "stack", "range")
        events = events.union(carried)
    events = events.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    named = [c for c in points.columns if c != "key"]
    dealt = points.select(
        "key", F.encode("key", "utf-8").alias("at"), F.lit(2).alias("kind"), _range_of(F.col("key"), bounds).alias("range"),
        F.pmod(F.xxhash64("key"), F.lit(copies)).cast("int").alias("copy"), F.struct(*named).alias("point"),
    )
    order = Window.partitionBy("range", "copy").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.unionByName(events, allowMissingColumns=True).withColumn("open", F.last("stack", ignorenulls=True).over(order))
    return swept.where("kind = 2").select("point.*", "key", F.coalesce("open", F.array().cast("array<struct<prefix:string,verdict:string>>")).alias("stack"))


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id", default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: the id, ``host``, ``path``, ``rule`` (host and path; null if none fits), ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict``. A rule fits its host and all subdomains if the url's path
    starts with the rule's; the longest that fits decides.
    """
    host, path = host_and_path(F.col(url))
    pages = pages.select(F.col(key).alias("id"), host.alias("host"), path.alias("path"))
    rules = checkpointed(
        rules.where("host <> ''").groupBy("host", F.coalesce("path", F.lit("")).alias("path")).agg(F.max("verdict").alias("verdict"))
        .select(_host_key(F.col("host")).alias("host_key"), "path", "verdict")
    )
    zero = F.lit("\x00")
    urls = checkpointed(pages.groupBy("host", "path").agg(F.count("*").alias("n")).withColumn("key", F.concat(_host_key(F.col("host")), zero, "path")))
    hosts = rules.select(F.col("host_key").alias("prefix"), F.lit(None).cast("string").alias("verdict")).distinct()
    around = sweep(urls.drop("n"), hosts).select("host", "path", F.explode("stack").alias("rule")).select("host", "path", F.concat("rule.prefix", zero, "path").alias("key"))
    paths = rules.select(F.concat("host_key", zero, "path").alias("prefix"), "verdict")
    inner = sweep(checkpointed(around), paths).where("size(stack) > 0").select("host", "path", F.element_at("stack", -1).alias("rule"))
    parts = F.split("rule.prefix", zero, 2)
    rule_host = F.array_join(F.reverse(F.split(F.expr("substring(rule_key, 1, length(rule_key) - 1)"), r"\.")), ".")
    best = (
        inner.withColumns({"rule_key": parts[0], "rule_path": parts[1]})
        .withColumn("rule_host", rule_host)
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length(F.concat("rule_host", "rule_path")), F.length("rule_host"), F.concat("rule_host", "rule_path").alias("rule"), "rule.verdict")).alias("best"))
    )
    answers = checkpointed(urls.drop("key").join(best, ["host", "path"], "left"))
    total = answers.agg(F.sum("n")).first()[0] or 0
    return joined_by_key(pages, answers, ["host", "path"], total).select(
        F.col("id").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
