"""URL filters as a sort-merge range join.

A host is written backwards, label by label, each label ended by a dot; the hosts
that a rule covers are then exactly the keys that begin with the rule's key, one
interval. URLs and rules are sorted together by key in range partitions, and a
sweep keeps a stack of the rules whose interval holds the current key: intervals
of prefixes nest or are apart. Of the rules on the stack the longest whose path
begins the URL's path decides. A partition is opened with the rules whose
interval began in an earlier one.
"""
from __future__ import annotations

import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cytogrid.llm.common import durable, join_small


def host_of(url: str) -> Column:
    rest = F.substring(F.col(url), F.instr(F.col(url), "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.when(F.instr(F.col(url), "://") > 0, F.translate(host, string.ascii_uppercase, string.ascii_lowercase)).otherwise("")


def path_of(url: str) -> Column:
    rest = F.substring(F.col(url), F.instr(F.col(url), "://") + 3, F.length(url))
    return F.when(F.instr(F.col(url), "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def host_key(host: str) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(F.col(host), r"\.")), "."), F.lit("."))


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every URL.

    ``rules`` has host, path (begins with / or is empty) and action. The longest
    rule wins, host and path counted together; of equally long ones that with the
    longer host. Where no rule fits, rule is null and the verdict is ``default``;
    so for null URLs and those without ``://``, whose host and path are empty.
    """
    urls = (pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url")).withColumns({"host": host_of("url"), "path": path_of("url")})
            .withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
            .select(host_key("host").alias("key"), F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("action")))
    marks = rules.select(host_key("host").alias("key"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), "host", "path", "action").distinct()
    order = ["key", "kind", F.xxhash64("page_id", "path")]
    blocks = durable(urls.withColumn("page_id", F.col("page_id").cast("long")).union(marks).repartitionByRange(*order).withColumn("block", F.spark_partition_id()))
    # the rules open at a block's first key are those of its own leading labels; one row for each block and label
    labels = F.split(F.expr("substring(first, 1, length(first) - 1)"), r"\.")
    opened = (blocks.groupBy("block").agg(F.min("key").alias("first")).withColumn("labels", labels)
              .select("block", F.explode(F.expr("transform(sequence(1, size(labels)), n -> concat(array_join(slice(labels, 1, n), '.'), '.'))")).alias("key")))
    carried = join_small(opened, marks, ["key"], "inner").select(*marks.columns, "block")

    def sweep(batches):
        block, stack = None, []  # stack: (key, host, {path: action})
        for batch in batches:
            ids, hosts, paths, found, verdicts = [], [], [], [], []
            for row in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)]):
                key, kind, page, host, path, action, at = row
                if at != block:
                    block, stack = at, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, host, {}))
                    stack[-1][2][path] = action
                    continue
                best = None
                for _, rule_host, of_path in reversed(stack):
                    longest = max((p for p in of_path if path.startswith(p)), key=len, default=None) if len(of_path) < 16 else next(
                        (path[:n] for n in range(len(path), -1, -1) if path[:n] in of_path), None)
                    if longest is not None and (best is None or len(rule_host) + len(longest) > len(best[0])):
                        best = rule_host + longest, of_path[longest]
                ids.append(page), hosts.append(host), paths.append(path), found.append(best and best[0]), verdicts.append(best[1] if best else default)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())] + [pa.array(x, pa.string()) for x in (hosts, paths, found, verdicts)],
                                             names=["page_id", "host", "path", "rule", "verdict"])

    swept = blocks.union(carried).repartition("block").sortWithinPartitions("block", "key", "kind")
    return swept.mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")
