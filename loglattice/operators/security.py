"""Access decisions and configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def acl_allows(acls: DataFrame, requests: DataFrame) -> DataFrame:
    """Exact, * and prefix entries; a deny wins; no match is null."""
    a, r = acls.alias("a"), requests.alias("r")
    name = (F.col("a.rname") == "*") | (F.col("a.rname") == F.col("r.rname")) | (F.col("a.is_prefix") & F.col("r.rname").startswith(F.col("a.rname")))
    hit = (F.col("a.principal") == F.col("r.principal")) & (F.col("a.rtype") == F.col("r.rtype")) & F.col("a.op").isin("*", F.col("r.op")) & name
    joined = r.join(a, hit, "left").groupBy("r.id", "r.principal", "r.rtype", "r.rname", "r.op")
    deny, allow = F.bool_or(~F.col("a.allow")), F.bool_or("a.allow")
    return joined.agg(F.when(deny, False).when(allow, True).alias("allowed"))


def acl_authorize(decisions: DataFrame, super_users: list[str], enabled: bool = True) -> DataFrame:
    passed = F.lit(not enabled) | F.col("principal").isin(super_users) | F.coalesce("allowed", F.lit(False))
    return decisions.withColumn("authorized", passed)


# fixed values of the topic configuration: key -> (least, most, whether -1 switches it off); least and most of integers
MIN_ISR, MESSAGE, SEGMENT = "min.insync.replicas", "max.message.bytes", "segment.bytes"
MOST_MESSAGE, LEAST_SEGMENT, MOST_SEGMENT = 8 << 20, 1024, 1 << 30
OFF_OR_POSITIVE = ("retention.ms", "retention.bytes", "flush.messages", "flush.ms")
CONFIG_KEYS = (MIN_ISR, MESSAGE, *OFF_OR_POSITIVE, SEGMENT)


def _parsed(raw, key: str):
    """The trimmed value as an integer of the key's width, else null."""
    digits = F.regexp_extract(F.regexp_replace(raw, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"^[+-]?[0-9]+$", 0)
    return F.when(digits != "", digits.try_cast("int" if key in (MIN_ISR, MESSAGE) else "long").cast("long"))


def effective_config(topics: DataFrame, key: str, default: int) -> DataFrame:
    """topics(config, rf, ...) with ``value``, what the topic goes by: its own integer, else the cluster's default.

    The least number of in-sync replicas and the message size are at least 1, the former's default at most the replication
    factor; segments are never under their floor; retention and flush limits stand as they are.
    """
    own, value = _parsed(F.col("config")[key], key), F.lit(default).cast("long")
    if key == MIN_ISR:
        value = F.coalesce(F.greatest(own, F.when(own.isNotNull(), 1)), F.greatest(F.lit(1), F.least(value, F.col("rf"))))
    elif key == MESSAGE:
        value = F.coalesce(F.greatest(own, F.when(own.isNotNull(), 1)), value)
    elif key == SEGMENT:
        value = F.greatest(F.lit(LEAST_SEGMENT), F.coalesce(own, value))
    else:
        value = F.coalesce(own, value)
    return topics.withColumn("value", value.cast("long"))


def validate_config(settings: DataFrame) -> DataFrame:
    """settings(key, raw, rf, ...) with ``verdict``: ok, not_integer, too_small, too_large; unknown keys and null are ok."""
    verdict = F.lit("ok")
    for key in CONFIG_KEYS:
        value = _parsed(F.col("raw"), key)
        if key in OFF_OR_POSITIVE:
            small, large = (value != -1) & (value < 1), F.lit(False)
        else:
            small = value < (LEAST_SEGMENT if key == SEGMENT else 1)
            large = value > (F.col("rf") if key == MIN_ISR else MOST_MESSAGE if key == MESSAGE else MOST_SEGMENT)
        own = F.when(value.isNull(), "not_integer").when(small, "too_small").when(large, "too_large").otherwise("ok")
        verdict = F.when((F.col("key") == key) & F.col("raw").isNotNull(), own).otherwise(verdict)
    return settings.withColumn("verdict", verdict)


def duration_seconds(text):
    """30s, 5m or 1h; anything else is five minutes."""
    n, unit = F.regexp_extract(text, r"^([0-9]+)([smh])$", 1), F.regexp_extract(text, r"^([0-9]+)([smh])$", 2)
    factor = F.when(unit == "s", 1).when(unit == "m", 60).otherwise(3600)
    return F.when(n == "", F.lit(300).cast("long")).otherwise(n.try_cast("long") * factor)


def host_port(text):
    """struct(host, port) named hp of host:port, split at the last colon; a port that is no number is null."""
    return F.struct(F.regexp_extract(text, r"^(.*):[^:]*$", 1).alias("host"), F.substring_index(text, ":", -1).try_cast("long").alias("port")).alias("hp")


def merged_config(defaults: str, own: str):
    """key=value pairs of two maps in the order of their keys, ``own`` going before ``defaults``."""
    both = F.map_zip_with(defaults, own, lambda k, a, b: F.coalesce(b, a))
    return F.array_join(F.transform(F.array_sort(F.map_entries(both)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
