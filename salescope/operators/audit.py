"""Audit logs: redaction, filtered reads, and a per-day chain of keyed hashes.

A chained entry is ``log_date, seq, payload, prev_hash, hash``: ``payload`` is the
canonical JSON text (sorted keys, without ``hash``) and ``hash`` its HMAC-SHA256.
The first entry of a day follows 64 zeros.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from salescope.functions.fixed_values import GENESIS_HASH, REDACTED, SENSITIVE_KEYS
from salescope.functions.lookups import day_spine
from salescope.functions.text import contains_any
from salescope.session import ship


def _is_sensitive(key: Column) -> Column:
    return contains_any(F.lower(key), SENSITIVE_KEYS)


def redact_map(details: Column) -> Column:
    """Hide the values of sensitive keys in a flat string map."""
    return F.transform_values(details, lambda k, v: F.when(_is_sensitive(k), F.lit(REDACTED)).otherwise(v))


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^\s{}\[\]:,"]+|\s+', re.DOTALL)


def redacted_text(text: str) -> str:
    """JSON text with the values of sensitive keys hidden at any depth and all else as it stands.

    Text that is no JSON is hidden whole, as nothing tells its keys from its values.
    """
    hidden = json.dumps(REDACTED)
    try:
        json.loads(text)
    except RecursionError:
        pass  # deeper than the parser goes; the scan below needs no stack
    except ValueError:
        return REDACTED
    out: list[str] = []
    key, awaiting, depth = None, False, 0
    for token in _TOKEN.findall(text):
        if depth:  # inside a hidden object or list
            depth += (token in "{[") - (token in "}]") if len(token) == 1 else 0
            continue
        if awaiting and not token.isspace():
            awaiting = False
            out.append(hidden)
            depth = int(token in ("{", "["))
            continue
        if token == ":" and key is not None:
            name = json.loads(key, strict=False).lower()
            awaiting = any(word in name for word in SENSITIVE_KEYS)
        if not token.isspace():
            key = token if token.startswith('"') else None
        out.append(token)
    return "".join(out)


@F.pandas_udf(StringType())
def _redacted(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: None if text is None else redacted_text(text))


def redact_json(details: Column) -> Column:
    """Hide the values of sensitive keys in JSON text, at any depth, in objects and lists.

    Text without a sensitive word passes through, and an object without backslashes
    whose sensitive keys hold plain values only is rewritten in place. Only the rest goes to
    Python, in batches. Whatever holds a sensitive word and is no JSON is hidden whole.
    """
    suspect = contains_any(F.lower(details), SENSITIVE_KEYS) | F.contains(details, F.lit("\\u"))
    # Without backslashes a quoted text before a colon is a key and holds no quote.
    key = '(?i)("(?=[^"]*+"\\s*+:)[^"]*(?:' + "|".join(SENSITIVE_KEYS) + ')[^"]*+"\\s*+:\\s*+)'
    in_place = F.regexp_replace(details, key + '("[^"]*"|[-+0-9.eE]+|true|false|null)', "$1" + json.dumps(REDACTED))
    simple = (
        ~F.contains(details, F.lit("\\")) & ~details.rlike(key + r"[{\[]") & F.startswith(F.ltrim(details), F.lit("{"))
        & F.try_parse_json(details).isNotNull()
    )
    session = SparkSession.getActiveSession()
    if session is not None:
        ship(session)
    # Only the rest comes back from Python, so what is simple is asked once.
    return F.coalesce(_redacted(F.when(suspect & ~simple, details)), F.when(suspect, in_place).otherwise(details))


def query_log(
    log: DataFrame,
    user: str | None = None,
    agent: str | None = None,
    action_type: str | None = None,
    success: bool | None = None,
    start: str | None = None,
    end: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Entries matching every given filter, oldest first. Dates are inclusive days."""
    wanted = {"user": user, "agent": agent, "action_type": action_type, "success": success}
    for column, value in wanted.items():
        if value is not None:
            log = log.where(F.col(column) == value)
    if start is not None:
        log = log.where(F.col("log_date") >= F.to_date(F.lit(start)))
    if end is not None:
        log = log.where(F.col("log_date") <= F.to_date(F.lit(end)))
    ordered = log.orderBy("ts", "entry_id")
    return ordered.limit(limit) if limit else ordered


def success_rate(log: DataFrame) -> DataFrame:
    good = F.count_if("success")
    return log.agg(
        F.count("*").alias("entries"),
        F.count_if(~F.col("success")).alias("failed"),
        F.coalesce(F.round(good * 100 / F.nullif(F.count("*"), F.lit(0)), 4), F.lit(0.0)).alias("success_rate"),
    )


def daily_counts(log: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Entries on each of the last ``days`` days, quiet days as 0."""
    last = F.to_date(F.lit(as_of))
    recent = log.where((F.col("log_date") <= last) & (F.col("log_date") > F.date_sub(last, days)))
    counted = recent.groupBy(F.col("log_date").alias("day")).agg(F.count("*").alias("entries"))
    spine = day_spine(log.sparkSession, as_of, days)
    return spine.join(counted, "day", "left").select("day", F.coalesce("entries", F.lit(0)).alias("entries")).orderBy("day")


def hmac_sha256(text: Column, secret: str) -> Column:
    """HMAC-SHA256 in hex from two native hashes."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    digest = F.sha2(F.concat(inner, F.encode(text, "utf-8")), 256)
    return F.sha2(F.concat(outer, F.unhex(digest)), 256)


def build_chain(entries: DataFrame, secret: str, order: Sequence[str], day: str = "log_date") -> DataFrame:
    """Chain the JSON objects in column ``entry`` day by day, in the given order.

    Each hash depends on the one before, so a day is walked in order by one task;
    days run in parallel. Rows stream through in batches with only the last hash
    held, so a large day costs time but not memory; ``audit_tree.sharded_chain`` walks it by shards.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, seq, previous = object(), 0, GENESIS_HASH
        encode, keyed = json.JSONEncoder(sort_keys=True).encode, hmac.new(secret.encode(), digestmod=hashlib.sha256)
        for batch in batches:
            out = []
            for date, entry in zip(batch[day], batch["entry"]):
                if date != current:
                    current, seq, previous = date, 0, GENESIS_HASH
                payload = encode({**json.loads(entry), "prev_hash": previous})
                signed = keyed.copy()
                signed.update(payload.encode())
                digest = signed.hexdigest()
                out.append((date, seq, payload, previous, digest))
                seq, previous = seq + 1, digest
            yield pd.DataFrame(out, columns=[day, "seq", "payload", "prev_hash", "hash"])

    ship(entries.sparkSession)
    arranged = entries.repartition(day).sortWithinPartitions(day, *order).select(day, "entry")
    kind = entries.schema[day].dataType.simpleString()
    return arranged.mapInPandas(walk, f"{day} {kind}, seq long, payload string, prev_hash string, hash string")


@F.pandas_udf(StringType())
def _canonical_payload(lines: pd.Series) -> pd.Series:
    def canonical(line: str) -> str | None:
        try:
            entry = json.loads(line)
            entry.pop("hash", None)
            return json.dumps(entry, sort_keys=True)
        except (ValueError, TypeError, AttributeError):
            return None

    return lines.map(canonical)


def chain_from_lines(lines: DataFrame, day: str = "log_date") -> DataFrame:
    """Chained entries from raw log lines (``log_date, seq, line``) written elsewhere."""
    return lines.select(
        day,
        "seq",
        _canonical_payload("line").alias("payload"),
        F.get_json_object("line", "$.prev_hash").alias("prev_hash"),
        F.get_json_object("line", "$.hash").alias("hash"),
    )


def check_entries(chain: DataFrame, secret: str, day: str = "log_date") -> DataFrame:
    """Per entry: does it follow its predecessor, and does its hash recompute?

    The predecessor is joined on (day, seq), which spreads a large day over tasks. Payloads are judged
    before, so that only hashes are shuffled and sorted.
    """
    following = chain.select(day, (F.col("seq") + 1).alias("seq"), F.col("hash").alias("_expected"))
    expected = F.when(F.col("seq") == 0, F.lit(GENESIS_HASH)).otherwise(F.col("_expected"))
    judged = chain.select(
        day,
        "seq",
        "prev_hash",
        (F.get_json_object("payload", "$.prev_hash") == F.col("prev_hash")).alias("_recorded"),
        F.coalesce(hmac_sha256(F.col("payload"), secret) == F.col("hash"), F.lit(False)).alias("genuine"),
    )
    return judged.join(following, [day, "seq"], "left").select(
        day,
        "seq",
        F.coalesce((F.col("prev_hash") == expected) & F.col("_recorded"), F.lit(False)).alias("linked"),
        "genuine",
    )


def verify_chains(chain: DataFrame, secret: str, day: str = "log_date") -> DataFrame:
    """Per day: entries, whether the chain is intact, and the first broken position."""
    ok = F.col("linked") & F.col("genuine")
    return (
        check_entries(chain, secret, day)
        .groupBy(day)
        .agg(F.count("*").alias("entries"), F.bool_and(ok).alias("intact"), F.min(F.when(~ok, F.col("seq"))).alias("first_broken"))
    )


def verify_recent(chain: DataFrame, secret: str, as_of: str, days: int = 30) -> DataFrame:
    """Integrity of each of the last ``days`` days; a day without entries is intact."""
    last = F.to_date(F.lit(as_of))
    recent = chain.where((F.col("log_date") <= last) & (F.col("log_date") > F.date_sub(last, days)))
    checked = verify_chains(recent, secret).withColumnRenamed("log_date", "day")
    return day_spine(chain.sparkSession, as_of, days).join(checked, "day", "left").select(
        "day", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("intact", F.lit(True)).alias("intact")
    )
