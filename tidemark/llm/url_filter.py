"""URL filter rules by a sort-merge range join, in DataFrame functions only.

A rule or url becomes canonical keys: a host with its labels reversed, each
closed by a dot, then the path, as UTF-8 bytes. A rule fits exactly the keys that
begin with its own, which is an interval of the key order, up to the key's
successor (its last byte raised by one); the intervals nest. A url has one key for each
suffix of its host, since a rule fits its host and all subdomains; suffixes of
more labels than any rule's host has are left out, as no rule can fit them.

The rules (a list, so as small as the driver's memory) are swept once in key
order with a stack of open rules; every interval end leaves the innermost rule
that is open from there on. Url keys and these ends are then sorted together
and each key takes the last end at or before it. Url rows are dealt evenly over
slices by their place, not by host, and every slice gets the ends: a hot host
is spread like any other, and a slice has a bounded number of rows.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import quoted

SLICE_ROWS = 50_000
DEFAULT_VERDICT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path; empty strings
    for a null or a url without ``://``."""
    parts = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, parts, i), F.lit("")) for i in (1, 2))
    return F.translate(host, ascii_uppercase, ascii_lowercase), path


def _key(host: str, path: str) -> bytes:
    return ("".join(f"{label}." for label in reversed(host.split("."))) + path).encode()


def _after(key: bytes) -> bytes:
    """The least bytes above everything that begins with ``key`` (UTF-8 holds no 0xFF)."""
    return key[:-1] + bytes([key[-1] + 1])


def interval_ends(rules: Sequence[tuple[str, str, str]]) -> list[tuple[bytes, str | None, str | None]]:
    """(key, rule, verdict) in key order: from this key on, up to the next
    one's, the innermost open rule is ``rule`` (None: no rule is open).

    ``rules`` are (verdict, host, path); of two with one host and path the
    first counts. An empty path fits every path of the host; one that does not
    begin with ``/`` fits none, so such a rule is left out.
    """
    first: dict[tuple[bytes, str], tuple[str, str]] = {}
    for verdict, host, path in rules:
        if path and not path.startswith("/"):
            continue
        host = host.translate(str.maketrans(ascii_uppercase, ascii_lowercase))
        first.setdefault((_key(host, path), host + path), (verdict, host + path))
    ends: dict[bytes, tuple[str | None, str | None]] = {}
    open_rules: list[tuple[bytes, tuple[str, str]]] = []

    def close(until: bytes | None) -> None:
        while open_rules and (until is None or not until.startswith(open_rules[-1][0])):
            key, _ = open_rules.pop()
            verdict, rule = open_rules[-1][1] if open_rules else (None, None)
            ends[_after(key)] = (rule, verdict)

    for (key, _), (verdict, rule) in sorted(first.items(), key=lambda r: r[0][0]):
        close(key)
        open_rules.append((key, (verdict, rule)))
        ends[key] = (rule, verdict)
    close(None)
    return [(k, *v) for k, v in sorted(ends.items())]


def _slices(rows: int, ends: int, slice_rows: int, tasks: int) -> int:
    """Enough slices for their size and for all tasks, but so few that the
    ends given to each stay below the rows."""
    few = -(-rows // max(slice_rows, 2 * ends))
    return max(1, few, min(tasks, rows // max(1, 2 * ends)))


def judge_urls(df: DataFrame, rules: Sequence[tuple[str, str, str]], page_id: str = "page_id",
               url: str = "url", *, default: str = DEFAULT_VERDICT,
               slice_rows: int = SLICE_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict for every row.

    The longest rule (by characters of host and path) that fits wins, of two
    equally long ones that whose text is greater; where none fits, rule is null and verdict the default. A null url, or one
    without ``://``, has an empty host and path and fits no rule. Repeated
    rows are judged each on its own; other input columns are ignored; an
    empty input gives no rows.
    """
    spark = df.sparkSession
    key, address = quoted(df, page_id, url)
    ends = interval_ends(rules)
    slices = _slices(df.count(), len(ends), slice_rows,
                     int(spark.conf.get("spark.sql.shuffle.partitions")))
    host, path = host_and_path(address)
    place = F.monotonically_increasing_id()
    pages = df.select(key.alias("page_id"), host.alias("host"), path.alias("path"),
                      place.alias("place"))
    # Neighbouring rows go to different slices; the place's high bits hold the
    # input partition, so they are added in.
    pages = pages.withColumn("slice", F.pmod(
        F.col("place") + F.shiftright("place", 33), F.lit(slices)).cast("int"))
    labels = F.reverse(F.split("host", r"\."))
    deepest = max((h.count(".") + 1 for _, h, _ in rules), default=1)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest))), lambda n: F.concat(
        F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit("."), F.col("path")).cast("binary"))
    keys = (pages.withColumn("keys", suffixes)
            .select("slice", "place", "page_id", "host", "path", F.posexplode("keys").alias("nth", "key"))
            .select("slice", "key", F.lit(1).alias("kind"),
                    F.struct("place", "page_id", "nth",
                             F.when(F.col("nth") == 0, F.struct("host", "path")).alias("url")).alias("page"),
                    F.lit(None).cast("struct<rule:string,verdict:string>").alias("open")))
    page_type = keys.schema["page"].dataType
    # The ends as one literal, so that no row of theirs passes a Python worker.
    listed = json.dumps([{"key": k.hex(), "open": {"rule": r, "verdict": v}} for k, r, v in ends])
    marks = (spark.range(1).select(F.inline(F.from_json(
        F.lit(listed), "array<struct<key:string,open:struct<rule:string,verdict:string>>>")))
             .select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"),
                     F.unhex("key").alias("key"),
                     F.lit(0).alias("kind"), F.lit(None).cast(page_type).alias("page"), "open"))
    sweep = Window.partitionBy("slice").orderBy("key", "kind")
    fits = (keys.unionByName(marks)
            .withColumn("fit", F.last("open", ignorenulls=True).over(sweep))
            .where(F.col("kind") == 1)
            .select("slice", "page.*", "fit"))
    best = F.max(F.when(F.col("fit.rule").isNotNull(), F.struct(
        F.length("fit.rule").alias("long"), F.col("fit.rule").alias("rule"),
        F.col("fit.verdict").alias("verdict"))))
    # Already dealt by slice: no further exchange.
    return (fits.groupBy("slice", "place").agg(
        F.max("page_id").alias("page_id"), F.max("url").alias("url"), best.alias("best"))
        .select("page_id", "url.host", "url.path", "best.rule",
                F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
