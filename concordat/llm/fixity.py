"""Merkle fixity audit of two replicas of a web archive.

Records are laid out in files, each record at a byte offset that the first replica's manifest fixes. A
record's leaf is the SHA-256 of its bytes; the leaves of an offset range, in offset order, are
hashed into the range's node, and ``fanout`` nodes at a time into their parent, up to one root. The
audit compares the roots and goes down only into branches whose hashes differ, until it holds the
damaged ranges; records are compared in those alone.

Files get records by the hash of the record, and an offset range holds a bounded number of bytes, so
neither a hot host nor repeated rows make a large group; records that the manifest does not know share
ranges of some hundred. Both replicas go through the same aggregations, told apart by a mark. All
hashing is done by Spark functions.

Defined results: null URLs and null pages are empty ones, null ids sort last and match each other;
rows that repeat in id, URL and content are one record with a number of copies; different contents
under one id and URL are versions, numbered in the order of their hashes; empty replicas agree; a
record that only the second replica has is reported as ``extra`` with no offset.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.llm.common import Scratch
from concordat.operators.keys import binary_order


@dataclass(frozen=True)
class FixityConfig:
    records_per_file: int = 20_000
    range_bytes: int = 1 << 18
    fanout: int = 16
    strays: int = 256


KEY = ["id", "url", "version"]


def warc_record(url: Column, html: Column) -> Column:
    """A response record as it lies in a WARC file, as bytes."""
    body = F.encode(html, "UTF-8")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, version, digest, length, copies)`` of a replica. Versions are counted from places in one
    order of all records, so that any number of them under one id and URL is dealt over many tasks."""
    scratch = Scratch(pages.sparkSession, "records")
    url, html = F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(html_col), F.lit(""))
    raw = pages.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), warc_record(url, html).alias("raw"))
    each = raw.select("id", "url", F.sha2("raw", 256).alias("digest"), F.octet_length("raw").cast("long").alias("length"))
    one = each.groupBy("id", "url", "digest", "length").agg(F.count("*").alias("copies"))
    placed = scratch.write(binary_order(one, F.struct("id", "url", "digest"), "place"), "placed")
    several = placed.groupBy("id", "url").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").select("id", "url", "first")
    several = scratch.write(several, "several")
    version = F.coalesce(F.col("place") - F.col("first") + 1, F.lit(1)).cast("int")
    return _same(placed, several, ["id", "url"], "left").select("id", "url", version.alias("version"), "digest", "length", "copies")


def _drawn(files: int) -> Column:
    """A file for a record, from the leading bits of its hash."""
    return F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.lit(files))


def manifest(reference: DataFrame, config: FixityConfig) -> DataFrame:
    """The first replica's records with their places: ``file``, ``offset`` and ``span``, the offset range."""
    n = reference.count()
    files = max(1, math.ceil(n / config.records_per_file))
    placed = reference.withColumn("file", _drawn(files))
    order = Window.partitionBy("file").orderBy(F.col("id").asc_nulls_last(), "url", "version")
    placed = placed.withColumn("offset", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length"))
    return placed.withColumn("span", F.floor(F.col("offset") / config.range_bytes).cast("long"))


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys that may be null; the keys of both sides stay, the right one's with a mark."""
    right = b.withColumnsRenamed({k: f"r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys]
    return a.join(right, on, how)


def _joined_hash(parts: Column, between: str) -> Column:
    return F.sha2(F.array_join(parts, between), 256).alias("hash")


def _ranges(leaves: DataFrame) -> DataFrame:
    """``(node, side, hash)`` of the offset ranges of both replicas."""
    kids = F.array_sort(F.collect_list(F.struct("offset", "digest", "copies")))
    return leaves.groupBy("node", "side").agg(_joined_hash(F.transform(kids, lambda k: F.concat(k["digest"], F.lit(":"), k["copies"].cast("string"))), ";"))


def _parents(nodes: DataFrame, config: FixityConfig) -> DataFrame:
    kids = F.array_sort(F.collect_list(F.struct("node", "hash")))
    return nodes.groupBy(F.expr(f"node div {config.fanout}").alias("node"), "side").agg(_joined_hash(F.transform(kids, lambda k: k["hash"]), ""))


def _differing(nodes: DataFrame) -> DataFrame:
    """The nodes that the replicas do not have alike."""
    first, second = (F.max(F.when(F.col("side") == k, F.col("hash"))) for k in (0, 1))
    return nodes.groupBy("node").agg(first.alias("a"), second.alias("b")).filter(~F.col("a").eqNullSafe(F.col("b"))).select("node")


def audit(reference: DataFrame, replica: DataFrame, config: FixityConfig = FixityConfig(), **columns: str) -> DataFrame:
    """One row per damaged record: id, URL, version, file, offset and length of its place, ``kind``
    (``changed``, ``missing``, ``extra``) and both hashes. Equal replicas give no row."""
    scratch = Scratch(reference.sparkSession, "fixity")
    placed = scratch.write(manifest(scratch.write(records(reference, **columns), "reference"), config), "manifest")
    ends = placed.agg(F.max("span").alias("span"), F.max("file").alias("file")).first()
    spans = (ends.span or 0) + 1
    ranges = spans * ((ends.file or 0) + 1)
    node = F.col("file") * spans + F.col("span")
    left = placed.select(*KEY, node.alias("node"), "file", "offset", "length", "digest", "copies")
    found = scratch.write(_same(records(replica, **columns).drop("length"), placed.select(*KEY, "file", "span", "offset"), KEY, "left"), "found")
    # Records without a place share ranges of their own behind all others, some hundred of them in each.
    groups = max(1, math.ceil(found.filter("file is null").count() / config.strays))
    stray = ranges + _drawn(groups)
    right = found.select(*KEY, F.coalesce(node, stray).alias("node"), F.coalesce("offset", F.lit(-1)).alias("offset"), "digest", "copies")

    leaf = ["node", "offset", "digest", "copies"]
    both = left.select(*leaf, F.lit(0).alias("side")).unionByName(right.select(*leaf, F.lit(1).alias("side")))
    levels = [scratch.write(_ranges(both), "level-0")]
    most = ranges + groups - 1
    while most > 0:
        most //= config.fanout
        levels.append(scratch.write(_parents(levels[-1], config), f"level-{len(levels)}"))

    differing = scratch.write(_differing(levels[-1]), "differing")
    if differing.isEmpty():  # equal roots
        levels = levels[-1:]
    for level in reversed(levels[:-1]):
        above = differing.select(F.col("node").alias("parent"))
        differing = _differing(level.withColumn("parent", F.expr(f"node div {config.fanout}")).join(above, "parent", "left_semi"))
    differing = scratch.write(differing, "damaged")

    mine = left.join(differing, "node", "left_semi").drop("node")
    theirs = right.join(differing, "node", "left_semi").select(*KEY, F.col("digest").alias("found"), F.col("copies").alias("found_copies"))
    both = _same(mine, theirs, KEY, "full_outer").filter(~(F.col("digest").eqNullSafe(F.col("found")) & F.col("copies").eqNullSafe(F.col("found_copies"))))
    kind = F.when(F.col("found").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("changed")
    keys = [F.when(F.col("digest").isNull(), F.col(f"r_{k}")).otherwise(F.col(k)).alias(k) for k in KEY]
    return both.select(*keys, "file", "offset", "length", kind.alias("kind"), F.col("digest").alias("expected"), "found")
