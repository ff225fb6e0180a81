"""Secret scans with corpus-wide ownership frequency.

Three kinds of base match are always reported: assignments of passwords and keys, access key ids, and runs of hex
digits. Their values, and other long mixed strings, are candidates: their hashes are counted over the distinct
documents (repositories) and sources (owners) of the whole corpus. A value that several owners have is a widely copied
example, and so is one that a single owner has in MANY documents or more, such as a placeholder of its template; one
that a single owner has in fewer documents looks live. The scan adds the spans of live-looking mixed strings (kind `owned`)
that no base span covers; widely copied ones are counted, not added.

Defined results: null and empty texts have no spans; spans count code points; equal values of one document count once
for its owner; a null source is an owner of its own; repeated rows are reported each and count as one document, rows
without doc_id as one each; texts of any length are scanned whole; an empty table gives an empty result; only doc_id,
text and source are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import texts, written

#: The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIXED = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "owned")

assign, access, hexes, mixed = re.compile(ASSIGN, re.ASCII | re.IGNORECASE), re.compile(ACCESS), re.compile(HEX), re.compile(MIXED)
LEAST_ENTROPY = 3.5
#: A value in so many documents of its only owner counts as widely copied.
MANY = 10
#: Values of at least one in so many candidates are frequent ones.
HOT = 5000


def entropy(value: str) -> float:
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values())


def is_mixed(value: str) -> bool:
    """Digits, capitals and small letters together, too uneven for a word."""
    return any(c.isdigit() for c in value) and value != value.lower() and value != value.upper() and entropy(value) >= LEAST_ENTROPY


def found_in(text: str) -> list[tuple[int, int, int, str]]:
    """(start, place of the kind in KINDS, end, value) of base matches and of mixed strings that none of them touches, by start."""
    # A run of digits or letters that is long enough is found whole from its first character, so {16,} and {14,} keep
    # what the open patterns match; an assignment with a short value uses up its characters all the same.
    out = [(m.start(), 0, m.end(), m[2]) for m in assign.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), m[0]) for m in access.finditer(text)] if "AKIA" in text else []
    out += [(m.start(), 2, m.end(), m[0]) for m in hexes.finditer(text)]
    base, at = sorted((a, b) for a, _, b, _ in out), 0
    furthest = 0  # end of the base spans that begin before the end of the mixed string
    for m in mixed.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            furthest = max(furthest, base[at][1])
            at += 1
        if furthest <= m.start() and is_mixed(m[0]):
            out.append((m.start(), 3, m.end(), m[0]))
    return sorted(out)


def scanned(docs: DataFrame) -> DataFrame:
    """row, doc_id, source, base counts and digest, and found: array of (start, kind, end, hash of the value) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [found_in(t) for t in batch.column("text").to_pylist()]
            base = [[x for x in spans if x[1] < 3] for spans in found]
            count = lambda k: pa.array([sum(x[1] == k for x in spans) for spans in base], pa.int64())
            joined = [",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans) for spans in base]
            spans = [[{"start": a, "kind": k, "end": b, "hash": int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little", signed=True)} for a, k, b, v in x] for x in found]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("hash", pa.int64())]))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "source": batch.column("source"), "n_assign": count(0), "n_access": count(1), "n_hex": count(2), "base_sha256": pa.array([hashlib.sha256(j.encode()).hexdigest() for j in joined], pa.string()), "found": pa.array(spans, kind)}
            )

    schema = "doc_id long, source string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start: long, kind: int, end: long, hash: long>>"
    return texts(docs, docs["source"].cast("string").alias("source")).mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def ownership(candidates: DataFrame) -> DataFrame:
    """hash, repositories (documents), owners (sources) of each candidate value. candidates: row, doc_id, source, hash."""
    alone = F.when(F.col("doc_id").isNull(), F.col("row")).alias("alone")
    by_document = candidates.groupBy("hash", "doc_id", alone).agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("repositories"))
    by_owner = candidates.groupBy("hash", "source").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("owners"))
    return by_document.join(by_owner, "hash")


def with_ownership(each: DataFrame) -> DataFrame:
    """each (row, doc_id, source, hash) with the repositories and owners of its value.

    Values that stand in a share of 1 / HOT of all candidates or more are at most HOT, so they are sent to all tasks and
    their rows aren't shuffled; the rest is joined by value, and no value has a large part of it.
    """
    counted = written(ownership(each), "ownership")
    n = each.count()
    hot = F.broadcast(counted.where(F.col("repositories") * HOT >= n))
    cold = each.join(hot.select("hash"), "hash", "left_anti").join(counted, "hash")
    return each.join(hot, "hash").unionByName(cold)


def secrets(docs: DataFrame, many: int = MANY) -> DataFrame:
    """doc_id, base counts and digest, spans (all, joined), and how many spans are owner-specific or widely copied.

    Then repositories and owners: those of each candidate by start, joined, also of mixed strings that aren't added.
    """
    rows = written(scanned(docs), "secrets")
    each = rows.select("row", "doc_id", "source", F.explode("found").alias("s")).select("row", "doc_id", "source", "s.*")
    told = with_ownership(each).withColumn("live", (F.col("owners") == 1) & (F.col("repositories") < many))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    span = F.struct("start", "kind", "end", F.concat_ws(":", name, "start", "end").alias("said"))
    counts = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "kind", "end", c))), lambda x: x[c]), ",").alias(c)
    per_row = told.groupBy("row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") < 3) | F.col("live"), span))), lambda x: x["said"]), ",").alias("spans"),
        F.count_if("live").alias("n_owner_specific"),
        F.count_if(~F.col("live")).alias("n_widely_copied"),
        counts("repositories"),
        counts("owners"),
    )
    return rows.drop("found").join(per_row, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_owner_specific", F.lit(0)).alias("n_owner_specific"), F.coalesce("n_widely_copied", F.lit(0)).alias("n_widely_copied"),
        F.coalesce("repositories", F.lit("")).alias("repositories"), F.coalesce("owners", F.lit("")).alias("owners"),
    )
