"""Secret scan with corpus-wide ownership frequency.

1. **Candidates.** Each whole text is matched by three patterns, leftmost
   and without overlaps per kind: ``assign`` (a keyword, ``:`` or ``=`` and a
   value of 12 or more characters), ``access`` (``AKIA...``, 18 or more) and
   ``hex`` (16 or more). A span is the whole match, in code points, end exclusive. What
   none of these covers is searched for bare tokens: runs of value characters
   from a letter or digit to a letter or digit, 12 or more, with a letter and a digit.
2. **Ownership.** A candidate's value (without the punctuation at its ends) is
   hashed to 128 bits and counted over the corpus by distinct repositories and
   distinct owners, as three nested aggregations: (value, owner, repository), then
   (value, owner), then value. A value that a third of all rows hold is one
   row per task after the first partial step.
3. **Verdict.** ``example``: held by ``EXAMPLE_OWNERS`` owners or more, so copied
   widely. ``live``: fewer owners, and it looks random (a digit, ``MIN_DISTINCT`` distinct
   characters). ``weak``: the rest.
4. **Added spans.** ``reused``: a bare token equal to the live value of an
   ``assign`` or ``access`` match anywhere in the corpus. ``owned``: a bare token of
   20 or more characters, with lower case, upper case and digits, that is live, has one
   owner and stands in two repositories or more: a credential reused in its owner's files.

The corpus has no repository column: a document id stands for the repository and
``source`` for the owner (both are parameters).

Bounds: a task holds a batch's texts; after the scan only candidates (128-bit values
and positions) are shuffled. AQE splits a hot value in the join of its verdict. What is
grouped per document is bounded by its own text.

Edge cases: NULL and empty texts have no spans; a NULL owner is an owner, a NULL id a
repository; repeated rows are separate documents of one repository; equal starts go by kind in
the order ``assign, access, hex, reused, owned``, then by end; an empty table gives no rows;
other columns are not read. A lone surrogate counts as one code point.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelens.llm.common import importable, lean, written

KINDS = ("assign", "access", "hex", "reused", "owned")
BARE = 3  # a bare token before its verdict
EXAMPLE_OWNERS = 3
MIN_DISTINCT = 8
OWNED_CHARS = 20

# The patterns and least lengths of the base kinds.
ASSIGN = rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS, BARE_CHARS = 12, 18, 16, 12

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE)  # of bytes: ASCII letters only
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
# A run is one greedy match: with its least length in the pattern the long ones are the same.
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{%d,}" % (ACCESS_CHARS - 4))
_HEX = re.compile(rb"[0-9a-f]{%d,}" % HEX_CHARS)
_BARE = re.compile(rb"[A-Za-z0-9][A-Za-z0-9+/_.=-]{%d,}[A-Za-z0-9]" % (BARE_CHARS - 2))
_ENDS = b"+/_.=-"
_LETTER, _DIGIT, _LOWER, _UPPER = (re.compile(p) for p in (rb"[A-Za-z]", rb"[0-9]", rb"[a-z]", rb"[A-Z]"))


def candidates(text: bytes) -> list[tuple[int, int, int, bytes]]:
    """``kind, start, end, value`` in bytes: base matches, then bare tokens beside them."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(0, *m.span(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if b"AKIA" in text:
        found += [(1, *m.span(), m[0]) for m in _ACCESS.finditer(text)]
    found += [(2, *m.span(), m[0]) for m in _HEX.finditer(text)]
    taken = sorted((a, b) for _, a, b, _ in found)
    k, upto = 0, 0
    for m in _BARE.finditer(text):
        a, b = m.span()
        while k < len(taken) and taken[k][0] < b:
            upto = max(upto, taken[k][1])
            k += 1
        if upto <= a and _DIGIT.search(m[0]) and _LETTER.search(m[0]):
            found.append((BARE, a, b, m[0]))
    return found


def looks(value: bytes) -> int:
    """1: random enough to be a credential; 2: of mixed case and long besides."""
    random = bool(_DIGIT.search(value)) and len(set(value)) >= MIN_DISTINCT
    mixed = random and len(value) >= OWNED_CHARS and bool(_LOWER.search(value)) and bool(_UPPER.search(value))
    return random + mixed


def code_points(text: bytes, found: list[tuple[int, int, int, bytes]]) -> dict[int, int]:
    """Code points before each byte position that the candidates name."""
    places = sorted({p for _, a, b, _ in found for p in (a, b)})
    if text.isascii():
        return {p: p for p in places}
    at, last, out = 0, 0, {}
    for p in places:
        at += len(text[last:p].decode("utf-8", "surrogatepass"))
        last = p
        out[p] = at
    return out


_FOUND = "array<struct<kind:int,start:int,end:int,value:binary,looks:int>>"
_FOUND_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
                                  ("value", pa.binary()), ("looks", pa.int32())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        found = []
        for x in batch.column(2):
            text = (x.as_py() or "").encode("utf-8", "surrogatepass")
            hits = candidates(text)
            place = code_points(text, hits)
            found.append([{"kind": k, "start": place[a], "end": place[b], "looks": looks(v.strip(_ENDS)),
                           "value": xxhash.xxh3_128_digest(v.strip(_ENDS))} for k, a, b, v in hits])
        size = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(row, row + size), pa.int64()), batch.column(0), batch.column(1), pa.array(found, _FOUND_TYPE)],
            names=["row", "doc_id", "owner", "found"])
        row += size


def ownership(found: DataFrame) -> DataFrame:
    """``value, n_owners, n_repositories, named, looks, verdict`` of every candidate value."""
    per_file = found.groupBy("value", "owner", "repository").agg(
        F.max(F.col("kind") < 2).alias("named"), F.max("looks").alias("looks"))
    per_owner = per_file.groupBy("value", "owner").agg(
        F.count("*").alias("n"), F.max("named").alias("named"), F.max("looks").alias("looks"))
    per_value = per_owner.groupBy("value").agg(
        F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"), F.max("named").alias("named"),
        F.max("looks").alias("looks"))
    verdict = F.when(F.col("n_owners") >= EXAMPLE_OWNERS, "example").when(F.col("looks") > 0, "live").otherwise("weak")
    return per_value.withColumn("verdict", verdict)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
         repository_col: str | None = None) -> DataFrame:
    """One row per document: counts of the base kinds, their digest, all spans, counts by verdict."""
    importable(docs.sparkSession)
    repository = F.col(repository_col or id_col).cast("string")
    src = docs.select(F.struct(F.col(id_col).alias("id"), repository.alias("repository")).alias("doc_id"),
                      F.col(owner_col).cast("string").alias("owner"), F.col(text_col).alias("t"))
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = written(src.mapInArrow(
        lean(_scan), f"row long, doc_id struct<id:{id_type},repository:string>, owner string, found {_FOUND}"), "secret-candidates")
    found = rows.where(F.size("found") > 0).select(
        "row", F.col("doc_id.repository").alias("repository"), "owner", F.inline("found"))
    of_value = written(ownership(found), "secret-ownership")
    # kind 3 becomes reused or owned, or goes
    is_live = F.col("verdict") == "live"
    added = F.when(is_live & F.col("named"), F.lit(3)).when(
        is_live & (F.col("of_looks") > 1) & (F.col("n_owners") == 1) & (F.col("n_repositories") > 1), F.lit(4))
    kind = F.when(F.col("kind") < BARE, F.col("kind")).otherwise(added)
    judged = (found.join(of_value.withColumnRenamed("looks", "of_looks"), "value")
              .select("row", F.struct("start", kind.alias("kind"), "end", "verdict").alias("s"))
              .where(F.col("s.kind").isNotNull())
              .groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("all")))
    base = F.filter("all", lambda s: s["kind"] < BARE)
    out = rows.select("row", "doc_id.id").join(judged, "row", "left").select(
        "id", F.coalesce("all", F.array().cast(judged.schema["all"].dataType)).alias("all"))
    out = out.withColumn("base", base)

    def count(where) -> Column:
        return F.size(F.filter("all", where)).cast("long")

    def of_kind(k: int) -> Column:
        return count(lambda s: s["kind"] == k)

    return out.select(
        F.col("id").alias(id_col),
        *[of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"),
        count(lambda s: s["verdict"] == "live").alias("n_live"),
        count(lambda s: s["verdict"] == "example").alias("n_example"))
