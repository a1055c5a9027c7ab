"""Operator 8: secret scan with corpus-wide ownership frequency.

Patterns give candidates; each candidate value's hash is counted over the whole
corpus by distinct documents (the repositories) and by distinct owners (the
``owner`` column).  A value that many owners or many documents carry is a copied
example; one that a single owner carries in few documents looks live; the rest is
unclear.  Besides the base kinds (assign, access, hex) long mixed tokens are
candidates, and those that look live are reported as kind ``owned``.

Values are counted per (hash, owner, document), then per (hash, owner), then per
hash, so a value that a third of all documents carry does not gather in one task,
and the verdicts of such values are joined back salted.  Only hashes of values are
shuffled.  Null text is empty; a null owner counts as one owner, and the documents
of one owner without an id as one document.  Repeated rows count as one document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_hot, read

# Base kinds in their order, words that name an assigned secret.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}")
_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")

#: Owners and documents up to which a value looks live, and from which it is a copied example.
LIVE_OWNERS, EXAMPLE_OWNERS, LIVE_DOCS, EXAMPLE_DOCS, MIN_ENTROPY = 1, 3, 5, 20, 3.5


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def candidates(text: str) -> list[tuple[int, int, str, str]]:
    """``start, end, kind, value`` in code points, by start and kind."""
    found = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        found += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    base = list(found)
    for m in TOKEN.finditer(text):
        if re.search("[A-Za-z]", m[0]) and entropy(m[0]) >= MIN_ENTROPY and not any(s < m.end() and m.start() < e for s, e, _, _ in base):
            found.append((m.start(), m.end(), "owned", m[0]))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for text in pdf["text"]:
            spans = [{"start": s, "end": e, "kind": k, "hash": xxhash.xxh3_128_hexdigest(v.encode("utf-8", "surrogatepass"))} for s, e, k, v in candidates(text)] if isinstance(text, str) else []
            out.append(spans)
        yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "owner": pdf["owner"].array, "found": out})


def ownership(scanned: DataFrame) -> DataFrame:
    """``hash, n_docs, n_owners`` of every candidate value of ``scanned(doc_id, owner, found)``."""
    one = scanned.select("doc_id", "owner", F.explode("found.hash").alias("hash")).distinct()
    by_owner = one.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_owners"))


def verdict(n_docs: Column, n_owners: Column, live_owners: int, example_owners: int, live_docs: int, example_docs: int) -> Column:
    copied = (n_owners >= example_owners) | (n_docs >= example_docs)
    return F.when(copied, "example").when((n_owners <= live_owners) & (n_docs <= live_docs), "live").otherwise("unclear")


def scan_secrets(documents: DataFrame, owner: str = "source", live_owners: int = LIVE_OWNERS, example_owners: int = EXAMPLE_OWNERS, live_docs: int = LIVE_DOCS, example_docs: int = EXAMPLE_DOCS) -> DataFrame:
    """Per row of ``documents(doc_id, text, <owner>)``: doc_id, spans (start, end, kind, verdict).

    The verdict is ``live``, ``example`` or ``unclear`` by the value's numbers of documents and owners;
    spans of kind ``owned`` are there only if they look live.
    """
    # ids go through pandas as text: beside a null, longs would turn into doubles
    docs = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"))
    scanned = cut(docs.mapInPandas(_scan, "doc_id string, owner string, found array<struct<start:int,end:int,kind:string,hash:string>>"))
    counts = cut(ownership(scanned))
    told = counts.select("hash", "n_docs", verdict(F.col("n_docs"), F.col("n_owners"), live_owners, example_owners, live_docs, example_docs).alias("verdict"))
    of_doc = join_hot(scanned.select("doc_id", F.explode(F.array_distinct("found.hash")).alias("hash")), told.filter("verdict <> 'unclear'"), ["hash"], "n_docs", "doc_id")
    of_doc = of_doc.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set(F.when(F.col("verdict") == "live", F.col("hash"))).alias("_live"), F.collect_set(F.when(F.col("verdict") == "example", F.col("hash"))).alias("_example"))
    out = scanned.join(of_doc, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.size("found") > 0), "left")
    which = lambda x: F.when(F.array_contains("_live", x["hash"]), "live").when(F.array_contains("_example", x["hash"]), "example").otherwise("unclear")
    spans = F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), which(x).alias("verdict")))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.filter(spans, lambda x: (x["kind"] != "owned") | (x["verdict"] == "live")).alias("spans"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(read(spark, sf_dir, "documents"))
    name = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.array_join(F.transform(F.filter("spans", lambda x: x["kind"] != "owned"), name), ",")
    verdicts = lambda v: F.size(F.filter("spans", lambda x: x["verdict"] == v)).cast("long")
    return out.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("spans", name), ",").alias("spans"), verdicts("live").alias("n_live"), verdicts("example").alias("n_example"))
