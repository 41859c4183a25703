"""Secret scanning with an incremental ledger of content-addressed blobs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

RULE_VERSION = 1
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "jwt", "pem")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{16,}")
_JWT = re.compile(r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----")
#: Repeated blobs, and paths of them, up to which they are broadcast; beyond, the texts are exchanged.
BROADCAST_ROWS = 1_000_000


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) in order; a match that fails its length is dropped and not retried."""
    out, low = [], text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "eyJ" in text:
        out += [(m.start(), 3, m.end()) for m in _JWT.finditer(text)]
    if "-----BEGIN" in text:
        out += [(m.start(), 4, m.end()) for m in _PEM.finditer(text)]
    return sorted(out)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    name = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
    for pdf in batches:
        rows = []
        for blob, text in zip(pdf["blob"], pdf["text"], strict=True):
            spans = find(text)
            base = [s for s in spans if s[1] < len(BASE)]
            rows.append((blob, *(sum(s[1] == k for s in base) for k in range(len(BASE))), hashlib.sha256(name(base).encode()).hexdigest(), name(spans)))
        yield pd.DataFrame(rows, columns=["blob", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])


LEDGER = "blob string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def versions(paths: DataFrame) -> DataFrame:
    """(path, text, blob): every version of every path under the hash of its content; a null text is empty."""
    text = F.coalesce("text", F.lit(""))
    return paths.select("path", text.alias("text"), F.sha2(text, 256).alias("blob"))


def scan(paths: DataFrame, ledger: DataFrame | None = None, rule_version: int = RULE_VERSION, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The ledger's new rows (LEDGER and rule_version): a scan of each blob of paths (path, text) that it lacks.

    Of a blob's paths only the least is read: the others' ids, which are narrow, are taken out by an anti-join
    before texts reach Python. Repeated blobs and those ids are tables of their own, broadcast if counted to be few; beyond
    that they are exchanged, and Spark can split a blob that a third of all paths share. A null text is an empty blob, very long texts
    are scanned whole, a path with several texts has as many versions, a repeated row is one. A null path can't be the least of a blob's paths unless it
    is the only one. Other columns are not read; no paths, no rows.
    """
    every = versions(paths)
    first = written(every.groupBy("blob").agg(F.min("path").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("blob", "_first"), "repeated")
    first = F.broadcast(first) if first.count() <= broadcast_rows else first
    again = written(every.select("path", "blob").join(first, "blob").where("path <> _first").select("path", "blob"), "repeats")
    again = F.broadcast(again) if again.count() <= broadcast_rows else again
    todo = every.join(again, ["path", "blob"], "left_anti")
    if ledger is not None:
        todo = todo.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    found = todo.select("blob", "text").mapInPandas(_scan, LEDGER).dropDuplicates(["blob"])  # a row may be repeated whole
    return found.withColumn("rule_version", F.lit(rule_version))


def join_back(paths: DataFrame, ledger: DataFrame, rule_version: int = RULE_VERSION) -> DataFrame:
    """(path, n_*, base_sha256, spans) for every row of paths; only blobs with findings are joined, the rest have none."""
    some = ledger.where((F.col("rule_version") == rule_version) & (F.col("spans") != ""))
    got = versions(paths).select("path", "blob").join(some, "blob", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return got.select("path", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE), F.coalesce("base_sha256", F.lit(nothing)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in the whole of `documents`, with an empty ledger: see scan(), join_back()."""
    paths = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    return join_back(paths, written(scan(paths), "ledger")).withColumnRenamed("path", "doc_id")
