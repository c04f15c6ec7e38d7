"""Secret scans over an incremental blob ledger (DataFrame functions only).

Every version of every path is content-addressed by SHA-256. The ledger records
which (blob, rule version) pairs have been scanned and what was found; a new
batch scans only the pairs it has not seen, one copy of each blob, and findings
are joined back to all paths that hold the blob.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import materialize, write


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have at least ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


# The patterns of the operator's contract. For the last two the
# least length is part of the pattern: a maximal run is found either way.
RULES = (
    Rule(
        "assign",
        1,
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
)


def _hits(text: Column, rule: Rule) -> Column:
    """Per match: characters between it and the match before, its length, the length of its value."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    gaps = F.slice(F.split(text, rule.pattern, -1), 1, F.size(found))
    zipped = F.arrays_zip(gaps.alias("g"), found.alias("m"), value.alias("v"))
    hits = F.transform(
        zipped,
        lambda x: F.struct(
            F.lit(rule.kind).alias("kind"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"), F.length(x["v"]).alias("value")
        ),
    )
    return F.when(F.size(found) > 0, hits)


def find_spans(blobs: DataFrame, rules=RULES) -> DataFrame:
    """``blobs`` (blob_id, text, pending array<string>) to spans (blob_id, kind, start, end) in code points.

    Only rules named in ``pending`` run on a blob. Matches are leftmost and
    non-overlapping per rule; the running position is a window over the matches
    of one text, so many matches cost no more than sorting them.
    """
    hits = F.concat(
        *[
            F.coalesce(
                F.when(F.array_contains("pending", r.id), _hits(F.col("text"), r)),
                F.array().cast("array<struct<kind:string,gap:int,len:int,value:int>>"),
            )
            for r in rules
        ]
    )
    rows = blobs.select("blob_id", F.posexplode(hits).alias("i", "hit"))
    so_far = Window.partitionBy("blob_id", "hit.kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("hit.gap") + F.col("hit.len")).over(so_far)
    least = F.coalesce(*[F.when(F.col("hit.kind") == r.kind, F.lit(r.least)) for r in rules])
    return rows.select("blob_id", F.col("hit.kind").alias("kind"), (end - F.col("hit.len")).alias("start"), end.alias("end"), (F.col("hit.value") >= least).alias("ok")).where("ok").drop("ok")


class BlobLedger:
    """Ledger under ``path``: ``scans`` (blob_id, rules) and ``findings`` (blob_id, rule, start, end), a folder a batch.

    A batch's findings are written before its scans; findings of a batch without
    scans are not read, so a run that breaks off is scanned again.
    """

    def __init__(self, spark: SparkSession, path: str, rules=RULES):
        self.spark, self.path, self.rules = spark, path, tuple(rules)
        self.batches: list[str] = []

    @classmethod
    def open(cls, spark: SparkSession, path: str, rules=RULES) -> BlobLedger:
        """Attach to a ledger that earlier runs have written."""
        ledger = cls(spark, path, rules)
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/scans")
        fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(fs_path):
            done = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
            ledger.batches = sorted(s.getPath().getName() for s in fs.listStatus(fs_path) if done(s.getPath()))
        return ledger

    def _read(self, kind: str, schema: str) -> DataFrame | None:
        if not self.batches:
            return None
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{kind}/{b}" for b in self.batches])

    def scans(self) -> DataFrame | None:
        return self._read("scans", "blob_id binary, pending array<string>")

    def findings(self) -> DataFrame | None:
        """Spans found by the current rule versions."""
        found = self._read("findings", "blob_id binary, rule string, start long, end long")
        return found and found.where(F.col("rule").isin([r.id for r in self.rules]))

    def update(self, versions: DataFrame, path_col: str, text_col: str) -> DataFrame:
        """Scan what is new in ``versions`` (every historical version of every path); returns (path, blob_id).

        A NULL text is an empty blob. Repeated rows and equal texts are scanned
        once. The owner of a blob is its least path, so a group of copies costs
        one scan and its rows are pre-aggregated before the shuffle.
        """
        text = F.coalesce(F.col(text_col), F.lit(""))
        blob = F.unhex(F.sha2(text, 256))
        keyed = versions.select(F.col(path_col).alias("path"), blob.alias("blob_id"))
        pending = keyed.groupBy("blob_id").agg(F.min("path").alias("owner")).withColumn("pending", F.array(*[F.lit(r.id) for r in self.rules]))
        if (seen := self.scans()) is not None:
            seen = seen.groupBy("blob_id").agg(F.array_distinct(F.flatten(F.collect_list("pending"))).alias("seen"))
            left = F.array_except("pending", F.coalesce("seen", F.array().cast("array<string>")))
            pending = pending.join(seen, "blob_id", "left").select("blob_id", "owner", left.alias("pending")).where(F.size("pending") > 0)
        batch = uuid.uuid4().hex
        copies = versions.select(F.col(path_col).alias("path"), blob.alias("b"), text.alias("text"))
        todo = copies.join(pending.hint("shuffle_hash"), F.col("path").eqNullSafe(F.col("owner")) & (F.col("b") == F.col("blob_id"))).select("blob_id", "text", "pending")
        rule = F.coalesce(*[F.when(F.col("kind") == r.kind, F.lit(r.id)) for r in self.rules])
        write(find_spans(todo, self.rules).select("blob_id", rule.alias("rule"), "start", "end").distinct(), f"{self.path}/findings/{batch}")
        write(pending.select("blob_id", "pending"), f"{self.path}/scans/{batch}")
        self.batches.append(batch)
        return keyed

    def digest(self, blobs: DataFrame | None = None) -> DataFrame:
        """Per blob with findings: counts, and its spans sorted by start, then rule order; of ``blobs`` (blob_id) only, if given."""
        found = self.findings()
        if blobs is not None:
            found = found.join(blobs.select("blob_id").distinct(), "blob_id", "left_semi")
        order = F.coalesce(*[F.when(F.col("rule") == r.id, F.lit(i)) for i, r in enumerate(self.rules)])
        kind = F.split("rule", "@")[0]
        span = F.struct("start", order.alias("o"), "end", F.concat_ws(":", kind, "start", "end").alias("label"))
        spans = F.array_sort(F.collect_list(span))
        return found.groupBy("blob_id").agg(*[F.count_if(F.col("rule") == r.id).alias(f"n_{r.kind}") for r in self.rules], spans.alias("found"))


def scan_paths(versions: DataFrame, path_col: str, text_col: str, ledger: BlobLedger) -> DataFrame:
    """One row per row of ``versions``: path, blob_id, n_<kind> and ``found`` array<struct<start,o,end,label>> (empty: nothing found)."""
    keyed = ledger.update(versions, path_col, text_col)
    # Written first, so that the join's both sides are exchanges of their own and a
    # group of copies that holds many paths can be split.
    digest = materialize(ledger.digest(keyed if len(ledger.batches) > 1 else None), "digest")
    joined = keyed.join(digest, "blob_id", "left")
    empty = F.array().cast("array<struct<start:bigint,o:int,end:bigint,label:string>>")
    return joined.select("path", "blob_id", *[F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in ledger.rules], F.coalesce("found", empty).alias("found"))


def redact(docs: DataFrame, id_col: str, text_col: str, ledger: BlobLedger, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every found span (overlaps merged) replaced by ``mark``; all columns kept, NULL texts stay NULL."""
    ledger.update(docs, id_col, text_col)
    spans = ledger.digest().select(F.col("blob_id").alias("__b"), F.col("found").alias("__found"))
    rows = docs.withColumn("__blob", F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))
    text, found = F.col(text_col), F.col("__found")
    # The furthest end so far decides where the next kept piece begins.
    cut = F.aggregate(
        found,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark)))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))),
    )
    joined = rows.join(spans, F.col("__blob") == F.col("__b"), "left")
    return joined.withColumn(text_col, F.when(found.isNull(), text).otherwise(cut)).drop("__blob", "__b", "__found")
