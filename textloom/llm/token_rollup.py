"""Token counts as delta-maintained rollups.

A change says that a document's count was inserted, deleted or revised. A batch of changes becomes signed deltas,
added up by source, language and tokenizer version, before anything is stored; a revision subtracts the old count
and adds the new. A commit costs what its batch holds. Totals are a snapshot of the totals at some commits and the
deltas of those after them; compact() makes a new snapshot, so reading costs what came since.

Commits are idempotent. A batch's deltas are written to a folder of their own attempt; then a marker named by the
batch is created, which the file system lets only one attempt do, and the attempt's name is written into it. A marker
whose writer died in between doesn't count, and the next attempt makes another after it (batch~1, batch~2, ...). Totals
read the attempt that a batch's first whole marker names, so a batch that is sent again, or whose job died anywhere and
ran again, counts once.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
CHANGES = "op string, source string, lang string, tokenizer string, n_tokens bigint, old_tokens bigint"
DELTAS = "source string, lang string, tokenizer string, docs bigint, tokens bigint"


def signed_deltas(changes: DataFrame) -> DataFrame:
    """(source, lang, tokenizer, docs, tokens) from rows of op, keys, n_tokens and old_tokens.

    insert: +1 document, +n_tokens. delete: -1, -n_tokens. revise: 0, n_tokens - old_tokens. Null counts are 0, null
    keys are a key, and an unknown or null op fails. Groups whose deltas are all 0 are left out.
    """
    sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce("op", F.lit("null")))).cast("int"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    rows = changes.select(*KEYS, sign.cast("long").alias("docs"), F.when(F.col("op") == "revise", count("n_tokens") - count("old_tokens")).otherwise(sign * count("n_tokens")).alias("tokens"))
    return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 or tokens <> 0")


class TokenRollup:
    """A rollup stored in a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def commits(self, known: dict[str, str] | None = None) -> dict[str, str]:
        """The attempt that counts, by batch; of `known` batches nothing is read or returned."""
        folder = self._hadoop(f"{self.path}/commits")
        if not self._fs.exists(folder):
            return {}
        names = [s.getPath().getName().partition("~") for s in self._fs.listStatus(folder)]
        out = {}
        for batch, k in sorted((batch, int(k or 0)) for batch, _, k in names):
            if batch not in out and batch not in (known or ()) and (attempt := self._named(batch, k)):
                out[batch] = attempt
        return out

    def _marker(self, batch: str, k: int) -> str:
        return f"{self.path}/commits/{batch}" + (f"~{k}" if k else "")

    def _named(self, batch: str, k: int) -> str | None:
        """The attempt that a batch's k-th marker names; None if its writer didn't come to an end."""
        text = self._read(self._marker(batch, k))
        return text if re.fullmatch(re.escape(batch) + "-[0-9a-f]{32}", text) else None

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._hadoop(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of changes once; False if a batch of this name is there already."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"a batch's name has letters, digits, . _ and - only: {batch!r}")
        k = 0
        while self._fs.exists(self._hadoop(self._marker(batch, k))):
            if self._named(batch, k):
                return False
            k += 1
        attempt = f"{batch}-{uuid.uuid4().hex}"
        signed_deltas(changes).write.parquet(f"{self.path}/deltas/{attempt}")
        while not self._write(self._marker(batch, k), attempt):
            if self._named(batch, k):
                return False
            k += 1
        return True

    def _write(self, path: str, text: str) -> bool:
        """Create a file with this text; False if it is there already."""
        try:
            stream = self._fs.create(self._hadoop(path), False)
        except Exception as e:
            if "AlreadyExists" not in str(e) and "AlreadyBeingCreated" not in str(e):
                raise
            return False
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def _snapshot(self) -> dict:
        """The last whole snapshot: its folder of totals and the batches in it. One whose writer died is passed over."""
        folder = self._hadoop(f"{self.path}/snapshots")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        for name in sorted(names, key=int, reverse=True):
            try:
                return json.loads(self._read(f"{self.path}/snapshots/{name}")) | {"number": int(name)}
            except ValueError:
                continue
        return {"folder": None, "batches": {}, "number": 0}

    def _sum(self, snapshot: dict, since: dict[str, str]) -> DataFrame:
        paths = [f"{self.path}/deltas/{a}" for a in [*filter(None, [snapshot["folder"]]), *sorted(since.values())]]
        rows = self.spark.read.schema(DELTAS).parquet(*paths) if paths else self.spark.createDataFrame([], DELTAS)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) of all committed batches.

        Null keys are a key. Groups that have come to nothing are left out, so a rollup without batches, or of empty
        ones, has no rows.
        """
        snapshot = self._snapshot()
        return self._sum(snapshot, self.commits(snapshot["batches"]))

    def compact(self) -> bool:
        """Make the totals of all committed batches the snapshot; False if there is nothing new or another did so meanwhile.

        The totals are written first, then a file that names them and their batches, which only one writer can create.
        A batch that is committed meanwhile isn't in it and counts as a delta. Batches stay known, so they still can't
        be sent again.
        """
        snapshot = self._snapshot()
        since = self.commits(snapshot["batches"])
        if not since:
            return False
        folder = f"snapshot-{uuid.uuid4().hex}"
        self._sum(snapshot, since).write.parquet(f"{self.path}/deltas/{folder}")
        number = snapshot["number"] + 1
        while not self._write(f"{self.path}/snapshots/{number}", json.dumps({"folder": folder, "batches": snapshot["batches"] | since})):
            if self._snapshot()["number"] >= number:
                return False
            number += 1  # of a writer that died
        return True


def count_words(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The table with n_tokens: runs of anything but ASCII white space; 0 for null."""
    return docs.withColumn("n_tokens", F.coalesce(F.regexp_count(F.col(text_column), F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long"))
