"""A log of commits, each chained by hash to the one before.

An entry is a small file of JSON that appears whole, by renaming, and is never
replaced. Its hash covers its content and the hash of the entry before it; the
first is chained to the identity of the run. Whoever opens the log with another
identity, or finds an entry changed, missing or out of turn, gets a LedgerError.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import SparkSession


class LedgerError(ValueError):
    pass


def hashed(before: str, content: dict) -> str:
    return hashlib.sha256(json.dumps([before, content], sort_keys=True).encode()).hexdigest()


class Ledger:
    def __init__(self, spark: SparkSession, folder: str, identity: str):
        self.folder, self.spark = f"{folder}/log", spark
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.start = hashed("", {"identity": identity})
        self.entries = self._read()

    def _read(self) -> list[dict]:
        """The entries in their order, after a test of the whole chain."""
        at = self._path(self.folder)
        names = [x.getPath().getName() for x in self._files.listStatus(at)] if self._files.exists(at) else []
        if not any(n.endswith(".json") for n in names):
            return []
        lines = [json.loads(r["value"]) for r in self.spark.read.text(f"{self.folder}/*.json").collect()]  # an entry a commit
        entries, before = sorted(lines, key=lambda e: e["number"]), self.start
        for i, e in enumerate(entries):
            if e["number"] != i or e["before"] != before or e["hash"] != hashed(before, e["content"]):
                raise LedgerError(f"entry {i} of {self.folder} does not follow from the one before")
            before = e["hash"]
        return entries

    def contents(self) -> list[dict]:
        return [e["content"] for e in self.entries]

    @property
    def head(self) -> str:
        return self.entries[-1]["hash"] if self.entries else self.start

    def commit(self, content: dict) -> str:
        entry = {"number": len(self.entries), "before": self.head, "content": content, "hash": hashed(self.head, content)}
        final, part = (self._path(f"{self.folder}/{entry['number']:08d}.{end}") for end in ("json", "part"))
        if self._files.exists(final):
            raise LedgerError(f"another run has written entry {entry['number']} of {self.folder}")
        self._files.mkdirs(self._path(self.folder))
        out = self._files.create(part, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if not self._files.rename(part, final):
            raise LedgerError(f"entry {entry['number']} of {self.folder} could not be written")
        self.entries.append(entry)
        return entry["hash"]
