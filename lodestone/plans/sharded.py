"""The weight search over shards of queries, resumable and checked.

Rows are written once by shard of their query. The first pass gives every shard
its metrics under all profiles, and their means over all shards the profile that
is best for all; the second pass searches the weights of each query and page. A
shard's output is written with its digest taken on the way and then entered in
the ledger. A run that is ended at any point goes on after the last entry; what
it had not entered is written again. Other inputs or settings, a broken chain and
shards that no longer give their digest are refused.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import audit, oracle, page_oracle
from ..operators.contracts import CHANNELS
from ..sources.ledger import Ledger, LedgerError
from ..sources.writers import write_observed

SHARDS = 8
_INPUT = ["query_id", "page_id", "relevance", *CHANNELS]


def identity(scores: DataFrame, profiles, shards: int, sweeps: int) -> str:
    """Fingerprint of the rows that are read, and the settings."""
    rows = audit.fingerprint(scores.select(*_INPUT), _INPUT).first().asDict()
    return json.dumps({"rows": {k: str(v) for k, v in rows.items()}, "profiles": [list(p) for p in profiles], "shards": shards, "sweeps": sweeps}, sort_keys=True)


class ShardedSearch:
    """A search in ``folder``. ``scores`` has normalized channels and relevance."""

    def __init__(self, scores: DataFrame, profiles, folder: str, shards: int = SHARDS, sweeps: int = 2):
        self.spark, self.folder = scores.sparkSession, folder
        self.profiles, self.shards, self.sweeps = oracle.checked(profiles), shards, sweeps
        self.scores = scores.select(*_INPUT)
        self.ledger = Ledger(self.spark, folder, identity(scores, self.profiles, shards, sweeps))

    def _path(self, step: str, shard: int) -> str:
        return f"{self.folder}/{step}/shard={shard}"

    def _done(self, step: str) -> dict[int, dict]:
        return {c["shard"]: c for c in self.ledger.contents() if c["step"] == step}

    def _commit(self, df: DataFrame, step: str, shard: int, **more) -> None:
        digest = write_observed(df, self._path(step, shard), mode="overwrite")
        self.ledger.commit({"step": step, "shard": shard, **digest, **more})

    def run(self, stop_after: int | None = None) -> DataFrame | None:
        """(query_id, global_profile, global_ndcg10, query_profile, query_ndcg10,
        page_ndcg10, changed, updates), or None after ``stop_after`` commits."""
        for n, step in enumerate(self._steps()):
            if n == stop_after:
                return None
            step()
        return self.spark.read.parquet(*[self._path("search", s) for s in range(self.shards)])

    def _steps(self):
        """What has not been committed yet, in order."""
        if not self._done("input"):
            yield self._stage
        for s in range(self.shards):
            if s not in self._done("metrics"):
                yield lambda s=s: self._commit(oracle.profile_metrics(self._rows(s), self.profiles), "metrics", s)
        if not self._done("global"):
            yield self._choose
        for s in range(self.shards):
            if s not in self._done("search"):
                yield lambda s=s: self._commit(self._searched(s), "search", s)

    def _stage(self) -> None:
        """The rows by shard: each shard is read alone from here on."""
        d = self.scores.withColumn("shard", F.pmod(F.xxhash64("query_id"), F.lit(self.shards)).cast("int"))
        digest = write_observed(d.repartition("shard", "query_id"), f"{self.folder}/input", mode="overwrite", by=["shard"])
        self.ledger.commit({"step": "input", "shard": -1, **digest})

    def _rows(self, shard: int) -> DataFrame:
        schema = T.StructType([*self.scores.schema.fields, T.StructField("shard", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{self.folder}/input").where(F.col("shard") == shard).drop("shard")

    def _metrics(self, *shards: int) -> DataFrame:
        return self.spark.read.parquet(*[self._path("metrics", s) for s in shards])

    def _choose(self) -> None:
        best = oracle.global_oracle(self._metrics(*range(self.shards))).first()
        self.ledger.commit({"step": "global", "shard": -1, "profile": best["profile"] if best and best["profile"] is not None else -1})

    def _searched(self, shard: int) -> DataFrame:
        chosen = self._done("global")[-1]["profile"]
        metrics = self._metrics(shard)
        own = metrics.where(F.col("profile") == chosen).select("query_id", F.col("profile").alias("global_profile"), F.col("ndcg10").alias("global_ndcg10"))
        best = oracle.query_oracle(metrics).select("query_id", F.col("profile").alias("query_profile"), F.col("ndcg10").alias("query_ndcg10"))
        page = page_oracle.page_oracle(self._rows(shard), self.profiles, self.sweeps).select("query_id", "page_ndcg10", "changed", "updates")
        return own.join(best, "query_id").join(page, "query_id")

    def verify(self) -> None:
        """Every committed shard still gives its digest."""
        for c in self.ledger.contents():
            if c["step"] == "global":
                continue
            df = self.spark.read.parquet(f"{self.folder}/input" if c["step"] == "input" else self._path(c["step"], c["shard"]))
            now = audit.fingerprint(df, sorted(df.columns)).first().asDict()
            if any(str(now[k]) != c[k] for k in now):
                raise LedgerError(f"shard {c['shard']} of {c['step']} has changed")
