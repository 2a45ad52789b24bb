"""Results of a run's stages, kept in memory or on the shared file system.

``put`` takes DataFrames, report documents, feature plans and plain JSON values; ``get`` returns all pieces asked for, or
None when any is missing (partial reuse is never attempted).

``DurableCache`` outlives the session: frames are Parquet, the rest JSON. Every ``put`` writes its pieces first and its commit file
last, so a put that was killed half way leaves the earlier state in force; the newest commit that names a piece holds. A frame whose files
are no longer those of its commit counts as missing, and so is computed again.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tabml import reports as R
from tabml.operators.features import FeaturePlan


@dataclass
class RunCache:
    """Pieces of runs in memory."""

    entries: dict[str, dict] = field(default_factory=dict)

    def get(self, run_id: str | None, *keys: str):
        e = self.entries.get(run_id or "", {})
        return None if any(k not in e for k in keys) else [e[k] for k in keys]

    def put(self, run_id: str | None, **values) -> None:
        if run_id:
            self.entries.setdefault(run_id, {}).update(values)


class DurableCache(RunCache):
    """Pieces of runs under a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__()
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def _folder(self, run_id: str) -> str:
        return f"{self.root}/{hashlib.sha256(run_id.encode()).hexdigest()[:24]}"

    def _files(self, path: str) -> list[list]:
        """(name, length) of the data files of a frame."""
        fs, p = self._fs(path)
        if not fs.exists(p):
            return []
        return sorted([f.getPath().getName(), f.getLen()] for f in fs.listStatus(p) if f.getPath().getName().startswith("part-"))

    def _commits(self, run_id: str) -> dict:
        """Piece -> its newest committed form."""
        fs, p = self._fs(f"{self._folder(run_id)}/commits")
        out: dict = {}
        if fs.exists(p):
            for name in sorted(f.getPath().getName() for f in fs.listStatus(p) if f.getPath().getName().endswith(".json")):
                out.update(json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(fs.open(self._fs(f"{p}/{name}")[1]), "UTF-8")))
        return out

    def get(self, run_id: str | None, *keys: str):
        have = self._commits(run_id) if run_id else {}
        out = []
        for k in keys:
            piece = have.get(k)
            if piece is None or piece["kind"] == "frame" and (not piece["files"] or self._files(piece["path"]) != piece["files"]):
                return None
            if piece["kind"] == "frame":
                out.append(self.spark.read.parquet(piece["path"]))
            elif piece["kind"] == "plan":
                out.append(FeaturePlan.from_json(piece["value"]))
            else:
                out.append(R.build(getattr(R, piece["type"]), piece["value"]) if piece["kind"] == "report" else piece["value"])
        return out

    def put(self, run_id: str | None, **values) -> None:
        if not run_id:
            return
        folder, made = self._folder(run_id), {}
        for k, v in values.items():
            if isinstance(v, DataFrame):
                path = f"{folder}/{k}-{uuid.uuid4().hex[:12]}"
                v.write.parquet(path)
                made[k] = {"kind": "frame", "path": path, "files": self._files(path)}
            elif isinstance(v, FeaturePlan):
                made[k] = {"kind": "plan", "value": v.to_json()}
            elif dataclasses.is_dataclass(v):
                made[k] = {"kind": "report", "type": type(v).__name__, "value": v.to_dict()}
            else:
                made[k] = {"kind": "json", "value": v}
        self._commit(folder, made)

    def _commit(self, folder: str, made: dict) -> None:
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        fs, tmp = self._fs(f"{folder}/commits/{name}.tmp")
        out = fs.create(tmp)
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        if not fs.rename(tmp, self._fs(f"{folder}/commits/{name}.json")[1]):
            raise OSError(f"cannot commit to {folder}")


def digest(*parts) -> str:
    """Name of what a stage result depends on."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:16]


def source_version(df: DataFrame) -> list:
    """Schema and files (name, length, time of change) that a frame reads; a frame without files is known by its schema only."""
    spark = df.sparkSession
    out = [df.schema.json()]
    for f in sorted(df.inputFiles()):
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        st = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(p)
        out.append([os.path.basename(f), st.getLen(), st.getModificationTime()])
    return out
