"""Versioned tables: touched partitions are written anew beside the old ones, and a manifest names what a version consists of.

Readers go by the manifest alone, so a writer that breaks off leaves the last version as it was. A version is won by renaming its manifest to
a name that must not exist: of two writers that start from one version, one wins and the other gets Conflict. The content string
of a version comes from its rows, not from files or order: the same rows give the same string.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_PART = "_part"


def part_name(value: str | None) -> str:
    """A partition's name in paths and manifests, for whatever characters its value has; null has a name of its own."""
    return "null" if value is None else "p" + str(value).encode().hex().upper()


class Conflict(Exception):
    """Another writer has made the version that this one wanted to make."""


def row_number_hash(columns: list[str]) -> Column:
    """60 bits of the row's values; nulls differ from empty strings, and no two lists of values read alike."""
    coded = [F.coalesce(F.concat(F.length(F.col(f"`{c}`").cast("string")).cast("string"), F.lit(":"), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *coded)), 1, 15), 16, 10).cast("decimal(38,0)")


def digests(rows: DataFrame, by: Column) -> DataFrame:
    """Per partition: part, rows and digest (sum of the rows' hashes): the same in whatever order and files the rows lie."""
    return rows.groupBy(by.cast("string").alias("part")).agg(F.count("*").alias("rows"), F.sum(row_number_hash(rows.columns)).cast("string").alias("digest"))


class Versions:
    """Tables under one path that change together. by: table name to the name of the column that partitions it."""

    def __init__(self, spark: SparkSession, path: str, by: dict[str, str]):
        self.spark, self.path, self.by = spark, path.rstrip("/"), by
        self._hadoop = spark._jvm.org.apache.hadoop
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self._hadoop.fs.Path(f"{self.path}/{name}")

    def latest(self) -> dict:
        """The manifest of the last version; version 0 of nothing before the first."""
        folder = self._at("manifests")
        fs = folder.getFileSystem(self._conf)
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []
        names = [n for n in names if n.startswith("v") and n.endswith(".json")]
        return self.manifest(int(names[-1][1:-5])) if names else {"version": 0, "content": "", "tables": {}, "meta": {}}

    def manifest(self, version: int) -> dict:
        text = self.spark.read.text(f"{self.path}/manifests/v{version:09d}.json", wholetext=True).collect()[0][0]
        return json.loads(text)

    def read(self, table: str, manifest: dict | None = None, parts: list[str | None] | None = None) -> DataFrame:
        """A table as the manifest (the latest, if none is given) has it; parts: only the partitions of these values."""
        manifest = manifest or self.latest()
        held = manifest["tables"][table]
        wanted = None if parts is None else {part_name(v) for v in parts}
        paths = [f"{self.path}/{p['path']}" for name, p in sorted(held["parts"].items()) if wanted is None or name in wanted]
        schema = StructType.fromJson(held["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, changes: dict[str, DataFrame], base: dict, meta: dict | None = None, gone: dict[str, list[str | None]] | None = None) -> dict:
        """The version after base: partitions that changes hold are replaced whole, those of gone go, the others stay as they are. The driver sees a line a partition."""
        tables = {name: {"schema": t["schema"], "parts": dict(t["parts"])} for name, t in base["tables"].items()}
        for name, rows in changes.items():
            place = f"data/{uuid.uuid4().hex}"
            value = F.col(self.by[name]).cast("string")
            key = F.when(value.isNull(), "null").otherwise(F.concat(F.lit("p"), F.hex(F.encode(value, "UTF-8"))))
            rows.withColumn(_PART, key).write.partitionBy(_PART).parquet(f"{self.path}/{place}")
            held = tables.setdefault(name, {"schema": rows.schema.jsonValue(), "parts": {}})
            written = self.spark.read.schema(StructType([*rows.schema.fields])).option("recursiveFileLookup", True).parquet(f"{self.path}/{place}")
            for r in digests(written, F.col(self.by[name])).collect():
                held["parts"][part_name(r["part"])] = {"path": f"{place}/{_PART}={part_name(r['part'])}", "rows": r["rows"], "digest": r["digest"]}
        for name, parts in (gone or {}).items():
            for part in parts:
                tables[name]["parts"].pop(part_name(part), None)
        content = json.dumps([(t, part, p["rows"], p["digest"]) for t in sorted(tables) for part, p in sorted(tables[t]["parts"].items())])
        manifest = {"version": base["version"] + 1, "content": hashlib.sha256(content.encode()).hexdigest(), "tables": tables, "meta": meta or {}}
        self._publish(manifest)
        return manifest

    def _publish(self, manifest: dict) -> None:
        draft, final = self._at(f"manifests/.draft-{uuid.uuid4().hex}"), self._at(f"manifests/v{manifest['version']:09d}.json")
        fs = draft.getFileSystem(self._conf)
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        context = self._hadoop.fs.FileContext.getFileContext(draft.getFileSystem(self._conf).getUri(), self._conf)
        never_over = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, never_over)
        except Exception as e:
            fs.delete(draft, False)
            if "AlreadyExists" in str(e):
                raise Conflict(f"version {manifest['version']} of {self.path} exists") from e
            raise


def rebuild(store: Versions, table: str, rows: DataFrame) -> dict:
    """Replace the partitions of a table that rows hold. Returns version, content and a summary: rows, partitions written and partitions kept."""
    before = store.latest()
    after = store.commit({table: rows}, before)
    parts = after["tables"][table]["parts"]
    old = before["tables"].get(table, {"parts": {}})["parts"]
    written = [p for p in parts if parts[p]["path"] != old.get(p, {}).get("path")]
    return {"version": after["version"], "content": after["content"], "rows": sum(p["rows"] for p in parts.values()), "written": len(written), "kept": len(parts) - len(written)}
