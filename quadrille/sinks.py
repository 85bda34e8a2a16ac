"""Writing tiles: a tree of files, an object store or a key-value store.

A sink takes rows (z, tx, ty, payload). Tasks write with a client of their own; a tile that is
written again, because a task was lost, replaces itself. Failures are raised.
"""

from __future__ import annotations

import gzip
import os
import uuid
from collections.abc import Callable, Iterable
from typing import Protocol
from xml.etree import ElementTree

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quadrille.functions.grid import row_id


class Store(Protocol):
    """What holds named bytes."""

    def put(self, name: str, data: bytes) -> None: ...

    def get(self, name: str) -> bytes: ...

    def delete(self, name: str) -> None: ...


class Files:
    """Files under a folder, which all executors have to share."""

    def __init__(self, folder: str):
        self.folder = folder.removeprefix("file://")

    def _path(self, name: str) -> str:
        return os.path.join(self.folder, name)

    def put(self, name: str, data: bytes) -> None:
        path = self._path(name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        # Whole or not at all.
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)

    def get(self, name: str) -> bytes:
        with open(self._path(name), "rb") as f:
            return f.read()

    def delete(self, name: str) -> None:
        os.remove(self._path(name))


def zipped(data: bytes) -> bytes:
    """The bytes as gzip; the same bytes give the same."""
    return gzip.compress(data, mtime=0)


def unzipped(data: bytes) -> bytes:
    return gzip.decompress(data)


class S3:
    """Objects of a bucket, compressed if asked for; needs boto3."""

    def __init__(self, bucket: str, access: str | None = None, secret: str | None = None, zipped: bool = True):
        try:
            import boto3
        except ImportError as e:
            raise RuntimeError("an S3 store needs boto3") from e
        self.client = boto3.client("s3", aws_access_key_id=access, aws_secret_access_key=secret)
        self.bucket, self.zipped = bucket, zipped

    def put(self, name: str, data: bytes, content_type: str = "application/octet-stream") -> None:
        extra = {"ContentEncoding": "gzip"} if self.zipped else {}
        self.client.put_object(Bucket=self.bucket, Key=name, Body=zipped(data) if self.zipped else data, ContentType=content_type, **extra)

    def get(self, name: str) -> bytes:
        found = self.client.get_object(Bucket=self.bucket, Key=name)
        data = found["Body"].read()
        return unzipped(data) if found.get("ContentEncoding") == "gzip" else data

    def delete(self, name: str) -> None:
        self.client.delete_object(Bucket=self.bucket, Key=name)

    def create(self) -> None:
        self.client.create_bucket(Bucket=self.bucket)

    def drop(self) -> None:
        self.client.delete_bucket(Bucket=self.bucket)


def settings_of(*paths: str) -> dict[str, str]:
    """The properties of configuration files in XML; later files win."""
    out: dict[str, str] = {}
    for path in paths:
        for entry in ElementTree.parse(path).getroot().iter("property"):
            if (name := entry.findtext("name")) is not None:
                out[name.strip()] = (entry.findtext("value") or "").strip()
    return out


def address_of(host: str | list[str]) -> dict[str, str | int]:
    """Host and port of a Thrift server."""
    if isinstance(host, str):
        return {"host": host}
    found = settings_of(*host)
    named = found.get("hbase.thrift.host") or found.get("hbase.zookeeper.quorum", "").split(",")[0].split(":")[0].strip()
    if not named:
        raise ValueError(f"no host is named in {host}")
    return {"host": named, "port": int(found.get("hbase.regionserver.thrift.port", 9090))}


class HBase:
    """Cells of a table, one column; needs happybase.

    host: of the Thrift server, or configuration files, which name it as hbase.thrift.host or, where they do not, by the first
    host of hbase.zookeeper.quorum; hbase.regionserver.thrift.port is its port.
    """

    def __init__(self, host: str | list[str], table: str, family: str = "tileData", qualifier: str = ""):
        try:
            import happybase
        except ImportError as e:
            raise RuntimeError("an HBase store needs happybase") from e
        self.connection = happybase.Connection(**address_of(host))
        if table.encode() not in self.connection.tables():
            self.connection.create_table(table, {"tileData": {}, "tileMetaData": {}})
        self.table, self.cell = self.connection.table(table), f"{family}:{qualifier}".encode()

    def put(self, name: str, data: bytes) -> None:
        self.table.put(name.encode(), {self.cell: data})

    def get(self, name: str) -> bytes:
        return self.table.row(name.encode())[self.cell]

    def delete(self, name: str) -> None:
        self.table.delete(name.encode())


class Sink:
    """Where a job's tiles and other files go.

    make: makes a store, on the driver or in a task. names: of tiles, as prefix, separator and suffix.
    """

    def __init__(self, make: Callable[[], Store], layer: str, separator: str = "/", suffix: str = ".bin", prefix: str | None = None, make_meta: Callable[[], Store] | None = None):
        self.make, self.make_meta = make, make_meta or make
        self.layer, self.separator, self.suffix = layer, separator, suffix
        self.prefix = f"{layer}/" if prefix is None else prefix

    def write(self, tiles: DataFrame) -> DataFrame:
        """Writes the tiles and returns them."""
        make = self.make
        name = row_id(F.col("z"), F.col("tx"), F.col("ty"), self.prefix, self.separator, self.suffix)

        def put(rows: Iterable[Row]) -> None:
            store = None
            for row in rows:
                store = store or make()
                data = row["payload"]
                store.put(row["name"], data.encode() if isinstance(data, str) else bytes(data))

        tiles.select(name.alias("name"), "payload").foreachPartition(put)
        return tiles

    def write_bytes(self, name: str, data: bytes) -> None:
        self.make_meta().put(f"{self.layer}/{name}", data)


def files(folder: str, layer: str, suffix: str = ".bin") -> Sink:
    return Sink(lambda: Files(folder), layer, suffix=suffix)


def s3(bucket: str, layer: str, access: str | None = None, secret: str | None = None, suffix: str = ".bin") -> Sink:
    return Sink(lambda: S3(bucket, access, secret), layer, suffix=suffix)


def hbase(host: str | list[str], layer: str, qualifier: str = "") -> Sink:
    return Sink(lambda: HBase(host, layer, "tileData", qualifier), layer, separator=",", suffix="", prefix="", make_meta=lambda: HBase(host, layer, "tileMetaData"))


def write_parquet(tiles: DataFrame, path: str) -> None:
    """Tiles as a table, a folder for each level."""
    tiles.write.partitionBy("z").mode("overwrite").parquet(path)


def read_files(spark, folder: str, layer: str, suffix: str = ".bin") -> DataFrame:
    """(z, tx, ty, payload) of a tree of files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(f"{folder}/{layer}")
    parts = F.split(F.regexp_replace("path", r"\.[^./]*$", "") if suffix else F.col("path"), "/")
    at = lambda i: F.element_at(parts, i).try_cast("int")
    return found.select(at(-3).alias("z"), at(-2).alias("tx"), at(-1).alias("ty"), F.col("content").alias("payload")).where("z IS NOT NULL AND tx IS NOT NULL AND ty IS NOT NULL")
