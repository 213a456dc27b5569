"""VTK XML files with appended arrays, read back as tables."""

from __future__ import annotations

import base64
import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import AXES
from .sinks import VTK_TYPES

_NUMPY = {v: k for k, v in VTK_TYPES.items()}


def parse(content: bytes) -> tuple[ET.Element, list[tuple[str, str, int, np.ndarray]]]:
    """The XML of a file and (section, name, components, values) of its arrays, raw or in base64."""
    at = content.index(b"<AppendedData")
    start = content.index(b"_", at) + 1
    root = ET.fromstring(content[:at] + b"</VTKFile>")
    in_base64 = b'"base64"' in content[at:start]
    out = []
    for section in root.iter():
        for a in section.findall("DataArray"):
            p = start + int(a.get("offset"))
            if in_base64:
                (n,) = struct.unpack("<Q", base64.b64decode(content[p : p + 12])[:8])
                body = base64.b64decode(content[p : p + -(-(8 + n) // 3) * 4])[8:]
            else:
                (n,) = struct.unpack("<Q", content[p : p + 8])
                body = content[p + 8 : p + 8 + n]
            out.append((section.tag, a.get("Name"), int(a.get("NumberOfComponents")), np.frombuffer(body, _NUMPY[a.get("type")])))
    return root, out


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): a file is one row, bounded by the block that it holds."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_image(spark: SparkSession, path: str, arrays: dict[str, str]) -> DataFrame:
    """(file, lx, ly, lz, x, y, z and ``arrays`` by name and Spark type) of image pieces; l: within the piece."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                root, found = parse(bytes(content))
                e = list(map(int, root.find("ImageData/Piece").get("Extent").split()))
                shape = [e[1] - e[0], e[3] - e[2], e[5] - e[4]]
                local = [i.ravel(order="F").astype(np.int32) for i in np.indices(shape)]
                values = {n: v for _, n, _, v in found}
                yield pd.DataFrame({"file": name, **{f"l{a}": i for a, i in zip(AXES, local, strict=True)}, **{a: i + np.int32(s) for a, i, s in zip(AXES, local, e[::2], strict=True)}, **{n: values[n] for n in arrays}})

    columns = ", ".join([f"l{a} int" for a in AXES] + [f"{a} int" for a in AXES] + [f"{n} {t}" for n, t in arrays.items()])
    return _files(spark, path).mapInPandas(run, f"file string, {columns}")


def read_points(spark: SparkSession, path: str, arrays: dict[str, str]) -> DataFrame:
    """(x, y, z and ``arrays``) of the points of unstructured pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                found = {n: v for _, n, _, v in parse(bytes(content))[1]}
                at = found["points"].reshape(-1, 3)
                yield pd.DataFrame({**{a: at[:, i] for i, a in enumerate(AXES)}, **{n: found[n] for n in arrays}})

    return _files(spark, path).mapInPandas(run, ", ".join([f"{a} double" for a in AXES] + [f"{n} {t}" for n, t in arrays.items()]))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(tag, name, extent) of the pieces, data sets and arrays that an index or a collection lists."""
    text = spark.read.text(path, wholetext=True).first()["value"]  # a few lines a piece
    root = ET.fromstring(text)
    rows = [(e.tag, e.get("Source") or e.get("file") or e.get("Name"), e.get("Extent") or e.get("timestep") or e.get("type")) for e in root.iter() if e.tag in ("Piece", "DataSet", "PDataArray")]
    return spark.createDataFrame(rows, "tag string, name string, detail string").withColumn("kind", F.lit(root.get("type")))
