"""Raw mzML and mzXML files as the ``scans`` table.

``read_scans`` goes through Spark's own file listing, so it reads any store that Spark can; ``register`` adds the
formats ``mzml`` and ``mzxml`` for folders that are mounted on the workers, one task a file, read as a stream.
"""

from __future__ import annotations

import base64
import io
import os
import struct
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import PEAKS, SCANS

_MINUTE = {"minute": 1.0, "second": 1 / 60, "UO:0000031": 1.0, "UO:0000010": 1 / 60, "MS:1000038": 1.0, "MS:1000039": 1 / 60}


def safe_float(text: str | None) -> float | None:
    """A number, also with one decimal comma; None if it is none."""
    if text is None:
        return None
    if text.count(",") == 1 and "." not in text:
        text = text.replace(",", ".")
    try:
        return float(text)
    except ValueError:
        return None


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _params(node: ET.Element, deep: bool = True) -> dict[str, tuple[str, str]]:
    """name and accession -> (value, unit) of the cvParams below."""
    out = {}
    for p in node.iter() if deep else node:
        if _local(p.tag) == "cvParam":
            entry = (p.get("value", ""), p.get("unitAccession") or p.get("unitName") or "")
            out[p.get("name", "")] = out[p.get("accession", "")] = entry
    return out


def _array(node: ET.Element) -> tuple[str, np.ndarray]:
    """(``mz`` or ``intensity`` or another kind, values) of a binaryDataArray."""
    own = _params(node)
    text = next((n.text or "" for n in node if _local(n.tag) == "binary"), "")
    data = base64.b64decode(text)
    if "MS:1000574" in own or "zlib compression" in own:
        data = zlib.decompress(data) if data else b""
    kind = "<f4" if "MS:1000521" in own or "32-bit float" in own else "<i8" if "MS:1000522" in own else "<i4" if "MS:1000519" in own else "<f8"
    name = "mz" if "MS:1000514" in own or "m/z array" in own else "intensity" if "MS:1000515" in own or "intensity array" in own else "other"
    return name, np.frombuffer(data, kind)


def mzml_scans(stream, levels: tuple[int, ...] = (1, 2), rt_low: float = 0.0, rt_high: float = 1e9) -> Iterator[tuple]:
    """(scan_id, level, rt, precursor_mz, iso_lo, iso_hi, mz, intensity) in order. Arrays of scans outside the levels
    and times are not decoded, and such scans are left out; ids count all scans."""
    number = -1
    for _, node in ET.iterparse(stream, events=("end",)):
        if _local(node.tag) != "spectrum":
            continue
        number += 1
        own = _params(node)
        level = int(own.get("ms level", own.get("MS:1000511", ("1", "")))[0] or 1)
        value, unit = own.get("scan start time") or own.get("MS:1000016") or own.get("scan time") or ("0", "minute")
        rt = (safe_float(value) or 0.0) * _MINUTE.get(unit, 1.0)
        if level in levels and rt_low <= rt <= rt_high:
            arrays = dict(_array(n) for n in node.iter() if _local(n.tag) == "binaryDataArray")
            mz, intensity = arrays.get("mz", np.zeros(0)), arrays.get("intensity", np.zeros(0))
            precursor = low = high = None
            if level == 2:
                ion = own.get("selected ion m/z") or own.get("MS:1000744")
                precursor = safe_float(ion[0]) if ion else None
                lo, hi = own.get("isolation window lower offset") or own.get("MS:1000828"), own.get("isolation window upper offset") or own.get("MS:1000829")
                low, high = (safe_float(lo[0]) if lo else None) or 1.5, (safe_float(hi[0]) if hi else None) or 1.5
            n = min(len(mz), len(intensity))
            yield number, level, rt, precursor, low, high, mz[:n].astype(np.float32), intensity[:n].astype(np.float32)
        node.clear()


def _duration(text: str | None) -> float:
    """Minutes of ``PT12.3S`` or ``PT1M2S``, or of bare seconds."""
    if not text:
        return 0.0
    if not text.startswith("PT"):
        return (safe_float(text) or 0.0) / 60
    total, number = 0.0, ""
    for c in text[2:]:
        if c in "HMS":
            total += (safe_float(number) or 0.0) * {"H": 60.0, "M": 1.0, "S": 1 / 60}[c]
            number = ""
        else:
            number += c
    return total


def mzxml_scans(stream, levels: tuple[int, ...] = (1, 2), rt_low: float = 0.0, rt_high: float = 1e9) -> Iterator[tuple]:
    number, open_ = -1, []
    for event, node in ET.iterparse(stream, events=("start", "end")):
        if _local(node.tag) != "scan":
            continue
        if event == "start":
            number += 1
            open_.append(number)
            continue
        own = open_.pop()
        level, rt = int(node.get("msLevel", "1")), _duration(node.get("retentionTime"))
        if level in levels and rt_low <= rt <= rt_high:
            peaks = next((n for n in node if _local(n.tag) == "peaks"), None)
            data = base64.b64decode(peaks.text or "") if peaks is not None else b""
            if peaks is not None and peaks.get("compressionType") == "zlib" and data:
                data = zlib.decompress(data)
            pairs = np.frombuffer(data, ">f8" if peaks is not None and peaks.get("precision") == "64" else ">f4").reshape(-1, 2)
            precursor = low = high = None
            if level == 2:
                ion = next((n for n in node if _local(n.tag) == "precursorMz"), None)
                precursor = safe_float(ion.text) if ion is not None else None
                width = safe_float(ion.get("windowWideness")) if ion is not None else None
                low = high = width / 2 if width else 1.5
            yield own, level, rt, precursor, low, high, pairs[:, 0].astype(np.float32), pairs[:, 1].astype(np.float32)
        if not open_:
            node.clear()


PARSERS = {".mzml": mzml_scans, ".mzxml": mzxml_scans}


def stem(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


def _row(sample: str, scan: tuple) -> tuple:
    *head, mz, intensity = scan
    return (sample, *head, [{"mz": float(m), "intensity": float(i)} for m, i in zip(mz, intensity, strict=True)])


_NAMES = ["sample_id", "scan_id", "level", "rt", "precursor_mz", "iso_lo", "iso_hi", "peaks"]


def raw_files(spark: SparkSession, path: str, done: DataFrame | None = None) -> list[str]:
    """Paths of the raw files at a path, folder or pattern, without those of the samples (sample_id) in ``done``. Only
    names are read, one a file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[mM][zZ]*[mM][lL]").load(path).select("path")
    named = files.withColumn("sample_id", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))
    if done is not None:
        named = named.join(done.select("sample_id").distinct(), "sample_id", "left_anti")
    return sorted(r.path for r in named.select("path").collect())


def read_scans(spark: SparkSession, path: str | list[str], levels: tuple[int, ...] = (1, 2), rt_low: float = 0.0, rt_high: float = 1e9) -> tuple[DataFrame, DataFrame]:
    """(scans, errors) of all mzML and mzXML files at a path, folder or pattern. A file that can't be parsed gives a row
    (sample_id, step, message) in errors and no scans. One file is one row of Spark's binary reader, parsed once."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[mM][zZ]*[mM][lL]").load(path).select("path", "content")

    def run(frames):
        for frame in frames:
            for name, content in zip(frame.path, frame.content, strict=True):
                parse = PARSERS.get(os.path.splitext(name)[1].lower())
                rows: list[tuple] = []
                try:
                    if parse is None:
                        raise ValueError("neither mzML nor mzXML")
                    for scan in parse(io.BytesIO(content), levels, rt_low, rt_high):
                        rows.append((*_row(stem(name), scan), None))
                except (ET.ParseError, ValueError, zlib.error, struct.error) as error:
                    rows = [(stem(name), *[None] * 6, [], f"{type(error).__name__}: {error}")]
                for at in range(0, len(rows), 200):
                    yield pd.DataFrame(rows[at : at + 200], columns=[*_NAMES, "message"])

    from ..plans.tables import stored

    both = stored(files.mapInPandas(run, SCANS + ", message string"), "scans")
    scans = both.where("message is null").drop("message")
    return scans, both.where("message is not null").select("sample_id", F.lit("read").alias("step"), "message")


class _Reader(DataSourceReader):
    def __init__(self, options: dict, parse):
        self.path, self.parse = options["path"], parse
        self.levels = tuple(int(x) for x in options.get("levels", "1,2").split(","))
        self.low, self.high = float(options.get("rt_low", 0)), float(options.get("rt_high", 1e9))

    def partitions(self):
        if os.path.isdir(self.path):
            names = sorted(os.path.join(self.path, f) for f in os.listdir(self.path) if not f.startswith("."))
        else:
            names = [self.path]
        found = [InputPartition(f) for f in names if PARSERS.get(os.path.splitext(f)[1].lower()) is self.parse]
        if not found:
            raise FileNotFoundError(self.path)
        return found

    def read(self, partition):
        with open(partition.value, "rb") as stream:
            for scan in self.parse(stream, self.levels, self.low, self.high):
                yield _row(stem(partition.value), scan)


class MzmlSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mzml"

    def schema(self) -> str:
        return SCANS

    def reader(self, schema):
        return _Reader(self.options, mzml_scans)


class MzxmlSource(MzmlSource):
    @classmethod
    def name(cls) -> str:
        return "mzxml"

    def reader(self, schema):
        return _Reader(self.options, mzxml_scans)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MzmlSource)
    spark.dataSource.register(MzxmlSource)


def file_heads(spark: SparkSession, path: str, chars: int = 65536) -> DataFrame:
    """file_id and the first characters of each raw file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("sample_id"), F.decode(F.substring("content", 1, chars), "UTF-8").alias("head"))


def probe(heads: DataFrame) -> DataFrame:
    """Instrument, polarity, centroid flag and start time named in the head; null where it says nothing."""
    from ..operators.annotation import instrument

    low = F.lower("head")
    time = F.regexp_extract("head", 'startTimeStamp="([^"]*)"', 1)
    return heads.select(
        "sample_id",
        instrument(F.col("head")).alias("ms_type"),
        F.when(F.contains(low, F.lit("positive scan")) | F.contains(low, F.lit('polarity="+"')), "positive").when(F.contains(low, F.lit("negative scan")) | F.contains(low, F.lit('polarity="-"')), "negative").alias("ion_mode"),
        (F.contains(low, F.lit("centroid spectrum")) | F.contains(low, F.lit('centroided="1"'))).alias("is_centroid"),
        start_time(time).alias("time"),
    )


def start_time(text: Column) -> Column:
    """Only ``YYYY-MM-DDTHH:MM:SSZ``; null for anything else."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$"), F.try_to_timestamp(F.regexp_replace(text, "[TZ]", " "), F.lit("yyyy-MM-dd HH:mm:ss ")))


__all__ = ["PEAKS", "file_heads", "mzml_scans", "mzxml_scans", "probe", "read_scans", "register", "safe_float", "start_time", "stem"]
