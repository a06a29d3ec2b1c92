"""Document folders: text files, DOCX and ZIP archives through ``binaryFile``."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .xlsx import Book

SUFFIXES = ("txt", "docx")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def list_folder(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (*SUFFIXES, "zip")) -> DataFrame:
    """``path, content`` of the documents of a folder and its subfolders."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(path).select("path", "content")


def _text(name: str, data: bytes) -> str | None:
    if name.lower().endswith(".txt"):
        try:
            return data.decode("utf-8-sig")
        except UnicodeDecodeError:
            return data.decode("cp1251", "replace")
    if name.lower().endswith(".docx"):
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                body = ElementTree.fromstring(z.read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None
        return "\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in body.iter(f"{_W}p"))
    return None


def member_name(info: zipfile.ZipInfo) -> str:
    """Names without the UTF-8 flag were written in the DOS code page of their country."""
    name = info.filename
    if not info.flag_bits & 0x800:
        try:
            name = name.encode("cp437").decode("cp866")
        except (UnicodeEncodeError, UnicodeDecodeError):
            pass
    return name.rsplit("/", 1)[-1]


def read_documents(files: DataFrame) -> DataFrame:
    """``source, name, text, error``; archives are opened, their dot files skipped, names made unique within one."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                name = re.split(r"[/\\]", path)[-1]
                if not name.lower().endswith(".zip"):
                    text = _text(name, data)
                    rows.append((path, name, text, None if text is not None else "unreadable"))
                    continue
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        seen: dict[str, int] = {}
                        for info in z.infolist():
                            inner = member_name(info)
                            if info.is_dir() or inner.startswith(".") or not inner.lower().endswith(SUFFIXES):
                                continue
                            k = seen[inner] = seen.get(inner, 0) + 1
                            stem, dot, suffix = inner.rpartition(".")
                            text = _text(inner, z.read(info))
                            rows.append((path, inner if k == 1 else f"{stem}_{k - 1}{dot}{suffix}", text, None if text is not None else "unreadable"))
                except (zipfile.BadZipFile, RuntimeError) as e:
                    rows.append((path, name, None, str(e)))
            yield pd.DataFrame(rows, columns=["source", "name", "text", "error"])

    return files.mapInPandas(run, "source string, name string, text string, error string")


def broken(files: DataFrame) -> DataFrame:
    """``path, error`` of those of ``files(path, content)`` that a batch can't take: archives and workbooks that don't open or hold a part whose checksum is
    wrong, and workbooks without rows."""

    def fault(name: str, data: bytes) -> str | None:
        if not name.lower().endswith((".zip", ".xlsx", ".docx")):
            return None
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                bad = z.testzip()
            if bad is not None:
                return f"{bad}: wrong checksum"
            if name.lower().endswith(".xlsx") and len(list(islice(Book(data).rows(), 2))) < 2:
                return "no rows"
        except (zipfile.BadZipFile, OSError, EOFError, NotImplementedError, RuntimeError, zlib.error, KeyError, IndexError, ValueError, ElementTree.ParseError) as e:
            return f"doesn't open: {e}"
        return None

    def run(batches):
        for pdf in batches:
            found = [(path, fault(path, data)) for path, data in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame([f for f in found if f[1]], columns=["path", "error"])

    return files.mapInPandas(run, "path string, error string")


def accepted(files: DataFrame, shown: int = 5) -> DataFrame:
    """The files, if a batch can take all of them; else ``ValueError`` with the first faults, before anything is imported."""
    faults = broken(files).orderBy("path").limit(shown).collect()
    if faults:
        raise ValueError("; ".join(f"{r.path.rpartition('/')[2]}: {r.error}" for r in faults))
    return files


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows whose key isn't new, and all new rows."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def formula_safe(df: DataFrame) -> DataFrame:
    """Text cells that a spreadsheet would read as formulas begin with an apostrophe."""
    kinds = dict(df.dtypes)
    return df.select(*(F.when(F.col(c).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in df.columns))
