"""Binary contents: magic bytes, printable strings, ZIP directories."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Leading bytes in hex, the type they tell and whether it is a program.
MAGIC = (
    ("4D5A", "PE", True), ("7F454C46", "ELF", True), ("FEEDFACE", "MACHO", True), ("FEEDFACF", "MACHO", True), ("CFFAEDFE", "MACHO", True), ("CAFEBABE", "MACHO", True),
    ("504B0304", "ZIP", False), ("504B0506", "ZIP", False), ("1F8B", "GZIP", False), ("89504E47", "PNG", False), ("FFD8FF", "JPEG", False),
)
PROGRAM_EXTENSIONS = ("exe", "dll", "so", "dylib", "bin", "out", "com")
ZIP_BOMB_RATIO, ZIP_BOMB_BYTES = 100, 20 * 1024 * 1024


def sniff(content: Column) -> Column:
    """Struct of type, is_executable, is_archive and is_binary by the first bytes; unknown types are binary if over 5 % of the first 512 bytes are control bytes below 7."""
    head = F.hex(F.substring(content, 1, 4))
    kind, program = F.lit(None).cast("string"), F.lit(False)
    for magic, name, executable in reversed(MAGIC):
        kind = F.when(head.startswith(magic), name).otherwise(kind)
        program = F.when(head.startswith(magic), executable).otherwise(program)
    sample = F.decode(F.substring(content, 1, 512), "ISO-8859-1")
    control = F.length(sample) - F.length(F.regexp_replace(sample, r"[\x00-\x06]", ""))
    odd = F.length(sample) * 0.05 < control
    return F.struct(
        F.coalesce(kind, F.lit("UNKNOWN")).alias("type"), program.alias("is_executable"), F.coalesce(kind.isin("ZIP", "GZIP"), F.lit(False)).alias("is_archive"), F.coalesce(kind.isNotNull() | odd, F.lit(False)).alias("is_binary")
    )


def is_disguised(executable: Column, extension: Column) -> Column:
    """A program under a name that doesn't say so; a name without extension doesn't."""
    return executable & ~extension.isin(*PROGRAM_EXTENSIONS)


def printable_strings(content: Column, least: int = 5, most: int = 3000) -> Column:
    """The first runs of printable characters of at least that length."""
    return F.slice(F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(rf"[\x20-\x7e]{{{least},}}"), F.lit(0)), 1, most)


def control_share(content: Column) -> Column:
    """Share of NUL and control bytes below 7 in the first 512 bytes."""
    sample = F.decode(F.substring(content, 1, 512), "ISO-8859-1")
    return F.when(F.length(sample) > 0, (F.length(sample) - F.length(F.regexp_replace(sample, r"[\x00-\x06]", ""))) / F.length(sample)).otherwise(0.0)


ZIP_SCHEMA = T.StructType([
    T.StructField("is_archive", T.BooleanType()), T.StructField("entries", T.IntegerType()), T.StructField("uncompressed", T.LongType()),
    T.StructField("traversal", T.BooleanType()), T.StructField("bomb", T.BooleanType()), T.StructField("notes", T.ArrayType(T.StringType())),
])


def inspect_zip(data: bytes | None) -> tuple[bool, int, int, bool, bool, list[str]]:
    """The central directory's figures; nothing is unpacked, and a broken directory gives what was read so far."""
    if data is None or len(data) < 22 or data[:2] != b"PK":
        return False, 0, 0, False, False, []
    end = data.rfind(b"PK\x05\x06", max(0, len(data) - 65_557))
    entries = total = 0
    traversal, notes = False, []
    if end >= 0 and end + 22 <= len(data):
        entries, at = struct.unpack_from("<H", data, end + 10)[0], struct.unpack_from("<I", data, end + 16)[0]
        for _ in range(entries):
            if at + 46 > len(data) or data[at : at + 4] != b"PK\x01\x02":
                break
            size, name_size, extra, comment = *struct.unpack_from("<I", data, at + 24), *struct.unpack_from("<HHH", data, at + 28)
            total += size
            name = data[at + 46 : at + 46 + name_size].decode("utf-8", "replace")
            if len(data) >= at + 46 + name_size:
                if "../" in name or "..\\" in name or name[:1] in ("/", "\\"):
                    traversal = True
                    notes.append(f"leaves its folder: {name}")
                if name.endswith((".zip", ".tar.gz", ".7z")):
                    notes.append(f"nested archive: {name}")
                if name.endswith((".exe", ".dll", ".bat", ".vbs", ".ps1")):
                    notes.append(f"program: {name}")
            at += 46 + name_size + extra + comment
    bomb = total / len(data) > ZIP_BOMB_RATIO and total > ZIP_BOMB_BYTES
    return True, entries, total, traversal, bomb, notes + ["unpacks to over a hundred times its size"] * bomb


@F.pandas_udf(ZIP_SCHEMA)
def zip_report(contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([inspect_zip(c) for c in contents], columns=["is_archive", "entries", "uncompressed", "traversal", "bomb", "notes"])
