"""Detectors over bytes and facts."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Floors of the byte tests (fixed values): bytes, 0x90 run, code bytes, markers, entropy, printable share.
MIN_BYTES, MIN_NOPS, MIN_CODE, MIN_MARKERS, MIN_ENTROPY, MAX_PRINTABLE = 12, 8, 16, 3, 3.5, 0.5
PROLOGUES = (b"\x55\x48\x89\xe5", b"\x55\x89\xe5", b"\x30\x83")
MARKERS = (b"\xcd\x80", b"\x0f\x05", b"\xeb", b"\xe8", b"\x31\xc0", b"\xff\xe4", b"\x2f\x62\x69\x6e")


def shape_of(data: bytes) -> str:
    """Elf, mz, nop-sled, prologue, shellcode or none, first fit wins."""
    if len(data) < MIN_BYTES:
        return "none"
    if data[:4] == b"\x7fELF":
        return "elf"
    if data[:2] == b"MZ":
        return "mz"
    if max((len(m) for m in re.findall(rb"\x90+", data)), default=0) >= MIN_NOPS:
        return "nop-sled"
    if sum(data.count(p) for p in PROLOGUES) >= 3:
        return "prologue"
    counts = np.bincount(np.frombuffer(data, "uint8"), minlength=256)
    p = counts[counts > 0] / len(data)
    printable = counts[32:127].sum() / len(data)
    if len(data) >= MIN_CODE and sum(m in data for m in MARKERS) >= MIN_MARKERS and -(p * np.log2(p)).sum() >= MIN_ENTROPY and printable <= MAX_PRINTABLE:
        return "shellcode"
    return "none"


def blob_shape(data: Column) -> Column:
    """The shape of byte strings, Arrow batches at a time; null counts as empty."""

    @F.pandas_udf("string")
    def shape(s: pd.Series) -> pd.Series:
        return pd.Series([shape_of(bytes(b)) if b is not None else "none" for b in s])

    return shape(data)


def text_entropy(text: Column) -> Column:
    """D02 for texts of any length: bits per character, 0 for none; each text is counted where it lies."""

    @F.pandas_udf("double")
    def counted(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> float | None:
            if not isinstance(t, str):
                return None
            _, n = np.unique(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4"), return_counts=True)
            p = n / max(1, len(t))
            return float(-(p * np.log2(p)).sum())

        return pd.Series([one(t) for t in texts], dtype="float64")

    return counted(text)
