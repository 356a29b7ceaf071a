"""Recording files derived from tables, for queries and tests over the file source.

Files are written by the tasks that hold their rows: each file's group is a
fixed number of rows, so no task or file grows with the data. A retried task
writes the same bytes to the same name.
"""

from __future__ import annotations

import os
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from epochwright.sources import edf


def edf_bytes(
    record_sec: float,
    signals: Sequence[tuple[str, str, tuple, np.ndarray]],
    annotations: Sequence[tuple[float, float, str]] | None = None,
) -> bytes:
    """A file of ``(label, unit, (pmin, pmax, dmin, dmax), digital[n_records, samples])``.

    ``annotations`` adds an annotation signal holding all texts in the first record.
    """
    fields = [(label, unit, scale, np.asarray(values, "<i2")) for label, unit, scale, values in signals]
    if annotations is not None:
        texts = "+0\x14\x14\x00" + "".join(
            f"{onset:+.10g}\x15{duration:.10g}\x14{text}\x14\x00"
            for onset, duration, text in annotations
        )
        raw = texts.encode()
        records = len(fields[0][3]) if fields else 1
        per_record = len(raw) // 2 + 1
        block = np.zeros((records, per_record), "<i2")
        block[0] = np.frombuffer(raw.ljust(2 * per_record, b"\0"), "<i2")
        fields.append((edf.ANNOTATION_LABEL, "", (-1, 1, -32768, 32767), block))
    n_records = len(fields[0][3])

    def text(value, width: int) -> bytes:
        return str(value)[:width].ljust(width).encode("latin-1")

    main = {
        "version": 0,
        "date": "01.01.00",
        "time": "00.00.00",
        "header_bytes": 256 * (1 + len(fields)),
        "n_records": n_records,
        "record_sec": f"{record_sec:g}",
        "n_signals": len(fields),
    }
    columns = {
        "label": [f[0] for f in fields],
        "unit": [f[1] for f in fields],
        "physical_min": [f[2][0] for f in fields],
        "physical_max": [f[2][1] for f in fields],
        "digital_min": [f[2][2] for f in fields],
        "digital_max": [f[2][3] for f in fields],
        "samples": [f[3].shape[1] for f in fields],
    }
    header = b"".join(text(main.get(name, ""), width) for name, width in edf.MAIN_HEADER)
    blank = [""] * len(fields)
    for name, width in edf.SIGNAL_HEADER:
        header += b"".join(text(value, width) for value in columns.get(name, blank))
    return header + np.concatenate([f[3] for f in fields], axis=1).tobytes()


def write_file(path: str, content: bytes) -> None:
    """Whole or not at all: write aside, then rename."""
    filesystem, name = edf.resolve(path)
    filesystem.create_dir(os.path.dirname(name), recursive=True)
    aside = f"{name}.{os.getpid()}.part"
    with filesystem.open_output_stream(aside) as out:
        out.write(content)
    filesystem.move(aside, name)


def spoil_files(files: DataFrame) -> DataFrame:
    """``path, how`` rows: a file is cut to three quarters (``cut``) or overwritten (``junk``); lists them."""

    def spoil(frames):
        for pdf in frames:
            for path, how in zip(pdf["path"], pdf["how"]):
                with edf._open(path) as handle:
                    content = handle.read()
                write_file(path, content[: len(content) * 3 // 4] if how == "cut" else b"not a recording")
            yield pdf

    return files.mapInPandas(spoil, "path string, how string")


def digitize(values: np.ndarray) -> np.ndarray:
    """Samples in [-1, 1] to 16 bits."""
    return (np.rint((np.clip(values, -1.0, 1.0) + 1.0) * 32767.5) - 32768).astype("<i2")


FULL_RANGE = (-1, 1, -32768, 32767)


def write_signal_files(
    rows: DataFrame, folder: str, channel: str, rate: float, other: str = "EOG horizontal"
) -> DataFrame:
    """``file, record, signal`` rows to one two-channel file per ``file``; lists what was written.

    One row is one data record. The second channel holds every other sample.
    """

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("record")
        digital = digitize(np.stack(pdf["signal"].to_list()).astype(float))
        name = pdf["file"].iloc[0]
        content = edf_bytes(
            digital.shape[1] / rate,
            [(channel, "uV", FULL_RANGE, digital), (other, "uV", FULL_RANGE, digital[:, ::2])],
        )
        write_file(f"{folder}/{name}", content)
        return pd.DataFrame({"file": [name], "bytes": [len(content)]})

    return rows.select("file", "record", "signal").groupBy("file").applyInPandas(
        write, "file string, bytes long"
    )


def write_annotation_files(rows: DataFrame, folder: str) -> DataFrame:
    """``file, record, onset, duration, description`` rows to one file per ``file``."""

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("record")
        name = pdf["file"].iloc[0]
        entries = list(zip(pdf["onset"], pdf["duration"], pdf["description"]))
        content = edf_bytes(0, [], entries)
        write_file(f"{folder}/{name}", content)
        return pd.DataFrame({"file": [name], "bytes": [len(content)]})

    columns = ["file", "record", "onset", "duration", "description"]
    return rows.select(*columns).groupBy("file").applyInPandas(write, "file string, bytes long")
