"""Magnitude spectrum of one frame of a signal, as a vector."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecframe.operators.kernel import groups
from vecframe.session import ship


def hann(length: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / length)


def frame_spectrum(
    df: DataFrame,
    samples: str = "samples",
    column: str = "spectrum",
    n_fft: int = 256,
    win_length: int = 80,
    hop_length: int = 400,
    frame: int = 0,
    center: bool = True,
) -> DataFrame:
    """Add the n_fft/2 + 1 magnitudes of one short-time Fourier frame of every signal.

    A Hann window of `win_length` samples is centred in the frame. With `center` the signal is
    mirrored by n_fft/2 samples at both ends, so frame 0 is centred on the first sample. Signals
    too short for the frame give NULL.
    """
    if not 0 < win_length <= n_fft:
        raise ValueError("win_length must be between 1 and n_fft")
    ship(df.sparkSession)
    window = np.zeros(n_fft)
    left = (n_fft - win_length) // 2
    window[left:left + win_length] = hann(win_length)
    half = n_fft // 2 if center else 0

    @F.arrow_udf("array<double>")
    def spectrum(signals: pa.Array) -> pa.Array:
        values = signals.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        lengths = np.asarray(signals.value_lengths().fill_null(0))
        starts = np.cumsum(lengths) - lengths
        out = np.full((len(signals), n_fft // 2 + 1), np.nan)
        fits = np.zeros(len(signals), bool)
        for length, rows in groups(lengths):
            at = frame * hop_length - half + np.arange(n_fft)
            padded = length + 2 * half
            if length == 0 or length <= half or frame * hop_length + n_fft > padded:
                continue
            at = np.abs(at)
            at = np.where(at >= length, 2 * (length - 1) - at, at)
            out[rows] = np.abs(np.fft.rfft(values[starts[rows][:, None] + at] * window, axis=1))
            fits[rows] = True
        width = out.shape[1]
        offsets = pa.array(np.arange(len(signals) + 1) * width, pa.int32())
        return pa.ListArray.from_arrays(
            offsets, pa.array(out.reshape(-1)), mask=pa.array(~fits)
        )

    return df.withColumn(column, spectrum(F.col(samples)))
