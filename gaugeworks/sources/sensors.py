"""Sources: sequences, functions and mock sensors, in batch and as a Python data source."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from gaugeworks import schema
from gaugeworks.errors import ReadFailed

# The multiplier and increment of the generator, modulo 2^64.
LCG_MULTIPLIER = 6364136223846793005
LCG_INCREMENT = 1442695040888963407
#: Samples that one task draws.
BLOCK = 1 << 16


class Lcg:
    """A 64-bit linear congruential generator whose draws are computed in whole arrays."""

    def __init__(self, seed: int = 42, skip: int = 0) -> None:
        self.state = np.uint64((seed + 1) % (1 << 64))
        self.skip(skip)

    @staticmethod
    def jump(n: int) -> tuple[int, int]:
        """(a, c) with a * state + c the state after n draws."""
        a, c, out_a, out_c = LCG_MULTIPLIER, LCG_INCREMENT, 1, 0
        while n:
            if n & 1:
                out_a, out_c = out_a * a % (1 << 64), (out_c * a + c) % (1 << 64)
            a, c, n = a * a % (1 << 64), (a + 1) * c % (1 << 64), n >> 1
        return out_a, out_c

    def skip(self, n: int) -> None:
        a, c = self.jump(n)
        self.state = np.uint64((int(self.state) * a + c) % (1 << 64))

    def draws(self, n: int) -> np.ndarray:
        """The next n values, as unsigned 64-bit numbers."""
        a, c = np.array([LCG_MULTIPLIER], np.uint64), np.array([LCG_INCREMENT], np.uint64)
        with np.errstate(over="ignore"):
            while len(a) < n:
                a, c = np.concatenate([a, a * a[-1]]), np.concatenate([c, a * c[-1] + c])
            out = a[:n] * self.state + c[:n]
        if n:
            self.state = out[-1]
        return out

    def floats(self, n: int) -> np.ndarray:
        """Single precision in [0, 1)."""
        return (self.draws(n) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)


def signed(u: np.ndarray) -> np.ndarray:
    return u * np.float32(2) - np.float32(1)


def gaussian(u: np.ndarray) -> np.ndarray:
    """About normal: the sum of 12 uniforms (last axis) less 6, added up in single precision."""
    total = np.zeros(u.shape[:-1], np.float32)
    for i in range(12):
        total = total + u[..., i]
    return total - np.float32(6)


@dataclass(frozen=True)
class Noise:
    std: float = 0.01
    drift: float = 1e-4
    spike_probability: float = 0.0
    spike_magnitude: float = 0.0

    @classmethod
    def none(cls) -> Noise:
        return cls(0.0, 0.0, 0.0, 0.0)

    @classmethod
    def low(cls) -> Noise:
        return cls(0.005, 1e-5, 0.0, 0.0)

    @classmethod
    def high(cls) -> Noise:
        return cls(0.1, 0.001, 0.01, 1.0)


@dataclass(frozen=True)
class MockImu:
    """Inertial readings: a base, a sine on the acceleration, a random-walk bias, noise and spikes.

    Draws a sample: the bias steps (3 for accel, 3 for gyro, each only with drift), then for
    each of the six values 12 uniforms with noise, and with spikes 1, plus 1 if it fires.
    Without spikes the number is fixed, so tasks jump to their first sample; with spikes it
    depends on the draws, and one task walks them all. Bias walks restart from the sum of the
    block totals in every block of BLOCK samples, equal to the plain walk within the first.
    """

    hz: float = 100.0
    base_accel: tuple[float, float, float] = (0.0, 0.0, -9.81)
    base_gyro: tuple[float, float, float] = (0.0, 0.0, 0.0)
    frequency: float = 0.0
    amplitude: tuple[float, float, float] = (0.0, 0.0, 0.0)
    accel_noise: Noise = field(default_factory=Noise)
    gyro_noise: Noise = field(default_factory=Noise)
    seed: int = 42
    name: str = "mock_imu"

    def with_motion(self, frequency: float, amplitude: tuple[float, float, float]) -> MockImu:
        return replace(self, frequency=frequency, amplitude=amplitude)

    def with_noise(self, noise: Noise) -> MockImu:
        return replace(self, accel_noise=noise, gyro_noise=noise)

    @property
    def noises(self) -> tuple[Noise, Noise]:
        return self.accel_noise, self.gyro_noise

    @property
    def spiky(self) -> bool:
        return any(n.spike_probability > 0 for n in self.noises)

    @property
    def draws(self) -> int:
        """Draws a sample, without spikes."""
        return sum(3 * (n.drift > 0) + 36 * (n.std > 0) for n in self.noises)

    def info(self) -> dict:
        return {"name": self.name, "sample_rate_hz": self.hz, "sensor_type": "imu", "metadata": {"seed": str(self.seed)}}

    def samples(self, start: int, n: int) -> np.ndarray:
        """n x 6 single-precision values (accel, gyro) from a sample on."""
        if self.spiky:
            noise, steps = self._walked(start, n)
        else:
            u = Lcg(self.seed, start * self.draws).floats(n * self.draws).reshape(n, self.draws)
            steps, noise, at = np.zeros((n, 6), np.float32), np.zeros((n, 6), np.float32), 0
            for k, one in enumerate(self.noises):
                if one.drift > 0:
                    steps[:, 3 * k : 3 * k + 3] = signed(u[:, at : at + 3]) * np.float32(one.drift)
                    at += 3
            for k, one in enumerate(self.noises):
                if one.std > 0:
                    noise[:, 3 * k : 3 * k + 3] = gaussian(u[:, at : at + 36].reshape(n, 3, 12)) * np.float32(one.std)
                    at += 36
        bias = np.cumsum(steps, axis=0, dtype=np.float32) + self._bias_before(start)
        phase = np.cumsum(np.full(n, self.frequency / self.hz * math.tau)) + start * (self.frequency / self.hz * math.tau)
        motion = np.zeros((n, 6), np.float32)
        motion[:, :3] = np.sin(phase).astype(np.float32)[:, None] * np.array(self.amplitude, np.float32)
        return np.array([*self.base_accel, *self.base_gyro], np.float32) + motion + bias + noise

    def _bias_before(self, start: int) -> np.ndarray:
        total, at = np.zeros(6, np.float32), 0
        if self.spiky or not any(n.drift > 0 for n in self.noises):
            return total
        while at < start:
            n = min(BLOCK, start - at)
            # Only the bias draws of each sample matter here; the others are skipped by stride.
            u = Lcg(self.seed, at * self.draws).floats(n * self.draws).reshape(n, self.draws)
            k = 0
            for i, one in enumerate(self.noises):
                if one.drift > 0:
                    total[3 * i : 3 * i + 3] += np.cumsum(signed(u[:, k : k + 3]) * np.float32(one.drift), axis=0, dtype=np.float32)[-1]
                    k += 3
            at += n
        return total

    def _walked(self, start: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Draw by draw, from the first sample on."""
        if start:
            raise ReadFailed("a spiky sensor is read from its start")
        source = iter(self._stream())
        noise, steps = np.zeros((n, 6), np.float32), np.zeros((n, 6), np.float32)
        for i in range(n):
            for k, one in enumerate(self.noises):
                if one.drift > 0:
                    for j in range(3):
                        steps[i, 3 * k + j] = signed(next(source)) * np.float32(one.drift)
            for k, one in enumerate(self.noises):
                for j in range(3):
                    x = np.float32(0)
                    if one.std > 0:
                        x = gaussian(np.array([next(source) for _ in range(12)], np.float32)) * np.float32(one.std)
                    if one.spike_probability > 0 and next(source) < np.float32(one.spike_probability):
                        x = x + signed(next(source)) * np.float32(one.spike_magnitude)
                    noise[i, 3 * k + j] = x
        return noise, steps

    def _stream(self) -> Iterator[np.float32]:
        rng = Lcg(self.seed)
        while True:
            yield from rng.floats(4096)

    def read(self, spark: SparkSession, n: int) -> DataFrame:
        """timestamp_ns, seq, accel and gyro of the first n samples; blocks are drawn in parallel."""
        size = n if self.spiky else BLOCK
        parts = max(1, -(-n // size)) if n else 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in batch.column("id").to_pylist():
                    start = block * size
                    count = min(size, n - start)
                    if count > 0:
                        x = self.samples(start, count)
                        seq = np.arange(start, start + count)
                        vec = lambda at: pa.StructArray.from_arrays([pa.array(x[:, at + i]) for i in range(3)], ["x", "y", "z"])  # noqa: B023, E731
                        yield pa.RecordBatch.from_arrays([pa.array((seq * (1e9 / self.hz)).astype(np.int64)), pa.array(seq), vec(0), vec(3)], ["timestamp_ns", "seq", "accel", "gyro"])

        return spark.range(0, parts, 1, parts).mapInArrow(run, "timestamp_ns long, seq long, accel struct<x:float,y:float,z:float>, gyro struct<x:float,y:float,z:float>")


def sequence(spark: SparkSession, values: list, n: int, repeat: bool = False, hz: float = 100.0) -> DataFrame:
    """n pulls of a list: cycling with `repeat`, else its last value is held. An empty list can't be read."""
    if not values:
        raise ReadFailed("the sequence is empty")
    last = len(values) - 1
    at = F.col("id") % len(values) if repeat else F.least(F.col("id"), F.lit(last))
    items: Column = F.array(*map(F.lit, values))
    return spark.range(n).select((F.col("id") * int(1e9 / hz)).alias("timestamp_ns"), F.col("id").alias("seq"), F.get(items, at.cast("int")).alias("data"))


def from_function(spark: SparkSession, function: Callable[[int], float | None], n: int, hz: float = 100.0) -> DataFrame:
    """n stamped results of function(seq); readings for which it raises a SensorError or gives None are left out."""
    from gaugeworks.errors import SensorError

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, got = [], []
            for i in batch.column("id").to_pylist():
                try:
                    value = function(i)
                except SensorError:
                    continue
                if value is not None:
                    ids.append(i)
                    got.append(float(value))
            seq = np.array(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((seq * (1e9 / hz)).astype(np.int64)), pa.array(seq), pa.array(got, pa.float64())], ["timestamp_ns", "seq", "data"])

    return spark.range(n).mapInArrow(run, "timestamp_ns long, seq long, data double")


def demo_stream(spark: SparkSession, n: int) -> DataFrame:
    """Four sensors in turn around a slow sine: sensor_id, seq, timestamp_ns, value."""
    return spark.range(n).select((F.col("id") % 4).cast("int").alias("sensor_id"), F.col("id").alias("seq"), (F.col("id") * 1_000_000).alias("timestamp_ns"), (50 + 30 * F.sin(F.col("id") * 0.1)).alias("value"))


def barometer(spark: SparkSession, n: int, hz: float = 20.0) -> DataFrame:
    return spark.range(n).select((F.col("id") * int(1e9 / hz)).alias("timestamp_ns"), F.col("id").alias("seq"), (101325 + 100 * F.sin(F.col("id") * 0.1)).alias("pressure_pa"), (25 + 2 * F.cos(F.col("id") * 0.05)).alias("temperature_c"))


def sensor_info(spark: SparkSession, *infos: dict) -> DataFrame:
    return spark.createDataFrame([tuple(i.get(f.name) for f in schema.SENSOR_INFO.fields) for i in infos], schema.SENSOR_INFO)


def calibration_of(df: DataFrame, keys: tuple[str, ...], column: str) -> DataFrame:
    """Mean of a vector at rest by key: the bias to take off."""
    mean = F.struct(*(F.avg(f"{column}.{c}").alias(c) for c in "xyz"))
    return df.groupBy(*keys).agg(mean.alias(f"{column}_bias"))


@dataclass
class _Block(InputPartition):
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.imu, self.rows = _imu_of(options), int(options.get("rows", "1000"))

    def partitions(self) -> list[_Block]:
        size = self.rows if self.imu.spiky else BLOCK
        return [_Block(a, min(a + size, self.rows)) for a in range(0, self.rows, max(size, 1))]

    def read(self, partition: _Block) -> Iterator[tuple]:
        return _rows(self.imu, partition.start, partition.end)


class _StreamReader(SimpleDataSourceStreamReader):
    """Each trigger gives the next `batch` samples."""

    def __init__(self, options: dict[str, str]) -> None:
        self.imu, self.batch = _imu_of(options), int(options.get("batch", "100"))
        self.limit = int(options.get("rows", str(1 << 62)))

    def initialOffset(self) -> dict:
        return {"seq": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = min(start["seq"] + self.batch, self.limit)
        return iter(list(_rows(self.imu, start["seq"], end))), {"seq": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return _rows(self.imu, start["seq"], end["seq"])

    def commit(self, end: dict) -> None:
        pass


def _imu_of(options: dict[str, str]) -> MockImu:
    got = {k: json.loads(v) for k, v in options.items() if k in ("hz", "seed", "frequency")}
    noise = {"none": Noise.none, "low": Noise.low, "high": Noise.high, "default": Noise}[options.get("noise", "default")]()
    imu = MockImu(**got).with_noise(noise)
    return replace(imu, amplitude=tuple(json.loads(options["amplitude"]))) if "amplitude" in options else imu


def _rows(imu: MockImu, start: int, end: int) -> Iterator[tuple]:
    if end > start:
        x = imu.samples(start, end - start).astype(float)
        for i, r in enumerate(x.tolist(), start):
            yield int(i * (1e9 / imu.hz)), i, tuple(r[:3]), tuple(r[3:])


class ImuDataSource(DataSource):
    """spark.read / readStream.format("mock_imu"); options rows, batch, hz, seed, frequency, amplitude (JSON list), noise."""

    @classmethod
    def name(cls) -> str:
        return "mock_imu"

    def schema(self) -> str:
        return "timestamp_ns long, seq long, accel struct<x:float,y:float,z:float>, gyro struct<x:float,y:float,z:float>"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001, ARG002
        return _Reader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: ANN001, ARG002
        return _StreamReader(self.options)
