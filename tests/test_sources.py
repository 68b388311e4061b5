import math
from dataclasses import replace

import numpy as np
import pytest

from gaugeworks.errors import InvalidData, PipelineError, ReadFailed, SensorError
from gaugeworks.sources import sensors
from gaugeworks.sources.sensors import BLOCK, ImuDataSource, Lcg, MockImu, Noise


class Plain:
    """The generator with Python's whole numbers."""

    def __init__(self, seed):
        self.state = (seed + 1) % 2**64

    def next(self):
        self.state = (self.state * sensors.LCG_MULTIPLIER + sensors.LCG_INCREMENT) % 2**64
        return self.state

    def f32(self):
        return np.float32(self.next() >> 40) / np.float32(1 << 24)

    def signed(self):
        return self.f32() * np.float32(2) - np.float32(1)

    def gaussian(self):
        total = np.float32(0)
        for _ in range(12):
            total = total + self.f32()
        return total - np.float32(6)


def test_generator():
    plain, rng = Plain(42), Lcg(42)
    assert [plain.next() for _ in range(100)] == rng.draws(60).tolist() + rng.draws(40).tolist()
    late = Lcg(42, 70)
    plain = Plain(42)
    assert [plain.next() for _ in range(75)][70:] == late.draws(5).tolist()
    assert len(rng.draws(0)) == 0


def by_hand(imu, n):
    """Sample after sample, draw after draw."""
    rng, bias, phase, out = Plain(imu.seed), np.zeros(6, np.float32), 0.0, []
    for _ in range(n):
        phase += imu.frequency / imu.hz * math.tau
        for k, noise in enumerate(imu.noises):
            if noise.drift > 0:
                for j in range(3):
                    bias[3 * k + j] += rng.signed() * np.float32(noise.drift)
        x = []
        for k, noise in enumerate(imu.noises):
            for _ in range(3):
                v = np.float32(0)
                if noise.std > 0:
                    v = v + rng.gaussian() * np.float32(noise.std)
                if noise.spike_probability > 0 and rng.f32() < np.float32(noise.spike_probability):
                    v = v + rng.signed() * np.float32(noise.spike_magnitude)
                x.append(v)
        motion = np.array([*(np.float32(a) * np.float32(math.sin(phase)) for a in imu.amplitude), 0, 0, 0], np.float32)
        out.append(np.array([*imu.base_accel, *imu.base_gyro], np.float32) + motion + bias + np.array(x, np.float32))
    return np.array(out)


@pytest.mark.parametrize("noise", [Noise(), Noise.none(), Noise.low(), Noise.high(), Noise(0.0, 0.1, 0.5, 2.0)])
def test_samples(noise):
    imu = MockImu(seed=7).with_motion(1.0, (0.5, 0.0, 0.2)).with_noise(noise)
    assert np.allclose(imu.samples(0, 200), by_hand(imu, 200), atol=1e-5)


def test_noise_of_one_side_only():
    imu = replace(MockImu(), gyro_noise=Noise.none())
    assert np.allclose(imu.samples(0, 50), by_hand(imu, 50), atol=1e-6)
    assert imu.draws == 39


def test_blocks_are_one_stream(spark, monkeypatch):
    monkeypatch.setattr(sensors, "BLOCK", 64)
    imu = MockImu()
    rows = imu.read(spark, 200).orderBy("seq").collect()
    got = np.array([[*r.accel, *r.gyro] for r in rows])
    assert np.allclose(got, by_hand(imu, 200), atol=1e-4)
    assert [r.timestamp_ns for r in rows[:3]] == [0, 10**7, 2 * 10**7]
    assert imu.read(spark, 0).count() == 0 and BLOCK == 1 << 16


def test_spiky_sensors_are_read_from_the_start():
    with pytest.raises(ReadFailed):
        MockImu().with_noise(Noise.high()).samples(5, 5)


def test_sequences(spark):
    pull = lambda *a, **k: [r.data for r in sensors.sequence(spark, *a, **k).orderBy("seq").collect()]
    assert pull([1, 2, 3, 4, 5], 6) == [1, 2, 3, 4, 5, 5]
    assert pull([1, 2, 3], 5, repeat=True) == [1, 2, 3, 1, 2]
    with pytest.raises(ReadFailed):
        pull([], 1)


def test_function_source(spark):
    def read(i):
        if i == 2:
            raise InvalidData
        return None if i == 3 else i * 1.5

    assert [(r.seq, r.data) for r in sensors.from_function(spark, read, 5).orderBy("seq").collect()] == [(0, 0), (1, 1.5), (4, 6)]
    assert issubclass(ReadFailed, SensorError) and issubclass(SensorError, PipelineError)


def test_data_source(spark):
    spark.dataSource.register(ImuDataSource)
    got = spark.read.format("mock_imu").option("rows", "300").option("noise", "low").load().orderBy("seq").collect()
    assert np.allclose([[*r.accel, *r.gyro] for r in got], MockImu().with_noise(Noise.low()).samples(0, 300), atol=1e-6)


def test_info_and_bias(spark):
    info = sensors.sensor_info(spark, MockImu().info()).first()
    assert info.metadata["seed"] == "42" and info.sample_rate_hz == 100
    rows = MockImu(base_accel=(1.0, 2.0, 3.0)).with_noise(Noise.none()).read(spark, 10)
    bias = sensors.calibration_of(rows, (), "accel").first().accel_bias
    assert tuple(bias) == (1, 2, 3)
    assert sensors.demo_stream(spark, 8).filter("sensor_id = 3").count() == 2 and sensors.barometer(spark, 5).count() == 5
