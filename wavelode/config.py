"""Settings of an encoder: checked when made, changed by ``dataclasses.replace``."""

from __future__ import annotations

from dataclasses import dataclass

# What the options may be.
APPLICATIONS = {"voip": 2048, "audio": 2049, "restricted_lowdelay": 2051}
BANDWIDTHS = ("Narrowband", "Mediumband", "Wideband", "Superwideband", "Fullband")
RATES = (8000, 12000, 16000, 24000, 48000)


@dataclass(frozen=True)
class EncoderConfig:
    bitrate: int = 24_000
    channels: int = 1
    complexity: int = 5
    vbr: bool = False
    constrained_vbr: bool = True
    loss_percent: int = 0
    max_bandwidth: str = "Fullband"
    bandwidth: str | None = None
    application: str = "audio"

    def __post_init__(self) -> None:
        checks = (
            (6_000 <= self.bitrate <= 510_000, "bitrate"),
            (self.channels in (1, 2), "channels"),
            (0 <= self.complexity <= 10, "complexity"),
            (0 <= self.loss_percent <= 100, "loss_percent"),
            (self.max_bandwidth in BANDWIDTHS, "max_bandwidth"),
            (self.bandwidth is None or self.bandwidth in BANDWIDTHS, "bandwidth"),
            (self.application in APPLICATIONS, "application"),
        )
        for good, name in checks:
            if not good:
                raise ValueError(f"{name} is out of range: {getattr(self, name)!r}")

    @property
    def frame_bytes(self) -> int:
        """Bytes of a 20 ms frame without its TOC byte."""
        return self.bitrate // 400 - 1

    def equivalent_rate(self) -> int:
        """The rate of variable bit rate at full complexity that sounds alike."""
        rate = self.bitrate if self.vbr else self.bitrate - self.bitrate // 12
        return rate * (90 + self.complexity) // 100

    def threshold_rate(self) -> int:
        """The equivalent rate that stereo width and mode are told by: at low complexity, without a pitch filter, a tenth less."""
        rate = self.equivalent_rate()
        return rate if self.complexity >= 5 else rate * 9 // 10

    def chosen_bandwidth(self) -> str:
        """By rate a channel, and no more than the largest allowed; or as set."""
        if self.bandwidth:
            return self.bandwidth
        rate = self.bitrate // self.channels
        best = "Narrowband" if rate < 9_000 else "Wideband" if rate < 13_500 else "Superwideband" if rate < 14_000 else "Fullband"
        return BANDWIDTHS[min(BANDWIDTHS.index(best), BANDWIDTHS.index(self.max_bandwidth))]


@dataclass(frozen=True)
class DecoderConfig:
    sample_rate: int = 48_000
    channels: int = 2

    def __post_init__(self) -> None:
        if self.sample_rate not in RATES or self.channels not in (1, 2):
            raise ValueError(f"no such output: {self.sample_rate} Hz, {self.channels} channels")

    def check_lost(self, samples: int) -> None:
        """What is lost is concealed by frames of 20 ms: ``samples`` of all channels."""
        if samples != self.sample_rate // 50 * self.channels:
            raise ValueError(f"a lost frame has {self.sample_rate // 50 * self.channels} samples, not {samples}")
