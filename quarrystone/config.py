"""Settings of the store, with defaults and bounds."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields
from pathlib import Path

# Sizes and constants of the stored formats.
BLOCK_SIZE = 1 << 20
PACK_HEADER, INDEX_ENTRY = 32, 40
PACK_MAGIC = b"VPK2"
VAULT_DOMAIN = 0xA7
SCAN_BATCH = 50_000
KIND_FILE, KIND_DIR, KIND_SYMLINK = 1, 2, 3
FLAG_READONLY, FLAG_VAULT, FLAG_VAULT_ROOT = 1, 2, 4
ROOT_INO, SNAPSHOTS_INO, VAULT_INO = 1, 2, 3
PACK_FOLDERS = ("A", "B", "C", "D", "E", "F")


@dataclass(frozen=True)
class Settings:
    """Values outside their bounds are refused; unknown keys of a file are ignored.

    Names, defaults and bounds are those of the store's TOML file.  Keys that only the kernel interface,
    caches or a key derivation without counterpart would use are accepted and not kept.
    """

    # Keys and defaults of the file.
    sync_interval_ms: int = 5_000
    batch_max_size_mb: int = 512
    batch_flush_interval_ms: int = 500
    pack_max_size_mb: int = 10_240
    zstd_compression_level: int = 3
    ultracdc_min_size_bytes: int = 16 * 1024
    ultracdc_avg_size_bytes: int = 32 * 1024
    ultracdc_max_size_bytes: int = 64 * 1024
    gc_idle_min_ms: int = 15_000
    gc_pack_rewrite_min_reclaim_bytes: int = 64 * 1024 * 1024
    gc_pack_rewrite_min_reclaim_percent: float = 25.0
    gc_discard_filename: str = ".DISCARD"
    vault_enabled: bool = True
    block_size: int = BLOCK_SIZE

    def __post_init__(self):
        for name in ("sync_interval_ms", "batch_max_size_mb", "batch_flush_interval_ms", "pack_max_size_mb", "gc_idle_min_ms", "gc_pack_rewrite_min_reclaim_bytes", "block_size"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be over 0")
        if not -7 <= self.zstd_compression_level <= 22:
            raise ValueError("zstd_compression_level must be from -7 to 22")
        if not 0 < self.ultracdc_min_size_bytes <= self.ultracdc_avg_size_bytes <= self.ultracdc_max_size_bytes:
            raise ValueError("ultracdc sizes must rise: 0 < min <= avg <= max")
        if not 0 <= self.gc_pack_rewrite_min_reclaim_percent <= 100:
            raise ValueError("gc_pack_rewrite_min_reclaim_percent must be from 0 to 100")
        if not self.gc_discard_filename:
            raise ValueError("gc_discard_filename must not be empty")

    @classmethod
    def load(cls, path: str | Path) -> Settings:
        with open(path, encoding="utf-8") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, text: str) -> Settings:
        given = tomllib.loads(text)
        return cls(**{k: v for k, v in given.items() if k in {x.name for x in fields(cls)}})


def refused_setting(text: str) -> str:
    """The setting that a settings file is refused for; empty if it is accepted."""
    try:
        Settings.parse(text)
    except ValueError as e:
        return str(e).split(" ")[0]
    return ""
