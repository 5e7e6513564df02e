"""Change detection between two listings of a directory."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Manifest = dict[str, tuple[int, int]]


@dataclass
class ChangeSummary:
    added: int = 0
    modified: int = 0
    deleted: int = 0
    reread: int = 0

    def to_dict(self) -> dict[str, int]:
        return asdict(self)

    def __getitem__(self, name: str) -> int:
        return getattr(self, name)


@dataclass
class Changes:
    added: list[str] = field(default_factory=list)
    modified: list[str] = field(default_factory=list)
    deleted: list[str] = field(default_factory=list)

    def __bool__(self) -> bool:
        return bool(self.added or self.modified or self.deleted)

    def summary(self, reread: int = 0) -> ChangeSummary:
        return ChangeSummary(len(self.added), len(self.modified), len(self.deleted), reread)


def diff_manifests(old: Manifest, new: Manifest) -> Changes:
    return Changes(sorted(new.keys() - old.keys()), sorted(n for n in new.keys() & old.keys() if new[n] != old[n]), sorted(old.keys() - new.keys()))


def diff_frames(old: DataFrame, new: DataFrame, name: str = "file_name", signature: tuple[str, ...] = ("mtime", "size")) -> DataFrame:
    """(file_name, change) for manifests that are tables themselves: one full outer join."""
    o, n = (f.select(F.col(name).alias(f"_{k}"), F.struct(*signature).alias(f"_{k}_sig")) for k, f in (("o", old), ("n", new)))
    both = o.join(n, F.col("_o") == F.col("_n"), "full_outer")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "deleted").when(~F.col("_o_sig").eqNullSafe(F.col("_n_sig")), "modified")
    return both.select(F.coalesce("_n", "_o").alias(name), change.alias("change")).where("change is not null")
