"""What a read of parquet parts for a box would cost: row groups by their footers' statistics.

Spark prunes row groups by itself; this says, before anything is read, how much that saves. Footers are read by the executors,
one task for some files; data pages are not touched. Paths must be such that an executor can open them (local or mounted, or any
file system that pyarrow knows by the path's scheme).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.shipping import ship

GROUP = "path string, part int, first_row long, rows long, south double, west double, north double, east double, all_bytes long, wanted_bytes long"
SIDES = {"west": ("xmin", "min"), "east": ("xmax", "max"), "south": ("ymin", "min"), "north": ("ymax", "max")}
WORLD = {"south": -90.0, "west": -180.0, "north": 90.0, "east": 180.0}


def footer_groups(path: str, columns: list[str], box: str = "bbox") -> pd.DataFrame:
    """The row groups of one file. Where a side's statistics are missing the group may be anywhere, so it covers the world."""
    from pyarrow import fs
    from pyarrow.parquet import ParquetFile

    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    rows, first = [], 0
    with system.open_input_file(name) as file:
        footer = ParquetFile(file).metadata
    for at in range(footer.num_row_groups):
        group = footer.row_group(at)
        leaves = [group.column(k) for k in range(group.num_columns)]
        known = {leaf.path_in_schema: leaf.statistics for leaf in leaves if leaf.is_stats_set and leaf.statistics.has_min_max}
        sides = {}
        for side, (leaf, which) in SIDES.items():
            stats = known.get(f"{box}.{leaf}")
            sides[side] = None if stats is None else float(getattr(stats, which))
        if None in sides.values():
            sides = WORLD
        wanted = sum(leaf.total_compressed_size for leaf in leaves if leaf.path_in_schema.split(".")[0] in columns)
        rows.append((path, at, first, group.num_rows, *(sides[s] for s in ("south", "west", "north", "east")), group.total_byte_size, wanted))
        first += group.num_rows
    return pd.DataFrame(rows, columns=[c.split()[0] for c in GROUP.split(", ")])


def row_groups(paths: DataFrame, columns: list[str], box: str = "bbox") -> DataFrame:
    """Row groups of the files named by ``path``: place, rows, extent, bytes of all and of the wanted columns."""
    ship(paths.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                yield footer_groups(path, columns, box)

    return paths.select("path").mapInPandas(run, GROUP)


def planned_read(groups: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """path, groups, rows and how many of each a read of the box touches, with the bytes of the wanted and of all columns."""
    met = (F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south)
    touched = lambda c: F.coalesce(F.sum(F.when(met, F.col(c))), F.lit(0)).cast("long")
    return groups.groupBy("path").agg(
        F.count("*").alias("groups"), F.sum("rows").alias("rows"), F.count_if(met).alias("touched_groups"), touched("rows").alias("touched_rows"), touched("wanted_bytes").alias("planned_bytes"), touched("all_bytes").alias("planned_bytes_all"),
    )


def checked_rows(rows: DataFrame, expected: int) -> DataFrame:
    """``rows``, or an error if there are not as many as the footers promise."""
    counted = rows.count()
    if counted != expected:
        raise ValueError(f"read {counted} rows, the footers promise {expected}")
    return rows
