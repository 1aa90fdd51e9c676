"""Event logs: their rows, the last ones, levels, redaction, progress, files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ("debug", "info", "warn", "error")
# Size at which a log is set aside, and files kept, the open one too.
MAX_BYTES, MAX_FILES = 5 * 1024 * 1024, 5


def event(level: Column, feature: Column, route: Column, stage: Column, action: Column, message: Column, run_id: Column | None = None, error_code: Column | None = None, error_chain: Column | None = None) -> Column:
    """A row of a log as a struct; what is not given is null, its time is now."""
    none = F.lit(None).cast("string")
    optional = {"run_id": run_id, "error_code": error_code, "error_chain": error_chain}
    return F.struct(
        F.current_timestamp().alias("timestamp"), level.alias("level"), feature.alias("feature"), route.alias("route"), stage.alias("stage"), action.alias("action"), message.alias("message"), *[(none if c is None else c).alias(k) for k, c in optional.items()]
    )


def last_events(events: DataFrame, n: int = 2_000, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The n newest.  A sort with a limit, so no task holds more than n rows."""
    return events.orderBy(*[F.desc(c) for c in order]).limit(n)


def last_events_by(events: DataFrame, key: str, n: int, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def level(name: Column) -> Column:
    """A known level, spelt just so; else info."""
    return F.when(name.isin("error", "warn", "debug"), name).otherwise(F.lit("info"))


def redacted(message: Column) -> Column:
    """Absolute paths below the folders that tell of a user replaced."""
    return F.regexp_replace(message, r"/(?:Users|Volumes|private|tmp)/[^\s,;)]+", "[path]")


def line_class(message: Column) -> Column:
    return F.when(F.contains(message, F.lit("→ Good")), "good").when(F.contains(message, F.lit("→ Rejected")), "rejected").otherwise("other")


def error_code(message: Column) -> Column:
    return F.substring_index(message, ":", 1)


def percent(done: Column, total: Column) -> Column:
    """0 to 100; 0 of nothing."""
    return F.when(total == 0, F.lit(0)).otherwise(F.least(F.lit(100), F.round(100 * done / F.when(total != 0, total)).cast("int")))


def rotate(folder: str | Path, name: str, most_bytes: int = MAX_BYTES, files: int = MAX_FILES) -> bool:
    """Sets a log of at least ``most_bytes`` aside as name.1, after moving each
    older one a number up and dropping the last; whether it did."""
    current = Path(folder) / name
    if not current.exists() or current.stat().st_size < most_bytes:
        return False
    aged = lambda n: current.with_name(f"{name}.{n}")
    aged(files - 1).unlink(missing_ok=True)
    for n in reversed(range(1, files - 1)):
        if aged(n).exists():
            aged(n).rename(aged(n + 1))
    current.rename(aged(1))
    return True


def clear(folder: str | Path, name: str) -> int:
    """Removes a log and those set aside, by the start of their names; how many."""
    found = [f for f in Path(folder).glob("*") if f.is_file() and f.name.startswith(name)]
    for f in found:
        f.unlink()
    return len(found)
