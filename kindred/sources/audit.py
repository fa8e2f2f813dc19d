"""Log lines with a level gate, and audit events as lines or as rows of a table."""

from __future__ import annotations

import datetime
import os
import sys
from collections.abc import Mapping
from typing import TextIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Level names in order; another name counts as info.
LEVELS = ("debug", "info", "warn", "error")


def level(name: str) -> int:
    return LEVELS.index(name) if name in LEVELS else LEVELS.index("info")


def audit_line(event: str, session: str, details: Mapping[str, object], time: str | None = None) -> str:
    """AUDIT_EVENT, TIMESTAMP (UTC) and SESSION, then the details as key=value in order of their keys."""
    stamp = time or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = f"AUDIT_EVENT={event} TIMESTAMP={stamp} SESSION={session}"
    return " ".join([head, *(f"{k}={details[k]}" for k in sorted(details))])


def audit_lines(df: DataFrame, event: Column, time: Column, session: str, details: list[str]) -> Column:
    """The same of every row, as an expression: details are columns, null ones left out."""
    stamp = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    told = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in sorted(details)]
    return F.concat_ws(" ", F.concat(F.lit("AUDIT_EVENT="), event), F.concat(F.lit("TIMESTAMP="), stamp), F.lit(f"SESSION={session}"), *told)


def append_audit(spark: SparkSession, path: str, rows: list[tuple[str, str, Mapping[str, object]]], session: str) -> None:
    """Append events (name, time, details) to a table of audit rows."""
    held = [(e, t, session, {k: str(v) for k, v in d.items()}) for e, t, d in rows]
    spark.createDataFrame(held, "event string, time string, session string, details map<string,string>").write.mode("append").parquet(path)


class Logger:
    """Lines to a file or standard output from a level on; audit lines to a file of their own, and here as warnings.

    settings: the logging part of a configuration (level, file, enable_audit, audit_file).
    """

    def __init__(self, settings, session: str, out: TextIO | None = None):
        self.session, self.level = session, level(settings.level)
        self.out = out or (self._opened(settings.file) if settings.file else sys.stdout)
        self.audit_out = self._opened(settings.audit_file or "audit.log") if settings.enable_audit else None

    @staticmethod
    def _opened(path: str) -> TextIO:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        return open(path, "a", buffering=1)

    def log(self, name: str, message: str) -> None:
        if level(name) >= self.level:
            self.out.write(f"[KINDRED-{self.session}] [{name.upper()}] {message}\n")

    def debug(self, message: str) -> None:
        self.log("debug", message)

    def info(self, message: str) -> None:
        self.log("info", message)

    def warn(self, message: str) -> None:
        self.log("warn", message)

    def error(self, message: str) -> None:
        self.log("error", message)

    def audit(self, event: str, details: Mapping[str, object]) -> None:
        line = audit_line(event, self.session, details)
        if self.audit_out:
            self.audit_out.write(f"[AUDIT-{self.session}] {line}\n")
        if level("warn") >= self.level:
            self.out.write(f"[KINDRED-{self.session}] [AUDIT] {line}\n")

    def close(self) -> None:
        for f in (self.out, self.audit_out):
            if f not in (None, sys.stdout):
                f.close()
