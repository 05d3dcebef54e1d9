"""Rows and paths that several test files share."""

import datetime as dt

from faultline.schemas import LOG_SCHEMA

SF_SMALL = "/root/testdata/sf0.001"
LOG_DDL = ("LineId bigint, Date string, Time string, Pid bigint, Level string, Component string, "
           "Content string, EventId string, EventTemplate string, pos bigint")


def log_frame(spark, rows):
    """Rows in schema order; the list position becomes the ingest position."""
    assert len(LOG_SCHEMA) == 9
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], LOG_DDL)


FOUR = [
    (1, "081109", "203615", 143, "INFO", "dfs.A", "Receiving block blk_1", "E1", "t1"),
    (2, "081109", "203616", 143, "ERROR", "dfs.B", "Heartbeat block failed", "E2", "t2"),
    (3, "081109", "204010", 35, "warning", "dfs.A", "Connection timeout", "E3", "t3"),
    (4, "081109", "204011", 36, "FATAL", "dfs.C", "disk volume failure", "E4", "t4"),
]


def storm_rows():
    """433 lines over 40 minutes: routine chatter, one heartbeat storm, one burst of resets."""
    rows, start = [], dt.datetime(2008, 11, 9, 20)

    def add(when, level, content, pid):
        n = len(rows) + 1
        rows.append((n, when.strftime("%y%m%d"), when.strftime("%H%M%S"), pid, level, "dfs.DataNode",
                     content.replace("#", str(n)), "E1", "t"))

    for minute in range(40):
        for sec in range(0, 60, 6):
            add(start + dt.timedelta(minutes=minute, seconds=sec), "INFO",
                "PacketResponder 1 for block blk_# terminating", 100 + sec)
    for k in range(25):
        add(start + dt.timedelta(minutes=25, seconds=2 * k), "ERROR",
            f"Lost heartbeat from datanode 10.0.0.{k} block blk_#", 300 + k)
    for k in range(8):
        add(start + dt.timedelta(minutes=10, seconds=5 * k), "WARN",
            f"Connection reset by peer 10.0.0.{k}", 200 + k)
    return rows


def feature_rows(normal=60, spikes=3, seed=0):
    """Window features: `normal` quiet rows and `spikes` heartbeat-led spikes, one per minute."""
    import numpy as np

    from faultline.constants import FEATURES
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(normal + spikes):
        if i < normal:
            n, e = int(rng.integers(80, 120)), int(rng.integers(0, 3))
            v = [n, e, int(rng.integers(0, 4)), n - e, 0, 0, 0, 0, 0, 0, 5, int(rng.integers(8, 12)),
                 int(rng.integers(10, 15)), e / n, 0.02, 0.0]
        else:
            v = [900, 300, 150, 450, 20, 200, 10, 5, 5, 2, 12, 40, 60, 0.33, 0.17, 0.02]
        rows.append((dt.datetime(2008, 11, 9, 20) + dt.timedelta(minutes=i), *map(float, v)))
    return rows, "time_window timestamp_ntz, " + ", ".join(f"{c} double" for c in FEATURES)
