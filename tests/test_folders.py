import os
import random
from datetime import datetime, timedelta

import pytest

from marlstone.streaming import folders, streams
from tests.test_keyed_state import START, base, drain  # noqa: F401


def seconds(n):
    return START + timedelta(seconds=n)


def simulated(scans, debounce, absence):
    """The changes, told second by second."""
    out, state = [], {}
    for now in range(0, max(scans) + 1):
        listed = scans.get(now)
        for path, s in state.items():
            if s["wait"] is not None and now == s["since"] + debounce and now <= s["last"] + absence and not (listed is not None and debounce == 0):
                tell(out, path, s, now)
            if s["last"] + absence + 1 == now:
                if s["told"] is not None and not s["gone"]:
                    out.append((path, "deleted", None, s["last"] + absence))
                    s["gone"] = True
                s["wait"] = None
        for path, modified in (listed or {}).items():
            s = state.setdefault(path, {"told": None, "gone": False, "wait": None, "since": None, "last": None})
            s["last"] = now
            if s["wait"] is not None and modified != s["wait"] or s["wait"] is None and (s["gone"] or s["told"] is None or modified > s["told"]):
                s["wait"], s["since"] = modified, now
                if debounce == 0:
                    tell(out, path, s, now)
    return out


def tell(out, path, s, now):
    if s["gone"] or s["told"] is None or s["wait"] > s["told"]:
        out.append((path, "returning" if s["gone"] else "new" if s["told"] is None else "changed", s["wait"], now))
    s["told"], s["gone"], s["wait"] = s["wait"], False, None


def listed(spark, scans):
    rows = [(p, seconds(m), seconds(at)) for at, files in scans.items() for p, m in files.items()] + [("", None, seconds(at)) for at in scans]
    return spark.createDataFrame(rows + [(None, seconds(1), seconds(max(scans))), ("nodate", None, seconds(max(scans)))], folders.SCAN_SCHEMA)


@pytest.mark.parametrize("debounce,absence,each", [(0, 10, 1), (15, 25, 3)])
def test_changes_over_restarts_equal_a_simulation(spark, base, debounce, absence, each):  # noqa: F811
    rng = random.Random(debounce)
    scans, there = {}, {}
    for n in range(12):
        for p in "abcdef":
            if rng.random() < 0.35:
                there.pop(p, None)
            elif rng.random() < 0.5:
                there[p] = n * 10
        scans[n * 10] = dict(there)
    scans.update({300: {}, 400: {}, 500: {}})  # all are gone; time goes on
    source = streams.file_stream(spark, f"{base}/in/*", folders.SCAN_SCHEMA, max_files=1)
    times = list(scans)
    for n in range(0, len(times), each):  # each run goes on from the checkpoint of the one before
        listed(spark, {t: scans[t] for t in times[n : n + each]}).coalesce(1).write.parquet(f"{base}/in/{n}")
        if n % 2 == 0 or n + each >= len(times):
            got = drain(folders.changes(source, debounce, absence), base, "folder", "append")
    plain = [(r.path, r.change, r.modified and int((r.modified - START).total_seconds()), int((r.at - START).total_seconds())) for r in got.collect()]
    want = simulated(scans, debounce, absence)
    assert sorted(plain, key=repr) == sorted(want, key=repr)
    assert {c for _, c, _, _ in want} == {"new", "changed", "returning", "deleted"}


def test_a_real_folder(spark, base, tmp_path):  # noqa: F811
    folder = tmp_path / "notes"
    folder.mkdir()
    source = streams.file_stream(spark, f"{base}/log/*", folders.SCAN_SCHEMA, max_files=1)

    def put(name, when):
        (folder / name).write_text(str(when))
        os.utime(folder / name, (1_700_000_000 + when, 1_700_000_000 + when))

    steps = [lambda: (put("a.md", 1), put("b.md", 1), put("c.txt", 1)), lambda: put("a.md", 5), lambda: (folder / "b.md").unlink(), lambda: put("b.md", 9), lambda: None, lambda: None]
    for n, step in enumerate(steps):
        step()
        folders.scan(spark, f"file://{folder}", datetime(2024, 1, 1, 0, n), "*.md").coalesce(1).write.parquet(f"{base}/log/{n}")
        got = drain(folders.changes(source, 0, 60), base, "real", "append")
    names = [(r.path.split("/")[-1], r.change) for r in got.orderBy("at", "path").collect()]
    assert names == [("a.md", "new"), ("b.md", "new"), ("a.md", "changed"), ("b.md", "deleted"), ("b.md", "returning")]
