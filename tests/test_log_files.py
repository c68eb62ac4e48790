"""Log files read in many tasks against the parse of whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from clearbrook.operators import logs
from clearbrook.sources.tables import read_log_lines

FIELDS = ["entry_id", "timestamp", "level", "source", "message", "line_number"]


def log_text(seed: int) -> str:
    rng, out = random.Random(seed), ["no entry yet"] * (seed % 2)
    for i in range(rng.randint(1, 12)):
        out.append(f"{' ' * rng.randint(0, 2)}2024-01-{i + 1:02d} 08:0{i % 10}:00 [{rng.choice(['INFO', 'WARN'])}] {rng.choice(['LAB-RESULT', 'A B'])}: " + rng.choice(["-", "one", "x: y | z: 1"]))
        out += [rng.choice(["", "  more of it", "\tät 09:30: said", "2024-01-01 without a level", "last \r"]) for _ in range(rng.randint(0, 4))]
    return "\n".join(out) + "\n" * rng.randint(0, 3)


@pytest.mark.parametrize("size", [17, 90, 1 << 20])
def test_files_cut_anywhere_give_the_entries_of_the_whole(spark, tmp_path, size):
    texts = {f"f{i}.log": log_text(i) for i in range(12)} | {"raw.log": "plain\n\n two words \nthree", "empty.log": "", "head.log": "2024-01-01 08:00:00 [INFO] S: only"}
    for name, t in texts.items():
        (tmp_path / name).write_text(t, newline="")
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        lines = read_log_lines(spark, str(tmp_path))
        got = logs.parse_lines(lines).withColumn("file", F.regexp_extract("file", "[^/]+$", 0)).collect()
        blocks = lines.select("file", "block").distinct().count()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert blocks > 60 if size == 17 else blocks > 14 if size == 90 else blocks <= 15
    whole = logs.parse_entries(spark.createDataFrame(list(texts.items()), "file string, text string"), "file").collect()
    row = lambda r: (r.file, *[r[f] for f in FIELDS])
    assert sorted(map(str, map(row, got))) == sorted(map(str, map(row, whole))) and len(whole) > 60
