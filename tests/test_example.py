"""The README example, end to end on files: timeline text (S4) and a meter
CSV (S11) to phase times (A4) and phase energy (A5)."""

import os

from pyspark.sql import functions as F

from bootlens.operators import meter, timeline as tl
from bootlens.sources.files import read_samples
from bootlens.sources.timeline import read_timeline

LOG = ["2024-01-01 09:00:00|1704099600.000000000|7|--Start--|",
       "2024-01-01 09:00:00|1704099600.100000000|7|exec_run alloc:end bmcid=C1 node=3|",
       "2024-01-01 09:00:01|1704099601.000000000|7|C1 poweron:begin|",
       "2024-01-01 09:00:09|1704099609.000000000|7|exec_run poweron:end|"]
WATT = ["ts,source,value", "2024-01-01 09:00:02,C1,10", "2024-01-01 09:00:05,C1,12", "2024-01-01 09:00:08,C1,14"]


def test_readme_example(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/logs/h1")
    os.makedirs(f"{tmp_dir}/watt")
    with open(f"{tmp_dir}/logs/h1/time.log", "w") as f:
        f.write("\n".join(LOG) + "\n")
    with open(f"{tmp_dir}/watt/w.csv", "w") as f:
        f.write("\n".join(WATT) + "\n")
    lines = read_timeline(spark, f"{tmp_dir}/logs/*/time.log")
    intervals = tl.intervals_from_timeline(lines)
    times = {(r.bmc_id, r.phase): (r.n_closed, r.total_sec) for r in tl.phase_times(intervals).collect()}
    assert times[("C1", "poweron")] == (1, 8.0)
    watts = read_samples(spark, f"{tmp_dir}/watt/")
    samples = watts.select(F.col("source").alias("bmc_id"), (F.unix_micros("ts") * 1000).alias("epoch_ns"),
                           F.monotonically_increasing_id().alias("seq"), "value")
    e = meter.phase_energy(intervals, samples, delay=0.0, floor=1.0).collect()
    assert [(r.bmc_id, r.phase, r.n_samples, r.joule, r.watt) for r in e] == [("C1", "poweron", 3, 72.0, 9.0)]
