"""Versioned tables: commits, conflicts, old readers; growing logs; listings."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from bootlens.operators import changes as chg
from bootlens.sources import files as sf, tail, versions as vs
from bootlens.streaming import boot as st


def _kernels(spark, n):
    return spark.range(1, n + 1).select(F.col("id").alias("kernel_id"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("kernel_name"),
                                        F.lit("f").alias("kernel_file"), F.lit("p").alias("kernel_param"))


def test_two_writers_on_one_base(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    assert vs.create(path, _kernels(spark, 40), "kernel_name", "kernel_id", buckets=8) == 0
    old = vs.read(spark, path)
    names = lambda *x: spark.createDataFrame([(v,) for v in x], "kernel_name string")
    delete = lambda rows, ch, top: chg.delete_by_name(rows, ch, "kernel_name")[0]
    assert vs.commit(path, 0, names("k40", "k7"), delete) == 1
    with pytest.raises(vs.VersionConflict):
        vs.commit(path, 0, names("k1"), delete)
    assert vs.versions(spark, path) == [0, 1]
    assert old.count() == vs.read(spark, path, 0).count() == 40 and vs.read(spark, path).count() == 38
    ch = spark.createDataFrame([("new", "g"), ("k3", "h")], "kernel_name string, kernel_file string")
    assert vs.commit(path, 1, ch, lambda rows, c, top: chg.apply_upsert(rows, c, "kernel_name", "kernel_id", highest=top)) == 2
    got = {r.kernel_name: (r.kernel_id, r.kernel_file, r.kernel_param) for r in vs.read(spark, path).collect()}
    assert got["new"] == (41, "g", "") and got["k3"] == (3, "h", "p") and len(got) == 39   # 40 is not given again
    a, b = (vs._manifest(spark, path, v)["files"] for v in (1, 2))
    assert sum(a[x] != b[x] for x in a) <= 2 < len(a)   # only touched buckets are written anew


def test_a_race_has_one_winner(spark, tmp_dir):
    path, won, lost = f"{tmp_dir}/t", [], []
    vs.create(path, _kernels(spark, 10), "kernel_name", buckets=4)
    gate = threading.Barrier(3)

    def write(n):
        ch = spark.createDataFrame([(f"k{n}", f"by {n}")], "kernel_name string, kernel_param string")

        def apply(rows, c, top):
            gate.wait(60)   # all have seen the same base
            return chg.set_column(rows, c, "kernel_name", "kernel_param")[0]

        try:
            won.append(vs.commit(path, 0, ch, apply))
        except vs.VersionConflict:
            lost.append(n)

    threads = [threading.Thread(target=write, args=(n,)) for n in (1, 2, 3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert won == [1] and len(lost) == 2
    assert vs.read(spark, path).where("kernel_param LIKE 'by %'").count() == 1


def test_empty_table_and_strays(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    vs.create(path, _kernels(spark, 0), "kernel_name", "kernel_id")
    assert vs.read(spark, path).collect() == []
    rows = _kernels(spark, 2).drop("kernel_id")
    vs.commit(path, 0, rows, lambda old, c, top: chg.insert_absent(old, c, "kernel_name", "kernel_id", highest=top))
    assert sorted(r.kernel_id for r in vs.read(spark, path).collect()) == [1, 2]
    with pytest.raises(ValueError):
        vs.commit(path, 1, rows.limit(1), lambda old, c, top: _kernels(spark, 30))


def test_follows_growing_files(spark, tmp_dir):
    """Equal lines and equal times keep the order of the file; a line being written waits for its end."""
    def add(name, text):
        os.makedirs(f"{tmp_dir}/log/h1", exist_ok=True)
        with open(f"{tmp_dir}/log/h1/{name}", "a") as f:
            f.write(text)

    def got():
        df = st.run_to_files(tail.follow_timeline(spark, f"{tmp_dir}/log", "*.log", range_bytes=40), f"{tmp_dir}/q")
        return sorted((r.seq, r.message) for r in df.where("valid").collect())

    line = lambda m: f"d|1.5|7|{m}|\n"
    add("a.log", line("one") + line("same") + line("same") + "d|1.5|7|ha")
    add("b.txt", line("other"))
    first = got()
    assert [m for _, m in first] == ["one", "same", "same"] and len({s for s, _ in first}) == 3
    add("a.log", "lf|\n" + "".join(line(f"m{k} é" * 5) for k in range(30)))
    now = got()
    assert [m for _, m in now] == ["one", "same", "same", "half", *(f"m{k} é" * 5 for k in range(30))]
    text = open(f"{tmp_dir}/log/h1/a.log", "rb").read()
    assert all(text[s:].startswith(f"d|1.5|7|{m}|\n".encode()) for s, m in now)
    assert got() == now


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_ranges_cover_every_line_once(tmp_dir, size):
    lines = ["", "a", "bb\r", "x" * 50, "", "é" * 9, "end"]
    path = f"{tmp_dir}/f"
    with open(path, "wb") as f:
        f.write("\n".join(lines).encode() + b"\npart")
    stop = tail.complete_until(path, path, 0, os.path.getsize(path))
    out = [(q, v) for a in range(0, stop, size) for b in tail.read_lines(path, path, a, min(stop, a + size), 0, stop) for v, q in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
    assert [v for _, v in sorted(out)] == [x.removesuffix("\r") for x in lines] and len(out) == len(lines)


def test_listing_with_access_times(spark, tmp_dir):
    for name in ("a/x.bin", "a/deep/y.bin", "b/z.txt", "_tmp/w.bin", "a/.hidden"):
        os.makedirs(os.path.dirname(f"{tmp_dir}/l/{name}"), exist_ok=True)
        with open(f"{tmp_dir}/l/{name}", "w") as f:
            f.write(name)
    os.makedirs(f"{tmp_dir}/l/empty")
    os.utime(f"{tmp_dir}/l/a/x.bin", (0, 0))
    ls = sf.read_listing(spark, f"{tmp_dir}/l", partitions=3)
    assert {r.path[len(tmp_dir):]: r.length for r in ls.collect()} == {"/l/a/x.bin": 7, "/l/a/deep/y.bin": 12, "/l/b/z.txt": 7}
    recent = sf.accessed_since(ls, F.current_timestamp())
    assert sorted(r.path[len(tmp_dir):] for r in recent.collect()) == ["/l/a/deep/y.bin", "/l/b/z.txt"]
    assert sf.read_listing(spark, f"{tmp_dir}/l", "*.bin").count() == 2
    assert sf.read_listing(spark, f"file:{tmp_dir}/l/empty").collect() == []
