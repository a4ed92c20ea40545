"""Sources: manifests, listings, result logs, TSV, Docker JSON."""

import os

from pyspark.sql import functions as F

from bootlens.operators import benchmark as bm
from bootlens.schemas import NODE
from bootlens.sources import catalog as src_cat, files as sf


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_manifests(spark, tmp_dir):
    root = f"{tmp_dir}/repo"
    _write(f"{root}/r1/BMCfile", "kernel vmlinuz\ninitrd  initrd.img \nparam p.txt\nkernel vmlinuz-2\n")
    _write(f"{root}/r2/BMCfile", "kernel k\n# comment\ninitrd i\n")
    _write(f"{root}/r3/BMCfile", "kernel k\nfoo bar\n")
    _write(f"{root}/r4/BMCfile", "kernel k\n")
    t = {r.repo: r for r in sf.manifest_table(sf.read_manifests(spark, root)).collect()}
    assert (t["r1"].kernel, t["r1"].initrd, t["r1"].param, t["r1"].error) == ("vmlinuz-2", "initrd.img", "p.txt", None)
    assert t["r2"].error == "syntax error: # comment"
    assert t["r3"].error == "syntax error: foo bar"
    assert t["r4"].error == "initrd must be specified"
    listing = sf.read_listing(spark, root)
    _write(f"{root}/r5/BMCfile", "kernel k5\ninitrd i5\n")
    _write(f"{root}/r5/k5", "x")
    t2 = {r.repo: r for r in sf.manifest_table(sf.read_manifests(spark, root), sf.read_listing(spark, root),
                                               root).collect()}
    assert t2["r5"].error == "cannot read i5"
    assert listing is not None


def test_manifest_from_listing(spark):
    listing = spark.createDataFrame([("/repo/a/vmlinuz-kernel",), ("/repo/a/my-initrd",), ("/repo/a/my-initrd.sig",),
                                     ("/repo/a/sub/x-kernel",), ("/repo/b/one-kernel",), ("/repo/b/two-kernel",),
                                     ("/repo/b/x-initrd",), ("/repo/c/x-param",)], "path string")
    t = {r.repo: r for r in sf.manifest_from_listing(listing, "/repo").collect()}
    assert (t["a"].kernel, t["a"].initrd, t["a"].initrdsig, t["a"].error) == \
        ("/repo/a/vmlinuz-kernel", "/repo/a/my-initrd", "/repo/a/my-initrd.sig", None)
    assert t["b"].error == "ambiguous kernel"
    assert t["c"].error == "No kernel file in repository"


def test_ambiguous_extras_and_dot_files_are_left_out(spark):
    listing = spark.createDataFrame([(f"/repo/a/{x}",) for x in ("k-kernel", ".old-kernel", "i-initrd", "x-param", "y-param",
                                                                "a-kernel.sig", "b-kernel.sig")], "path string")
    r = sf.manifest_from_listing(listing, "/repo").first()
    assert (r.kernel, r.initrd, r.param, r.kernelsig, r.error) == ("/repo/a/k-kernel", "/repo/a/i-initrd", None, None, None)


def test_param_content(spark):
    m = spark.createDataFrame([("a", "p1"), ("b", None), ("c", "gone")], "repo string, param string")
    files = spark.createDataFrame([("/repo/a/p1", "quiet ro\nx=1\n\n")], "path string, text string")
    got = {r.repo: r.kernel_param for r in sf.with_param_content(m, files, "/repo").collect()}
    assert got == {"a": "quiet ro\nx=1", "b": None, "c": None}


def test_results(spark, tmp_dir):
    _write(f"{tmp_dir}/res/res-blas-1600-myblas-Smton-1.out", "warming up\nGFLOPS = 10.5\nGFLOPS = oops\n")
    _write(f"{tmp_dir}/res/res-blas-3200-myblas-Smton-2.out", "GFLOPS =3.5e1 extra\n")
    _write(f"{tmp_dir}/res/res-blas-1600-pkgblas-Smtoff-1.out", "GFLOPS = 4\n")
    r = sf.parse_results(sf.read_results(spark, f"{tmp_dir}/res"))
    got = {(x.target, x.smt): (x.n_lines, x.mean_gflops) for x in bm.mean_gflops(r).collect()}
    assert got == {("myblas", "on"): (3, (10.5 + 0 + 35.0) / 3), ("pkgblas", "off"): (1, 4.0)}
    sizes = sorted({x.size for x in r.collect()})
    assert sizes == [1600, 3200]
    lines = sf.read_results(spark, f"{tmp_dir}/res")
    got2 = {(x.target, x.smt): (x.n_lines, x.mean_gflops) for x in bm.mean_gflops_from_lines(lines).collect()}
    assert got2 == got


def test_listing_and_counts(spark, tmp_dir):
    _write(f"{tmp_dir}/l/a/x.bin", "123")
    _write(f"{tmp_dir}/l/b/y.bin", "12345")
    ls = sf.read_listing(spark, f"{tmp_dir}/l")
    assert sorted(r.length for r in ls.collect()) == [3, 5]
    areas = spark.createDataFrame([("a",), ("b",), ("c",)], "area string")
    listing = ls.withColumn("area", F.element_at(F.split("path", "/"), -2))
    got = sorted((r.area, r.n) for r in sf.area_counts(listing, areas).collect())
    assert got == [("a", 1), ("b", 1), ("c", 0)]


def test_tsv_roundtrip_with_nulls(spark, tmp_dir):
    from tests.fleet import fleet

    nodes = fleet(spark)[0]
    nodes.createOrReplaceTempView("Node")
    out = src_cat.dump_all(spark, f"{tmp_dir}/dump", names=["Node"])
    back = src_cat.read_tsv(spark, out["Node"], NODE, null_value=src_cat.NULL_TEXT)
    assert back.exceptAll(nodes).count() == 0 and nodes.exceptAll(back).count() == 0
    text = "".join(open(os.path.join(out["Node"], f)).read() for f in os.listdir(out["Node"]) if f.endswith(".csv"))
    assert "<NULL>" in text and "\t" in text
    assert "node" in [t.lower() for t in src_cat.list_tables(spark)]


def test_docker_json(spark):
    doc = '[{"Config": {"Env": ["PATH=/bin:/usr/bin", "A=1=2", "EMPTY"]}}, {"Config": {"Env": null}}]'
    tags = '[{"name": "latest"}, {"name": "7.1"}]'
    df = spark.createDataFrame([(doc, tags)], "json string, tags string")
    env = {(r.key, r.value) for r in sf.image_env(df).collect()}
    assert env == {("PATH", "/bin:/usr/bin"), ("A", "1=2"), ("EMPTY", None)}
    r = df.select(sf.tag_exists(sf.tag_names(df, "tags"), F.lit("7.1")).alias("a"),
                  sf.tag_exists(sf.tag_names(df, "tags"), F.lit("7")).alias("b")).first()
    assert r.a is True and r.b is False


def test_rows_changed(spark):
    """Rows of one side only, repeats counted; NULL and its place count, equal tables give 0."""
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (None, "2"), (3, "y")], "a long, b string")
    b = spark.createDataFrame([(1, "x"), (2, None), (None, "2"), (3, "z")], "a long, b string")
    for buckets in (1, 1 << 16):
        n = [src_cat.rows_changed(x, y, buckets).first().n_changed for x, y in ((a, a), (a, b), (b, a), (a.limit(0), b))]
        assert n == [0, 3, 3, 4]


def test_files_of_a_type_are_written_by_many_tasks(spark, tmp_dir):
    import glob

    from bootlens.plans.registry import _write_by_type

    ev = spark.range(1050).select(F.col("id").alias("event_id"), F.when(F.col("id") < 1001, "a").when(F.col("id") < 1040, "b").alias("event_type"))
    _write_by_type(ev, f"{tmp_dir}/o", rows=100, files=2)
    files = {t: glob.glob(f"{tmp_dir}/o/event_type={t}/part-*") for t in ("a", "b", "__HIVE_DEFAULT_PARTITION__")}
    assert [len(f) for f in files.values()] == [11, 1, 1]
    assert len({f.split("/part-")[1].split("-")[0] for f in files["a"]}) > 1
    assert spark.read.parquet(f"{tmp_dir}/o").count() == 1050
