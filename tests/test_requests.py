"""Request checks: query strings, sessions, boot outcome, senders."""

import datetime as dt

from pyspark.sql import functions as F

from bootlens.functions import scalars as sc
from bootlens.operators import requests as rq
from tests.fleet import T0, fleet


def test_parse_query(spark):
    df = spark.createDataFrame([("bmcid=a&status=ok&bmcid=b&x=&sign=req&mac=00%3A11",), ("",)], "q string")
    m = df.select(sc.parse_query("q").alias("m")).collect()
    assert m[0].m == {"bmcid": "b", "status": "ok", "x": "", "mac": "00%3A11"}
    assert m[1].m == {}
    r = df.select(sc.unknown_keys("q", ["bmcid", "status"]).alias("u"), sc.required(sc.parse_query("q"), "x").alias("x"),
                  sc.decode_colon(F.lit("00%3A11%3a22")).alias("d"), sc.url_decode(F.lit("a%20b")).alias("u2")).first()
    assert r.u == ["x", "mac"] and r.x is None and r.d == "00:11:22" and r.u2 == "a b"


def test_scalars(spark):
    df = spark.createDataFrame([("https://github.com/a/b.git", "img:tag", "alice@host", "foo.tar.gz")], "u string, i string, l string, f string")
    r = df.select(sc.path_escape("u").alias("e"), sc.image_name("i").alias("n"), sc.image_tag("i").alias("t"),
                  sc.login_user("l").alias("lu"), sc.login_host("l").alias("lh"), sc.login_user("f").alias("root"),
                  sc.stem("f").alias("s"), sc.nth_field("u", "/", 3).alias("h"),
                  sc.token_after(F.lit("1.2.3.4 via 5.6.7.8 dev eth0 src 9.9.9.9 uid 0"), "src").alias("src"),
                  sc.power_code(F.lit("reset")).alias("pc"), sc.early_start(F.lit("wol")).alias("es"),
                  sc.home_dir(F.lit("bob"), F.lit(None)).alias("hd"),
                  sc.short_id(F.lit("123e4567-e89b-12d3-a456-426614174000")).alias("sid"),
                  sc.gflops(F.lit(1000), F.lit(2.0)).alias("g")).first()
    assert r.e == "https:%%github.com%a%b" and (r.n, r.t) == ("img", "tag")
    assert (r.lu, r.lh, r.root) == ("alice", "host", "root") and r.s == "foo" and r.h == "github.com"
    assert r.src == "9.9.9.9" and r.pc == 5 and r.es is False and r.hd == "/home/bob"
    assert r.sid == "426614174000" and abs(r.g - 1.0) < 1e-12


def test_check_session(spark):
    now = dt.datetime(2024, 1, 1, 12, 0, 0)
    hashes = spark.createDataFrame([("s1", now + dt.timedelta(hours=1), "n1"), ("s2", now - dt.timedelta(seconds=1), "n2"),
                                    ("s3", now, "n3"), ("s4", now + dt.timedelta(hours=1), None),
                                    ("s5", now + dt.timedelta(hours=1), "")],
                                   "session_id string, session_good_for timestamp, nonce2 string")
    req = spark.createDataFrame([("r1", "s1", "n1", now), ("r2", "s1", "n1", now + dt.timedelta(seconds=5)),
                                 ("r3", "s2", "n2", now), ("r4", "s3", "n3", now), ("r5", "s1", "bad", now),
                                 ("r6", "s9", "x", now), ("r7", "s4", "", now), ("r8", "s5", "", now)],
                                "rid string, session_id string, nonce string, ts timestamp")
    got = {x.rid: x.verdict for x in rq.check_session(req, hashes, F.lit(now)).collect()}
    assert got == {"r1": "ok", "r2": "reused", "r3": "expired", "r4": "ok", "r5": "bad nonce",
                   "r6": "unknown session", "r7": "bad nonce", "r8": "bad nonce"}


def test_boot_outcome(spark):
    def e(s):
        return s * 1_000_000_000
    runs = spark.createDataFrame([("a", e(100), 1), ("b", e(100), 2), ("c", e(100), 3), ("d", e(100), 4)],
                                 "bmc_id string, epoch_ns long, seq long")
    notes = spark.createDataFrame([
        ("a", e(150), 10, "ok"), ("a", e(160), 11, "fail"),          # two in time: first wins
        ("b", e(280), 12, "ok"),                                      # late (>= 180 s)
        ("c", e(100), 13, "panic"),                                   # at the start instant
    ], "bmc_id string, epoch_ns long, seq long, status string")
    got = {x.bmc_id: (x.outcome, x.notice_seq) for x in rq.boot_outcome(runs, notes, partitions=3).collect()}
    assert got == {"a": ("ok", 10), "b": ("timed out", None), "c": ("boot failure: panic", 13), "d": ("timed out", None)}


def test_identify_and_authorise(spark):
    nodes, conts, *_ = fleet(spark)
    # c1 on node 1 (mac m1), c4 on node 2; node 4 (10.0.2.4, m4) is idle and never matches
    req = spark.createDataFrame([("10.0.2.2", "m1"), ("10.9.9.9", "m1"), ("10.9.9.9", None), ("10.0.2.4", "m1"), ("10.0.2.4", "m4")],
                                "remote_addr string, mac_addr string")
    got = [(x.bmc_id, x.matched_by) for x in rq.identify_caller(req, nodes, conts).collect()]
    assert sorted(got, key=str) == sorted([("c4", "ip"), ("c1", "mac"), (None, None), ("c1", "mac"), (None, None)], key=str)
    detail = conts.join(nodes, "node_id")     # inner: terminated c3 has no node
    notices = spark.createDataFrame([("c1", "10.0.3.1"), ("c1", "10.0.1.1"), ("c1", "10.0.3.2"), ("c3", "10.0.3.1")],
                                    "bmc_id string, remote_addr string")
    ok = sorted((x.bmc_id, x.remote_addr) for x in rq.authorise_sender(notices, detail).collect())
    assert ok == [("c1", "10.0.1.1"), ("c1", "10.0.3.1")]
    _ = T0


def test_boot_args(spark):
    df = spark.createDataFrame([("nfs", "B1", "C1", "quiet "), ("s-ramfs", "B2", "C2", "a b"), ("isofs", "B3", "C3", ""),
                                ("zfs", "B4", "C4", "")], "fstype string, base string, bmc string, kp string")
    ip = sc.boot_ip(F.lit("10.0.3.1"), F.lit("srv"), F.lit(None), F.lit("255.255.255.0"), F.lit("n1"), F.lit("eth0"))
    got = [r.a for r in df.select(sc.boot_args("fstype", "base", "bmc", ip, "kp", F.lit("srv"),
                                               doc_path="bmc", distfs_root="/x/dist").alias("a")).collect()]
    assert got[0] == ("imgargs KB1 bmcid=C1 boot=nfs rootdelay=1 ip=10.0.3.1:srv::255.255.255.0:n1:eth0 root=/dev/nfs "
                      "nfsroot=srv:/x/dist/B1 port=tcp rw quiet ")
    assert got[1] == ("imgargs KB2 bmcid=C2 boot=local rootdelay=1 ip=10.0.3.1:srv::255.255.255.0:n1:eth0 "
                      "bmcroot=http://srv/bmc/rootfs/B2.tar.gz bmcroot2=http://srv/bmc/rootfs/B2-etc.tar.gz rw a b")
    assert got[2] == "imgargs KB3 iso raw" and got[3] is None


def test_checked_boot_outcome(spark):
    e = 1_000_000_000
    runs = spark.createDataFrame([("a", 100 * e, 1), ("b", 100 * e, 2)], "bmc_id string, epoch_ns long, seq long")
    notes = spark.createDataFrame([("a", 110 * e, 10, "ok", "10.9.9.9"), ("a", 120 * e, 11, "bad", "10.0.3.1"),
                                   ("b", 110 * e, 12, "ok", "10.0.2.2")],
                                  "bmc_id string, epoch_ns long, seq long, status string, remote_addr string")
    detail = spark.createDataFrame([("a", "10.0.3.1", "10.0.1.1", "10.0.2.1"), ("b", "10.0.3.2", "10.0.1.2", "10.0.2.2")],
                                   "bmc_id string, ip4_addr_os string, ip4_addr_mgmt string, ip4_addr_boot string")
    got = {x.bmc_id: (x.outcome, x.notice_seq) for x in rq.checked_boot_outcome(runs, notes, detail, partitions=2).collect()}
    # a's first notice comes from a foreign address and does not count
    assert got == {"a": ("boot failure: bad", 11), "b": ("ok", 12)}


def test_strip_prefix_and_null_if_empty(spark):
    df = spark.createDataFrame([("/srv/repo/a/k",), ("/other/x",), ("",)], "p string")
    got = [(r.s, r.n) for r in df.select(sc.strip_prefix("p", "/srv/repo/").alias("s"),
                                          sc.null_if_empty("p").alias("n")).collect()]
    assert got == [("a/k", "/srv/repo/a/k"), ("/other/x", "/other/x"), ("", None)]


def test_boot_outcome_null_times(spark):
    runs = spark.createDataFrame([("a", None, 1), ("b", 5, 2)], "bmc_id string, epoch_ns long, seq long")
    notes = spark.createDataFrame([("a", 1, 10, "ok"), ("b", None, 11, "ok")],
                                  "bmc_id string, epoch_ns long, seq long, status string")
    got = {x.bmc_id: x.outcome for x in rq.boot_outcome(runs, notes, partitions=2).collect()}
    assert got == {"a": "timed out", "b": "timed out"}


def test_session_without_expiry_is_refused(spark):
    h = spark.createDataFrame([("s", None, "n")], "session_id string, session_good_for timestamp, nonce2 string")
    req = spark.createDataFrame([("s", "n", T0)], "session_id string, nonce string, ts timestamp")
    assert [x.verdict for x in rq.check_session(req, h, F.lit(T0)).collect()] == ["expired"]


def test_span_seconds_on_both_sides_of_104_days(spark):
    from fractions import Fraction

    from bootlens.schemas import span_seconds

    values = [0, 1, 999, 123456789, 2**53 - 1, 2**53 + 1, 10000000123456789, 9223372036854775807, -1, -10000000123456789]
    df = spark.createDataFrame([(v,) for v in values], "ns long")
    assert [r.s for r in df.select(span_seconds(F.col("ns")).alias("s")).collect()] == [float(Fraction(v, 10**9)) for v in values]
