"""Timeline parsing and pairing on hand-made lines (FIXTURES §2)."""

import pytest
from pyspark.sql import functions as F

from bootlens.operators import timeline as tl
from bootlens.sources.timeline import parse_lines, read_timeline

LINES = [
    # (line, seq)
    ("2024-01-01 09:00:00|1704099600.000000001|100|--Start--|", 1),
    ("2024-01-01 09:00:00|1704099600.000000002|100|exec_run:begin --rank=eq 1 img k i echo a|b x:end|", 2),
    ("2024-01-01 09:00:01|1704099601.000000000|100|exec_run alloc:begin|", 3),
    ("2024-01-01 09:00:02|1704099602.000000000|100|exec_run alloc:end bmcid=C1 node=3|", 4),
    ("2024-01-01 09:00:02|1704099602.100000000|100|exec_run prepare:begin|", 5),
    ("2024-01-01 09:00:03|1704099603.000000000|100|C1 poweron:begin|", 6),
    ("2024-01-01 09:00:05|1704099605.000000000|100|exec_run poweron:end|", 7),
    ("2024-01-01 09:00:09|1704099609.000000000|100|exec_run:end|", 8),
    # loader marks, a new pid each
    ("2024-01-01 09:00:04|1704099604.000000100|201|load_kernel:begin_bmcid=C1 from 10.0.0.5|", 9),
    ("2024-01-01 09:00:04|1704099604.000000900|202|load_kernel:end_bmcid=C1 from 10.0.0.5|", 10),
    # same microsecond, nanoseconds decide the order
    ("2024-01-01 09:00:06|1704099606.000001500|203|verify_kernel:end_bmcid=C1 from 10.0.0.5|", 11),
    ("2024-01-01 09:00:06|1704099606.000001400|204|verify_kernel:begin_bmcid=C1 from 10.0.0.5|", 12),
    # pid 100 reused by a later kill of two ids
    ("2024-01-01 10:00:00|1704103200.000000000|100|--Start--|", 13),
    ("2024-01-01 10:00:00|1704103200.100000000|100|exec_kill:begin C1 C2|", 14),
    ("2024-01-01 10:00:00|1704103200.200000000|100|exec_kill1:begin C1|", 15),
    ("2024-01-01 10:00:01|1704103201.000000000|100|kill poweroff:begin|", 16),
    ("2024-01-01 10:00:02|1704103202.000000000|100|kill poweroff:end|", 17),
    ("2024-01-01 10:00:03|1704103203.000000000|100|exec_kill1:begin C2|", 18),
    ("2024-01-01 10:00:04|1704103204.000000000|100|kill poweroff:begin|", 19),
    # a background pull started by the first run: its note names the container
    ("2024-01-01 09:00:05|1704099605.500000000|150|--Start--|", 22),
    ("2024-01-01 09:00:05|1704099605.600000000|150|exec_pull:begin img|", 23),
    ("2024-01-01 09:00:05|1704099605.700000000|150|exec_pull: bmcid=C1 parent=100|", 24),
    ("2024-01-01 09:00:08|1704099608.000000000|150|exec_pull:end|", 25),
    # web scripts: pid 400 serves two requests; the second names its id only after its begin mark
    ("2024-01-01 12:00:00|1704110400.000000000|400|cgi-baremetal bmcid=C1 from=10.0.0.5 mac=m1|", 30),
    ("2024-01-01 12:00:00|1704110400.100000000|400|cgi-baremetal:begin bmcid=C1 from=10.0.0.5|", 31),
    ("2024-01-01 12:00:01|1704110401.000000000|400|cgi-baremetal waitstate:begin|", 32),
    ("2024-01-01 12:00:02|1704110402.000000000|400|cgi-baremetal waitstate:end|", 33),
    ("2024-01-01 12:00:02|1704110402.100000000|400|cgi-baremetal:end|", 34),
    ("2024-01-01 12:01:00|1704110460.000000000|400|cgi-notify-bmc:begin from 10.0.3.2|", 35),
    ("2024-01-01 12:01:00|1704110460.100000000|400|cgi-notify-bmc bmcid=C2 status=ok|", 36),
    ("2024-01-01 12:01:00|1704110460.200000000|400|cgi-notify-bmc:end|", 37),
    # a begin without an end (failed process)
    ("2024-01-01 11:00:00|1704106800.000000000|300|exec_pull:begin img|", 20),
    # not a timeline line
    ("garbage without bars", 21),
]


@pytest.fixture(scope="module")
def timeline(spark):
    df = spark.createDataFrame(LINES, "value string, seq long")
    return parse_lines(df, host=F.lit("mgr"), seq=F.col("seq"))


def test_parse_keeps_bars_and_rejects(timeline):
    rows = {r.seq: r for r in timeline.collect()}
    assert rows[2].message == "exec_run:begin --rank=eq 1 img k i echo a|b x:end"
    assert rows[21].valid is False and rows[21].message is None
    assert rows[1].epoch_ns == 1704099600000000001


def test_marks_grammar(timeline):
    m = {r.seq: r for r in tl.marks(timeline).collect()}
    assert (m[2].phase, m[2].kind) == ("exec_run", "begin")   # the logged x:end is not a mark
    assert (m[6].prefix, m[6].phase, m[6].kind) == ("C1", "poweron", "begin")
    assert (m[9].phase, m[9].kind, m[9].bmc_id) == ("load_kernel", "begin", "C1")
    assert m[1].is_start and m[4].bmc_id == "C1" and m[15].bmc_id == "C1" and m[5].bmc_id is None


def test_runs_and_ids(timeline):
    m = tl.fill_bmc_id(tl.attach_pid(tl.segment_runs(tl.marks(timeline))))
    r = {x.seq: x for x in m.collect()}
    # first run of pid 100 names only C1: all its marks get C1, also before the naming mark
    assert r[3].bmc_id == "C1" and r[2].bmc_id == "C1"
    # the reused pid starts a new run
    assert r[14].run_seq == 13 and r[3].run_seq == 1
    # the kill run names two ids: each mark takes the last id named before it
    assert r[16].bmc_id == "C1" and r[19].bmc_id == "C2"
    assert r[14].bmc_id is None
    assert r[23].bmc_id == "C1" and r[23].parent_pid == 100
    # web script runs: each request of the reused pid is its own run
    assert r[31].is_start and r[35].is_start and r[32].run_seq == 31 and r[35].run_seq == 35
    assert r[32].bmc_id == "C1" and r[34].bmc_id == "C1"
    assert r[35].bmc_id == "C2" and r[37].bmc_id == "C2"      # named only by the fact line after it


def test_intervals(timeline):
    iv = tl.intervals_from_timeline(timeline).collect()
    by = {(x.bmc_id, x.phase, x.begin_seq): x for x in iv}
    # poweron begun under tag C1 is closed by "exec_run poweron:end"
    assert by[("C1", "poweron", 6)].end_seq == 7
    # loader marks pair by id across pids, nanoseconds order them
    assert by[("C1", "load_kernel", 9)].end_seq == 10
    assert by[("C1", "verify_kernel", 12)].end_seq == 11
    assert by[("C1", "verify_kernel", 12)].duration_ns == 100
    # second poweroff of the kill run has no end: open interval
    assert by[("C2", "poweroff", 19)].end_seq is None
    # the background pull belongs to C1 through its note
    assert by[("C1", "exec_pull", 23)].end_seq == 25
    # the failed pull has no id and no end
    nid = [x for x in iv if x.bmc_id is None and x.phase == "exec_pull"]
    assert len(nid) == 1 and nid[0].end_ns is None


def test_phase_times_counts(timeline):
    pt = {(r.bmc_id, r.phase): r for r in tl.phase_times(tl.intervals_from_timeline(timeline)).collect()}
    assert pt[("C1", "exec_run")].n_closed == 1 and pt[("C1", "exec_run")].total_sec == 8999999998 / 1e9
    assert pt[("C2", "poweroff")].n_open == 1


def test_read_timeline_files(spark, tmp_dir):
    import os

    os.makedirs(f"{tmp_dir}/hostA")
    with open(f"{tmp_dir}/hostA/time.log", "w") as f:
        f.write("\n".join(line for line, _ in LINES[:5]) + "\n")
    t = read_timeline(spark, f"{tmp_dir}/*/time.log")
    rows = t.collect()
    assert len(rows) == 5 and {r.host for r in rows} == {"hostA"}


def test_relative_time(spark):
    df = spark.createDataFrame([("a", 10_500_000_000), ("a", 12_000_000_000), ("b", 3_000_000_000)],
                               "bmc_id string, epoch_ns long")
    got = sorted((r.bmc_id, r.rel_sec) for r in tl.relative_time(df).collect())
    assert got == [("a", 0.0), ("a", 1.5), ("b", 0.0)]


def test_oversized_numbers_are_rejects(spark):
    df = spark.createDataFrame([("d|123456789012345678901234.5|1|x:begin|", 1), ("d|1.5|99999999999999999999999|x:end|", 2)],
                               "value string, seq long")
    rows = parse_lines(df, seq=F.col("seq")).collect()
    assert [r.valid for r in rows] == [False, False]


def test_mark_helpers_agree_with_marks(spark, timeline):
    from bootlens.functions import marks as mk

    msg = F.col("message")
    one = timeline.where("valid").select(
        "seq", mk.parse_mark(msg).alias("p"), mk.mark_prefix(msg).alias("prefix"), mk.mark_phase(msg).alias("phase"),
        mk.mark_kind(msg).alias("kind"), mk.mark_rest(msg).alias("rest"))
    table = {r.seq: r for r in tl.marks(timeline).collect()}
    for r in one.collect():
        t = table[r.seq]
        assert (r.prefix, r.phase, r.kind, r.rest) == (t.prefix, t.phase, t.kind, t.rest)
        assert (r.p.prefix, r.p.phase, r.p.kind) == (t.prefix, t.phase, t.kind)
        if t.kind is not None:
            assert r.p.bmc_id == t.bmc_id


def test_only_telling_lines_without_texts_are_ordered(spark, timeline):
    m = tl.marks(timeline)
    rows = tl.telling_lines(m)
    assert not {"message", "rest", "prefix"} & set(rows.columns)
    kept = {r.seq for r in rows.collect()}
    for r in m.collect():
        telling = r.is_start or r.kind is not None or r.bmc_id is not None or r.message.startswith("exec_pull: ")
        assert (r.seq in kept) == telling
    # the same intervals as with every line and its text in the scan
    whole = tl.fill_bmc_id(tl.attach_pid(tl.segment_runs_and_carry(m)))
    want = sorted((r.bmc_id or "", r.host, r.pid, r.phase, r.begin_ns, r.end_ns or 0)
                  for r in tl.pair_marks(whole.where("bmc_id is not null"), ["bmc_id"], carry=["host", "pid"]).collect())
    got = sorted((r.bmc_id or "", r.host, r.pid, r.phase, r.begin_ns, r.end_ns or 0)
                 for r in tl.intervals_from_timeline(timeline).where("bmc_id is not null").collect())
    assert got == want and got


def test_marks_of_odd_messages(spark):
    from bootlens.functions import marks as mk

    odd = ["", "x", ":begin", "a:begin", "a:b:begin", "p a:end r", "a:begin_x", "a:beginx", "\u0001a:begin", "a\u0001b", "a:end ", "p q a:begin", None]
    got = spark.createDataFrame([(m,) for m in odd], "m string").select(mk.mark_parts(F.col("m"))).collect()
    assert [r[0] is not None for r in got] == [False, False, False, True, False, True, True, False, True, False, True, False, False]


def test_runs_bring_what_their_marks_need(spark, timeline):
    """Notes and ids of a run come with the scan that finds the runs: no mark is joined to its run again, and results are
    those of the joins."""
    m = tl.marks(timeline)
    got = tl.fill_bmc_id(tl.attach_pid(tl.segment_runs_and_carry(m, partitions=5)))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan
    joined = tl.fill_bmc_id(tl.attach_pid(tl.segment_runs(m)))
    cols = ["seq", "host", "pid", "run_epoch_ns", "run_seq", "bmc_id", "parent_pid"]
    assert sorted(map(repr, got.select(cols).collect())) == sorted(map(repr, joined.select(cols).collect()))


def test_only_begins_bring_what_intervals_carry(spark, timeline):
    import glob

    from bootlens.session import ensure_checkpoint_dir

    at = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{at}/ordered-scan-*"))
    iv = tl.intervals_from_timeline(timeline)
    assert iv.columns[:6] == ["phase", "bmc_id", "host", "run_epoch_ns", "run_seq", "pid"]
    written = [spark.read.parquet(p) for p in set(glob.glob(f"{at}/ordered-scan-*")) - before]
    pairing = next(x for x in written if "_proc" in x.columns)
    assert pairing.where("kind = 'end' AND pid IS NOT NULL").count() == 0 and pairing.where("kind = 'begin' AND pid IS NULL").count() == 0
    assert pairing.where("bmc_id IS NOT NULL AND _proc IS NOT NULL").count() == 0
