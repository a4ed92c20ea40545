"""Events out of logged text."""

from bootlens.operators import events as ev

LOG = [("Initialize", "Initialize", None, None, False), ("addnode n1", "addnode", "n1", None, False), ("run C1 on n1", "run", "C1", "n1", False),
       ("import_kernel k1 (update)", "import_kernel", "k1", None, True), ("rm_rootfs r", "rm_rootfs", "r", None, False),
       ("kill C1", "kill", "C1", None, False), ("rm C1", "rm", "C1", None, False), ("something else", None, None, None, None), (None, None, None, None, None)]


def test_log_messages(spark):
    df = spark.createDataFrame([(k, r[0]) for k, r in enumerate(LOG)], "seq long, message string")
    got = [(r.message, r.action, r.name, r.node, r.is_update) for r in ev.log_events(df).orderBy("seq").collect()]
    assert got == LOG
    assert [(r.bmc_id, r.state) for r in ev.state_events(df).orderBy("seq").collect()] == [("C1", "up"), ("C1", "terminated"), ("C1", "removed")]


def test_fact_lines(spark):
    lines = ["cgi-baremetal bmcid=C1 from=10.0.0.5 mac=m1", "cgi-baremetal session_id=a:b nonce2=n expiration=2024-01-01 09:00:00",
             "cgi-baremetal waitstate bmcid=C1 state=pending", "cgi-notify-bmc bmcid=C1 status=ok", "cgi-baremetal:begin bmcid=C1 from=10.0.0.5",
             "cgi-baremetal session_id= nonce2= expiration=", "exec_run alloc:end bmcid=C1"]
    df = spark.createDataFrame([("h", k, k, k, m) for k, m in enumerate(lines)], "host string, pid long, epoch_ns long, seq long, message string")
    got = {r.seq: r for r in ev.fact_events(df).collect()}
    assert sorted(got) == [0, 1, 2, 3, 5]
    assert (got[0].bmc_id, got[0].remote_addr, got[0].mac_addr, got[0].status) == ("C1", "10.0.0.5", "m1", None)
    assert (got[1].session_id, got[1].nonce2, got[1].expiration) == ("a:b", "n", "2024-01-01 09:00:00")
    assert got[2].state == "pending" and got[3].status == "ok" and (got[5].session_id, got[5].expiration) == (None, None)
