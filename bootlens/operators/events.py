"""Events out of logged text: audit log messages and timeline fact lines.

They feed the operators that take events: state events W6 and M7, boot
requests J13, sessions J15, notices J18.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# The actions of the audit log, and the state a container action asks for.
LOG_PATTERN = r"^(Initialize|addnode|delnode|import_\w+|rm_\w+|set_kernel_param|pull_bmc|pull|run|kill|rm)(?: (\S+))?(?: on (\S+))?( \(update\))?$"
LOG_STATES = {"run": "up", "kill": "terminated", "rm": "removed"}
# Fixed pattern of a fact line: its script, then key=value words; the last value may hold spaces.
FACT_PATTERN = r"^(cgi-[\w-]+)(?: waitstate| redirect)? (?:\w+=)"
FACT_KEYS = (("bmcid", "bmc_id"), ("from", "remote_addr"), ("mac", "mac_addr"), ("session_id", "session_id"), ("nonce2", "nonce2"),
             ("state", "state"), ("status", "status"))


def log_events(log: DataFrame, message: str = "message") -> DataFrame:
    """Audit log rows with their message taken apart: ``action``, ``name``
    (what it is about), ``node`` (of ``run ID on NODE``) and ``is_update``.
    Messages outside the grammar have a NULL action.  The log records what
    was asked for, not what came of it."""
    m = F.col(message)
    ok = m.rlike(LOG_PATTERN)
    g = lambda i: F.when(ok, F.nullif(F.regexp_extract(m, LOG_PATTERN, i), F.lit("")))
    return log.select("*", g(1).alias("action"), g(2).alias("name"), g(3).alias("node"), F.when(ok, g(4).isNotNull()).alias("is_update"))


def state_events(log: DataFrame, message: str = "message") -> DataFrame:
    """The log rows that change a container (``run``, ``kill``, ``rm``) with
    ``bmc_id`` and ``state``, as W6 and M7 take them."""
    state = F.create_map(*[F.lit(x) for pair in LOG_STATES.items() for x in pair])
    ev = log_events(log, message).where(F.col("action").isin(*LOG_STATES) & F.col("name").isNotNull())
    return ev.select(*log.columns, F.col("name").alias("bmc_id"), state[F.col("action")].alias("state"))


def fact_events(timeline: DataFrame) -> DataFrame:
    """Timeline fact lines of the web scripts, their words as columns: host,
    pid, epoch_ns, seq, script, bmc_id, remote_addr, mac_addr, session_id,
    nonce2, state, status, expiration (to the end of the line); NULL where a
    line does not name one.  Select on them: requests have a remote_addr,
    sessions a session_id, state events a state, notices a status."""
    tl = timeline.where(F.col("valid")) if "valid" in timeline.columns else timeline
    m = F.col("message")
    facts = tl.where(m.rlike(FACT_PATTERN))
    word = lambda k: F.nullif(F.regexp_extract(m, rf"(?:^| ){k}=(\S*)", 1), F.lit(""))
    return facts.select("host", "pid", "epoch_ns", "seq", F.regexp_extract(m, FACT_PATTERN, 1).alias("script"),
                        *[word(k).alias(c) for k, c in FACT_KEYS],
                        F.nullif(F.regexp_extract(m, r" expiration=(.*)$", 1), F.lit("")).alias("expiration"))
