"""Declared schemas of the fleet tables, logs and request records.

Types follow the catalog DDL: INTEGER ids are ``long``, BOOL is ``boolean``
(stored as 1/0 and read as boolean), CURRENT_TIMESTAMP columns are UTC
``timestamp``.  The timeline keeps the epoch as whole nanoseconds in a
``long`` (``epoch_ns``; exact until the year 2262) so that order ties break
exactly and comparisons, sorts and range bounds stay 8-byte integer work.
"""

from pyspark.sql import types as T

S, L, I, B, TS, D = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType(), T.DoubleType()
EPOCH_NS = T.LongType()
NS_PER_SECOND = 1_000_000_000


def ns_lit(seconds: float):
    """A number of seconds as a nanosecond literal."""
    from pyspark.sql import functions as F

    return F.lit(int(round(seconds * NS_PER_SECOND)))


def span_seconds(ns):
    """Nanoseconds to seconds as a double, correctly rounded for every size:
    an exact decimal product with nine fraction digits, rounded once."""
    from decimal import Decimal

    from pyspark.sql import functions as F

    return (ns.cast("decimal(28,0)") * F.lit(Decimal("0.000000001"))).cast("double")


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


NODE = _schema(("node_id", L), ("node_name", S), ("node_descr", S), ("node_rank", I), ("have_tpm", B),
               ("method_mgmt", S), ("mac_addr_mgmt", S), ("ip4_addr_mgmt", S), ("password_mgmt", S),
               ("ip4_addr_boot", S), ("interface_os", S), ("ip4_addr_os", S), ("netmask_os", S),
               ("gateway_os", S), ("dns_os", S))
CONTAINER = _schema(("bmc_id", S), ("base_name", S), ("client_addr", S), ("kernel_id", L), ("kernel_param", S),
                    ("initrd_id", L), ("rootfs_id", L), ("fstype", S), ("node_id", L), ("command", S),
                    ("created", TS), ("state", S))
KERNEL = _schema(("kernel_id", L), ("kernel_name", S), ("kernel_file", S), ("kernel_sig_file", S), ("kernel_param", S))
INITRD = _schema(("initrd_id", L), ("initrd_name", S), ("initrd_file", S), ("initrd_sig_file", S))
ROOTFS = _schema(("rootfs_id", L), ("rootfs_name", S), ("rootfs_file", S), ("rootfs_sig_file", S))
LOG = _schema(("date", TS), ("pid", L), ("message", S))
HASHES = _schema(("session_id", S), ("session_good_for", TS), ("nonce2", S))
TIMELINE = _schema(("host", S), ("local_date", S), ("epoch_ns", EPOCH_NS), ("pid", L), ("message", S), ("seq", L))
REQUEST = _schema(("ts", TS), ("remote_addr", S), ("mac_addr", S), ("query", S))
NOTICE = _schema(("ts", TS), ("remote_addr", S), ("bmc_id", S), ("status", S))
RUN_REQUEST = _schema(("request_id", S), ("ts", TS), ("image", S), ("kernel", S), ("initrd", S), ("fstype", S),
                      ("rank_op", S), ("rank_n", I))
MANIFEST = _schema(("repo", S), ("line_no", L), ("key", S), ("value", S))
LISTING = _schema(("path", S), ("length", L), ("modified", TS), ("accessed", TS))
RESULT_LINE = _schema(("file_name", S), ("line", S))
SAMPLE = _schema(("ts", TS), ("source", S), ("value", D))
CPU_CORE = _schema(("host", S), ("cpu", I), ("core", I))

#: Catalog tables by name, as the catalog DDL declares them.
CATALOG = {
    "Log": LOG, "Node": NODE, "Container": CONTAINER,
    "Kernel": KERNEL, "Initrd": INITRD, "Rootfs": ROOTFS,
}

# Fixed values of the reference (domains of the catalog columns).
TPM_VALUES = ("0", "1")
MGMT_METHODS = ("wol", "amt", "amt-soap", "ipmi")
FSTYPES = ("nfs", "ramfs", "s-ramfs", "isofs")
CONTAINER_STATES = ("terminated", "up", "pending", "running", "shutting-down")
IMAGE_KINDS = ("kernel", "initrd", "rootfs")
