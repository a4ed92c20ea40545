"""A small hand-made fleet with the rows FIXTURES §2 asks for."""

import datetime as dt

from bootlens import schemas as S

T0 = dt.datetime(2024, 1, 1, 9, 0, 0)


def fleet(spark):
    nodes = spark.createDataFrame([
        (1, "n1", "d", 1, True, "ipmi", "m1", "10.0.1.1", "pw", "10.0.2.1", "eth0", "10.0.3.1", None, None, None),
        (2, "n2", "d", 1, False, "wol", None, "10.0.1.2", "pw", "10.0.2.2", "eth0", "10.0.3.2", None, None, None),
        (3, "n3", "d", 2, True, "amt", None, "10.0.1.3", "pw", "10.0.2.3", "eth0", "10.0.3.3", None, None, None),
        (4, "n4", "d", 2, False, "bogus", "m4", "10.0.1.3", "pw", "10.0.2.4", "eth0", "10.0.3.4", None, None, None),
        (5, "", "d", None, True, None, "m5", "10.0.1.5", "pw", "10.0.2.5", "eth0", "10.0.3.5", None, None, None),
    ], S.NODE)
    kernels = spark.createDataFrame([
        (10, "kA", "k/a", "k/a.sig", "quiet"), (11, "kB", "k/b", "", None), (12, "kC", "k/c", None, "ro"),
    ], S.KERNEL)
    initrds = spark.createDataFrame([(20, "iA", "i/a", "i/a.sig"), (21, "iB", "i/b", None)], S.INITRD)
    rootfs = spark.createDataFrame([(30, "rA", "r/a", None), (31, "rB", "r/b", None)], S.ROOTFS)
    containers = spark.createDataFrame([
        # running on node 1
        ("c1", "b1", "cli", 10, "x=1", 20, 30, "nfs", 1, "sh", T0, "running"),
        # allocated but still 'terminated' (power-on not done): occupies node 3
        ("c2", "b2", "cli", 12, None, 20, 30, "ramfs", 3, "sh", T0 + dt.timedelta(seconds=1), "terminated"),
        # terminated, node NULL
        ("c3", "b3", "cli", 10, "y", 21, 31, "nfs", None, "sh", T0 + dt.timedelta(seconds=2), "terminated"),
        # kernel row gone (orphan)
        ("c4", "b4", "cli", 99, "z", 20, 31, "s-ramfs", 2, "sh", T0 + dt.timedelta(seconds=3), "pending"),
    ], S.CONTAINER)
    return nodes, containers, kernels, initrds, rootfs
