"""Scalar functions as Column expressions (JVM side, no Python UDF)."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def path_escape(x) -> Column:
    """repository URL to a file name: '/' -> '%', trailing '.git' dropped."""
    return F.translate(F.regexp_replace(_c(x), r"\.git$", ""), "/", "%")


def image_name(x) -> Column:
    """name before the first ':' (the whole text when there is none)."""
    return F.substring_index(_c(x), ":", 1)


def image_tag(x) -> Column:
    """tag after the first ':'; NULL when there is none."""
    x = _c(x)
    return F.when(x.contains(":"), F.substr(x, F.instr(x, ":") + 1))


# Fixed pattern: user@host, split at the first '@'.
LOGIN_PATTERN = r"^([^@]*)@(.*)$"


def login_user(x) -> Column:
    """user of ``user@host`` (split at the first '@'), else ``root``."""
    x = _c(x)
    return F.when(x.rlike(LOGIN_PATTERN), F.regexp_extract(x, LOGIN_PATTERN, 1)).otherwise(F.lit("root"))


def login_host(x) -> Column:
    """the part after the first '@', else the whole text."""
    x = _c(x)
    return F.when(x.rlike(LOGIN_PATTERN), F.regexp_extract(x, LOGIN_PATTERN, 2)).otherwise(x)


def strip_prefix(x, prefix) -> Column:
    """drop a leading ``prefix`` (repository root) when present."""
    x = _c(x)
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.when(x.startswith(prefix), F.substr(x, F.length(prefix) + 1)).otherwise(x)


def stem(x) -> Column:
    """text before the first dot."""
    return F.substring_index(_c(x), ".", 1)


def short_id(uuid_col) -> Column:
    """last group of a UUID (pass ``F.expr('uuid()')`` for a new one)."""
    return F.substring_index(_c(uuid_col), "-", -1)


def query_entries(q) -> Column:
    """``k=v&k=v`` to an array of (key, value, pos); key before the first
    '=', value after it ('' when there is no '=').  Empty items are skipped."""
    items = F.filter(F.split(_c(q), "&"), lambda s: s != F.lit(""))
    return F.transform(items, lambda s, i: F.struct(
        F.substring_index(s, "=", 1).alias("key"),
        F.when(s.contains("="), F.substr(s, F.instr(s, "=") + 1)).otherwise(F.lit("")).alias("value"),
        i.alias("pos")))


def parse_query(q, drop_keys=("sign",)) -> Column:
    """query string to a map; a repeated key keeps its last value.

    Done in the array (no dependence on ``spark.sql.mapKeyDedupPolicy``):
    an entry is kept only when no later entry has the same key.  ``sign``
    never counts as a parameter."""
    e = query_entries(q)
    if drop_keys:
        e = F.filter(e, lambda x: ~x["key"].isin(*drop_keys))
    last = F.filter(e, lambda x: ~F.exists(e, lambda y: (y["key"] == x["key"]) & (y["pos"] > x["pos"])))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["key"], x["value"])))


def unknown_keys(q, allowed, drop_keys=("sign",)) -> Column:
    """F7 (refusing form): keys not in ``allowed``; a non-empty array means
    the request is refused."""
    e = query_entries(q)
    return F.filter(F.transform(e, lambda x: x["key"]),
                    lambda k: ~k.isin(*allowed) & ~k.isin(*drop_keys))


def required(m, key) -> Column:
    """F8: a required non-empty parameter: NULL when missing or empty."""
    return F.nullif(_c(m)[key], F.lit(""))


def url_decode(x) -> Column:
    """percent decoding (NULL for malformed input)."""
    return F.try_url_decode(_c(x))


def decode_colon(x) -> Column:
    """F9 (boot loader form): only ``%3A`` is decoded."""
    return F.regexp_replace(_c(x), "%3[Aa]", ":")


def token_after(x, marker: str) -> Column:
    """the token after a marker word, e.g. ``src A`` -> A."""
    return F.nullif(F.regexp_extract(_c(x), marker + r"\s+(\S+)", 1), F.lit(""))


def nth_field(x, delim: str, n: int) -> Column:
    """n-th field (1-based) by a delimiter; NULL past the end."""
    return F.get(F.split(_c(x), re.escape(delim)), n - 1)


def null_if_empty(x) -> Column:
    """NULL for an empty text."""
    return F.nullif(_c(x), F.lit(""))


# Power action codes and early-start rule.
POWER_CODES = {"on": 2, "off": 8, "reset": 5}


def power_code(action) -> Column:
    """power on/off/reset -> 2/8/5; NULL for anything else."""
    m = F.create_map(*[v for k, c in POWER_CODES.items() for v in (F.lit(k), F.lit(c))])
    return m[_c(action)]


def early_start(method) -> Column:
    """early start is off for ``wol`` and on otherwise."""
    return _c(method) != F.lit("wol")


def _text(x) -> Column:
    """A value as the shell sees it: NULL is empty text."""
    return F.coalesce(_c(x).cast("string"), F.lit(""))


def boot_ip(ip4_addr, server, gateway, netmask, node_name, iface) -> Column:
    """F16: the kernel ``ip=`` value: addr:server:gateway:netmask:name:iface."""
    return F.concat_ws(":", *[_text(x) for x in (ip4_addr, server, gateway, netmask, node_name, iface)])


# Boot argument lines by file system type.
BOOT_ARGS_NFS = ("imgargs K{base} bmcid={bmc_id} boot=nfs rootdelay=1 ip={ip} root=/dev/nfs "
                 "nfsroot={server}:{nfs_root} port=tcp rw {kernel_param}")
BOOT_ARGS_RAMFS = ("imgargs K{base} bmcid={bmc_id} boot=local rootdelay=1 ip={ip} "
                   "bmcroot={http}://{server}/{doc}/rootfs/{base}.tar.gz "
                   "bmcroot2={http}://{server}/{doc}/rootfs/{base}-etc.tar.gz rw {kernel_param}")
BOOT_ARGS_ISOFS = "imgargs K{base} iso raw"


def boot_args(fstype, base_name, bmc_id, ip, kernel_param, server, *, doc_path: str, distfs_root: str,
              http: str = "http") -> Column:
    """F16: the boot loader's argument line for a container (NULL for an
    unknown file system type).  ``doc_path`` is the web server's folder,
    ``distfs_root`` the exported one.  ``kernel_param`` is the kernel's and the
    container's parameter joined by a space, as the loader builds it."""
    f = _c(fstype)
    parts = {"base": _text(base_name), "bmc_id": _text(bmc_id), "ip": _text(ip), "kernel_param": _text(kernel_param),
             "server": _text(server), "http": F.lit(http), "doc": F.lit(doc_path),
             "nfs_root": F.concat(F.lit(distfs_root.rstrip("/") + "/"), _text(base_name))}

    def fill(template: str) -> Column:
        fmt, args = [], []
        for piece in re.split(r"(\{[a-z_]+\})", template):
            if piece.startswith("{") and piece.endswith("}"):
                fmt.append("%s")
                args.append(parts[piece[1:-1]])
            else:
                fmt.append(piece.replace("%", "%%"))
        return F.format_string("".join(fmt), *args)

    return (F.when(f == "nfs", fill(BOOT_ARGS_NFS))
            .when(f.isin("ramfs", "s-ramfs"), fill(BOOT_ARGS_RAMFS))
            .when(f == "isofs", fill(BOOT_ARGS_ISOFS)))


def deadline(start, seconds) -> Column:
    """start + timeout seconds."""
    secs = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return _c(start) + F.make_dt_interval(secs=secs)


def time_left(deadline_col, now) -> Column:
    """seconds left until the deadline (negative when passed); no
    session time zone is involved for TIMESTAMP_NTZ inputs."""
    return F.timestamp_diff("MICROSECOND", _c(now), _c(deadline_col)) / F.lit(1e6)


def expired(valid_until, now) -> Column:
    """strictly past (expiring exactly now is still valid)."""
    return _c(valid_until) < _c(now)


def gflops(n, seconds) -> Column:
    """GFLOPS of an n x n matrix multiply: 2 n^3 / t * 1e-9 (NULL for t = 0)."""
    return F.try_divide(F.lit(2.0) * F.pow(_c(n).cast("double"), 3), _c(seconds)) * F.lit(1e-9)


def passwd_homes(lines):
    """F19 lookup table: passwd lines (column ``line``, ``name:x:uid:gid:gecos:home:shell``)
    to (user, home), the first line of a name winning (P7, a partial
    ``min_by`` on the line number ``line_no``)."""
    fields = F.split(F.col("line"), ":")
    rows = lines.select(F.get(fields, 0).alias("user"), F.get(fields, 5).alias("home"), "line_no")
    return rows.where(F.col("user").isNotNull()).groupBy("user").agg(F.min_by("home", "line_no").alias("home"))


def home_dir(user, passwd_home) -> Column:
    """home directory: passwd field 6 when known, else /root for root
    and /home/USER otherwise."""
    u = _c(user)
    return F.coalesce(_c(passwd_home), F.when(u == "root", F.lit("/root")).otherwise(F.concat(F.lit("/home/"), u)))
