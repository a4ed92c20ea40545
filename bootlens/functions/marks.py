"""parse a timeline mark.

A mark message reads ``[PREFIX ]PHASE:begin|end[ REST]`` or, from the boot
loader and inside containers, ``PHASE:begin_REST``.  Neither prefix nor phase
may hold a colon, so a logged user command such as
``exec_run:begin ... x:end`` is read by its first mark only.
"""

from pyspark.sql import Column, functions as F

# Fixed patterns of the mark grammar.
MARK_PATTERN = r"^(?:([^\s:]+) )?([^\s:]+):(begin|end)(?:[ _](.*))?$"
BMCID_PATTERN = r"bmcid=(\S+)"
START_MARK = "--Start--"
# Marks that name their container as the first word (kill1/rm1 ID),
# and the name prefix of the web scripts, which write no start line.
ID_FIRST_PHASES = ("exec_kill1", "exec_rm1")
SCRIPT_PREFIX = "cgi-"
END_MARK = "--End--"


SEP = "\u0001"


def mark_joined(msg: Column) -> Column:
    """The message with a mark rewritten to ``g1 SEP g2 SEP g3 SEP g4`` in one regex pass."""
    return F.regexp_replace(msg, MARK_PATTERN, SEP.join(f"${i}" for i in range(1, 5)))


def mark_split(msg: Column, joined: Column) -> Column:
    """The four groups of the mark pattern; NULL when the message is not a mark.

    A mark loses its first colon when it is rewritten, so only a mark differs from its message."""
    return F.when(joined != msg, F.split(joined, SEP, 4))


def mark_parts(msg: Column) -> Column:
    """The four groups of the mark pattern; NULL when the message is not a mark.
    Select it once and take fields with ``mark_field``."""
    return mark_split(msg, mark_joined(msg))


def mark_field(parts: Column, i: int) -> Column:
    return F.nullif(F.element_at(parts, i), F.lit(""))


def mark_prefix(msg: Column) -> Column:
    return mark_field(mark_parts(msg), 1)


def mark_phase(msg: Column) -> Column:
    return mark_field(mark_parts(msg), 2)


def mark_kind(msg: Column) -> Column:
    return mark_field(mark_parts(msg), 3)


def mark_rest(msg: Column) -> Column:
    return mark_field(mark_parts(msg), 4)


def bmcid_of(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, BMCID_PATTERN, 1), F.lit(""))


def container_id(phase: Column, kind: Column, rest: Column) -> Column:
    """The container a mark names: ``bmcid=ID`` in the rest, or the first
    word of the rest for ``exec_kill1:begin ID`` and ``exec_rm1:begin ID``."""
    first_word = F.nullif(F.regexp_extract(rest, r"^(\S+)", 1), F.lit(""))
    positional = F.when(phase.isin(*ID_FIRST_PHASES) & (kind == F.lit("begin")), first_word)
    return F.coalesce(bmcid_of(rest), positional)


def parse_mark(msg: Column) -> Column:
    """Struct (prefix, phase, kind, rest, bmc_id); all NULL when not a mark.
    (For whole tables prefer ``bootlens.operators.timeline.marks``, which
    runs the pattern once per line.)"""
    parts = mark_parts(msg)
    phase, kind, rest = mark_field(parts, 2), mark_field(parts, 3), mark_field(parts, 4)
    return F.struct(mark_field(parts, 1).alias("prefix"), phase.alias("phase"), kind.alias("kind"),
                    rest.alias("rest"), container_id(phase, kind, rest).alias("bmc_id"))
