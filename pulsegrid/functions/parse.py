"""Column functions for wire log lines, slugs, ids and timestamps.

Everything here is a built-in Spark expression (JVM side; higher-order functions
are interpreted); no Python runs per row.

Wire format: ``<date> <time> <LEVEL> [<service>] <message> | k=v | ... | trace_id=<id>``.
The line is split on the exact separator `` | ``; the head must match
``^\\S+\\s+\\S+\\s+(\\S+)\\s+\\[([^\\]]+)\\]\\s+(.*)$`` or the line is dropped; every later
piece that contains ``=`` is split at its first ``=``, both sides trimmed, and
the last occurrence of a key wins. Regexes run with Unicode character classes
and ``\\n`` as the only line terminator, which is how the text was meant to be
read (Java's defaults are ASCII classes and several terminators).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wire-format separator and head pattern.
SEPARATOR = " | "
HEAD_PATTERN = r"^\S+\s+\S+\s+(\S+)\s+\[([^\]]+)\]\s+(.*)$"
_FLAGS = "(?U)(?d)"
_WS_EDGES = _FLAGS + r"^\s+|\s+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(x) -> Column:
    """Trim Unicode whitespace from both ends (``str.strip()``), not only spaces."""
    return F.regexp_replace(_c(x), _WS_EDGES, "")


def split_pieces(line) -> Column:
    return F.split(_c(line), r" \| ")


def head_match(head) -> Column:
    return _c(head).rlike(_FLAGS + HEAD_PATTERN)


def head_groups(head) -> Column:
    """[level, message, service] of a matching head, by one match.

    The groups are joined by line feeds: level and message cannot hold one,
    and the service comes last.
    """
    return F.split(F.regexp_replace(_c(head), _FLAGS + HEAD_PATTERN, "$1\n$3\n$2"), "\n", 3)


def context_entries(pieces) -> Column:
    """Array<struct<key,value>> of the ``k=v`` pieces after the head, last key wins, first-seen order kept."""
    rest = F.slice(_c(pieces), 2, F.greatest(F.size(_c(pieces)) - 1, F.lit(0)))
    kv = F.transform(F.filter(rest, lambda p: p.contains("=")),
                     lambda p: F.struct(strip_ws(F.substring_index(p, "=", 1)).alias("key"),
                                        strip_ws(F.substr(p, F.instr(p, "=") + 1)).alias("value")))
    # the one-element arrays bind the pairs, then their keys, so each is built once per line
    bound = F.flatten(F.transform(F.array(kv), lambda pairs: F.flatten(F.transform(
        F.array(F.struct(F.transform(pairs, lambda e: e["key"]).alias("keys"), F.reverse(pairs).alias("last_first"))),
        lambda s: F.transform(F.array_distinct(s["keys"]), lambda k: F.struct(
            k.alias("key"),
            F.element_at(s["last_first"], F.array_position(F.reverse(s["keys"]), k).cast("int"))["value"].alias("value")))))))
    return bound


def context_map(pieces) -> Column:
    rest = F.slice(_c(pieces), 2, F.greatest(F.size(_c(pieces)) - 1, F.lit(0)))
    return F.when(F.exists(rest, lambda p: p.contains("=")), F.map_from_entries(context_entries(pieces)))


def context_text(ctx_map) -> Column:
    """Map rendered as sorted ``k=v`` pairs joined by ``;`` (stable text for comparison)."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(_c(ctx_map)),
                                                 lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")


def slug(x) -> Column:
    """lower, runs of ``[^a-z0-9]`` to ``_``, strip ``_``; empty or missing gives ``alert``."""
    s = F.regexp_replace(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("alert"))


def parse_case_id(x) -> Column:
    """Integer after the last ``-`` (or the whole text), else NULL."""
    tail = F.substring_index(_c(x), "-", -1)
    return tail.try_cast("bigint")


def case_label(case_id) -> Column:
    return F.format_string("CASE-%04d", _c(case_id))


def py_isoformat(ts) -> Column:
    """``datetime.isoformat()`` of a UTC timestamp: fraction only when non-zero, ``+00:00`` suffix."""
    t = _c(ts)
    micros = F.unix_micros(t) % 1_000_000
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
                    .otherwise(F.lit("")),
                    F.lit("+00:00"))


def hms(ts) -> Column:
    return F.date_format(_c(ts), "HH:mm:ss")


def nonempty(x) -> Column:
    """Python truthiness for strings: '' counts as missing."""
    return F.nullif(_c(x), F.lit(""))
