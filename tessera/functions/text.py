"""Text column builders: rendering result rows and matching golden lines.

All built-in expressions. A golden token is judged once, on the target's side: does it hold metacharacters,
and is it a valid Java pattern? Only then does it become an anchored regular expression, which the rows are
tested with by ``regexp_instr`` (it keeps the last compiled pattern, where ``rlike`` on a column compiles anew
every row). An invalid pattern matches nothing but itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_META = r"[\\.\[\]{}()*+?^$|]"


_CTRL = "".join(chr(i) for i in range(0x21))


def jtrim(c: Column) -> Column:
    """Java ``String.trim``: strip chars <= U+0020 at both ends."""
    return F.trim(c, F.lit(_CTRL))


def tokens(c: Column, sep: str = r"\s+") -> Column:
    """``line.split(sep).map(_.trim).filter(_.nonEmpty)`` as an array column."""
    return F.filter(F.transform(F.split(c, sep), lambda x: jtrim(x)), lambda x: F.length(x) > 0)


def compile_pattern(pattern: Column) -> Column:
    """Tokens of a golden line: array<struct<text, rx>>, ``rx`` null where a token is plain text.

    ``rx`` matches a whole token. A token that opens a quotation (``\\Q``) is closed before the anchor.
    """
    valid = lambda t: F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), t).isNotNull()
    opened = lambda t: F.instr(F.substring_index(t, r"\Q", -1), r"\E") == 0
    closed = lambda t: F.when(F.contains(t, F.lit(r"\Q")) & opened(t), F.concat(t, F.lit(r"\E"))).otherwise(t)
    return F.transform(tokens(pattern), lambda t: F.struct(
        t.alias("text"),
        F.when(t.rlike(_META) & valid(t), F.concat(F.lit(r"\A(?:"), closed(t), F.lit(r")\z"))).alias("rx")))


def match_compiled(line: Column, compiled: Column) -> Column:
    """Token-wise line match against ``compile_pattern``: both empty -> true; counts equal; each token equal or
    matched whole."""
    lt = tokens(line)
    hit = lambda w, p: (w == p["text"]) | F.when(
        p["rx"].isNotNull(), F.regexp_instr(w, p["rx"]) > 0).otherwise(False)
    return (F.size(lt) == F.size(compiled)) & F.forall(F.zip_with(lt, compiled, hit), lambda x: x)


def match_line(line: Column, pattern: Column) -> Column:
    """Token-wise match of a line and a golden line; equal texts need no tokens."""
    return F.when(line == pattern, F.lit(True)).otherwise(match_compiled(line, compile_pattern(pattern)))


VARIABLE = r"\$\{(\w+)\}"


def substitute(text: Column, variables: Column) -> Column:
    """``${name}`` -> value from the ``variables`` map, in one pass: values are not substituted again, and
    unknown names stay as written."""
    names = F.regexp_extract_all(text, F.lit(VARIABLE), F.lit(1))
    values = F.transform(names, lambda k: F.coalesce(F.try_element_at(variables, k),
                                                     F.concat(F.lit("${"), k, F.lit("}"))))
    parts = F.split(text, VARIABLE, -1)
    return F.array_join(F.zip_with(parts, values, lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")


def render_line(cols: Sequence[Column | str]) -> Column:
    """Row -> text: cells joined by one space; null or blank cells dropped; kept cells untrimmed."""
    cells = []
    for c in cols:
        s = (F.col(c) if isinstance(c, str) else c).cast("string")
        cells.append(F.when(F.length(jtrim(s)) > 0, s))
    return F.concat_ws(" ", *cells)
