"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def check_sizes(total: int, n: int) -> None:
    """Refuse shard counts that cannot be filled."""
    if n < 1:
        raise ValueError(f"a split needs at least one shard, not {n}")
    if total < n:
        raise ValueError(f"{total} rows cannot fill {n} shards")


def int_div(value: Column, by: int | Column) -> Column:
    """Whole-number division on longs (``/`` would go through double)."""
    return F.call_function("div", value, by if isinstance(by, Column) else F.lit(by).cast("long"))


def shard_of(row_idx: Column, total: int, n: int) -> Column:
    """Shard of a row: blocks of ``total div n`` rows, the remainder goes to the last one."""
    check_sizes(total, n)
    return F.least(int_div(row_idx, total // n), F.lit(n - 1).cast("long")).cast("int")


def shard_name(stem: str, shard_id: Column, suffix: str) -> Column:
    """``stem.shardNNNN.ext``, the number padded to four digits."""
    return F.format_string("%s.shard%04d%s", F.lit(stem), shard_id, F.lit(suffix))


def output_path(base: str, rel: Column) -> Column:
    """Path of a relative output below ``base``."""
    return F.concat(F.lit(base.rstrip("/") + "/"), rel)


def ancestors(rel: Column) -> Column:
    """Every leading part of a relative path, the path itself last."""
    parts = F.split(rel, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
    )


def glob_regex(pattern: str) -> str:
    """Java regex for a shell pattern; ``*`` crosses ``/``, as in plain name matching."""
    out, i = [], 0
    while i < len(pattern):
        char = pattern[i]
        i += 1
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif char == "[":
            # A `]` right after the opening bracket (or its `!`) belongs to the set.
            first = i + 1 if pattern[i : i + 1] == "!" else i
            end = pattern.find("]", first + 1)
            if end < 0:
                out.append("\\[")
                continue
            out.append(_char_set(pattern[first:end], negated=first > i))
            i = end + 1
        else:
            out.append(_literal(char))
    return "(?s)^" + "".join(out) + "\\z"


def path_regexes(patterns: Sequence[str]) -> list[str]:
    """Python regexes (to be matched with DOTALL) of the patterns, in the meaning of ``glob_regex``."""
    cleaned = [p.strip().rstrip("/") for p in patterns]
    return [glob_regex(p).removeprefix("(?s)^").removesuffix("\\z") + "\\Z" for p in dict.fromkeys(cleaned) if p]


def _literal(char: str) -> str:
    return char if char.isalnum() or char in "_/ " or ord(char) > 127 else "\\" + char


def _char_set(body: str, negated: bool) -> str:
    items, i = [], 0
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-":
            low, high = body[i], body[i + 2]
            if low <= high:
                items.append(f"{_literal(low)}-{_literal(high)}")
            i += 3
        else:
            items.append(_literal(body[i]))
            i += 1
    if not items:
        return "." if negated else "(?!)"
    return f"[{'^' if negated else ''}{''.join(items)}]"


def matches_any(rel: Column, patterns: Sequence[str]) -> Column:
    """True when a pattern fits the path, one of its parent directories or one path part."""
    cleaned = [p.strip().rstrip("/") for p in patterns]
    regexes = [glob_regex(p) for p in cleaned if p]
    if not regexes:
        return F.lit(False)
    one_regex = "|".join(f"(?:{r})" for r in dict.fromkeys(regexes))
    candidates = F.concat(ancestors(rel), F.split(rel, "/"))
    return F.exists(candidates, lambda part: part.rlike(one_regex))


def _tagged(value: Column) -> Column:
    """Text with its byte length in front, so that neighbours cannot run together."""
    return F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)


def _steady(value: Column, kind: T.DataType) -> Column:
    """The value in a form whose text depends on neither the time zone nor the order of a map."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _steady(x, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = [_steady(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    if isinstance(kind, T.MapType):
        entry = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        return F.array_sort(F.transform(F.map_entries(value), lambda x: F.struct(F.to_json(F.struct(_steady(x, entry).alias("e"))))))
    return value


def row_digest(fields: Sequence[T.StructField]) -> Column:
    """sha256 (hex) of a row: each column as ``length:text``, null as ``-``."""
    parts = []
    for field in fields:
        value = _steady(F.col("`" + field.name.replace("`", "``") + "`"), field.dataType)
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            text = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
            text = F.when(value.isNotNull(), text)
        elif isinstance(field.dataType, T.BinaryType):
            text = F.hex(value)
        else:
            text = value.cast("string")
        parts.append(F.coalesce(_tagged(text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def pair_digest(left: Column, right: Column) -> Column:
    """sha256 (hex) of two texts, both with their length in front."""
    return F.sha2(F.concat(_tagged(left), _tagged(right)), 256)
