"""Key layouts: an ordered list of typed fields, with codecs whose byte order is the logical order."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Widths in bytes and Spark types of the field kinds; fixed values.
KINDS = {"uint8": (1, "smallint"), "uint16": (2, "int"), "uint32": (4, "bigint"), "uint64": (8, "decimal(20,0)"), "int64": (8, "bigint"), "dict16": (2, "string"), "dict32": (4, "string")}
#: Largest codes of the dictionary kinds; fixed values.
MAX_CODE = {"dict16": 65_535, "dict32": 2**31 - 1}
#: Bytes of an encoded dictionary string, escapes and terminator included.
MAX_ENCODED = 128


def wide_literal(n: int) -> Column:
    """Literals beyond signed 64 bits go in as text."""
    return F.lit(str(n)).cast("decimal(20,0)")


@dataclass(frozen=True)
class KeyField:
    name: str
    kind: str

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind of key field: {self.kind}")
        if not self.name:
            raise ValueError("a key field needs a name")

    @property
    def width(self) -> int:
        return KINDS[self.kind][0]

    @property
    def is_dictionary(self) -> bool:
        return self.kind in MAX_CODE


@dataclass(frozen=True)
class KeyLayout:
    fields: tuple[KeyField, ...]

    def __post_init__(self) -> None:
        if not self.fields:
            raise ValueError("a layout needs a field")
        if len({f.name for f in self.fields}) < len(self.fields):
            raise ValueError("two key fields have one name")

    @classmethod
    def of(cls, **kinds: str) -> KeyLayout:
        return cls(tuple(KeyField(n, k) for n, k in kinds.items()))

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def width(self) -> int:
        return sum(f.width for f in self.fields)

    def field(self, which: str | int) -> KeyField:
        """By name or by place."""
        if isinstance(which, int):
            return self.fields[which]
        for f in self.fields:
            if f.name == which:
                return f
        raise KeyError(which)

    def offset(self, name: str) -> int:
        at = 0
        for f in self.fields:
            if f.name == name:
                return at
            at += f.width
        raise KeyError(name)

    def fingerprint(self) -> str:
        """Kind, width, name and order of all fields."""
        return json.dumps([[f.kind, f.width, f.name] for f in self.fields])

    @classmethod
    def from_fingerprint(cls, text: str) -> KeyLayout:
        return cls(tuple(KeyField(name, kind) for kind, _, name in json.loads(text)))

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, T._parse_datatype_string(KINDS[f.kind][1])) for f in self.fields])

    def cast(self, df: DataFrame) -> DataFrame:
        """``df`` with its key columns cast; numeric ones must be there and in range."""
        out = df
        for f in self.fields:
            col = F.col(f.name).cast(KINDS[f.kind][1])
            if not f.is_dictionary:
                low, high = (-(2**63), 2**63 - 1) if f.kind == "int64" else (0, 2 ** (8 * f.width) - 1)
                wide = F.col(f.name).cast("decimal(20,0)")
                fits = wide.between(wide_literal(low), wide_literal(high))
                col = F.when(F.coalesce(fits, F.lit(False)), col).otherwise(F.raise_error(F.lit(f"key field {f.name} is null or out of range")))
            out = out.withColumn(f.name, col)
        return out

    def encode(self, codes: dict[str, Column] | None = None) -> Column:
        """The whole key as bytes. ``codes``: the code columns of dictionary fields (``<name>_code`` if not given)."""
        parts = []
        for f in self.fields:
            col = (codes or {}).get(f.name, F.col(f"{f.name}_code")) if f.is_dictionary else F.col(f.name)
            parts.append(encode_int(F.coalesce(col, F.lit(0)), f.width, signed=f.kind == "int64"))
        return reduce(lambda a, b: F.concat(a, b), parts)


def encode_int(col: Column, width: int, signed: bool = False) -> Column:
    """Big-endian bytes; of signed integers the sign bit is flipped, so bytes order as numbers do."""
    if signed:
        number = col.cast("bigint").bitwiseXOR(F.lit(-(2**63)).cast("bigint")) if width == 8 else col.cast("bigint") + 2 ** (8 * width - 1)
        digits = F.hex(number)
    elif width == 8:
        # Unsigned 64 bits as two halves, since hex() takes signed numbers.
        wide = col.cast("decimal(20,0)")
        high = F.floor(wide / wide_literal(2**32)).cast("bigint")
        low = (wide - high.cast("decimal(20,0)") * wide_literal(2**32)).cast("bigint")
        digits = F.concat(F.lpad(F.hex(high), 8, "0"), F.lpad(F.hex(low), 8, "0"))
    else:
        digits = F.hex(col.cast("bigint"))
    return F.unhex(F.lpad(digits, 2 * width, "0"))


def decode_int(col: Column, offset: int, width: int, signed: bool = False) -> Column:
    """The inverse of ``encode_int``, from a key's bytes."""
    digits = F.hex(F.substring(col, offset + 1, width))
    if width == 8:
        halves = [F.conv(F.substring(digits, k, 8), 16, 10).cast("decimal(20,0)") for k in (1, 9)]
        wide = halves[0] * wide_literal(2**32) + halves[1]
        return (wide - wide_literal(2**63)).cast("bigint") if signed else wide.cast("decimal(20,0)")
    number = F.conv(digits, 16, 10).cast("bigint")
    return number - 2 ** (8 * width - 1) if signed else number


def encoded_length(col: Column) -> Column:
    """Bytes of a dictionary string with an escape before each byte 0 or 1 and a terminator."""
    escapes = F.length(F.regexp_replace(col, "[^\\x00\\x01]", ""))
    return F.octet_length(col) + escapes + 1


def encode_string(text: str) -> bytes:
    out = bytearray()
    for b in text.encode():
        out += bytes([1, b]) if b <= 1 else bytes([b])
    return bytes(out + b"\0")


def decode_string(raw: bytes) -> str:
    out, it = bytearray(), iter(raw)
    for b in it:
        if b == 0:
            break
        out.append(next(it, 0) if b == 1 else b)
    return out.decode()
