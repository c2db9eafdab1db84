"""Column functions of contract data.

Signatures and type names are literals, so result types are known when a query
is planned: each function builds an Arrow-batched UDF for its signature, or a
plain literal where nothing depends on rows.  In SQL, elementary types, strings
and bytes take JVM expressions instead (``abisql``).
"""

from __future__ import annotations

import decimal
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import abi


def evm_topic(signature: str) -> Column:
    """The topic of an event signature, as a literal."""
    return F.lit(abi.parse_signature(signature).topic)


def _each(result: T.DataType, one: Callable) -> Callable:
    """A pandas UDF that applies `one` to the values of each row."""
    if isinstance(result, T.StructType):

        def rows(*columns: pd.Series) -> pd.DataFrame:
            made = [one(*values) for values in zip(*map(_values, columns), strict=True)]
            return pd.DataFrame({f.name: pd.Series([None if m is None else m[f.name] for m in made], dtype=object) for f in result.fields})

        return F.pandas_udf(rows, result)

    def values(*columns: pd.Series) -> pd.Series:
        return pd.Series([one(*v) for v in zip(*map(_values, columns), strict=True)], dtype=object)

    return F.pandas_udf(values, result)


def _values(column: pd.Series | pd.DataFrame):
    """A column's values; a struct column comes as a frame and gives tuples."""
    return column.itertuples(index=False, name=None) if isinstance(column, pd.DataFrame) else column


def _null(v) -> bool:
    return v is None or v is pd.NA or (isinstance(v, float) and v != v)


def _struct(names: list[str], types: list[abi.Type]) -> T.StructType:
    return T.StructType([T.StructField(n, abi.spark_type(t)) for n, t in zip(names, types, strict=True)])


def evm_decode_log(topic1: Column, topic2: Column, topic3: Column, data: Column, signature: str) -> Column:
    """See log_udf; an event without parameters is a null."""
    return log_udf(signature)(topic1, topic2, topic3, data) if abi.parse_signature(signature).params else F.lit(None)


def log_fields(event: abi.Signature) -> tuple[list[abi.Type], list[abi.Type], list[str]]:
    """The types of an event's indexed parameters and of the others, and the names of all, indexed ones first."""
    indexed = [p for p in event.params if p.indexed]
    if len(indexed) > 3:
        raise abi.AbiError("an event has three indexed parameters at most")
    body = [p for p in event.params if not p.indexed]
    # What an indexed parameter of a reference type leaves is its 32-byte hash.
    shown = [abi.Type("bytesN", 32) if p.type.dynamic or p.type.kind in ("array", "tuple") else p.type for p in indexed]
    return shown, [p.type for p in body], [p.name or f"c{i}" for i, p in enumerate(indexed + body)]


def param_names(function: abi.Signature) -> list[str]:
    if any(not p.name for p in function.params):
        raise abi.AbiError("the parameters need names")
    return [p.name for p in function.params]


def log_udf(signature: str):
    """A struct of an event's parameters: indexed ones from topics, the others from the data.

    A null topic gives a null field; data that is null or does not decode gives
    null fields for all that lies in it; the struct itself is never null.
    """
    shown, body, names = log_fields(abi.parse_signature(signature))
    types = shown + body
    result = _struct(names, types)

    def one(t1, t2, t3, raw):
        values = []
        for t, topic in zip(shown, (t1, t2, t3), strict=False):
            try:
                values.append(None if _null(topic) else abi.from_word(t, bytes(topic).rjust(32, b"\0")))
            except abi.AbiError:
                values.append(None)
        try:
            values += [None] * len(body) if _null(raw) else abi.decode_sequence(tuple(body), bytes(raw))
        except abi.AbiError:
            values += [None] * len(body)
        return {n: abi.to_spark(t, v) for n, t, v in zip(names, types, values, strict=True)}

    return _each(result, one)


evm_decode = evm_decode_log


def evm_decode_params(data: Column, signature: str) -> Column:
    """A struct of a call's arguments; null if the data is null, short, of another selector, or does not decode."""
    function = abi.parse_signature(signature)
    if not function.params:
        return F.when(F.substring(data, 1, 4) == F.lit(function.selector), F.struct())
    made = params_udf(signature)(data)
    return F.when(made["ok"], made["value"])


def params_udf(signature: str):
    """Struct (value, ok) of a call's arguments."""
    function = abi.parse_signature(signature)
    types, names = tuple(p.type for p in function.params), param_names(function)
    selector = function.selector
    result = T.StructType([T.StructField("value", _struct(names, list(types))), T.StructField("ok", T.BooleanType())])

    def one(raw):
        try:
            if not _null(raw) and bytes(raw[:4]) == selector:
                values = abi.decode_sequence(types, bytes(raw[4:]))
                return {"value": {n: abi.to_spark(t, v) for n, t, v in zip(names, types, values, strict=True)}, "ok": True}
        except abi.AbiError:
            pass
        return {"value": None, "ok": False}

    return _each(result, one)


def evm_encode_params(values: list[Column], signature: str) -> Column:
    """Selector and encoded arguments; an error where an argument is null or does not fit its type."""
    made = encode_params_udf(signature, len(values))
    return made(*values) if values else F.lit(abi.parse_signature(signature).selector)


def encode_params_udf(signature: str, given: int):
    function = abi.parse_signature(signature)
    types = tuple(p.type for p in function.params)
    if given != len(types):
        raise abi.AbiError(f"{len(types)} values wanted, {given} given")

    def one(*row):
        return function.selector + abi.encode_sequence(types, [None if _null(v) else _plain(v) for v in row])

    return _each(T.BinaryType(), one)


def _plain(v):
    return v.tolist() if hasattr(v, "tolist") and not isinstance(v, bytes) else v


def evm_decode_type(data: Column, type_name: str) -> Column:
    """One value of a type; null if the data does not decode."""
    return decode_type_udf(type_name)(data)


def decode_type_udf(type_name: str):
    t = abi.parse_type(type_name)

    def one(raw):
        try:
            return None if _null(raw) else abi.to_spark(t, abi.decode(t, bytes(raw)))
        except abi.AbiError:
            return None

    return _each(abi.spark_type(t), one)


def evm_encode_type(value: Column, type_name: str) -> Column:
    """The encoding of one value; an error where it does not fit the type, null for null."""
    return encode_type_udf(type_name)(value)


def encode_type_udf(type_name: str):
    t = abi.parse_type(type_name)

    def one(v):
        return None if _null(v) else abi.encode(t, _plain(v))

    return _each(T.BinaryType(), one)


def evm_encode_hex(text: str | None) -> Column:
    """20 or 32 bytes from hex text with or without 0x, as a literal."""
    if text is None:
        raise abi.AbiError("null is no hex text")
    digits = text.removeprefix("0x")
    if len(digits) % 2:
        raise abi.AbiError("odd number of digits")
    try:
        raw = bytes.fromhex(digits)
    except ValueError as e:
        raise abi.AbiError(f"invalid hex text: {text!r}") from e
    if len(raw) not in (20, 32):
        raise abi.AbiError(f"expected 20 or 32 bytes, got {len(raw)}")
    return F.lit(raw)


def evm_decode_hex(data: Column) -> Column:
    """0x and lower-case hex digits, in the JVM."""
    return F.concat(F.lit("0x"), F.lower(F.hex(data)))


MAX_UNITS = 32
_EXACT = decimal.Context(prec=200, Emin=-999999, Emax=999999)


def shift(value, units) -> str | None:
    """value * 10**units, exactly, in plain notation without trailing zeros."""
    if _null(value):
        return None
    units = 1 if _null(units) else int(units)
    if abs(units) > MAX_UNITS:
        raise ValueError(f"units must be between -{MAX_UNITS} and {MAX_UNITS}")
    moved = _EXACT.scaleb(_EXACT.create_decimal(str(value)), units)
    text = format(moved, "f")
    if "." in text:
        text = text.rstrip("0").rstrip(".")
    return "0" if text in ("-0", "") else text


def shift_units(value: Column, units: Column) -> Column:
    """Decimal text of value * 10**units (numbers or texts); a null value gives null, null units count as 1."""
    return SHIFT_UDF(value.cast("string"), units.cast("int"))


SHIFT_UDF = _each(T.StringType(), lambda v, u: shift(v, u))


def eth_call(client: Callable, sender: Column, to: Column, data: Column, block: Column, tries: int = 3) -> Column:
    """See eth_call_udf."""
    return eth_call_udf(client, tries)(sender, to, data, block)


def eth_call_udf(client: Callable[[bytes, bytes | None, bytes | None, str], tuple[bytes | None, str | None]], tries: int = 3):
    """Struct (data, message) of a read-only call (sender, target, data, block) through an injected client.

    The client returns (data, message) or raises; a failure is tried again.  A
    null target or block is an error.  Equal calls of a batch are made once.
    """
    result = T.StructType([T.StructField("data", T.BinaryType()), T.StructField("message", T.StringType())])

    def rows(s: pd.Series, t: pd.Series, d: pd.Series, b: pd.Series) -> pd.DataFrame:
        known: dict = {}
        out = []
        for call in zip(s, t, d, b, strict=True):
            call = tuple(None if _null(v) else v for v in call)
            if call[1] is None or call[3] is None:
                raise ValueError("eth_call needs a target and a block")
            for left in range(tries - 1, -1, -1):
                if call in known:
                    break
                try:
                    known[call] = client(*call)
                except Exception:
                    if not left:
                        raise
            out.append(known[call])
        return pd.DataFrame({"data": pd.Series([x[0] for x in out], dtype=object), "message": pd.Series([x[1] for x in out], dtype=object)})

    return F.pandas_udf(rows, result).asNondeterministic()
