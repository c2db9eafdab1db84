"""Contract values as JVM expressions: SQL text for elementary types, strings and bytes.

Words of 32 bytes are read and written with ``substring``, ``hex`` and ``conv``; numbers
of over 64 bits become decimal text by way of limbs to the base 10**18, whose
sums fit DECIMAL(38, 0).  They become temporary SQL functions, so that an argument
is computed once however often its name comes.  Arrays and tuples, and numbers
that are given as anything but Spark integers, are left to the Arrow functions
of ``evm``.
"""

from __future__ import annotations

from pyspark.sql import types as T

from . import abi

STATIC = ("int", "uint", "bool", "address", "bytesN")
_LIMB = 10**18
_INTEGERS = "('tinyint', 'smallint', 'int', 'bigint')"


def plain(types: list[abi.Type]) -> bool:
    """Whether all types have expressions."""
    return all(t.kind in STATIC or t.kind in ("string", "bytes") for t in types)


# Decoding -----------------------------------------------------------------


def _check(t: abi.Type, word: str) -> str:
    """Whether a word holds a value of the type."""
    if t.kind in ("uint", "int"):
        pad = 32 - t.size // 8
        if not pad:
            return "true"
        if t.kind == "uint":
            return f"substring({word}, 1, {pad}) = X'{'00' * pad}'"
        sign = f"substring({word}, {pad + 1}, 1) >= X'80'"
        return f"substring({word}, 1, {pad}) = CASE WHEN {sign} THEN X'{'FF' * pad}' ELSE X'{'00' * pad}' END"
    if t.kind == "bool":
        return f"substring({word}, 1, 31) = X'{'00' * 31}' AND substring({word}, 32, 1) <= X'01'"
    if t.kind == "address":
        return f"substring({word}, 1, 12) = X'{'00' * 12}'"
    return f"substring({word}, {t.size + 1}, {32 - t.size}) = X'{'00' * (32 - t.size)}'" if t.size < 32 else "true"


def _decimal_text() -> list[str]:
    """Statements that make DECIMAL_TEXT(p3, p2, p1, p0, minus): the decimal text of four 64-bit parts, in limbs of 18 digits; of the negative number whose parts have those inverted bits if minus."""
    totals: list[str] = []
    for j in range(5):
        terms = [f"p{k} * {w}BD" if w != 1 else f"p{k}" for k in range(4) if (w := 2 ** (64 * k) // _LIMB**j % _LIMB)]
        if not j:
            terms.append("CASE WHEN minus THEN 1 ELSE 0 END")
        if totals:
            terms.append(f"CAST((t{j - 1} - t{j - 1} % {_LIMB}BD) / {_LIMB}BD AS DECIMAL(38, 0))")
        totals.append(f"CAST({' + '.join(terms)} AS DECIMAL(38, 0))")
    # Each function names one more limb's total, so that none is written out twice.
    parts = ", ".join(f"p{k} DECIMAL(20, 0)" for k in (3, 2, 1, 0)) + ", minus BOOLEAN"
    own = "p3, p2, p1, p0, minus"
    known = lambda n: "".join(f", t{j} DECIMAL(38, 0)" for j in range(n))
    digits = ", ".join(f"lpad(CAST(t{j} % {_LIMB}BD AS STRING), 18, '0')" for j in range(4, -1, -1))
    text = f"trim(LEADING '0' FROM concat({digits}))"
    out = [f"CREATE OR REPLACE TEMPORARY FUNCTION {DECIMAL_TEXT}_5({parts}{known(5)}) RETURNS STRING RETURN concat(CASE WHEN minus THEN '-' ELSE '' END, CASE WHEN {text} = '' THEN '0' ELSE {text} END)"]
    for n in range(4, -1, -1):
        args = "".join(f", t{j}" for j in range(n))
        name = f"{DECIMAL_TEXT}_{n}" if n else DECIMAL_TEXT
        out.append(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parts}{known(n)}) RETURNS STRING RETURN {DECIMAL_TEXT}_{n + 1}({own}{args}, {totals[n]})")
    return out


DECIMAL_TEXT = "blockloom_decimal_text"


def _text(t: abi.Type, word: str) -> str:
    """Decimal text of an integer word."""
    parts = [f"CAST(conv(hex(substring({word}, {8 * k + 1}, 8)), 16, 10) AS DECIMAL(20, 0))" for k in range(4)]
    minus, low = f"substring({word}, 1, 1) >= X'80'", f"hex(substring({word}, 25, 8))"
    # Numbers of 64 bits need no limbs; their parts are null, so that nothing is computed.
    short = [(f"substring({word}, 1, 24) = X'{'00' * 24}'", f"conv({low}, 16, 10)")]
    if t.kind == "int":
        short.append((f"substring({word}, 1, 24) = X'{'FF' * 24}' AND substring({word}, 25, 1) >= X'80'", f"conv({low}, 16, -10)"))
        parts = [f"CASE WHEN {minus} THEN 18446744073709551615BD - {p} ELSE {p} END" for p in parts]
    is_short = " OR ".join(f"({c})" for c, _ in short)
    parts = [f"CASE WHEN NOT ({is_short}) THEN {p} END" for p in parts]
    long = f"{DECIMAL_TEXT}({', '.join(parts)}, {minus if t.kind == 'int' else 'false'})"
    return f"CASE {' '.join(f'WHEN {c} THEN {v}' for c, v in short)} ELSE {long} END"


def _value(t: abi.Type, word: str) -> str:
    if t.kind in ("int", "uint"):
        held = abi.spark_type(t)
        if t.size <= 64:
            return f"CAST(conv(hex(substring({word}, 25, 8)), 16, {'-10' if t.kind == 'int' else '10'}) AS {held.simpleString()})"
        return _text(t, word) if isinstance(held, T.StringType) else f"CAST({_text(t, word)} AS {held.simpleString()})"
    if t.kind == "bool":
        return f"substring({word}, 32, 1) = X'01'"
    return f"substring({word}, 13, 20)" if t.kind == "address" else f"substring({word}, 1, {t.size})"


def _short(word: str) -> str:
    """A word as a length or place: an INT, or null where it is beyond any data."""
    return f"CASE WHEN substring({word}, 1, 28) = X'{'00' * 28}' AND substring({word}, 29, 1) < X'80' THEN CAST(conv(hex(substring({word}, 29, 4)), 16, 10) AS INT) END"


def sequence(types: list[abi.Type], data: str) -> tuple[str, list[str]]:
    """Whether data holds a sequence of types (null counts as no), and the values' expressions."""
    checks, values = [f"octet_length({data}) >= {sum(t.head for t in types)}"], []
    at = 0
    for t in types:
        word = f"substring({data}, {at + 1}, 32)"
        if t.kind in STATIC:
            checks.append(_check(t, word))
            values.append(_value(t, word))
        else:
            place = f"({_short(word)})"
            size = f"({_short(f'substring({data}, {place} + 1, 32)')})"
            raw = f"substring({data}, {place} + 33, {size})"
            checks.append(f"CAST({place} AS BIGINT) + 32 <= octet_length({data}) AND CAST({place} AS BIGINT) + 32 + {size} <= octet_length({data})")
            if t.kind == "string":
                checks.append(f"is_valid_utf8(CAST({raw} AS STRING))")
            values.append(f"CAST({raw} AS STRING)" if t.kind == "string" else raw)
        at += t.head
    return " AND ".join(f"({c})" for c in checks), values


def decode_type(t: abi.Type, data: str) -> str:
    ok, (value,) = sequence([t], data)
    return f"CASE WHEN {ok} THEN {value} END"


def decode_params(types: list[abi.Type], names: list[str], selector: bytes, data: str) -> str:
    ok, values = sequence(types, f"substring({data}, 5)")
    fields = ", ".join(f"'{n}', {v}" for n, v in zip(names, values, strict=True))
    return f"CASE WHEN substring({data}, 1, 4) = X'{selector.hex()}' AND {ok} THEN named_struct({fields}) END"


def decode_log(indexed: list[abi.Type], body: list[abi.Type], names: list[str], topics: list[str], data: str) -> str:
    fields = []
    for t, topic in zip(indexed, topics, strict=False):
        word = f"lpad({topic}, 32, X'00')"
        fields.append(f"CASE WHEN octet_length({topic}) <= 32 AND {_check(t, word)} THEN {_value(t, word)} END")
    if body:
        ok, values = sequence(body, data)
        fields += [f"CASE WHEN {ok} THEN {v} END" for v in values]
    return f"named_struct({', '.join(f"'{n}', {v}" for n, v in zip(names, fields, strict=True))})"


# Encoding -----------------------------------------------------------------


def fits(t: abi.Type, value: str) -> str:
    """Whether a value's Spark type is one that is encoded here; a constant when the query is planned."""
    if t.kind in ("int", "uint"):
        return f"typeof({value}) IN {_INTEGERS}"
    return f"typeof({value}) = '{parameter(t).lower()}'"


def parameter(t: abi.Type) -> str:
    """The Spark type of a value that is encoded here."""
    return "BIGINT" if t.kind in ("int", "uint") else {"bool": "BOOLEAN", "string": "STRING"}.get(t.kind, "BINARY")


def _failed(message: str) -> str:
    return f"CAST(raise_error({message}) AS BINARY)"


def word_of(t: abi.Type, value: str) -> str:
    """The 32 bytes of a static value that is not null."""
    if t.kind in ("int", "uint"):
        n = value
        made = f"unhex(lpad(hex({n}), 64, CASE WHEN {n} < 0 THEN 'F' ELSE '0' END))"
        out = []
        if t.kind == "uint":
            out.append(f"{n} < 0")
            if t.size < 64:
                out.append(f"{n} >= {1 << t.size}")
        elif t.size < 64:
            out += [f"{n} < {-(1 << (t.size - 1))}", f"{n} >= {1 << (t.size - 1)}"]
        message = f"concat({n}, ' is out of range of {t}')"
        return f"CASE WHEN {' OR '.join(out)} THEN {_failed(message)} ELSE {made} END" if out else made
    if t.kind == "bool":
        return f"CASE WHEN {value} THEN X'{'00' * 31}01' ELSE X'{'00' * 32}' END"
    size = 20 if t.kind == "address" else t.size
    raw = value
    made = f"concat(X'{'00' * 12}', {raw})" if t.kind == "address" else f"rpad({raw}, 32, X'00')"
    message = f"concat(octet_length({raw}), ' bytes for {t}')"
    return f"CASE WHEN octet_length({raw}) <> {size} THEN {_failed(message)} ELSE {made} END"


def _number(n: str) -> str:
    return f"unhex(lpad(hex(CAST({n} AS BIGINT)), 64, '0'))"


def encode_sequence(types: list[abi.Type], values: list[str]) -> str:
    """The bytes of values of which none is null."""
    place, heads, tails = str(sum(t.head for t in types)), [], []
    for t, v in zip(types, values, strict=True):
        if t.kind in STATIC:
            heads.append(word_of(t, v))
            continue
        raw = f"CAST({v} AS BINARY)"
        size = f"octet_length({raw})"
        padded = f"CAST(ceil({size} / 32.0BD) AS INT) * 32"
        heads.append(_number(place))
        tails.append(f"concat({_number(size)}, rpad({raw}, {padded}, X'00'))")
        place = f"{place} + 32 + {padded}"
    return f"concat({', '.join([*heads, *tails])})"


SHIFT = "blockloom_shift_units"


def _shift_units(most: int = 32) -> list[str]:
    """Statements that make SHIFT(value, units): value * 10**units by moving the point in the text; each function names more of its parts."""
    failed = lambda message: f"CAST(raise_error({message}) AS STRING)"
    whole = "trim(LEADING '0' FROM CASE WHEN place <= 0 THEN '' ELSE rpad(substring(digits, 1, place), place, '0') END)"
    rest = "trim(TRAILING '0' FROM CASE WHEN place <= 0 THEN concat(repeat('0', -place), digits) ELSE substring(digits, place + 1) END)"
    made = "concat(CASE WHEN minus AND concat(whole, rest) <> '' THEN '-' ELSE '' END, CASE WHEN whole = '' THEN '0' ELSE whole END, CASE WHEN rest = '' THEN '' ELSE concat('.', rest) END)"
    good = "translate(body, '0123456789', '') IN ('', '.') AND length(replace(body, '.', '')) > 0 AND e IS NOT NULL"
    steps = [
        ("_4", "v STRING, u INT, minus BOOLEAN, good BOOLEAN, whole STRING, rest STRING", f"CASE WHEN abs(u) > {most} THEN {failed(f"'units must be between -{most} and {most}'")} WHEN NOT good THEN {failed("concat('not a number: ', v)")} ELSE {made} END"),
        ("_3", "v STRING, u INT, minus BOOLEAN, good BOOLEAN, digits STRING, place INT", f"{SHIFT}_4(v, u, minus, good, {whole}, {rest})"),
        ("_2", "v STRING, u INT, minus BOOLEAN, body STRING, e INT", f"{SHIFT}_3(v, u, minus, {good}, replace(body, '.', ''), CASE WHEN instr(body, '.') = 0 THEN length(body) ELSE instr(body, '.') - 1 END + greatest(-1000, least(1000, coalesce(e, 0))) + greatest(-100, least(100, u)))"),
        ("_1", "v STRING, u INT, m STRING", f"{SHIFT}_2(v, u, startswith(m, '-'), CASE WHEN startswith(m, '-') OR startswith(m, '+') THEN substring(m, 2) ELSE m END, CASE WHEN length(m) = length(v) THEN 0 ELSE TRY_CAST(substring(v, length(m) + 2) AS INT) END)"),
        ("_0", "v STRING, u INT", f"{SHIFT}_1(v, u, substring_index(v, 'e', 1))"),
        ("", "v STRING, u INT", f"CASE WHEN v IS NOT NULL THEN {SHIFT}_0(lower(trim(v)), coalesce(u, 1)) END"),
    ]
    return [f"CREATE OR REPLACE TEMPORARY FUNCTION {SHIFT}{n}({params}) RETURNS STRING RETURN {body}" for n, params, body in steps]


def helpers(name: str) -> list[str]:
    """The statements that make what a contract function calls."""
    return _shift_units() if name == "shift_units" else _decimal_text()
