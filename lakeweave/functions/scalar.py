"""The scalar function library as Spark SQL expressions.

Each function takes (expression, class) pairs and returns one; the classes are
int, real, text, blob, date, bool, null and any. No function runs Python on
the executors, so all of them stay inside Spark's optimizer and code
generation. ``column`` gives the same functions to DataFrame code.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

Typed = tuple[str, str]


def quote(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number(x: Typed) -> str:
    """A predicate as 1, 0 or NULL; anything else as it is."""
    return f"CAST({x[0]} AS BIGINT)" if x[1] == "bool" else x[0]


def text(x: Typed) -> str:
    """The value as text: whole reals without a fraction, times as yyyy-MM-dd HH:mm:ss."""
    sql, kind = x
    if kind == "text":
        return sql
    if kind == "blob":
        return f"decode({sql}, 'UTF-8')"
    if kind == "bool":
        return f"CAST(CAST({sql} AS BIGINT) AS STRING)"
    if kind == "real":
        return f"regexp_replace(CAST({sql} AS STRING), '[.]0$', '')"
    if kind == "date":
        return f"date_format({sql}, 'yyyy-MM-dd HH:mm:ss')"
    return f"CAST({sql} AS STRING)"


def truth(x: Typed) -> str:
    """The value as a condition: numbers by being non-zero, text by not being null."""
    sql, kind = x
    if kind in ("bool", "any"):
        return sql
    if kind == "null":
        return "CAST(NULL AS BOOLEAN)"
    if kind in ("int", "real"):
        return f"({sql} <> 0)"
    return f"(CASE WHEN {sql} IS NULL THEN NULL ELSE TRUE END)"


def common(*xs: Typed) -> str:
    """The class that values of several classes share."""
    kinds = {k for _, k in xs if k != "null"}
    if not kinds:
        return "null"
    if len(kinds) == 1:
        return kinds.pop()
    if kinds <= {"int", "bool"}:
        return "int"
    if kinds <= {"int", "real", "bool"}:
        return "real"
    return "any"


def alike(*xs: Typed) -> tuple[list[str], str]:
    """The values brought to one class where predicates and numbers meet."""
    kind = common(*xs)
    return [number(x) if kind in ("int", "real") else x[0] for x in xs], kind


def unify(*xs: Typed) -> tuple[list[str], str]:
    """The values of one result: as ``alike``, and text where text and other classes mix."""
    values, kind = alike(*xs)
    if kind == "any" and any(k == "text" for _, k in xs) and all(k != "any" for _, k in xs):
        return [x[0] if x[1] == "null" else text(x) for x in xs], "text"
    return values, kind


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a GLOB pattern of * and ?."""
    return "(?s)^" + "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in pattern) + "$"


def like(x: Typed, pattern: Typed, literal: str | None = None, escape: str | None = None) -> str:
    """Case-insensitive LIKE; a backslash is an ordinary character unless it is the escape."""
    if escape is not None:
        return f"({text(x)} ILIKE {pattern[0]} ESCAPE {escape})"
    if literal is not None:
        return f"({text(x)} ILIKE {quote(literal.replace(chr(92), chr(92) * 2))})"
    return f"({text(x)} ILIKE replace({text(pattern)}, '\\\\', '\\\\\\\\'))"


def glob(x: Typed, pattern: Typed, literal: str | None = None) -> str:
    if literal is not None:
        return f"({text(x)} RLIKE {quote(glob_regex(literal))})"
    escaped = f"regexp_replace({text(pattern)}, '[^A-Za-z0-9*?\\\\s]', '\\\\\\\\$0')"
    return f"({text(x)} RLIKE concat('(?s)^', replace(replace({escaped}, '*', '.*'), '?', '.'), '$'))"


def real_div(a: str, b: str) -> str:
    """Division of reals by IEEE rules: infinities and NaN instead of an error."""
    return (
        f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {b} <> 0 THEN {a} / {b} "
        f"WHEN {a} = 0 OR isnan(CAST({a} AS DOUBLE)) THEN DOUBLE('NaN') ELSE signum({a}) * DOUBLE('Infinity') END)"
    )


def _abs(x):
    return f"abs({number(x)})", x[1]


def _coalesce(*xs):
    values, kind = unify(*xs)
    return f"coalesce({', '.join(values)})", kind


def _nullif(a, b):
    (x, y), _ = alike(a, b)
    return f"nullif({x}, {y})", "int" if a[1] == "bool" else a[1]


def _iif(c, a, b=("NULL", "null")):
    (x, y), kind = unify(a, b)
    return f"if({truth(c)}, {x}, {y})", kind


def _typeof(x):
    name = {"int": "integer", "bool": "integer", "real": "real", "text": "text", "blob": "blob", "date": "integer", "null": "null"}.get(x[1])
    kind = quote(name) if name else f"CASE typeof({x[0]}) WHEN 'bigint' THEN 'integer' WHEN 'int' THEN 'integer' WHEN 'double' THEN 'real' WHEN 'string' THEN 'text' WHEN 'binary' THEN 'blob' ELSE 'null' END"
    return f"CASE WHEN {x[0]} IS NULL THEN 'null' ELSE {kind} END", "text"


def _length(x):
    return f"CAST(length({x[0] if x[1] == 'blob' else text(x)}) AS BIGINT)", "int"


def _cased(name):
    return lambda x: (f"{name}({text(x)})", "text")


def _trim(side, pattern):
    """White space of any kind, or the given characters, off one or both ends."""

    def build(x, chars=None):
        if chars:
            return f"trim({side} {text(chars)} FROM {text(x)})", "text"
        return f"regexp_replace({text(x)}, {quote(pattern)}, '')", "text"

    return build


def _substr(x, start, length=None):
    s = x[0] if x[1] == "blob" else text(x)
    # A start before the text is the text's start, and the length keeps counting from there.
    at = f"CAST(greatest({start[0]}, -length({s})) AS INT)"
    kind = "blob" if x[1] == "blob" else "text"
    if length is None:
        return f"substring({s}, {at})", kind
    return f"substring({s}, {at}, CAST(greatest({length[0]}, 0) AS INT))", kind


def _replace(x, a, b):
    return f"replace({text(x)}, {text(a)}, {text(b)})", "text"


def _instr(x, y):
    return f"CAST(instr({text(x)}, {text(y)}) AS BIGINT)", "int"


def _hex(x):
    return f"hex({x[0] if x[1] == 'blob' else text(x)})", "text"


def _unicode(x):
    """The first code point, which may be 0; NULL for an empty text."""
    return f"CASE WHEN octet_length({text(x)}) > 0 THEN CAST(ascii({text(x)}) AS BIGINT) END", "int"


def _char(*xs):
    one = lambda x: f"coalesce(decode(unhex(lpad(hex(CAST({number(x)} AS BIGINT)), 8, '0')), 'UTF-32'), '')"
    return f"concat({', '.join(map(one, xs))})", "text"


def _quote(x):
    if x[1] == "blob":
        body = f"concat('X\\'', hex({x[0]}), '\\'')"
    elif x[1] in ("text", "date", "any"):
        body = f"concat('\\'', replace({text(x)}, '\\'', '\\'\\''), '\\'')"
    else:
        body = text(x)
    return f"coalesce({body}, 'NULL')", "text"


def _printf(form, *xs):
    """%d %i %f %s and %%; the form has to be a literal."""
    literal = re.fullmatch(r"'((?:[^'\\]|\\.)*)'", form[0])
    if not literal:
        return f"format_string({', '.join([form[0], *[x[0] for x in xs]])})", "text"
    body, rest, parts = re.sub(r"\\(.)", r"\1", literal[1]), list(xs), []
    for piece in re.split(r"(%[dif s%])", body):
        if piece in ("%d", "%i", "%f", "%s"):
            if not rest:
                parts.append("'?'")
                continue
            x = rest.pop(0)
            if piece == "%s":
                parts.append(f"coalesce({text(x)}, 'NULL')")
            elif piece == "%f":
                parts.append(f"format_string('%.6f', CAST(coalesce({number(x)}, 0) AS DOUBLE))")
            else:
                parts.append(f"CAST(CAST(coalesce({number(x)}, 0) AS BIGINT) AS STRING)")
        elif piece:
            parts.append(quote("%" if piece == "%%" else piece))
    return f"concat({', '.join(parts or [quote('')])})", "text"


def _extreme(name):
    def build(*xs):
        values, kind = unify(*xs)
        return f"{name}({', '.join(values)})", kind

    return build


def _moment(x: Typed) -> str:
    return x[0] if x[1] == "date" else f"CAST({x[0]} AS TIMESTAMP_NTZ)"


def _format(pattern):
    return lambda x: (f"date_format({_moment(x)}, '{pattern}')", "text")


def _part(name):
    return lambda x: (f"CAST({name}({_moment(x)}) AS BIGINT)", "int")


def _random():
    # 64 random bits from two draws of 32
    return "(shiftleft(CAST(floor(rand() * 4294967296) AS BIGINT), 32) | CAST(floor(rand() * 4294967296) AS BIGINT))", "int"


def ticks(moment: str) -> str:
    """100 ns steps since 0001-01-01 of a time."""
    return f"(unix_micros(CAST({moment} AS TIMESTAMP)) * 10 + 621355968000000000)"


#: name -> (least arguments, most arguments or None, builder)
FUNCTIONS = {
    "abs": (1, 1, _abs),
    "random": (0, 0, _random),
    "coalesce": (2, None, _coalesce),
    "ifnull": (2, 2, _coalesce),
    "nullif": (2, 2, _nullif),
    "iif": (2, 3, _iif),
    "typeof": (1, 1, _typeof),
    "zeroblob": (1, 1, lambda n: (f"unhex(repeat('00', CAST({n[0]} AS INT)))", "blob")),
    "length": (1, 1, _length),
    "lower": (1, 1, _cased("lower")),
    "upper": (1, 1, _cased("upper")),
    "trim": (1, 2, _trim("BOTH", r"^[\s\p{Z}]+|[\s\p{Z}]+$")),
    "ltrim": (1, 2, _trim("LEADING", r"^[\s\p{Z}]+")),
    "rtrim": (1, 2, _trim("TRAILING", r"[\s\p{Z}]+$")),
    "substr": (2, 3, _substr),
    "substring": (2, 3, _substr),
    "replace": (3, 3, _replace),
    "instr": (2, 2, _instr),
    "hex": (1, 1, _hex),
    "unicode": (1, 1, _unicode),
    "char": (1, None, _char),
    "quote": (1, 1, _quote),
    "printf": (1, None, _printf),
    "format": (1, None, _printf),
    "min": (2, None, _extreme("least")),
    "max": (2, None, _extreme("greatest")),
    "like": (2, 2, lambda p, x: (like(x, p), "bool")),
    "glob": (2, 2, lambda p, x: (glob(x, p), "bool")),
    "date": (1, 1, _format("yyyy-MM-dd")),
    "time": (1, 1, _format("HH:mm:ss")),
    "datetime": (1, 1, _format("yyyy-MM-dd HH:mm:ss")),
    "year": (1, 1, _part("year")),
    "month": (1, 1, _part("month")),
    "day": (1, 1, _part("day")),
    "hour": (1, 1, _part("hour")),
    "minute": (1, 1, _part("minute")),
    "second": (1, 1, _part("second")),
    "json_extract": (2, 2, lambda x, p: (f"get_json_object({text(x)}, {text(p)})", "text")),
}


def call(name: str, args: list[Typed]) -> Typed:
    """The function's expression and class; ValueError for an unknown name or a wrong number of arguments."""
    if name not in FUNCTIONS:
        raise ValueError(f"no such function: {name}")
    least, most, build = FUNCTIONS[name]
    if len(args) < least or most is not None and len(args) > most:
        raise ValueError(f"wrong number of arguments to function {name}()")
    return build(*args)


def column(name: str, *args: tuple[str, str]) -> Column:
    """The function as a Column, for DataFrame code: args are (SQL expression, class)."""
    return F.expr(number(call(name, list(args))))
