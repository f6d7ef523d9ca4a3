"""User-written filter expressions, compiled to typed Columns.

A small expression language: literals, names, a.b and a["b"], comparisons,
&& || !, + - * / %, the ternary, in, has(), size(), int(), double(), string(), list
literals, the string methods contains, startsWith, endsWith and matches, and the
macros exists, exists_one, all, filter and map over lists and the keys of maps.

Every node has a type. Parsed JSON is dynamic: a VARIANT whose type is looked at
row by row, so that log.latency_ms > 100 compares numbers and log.a.b follows
nested objects. Values of different types aren't equal; ordering them, or adding
an int to a double, is a failure. Every failure (missing key or name, unknown
function, division of ints by zero, overflow, wrong type, unreadable pattern)
becomes null; SQL's three-valued logic then absorbs it as the language does, and a
filter keeps rows whose result is null or not boolean. An expression that can't
be parsed keeps every row. The pattern of matches must be a literal.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.functions.columns import plain_number
from telemill.operators.logs import parse_object

_TOKEN = re.compile(
    r"""\s*(?:(?P<num>0[xX][0-9a-fA-F]+u?|\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+|\d+[eE][+-]?\d+|\d+u?)|(?P<str>[rR]?(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'))|(?P<name>[A-Za-z_]\w*)|(?P<op>&&|\|\||[=!<>]=|[<>!+\-*/%()\[\],.?:]))"""
)
_LEVELS: tuple[tuple[str, ...], ...] = (("||",), ("&&",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "-"), ("*", "/", "%"))


class ParseError(ValueError):
    pass


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected {text[at:at + 10]!r}")
        out.append((m.lastgroup or "", m[m.lastgroup]))
        at = m.end()
    return [*out, ("end", "")]


class _Parser:
    """Text to nested tuples: ("lit", v), ("name", n), ("call", f, args), ("method", x, f, args), ("op", o, args), ..."""

    def __init__(self, text: str) -> None:
        self.toks, self.i = _tokens(text), 0

    def peek(self) -> str:
        return self.toks[self.i][1] if self.toks[self.i][0] != "str" else "\0str"

    def take(self, expected: str | None = None) -> tuple[str, str]:
        tok = self.toks[self.i]
        if expected is not None and (tok[1] != expected or tok[0] == "str"):
            raise ParseError(f"expected {expected!r}, found {tok[1]!r}")
        self.i += 1
        return tok

    def parse(self) -> tuple:
        tree = self.ternary()
        if self.toks[self.i][0] != "end":
            raise ParseError(f"unexpected {self.peek()!r}")
        return tree

    def ternary(self) -> tuple:
        cond = self.binary(0)
        if self.peek() != "?":
            return cond
        self.take("?")
        yes = self.ternary()
        self.take(":")
        return ("if", cond, yes, self.ternary())

    def binary(self, level: int) -> tuple:
        if level == len(_LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.peek() in _LEVELS[level]:
            op = self.take()[1]
            left = ("op", op, [left, self.binary(level + 1)])
        return left

    def unary(self) -> tuple:
        if self.peek() in ("!", "-"):
            op = self.take()[1]
            return ("op", f"u{op}", [self.unary()])
        return self.postfix()

    def args(self, close: str) -> list[tuple]:
        out = []
        while self.peek() != close:
            out.append(self.ternary())
            if self.peek() != ",":
                break
            self.take(",")
        self.take(close)
        return out

    def postfix(self) -> tuple:
        x = self.primary()
        while self.peek() in (".", "["):
            if self.take()[1] == "[":
                x = ("index", x, self.ternary())
                self.take("]")
                continue
            kind, name = self.take()
            if kind != "name":
                raise ParseError("a name must follow .")
            if self.peek() == "(":
                self.take("(")
                x = ("method", x, name, self.args(")"))
            else:
                x = ("index", x, ("lit", name))
        return x

    def primary(self) -> tuple:
        kind, text = self.take()
        if kind == "num":
            if text[:2] in ("0x", "0X"):
                return ("lit", int(text.rstrip("u"), 16))
            return ("lit", float(text) if re.search(r"[.eE]", text) else int(text.rstrip("u")))
        if kind == "str" and text[0] in "rR":
            return ("lit", text[2:-1])
        if kind == "str":
            return ("lit", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), text[1:-1]))
        if text == "(":
            inner = self.ternary()
            self.take(")")
            return inner
        if text == "[":
            return ("list", self.args("]"))
        if kind == "name":
            if text in ("true", "false", "null"):
                return ("lit", {"true": True, "false": False, "null": None}[text])
            if self.peek() == "(":
                self.take("(")
                return ("call", text, self.args(")"))
            return ("name", text)
        raise ParseError(f"unexpected {text!r}")


Kind = str | tuple  # int, num (double), str, bool, null, dyn, ? or ("map", kind) and ("list", kind)


@dataclass(frozen=True)
class Typed:
    """A column and its kind."""

    column: Column
    kind: Kind

    @property
    def numeric(self) -> bool:
        return self.kind in ("int", "num")


class _Failed(Typed):
    """A value that no row has; its column is made where it is used, when there is a session."""

    def __init__(self) -> None:
        object.__setattr__(self, "kind", "?")

    @property
    def column(self) -> Column:
        return F.lit(None).cast("boolean")


_FAILED = _Failed()
_ORDER: dict[str, Callable[[Column, Column], Column]] = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
_MACROS = ("exists", "exists_one", "all", "filter", "map")


def _get(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _is(v: Column, *kinds: str) -> Column:
    found = F.schema_of_variant(v)
    test = F.lit(False)
    for k in kinds:
        test = test | found.startswith(k)
    return test


def _part(x: Typed, kind: str) -> Column:
    """x as num, str or bool; null where a dynamic value has another type."""
    if x.kind == kind or (kind == "num" and x.numeric):
        return x.column.cast("double") if kind == "num" else x.column
    if x.kind != "dyn":
        return F.lit(None).cast({"num": "double", "str": "string", "bool": "boolean"}[kind])
    types = {"num": (("BIGINT", "DOUBLE", "FLOAT", "DECIMAL", "INT", "SMALLINT", "TINYINT"), "double"), "str": (("STRING",), "string"), "bool": (("BOOLEAN",), "boolean")}[kind]
    return F.when(_is(x.column, *types[0]), _get(x.column, types[1]))


def _is_null(x: Typed) -> Column:
    if x.kind == "null":
        return F.lit(True)
    return F.is_variant_null(x.column) if x.kind == "dyn" else F.lit(False)


def _dynamic(x: Typed) -> Column:
    """x as VARIANT."""
    if x.kind == "dyn":
        return x.column
    if x.kind == "null":
        return F.parse_json(F.lit("null"))
    if isinstance(x.kind, tuple):
        return x.column.cast("variant") if x.kind[0] == "list" else F.to_variant_object(x.column)
    return x.column.cast("variant")


def _failing(x: Typed) -> Column:
    """Whether x failed: a null literal and a JSON null are values."""
    return F.lit(False) if x.kind == "null" else x.column.isNull()


def _equal(a: Typed, b: Typed) -> Column:
    """Equality of any two values: false for different types, null if one failed."""
    if "?" in (a.kind, b.kind):
        return _FAILED.column
    if a.kind == b.kind and a.kind in ("str", "bool"):
        return a.column == b.column
    if a.numeric and b.numeric:
        return _numbers("==", a.column, b.column)
    failed = _failing(a) | _failing(b)
    if "dyn" in (a.kind, b.kind):
        same = [F.coalesce(_part(a, k) == _part(b, k), F.lit(False)) for k in ("str", "bool")]
        same += [F.coalesce(_numbers("==", _part(a, "num"), _part(b, "num")), F.lit(False)), _is_null(a) & _is_null(b)]
        if not {a.kind, b.kind} & {"str", "bool", "int", "num", "null"}:
            text = [F.when(_is(_dynamic(x), "OBJECT", "ARRAY"), F.to_json(_dynamic(x))) for x in (a, b)]
            same.append(F.coalesce(text[0] == text[1], F.lit(False)))
        out = same[0]
        for x in same[1:]:
            out = out | x
        return F.when(~failed, out)
    if isinstance(a.kind, tuple) and isinstance(b.kind, tuple) and a.kind[0] == b.kind[0]:
        return F.when(~failed, F.to_json(_dynamic(a)) == F.to_json(_dynamic(b)))
    return F.when(~failed, _is_null(a) & _is_null(b))


def _numbers(op: str, a: Column, b: Column) -> Column:
    """Comparison of numbers; NaN equals nothing and is in no order."""
    odd = F.isnan(a.cast("double")) | F.isnan(b.cast("double"))
    return F.when(odd, F.lit(False)).otherwise(a == b if op == "==" else _ORDER[op](a, b))


def _ordered(op: str, a: Typed, b: Typed) -> Column:
    if a.numeric and b.numeric:
        return _numbers(op, a.column, b.column)
    tries = []
    for kind in ("num", "str", "bool"):
        if all(x.kind in ("dyn", kind) or (kind == "num" and x.numeric) for x in (a, b)):
            x, y = _part(a, kind), _part(b, kind)
            tries.append(_numbers(op, x, y) if kind == "num" else _ORDER[op](x, y))
    return F.coalesce(*tries) if tries else _FAILED.column


def _arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    """Numbers of one type, and + of texts and lists; a JSON number is a double."""
    kinds = {a.kind, b.kind}
    if kinds == {"int"}:
        made = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "%": F.try_mod}
        if op in made:
            return Typed(made[op](a.column.cast("long"), b.column.cast("long")), "int")
        x, y = a.column.cast("decimal(38,0)"), b.column.cast("decimal(38,0)")  # towards zero, exactly
        return Typed(F.when(b.column != 0, (x - F.try_mod(x, F.when(y != 0, y))) / F.when(y != 0, y)).try_cast("long"), "int")
    if kinds <= {"num", "dyn"} and op != "%":
        x, y = _part(a, "num"), _part(b, "num")
        if op == "/":
            endless = F.when(F.isnan(x), float("nan")).when(x > 0, float("inf")).when(x < 0, float("-inf")).otherwise(float("nan"))
            number = F.when(y == 0, F.when(x.isNotNull(), endless)).otherwise(F.try_divide(x, F.when(y != 0, y)))
        else:
            number = {"+": x + y, "-": x - y, "*": x * y}[op]
        if "num" in kinds or op != "+":
            return Typed(number, "num")
        return Typed(F.coalesce(number.cast("variant"), F.concat(_part(a, "str"), _part(b, "str")).cast("variant")), "dyn")
    if op == "+" and kinds <= {"str", "dyn"}:
        return Typed(F.concat(_part(a, "str"), _part(b, "str")), "str")
    if op == "+" and a.kind == b.kind and isinstance(a.kind, tuple) and a.kind[0] == "list":
        return Typed(F.concat(a.column, b.column), a.kind)
    return _FAILED


def _elements(x: Typed) -> Typed | None:
    """The elements of a list or the keys of a map, as a list."""
    if isinstance(x.kind, tuple):
        return x if x.kind[0] == "list" else Typed(F.map_keys(x.column), ("list", "str"))
    if x.kind != "dyn":
        return None
    keys = F.transform(F.map_keys(_get(x.column, "map<string,variant>")), lambda k: k.cast("variant"))
    return Typed(F.when(_is(x.column, "ARRAY"), _get(x.column, "array<variant>")).when(_is(x.column, "OBJECT"), keys), ("list", "dyn"))


class _Compiler:
    """Trees to typed columns over an environment of names."""

    def __init__(self, names: dict[str, Typed], good_pattern: Callable[[str], bool]) -> None:
        self.names, self.good_pattern = names, good_pattern

    def typed(self, t: tuple) -> Typed:
        what = t[0]
        if what == "lit":
            return Typed(F.lit(t[1]), {bool: "bool", int: "int", float: "num", str: "str"}.get(type(t[1]), "null"))
        if what == "name":
            return self.names.get(t[1], _FAILED)
        if what == "list":
            return self.listed([self.typed(x) for x in t[1]])
        if what == "index":
            return self.index(self.typed(t[1]), t[2])
        if what == "if":
            return self.choice(*[self.typed(x) for x in t[1:]])
        if what == "op":
            return self.operator(t[1], t[2])
        if what == "method":
            return self.method(t[1], t[2], t[3])
        return self.call(t[1], t[2])

    def boolean(self, t: tuple) -> Column:
        return _part(self.typed(t), "bool")

    def listed(self, items: list[Typed]) -> Typed:
        kinds = {x.kind for x in items}
        if "?" in kinds:
            return _FAILED
        if len(kinds) == 1 and (kind := next(iter(kinds))) != "null":
            return Typed(F.array(*[x.column for x in items]), ("list", kind))
        return Typed(F.array(*[_dynamic(x) for x in items]) if items else F.array().cast("array<variant>"), ("list", "dyn"))

    def index(self, box: Typed, key: tuple) -> Typed:
        at = self.typed(key)
        if isinstance(box.kind, tuple) and box.kind[0] == "map":
            return Typed(F.try_element_at(box.column, at.column), box.kind[1]) if at.kind == "str" else _FAILED
        if isinstance(box.kind, tuple):
            return Typed(F.get(box.column, F.when(at.column >= 0, at.column).cast("int")), box.kind[1]) if at.kind == "int" else _FAILED
        if box.kind != "dyn":
            return _FAILED
        if key[0] == "lit" and at.kind == "str" and not set(key[1]) & set("'\"\\"):
            return Typed(F.try_variant_get(box.column, f'$["{key[1]}"]', "variant"), "dyn")
        if at.kind == "int":
            return Typed(F.get(_get(box.column, "array<variant>"), F.when(at.column >= 0, at.column).cast("int")), "dyn")
        return Typed(F.try_element_at(_get(box.column, "map<string,variant>"), _part(at, "str")), "dyn")

    def choice(self, cond: Typed, yes: Typed, no: Typed) -> Typed:
        c = _part(cond, "bool")
        if yes.kind == no.kind and yes.kind != "null":
            kind, y, n = yes.kind, yes.column, no.column
        elif "?" in (yes.kind, no.kind):
            kind = no.kind if yes.kind == "?" else yes.kind
            if kind in ("null", "?"):
                return _FAILED
            y, n = (F.lit(None) if x.kind == "?" else x.column for x in (yes, no))
        else:
            kind, y, n = "dyn", _dynamic(yes), _dynamic(no)
        return Typed(F.when(c, y).when(~c, n), kind)

    def operator(self, op: str, args: list[tuple]) -> Typed:
        if op == "u!":
            return Typed(~self.boolean(args[0]), "bool")
        if op in ("&&", "||"):
            a, b = self.boolean(args[0]), self.boolean(args[1])
            return Typed(a & b if op == "&&" else a | b, "bool")
        a = self.typed(args[0])
        if op == "u-":
            return _arithmetic("-", Typed(F.lit(0), "int") if a.kind == "int" else Typed(F.lit(0.0), "num"), a)
        b = self.typed(args[1])
        if op == "in":
            return Typed(self.contained(a, args[1], b), "bool")
        if op in ("==", "!="):
            same = _equal(a, b)
            return Typed(same if op == "==" else ~same, "bool")
        if op in _ORDER:
            return Typed(_ordered(op, a, b), "bool")
        return _arithmetic(op, a, b)

    def contained(self, x: Typed, tree: tuple, box: Typed) -> Column:
        if tree[0] == "list":  # element by element: a list may mix types
            out = F.lit(False)
            for e in tree[1]:
                out = out | _equal(x, self.typed(e))
            return F.when(~_failing(x), out) if x.kind != "?" else _FAILED.column
        if isinstance(box.kind, tuple) and box.kind[0] == "map":
            return F.map_contains_key(box.column, x.column) if x.kind == "str" else F.map_contains_key(box.column, _part(x, "str"))
        among = _elements(box)
        if among is None or x.kind == "?":
            return _FAILED.column
        return F.exists(among.column, lambda e: _equal(x, Typed(e, among.kind[1])))

    def macro(self, x: Typed, name: str, args: list[tuple]) -> Typed:
        box = _elements(x)
        if box is None or args[0][0] != "name":
            return _FAILED
        kind = box.kind[1]

        def over(tree: tuple, e: Column) -> Typed:
            return _Compiler(self.names | {args[0][1]: Typed(e, kind)}, self.good_pattern).typed(tree)

        test = lambda e: _part(over(args[1], e), "bool")
        if name == "exists":
            return Typed(F.exists(box.column, test), "bool")
        if name == "all":
            return Typed(F.forall(box.column, test), "bool")
        decided = F.forall(box.column, lambda e: test(e).isNotNull()) if name != "map" or len(args) == 3 else F.lit(True)
        if name == "exists_one":
            return Typed(F.when(decided, F.size(F.filter(box.column, test)) == 1), "bool")
        kept = F.when(decided, F.filter(box.column, test)) if name == "filter" or len(args) == 3 else box.column
        if name == "filter":
            return Typed(kept, box.kind)
        kinds: list[Kind] = []

        def made(e: Column) -> Column:
            got = over(args[-1], e)
            kinds.append(got.kind)
            return got.column

        out = F.transform(kept, made)
        if kinds[-1] in ("?", "null"):
            return _FAILED
        return Typed(F.when(F.forall(out, lambda y: y.isNotNull()), out), ("list", kinds[-1]))

    def method(self, tree: tuple, name: str, args: list[tuple]) -> Typed:
        x = self.typed(tree)
        if name in _MACROS and len(args) in ((2, 3) if name == "map" else (2,)):
            return self.macro(x, name, args)
        if name == "size" and not args:
            return self.size(x)
        if name not in ("contains", "startsWith", "endsWith", "matches") or len(args) != 1:
            return _FAILED
        a, text = self.typed(args[0]), _part(x, "str")
        if name == "matches":
            good = args[0][0] == "lit" and a.kind == "str" and self.good_pattern(args[0][1])
            return Typed(F.regexp_like(text, a.column), "bool") if good else _FAILED
        other = _part(a, "str")
        return Typed({"contains": text.contains, "startsWith": text.startswith, "endsWith": text.endswith}[name](other), "bool")

    def size(self, x: Typed) -> Typed:
        if x.kind == "str":
            return Typed(F.length(x.column).cast("long"), "int")
        if isinstance(x.kind, tuple):
            return Typed(F.when(x.column.isNotNull(), F.size(x.column)).cast("long"), "int")
        box = _elements(x)
        return _FAILED if box is None else Typed(F.coalesce(F.length(_part(x, "str")), F.when(box.column.isNotNull(), F.size(box.column))).cast("long"), "int")

    def call(self, name: str, args: list[tuple]) -> Typed:
        if name == "has" and len(args) == 1 and args[0][0] == "index":
            box = self.typed(args[0][1])
            if box.kind == "dyn":
                return Typed(F.when(_is(box.column, "OBJECT"), self.index(box, args[0][2]).column.isNotNull()), "bool")
            return Typed(F.map_contains_key(box.column, self.typed(args[0][2]).column), "bool") if isinstance(box.kind, tuple) and box.kind[0] == "map" else _FAILED
        if len(args) == 2 and name in ("contains", "startsWith", "endsWith", "matches"):
            return self.method(args[0], name, args[1:])
        if len(args) != 1:
            return _FAILED
        x = self.typed(args[0])
        if name == "size":
            return self.size(x)
        if name not in ("int", "double", "string", "bool", "dyn") or x.kind in ("?", "null") or isinstance(x.kind, tuple):
            return _FAILED
        if name == "dyn":
            return x
        texts, flags = _part(x, "str"), _part(x, "bool")
        if name == "int":
            number = x.column.cast("long") if x.kind == "int" else F.when(~F.isnan(_part(x, "num")), _part(x, "num")).try_cast("long")
            return Typed(F.coalesce(number, F.when(texts.rlike(r"^[+-]?[0-9]+$"), texts).try_cast("long")), "int")
        if name == "double":
            return Typed(F.coalesce(_part(x, "num"), texts.try_cast("double")), "num")
        if name == "bool":
            return Typed(F.coalesce(flags, texts.try_cast("boolean")), "bool")
        whole = x.column.cast("string") if x.kind == "int" else plain_number(_part(x, "num"))
        return Typed(F.coalesce(texts, flags.cast("string"), whole), "str")


def _kind_of(t: T.DataType) -> Kind:
    if isinstance(t, T.StringType):
        return "str"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.MapType):
        return ("map", _kind_of(t.valueType)) if isinstance(t.keyType, T.StringType) else "?"
    if isinstance(t, T.ArrayType):
        return ("list", _kind_of(t.elementType))
    if isinstance(t, T.VariantType):
        return "dyn"
    if isinstance(t, T.IntegralType):
        return "int"
    return "num" if isinstance(t, T.NumericType) else "?"


def names_of(rows: DataFrame) -> dict[str, Typed]:
    """Every column of rows under its name."""
    return {f.name: Typed(F.col(f"`{f.name}`"), _kind_of(f.dataType)) for f in rows.schema.fields}


def predicate(expression: str, rows: DataFrame, names: dict[str, Typed] | None = None) -> Column:
    """The expression over names (by default the columns of rows) as a Column that keeps what fails."""

    def good_pattern(p: str) -> bool:
        try:
            rows.sparkSession._jvm.java.util.regex.Pattern.compile(p)
            return True
        except Exception:  # noqa: BLE001 - whatever the engine of patterns says
            return False

    try:
        found = _Compiler(names_of(rows) if names is None else names, good_pattern).typed(_Parser(expression).parse())
        keep = F.coalesce(_part(found, "bool"), F.lit(True))
        rows.select(keep).schema  # the analyzer looks at it now, not when the pipeline runs
        return keep
    except (ParseError, AnalysisException, RecursionError):
        return F.lit(True)


def apply_filter(rows: DataFrame, expression: str, drop_non_matching: bool = True, names: dict[str, Typed] | None = None) -> DataFrame:
    """Rows for which the expression isn't false."""
    if not drop_non_matching or not expression.strip():
        return rows
    return rows.where(predicate(expression, rows, names))


def envelope_names(on: str) -> dict[str, Typed]:
    """What a pre filter sees of an envelope: times always, the rest by `on`."""
    empty = Typed(F.create_map().cast("map<string,string>"), ("map", "str"))
    names = {"now_unix": Typed(F.unix_timestamp(), "int"), "ts_unix": Typed(F.col("ts_unix"), "int")}
    kind, attrs = Typed(F.col("kind"), "str"), Typed(F.coalesce("attrs", empty.column), ("map", "str"))
    if on == "metrics":
        return names | {"kind": kind, "attrs": attrs, "metric_name": Typed(F.lit(""), "str"), "labels": empty, "resource": empty}
    if on == "logs":
        nothing = F.parse_json(F.lit("{}"))
        return names | {"log": Typed(F.coalesce(parse_object(F.col("bytes").cast("string")), nothing), "dyn")}
    if on == "traces":
        return names | {"kind": kind, "attributes": empty, "resource": empty, "span_name": Typed(F.lit(""), "str"), "duration_ms": Typed(F.lit(0.0), "num")}
    item = F.to_variant_object(F.struct("kind", "ts_unix", attrs.column.alias("attrs")))
    return names | {"item": Typed(item, "dyn")}


def filter_envelopes(envelopes: DataFrame, expression: str, on: str = "metrics", drop_non_matching: bool = True) -> DataFrame:
    """A pre filter over what `on` offers (metrics: kind, attrs, ...; logs: log; traces; anything else: item)."""
    return apply_filter(envelopes, expression, drop_non_matching, envelope_names(on))


def filter_aggregates(aggregates: DataFrame, expression: str, drop_non_matching: bool = True) -> DataFrame:
    """A post filter over the columns of aggregate rows, with now_unix; count is a double."""
    names = names_of(aggregates) | {"now_unix": Typed(F.unix_timestamp(), "int")}
    if "count" in names:
        names["count"] = Typed(F.col("count").cast("double"), "num")
    return apply_filter(aggregates, expression, drop_non_matching, names)
