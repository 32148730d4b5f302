"""Validation schemas that compile to a value Column and an issues Column.

``schema.compile(column)`` gives (value, issues): issues is ARRAY<STRUCT<path, message, expected, actual>>, and the value is
null where there are any. A failed check ends its chain. Schemas work on typed columns and on VARIANT ones; on a typed
column a null is a missing value, on a VARIANT null and missing differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..plans.skew import col

ISSUE = "array<struct<path:string,message:string,expected:string,actual:string>>"
#: White space at the ends that trimming removes.
WHITE = " \t\x0b\r\n\x0c"


def no_issues() -> Column:
    return F.array().cast(ISSUE)


def issue(path: Column, message: str, expected: str, actual: Column) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(message).alias("message"), F.lit(expected).alias("expected"), F.coalesce(actual.cast("string"), F.lit("missing")).alias("actual")))


def root() -> Column:
    return F.lit("$")


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, which is worked out once however often ``f`` uses it."""
    return F.transform(F.array(x), f)[0]


def _some(issues: Column) -> Column:
    return _let(issues, lambda i: F.when(F.size(i) > 0, i))


class Schema:
    """``run(column, path, variant)`` gives the value and the issues, null for none; ``described`` is its name in messages."""

    def __init__(self, run: Callable[[Column, Column, bool], tuple[Column, Column]], described: str = "", takes_missing: bool = False):
        self.run, self.described, self.takes_missing = run, described, takes_missing

    def compile(self, c: Column | str, path: Column | None = None, variant: bool = False) -> tuple[Column, Column]:
        value, issues = self.run(col(c) if isinstance(c, str) else c, root() if path is None else path, variant)
        return F.when(issues.isNull(), value), F.coalesce(issues, no_issues())

    # -- stages ------------------------------------------------------------------------------------------------------
    def _then(self, bad: Callable[[Column], Column], message: str, expected: str) -> Schema:
        def run(c, path, variant):
            value, issues = self.run(c, path, variant)
            found = F.when(value.isNotNull() & F.coalesce(bad(value), F.lit(True)), issue(path, message, expected, value))
            return value, F.coalesce(issues, found)

        return Schema(run, self.described, self.takes_missing)

    def min_len(self, n: int) -> Schema:
        """At least ``n`` bytes."""
        return self._then(lambda v: F.octet_length(v) < n, "too short", f"at least {n} bytes")

    def max_len(self, n: int) -> Schema:
        return self._then(lambda v: F.octet_length(v) > n, "too long", f"at most {n} bytes")

    def matches(self, pattern: str) -> Schema:
        """The pattern must match at the start."""
        return self._then(lambda v: ~v.rlike(f"^(?:{pattern})"), "no match", pattern)

    def gte(self, n: float) -> Schema:
        return self._then(lambda v: v < n, "too small", f">= {n}")

    def lte(self, n: float) -> Schema:
        return self._then(lambda v: v > n, "too large", f"<= {n}")

    def refine(self, holds: Callable[[Column], Column], message: str = "refused") -> Schema:
        return self._then(lambda v: ~holds(v), message, "a value that holds")

    def map(self, f: Callable[[Column], Column]) -> Schema:
        def run(c, path, variant):
            value, issues = self.run(c, path, variant)
            return f(value), issues

        return Schema(run, self.described, self.takes_missing)

    def trim(self) -> Schema:
        return self.map(lambda v: F.btrim(v, F.lit(WHITE)))

    def describe(self, name: str) -> Schema:
        return Schema(self.run, name, self.takes_missing)

    # -- missing and null --------------------------------------------------------------------------------------------
    def _absent(self, absent: Callable[[Column, bool], Column], instead: Callable[[], Column] | None) -> Schema:
        def run(c, path, variant):
            value, issues = self.run(c, path, variant)
            a = absent(c, variant)
            return (F.when(~a, value) if instead is None else F.when(a, instead()).otherwise(value)), F.when(~a, issues)

        return Schema(run, self.described, True)

    def optional(self) -> Schema:
        """Missing and null give no value and no issue."""
        return self._absent(_nothing, None)

    def nullable(self) -> Schema:
        """A null gives no value and no issue; a missing one goes to the schema. On a typed column null is the null."""
        return self._absent(lambda c, variant: F.coalesce(F.is_variant_null(c), F.lit(False)) if variant else c.isNull(), None)

    def default(self, v: object) -> Schema:
        return self._absent(_nothing, lambda: F.lit(v))

    # -- results -----------------------------------------------------------------------------------------------------
    def parse(self, df: DataFrame, c: Column | str, value: str = "value", issues: str = "issues", variant: bool = False) -> DataFrame:
        """``df`` with the value, the issues and ``ok``."""
        v, i = self.compile(c, variant=variant)
        ok = (F.size(i) == 0) & (F.lit(True) if self.takes_missing else v.isNotNull())
        return df.withColumns({value: v, issues: i, "ok": ok})

    def parse_or_raise(self, df: DataFrame, c: Column | str, value: str = "value", variant: bool = False) -> DataFrame:
        """``df`` with the value; a row with issues raises, with all their messages."""
        v, i = self.compile(c, variant=variant)
        text = F.array_join(F.transform(i, lambda x: F.concat(x["path"], F.lit(": "), x["message"])), "; ")
        return df.withColumn(value, F.when(F.size(i) > 0, F.raise_error(text)).otherwise(v))


def _nothing(c: Column, variant: bool) -> Column:
    return c.isNull() | F.coalesce(F.is_variant_null(c), F.lit(False)) if variant else c.isNull()


def _scalar(name: str, read: Callable[[Column], Column]) -> Schema:
    def run(c, path, variant):
        v = read(c) if variant else c
        return v, F.when(v.isNull(), issue(path, "wrong kind", name, V.kind(c) if variant else F.lit(None)))

    return Schema(run, name)


def any_value() -> Schema:
    """Anything; missing is null."""
    return Schema(lambda c, path, variant: (c, F.lit(None).cast(ISSUE)), "any", True)


def string() -> Schema:
    return _scalar("string", V.to_string)


def boolean() -> Schema:
    return _scalar("bool", V.to_bool)


def integer() -> Schema:
    return _scalar("int", V.to_int)


def number() -> Schema:
    """A float; an int is taken as one."""
    return _scalar("float", V.to_number).map(lambda v: v.cast("double"))


def literal(v: object) -> Schema:
    base = {bool: boolean, int: integer, str: string}[type(v)]()
    return base._then(lambda x: x != F.lit(v), "another value", str(v))


def enum(*choices: str) -> Schema:
    return string()._then(lambda x: ~x.isin(*choices), "none of the choices", ", ".join(choices))


def _path(path: Column, step: Column) -> Column:
    return F.concat(path, F.lit("."), step.cast("string"))


def _whole(c: Column, path: Column, variant: bool, want: str, found: Column) -> Column:
    """The issue of a value that is no ``want`` at all, else those found inside."""
    kind = V.kind(c) if variant else F.when(c.isNotNull(), want)
    return F.when(F.coalesce(kind != want, F.lit(True)), issue(path, "wrong kind", want, kind)).otherwise(_some(found))


def array(item: Schema) -> Schema:
    """All elements are checked and all issues kept, under the element's index."""

    def run(c, path, variant):
        v = F.try_variant_get(c, "$", "array<variant>") if variant else c
        found = F.flatten(F.transform(v, lambda x, i: F.coalesce(item.run(x, _path(path, i), variant)[1], no_issues())))
        return F.transform(v, lambda x, i: item.run(x, _path(path, i), variant)[0]), _whole(c, path, variant, "array", found)

    return Schema(run, "array")


def record(item: Schema) -> Schema:
    """A map from names to values, each checked, issues under the name."""

    def run(c, path, variant):
        m = F.try_variant_get(c, "$", "map<string,variant>") if variant else c
        found = F.flatten(F.transform(F.map_entries(m), lambda e: F.coalesce(item.run(e["value"], _path(path, e["key"]), variant)[1], no_issues())))
        return F.transform_values(m, lambda k, x: item.run(x, _path(path, k), variant)[0]), _whole(c, path, variant, "object", found)

    return Schema(run, "record")


def union(*branches: Schema) -> Schema:
    """The value of the first branch without issues; if all have some, the issues of the branch with the fewest, the first
    of equals. Branches must give one type."""

    def run(c, path, variant):
        got = [b.run(c, path, variant) for b in branches]
        value = F.lit(None)
        for v, i in reversed(got):
            value = F.when(i.isNull(), v).otherwise(value)
        sized = F.array(*[F.struct(F.coalesce(F.size(i), F.lit(0)).alias("n"), F.lit(k).alias("k"), i.alias("i")) for k, (_, i) in enumerate(got)])
        return value, _let(sized, lambda a: F.when(F.forall(a, lambda x: x["i"].isNotNull()), F.array_min(a)["i"]))

    return Schema(run, "union", any(b.takes_missing for b in branches))


def _fields(pairs: dict[str, tuple[Column, Column]]) -> tuple[Column, Column]:
    value = F.struct(*[v.alias(n) for n, (v, _) in pairs.items()])
    return value, F.concat(*[F.coalesce(i, no_issues()) for _, i in pairs.values()])


def obj(**fields: Schema) -> Schema:
    """A struct of the fields, all checked and all issues kept; further names are ignored."""

    def run(c, path, variant):
        value, found = _fields({n: s.run(V.at_path(c, n) if variant else c[n], _path(path, F.lit(n)), variant) for n, s in fields.items()})
        return value, _whole(c, path, variant, "object", found)

    return Schema(run, "object")


def row(fields: dict[str, Schema]) -> Schema:
    """As ``obj``, over the columns of a DataFrame themselves."""

    def run(c, path, variant):
        value, found = _fields({n: s.run(col(n), _path(path, F.lit(n)), variant) for n, s in fields.items()})
        return value, _some(found)

    return Schema(run, "row")


def split(df: DataFrame, schema: Schema, c: Column | str | None = None, variant: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid rows with ``value``, the others with ``issues``)."""
    done = schema.parse(df, F.lit(None) if c is None else c, variant=variant)
    return done.filter("ok").drop("issues", "ok"), done.filter("not ok").drop("value", "ok")
