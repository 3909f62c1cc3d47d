"""Sums of floating-point columns that do not depend on the order of addition.

A DOUBLE is a 53-bit whole number times a power of two. Values are grouped by exponent, 16 powers of
two to a bucket, and scaled (exactly, by powers of two) to whole numbers below 2^70, which are cut into
four limbs of 18 bits. Limbs are summed as BIGINT, so neither partitions, retries nor partial
aggregates can change a sum: a group and bucket may hold 2^45 values before a limb overflows, which is
an error, not a wrong result. Each group's few buckets are added once, from the largest down, with the
rounding error of every addition carried along, and rounded at the end.

Whole numbers and DECIMAL are summed as decimals, which is exact already. NaN counts as missing; an
infinity decides the sum as in IEEE arithmetic (two opposite ones give NaN).

The bucket is a grouping column, so Spark's partial aggregation applies: a task sends one row a group
and bucket. Data of one magnitude has one to three buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import named, quoted

SPREAD = 16                      # powers of two in a bucket
WIDTH, LIMBS = 18, 4             # bits of a limb, limbs of a value
POINT = 53                       # a bucket b counts in units of 2^(SPREAD b - POINT)
HALF = 32                        # a limb's sum is taken apart here to become exact doubles


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def _limbs(c: str, i: int) -> list[str]:
    """SQL for the parts of a DOUBLE column, each using those before it: _b (bucket; none for zero, missing and
    infinite), _l (limbs from the lowest), _x (the value if it is infinite), _v (the value, NaN missing)."""
    # the usual magnitudes by comparison; logarithms and powers only for the others
    usual = (0, 1, -1, 2, -2)
    near = " ".join(f"when _s{i} >= {2.0 ** (SPREAD * n)!r}D and _s{i} < {2.0 ** (SPREAD * (n + 1))!r}D then {n}" for n in usual)
    unit = " ".join(f"when {n} then {2.0 ** (POINT - SPREAD * n)!r}D" for n in usual)
    power, cut, mask = f"({POINT} - _b{i} * {SPREAD})", f"{2.0 ** (2 * WIDTH)!r}D", (1 << WIDTH) - 1
    pieces = [piece for half in (f"_o{i}", f"_h{i}") for piece in (f"({half} & {mask})", f"shiftright({half}, {WIDTH})")]
    return [
        f"if(isnan({quoted(c)}), null, cast({quoted(c)} as double)) as _v{i}",
        f"abs(_v{i}) as _s{i}",
        f"case {near} when _s{i} > 0 and _s{i} < cast('Infinity' as double) then cast(floor(log2(_s{i}) / {SPREAD}) as int) end as _b{i}",
        f"case _b{i} {unit} end as _m{i}",
        f"if(_m{i} is not null, _s{i} * _m{i}, _s{i} * pow(2D, floor({power} / 2)) * pow(2D, {power} - floor({power} / 2))) as _w{i}",
        f"floor(_w{i} / {cut}) as _h{i}",
        f"cast(_w{i} - cast(_h{i} as double) * {cut} as bigint) as _o{i}",
        *[f"if(_v{i} < 0, -{piece}, {piece}) as _l{i}_{j}" for j, piece in enumerate(pieces)],
        f"if(_s{i} = cast('Infinity' as double), _v{i}, null) as _x{i}"]


def partial_sums(df: DataFrame, keys: list[str], sums: dict[str, str], rows: str | None = None,
                 lows: dict[str, str] | None = None, highs: dict[str, str] | None = None,
                 others: dict[str, Column] | None = None) -> DataFrame:
    """Sums still in parts: a row a group and bucket, to be joined, regrouped and finished by ``whole_sums``.

    ``sums``, ``lows`` (minimum), ``highs`` (maximum): result name → numeric column; ``rows``: name of the row count;
    ``others``: aggregates of groups that have no value to sum, and so no bucket.
    """
    aggs: list[str] = []
    parts, buckets = [], []
    for i, c in enumerate(sums.values()):
        if is_floating(df.schema[c].dataType):
            parts += _limbs(c, i)
            buckets.append(f"_b{i}")
            aggs += [f"sum(_l{i}_{j}) as _l{i}_{j}" for j in range(LIMBS)]
            aggs += [f"sum(_x{i}) as _x{i}", f"count(_v{i}) as _n{i}"]
        else:
            wide = f"cast({quoted(c)} as decimal(20,0))" if isinstance(df.schema[c].dataType, T.IntegralType) else quoted(c)
            aggs += [f"sum({wide}) as _d{i}", f"count({quoted(c)}) as _n{i}"]
    for fn, wanted in (("min", lows or {}), ("max", highs or {})):
        for name, c in wanted.items():
            value = f"if(isnan({quoted(c)}), null, {quoted(c)})" if is_floating(df.schema[c].dataType) else quoted(c)
            aggs.append(f"{fn}({value}) as {quoted(name)}")
    if rows:
        aggs.append(f"count(1) as {quoted(rows)}")
    data = df.selectExpr("*", *parts) if parts else df
    return data.groupBy(*[named(k) for k in keys], *buckets).agg(
        *[F.expr(a) for a in aggs], *[a.alias(name) for name, a in (others or {}).items()])


def _added(i: int) -> str:
    """SQL that adds the collected parts ``_p{i}`` of a group: one DOUBLE."""
    terms = []
    for j in reversed(range(LIMBS)):
        for piece, shift in ((f"shiftright(abs(p.l{j}), {HALF})", HALF), (f"(abs(p.l{j}) & {(1 << HALF) - 1}L)", 0)):
            power = f"(p.b * {SPREAD} + {j * WIDTH - POINT + shift})"
            terms.append(f"signum(p.l{j}) * cast({piece} as double) * pow(2D, floor({power} / 2)) * pow(2D, {power} - floor({power} / 2))")
    every = f"flatten(transform(sort_array(_p{i}, false), p -> array({', '.join(terms)})))"
    s, back = "(a.s + t)", "((a.s + t) - a.s)"
    step = f"named_struct('s', {s}, 'e', a.e + ((a.s - ({s} - {back})) + (t - {back})))"
    return f"aggregate({every}, named_struct('s', 0D, 'e', 0D), (a, t) -> {step}, a -> if(isnan(a.e), a.s, a.s + a.e))"


def whole_sums(parts: DataFrame, keys: list[str], sums: dict[str, str], rows: str | None = None,
               lows: dict[str, str] | None = None, highs: dict[str, str] | None = None, counts: bool = False,
               others: dict[str, Column] | None = None) -> DataFrame:
    """Finish ``partial_sums`` by ``keys`` (of the parts, or of what they were joined to).

    Sums of DOUBLE columns are DOUBLE, of others DECIMAL; a group without a value has NULL. With
    ``counts`` the number of values of each sum comes along as ``<name>_n``.
    """
    floating = [i for i in range(len(sums)) if f"_b{i}" in parts.columns]
    aggs: list[str] = []
    for i in range(len(sums)):
        aggs.append(f"sum(_n{i}) as _n{i}")
        if i in floating:
            part = ", ".join(["'b'", f"_b{i}", *(x for j in reversed(range(LIMBS)) for x in (f"'l{j}'", f"_l{i}_{j}"))])
            aggs += [f"collect_list(if(_b{i} is not null, named_struct({part}), null)) as _p{i}", f"sum(_x{i}) as _x{i}"]
        else:
            aggs.append(f"sum(_d{i}) as _d{i}")
    aggs += [f"min({quoted(n)}) as {quoted(n)}" for n in lows or {}]
    aggs += [f"max({quoted(n)}) as {quoted(n)}" for n in (*(highs or {}), *(others or {}))]
    if rows:
        aggs.append(f"sum({quoted(rows)}) as {quoted(rows)}")
    out = [quoted(k) for k in keys]
    for i, name in enumerate(sums):
        value = f"coalesce(_x{i}, {_added(i)})" if i in floating else f"_d{i}"
        out.append(f"if(_n{i} > 0, {value}, null) as {quoted(name)}")
        if counts:
            out.append(f"coalesce(_n{i}, 0) as {quoted(name + '_n')}")
    out += [quoted(n) for n in (*(lows or {}), *(highs or {}), *(others or {}))]
    if rows:
        out.append(f"coalesce({quoted(rows)}, 0) as {quoted(rows)}")
    return parts.groupBy(*[named(k) for k in keys]).agg(*[F.expr(a) for a in aggs]).selectExpr(*out)


def regrouped(parts: DataFrame, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """Parts of a coarser grouping: partial sums added by ``keys`` and bucket."""
    buckets = [c for c in parts.columns if c.startswith("_b")]
    summed = [c for c in parts.columns if c.startswith(("_l", "_x", "_n", "_d"))]
    return parts.groupBy(*[named(k) for k in keys], *buckets).agg(*[F.sum(c).alias(c) for c in summed])


def grouped_sums(df: DataFrame, keys: list[str], sums: dict[str, str], rows: str | None = None,
                 lows: dict[str, str] | None = None, highs: dict[str, str] | None = None, counts: bool = False,
                 others: dict[str, Column] | None = None) -> DataFrame:
    """One row a group (one in all without keys): order-free sums, minima, maxima and counts."""
    return whole_sums(partial_sums(df, keys, sums, rows, lows, highs, others), keys, sums, rows, lows, highs, counts, others)
